"""The registered queries of the numbered operators, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.html_extract import extract_main_text
from corvane.llm.jaccard_join import similar_sets
from corvane.llm.line_dedup import LineIndex, dedup_lines
from corvane.llm.mixing import mix
from corvane.llm.packing import pack
from corvane.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads
from corvane.llm.quality_rules import LENIENT, STANDARD, ablation, apply_policy, ledger
from corvane.llm.secret_scan import ALLOWED, CANDIDATE, CLASSES, WINDOW, secret_scan
from corvane.llm.simhash_dedup import near_duplicates
from corvane.llm.substring_dedup import dedup_substrings
from corvane.llm.token_counts import folded_content, token_counts
from corvane.llm.topk_search import integer_vectors, top_k
from corvane.llm.vector_codes import codebooks_digest, scaled_vectors, vector_codes
from corvane.session import fresh_path, materialise, table


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document; the cache starts empty, so every distinct text is encoded."""
    return token_counts(
        table(spark, sf_dir, "documents"),
        vocabulary("word_bpe_49k.json"),
        fresh_path(spark, "token-cache"),
        limit=2048,
        normalise=folded_content,
        space_matters=False,
    )


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best inner products of every hundredth vector among all vectors."""
    vectors = integer_vectors(table(spark, sf_dir, "embeddings"), scale=1024)
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=1024, end_id=2)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rule ledger of every document under the standard policy."""
    return apply_policy(ledger(table(spark, sf_dir, "documents")))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secret_scan(table(spark, sf_dir, "documents"))


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base kinds of secrets in every document, which SQL can say too."""
    return op5_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without windows of 50 words that an earlier one holds, as a digest."""
    kept = dedup_substrings(table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op7_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"), radius=2, shingle=3)


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return mix(table(spark, sf_dir, "documents"))


def mix_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each source in all."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source")
    taken = op8_source_mixing(spark, sf_dir)
    by_source = taken.join(docs, F.col("doc_id") == F.col("id")).groupBy("source", "source_size")
    return by_source.agg(F.round(F.max("target"), 3).alias("target"), F.sum("taken").alias("taken"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of two policies rejects alone and in all, from one written ledger."""
    stored = materialise(ledger(table(spark, sf_dir, "documents")), "ledger")
    each = [ablation(stored, p).select(F.lit(f"{p.name}-{p.version}").alias("policy"), "*") for p in (STANDARD, LENIENT)]
    return each[0].unionByName(each[1])


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract_main_text(table(spark, sf_dir, "pages"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the lines that three or more share, as a digest; the index grows in two insertions."""
    cleaned = dedup_lines(table(spark, sf_dir, "documents"), fresh_path(spark, "line-index"), batches=2)
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def line_index_after_retraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same once all documents in one language are taken out of the index, which is opened again before and after that."""
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "line-index")
    dedup_lines(docs, path, batches=2)
    LineIndex(spark, path).delete(docs.where("lang = 'fr'"))
    left = LineIndex(spark, path).clean(docs.where("lang IS NULL OR lang <> 'fr'"))
    return left.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every vector: 8 parts, 16 entries, 6 rounds."""
    codes, books = vector_codes(scaled_vectors(table(spark, sf_dir, "embeddings"), scale=4096), parts=8, entries=16, rounds=6)
    return codes.withColumn("codebooks_sha256", F.lit(codebooks_digest(books)))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, linked at a similarity of 0.9 of three-word shingles."""
    return similar_sets(table(spark, sf_dir, "documents"), percent=90, shingle=3)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every node of the trie of conversations that begin like the first one of their hundred."""
    turns = materialise(numbered_turns(table(spark, sf_dir, "conversations")), "numbered-turns")
    return prefix_trie(*with_shared_heads(turns, group=100, most=6))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_topk_search": op2_topk_search,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_secret_scan": op5_secret_scan,
    "secret_counts": secret_counts,
    "op6_substring_dedup": op6_substring_dedup,
    "op7_simhash_near_dedup": op7_simhash_near_dedup,
    "op8_source_mixing": op8_source_mixing,
    "mix_totals": mix_totals,
    "quality_ablation": quality_ablation,
    "op9_html_extraction": op9_html_extraction,
    "op10_line_dedup": op10_line_dedup,
    "line_index_after_retraction": line_index_after_retraction,
    "op11_vector_codes": op11_vector_codes,
    "op12_jaccard_join": op12_jaccard_join,
    "op13_prefix_trie": op13_prefix_trie,
}

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
_STRIP = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

# letters in either case, ASCII alone
_NAMES = "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in "password|passwd|secret|token|api_?key")
_ASSIGN = rf"""({_NAMES})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

SQL: dict[str, str] = {
    "op4_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS ws FROM documents),
        windows AS (SELECT doc_id, i, array_to_string(ws[i : i + 4], ' ') AS w FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 3)) AS i)),
        twice AS (SELECT doc_id, w FROM windows GROUP BY ALL HAVING count(*) > 1),
        covered AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN twice USING (doc_id, w), range(5) r(k)),
        repeats AS (SELECT doc_id, count(*) AS n_repeat_words FROM covered GROUP BY doc_id),
        m AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
            length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols,
            length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS n_upper,
            list_filter(string_split(text, chr(10)), lambda x: length(trim(x, {_STRIP})) > 0) AS ls FROM d),
        n AS (SELECT doc_id, n_words, word_chars, n_symbols, n_upper, CAST(len(ls) AS BIGINT) AS n_word_lines,
            CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM m LEFT JOIN repeats USING (doc_id)),
        f AS (SELECT *, CAST((n_words < 10)::INT + 2 * (100 * n_repeat_words > 20 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
            + 8 * (2 * n_dup_lines > n_word_lines)::INT + 16 * (2 * n_upper > word_chars)::INT
            + 32 * (word_chars < 2 * n_words OR word_chars > 20 * n_words)::INT AS BIGINT) AS failed FROM n)
        SELECT *, (failed & 3) <> 0 AS base_failed, failed = 0 AS kept FROM f""",
    "secret_counts": rf"""
        SELECT doc_id, CAST(len(list_filter(regexp_extract_all(coalesce(text, ''), '{_ASSIGN}', 2), lambda x: length(x) >= 6)) AS BIGINT) AS n_assign,
            CAST(len(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]{{16,}}')) AS BIGINT) AS n_access,
            CAST(len(regexp_extract_all(coalesce(text, ''), '[0-9a-f]{{24,}}')) AS BIGINT) AS n_hex FROM documents""",
    "op5_secret_scan": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        p(no, kind, pattern) AS (VALUES (0, 'assign', '{_ASSIGN}'), (1, 'access', 'AKIA[A-Z0-9]{{16,}}'), (2, 'hex', '[0-9a-f]{{24,}}'), (3, 'entropy', '{CANDIDATE}')),
        m AS (SELECT doc_id, no, kind, regexp_extract_all(text, pattern) AS hits, regexp_split_to_array(text, pattern) AS gaps FROM d, p),
        u AS (SELECT doc_id, no, kind, unnest(hits) AS hit, unnest(gaps[1 : len(hits)]) AS gap, generate_subscripts(hits, 1) AS i FROM m),
        spans AS (SELECT doc_id, no, kind, hit, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, no ORDER BY i) AS stop FROM u),
        base AS (SELECT doc_id, no, kind, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM spans
            WHERE no < 3 AND (no > 0 OR length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 6)),
        -- the characters of candidates that no base span holds, in runs
        chars AS (SELECT doc_id, stop, CAST(stop - length(hit) AS BIGINT) + unnest(range(length(hit))) AS pos, unnest(string_split(hit, '')) AS c FROM spans WHERE no = 3),
        free AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id, stop ORDER BY pos) AS run FROM chars
            WHERE NOT EXISTS (FROM base b WHERE b.doc_id = chars.doc_id AND b.start <= pos AND pos < b.stop)),
        parts AS (SELECT doc_id, min(pos) AS start, string_agg(c, '' ORDER BY pos) AS hit FROM free GROUP BY doc_id, stop, run HAVING count(*) >= {WINDOW}),
        judged AS (SELECT *, CASE {" ".join(f"WHEN regexp_matches(hit, '{c.pattern}') THEN {c.least_bits}" for c in CLASSES)} END AS least FROM parts
            WHERE {" AND ".join(f"NOT regexp_matches(hit, '{x}')" for x in ALLOWED)}),
        windows AS (SELECT doc_id, start, least, i, unnest(string_split(hit[i + 1 : i + {WINDOW}], '')) AS c
            FROM judged, LATERAL (SELECT unnest(range(length(hit) - {WINDOW - 1})) AS i)),
        counts AS (SELECT doc_id, start, least, i, c, count(*) AS n FROM windows GROUP BY ALL),
        random AS (SELECT doc_id, start, i FROM counts GROUP BY doc_id, start, least, i HAVING log2({WINDOW}) - sum(n * log2(n)) / {WINDOW} >= least - 1e-10),
        every AS (FROM base UNION ALL SELECT doc_id, 3, 'entropy', start + min(i), start + max(i) + {WINDOW} FROM random GROUP BY doc_id, start),
        listed AS (SELECT doc_id, count(*) FILTER (no = 0) AS n_assign, count(*) FILTER (no = 1) AS n_access, count(*) FILTER (no = 2) AS n_hex, count(*) FILTER (no = 3) AS n_entropy,
            string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, no, stop) FILTER (no < 3) AS base,
            string_agg(concat_ws(':', kind, start, stop), ',' ORDER BY start, no, stop) AS spans FROM every GROUP BY doc_id)
        SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, coalesce(n_entropy, 0) AS n_entropy,
            sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN listed USING (doc_id)""",
    "op6_substring_dedup": rf"""
        WITH d AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
        windows AS (SELECT doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS w FROM d, LATERAL (SELECT unnest(range(1, len(ws) - 48)) AS i)),
        first AS (SELECT w, min(doc_id) AS first_doc FROM windows GROUP BY w),
        lost AS (SELECT DISTINCT doc_id, i + k AS j FROM windows JOIN first USING (w), range(50) r(k) WHERE first_doc < doc_id),
        words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS j FROM d),
        kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY j) AS text FROM words ANTI JOIN lost USING (doc_id, j) GROUP BY doc_id)
        SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
        FROM d LEFT JOIN kept USING (doc_id)""",
    "op10_line_dedup": f"""
        WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
        keyed AS (SELECT *, translate(trim(line, {_STRIP}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
        common AS (SELECT key, max(doc_id) AS last_doc FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3)
        SELECT doc_id, count(*) AS n_lines, count(*) FILTER (last_doc > doc_id) AS n_dropped,
            sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (last_doc IS NULL OR last_doc = doc_id), '')) AS kept_sha256
        FROM keyed LEFT JOIN common USING (key) GROUP BY doc_id""",
    "op2_topk_search": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e FROM embeddings
            WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
                vec_id, score
            FROM scored
        )
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10""",
}
# the same over the documents that stay
SQL["line_index_after_retraction"] = SQL["op10_line_dedup"].replace("FROM documents)", "FROM documents WHERE lang IS NULL OR lang <> 'fr')")
SQL["quality_ablation"] = f"""
    WITH l AS ({SQL["op4_quality_rules"]}),
    p(policy, rule, bit, mask) AS (VALUES ('standard-1', 'too_few_words', 1, 63), ('standard-1', 'repeated_windows', 2, 63), ('standard-1', 'symbol_heavy', 4, 63),
        ('standard-1', 'repeated_lines', 8, 63), ('standard-1', 'shouting', 16, 63), ('standard-1', 'odd_word_length', 32, 63),
        ('lenient-1', 'too_few_words', 1, 19), ('lenient-1', 'repeated_windows', 2, 19), ('lenient-1', 'shouting', 16, 19))
    SELECT policy, rule, count(*) FILTER (failed & bit <> 0) AS n_failed, count(*) FILTER (failed & mask = bit) AS n_only FROM l, p GROUP BY policy, rule"""
# what every source has and is to give
_TARGETS = f"""
    s AS (SELECT source, CAST(sum(len({_WORDS})) AS BIGINT) AS source_size FROM documents GROUP BY source),
    n AS (SELECT *, CAST(1 + (row_number() OVER (ORDER BY source IS NULL, source COLLATE "C") - 1) % 3 AS DOUBLE) AS w, CAST(3 * source_size AS DOUBLE) AS cap,
        CAST(sum(source_size) OVER () AS DOUBLE) AS total FROM s),
    -- the level that would give all, were just the sources full that fill up at or below a point: the true one is the highest of them
    v AS (SELECT a.cap / a.w AS at, any_value(a.total) AS total, sum(b.cap) FILTER (b.cap / b.w <= a.cap / a.w) AS full_up,
        sum(b.w) FILTER (b.cap / b.w > a.cap / a.w) AS others FROM n a, n b GROUP BY a.cap / a.w),
    g AS (SELECT max(x) AS level FROM (SELECT (SELECT any_value(total) / sum(w) FROM n) AS x UNION ALL SELECT (total - full_up) / others FROM v WHERE others > 0)),
    targets AS (SELECT source, source_size, least(cap, level * w) AS target FROM n, g)"""
SQL["mix_totals"] = f"WITH {_TARGETS} SELECT source, source_size, round(target, 3) AS target, CAST(round(target) AS BIGINT) AS taken FROM targets"
SQL["op8_source_mixing"] = f"""
    WITH {_TARGETS},
    d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || md5(concat_ws(':', doc_id, 42))[1:15] AS BIGINT) AS key FROM documents),
    o AS (SELECT d.*, source_size, target, CAST(round(target) AS BIGINT) AS budget,
        CAST(coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
        FROM d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    e AS (SELECT *, coalesce(budget // nullif(source_size, 0), 0) AS epochs FROM o)
    SELECT doc_id, size, source_size, target, epochs * size + greatest(0, least(size, budget - epochs * source_size - before)) AS taken FROM e"""

def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Each round assigns every part to its nearest entry and then makes new entries of floored means."""
    distance = "list_sum(list_transform(list_zip(x, c), lambda t: (t[1] - t[2]) * (t[1] - t[2])))"
    assigned = f"SELECT rid, p, any_value(x) AS x, arg_min(e, {distance} * {entries} + e) AS e, min({distance}) AS d FROM v JOIN {{}} USING (p) GROUP BY rid, p"
    floored = "CAST((s - ((s % n + n) % n)) // n AS BIGINT)"
    steps = [f"""
        a{k} AS MATERIALIZED ({assigned.format(f"e{k}")}),
        s{k} AS (SELECT p, e, j, CAST(sum(x[j]) AS BIGINT) AS s, count(*) AS n FROM a{k}, LATERAL (SELECT unnest(range(1, len(x) + 1)) AS j) GROUP BY p, e, j),
        m{k} AS (SELECT p, e, list({floored} ORDER BY j) AS c FROM s{k} GROUP BY p, e),
        e{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m{k}.c, e{k}.c) AS c FROM e{k} LEFT JOIN m{k} USING (p, e))""" for k in range(rounds)]  # fmt: skip
    return f"""
        WITH kept AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * x::DOUBLE) AS BIGINT)) AS f,
            row_number() OVER (ORDER BY vec_id NULLS LAST, f) AS rid FROM embeddings
            WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        v AS MATERIALIZED (SELECT rid, p, f[p * len(f) // {parts} + 1 : (p + 1) * len(f) // {parts}] AS x FROM kept, range({parts}) r(p)),
        e0 AS MATERIALIZED (SELECT p, rid - 1 AS e, x AS c FROM v WHERE rid <= {entries}),{",".join(steps)},
        placed AS (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
            FROM ({assigned.format(f"e{rounds}")}) GROUP BY rid)
        SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
            (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) FROM e{rounds}) AS codebooks_sha256
        FROM placed JOIN kept USING (rid)"""


SQL["op11_vector_codes"] = _codes_sql()

# CRC-32 of a decimal id, a bit at a time
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)),
    lambda crc, byte: list_reduce(list_prepend(xor(crc, byte), range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""
SQL["op13_prefix_trie"] = f"""
    WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
    c AS (SELECT conv_id, {_CRC} % 6 AS h, list({{'turn': concat(strlen(role), ':', role, strlen(text), ':', text), 'size': length(text)}}
        ORDER BY turn NULLS FIRST, md5(concat(strlen(role), ':', role, text))) AS own FROM t GROUP BY conv_id),
    p AS (SELECT c.conv_id, list_concat(coalesce(b.own[1 : c.h], []), c.own[c.h + 1 :]) AS path FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 100),
    occ AS MATERIALIZED (SELECT conv_id, d, len(path) = d AS ends, coalesce(path[d].size, 0) AS size,
        md5(array_to_string(list_transform(path[1 : d], lambda x: x.turn), '')) AS key FROM p, LATERAL (SELECT unnest(range(len(path) + 1)) AS d)),
    n AS MATERIALIZED (SELECT d, key, min(conv_id) AS owner, count(*) AS n_convs, any_value(size) AS size,
        string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends) AS ended FROM occ GROUP BY d, key),
    up AS (SELECT n.d, n.key, p.key AS above FROM n JOIN occ p ON p.conv_id = n.owner AND p.d = n.d - 1),
    kids AS (SELECT d - 1 AS d, above AS key, count(*) AS n_children FROM up GROUP BY ALL),
    sub AS (SELECT a.d, a.key, sum((n.n_convs - 1) * n.size) AS saved, count(*) FILTER (n_children IS NULL) AS n_leaves
        FROM n LEFT JOIN kids USING (d, key) JOIN occ a ON a.conv_id = n.owner AND a.d <= n.d GROUP BY a.d, a.key)
    SELECT n.owner AS conv_id, n.d AS depth, p.owner AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves,
        CAST(saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ended, '')) AS ends_sha256
    FROM n JOIN sub USING (d, key) LEFT JOIN kids USING (d, key) LEFT JOIN up USING (d, key) LEFT JOIN n p ON p.d = n.d - 1 AND p.key = up.above"""

_LOWER_WORDS = _WORDS.replace("coalesce(text, '')", "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
SQL["op12_jaccard_join"] = rf"""
    WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} AS ws FROM documents),
    s AS MATERIALIZED (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 2], ' ') AS shingle FROM d, LATERAL (SELECT unnest(range(1, greatest(1, len(ws) - 2) + 1)) AS i) WHERE len(ws) > 0),
    sets AS MATERIALIZED (SELECT doc_id, count(*) AS n, md5(string_agg(shingle, chr(10) ORDER BY shingle)) AS digest FROM s GROUP BY doc_id),
    one AS MATERIALIZED (SELECT min(doc_id) AS doc_id, any_value(n) AS n, digest FROM sets GROUP BY digest),
    t AS MATERIALIZED (SELECT doc_id, n, shingle FROM s JOIN one USING (doc_id)),
    links AS MATERIALIZED (SELECT a.doc_id AS x, b.doc_id AS y FROM t a JOIN t b ON a.shingle = b.shingle AND a.doc_id < b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
        GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
    edges AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
    reach(x, y) AS (SELECT doc_id, doc_id FROM one UNION SELECT r.x, b.y FROM reach r JOIN edges b ON r.y = b.x),
    c AS (SELECT x AS doc_id, min(y) AS component_id FROM reach GROUP BY x)
    SELECT d.doc_id, coalesce(sets.n, 0) AS n_shingles, coalesce(c.component_id, d.doc_id) AS component_id
    FROM d LEFT JOIN sets USING (doc_id) LEFT JOIN one USING (digest) LEFT JOIN c ON c.doc_id = one.doc_id"""
