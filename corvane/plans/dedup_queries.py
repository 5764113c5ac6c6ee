"""Queries over staged de-duplication."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import dedup
from corvane.plans.catalog import SQL, query
from corvane.plans.text_queries import FLAT
from corvane.session import materialise, table

#: Chains of parents are followed to their end where no bound keeps them short; rounds grow with its logarithm.
MANY_HOPS = 1 << 40

_PRINTS = """
    words AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: length(x) > 1)) AS w FROM documents),
    long_docs AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id HAVING count(*) >= 16),
    counted AS (SELECT doc_id, w, count(*) AS c FROM words SEMI JOIN long_docs USING (doc_id) GROUP BY ALL),
    hashed AS (SELECT w, sha256(w) AS h FROM (SELECT DISTINCT w FROM counted)),
    bits AS (SELECT w, b, ((strpos('0123456789abcdef', substr(h, CAST(2 * (b // 8) + CASE WHEN b % 8 >= 4 THEN 1 ELSE 2 END AS INT), 1)) - 1) >> CAST(b % 4 AS INT)) & 1 AS bit
        FROM hashed, range(64) r(b)),
    sums AS (SELECT doc_id, b, sum(CASE WHEN bit = 1 THEN c ELSE -c END) AS s FROM counted JOIN bits USING (w) GROUP BY ALL),
    prints AS (SELECT doc_id, CAST(sum(CASE WHEN s <= 0 THEN 0 WHEN b = 63 THEN -9223372036854775808 ELSE CAST(pow(2, b) AS HUGEINT) END) AS BIGINT) AS print
        FROM sums GROUP BY doc_id)"""
_NEAR = f"""{_PRINTS},
    ranked AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS r FROM prints),
    near AS (SELECT a.doc_id, b.doc_id AS parent, bit_count(xor(a.print, b.print)) AS distance FROM ranked a JOIN ranked b
        ON b.r BETWEEN a.r - 500 AND a.r - 1 WHERE bit_count(xor(a.print, b.print)) <= 3),
    simhash AS (SELECT doc_id, arg_min(parent, distance * 10000000000 + parent) AS parent, CAST(min(distance) AS INT) AS distance FROM near GROUP BY doc_id)"""
_EXACT = f"hashes AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256('||' || {FLAT})) AS parent FROM documents)"


def _stages(spark, d, candidates=dedup.simhash_candidates):
    docs = table(spark, d, "documents", spread=True)
    empty = F.lit(None).cast("string")
    exact = dedup.parent_by_key(docs, T.content_hash(empty, empty, F.col("text")))
    near = candidates(materialise(dedup.simhash_fingerprints(docs), "prints"))
    return docs, [("content_hash", exact), ("simhash", near)]


@query(f"WITH {_EXACT} SELECT doc_id, parent FROM hashes WHERE parent < doc_id")
def dedup_exact_canonical(spark, d):
    return _stages_exact(spark, d)


def _stages_exact(spark, d):
    empty = F.lit(None).cast("string")
    return dedup.parent_by_key(table(spark, d, "documents", spread=True), T.content_hash(empty, empty, F.col("text")))


@query("""
    WITH u AS (SELECT page_id, split_part(url, '#', 1) AS url FROM pages),
    p AS (SELECT page_id, split_part(url, '?', 1) || '?' || array_to_string(list_sort(list_filter(string_split(split_part(url, '?', 2), '&'),
        lambda x: x <> '' AND NOT (split_part(x, '=', 1) = 'ref' OR starts_with(x, 'utm_')))), '&') AS k FROM u)
    SELECT page_id, parent FROM (SELECT page_id, min(page_id) OVER (PARTITION BY k) AS parent FROM p) WHERE parent < page_id""")
def dedup_canonical_url(spark, d):
    from corvane.functions.urls import canonical_url

    pages = table(spark, d, "pages", spread=True).where(~T.is_import_url(F.col("url")))
    return dedup.parent_by_key(pages, canonical_url("url"), "page_id")


@query("""
    SELECT item_id, parent FROM (SELECT conv_id * 1000 + turn AS item_id, min(conv_id * 1000 + turn) OVER (PARTITION BY role, text) AS parent
        FROM conversations WHERE text <> '') WHERE parent < item_id""")
def dedup_external_key(spark, d):
    """The platform and external id stage, with role and text as a message's key."""
    rows = table(spark, d, "conversations").where("text <> ''").select((F.col("conv_id") * 1000 + F.col("turn")).alias("item_id"), F.concat_ws("|", "role", "text").alias("key"))
    return dedup.parent_by_key(rows, F.col("key"), "item_id")


@query(f"WITH {_PRINTS} SELECT doc_id, print FROM prints")
def simhash_fingerprints(spark, d):
    return dedup.simhash_fingerprints(table(spark, d, "documents", spread=True))


@query(f"WITH {_NEAR} SELECT doc_id, parent, distance FROM simhash")
def simhash_near_pairs(spark, d):
    return _stages(spark, d)[1][1][1]


_STAGED = f"""WITH {_NEAR}, {_EXACT},
    staged AS (SELECT doc_id, CASE WHEN h.parent < doc_id THEN 'content_hash' WHEN s.parent IS NOT NULL THEN 'simhash' END AS stage,
        CASE WHEN h.parent < doc_id THEN h.parent ELSE s.parent END AS parent FROM hashes h LEFT JOIN simhash s USING (doc_id))"""


@query(f"{_STAGED} SELECT doc_id, stage, parent FROM staged")
def dedup_all_stages(spark, d):
    docs, stages = _stages(spark, d)
    return dedup.staged_parents(docs, stages)


_ROOTS = f"""{_STAGED.replace('WITH', 'WITH RECURSIVE', 1)},
    up AS (SELECT doc_id, coalesce(parent, doc_id) AS root, parent IS NULL AS done FROM staged
        UNION ALL SELECT u.doc_id, coalesce(s.parent, s.doc_id), s.parent IS NULL FROM up u JOIN staged s ON s.doc_id = u.root WHERE NOT u.done)"""


@query(f"{_ROOTS} SELECT doc_id, root FROM up WHERE done")
def forest_roots(spark, d):
    docs, stages = _stages(spark, d)
    return dedup.forest_roots(dedup.staged_parents(docs, stages), MANY_HOPS)


@query(f"{_ROOTS} SELECT u.root AS canonical, doc_id, stage FROM up u JOIN staged USING (doc_id) WHERE done AND parent IS NOT NULL")
def duplicate_groups(spark, d):
    docs, stages = _stages(spark, d)
    staged = materialise(dedup.staged_parents(docs, stages), "staged")
    return dedup.duplicate_groups(staged, dedup.forest_roots(staged, MANY_HOPS))


@query(f"{_STAGED} SELECT count(*) AS examined, count(parent) AS duplicates, count(parent)::DOUBLE / count(*) AS rate FROM staged")
def duplicate_rate(spark, d):
    docs, stages = _stages(spark, d)
    return dedup.duplicate_rate(dedup.staged_parents(docs, stages))


# the same without a bound on how far apart near copies may lie


def _far(sql: str) -> str:
    return sql.replace("b.r BETWEEN a.r - 500 AND a.r - 1", "b.r < a.r")


def _unbounded_stages(spark, d):
    return _stages(spark, d, dedup.simhash_candidates_unbounded)


def _unbounded_staged(spark, d):
    docs, stages = _unbounded_stages(spark, d)
    return materialise(dedup.staged_parents(docs, stages), "staged")


@query(_far(SQL["simhash_near_pairs"]))
def simhash_near_pairs_unbounded(spark, d):
    return _unbounded_stages(spark, d)[1][1][1]


@query(_far(SQL["dedup_all_stages"]))
def dedup_all_stages_unbounded(spark, d):
    return _unbounded_staged(spark, d)


@query(_far(SQL["forest_roots"]))
def forest_roots_unbounded(spark, d):
    return dedup.forest_roots(_unbounded_staged(spark, d), MANY_HOPS)


@query(_far(SQL["duplicate_groups"]))
def duplicate_groups_unbounded(spark, d):
    staged = _unbounded_staged(spark, d)
    return dedup.duplicate_groups(staged, dedup.forest_roots(staged, MANY_HOPS))


@query(_far(SQL["duplicate_rate"]))
def duplicate_rate_unbounded(spark, d):
    return dedup.duplicate_rate(_unbounded_staged(spark, d))
