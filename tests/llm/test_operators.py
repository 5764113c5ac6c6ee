"""Every operator against brute force on hostile rows, on an empty table, and with null ids."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import line_dedup, mixing, packing, quality_rules, secret_scan, simhash_dedup, substring_dedup, token_counts, topk_search
from corvane.llm.queries import vocabulary
from corvane.session import fresh_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def tokenizer(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(name))


def by(df, *columns):
    return sorted(df.select(*columns).collect(), key=str)


def expect(df, columns, wanted):
    assert by(df, *columns) == sorted(wanted, key=str)


def ascii_lower(s):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in s)


# 1


def test_token_counts(spark, docs, rows):
    t = tokenizer("word_bpe_49k.json")
    cache = fresh_path(spark, "cache")
    count = lambda d: token_counts.token_counts(d, vocabulary("word_bpe_49k.json"), cache, 20, token_counts.folded_content, False)
    wanted = [(r[0], len((r[1] or "").encode()), n := len(t.encode(r[1] or "", add_special_tokens=False).ids), n > 20) for r in rows]
    expect(count(docs), ["doc_id", "n_bytes", "n_tokens", "over_limit"], wanted)
    files = spark.read.parquet(cache)
    before = files.count()
    expect(count(docs), ["doc_id", "n_bytes", "n_tokens", "over_limit"], wanted)
    assert spark.read.parquet(cache).count() == before  # nothing was encoded again
    assert files.groupBy("digest").count().where("count > 1").isEmpty()


def test_token_counts_cased(spark, docs, rows):
    t = tokenizer("byte_bpe_50k.json")
    got = token_counts.token_counts(docs, vocabulary("byte_bpe_50k.json"), fresh_path(spark, "cache"))
    expect(got, ["doc_id", "n_tokens"], [(r[0], len(t.encode(r[1] or "", add_special_tokens=False).ids)) for r in rows])


def test_memo_that_is_full_still_counts(monkeypatch):
    from corvane.llm import tokens

    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 3)
    memo = tokens.TokenMemo(vocabulary("byte_bpe_50k.json"), True, True)
    t = tokenizer("byte_bpe_50k.json")
    for text in ("one two three four", "five six seven", "one two nine ten", "one two nine ten"):
        assert memo.encode(text) == len(t.encode(text).ids)


# 2


def test_top_k(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 16)).astype(np.float32)
    v[50:300] = v[0]  # many equal vectors
    data = [(int(i), [float(x) for x in r]) for i, r in enumerate(v)]
    data += [(900, None), (1000, [float("nan")] * 16), (1100, [None] + [0.0] * 15), (1200, [float("inf")] * 16), (None, [1.0] * 16)]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("v", F.lit(1))
    ints = topk_search.integer_vectors(frame)
    got = topk_search.top_k(ints, ints.where("vec_id % 100 = 0"), 10)
    whole = np.floor(v.astype(np.float64) * 1024).astype(np.int64)
    wanted = []
    for q in range(0, 700, 100):
        scores = whole @ whole[q]
        order = [i for i in np.lexsort((np.arange(700), -scores)) if i != q][:10]
        wanted += [(q, n + 1, int(i), int(scores[i])) for n, i in enumerate(order)]
    expect(got, ["query_id", "rank", "vec_id", "score"], wanted)


def test_top_k_of_few(spark):
    ints = topk_search.integer_vectors(spark.createDataFrame([(0, [1.0, 2.0]), (1, [0.5, 0.5])], "vec_id long, embedding array<float>"))
    expect(topk_search.top_k(ints, ints.where("vec_id = 0")), ["query_id", "rank", "vec_id"], [(0, 1, 1)])
    assert topk_search.top_k(ints.limit(0), ints.limit(0)).isEmpty()


def plain_top_k(rows, k):
    out = []
    for q in sorted({i for i, _ in rows if i % 100 == 0}):
        for asked in {tuple(v) for i, v in rows if i == q}:
            scores = sorted((-int(np.dot(asked, v)), i) for i, v in rows if i != q and len(v) == len(asked))[:k]
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return out


@pytest.mark.parametrize("blocks", [(8192, 4096, 256), (7, 3, 2)])
def test_top_k_of_repeated_ids(spark, monkeypatch, blocks):
    for name, n in zip(("CANDIDATE_BLOCK", "QUERY_BLOCK", "TILE"), blocks):
        monkeypatch.setattr(topk_search, name, n)
    rng = np.random.default_rng(3)
    same, far = [3, 4, 5, 6, 7, 8, 9, 10], [1 << 40] * 8
    rows = [(100, same)] * 12 + [(200, same)] + [(201, same)] * 3 + [(300, far), (301, [5])]  # many rows of one id and vector
    rows += [(int(i), [int(x) for x in rng.integers(-3, 4, 8)]) for i in rng.integers(202, 260, 60)]
    rows += [(int(i), same) for i in rng.integers(250, 270, 30)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>").repartition(3)
    for k in (1, 4, 10):
        got = topk_search.top_k(vectors, vectors.where("vec_id % 100 = 0"), k)
        expect(got, ["query_id", "rank", "vec_id", "score"], plain_top_k(rows, k))


def test_bounds_hold():
    rng = np.random.default_rng(2)
    q, c = rng.integers(-2000, 2000, (5, 24)), rng.integers(-2000, 2000, (40, 24))
    for n in (1, 3, 4, 24):
        upper = topk_search._statistics(q, n) @ topk_search._statistics(c, n).T
        assert (upper >= q @ c.T - 1e-6 * np.abs(upper)).all()


# 3


def test_packing(docs, rows):
    t = tokenizer("byte_bpe_50k.json")
    got = packing.pack(docs, vocabulary("byte_bpe_50k.json"), 64, 2).collect()
    wanted = []
    for r in rows:
        ids = np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 2], "<u4")
        cuts = [0, *range(len(ids) % 64 or 64, len(ids), 64), len(ids)] if len(ids) > 64 else [0, len(ids)]
        wanted += [(r[0], i, a, b - a, zlib.crc32(ids[a:b].tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(r[:5] for r in got) == sorted(wanted)
    at = defaultdict(list)
    for r in got:
        at[r.sequence_id].append((r.offset, r.length))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 64
    total = sum(w[3] for w in wanted)
    assert len(at) <= 11 / 9 * -(-total // 64) + 1


def test_packing_nothing(empty):
    assert packing.pack(empty, vocabulary("byte_bpe_50k.json")).isEmpty()


def _optimum(items, capacity):
    best = [len(items)]
    items = sorted(items, reverse=True)

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        tried = set()
        for b in range(len(bins)):
            if bins[b] >= items[i] and bins[b] not in tried:
                tried.add(bins[b])
                bins[b] -= items[i]
                go(i + 1, bins)
                bins[b] += items[i]
        go(i + 1, [*bins, capacity - items[i]])

    go(0, [])
    return best[0]


@pytest.mark.parametrize("seed", range(60))
def test_reduction_keeps_an_optimum(seed):
    rng = np.random.default_rng(seed)
    items = rng.integers(1 + 12 * (seed % 3), 60, rng.integers(1, 10)).tolist()
    fixed, left = packing.reduce_dominated(Counter(items), 64)
    assert all(x.used <= 64 for x in fixed)
    rest = [n for n, c in left.items() for _ in range(c)]
    used = [n for x in fixed for n, k in x.parts for _ in range(k * x.count)]
    assert sorted(rest + used) == sorted(items)
    assert sum(x.count for x in fixed) + _optimum(rest, 64) == _optimum(items, 64)


@pytest.mark.parametrize("seed", range(10))
def test_layouts_hold_every_length(seed):
    counts = Counter(np.random.default_rng(seed).integers(1, 101, 3000).tolist())
    layouts = packing.plan_layouts(counts, 100)
    held = Counter()
    for x in layouts:
        assert x.used <= 100
        for length, n in x.parts:
            held[length] += n * x.count
    assert held == counts
    items, bound = list(counts.elements()), 0
    for k in range(51):  # lengths over half fill sequences of their own; what of the rest can't go beside them needs more
        over = [n for n in items if n > 100 - k]
        half = [n for n in items if 50 < n <= 100 - k]
        rest = sum(n for n in items if k <= n <= 50)
        bound = max(bound, len(over) + len(half) + max(0, -(-(rest - 100 * len(half) + sum(half)) // 100)))
    assert sum(x.count for x in layouts) <= bound * 1.01 + 1


# 4


def measures(text):
    w = WORD.findall(text or "")
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    seen, covered = Counter(windows), set()
    for i, x in enumerate(windows):
        covered |= set(range(i, i + 5)) if seen[x] > 1 else set()
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(docs, rows):
    got = quality_rules.apply_policy(quality_rules.ledger(docs))
    wanted = [(r[0], *(m := measures(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in rows]
    expect(got, ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"], wanted)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert kept[27] and kept[39] and not kept[23 * 3] and not kept[24 * 3]
    assert sorted(r.doc_id for r in quality_rules.good_documents(docs).collect()) == sorted(r[0] for r in rows if kept[r[0]])


def test_ledger_ablation(docs):
    rows = quality_rules.ledger(docs).cache()
    failed = [r.failed for r in rows.collect()]
    got = {r.rule: (r.n_failed, r.n_only) for r in quality_rules.ablation(rows).collect()}
    for i, rule in enumerate(quality_rules.RULES):
        assert got[rule.name] == (sum(f >> i & 1 for f in failed), sum(f == 1 << i for f in failed))


# 5


def test_secret_scan(docs, rows):
    assign = re.compile(secret_scan.ASSIGN.replace("(?i)", ""), re.I | re.A)
    got = {r.doc_id: r for r in secret_scan.secret_scan(docs).collect()}
    for doc, text, *_ in rows:
        text = text or ""
        spans = [(m.start(), 0, "assign", m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(spans))
        assert got[doc].base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [x for x in got[doc].spans.split(",") if x and "entropy" not in x] == [x for x in joined.split(",") if x]
    assert got[26 * 3].n_entropy == 1


def test_entropy_by_increments(spark):
    hits = ["9f8Kq2Lw7Zp0Xc4Vb6Nm1", "aaaaaaaaaaaaaaaaaaaaaaa1b2c3", "550e8400-e29b-41d4-a716-446655440000", "111111111111111111111", "abcdefghijABCDEFGHIJ0123456789ghijklmnop"]
    got = {r.text: r.spans for r in secret_scan.secret_scan(spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "doc_id long, text string")).join(
        spark.createDataFrame([(i, h) for i, h in enumerate(hits)], "doc_id long, text string"), "doc_id").collect()}
    for hit in hits:
        cls = next(c for c in secret_scan.CLASSES if re.match(c.pattern, hit))
        allowed = any(re.search(p, hit) for p in secret_scan.ALLOWED)
        best = []
        for i in range(len(hit) - secret_scan.WINDOW + 1):
            n = Counter(hit[i : i + secret_scan.WINDOW])
            h = -sum(c / secret_scan.WINDOW * np.log2(c / secret_scan.WINDOW) for c in n.values())
            best += [i] if h >= cls.least_bits - 1e-9 else []
        found = ",".join(x for x in got[hit].split(",") if x.startswith("entropy"))  # the second is a base match too
        assert found == ("" if allowed or not best else f"entropy:{best[0]}:{best[-1] + secret_scan.WINDOW}"), hit


def test_entropy_decides(spark):
    key = "qZ7xKfWmRtYbNcVdPgHs"  # one digit
    found = {
        key: "entropy:0:20", "qZbxKfWmRtYbNcVdPgHs": "entropy:0:20", key + "example" + key: "entropy:0:47",
        key + "_" + "0123456789abcdef01234567" + "_" + key: "entropy:0:21,hex:21:45,entropy:45:66",
        key + "_password=abcdefgh": "entropy:0:21,assign:21:38",
        "some/long/path/to_a_file/of2/words": "", "550e8400-e29b-41d4-a716-446655440000": "", "2026-11-27/12345678-00000": "",
    }
    rows = [(i, h) for i, h in enumerate(found)]
    got = {r.doc_id: r.spans for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {h: got[i] for i, h in rows} == found


def test_entropy_of_random_keys(spark):
    import string

    rng, every = np.random.default_rng(6), {"hex": "0123456789abcdef", "alnum": string.ascii_letters + string.digits, "base64": string.ascii_letters + string.digits + "+/"}
    rows = [(f"{name}{n}", "key is " + "".join(rng.choice(list(alphabet), n)) + " here") for name, alphabet in every.items() for n in (20, 32, 40) for _ in range(100)]
    found = Counter(r.doc_id for r in secret_scan.secret_scan(spark.createDataFrame(rows, "doc_id string, text string")).collect() if r.spans)
    for name in every:
        assert min(found[f"{name}{n}"] for n in (20, 32, 40)) >= 90, found
    words = [(i, " ".join(rng.choice(["some/path/of/words", "aWordWithManyLettersTogether", "2026-11-27", "internationalization"], 9))) for i in range(50)]
    clean = secret_scan.secret_scan(spark.createDataFrame(words, "doc_id long, text string")).where("spans <> ''").count()
    assert clean == 0


def test_many_spans_take_little_more_than_their_number(spark):
    import time

    hits = " x ".join(f"{i:024x}" for i in range(16_000))
    blobs = "-".join(f"{i:024x}" + "Zk" * 3 for i in range(4_000)) + " password=abcdef" * 2_000
    start = time.time()
    rows = spark.createDataFrame([(1, hits), (2, blobs)], "doc_id long, text string")
    got = {r.doc_id: r for r in secret_scan.secret_scan(rows).collect()}
    assert time.time() - start < 60
    assert (got[1].n_hex, got[2].n_hex, got[2].n_assign) == (16_000, 4_000, 2_000)
    joined = ",".join(f"hex:{27 * i}:{27 * i + 24}" for i in range(16_000))
    assert got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


# 6


def without_repeats(rows, window):
    first = {}
    split = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for doc, w in split:
        for i in range(len(w) - window + 1):
            x = tuple(w[i : i + window])
            if doc is not None:
                first[x] = min(first.get(x, doc), doc)
    for doc, w in split:
        lost = set()
        for i in range(len(w) - window + 1):
            if doc is not None and first[tuple(w[i : i + window])] < doc:
                lost |= set(range(i, i + window))
        yield doc, len(w), len(lost), " ".join(x for i, x in enumerate(w) if i not in lost)


@pytest.mark.parametrize("window", [50, 7, 2])
@pytest.mark.parametrize("wide", [400, 3])
def test_substring_dedup(spark, with_null_id, rows, window, wide, monkeypatch):
    monkeypatch.setattr(substring_dedup, "WIDE_ANCHOR", wide)
    got = substring_dedup.dedup_substrings(with_null_id, window)
    expect(got, ["doc_id", "n_words", "n_removed", "kept_text"], without_repeats([*rows, (None, rows[9][1])], window))


def test_fm_index_against_search():
    from corvane.llm.fm_index import FMIndex

    rng = np.random.default_rng(3)
    for depth in (1, 2, 3, 5, 8):
        passages = [rng.integers(1, 4, rng.integers(0, 40)) for _ in range(30)]
        passages += [np.full(30, 2), np.full(25, 2), np.array([], np.int64)]
        weights = rng.integers(0, 100, len(passages))
        found = FMIndex(passages, weights, depth).matches(passages)
        for p, got in zip(passages, found):
            for i in range(len(p) - depth + 1):
                x = p[i : i + depth].tolist()
                assert got[i] == min(w for o, w in zip(passages, weights) if any(o[j : j + depth].tolist() == x for j in range(len(o) - depth + 1)))


# 7


def fingerprint(text):
    import xxhash

    w = WORD.findall(ascii_lower(text or ""))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, radius):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in prints:
        for b in prints:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in prints}


@pytest.mark.parametrize("radius", [2, 1, 3])
def test_simhash(docs, rows, radius):
    prints = [(r[0], fingerprint(r[1])) for r in rows]
    group = groups({p for _, p in prints}, radius)
    least = defaultdict(list)
    for doc, p in prints:
        least[group[p]].append(doc)
    wanted = [(doc, f"{p:016x}", min(least[group[p]])) for doc, p in prints]
    expect(simhash_dedup.near_duplicates(docs, radius), ["doc_id", "fingerprint", "component_id"], wanted)
    kept = [r.doc_id for r in simhash_dedup.first_of_each_group(docs, radius).collect()]
    assert sorted(kept) == sorted({w[2] for w in wanted})


def test_components_of_a_long_chain(spark):
    from corvane.llm.components import connected_components

    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001), (5, 5), (None, 3)]
    got = dict(connected_components(spark.createDataFrame(edges, "a long, b long")).collect())
    assert got == {**dict.fromkeys(range(301), 0), 1000: 1000, 1001: 1000}


# 8


def water(sizes, weights=(1, 2, 3)):
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    left, active, target = sum(sizes.values()), set(order), {}
    while active:
        total = sum(weight[s] for s in active)
        over = [s for s in active if left * weight[s] / total > 3 * sizes[s]]
        for s in over or list(active):
            target[s] = 3 * sizes[s] if over else left * weight[s] / total
        left -= sum(target[s] for s in over)
        active -= set(over or active)
    return target


def test_mixing(spark, docs, rows):
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    target = water(sizes)
    out = mixing.mix(docs).join(docs.select("doc_id", "source").distinct(), "doc_id").collect()
    assert sorted((r.doc_id, r["size"], r.source_size) for r in out) == sorted((r[0], len(WORD.findall(r[1] or "")), sizes[r[3]]) for r in rows)
    taken = Counter()
    for r in out:
        assert abs(r.target - target[r.source]) < 1e-6 and 0 <= r.taken <= 3 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 for s in sizes)
    expect(mixing.mix(docs), ["doc_id", "taken"], [(r.doc_id, r.taken) for r in out])  # reruns agree
    once = docs.dropDuplicates(["doc_id"])
    words = Counter()
    for r in mixing.mixed_documents(once).collect():
        words[r.source] += len(WORD.findall(r.text or ""))
    budget = {r.source: r.t for r in mixing.mix(once).join(once.select("doc_id", "source"), "doc_id").groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert words == Counter(budget)


def test_mixing_of_empty_texts(spark):
    frame = spark.createDataFrame([(1, None, "a"), (2, "", None)], "doc_id long, text string, source string")
    expect(mixing.mix(frame), ["doc_id", "target", "taken"], [(1, 0.0, 0), (2, 0.0, 0)])
    assert mixing.mixed_documents(frame.withColumn("n_chars", F.lit(0))).isEmpty()


# 10


def clean_lines(rows, least_docs=3):
    key = lambda x: ascii_lower(x.strip(" \t\n\r\x0b\x0c"))
    holders = defaultdict(set)
    for r in rows:
        for x in (r[1] or "").split("\n"):
            if len(key(x)) >= 20 and r[0] is not None:
                holders[key(x)].add(r[0])
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if r[0] is None or len(holders.get(key(x), ())) < least_docs or max(holders[key(x)]) == r[0]]
        yield r[0], len(lines), len(lines) - len(kept), "\n".join(kept)


LINE_COLUMNS = ["doc_id", "n_lines", "n_dropped", "kept_text"]


def test_line_dedup(spark, with_null_id, rows):
    wanted = list(clean_lines([*rows, (None, rows[9][1])]))
    expect(line_dedup.dedup_lines(with_null_id, fresh_path(spark, "lines")), LINE_COLUMNS, wanted)
    texts = [(d, t) for d, _, _, t in wanted]
    cleaned = line_dedup.clean_documents(with_null_id, fresh_path(spark, "lines"))
    assert cleaned.columns == with_null_id.columns
    assert sorted(((r.doc_id, r.text or "") for r in cleaned.collect()), key=str) == sorted(texts, key=str)


def test_line_index_changes_and_undo(spark, docs, rows):
    index = line_dedup.LineIndex(spark, fresh_path(spark, "lines"), shards=4)
    a, b = docs.where("doc_id < 57"), docs.where("doc_id >= 48")  # they share documents
    index.insert(a)
    index.insert(b)
    expect(index.clean(docs), LINE_COLUMNS, clean_lines(rows))
    index.delete(spark.createDataFrame([(60,), (27,)], "doc_id long"))
    left = [r for r in rows if r[0] not in (60, 27)]
    expect(index.clean(docs.where("doc_id not in (60, 27)")), LINE_COLUMNS, clean_lines(left))
    again = line_dedup.LineIndex(spark, index.path)  # opened by someone else, who needs to know nothing but the folder
    assert (again.version, again.shards) == (index.version, 4) == (3, 4)
    expect(again.clean(docs.where("doc_id not in (60, 27)")), LINE_COLUMNS, clean_lines(left))
    again.undo()
    expect(again.clean(docs), LINE_COLUMNS, clean_lines(rows))
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):  # a change to a state that is not the last one any more
        index.delete(docs.select("doc_id"))
    again.delete(docs.select("doc_id"))
    assert again.present().isEmpty()
    again.insert(docs)
    expect(again.clean(docs), LINE_COLUMNS, clean_lines(rows))
    for _ in range(4):  # both later changes, then the two insertions
        again.undo()
    assert again.present().isEmpty()
    with pytest.raises(ValueError, match="nothing to undo"):
        line_dedup.LineIndex(spark, index.path).undo()


def test_line_index_goes_on_after_a_broken_commit(spark, docs, rows):
    index = line_dedup.LineIndex(spark, fresh_path(spark, "lines"), shards=4)
    index.insert(docs.where("doc_id < 57"))
    jvm, manifest = spark._jvm, f"{index.path}/manifest"
    left = jvm.org.apache.hadoop.fs.Path(f"{manifest}/2/_temporary")
    left.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(left)
    again = line_dedup.LineIndex(spark, index.path)
    assert again.version == 1
    again.insert(docs.where("doc_id >= 57"))
    assert again.version == 3 and line_dedup.LineIndex(spark, index.path).version == 3
    expect(again.clean(docs), LINE_COLUMNS, clean_lines(rows))
    again.undo()
    with pytest.raises(RuntimeError):  # this one still looks at entry 1
        index.insert(docs)
    # an entry made of the same one as another, which a race could leave
    entry = spark.createDataFrame([(3, 4, 20, [], None, 3)], line_dedup.ENTRY)
    entry.coalesce(1).write.parquet(f"{manifest}/9")
    with pytest.raises(RuntimeError, match="at once"):
        line_dedup.LineIndex(spark, index.path)


def test_filters_tell_what_is_known(spark, docs):
    from corvane.llm.cuckoo import CuckooFilter

    index = line_dedup.LineIndex(spark, fresh_path(spark, "lines"), shards=3)
    held = lambda: {r.shard: CuckooFilter.from_bytes(bytes(r.filter)) for r in index.filters().collect()}
    keys = index.present().select("key", index._shard().alias("shard"))
    index.insert(docs)
    keys = index.present().select("key", index._shard().alias("shard")).distinct().collect()
    filters = held()
    assert keys and all(filters[r.shard].has(line_dedup._hashes([r.key])).all() for r in keys)
    index.delete(docs.select("doc_id"))
    filters = held()
    assert not any(filters[r.shard].has(line_dedup._hashes([r.key])).any() for r in keys)


@pytest.mark.parametrize("batches", [1, 3])
def test_line_dedup_in_batches(spark, with_null_id, rows, batches):
    got = line_dedup.dedup_lines(with_null_id, fresh_path(spark, "lines"), batches=batches)
    expect(got, LINE_COLUMNS, clean_lines([*rows, (None, rows[9][1])]))


def test_join_with_frequent_keys(spark, monkeypatch):
    from corvane.llm import skew

    rows = spark.createDataFrame([(i % 5 if i % 2 else 7, i) for i in range(200)] + [(None, -1), (99, -2)], "k long, v long")
    counts = rows.groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("most"))
    wanted = by(rows.join(counts, "k"), "k", "v", "n", "most")
    for share in (1, 4, 1000):
        monkeypatch.setattr(skew, "HOT_SHARE", share)
        assert by(skew.join_counted(rows, counts, "k", "n", 202), "k", "v", "n", "most") == wanted


def test_cuckoo_filter():
    from corvane.llm.cuckoo import CuckooFilter

    keys = np.unique(np.random.default_rng(4).integers(0, 1 << 63, 5000, np.uint64))
    known = CuckooFilter()
    for part in np.array_split(keys, 7):
        known.add(part)
    known = CuckooFilter.from_bytes(known.to_bytes())
    assert known.has(keys).all() and len(known.stages) > 1
    assert known.has(np.random.default_rng(5).integers(0, 1 << 63, 5000, np.uint64)).sum() < 50
    known.drop(keys[::2])
    assert known.has(keys[1::2]).all() and known.has(keys[::2]).sum() < 50
    # keys that share fingerprints and buckets: each holds a slot of its own, as far as there are any
    alike = np.arange(6, dtype=np.uint64) * np.uint64(1 << 40)
    known = CuckooFilter()
    known.reserve(64)
    known.add(alike)
    known.drop(alike[:3])
    assert known.has(alike[3:]).all()
    known.drop(alike[3:])
    assert not known.has(alike).any()


def test_repeated_rows_stay_within_the_budget(spark):
    # a source of nothing but equal rows, which its budget takes more than once, and one that is cut
    rows = [(1, "a b c", "x", "en", 5)] * 7 + [(2, "d e f g h", "x", "en", 9), (3, "w " * 40, "y", "en", 80)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long").selectExpr("*", "1 AS row_key", "2 AS taken", "3 AS nth")
    wanted = {r.doc_id: r.n for r in mixing.mix(frame).groupBy("doc_id").agg(F.sum("taken").alias("n")).collect()}
    got = Counter()
    for r in mixing.mixed_documents(frame).collect():
        assert (r.row_key, r.taken, r.nth) == (1, 2, 3)
        got[r.doc_id] += len(WORD.findall(r.text))
    assert got == wanted


def test_first_of_each_group_with_clashing_names(spark, rows):
    frame = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    clash = frame.selectExpr("*", "1 AS id", "2 AS nth", "'s' AS stays", "3 AS n_rows", "4 AS row", "5 AS __nth", "6 AS stay_id")
    plain, got = simhash_dedup.first_of_each_group(frame, 2), simhash_dedup.first_of_each_group(clash, 2)
    assert got.columns == clash.columns
    assert by(got, "doc_id", "text") == by(plain, "doc_id", "text")
    assert {tuple(r)[2:] for r in got.collect()} == {(1, 2, "s", 3, 4, 5, 6)}


# all


def test_empty_tables(spark, empty):
    assert token_counts.token_counts(empty, vocabulary("word_bpe_49k.json"), fresh_path(spark, "c")).isEmpty()
    assert quality_rules.apply_policy(quality_rules.ledger(empty)).isEmpty()
    assert secret_scan.secret_scan(empty).isEmpty()
    assert substring_dedup.dedup_substrings(empty).isEmpty()
    assert simhash_dedup.near_duplicates(empty).isEmpty()
    assert simhash_dedup.first_of_each_group(empty).isEmpty()
    assert mixing.mix(empty).isEmpty()
    assert line_dedup.dedup_lines(empty, fresh_path(spark, "l")).isEmpty()


def test_null_ids(spark, with_null_id):
    n = with_null_id.count()
    assert token_counts.token_counts(with_null_id, vocabulary("word_bpe_49k.json"), fresh_path(spark, "c")).count() == n
    assert quality_rules.ledger(with_null_id).count() == n
    assert secret_scan.secret_scan(with_null_id).count() == n
    assert simhash_dedup.near_duplicates(with_null_id).count() == n
    assert mixing.mix(with_null_id).count() == n
    assert packing.pack(with_null_id, vocabulary("byte_bpe_50k.json")).where("piece = 0").count() == n
