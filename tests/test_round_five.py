"""Blocks of one order on both sides, and pairs that meet whatever order rows come in."""

import pytest
from pyspark.sql import functions as F

from corvane.operators import extract, resolve


def test_blocks_meet_themselves_in_one_order():
    """Rows of a block come to its two sides in different orders when they come from several executors; no pair is lost by that."""
    import numpy as np
    import pandas as pd
    import pyarrow as pa

    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6))
    rows = pd.DataFrame({"entity_type": "tool", "dim": 6, "block": 0, "entity": range(40), "v": list(v)})
    one, two = (resolve._packed(rows.sample(frac=1, random_state=seed)).iloc[0] for seed in (1, 2))
    side = {"block": [0], "other_block": [0], "ids": [one["ids"]], "vectors": [one["vectors"]], "other_ids": [two["ids"]], "other_vectors": [two["vectors"]]}
    found = pa.Table.from_batches(resolve._close(0.3, False)(iter([pa.RecordBatch.from_pydict(side)])))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    wanted = {(i, j) for i in range(40) for j in range(i + 1, 40) if (unit @ unit.T)[i, j] >= 0.3}
    got = [tuple(sorted(p)) for p in zip(found["entity"].to_pylist(), found["other"].to_pylist())]
    assert set(got) == wanted and len(got) == len(wanted)


def test_semantic_pairs_are_divided_by_both_roots(spark):
    """As the queries' SQL has it: 2 / (sqrt(5) * sqrt(5)) is just below 0.4, 2 / sqrt(5 * 5) is not."""
    rows = spark.createDataFrame([(1, "tool", [1.0, 2.0, 0.0]), (2, "tool", [2.0, 0.0, 1.0]), (3, "tool", [2.0, 0.0, 1.0])], "entity long, entity_type string, embedding array<double>")
    for others in (None, 100):
        assert {(r.a, r.b) for r in resolve.by_semantics(rows, 0.4, others).collect()} == {(2, 3)}


def test_semantic_query_has_no_cap(spark, tmp_path):
    """The query finds like vectors behind the first hundred of their type, as its SQL does."""
    import duckdb
    import numpy as np

    import __spark_entry__

    v = np.random.default_rng(6).normal(size=(260, 16))
    v[250] = 3 * v[150]
    rows = [(i, [float(x) for x in r], 3) for i, r in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.a, r.b): r.score for r in __spark_entry__.queries()["resolve_semantic"](spark, str(tmp_path)).collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    assert got == {(a, b): score for a, b, _, score in con.sql(__spark_entry__.oracle_sql()["resolve_semantic"]).fetchall()}
    assert got[150, 250] == 0.8


def test_large_blocks_are_compared_in_parts(spark, monkeypatch):
    import numpy as np

    v = np.random.default_rng(7).normal(size=(70, 5))
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cos = unit @ unit.T
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 16)
    monkeypatch.setattr(resolve, "EXACT_PAIRS", 9)
    places = lambda parts: sorted((int(i), int(j)) for x, y in parts for i, j in zip(x, y))
    assert places(resolve._near([unit, unit], 0.5, True)) == [(i, j) for i in range(70) for j in range(i + 1, 70) if cos[i, j] >= 0.5]
    assert places(resolve._near([unit[:30], unit[30:]], 0.5, False)) == [(i, j) for i in range(30) for j in range(40) if cos[i, j + 30] >= 0.5]
    monkeypatch.setattr(resolve, "MANY_BLOCKS", 2)
    rows = spark.createDataFrame([(i, "tool", [float(x) for x in r]) for i, r in enumerate(v)], "entity long, entity_type string, embedding array<double>")
    assert resolve._blocks(rows).count() == 2
    assert {(r.a, r.b) for r in resolve.by_semantics(rows, 0.5).collect()} == {(i, j) for i in range(70) for j in range(i + 1, 70) if cos[i, j] >= 0.5}


@pytest.mark.parametrize("few", [0, 1 << 21])
def test_pairs_are_met_by_stripes(spark, monkeypatch, few):
    """All pairs, each once, over many stripes and shares; what two columns write of them repeats itself every few rows."""
    import random

    monkeypatch.setattr(resolve, "FEW_PAIRS", few)
    monkeypatch.setattr(resolve, "STRIPE", 4)
    monkeypatch.setattr(resolve, "SHARE", 16)
    rng = random.Random(8)
    ids = [(f"e{i:03}", f"ns{rng.randrange(3)}_handle", f"v{rng.randrange(3) * rng.randrange(2)}") for i in range(150)]
    ids += [(f"e{i:03}", f"ns{i % 3}_handle", "v0") for i in range(0, 150, 7)] + [("e900", "ns1_handle", None), (None, "ns1_handle", "v0"), ("e901", "ns1_handle", "alone")]
    frame = spark.createDataFrame(ids, "entity string, namespace string, value string")
    wanted = {(a, b) for a, n, v in ids for b, m, w in ids if v == w and v and a and b and a < b and n != m}
    got = resolve.by_account_handle(frame).collect()
    assert len(got) == len(wanted) and {(r.a, r.b) for r in got} == wanted
    met = resolve.meet(frame.distinct(), ["value"], "entity", "namespace")
    held = {x for x in ids if None not in x}
    assert sorted((r.value, r.entity, r.namespace, r.entity_2, r.namespace_2) for r in met.collect()) == sorted((v, a, n, b, m) for a, n, v in held for b, m, w in held if v == w and a < b)


def test_written_pairs_take_little(spark, tmp_path):
    rows = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") * 7919 % 100_003).alias("entity"), F.concat("id", F.lit("")).alias("namespace"), F.lit("v").alias("value"))
    handles = rows.withColumn("namespace", F.concat(F.col("namespace").cast("int") % 25, F.lit("_handle")))
    resolve.by_account_handle(handles).write.parquet(f"{tmp_path}/pairs")
    n = 3000 * 2999 // 2 - 25 * (120 * 119 // 2)
    assert spark.read.parquet(f"{tmp_path}/pairs").count() == n
    assert sum(p.stat().st_size for p in tmp_path.rglob("*.parquet")) < n


def test_search_finds_what_patterns_find_anywhere(spark):
    """Runs around a mark hold every match: the same as trying each pattern at every character, offsets and excerpts too."""
    import random
    import re

    rng = random.Random(10)
    parts = ["a", "b-", "_", ".", "@", "://", "http", "HTTPS", "x.com", "mail.org", "al@x.net", "co.uk", " ", "\n", "\xa0", "見", "ſ", "🙂", "(", ")", "]", '"', "。", "/", "%", "1.2", "x.yz_"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(25))) for _ in range(3000)] + [None, "", "y" * 3000 + " a@b.co " + "z" * 3000 + " https://q.com/(a). "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r.doc_id, r.kind, r["at"], r.hit, r.excerpt) for r in extract.search(docs, extract.EMAIL, extract.URL, extract.DOMAIN).collect())
    wanted = []
    for n, text in enumerate(texts):
        found = {k: [(m.start(), m.group()) for m in re.compile(p, re.ASCII).finditer(text or "")] for k, p in (("email", extract.EMAIL), ("url", extract.URL), ("domain", extract.DOMAIN))}
        urls = [(at, extract.trim_url_tail(hit), hit) for at, hit in found["url"]]
        free = [(at, hit) for at, hit in found["domain"] if not any(a <= at < a + len(u) for a, u, _ in urls)]
        around = lambda at, hit: text[max(at - 240, 0) : at + len(hit) + 240].strip(" ")  # noqa: B023, E731
        wanted += [(n, k, at, hit, around(at, hit)) for k, hits in (("email", found["email"]), ("domain", free)) for at, hit in hits]
        wanted += [(n, "url", at, u, around(at, hit)) for at, u, hit in urls]
    assert got == sorted(wanted) and len(got) > 1000
    assert extract.trim_url_tail("http://x.com/a_(b).])\"") == "http://x.com/a_(b)" and extract.trim_url_tail("http://x.com/a. ") == "http://x.com/a "


def test_texts_are_searched_once_for_domains(spark, monkeypatch):
    searched, plain = [], extract.search
    monkeypatch.setattr(extract, "search", lambda docs, *patterns: searched.append(patterns) or plain(docs, *patterns))
    docs = spark.createDataFrame([(1, "see example.com, https://www.site.org/a.b.com). and a@mail.org, not read.me or x@nowhere.lan")], "doc_id long, text string")
    suffixes = spark.createDataFrame([("com",), ("org",)], "suffix string")
    found = extract.extract_all(docs, suffixes=suffixes).where("entity_type = 'domain'")
    assert sorted(r.entity_key for r in found.collect()) == ["example.com", "mail.org", "www.site.org"]
    assert searched == [(extract.EMAIL, extract.URL, extract.DOMAIN)]
