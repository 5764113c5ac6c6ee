"""References that were cut off, cosines as SQL has them, and pairs that no grouping follows."""

import math
from functools import reduce

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.operators import chunk, embed, extract, resolve
from corvane.sources import web


def test_references_that_nothing_ends_stay(spark):
    html = "<title>a &amp; b &amp&#x27;&quot; &nosuch &#39</title><body>x"
    rows = spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string")
    assert web.read_pages(rows, ended=True).first().title == "a & b &amp'\" &nosuch &#39"
    assert web.read_pages(rows).first().title == "a & b &'\" &nosuch '"


def test_cosine_is_one_root_and_at_most_one(spark):
    """Vectors of one direction are equally alike, so the first of them is the parent."""
    base = [0.1 * (k * 7 % 11) + 0.3 for k in range(64)]
    vectors = [(k, 0, [x * f for x in base]) for k, f in enumerate((1.0, 3.0, 0.7, 1.1, 2.3, 0.9))]
    frame = spark.createDataFrame(vectors, "doc_id long, model int, embedding array<double>")
    cos = frame.alias("x").crossJoin(frame.alias("y")).select(T.cosine(F.col("x.embedding"), F.col("y.embedding")).alias("c")).collect()
    assert max(r.c for r in cos) == 1.0
    got = {r.doc_id: (r.parent, r.similarity) for r in embed.semantic_parents(frame, 0.9).collect()}

    def cosine(a, b):
        dot = lambda x, y: reduce(lambda s, pq: s + pq[0] * pq[1], zip(x, y), 0.0)  # noqa: E731  # sum() of Python compensates
        return min(dot(a, b) / math.sqrt(dot(a, a) * dot(b, b)), 1.0)

    for n, (k, _, v) in enumerate(vectors[1:], 1):
        best = max(((cosine(w, v), -i) for i, _, w in vectors[:n]))
        assert got[k][0] == -best[1] and abs(got[k][1] - best[0]) < 1e-15


@pytest.mark.parametrize("several", [False, True])
def test_pairs_come_once_and_only_those_of_several_rows_are_grouped(spark, several):
    rows = [(f"e{i:02}", f"k{i % 4}") for i in range(24)] + [(f"e{i:02}", f"k{j}") for i in range(0, 24, 5) for j in (1, 2)] * several
    frame = spark.createDataFrame(rows, "entity string, alias string")
    wanted = {(a, b) for a, x in rows for b, y in rows if x == y and a < b}
    got = resolve.by_alias(frame).collect()
    assert len(got) == len(wanted) and {(r.a, r.b) for r in got} == wanted


def test_gate_judges_single_pairs_as_they_come(spark):
    rows = spark.createDataFrame([(1, 2, 0.96, True), (1, 3, 0.8, True), (2, 3, 0.5, True), (2, 4, 0.99, False)], "a int, b int, score double, same_type boolean")
    once = resolve.gate(rows, once=True)
    assert once.collect() and set(map(tuple, once.collect())) == set(map(tuple, resolve.gate(rows).collect()))
    assert "Exchange" not in once._jdf.queryExecution().toString()


def test_tokens_of_pieces_add_up(monkeypatch):
    import random

    import public_tokenizers

    tokens = chunk.VocabularyTokens(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(4)
    parts = ["word", "don't", "it's", " ", "  ", "\n", "\n\n ", "\t", "\r\n", "12345", "é", "見る", "🙂", "<|endoftext|>", "\xa0", "　", "\x0b", "…", "a.b", "###", "'s", "​", "\x85", "_"]
    texts = ["", " ", "\n \n"] + ["".join(rng.choices(parts, k=rng.randrange(1, 14))) for _ in range(3000)]
    wanted = tokens._encoded(texts)
    assert tokens.counts(texts) == wanted and tokens.counts(texts) == wanted
    assert [tokens.counts([t])[0] for t in texts] == wanted
    met = []
    monkeypatch.setattr(tokens, "_encoded", lambda ts: met.extend(ts) or [1] * len(ts))
    tokens.counts(["word word word"] * 5)  # known by now
    assert met == []


def test_chunks_leave_a_worker_before_there_are_many(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(chunk, "HELD", 5000)
    texts = ["A sentence of some words. " * 200] * 20 + [None, ""]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(22)), "title": [""] * 22, "text": texts, "strategy": ["fixed"] * 22})
    out = list(chunk._chunks(chunk.ChunkConfig(), None, None)(iter([batch])))
    assert len(out) > 10 and max(sum(map(len, b.column("chunk").to_pylist())) for b in out) < 8000
    assert set(pa.Table.from_batches(out).column("doc_id").to_pylist()) == set(range(20))


def test_chunks_cover_white_space_at_their_bounds():
    tokens, config = chunk.PlainTokens(), chunk.ChunkConfig(target=10, overlap=2, header=0, limit=30, prefix="")
    full = "one two three four five six seven eight nine ten"
    for text in (f"{full}\n\n", f"\n\n{full}\n{full}\n \n", f"{full}\n" * 3 + "\t\n", full * 9 + "\n"):
        for strategy in ("fixed", "whole"):
            found, reached = chunk.document_chunks(None, text, strategy, config, tokens), 0
            assert all(text[a:b].strip() and n + config.specials <= config.limit for a, b, n, _ in found)
            for a, b, _, _ in found:
                assert a <= reached <= b
                reached = b
            assert reached == len(text)
    assert chunk.document_chunks(None, " \n\t ", "fixed", config, tokens) == []


def test_first_of_a_type_are_compared_in_blocks(spark, monkeypatch):
    """Cosines of vectors with each of the first ones come from packed blocks, as the column expression has them; what is like nothing takes no part."""
    import random

    rng = random.Random(6)
    rows = [(k, f"kind{k % 2}", [rng.uniform(-1, 1) for _ in range(6)]) for k in range(90)]
    rows += [(100, "kind0", None), (101, "kind0", [0.0] * 6), (102, "kind1", [1.0, None] * 3), (103, "kind1", [1.0]), (-1, "kind0", None)]
    frame = spark.createDataFrame(rows, "entity long, entity_type string, embedding array<double>")
    monkeypatch.setattr(resolve, "BLOCK_ROWS", 16)
    got = resolve.by_semantics(frame, 0.3, others=4)
    usable = [r for r in rows if r[2] and None not in r[2] and any(r[2])]
    first = {t: sorted(k for k, kind, _ in rows if kind == t)[:5] for t in ("kind0", "kind1")}
    wanted = {}
    for k, t, v in usable:
        for o, kind, w in usable:
            if kind == t and o in first[t] and o != k and len(v) == len(w):
                c = sum(p * q for p, q in zip(v, w)) / math.sqrt(sum(p * p for p in v) * sum(q * q for q in w))
                if c >= 0.3:
                    wanted[min(k, o), max(k, o)] = round(0.8 * c, 6)
    assert {(r.a, r.b): r.score for r in got.collect()} == wanted and got.count() == len(wanted)
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_domains_are_searched_for_once(spark):
    docs = spark.createDataFrame([(1, "see example.com and a@mail.org, not read.me")], "doc_id long, text string")
    suffixes = spark.createDataFrame([("com",), ("org",)], "suffix string")
    found = extract.extract_domains(docs, extract.extract_emails(docs), suffixes)
    assert sorted(r.entity_key for r in found.collect()) == ["example.com", "mail.org"]
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
