"""Golden cases of operators that the driver's tables don't exercise."""

import datetime
import hashlib

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as T
from corvane.functions.urls import canonical, canonical_url
from corvane.operators import chunk, dedup, extract, graph, ops, resolve, search, stix, timeline
from corvane.sources import imports, web
from corvane.streaming import jobs


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("raw", "wanted"),
    [
        ("HTTPS://Example.INVALID/Path/To/Article", "https://example.invalid/Path/To/Article"),
        ("https://e.invalid/?utm_source=news&id=42&fbclid=xyz&page=2", "https://e.invalid/?id=42&page=2"),
        ("https://e.invalid/?utmost=1", "https://e.invalid/?utmost=1"),
        ("https://e.invalid:443/", "https://e.invalid/"),
        ("http://e.invalid:8080", "http://e.invalid:8080/"),
        ("https://user:pw@e.invalid/%7Ea%2fb#part", "https://e.invalid/~a%2Fb"),
        ("https://e.invalid/a/", "https://e.invalid/a/"),
        ("https://e.invalid/?b=2&a=1&a=0", "https://e.invalid/?a=0&a=1&b=2"),
        ("not a url", None),
        ("http://[bad", None),
        (None, None),
    ],
)
def test_canonical_url(raw, wanted):
    assert canonical(raw) == wanted


def test_canonical_url_column(spark):
    frame = spark.createDataFrame([("HTTP://A.invalid",), (None,)], "u string")
    assert [r.c for r in frame.select(canonical_url("u").alias("c")).collect()] == ["http://a.invalid/", None]


def test_content_hash(spark):
    h = lambda *p: value(spark, T.content_hash(*[F.lit(x).cast("string") for x in p]))
    assert h("a b", None, "c") == h(" a \n b", "", "c　") == hashlib.sha256(b"a b||c").hexdigest()
    assert h("A", None, None) != h("a", None, None)
    assert h("a", "b", None) != h("a", None, "b")


def test_truncation(spark):
    assert value(spark, T.truncate_bytes(F.lit("aé😀"), 6)) == "aé"
    assert value(spark, T.truncate_bytes(F.lit("aé😀"), 7)) == "aé😀"
    assert value(spark, T.truncate_chars(F.lit("abcd"), 3)) == "abc…"


def test_uuid5(spark):
    import uuid

    for name in ("a", "é", ""):
        assert value(spark, T.uuid5(str(uuid.NAMESPACE_URL), F.lit(name))) == str(uuid.uuid5(uuid.NAMESPACE_URL, name))


def test_redaction(spark):
    assert value(spark, T.redact_credentials(F.lit('Bearer abc sk-12/3", x'))) == f'Bearer {T.MASK} abc sk-{T.MASK}", x'


def test_merge_json(spark):
    import json

    assert json.loads(value(spark, T.merge_json(F.lit('{"a":"1","b":"2"}'), F.lit('{"b":"3","c":"4"}')))) == {"a": "1", "b": "3", "c": "4"}


def test_cosine(spark):
    v = lambda *x: F.array(*[F.lit(float(i)) for i in x])
    assert value(spark, T.cosine(v(1, 0), v(1, 1))) == pytest.approx(0.5**0.5)
    assert value(spark, T.cosine(v(0, 0), v(1, 1))) == 0 and value(spark, T.cosine(v(1), v(1, 1))) == 0


TEXT = "修補的CVE-2026-31337與 XCVE-2026-0001 在10.0.0.300 8.8.8.8, a.b@example.com; see (https://Example.com/a?utm_id=1). " + "a" * 40 + " github.com/octo_cat/x github.com/octo-cat"


def test_extraction(spark):
    docs = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    found = {(r.entity_type, r.entity_key): r for r in extract.extract_all(docs).collect()}
    assert set(found) == {
        ("vulnerability", "CVE-2026-31337"), ("ip", "8.8.8.8"), ("email", "a.b@example.com"), ("domain", "example.com"), ("hash", "a" * 40),
        ("account", "github:octo_cat"), ("url", "https://example.com/a"),
    }
    assert found["vulnerability", "CVE-2026-31337"].at == 3 and found["hash", "a" * 40].confidence == 0.7


def test_staged_dedup(spark):
    text = " ".join(f"word{i}" for i in range(60))
    near = text.replace("word7 ", "other ").replace("word30 ", "words ")
    rows = [(1, text), (2, text + "  "), (3, near), (4, "short text"), (5, "short  text"), (6, None), (7, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    prints = dedup.simhash_fingerprints(docs)
    assert {r.doc_id for r in prints.collect()} == {1, 2, 3}
    hits = {r.doc_id: (r.parent, r.distance) for r in dedup.simhash_candidates(prints, 64 - 1).collect()}
    assert hits[2] == (1, 0)
    exact = dedup.parent_by_key(docs, T.content_hash(F.col("text")))
    staged = dedup.staged_parents(docs, [("content_hash", exact), ("simhash", dedup.simhash_candidates(prints, 3))])
    parents = {r.doc_id: (r.stage, r.parent) for r in staged.collect()}
    assert parents[2] == ("content_hash", 1) and parents[5] == ("content_hash", 4) and parents[7] == ("content_hash", 6)
    assert parents[1] == parents[4] == (None, None)


def test_scan_back_is_bounded(spark):
    prints = spark.createDataFrame([(i, 5) for i in range(0, 40, 2)], "doc_id long, print long")
    got = {r.doc_id: r.parent for r in dedup.simhash_candidates(prints, 3, scan_back=4).collect()}
    assert got == {i: max(0, i - 8) for i in range(2, 40, 2)}


def test_forest_roots(spark):
    chain = spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, 9)], "doc_id long, parent long")
    assert {r.root for r in dedup.forest_roots(chain).collect()} == {0}


def test_forest_roots_bound_is_exact(spark):
    chain = lambda n: spark.createDataFrame([(0, None)] + [(i, i - 1) for i in range(1, n + 1)], "doc_id long, parent long")
    assert dedup.forest_roots(chain(5), 5).where("root <> 0").isEmpty()
    for n, most in ((6, 5), (9, 8), (20, 8)):
        with pytest.raises(ValueError, match="longer"):
            dedup.forest_roots(chain(n), most)


def test_budget_passes_over_what_is_refused(spark):
    rows = [("c", i, n) for i, n in enumerate([6, 5, 4, 1, 0, None])] + [("d", 1, 11), ("d", 2, 10), (None, 1, 3), (None, 2, 8), (None, 3, 7)]
    got = ops.within_budget(spark.createDataFrame(rows, "k string, at int, amount long"), 10, ["k"], ["at"]).collect()
    found = {(r.k, r.at): (r.used, r.allowed) for r in got}
    assert [found["c", i] for i in range(6)] == [(6, True), (6, False), (10, True), (10, False), (10, True), (10, False)]
    assert [found["d", i] for i in (1, 2)] == [(0, False), (10, True)]
    assert [found[None, i] for i in (1, 2, 3)] == [(3, True), (3, False), (10, True)]


def test_jaccard_against_sets(spark):
    import random

    rng = random.Random(2)
    pairs = {(f"e{rng.randrange(30)}", f"m{rng.randrange(12)}") for _ in range(120)} | {(f"e{i}", "hub") for i in range(30)} | {("e1", "e2")}
    frame = spark.createDataFrame([(f"{a}{b}", a, b) for a, b in pairs], "edge_id string, src string, dst string")
    near = {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for least in (0.2, 0.5, 2 / 3, 1.0):
        wanted = {}
        for a in near:
            for c in near:
                if a < c and c not in near[a] and near[a] & near[c]:
                    j = len(near[a] & near[c]) / len(near[a] | near[c])
                    if j >= least:
                        wanted[a, c] = j
        assert {(r.a, r.c): r.jaccard for r in graph.neighbour_jaccard(frame, least).collect()} == wanted
        few = {(r.a, r.c) for r in graph.neighbour_jaccard(frame, least, most=2).collect()}
        assert few <= set(wanted)


def test_star_links_make_the_groups_of_pairs(spark):
    rows = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x"), (3, "y"), (4, "y"), (5, "z"), (5, "z")], "entity long, alias string")
    assert sorted((r.a, r.b) for r in resolve.star_links(rows, ["alias"], "alias").collect()) == [(1, 2), (1, 3), (3, 4)]


def test_scratch_folder_of_a_cluster_must_be_named():
    from types import SimpleNamespace

    from corvane.session import scratch_dir

    conf = {}
    cluster = SimpleNamespace(conf=SimpleNamespace(get=conf.get, set=conf.__setitem__), sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(cluster)
    cluster.sparkContext.master = "local[2]"
    assert scratch_dir(cluster) == conf["spark.checkpoint.dir"]


EDGES = [("ab", "A", "B", "mentions", 0.9, 0, 100, 1), ("bc", "B", "C", "associated_with", 0.4, 100, 200, 2), ("ac", "A", "C", "mentions", 0.5, 0, 10, 3), ("cd", "C", "D", "uses", 0.5, 0, 10, 1)]
EDGE = "edge_id string, src string, dst string, edge_type string, confidence double, first_seen int, last_seen int, evidence_count long"


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE)


def test_graph(spark, edges):
    starts = spark.createDataFrame([("A",)], "node string")
    names = lambda df: sorted(r.node for r in df.collect())
    assert names(graph.neighbours(edges, starts, 0)) == []
    assert names(graph.neighbours(edges, starts, 1)) == ["B", "C"]
    assert names(graph.neighbours(edges, starts, 2)) == ["B", "C", "D"]
    assert names(graph.neighbours(graph.edge_filter(edges, time_range=(50, 150)), starts, 2)) == ["B", "C"]
    assert names(graph.neighbours(graph.edge_filter(edges, least_confidence=0.8), starts, 5)) == ["B"]
    pairs = spark.createDataFrame([("A", "A"), ("A", "D"), ("D", "B"), ("A", "Z")], "start string, end string")
    paths = {(r.start, r.end): r.path for r in graph.shortest_paths(edges, pairs).collect()}
    assert paths == {("A", "A"): ["A"], ("A", "D"): ["A", "C", "D"], ("D", "B"): ["D", "C", "B"], ("A", "Z"): None}
    walks = {tuple(r.edges) for r in graph.bounded_walks(edges, starts, 3).collect()}
    assert ("ab", "bc", "ac") in walks and ("ab", "bc", "cd") in walks and all(len(set(w)) == len(w) for w in walks)
    assert graph.bounded_walks(edges, starts, 3, most=2).count() == 2
    with pytest.raises(ValueError, match="hops"):
        graph.distances(edges, starts, 11)
    with pytest.raises(ValueError, match="both ends"):
        graph.edge_filter(edges, time_range=(5, None))


def test_merge(spark, edges):
    merged = spark.createDataFrame([("C", "B")], "entity string, survivor string")
    got = {(r.src, r.edge_type, r.dst): (r.evidence_count, r.confidence, r.first_seen, r.last_seen) for r in resolve.merge_edges(edges, merged).collect()}
    assert got == {("A", "mentions", "B"): (4, 0.9, 0, 100), ("B", "uses", "D"): (1, 0.5, 0, 10)}


def test_gate(spark):
    rows = [("a", "b", 0.95, True), ("a", "b", 0.4, True), ("a", "c", 0.8, True), ("a", "d", 0.99, False), ("a", "e", 0.5, True)]
    got = {r.b: r.decision for r in resolve.gate(spark.createDataFrame(rows, "a string, b string, score double, same_type boolean")).collect()}
    assert got == {"b": "merge", "c": "review", "d": "pending", "e": "pending"}


def test_timeline_limits_first(spark):
    at = datetime.datetime(2026, 1, 1)
    docs = spark.createDataFrame([(1, at, at, False), (2, None, at, True), (3, None, at, False)], "doc_id long, published_at timestamp, observed_at timestamp, is_duplicate boolean")
    found = spark.createDataFrame([(10, 1, "e"), (11, 2, "e"), (12, 3, "e")], "extraction_id long, doc_id long, entity string")
    rows = timeline.entity_timeline(found, docs, "e", 2).collect()
    assert [(r.doc_id, r.time_source, r.truncated) for r in rows] == [(1, "published", True)]


@pytest.mark.parametrize(
    ("text", "code"),
    [("", "empty"), ("(", "missing_operand"), ("a (b", "open_bracket"), ("a)", "extra_bracket"), ('"a', "open_quote"), ('"" a', "empty_phrase"), ("a AND", "missing_operand"),
     ("OR a", "missing_operand"), ("x" * 1025, "too_long"), ("a " * 65, "too_many_tokens"), ("(" * 10 + "a" + ")" * 10, "too_deep")],
)
def test_query_errors(spark, text, code):
    with pytest.raises(search.QueryError) as e:
        search.query_condition(text, F.col("terms"))
    assert e.value.code == code


@pytest.mark.parametrize(
    ("text", "wanted"),
    [("red", {1, 2}), ("red fox", {1}), ("red OR blue", {1, 2, 3}), ("red AND NOT fox", {2}), ('"red fox"', {1}), ('"fox red"', set()), ("NOT red", {3, 4}),
     ("(blue OR fox) sky", {3}), ("and", set()), ("修補", {4}), ("補修", set())],
)
def test_keyword_queries(spark, text, wanted):
    docs = spark.createDataFrame([(1, "The red fox"), (2, "Red, red wine"), (3, "blue sky"), (4, "已修補完成")], "doc_id long, text string")
    rows = docs.select("doc_id", search.terms_of(F.col("text")).alias("terms"))
    assert {r.doc_id for r in rows.where(search.query_condition(text, F.col("terms"))).collect()} == wanted


def test_fusion(spark):
    lists = lambda *ids: spark.createDataFrame([(i, n + 1) for n, i in enumerate(ids)], "id string, rank int")
    got = [(r.id, round(r.score, 6)) for r in search.fuse_ranks(lists("a", "b", "a"), lists("c", "b"), 5).collect()]
    assert got == [("b", round(2 / 62, 6)), ("a", round(1 / 61, 6)), ("c", round(1 / 61, 6))]
    assert [search.pool_size(n) for n in (20, 100, 1)] == [60, 200, 3]
    assert search.decode_cursor(search.encode_cursor([1.5, "x"])) == [1.5, "x"]


def test_chunks(spark):
    text = "First one. Second (with a stop. inside) here! Third\nFourth。" + " word" * 700 + "."
    assert "".join(text[a:b] for a, b in chunk.sentences(text)) == text
    config = chunk.ChunkConfig(target=30, overlap=10, header=5, limit=60)
    spans = chunk.packed(text, config)
    assert spans[0][0] == 0 and spans[-1][1] == len(text)
    assert all(a2 <= b1 and b2 >= b1 and a2 > a1 for (a1, b1), (a2, b2) in zip(spans, spans[1:]))
    docs = spark.createDataFrame([(1, "A title", text, "imported"), (2, None, None, "article"), (3, "t", "short.", "article")], "doc_id long, title string, text string, object_type string")
    chunks = chunk.chunk_documents(docs, config)
    assert all(r.chunk == text[r.start : r.end] and r.token_count <= 60 for r in chunks.where("doc_id = 1").collect())
    assert chunk.broken_chunks(chunks).isEmpty() and chunks.where("doc_id = 2").isEmpty() and chunks.where("doc_id = 3").count() == 1
    assert [r.doc_id for r in chunk.changed_documents(chunks, chunks.where("doc_id <> 3")).collect()] == [3]
    with pytest.raises(ValueError, match="overlap"):
        chunk.ChunkConfig(target=100, overlap=100)


def test_imports(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"Headline": " T ", "link": "u", "published": "2026-01-02T03:04:05Z", "id": 7}, {"id": 8}]')
    (tmp_path / "b.json").write_text('{"title": "x", "date": "Fri, 02 Jan 2026 03:04:05 GMT"}\n{"title": "y", "date": "1767323045"}\n{"title": "z", "date": "soon"}')
    (tmp_path / "c.csv").write_text("title,description,link\n a ,b,\n,,u\n")
    at = datetime.datetime(2026, 1, 2, 3, 4, 5)
    assert [(r.title, r.external_id, r.published_at) for r in imports.read_json(spark, str(tmp_path / "a.json")).collect()] == [("T", "7", at)]
    got = {r.title: (r.published_at, r.published_raw) for r in imports.read_json(spark, str(tmp_path / "b.json")).collect()}
    assert got["x"][0] == at and got["y"][0] == at and got["z"] == (None, "soon")
    assert [(r.title, r.summary, r.url) for r in imports.read_csv(spark, str(tmp_path / "c.csv")).collect()] == [("a", "b", None)]
    assert value(spark, imports.json_depth(F.lit('{"a": [1, {"b": "]]}}"}]}'))) == 3


def test_feeds(spark):
    rss = '<rss xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><item><title>T</title><link>l</link><guid>g</guid><pubDate>d</pubDate><description>s</description><dc:creator>c</dc:creator></item></channel></rss>'
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><id>i</id><link href="l"/><updated>u</updated><summary>s</summary><author><name>n</name></author></entry></feed>'
    js = '{"items": [{"id": "i", "url": "u", "title": "t", "content_text": "c", "authors": [{"name": "n"}]}]}'
    rows = {r.source: tuple(r)[1:] for r in web.read_feeds(spark.createDataFrame([("rss", rss), ("atom", atom), ("json", js)], "source string, body string")).collect()}
    assert rows == {"rss": ("g", "l", "T", "s", "d", "c"), "atom": ("i", "l", "T", "s", "u", "n"), "json": ("i", "u", "t", "c", None, "n")}


def test_page_fields():
    html = "<html><head><title> A  b </title><meta name=description content=D><meta property='og:site_name' content=S><meta name=author content=W></head><body>x<script>no</script><p>y &amp; z</p></body></html>"
    assert web.page_fields(html) == ("A b", "D", "S", "W", "x y & z")


BUNDLE = """{"type": "bundle", "id": "bundle--1", "objects": [
 {"type": "identity", "id": "identity--00000000-0000-4000-8000-000000000001", "name": "Acme", "identity_class": "organization"},
 {"type": "threat-actor", "id": "threat-actor--00000000-0000-4000-8000-000000000002", "name": "Bad  Actor"},
 {"type": "campaign", "id": "campaign--00000000-0000-4000-8000-000000000003", "name": "skipped"},
 {"type": "relationship", "id": "relationship--00000000-0000-4000-8000-000000000004", "relationship_type": "targets",
  "source_ref": "threat-actor--00000000-0000-4000-8000-000000000002", "target_ref": "identity--00000000-0000-4000-8000-000000000001"}]}"""


def test_stix(spark, tmp_path):
    (tmp_path / "b.json").write_text(BUNDLE)
    objects = stix.read_bundle(spark, str(tmp_path / "b.json"))
    assert stix.invalid_objects(objects).isEmpty()
    found = stix.to_entities(objects)
    assert {(r.entity_type, r.name_key) for r in found.collect()} == {("organization", "acme"), ("threat_actor", "bad actor")}
    assert [r.relationship_type for r in stix.to_relationships(objects).collect()] == ["targets"]
    stored = spark.createDataFrame([("organization", "acme", "ACME", None, 0.9)], "entity_type string, name_key string, name string, description string, confidence double")
    got = {r.name_key: (r.name, r.confidence) for r in stix.import_entities(stored, found).collect()}
    assert got == {"acme": ("ACME", 0.9), "bad actor": ("Bad  Actor", 0.8)}
    assert not value(spark, stix.is_id(F.lit("identity--1")))


def test_health_order(spark):
    now = datetime.datetime(2026, 1, 10)
    old, fresh = now - datetime.timedelta(days=2), now - datetime.timedelta(minutes=5)
    rows = [
        (1, False, "running", 3, old, None), (2, True, "running", 3, old, None), (3, True, "running", 3, fresh, None), (4, True, "idle", 3, fresh, fresh),
        (5, True, "idle", 0, fresh, None), (6, True, "idle", 0, old, old), (7, True, "idle", 0, None, None),
    ]
    frame = spark.createDataFrame(rows, "id int, enabled boolean, status string, error_count int, last_run timestamp, last_success timestamp")
    got = {r.id: r.reason for r in frame.select("id", ops.connector_health(F.lit(now)).alias("reason")).collect()}
    assert got == {1: None, 2: "stuck", 3: None, 4: "errors", 5: "never_succeeded", 6: "stale", 7: None}


def test_p95(spark):
    assert spark.range(1, 21).agg(ops.p95(F.col("id")).alias("p")).first().p == 19


def test_stream_is_idempotent(spark, tmp_path):
    row = '{"id": "%s", "event_type": "raw.collected", "schema_version": 1, "payload": "{\\"n\\": %d}"}\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text(row % ("1", 1) + row % ("1", 1) + row % ("2", 2))
    for _ in range(2):  # the second run finds nothing new
        events = jobs.read_events(spark, str(tmp_path / "in"))
        jobs.run_batches(events, lambda b: b.select("id", "payload"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
    bad = spark.createDataFrame([("1", "{"), ("2", '{"n": 1}'), ("3", None)], "id string, payload string")
    assert {r.id for r in jobs.failed_events(bad.withColumn("payload", F.col("payload")), "n int").collect()} >= {"3"}


def test_pressure_falls_by_steps():
    assert jobs.next_level(0, 3, 0, 30) == (3, True)
    assert jobs.next_level(3, 0, 10, 30) == (3, False)
    assert jobs.next_level(3, 0, 31, 30) == (2, True)
    assert jobs.next_level(1, 1, 99, 30) == (1, False)


def test_semantic_pairs_are_not_capped(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(resolve, "BLOCK_ROWS", 64)
    v = np.random.default_rng(4).normal(size=(300, 8))
    v[290] = 2 * v[150]  # both far behind the first hundred
    data = [(i, "person" if i % 50 == 49 else "tool", [float(x) for x in r]) for i, r in enumerate(v)] + [(900, "tool", None), (901, "tool", [0.0] * 8), (902, "tool", [1.0])]
    rows = spark.createDataFrame(data, "entity long, entity_type string, embedding array<double>")
    got = {(r.a, r.b): r.score for r in resolve.by_semantics(rows, least=0.7).collect()}
    unit = v / np.linalg.norm(v, axis=1)[:, None]
    cos = unit @ unit.T
    wanted = {(i, j) for i in range(300) for j in range(i + 1, 300) if cos[i, j] >= 0.7 and i % 50 != 49 and j % 50 != 49}
    assert set(got) == wanted and got[150, 290] == 0.8
    assert (150, 290) not in {(r.a, r.b) for r in resolve.by_semantics(rows, 0.7, others=100).collect()}


def test_extraction_of_a_long_document(spark):
    text = " ".join(f"CVE-2026-{i:05}" for i in range(1300))
    items = extract.extract_all(spark.createDataFrame([(1, text)], "doc_id long, text string"))
    assert extract.entities(items).count() == extract.identifiers(items).count() == 1300
    assert items.count() == 1300 and extract.extract_all(spark.createDataFrame([(1, text)], "doc_id long, text string"), 500).count() == 500


def test_chunks_of_a_very_long_text(spark):
    text = "Some words of a line.\n" * 120_000  # over 2 MiB
    docs = spark.createDataFrame([(1, "", text, "message"), (2, "", "short", "message")], "doc_id long, title string, text string, object_type string")
    chunks = chunk.chunk_documents(docs)
    assert "truncated" not in chunks.columns and chunks.where("doc_id = 1").agg({"end": "max"}).first()[0] == len(text)
    cut = chunk.chunk_documents(docs, max_bytes=1000).groupBy("doc_id").agg(F.max("end").alias("end"), F.max("truncated").alias("truncated")).collect()
    assert {(r.doc_id, r.end, r.truncated) for r in cut} == {(1, 1000, True), (2, 5, False)}


def test_near_copies_far_apart(spark):
    import random

    rng = random.Random(6)
    prints = [rng.getrandbits(64) for _ in range(700)]
    for i in range(40):
        prints.append(prints[i] ^ sum(1 << b for b in rng.sample(range(64), i % 5)))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    rows = spark.createDataFrame(list(enumerate(signed)), "doc_id long, print long")
    wanted = set()
    for i, p in enumerate(prints):
        near = [((p ^ q).bit_count(), j) for j, q in enumerate(prints[:i]) if (p ^ q).bit_count() <= 3]
        wanted |= {(i, min(near)[1], min(near)[0])} if near else set()
    assert len(wanted) == 32 and {tuple(r) for r in dedup.simhash_candidates_unbounded(rows).select("doc_id", "parent", "distance").collect()} == wanted
    assert dedup.simhash_candidates(rows).isEmpty()


def test_no_cap_or_single_task_in_paging_and_turns(spark):
    import inspect

    from corvane.plans import search_queries

    assert "10_000_000" not in inspect.getsource(search_queries.search_after_page)
    docs = spark.createDataFrame([(i, "blend the " + "x " * (i % 7)) for i in range(50)], "doc_id long, text string")
    assert search.bm25_scores(docs, ["blend", "the"]).count() == 50
    due = [(i, i % 3, i // 4 if i % 5 else None) for i in range(200)]
    got = ops.fair_dispatch(spark.createDataFrame(due, "id long, error_count int, last_success int"), 8)
    assert "SinglePartition, ENSURE_REQUIREMENTS" not in got.select("id")._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    key = lambda r: (r[1], r[2] is None, -(r[2] or 0), r[0])
    kept = sorted(r for r in due if not r[1]) + sorted((r for r in due if r[1]), key=key)[:8]
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.turn)] == [r[0] for r in sorted(kept, key=key)]
    assert [r.turn for r in sorted(got.collect(), key=lambda r: r.turn)] == list(range(1, len(kept) + 1))


def test_graph_changes_and_deletes(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 2), ("c", "a", 3), (None, "a", 4)], "src string, dst string, v int")
    got = lambda df: sorted((r["src"] or "", r["dst"], r["v"]) for r in df.collect())
    assert got(graph.without_nodes(edges, spark.createDataFrame([("b",)], "node string"))) == [("", "a", 4), ("c", "a", 3)]
    assert got(graph.without_nodes(edges, spark.createDataFrame([], "node string"))) == got(edges)
    changed = spark.createDataFrame([("a", "b"), ("b", "c"), ("a", "b"), ("x", "y")], "src string, dst string")
    canonical = spark.createDataFrame([("a", "b", 9), ("x", "y", 8), ("z", "z", 7)], "src string, dst string, v int")
    assert got(graph.apply_changes(edges, changed, canonical, ["src", "dst"])) == [("", "a", 4), ("a", "b", 9), ("c", "a", 3), ("x", "y", 8)]


def test_boosted_fields(spark):
    docs = spark.createDataFrame([(1, "Fox", "a dog"), (2, "Dog", "the fox"), (3, None, None), (4, "", "")], "doc_id int, title string, body string")
    score = {r["doc_id"]: r["score"] for r in search.boosted(docs, ["fox"], {"title": 3, "body": 1}).collect()}
    alone = {r["doc_id"]: r["score"] for f in ("title", "body") for r in search.bm25_scores(docs, ["fox"], f).collect()}
    assert score == {1: 3 * alone[1], 2: alone[2]} and score[1] > score[2]
    assert search.boosted(docs.limit(0), ["fox"], {"title": 3, "body": 1}).count() == 0


def test_documents_must_say_whether_they_are_duplicates(spark):
    docs = spark.createDataFrame([(1, True), (2, False)], "doc_id int, is_duplicate boolean")
    assert [r["doc_id"] for r in extract.to_extract(docs).collect()] == [2]
    with pytest.raises(Exception, match="is_duplicate is missing: 3"):
        extract.to_extract(docs.union(spark.createDataFrame([(3, None)], docs.schema))).collect()


@pytest.mark.parametrize("least", [0.2, 0.5, 1.0])
def test_jaccard_of_nodes_that_many_share_tells_them_apart(spark, least, monkeypatch):
    """What is moved stays near the links, where each of few elements is shared by many nodes and pairs of those would be many; in blocks too."""
    import random
    from itertools import combinations

    rng = random.Random(3)
    sets = {f"e{i}": frozenset(rng.sample(range(40), rng.choice((1, 2, 3, 4, 7, 8, 9)))) for i in range(700)}
    sets |= {f"copy{i}": sets[f"e{i}"] for i in range(40)} | {"big": frozenset(range(1000, 1090)), "big2": frozenset(range(1002, 1090)), "mid": frozenset(range(1000, 1060))}
    frame = spark.createDataFrame([(f"{a}:{b}", a, f"n{b}") for a, s in sets.items() for b in s], "edge_id string, src string, dst string")
    ends = {}
    for a, s in sets.items():
        for b in s:
            ends.setdefault(f"n{b}", set()).add(a)
    near = {a: {f"n{b}" for b in s} for a, s in sets.items()} | ends
    wanted = {(a, c): j for a, c in combinations(sorted(near), 2) if (j := len(near[a] & near[c]) / len(near[a] | near[c])) >= least and j > 0 and c not in near[a]}
    for block in (1 << 15, 50):
        monkeypatch.setattr(graph, "BLOCK", block)
        got = graph.neighbour_jaccard(frame, least).collect()
        assert len(got) == len(wanted) and {(r.a, r.c): r.jaccard for r in got} == wanted


def test_pieces_of_jaccard_runs_cover_all():
    import numpy as np

    for costs in ([], [0, 0], [5, 1, 9, 0, 3], [100]):
        cut = graph._pieces(np.array(costs, np.int64), 4)
        assert [i for a, b in cut for i in range(a, b)] == list(range(len(costs)))


@pytest.mark.parametrize("candidates", [dedup.simhash_candidates, dedup.simhash_candidates_unbounded])
def test_exploded_fingerprints_are_not_broadcast(spark, candidates):
    """Twenty (or four) rows a fingerprint look to Spark as small as the fingerprints, and the driver would hold them all."""
    prints = spark.createDataFrame([(i, i * 0x9E3779B97F4A7C15 % (1 << 64) - (1 << 63)) for i in range(300)], "doc_id long, print long")
    found = candidates(prints)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString()
    keys = "choice" if candidates is dedup.simhash_candidates_unbounded else "band"
    assert [x for x in plan.split("\n") if "BroadcastHashJoin" in x and keys in x] == [] and "SortMergeJoin [" in plan
