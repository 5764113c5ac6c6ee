"""Addresses, domains, attributes and chunks on golden cases."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import addresses, domains
from corvane.operators import chunk, extract


def one(spark, texts, f):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r[0] for r in rows.orderBy("doc_id").select(f(F.col("text"))).collect()]


def test_ipv6_is_parsed_and_written_as_the_standard_library_does(spark):
    rng = random.Random(2)
    texts = ["::", "::1", "1::", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "1:2:3:4:5:6:7:8", "1:2:3:4::5:6:7:8", "1::2::3", ":1:2:3:4:5:6:7", "12345::", "g::1", "", "1.2.3.4", "::ffff:1.2.3.4",
             "::1.2.3.4", "::ffff:256.1.1.1", "1:2:3:4:5:6:1.2.3.4", "FE80::ABCD", "0:0:1:0:0:0:1:0", "1:0:0:2:0:0:3:4", "::ffff:c000:201", ":::", "1:::2", None]
    texts += [":".join(format(rng.choice([0, 0, 1, 0xAB, 0xFFFF]), rng.choice(["x", "04x", "X"])) for _ in range(8)) for _ in range(60)]

    def wanted(t):
        try:
            return ipaddress.IPv6Address(t) if t and ":" in t else None
        except ValueError:
            return None

    number = lambda ip: None if ip is None else [(int(ip) >> s & (1 << 64) - 1) - (1 << 64) * (int(ip) >> s >> 63 & 1) for s in (64, 0)]
    found = one(spark, texts, addresses.address_number)
    assert [list(f) if f and ":" in t else None for f, t in zip(found, texts)] == [number(wanted(t)) for t in texts]
    text = lambda ip: None if ip is None else f"::ffff:{ip.ipv4_mapped}" if ip.ipv4_mapped else str(ip)
    assert one(spark, texts, addresses.canonical_ipv6) == [text(wanted(t)) for t in texts]


def test_ranges(spark):
    ranges = spark.createDataFrame([("10.0.0.0/8", "a"), ("10.1.2.3/16", "b"), ("::/0", "all"), ("2001:db8::/32", "doc"), ("2001:db8:0:0:8000::/65", "low"), ("nonsense", "x"), ("1.2.3.4/77", "x")], "cidr string, owner string")
    texts = ["10.2.3.4", "10.1.9.9", "11.1.1.1", "2001:db8:0:0:9::1", "2001:db8:0:0:8001::", "host", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, ip string").select("id", addresses.address_number(F.col("ip")).alias("number"))
    found = {r.id: r.owner for r in addresses.match_ranges(rows, "number", ranges).collect()}
    assert [found[i] for i in range(7)] == ["a", "b", "all", "doc", "low", None, None]


def test_suffixes(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// a comment\ncom\nuk\nco.uk\n*.wild\n!not.wild\n\n github.io\n")
    table = domains.suffix_table(spark, f"file://{tmp_path}/list.dat")
    assert {r.suffix for r in table.collect()} == {"com", "uk", "co.uk", "github.io"}
    hosts = ["www.news.example.co.uk", "example.com", "co.uk", "x.notaco.uk", "User.GitHub.io.", "nothing.lan", "a" * 300 + ".com", None, "com"]
    rows = spark.createDataFrame([(i, h) for i, h in enumerate(hosts)], "id long, host string")
    found = {r.id: (r.suffix, r.registrable) for r in domains.with_suffix(rows, "host", table).collect()}
    assert [found[i] for i in range(9)] == [("co.uk", "example.co.uk"), ("com", "example.com"), ("co.uk", None), ("uk", "notaco.uk"), ("github.io", "user.github.io"), (None, None), (None, None), (None, None), ("com", None)]


def test_all_extractors(spark):
    text = (
        "公告CVE-2026-0001影響 https://evil.example.com/a_(b)/x]). and (http://192.0.2.7/x). Mail: A.B@Corp.co.uk, x.com@lan.lan; seen at 2001:0DB8::0:1 and 10.0.0.8, 1.2.3.4.5; "
        "README.md, main.py, host-1.example.org. github.com/orgs/x github.com/Alice/repo t.me/joinchat/abc x.com/octo-cat 00000000-0000-0000-0000-000000000000 " + "ab" * 20
    )
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    found = {(r.entity_type, r.entity_key): r for r in extract.extract_all(docs, suffixes=domains.suffix_table(spark)).collect()}
    assert set(found) == {
        ("vulnerability", "CVE-2026-0001"), ("url", "https://evil.example.com/a_(b)/x"), ("url", "http://192.0.2.7/x"), ("domain", "evil.example.com"),
        ("email", "a.b@corp.co.uk"), ("domain", "corp.co.uk"), ("domain", "x.com"), ("ip", "2001:db8::1"), ("ip", "10.0.0.8"), ("ip", "192.0.2.7"), ("ip", "1.2.3.4"),
        ("domain", "host-1.example.org"), ("domain", "github.com"), ("account", "github:alice"), ("hash", "ab" * 20),
    }
    assert found["ip", "10.0.0.8"].attributes["is_private"] == "true" and found["ip", "2001:db8::1"].confidence == 0.95
    assert found["domain", "corp.co.uk"].attributes == {"public_suffix": "co.uk", "registrable_domain": "corp.co.uk", "is_registrable_domain": "true"}
    assert found["hash", "ab" * 20].attributes == {"algorithm": "sha1", "ambiguous_sha1": "true"}
    at = found["account", "github:alice"].at
    assert text[at:].startswith("github.com/Alice") and found["account", "github:alice"].excerpt == text[max(0, at - 240) : at + len("github.com/Alice") + 240].strip(" ")


def test_excerpts_and_offsets_in_a_long_text(spark):
    words = [f"wörd{i} 😀 a{i}@example.com" if i % 3 == 0 else f"wörd{i} 。" for i in range(9000)]
    text = " ".join(words)
    found = extract.extract_emails(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()
    assert len(found) == 3000
    for r in found:
        hit = text[r.at : r.at + len(r.entity_key)]
        assert hit == r.entity_key and r.excerpt == text[max(0, r.at - 240) : r.at + len(hit) + 240].strip(" ")


def test_scan(spark):
    rows = [(i, [(7 * j + i) % 13 - 3 for j in range(i)]) for i in (0, 1, 2, 3, 10, 99)]
    frame = spark.createDataFrame(rows, "i int, v array<int>")
    sums = frame.select("v", extract.scan(F.col("v"), F.lit(0), lambda a, b: a + b).alias("s"), extract.scan(F.col("v"), F.lit(-9), lambda a, b: F.greatest(a, b)).alias("m"))
    for r in sums.collect():
        assert r.s == [sum(r.v[:k]) for k in range(len(r.v))] and r.m == [max([-9, *r.v[:k]]) for k in range(len(r.v))]


def test_attributes_are_overlaid_by_key(spark):
    schema = "entity_type string, entity_key string, confidence double, attributes map<string,string>"
    stored = spark.createDataFrame([("ip", "a", 0.9, {"x": "1", "y": "2"}), ("ip", "b", 0.5, None)], schema)
    new = spark.createDataFrame([("ip", "a", 0.7, {"y": "3", "z": "4"}), ("ip", "c", 0.4, {"q": None})], schema)
    found = {r.entity_key: (r.confidence, r.attributes) for r in extract.upsert_entities(stored, new).collect()}
    assert found == {"a": (0.9, {"x": "1", "y": "3", "z": "4"}), "b": (0.5, {}), "c": (0.4, {"q": None})}
    assert found == {r.entity_key: (r.confidence, r.attributes) for r in extract.upsert_entities(extract.upsert_entities(stored, new), new).collect()}


def vocabulary():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("path", [None, vocabulary()])
def test_chunks_keep_the_models_limit(path):
    tokens = chunk.tokens_of(path)
    rng = random.Random(1)
    config = chunk.ChunkConfig(target=40, overlap=15, header=8, limit=70)
    prose = " ".join(rng.choice(["Straße", "the", "ganz", "😀😀", "标题。", "end.", "x" * 30, "d41d8cd98f00b204"]) for _ in range(900))
    for title, text in ((None, prose), ("A title " * 20, prose), ("Short", "Short\n" + prose), ("標題" * 60, "一" * 400), (None, "   \n\n "), ("t", ""), (None, "q" * 3000)):
        for strategy in ("fixed", "whole", "record"):
            found = chunk.document_chunks(title, text, strategy, config, tokens)
            for a, b, n, head in found:
                given = f"{head}\n{text[a:b]}" if head else text[a:b]
                assert tokens.counts([given])[0] == n and tokens.counts([config.prefix + given])[0] + config.specials <= config.limit
                assert tokens.counts([head])[0] <= config.header and (title or "").startswith(head)
            ends = 0
            for a, b, _, _ in found:
                assert a <= ends < b or not text[ends:a].strip()
                ends = max(ends, b)
            assert not text[ends:].strip()
    assert chunk.document_chunks("Short", "Short\nand little", "whole", config, tokens)[0][3] == ""
    assert chunk.document_chunks("Title", "other text", "record", config, tokens)[0][3] == "Title"


def test_hard_cuts_fall_where_tokens_begin():
    tokens = chunk.tokens_of(vocabulary())
    text = "unbelievably internationalisation " * 40
    starts = set(tokens.starts(text))
    pieces = chunk.hard_cut(text, 0, len(text), 20, tokens)
    assert "".join(text[a:b] for a, b, _ in pieces) == text and all(n <= 20 for _, _, n in pieces) and {a for a, _, _ in pieces} <= starts
    assert len(pieces) < 40
