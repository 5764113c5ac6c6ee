"""Operator 13 against a trie of tuples."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from corvane.llm import prefix_trie as module
from corvane.llm.prefix_trie import numbered_turns, prefix_trie, with_shared_heads

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string, size string"


def digest(role, text):
    return hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).digest()


def brute(rows, group=100, most=6):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, digest(role or "", text or ""), role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % most
        paths[c] = tuple(own.get(c - c % group, [])[:h]) + tuple(ts[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    out = []
    for node, cs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(m[:-1] == n for m in members if m)]
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        ends = ",".join(str(c) for c in sorted(cs) if paths[c] == node)
        out.append((min(cs), len(node), min(members[node[:-1]]) if node else None, len(cs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA).repartition(3)
    trie = prefix_trie(*with_shared_heads(numbered_turns(frame)))
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted((tuple(r) for r in trie.select(*names).collect()), key=str)


@pytest.mark.parametrize("bits,hot", [(12, 1000), (1, 5)])
def test_trie(spark, monkeypatch, bits, hot):
    from corvane.llm import skew

    monkeypatch.setattr(module, "RANGE_BITS", bits)
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    rng = random.Random(bits)
    rows = []
    for c in [*range(95, 230), *range(305, 315), 400, 7]:  # groups with and without their first conversation
        copy = c % 100 if rng.random() < 0.3 else 0
        for t in range(rng.choice([0, 1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant", None]), f"é{t}" if copy else rng.choice(["hello", "", None, "😀 x", f"own {c}"])))
    rows += [(400, 5, "user", "twice")] * 2 + [(401, None, "user", "no number"), (401, 0, "user", "first"), (401, None, None, None), (401, -3, "u", "minus")]
    rows += [(None, 1, "user", "no conversation"), (402, 1, "a", "b c"), (402, 1, "ab", " c"), (403, 4, "user", "x" * 50_000)]
    assert found(spark, rows) == brute(rows)


def test_nothing(spark):
    assert found(spark, []) == []
    assert found(spark, [(None, 1, "user", "text")]) == []
