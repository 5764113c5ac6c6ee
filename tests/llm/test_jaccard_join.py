"""Operator 12 against all pairs."""

import random
import re

import numpy as np
import pytest

from corvane.llm import jaccard_join
from corvane.llm.jaccard_join import most_apart, schemes, segment_sums, similar_sets, tokens_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=3):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=90):
    """rows: (doc_id, text)"""
    sets = [shingles(t) for _, t in rows]
    distinct = [frozenset(s) for s in dict.fromkeys(map(frozenset, sets)) if s]
    up = {s: s for s in distinct}

    def find(s):
        while up[s] != s:
            s = up[s]
        return s

    for i, a in enumerate(distinct):
        for b in distinct[:i]:
            if 100 * len(a & b) >= percent * len(a | b):
                up[find(a)] = find(b)
    least = {}
    for (i, _), s in zip(rows, sets):
        if s and i is not None:
            least[find(frozenset(s))] = min(least.get(find(frozenset(s)), i), i)
    return sorted(((i, len(s), least.get(find(frozenset(s))) if s else i) for (i, _), s in zip(rows, sets)), key=str)


def found(df, percent=90):
    return sorted((tuple(r) for r in similar_sets(df, percent).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def families(rng):
    """Texts with copies that differ in none to many words: hubs, chains, and families in which nothing links."""
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for size, copies, edits in ((150, 40, 8), (60, 25, 3), (400, 15, 20), (12, 20, 2), (25, 10, 1)):
        base = rng.choices(vocabulary, k=size)
        out.append(" ".join(base))
        for _ in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, edits)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words[: len(words) - rng.choice([0, 0, 0, 1, 5])]))
    chain = rng.choices(vocabulary, k=200)
    for i in range(30):
        chain = [*chain[3:], *rng.choices(vocabulary, k=3)]
        out.append(" ".join(chain))
    return out + [" ".join(rng.choices(vocabulary, k=rng.randint(1, 300))) for _ in range(40)]


@pytest.mark.parametrize("common,share,hot,limit", [(32, 500, 1000, 10**6), (2, 3, 10, 0), (4, 500, 1000, 10**6)])
def test_families(spark, monkeypatch, common, share, hot, limit):
    from corvane.llm import skew

    for name, value in (("COMMON", common), ("PIVOT_SHARE", share), ("BROADCAST_IDS", limit)):
        monkeypatch.setattr(jaccard_join, name, value)
    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    texts = families(random.Random(common))
    rows = [(7 * i % 1009, t) for i, t in enumerate(texts)]
    wanted = brute(rows)
    assert len({c for _, _, c in wanted}) < len(rows) - 50
    assert found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)) == wanted


def test_hostile_rows(spark, with_null_id, rows):
    assert found(with_null_id) == brute([(r[0], r[1]) for r in rows] + [(None, rows[9][1])])
    alone = [(None, "only a null id has this text"), (1, None), (None, None), (2, "A b"), (3, "a B"), (4, "a b c"), (5, "word"), (6, "Word")]
    assert found(spark.createDataFrame(alone, "doc_id long, text string")) == brute(alone)


def test_empty(spark, empty):
    assert similar_sets(empty).isEmpty()


@pytest.mark.parametrize("percent", [50, 80, 90, 100])
def test_similar_sets_have_a_segment_in_common(percent):
    """Of sets as different as they may be, both index some scheme in which a segment is the same and one of them is at home."""
    rng = np.random.default_rng(percent)
    for _ in range(200):
        t = int(rng.integers(1, 400))
        y = np.unique(rng.integers(0, 1 << 63, t, dtype=np.uint64))
        drop = int(rng.integers(0, most_apart(len(y), percent) + 1))
        x = np.concatenate([rng.permutation(y)[drop:], rng.integers(0, 1 << 63, int(rng.integers(0, 3)), dtype=np.uint64)])
        both = len(np.intersect1d(x, y))
        if not len(x) or 100 * both < percent * (len(x) + len(y) - both):
            continue
        index = [{(s, i): (int(v), guest) for s, guest, m, _ in schemes(len(z), percent) for i, v in enumerate(segment_sums(z, s, m)[2])} for z in (x, y)]
        assert any(index[1].get(k, (None, True))[0] == v and not (g and index[1][k][1]) for k, (v, g) in index[0].items())


def test_tokens():
    assert len(tokens_of("", 3)) == len(tokens_of(" \n", 3)) == 0
    assert len(tokens_of("a b", 3)) == len(tokens_of("a b c", 3)) == 1
    assert (tokens_of("A b C d", 3) == tokens_of("a\nB\tc  D", 3)).all()
    assert len(tokens_of("É b c", 3)) == 1 and tokens_of("É b c", 3) != tokens_of("é b c", 3)
