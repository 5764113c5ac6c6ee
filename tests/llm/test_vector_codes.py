"""Operator 11 against plain k-means in Python integers."""

import numpy as np
import pytest

from corvane.llm.vector_codes import codebooks_digest, nearest, scaled_vectors, vector_codes

COLUMNS = "vec_id long, embedding array<float>, label int, v string, code string, error string"


def brute(rows, parts, entries, rounds, scale=4096):
    """rows: (vec_id, vector, label). The codes of every row by looking at all entries."""
    rows = sorted(((i, [int(np.floor(scale * float(np.float32(x)))) for x in v], label) for i, v, label in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    w = len(rows[0][1]) // parts
    cut = lambda v, p: v[p * w : (p + 1) * w]
    books = [[cut(r[1], p) for r in rows[:entries]] for p in range(parts)]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    assign = lambda: [[min((d2(cut(r[1], p), c), e) for e, c in enumerate(books[p])) for p in range(parts)] for r in rows]
    for _ in range(rounds):
        at = assign()
        for p in range(parts):
            for e in range(len(books[p])):
                own = [cut(r[1], p) for r, a in zip(rows, at) if a[p][1] == e]
                if own:
                    books[p][e] = [sum(c) // len(own) for c in zip(*own)]
    at, total = assign(), {}
    for r, a in zip(rows, at):
        total[r[2]] = total.get(r[2], 0) + sum(d for d, _ in a)
    return sorted(((r[0], "".join(f"{e:02x}" for _, e in a), sum(d for d, _ in a), total[r[2]]) for r, a in zip(rows, at)), key=str), books


def run(spark, data, **how):
    frame = spark.createDataFrame([(*r, "clash", "clash", "clash") for r in data], COLUMNS).repartition(3)
    codes, books = vector_codes(scaled_vectors(frame), **how)
    return sorted((tuple(r) for r in codes.collect()), key=str), books


@pytest.mark.parametrize("hot", [1000, 2])
def test_codes(spark, monkeypatch, hot):
    from corvane.llm import skew

    monkeypatch.setattr(skew, "HOT_SHARE", hot)
    rng = np.random.default_rng(3)
    data = [(int(i), [float(x) for x in np.round(rng.normal(size=8) * 4) / 4], None if i % 3 else int(i % 5)) for i in rng.permutation(150)]
    data += [data[0], data[1], (7, [9.0] * 8, 1), (None, [0.25] * 8, 2), (-5, [-0.1] * 8, 2)]  # repeated rows and ids, a null id
    odd = [(900, None, 1), (901, [float("nan")] * 8, 1), (902, [None] + [0.0] * 7, 1), (903, [float("inf")] * 8, 1), (904, [], 1), (905, [1.0] * 6, 1)]
    wanted, books = brute(data, 4, 6, 3)
    assert run(spark, data + odd, parts=4, entries=6, rounds=3) == (wanted, books)


def test_few_rows_and_none(spark):
    data = [(2, [1.0, 2.0], 1), (1, [1.0, 2.0], None)]
    assert run(spark, data, parts=2, entries=16, rounds=2) == brute(data, 2, 16, 2)
    assert run(spark, [], parts=2) == ([], [])
    assert run(spark, [(1, None, 1)], parts=2) == ([], [])
    with pytest.raises(ValueError):
        run(spark, data, parts=3)


def test_search_is_exact_and_looks_at_few():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (16, 8))
    entries = np.concatenate([centres[:15], centres[3:4]])  # an entry twice
    x = np.concatenate([centres[rng.integers(0, 15, 2000)] + rng.integers(-50, 50, (2000, 8)), (entries[:1] + entries[1:2]) // 2])
    d = np.square(x[:, None] - entries[None]).sum(axis=2)
    for before in (np.zeros(len(x), np.uint8), d.argmin(axis=1).astype(np.uint8), rng.integers(0, 16, len(x)).astype(np.uint8)):
        at, best, computed = nearest(x, before, entries)
        assert (at == d.argmin(axis=1)).all() and (best == d.min(axis=1)).all()
    assert nearest(x, d.argmin(axis=1), entries)[2] < 2 * len(x)


def test_digest():
    import hashlib

    assert codebooks_digest([[[1, -2], [3, 4]]]) == hashlib.sha256(b"1,-2,3,4").hexdigest()
