"""Rebuilds in pages, schedules, quotas, prints by built-ins, and groups in place of pairs."""

import datetime
import hashlib
import random

import pytest
import regex
from pyspark.sql import functions as F

from corvane.operators import dedup, ops, resolve, schedule
from corvane.operators.rebuild import Rebuild


@pytest.mark.parametrize("stops", [(None,), (1, 1, None), (2, 0, None)])
def test_rebuild_goes_on_where_it_stopped(spark, tmp_path, stops):
    rows = [(k, f"v{k}") for k in (5, 1, 1, 9, 12, 30, 31, 40, 41)] + [(None, "null")]
    source = spark.createDataFrame(rows, "k long, v string")
    calls = []
    build = lambda page: (calls.append(1), page.select("v"))[1]
    again = Rebuild(spark, f"file://{tmp_path}/graph")
    again.run(source.where("k = 5"), "k", build, 2)
    old = again.current()
    for stop in stops:
        whole = again.run(source, "k", build, 3, stop)
        assert whole == (stop is None)
        if not whole:  # readers see the old one
            assert again.current() == old and [r.v for r in again.read("v string").collect()] == ["v5"]
            again = Rebuild(spark, again.path)
    assert again.current() != old and sorted(r.v for r in again.read("v string").collect()) == sorted(v for _, v in rows)
    assert len(calls) == 1 + 3  # no page was built twice
    assert Rebuild(spark, f"file://{tmp_path}/none").read("v string").isEmpty()


def test_rebuild_of_nothing_and_of_null_keys(spark, tmp_path):
    empty, nulls = spark.createDataFrame([], "k long, v string"), spark.createDataFrame([(None, "a")], "k long, v string")
    for name, source, n in (("e", empty, 0), ("n", nulls, 1)):
        again = Rebuild(spark, f"file://{tmp_path}/{name}")
        assert again.run(source, "k", lambda p: p.select("v"), 3) and again.read("v string").count() == n


def brute_due(text, now):
    """Goes back minute by minute."""
    fields = text.split()
    names = {n: i + 1 for i, n in enumerate(schedule.MONTHS)} | {n: i for i, n in enumerate(schedule.WEEKDAYS)}

    def values(field, low, high):
        out = set()
        for part in field.split(","):
            base, _, step = part.partition("/")
            if base == "*":
                a, b = low, high
            else:
                a, _, b = base.partition("-")
                a = int(names.get(a, a))
                b = int(names.get(b, b)) if b else high if step else a
            out |= set(range(a, b + 1, int(step or 1)))
        return out

    minute, hour, day, month, week = (values(f, *r) for f, r in zip(fields, ((0, 59), (0, 23), (1, 31), (1, 12), (0, 7))))
    week = {w % 7 for w in week}
    at = now.replace(second=0, microsecond=0)
    for _ in range(60 * 24 * 800):
        if at.minute in minute and at.hour in hour and at.month in month:
            dom, dow = at.day in day, (at.weekday() + 1) % 7 in week
            if (dow if fields[2] == "*" else dom if fields[4] == "*" else dom or dow):
                return int(at.replace(tzinfo=datetime.timezone.utc).timestamp())
        at -= datetime.timedelta(minutes=1)


def test_schedules(spark):
    now = datetime.datetime(2024, 3, 1, 0, 7, 31)
    now_s = int(now.replace(tzinfo=datetime.timezone.utc).timestamp())
    good = ["* * * * *", "*/15 * * * *", "8-59/7 * * * *", "0 0 * * *", "30 23 31 * *", "5 4 * * sun", "0 12 1,15 * mon-wed", "10 10 29 feb *", "0 9-17/4 * jan,mar 5", "59 23 * * 7", "7 0 1 3 *"]
    bad = ["60 * * * *", "* * * *", "* * * * * * *", "a * * * *", "5-1 * * * *", "*/0 * * * *", "1,,2 * * * *", "* 24 * * *"]
    rows = spark.createDataFrame([(s,) for s in [*good, *bad, None, " ", good[0]]], "schedule string")
    found = {r.schedule: (r.readable, r.due_at) for r in schedule.due_times(rows, now_s).collect()}
    assert found == {s: (True, brute_due(s, now)) for s in good} | {s: (False, None) for s in bad}
    seconds = spark.createDataFrame([("15,45 * * * * *",), ("50 7 0 * * *",)], "schedule string")
    assert {r.schedule: r.due_at - now_s for r in schedule.due_times(seconds, now_s).collect()} == {"15,45 * * * * *": -16, "50 7 0 * * *": -86400 + 19}


def test_quotas(spark):
    d, e = datetime.date(2024, 1, 1), datetime.date(2024, 1, 2)
    rows = [("c", "r", d, i, a) for i, a in enumerate([2, 2, 2, None, 1])] + [("c", "s", d, 10, 3), ("c", None, d, 11, 2), ("c", "r", e, 12, 1), ("c", "s", e, 13, 4), (None, "r", d, 1, 99), ("free", "r", d, 1, 51), ("free", "q", d, 2, 50)]
    calls = spark.createDataFrame(rows, "collection string, run string, day date, n long, amount long")
    limits = spark.createDataFrame([("c", 5, 9)], "collection string, max_ai_calls_per_run int, daily_ai_budget int")
    found = {(r.collection, r.n): (r.allowed, r.refused_by, r.used_run, r.used_day) for r in ops.within_quotas(calls, limits, ["n"]).collect()}
    assert found == {
        ("c", 0): (True, None, 2, 2), ("c", 1): (True, None, 4, 4), ("c", 2): (False, "run", 4, 4), ("c", 3): (False, "no_amount", 4, 4), ("c", 4): (True, None, 5, 5), ("c", 10): (True, None, 3, 8),
        ("c", 11): (False, "day", None, 8), ("c", 12): (False, "run", 5, 0), ("c", 13): (False, "run", 3, 0), (None, 1): (True, None, None, None), ("free", 1): (False, "run", 0, 0), ("free", 2): (True, None, 50, 50),
    }


def test_prints_by_built_ins(spark, monkeypatch):
    rng = random.Random(6)
    words = ["Straße", "the", "ÉTÉ", "x1", "a", "标题", "naïve", "zz"]
    texts = [" ".join(rng.choice(words) for _ in range(n)) for n in (3, 16, 17, 40, 500, 3000)] + [None, "", "- " * 40]

    def plain(text):
        found = [w for w in regex.findall(r"[\p{L}\p{N}]+", (text or "").lower()) if len(w) > 1]
        if len(found) < 16:
            return None
        hashes = [int.from_bytes(hashlib.sha256(w.encode()).digest()[:8], "little") for w in found]
        value = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(found))
        return value - (1 << 64) if value >= 1 << 63 else value

    wanted = {i: plain(t) for i, t in enumerate(texts) if plain(t) is not None}
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for lane in (65_535, 100):
        monkeypatch.setattr(dedup, "LANE_WORDS", lane)
        prints = dedup.simhash_fingerprints(docs, built_in=True)
        assert {r.doc_id: r.print for r in prints.collect()} == wanted
    assert {r.doc_id: r.print for r in dedup.simhash_fingerprints(docs).collect()} == wanted
    assert "Python" not in prints._jdf.queryExecution().toString() and "Arrow" not in prints._jdf.queryExecution().toString()


def test_stars_group_as_pairs_do(spark):
    rng = random.Random(9)
    rows = [(f"e{rng.randrange(60):02}", f"ns{rng.randrange(3)}_handle", f"v{rng.randrange(25)}") for _ in range(90)]
    frame = spark.createDataFrame(rows, "entity string, namespace string, value string")

    def groups(pairs):
        up = {}
        find = lambda x: x if up.setdefault(x, x) == x else find(up[x])
        for r in pairs.collect():
            up[max(find(r.a), find(r.b))] = min(find(r.a), find(r.b))
        return {x: find(x) for x in list(up)}

    stars = resolve.star_links(frame, ["value"], "account_handle", "namespace")
    pairs = resolve.by_account_handle(frame)
    assert groups(stars) == groups(pairs) and stars.select("a", "b").exceptAll(pairs.select("a", "b")).isEmpty()


def test_ranks_don_t_mind_gaps(spark):
    ids = [1, 2, 3, 10**15, 10**15 + 1, -(10**12)] + list(range(500, 700))
    found = dedup.ranked_by_id(spark.createDataFrame([(i,) for i in ids], "doc_id long"))
    assert {r.doc_id: r["rank"] for r in found.collect()} == {i: n + 1 for n, i in enumerate(sorted(ids))}


def test_semantic_parents_write_one_row_a_document(spark, monkeypatch):
    import numpy as np

    from corvane.operators import embed

    monkeypatch.setattr(resolve, "BLOCK_ROWS", 16)
    monkeypatch.setattr(resolve, "EXACT_PAIRS", 50)
    rng = np.random.default_rng(7)
    base = rng.normal(size=(6, 8))
    v = np.repeat(base, 12, axis=0) + rng.normal(size=(72, 8)) * 0.1
    v[30] = v[29] = v[25]
    rows = [(int(i), "m", [float(x) for x in v[i]]) for i in rng.permutation(72)]
    rows += [(40, "m", rows[0][2]), (99, "other", rows[0][2]), (100, "m", None)]
    found = {r.doc_id: (r.parent, round(r.similarity, 9)) for r in embed.semantic_parents(spark.createDataFrame(rows, "doc_id long, model string, embedding array<double>"), 0.9).collect()}
    wanted = {}
    for i, m, x in rows:
        for j, n, y in rows:
            if j < i and m == n and x and y:
                cos = float(np.dot(x, y) / (np.linalg.norm(x) * np.linalg.norm(y)))
                if cos >= 0.9 and (round(cos, 9), -j) > (wanted.get(i, (0, 0))[1], -wanted.get(i, (0, 0))[0]):
                    wanted[i] = (j, round(cos, 9))
    assert found == wanted and len(found) > 50
