"""Operator 5, secret scans, natively: patterns, and sliding-window entropy per character class.

Pattern matches are located by what lies between them: the text is split at a pattern, and the lengths of gaps and
matches add up to code point offsets. Candidate strings that no pattern explains are judged by the
Shannon entropy of their best window, with the counts of a window's characters kept up as it slides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: Greedy runs of at least the length asked for start where the run does, as the shorter patterns' matches would.
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
BASE_KINDS = ("assign", "access", "hex")
ENTROPY_KIND = "entropy"

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Items that a fold appends to one result.
BLOCK = 128
#: Counts that one number holds, five bits each.
PACKED = 12


@dataclass(frozen=True)
class CharClass:
    """Strings made of ``alphabet`` only, and the bits a character that a window of one must reach."""

    name: str
    pattern: str
    alphabet: str
    least_bits: float


_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A word of a path or name: letters of one case or capitalised, with a short number after it, or a number.
_WORD = r"(?:(?:[A-Z]?[a-z]{1,15}|[A-Z]{1,15})[0-9]{0,2}|[0-9]{1,8})"
#: From narrow to wide; a string belongs to the first whose pattern it matches.
CLASSES = (
    CharClass("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef", 3.0),
    CharClass("upper", r"^[0-9A-Z]+$", _DIGITS + _UPPER, 3.4),
    CharClass("alnum", r"^[0-9A-Za-z]+$", _DIGITS + _LOWER + _UPPER, 3.6),
    CharClass("base64", r"^[0-9A-Za-z+/_=-]+$", _DIGITS + _LOWER + _UPPER + "+/_=-", 3.8),
)
#: Whole strings that look random and are known not to be secret: UUIDs, numbers, dates, paths and names of short
#: words with separators, and names of capitalised words without.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9+/_=-]+$",
    r"^[/_-]*" + _WORD + r"([/_=+-]+" + _WORD + r")+[/_=-]*$",
    r"^[A-Za-z][a-z]{0,14}([A-Z][a-z]{2,14})+[0-9]{0,2}$",
)

SPAN = "struct<start:int,kind_no:int,kind:string,end:int,hit:string>"
_NO_SPANS = f"array<{SPAN}>"


def _let(value: Column, body) -> Column:
    """``body(value)``, with ``value`` computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _scan(items: Column, kind: str, value, combine, make) -> Column:
    """``make(item, so far)`` of every item, where ``so far`` combines the values (not negative) of those before.

    A fold that appends to its result copies it each time, so the fold runs within blocks and over the blocks' totals: what is
    copied is then ``BLOCK`` times the items rather than their square.
    """
    zero = F.lit(0)

    def grown(xs: Column, start: Column, out_kind: str, of, made) -> Column:
        init = F.struct(start.alias("at"), F.array().cast(out_kind).alias("out"))
        step = lambda acc, x: F.struct(combine(acc["at"], of(x)).alias("at"), F.concat(acc["out"], F.array(made(x, acc["at"])).cast(out_kind)).alias("out"))
        return F.aggregate(xs, init, step, lambda acc: acc["out"])

    def in_blocks(blocks: Column) -> Column:
        totals = F.transform(blocks, lambda block: F.aggregate(block, zero, lambda acc, x: combine(acc, value(x))))
        starts = grown(totals, zero, "array<int>", lambda t: t, lambda t, at: at)
        return F.flatten(F.zip_with(blocks, starts, lambda block, at: grown(block, at, kind, value, make)))

    last = lambda xs: F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int") - 1, zero)
    cut = _let(items, lambda xs: F.transform(F.sequence(zero, last(xs)), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK)))
    return _let(cut, in_blocks)


def spans_of(text: Column, pattern: str, kind: str, kind_no: int) -> Column:
    """Leftmost non-overlapping matches with code point offsets, end exclusive."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    pairs = F.zip_with(hits, F.slice(gaps, 1, F.size(hits)), lambda h, g: F.struct(g.alias("gap"), h.alias("hit")))

    def span(x: Column, at: Column) -> Column:
        start = at + F.length(x["gap"])
        end = start + F.length(x["hit"])
        return F.struct(start.alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(kind).alias("kind"), end.alias("end"), x["hit"].alias("hit"))

    found = _scan(pairs, _NO_SPANS, lambda x: F.length(x["gap"]) + F.length(x["hit"]), lambda a, b: a + b, span)
    return F.when(text.rlike(pattern), found).otherwise(F.array().cast(_NO_SPANS))


def _xlog(n: int) -> float:
    return n * math.log2(n) if n else 0.0


def _best_range(hit: Column) -> Column:
    """(from, to) of the windows of ``hit`` that reach its class's entropy; -1 if none does, null if it is of no class.

    The state is the window's counts, five bits each in a few numbers, and the sum of count * log2(count). A step adds what the
    entering and the leaving character change, and touches only their counts.
    """
    alphabet = CLASSES[-1].alphabet  # it has those of the others
    least = F.lit(None).cast("double")
    for cls in reversed(CLASSES):
        least = F.when(hit.rlike(cls.pattern), F.lit(cls.least_bits)).otherwise(least)
    code = F.transform(F.split(hit, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    growth = F.array(*[F.lit(float(_xlog(k + 1) - _xlog(k))) for k in range(WINDOW + 1)])
    floor = WINDOW * (math.log2(WINDOW) - least)  # entropy >= least is sum <= floor
    words = [f"w{i}" for i in range(-(-len(alphabet) // PACKED))]
    units = F.array(*[F.lit(1 << (5 * i)).cast("long") for i in range(PACKED)])
    init = F.struct(
        *[F.lit(0).cast("long").alias(w) for w in words], F.lit(0.0).alias("total"),
        F.lit(-1).alias("first"), F.lit(-1).alias("last"), F.lit(0).alias("i"),
    )

    def run(codes: Column, floor: Column) -> Column:
        def step(acc: Column, entering: Column) -> Column:
            i = acc["i"]
            # nothing leaves the first windows: a code that no number holds
            leaving = F.when(i >= WINDOW, F.get(codes, i - WINDOW)).otherwise(F.lit(PACKED * len(words)))

            def count(c: Column) -> Column:
                held = F.lit(0).cast("long")
                for j, w in enumerate(words):
                    held = F.when(F.floor(c / PACKED) == j, acc[w]).otherwise(held)
                return F.call_function("shiftright", held, 5 * F.pmod(c, F.lit(PACKED))).bitwiseAND(F.lit(31).cast("long")).cast("int")

            # what one more, or one less, of a character adds to the sum
            change = F.when(leaving == entering, F.lit(0.0)).otherwise(
                F.element_at(growth, count(entering) + 1) - F.when(i >= WINDOW, F.element_at(growth, F.greatest(count(leaving), F.lit(1)))).otherwise(F.lit(0.0))
            )

            def one(c: Column, j: int) -> Column:
                return F.when(F.floor(c / PACKED) == j, F.element_at(units, F.pmod(c, F.lit(PACKED)) + 1)).otherwise(F.lit(0).cast("long"))

            total = acc["total"] + change
            reached = (i >= WINDOW - 1) & (total <= floor + 1e-9)
            return F.struct(
                *[(acc[w] + one(entering, j) - one(leaving, j)).alias(w) for j, w in enumerate(words)], total.alias("total"),
                F.when(reached & (acc["first"] < 0), i - (WINDOW - 1)).otherwise(acc["first"]).alias("first"),
                F.when(reached, i + 1).otherwise(acc["last"]).alias("last"), (i + 1).alias("i"),
            )

        return F.aggregate(codes, init, step, lambda a: F.struct(a["first"].alias("first"), a["last"].alias("last")))

    return _let(floor, lambda floor: _let(code, lambda codes: run(codes, floor)))


_FREE = "array<struct<from:int,to:int>>"


def _free_of(base: Column, length: Column) -> Column:
    """What sorted base spans leave of a text of that length: (from, to), in order."""
    before = lambda xs: _scan(xs, _FREE, lambda x: x["end"], F.greatest, lambda x, reach: F.struct(reach.alias("from"), x["start"].alias("to")))
    last = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: F.greatest(acc, x["end"]))
    every = _let(base, lambda xs: F.concat(before(xs), F.array(F.struct(last(xs).alias("from"), length.alias("to"))).cast(_FREE)))
    return F.filter(every, lambda x: x["from"] < x["to"])


def _first_where(items: Column, holds) -> Column:
    """Index of the first of sorted items that a condition holds for, by bisection; their number if for none."""
    init = F.struct(F.lit(0).alias("lo"), F.size(items).alias("hi"))

    def step(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        ok = F.coalesce(holds(F.get(items, mid)), F.lit(True))  # beyond the end once both have met there
        return F.struct(F.when(ok, acc["lo"]).otherwise(mid + 1).alias("lo"), F.when(ok, F.least(mid, acc["hi"])).otherwise(acc["hi"]).alias("hi"))

    steps = F.ceil(F.log2(F.size(items) + 1)).cast("int") + 1
    return F.aggregate(F.sequence(F.lit(1), steps), init, step, lambda acc: acc["lo"])


def _entropy_spans(candidates: Column, free: Column, kind_no: int) -> Column:
    """Spans of what base spans leave of the candidates, where that reaches its class's entropy and is not allowed."""

    def judged(x: Column) -> Column:
        return _let(_best_range(x["hit"]), lambda best: F.struct(
            (x["start"] + best["first"]).alias("start"), F.lit(kind_no).alias("kind_no"), F.lit(ENTROPY_KIND).alias("kind"),
            F.when(best["first"] >= 0, x["start"] + best["last"]).alias("end"), x["hit"].alias("hit"),
        ))

    def left_over(free: Column, x: Column) -> Column:
        lo = _first_where(free, lambda g: g["to"] > x["start"])
        hi = _first_where(free, lambda g: g["from"] >= x["end"])
        cut = F.transform(F.slice(free, lo + 1, F.greatest(hi - lo, F.lit(0))), lambda g: F.struct(
            F.greatest(g["from"], x["start"]).alias("from"), F.least(g["to"], x["end"]).alias("to")))

        def part(g: Column) -> Column:
            hit = F.substring(x["hit"], g["from"] - x["start"] + 1, g["to"] - g["from"])
            return F.struct(g["from"].alias("start"), F.lit(kind_no).alias("kind_no"), F.lit("candidate").alias("kind"), g["to"].alias("end"), hit.alias("hit"))

        return F.transform(F.filter(cut, lambda g: g["to"] - g["from"] >= WINDOW), part)

    def open_to_doubt(x: Column) -> Column:
        ok = F.lit(True)
        for pattern in ALLOWED:
            ok = ok & ~x["hit"].rlike(pattern)
        return ok

    left = _let(free, lambda free: F.flatten(F.transform(candidates, lambda x: left_over(free, x))))
    parts = F.filter(left, open_to_doubt)
    return F.filter(F.transform(parts, judged), lambda x: x["end"].isNotNull())


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_entropy, base_sha256, spans) of every row of ``docs``.

    Null and empty texts have no span, and ``base_sha256`` of the empty string. Repeated rows are scanned each;
    an empty table gives an empty result; other columns are not looked at. No shuffle, no Python: a text's
    spans are found in its own row, texts that hold no match cost one search for each pattern, and many spans cost little more
    than their number.
    """
    text = F.col("text")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    assign = F.filter(
        spans_of(text, ASSIGN, "assign", 0), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6
    )
    found = rows.select(
        "doc_id",
        F.length(text).alias("length"),
        assign.alias("assign"),
        spans_of(text, ACCESS, "access", 1).alias("access"),
        spans_of(text, HEX, "hex", 2).alias("hex"),
        spans_of(text, CANDIDATE, "candidate", 3).alias("candidates"),
    )
    base = found.withColumn("base", F.sort_array(F.concat("assign", "access", "hex")))
    both = base.withColumn("free", _free_of(F.col("base"), F.col("length"))).withColumn("entropy", _entropy_spans(F.col("candidates"), F.col("free"), 3))
    count = lambda c: F.size(c).cast("long").alias(f"n_{c}")
    return both.select(
        "doc_id", count("assign"), count("access"), count("hex"), count("entropy"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.sort_array(F.concat("base", "entropy"))).alias("spans"),
    )
