"""Operator 3, best-fit packing, by Martello-Toth dominance reduction.

How many sequences are needed, and of what make, depends on the histogram of lengths alone: at most
``capacity`` numbers, however many documents there are. The histogram is reduced (sets that dominate
every other set holding one of their documents are fixed for good), best-fit packs what remains, and the
resulting layouts are dealt to the pieces by their rank among pieces of the same length, on the cluster.
"""

from __future__ import annotations

import bisect
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.tokens import memo
from corvane.session import materialise

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
#: Layout rows up to which they are broadcast; beyond it they are joined by shuffle.
BROADCAST_ROWS = 50_000


def _cutter(path: str, capacity: int, end_id: int):
    def cut(batches):
        import zlib

        import pyarrow as pa

        encoder = memo(path, space_matters=True, counts_only=False)
        end = end_id.to_bytes(4, "little")
        for b in batches:
            out = [[], [], [], [], []]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = memoryview(encoder.encode(text) + end)
                n = len(ids) // 4
                first = n if n <= capacity else n % capacity or capacity
                for i, (lo, hi) in enumerate(zip([0, *range(first, n, capacity)], [*range(first, n, capacity), n])):
                    for values, v in zip(out, (doc, i, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi]))):
                        values.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

    return cut


@dataclass
class Layout:
    """``count`` sequences that hold the same lengths: (length, how many), largest first."""

    count: int
    parts: list[tuple[int, int]] = field(default_factory=list)

    @property
    def used(self) -> int:
        return sum(length * n for length, n in self.parts)


def reduce_dominated(counts: dict[int, int], capacity: int) -> tuple[list[Layout], dict[int, int]]:
    """Fix sets of at most three that dominate all others holding the same length; what is left.

    A set S with length x dominates when every other feasible set with x can be grouped so that each
    group fits into one member of S. For S = {x, k}, k the longest that fits beside x, that holds if k
    fills the room, or if no two others fit together. For S = {x, k, b}, b the longest that fits beside
    both, it holds if no three others fit and no pair of others has a shorter member longer than b.
    """
    left = {n: c for n, c in counts.items() if c}
    fixed: list[Layout] = []

    def take(x: int, partners: list[int]) -> None:
        need: dict[int, int] = {}
        for n in (x, *partners):
            need[n] = need.get(n, 0) + 1
        m = min(left[n] // k for n, k in need.items())
        fixed.append(Layout(m, sorted(need.items(), reverse=True)))
        for n, k in need.items():
            left[n] -= m * k
            if not left[n]:
                del left[n]

    again = True
    while again:
        again = False
        for x in sorted(left, reverse=True):
            while x in left:
                room = capacity - x
                rest = sorted(left)
                if left[x] == 1:
                    rest.remove(x)
                at = bisect.bisect_right(rest, room)
                if not at:
                    take(x, [])
                    again = True
                    continue
                k = rest[at - 1]
                smallest = _smallest(left, x, 3)
                if k == room or len(smallest) < 2 or smallest[0] + smallest[1] > room:
                    take(x, [k])
                    again = True
                    continue
                if len(smallest) < 3 or sum(smallest) > room:
                    b = _longest(left, {x: 1, k: 1 + (k == x)}, room - k)
                    if b and all(_longest(left, {x: 1, y: 1 + (y == x)}, min(y, room - y)) <= b for y in rest[: at - 1]):
                        take(x, [k, b])
                        again = True
                        continue
                break
    return fixed, left


def _smallest(left: dict[int, int], without: int, n: int) -> list[int]:
    out: list[int] = []
    for length in sorted(left):
        out += [length] * min(n - len(out), left[length] - (length == without))
        if len(out) == n:
            break
    return out


def _longest(left: dict[int, int], taken: dict[int, int], room: int) -> int:
    return max((n for n, c in left.items() if n <= room and c > taken.get(n, 0)), default=0)


def best_fit(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Best-fit decreasing over a histogram: equal sequences are handled together."""
    open_by_room: dict[int, list[Layout]] = {}
    rooms: list[int] = []
    done: list[Layout] = []

    def put(layout: Layout) -> None:
        room = capacity - layout.used
        if room <= 0:
            done.append(layout)
            return
        if room not in open_by_room:
            open_by_room[room] = []
            bisect.insort(rooms, room)
        open_by_room[room].append(layout)

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                layout = open_by_room[room].pop()
                if not open_by_room[room]:
                    del open_by_room[room]
                    rooms.pop(at)
            else:
                room, layout = capacity, Layout(n)
            each = room // length
            full = min(layout.count, n // each)
            if full:
                put(Layout(full, [*layout.parts, (length, each)]))
                n -= full * each
            spare = layout.count - full
            if spare and n:  # fewer than ``each`` are left: they go into one sequence
                some = min(n, each)
                put(Layout(1, [*layout.parts, (length, some)]))
                n -= some
                spare -= 1
            if spare and layout.parts:
                put(Layout(spare, layout.parts))
    return done + [x for layouts in open_by_room.values() for x in layouts]


def plan_layouts(counts: dict[int, int], capacity: int) -> list[Layout]:
    """Reduction, then best-fit."""
    fixed, left = reduce_dominated(counts, capacity)
    return fixed + best_fit(left, capacity)


def layout_rows(layouts: list[Layout]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, end rank, how many a sequence, first sequence, offset) for every part."""
    rows, ranks, sequence = [], {}, 0
    for layout in layouts:
        offset = 0
        for length, each in layout.parts:
            first = ranks.get(length, 0)
            ranks[length] = first + layout.count * each
            rows.append((length, first, ranks[length], each, sequence, offset))
            offset += length * each
        sequence += layout.count
    return rows


def pack(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Every piece of every document with its sequence and its offset there.

    A document is its ids and ``end_id``, so null and empty texts are one piece of length 1. Only longer
    ones than ``capacity`` are cut, all pieces full but the first. Repeated rows are packed as often as
    they occur. An empty table gives no piece. Other columns of ``docs`` are not looked at.

    Scale: one row a piece is shuffled, without ids; ranks come from counts of hashed shares of each
    length, so a length that a third of all pieces have is not one task's. The driver sees a histogram
    of ``capacity`` numbers at most.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    pieces = materialise(rows.mapInArrow(_cutter(tokenizer_path, capacity, end_id), PIECE_SCHEMA), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    layout = layout_rows(plan_layouts(counts, capacity))
    parts = spark.createDataFrame(layout, "length long, lo long, hi long, each long, first_sequence long, base long")
    if len(layout) <= BROADCAST_ROWS:
        parts = F.broadcast(parts)
    shares = max(256, sum(counts.values()) // 50_000)
    dealt = pieces.withColumn("share", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(7)), F.lit(shares)))
    before = Window.partitionBy("length").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("length", "share").count().select("length", "share", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("ahead"))
    own = Window.partitionBy("length", "share").orderBy("doc_id", "piece", "ids_crc32")
    ranked = dealt.withColumn("own", F.row_number().over(own)).join(bases, ["length", "share"])
    ranked = ranked.withColumn("rank", F.col("ahead") + F.col("own") - 1)
    at = F.col("rank") - F.col("lo")
    return (
        ranked.join(parts, "length")
        .where((F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
        .select(
            "doc_id", "piece", "start", "length", "ids_crc32",
            (F.col("first_sequence") + F.floor(at / F.col("each"))).cast("long").alias("sequence_id"),
            (F.col("base") + F.col("length") * F.pmod(at, F.col("each"))).cast("long").alias("offset"),
        )
    )
