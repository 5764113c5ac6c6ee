"""Staged de-duplication: parents by key and by SimHash, first stage wins, forest roots."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.extract import let
from corvane.session import materialise

MIN_TOKENS, MAX_DISTANCE, SCAN_BACK = 16, 3, 500


def parent_by_key(docs: DataFrame, key: Column, id_col: str = "doc_id") -> DataFrame:
    """(id, parent): for documents whose key an earlier one has, the earliest.

    The minimum is combined before the shuffle and joined back, so a key that a third of all documents have is
    split like any skewed join. Null and empty keys match nothing.
    """
    keyed = docs.select(F.col(id_col), key.alias("key")).where("key IS NOT NULL AND key <> ''")
    first = keyed.groupBy("key").agg(F.min(id_col).alias("parent"))
    return keyed.join(first, "key").where(F.col(id_col) > F.col("parent")).select(id_col, "parent")


#: Words that a sixteen-bit lane can count.
LANE_WORDS = 65_535


def simhash(words: Column) -> Column:
    """The 64-bit SimHash of an array of words: a bit is set where it is in over half of their digests (first 8 bytes of SHA-256, little end first).

    Bits are counted four at a time: a digest, shifted by 0 to 15 and masked, adds one to each of the four sixteen-bit lanes of a long whose bit is
    set. Longer texts are counted in parts.
    """
    lanes, zero = 0x0001000100010001, F.lit(0).cast("long")
    digest = lambda w: F.conv(F.substring(F.sha2(w, 256), 1, 16), 16, -10).cast("long")
    parts = lambda hs: F.transform(F.sequence(F.lit(0), F.floor((F.size(hs) - 1) / LANE_WORDS).cast("int")), lambda i: F.slice(hs, i * LANE_WORDS + 1, LANE_WORDS))
    lane = lambda part, s: F.aggregate(part, zero, lambda a, h: a + F.shiftright(h, s).bitwiseAND(F.lit(lanes)))
    counted = lambda part: F.array(*[lane(part, s) for s in range(16)])
    total = lambda sums, bit: F.aggregate(sums, zero, lambda a, each: a + F.shiftrightunsigned(each[bit % 16], bit // 16 * 16).bitwiseAND(F.lit(0xFFFF)))

    def printed(x: Column) -> Column:
        out = zero
        for bit in range(64):
            n = total(x["sums"], bit)
            at = 8 * (7 - bit // 8) + bit % 8  # the digest was read big end first
            out = out.bitwiseOR(F.when(2 * n > x["n"], F.lit(1 << at if at < 63 else -(1 << 63)).cast("long")).otherwise(zero))
        return out

    summed = lambda hs: F.struct(F.size(hs).alias("n"), F.transform(parts(hs), counted).alias("sums"))
    return let(let(F.transform(words, digest), summed), printed)


#: Digests of words that a Python worker remembers, about 200 bytes each.
KNOWN_WORDS = 100_000


def _simhash(batches):
    from hashlib import sha256

    import numpy as np
    import pyarrow as pa
    import regex

    split = regex.compile(r"[\p{L}\p{N}]+")
    known: dict[str, bytes] = {}

    def printed(text):
        words = [w for w in split.findall(text.lower()) if len(w) > 1]
        if len(words) < MIN_TOKENS:
            return None
        for w in set(words).difference(known):
            if len(known) >= KNOWN_WORDS:
                known.clear()
            known[w] = sha256(w.encode()).digest()[:8]
        raw = b"".join([known[w] if w in known else sha256(w.encode()).digest()[:8] for w in words])
        ones = np.zeros(64, np.int64)
        for at in range(0, len(raw), 1 << 19):
            part = np.frombuffer(raw[at : at + (1 << 19)], np.uint8).reshape(-1, 8)
            ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        return int(np.packbits(2 * ones > len(words), bitorder="little").view(np.int64)[0])

    for b in batches:
        # one text at a time becomes a string of Python's
        prints = [printed(text.as_py() or "") for text in b.column("text")]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])


def simhash_fingerprints(docs: DataFrame, built_in: bool = False) -> DataFrame:
    """(doc_id, print): 64-bit SimHash over lower-cased words of two and more characters; none under 16 words.

    With ``built_in`` no Python worker runs and the prints are the same; folding arrays in the JVM takes about ten times as long as numpy in Arrow batches.
    """
    if not built_in:
        return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_simhash, "doc_id long, print long").where("print IS NOT NULL")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda w: F.length(w) > 1)
    hashed = let(words, lambda ws: F.when(F.size(ws) >= MIN_TOKENS, simhash(ws)))
    return docs.select(F.col("doc_id").cast("long"), hashed.alias("print")).where("print IS NOT NULL")


def ranked_by_id(rows: DataFrame, id_col: str = "doc_id", share_rows: int = 1_000_000) -> DataFrame:
    """``rows`` with ``rank``, the place (from 1) by id, without sorting all in one task.

    Ranges of ids are cut where Spark's sample of them says, so gaps don't matter; they are written, so that what a row's range is stays. One
    row a range is summed in one task.
    """
    held = rows.count()
    n = max(rows.sparkSession.sparkContext.defaultParallelism, held // share_rows)
    dealt = materialise(rows.repartitionByRange(n, id_col).withColumn("share", F.spark_partition_id()), "ranges")
    ahead = Window.orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    bases = dealt.groupBy("share").count().select("share", F.coalesce(F.sum("count").over(ahead), F.lit(0)).alias("base"))
    own = F.row_number().over(Window.partitionBy("share").orderBy(id_col))
    return dealt.withColumn("own", own).join(F.broadcast(bases), "share").withColumn("rank", F.col("base") + F.col("own")).drop("share", "own", "base")


def simhash_candidates(prints: DataFrame, max_distance: int = MAX_DISTANCE, scan_back: int = SCAN_BACK) -> DataFrame:
    """(doc_id, parent, distance): the best earlier document within the distance among the ``scan_back`` before.

    ``simhash_candidates_unbounded`` looks at all. A 64-bit value within distance 3 of another shares one of its four 16-bit bands; the bound on how far back to
    look is a second key, so no band ever pairs more than two stretches of ``scan_back`` ranks.
    """
    ranked = ranked_by_id(prints)
    bands = F.explode(F.array(*[F.struct(F.lit(i).alias("band"), F.shiftrightunsigned("print", 16 * i).bitwiseAND(0xFFFF).alias("value")) for i in range(4)]))
    stretch = F.floor((F.col("rank") - 1) / scan_back)
    banded = ranked.withColumn("stretch", stretch).select("*", bands.alias("b")).select("doc_id", "print", "rank", "stretch", "b.*")
    later = banded.select("*", F.explode(F.array(F.col("stretch"), F.col("stretch") - 1)).alias("in_stretch"))
    earlier = banded.select(F.col("doc_id").alias("parent"), F.col("print").alias("p"), F.col("rank").alias("r"), F.col("stretch").alias("in_stretch"), "band", "value").hint("merge")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("p")))
    met = later.join(earlier, ["band", "value", "in_stretch"]).where((F.col("r") < F.col("rank")) & (F.col("r") >= F.col("rank") - scan_back))
    near = met.select("doc_id", "parent", distance.alias("distance")).where(F.col("distance") <= max_distance)
    best = near.groupBy("doc_id").agg(F.min(F.struct("distance", "parent")).alias("best"))
    return best.select("doc_id", "best.parent", "best.distance")


def simhash_candidates_unbounded(prints: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, parent, distance): the best earlier document within the distance, however far before.

    Of 64 bits in ``max_distance`` + 3 blocks, two values within the distance have three in common, so each distinct
    fingerprint meets others under every choice of three. A document that repeats an earlier one's fingerprint has
    that one's first document as its parent; only the first documents of fingerprints need a search.
    """
    n = max_distance + 3
    cuts = [64 * i // n for i in range(n + 1)]
    masks = [sum((1 << cuts[b + 1]) - (1 << cuts[b]) for b in choice) for choice in combinations(range(n), 3)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    firsts = materialise(prints.groupBy("print").agg(F.min("doc_id").alias("first")), "first-prints")
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("choice"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("value")) for i, m in enumerate(signed)]))
    keyed = firsts.select("first", "print", keys.alias("k")).select("first", "print", "k.*")
    # each fingerprint is twenty rows here, which Spark's estimate of sizes doesn't see: a broadcast would build all of them on the driver
    earlier = keyed.select(F.col("first").alias("parent"), F.col("print").alias("p"), "choice", "value").hint("merge")
    distance = F.bit_count(F.col("print").bitwiseXOR(F.col("p")))
    met = keyed.join(earlier, ["choice", "value"]).where((F.col("parent") < F.col("first")) & (distance <= max_distance))
    near = met.select(F.col("first").alias("doc_id"), F.struct(distance.alias("distance"), "parent").alias("hit"))
    best = near.groupBy("doc_id").agg(F.min("hit").alias("best")).select("doc_id", "best.parent", "best.distance")
    same = prints.join(firsts, "print").where(F.col("doc_id") > F.col("first")).select("doc_id", F.col("first").alias("parent"), F.lit(0).alias("distance"))
    return best.unionByName(same)


def staged_parents(docs: DataFrame, stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """(doc_id, stage, parent): the first stage that finds a parent decides."""
    rows = None
    for n, (name, found) in enumerate(stages):
        part = found.select("doc_id", F.struct(F.lit(n).alias("n"), F.lit(name).alias("stage"), F.col("parent")).alias("hit"))
        rows = part if rows is None else rows.unionByName(part)
    best = rows.groupBy("doc_id").agg(F.min("hit").alias("hit"))
    return docs.select("doc_id").join(best, "doc_id", "left").select("doc_id", "hit.stage", "hit.parent")


def forest_roots(parents: DataFrame, max_hops: int = 8) -> DataFrame:
    """(doc_id, root): parents followed to their roots by pointer jumping; a chain of more hops than allowed is an error.

    Each row carries the hops it has jumped, which double in each round, so the bound is exact.
    """
    start = F.coalesce("parent", "doc_id").alias("root")
    now = materialise(parents.select("doc_id", start, F.when(F.col("parent") != F.col("doc_id"), 1).otherwise(0).alias("hops")), "roots")
    while True:
        up = now.select(F.col("doc_id").alias("root"), F.col("root").alias("above"), F.col("hops").alias("more"))
        moved = (F.col("above") != F.col("root")).alias("moved")
        new = now.join(up, "root", "left").select("doc_id", F.coalesce("above", "root").alias("root"), (F.col("hops") + F.coalesce("more", F.lit(0))).alias("hops"), moved)
        new = materialise(new, "roots")
        longest, any_moved = new.agg(F.max("hops"), F.max("moved")).first()
        if (longest or 0) > max_hops:
            raise ValueError(f"a chain of duplicates is longer than {max_hops}")
        now = new.drop("moved")
        if not any_moved:
            return now.drop("hops")


def duplicate_groups(staged: DataFrame, roots: DataFrame) -> DataFrame:
    """(canonical, doc_id, stage): every duplicate with its canonical document."""
    return staged.where("parent IS NOT NULL").join(roots, "doc_id").select(F.col("root").alias("canonical"), "doc_id", "stage")


def duplicate_rate(staged: DataFrame) -> DataFrame:
    """(examined, duplicates, rate): 0 where nothing was examined."""
    counts = staged.agg(F.count("*").alias("examined"), F.count("parent").alias("duplicates"))
    return counts.withColumn("rate", F.when(F.col("examined") > 0, F.col("duplicates") / F.col("examined")).otherwise(0.0))
