"""Operator 8, mixing sources to target weights, natively.

Every document gets a hash-random key. Keys are cut into ranges (shares) by their leading bits; the
sizes of the shares are summed and made prefix sums, and each share sorts its own keys. That is the
prefix sum over the whole source in random order, without any task that holds a whole source. The
cut at the source's budget then falls into one document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
#: No source gives more than this many times what it has.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_no, source_size, target) from (source, size): one row a source.

    Sources in code point order, null last, weigh ``weights`` in turn and share the sum of all sizes. A
    target stops at ``max_epochs`` times its source; the excess goes to the others by weight until none is
    above. That fixed point is a water level: sources are sorted by the level at which they fill up, and the
    first whose level isn't reached by what is left sets it. The windows run over one row a source, in one task: sources are kinds of
    data, and their number doesn't grow with it. Hosts, of which there may be millions, should be grouped into such kinds first.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col("source").isNull(), "source")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.pmod(F.col("source_no") - 1, F.lit(len(weights))) + 1)
    numbered = sources.withColumn("source_no", F.row_number().over(order)).withColumn("weight", weight)
    numbered = numbered.withColumn("cap", (F.col("source_size") * max_epochs).cast("double"))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), "source_no")
    below, above = by_level.rowsBetween(Window.unboundedPreceding, -1), by_level.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = F.sum("source_size").over(everything)
    left = total - F.coalesce(F.sum("cap").over(below), F.lit(0.0))
    levels = numbered.withColumn("level", left / F.sum("weight").over(above))
    reached = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct(F.col("cap") / F.col("weight"), "source_no", "level"))
    water = F.min(reached).over(everything)["level"]
    target = F.least("cap", F.coalesce(water * F.col("weight"), F.col("cap")))
    return levels.select("source", "source_no", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    keyed: bool = False,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row; ``taken`` counts words, repeats included.

    Every source is taken in as many whole epochs as its budget holds, and the rest of the budget is cut
    off the random order, so the sum of ``taken`` is the rounded target. Null texts have size 0, null
    sources are a source. Repeated rows count each; ties of key and id go by size, so reruns agree.
    An empty table gives an empty result. Only DataFrame functions are used.
    ``keyed`` adds ``row_key``, by which mixed_documents finds the row again.
    """
    row_key = [_row_key(id_col, source_col, text_col).alias("row_key")] * keyed
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *row_key)
    sized = materialise(rows, "sizes")
    targets = materialise(source_targets(sized, weights, max_epochs), "targets")
    shares = max(256, sized.count() // 50_000)
    # 60 bits of a digest that any engine has, so that SQL can state the order too
    key = F.conv(F.substring(F.md5(F.concat_ws(":", "doc_id", F.lit(seed))), 1, 15), 16, 10).cast("long")
    share = F.shiftright(F.shiftright(key, 29) * F.lit(shares), 31)
    known = sized.join(targets, sized["source"].eqNullSafe(targets["source"])).drop("source")
    dealt = known.withColumn("key", key).withColumn("share", share)
    ahead = Window.partitionBy("source_no").orderBy("share").rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("source_no", "share").agg(F.sum("size").alias("words"))
    bases = sums.select("source_no", "share", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    own = Window.partitionBy("source_no", "share").orderBy("key", "doc_id", "size")
    before = F.coalesce(F.sum("size").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ordered = dealt.withColumn("before", before).join(bases, ["source_no", "share"])
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0).cast("long")
    rest = budget - epochs * F.col("source_size") - F.col("base") - F.col("before")
    taken = epochs * F.col("size") + F.greatest(F.lit(0).cast("long"), F.least("size", rest))
    return ordered.select("doc_id", "size", "source_size", "target", taken.alias("taken"), *["row_key"] * keyed)


def _row_key(*columns: str) -> Column:
    """128 bits of a row; lengths keep what one column ends with apart from what the next begins with."""
    parts = [F.col(c).cast("string") for c in columns]
    return F.unhex(F.md5(F.concat(*[F.coalesce(F.concat(F.octet_length(p).cast("string"), F.lit(":"), p), F.lit("-")) for p in parts])))


def mixed_documents(
    docs: DataFrame,
    weights: tuple[int, ...] = (1, 2, 3),
    max_epochs: int = MAX_EPOCHS,
    seed: int = 42,
    id_col: str = "doc_id",
    source_col: str = "source",
    text_col: str = "text",
    length_col: str = "n_chars",
) -> DataFrame:
    """The mix itself, with the columns of ``docs``: a document as often as whole epochs take it.

    Of the one document of a source into which its budget's end falls, the words before the cut are taken too, joined
    by spaces. Documents of which nothing is taken are not in the mix. Rows that repeat id, source and text
    share evenly what is taken of all of them, so the mix stays within its budgets.
    """
    taken = mix(docs, weights, max_epochs, seed, id_col, source_col, text_col, keyed=True)
    taken = taken.groupBy("row_key").agg(F.sum("taken").alias("taken"), F.first("size").alias("words"), F.count("*").alias("n_rows"))
    taken = materialise(taken.where("taken > 0"), "taken")
    joined = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), _row_key(id_col, source_col, text_col).alias("row_key"))
    alone = joined.join(taken.where("n_rows = 1"), "row_key")
    # only rows that are repeated are numbered
    nth = F.row_number().over(Window.partitionBy("row_key").orderBy(F.lit(1)))
    share = F.floor(F.col("taken") / F.col("n_rows")) + (nth <= F.pmod("taken", "n_rows")).cast("long")
    # written by itself, so that where there are few or none its size is known and no text moves for it
    often = materialise(taken.where("n_rows > 1"), "repeated")
    repeated = joined.join(often, "row_key").withColumn("taken", share).where("taken > 0")
    joined = alone.unionByName(repeated)
    whole, rest = F.floor(F.col("taken") / F.col("words")).cast("int"), F.pmod("taken", "words").cast("int")
    copies = joined.select("row", rest.alias("rest"), whole.alias("whole"), F.explode(F.sequence(F.lit(1), whole + (rest > 0).cast("int"))).alias("nth"))
    words = F.array_remove(F.split(F.col(f"row.{text_col}"), r"[\x20\x09-\x0D]+"), "")
    text = F.when(F.col("nth") > F.col("whole"), F.array_join(F.slice(words, 1, F.col("rest")), " ")).otherwise(F.col(f"row.{text_col}"))
    new = {text_col: text, length_col: F.length(text).cast("long")}
    return copies.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
