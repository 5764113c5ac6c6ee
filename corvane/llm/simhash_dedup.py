"""Operator 7, SimHash near-dedup, by meet-in-the-middle ball hashing.

Two fingerprints within the radius have a value in common that is within half the radius of both. So every
distinct fingerprint emits all values of its ball of half the radius, equal values meet in a shuffle, and
those that meet are verified. A value meets at most as many distinct fingerprints as its own ball
holds, however many documents share them.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.components import connected_components
from corvane.session import materialise

BITS = 64


def _fingerprints(shingle: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        def one(text):
            words = text.encode().lower().split()  # bytes: A-Z only, and white space as in the contract
            if not words:
                return 0
            k = min(shingle, len(words))
            whole = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
            starts = np.concatenate(([0], ends[:-1] + 1))
            n = len(words) - k + 1
            hashes = np.fromiter((xxh64_intdigest(whole[s:e], 42) for s, e in zip(starts[:n].tolist(), ends[k - 1 :].tolist())), np.uint64, n)
            ones = np.zeros(BITS, np.int64)
            for at in range(0, n, 65536):
                part = hashes[at : at + 65536]
                ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])

        for b in batches:
            prints = [one(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(prints, pa.int64())], names=["doc_id", "print"])

    return run


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, print): the 64-bit SimHash of every row; 0 for null texts and texts without a word."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "doc_id long, print long")


def ball_masks(half: int) -> list[int]:
    """Every 64-bit pattern with at most ``half`` bits set, as signed values."""
    masks = [sum(1 << i for i in bits) for n in range(half + 1) for bits in combinations(range(BITS), n)]
    return [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]


def near_links(prints: DataFrame, radius: int = 2) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that are within ``radius``.

    Not every pair is emitted: each value of a ball links what meets there to the smallest of it. With an
    even radius all that meet are within the radius of each other; with an odd one those that are not
    are verified away, so pairs come from all that meet (their number is bounded by the ball).
    """
    half = (radius + 1) // 2
    masks = F.array(*[F.lit(m).cast("long") for m in ball_masks(half)])
    met = prints.select("print", F.explode(F.transform(masks, lambda m: F.col("print").bitwiseXOR(m))).alias("variant"))
    if radius % 2 == 0:
        first = F.min("print").over(Window.partitionBy("variant"))
        pairs = met.select(F.col("print").alias("a"), first.alias("b")).where(F.col("a") > F.col("b"))
    else:
        own = met.groupBy("variant").agg(F.sort_array(F.collect_set("print")).alias("all")).where(F.size("all") > 1)
        each = own.select(F.posexplode("all").alias("i", "a"), "all")
        pairs = each.select("a", F.explode(F.slice("all", 1, F.col("i"))).alias("b"))
    return pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def near_duplicates(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row; component_id is the smallest doc_id reachable.

    Rows with a null id take part under the null id. Repeated rows come out as often as they went in; an empty
    table gives an empty result. Only distinct fingerprints are compared, so a group of copies costs
    one of them; documents meet their component in joins on the fingerprint that AQE can split.
    """
    docs_prints = materialise(fingerprints(docs, shingle, id_col, text_col), "prints")
    distinct = materialise(docs_prints.groupBy("print").agg(F.min("doc_id").alias("first_doc")), "distinct-prints")
    roots = connected_components(near_links(distinct, radius)).select(F.col("node").alias("print"), "root")
    placed = distinct.join(roots, "print", "left").select("print", "first_doc", F.coalesce("root", "print").alias("root"))
    components = placed.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    by_print = placed.join(components, "root").select("print", "component_id")
    return docs_prints.join(by_print, "print").select(
        "doc_id", F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id"
    )


def first_of_each_group(
    docs: DataFrame, radius: int = 2, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``docs`` with the smallest doc_id of each group of near-duplicates; rows that repeat it in id and text are one.

    Which ids go, and whether rows repeat those that stay, is found from ids alone. Only what goes or is repeated is written and
    joined with the texts: where that is small, as its size as a table tells, no text moves; where it isn't, texts travel once.
    Only rows with a repeated id are compared by a digest of their text.
    """
    groups = near_duplicates(docs, radius, shingle, id_col, text_col)
    ids = groups.groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"), F.count("*").alias("n_rows"))
    marked = materialise(ids.where("NOT stays OR n_rows > 1"), "marked")
    often = materialise(marked.where("stays").select("doc_id"), "repeated")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("id"))
    alone = rows.join(marked.select("doc_id"), rows["id"].eqNullSafe(F.col("doc_id")), "left_anti")
    repeated = rows.join(often, rows["id"].eqNullSafe(often["doc_id"]), "left_semi")
    alike = Window.partitionBy("id", F.md5(F.col(f"row.{text_col}"))).orderBy(F.lit(1))
    repeated = repeated.withColumn("nth", F.row_number().over(alike)).where("nth = 1")
    return alone.select("row.*").unionByName(repeated.select("row.*"))
