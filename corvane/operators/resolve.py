"""Entity resolution and merge: candidate pairs by method, and what a merge does to edges."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# What a method's agreement is worth.
SCORES = {"normalized_name": 0.40, "alias": 0.55, "domain": 0.30, "account_handle": 0.35, "exact_identifier": 0.95}


#: Rows that meet another row at once; rows of a group that a task meets at least; pairs, and rows, that a task should be given.
STRIPE, SHARE, TASK_PAIRS, TASK_ROWS = 64, 2048, 1 << 25, 1 << 15

#: Pairs up to which rows meet in a plain join.
FEW_PAIRS = 1 << 21


def meet(rows: DataFrame, on: list[str], of: str, alike: str | None = None) -> DataFrame:
    """``rows`` with each other where they agree on ``on`` and the first's ``of`` is the lesser; of the second, names end in _2.

    What comes out may be very many times what goes in. A group's rows are ranked and packed, in stripes for the second side and
    larger packs for the first; stripes are dealt to shares of the group, which every pack is sent to, so that a large group has many tasks.
    Nothing is gathered or grouped after. Pairs come by stripe, then by first row, those with one ``alike`` together: what is written repeats itself
    every few rows and a task's values are few enough for a dictionary, so files take a fraction of a byte a pair and not several. Where there are few
    pairs (which a count of the groups tells first) rows are joined as they are.
    """
    rest = [c for c in rows.columns if c not in (*on, of)]
    held = rows.where(F.col(of).isNotNull())
    sizes = held.groupBy(*on).agg(F.count("*").alias("_n")).where("_n > 1").withColumn("_shares", F.ceil(F.col("_n") / SHARE))
    n = F.col("_n").cast("double")
    pairs, sent = sizes.agg(F.coalesce(F.sum(n * n / 2), F.lit(0.0)), F.coalesce(F.sum(n * F.col("_shares")), F.lit(0.0))).first()
    if pairs <= FEW_PAIRS:
        other = held.select(*on, *[F.col(c).alias(f"{c}_2") for c in (of, *rest)])
        return held.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism).join(other, on).where(F.col(of) < F.col(f"{of}_2"))
    tasks = int(max(4 * rows.sparkSession.sparkContext.defaultParallelism, pairs / TASK_PAIRS, sent / TASK_ROWS))
    placed = held.join(sizes, on).withColumn("_at", F.row_number().over(Window.partitionBy(*on).orderBy(of)) - 1)
    packed = lambda *names: F.sort_array(F.collect_list(F.struct(*names)))
    stripe = F.floor(F.col("_at") / STRIPE)
    stripes = placed.groupBy(*on, stripe.alias("_stripe"), (stripe % F.col("_shares")).alias("_share")).agg(packed(of, *rest).alias("_seconds"), F.max(of).alias("_last"))
    ahead = [alike] if alike else []
    packs = placed.groupBy(*on, "_shares", F.floor(F.col("_at") / SHARE)).agg(packed(*ahead, of, *[c for c in rest if c != alike]).alias("_firsts"), F.min(of).alias("_least"))
    packs = packs.select(*on, "_firsts", "_least", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_shares") - 1)).alias("_share"))
    keys = [*on, "_share"]
    met = stripes.repartition(tasks, *keys).join(packs.repartition(tasks, *keys).hint("merge"), keys).where("_least < _last")
    first = met.select(*on, "_seconds", "_last", F.explode("_firsts").alias("_first")).where(F.col(f"_first.{of}") < F.col("_last"))
    both = first.select(*on, "_first", F.explode("_seconds").alias("_second")).where(F.col(f"_first.{of}") < F.col(f"_second.{of}"))
    return both.select(*on, *[F.col(f"_first.{c}").alias(c) for c in (of, *rest)], *[F.col(f"_second.{c}").alias(f"{c}_2") for c in (of, *rest)])


def _pairs(left: DataFrame, on: list[str], differ: str | None, method: str) -> DataFrame:
    """Ordered pairs of different entities that agree on ``on``, and differ in ``differ`` if it is given; rows are distinct.

    An entity that has several of ``differ`` under one key becomes one row, which differs from all. Then only two entities that have several
    rows each can meet more than once, so only their pairs need to be made distinct.
    """
    if differ is not None:
        left = left.where(F.col(differ).isNotNull()).groupBy("entity", *on).agg(F.min(differ).alias(differ), (F.count("*") > 1).alias("many"))
    counted = left.withColumn("rows", F.count("*").over(Window.partitionBy("entity")))
    several = counted.where("rows > 1").drop("rows")
    differs = F.lit(True) if differ is None else F.col("many") | F.col("many_2") | (F.col(differ) != F.col(f"{differ}_2"))
    name = lambda met: met.select(F.col("entity").alias("a"), F.col("entity_2").alias("b"), F.lit(method).alias("method"), F.lit(SCORES[method]).alias("score"))
    once = meet(counted, on, "entity", differ).where(differs & ((F.col("rows") == 1) | (F.col("rows_2") == 1)))
    return name(once).unionByName(name(meet(several, on, "entity", differ).where(differs)).distinct())


def star_links(rows: DataFrame, on: list[str], method: str, differ: str | None = None) -> DataFrame:
    """(a, b, method, score): every entity that agrees on ``on`` with others, linked to the first of them.

    The same groups as the pairs of ``by_alias`` and its like make, in a row a member: where very many share a key, all pairs of
    them are too many to write down, and a merge needs only the group. With ``differ`` only entities that differ in that column link:
    to the first of all, and those that are like it to the first that isn't.
    """
    held = rows.select("entity", *on, *([differ] if differ else [])).distinct()
    score = F.lit(SCORES[method]).alias("score")
    if differ is None:
        first = held.groupBy(*on).agg(F.min("entity").alias("a"), F.count("*").alias("n")).where("n > 1")
        met = held.join(first, on).where(F.col("entity") > F.col("a"))
        return met.select("a", F.col("entity").alias("b"), F.lit(method).alias("method"), score).distinct()
    first = held.groupBy(*on).agg(F.min(F.struct("entity", differ)).alias("first"), F.countDistinct(differ).alias("n")).where("n > 1").drop("n")
    known = held.join(first, on)
    other = known.where(F.col(differ) != F.col(f"first.{differ}")).groupBy(*on).agg(F.min("entity").alias("second"))
    hub = F.when(F.col(differ) != F.col(f"first.{differ}"), F.col("first.entity")).otherwise(F.col("second"))
    met = known.join(other, on).select("entity", hub.alias("hub")).where("entity <> hub")
    return met.select(F.least("entity", "hub").alias("a"), F.greatest("entity", "hub").alias("b"), F.lit(method).alias("method"), score).distinct()


def by_normalized_name(entities: DataFrame) -> DataFrame:
    """Entities (entity, entity_type, name_key) of different types with one name."""
    return _pairs(entities.select("entity", "entity_type", "name_key").distinct(), ["name_key"], "entity_type", "normalized_name")


def by_alias(aliases: DataFrame) -> DataFrame:
    """Entities that share an alias (entity, alias)."""
    return _pairs(aliases.select("entity", "alias").distinct(), ["alias"], None, "alias")


def by_domain(links: DataFrame) -> DataFrame:
    """Entities that are linked to one domain (entity, domain)."""
    return _pairs(links.select("entity", "domain").distinct(), ["domain"], None, "domain")


def by_account_handle(identifiers: DataFrame) -> DataFrame:
    """Accounts with one handle on different platforms (entity, namespace, value)."""
    handles = identifiers.where(F.col("namespace").endswith("_handle")).select("entity", "namespace", "value").distinct()
    return _pairs(handles, ["value"], "namespace", "account_handle")


def identifier_conflicts(identifiers: DataFrame) -> DataFrame:
    """An identifier belongs to its first entity; each other claim is a pair with it."""
    first = identifiers.groupBy("namespace", "value").agg(F.min("entity").alias("a"))
    claims = identifiers.join(first, ["namespace", "value"]).where("entity > a")
    score = F.lit(SCORES["exact_identifier"]).alias("score")
    return claims.select("a", F.col("entity").alias("b"), F.lit("exact_identifier").alias("method"), score).distinct()


def new_candidates(found: DataFrame, stored: DataFrame) -> DataFrame:
    """Those that are not stored under their pair and method."""
    return found.dropDuplicates(["a", "b", "method"]).join(stored, ["a", "b", "method"], "left_anti")


def gate(candidates: DataFrame, merge_at: float = 0.95, review_at: float = 0.70, once: bool = False) -> DataFrame:
    """(a, b, score, decision): by the greatest score; pairs of different types always wait (column same_type).

    With ``once`` every pair is in ``candidates`` once, so they are judged as they come.
    """
    best = candidates if once else candidates.groupBy("a", "b").agg(F.max("score").alias("score"), F.min("same_type").alias("same_type"))
    decision = F.when((F.col("score") < review_at) | ~F.col("same_type"), "pending").when(F.col("score") >= merge_at, "merge").otherwise("review")
    return best.select("a", "b", "score", decision.alias("decision"))


def merge_edges(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after a merge (entity -> survivor): loops go, edges that coincide are one.

    One edge of several sums the evidence, keeps the greatest confidence and spans their time.
    """
    ends = edges
    for end in ("src", "dst"):
        into = merged.select(F.col("entity").alias(end), F.col("survivor").alias("to"))
        ends = ends.join(into, end, "left").withColumn(end, F.coalesce("to", end)).drop("to")
    return ends.where("src <> dst").groupBy("src", "edge_type", "dst").agg(
        F.sum("evidence_count").alias("evidence_count"), F.max("confidence").alias("confidence"),
        F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"),
    )


def repoint(rows: DataFrame, merged: DataFrame, column: str) -> DataFrame:
    """Rows whose ``column`` names a merged entity name its survivor."""
    into = merged.select(F.col("entity").alias(column), F.col("survivor").alias("to"))
    return rows.join(into, column, "left").withColumn(column, F.coalesce("to", column)).drop("to").select(rows.columns)


IDENTITY_TYPES = ("person", "organization", "threat_actor")


#: Vectors of a block, and pairs whose products are summed at once.
BLOCK_ROWS, EXACT_PAIRS = 2048, 1 << 15

#: Blocks of a type from which on they grow, each up to so many times BLOCK_ROWS, as a block is shuffled once for each other.
MANY_BLOCKS, BLOCK_GROWTH = 32, 8


def _packed(pdf):
    """A block's vectors as one row, in the order of their ids: a block is packed for either side of its pairs, and rows reach tasks in any order."""
    import numpy as np
    import pandas as pd

    pdf = pdf.sort_values("entity", kind="stable")
    first, vectors = pdf.iloc[0], np.stack(pdf["v"].to_numpy()).astype(np.float64)
    row = {"entity_type": first["entity_type"], "dim": vectors.shape[1], "block": int(first["block"]), "ids": pdf["entity"].tolist(), "vectors": vectors.tobytes()}
    return pd.DataFrame([row])


def _near(unit, least: float, own: bool):
    """Places of those in the first block and those in the second whose product reaches ``least``, some at a time; ``own`` if the blocks are one."""
    import numpy as np

    for a in range(0, len(unit[0]), BLOCK_ROWS):
        for b in range(a if own else 0, len(unit[1]), BLOCK_ROWS):
            near = unit[0][a : a + BLOCK_ROWS] @ unit[1][b : b + BLOCK_ROWS].T >= least
            x, y = np.nonzero(np.triu(near, 1) if own and a == b else near)
            for at in range(0, len(x), EXACT_PAIRS):
                yield x[at : at + EXACT_PAIRS] + a, y[at : at + EXACT_PAIRS] + b


def _close(least: float, best: bool, two_roots: bool = False):
    """Pairs of blocks to pairs of vectors that reach ``least``; of a block with itself each once, as both sides have one order."""

    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        for batch in batches:
            for n in range(batch.num_rows):
                value = lambda name, n=n: batch.column(name)[n]
                ids = [value("ids").values, value("other_ids").values]
                v = [np.frombuffer(value(c).as_py(), np.float64).reshape(len(i), -1) for c, i in zip(("vectors", "other_vectors"), ids)]
                # sums in order, as the column expression's
                square = [np.cumsum(x * x, axis=1)[:, -1] for x in v]
                unit = [x / np.sqrt(np.where(k > 0, k, 1))[:, None] for x, k in zip(v, square)]
                own = value("block").as_py() == value("other_block").as_py()
                for i, j in _near(unit, least - 1e-9, own):
                    norms = np.sqrt(square[0][i]) * np.sqrt(square[1][j]) if two_roots else np.sqrt(square[0][i] * square[1][j])
                    cos = np.clip(np.cumsum(v[0][i] * v[1][j], axis=1)[:, -1] / norms, -1, 1)
                    ok = cos >= least
                    arrays = [ids[0].take(pa.array(i[ok])), ids[1].take(pa.array(j[ok])), pa.array(cos[ok])]
                    if best:
                        one, two = (pd.Series(a.to_pylist(), dtype=object) for a in arrays[:2])
                        pairs = pd.DataFrame({"entity": np.maximum(one, two), "other": np.minimum(one, two), "cos": cos[ok]})
                        pairs = pairs[pairs["entity"] != pairs["other"]].sort_values(["cos", "other"], ascending=[False, True]).drop_duplicates("entity")
                        arrays = [pa.array(pairs[c].tolist(), a.type) for c, a in zip(pairs, arrays)]
                    yield pa.RecordBatch.from_arrays(arrays, names=["entity", "other", "cos"])

    return run


def _blocks(rows: DataFrame) -> DataFrame:
    """Vectors of (entity, entity_type, embedding) that are like any, packed by type, length and block; with the number of blocks."""
    v = F.col("embedding").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size(v) > 0) & F.exists(v, lambda x: x != 0)
    held = rows.where("entity IS NOT NULL AND entity_type IS NOT NULL").where(F.coalesce(usable, F.lit(False))).select("entity", "entity_type", v.alias("v"), F.size(v).alias("dim"))
    n = F.count("*")
    n_blocks = F.greatest(F.least(F.ceil(n / BLOCK_ROWS), F.lit(MANY_BLOCKS)), F.ceil(n / (BLOCK_GROWTH * BLOCK_ROWS)))
    sizes = held.groupBy("entity_type", "dim").agg(n_blocks.alias("n_blocks"))
    dealt = held.join(sizes, ["entity_type", "dim"]).withColumn("block", F.pmod(F.xxhash64("entity"), F.col("n_blocks")).cast("int"))
    kind = dict(rows.dtypes)
    blocks = dealt.select("entity_type", "dim", "block", "entity", "v").groupBy("entity_type", "dim", "block").applyInPandas(
        _packed, f"entity_type {kind['entity_type']}, dim int, block int, ids array<{kind['entity']}>, vectors binary"
    )
    return blocks.join(sizes, ["entity_type", "dim"])


def close_pairs(rows: DataFrame, least: float, best: bool = False, two_roots: bool = False) -> DataFrame:
    """(entity, other, cos) of all pairs of a type that reach ``least``, in pairs of blocks.

    A cosine is divided by one root of both squares, or with ``two_roots`` by the product of their roots, which may differ in its last bit.

    With ``best`` of each pair of blocks (and number of pairs) only the most alike earlier one of each entity comes out, the first of equally
    alike ones, so that many like entities don't write all their pairs; ``entity`` is then the later one.
    """
    kind = dict(rows.dtypes)
    blocks = _blocks(rows)
    last = (F.col("n_blocks") - 1).cast("int")
    left = blocks.withColumn("other_block", F.explode(F.sequence("block", last))).drop("n_blocks")
    right = blocks.select(
        "entity_type", "dim", F.col("block").alias("other_block"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"),
        F.explode(F.sequence(F.lit(0), F.col("block"))).alias("block"),
    )
    pairs = left.join(right, ["entity_type", "dim", "block", "other_block"])
    return pairs.mapInArrow(_close(least, best, two_roots), f"entity {kind['entity']}, other {kind['entity']}, cos double")


def close_to(rows: DataFrame, some: DataFrame, least: float) -> DataFrame:
    """(entity, other, cos) of all pairs of a type that reach ``least``, of ``rows`` with ``some``, in pairs of blocks."""
    kind = dict(rows.dtypes)
    few = _blocks(some).select("entity_type", "dim", (-1 - F.col("block")).alias("other_block"), F.col("ids").alias("other_ids"), F.col("vectors").alias("other_vectors"))
    return _blocks(rows).drop("n_blocks").join(few, ["entity_type", "dim"]).mapInArrow(_close(least, False, two_roots=True), f"entity {kind['entity']}, other {kind['entity']}, cos double")


def by_semantics(vectors: DataFrame, least: float = 0.85, others: int | None = None) -> DataFrame:
    """Pairs of (entity, entity_type, embedding) of a type by cosine. Types that tell identities are left out.

    All pairs of a type are compared, a block of vectors with a block, so tasks are even and of bounded memory; vectors that
    are null, zero or not finite, and those of other lengths, are like nothing. Only a caller who gives ``others`` gets less: each is then
    compared with that many of its type, the first by id, and links between all others are missed. No query does.
    """
    from pyspark.sql import Window

    from corvane.functions.text import cosine

    rows = vectors.where(~F.col("entity_type").isin(*IDENTITY_TYPES)).select("entity", "entity_type", "embedding")
    if others is None:
        if least <= 0:
            raise ValueError("the least cosine must be over 0")
        met = close_pairs(rows, least, two_roots=True).where(F.col("entity") != F.col("other"))
        close = met.select(F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b"), "cos")
    else:
        nth = F.row_number().over(Window.partitionBy("entity_type").orderBy("entity"))
        first = rows.withColumn("nth", nth).where(F.col("nth") <= others + 1).drop("nth")
        if least > 0:
            met = close_to(rows, first, least)
        else:  # what is like nothing counts too
            second = first.select("entity_type", F.col("entity").alias("other"), F.col("embedding").alias("v"))
            met = rows.join(second, "entity_type").select("entity", "other", cosine(F.col("embedding"), F.col("v")).alias("cos"))
        close = met.where(F.col("entity") != F.col("other")).select(F.least("entity", "other").alias("a"), F.greatest("entity", "other").alias("b"), "cos")
    kept = close.where(F.col("cos") >= least).groupBy("a", "b").agg(F.max("cos").alias("cos"))
    return kept.select("a", "b", F.lit("semantic").alias("method"), F.round(0.8 * F.col("cos"), 6).alias("score"))


def by_graph_context(neighbour_pairs: DataFrame) -> DataFrame:
    """Pairs (a, c, jaccard) of entities two hops apart that share neighbours."""
    return neighbour_pairs.select("a", F.col("c").alias("b"), F.lit("graph_context").alias("method"), F.round(0.7 * F.col("jaccard"), 6).alias("score"))


def refuse_large_merges(references: DataFrame, most: int = 100) -> DataFrame:
    """(entity, refused): entities with a list of references (entity, kind) too long to be merged safely."""
    sizes = references.groupBy("entity", "kind").agg(F.count("*").alias("n"))
    return sizes.groupBy("entity").agg((F.max("n") >= most).alias("refused"))


def merge_snapshot(edges: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges that a merge touches, as they were; what an undo puts back."""
    touched = merged.select(F.col("entity").alias("e")).union(merged.select(F.col("survivor").alias("e"))).distinct()
    by_src = edges.join(touched, edges["src"] == touched["e"], "left_semi")
    return by_src.unionByName(edges.join(touched, edges["dst"] == touched["e"], "left_semi")).distinct()


def undo_merge(now: DataFrame, snapshot: DataFrame, merged: DataFrame) -> DataFrame:
    """Edges after a merge is taken back: those of the survivor go, the snapshot's come back."""
    gone = merged.select(F.col("survivor").alias("e")).distinct()
    rest = now.join(gone, now["src"] == gone["e"], "left_anti").join(gone, now["dst"] == gone["e"], "left_anti")
    return rest.unionByName(snapshot.select(rest.columns))
