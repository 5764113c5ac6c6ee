"""Operator 13, the prefix trie of conversations, by smallest-member ownership.

Every distinct prefix of turns is a node. A node is owned by the smallest conversation that starts with it, so a conversation owns a
suffix of its path: once it owns a prefix, it owns all longer ones. Texts are never compared; a prefix is known by its depth and 128 bits
that its turns' digests and places make up.

Of a node's subtree every occurrence of a turn belongs to one of the node's members, and every node to its owner, who is a member too. So
what sharing saves in a subtree is, summed over members, their tokens from that depth on less those from where they own their
path. One group-by of prefixes sums that and the leaves that members own.

No task holds a conversation or a prefix whole: running sums are cut into ranges of turns, and frequent prefixes and conversations meet
what belongs to them by broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.skew import join_counted
from corvane.session import materialise

#: Turns of one range of a conversation, and ids of one range of a node's members.
RANGE_BITS = 12
KEY = ["depth", "key_a", "key_b"]


def _running(rows: DataFrame, conv: str, by: str, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """``rows`` with running aggregates in the order of the numbers in ``by`` (null first), then ``order``.

    ``sums`` has an aggregate a column, all of sum or bit_xor. Each range of a conversation has its own window; what comes before a
    range is added to it.
    """
    ranged = rows.withColumn("range", F.coalesce(F.shiftright(by, RANGE_BITS), F.lit(-(1 << 62))))
    own = Window.partitionBy(conv, "range").orderBy(F.col(by).asc_nulls_first(), *order).rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(conv).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    joined = {c: _again(c, F.col(f"whole_{c}")) for c in sums}
    whole = ranged.groupBy(conv, "range").agg(*[a.alias(f"whole_{c}") for c, a in sums.items()])
    before = whole.select(conv, "range", F.row_number().over(Window.partitionBy(conv).orderBy("range")).alias("nth"), *[joined[c].over(ahead).alias(f"base_{c}") for c in sums])
    before = materialise(before.where("nth > 1").drop("nth"), "ranges")  # none of a conversation that is one range
    here = ranged.select("*", *[a.over(own).alias(f"own_{c}") for c, a in sums.items()]).join(before, [conv, "range"], "left")
    zero = F.lit(0).cast("long")
    added = {c: _joined(c, F.col(f"own_{c}"), F.coalesce(f"base_{c}", zero)) for c in sums}
    return here.select(*rows.columns, *[x.alias(c) for c, x in added.items()])


def _again(name: str, whole: Column) -> Column:
    return F.bit_xor(whole) if name.startswith("key_") else F.sum(whole)


def _joined(name: str, a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b) if name.startswith("key_") else a + b


def numbered_turns(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(conv_id, pos, digest, size): the turns of every conversation from 1 on, as digests of role and text; size is the text's code points.

    Null turns come first; turns with one number are in the order of their digests (MD5 of the role's bytes, ``:``, role and text). Null roles
    and texts are empty. Rows without a conversation take no part; repeated rows are turns each.
    """
    role, text = F.coalesce(F.col(role_col), F.lit("")), F.coalesce(F.col(text_col), F.lit(""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("long").alias("conv_id"),
        F.col(turn_col).cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))).alias("digest"),
        F.char_length(text).cast("long").alias("size"),
    )
    rows = materialise(rows, "turns")
    return _running(rows, "conv_id", "turn", [F.col("digest")], {"pos": F.count("*")}).select("conv_id", "pos", "digest", "size")


def with_shared_heads(turns: DataFrame, group: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, size), (conv_id, n_turns)) of conversations that begin like the first one of their group.

    Conversation c takes the first h turns of conversation c - c % group (all it has, if fewer; none, if it isn't there), where h is
    CRC-32 of its decimal id modulo ``most``, and then its own turns after its first h. All that are there are in the second table, those
    that have no turn left too. A group's first turns are met by at most ``group`` conversations.
    """
    counted = materialise(turns.groupBy("conv_id").agg(F.count("*").alias("n")), "conversations")
    c = F.col("conv_id")
    plan = counted.select("conv_id", "n", (c - c % group).alias("base"), (F.crc32(c.cast("string")) % most).alias("h"))
    bases = counted.where(c % group == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    plan = plan.join(bases, "base", "left").withColumn("k", F.least("h", F.coalesce("n_base", F.lit(0).cast("long")))).drop("n_base")
    plan = materialise(plan, "plan")
    first = turns.where((c % group == 0) & (F.col("pos") < most)).withColumnRenamed("conv_id", "base")
    heads = first.join(plan.select("conv_id", "base", "k"), "base").where("pos <= k").select("conv_id", F.col("pos").alias("depth"), "digest", "size")
    own = join_counted(turns, plan.select("conv_id", "h", "k", "n"), "conv_id", "n", _size(turns)).where("pos > h")
    tails = own.select("conv_id", (F.col("k") + F.col("pos") - F.col("h")).alias("depth"), "digest", "size")
    lengths = plan.select("conv_id", (F.col("k") + F.greatest(F.lit(0).cast("long"), F.col("n") - F.col("h"))).alias("n_turns"))
    return heads.unionByName(tails), lengths


def _size(df: DataFrame) -> int:
    return df.count()


def prefix_trie(turns: DataFrame, lengths: DataFrame) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    ``turns`` is (conv_id, depth, digest, size) with depths from 1 on without a gap, ``lengths`` is (conv_id, n_turns) of all conversations, those without
    turns too. A node's conv_id is its smallest member, so (conv_id, depth) names it. No conversation gives no node.

    Ownership is found by a grouped minimum that is joined back: a window over a prefix would hold all members of a frequent one in one
    task. Only ends_sha256 reads the ids of one node's ends in one task, as SHA-256 must; it streams them, in ranges that were joined before.
    """
    place = lambda salt: F.xxhash64(F.lit(salt), "depth", "digest")
    rows = turns.select("conv_id", "depth", "size", place(1).alias("own_a"), place(2).alias("own_b"))
    paths = _running(
        rows, "conv_id", "depth", [], {"key_a": F.bit_xor("own_a"), "key_b": F.bit_xor("own_b"), "tokens": F.sum("size")}
    )
    zero = F.lit(0).cast("long")
    paths = paths.select(
        "conv_id", *KEY, F.col("key_a").bitwiseXOR(F.col("own_a")).alias("up_a"), F.col("key_b").bitwiseXOR(F.col("own_b")).alias("up_b"),
        (F.col("tokens") - F.col("size")).alias("before"), "tokens",
    )
    roots = lengths.select("conv_id", *[zero.alias(x) for x in (*KEY, "up_a", "up_b", "before", "tokens")])
    paths = materialise(paths.unionByName(roots), "paths")
    n_rows = _size(paths)
    lengths = materialise(lengths, "lengths")

    nodes = paths.groupBy(*KEY).agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b"))
    nodes = materialise(nodes.withColumn("node", F.struct(*KEY)), "nodes")
    above = F.struct((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("key_a"), F.col("up_b").alias("key_b"))
    children = materialise(nodes.where("depth > 0").groupBy(above.alias("node")).agg(F.count("*").alias("n_children")), "children")

    owners = join_counted(paths.withColumn("node", F.struct(*KEY)), nodes.select("node", "owner", "n_convs"), "node", "n_convs", n_rows)
    mine = F.col("owner") == F.col("conv_id")
    # where a conversation's own suffix begins, and how many tokens it has
    suffixes = owners.groupBy("conv_id").agg(
        F.min(F.when(mine, F.struct("depth", "before"))).alias("first"), F.max(F.struct("depth", mine.alias("mine"), "node")).alias("last"), F.max("tokens").alias("tokens")
    )
    ends = suffixes.select("conv_id", F.coalesce("first.before", "tokens").alias("owned_from"), F.col("last.mine").alias("mine"), F.col("last.node").alias("node"))
    ends = materialise(ends, "ends")
    many = children.where(F.col("n_children") > 0).select("node").withColumn("inner", F.lit(True))
    leaves = ends.where("mine").join(many, "node", "left").select("conv_id", F.when(F.col("inner"), 0).otherwise(1).cast("long").alias("leaf"))
    known = ends.select("conv_id", "owned_from").join(leaves, "conv_id", "left").join(lengths, "conv_id")
    known = materialise(known.withColumn("n_rows", F.col("n_turns") + 1), "known")

    told = join_counted(paths, known.select("conv_id", "owned_from", "leaf", "n_rows"), "conv_id", "n_rows", n_rows)
    saved = F.greatest(zero, F.col("owned_from") - F.col("before"))
    sums = told.groupBy(*KEY).agg(F.sum(F.coalesce("leaf", zero)).alias("n_leaves"), F.sum(saved).alias("saved_tokens"))
    whole = nodes.join(sums, KEY).join(children, "node", "left").join(_ends_digests(ends), "node", "left")
    parents = nodes.join(children, "node").select(F.col("node").alias("above"), F.col("owner").alias("parent_conv_id"), "n_children")
    parents = materialise(parents, "parents")
    whole = whole.withColumn("n_children", F.coalesce("n_children", zero)).withColumnRenamed("n_children", "n_below").withColumn("above", above)
    whole = materialise(whole, "whole")
    below = join_counted(whole.where("depth > 0"), parents, "above", "n_children", _size(nodes))
    out = ["owner", "depth", "parent_conv_id", "n_convs", "n_below", "n_leaves", "saved_tokens", "ends_sha256"]
    both = below.select(*out).unionByName(whole.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long")).select(*out))
    digest = F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")
    return both.select(F.col("owner").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.col("n_below").alias("n_children"), "n_leaves", "saved_tokens", digest)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) of the conversations that end at a node.

    Ids are joined in ranges of 4096 first, so a range is bounded; a node's ranges are then hashed as they stream by.
    """
    ranges = ends.groupBy("node", F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")), ",").alias("ids"))
    keyed = ranges.select(*[F.col(f"node.{k}").alias(k) for k in KEY], "range", "ids").repartition(*KEY).sortWithinPartitions(*KEY, "range")
    hashed = keyed.mapInArrow(_hashed, "depth long, key_a long, key_b long, ends_sha256 string")
    return hashed.select(F.struct(*KEY).alias("node"), "ends_sha256")


def _hashed(batches):
    import hashlib

    import pyarrow as pa

    now, state = None, None
    names = [*KEY, "ends_sha256"]
    for b in batches:
        done = []
        for *key, ids in zip(*[b.column(k).to_pylist() for k in KEY], b.column("ids").to_pylist()):
            if key != now:
                if now:
                    done.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=names)
    if now:
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*now, state.hexdigest())], names=names)
