"""Bounded traversal of entity graphs: neighbours, relationships, shortest paths, walks, upserts.

Edges are (edge_id, src, dst, edge_type, confidence, first_seen, last_seen) and are walked both ways. Filters hold for
every edge on the way, the filter on node types only for its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.session import materialise

MAX_HOPS = 10


def edge_filter(edges: DataFrame, types=None, least_confidence=None, time_range=None) -> DataFrame:
    """Edges of some types, of a confidence, whose time overlaps a closed range; what isn't set doesn't filter."""
    if types:
        edges = edges.where(F.col("edge_type").isin(*types))
    if least_confidence is not None:
        edges = edges.where(F.col("confidence") >= least_confidence)
    if time_range is not None:
        lo, hi = time_range
        if lo is None or hi is None or lo > hi:
            raise ValueError("a time range needs both ends in order")
        edges = edges.where((F.col("first_seen") <= F.lit(hi)) & (F.col("last_seen") >= F.lit(lo)))
    return edges


def both_ways(edges: DataFrame) -> DataFrame:
    forth = edges.select("edge_id", F.col("src").alias("a"), F.col("dst").alias("b"))
    return forth.unionByName(edges.select("edge_id", F.col("dst").alias("a"), F.col("src").alias("b")))


def distances(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, node, hop): every node within ``hops`` of each start (a column ``node``), with its distance.

    A join of the frontier a hop, what was seen is taken out by an anti join, and each hop is written to the shared
    folder, so a lost executor costs one hop. It ends with the frontier.
    """
    if not 0 <= hops <= MAX_HOPS:
        raise ValueError(f"hops must be within 0 and {MAX_HOPS}")
    ways = both_ways(edges)
    seen = materialise(starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("hop")).distinct(), "hop")
    frontier = seen
    for hop in range(1, hops + 1):
        reached = frontier.select("start", F.col("node").alias("a")).join(ways.select("a", "b"), "a").select("start", F.col("b").alias("node")).distinct()
        frontier = materialise(reached.join(seen, ["start", "node"], "left_anti").withColumn("hop", F.lit(hop)), "hop")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def neighbours(edges: DataFrame, starts: DataFrame, hops: int, nodes: DataFrame | None = None, node_types=None) -> DataFrame:
    """(start, node): distinct nodes within ``hops``, the start itself excluded."""
    found = distances(edges, starts, hops).where("node <> start").select("start", "node")
    if node_types:
        found = found.join(nodes.where(F.col("node_type").isin(*node_types)).select("node"), "node", "left_semi")
    return found


def neighbourhood_edges(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, edge_id): distinct edges on walks of at most ``hops`` from each start."""
    if hops < 1:
        return starts.limit(0).select(F.col("node").alias("start")).join(edges.select("edge_id").limit(0))
    inner = distances(edges, starts, hops - 1)
    return inner.select("start", F.col("node").alias("a")).join(both_ways(edges), "a").select("start", "edge_id").distinct()


def shortest_path_lengths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(start, end, hops): hops of a shortest path of each pair; null if there is none within ``max_hops``."""
    found = distances(edges, pairs.select(F.col("start").alias("node")), max_hops)
    ends = found.select("start", F.col("node").alias("end"), F.col("hop").alias("hops"))
    return pairs.join(ends, ["start", "end"], "left").select("start", "end", "hops")


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_hops: int = MAX_HOPS) -> DataFrame:
    """(start, end, path): one shortest path of each pair as an array of nodes, the least in node order."""
    found = materialise(distances(edges, pairs.select(F.col("start").alias("node")), max_hops), "hops")
    lengths = found.select("start", F.col("node").alias("end"), F.col("hop").alias("left"))
    walk = pairs.join(lengths, ["start", "end"]).select("start", "end", "left", F.array("end").alias("path"))
    ways = both_ways(edges).select("a", "b").distinct()
    for _ in range(max_hops):
        head = walk.where("left > 0").withColumn("b", F.element_at("path", 1)).join(ways, "b")
        closer = found.select("start", F.col("node").alias("a"), (F.col("hop") + 1).alias("left"))
        step = head.join(closer, ["start", "a", "left"]).groupBy("start", "end").agg(F.min(F.struct("a", "left", "path")).alias("s"))
        step = step.select("start", "end", (F.col("s.left") - 1).alias("left"), F.concat(F.array("s.a"), "s.path").alias("path"))
        walk = materialise(step.unionByName(walk.where("left = 0")), "walk")
        if walk.where("left > 0").isEmpty():
            break
    return pairs.join(walk.select("start", "end", "path"), ["start", "end"], "left")


def bounded_walks(edges: DataFrame, starts: DataFrame, hops: int, most: int = 256) -> DataFrame:
    """(start, node, edges): walks of up to ``hops`` edges that use no edge twice, at most ``most`` a start (in edge order)."""
    from pyspark.sql import Window

    ways = both_ways(edges)
    now = starts.select(F.col("node").alias("start"), "node", F.array().cast("array<string>").alias("edges"))
    found = None
    nth = F.row_number().over(Window.partitionBy("start").orderBy(F.size("edges"), "edges"))
    for _ in range(hops):
        step = now.join(ways, now["node"] == ways["a"]).where(~F.array_contains("edges", F.col("edge_id").cast("string")))
        step = step.select("start", F.col("b").alias("node"), F.concat("edges", F.array(F.col("edge_id").cast("string"))).alias("edges"))
        now = materialise(step.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth"), "walks")
        found = now if found is None else found.unionByName(now)
    return found.withColumn("nth", nth).where(F.col("nth") <= most).drop("nth")


def upsert_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Edges by (src, dst, edge_type): on a match confidence and last_seen are the new ones, first_seen stays."""
    key = ["src", "dst", "edge_type"]
    o, n = old.alias("o"), new.alias("n")
    pick = lambda c, first, second: F.coalesce(f"{first}.{c}", f"{second}.{c}").alias(c)
    on = [F.col(f"o.{k}") == F.col(f"n.{k}") for k in key]
    return o.join(n, on, "full").select(
        *[pick(k, "o", "n") for k in key], pick("confidence", "n", "o"), pick("first_seen", "o", "n"), pick("last_seen", "n", "o")
    )


def without_nodes(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges that are left when ``nodes`` go."""
    gone = nodes.select("node")
    return edges.join(gone, edges["src"] == gone["node"], "left_anti").join(gone, edges["dst"] == gone["node"], "left_anti")


def without_edges(edges: DataFrame, gone: DataFrame, key: list[str]) -> DataFrame:
    return edges.join(gone.select(*key), key, "left_anti")


def apply_changes(edges: DataFrame, changed: DataFrame, canonical: DataFrame, key: list[str]) -> DataFrame:
    """``edges`` after a batch of changes, which say only what to read again (``key``): what canonical rows hold is put, what they no longer hold goes."""
    touched = changed.select(*key).distinct()
    return without_edges(edges, touched, key).unionByName(canonical.select(edges.columns).join(touched, key, "left_semi"))


def inside(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges both of whose ends are among ``nodes``."""
    ids = nodes.select("node")
    return edges.join(ids, edges["src"] == ids["node"], "left_semi").join(ids, edges["dst"] == ids["node"], "left_semi")


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets; 0 if both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both > 0, F.size(F.array_intersect(a, b)) / both).otherwise(0.0)


#: Neighbours of a node whose whole list goes to its tasks, elements by which two nodes are told apart, nodes of a block, and rows or pairs at once.
SMALL, DEPTH, BLOCK, AT_ONCE = 64, 4, 1 << 15, 1 << 20


def _runs(key):
    """(start, size) of runs of equal values."""
    import numpy as np

    start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return start, np.diff(np.r_[start, len(key)])


def _pieces(costs, most: int):
    """Slices of consecutive items whose costs add up to about ``most``."""
    import numpy as np

    total = np.cumsum(costs)
    cuts = np.unique(np.r_[0, np.searchsorted(total, np.arange(most, (total[-1] if len(total) else 0) + 1, most), "right"), len(costs)])
    return list(zip(cuts[:-1], cuts[1:]))


def _spread(counts):
    """Of each item repeated by its count: the item's number, and which repetition it is."""
    import numpy as np

    item = np.repeat(np.arange(len(counts)), counts)
    return item, np.arange(len(item)) - np.repeat(np.cumsum(counts) - counts, counts)


def _similar(least: float):
    """Pairs of nodes that have an element in common and reach ``least``, over rows sorted by element and pair of blocks.

    A pair is found by its first common elements in order and nowhere else, so it comes out once in all tasks. Where many nodes share an element they are
    told apart by the next one, up to as many as a pair of their sizes must share at least, or until comparing them costs less.
    """

    def pairs_of(batch):
        import numpy as np

        column = lambda c: batch.column(c).to_numpy()
        x, n, own, block, other = (column(c) for c in ("x", "n", "own", "block", "other"))
        lists = batch.column("near").combine_chunks()
        values, rank = np.unique(lists.flatten().to_numpy(), return_inverse=True)
        begin, wide = np.cumsum(n) - n, len(values) + 1
        held = np.repeat(np.arange(len(x)), n) * wide + rank
        at = np.searchsorted(held, np.arange(len(x)) * wide + np.searchsorted(values, column("y"))) - begin + 1
        groups = np.cumsum(np.r_[False, (np.diff(column("y")) != 0) | (np.diff(block) != 0) | (np.diff(other) != 0)])
        needed = lambda size: np.maximum(np.ceil(size * (least / (1 + least)) - 1e-9), 1).astype(np.int64)
        fewest = needed(n + np.ceil(n * least - 1e-9))
        most = needed(n + np.floor(n / least + 1e-9)) if least > 0 else np.full(len(n), SMALL)
        out = []

        def compare(who, pos, start, size, told, depth):
            each, nth = _spread(size)
            row = start[each] + nth
            follow = size[each] - 1 - nth
            for lo, hi in _pieces(follow, AT_ONCE):
                p, q = _spread(follow[lo:hi])
                first = row[lo:hi][p]
                second = first + q + 1
                i, j, pi, pj = who[first], who[second], pos[first], pos[second]
                must = needed(n[i] + n[j])
                ok = (np.minimum(must, DEPTH) == told) & (depth + np.minimum(n[i] - pi, n[j] - pj) >= must) & (np.minimum(n[i], n[j]) >= np.maximum(n[i], n[j]) * least - 1e-9)
                ok &= (block[i] == other[i]) | (own[i] != own[j])
                i, j, pi, must = i[ok], j[ok], pi[ok], must[ok]
                for lo2, hi2 in _pieces(n[i], 4 * AT_ONCE):
                    a, b, upto = i[lo2:hi2], j[lo2:hi2], pi[lo2:hi2]
                    pair, place = _spread(n[a])
                    asked = b[pair] * wide + rank[begin[a][pair] + place]
                    hit = held[np.minimum(np.searchsorted(held, asked), len(held) - 1)] == asked
                    shared = np.bincount(pair[hit], minlength=len(a))
                    before = np.bincount(pair[hit & (place < upto[pair])], minlength=len(a))
                    good = (shared / (n[a] + n[b] - shared) >= least) & (before == depth)
                    out.append((x[a[good]], x[b[good]], n[a[good]], n[b[good]], shared[good]))

        def walk(group, who, pos, reach, told, depth):
            order = np.argsort(group, kind="stable")
            group, who, pos = group[order], who[order], pos[order]
            start, size = _runs(group)
            more = np.maximum(reach[who] + depth + 1 - pos, 0)
            cost = np.add.reduceat(more, start) if len(start) else more
            direct = (size > 1) & ((depth == told) | (size * (size - 1) // 2 <= 4 * cost))
            compare(who, pos, start[direct], size[direct], told, depth)
            deeper = (size > 1) & ~direct
            start, size, cost = start[deeper], size[deeper], cost[deeper]
            for lo, hi in _pieces(cost, AT_ONCE):
                run, nth = _spread(size[lo:hi])
                row = start[lo:hi][run] + nth
                old, step = _spread(more[row])
                w, new = who[row][old], pos[row][old] + step + 1
                walk(run[old] * wide + rank[begin[w] + new - 1], w, new, reach, told, depth + 1)

        for told in range(1, DEPTH + 1):
            reach = n - np.maximum(fewest, told)
            mine = np.flatnonzero((np.minimum(fewest, DEPTH) <= told) & (np.minimum(most, DEPTH) >= told) & (at <= reach + 1))
            if len(mine):
                walk(groups[mine], mine, at[mine], reach, told, 1)
        return out

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def found(table):
            names = ("x", "z", "n", "m", "shared")
            for part in pairs_of(table):
                yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in part], names=names)

        rest, held = [], 0
        for batch in batches:
            rest.append(batch)
            held += batch.num_rows
            if held < BLOCK:
                continue
            table = pa.Table.from_batches(rest)
            key = [table.column(c).to_numpy() for c in ("y", "block", "other")]
            last = int(np.flatnonzero(np.logical_or.reduce([k != k[-1] for k in key]))[-1:].sum() + 1) if any((k != k[-1]).any() for k in key) else 0
            if last:
                yield from found(table.slice(0, last))
                table = table.slice(last)
            rest, held = table.to_batches(), table.num_rows
        if held:
            yield from found(pa.Table.from_batches(rest))

    return run


def neighbour_jaccard(edges: DataFrame, least: float = 0.5, most: int | None = None) -> DataFrame:
    """(a, c, jaccard): pairs a < c two hops apart, with no edge of their own, by the share of neighbours in common.

    Two sets that reach ``least`` are of sizes within that ratio, and share one of the first members of each in any fixed order, as many as
    could be missing and one more; k of them, if so many must be shared, within k - 1 members more. With the rarest first a hub is among them only for nodes with
    little else. Nodes of up to SMALL neighbours meet at such a member with all of their neighbours at hand, where very many have it in pairs of blocks,
    and are told apart there (``_similar``), so what is shuffled is links and pairs that reach ``least``. Pairs with a larger node meet by one member each: what
    two share of their first members is counted, after the last of these they can share no more than either has left, and only pairs that may still
    reach ``least`` are counted exactly. With ``most`` only pairs that are among the first so many in id order of a node come out.
    """
    from pyspark.sql import Window

    from corvane.operators.dedup import ranked_by_id

    links = materialise(both_ways(edges).select("a", "b").where("a IS NOT NULL AND b IS NOT NULL").distinct(), "links")
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    # numbered by rarity, so numbers are in the order of members
    nodes = materialise(ranked_by_id(degree.withColumn("place", F.struct("n", "a")), "place").select("a", "n", F.col("rank").cast("long").alias("id")), "nodes")
    ends = links.join(nodes.select("a", "n", F.col("id").alias("x")), "a").join(nodes.select(F.col("a").alias("b"), F.col("n").alias("popular"), F.col("id").alias("y")), "b")
    ends = materialise(ends.select("x", "n", "y", "popular"), "ends")
    # the margin keeps a pair that is at the bound but for rounding
    needed = lambda size: F.greatest(F.ceil(size * (least / (1 + least)) - 1e-9), F.lit(1))

    sets = ends.where(F.col("n") <= SMALL).groupBy("x", "n").agg(F.sort_array(F.collect_list(F.struct("y", "popular"))).alias("s"))
    kept = F.slice("s", F.lit(1), (F.col("n") - F.greatest(F.ceil(F.col("n") * least - 1e-9), F.lit(1)) + 1).cast("int"))
    each = sets.select("x", "n", F.col("s.y").alias("near"), F.explode(kept).alias("f")).select("x", "n", "near", "f.y", F.ceil(F.col("f.popular") / BLOCK).alias("blocks")).where("f.popular > 1")
    own = F.pmod(F.xxhash64("x"), F.col("blocks"))
    dealt = each.withColumn("own", own).withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("y", F.least("own", "with").alias("block"), F.greatest("own", "with").alias("other"), "own", "x", "n", "near")
    pairs = dealt.repartition("y", "block", "other").sortWithinPartitions("y", "block", "other").mapInArrow(_similar(least), "x long, z long, n long, m long, shared long")

    sized = ends.where(F.col("n") >= SMALL * least - 1e-9).withColumn("nth", F.row_number().over(Window.partitionBy("x").orderBy("y")))
    first = materialise(sized.where(F.col("nth") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1).select("x", "y", "n", "nth"), "first-links")
    other = first.select(F.col("x").alias("z"), "y", F.col("n").alias("m"), F.col("nth").alias("mth"))
    # of two nodes the larger one, whose number is greater, is x
    alike = (F.col("m") >= F.col("n") * least - 1e-9) & (F.col("x") > F.col("z"))
    met = first.where(F.col("n") > SMALL).join(other, "y").where(alike).groupBy("x", "z", "n", "m").agg(F.count("*").alias("shared"), F.max("nth").alias("i"), F.max("mth").alias("j"))
    met = met.where(F.col("shared") + F.least(F.col("n") - F.col("i"), F.col("m") - F.col("j")) >= needed(F.col("n") + F.col("m"))).select("x", "z", "n", "m")
    near = ends.select("x", "y")
    both = met.join(near, "x").join(near.select(F.col("x").alias("z"), "y"), ["z", "y"])
    pairs = pairs.unionByName(both.groupBy("x", "z", "n", "m").agg(F.count("*").alias("shared")))

    score = F.col("shared") / (F.col("n") + F.col("m") - F.col("shared"))
    scored = pairs.select("x", "z", score.alias("jaccard")).where(F.col("jaccard") >= least).join(near.select("x", F.col("y").alias("z")), ["x", "z"], "left_anti")
    named = scored.join(nodes.select(F.col("id").alias("x"), "a"), "x").join(nodes.select(F.col("id").alias("z"), F.col("a").alias("c")), "z")
    found = named.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c"), "jaccard")
    if most is not None:
        found = materialise(found, "pairs")
        sides = found.select("a", "c").unionByName(found.select(F.col("c").alias("a"), F.col("a").alias("c")))
        kept = sides.withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("c"))).where(F.col("nth") <= most)
        found = found.join(kept.select(F.least("a", "c").alias("a"), F.greatest("a", "c").alias("c")).distinct(), ["a", "c"], "left_semi")
    return found


def export_walk(edges: DataFrame, starts: DataFrame, depth: int, merged: DataFrame, per_node: int = 100, most: int = 10_000) -> DataFrame:
    """(node, hop): entities to export: breadth first over at most ``per_node`` edges a node, merged ones left out."""
    from pyspark.sql import Window

    gone = merged.select(F.col("entity").alias("node"))
    ways = both_ways(edges).join(gone.select(F.col("node").alias("b")), "b", "left_anti")
    nth = F.row_number().over(Window.partitionBy("a").orderBy("edge_id"))
    ways = materialise(ways.withColumn("nth", nth).where(F.col("nth") <= per_node).select("a", "b"), "ways")
    seen = materialise(starts.select("node").distinct().join(gone, "node", "left_anti").withColumn("hop", F.lit(0)), "export")
    frontier = seen
    for hop in range(1, depth + 1):
        reached = frontier.join(ways, frontier["node"] == ways["a"]).select(F.col("b").alias("node")).distinct()
        frontier = materialise(reached.join(seen, "node", "left_anti").withColumn("hop", F.lit(hop)), "export")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.orderBy("hop", "node").limit(most)


def source_expansion(found: DataFrame, sources: DataFrame, cap: int, score: float = 0.4) -> DataFrame:
    """(collection, method, id, score): candidates of a run, those of the graph (collection, id, score) before those by source (collection, id).

    A collection takes at most ``cap`` in all, which is its budget: sources come in as far as the graph leaves room. The first by id
    are taken of each.
    """
    from pyspark.sql import Window

    both = found.select("collection", F.lit("graph_expansion").alias("method"), "id", F.col("score").cast("double"), F.lit(0).alias("later"))
    both = both.unionByName(sources.select("collection", F.lit("source_expansion").alias("method"), "id", F.lit(score).alias("score"), F.lit(1).alias("later")))
    nth = F.row_number().over(Window.partitionBy("collection").orderBy("later", "id"))
    return both.withColumn("nth", nth).where(F.col("nth") <= cap).select("collection", "method", "id", "score")
