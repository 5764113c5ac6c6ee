"""Operator 2, exact top-k search, by multi-resolution segment statistics.

A vector is cut into equal segments; their means and deviations bound distances from below: over a segment of
length n, |q - c|^2 >= n * ((mean_q - mean_c)^2 + (dev_q - dev_c)^2). As n * (mean^2 + dev^2) is the segment's own square, that
bound is |q|^2 + |c|^2 - 2 * (a . b) with a and b the scaled means and deviations, so a . b bounds the inner product from
above. Bounds are taken from one segment up to many, each on what the last has left, and the survivors' products
are computed exactly in integers. What a query must reach is first set over one block for all of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.session import materialise

#: Rows of a candidate and of a query block. Candidates travel once a query block, queries once a candidate block.
CANDIDATE_BLOCK, QUERY_BLOCK = 8192, 4096
#: Queries of a block that are looked at at once: memory of a task is about this times a candidate block, in doubles.
TILE = 256
#: Pairs whose exact products are computed at once.
EXACT_PAIRS = 1 << 16
BLOCK = "dim int, n int, width int, ids binary, vectors binary"
HITS = "query_id long, vec_id long, score long"


def _needed(vectors, ids, k: int):
    """Rows that may be among the k best of some query: of equal vectors only few matter, whatever id the query excludes.

    Rows are in order of their ids. Of one id and vector k rows matter. Of equal vectors a row matters if fewer than k before it are left
    when the id that most of them have is excluded.
    """
    import numpy as np
    import pandas as pd

    _, group = np.unique(vectors, axis=0, return_inverse=True)
    rows = pd.DataFrame({"group": group.ravel(), "id": ids, "at": np.arange(len(ids))})
    rows = rows[rows.groupby(["group", "id"]).cumcount() < k]
    run = rows.groupby(["group", "id"]).cumcount() + 1
    longest = run.groupby(rows["group"]).cummax().groupby(rows["group"]).shift(fill_value=0)
    return rows["at"].to_numpy()[(rows.groupby("group").cumcount() - longest < k).to_numpy()]


def _packed(part: str, k: int | None):
    """Pack a block's vectors into one row, in the narrowest integers; with ``k`` only those that matter to a search."""

    def run(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values("vec_id", kind="stable")
        vectors, ids = np.stack(pdf["v"].to_numpy()).astype(np.int64), pdf["vec_id"].to_numpy(np.int64)
        if k:
            kept = _needed(vectors, ids, k)
            vectors, ids = vectors[kept], ids[kept]
        width = next(w for w in (2, 4, 8) if w == 8 or np.abs(vectors).max(initial=0) < 1 << (8 * w - 1))
        packed = vectors.astype(f"<i{width}").tobytes()
        row = {"block": int(pdf["block"].iloc[0]), "dim": vectors.shape[1], "n": len(ids), "width": width, "ids": ids.tobytes(), "vectors": packed}
        return pd.DataFrame([row]).rename(columns={c: f"{part}_{c}" for c in row if c != "dim"})

    return run


def _statistics(x, segments: int):
    """Means and deviations by segment, scaled so that plain products of them are the bound."""
    import numpy as np

    parts = np.array_split(x.astype(np.float64), segments, axis=1)
    scale = [np.sqrt(p.shape[1]) for p in parts]
    return np.stack([s * p.mean(axis=1) for s, p in zip(scale, parts)] + [s * p.std(axis=1) for s, p in zip(scale, parts)], axis=1)


def search_block(query_ids, queries, ids, vectors, k: int, floor=None):
    """(query row, candidate row, score) of all pairs that may be among a query's k best; ``floor`` is what a query's must reach."""
    import numpy as np

    dim, n = vectors.shape[1], min(k, len(ids))
    of_candidates: dict = {}

    def exact(qi, ci):
        out = np.empty(len(qi), np.int64)
        for at in range(0, len(qi), EXACT_PAIRS):
            s = slice(at, at + EXACT_PAIRS)
            out[s] = np.einsum("ij,ij->i", queries[qi[s]], vectors[ci[s]])
        return out

    def statistics(rows, segments):
        if segments not in of_candidates:
            of_candidates[segments] = _statistics(vectors, segments)
        return _statistics(queries[rows], segments), of_candidates[segments]

    largest = np.abs(vectors).max(initial=0).astype(np.float64)
    found = []
    for first in range(0, len(queries), TILE):
        tile = np.arange(first, min(first + TILE, len(queries)))
        own = query_ids[tile, None] == ids[None, :]
        # rounding of a bound: far below one part in 2**40 of the largest it can be
        slack = 1e-9 * dim * largest * np.abs(queries[tile]).max(initial=0) + 1e-6
        a, b = statistics(tile, 1)
        upper = a @ b.T
        upper[own] = -np.inf
        # the most promising by the coarsest bound set each query's first threshold
        rows = np.repeat(np.arange(len(tile)), n)
        cols = np.argpartition(-upper, n - 1, axis=1)[:, :n].ravel()
        seeds = np.where(own[rows, cols], np.iinfo(np.int64).min, exact(tile[rows], cols)).reshape(len(tile), n)
        least = seeds.min(axis=1).astype(np.float64) if n == k else np.full(len(tile), -np.inf)
        if floor is not None:
            least = np.maximum(least, floor[tile])
        qi, ci = np.nonzero((upper >= least[:, None] - slack) & ~own)
        segments = 4
        while segments <= dim // 2 and len(qi):
            a, b = statistics(tile, segments)
            if 4 * len(qi) > upper.size:
                near = (a @ b.T)[qi, ci]
            else:
                parts = [slice(at, at + EXACT_PAIRS) for at in range(0, len(qi), EXACT_PAIRS)]
                near = np.concatenate([np.einsum("ij,ij->i", a[qi[x]], b[ci[x]]) for x in parts])
            ok = near >= least[qi] - slack
            qi, ci = qi[ok], ci[ok]
            segments *= 4
        found.append((tile[qi], ci, exact(tile[qi], ci)))
    return tuple(np.concatenate(x) for x in zip(*found))


def _loaded(r: dict, part: str):
    """Ids and vectors of a packed block."""
    import numpy as np

    ids = np.frombuffer(r[f"{part}_ids"], np.int64)
    return ids, np.frombuffer(r[f"{part}_vectors"], f"<i{r[f'{part}_width']}").astype(np.int64).reshape(len(ids), -1)


def _best(query_ids, queries, ids, vectors, k: int, floor=None):
    """The pairs of ``search_block`` that are among a query's k best in this block, best first."""
    import numpy as np

    qi, ci, score = search_block(query_ids, queries, ids, vectors, k, floor)
    order = np.lexsort((ids[ci], -score, qi))
    qi, ci, score = qi[order], ci[order], score[order]
    best = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") < k
    return qi[best], ci[best], score[best]


def _floors(k: int):
    """Each query's k-th best score in one block, which its k best of all must reach."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            found = []
            for r in b.to_pylist():
                query_ids, queries = _loaded(r, "q")
                floor = np.full(len(query_ids), -np.inf)
                if r["c_ids"]:
                    qi, _, score = _best(query_ids, queries, *_loaded(r, "c"), k)
                    last = np.arange(len(qi)) - np.searchsorted(qi, qi, side="left") == k - 1
                    floor[qi[last]] = score[last]
                found.append(floor.tobytes())
            kept = [c for c in b.schema.names if not c.startswith("c_")]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found, pa.binary())], names=[*kept, "q_floor"])

    return run


def _search(k: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            for r in b.to_pylist():
                (query_ids, queries), (ids, vectors) = _loaded(r, "q"), _loaded(r, "c")
                qi, ci, score = _best(query_ids, queries, ids, vectors, k, np.frombuffer(r["q_floor"], np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(query_ids[qi]), pa.array(ids[ci]), pa.array(score)], names=["query_id", "vec_id", "score"])

    return run


def integer_vectors(embeddings: DataFrame, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(scale * x) of every component; vectors that are null, empty or not finite are left out."""
    v = F.col("v")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(scale * x).cast("long")).alias("v"))


def _blocks(rows: DataFrame, part: str, size: int, k: int | None) -> tuple[DataFrame, int]:
    n = max(1, -(-rows.count() // size))
    schema = ", ".join(f"{part}_{c}" if not c.startswith("dim") else c for c in (f"block int, {BLOCK}").split(", "))
    block = F.pmod(F.xxhash64("vec_id", F.lit(3)), F.lit(n)).cast("int").alias("block")
    grouped = rows.select("vec_id", "v", F.size("v").alias("dim"), block).groupBy("block", "dim")
    return materialise(grouped.applyInPandas(_packed(part, k), schema), f"{part}-blocks"), n


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best inner products, ties to the smaller vec_id.

    Both sides are (vec_id, v) of integers. A query's own id isn't a candidate; one without any other vector of its
    length has no row. Rows of one id and vector ask once; as candidates repeated rows count each. Components
    must keep inner products within 64 bits.

    Scale: the stated query set meets all vectors in blocks, keyed by the pair of blocks, so tasks are even and of
    bounded memory whatever the data; blocks are packed once and written. A vector with very many copies is cut in each block to the
    rows that can matter, at most 2k. Rows of one id are in one block: an id with very many different vectors is one block row.
    """
    asked, n_asked = _blocks(queries.dropDuplicates(["vec_id", "v"]), "q", QUERY_BLOCK, None)
    held, n_held = _blocks(vectors, "c", CANDIDATE_BLOCK, k)
    one = held.where("c_block = 0").select("dim", *[c for c in held.columns if c.startswith("c_") and c != "c_block"])
    floored = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", q_floor binary"
    met = asked.join(one, "dim", "left").select(*asked.columns, *[c for c in one.columns if c != "dim"])
    asked = materialise(met.mapInArrow(_floors(k), floored), "q-floors")
    left = held.withColumn("q_block", F.explode(F.sequence(F.lit(0), F.lit(n_asked - 1))))
    right = asked.withColumn("c_block", F.explode(F.sequence(F.lit(0), F.lit(n_held - 1))))
    pairs = left.join(right, ["q_block", "c_block", "dim"]).drop("q_block", "c_block", "q_n", "c_n")
    hits = pairs.mapInArrow(_search(k), HITS)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
