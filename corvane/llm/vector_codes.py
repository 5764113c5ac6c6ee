"""Operator 11, vector code compression: integer k-means codebooks by position, searched by Exponion.

A vector is cut into equal parts; each part position has a small codebook, refined in rounds of assigning and averaging. The search
for a part starts at the entry it had before, at squared distance d. By the triangle inequality an entry that is as near or nearer lies
within twice that distance of the entry it had, so only entries whose squared distance from it is at most 4 * d are looked
at, from its list of the others sorted by distance. Everything is in integers, so the bound and all ties are exact.

Vectors are packed into blocks (one Arrow batch, one row). A block carries its codes from round to round, and the sums that the next
codebooks are made of; the driver sees those sums added up, a number that only the shape of the codebooks decides.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.skew import join_counted
from corvane.session import materialise

#: Components beyond this don't keep the squared distances of 64 of them within 64 bits.
LIMIT = 1 << 27
STATE = "ids array<long>, labels array<string>, dim int, width int, vectors binary, codes binary, sums array<long>"


def nearest(x, before, entries):
    """(index, squared distance, distances computed): of every row of ``x`` the nearest row of ``entries``, ties to the lower index.

    ``before`` holds the entry from which each row's search starts.
    """
    import numpy as np

    between = np.square(entries[:, None, :] - entries[None, :, :]).sum(axis=2)
    order = np.argsort(between, axis=1, kind="stable")
    own = np.square(x - entries[before]).sum(axis=1)
    best, at, computed = own.copy(), before.astype(np.int64), len(x)
    for entry in np.unique(before).tolist():
        rows = np.flatnonzero(before == entry)
        rows = rows[np.argsort(-own[rows], kind="stable")]
        reach = -4 * own[rows]  # ascending: the rows that reach furthest come first
        for other in order[entry].tolist():
            live = rows[: np.searchsorted(reach, -between[entry, other], side="right")]
            if not len(live):
                break
            if other == entry:
                continue
            d = np.square(x[live] - entries[other]).sum(axis=1)
            computed += len(live)
            nearer = (d < best[live]) | ((d == best[live]) & (other < at[live]))
            best[live[nearer]], at[live[nearer]] = d[nearer], other
    return at, best, computed


def _assigned(vectors, codes, books):
    """New codes and squared distances of a block: (n, parts) each."""
    import numpy as np

    found = [nearest(x, codes[:, p], books[p]) for p, x in enumerate(np.split(vectors, len(books), axis=1))]
    return np.stack([f[0] for f in found], axis=1).astype(np.uint8), np.stack([f[1] for f in found], axis=1)


def _sums(vectors, codes, books):
    """Of every part, entry: the sum of each component and the number of parts assigned, flat."""
    import numpy as np

    out = np.zeros((len(books), books.shape[1], books.shape[2] + 1), np.int64)
    for p, x in enumerate(np.split(vectors, len(books), axis=1)):
        np.add.at(out[p, :, :-1], codes[:, p], x)
        out[p, :, -1] = np.bincount(codes[:, p], minlength=books.shape[1])
    return out.ravel().tolist()


def _first_round(books):
    def run(batches):
        import numpy as np
        import pandas as pd
        import pyarrow as pa

        for b in batches:
            if not b.num_rows:
                continue
            vectors = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(b.num_rows, -1)
            if np.abs(vectors).max(initial=0) >= LIMIT:
                raise ValueError(f"a scaled component is beyond {LIMIT}: its squared distances don't fit a long")
            codes, _ = _assigned(vectors, np.zeros((b.num_rows, len(books)), np.uint8), books)
            width = 2 if np.abs(vectors).max(initial=0) < 1 << 15 else 4
            row = {"ids": b.column("vec_id").to_pylist(), "labels": b.column("label").to_pylist(), "dim": vectors.shape[1], "width": width}
            row |= {"vectors": vectors.astype(f"<i{width}").tobytes(), "codes": codes.tobytes(), "sums": _sums(vectors, codes, books)}
            yield pa.RecordBatch.from_pylist([row], schema=_arrow_state())

    return run


def _arrow_state():
    import pyarrow as pa

    types = {"ids": pa.list_(pa.int64()), "labels": pa.list_(pa.string()), "dim": pa.int32(), "width": pa.int32()}
    return pa.schema(types | {"vectors": pa.binary(), "codes": pa.binary(), "sums": pa.list_(pa.int64())})


def _unpacked(row, parts: int):
    import numpy as np

    vectors = np.frombuffer(row["vectors"], f"<i{row['width']}").astype(np.int64).reshape(-1, row["dim"])
    return vectors, np.frombuffer(row["codes"], np.uint8).reshape(-1, parts)


def _next_round(books):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                vectors, before = _unpacked(row, len(books))
                codes, _ = _assigned(vectors, before, books)
                row |= {"codes": codes.tobytes(), "sums": _sums(vectors, codes, books)}
                yield pa.RecordBatch.from_pylist([row], schema=_arrow_state())

    return run


def _last_round(books):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            for row in b.to_pylist():
                codes, d = _assigned(*_unpacked(row, len(books)), books)
                text = codes.tobytes().hex()
                n = 2 * len(books)
                columns = [row["ids"], [text[i : i + n] for i in range(0, len(text), n)], d.sum(axis=1).tolist(), row["labels"]]
                types = [pa.int64(), pa.string(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["vec_id", "code", "error", "label"])

    return run


def _averaged(books, state: DataFrame):
    """The entries replaced by the floored mean of what is assigned to them; unused entries stay."""
    import numpy as np

    each = state.select(F.posexplode("sums").alias("i", "x")).groupBy("i").agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"))
    flat = {r.i: int(r.x) for r in each.collect()}  # parts * entries * (width of a part + 1) numbers
    out, width = books.copy(), books.shape[2] + 1
    for p in range(books.shape[0]):
        for e in range(books.shape[1]):
            at = (p * books.shape[1] + e) * width
            if n := flat.get(at + width - 1, 0):
                out[p, e] = np.array([flat[at + i] // n for i in range(width - 1)], np.int64)
    return out


def scaled_vectors(
    embeddings: DataFrame, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """(vec_id, v, label): floor(scale * x) of every component; vectors that are null, empty or not finite are left out. Null ids stay."""
    v = F.col("v")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label")
    )
    rows = rows.where(v.isNotNull() & (F.size(v) > 0) & F.coalesce(usable, F.lit(False)))
    return rows.select("vec_id", F.transform(v, lambda x: F.floor(scale * x).cast("long")).alias("v"), "label")


def vector_codes(vectors: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6) -> tuple[DataFrame, list[list[list[int]]]]:
    """((vec_id, code, error, label_error) of every row, the final codebooks) of (vec_id, v, label) with integer vectors.

    The first codebooks are the parts of the ``entries`` smallest vec_ids (null last, equal ids by their vectors; with fewer rows there are
    fewer entries). ``code`` has two hex digits a part, ``error`` the squared distances summed over parts, ``label_error`` the errors summed
    over equal labels, null being one. Vectors of another length than the smallest vec_id's take no part; a length that
    ``parts`` doesn't divide is an error, as are components beyond LIMIT. Rows that are repeated count and come out each. An empty table
    gives an empty result and no codebooks. ``vectors`` is built of three named columns, so others can't clash.

    Every round's blocks are written, so a lost executor costs its part of one round. Labels with many rows meet their sum by broadcast.
    """
    import numpy as np

    if not 0 < entries <= 256:
        raise ValueError("a code is one byte")
    seeds = np.array([r.v for r in _first(vectors, entries)], np.int64)
    if not seeds.size:
        return vectors.selectExpr("vec_id", "'' AS code", "0L AS error", "0L AS label_error").limit(0), []
    if seeds.shape[1] % parts:
        raise ValueError(f"{parts} parts don't divide vectors of length {seeds.shape[1]}")
    books = np.stack(np.split(seeds, parts, axis=1))
    state = materialise(vectors.where(F.size("v") == seeds.shape[1]).mapInArrow(_first_round(books), STATE), "vector-codes")
    books = _averaged(books, state)
    for _ in range(rounds - 1):
        state = materialise(state.mapInArrow(_next_round(books), STATE), "vector-codes")
        books = _averaged(books, state)
    placed = state.mapInArrow(_last_round(books), "vec_id long, code string, error long, label string")
    # a label that is null is told apart from all others
    placed = materialise(placed.withColumn("label", F.coalesce(F.concat(F.lit("="), "label"), F.lit("null"))), "codes")
    by_label = materialise(placed.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "label-errors")
    joined = join_counted(placed, by_label, "label", "n", placed.count())
    return joined.select("vec_id", "code", "error", "label_error"), books.tolist()


def _first(vectors: DataFrame, n: int) -> list:
    """The first rows by vec_id; of those only as many as have the first one's length."""
    rows = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(1).collect()
    if not rows:
        return []
    alike = vectors.where(F.size("v") == len(rows[0].v))
    return alike.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(n).collect()


def codebooks_digest(books: list[list[list[int]]]) -> str:
    """SHA-256 of all components in order, as decimal numbers with commas between."""
    return hashlib.sha256(",".join(str(x) for part in books for entry in part for x in entry).encode()).hexdigest()
