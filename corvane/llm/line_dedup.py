"""Operator 10, line dedup, by sharded cuckoo filters over exact reference tables.

The index is a log of references: (line key, document, +1 or -1). Its sums are the exact counts. Each shard of the
key space also has a cuckoo filter of the keys it holds, so a batch's keys that no document has used before
are told apart without reading the log, and a document's deletion takes keys out again. Every change adds an entry to a
manifest in the index's folder, next to the last, so an index can be opened again anywhere, and a change undone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.skew import join_counted
from corvane.session import materialise

MIN_CHARS, MIN_DOCS = 20, 3
LOG = "key binary, doc_id long, sign int"
FILTERS = "shard int, filter binary"
ENTRY = "parent int, shards int, min_chars int, logs array<string>, filters string, base long"
PROBED = "shard int, key binary, maybe boolean, filter binary"


def line_key(line: str) -> str:
    """White space stripped at both ends, A-Z lower-cased."""
    return line.encode().strip().lower().decode()


def _digest(key: str) -> bytes:
    from hashlib import blake2b

    return blake2b(key.encode(), digest_size=16).digest()


def _references(min_chars: int):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            keys, docs = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                own = {k for k in map(line_key, text.split("\n")) if len(k) >= min_chars}
                keys += map(_digest, own)
                docs += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(docs, pa.int64())], names=["key", "doc_id"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def references(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(key, doc_id): each document's distinct line keys of at least ``min_chars``."""
    return _rows(docs, id_col, text_col).mapInArrow(_references(min_chars), "key binary, doc_id long")


def _hashes(keys):
    import numpy as np

    return np.frombuffer(b"".join(bytes(k)[:8] for k in keys), "<u8")


def _loaded(right):
    from corvane.llm.cuckoo import CuckooFilter

    return CuckooFilter.from_bytes(bytes(right["filter"].iloc[0]) if len(right) else None)


def _probe_and_add(left, right):
    """One shard: keys of a batch, each with whether the filter may know it, and the grown filter."""
    import pandas as pd

    shard, known, hashes = int((left if len(left) else right)["shard"].iloc[0]), _loaded(right), _hashes(left["key"])
    seen = known.has(hashes)
    known.reserve(int(1.3 * len(hashes)))
    # a key that only looks known is added by the exact check that follows
    known.add(hashes[~seen])
    out = pd.DataFrame({"shard": shard, "key": left["key"], "maybe": seen, "filter": None})
    return pd.concat([out, pd.DataFrame({"shard": [shard], "key": [None], "maybe": [False], "filter": [known.to_bytes()]})])


def _change(add: bool):
    def run(left, right):
        import pandas as pd

        shard, known = int((left if len(left) else right)["shard"].iloc[0]), _loaded(right)
        (known.add if add else known.drop)(_hashes(left["key"]))
        return pd.DataFrame({"shard": [shard], "filter": [known.to_bytes()]})

    return run


class LineIndex:
    """The index in ``path``, a folder that driver and executors share: the one that is there, or a new one.

    ``shards`` is fixed when the index is made: about as many as keep a shard's distinct keys under a hundred
    thousand or so, since a shard's filter (a few bytes a key) is one row. Keys are spread by their digest, and only
    distinct keys are grouped by shard, so a line that every document holds is one key there.

    The folder holds ``manifest/N``, one row an entry, and the files that entries name. The highest whole entry counts. A change writes its files under
    names of its own and then its entry, under the next number that no folder has, be it whole or what a broken write left; files without
    a whole entry are not part of the index, so a change that is broken off leaves it as it was, and the next one goes on. An entry tells which one it
    was made of: a change fails where another was faster, and an index in which two whole entries were made of one can't be opened.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int = 256, min_chars: int = MIN_CHARS):
        self.spark, self.path = spark, path.rstrip("/")
        self.version, self.parent, self._logs, self._filters = self._last(), 0, [], None
        self.shards, self.min_chars = shards, min_chars
        if self.version:
            self._enter(self._entry(self.version))

    def _numbers(self, whole: bool) -> list[int]:
        """Numbers of the entries, ascending: of those that were written to their end, or of all folders."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path
        at = path(f"{self.path}/manifest")
        fs = at.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [f.getPath() for f in fs.globStatus(path(at, "*/_SUCCESS" if whole else "*")) or ()]
        return sorted(int((p.getParent() if whole else p).getName()) for p in found)

    def _last(self) -> int:
        whole = self._numbers(whole=True)
        if len(whole) > 1 and self._entry(whole[-1]).base != whole[-2]:
            raise RuntimeError(f"two changes of entry {self._entry(whole[-1]).base} were made at once: {whole[-2]} and {whole[-1]}")
        return whole[-1] if whole else 0

    def _entry(self, version: int):
        return self.spark.read.schema(ENTRY).parquet(f"{self.path}/manifest/{version}").first()

    def _enter(self, entry) -> None:
        self.parent, self.shards, self.min_chars = entry.parent, entry.shards, entry.min_chars
        self._logs, self._filters = list(entry.logs), entry.filters

    def _shard(self):
        return F.pmod(F.xxhash64("key"), F.lit(self.shards)).cast("int")

    def _read(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _fresh(self, label: str) -> str:
        return f"{self.path}/data/{label}-{uuid.uuid4().hex}"

    def filters(self) -> DataFrame:
        """(shard, filter) of the present version."""
        return self._read([self._filters] if self._filters else [], FILTERS)

    def present(self) -> DataFrame:
        """(key, doc_id): the references that hold now, each once.

        An insertion logs only references that didn't hold before it, so as long as nothing was deleted the log is what holds.
        """
        log = self._read(self._logs, LOG)
        if not self._grouped():
            return log.select("key", "doc_id")
        return log.groupBy("key", "doc_id").agg(F.sum("sign").alias("n")).where("n > 0").select("key", "doc_id")

    def _grouped(self) -> bool:
        return any(p.rsplit("/", 1)[1].startswith("gone-") for p in self._logs)

    def counts(self) -> DataFrame:
        """(key, n_docs, last_doc): the exact reference counts."""
        return self.present().groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))

    def _commit(self, log: DataFrame, filters: DataFrame, label: str = "log") -> None:
        to_log, to_filters = self._fresh(label), self._fresh("filters")
        filters.write.parquet(to_filters)
        log.write.parquet(to_log)
        self._record(self.version, [*self._logs, to_log], to_filters)

    def _record(self, parent: int, logs: list[str], filters: str | None) -> None:
        if self._last() != self.version:
            raise RuntimeError(f"PATH_ALREADY_EXISTS: {self.path}/manifest has an entry after {self.version}; open the index again")
        number = max(self._numbers(whole=False), default=0) + 1
        entry = self.spark.createDataFrame([(parent, self.shards, self.min_chars, logs, filters, self.version)], ENTRY)
        entry.coalesce(1).write.parquet(f"{self.path}/manifest/{number}")
        self.version = number
        self.parent, self._logs, self._filters = parent, logs, filters

    def insert(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> None:
        """Add documents. A document that is there already adds only lines that it didn't have."""
        refs, probes = self._fresh("refs"), self._fresh("probed")
        references(docs, self.min_chars, id_col, text_col).write.parquet(refs)
        batch = self._read([refs], "key binary, doc_id long")
        keys = batch.select("key").distinct().withColumn("shard", self._shard())
        keys.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_probe_and_add, PROBED).write.parquet(probes)
        # two readings, so that the columns of one are not those of the other where they meet below
        filters = self._read([probes], PROBED).where("filter IS NOT NULL").select("shard", "filter")
        maybe = self._read([probes], PROBED).where("maybe").select("shard", "key")
        new = batch.distinct()
        if self._logs and not maybe.isEmpty():
            old = materialise(self.present().join(maybe.select("key"), "key", "left_semi"), "known-lines")
            new = new.join(old, ["key", "doc_id"], "left_anti")
            # keys that a filter took for others' are known now for themselves
            wrong = maybe.join(old.select("key").distinct(), "key", "left_anti")
            filters = wrong.groupBy("shard").cogroup(filters.groupBy("shard")).applyInPandas(_change(add=True), FILTERS)
        self._commit(new.withColumn("sign", F.lit(1)), filters)

    def delete(self, doc_ids: DataFrame) -> None:
        """Take documents (a column ``doc_id``) out; keys that nothing refers to any more leave the filters."""
        gone = materialise(self.present().join(doc_ids.select("doc_id").distinct(), "doc_id", "left_semi").select("key", "doc_id"), "gone-lines")
        touched = gone.groupBy("key").agg(F.count("*").alias("minus"))
        empty = touched.join(self.counts(), "key").where("n_docs = minus").select("key").withColumn("shard", self._shard())
        filters = empty.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInPandas(_change(add=False), FILTERS)
        self._commit(gone.withColumn("sign", F.lit(-1)), filters, "gone")

    def undo(self) -> None:
        """Back to the state before the last change that isn't undone; that is a new entry, so nothing is overwritten."""
        if not self._logs:
            raise ValueError("nothing to undo")
        if not self.parent:
            self._record(0, [], None)
            return
        before = self._entry(self.parent)
        self._record(before.parent, list(before.logs), before.filters)

    def dropped_keys(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """(doc_id, keys): the keys whose lines each document loses."""
        present = materialise(self.present(), "present-lines") if self._grouped() else self.present()
        counts = present.groupBy("key").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("last_doc"))
        common = materialise(counts.where(F.col("n_docs") >= min_docs), "common-lines")
        lost = join_counted(present, common, "key", "n_docs", present.count()).where(F.col("doc_id") < F.col("last_doc"))
        return lost.groupBy("doc_id").agg(F.collect_list("key").alias("keys"))

    def clean(
        self, docs: DataFrame, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: bool = False
    ) -> DataFrame:
        """(doc_id, n_lines, n_dropped, kept_text) of every row of ``docs`` by the present counts.

        ``carry`` adds ``row``, the whole row.
        """
        row = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")] if carry else []
        rows = _rows(docs, id_col, text_col, *row).join(self.dropped_keys(min_docs), "doc_id", "left")
        schema = "doc_id long, n_lines long, n_dropped long, kept_text string"
        if carry:
            schema += f", row {docs.schema.simpleString()}"
        return rows.mapInArrow(_drop_lines, schema)


def _drop_lines(batches):
    import pyarrow as pa

    for b in batches:
        out: list[list] = [[], [], []]
        for text, keys in zip(b.column("text").to_pylist(), b.column("keys").to_pylist()):
            lines = text.split("\n")
            kept = lines
            if keys:
                lost = set(keys)
                kept = [x for x in lines if _digest(line_key(x)) not in lost]
            for values, v in zip(out, (len(lines), len(lines) - len(kept), "\n".join(kept))):
                values.append(v)
        arrays = [b.column("doc_id"), *[pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.string()))]]
        carried = ["row"] * ("row" in b.schema.names)
        arrays += [b.column(c) for c in carried]
        yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_lines", "n_dropped", "kept_text", *carried])


def _insert_all(docs: DataFrame, index_dir: str, min_chars: int, id_col: str, text_col: str, batches: int) -> LineIndex:
    held = docs.where(F.col(id_col).isNotNull())
    index = LineIndex(docs.sparkSession, index_dir, max(64, held.count() // 10_000), min_chars)
    for i in range(batches):
        index.insert(held.where(F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(batches)) == i), id_col, text_col)
    return index


def dedup_lines(
    docs: DataFrame,
    index_dir: str,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 1,
) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): ``docs`` inserted into the index in ``index_dir`` and cleaned by it.

    Null and empty texts are one empty line. A key in ``min_docs`` documents stays in the largest doc_id that holds
    it. Rows that repeat a doc_id count as one document and are all cleaned; rows with a null id keep all their
    lines. An empty table gives an empty result. Other columns are not looked at. Documents are inserted in ``batches``
    parts, which changes nothing in the result: what a part has in common with the ones before it is told by the filters.
    """
    index = _insert_all(docs, index_dir, min_chars, id_col, text_col, batches)
    return index.clean(docs, min_docs, id_col, text_col)


def clean_documents(
    docs: DataFrame,
    index_dir: str,
    min_docs: int = MIN_DOCS,
    min_chars: int = MIN_CHARS,
    id_col: str = "doc_id",
    text_col: str = "text",
    length_col: str = "n_chars",
    batches: int = 1,
) -> DataFrame:
    """``docs`` with cleaned texts (null for null) and their lengths; every row and column stays."""
    index = _insert_all(docs, index_dir, min_chars, id_col, text_col, batches)
    cleaned = index.clean(docs, min_docs, id_col, text_col, carry=True)
    text = F.when(F.col(f"row.{text_col}").isNotNull(), F.col("kept_text"))
    new = {text_col: text, length_col: F.coalesce(F.length(text), F.lit(0)).cast("long")}
    return cleaned.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`") for c in docs.columns])
