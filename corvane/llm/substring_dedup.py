"""Operator 6, substring dedup, by an FM-index per shard.

Shards are made by content: the smallest hash of a short run of words in a window (its anchor) is the same for
equal windows, so passages meet in the shard of their anchors and nowhere else. Anchors that one document alone
has are dropped by a count before any text moves. Each shard indexes its different passages and streams
them by backward search; an interval at the full window length tells the smallest document that holds it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.skew import join_counted
from corvane.session import materialise

#: Bytes of passages about which a shard is made.
SHARD_BYTES = 500_000
#: Different passages, and bytes of them, beyond which an anchor is settled by window.
WIDE_ANCHOR, WIDE_BYTES = 400, 1_000_000
#: Rows that a task holds before it hands them on.
OUT_ROWS = 20_000
PASSAGE = "key binary, doc_id long, start int, anchor long, digest binary, passage binary"
SPANS = "array<struct<at:int,n:int,first_doc:bigint>>"
FOUND = f"anchor long, digest binary, spans {SPANS}"


def _digest(words: bytes) -> bytes:
    from hashlib import blake2b

    return blake2b(words, digest_size=16).digest()


def _anchor_rows(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from corvane.llm.wordwindows import Words, anchors

        for b in batches:
            found, docs = [], []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                words = Words(text)
                if len(words) >= window and doc is not None:
                    own = np.unique(anchors(words, window))
                    found.append(own.view(np.int64))
                    docs.append(np.full(len(own), doc, np.int64))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found)), pa.array(np.concatenate(docs))], names=["anchor", "doc_id"])

    return run


def _passages(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        from corvane.llm.wordwindows import Words, anchors, runs

        kinds = (pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        names = ["key", "doc_id", "start", "anchor", "digest", "passage"]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

        for b in batches:
            out: list[list] = [[], [], [], [], [], []]
            columns = [b.column(c).to_pylist() for c in ("key", "doc_id", "text", "anchors")]
            for key, doc, text, shared in zip(*columns):
                words = Words(text)
                if len(words) < window:
                    continue
                own = anchors(words, window).view(np.int64)
                starts, ends = runs(own)
                wanted = np.isin(own[starts], np.array(shared, np.int64))
                listed = words.list()
                for s, e in zip(starts[wanted].tolist(), ends[wanted].tolist()):
                    passage = b" ".join(listed[s : e + window - 1])
                    for values, v in zip(out, (key, doc, s, int(own[s]), _digest(passage), passage)):
                        values.append(v)
                if len(out[0]) >= OUT_ROWS:
                    yield batch(out)
                    out = [[], [], [], [], [], []]
            yield batch(out)

    return run


def _search_shard(window: int):
    def run(pdf):
        from itertools import chain

        import numpy as np
        import pandas as pd

        from corvane.llm.fm_index import FMIndex
        from corvane.llm.wordwindows import runs

        words = [bytes(p).split(b" ") for p in pdf["passage"]]
        ids = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)), 1)}
        every = np.fromiter(map(ids.__getitem__, chain.from_iterable(words)), np.int64)
        coded = np.split(every, np.cumsum([len(w) for w in words])[:-1])
        index = FMIndex(coded, pdf["first_doc"].to_numpy(np.int64), window)
        spans = []
        for first in index.matches(coded):
            starts, ends = runs(first)
            spans.append([{"at": s, "n": e - s, "first_doc": int(first[s])} for s, e in zip(starts.tolist(), ends.tolist())])
        return pd.DataFrame({"anchor": pdf["anchor"], "digest": pdf["digest"], "spans": spans})

    return run


def _windows(window: int):
    def run(batches):
        import pyarrow as pa

        kinds = (pa.int64(), pa.binary(), pa.int32(), pa.binary(), pa.int64())
        names = ["anchor", "digest", "at", "words", "first_doc"]

        def batch(out):
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(out, kinds)], names=names)

        for b in batches:
            out: list[list] = [[], [], [], [], []]
            columns = [b.column(c).to_pylist() for c in ("anchor", "digest", "passage", "first_doc")]
            for anchor, digest, passage, first in zip(*columns):
                words = passage.split(b" ")
                for i in range(len(words) - window + 1):
                    for values, v in zip(out, (anchor, digest, i, _digest(b" ".join(words[i : i + window])), first)):
                        values.append(v)
                    if len(out[0]) >= OUT_ROWS:
                        yield batch(out)
                        out = [[], [], [], [], []]
            yield batch(out)

    return run


def _by_window(wide: DataFrame, window: int) -> DataFrame:
    """(anchor, digest, spans) of passages of wide anchors, settled window by window by a grouped minimum over 128-bit digests.

    A window that one passage alone has is settled by its group. Those that several have go back to them by a join in which very frequent ones are broadcast.
    """
    each = materialise(wide.mapInArrow(_windows(window), "anchor long, digest binary, at int, words binary, first_doc long"), "wide")
    place = F.struct("anchor", "digest", "at")
    least = each.groupBy("words").agg(F.min("first_doc").alias("least_doc"), F.count("*").alias("n"), F.min(place).alias("place"))
    least = materialise(least, "windows")
    alone = least.where("n = 1").select("place.*", F.col("least_doc").alias("first_doc"))
    shared = least.where("n > 1").select("words", F.col("least_doc").alias("first_doc"), "n")
    met = join_counted(each.drop("first_doc"), shared, "words", "n", each.count()).drop("n")
    settled = alone.unionByName(met.drop("words"))
    return settled.groupBy("anchor", "digest").agg(F.collect_list(F.struct("at", F.lit(1).alias("n"), "first_doc")).alias("spans"))


def repeated_spans(rows: DataFrame, window: int) -> DataFrame:
    """(doc_id, key, spans): runs of ``n`` windows from ``start`` that a smaller doc_id holds, of (doc_id, key, text)."""
    found = materialise(rows.select("doc_id", "text").mapInArrow(_anchor_rows(window), "anchor long, doc_id long"), "anchors")
    ends = found.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
    shared = found.join(ends.where("lo < hi").select("anchor"), "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))
    passages = materialise(rows.join(shared, "doc_id").mapInArrow(_passages(window), PASSAGE), "passages")
    different = passages.groupBy("anchor", "digest").agg(F.min("doc_id").alias("first_doc"), F.first("passage").alias("passage"))
    different = materialise(different, "different")
    size = F.octet_length("passage").cast("long")
    per_anchor = different.groupBy("anchor").agg(F.count("*").alias("ways"), F.sum(size).alias("bytes"))
    is_wide = (F.col("ways") > 1) & ((F.col("ways") > WIDE_ANCHOR) | (F.col("bytes") > WIDE_BYTES))
    of_anchor = materialise(per_anchor.select("anchor", is_wide.alias("wide"), "bytes"), "ways")
    totals = of_anchor.where("NOT wide").agg(F.sum("bytes")).first()[0] or 0
    shards = max(1, totals // SHARD_BYTES)
    passage = different.join(of_anchor.drop("bytes"), "anchor")
    narrow = passage.where("NOT wide").select("anchor", "digest", "first_doc", "passage")
    searched = narrow.groupBy(F.pmod(F.xxhash64("anchor"), F.lit(shards)).alias("shard")).applyInPandas(_search_shard(window), FOUND)
    settled = _by_window(passage.where("wide").select("anchor", "digest", "first_doc", "passage"), window)
    verdicts = searched.unionByName(settled)
    placed = passages.select("key", "doc_id", "start", "anchor", "digest").join(verdicts, ["anchor", "digest"])
    lost = F.filter("spans", lambda x: x["first_doc"] < F.col("doc_id"))
    spans = F.transform(lost, lambda x: F.struct((F.col("start") + x["at"]).alias("start"), x["n"].alias("n")))
    return placed.where(F.size(lost) > 0).select("doc_id", "key", spans.alias("spans"))


def _without(window: int):
    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            out: list[list] = [[], [], []]
            for text, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist()):
                words = text.encode().split()
                kept = words
                if spans:
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, [s["start"] for s in spans], 1)
                    np.add.at(edge, [s["start"] + s["n"] + window - 1 for s in spans], -1)
                    kept = [w for w, c in zip(words, np.cumsum(edge)[:-1].tolist()) if not c]
                for values, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept).decode())):
                    values.append(v)
            arrays = [b.column("doc_id"), *[pa.array(v, k) for v, k in zip(out, (pa.int64(), pa.int64(), pa.string()))]]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run


def dedup_substrings(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text) of every row, without words in windows that a smaller doc_id holds.

    Null and empty texts have no word. Rows that repeat a doc_id don't take words from each other; rows with a
    null id neither lose nor take words. An empty table gives an empty result. Other columns are not looked at.

    Scale: what travels is an anchor for about every twentieth word, the passages whose anchor two documents have,
    combined where they are equal, and the texts twice by key. A passage in a million documents is one row of a
    shard; an anchor with very many different passages around it (the edges of such a passage) is settled
    window by window, by a grouped minimum over digests, so no shard grows with it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("key", F.unhex(F.md5("text")))
    spans = repeated_spans(rows, window).groupBy("doc_id", "key").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    out = "doc_id long, n_words long, n_removed long, kept_text string"
    return rows.join(spans, ["doc_id", "key"], "left").mapInArrow(_without(window), out)
