"""Operator 1, token counts, by a digest cache.

Every text's normalised content is digested in the JVM. The digests are joined with the stored counts
of the same tokenizer version; one text of each digest that has none is encoded, and its count is
appended to the cache. A later run, or a copy of a text, never meets the tokenizer again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.llm.tokens import memo, tokenizer_digest

CACHE_SCHEMA = "digest string, n_tokens long, tokenizer string"


def exact_content(text: Column) -> Column:
    """For tokenizers to which every byte matters."""
    return text


def folded_content(text: Column) -> Column:
    """For tokenizers that ignore case and white space: A-Z lower-cased, ASCII white space made one space.

    Texts with ``<|`` stay as they are: a special token is looked for before case is folded.
    """
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(text.contains("<|"), text).otherwise(F.trim(F.regexp_replace(low, r"[ \t\n\r]+", " ")))


def _encoder(path: str, space_matters: bool):
    def encode(batches):
        import pyarrow as pa

        counter = memo(path, space_matters, counts_only=True)
        for b in batches:
            counts = [counter.encode(t) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return encode


def stored_counts(docs: DataFrame, cache_dir: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds for a tokenizer version; none if there is no cache yet."""
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(cache_dir)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], "digest string, n_tokens long")
    kept = spark.read.schema(CACHE_SCHEMA).parquet(cache_dir).where(F.col("tokenizer") == version)
    return kept.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame,
    tokenizer_path: str,
    cache_dir: str,
    limit: int = 2048,
    normalise: Callable[[Column], Column] = exact_content,
    space_matters: bool = True,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``.

    Null and empty texts have 0 bytes and 0 tokens. Repeated rows come out as often as they went in; an
    empty table gives an empty result and leaves the cache alone. Other columns of ``docs`` are not
    looked at, whatever their names. ``cache_dir`` is in a store that all executors reach.

    Scale: texts are combined by digest before they are shuffled, so a text with millions of copies
    travels once a task; the join back carries digests only and AQE splits it where one is hot.
    """
    version = tokenizer_digest(tokenizer_path)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.withColumn("digest", F.sha2(normalise(F.col("text")), 256))
    stored = stored_counts(docs, cache_dir, version)
    misses = rows.groupBy("digest").agg(F.first("text").alias("text")).join(stored, "digest", "left_anti")
    counted = misses.mapInArrow(_encoder(tokenizer_path, space_matters), "digest string, n_tokens long")
    counted.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_dir)
    n = F.col("n_tokens")
    return (
        rows.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "digest")
        .join(stored_counts(docs, cache_dir, version), "digest")
        .select("doc_id", "n_bytes", n, (n > limit).alias("over_limit"))
    )
