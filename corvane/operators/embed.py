"""What is embedded and under which key, what needs no new embedding, and duplicates by meaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.resolve import close_pairs

# Fixed value: the prefix of cached vectors' keys.
CACHE_PREFIX = "embedding-cache:v1:"


def entity_text(name: Column, description: Column) -> Column:
    """What is embedded of an entity: its name, and its description where there is one."""
    return F.when(description.isNotNull(), F.concat(name, F.lit(": "), description)).otherwise(name)


def content_key(text: Column) -> Column:
    """SHA-256 of the text as it is."""
    return F.sha2(text, 256)


def cache_key(text: Column) -> Column:
    return F.concat(F.lit(CACHE_PREFIX), content_key(text))


def to_embed(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """``rows`` (target, target_type, model, text) whose vector of this very text is not stored, each once, with ``content_hash``.

    ``stored`` has target, target_type, model and content_hash. Only keys are joined.
    """
    keys = ["target", "target_type", "model", "content_hash"]
    return rows.withColumn("content_hash", content_key(F.col("text"))).dropDuplicates(keys).join(stored.select(keys), keys, "left_anti")


def matched_section(body: Column, title: Column) -> Column:
    """The part of a document that stands for a hit by meaning: the body if it says anything, or else the title."""
    says = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    return F.when(says(body), "body").when(says(title), "title")


def semantic_parents(vectors: DataFrame, least: float = 0.9) -> DataFrame:
    """(doc_id, parent, similarity): for each of (doc_id, model, embedding) the earlier document of its model that is most like it.

    Only documents whose cosine reaches ``least``; of equally alike ones the first. All earlier documents are looked at, a
    block of vectors with a block, not a few neighbours of an approximate index, so nothing goes stale or is missed; of a pair of blocks only
    each document's best comes out.
    """
    rows = vectors.select(F.col("doc_id").alias("entity"), F.col("model").alias("entity_type"), "embedding")
    pairs = close_pairs(rows, least, best=True).where(F.col("entity") != F.col("other"))
    ordered = pairs.select(F.greatest("entity", "other").alias("doc_id"), F.least("entity", "other").alias("parent"), "cos")
    best = ordered.groupBy("doc_id").agg(F.min(F.struct((-F.col("cos")).alias("away"), F.col("parent"))).alias("best"))
    return best.select("doc_id", "best.parent", (-F.col("best.away")).alias("similarity"))
