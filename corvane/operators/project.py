"""Projections into read models, upserts by natural key, claims, and provenance joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import truncate_bytes

MAX_FIELD_BYTES, MAX_EXTRACTIONS, MAX_HIT_ENTITIES = 262_144, 100, 20


def index_documents(docs: DataFrame, extractions: DataFrame, provenance: DataFrame, max_bytes: int = MAX_FIELD_BYTES) -> DataFrame:
    """One search document each (canonical) document: fields cut to size, its time, its first entities, its provenance.

    ``docs`` (doc_id, text, lang, published_at, observed_at, duplicate_of), ``extractions`` (extraction_id, doc_id, entity_type,
    entity_key), ``provenance`` (doc_id, source). Entities are numbered in the window, so no list grows beyond its bound.
    """
    canonical = docs.where("duplicate_of IS NULL")
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("extraction_id"))
    first = extractions.withColumn("nth", nth).where(F.col("nth") <= MAX_EXTRACTIONS)
    entities = first.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("entity_type", "entity_key"))).alias("entities"))
    source = provenance.groupBy("doc_id").agg(F.min("source").alias("source"))
    rows = canonical.join(entities, "doc_id", "left").join(source, "doc_id", "left")
    none = F.array().cast("array<struct<entity_type:string,entity_key:string>>")
    return rows.select(
        "doc_id", truncate_bytes(F.col("text"), max_bytes).alias("body"), F.lower("lang").alias("language"), "source",
        F.coalesce("published_at", "observed_at").alias("effective_date"), F.coalesce("entities", none).alias("entities"),
    )


def hit_entities(index: DataFrame) -> DataFrame:
    """What a search hit shows of its entities."""
    return index.withColumn("entities", F.slice("entities", 1, MAX_HIT_ENTITIES))


def upsert_fields(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Partial upsert: a field that the new row leaves null keeps its value."""
    columns = [c for c in old.columns if c != key]
    renamed = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    return old.join(renamed, key, "full").select(key, *[F.coalesce(f"new_{c}", c).alias(c) for c in columns])


def unclaimed(items: DataFrame, claims: DataFrame, key: list[str]) -> DataFrame:
    """Items that no earlier run has claimed; each once."""
    return items.dropDuplicates(key).join(claims.select(key), key, "left_anti")


def first_by_key(rows: DataFrame, key: list[str], id_col: str) -> DataFrame:
    """Keys that several rows have, with the row that stays."""
    return rows.groupBy(*key).agg(F.min(id_col).alias("kept"), F.count("*").alias("n")).where("n > 1")


def latest_per(rows: DataFrame, by: str, order: list, n: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= n)


def platforms(docs: DataFrame, raw: DataFrame, sources: DataFrame) -> DataFrame:
    """(doc_id, platform) over two lookups; null where either misses."""
    return docs.select("doc_id", "raw_id").join(raw.select("raw_id", "source_id"), "raw_id", "left").join(sources.select("source_id", "platform"), "source_id", "left").select("doc_id", "platform")


def new_evidence(found: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Evidence that isn't stored; nulls in the key are equal to nulls."""
    f, s = found.alias("f"), stored.alias("s")
    same = F.lit(True)
    for k in key:
        same = same & F.col(f"f.{k}").eqNullSafe(F.col(f"s.{k}"))
    return f.join(s, same, "left_anti")


def dead_letters(failed: DataFrame) -> DataFrame:
    """Failed events, one a place in the log, with how often each failed."""
    return failed.groupBy("topic", "part", "offset").agg(F.count("*").alias("attempts"), F.max("error").alias("error"))


def claim_batch(outbox: DataFrame, now, limit: int = 100) -> DataFrame:
    """The oldest entries that wait, or whose lease has run out."""
    free = F.col("leased_until").isNull() | (F.col("leased_until") < F.lit(now))
    return outbox.where(F.col("published_at").isNull() & free).orderBy("created_at", "id").limit(limit)
