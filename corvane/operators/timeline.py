"""Entity timelines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def entity_timeline(extractions: DataFrame, docs: DataFrame, entity, limit: int = 100) -> DataFrame:
    """An entity's mentions in time, latest first: the first ``limit`` extractions by id, then their documents.

    Duplicates (is_duplicate) are dropped after the limit, so ``truncated`` tells of the extractions. The time is the
    publication's, or else the observation's.
    """
    own = extractions.where(F.col("entity") == entity).orderBy("extraction_id").limit(limit)
    truncated = own.count() >= limit
    met = own.join(docs, "doc_id").where(~F.col("is_duplicate"))
    source = F.when(F.col("published_at").isNotNull(), "published").otherwise("observed")
    rows = met.select("extraction_id", "doc_id", F.coalesce("published_at", "observed_at").alias("at"), source.alias("time_source"))
    return rows.withColumn("truncated", F.lit(truncated)).orderBy(F.desc("at"), "extraction_id")
