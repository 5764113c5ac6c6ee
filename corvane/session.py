"""Session helpers: the shared scratch folder and tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``, which driver and executors share.

    Only where the session names none and driver and executors are one process (tests, a laptop) a temporary folder is made and set.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corvane-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the scratch folder that nothing has used."""
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The written table outlives executors, so a lost one costs no recomputation of what is above.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes of input a core below which a table's own splits can't be trusted to occupy the cores.
SPREAD_BYTES = 32 * 1024 * 1024


def table(spark: SparkSession, sf_dir: str, name: str, spread: bool = False) -> DataFrame:
    """One of the input tables.

    ``spread`` deals rows out evenly where the files are so small that one row group may be all there is, for queries that
    spend much on each row. By the plan's size estimate large tables are read as they lie.
    """
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if spread else None
    return rows.repartition(cores) if spread and size < cores * SPREAD_BYTES else rows


def whole_entries(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the folders in ``path`` that were written to their end, ascending."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(at, "*/_SUCCESS")) or ()
    return sorted(int(f.getPath().getParent().getName()) for f in done)
