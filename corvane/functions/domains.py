"""Public suffixes and registrable domains of host names, by a join with a table of suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A start for texts about security; the whole public list goes in as a file.
SUFFIXES = (
    "com", "net", "org", "edu", "gov", "mil", "int", "info", "biz", "name", "pro", "arpa", "io", "dev", "app", "cloud", "online", "site", "xyz", "top",
    "test", "example", "invalid", "localhost", "onion", "us", "uk", "de", "fr", "es", "it", "nl", "se", "no", "fi", "dk", "pl", "ru", "ua", "cn", "tw", "hk",
    "jp", "kr", "in", "au", "nz", "br", "mx", "za", "eu", "ch", "at", "be", "ca", "md", "sh", "co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "co.jp",
    "com.cn", "com.tw", "org.tw", "gov.tw", "edu.tw", "com.br", "co.nz", "co.za", "github.io", "pages.dev", "herokuapp.com", "s3.amazonaws.com",
)


def suffix_table(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(suffix): the lines of a file in the public list's form (comments, wildcards and exceptions are left out), or SUFFIXES."""
    if path is None:
        return spark.createDataFrame([(s,) for s in SUFFIXES], "suffix string")
    line = F.lower(F.trim("value"))
    return spark.read.text(path).select(line.alias("suffix")).where(line.rlike(r"^[^\s/!*]+$")).distinct()


def with_suffix(rows: DataFrame, host: str, suffixes: DataFrame) -> DataFrame:
    """``rows`` with the longest suffix that ``host`` ends in, and the domain of one label more; both null if none does.

    Every distinct host is cut into its tails once, which meet the table by equality. A host that is itself a suffix has no registrable
    domain; nulls and names that are too long have neither.
    """
    names = rows.select(F.col(host).alias("name")).where("name IS NOT NULL AND length(name) <= 253").distinct()
    labels = F.split(F.lower(F.rtrim("name", F.lit("."))), r"\.")
    cut = names.select("name", labels.alias("labels"))
    tails = F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.array_join(F.slice("labels", i, F.size("labels")), "."))
    met = cut.select("name", "labels", F.posexplode(tails).alias("i", "suffix")).join(suffixes.select("suffix"), "suffix")
    best = met.groupBy("name").agg(F.min(F.struct("i", "suffix", "labels")).alias("best"))
    label = F.get(F.col("best.labels"), F.col("best.i") - 1)
    found = best.select("name", F.col("best.suffix").alias("suffix"), F.when(label != "", F.concat_ws(".", label, F.col("best.suffix"))).alias("registrable"))
    return rows.join(found, rows[host] == found["name"], "left").drop("name")
