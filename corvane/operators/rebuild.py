"""Rebuilding a derived table, such as the graph, in pages: stopped at any page it goes on there, and readers see the old one until it is whole."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import whole_entries


def _note(spark: SparkSession, path: str, row: tuple, schema: str) -> None:
    """A one-row table; it counts once it is whole."""
    spark.createDataFrame([row], schema).coalesce(1).write.mode("overwrite").parquet(path)


class Rebuild:
    """The table in ``path``, a shared folder, by generations.

    ``started/N`` and ``current/N`` each name a generation; the highest whole entry counts. A generation has ``pages/N``, what was made of page N, and
    ``marks/N``, the last key of that page, which is written after it. A page without a mark is written anew, so a page that is
    broken off leaves nothing behind. To swap generations is to write one entry.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _named(self, kind: str) -> tuple[int, str | None]:
        entries = whole_entries(self.spark, f"{self.path}/{kind}")
        if not entries:
            return 0, None
        return entries[-1], self.spark.read.schema("generation string").parquet(f"{self.path}/{kind}/{entries[-1]}").first().generation

    def current(self) -> str | None:
        """The generation that readers see."""
        return self._named("current")[1]

    def open_generation(self) -> str:
        """The one that was begun and isn't current yet, or a new one."""
        number, begun = self._named("started")
        if begun is not None and begun not in self._finished():
            return begun
        fresh = uuid.uuid4().hex
        _note(self.spark, f"{self.path}/started/{number + 1}", (fresh,), "generation string")
        return fresh

    def _finished(self) -> set[str]:
        entries = whole_entries(self.spark, f"{self.path}/current")
        found = self.spark.read.schema("generation string").parquet(*[f"{self.path}/current/{n}" for n in entries]).collect() if entries else []
        return {r.generation for r in found}  # one a rebuild

    def run(self, source: DataFrame, key: str, build: Callable[[DataFrame], DataFrame], page_rows: int = 1_000_000, stop_after: int | None = None) -> bool:
        """Build page after page of ``source`` in the order of ``key``, and swap at the end; False if it stopped before, after ``stop_after`` pages.

        Pages are cut by key, and rows with one key are in one page. Null keys are in the first. ``build`` makes of a page what it adds to the table, and
        must not look at other pages. What is added to the source behind the watermark while it runs comes with the next rebuild.
        """
        generation = self.open_generation()
        base = f"{self.path}/generations/{generation}"
        marks = whole_entries(self.spark, f"{base}/marks")
        mark = self.spark.read.schema("upto long, rows long").parquet(f"{base}/marks/{marks[-1]}").first() if marks else None
        page, upto, column, done = (marks[-1] if marks else 0), mark.upto if mark else None, F.col(key), 0
        while True:
            ahead = source if upto is None else source.where(column > upto)
            end = ahead.select(column.alias("k")).where("k IS NOT NULL").orderBy("k").limit(page_rows).agg(F.max("k").alias("end")).first().end
            if end is None and not (page == 0 and not source.isEmpty()):
                break
            if stop_after is not None and done == stop_after:
                return False
            page, done = page + 1, done + 1
            first = column.isNull() if upto is None else F.lit(False)
            rows = ahead.where(first if end is None else first | (column <= end))
            build(rows).write.mode("overwrite").parquet(f"{base}/pages/{page}")
            upto = end if end is not None else -(1 << 63)
            _note(self.spark, f"{base}/marks/{page}", (upto, page_rows), "upto long, rows long")
        _note(self.spark, f"{self.path}/current/{self._named('current')[0] + 1}", (generation,), "generation string")
        return True

    def read(self, schema: str) -> DataFrame:
        """All pages of the current generation; no row if there is none."""
        generation = self.current()
        base = f"{self.path}/generations/{generation}"
        pages = whole_entries(self.spark, f"{base}/marks") if generation else []
        return self.spark.read.schema(schema).parquet(*[f"{base}/pages/{n}" for n in pages]) if pages else self.spark.createDataFrame([], schema)
