"""Gets this package to the Python workers of any cluster."""

from __future__ import annotations

import functools
import os
import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

_SHIPPED: set[str] = set()


def ship(spark) -> None:
    """Hand the package to Spark's file server once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    root = Path(__file__).resolve().parent
    archive = os.path.join(tempfile.mkdtemp(prefix="corvane-"), "corvane.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    context.addPyFile(archive)


def shipped(query: Callable) -> Callable:
    """``query``, with the package shipped before it runs."""

    @functools.wraps(query)
    def run(spark, sf_dir):
        ship(spark)
        return query(spark, sf_dir)

    return run
