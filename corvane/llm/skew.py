"""Joins in which no key gathers more than a small part of the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key that has over one HOT_SHARE-th of all rows is broadcast; so fewer than HOT_SHARE are, whatever the data.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, keyed: DataFrame, key: str, n_col: str, n_rows: int) -> DataFrame:
    """``rows`` with the columns of ``keyed`` (one row a key; ``n_col``: rows that have it, or fewer where only some of them matter).

    ``n_rows`` is the number of ``rows``. Frequent keys meet their rows in place, the others in a shuffle that no frequent key is part
    of. Both tables are read more than once, so they should be written ones.
    """
    bound = n_rows / HOT_SHARE
    hot = F.broadcast(keyed.where(F.col(n_col) > bound))
    cold = keyed.where(F.col(n_col) <= bound)
    return rows.join(hot, key).unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key))
