"""Joins that split hot keys, over tables written to the folder all executors share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corploom.functions.batches import bound_batches
from corploom.plans.tables import forget, new_path, written

__all__ = ["bound_batches", "forget", "lookup", "new_path", "shuffle_parts", "written"]

def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def lookup(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """Inner join of ``rows`` with a ``table`` of one row a key, whatever share of the rows one key holds.

    A key with more than 1/(4 P) of all rows is hot, P being the shuffle
    partitions: at most 4 P keys can be, so that part of the table is broadcast
    under a proven bound and its rows stay where they are.  The rest shuffles.
    ``rows`` is read three times, so it should be a written or cheap table.
    """
    parts = shuffle_parts(rows.sparkSession)
    n = rows.count()
    limit = max(n // (4 * parts), 1000)
    found = rows.groupBy(key).count().where(F.col("count") > limit).select(key).collect() if n > limit else []  # at most 4 P
    if not found:
        return rows.join(table, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(key).schema))
    warm = rows.join(hot, key, "left_semi").join(F.broadcast(table.join(hot, key, "left_semi")), key)
    cold = rows.join(hot, key, "left_anti").join(table, key)
    return warm.unionByName(cold)
