"""Broadcasts behind a check of size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a table that may be broadcast.
BROADCAST_ROWS = 2_000_000


def checked(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df, broadcast if it has no more rows than that, else as it is."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def held(df: DataFrame, value: Column, name: str, *others: str) -> DataFrame:
    """The other columns and a costly value, computed once for each row: filters and later columns do not go behind the generator that gives it."""
    return df.select(*others, F.explode(F.array(value)).alias(name))


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files give fewer splits than there are cores: a small table of long texts is work, not data."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
