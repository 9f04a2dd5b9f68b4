"""Interval algebra on (key, start, end) rows, half-open, by window functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge(spans: DataFrame, key: str) -> DataFrame:
    """Overlapping and touching spans of a key joined into islands; empty and inverted ones are dropped."""
    order = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.filter("end > start").withColumn("new", F.when(F.col("start") <= reach, 0).otherwise(1))
    rows = rows.withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(key, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def covered(spans: DataFrame, key: str) -> DataFrame:
    """How much of each key its spans cover."""
    return merge(spans, key).groupBy(key).agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("covered"))


def intersect(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What both sides cover, in the pieces in which they do."""
    a, b = merge(left, key), merge(right, key).withColumnsRenamed({"start": "start2", "end": "end2"})
    both = a.join(b, key).withColumns({"low": F.greatest("start", "start2"), "high": F.least("end", "end2")}).filter("high > low")
    return both.select(key, F.col("low").alias("start"), F.col("high").alias("end"))


def merge_near(spans: DataFrame, key: str, gap: int) -> DataFrame:
    """merge() that also bridges gaps of so many places."""
    rows = merge(spans.select(key, "start", (F.col("end") + gap).alias("end")).filter(F.col("end") - gap > F.col("start")), key)
    return rows.withColumn("end", F.col("end") - gap)


def pieces(spans: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """key, start, end and for each kind how many of its spans cover the piece: every stretch between two ends. spans: key, start, end, kind."""
    real = spans.filter("end > start")
    ends = real.select(key, "kind", F.col("start").alias("at"), F.lit(1).alias("step")).unionByName(real.select(key, "kind", F.col("end").alias("at"), F.lit(-1).alias("step")))
    steps = ends.groupBy(key, "at").agg(*(F.sum(F.when(F.col("kind") == k, F.col("step")).otherwise(0)).alias(k) for k in kinds))
    order = Window.partitionBy(key).orderBy("at")
    running = order.rowsBetween(Window.unboundedPreceding, 0)
    return steps.select(key, F.col("at").alias("start"), F.lead("at").over(order).alias("end"), *(F.sum(k).over(running).alias(k) for k in kinds)).filter("end is not null")


def subtract(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """What the left side covers and the right side does not."""
    both = left.select(key, "start", "end", F.lit("l").alias("kind")).unionByName(right.select(key, "start", "end", F.lit("r").alias("kind")))
    return merge(pieces(both, key, ["l", "r"]).filter("l > 0 and r = 0").select(key, "start", "end"), key)


def ledger(spans: DataFrame, key: str) -> DataFrame:
    """key, total, excluded, duplicate, cited, own: places from 0 to the last end, in buckets that exclude each other and add up.

    kind: excluded goes before duplicate; cited counts the places of duplicate that citations cover too."""
    size = F.col("end") - F.col("start")
    of = lambda condition, name: F.sum(F.when(F.expr(condition), size).otherwise(0)).cast("long").alias(name)
    sums = pieces(spans, key, ["excluded", "duplicate", "cited"]).groupBy(key).agg(F.max("end").cast("long").alias("total"), of("excluded > 0", "excluded"), of("excluded = 0 and duplicate > 0", "duplicate"), of("excluded = 0 and duplicate > 0 and cited > 0", "cited"))
    return sums.withColumn("own", F.col("total") - F.col("excluded") - F.col("duplicate"))


def attributed(spans: DataFrame, key: str, claimant: str) -> DataFrame:
    """key, claimant, places: each place goes to the first span that covers it, in order of start, end and claimant.

    What earlier spans cover of a later one is a stretch from its start on, so one running maximum tells what is left of it."""
    order = Window.partitionBy(key).orderBy("start", "end", claimant).rowsBetween(Window.unboundedPreceding, -1)
    rows = spans.filter("end > start").withColumn("taken", F.coalesce(F.max("end").over(order), F.col("start")))
    left = rows.withColumn("left", F.col("end") - F.greatest("start", "taken")).filter(F.col("left") > 0)
    return left.groupBy(key, claimant).agg(F.sum("left").cast("long").alias("places"))
