"""Structured Streaming forms of the library's import and of event counts.

State is bounded by the watermark: what is older than it has been dropped, and so has the state that waited for it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.library import body_hash


def first_seen(texts: DataFrame, late: str = "1 hour") -> DataFrame:
    """texts (ts, text) with body_hash: of copies that arrive within so much time of each other, the first."""
    return texts.withColumn("body_hash", body_hash(F.col("text"))).withWatermark("ts", late).dropDuplicatesWithinWatermark(["body_hash"])


def windowed(events: DataFrame, size: str = "10 minutes", slide: str | None = None, late: str = "30 minutes") -> DataFrame:
    """start, event_type, n, total: events (ts, event_type, value) by windows of their time; later ones than allowed are left out."""
    per = events.withWatermark("ts", late).groupBy(F.window("ts", size, slide), "event_type")
    return per.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "30 minutes") -> DataFrame:
    """user_id, start, end, n: runs of a user's events with no longer pause."""
    per = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id")
    return per.agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")
