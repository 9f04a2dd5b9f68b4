"""Hits of documents in a bounded set of sources: where they stand, how they join, who owns a place, and the ledgers made of them.

A hit is a row: the document, start and end in its compared characters, the source, a score."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import similarity, spans

GAP, SHORTEST = 2, 3
#: Kinds of evidence, the stronger first.
PRIORITY = ("duplicate", "rewritten", "machine", "suspected")


def placed(table: DataFrame, key: str) -> DataFrame:
    """The fragments of a table with their places: start and end among all characters of its fragments."""
    rows = similarity.fragments(table, key)
    order = Window.partitionBy(key).orderBy("at", "fragment").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("end", F.sum("size").over(order)).withColumn("start", F.col("end") - F.col("size"))


def verbatim(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """doc_id, start, end, source, score: fragments that stand in a source too, the least source for each."""
    known = similarity.fragments(sources, "item_id").groupBy("fragment").agg(F.min("item_id").alias("source"))
    return placed(docs, "doc_id").join(known, "fragment").select("doc_id", "start", "end", "source", F.lit(1.0).alias("score"))


def coalesced(hits: DataFrame, gap: int = GAP) -> DataFrame:
    """Hits of one source that follow each other at most gap apart become one: the score weighed by length."""
    order = Window.partitionBy("doc_id").orderBy("start", "end", "source")
    same = (F.lag("source").over(order) == F.col("source")) & (F.col("start") - F.lag("end").over(order) <= gap)
    rows = hits.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    size = F.col("end") - F.col("start")
    return rows.groupBy("doc_id", "run", "source").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n_hits"), (F.sum(F.col("score") * size) / F.sum(size)).alias("score")).drop("run")


def disputed(hits: DataFrame) -> DataFrame:
    """doc_id, places: how many places more than one source claims."""
    own = spans.merge(hits.select(F.concat_ws("\x00", F.col("doc_id").cast("string"), F.col("source").cast("string")).alias("k"), "start", "end"), "k")
    claims = own.select(F.substring_index("k", "\x00", 1).cast("long").alias("doc_id"), "start", "end", F.lit("n").alias("kind"))
    return spans.pieces(claims, "doc_id", ["n"]).filter("n > 1").groupBy("doc_id").agg(F.sum(F.col("end") - F.col("start")).cast("long").alias("places"))


def tiled(evidence: DataFrame, key: str, shortest: int = SHORTEST) -> DataFrame:
    """key, start, end, kind: each place belongs to the strongest kind that covers it; bands shorter than so many places go. evidence: key, start, end, kind."""
    cut = spans.pieces(evidence, key, list(PRIORITY))
    kind = F.coalesce(*[F.when(F.col(k) > 0, F.lit(k)) for k in PRIORITY])
    rows = cut.withColumn("kind", kind).filter("kind is not null")
    order = Window.partitionBy(key).orderBy("start")
    same = (F.lag("kind").over(order) == F.col("kind")) & (F.lag("end").over(order) == F.col("start"))
    rows = rows.withColumn("new", F.when(same, 0).otherwise(1)).withColumn("band", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    bands = rows.groupBy(key, "band", "kind").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("band")
    return bands.filter(F.col("end") - F.col("start") >= shortest)


def ledger(hits: DataFrame) -> DataFrame:
    """source, chars, n_hits, n_docs, longest, best: what each source accounts for."""
    size = F.col("end") - F.col("start")
    return hits.groupBy("source").agg(F.sum(size).cast("long").alias("chars"), F.count("*").alias("n_hits"), F.countDistinct("doc_id").alias("n_docs"), F.max(size).cast("long").alias("longest"), F.round(F.max("score"), 6).alias("best"))


def folded(ledger: DataFrame, top: int = 10) -> DataFrame:
    """source (null for the others), chars, n_sources: the rows of most characters, and one for all others."""
    first = ledger.orderBy(F.desc("chars"), "source").limit(top).select(F.col("source").alias("named"))
    rows = ledger.join(F.broadcast(first), F.col("source") == F.col("named"), "left")  # so many rows at most
    return rows.groupBy(F.col("named").alias("source")).agg(F.sum("chars").alias("chars"), F.count("*").alias("n_sources"))
