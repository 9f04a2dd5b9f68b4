"""Judging scores against labels, and sampling by stratum."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

BUCKETS = 256


def auc(scored: DataFrame) -> DataFrame:
    """n_pos, n_neg, auc: one row, ties counted half. scored: score, label (0 or 1).

    Rows are summed by score first. A running count over all scores would sort them in one task, so scores go to buckets
    between BUCKETS quantiles; only the buckets' totals, a bounded number, meet in one task."""
    per = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    bounds = scored.agg(F.percentile_approx("score", [k / BUCKETS for k in range(1, BUCKETS)]).alias("bounds"))
    cut = per.crossJoin(F.broadcast(bounds)).withColumn("bucket", F.size(F.filter("bounds", lambda x: x < F.col("score")))).drop("bounds")  # one row
    total = cut.groupBy("bucket").agg(F.sum("neg").alias("own"))
    total = total.select("bucket", (F.sum("own").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own")).alias("before"))
    within = F.sum("neg").over(Window.partitionBy("bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, 0)) - F.col("neg")
    rows = cut.withColumn("within", within).join(F.broadcast(total), "bucket")
    won = F.sum(F.col("pos") * (F.col("before") + F.col("within") + F.col("neg") / 2.0))
    sums = rows.agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"), won.alias("won"))
    return sums.select("n_pos", "n_neg", F.round(F.try_divide(F.col("won"), F.col("n_pos").cast("double") * F.col("n_neg")), 6).alias("auc"))


def operating_point(scored: DataFrame, share: float = 0.01) -> DataFrame:
    """threshold, false_share, hit_share: the score above which so large a share of label 0 lies, and what of each label it takes."""
    line = scored.filter("label = 0").agg(F.percentile("score", 1 - share).alias("threshold"))
    above = F.col("score") > F.col("threshold")
    part = lambda label: F.round(F.try_divide(F.count_if(above & (F.col("label") == label)), F.count_if(F.col("label") == label)), 6)
    return scored.crossJoin(F.broadcast(line)).groupBy("threshold").agg(part(0).alias("false_share"), part(1).alias("hit_share"))  # one row


def log_odds(labelled: DataFrame) -> DataFrame:
    """w, n1, n0, log_odds: add-one log odds of each word between the labels. labelled: text, label."""
    words = labelled.select("label", F.explode(T.words(F.col("text"))).alias("w"))
    per = words.groupBy("w").agg(F.count_if(F.col("label") == 1).alias("n1"), F.count_if(F.col("label") == 0).alias("n0"))
    whole = per.agg(F.sum("n1").alias("all1"), F.sum("n0").alias("all0"), F.count("*").alias("kinds"))
    side = lambda n, of: F.ln((F.col(n) + 1.0) / (F.col(of) + F.col("kinds")))
    return per.crossJoin(F.broadcast(whole)).select("w", "n1", "n0", (F.round(side("n1", "all1") - side("n0", "all0"), 6) + 0.0).alias("log_odds"))  # one row


def reject_reason(docs: DataFrame) -> DataFrame:
    """doc_id, reason: the first filter that a document fails, kept if none."""
    text = F.coalesce("text", F.lit(""))
    size = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    n, letters, digits = size(r"[\x09-\x0D\x20]"), F.length(T.compact(text)), size("[^0-9]")
    reason = F.when(n < 60, "short").when(n > 50000, "long").when(F.lower(text).rlike("https?:|doi[.]org"), "link").when(10 * digits > 3 * n, "digits").when(10 * letters < 6 * n, "letters").otherwise("kept")
    return docs.select("doc_id", reason.alias("reason"))


def quota(docs: DataFrame, most: int = 3) -> DataFrame:
    """doc_id, source, band: so many documents of each source and length band, the least by hash."""
    band = F.expr("case when n_chars < 500 then 0 when n_chars < 2000 then 1 when n_chars < 8000 then 2 else 3 end")
    rows = docs.select("doc_id", "source", band.alias("band"))
    r = F.row_number().over(Window.partitionBy("source", "band").orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id"))
    return rows.withColumn("r", r).filter(F.col("r") <= most).drop("r")
