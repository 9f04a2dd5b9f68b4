"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations only.

Every document of a source has the same expected number of copies, its source's target over its source's size. The whole
part is certain; the fraction is rounded so that the source's words are kept: two documents with fractions p and q and
sizes v and w exchange mass (v*dp + w*dq = 0) in a random direction until one of them is 0 or 1; the other goes on to the
next pair. A chunk of about FAN documents is folded this way within one row, its one residual moves up a level, and
FAN residuals make the next chunk, until one residual is left in a source. Only that one changes the source's words: it is
rounded to the nearer of 0 and 1, so a source misses its target by half of one document's size at most.

Defined cases: a null text has size 0 and is taken 0 times; null is a source of its own, the last; null doc_ids are
ordinary values; identical rows are rounded one by one; an empty table gives an empty result; other columns are ignored.
The result depends on the rows alone, not on their order or partitions.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: A word: no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE, CAP = 1.5, 2.0
#: Mean number of documents or residuals in a chunk.
FAN = 128


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, h (of the text), n: identical rows counted."""
    text = common.text_of()
    return docs.select("doc_id", "source", F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(text).alias("h")).groupBy("doc_id", "source", "size", "h").agg(F.count("*").alias("n"))


def targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size, n_docs, target: the share of all sizes by weight, none above cap times its source's size.

    What is cut off at a cap is shared again by weight until none is above, so target = min(cap, level * weight) with one
    level for all; over the sources ordered by cap / weight it is the first whose level no longer reaches its cap. One row
    for each source is all that meets here.
    """
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    whole = Window.partitionBy()
    per = sized.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.sum("n").alias("n_docs"))
    per = per.withColumn("w", F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(F.row_number().over(everything) - 1, F.lit(len(weights))) + 1).cast("int")))
    per = per.withColumns({"most": F.col("source_size") * F.lit(float(cap)), "ratio": F.col("source_size") * F.lit(float(cap)) / F.col("w"), "all": F.sum("source_size").over(whole) * F.lit(float(share))})
    before = F.coalesce(F.sum("most").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    per = per.withColumn("reach", (F.col("all") - before) / rest).withColumn("place", F.row_number().over(by_ratio))
    level = F.min(F.when(F.col("reach") <= F.col("ratio"), F.struct("place", "reach"))).over(whole)["reach"]
    return per.select("source", "source_size", "n_docs", F.coalesce(F.least("most", level * F.col("w")), "most").alias("target"))


def _pivot(acc: Column, x: Column) -> Column:
    """One exchange of mass between the residual so far and the next unit; what has become 0 or 1 joins done."""
    cur = acc["cur"]
    p, q, r = cur["p"], x["p"], x["w"] / cur["w"]
    up, down = F.least(1 - p, q * r), F.least(p, (1 - q) * r)
    rise = common.uniform(cur["h"], x["h"]) * (up + down) < down
    first = F.when(rise, 1 - p <= q * r).otherwise(p <= (1 - q) * r)
    within = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    with_p = lambda s, c: s.withField("p", within(c))
    second_moves = F.when(rise, q - (1 - p) / r).otherwise(q + p / r)
    first_moves = F.when(rise, p + q * r).otherwise(p - (1 - q) * r)
    left = F.when(first, with_p(x, second_moves)).otherwise(with_p(cur, first_moves))
    ended = F.when(first, with_p(cur, F.when(rise, 1.0).otherwise(0.0))).otherwise(with_p(x, F.when(rise, 0.0).otherwise(1.0)))
    return F.when(cur.isNull(), F.struct(x.alias("cur"), acc["done"].alias("done"))).otherwise(F.struct(left.alias("cur"), F.concat(acc["done"], F.array(ended)).alias("done")))


def _fold(units: DataFrame) -> DataFrame:
    """units: source, bucket, unit. A row for each bucket: done, and cur that is left."""
    kind = units.schema["unit"].dataType.simpleString()
    start = F.struct(F.lit(None).cast(kind).alias("cur"), F.array().cast(f"array<{kind}>").alias("done"))
    got = units.groupBy("source", "bucket").agg(F.aggregate(F.array_sort(F.collect_list("unit")), start, _pivot).alias("got"))
    return got.select("source", "bucket", "got.cur", "got.done")


def copies(sized: DataFrame, goals: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, source, size, h, i, source_size, target, copies: a row for each row of the documents."""
    rows = sized.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).drop("n")
    on = rows["source"].eqNullSafe(goals["source"])
    rows = rows.join(goals, on).drop(goals["source"])
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.withColumn("ratio", ratio).withColumn("whole", F.floor(F.col("ratio") + 1e-12)).withColumn("p", F.greatest(F.lit(0.0), F.col("ratio") - F.col("whole")))
    rows = rows.withColumn("open", (F.col("p") > 1e-12) & (F.col("size") > 0))
    about = F.struct("doc_id", "source", "size", "h", "i", "source_size", "target", "whole").alias("about")
    key = F.xxhash64("doc_id", "h", "i")
    buckets = F.ceil(F.col("n_docs") / F.lit(fan)).cast("long")
    units = rows.filter("open").select("source", F.pmod(key, buckets).alias("bucket"), F.struct(key.alias("h"), F.col("size").cast("double").alias("w"), F.col("p"), about).alias("unit"))
    most = goals.agg(F.max("n_docs")).first()[0] or 0
    level, buckets_left, ended = common.stored(_fold(units), "mix-level"), -(-most // fan), []
    ended.append(level.select(F.explode("done").alias("unit")))
    while buckets_left > 1:
        level = _fold(level.filter("cur is not null").select("source", F.floor(F.col("bucket") / F.lit(fan)).alias("bucket"), F.col("cur").alias("unit")))
        ended.append(level.select(F.explode("done").alias("unit")))
        buckets_left = -(-buckets_left // fan)
    lone = F.col("cur").withField("p", F.when(F.col("cur.p") >= 0.5, 1.0).otherwise(0.0))
    ended.append(level.filter("cur is not null").select(lone.alias("unit")))
    chosen = ended[0]
    for more in ended[1:]:
        chosen = chosen.unionByName(more)
    names = ["doc_id", "source", "size", "h", "i", "source_size", "target"]
    chosen = chosen.select(*[F.col(f"unit.about.{c}") for c in names], (F.col("unit.about.whole") + F.col("unit.p").cast("long")).alias("copies"))
    certain = rows.filter(~F.col("open")).select(*names, F.when(F.col("size") > 0, F.col("whole")).otherwise(F.lit(0)).cast("long").alias("copies"))
    return chosen.unionByName(certain)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP, fan: int = FAN) -> DataFrame:
    """How often each document is taken: see copies()."""
    sized = common.stored(sizes(docs), "mix-sizes")
    goals = common.stored(targets(sized, weights, share, cap), "mix-targets")
    return copies(sized, goals, fan)


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, with all their columns, whatever these are called.

    Of rows that share doc_id, source and text, those that sort first by their other columns are taken more often.
    """
    chosen = mix(docs.select("doc_id", "source", "text"), **options)
    per = chosen.groupBy("doc_id", "source", "h").agg(F.sort_array(F.collect_list("copies"), asc=False).alias("copies")).filter(F.col("copies")[0] > 0)
    names = docs.columns
    held = docs.select(F.col("doc_id").alias("a"), F.col("source").alias("b"), F.xxhash64(common.text_of()).alias("c"), F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)]).alias("row"))
    per = common.stored(per.select("doc_id", "source", "h", "copies"), "mix-copies")
    both = held.join(per, F.col("a").eqNullSafe(F.col("doc_id")) & (F.col("c") == F.col("h")) & F.col("b").eqNullSafe(F.col("source")))
    # rows that are alone need no order; the others are numbered by all that they hold
    alone = both.filter(F.size("copies") == 1).select("row", F.col("copies")[0].alias("times"))
    nth = F.row_number().over(Window.partitionBy("a", "b", "c").orderBy(F.xxhash64(F.to_json("row")), F.to_json("row")))
    several = both.filter(F.size("copies") > 1).withColumn("nth", nth).select("row", F.get("copies", F.col("nth") - 1).alias("times"))
    taken = alone.unionByName(several).withColumn("times", F.col("times").cast("int")).filter("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time")).select(*[F.col(f"row.c{k}").alias(c) for k, c in enumerate(names)])


def op5_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = mix(common.table(spark, sf_dir, "documents"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")
