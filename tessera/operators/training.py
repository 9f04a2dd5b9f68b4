"""Fitting and judging style models: n-gram vectors, logistic regression, backoff models, thresholds, audits."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import measures as M
from tessera.functions import text as T


def gram_counts(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, gram, tf: runs of n characters of the compact text."""
    c = F.col("c")
    rows = docs.select("doc_id", T.compact(F.col("text")).alias("c")).filter(F.length(c) >= n)
    each = F.transform(F.sequence(F.lit(1), F.length(c) - (n - 1)), lambda i: F.substring(c, i, F.lit(n)))
    return rows.select("doc_id", F.explode(each).alias("gram")).groupBy("doc_id", "gram").agg(F.count("*").alias("tf"))


def vectors(docs: DataFrame, vocabulary: DataFrame, n: int = 2) -> DataFrame:
    """doc_id, gram, x: 1 + ln tf over the length of the row, of the grams in the vocabulary alone."""
    rows = gram_counts(docs, n).join(vocabulary.select("gram"), "gram").withColumn("w", 1 + F.log("tf"))
    return rows.select("doc_id", "gram", (F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("doc_id")))).alias("x"))


def linear_score(vectors: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """doc_id, score: the sigmoid of the weighed sum. weights: gram, weight."""
    total = vectors.join(weights, "gram").groupBy("doc_id").agg(F.sum(F.col("x") * F.col("weight")).alias("z"))
    return total.select("doc_id", (1 / (1 + F.exp(-(F.col("z") + F.lit(float(bias)))))).alias("score"))


def fit_logistic(labelled: DataFrame, features: Sequence[str], regularisation: float = 0.0, weight: str | None = None) -> tuple[list[float], float]:
    """Coefficients and bias of a logistic regression. labelled: label (0 or 1) and the features as doubles."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=list(features), outputCol="x", handleInvalid="skip").transform(labelled)
    model = LogisticRegression(featuresCol="x", labelCol="label", regParam=regularisation, maxIter=100, **({"weightCol": weight} if weight else {})).fit(rows)
    return [float(v) for v in model.coefficients], float(model.intercept)


def pair_differences(rows: DataFrame, features: Sequence[str], most: int = 12) -> DataFrame:
    """label, features: within each group, one of label 1 less one of label 0 and the reverse; the first pairs by hash, so many a group."""
    side = lambda y: rows.filter(F.col("label") == y).select("group", F.col("id").alias(f"id{y}"), *[F.col(f).alias(f"{f}_{y}") for f in features], F.row_number().over(Window.partitionBy("group").orderBy(F.xxhash64("id"), "id")).alias(f"r{y}")).filter(F.col(f"r{y}") <= most)
    pairs = side(1).join(side(0), "group")
    order = F.row_number().over(Window.partitionBy("group").orderBy(F.col("r1") + F.col("r0"), "r1"))
    pairs = pairs.withColumn("r", order).filter(F.col("r") <= most)
    up = pairs.select("group", F.lit(1).alias("label"), *[(F.col(f"{f}_1") - F.col(f"{f}_0")).alias(f) for f in features])
    return up.unionByName(up.select("group", F.lit(0).alias("label"), *[(-F.col(f)).alias(f) for f in features]))


def sign_agreement(rows: DataFrame, feature: str) -> DataFrame:
    """domains, agreeing: how many domains there are, and how many show the sign that most do of the difference of label means. rows: domain, label, feature."""
    per = rows.groupBy("domain").agg((F.avg(F.when(F.col("label") == 1, F.col(feature))) - F.avg(F.when(F.col("label") == 0, F.col(feature)))).alias("gap")).filter("gap is not null")
    up, down = F.count_if(F.col("gap") > 0), F.count_if(F.col("gap") < 0)
    return per.agg(F.count("*").alias("domains"), F.greatest(up, down).alias("agreeing"))


def capped_groups(rows: DataFrame, cap: int) -> DataFrame:
    """domain, group: whole groups of a domain, in order of their hash, until the cap of rows is reached; the first one always. rows: domain, group."""
    sizes = rows.groupBy("domain", "group").agg(F.count("*").alias("n"))
    order = Window.partitionBy("domain").orderBy(F.md5(F.col("group").cast("string")), "group")
    taken = sizes.withColumn("before", F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n"))
    return taken.filter((F.col("before") == 0) | (F.col("before") + F.col("n") <= cap)).select("domain", "group", "n")


def bias_within(scored: DataFrame, per_mille: float = 2.0) -> float:
    """The least threshold that at most so many in a thousand of label 0 lie above. scored: score, label."""
    zero = scored.filter("label = 0")
    n = zero.count()
    allowed = int(n * per_mille / 1000)
    if not n:
        return 0.0
    top = zero.groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).limit(allowed + 1).collect()  # distinct scores, as many as may lie above and one
    above = 0
    for r in top:
        if above + r.n > allowed:
            return float(r.score)
        above += r.n
    return float(top[-1].score)


def criterion(rows: DataFrame, value: str, factor: float = 1.0) -> DataFrame:
    """mean, sd, sign, weight, auc, p50, p90 of a value: human rows are label 0. The weight is half the gap in deviations, between 0.15 and 1."""
    from . import calibration

    zero = F.when(F.col("label") == 0, F.col(value))
    one = F.when(F.col("label") == 1, F.col(value))
    sums = rows.agg(F.avg(zero).alias("mean"), F.stddev_pop(zero).alias("sd"), F.avg(one).alias("other"), F.percentile_approx(zero, 0.5).alias("p50"), F.percentile_approx(zero, 0.9).alias("p90"))
    auc = calibration.auc(rows.select(F.col(value).alias("score"), "label")).select("auc")
    gap = F.try_divide(F.abs(F.col("other") - F.col("mean")), F.col("sd"))
    return sums.crossJoin(F.broadcast(auc)).select("mean", "sd", F.when(F.col("other") >= F.col("mean"), 1).otherwise(-1).alias("sign"), F.least(F.lit(1.0), F.greatest(F.lit(0.15), gap / 2)).alias("raw"), "auc", "p50", "p90").withColumn("weight", F.col("raw") * F.lit(float(factor))).drop("raw")  # one row each


def floor_percentile(rows: DataFrame, key: str, value: str, share: float, place: Callable[[Column], Column] = F.floor) -> DataFrame:
    """key, value: the one at the floored place of each key's sorted values, nulls last. Values are counted first, so equal ones are one row.

    place: what makes a place of the share of the rows, where it is not floored."""
    per = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    order = Window.partitionBy(key).orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, 0)
    per = per.withColumns({"to": F.sum("n").over(order), "all": F.sum("n").over(Window.partitionBy(key))})
    at = F.least(place(F.col("all") * F.lit(share)).cast("long"), F.col("all") - 1)
    return per.filter((F.col("to") > at) & (F.col("to") - F.col("n") <= at)).select(key, value)


def top_terms(lexicon: DataFrame, most: int) -> DataFrame:
    """The words of highest and lowest log odds, so many a side. lexicon: calibration.log_odds()."""
    high = lexicon.orderBy(F.desc("log_odds"), "w").limit(most).withColumn("side", F.lit(1))
    low = lexicon.orderBy("log_odds", "w").limit(most).withColumn("side", F.lit(0))
    return high.unionByName(low)


def lexicon_score(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """doc_id, score: the mean log odds of a document's words that are terms, 0 for none."""
    rows = docs.select("doc_id", F.explode_outer(T.words(F.col("text"))).alias("w")).join(F.broadcast(terms.select("w", "log_odds")), "w", "left")  # as many terms as were asked for
    return rows.groupBy("doc_id").agg(F.coalesce(F.avg("log_odds"), F.lit(0.0)).alias("score"))


def backoff_counts(docs: DataFrame, least: tuple[int, int, int] = (1, 2, 2)) -> DataFrame:
    """gram, n, size: runs of 1, 2 and 3 characters in all texts, those that come so often."""
    out = None
    for n, floor in enumerate(least, 1):
        own = gram_counts(docs, n).groupBy("gram").agg(F.sum("tf").alias("n")).filter(F.col("n") >= floor).withColumn("size", F.lit(n))
        out = own if out is None else out.unionByName(own)
    return out


def backoff_bits(docs: DataFrame, model: DataFrame, penalty: float = 0.4, unknown: float = 20.0) -> DataFrame:
    """doc_id, bits: bits a character, each by the longest run before it that the model holds, every step back weighed by penalty."""
    total = model.filter("size = 1").agg(F.sum("n").alias("all"))
    c = F.col("c")
    rows = docs.select("doc_id", T.compact(F.col("text")).alias("c")).filter(F.length(c) > 0)
    at = rows.select("doc_id", "c", F.explode(F.sequence(F.lit(1), F.length(c))).alias("i"))
    run = lambda k: F.when(F.col("i") >= k, F.substring(c, F.col("i") - (k - 1), F.lit(k)))
    at = at.select("doc_id", run(1).alias("g1"), run(2).alias("g2"), run(3).alias("g3"), F.substring(run(2), 1, 1).alias("h1"), F.substring(run(3), 1, 2).alias("h2"))
    per = at.groupBy("doc_id", "g1", "g2", "g3", "h1", "h2").agg(F.count("*").alias("times"))
    of = lambda name: model.select(F.col("gram").alias(name), F.col("n").alias(f"n_{name}"))
    for name in ("g1", "g2", "g3", "h1", "h2"):
        per = per.join(of(name), name, "left")
    per = per.crossJoin(F.broadcast(total))  # one row
    p = F.when(F.col("n_g3").isNotNull() & F.col("n_h2").isNotNull(), F.col("n_g3") / F.col("n_h2")).when(F.col("n_g2").isNotNull() & F.col("n_h1").isNotNull(), penalty * F.col("n_g2") / F.col("n_h1")).when(F.col("n_g1").isNotNull(), penalty * penalty * F.col("n_g1") / F.col("all"))
    cost = F.coalesce(-F.log2(F.least(p, F.lit(1.0))), F.lit(unknown))
    return per.groupBy("doc_id").agg((F.sum(cost * F.col("times")) / F.sum("times")).alias("bits"))


def sign_test(gain: int, loss: int) -> float:
    """Two-sided probability of a split at least as uneven under a fair coin."""
    n = gain + loss
    tail = sum(math.comb(n, k) for k in range(min(gain, loss) + 1))
    return min(1.0, 2 * tail / 2**n) if n else 1.0


def rule_audit(rows: DataFrame, rules: dict[str, str]) -> list[tuple[str, float, float, float]]:
    """rule, rate in label 1, rate in label 0, sign test of pairs by group. rows: group, label, text; rules: name -> pattern."""
    hit = [F.max(F.when(F.col("label") == y, T.folded(F.col("text")).rlike(p).cast("int"))).alias(f"{n}_{y}") for n, p in rules.items() for y in (1, 0)]
    per = rows.groupBy("group").agg(*hit)
    sums = per.agg(*[e for n in rules for e in (F.avg(f"{n}_1").alias(f"{n}_r1"), F.avg(f"{n}_0").alias(f"{n}_r0"), F.count_if(F.col(f"{n}_1") > F.col(f"{n}_0")).alias(f"{n}_g"), F.count_if(F.col(f"{n}_1") < F.col(f"{n}_0")).alias(f"{n}_l"))]).first()
    return [(n, sums[f"{n}_r1"] or 0.0, sums[f"{n}_r0"] or 0.0, sign_test(sums[f"{n}_g"], sums[f"{n}_l"])) for n in rules]


def outliers(rows: DataFrame, line: float = 2.0) -> DataFrame:
    """doc_id, place, z: parts of a document whose score lies so many deviations from its mean. rows: doc_id, place, score."""
    own = Window.partitionBy("doc_id")
    z = F.try_divide(F.col("score") - F.avg("score").over(own), F.stddev_pop("score").over(own))
    return rows.select("doc_id", "place", z.alias("z")).filter(F.abs("z") > line)


def chunks(text: str, low: int, high: int) -> list[str]:
    """A text in stretches of low to high characters that end with a sentence; a longer sentence stands alone, a short rest joins the last one."""
    out: list[str] = []
    held = ""
    for a, b in M.sentence_spans(text):
        own = text[a:b]
        if held and len(held) + len(own) > high:
            out.append(held)
            held = ""
        held += own
        if len(held) >= low:
            out.append(held)
            held = ""
    if held:
        if out and len(out[-1]) + len(held) <= high:
            out[-1] += held
        else:
            out.append(held)
    return out


def perturbed(text: str, mode: str, seed: int = 0) -> str:
    """Sentences merged in twos, split at their commas, or cut to one length: what a robust score must bear."""
    r = random.Random(seed)
    parts = [text[a:b] for a, b in M.sentence_spans(text)]
    if mode == "merge":
        joined = [p[:-1] + "，" if k % 2 == 0 and k + 1 < len(parts) and p[-1:] in "。.!！?？" else p for k, p in enumerate(parts)]
        return "".join(joined)
    if mode == "split":
        return "".join(p.replace("，", "。", 1) if r.random() < 0.5 else p for p in parts)
    if mode == "equal":
        plain = "".join(p.rstrip("。.!！?？") for p in parts)
        size = max(1, round(len(plain) / max(1, len(parts))))
        return "".join(plain[k : k + size] + "。" for k in range(0, len(plain), size))
    raise ValueError(f"no such mode: {mode}")
