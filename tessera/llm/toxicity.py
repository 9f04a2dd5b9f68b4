"""Toxic passages by maximum-scoring segment search.

A token is a word; what is known of it is known of its forms, the word itself and its first 4, 5 and 6 letters, since many
languages inflect or compound a toxic stem. For each form the log-odds of toxic against clean documents have a Dirichlet
prior: ALPHA pseudo-documents dealt to the classes by their size, so that an unseen form says nothing. A form counts by its
lower confidence bound, the log-odds moved SURE standard errors towards 0, and a token by its form that says most. Less a
drift, so that ordinary text scores below 0, token scores are searched in linear time for all maximal segments. The best
segments of a clean text of n tokens follow an extreme-value law, P(S > s) = 1 - exp(-K n exp(-lambda s)); lambda solves
E[exp(lambda score)] = 1 over clean documents' tokens and K fits their best segments. A segment is significant where its
expected number is below SIGNIFICANT; a document's evidence is the least P-value of its r best segments together, and
monotone bins of it, fitted on the training rows, give the score by linear interpolation.

Forms are counted in 2^BITS hash buckets, so the model that is broadcast has a fixed bound, and it is fitted on at most
FIT_ROWS labelled rows, those with the smallest hash of doc_id. Everything is scored, whole.

Defined cases: null and empty texts have no tokens and no evidence and get the score of the least evidence; labels that are
null are left out and repeated ones count as toxic if one is; with no labels of either kind every score is 0; null and
repeated doc_ids are scored row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS, FIT_ROWS = 20, 200_000
ALPHA, SURE, DRIFT = 1.0, 2.0, 0.5
SIGNIFICANT, THRESHOLD = 0.01, 0.7
#: Bins of evidence, two for each unit of -ln P.
BINS = 128
WORD = re.compile(r"[^\W\d_]+")
REMEMBERED = 600_000
MASK = (1 << BITS) - 1
SCORED = "doc_id long, text_key long, tokens long, evidence double, best double, passages array<struct<start:int,end:int,expected:double>>"


class Model(NamedTuple):
    buckets: np.ndarray
    values: np.ndarray
    rate: float
    log_k: float

    def table(self) -> dict[int, float]:
        return dict(zip(self.buckets.tolist(), self.values.astype(float).tolist(), strict=True))


def forms(word: str) -> list[int]:
    """The buckets of a word's forms."""
    n = len(word)
    own = (word,) if n < 4 else (word, word[:4] + "*") if n == 4 else (word, word[:4] + "*", word[:5] + "*") if n == 5 else (word, word[:4] + "*", word[:5] + "*", word[:6] + "*")
    return [zlib.crc32(x.encode()) & MASK for x in own]


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, sum) of a sequence, in one pass over its positive scores (Ruzzo and Tompa)."""
    sums = np.concatenate([[0.0], np.cumsum(scores, dtype=float)])
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum after, nearest earlier with a smaller sum before
    for at in np.flatnonzero(scores > 0).tolist():
        start, left, right = at, float(sums[at]), float(sums[at + 1])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, at + 1, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, right - left) for a, b, left, right, _ in found]


def spans_of_words(text: str, low: str) -> list[tuple[int, int]]:
    """Where in text the words of its lower case form stand; a character may have a longer one."""
    spans = [m.span() for m in WORD.finditer(low)]
    if len(low) == len(text):
        return spans
    starts = list(accumulate((len(c.lower()) for c in text), initial=0))
    return [(bisect_right(starts, a) - 1, bisect_left(starts, b)) for a, b in spans]


def evidence(sums: list[float], tokens: int, model: Model) -> float:
    """-ln of the least P-value of the r best segments together, over all r (Karlin and Altschul)."""
    best = total = 0.0
    base = model.log_k + math.log(max(tokens, 1))
    for r, s in enumerate(sorted(sums, reverse=True), 1):
        total += model.rate * s - base
        if r == 1:
            best = max(best, -math.log(-math.expm1(-math.exp(min(-total, 30.0)))) if total < 30 else total)
        else:
            t = total + math.lgamma(r + 1)
            if t <= r * (r + 1):  # the tail formula holds beyond this
                break
            best = max(best, t - (r - 1) * math.log(t) + math.lgamma(r + 1) + math.lgamma(r))
    return best


def split(doc_id: Column) -> Column:
    """The fold of a document: rows of fold 1 are held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)), F.lit(0))


def _counted(rows: DataFrame) -> DataFrame:
    """bucket, toxic, clean: documents with a form, by label. rows: text, toxic."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, known = np.zeros((2, 1 << BITS), dtype=np.int64), {}
        for batch in batches:
            for text, toxic in zip(batch["text"], batch["toxic"], strict=True):
                own: set[int] = set()
                for w in set(WORD.findall(text.lower())):
                    if (got := known.get(w)) is None:
                        if len(known) > REMEMBERED:
                            known.clear()
                        got = known[w] = forms(w)
                    own.update(got)
                counts[int(toxic), list(own)] += 1
        known.clear()
        common.trim()
        at = np.flatnonzero(counts.any(axis=0))
        for k in range(0, len(at), 1 << 17):
            some = at[k : k + (1 << 17)]
            yield pd.DataFrame({"bucket": some, "toxic": counts[1, some], "clean": counts[0, some]})

    return rows.mapInPandas(kernel, "bucket long, toxic long, clean long").groupBy("bucket").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def labelled(labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, toxic of the rows that may be learnt from: not held out, and at most fit_rows."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    return rows.filter(split(F.col("doc_id")) != 1).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)


def fit(docs: DataFrame, rows: DataFrame) -> Model | None:
    """The token model without K. rows: labelled(); their number is bounded, so they are broadcast."""
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text"))
    counts = common.stored(_counted(text.join(F.broadcast(rows), "doc_id").select("text", "toxic")), "toxic-counts")
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    if not total.t or not total.c:
        return None
    n1, n0 = float(total.t), float(total.c)
    a1, a0 = ALPHA * n1 / (n1 + n0), ALPHA * n0 / (n1 + n0)
    odds = lambda y, a, n: F.log((F.col(y) + a) / (F.lit(n) - F.col(y) + ALPHA))
    delta = odds("toxic", a1, n1) - odds("clean", a0, n0)
    error = F.sqrt(1 / (F.col("toxic") + a1) + 1 / (F.col("clean") + a0))
    weighed = counts.select("bucket", "clean", (F.signum(delta) * F.greatest(F.lit(0.0), F.abs(delta) - SURE * error)).alias("value")).filter("value <> 0")
    kept = weighed.toPandas()
    values, p = kept["value"].to_numpy(float), (kept["clean"].to_numpy(float) + a0) / n0
    if not (values > DRIFT).any():
        return Model(kept["bucket"].to_numpy(np.int64), values.astype(np.float32), 1.0, 0.0)
    rest = max(0.0, 1 - p.sum())
    low, high = 1e-4, 30.0
    for _ in range(60):
        mid = (low + high) / 2
        over = (p * np.exp(np.minimum(mid * (values - DRIFT), 500.0))).sum() + rest * math.exp(-mid * DRIFT) > 1
        low, high = (low, mid) if over else (mid, high)
    return Model(kept["bucket"].to_numpy(np.int64), values.astype(np.float32), low, 0.0)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, tokens, evidence, best (segment), passages: the significant ones, code points, and their expected number."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.value
        weight, known = model.table().get, {}

        def value(w: str) -> float:
            most = 0.0
            for b in forms(w):
                if (v := weight(b)) is not None and abs(v) > abs(most):
                    most = v
            return most - DRIFT

        for batch in batches:
            out = []
            for doc, key, text in zip(batch["doc_id"], batch["text_key"], batch["text"], strict=True):
                low = text.lower()
                words = WORD.findall(low)
                try:
                    scores = [known[w] for w in words]
                except KeyError:
                    if len(known) > REMEMBERED:
                        known.clear()
                    for w in words:
                        if w not in known:
                            known[w] = value(w)
                    scores = [known[w] for w in words]
                if not scores or max(scores) <= 0:
                    out.append((doc, key, len(words), 0.0, 0.0, []))
                    continue
                segments = maximal_segments(np.array(scores))
                expected = [math.exp(min(700.0, model.log_k + math.log(len(words)) - model.rate * s)) for _, _, s in segments]
                passages = []
                if min(expected) < SIGNIFICANT:
                    places = spans_of_words(text, low)
                    passages = [{"start": places[a][0], "end": places[b - 1][1], "expected": e} for (a, b, _), e in zip(segments, expected, strict=True) if e < SIGNIFICANT]
                sums = [s for _, _, s in segments]
                out.append((doc, key, len(words), evidence(sums, len(words), model), max(sums), passages))
            made = pd.DataFrame(out, columns=["doc_id", "text_key", "tokens", "evidence", "best", "passages"])
            yield made.assign(doc_id=made["doc_id"].astype("Int64"))
        common.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(common.text_of()).alias("text_key"), common.text_of().alias("text")).mapInPandas(kernel, SCORED)


def with_k(found: DataFrame, rows: DataFrame, model: Model) -> Model:
    """K from the best segments of clean training documents: lambda S - ln n has the mean ln K + Euler's constant."""
    clean = found.filter("best > 0").join(F.broadcast(rows.filter("toxic = 0")), "doc_id")
    mean = clean.agg(F.avg(F.lit(model.rate) * F.col("best") - F.log("tokens"))).first()[0]
    return model._replace(log_k=0.0 if mean is None else mean - 0.5772156649)


def calibrated(found: DataFrame, rows: DataFrame) -> list[float]:
    """The score of each bin of evidence: the toxic share of the training rows in it, pooled until it rises."""
    bins = found.join(F.broadcast(rows), "doc_id").groupBy(_bin().alias("bin")).agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).orderBy("bin").collect()
    n, t = sum(r.n for r in bins), sum(r.t for r in bins)
    if not t:
        return [0.0] * BINS
    pools: list[list[float]] = []  # weight, toxic, first and last bin
    for r in bins:
        pools.append([r.n, r.t, r.bin, r.bin])
        while len(pools) > 1 and pools[-2][1] / pools[-2][0] >= pools[-1][1] / pools[-1][0]:
            last = pools.pop()
            pools[-1] = [pools[-1][0] + last[0], pools[-1][1] + last[1], pools[-1][2], last[3]]
    at, share = [], []
    for w, y, first, last in pools:
        at += [first, last] if last > first else [first]
        share += [(y + t / n) / (w + 1)] * (2 if last > first else 1)
    return np.maximum.accumulate(np.interp(range(BINS), at, share)).tolist()


def _bin() -> Column:
    return F.least(F.floor(F.col("evidence") * 2), F.lit(BINS - 1)).cast("int")


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, passages, text_key (xxhash64) of every document."""
    common.ship(docs.sparkSession)
    rows = common.stored(labelled(labels, fit_rows), "toxic-rows")
    model = fit(docs, rows)
    if model is None:
        model = Model(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.float32), 1.0, 0.0)
    docs = docs.select("doc_id", "text")
    train = docs.join(F.broadcast(rows.select(F.col("doc_id").alias("train"))), F.col("doc_id").cast("long") == F.col("train"), "left_semi")
    model = with_k(scored(train, model), rows, model)
    found = common.stored(scored(docs, model), "toxic-scored")
    shares = calibrated(found, rows)
    share = F.array(*map(F.lit, [*shares, shares[-1]]))
    low, high = F.element_at(share, _bin() + 1), F.element_at(share, _bin() + 2)
    score = low + (high - low) * F.least(F.lit(1.0), F.col("evidence") * 2 - _bin())
    return found.select("doc_id", (split(F.col("doc_id")) == 1).alias("held_out"), score.alias("score"), (score >= THRESHOLD).cast("int").alias("predicted"), "evidence", "passages", "text_key")


def clean(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs with all their columns, whatever these are called, without those that are predicted toxic.

    The decision is kept by doc_id and text, so rows that share a doc_id, or have none, are each judged by their own text.
    """
    one, two, bad_one, bad_two = common.free_names(["id", "key", "bad_id", "bad_key"], docs.columns)
    found = toxicity(docs, labels, **options).filter("predicted = 1").select(F.col("doc_id").alias(bad_one), F.col("text_key").alias(bad_two)).distinct()
    bad = common.stored(found, "toxic-ids")
    keyed = docs.withColumns({one: F.col("doc_id").cast("long"), two: F.xxhash64(common.text_of())})
    return keyed.join(bad, F.col(one).eqNullSafe(F.col(bad_one)) & (F.col(two) == F.col(bad_two)), "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])


def op2_segment_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
