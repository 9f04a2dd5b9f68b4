"""Statistics of writing style, one row a document row: counted inside the row, without a shuffle.

What a document repeats is its own affair: its characters or words are sorted and counted in one vectorised Arrow pass, so no
row is made of them. Documents with nothing to count have no row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

from .sizes import held

COUNTED = "doc_id long, total long, kinds long, once long, nats double"


def counted(rows: DataFrame, words: bool, run: int = 1) -> DataFrame:
    """doc_id, total, kinds, once (kinds that come once), nats (entropy): of the runs of so many neighbours in x, a text or a list of words."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x")
            if words:
                x = x.cast(pa.list_(pa.string()))
                coded, ends = x.flatten().dictionary_encode(), np.concatenate([[0], np.cumsum(np.diff(x.offsets.to_numpy()))])
                codes = coded.indices.to_numpy().astype(np.int64)
                each = [codes[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            else:
                each = (np.frombuffer((t or "").encode("utf-32-le"), dtype="<u4").astype(np.int64) for t in x.to_pylist())
            out: list[tuple] = []
            for doc, own in zip(batch.column("doc_id").to_pylist(), each, strict=True):
                total = len(own) - run + 1
                if total < 1:
                    continue
                if run == 2:
                    own = (own[:-1] << 32) + own[1:]
                n = np.unique(own, return_counts=True)[1]
                out.append((doc, total, len(n), int((n == 1).sum()), float(np.log(total) - (n * np.log(n)).sum() / total)))
            kinds = [pa.int64()] * 4 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, kinds, strict=True)], names=["doc_id", "total", "kinds", "once", "nats"])

    return rows.mapInArrow(kernel, COUNTED)


def _entropy(nats: Column, name: str, bits: bool = False) -> Column:
    return (F.round(nats / F.lit(float(np.log(2.0))) if bits else nats, 6) + 0.0).alias(name)


def char_entropy(docs: DataFrame) -> DataFrame:
    """doc_id, char_entropy: in nats, of the characters that are no blanks."""
    rows = counted(docs.select("doc_id", F.regexp_replace("text", f"[{T.BLANKS}]", "").alias("x")), words=False)
    return rows.select("doc_id", _entropy(F.col("nats"), "char_entropy"))


def bigram_entropy(docs: DataFrame) -> DataFrame:
    rows = counted(docs.select("doc_id", T.words(F.col("text")).alias("x")), words=True, run=2)
    return rows.select("doc_id", _entropy(F.col("nats"), "bigram_entropy", bits=True))


def vocabulary(docs: DataFrame) -> DataFrame:
    """doc_id, words, types, hapaxes, type_ratio."""
    rows = counted(docs.select("doc_id", T.words(F.col("text")).alias("x")), words=True)
    return rows.select("doc_id", F.col("total").alias("words"), F.col("kinds").alias("types"), F.col("once").alias("hapaxes"), F.round(F.col("kinds") / F.col("total"), 6).alias("type_ratio"))


def sentence_rhythm(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, mean_length, length_cv: of sentence lengths in counted characters."""
    n, mean = F.col("n"), F.col("mean")
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    rows = held(docs, F.filter(F.transform(T.sentences(F.col("text")), T.valid_chars), lambda x: x > 0), "n", "doc_id").filter("size(n) > 0")
    rows = rows.select("doc_id", "n", (total(n) / F.size(n)).alias("mean"))
    spread = F.sqrt(total(F.transform(n, lambda x: (x - mean) * (x - mean))) / F.size(n))
    return rows.select("doc_id", F.size(n).cast("long").alias("sentences"), F.round(mean, 6).alias("mean_length"), F.round(spread / mean, 6).alias("length_cv"))


def opening(docs: DataFrame) -> DataFrame:
    """doc_id, sentences, most: how often the commonest first word opens a sentence."""
    first: Column = F.get(T.words(F.col("s")), 0)
    rows = docs.select("doc_id", F.explode(T.sentences(F.col("text"))).alias("s")).select("doc_id", first.alias("w")).filter("w is not null")
    return rows.groupBy("doc_id", "w").agg(F.count("*").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("sentences"), F.max("n").alias("most"))
