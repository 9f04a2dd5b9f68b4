"""Near-duplicate documents: improved consistent weighted sampling over TF-IDF shingles, banded, verified exactly.

A shingle is five words in a row (all words of a shorter text); words are runs between ASCII white space, in lower case. Its
weight is how often it stands in the text times the mean inverse document frequency of its words. The frequencies are those
of words, not of shingles: a shingle that an edit has made unique would else outweigh all that two copies share, the more
so the more copies there are. They are counted over all documents in 2^BITS hash buckets, a bound on what is broadcast.

SAMPLES consistent weighted samples of each distinct text agree with those of another as often as their weighted Jaccard
similarity says. Texts that agree on all ROWS samples of a band meet in a bucket; there whole signatures are compared, and
pairs that agree on at least CLOSE of the samples may be near-duplicates. A group of copies would give pairs by the square
of its size, so a first search takes a spanning forest of each bucket's pairs, the best first, and a second one judges all
pairs whose ends are not in one class yet: their texts' shingles come to the bucket, each pair is verified in the first band
that it shares, and only links that join two classes leave it, so that no step makes more rows than there are documents in
buckets. Buckets above TILE texts or HELD shingles are searched in tiles of two chunks each, by several tasks.
A pair is a link where its weighted Jaccard similarity, of whole texts, is at least THRESHOLD. Classes are the connected
components of links; identical texts are one node from the start.

Defined cases: texts without words (null and empty ones among them) have no shingles, resemble nothing and are classes of
their own; rows that share a doc_id are one node; a null doc_id is a node named by minus one less the text's hash; an empty
table gives an empty result; other columns are ignored by the operator and kept by the filter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 12, 4
SAMPLES = BANDS * ROWS
CLOSE = 0.6
BITS, TILE, HELD, SLICE = 18, 4096, 4_000_000, 1_000_000
U = np.uint64
M = U(0x9E3779B97F4A7C15)
M_INVERSE = U(pow(int(M), -1, 1 << 64))
SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
#: Quantiles of Gamma(2, 1), drawn once from a fixed seed: what a sample's random numbers are looked up in.
GAMMA = np.random.default_rng(20240229).gamma(2.0, 1.0, 1 << 13).astype(np.float32)
LOG_GAMMA = np.log(np.random.default_rng(7).gamma(2.0, 1.0, 1 << 13)).astype(np.float32)
SEEDS = np.random.default_rng(11).integers(1, 1 << 63, SAMPLES, dtype=np.uint64) | U(1)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(32))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A hash of every word of texts, and where each text's words begin."""
    texts = pa.concat_arrays([pc.ascii_lower(texts)])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if ends[-1] == ends[0]:
        return np.zeros(0, dtype=U), np.zeros(len(texts) + 1, dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[ends] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1] | edge[1:-1]]))
    stops = np.flatnonzero(inside & np.concatenate([~inside[1:] | edge[1:-1], [True]])) + 1
    power = np.full(len(data), M, dtype=U)
    power[0] = 1
    np.cumprod(power, out=power)
    sums = np.concatenate([np.zeros(1, dtype=U), np.cumsum((data.astype(U) + U(1)) * power)])
    back = np.full(len(data), M_INVERSE, dtype=U)
    back[0] = 1
    np.cumprod(back, out=back)
    return mixed((sums[stops] - sums[starts]) * back[starts]), np.searchsorted(starts, ends)


class Shingles:
    """The weighted shingles of texts, given the inverse document frequency of each bucket of words."""

    def __init__(self, idf: np.ndarray):
        self.idf = idf

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct shingles in order, and their weights, text by text."""
        h, bounds = word_hashes(texts)
        w = self.idf[h >> U(64 - BITS)]
        n = max(0, len(h) - WORDS + 1)
        five, weight = np.zeros(n, dtype=U), np.zeros(n, dtype=np.float32)
        for k in range(WORDS):
            five = (five ^ h[k : k + n]) * M + (five >> U(29))
            weight += w[k : k + n]
        weight /= WORDS
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            if b - a >= WORDS:
                own, at, times = np.unique(five[a : b - WORDS + 1], return_index=True, return_counts=True)
                yield own, weight[a + at] * times.astype(np.float32)
            elif b > a:
                yield mixed((h[a:b] * np.cumprod(np.full(b - a, M))).sum(keepdims=True)), w[a:b].mean(keepdims=True)
            else:
                yield h[:0], w[:0]


def signature(shingles: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """SAMPLES consistent weighted samples (Ioffe): the shingle of least a, and its quantised weight, mixed into 64 bits."""
    best, out = np.full(SAMPLES, np.inf, dtype=np.float32), np.zeros(SAMPLES, dtype=U)
    for k in range(0, len(shingles), 1024):
        h, log_w = shingles[k : k + 1024], np.log(weights[k : k + 1024])[:, None]
        x = h[:, None] * SEEDS
        x ^= x >> U(32)
        x *= M
        r = GAMMA[(x >> U(51)).astype(np.int16)]
        log_c = LOG_GAMMA[((x >> U(38)) & U(8191)).astype(np.int16)]
        beta = ((x >> U(14)) & U(0xFFFFFF)).astype(np.float32) * np.float32(2.0**-24)
        t = np.floor(log_w / r + beta)
        a = log_c - r * (t - beta + 1)
        at = a.argmin(axis=0)
        least = a[at, np.arange(SAMPLES)]
        new = least < best
        best[new] = least[new]
        out[new] = mixed(h[at] + t[at, np.arange(SAMPLES)].astype(np.int64).astype(U) * M)[new]
    return out


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = float(np.minimum(a[1][i], b[1][j]).sum(dtype=float))
    either = float(a[1].sum(dtype=float) + b[1].sum(dtype=float)) - both
    return both / either if either > 0 else 0.0


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


def frequencies(docs: DataFrame) -> np.ndarray:
    """Inverse document frequency of each bucket of words, over all documents."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BITS, dtype=np.int64)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                h, bounds = word_hashes(texts.slice(a, b - a))
                doc = np.repeat(np.arange(b - a, dtype=np.int64), np.diff(bounds))
                counts += np.bincount(np.unique((doc << BITS) | (h >> U(64 - BITS)).astype(np.int64)) & ((1 << BITS) - 1), minlength=1 << BITS)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])

    found = docs.select(common.text_of().alias("text")).mapInArrow(kernel, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(1 << BITS)
    df[found["bucket"].to_numpy(np.int64)] = found["n"].to_numpy(float)
    return (np.log((1 + df.max()) / (1 + df)) + 1).astype(np.float32)


def signatures(docs: DataFrame, idf) -> DataFrame:
    """doc_id, text_key, bands array<long> (null without words), marks binary (a byte of each sample), size (distinct shingles). idf: broadcast."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(idf.value)
        for batch in batches:
            texts = batch.column("text")
            for a, b in slices(texts):
                bands, marks, size = [], [], []
                for own, weights in shingles.of(texts.slice(a, b - a)):
                    size.append(len(own))
                    if not len(own):
                        bands.append(None)
                        marks.append(None)
                        continue
                    s = signature(own, weights)
                    x = np.arange(1, BANDS + 1, dtype=U)
                    for row in s.reshape(BANDS, ROWS).T:
                        x = mixed(x * M + row)
                    bands.append(x.astype(np.int64))
                    marks.append((s & U(255)).astype(np.uint8).tobytes())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), batch.column("text_key").slice(a, b - a), pa.array(bands, type=pa.list_(pa.int64())), pa.array(marks, type=pa.binary()), pa.array(size, type=pa.int64())], names=["doc_id", "text_key", "bands", "marks", "size"])

    return keyed(docs).mapInArrow(kernel, "doc_id long, text_key string, bands array<long>, marks binary, size long")


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id (never null), text_key, text."""
    text = common.text_of()
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), -1 - F.abs(F.xxhash64(text) % F.lit(1 << 62))).alias("doc_id"), F.md5(text).alias("text_key"), text.alias("text"))


NEED = int(np.ceil(CLOSE * SAMPLES))


def closest_pairs(marks: np.ndarray) -> Iterator[tuple[int, int]]:
    """A spanning forest of the rows that agree on NEED marks, the best agreements first (Prim): fewer pairs than rows."""
    n = len(marks)
    if n == 2:
        if np.count_nonzero(marks[0] == marks[1]) >= NEED:
            yield 0, 1
        return
    best, link, at = np.full(n, -1), np.zeros(n, dtype=np.int64), 0
    for _ in range(n):
        if best[at] >= NEED:
            yield int(link[at]), at
        best[at] = -3  # done
        same = np.count_nonzero(marks == marks[at], axis=1)
        better = (same > best) & (best > -3)
        best[better], link[better] = same[better], at
        at = int(best.argmax())
        if best[at] == -3:
            return


def strangers_first(group: np.ndarray) -> tuple[np.ndarray, int]:
    """An order of the rows with the largest group last, and how many rows are outside it: every pair of different groups has an end among those."""
    names, at, n = np.unique(group, return_inverse=True, return_counts=True)
    largest = at == n.argmax()
    return np.argsort(largest, kind="stable"), int(len(group) - n.max())


def open_rows(marks: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows agree on NEED marks with a row of another group."""
    order, outside = strangers_first(group)
    marks, group = marks[order], group[order]
    found = np.zeros(len(marks), dtype=bool)
    for i in range(min(outside, len(marks) - 1)):
        close = (group[i + 1 :] != group[i]) & (np.count_nonzero(marks[i + 1 :] == marks[i], axis=1) >= NEED)
        found[i + 1 :] |= close
        found[i] |= close.any()
    out = np.empty_like(found)
    out[order] = found
    return out


def joining_pairs(marks: np.ndarray, group: np.ndarray, bands: np.ndarray, bucket: int, keys: list[np.ndarray], weights: list[np.ndarray], threshold: float) -> Iterator[tuple[int, int, float]]:
    """Pairs of similarity threshold and above that join two groups, each judged in the first band it shares; groups merge as they are found."""
    order, outside = strangers_first(group)
    marks, bands, group = marks[order], bands[order], np.unique(group[order], return_inverse=True)[1]
    keys, weights = [keys[k] for k in order], [weights[k] for k in order]
    places, flat = np.unique(np.concatenate(keys), return_inverse=True)[1], np.concatenate(weights)
    ends = np.cumsum([len(k) for k in keys])
    starts = ends - [len(k) for k in keys]
    total = np.add.reduceat(flat, starts, dtype=float)
    own = np.zeros(int(places.max()) + 1, dtype=np.float32)
    for i in range(min(outside, len(keys) - 1)):
        shared = bands[i + 1 :] == bands[i]
        near = (group[i + 1 :] != group[i]) & (bands[i][shared.argmax(axis=1)] == bucket) & shared.any(axis=1)
        near &= np.count_nonzero(marks[i + 1 :] == marks[i], axis=1) >= NEED
        near &= np.minimum(total[i + 1 :], total[i]) >= 0.999 * threshold * np.maximum(total[i + 1 :], total[i])
        at = np.flatnonzero(near) + i + 1
        if not len(at):
            continue
        own[places[starts[i] : ends[i]]] = weights[i]
        if len(at) < 32:
            both = np.array([np.minimum(own[places[starts[j] : ends[j]]], weights[j]).sum(dtype=float) for j in at])
        else:
            low = starts[at[0]]
            both = np.add.reduceat(np.minimum(own[places[low:]], flat[low:]), starts[at[0] :] - low, dtype=float)[at - at[0]]
        own[places[starts[i] : ends[i]]] = 0
        score = both / (total[i] + total[at] - both)
        for j, x in zip(at[score >= threshold].tolist(), score[score >= threshold].tolist(), strict=True):
            if group[j] != group[i]:
                yield int(order[i]), int(order[j]), x
                group[group == group[j]] = group[i]


def buckets(signed: DataFrame) -> DataFrame:
    """bucket, i, j, doc_id, marks: the rows of each tile of a bucket with company. signed: doc_id, bands, marks, size of distinct texts."""
    rows = signed.filter("bands is not null").select(F.explode("bands").alias("bucket"), "doc_id", "marks", "size")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("size").alias("held")).filter("n > 1")
    rows = rows.join(counts.hint("merge"), "bucket")
    chunks = F.ceil(F.greatest(F.col("n") / F.lit(TILE), F.col("held") / F.lit(HELD))).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), chunks.cast("long")).cast("int")
    tiles = F.transform(F.sequence(F.lit(0), chunks - 1), lambda o: F.struct(F.least(o, own).alias("i"), F.greatest(o, own).alias("j")))
    return rows.select("bucket", "doc_id", "marks", F.explode(tiles).alias("tile")).select("bucket", "tile.i", "tile.j", "doc_id", "marks")


def tiled(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, list[tuple[int, int]]]]:
    """Rows sorted by tile, and where in them each whole tile of two rows or more begins and ends."""
    held: list[pa.RecordBatch] = []
    for batch in chain(batches, [None]):
        if batch is not None:
            held.append(batch)
        rows = pa.Table.from_batches(held) if held else None
        if rows is None or not len(rows):
            continue
        key = [rows.column(c).to_numpy() for c in ("bucket", "i", "j")]
        new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
        bounds = [0, *new.tolist(), *([len(rows)] if batch is None else [])]
        yield rows, [(x, y) for x, y in zip(bounds, bounds[1:], strict=False) if y - x > 1]
        held = rows.slice(bounds[-1]).combine_chunks().to_batches() if batch is not None else []


def by_tile(rows: DataFrame) -> DataFrame:
    return rows.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j", "doc_id")


def marks_of(group: pa.Table) -> np.ndarray:
    return np.frombuffer(b"".join(group.column("marks").to_pylist()), dtype=np.uint8).reshape(-1, SAMPLES)


def candidates(rows: DataFrame) -> DataFrame:
    """a < b: the pairs of each tile's forest. rows: buckets()."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tiles in tiled(batches):
            a, b = [], []
            for x, y in tiles:
                group = rows.slice(x, y - x)
                ids = group.column("doc_id").to_numpy()
                found = list(closest_pairs(marks_of(group)))
                a += [min(ids[x], ids[y]) for x, y in found]
                b += [max(ids[x], ids[y]) for x, y in found]
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return by_tile(rows).mapInArrow(kernel, "a long, b long").filter("a <> b").distinct()


def apart(rows: DataFrame) -> DataFrame:
    """The rows that are close to one of another class in their tile. rows: buckets(), and the class_id that each document is known to be in."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tiles in tiled(batches):
            kept = np.zeros(len(rows), dtype=bool)
            for x, y in tiles:
                group = rows.slice(x, y - x)
                kept[x:y] = open_rows(marks_of(group), group.column("class_id").to_numpy())
            yield from rows.filter(pa.array(kept)).to_batches()

    return by_tile(rows).mapInArrow(kernel, rows.schema)


def joining(rows: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity: links that join the classes of each tile. rows: apart(), with bands, and keys and weights of vectors()."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, tiles in tiled(batches):
            a, b, score = [], [], []
            for x, y in tiles:
                group = rows.slice(x, y - x)
                ids, bands = group.column("doc_id").to_numpy(), np.array(group.column("bands").to_pylist(), dtype=np.int64)
                keys = [np.frombuffer(v, dtype=U) for v in group.column("keys").to_pylist()]
                weights = [np.frombuffer(v, dtype=np.float32) for v in group.column("weights").to_pylist()]
                for p, q, s in joining_pairs(marks_of(group), group.column("class_id").to_numpy(), bands, group.column("bucket")[0].as_py(), keys, weights, threshold):
                    a.append(min(ids[p], ids[q]))
                    b.append(max(ids[p], ids[q]))
                    score.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64()), pa.array(score, type=pa.float64())], names=["a", "b", "similarity"])

    return by_tile(rows).mapInArrow(kernel, "a long, b long, similarity double")


def vectors(texts: DataFrame, idf) -> DataFrame:
    """doc_id, keys and weights: the shingles of each text. texts: doc_id, text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(idf.value)
        for batch in batches:
            for a, b in slices(batch.column("text")):
                own = list(shingles.of(batch.column("text").slice(a, b - a)))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array([k.tobytes() for k, _ in own], type=pa.binary()), pa.array([w.astype(np.float32).tobytes() for _, w in own], type=pa.binary())], names=["doc_id", "keys", "weights"])

    return texts.select("doc_id", "text").mapInArrow(kernel, "doc_id long, keys binary, weights binary")


def verified(pairs: DataFrame, texts: DataFrame, idf, threshold: float = THRESHOLD) -> DataFrame:
    """a, b, similarity of the pairs that reach the threshold. texts: doc_id, text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(idf.value)
        for batch in batches:
            for at in range(0, len(batch), 128):
                some = batch.slice(at, 128)
                score = [similarity(x, y) for x, y in zip(shingles.of(some.column("text_a")), shingles.of(some.column("text_b")), strict=True)]
                out = pa.RecordBatch.from_arrays([some.column("a"), some.column("b"), pa.array(score, type=pa.float64())], names=["a", "b", "similarity"])
                yield out.filter(pa.array([s >= threshold for s in score]))

    of = lambda side: texts.select(F.col("doc_id").alias(side), F.col("text").alias(f"text_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "text_a", "text_b").mapInArrow(kernel, "a long, b long, similarity double")


def links(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(a, b, similarity): links between the first documents of distinct texts that join all classes; (a, b): the same classes,
    with those that the first search found as stars; and doc_id, first of all documents."""
    spark = docs.sparkSession
    common.ship(spark)
    idf = spark.sparkContext.broadcast(frequencies(docs))
    signed = common.stored(signatures(docs, idf), "near-signed")
    firsts = signed.groupBy("text_key").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("marks").alias("marks"), F.first("size").alias("size"))
    firsts = common.stored(firsts, "near-firsts")
    members = signed.select("doc_id", "text_key").join(firsts.select("text_key", F.col("doc_id").alias("first")), "text_key").select("doc_id", "first")
    met = common.stored(buckets(firsts), "near-buckets")
    pairs = common.stored(candidates(met), "near-pairs")
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()  # the forest holds each document of any pair
    texts = common.stored(keyed(docs).select("doc_id", "text").join(wanted.hint("merge"), "doc_id", "left_semi"), "near-texts").dropDuplicates(["doc_id"])
    sure = common.stored(verified(pairs, texts, idf, threshold), "near-links")
    # what the first search has not joined yet is compared whole
    known = components(sure)
    named = met.join(known.hint("merge"), F.col("doc_id") == F.col("node"), "left").select(*met.columns, F.coalesce("component", "doc_id").alias("class_id"))
    left = common.stored(apart(named), "near-apart")
    some = texts.join(left.select("doc_id").distinct().hint("merge"), "doc_id", "left_semi")
    whole = left.join(firsts.select("doc_id", "bands").hint("merge"), "doc_id").join(vectors(some, idf).hint("merge"), "doc_id")
    rest = common.stored(joining(whole, threshold), "near-links")
    stars = known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(rest.select("a", "b"))
    return sure.unionByName(rest), stars, members


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class), kept (whether it is that one): one row a document row."""
    _, stars, members = links(docs, threshold)
    rows = members.join(components(stars), F.col("first") == F.col("node"), "left")
    return rows.select("doc_id", F.coalesce("component", "first").alias("class_id")).withColumn("kept", F.col("doc_id") == F.col("class_id"))


def deduplicated(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with all their columns, whatever these are called, one document of each class: that of the least doc_id, nulls last.

    Here a node is a distinct text, named by its hash, so rows that share a doc_id, or have none, are told apart by their texts.
    """
    names = docs.columns
    key, order, node, first = common.free_names(["key", "order", "node", "first"], names)
    others = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names) if c != "text"])))
    rows = docs.withColumns({key: F.xxhash64(common.text_of()), order: F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").cast("long").alias("id"), others.alias("others"))})
    firsts = rows.groupBy(F.col(key).alias("node")).agg(F.min(order).alias("first"))
    of = classes(rows.select(F.col(key).alias("doc_id"), "text"), threshold).select("doc_id", "class_id").distinct()
    best = firsts.join(of.hint("merge"), F.col("node") == F.col("doc_id")).groupBy("class_id").agg(F.min(F.struct("first", "node")).alias("best"))
    best = common.stored(best.select(F.col("best.node").alias(node), F.col("best.first").alias(first)), "near-kept")
    kept = rows.join(best, (F.col(key) == F.col(node)) & F.col(order).eqNullSafe(F.col(first)), "left_semi")
    return kept.dropDuplicates([key]).select(*[F.col(f"`{c}`") for c in names])


def op6_weighted_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.table(spark, sf_dir, "documents"))
