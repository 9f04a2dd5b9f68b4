"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with cosine c lie at squared distance 2 - 2c. Rotated by a fixed random rotation and split into BLOCKS blocks of
like size, two vectors within the whole budget 2 - 2 THRESHOLD are within the block's share of it, in proportion to its
dimensions, in one block at least: so the union of the blocks' range joins holds every link. A block's range join cuts its
first coordinate into cells as wide as the block's radius; a vector meets those of its own cell and of the next. Cells with
more than TILE vectors are joined in tiles of two chunks, by several tasks. In a tile, pairs within the block's budget are
verified by cosine in double precision, on the vectors as given; a pair counts in the first block that finds it and in no other, so that links are
counted where they are found, no pair leaves its task, and no distinct is needed. A task sends back the number of links of
each of its vectors and a spanning forest of them, which the connected components are made of.

Defined cases: null and empty vectors, zero ones and those with null or non-finite components link with nothing; vectors of
another length than the first block of dimensions allows are compared with those of their own length only; equal vectors are
one node, named by their hash, that counts as often as it stands; a null vec_id stays null in the result and never names a
component, whose name is null if no row of it has a vec_id; rows that share a vec_id count each; an empty table gives an
empty result; other columns are ignored. Links are judged on the given doubles, not on rotated ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .components import components

THRESHOLD, BLOCKS, TILE, SUB = 0.9, 4, 16_384, 2048
#: What rounding may add to a squared distance, and what single precision may.
SLACK, COARSE = 1e-7, 1e-4


def rotation(dimensions: int) -> np.ndarray:
    """A fixed random rotation."""
    q, r = np.linalg.qr(np.random.default_rng(dimensions).standard_normal((dimensions, dimensions)))
    return q * np.sign(np.diag(r))


def blocks(dimensions: int) -> list[tuple[int, int]]:
    edges = np.linspace(0, dimensions, min(BLOCKS, dimensions) + 1).astype(int).tolist()
    return list(zip(edges, edges[1:], strict=False))


def budgets(dimensions: int, threshold: float) -> list[float]:
    return [(2 - 2 * threshold) * (b - a) / dimensions + SLACK for a, b in blocks(dimensions)]


def plain(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as given but for a power of two, which no rounding comes with and no square overflows from, and their lengths."""
    scaled = np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def rotated(vectors: np.ndarray) -> np.ndarray:
    """Unit vectors, rotated."""
    largest = np.abs(vectors).max(axis=1, keepdims=True)
    scaled = vectors / largest
    return (scaled / np.linalg.norm(scaled, axis=1, keepdims=True)) @ rotation(vectors.shape[1])


def _keys(rows: DataFrame, threshold: float) -> DataFrame:
    """vec_id, key, data (little-endian doubles), cells: of each block; the last three null for vectors that link with nothing."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key: list = [None] * len(batch)
            data: list = [None] * len(batch)
            cells: list = [None] * len(batch)
            by_length: dict[int, list[int]] = {}
            vectors: dict[int, np.ndarray] = {}
            for k, v in enumerate(batch.column("vector")):
                if v.is_valid and len(v.values) and not v.values.null_count:
                    x = v.values.to_numpy().astype("<f8") + 0.0
                    if np.isfinite(x).all() and x.any():
                        vectors[k], data[k] = x, x.tobytes()
                        key[k] = hashlib.blake2b(data[k], digest_size=16).hexdigest()
                        by_length.setdefault(len(x), []).append(k)
            for length, at in by_length.items():
                turned = rotated(np.array([vectors[k] for k in at]))
                first = np.array([np.floor(turned[:, a] / np.sqrt(s)) for (a, _), s in zip(blocks(length), budgets(length, threshold), strict=True)], dtype=np.int64)
                for k, own in zip(at, first.T.tolist(), strict=True):
                    cells[k] = own
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(key, type=pa.string()), pa.array(data, type=pa.binary()), pa.array(cells, type=pa.list_(pa.int64()))], names=["vec_id", "key", "data", "cells"])

    return rows.mapInArrow(kernel, "vec_id long, key string, data binary, cells array<long>")


def _pairs(x: np.ndarray, y: np.ndarray | None, spans: list[tuple[int, int]], most: list[float], block: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and y (of x alone if y is None) within the block's budget that no earlier block finds."""
    a, b = spans[block]
    other = x if y is None else y
    left, right = x[:, a:b].astype(np.float32), other[:, a:b].astype(np.float32)
    left_square, right_square = (left * left).sum(axis=1), (right * right).sum(axis=1)
    for i in range(0, len(x), SUB):
        for j in range(i if y is None else 0, len(other), SUB):
            near = left[i : i + SUB] @ right[j : j + SUB].T
            near *= -2
            near += left_square[i : i + SUB, None]
            near += right_square[None, j : j + SUB]
            p, q = np.nonzero(near <= most[block] + COARSE)
            p, q = p + i, q + j
            if y is None and i == j:
                p, q = p[p < q], q[p < q]
            for k in range(0, len(p), 65_536):
                s, t = p[k : k + 65_536], q[k : k + 65_536]
                square = (x[s] - other[t]) ** 2
                found = [square[:, u:v].sum(axis=1) <= m for (u, v), m in zip(spans[: block + 1], most, strict=False)]
                first = found[block] & ~np.any(found[:block], axis=0) if block else found[0]
                yield s[first], t[first]


def _forest(n: int, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The smallest row that each row hangs together with."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def join(firsts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """node, root, links: of vectors with links, once for each tile that found some. firsts: node, times, data, cells."""
    rows = firsts.select("node", "times", "data", F.size("cells").alias("parts"), (F.octet_length("data") / 8).cast("int").alias("length"), F.posexplode("cells").alias("block", "cell"))
    own = rows.withColumn("side", F.lit(0))
    both = own.unionByName(rows.withColumn("side", F.lit(1)).withColumn("cell", F.col("cell") - 1))
    place = ["length", "block", "cell"]
    counts = both.groupBy(*place).agg(F.ceil(F.sum(F.lit(1) - F.col("side")) / F.lit(TILE)).cast("int").alias("homes"), F.ceil(F.sum("side") / F.lit(TILE)).cast("int").alias("nexts")).filter("homes > 0")
    both = both.join(counts, place)
    chunk = lambda n: F.pmod(F.xxhash64("node"), F.greatest(F.col(n), F.lit(1)).cast("long")).cast("int")
    up_to = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1)).otherwise(F.array().cast("array<int>"))
    home, right = chunk("homes"), chunk("nexts")
    tile = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    of_home = F.concat(F.transform(up_to("homes"), lambda o: tile(0, F.least(o, home), F.greatest(o, home))), F.transform(up_to("nexts"), lambda o: tile(1, home, o)))
    of_next = F.transform(up_to("homes"), lambda o: tile(1, o, right))
    dealt = both.withColumn("tile", F.explode(F.when(F.col("side") == 0, of_home).otherwise(of_next)))
    # which of a tile's two sets a row is in
    second = F.when(F.col("side") == 1, True).otherwise((F.col("tile.kind") == 0) & (F.col("tile.i") != F.col("tile.j")) & (home == F.col("tile.j")))
    dealt = dealt.select(*place, "tile.kind", "tile.i", "tile.j", second.alias("second"), "node", "times", "data")
    names = [*place, "kind", "i", "j"]

    def linked(group: pa.Table) -> list[tuple[int, int, int]]:
        length, block = group.column("length")[0].as_py(), group.column("block")[0].as_py()
        second = group.column("second").to_numpy()
        node, times = group.column("node").to_numpy(), group.column("times").to_numpy()
        given = np.frombuffer(b"".join(group.column("data").to_pylist()), dtype="<f8").reshape(-1, length)
        x, (scaled, norm) = rotated(given), plain(given)
        one = group.column("kind")[0].as_py() == 0 and group.column("i")[0].as_py() == group.column("j")[0].as_py()
        at_x, at_y = np.flatnonzero(~second), np.flatnonzero(second)
        links, p, q = np.zeros(len(x), dtype=np.int64), [], []
        for s, t in _pairs(x[at_x], None if one else x[at_y], blocks(length), budgets(length, threshold), block):
            s, t = at_x[s], (at_x if one else at_y)[t]
            near = (scaled[s] * scaled[t]).sum(axis=1) / (norm[s] * norm[t]) >= threshold
            s, t = s[near], t[near]
            links += np.bincount(s, weights=times[t], minlength=len(x)).astype(np.int64) + np.bincount(t, weights=times[s], minlength=len(x)).astype(np.int64)
            root = _forest(len(x), s, t)
            moved = np.flatnonzero(root != np.arange(len(x)))
            p.append(moved)
            q.append(root[moved])
        if not links.any():
            return []
        root = _forest(len(x), np.concatenate(p), np.concatenate(q))
        return [(int(node[k]), int(node[root[k]]), int(links[k])) for k in np.flatnonzero(links)]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            group = pa.Table.from_batches(held) if held else None
            if group is None or not len(group):
                continue
            key = [group.column(c).to_numpy() for c in names]
            new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in key], axis=0)) + 1
            if batch is not None and not len(new):
                continue
            bounds = [0, *new.tolist(), *([len(group)] if batch is None else [])]
            out = [row for a, b in zip(bounds, bounds[1:], strict=False) if b - a > 1 for row in linked(group.slice(a, b - a))]
            held = group.slice(bounds[-1]).to_batches() if batch is not None else []
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], type=pa.int64()) for c in range(3)], names=["node", "root", "links"])

    return dealt.repartition(*names).sortWithinPartitions(*names).mapInArrow(kernel, "node long, root long, links long")


def near_vectors(table: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row a row of table (vec_id, embedding)."""
    common.ship(table.sparkSession)
    rows = common.stored(_keys(table.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vector")), threshold), "vectors")
    firsts = rows.filter("key is not null").groupBy("key").agg(F.min("vec_id").alias("least"), F.count("*").alias("times"), F.first("data").alias("data"), F.first("cells").alias("cells"))
    firsts = common.stored(firsts.withColumn("node", F.xxhash64("key")), "vector-firsts")
    found = common.stored(join(firsts, threshold), "vector-links")
    of = common.stored(components(found.select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = firsts.select("key", "node", "least", "times").join(links, "node", "left").join(of, "node", "left")
    known = common.stored(known.select("key", "least", F.coalesce("component", "node").alias("component"), (F.coalesce("links", F.lit(0)) + F.col("times") - 1).alias("n_links")), "vector-known")
    names = known.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = rows.select("vec_id", "key").join(known.join(names, "component").select("key", "n_links", "component_id"), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return linked.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op3_subspace_pigeonhole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(common.table(spark, sf_dir, "embeddings"))
