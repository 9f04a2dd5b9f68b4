"""Repeated passages, found with a run-length compressed Burrows-Wheeler index and removed from the texts.

A byte goes where a string of LENGTH bytes that covers it starts anywhere else in the corpus too. The windows of LENGTH bytes
of each text are dealt to anchors: the GRAM of least hash within a window, the leftmost of equals. Equal windows have equal
anchors at equal places, and the windows of one anchor are neighbours, so that the text around it, its context, holds them
all and no window stands in two contexts. Then:

1. Contexts that are equal are repeated as a whole. Equal ones of a task are joined there, before anything is shuffled.
2. Contexts that share their gram and HALF of the bytes before or after it with another may share some windows. Only these
   go to the index, one of each, grouped by gram.
3. A group's contexts are indexed: suffixes are sorted, the Burrows-Wheeler transform is kept as its runs, and of each run
   the places of its two ends in the text and the length of their match with the neighbour beyond the run. Streaming the
   contexts over that index gives matching statistics: the longest match elsewhere of the suffix at i is the sample at i if
   there is one, and one less than that at i - 1 if not. Windows whose statistics reach LENGTH are repeated.
4. Marks meet their texts, and what they cover is cut out.

Defined cases: null texts are empty; texts shorter than LENGTH bytes keep all; identical rows count as two places, so all of
their windows are repeated; null and repeated doc_ids are told apart by their texts; an empty table gives an empty result;
other columns are ignored.
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

LENGTH, GRAM, HALF = 200, 40, 80
SLICE, BLOCK = 4_000_000, 1_000_000
U = np.uint64
M = U(0xD1342543DE82EF95)
M_INVERSE = U(pow(int(M), -1, 1 << 64))
#: A number for each byte value, from a fixed seed, so that hashes of like texts have nothing in common.
VALUES = np.random.default_rng(5).integers(1, 1 << 63, 256, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


class Hashes:
    """Hashes of any stretch of data, by running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        power = np.full(n, M, dtype=U)
        self.back = np.full(n + 1, M_INVERSE, dtype=U)
        if n:
            power[0] = 1
        self.back[0] = 1
        np.cumprod(power, out=power)
        np.cumprod(self.back, out=self.back)
        self.sums = np.zeros(n + 1, dtype=U)
        np.cumsum(VALUES[data] * power, out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mixed((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U))

    def grams(self, n: int) -> np.ndarray:
        return mixed((self.sums[n:] - self.sums[:-n]) * self.back[: len(self.back) - n])


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of so many elements, from running minima of blocks to either side."""
    n = len(x) - width + 1
    blocks = -(-len(x) // width)
    padded = np.full(blocks * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    padded[: len(x)] = x
    padded = padded.reshape(blocks, width)
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    before = np.minimum.accumulate(padded, axis=1).ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, ...] | None:
    """doc, start, size, anchor (from the start), gram hash, context hash, hash before, hash after of each context. ends: of texts, from 0."""
    if len(data) < LENGTH:
        return None
    hashes = Hashes(data)
    key = (hashes.grams(GRAM) >> U(33)).astype(np.int64) << 32  # 31 bits of hash above the place: equal windows agree on both
    key |= np.arange(len(key))
    least = sliding_minimum(key, LENGTH - GRAM + 1) & 0xFFFFFFFF
    sizes = np.diff(ends)
    windows = np.maximum(sizes - LENGTH + 1, 0)
    valid = np.zeros(len(data) + 1, dtype=np.int8)
    some = windows > 0
    np.add.at(valid, ends[:-1][some], 1)
    np.add.at(valid, (ends[:-1] + windows)[some], -1)
    inside = np.cumsum(valid[: len(least)], dtype=np.int64) > 0
    new = inside & np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1]])
    starts = np.flatnonzero(new)
    if not len(starts):
        return None
    stops = np.flatnonzero(inside & np.concatenate([(least[1:] != least[:-1]) | ~inside[1:], [True]])) + LENGTH
    anchor = least[starts]
    doc = np.searchsorted(ends, starts, side="right") - 1
    gram = hashes.of(anchor, anchor + GRAM)
    before = hashes.of(np.maximum(anchor - HALF, starts), anchor + GRAM)
    after = hashes.of(anchor, np.minimum(anchor + GRAM + HALF, stops))
    return doc, starts - ends[doc], stops - starts, anchor - starts, gram, hashes.of(starts, stops) ^ mixed((anchor - starts).astype(U) + U(1)), before, after


def _slices(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    ends = np.cumsum(sizes)
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary or string column, and where each row ends in them, from 0."""
    ends = np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    return data, ends - ends[0]


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, id and h (which together name a row's text), raw."""
    text = common.text_of()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 62))).alias("id"), F.xxhash64(text).alias("h"), text.cast("binary").alias("raw"))


CONTEXT = "gram long, context long, halves long, id long, h long, start long, shape long"
MARK = "id long, h long, start long, size int, anchor int, gram long, whole boolean, wanted boolean"


def contexts(keyed: DataFrame) -> DataFrame:
    """CONTEXT rows: shape is size << 12 | anchor << 2 | whether equals are known << 1 | whether those are elsewhere in the rows."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            ids, hs = batch.column("id").to_numpy(), batch.column("h").to_numpy()
            whole_data, whole_ends = _bytes_of(raw)
            for a, b in _slices(np.diff(whole_ends)):
                data, ends = whole_data[whole_ends[a] : whole_ends[b]], whole_ends[a : b + 1] - whole_ends[a]
                if (found := anchors(data, ends)) is None:
                    continue
                doc, start, size, anchor, gram, context, before, after = found
                order = np.lexsort((gram, context))
                same = (context[order][1:] == context[order][:-1]) & (gram[order][1:] == gram[order][:-1])
                known, later = np.zeros(len(doc), dtype=bool), np.zeros(len(doc), dtype=bool)
                known[order[1:][same]] = known[order[:-1][same]] = True
                later[order[1:][same]] = True
                halves = (before >> U(32) << U(32)) | (after >> U(32))
                shape = size.astype(np.int64) << 12 | anchor.astype(np.int64) << 2 | known.astype(np.int64) << 1 | later
                # those that stand for themselves no more are dealt anywhere
                where = np.where(later, mixed(start.astype(U) * M + doc.astype(U)), gram).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (where, context.astype(np.int64), halves.astype(np.int64), ids[a:b][doc], hs[a:b][doc], start, shape)], names=[c.split()[0] for c in CONTEXT.split(", ")])

    return keyed.select("id", "h", "raw").mapInArrow(kernel, CONTEXT)


def _by_key(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[pa.Table]:
    """Whole groups of rows that follow each other, at least so many rows at once."""
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in chain(batches, [None]):
        if batch is not None and len(batch):
            held.append(batch)
            rows += len(batch)
        if not held or batch is not None and rows < least:
            continue
        table = pa.Table.from_batches(held)
        if batch is None:
            yield table
            return
        k = table.column(key).to_numpy()
        cut = np.flatnonzero(k[1:] != k[:-1])
        if not len(cut):
            least = rows * 2
            continue
        cut = int(cut[-1]) + 1
        yield table.slice(0, cut)
        held = table.slice(cut).combine_chunks().to_batches()
        rows = len(table) - cut


def _again(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Whether a row's value stands again in its group."""
    order = np.lexsort((value, group))
    same = (value[order][1:] == value[order][:-1]) & (group[order][1:] == group[order][:-1])
    out = np.zeros(len(group), dtype=bool)
    out[order[1:][same]] = out[order[:-1][same]] = True
    return out


def matched(found: DataFrame) -> DataFrame:
    """MARK rows: contexts that are repeated as a whole, and those that the index wants."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "gram", 50_000):
            gram, context, halves, shape = (rows.column(c).to_numpy() for c in ("gram", "context", "halves", "shape"))
            known, later = (shape & 2) > 0, (shape & 1) > 0
            twice = _again(gram, context) & ~later
            whole = twice | known | later
            first = ~later & np.concatenate([[True], (gram[1:] != gram[:-1]) | (context[1:] != context[:-1])])
            wanted = np.zeros(len(gram), dtype=bool)
            at = np.flatnonzero(first)
            wanted[at] = _again(gram[at], halves[at] >> 32) | _again(gram[at], halves[at] & 0xFFFFFFFF)
            kept = whole | wanted
            out = rows.filter(pa.array(kept))
            shape = shape[kept]
            yield pa.RecordBatch.from_arrays([*(out.column(c).combine_chunks() for c in ("id", "h", "start")), pa.array((shape >> 12).astype(np.int32)), pa.array((shape >> 2 & 1023).astype(np.int32)), out.column("gram").combine_chunks(), pa.array(whole[kept]), pa.array(wanted[kept])], names=[c.split()[0] for c in MARK.split(", ")])

    return found.repartition("gram").sortWithinPartitions("gram", "context").mapInArrow(kernel, MARK)


class RunLengthIndex:
    """The runs of the Burrows-Wheeler transform of strings, and for each run's two ends their place and their match beyond it.

    Each string ends in a sign of its own that is no byte, so no match leaves its string and the order of suffixes is whole."""

    def __init__(self, strings: list[bytes]):
        self.ends = np.cumsum([len(s) + 1 for s in strings])
        n = int(self.ends[-1])
        signs = np.frombuffer(b"".join(s + b"\0" for s in strings), dtype=np.uint8).astype(np.int64)
        signs[self.ends - 1] = 256 + np.arange(len(strings))
        padded = np.concatenate([signs, np.full(4, 256)])
        key, last = np.zeros(n, dtype=U), np.zeros(n, dtype=bool)  # whether a string ends within the key, which tells it from all others
        for k in range(4):
            key = key << U(16) | np.where(last, 0, np.minimum(padded[k : k + n], 256)).astype(U)
            last |= padded[k : k + n] >= 256
        order = np.argsort(key, kind="stable")  # keys with ends: by place, which is the order of the ends
        ranks, width, new = [], 4, np.concatenate([[False], (key[order][1:] != key[order][:-1]) | last[order][1:]])
        while True:
            rank = np.empty(n, dtype=np.int64)
            rank[order] = np.cumsum(new)
            ranks.append((width, rank))
            if new[1:].all():
                break
            beyond = np.zeros(n, dtype=np.int64)
            beyond[: n - width] = rank[width:] + 1
            step = rank * (n + 1) + beyond
            order = np.argsort(step, kind="stable")
            new = np.concatenate([[False], step[order][1:] != step[order][:-1]])
            width *= 2
        before = signs[order - 1]  # an end stands before each string, so the matches of its first place are samples of their own
        edge = np.flatnonzero(before[1:] != before[:-1]) + 1  # a run begins at each
        tails, heads = order[edge - 1], order[edge]
        match = np.zeros(len(edge), dtype=np.int64)
        for width, rank in reversed(ranks):
            i, j = tails + match, heads + match
            same = rank[i] == rank[j]
            match[same] += width
        for _ in range(3):
            same = signs[tails + match] == signs[heads + match]
            match[same] += 1
        self.n, self.runs = n, len(edge) + 1
        self.heads, self.tails, self.match = heads, tails, match
        self.outer = order[[0, -1]]

    def statistics(self) -> np.ndarray:
        """The longest match elsewhere of the suffix at each place, as the strings stream by."""
        out = np.zeros(self.n, dtype=np.int64)
        for places, outer in ((self.heads, self.outer[:1]), (self.tails, self.outer[-1:])):
            sample = np.full(self.n, -1, dtype=np.int64)
            sample[outer] = 0
            sample[places] = self.match
            last = np.maximum.accumulate(np.where(sample >= 0, np.arange(self.n), 0))
            np.maximum(out, np.maximum(sample[last], 0) - (np.arange(self.n) - last), out=out)
        return out


def _repeated(strings: list[bytes]) -> list[list[tuple[int, int]]]:
    """The stretches (start, end) of each string that windows cover which stand elsewhere in the strings."""
    index = RunLengthIndex(strings)
    ends = index.ends
    at = np.flatnonzero(index.statistics() >= LENGTH)
    of = np.searchsorted(ends, at, side="right")
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    if not len(at):
        return out
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (of[1:] != of[:-1])]))
    for a, b in zip(new.tolist(), [*new[1:].tolist(), len(at)], strict=True):
        k = int(of[a])
        base = int(ends[k]) - len(strings[k]) - 1
        out[k].append((int(at[a]) - base, int(at[b - 1]) - base + LENGTH))
    return out


def indexed(wanted: DataFrame) -> DataFrame:
    """id, h, start, size of stretches. wanted: gram, id, h, start, text of contexts."""
    out_kind = "id long, h long, start long, size long"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_key(batches, "gram", BLOCK // LENGTH):
            texts = rows.column("text").to_pylist()
            gram, ids, hs, starts = (rows.column(c).to_numpy() for c in ("gram", "id", "h", "start"))
            cuts = np.flatnonzero(gram[1:] != gram[:-1]) + 1
            bounds = [0, *cuts.tolist(), len(gram)]
            a, made = 0, []
            for k in range(1, len(bounds)):
                size = sum(map(len, texts[bounds[a] : bounds[k]]))
                if size >= BLOCK or k == len(bounds) - 1:
                    low, high = bounds[a], bounds[k]
                    for row, spans in enumerate(_repeated(texts[low:high]), low):
                        made += [(ids[row], hs[row], starts[row] + s, e - s) for s, e in spans]
                    a = k
            yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], type=pa.int64()) for c in range(4)], names=["id", "h", "start", "size"])

    return wanted.repartition("gram").sortWithinPartitions("gram", "id", "start").mapInArrow(kernel, out_kind)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in spans:
        parts.append(raw[at:a])
        at = b
    return b"".join([*parts, raw[at:]])


PHASE = "doc_id long, id long, h long, raw binary, spans array<struct<start:long,end:long>>, open boolean, contexts array<struct<gram:long,start:long,text:binary>>"


def _first_phase(joined: DataFrame) -> DataFrame:
    """Spans known so far; the contexts that the index wants; raw only of texts that may yet lose more, or are cut already."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, i, h, raw, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "id", "h", "raw", "marks")), strict=True):
                spans = _merged([(m["start"], m["start"] + m["size"]) for m in marks or [] if m["whole"]])
                wanted = {(m["gram"], m["start"], m["size"]) for m in marks or [] if m["wanted"]}
                rows.append((doc, i, h, raw, [{"start": a, "end": b} for a, b in spans], any(m["wanted"] and not m["whole"] for m in marks or []), [{"gram": g, "start": s, "text": raw[s : s + n]} for g, s, n in wanted]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_(), pa.list_(pa.struct([("gram", pa.int64()), ("start", pa.int64()), ("text", pa.binary())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], type=t) for c, t in enumerate(kinds)], names=[c.split()[0] for c in ("doc_id", "id", "h", "raw", "spans", "open", "contexts")])

    return joined.mapInArrow(kernel, PHASE)


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"


def _cut(rows: DataFrame) -> DataFrame:
    """RESULT. rows: doc_id, raw, spans, more."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, raw, spans, more in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "raw", "spans", "more")), strict=True):
                own = _merged([(s["start"], s["end"]) for s in [*(spans or []), *(more or [])]])
                out.append((doc, len(raw), sum(b - a for a, b in own), len(own), hashlib.sha256(_kept(raw, own)).hexdigest(), [{"start": a, "end": b} for a, b in own]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], type=t) for c, t in enumerate(kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return rows.mapInArrow(kernel, RESULT)


def repeats(docs: DataFrame) -> DataFrame:
    """RESULT: what is removed from each text (byte offsets), and the hash of what is left."""
    common.ship(docs.sparkSession)
    keyed = _keyed(docs)
    marks = common.stored(matched(contexts(keyed)), "repeat-marks")
    by_text = marks.groupBy("id", "h").agg(F.collect_list(F.struct("start", "size", "gram", "whole", "wanted")).alias("marks"))
    joined = keyed.join(by_text, ["id", "h"], "left")
    phase = common.stored(_first_phase(joined).withColumn("n_bytes", F.octet_length("raw")).withColumn("sha", F.when(F.size("spans") == 0, F.sha2("raw", 256))).withColumn("raw", F.when(F.col("open") | (F.size("spans") > 0), F.col("raw"))), "repeat-phase")
    more = common.stored(indexed(phase.select("id", "h", F.explode("contexts").alias("c")).select("c.gram", "id", "h", "c.start", "c.text").distinct()), "repeat-found")
    by_text = more.groupBy("id", "h").agg(F.collect_list(F.struct(F.col("start"), (F.col("start") + F.col("size")).alias("end"))).alias("more"))
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    untouched = phase.filter("not open and size(spans) = 0").select("doc_id", F.col("n_bytes").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"), F.col("sha").alias("kept_sha256"), none.alias("spans"))
    settled = _cut(phase.filter("not open and size(spans) > 0").select("doc_id", "raw", "spans", none.alias("more")))
    opened = _cut(phase.filter("open").join(by_text, ["id", "h"], "left").select("doc_id", "raw", "spans", F.coalesce("more", none).alias("more")))
    return untouched.unionByName(settled).unionByName(opened)


def op4_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats(common.table(spark, sf_dir, "documents")).drop("spans")
