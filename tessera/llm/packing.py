"""Best-fit packing of tokenised documents into sequences, improved by a swap-based local search.

Every document becomes token ids and one end id; only longer ones are cut, into full sequences and a last shorter piece.
The pieces that are shorter than a sequence are dealt into shards of about SHARD pieces; each shard is packed by best fit
in order of falling length and then improved: while an exchange between two underfull bins raises the sum of squared fills,
one document moves, one is exchanged for one, or two for one, towards the fuller bin, so that the emptier one runs dry. The
search ends when no two bins have such an exchange left, which the rise of an integer sum below a bound brings about. A
shard ends with one bin that has to stay underfull, so shards cost next to nothing and each is packed by itself.

Defined cases: a null text is empty and becomes the end id alone; null doc_ids are ordinary values; identical rows are
pieces of their own; an empty table gives an empty result; other columns are ignored. Texts that spell a special token are
tokenised as the tokenizer does by default.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

CAPACITY, SHARD = 2048, 50_000
TOKENIZER = "word_bpe_49k.json"
END_ID = 0
#: Bytes of words and of their ids that a worker remembers, and the longest word that it does.
REMEMBERED, LONGEST = 16_000_000, 64
#: Bytes of text that are tokenised at once.
SLICE = 1_000_000
PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long, salt long"
#: Control characters that Python counts as white space and tokenizers don't.
ODD_SPACE = ("\x1c", "\x1d", "\x1e", "\x1f", "\x85")
#: Signs that may join or split letters otherwise than by kind: texts with them are cut at white space alone.
UNSPLIT = r"['\x00-\x08\x0e-\x1f\x7f]|[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
#: Of bytes: white space 0, letters 1, signs 2, digits 3.
KINDS = np.full(256, 1, dtype=np.uint8)
KINDS[:128] = [0 if c.isspace() else 1 if c.isalpha() else 3 if c.isdigit() else 2 for c in map(chr, range(128))]
#: A run of letters is one word to the tokenizer; letters and then signs are two.
PLAIN = re.compile("[a-zß-öø-ÿ]+")
PARTED = re.compile(r"([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]+)")


class Words:
    """Token ids of texts. A tokenizer of this kind never looks across white space, so each run between white space is
    tokenised once and remembered; runs of plain letters are tokenised together, as each ends with a word-end token."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.of: dict[str, bytes] = {}
        #: How many words are remembered for good, and their bytes.
        self.held = self.bytes = 0

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _learn(self, words: list[str]) -> None:
        """Remembers the ids of new words."""
        of, plain, parted, rest = self.of, set(), [], []
        for w in words:
            if PLAIN.fullmatch(w):
                plain.add(w)
            elif m := PARTED.fullmatch(w):
                parted.append((w, *m.groups()))
                plain.add(m[1])
                if m[2] not in of:
                    rest.append(m[2])
            else:
                rest.append(w)
        new = [w for w in plain if w not in of]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype=np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(some):
                rest += some
                continue
            raw = ids.tobytes()
            for w, a, b in zip(some, [0, *(4 * cuts[:-1]).tolist()], (4 * cuts).tolist(), strict=True):
                of[w] = raw[a:b]
        rest = list(dict.fromkeys(rest))
        for w, e in zip(rest, self.tokenizer.encode_batch_fast(rest, add_special_tokens=False), strict=True):
            of[w] = np.array(e.ids, dtype=np.uint32).tobytes()
        for w, core, tail in parted:
            of[w] = of[core] + of[tail]

    def _forget(self) -> None:
        """Drops words that are too long to come again, and all words when they take too many bytes."""
        new = list(islice(reversed(self.of.items()), max(0, len(self.of) - self.held)))
        for w, raw in new:
            if len(w) > LONGEST:
                del self.of[w]
            else:
                self.bytes += len(w) + len(raw)
        if self.bytes > REMEMBERED:
            self.of.clear()
            self.bytes = 0
        self.held = len(self.of)

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text starts in them."""
        self._forget()
        odd = np.zeros(len(texts), dtype=bool)
        for s in (*self.special, *ODD_SPACE):
            odd |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        mixed = pc.match_substring_regex(texts, UNSPLIT).to_numpy(zero_copy_only=False) & ~odd
        parts = [(np.flatnonzero(odd), lambda t: self._counted([self.whole(x) for x in t.to_pylist()])), (np.flatnonzero(mixed), lambda t: self._mapped(*_by_space(t))), (np.flatnonzero(~(odd | mixed)), lambda t: self._mapped(*_by_class(t)))]
        parts = [(rows, f(pc.ascii_lower(texts.take(pa.array(rows))) if not odd[rows[0]] else texts.take(pa.array(rows)))) for rows, f in parts if len(rows)]
        if len(parts) == 1:
            return parts[0][1]
        lengths = np.zeros(len(texts), dtype=np.int64)
        for rows, (_, starts) in parts:
            lengths[rows] = np.diff(starts)
        ends = np.concatenate([[0], np.cumsum(lengths)])
        out = np.empty(ends[-1], dtype=np.uint32)
        for rows, (flat, starts) in parts:
            out[np.repeat(ends[rows] - starts[:-1], np.diff(starts)) + np.arange(len(flat))] = flat
        return out, ends

    @staticmethod
    def _counted(own: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([*own, np.zeros(0, dtype=np.uint32)]), np.concatenate([[0], np.cumsum([len(x) for x in own], dtype=np.int64)])

    def _mapped(self, units: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of the units of texts; bounds: where each text's units begin."""
        coded = units.dictionary_encode()
        distinct, of = [w.strip() for w in coded.dictionary.to_pylist()], self.of
        if new := [w for w in distinct if w not in of and w]:
            self._learn(list(dict.fromkeys(new)))
        raw = [of[w] if w else b"" for w in distinct]
        table = np.frombuffer(b"".join(raw), dtype=np.uint32)
        lengths = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw)) // 4
        begins = np.cumsum(lengths) - lengths
        place = coded.indices.to_numpy()
        counts = lengths[place]
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = np.repeat((begins[place] - ends[:-1]).astype(np.int32), counts)
        at += np.arange(ends[-1], dtype=np.int32)
        return table[at], ends[bounds]


def _by_space(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units between white space."""
    split = pc.ascii_split_whitespace(texts)
    bounds = split.offsets.to_numpy()
    return split.values.slice(bounds[0], bounds[-1] - bounds[0]), bounds - bounds[0]


def _by_class(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Units of one kind each, letters or signs or one digit, with the white space before them: what the tokenizer cuts into."""
    texts = pa.concat_arrays([texts])
    ends = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[ends[0] : ends[-1]] if ends[-1] > ends[0] else np.zeros(0, dtype=np.uint8)
    ends = ends - ends[0]
    kind = KINDS[data]
    cut = np.empty(len(data) + 1, dtype=bool)
    cut[1:-1] = ((kind[1:] != kind[:-1]) | (kind[1:] == 3)) & (kind[:-1] != 0)
    cut[ends] = True
    at = np.flatnonzero(cut)
    units = pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data)))
    return units, np.searchsorted(at, ends)


@cache
def _words(name: str) -> Words:
    if "/" not in name:
        import public_tokenizers

        name = public_tokenizers.path(name)
    return Words(name)


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """Each document's pieces: doc_id, piece, start, length, ids_crc32, and a salt that deals identical pieces apart."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, seen = _words(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            for at, end in _slices(batch.column("text")):
                flat, starts = words.ids(batch.column("text").slice(at, end - at))
                out: list[tuple] = []
                for doc, a, b in zip(batch.column("doc_id").slice(at, end - at).to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    raw = np.append(flat[a:b], np.uint32(END_ID)).astype("<u4")
                    for k in range(0, len(raw), capacity):
                        own = raw[k : k + capacity]
                        out.append((doc, k // capacity, k, len(own), zlib.crc32(own.tobytes()), (part << 36) + seen))
                        seen += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), [pa.int64(), pa.int32(), *[pa.int64()] * 4], strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])
        common.trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().alias("text")).mapInArrow(kernel, PIECE)


def _slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of rows of about SLICE bytes."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(ends):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE, side="right")))
        yield at, end
        at = end


def best_fit(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices: in order of falling length, each to the fullest bin that has room."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0  # bit r: some bin has room r
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        if fit := rooms >> n:
            room = n + (fit & -fit).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        if left := room - n:
            by_room[left].append(b)
            rooms |= 1 << left
    return bins


class LocalSearch:
    """Exchanges between underfull bins that raise the sum of squared fills, fuller bins gaining, until none is found.

    A donor gives a tokens (one document or two) for b (one document, or 0 for none) to a taker of no more room than its own,
    if 0 < a - b <= the taker's room. For each b, the most room of any bin that holds such a document therefore answers for
    all of them: reach[b] is b and that room, and the least b < a with reach[b] >= a is the best exchange for a.
    """

    def __init__(self, lengths: np.ndarray, bins: list[list[int]], capacity: int):
        self.n, self.capacity = lengths.astype(int).tolist(), capacity
        self.full = [b for b in bins if sum(self.n[i] for i in b) == capacity]
        self.open = [b for b in bins if sum(self.n[i] for i in b) < capacity]
        self.room = [capacity - sum(self.n[i] for i in b) for b in self.open]
        self.moves = 0
        #: length (0: any bin) -> room -> the bins, in order; and the rooms of each length as bits.
        self.where: list[dict[int, dict[int, None]]] = [{} for _ in range(capacity + 1)]
        self.bits = [0] * (capacity + 1)
        self.lengths = np.arange(capacity + 1)
        self.reach = np.full(capacity + 1, -1)

    def run(self) -> list[list[int]]:
        for b in range(len(self.open)):
            self._enter(b)
        before = -1
        while self.moves != before:
            before = self.moves
            self._sweep()
        return self.full + [b for b in self.open if b]

    def _held(self, b: int) -> set[int]:
        return {0, *(self.n[i] for i in self.open[b])}

    def _enter(self, b: int) -> None:
        room = self.room[b]
        if not 0 < room < self.capacity:
            return
        for v in self._held(b):
            self.where[v].setdefault(room, {})[b] = None
            self.bits[v] |= 1 << room

    def _leave(self, b: int) -> None:
        room = self.room[b]
        for v in self._held(b):
            bins = self.where[v][room]
            del bins[b]
            if not bins:
                del self.where[v][room]
                self.bits[v] ^= 1 << room

    def _refresh(self, lengths: Iterable[int], limit: int) -> None:
        """reach of these lengths, over bins with no more room than limit."""
        mask = (2 << limit) - 1
        for v in lengths:
            most = (self.bits[v] & mask).bit_length() - 1
            self.reach[v] = v + most if most > 0 else -1

    def _sweep(self) -> None:
        """All bins give in order of falling room; one that gains on the way gives when its new room's turn comes."""
        queue = [(-r, b) for b, r in enumerate(self.room) if 0 < r < self.capacity]
        heapify(queue)
        if not queue:
            return
        limit = -queue[0][0]
        self._refresh(range(self.capacity + 1), limit)
        while queue:
            room, donor = heappop(queue)
            if self.room[donor] != -room:
                continue
            if -room < limit:
                limit = -room
                self._refresh(np.flatnonzero(self.reach > self.lengths + limit).tolist(), limit)
            self._leave(donor)
            self._refresh(self._held(donor), limit)
            while self.open[donor] and (found := self._best(donor)):
                taker = self._give(donor, *found, limit)
                if self.room[taker]:
                    heappush(queue, (-self.room[taker], taker))
            self._enter(donor)
            self._refresh(self._held(donor), limit)

    def _best(self, donor: int) -> tuple[int, tuple[int, ...], int] | None:
        """The exchange of this donor that moves most: how much, its documents, and the length that comes back."""
        by_length: dict[int, list[int]] = {}
        for i in self.open[donor]:
            by_length.setdefault(self.n[i], []).append(i)
        plans: dict[int, tuple[int, ...]] = {}
        for x, (a, own) in enumerate(by_length.items()):
            for y, (b, other) in enumerate(by_length.items()):
                if y < x:
                    plans[a + b] = (own[0], other[0])
            if len(own) > 1:
                plans[2 * a] = (own[0], own[1])
        plans |= {a: (own[0],) for a, own in by_length.items()}
        most, best = 0, None
        for a, give in plans.items():
            if most < a <= self.capacity:
                able = self.reach[:a] >= a
                b = int(able.argmax())
                if able[b] and a - b > most:
                    most, best = a - b, (a - b, give, b)
        return best

    def _give(self, donor: int, gain: int, give: tuple[int, ...], length: int, limit: int) -> int:
        """Carries an exchange out; the taker."""
        taker = next(iter(self.where[length][int(self.reach[length]) - length]))
        back = [next(i for i in self.open[taker] if self.n[i] == length)] if length else []
        changed = self._held(taker)
        self._leave(taker)
        self.open[donor] = [i for i in self.open[donor] if i not in give] + back
        self.open[taker] = [i for i in self.open[taker] if i not in back] + list(give)
        self.room[donor] += gain
        self.room[taker] -= gain
        self._enter(taker)
        self._refresh(changed | self._held(taker), limit)
        self.moves += 1
        return taker


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths, none above capacity."""
    return LocalSearch(lengths, best_fit(lengths, capacity), capacity).run()


def packed(cut: DataFrame, capacity: int = CAPACITY, shard: int = SHARD) -> DataFrame:
    """Pieces with sequence_id and offset."""
    short = cut.filter(F.col("length") < capacity)
    shards = max(1, -(-short.count() // shard))

    def kernel(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("salt", ignore_index=True)
        lengths = rows["length"].to_numpy()
        sequence, offset = np.zeros(len(rows), dtype=np.int64), np.zeros(len(rows), dtype=np.int64)
        for k, members in enumerate(pack(lengths, capacity)):
            sequence[members] = ((2 * int(key[0]) + 1) << 32) + k
            offset[members] = np.cumsum(lengths[members]) - lengths[members]
        common.trim()
        return rows.assign(sequence_id=sequence, offset=offset, doc_id=rows["doc_id"].astype("Int64")).drop(columns=["salt", "shard"])

    names = [c for c in cut.columns if c != "salt"]
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema if f.name in names)
    some = short.withColumn("shard", F.pmod(F.xxhash64("salt"), F.lit(shards))).groupBy("shard").applyInPandas(kernel, f"{kinds}, sequence_id long, offset long")
    alone = cut.filter(F.col("length") == capacity).select(*names, (F.col("salt") * 2).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return some.unionByName(alone)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    return packed(common.stored(pieces(common.table(spark, sf_dir, "documents")), "pack-pieces"))
