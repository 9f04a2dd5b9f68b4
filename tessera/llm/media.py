"""Texts as lossless images: stored as WebP, read back, and described by features of their samples.

A text's UTF-8 bytes, padded with bytes 255 (which UTF-8 never holds) to a positive multiple of ROW, are the samples of an
image of WIDTH pixels a row and four 8-bit channels. Images of more than ROWS rows are cut into images of so many rows, whose
files follow each other, so that no image is large and one that is long keeps no task waiting. What an image is like decides
how it is stored: few colours take a palette, rows that repeat take back-references and a colour cache, all else prefix
codes alone, which suit text best. The stored bytes are a table in the shared folder, and features come from what is
read back from there.

Defined cases: null and empty texts are one row of padding; equal texts have equal stored forms and features; null and
repeated doc_ids are kept row by row; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, webp

WIDTH, ROWS = 144, 32
ROW = 4 * WIDTH
#: Where the counts of each channel begin; bits that a symbol's code and a transform take, about.
OFFSETS, CODE_BITS, TRANSFORM_BITS = np.arange(4) * 256, 4, 200
#: Images that are coded at once, about.
BATCH = 1024
READ = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    return text + b"\xff" * (-len(text) % ROW or (0 if text else ROW))


def images(data: bytes) -> list[np.ndarray]:
    rows = np.frombuffer(data, dtype=np.uint8).reshape(-1, WIDTH, 4)
    return [rows[k : k + ROWS] for k in range(0, len(rows), ROWS)]


def _form(image: np.ndarray) -> dict | None:
    """How an image is stored that prefix codes alone don't suit."""
    numbers = np.ascontiguousarray(image).view("<u4").reshape(len(image), WIDTH)
    if len(image) == 1 and (numbers[0, 16:] == numbers[0, -1]).all() or len(np.unique(numbers[0])) <= 16 and len(np.unique(numbers)) <= 16:
        return {"palette": True, "matches": True}
    if len(image) >= 4 and len(np.unique(numbers, axis=0)) * 2 <= len(image):
        return {"matches": True, "cache_bits": 6}
    return _transform(image)


def _bits(x: np.ndarray) -> float:
    """What the samples take by the entropy of each channel, and about so much for the codes themselves."""
    counts = np.bincount((x.reshape(-1, 4) + OFFSETS).ravel(), minlength=1024)
    some = counts[counts > 0]
    n = x.size // 4
    return float((some * np.log2(n / some)).sum()) + CODE_BITS * len(some)


def _slope(of: np.ndarray, by: np.ndarray) -> int:
    """The multiplier, in 32nds, by which one channel follows another best."""
    a, b = of.astype(np.int8).astype(np.float64), by.astype(np.int8).astype(np.float64)
    return int(np.clip(np.rint(32 * (a * b).sum() / max((b * b).sum(), 1.0)), -128, 127))


def _transform(image: np.ndarray) -> dict | None:
    """The transform of an image whose residuals take the fewest bits, or none where the samples themselves do."""
    green, red, blue = image[..., 0], image[..., 1], image[..., 2]
    cross = (_slope(red, green), _slope(blue, green), 0)
    options = [{"subtract_green": True}, {"cross_colour": cross}, *({"predictor": m} for m in (1, 2))]
    least, best = _bits(image) - TRANSFORM_BITS, None
    for o in options:
        if (bits := _bits(_residual(image, o))) < least:
            least, best = bits, o
    return best


def _residual(image: np.ndarray, option: dict) -> np.ndarray:
    out = image.copy()
    if "subtract_green" in option:
        out[..., 1:3] -= image[..., :1]
    elif "cross_colour" in option:
        green = image[..., 0].astype(np.int8).astype(np.int32)
        for k, by in zip((1, 2), option["cross_colour"], strict=False):
            out[..., k] -= (by * green >> 5).astype(np.uint8)
    elif option["predictor"] == 1:
        out[:, 1:] -= image[:, :-1]
    else:
        out[1:] -= image[:-1]
    return out


def stored_forms(payloads: list[bytes]) -> list[bytes]:
    """The stored form of each payload."""
    parts = [images(p) for p in payloads]
    flat = [i for own in parts for i in own]
    forms = [_form(i) for i in flat]
    plain = iter(webp.encode_many([i for i, f in zip(flat, forms, strict=True) if f is None]))
    done = iter([next(plain) if f is None else webp.encode(i, **f) for i, f in zip(flat, forms, strict=True)])
    return [b"".join(next(done) for _ in own) for own in parts]


def read_back(media: list[bytes]) -> list[bytes]:
    """The payload of each stored form."""
    files, counts = [], []
    for m in media:
        at = n = 0
        while at < len(m):
            size = int.from_bytes(m[at + 4 : at + 8], "little") + 8
            files.append(m[at : at + size])
            at, n = at + size, n + 1
        counts.append(n)
    done = iter(webp.decode_many(files))
    return [b"".join(next(done).tobytes() for _ in range(n)) for n in counts]


def feature(samples: np.ndarray) -> str:
    """Rows, and of all samples the sum, the sum of squares, and the sums of absolute steps along a row and down a column."""
    x = samples.reshape(-1, WIDTH, 4).astype(np.int32)
    along, down = np.abs(np.diff(x, axis=1)).sum(dtype=np.int64), np.abs(np.diff(x, axis=0)).sum(dtype=np.int64)
    return f"{len(x)}:{x.sum(dtype=np.int64)}:{np.square(x).sum(dtype=np.int64)}:{along}:{down}"


def _runs(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of rows that hold about BATCH full images' worth of bytes or rows."""
    cost = np.cumsum(sizes + 2048)
    at = 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + BATCH * 8192, side="right")))
        yield at, end
        at = end


def write(docs: DataFrame) -> DataFrame:
    """doc_id, media: the stored form of each text."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column("raw")
            sizes = np.diff(np.frombuffer(raw.buffers()[1], dtype=np.int32)[raw.offset : raw.offset + len(raw) + 1]).astype(np.int64)
            for a, b in _runs(sizes):
                media = stored_forms([payload(x) for x in raw.slice(a, b - a).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), pa.array(media, type=pa.binary())], names=["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.text_of().cast("binary").alias("raw")).mapInArrow(kernel, "doc_id long, media binary")


def read(media: DataFrame) -> DataFrame:
    """What the stored forms hold: READ."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("media")
            sizes = np.diff(np.frombuffer(held.buffers()[1], dtype=np.int32)[held.offset : held.offset + len(held) + 1]).astype(np.int64)
            for a, b in _runs(2 * sizes):
                forms = held.slice(a, b - a).to_pylist()
                rows = [(len(p.rstrip(b"\xff")), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(np.frombuffer(p, dtype=np.uint8))) for p, m in zip(read_back(forms), forms, strict=True)]
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), *(pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))], names=[c.split()[0] for c in READ.split(", ")])

    return media.mapInArrow(kernel, READ)


def op9_lossless_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    path = common.fresh(spark, "media")
    made = write(common.table(spark, sf_dir, "documents"))
    made.write.option("compression", "none").parquet(path)
    return read(spark.read.schema(made.schema).parquet(path))
