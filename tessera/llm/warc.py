"""WARC archives: written from rows, read back, and indexed by an external merge of sorted capture runs.

Writing is DataFrame work: each record is one string, its WARC header, an empty line and the payload, and Spark's text sink
puts the two empty lines that end a record between them, so that archives reach any file system Spark writes to. A payload
that other rows share is written once; the others become revisit records that name it. Reading walks each archive record
by record by Content-Length, decompressing as it goes, and gives a capture run: index lines sorted by (URL key, timestamp,
page). The runs are tables in the shared folder. The external merge ranges them by that key and merges the runs of a range
with a loser tree, which gives capture histories in global order: ranges follow each other and each is in order.

Defined cases: a null html is an empty payload; a null URL is the empty URL key; a null page_id is written as "null", read
as null, dated as page 0 and loses to any other page; rows that repeat the largest page_id of a payload are all responses;
an empty table gives empty archives and an empty index; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator, Sequence
from typing import Any, NamedTuple
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: Captures have no time of their own here: a page's is this date and as many seconds as its page_id, modulo TURN, so that every
#: date has four digits for the year and dates sort as text.
EPOCH, TURN = 946684800, 1_000_000_000
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Records in an archive, the bytes that they may have if all are as long as the longest, and index lines in a range of the merge.
ARCHIVE_RECORDS, ARCHIVE_BYTES, RANGE_LINES = 4096, 1 << 28, 200_000
LINE = "urlkey string, timestamp string, page_id long, run string, seq long, offset long, length long, payload_bytes long, payload_digest string, record_type string, refers_to long"


class Record(NamedTuple):
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


class LoserTree:
    """k-way merge of sorted sequences: a tournament whose inner nodes hold losers, so that each step replays one path."""

    def __init__(self, runs: Sequence[Sequence[Any]]):
        self.sources = [iter(r) for r in runs]
        self.heads = [next(s, None) for s in self.sources]
        self.k = len(runs)
        self.losers = [-1] * max(1, self.k)
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            held = self.losers[node]
            if held < 0:
                if building:
                    self.losers[node] = winner
                    return
            elif self._before(held, winner):
                self.losers[node], winner = winner, held
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator[Any]:
        while self.k and (head := self.heads[w := self.losers[0]]) is not None:
            yield head
            self.heads[w] = next(self.sources[w], None)
            self._play(w)


def base32_of(hexed: Column) -> Column:
    """Base32 of 40 hex digits: five of them are 20 bits are four letters."""
    letters = []
    for k in range(8):
        bits = F.conv(F.substring(hexed, 5 * k + 1, 5), 16, 10).cast("int")
        letters += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def url_key(url: str) -> str:
    """The sort-friendly key of a URL: host labels reversed, without www, port or fragment, in lower case."""
    try:
        at = urlsplit(url.strip())
        host, port = at.hostname or "", at.port
    except ValueError:
        return url.lower()
    labels = host.removeprefix("www.").split(".")[::-1]
    rest = (at.path or "/") + (f"?{'&'.join(sorted(at.query.split('&')))}" if at.query else "")
    return (",".join(labels) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + rest).lower()


def write(pages: DataFrame, path: str) -> None:
    """Archives of pages (page_id, url, html) below path."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumns({"sha": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html")})
    keys = common.stored(rows.drop("html"), "warc-keys")  # payloads stay where they are until their one response is known
    longest = keys.agg(F.max("bytes")).first()[0] or 0
    last = keys.groupBy("sha", "bytes").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
    again = last.filter("n > 1").select(F.col("sha").alias("of"), F.col("bytes").alias("of_bytes"), "first")
    revisits = keys.join(again, (F.col("sha") == F.col("of")) & (F.col("bytes") == F.col("of_bytes")) & ~F.col("page_id").eqNullSafe(F.col("first")))
    revisits = revisits.select("page_id", "url", F.lit("").alias("html"), "sha", "bytes", "first", F.lit(False).alias("is_first"))
    chosen = last.select(F.col("sha").alias("of"), F.col("bytes").alias("of_bytes"), "first")
    responses = rows.join(chosen, (F.col("sha") == F.col("of")) & (F.col("bytes") == F.col("of_bytes")) & F.col("page_id").eqNullSafe(F.col("first")), "left_semi")
    responses = responses.select("page_id", "url", "html", "sha", "bytes", F.lit(None).cast("long").alias("first"), F.lit(True).alias("is_first"))
    both, is_first = responses.unionByName(revisits), F.col("is_first")
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    date = F.date_format(F.timestamp_seconds(F.lit(EPOCH) + F.pmod(F.coalesce("page_id", F.lit(0)), F.lit(TURN))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    lines: list[Column] = [F.lit("WARC/1.1\r\nWARC-Type: "), F.when(is_first, "response").otherwise("revisit")]
    one_line = F.regexp_replace("url", r"[\r\n]+", " ")
    for key, value in (("WARC-Record-ID", name(F.col("page_id"))), ("WARC-Target-URI", one_line), ("WARC-Date", date), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32_of(F.col("sha"))))):
        lines += [F.lit(f"\r\n{key}: "), value]
    lines += [F.when(is_first, F.lit("")).otherwise(F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), name(F.col("first"))))]
    lines += [F.lit("\r\nContent-Length: "), F.when(is_first, F.col("bytes")).otherwise(0).cast("string"), F.lit(END), F.when(is_first, F.col("html")).otherwise("")]
    both.select(F.concat(*lines).alias("record")).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", max(1, min(ARCHIVE_RECORDS, ARCHIVE_BYTES // max(1, longest)))).text(path)


def _plain(stored: bytes) -> Iterator[bytes]:
    if not stored.startswith(b"\x1f\x8b"):
        yield stored
        return
    rest = stored
    while rest:
        z = zlib.decompressobj(31)
        at = 0
        while at < len(rest) and not z.eof:
            yield z.decompress(rest[at : at + 262144])
            at += 262144
        yield z.flush()
        rest = z.unused_data + rest[at:] if z.eof else b""


def records(stored: bytes) -> Iterator[Record]:
    """The records of an archive, one at a time; offsets and lengths are those of the plain archive."""
    held, done, parts = bytearray(), 0, _plain(stored)
    ended = False

    def more() -> bool:
        part = next(parts, None)
        if part is not None:
            held.extend(part)
        return part is not None

    while not ended:
        while (cut := held.find(b"\r\n\r\n")) < 0:
            if not more():
                ended = True
                break
        if ended:
            break
        first, *rest = bytes(held[:cut]).decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"no record at {done}: {first[:40]!r}")
        headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in rest)
        size = int(headers["Content-Length"])
        while len(held) < cut + 4 + size + 4 and more():
            pass
        if len(held) < cut + 4 + size:
            raise ValueError(f"record at {done} is cut short")
        yield Record(done, cut + 4 + size, headers, bytes(held[cut + 4 : cut + 4 + size]))
        del held[: cut + 8 + size]
        done += cut + 8 + size
    if held.strip():
        raise ValueError(f"{len(held)} bytes after the last record")


def _page(name: str) -> int | None:
    x = name.removeprefix("<urn:page:").removesuffix(">")
    return None if x == "null" else int(x)


def _run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each archive as a sorted capture run."""
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"], strict=True):
            lines = []
            for r in records(bytes(content)):
                h, first = r.headers, r.headers["WARC-Type"] == "response"
                digest = base64.b32encode(hashlib.sha1(r.payload).digest()).decode() if first else h["WARC-Payload-Digest"].removeprefix("sha1:")
                if first and h["WARC-Payload-Digest"] != f"sha1:{digest}":
                    raise ValueError(f"{path}: payload at {r.offset} has another digest")
                lines.append((url_key(h["WARC-Target-URI"]), "".join(x for x in h["WARC-Date"] if x.isdigit()), _page(h["WARC-Record-ID"]), path.rsplit("/", 1)[-1], 0, r.offset, r.length, len(r.payload) if first else None, digest, h["WARC-Type"], None if first else _page(h["WARC-Refers-To"])))
            lines.sort(key=lambda x: (x[0], x[1], -1 if x[2] is None else x[2]))
            out = pd.DataFrame(lines, columns=[c.split()[0] for c in LINE.split(", ")])
            out["seq"] = range(len(out))
            for c in ("page_id", "payload_bytes", "refers_to"):
                out[c] = out[c].astype("Int64")
            yield out


def runs(spark: SparkSession, path: str) -> DataFrame:
    """The archives below path as sorted capture runs."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(_run, LINE)


def _merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of one range, run after run and each in order: merged."""
    held = [b for b in batches if len(b)]
    if not held:
        return
    rows = pd.concat(held, ignore_index=True)
    keys = list(zip(rows["urlkey"], rows["timestamp"], rows["page_id"].fillna(-1), rows.index, strict=True))
    starts = [0, *(rows.index[rows["run"].ne(rows["run"].shift())][1:]), len(rows)]
    order = [k[-1] for k in LoserTree([keys[a:b] for a, b in zip(starts, starts[1:], strict=False)])]
    out = rows.iloc[order]
    for c in ("page_id", "payload_bytes", "refers_to"):
        out = out.assign(**{c: out[c].astype("Int64")})
    yield out


def histories(index_runs: DataFrame) -> DataFrame:
    """The runs merged into capture histories in global order of (urlkey, timestamp, page_id)."""
    ranges = max(1, -(-index_runs.count() // RANGE_LINES))
    dealt = index_runs.repartitionByRange(max(ranges, min(common.parts(index_runs.sparkSession), 64)), "urlkey", "timestamp", "page_id")
    return dealt.sortWithinPartitions("run", "seq").mapInPandas(_merge, LINE)


def resolved(index: DataFrame) -> DataFrame:
    """The index with the payload size of each revisit taken from the response that it refers to."""
    first = index.filter("record_type = 'response'").select(F.col("page_id").alias("_of"), F.col("payload_bytes").alias("_bytes"), F.col("payload_digest").alias("_digest")).distinct()
    both = index.join(first, (F.col("refers_to") == F.col("_of")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return both.withColumn("payload_bytes", F.coalesce("payload_bytes", "_bytes")).drop("_of", "_bytes", "_digest")


def op10_warc_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    common.ship(spark)
    path = common.fresh(spark, "warc")
    write(common.table(spark, sf_dir, "pages"), path)
    index = common.stored(histories(common.stored(runs(spark, path), "warc-runs")), "warc-index")
    return resolved(index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp", F.col("run").alias("archive"), "offset", "length")
