"""Text, Markdown, DOCX and PDF files as documents, with bounds on what is unpacked."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.shipping import ship

from . import pdf
from .decoding import decode

WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
DOCUMENT = "path string, kind string, encoding string, text string, problem string"
#: Bytes of one part unpacked, parts of a container, and how many times smaller a packed part may be.
MOST_BYTES, MOST_PARTS, MOST_RATIO = 64 << 20, 4096, 200


def container(content: bytes, wanted: str) -> bytes:
    """A part of a zip container, refused where it is too large, too many or packed too tightly."""
    with zipfile.ZipFile(io.BytesIO(content)) as box:
        if len(box.infolist()) > MOST_PARTS:
            raise ValueError("too many parts")
        part = box.getinfo(wanted)
        if part.file_size > MOST_BYTES or part.file_size > MOST_RATIO * max(1, part.compress_size):
            raise ValueError("part too large")
        with box.open(part) as f:
            data = f.read(MOST_BYTES + 1)
    if len(data) > MOST_BYTES:
        raise ValueError("part too large")
    return data


def docx_text(content: bytes) -> str:
    """The paragraphs of a Word document, a line each; tabs and breaks kept, deleted text and instructions left out."""
    xml = container(content, "word/document.xml")
    if b"<!DOCTYPE" in xml[:4096].upper():
        raise ValueError("document type declared")
    lines = []
    for paragraph in ElementTree.fromstring(xml).iter(f"{WORD}p"):
        out = []
        for x in paragraph.iter():
            if x.tag == f"{WORD}t":
                out.append(x.text or "")
            elif x.tag == f"{WORD}tab":
                out.append("\t")
            elif x.tag in (f"{WORD}br", f"{WORD}cr"):
                out.append("\n")
        lines.append("".join(out))
    return "\n".join(lines)


def text_of(path: str, content: bytes) -> tuple[str, str, str | None, str | None]:
    """kind, encoding, text and what went wrong."""
    if content[:4] == b"PK\x03\x04":
        try:
            return "docx", "utf-8", docx_text(content), None
        except (ValueError, KeyError, zipfile.BadZipFile, ElementTree.ParseError) as e:
            return "docx", "", None, f"{type(e).__name__}: {e}"
    if b"%PDF-" in content[:1024]:
        try:
            found = pdf.extracted(content)
        except (ValueError, TypeError, LookupError, OverflowError) as e:
            return "pdf", "", None, f"{type(e).__name__}: {e}"
        lost = f"{found.undecodable} glyphs without a character" if found.undecodable else None
        return "pdf", "", found.text, lost if found.text_ops else "no text layer"
    if b"\x00" in content[:1024] and decode(content)[1] == "utf-8-loose":
        return "binary", "", None, "no text"
    text, encoding = decode(content)
    return "markdown" if path.lower().endswith((".md", ".markdown")) else "text", encoding, text, None


def read(spark: SparkSession, path: str, most: int = 64 << 20) -> DataFrame:
    """All files below path as documents; a file of more bytes, or one that cannot be read, has a problem and no text.

    Files without a byte have no row: Spark's reader passes over them."""
    ship(spark)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *(text_of(p, bytes(c)) if c is not None else ("skipped", "", None, "too large"))) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame(rows, columns=["path", "kind", "encoding", "text", "problem"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = files.filter(f"length <= {int(most)}").select("path", "content")
    large = files.filter(f"length > {int(most)}").selectExpr("path", "cast(null as binary) content")
    return small.unionByName(large).mapInPandas(kernel, DOCUMENT)
