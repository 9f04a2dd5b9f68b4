"""Bibliographic exports in five dialects, told apart by their first lines and read into one shape."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tessera.shipping import ship

from .decoding import decode

RECORD = "path string, format string, ordinal int, title string, authors array<string>, venue string, year string, volume string, issue string, pages string, doi string, locator string, keywords array<string>, abstract string"
FIELDS = ("title", "authors", "venue", "year", "volume", "issue", "pages", "doi", "locator", "keywords", "abstract")
LISTS = ("authors", "keywords")
#: What the tags of each dialect mean.
PERCENT = {"T": "title", "A": "authors", "E": "authors", "J": "venue", "B": "venue", "D": "year", "V": "volume", "7": "volume", "N": "issue", "P": "pages", "R": "doi", "U": "locator", "K": "keywords", "X": "abstract"}
RIS = {"TI": "title", "T1": "title", "AU": "authors", "A1": "authors", "JO": "venue", "JF": "venue", "T2": "venue", "PY": "year", "Y1": "year", "DA": "year", "VL": "volume", "IS": "issue", "SP": "pages", "EP": "pages", "DO": "doi", "UR": "locator", "KW": "keywords", "AB": "abstract", "N2": "abstract"}
BIBTEX = {"title": "title", "author": "authors", "journal": "venue", "booktitle": "venue", "year": "year", "date": "year", "volume": "volume", "number": "issue", "pages": "pages", "doi": "doi", "url": "locator", "keywords": "keywords", "abstract": "abstract"}
PLAIN = {"摘要": "abstract", "关键词": "keywords", "作者": "authors", "题名": "title", "刊名": "venue", "年": "year"}
_YEAR = re.compile(r"(?<!\d)(1[5-9]\d\d|20\d\d)(?!\d)")
_HAN = re.compile(r"[一-鿿]")
_CITE = re.compile(r"\[[A-Z]{1,3}(?:/[A-Z]{1,3})?\]")
_RIS_LINE = re.compile(r"^([A-Z][A-Z0-9])  ?-\s?(.*)$")
_ENTRY = re.compile(r"@([A-Za-z]+)\s*[{(]\s*([^,\s{}]*)\s*,")
_LABEL = re.compile(r"^[【\[]?(" + "|".join(PLAIN) + r")[】\]]?\s*[:：]?\s*(.+)$")


def year_of(text: str) -> str:
    """The first year between 1500 and 2099, or nothing."""
    found = _YEAR.search(text or "")
    return found[0] if found else ""


def joined(before: str, more: str) -> str:
    """A wrapped line put behind what came before it: without a space between Han signs."""
    if not before or not more:
        return before or more
    return before + more if _HAN.match(before[-1]) and _HAN.match(more[0]) else f"{before} {more}"


def names(text: str, commas: bool = False) -> list[str]:
    """A list of names or keywords: parted by semicolons, " and ", and commas if asked for."""
    parts = re.split(r"[;；]|\sand\s" + ("|[,，]" if commas else ""), text)
    return [p.strip() for p in parts if p.strip()]


def _empty() -> dict[str, Any]:
    return {f: [] if f in LISTS else "" for f in FIELDS}


def _put(record: dict[str, Any], field: str, value: str, wrapped: bool = False) -> None:
    value = value.strip()
    if not value:
        return
    if field in LISTS:
        record[field] += [n for n in names(value, field == "keywords") if n not in record[field]]
    elif field == "year":
        record["year"] = record["year"] or year_of(value)
    elif field == "pages" and record["pages"] and not wrapped:
        record["pages"] += f"-{value}"
    elif wrapped:
        record[field] = joined(record[field], value)
    else:
        record[field] = record[field] or value


def _tagged(text: str, start: Callable[[str], tuple[str, str] | None], fields: dict[str, str], opens: str, closes: str) -> Iterator[dict]:
    """Line by line: a tag begins a field, a line without one goes on with it; opens begins a record, closes ends it."""
    record: dict | None = None
    last = ""
    for line in text.splitlines():
        if not line.strip():
            continue
        if (tag := start(line)) is None:
            if record is not None and last in fields:
                _put(record, fields[last], line, wrapped=True)
            continue
        last, value = tag
        if last == opens or (record is None and last != closes):
            if record is not None:
                yield record
            record = _empty()
        if last == closes:
            if record is not None:
                yield record
            record, last = None, ""
        elif last in fields and record is not None:
            _put(record, fields[last], value)
    if record is not None:
        yield record


def _percent(text: str) -> Iterator[dict]:
    def tag(line: str) -> tuple[str, str] | None:
        return (line[1], line[2:]) if len(line) > 1 and line[0] == "%" and (line[1].isalnum() or line[1] in "@!") else None

    return _tagged(text, tag, PERCENT, "0", "")


def _ris(text: str) -> Iterator[dict]:
    def tag(line: str) -> tuple[str, str] | None:
        found = _RIS_LINE.match(line)
        return (found[1], found[2]) if found else None

    return _tagged(text, tag, RIS, "TY", "ER")


def _value(text: str, at: int) -> tuple[str, int]:
    """A BibTeX value from at on: braces may nest, quotes hold braces, other values end at a comma. What is not closed ends with the text."""
    if at < len(text) and text[at] in '{"':
        depth, k, quoted = 0, at, text[at] == '"'
        while k < len(text):
            c = text[k]
            if c == "{":
                depth += 1
            elif c == "}":
                depth -= 1
            if (not quoted and depth == 0) or (quoted and k > at and c == '"' and depth == 0):
                return text[at + 1 : k], k + 1
            k += 1
        return text[at + 1 :], len(text)
    end = min((p for p in (text.find(",", at), text.find("}", at), text.find("\n", at)) if p >= 0), default=len(text))
    return text[at:end], end


def _bibtex(text: str) -> Iterator[dict]:
    entries = [m for m in _ENTRY.finditer(text) if m[1].lower() not in ("comment", "string", "preamble")]
    for m, after in zip(entries, [*(e.start() for e in entries[1:]), len(text)], strict=True):
        record, at = _empty(), m.end()
        while field := re.compile(r"[\s,]*([A-Za-z_-]+)\s*=\s*").match(text, at, after):
            value, at = _value(text[:after], field.end())
            if name := BIBTEX.get(field[1].lower()):
                _put(record, name, re.sub(r"\s+", " ", value.replace("{", "").replace("}", "")))
        yield record


def cite_line(line: str) -> dict[str, Any]:
    """A line of the kind "[1] Names. Title[J]. Venue, 2021, 57(3): 12-20"."""
    mark = _CITE.search(line)
    head = re.sub(r"^\s*(?:\[\d+\]|\(\d+\)|\d+[.、])\s*", "", line[: mark.start()]).strip()
    tail = line[mark.end() :].lstrip(" .。")
    record = _empty()
    cut = max(head.rfind("."), head.rfind("。"))
    record["authors"], record["title"] = (names(head[:cut], commas=True), head[cut + 1 :].strip()) if cut >= 0 else ([], head)
    record["venue"] = re.sub(r"^[^:：]{1,12}[:：]\s*", "", re.split("[,，.。]", tail, maxsplit=1)[0]).strip()
    record["year"] = year_of(tail)
    if found := re.search(r"(\d+)\s*[（(]\s*([\w./-]+)\s*[)）]", tail):
        record["volume"], record["issue"] = found[1], found[2].lstrip("0") or found[2]
    if found := re.search(r"[:：]\s*([A-Z]?\d+(?:\s*[-–+]\s*[A-Z]?\d+)?)", tail):
        record["pages"] = re.sub(r"\s", "", found[1])
    return record


def _plain(text: str) -> Iterator[dict]:
    record: dict | None = None
    last = ""
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        if (mark := _CITE.search(line)) and len(line) > mark.end():
            if record is not None:
                yield record
            record, last = cite_line(line), ""
        elif field := _LABEL.match(line):
            record = record or _empty()
            last = PLAIN[field[1]]
            _put(record, last, field[2])
        elif record is not None and last == "abstract":
            _put(record, "abstract", line, wrapped=True)
    if record is not None:
        yield record


def format_of(text: str) -> str:
    """What the first 200 lines look like: ris, percent, bibtex, plain, or document."""
    lines = text.splitlines()[:200]
    if any(_ENTRY.match(x.strip()) for x in lines):
        return "bibtex"
    tags = [m[1] for x in lines if (m := _RIS_LINE.match(x))]
    if "TY" in tags or len({"TI", "AU", "AB", "ER"} & set(tags)) > 1:
        return "ris"
    if sum(bool(re.match(r"%[0-9A-Z@]\s", x)) for x in lines) > 1:
        return "percent"
    cited = sum(bool(_CITE.search(x)) and len(x) < 400 for x in lines)
    filled = sum(bool(x.strip()) for x in lines)
    return "plain" if cited and 3 * cited >= filled or any(_LABEL.match(x.strip()) for x in lines[:5]) else "document"


PARSERS = {"percent": _percent, "ris": _ris, "bibtex": _bibtex, "plain": _plain}


def parse(text: str) -> tuple[str, list[dict]]:
    """(format, records); a document has none. Records without a title and without an abstract go."""
    kind = format_of(text)
    return kind, [r for r in PARSERS[kind](text) if r["title"] or r["abstract"]] if kind in PARSERS else []


def read(spark: SparkSession, path: str, most: int = 32 << 20) -> DataFrame:
    """The records of all files below path: one task reads a file, of at most so many bytes; larger ones have no records."""
    ship(spark)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                kind, found = parse(decode(bytes(content))[0])
                yield pd.DataFrame([{"path": name, "format": kind, "ordinal": k, **r} for k, r in enumerate(found)], columns=["path", "format", "ordinal", *FIELDS])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter(f"length <= {int(most)}")
    return files.select("path", "content").mapInPandas(kernel, RECORD)
