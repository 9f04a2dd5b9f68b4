"""Headings, citations and quotations: what a comparison leaves out or marks apart."""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import measures, text as T

#: Titles of sections that are no prose; lists of references and of contents among them. The lists are a parameter of structure().
REFERENCES = ("参考文献", "主要参考文献", "引用文献", "references", "bibliography", "works cited", "literature cited")
CONTENTS = ("目录", "目次", "contents", "table of contents")
OTHERS = ("致谢", "谢辞", "附录", "acknowledgements", "acknowledgments", "acknowledgement", "appendix", "appendices")
#: Signs of a line of references on folded text, and what each adds.
INDEXED = r"^(?:\[\d{1,3}\]|\(\d{1,3}\)|\d{1,3}[.,)]|[a-z]\.|\d{1,3}-\d{1,3})\s*"
TYPED = r"\[[a-z]{1,3}(?:/[a-z]{1,3})?\]"
SOURCED = "学报|期刊|杂志|论文集|学位论文|毕业设计|出版社|书局|书店|印刷厂|技术报告|proceedings|journal|press|transactions|springer|elsevier|ieee|acm|publisher"
DATED, NAMED = r"(?:1[5-9]|20)\d{2}", r"doi|isbn|issn|pmid|arxiv|et al|访问日期|引用日期|收稿日期|页码|文档编号|\bpp\b"
PAGED, INITIALS, DOTTED = r"\d+\s*[-~]\s*\d+", r"(?:[a-z][a-z]*[ ,]+[a-z]\.){2,}", r"(?:[^.]*\.){3}"
SCORES = ((INDEXED, 2), (TYPED, 2), (SOURCED, 1), (DATED, 1), (NAMED, 1), (PAGED, 1), (INITIALS, 1), (DOTTED, 1))
CHAPTER = r"^(?:[0-9]{1,2}(?:[.][0-9]{1,2})*\s+\S|第?[零一二三四五六七八九十百]{1,4}(?:章|节|部分))"
LEADER = r"^\S[^\n]{0,80}(?:[.·…]{2,} *| {2,}|\t)[0-9]{1,4}$"
#: Pairs of quotation marks, and how long a quotation is.
QUOTES = (("“", "”"), ("‘", "’"), ("「", "」"), ("『", "』"), ('"', '"'))
QUOTED = (8, 4000)
PROSE, LEAST_ENTRIES, RUN = 40, 2, 3


def citation_like(line: Column) -> Column:
    """Whether a line reads like an entry of a list of references: signs that add up to 3, one of them an index, a type or a source."""
    norm = F.trim(T.folded(line))
    points = sum((F.when(norm.rlike(p), n).otherwise(0) for p, n in SCORES), F.lit(0))
    return F.length(norm).between(6, 400) & (points >= 3) & (norm.rlike(INDEXED) | norm.rlike(TYPED) | norm.rlike(SOURCED))


def is_citation(line: str) -> bool:
    norm = measures.folded(line).strip()
    points = sum(n for p, n in SCORES if re.search(p, norm))
    return 6 <= len(norm) <= 400 and points >= 3 and any(re.search(p, norm) for p in (INDEXED, TYPED, SOURCED))


def is_entry(line: str) -> bool:
    """A citation that also names its type or an identifier."""
    norm = measures.folded(line)
    return is_citation(line) and bool(re.search(TYPED, norm) or re.search(NAMED, norm))


def query_entry(text: Column) -> Column:
    """Whether a whole query is one entry: an index and a year, 20 to 600 characters."""
    return F.length(text).between(20, 600) & text.rlike(r"^\s*[\[【(（]?\d{1,4}[\]】)）.、]") & text.rlike(r"(?<!\d)(?:1[5-9]\d\d|2[01]\d\d|2200)(?!\d)")


def title(line: str) -> str:
    """A heading as it is compared: without number, trailing page or signs, and blanks."""
    norm = re.sub(r"[\s:：.·…]*\d*[\s:：]*$", "", measures.folded(line).strip())
    return re.sub(r"^(?:第?[零一二三四五六七八九十百\d]{1,4}[章节、.]?|\d+(?:\.\d+)*)[\s.、]*", "", norm).replace(" ", "")


def heading(line: str) -> str | None:
    """references, contents or other for the title of a section without prose."""
    if not 0 < len(line.strip()) <= 40:
        return None
    of = title(line)
    for kind, titles in (("references", REFERENCES), ("contents", CONTENTS), ("other", OTHERS)):
        if of in {t.replace(" ", "") for t in titles} or kind == "other" and any(of.startswith(t) for t in OTHERS) and len(of) <= 20 and not re.search("[.!?;]", of):
            return kind
    return None


def line_spans(text: str) -> list[tuple[int, int]]:
    """Where the lines of T.lines() stand."""
    out = []
    for m in re.finditer("[^\n\r\x0b\x0c  ]+", text):
        own = m[0]
        a, b = m.start() + len(own) - len(own.lstrip(T.BLANKS)), m.end() - len(own) + len(own.rstrip(T.BLANKS))
        if b > a:
            out.append((a, b))
    return out


def _section(lines: list[str], first: int, kind: str) -> tuple[int, int, int]:
    """Where a section that begins after a heading ends, and its entries and leaders: at the next heading or chapter, or at prose in a list."""
    entries = leaders = 0
    for k in range(first, len(lines)):
        leader = bool(re.search(LEADER, lines[k]))
        entry = is_citation(lines[k])
        if heading(lines[k]) or not leader and kind != "contents" and re.search(CHAPTER, measures.folded(lines[k])):
            return k, entries, leaders
        if kind != "other" and not entry and not leader and len(lines[k]) >= PROSE:
            return k, entries, leaders
        entries += entry
        leaders += leader
    return len(lines), entries, leaders


def structure(text: str) -> list[tuple[int, int, str]]:
    """Sections that are no prose, and runs of entries without a heading: start, end, kind, merged where they touch."""
    spans = line_spans(text)
    lines = [text[a:b] for a, b in spans]
    found = []
    for k, line in enumerate(lines):
        if kind := heading(line):
            end, entries, leaders = _section(lines, k + 1, kind)
            if kind == "references" and entries < LEAST_ENTRIES or kind == "contents" and leaders < LEAST_ENTRIES:
                continue
            found.append((spans[k][0], spans[end - 1][1], kind))
    for a, b in _runs([is_entry(x) for x in lines]):
        if b - a >= RUN and not any(s <= spans[a][0] and spans[b - 1][1] <= e for s, e, _ in found):
            found.append((spans[a][0], spans[b - 1][1], "references"))
    merged: list[tuple[int, int, str]] = []
    for a, b, kind in sorted(found):
        if merged and a <= merged[-1][1] + 1:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2])
        else:
            merged.append((a, b, kind))
    return merged


def _runs(flags: list[bool]) -> Iterator[tuple[int, int]]:
    at = 0
    for k, f in enumerate([*flags, False]):
        if not f:
            if k > at:
                yield at, k
            at = k + 1


def quotations(text: str) -> list[tuple[int, int]]:
    """Quoted stretches with their marks, of 8 to 4000 characters between them, in one line, merged."""
    found = []
    for a, b in QUOTES:
        found += [m.span() for m in re.finditer(f"{a}([^{a}{b}\n\r]{{{QUOTED[0]},{QUOTED[1]}}}){b}", text)]
    merged: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1] = (merged[-1][0], max(b, merged[-1][1]))
        else:
            merged.append((a, b))
    return merged
