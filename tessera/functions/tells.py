"""Tells: rules of a table, held against sentences, paragraphs or a whole text."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from . import measures


class Tell(NamedTuple):
    """scope: sent, para or doc; kind: regex, or struct, whose spec names a structure below; cap: most hits that are told."""

    name: str
    scope: str
    kind: str
    spec: str
    cap: int = 3
    ratio: float = 1.0


class Hit(NamedTuple):
    name: str
    start: int
    end: int


STRUCTURES = {
    "triples": lambda body: measures.triples(measures.clauses(body)) > 0,
    "equal_sentences": lambda body: measures.document(body)[0].flat_ratio >= 0.5,
    "labels": lambda body: len(re.findall(r"[^\s:]{2,14}:\S", body)) > 1,
}


def parts(text: str, scope: str) -> list[tuple[int, int]]:
    if scope == "doc":
        return [(0, len(text))]
    return measures.sentence_spans(text) if scope == "sent" else [m.span() for m in re.finditer(r"[^\n\r]+", text)]


def scan(text: str, rules: Sequence[Tell]) -> list[Hit]:
    """The hits of all rules, by rule and place, each rule up to its cap; what is read is the folded text."""
    norm, out = measures.folded(text), []
    for r in rules:
        found: list[Hit] = []
        for a, b in parts(text, r.scope):
            if r.kind == "regex":
                found += [Hit(r.name, a + m.start(), a + m.end()) for m in re.finditer(r.spec, norm[a:b])]
            elif STRUCTURES[r.spec](norm[a:b]):
                found.append(Hit(r.name, a, b))
        out += found[: r.cap]
    return out


def work_order(hits: Sequence[Hit], rules: Sequence[Tell]) -> list[Hit]:
    """Rules that set the sides apart most first, then by place."""
    ratio = {r.name: r.ratio for r in rules}
    return sorted(hits, key=lambda h: (-ratio.get(h.name, 0.0), h.start, h.end))


def fanned(hits: Sequence[Hit], spans: Sequence[tuple[int, int]]) -> list[list[str]]:
    """The names of the hits that each sentence is touched by: what is told of a paragraph or text is told of all its sentences."""
    return [sorted({h.name for h in hits if h.start < b and h.end > a}) for a, b in spans]
