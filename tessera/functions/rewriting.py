"""Rewriting of single texts under protection: masks, rules, sentence splits, and a loop that keeps what lowers a measure. Plain Python, for kernels."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

from . import blocks, measures

#: What a rewrite must not touch: citations, formulas, addresses, numbers with units.
PROTECTED = (r"\[\d+(?:[-,]\d+)*\]", r"\$[^$\n]{1,200}\$", r"https?://\S+", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+", r"\d+(?:\.\d+)?\s?(?:%|℃|mm|cm|kg|ms|GB|MB)")
#: Masks are private-use signs, one for each protected stretch.
FIRST_MASK, MOST_MASKS = 0xE000, 6400


class Masked(NamedTuple):
    text: str
    held: list[str]


def masked(text: str, terms: Sequence[str] = (), patterns: Sequence[str] = PROTECTED) -> Masked:
    """A text with each protected stretch, the longest first, replaced by a sign of its own. A text that holds such signs is refused."""
    if any(FIRST_MASK <= ord(c) < FIRST_MASK + MOST_MASKS for c in text):
        raise ValueError("the text holds signs that masks are made of")
    every = [re.escape(t) for t in sorted(filter(None, terms), key=len, reverse=True)] + list(patterns)
    held: list[str] = []

    def put(m: re.Match) -> str:
        if len(held) >= MOST_MASKS:
            return m[0]
        held.append(m[0])
        return chr(FIRST_MASK + len(held) - 1)

    return Masked(re.sub("|".join(f"(?:{p})" for p in every), put, text) if every else text, held)


def restored(text: str, held: Sequence[str]) -> str | None:
    """The text with its stretches back; None where one is missing, doubled or unknown."""
    signs = [c for c in text if FIRST_MASK <= ord(c) < FIRST_MASK + MOST_MASKS]
    if sorted(signs) != [chr(FIRST_MASK + k) for k in range(len(held))]:
        return None
    return "".join(held[ord(c) - FIRST_MASK] if FIRST_MASK <= ord(c) < FIRST_MASK + MOST_MASKS else c for c in text)


class Rule(NamedTuple):
    name: str
    pattern: str
    by: str
    clause_start: bool = False


def applied(text: str, rule: Rule, times: int = 1) -> str:
    """A rule at its first so many places; one for clause starts only behind a sign or at the beginning."""
    left = times

    def put(m: re.Match) -> str:
        nonlocal left
        before = text[m.start() - 1 : m.start()]
        if not left or rule.clause_start and before and not re.match(r"[\s,;.!?，；。！？、：]", before):
            return m[0]
        left -= 1
        return m.expand(rule.by)

    return re.sub(rule.pattern, put, text)


def defect(before: str, after: str) -> str | None:
    """What is wrong with a rewritten text, None if nothing is."""
    a, b = before.strip(), after.strip()
    if not b:
        return "empty"
    if re.match(r"[,;:.!?，；：。！？、]", b):
        return "head"
    if re.search(r"[,;:，；：、]$", b) and not re.search(r"[,;:，；：、]$", a):
        return "tail"
    if re.search(r"[,;:，；：、。]{2}", b):
        return "doubled"
    return "shorter" if len(b) < 0.6 * len(a) else "longer" if len(b) > 2 * len(a) else None


def options(text: str, rules: Sequence[Rule], most: int = 8, terms: Sequence[str] = ()) -> list[str]:
    """Different sound rewrites: all rules one after the other, then each alone."""
    hidden, held = masked(text, terms)
    whole = hidden
    for r in rules:
        whole = applied(whole, r, 3)
    out: list[str] = []
    for made in [whole, *(applied(hidden, r) for r in rules), *splits(hidden)]:
        back = restored(made, held)
        if back is not None and back != text and back not in out and defect(text, back) is None:
            out.append(back)
    return out[:most]


def splits(text: str, least: int = 12) -> list[str]:
    """Each comma with so many signs on both sides up to the next sign turned into a semicolon."""
    out = []
    for m in re.finditer("[,，]", text):
        left = re.split("[,;.!?，；。！？]", text[: m.start()])[-1]
        right = re.split("[,;.!?，；。！？]", text[m.end() :])[0]
        if len(left.strip()) >= least and len(right.strip()) >= least:
            out.append(text[: m.start()] + (";" if m[0] == "," else "；") + text[m.end() :])
    return out


def improved(text: str, rules: Sequence[Rule], measure: Callable[[str], float], most_checks: int = 200, terms: Sequence[str] = ()) -> tuple[str, float, int]:
    """Sentence by sentence, the rewrite that lowers the measure of the whole text most, until none does or the checks are used up: text, measure, checks."""
    best, checks, moved = measure(text), 1, True
    while moved and checks < most_checks:
        moved = False
        for a, b in reversed(measures.sentence_spans(text)):
            found: tuple[float, str] | None = None
            for option in options(text[a:b], rules, terms=terms):
                if checks >= most_checks:
                    break
                whole = text[:a] + option + text[b:]
                score, checks = measure(whole), checks + 1
                if score < (found[0] if found else best):
                    found = (score, whole)
            if found:
                best, text, moved = found[0], found[1], True
    return text, best, checks


def edits(before: str, after: str) -> list[tuple[int, int, str]]:
    """start, end and new text of what was changed, from the blocks that both share."""
    out, i, j = [], 0, 0
    for a, b, n in [*blocks.shared_blocks(before, after, 2, 64), (len(before), len(after), 0)]:
        if a >= i and b >= j:
            if (a, b) != (i, j) and (before[i:a] or after[j:b]):
                out.append((i, a, after[j:b]))
            i, j = a + n, b + n
    return out
