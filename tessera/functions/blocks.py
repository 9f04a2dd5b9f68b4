"""What two texts share: common blocks, tiles over anchors, and bands that give way to better hits. Plain Python, for kernels."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Sequence

from . import measures

LEAST_BLOCK, MOST_BLOCKS = 5, 16
LEAST_RUN, CORE = 13, 8


def longest_common(a: str, b: str) -> tuple[int, int, int]:
    """start in a, start in b and size of the longest string that both hold; the first of equals. By halving the size over sets of hashes of equal length."""

    def at(n: int) -> tuple[int, int] | None:
        seen: dict[str, int] = {}
        for j in range(len(b) - n + 1):
            seen.setdefault(b[j : j + n], j)
        return next(((i, seen[a[i : i + n]]) for i in range(len(a) - n + 1) if a[i : i + n] in seen), None)

    low, high, best = 0, min(len(a), len(b)), (0, 0)
    while low < high:
        mid = (low + high + 1) // 2
        if (found := at(mid)) is not None:
            low, best = mid, found
        else:
            high = mid - 1
    return *best, low


def shared_blocks(a: str, b: str, least: int = LEAST_BLOCK, most: int = MOST_BLOCKS) -> list[tuple[int, int, int]]:
    """Common blocks in order, the longest first and then those left and right of it; at most so many, their ends letters or digits."""
    found: list[tuple[int, int, int]] = []
    open_ = [(0, len(a), 0, len(b))]
    while open_ and len(found) < most:
        a0, a1, b0, b1 = open_.pop(0)
        i, j, n = longest_common(a[a0:a1], b[b0:b1])
        if n < least:
            continue
        i, j = i + a0, j + b0
        found.append((i, j, n))
        open_ += [(a0, i, b0, j), (i + n, a1, j + n, b1)]
    out = []
    for i, j, n in sorted(found):
        own = a[i : i + n]
        left = len(own) - len(re.sub(r"^\W+", "", own))
        right = len(own) - len(re.sub(r"\W+$", "", own))
        if n - left - right >= least:
            out.append((i + left, j + left, n - left - right))
    return out


def tiles(a: Sequence, b: Sequence, anchors: Sequence[tuple[int, int]], least: int = LEAST_RUN) -> list[tuple[int, int, int]]:
    """Greedy tiling: from places where both agree, the longest run of equal tokens that no tile covers yet, again and again; by place in a."""
    used_a, used_b = [False] * len(a), [False] * len(b)
    out = []
    while True:
        best = (0, 0, 0)
        for i, j in anchors:
            if used_a[i] or used_b[j] or a[i] != b[j]:
                continue
            s = 0
            while i - s > 0 and j - s > 0 and a[i - s - 1] == b[j - s - 1] and not used_a[i - s - 1] and not used_b[j - s - 1]:
                s += 1
            e = 1
            while i + e < len(a) and j + e < len(b) and a[i + e] == b[j + e] and not used_a[i + e] and not used_b[j + e]:
                e += 1
            if (s + e, -(i - s), -(j - s)) > (best[2], -best[0], -best[1]):
                best = (i - s, j - s, s + e)
        if best[2] < least:
            return sorted(out)
        i, j, n = best
        used_a[i : i + n] = [True] * n
        used_b[j : j + n] = [True] * n
        out.append(best)


def anchors(a: Sequence, b: Sequence, size: int) -> list[tuple[int, int]]:
    """Where runs of so many tokens of a stand in b."""
    at = defaultdict(list)
    for j in range(len(b) - size + 1):
        at[tuple(b[j : j + size])].append(j)
    return [(i, j) for i in range(len(a) - size + 1) for j in at.get(tuple(a[i : i + size]), ())]


def trimmed_bands(hits: Sequence[tuple[int, int]], bands: Sequence[tuple[int, int]], least: int = LEAST_RUN) -> list[tuple[int, int]]:
    """What is left of each band beside the hits and the bands before it; all of its pieces if they add up to enough, else none."""
    taken = sorted(hits)
    out: list[tuple[int, int]] = []
    for a, b in bands:
        pieces, at = [], a
        for s, e in sorted(taken):
            if e <= at or s >= b:
                continue
            if s > at:
                pieces.append((at, s))
            at = max(at, e)
        if at < b:
            pieces.append((at, b))
        if sum(e - s for s, e in pieces) >= least:
            out += pieces
            taken += pieces
    return out


#: Words that say nothing of a topic; a parameter of key_phrase().
STOPWORDS = frozenset("the a an of and or in on at to for with by from as is are was were be this that these those it its we our their based using study research analysis 基于 研究 分析 以及 进行 通过 对于 我们 本文 的 了 和 与 在 是".split())


def weight(word: str) -> float:
    """How much a word says: longer ones and Han ones more, numbers little."""
    if word.isdigit():
        return 0.2
    return (1.5 if any("一" <= c <= "鿿" for c in word) else 1.0) * min(len(word), 12) / 4


def key_phrase(text: str, most: int = 48, stop: frozenset[str] = STOPWORDS) -> str:
    """The words of a text that say most, in their order, of so many characters at most."""
    words = [w for w in re.findall(r"[一-鿿]+|[^\W_一-鿿]+", measures.folded(text)) if w not in stop]
    parts: list[str] = []
    for w in words:
        parts += re.split("|".join(sorted((s for s in stop if "一" <= s[0] <= "鿿"), key=len, reverse=True)), w) if "一" <= w[0] <= "鿿" else [w]
    first = {w: k for k, w in reversed(list(enumerate(p for p in parts if p)))}
    picked, held = [], 0
    for w in sorted(first, key=lambda w: (-weight(w), first[w])):
        if held + len(w) + bool(picked) <= most:
            picked.append(w)
            held += len(w) + (len(picked) > 1)
    return " ".join(sorted(picked, key=first.get))


def narrowed(phrase: str, words: int, chars: int) -> str:
    """The first words of a phrase, as many as fit."""
    out: list[str] = []
    for w in phrase.split()[:words]:
        if len(" ".join([*out, w])) > chars:
            break
        out.append(w)
    return " ".join(out)


def allocated(sizes: Sequence[int], engines: Sequence[str], cap: int, budget: int) -> list[tuple[int, str]]:
    """(window, engine) requests, layer by layer: each window gets one more engine a round, larger windows and engines with more left first."""
    left = dict.fromkeys(engines, cap)
    asked: list[tuple[int, str]] = []
    had: dict[int, set[str]] = {k: set() for k in range(len(sizes))}
    order = sorted(range(len(sizes)), key=lambda k: (-sizes[k], k))
    for _ in engines:
        for k in order:
            free = [e for e in engines if left[e] and e not in had[k]]
            if len(asked) >= budget:
                return asked
            if free:
                e = max(free, key=lambda e: (left[e], -engines.index(e)))
                left[e] -= 1
                had[k].add(e)
                asked.append((k, e))
    return asked


def quiet(gains: Sequence[int], most: int = 2) -> int:
    """How many requests are made until so many in a row gain nothing."""
    run = 0
    for k, g in enumerate(gains, 1):
        run = 0 if g else run + 1
        if run == most:
            return k
    return len(gains)
