"""A small language model of characters, interpolated over runs of up to so many, and the signals read from it."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Sequence
from typing import NamedTuple


class Signals(NamedTuple):
    bits: float
    mean_rank: float
    log_rank: float
    entropy: float


class Model:
    """Witten and Bell: what a context has not shown weighs as much as how many kinds it has shown."""

    def __init__(self, texts: Sequence[str], order: int = 3):
        self.order = order
        self.next: list[dict[str, Counter]] = [defaultdict(Counter) for _ in range(order)]
        for t in texts:
            for i, c in enumerate(t):
                for n in range(min(order, i + 1)):
                    self.next[n][t[i - n : i]][c] += 1
        self.kinds = sorted(self.next[0][""])

    def probability(self, context: str, c: str) -> float:
        p = 1.0 / (len(self.kinds) + 1)
        for n in range(self.order):
            if n > len(context):
                break
            seen = self.next[n].get(context[len(context) - n :])
            if not seen:
                break
            total, kinds = sum(seen.values()), len(seen)
            p = (seen[c] + kinds * p) / (total + kinds)
        return p

    def signals(self, text: str) -> Signals:
        """Bits a character, the rank of each among all that could stand there and its logarithm, and the entropy of the places, as means."""
        if not text:
            return Signals(0.0, 0.0, 0.0, 0.0)
        bits = rank = log_rank = entropy = 0.0
        for i, c in enumerate(text):
            context = text[max(0, i - self.order + 1) : i]
            all_ = [self.probability(context, k) for k in self.kinds]
            p = self.probability(context, c)
            r = 1 + sum(q > p for q in all_)
            bits -= math.log2(p)
            rank += r
            log_rank += math.log(r)
            entropy -= sum(q * math.log2(q) for q in all_)
        n = len(text)
        return Signals(bits / n, rank / n, log_rank / n, entropy / n)

    def best_window(self, text: str, size: int = 24, stride: int = 8, most: int = 64) -> float:
        """The fewest bits a character of any window."""
        starts = range(0, max(1, len(text) - size + 1), stride)
        return min((self.signals(text[s : s + size]).bits for s in list(starts)[:most]), default=0.0)
