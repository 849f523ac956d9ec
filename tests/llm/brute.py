"""Plain-Python versions of the operators, for small tables."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict


def lowered(text: str | None) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def tokens(text: str | None) -> list[str]:
    return re.findall(r"[^\x20\x09-\x0D]+", lowered(text))


class Katz:
    """The backoff model of any order by dictionaries of tuples; None stands for the end, "" for a begin."""

    def __init__(self, texts: list[str | None], held: list[bool], order: int = 2):
        self.order, self.lists = order, [[*tokens(t), None] for t in texts]
        self.uni = Counter()
        self.after = [defaultdict(Counter) for _ in range(order + 1)]  # by length of the n-gram: history -> followers
        for ws, h in zip(self.lists, held, strict=True):
            if not h:
                self.uni.update(ws)
                for n in range(2, order + 1):
                    padded = [""] * (n - 1) + ws
                    for i in range(len(ws)):
                        self.after[n][tuple(padded[i : i + n - 1])][ws[i]] += 1
        self.total, self.kinds = sum(self.uni.values()), len(self.uni)
        self.ratio = [None, None] + [self._ratios(n) for n in range(2, order + 1)]

    def _ratios(self, n: int) -> dict[int, float]:
        of = Counter(c for x in self.after[n].values() for c in x.values())
        k, out = 5, {}
        x = (k + 1) * of[k + 1] / of[1] if of[1] else 1.0
        for r in range(1, k + 1):
            d = ((r + 1) * of[r + 1] / of[r] / r - x) / (1 - x) if of[r] and x < 1 else math.nan
            out[r] = d if 0 < d < 1 else (r - 0.5) / r
        return out

    def p(self, w: str | None, history: tuple = ()) -> float:
        n = len(history) + 1
        if n == 1:
            return (self.uni[w] + 1) / (self.total + self.kinds + 1)
        seen = self.after[n].get(history)
        if not seen:
            return self.p(w, history[1:])
        if w in seen:
            return self._kept(n, seen, seen[w])
        # What the seen words leave, shared by the shorter history's model among the others.
        left = math.fsum([1.0] + [-self._kept(n, seen, c) for c in seen.values()])
        rest = math.fsum([1.0] + [-self.p(v, history[1:]) for v in seen])
        return left / rest * self.p(w, history[1:])

    def _kept(self, n: int, seen: Counter, c: int) -> float:
        total = sum(seen.values())
        if min(seen.values()) > 5:  # nothing is discounted: half a count each for unseen words
            return (c - 0.5) / total
        return self.ratio[n].get(c, 1.0) * c / total

    def scores(self) -> list[tuple[int, int, int, float, float]]:
        """n_tokens, n_known, train_tokens, base and score of each text."""
        out = []
        for ws in self.lists:
            padded = [""] * (self.order - 1) + ws
            logs = [math.log10(self.p(w, tuple(padded[i : i + self.order - 1]))) for i, w in enumerate(ws)]
            out.append((len(ws), sum(self.uni[w] > 0 for w in ws), self.total, sum(math.log10(self.p(w)) for w in ws), math.fsum(logs)))
        return out


def katz(texts: list[str | None], held: list[bool], order: int = 2) -> list[tuple[int, int, int, float, float]]:
    return Katz(texts, held, order).scores()
