"""Byte-pair merging of one word: a contiguous array of parts and, beside it, the ranks of their boundaries."""

from __future__ import annotations

import heapq

NEVER = 1 << 60
SHORT = 96     # parts; longer words are merged by a queue, with the same result
WIDTH = 24     # bits of a token id


class Merges:
    """``rank`` and ``made``: of two adjacent tokens, the rank of joining them and the token that results."""

    def __init__(self, triples):
        self.rank: dict[int, int] = {}
        self.made: dict[int, int] = {}
        for left, right, rank, token in triples:
            key = left << WIDTH | right
            self.rank[key], self.made[key] = rank, token

    def merge(self, parts: list[int]) -> list[int]:
        """The parts of a word after all merges, the least rank first and the leftmost of equals. ``parts``: token of
        each starting part, -1 for one that never joins; changed in place."""
        return self._short(parts) if len(parts) <= SHORT else self._long(parts)

    def _short(self, parts: list[int]) -> list[int]:
        """ranks[i] belongs to the boundary between part i and i + 1. A merge deletes that boundary and refreshes the
        ranks of the two that are now its neighbours."""
        get, made = self.rank.get, self.made
        ranks = [get(a << WIDTH | b, NEVER) for a, b in zip(parts, parts[1:])]
        while ranks:
            least = min(ranks)
            if least == NEVER:
                break
            i = ranks.index(least)
            token = made[parts[i] << WIDTH | parts[i + 1]]
            parts[i:i + 2] = (token,)
            del ranks[i]
            if i < len(ranks):
                ranks[i] = get(token << WIDTH | parts[i + 1], NEVER)
            if i:
                ranks[i - 1] = get(parts[i - 1] << WIDTH | token, NEVER)
        return parts

    def _long(self, parts: list[int]) -> list[int]:
        n, get, made = len(parts), self.rank.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := get(parts[i] << WIDTH | parts[i + 1], NEVER)) != NEVER]
        heapq.heapify(queue)
        gone = [False] * n
        while queue:
            _, i, a, b = heapq.heappop(queue)
            j = after[i]
            if gone[i] or j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], gone[j], after[i] = made[a << WIDTH | b], True, after[j]
            if (k := after[i]) < n:
                before[k] = i
                if (r := get(parts[i] << WIDTH | parts[k], NEVER)) != NEVER:
                    heapq.heappush(queue, (r, i, parts[i], parts[k]))
            if (k := before[i]) >= 0 and (r := get(parts[k] << WIDTH | parts[i], NEVER)) != NEVER:
                heapq.heappush(queue, (r, k, parts[k], parts[i]))
        return [p for p, x in zip(parts, gone) if not x]


class Memo(dict):
    """Answers by word, computed on a miss. Of bounded size in two halves: when the newer is full, ``renewed`` drops
    the older, so that words in use stay."""

    def __init__(self, compute, most: int, longest: int, old: dict | None = None):
        super().__init__()
        self.compute, self.most, self.longest, self.old = compute, most, longest, old or {}

    def __missing__(self, word: str):
        found = self.old.get(word)
        if found is None:
            found = self.compute(word)
        if len(word) <= self.longest:
            self[word] = found
        return found

    def renewed(self) -> Memo:
        return self if 2 * len(self) < self.most else Memo(self.compute, self.most, self.longest, dict(self))
