"""A hierarchical index over 64-bit codes in Gray order, for self-joins by Hamming distance.

Codes are sorted by Gray rank, so neighbours share long bit patterns. Runs of `FAN` nodes get a parent that holds the pattern of the bits
in which all of them agree, and the mask of those bits. Two nodes are compared in the bits that both masks have: differences found there
hold for all pairs below, so they are accumulated on the way down, and a pair of groups is given up once they exceed the limit.
A pair of groups whose undecided bits can't exceed the limit any more is accepted whole.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

FAN = 8
#: Pairs of nodes that are looked at together, which bounds the memory.
CHUNK = 1 << 18


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class Forest:
    """Disjoint sets over 0..n-1, joined by arrays of pairs."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def roots(self, i: np.ndarray) -> np.ndarray:
        i = self.parent[i]
        while not np.array_equal(up := self.parent[i], i):
            i = up
        return i

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        while len(i):
            i, j = self.roots(i), self.roots(j)
            apart = i != j
            i, j = i[apart], j[apart]
            np.minimum.at(self.parent, np.maximum(i, j), np.minimum(i, j))


class GrayIndex:
    def __init__(self, keys: np.ndarray, codes: np.ndarray) -> None:
        """Only codes of the same key are compared."""
        order = np.lexsort((gray_rank(codes), keys))
        self.order, self.codes = order, codes[order]
        key = keys[order]
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        #: by level from the leaves: pattern, mask, first child and end of children, first leaf and end of leaves
        here = np.arange(len(codes))
        self.levels = [(self.codes, full, here, here + 1, here, here + 1)]
        ands = ors = self.codes
        leaf, roots = here, len(np.unique(key))
        while len(ands) > roots:
            new_key = np.concatenate([[True], key[1:] != key[:-1]])
            first = np.flatnonzero(new_key)
            at = np.arange(len(key)) - np.repeat(first, np.diff(np.append(first, len(key))))
            start = np.flatnonzero(new_key | (at % FAN == 0))
            ands, ors = np.bitwise_and.reduceat(ands, start), np.bitwise_or.reduceat(ors, start)
            leaf, key = leaf[start], key[start]
            mask = ~(ands ^ ors)
            end = np.append(start[1:], len(at))
            self.levels.append((ands & mask, mask, start, end, leaf, np.append(leaf[1:], len(codes))))

    def _leaves(self, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the range, leaf) for all leaves of some ranges."""
        n = end - first
        which = np.repeat(np.arange(len(n)), n)
        return which, first[which] + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def linked(self, limit: int, check: Callable[[np.ndarray, np.ndarray], np.ndarray] | None = None) -> np.ndarray:
        """For each code, in the order given, the number of a code that stands for its component of links. check(i, j): which pairs
        of codes, by their numbers, are links after all; asked only for pairs that aren't joined yet."""
        forest = Forest(len(self.codes))
        top = len(self.levels) - 1
        each = np.arange(len(self.levels[top][0]))
        stack = [(top, each, each, np.zeros(len(each), np.int64), self.levels[top][1])] if len(each) else []
        while stack:
            level, a, b, differ, known = stack.pop()
            if level == 0:
                continue
            _, _, start, end, _, _ = self.levels[level]
            na, nb = end[a] - start[a], end[b] - start[b]
            total = np.cumsum(na * nb)
            if len(a) > 1 and total[-1] > CHUNK:
                cut = max(1, min(len(a) - 1, int(np.searchsorted(total, CHUNK))))
                stack += [(level, x[cut:], y[cut:], d[cut:], k[cut:]) for x, y, d, k in [(a, b, differ, known)]]
                a, b, differ, known, na, nb, total = (x[:cut] for x in (a, b, differ, known, na, nb, total))
            pair = np.repeat(np.arange(len(a)), na * nb)
            at = np.arange(total[-1]) - (total - na * nb)[pair]
            i, j = start[a][pair] + at // nb[pair], start[b][pair] + at % nb[pair]
            keep = (a != b)[pair] | (i < j if level == 1 else i <= j)
            pair, i, j = pair[keep], i[keep], j[keep]
            pattern, mask, _, _, leaf, leaf_end = self.levels[level - 1]
            common = mask[i] & mask[j]
            count = differ[pair] + np.bitwise_count((pattern[i] ^ pattern[j]) & common & ~known[pair])
            near = count <= limit
            i, j, count, common = i[near], j[near], count[near], common[near]
            if check is not None:
                if level == 1:
                    apart = forest.roots(i) != forest.roots(j)
                    i, j = i[apart], j[apart]
                    good = check(self.order[i], self.order[j])
                    forest.join(i[good], j[good])
                elif len(i):
                    stack.append((level - 1, i, j, count, common))
                continue
            whole = count + 64 - np.bitwise_count(common) <= limit
            for side in (i, j):
                which, leaves = self._leaves(leaf[side[whole]], leaf_end[side[whole]])
                forest.join(leaf[i[whole]][which], leaves)
            rest = ~whole
            if rest.any():
                stack.append((level - 1, i[rest], j[rest], count[rest], common[rest]))
        out = np.empty(len(self.codes), np.int64)
        out[self.order] = self.order[forest.roots(np.arange(len(self.codes)))]
        return out
