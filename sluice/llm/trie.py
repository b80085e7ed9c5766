"""Self-join of binary words within a Hamming budget, by walking a binary trie against itself."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: node pairs walked at once; a wider frontier is halved and the halves walked one after the other
FRONTIER = 1 << 16


def close_pairs(groups: np.ndarray, words: np.ndarray, budget: int, frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs i < j of equal group whose 64-bit words differ in at most ``budget`` bits.

    Input must be sorted by (group, word) without repeats. A trie node is a range of rows; pairs of nodes start as
    (root, root) of every group and go down one bit at a time. Differing bits add up; pairs over the budget are dropped.
    """
    n = len(words)
    if n < 2:
        return
    starts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]]))
    ends = np.concatenate([starts[1:], [n]])
    wide = ends - starts > 1
    starts, ends = starts[wide], ends[wide]
    zeros: dict[int, np.ndarray] = {}

    def zeros_before(level: int) -> np.ndarray:
        if level not in zeros:
            bit = (words >> np.uint64(63 - level)) & np.uint64(1)
            zeros[level] = np.concatenate([[0], np.cumsum(bit == 0)]).astype(np.int32)
        return zeros[level]

    stack = [(0, np.stack([starts, ends, starts, ends, np.zeros_like(starts)]).astype(np.int32))]
    while stack:
        level, pairs = stack.pop()
        single = (pairs[1] - pairs[0] == 1) & (pairs[3] - pairs[2] == 1)
        if single.any():
            i, j = pairs[0, single], pairs[2, single]
            near = (i != j) & (np.bitwise_count(words[i] ^ words[j]) <= budget)
            if near.any():
                yield i[near], j[near]
            pairs = pairs[:, ~single]
        if pairs.shape[1] == 0 or level == 64:
            continue
        if pairs.shape[1] > frontier:
            half = pairs.shape[1] // 2
            stack += [(level, pairs[:, :half].copy()), (level, pairs[:, half:].copy())]  # views would keep the whole
            continue
        a0, a1, b0, b1, spent = pairs
        before = zeros_before(level)
        am, bm = a0 + before[a1] - before[a0], b0 + before[b1] - before[b0]
        same = a0 == b0
        split = np.concatenate(
            [
                np.stack([a0, am, b0, bm, spent]),
                np.stack([am, a1, bm, b1, spent]),
                np.stack([a0, am, bm, b1, spent + 1]),
                np.stack([am, a1, b0, bm, spent + 1])[:, ~same],
            ],
            axis=1,
        )
        stack.append((level + 1, split[:, (split[0] < split[1]) & (split[2] < split[3]) & (split[4] <= budget)]))


class Forest:
    """Components of the links seen so far over rows 0 to n - 1, and links that span them: fewer than n of them."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.spanning: list[tuple[np.ndarray, np.ndarray]] = []

    def link(self, i: np.ndarray, j: np.ndarray) -> None:
        while True:
            a, b = self.root[i], self.root[j]
            apart = a != b
            if not apart.any():
                return
            i, j, a, b = i[apart], j[apart], a[apart], b[apart]
            high, low = np.maximum(a, b), np.minimum(a, b)
            np.minimum.at(self.root, high, low)
            won = np.flatnonzero(self.root[high] == low)
            won = won[np.unique(high[won], return_index=True)[1]]
            self.spanning.append((i[won], j[won]))
            while True:
                up = self.root[self.root]
                if np.array_equal(up, self.root):
                    break
                self.root = up

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return tuple(np.concatenate([none, *side]) for side in zip(*self.spanning, strict=True)) if self.spanning else (none, none)
