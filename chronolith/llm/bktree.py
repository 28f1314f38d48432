"""BK-trees over 64-bit fingerprints, many trees at a time, as arrays.

A child hangs under its parent at the edge numbered by their Hamming distance. A search visits a
node, then only the edges within ``radius`` of the distance just measured. Both insertion and
search run level by level for all entries at once.
"""

from __future__ import annotations

import numpy as np


class Forest:
    """One BK-tree for each run of equal ``shard`` values (which must be sorted)."""

    def __init__(self, prints: np.ndarray, shard: np.ndarray) -> None:
        self.prints = prints
        n = len(prints)
        first = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]]) if n else np.zeros(0, np.int64)
        self.shards, self.roots = shard[first] if n else shard, first
        at = np.repeat(first, np.diff(np.r_[first, n]))
        rest = np.flatnonzero(at != np.arange(n))
        keys, children = [], []
        while len(rest):
            far = np.bitwise_count(prints[rest] ^ prints[at[rest]]).astype(np.int64)
            key = at[rest] * 65 + far
            order = np.argsort(key, kind="stable")
            key, rest = key[order], rest[order]
            new = np.r_[True, key[1:] != key[:-1]]
            keys.append(key[new])
            children.append(rest[new])
            at[rest] = rest[new][np.cumsum(new) - 1]
            rest = rest[~new]
        self.keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
        self.children = np.concatenate(children) if children else np.zeros(0, np.int64)
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.children = self.keys[order], self.children[order]

    def search(self, prints: np.ndarray, shard: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, entry) within the radius, each query in the tree of its own shard."""
        if not len(prints) or not len(self.roots):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        place = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        query = np.flatnonzero(self.shards[place] == shard)
        node = self.roots[place[query]]
        found: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            far = np.bitwise_count(prints[query] ^ self.prints[node]).astype(np.int64)
            hit = far <= radius
            found.append((query[hit], node[hit]))
            low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
            high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right")
            count = high - low
            query = np.repeat(query, count)
            start = np.repeat(low - np.r_[0, np.cumsum(count)[:-1]], count)
            node = self.children[start + np.arange(len(query))]
        return np.concatenate([q for q, _ in found]), np.concatenate([e for _, e in found])


def labels_of(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index linked to each of n entries."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label = jumped
        if (label == before).all():
            break
    return label


def least_forest(n: int, a: np.ndarray, b: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Boruvka: places of the links of a minimum spanning forest, ties by place after sorting."""
    order = np.lexsort((b, a, weight))
    left, right, label, taken = a[order], b[order], np.arange(n), []
    place = np.arange(len(order))
    while True:
        la, lb = label[left[place]], label[right[place]]
        place = place[la != lb]
        if not len(place):
            break
        la, lb = label[left[place]], label[right[place]]
        best = np.full(n, len(order))
        np.minimum.at(best, la, place)
        np.minimum.at(best, lb, place)
        chosen = np.unique(best[best < len(order)])
        taken.append(chosen)
        merged = labels_of(n, label[left[chosen]], label[right[chosen]])
        label = merged[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, np.int64)
