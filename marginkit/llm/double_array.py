"""A double-array trie over sorted label sequences, in numpy.

A state is a slot. The child of slot s by label c is slot BASE[s] + c, and it is there
exactly if CHECK[BASE[s] + c] = s. Labels are dense numbers. Sequences must be sorted, so
that the sequences below a node are one run; the array is then filled level by level.

Placing: an only child takes the next free slot whatever its label (BASE may be negative),
so these fill the holes that the sets of siblings leave. A set of siblings is tried at a few free
slots and else put behind the last used slot; labels numbered by first use keep siblings
close together.
"""

from __future__ import annotations

import numpy as np

TRIES = 24


class DoubleArray:
    def __init__(self, room: int):
        self.base = np.zeros(room, dtype=np.int64)
        self.check = np.full(room, -1, dtype=np.int64)
        self.check[0] = 0          # the root is slot 0
        self.free = 1              # no free slot before
        self.late = 1              # where the last set of siblings was put behind the rest
        self.end = 1               # no used slot from here on

    def _grow(self, n: int) -> None:
        if n > len(self.check):
            more = max(n, 2 * len(self.check)) - len(self.check)
            self.base = np.concatenate([self.base, np.zeros(more, dtype=np.int64)])
            self.check = np.concatenate([self.check, np.full(more, -1, dtype=np.int64)])

    def _free_from(self, at: int, n: int) -> np.ndarray:
        """The first n free slots from ``at`` on."""
        found, to = np.zeros(0, dtype=np.int64), at
        while len(found) < n:
            start, to = to, to + max(4 * (n - len(found)), 256)
            self._grow(to)
            found = np.concatenate([found, start + np.flatnonzero(self.check[start:to] < 0)])
        return found[:n]

    def add_children(self, parent: np.ndarray, label: np.ndarray) -> None:
        """Place the children (parent slot, label); the children of a parent are one run, labels unlike."""
        first = np.flatnonzero(np.append(True, parent[1:] != parent[:-1]))
        count = np.diff(np.append(first, len(parent)))
        for at in np.flatnonzero(count > 1):
            self._siblings(parent[first[at]], label[first[at]:first[at] + count[at]])
        only = first[count == 1]
        if len(only):
            slots = self._free_from(self.free, len(only))
            self.base[parent[only]] = slots - label[only]
            self.check[slots] = parent[only]
            self.free, self.end = int(slots[-1]) + 1, max(self.end, int(slots[-1]) + 1)

    def _siblings(self, parent: int, label: np.ndarray) -> None:
        low, high = int(label.min()), int(label.max())
        for start in (self.free, self.late):
            for slot in self._free_from(start, TRIES):
                self._grow(int(slot) + high - low + 1)
                if (self.check[slot + label - low] < 0).all():
                    return self._put(parent, int(slot) - low, label)
        self.late = self.end
        self._grow(self.end + high - low + 1)
        return self._put(parent, self.end - low, label)

    def _put(self, parent: int, base: int, label: np.ndarray) -> None:
        self.base[parent] = base
        self.check[base + label] = parent
        self.end = max(self.end, base + int(label.max()) + 1)

    def step(self, slot: np.ndarray, label: np.ndarray) -> np.ndarray:
        """The child slots by the labels; -1 where there is none."""
        to = self.base[slot] + label
        inside = (to >= 0) & (to < len(self.check))
        return np.where(inside & (self.check[np.where(inside, to, 0)] == slot) & (to != 0), to, -1)


def by_first_use(label: np.ndarray, level: np.ndarray) -> np.ndarray:
    """Dense numbers of the labels in the order of their first use, upper levels first."""
    order = np.argsort(level, kind="stable")
    _, first, number = np.unique(label[order], return_index=True, return_inverse=True)
    rank = np.empty(len(first), dtype=np.int64)
    rank[np.argsort(first, kind="stable")] = np.arange(len(first))
    out = np.empty(len(label), dtype=np.int64)
    out[order] = rank[number]
    return out


def build(label: np.ndarray, offset: np.ndarray) -> DoubleArray:
    """The trie of the sequences label[offset[i]:offset[i + 1]], which are sorted so that equal prefixes are neighbours."""
    length = np.diff(offset)
    trie = DoubleArray(2 * len(label) + 256)
    live, slot = np.flatnonzero(length > 0), np.zeros(len(length), dtype=np.int64)
    depth = 0
    while len(live):
        parent, by = slot[live], label[offset[live] + depth]
        new = np.append(True, (parent[1:] != parent[:-1]) | (by[1:] != by[:-1]))
        trie.add_children(parent[new], by[new])
        slot[live] = trie.step(parent, by)
        depth += 1
        live = live[length[live] > depth]
    return trie
