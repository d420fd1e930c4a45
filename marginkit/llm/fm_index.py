"""A bidirectional FM-index over a delimited vocabulary, in numpy, and its one-error search.

The text is $w1$w2...$wk with the words in code-point order, read as a ring. Rows are its
rotations in order; $ is the smallest symbol, so row i of the first k is the rotation that
starts with $wi$, and a match of $w$ names its word without a locate step. One index is
over the text, one over the reversed text. A pattern P is held as two intervals of equal
size, of the rotations that start with P and of the reversed ones that start with reversed P;
adding a symbol at either end narrows both.

The last column of the sorted rotations is kept as a wavelet matrix: a step by a given symbol, and the list of all
symbols that can come next, take one pass over the bits of a symbol, for many
patterns at once.
"""

from __future__ import annotations

import numpy as np

END = 0      # the symbol of the delimiter


class Column:
    """The wavelet matrix of one index's last column, with the first rows of each symbol."""

    def __init__(self, ring: np.ndarray, n_symbols: int):
        last = ring[_sorted_rotations(ring) - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ring, minlength=n_symbols))])[:-1]
        self.bits = max(1, int(n_symbols - 1).bit_length())
        self.zeros, self.n_zeros = [], []
        at = np.zeros(n_symbols, dtype=np.int64)
        symbols = np.arange(n_symbols)
        for bit in range(self.bits - 1, -1, -1):
            one = (last >> bit) & 1
            zeros = np.concatenate([[0], np.cumsum(1 - one)])
            self.zeros.append(zeros)
            self.n_zeros.append(int(zeros[-1]))
            at = np.where((symbols >> bit) & 1, zeros[-1] + at - zeros[at], zeros[at])
            last = np.concatenate([last[one == 0], last[one == 1]])
        self.shift = self.first - at           # from places in the last level to rows

    def step(self, low, high, symbol):
        """Rows (low, high) after the symbol, and how many of the old rows go on with a smaller one."""
        less = np.zeros(len(low), dtype=np.int64)
        a, b = low, high
        for level, bit in enumerate(range(self.bits - 1, -1, -1)):
            one = ((symbol >> bit) & 1).astype(bool)
            za, zb, n = self.zeros[level][a], self.zeros[level][b], self.n_zeros[level]
            less += np.where(one, zb - za, 0)
            a, b = np.where(one, n + a - za, za), np.where(one, n + b - zb, zb)
        return a + self.shift[symbol], b + self.shift[symbol], less

    def following(self, low, high):
        """Every symbol that can follow: (pattern, symbol, low, high, less)."""
        who, a, b = np.arange(len(low)), low, high
        symbol, less = np.zeros(len(low), dtype=np.int64), np.zeros(len(low), dtype=np.int64)
        for level in range(self.bits):
            za, zb, n = self.zeros[level][a], self.zeros[level][b], self.n_zeros[level]
            zero, one = zb > za, (b - zb) > (a - za)
            who, symbol, less, a, b = (np.concatenate(x) for x in (
                (who[zero], who[one]), (2 * symbol[zero], 2 * symbol[one] + 1), (less[zero], (less + zb - za)[one]),
                (za[zero], (n + a - za)[one]), (zb[zero], (n + b - zb)[one])))
        return who, symbol, a + self.shift[symbol], b + self.shift[symbol], less


def _sorted_rotations(ring: np.ndarray) -> np.ndarray:
    """The starts of the ring's rotations in their order, by doubling the sorted length."""
    rank, width = ring.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -width)
        order = np.argsort(key, kind="stable")
        new = np.append(0, (np.diff(key[order]) != 0).astype(np.int64))
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new)
        if rank[order[-1]] == len(ring) - 1 or width >= len(ring):
            return order
        width *= 2


class Patterns:
    """Patterns of one search: their number and both intervals; ``near`` is the interval of
    the index that the search extends by, ``far`` the first row in the other one."""

    def __init__(self, who, low, high, far):
        self.who, self.low, self.high, self.far = who, low, high, far

    def take(self, keep) -> "Patterns":
        return Patterns(self.who[keep], self.low[keep], self.high[keep], self.far[keep])

    @staticmethod
    def together(parts: "list[Patterns]") -> "Patterns":
        return Patterns(*(np.concatenate([getattr(p, name) for p in parts]) for name in ("who", "low", "high", "far")))


class Vocabulary:
    def __init__(self, words: list[str]):
        """``words`` distinct and in code-point order."""
        self.words = words
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        self.alphabet = np.unique(points)
        length = np.array([len(w) for w in words], dtype=np.int64)
        ring = np.full(len(points) + len(words), END, dtype=np.int64)
        inside = np.ones(len(ring), dtype=bool)
        inside[np.cumsum(length + 1) - length - 1] = False
        ring[inside] = np.searchsorted(self.alphabet, points) + 1
        self.forward = Column(ring, len(self.alphabet) + 1)
        self.backward = Column(ring[::-1], len(self.alphabet) + 1)

    def symbols(self, words: list[str]):
        """(symbols of all words, offsets); -1 for code points that no word of the index has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), dtype="<u4")
        at = np.searchsorted(self.alphabet, points)
        found = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == points
        offset = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
        return np.where(found, at + 1, -1), offset

    def one_error(self, queries: list[str], inside: np.ndarray, suffix: bool):
        """(query, word) by number: words with exactly one error, which lies in the part that
        follows the exactly matched half. ``suffix``: the right half is matched exactly and the
        search runs leftwards, else the left half and it runs rightwards. ``inside``: the query is a word of
        the index, so an interval of one row holds nothing else."""
        symbol, offset = self.symbols(queries)
        length = np.diff(offset)
        half = np.where(suffix, length - length // 2, length // 2)
        first, way = (offset[1:] - 1, -1) if suffix else (offset[:-1], 1)
        column = self.forward if suffix else self.backward

        def wanted(who, depth):
            return np.where(depth < length[who], symbol[np.clip(first[who] + way * depth, 0, len(symbol) - 1)], END)

        def step(p, c):
            p, c = p.take(c >= 0), c[c >= 0]
            low, high, less = column.step(p.low, p.high, c)
            return Patterns(p.who, low, high, p.far + less).take(high > low)

        n = len(queries)
        exact = Patterns(np.arange(n), np.zeros(n, dtype=np.int64), np.full(n, len(self.words)), np.zeros(n, dtype=np.int64))
        erring, found, depth = [], [], 0
        while len(exact.who) or any(len(p.who) for p in erring):
            exact = exact.take(~((exact.high - exact.low == 1) & inside[exact.who]))
            ready = exact.take(half[exact.who] <= depth)
            if len(ready.who):
                end = depth >= length[ready.who]
                next_ = wanted(ready.who, depth)
                # the word lacks this symbol; of a run, the last one
                lacks = ready.take(~end & (next_ != wanted(ready.who, depth + 1)))
                who, c, low, high, less = column.following(ready.low, ready.high)
                other = Patterns(ready.who[who], low, high, ready.far[who] + less)
                unlike = (c != END) & (c != next_[who])
                erring.append(other.take(unlike))                       # the word has one more symbol here
                later = [lacks, other.take(unlike & ~end[who])]         # or another one
            else:
                later = []
            now = Patterns.together(erring) if erring else exact.take(slice(0, 0))
            moved = step(now, wanted(now.who, depth))
            done = length[moved.who] <= depth                           # the delimiter was matched
            found.append(moved.take(done))
            erring = [p for p in [moved.take(~done), *later] if len(p.who)]
            exact = exact.take(length[exact.who] > depth)
            exact = step(exact, wanted(exact.who, depth))
            depth += 1
        hits = Patterns.together(found) if found else exact
        # rows of the text's own index name the words; the other index gives them as the synchronised rows
        return hits.who, hits.low if suffix else hits.far
