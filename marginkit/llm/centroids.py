"""Centroids of posting lists and the graph that finds the nearest of them, in numpy.

The centroids come from balanced splitting of a sample: a set is split by a few rounds of
k-means, and every part still too large is split again, so dense regions get more centroids and
no part holds more than its share. The graph links each centroid to its nearest ones both
ways; a search starts at pivots and follows the links of the best centroids found so far, for many vectors at
once.
"""

from __future__ import annotations

import numpy as np

SPLIT = 16
ROUNDS = 6
LINKS = 24
BLOCK = 256
AT_ONCE = 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of a to all rows of b."""
    out = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
    return np.maximum(out, 0.0)


def _parts(x: np.ndarray, k: int) -> np.ndarray:
    """The part of each row, by k-means from rows spread over the order of the first
    direction of greatest variance."""
    spread = x - x.mean(axis=0)
    way = spread[np.argmax((spread * spread).sum(axis=1))]
    start = np.argsort(spread @ way, kind="stable")[np.linspace(0, len(x) - 1, k).astype(np.int64)]
    centres = x[start]
    for _ in range(ROUNDS):
        part = squared(x, centres).argmin(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, part, x)
        n = np.bincount(part, minlength=k)
        centres = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centres)
    return part


def balanced_centroids(x: np.ndarray, k: int) -> np.ndarray:
    """About k centroids, none of more rows of x than its share unless rows are equal."""
    most = max(1, int(np.ceil(len(x) / k)))
    todo, out = [np.arange(len(x))], []
    while todo:
        rows = todo.pop()
        if len(rows) > most:
            part = _parts(x[rows], min(SPLIT, max(2, round(len(rows) / most))))
            pieces = [rows[part == p] for p in np.unique(part)]
            if len(pieces) > 1:
                todo += pieces
                continue
        out.append(x[rows].mean(axis=0))
    return np.array(out, dtype=np.float32)


class CentroidGraph:
    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.norm = (centroids * centroids).sum(axis=1)
        k = len(centroids)
        n = max(1, min(LINKS, k - 1))
        near = np.zeros((k, n), dtype=np.int32)
        if k > 1:
            for at in range(0, k, BLOCK):
                d = squared(centroids[at:at + BLOCK], centroids)
                d[np.arange(len(d)), np.arange(at, at + len(d))] = np.inf
                near[at:at + BLOCK] = np.argpartition(d, n - 1, axis=1)[:, :n]
        # and back: what is near to no one would never be reached
        source = np.repeat(np.arange(k, dtype=np.int32), n)
        order = np.argsort(near.ravel(), kind="stable")
        to, source = near.ravel()[order], source[order]
        place = np.arange(len(to)) - np.searchsorted(to, to)
        back = np.repeat(near[:, :1], n, axis=1)
        keep = place < n
        back[to[keep], place[keep]] = source[keep]
        self.links = np.concatenate([near, back], axis=1)
        self.pivots = np.unique(np.linspace(0, k - 1, max(1, int(2 * np.sqrt(k)))).astype(np.int64))

    def within(self, x: np.ndarray, ratio: float, least: int, beam: int = 64):
        """(row, centroid): for each row of x the centroids at most ``ratio`` times as far as
        its nearest, and the nearest ``least`` at any rate. A row whose whole beam is that near is
        searched again with a beam four times as wide, until one centroid lies outside or all are in."""
        rows, out = np.arange(len(x)), []
        k = len(self.centroids)
        while len(rows):
            width = min(beam, k)
            again = []
            for at in range(0, len(rows), BLOCK):
                part = rows[at:at + BLOCK]
                who, far = self._nearest(x[part], width)
                inside = far <= ratio * ratio * far[:, :1] + 1e-12
                open_ = np.zeros(len(part), dtype=bool) if width == k else (inside[:, -1] | (width < least))
                inside |= (np.arange(width)[None, :] < least) & np.isfinite(far)
                again.append(part[open_])
                r, c = np.nonzero(inside & ~open_[:, None])
                out.append((part[r], who[r, c]))
            rows, beam = np.concatenate(again), 4 * beam
        return tuple(np.concatenate(o) for o in zip(*out)) if out else (np.zeros(0, dtype=np.int64),) * 2

    def _nearest(self, x, beam):
        """(centroids, squared distances), nearest first, of the ``beam`` nearest that following the links finds; infinite where there are fewer."""
        x = x.astype(np.float32)
        m, k = len(x), len(self.centroids)
        rows, own = np.arange(m)[:, None], (x * x).sum(axis=1)[:, None]
        seen = np.zeros((m, k), dtype=bool)
        seen[:, self.pivots] = True
        who = np.repeat(self.pivots[None, :], m, axis=0)
        far = self.norm[self.pivots][None, :] - 2.0 * (x @ self.centroids[self.pivots].T)
        if who.shape[1] < beam:
            more = beam - who.shape[1]
            who = np.concatenate([who, np.zeros((m, more), dtype=np.int64)], axis=1)
            far = np.concatenate([far, np.full((m, more), np.inf, dtype=np.float32)], axis=1)
        order = np.argsort(far, axis=1, kind="stable")[:, :beam]
        who, far = who[rows, order], far[rows, order]
        done = np.isinf(far)
        while True:
            live = np.flatnonzero(~done.all(axis=1))
            if not len(live):
                return who, np.where(np.isinf(far), np.inf, np.maximum(far + own, 0.0))
            n = min(AT_ONCE, beam)
            pick = np.argpartition(np.where(done[live], np.inf, far[live]), n - 1, axis=1)[:, :n]
            fresh = ~np.take_along_axis(done[live], pick, axis=1)
            np.put_along_axis(picked := done[live], pick, True, axis=1)
            done[live] = picked
            to = self.links[np.take_along_axis(who[live], pick, axis=1)].reshape(len(live), -1).astype(np.int64)
            new = ~seen[live[:, None], to] & np.repeat(fresh, self.links.shape[1], axis=1)
            r, c = np.nonzero(new)
            pair = np.unique(r * k + to[r, c])              # a centroid may be linked from several places
            r, to = pair // k, pair % k
            seen[live[r], to] = True
            d = self.norm[to] - 2.0 * np.einsum("ij,ij->i", self.centroids[to], x[live[r]])
            place = np.arange(len(r)) - np.searchsorted(r, r)
            wide = int(place.max()) + 1 if len(r) else 1
            more_who, more_far = np.zeros((len(live), wide), dtype=np.int64), np.full((len(live), wide), np.inf, dtype=np.float32)
            more_who[r, place], more_far[r, place] = to, d
            all_who, all_far = np.concatenate([who[live], more_who], axis=1), np.concatenate([far[live], more_far], axis=1)
            all_done = np.concatenate([done[live], np.isinf(more_far)], axis=1)
            order = np.argsort(all_far, axis=1, kind="stable")[:, :beam]
            at = np.arange(len(live))[:, None]
            who[live], far[live], done[live] = all_who[at, order], all_far[at, order], all_done[at, order]
