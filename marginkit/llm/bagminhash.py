"""BagMinHash signatures of weighted sets (multisets), for batches of documents at once.

Weights are whole counts, discretised in unit steps. Every step of every element owns a
Poisson process of points in time; a point is marked with one of ``m`` signature slots,
and a slot keeps its earliest point. Two multisets agree in a slot with probability
equal to their weighted Jaccard similarity (sum of minima over sum of maxima), because
they share exactly the processes of the steps both have.

The processes of steps [0,1), [1,2), [2,4), [4,8), ... are merged to one process per
ring, so an element of weight w costs O(log w). A ring the weight ends inside is
refined: each point draws its place in the ring bit by bit (halving the ring), and
counts only below w. Points come in ascending order and a document stops as soon as no
later point can win, so the cost is O(elements + m log m) per document.
"""

from __future__ import annotations

import numpy as np

from .bytescan import mix

_U = np.uint64
_G = 0x9E3779B97F4A7C15


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> _U(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def signatures(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """(n_docs, m) array of uint64 slots. ``doc`` ascending; a document without
    elements gets slots of all ones (equal to no other use)."""
    top = np.full((n_docs, m), np.inf)
    if len(doc) == 0:
        return top.view(np.uint64)
    total = np.bincount(doc, weights=weight, minlength=n_docs)
    # cells: one per element and ring
    cells_doc, cells_seed, cells_rate, cells_end = [doc], [mix(element)], [np.ones(len(doc))], [np.zeros(len(doc), dtype=np.int64)]
    level, low = 1, 1
    more = np.flatnonzero(weight > 1)
    while len(more):
        w = weight[more]
        cells_doc.append(doc[more])
        cells_seed.append(mix(mix(element[more]) ^ _U(level * _G & (1 << 64) - 1)))
        cells_rate.append(np.full(len(more), float(low)))
        cells_end.append(np.where(w >= 2 * low, 0, w))      # 0: the whole ring counts
        level, low = level + 1, 2 * low
        more = more[w > low]
    c_doc, seed = np.concatenate(cells_doc), np.concatenate(cells_seed)
    rate, end = np.concatenate(cells_rate), np.concatenate(cells_end)

    has = total > 0
    limit = np.zeros(n_docs)
    limit[has] = (m / total[has]) * (np.log(m) + 3.5)
    step = 1
    time = -np.log(_uniform(mix(seed + _U(_G)))) / rate
    idle_doc, idle_time, idle_seed, idle_rate, idle_end, idle_step = [], [], [], [], [], []
    flat = top.ravel()
    at_step = np.ones(len(time), dtype=np.int64)
    while True:
        while len(time):
            go = time <= limit[c_doc]
            if not go.all():
                rest = ~go
                idle_doc.append(c_doc[rest]); idle_time.append(time[rest]); idle_seed.append(seed[rest])
                idle_rate.append(rate[rest]); idle_end.append(end[rest]); idle_step.append(at_step[rest])
                c_doc, time, seed, rate, end, at_step = (x[go] for x in (c_doc, time, seed, rate, end, at_step))
            if not len(time):
                break
            mark = mix(seed ^ mix(at_step.astype(np.uint64) + _U(0xA5A5)))
            slot = (mark >> _U(33)) % _U(m)
            ok = end == 0
            if not ok.all():
                place = rate * (1.0 + _uniform(mix(mark)))     # in [low, 2 low)
                ok |= place < end
            key = c_doc * m + slot.astype(np.int64)
            np.minimum.at(flat, key[ok], time[ok])
            at_step = at_step + 1
            time = time - np.log(_uniform(mix(seed + at_step.astype(np.uint64) * _U(_G)))) / rate
        late = has & (top.max(axis=1) > limit)
        if not late.any():
            break
        limit[late] *= 1.7
        c_doc, time, seed = np.concatenate(idle_doc), np.concatenate(idle_time), np.concatenate(idle_seed)
        rate, end, at_step = np.concatenate(idle_rate), np.concatenate(idle_end), np.concatenate(idle_step)
        pick = late[c_doc]
        c_doc, time, seed, rate, end, at_step = (x[pick] for x in (c_doc, time, seed, rate, end, at_step))
        idle_doc, idle_time, idle_seed, idle_rate, idle_end, idle_step = [], [], [], [], [], []
    return top.view(np.uint64)


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """(n_docs, bands) hashes of the slots of each band."""
    n, m = sig.shape
    rows = m // bands
    out = np.zeros((n, bands), dtype=np.uint64)
    grouped = sig[:, :rows * bands].reshape(n, bands, rows)
    for k in range(rows):
        out = mix(out * _U(0xD1342543DE82EF95) + grouped[:, :, k])
    return out
