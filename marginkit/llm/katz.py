r"""Katz backoff language model (bigrams), trained and applied in one corpus-wide job.

P(w | h) = d(r) r / c(h) for a pair seen r > 0 times in training, else a(h) P(w); P(w) =
d(c) c / N for a known word, and the rest of the unigram mass for all unknown words
together. d are Good-Turing discounts for counts up to ``GT_MAX`` (absolute discounting
where the counts of counts give no valid one). a(h) = (1 - seen mass of h) / (1 - unigram
mass of the words seen after h), so that every P(. | h) sums to exactly one over the
known words and the unknown class; a history whose pairs are all undiscounted counts one
more event. Unknown histories give P(w). All sums behind a(h) are sums of whole numbers.

Tokens are lower-cased (A-Z) words (runs of anything but space and \x09-\x0D) and one
end token per text; the first token's history is a start mark. Words are compared by
64-bit hashes.

Tables, all in the shared checkpoint folder, no vocabulary or pair table on the driver:

1. Batches: about ``BATCH_TOKENS`` tokens of whole texts a row, as a local vocabulary and a
   compressed stream of local numbers. Everything later is pre-aggregated per batch.
2. Words, partitioned by ranges of the hash (one row each): training counts, and which
   batches hold the word. Words are numbered by falling count, so the count of any
   number follows from one step per distinct count, at most sqrt(2 N) steps, and that
   staircase is what tasks get instead of the vocabulary.
3. Pairs, partitioned in buckets (one row each): training counts, and which texts hold
   the pair. A word of rank ``HOT`` or more is at most 1/HOT of all tokens, so pairs with
   such a word cannot make a hot bucket. They are bucketed by history, or by both words if
   the history is among the first HOT; pairs of two hot words stay with their batch, and
   their counts form a matrix of at most (HOT + 1) x HOT numbers, which is broadcast.
   A bucket thus holds whole histories (or shares of hot ones, whose sums are broadcast,
   HOT + 1 rows) and scores its pairs by itself.

Scores are added up per text in a fixed order of buckets.

Edge cases: null and empty texts have the end token alone; a null id trains; repeated rows
are separate texts; without training texts every score is 0; an empty table gives an empty
result; other columns are not looked at.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import SPACE_WORDS, mix, split_words, text_chunks
from .common import Shared, lean, materialise, trim

BATCH_TOKENS = 1_500_000
BUCKET_TOKENS = 3_000_000
HOT = 1024
GT_MAX = 5
END = np.uint64(0xE7D0F7E87A11CE55)
START = -1           # number of the start mark as a history


def pack(values: np.ndarray) -> bytes:
    """Compress whole numbers >= 0: narrowest type, bytes of equal weight together."""
    top = int(values.max()) if len(values) else 0
    width = next(w for w in (1, 2, 4, 8) if top < 1 << (8 * w))
    raw = np.ascontiguousarray(values.astype(f"<u{width}")).view(np.uint8).reshape(-1, width)
    return bytes([width]) + zlib.compress(np.ascontiguousarray(raw.T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    width = data[0]
    raw = np.frombuffer(zlib.decompress(data[1:]), dtype=np.uint8).reshape(width, -1)
    return np.ascontiguousarray(raw.T).view(f"<u{width}").ravel().astype(np.int64)


# --- batches -------------------------------------------------------------------------

BATCH = "batch long, ids array<bigint>, held array<boolean>, n array<int>, words binary, train binary, places binary, stream binary"


def batches(docs: DataFrame) -> DataFrame:
    """Table 1 from (doc_id, held_out, text)."""
    def run(parts):
        number = TaskContext.get().partitionId() << 32
        ids, held, sizes, hashes, total = [], [], [], [], 0
        for part in parts:
            key, out = part.column("doc_id").to_pylist(), part.column("held_out").to_pylist()
            for a, b, data, offsets in text_chunks(part.column("text")):
                words = split_words(data, offsets, SPACE_WORDS)
                n = np.diff(words.first)
                tokens = np.full(len(words.start) + len(n), END, dtype=np.uint64)   # an end after each text
                tokens[np.arange(len(words.start)) + words.doc] = words.hashes()
                ids += key[a:b]
                held += out[a:b]
                sizes.append(n + 1)
                hashes.append(tokens)
                total += len(tokens)
                if total >= BATCH_TOKENS:
                    yield _batch(number, ids, held, np.concatenate(sizes), np.concatenate(hashes))
                    number, ids, held, sizes, hashes, total = number + 1, [], [], [], [], 0
        if ids:
            yield _batch(number, ids, held, np.concatenate(sizes), np.concatenate(hashes))

    return docs.select("doc_id", "held_out", "text").mapInArrow(lean(run), BATCH)


def _batch(number, ids, held, sizes, tokens):
    words, local = np.unique(tokens, return_inverse=True)
    by_count = np.argsort(-np.bincount(local), kind="stable")
    rank = np.empty_like(by_count)                        # local numbers by falling count pack best
    rank[by_count] = np.arange(len(by_count))
    training = np.repeat(~np.array(held, dtype=bool), sizes)
    train = np.bincount(local[training], minlength=len(words))
    return pa.RecordBatch.from_arrays(
        [pa.array([number], type=pa.int64()), pa.array([ids], type=pa.list_(pa.int64())), pa.array([held], type=pa.list_(pa.bool_())),
         pa.array([sizes], type=pa.list_(pa.int32())), pa.array([pack(np.diff(words, prepend=np.uint64(0)))]), pa.array([pack(train)]),
         pa.array([pack(rank)]), pa.array([pack(rank[local])])],
        names=["batch", "ids", "held", "n", "words", "train", "places", "stream"])


# --- words ---------------------------------------------------------------------------

def _word_parts(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, batch, words, train): the vocabulary of each batch, in order of hash, cut
    into ``buckets`` equal ranges of the hash."""
    def run(parts):
        for part in parts:
            for row in _rows(part):
                words = np.cumsum(unpack(row["words"])).view(np.uint64)
                train = unpack(row["train"])
                bucket = ((words >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                cut = np.searchsorted(bucket, np.arange(buckets + 1))
                have = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(have), pa.array([row["batch"]] * len(have), type=pa.int64()),
                     pa.array([pack(np.diff(words[cut[b]:cut[b + 1]], prepend=np.uint64(0))) for b in have], type=pa.binary()),
                     pa.array([pack(train[cut[b]:cut[b + 1]]) for b in have], type=pa.binary())], names=["bucket", "batch", "words", "train"])
    return table.select("batch", "words", "train").mapInArrow(lean(run), "bucket long, batch long, words binary, train binary")


WORDS = "bucket long, c binary, batches array<bigint>, sizes array<int>, places binary"


def _merge_words(group: pa.Table) -> pa.Table:
    """One row for a bucket: training count of each distinct word, and for each batch the
    places of its words among them."""
    rows = group.sort_by("batch").to_pylist()
    words = [np.cumsum(unpack(r["words"])).view(np.uint64) for r in rows]
    distinct, places = np.unique(np.concatenate(words), return_inverse=True)
    c = np.zeros(len(distinct), dtype=np.int64)
    np.add.at(c, places, np.concatenate([unpack(r["train"]) for r in rows]))
    return pa.table({"bucket": group.column("bucket").slice(0, 1), "c": pa.array([pack(c)]),
                     "batches": pa.array([[r["batch"] for r in rows]], type=pa.list_(pa.int64())),
                     "sizes": pa.array([[len(w) for w in words]], type=pa.list_(pa.int32())), "places": pa.array([pack(places)])})


def _count_classes(words: DataFrame) -> DataFrame:
    """(bucket, c, n): words of each training count above 0."""
    def run(parts):
        for part in parts:
            for row in _rows(part):
                c, n = np.unique(unpack(row["c"]), return_counts=True)
                known = c > 0
                yield pa.RecordBatch.from_arrays([pa.array([row["bucket"]] * int(known.sum()), type=pa.int64()), pa.array(c[known]),
                                                  pa.array(n[known].astype(np.int64))], names=["bucket", "c", "n"])
    return words.select("bucket", "c").mapInArrow(lean(run), "bucket long, c long, n long")


def _numbers(words: DataFrame, classes: DataFrame, shared) -> DataFrame:
    """(batch, slots): the numbers of each batch's words, as blobs by bucket. A word's number
    is the start of its count's step, plus the words of that count in buckets before, plus
    its place among those of its own bucket."""
    before = F.sum("n").over(Window.partitionBy("c").orderBy("bucket")) - F.col("n")
    offsets = classes.withColumn("before", before).groupBy("bucket").agg(F.collect_list(F.struct("c", "before")).alias("offsets"))

    def run(parts):
        uni = shared.value
        for part in parts:
            for row in _rows(part):
                c = unpack(row["c"])
                number = np.full(len(c), uni.known, dtype=np.int64)
                at = np.argsort(c, kind="stable")
                at = at[c[at] > 0]
                kinds, first, inverse = np.unique(c[at], return_index=True, return_inverse=True)
                earlier = {o["c"]: o["before"] for o in row["offsets"] or ()}
                base = uni.start[np.searchsorted(-uni.count[:-1], -kinds)] + np.array([earlier[k] for k in kinds.tolist()], dtype=np.int64)
                number[at] = (base - first)[inverse] + np.arange(len(at))
                found = number[unpack(row["places"])]
                cut = np.concatenate([[0], np.cumsum(row["sizes"])])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["batches"], type=pa.int64()), pa.array([row["bucket"]] * len(row["batches"]), type=pa.int64()),
                     pa.array([pack(found[x:y]) for x, y in zip(cut, cut[1:])], type=pa.binary())], names=["batch", "bucket", "numbers"])

    rows = words.join(offsets, "bucket", "left").mapInArrow(lean(run), "batch long, bucket long, numbers binary")
    return rows.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("bucket", "numbers"))).alias("slots"))


class Unigrams:
    """Counts of words by number, discounts, and P(w)."""

    def __init__(self, steps: list[tuple[int, int]]):
        """``steps``: (count, number of words with it), by falling count."""
        self.count = np.array([c for c, _ in steps] + [0], dtype=np.int64)
        size = np.array([n for _, n in steps], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        self.known = int(self.start[-1])                  # the number of the unknown class
        self.tokens = int((self.count[:-1] * size).sum())
        self.d = discounts([int(size[self.count[:-1] == r].sum()) for r in range(1, GT_MAX + 2)])
        mass = float((self.weight(self.count[:-1]) * size).sum())
        self.unknown = self.tokens - mass                 # in units of 1 / tokens
        self.scale = 1.0
        if self.tokens and self.unknown < 0.5:            # no word is rare enough to be discounted: the unknown class counts one
            self.scale = self.unknown = self.tokens / (self.tokens + 1)
            self.scale *= self.tokens / mass

    def weight(self, counts: np.ndarray) -> np.ndarray:
        """d(c) c"""
        return np.where(counts <= GT_MAX, self.d[np.minimum(counts, GT_MAX)], 1.0) * counts

    def counts(self, number: np.ndarray) -> np.ndarray:
        return self.count[np.searchsorted(self.start, number, side="right") - 1]

    def log(self, number: np.ndarray) -> np.ndarray:
        """log10 P(w); 0 without training."""
        if not self.tokens:
            return np.zeros(len(number))
        c = self.counts(number)
        return np.log10(np.where(c > 0, self.scale * self.weight(c), self.unknown)) - np.log10(self.tokens)


def discounts(n: list[int]) -> np.ndarray:
    """d(0..GT_MAX) from the counts of counts n[0] = n_1 .. n[GT_MAX]; all below one."""
    out = np.ones(GT_MAX + 1)
    absolute = n[0] / (n[0] + 2 * n[1]) if n[0] and n[1] else 0.5
    rest = (GT_MAX + 1) * n[GT_MAX] / n[0] if n[0] else 1.0
    for r in range(1, GT_MAX + 1):
        d = ((r + 1) * n[r] / (r * n[r - 1]) - rest) / (1 - rest) if n[r - 1] and rest < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - absolute) / r
    return out


# --- pairs ---------------------------------------------------------------------------

PAIRS = ("bucket long, batch long, ids array<bigint>, held array<boolean>, n array<int>, known array<int>, base array<double>, "
         "own array<double>, h binary, w binary, count binary, holders binary, batches array<bigint>, from_batch binary, doc binary, times binary")
_PAIR_ARROW = pa.schema([
    ("bucket", pa.int64()), ("batch", pa.int64()), ("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())),
    ("n", pa.list_(pa.int32())), ("known", pa.list_(pa.int32())), ("base", pa.list_(pa.float64())), ("own", pa.list_(pa.float64())),
    *[(c, pa.binary()) for c in ("h", "w", "count", "holders")], ("batches", pa.list_(pa.int64())),
    *[(c, pa.binary()) for c in ("from_batch", "doc", "times")]])


def _row(**values):
    return pa.RecordBatch.from_arrays([pa.array([values.get(f.name)], type=f.type) for f in _PAIR_ARROW], schema=_PAIR_ARROW)


def _pair_rows(joined: DataFrame, shared, buckets: int) -> DataFrame:
    """One row per batch (what its texts have by themselves, and pairs of hot words; bucket
    below 0) and one per batch and bucket."""
    def run(parts):
        uni = shared.value
        for part in parts:
            for row in _rows(part):
                places = unpack(row["places"])
                number = np.empty(len(places), dtype=np.int64)
                number[places] = np.concatenate([unpack(s["numbers"]) for s in row["slots"]])
                yield from _pairs_of(row, number, uni, buckets)
    return joined.mapInArrow(lean(run), PAIRS)


def _rows(part: pa.RecordBatch):
    """The rows of a batch as dicts, one at a time (a row may be megabytes)."""
    for i in range(part.num_rows):
        yield part.slice(i, 1).to_pylist()[0]


def _pairs_of(row, number: np.ndarray, uni: Unigrams, buckets: int):
    stream, sizes = unpack(row["stream"]), np.array(row["n"], dtype=np.int64)
    n_docs, n_words = len(sizes), len(number)
    doc = np.repeat(np.arange(n_docs), sizes)
    first = np.cumsum(sizes) - sizes
    c = uni.counts(number)
    vocabulary = uni.known
    base = np.log10((c + 0.5) / (uni.tokens + 0.5 * (vocabulary + 1)))
    before = np.empty_like(stream)
    before[1:] = stream[:-1]
    before[first] = n_words                               # local number of the start mark
    history = np.append(number, START)
    after_unknown = history[before] == uni.known
    own = np.bincount(doc[after_unknown], weights=uni.log(number)[stream[after_unknown]], minlength=n_docs)
    training = ~np.array(row["held"], dtype=bool)
    # distinct (pair, text) with its times, then distinct pairs
    pick = ~after_unknown
    key = (before[pick] * n_words + stream[pick]) * n_docs + doc[pick]
    del before, pick, after_unknown
    key.sort()
    new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, dtype=np.int64)
    times = np.diff(np.append(new, len(key)))
    pair, text = np.divmod(key[new], n_docs)
    del key
    start = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.empty(0, dtype=np.int64)
    holders = np.diff(np.append(start, len(pair)))
    lh, lw = np.divmod(pair[start], n_words)
    h, w = history[lh], number[lw]
    count = np.add.reduceat(np.where(training[text], times, 0), start) if len(start) else np.empty(0, dtype=np.int64)
    hot = (h < HOT) & (w < HOT)
    spread = np.where(h < HOT, mix(mix(h.astype(np.uint64)) + w.astype(np.uint64)), mix(h.astype(np.uint64)))
    bucket = np.where(hot, -1, (spread % np.uint64(buckets)).astype(np.int64))
    order = np.argsort(bucket, kind="stable")
    cut = np.searchsorted(bucket[order], np.arange(-1, buckets + 1))
    for b in range(-1, buckets):
        mine = order[cut[b + 1]:cut[b + 2]]
        if not len(mine) and b >= 0:
            continue
        entries = _ranges(start[mine], holders[mine])
        packed = dict(h=pack(h[mine] + 1), w=pack(w[mine]), count=pack(count[mine]), holders=pack(holders[mine]),
                      doc=pack(text[entries]), times=pack(times[entries]))
        if b < 0:
            yield _row(bucket=-1 - row["batch"], batch=row["batch"], ids=row["ids"], held=row["held"], n=row["n"],
                       known=np.bincount(doc, weights=(c > 0)[stream], minlength=n_docs).astype(np.int32),
                       base=np.bincount(doc, weights=base[stream], minlength=n_docs), own=own, **packed)
        else:
            yield _row(bucket=b, batch=row["batch"], **packed)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [start, start + size), one after another."""
    if not len(start):
        return np.empty(0, dtype=np.int64)
    return np.repeat(start - (np.cumsum(size) - size), size) + np.arange(size.sum())


def _merge(table: pa.Table) -> pa.Table:
    """The rows of one bucket as one row; a batch's own row stays. One column is unpacked
    at a time, and memory is given back at the end."""
    if table.column("bucket")[0].as_py() < 0:
        return table
    table = table.sort_by("batch")

    def column(name):
        return [unpack(x.as_py()) for x in table.column(name)]

    h, w = (np.concatenate(column(c)) for c in "hw")
    order = np.lexsort((w, h))
    h, w = h[order], w[order]
    start = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (w[1:] != w[:-1])]))
    out = dict(bucket=table.column("bucket")[0].as_py(), batches=table.column("batch").to_pylist(), h=pack(h[start]), w=pack(w[start]))
    del h, w
    out["count"] = pack(np.add.reduceat(np.concatenate(column("count"))[order], start))
    holders = np.concatenate(column("holders"))
    out["holders"] = pack(np.add.reduceat(holders[order], start))
    entries = _ranges((np.cumsum(holders) - holders)[order], holders[order])
    del holders, order, start
    out["times"] = pack(np.concatenate(column("times"))[entries])
    docs = column("doc")
    sizes = [len(x) for x in docs]
    out["doc"] = pack(np.concatenate(docs)[entries])
    del docs
    out["from_batch"] = pack(np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[entries])
    merged = pa.Table.from_batches([_row(**out)])
    del entries, out
    trim()
    return merged


# --- discounts, backoff weights, scores ------------------------------------------------

def _tally(h, w, count, uni: Unigrams, size: int) -> np.ndarray:
    """Per history (0 .. size-1, already numbered): pairs by count 1 .. GT_MAX + 1, then seen
    words by unigram count 1 .. GT_MAX, then the tokens of seen words counted more often."""
    out = np.zeros((size, 2 * GT_MAX + 2), dtype=np.int64)
    seen = count > 0
    h, count, c = h[seen], count[seen], uni.counts(w[seen])
    few = count <= GT_MAX + 1
    np.add.at(out, (h[few], count[few] - 1), 1)
    few = c <= GT_MAX
    np.add.at(out, (h[few], GT_MAX + c[few]), 1)
    np.add.at(out[:, -1], h[~few], c[~few])
    return out


class Histories:
    """Scale of seen pairs and log10 a(h), from tallies and c(h)."""

    def __init__(self, tally: np.ndarray, c: np.ndarray, d: np.ndarray, uni: Unigrams):
        r = np.arange(1, GT_MAX + 1)
        c = np.maximum(c, 1)
        left = (tally[:, :GT_MAX] * ((1 - d[1:]) * r)).sum(axis=1) / c
        none = left <= 0
        self.scale = np.where(none, c / (c + 1), 1.0)
        left = np.where(none, 1 / (c + 1), left)
        seen = ((tally[:, GT_MAX + 1:-1] * (uni.d[1:] * r)).sum(axis=1) + tally[:, -1]) * uni.scale / max(uni.tokens, 1)
        self.alpha = np.log10(left) - np.log10(np.maximum(1 - seen, uni.unknown / max(uni.tokens, 1)))


class Model:
    """All that tasks need besides their own rows; its size does not grow with the corpus
    but for the unigram staircase (sqrt(2 N) steps)."""

    def __init__(self, uni: Unigrams, starts: int, d, hot_tally, hot_counts):
        self.uni, self.starts, self.d, self.hot_counts = uni, starts, d, hot_counts
        number = np.arange(-1, HOT)
        c = np.where(number < 0, starts, uni.counts(np.maximum(number, 0)))
        self.hot_c, self.hot = c, Histories(hot_tally, c, d, uni)

    def log(self, count, c, scale, alpha, w) -> np.ndarray:
        """log10 P(w | h) of pairs."""
        if not self.uni.tokens:
            return np.zeros(len(count))
        weight = np.where(count <= GT_MAX, self.d[np.minimum(count, GT_MAX)], 1.0) * count
        seen = np.log10(np.maximum(weight, 1e-300)) - np.log10(np.maximum(c, 1)) + np.log10(scale)
        return np.where(count > 0, seen, alpha + self.uni.log(w))


def _bucket_logs(row, model: Model) -> np.ndarray:
    """log10 P of each pair of a bucket row or a batch's own row."""
    h, w, count = unpack(row["h"]), unpack(row["w"]), unpack(row["count"])     # h is shifted by one
    if row["bucket"] < 0:
        count = model.hot_counts[h, w]
        return model.log(count, model.hot_c[h], model.hot.scale[h], model.hot.alpha[h], w)
    known, at = np.unique(h, return_inverse=True)
    c = model.uni.counts(np.maximum(known - 1, 0))
    own = Histories(_tally(at, w, count, model.uni, len(known)), c, model.d, model.uni)
    hot = known <= HOT
    own.scale[hot], own.alpha[hot], c[hot] = model.hot.scale[known[hot]], model.hot.alpha[known[hot]], model.hot_c[known[hot]]
    return model.log(count, c[at], own.scale[at], own.alpha[at], w)


def _scores(row, model: Model):
    """(batch, texts, sums) of a row's pairs."""
    logs = np.repeat(_bucket_logs(row, model), unpack(row["holders"])) * unpack(row["times"])
    doc = unpack(row["doc"])
    if row["bucket"] < 0:
        yield row["batch"], np.arange(len(row["n"])), np.bincount(doc, weights=logs, minlength=len(row["n"])) + np.array(row["own"])
        return
    source = unpack(row["from_batch"])
    order = np.argsort(source, kind="stable")
    cut = np.searchsorted(source[order], np.arange(len(row["batches"]) + 1))
    for k, batch in enumerate(row["batches"]):
        mine = order[cut[k]:cut[k + 1]]
        sums = np.bincount(doc[mine], weights=logs[mine])
        have = np.unique(doc[mine])
        yield batch, have, sums[have]


def score_corpus(docs: DataFrame) -> DataFrame:
    """docs: (doc_id, held_out, text). One row per text: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10)."""
    spark = docs.sparkSession
    table = materialise(batches(docs), "katz-batches")
    starts, total = table.select(F.sum(F.expr("size(filter(held, x -> not x))")), F.sum(F.expr("aggregate(n, 0L, (a, x) -> a + x)"))).first()
    starts, total = starts or 0, total or 0
    buckets = max(1, -(-total // BUCKET_TOKENS))
    parts = _word_parts(table, max(1, -(-buckets // 2)))
    words = materialise(parts.groupBy("bucket").applyInArrow(_merge_words, WORDS), "katz-words")
    classes = materialise(_count_classes(words), "katz-counts")
    steps = classes.groupBy("c").agg(F.sum("n").alias("n")).orderBy(F.col("c").desc()).collect()   # at most sqrt(2 N) rows
    uni = Unigrams([(r["c"], r["n"]) for r in steps])
    joined = table.drop("words", "train").join(_numbers(words, classes, Shared(spark, uni)), "batch")
    rows = _pair_rows(joined, Shared(spark, uni), buckets)
    pairs = materialise(rows.groupBy("bucket").applyInArrow(_merge, PAIRS), "katz-pairs")

    model = Shared(spark, _model(pairs, uni, starts))

    def score(parts):
        m = model.value
        for part in parts:
            for row in _rows(part):
                own = row if row["bucket"] < 0 else {}
                for batch, doc, sums in _scores(row, m):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], type=t) for v, t in ((batch, pa.int64()), (row["bucket"], pa.int64()), (pack(doc), pa.binary()),
                         (sums.tobytes(), pa.binary()), *[(own.get(f), _PAIR_ARROW.field(f).type) for f in ("ids", "held", "n", "known", "base")])],
                        names=["batch", "bucket", "doc", "sums", "ids", "held", "n", "known", "base"])

    partial = pairs.mapInArrow(lean(score), "batch long, bucket long, doc binary, sums binary, ids array<bigint>, held array<boolean>, "
                                      "n array<int>, known array<int>, base array<double>")
    tokens = uni.tokens

    def finish(group: pa.Table) -> pa.Table:
        rows = group.sort_by("bucket").to_pylist()
        own = rows[0]
        score = np.zeros(len(own["n"]))
        for row in rows:
            score[unpack(row["doc"])] += np.frombuffer(row["sums"])
        return pa.table({"doc_id": pa.array(own["ids"], type=pa.int64()), "held_out": pa.array(own["held"], type=pa.bool_()),
                         "n_tokens": pa.array(own["n"], type=pa.int64()), "n_known": pa.array(own["known"], type=pa.int64()),
                         "train_tokens": pa.array([tokens] * len(score), type=pa.int64()), "base_score": pa.array(own["base"]),
                         "score": pa.array(score)})

    return partial.groupBy("batch").applyInArrow(
        finish, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def _model(pairs: DataFrame, uni: Unigrams, starts: int) -> Model:
    """Sum the tallies of hot histories, and the counts of counts, over all buckets."""
    shared = Shared(pairs.sparkSession, uni)
    hot = pairs.where("bucket < 0").select("h", "w", "count")
    cold = pairs.where("bucket >= 0").select("h", "w", "count")

    def hot_counts(parts):
        sums = np.zeros((HOT + 1, HOT), dtype=np.int64)
        for part in parts:
            for row in _rows(part):
                np.add.at(sums, (unpack(row["h"]), unpack(row["w"])), unpack(row["count"]))
        h, w = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(h.astype(np.int32)), pa.array(w.astype(np.int32)), pa.array(sums[h, w])], names=["h", "w", "n"])

    def tallies(parts):
        u = shared.value
        sums = np.zeros((HOT + 2, 2 * GT_MAX + 2), dtype=np.int64)     # the last row: all other histories
        for part in parts:
            for row in _rows(part):
                h, w, count = unpack(row["h"]), unpack(row["w"]), unpack(row["count"])
                sums += _tally(np.minimum(h, HOT + 1), w, count, u, HOT + 2)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(HOT + 2, dtype=np.int32)), pa.array(list(sums), type=pa.list_(pa.int64()))], names=["h", "t"])

    counts = np.zeros((HOT + 1, HOT), dtype=np.int64)
    got = hot.mapInArrow(lean(hot_counts), "h int, w int, n long").groupBy("h", "w").agg(F.sum("n").alias("n")).toArrow()
    counts[got["h"].to_numpy(), got["w"].to_numpy()] = got["n"].to_numpy()
    tally = np.zeros((HOT + 2, 2 * GT_MAX + 2), dtype=np.int64)
    cells = cold.mapInArrow(lean(tallies), "h int, t array<bigint>").select("h", F.posexplode("t").alias("k", "n")).groupBy("h", "k").agg(F.sum("n").alias("n")).toArrow()
    tally[cells["h"].to_numpy(), cells["k"].to_numpy()] = cells["n"].to_numpy()
    h, w = np.nonzero(counts)
    tally[:HOT + 1] += _tally(h, w, counts[h, w], uni, HOT + 1)
    d = discounts([int(x) for x in tally[:, :GT_MAX + 1].sum(axis=0)])
    return Model(uni, starts, d, tally[:HOT + 1], counts)
