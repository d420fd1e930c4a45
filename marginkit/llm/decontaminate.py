"""Benchmark decontamination with a generalised suffix automaton of the test items.

Items and documents are lower-cased (A-Z) and cut into words. All items go into one
automaton over words; a document's words are streamed through it, and at each word the
length of the longest match ending there is known. A match of at least ``window`` words
ends a window of an item; an item with fewer words is one window as a whole. Every word
inside such a window is hit.

Speed: a match of two words or more only runs over word pairs that occur in an item.
Pairs are tested for a whole chunk of texts at once, and only runs of such pairs that are
long enough to hold a window are streamed word by word.

The items are broadcast. Items are dealt over automata of at most ``MAX_ITEM_WORDS``
words, counted first (an item longer than that is cut in pieces that overlap by a window
less one word, so no window is lost); documents pass through them one after another in
the same task, so memory holds at most that many words per pass, however many items
there are.

Edge cases: null and empty texts and items have no words and no hits; repeated rows
give repeated results; items with equal texts all count; an item id that is null counts
as the text 'null'; an empty benchmark hits nothing; an empty table gives an empty
result; other columns of the input are kept as they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import ALNUM_WORDS, split_words, text_chunks
from .common import Shared, fold

WINDOW = 13
MAX_ITEM_WORDS = 1_000_000
#: Java form of the word rule
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
                                   T.StructField("words", T.LongType())]))


class SuffixAutomaton:
    """Generalised suffix automaton over the words of a set of items."""

    def __init__(self, items, window: int):
        self.window = window
        self.next, self.link, self.len = [{}], [-1], [0]
        self.ids: dict[str, int] = {}
        coded = [(key, [self.ids.setdefault(w, len(self.ids)) for w in words]) for key, words in items]
        for _, words in coded:
            last = 0
            for w in words:
                last = self._extend(last, w)
        self.items: dict[int, set] = {}          # state of a full window -> items
        self.short: dict[int, list] = {}         # state -> [(words, item)] of short items
        for key, words in coded:
            state = size = 0
            for w in words:
                state, size = self.step(state, size, w)
                if size >= window:
                    self.items.setdefault(self.window_state(state), set()).add(key)
            if 0 < len(words) < window:
                self.short.setdefault(state, []).append((len(words), key))
        self.least = min([window, *(n for x in self.short.values() for n, _ in x)])

    def _extend(self, last: int, w: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        if w in nxt[last]:                       # the word already follows: reuse or split
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else self._clone(last, w, q)
        new = len(nxt)
        nxt.append({}); link.append(0); length.append(length[last] + 1)
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, w, q)
        return new

    def _clone(self, p: int, w: int, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        copy = len(nxt)
        nxt.append(dict(nxt[q])); link.append(link[q]); length.append(length[p] + 1)
        link[q] = copy
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = copy
            p = link[p]
        return copy

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """State and length of the longest match after one more word."""
        nxt, link = self.next, self.link
        while state and w not in nxt[state]:
            state = link[state]
            size = self.len[state]
        if w in nxt[state]:
            return nxt[state][w], size + 1
        return 0, 0

    def window_state(self, state: int) -> int:
        """State of the last ``window`` words of a match at least that long."""
        while self.len[self.link[state]] >= self.window:
            state = self.link[state]
        return state

    def hits(self, words: list[int]):
        """Yield (first word, one past last, items) of every window that occurs."""
        state = size = 0
        for i, w in enumerate(words):
            state, size = self.step(state, size, w)
            if size >= self.window:
                yield i + 1 - self.window, i + 1, self.items[self.window_state(state)]
            if self.short:
                s = state
                while s > 0:
                    for n, key in self.short.get(s, ()):
                        if n <= size:
                            yield i + 1 - n, i + 1, (key,)
                    s = self.link[s]


class Matcher:
    """The automaton with sorted hashes of its words and word pairs."""

    def __init__(self, items, window: int = WINDOW):
        self.sam = SuffixAutomaton(items, window)
        vocabulary = list(self.sam.ids)
        joined = "".join(vocabulary).encode()
        sizes = [len(w.encode()) for w in vocabulary]
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        words = split_words(np.frombuffer(joined, dtype=np.uint8), offsets, ALNUM_WORDS)
        h = words.hashes()
        order = np.argsort(h)
        self.hash, self.code, self.words = h[order], order, vocabulary
        self.seen = np.zeros(1 << 20, dtype=bool)
        self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        pairs = set()
        for _, text in items:
            coded = [self.sam.ids[w] for w in text]
            pairs.update(zip(coded, coded[1:]))
        self.pairs = np.array(sorted(a * len(vocabulary) + b for a, b in pairs), dtype=np.int64)

    def codes(self, h: np.ndarray) -> np.ndarray:
        """Word number of each hash, -1 for words of no item."""
        out = np.full(len(h), -1, dtype=np.int64)
        if not len(self.hash):
            return out
        maybe = np.flatnonzero(self.seen[(h & np.uint64((1 << 20) - 1)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.hash, h[maybe]), len(self.hash) - 1)
        good = self.hash[at] == h[maybe]
        out[maybe[good]] = self.code[at[good]]
        return out

    def scan(self, words) -> dict[int, tuple[list, set]]:
        """Text index -> (hit spans in words, items) of a chunk."""
        code = self.codes(words.hashes())
        if not (code >= 0).any():
            return {}
        known = (code[1:] >= 0) & (code[:-1] >= 0) & (words.doc[1:] == words.doc[:-1])
        at = np.flatnonzero(known)
        key = code[at] * len(self.words) + code[at + 1]
        where = np.searchsorted(self.pairs, key)
        ok = np.zeros(len(code) + 1, dtype=bool)          # ok[i]: words i-1 and i belong together
        if len(self.pairs):
            where = np.minimum(where, len(self.pairs) - 1)
            ok[at[self.pairs[where] == key] + 1] = True
        starts = np.flatnonzero((code >= 0) & ~ok[:-1])
        ends = np.flatnonzero((code >= 0) & ~ok[1:]) + 1
        long = ends - starts >= self.sam.least
        found: dict[int, tuple[list, set]] = {}
        for a, b in zip(starts[long], ends[long]):
            run = []
            for i in range(a, b):                          # the words themselves, not their hashes
                c = int(code[i])
                same = words.text(i).translate(_FOLD) == self.words[c]
                run.append(c if same else -1)
            for x, y, items in self.sam.hits(run):
                spans, names = found.setdefault(int(words.doc[a]), ([], set()))
                x, y = x + int(a), y + int(a)
                if spans and x <= spans[-1][1] and x >= spans[-1][0]:
                    spans[-1][1] = max(spans[-1][1], y)
                else:
                    spans.append([x, y])
                names |= set(items)
        return {d: (_union(s), names) for d, (s, names) in found.items()}


_FOLD = {c: c + 32 for c in range(65, 91)}


def _union(spans):
    out = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def item_groups(benchmark: DataFrame, window: int = WINDOW, key: str = "item_id", text: str = "text",
                max_words: int = MAX_ITEM_WORDS):
    """Yield the items as lists of (id, words) of at most ``max_words`` words, one list per
    automaton; the driver holds one list at a time. Long items are cut into overlapping
    pieces first."""
    words = F.regexp_extract_all(fold(F.coalesce(F.col(text), F.lit(""))), F.lit(WORDS), F.lit(0))
    step = max_words - window
    items = benchmark.select(F.coalesce(F.col(key).cast("string"), F.lit("null")).alias("k"), words.alias("w")).where("size(w) > 0")
    pieces = items.select("k", F.explode(F.expr(
        f"transform(sequence(0, greatest(0, (size(w) - {window}) div {step})), i -> slice(w, i * {step} + 1, {max_words}))")).alias("w"))
    group, size = [], 0
    for k, w in pieces.toLocalIterator():
        if size + len(w) > max_words and group:
            yield group
            group, size = [], 0
        group.append((k, list(w)))
        size += len(w)
    yield group


def find_hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text",
              keep: list[str] | None = None, max_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """The columns ``keep`` (default: all) with ``_n_words``, ``_items`` (ids as strings) and
    ``_spans``: byte ranges of the text (UTF-8) that are hit, with their words."""
    spark = docs.sparkSession
    kept = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    out = packed.withColumns({"_n_words": F.lit(0).cast("long"), "_items": F.array().cast("array<string>"),
                              "_spans": F.array().cast(_SPANS)})
    for group in item_groups(benchmark, window, max_words=max_words):
        shared = Shared(spark, Matcher(group, window))
        out = out.mapInArrow(_scanner(shared), out.schema)
    return out.drop("_text")


def _scanner(shared):
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64())]))

    def scan(batches):
        matcher = shared.value
        for batch in batches:
            n_words, spans, items = [], batch.column("_spans").to_pylist(), batch.column("_items").to_pylist()
            for a, _, data, offsets in text_chunks(batch.column("_text")):
                words = split_words(data, offsets, ALNUM_WORDS)
                n_words.append(np.diff(words.first))
                for d, (ranges, names) in matcher.scan(words).items():
                    old = spans[a + d]
                    new = [(int(words.start[x] - offsets[d]), int(words.end[y - 1] - offsets[d]), x, y) for x, y in ranges]
                    spans[a + d] = _merge(old, new, words, d, offsets)
                    items[a + d] = sorted({*items[a + d], *names})
            count = pa.array(np.concatenate(n_words) if n_words else np.empty(0, dtype=np.int64), type=pa.int64())
            cols = {"_row": batch.column("_row"), "_text": batch.column("_text"), "_n_words": count,
                    "_items": pa.array(items, type=pa.list_(pa.string())), "_spans": pa.array(spans, type=span)}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return scan


def _merge(old, new, words, d, offsets):
    """Byte ranges of an earlier automaton and this one, as their union with word counts."""
    ranges = _union([[s["start"], s["end"]] for s in old] + [[s, e] for s, e, _, _ in new])
    first, end = words.first[d], words.first[d + 1]
    start = words.start[first:end] - offsets[d]
    # ranges that only touch through a separator stay apart; each starts and ends at a word
    return [{"start": s, "end": e, "words": int(np.searchsorted(start, e) - np.searchsorted(start, s))} for s, e in ranges]


def judge(hits: DataFrame, min_share_inverse: int = 20) -> DataFrame:
    """Counts and the verdict: n_words, n_hit, n_items, items_sha256, contaminated."""
    n_hit = F.coalesce(F.expr("aggregate(_spans, 0L, (a, s) -> a + s.words)"), F.lit(0).cast("long"))
    return hits.select(
        "_row", "_spans", F.col("_n_words").alias("n_words"), n_hit.alias("n_hit"),
        F.size("_items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("_items"), ","), 256).alias("items_sha256"),
        ((n_hit > 0) & (min_share_inverse * n_hit >= F.col("_n_words"))).alias("contaminated"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, min_share_inverse: int = 20,
                  text: str = "text") -> DataFrame:
    """The documents without contamination: those with 1/``min_share_inverse`` or more of
    their words hit go (coverage limit); from the others every hit span is cut out
    (length limit), the text on both sides joined as it is. Columns stay as they are."""
    judged = judge(find_hits(docs, benchmark, window, text), min_share_inverse).where("not contaminated")
    cut = F.expr("""
        case when size(_spans) = 0 then _old else decode(
          aggregate(_spans, struct(unhex('') as out, 0L as at),
            (a, s) -> struct(concat(a.out, substring(_bytes, cast(a.at + 1 as int), cast(s.start - a.at as int))) as out, s.end as at),
            a -> concat(a.out, substring(_bytes, cast(a.at + 1 as int)))), 'UTF-8') end""")
    old = F.col(f"_row.`{text}`")
    clean = judged.withColumn("_old", old).withColumn("_bytes", F.when(F.size("_spans") > 0, F.encode(old, "UTF-8"))).withColumn("_new", cut)
    return clean.select(*[F.col("_new").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
