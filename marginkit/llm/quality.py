r"""Line-first quality rules.

Every line (text between newlines) with a word is judged on its own:

* punctuation: prose ends or carries sentence punctuation. A line fails if at least
  ``max_symbol_rate`` percent of its words carry symbols out of ``#*$%&|<>`` or doubled marks
  (``!!``, ``??``), or if it has ``long_line`` words or more without any of ``.!?:;,``
  or their wide forms.
* navigation: a line fails if ``max_bar_rate`` percent or more of its words are bare separators
  (``|``, ``>``, ``/``, ``*``, ``-`` ...), as in menus and breadcrumbs.
* boilerplate: a line of at most ``boilerplate_words`` words fails if it holds one of
  ``BOILERPLATE``.

Failing lines are removed. Then a document is rejected if it lost more than ``max_loss``
percent of its words. Before the line rules, documents are rejected that have fewer than
``min_words`` words, or more than ``max_repeat`` percent of words inside 8-word windows
that occur twice or more in the text.

Words are runs of anything but space and \x09-\x0D. All counting is done for a chunk of
texts at once on the bytes; windows and lines are compared by 64-bit hashes within one
document.

Edge cases: a null or empty text has no words and is rejected, and its cleaned text is
null or empty; lines without words are kept as they are and count as no loss; repeated
rows are judged each by itself; an empty table gives an empty result; other columns of
the input are kept as they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytescan import SPACE_WORDS, mix, split_words, text_chunks, windows

#: lower-case phrases of page furniture
BOILERPLATE = (
    "all rights reserved", "privacy policy", "terms of use", "terms of service", "cookie policy",
    "we use cookies", "accept cookies", "enable javascript", "javascript is disabled", "sign in to",
    "log in to", "subscribe to our", "click here to", "share this article", "read more:", "back to top",
    "skip to content", "lorem ipsum",
)


@dataclass(frozen=True)
class Rules:
    min_words: int = 20
    window: int = 8
    max_repeat: int = 30           # all rates are percent of words
    max_symbol_rate: int = 30
    max_bar_rate: int = 20
    long_line: int = 40
    boilerplate_words: int = 30
    max_loss: int = 40


def _lut(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[list(chars.encode())] = True
    return out


_SYMBOL, _DOUBLE, _STOP = _lut("#*$%&|<>"), _lut("!?"), _lut(".!?:;,")
_BAR = _lut("|>/*-<")         # a bar is a word of 1 to 3 of these, or one of the wide ones
_WIDE_BAR = [c.encode() for c in "·»«•›"]
_LINES = np.ones(256, dtype=bool)
_LINES[0x0A] = False
_WIDE_STOP = re.compile("[…。、！？，：；।]")
_BOILER = re.compile("|".join(map(re.escape, BOILERPLATE)), re.I)
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost_words"]


def _sums(x: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x) + 1, dtype=np.int64)
    np.cumsum(x, out=out[1:])
    return out


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of equal keys: which have a twin, and which have an equal key at an earlier place."""
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twin, later = np.zeros(len(key), dtype=bool), np.zeros(len(key), dtype=bool)
    later[order[1:][same]] = True
    twin[order[1:][same]] = True
    twin[order[:-1][same]] = True
    return twin, later


def _own(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Hashes made different between documents."""
    return mix(h + mix(doc.astype(np.uint64) + np.uint64(1)))


def measure(data: np.ndarray, offsets: np.ndarray, rules: Rules):
    """Counts of each text of a chunk, and its failing lines as (text, start, end) bytes."""
    n = len(offsets) - 1
    words = split_words(data, offsets, SPACE_WORDS)
    lines = split_words(data, offsets, _LINES)
    n_words = np.diff(words.first)
    inside = _sums(SPACE_WORDS[data] & ((data & 0xC0) != 0x80)) if len(data) else np.zeros(1, dtype=np.int64)
    symbol = _sums(_SYMBOL[data]) if len(data) else np.zeros(1, dtype=np.int64)
    stop = _sums(_STOP[data]) if len(data) else np.zeros(1, dtype=np.int64)
    word_chars = inside[offsets[1:]] - inside[offsets[:-1]]
    n_symbols = symbol[offsets[1:]] - symbol[offsets[:-1]]
    # words in repeated windows
    h, doc, at = windows(words.hashes(fold=False), words.first, rules.window)
    full = n_words[doc] >= rules.window
    h, doc, at = h[full], doc[full], at[full]
    twin, _ = _repeated(_own(h, doc))
    edge = np.zeros(len(words.start) + 1, dtype=np.int64)
    np.add.at(edge, at[twin], 1)
    np.add.at(edge, at[twin] + rules.window, -1)
    covered = _sums(np.cumsum(edge[:-1]) > 0)
    n_repeat = covered[words.first[1:]] - covered[words.first[:-1]]
    # lines with a word
    w0 = np.searchsorted(words.start, lines.start)
    w1 = np.searchsorted(words.start, lines.end)
    with_word = w1 > w0
    start, end, owner = lines.start[with_word], lines.end[with_word], lines.doc[with_word]
    w0, w1 = w0[with_word], w1[with_word]
    _, later = _repeated(_own(lines.hashes(fold=False)[with_word], owner))
    n_dup = np.bincount(owner[later], minlength=n)
    # line rules
    size = w1 - w0
    double = np.zeros(len(data), dtype=bool)
    if len(data) > 1:
        double[1:] = _DOUBLE[data[1:]] & (data[1:] == data[:-1])
    doubles = _sums(double)
    noisy = _sums((symbol[words.end] > symbol[words.start]) | (doubles[words.end] > doubles[words.start]))
    bars = _sums(_bars(data, words))
    stops = stop[end] - stop[start]
    fails = 100 * (noisy[w1] - noisy[w0]) >= rules.max_symbol_rate * size
    fails |= 100 * (bars[w1] - bars[w0]) >= np.maximum(rules.max_bar_rate * size, 100)
    for i in np.flatnonzero(~fails & (stops == 0) & (size >= rules.long_line)):
        fails[i] = not _WIDE_STOP.search(data[start[i]:end[i]].tobytes().decode("utf-8", "replace"))
    for i in _boilerplate(data, start, end, size <= rules.boilerplate_words):
        fails[i] = True
    n_lost = np.bincount(owner[fails], weights=size[fails], minlength=n).astype(np.int64)
    counts = [n_words, word_chars, n_symbols, n_dup, n_repeat, n_lost]
    return counts, (owner[fails], start[fails], end[fails])


def _bars(data, words) -> np.ndarray:
    size = words.end - words.start
    plain = _sums(_BAR[data]) if len(data) else np.zeros(1, dtype=np.int64)
    out = (size <= 3) & (plain[words.end] - plain[words.start] == size)
    for mark in _WIDE_BAR:
        at = np.flatnonzero(size == len(mark))
        same = np.ones(len(at), dtype=bool)
        for k, byte in enumerate(mark):
            same &= data[words.start[at] + k] == byte
        out[at[same]] = True
    return out


def _boilerplate(data, start, end, short) -> list[int]:
    """Indices of the short lines that hold a boilerplate phrase."""
    if not len(start):
        return []
    text = data.tobytes().decode("latin-1")      # one character per byte, so places stay
    out = []
    for m in _BOILER.finditer(text):
        i = int(np.searchsorted(start, m.start(), side="right")) - 1
        if i >= 0 and m.end() <= end[i] and short[i]:
            out.append(i)
    return out


def clean_lines(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: list[str] | None = None,
                with_text: bool = True) -> DataFrame:
    """The columns ``keep`` (default: all) packed as ``_row``, with the counts, base_failed,
    kept and, if ``with_text``, the cleaned text as ``_clean``."""
    kept = docs.columns if keep is None else keep
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), F.col(f"`{text}`").alias("_text"))
    row_type = packed.schema["_row"].dataType
    schema = T.StructType([T.StructField("_row", row_type), *[T.StructField(c, T.LongType()) for c in COUNTS]]
                          + [T.StructField("_clean", T.StringType())] * with_text)

    def judge(batches):
        for batch in batches:
            column = batch.column("_text")
            counts = [[] for _ in COUNTS]
            clean = column.to_pylist() if with_text else None
            for a, _, data, offsets in text_chunks(column):
                c, (owner, start, end) = measure(data, offsets, rules)
                for got, more in zip(counts, c):
                    got.append(more)
                if with_text:
                    for d in np.unique(owner):
                        clean[a + d] = _without(data, offsets, d, start[owner == d], end[owner == d])
            arrays = [pa.array(np.concatenate(c) if c else np.empty(0, dtype=np.int64), type=pa.int64()) for c in counts]
            tail = [pa.array(clean, type=pa.string())] if with_text else []
            yield pa.RecordBatch.from_arrays([batch.column("_row"), *arrays, *tail], names=["_row", *COUNTS] + ["_clean"] * with_text)

    out = packed.mapInArrow(judge, schema)
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat * F.col("n_words"))
    return (out.withColumn("base_failed", failed)
            .withColumn("kept", ~failed & (100 * F.col("n_lost_words") <= rules.max_loss * F.col("n_words"))))


def _without(data, offsets, d, start, end) -> str:
    """Text ``d`` without the given lines and the newline that ends each."""
    low, high = int(offsets[d]), int(offsets[d + 1])
    out, at = [], low
    for s, e in zip(start.tolist(), end.tolist()):
        out.append(data[at:s].tobytes())
        at = min(e + 1, high)
    out.append(data[at:high].tobytes())
    return b"".join(out).decode("utf-8", "replace")


def filter_quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text") -> DataFrame:
    """The documents that are kept, without their failing lines; columns stay as they are."""
    good = clean_lines(docs, rules, text).where("kept")
    return good.select(*[F.col("_clean").alias(c) if c == text else F.col(f"_row.`{c}`").alias(c) for c in docs.columns])
