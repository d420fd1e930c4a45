"""Language identification by Bayesian fusion of four kinds of evidence.

posterior(L) ~ P(text | L)^t * P(declared | L) * P(suffix | L) * prior(L | host)

* Text: naive Bayes over byte trigrams of the visible text, hashed to ``BUCKETS``; counts
  come from all labelled documents. The log-likelihood is tempered: it counts as that of
  ``min(trigrams, TEXT_CAP) * TEMPER`` independent trigrams, as neighbours overlap.
* Declared: the language of the page's own markup (``<html lang>`` or a
  ``content-language`` meta, wherever in the page it stands; comments and scripts do not
  count). Address suffix: the last label of the host. Their tables
  P(value | L) are counted over all pages, each page with the posterior of its text alone,
  and smoothed; a missing value is no evidence.
* Host: expected pages per language are counted for every host, its parent domains and
  the whole table by grouped aggregation. Each level is smoothed with its parent:
  prior(node) = (counts + K * prior(parent)) / (pages + K). A page's own count is taken
  out of its own host's counts.

The text model is broadcast; its size is languages * BUCKETS * 8 bytes, and more than
``MAX_LANGUAGES`` languages raise an error. Host, suffix and declared tables stay
distributed and are joined.

Edge cases: a null or empty page has no text evidence, a null address no host (it then
has the prior of the whole table) and no suffix; ties go to the language that sorts first;
repeated rows are pages of their own; an empty table gives an empty result; documents
with a null language or text are not used for training, and without any labelled
document an error is raised.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bytescan import text_chunks
from .common import Shared, fold, materialise
from .html_text import declared_language, lay_out, parse

BUCKETS = 1 << 15
MAX_LANGUAGES = 256
TEXT_CAP, TEMPER = 400, 0.1
HOST_STRENGTH = 5.0
ALPHA = 0.5


def _fold_table() -> np.ndarray:
    """Lower-case A-Z, and one class for everything that is neither letter nor space."""
    table = np.arange(256, dtype=np.uint32)
    table[0x41:0x5B] += 32
    other = np.ones(256, dtype=bool)
    other[0x61:0x7B] = other[0x41:0x5B] = other[0x80:] = False
    table[other] = 0x20
    return table


_FOLDED = _fold_table()


def trigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the trigram that starts at each byte, and each text's count of trigrams.
    Buckets are laid out text by text."""
    folded = _FOLDED[data]
    size = np.maximum(np.diff(offsets) - 2, 0)
    if len(data) < 3:
        return np.empty(0, dtype=np.int64), size
    code = (folded[:-2] << np.uint32(16)) | (folded[1:-1] << np.uint32(8)) | folded[2:]
    bucket = ((code * np.uint32(0x9E3779B1)) >> np.uint32(17)).astype(np.int64)
    keep = np.ones(len(bucket), dtype=bool)
    for back in (1, 2):                                  # trigrams that run into the next text
        at = offsets[1:-1] - back
        keep[at[(at >= 0) & (at < len(keep))]] = False
    for short in np.flatnonzero(np.diff(offsets) < 3):   # texts of one or two bytes
        keep[offsets[short]:min(offsets[short + 1], len(keep))] = False
    return bucket[keep], size


class TextModel:
    def __init__(self, languages: list[str], counts: np.ndarray):
        self.languages = languages
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + ALPHA) / (total + ALPHA * BUCKETS))

    def score(self, data, offsets) -> tuple[np.ndarray, np.ndarray]:
        """Mean log-likelihood per trigram, texts by languages, and the counts of trigrams."""
        bucket, size = trigrams(data, offsets)
        out = np.zeros((len(size), len(self.languages)))
        full = np.flatnonzero(size > 0)
        if len(full):
            starts = (np.cumsum(size) - size)[full]
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(self.logp[k][bucket], starts) / size[full]
        return out, size


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> TextModel:
    """Count the trigrams of all labelled documents; partial counts are summed per task."""
    labelled = docs.select(F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("lang")).where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for a, b, data, offsets in text_chunks(batch.column("text")):
                bucket, size = trigrams(data, offsets)
                names = sorted(set(langs[a:b]))
                code = np.repeat([names.index(x) for x in langs[a:b]], size)
                for k, name in enumerate(names):
                    got = np.bincount(bucket[code == k], minlength=BUCKETS)
                    sums[name] = sums[name] + got if name in sums else got
        for name, got in sums.items():
            at = np.flatnonzero(got)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), type=pa.string()), pa.array(at.astype(np.int32)), pa.array(got[at].astype(np.int64))],
                                             names=["lang", "bucket", "n"])

    parts = labelled.mapInArrow(count, "lang string, bucket int, n long")
    table = materialise(parts.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "language-model")
    languages = [r[0] for r in table.select("lang").distinct().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()]
    if not 0 < len(languages) <= MAX_LANGUAGES:
        raise ValueError(f"the text model takes 1 to {MAX_LANGUAGES} languages")
    counts = np.zeros((len(languages), BUCKETS))
    for name, bucket, n in table.toLocalIterator():      # at most languages * BUCKETS rows
        counts[languages.index(name), bucket] = n
    return TextModel(languages, counts)


def evidence(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, host, suffix, declared, ll): tempered log-likelihoods in language order."""
    markup, address = F.coalesce(F.col(f"`{html}`"), F.lit("")), F.coalesce(F.col(f"`{url}`"), F.lit(""))
    host = F.regexp_replace(fold(F.regexp_extract(address, r"://(?:[^/?#@]*@)?([^/?#:]*)", 1)), r"^\.+|\.+$", "")
    named = pages.select(F.col(f"`{key}`").alias("page_id"), host.alias("host"), markup.alias("_html"))
    shared = Shared(pages.sparkSession, model)

    def score(batches):
        m = shared.value
        for batch in batches:
            texts, declared = [], []
            for x in batch.column("_html"):
                tree = parse(x.as_py())
                texts.append(lay_out(tree))
                declared.append(declared_language(tree))
            text = pa.array(texts, type=pa.string())
            parts = [m.score(data, offsets) for _, _, data, offsets in text_chunks(text)]
            mean = np.concatenate([p[0] for p in parts]) if parts else np.empty((0, len(m.languages)))
            size = np.concatenate([p[1] for p in parts]) if parts else np.empty(0)
            ll = mean * (np.minimum(size, TEXT_CAP) * TEMPER)[:, None]
            at = pa.array(np.arange(len(ll) + 1) * len(m.languages), type=pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("host"), pa.array(declared, type=pa.string()),
                                              pa.ListArray.from_arrays(at, pa.array(ll.ravel()))],
                                             names=["page_id", "host", "declared", "ll"])

    kind = named.schema["page_id"].dataType.simpleString()
    scored = named.mapInArrow(score, f"page_id {kind}, host string, declared string, ll array<double>")
    return scored.withColumn("suffix", F.regexp_extract("host", r"([^.]*)$", 1))


def _softmax(column: str) -> str:
    return (f"transform({column}, x -> exp(x - array_max({column})) / "
            f"aggregate({column}, 0D, (a, y) -> a + exp(y - array_max({column}))))")


def _as_array(long_form: DataFrame, key: str, value: str) -> DataFrame:
    return long_form.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", value))), lambda s: s[value]).alias(value))


def _likelihood(soft: DataFrame, column: str, n_langs: int) -> DataFrame:
    """(value, log P(value | L) in language order) of a categorical evidence."""
    cells = (soft.where(f"{column} <> ''").select(column, F.posexplode("p").alias("k", "p"))
             .groupBy(column, "k").agg(F.sum("p").alias("n")))
    cells = materialise(cells, f"evidence-{column}")
    kinds = cells.select(column).distinct().count()
    totals = cells.groupBy("k").agg(F.sum("n").alias("_all"))
    logs = cells.join(totals, "k").withColumn(f"l_{column}", F.log((F.col("n") + ALPHA) / (F.col("_all") + ALPHA * kinds)))
    return materialise(_as_array(logs, column, f"l_{column}").withColumnRenamed(column, f"_{column}"), f"likelihood-{column}")


def host_priors(soft: DataFrame, strength: float = HOST_STRENGTH) -> DataFrame:
    """(host, parent prior, own counts, own pages) for every host, all in language order."""
    cells = materialise(soft.select("host", F.posexplode("p").alias("k", "p")).groupBy("host", "k")
                        .agg(F.sum("p").alias("n"), F.count(F.lit(1)).alias("pages")), "host-counts")
    root = cells.groupBy("k").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages"))
    languages = F.lit(1.0) / F.count(F.lit(1)).over(Window.partitionBy())
    root = root.withColumn("prior", (F.col("n") + strength * languages) / (F.col("pages") + strength))
    level = materialise(root.select(F.lit("").alias("node"), "k", "prior"), "host-level")
    labels = F.split("host", "[.]")
    chain = F.when(F.col("host") == "", F.array().cast("array<string>")).otherwise(
        F.expr("transform(sequence(1, size(split(host, '[.]'))), i -> array_join(slice(split(host, '[.]'), -i, i), '.'))"))
    nodes = materialise(cells.select(F.posexplode(chain).alias("depth", "node"), "k", "n", "pages")
                        .groupBy("depth", "node", "k").agg(F.sum("n").alias("n"), F.sum("pages").alias("pages")), "host-nodes")
    every = level
    for depth in range((nodes.agg(F.max("depth")).first()[0] or 0) + 1):   # as deep as host names go
        here = nodes.where(F.col("depth") == depth)
        parent = F.when(F.lit(depth) == 0, F.lit("")).otherwise(F.regexp_replace("node", r"^[^.]*\.", ""))
        up = level.select(F.col("node").alias("_parent"), F.col("k").alias("_k"), F.col("prior").alias("_prior"))
        joined = here.join(up, (parent == F.col("_parent")) & (F.col("k") == F.col("_k")))
        level = materialise(joined.select("node", "k", ((F.col("n") + strength * F.col("_prior")) / (F.col("pages") + strength)).alias("prior")), "host-level")
        every = every.unionByName(level)
    parent = F.when(F.size(labels) > 1, F.regexp_replace("host", r"^[^.]*\.", "")).otherwise(F.lit(""))
    up = every.select(F.col("node").alias("_parent"), F.col("k").alias("_k"), F.col("prior").alias("_prior"))
    joined = cells.join(up, (parent == F.col("_parent")) & (F.col("k") == F.col("_k")))
    return materialise(joined.groupBy(F.col("host").alias("_host")).agg(
        F.array_sort(F.collect_list(F.struct("k", "n", "_prior"))).alias("_prior"), F.max("pages").alias("_pages")), "host-priors")


def identify(pages: DataFrame, model: TextModel, key: str = "page_id", url: str = "url", html: str = "html",
             strength: float = HOST_STRENGTH) -> DataFrame:
    """One row per page: page_id, host, suffix, declared, text_lang, lang, confidence."""
    names = F.array(*[F.lit(x) for x in model.languages])
    rows = evidence(pages, model, key, url, html).withColumn("p", F.expr(_softmax("ll")))
    rows = materialise(rows, "language-evidence")
    joined = rows.join(host_priors(rows, strength), F.col("host") == F.col("_host"))
    for column in ("declared", "suffix"):
        joined = joined.join(_likelihood(rows, column, len(model.languages)), F.col(column) == F.col(f"_{column}"), "left")
    # a page's own text is taken out of its host's counts
    prior = F.expr(f"transform(_prior, (s, i) -> (greatest(s.n - p[i], 0D) + {strength}D * s._prior) / (_pages - 1 + {strength}D))")
    total = F.expr("transform(ll, (x, i) -> x + coalesce(l_declared[i], 0D) + coalesce(l_suffix[i], 0D) + ln(_host_prior[i]))")
    fused = joined.withColumn("_host_prior", prior).withColumn("_sum", total).withColumn("_post", F.expr(_softmax("_sum")))
    best = lambda c: F.element_at(names, F.array_position(c, F.array_max(c)).cast("int"))
    return fused.select("page_id", "host", "suffix", F.when(F.col("declared") != "", F.col("declared")).alias("declared"),
                        best(F.col("p")).alias("text_lang"), best(F.col("_post")).alias("lang"),
                        F.array_max("_post").alias("confidence"))
