r"""Spelling variants: words that differ by one inserted, deleted or replaced code point.

A word's form is its near word of the largest count (ties: the smallest in code-point
order) if that count is at least ``RATIO`` times the word's own; its root is where the
forms lead.

1. One error leaves one half of a word whole. So a word is looked up twice: among the words that
   start with its left half, and among those that end with its right half (floor and ceiling
   of half its length). A word is indexed under each such half that a word of its length, or one longer or
   shorter, can have: two keys a side.
2. Keys are dealt to shards of about ``SHARD_WORDS`` indexed words. A key with more words than
   that is cut in blocks of words and chunks of queries, each pair of them a shard, so no task holds more.
3. A shard builds a bidirectional FM-index of its words and runs the two search schemes:
   left half exactly, then rightwards with one error; right half exactly, then leftwards. A pair that both
   schemes meet counts in the first only, so the pairs of all shards are distinct and
   only their counts and best forms leave a task.
4. Forms grow tenfold at each step, so chains are short; roots follow by pointer doubling.

Edge cases: null texts and words have no words; words of any length are whole;
repeated rows of a vocabulary are added up; an empty table gives an empty result; other
columns are not looked at. Ties as above.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise
from .fm_index import Vocabulary

RATIO = 10
SHARD_WORDS = 1 << 14
LETTERS = r"[A-Za-zÀ-ÿ]"


def letter_runs(docs: DataFrame, least: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, run): maximal runs of letters, those of at least ``least`` code points."""
    runs = F.regexp_extract_all(F.col(f"`{text}`"), F.lit(f"({LETTERS}{{{least},}})"), F.lit(1))
    return docs.select(F.col(f"`{key}`").alias("doc_id"), F.explode(runs).alias("run"))


def vocabulary(words: DataFrame, least_length: int, least_count: int) -> DataFrame:
    """(word, n) of the words that are long and frequent enough."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def _keyed(words: DataFrame) -> DataFrame:
    """(suffix, key, query, word, n): a row for each key under which a word is looked up or indexed."""
    size = F.length("word")

    def rows(suffix, half, query):
        key = F.expr("right(word, _half)" if suffix else "left(word, _half)")
        return (words.withColumn("_half", half).select(F.lit(suffix).alias("suffix"), key.alias("key"), F.lit(query).alias("query"), "word", "n"))

    def halves(of):
        return F.explode(F.array_distinct(F.array(*[of(size + d) for d in (-1, 0, 1)])))

    left, right = (lambda n: F.floor(n / 2).cast("int")), (lambda n: F.ceil(n / 2).cast("int"))
    return (rows(False, left(size), True).unionAll(rows(True, right(size), True))
            .unionAll(rows(False, halves(left), False)).unionAll(rows(True, halves(right), False)))


def _search(keys, table):
    """(word, n_near, best, best_n) of the queries of one shard."""
    suffix, query = keys[0].as_py(), table.column("query").to_numpy()
    word, n = table.column("word").to_pylist(), table.column("n").to_numpy()
    counts = {w: int(c) for w, c, q in zip(word, n, query) if not q}
    words = sorted(counts)
    queries = sorted({w for w, q in zip(word, query) if q})
    empty = pa.table({"word": pa.array([], pa.string()), "n_near": pa.array([], pa.int64()), "best": pa.array([], pa.string()), "best_n": pa.array([], pa.int64())})
    if not words or not queries:
        return empty
    who, hit = Vocabulary(words).one_error(queries, np.array([q in counts for q in queries]), suffix)
    if suffix and len(who):      # pairs that also agree in the query's left half are found from that side
        new = np.array([words[h][:len(queries[w]) // 2] != queries[w][:len(queries[w]) // 2] for w, h in zip(who.tolist(), hit.tolist())])
        who, hit = who[new], hit[new]
    if not len(who):
        return empty
    n_of = np.array([counts[w] for w in words])
    order = np.lexsort((hit, -n_of[hit], who))
    who, hit = who[order], hit[order]
    first = np.flatnonzero(np.append(True, who[1:] != who[:-1]))
    return pa.table({"word": [queries[i] for i in who[first]], "n_near": pa.array(np.diff(np.append(first, len(who)))),
                     "best": [words[i] for i in hit[first]], "best_n": pa.array(n_of[hit[first]].astype(np.int64))})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best, best_n) of the words (word, n, distinct) that have near words."""
    rows = materialise(_keyed(words), "halves")
    sizes = rows.groupBy("suffix", "key").agg(F.sum(F.when(F.col("query"), 0).otherwise(1)).alias("_w"), F.sum(F.when(F.col("query"), 1).otherwise(0)).alias("_q"))
    hot = materialise(sizes.where((F.col("_w") > SHARD_WORDS) | (F.col("_q") > SHARD_WORDS)).select(
        "suffix", "key", F.ceil(F.col("_w") / SHARD_WORDS).alias("_blocks"), F.ceil(F.col("_q") / SHARD_WORDS).alias("_chunks")), "hot-halves")
    shards = max(1, -(-rows.where("not query").count() // (2 * SHARD_WORDS)))
    shard = F.concat(F.lit("s"), F.pmod(F.xxhash64("key"), F.lit(shards)).cast("string"))
    if hot.isEmpty():
        dealt = rows.withColumn("shard", shard)
    else:
        cut = rows.join(hot, ["suffix", "key"])
        part = lambda n: F.pmod(F.xxhash64("word"), F.greatest(F.col(n), F.lit(1)))
        every = lambda n: F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n), F.lit(1)) - 1)
        cut = cut.withColumn("_b", F.explode(F.when(F.col("query"), every("_blocks")).otherwise(F.array(part("_blocks")))))
        cut = cut.withColumn("_c", F.explode(F.when(F.col("query"), F.array(part("_chunks"))).otherwise(every("_chunks"))))
        cut = cut.withColumn("shard", F.concat_ws(" ", F.lit("k"), "_b", "_c", "key"))
        dealt = rows.join(hot, ["suffix", "key"], "left_anti").withColumn("shard", shard).unionByName(cut.select(*rows.columns, "shard"))
    found = (dealt.select("suffix", "shard", "query", "word", "n").groupBy("suffix", "shard")
             .applyInArrow(_search, "word string, n_near long, best string, best_n long"))
    return (found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("_best"))
            .select("word", "n_near", F.col("_best.best").alias("best"), (-F.col("_best.less")).alias("best_n")))


def variant_groups(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """One row per word of (word, n): word, form, root, n, n_near, form_n."""
    words = materialise(words.where("word is not null").groupBy("word").agg(F.sum("n").cast("long").alias("n")), "words")
    near = words.join(near_words(words), "word", "left")
    big = F.col("best_n") >= F.col("n") * ratio
    known = materialise(near.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
                                    F.when(big, F.col("best")).alias("form"), F.when(big, F.col("best_n")).alias("form_n")), "forms")
    return known.join(_roots(known.where("form is not null").select("word", F.col("form").alias("root"))), "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(steps: DataFrame) -> DataFrame:
    """(word, root) from single steps; each round doubles the steps taken."""
    while True:
        steps = materialise(steps, "roots")
        on = steps.select(F.col("word").alias("_at"), F.col("root").alias("_next"))
        if steps.join(on, F.col("root") == F.col("_at"), "left_semi").isEmpty():
            return steps
        steps = steps.join(on, F.col("root") == F.col("_at"), "left").select("word", F.coalesce("_next", "root").alias("root"))
