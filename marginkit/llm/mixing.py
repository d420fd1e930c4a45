"""Mix sources to target weights by weighted fair queueing. DataFrame functions only.

Each source is a queue of its documents in a fixed shuffled order (md5 of the id and a
seed), served ``passes`` times over. A document's virtual finish time is the source's
words up to and including it, over all its passes, divided by the source's target. The
mix is all documents in order of finish time, cut off where the total budget is used up.
As every source has emitted time x target words at any time, the cut falls at a finish
time of about 1 and each source ends near its target.

Targets: sources in code point order (null last) weigh ``weights``, repeating, and share
``share`` times all words. A target stops at ``passes`` times its source's words, and the
excess is shared again by weight until none is above.

No task ever holds a source: a source's queue is cut at fixed fractions of the md5 range,
and each piece adds the words of the pieces before. The budget's cut is found with
histograms of the finish time, refined until the cell it falls into is small.

Edge cases: a null text has 0 words; a null source is a source of its own; documents
without words are never taken (0 words, 0 copies); repeated rows are separate documents;
ties in the order are broken by id, then words; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, materialise, numbered

PIECE_ROWS = 50_000       # aimed-at documents of a piece of a queue
CELLS = 1024              # cells of one histogram
EXACT_ROWS = 100_000      # a cell of at most so many copies is sorted as it is


def _sized_columns(seed: str, key: str, text: str, source: str) -> list:
    words = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit("null"))))
    return [F.col(key).alias("doc_id"), F.col(source).alias("source"), words.alias("size"), order.alias("_order"),
            F.conv(F.substring(order, 1, 8), 16, 10).cast("long").alias("_at")]


def sized(docs: DataFrame, seed: str = "mix", key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Narrow table of the documents: id, source, words and place in the shuffle (0 to 2^32)."""
    return docs.select(*_sized_columns(seed, f"`{key}`", f"`{text}`", f"`{source}`"))


def targets(sources: DataFrame, weights=(3, 1, 2), share: float = 1.5, passes: int = 2) -> DataFrame:
    """Add ``target`` to a table (source, source_size). Only totals reach the driver."""
    ranked = numbered(sources, [F.col("source").asc_nulls_last()], "_rank")
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]),
                          ((F.col("_rank") - 1) % len(weights) + 1).cast("int"))
    caps = materialise(ranked.withColumn("_weight", weight).withColumn("_cap", passes * F.col("source_size")), "sources")
    total = caps.agg(F.sum("source_size")).first()[0] or 0
    level, full = 0.0, -1
    while True:
        at = F.col("_cap") <= F.lit(level) * F.col("_weight") if full >= 0 else F.lit(False)
        cap, free, count = caps.agg(F.sum(F.when(at, F.col("_cap"))), F.sum(F.when(~at, F.col("_weight"))),
                                    F.count(F.when(at, 1))).first()
        if count == full or not free:
            full = count
            break
        level, full = (share * total - (cap or 0)) / free, count
    capped = F.col("_cap") <= F.lit(level) * F.col("_weight") if free else F.lit(True)
    return caps.select("source", "source_size",
                       F.when(capped, F.col("_cap").cast("double")).otherwise(F.lit(level) * F.col("_weight")).alias("target"))


def finish_times(docs: DataFrame, aims: DataFrame) -> DataFrame:
    """Add source_size, target and ``_finish`` (of the first pass) to a sized table."""
    pieces = max(1, -(-docs.count() // PIECE_ROWS))
    cut = docs.withColumn("_piece", F.expr(f"_at * {pieces}L div 4294967296L"))
    offsets = cut.groupBy("source", "_piece").agg(F.sum("size").alias("_words"))
    offsets = offsets.withColumn("_before", F.sum("_words").over(
        Window.partitionBy("source").orderBy("_piece")) - F.col("_words")).drop("_words")
    a = aims.select(F.col("source").alias("_s"), "source_size", "target")
    offsets = materialise(offsets.join(a, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"), "queues")
    o = offsets.withColumnRenamed("source", "_s").withColumnRenamed("_piece", "_p")
    joined = cut.join(o, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_piece") == F.col("_p"))).drop("_s", "_p")
    queue = Window.partitionBy("source", "_piece").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    return (joined.withColumn("_words", F.sum("size").over(queue) + F.col("_before"))
            .withColumn("_finish", F.when(F.col("target") > 0, F.col("_words") / F.col("target")))
            .drop("_before", "_at"))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, passes: int = 2, seed: str = "mix",
        key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken."""
    rows = materialise(sized(docs, seed, key, text, source), "sized")
    sources = materialise(rows.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    aims = materialise(targets(sources, weights, share, passes), "targets")
    queued = materialise(finish_times(rows, aims), "finish")
    copies = queued.where("size > 0 and target > 0").select(
        "doc_id", "size", "_order", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"), "_words", "source_size", "target")
    copies = copies.select("doc_id", "size", "_order", "_pass",
                           ((F.col("_words") + F.col("_pass") * F.col("source_size")) / F.col("target")).alias("_t"))
    budget = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    last = _cut(copies, budget)
    taken = F.lit(0)
    for k in range(passes):
        at = (F.col("_words") + F.lit(k) * F.col("source_size")) / F.when(F.col("target") > 0, F.col("target"))
        here = F.struct(at.alias("_t"), F.col("_order"), F.col("doc_id"), F.col("size"), F.lit(k).alias("_pass"))
        taken = taken + F.when((F.col("size") > 0) & (here <= last), 1).otherwise(0) if last is not None else taken
    return (queued.withColumn("copies", taken.cast("int"))
            .select("doc_id", "source", "size", "source_size", "target", "copies",
                    (F.col("size") * F.col("copies")).alias("taken")))


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, passes: int = 2, seed: str = "mix",
                    key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The documents in the mix, with the number of times each is taken as ``copies`` (an
    input column of that name is replaced). Rows are told apart by id, source, words and,
    where these repeat, by a running number."""
    kept = [c for c in docs.columns if c != "copies"]
    slot = F.concat_ws("|", "_order", "size", F.col("source").isNull(), F.coalesce("source", F.lit("")))
    turn = F.row_number().over(Window.partitionBy("_slot").orderBy("_slot"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row"), *_sized_columns(seed, f"`{key}`", f"`{text}`", f"`{source}`"))
    rows = rows.select("_row", slot.alias("_slot")).withColumn("_turn", turn)
    found = mix(docs, weights, share, passes, seed, key, text, source).where("copies > 0")
    order = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))))
    found = found.withColumn("_order", order).select("copies", slot.alias("_slot")).withColumn("_turn", turn)
    return rows.join(found, ["_slot", "_turn"]).select(*[F.col(f"_row.`{c}`").alias(c) for c in kept], "copies")


def _cut(copies: DataFrame, budget: float):
    """The last copy within the budget, as a struct literal to compare with (None: none).

    Sums the words of ``CELLS`` equal cells of the finish time, keeps the cell where the
    budget is crossed, and looks closer at that cell alone until it is small enough to be
    sorted; the sums before it are carried along."""
    low, high, used = 0.0, copies.agg(F.max("_t")).first()[0], 0
    if high is None:
        return None
    inside = copies
    while True:
        width = (high - low) / CELLS
        rows = inside.count()
        if rows <= EXACT_ROWS or not low + width > low:
            break
        cell = F.least(F.lit(CELLS - 1), F.greatest(F.lit(0), F.floor((F.col("_t") - F.lit(low)) / F.lit(width)))).cast("int")
        sums = inside.groupBy(cell.alias("_cell")).agg(F.sum("size").alias("_words"), F.min("_t").alias("_a"),
                                                      F.max("_t").alias("_z"))
        running = sums.withColumn("_sum", F.sum("_words").over(Window.orderBy("_cell")))
        hit = running.where(F.col("_sum") + F.lit(used) > F.lit(budget)).orderBy("_cell").first()
        if hit is None:
            return _literal(inside.orderBy(*[F.col(c).desc() for c in _ORDER]).first())
        used += hit["_sum"] - hit["_words"]
        narrower = inside.where(F.col("_t").between(F.lit(hit["_a"]), F.lit(hit["_z"])))
        low, high, inside = hit["_a"], hit["_z"], narrower
    order = Window.orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    fits = inside.withColumn("_sum", F.sum("size").over(order)).where(F.col("_sum") + F.lit(used) <= F.lit(budget))
    best = fits.orderBy(*[F.col(c).desc() for c in _ORDER]).first()
    if best is None:  # the cut falls before this cell's first copy: just below it
        first = inside.orderBy(*_ORDER).first()
        return _literal(first, -1)
    return _literal(best)


_ORDER = ["_t", "_order", "doc_id", "size", "_pass"]


def _literal(row, pass_shift: int = 0):
    if row is None:
        return None
    return F.struct(F.lit(row["_t"]).alias("_t"), F.lit(row["_order"]).alias("_order"),
                    F.lit(row["doc_id"]).cast("long").alias("doc_id"), F.lit(row["size"]).cast("long").alias("size"),
                    F.lit(row["_pass"] + pass_shift).alias("_pass"))
