r"""Approximate nearest neighbours by inner product: balanced posting lists behind a centroid graph.

1. Only the k + 1 smallest ids of each distinct vector can be among the k nearest of any
   query, as copies tie and ties go to smaller ids (the one extra stands in for the query's own id). These
   rows are indexed; the limit is exact and is applied before the shuffle (a window with a group limit).
2. Largest inner product becomes nearest by distance: vectors of like norm (a factor of two) form a
   band, are scaled to at most one and get one more coordinate that makes them unit vectors;
   unit queries have zero there. Bands have their own centroids, so a few long vectors do
   not blur the rest.
3. Centroids are fitted by balanced splitting on a sample (rows by a hash of the id, about ``SAMPLE`` rows). Lists hold about the square root of the
   number of indexed rows, ``LIST_ROWS`` at least, so their number and their length grow alike; at most
   ``MAX_LISTS``, beyond which the lists alone grow.
4. Every vector goes to its nearest centroid's list, and, near a boundary, to up to ``COPIES`` - 1
   more: those at most ``BOUNDARY`` times as far that are not much nearer to a chosen centroid than to
   the vector (``SPREAD``). In many dimensions centroids lie nearer to each other than any vector to them, so
   "not nearer at all" would copy nothing.
5. A query follows the centroid graph and reads the lists at most ``RATIO`` times as far as
   the nearest, however many they are, and the nearest ``LEAST_LISTS`` at any rate.
6. Lists are cut in blocks of ``BLOCK_ROWS`` vectors and the queries that read a list in chunks of as
   many, so a task holds one block and one chunk. Equal queries are searched once. Scores are computed in
   double precision on the original values, the same way for equal vectors.

The approximation is in 5 alone; ``recall`` measures it against all rows. What reaches the
driver: the sample, counts per band, and sizes per list.

Edge cases: rows with a null id, and vectors that are null, empty, zero or hold null, NaN or
infinite components take no part; of rows with one id, the one with the largest vector counts; only
vectors of the most common length (ties: the longest) take part; fewer candidates than k: all of
them; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .centroids import CentroidGraph, balanced_centroids, squared
from .common import Shared, materialise

SAMPLE = 1 << 16
LEAST_SAMPLE = 256
LIST_ROWS = 128
MAX_LISTS = 1 << 14
COPIES, BOUNDARY, SPREAD = 4, 1.15, 0.5
RATIO = 1.06
LEAST_LISTS = 8
BLOCK_ROWS = 1 << 11
SALTS = 16


def vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, vector, band): one row per id that takes part, from a written table."""
    kind = "float" if dict(df.dtypes)[vector] == "array<float>" else "double"
    own = df.select(F.col(f"`{key}`").cast("long").alias("vec_id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("vector"))
    wide = F.col("vector").cast("array<double>")
    good = F.forall(wide, lambda x: F.coalesce(F.abs(x) < F.lit(float("inf")), F.lit(False))) & F.exists(wide, lambda x: x != 0)
    top = F.array_max(F.transform(wide, F.abs))
    norm = top * F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + (x / top) * (x / top)))
    own = own.where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.max("vector").alias("vector"))
    own = materialise(own.withColumn("band", F.floor(F.log2(norm) + 0.5).cast("int")), "vectors")
    most = own.groupBy(F.size("vector").alias("_d")).agg(F.count(F.lit(1)).alias("_n")).orderBy(F.desc("_n"), F.desc("_d")).limit(1).collect()
    return own.where(F.size("vector") == (most[0]["_d"] if most else 0))


def _matrix(column) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray, band: int) -> np.ndarray:
    """Vectors of a band, scaled to at most one and made unit vectors by one more coordinate."""
    x = x / 2.0 ** (band + 0.5)
    return np.concatenate([x, np.sqrt(np.maximum(1.0 - (x * x).sum(axis=1), 0.0))[:, None]], axis=1).astype(np.float32)


def _queries(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1)[:, None]
    x = x / np.sqrt((x * x).sum(axis=1))[:, None]
    return np.concatenate([x, np.zeros((len(x), 1))], axis=1).astype(np.float32)


def fit(rows: DataFrame) -> "dict[int, tuple[int, CentroidGraph]]":
    """band -> (number of its first list, graph of its centroids), from a sample of (vec_id, vector, band)."""
    counts = {r["band"]: r["n"] for r in rows.groupBy("band").agg(F.count(F.lit(1)).alias("n")).collect()}
    total, graphs, first = sum(counts.values()), {}, 0
    if not total:
        return graphs
    share = {b: min(1.0, max(LEAST_SAMPLE, SAMPLE * n / total) / n) for b, n in counts.items()}
    odds = F.create_map(*[F.lit(x) for b in sorted(share) for x in (b, share[b])])[F.col("band")]
    picked = F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < odds * F.lit(float(1 << 30))
    sample = rows.where(picked).select("vec_id", "band", "vector").toArrow()
    order = np.argsort(sample["vec_id"].to_numpy())
    sample, band = sample.take(order), sample["band"].to_numpy()[order]
    for b in sorted(counts):
        at = np.flatnonzero(band == b)
        if not len(at):        # a band of very few rows can miss the sample; its list then needs no centre
            centroids = np.zeros((1, len(sample["vector"][0]) + 1 if len(sample) else 1), dtype=np.float32)
        else:
            length = max(LIST_ROWS, int(np.sqrt(total)))
            lists = max(1, min(-(-counts[b] // length), -(-MAX_LISTS * counts[b] // total), len(at)))
            centroids = balanced_centroids(_unit(_matrix(sample["vector"].take(at)), b), lists)
        graphs[b] = (first, CentroidGraph(centroids))
        first += len(centroids)
    return graphs


def _chosen(x: np.ndarray, centroids: np.ndarray):
    """(row, centroid): the nearest centroid of each row and the further ones its closure takes."""
    out = []
    for at in range(0, len(x), BLOCK_ROWS):
        d = squared(x[at:at + BLOCK_ROWS], centroids)
        n = min(2 * COPIES, d.shape[1])
        near = np.argpartition(d, n - 1, axis=1)[:, :n]
        near = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, axis=1), axis=1, kind="stable"), axis=1)
        d = np.take_along_axis(d, near, axis=1)
        take = np.zeros(near.shape, dtype=bool)
        take[:, 0] = True
        for j in range(1, n):
            good = (d[:, j] <= BOUNDARY ** 2 * d[:, 0]) & (take.sum(axis=1) < COPIES)
            for i in range(j):
                gap = ((centroids[near[:, i]] - centroids[near[:, j]]) ** 2).sum(axis=1)
                good &= ~take[:, i] | (gap >= SPREAD ** 2 * d[:, j])
            take[:, j] = good
        r, c = np.nonzero(take)
        out.append((at + r, near[r, c]))
    return tuple(np.concatenate(o) for o in zip(*out))


def postings(rows: DataFrame, shared: Shared) -> DataFrame:
    """(list, vec_id, vector) of every row, boundary rows in several lists."""
    def assign(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            band, x = batch.column("band").to_numpy(), _matrix(batch.column("vector"))
            for b in np.unique(band):
                first, graph = shared.value[int(b)]
                at = np.flatnonzero(band == b)
                r, c = _chosen(_unit(x[at], int(b)), graph.centroids)
                part = batch.select(["vec_id", "vector"]).take(pa.array(at[r]))
                yield pa.RecordBatch.from_arrays([pa.array((first + c).astype(np.int64)), part.column(0), part.column(1)], names=["list", "vec_id", "vector"])
    kind = dict(rows.dtypes)["vector"]
    return rows.select("band", "vec_id", "vector").mapInArrow(assign, f"list long, vec_id long, vector {kind}")


def probes(queries: DataFrame, shared: Shared, ratio: float) -> DataFrame:
    """(list, query, vector): the lists that each query reads."""
    def select(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _queries(_matrix(batch.column("vector")))
            for first, graph in shared.value.values():
                r, c = graph.within(x, ratio, LEAST_LISTS)
                for at in range(0, len(r), BLOCK_ROWS):
                    part = batch.select(["query", "vector"]).take(pa.array(r[at:at + BLOCK_ROWS]))
                    yield pa.RecordBatch.from_arrays([pa.array((first + c[at:at + BLOCK_ROWS]).astype(np.int64)), part.column(0), part.column(1)], names=["list", "query", "vector"])
    kind = dict(queries.dtypes)["vector"]
    return queries.select("query", "vector").mapInArrow(select, f"list long, query string, vector {kind}")


def best_of(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int):
    """(query row, id, score) of the k best of x for each row of q: by score, then by smaller id."""
    out = []
    for at in range(0, len(q), BLOCK_ROWS):
        part = q[at:at + BLOCK_ROWS]
        rough = part @ x.T
        if x.shape[0] > k:
            # the product rounds otherwise than a row by itself does, so what may tie is kept
            slack = 1e-12 * np.sqrt((part * part).sum(axis=1))[:, None] * np.sqrt((x * x).sum(axis=1).max())
            least = np.partition(rough, x.shape[0] - k, axis=1)[:, x.shape[0] - k][:, None]
            r, c = np.nonzero(~(rough < least - slack))
        else:
            r, c = np.nonzero(np.ones(rough.shape, dtype=bool))
        score = (part[r] * x[c]).sum(axis=1) + 0.0
        order = np.lexsort((ids[c], -score, r))
        r, c, score = r[order], c[order], score[order]
        keep = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((at + r[keep], ids[c[keep]], score[keep]))
    return tuple(np.concatenate(o) for o in zip(*out))


def nearest(rows: DataFrame, queries: DataFrame, k: int, ratio: float = RATIO) -> DataFrame:
    """(query_id, rank, vec_id, score): for each of ``queries``, the k rows of ``rows``
    (both as ``vectors`` gives them) of largest inner product that the index finds, without the query's own id."""
    spark = rows.sparkSession
    by_id = Window.partitionBy("vector").orderBy("vec_id")
    kept = materialise(rows.withColumn("_r", F.row_number().over(by_id)).where(F.col("_r") <= k + 1).drop("_r"), "indexed")
    graphs = fit(kept)
    if not graphs:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    shared = Shared(spark, graphs)
    lists = materialise(postings(kept, shared), "postings")
    name = F.sha2(F.encode(F.array_join(F.col("vector").cast("array<string>"), ","), "UTF-8"), 256)
    asked = materialise(queries.select(F.col("vec_id").alias("query_id"), name.alias("query"), "vector"), "queries")
    # few bytes, much work: a stated number of partitions is not merged into one
    distinct = asked.groupBy("query").agg(F.first("vector").alias("vector")).repartition(max(8, spark.sparkContext.defaultParallelism))
    reads = materialise(probes(distinct, shared, ratio), "probes")
    shared.data.unpersist()

    # one unit of work is a block of a list and a chunk of the queries that read it; at most MAX_LISTS sizes, and one a band
    blocks = lists.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_blocks"))
    chunks = reads.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("_chunks"))
    sizes = F.broadcast(materialise(blocks.join(chunks, "list"), "list-sizes"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    left = lists.join(sizes, "list").select("list", part("vec_id", "_blocks").alias("block"), every("_chunks").alias("chunk"), "vec_id", "vector")
    right = reads.join(sizes, "list").select("list", every("_blocks").alias("block"), part("query", "_chunks").alias("chunk"), "query", "vector")

    def score(_, x, q):
        if not x.num_rows or not q.num_rows:
            return pa.table({"query": pa.array([], pa.string()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        r, ids, value = best_of(_matrix(q["vector"]), _matrix(x["vector"]), x["vec_id"].to_numpy(), k + 1)
        return pa.table({"query": q["query"].take(pa.array(r)), "vec_id": pa.array(ids), "score": pa.array(value)})

    unit = ["list", "block", "chunk"]
    found = left.groupBy(*unit).cogroup(right.groupBy(*unit)).applyInArrow(score, "query string, vec_id long, score double")
    found = found.groupBy("query", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    hits = F.transform(F.array_sort(F.collect_list(F.struct("_r", "vec_id", "score"))), lambda h: F.struct(h["vec_id"].alias("vec_id"), h["score"].alias("score")))
    top = materialise(top.groupBy("query").agg(hits.alias("_hits")), "found")
    # many equal queries share one answer: both sides are salted
    salted = top.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    mine = asked.select("query_id", "query", F.pmod(F.xxhash64("query_id"), F.lit(SALTS)).alias("_salt")).join(salted, ["query", "_salt"])
    mine = mine.select("query_id", F.posexplode(F.slice(F.filter("_hits", lambda h: h["vec_id"] != F.col("query_id")), 1, k)).alias("_at", "_hit"))
    return mine.select("query_id", (F.col("_at") + 1).cast("int").alias("rank"), F.col("_hit.vec_id").alias("vec_id"), F.col("_hit.score").alias("score"))


def recall(rows: DataFrame, queries: DataFrame, found: DataFrame, k: int) -> float:
    """The share of the k nearest that was found, by score, for a set of queries small enough
    to be broadcast, against all rows in blocks."""
    asked = queries.select("vec_id", "vector").toArrow()
    q, own = _matrix(asked["vector"]), asked["vec_id"].to_numpy()
    shared = Shared(rows.sparkSession, (q, own))

    def scan(batches):
        q, own = shared.value
        for batch in batches:
            if not batch.num_rows:
                continue
            r, ids, value = best_of(q, _matrix(batch.column("vector")), batch.column("vec_id").to_numpy(), k + 1)
            other = ids != own[r]
            yield pa.RecordBatch.from_arrays([pa.array(own[r][other]), pa.array(ids[other]), pa.array(value[other])], names=["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    true = (rows.select("vec_id", "vector").mapInArrow(scan, "query_id long, vec_id long, score double")
            .withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    met = true.join(found.select("query_id", F.col("vec_id").alias("vec_id"), F.lit(1).alias("_hit")), ["query_id", "vec_id"], "left")
    row = met.agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit")).first()
    return row["hit"] / row["n"] if row["n"] else 1.0
