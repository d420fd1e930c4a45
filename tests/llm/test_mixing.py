import hashlib

from pyspark.sql import functions as F

from marginkit.llm import mixing
from helpers import DOCS, prose, rows, words


def brute(docs, weights=(3, 1, 2), share=1.5, passes=2):
    sized = [(d, s, len(words(t))) for d, t, s in docs]
    sources = sorted({s for _, s, _ in sized}, key=lambda s: (s is None, s or ""))
    size = {s: sum(n for _, x, n in sized if x == s) for s in sources}
    w = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    budget = share * sum(size.values())
    capped = set()
    while True:
        free = [s for s in sources if s not in capped]
        level = (budget - sum(passes * size[s] for s in capped)) / sum(w[s] for s in free) if free else 0
        more = {s for s in free if passes * size[s] <= level * w[s]}
        if not more:
            break
        capped |= more
    target = {s: float(passes * size[s]) if s in capped else level * w[s] for s in sources}
    order = lambda d: hashlib.md5(f"mix:{'null' if d is None else d}".encode()).hexdigest()
    copies, run = [], dict.fromkeys(sources, 0)
    for i, (d, s, n) in sorted(enumerate(sized), key=lambda x: (order(x[1][0]), x[1][0] or -1, x[1][2])):
        run[s] += n
        copies += [((run[s] + p * size[s]) / target[s], order(d), d or -1, n, p, i) for p in range(passes) if n and target[s]]
    taken, used = [0] * len(sized), 0
    for c in sorted(copies):
        used += c[3]
        if used > budget:
            break
        taken[c[5]] += c[3]
    return [dict(doc_id=d, size=n, source_size=size[s], target=target[s], taken=t) for (d, s, n), t in zip(sized, taken)]


def make(spark, n=300):
    docs = [(i, prose(i, 5 + i * 7 % 90), ["big", "b", None, "c"][0 if i % 3 == 0 else i % 4]) for i in range(n)]
    docs += [(n, None, "b"), (n + 1, "", "only"), (n + 2, " \t", "c"), (n + 3, prose(9, 4000), "tiny")]
    return docs, spark.createDataFrame([(d, t, "en", s, 1) for d, t, s in docs], DOCS)


def test_equals_brute_force_whatever_the_pieces(spark, monkeypatch):
    docs, df = make(spark)
    want = sorted(brute(docs), key=lambda r: r["doc_id"])
    for piece, exact, cells in ((50_000, 100_000, 1024), (7, 5, 8)):
        monkeypatch.setattr(mixing, "PIECE_ROWS", piece)
        monkeypatch.setattr(mixing, "EXACT_ROWS", exact)
        monkeypatch.setattr(mixing, "CELLS", cells)
        got = rows(mixing.mix(df.repartition(3)), ["doc_id"])
        assert [{k: r[k] for k in want[0]} for r in got] == want
        assert all(r["taken"] <= 2 * r["size"] for r in got)


def test_documents_of_the_mix(spark):
    docs, df = make(spark)
    extra = df.withColumn("size", F.lit("x")).withColumn("_order", F.lit(1))
    out = mixing.mixed_documents(extra.unionByName(extra.where("doc_id = 5")))
    assert out.columns == [*extra.columns, "copies"]
    got = rows(out.groupBy("doc_id").agg(F.sum("copies").alias("n"), F.count("*").alias("rows")), ["doc_id"])
    assert {r["doc_id"] for r in got} <= {d for d, t, _ in docs if words(t)}
    assert all(1 <= r["n"] <= 2 * (2 if r["doc_id"] == 5 else 1) for r in got)


def test_repeated_rows_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c", "en", "s", 1)] * 3 + [(7, "d e", "en", None, 1)] * 4, DOCS)
    got = mixing.mix(df).collect()
    assert len(got) == 7 and all(r.taken <= 2 * r.size for r in got)
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed_documents(df.limit(0)).count() == 0
    nothing = df.withColumn("text", F.lit(None).cast("string"))
    assert {r.taken for r in mixing.mix(nothing).collect()} == {0}
