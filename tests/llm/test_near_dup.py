from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginkit.llm import near_dup
from marginkit.llm.bagminhash import signatures
from marginkit.llm.components import components
from helpers import DOCS, folded, prose


def runs(text):
    w = folded(text)
    return Counter(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def classes(texts, similar=0.8):
    bags, parent = [runs(t) for t in texts], list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, a in enumerate(bags):
        for j in range(i):
            low = sum((a & bags[j]).values())
            if a and bags[j] and low >= similar * sum((a | bags[j]).values()):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(texts))]


def edited(text, k, at):
    w = text.split(" ")
    return " ".join(w[:at] + [f"new{k}"] + w[at + 1:])


BASE = prose(1, 120)
CHAIN = [" ".join((prose(7, 300).split(" "))[i * 8:i * 8 + 150]) for i in range(10)]
TEXTS = ([BASE, BASE.upper(), BASE.replace(" ", "\n"), None, "", " \n", "one", "one", "one two", prose(2, 4), prose(2, 4) + " "]
         + [edited(BASE, k, 10 + k) for k in range(40)] + CHAIN + [prose(50 + k, 30) for k in range(20)]
         + ["shared head of many documents with the same words here " * 2 + prose(90 + k, 25) for k in range(25)]
         + ["spam " * 50, "spam " * 60, "spam " * 70, prose(3, 3000), edited(prose(3, 3000), 1, 500)])


@pytest.mark.parametrize("hubs,sketch", [(16, 1 << 20), (1, 64), (1, 1 << 20)])
def test_classes_equal_brute_force(spark, monkeypatch, hubs, sketch):
    monkeypatch.setattr(near_dup, "HUBS", hubs)
    monkeypatch.setattr(near_dup, "SKETCH", sketch)
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)], DOCS).repartition(5)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df.withColumnRenamed("lang", "digest")).collect()}
    assert got == dict(enumerate(classes(TEXTS)))


def test_prefix_pairs_hold_all_similar_pairs(spark):
    texts = [edited(edited(BASE, k, 5 + k % 90), -k, 100 - k % 30) for k in range(60)] + CHAIN + ["spam " * 50, "spam " * 60]
    df = spark.createDataFrame([(bytes([i]), t, bytes([i]), sum(runs(t).values())) for i, t in enumerate(texts)], "digest binary, text string, label binary, n long")
    got = {(r.a[0], r.b[0]) for r in near_dup._prefix_pairs(df.select("digest", "text"), df.select("digest", "n", "label"), 0.8).collect()}
    bags = [runs(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert want <= got and len(want) > 20


@pytest.mark.parametrize("window,cut", [(32, 1 << 16), (1, 7)])
def test_prefixes_of_long_texts_stay_linear(spark, monkeypatch, window, cut):
    seen, write = [], near_dup.materialise
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    monkeypatch.setattr(near_dup, "WINDOW", window, raising=False)
    monkeypatch.setattr(near_dup, "SLICE", cut, raising=False)
    common = " ".join(f"c{i}" for i in range(2000))
    long = [common + " " + " ".join(f"o{k}-{i}" for i in range(900)) for k in range(4)]
    texts = long + [edited(edited(long[0], 1, 300), 2, 2500), " ".join(long[1].split(" ")[50:])] + [" ".join(long[2].split(" ")[k:k + 40]) for k in range(5)]
    df = spark.createDataFrame([(bytes([i]), t, bytes([i]), sum(runs(t).values())) for i, t in enumerate(texts)], "digest binary, text string, label binary, n long")
    got = {(r.a[0], r.b[0]) for r in near_dup._prefix_pairs(df.select("digest", "text"), df.select("digest", "n", "label"), 0.8).collect()}
    bags = [runs(t) for t in texts]
    want = {(i, j) for j in range(len(texts)) for i in range(j) if sum((bags[i] & bags[j]).values()) >= 0.8 * sum((bags[i] | bags[j]).values())}
    assert want <= got and {(0, 4), (1, 5)} <= want
    heads = next(df for name, df in seen if name == "prefixes")
    assert heads.count() > 500 and heads.agg(F.max(F.size("before"))).first()[0] == window


def test_buckets_of_a_group_do_not_repeat_pairs(spark, monkeypatch):
    """Texts of one group share many buckets; each pair is made and compared once."""
    seen, write = [], near_dup.materialise
    monkeypatch.setattr(near_dup, "materialise", lambda df, name: seen.append((name, write(df, name))) or seen[-1][1])
    base = prose(5, 200).split(" ")
    texts = [" ".join(f"{w}{k}" if i % 31 == k % 31 and i < 100 + k else w for i, w in enumerate(base)) for k in range(60)]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(df).collect()}
    assert got == dict(enumerate(classes(texts)))
    pairs = [{(bytes(r.a), bytes(r.b)) for r in df.collect()} for name, df in seen if name == "pairs"]
    members = next(df for name, df in seen if name == "members")
    assert members.count() > 5 * len(texts) and len(pairs) > 1 and all(pairs[:2]) and not pairs[0] & pairs[1]


def test_copies_collapse_before_the_join(spark):
    rows = [("a", "copy")] * 300 + [("b", "other"), ("c", "copy of b")]
    df = spark.createDataFrame([(x.encode(), t) for x, t in rows], "digest binary, text string").repartition(3)
    assert {(bytes(r.digest), r.text) for r in near_dup._once_per_task(df).collect()} == {(x.encode(), t) for x, t in rows}
    assert near_dup._once_per_task(df).count() <= 9 and near_dup._once_per_task(df.limit(0)).count() == 0


def test_signatures_are_unbiased():
    rng = np.random.default_rng(5)
    for low, high in ((1, 2), (1, 12), (50, 900)):
        a = rng.integers(low, high, 200)
        b = np.maximum(a + rng.integers(-max(1, low // 4), max(2, high // 5), 200), 0)
        a[:20], b[20:40] = 0, 0
        element = rng.integers(1, 1 << 62, 200).astype(np.uint64)
        doc = np.repeat([0, 1], 200)
        weight = np.concatenate([a, b])
        keep = weight > 0
        s = signatures(doc[keep], np.tile(element, 2)[keep], weight[keep], 3, 4096)
        true = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        assert abs((s[0] == s[1]).mean() - true) < 4 * (true * (1 - true) / 4096) ** 0.5 + 1e-9
        assert len(np.unique(s[2])) == 1


def test_one_document_of_each_class_stays(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows + [rows[0], rows[0], rows[60]] + [(None, BASE + " x y z", "en", "s", 1), (None, "lone text of no id at all", "en", "s", 1)], DOCS)
    out = near_dup.drop_near_duplicates(df)
    assert out.columns == df.columns
    kept = [r.doc_id for r in out.collect()]
    roots = {c for c in classes(TEXTS)}
    assert sorted(x for x in kept if x is not None) == sorted(roots) and kept.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], DOCS)
    assert near_dup.near_duplicates(df).count() == 0 and near_dup.drop_near_duplicates(df).count() == 0


def test_components_of_paths_stars_and_cycles(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 500 + k) for k in range(1, 80)] + [(999, 600 - k) for k in range(5)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7), (3, 2)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long").orderBy(F.rand(3))).collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x
    for a, b in edges:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    assert got == {x: find(x) for x in parent}
