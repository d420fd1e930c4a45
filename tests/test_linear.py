"""The linear fit against numpy, the paired comparison against a plain loop, and customer-level profiles."""

import hashlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from marginkit import schema as S
from marginkit.operators import linear
from marginkit.operators.evaluate import BOOTSTRAP_BUCKETS, BOOTSTRAP_DRAWS, smape_paired
from marginkit.operators.quality import profile_flags
from marginkit.operators.score import LINEAR_TERMS, score_linear

SCHEMA = ("consumer_id long, Freq_purchase string, avg_imputed_contribution_margin double, AVERAGE_TIME_TO_PURCHASE string, "
          "avg_vehicle_age double, lease_purchase_flag string, Latest_CM double, term string")


def _rows(n, seed=5):
    rng = np.random.default_rng(seed)
    pick = {c: [*names, None, "else"] for c, names in LINEAR_TERMS.items()}
    rows = []
    for i in range(n):
        freq, rec, lease = (pick[c][rng.integers(len(pick[c]))] for c in LINEAR_TERMS)
        m = None if rng.random() < 0.1 else round(float(rng.normal(20000, 9000)), 2)
        a = None if rng.random() < 0.2 else (float("nan") if rng.random() < 0.05 else round(float(rng.uniform(0, 20)), 4))
        y = None if rng.random() < 0.05 else round(0.6 * (m or 9000) + 700 * (freq == "Two") + float(rng.normal(0, 500)), 2)
        rows.append((i, freq, m, rec, a, lease, y, "clash"))
    return rows


def _design(rows):
    x, y = [], []
    for _, freq, m, rec, a, lease, target, _ in rows:
        if target is None:
            continue
        gone = a is None or a != a
        bands = [float(v == n) for (c, names), v in zip(LINEAR_TERMS.items(), (freq, rec, lease)) for n in names]
        x.append([1.0, m or 0.0, 0.0 if gone else a, float(m is None), float(gone), *bands])
        y.append(target)
    return np.array(x), np.array(y)


@pytest.mark.parametrize("parts", [1, 13])
def test_fit_equals_numpy(spark, parts):
    rows = _rows(3000)
    df = spark.createDataFrame(rows, SCHEMA).repartition(parts)
    x, y = _design(rows)
    g = x.T @ x
    g[np.arange(1, 15), np.arange(1, 15)] *= 1.001
    want = np.linalg.solve(g, x.T @ y)
    totals = {(r.row_term, r.column_term): int(r.total) for r in linear.gram(df).collect()}
    assert totals["intercept", "intercept"] == len(y)
    fitted = linear.solve_ridge(totals)
    got = np.array([fitted[t] for t in linear.TERMS])
    assert np.allclose(got, want, rtol=0, atol=np.where(np.arange(15) == 1, 1e-8, 1e-4))
    unrounded = np.linalg.solve(g, x.T @ y)
    assert np.max(np.abs(x @ got - x @ unrounded)) < 0.005
    # applied by the linear scorer
    scored = {r[0]: r[1] for r in score_linear(df, linear.fit_linear(df)).collect()}
    ids = [r[0] for r in rows if r[6] is not None and not (r[4] is not None and r[4] != r[4])]
    at = {r[0]: i for i, r in enumerate(r for r in rows if r[6] is not None)}
    assert max(abs(scored[i] - (x @ unrounded)[at[i]]) for i in ids) < 0.05


def test_exact_solution_within_1e_9_of_numpy(monkeypatch, spark):
    monkeypatch.setattr(linear, "digits", lambda term: 14)
    rows = _rows(500, 8)
    x, y = _design(rows)
    g = x.T @ x
    g[np.arange(1, 15), np.arange(1, 15)] *= 1.001
    fitted = linear.solve_ridge({(r.row_term, r.column_term): int(r.total)
                                 for r in linear.gram(spark.createDataFrame(rows, SCHEMA)).collect()})
    scale = np.sqrt(np.diag(g))   # numpy solves the scaled system, which is better conditioned
    want = np.linalg.solve(g / np.outer(scale, scale), x.T @ y / scale) / scale
    got = np.array([fitted[t] for t in linear.TERMS])
    assert np.max(np.abs((x @ got - x @ want) / np.maximum(np.abs(x @ want), 1))) < 1e-9


def test_fit_edge_cases(spark):
    empty = linear.fit_linear(spark.createDataFrame([], SCHEMA)).collect()
    assert len(empty) == len(linear.TERMS) == 15 and all(r.weight == 0 for r in empty)
    rows = _rows(40)
    once, twice = (linear.gram(spark.createDataFrame(r, SCHEMA)) for r in (rows, rows + rows))
    once, twice = ({(r.row_term, r.column_term): int(r.total) for r in g.collect()} for g in (once, twice))
    assert twice == {k: 2 * v for k, v in once.items()}
    assert linear.solve_ridge(once) == linear.solve_ridge(twice)
    one = [(1, "One", None, None, None, None, 100.0, "x")] * 3
    w = {r.term: r.weight for r in linear.fit_linear(spark.createDataFrame(one, SCHEMA)).collect()}
    assert abs(w["intercept"] + w["Freq_purchase=One"] + sum(v for t, v in w.items() if "missing" in t) - 100) < 0.1
    big = [(i, "One", 9e12, "x", 20.0, "Zero", 9e12, "x") for i in range(50)]   # beyond a long
    assert {int(r.total) for r in linear.gram(spark.createDataFrame(big, SCHEMA)).collect()} >= {50 * (9 * 10 ** 14) ** 2}


def test_fit_groups_before_it_shuffles(spark):
    plan = linear.gram(spark.createDataFrame(_rows(50), SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan
    head = plan.split("Exchange")
    assert all("partial_sum" in part or "partial_count" in part for part in head[1:] if "HashAggregate" in part)


def _smape(p, a):
    return 0.0 if abs(p) + abs(a) == 0 else 2 * abs(p - a) / (abs(p) + abs(a))


def _h(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def test_paired_comparison_equals_a_plain_loop(spark):
    rng = np.random.default_rng(3)
    rows = [(i, *(None if rng.random() < 0.1 else float(round(v, 2)) for v in rng.normal(100, 60, 3)),
             0.0 if i % 50 == 0 else float(rng.normal(100, 40))) for i in range(2000)]
    df = spark.createDataFrame(rows, "consumer_id long, a double, b double, base double, Latest_CM double")
    got = {r.model: r for r in smape_paired(df, ["a", "b"], "base").collect()}
    for k, m in ((1, "a"), (2, "b")):
        pairs = [(r[0], _smape(r[k], r[4]), _smape(r[3], r[4])) for r in rows if r[k] is not None and r[3] is not None]
        assert got[m].customers == len(pairs)
        assert got[m].smape == pytest.approx(np.mean([p[1] for p in pairs]), abs=2e-9)
        assert got[m].difference == pytest.approx(np.mean([p[1] - p[2] for p in pairs]), abs=2e-9)
        n, d = np.zeros(BOOTSTRAP_BUCKETS), np.zeros(BOOTSTRAP_BUCKETS)
        for key, t, u in pairs:
            n[_h(str(key)) % BOOTSTRAP_BUCKETS] += 1
            d[_h(str(key)) % BOOTSTRAP_BUCKETS] += t - u
        means = []
        cumulative = np.cumsum([np.exp(-1) / f for f in (1, 1, 2, 6, 24, 120, 720)])
        for draw in range(1, BOOTSTRAP_DRAWS + 1):
            w = np.array([np.searchsorted(cumulative, _h(f"{draw}:{b}") / 2 ** 32, side="right") for b in range(BOOTSTRAP_BUCKETS)])
            means.append((w @ d) / (w @ n))
        assert (got[m].low, got[m].high) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])), abs=5e-9)
        assert got[m].low < got[m].difference < got[m].high


def test_paired_comparison_without_rows(spark):
    df = spark.createDataFrame([(1, None, 2.0, 3.0)], "consumer_id long, a double, base double, Latest_CM double")
    r = smape_paired(df, ["a"], "base").first()
    assert (r.customers, r.smape, r.low) == (0, None, None)
    assert smape_paired(df.where("false"), ["a"], "base").count() == 0


def test_profile_of_customers_with_a_hot_customer(spark):
    n = 60_000
    rows = spark.range(n).select(
        F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 1000 == 1, F.lit(None)).otherwise(F.col("id") % 500 + 100).cast("long").alias(S.CUSTOMER),
        F.when(F.col("id") % 7 == 0, 0).otherwise(F.col("id")).cast("decimal(18,2)").alias(S.MARGIN))
    there = spark.createDataFrame([(7,), (7,), (150,), (None,)], f"{S.CUSTOMER} long")
    out = profile_flags(rows, {"all": (F.lit(True), F.col(S.MARGIN)), "some": (F.col(S.MARGIN) > 10, F.col(S.MARGIN))},
                        of_customers={"again": ("some", there), "again_all": ("all", there)})
    got = {r.stage: (r.n_rows, r.n_customers, r.n_zero_margin) for r in out.collect()}
    keep = rows.where(F.col(S.CUSTOMER).isin(7, 150))
    want = keep.agg(F.count("*"), F.countDistinct(S.CUSTOMER), F.count_if(F.col(S.MARGIN) == 0)).first()
    assert got["again_all"] == tuple(want) and got["all"][0] == n
    some = keep.where(F.col(S.MARGIN) > 10)
    assert got["again"] == (some.count(), 2, 0)
    # rows are reduced to customers below the join
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    left = plan[plan.index("Join LeftOuter"):]
    assert left.index("Aggregate") < left.index("Range")
