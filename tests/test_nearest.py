"""Nearest neighbours, density clusters and quantiles against brute force."""

import math
import struct
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import aggregates as A
from tessera.operators import density, modes, nearest, quantiles, stages
from tessera.operators import learning as M
from tessera.operators import neighbours as N
from tessera.operators import reshape as H
from tessera.operators import statistics as T


def frame(spark, x, names="xyzw"):
    rows = [(i, *(float(v) for v in r)) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "k long, " + ", ".join(f"{names[c]} double" for c in range(x.shape[1])))


def squares(x, y):
    d = np.zeros((len(x), len(y)))
    for c in range(x.shape[1]):
        d += (x[:, c, None] - y[None, :, c]) ** 2
    return d


def points(kind, n, dims, seed=1):
    rng = np.random.default_rng(seed)
    if kind == "grid":  # many equal distances and positions
        return rng.integers(0, 6, (n, dims)).astype(float)
    if kind == "clumps":
        return np.vstack([rng.normal(c, s, (n // 3, dims)) for c, s in ((0, 0.01), (5, 1.0), (100, 30.0))])
    return np.vstack([np.zeros((n // 3, dims)), rng.normal(0, 1, (n - n // 3, dims))])  # one position holds a third


# --- nearest neighbours ------------------------------------------------------------
@pytest.mark.parametrize(("kind", "dims", "k"), [("copies", 1, 3), ("grid", 2, 5), ("clumps", 4, 1)])
def test_nearest_equals_brute_force(spark, kind, dims, k):
    at, asked = points(kind, 300, dims), points("clumps", 90, dims, 2)
    names = list("xyzw"[:dims])
    got = defaultdict(list)
    for r in nearest.nearest(frame(spark, asked), frame(spark, at), names, ["k"], k, region=40).collect():
        got[tuple(r.q)].append((r["rank"], r.k, r.d))
    d = squares(asked, at)
    for i, q in enumerate(asked):
        want = [(n + 1, int(j), d[i, j]) for n, j in enumerate(sorted(range(len(at)), key=lambda j: (d[i, j], j))[:k])]
        assert sorted(got[tuple(q)]) == want


def test_nearest_of_odd_rows(spark):
    schema = "k long, x double, y double"
    some = spark.createDataFrame([(1, 0.0, -0.0), (2, math.nan, 1.0), (3, None, 1.0), (4, math.inf, 0.0), (5, 1.0, 1.0), (5, 1.0, 1.0)], schema)
    got = nearest.nearest(some, some, ["x", "y"], ["k"], 9).orderBy("q", "rank").collect()
    assert [(r.q, r.k, r.d, r["rank"]) for r in got] == [([0, 0], 1, 0, 1), ([0, 0], 5, 2, 2), ([0, 0], 5, 2, 3), ([1, 1], 5, 0, 1), ([1, 1], 5, 0, 2), ([1, 1], 1, 2, 3)]
    assert nearest.nearest(some, some.limit(0), ["x"], ["k"], 2).count() == 0
    assert nearest.nearest(some.limit(0), some, ["x"], ["k"], 2).count() == 0


def test_comparisons_grow_in_proportion(spark):
    def compared(n):
        x = np.random.default_rng(3).uniform(0, 1, (n, 2))
        found = nearest.nearest(frame(spark, x), frame(spark, x), ["x", "y"], ["k"], 5, region=512)
        return found.where("rank = 1").agg(F.sum("compared")).first()[0]

    small, large = compared(1000), compared(8000)
    assert large < 8 * 2 * small and large < 0.2 * 8000 * 8000


def test_search_of_a_task_equals_brute_force():
    rng = np.random.default_rng(4)
    at, asked = rng.integers(0, 9, (700, 3)).astype(float), rng.normal(4, 3, (120, 3))
    best, place, compared = nearest.search(at, asked, np.full(120, 30.0), 4, leaf=16)
    d = squares(asked, at)
    for i in range(120):
        want = sorted((d[i, j], j) for j in range(700) if d[i, j] <= 30)[:4]
        assert [(b, p) for b, p in zip(best[i], place[i], strict=True) if p < 700] == want
    assert compared.sum() < 120 * 700 / 2


def test_imputation_search_over_k_equals_single_searches(spark):
    rows = [(i, float(i * 7 % 31), float(i % 5)) for i in range(120)]
    df = spark.createDataFrame(rows, "k long, x double, y double")
    got = {r.k: (r.mse, r.best) for r in N.imputation_k_scores(df, "x", ["y"], "k", (1, 4)).collect()}
    base = N._hidden(df, "x", "k", 0.1, 1)
    for k in (1, 4):
        assert abs(got[k][0] - N._error(N.knn_imputed(base, ["x", "y"], "k", k), "x").first().mse) < 1e-9
    assert sum(b for _, b in got.values()) == 1


def test_knn_classes_equal_brute_force(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(0, 1, (200, 4))
    df = frame(spark, x).withColumn("label", (F.col("x") > 0).cast("string"))
    got = {r.k: r.predicted for r in N.knn_classified(df, df, list("xyzw"), "label", "k", 5).collect()}
    d = squares(x, x)
    for i in range(200):
        near = np.argsort(d[i], kind="stable")[:5]
        assert got[i] == ("true" if (x[near, 0] > 0).sum() > 2 else "false")


# --- local outlier factor, label spreading -------------------------------------------
def plain_graph(x, k):
    d = squares(x, x)
    return {i: sorted((d[i, j], j) for j in range(len(x)) if j != i)[:k] for i in range(len(x))}


@pytest.mark.parametrize("kind", ["clumps", "copies"])
def test_outlier_factors_equal_brute_force(spark, kind):
    x, k = points(kind, 150, 2), 4
    graph = plain_graph(x, k)
    reach = {i: math.sqrt(g[-1][0]) for i, g in graph.items()}
    density_ = {i: 1 / (np.mean([max(reach[j], math.sqrt(d)) for d, j in g]) + 1e-10) for i, g in graph.items()}
    got = {r.k: r.factor for r in nearest.outlier_factors(frame(spark, x), "k", ["x", "y"], k).collect()}
    for i, g in graph.items():
        assert math.isclose(got[i], np.mean([density_[j] for _, j in g]) / density_[i], rel_tol=1e-6)


def test_labels_spread_as_the_dense_solution(spark):
    x, k, keep = points("clumps", 90, 2, 6), 4, 0.5
    w = np.zeros((len(x), len(x)))
    for i, g in plain_graph(x, k).items():
        for _, j in g:
            w[i, j] = w[j, i] = 1
    s = w / np.sqrt(np.outer(w.sum(axis=1), w.sum(axis=1)))
    told = {i: "ab"[int(x[i, 0] > 2)] for i in range(0, len(x), 9)}
    first = np.array([[float(told.get(i) == c) for c in "ab"] for i in range(len(x))])
    solved = np.linalg.solve(np.eye(len(x)) - keep * s, (1 - keep) * first)
    df = frame(spark, x).withColumn("l", F.when(F.col("k") % 9 == 0, F.when(F.col("x") > 2, "b").otherwise("a")))
    got = {r.k: r.spread for r in N.labels_spread(df, "k", ["x", "y"], "l", k, keep, tolerance=1e-4).collect()}
    for i, row in enumerate(solved):
        if abs(row[0] - row[1]) > 1e-3:
            assert got[i] == told.get(i, "ab"[int(row.argmax())])
        elif row.max() == 0:
            assert got[i] is None


# --- density clusters ------------------------------------------------------------------
def plain_clusters(x, eps, least):
    d = squares(x, x) <= eps * eps
    core = d.sum(axis=1) >= least
    label = {i: i for i in range(len(x)) if core[i]}
    changed = True
    while changed:
        changed = False
        for i in label:
            low = min(label[j] for j in label if d[i, j])
            changed |= low < label[i]
            label[i] = min(label[i], low)
    border = {i: min((label[j] for j in label if d[i, j]), default=None) for i in range(len(x)) if not core[i]}
    return {i: (bool(core[i]), label.get(i, border.get(i))) for i in range(len(x))}


@pytest.mark.parametrize(("kind", "eps", "least", "dims"), [("grid", 1.0, 12, 2), ("clumps", 0.8, 4, 2), ("clumps", 8.0, 3, 3), ("copies", 0.35, 5, 2), ("copies", 1e-3, 2, 1)])
def test_density_clusters_equal_brute_force(spark, kind, eps, least, dims):
    x = points(kind, 150, dims, 7)
    got = {r.k: (r.core, r.cluster) for r in density.density_clusters(frame(spark, x), "k", list("xyz"[:dims]), eps, least).collect()}
    assert got == plain_clusters(x, eps, least)


def test_a_dense_cell_makes_no_pairs(spark):
    """4,000 rows in two cells just within reach of each other: their pairs are 16 million."""
    rng = np.random.default_rng(9)
    x = np.vstack([rng.uniform(0, 0.5, (2000, 2)), rng.uniform(0, 0.5, (2000, 2)) + [1.2, 0]])
    got = density.density_clusters(frame(spark, x), "k", ["x", "y"], 1.0, 5)
    assert [tuple(r) for r in got.groupBy("core", "cluster").count().collect()] == [(True, 0, 4000)]
    apart = density.density_clusters(frame(spark, x + np.where(np.arange(4000) < 2000, 0, 0.51)[:, None] * [1, 0]), "k", ["x", "y"], 1.0, 5)
    assert sorted(tuple(r) for r in apart.groupBy("core", "cluster").count().collect()) == [(True, 0, 2000), (True, 2000, 2000)]


def test_density_clusters_of_odd_rows(spark):
    schema = "k long, x double, y double"
    odd = spark.createDataFrame([(1, 0.0, -0.0), (2, math.nan, 1.0), (3, None, 1.0), (4, math.inf, 0.0), (5, 0.0, 0.0)], schema)
    got = {r.k: (r.core, r.cluster) for r in density.density_clusters(odd, "k", ["x", "y"], 1.0, 2).collect()}
    assert got == {1: (True, 1), 2: (False, None), 3: (False, None), 4: (False, None), 5: (True, 1)}
    assert density.density_clusters(odd.limit(0), "k", ["x", "y"], 1.0, 2).count() == 0


def test_components(spark):
    nodes = spark.createDataFrame([(i,) for i in [*range(40), 7]], "node long")
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(30, 25), (25, 30), (33, 33)], "a long, b long")
    got = {r.node: r.label for r in stages.connected(nodes, links).collect()}
    assert got == {i: 0 if i <= 20 else 25 if i == 30 else i for i in range(40)}
    assert stages.connected(nodes, links.limit(0)).where("node <> label").count() == 0


# --- quantiles ---------------------------------------------------------------------------
def test_order_of_bits(spark):
    rng = np.random.default_rng(1)
    values = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308, -1.7976931348623157e308, math.inf, -math.inf, 1.0, -1.0]
    values += [float(v) for p in range(-1074, 1024, 7) for v in (math.ldexp(1, p), np.nextafter(math.ldexp(1, p), 0), np.nextafter(math.ldexp(1, p), math.inf))]
    values += [struct.unpack("<d", rng.bytes(8))[0] for _ in range(3000)]
    values = [v for v in values if not math.isnan(v)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for r in df.select("v", quantiles.ordered_bits(F.col("v")).alias("b")).collect():
        bits = struct.unpack("<q", struct.pack("<d", abs(r.v)))[0]
        assert r.b == (-bits if r.v < 0 else bits), r.v


@pytest.mark.parametrize("few", [0, 50, 1 << 20])
def test_quantiles_equal_sorted_groups(spark, few):
    rng = np.random.default_rng(2)
    values = {"a": [7.5] * 400 + list(rng.normal(0, 1, 200)), "b": list(10.0 ** rng.uniform(-300, 300, 301) * rng.choice([-1, 1], 301)), "c": [3.0], None: [1.0, 2.0, math.nan], "d": [math.nan]}
    rows = [(g, float(v)) for g, vs in values.items() for v in vs] + [("d", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    wanted = [0.0, 0.25, 0.5, 0.9, 1.0]
    got = {r.g: r for r in quantiles.quantiles(df, ["g"], "v", wanted, few=few).collect()}
    assert set(got) == set(values)
    for g, vs in values.items():
        vs = [v for v in vs if not math.isnan(v)]
        assert got[g].n == len(vs)
        for i, p in enumerate(wanted):
            assert got[g][f"q{i}"] is None if not vs else math.isclose(got[g][f"q{i}"], np.quantile(vs, p), rel_tol=1e-9, abs_tol=1e-12)
    everything = [v for vs in values.values() for v in vs if not math.isnan(v)]
    one = quantiles.quantiles(df, [], "v", [0.5], few=few).collect()
    assert len(one) == 1 and one[0].n == len(everything) and math.isclose(one[0].q0, np.quantile(everything, 0.5), rel_tol=1e-12)
    assert quantiles.quantiles(df.limit(0), ["g"], "v", [0.5], few=few).count() == 0


def test_operators_use_selection(spark):
    df = spark.createDataFrame([(i % 3, float(i * 37 % 101)) for i in range(200)], "g long, v double")
    frames = [T.scaled(df, "v", "robust", "s"), T.imputed(df, ["v"], "median"), T.iqr_outliers(df, "v", ["g"]), T.quantile_ranks(df, "v"), T.moments(df, ["g"], "v"), A.many_aggregates(df, ["g"], "v", ["median", "mean"]), A.named_aggregates(df, F.col("g"), "h", ["v"], "median"), A.summary(df, ["v"])]
    for f in frames:
        plan = f._jdf.queryExecution().toString().lower()
        assert f.count() and "percentile" not in plan and "median(" not in plan
    want = {g: float(np.median([v for h, v in ((i % 3, i * 37 % 101) for i in range(200)) if h == g])) for g in range(3)}
    assert {r.g: r.median_v for r in frames[5].collect()} == want == {r.h: r.median_v for r in frames[6].collect()}


def test_quantile_ranks_equal_brute_force(spark):
    values = [float(v) for v in np.random.default_rng(5).normal(0, 2, 150).round(1)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v double")
    marks = np.quantile(values, [i / 99 for i in range(100)])
    for r in T.quantile_ranks(df, "v").collect():
        below = int((marks <= r.v + 1e-12).sum())
        low = (below - 1) / 99
        assert low - 1e-9 <= r.v_rank <= low + 1 / 99 + 1e-9


def test_label_codes_over_ranges(spark):
    values = [f"v{i * 7 % 50:02d}" for i in range(300)] + [None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k long, v string")
    at = {v: i for i, v in enumerate(sorted({v for v in values if v}))}
    assert {r.k: r.code for r in H.label_encoded(df, "v", "code").collect()} == {i: at.get(v, -1) for i, v in enumerate(values)}


# --- mean shift, loadings -----------------------------------------------------------------
def plain_modes(x, h):
    seeds = {tuple(np.rint(r / h)) for r in x}
    rest = []
    for bin_ in seeds:
        at = np.array(bin_) * h
        while True:
            near = x[((x - at) ** 2).sum(axis=1) <= h * h]
            if not len(near):
                break
            before, at = at, near.mean(axis=0)
            if ((at - before) ** 2).sum() <= (1e-3 * h) ** 2:
                rest.append((len(near), ",".join(str(v) for v in bin_), at))
                break
    kept = []
    for n, _, at in sorted(rest, key=lambda r: (-r[0], r[1])):
        if all(((at - k) ** 2).sum() > h * h for _, k in kept):
            kept.append((n, at))
    return kept


@pytest.mark.parametrize("kind", ["copies", "clumps"])
def test_modes_equal_brute_force(spark, kind):
    x, h = points(kind, 120, 2, 11), 1.5
    kept = plain_modes(x, h)
    got = {r.k: r for r in modes.mean_shift(frame(spark, x), "k", ["x", "y"], h).collect()}
    for i, p in enumerate(x):
        n, at = min(kept, key=lambda k: ((k[1] - p) ** 2).sum())
        assert got[i].mode_size == n and np.allclose(got[i].mode, at, atol=1e-6)
    odd = spark.createDataFrame([(1, None, 1.0), (2, math.nan, 1.0)], "k long, x double, y double")
    assert [r.mode for r in modes.mean_shift(odd, "k", ["x", "y"], h).collect()] == [None, None]


def test_loadings_are_the_covariance_vectors(spark):
    x = np.random.default_rng(3).normal(0, 1, (200, 3)) * [5, 1, 0.2] + np.array([1, 2, 3])
    df = M.vectors(spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "k long, e array<double>"), "e")
    values, vectors = np.linalg.eigh(np.cov(x.T))
    got = {(r.component, r.feature): r.loading for r in M.loadings(df, 2).collect()}
    for c in range(2):
        want = vectors[:, -1 - c]
        assert np.allclose(np.abs([got[c, f] for f in range(3)]), np.abs(want), atol=1e-6)


def test_quantiles_of_few_groups_do_not_shuffle_rows_by_them(spark):
    """No plan joins the rows with ranks or bounds by a shuffle of few keys."""
    df = spark.range(20_000).select((F.col("id") % 3).alias("g"), (F.col("id") * 7919 % 20_011).cast("double").alias("v"))
    plan = T.iqr_outliers(df, "v", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
