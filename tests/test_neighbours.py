"""Neighbours, density, composite records and the size of plans."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import joins as J
from tessera.operators import learning as M
from tessera.operators import neighbours as N
from tessera.operators import ranking as R
from tessera.operators import records as C
from tessera.operators import statistics as T
from tessera.plans import relational


def points(spark, n=60, seed=3):
    rng = np.random.default_rng(seed)
    xy = np.r_[rng.normal(0, 1, (n // 2, 2)), rng.normal(8, 1, (n - n // 2, 2))]
    return [(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(xy)], "k long, x double, y double")


def test_close_pairs_equal_brute_force(spark):
    rows, df = points(spark)
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 1.0}
    assert {tuple(r) for r in N.close_pairs(df, "k", ["x", "y"], 1.0).collect()} == want


def test_knn_imputation_equals_brute_force(spark):
    rows, df = points(spark)
    holes = df.withColumn("y", F.when(F.col("k") % 7 != 0, F.col("y")))
    known = [r for r in rows if r[0] % 7]
    got = {r.k: r.y for r in N.knn_imputed(holes, ["x", "y"], "k", 3).collect()}
    for k, x, y in rows:
        near = sorted(known, key=lambda r: abs(r[1] - x))[:3]
        assert abs(got[k] - (y if k % 7 else np.mean([r[2] for r in near]))) < 1e-9


def brute_imputed(rows, k):
    """rows: (key, x, y, z) with None; the k nearest complete rows by (distance, key)."""
    known = [r for r in rows if None not in r[1:]]
    out = {}
    for r in rows:
        there = [c for c in (1, 2, 3) if r[c] is not None]
        near = sorted(known, key=lambda o: (sum((o[c] - r[c]) ** 2 for c in there), o[0]))[: k if there else None]
        out[r[0]] = tuple(r[c] if r[c] is not None else float(np.mean([o[c] for o in near])) for c in (1, 2, 3))
    return out


def test_knn_imputation_over_many_blocks_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, *(None if rng.random() < 0.2 else float(v) for v in rng.integers(0, 6, 3))) for i in range(400)] + [(400, None, None, None)]
    df = spark.createDataFrame(rows, "k long, x double, y double, z double")
    got = {r.k: (r.x, r.y, r.z) for r in N.knn_imputed(df, ["x", "y", "z"], "k", 3).collect()}
    want = brute_imputed(rows, 3)
    assert len(got) == len(rows) and all(np.allclose(got[k], want[k]) for k in want)


def test_knn_imputation_of_odd_rows(spark):
    schema = "k long, x double, y double"
    assert N.knn_imputed(spark.createDataFrame([], schema), ["x", "y"], "k").count() == 0
    none = N.knn_imputed(spark.createDataFrame([(1, None, 2.0)], schema), ["x", "y"], "k").first()
    assert none.x is None and none.y == 2.0
    repeated = spark.createDataFrame([(1, 1.0, 1.0), (1, 1.0, 1.0), (2, 5.0, 9.0), (3, float("nan"), 1.0), (3, None, 1.0)], schema)
    got = [r.x for r in N.knn_imputed(repeated, ["x", "y"], "k", 2).where("k = 3").collect()]
    assert got == [1.0, 1.0]


def test_imputation_k_scores_equal_brute_force(spark):
    rows, df = points(spark)
    got = N.imputation_k_scores(df, "y", ["x"], "k", ks=(1, 5)).collect()
    hidden = {r.k for r in df.where("pmod(xxhash64(1, k), 1000) < 100").collect()}
    known = [r for r in rows if r[0] not in hidden]
    for r in got:
        error = [(y - np.mean([o[2] for o in sorted(known, key=lambda o: (abs(o[1] - x), o[0]))[: r.k]])) ** 2 for k, x, y in rows if k in hidden]
        assert abs(r.mse - np.mean(error)) < 1e-9
    assert [r.k for r in got if r.best] == [min(got, key=lambda r: (r.mse, r.k)).k]


def test_knn_classes_and_davies_bouldin(spark):
    rows, df = points(spark)
    labelled = df.withColumn("c", F.when(F.col("k") < 30, "a").otherwise("b"))
    got = N.knn_classified(labelled, labelled, ["x", "y"], "c", "k").where("c = predicted").count()
    assert got >= 58
    xy, c = np.array([r[1:] for r in rows]), np.arange(60) >= 30
    m = [xy[c == v].mean(axis=0) for v in (False, True)]
    s = [np.sqrt(((xy[c == v] - m[i]) ** 2).sum(axis=1)).mean() for i, v in enumerate((False, True))]
    assert abs(N.davies_bouldin(labelled, "c", ["x", "y"]) - sum(s) / np.sqrt(((m[0] - m[1]) ** 2).sum())) < 1e-9
    assert N.davies_bouldin(labelled.where("c = 'a'"), "c", ["x", "y"]) == 0.0


def test_folds_are_dealt_in_turn_within_each_class(spark):
    df = spark.range(3000).select(F.col("id").alias("k"), F.when(F.col("id") % 7 > 0, F.when(F.col("id") % 3 == 0, "rare").otherwise("hot")).alias("c"))
    got = M.folds(df, "k", "c", 5, 9).collect()
    hashed = {r.k: r.h for r in df.select("k", F.xxhash64(F.lit(9), "k").alias("h")).collect()}
    assert len(got) == 3000
    for c in (None, "rare", "hot"):
        rows = sorted((r for r in got if r.c == c), key=lambda r: (hashed[r.k], r.k))
        assert [r.fold for r in rows] == [(i + 1) % 5 for i in range(len(rows))]


def test_power_transform_finds_the_logarithm(spark):
    df = spark.createDataFrame([(float(np.exp(x)),) for x in np.random.default_rng(1).normal(2, 1, 400)], "v double")
    assert abs(T.power_transform(df, "v", "boxcox")[1]) <= 0.15


def test_structure_context_and_identity(spark):
    df = spark.createDataFrame([(" 1abc", "1abc->2def", None, "", "['x1', ' x2 ', 'x1']", "['A', 'B']")], "code string, map string, new string, canon string, rel string, chains string")
    r = C.with_identity(df, "code", "map", "new", "canon", "rel").withColumn("ctx", C.structure_context(F.col("chains"), F.lit(None).cast("string"), F.lit("oops"))).first()
    assert (r.code, r.canonical, r.related) == ("1ABC", "2DEF", ["X1", "X2"]) and r.ctx.multichain and r.ctx.n_entities == 0
    assert C.with_old_names(df, {"Pdb Code": "code", "code": "map"}).columns[-1] == "Pdb Code"


def test_candidates_export_is_flat(spark):
    records = spark.createDataFrame([("1PFO", "Bitopic", "beta barrel", 1, 2, "x", False, None)], "entity string, a string, b string, m int, n int, words string, replaced boolean, edge boolean")
    reviews, notes = spark.createDataFrame([], "entity string, review_status string"), spark.createDataFrame([], "entity string, notes long")
    out = C.export_rows(C.candidates(records, reviews, notes, "entity", ["a", "b"], ["m", "n"], "words", "replaced", "edge"), "entity").first()
    assert out.disagreement_any and out.assessment_rules == '["override:1PFO"]' and out.decision_include and out.status == "not_recommended"


def test_joins_and_order(spark):
    assert J.join_path({"a": ["x", "y"], "b": ["y", "z"], "c": ["z"]}) == [("a", "b", "y"), ("b", "c", "z")]
    df = spark.createDataFrame([(1, "b"), (2, None), (3, "a")], "k int, v string")
    assert [r.k for r in df.orderBy(*R.ordered(df, "v", "desc", "k", df.columns)).collect()] == [2, 1, 3]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_are_pruned_and_filters_pushed(spark, sf_dir):
    p = plan(relational.semi_selection(spark, sf_dir))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,300000.0)" in p and "o_comment" not in p and "ReadSchema: struct<c_custkey:bigint,c_mktsegment:string>" in p
    for name in ("missing_methods", "crosstab_cumsum", "alias_join", "upsert_keep_meaningful"):
        if name in relational.QUERIES:
            assert "CartesianProduct" not in plan(relational.QUERIES[name](spark, sf_dir)), name


def test_isolation_finds_the_far_point(spark):
    rows, _ = points(spark)
    df = spark.createDataFrame(rows + [(99, 100.0, -100.0)], "k long, x double, y double")
    got = {r.k: r.isolation for r in N.isolation_scores(df, ["x", "y"], "k").collect()}
    assert max(got, key=got.get) == 99 and all(0 < v <= 1 for v in got.values())


def test_labels_spread_within_groups(spark):
    _, df = points(spark)
    few = df.withColumn("c", F.when(F.col("k") == 0, "a").when(F.col("k") == 59, "b"))
    got = N.labels_spread(few, "k", ["x", "y"], "c", 5).collect()
    assert sum(r.spread == ("a" if r.k < 30 else "b") for r in got) >= 55
    found = N.graph_clusters(df, "k", ["x", "y"], 3.0, 2).where("cluster is not null").collect()
    assert len({r.cluster for r in found if r.k < 30}) == 1 and len({r.cluster for r in found}) == 2


def test_geometry_of_a_small_structure(spark):
    line = lambda i, atom, res, num, x, y, z: f"ATOM  {i:5d} {atom:<4s} {res:3s} A{num:4d}    {x:8.3f}{y:8.3f}{z:8.3f}  1.00  0.00"
    text = [line(1, " CA", "ALA", 1, 0, 0, 0), line(2, " CA", "LYS", 2, 3, 0, 0), line(3, " NZ", "LYS", 2, 3, 3, 0), line(4, " OD1", "ASP", 3, 3, 6.5, 0), "HETATM junk"]
    lines = spark.createDataFrame([("e", t) for t in text], "entity string, value string")
    r = C.geometry(C.atoms(lines, "entity"), "entity").first()
    xyz = np.array([[0, 0, 0], [3, 0, 0], [3, 3, 0], [3, 6.5, 0]])
    assert r.atoms == 4 and r.salt_bridges == 1 and r.hydrophobic == 0.5 and abs(r.gyration - np.sqrt(xyz.var(axis=0).sum())) < 1e-9 and abs(r.extent - np.sqrt(9 + 6.5**2)) < 1e-9
