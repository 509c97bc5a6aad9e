"""Registered queries of the statistics and learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import learning as M
from ..operators import neighbours as N
from ..operators import statistics as T
from ..operators.attributions import attributed, forest, mean_attributions, patterns
from ..operators.density import density_clusters as clusters_by_density
from ..operators.modes import mean_shift
from ..operators.nearest import outlier_factors
from ..operators.spectral import spectral_clusters as clusters_by_spectrum
from ..sources.readers import table
from .registry import registry

query, QUERIES, ORACLE_SQL = registry()

_SCALED = {
    "minmax": "(x - min(x) OVER ()) / (max(x) OVER () - min(x) OVER ())",
    "robust": "(x - median(x) OVER ()) / (quantile_cont(x, 0.75) OVER () - quantile_cont(x, 0.25) OVER ())",
    "maxabs": "x / max(abs(x)) OVER ()",
    "standard": "(x - avg(x) OVER ()) / stddev_pop(x) OVER ()",
    "log1p": "ln(1 + x)",
}


@query(f"SELECT p_partkey, {', '.join(f'round({e}, 6) AS {n}' for n, e in _SCALED.items())} FROM (SELECT p_partkey, p_retailprice AS x FROM part)")
def scalers(spark, d):
    """ML-7..11."""
    out = table(spark, d, "part", ["p_partkey", "p_retailprice"])
    for how in _SCALED:
        out = T.scaled(out, "p_retailprice", how, how)
    return out.select("p_partkey", *[F.round(n, 6).alias(n) for n in _SCALED])


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN p < q1 - 1.5 * (q3 - q1) OR p > q3 + 1.5 * (q3 - q1) THEN 'Outlier' ELSE 'Inlier' END AS kind FROM (SELECT l_orderkey, l_linenumber, l_returnflag AS f, l_extendedprice AS p FROM lineitem)
JOIN (SELECT l_returnflag AS f, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1) USING (f)
""")
def iqr_outliers(spark, d):
    """ML-31, ML-34."""
    rows = table(spark, d, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice"])
    return T.iqr_outliers(rows, "l_extendedprice", ["l_returnflag"]).select("l_orderkey", "l_linenumber", "kind")


@query("SELECT p_partkey, round(coalesce(x, avg(x) OVER ()), 6) AS filled FROM (SELECT p_partkey, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS x FROM part)")
def mean_imputation(spark, d):
    """ML-1, ML-6, ML-45."""
    rows = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("filled"))
    return T.imputed(rows, ["filled"]).withColumn("filled", F.round("filled", 6))


@query("SELECT p_partkey, round(a / sqrt(a * a + b * b), 6) AS a, round(b / sqrt(a * a + b * b), 6) AS b FROM (SELECT p_partkey, p_size::DOUBLE AS a, p_retailprice AS b FROM part)")
def unit_vectors(spark, d):
    """ML-15."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("a"), F.col("p_retailprice").alias("b"))
    return T.unit_vectors(rows, ["a", "b"]).withColumns({c: F.round(c, 6) for c in "ab"})


@query("""
SELECT o_orderstatus, round(avg(o_totalprice), 3) AS mean, round(stddev_pop(o_totalprice), 3) AS sd, median(o_totalprice) AS median, min(o_totalprice) AS low, max(o_totalprice) AS high, round(max(o_totalprice) - min(o_totalprice), 2) AS spread,
  round(quantile_cont(o_totalprice, 0.25), 3) AS q25, round(quantile_cont(o_totalprice, 0.75), 3) AS q75 FROM orders GROUP BY 1
""")
def moments(spark, d):
    """ML-52 (without skew and kurtosis, whose definitions differ)."""
    out = T.moments(table(spark, d, "orders"), ["o_orderstatus"], "o_totalprice").drop("skew", "kurtosis")
    return out.withColumns({"mean": F.round("mean", 3), "sd": F.round("sd", 3), "spread": F.round("spread", 2), "q25": F.round("q25", 3), "q75": F.round("q75", 3)})


@query("SELECT quality, toxic, count(*) AS n FROM labels GROUP BY 1, 2")
def confusion_matrix(spark, d):
    """ML-41."""
    return T.confusion(table(spark, d, "labels"), "quality", "toxic")


@query("""
WITH c AS (SELECT k, (SELECT count(*) FROM labels WHERE quality = k) AS sup, (SELECT count(*) FROM labels WHERE toxic = k) AS said, (SELECT count(*) FROM labels WHERE toxic = k AND quality = k) AS hit FROM (SELECT DISTINCT quality AS k FROM labels)),
  m AS (SELECT sup, hit, coalesce(hit::DOUBLE / nullif(said, 0), 0) AS p, hit::DOUBLE / sup AS r FROM c)
SELECT round(sum(hit)::DOUBLE / sum(sup), 6) AS accuracy, round(sum(p * sup) / sum(sup), 6) AS precision, round(sum(r * sup) / sum(sup), 6) AS recall, round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * sup) / sum(sup), 6) AS f1 FROM m
""")
def weighted_f1(spark, d):
    """ML-42."""
    out = T.weighted_scores(table(spark, d, "labels"), "quality", "toxic")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("""
WITH r AS (SELECT o_orderstatus AS c, o_totalprice / 1000 AS x FROM orders), g AS (SELECT c, count(*) AS n, avg(x) AS m, var_pop(x) AS v FROM r GROUP BY 1)
SELECT count(*) AS clusters, round(sum(n * v), 1) AS within, round((sum(n * m * m) - sum(n * m) * sum(n * m) / sum(n)), 1) AS between FROM g
""")
def cluster_quality(spark, d):
    """ML-28, ML-29, ML-50."""
    rows = table(spark, d, "orders").withColumn("x", F.col("o_totalprice") / 1000)
    return T.cluster_quality(rows, "o_orderstatus", ["x"]).select("clusters", F.round("within", 1).alias("within"), F.round("between", 1).alias("between"))


@query(None)
def power_transforms(spark, d):
    """ML-12, ML-13."""
    rows = table(spark, d, "part", ["p_partkey", "p_retailprice"])
    return T.power_transform(T.power_transform(rows, "p_retailprice", "boxcox")[0], "p_retailprice", "yeojohnson")[0]


@query(None)
def quantile_ranks(spark, d):
    """ML-14."""
    return T.quantile_ranks(table(spark, d, "part", ["p_partkey", "p_retailprice"]), "p_retailprice")


@query(None)
def exponential_growth(spark, d):
    """ML-35: fitted on the counts of all years, evaluated for every year."""
    counts = table(spark, d, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.count("*").alias("n")).where("year is not null")
    index = counts.select("year", "n", (F.col("year") - F.lit(1992)).alias("i"))
    points = [(r["i"], r["n"]) for r in index.orderBy("i").collect()]  # one point a year
    a, b = T.exponential_fit(points)
    return index.withColumn("fit", F.lit(a) * F.exp(F.lit(b) * (F.col("i") - 20)))


def _vectors(spark, d):
    return M.vectors(table(spark, d, "embeddings"), "embedding")


@query(None)
def pca2(spark, d):
    """ML-16, ML-17, ML-20."""
    return M.principal_components(_vectors(spark, d), 2).select("vec_id", F.get("pc", F.lit(0)).alias("pc1"), F.get("pc", F.lit(1)).alias("pc2"))


@query(None)
def kmeans(spark, d):
    """ML-22."""
    return M.clusters(_vectors(spark, d), 5).select("vec_id", "cluster")


@query(None)
def kmeans_best_k(spark, d):
    """ML-23, ML-28, ML-30."""
    k, score = M.best_k(_vectors(spark, d), range(2, 5))
    return spark.createDataFrame([(k, float(score))], "k int, silhouette double")


@query(None)
def mixture_clusters(spark, d):
    """ML-26: Gaussian mixture on two principal components."""
    rows = M.principal_components(_vectors(spark, d), 2).select("vec_id", "pc")
    return M.clusters(M.vectors(rows, "pc"), 3, "gaussian").select("vec_id", "cluster")


@query(None)
def bisecting_clusters(spark, d):
    """ML-24, by bisecting k-means in place of merging."""
    return M.clusters(_vectors(spark, d), 3, "bisecting").select("vec_id", "cluster")


@query(None)
def self_training(spark, d):
    """ML-38: a tenth of the labels, and confident predictions for the rest."""
    rows = _vectors(spark, d).select("vec_id", F.col("label").cast("double").alias("label"), "features")
    told = F.pmod(F.xxhash64("vec_id"), F.lit(10)) == 0
    return M.self_trained(rows.where(told), rows.where(~told).drop("label"), "logistic", 0.9, 2).select("vec_id", "prediction")


@query(None)
def feature_importances(spark, d):
    """ML-36, AGG-47: forest importances of two columns of a line's price."""
    rows = table(spark, d, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_returnflag"]).withColumn("label", (F.col("l_returnflag") == "R").cast("double"))
    found = M.importances(rows, ["l_quantity", "l_extendedprice", "l_discount"])
    return spark.createDataFrame(found, "feature string, importance double")


@query(None)
def batch_scoring(spark, d):
    """ML-45, ML-47, ML-48: one fitted model applied to every row."""
    rows = table(spark, d, "part", ["p_partkey", "p_size", "p_retailprice", "p_type"]).withColumns({"p_size": F.col("p_size").cast("double"), "p_retailprice": F.col("p_retailprice").cast("double")})
    model = M.scoring_pipeline(rows.where("p_partkey % 4 <> 0"), ["p_size", "p_retailprice"], "p_type", "tree")
    return model.transform(rows).select("p_partkey", "prediction")


@query(None)
def classifier_cmp(spark, d):
    """ML-37, ML-40..42: five classifiers on whether the label is odd."""
    rows = _vectors(spark, d).select("vec_id", (F.col("label") % 2).cast("double").alias("label"), "features")
    train, test = M.split(rows, "vec_id", 0.3, 5)
    return M.comparison(train, test, ["logistic", "tree", "forest", "boosting", "svm"])


@query("SELECT label, fold, count(*) AS n FROM (SELECT label, (row_number() OVER (PARTITION BY label ORDER BY vec_id) % 5)::INT AS fold FROM embeddings) GROUP BY 1, 2")
def stratified_folds(spark, d):
    """ML-39: sizes of the folds by class."""
    return M.folds(table(spark, d, "embeddings", ["vec_id", "label"]), "vec_id", "label", 5, 1).groupBy("label", "fold").agg(F.count("*").alias("n"))


# --- neighbours ----------------------------------------------------------------
@query("""
WITH p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier), b AS (SELECT a.k AS a, c.k AS b FROM p a JOIN p c ON a.k <> c.k AND (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) <= 25.0),
  core AS (SELECT a AS k FROM b GROUP BY 1 HAVING count(*) + 1 >= 4)
SELECT k AS s_suppkey, CASE WHEN k IN (SELECT k FROM core) OR k IN (SELECT a FROM b WHERE b IN (SELECT k FROM core)) THEN 'Inlier' ELSE 'Outlier' END AS kind FROM p
""")
def density_outliers(spark, d):
    """ML-25, ML-32."""
    rows = table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))
    return N.density_outliers(rows, "s_suppkey", ["x", "y"], 5.0, 4).select("s_suppkey", "kind")


@query("""
WITH p AS (SELECT p_partkey, p_size::DOUBLE AS s, CASE WHEN p_partkey % 10 <> 0 THEN p_retailprice::DOUBLE END AS v FROM part),
  near AS (SELECT a.p_partkey, b.v, row_number() OVER (PARTITION BY a.p_partkey ORDER BY (a.s - b.s) * (a.s - b.s), b.p_partkey) AS r FROM p a JOIN p b ON a.v IS NULL AND b.v IS NOT NULL),
  filled AS (SELECT p_partkey, avg(v) AS v FROM near WHERE r <= 3 GROUP BY 1)
SELECT p_partkey, s AS p_size, round(coalesce(p.v, f.v), 4) AS p_retailprice FROM p LEFT JOIN filled f USING (p_partkey)
""")
def knn_imputation(spark, d):
    """ML-2."""
    rows = table(spark, d, "part").select("p_partkey", F.col("p_size").cast("double").alias("p_size"), F.when(F.col("p_partkey") % 10 != 0, F.col("p_retailprice")).alias("p_retailprice"))
    return N.knn_imputed(rows, ["p_size", "p_retailprice"], "p_partkey").withColumn("p_retailprice", F.round("p_retailprice", 4))


@query("""
WITH p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier),
  near AS (SELECT * FROM (SELECT a.k AS a, b.k AS b, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS d, row_number() OVER (PARTITION BY a.k ORDER BY (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y), b.k) AS r FROM p a JOIN p b ON a.k <> b.k) WHERE r <= 5),
  reach AS (SELECT a AS b, max(d) AS reach FROM near GROUP BY 1), dens AS (SELECT a, 1 / (avg(greatest(d, reach)) + 1e-10) AS w FROM near JOIN reach USING (b) GROUP BY 1)
SELECT n.a AS s_suppkey, round(avg(o.w) / any_value(m.w), 6) AS factor FROM near n JOIN dens o ON n.b = o.a JOIN dens m ON n.a = m.a GROUP BY 1
""")
def local_outliers(spark, d):
    """ML-32: local outlier factor."""
    return outlier_factors(_supplier_points(spark, d), "s_suppkey", ["x", "y"], 5).select("s_suppkey", F.round("factor", 6).alias("factor"))


@query("""
WITH RECURSIVE p AS (SELECT s_suppkey AS k, s_acctbal / 100 AS x, s_nationkey::DOUBLE AS y FROM supplier), b AS (SELECT a.k AS a, c.k AS b FROM p a JOIN p c ON (a.x - c.x) * (a.x - c.x) + (a.y - c.y) * (a.y - c.y) <= 25.0),
  core AS (SELECT a AS k FROM b GROUP BY 1 HAVING count(*) >= 4), link AS (SELECT a, b FROM b WHERE a IN (SELECT k FROM core) AND b IN (SELECT k FROM core)),
  walk AS (SELECT k AS a, k AS b FROM core UNION SELECT walk.a, link.b FROM walk JOIN link ON walk.b = link.a), c AS (SELECT a AS k, min(b) AS cluster FROM walk GROUP BY 1)
SELECT p.k AS s_suppkey, p.k IN (SELECT k FROM core) AS core, coalesce(any_value(own.cluster), min(near.cluster)) AS cluster FROM p LEFT JOIN c own ON own.k = p.k LEFT JOIN b ON b.a = p.k LEFT JOIN c near ON near.k = b.b GROUP BY 1, 2
""")
def density_clusters(spark, d):
    """ML-25: density clusters with their labels."""
    return clusters_by_density(_supplier_points(spark, d), "s_suppkey", ["x", "y"], 5.0, 4).select("s_suppkey", "core", "cluster")


@query(None)
def imputer_k_search(spark, d):
    """ML-4."""
    return N.imputation_k_scores(table(spark, d, "part"), "p_retailprice", ["p_size"], "p_partkey")


@query(None)
def imputer_comparison(spark, d):
    """ML-5."""
    return N.imputer_scores(table(spark, d, "part"), "p_retailprice", ["p_size"], "p_partkey")


@query(None)
def knn_classes(spark, d):
    """ML-37 (kNN), on all numbers of the embeddings."""
    rows = table(spark, d, "embeddings")
    names = [f"e{i}" for i in range(rows.select(F.max(F.size("embedding"))).first()[0] or 0)]
    rows = rows.select("vec_id", "label", *[F.get("embedding", F.lit(i)).cast("double").alias(c) for i, c in enumerate(names)])
    return N.knn_classified(rows, rows.where("vec_id % 2 = 0"), names, "label", "vec_id").select("vec_id", "label", "predicted")


@query(None)
def gaussian_projection(spark, d):
    """ML-18."""
    rows = table(spark, d, "embeddings")
    size = rows.select(F.max(F.size("embedding"))).first()[0]
    return N.random_projection(rows, "embedding", 8, size).select("vec_id", "projected")


def _supplier_points(spark, d):
    return table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 100).alias("x"), F.col("s_nationkey").cast("double").alias("y"))


@query(None)
def isolation_scores(spark, d):
    """ML-32, ML-33."""
    return N.isolation_scores(_supplier_points(spark, d), ["x", "y"], "s_suppkey").select("s_suppkey", "isolation")


@query(None)
def spread_labels(spark, d):
    """ML-51."""
    rows = _supplier_points(spark, d).withColumn("c", F.when(F.col("s_suppkey") % 5 == 0, F.when(F.col("x") > 50, "high").otherwise("low")))
    return N.labels_spread(rows, "s_suppkey", ["x", "y"], "c", 5).select("s_suppkey", "spread")


@query(None)
def mean_shift_modes(spark, d):
    """ML-27."""
    out = mean_shift(_supplier_points(spark, d), "s_suppkey", ["x", "y"], 15.0)
    return out.select("s_suppkey", "mode_size", F.transform("mode", lambda v: F.round(v, 4)).alias("mode"))


@query(None)
def principal_loadings(spark, d):
    """ML-17: how much each component of the embeddings weighs in a principal one."""
    return M.loadings(_vectors(spark, d), 2)


@query(None)
def graph_clusters(spark, d):
    """ML-49."""
    return N.graph_clusters(_supplier_points(spark, d), "s_suppkey", ["x", "y"], 10.0, 3).select("s_suppkey", "cluster")


@query(None)
def spectral_clusters(spark, d):
    """ML-49: spectral clusters of the graph of nearest neighbours."""
    return clusters_by_spectrum(_supplier_points(spark, d), "s_suppkey", ["x", "y"], 3).select("s_suppkey", "cluster")


@query(None)
def feature_attributions(spark, d):
    """ML-43: mean absolute Shapley value of each column for each return flag, over all lines."""
    names = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    flag = F.when(F.col("l_returnflag") == "R", 2.0).when(F.col("l_returnflag") == "N", 1.0).otherwise(0.0)
    rows = M.counted(table(spark, d, "lineitem", [*names, "l_returnflag"]).withColumn("label", flag), names)
    model = forest(M.forest_of_counts(rows, 8, 4, seed=1), spark)
    found = mean_attributions(attributed(patterns(rows, model, weight="n"), model), names, weight="n")
    return found.select(F.element_at(F.array(*[F.lit(x) for x in "ANR"]), F.col("class") + 1).alias("flag"), "feature", F.round("mean_abs", 9).alias("mean_abs"))
