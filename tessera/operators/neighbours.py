"""What is built on nearest neighbours, and random projections (ML-2, 4, 5, 18, 33, 37, 49, 50, 51).

Imputation and label spreading use the exact search of ``nearest``, outliers the
clusters of ``density``.  Neighbours within a radius come from an equality join on
grid cells, so only rows of adjacent cells meet.  A classifier by neighbours is
fitted on a bounded number of labelled rows, which is a parameter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .density import density_clusters
from .nearest import nearest, neighbour_graph
from .stages import settled
from .within import Within

DONORS = 5000  # labelled rows of the classifier by neighbours


def _donors(df: DataFrame, columns: Sequence[str], key: str, most: int, more: Sequence[str] = ()) -> pd.DataFrame:
    """At most ``most`` complete rows, by hashed key."""
    return df.dropna(subset=list(columns)).orderBy(F.xxhash64(key), key).limit(most).select(*columns, *more).toPandas()


def _value(c: str) -> Column:
    return F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))


def _known_neighbours(df: DataFrame, columns: Sequence[str], key: str, k: int) -> DataFrame:
    """there, q, near: for the rows with nulls, by which columns are there and where
    they lie over those, the numbers of the k nearest complete rows, nearest first."""
    missing = F.exists(F.array(*[_value(c) for c in columns]), lambda v: v.isNull())
    rows = df.withColumn("__gap", missing).withColumn("__there", F.array(*[_value(c).isNotNull() for c in columns]))
    donors = df.where(~missing).select(F.col(key), *[_value(c).alias(f"__v{i}") for i, c in enumerate(columns)])
    gaps = [r[0] for r in rows.where("__gap").select("__there").distinct().collect()]  # which columns, not which rows
    out = None
    for there in sorted(gaps):
        at = [i for i, x in enumerate(there) if x]
        if not at:
            continue
        asked = rows.where(F.col("__there") == F.array(*[F.lit(x) for x in there])).select(*[_value(columns[i]).alias(f"__v{i}") for i in at])
        found = nearest(asked, donors, [f"__v{i}" for i in at], [key, *[f"__v{i}" for i in range(len(columns))]], k)
        near = F.array_sort(F.collect_list(F.struct("rank", F.array(*[f"__v{i}" for i in range(len(columns))]).alias("x"))))  # k
        found = found.groupBy("q").agg(F.transform(near, lambda s: s["x"]).alias("near")).select(F.array(*[F.lit(x) for x in there]).alias("there"), "q", "near")
        out = found if out is None else out.unionByName(found)
    if out is None:
        return df.sparkSession.createDataFrame([], "there array<boolean>, q array<double>, near array<array<double>>")
    return settled(out)


def _filled(df: DataFrame, found: DataFrame, columns: Sequence[str], k: int) -> DataFrame:
    """``df`` with its nulls filled by the first ``k`` neighbours' means."""
    values = F.array(*[_value(c) for c in columns])
    whole = ~F.exists(values, lambda v: v.isNull())
    known = df.where(whole).agg(F.array(*[F.avg(_value(c)) for c in columns]).alias("m")).scalar()
    mean = lambda i: F.expr(f"aggregate(slice(near, 1, {int(k)}), 0D, (s, x) -> s + x[{i}])") / F.least(F.size("near"), F.lit(k))
    found = found.select(F.col("there").alias("__there"), F.col("q").alias("__q"), F.array(*[mean(i) for i in range(len(columns))]).alias("__f"))
    gaps = df.where(~whole).withColumns({"__there": F.transform(values, lambda v: v.isNotNull()), "__q": F.transform(F.filter(values, lambda v: v.isNotNull()), lambda v: v + 0.0)})
    got = gaps.join(found, ["__there", "__q"], "left").withColumn("__f", F.coalesce("__f", known))
    got = got.withColumns({c: F.coalesce(_value(c), F.get("__f", F.lit(i))) for i, c in enumerate(columns)}).select(*df.columns)
    return df.where(whole).withColumns({c: _value(c) for c in columns}).select(*df.columns).unionByName(got)


def knn_imputed(df: DataFrame, columns: Sequence[str], key: str, k: int = 3) -> DataFrame:
    """ML-2: nulls (and NaN) become the mean of the k nearest of all complete rows by
    distance over the columns that are there, ties by ``key``, then by the numbers;
    with no column there, or an infinite number, the mean of all complete rows; with
    no complete row they stay.  Infinite numbers are nobody's neighbours.

    Neighbours are found by ``nearest``, once for each set of columns that are there.
    """
    return _filled(df, _known_neighbours(df, columns, key, k), columns, k)


def imputation_k_scores(df: DataFrame, column: str, others: Sequence[str], key: str, ks: Sequence[int] = (1, 3, 5, 7, 9), hide: float = 0.1, seed: int = 1) -> DataFrame:
    """ML-4: known values are hidden and imputed again with each of the few ``ks``, from
    one search of the largest; ``best`` marks the k with the smallest squared error,
    of equals the smallest k."""
    base = _hidden(df, column, key, hide, seed)
    found = _known_neighbours(base, [column, *others], key, max(ks))
    out = None
    for k in ks:
        one = _error(_filled(base, found, [column, *others], k), column).select(F.lit(k).alias("k"), "mse")
        out = one if out is None else out.unionByName(one)
    return out.withColumn("best", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("mse").asc_nulls_last(), "k")) == 1)  # a row for each k


def knn_classified(df: DataFrame, train: DataFrame, columns: Sequence[str], label: str, key: str, k: int = 5, donors: int = DONORS) -> DataFrame:
    """ML-37 (kNN): the commonest label among the k nearest of at most ``donors`` rows."""
    known = _donors(train.where(F.col(label).isNotNull()), columns, key, donors, [label])
    at, said = known[list(columns)].to_numpy(float), known[label].to_numpy()

    names, said = np.unique(said.astype(str), return_inverse=True)
    most = min(k, len(at))

    @F.pandas_udf("string")
    def vote(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            x, out = np.column_stack([p.to_numpy(float) for p in parts]), []
            for part in np.array_split(x, -(-len(x) // 512) or 1):
                d = (at * at).sum(axis=1)[None, :] - 2 * part @ at.T  # but for the row's own square
                near = np.argpartition(d, most - 1, axis=1)[:, :most] if most else np.zeros((len(part), 0), int)
                votes = np.zeros((len(part), len(names)), int)
                np.add.at(votes, (np.arange(len(part))[:, None], said[near]), 1)
                out += names[votes.argmax(axis=1)].tolist() if most else [None] * len(part)
            yield pd.Series(out, dtype=object)

    return df.withColumn("predicted", vote(*[F.col(c).cast("double") for c in columns]))


def imputer_scores(df: DataFrame, column: str, others: Sequence[str], key: str, hide: float = 0.1, seed: int = 1) -> DataFrame:
    """ML-5: known values are hidden and imputed again; squared error by method."""
    from .statistics import imputed

    base = _hidden(df, column, key, hide, seed)
    error = lambda d, name: _error(d, column).withColumn("method", F.lit(name))
    out = error(imputed(base, [column], "mean"), "mean").unionByName(error(imputed(base, [column], "median"), "median"))
    return out.unionByName(error(knn_imputed(base, [column, *others], key), "knn")).select("method", "mse")


def _hidden(df: DataFrame, column: str, key: str, hide: float, seed: int) -> DataFrame:
    """Rows with a value: a share of the values, by hashed key, is moved to ``__t``."""
    hidden = F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1000)) < int(1000 * hide)
    return df.where(F.col(column).isNotNull()).withColumn("__t", F.col(column).cast("double")).withColumn(column, F.when(~hidden, F.col(column).cast("double"))).withColumn("__h", hidden)


def _error(df: DataFrame, column: str) -> DataFrame:
    """Mean squared error of what was hidden."""
    return df.where("__h").agg(F.avg(F.pow(F.col(column) - F.col("__t"), F.lit(2))).alias("mse"))


def random_projection(df: DataFrame, column: str, k: int, size: int, seed: int = 1, to: str = "projected") -> DataFrame:
    """ML-18: Gaussian projection; the matrix is made from the seed in every task."""

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matrix = np.random.default_rng(seed).normal(0, k**-0.5, (size, k))
        for s in batches:
            yield pd.Series(list(np.stack(s.tolist()) @ matrix)) if len(s) else pd.Series([], dtype=object)

    return df.withColumn(to, project(F.col(column).cast("array<double>")))


def close_pairs(df: DataFrame, key: str, columns: Sequence[str], eps: float) -> DataFrame:
    """(a, b) of rows at most ``eps`` apart, a < b: one side goes into its own
    grid cell, the other into all adjacent ones; few columns only."""
    cell = [F.floor(F.col(c) / eps).cast("long") for c in columns]
    own = df.select(F.col(key).alias("a"), F.array(*cell).alias("cell"), *[F.col(c).alias(f"x{i}") for i, c in enumerate(columns)])
    shifts = F.array(*[F.array(*[F.lit(s).cast("long") for s in shift]) for shift in itertools.product((-1, 0, 1), repeat=len(columns))])
    other = df.select(F.col(key).alias("b"), F.explode(F.transform(shifts, lambda s: F.zip_with(F.array(*cell), s, lambda p, q: p + q))).alias("cell"), *[F.col(c).alias(f"y{i}") for i, c in enumerate(columns)])
    distance = sum((F.pow(F.col(f"x{i}") - F.col(f"y{i}"), F.lit(2)) for i in range(1, len(columns))), F.pow(F.col("x0") - F.col("y0"), F.lit(2)))
    return own.join(other, "cell").where((F.col("a") < F.col("b")) & (distance <= eps * eps)).select("a", "b")


def density_outliers(df: DataFrame, key: str, columns: Sequence[str], eps: float, least: int) -> DataFrame:
    """ML-33: rows that belong to no density cluster are outliers."""
    return density_clusters(df, key, columns, eps, least).withColumn("kind", F.when(F.col("cluster").isNotNull(), "Inlier").otherwise("Outlier")).drop("core", "cluster")


def davies_bouldin(df: DataFrame, label: str, columns: Sequence[str]) -> float:
    """ML-50: from each cluster's centre and mean distance to it; the clusters'
    few rows are compared on the driver."""
    from pyspark.sql import Window

    by = Window.partitionBy(label)
    centred = df.select(label, *[F.col(c) for c in columns], *[F.avg(c).over(by).alias(f"m{i}") for i, c in enumerate(columns)])
    d = F.sqrt(sum((F.pow(F.col(c) - F.col(f"m{i}"), F.lit(2)) for i, c in enumerate(columns)), F.lit(0.0)))
    rows = centred.groupBy(label).agg(F.avg(d).alias("s"), *[F.first(f"m{i}").alias(f"m{i}") for i in range(len(columns))]).collect()
    if len(rows) < 2:
        return 0.0
    centre = np.array([[r[f"m{i}"] for i in range(len(columns))] for r in rows])
    s = np.array([r["s"] for r in rows])
    apart = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(apart > 0, (s[:, None] + s[None]) / apart, -np.inf)
    return float(ratio.max(axis=1).mean())


def isolation_scores(df: DataFrame, columns: Sequence[str], key: str, trees: int = 50, sample: int = 256, seed: int = 1, to: str = "isolation") -> DataFrame:
    """ML-32, 33: isolation forest score, 0..1, high for rows that few random cuts
    set apart.  Each tree is grown from at most ``sample`` rows of a bounded donor set."""
    rng, known = np.random.default_rng(seed), _donors(df, columns, key, trees * sample).to_numpy(float)
    if len(known) < 2:
        return df.withColumn(to, F.lit(0.0))
    size = min(sample, len(known))
    deepest = int(np.ceil(np.log2(size)))

    def rest(n: int) -> float:
        """Mean depth of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def grow(x: np.ndarray, depth: int):
        spread = np.flatnonzero(x.min(axis=0) < x.max(axis=0)) if len(x) else []
        if depth >= deepest or len(x) < 2 or len(spread) == 0:
            return depth + rest(len(x))
        c = rng.choice(spread)
        cut = rng.uniform(x[:, c].min(), x[:, c].max())
        return int(c), float(cut), grow(x[x[:, c] <= cut], depth + 1), grow(x[x[:, c] > cut], depth + 1)

    forest = [grow(known[rng.choice(len(known), size, replace=False)], 0) for _ in range(trees)]

    def depths(node, x: np.ndarray, rows: np.ndarray, out: np.ndarray) -> None:
        if not isinstance(node, tuple):
            out[rows] += node
            return
        left = x[rows, node[0]] <= node[1]
        depths(node[2], x, rows[left], out)
        depths(node[3], x, rows[~left], out)

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            x = np.nan_to_num(np.column_stack([p.to_numpy(float) for p in parts]))
            out = np.zeros(len(x))
            for tree in forest:
                depths(tree, x, np.arange(len(x)), out)
            yield pd.Series(2.0 ** (-out / trees / max(rest(size), 1e-9)))

    return df.withColumn(to, score(*[F.col(c).cast("double") for c in columns]))


def labels_spread(df: DataFrame, key: str, columns: Sequence[str], label: str, k: int = 7, keep: float = 0.8, tolerance: float = 1e-3, most: int = 100) -> DataFrame:
    """ML-51: known labels spread over the graph of nearest neighbours.  Two rows are
    linked if one is among the k nearest of the other; a link weighs one over the
    root of both rows' numbers of links.  In each round a row's weights are ``keep``
    times what comes over its links and the rest what it knew at first, until no
    weight changes by more than ``tolerance``.  Rows that nothing reaches get null.
    """
    graph = neighbour_graph(df, key, columns, k).select("a", "b")
    links = settled(graph.unionByName(graph.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    degree = links.groupBy("a").agg(F.count("*").alias("n"))
    weighed = links.join(degree, "a").join(degree.select(F.col("a").alias("b"), F.col("n").alias("m")), "b")
    links = settled(weighed.select("a", "b", (keep / F.sqrt(F.col("n") * F.col("m"))).alias("s")))
    first = settled(df.where(F.col(label).isNotNull()).select(F.col(key).alias("a"), F.col(label).alias("l"), F.lit(1.0 - keep).alias("w")))
    now = first
    for _ in range(most):
        came = links.join(now.select(F.col("a").alias("b"), "l", "w"), "b").groupBy("a", "l").agg(F.sum(F.col("s") * F.col("w")).alias("w"))
        after = settled(came.unionByName(first).groupBy("a", "l").agg(F.sum("w").alias("w")))
        change = after.join(now.withColumnRenamed("w", "old"), ["a", "l"], "full_outer").agg(F.max(F.abs(F.coalesce("w", F.lit(0.0)) - F.coalesce("old", F.lit(0.0))))).first()[0]
        now = after
        if (change or 0.0) <= tolerance:
            break
    best = now.groupBy("a").agg(F.max_by("l", F.struct("w", "l")).alias("spread"))
    return df.join(best.withColumnRenamed("a", key), key, "left").withColumn("spread", F.coalesce(F.col(label), F.col("spread")))


def graph_clusters(df: DataFrame, key: str, columns: Sequence[str], eps: float, k: int, rounds: int = 15, seed: int = 0) -> DataFrame:
    """ML-49: power iteration clustering on the graph of close rows, in place of
    spectral clustering.  Rows at most ``eps`` apart are linked; rows without links, or
    with a null or non-finite number, get none.

    No link is ever made.  Rows at one position have the same links but for each other,
    so they are one node of their number, and a round's sum over a node's links is one
    over all rows within ``eps``.  As in Spark's own, a round divides that by the number
    of links and by the sum of all sizes, until changes hardly change; k-means splits
    the values, here over their range, since they shrink with the number of rows."""
    place = F.transform(F.array(*[F.col(c).cast("double") for c in columns]), lambda v: v + 0.0)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    nodes = df.select(F.col(key).alias("node"), place.alias("x")).where(fine).groupBy("x").agg(F.min("node").alias("node"), F.count("*").alias("n"))
    nodes = settled(nodes)
    discs = Within(nodes, len(columns), eps)
    linked = discs.sums(discs.rows, F.col("n"), "links").withColumn("links", F.col("links") - 1).where("links > 0")
    state = settled(linked.withColumn("v", F.xxhash64(F.lit(seed), "node") / F.lit(float(1 << 63))))
    size = lambda v: F.sum(F.col("n") * F.abs(v))
    rows, whole = state.agg(F.sum("n"), size(F.col("v"))).first()
    if not rows:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    state, before = state.withColumn("v", F.col("v") / whole), float("inf")
    for _ in range(rounds):
        # The sum has every row at the position, and a row is not linked with itself.
        state = discs.sums(state.withColumnRenamed("v", "old"), F.col("n") * F.col("old"), "v").withColumn("v", (F.col("v") - F.col("old")) / F.col("links"))
        whole = state.agg(size(F.col("v"))).first()[0]
        state = state.withColumn("v", F.col("v") / (whole or 1.0))
        change = state.agg(size(F.col("v") - F.col("old"))).first()[0]
        state = state.drop("old")
        if abs(change - before) < max(1e-5 / rows, 1e-8):
            break
        before = change
    low, high = state.agg(F.min("v"), F.max("v")).first()
    spread = settled(state.select("node", "x", F.col("n").cast("double").alias("n"), array_to_vector(F.array((F.col("v") - low) / ((high - low) or 1.0))).alias("features")))
    found = KMeans(k=k, seed=seed, weightCol="n").fit(spread).transform(spread).select(F.col("x").alias("__x"), F.col("prediction").alias("cluster"))
    return df.withColumn("__at", place).join(found, F.col("__at") == F.col("__x"), "left").select(*[df[c] for c in df.columns], "cluster")
