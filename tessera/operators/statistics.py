"""Scaling, imputation, outliers and cluster quality by aggregates (ML)."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quantiles import quantiles
from .stages import beside


def one_row(df: DataFrame, aggs: dict[str, Column]) -> Column:
    """A struct of aggregates over all of ``df``, as a scalar subquery."""
    return df.agg(F.struct(*[c.alias(n) for n, c in aggs.items()]).alias("s")).scalar()


def scaled(df: DataFrame, column: str, how: str, to: str) -> DataFrame:
    """ML-7..11: minmax, robust, maxabs, standard (population) or log1p."""
    c = F.col(column)
    if how == "log1p":
        return df.withColumn(to, F.log1p(c))
    if how == "robust":
        q = quantiles(df, [], column, [0.25, 0.5, 0.75]).select(F.struct("q0", "q1", "q2")).scalar()
        return df.withColumn(to, F.try_divide(c - q["q1"], q["q2"] - q["q0"]))
    stats = {
        "minmax": {"a": F.min(c), "b": F.max(c) - F.min(c)},
        "maxabs": {"a": F.lit(0.0), "b": F.max(F.abs(c))},
        "standard": {"a": F.avg(c), "b": F.stddev_pop(c)},
    }[how]
    s = one_row(df, stats)
    return df.withColumn(to, F.try_divide(c - s["a"], s["b"]))


def unit_vectors(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """ML-15: rows divided by their Euclidean length, zero rows stay."""
    norm = F.sqrt(sum((F.col(c) * F.col(c) for c in columns[1:]), F.col(columns[0]) * F.col(columns[0])))
    return df.withColumns({c: F.when(norm > 0, F.col(c) / norm).otherwise(F.col(c)) for c in columns})


def imputed(df: DataFrame, columns: Sequence[str], how: str = "mean") -> DataFrame:
    """ML-1, 6, 45: nulls become the column's mean or median, 0 if it has none."""
    if how == "mean":
        s = one_row(df, {f"s{i}": F.avg(c) for i, c in enumerate(columns)})
        known = {c: s[f"s{i}"] for i, c in enumerate(columns)}
    else:
        known = {c: quantiles(df, [], c, [0.5]).select("q0").scalar() for c in columns}
    return df.withColumns({c: F.coalesce(F.col(c).cast("double"), known[c], F.lit(0.0)) for c in columns})


def varying(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """ML-20, 46: columns whose variance is above 0, in one pass."""
    r = df.agg(*[F.var_pop(c).alias(f"v{i}") for i, c in enumerate(columns)]).first()
    return [c for i, c in enumerate(columns) if (r[f"v{i}"] or 0) > 0]


def iqr_outliers(df: DataFrame, column: str, by: Sequence[str] = (), factor: float = 1.5) -> DataFrame:
    """ML-31: bounds from exact quartiles; Outlier beyond them."""
    c = F.col(column)
    found = quantiles(df, by, column, [0.25, 0.75]).select(*by, F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    joined = df.join(found, list(by)) if by else beside(df, found, by)
    wide = factor * (F.col("q3") - F.col("q1"))
    joined = joined.withColumns({"lower": F.col("q1") - wide, "upper": F.col("q3") + wide})
    return joined.withColumn("kind", F.when((c < F.col("lower")) | (c > F.col("upper")), "Outlier").otherwise("Inlier"))


def power_transform(df: DataFrame, column: str, kind: str, steps: int = 81) -> tuple[DataFrame, float]:
    """ML-12, 13: Box-Cox or Yeo-Johnson; the exponent maximises the
    log-likelihood on a grid over -2..2, all of it in one aggregate."""
    grid = [round(-2 + 4 * i / (steps - 1), 6) for i in range(steps)]
    x = F.col(column).cast("double")

    def power(l: float) -> Column:
        if kind == "boxcox":
            return F.log(x) if l == 0 else (F.pow(x, F.lit(l)) - 1) / l
        up = F.log1p(x) if l == 0 else (F.pow(x + 1, F.lit(l)) - 1) / l
        down = -F.log1p(-x) if l == 2 else -(F.pow(1 - x, F.lit(2 - l)) - 1) / (2 - l)
        return F.when(x >= 0, up).otherwise(down)

    slope = F.sum(F.log(x)) if kind == "boxcox" else F.sum(F.signum(x) * F.log1p(F.abs(x)))
    r = df.agg(F.count(x), slope, *[F.var_pop(power(l)) for l in grid]).first()
    best = max(range(steps), key=lambda i: -r[0] / 2 * math.log(r[2 + i]) + (grid[i] - 1) * r[1] if r[2 + i] else -math.inf)
    return df.withColumn(f"{column}_{kind}", power(grid[best])), grid[best]


def quantile_ranks(df: DataFrame, column: str, n: int = 100) -> DataFrame:
    """ML-14: position among n quantiles, 0..1, interpolated between them."""
    points = [i / (n - 1) for i in range(n)]
    row = quantiles(df, [], column, points).select(F.array(*[f"q{i}" for i in range(n)])).scalar()
    q, x = F.col("__q"), F.col(column)
    below = F.size(F.filter(q, lambda v: v <= x))
    lo, hi = F.get(q, below - 1), F.get(q, below)
    at = F.when(below == 0, 0.0).when(below >= n, 1.0).otherwise((below - 1 + F.coalesce(F.try_divide(x - lo, hi - lo), F.lit(0.0))) / (n - 1))
    return df.withColumn("__q", row).withColumn(f"{column}_rank", at).drop("__q")


def moments(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """ML-52: mean, population deviation, median, range, quartiles, skew, kurtosis."""
    c = F.col(column)
    plain = df.groupBy(*by).agg(
        F.avg(c).alias("mean"), F.stddev_pop(c).alias("sd"), F.min(c).alias("low"), F.max(c).alias("high"), (F.max(c) - F.min(c)).alias("spread"), F.skewness(c).alias("skew"), F.kurtosis(c).alias("kurtosis"),
    )
    return beside(plain, quantiles(df, by, column, [0.25, 0.5, 0.75]).select(*by, F.col("q0").alias("q25"), F.col("q1").alias("median"), F.col("q2").alias("q75")), by)


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """ML-41."""
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def weighted_scores(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """ML-42: accuracy and support-weighted precision, recall and F1 from the
    confusion counts; a class without predictions has precision 0."""
    cells = confusion(df, truth, predicted)
    t, p = F.col(truth), F.col(predicted)
    each = cells.select(F.inline(F.array(F.struct(t.alias("c"), F.col("n").alias("support"), F.lit(0).cast("long").alias("said"), F.when(t == p, F.col("n")).otherwise(0).alias("hit")), F.struct(p.alias("c"), F.lit(0).cast("long").alias("support"), F.col("n").alias("said"), F.lit(0).cast("long").alias("hit")))))
    one = each.groupBy("c").agg(*[F.sum(k).alias(k) for k in ("support", "said", "hit")]).where("support > 0")
    prec, rec = F.coalesce(F.try_divide(F.col("hit"), F.col("said")), F.lit(0.0)), F.col("hit") / F.col("support")
    f1 = F.coalesce(F.try_divide(2 * prec * rec, prec + rec), F.lit(0.0))
    w = F.col("support")
    return one.agg((F.sum("hit") / F.sum(w)).alias("accuracy"), (F.sum(prec * w) / F.sum(w)).alias("precision"), (F.sum(rec * w) / F.sum(w)).alias("recall"), (F.sum(f1 * w) / F.sum(w)).alias("f1"))


def cluster_quality(df: DataFrame, label: str, columns: Sequence[str]) -> DataFrame:
    """ML-29, 50: Calinski-Harabasz from within and between sums of squares; 0 for one cluster."""
    n, k = F.sum("n"), F.count("*")
    per = df.groupBy(label).agg(F.count("*").cast("double").alias("n"), *[F.avg(c).alias(f"m_{c}") for c in columns], sum((F.var_pop(c) for c in columns[1:]), F.var_pop(columns[0])).alias("v"))
    within = F.sum(F.col("n") * F.col("v"))
    between = sum((F.sum(F.col("n") * F.col(f"m_{c}") * F.col(f"m_{c}")) - F.pow(F.sum(F.col("n") * F.col(f"m_{c}")), F.lit(2)) / n for c in columns), F.lit(0.0))
    return per.agg(k.alias("clusters"), within.alias("within"), between.alias("between"), F.when(k > 1, F.coalesce(F.try_divide(between / (k - 1), within / (n - k)), F.lit(0.0))).otherwise(0.0).alias("calinski_harabasz"))


def exponential_fit(points: Sequence[tuple[float, float]], shift: float = 20.0, start: tuple[float, float] = (100.0, 0.1), rounds: int = 200) -> tuple[float, float]:
    """ML-35: least squares of y = a exp(b (x - shift)) by damped Gauss-Newton;
    the points are a small result, one per year."""
    x, y = (np.array(v, float) for v in zip(*points, strict=True))
    p, damp = np.array(start), 1e-3
    error = lambda q: float(((y - q[0] * np.exp(np.clip(q[1] * (x - shift), -50, 50))) ** 2).sum())
    for _ in range(rounds):
        e = np.exp(np.clip(p[1] * (x - shift), -50, 50))
        j = np.c_[e, p[0] * (x - shift) * e]
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), j.T @ (y - p[0] * e))
        if error(p + step) < error(p):
            p, damp = p + step, damp / 3
            if np.abs(step).max() < 1e-10:
                break
        else:
            damp *= 5
    return float(p[0]), float(p[1])
