"""Normalisation, encoding and pointwise functions of curves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from undula.sources.curves import points

EPS = 2.220446049250313e-16


def encode_sorted(df: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Codes by sorted order, from the small set of distinct labels; the rows aren't shuffled for it."""
    codes = df.select(label).distinct().select(label, (F.dense_rank().over(Window.orderBy(label)) - 1).cast("int").alias(out))
    return df.join(codes, label)


def encode_first_seen(df: DataFrame, label: str, order: str, out: str = "label_code") -> DataFrame:
    """Codes by first appearance in the order of ``order``."""
    first = df.groupBy(label).agg(F.min(order).alias("__first"))
    codes = first.select(label, (F.dense_rank().over(Window.orderBy("__first", label)) - 1).cast("int").alias(out))
    return df.join(codes, label)


def numeric_labels(df: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Text labels by sorted order; numbers as whole numbers, not made compact."""
    if dict(df.dtypes)[label] in ("string", "binary", "boolean"):
        return encode_sorted(df, label, out)
    return df.withColumn(out, F.col(label).cast("int"))


def rescale(curves: DataFrame) -> DataFrame:
    """All values to [-1, 1] by the least and greatest of the whole collection; one value everywhere gives 0."""
    ends = curves.agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    return curves.crossJoin(F.broadcast(ends)).select(  # one row
        "sample_id", "feature", F.transform("values", lambda v: F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)) * 2 - 1).alias("values")
    )


def standard_stats(curves: DataFrame, eps: float = 1e-8) -> DataFrame:
    """(feature, t_idx, mean, std): moments over samples, std with ``eps`` added; features x steps rows."""
    return points(curves).groupBy("feature", "t_idx").agg(F.avg("value").alias("mean"), (F.sqrt(F.var_pop("value")) + eps).alias("std"))


def standardize(curves: DataFrame, eps: float = 1e-8) -> DataFrame:
    """Curves less the mean and over the deviation of each (feature, time).

    The statistics come back as one pair of arrays a feature, so curves are neither exploded nor shuffled again.
    """
    s = standard_stats(curves, eps).groupBy("feature").agg(F.array_sort(F.collect_list(F.struct("t_idx", "mean", "std"))).alias("s"))
    return curves.join(s, "feature").select("sample_id", "feature", F.zip_with("values", "s", lambda v, m: (v - m["mean"]) / m["std"]).alias("values"))


def zscore(curves: DataFrame) -> DataFrame:
    """Curves over the moments of their feature, all samples and times together; per-curve sums are combined, nothing is exploded."""
    sums = curves.select(
        "feature",
        F.size("values").cast("double").alias("n"),
        F.aggregate("values", F.lit(0.0), lambda a, v: a + v).alias("s"),
    )
    mean = sums.groupBy("feature").agg((F.sum("s") / F.sum("n")).alias("mu"))
    dev = curves.join(mean, "feature").select("feature", "mu", F.size("values").cast("double").alias("n"), F.aggregate("values", F.lit(0.0), lambda a, v: a + (v - F.col("mu")) * (v - F.col("mu"))).alias("q"))
    stat = dev.groupBy("feature").agg(F.first("mu").alias("mu"), (F.sqrt(F.sum("q") / F.sum("n")) + EPS).alias("sd"))
    return curves.join(stat, "feature").select("sample_id", "feature", F.transform("values", lambda v: (v - F.col("mu")) / F.col("sd")).alias("values"))


def gradient(values: str | Column, step: Column) -> Column:
    """Central differences, one-sided at the ends, of an array on an even grid."""
    x = F.col(values) if isinstance(values, str) else values
    n = F.size(x)
    at = lambda i: F.get(x, i)
    return F.transform(
        x,
        lambda v, i: F.when(i == 0, (at(i + 1) - v) / step).when(i == n - 1, (v - at(i - 1)) / step).otherwise((at(i + 1) - at(i - 1)) / (2 * step)),
    )


def srvf(curves: DataFrame) -> DataFrame:
    """(sample_id, feature, values): square-root velocities, gradients over the root of the speed across features."""
    g = curves.select("sample_id", "feature", gradient("values", F.lit(1.0) / (F.size("values") - 1)).alias("g"))
    rows = g.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature", "g"))).alias("fs"))
    steps = F.sequence(F.lit(0), F.size(F.col("fs")[0]["g"]) - 1)
    speed = F.transform(steps, lambda t: F.sqrt(F.sqrt(F.aggregate("fs", F.lit(0.0), lambda a, f: a + F.get(f["g"], t) * F.get(f["g"], t))) + EPS))
    return rows.withColumn("speed", speed).select("sample_id", F.explode("fs").alias("f"), "speed").select("sample_id", F.col("f.feature").alias("feature"), F.zip_with("f.g", "speed", lambda a, b: a / b).alias("values"))


def coarsen(values: str) -> Column:
    """Means of neighbouring pairs; an odd tail is dropped."""
    return F.transform(F.sequence(F.lit(0), F.floor(F.size(values) / 2).cast("int") - 1), lambda k: (F.get(values, k * 2) + F.get(values, k * 2 + 1)) / 2)


def resample(values: str, n: int) -> Column:
    """Linear interpolation at ``n`` even places from the first value to the last."""
    last = F.size(values) - 1

    def at(k):
        x = k * last / F.lit(float(n - 1))
        i = F.least(F.floor(x).cast("int"), last - 1)
        return F.get(values, i) * (1 - (x - i)) + F.get(values, i + 1) * (x - i)

    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), at)


def trapezoid(values: str | Column, step: Column) -> Column:
    """The integral of an array on an even grid."""
    x = F.col(values) if isinstance(values, str) else values
    return (F.aggregate(x, F.lit(0.0), lambda a, v: a + v) - (F.get(x, F.lit(0)) + F.element_at(x, -1)) / 2) * step


def second_difference(values: str) -> Column:
    """The mean absolute second difference of an array."""
    n = F.size(values) - 2
    parts = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.abs(F.get(values, k) - 2 * F.get(values, k + 1) + F.get(values, k + 2)))
    return F.aggregate(parts, F.lit(0.0), lambda a, v: a + v) / n


def layer_norm(curves: DataFrame, eps: float = 1e-10) -> DataFrame:
    """Each sample over its own moments, all features and times together."""
    s = points(curves).groupBy("sample_id").agg(F.avg("value").alias("mu"), F.var_pop("value").alias("var"))
    return curves.join(s, "sample_id").select("sample_id", "feature", F.transform("values", lambda v: (v - F.col("mu")) / F.sqrt(F.col("var") + eps)).alias("values"))


def mad_sigma(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by, sigma): the noise scale by median absolute deviation."""
    mid = df.groupBy(*by).agg(F.percentile(value, F.lit(0.5)).alias("__m"))
    return df.join(mid, by).groupBy(*by).agg((F.percentile(F.abs(F.col(value) - F.col("__m")), F.lit(0.5)) / 0.6745 + 1e-12).alias("sigma"))


def rolling_mean(df: DataFrame, value: str, order: str, window: int, by: list[str]) -> DataFrame:
    """(by, order, mean) of full windows only."""
    w = Window.partitionBy(*by).orderBy(order)
    return (
        df.withColumn("__n", F.row_number().over(w))
        .withColumn("mean", F.avg(value).over(w.rowsBetween(1 - window, 0)))
        .filter(F.col("__n") >= window)
        .select(*by, order, "mean")
    )


def rolling_window(n: int) -> int:
    """The window for a curve of n values: a tenth of them, between 1 and 10."""
    return min(10, max(1, n // 10))
