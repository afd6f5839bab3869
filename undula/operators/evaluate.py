"""Scores of partitions: silhouette, Davies-Bouldin, contingency, adjusted Rand and mutual information, clustering loss."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from undula.operators.graph import euclidean, label_sums, symmetric


#: Centroids that go to every task.
MOST_CENTROIDS = 100_000


def centroids(points: DataFrame, label: str = "label") -> DataFrame:
    """(label, k, c): means by dimension; rows meet as partial sums."""
    return points.select(F.col(label).alias("label"), F.posexplode("z").alias("k", "v")).groupBy("label", "k").agg(F.avg("v").alias("c"))


def centroid_vectors(points: DataFrame, label: str = "label") -> DataFrame:
    return centroids(points, label).groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("c"))


def global_mean(points: DataFrame) -> DataFrame:
    return points.select(F.posexplode("z").alias("k", "v")).groupBy("k").agg(F.avg("v").alias("c"))


def _square(a: str, b: str):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def clustering_loss(points: DataFrame, cached: DataFrame | None = None, mean: DataFrame | None = None) -> DataFrame:
    """(loss): (2 sum |x - own centroid|^2 - sum |x - mean|^2) / (n dimensions); centroids and mean may be given, frozen."""
    cents = centroid_vectors(points) if cached is None else cached
    mu = global_mean(points) if mean is None else mean
    mu = mu.agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "c"))), lambda s: s["c"]).alias("mu"))
    return (
        points.join(cents, "label")
        .crossJoin(F.broadcast(mu))  # one row
        .agg(((2 * F.sum(_square("z", "c")) - F.sum(_square("z", "mu"))) / F.sum(F.size("z"))).alias("loss"))
    )


def nearest_centroid(points: DataFrame, cents: DataFrame) -> DataFrame:
    """(sample_id, label): the nearest of the given centroids, at most ``MOST_CENTROIDS``, packed into one row."""
    if cents.limit(MOST_CENTROIDS + 1).count() > MOST_CENTROIDS:
        raise ValueError("too many centroids to send them to every task")
    packed = cents.agg(F.collect_list(F.struct("label", "c")).alias("cs"))
    near = F.array_min(F.transform("cs", lambda c: F.struct(_square_of("z", c["c"]).alias("d"), c["label"].alias("label"))))
    return points.crossJoin(F.broadcast(packed)).select("sample_id", near["label"].alias("label"))  # one row


def _square_of(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v)


def cluster_sizes(points: DataFrame) -> DataFrame:
    return points.groupBy("label").agg(F.count(F.lit(1)).alias("size"))


def silhouette_samples(points: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(sample_id, label, s): (b - a) / max(a, b), 0 for members alone in their cluster.

    Distances of vectors are summed by cluster within pairs of blocks, so a row for each point, cluster and block moves;
    ``pairs`` (i, j, dist) may give other distances, of which each then goes to both its ends.
    """
    if pairs is None:
        sums = label_sums(points)
    else:
        of, to = (points.select(F.col("sample_id").alias(c), F.col("label").alias(n)) for c, n in (("i", "li"), ("j", "lj")))
        sums = symmetric(pairs).join(to, "j").join(of, "i").select("i", F.col("lj").alias("label"), (F.col("li") == F.col("lj")).alias("own"), F.col("dist").alias("sum"), F.lit(1).cast("long").alias("n"))
        sums = sums.unionByName(of.select("i", F.col("li").alias("label"), F.lit(True).alias("own"), F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")))
    return _silhouettes(sums, "i").select(F.col("i").alias("sample_id"), "label", "s")


def _silhouettes(sums: DataFrame, *by: str) -> DataFrame:
    """(by, label, s) from sums of distances by cluster."""
    each = sums.groupBy(*by, "label", "own").agg(F.try_divide(F.sum("sum"), F.sum("n")).alias("d"))
    ab = each.groupBy(*by).agg(F.max(F.when(F.col("own"), F.col("label"))).alias("label"), F.max(F.when(F.col("own"), F.col("d"))).alias("a"), F.min(F.when(~F.col("own"), F.col("d"))).alias("b"))
    s = F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0))
    return ab.select(*by, "label", F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0).otherwise(s).alias("s"))


def silhouette(points: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    return silhouette_samples(points, pairs).agg(F.avg("s").alias("silhouette"))


def silhouettes_of(points: DataFrame, labels: str) -> DataFrame:
    """(part, silhouette) of the partitions whose labels are the entries of an array column; distances are taken once."""
    return _silhouettes(label_sums(points, labels), "part", "i").groupBy("part").agg(F.avg("s").alias("silhouette"))


def davies_bouldin(points: DataFrame) -> DataFrame:
    """(davies_bouldin): mean over clusters of the largest (S_i + S_j) / |c_i - c_j|."""
    c = centroid_vectors(points)
    s = points.join(c, "label").groupBy("label").agg(F.avg(euclidean("z", "c")).alias("s"))
    k = c.join(s, "label")
    x, y = k.select(*(F.col(n).alias(f"{n}1") for n in ("label", "c", "s"))), k.select(*(F.col(n).alias(f"{n}2") for n in ("label", "c", "s")))
    worst = x.join(y, F.col("label1") != F.col("label2")).groupBy("label1").agg(F.max((F.col("s1") + F.col("s2")) / euclidean("c1", "c2")).alias("r"))
    return worst.agg(F.avg("r").alias("davies_bouldin"))


def contingency(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count(F.lit(1)).alias("n"))


def _pairs_of(c):
    return c * (c - 1) / 2


def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ari) from the contingency table, whose size is classes x clusters; 1 where both are trivial."""
    return rand_of(contingency(df, a, b))


def rand_of(t: DataFrame) -> DataFrame:
    """``adjusted_rand`` from a contingency table (a, b, n)."""
    one = lambda name, by: t.groupBy(by).agg(F.sum("n").alias("s")).agg(F.sum(_pairs_of(F.col("s"))).alias(name))
    cells = t.agg(F.sum(_pairs_of(F.col("n"))).alias("c"), _pairs_of(F.sum("n")).alias("all"))
    r = cells.crossJoin(one("ra", "a")).crossJoin(one("rb", "b"))  # single rows
    e = F.col("ra") * F.col("rb") / F.col("all")
    return r.select(F.coalesce(F.try_divide(F.col("c") - e, (F.col("ra") + F.col("rb")) / 2 - e), F.lit(1.0)).alias("ari"))


def log_gamma(x: Column) -> Column:
    """ln Gamma of x >= 1 by Stirling's series at x + 8, less the logarithm of x (x + 1) ... (x + 7)."""
    y = x + 8
    z = 1 / (y * y)
    series = (F.lit(1 / 12) - z * (F.lit(1 / 360) - z * (F.lit(1 / 1260) - z * (F.lit(1 / 1680) - z / 1188)))) / y
    rise = x
    for k in range(1, 8):
        rise = rise * (x + k)
    return (y - 0.5) * F.log(y) - y + 0.5 * float(np.log(2 * np.pi)) + series - F.log(rise)


def adjusted_mutual_information(df: DataFrame, a: str, b: str) -> DataFrame:
    """(ami) with the arithmetic normaliser; the expectation is over the hypergeometric model.

    For two classes of sizes a and b the count k in both lies around its mean a b / n, and beyond 6 sqrt(min(a, b)) of
    it with a probability of at most 2 exp(-72) (Hoeffding), which no double sum of logarithms up to ln n can show: the
    sum over k runs over that many whole numbers, away from the most likely one, in one row a pair of distinct class sizes.
    """
    return mutual_information_of(contingency(df, a, b), df.count())


def mutual_information_of(t: DataFrame, n: int | None = None) -> DataFrame:
    """``adjusted_mutual_information`` from a contingency table (a, b, n) of n rows, which five sums read."""
    spark = t.sparkSession
    n = (t.agg(F.sum("n")).first()[0] or 0) if n is None else n
    if n == 0:
        return spark.createDataFrame([(1.0,)], "ami double")
    rows = t.groupBy("a").agg(F.sum("n").alias("ai"))
    cols = t.groupBy("b").agg(F.sum("n").alias("bj"))
    mi = t.join(rows, "a").join(cols, "b").agg(F.sum(F.col("n") / n * F.log(F.lit(float(n)) * F.col("n") / (F.col("ai") * F.col("bj")))).alias("mi"))
    h = lambda d, c, name: d.agg((-F.sum(F.col(c) / n * F.log(F.col(c) / n))).alias(name))
    ra = rows.groupBy(F.col("ai").cast("double").alias("x")).agg(F.count(F.lit(1)).alias("cx"))
    rb = cols.groupBy(F.col("bj").cast("double").alias("y")).agg(F.count(F.lit(1)).alias("cy"))
    all_ = float(n)
    least, most = F.greatest(F.lit(1.0), F.col("x") + F.col("y") - all_), F.least("x", "y")
    mean, reach = F.col("x") * F.col("y") / all_, 6 * F.sqrt(F.least("x", "y")) + 1
    lo, hi = F.greatest(least, F.floor(mean - reach)).cast("long"), F.least(most, F.ceil(mean + reach)).cast("long")
    mode = F.greatest(lo, F.least(hi, F.floor((F.col("x") + 1) * (F.col("y") + 1) / (all_ + 2)).cast("long")))
    cells = ra.crossJoin(rb).select("x", "y", "cx", "cy", lo.alias("lo"), hi.alias("hi"), mode.alias("mode")).filter("lo <= hi")  # distinct class sizes
    k, x, y = F.col("mode").cast("double"), F.col("x"), F.col("y")
    log_p = log_gamma(x + 1) + log_gamma(y + 1) + log_gamma(all_ - x + 1) + log_gamma(all_ - y + 1) - log_gamma(F.lit(all_) + 1)
    log_p = log_p - log_gamma(k + 1) - log_gamma(x - k + 1) - log_gamma(y - k + 1) - log_gamma(all_ - x - y + k + 1)
    cells = cells.withColumn("p", F.exp(log_p))

    def walk(steps, up: bool):
        """The sum over ``steps``, away from the mode: each probability is a ratio times the one before."""

        def step(acc, i):
            j = i.cast("double")
            p = acc["p"] if up else acc["p"] * (j + 1) * (all_ - x - y + j + 1) / ((x - j) * (y - j))
            then = p * (x - j) * (y - j) / ((j + 1) * (all_ - x - y + j + 1)) if up else p
            return F.struct((acc["s"] + j / all_ * F.log(all_ * j / (x * y)) * p).alias("s"), then.alias("p"))

        return F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), F.col("p").alias("p")), step)["s"]

    above = walk(F.sequence("mode", "hi"), True)
    below = F.when(F.col("mode") > F.col("lo"), walk(F.sequence(F.col("mode") - 1, F.col("lo"), F.lit(-1).cast("long")), False)).otherwise(0.0)
    emi = cells.agg(F.sum(F.col("cx") * F.col("cy") * (above + below)).alias("emi"))
    one = mi.crossJoin(emi).crossJoin(h(rows, "ai", "ha")).crossJoin(h(cols, "bj", "hb"))  # single rows
    return one.select(F.coalesce(F.try_divide(F.col("mi") - F.col("emi"), (F.col("ha") + F.col("hb")) / 2 - F.col("emi")), F.lit(1.0)).alias("ami"))


def project_2d(points: DataFrame) -> DataFrame:
    """(sample_id, x, y): the two leading principal components of (sample_id, z)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    data = points.select("sample_id", array_to_vector("z").alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="p").fit(data).transform(data).withColumn("p", vector_to_array("p"))
    return out.select("sample_id", F.col("p")[0].alias("x"), F.col("p")[1].alias("y"))
