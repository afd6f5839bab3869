"""The library's registered queries over the driver's tables, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from undula.functions import manifolds, normalise
from undula.operators import autoencoder, baselines, cluster, distance, evaluate, graph, nearest, smoothing
from undula.plans import paths, runner, sql
from undula.sources import curves as src
from undula.sources import generators
from undula.sources.shared import dropped, new_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

STEPS = 30
M = 6

#: Points of the event curves: p(s, f, t, v).
P = f"""WITH ty AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS f FROM (SELECT DISTINCT event_type FROM events)),
d0 AS (SELECT min(ts::date) AS d FROM events),
ce AS (SELECT user_id AS s, f, date_diff('day', d0.d, ts::date) AS t, sum(value) AS v FROM events JOIN ty USING (event_type), d0 GROUP BY ALL),
gr AS (SELECT s, f, t FROM (SELECT DISTINCT user_id AS s FROM events), (SELECT f FROM ty), (SELECT unnest(range({STEPS})) AS t)),
p AS (SELECT gr.s, gr.f, gr.t, coalesce(ce.v, 0.0::double) AS v FROM gr LEFT JOIN ce USING (s, f, t))"""
#: z-scored points z, gradients g and square-root velocities q on top of P.
Q = f"""{P},
zs AS (SELECT f, avg(v) AS mu, stddev_pop(v) AS sd FROM p GROUP BY f),
z AS (SELECT s, f, t, (v - mu) / (sd + 2.220446049250313e-16) AS v FROM p JOIN zs USING (f)),
g AS (SELECT s, f, t, CASE WHEN t = 0 THEN (lead(v) OVER w - v) / h WHEN t = {STEPS - 1} THEN (v - lag(v) OVER w) / h ELSE (lead(v) OVER w - lag(v) OVER w) / (2 * h) END AS v
      FROM z, (SELECT 1.0::double / {STEPS - 1} AS h) WINDOW w AS (PARTITION BY s, f ORDER BY t)),
sp AS (SELECT s, t, sqrt(sqrt(sum(v * v)) + 2.220446049250313e-16) AS r FROM g GROUP BY s, t),
q AS (SELECT s, f, t, v / r AS v FROM g JOIN sp USING (s, t))"""
#: Long embeddings e(i, k, x), pairs d(i, j, dist), symmetric sy and ranked kn on top.
E = """WITH e AS (SELECT vec_id AS i, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings),
d AS (SELECT a.i, b.i AS j, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist FROM e a JOIN e b ON a.k = b.k AND a.i < b.i GROUP BY a.i, b.i),
sy AS (SELECT i, j, dist FROM d UNION ALL SELECT j, i, dist FROM d),
kn AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS r FROM sy)"""


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def _events(spark, d) -> DataFrame:
    return src.from_events(spark, d, STEPS)


def _long(curves: DataFrame, name: str = "value", digits: int = 6) -> DataFrame:
    return src.points(curves).select("sample_id", "feature", "t_idx", F.round("value", digits).alias(name))


def _out(f: str = "v", table: str = "p", digits: int = 6) -> str:
    return f"SELECT s AS sample_id, f AS feature, t AS t_idx, round({f}, {digits}) AS value FROM {table}"


@query("curves_dense", f"{P} {_out()}")
def curves_dense(spark, d):
    return _long(_events(spark, d))


@query("rescale_global", f"{P} {_out('coalesce((v - lo) / nullif(hi - lo, 0), 0.5) * 2 - 1', 'p, (SELECT min(v) AS lo, max(v) AS hi FROM p)')}")
def rescale_global(spark, d):
    return _long(normalise.rescale(_events(spark, d)))


@query("label_encode_sorted", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS label_code FROM orders")
def label_encode_sorted(spark, d):
    return normalise.encode_sorted(spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority"), "o_orderpriority").select("o_orderkey", "label_code")


@query(
    "label_encode_first_seen",
    "WITH m AS (SELECT event_type, min(event_id) AS e FROM events GROUP BY event_type), c AS (SELECT event_type, dense_rank() OVER (ORDER BY e, event_type) - 1 AS label_code FROM m) SELECT event_id, label_code FROM events JOIN c USING (event_type)",
)
def label_encode_first_seen(spark, d):
    return normalise.encode_first_seen(spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type"), "event_type", "event_id").select("event_id", "label_code")


@query("standardize_stats", f"{P} SELECT f AS feature, t AS t_idx, round(avg(v), 6) AS mean, round(sqrt(var_pop(v)) + 1e-8, 6) AS std FROM p GROUP BY f, t")
def standardize_stats(spark, d):
    return normalise.standard_stats(_events(spark, d)).select("feature", "t_idx", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("standardize_functional", f"{P}, st AS (SELECT f, t, avg(v) AS mu, sqrt(var_pop(v)) + 1e-8 AS sd FROM p GROUP BY f, t) {_out('(v - mu) / sd', 'p JOIN st USING (f, t)', 5)}")
def standardize_functional(spark, d):
    return _long(normalise.standardize(_events(spark, d)), digits=5)


@query("zscore_feature", f"{Q} {_out(table='z')}")
def zscore_feature(spark, d):
    return _long(normalise.zscore(_events(spark, d)))


@query("srvf", f"{Q} {_out(table='q', digits=5)}")
def srvf(spark, d):
    return _long(normalise.srvf(normalise.zscore(_events(spark, d))), digits=5)


@query("gradient", f"{Q} {_out(table='g', digits=5)}")
def gradient(spark, d):
    z = normalise.zscore(_events(spark, d))
    return _long(z.select("sample_id", "feature", normalise.gradient("values", F.lit(1.0) / (F.size("values") - 1)).alias("values")), digits=5)


@query("coarsen_pairs", f"{P} SELECT s AS sample_id, f AS feature, t // 2 AS t_idx, round(avg(v), 6) AS value FROM p WHERE t < {STEPS // 2 * 2} GROUP BY s, f, t // 2")
def coarsen_pairs(spark, d):
    return _long(_events(spark, d).select("sample_id", "feature", normalise.coarsen("values").alias("values")))


@query(
    "resample_linear",
    f"{P}, n AS (SELECT k, k * {STEPS - 1} / 19.0::double AS x, least(floor(k * {STEPS - 1} / 19.0::double)::int, {STEPS - 2}) AS lo FROM (SELECT unnest(range(20)) AS k)) SELECT a.s AS sample_id, a.f AS feature, k AS t_idx, round(a.v * (1 - (x - lo)) + b.v * (x - lo), 6) AS value FROM n JOIN p a ON a.t = lo JOIN p b ON b.s = a.s AND b.f = a.f AND b.t = lo + 1",
)
def resample_linear(spark, d):
    return _long(_events(spark, d).select("sample_id", "feature", normalise.resample("values", 20).alias("values")))


@query("trapz_energy", f"{Q}, en AS (SELECT s, t, sum(v * v) AS v FROM q GROUP BY s, t) SELECT s AS sample_id, round(sum(v * CASE WHEN t IN (0, {STEPS - 1}) THEN 0.5 ELSE 1.0 END) / {STEPS - 1}, 5) AS energy FROM en GROUP BY s")
def trapz_energy(spark, d):
    q = normalise.srvf(normalise.zscore(_events(spark, d)))
    per = q.select("sample_id", normalise.trapezoid(F.transform("values", lambda v: v * v), F.lit(1.0) / (F.size("values") - 1)).alias("e"))
    return per.groupBy("sample_id").agg(F.round(F.sum("e"), 5).alias("energy"))


@query("second_difference", f"{P}, dd AS (SELECT s, f, t, v - 2 * lead(v) OVER w + lead(v, 2) OVER w AS x FROM p WINDOW w AS (PARTITION BY s, f ORDER BY t)) SELECT s AS sample_id, f AS feature, round(avg(abs(x)), 6) AS roughness FROM dd WHERE x IS NOT NULL GROUP BY s, f")
def second_difference(spark, d):
    return _events(spark, d).select("sample_id", "feature", F.round(normalise.second_difference("values"), 6).alias("roughness"))


@query("layer_norm", f"{P}, st AS (SELECT s, avg(v) AS mu, var_pop(v) AS va FROM p GROUP BY s) {_out('(v - mu) / sqrt(va + 1e-10)', 'p JOIN st USING (s)')}")
def layer_norm(spark, d):
    return _long(normalise.layer_norm(_events(spark, d)))


@query("rolling_mean", f"{P}, r AS (SELECT s, f, t, avg(v) OVER (PARTITION BY s, f ORDER BY t ROWS 4 PRECEDING) AS m, row_number() OVER (PARTITION BY s, f ORDER BY t) AS n FROM p) SELECT s AS sample_id, f AS feature, t AS t_idx, round(m, 6) AS mean FROM r WHERE n >= 5")
def rolling_mean(spark, d):
    return normalise.rolling_mean(src.points(_events(spark, d)), "value", "t_idx", 5, ["sample_id", "feature"]).select("sample_id", "feature", "t_idx", F.round("mean", 6).alias("mean"))


_W = normalise.rolling_window(STEPS)


@query("rolling_mean_by_rule", f"{P}, r AS (SELECT s, f, t, avg(v) OVER (PARTITION BY s, f ORDER BY t ROWS {_W - 1} PRECEDING) AS m, row_number() OVER (PARTITION BY s, f ORDER BY t) AS n FROM p) SELECT s AS sample_id, f AS feature, t AS t_idx, round(m, 6) AS mean FROM r WHERE n >= least(10, greatest(1, {STEPS} // 10))")
def rolling_mean_by_rule(spark, d):
    return normalise.rolling_mean(src.points(_events(spark, d)), "value", "t_idx", _W, ["sample_id", "feature"]).select("sample_id", "feature", "t_idx", F.round("mean", 6).alias("mean"))


@query("mad_sigma", f"{P}, m AS (SELECT s, f, median(v) AS m FROM p GROUP BY s, f) SELECT s AS sample_id, f AS feature, round(median(abs(v - m)) / 0.6745 + 1e-12, 6) AS sigma FROM p JOIN m USING (s, f) GROUP BY s, f")
def mad_sigma(spark, d):
    return normalise.mad_sigma(src.points(_events(spark, d)), "value", ["sample_id", "feature"]).select("sample_id", "feature", F.round("sigma", 6).alias("sigma"))


_WIDE = [f"f{f}_t{t}" for f in range(5) for t in range(STEPS)]


@query("wide_pivot", f"{P} SELECT s AS sample_id, " + ", ".join(f"round(max(CASE WHEN f = {f} AND t = {t} THEN v END), 6) AS f{f}_t{t}" for f in range(5) for t in range(STEPS)) + " FROM p GROUP BY s")
def wide_pivot(spark, d):
    return src.wide(_events(spark, d)).select("sample_id", *(F.round(n, 6).alias(n) for n in _WIDE))


#: Curves whose samples are numbered by the order of their ids, with a label.
_NUMBERED = f"{P}, nu AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT s FROM p))"


@query("csv_round_trip", f"{_NUMBERED} SELECT i AS sample_id, f AS feature, t AS t_idx, round(v, 6) AS value, (s % 3)::varchar AS label FROM p JOIN nu USING (s)")
def csv_round_trip(spark, d):
    c, path = _events(spark, d), new_path(spark, "csv")
    src.save_wide(c, c.select("sample_id", (F.col("sample_id") % 3).alias("label")).distinct(), path)
    back, labels = src.load_wide(spark, path, 5, STEPS)
    return _long(back).join(labels, "sample_id")


def _text_file(spark, name: str, lines: DataFrame) -> str:
    """``lines`` (n, value) as one text file, in the order of n."""
    path = new_path(spark, name)
    lines.orderBy("n").select("value").coalesce(1).write.text(path)
    return path


@query("ts_round_trip", f"{_NUMBERED} SELECT i + 1 AS row_id, f AS feature, t AS t_idx, round(v, 6) AS value, 'u' || s % 3 AS label FROM p JOIN nu USING (s)")
def ts_round_trip(spark, d):
    rows = _events(spark, d).groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("feature", "values"))).alias("x"))
    line = F.concat_ws(":", F.transform("x", lambda f: F.concat_ws(",", f["values"].cast("array<string>"))), F.concat(F.lit("u"), F.col("sample_id") % 3))
    lines = rows.select(F.col("sample_id").alias("n"), line.alias("value")).unionByName(spark.createDataFrame([(-1, "@problemName events")], "n long, value string"))
    curves, labels = src.load_ts(spark, _text_file(spark, "ts", lines))
    return src.points(curves).join(labels, "sample_id").select(F.col("sample_id").alias("row_id"), "feature", "t_idx", F.round("value", 6).alias("value"), "label")


#: A row of the file is a feature of a sample, in the order of (feature, sample).
@query(
    "arff_round_trip",
    f"{_NUMBERED}, nn AS (SELECT count(*) AS n FROM nu), q AS (SELECT *, min(v) OVER () AS lo, max(v) OVER () AS hi FROM p), la AS (SELECT s % 3 AS c, row_number() OVER (ORDER BY min(s)) - 1 AS label FROM nu GROUP BY 1) SELECT f * n + i + 3 AS row_id, t AS t_idx, round(coalesce((v - lo) / nullif(hi - lo, 0), 0.5) * 2 - 1, 6) AS value, label FROM q JOIN nu USING (s) JOIN la ON c = s % 3, nn",
)
def arff_round_trip(spark, d):
    rows = _events(spark, d)
    most = rows.agg(F.max("sample_id")).first()[0]
    rows = rows.select((F.col("feature") * (most + 1) + F.col("sample_id")).alias("n"), F.concat_ws(",", F.col("values").cast("array<string>"), F.concat(F.lit("u"), F.col("sample_id") % 3)).alias("value"))
    head = spark.createDataFrame([(-3, "@relation events"), (-2, "% a comment"), (-1, "@data")], "n long, value string")
    curves, labels = src.load_arff(spark, _text_file(spark, "arff", rows.unionByName(head)))
    return src.points(curves).join(labels, "sample_id").select(F.col("sample_id").alias("row_id"), "t_idx", F.round("value", 6).alias("value"), "label")


@query("numeric_labels", "SELECT o_orderkey, dense_rank() OVER (ORDER BY o_orderpriority) - 1 AS text_code, o_custkey % 7 AS number_code FROM orders")
def numeric_labels(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", "o_orderpriority", (F.col("o_custkey") % 7).alias("digit"))
    return normalise.numeric_labels(normalise.numeric_labels(o, "o_orderpriority", "text_code"), "digit", "number_code").select("o_orderkey", "text_code", "number_code")


@query("supplier_curves", "WITH fl AS (SELECT l_returnflag, row_number() OVER (ORDER BY l_returnflag) - 1 AS f FROM (SELECT DISTINCT l_returnflag FROM lineitem)), mo AS (SELECT min(year(l_shipdate) * 12 + month(l_shipdate)) AS m0, max(year(l_shipdate) * 12 + month(l_shipdate)) AS m1 FROM lineitem), ce AS (SELECT l_suppkey AS s, f, year(l_shipdate) * 12 + month(l_shipdate) - m0 AS t, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem JOIN fl USING (l_returnflag), mo GROUP BY ALL), gr AS (SELECT s, f, t FROM (SELECT DISTINCT l_suppkey AS s FROM lineitem), (SELECT f FROM fl), (SELECT unnest(range((SELECT m1 - m0 + 1 FROM mo))) AS t)) SELECT s AS sample_id, f AS feature, t AS t_idx, round(coalesce(v, 0), 4) AS value FROM gr LEFT JOIN ce USING (s, f, t)")
def supplier_curves(spark, d):
    return _long(src.from_lineitem(spark, d), digits=4)


# --- pairs and graphs -----------------------------------------------------------------------------------------


def _pairs(spark, d) -> DataFrame:
    return graph.euclidean_pairs(src.latent(spark, d))


def _knn(spark, d, m: int | None = M) -> DataFrame:
    return graph.nearest_points(_nodes(spark, d), m) if m else graph.neighbours(_pairs(spark, d))


def _nodes(spark, d) -> DataFrame:
    return src.latent(spark, d)


@query("pairwise_euclidean", f"{E} SELECT i, j, round(dist, 6) AS dist FROM d")
def pairwise_euclidean(spark, d):
    return _pairs(spark, d).select("i", "j", F.round("dist", 6).alias("dist"))


@query("distance_symmetric", f"{E} SELECT i, count(*) AS n, round(sum(dist), 5) AS total FROM sy GROUP BY i")
def distance_symmetric(spark, d):
    return graph.distance_totals(_nodes(spark, d)).select("i", "n", F.round("total", 5).alias("total"))


@query("most_similar", f"{E} SELECT i, j, round(dist, 6) AS dist FROM d ORDER BY d.dist, i, j LIMIT 1")
def most_similar(spark, d):
    return graph.extreme_of_points(_nodes(spark, d)).select("i", "j", F.round("dist", 6).alias("dist"))


@query("most_different", f"{E} SELECT i, j, round(dist, 6) AS dist FROM d ORDER BY d.dist DESC, i, j LIMIT 1")
def most_different(spark, d):
    return graph.extreme_of_points(_nodes(spark, d), far=True).select("i", "j", F.round("dist", 6).alias("dist"))


@query("knn", f"{E} SELECT i, r AS rank, j, round(dist, 6) AS dist FROM kn WHERE r <= {M}")
def knn(spark, d):
    return _knn(spark, d).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


@query("knn_pivots", f"{E} SELECT i, r AS rank, j, round(dist, 6) AS dist FROM kn WHERE r <= {M}")
def knn_pivots(spark, d):
    return nearest.by_pivots(_nodes(spark, d), M).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


@query("avg_mth_distance", f"{E} SELECT r AS m, round(avg(dist), 6) AS avg_dist FROM kn GROUP BY r")
def avg_mth_distance(spark, d):
    return graph.mean_by_rank(_nodes(spark, d)).select("m", F.round("avg_dist", 6).alias("avg_dist"))


@query(
    "optimal_m_avg_distance",
    f"{E}, c AS (SELECT r AS m, avg(dist) AS a FROM kn GROUP BY r), n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT m, (lead(a) OVER (ORDER BY m) - a) / (a + 1e-12) AS jump FROM c) SELECT m + 1 AS m FROM s, n WHERE jump IS NOT NULL AND m <= greatest(2, least(n.n - 2, n.n // 4)) ORDER BY jump DESC, m LIMIT 1",
)
def optimal_m_avg_distance(spark, d):
    return spark.createDataFrame([(graph.optimal_m_of_points(_nodes(spark, d)),)], "m int")


@query("similarity_neighbors", f"{E}, k AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b, dist FROM kn WHERE r <= {M}) SELECT a AS i, b AS j, round(exp(-dist), 6) AS w FROM k UNION ALL SELECT b, a, round(exp(-dist), 6) FROM k")
def similarity_neighbors(spark, d):
    return graph.similarity(_pairs(spark, d), _knn(spark, d)).select("i", "j", F.round("w", 6).alias("w"))


@query("similarity_distance", f"{E} SELECT i, j, round(exp(-dist), 6) AS w FROM sy")
def similarity_distance(spark, d):
    return graph.similarity(_pairs(spark, d), method="distance").select("i", "j", F.round("w", 6).alias("w"))


@query("edges_unique", f"{E} SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j, round(exp(-dist), 6) AS w FROM kn WHERE r <= {M}")
def edges_unique(spark, d):
    return graph.edges(_knn(spark, d)).select("i", "j", F.round("w", 6).alias("w"))


@query("graph_sparsity", f"{E}, k AS (SELECT DISTINCT least(i, j) AS a, greatest(i, j) AS b FROM kn WHERE r <= {M}) SELECT round(2.0::double * count(*) / ((SELECT count(*) FROM embeddings) * (SELECT count(*) FROM embeddings)), 8) AS sparsity FROM k")
def graph_sparsity(spark, d):
    return graph.sparsity(graph.edges(_knn(spark, d)), _nodes(spark, d).count()).select(F.round("sparsity", 8).alias("sparsity"))


@query("intra_inter", f"{E}, l AS (SELECT vec_id, label FROM embeddings) SELECT round(avg(CASE WHEN a.label = b.label THEN dist END), 6) AS intra, round(avg(CASE WHEN a.label <> b.label THEN dist END), 6) AS inter FROM d JOIN l a ON a.vec_id = d.i JOIN l b ON b.vec_id = d.j")
def intra_inter(spark, d):
    r = graph.class_distances(_nodes(spark, d))
    return r.select(F.round("intra", 6).alias("intra"), F.round("inter", 6).alias("inter"))


#: Components of the graphs of the first ranks; once there is one, there is one for every larger m.
_RANKS = 16
_CM = (
    f"{E}, ed AS (SELECT r, i, j FROM kn WHERE r <= {_RANKS}), ms AS (SELECT unnest(range(1, {_RANKS + 1})) AS m), un AS (SELECT m, i, j FROM ed JOIN ms ON r <= m UNION SELECT m, j, i FROM ed JOIN ms ON r <= m), "
    "re AS (SELECT * FROM (WITH RECURSIVE re(m, i, c) AS (SELECT m, vec_id, vec_id FROM embeddings, ms UNION SELECT re.m, un.j, re.c FROM re JOIN un ON un.m = re.m AND un.i = re.i WHERE re.c < un.j) SELECT m, i, min(c) AS c FROM re GROUP BY m, i)), "
    f"cm AS (SELECT m, count(*) FILTER (WHERE c = i) AS components FROM re GROUP BY m UNION ALL SELECT k, (SELECT CASE WHEN count(*) FILTER (WHERE c = i) = 1 THEN 1 END FROM re WHERE m = {_RANKS}) FROM (SELECT unnest(range({_RANKS + 1}, (SELECT count(*) FROM embeddings))) AS k))"
)


@query("components_at_m", f"{_CM} SELECT m, components FROM cm")
def components_at_m(spark, d):
    return graph.components_of_points(_nodes(spark, d))


@query("optimal_m_connectivity", f"{_CM} SELECT min(m) AS m, greatest(5, least(min(m), (SELECT count(*) FROM embeddings) // 5)) AS capped FROM cm WHERE components = 1")
def optimal_m_connectivity(spark, d):
    m = graph.first_connected(graph.components_of_points(_nodes(spark, d)))
    return spark.createDataFrame([(m, graph.capped_m(m, _nodes(spark, d).count()))], "m int, capped int")


@query("knn_default_m", f"{E}, c AS (SELECT r AS m, avg(dist) AS a FROM kn GROUP BY r), n AS (SELECT count(*) AS n FROM embeddings), s AS (SELECT m, (lead(a) OVER (ORDER BY m) - a) / (a + 1e-12) AS jump FROM c), o AS (SELECT m + 1 AS m FROM s, n WHERE jump IS NOT NULL AND m <= greatest(2, least(n.n - 2, n.n // 4)) ORDER BY jump DESC, s.m LIMIT 1) SELECT i, r AS rank, j, round(dist, 6) AS dist FROM kn, o WHERE r <= o.m")
def knn_default_m(spark, d):
    z = _nodes(spark, d)
    return graph.nearest_points(z, graph.optimal_m_of_points(z)).select("i", "rank", "j", F.round("dist", 6).alias("dist"))


@query("matrix_check", "SELECT count(*) AS points FROM embeddings")
def matrix_check(spark, d):
    return spark.createDataFrame([(graph.check_points(_nodes(spark, d)),)], "points int")


@query("class_sorted_matrix", f"{E}, pl AS (SELECT vec_id, row_number() OVER (ORDER BY label, vec_id) - 1 AS o FROM embeddings) SELECT a.o AS row, b.o AS col, round(dist, 6) AS dist FROM sy JOIN pl a ON a.vec_id = sy.i JOIN pl b ON b.vec_id = sy.j UNION ALL SELECT o, o, 0.0 FROM pl")
def class_sorted_matrix(spark, d):
    return graph.points_by_class(_nodes(spark, d)).select("row", "col", F.round("dist", 6).alias("dist"))


@query("edge_differences", f"{E}, k AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM kn WHERE r <= {M}) SELECT k.i, k.j, round(sum(abs(a.x - b.x)), 5) AS l1 FROM k JOIN e a ON a.i = k.i JOIN e b ON b.i = k.j AND a.k = b.k GROUP BY k.i, k.j")
def edge_differences(spark, d):
    e = graph.difference(graph.edges(_knn(spark, d)), _nodes(spark, d))
    return e.select("i", "j", F.round(F.aggregate("d", F.lit(0.0), lambda s, v: s + F.abs(v)), 5).alias("l1"))


@query("edge_divergence", f"{E}, k AS (SELECT DISTINCT least(i, j) AS i, greatest(i, j) AS j FROM kn WHERE r <= {M}), df AS (SELECT k.i, k.j, a.k, a.x - b.x AS x FROM k JOIN e a ON a.i = k.i JOIN e b ON b.i = k.j AND a.k = b.k), s AS (SELECT i AS n, k, x FROM df UNION ALL SELECT j, k, -x FROM df) SELECT n AS sample_id, k, round(sum(x), 5) AS v FROM s GROUP BY n, k")
def edge_divergence(spark, d):
    z = graph.divergence(graph.difference(graph.edges(_knn(spark, d)), _nodes(spark, d)))
    return z.select("sample_id", F.posexplode("z").alias("k", "x")).select("sample_id", "k", F.round("x", 5).alias("v"))


# --- evaluation -----------------------------------------------------------------------------------------------


@query("centroids", "SELECT label, k, round(avg(x), 6) AS c FROM (SELECT label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings) GROUP BY label, k")
def centroids(spark, d):
    return evaluate.centroids(_nodes(spark, d)).select("label", "k", F.round("c", 6).alias("c"))


@query("global_mean", "SELECT k, round(avg(x), 6) AS c FROM (SELECT unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings) GROUP BY k")
def global_mean(spark, d):
    return evaluate.global_mean(_nodes(spark, d)).select("k", F.round("c", 6).alias("c"))


@query("clustering_loss", "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings), c AS (SELECT label, k, avg(x) AS c FROM e GROUP BY label, k), g AS (SELECT k, avg(x) AS g FROM e GROUP BY k) SELECT round((2 * sum((x - c) * (x - c)) - sum((x - g) * (x - g))) / count(*), 6) AS loss FROM e JOIN c USING (label, k) JOIN g USING (k)")
def clustering_loss(spark, d):
    return evaluate.clustering_loss(_nodes(spark, d)).select(F.round("loss", 6).alias("loss"))


_FROZEN = "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings), c AS (SELECT label, k, avg(x) AS c FROM e WHERE vec_id % 2 = 0 GROUP BY label, k), g AS (SELECT k, avg(x) AS g FROM e WHERE vec_id % 2 = 0 GROUP BY k)"


@query("clustering_loss_cached", f"{_FROZEN} SELECT round((2 * sum((x - c) * (x - c)) - sum((x - g) * (x - g))) / count(*), 6) AS loss FROM e JOIN c USING (label, k) JOIN g USING (k)")
def clustering_loss_cached(spark, d):
    """All points against centroids that were computed before, from every second one."""
    n = _nodes(spark, d)
    old = n.filter("sample_id % 2 = 0")
    return evaluate.clustering_loss(n, evaluate.centroid_vectors(old), evaluate.global_mean(old)).select(F.round("loss", 6).alias("loss"))


@query("cluster_sizes", "SELECT label, count(*) AS size FROM embeddings GROUP BY label")
def cluster_sizes(spark, d):
    return evaluate.cluster_sizes(_nodes(spark, d))


@query("nearest_centroid", "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings), c AS (SELECT label AS cl, k, avg(x) AS c FROM e GROUP BY label, k), d AS (SELECT vec_id, cl, sum((x - c) * (x - c)) AS q FROM e JOIN c USING (k) GROUP BY vec_id, cl) SELECT vec_id AS sample_id, arg_min(cl, q) AS label FROM d GROUP BY vec_id")
def nearest_centroid(spark, d):
    n = _nodes(spark, d)
    return evaluate.nearest_centroid(n, evaluate.centroid_vectors(n))


S = f"""{E}, l AS (SELECT vec_id, label FROM embeddings), m AS (SELECT sy.i, b.label AS lj, avg(dist) AS d FROM sy JOIN l b ON b.vec_id = sy.j GROUP BY sy.i, b.label),
ab AS (SELECT m.i, a.label, max(CASE WHEN lj = a.label THEN d END) AS a, min(CASE WHEN lj <> a.label THEN d END) AS b FROM m JOIN l a ON a.vec_id = m.i GROUP BY m.i, a.label),
si AS (SELECT i, label, CASE WHEN a IS NULL OR b IS NULL THEN 0.0::double ELSE coalesce((b - a) / nullif(greatest(a, b), 0), 0) END AS s FROM ab)"""


@query("silhouette_samples", f"{S} SELECT i AS sample_id, label, round(s, 5) AS s FROM si")
def silhouette_samples(spark, d):
    return evaluate.silhouette_samples(_nodes(spark, d)).select("sample_id", "label", F.round("s", 5).alias("s"))


@query("silhouette", f"{S} SELECT round(avg(s), 5) AS silhouette FROM si")
def silhouette(spark, d):
    return evaluate.silhouette(_nodes(spark, d)).select(F.round("silhouette", 5).alias("silhouette"))


@query("davies_bouldin", "WITH e AS (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings), c AS (SELECT label, k, avg(x) AS c FROM e GROUP BY label, k), r AS (SELECT vec_id, label, sqrt(sum((x - c) * (x - c))) AS r FROM e JOIN c USING (label, k) GROUP BY vec_id, label), s AS (SELECT label, avg(r) AS s FROM r GROUP BY label), m AS (SELECT a.label AS la, b.label AS lb, sqrt(sum((a.c - b.c) * (a.c - b.c))) AS m FROM c a JOIN c b ON a.k = b.k AND a.label <> b.label GROUP BY a.label, b.label) SELECT round(avg(w), 5) AS davies_bouldin FROM (SELECT la, max((x.s + y.s) / m) AS w FROM m JOIN s x ON x.label = la JOIN s y ON y.label = lb GROUP BY la)")
def davies_bouldin(spark, d):
    return evaluate.davies_bouldin(_nodes(spark, d)).select(F.round("davies_bouldin", 5).alias("davies_bouldin"))


def _labels(spark, d) -> DataFrame:
    return spark.read.parquet(f"{d}/labels.parquet").filter("quality is not null and toxic is not null")


_T = "WITH t AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY 1, 2), ra AS (SELECT a, sum(n) AS ai FROM t GROUP BY a), rb AS (SELECT b, sum(n) AS bj FROM t GROUP BY b), nn AS (SELECT sum(n)::bigint AS n FROM t)"


@query("contingency", f"{_T} SELECT a, b, n FROM t")
def contingency(spark, d):
    return evaluate.contingency(_labels(spark, d), "quality", "toxic")


@query("ari", f"{_T}, x AS (SELECT (SELECT sum(n * (n - 1) / 2.0) FROM t) AS c, (SELECT sum(ai * (ai - 1) / 2.0) FROM ra) AS pa, (SELECT sum(bj * (bj - 1) / 2.0) FROM rb) AS pb, (SELECT n * (n - 1) / 2.0 FROM nn) AS al) SELECT round(((c - pa * pb / al) / ((pa + pb) / 2 - pa * pb / al))::double, 6) AS ari FROM x")
def ari(spark, d):
    return evaluate.adjusted_rand(_labels(spark, d), "quality", "toxic").select(F.round("ari", 6).alias("ari"))


@query(
    "ami",
    f"{_T}, mi AS (SELECT sum(t.n::double / nn.n * ln(nn.n::double * t.n / (ai * bj))) AS mi FROM t JOIN ra USING (a) JOIN rb USING (b), nn), h AS (SELECT (SELECT -sum(ai::double / nn.n * ln(ai::double / nn.n)) FROM ra, nn) AS ha, (SELECT -sum(bj::double / nn.n * ln(bj::double / nn.n)) FROM rb, nn) AS hb), "
    "em AS (SELECT sum(k::double / n * ln(n::double * k / (ai * bj)) * exp(lgamma(ai + 1) + lgamma(bj + 1) + lgamma(n - ai + 1) + lgamma(n - bj + 1) - lgamma(n + 1) - lgamma(k + 1) - lgamma(ai - k + 1) - lgamma(bj - k + 1) - lgamma(n - ai - bj + k + 1))) AS emi FROM (SELECT ai::bigint AS ai, bj::bigint AS bj, nn.n AS n, unnest(range(greatest(1, (ai + bj)::bigint - nn.n), least(ai, bj)::bigint + 1)) AS k FROM ra, rb, nn)) SELECT round((mi - emi) / ((ha + hb) / 2 - emi), 5) AS ami FROM mi, h, em",
)
def ami(spark, d):
    return evaluate.adjusted_mutual_information(_labels(spark, d), "quality", "toxic").select(F.round("ami", 5).alias("ami"))


# --- manifolds ------------------------------------------------------------------------------------------------

#: Embeddings as tangent vectors at the first axis: the first coordinate 0, a tenth of the rest.
_V = "WITH v AS (SELECT vec_id AS i, unnest(range(len(embedding))) AS k, unnest([0.0::double] || list_transform(embedding[2:], lambda x: x::double / 10)) AS x FROM embeddings), n AS (SELECT i, greatest(sqrt(sum(x * x)), 1e-8) AS n FROM v GROUP BY i)"


def _tangent(spark, d) -> DataFrame:
    z = src.latent(spark, d)
    return z.select("sample_id", F.concat(F.array(F.lit(0.0)), F.transform(F.slice("z", F.lit(2), F.size("z") - 1), lambda x: x / 10)).alias("v"))


def _vectors(df: DataFrame, column) -> DataFrame:
    return df.select("sample_id", F.posexplode(column).alias("k", "x")).select("sample_id", "k", F.round("x", 6).alias("x"))


@query("sphere_exp", f"{_V} SELECT i AS sample_id, k, round(cos(n) * CASE WHEN k = 0 THEN 1 ELSE 0 END + sin(n) / n * x, 6) AS x FROM v JOIN n USING (i)")
def sphere_exp(spark, d):
    return _vectors(_tangent(spark, d), manifolds.readout(F.col("v"), "sphere"))


@query("sphere_log", f"{_V}, u AS (SELECT i, k, x / sqrt(sum(x * x) OVER (PARTITION BY i)) AS x FROM (SELECT i, k, CASE WHEN k = 0 THEN 0.5::double ELSE x END AS x FROM v)), c AS (SELECT i, greatest(least(max(CASE WHEN k = 0 THEN x END), 1 - 1e-7), -1 + 1e-7) AS c FROM u GROUP BY i), w AS (SELECT i, k, c, x - CASE WHEN k = 0 THEN c ELSE 0 END AS x FROM u JOIN c USING (i)) SELECT i AS sample_id, k, round(acos(c) * x / greatest(sqrt(sum(x * x) OVER (PARTITION BY i)), 1e-8), 6) AS x FROM w")
def sphere_log(spark, d):
    y = F.transform("v", lambda x, i: F.when(i == 0, 0.5).otherwise(x))
    return _vectors(_tangent(spark, d).select("sample_id", y.alias("y")), manifolds.to_tangent(F.col("y"), "sphere"))


@query("poincare_exp0", f"{_V} SELECT i AS sample_id, k, round(tanh(n) / n * x, 6) AS x FROM v JOIN n USING (i)")
def poincare_exp0(spark, d):
    return _vectors(_tangent(spark, d), manifolds.readout(F.col("v"), "poincare"))


@query("poincare_log0", f"{_V}, y AS (SELECT i, k, tanh(n) / n * x AS x FROM v JOIN n USING (i)), m AS (SELECT i, greatest(least(sqrt(sum(x * x)), 1 - 1e-6), 1e-8) AS m FROM y GROUP BY i) SELECT i AS sample_id, k, round(atanh(m) / m * x, 6) AS x FROM y JOIN m USING (i)")
def poincare_log0(spark, d):
    return _vectors(_tangent(spark, d).select("sample_id", manifolds.poincare_exp0(F.col("v")).alias("y")), manifolds.to_tangent(F.col("y"), "poincare"))


_KA = f"""{_V}, y AS (SELECT i, k, cos(n) * CASE WHEN k = 0 THEN 1 ELSE 0 END + sin(n) / n * x AS x FROM v JOIN n USING (i)),
pt AS (SELECT i, list(x ORDER BY k) AS y FROM y GROUP BY i), yy AS (SELECT list(y) AS ys FROM pt), m0 AS (SELECT list(x ORDER BY k) AS a FROM (SELECT k, avg(x) AS x FROM y GROUP BY k)),
st(q, a, still) AS (SELECT 0, list_transform(a, lambda x: x / greatest(sqrt(list_inner_product(a, a)), 1e-8)), false FROM m0
UNION ALL SELECT q + 1, CASE WHEN nn < 1e-10 THEN a ELSE list_transform(w, lambda x: x / sqrt(list_inner_product(w, w))) END, nn < 1e-10
FROM (SELECT q, a, nn, list_transform(a, lambda x, k: cos(nn) * x + sin(nn) * g[k] / nn) AS w FROM (SELECT q, a, g, sqrt(list_inner_product(g, g)) AS nn
FROM (SELECT q, a, (SELECT list(s ORDER BY k) FROM (SELECT k, avg(l) AS s FROM (SELECT unnest(range(len(u))) AS k, unnest(u) AS l FROM (SELECT list_transform(u, lambda x: acos(c) * x / greatest(sqrt(list_inner_product(u, u)), 1e-8)) AS u FROM (SELECT list_transform(y, lambda x, k: x - c * a[k]) AS u, c FROM (SELECT y, greatest(least(list_inner_product(y, a), 1 - 1e-7), -1 + 1e-7) AS c FROM (SELECT unnest(ys) AS y FROM yy))))) GROUP BY k)) AS g FROM st WHERE q < 50 AND NOT still))))"""


@query("karcher_anchor", f"{_KA.replace('WITH v', 'WITH RECURSIVE v', 1)} SELECT unnest(range(len(a))) AS k, round(unnest(a), 6) AS x FROM (SELECT a FROM st ORDER BY q DESC LIMIT 1)")
def karcher_anchor(spark, d):
    on = _tangent(spark, d).select(manifolds.sphere_exp(manifolds.default_anchor(F.col("v")), F.col("v")).alias("y"))
    return spark.createDataFrame([(k, round(x, 6)) for k, x in enumerate(manifolds.fit_anchor(on, "y"))], "k int, x double")


_BA = "WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY md5('0|' || vec_id), vec_id) - 1 AS n FROM embeddings)"


@query("minibatches", f"{_BA} SELECT n // 32 AS batch, n % 32 AS place, vec_id AS sample_id FROM o")
def minibatches(spark, d):
    return autoencoder.minibatches(_nodes(spark, d).select("sample_id"), 32).select("batch", "place", "sample_id")


@query("minibatch_gather", f"{_BA} SELECT n // 32 AS batch, k, round(sum(x), 5) AS total, count(DISTINCT label) AS labels FROM o JOIN (SELECT vec_id, label, unnest(range(len(embedding))) AS k, unnest(embedding)::double AS x FROM embeddings) USING (vec_id) GROUP BY ALL")
def minibatch_gather(spark, d):
    n = _nodes(spark, d)
    g = autoencoder.gather(autoencoder.minibatches(n.select("sample_id"), 32), n)
    return g.select("batch", "label", F.posexplode("z").alias("k", "x")).groupBy("batch", "k").agg(F.round(F.sum("x"), 5).alias("total"), F.count_distinct("label").alias("labels"))


# --- distances ------------------------------------------------------------------------------------------------


def _metric(name: str):
    def run(spark, d):
        return distance.pairwise(_events(spark, d), name).select("i", "j", F.round("dist", 5).alias("dist"))

    return run


def _warped(band: int | None) -> str:
    """Time warping of all pairs of z-scored curves: rows of the lattice by recursion, the way along a row by a running minimum."""
    inside = f"abs(c.i - c.j) <= {band}" if band is not None else "true"
    return f"""{Q.replace('WITH ty', 'WITH RECURSIVE ty', 1)}, zl AS (SELECT s, t, list(v ORDER BY f) AS x FROM z GROUP BY s, t),
ct AS (SELECT a.s AS a, b.s AS b, a.t AS i, b.t AS j, list_distance(a.x, b.x) AS c FROM zl a JOIN zl b ON a.s < b.s),
dw(i, a, b, j, d) AS (SELECT -1, a.s, b.s, -1, 0.0::double FROM (SELECT DISTINCT s FROM z) a JOIN (SELECT DISTINCT s FROM z) b ON a.s < b.s
UNION ALL SELECT i, a, b, j, s + min(e - (s - c)) OVER (PARTITION BY a, b ORDER BY j) FROM (
SELECT c.i, c.a, c.b, c.j, c.c, sum(c.c) OVER (PARTITION BY c.a, c.b ORDER BY c.j) AS s, least(coalesce(u.d, 'infinity'::double), coalesce(g.d, 'infinity'::double)) AS e
FROM (SELECT DISTINCT i FROM dw) w JOIN ct c ON c.i = w.i + 1 AND {inside} LEFT JOIN dw u ON u.a = c.a AND u.b = c.b AND u.j = c.j LEFT JOIN dw g ON g.a = c.a AND g.b = c.b AND g.j = c.j - 1)),
dt AS (SELECT a AS i, b AS j, d AS dist FROM dw WHERE dw.i = {STEPS - 1} AND dw.j = {STEPS - 1})"""


for _name in distance.METRICS:
    query(_name.replace("-", "_"), f"{_warped(distance.default_band(STEPS))} SELECT i, j, round(dist, 5) AS dist FROM dt" if _name == "fastdtw" else None)(_metric(_name))


@query("dtw_full", f"{_warped(None)} SELECT i, j, round(dist, 5) AS dist FROM dt")
def dtw_full(spark, d):
    return distance.pairwise(_events(spark, d), "fastdtw", band=STEPS).select("i", "j", F.round("dist", 5).alias("dist"))


_MV = sql.values(((m, di, dj) for m, (di, dj) in enumerate(distance.MOVES)), "m, di, dj")
#: The elastic lattice of the curves 1 (held) and 2 (warped): costs of moves by their integrals, rows by recursion, which
#: carries the last four, then the way back.
_ELASTIC = f"""{Q.replace('WITH ty', 'WITH RECURSIVE ty', 1)}, ab AS (SELECT f, t, max(CASE WHEN s = 1 THEN v END) AS a, max(CASE WHEN s = 2 THEN v END) AS b FROM q WHERE s IN (1, 2) GROUP BY f, t),
mv AS {_MV}, pt AS (SELECT m, di, dj, i, j, i - di + x AS ta, CASE WHEN x IN (0, di) THEN 0.5::double ELSE 1.0::double END AS w, j - dj + x * dj::double / di AS p
FROM mv, (SELECT unnest(range({STEPS})) AS i), (SELECT unnest(range({STEPS})) AS j), (SELECT unnest(range(5)) AS x) WHERE i >= di AND j >= dj AND x <= di),
ct AS (SELECT m, di, dj, i, j, sum(w * pow(h.a - sqrt(dj::double / di) * (l.b * (1 - p + l.t) + u.b * (p - l.t)), 2)) / {STEPS - 1} AS c
FROM pt JOIN ab h ON h.t = ta JOIN ab l ON l.f = h.f AND l.t = least(floor(p), {STEPS - 2}) JOIN ab u ON u.f = h.f AND u.t = l.t + 1 GROUP BY ALL),
el(n, i, j, v, m) AS (SELECT 0, 0, 0, 0.0::double, -1 UNION ALL
SELECT n + 1, i, j, v, m FROM (SELECT n, i, j, v, m FROM el WHERE i >= n - 2 UNION ALL
SELECT n, n + 1, j, b.v, b.m FROM (SELECT e.n, c.j, min({{'v': e.v + c.c, 'm': c.m}}) AS b FROM el e JOIN ct c ON c.i = e.n + 1 AND e.i = c.i - c.di AND e.j = c.j - c.dj GROUP BY e.n, c.j)) WHERE n < {STEPS - 1}),
tk AS (SELECT i, j, v, el.m, di, dj FROM el LEFT JOIN mv USING (m) WHERE n = i),
bk(q, i, j) AS (SELECT 0, {STEPS - 1}, {STEPS - 1} UNION ALL SELECT bk.q + 1, bk.i - di, bk.j - dj FROM bk JOIN tk ON tk.i = bk.i AND tk.j = bk.j WHERE tk.m >= 0)"""


@query("alignment_path", f"{_ELASTIC} SELECT (SELECT max(q) FROM bk) - q AS step, i, j FROM bk")
def alignment_path(spark, d):
    return distance.alignment(_events(spark, d), 1, 2)


@query("elastic_pair", f"{_ELASTIC} SELECT round(sqrt(v), 5) AS dist FROM tk WHERE i = {STEPS - 1} AND j = {STEPS - 1}")
def elastic_pair(spark, d):
    """The whole lattice for two curves."""
    two = _events(spark, d).filter(F.col("sample_id").isin(1, 2))
    return distance.pairwise(_events(spark, d), "elastic", band=STEPS, only=two.select("sample_id").distinct()).select(F.round("dist", 5).alias("dist"))


@query("curve_neighbours", f"{_warped(distance.default_band(STEPS))}, kn AS (SELECT i, j, dist, row_number() OVER (PARTITION BY i ORDER BY dist, j) AS rank FROM (SELECT * FROM dt UNION ALL SELECT j, i, dist FROM dt)) SELECT i, rank, j, round(dist, 5) AS dist FROM kn WHERE rank <= {M}")
def curve_neighbours(spark, d):
    return nearest.of_curves(_events(spark, d), M, block=64).select("i", "rank", "j", F.round("dist", 5).alias("dist"))


@query("extremes", f"{_warped(distance.default_band(STEPS))}, ex AS (SELECT 'similar' AS which, unnest([i, j]) AS s FROM (SELECT i, j FROM dt ORDER BY dt.dist, i, j LIMIT 1) UNION ALL SELECT 'different', unnest([i, j]) FROM (SELECT i, j FROM dt ORDER BY dt.dist DESC, i, j LIMIT 1)) SELECT which, s AS sample_id, f AS feature, t AS t_idx, round(v, 6) AS value FROM ex JOIN p USING (s)")
def extremes(spark, d):
    c = _events(spark, d)
    e = graph.curves_of(distance.extreme_pairs(c, "fastdtw"), c)
    return e.select("which", "sample_id", "feature", F.posexplode("values").alias("t_idx", "value")).withColumn("value", F.round("value", 6))


# --- smoothing ------------------------------------------------------------------------------------------------

_FC = f"""{P}, fc AS (SELECT s, f, avg(v) AS a0, {", ".join(f"2 * avg(v * cos(2 * pi() * {k} * t / {STEPS})) AS a{k}, 2 * avg(v * sin(2 * pi() * {k} * t / {STEPS})) AS b{k}" for k in (1, 2, 3))} FROM p GROUP BY s, f)"""


@query("fourier_coefs", f"{_FC} SELECT s AS sample_id, f AS feature, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("a0", "a1", "b1", "a2", "b2", "a3", "b3")) + " FROM fc")
def fourier_coefs(spark, d):
    c = smoothing.fourier_coefficients(_events(spark, d), 3)
    return c.select("sample_id", "feature", *(F.round(F.col("c")[k], 6).alias(n) for k, n in enumerate(("a0", "a1", "b1", "a2", "b2", "a3", "b3"))))


@query("fourier_eval", f"{_FC} SELECT s AS sample_id, f AS feature, k AS t_idx, round(a0 + a1 * cos(2 * pi() * x) + b1 * sin(2 * pi() * x) + a2 * cos(4 * pi() * x) + b2 * sin(4 * pi() * x) + a3 * cos(6 * pi() * x) + b3 * sin(6 * pi() * x), 6) AS value FROM fc, (SELECT k, k / 9.0::double AS x FROM (SELECT unnest(range(10)) AS k))")
def fourier_eval(spark, d):
    fit = smoothing.fourier_series(smoothing.fourier_coefficients(_events(spark, d), 3), 10)
    return _long(fit.withColumnRenamed("fit", "values"))


def _arrays(df: DataFrame, column: str, digits: int = 6) -> DataFrame:
    return df.select("sample_id", "feature", F.posexplode(column).alias("k", "x")).select("sample_id", "feature", "k", F.round("x", digits).alias("x"))


def _recursive(*parts: str) -> str:
    """The curves p and further tables, some of which recur."""
    return ", ".join((P.replace("WITH ty", "WITH RECURSIVE ty", 1), *parts))


_COEFS = " SELECT s AS sample_id, f AS feature, k, round(c, 4) AS x FROM co"
_P10 = _recursive(sql.splines([10], STEPS), sql.projector(), sql.COEFFICIENTS)


@query("bspline_coefs", f"{_P10} {_COEFS}")
def bspline_coefs(spark, d):
    return _arrays(smoothing.bspline_coefficients(_events(spark, d), 10), "c", 4)


#: Where each event lies on its curve: the share of the table's days that has passed.
_PLACES = f"pl AS (SELECT event_id AS t, user_id AS s, f, date_diff('microsecond', d0.d::timestamp, ts) / (86400e6::double * {STEPS}) AS x FROM events JOIN ty USING (event_type), d0)"


def _places(spark, d) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    types = e.select("event_type").distinct().withColumn("feature", (F.dense_rank().over(Window.orderBy("event_type")) - 1).cast("int"))  # a row a type
    day = e.agg(F.min(F.to_date("ts")).cast("timestamp").alias("d0"))
    passed = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros("d0")) / (86400e6 * len(_grid_of(spark, d)))
    return e.join(F.broadcast(types), "event_type").crossJoin(F.broadcast(day)).select("event_id", F.col("user_id").alias("sample_id"), "feature", passed.alias("x"))  # one row


@query("spline_at_events", _recursive(sql.splines([10], STEPS), sql.projector(), sql.COEFFICIENTS, _PLACES, sql.splines([10], STEPS, "e", "(SELECT t, x FROM pl)")) + " SELECT pl.t AS event_id, round(sum(c * e.v), 5) AS fit FROM pl JOIN e USING (t) JOIN co ON co.s = pl.s AND co.f = pl.f AND co.k = e.k GROUP BY pl.t")
def spline_at_events(spark, d):
    """The fitted curve of each event's user and type at the event's own time."""
    fit = smoothing.fits_at(smoothing.bspline_coefficients(_events(spark, d), 10), _places(spark, d))
    return fit.select("event_id", F.round("fit", 5).alias("fit"))


@query(
    "fourier_at_events",
    f"{P}, fc AS (SELECT s, f, avg(v) AS a0, {', '.join(f'2 * avg(v * cos(2 * pi() * {k} * t / {STEPS})) AS a{k}, 2 * avg(v * sin(2 * pi() * {k} * t / {STEPS})) AS b{k}' for k in (1, 2, 3))} FROM p GROUP BY s, f), {_PLACES} SELECT t AS event_id, round(a0{''.join(f' + a{k} * cos(2 * pi() * {k} * x) + b{k} * sin(2 * pi() * {k} * x)' for k in (1, 2, 3))}, 5) AS fit FROM pl JOIN fc USING (s, f)",
)
def fourier_at_events(spark, d):
    fit = smoothing.fits_at(smoothing.fourier_coefficients(_events(spark, d), 3), _places(spark, d), "fourier")
    return fit.select("event_id", F.round("fit", 5).alias("fit"))


@query("smoothing_features_wavelet")
def smoothing_features_wavelet(spark, d):
    return _arrays(smoothing.smoothing_features(_events(spark, d), 8, 40, "wavelet")[0], "c", 4)


@query("bspline_penalized", _recursive(sql.splines([12], STEPS), sql.projector("(SELECT 12 AS n, 0.3::double AS lam)", sql.DIFFERENCES), sql.COEFFICIENTS) + _COEFS)
def bspline_penalized(spark, d):
    return _arrays(smoothing.bspline_coefficients(_events(spark, d), 12, 0.3), "c", 4)


@query("legendre_projection", _recursive(sql.legendre(6, STEPS), sql.projector(), sql.COEFFICIENTS) + _COEFS)
def legendre_projection(spark, d):
    return _arrays(smoothing.project(_events(spark, d), "legendre", 6), "c", 4)


@query("bspline_projection", _P10 + _COEFS)
def bspline_projection(spark, d):
    return _arrays(smoothing.project(_events(spark, d), "bspline", 10), "c", 4)


def _grid_of(spark, d) -> np.ndarray:
    """The event curves' own grid on [0, 1]."""
    return np.linspace(0, 1, _events(spark, d).agg(F.max(F.size("values"))).first()[0])


#: Places of the basis queries over the span of the event curves.
BASIS_STEPS = 40


def _places_of(spark, d) -> np.ndarray:
    """``BASIS_STEPS`` even places from the first to the last step of the event curves, as shares of that span."""
    last = len(_grid_of(spark, d)) - 1
    return np.linspace(0, last, BASIS_STEPS) / last


def _basis(spark, phi: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(t, k, round(float(v), 6) + 0.0) for t, row in enumerate(phi) for k, v in enumerate(row)], "t int, k int, v double")


_ONE = " SELECT t, k, round(v, 6) + 0.0 AS v FROM b"


@query("bspline_basis", "WITH RECURSIVE " + sql.splines([9], BASIS_STEPS) + _ONE)
def bspline_basis(spark, d):
    return _basis(spark, smoothing.bspline_design(_places_of(spark, d), 9))


@query("fourier_basis_cos_sin", "WITH " + sql.fourier(4, BASIS_STEPS) + _ONE)
def fourier_basis_cos_sin(spark, d):
    return _basis(spark, smoothing.fourier_design(_places_of(spark, d), 4))


@query("fourier_basis_sin_cos", "WITH " + sql.fourier(4, BASIS_STEPS, "sin") + _ONE)
def fourier_basis_sin_cos(spark, d):
    return _basis(spark, smoothing.fourier_basis(_places_of(spark, d), 9))


@query("legendre_basis", "WITH RECURSIVE " + sql.legendre(7, BASIS_STEPS) + _ONE)
def legendre_basis(spark, d):
    return _basis(spark, smoothing.orthogonal_basis("legendre", 7, len(_places_of(spark, d))))


@query("half_wave_basis", f"WITH b AS (SELECT t, k, CASE WHEN k = 0 THEN 1.0::double WHEN k % 2 = 1 THEN sqrt(2) * sin((k + 1) * pi() * t / {STEPS - 1}) ELSE sqrt(2) * cos(k * pi() * t / {STEPS - 1}) END AS v FROM (SELECT unnest(range({STEPS})) AS t), (SELECT unnest(range(6)) AS k))" + _ONE)
def half_wave_basis(spark, d):
    return _basis(spark, smoothing.orthogonal_basis("fourier", 6, len(_grid_of(spark, d))))


@query("gram_matrix", "WITH RECURSIVE " + sql.splines([9], STEPS) + f" SELECT x.k AS i, y.k AS j, round(sum(x.v * y.v) / {STEPS - 1}, 8) AS v FROM b x JOIN b y USING (t) GROUP BY ALL")
def gram_matrix(spark, d):
    g = smoothing.gram(smoothing.orthogonal_basis("bspline", 9, len(_grid_of(spark, d))))
    return spark.createDataFrame([(i, j, round(float(v), 8)) for i, row in enumerate(g) for j, v in enumerate(row)], "i int, j int, v double")


@query("smoothing_features_bspline", _recursive(f"st AS (SELECT f, t, avg(v) AS mu, sqrt(var_pop(v)) + 1e-8 AS sd FROM p GROUP BY f, t), pz AS (SELECT s, f, t, (v - mu) / sd AS v FROM p JOIN st USING (f, t))", sql.splines([8], STEPS), sql.projector(), sql.COEFFICIENTS.replace("FROM p JOIN", "FROM pz p JOIN")) + _COEFS)
def smoothing_features_bspline(spark, d):
    return _arrays(smoothing.smoothing_features(_events(spark, d), 8, 40, standardize=True)[0], "c", 4)


@query("smoothing_features_fourier", f"{_FC} SELECT s AS sample_id, f AS feature, k, round(x, 4) AS x FROM (SELECT s, f, unnest(range(7)) AS k, unnest([a0, a1, b1, a2, b2, a3, b3]) AS x FROM fc)")
def smoothing_features_fourier(spark, d):
    return _arrays(smoothing.smoothing_features(_events(spark, d), 7, 40, "fourier")[0], "c", 4)


def _scored(spark, d, grid: list) -> DataFrame:
    g = smoothing.gcv_scores(_events(spark, d), grid)
    return g.select("terms", "lam", F.round("df", 6).alias("df"), F.round("gcv", 3).alias("gcv"))


def _grid(grid: list) -> str:
    return sql.values(((int(k), float(lam)) for k, lam, _ in grid), "n, lam")


_BG, _FG = smoothing.bspline_grid(STEPS), smoothing.fourier_grid(STEPS)


@query("gcv_bspline", _recursive(sql.splines(sorted({k for k, _, _ in _BG}), STEPS), sql.projector(_grid(_BG), sql.DIFFERENCES)) + sql.scores(STEPS))
def gcv_bspline(spark, d):
    return _scored(spark, d, _BG)


@query("gcv_fourier", _recursive(sql.fourier(_FG[0][0], STEPS), sql.projector(_grid(_FG), sql.CURVATURES)) + sql.scores(STEPS))
def gcv_fourier(spark, d):
    return _scored(spark, d, _FG)


@query(
    "moving_average_gcv",
    f"{P}, fi AS (SELECT s, f, t, v, avg(v) OVER (PARTITION BY s, f ORDER BY t ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS y FROM p), df AS (SELECT sum(CASE WHEN t IN (0, {STEPS - 1}) THEN 0.5::double ELSE 1.0::double / 3 END) AS df FROM (SELECT unnest(range({STEPS})) AS t)), r AS (SELECT s, f, sum((v - y) * (v - y)) AS rss FROM fi GROUP BY s, f) SELECT round(max(df), 6) AS df, round({STEPS} * avg(rss) / (({STEPS} - max(df)) * ({STEPS} - max(df))), 5) AS gcv FROM r, df",
)
def moving_average_gcv(spark, d):
    s = np.zeros((STEPS, STEPS))
    for t in range(STEPS):
        lo, hi = max(0, t - 1), min(STEPS, t + 2)
        s[t, lo:hi] = 1 / (hi - lo)
    return smoothing.gcv_scores(_events(spark, d), [(3, 0.0, s)]).select(F.round("df", 6).alias("df"), F.round("gcv", 5).alias("gcv"))


@query(
    "fit_of_each_label",
    f"{_P10}, la AS (SELECT s % 3 AS label, min(s) AS s FROM p GROUP BY 1), fi AS (SELECT label, s, f, b.t, sum(b.v * c) AS v FROM co JOIN la USING (s) JOIN b USING (k) GROUP BY ALL) SELECT label, s AS sample_id, f AS feature, t AS t_idx, round(fi.v, 4) AS fit, round(any_value(p.v), 6) AS value FROM fi JOIN p USING (s, f, t) GROUP BY ALL",
)
def fit_of_each_label(spark, d):
    c = _events(spark, d)
    labels = c.select("sample_id", (F.col("sample_id") % 3).alias("label")).distinct()
    fits = smoothing.second_stage(c, 10, STEPS)
    both = smoothing.fit_of_each_label(c, fits, labels).select("label", "sample_id", "feature", F.posexplode(F.arrays_zip("fit", "values")).alias("t_idx", "x"))
    return both.select("label", "sample_id", "feature", "t_idx", F.round("x.fit", 4).alias("fit"), F.round("x.values", 6).alias("value"))


@query("principal_components")
def principal_components(spark, d):
    p = evaluate.project_2d(_nodes(spark, d))
    return p.select("sample_id", F.round(F.abs("x"), 5).alias("x"), F.round(F.abs("y"), 5).alias("y"))


_LOW, _LEVELS = smoothing.LOW["db4"], smoothing.greatest_level(STEPS, "db4")
_WA = f"{P}, {sql.wavelet(_LEVELS, STEPS, _LOW)}"


def _shrunk(tau: str) -> str:
    return f"CASE WHEN abs(v) > {tau} THEN sign(v) * (abs(v) - {tau}) ELSE 0 END"


_CUT = " UNION ALL ".join(f"SELECT s, f, {lv} AS level, k, {_shrunk('tau')} AS d, NULL::double AS a FROM d{lv} JOIN mt USING (s, f)" for lv in range(1, _LEVELS + 1)) + f" UNION ALL SELECT s, f, {_LEVELS}, k, NULL, {_shrunk('tau')} FROM a{_LEVELS} JOIN mt USING (s, f)"
_MAD = "SELECT s, f, median(abs(v - m)) / 0.6745 + 1e-12 AS sigma FROM d1 JOIN (SELECT s, f, median(v) AS m FROM d1 GROUP BY s, f) USING (s, f) GROUP BY s, f"


def _back(key: str) -> str:
    """Signals from the shrunk levels cu."""
    merged = f"cm AS (SELECT {key}, level, k, max(d) AS d, max(a) AS a FROM cu GROUP BY ALL)"
    return f"{merged}, {sql.unwavelet(_LEVELS, STEPS, _LOW, 'cm', key)}"


@query("wavelet_denoise", f"{_WA}, mt AS (SELECT s, f, 2 * sigma AS tau FROM ({_MAD.replace('d1', f'd{1}')})), cu AS ({_CUT}), {_back('s, f')} SELECT s AS sample_id, f AS feature, k, round(v, 4) AS x FROM z0 WHERE k < {STEPS}")
def wavelet_denoise(spark, d):
    return _arrays(smoothing.wavelet_denoise(_events(spark, d)), "fit", 4)


def _wavelet_gcv() -> str:
    """Scores of every level up to the greatest one and of eight thresholds."""
    parts = [_WA, f"sg AS (SELECT sigma FROM ({_MAD}) ORDER BY s, f LIMIT 1)", "mt0 AS (SELECT g, (0.5 + g * 3.0::double / 7) * sigma AS tau FROM sg, (SELECT unnest(range(8)) AS g))"]
    found = []
    for top in range(1, _LEVELS + 1):
        cut = " UNION ALL ".join(f"SELECT s, f, g, tau, {lv} AS level, k, {_shrunk('tau')} AS d, NULL::double AS a FROM d{lv}, mt0" for lv in range(1, top + 1)) + f" UNION ALL SELECT s, f, g, tau, {top}, k, NULL, {_shrunk('tau')} FROM a{top}, mt0"
        own = sql.unwavelet(top, STEPS, _LOW, f"cm{top}", "s, f, g")
        for lv in range(top + 1):
            own = own.replace(f"z{lv} ", f"z{top}_{lv} ").replace(f"z{lv})", f"z{top}_{lv})")
        parts += [f"cu{top} AS ({cut})", f"cm{top} AS (SELECT s, f, g, level, k, max(d) AS d, max(a) AS a FROM cu{top} GROUP BY ALL)", own.replace("ts AS", f"ts{top} AS").replace(", ts ", f", ts{top} ")]
        parts += [f"kp{top} AS (SELECT s, f, g, tau, count(*) FILTER (WHERE coalesce(d, a) <> 0) AS kept FROM cu{top} GROUP BY ALL)", f"rs{top} AS (SELECT s, f, g, sum((p.v - z.v) * (p.v - z.v)) AS rss FROM z{top}_0 z JOIN p USING (s, f) WHERE z.k = p.t GROUP BY ALL)"]
        found.append(f"SELECT {top} AS level, round(tau, 6) AS tau, round(ln(avg({STEPS} * rss / pow(greatest(1e-12, {STEPS} - kept), 2))), 6) AS log_gcv FROM rs{top} JOIN kp{top} USING (s, f, g) GROUP BY tau")
    return ", ".join(parts) + " " + " UNION ALL ".join(found)


@query("gcv_wavelet", _wavelet_gcv())
def gcv_wavelet(spark, d):
    return smoothing.wavelet_scores(_events(spark, d)).select("level", F.round("tau", 6).alias("tau"), F.round(F.log("gcv"), 6).alias("log_gcv"))


# --- clustering -----------------------------------------------------------------------------------------------


def _groups(spark, d) -> tuple[DataFrame, DataFrame]:
    """Points and edges of the embeddings."""
    z = _nodes(spark, d)
    return z, graph.edges(graph.nearest_points(z, M))


_EDGES = f"SELECT least(i, j) AS i, greatest(i, j) AS j, exp(-min(dist)) AS w FROM kn WHERE r <= {M} GROUP BY 1, 2"
_LOG = f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {paths.merges(_EDGES)}"


#: No SQL: the order of merges hangs on the last bits of sums once centres are close; what may be chosen from it does not.
@query("homotopy_path")
def homotopy_path(spark, d):
    path = cluster.homotopy_path(*_groups(spark, d))
    return path.select("step", F.round("lambda", 8).alias("lambda"), "kept", "absorbed", "kept_size", "absorbed_size", "kept_since", "absorbed_since")


@query("valid_partitions", f"{_LOG}, {paths.VALID} SELECT step, clusters, least FROM vp")
def valid_partitions(spark, d):
    z, e = _groups(spark, d)
    return cluster.valid_partitions(cluster.homotopy_path(z, e), z.count())


@query("convex_clusters", f"{_LOG}, {paths.VALID}, {paths.CHOSEN} SELECT i AS sample_id, dense_rank() OVER (ORDER BY c) - 1 AS cluster, true AS valid FROM cl JOIN best USING (s)")
def convex_clusters(spark, d):
    return cluster.convex_clustering(*_groups(spark, d)).select("sample_id", "cluster", "valid")


@query("fista_solve", f"{E.replace('WITH ', 'WITH RECURSIVE ', 1)}, {paths.dual_steps(_EDGES, 0.01)} SELECT sample_id, k, round(x, 5) AS x FROM u")
def fista_solve(spark, d):
    u = cluster.fista_solve(*_groups(spark, d), 0.01)
    return u.select("sample_id", F.posexplode("u").alias("k", "x")).select("sample_id", "k", F.round("x", 5).alias("x"))


@query("kmeans")
def kmeans(spark, d):
    return cluster.kmeans(_nodes(spark, d), 10)


#: Lloyd rounds from the points of least id: assignments a by the centres c of each round.
_LLOYD, _CENTRES = 6, 10


@query(
    "lloyd_rounds",
    f"""WITH RECURSIVE x AS (SELECT vec_id AS i, embedding::double[] AS z FROM embeddings),
ro(q, i, z, a) AS (
SELECT 0, i, z, NULL::bigint FROM x UNION ALL
(WITH ce AS (SELECT row_number() OVER (ORDER BY i) - 1 AS c, z FROM ro WHERE a IS NULL ORDER BY i LIMIT {_CENTRES}),
me AS (SELECT a AS c, k, avg(v) AS v FROM (SELECT a, unnest(range(len(z))) AS k, unnest(z) AS v FROM ro WHERE a IS NOT NULL) GROUP BY 1, 2),
al AS (SELECT * FROM ce UNION ALL SELECT c, list(v ORDER BY k) FROM me GROUP BY c),
di AS (SELECT ro.q, ro.i, any_value(ro.z) AS z, arg_min(al.c, list_sum(list_transform(list_zip(ro.z, al.z), lambda p: (p[1] - p[2]) * (p[1] - p[2])))) AS a FROM ro, al WHERE ro.q < {_LLOYD} GROUP BY ro.q, ro.i)
SELECT q + 1, i, z, a FROM di))
SELECT i AS sample_id, a AS cluster FROM ro WHERE q = {_LLOYD}""",
)
def lloyd_rounds(spark, d):
    z = _nodes(spark, d)
    first = np.array([r["z"] for r in z.orderBy("sample_id").limit(_CENTRES).collect()], float)
    centres, _ = cluster.lloyd(z, [first], rounds=_LLOYD - 1, tol=-1.0)
    return cluster.nearest_of(z, centres).select("sample_id", F.col("clusters")[0].cast("long").alias("cluster"))


@query("kmeans_sweep")
def kmeans_sweep(spark, d):
    z = _nodes(spark, d)
    sweep, all_ = cluster.kmeans_sweep(z, labels=z.select("sample_id", "label"))
    dropped(all_)
    return sweep.select("k", "clusters", *(F.round(c, 5).alias(c) for c in ("silhouette", "ami", "ari")))


#: Starts of paths, made from the suppliers' keys.
_START = {
    "hypersphere": (["0.02 + k % 5 / 50", "cos(k)", "sin(k)", "0", "0", "0", "1"], 3),
    "hyperbolic": (["1 + k % 4 / 3", "cos(k)", "sin(k)"], 2),
    "swiss_roll": (["k % 10", "1.5 * pi() + k % 7 / 5"], 3),
    "lorenz": (["14 + k % 15", "k % 19 - 9", "k % 17 - 8", "k % 13 - 6"], 3),
    "pendulum": (["k % 11 / 10 - 0.5", "k % 7 - 0.3"], 3),
}
_LENGTH = 60


def _starts(spark, d, kind: str) -> DataFrame:
    k = spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("sample_id"), F.col("s_suppkey").cast("double").alias("k"))
    return k.select("sample_id", F.array(*(F.expr(e).cast("double") for e in _START[kind][0])).alias("start"))


def _path_sql(kind: str) -> str:
    a = [f"({e})::double" for e in _START[kind][0]]
    k = "SELECT s_suppkey AS s, s_suppkey::double AS k FROM supplier"
    t, n = f"(SELECT unnest(range({_LENGTH})) AS t)", _LENGTH - 1
    if kind == "pendulum":
        turned = "CASE WHEN a > pi() THEN a - 2 * pi() WHEN a < -pi() THEN a + 2 * pi() ELSE a END"
        steps = f"st(s, t, a, w) AS (SELECT s, 0, {a[0]}, {a[1]} FROM ({k}) UNION ALL SELECT s, t + 1, {turned}, w FROM (SELECT s, t, a + 0.02::double * w AS a, w - 0.02::double * 9.81::double * sin(a) AS w FROM st WHERE t < {n}))"
        x = ["cos(a)", "sin(a)", "w"]
    elif kind == "lorenz":
        h = "0.01::double"
        steps = f"st(s, t, r, x, y, z) AS (SELECT s, 0, {', '.join(a)} FROM ({k}) UNION ALL SELECT s, t + 1, r, x + {h} * (10 * (y - x)), y + {h} * (x * (r - z) - y), z + {h} * (x * y - 8 / 3::double * z) FROM st WHERE t < {n})"
        x = ["x", "y", "z"]
    elif kind == "swiss_roll":
        steps = f"st AS (SELECT s, t, {a[0]} AS h, {a[1]} + 1.5 * pi() * t / {n} AS g FROM ({k}), {t})"
        x = ["g * cos(g)", "h", "g * sin(g)"]
    elif kind == "hyperbolic":
        steps = f"st AS (SELECT s, t, {a[0]} * t / {n} AS g, {a[1]} AS x, {a[2]} AS y FROM ({k}), {t})"
        x = [f"(exp(g) - exp(-g)) / 2 / (1 + (exp(g) + exp(-g)) / 2) * {c}" for c in ("x", "y")]
    else:
        steps = f"st AS (SELECT s, t, {a[0]} * t AS g, {', '.join(f'{v} AS a{i}' for i, v in enumerate(a[1:]))} FROM ({k}), {t})"
        x = [f"cos(g) * a{i} + sin(g) * a{i + 3}" for i in range(3)]
    return f"WITH RECURSIVE {steps} SELECT s AS sample_id, unnest(range({len(x)})) AS feature, t AS t_idx, round(unnest([{', '.join(x)}]), 5) + 0.0 AS value FROM st"


def _path_query(kind: str):
    def run(spark, d):
        return src.points(generators.trajectories(_starts(spark, d, kind), kind, _LENGTH)).withColumn("value", F.round("value", 5) + 0.0)

    return run


for _name in generators.CATALOG:
    query(f"trajectory_{_name}", _path_sql(_name))(_path_query(_name))


# --- networks and whole experiments -----------------------------------------------------------------------------


#: A network whose weights are sines of their places, so that SQL can make them as well.
_NET = {"layers": [6, 5, 3, 5, 6, 4, 4], "features": 5, "terms": 7, "terms_in": 5}
_WEIGHTS = {
    "wfn": (6, 5, 5), "bfn": (6,), "enc0.w": (6, 5), "enc0.b": (5,), "enc1.w": (5, 3), "enc1.b": (3,), "dec0.w": (3, 5), "dec0.b": (5,), "dec1.w": (5, 6), "dec1.b": (6,),
    "wfn1": (6, 4, 7), "bfn1": (4, 7), "wfn2": (4, 4, 7), "bfn2": (4,), "wfn3": (4, 5, 7),
    **{f"{n}.{k}": (o,) for n, o in (("enc0", 5), ("enc1", 3), ("dec0", 5), ("dec1", 6)) for k in ("scale", "shift", "mean", "var")},
}


def _pitch(name: str) -> float:
    return 0.3 + 0.17 * list(_WEIGHTS).index(name)


def _network() -> autoencoder.Network:
    grid = np.linspace(0, 1, STEPS)
    net = autoencoder.Network(5, _NET["layers"], smoothing.fourier_design(grid, 3).T, smoothing.fourier_design(grid, 2).T)
    for name, shape in _WEIGHTS.items():
        w = np.sin(_pitch(name) * (np.arange(np.prod(shape)) + 1)).reshape(shape) / 2 + (1.5 if name.endswith((".scale", ".var")) else 0)
        (net.stats if name.endswith((".mean", ".var")) else net.params)[name] = w
    return net


def _weights(name: str) -> str:
    """(a, b, c: places, v) of a weight array."""
    shape = (*_WEIGHTS[name], 1, 1)[:3]
    more = 1.5 if name.endswith((".scale", ".var")) else 0.0
    return f"(SELECT a, b, c, sin({_pitch(name)!r}::double * ((a * {shape[1]} + b) * {shape[2]} + c + 1)) / 2 + {more}::double AS v FROM (SELECT unnest(range({shape[0]})) AS a), (SELECT unnest(range({shape[1]})) AS b), (SELECT unnest(range({shape[2]})) AS c))"


def _elu(x: str) -> str:
    return f"CASE WHEN {x} > 0 THEN {x} ELSE exp({x}) - 1 END"


def _dense(at: str, source: str, out: str) -> str:
    w, b, scale, shift, mean, var = (_weights(f"{at}.{k}") for k in ("w", "b", "scale", "shift", "mean", "var"))
    normed = "(u.v + b.v - mu.v) / sqrt(va.v + 1e-5) * sc.v + sh.v"
    return f"{out} AS (SELECT s, k, {_elu('v')} AS v FROM (SELECT u.s, u.k, {normed} AS v FROM (SELECT x.s, w.b AS k, sum(x.v * w.v) AS v FROM {source} x JOIN {w} w ON w.a = x.k GROUP BY ALL) u JOIN {b} b ON b.a = u.k JOIN {mean} mu ON mu.a = u.k JOIN {var} va ON va.a = u.k JOIN {scale} sc ON sc.a = u.k JOIN {shift} sh ON sh.a = u.k))"


_CODES = ", ".join((
    _FC, sql.fourier(3, STEPS), sql.fourier(2, STEPS, name="bi"),
    "x AS (SELECT s, f AS p, unnest(range(7)) AS m, unnest([a0, a1, b1, a2, b2, a3, b3]) / 100 AS v FROM fc)",
    f"ai AS (SELECT b.k AS m, bi.k AS l, sum(b.v * bi.v) / {STEPS} AS v FROM b JOIN bi USING (t) GROUP BY ALL)",
    "xi AS (SELECT s, p, l, sum(x.v * ai.v) AS v FROM x JOIN ai USING (m) GROUP BY ALL)",
    f"e0 AS (SELECT s, u.k, greatest(u.v + b.v, 0) AS v FROM (SELECT s, w.a AS k, sum(xi.v * w.v) AS v FROM xi JOIN {_weights('wfn')} w ON w.b = p AND w.c = l GROUP BY ALL) u JOIN {_weights('bfn')} b ON b.a = u.k)",
    _dense("enc0", "e0", "e1"), _dense("enc1", "e1", "z"),
))
_CURVES = ", ".join((
    _CODES, _dense("dec0", "z", "d1"), _dense("dec1", "d1", "d2"),
    f"cc AS (SELECT s, z, m, u.v + b.v AS v FROM (SELECT s, w.b AS z, w.c AS m, sum(d2.v * w.v) AS v FROM d2 JOIN {_weights('wfn1')} w ON w.a = d2.k GROUP BY ALL) u JOIN {_weights('bfn1')} b ON b.a = z AND b.b = m)",
    f"g1 AS (SELECT s, z, t, {_elu('v')} AS v FROM (SELECT s, z, t, sum(cc.v * b.v) AS v FROM cc JOIN b ON b.k = m GROUP BY ALL))",
    f"w2 AS (SELECT w.a AS z, w.b AS y, t, sum(w.v * b.v) AS v FROM {_weights('wfn2')} w JOIN b ON b.k = w.c GROUP BY ALL)",
    f"g2 AS (SELECT s, y, t, {_elu('v')} AS v FROM (SELECT s, u.y, u.t, u.v + b.v AS v FROM (SELECT s, y, t, sum(g1.v * w2.v) AS v FROM g1 JOIN w2 USING (z, t) GROUP BY ALL) u JOIN {_weights('bfn2')} b ON b.a = u.y))",
    f"w3 AS (SELECT w.a AS y, w.b AS p, t, sum(w.v * b.v) AS v FROM {_weights('wfn3')} w JOIN b ON b.k = w.c GROUP BY ALL)",
    "ou AS (SELECT s, p, t, sum(g2.v * w3.v) AS v FROM g2 JOIN w3 USING (y, t) GROUP BY ALL)",
))


def _bend(name: str, groups: str, place: str) -> str:
    return f"(SELECT avg(abs(v - 2 * n + o)) FROM (SELECT v, lead(v) OVER w AS n, lead(v, 2) OVER w AS o FROM {_weights(name)} WINDOW w AS (PARTITION BY {groups} ORDER BY {place})) WHERE o IS NOT NULL)"


_LOSSES = (
    f"{_CURVES}, fx AS (SELECT s, p, t, sum(x.v * b.v) AS v FROM x JOIN b ON b.k = m GROUP BY ALL), wi AS {_weights('wfn')}, bb AS (SELECT x.k AS l, y.k AS k, sum(x.v * y.v) / {STEPS} AS v FROM bi x JOIN bi y USING (t) GROUP BY ALL), "
    "oc AS (SELECT x.a AS q, y.a AS r, sum(x.v * bb.v * y.v) AS v FROM wi x JOIN bb ON bb.l = x.c JOIN wi y ON y.b = x.b AND y.c = bb.k GROUP BY ALL), "
    "zl AS (SELECT s, k, v, s % 2 AS label FROM z), mk AS (SELECT label, k, avg(v) AS c FROM zl GROUP BY ALL), gk AS (SELECT k, avg(v) AS g FROM z GROUP BY k), "
    "lo AS (SELECT (SELECT avg(pow(ou.v - fx.v, 2)) FROM ou JOIN fx USING (s, p, t)) AS reconstruction, (SELECT sum(CASE WHEN q <> r THEN v * v END) / 15 + sum(CASE WHEN q = r THEN (v - 1) * (v - 1) END) / 6 FROM oc) AS orthogonality, "
    f"{_bend('wfn1', 'a, b', 'c')} + {_bend('wfn2', 'a, b', 'c')} + {_bend('wfn3', 'a, b', 'c')} + {_bend('bfn1', 'a', 'b')} + (SELECT avg(abs(v)) FROM {_weights('bfn2')}) AS roughness, "
    "(SELECT (2 * sum(pow(v - c, 2)) - sum(pow(v - g, 2))) / count(*) FROM zl JOIN mk USING (label, k) JOIN gk USING (k)) AS clustering)"
)


def _coefs(spark, d) -> DataFrame:
    return smoothing.fourier_coefficients(_events(spark, d), 3).withColumn("c", F.transform("c", lambda x: x / 100))


@query("network_codes", f"{_CODES} SELECT s AS sample_id, k, round(v, 6) AS x FROM z")
def network_codes(spark, d):
    return autoencoder.encode(_coefs(spark, d), _network()).select("sample_id", F.posexplode("z").alias("k", "x")).withColumn("x", F.round("x", 6))


@query("network_curves", f"{_CURVES} SELECT s AS sample_id, p AS feature, t AS t_idx, round(v, 6) AS value FROM ou")
def network_curves(spark, d):
    return _long(autoencoder.reconstruct(_coefs(spark, d), _network()))


@query("network_losses", f"{_LOSSES} SELECT round(reconstruction, 6) AS reconstruction, round(orthogonality, 6) AS orthogonality, round(roughness, 6) AS roughness, round(clustering, 6) AS clustering, round(reconstruction + 0.5 * orthogonality + 0.05 * roughness + 0.5 * clustering, 6) AS total FROM lo")
def network_losses(spark, d):
    c, net = _coefs(spark, d), _network()
    z = autoencoder.encode(c, net).withColumn("label", F.col("sample_id") % 2)
    means = {r.label: np.array(r.c) for r in evaluate.centroid_vectors(z).collect()}
    mean = np.array([r.c for r in evaluate.global_mean(z).orderBy("k").collect()])
    out = autoencoder.losses(c, z.select("sample_id", "label"), net, means, mean)
    return out.select(*(F.round(k, 6).alias(k) for k in out.columns))


@query(
    "model_summary",
    "WITH f AS (SELECT count(DISTINCT event_type) AS f FROM events) SELECT name, weights FROM (VALUES "
    + ", ".join(f"('{k}', {f'{v[0]} * 5 * (SELECT f FROM f)' if k == 'wfn' else f'4 * 7 * (SELECT f FROM f)' if k == 'wfn3' else int(np.prod(v))})" for k, v in _WEIGHTS.items() if not k.endswith((".mean", ".var")))
    + ") AS t(name, weights)",
)
def model_summary(spark, d):
    """The weights of the network for the event curves: as many input and output functions as they have features."""
    x, grid = _events(spark, d), _grid_of(spark, d)
    net = autoencoder.Network(x.select("feature").distinct().count(), _NET["layers"], smoothing.fourier_design(grid, 3).T, smoothing.fourier_design(grid, 2).T)
    return spark.createDataFrame([(k, n) for k, _, n in net.summary()], "name string, weights int")


def _coefs_and_edges(spark, d, m: int):
    """Coefficients of the event curves, their basis, and the edges of their warping distances."""
    x = _events(spark, d)
    c, basis = smoothing.smoothing_features(normalise.rescale(x), 8, 40)
    return c, basis, graph.edges(nearest.of_curves(x, m, block=64))


@query("train_encode")
def train_encode(spark, d):
    """A network trained on the event curves, with partitions refreshed after pretraining; its codes."""
    c, basis, e = _coefs_and_edges(spark, d, 5)
    _, x, edges = runner.gathered(c, e)
    trial = {"latent": 3}
    rows = runner.train_trials(spark, x, edges, basis, basis, [trial], 60, 20).collect()
    net = runner.loaded(runner.network(x.shape[1], basis, basis, trial), rows)
    return autoencoder.encode(c, net).select("sample_id", F.posexplode("z").alias("k", "x")).select("sample_id", "k", F.round("x", 4).alias("x"))


@query("last_losses", "SELECT trial, round(avg(value), 6) AS value FROM (SELECT user_id AS trial, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 5 GROUP BY trial")
def last_losses(spark, d):
    log = spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("trial"), F.col("event_id").alias("epoch"), F.col("value").alias("loss"))
    return runner.last_losses(log).withColumn("value", F.round("value", 6))


@query("run_experiment")
def run_experiment(spark, d):
    """A whole run over the event curves, whose labels are remainders of their ids, at the operator's defaults."""
    x = _events(spark, d).withColumn("label", F.col("sample_id") % 4)
    r = runner.run_experiment(spark, x)
    r["release"]()  # the row is there already
    return r["result"].select("dataset", "n_true", F.round("ari", 4).alias("ari"), F.round("ami", 4).alias("ami"), "n_pred")


@query("tune")
def tune(spark, d):
    c, basis, e = _coefs_and_edges(spark, d, 4)
    return runner.optimize(spark, c, e, basis, basis)[1].select("trial", F.round("value", 5).alias("value"))


def _baseline(kind: str):
    def run(spark, d):
        x = _events(spark, d)
        found, sweep = baselines.baseline(x, kind, x.select("sample_id", (F.col("sample_id") % 3).alias("label")).distinct())
        return sweep.select("k", "clusters", *(F.round(c, 5).alias(c) for c in ("silhouette", "ami", "ari")))

    return run


for _kind in ("linear", "network"):
    query(f"baseline_{_kind}_sweep")(_baseline(_kind))


@query("baseline_linear")
def baseline_linear(spark, d):
    return baselines.fit_embed(_events(spark, d), "linear").select("sample_id", F.posexplode("z").alias("k", "x")).select("sample_id", "k", F.round("x", 4).alias("x"))


@query("baseline_network")
def baseline_network(spark, d):
    return baselines.fit_embed(_events(spark, d), "network").select("sample_id", F.posexplode("z").alias("k", "x")).select("sample_id", "k", F.round("x", 4).alias("x"))
