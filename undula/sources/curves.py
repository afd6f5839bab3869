"""Curve collections: one row for each sample and feature, values as an array on a common grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def within(t, steps) -> Column:
    """``t``; a cell outside the grid of ``steps`` raises an error, so that none is lost without a word."""
    return F.when((t >= 0) & (t < steps), t).otherwise(F.raise_error(F.concat(F.lit("a cell lies outside the grid: step "), t.cast("string"))).cast("int"))


def from_events(spark: SparkSession, sf_dir: str, days: int | None = None) -> DataFrame:
    """(sample_id, feature, values): daily sums of each user's events by type, zero where there are none.

    The grid runs from the first event's day to the last one's, or over ``days``, beyond which an event is an error.

    Types and span are one row, from one pass; cells are numbered (type, day), summed by (user, cell) with partial sums,
    then gathered into one map a user, whose size types x days bounds. Types are coded in sorted order.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts", "value")
    last = F.lit(days) if days is not None else F.date_diff(F.max(F.to_date("ts")), F.min(F.to_date("ts"))) + 1
    head = events.agg(F.array_sort(F.collect_set("event_type")).alias("names"), F.min(F.to_date("ts")).alias("d0"), last.alias("steps"))
    cell = (F.array_position("names", F.col("event_type")).cast("int") - 1) * F.col("steps") + within(F.date_diff(F.to_date("ts"), "d0"), F.col("steps"))
    return _dense(events, head, "user_id", cell, F.col("value"))


def _dense(rows: DataFrame, head: DataFrame, key: str, cell: Column, value: Column) -> DataFrame:
    """(sample_id, feature, values) from the sums of ``value`` by cell; ``head`` is one row (names, steps, ...), cells are features x steps."""
    one = F.broadcast(head)  # one row
    sums = rows.crossJoin(one).select(F.col(key).alias("sample_id"), cell.alias("cell"), value.alias("value")).filter("cell is not null").groupBy("sample_id", "cell").agg(F.sum("value").alias("value"))
    maps = sums.groupBy("sample_id").agg(F.map_from_entries(F.collect_list(F.struct("cell", "value"))).alias("cells")).crossJoin(F.broadcast(head.select("names", "steps")))
    filled = lambda f: F.transform(F.sequence(f * F.col("steps"), (f + 1) * F.col("steps") - 1), lambda c: F.coalesce(F.try_element_at("cells", c), F.lit(0.0)))
    return maps.select("sample_id", F.posexplode(F.transform("names", lambda _, f: filled(f))).alias("feature", "values"))


def from_lineitem(spark: SparkSession, sf_dir: str, months: int | None = None) -> DataFrame:
    """(sample_id, feature, values): monthly revenue of each supplier by return flag.

    The grid runs from the first month of the table to the last one, or over ``months``, beyond which a row is an error.
    """
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice", "l_discount")
    month = F.year("l_shipdate") * 12 + F.month("l_shipdate")
    last = F.lit(months) if months is not None else F.max(month) - F.min(month) + 1
    head = li.agg(F.array_sort(F.collect_set("l_returnflag")).alias("names"), F.min(month).alias("m0"), last.alias("steps"))
    cell = (F.array_position("names", F.col("l_returnflag")).cast("int") - 1) * F.col("steps") + within(month - F.col("m0"), F.col("steps"))
    return _dense(li, head, "l_suppkey", cell, F.col("l_extendedprice") * (1 - F.col("l_discount")))


def points(curves: DataFrame) -> DataFrame:
    """The long view (sample_id, feature, t_idx, value)."""
    return curves.select("sample_id", "feature", F.posexplode("values").alias("t_idx", "value"))


def from_points(long: DataFrame) -> DataFrame:
    """Curves from the long view; t_idx orders the values."""
    return long.groupBy("sample_id", "feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("t_idx", "value"))), lambda p: p["value"]).alias("values"))


def check_dense(curves: DataFrame) -> int:
    """The common number of values; raises ``ValueError`` for ragged curves, nulls, or samples that lack a feature."""
    r = curves.agg(
        F.min(F.size("values")).alias("lo"),
        F.max(F.size("values")).alias("hi"),
        F.max(F.exists("values", lambda v: v.isNull())).alias("nulls"),
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("sample_id").alias("s"),
        F.count_distinct("feature").alias("f"),
    ).first()
    if not r.n or r.lo != r.hi or r.nulls or r.n != r.s * r.f:
        raise ValueError("curves are not a dense (samples, features, steps) collection")
    return r.lo


def latent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, z array<double>, label) of the embeddings."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("z"), F.col("label").cast("int").alias("label"))


# --- wide files -----------------------------------------------------------------------------------------------


def wide(curves: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row a sample, columns f{feature}_t{step} feature by feature, then label if given."""
    steps = check_dense(curves)
    features = [r[0] for r in curves.select("feature").distinct().orderBy("feature").collect()]
    rows = curves.groupBy("sample_id").pivot("feature", features).agg(F.first("values"))
    if labels is not None:
        rows = rows.join(labels, "sample_id")
    cols = [F.col(f"`{f}`")[t].alias(f"f{f}_t{t}") for f in features for t in range(steps)]
    return rows.select("sample_id", *cols, *(["label"] if labels is not None else []))


def save_wide(curves: DataFrame, labels: DataFrame, path: str) -> None:
    """A CSV folder with a header; its rows carry no id, the order of rows is that of sample_id."""
    wide(curves, labels).orderBy("sample_id").drop("sample_id").write.mode("overwrite").option("header", True).csv(path)


def load_wide(spark: SparkSession, path: str, n_features: int, n_steps: int) -> tuple[DataFrame, DataFrame]:
    """(curves, labels) of such a CSV; ids number the rows in the files' order."""
    names = [c for c in spark.read.option("header", True).csv(path).columns if c != "label"]
    if len(names) != n_features * n_steps:
        raise ValueError(f"{len(names)} value columns, not {n_features} x {n_steps}")
    raw = spark.read.option("header", True).schema(", ".join([*(f"`{c}` double" for c in names), "label string"])).csv(path)
    rows = numbered(raw)
    per = F.array(*(F.array(*(F.col(f"`{c}`") for c in names[f * n_steps : (f + 1) * n_steps])) for f in range(n_features)))
    return (
        rows.select("sample_id", F.posexplode(per).alias("feature", "values")),
        rows.select("sample_id", "label"),
    )


def numbered(df: DataFrame) -> DataFrame:
    """``df``, read from files, with sample_id: the rows' numbers in the files' order, gapless, without a shuffle of the rows.

    Counts of the files' blocks, one row each, give the offsets.
    """
    names = df.columns
    part = df.select("*", F.col("_metadata.file_path").alias("__f"), F.col("_metadata.file_block_start").alias("__b")).withColumn("__m", F.monotonically_increasing_id())
    blocks = part.groupBy("__f", "__b").agg(F.count(F.lit(1)).alias("__n"), F.min("__m").alias("__first"))
    w = Window.orderBy("__f", "__b").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select("__f", "__b", "__first", F.coalesce(F.sum("__n").over(w), F.lit(0)).alias("__o"))
    return part.join(F.broadcast(before), ["__f", "__b"]).select((F.col("__o") + F.col("__m") - F.col("__first")).alias("sample_id"), *names)


def load_arff(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(curves, labels) of an ARFF file; labels are coded by first appearance.

    A relational file (one quoted series attribute with ``\\n`` between features, and a class) gives each feature
    rescaled to [-1, 1] on its own; a wide file has its last column as class and is rescaled as a whole.
    """
    lines = numbered(spark.read.text(path)).filter("trim(value) <> ''").filter(~F.trim("value").startswith("%"))
    at = lines.filter(F.lower(F.trim("value")) == "@data").agg(F.min("sample_id")).first()[0]
    if at is None:
        raise ValueError("no @data in the file")
    rows = lines.filter(F.col("sample_id") > at).select("sample_id", F.trim("value").alias("value"))
    relational = lines.filter(F.lower("value").contains(" relational")).count() > 0
    if relational:
        m = F.regexp_extract("value", r"^\s*[\"'](.*)[\"']\s*,\s*(.*)$", 1), F.regexp_extract("value", r"^\s*[\"'](.*)[\"']\s*,\s*(.*)$", 2)
        parsed = rows.select("sample_id", F.split(m[0], r"\\n").alias("dims"), F.trim(m[1]).alias("raw"))
        series = parsed.select("sample_id", F.posexplode("dims").alias("feature", "text"), "raw")
    else:
        parts = F.split("value", r"\s*,\s*")
        parsed = rows.select("sample_id", F.element_at(parts, -1).alias("raw"), F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ",").alias("text"))
        series = parsed.select("sample_id", F.lit(0).alias("feature"), "text", "raw")
    curves = series.select("sample_id", "feature", F.split("text", r"\s*,\s*").cast("array<double>").alias("values"))
    low = curves.groupBy("feature").agg(F.min(F.array_min("values")).alias("lo"), F.max(F.array_max("values")).alias("hi"))
    scaled = curves.join(low, "feature").select("sample_id", "feature", F.transform("values", lambda v: F.coalesce(F.try_divide(v - F.col("lo"), F.col("hi") - F.col("lo")), F.lit(0.5)) * 2 - 1).alias("values"))
    codes = parsed.groupBy("raw").agg(F.min("sample_id").alias("first"))
    ranked = codes.select("raw", (F.row_number().over(Window.orderBy("first")) - 1).cast("int").alias("label"))  # a row a class
    return scaled, parsed.join(ranked, "raw").select("sample_id", "label")


def load_ts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(curves, raw labels) of a .ts file: dimensions between colons, values between commas, the class last."""
    lines = numbered(spark.read.text(path)).filter(F.trim("value") != "").filter(~F.trim("value").rlike("^[#@]"))
    parts = F.split(F.trim("value"), ":")
    rows = lines.select("sample_id", F.slice(parts, F.lit(1), F.size(parts) - 1).alias("dims"), F.element_at(parts, -1).alias("label"))
    curves = rows.select("sample_id", F.posexplode("dims").alias("feature", "text")).select("sample_id", "feature", F.split("text", ",").cast("array<double>").alias("values"))
    return curves, rows.select("sample_id", "label")
