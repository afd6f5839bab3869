"""Cutting lineage through files in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: What ``stash`` has written and nothing has deleted yet, in order.
_MADE: list[DataFrame] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode where it is unset (tests)."""
    sc = spark.sparkContext
    where = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not where:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        where = "file://" + tempfile.mkdtemp(prefix="undula-")
        sc.setCheckpointDir(where)
    return where


def stash(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends there, a lost executor loses nothing."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/undula-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._undula_path = path
    _MADE.append(out)
    return out


def drop_stash(df: DataFrame) -> None:
    """Delete what ``stash`` wrote, once everything that reads it has been written elsewhere."""
    path = getattr(df, "_undula_path", None)
    if path:
        jvm = df.sparkSession.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
        _MADE[:] = [d for d in _MADE if d._undula_path != path]


def made() -> int:
    """How many written tables there are: a mark for ``drop_since``."""
    return len(_MADE)


def drop_since(mark: int, but: DataFrame | None = None) -> None:
    """Delete what was written since the mark, once only ``but`` is read any more."""
    for df in _MADE[mark:]:
        if df is not but:
            drop_stash(df)
