"""The folder that all executors share, and intermediate tables in it."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def work_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of this machine only in local mode without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base:
        return base
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return _own.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="evidra-"))


def remove(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _remove_all() -> None:
    for spark, path in _written:
        try:
            remove(spark, path)
        except Exception:  # the session has ended: nothing more can be done here
            return


atexit.register(_remove_all)


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed at exit."""
    path = f"{work_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written and read back: the lineage is cut, and lost executors repeat nothing of it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, key: str, each: int) -> DataFrame:
    """rows (counted) dealt by key to as many tasks as hold about `each` of them, so that a task's share does not grow with the
    input; what groups by the key, alone or with others, needs no further shuffle."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-rows.count() // each)), key)
