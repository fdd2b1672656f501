"""Durable intermediates: Parquet in the folder named by ``spark.checkpoint.dir``."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows from which a table that is joined again and again is laid out in buckets.
BUCKET_FROM = 1_000_000

_written: dict[str, SparkSession] = {}
_tables: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a private one only where all of Spark is one process, as in tests."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spindrel-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    _written.pop(path, None)


def written(df: DataFrame, path: str | None = None) -> tuple[DataFrame, str]:
    """Write ``df`` and read it back, which cuts its lineage: (table, path)."""
    spark = df.sparkSession
    kept = path is not None
    path = path or f"{shared_dir(spark)}/spindrel/{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not kept:
        _written[path] = spark
    return spark.read.schema(df.schema).parquet(path), path


def observed(df: DataFrame, **metrics: Column) -> tuple[DataFrame, str, dict]:
    """``written`` with aggregates of the rows that are gathered while they are written."""
    seen = Observation()
    table, path = written(df.observe(seen, *[m.alias(name) for name, m in metrics.items()]))
    return table, path, seen.get


def counted(df: DataFrame) -> tuple[DataFrame, str, int]:
    """``written``, and the number of rows without another job."""
    table, path, seen = observed(df, n=F.count(F.lit(1)))
    return table, path, seen["n"]


def bucketed(df: DataFrame, column: str, rows: int) -> DataFrame:
    """``df`` written in buckets by a column, so that joins on it need not shuffle it again."""
    spark = df.sparkSession
    path, name = f"{shared_dir(spark)}/spindrel/{uuid.uuid4().hex}", f"spindrel_{uuid.uuid4().hex}"
    if rows < BUCKET_FROM:  # so few rows are sent sooner than buckets are laid out
        return written(df)[0]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(parts, column).write.bucketBy(parts, column).sortBy(column).option("path", path).saveAsTable(name)
    _written[path] = spark
    _tables[name] = spark
    return spark.table(name)


@atexit.register
def _clean() -> None:
    for name, spark in list(_tables.items()):
        try:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        except Exception:  # the JVM may be gone already
            return
    for path, spark in list(_written.items()):
        try:
            delete(spark, path)
        except Exception:  # the JVM may be gone already
            return
