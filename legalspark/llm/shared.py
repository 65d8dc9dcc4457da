"""Shared scratch tables and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a table of ids may be broadcast (16 bytes a row, about 64 MB).
BROADCAST_ROWS = 4_000_000


def scratch_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; a temporary one only on a local master without it."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="legalspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/") + "/legalspark"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def moved(df: DataFrame, name: str, *rest: DataFrame) -> DataFrame:
    """``written``, after which the scratch tables that ``df`` was read from, and ``rest``, are removed."""
    out = written(df, name)
    dropped(df, *rest)
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes scratch tables that nothing needs any more; other files are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = scratch_dir(spark).rpartition("://")[2].removeprefix("/")
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own in name:
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small_side(df: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Hints a broadcast if the narrow table has at most ``limit`` rows; beyond it the join is left to a shuffle."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= limit else df.hint("shuffle_hash")


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def as_long(col: str) -> Column:
    return F.col(col).cast("bigint")


def ids_of(df: DataFrame, col: str) -> np.ndarray:
    """A checked, narrow column of longs, sorted, on the driver."""
    return np.sort(df.select(col).toArrow().column(0).to_numpy().astype(np.int64))
