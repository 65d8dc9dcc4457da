"""Tables written once and read again by several branches of a plan, in the folder that the cluster shares."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SHUFFLES = re.compile(r"\b(Aggregate|Join|Window|Sort|Repartition\w*|RebalancePartitions|Distinct|Deduplicate|GlobalLimit|LogicalRDD)\b")


def shared_folder(spark: SparkSession) -> str:
    """What spark.checkpoint.dir names; a temporary folder only on a local master where it is unset."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        place = "file://" + tempfile.mkdtemp(prefix="legalspark-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def landed_once(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Removes landed tables that nothing needs any more; files elsewhere are left alone."""
    for df in tables:
        spark = df.sparkSession
        own = shared_folder(spark).rpartition("://")[2]
        for name in {f.rpartition("/")[0] for f in df.inputFiles()}:
            if own in name and re.search(r"-[0-9a-f]{32}$", name):
                path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
                path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a plain scan over all cores, if its files give fewer partitions than there are cores.

    Work in Python is dear beside moving its input once. A table of many files, as any large one is, stays as it is, and
    so does a plan with a shuffle, whose partitions are planned at run time.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if _SHUFFLES.search(rows._jdf.queryExecution().optimizedPlan().toString()) or rows.rdd.getNumPartitions() >= cores:
        return rows
    return rows.repartition(cores)
