"""Incremental parsing: a stream of HTML files, each parsed once. An extension; files seen are kept in the checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.parse import parse_documents
from ..sources.documents import stem


def html_stream(spark: SparkSession, path: str, files_a_batch: int = 1000) -> DataFrame:
    rows = spark.readStream.option("wholetext", True).option("maxFilesPerTrigger", files_a_batch).text(path)
    return rows.select(stem(F.col("_metadata.file_path")).alias("doc_id"), F.col("_metadata.file_path").alias("source_file"), F.col("value").alias("html"), F.lit(None).cast("string").alias("celex"))


def parse_stream(documents: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Writes units under ``out``/units, one folder a batch; a batch that runs again replaces its own folder."""

    def sink(batch: DataFrame, number: int) -> None:
        parse_documents(batch).units.write.mode("overwrite").parquet(f"{out}/units/batch={number}")

    writer = documents.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
