"""Intake of an unbounded input of raw records."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from shelfwise.operators.intake import classify
from shelfwise.schemas import RAW


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def run_intake(raw: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Classify what has arrived and append it, partitioned by status; no state is kept."""
    return (
        classify(raw).writeStream.format("parquet").partitionBy("status")
        .option("path", out).option("checkpointLocation", checkpoint)
        .outputMode("append").trigger(availableNow=True).start()
    )
