"""Resumable record stores and incremental counts.

A long run appends its records in partitions by key and, when it is started again, does only what is missing. The
streaming count is an extra for files that keep arriving.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from markweave.functions.scores import all_valid
from markweave.operators.experiments import remaining_work


def append_records(records: DataFrame, folder: str, partition_by: tuple[str, ...] = ("seed", "K")) -> None:
    """Append finished records; a key's partition is written by one commit."""
    records.write.mode("append").partitionBy(*partition_by).parquet(folder)


def completed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Records of earlier runs; none where nothing was written yet."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(folder)


def resume(wanted: DataFrame, folder: str, schema: T.StructType, keys: tuple[str, ...] = ("seed", "K", "target_id")) -> DataFrame:
    """The part of ``wanted`` without a record in the store."""
    return remaining_work(wanted, completed(wanted.sparkSession, folder, schema), keys)


def rater_count_stream(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Running total and valid rows per rater over Parquet files that arrive in a folder (update or complete mode)."""
    rows = spark.readStream.schema(schema).parquet(folder)
    return rows.groupBy("rater_id").agg(F.count("*").alias("total_sample_count"), F.count_if(all_valid()).alias("valid_sample_count"))


def event_window_counts(spark: SparkSession, folder: str, schema: T.StructType, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events per type and window, with a watermark for late ones (append mode)."""
    return spark.readStream.schema(schema).parquet(folder).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
