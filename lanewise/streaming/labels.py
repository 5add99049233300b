"""Labels on a stream of actions: they need one row only, so batch and stream share the code."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.functions.labels import enrich
from lanewise.sources.board_log import LOG


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Flat logs that arrive as Parquet files, labelled; repeats within two days count once."""
    return enrich(spark.readStream.schema(LOG).parquet(path)).withWatermark("date", "2 days").dropDuplicatesWithinWatermark(["board_id", "id"])


def activity(stream: DataFrame, window: str = "1 hour") -> DataFrame:
    """Card events per board, class and time window."""
    return stream.filter("c IS NOT NULL").groupBy("board_id", "c", F.window("date", window)).agg(F.count("*").alias("n"))
