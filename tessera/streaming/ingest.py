"""Streaming arrival of unit values, beyond the batch engine: deduplication, late data, months."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_VALUES = "fund string, admin string, ts timestamp, unit_value double, assets double, status string"


def unit_value_stream(spark: SparkSession, folder: str, schema: str = UNIT_VALUES, fmt: str = "parquet") -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).load(folder)


def deduplicated(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """One row per (fund, admin, ts, status), as far back as late rows may come; state beyond that is dropped."""
    return stream.withWatermark("ts", late).dropDuplicatesWithinWatermark(["fund", "admin", "ts", "status"])


def daily_totals(stream: DataFrame, late: str = "10 days") -> DataFrame:
    """(window, fund, n, assets, mean_value) of each day, final once the watermark has passed it."""
    day = F.window("ts", "1 day")
    return stream.withWatermark("ts", late).groupBy(day, "fund").agg(F.count(F.lit(1)).alias("n"), F.sum("assets").alias("assets"), F.avg("unit_value").alias("mean_value"))


def merge_statuses(rows: DataFrame) -> DataFrame:
    """Of the rows of a (fund, admin, ts), the confirmed one, else the provisional one."""
    return rows.groupBy("fund", "admin", "ts").agg(F.max_by(F.struct("unit_value", "assets", "status"), F.struct(F.col("status") == "confirmed", "unit_value")).alias("x")).select("fund", "admin", "ts", "x.*")


def write_to(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append"):
    """Append to a Parquet folder, exactly once by the checkpoint; ends when all that is there has been read."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start(folder)
