"""Series of a JSON service, fetched per (indicator, year) with retries, as a DataFrame."""

from __future__ import annotations

import json
import time
import urllib.request

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fetch_json(url: str, tries: int = 4, wait: float = 1.0):
    """The document at a URL; failures are tried again, each time after twice the wait."""
    for k in range(tries):
        try:
            with urllib.request.urlopen(url, timeout=30) as r:  # noqa: S310
                return json.load(r)
        except (OSError, ValueError):
            if k == tries - 1:
                raise
            time.sleep(wait * 2**k)
    return None


def fetch_series(spark: SparkSession, url: str, indicators: list[str], years: list[int], tries: int = 4, wait: float = 1.0) -> DataFrame:
    """(date, indicator, value) of url.format(indicator=..., year=...), whose 'serie' lists 'fecha' and 'valor'."""

    def run(batches):
        for pdf in batches:
            for name, year in zip(pdf["indicator"], pdf["year"], strict=True):
                found = fetch_json(url.format(indicator=name, year=year), tries, wait).get("serie", [])
                yield pd.DataFrame({"day": [x["fecha"][:10] for x in found], "indicator": name, "value": [float(x["valor"]) for x in found]})

    tasks = spark.createDataFrame([(i, y) for i in indicators for y in years], "indicator string, year int")
    made = tasks.mapInPandas(run, "day string, indicator string, value double")
    return made.select(F.to_date("day").alias("date"), "indicator", "value")


def series_report(rows: DataFrame, daily: bool, jump: float = 0.05) -> DataFrame:
    """(indicator, n, missing, not_positive, jumps): gaps of a daily series, bad values, changes beyond the jump."""
    from tessera.operators.panel import row_return

    moved = rows.withColumn("r", row_return("value", ["indicator"], "date"))
    gaps = F.datediff(F.max("date"), F.min("date")) + 1 - F.count_distinct("date") if daily else F.lit(0)
    return moved.groupBy("indicator").agg(F.count(F.lit(1)).alias("n"), gaps.cast("bigint").alias("missing"), F.count_if(F.col("value") <= 0).alias("not_positive"), F.count_if(F.abs("r") > jump).alias("jumps"))
