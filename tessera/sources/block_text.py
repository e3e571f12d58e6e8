"""Unit-value files in blocks: banners, headers that change the administrators, decimal commas.

A file is Latin-1 text with ';' between cells. A banner line ('Valores Confirmados' or
'Valores Provisorios') sets the status of what follows; a line whose first cell is 'Fecha'
starts a new set of administrators, one for every second cell; data lines start with a date
and hold two cells, unit value and assets, for each administrator. All else is skipped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.text import canonical_name, local_number
from tessera.operators.segments import running

# Fixed values of the format.
BANNER, HEADER, DATE = r"^Valores (Confirmados|Provisorios)", "Fecha", r"^\d{4}-\d{2}-\d{2}$"
STATUS = {"Confirmados": "confirmed", "Provisorios": "provisional"}
FUND_OF_FILE = r"vcf([A-E])"


def read_unit_values(spark: SparkSession, path: str) -> DataFrame:
    """(fund, date, admin, unit_value, assets, status) of all files of a path or glob; the fund is in the name.

    Files are split at any byte as Spark splits text, so one large file is read by many tasks; each
    split hands its last header and banner on to those after it. Short lines are padded with nulls; cells
    that are no numbers are null; a null unit value is kept for the quality report.
    """
    # The text source hands bytes on as they are, so that they can be decoded here.
    text = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("no"), F.decode(F.col("value").cast("binary"), "ISO-8859-1").alias("line")
    )
    first = F.trim(F.get(F.split("line", ";"), 0))
    lines = text.select("file", "split", "no", F.split("line", ";").alias("cells"), first.alias("first"), F.regexp_extract("line", BANNER, 1).alias("banner"))
    # Odd places of the header hold names; where a cell is blank the columns go on without one.
    names = F.filter("cells", lambda c, i: (i > 0) & (i % 2 == 1) & (F.trim(c) != ""))
    header = F.when(F.col("first") == HEADER, F.transform(names, canonical_name))
    banner = F.when(F.col("banner") != "", F.col("banner"))
    known = running(lines, ["file"], ["split", "no"], {"admins": (header, "last"), "status": (banner, "last")}, segment=F.col("split"))
    rows = known.where(F.col("first").rlike(DATE) & F.col("admins").isNotNull())
    cells = rows.select("file", "cells", "status", F.col("first").try_cast("date").alias("date"), F.posexplode("admins").alias("k", "admin"))
    status = F.create_map(*[F.lit(x) for kv in STATUS.items() for x in kv])[F.col("status")]
    made = cells.select(
        F.regexp_extract("file", FUND_OF_FILE, 1).alias("fund"), "date", "admin", local_number(F.get("cells", 1 + 2 * F.col("k"))).alias("unit_value"), local_number(F.get("cells", 2 + 2 * F.col("k"))).alias("assets"),
        status.alias("status"),
    )
    return made.where("date is not null")


def unit_panel(rows: DataFrame) -> DataFrame:
    """Rows with a unit value, assets of 0 as null, and the daily return of each series."""
    from tessera.operators.panel import row_return

    known = rows.where("unit_value is not null").withColumn("assets", F.nullif("assets", F.lit(0.0)))
    return known.withColumn("ret", row_return("unit_value", ["fund", "admin"], "date"))


def real_panel(panel: DataFrame, deflator: DataFrame, members: DataFrame, jump: float = 0.10) -> DataFrame:
    """Adds level, real values and returns, adjusted real returns, and members as of each date.

    A real return is put to 0 where the nominal one was neutralised (``ret_adjusted`` is 0
    and ``ret`` jumps). Members come by administrator, as of the date; before an
    administrator's first count, that count.
    """
    from tessera.operators.asof import asof_backward
    from tessera.operators.panel import deflated, filled_both_ways, row_return

    real = deflated(panel, deflator, "unit_value", ["fund", "admin"], "date")
    real = real.withColumn("ret_real", row_return("unit_value_real", ["fund", "admin"], "date"))
    calm = (F.col("ret_adjusted") == 0) & (F.abs("ret") > jump)
    real = real.withColumn("ret_real_adjusted", F.when(calm, 0.0).otherwise(F.col("ret_real")))
    joined = asof_backward(real, members.withColumnRenamed("date", "members_date"), ["admin"], "date", "members_date", "n")
    return joined.withColumn("n", filled_both_ways("n", ["admin"], "date")).withColumnRenamed("n", "members").drop("members_date")


def system_index(panel: DataFrame, ret: str, since: str, confirmed_only: bool = True) -> DataFrame:
    """(fund, date, ret) of the whole system: returns weighted by assets; the first date's return is 0."""
    from tessera.operators.panel import weighted_mean

    kept = panel.where(F.col("date") >= F.lit(since).cast("date"))
    kept = kept.where(F.col("status") == "confirmed") if confirmed_only else kept
    daily = kept.groupBy("fund", "date").agg(weighted_mean(ret, "assets").alias("ret"))
    first = kept.agg(F.min("date").alias("_first"))
    return daily.crossJoin(F.broadcast(first)).select("fund", "date", F.when(F.col("date") == F.col("_first"), 0.0).otherwise(F.col("ret")).alias("ret"))
