"""Small input tables: deflators, members, mortality, macro series, as CSV or XLSX."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_deflator(spark: SparkSession, path: str) -> DataFrame:
    """(date, level) of a CSV with a header; of repeated dates the first line of the file counts."""
    rows = spark.read.schema("date date, level double").option("header", True).csv(path)
    first = Window.partitionBy("date").orderBy("_file", "_row")
    numbered = rows.select("*", F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_row")).withColumn("_k", F.row_number().over(first))
    return numbered.where("_k = 1 and date is not null").select("date", "level")


def read_macro(spark: SparkSession, path: str, indicators: list[str]) -> DataFrame:
    """(month, indicators...): the last known value of each month of a long CSV (date, indicator, value)."""
    rows = spark.read.schema("date date, indicator string, value double").option("header", True).csv(path)
    last = F.max_by("value", F.when(F.col("value").isNotNull(), F.col("date")))
    return rows.groupBy(F.last_day("date").alias("month")).pivot("indicator", indicators).agg(last)


def macro_variables(macro: DataFrame, last_month: str) -> DataFrame:
    """(month, inflation_12, policy_6, dollar_3, activity), none of it known before it was published.

    A calendar of months without gaps, each series carried forward first; the inflation of a
    month is published in the next, activity a month later still. Months before the first
    value of a variable take that value. A macro table has some hundred rows, in one order.
    """
    from tessera.operators.panel import filled_both_ways, log_change, previous, rolling_product

    span = macro.agg(F.min("month").alias("a"))
    spine = span.select(F.explode(F.sequence(F.trunc("a", "month"), F.lit(last_month).cast("date"), F.expr("interval 1 month"))).alias("m")).select(F.last_day("m").alias("month"))
    rows = spine.join(macro, "month", "left").withColumn("one", F.lit(1))
    forward = Window.partitionBy("one").orderBy("month").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({c: F.last(c, True).over(forward) for c in ("ipc", "tpm", "dolar", "imacec")})
    rows = rows.withColumn("year", rolling_product(1 + F.col("ipc") / 100, ["one"], "month", 12) - 1)
    made = rows.select(
        "one", "month", previous("year", ["one"], "month").alias("inflation_12"), (F.col("tpm") - previous("tpm", ["one"], "month", 6)).alias("policy_6"),
        log_change("dolar", ["one"], "month", 3).alias("dollar_3"), previous("imacec", ["one"], "month", 2).alias("activity"),
    )
    names = ["inflation_12", "policy_6", "dollar_3", "activity"]
    return made.withColumns({c: filled_both_ways(c, ["one"], "month") for c in names}).select("month", *names)


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, text, number) of every filled cell of XLSX files; rows and columns from 1.

    Only the standard library reads the archive. A workbook is one task's work.
    """
    import pandas as pd

    def cells(batches):
        import io
        import re
        import zipfile
        from xml.etree import ElementTree

        tag = lambda e: e.tag.rsplit("}", 1)[-1]
        for pdf in batches:
            for file, content in zip(pdf["path"], pdf["content"], strict=True):
                out = []
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    shared = []
                    if "xl/sharedStrings.xml" in z.namelist():
                        shared = ["".join(t.text or "" for t in si.iter() if tag(t) == "t") for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))]
                    rels = {r.get("Id"): r.get("Target").lstrip("/") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
                    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
                    for sheet in (s for s in book.iter() if tag(s) == "sheet"):
                        target = rels[next(v for k, v in sheet.attrib.items() if k.endswith("}id"))]
                        body = ElementTree.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
                        for c in (c for c in body.iter() if tag(c) == "c"):
                            letters, digits = re.match(r"([A-Z]+)(\d+)", c.get("r")).groups()
                            col = 0
                            for ch in letters:
                                col = col * 26 + ord(ch) - 64
                            value = next((v.text for v in c if tag(v) == "v"), None)
                            inline = "".join(t.text or "" for t in c.iter() if tag(t) == "t")
                            kind = c.get("t", "n")
                            text = shared[int(value)] if kind == "s" and value is not None else inline if kind == "inlineStr" else value
                            if text is not None:
                                out.append((file, sheet.get("name"), int(digits), col, text, float(value) if kind == "n" and value is not None else None))
                yield pd.DataFrame(out, columns=["file", "sheet", "row", "col", "text", "number"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(cells, "file string, sheet string, row int, col int, text string, number double")


def excel_date(number):
    """Days since 1899-12-30, as spreadsheets count them."""
    return F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int"))


def members_from_cells(cells: DataFrame, first_row: int = 3, columns: tuple[int, int, int] = (1, 2, 16), total: str = "SISTEMA") -> DataFrame:
    """(date, admin, n): members by date and administrator of the cells of a sheet, the total row left out."""
    from tessera.functions.text import canonical_name

    pick = lambda c, v: F.max(F.when(F.col("col") == c, F.col(v)))
    rows = cells.where(F.col("row") >= first_row).groupBy("file", "sheet", "row").agg(pick(columns[0], "number").alias("d"), pick(columns[0], "text").alias("dt"), pick(columns[1], "text").alias("admin"), pick(columns[2], "number").alias("n"))
    date = F.coalesce(excel_date(F.col("d")), F.substring("dt", 1, 10).try_cast("date"))
    named = rows.select(date.alias("date"), canonical_name(F.col("admin")).alias("admin"), "n").where(F.col("date").isNotNull() & F.col("admin").isNotNull() & (F.col("admin") != total))
    return named.groupBy("date", "admin").agg(F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"))


def mortality_from_cells(cells: DataFrame, sheets: dict[str, str], first_row: int = 4, age_col: int = 13, q_col: int = 14, factors: int = 16) -> DataFrame:
    """(sex, age, q0, aa): the table of each sheet named in {sheet: sex}; rows without a numeric age are notes."""
    pick = lambda c: F.max(F.when(F.col("col") == c, F.col("number")))
    sex = F.create_map(*[F.lit(x) for kv in sheets.items() for x in kv])[F.col("sheet")]
    rows = cells.where(F.col("row") >= first_row).withColumn("sex", sex).where("sex is not null")
    after = F.array_sort(F.collect_list(F.when((F.col("col") > q_col) & (F.col("col") <= q_col + factors) & F.col("number").isNotNull(), F.struct("col", "number"))))
    made = rows.groupBy("sex", "row").agg(pick(age_col).alias("age"), pick(q_col).alias("q0"), F.transform(after, lambda x: x["number"]).alias("aa"))
    return made.where("age is not null and q0 is not null").select("sex", F.col("age").cast("int").alias("age"), "q0", "aa")
