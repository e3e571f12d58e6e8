"""Reports: CSV with fixed decimals, a JSON bundle, workbooks with live formulas, text between markers.

Tables go out through Spark's writers. Only reports, which are summaries of a few thousand
rows at most, pass through the driver, and that bound is checked.
"""

from __future__ import annotations

import gzip
import json
import math
import zipfile
from pathlib import Path
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REPORT_ROWS = 100_000


def fixed_decimals(df: DataFrame, digits: dict[str, int] | int = 6) -> DataFrame:
    """Doubles as text with a fixed number of decimals, null as null."""
    of = lambda c: digits if isinstance(digits, int) else digits.get(c, 6)
    return df.select(*[F.replace(F.format_number(c, of(c)), F.lit(","), F.lit("")).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | int = 6, compressed: bool = True) -> None:
    """A folder of CSV parts with headers, written by the executors."""
    fixed_decimals(df, digits).write.mode("overwrite").option("header", True).option("compression", "gzip" if compressed else "none").csv(path)


def report_rows(df: DataFrame) -> list[dict]:
    """Rows of a report; more than REPORT_ROWS are refused."""
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report has at most {REPORT_ROWS} rows; write the table instead")
    return [r.asDict(recursive=True) for r in rows]


def write_report_csv(df: DataFrame, file: str, digits: dict[str, int] | int = 6) -> None:
    """One gzip file whose bytes depend on the rows alone (its time stamp is 0)."""
    rows = report_rows(fixed_decimals(df, digits))
    text = ",".join(df.columns) + "\n" + "".join(",".join("" if r[c] is None else str(r[c]) for c in df.columns) + "\n" for r in rows)
    with open(file, "wb") as raw, gzip.GzipFile(filename="", mode="wb", fileobj=raw, mtime=0) as out:
        out.write(text.encode())


def _plain(x):
    if isinstance(x, dict):
        return {str(k): _plain(v) for k, v in x.items()}
    if isinstance(x, (list, tuple)):
        return [_plain(v) for v in x]
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x if x is None or isinstance(x, (bool, int, float, str)) else str(x)


def write_json(parts: dict, file: str) -> None:
    """A bundle of reports and plain values; DataFrames become lists of records, NaN becomes null."""
    made = {k: report_rows(v) if isinstance(v, DataFrame) else v for k, v in parts.items()}
    Path(file).write_text(json.dumps(_plain(made), ensure_ascii=False, allow_nan=False), encoding="utf-8")


def _column(k: int) -> str:
    name = ""
    while k:
        k, rest = divmod(k - 1, 26)
        name = chr(65 + rest) + name
    return name


def _cell(row: int, col: int, value) -> str:
    at = f"{_column(col)}{row}"
    if value is None or (isinstance(value, float) and not math.isfinite(value)):
        return ""
    if isinstance(value, str) and value.startswith("="):
        return f'<c r="{at}"><f>{escape(value[1:])}</f></c>'
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return f'<c r="{at}"><v>{value!r}</v></c>'
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def write_xlsx(sheets: dict[str, list[list]], file: str) -> None:
    """A workbook of sheets of rows; a string that starts with '=' is a formula."""
    names = list(sheets)
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    pack = "http://schemas.openxmlformats.org/package/2006"
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
    kind = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    with zipfile.ZipFile(file, "w", zipfile.ZIP_DEFLATED) as z:

        def put(name, text):
            z.writestr(zipfile.ZipInfo(name), head + text, zipfile.ZIP_DEFLATED)

        over = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="{kind}.worksheet+xml"/>' for i in range(1, len(names) + 1))
        put("[Content_Types].xml", f'<Types xmlns="{pack}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="{kind}.sheet.main+xml"/>{over}</Types>')
        put("_rels/.rels", f'<Relationships xmlns="{pack}/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        put("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>' + "".join(f'<sheet name="{escape(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(names, 1)) + "</sheets></workbook>")
        put("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{pack}/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(names) + 1)) + "</Relationships>")
        for i, n in enumerate(names, 1):
            body = "".join(f'<row r="{r}">{"".join(_cell(r, c, v) for c, v in enumerate(row, 1))}</row>' for r, row in enumerate(sheets[n], 1))
            put(f"xl/worksheets/sheet{i}.xml", f"<worksheet {ns}><sheetData>{body}</sheetData></worksheet>")


def sheet_of(df: DataFrame) -> list[list]:
    return [df.columns, *[[r[c] for c in df.columns] for r in report_rows(df)]]


def annuity_sheet(balance: float, rate: float, stay: list[float]) -> list[list]:
    """A live annuity simulator: monthly survival in column A, discount in B, their product in C, the pension on top."""
    n = len(stay)
    top = [["balance", balance], ["yearly rate", rate], ["factor", f"=SUM(C6:C{n + 5})"], ["pension", "=B1/B3"], ["alive", "discount", "value"]]
    rows = [[1.0 if k == 0 else f"=A{k + 5}*{stay[k - 1]!r}", f"=(1+$B$2)^(-{k}/12)", f"=A{k + 6}*B{k + 6}"] for k in range(n)]
    return top + rows


def replace_between(file: str, start: str, end: str, text: str) -> bool:
    """Put text between two markers of a file; False, and the file as it was, where they are not found."""
    path = Path(file)
    old = path.read_text(encoding="utf-8")
    a = old.find(start)
    b = old.find(end, a + len(start)) if a >= 0 else -1
    if b < 0:
        return False
    path.write_text(old[: a + len(start)] + text + old[b:], encoding="utf-8")
    return True
