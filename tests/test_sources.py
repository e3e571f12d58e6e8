"""Readers and writers over files made here."""

import gzip
import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

from pyspark.sql import functions as F

from tessera.operators import checks
from tessera.sources import block_text, rest, sinks, tables
from tessera.streaming import ingest

BLOCKS = """Valores Confirmados;;;;
Fecha;Capital ;Patrimonio;PlanVitál;Patrimonio
;valor cuota;;valor cuota;
2020-01-01;95.178,58;1.000,00;10,00;5,00
2020-01-02;95.200,00;0,00;;
nota al pie
2020-01-03;95.300,00
Valores Provisorios
Fecha;Capital;Patrimonio
2020-01-04;96.000,00;1.500,00
"""


def test_blocks(spark, tmp_path):
    (tmp_path / "vcfA2020.csv").write_bytes(BLOCKS.encode("latin-1"))
    (tmp_path / "vcfB2020.csv").write_bytes(BLOCKS.replace("2020", "2021").encode("latin-1"))
    rows = block_text.read_unit_values(spark, f"{tmp_path}/vcf*.csv")
    found = {(r["fund"], str(r["date"]), r["admin"]): (r["unit_value"], r["assets"], r["status"]) for r in rows.collect()}
    assert found["A", "2020-01-01", "CAPITAL"] == (95178.58, 1000.0, "confirmed")
    assert found["A", "2020-01-02", "PLANVITAL"] == (None, None, "confirmed")
    assert found["A", "2020-01-03", "CAPITAL"] == (95300.0, None, "confirmed")
    assert found["A", "2020-01-04", "CAPITAL"] == (96000.0, 1500.0, "provisional")
    assert ("A", "2020-01-04", "PLANVITAL") not in found and ("B", "2021-01-01", "CAPITAL") in found
    panel = block_text.unit_panel(rows)
    one = {str(r["date"]): r for r in panel.where("fund = 'A' and admin = 'CAPITAL'").collect()}
    assert one["2020-01-02"]["assets"] is None and abs(one["2020-01-02"]["ret"] - (95200 / 95178.58 - 1)) < 1e-12
    clean = checks.neutralised(panel, checks.rebase_events(panel.select("fund", "admin", "date", "ret")))
    deflator = spark.createDataFrame([("2020-01-02", 2.0), ("2020-01-04", 4.0)], "d string, level double").select(F.to_date("d").alias("date"), "level")
    members = spark.createDataFrame([("2020-01-03", "CAPITAL", 7.0)], "d string, admin string, n double").select(F.to_date("d").alias("date"), "admin", "n")
    real = {(r["admin"], str(r["date"])): r for r in block_text.real_panel(clean, deflator, members).where("fund = 'A'").collect()}
    assert real["CAPITAL", "2020-01-01"]["unit_value_real"] == 95178.58 / 2 and real["CAPITAL", "2020-01-04"]["unit_value_real"] == 24000.0
    assert real["CAPITAL", "2020-01-01"]["members"] == 7.0 and real["PLANVITAL", "2020-01-01"]["members"] is None
    index = {str(r["date"]): r["ret"] for r in block_text.system_index(clean, "ret_adjusted", "2020-01-01").where("fund = 'A'").collect()}
    assert index["2020-01-01"] == 0.0 and "2020-01-04" not in index


def test_one_file_in_many_splits(spark, tmp_path):
    """A file that is cut at every few thousand bytes, inside lines and between a header and its lines, is read as a whole one is."""
    import random

    rng, lines, want, names, status = random.Random(4), [], [], [], None
    for k in range(3000):
        if k % 400 == 0:
            status = ("confirmed", "provisional")[k // 400 % 2]
            lines.append({"confirmed": "Valores Confirmados;;", "provisional": "Valores Provisorios"}[status])
        if k % 150 == 0:
            names = rng.sample(["Capital", "PlanVit\u00e1l", "Modelo", "Uno", "H\u00e1bitat"], rng.randrange(1, 4))
            lines += ["Fecha;" + ";".join(f"{n};Patrimonio" for n in names), ";valor cuota;;" * len(names)]
        date = f"20{k // 336 + 10}-{k // 28 % 12 + 1:02d}-{k % 28 + 1:02d}"
        values = [rng.randrange(1000, 99999) for _ in names]
        lines.append(date + "".join(f";{v // 100},{v % 100:02d};{v},00" for v in values))
        want += [("A", date, n.upper().replace("\u00c1", "A"), v / 100, float(v), status) for n, v in zip(names, values)]
    (tmp_path / "vcfA.csv").write_bytes("\r\n".join(lines).encode("latin-1"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "5000")
        rows = block_text.read_unit_values(spark, f"{tmp_path}/vcf*.csv")
        assert spark.read.text(f"{tmp_path}/vcf*.csv").rdd.getNumPartitions() > 15
        got = sorted((r["fund"], str(r["date"]), r["admin"], r["unit_value"], r["assets"], r["status"]) for r in rows.collect())
    finally:
        spark.conf.set(key, before)
    assert got == sorted(want)


def test_small_tables(spark, tmp_path):
    (tmp_path / "uf.csv").write_text("date,level\n2020-01-02,2\n2020-01-01,1\n2020-01-02,3\n")
    got = {str(r["date"]): r["level"] for r in tables.read_deflator(spark, f"{tmp_path}/uf.csv").collect()}
    assert got == {"2020-01-01": 1.0, "2020-01-02": 2.0}
    lines = ["date,indicator,value"]
    for k in range(30):
        day = f"{2018 + k // 12}-{k % 12 + 1:02d}-15"
        lines += [f"{day},ipc,{10.0 if k == 20 else 0.0}", f"{day},tpm,{k}", f"{day},dolar,{100 + k}", f"{day},imacec,{k}"]
    (tmp_path / "macro.csv").write_text("\n".join(lines))
    macro = tables.read_macro(spark, f"{tmp_path}/macro.csv", ["ipc", "tpm", "dolar", "imacec"])
    made = tables.macro_variables(macro, "2020-06-30").orderBy("month").collect()
    assert len(made) == 30 and made[20]["inflation_12"] < 1e-9 and abs(made[21]["inflation_12"] - 0.1) < 1e-9
    assert made[29]["policy_6"] == 6 and made[29]["activity"] == 27


def test_workbooks(spark, tmp_path):
    file = f"{tmp_path}/members.xlsx"
    sinks.write_xlsx({"one & two": [["x"], ["h"], [43831, "Capital"] + [None] * 13 + [12.5], [43831, "SISTEMA"] + [None] * 13 + [99.0]], "calc": sinks.annuity_sheet(100.0, 0.03, [0.9, 0.8])}, file)
    cells = tables.read_xlsx(spark, file)
    members = tables.members_from_cells(cells.where("sheet = 'one & two'")).collect()
    assert [(str(r["date"]), r["admin"], r["n"]) for r in members] == [("2020-01-01", "CAPITAL", 12.5)]
    import zipfile

    sheet = zipfile.ZipFile(file).read("xl/worksheets/sheet2.xml").decode()
    assert "<f>SUM(C6:C7)</f>" in sheet and "<f>B1/B3</f>" in sheet
    table = [["t"], ["t"], ["t"], [None] * 12 + [65, 0.01, 0.02, 0.015], [None] * 12 + ["note", 1.0]]
    sinks.write_xlsx({"Men": table}, f"{tmp_path}/q.xlsx")
    got = tables.mortality_from_cells(tables.read_xlsx(spark, f"{tmp_path}/q.xlsx"), {"Men": "H"}).collect()
    assert [(r["sex"], r["age"], r["q0"], r["aa"]) for r in got] == [("H", 65, 0.01, [0.02, 0.015])]


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([(1, 1234.5, None), (2, None, "a")], "i int, x double, s string")
    for name in ("a.gz", "b.gz"):
        sinks.write_report_csv(df, f"{tmp_path}/{name}", 2)
    assert (tmp_path / "a.gz").read_bytes()[10:] == (tmp_path / "b.gz").read_bytes()[10:]
    assert gzip.open(tmp_path / "a.gz", "rt").read() == "i,x,s\n1,1234.50,\n2,,a\n"
    sinks.write_csv(df, f"{tmp_path}/out", 1)
    assert spark.read.option("header", True).csv(f"{tmp_path}/out").count() == 2
    sinks.write_json({"rows": df, "bad": float("nan"), "list": [1, (2.0, None)]}, f"{tmp_path}/x.json")
    assert json.loads((tmp_path / "x.json").read_text()) == {"rows": [{"i": 1, "x": 1234.5, "s": None}, {"i": 2, "x": None, "s": "a"}], "bad": None, "list": [1, [2.0, None]]}
    (tmp_path / "r.md").write_text("a<!--s-->old<!--e-->b")
    assert sinks.replace_between(f"{tmp_path}/r.md", "<!--s-->", "<!--e-->", "new") and (tmp_path / "r.md").read_text() == "a<!--s-->new<!--e-->b"


def test_rest_retries(spark):
    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):  # noqa: N802
            calls.append(self.path)
            if len(calls) == 1:
                self.send_error(503)
                return
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"serie": [{"fecha": "2020-01-01T03:00:00Z", "valor": 1.5}, {"fecha": "2020-01-04", "valor": 3}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    rows = rest.fetch_series(spark, f"http://127.0.0.1:{server.server_port}/{{indicator}}/{{year}}", ["uf"], [2020], wait=0.01)
    report = rest.series_report(rows, daily=True).first()
    server.shutdown()
    assert (report["n"], report["missing"], report["jumps"]) == (2, 2, 1)


def test_stream(spark, tmp_path):
    rows = [("A", "X", "2024-01-01 10:00:00", 1.0, 5.0, "provisional"), ("A", "X", "2024-01-01 10:00:00", 1.0, 5.0, "provisional"), ("A", "X", "2024-01-01 10:00:00", 1.1, 5.0, "confirmed")]
    df = spark.createDataFrame(rows, "fund string, admin string, t string, unit_value double, assets double, status string")
    df.select("fund", "admin", F.to_timestamp("t").alias("ts"), "unit_value", "assets", "status").write.parquet(f"{tmp_path}/in")
    stream = ingest.deduplicated(ingest.unit_value_stream(spark, f"{tmp_path}/in"))
    ingest.write_to(stream, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(120)
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2
    assert [r["unit_value"] for r in ingest.merge_statuses(out).collect()] == [1.1]
