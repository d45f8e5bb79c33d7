"""Names, types, files, tables in documents, and streams."""

import tempfile

import pytest
from pyspark.sql import functions as F

from lumora.catalogue.ingest import workbook_bytes
from lumora.functions import columns as C
from lumora.operators import logs as L
from lumora.operators import report as R
from lumora.operators import schema as N
from lumora.sources import files as S
from lumora.sources import folders as D
from lumora.sources import sinks as K
from lumora.sources import tables as W
from lumora.streaming import logs as SL


@pytest.mark.parametrize("name", ["test_column", "test-column", "test  column", "TEST_COLUMN"])
def test_names_normalise(spark, name):
    assert N.normalize_name(name) == "test column"
    assert spark.createDataFrame([(name,)], "n string").select(C.normalize_name(F.col("n"))).first()[0] == "test column"


@pytest.mark.parametrize("name,values,kind,dtype", [
    ("test_numeric", [1, 2, 3, 4, 5], "long", "quantitative"), ("test_categorical", list("ABCAB"), "string", "qualitative"),
    ("date", ["2023-01-01", "2023-01-02", "2023-01-03"], "string", "datetime"), ("year", [2001, 2002, 2003], "long", "datetime"),
    ("montant", ["1.234,50 €", "12,00 €", "7 €"], "string", "quantitative"), ("empty", [None, None], "string", "qualitative"),
])
def test_types_are_inferred(spark, name, values, kind, dtype):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, {name} {kind}")
    row = N.infer_types(df, ["i"], [name]).first()
    assert row["dtype"] == dtype and (row["confidence"] > 0.5 or name == "empty")


@pytest.mark.parametrize("text,number", [
    ("1.234,50 €", 1234.5), ("1,234.50", 1234.5), ("12 %", 12.0), ("n/a", None), ("0,5", 0.5), ("1.234.567", 1234567.0), ("1,234,567", 1234567.0),
    ("1 234,5", 1234.5), ("-3,25", -3.25), ("$7", 7.0),
])
def test_numbers_in_either_notation(spark, text, number):
    assert spark.createDataFrame([(text,)], "t string").select(C.to_number(F.col("t"))).first()[0] == number


def test_safe_casts(spark):
    row = spark.createDataFrame([("123.45", "123", "invalid")], "a string, b string, c string").select(
        C.safe_float(F.col("a")), C.safe_int(F.col("b")), C.safe_float(F.col("c")), C.safe_divide(F.lit(1), F.lit(0))).first()
    assert tuple(row) == (123.45, 123, None, 0.0)


def test_mixed_dates_take_the_first_format_that_fits(spark):
    texts = ["2020-03-04", "25/12/2020", "2020-01-02 03:04:05", "12/31/2020", "31-01-2020", "no date"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, d string")
    got = [str(r["d"])[:10] for r in N.to_datetime(df, "d").orderBy("i").collect()]
    assert got == ["2020-03-04", "2020-12-25", "2020-01-02", "2020-12-31", "2020-01-31", "None"]


def test_overrides_are_kept_in_metadata(spark):
    df = N.apply_types(spark.createDataFrame([("1,5",), ("x",)], "v string"), {"v": "quantitative"})
    assert df.schema["v"].metadata["semantic_type"] == "quantitative" and [r[0] for r in df.collect()] == [1.5, None]
    assert N.temporal_columns(N.apply_types(spark.createDataFrame([("a",)], "my_date string"), {"my_date": "qualitative"})).first()["is_temporal"] is False


def test_trim_keeps_inner_gaps(spark):
    df = spark.createDataFrame([(0, None), (1, "a"), (2, None), (3, "b"), (4, None)], "i int, v string")
    assert [r["i"] for r in N.trim_table(df, "i").orderBy("i").collect()] == [1, 2, 3]


def test_encoding_and_separator():
    assert S.detect_encoding("né".encode("latin-1")) == "latin-1" and S.detect_encoding("né".encode()) == "utf-8"
    assert [S.detect_separator(t) for t in ("a;b;c,d", "a\tb", "a|b|c", "abc")] == [";", "\t", "|", ","]
    assert S.sniff_head("x/notes.txt", b"hello")["error"] and S.sniff_head("x/t.txt", b"a,b,c\n1,2,3")["format"] == "csv"
    assert S.sniff_head("x/empty.csv", b"")["error"] == "empty file"


def test_directory_with_a_broken_file(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    with open(f"{folder}/one.csv", "w") as f:
        f.write("Id;Amount\n1;2,5\n2;NA\n")
    with open(f"{folder}/two.csv", "w") as f:
        f.write("Id,Amount,Place\n3,4.5,north\n")
    with open(f"{folder}/three.json", "w") as f:
        f.write('{"data": [{"Id": 4, "Amount": 1.5}, {"Id": 5, "Amount": null}]}')
    with open(f"{folder}/broken.bin", "wb") as f:
        f.write(b"\x00\x01")
    got = S.ingest_directory(spark, folder)
    rows = sorted((int(r["id"]), r["amount"]) for r in got["unified"].collect())
    assert rows == [(1, 2.5), (2, None), (3, 4.5), (4, 1.5), (5, None)]
    log = {r["path"].rsplit("/", 1)[-1]: r["success"] for r in got["log"].collect()}
    assert log == {"one.csv": True, "two.csv": True, "three.json": True, "broken.bin": False}
    assert got["catalog"].count() == 3


def test_json_shapes(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    for name, text in (("list", '[{"a": 1}, {"a": 2}]'), ("records", '{"records": [{"a": 3}]}'), ("single", '{"a": 4}')):
        with open(f"{folder}/{name}.json", "w") as f:
            f.write(text)
    got = {n: sorted(r["a"] for r in S.read_json_any(spark, f"{folder}/{n}.json").collect()) for n in ("list", "records", "single")}
    assert got == {"list": [1, 2], "records": [3], "single": [4]}


def test_html_and_workbooks(spark):
    page = "<p>x</p><table><tr><th>a<th>b</tr><tr><td>1 &amp; 2</td><td><b>z</b></td></tr></table><table><tr><td>q</td></tr></table>"
    pages = spark.createDataFrame([("u", page), ("v", "none"), ("w", None)], "url string, html string")
    assert [(r["url"], r["table_count"], r["row"], r["cells"]) for r in W.html_tables(pages).orderBy("row").collect()] == [("u", 2, 0, ["a", "b"]), ("u", 2, 1, ["1 & 2", "z"])]
    assert W.html_tables(pages, all_tables=True).count() == 3
    odd = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("c", "<p>none</p>", 3), ("d", "<table><tr><td>x", 4), ("d", "<table><tr><td>x", 4)], "url string, html string, row int")
    assert [(r["url"], r["table_count"], r["row"], r["cells"]) for r in W.html_tables(odd).collect()] == [("d", 1, 0, ["x"])] * 2
    W.register_html_tables(spark, "tables_of")
    assert spark.sql("SELECT t.* FROM VALUES ('<table><tr><td>1</td></tr></table>') AS p(h), LATERAL tables_of(h, true) t").first()["cells"] == ["1"]
    books = spark.createDataFrame([("good", bytearray(workbook_bytes(["a", "b"], [1, "x"]))), ("bad", bytearray(b"no zip"))], "path string, content binary")
    rows = W.workbook_rows(books).orderBy("path", "row").collect()
    assert rows[0]["path"] == "bad" and rows[0]["error"] and [r["cells"] for r in rows[1:]] == [["a", "b"], ["1", "x"]]
    assert rows[1]["sheet_names"] == ["data"] and rows[1]["sheet"] == "data"


def test_report_styles(spark):
    rows = spark.createDataFrame([("s", "a", "metric", "1"), ("s", "b", "finding", "2")], "section string, item string, kind string, value_json string")
    assert [r["line"] for r in K.report_lines(rows, "markdown", "T").orderBy("line_no").collect()] == ["# T", "", "## s", "- **a**: 1", "- **b**: 2"]
    assert "<li><b>a</b>: 1</li>" in [r["line"] for r in K.report_lines(rows, "html").collect()]
    assert {r["kind"]: r["insights"] for r in R.insight_counts(rows).collect()} == {"finding": 1, "total": 1}
    assert not R.report_contract_check(rows).first()["valid"]


def test_stream_gives_what_the_batch_gives(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    lines = [f"2024-01-01 {h:02d}:{m:02d}:00 - s - {'ERROR' if m % 20 == 0 else 'INFO'} - text" for h in range(6) for m in range(0, 60, 5)]
    df = spark.createDataFrame([(t,) for t in lines], "value string")
    df.repartition(3).write.text(f"{folder}/in")
    batch = {(r["window_start"], r["lines"], r["error_lines"]) for r in SL.window_counts(df.withColumnRenamed("value", "line")).collect()}
    done = SL.run_once(SL.window_counts(SL.read_log_stream(spark, f"{folder}/in")), f"{folder}/out", f"{folder}/state")
    streamed = {(r["window_start"], r["lines"], r["error_lines"]) for r in done.collect()}
    assert streamed < batch and len(batch) - len(streamed) == 1  # the last hour is still open
    # a second run reads only new files
    df.limit(1).write.mode("append").text(f"{folder}/in")
    tail = SL.tail_logs(SL.read_log_stream(spark, f"{folder}/in"))
    first = SL.run_once(tail, f"{folder}/tail", f"{folder}/tail-state").count()
    assert SL.run_once(tail, f"{folder}/tail", f"{folder}/tail-state").count() == first == 19


def test_log_levels_take_the_first_match(spark):
    df = spark.createDataFrame([("INFO slow Error: x",), ("warn only",), ("debug user",), ("plain",)], "line string")
    rows = L.classify_log(df).collect()
    assert [r["level"] for r in rows] == ["error", "warning", "debug", None]
    assert rows[0]["is_exception"] and rows[0]["is_performance"] and rows[2]["is_user_action"]


def test_workbooks_and_pages_are_read_with_the_folder(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    for k in range(3):
        with open(f"{folder}/book{k}.xlsx", "wb") as f:
            f.write(workbook_bytes(["Id", "Amount"], [k, "1,5"], [k + 10, None]))
    with open(f"{folder}/broken.xlsx", "wb") as f:
        f.write(b"PK no workbook")
    with open(f"{folder}/page.html", "w") as f:
        f.write("<table><tr><th>Id</th><th>Place</th></tr><tr><td>20</td><td>north</td></tr></table>")
    with open(f"{folder}/long.csv", "w", encoding="latin-1") as f:
        f.write("Id,Place\n" + "".join(f"{100 + k},señor {k}\n" for k in range(3000)))  # longer than a head
    heads = S.sniff_files(spark, folder).collect()
    assert {r["path"].rsplit("/", 1)[-1]: r["encoding"] for r in heads if r["format"] == "csv"} == {"long.csv": "latin-1"} and len(heads) == 6
    tables, log = S.read_many(spark, folder)
    outcome = {r["path"].rsplit("/", 1)[-1]: r["success"] for r in log.collect()}
    assert outcome == {"book0.xlsx": True, "book1.xlsx": True, "book2.xlsx": True, "broken.xlsx": False, "page.html": True, "long.csv": True}
    sizes = sorted((t.columns, t.count()) for t in tables.values())
    assert sizes == [(["Id", "Amount"], 6), (["Id", "Place"], 1), (["Id", "Place"], 3000)]
    unified = S.ingest_directory(spark, folder)["unified"]
    assert unified.count() == 3007 and {"_type_id", "_type_amount", "_type_place"} <= set(unified.columns)
    assert unified.where("place like 'señor%'").count() == 3000 and unified.where("amount = 1.5").count() == 3


def test_shares_are_handed_on_in_bounded_batches(spark):
    folder = tempfile.mkdtemp(prefix="run-")
    for k in range(300):
        with open(f"{folder}/file{k}.csv", "wb") as f:
            f.write(b"a,b\n" + b"x" * 20_000)
    got = list(D.SOURCES["file_heads"]({"path": folder}).reader(None).read(D.Share(0, 1)))
    assert sum(b.num_rows for b in got) == 300 and len(got) > 1
    assert max(b.nbytes for b in got) < D.BATCH_BYTES + 2 * D.HEAD_BYTES
    rows = [("p", ["s"], "s", k, [str(k), None], None) for k in range(2 * D.BATCH_ROWS + 1)]
    books = list(D.batches(iter(rows), W.WORKBOOK_SCHEMA))
    assert [b.num_rows for b in books] == [D.BATCH_ROWS, D.BATCH_ROWS, 1] and list(D.batches(iter([]), W.WORKBOOK_SCHEMA)) == []
    assert [tuple(r.values()) for b in books for r in b.to_pylist()] == rows


def test_files_are_opened_by_one_python_step_and_parsed_once(spark, monkeypatch):
    folder = tempfile.mkdtemp(prefix="run-")
    for name, rows in (("full", [[None, " "], ["Id", "Amount"], [1, "1,5"], [None, None], [2, None]]), ("empty", [])):
        with open(f"{folder}/{name}.xlsx", "wb") as f:
            f.write(workbook_bytes(*rows))
    with open(f"{folder}/broken.xlsx", "wb") as f:
        f.write(b"PK no workbook")
    with open(f"{folder}/plain.csv", "w") as f:
        f.write("Id;Amount\n3;2\n")

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    sniffed, sheets = S.sniff_files(spark, folder), S._sheet_groups(spark, folder, "workbook_sheets")
    types = N.infer_types(spark.createDataFrame([(1, "1,5")], "i int, amount string").localCheckpoint(), ["i"])
    assert "MapInPandas" not in plan(sniffed) and plan(sheets).count("BatchScan") == 1
    assert plan(types).count("ExistingRDD") == 1  # the checkpoint; the short tables start no Python workers
    got = {(r["path"].rsplit("/", 1)[-1], r["row"], r["_top"], *(r["cells"] or []), *(r["_head"] or [])) for r in sheets.collect()}
    assert got == {("full.xlsx", 1, 1, "Id", "Amount", "Id", "Amount"), ("full.xlsx", 2, 1, "1", "1,5", "Id", "Amount"), ("full.xlsx", 4, 1, "2", None, "Id", "Amount"),
                   ("empty.xlsx", None, None), ("broken.xlsx", None, None)}
    first = {tuple(r) for r in sniffed.collect()}
    monkeypatch.setattr(S, "readable", lambda folder: False)  # as a store that only Spark opens
    monkeypatch.setattr(D, "readable", lambda folder: False)
    assert {tuple(r) for r in S.sniff_files(spark, folder).collect()} == first and len(first) == 4
