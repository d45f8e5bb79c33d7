"""Writing tables, results and reports. Every write is distributed; lines of a report keep their order."""

from __future__ import annotations

import io
import json
import uuid
import zipfile

import tempfile

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T


def workspace(spark: SparkSession) -> str:
    """A fresh folder: below the shared checkpoint folder of the session, or a temporary one in local mode."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a shared folder")
        base = tempfile.mkdtemp(prefix="lumora-")
    return f"{base}/lumora-{uuid.uuid4().hex}"


def _flat(df: DataFrame) -> DataFrame:
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[
        F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema
    ])


def write_csv(df: DataFrame, path: str, sep: str = ",") -> None:
    """Nested values are written as JSON text."""
    _flat(df).write.mode("overwrite").option("header", True).option("sep", sep).option("escape", '"').csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_result(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result exports: decompositions, change points, forecasts, anomalies, metrics."""
    {"csv": write_csv, "parquet": write_parquet, "json": write_json}[fmt](df, path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def report_lines(items: DataFrame, style: str = "markdown", title: str = "Report") -> DataFrame:
    """(line_no, line) of a report in (section, item, value_json) rows; a report has few items, so one sorted list is enough."""
    rows = items.select("section", "item", "value_json").orderBy("section", "item").collect()
    out: list[str] = []
    if style == "html":
        out += [f"<html><head><meta charset='utf-8'><title>{title}</title></head><body>", f"<h1>{title}</h1>"]
    elif style == "markdown":
        out.append(f"# {title}")
    else:
        out += [title, "=" * len(title)]
    section = None
    for r in rows:
        if r["section"] != section:
            if style == "html" and section is not None:
                out.append("</ul>")
            section = r["section"]
            out += {"html": [f"<h2>{section}</h2>", "<ul>"], "markdown": ["", f"## {section}"]}.get(style, ["", section, "-" * len(section)])
        value = r["value_json"]
        out.append({"html": f"<li><b>{r['item']}</b>: {value}</li>", "markdown": f"- **{r['item']}**: {value}"}.get(style, f"{r['item']}: {value}"))
    if style == "html":
        out += (["</ul>"] if rows else []) + ["</body></html>"]
    return items.sparkSession.createDataFrame(list(enumerate(out)), "line_no int, line string")


def write_report(items: DataFrame, path: str, style: str = "json", title: str = "Report") -> None:
    """JSON items, or Markdown, HTML or plain text lines in order."""
    if style == "json":
        write_json(items, path)
    else:
        lines = report_lines(items, style, title)
        lines.orderBy("line_no").select("line").coalesce(1).write.mode("overwrite").text(path)


def write_log_analysis(df: DataFrame, path: str, hours: int = 24) -> None:
    """Log results with the time and span of the analysis."""
    write_json(df.withColumn("analysis_timestamp", F.current_timestamp()).withColumn("analysis_duration_hours", F.lit(hours)), path)


def as_json(value) -> str:
    return json.dumps(value, ensure_ascii=False)


def workbook_bytes(*rows):
    """A minimal workbook with one sheet."""
    cells = [
        "".join(f'<c t="inlineStr"><is><t>{v}</t></is></c>' if isinstance(v, str) else "<c/>" if v is None else f"<c><v>{v}</v></c>" for v in r) for r in rows
    ]
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="data" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>' + "".join(f"<row>{c}</row>" for c in cells) + "</sheetData></worksheet>")
    return out.getvalue()
