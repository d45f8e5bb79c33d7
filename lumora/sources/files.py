"""Reading many files: discovery, format sniffing in one job, one scan per group of alike files."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lumora.functions.columns import null_tokens
from lumora.operators.schema import apply_types, clean_names, infer_types, tag_types, union_tables
from lumora.sources.folders import file_heads, read_folder, readable
from lumora.sources.sniff import FORMATS, SEPARATORS, SNIFF_SCHEMA, detect_encoding, detect_separator, sniff_head  # noqa: F401
from lumora.sources.tables import cells_to_columns
from lumora.plans.sizing import cut_lineage, join_on

def list_files(spark: SparkSession, folder: str, exts: Sequence[str] | None = None) -> DataFrame:
    """One row per file below `folder`. Only the listing is read; the content column is pruned."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    files = reader.load(folder).select("path", "length", "modificationTime")
    name = F.element_at(F.split("path", "/"), -1)
    ext = F.when(name.contains("."), F.lower(F.element_at(F.split(name, r"\."), -1))).otherwise("")
    rows = files.select(
        "path", name.alias("name"), ext.alias("ext"), F.col("length").alias("size"), F.round(F.col("length") / 1048576.0, 2).alias("size_mb"),
        F.col("modificationTime").alias("modified"), ext.isin(list(FORMATS)).alias("supported"))
    return rows.where(F.col("ext").isin([e.lower() for e in exts])) if exts else rows


def sniff_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, format, encoding, separator, header, error) for all files in one job, from their first bytes.

    Heads stay in the task that opens the files. Of a store that only Spark can open they come a hundred at a time.
    """
    if readable(folder):
        return read_folder(spark, "file_kinds", folder)
    found = F.udf(lambda path, head: tuple(sniff_head(path, bytes(head)).values()), SNIFF_SCHEMA, useArrow=False)
    return file_heads(spark, folder).select(found("path", "head").alias("found")).select("found.*")


def file_encodings(spark: SparkSession, folder: str) -> DataFrame:
    """(path, encoding) of every file."""
    return sniff_files(spark, folder).select("path", "encoding")


def _missing(df: DataFrame) -> DataFrame:
    kinds = dict(df.dtypes)
    return df.select(*[null_tokens(F.col(f"`{c}`")).alias(c) if kinds[c] == "string" else F.col(f"`{c}`") for c in df.columns])


def read_delimited(spark: SparkSession, paths: str | Sequence[str], sep: str = ",", encoding: str = "utf-8") -> DataFrame:
    """Delimited text with a header. Values stay text with missing tokens removed; types are inferred later."""
    charset = "utf-8" if encoding == "utf-8" else "iso-8859-1"  # what Spark calls the trial encodings
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", charset).option("multiLine", False)
    reader = reader.option("escape", '"').option("mode", "PERMISSIVE")
    return _missing(reader.csv(paths if isinstance(paths, str) else list(paths)))


def read_tsv(spark: SparkSession, paths: str | Sequence[str], encoding: str = "utf-8") -> DataFrame:
    return read_delimited(spark, paths, "\t", encoding)


def read_csv_auto(spark: SparkSession, path: str) -> DataFrame:
    """Separator and encoding from the first lines; other separators are tried when one column comes out."""
    lines = [bytes(r[0]) for r in spark.read.text(path).select(F.col("value").cast("binary")).limit(20).collect()]
    found = sniff_head(path if path.endswith(".csv") else path + "/x.csv", b"\n".join(lines))
    for sep in [found["separator"], *[s for s in SEPARATORS if s != found["separator"]]]:
        df = read_delimited(spark, path, sep, found["encoding"])
        if len(df.columns) > 1 and not df.isEmpty():
            return df
    raise ValueError(f"no separator gives more than one column: {path}")


def read_json_any(spark: SparkSession, paths: str | Sequence[str], lines: bool = False) -> DataFrame:
    """Records from a list, an object with `data` or `records`, a single object, or one object per line.

    A multi-line document is parsed by one task; use `lines` for files that should be split.
    """
    df = spark.read.option("multiLine", not lines).json(paths if isinstance(paths, str) else list(paths))
    kinds = dict(df.dtypes)
    holders = [c for c in ("data", "records") if kinds.get(c, "").startswith("array<struct")]
    if holders:
        items = F.coalesce(*[F.col(c) for c in holders]) if len({kinds[c] for c in holders}) == 1 else F.col(holders[0])
        df = df.select(F.explode(items).alias("_r")).select("_r.*")
    return df.drop("_corrupt_record")


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_xml(spark: SparkSession, paths: str | Sequence[str], row_tag: str = "row") -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(paths if isinstance(paths, str) else list(paths))


# ---------------------------------------------------------------- many files

_ALIKE = ["format", "encoding", "separator", "header"]


def _sheet_groups(spark: SparkSession, folder: str, source: str) -> DataFrame:
    """Rows of sheets or tables below their header row, with the header; empty rows don't count.

    Files are parsed once; the rows of a file, which one task has parsed, meet in a window.
    """
    rows = read_folder(spark, source, folder)
    rows = rows if "error" in rows.columns else rows.withColumn("error", F.lit(None).cast("string"))
    filled = rows.where(F.exists("cells", lambda c: F.coalesce(F.trim(c), F.lit("")) != "") | F.col("error").isNotNull())
    file = Window.partitionBy("path")
    top, head, error = F.min("row").over(file), F.min_by("cells", "row").over(file), F.max("error").over(file)
    return filled.select("path", "row", "cells", top.alias("_top"), head.alias("_head"), error.alias("_error"))


def _scan(spark: SparkSession, fmt: str, encoding: str, sep: str, paths: Sequence[str]) -> DataFrame:
    if fmt in ("csv", "tsv"):
        df = read_delimited(spark, paths, sep, encoding)
        if len(df.columns) < 2:
            raise ValueError("fewer than two columns")
    else:
        df = read_json_any(spark, paths) if fmt == "json" else spark.read.parquet(*paths) if fmt == "parquet" else read_xml(spark, paths)
    if not df.columns:
        raise ValueError("no columns")
    return df


def read_many(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables by group name, ingest log). Files with equal format, separator, encoding and header share a scan.

    Workbooks (first sheet) and pages (first table) are grouped by their header row. A group or file that cannot be
    read is recorded in the log and the others go on. The log is a DataFrame with a row per file; the paths of a
    group reach the driver, where Spark's own file index of the scan holds them too.
    """
    sniffed = cut_lineage(sniff_files(spark, folder))
    plain = sniffed.where(F.col("error").isNull() & ~F.col("format").isin("html", "xlsx"))
    groups = sorted(plain.groupBy(*_ALIKE).agg(F.sort_array(F.collect_list("path")).alias("paths")).collect(), key=lambda r: r["paths"][0])
    tables: dict[str, DataFrame] = {}
    outcome: list[tuple] = []
    for r in groups:
        name, error = f"group_{len(outcome)}_{r['format']}", None
        try:
            tables[name] = _scan(spark, r["format"], r["encoding"], r["separator"], r["paths"])
        except Exception as e:  # noqa: BLE001  (the log keeps the reason, other groups continue)
            name, error = None, re.sub(r"\s+", " ", str(e))[:300]
        outcome.append((*[r[c] for c in _ALIKE], name, error))
    logs = []
    known = spark.createDataFrame(outcome, "format string, encoding string, separator string, header string, table_name string, _error string")
    logs.append(join_on(plain, known, _ALIKE).select("path", "format", F.col("_error").isNull().alias("success"), F.col("_error").alias("error"), "table_name"))
    logs.append(sniffed.where("error IS NOT NULL").select("path", "format", F.lit(False).alias("success"), "error", F.lit(None).cast("string").alias("table_name")))
    formats = {r["format"] for r in sniffed.where("error IS NULL").select("format").distinct().collect()}
    for fmt, source in (("xlsx", "workbook_sheets"), ("html", "html_files")):
        if fmt not in formats:
            continue
        rows = cut_lineage(_sheet_groups(spark, folder, source))
        heads = sorted(r["_head"] for r in rows.where("_head IS NOT NULL").select("_head").distinct().collect())
        names = [(head, f"group_{len(outcome) + k}_{fmt}") for k, head in enumerate(heads)]
        outcome += names
        for head, name in names:
            cells = rows.where(F.col("_head").eqNullSafe(F.array(*[F.lit(h) for h in head])) & (F.col("row") > F.col("_top")))
            columns = [h if h and h.strip() else f"column_{i}" for i, h in enumerate(head)]
            tables[name] = _missing(cells_to_columns(cells, columns, 0).drop("path", "row"))
        named = spark.createDataFrame(names, "_head array<string>, table_name string")
        files = sniffed.where(F.col("format") == fmt).select("path").join(rows.groupBy("path").agg(F.first("_head").alias("_head"), F.first("_error").alias("_error")), "path", "left")
        reason = F.when(F.col("table_name").isNull(), F.coalesce("_error", F.lit("no table")))
        logs.append(files.join(named, "_head", "left").select("path", F.lit(fmt).alias("format"), F.col("table_name").isNotNull().alias("success"), reason.alias("error"), "table_name"))
    return tables, reduce(DataFrame.unionByName, logs)


def table_catalog(spark: SparkSession, tables: Mapping[str, DataFrame], types: Mapping[str, Mapping[str, str]], log: DataFrame) -> DataFrame:
    """One row per file: path, table, time columns and typed columns."""
    rows = []
    for name, kinds in types.items():
        times = [c for c, k in kinds.items() if k == "datetime"]
        rows.append((name, bool(times), times[0] if times else None, [(c, k) for c, k in kinds.items()]))
    schema = "table_name string, has_time_column boolean, time_column string, columns array<struct<name:string,dtype:string>>"
    if not rows:
        return spark.createDataFrame([], "file_path string, " + schema)
    return log.where("success").select(F.col("path").alias("file_path"), "table_name").join(spark.createDataFrame(rows, schema), "table_name")


def ingest_directory(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Read, clean, type and stack all files below `folder`: {unified, catalog, log}.

    Every column `c` has its inferred type in `_type_c`; numbers and dates are parsed by it. Rows come in order of the first
    time column, without a time last.
    """
    tables, log = read_many(spark, folder)
    typed, kinds = [], {}
    for name, raw in tables.items():
        df = clean_names(raw)
        found = {r["column"]: r["dtype"] for r in infer_types(df, df.columns[:1]).collect()}
        kinds[name] = found
        typed.append((name, tag_types(apply_types(df, found), found)))
    if not typed:
        raise ValueError(f"no readable file below {folder}")
    return {"unified": union_tables(typed), "catalog": table_catalog(spark, tables, kinds, log), "log": log}


# The two source files of the domain pair and their tags.
PAIR = [("rsa_ppa_s_agg_age.csv", "Age"), ("rsa_ppa_s_agg_sitfam.csv", "Situation_Familiale")]


def load_source_pair(spark: SparkSession, folder: str) -> DataFrame:
    """The two `;`-separated files, tagged by source and stacked by name."""
    parts = [read_delimited(spark, f"{folder}/{name}", ";").withColumn("Source", F.lit(tag)) for name, tag in PAIR]
    return parts[0].unionByName(parts[1], allowMissingColumns=True)

