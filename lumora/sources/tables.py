"""Tables inside HTML pages and workbooks, as rows of cells."""

from __future__ import annotations

import io
import re
import zipfile
from html.parser import HTMLParser
from typing import IO
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, functions as F

SHEET = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


class _Tables(HTMLParser):
    """Cells of every outer or nested table, in document order."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.tables: list[list[list[str]]] = []
        self.open: list[int] = []
        self.cell: list[str] | None = None

    def _close_cell(self) -> None:
        if self.cell is not None and self.open:
            rows = self.tables[self.open[-1]]
            if not rows:
                rows.append([])
            rows[-1].append(re.sub(r"\s+", " ", "".join(self.cell)).strip())
        self.cell = None

    def handle_starttag(self, tag, attrs):
        if tag == "table":
            self._close_cell()
            self.tables.append([])
            self.open.append(len(self.tables) - 1)
        elif self.open and tag == "tr":
            self._close_cell()
            self.tables[self.open[-1]].append([])
        elif self.open and tag in ("td", "th"):
            self._close_cell()
            self.cell = []

    def handle_endtag(self, tag):
        if tag in ("td", "th", "tr"):
            self._close_cell()
        elif tag == "table" and self.open:
            self._close_cell()
            self.open.pop()

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def page_tables(text: str) -> list[list[list[str]]]:
    """All tables of a page, as rows of cells."""
    parser = _Tables()
    parser.feed(text)
    parser.close()
    parser._close_cell()  # a page may break off inside a cell
    return [[r for r in t if r] for t in parser.tables]


@F.udtf(returnType="table_count int, table_index int, row int, cells array<string>")
class HtmlTables:
    """Table function over one page: a row per row of its first table, or of every table."""

    def eval(self, text: str, all_tables: bool):
        found = page_tables(text or "")
        for i, table in enumerate(found if all_tables else found[:1]):
            for k, cells in enumerate(table):
                yield len(found), i, k, cells


def register_html_tables(spark: SparkSession, name: str = "html_tables") -> None:
    """Make the table function known to SQL: `SELECT … FROM pages, LATERAL html_tables(html, true)`."""
    spark.udtf.register(name, HtmlTables)


def html_tables(pages: DataFrame, url: str = "url", html: str = "html", all_tables: bool = False) -> DataFrame:
    """(url, table_count, table_index, row, cells): the first (or every) table of each page, by a lateral join with a table function."""
    found = pages.select(F.col(url).alias("url"), F.col(html).alias("_html"))
    return found.lateralJoin(HtmlTables(F.col("_html").outer(), F.lit(all_tables))).select("url", "table_count", "table_index", "row", "cells")


def _column_number(ref: str) -> int:
    n = 0
    for ch in re.match(r"[A-Z]+", ref).group():
        n = n * 26 + ord(ch) - 64
    return n - 1


def workbook_sheet(content: bytes | IO[bytes], sheet: int | str = 0) -> tuple[list[str], str, list[list[str | None]]]:
    """(sheet names, chosen sheet, rows of cell texts) of one .xlsx file, given whole or as an open file."""
    with zipfile.ZipFile(io.BytesIO(content) if isinstance(content, bytes) else content) as z:
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        entries = [(s.get("name"), s.get(LINK)) for s in book.iter(f"{SHEET}sheet")]
        names = [n for n, _ in entries]
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        at = names.index(sheet) if isinstance(sheet, str) else sheet
        target = links[entries[at][1]].lstrip("/")
        target = target if target.startswith("xl/") else f"xl/{target}"
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            root = ElementTree.fromstring(z.read("xl/sharedStrings.xml"))
            shared = ["".join(t.text or "" for t in si.iter(f"{SHEET}t")) for si in root.iter(f"{SHEET}si")]
        rows: list[list[str | None]] = []
        for row in ElementTree.fromstring(z.read(target)).iter(f"{SHEET}row"):
            cells: list[str | None] = []
            for c in row.iter(f"{SHEET}c"):
                place = _column_number(c.get("r")) if c.get("r") else len(cells)
                cells += [None] * (place - len(cells))
                value = c.find(f"{SHEET}v")
                if c.get("t") == "inlineStr":
                    text = "".join(t.text or "" for t in c.iter(f"{SHEET}t"))
                elif value is None:
                    text = None
                else:
                    text = shared[int(value.text)] if c.get("t") == "s" else value.text
                cells.append(text)
            rows.append(cells)
        return names, names[at], rows


WORKBOOK_SCHEMA = "path string, sheet_names array<string>, sheet string, row int, cells array<string>, error string"


def workbook_rows(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """Rows of the first (or named) sheet of each workbook in (path, content); a broken file gives an error row."""

    def run(batches):
        import pandas as pd  # only here, as workers that read folders import this module too

        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    names, chosen, rows = workbook_sheet(bytes(content), sheet)
                    out += [(path, names, chosen, i, cells, None) for i, cells in enumerate(rows)]
                except Exception as e:  # noqa: BLE001  (the error row names the reason)
                    out.append((path, None, None, None, None, f"{type(e).__name__}: {e}"[:300]))
            frame = pd.DataFrame(out, columns=["path", "sheet_names", "sheet", "row", "cells", "error"])
            yield frame.astype({"row": "Int32"})

    return files.select("path", "content").mapInPandas(run, WORKBOOK_SCHEMA)


def read_workbooks(spark: SparkSession, folder: str, sheet: int | str = 0) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xlsx").load(folder)
    return workbook_rows(files, sheet)


def cells_to_columns(rows: DataFrame, names: list[str], skip: int = 1) -> DataFrame:
    """Cell arrays as named text columns, header rows left out."""
    cells = [F.try_element_at("cells", F.lit(i + 1)).alias(n) for i, n in enumerate(names)]
    keep = [c for c in ("path", "url") if c in rows.columns]
    return rows.where(F.col("row") >= skip).select(*keep, "row", *cells)
