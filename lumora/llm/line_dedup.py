"""Line dedup: windows of three consecutive lines that occurred before, in any document, are removed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumora.llm.shared import fingerprint, fresh, id_and_text, let

#: Lines per window.
WIDTH = 3
NOT_BLANK = r"[^\x20\x09-\x0D]"
BLANKS = " \t\n\x0b\f\r"


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _windows(text: Column, width: int) -> Column:
    """Position and 128-bit hash of every window of `width` lines of which one or more isn't blank, and the text's print.

    Each line is hashed and looked at once; windows are made from the hashes of their lines. The print stands in the array,
    as a column beside it would be computed anew for each window, from a text that is copied as often.
    """

    def of_line(line: Column) -> Column:
        return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(width), line).alias("b"), (F.ltrim(line, F.lit(BLANKS)) != "").alias("filled"))

    def of_lines(found: Column) -> Column:
        lines = found["lines"]

        def at(i: Column) -> Column:
            part = [lines[i + k] for k in range(width)]
            filled = reduce(Column.__or__, [p["filled"] for p in part])
            hashes = [F.xxhash64(*[p["a"] for p in part]).alias("h1"), F.xxhash64(*[p["b"] for p in reversed(part)]).alias("h2")]
            return F.struct(found["print"].alias("print"), i.alias("pos"), *hashes, filled.alias("filled"))

        return F.when(F.size(lines) >= width, F.filter(F.transform(F.sequence(F.lit(0), F.size(lines) - width), at), lambda w: w["filled"]))

    return let(F.struct(F.transform(_lines(text), of_line).alias("lines"), fingerprint(text).alias("print")), of_lines)


def repeated_positions(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, print, at): for each document with repeated windows, the sorted starts of those that occurred before.

    Occurrences are ordered by doc_id (null first), print of the text and position. Windows are counted with partial
    sums, so a window that a third of all documents share is one row per task; the join that finds its occurrences
    is an inner join of two shuffled sides, which adaptive execution splits where a window is that frequent.
    """
    windows = docs.select("doc_id", F.explode_outer(_windows(F.col("text"), width)).alias("w")).where("w IS NOT NULL").select(
        "doc_id", "w.print", "w.pos", "w.h1", "w.h2"
    )
    place = F.struct("doc_id", "print", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("first")).where("n > 1").select("h1", "h2", "first")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    return later.groupBy("doc_id", "print").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def _without(text: Column, at: Column, width: int) -> Column:
    """The text without the lines that the windows at these positions cover; windows may overlap."""

    def of_lines(lines: Column) -> Column:
        covered = F.flatten(F.transform(at, lambda p: F.sequence(p, p + width - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), covered)
        return F.struct(F.array_join(F.transform(kept, lambda i: lines[i]), "\n").alias("text"), (F.size(lines) - F.size(kept)).cast("long").alias("removed"))

    return let(_lines(text), of_lines)


def with_repeats_removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> tuple[DataFrame, str, str]:
    """`docs` with two more columns, whose names follow: the new text, and the number of removed lines."""
    found = repeated_positions(id_and_text(docs, id_col, text_col), width)
    names = [fresh(docs, n) for n in ("_id", "_print", "_at", "_new", "_left", "_removed")]
    key, mark, at, new, left, removed = names
    found = found.toDF(key, mark, at)
    text = F.col(f"`{text_col}`")
    joined = docs.join(found, F.col(f"`{id_col}`").eqNullSafe(F.col(key)) & (fingerprint(text) == F.col(mark)), "left")
    made = joined.withColumn(new, F.when(F.col(at).isNotNull(), _without(text, F.col(at), width)))
    made = made.withColumn(left, F.when(F.col(new).isNull(), text).otherwise(F.col(new)["text"])).withColumn(removed, F.coalesce(F.col(new)["removed"], F.lit(0).cast("long")))
    return made.drop(key, mark, at, new), left, removed


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH) -> DataFrame:
    """One row per input row: doc_id, n_lines, n_removed and the text that is left.

    Of equal windows the first by (doc_id, text print, position) stays; every line inside a later one goes. Windows of
    blank lines only don't count. Texts of fewer than `width` lines have no window and stay as they are, null stays
    null with 0 lines. Rows that agree in id and text are one document: all get the same result.
    """
    made, left, removed = with_repeats_removed(id_and_text(docs, id_col, text_col), width=width)
    n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(_lines(F.col("text")))).cast("long")
    return made.select("doc_id", n_lines.alias("n_lines"), F.col(removed).alias("n_removed"), F.col(left).alias("kept_text"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars", width: int = WIDTH) -> DataFrame:
    """`docs` with shortened texts (and their new length in `chars_col`); a document that loses all its words goes."""
    made, left, removed = with_repeats_removed(docs, id_col, text_col, width)
    made = made.where((F.col(removed) == 0) | F.col(left).rlike(NOT_BLANK))
    text = F.col(left)
    values = {text_col: text}
    if chars_col and chars_col in docs.columns:
        values[chars_col] = F.when(F.col(removed) == 0, F.col(f"`{chars_col}`")).otherwise(F.length(text)).cast(docs.schema[chars_col].dataType)
    return made.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])
