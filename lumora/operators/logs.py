"""Log lines and metric records as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators.relational import rank_within

# Patterns of levels (first match wins) and independent categories, and alert limits.
LEVELS = {"error": "ERROR|CRITICAL|FATAL", "warning": "WARNING|WARN", "info": "INFO", "debug": "DEBUG"}
CATEGORIES = {
    "exception": "Exception|Traceback|Error:", "performance": "performance|slow|timeout|memory",
    "user_action": "user|login|logout|upload|download", "data_processing": "data|processing|analysis|ingestion",
}
TIMESTAMP_PATTERN = r"(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2})"
ERROR_RATE, WARNING_RATE, EXCEPTIONS, SLOW_LINES = 0.1, 0.2, 10, 5
METRIC_LIMIT = 90


def _matches(line: Column, pattern: str) -> Column:
    return line.rlike(f"(?i){pattern}")


def parse_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `ts`: the first wall-clock time in the line (no time zone), null when there is none or it is no date."""
    text = F.nullif(F.regexp_extract(F.col(line), TIMESTAMP_PATTERN, 1), F.lit(""))
    return df.withColumn("ts", text.try_cast("timestamp_ntz"))


def recent(df: DataFrame, cutoff: str | None) -> Column:
    """Lines at or after the cutoff, and lines without a timestamp."""
    if cutoff is None:
        return F.lit(True)
    return F.col("ts").isNull() | (F.col("ts") >= F.lit(cutoff).cast("timestamp_ntz"))


def recent_log(df: DataFrame, cutoff: str | None, line: str = "line") -> DataFrame:
    return parse_log(df, line).where(recent(df, cutoff))


def classify_log(df: DataFrame, line: str = "line") -> DataFrame:
    """Add `level` and one flag per category."""
    level = None
    for name, pattern in LEVELS.items():
        hit = _matches(F.col(line), pattern)
        level = F.when(hit, name) if level is None else level.when(hit, name)
    return df.select("*", level.alias("level"), *[_matches(F.col(line), p).alias(f"is_{n}") for n, p in CATEGORIES.items()])


def classify_live(df: DataFrame, line: str = "line") -> DataFrame:
    """The reduced classes of live monitoring: error, warning, exception, performance; other lines are left out."""
    order = {"error": LEVELS["error"], "warning": LEVELS["warning"], "exception": CATEGORIES["exception"], "performance": CATEGORIES["performance"]}
    kind = None
    for name, pattern in order.items():
        hit = _matches(F.col(line), pattern)
        kind = F.when(hit, name) if kind is None else kind.when(hit, name)
    return df.withColumn("kind", kind).where(F.col("kind").isNotNull())


def _counters() -> list[Column]:
    inside = F.col("_in")
    levels = [F.sum((inside & F.col("level").eqNullSafe(n)).cast("long")).alias(f"{n}_lines") for n in LEVELS]
    flags = [F.sum((inside & F.col(f"is_{n}")).cast("long")).alias(f"{n}_lines") for n in CATEGORIES]
    return [F.count(F.lit(1)).alias("lines"), *levels, *flags]


def log_summary(df: DataFrame, by: Sequence[str] = ("file",), cutoff: str | None = None, line: str = "line") -> DataFrame:
    """Per file: all lines, and levels and categories of the lines in range, with level shares of all lines."""
    marked = classify_log(parse_log(df, line), line).withColumn("_in", recent(df, cutoff))
    counts = marked.groupBy(*by).agg(*_counters())
    return counts.select("*", *[(F.col(f"{n}_lines") * 100.0 / F.col("lines")).alias(f"{n}_pct") for n in LEVELS])


def log_totals(summary: DataFrame) -> DataFrame:
    names = ["lines", *[f"{n}_lines" for n in [*LEVELS, *CATEGORIES]]]
    total = summary.agg(F.count(F.lit(1)).alias("files"), *[F.sum(n).alias(n) for n in names])
    return total.select("*", *[F.coalesce(F.try_divide(F.col(f"{n}_lines") * 100.0, F.col("lines")), F.lit(0.0)).alias(f"{n}_pct") for n in LEVELS])


def first_lines(df: DataFrame, number: str = "line_no", by: Sequence[str] = ("file",), errors: int = 10, warnings: int = 10, cutoff: str | None = None, line: str = "line") -> DataFrame:
    """(file, level, rank, line number, line): the first error and warning lines per file."""
    marked = classify_log(parse_log(df, line), line).where(recent(df, cutoff) & F.col("level").isin("error", "warning"))
    ranked = rank_within(marked, [*by, "level"], [F.col(number)], max(errors, warnings))
    keep = F.col("_rank") <= F.when(F.col("level") == "error", errors).otherwise(warnings)
    return ranked.where(keep).select(*by, "level", F.col("_rank").alias("rank"), number, F.trim(F.col(line)).alias("line"))


def log_alerts(totals: DataFrame) -> DataFrame:
    """(alert, amount) rows for the limits that are exceeded."""
    rules = [
        ("error_rate", F.col("error_lines") / F.col("lines"), ERROR_RATE), ("warning_rate", F.col("warning_lines") / F.col("lines"), WARNING_RATE),
        ("exceptions", F.col("exception_lines").cast("double"), EXCEPTIONS), ("performance", F.col("performance_lines").cast("double"), SLOW_LINES),
    ]
    return _fired(totals, rules)


def _fired(df: DataFrame, rules: list[tuple[str, Column, float]], keep: Sequence[str] = ()) -> DataFrame:
    entries = [F.when(v > limit, F.struct(F.lit(n).alias("alert"), v.alias("amount"))) for n, v, limit in rules]
    return df.select(*keep, F.explode(F.array_compact(F.array(*entries))).alias("_a")).select(*keep, "_a.*")


def windowed_alerts(counts: DataFrame, keep: Sequence[str]) -> DataFrame:
    """The same limits over per-window counts."""
    rules = [
        ("error_rate", F.col("error_lines") / F.col("lines"), ERROR_RATE), ("warning_rate", F.col("warning_lines") / F.col("lines"), WARNING_RATE),
        ("exceptions", F.col("exception_lines").cast("double"), EXCEPTIONS), ("performance", F.col("performance_lines").cast("double"), SLOW_LINES),
    ]
    return _fired(counts, rules, keep)


METRIC_SCHEMA = (
    "timestamp string, cpu struct<percent:double,count:int>, memory struct<percent:double,available_gb:double,used_gb:double>, "
    "disk struct<percent:double,free_gb:double>"
)


def metric_summary(df: DataFrame, cutoff: str | None = None) -> DataFrame:
    """(resource, records, mean, max, min) over records after the cutoff."""
    kept = df
    if cutoff is not None:
        kept = df.where(F.col("timestamp").try_cast("timestamp_ntz") > F.lit(cutoff).cast("timestamp_ntz"))
    parts = ["cpu", "memory", "disk"]
    wide = kept.agg(F.count(F.lit(1)).alias("records"), *[f(f"{p}.percent").alias(f"{p}_{n}") for p in parts for n, f in (("mean", F.avg), ("max", F.max), ("min", F.min))])
    entries = F.array(*[F.struct(F.lit(p).alias("resource"), *[F.col(f"{p}_{n}").alias(n) for n in ("mean", "max", "min")]) for p in parts])
    return wide.select("records", F.explode(entries).alias("_e")).select("_e.resource", "records", "_e.mean", "_e.max", "_e.min")


def metric_alerts(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("max") > METRIC_LIMIT).select("resource", "max")


