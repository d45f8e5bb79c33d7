"""Profiles, quality scores and checks. All columns share one aggregate wherever the result allows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators.relational import data_names, distinct_count, duplicate_rows, moment_names, numeric_names, text_names
from lumora.plans.quantiles import column_quantiles

# Quality labels and their upper bounds in percent of missing cells.
QUALITY_LEVELS = [("Excelente", 5), ("Buena", 15), ("Regular", 30), ("Pobre", None)]


def _q(c: str) -> Column:
    return F.col(f"`{c}`")


def quality_label(missing_percentage: Column) -> Column:
    label = None
    for name, bound in QUALITY_LEVELS:
        if bound is None:
            return label.otherwise(name)
        cond = missing_percentage < bound
        label = F.when(cond, name) if label is None else label.when(cond, name)
    return label


def _stack(df: DataFrame, cols: Sequence[str], stats: dict[str, object], extra: Sequence[Column] = ()) -> DataFrame:
    """One wide aggregate of `stats` per column, turned into one row per column."""
    aggs = [fn(c).alias(f"{i}_{name}") for i, c in enumerate(cols) for name, fn in stats.items()]
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), *extra, *aggs)
    entries = [
        F.struct(F.lit(c).alias("variable"), *[F.col(f"{i}_{name}").alias(name) for name in stats])
        for i, c in enumerate(cols)
    ]
    return wide.select("_rows", F.explode(F.array(*entries)).alias("_e")).select("_rows", "_e.*")


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per data column: type, total, non-null, null, unique, duplicates, completeness and number stats.

    Three passes: one map-side aggregate, one shuffle of distinct (column, value) pairs, one exact median.
    """
    cols = data_names(df)
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    numeric = set(numeric_names(df))

    def number(fn):
        return lambda c: (fn(_q(c).cast("double")) if c in numeric else F.lit(None).cast("double"))

    stats = {
        "non_null": lambda c: F.count(_q(c)),
        "minimum": number(F.min),
        "maximum": number(F.max),
        "mean": number(F.avg),
        "std": number(F.stddev_samp),
    }
    base = _stack(df, cols, stats)
    kind = F.create_map(*[F.lit(x) for c in cols for x in (c, types[c])])
    unique = distinct_count(df, cols, approximate)
    out = base.join(F.broadcast(unique), "variable", "left")
    if numeric:
        medians = column_quantiles(df, [c for c in cols if c in numeric], [0.5], ["median"])
        out = out.join(F.broadcast(medians), "variable", "left")
    else:
        out = out.withColumn("median", F.lit(None).cast("double"))
    return out.select(
        "variable", kind[F.col("variable")].alias("type"), F.col("_rows").alias("total"), "non_null",
        (F.col("_rows") - F.col("non_null")).alias("null_count"), F.col("unique_count"),
        (F.col("_rows") - F.col("unique_count")).alias("duplicates"),
        (F.col("non_null") * 100.0 / F.col("_rows")).alias("completeness"),
        "minimum", "maximum", "mean", "median", "std",
    )


def column_info(df: DataFrame, order: Sequence[str], samples: int = 5) -> DataFrame:
    """(name, null_count, unique_count, sample_values): samples are the first non-null values in `order`."""
    from lumora.operators.schema import _head_arrays

    cols = data_names(df)
    nulls = _stack(df, cols, {"null_count": lambda c: F.sum(_q(c).isNull().cast("long"))})
    heads = _head_arrays(df, cols, order).select(F.col("column").alias("variable"), F.slice("v", 1, samples).alias("sample_values"))
    joined = nulls.join(F.broadcast(distinct_count(df, cols)), "variable").join(F.broadcast(heads), "variable")
    return joined.select(F.col("variable").alias("name"), "null_count", "unique_count", "sample_values")


def ingestion_summary(catalog: DataFrame) -> DataFrame:
    """Totals over a catalog of (file_path, table_name, has_time_column, columns array<struct<name,dtype>>)."""
    def of_kind(kind: str) -> Column:
        return F.sum(F.size(F.filter("columns", lambda c: c["dtype"] == kind))).cast("long").alias(kind)

    return catalog.agg(
        F.count_distinct("file_path").alias("total_files"), F.count(F.lit(1)).alias("total_tables"),
        F.sum(F.size("columns")).cast("long").alias("total_columns"),
        F.sum(F.col("has_time_column").cast("long")).alias("tables_with_time"),
        *[of_kind(kind) for kind in ("quantitative", "qualitative", "datetime")],
    )


def _missing(df: DataFrame) -> Column:
    per_row = reduce(lambda a, b: a + b, [_q(c).isNull().cast("long") for c in df.columns])
    return F.coalesce(F.sum(per_row), F.lit(0))


def quality_level(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    base = df.agg((F.count(F.lit(1)) * width).alias("total_cells"), _missing(df).alias("missing_cells"))
    pct = F.coalesce(F.try_divide(F.col("missing_cells") * 100.0, F.col("total_cells")), F.lit(0.0))
    return base.withColumn("missing_percentage", pct).withColumn("quality", quality_label(F.col("missing_percentage")))


def summary_metrics(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    return quality_level(df).select(
        (F.col("total_cells") / width).cast("long").alias("total_observations"),
        F.lit(width).cast("long").alias("total_variables"),
        F.lit(len(numeric_names(df))).cast("long").alias("numeric_variables"),
        F.lit(len(text_names(df))).cast("long").alias("categorical_variables"),
        F.col("quality").alias("data_quality"), "missing_percentage",
        (100.0 - F.col("missing_percentage")).alias("completeness_score"),
    )


def quality_score(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """100 − 2·missing % − duplicate % − empty-column %, floored at 0; two one-row aggregates."""
    width = len(df.columns)
    empty = reduce(lambda a, b: a + b, [(F.count(_q(c)) == 0).cast("long") for c in df.columns])
    cells = df.agg(
        F.lit(1).alias("_j"), F.count(F.lit(1)).alias("total_rows"), _missing(df).alias("_missing"),
        empty.alias("empty_columns"),
    )
    copies = duplicate_rows(df).select(F.lit(1).alias("_j"), "duplicate_rows", "duplicate_percentage")
    both = cells.join(F.broadcast(copies), "_j").drop("_j")
    pct = F.coalesce(F.try_divide(F.col("_missing") * 100.0, F.col("total_rows") * width), F.lit(0.0))
    scored = both.withColumn("missing_percentage", pct)
    score = F.greatest(
        F.lit(0.0),
        100.0 - F.col("missing_percentage") * 2 - F.col("duplicate_percentage") - F.col("empty_columns") * 100.0 / width,
    )
    return scored.select(
        "total_rows", F.lit(width).cast("long").alias("total_columns"), "missing_percentage", "duplicate_rows",
        "empty_columns", score.alias("quality_score"), (score >= threshold * 100).alias("is_valid"),
    )


def quality_by_variable(df: DataFrame) -> DataFrame:
    """Missing share, unique ratio and issue codes per column."""
    cols = data_names(df)
    text = F.col("variable").isin(text_names(df))
    nulls = _stack(df, cols, {"_nulls": lambda c: F.sum(_q(c).isNull().cast("long"))})
    joined = nulls.join(F.broadcast(distinct_count(df, cols)), "variable")
    missing = F.col("_nulls") * 100.0 / F.col("_rows")
    ratio = F.col("unique_count") / F.col("_rows")
    issues = F.array_compact(
        F.array(
            F.when(missing > 20, "high_missing"),
            F.when((ratio < 0.01) & text, "few_unique_values"),
            F.when((missing > 0) & (missing < 5), "sporadic_missing"),
        )
    )
    return joined.select(
        "variable", missing.alias("missing_percentage"), ratio.alias("unique_ratio"),
        (100 - missing).alias("completeness_score"), F.array_join(issues, ",").alias("issues"),
    )


def missing_ranking(df: DataFrame) -> DataFrame:
    cols = data_names(df)
    nulls = _stack(df, cols, {"missing": lambda c: F.sum(_q(c).isNull().cast("long"))})
    return nulls.where(F.col("missing") > 0).select("variable", "missing").orderBy(F.desc("missing"), "variable")


def type_distribution(df: DataFrame) -> DataFrame:
    rows = []
    for f in df.schema:
        if not f.name.startswith("_"):
            kind = (
                "numeric" if f.name in numeric_names(df) else "temporal" if f.name in moment_names(df) else "categorical"
            )
            rows.append((f.dataType.simpleString(), (f.metadata or {}).get("semantic_type", kind)))
    schema = df.sparkSession.createDataFrame(rows, "physical string, semantic string")
    return schema.groupBy("physical", "semantic").agg(F.count(F.lit(1)).alias("columns"))


def table_overview(df: DataFrame, source: str = "_source_file") -> DataFrame:
    cols = data_names(df)
    sources = F.count_distinct(source) if source in df.columns else F.lit(0).cast("long")
    missing = reduce(lambda a, b: a + b, [_q(c).isNull().cast("long") for c in cols])
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.lit(len(cols)).cast("long").alias("columns"),
        F.lit(len(numeric_names(df))).cast("long").alias("numeric_columns"),
        F.lit(len(text_names(df))).cast("long").alias("categorical_columns"),
        F.coalesce(F.sum(missing), F.lit(0)).alias("total_missing"), sources.alias("source_files"),
    )


def quality_recommendations(df: DataFrame) -> DataFrame:
    """(kind, rule, amount) rows for the rules that fire."""
    numeric, text = len(numeric_names(df)), len(text_names(df))
    score = quality_score(df).select("missing_percentage", F.col("duplicate_rows").cast("double").alias("dup"))
    flagged = quality_by_variable(df).agg(
        F.sum((F.col("issues") != "").cast("double")).alias("flagged")
    )
    base = score.withColumn("_j", F.lit(1)).join(F.broadcast(flagged.withColumn("_j", F.lit(1))), "_j")
    complete = 100 - F.col("missing_percentage")
    rules = [
        ("quality", "impute_missing", complete < 80, complete),
        ("quality", "consider_imputation", (complete < 90) & (complete >= 80), complete),
        ("quality", "remove_duplicates", F.col("dup") > 0, F.col("dup")),
        ("quality", "review_variables", F.col("flagged") > 0, F.col("flagged")),
        ("analysis", "principal_components", F.lit(numeric > 5), F.lit(float(numeric))),
        ("analysis", "category_frequencies", F.lit(text > 0), F.lit(float(text))),
        ("modeling", "regression_clustering", F.lit(numeric > 2), F.lit(float(numeric))),
        ("modeling", "classification", F.lit(text > 1), F.lit(float(text))),
        ("action", "validate_with_stakeholders", F.lit(True), F.lit(None).cast("double")),
        ("action", "monitor_quality", F.lit(True), F.lit(None).cast("double")),
        ("action", "document_preprocessing", F.lit(True), F.lit(None).cast("double")),
        ("action", "consider_further_analysis", F.lit(True), F.lit(None).cast("double")),
    ]
    entries = [
        F.when(cond, F.struct(F.lit(kind).alias("kind"), F.lit(rule).alias("rule"), amount.alias("amount")))
        for kind, rule, cond, amount in rules
    ]
    return base.select(F.explode(F.array_compact(F.array(*entries))).alias("_e")).select("_e.*")


# ---------------------------------------------------------------- checks

def check_structure(df: DataFrame) -> DataFrame:
    width = len(df.columns)
    rows = df.limit(1).count()
    found = [("has_columns", width > 0), ("has_rows", rows > 0)]
    return df.sparkSession.createDataFrame(found, "check string, passed boolean")


def check_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, exists, numeric_type, not_convertible)."""
    present = [c for c in cols if c in df.columns]
    numeric = set(numeric_names(df))
    bad = _stack(
        df, present,
        {"not_convertible": lambda c: F.sum((_q(c).cast("string").try_cast("double").isNull()).cast("long"))},
    )
    rows = bad.select(
        "variable", F.lit(True).alias("exists"), F.col("variable").isin(list(numeric)).alias("numeric_type"), "not_convertible"
    )
    absent = [(c, False, False, None) for c in cols if c not in present]
    if absent:
        rows = rows.unionByName(df.sparkSession.createDataFrame(
            absent, "variable string, exists boolean, numeric_type boolean, not_convertible long"))
    return rows


def check_categorical(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Flag text columns with more distinct values than 90 % of the rows."""
    totals = _stack(df, cols, {})
    joined = totals.join(F.broadcast(distinct_count(df, cols)), "variable")
    return joined.select("variable", "unique_count", (F.col("unique_count") > F.col("_rows") * 0.9).alias("too_many_values"))


def check_time(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(variable, unparseable): non-null values that are not a date."""
    from lumora.functions.columns import DATE_FORMATS, to_moment

    def bad(c: str) -> Column:
        if c in moment_names(df):
            return F.lit(0).cast("long") * F.count(_q(c))
        text = _q(c).cast("string")
        parsed = F.coalesce(*[to_moment(text, f) for f in DATE_FORMATS], text.try_cast("timestamp"))
        return F.sum((text.isNotNull() & parsed.isNull()).cast("long"))

    rows = _stack(df, cols, {"unparseable": bad})
    return rows.select("variable", "unparseable", (F.col("unparseable") == 0).alias("valid"))


# Fewest (numeric, categorical, temporal) columns per analysis.
REQUIREMENTS = {
    "regression": (2, 0, 0), "classification": (1, 1, 0), "clustering": (2, 0, 0), "multivariate": (3, 0, 0),
    "time_series": (1, 0, 1),
}


def check_requirements(df: DataFrame, kind: str, min_rows: int = 10) -> DataFrame:
    """(kind, enough_columns, enough_rows, any_value, valid)."""
    have = (len(numeric_names(df)), len(text_names(df)), len(moment_names(df)))
    if kind == "univariate":
        enough = have[0] + have[1] > 0
    elif kind == "bivariate":
        enough = have[0] >= 2 or have[1] >= 2
    else:
        enough = all(h >= n for h, n in zip(have, REQUIREMENTS[kind]))
    any_value = reduce(lambda a, b: a | b, [F.count(_q(c)) > 0 for c in df.columns])
    base = df.agg((F.count(F.lit(1)) >= min_rows).alias("enough_rows"), any_value.alias("any_value"))
    return base.select(
        F.lit(kind).alias("kind"), F.lit(enough).alias("enough_columns"), "enough_rows", "any_value",
        (F.lit(enough) & F.col("enough_rows") & F.col("any_value")).alias("valid"),
    )


def check_corr_matrix(corr: DataFrame) -> DataFrame:
    """Over (var1, var2, r): square and within ±1.01."""
    n1, n2, cells = F.count_distinct("var1"), F.count_distinct("var2"), F.count(F.lit(1))
    inside = F.coalesce((F.min("r") >= -1.01) & (F.max("r") <= 1.01), F.lit(True))
    return corr.agg(((n1 == n2) & (cells == n1 * n2)).alias("square"), inside.alias("in_range"))


def check_ml_inputs(df: DataFrame, features: Sequence[str], target: str, kind: str) -> DataFrame:
    any_null = reduce(lambda a, b: a | b, [_q(c).isNull() for c in features])
    base = df.agg(
        F.count(F.lit(1)).alias("rows"), F.sum(any_null.cast("long")).alias("rows_with_missing_features"),
        F.sum(_q(target).isNull().cast("long")).alias("missing_target"),
        F.count_distinct(_q(target)).alias("classes"),
    )
    if kind == "classification":
        fine = (F.col("classes") >= 2) & (F.col("classes") <= F.col("rows") * 0.9)
    else:
        fine = F.lit(target in numeric_names(df))
    clean = (F.col("rows") > 0) & (F.col("rows_with_missing_features") == 0) & (F.col("missing_target") == 0)
    return base.withColumn("target_ok", fine).withColumn("valid", clean & fine)


def validation_suite(df: DataFrame) -> DataFrame:
    """(check, severity, subject, message) rows for failed checks, plus one `overall` row."""
    numeric, text = numeric_names(df), text_names(df)
    parts = [
        check_structure(df).where(~F.col("passed")).select(
            F.lit("structure").alias("check"), F.lit("error").alias("severity"), F.col("check").alias("subject"),
            F.lit("failed").alias("message"),
        )
    ]
    if numeric:
        parts.append(check_numeric(df, numeric).where("not_convertible > 0").select(
            F.lit("numeric").alias("check"), F.lit("error").alias("severity"), F.col("variable").alias("subject"),
            F.concat(F.col("not_convertible").cast("string"), F.lit(" values are not numbers")).alias("message")))
    if text:
        parts.append(check_categorical(df, text).where("too_many_values").select(
            F.lit("categorical").alias("check"), F.lit("error").alias("severity"), F.col("variable").alias("subject"),
            F.concat(F.col("unique_count").cast("string"), F.lit(" unique values")).alias("message")))
    parts.append(quality_score(df).where("not is_valid").select(
        F.lit("quality").alias("check"), F.lit("warning").alias("severity"), F.lit("table").alias("subject"),
        F.concat(F.lit("score "), F.format_number("quality_score", 1)).alias("message")))
    found = reduce(DataFrame.unionByName, parts)
    overall = found.agg(F.coalesce(F.sum((F.col("severity") == "error").cast("long")), F.lit(0)).alias("_e")).select(
        F.lit("overall").alias("check"), F.lit("info").alias("severity"), F.lit("table").alias("subject"),
        F.when(F.col("_e") == 0, "valid").otherwise("invalid").alias("message"))
    return found.unionByName(overall)
