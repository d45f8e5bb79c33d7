"""Reports as rows: (section, item, kind, value_json). Each section is a small result of the other operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from lumora.operators import linear as L
from lumora.operators import models as M
from lumora.operators import quality as Q
from lumora.operators import univariate as U
from lumora.operators.bivariate import corr_matrix, most_correlated_pair, strong_pairs, vif_approx
from lumora.operators.relational import data_columns, data_names, moment_names, numeric_names, text_names
from lumora.operators.schema import scale
from lumora.operators.timeseries import trend
from lumora.plans.sizing import cut_lineage

DIGITS = 6
# Words that mark a time column in the temporal section.
TIME_NAME_WORDS = ["date", "fecha", "time", "tiempo", "year", "año"]


def _value(df: DataFrame, cols: Sequence[str]) -> Column:
    kinds = dict(df.dtypes)
    fields = [F.round(F.col(c), DIGITS).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in cols]
    return F.to_json(F.struct(*fields))


def items(df: DataFrame, section: str, name: str | None = None, by: Sequence[str] = (), kind: str = "metric") -> DataFrame:
    """Rows of a result as report items; without `by`, one item per column of a one-row result."""
    rest = [c for c in df.columns if c not in by]
    if by:
        label = F.concat_ws(".", *([F.lit(name)] if name else []), *[F.col(c).cast("string") for c in by])
        return df.select(F.lit(section).alias("section"), label.alias("item"), F.lit(kind).alias("kind"), _value(df, rest).alias("value_json"))
    kinds = dict(df.dtypes)

    def text(c: str) -> Column:
        v = F.round(F.col(c), DIGITS) if kinds[c] in ("double", "float") else F.col(c)
        return F.when(F.col(c).isNotNull(), F.get_json_object(F.to_json(F.struct(v.alias("v"))), "$.v"))

    entries = F.array(*[F.struct(F.lit(c).alias("item"), text(c).alias("value_json")) for c in rest])
    return df.select(F.explode(entries).alias("_e")).select(F.lit(section).alias("section"), "_e.item", F.lit(kind).alias("kind"), "_e.value_json")


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def executive_numbers(df: DataFrame) -> DataFrame:
    """Counts, completeness, quality score .7·completeness + 30·numeric share (0–100) and the finding on completeness."""
    numeric, text = len(numeric_names(df)), len(text_names(df))
    base = Q.quality_level(df).select((F.col("total_cells") / len(df.columns)).cast("long").alias("total_observations"), (100 - F.col("missing_percentage")).alias("completeness_rate"))
    share = numeric / (numeric + text) if numeric + text else 0.0
    c = F.col("completeness_rate")
    score = F.least(F.lit(100.0), F.greatest(F.lit(0.0), c * 0.7 + share * 30))
    finding = F.when(c > 90, "excellent_completeness").when(c > 75, "good_completeness").otherwise("low_completeness")
    return base.select(
        "total_observations", F.lit(numeric + text).cast("long").alias("total_variables"), F.lit(numeric).cast("long").alias("numeric_variables"),
        F.lit(text).cast("long").alias("categorical_variables"), "completeness_rate", score.alias("data_quality_score"), finding.alias("finding"))


def executive_summary(df: DataFrame) -> DataFrame:
    numbers = executive_numbers(df)
    found = [items(numbers.drop("finding"), "executive_summary"), items(numbers.select("finding"), "executive_summary", kind="finding")]
    return _union(found)


def quality_section(df: DataFrame) -> DataFrame:
    df = data_columns(df)
    return _union([
        items(Q.quality_score(df), "data_quality"),
        items(Q.quality_by_variable(df), "data_quality", "variable", ["variable"]),
        items(Q.missing_ranking(df), "data_quality", "missing", ["variable"]),
        items(Q.type_distribution(df), "data_quality", "types", ["physical", "semantic"]),
        items(Q.quality_recommendations(df), "data_quality", "recommendation", ["kind", "rule"], kind="recommendation"),
    ])


def descriptive_section(df: DataFrame, max_vars: int | None = None) -> DataFrame:
    numeric, text = numeric_names(df)[:max_vars], text_names(df)[:max_vars]
    parts = []
    if numeric:
        parts += [
            items(U.describe_numeric(df, numeric), "descriptive", "numeric", ["variable"]),
            items(U.skewness_ranking(df, numeric), "descriptive", "skewness", ["variable"]),
            items(U.distribution_type(df, numeric), "descriptive", "distribution", ["variable"]),
        ]
    if len(numeric) > 1:
        corr = cut_lineage(corr_matrix(df, numeric))  # one pass over the table for both items
        parts += [
            items(corr, "descriptive", "correlation", ["var1", "var2"]),
            items(most_correlated_pair(df, numeric, corr), "descriptive", "most_correlated", ["var1", "var2"], kind="finding"),
        ]
    if text:
        parts.append(items(U.describe_categorical(df, text), "descriptive", "categorical", ["variable"]))
    if numeric and text:
        parts.append(items(U.extreme_variables(df, numeric, text), "descriptive", "extreme", ["finding"], kind="finding"))
    return _union(parts)


def correlation_section(df: DataFrame, max_vars: int | None = None) -> DataFrame:
    numeric = numeric_names(df)[:max_vars]
    corr = cut_lineage(corr_matrix(df, numeric))  # one pass over the table for all items
    pairs = strong_pairs(df, numeric, corr=corr)
    return _union([
        items(corr, "correlation", "matrix", ["var1", "var2"]),
        items(pairs, "correlation", "strong", ["var1", "var2"], kind="finding"),
        items(vif_approx(df, numeric, corr), "correlation", "vif", ["variable"]),
        items(pairs.agg(F.count(F.lit(1)).alias("strong_pairs")), "correlation", kind="finding"),
    ])


def outlier_section(df: DataFrame) -> DataFrame:
    return items(U.outlier_report(df), "outliers", "variable", ["variable"])


def temporal_trends(df: DataFrame) -> DataFrame:
    """Trend of all numeric columns in the order of the first time column (ten rows or more)."""
    times = [c for c in data_names(df) if any(w in c.lower() for w in TIME_NAME_WORDS)]
    numeric = [c for c in numeric_names(df) if c not in times]
    if not times or not numeric:
        raise ValueError("a time column and a numeric column are needed")
    parts = []
    for c in numeric:
        # rows that tie in time and value are alike, so their order changes nothing
        ordered = df.select(times[0], c).dropna().withColumn("_tie", F.monotonically_increasing_id())
        series = ordered.select(F.struct(F.col(times[0]).alias("t"), F.col(c).alias("v"), "_tie").alias("ts"), F.col(c).cast("double").alias("value"))
        parts.append(trend(series, "ts", "value").where("n >= 10").select(F.lit(f"{times[0]}_{c}").alias("pair"), "n", "slope", "r_squared", "direction"))
    return _union(parts)


def temporal_section(df: DataFrame) -> DataFrame:
    return items(temporal_trends(df), "temporal", "trend", ["pair"])


def ml_section(df: DataFrame, max_vars: int | None = None, trees: int = 100) -> DataFrame:
    """Importances for the last numeric column, three clusters of standardised rows, components."""
    numeric = numeric_names(df)[:max_vars]
    data = df.select(*numeric).dropna()
    parts = []
    if len(numeric) > 2:
        parts += [
            items(M.feature_importance(data, numeric[:-1], numeric[-1], trees=trees), "ml", "importance", ["feature"]),
            items(L.pca_variance(data, numeric, scaled=False), "ml", "component", ["component"]),
        ]
    parts.append(items(M.kmeans_summary(data, numeric, 3), "ml", "cluster", ["cluster"]))
    return _union(parts)


def metadata_section(df: DataFrame, title: str) -> DataFrame:
    head = Q.table_overview(df).withColumn("title", F.lit(title)).withColumn("generated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
    return items(head, "metadata")


def key_metrics(df: DataFrame) -> DataFrame:
    """Missing level, complexity grade and priority of the executive report."""
    numeric = len(numeric_names(df))
    # Grades and their limits.
    complexity = "Alta" if numeric >= 10 else "Media" if numeric >= 5 else "Baja"
    m = F.col("missing_percentage")
    level = F.when(m > 20, "critical").when(m > 10, "attention").otherwise("excellent")
    return Q.quality_level(df).select(
        F.greatest(F.lit(0.0), 100 - m).alias("data_quality_score"), F.lit(complexity).alias("analysis_complexity"),
        F.when(m > 20, "Alta").when(m > 10, "Media").otherwise("Baja").alias("recommendation_priority"), level.alias("missing_level"))


def executive_report(df: DataFrame) -> DataFrame:
    numeric, text = numeric_names(df), text_names(df)
    parts = [items(key_metrics(df), "key_metrics"), items(Q.missing_ranking(df), "key_findings", "missing", ["variable"], kind="finding")]
    if numeric:
        parts.append(items(U.describe_numeric(df, numeric).select("variable", "mean", "std"), "key_findings", "numeric", ["variable"]))
    if len(numeric) > 1:
        parts.append(items(strong_pairs(df, numeric, 0.8), "recommendations", "correlated", ["var1", "var2"], kind="recommendation"))
    if text:
        parts.append(items(U.describe_categorical(df, text).select("variable", "unique", "top"), "key_findings", "categorical", ["variable"]))
    if moment_names(df) and numeric:
        parts.append(items(temporal_trends(df), "key_findings", "trend", ["pair"], kind="finding"))
    rules = [r for r, on in (("multivariate_analysis", len(numeric) >= 5), ("association_analysis", len(text) >= 3)) if on]
    if rules:
        parts.append(items(df.sparkSession.createDataFrame([(r, True) for r in rules], "rule string, advised boolean"), "recommendations", "analysis", ["rule"], kind="recommendation"))
    return _union(parts)


def report(df: DataFrame, kind: str = "complete", max_vars: int | None = None, trees: int = 100) -> DataFrame:
    """complete, quality, statistical, timeseries, ml or executive: the union of its section rows.

    Every section reads the table again; keep `df` as a stored or cached table.
    """
    numeric = numeric_names(df)
    has_time = any(any(w in c.lower() for w in TIME_NAME_WORDS) for c in data_names(df))
    sections = {
        "quality": lambda: [executive_summary(df), quality_section(df)],
        "statistical": lambda: [descriptive_section(df, max_vars)] + ([correlation_section(df, max_vars), outlier_section(df)] if len(numeric) > 1 else []),
        "timeseries": lambda: [temporal_section(df)] if has_time else [],
        "ml": lambda: [ml_section(df, max_vars, trees)],
        "executive": lambda: [executive_report(df)],
    }
    if kind == "complete":
        chosen = [p for k in ("quality", "statistical", "timeseries", "ml") for p in sections[k]()]
    else:
        chosen = sections[kind]()
    return _union([metadata_section(df, kind), *chosen])


def text_report(df: DataFrame) -> DataFrame:
    """(line_no, line): overview, statistics of the numeric columns, pairs above .7."""
    numeric = numeric_names(df)
    overview = Q.table_overview(df).first()
    lines = ["ANALYSIS REPORT", "", "OVERVIEW", *[f"{k}: {overview[k]}" for k in ("rows", "columns", "numeric_columns", "categorical_columns", "total_missing")]]
    if numeric:
        lines += ["", "DESCRIPTIVE STATISTICS"]
        for r in U.describe_numeric(df, numeric).orderBy("variable").collect():
            lines += [r["variable"], f"mean {r['mean']:.2f}, median {r['q50']:.2f}, std {r['std'] or 0:.2f}, min {r['min']:.2f}, max {r['max']:.2f}"]
    if len(numeric) > 1:
        pairs = strong_pairs(df, numeric, 0.7).collect()
        lines += ["", "CORRELATIONS", *([f"{p['var1']} - {p['var2']}: r = {p['r']:.3f}" for p in pairs] or ["no pair above 0.7"])]
    return df.sparkSession.createDataFrame(list(enumerate(lines)), "line_no int, line string")


REQUIRED_METADATA = ["title", "generated_at"]


def report_contract_check(rows: DataFrame) -> DataFrame:
    """(has_metadata, has_sections, tests_valid, valid): required items present, every p value within 0…1."""
    meta = F.col("section") == "metadata"
    p = F.get_json_object("value_json", "$.p_value").try_cast("double")
    is_test = F.col("kind") == "test"
    bad = is_test & (p.isNull() | ~p.between(0, 1) | F.get_json_object("value_json", "$.statistic").isNull())
    flags = rows.agg(
        *[F.max((meta & (F.col("item") == k)).cast("int")).alias(k) for k in REQUIRED_METADATA],
        F.max((~meta).cast("int")).alias("_s"), F.coalesce(F.sum(bad.cast("int")), F.lit(0)).alias("_bad"))
    has = reduce(lambda a, b: a & b, [F.coalesce(F.col(k) == 1, F.lit(False)) for k in REQUIRED_METADATA])
    return flags.select(has.alias("has_metadata"), F.coalesce(F.col("_s") == 1, F.lit(False)).alias("has_sections"), (F.col("_bad") == 0).alias("tests_valid")).withColumn(
        "valid", F.col("has_metadata") & F.col("has_sections") & F.col("tests_valid"))


def insight_counts(rows: DataFrame) -> DataFrame:
    """(kind, insights) of findings, alerts and recommendations, and their total."""
    kinds = ["finding", "alert", "recommendation"]
    counts = rows.where(F.col("kind").isin(kinds)).groupBy("kind").agg(F.count(F.lit(1)).alias("insights"))
    return counts.unionByName(counts.agg(F.coalesce(F.sum("insights"), F.lit(0)).alias("insights")).select(F.lit("total").alias("kind"), "insights"))
