"""Semantic types, name cleaning, conversion and reshaping."""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumora.functions import columns as C
from lumora.operators.relational import data_names, moment_names, numeric_names
from lumora.plans.quantiles import column_quantiles
from lumora.plans.order import ordered_index

# Words and patterns of the type rules.
TIME_WORDS = [
    "date", "fecha", "time", "tiempo", "year", "año", "month", "mes", "day", "día", "timestamp", "datetime",
    "period", "período", "référence", "reference", "année", "mois", "jour", "created", "updated", "modified",
    "created_at", "updated_at", "fecha_nacimiento", "birth_date", "fecha_inicio", "start_date", "fecha_fin",
    "end_date", "fecha_creacion", "creation_date",
]
QUANTITY_WORDS = [
    "nombre", "number", "count", "total", "sum", "amount", "value", "quantity", "volume", "rate", "percentage",
    "ratio", "index", "score", "nbre", "nb", "montant", "valeur", "age", "edad", "id", "code", "numero", "num",
    "rank", "position", "ordre", "order", "poblacion", "population", "habitants", "resident", "residents",
    "ingreso", "income", "salario", "salary", "precio", "price", "cost", "costo", "gasto", "expense", "peso",
    "weight", "altura", "height",
]
YEAR_WORDS = [
    "year", "año", "année", "period", "período", "période", "date", "fecha", "time", "tiempo", "temps", "nombre",
    "personnes",
]
NOT_QUANTITY_WORDS = ["year", "año", "année", "period", "período", "période", "date", "fecha", "time", "tiempo"]
YEAR_NAME_PATTERNS = ["year", "año", "date", "fecha", "time", "period", "nombre.*personnes"]
DATE_TEXT_PATTERN = (
    r"\d{4}-\d{1,2}-\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{2}-\d{2}-\d{4}|\d{4}/\d{2}/\d{2}"
    r"|\d{4}年\d{1,2}月\d{1,2}日|\d{4}\.\d{2}\.\d{2}|\d{2}\.\d{2}\.\d{4}|\d{4} \d{2} \d{2}|\d{2} \d{2} \d{4}"
)
FIRST_TIME_WORDS = ["date référence", "date_reference", "date reference", "référence", "reference"]
NEXT_TIME_WORDS = [
    "date", "fecha", "time", "tiempo", "year", "año", "année", "period", "período", "période", "réf", "ref",
    "début", "debut", "begin", "fin", "end",
]
YEAR_MIN, YEAR_MAX = 1900, 2100


# ---------------------------------------------------------------- names

def clean_name_list(names: Sequence[str], style: str = "snake") -> list[str]:
    out: list[str] = []
    for i, name in enumerate(names, 1):
        text = str(name).strip()
        if style == "snake":
            text = re.sub(r"\s+", "_", re.sub(r"[^\w\s]", "_", text)).lower()
        else:
            text = re.sub(r"[^\w]", "", re.sub(r"\s+", "_", text))
        if not text or text == "nan":
            text = f"column_{i}"
        if style != "snake":
            base, k = text, 1
            while text in out:
                text, k = f"{base}_{k}", k + 1
        out.append(text)
    return out


def clean_names(df: DataFrame, style: str = "snake") -> DataFrame:
    return df.toDF(*clean_name_list(df.columns, style))


def normalize_name(name: str) -> str:
    return re.sub(r"\s+", " ", name.lower().replace("_", " ").replace("-", " ")).strip()


# ---------------------------------------------------------------- table edges

def trim_table(df: DataFrame, order: str) -> DataFrame:
    """Drop all-null rows before the first and after the last row that holds a value."""
    filled = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in df.columns if c != order])
    edge = df.where(filled).agg(F.min(order), F.max(order)).first()
    return df.where(F.col(order).between(edge[0], edge[1]))


# ---------------------------------------------------------------- type inference

#: Values of a column that tell its type.
HEAD_VALUES = 100


def _head_arrays(df: DataFrame, cols: Sequence[str], order: Sequence[str]) -> DataFrame:
    """(column, v): the first HEAD_VALUES non-null values of each column as text, in `order`, in one pass.

    Each task keeps its least values per column; these short lists are merged per column.
    """
    keys = [f"_o{i}" for i in range(len(order))]
    keyed = df.select(*[F.col(f"`{o}`").alias(k) for o, k in zip(order, keys)], *[F.col(f"`{c}`").cast("string").alias(f"_c{i}") for i, c in enumerate(cols)])
    by = [(k, "ascending") for k in keys]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, pa.Table] = {}
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows.take(pc.sort_indices(rows, sort_keys=by, null_placement="at_start"))
            for i in range(len(cols)):
                own = rows.select([*keys, f"_c{i}"]).filter(pc.is_valid(rows.column(f"_c{i}"))).slice(0, HEAD_VALUES).rename_columns([*keys, "v"])
                if i in best and own.num_rows:
                    own = pa.concat_tables([best[i], own])
                    own = own.take(pc.sort_indices(own, sort_keys=by, null_placement="at_start")).slice(0, HEAD_VALUES)
                best[i] = own if own.num_rows else best.get(i, own)
        for i, rows in best.items():
            yield from rows.append_column("at", pa.array([i] * rows.num_rows, pa.int32())).to_batches()

    kinds = ", ".join(f"{k} {keyed.schema[k].dataType.simpleString()}" for k in keys)
    lists = keyed.mapInArrow(least, f"{kinds}, v string, at int")
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy("at").orderBy(*keys))).where(F.col("r") <= HEAD_VALUES)
    heads = ranked.groupBy("at").agg(F.array_sort(F.collect_list(F.struct("r", "v"))).alias("s"))
    named = df.sparkSession.createDataFrame(pa.table({"at": pa.array(range(len(cols)), pa.int32()), "column": pa.array(cols, pa.string())}))
    return named.join(heads, "at", "left").select("column", F.coalesce(F.transform("s", lambda s: s["v"]), F.array().cast("array<string>")).alias("v"))


def infer_types(df: DataFrame, order: Sequence[str], cols: Sequence[str] | None = None) -> DataFrame:
    """(column, dtype, confidence) by the three-stage rule over the first 100 non-null values."""
    spark = df.sparkSession
    cols = list(cols or data_names(df))
    numeric = set(numeric_names(df))
    heads = _head_arrays(df, cols, order)

    rules = []
    for c in cols:
        name = normalize_name(c)
        year = 0.4 * any(w in name for w in YEAR_WORDS) + 0.3 * any(re.search(p, name) for p in YEAR_NAME_PATTERNS)
        date = 0.4 * any(w in name for w in TIME_WORDS)
        quantity = 0.4 * any(w in name for w in QUANTITY_WORDS) + 0.2 * (c in numeric)
        rules.append({"column": c, "year": float(year), "date": float(date), "quantity": float(quantity), "veto": any(w in name for w in NOT_QUANTITY_WORDS)})
    # an Arrow table is a local relation; a list of rows would start Python workers in every task of its scan
    kinds = pa.schema([("column", pa.string()), ("year", pa.float64()), ("date", pa.float64()), ("quantity", pa.float64()), ("veto", pa.bool_())])
    scores = spark.createDataFrame(pa.Table.from_pylist(rules, kinds))

    def number(t: Column, symbols: str) -> Column:
        return F.translate(F.regexp_replace(t, ",", "."), symbols, "").try_cast("double")

    def share(hits: Column, of: Column) -> Column:
        return F.coalesce(F.try_divide(hits.cast("double"), F.size(of).cast("double")), F.lit(0.0))

    first50, first20 = F.slice("v", 1, 50), F.slice("v", 1, 20)
    years = F.array_sort(F.filter(
        F.transform(first50, lambda t: number(t, " ")), lambda x: x.between(YEAR_MIN, YEAR_MAX)
    ))
    gaps = F.zip_with(F.slice("years", 2, 50), F.slice("years", 1, F.greatest(F.size("years") - 1, F.lit(0))),
                      lambda a, b: a - b)
    close = (F.size("years") >= 3) & F.forall(gaps, lambda d: d.between(1, 5))

    def dated(t: Column) -> Column:
        parsed = F.coalesce(*[C.to_moment(t, f) for f in C.DATE_FORMATS], t.try_cast("timestamp"))
        return parsed.isNotNull() | t.rlike(DATE_TEXT_PATTERN)

    def counted(t: Column) -> Column:
        x = number(t, " %$€")
        clean = F.translate(F.regexp_replace(t, ",", "."), " %$€", "")
        year_like = x.between(YEAR_MIN, YEAR_MAX) & (F.length(clean) == 4)
        finite = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        return F.coalesce(finite & ~year_like & (x != 0), F.lit(False))

    scored = (
        heads.join(F.broadcast(scores), "column")
        .withColumn("years", years)
        .select(
            "column", "v",
            F.least(F.lit(1.0), F.col("year") + share(F.size("years"), first50) * 0.6 + F.when(close, 0.2).otherwise(0.0)).alias("t"),
            F.least(F.lit(1.0), F.col("date") + share(F.size(F.filter(first20, dated)), first20) * 0.6).alias("d"),
            F.when(F.col("veto"), 0.0).otherwise(
                F.least(F.lit(1.0), F.col("quantity") + share(F.size(F.filter("v", counted)), F.col("v")) * 0.6)
            ).alias("q"),
        )
    )
    empty = F.size("v") == 0
    dtype = (
        F.when(empty, "qualitative").when(F.col("t") > 0.5, "datetime").when(F.col("d") > 0.6, "datetime")
        .when(F.col("q") > 0.5, "quantitative").otherwise("qualitative")
    )
    confidence = (
        F.when(empty, 0.0).when(F.col("t") > 0.5, F.col("t")).when(F.col("d") > 0.6, F.col("d"))
        .when(F.col("q") > 0.5, F.col("q")).otherwise(0.8)
    )
    return scored.select("column", dtype.alias("dtype"), confidence.alias("confidence"))


def infer_types_by_cast(df: DataFrame, mode: str = "simple") -> DataFrame:
    """(column, dtype, confidence) from one aggregate of cast failures.

    simple: dates .9, numbers .8, others .6. strict: all values castable → numeric, then date,
    else qualitative (1.0). keyword: time word .8, numeric with quantity word .9, numeric .7, else .8.
    """
    cols = data_names(df)
    spark = df.sparkSession
    numeric, moments = set(numeric_names(df)), set(moment_names(df))
    if mode == "keyword":
        rows = []
        for c in cols:
            name = normalize_name(c)
            if any(w in name for w in TIME_WORDS):
                rows.append((c, "temporal", 0.8))
            elif c in numeric:
                rows.append((c, "quantitative", 0.9 if any(w in name for w in QUANTITY_WORDS) else 0.7))
            else:
                rows.append((c, "qualitative", 0.8))
        return spark.createDataFrame(rows, "column string, dtype string, confidence double")

    aggs = []
    for c in cols:
        text = F.col(f"`{c}`").cast("string")
        number = text.try_cast("double").isNotNull()
        date = text.try_cast("timestamp").isNotNull() if c not in numeric else F.lit(False)
        aggs += [F.count(text), F.sum(number.cast("long")), F.sum(date.cast("long"))]
    got = df.agg(*aggs).first()
    rows = []
    for i, c in enumerate(cols):
        present, numbers, dates = got[3 * i], got[3 * i + 1] or 0, got[3 * i + 2] or 0
        is_number = c in numeric or (present > 0 and numbers == present)
        is_date = c in moments or (present > 0 and dates == present)
        if mode == "strict":
            kind = "numeric" if is_number else "timestamp" if is_date else "qualitative"
            rows.append((c, kind, 1.0))
        elif is_date and not is_number:
            rows.append((c, "temporal", 0.9))
        elif is_number:
            rows.append((c, "quantitative", 0.8))
        else:
            rows.append((c, "qualitative", 0.6))
    return spark.createDataFrame(rows, "column string, dtype string, confidence double")


# ---------------------------------------------------------------- conversion

def to_number_locale(df: DataFrame, col: str) -> DataFrame:
    """Numbers from text with either decimal mark; the mark of lone commas is decided per column."""
    text = C.strip_symbols(F.col(f"`{col}`"))
    grouped = text.contains(",") & text.contains(".")
    comma_last = F.length(F.substring_index(text, ",", -1)) < F.length(F.substring_index(text, ".", -1))
    votes = df.agg(
        F.sum(F.when(grouped & comma_last, 1).otherwise(0)).alias("european"),
        F.sum(F.when(grouped & ~comma_last, 1).otherwise(0)).alias("american"),
    ).first()
    lone_comma_decimal = (votes["european"] or 0) >= (votes["american"] or 0)
    return df.withColumn(col, C.to_number(F.col(f"`{col}`"), lone_comma_decimal))


def best_date_format(df: DataFrame, col: str, formats: Sequence[str] = C.DATE_FORMATS, share: float = 0.8) -> str | None:
    """First format that parses more than `share` of the non-null values; all are counted in one pass."""
    text = F.col(f"`{col}`").cast("string")
    row = df.agg(F.count(text), *[F.count(C.to_moment(text, f)) for f in formats]).first()
    for i, f in enumerate(formats, 1):
        if row[0] and row[i] / row[0] > share:
            return f
    return None


def to_datetime(df: DataFrame, col: str, formats: Sequence[str] = C.DATE_FORMATS) -> DataFrame:
    """Parse with the winning format; without one, each value takes the first format that fits."""
    chosen = best_date_format(df, col, formats)
    text = F.col(f"`{col}`").cast("string")
    tried = [chosen] if chosen else list(formats)
    return df.withColumn(col, F.coalesce(*[C.to_moment(text, f) for f in tried]))


def year_columns(df: DataFrame) -> DataFrame:
    """Columns named after a year become nullable integers."""
    for c in data_names(df):
        if any(w in c.lower() for w in ("year", "año", "année")):
            df = df.withColumn(c, F.col(f"`{c}`").cast("string").try_cast("bigint"))
    return df


def apply_types(df: DataFrame, overrides: Mapping[str, str], default_moment_format: str | None = None) -> DataFrame:
    """Convert columns to the given semantic types and keep the type in the column metadata."""
    for name, kind in overrides.items():
        if name not in df.columns:
            continue
        physical = df.schema[name].dataType
        if kind == "quantitative" and not isinstance(physical, T.NumericType):
            df = to_number_locale(df.withColumn(name, F.col(f"`{name}`").cast("string")), name)
        elif kind == "datetime" and name not in moment_names(df):
            if default_moment_format:
                df = df.withColumn(name, C.to_moment(F.col(f"`{name}`").cast("string"), default_moment_format))
            else:
                df = to_datetime(df, name)
        elif kind == "qualitative":
            df = df.withColumn(name, C.to_category(F.col(f"`{name}`")))
        df = df.withMetadata(name, {"semantic_type": kind})
    return df


def temporal_columns(df: DataFrame) -> DataFrame:
    """(column, physical, semantic, is_temporal): column metadata first, then physical type, then name."""
    rows = []
    moments = set(moment_names(df))
    for f in df.schema:
        if f.name.startswith("_"):
            continue
        declared = (f.metadata or {}).get("semantic_type")
        if declared in ("datetime", "time", "timestamp", "temporal"):
            temporal = True
        elif declared in ("quantitative", "qualitative"):
            temporal = False
        else:
            temporal = f.name in moments or any(w in normalize_name(f.name).split() for w in TIME_WORDS)
        rows.append((f.name, f.dataType.simpleString(), declared, temporal))
    return df.sparkSession.createDataFrame(
        rows, "column string, physical string, semantic string, is_temporal boolean"
    )


def verify_dates(df: DataFrame, col: str, order: Sequence[str], sample: int = 10) -> bool:
    """Ten head values: one fixed format parses all, or more than 80 % parse in some format."""
    head = df.where(F.col(f"`{col}`").isNotNull()).orderBy(*order).limit(sample)
    text = F.col(f"`{col}`").cast("string")
    each = [C.to_moment(text, f) for f in C.DATE_FORMATS]
    row = head.agg(
        F.count(text), F.count(F.coalesce(*each, text.try_cast("timestamp"))), *[F.count(e) for e in each]
    ).first()
    return row[0] > 0 and (any(row[0] == k for k in row[2:]) or row[1] / row[0] > 0.8)


def detect_time_columns(df: DataFrame, order: Sequence[str]) -> list[str]:
    """Priority names that verify, then time words, physical type, parseable values or years."""
    named = [c for c in data_names(df) if any(w in c.lower() for w in FIRST_TIME_WORDS)]
    found = [c for c in named if verify_dates(df, c, order)]
    if found:
        return found
    numeric, moments = numeric_names(df), moment_names(df)
    for c in data_names(df):
        if c in moments or any(w in c.lower() for w in NEXT_TIME_WORDS):
            found.append(c)
        elif c in numeric:
            head = df.where(F.col(f"`{c}`").isNotNull()).orderBy(*order).limit(20)
            inside = F.col(f"`{c}`").between(YEAR_MIN, YEAR_MAX)
            row = head.agg(F.count(F.lit(1)), F.sum(inside.cast("int"))).first()
            if row[0] and row[0] == row[1]:
                found.append(c)
        elif verify_dates(df, c, order, 20):
            found.append(c)
    return found


# ---------------------------------------------------------------- union

def tag_types(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Adds `_type_c` for every data column c."""
    return df.select("*", *[F.lit(types.get(c, "qualitative")).alias(f"_type_{c}") for c in data_names(df)])


def union_tables(
    tables: Sequence[tuple[str, DataFrame]], types: Mapping[str, str] | None = None, sort: bool = True
) -> DataFrame:
    """Stack tables by name with lineage columns; order by the first time column, nulls last."""
    parts = []
    for name, df in tables:
        times = [c for c in data_names(df) if any(w in c.lower() for w in TIME_WORDS)]
        tagged = year_columns(df).select(
            "*", F.lit(name).alias("_source_file"), F.lit(0).alias("_table_index"),
            F.lit(",".join(times) or None).cast("string").alias("_time_columns"),
        )
        parts.append(tag_types(tagged, types) if types is not None else tagged)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    primary = next((c for c in merged.columns if any(w in c.lower() for w in TIME_WORDS)), None)
    return merged.orderBy(F.col(f"`{primary}`").asc_nulls_last()) if sort and primary else merged


def union_with_pivot(
    tables: Sequence[tuple[str, str, DataFrame]], pivots: Mapping[int, str], types: Mapping[str, str] | None = None,
    sort: bool = True,
) -> DataFrame:
    """Stack (name, format, table) entries; `pivots` names the column each table is aligned on."""
    parts = []
    for i, (name, fmt, df) in enumerate(tables):
        tagged = df.select(
            "*", F.lit(name).alias("_source_file"), F.lit(i).alias("_file_index"), F.lit(fmt).alias("_file_format")
        )
        if types is not None:
            tagged = tag_types(tagged, types)
        pivot = pivots.get(i)
        if pivot in df.columns:
            tagged = tagged.select(
                "*", F.lit(pivot).alias("_pivot_column"), F.col(f"`{pivot}`").cast("string").alias("_pivot_value")
            )
        parts.append(tagged)
    merged = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if sort and "_pivot_value" in merged.columns:
        return merged.orderBy(F.col("_pivot_value").asc_nulls_last())
    return merged


# ---------------------------------------------------------------- reshape and prepare

def recode(df: DataFrame, col: str, mapping: Mapping[str, str]) -> DataFrame:
    pairs = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.try_element_at(pairs, F.col(f"`{col}`")), F.col(f"`{col}`")))


def to_long(df: DataFrame, ids: Sequence[str], metrics: Sequence[str], category: Column | None = None) -> DataFrame:
    """Metric columns to (Indicator, Value) rows, nulls dropped."""
    shaped = df.withColumn("Category", category) if category is not None else df
    keep = [*ids, *(["Category"] if category is not None else [])]
    cast = shaped.select(*keep, *[F.col(f"`{m}`").cast("double").alias(m) for m in metrics])
    return cast.unpivot(keep, list(metrics), "Indicator", "Value").where(F.col("Value").isNotNull())


def indicator_panel(long: DataFrame, ids: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """Wide panel ids × (Category_Indicator), summed, missing → 0."""
    named = long.withColumn("_key", F.concat_ws("_", "Category", "Indicator"))
    if keys is None:
        from lumora.operators.relational import levels

        keys = levels(named, "_key")
    return named.groupBy(*ids).pivot("_key", list(keys)).agg(F.sum("Value")).na.fill(0.0, list(keys))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    wide = df.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(c) for c in cols])
    return wide.unpivot([], list(cols), "variable", "coverage")


def filter_by_coverage(df: DataFrame, cols: Sequence[str], minimum: float = 0.6) -> list[str]:
    row = df.agg(*[F.avg(F.col(f"`{c}`").isNotNull().cast("double")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c] is not None and row[c] >= minimum]


def _quantile_rows(df: DataFrame, cols: Sequence[str], probs: Sequence[float]) -> dict[str, list[float]]:
    names = [f"p{i}" for i in range(len(probs))]
    return {r["variable"]: [r[n] for n in names] for r in column_quantiles(df, cols, probs, names).collect()}


def impute(df: DataFrame, cols: Sequence[str], how: str = "mean") -> DataFrame:
    """Fill nulls with the mean or the exact median of the column."""
    if how == "median":
        fills = {c: v[0] for c, v in _quantile_rows(df, cols, [0.5]).items()}
    else:
        row = df.agg(*[F.avg(f"`{c}`").alias(c) for c in cols]).first()
        fills = {c: row[c] for c in cols if row[c] is not None}
    return df.select(
        *[
            F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(fills.get(c))).alias(c) if c in cols else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def scale(df: DataFrame, cols: Sequence[str], how: str = "zscore") -> DataFrame:
    """zscore (population deviation), robust (median, IQR), minmax or none; zero spread divides by one."""
    if how == "none":
        return df
    if how == "robust":
        q = _quantile_rows(df, cols, [0.25, 0.5, 0.75])
        shift = {c: (q[c][1], q[c][2] - q[c][0]) for c in cols}
    elif how == "minmax":
        row = df.agg(*[f(f"`{c}`").alias(f"{t}{c}") for c in cols for t, f in (("a", F.min), ("b", F.max))]).first()
        shift = {c: (row[f"a{c}"], row[f"b{c}"] - row[f"a{c}"]) for c in cols}
    else:
        row = df.agg(
            *[f(f"`{c}`").alias(f"{t}{c}") for c in cols for t, f in (("a", F.avg), ("b", F.stddev_pop))]
        ).first()
        shift = {c: (row[f"a{c}"], row[f"b{c}"]) for c in cols}
    return df.select(
        *[
            ((F.col(f"`{c}`") - F.lit(float(shift[c][0]))) / F.lit(float(shift[c][1] or 1.0))).alias(c)
            if c in cols
            else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


def log1p_if_nonneg(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """log1p of the columns whose values are all present, finite and not negative."""
    aggs = []
    for c in cols:
        x = F.col(f"`{c}`").cast("double")
        fine = x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))
        aggs.append(F.min(fine.cast("int")).alias(c))
    row = df.agg(*aggs).first()
    return df.select(
        *[F.log1p(F.col(f"`{c}`")).alias(c) if c in cols and row[c] == 1 else F.col(f"`{c}`") for c in df.columns]
    )


def label_codes(df: DataFrame, col: str) -> DataFrame:
    """(value, code): dense codes in alphabetical order, missing spelled `nan`."""
    distinct = df.select(F.coalesce(F.col(f"`{col}`").cast("string"), F.lit("nan")).alias("value")).distinct()
    return ordered_index(distinct, ["value"], out="code")


def label_encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Replace text by its alphabetical code (a lookup join, broadcast only when the dictionary is small)."""
    from lumora.plans.sizing import broadcast_if_small

    for c in cols:
        codes = broadcast_if_small(label_codes(df, c)).select(F.col("value").alias("_value"), F.col("code").alias("_code"))
        text = F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("nan"))
        joined = df.join(codes, text == F.col("_value"), "left")
        df = joined.withColumn(c, F.col("_code")).drop("_value", "_code").select(*df.columns)
    return df


def narrow_plan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, from_type, to_type): the smallest integer or float type that holds min…max."""
    spark = df.sparkSession
    cols = list(cols or numeric_names(df))
    bounds = df.agg(*[f(f"`{c}`").alias(f"{t}{c}") for c in cols for t, f in (("a", F.min), ("b", F.max))]).first()
    rows = []
    for c in cols:
        kind = df.schema[c].dataType
        low, high = bounds[f"a{c}"], bounds[f"b{c}"]
        rows.append((c, kind.simpleString(), narrow_type(kind, low, high)))
    return spark.createDataFrame(rows, "column string, from_type string, to_type string")


def narrow_type(kind: T.DataType, low, high) -> str:
    if low is None:
        return kind.simpleString()
    if isinstance(kind, T.IntegralType):
        for name, bits in (("tinyint", 8), ("smallint", 16), ("int", 32)):
            if low > -(2 ** (bits - 1)) and high < 2 ** (bits - 1) - 1:
                return name
        return "bigint"
    if isinstance(kind, T.FractionalType) and max(abs(low), abs(high)) < 3.4028234663852886e38:
        return "float"
    return kind.simpleString()


def narrow_types(df: DataFrame) -> DataFrame:
    plan = {r["column"]: r["to_type"] for r in narrow_plan(df).collect()}
    return df.select(*[F.col(f"`{c}`").cast(plan[c]).alias(c) if c in plan else F.col(f"`{c}`") for c in df.columns])
