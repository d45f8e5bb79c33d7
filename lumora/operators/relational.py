"""Projection, filtering, sampling, joins and small aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql import types as T

from lumora.plans.order import ordered_index, rank_ranges
from lumora.plans.sizing import broadcast_if_small, join_on


def data_columns(df: DataFrame) -> DataFrame:
    """Drop the metadata columns (names starting with `_`)."""
    return df.select(*[F.col(f"`{c}`") for c in data_names(df)])


def data_names(df: DataFrame) -> list[str]:
    return [c for c in df.columns if not c.startswith("_")]


def numeric_names(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and not f.name.startswith("_")]


def text_names(df: DataFrame) -> list[str]:
    kinds = (T.StringType, T.BooleanType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and not f.name.startswith("_")]


def moment_names(df: DataFrame) -> list[str]:
    kinds = (T.TimestampType, T.TimestampNTZType, T.DateType)
    return [f.name for f in df.schema if isinstance(f.dataType, kinds) and not f.name.startswith("_")]


def select_by_type(df: DataFrame, kind: str, exclude: Sequence[str] = ()) -> DataFrame:
    """Columns of one kind: numeric, categorical or temporal. `exclude` names temporal columns to leave out."""
    names = {"numeric": numeric_names, "categorical": text_names, "temporal": moment_names}[kind](df)
    return df.select(*[c for c in names if c not in set(exclude)])


def preview(df: DataFrame, order: Sequence[str], rows: int = 100, cols: int = 20, width: int = 50) -> DataFrame:
    """First rows and columns as display text, long text cut."""
    names = data_names(df)[:cols]
    top = df.orderBy(*order).limit(rows)
    return top.select(*[F.substring(F.col(f"`{c}`").cast("string"), 1, width).alias(c) for c in names])


def complete_cases(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.dropna(subset=list(cols))


def sort_nulls_last(df: DataFrame, col: str) -> DataFrame:
    return df.orderBy(F.col(f"`{col}`").asc_nulls_last())


def top_n(df: DataFrame, by: str, n: int, tie: Sequence[str] = ()) -> DataFrame:
    """Rows with the n largest `by`; ties by the given columns ascending."""
    return df.orderBy(F.col(by).desc_nulls_last(), *tie).limit(n)


def value_counts(df: DataFrame, col: str) -> DataFrame:
    return df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("value")).agg(F.count(F.lit(1)).alias("count"))


def dedupe_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in `order`: a min over row structs, combined before the shuffle."""
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    lead = [*order, *[c for c in rest if c not in order]]
    lead = [c for c in lead if c not in keys]
    first = F.min(F.struct(*[F.col(f"`{c}`") for c in lead])).alias("_first")
    picked = df.groupBy(*keys).agg(first)
    return picked.select(*[F.col(f"`{c}`") if c in keys else F.col(f"_first.`{c}`").alias(c) for c in df.columns])


def duplicate_rows(df: DataFrame) -> DataFrame:
    """(rows, duplicate_rows, duplicate_percentage); equal rows after the first count, nulls equal.

    Row hashes are counted first, so 8 bytes per row are shuffled; only rows whose hash occurs twice are compared in full.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    hashed = df.select("*", F.xxhash64(*cols).alias("_h"))
    counts = df.agg(F.count(F.lit(1)).alias("rows"))
    twice = hashed.groupBy("_h").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_h")
    suspects = hashed.join(broadcast_if_small(twice), "_h", "left_semi")
    groups = suspects.groupBy(*cols).agg(F.count(F.lit(1)).alias("_copies"))
    extra = groups.agg(F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("duplicate_rows"), F.lit(1).alias("_j"))
    both = counts.withColumn("_j", F.lit(1)).join(F.broadcast(extra), "_j")
    share = F.coalesce(F.try_divide(F.col("duplicate_rows") * 100.0, F.col("rows")), F.lit(0.0))
    return both.select("rows", "duplicate_rows", share.alias("duplicate_percentage"))


def key_mark(key: Sequence[str], seed: int) -> Column:
    """A reproducible random order of rows: the digest of key and seed."""
    return F.md5(F.concat_ws("|", *[F.col(f"`{c}`").cast("string") for c in key], F.lit(str(seed))))


def sample_n(df: DataFrame, n: int, key: Sequence[str], seed: int = 42) -> DataFrame:
    """Reproducible uniform sample: the n smallest seeded digests of the key (a top-k, no full sort)."""
    return df.withColumn("_mark", key_mark(key, seed)).orderBy("_mark", *key).limit(n).drop("_mark")


def every_kth(df: DataFrame, order: Sequence[str], step: int = 1) -> DataFrame:
    """Every `step`-th row of an ordered table, the first one included; all rows with a step of 1."""
    if step < 2:
        return df
    return ordered_index(df, order).where(F.col("_pos") % step == 0).drop("_pos")


def cap_rows(df: DataFrame, order: Sequence[str], limit: int = 1_000_000) -> DataFrame:
    return df.orderBy(*order).limit(limit)


def size_ok(df: DataFrame, limit: int = 1_000_000) -> DataFrame:
    n = F.count(F.lit(1))
    return df.agg(n.alias("rows"), (n <= limit).alias("within_limit"))


def split_chronological(df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), test: float = 0.2) -> DataFrame:
    """Mark the first floor(n(1-test)) rows of each key as train, the others as test."""
    keys = list(keys)
    placed = ordered_index(df, order, keys)
    if keys:
        sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
        placed = join_on(placed, sizes, keys)
    else:
        placed = placed.withColumn("_n", F.lit(df.count()))
    train = F.col("_pos") < F.floor(F.col("_n") * (1 - test))
    return placed.withColumn("split", F.when(train, "train").otherwise("test")).drop("_pos", "_n")


def split_random(
    df: DataFrame, key: Sequence[str], test: float = 0.2, seed: int = 42, stratify: str | None = None, mark: str | None = None
) -> DataFrame:
    """Mark a reproducible random train/test split, exact in size within each stratum.

    Pinned rows that hold their `key_mark` already, in the column `mark`, stay where they are (without strata).
    """
    if mark and not stratify:
        placed = rank_ranges(df, [mark, *key], lambda n: [math.floor(n * (1 - test))], "_range")
        return placed.withColumn("split", F.when(F.col("_range") == 0, "train").otherwise("test")).drop("_range")
    keys = [stratify] if stratify else []
    marked = df.withColumn("_mark", key_mark(key, seed))
    return split_chronological(marked, ["_mark", *key], keys, test).drop("_mark")


def inner_on_time(actual: DataFrame, predicted: DataFrame, ts: str, keys: Sequence[str] = ()) -> DataFrame:
    return actual.join(predicted, [*keys, ts], "inner")


# Parts of a column name that mark a place.
PLACE_WORDS = ["depart", "region", "ciudad", "city", "zone"]


def place_columns(df: DataFrame) -> list[str]:
    return [c for c in data_names(df) if any(w in c.lower() for w in PLACE_WORDS)]


def group_mean(df: DataFrame, key: str, value: str, top: int = 20) -> DataFrame:
    means = df.groupBy(F.col(key).alias("place")).agg(F.avg(value).alias("mean_value"))
    return means.orderBy(F.col("mean_value").desc_nulls_last(), "place").limit(top)


def levels(df: DataFrame, col: str, most: int = 10_000) -> list:
    """Distinct non-null values of a grouping column, refused beyond `most` (pivots need a list)."""
    found = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().limit(most + 1).collect()]
    if len(found) > most:
        raise ValueError(f"{col} has more than {most} levels")
    return sorted(found)


def pivot_mean(df: DataFrame, x: str, group: str, value: str, values: Sequence | None = None) -> DataFrame:
    values = list(values) if values is not None else levels(df, group)
    return df.groupBy(x).pivot(group, values).agg(F.avg(value))


def counts_by_source(df: DataFrame, source: str = "_source_file") -> DataFrame:
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("rows"))


def distinct_count(df: DataFrame, cols: Sequence[str], approximate: bool = False) -> DataFrame:
    """(variable, unique_count): (variable, value) pairs are combined before the shuffle, per kind of value so none turn into text."""
    if approximate:
        wide = df.agg(*[F.approx_count_distinct(F.col(f"`{c}`")).alias(c) for c in cols])
        return wide.unpivot([], list(cols), "variable", "unique_count")
    kinds: dict[str, list[str]] = {"bigint": [], "double": [], "timestamp": [], "timestamp_ntz": [], "date": [], "string": []}
    for c in cols:
        t = df.schema[c].dataType
        kind = (
            "bigint" if isinstance(t, T.IntegralType) else "double" if isinstance(t, (T.DoubleType, T.FloatType))
            else "timestamp_ntz" if isinstance(t, T.TimestampNTZType) else "timestamp" if isinstance(t, T.TimestampType)
            else "date" if isinstance(t, T.DateType) else "string"
        )
        kinds[kind].append(c)
    parts = []
    for kind, names in kinds.items():
        if names:
            typed = df.select(*[F.col(f"`{c}`").cast(kind).alias(c) for c in names])
            pairs = typed.unpivot([], names, "variable", "value").groupBy("variable", "value").agg(F.lit(1))
            parts.append(pairs.groupBy("variable").agg(F.count("value").alias("unique_count")))
    return reduce(DataFrame.unionByName, parts)


def outer_merge(tables: Sequence[DataFrame], key: str | None) -> DataFrame:
    """Successive full outer joins on `key`; repeated right columns get the suffix `_dup`.

    Without a key the tables are stacked by name.
    """
    merged = tables[0]
    for right in tables[1:]:
        if key is None:
            merged = merged.unionByName(right, allowMissingColumns=True)
            continue
        for c in right.columns:
            if c != key and c in merged.columns:
                right = right.withColumnRenamed(c, f"{c}_dup")
        merged = merged.join(right, key, "full_outer")
    return merged


def lookup(df: DataFrame, col: str, table: DataFrame, key: str, value: str) -> Column | DataFrame:
    """Left lookup in a dictionary table, unmatched values kept."""
    pairs = table.select(F.col(key).alias("_k"), F.col(value).alias("_v"))
    joined = df.join(broadcast_if_small(pairs), F.col(col) == F.col("_k"), "left")
    return joined.withColumn(col, F.coalesce("_v", col)).drop("_k", "_v")


def rank_within(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """Top rows per key. Spark drops rows beyond n before the shuffle (window group limit)."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(window)).where(F.col("_rank") <= n)
