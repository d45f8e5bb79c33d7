"""User functions over row blocks, rows and columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def chunked_processing(df: DataFrame, func: Callable[[pd.DataFrame], pd.DataFrame], schema: str, chunk: int = 10_000) -> DataFrame:
    """Apply a pandas function to blocks of at most `chunk` rows, inside the tasks that hold them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for start in range(0, len(batch), chunk):
                yield func(batch.iloc[start: start + chunk])

    return df.mapInPandas(run, schema)


def parallel_rows(df: DataFrame, cols: Sequence[str], func: Callable[..., pd.Series], out: str, kind: str = "double") -> DataFrame:
    """Vectorised row function over Arrow batches of the named columns."""

    @F.pandas_udf(kind)
    def udf(*series: pd.Series) -> pd.Series:
        return func(*series)

    return df.withColumn(out, udf(*[F.col(c) for c in cols]))


def parallel_columns(df: DataFrame, cols: Sequence[str], func: Callable[[Column], Column], out: str = "result") -> DataFrame:
    """An aggregate expression for every column, all in one pass: (variable, result)."""
    wide = df.agg(*[func(F.col(f"`{c}`")).cast("double").alias(c) for c in cols])
    return wide.unpivot([], list(cols), "variable", out)
