"""Normal equations by one aggregate: the cross-product sums of a few columns."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F


#: Up to this many product sums are plain aggregate expressions; wider tables use partial matrices.
EXPRESSION_SUMS = 80


def cross_products(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Per key: `n` and the upper triangle of X'X as an array, with a leading constant column.

    Rows with a null in any column are left out, as in a regression on complete cases.
    """
    complete = df.dropna(subset=list(cols))
    width = len(cols) + 1
    if width * (width + 1) // 2 > EXPRESSION_SUMS:
        packed = complete.select(*keys, F.array(*[F.col(f"`{c}`").cast("double") for c in cols]).alias("_x"))
        return vector_products(packed, "_x", len(cols), keys)
    return column_products(complete, cols, keys)


def column_products(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The same for a few columns without nulls, as plain aggregate expressions."""
    width = len(cols) + 1
    terms = [F.lit(1.0), *[F.col(f"`{c}`").cast("double") for c in cols]]
    names, sums = [], []
    for i in range(width):
        for j in range(i, width):
            names.append(f"_s{i}_{j}")
            sums.append(F.sum(terms[i] * terms[j]).alias(names[-1]))
    wide = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *sums)
    return wide.select(*keys, "n", F.array(*names).alias("gram"))


def vector_products(df: DataFrame, vector: str, size: int, keys: Sequence[str] = ()) -> DataFrame:
    """The same from an array column of `size` numbers.

    X'X of each Arrow batch and key is a matrix product; then elements are summed, so only matrices are shuffled.
    """
    keys = list(keys)
    upper = np.triu_indices(size + 1)
    fields = "".join(f"`{k}` {df.schema[k].dataType.simpleString()}, " for k in keys)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            groups = batch.groupby(keys, dropna=False, sort=False) if keys else [((), batch)]
            rows = []
            for key, part in groups:
                if len(part) == 0:
                    continue
                x = np.column_stack([np.ones(len(part)), np.stack(part[vector].to_numpy()).astype(float)])
                key = key if isinstance(key, tuple) else (key,)
                rows.append((*key, len(part), (x.T @ x)[upper].tolist()))
            yield pd.DataFrame(rows, columns=[*keys, "n", "gram"])

    parts = df.select(*keys, vector).mapInPandas(partial, f"{fields}n long, gram array<double>")
    cells = parts.select(*keys, "n", F.posexplode("gram").alias("_at", "_v")).groupBy(*keys, "_at").agg(
        F.sum("n").alias("n"), F.sum("_v").alias("_v"))
    packed = cells.groupBy(*keys).agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("_at", "_v"))).alias("_c"))
    return packed.select(*keys, "n", F.transform("_c", lambda c: c["_v"]).alias("gram"))


def unpack(gram: Sequence[float], size: int) -> np.ndarray:
    """Symmetric (size+1)² matrix from the packed upper triangle."""
    matrix = np.zeros((size + 1, size + 1))
    upper = np.triu_indices(size + 1)
    matrix[upper] = np.asarray(gram, dtype=float)
    return matrix + np.triu(matrix, 1).T


def solve(gram: np.ndarray, x: Sequence[int], y: int) -> tuple[np.ndarray, float]:
    """Least squares of column `y` on columns `x` of the packed design: (coefficients, rss)."""
    a = gram[np.ix_(x, x)]
    b = gram[list(x), y]
    scale = np.sqrt(np.clip(np.diag(a), 1e-300, None))
    beta = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=1e-12)[0] / scale
    rss = float(gram[y, y] - 2 * beta @ b + beta @ a @ beta)
    return beta, max(rss, 0.0)
