"""Exact nearest neighbours: cells around pivots, and triangle bounds that say which cells a row must visit."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from lumora.operators.linear import _vector
from lumora.plans.sizing import cut_lineage

#: Cells, at most: their centres are one small matrix in every task.
MOST_PIVOTS = 2048
#: Relative slack of the bounds, far above the rounding of a distance.
SLACK = 1e-9


class Cells(NamedTuple):
    """Distinct training points (x, y, n, cell, gap) and, per cell, its centre, extent and nearest gaps."""

    points: DataFrame
    pivots: np.ndarray
    low: np.ndarray
    high: np.ndarray
    sizes: np.ndarray
    gaps: np.ndarray


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All distances between the rows of two small blocks, by differences, so that equal pairs have equal distances."""
    return np.sqrt(((a[:, None, :] - b[None]) ** 2).sum(axis=2))


def _chunks(a: np.ndarray, b: np.ndarray) -> range:
    return range(0, len(a), max(1, 500_000 // max(1, b.size)))


def cells(train: DataFrame, features: Sequence[str], label: str, k: int) -> Cells | None:
    """Equal points of equal label are joined first, so that a crowd of copies is one point. None for an empty table."""
    points = train.select(_vector(features).alias("x"), F.col(label).cast("string").alias("y")).where(~F.exists("x", lambda v: v.isNull()))
    points = cut_lineage(points.groupBy("x", "y").agg(F.count(F.lit(1)).alias("n")))
    total = points.count()
    if not total:
        return None
    most = min(MOST_PIVOTS, max(1, math.isqrt(total)))
    pivots = np.unique(np.array([r["x"] for r in points.orderBy(F.xxhash64("x"), "x").limit(most).collect()], dtype=float), axis=0)

    @F.pandas_udf("struct<cell:int,gap:double>")
    def place(v: pd.Series) -> pd.DataFrame:
        x = np.stack(v.to_numpy()).astype(float)
        cell, gap = np.empty(len(x), np.int32), np.empty(len(x))
        step = _chunks(x, pivots).step
        for at in _chunks(x, pivots):
            d = _distances(x[at : at + step], pivots)
            cell[at : at + step] = d.argmin(axis=1)
            gap[at : at + step] = d.min(axis=1)
        return pd.DataFrame({"cell": cell, "gap": gap})

    placed = cut_lineage(points.withColumn("_p", place("x")).select("x", "y", "n", "_p.cell", "_p.gap"))
    facts = placed.groupBy("cell").agg(F.min("gap").alias("low"), F.max("gap").alias("high"), F.count(F.lit(1)).alias("rows"))
    first = placed.select("cell", "gap", F.explode(F.sequence(F.lit(1), F.least("n", F.lit(k)))).alias("_copy"))
    ranked = first.withColumn("r", F.row_number().over(Window.partitionBy("cell").orderBy("gap"))).where(F.col("r") <= k)
    p = len(pivots)
    low, high, sizes, gaps = np.full(p, np.inf), np.full(p, -np.inf), np.zeros(p, np.int64), np.full((p, k), np.inf)
    for r in facts.collect():
        low[r["cell"]], high[r["cell"]], sizes[r["cell"]] = r["low"], r["high"], r["rows"]
    for r in ranked.select("cell", "r", "gap").collect():
        gaps[r["cell"], r["r"] - 1] = r["gap"]
    return Cells(placed, pivots, low, high, sizes, gaps)


def _regions(found: Cells, most: int) -> np.ndarray:
    """The region of each cell: neighbours along the longest axis of the pivots, of `most` points together, or one crowded cell."""
    centred = found.pivots - found.pivots.mean(axis=0)
    along = centred @ np.linalg.svd(centred, full_matrices=False)[2][0]
    region, number, filled = np.empty(len(along), np.int32), 0, 0
    for c in np.argsort(along, kind="stable"):
        if filled and filled + found.sizes[c] > most:
            number, filled = number + 1, 0
        region[c] = number
        filled += found.sizes[c]
    return region


def _asked(test: DataFrame, features: Sequence[str], key: str, found: Cells, k: int, region: np.ndarray) -> DataFrame:
    """(id, x, regions, cells): the cells that may hold one of the k nearest points of each row, one list per region.

    The k-th distance is at most that to the k best of all points, reached through their centres. A cell is left out if all
    its points are farther: by the ring around its centre that it fills, or by the plane between its centre and the nearest.
    """
    pivots, low, high, gaps, there = found.pivots, found.low, found.high, found.gaps, found.sizes > 0
    between = np.concatenate([_distances(pivots[i : i + 16], pivots) for i in range(0, len(pivots), 16)])

    def needed(row: np.ndarray) -> np.ndarray:
        reach = (row[:, None] + gaps).ravel()
        most = np.partition(reach, k - 1)[k - 1] if len(reach) >= k else np.inf
        most = most * (1 + SLACK) + SLACK
        own = int(np.argmin(np.where(there, row, np.inf)))
        nearest = int(row.argmin())
        with np.errstate(divide="ignore", invalid="ignore"):
            plane = (row * row - row[nearest] ** 2) / (2 * between[nearest])
        plane[nearest] = -np.inf
        near = there & (row - high <= most) & (low - row <= most) & ~(plane > most)
        near[own] = True
        return np.flatnonzero(near).astype(np.int32)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for low_row in range(0, len(batch), 500):  # lists of many cells stay few at a time
                part = batch.iloc[low_row : low_row + 500]
                x = np.stack(part["x"].to_numpy()).astype(float)
                regions, lists = [], []
                step = _chunks(x, pivots).step
                for at in _chunks(x, pivots):
                    for row in _distances(x[at : at + step], pivots):
                        near = needed(row)
                        of = region[near]
                        order = np.argsort(of, kind="stable")
                        first = np.flatnonzero(np.diff(of[order], prepend=-1))
                        regions.append(of[order][first])
                        lists.append(np.split(near[order], first[1:]))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "x": list(x), "regions": regions, "cells": lists})

    rows = test.select(F.col(key).cast("string").alias("id"), _vector(features).alias("x")).where(~F.exists("x", lambda v: v.isNull()))
    return rows.mapInPandas(run, "id string, x array<double>, regions array<int>, cells array<array<int>>")


def visits(test: DataFrame, features: Sequence[str], key: str, found: Cells, k: int) -> DataFrame:
    """(id, x, cell): the cells that each row must visit."""
    asked = _asked(test, features, key, found, k, np.zeros(len(found.pivots), np.int32))
    return asked.select("id", "x", F.explode(F.flatten("cells")).alias("cell"))


def comparisons(asked: DataFrame, found: Cells) -> int:
    """How many pairs of rows the search compares."""
    return sum(r["count"] * int(found.sizes[r["cell"]]) for r in asked.groupBy("cell").count().collect())


def nearest(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, block_rows: int = 20_000) -> DataFrame:
    """(id, d, y, n): the k nearest training points of each test row, ties by label; a point stands for n equal rows.

    Cells lie together in regions of up to `block_rows` points, so that a row moves once to a region, with the cells to
    visit there. Cells with more points, and regions asked by more rows, are dealt out in blocks; each pair of blocks is one
    task that returns only its k nearest per row. Rows with a null feature are left out.
    """
    found = cells(train, features, label, k)
    schema = "id string, d double, y string, n long"
    if found is None:
        return train.sparkSession.createDataFrame([], schema)
    region = _regions(found, block_rows)
    points_of = np.bincount(region, weights=found.sizes)
    asked = cut_lineage(_asked(test, features, key, found, k, region))
    counts = {r["region"]: r["count"] for r in asked.select(F.explode("regions").alias("region")).groupBy("region").count().collect()}
    dealt = [(c, max(1, -(-int(points_of[c]) // block_rows)), max(1, -(-n // block_rows))) for c, n in counts.items()]
    parts = F.broadcast(train.sparkSession.createDataFrame(dealt, "region int, blocks int, shards int"))  # no more rows than pivots
    sides = F.broadcast(train.sparkSession.createDataFrame(list(enumerate(region.tolist())), "cell int, region int"))
    left = asked.select("id", "x", F.explode(F.arrays_zip("regions", "cells")).alias("_v")).select("id", "x", F.col("_v.regions").alias("region"), F.col("_v.cells").alias("cells"))
    left = left.join(parts, "region").withColumn("shard", F.pmod(F.xxhash64("id"), F.col("shards")).cast("int"))
    left = left.select("id", "x", "cells", "region", "shard", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = found.points.join(sides, "cell").join(parts, "region").withColumn("block", F.pmod(F.xxhash64("x", "y"), F.col("blocks")).cast("int"))
    right = right.select("x", "y", "n", "cell", "region", "block", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"))

    def best(rows: pd.DataFrame, points: pd.DataFrame) -> pd.DataFrame:
        names = ["id", "d", "y", "n"]
        if not len(rows) or not len(points):
            return pd.DataFrame([], columns=names)
        points = points.sort_values("cell", kind="stable")
        b, y, n = np.stack(points["x"].to_numpy()).astype(float), points["y"].to_numpy(), points["n"].to_numpy()
        label_rank = np.argsort(np.argsort(y.astype(str), kind="stable"), kind="stable")
        a = np.stack(rows["x"].to_numpy()).astype(float)
        wanted = np.concatenate(rows["cells"].to_numpy())
        who = np.repeat(np.arange(len(a)), [len(c) for c in rows["cells"]])
        order = np.argsort(wanted, kind="stable")
        wanted, who = wanted[order], who[order]
        at_cell = points["cell"].to_numpy()

        def least(parts: list[tuple]) -> list[tuple]:
            """The k nearest of each row among what was found so far."""
            i, d, j = (np.concatenate(p) for p in zip(*parts))
            place = np.lexsort((label_rank[j], d, i))
            i, d, j = i[place], d[place], j[place]
            first = np.flatnonzero(np.diff(i, prepend=-1))
            kept = np.arange(len(i)) - np.repeat(first, np.diff(first, append=len(i))) < k
            return [(i[kept], d[kept], j[kept])]

        close, held, last = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))], 0, 0
        for c in np.unique(at_cell):
            low, high = np.searchsorted(at_cell, [c, c + 1])
            mine = who[slice(*np.searchsorted(wanted, [c, c + 1]))]
            some = b[low:high]
            step = _chunks(mine, some).step
            for at in range(0, len(mine), step):
                d = _distances(a[mine[at : at + step]], some)
                edge = np.partition(d, min(k, d.shape[1]) - 1, axis=1)[:, min(k, d.shape[1]) - 1]
                i, j = np.nonzero(d <= edge[:, None])
                close.append((mine[at : at + step][i], d[i, j], low + j))
                held += len(i)
                if held > 2 * last + 500_000:
                    close = least(close)
                    held = last = len(close[0][0])
        i, d, j = least(close)[0]
        return pd.DataFrame({"id": rows["id"].to_numpy()[i], "d": d, "y": y[j], "n": n[j]}, columns=names)

    keys = ["region", "block", "shard"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, schema)


def knn_classify(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5, block_rows: int = 20_000) -> DataFrame:
    """(key, prediction): majority of the k nearest training rows (ties: smaller label)."""
    near = nearest(train, test, features, label, key, k, block_rows)
    best = near.groupBy("id").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "y", "n"))), 1, k).alias("s"))  # ≤ k per visited block
    # of the sorted points only as many copies count as are still wanted
    taken = F.transform("s", lambda p, i: F.struct(p["y"].alias("y"), F.least(p["n"], F.greatest(F.lit(0).cast("long"), F.lit(k) - F.aggregate(F.slice("s", F.lit(1), i), F.lit(0).cast("long"), lambda a, q: a + q["n"]))).alias("c")))
    votes = best.select("id", F.explode(taken).alias("v")).groupBy("id", F.col("v.y").alias("y")).agg(F.sum("v.c").alias("c"))
    return votes.groupBy(F.col("id").alias(key)).agg(F.min(F.struct(-F.col("c"), "y"))["y"].alias("prediction"))
