"""Importances of a forest of shallow regression trees, whose weights of rows are drawn anew in each pass, never stored.

A tree sees every row as often as a Poisson number of mean one says. Features fall in at most 32 bins, so rows of a chunk
that share all bins are one cell: a tree needs three sums a cell, and only cells walk down the trees. Tasks hand on the sums
of (tree, node, feature, bin), whose number doesn't grow with the rows, and Spark adds them up by tree.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumora.plans.sizing import cut_lineage, spread_out

BINS = 32
#: Features in a packed word: five bits each.
WORD = 12
#: Rows from which the bounds of the bins are found, at most.
BIN_ROWS = 10_000
#: Rows whose cells are found together.
CHUNK_ROWS = 1 << 20
#: Bytes of sums that a task holds; beyond them, trees are grown in several passes.
SUM_BYTES = 64 * 1024 * 1024
#: Gains below this share of a node's squares are rounding.
LEAST_GAIN = 1e-10


#: A 16-bit random number stands for a Poisson number of mean one: how many of these limits it reaches.
LIMITS = [round((1 << 16) * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
#: Rows weighted at once.
PIECE_ROWS = 1 << 16


def _weighted(y: np.ndarray, squares: np.ndarray, cell: np.ndarray, starts: np.ndarray, seed: Sequence[int]) -> np.ndarray:
    """[n, Σy, Σy²] by cell of one tree's draw of rows, which come in order of their cells."""
    random = np.random.SFC64(seed).random_raw(len(y) // 4 + 1).view(np.uint16)
    lots = np.zeros((3, len(starts)))
    for a in range(0, len(y), PIECE_ROWS):
        piece = slice(a, min(a + PIECE_ROWS, len(y)))
        times = np.zeros(piece.stop - a, np.uint8)
        for limit in LIMITS:
            times += random[piece] >= limit
        weight = times.astype(float)
        here = slice(cell[a], cell[piece.stop - 1] + 1)
        at = np.maximum(starts[here] - a, 0)
        lots[0, here] += np.add.reduceat(weight, at)
        lots[1, here] += np.add.reduceat(weight * y[piece], at)
        lots[2, here] += np.add.reduceat(weight * squares[piece], at)
    return lots


def _bounds(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of all bins but the last: midpoints of all values if they are few, else about equal counts."""
    found, counts = np.unique(values[~np.isnan(values)], return_counts=True)
    if len(found) <= bins:
        return (found[:-1] + found[1:]) / 2
    stride, before, out = counts.sum() / bins, counts[0], []
    target = stride
    for i in range(1, len(found)):
        after = before + counts[i]
        if abs(before - target) < abs(after - target):
            out.append((found[i - 1] + found[i]) / 2)
            target += stride
        before = after
    return np.array(out[: bins - 1])


def _cells(df: DataFrame, features: Sequence[str], target: str) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows as packed bins and centred target, bounds by feature); the rows are pinned, as each level reads them."""
    used = df.select(*[F.col(f"`{c}`").cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(f"`{target}`").cast("double").alias("y")).dropna(
        subset=["y", *[f"x{i}" for i in range(len(features))]])
    n, mean = used.agg(F.count(F.lit(1)), F.avg("y")).first()
    if not n:
        raise ValueError("no complete rows")
    names = [f"x{i}" for i in range(len(features))]
    seen = used.select(*names)
    seen = (seen if n <= BIN_ROWS else seen.sample(min(1.0, BIN_ROWS / n), 42)).toPandas().to_numpy(dtype=float)
    bounds = [_bounds(seen[:, i], min(BINS, n)) for i in range(len(features))]
    words = math.ceil(len(features) / WORD)

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = {f"w{k}": np.zeros(len(b), np.int64) for k in range(words)}
            for i, at in enumerate(bounds):
                out[f"w{i // WORD}"] |= np.searchsorted(at, b[f"x{i}"].to_numpy()).astype(np.int64) << 5 * (i % WORD)
            yield pd.DataFrame({**out, "y": b["y"].to_numpy() - mean})

    schema = ", ".join([f"w{k} long" for k in range(words)] + ["y double"])
    return cut_lineage(spread_out(used).mapInPandas(pack, schema)), bounds


def _chunks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches put together to chunks of CHUNK_ROWS rows, wherever batches end."""
    held, rows = [], 0
    for b in batches:
        while len(b):
            part = b.iloc[: CHUNK_ROWS - rows]
            held.append(part)
            rows += len(part)
            b = b.iloc[len(part):]
            if rows == CHUNK_ROWS:
                yield pd.concat(held, ignore_index=True)
                held, rows = [], 0
    if held:
        yield pd.concat(held, ignore_index=True)


def _chosen(tree: int, node: int, usable: Sequence[int], size: int, seed: int) -> np.ndarray:
    """The features a node may split by."""
    return np.sort(np.random.default_rng([seed, tree, node]).choice(usable, size, replace=False))


def _best(sums: np.ndarray) -> tuple[int, int, float]:
    """(feature's place, last bin of the left side, gain) of a node from its (feature, bin, [n, Σy, Σy²]); gain 0: a leaf."""
    left = sums.cumsum(axis=1)[:, :-1]
    whole = sums.sum(axis=1, keepdims=True)
    right = whole - left

    def spread(m: np.ndarray) -> np.ndarray:
        return m[..., 2] - m[..., 1] ** 2 / np.maximum(m[..., 0], 1)

    gain = np.where((left[..., 0] >= 1) & (right[..., 0] >= 1), spread(whole) - spread(left) - spread(right), 0.0)
    at = int(gain.argmax())
    place, cut = divmod(at, BINS - 1)
    least = LEAST_GAIN * float(whole[0, 0, 2])
    return place, cut, float(gain.flat[at]) if gain.flat[at] > least else 0.0


def _splits(rows: DataFrame, width: int, trees: Sequence[int], level: int, feature: np.ndarray, cut: np.ndarray, usable: Sequence[int], size: int, seed: int) -> list:
    """The best splits of all nodes of a level of some trees: rows (tree, node, feature, cut, gain)."""
    first, nodes = (1 << level) - 1, 1 << level
    words = math.ceil(width / WORD)
    chosen = {t: np.stack([_chosen(t, first + k, usable, size, seed) for k in range(nodes)]) for t in trees}

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = np.zeros((len(trees), 3, nodes * size * BINS))
        part = TaskContext.get().partitionId()
        for number, chunk in enumerate(_chunks(batches)):
            packed = chunk[[f"w{k}" for k in range(words)]].to_numpy()
            order = np.lexsort(packed.T)
            packed, y = packed[order], chunk["y"].to_numpy()[order]
            new = np.concatenate([[True], (packed[1:] != packed[:-1]).any(axis=1)])
            starts, cell, squares = np.flatnonzero(new), new.cumsum() - 1, y * y
            cells = packed[starts]
            bins = np.column_stack([(cells[:, i // WORD] >> 5 * (i % WORD)) & (BINS - 1) for i in range(width)])
            each = np.arange(len(cells))
            for k, t in enumerate(trees):
                node = np.zeros(len(cells), np.int64)
                for _ in range(level):
                    by = feature[t, node]
                    node = np.where((by < 0) | (node < 0), -1, 2 * node + 1 + (bins[each, by] > cut[t, node]))
                open_ = np.flatnonzero(node >= first)
                if not len(open_):
                    continue
                own = node[open_] - first
                lots = _weighted(y, squares, cell, starts, [seed, part, number, t])
                for j in range(size):
                    place = (own * size + j) * BINS + bins[open_, chosen[t][own, j]]
                    for m in range(3):
                        sums[k, m] += np.bincount(place, lots[m][open_], nodes * size * BINS)
        yield pd.DataFrame({"tree": np.array(trees), "sums": [s.tobytes() for s in sums]})

    def decide(group: pd.DataFrame) -> pd.DataFrame:
        t = int(group["tree"].iloc[0])
        sums = np.zeros(3 * nodes * size * BINS)
        for s in group["sums"]:
            sums += np.frombuffer(s)
        sums = np.moveaxis(sums.reshape(3, nodes, size, BINS), 0, 3)
        out = []
        for k in range(nodes):
            place, last, gain = _best(sums[k])
            if gain > 0:
                out.append((t, first + k, int(chosen[t][k, place]), last, gain))
        return pd.DataFrame(out, columns=["tree", "node", "feature", "cut", "gain"])

    added = rows.mapInPandas(add_up, "tree int, sums binary")
    return added.groupBy("tree").applyInPandas(decide, "tree int, node int, feature int, cut int, gain double").collect()


def forest_importances(df: DataFrame, features: Sequence[str], target: str, trees: int = 100, depth: int = 5, seed: int = 42) -> np.ndarray:
    """Share of each feature in the fall of the squared error: by tree, then averaged over the trees.

    A node of several trees may split by a third of the features, rounded up, chosen at random among those that vary.
    """
    rows, bounds = _cells(df, features, target)
    usable = [i for i, b in enumerate(bounds) if len(b)]
    share = np.zeros((trees, len(features)))
    if not usable:
        return share[0]
    size = min(len(usable), math.ceil(len(features) / 3) if trees > 1 else len(features))
    feature, cut = np.full((trees, (1 << depth) - 1), -1), np.zeros((trees, (1 << depth) - 1), np.int64)
    growing = list(range(trees))
    for level in range(depth):
        together = max(1, SUM_BYTES // (24 * (1 << level) * size * BINS))
        found = []
        for i in range(0, len(growing), together):
            found += _splits(rows, len(features), growing[i: i + together], level, feature, cut, usable, size, seed)
        for r in found:
            feature[r["tree"], r["node"]], cut[r["tree"], r["node"]] = r["feature"], r["cut"]
            share[r["tree"], r["feature"]] += r["gain"]
        growing = sorted({r["tree"] for r in found})
    whole = share.sum(axis=1, keepdims=True)
    mean = np.divide(share, whole, out=np.zeros_like(share), where=whole > 0).sum(axis=0)
    return mean / mean.sum() if mean.sum() > 0 else mean
