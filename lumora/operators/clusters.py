"""Clusters and density: k-means with several starts in one pass, DBSCAN in any number of columns, isolation forests."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from lumora.operators.linear import _vector
from lumora.operators.schema import scale
from lumora.plans.order import ordered_index
from lumora.plans.quantiles import quantile_values
from lumora.plans.sizing import broadcast_if_small, cut_lineage, spread_out

# ---------------------------------------------------------------- k-means

#: Rows, of the least hashes, that starting centres are chosen from.
SEED_ROWS = 2_000
#: Rows whose distances to all centres are found at once.
PIECE_ROWS = 4_096


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def _packed(size: int):
    """Rows of arrays as matrices in binary form, one for each batch: a round then reads no single rows."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"x": pa.array([_matrix(batch.column(0), size).astype(float).tobytes()], pa.binary())})

    return pack


def _spread_seeds(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over a sample."""
    picked = [int(rng.integers(len(x)))]
    gap = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < k:
        total = gap.sum()
        picked.append(int(rng.choice(len(x), p=gap / total)) if total > 0 else int(rng.integers(len(x))))
        gap = np.minimum(gap, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def kmeans_centres(x: DataFrame, size: int, k: int, starts: int = 10, rounds: int = 100, tol: float = 1e-4, seed: int = 42) -> tuple[np.ndarray, np.ndarray, float]:
    """(centres, sizes, inertia) of the best of several starts over (x array<double>), by Lloyd's rounds.

    All starts share each pass: a task sums its rows per start and centre, and only these sums are shuffled. Seeds come from
    a sample by hash, so that the result depends neither on the number of cores nor on the layout of files.
    """
    sample = np.array([r["x"] for r in x.orderBy(F.xxhash64("x"), "x").limit(SEED_ROWS).collect()], dtype=float)
    if not len(sample):
        return np.zeros((0, size)), np.zeros(0, np.int64), 0.0
    rng = np.random.default_rng(seed)
    centres = np.stack([_spread_seeds(sample, k, rng) for _ in range(starts)])
    variance = float(sample.var(axis=0).mean())

    blocks = cut_lineage(x.select("x").mapInArrow(_packed(size), "x binary"))

    def step(now: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, seen = np.zeros((len(live), k, size + 2)), False
            flat = now[live].reshape(-1, size)
            double, own = -2 * flat, (flat * flat).sum(axis=1)[:, None]
            for block in (b for batch in batches for b in batch.column(0)):
                rows = np.frombuffer(block.as_buffer()).reshape(-1, size)
                for a in range(0, len(rows), PIECE_ROWS):
                    part = rows[a: a + PIECE_ROWS]
                    gaps = double @ part.T
                    gaps += own + (part * part).sum(axis=1)
                    gaps = np.maximum(gaps, 0, out=gaps).reshape(len(live), k, -1)
                    least = gaps.min(axis=1)
                    hot, taken = np.empty(gaps.shape), np.zeros(least.shape, bool)
                    for j in range(k):  # of equal distances the first counts
                        own_rows = ~((gaps[:, j] > least) | taken)
                        taken |= own_rows
                        hot[:, j] = own_rows
                    sums[:, :, 0] += hot.sum(axis=2)
                    sums[:, :, 1] += np.matmul(hot, least[:, :, None])[:, :, 0]
                    sums[:, :, 2:] += (hot.reshape(-1, len(part)) @ part).reshape(len(live), k, size)
                seen = seen or len(rows) > 0
            if seen:
                yield pa.record_batch({"at": pa.array(np.arange(sums.size, dtype=np.int32)), "v": pa.array(sums.ravel())})

        out = np.zeros(len(live) * k * (size + 2))
        for r in blocks.mapInArrow(partial, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
            out[r["at"]] = r["v"]
        out = out.reshape(len(live), k, size + 2)
        return out[:, :, 0], out[:, :, 1], out[:, :, 2:]

    live = np.arange(starts)
    counts, inertia = np.zeros((starts, k)), np.full(starts, np.inf)
    for _ in range(rounds):
        n, cost, sums = step(centres, live)
        counts[live], inertia[live] = n, cost.sum(axis=1)
        moved = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres[live])
        shift = ((moved - centres[live]) ** 2).sum(axis=(1, 2))
        centres[live] = moved
        live = live[shift > tol * variance]
        if not len(live):
            break
    # what the final centres give, for the best start
    best = int(np.argmin(inertia))
    n, cost, _ = step(centres, np.array([best]))
    order = np.lexsort(centres[best].T[::-1])
    return centres[best][order], n[0][order].astype(np.int64), float(cost.sum())


def _nearest(centres: np.ndarray) -> Column:
    @F.pandas_udf("int")
    def label(v: pd.Series) -> pd.Series:
        rows = np.stack(v.to_numpy()).astype(float)
        d = (rows * rows).sum(axis=1)[:, None] - 2 * rows @ centres.T + (centres * centres).sum(axis=1)
        return pd.Series(d.argmin(axis=1).astype(np.int32))

    return label


def _scaled(df: DataFrame, cols: Sequence[str], scaled: bool) -> DataFrame:
    complete = df.dropna(subset=list(cols))
    return scale(complete, list(cols), "zscore") if scaled else complete


def kmeans(df: DataFrame, cols: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42, out: str = "cluster", scaled: bool = True) -> DataFrame:
    """Complete rows with a cluster label. Distances are between standardised columns; labels are in order of the centres."""
    base = _scaled(df, cols, scaled)
    centres, _, _ = kmeans_centres(spread_out(base.select(_vector(cols).alias("x"))), len(cols), k, starts, seed=seed)
    if not scaled:
        return base.withColumn(out, _nearest(centres)(_vector(cols)))
    # rows keep their own values; labels come from the scaled copies
    own = df.dropna(subset=list(cols))
    both = scale(own.select("*", *[F.col(f"`{c}`").cast("double").alias(f"_z_{i}") for i, c in enumerate(cols)]), [f"_z_{i}" for i in range(len(cols))], "zscore")
    return both.withColumn(out, _nearest(centres)(_vector([f"_z_{i}" for i in range(len(cols))]))).drop(*[f"_z_{i}" for i in range(len(cols))])


def kmeans_summary(df: DataFrame, cols: Sequence[str], k: int = 3, starts: int = 10, seed: int = 42, scaled: bool = True) -> DataFrame:
    """(cluster, size, inertia of the model)."""
    x = spread_out(_scaled(df, cols, scaled).select(_vector(cols).alias("x")))
    _, sizes, inertia = kmeans_centres(x, len(cols), k, starts, seed=seed)
    return df.sparkSession.createDataFrame([(i, int(n), inertia) for i, n in enumerate(sizes)], "cluster int, size long, inertia double")


# ---------------------------------------------------------------- components

def _least_of(edges: Iterator[tuple]) -> dict:
    """Each node's least connected node, by union and find."""
    parent: dict = {}

    def root(v):
        while parent.setdefault(v, v) != v:
            parent[v] = parent[parent[v]]
            v = parent[v]
        return v

    for a, b in edges:
        ra, rb = root(a), root(b)
        if ra != rb:
            low, high = (ra, rb) if ra < rb else (rb, ra)
            parent[high] = low
    return {v: root(v) for v in parent}


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component.

    In each round, tasks first join the edges they hold, whichever these are, and send on one edge per node to the least
    node of its piece: a piece of any size is then as many edges as nodes, of which equal ones of different tasks merge by
    node, not by root. Then every node looks up the label of its label, so that distances halve.
    """
    kind = nodes.schema["node"].dataType.simpleString()

    def inside(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pairs: list[tuple] = []
        for batch in batches:
            pairs += [(_hashable(a), _hashable(b)) for a, b in zip(batch["a"], batch["b"])]
            if len(pairs) > 500_000:
                pairs = [(v, r) for v, r in _least_of(iter(pairs)).items() if v != r]
        found = [(v, r) for v, r in _least_of(iter(pairs)).items() if v != r]
        yield pd.DataFrame({"a": [_plain(v) for v, _ in found], "b": [_plain(r) for _, r in found]})

    schema = f"a {kind}, b {kind}"
    links = cut_lineage(edges.select("a", "b").mapInPandas(inside, schema).distinct())
    labels = nodes.select("node", F.col("node").alias("label"))
    both = cut_lineage(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    while True:
        near = both.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        lower = labels.join(near, F.col("node") == F.col("a"), "left").select("node", "label", F.least("label", "near").alias("new"))
        jump = labels.select(F.col("node").alias("_n"), F.col("label").alias("_l"))
        step = cut_lineage(lower.join(jump, F.col("new") == F.col("_n")).select("node", "label", F.least("new", "_l").alias("new")))
        changed = step.where("new < label").limit(1).count()
        labels = step.select("node", F.col("new").alias("label"))
        if not changed:
            return labels


def _hashable(v):
    return tuple(v) if isinstance(v, (list, np.ndarray)) else v


def _plain(v):
    return list(v) if isinstance(v, tuple) else v


# ---------------------------------------------------------------- density

#: Cell pairs are looked up by the first columns of a cell; the other columns are compared.
LOOKUP = 2


def cell_pairs(cells: DataFrame, d: int) -> DataFrame:
    """(a, b) of all pairs of occupied cells that may hold points within eps of each other, both ways and with themselves.

    Cells have sides of eps/√d. Sorted by their first columns, only cells in reach there meet, (2·⌈√d⌉+1)² places at most
    whatever d is, and the others are ruled out by the distance of the cells.
    """
    reach = math.ceil(math.sqrt(d))
    key = [F.col("cell")[i] for i in range(min(LOOKUP, d))]
    offsets = F.sequence(F.lit(-reach), F.lit(reach)).cast("array<bigint>")
    left = cells.select(F.col("cell").alias("a"), *[k.alias(f"k{i}") for i, k in enumerate(key)])

    def moved(name: str) -> Column:
        return F.explode(F.transform(offsets, lambda o: F.col(name) + o)).alias(name)

    for i in range(len(key)):
        left = left.select(*[c for c in left.columns if c != f"k{i}"], moved(f"k{i}"))
    right = cells.select(F.col("cell").alias("b"), *[k.alias(f"k{i}") for i, k in enumerate(key)])
    gap = F.aggregate(F.zip_with("a", "b", lambda x, y: F.greatest(F.abs(x - y) - 1, F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda s, v: s + v * v)
    return left.join(right, [f"k{i}" for i in range(len(key))]).where(gap <= d).select("a", "b")


def dbscan(
    df: DataFrame, cols: Sequence[str], key: Sequence[str], eps: float = 0.5, min_pts: int = 5, scaled: bool = True, fine: int = 8, out: str = "cluster"
) -> DataFrame:
    """Density clusters (−1 noise) on a grid whose cells are so small that a cell's points are all neighbours.

    A cell with `min_pts` points makes them all core without comparing any. Points of the other cells (fewer than
    `min_pts` each) are compared with the points of cells in reach, so a crowded cell meets a bounded number of
    partners. Cells join when core points of both lie within eps; each cell is represented by one point per sub-cell,
    so links between crowded cells are exact up to eps·(1 ± 2/fine). Any number of columns.
    """
    cols, key = list(cols), list(key)
    d = len(cols)
    base = scale(df.dropna(subset=cols), cols, "zscore") if scaled else df.dropna(subset=cols)
    side = eps / math.sqrt(d)
    cell = F.array(*[F.floor(F.col(f"`{c}`") / side).cast("long") for c in cols])
    pts = cut_lineage(base.select(*key, _vector(cols).alias("x"), cell.alias("cell")))
    counts = cut_lineage(pts.groupBy("cell").agg(F.count(F.lit(1)).alias("n")))
    pairs = cut_lineage(cell_pairs(counts.select("cell"), d))

    def gap(a: str, b: str) -> Column:
        return F.sqrt(F.aggregate(F.zip_with(a, b, lambda p, q: (p - q) * (p - q)), F.lit(0.0), lambda s, v: s + v))

    counted = pts.join(counts, "cell")
    dense = counted.where(F.col("n") >= min_pts).select(*key, "x", "cell")
    sparse = counted.where(F.col("n") < min_pts).select(*key, "x", "cell")

    def asked(rows: DataFrame) -> DataFrame:
        named = rows.select(*[F.col(k).alias(f"_{k}") for k in key], F.col("x").alias("_x"), F.col("cell").alias("a"))
        return named.join(pairs, "a").drop("a").withColumnRenamed("b", "cell")

    met = pts.join(asked(sparse), "cell").where(gap("x", "_x") <= eps)
    sparse_core = met.groupBy(*[f"_{k}" for k in key]).agg(F.count(F.lit(1)).alias("m")).where(F.col("m") >= min_pts)
    sparse_core = sparse.join(sparse_core.select(*[F.col(f"_{k}").alias(k) for k in key]), key, "left_semi")
    core = cut_lineage(dense.unionByName(sparse_core))
    sub = F.transform("x", lambda v: F.floor(v * fine / side))
    reps = cut_lineage(core.groupBy("cell", sub.alias("sub")).agg(F.min("x").alias("x")).select("cell", "x"))
    left = reps.select(F.col("cell").alias("a"), F.col("x").alias("_x")).join(pairs.where("a < b"), "a").select("a", "_x", F.col("b").alias("cell"))
    edges = reps.join(left, "cell").where(gap("x", "_x") <= eps).select("a", F.col("cell").alias("b")).distinct()
    labels = components(edges, core.select(F.col("cell").alias("node")).distinct())
    roots = ordered_index(labels.select("label").distinct(), ["label"], out=out)
    named = cut_lineage(labels.join(broadcast_if_small(roots), "label").select(F.col("node").alias("cell"), F.col(out).cast("int").alias(out)))
    core_rows = core.join(named, "cell").select(*key, out)
    border = core.join(asked(sparse.join(sparse_core.select(*key), key, "left_anti")), "cell").where(gap("x", "_x") <= eps)
    border = border.join(named, "cell").groupBy(*[f"_{k}" for k in key]).agg(F.min(out).alias(out))
    found = core_rows.unionByName(border.select(*[F.col(f"_{k}").alias(k) for k in key], out))
    return df.dropna(subset=cols).join(found, key, "left").withColumn(out, F.coalesce(F.col(out), F.lit(-1)))


# ---------------------------------------------------------------- isolation forest

def _grow(x: np.ndarray, rng: np.random.Generator, limit: int) -> list[tuple]:
    """Random isolation tree as rows (feature, split, left, right, adjusted depth); feature −1 marks a leaf."""
    nodes: list[tuple] = []

    def average(n: int) -> float:
        if n <= 1:
            return 0.0
        return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def build(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append(())
        low, high = (rows.min(axis=0), rows.max(axis=0)) if len(rows) else (None, None)
        open_cols = np.flatnonzero(high > low) if len(rows) > 1 else []
        if depth >= limit or len(open_cols) == 0:
            nodes[at] = (-1, 0.0, -1, -1, depth + average(len(rows)))
            return at
        f = int(rng.choice(open_cols))
        split = float(rng.uniform(low[f], high[f]))
        inside = rows[:, f] < split
        left, right = build(rows[inside], depth + 1), build(rows[~inside], depth + 1)
        nodes[at] = (f, split, left, right, 0.0)
        return at

    build(x, 0)
    return nodes


def _mixed(mark: np.ndarray, tree: int) -> np.ndarray:
    """63 bits of (row, tree), independent from tree to tree."""
    u = np.uint64
    x = mark.view(u) + u((0x9E3779B97F4A7C15 * (tree + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> u(30))) * u(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> u(27))) * u(0x94D049BB133111EB)
    return ((x ^ (x >> u(31))) >> u(1)).view(np.int64)


def tree_samples(df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int, sample: int, seed: int) -> DataFrame:
    """(tree, mark, x): per tree the `sample` rows of the least hashes of (key, tree), in one pass.

    Each task keeps only its own least rows per tree; these lists are merged per tree.
    """
    mark = F.xxhash64(*[F.col(f"`{c}`") for c in key], F.lit(seed))
    size = len(cols)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks, rows = [np.zeros(0, np.int64)] * trees, [np.zeros((0, size))] * trees
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1), size)
            for t in range(trees):
                m = _mixed(own, t)
                if len(marks[t]) == sample:
                    low = m < marks[t].max()
                    m, part = m[low], x[low]
                else:
                    part = x
                if len(m):
                    m, part = np.concatenate([marks[t], m]), np.concatenate([rows[t], part])
                    if len(m) > sample:
                        at = np.argpartition(m, sample - 1)[:sample]
                        m, part = m[at], part[at]
                    marks[t], rows[t] = m, part
        for t in range(trees):
            if len(marks[t]):
                x = pa.ListArray.from_arrays(pa.array(np.arange(len(marks[t]) + 1, dtype=np.int32) * size), pa.array(rows[t].ravel()))
                yield pa.record_batch({"tree": pa.array(np.full(len(marks[t]), t, np.int32)), "mark": pa.array(marks[t]), "x": x})

    lists = df.dropna(subset=list(cols)).select(mark.alias("m"), _vector(cols).alias("x")).mapInArrow(least, "tree int, mark long, x array<double>")
    ranked = lists.withColumn("r", F.row_number().over(Window.partitionBy("tree").orderBy("mark", "x")))
    return ranked.where(F.col("r") <= sample).drop("r")


def isolation_scores(df: DataFrame, cols: Sequence[str], key: Sequence[str], trees: int = 100, sample: int = 256, seed: int = 42) -> DataFrame:
    """Rows with an anomaly score in (0, 1). Every tree has its own sample, by one rule at every size."""
    cols = list(cols)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = np.stack(pdf.sort_values("mark")["x"].to_numpy()).astype(float)
        f, s, left, right, depth = zip(*_grow(x, np.random.default_rng(seed + tree), math.ceil(math.log2(max(len(x), 2)))))
        return pd.DataFrame([(tree, len(x), list(f), list(s), list(left), list(right), list(depth))], columns=["tree", "n", "f", "s", "l", "r", "d"])

    schema = "tree int, n int, f array<int>, s array<double>, l array<int>, r array<int>, d array<double>"
    grown = sorted(tree_samples(df, cols, key, trees, sample, seed).groupBy("tree").applyInPandas(grow, schema).collect(), key=lambda t: t["tree"])
    if not grown:
        return df.dropna(subset=cols).withColumn("score", F.lit(None).cast("double"))
    forest = [(np.array(t["f"]), np.array(t["s"]), np.array(t["l"]), np.array(t["r"]), np.array(t["d"])) for t in grown]
    n = float(np.mean([t["n"] for t in grown]))
    norm = 2 * (math.log(max(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / n if n > 2 else 1.0
    limit = math.ceil(math.log2(max(n, 2)))

    @F.pandas_udf("double")
    def score(v: pd.Series) -> pd.Series:
        x = np.stack(v.to_numpy()).astype(float)
        total, place = np.zeros(len(x)), np.arange(len(x))
        for f, s, left, right, depth in forest:
            at = np.zeros(len(x), dtype=int)
            for _ in range(limit + 1):
                inner = f[at] >= 0
                if not inner.any():
                    break
                go_left = x[place, np.where(inner, f[at], 0)] < s[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += depth[at]
        return pd.Series(np.power(2.0, -total / len(forest) / norm))

    return spread_out(df.dropna(subset=cols)).withColumn("score", score(_vector(cols)))


def isolation_forest(df: DataFrame, cols: Sequence[str], key: Sequence[str], contamination: float = 0.1, seed: int = 42, trees: int = 100) -> DataFrame:
    """Rows with score and an outlier flag above the contamination quantile."""
    scored = isolation_scores(df, cols, key, trees, seed=seed)  # rows may move to other cores; scores don't depend on it
    scores = cut_lineage(scored.select("score"))  # one column; the rows themselves are not written
    (cut,) = quantile_values(scores, "score", [1 - contamination])
    return scored.withColumn("outlier", F.col("score") > F.lit(cut))
