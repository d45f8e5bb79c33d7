"""Row order without a one-task sort: running sums, positions and sliding windows.

A group may hold a third of all rows, so a window over the whole group is used only after a
count shows the input is small. Otherwise rows are range-partitioned on (keys, order), the layout
is pinned by a checkpoint (range bounds are sampled, so a recomputation could move rows), and
totals per range are carried over as offsets.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from lumora.plans.sizing import cut_lineage, is_small, join_on, partitions_for

#: Rows per block of a sliding window; halo rows come on top.
BLOCK_ROWS = 65_536


def group_window(keys: Sequence[str]) -> WindowSpec:
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def running_sums(
    df: DataFrame,
    sums: Mapping[str, Column],
    order: Sequence[str],
    keys: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Add inclusive running totals of `sums` per `keys` in `order` (which must be total)."""
    keys, order = list(keys), list(order)
    if small is None:
        df = cut_lineage(df)  # counted, sampled and read: computed once
        small = is_small(df)
    if small:
        frame = group_window(keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        return df.select("*", *[F.sum(c).over(frame).alias(n) for n, c in sums.items()])

    weights = {n: f"_w_{n}" for n in sums}
    weighted = df.select("*", *[c.alias(weights[n]) for n, c in sums.items()])
    parts = partitions_for(df, df.count())
    ranged = weighted.repartitionByRange(parts, *[F.col(f"`{c}`") for c in [*keys, *order]])
    blocks = cut_lineage(ranged.withColumn("_range", F.spark_partition_id()))
    group = [*keys, "_range"]
    totals = blocks.groupBy(*group).agg(*[F.sum(w).alias(w) for w in weights.values()])
    before = group_window(keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, *[F.coalesce(F.sum(w).over(before), F.lit(0)).alias(f"_o_{n}") for n, w in weights.items()]
    )
    inside = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = blocks.select("*", *[F.sum(w).over(inside).alias(f"_l_{n}") for n, w in weights.items()])
    joined = join_on(local, offsets, group)
    return joined.select(
        *df.columns, *[(F.col(f"_l_{n}") + F.col(f"_o_{n}")).alias(n) for n in sums]
    )


def ordered_index(
    df: DataFrame, order: Sequence[str], keys: Sequence[str] = (), out: str = "_pos", small: bool | None = None
) -> DataFrame:
    """Add the 0-based position of each row within `keys`, in `order`."""
    counted = running_sums(df, {out: F.lit(1).cast("long")}, order, keys, small)
    return counted.withColumn(out, F.col(out) - 1)


#: Characters by which texts are first counted, to find the ranks among them.
HEAD = 3


def rank_ranges(df: DataFrame, order: Sequence[str], ranks: Callable[[int], Sequence[int]], out: str) -> DataFrame:
    """Add how many of `ranks`, which depend on the number of rows, are at or below the 0-based position of a row in `order`.

    The first column is text without nulls and evenly spread, such as a digest. Rows stay where they are: counts by heads of the
    texts tell which heads hold a rank, counts by text inside these heads which texts. Only rows with such a text are sorted.
    `df` is read several times and must be pinned, or made from pinned rows by value alone.
    """
    text = F.col(f"`{order[0]}`")
    head, each = F.substring(text, 1, HEAD), F.count(F.lit(1)).alias("_c")

    def total(parts: Sequence[Column]) -> Column:
        return reduce(lambda x, y: x + y, parts)

    def at(values: Column, starts: Mapping[str, int]) -> Column:
        return total([F.when(values == v, F.lit(s)).otherwise(F.lit(0)) for v, s in starts.items()])

    heads = cut_lineage(df.groupBy(head.alias("_v")).agg(each))
    n = heads.agg(F.coalesce(F.sum("_c"), F.lit(0))).first()[0]
    wanted = [r for r in ranks(n) if r < n]
    if not wanted:
        return df.withColumn(out, F.lit(0))
    holds = reduce(lambda x, y: x | y, [(F.col("_cum") > r) & (F.col("_cum") - F.col("_c") <= r) for r in wanted])
    found = running_sums(heads, {"_cum": F.col("_c")}, ["_v"]).where(holds).collect()
    before = {r["_v"]: r["_cum"] - r["_c"] for r in found}
    texts = cut_lineage(df.where(head.isin(list(before))).groupBy(head.alias("_head"), text.alias("_v")).agg(each))
    found = running_sums(texts, {"_cum": F.col("_c")}, ["_v"], ["_head"]).withColumn("_cum", F.col("_cum") + at(F.col("_head"), before)).where(holds).collect()
    starts = {r["_v"]: r["_cum"] - r["_c"] for r in found}
    own = [next(v["_v"] for v in found if v["_cum"] - v["_c"] <= r < v["_cum"]) for r in wanted]
    edge = ordered_index(df.where(text.isin(list(starts))), order, [order[0]], "_at")
    place = F.col("_at") + at(text, starts)
    rest = df.where(~text.isin(list(starts))).withColumn(out, total([(text > F.lit(v)).cast("int") for v in own]))
    return rest.unionByName(edge.withColumn(out, total([(place >= r).cast("int") for r in wanted])).drop("_at"))


def sliding(
    df: DataFrame,
    pos: str,
    before: int,
    after: int,
    make: Callable[[WindowSpec], Mapping[str, Column]],
    keys: Sequence[str] = (),
    small: bool | None = None,
    block: int | None = None,
) -> DataFrame:
    """Add window columns that look at most `before` rows back and `after` rows ahead.

    `pos` must be contiguous per key. A large group is cut into blocks of positions; rows near a
    block edge are copied to the neighbour block, so every window task is bounded.
    """
    keys = list(keys)
    small = is_small(df) if small is None else small
    if small:
        window = group_window(keys).orderBy(pos)
        return df.select("*", *[c.alias(n) for n, c in make(window).items()])
    block = block or int(df.sparkSession.conf.get("lumora.blockRows", str(BLOCK_ROWS)))
    home = F.floor(F.col(pos) / block)
    targets = F.sequence(F.floor((F.col(pos) - after) / block), F.floor((F.col(pos) + before) / block))
    spread = df.withColumn("_home", home).withColumn("_block", F.explode(targets))
    window = Window.partitionBy(*keys, "_block").orderBy(pos)
    made = spread.select("*", *[c.alias(n) for n, c in make(window).items()])
    return made.where(F.col("_home") == F.col("_block")).drop("_home", "_block")


def lags(
    df: DataFrame,
    pos: str,
    columns: Mapping[str, tuple[str, int]],
    keys: Sequence[str] = (),
    small: bool | None = None,
) -> DataFrame:
    """Add lagged copies: `columns` maps a new name to (source column, lag)."""
    longest = max(lag for _, lag in columns.values())
    return sliding(
        df, pos, longest, 0,
        lambda w: {name: F.lag(source, lag).over(w) for name, (source, lag) in columns.items()},
        keys, small,
    )
