"""Size checks. A plan that gathers rows in one task, or broadcasts them, asks here first."""

from __future__ import annotations

import math
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

#: Above this many rows nothing may be windowed or sorted as one group.
SMALL_ROWS = 1_000_000
#: Above this many values the built-in exact percentile, which buffers distinct values, is not used.
PERCENTILE_ROWS = 5_000_000
#: Above this many rows a join side is shuffled, never broadcast.
BROADCAST_ROWS = 100_000
#: And above this many bytes of text and array content.
BROADCAST_BYTES = 64 * 1024 * 1024
#: Rows a range partition should hold.
ROWS_PER_PARTITION = 2_000_000


def small_rows(spark: SparkSession, limit: int = SMALL_ROWS) -> int:
    return int(spark.conf.get("lumora.smallRows", str(limit)))


def is_small(df: DataFrame, limit: int = SMALL_ROWS) -> bool:
    """One column-pruned count; partial counts are combined, no rows move. `lumora.smallRows` overrides the limit."""
    return df.count() <= small_rows(df.sparkSession, limit)


def partitions_for(df: DataFrame, rows: int) -> int:
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(shuffle, math.ceil(rows / ROWS_PER_PARTITION))


def spread_out(df: DataFrame) -> DataFrame:
    """Use all cores for work that costs more than moving the rows, when a count shows a small input.

    Large inputs have many partitions already and stay where they are.
    """
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if df.count() <= PERCENTILE_ROWS else df


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder the cluster names."""
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a shared folder")
            folder = tempfile.mkdtemp(prefix="lumora-checkpoint-")
        context.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table that later stages read again, below the folder that all executors share."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        cut_lineage(spark.range(0))  # sets a folder in local mode, refuses on a cluster
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/lumora-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write once as Parquet and read again: lineage ends, and later stages read only their columns."""
    path = scratch(df.sparkSession, name)
    df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a check of rows and bytes; beyond the limits the join shuffles.

    The side is computed once, pinned, and then counted and joined from the pinned rows.
    """
    pinned = cut_lineage(df)
    wide = F.lit(0).cast("long")
    for field in df.schema:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            wide = wide + F.coalesce(F.octet_length(c), F.lit(0))
        elif isinstance(field.dataType, T.ArrayType):
            wide = wide + F.coalesce(F.octet_length(F.to_json(c)), F.lit(0))
    rows, size = pinned.agg(F.count(F.lit(1)), F.coalesce(F.sum(wide), F.lit(0))).first()
    return F.broadcast(pinned) if rows <= limit and size <= BROADCAST_BYTES else pinned


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on `keys` where null matches null; key columns come from the left."""
    if not keys:
        raise ValueError("join_on needs at least one key")
    renamed = right
    for key in keys:
        renamed = renamed.withColumnRenamed(key, f"_r_{key}")
    condition: Column | None = None
    for key in keys:
        part = F.col(f"`{key}`").eqNullSafe(F.col(f"`_r_{key}`"))
        condition = part if condition is None else condition & part
    return left.join(renamed, condition, how).drop(*[f"_r_{key}" for key in keys])
