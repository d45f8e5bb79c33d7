"""Sharding along a Hilbert curve: rows that are near in several metadata dimensions share files, which then can be pruned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumora.llm.shared import fresh, let
from lumora.plans.order import running_sums

SHARDS = 40
BITS = 4
#: Bytes of a row besides its text.
ROW_BYTES = 16


def hilbert_index(coordinates: Sequence[Column], bits: int = BITS) -> Column:
    """Place of a grid cell on the Hilbert curve; every coordinate has `bits` bits.

    The coordinates are turned from the highest level down, then Gray-coded, and their bits interleaved.
    """
    n = len(coordinates)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def turned(x: Column, step: Column) -> Column:
        q, i = step["q"], step["i"]
        low = q - 1
        swap = F.get(x, F.lit(0)).bitwiseXOR(F.get(x, i)).bitwiseAND(low)
        flip = F.get(x, i).bitwiseAND(q) != 0
        first = F.when(flip, low).otherwise(swap)
        return F.transform(x, lambda v, j: F.when(j == 0, v.bitwiseXOR(first)).when((j == i) & ~flip, v.bitwiseXOR(swap)).otherwise(v))

    def coded(x: Column) -> Column:
        gray = F.transform(x, lambda _, j: F.aggregate(F.slice(x, F.lit(1), j + 1), F.lit(0), lambda a, v: a.bitwiseXOR(v)))
        return let(gray, interleaved)

    def interleaved(g: Column) -> Column:
        levels = F.array(*[F.lit(1 << b) for b in range(bits - 1, 0, -1)])
        mask = F.aggregate(levels, F.lit(0), lambda t, q: F.when(g[n - 1].bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t))

        def digits(t: Column) -> Column:
            total = F.lit(0).cast("long")
            for b in range(bits - 1, -1, -1):
                for i in range(n):
                    total = total * 2 + F.shiftright(g[i].bitwiseXOR(t), b).bitwiseAND(F.lit(1))
            return total

        return let(mask, digits)

    start = F.array(*[c.cast("int") for c in coordinates])
    return let(F.aggregate(steps, start, turned) if bits > 1 else start, coded)


def by_digest(value: Column, bits: int = BITS) -> Column:
    """A coordinate for a column without order: the first bits (four at most) of a digest; null counts as empty."""
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(value.cast("string"), F.lit(""))), 1, 1), 16, 10).cast("int"), 4 - bits)


def by_magnitude(value: Column, first: int = 5, bits: int = BITS) -> Column:
    """A coordinate for a count: how many of 2^first, 2^(first+1), … it reaches."""
    return sum(((value >= (1 << (first + k))).cast("int") for k in range((1 << bits) - 1)), F.lit(0))


def size_of(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + ROW_BYTES).cast("long")


def crc_of(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def assign(rows: DataFrame, coordinates: Sequence[Column], size: Column, order: Sequence[str], shards: int = SHARDS, law: str = "rows", bits: int = BITS) -> DataFrame:
    """`rows` with two more columns, `shard` and `slot` (an input column of such a name is replaced).

    Rows are put in the order of the curve, then of the columns in `order` (null first), and the sequence is cut into runs:
    of equal counts (`rows`: at most one apart) or of near equal `size` sums (`bytes`: a row belongs where its middle
    lies). Positions come from range partitions and their totals, so no task gets all rows; rows that agree in everything
    are split between ranges as well. An empty table gives no rows.
    """
    if law not in ("rows", "bytes"):
        raise ValueError("law is rows or bytes")
    rows = rows.drop(*[c for c in rows.columns if c.lower() in ("shard", "slot")])
    curve, weight, tie, position, passed = (fresh(rows, f"_{n}") for n in ("curve", "weight", "tie", "position", "passed"))
    placed = rows.select("*", hilbert_index(coordinates, bits).alias(curve), size.alias(weight), F.monotonically_increasing_id().alias(tie))
    n, total = rows.agg(F.count(F.lit(1)), F.sum(size)).first()
    sums = {position: F.lit(1).cast("long")} | ({passed: F.col(weight)} if law == "bytes" else {})
    counted = running_sums(placed, sums, [curve, *order, tie], small=False)
    at = F.col(position) - 1
    if law == "rows":
        made = counted.withColumn("shard", F.expr(f"CAST((`{position}` - 1) * {shards} div {max(n, 1)} AS int)"))
        made = made.withColumn("slot", at - F.expr(f"(shard * {n}L + {shards - 1}) div {shards}"))
    else:
        middle = 2 * F.col(passed) - F.col(weight)
        made = counted.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / F.lit(2 * max(total or 0, 1)))).cast("int"))
        starts = F.broadcast(made.groupBy("shard").agg(F.min(at).alias(passed + "_first")))  # one row per shard
        made = made.join(starts, "shard").withColumn("slot", at - F.col(passed + "_first"))
    return made.select(*[F.col(f"`{c}`") for c in rows.columns], "shard", "slot")


def document_coordinates(text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> list[Column]:
    return [by_digest(F.col(f"`{lang_col}`")), by_digest(F.col(f"`{source_col}`")), by_magnitude(size_of(F.col(f"`{text_col}`")))]


def shard_documents(docs: DataFrame, shards: int = SHARDS, law: str = "rows", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null: no law by key).

    Dimensions are language, source and size. Null texts have 16 bytes and the checksum of the empty text; null languages
    and sources count as empty. Repeated rows and null ids get a slot each. Only these columns are shuffled, never texts.
    """
    text = F.col(f"`{text_col}`")
    slim = docs.select(F.col(f"`{id_col}`").alias("doc_id"), size_of(text).alias("size"), crc_of(text).alias("text_crc32"), *[c.alias(f"d{k}") for k, c in enumerate(document_coordinates(text_col, lang_col, source_col))])
    made = assign(slim, [F.col("d0"), F.col("d1"), F.col("d2")], F.col("size"), ["doc_id", "text_crc32", "size"], shards, law)
    return made.select("doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, law: str = "bytes", id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> None:
    """Write whole rows into one folder per shard, in curve order, so that file statistics are narrow in every dimension."""
    made = assign(docs, document_coordinates(text_col, lang_col, source_col), size_of(F.col(f"`{text_col}`")), [id_col], shards, law)
    made.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
