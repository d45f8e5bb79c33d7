"""Helpers of the corpus operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumora.plans.sizing import scratch, written  # noqa: F401  (of the corpus operators too)

#: A-Z to a-z, other ASCII characters that belong to no word to a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def words_of(text: bytes) -> list[bytes]:
    """Lower-case words of a UTF-8 text."""
    return text.translate(PLAIN).split()


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of `value`, which is computed once however often `body` names it."""
    return F.transform(F.array(value), body)[0]


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have in any letter case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_and_text(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Only the columns that an operator works on, so that no other column can clash."""
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"), *[F.col(f"`{c}`").alias(c) for c in more])


def fingerprint(text: Column) -> Column:
    """64 bits that tell apart the texts of rows with one id; null has its own value."""
    return F.xxhash64(text, F.length(text))


def before_each(values: Column, merge: Callable[[Column, Column], Column], zero: Column) -> Column:
    """For each value of an array, all earlier ones merged (an associative operation), by blocks of 64."""

    def merged(part: Column) -> Column:
        return F.aggregate(part, zero, lambda a, b: merge(a, b))

    def of_values(x: Column) -> Column:
        last = ((F.size(x) - 1) / 64).cast("int")
        totals = F.transform(F.sequence(F.lit(0), last), lambda c: merged(F.slice(x, c * 64 + 1, F.lit(64))))

        def inside(blocks: Column) -> Column:
            return F.transform(x, lambda _, i: merge(F.get(blocks, (i / 64).cast("int")), merged(F.slice(x, i - i % 64 + 1, i % 64))))

        def of_blocks(t: Column) -> Column:
            return let(F.transform(t, lambda _, c: merged(F.slice(t, F.lit(1), c))), inside)

        return F.when(F.size(x) > 0, let(totals, of_blocks)).otherwise(x)

    return let(values, of_values)


def pattern_spans(text: Column, pattern: str, *hints: str, context: tuple[int, int] | None = None) -> Column:
    """All leftmost, non-overlapping matches of a pattern that matches no empty text: array of (start, end, match).

    With `context`, also `before` and `after`: so many characters on either side, up to the next match.

    Positions are code points, `end` is exclusive. What stands between matches gives the positions. The pattern is only
    tried on texts that hold one of the `hints`. Null, or an empty array, where nothing matches.
    """

    def placed(found: Column) -> Column:
        def of(between: Column) -> Column:
            lengths = F.transform(found, lambda m, i: F.length(between[i]) + F.length(m))

            def span(before: Column, m: Column, i: Column) -> Column:
                start = before[i] + F.length(between[i])
                parts = [start.alias("start"), (start + F.length(m)).alias("end"), m.alias("match")]
                if context:
                    parts += [F.substring(between[i], -context[0], context[0]).alias("before"), F.substring(between[i + 1], 1, context[1]).alias("after")]
                return F.struct(*parts)

            return let(before_each(lengths, lambda n, x: n + x, F.lit(0)), lambda before: F.transform(found, lambda m, i: span(before, m, i)))

        return F.when(F.size(found) > 0, let(F.split(text, pattern, -1), of))

    spans = let(F.regexp_extract_all(text, F.lit(pattern), 0), placed)
    if not hints:
        return spans
    there = F.contains(text, F.lit(hints[0]))
    for hint in hints[1:]:
        there = there | F.contains(text, F.lit(hint))
    return F.when(there, spans)


def no_spans() -> Column:
    return F.array().cast("array<struct<kind:string,rank:int,start:int,end:int>>")


def of_kind(spans: Column, kind: str, rank: int) -> Column:
    """Spans with their kind and its place in the list of kinds; none if null."""
    named = F.transform(spans, lambda s: F.struct(F.lit(kind).alias("kind"), F.lit(rank).alias("rank"), s["start"].alias("start"), s["end"].alias("end")))
    return F.coalesce(named, no_spans())


def joined_spans(spans: Column, first: str, then: str) -> Column:
    """`kind:start:end`, comma-joined, in the order of these two fields."""
    keyed = F.transform(spans, lambda s: F.struct(s[first].alias("a"), s[then].alias("b"), s["end"].alias("c"), F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")).alias("said")))
    return F.array_join(F.transform(F.sort_array(keyed), lambda s: s["said"]), ",")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
