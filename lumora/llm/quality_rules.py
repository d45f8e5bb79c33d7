"""Quality rules: a table of thresholds becomes one projection over whole texts, without user functions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from lumora.llm.shared import id_and_text, let

#: Fixed values of the measures.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
WINDOW = 5
#: Very frequent words of the corpus languages, as they stand inside sentences.
STOP_WORDS = (
    "the of and to in is that for it as with was on be by this are from at or an a "
    "le la les de des et un une en du que est dans pour sur par au avec pas "
    "der die das und ein eine zu den von mit sich des auf für ist im dem nicht als "
    "el los las del que y en un una por con para se su al es no lo"
).split()

#: measure, least, most (null: open). A document is kept if every measure lies within its bounds.
THRESHOLDS: tuple[tuple[str, float | None, float | None], ...] = (
    ("n_words", 10, None),
    ("mean_word_chars", 2.0, 20.0),
    ("symbols_per_word", None, 0.1),
    ("stop_word_share", 0.02, None),
    ("dup_line_share", None, 0.5),
    ("repeat_word_share", None, 0.2),
)


def _covered_words(words: Column, width: int = WINDOW) -> Column:
    """Words inside windows of `width` words that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Equal hashes become neighbours by sorting, so the work is n log n.
    """
    last = F.size(words) - width

    def of_starts(starts: Column) -> Column:
        steps = F.transform(starts, lambda p, k: F.least(F.lit(width), F.coalesce(F.get(starts, k + 1) - p, F.lit(width))))
        return F.aggregate(steps, F.lit(0), lambda total, x: total + x)

    def of_sorted(pairs: Column) -> Column:
        def repeated(x: Column, k: Column) -> Column:
            before, after = F.get(pairs, k - 1)["h"], F.get(pairs, k + 1)["h"]
            return F.coalesce(before == x["h"], F.lit(False)) | F.coalesce(after == x["h"], F.lit(False))

        return let(F.sort_array(F.transform(F.filter(pairs, repeated), lambda x: x["p"])), of_starts)

    def of_hashes(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(let(pairs, of_sorted))

    starts = F.sequence(F.lit(0), last)
    hashes = F.transform(starts, lambda i: F.xxhash64(*[words[i + k] for k in range(width)]))
    return F.when(last < 1, F.lit(0)).otherwise(let(hashes, of_hashes))


def measures(text: Column) -> Column:
    """One struct of counts of a whole text (null: empty)."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(WORD_PATTERN))

    def counts(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
            F.size(F.filter(words, lambda w: w.isin(STOP_WORDS))).cast("long").alias("n_stop_words"),
            let(lines, lambda x: F.struct(F.size(x).cast("long").alias("all"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup"))).alias("lines"),
            _covered_words(words).cast("long").alias("n_repeat_words"),
        )

    return let(F.regexp_extract_all(text, F.lit(WORD_PATTERN), 0), counts)


def compiled(m: Column, thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> Column:
    """True where every measure lies within its bounds; a measure without value (no words, no lines) counts as 0."""
    words = F.nullif(m["n_words"], F.lit(0))
    known = {
        "n_words": m["n_words"],
        "mean_word_chars": m["word_chars"] / words,
        "symbols_per_word": m["n_symbols"] / words,
        "stop_word_share": (m["n_stop_words"] + 1) / words,  # one more, so that short texts may have none
        "dup_line_share": m["lines"]["dup"] / F.nullif(m["lines"]["all"], F.lit(0)),
        "repeat_word_share": m["n_repeat_words"] / words,
    }
    verdict = F.lit(True)
    for name, least, most in thresholds:
        value = F.coalesce(known[name], F.lit(0))
        if least is not None:
            verdict = verdict & (value >= F.lit(least))
        if most is not None:
            verdict = verdict & (value <= F.lit(most))
    return verdict


def base_failed(m: Column) -> Column:
    return (m["n_words"] < 10) | (100 * m["n_repeat_words"] > 20 * m["n_words"])


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """One row per input row: counts, `base_failed` and `kept`. One scan, no shuffle.

    Null and empty texts have no words and fail. Repeated rows and null ids give a row each. Other columns are not
    read. Very long texts cost n log n in their words.
    """
    measured = id_and_text(docs, id_col, text_col).select("doc_id", measures(F.col("text")).alias("m"))
    m = F.col("m")
    return measured.select(
        "doc_id", m["n_words"].alias("n_words"), m["word_chars"].alias("word_chars"), m["n_symbols"].alias("n_symbols"), m["lines"]["dup"].alias("n_dup_lines"),
        m["n_repeat_words"].alias("n_repeat_words"), base_failed(m).alias("base_failed"), (~base_failed(m) & compiled(m, thresholds)).alias("kept"),
        m["lines"]["all"].alias("n_lines"), m["n_stop_words"].alias("n_stop_words"),
    )


def keep_good(docs: DataFrame, text_col: str = "text", thresholds: Sequence[tuple[str, float | None, float | None]] = THRESHOLDS) -> DataFrame:
    """The rows of `docs`, with all their columns, that pass the base rules and the thresholds."""
    verdict = let(measures(F.col(f"`{text_col}`")), lambda m: ~base_failed(m) & compiled(m, thresholds))
    return docs.where(verdict)
