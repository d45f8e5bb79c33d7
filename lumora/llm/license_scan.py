"""Licence scans: whole texts and single lines are brought to a canonical form, and their digests joined to known ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumora.llm.licences import NOTICES, TEXTS
from lumora.llm.shared import id_and_text, let

#: What goes on after `copyright` where it begins a line of a licence's own words, so that no holder follows.
PROSE = ("holder", "owner", "notice", "law", "license", "licence", "statement", "disclaimer", "interest", "treaty", "permission", "protection", "infringement", "right", "status", "and ", "or ", "in ", "on ", "is ", "are ", "if ", "of ", "related", "doctrine", "as ", "to ", "for ", "by ", "under ", "applies", "the software", "the library", "terms", "line", "material", "act", "resulting", "permissions", "ownership")
#: Applied to lower-case text, one after the other: pattern, replacement. Java and RE2 read them alike.
CANONICAL: tuple[tuple[str, str], ...] = (
    (r"(?m)^[^\n\p{L}\p{N}©]*(?:copyright|©|\(c\))[ \t]*(?:\(c\)|©)?[ \t]*(?:[0-9]{4}|<|\[|\{)[^\n]*$", ""),
    (r"(?m)^[^\n\p{L}\p{N}©]*(?:copyright[ \t:]*(?:\(c\)|©)|©)[^\n]*$", ""),
    (r"(?m)^[^\n\p{L}\p{N}©]*\(c\)[^\n]*[0-9]{4}[^\n]*$", ""),
    *[(rf"copyright[ \t]+{word}", f"copyright_ {word}") for word in PROSE],
    (r"(?m)^[^\n\p{L}\p{N}©]*copyright[ \t:]+[^\n \t][^\n]*$", ""),
    (r"copyright_ ", "copyright "),
    (r"(?m)^[ \t]*[0-9]{1,2}[.)][ \t]+", ""),
    (r"(?m)^[^\n\p{L}\p{N}]*all rights reserved[^\n\p{L}\p{N}]*$", ""),
    (r"licence", "license"),
    (r"sub[- ]license", "sublicense"),
    (r"non-infringement", "noninfringement"),
    (r"copyright (?:holders|owners|owner)", "copyright holder"),
    (r"per cent", "percent"),
    (r"acknowledgement", "acknowledgment"),
    (r"https://", "http://"),
    (r"&", " and "),
    (r"[^\p{L}\p{N}\n]+", " "),
)
#: Known texts are few by contract, so that their digests may be sent to all tasks.
MOST_KNOWN = 10_000


def canonical_lines(text: Column) -> Column:
    """The lines of a text in canonical form, without white space at their ends."""
    text = F.lower(text)
    for pattern, replacement in CANONICAL:
        text = F.regexp_replace(text, pattern, replacement)
    return F.transform(F.split(text, "\n", -1), lambda line: F.trim(line))


def _whole(lines: Column) -> Column:
    return F.array_join(F.filter(lines, lambda line: line != ""), " ")


def known_digests(spark: SparkSession, known: Sequence[tuple[str, str]] | None = None) -> DataFrame:
    """(digest, licence) of known texts, by default those of this library with and without their titles."""
    if known is None:
        known = [*NOTICES, *[(name, text) for name, _, text in TEXTS], *[(name, f"{title}\n\n{text}") for name, title, text in TEXTS]]
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    rows = spark.createDataFrame(list(known), "licence string, text string")
    return rows.select(F.sha2(_whole(canonical_lines(F.col("text"))), 256).alias("digest"), "licence").groupBy("digest").agg(F.min("licence").alias("licence"))


def find_licences(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per match: doc_id, scope (`text`, or `line` if the text has several), line (from 0; null for a whole text), licence, digest.

    Null, empty and blank texts match nothing. Repeated rows and null ids give their own matches. Other columns are not
    read. Every line of any length is judged; nothing is shuffled, as only the known digests are broadcast, of which
    there are MOST_KNOWN at most.
    """
    known = F.broadcast(known if known is not None else known_digests(docs.sparkSession))

    def units(lines: Column) -> Column:
        each = F.transform(lines, lambda line, i: F.struct(F.lit("line").alias("scope"), i.alias("line"), line.alias("said")))
        single = F.when(F.size(lines) > 1, each).otherwise(F.slice(each, 1, 0))
        whole = F.array(F.struct(F.lit("text").alias("scope"), F.lit(None).cast("int").alias("line"), _whole(lines).alias("said")))
        told = F.filter(F.concat(whole, single), lambda u: u["said"] != "")
        return F.transform(told, lambda u: F.struct(u["scope"].alias("scope"), u["line"].alias("line"), F.sha2(u["said"], 256).alias("digest")))

    docs = id_and_text(docs, id_col, text_col)
    parts = docs.select("doc_id", F.explode_outer(let(canonical_lines(F.col("text")), units)).alias("u")).select("doc_id", "u.scope", "u.line", "u.digest")
    return parts.join(known, "digest").select("doc_id", "scope", "line", "licence", "digest")
