"""Secret scans over a blob ledger: every distinct text is scanned once per version of the rules."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from lumora.llm.shared import id_and_text, joined_spans, of_kind, pattern_spans, scratch


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: Only texts with one of these are searched; none: all.
    hints: tuple[str, ...] = ()
    #: Of a match, this part must have so many characters.
    group: int = 0
    least: int = 1


#: The base kinds in their order. Runs that are too short fail as a whole, so a count replaces `+` where
#: no shorter match can begin inside a failed run.
BASE: tuple[Rule, ...] = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", (":", "="), 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}", ("AKIA",)),
    Rule("hex", r"[0-9a-f]{24,}"),
)
#: Further kinds.
MORE: tuple[Rule, ...] = (
    # up to the END marker (headers may hold single hyphens), or without one to the end of the base64 lines
    Rule(
        "private_key",
        r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----(?:[^-]*(?:-[^-]+){0,40}-----END [A-Z ]{0,40}PRIVATE KEY-----|[ \t\r\n\\]*[A-Za-z0-9+/=]{16}(?:[A-Za-z0-9+/= \t\r\n\\]*[A-Za-z0-9+/=]{16})?(?:[ \t\r\n\\]+[A-Za-z0-9+/]+=+)?)?",
        ("PRIVATE KEY-----",),
    ),
    Rule("code_host_token", r"gh[pousr]_[A-Za-z0-9]{36,}", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-")),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*", ("eyJ",)),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35,}", ("AIza",)),
    Rule("url_login", r"://[A-Za-z0-9._%+-]+:[A-Za-z0-9._%+!$&*-]+@", ("://",)),
)
RULES = BASE + MORE


def version_of(rules: Sequence[Rule]) -> str:
    """Changes with any part of any rule."""
    return hashlib.sha256(repr([tuple(r) for r in rules]).encode()).hexdigest()[:16]


def _long_enough(spans: Column, rule: Rule) -> Column:
    return F.filter(spans, lambda s: F.length(F.regexp_extract(s["match"], rule.pattern, rule.group)) >= rule.least)


def spans_of(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Array of (kind, rank, start, end) of all rules over a whole text."""
    parts = []
    for rank, rule in enumerate(rules):
        spans = pattern_spans(text, rule.pattern, *rule.hints)
        if rule.least > 1:
            spans = _long_enough(spans, rule)
        parts.append(of_kind(spans, rule.kind, rank))
    return F.concat(*parts)


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def _ledger(spark: SparkSession, path: str, version: str) -> DataFrame:
    """What was found in every blob that this version of the rules has seen."""
    empty = spark.range(0).selectExpr("CAST(null AS binary) AS blob", "CAST(null AS string) AS version", "CAST(null AS array<struct<kind:string,rank:int,start:int,end:int>>) AS spans")
    try:
        kept = spark.read.schema(empty.schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        kept = empty
    return kept.where(F.col("version") == version).select("blob", "spans")


def update_ledger(docs: DataFrame, ledger: str, text_col: str = "text", rules: Sequence[Rule] = RULES) -> int:
    """Scan the blobs of `docs` that the ledger lacks for these rules, append them, and return how many there were.

    Equal texts meet by the digest of their content; the copies are dropped before they are shuffled, then per digest. A
    blob without findings is noted as well, so that it isn't scanned again. A job that is repeated after a failure adds
    whole files or none.
    """
    version, spark = version_of(rules), docs.sparkSession
    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text")).withColumn("blob", _blob(F.col("text")))
    blobs = texts.groupBy("blob").agg(F.any_value("text").alias("text"))
    unseen = blobs.join(_ledger(spark, ledger, version).select("blob"), "blob", "left_anti")
    before = _ledger(spark, ledger, version).count()
    unseen.select("blob", F.lit(version).alias("version"), spans_of(F.col("text"), rules).alias("spans")).write.mode("append").parquet(ledger)
    return _ledger(spark, ledger, version).count() - before


def findings(docs: DataFrame, ledger: str, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per input row: doc_id and the spans that the ledger has for its text; an empty array if none.

    Null texts count as empty. Repeated rows and null ids give a row each. Other columns are not read.
    """
    paths = id_and_text(docs, id_col, text_col).select("doc_id", _blob(F.col("text")).alias("blob"))
    found = _ledger(docs.sparkSession, ledger, version_of(rules)).where(F.size("spans") > 0).groupBy("blob").agg(F.any_value("spans").alias("spans"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def scan(docs: DataFrame, ledger: str | None = None, id_col: str = "doc_id", text_col: str = "text", rules: Sequence[Rule] = RULES) -> DataFrame:
    """`findings` of `docs` after the ledger (a new one if not given) was brought up to date."""
    ledger = ledger or scratch(docs.sparkSession, "ledger")
    update_ledger(docs, ledger, text_col, rules)
    return findings(docs, ledger, id_col, text_col, rules)


def digests(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, and spans as text by start and kind."""
    base = F.filter("spans", lambda s: s["rank"] < len(BASE))

    def count(rule: Rule) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")

    counts = [count(rule) for rule in BASE]
    return found.select("doc_id", *counts, F.sha2(joined_spans(base, "start", "rank"), 256).alias("base_sha256"), joined_spans(F.col("spans"), "start", "rank").alias("spans"))
