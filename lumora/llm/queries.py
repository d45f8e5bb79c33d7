"""The corpus operators as registered queries over whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from lumora.llm import bpe, decontamination, language_id, licences, license_scan, line_dedup, manifest, near_dedup, pii, quality_rules, secret_scan, sharding, suffix_dedup, whitening
from lumora.llm.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def _sql_bounds() -> str:
    """The threshold table as an SQL condition."""
    known = {
        "n_words": "n_words", "mean_word_chars": "word_chars / n_words", "symbols_per_word": "n_symbols / n_words", "stop_word_share": "(n_stop_words + 1) / n_words",
        "dup_line_share": "n_dup_lines / n_lines", "repeat_word_share": "n_repeat_words / n_words",
    }
    parts = []
    for name, least, most in quality_rules.THRESHOLDS:
        value = f"coalesce(CASE WHEN n_words > 0 THEN {known[name]} END, 0)"
        parts += [f"{value} >= {least}"] if least is not None else []
        parts += [f"{value} <= {most}"] if most is not None else []
    return " AND ".join(parts)


_STOPS = ", ".join(f"'{w}'" for w in quality_rules.STOP_WORDS)
#: Measures and verdict of every row of `{source}`.
QUALITY_SQL = rf"""
w AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM {{source}}),
windows AS (SELECT doc_id, unnest(range(1, len(ws) - 3)) AS p, ws FROM w WHERE len(ws) >= 6),
keyed AS (SELECT doc_id, p, array_to_string(ws[p:p + 4], ' ') AS win FROM windows),
twice AS (SELECT doc_id, win FROM keyed GROUP BY doc_id, win HAVING count(*) > 1),
hit AS (SELECT doc_id, count(DISTINCT p + o) AS n FROM keyed JOIN twice USING (doc_id, win) CROSS JOIN (VALUES (0), (1), (2), (3), (4)) AS v(o) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
             coalesce(hit.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines, len(list_filter(ws, lambda x: x IN ({_STOPS})))::BIGINT AS n_stop_words
      FROM w LEFT JOIN hit ON w.doc_id = hit.doc_id),
verdicts AS (SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
             NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND {_sql_bounds()} AS kept, n_lines, n_stop_words FROM m)"""


@register("op9_quality_rules", f"WITH {QUALITY_SQL.format(source='documents')} SELECT * FROM verdicts")
def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_report(table(spark, sf_dir, "documents"))


#: Shortened texts of every row of `{source}`.
LINES_SQL = r"""
l AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM {source}),
places AS (SELECT doc_id, p, ls FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS p FROM l WHERE len(ls) >= 3)),
wins AS (SELECT doc_id, p, array_to_string(ls[p:p + 2], chr(10)) AS win FROM places),
ranked AS (SELECT doc_id, p, row_number() OVER (PARTITION BY win ORDER BY doc_id NULLS FIRST, p) AS k FROM wins WHERE regexp_matches(win, '[^\x20\x09-\x0D]')),
gone AS (SELECT doc_id, list(DISTINCT p + o) AS covered FROM ranked CROSS JOIN (VALUES (0), (1), (2)) AS v(o) WHERE k > 1 GROUP BY doc_id),
shortened AS (SELECT l.doc_id, coalesce(len(ls), 0)::BIGINT AS n_lines, coalesce(len(covered), 0)::BIGINT AS n_removed,
                     CASE WHEN covered IS NULL THEN text
                          ELSE array_to_string(list_filter(ls, lambda x, i: NOT list_contains(covered, i)), chr(10)) END AS kept_text
              FROM l LEFT JOIN gone ON l.doc_id = gone.doc_id)"""


@register("op1_line_dedup", f"WITH {LINES_SQL.format(source='documents')} SELECT * FROM shortened")
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


@register("op3_bpe")
def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"))


def bpe_digests(docs: DataFrame) -> DataFrame:
    """Number of tokens, and digests of ids and decoded text."""
    made = bpe.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"))
    return made.select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


#: Words and hits of every row of `{source}`.
HITS_SQL = r"""
dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM {source}),
bw AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+') AS ws FROM benchmark),
bp AS (SELECT item, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(1, len(ws) - 12) + 1)) AS p FROM bw WHERE len(ws) > 0),
bwin AS (SELECT DISTINCT item, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM bp),
dp AS (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS p FROM dw CROSS JOIN (SELECT DISTINCT n FROM bwin) WHERE len(ws) >= n),
found AS (SELECT doc_id, p, n, item FROM (SELECT doc_id, p, n, array_to_string(ws[p:p + n - 1], ' ') AS win FROM dp) JOIN bwin USING (n, win)),
hits AS (SELECT doc_id, count(DISTINCT w) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS w FROM found) GROUP BY doc_id),
owned AS (SELECT doc_id, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY doc_id),
judged AS (SELECT dw.doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
                  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
           FROM dw LEFT JOIN hits ON dw.doc_id = hits.doc_id LEFT JOIN owned ON dw.doc_id = owned.doc_id)"""


@register("op2_decontaminate", f"WITH {HITS_SQL.format(source='documents')} SELECT * FROM judged")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


@register("op4_minhash")
def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicate_classes(table(spark, sf_dir, "documents"))


def spans_sql(name: str, kind: str, rank: int, pattern: str, keep: str = "TRUE") -> str:
    """A view of all matches of a pattern in `t(doc_id, text)`: what stands between matches gives their places."""
    pattern = pattern.replace("'", "''")
    return f"""
{name}_m AS (SELECT doc_id, regexp_extract_all(text, '{pattern}') AS found, regexp_split_to_array(text, '{pattern}') AS between FROM t WHERE regexp_matches(text, '{pattern}')),
{name}_i AS (SELECT doc_id, found, between, unnest(range(1, len(found) + 1)) AS i FROM {name}_m),
{name} AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, start, start + length(match) AS stop, match
           FROM (SELECT doc_id, found[i] AS match, length(array_to_string(between[1:i], '')) + length(array_to_string(found[1:i - 1], '')) AS start FROM {name}_i) WHERE {keep})"""


def _secret_sql() -> str:
    views = []
    for k, r in enumerate(secret_scan.RULES):
        keep = f"length(regexp_extract(match, '{r.pattern.replace(chr(39), chr(39) * 2)}', {r.group})) >= {r.least}" if r.least > 1 else "TRUE"
        views.append(spans_sql(f"r{k}", r.kind, k, r.pattern, keep))
    every = " UNION ALL ".join(f"SELECT doc_id, kind, rank, start, stop FROM r{k}" for k in range(len(secret_scan.RULES)))
    counts = ", ".join(f"count(rank) FILTER (rank = {k}) AS n_{r.kind}" for k, r in enumerate(secret_scan.BASE))
    said = "string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank, stop)"
    return f"""WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), {", ".join(views)}, every AS ({every})
SELECT t.doc_id, {counts}, sha256(coalesce({said} FILTER (rank < {len(secret_scan.BASE)}), '')) AS base_sha256, coalesce({said}, '') AS spans
FROM t LEFT JOIN every ON t.doc_id = every.doc_id GROUP BY t.doc_id"""


@register("op6_secret_scan", _secret_sql())
def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digests(secret_scan.scan(table(spark, sf_dir, "documents")))


def hilbert_of(point: tuple[int, ...], bits: int) -> int:
    """Place of one cell on the curve, for the tables of SQL and tests."""
    x, n = list(point), len(point)
    for b in range(bits - 1, 0, -1):
        q = 1 << b
        for i in range(n):
            if x[i] & q:
                x[0] ^= q - 1
            else:
                t = (x[0] ^ x[i]) & (q - 1)
                x[0] ^= t
                x[i] ^= t
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = 0
    for b in range(bits - 1, 0, -1):
        if x[-1] >> b & 1:
            t ^= (1 << b) - 1
    return int("".join(str((v ^ t) >> b & 1) for b in range(bits - 1, -1, -1) for v in x), 2)


def _crc_table() -> list[int]:
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_CURVE = [hilbert_of((c >> 8, c >> 4 & 15, c & 15), 4) for c in range(4096)]
_SHARD_SQL = f"""
WITH b AS (SELECT doc_id, lang, source, strlen(coalesce(text, '')) + 16 AS size,
                  list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::BIGINT) AS bytes FROM documents),
d AS (SELECT doc_id, size::BIGINT AS size,
             xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, bytes), lambda c, v: xor(c >> 8, {_crc_table()}[(xor(c, v) & 255) + 1]))) AS text_crc32,
             ('0x' || md5(coalesce(lang, ''))[1:1])::INT * 256 + ('0x' || md5(coalesce(source, ''))[1:1])::INT * 16 + list_sum(list_transform(range(5, 20), lambda k: (size >= (1::BIGINT << k))::INT))::INT AS cell FROM b),
r AS (SELECT *, row_number() OVER (ORDER BY {_CURVE}[cell + 1], doc_id NULLS FIRST) - 1 AS place, count(*) OVER () AS n FROM d)
SELECT doc_id, size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (place * 40 // n)::INT AS shard, (place - ((place * 40 // n) * n + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard FROM r"""


@register("op8_sharding", _SHARD_SQL)
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@register("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(pii.find_private(table(spark, sf_dir, "documents")))


@register("op7_language_id")
def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


def _license_sql() -> str:
    known = [*licences.NOTICES, *[(n, t) for n, _, t in licences.TEXTS], *[(n, f"{title}\n\n{t}") for n, title, t in licences.TEXTS]]
    quoted = lambda s: "'" + s.replace("'", "''") + "'"

    def lines(text: str) -> str:
        text = f"lower({text})"
        for pattern, replacement in license_scan.CANONICAL:
            text = f"regexp_replace({text}, {quoted(pattern)}, {quoted(replacement)}, 'g')"
        return f"list_transform(string_split({text}, chr(10)), lambda x: trim(x))"

    whole = "array_to_string(list_filter(ls, lambda x: x <> ''), ' ')"
    return f"""WITH k AS (SELECT sha256({whole}) AS digest, min(licence) AS licence FROM (SELECT licence, {lines('said')} AS ls FROM (VALUES {", ".join(f"({quoted(n)}, {quoted(t)})" for n, t in known)}) AS v(licence, said)) GROUP BY 1),
l AS (SELECT doc_id, {lines("text")} AS ls FROM documents),
u AS (SELECT doc_id, 'text' AS scope, NULL::INT AS line, {whole} AS said FROM l
      UNION ALL SELECT doc_id, 'line', i::INT, ls[i + 1] FROM (SELECT doc_id, ls, unnest(range(len(ls))) AS i FROM l WHERE len(ls) > 1))
SELECT doc_id, scope, line, licence, digest FROM (SELECT *, sha256(said) AS digest FROM u WHERE said <> '') JOIN k USING (digest)"""


@register("op5_license_scan", _license_sql())
def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.find_licences(table(spark, sf_dir, "documents"))


@register("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened_embeddings(table(spark, sf_dir, "embeddings"))


def _said(column: str) -> str:
    return f"coalesce(strlen({column}::VARCHAR)::VARCHAR || ':' || {column}::VARCHAR, '-')"


_LEAF = f"sha256({_said('doc_id')} || {_said('source')} || {_said('lang')} || {{n}} || {_said('text')})"
_MANIFEST_SQL = f"""
WITH RECURSIVE b AS (SELECT doc_id, coalesce('=' || lang, '') AS grp, {_LEAF.format(n=_said('n_chars'))} AS leaf, {_LEAF.format(n=_said('(n_chars + 1)'))} AS changed,
  xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(doc_id::VARCHAR)), '..'), lambda h: ('0x' || h)::BIGINT)),
      lambda c, v: xor(c >> 8, {_crc_table()}[(xor(c, v) & 255) + 1]))) AS crc FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS m FROM b),
low AS (SELECT 0 AS level, grp, pos, m, leaf AS digest FROM placed
  UNION ALL SELECT level + 1, grp, pos // 2, max((m + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM low WHERE m > 1 GROUP BY level, grp, pos // 2),
tops AS (SELECT grp, digest, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS m FROM low WHERE m = 1),
high AS (SELECT 0 AS level, pos, m, digest FROM tops
  UNION ALL SELECT level + 1, pos // 2, max((m + 1) // 2), sha256(string_agg(digest, '' ORDER BY pos)) FROM high WHERE m > 1 GROUP BY level, pos // 2),
path AS (SELECT 0 AS level, doc_id, leaf, grp, pos, m, '' AS proof, CASE WHEN crc % 7 = 0 THEN changed ELSE leaf END AS folded FROM placed
  UNION ALL SELECT p.level + 1, p.doc_id, p.leaf, p.grp, p.pos // 2, (p.m + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.digest, '') ELSE s.digest || p.folded END)
  FROM path p LEFT JOIN low s ON s.grp = p.grp AND s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.m > 1),
ended AS (SELECT doc_id, leaf, tops.digest AS subroot, tops.pos, tops.m, proof, folded FROM path JOIN tops USING (grp) WHERE path.m = 1),
rest AS (SELECT 0 AS level, * FROM ended
  UNION ALL SELECT p.level + 1, p.doc_id, p.leaf, p.subroot, p.pos // 2, (p.m + 1) // 2, p.proof || coalesce(s.digest, ''),
    sha256(CASE WHEN p.pos % 2 = 0 THEN p.folded || coalesce(s.digest, '') ELSE s.digest || p.folded END)
  FROM rest p LEFT JOIN high s ON s.level = p.level AND s.pos = xor(p.pos, 1) WHERE p.m > 1)
SELECT doc_id, leaf, subroot, high.digest AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = high.digest AS verified FROM rest, high WHERE rest.m = 1 AND high.m = 1"""


@register("op13_merkle_manifest", _MANIFEST_SQL)
def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(table(spark, sf_dir, "documents"))


@register("op11_suffix_dedup")
def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(suffix_dedup.repeated_bytes(table(spark, sf_dir, "documents")))
