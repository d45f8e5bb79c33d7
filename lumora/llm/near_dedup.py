"""Near duplicates by DartMinHash: weighted signatures of word shingles, banded, checked exactly, joined to classes."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lumora.llm.shared import fresh, id_and_text, words_of, written

#: Words of a shingle, and the weighted Jaccard similarity from which two texts are near duplicates.
SHINGLE, SIMILARITY = 5, 0.8
#: Bands and coordinates per band: of texts at the threshold a share of (1 - 0.8^6)^40 = 5e-6 meets in no band.
BANDS, ROWS = 40, 6
BATCH_WORDS = 1 << 17

_U = np.uint64
#: Odd multipliers of the hash functions.
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=_U)


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input changes about half of the output."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(words: list[bytes], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles, sorted, and how often each occurs. Fewer words than `size` are one shingle."""
    if not words:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    hashed = np.array([xxhash.xxh3_64_intdigest(w) for w in words], dtype=_U)
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, _U)
    for k in range(width):
        total = _mix(total * _MULTIPLIERS[0] + hashed[k : len(words) - width + 1 + k])
    return np.unique(total, return_counts=True)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two texts' shingle counts."""
    _, at_a, at_b = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    common = int(np.minimum(a[1][at_a], b[1][at_b]).sum())
    union = int(a[1].sum() + b[1].sum()) - common
    return common / union if union else 0.0


def signatures(documents: list[tuple[np.ndarray, np.ndarray]], k: int) -> np.ndarray:
    """A row of `k` coordinates per document; equal coordinates have the documents' weighted Jaccard similarity as probability.

    The region of an element of weight w is a strip of w unit cells along the rank axis. Hashed darts fall on every cell
    as a Poisson process of rank (sums of exponential gaps), the same for all documents; a document keeps the darts
    below the rank at which about k ln k + 2k are expected, each dart belongs to one coordinate, and the earliest dart of a
    coordinate is its value. Where a coordinate got no dart, the document is thrown again up to twice the rank.
    """
    out = np.full((len(documents), k), np.inf)
    limit = np.array([(k * math.log(max(k, 2)) + 2 * k) / max(int(weights.sum()), 1) for _, weights in documents])
    todo = np.arange(len(documents))
    while len(todo):
        cells, owner = [], []
        for d in todo:
            elements, weights = documents[d]
            if len(elements) and weights.max() > 1:
                copies = np.arange(weights.sum()) - np.repeat(np.cumsum(weights) - weights, weights)
                elements = _mix(np.repeat(elements, weights) + copies.astype(_U) * _MULTIPLIERS[1])
            else:  # the first copy of an element is the same cell whether or not others follow
                elements = _mix(elements)
            cells.append(elements)
            owner.append(np.full(len(elements), d))
        _throw(np.concatenate(cells), np.concatenate(owner), limit, out)
        todo = todo[np.isinf(out[todo]).any(axis=1) & np.array([len(documents[d][0]) > 0 for d in todo])]
        limit[todo] *= 2
    return out


def _throw(cells: np.ndarray, owner: np.ndarray, limit: np.ndarray, out: np.ndarray, width: int = 4) -> None:
    """All darts of these cells below their document's limit: keep the earliest per coordinate in `out`."""
    k = out.shape[1]
    rank, number = np.zeros(len(cells)), 0
    while len(cells):
        seeds = _mix(cells[:, None] + np.arange(number + 1, number + width + 1, dtype=_U)[None, :] * _MULTIPLIERS[2])
        gaps = -np.log(((seeds >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53)
        ranks = rank[:, None] + np.cumsum(gaps, axis=1)
        hit = ranks <= limit[owner][:, None]
        coordinates = (_mix(seeds[hit] ^ _MULTIPLIERS[3]) % _U(k)).astype(np.int64)
        owners = np.broadcast_to(owner[:, None], hit.shape)[hit]
        np.minimum.at(out.reshape(-1), owners * k + coordinates, ranks[hit])
        live = hit[:, -1]
        cells, owner, rank, number = cells[live], owner[live], ranks[live, -1], number + width


def band_keys(signature: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per band and document."""
    values = np.ascontiguousarray(signature).view(_U).reshape(len(signature), bands, rows)
    total = np.broadcast_to(np.arange(1, bands + 1, dtype=_U)[None, :], values.shape[:2])
    for k in range(rows):
        total = _mix(total * _MULTIPLIERS[4] + values[:, :, k])
    return total.view(np.int64)


def _signed(docs: DataFrame) -> DataFrame:
    """(doc_id, print, bands) of rows with words: a 128-bit print of the words in order, and the keys of all bands."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("print", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType(), False))])

    def made(ids: list, found: list[tuple[bytes, tuple[np.ndarray, np.ndarray]]], kind: pa.DataType) -> pa.RecordBatch:
        keys = band_keys(signatures([s for _, s in found], BANDS * ROWS))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(found) + 1) * BANDS, pa.int32()), pa.array(keys.reshape(-1)))
        return pa.RecordBatch.from_arrays([pa.array(ids, kind), pa.array([p for p, _ in found], pa.binary()), lists], names=["doc_id", "print", "bands"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found, size = [], [], 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = words_of((text.as_py() or "").encode())
                if words:
                    ids.append(doc_id.as_py())
                    found.append((hashlib.blake2b(b" ".join(words), digest_size=16).digest(), shingles(words)))
                    size += len(words)
                if size > BATCH_WORDS:
                    yield made(ids, found, batch.schema.field(0).type)
                    ids, found, size = [], [], 0
            if found:
                yield made(ids, found, batch.schema.field(0).type)

    return docs.mapInArrow(work, schema)


@lru_cache(maxsize=64)
def _remembered(text: str) -> tuple[np.ndarray, np.ndarray]:
    return shingles(words_of(text.encode()))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose texts are at least that similar."""
    left = texts.withColumnsRenamed({"node": "a", "text": "text_a"})
    right = texts.withColumnsRenamed({"node": "b", "text": "text_b"})
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            mask = [similarity(_remembered(a.as_py()), _remembered(b.as_py())) >= least for a, b in zip(batch.column(2), batch.column(3))]
            yield batch.select(["a", "b"]).filter(pa.array(mask, pa.bool_()))

    return both.mapInArrow(work, pairs.select("a", "b").schema)


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of each connected component, for every node of an edge (a, b).

    Each round links every node's larger neighbours, then its smaller ones, to its least neighbour, until all edges
    lead to roots. A round is partial minima and joins on a node; rounds grow with the logarithm of a component's width.
    """
    def turned(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct()

    def large_star(df: DataFrame) -> DataFrame:
        around = df.union(df.select("b", "a")).toDF("u", "v")
        least = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return around.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))

    def small_star(df: DataFrame) -> DataFrame:
        least = df.groupBy("a").agg(F.min("b").alias("m"))
        linked = df.join(least, "a")
        return linked.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))

    edges, state = written(turned(edges), "edges"), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 30)))).first()
        if now == state or not now[0]:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
        edges = written(turned(small_star(turned(large_star(edges)))), "edges")


def _rooted(df: DataFrame, column: str, roots: DataFrame, name: str) -> DataFrame:
    """Add the root of the node in `column`; a node without edges is its own."""
    found = roots.select(F.col("node").alias(column), F.col("root").alias(name))
    return df.join(found, column, "left").withColumn(name, F.coalesce(name, column))


#: Parts into which the hashes of shingles are dealt for the bounds; a power of two.
PARTS = 32


def _shares(texts: DataFrame) -> DataFrame:
    """(node, total, shared, parts): weight of a text's shingles, and of those that some other node has as well, in all and per part.

    Two texts have at most the smaller `shared` in common, and at most the sum of the smaller values over all parts.
    """
    node = texts.schema["node"]
    each = T.StructType([node, T.StructField("shingle", T.LongType()), T.StructField("weight", T.LongType())])
    dealt = T.StructType([node, T.StructField("total", T.LongType()), T.StructField("all_parts", T.ArrayType(T.LongType(), False))])

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, text in enumerate(batch.column(1)):
                elements, weights = shingles(words_of(text.as_py().encode()))
                owner = batch.column(0).slice(k, 1).take(pa.array(np.zeros(len(elements), np.int64)))
                yield pa.RecordBatch.from_arrays([owner, pa.array(elements.view(np.int64)), pa.array(weights)], names=each.names)

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for text in batch.column(1):
                elements, weights = shingles(words_of(text.as_py().encode()))
                parts.append(np.bincount((elements % _U(PARTS)).astype(np.int64), weights, PARTS).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([int(p.sum()) for p in parts], pa.int64()), pa.array(parts, pa.list_(pa.int64()))], names=dealt.names)

    owned = texts.mapInArrow(spread, each).groupBy("shingle").agg(F.min("node").alias("node"), F.max("node").alias("top"), F.max("weight").alias("weight"))
    part = F.col("shingle").bitwiseAND(F.lit(PARTS - 1)).cast("int").alias("part")  # of a signed hash the last bits are the same
    own = owned.where("node = top").groupBy("node", part).agg(F.sum("weight").alias("weight"))
    own = own.groupBy("node").agg(F.map_from_entries(F.collect_list(F.struct("part", "weight"))).alias("own"))
    single = texts.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").select("node")  # an id with several texts gets the wider bound
    less = F.transform("all_parts", lambda v, k: v - F.coalesce(F.element_at("own", k), F.lit(0)))
    parts = F.when(F.col("own").isNull(), F.col("all_parts")).otherwise(less)
    made = texts.mapInArrow(summed, dealt).join(own.join(single, "node"), "node", "left").select("node", "total", parts.alias("parts"))
    return made.withColumn("shared", F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x))


def _possible(shared_a: str, total_a: str, shared_b: str, total_b: str, least: float) -> Column:
    """Whether two nodes can be that similar, by what each shares with any other."""
    common = F.least(shared_a, shared_b)
    return common >= least * (F.col(total_a) + F.col(total_b) - common)


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """One row per input row: doc_id, and class_id, the least id of its class.

    Words are lower-cased runs of letters and digits, elements are shingles of five words (shorter texts are one shingle),
    weighted by how often they occur. Texts of equal words are copies: they become one node, named by their least id, so a
    group of copies costs partial minima only. In each band the nodes of one key are linked to one centre, not to each
    other: to the node that shares the largest part of its shingles with others, as the common source of edited copies does.
    Links are checked on whole texts. Where nodes of a bucket still belong to several classes, the pairs between these
    classes are checked as well, in the first band in which they meet, unless the shingles that each shares with any other
    rule them out. So no link is lost to the choice of a centre, and nothing is capped.
    Texts without words (null, empty) are classes of their own. Rows of one id are one document, and an id with several
    texts joins their classes. Rows without id have no class (null).
    """
    docs = id_and_text(docs, id_col, text_col)
    known = docs.where("doc_id IS NOT NULL")
    signed = written(_signed(known), "signed")
    nodes = written(signed.groupBy("print").agg(F.min("doc_id").alias("node"), F.any_value("bands").alias("bands")), "nodes")
    copies = signed.join(nodes.select("print", "node"), "print").select("doc_id", "node")
    named = written(copies.groupBy("doc_id").agg(F.min("node").alias("node"), F.max("node").alias("top")), "named")
    several = named.where("node < top").select("doc_id", F.col("node").alias("a"))
    same_id = several.join(copies, "doc_id").select("a", F.col("node").alias("b"))

    placed = nodes.select("node", F.explode_outer("bands").alias("band"))
    met = placed.groupBy("band").agg(F.min("node").alias("low"), F.max("node").alias("high")).where("low < high").select("band")
    members = written(placed.join(met, "band"), "members")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    texts = written(known.join(wanted, "doc_id", "left_semi").where("text IS NOT NULL").toDF("node", "text").distinct(), "texts")
    shares = written(_shares(texts), "shares")
    members = written(members.join(shares.drop("parts"), "node"), "members")

    centres = members.groupBy("band").agg(F.min(F.struct((-F.col("shared") / F.col("total")).alias("s"), "node", "total", "shared")).alias("hub"))
    starred = members.join(centres, "band").select(F.col("hub.node").alias("a"), F.col("node").alias("b"), "total", "shared", F.col("hub.total").alias("total_a"), F.col("hub.shared").alias("shared_a"))
    links = starred.where((F.col("a") != F.col("b")) & _possible("shared", "total", "shared_a", "total_a", least)).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    edges = written(_verified(links, texts, least), "edges")

    rooted = _rooted(members, "node", components(edges), "root")
    unsure = rooted.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("total").alias("lightest")).where("low < high").drop("low", "high")
    best = F.col("shared") >= least * (F.greatest("lightest", "shared") + F.col("total") - F.col("shared"))
    rest = written(rooted.join(unsure, "band").where(best).select("band", "node", "root", "total", "shared"), "rest")
    details = nodes.select("node", "bands").join(rest.select("node").distinct(), "node").join(shares.select("node", "parts"), "node")
    rest = written(rest.join(details, "node"), "rest")
    left, right = (rest.select("band", *[F.col(c).alias(f"{c}_{x}") for c in ("node", "root", "total", "shared", "bands", "parts")]) for x in "ab")
    first = F.get(F.array_intersect("bands_a", "bands_b"), F.lit(0)) == F.col("band")
    common = F.aggregate(F.zip_with("parts_a", "parts_b", lambda x, y: F.least(x, y)), F.lit(0).cast("long"), lambda n, x: n + x)
    close = (1 + least) * common + 1e-6 >= least * (F.col("total_a") + F.col("total_b"))
    between = (F.col("root_a") != F.col("root_b")) & (F.col("node_a") < F.col("node_b"))
    pairs = left.join(right, "band").where(between & _possible("shared_a", "total_a", "shared_b", "total_b", least) & first & close)
    pairs = pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()
    final = components(edges.union(_verified(pairs, texts, least)).union(same_id))

    classes = _rooted(named.select("doc_id", "node"), "node", final, "class_id").select("doc_id", "class_id")
    return docs.select("doc_id").join(classes, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def keep_one_per_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = SIMILARITY) -> DataFrame:
    """The rows of `docs`, with their columns, whose id is the least of its class; of rows of one id one. Rows without id stay."""
    key = fresh(docs, "_kept")
    heads = near_duplicate_classes(docs.where(F.col(f"`{id_col}`").isNotNull()), id_col, text_col, least).where("doc_id = class_id").select(F.col("doc_id").alias(key)).distinct()
    known = docs.join(heads, F.col(f"`{id_col}`") == F.col(key)).dropDuplicates([key]).drop(key)
    return known.unionByName(docs.where(F.col(f"`{id_col}`").isNull()))
