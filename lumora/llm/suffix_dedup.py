"""Removal of repeated passages, byte by byte, by suffix arrays over shards.

A byte goes if a string of WINDOW bytes that covers it also starts in a document with a smaller id. Equal strings have the
same least hash among their 16-byte parts, the anchor. Shards of texts first tell, by 32 bits per anchor, which anchors
occur more than once. Only stretches of strings with such an anchor become pieces; each shard sends a piece once, packed
with others for the task of its anchor. A task joins equal pieces and sorts all suffixes of what is left by induced
sorting; neighbours whose common prefix is as long as a window are one class, and the least id of each class goes
back to the shards.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from lumora.llm.shared import id_and_text, scratch
from lumora.llm.suffix_array import permuted_prefixes, suffix_array

#: Bytes of a string that may not repeat, and of the parts of it that are hashed.
WINDOW, PART = 50, 16
#: Starts of consecutive windows with one anchor: a piece has at most so many.
RUN = WINDOW - PART + 1
PIECE = WINDOW + RUN - 1
#: Bytes of text in a shard, of pieces in one suffix array, of shards in a bucket, and anchors told apart in one task.
SHARD_BYTES, ARRAY_BYTES, BUCKET_BYTES, ANCHORS = 4 << 20, 8 << 20, 24 << 20, 1 << 20
#: Windows whose anchors are found at once: few enough for a core's own cache.
BLOCK = 1 << 15
#: Stands for a null id, which comes before all others.
NO_ID = -(1 << 63)
#: Between pieces; no byte of UTF-8.
GAP = 255

_U = np.uint64


def _words(buffer: np.ndarray, count: int) -> np.ndarray:
    """The eight bytes from each place on as a number."""
    return np.ndarray(count, dtype="<u8", buffer=buffer.data, strides=(1,))


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of `width` consecutive values, from each place on."""
    n = 1
    while 2 * n <= width:
        values = np.minimum(values[:-n], values[n:])
        n *= 2
    return np.minimum(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def _ragged(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0]+1, …, counts[0] of them, then those of the next."""
    return np.repeat(first - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())


def runs(text: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor, inside one text each: first window, number of windows (at most RUN), anchor."""
    n = len(text) - WINDOW + 1
    if n < 1:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, _U)
    words = _words(np.concatenate([text, np.zeros(16, np.uint8)]), len(text) - 7)
    anchor = np.empty(n, _U)
    for low in range(0, n, BLOCK):
        parts = min(BLOCK, n - low) + RUN - 1
        near = words[low : low + parts + 8].copy()
        h = near[:parts] * _U(0x9E3779B97F4A7C15)
        h ^= h >> _U(32)
        h += near[8:]
        h *= _U(0xD6E8FEB86659FD93)
        h ^= h >> _U(29)
        h *= _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(32)
        anchor[low : low + BLOCK] = _least(h, RUN)
    begins = np.ones(n, bool)
    begins[1:] = anchor[1:] != anchor[:-1]
    # windows that reach over the end of their text; a text of fewer bytes has none at all
    lows = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    marks = np.zeros(n + 1, np.int32)
    np.add.at(marks, np.minimum(np.maximum(lows, ends - WINDOW + 1), n), 1)
    np.add.at(marks, np.minimum(ends, n), -1)
    valid = np.cumsum(marks[:n]) == 0
    begins[np.minimum(lows[lows < n], n - 1)] = True
    begins[1:] |= valid[1:] != valid[:-1]
    first = np.flatnonzero(begins)
    count = np.diff(first, append=n)
    keep = valid[first]
    first, count = first[keep], count[keep]
    if count.max(initial=0) > RUN:  # equal hashes side by side: the text repeats itself
        parts = -(-count // RUN)
        of = np.repeat(np.arange(len(first)), parts)
        k = np.arange(len(of)) - np.repeat(np.cumsum(parts) - parts, parts)
        first, count = first[of] + k * RUN, np.minimum(RUN, count[of] - k * RUN)
    return first, count, anchor[first]


def shard_texts(docs: DataFrame) -> tuple[DataFrame, int]:
    """(shard, ids, ends, text): texts of a few megabytes side by side in a row, written in buckets by shard; and their bytes.

    `docs` has (doc_id, text). Later stages join small tables to the shards without moving texts again.
    """
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, ids, parts, size = TaskContext.get().partitionId() << 32, [], [], 0

        def row() -> pa.RecordBatch:
            ends = np.cumsum([len(p) for p in parts], dtype=np.int64)
            return pa.record_batch({"shard": [number], "ids": [np.array(ids, np.int64).tobytes()], "ends": [ends.tobytes()], "text": pa.array([b"".join(parts)], pa.binary())})

        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                ids.append(NO_ID if i is None else i)
                parts.append(text or b"")
                size += len(parts[-1])
                if size >= SHARD_BYTES:
                    yield row()
                    number, ids, parts, size = number + 1, [], [], 0
        if ids:
            yield row()

    spark = docs.sparkSession
    packed = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(pack, "shard long, ids binary, ends binary, text binary")
    name = f"lumora_shards_{uuid.uuid4().hex}"
    buckets = min(20_000, max(12, total // BUCKET_BYTES))
    packed.write.bucketBy(buckets, "shard").option("path", scratch(spark, "shards")).option("compression", "zstd").saveAsTable(name)
    shards = spark.table(name)
    shards.schema  # noqa: B018  the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return shards, total


def _shard(row: pa.Table) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    of = lambda name, kind: np.frombuffer(row.column(name)[0].as_py(), kind)
    return row.column("shard")[0].as_py(), of("ids", np.int64), of("ends", np.int64), of("text", np.uint8)


def repeated_anchors(shards: DataFrame, total: int) -> DataFrame:
    """(shard, anchors): which anchors of a shard may occur in another one too. 32 bits tell anchors of one bucket apart;
    that some unlike ones agree only costs work later."""
    buckets = max(24, total // 18 // ANCHORS)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                shard, _, ends, text = _shard(pa.Table.from_batches([batch.slice(k, 1)]))
                seen = np.unique(_short(runs(text, ends)[2], buckets))
                of = (seen >> _U(32)).astype(np.int64)
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                blobs = [p.astype(np.uint32).tobytes() for p in np.split(seen, cuts[1:])] if len(seen) else []
                yield pa.record_batch({"bucket": pa.array(of[cuts], pa.int64()), "shard": pa.array([shard] * len(blobs), pa.int64()), "anchors": pa.array(blobs, pa.binary())})

    def meet(rows: pa.Table) -> pa.Table:
        lists = [np.frombuffer(b, np.uint32) for b in rows.column("anchors").to_pylist()]
        every = np.sort(np.concatenate(lists))
        twice = every[1:][every[1:] == every[:-1]]
        kept = [p[_among(twice, p)] for p in lists]
        there = [k for k, p in enumerate(kept) if len(p)]
        high = _U(rows.column("bucket")[0].as_py()) << _U(32)
        blobs = [(kept[k].astype(_U) | high).tobytes() for k in there]
        return pa.table({"shard": rows.column("shard").take(pa.array(there, pa.int64())), "anchors": pa.array(blobs, pa.binary())})

    told = shards.mapInArrow(tell, "bucket long, shard long, anchors binary")
    return told.groupBy("bucket").applyInArrow(meet, "shard long, anchors binary")


def _among(known: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each value is in the sorted list."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _short(anchor: np.ndarray, buckets: int) -> np.ndarray:
    return ((anchor >> _U(32)) % _U(buckets)) << _U(32) | (anchor & _U(0xFFFFFFFF))


def _prints(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64 bits of every piece, at most 88 bytes long; `raw` goes on for 88 bytes behind the last one."""
    rows = np.lib.stride_tricks.sliding_window_view(raw, 88)[begins]
    rows *= np.arange(88) < sizes[:, None]
    mixed = sizes.astype(_U) * _U(0xC2B2AE3D27D4EB4F)
    for w in range(11):
        mixed = (mixed ^ rows[:, 8 * w : 8 * w + 8].copy().view("<u8")[:, 0]) * _U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U(31)
    return mixed


def _groups(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination of values begins, in sorted columns."""
    begins = np.zeros(len(columns[0]), bool)
    begins[:1] = True
    for c in columns:
        begins[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(begins)


def _packed(*arrays: np.ndarray) -> bytes:
    whole = b"".join(np.ascontiguousarray(x).tobytes() for x in arrays)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, codec="zstd", asbytes=True)


def _unpacked(blob: bytes) -> bytes:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)


#: Pieces for a task to sort, or, with `places`, where the pieces of a shard are, which the task hands on.
_PIECES = "task int, shard long, places boolean, count int, blob binary"


def pieces(shards: DataFrame, repeated: DataFrame, total: int) -> DataFrame:
    """The distinct pieces of each shard with the least and largest id that has them, packed by the task that sorts them;
    and one row per shard that tells where its pieces are."""
    buckets = max(24, total // 18 // ANCHORS)
    tasks = max(24, total // ARRAY_BYTES)

    def cut(row: pa.Table, told: pa.Table) -> pa.Table:
        out: dict[str, list] = {"task": [], "shard": [], "places": [], "count": [], "blob": []}
        kinds = {"task": pa.int32(), "shard": pa.int64(), "places": pa.bool_(), "count": pa.int32(), "blob": pa.binary()}
        if row.num_rows:
            shard, ids, ends, text = _shard(row)
            first, count, anchor = runs(text, ends)
            elsewhere = np.sort(np.concatenate([np.zeros(0, _U), *[np.frombuffer(b, _U) for b in told.column("anchors").to_pylist()]]))
            chosen = _among(elsewhere, _short(anchor, buckets))
            own = ids[np.searchsorted(ends, first, side="right")]
            order = np.argsort(anchor, kind="stable")
            group = _groups(anchor[order])
            if len(group):
                unlike = np.minimum.reduceat(own[order], group) < np.maximum.reduceat(own[order], group)
                chosen[order] |= np.repeat(unlike, np.diff(group, append=len(order)))
            first, count, anchor, own = first[chosen], count[chosen], anchor[chosen], own[chosen]
            sizes = count + WINDOW - 1
            padded = np.concatenate([text, np.zeros(96, np.uint8)])
            prints = _prints(padded, first, sizes)
            task = ((anchor * _U(0xA0761D6478BD642F)) >> _U(40)).astype(np.int64) % tasks
            order = np.lexsort((prints, anchor, task))
            group = _groups(task[order], anchor[order], prints[order])
            number = np.empty(len(order), np.int32)
            number[order] = np.repeat(np.arange(len(group), dtype=np.int32), np.diff(group, append=len(order)))
            lead = order[group]
            least = np.minimum.reduceat(own[order], group) if len(group) else own
            most = np.maximum.reduceat(own[order], group) if len(group) else own
            cuts = np.append(_groups(task[lead]), len(lead))
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                at = lead[x:y]
                raw = padded[_ragged(first[at], sizes[at])]
                out["task"].append(int(task[at[0]]))
                out["count"].append(y - x)
                out["blob"].append(_packed(anchor[at], least[x:y], most[x:y], np.arange(x, y, dtype=np.int32), sizes[at].astype(np.uint8), raw))
            out["places"] = [False] * len(out["task"]) + [True]
            out["task"].append(shard % tasks)
            out["count"].append(len(first))
            out["blob"].append(_packed(first.astype(np.int32), number, count.astype(np.uint8)))
            out["shard"] = [shard] * len(out["task"])
        return pa.table({n: pa.array(v, kinds[n]) for n, v in out.items()})

    return shards.groupBy("shard").cogroup(repeated.groupBy("shard")).applyInArrow(cut, _PIECES)


def window_classes(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, least: np.ndarray) -> np.ndarray:
    """For every window of every piece, in order, the least id among all pieces that hold the same window.

    `text` has the pieces with GAP behind each; piece k begins at `begins[k]` and has `counts[k]` windows. A window whose
    print no other has is like no other. Only stretches of the remaining ones get into the suffix array.
    """
    starts = _ragged(begins, counts)
    out = np.repeat(least, counts)
    prints = _window_prints(text, starts)
    order = np.argsort(prints)
    twice = np.flatnonzero(prints[order[1:]] == prints[order[:-1]])
    shared = np.zeros(len(starts), bool)
    shared[order[twice]] = shared[order[twice + 1]] = True
    if not len(twice):
        return out
    opens, closes, offset = shared.copy(), shared.copy(), np.cumsum(counts) - counts
    opens[1:] &= ~shared[:-1]
    opens[offset] = shared[offset]
    closes[:-1] &= ~shared[1:]
    closes[offset + counts - 1] = shared[offset + counts - 1]
    at = np.flatnonzero(opens)
    many = np.flatnonzero(closes) + 1 - at
    sizes = many + WINDOW - 1
    begin = np.cumsum(sizes + 1) - (sizes + 1)
    stretches = np.full(int((sizes + 1).sum()), GAP, np.uint8)
    stretches[_ragged(begin, sizes)] = text[_ragged(starts[at], sizes)]
    out[shared] = _sorted_classes(stretches, begin, many, out[shared])
    return out


def _window_prints(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64 bits of the window at each place."""
    words = _words(np.concatenate([text, np.zeros(8, np.uint8)]), len(text))
    mixed = np.zeros(len(starts), _U)
    for k in (*range(0, WINDOW - 7, 8), WINDOW - 8):
        mixed = (mixed ^ words[starts + k]) * _U(0x9E3779B97F4A7C15)
        mixed ^= mixed >> _U(31)
    return mixed


def _sorted_classes(text: np.ndarray, begins: np.ndarray, counts: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The same by a suffix array, with an id for each window instead of each piece."""
    sa = suffix_array(text, 256)
    shared = permuted_prefixes(text, sa, begins, PIECE + WINDOW)
    starts = _ragged(begins, counts)
    number = np.full(len(text), -1, np.int32)
    number[starts] = np.arange(len(starts), dtype=np.int32)
    # neighbours with a common prefix of a window are in one class, whether or not their first bytes are a window
    cls = np.cumsum(shared[sa] < WINDOW, dtype=np.int32)
    order = number[sa]
    cls, order = cls[order >= 0], order[order >= 0]
    group = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
    out = np.empty(len(starts), np.int64)
    out[order] = np.repeat(np.minimum.reduceat(own[order], group), np.diff(group, append=len(order)))
    return out


_FOUND = "shard long, places boolean, count int, blob binary"


def _classes_of(raw: np.ndarray, begins: np.ndarray, sizes: np.ndarray, anchor: np.ndarray, least: np.ndarray) -> np.ndarray:
    """The least id of every window of distinct pieces, which are sorted by anchor, by suffix arrays of bounded size.

    Windows of unlike anchors are unlike: a piece alone with its anchor keeps its own id and is not sorted. Arrays are
    cut between anchors. An anchor with more text than an array holds is cut between single windows instead,
    ordered by their own hash: equal windows stay together.
    """
    counts = sizes - WINDOW + 1
    offset = np.cumsum(counts) - counts
    found = np.repeat(least, counts)
    edges = _groups(anchor)
    fellows = np.diff(edges, append=len(anchor))
    several = np.repeat(fellows > 1, fellows)
    begins, sizes, anchor, least, counts, offset = (x[several] for x in (begins, sizes, anchor, least, counts, offset))

    def sort(begin: np.ndarray, size: np.ndarray, own: np.ndarray, to: np.ndarray) -> None:
        starts = np.cumsum(size + 1) - (size + 1)
        text = np.full(int((size + 1).sum()), GAP, np.uint8)
        text[_ragged(starts, size)] = raw[_ragged(begin, size)]
        found[_ragged(to, size - WINDOW + 1)] = window_classes(text, starts, size - WINDOW + 1, own)

    def parts(key: np.ndarray, size: np.ndarray) -> Iterator[slice]:
        edges = np.append(_groups(key), len(key))
        filled = np.append(0, np.cumsum(size))[edges]
        low = 0
        while low < len(edges) - 1:
            high = max(low + 1, int(np.searchsorted(filled, filled[low] + ARRAY_BYTES, side="right")) - 1)
            yield slice(int(edges[low]), int(edges[high]))
            low = high

    for part in parts(anchor, sizes):
        if sizes[part].sum() <= 2 * ARRAY_BYTES:
            sort(begins[part], sizes[part], least[part], offset[part])
            continue
        alone = counts[part]
        begin, to, own = _ragged(begins[part], alone), _ragged(offset[part], alone), np.repeat(least[part], alone)
        prints = _prints(np.concatenate([raw, np.zeros(88, np.uint8)]), begin, np.full(len(begin), WINDOW))
        order = np.argsort(prints, kind="stable")
        for some in parts(prints[order], np.full(len(order), WINDOW)):
            at = order[some]
            sort(begin[at], np.full(len(at), WINDOW), own[at], to[at])
    return found


def sort_pieces(cut: DataFrame) -> DataFrame:
    """Least ids of the windows of all pieces that some larger id of the shard has too, as runs, packed by shard.

    All pieces of an anchor are in one task; pieces of several shards that are equal are joined before they are sorted.
    Rows that tell where pieces are go on as they are.
    """

    def handled(rows: pa.Table) -> pa.Table:
        places = rows.filter(rows.column("places")).select(["shard", "places", "count", "blob"])
        work = rows.filter(pa.compute.invert(rows.column("places")))
        return pa.concat_tables([places, sort(work)]) if work.num_rows else places

    def sort(rows: pa.Table) -> pa.Table:
        shard, count, blobs = (rows.column(n).to_pylist() for n in ("shard", "count", "blob"))
        parts: list[list[np.ndarray]] = []
        for n, blob in zip(count, blobs):
            whole, at, own = _unpacked(blob), 0, []
            for kind in (_U, np.int64, np.int64, np.int32, np.uint8):
                own.append(np.frombuffer(whole, kind, n, at))
                at += n * np.dtype(kind).itemsize
            parts.append([*own, np.frombuffer(whole, np.uint8, offset=at)])
        anchor, least, most, number, sizes, raw = (np.concatenate(x) for x in zip(*parts))
        del parts
        sizes = sizes.astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        raw = np.concatenate([raw, np.zeros(88, np.uint8)])
        prints = _prints(raw, begins, sizes)
        order = np.lexsort((prints, anchor))
        group = _groups(anchor[order], prints[order])
        lead = order[group]
        which = np.empty(len(order), np.int64)
        which[order] = np.repeat(np.arange(len(group)), np.diff(group, append=len(order)))
        found = _classes_of(raw, begins[lead], sizes[lead], anchor[lead], np.minimum.reduceat(least[order], group))
        counts = sizes[lead] - WINDOW + 1
        offset = np.cumsum(counts) - counts
        told = np.minimum.reduceat(found, offset)[which] < most
        # runs of equal ids within a piece
        edges = np.zeros(len(found), bool)
        edges[1:] = found[1:] != found[:-1]
        edges[offset] = True
        at = np.flatnonzero(edges)
        low = np.searchsorted(at, offset)
        many = np.diff(low, append=len(at))
        froms = (at - np.repeat(offset, many)).astype(np.uint8)
        ids = found[at]
        out_shard, out_count, out_blob, low_row = [], [], [], 0
        for name, n in zip(shard, count):
            rows_of = low_row + np.flatnonzero(told[low_row : low_row + n])
            low_row += n
            if len(rows_of):
                w = which[rows_of]
                take = _ragged(low[w], many[w])
                out_shard.append(name)
                out_count.append(len(rows_of))
                out_blob.append(_packed(number[rows_of], many[w].astype(np.uint8), ids[take], froms[take]))
        return pa.table({"shard": pa.array(out_shard, pa.int64()), "places": pa.array([False] * len(out_shard), pa.bool_()), "count": pa.array(out_count, pa.int32()), "blob": pa.array(out_blob, pa.binary())})

    return cut.groupBy("task").applyInArrow(handled, _FOUND)


def covered_bytes(text: np.ndarray, ends: np.ndarray, ids: np.ndarray, where: tuple[int, bytes], told: list[tuple[int, bytes]]) -> np.ndarray:
    """Which bytes of a shard go. `where` has first window, piece number and number of windows of every occurrence,
    `told` the runs of least ids of pieces."""
    n, blob = where
    whole = _unpacked(blob)
    first = np.frombuffer(whole, np.int32, n).astype(np.int64)
    number, counts = np.frombuffer(whole, np.int32, n, 4 * n), np.frombuffer(whole, np.uint8, n, 8 * n).astype(np.int64)
    length = np.zeros(int(number.max(initial=-1)) + 1, np.int64)
    length[number] = counts
    offset = np.cumsum(length) - length
    least = np.full(int(length.sum()), np.iinfo(np.int64).max)
    for n, blob in told:
        whole = _unpacked(blob)
        piece, many = np.frombuffer(whole, np.int32, n), np.frombuffer(whole, np.uint8, n, 4 * n).astype(np.int64)
        total = int(many.sum())
        own, froms = np.frombuffer(whole, np.int64, total, 5 * n), np.frombuffer(whole, np.uint8, total, 5 * n + 8 * total).astype(np.int64)
        stops = np.append(froms[1:], 0)
        stops[np.cumsum(many) - 1] = length[piece]
        least[_ragged(np.repeat(offset[piece], many) + froms, stops - froms)] = np.repeat(own, stops - froms)
    starts = _ragged(first, counts)
    owner = np.repeat(ids[np.searchsorted(ends, first, side="right")], counts)
    gone = starts[least[_ragged(offset[number], counts)] < owner]
    marks = np.zeros(len(text), np.int32)
    marks[gone] = 1
    upto = np.concatenate([np.zeros(WINDOW, np.int32), np.cumsum(marks, dtype=np.int32)])
    return upto[WINDOW:] > upto[: len(text)]


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, spans (start, end) of removed bytes, and the bytes that stay.

    Ids are whole numbers. Null texts are empty. A null id comes before all others; rows of one id don't take from each
    other. Texts under WINDOW bytes keep all. Other columns are not read. Empty tables give no rows.
    """
    shards, total = shard_texts(id_and_text(docs, id_col, text_col))
    told = sort_pieces(pieces(shards, repeated_anchors(shards, total), total))

    def remove(row: pa.Table, told: pa.Table) -> pa.Table:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        if not row.num_rows:
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_bytes": pa.array([], pa.int64()), "spans": pa.array([], kind), "kept": pa.array([], pa.binary())})
        _, ids, ends, text = _shard(row)
        found = list(zip(*[told.column(n).to_pylist() for n in ("places", "count", "blob")]))
        where = next((n, b) for places, n, b in found if places)
        gone = covered_bytes(text, ends, ids, where, [(n, b) for places, n, b in found if not places])
        lows = np.concatenate([[0], ends[:-1]]).astype(np.int64)
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = lows[lows < len(text)]
        edge[inner] = gone[inner]
        last = gone.copy()
        last[:-1] &= ~gone[1:]
        stops = ends[ends > 0] - 1
        last[stops] = gone[stops]
        a, b = np.flatnonzero(edge), np.flatnonzero(last) + 1
        of = np.searchsorted(ends, a, side="right")
        offsets = np.searchsorted(of, np.arange(len(ends) + 1)).astype(np.int32)
        spans = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array((a - lows[of]).astype(np.int32)), pa.array((b - lows[of]).astype(np.int32))], ["start", "end"]))
        left = np.concatenate([[0], np.cumsum(~gone)])[np.concatenate([[0], ends])].astype(np.int32)
        kept = pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(left), pa.py_buffer(text[~gone])])
        return pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "n_bytes": pa.array(ends - lows), "spans": spans, "kept": kept})

    return shards.groupBy("shard").cogroup(told.groupBy("shard")).applyInArrow(remove, "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary")


def digests(found: DataFrame) -> DataFrame:
    """Lengths, numbers of removed bytes and spans, and a digest of what is left."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + (s["end"] - s["start"]).cast("long"))
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
