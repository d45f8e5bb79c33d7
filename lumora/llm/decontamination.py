"""Benchmark decontamination: a generalised suffix automaton of the test items, streamed over training texts."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lumora.llm.shared import PLAIN, fresh, id_and_text, words_of

#: Words of an item that make a window; an item of fewer words is one window.
WINDOW = 13
#: A document is contaminated if this share of its words, or more, lies in windows of items.
COVERAGE = 0.05
#: Bytes of item texts in one automaton. More items make more automata, and one more pass over the texts each.
BLOCK_BYTES = 1 << 20
BATCH_ROWS = 256

class Automaton:
    """Suffix automaton over the words of many items, with the items that own each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        self.window, self.ids = window, {}
        self.size, self.link, self.moves = [0], [-1], [{}]
        #: By state: items whose window of `window` words ends there; (length, items) of shorter items.
        self.owners: dict[int, set[str]] = {}
        self.short: dict[int, tuple[int, set[str]]] = {}
        texts = [(name, [self.ids.setdefault(w, len(self.ids)) for w in words_of(text)]) for name, text in items]
        for _, words in texts:
            last = 0
            for w in words:
                last = self._extend(last, w)
        for name, words in texts:
            self._own(name, words)
        order = sorted(range(len(self.size)), key=self.size.__getitem__)
        self.nearest = [0] * len(self.size)  # this state or the next by suffix links at which a short item ends
        for v in order[1:]:
            self.nearest[v] = v if v in self.short else self.nearest[self.link[v]]
        lengths = [len(words) for _, words in texts if words]
        self.shortest = min([window, *lengths]) if lengths else 0

    def _state(self, size: int, link: int, moves: dict[int, int]) -> int:
        self.size.append(size)
        self.link.append(link)
        self.moves.append(moves)
        return len(self.size) - 1

    def _split(self, p: int, w: int) -> int:
        """The state that `w` leads to from `p`, of exactly one word more than `p`."""
        q = self.moves[p][w]
        if self.size[q] == self.size[p] + 1:
            return q
        clone = self._state(self.size[p] + 1, self.link[q], dict(self.moves[q]))
        self.link[q] = clone
        while p >= 0 and self.moves[p].get(w) == q:
            self.moves[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.moves[last]:
            return self._split(last, w)
        new, p = self._state(self.size[last] + 1, 0, {}), last
        while p >= 0 and w not in self.moves[p]:
            self.moves[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def _window_state(self, v: int) -> int:
        while self.size[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def _own(self, name: str | None, words: list[int]) -> None:
        v, names = 0, {name} if name is not None else set()
        for k, w in enumerate(words, 1):
            v = self.moves[v][w]
            if k >= self.window:
                self.owners.setdefault(self._window_state(v), set()).update(names)
        if 0 < len(words) < self.window:
            self.short.setdefault(v, (len(words), set()))[1].update(names)

    def matches(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Half-open ranges of words that windows cover, and the items that own these windows."""
        if not self.shortest or len(words) < self.shortest:
            return [], set()
        known = np.fromiter(map(self.ids.get, words, repeat(-1)), np.int64, len(words))
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known >= 0, [False])).astype(np.int8)))
        spans, names = [], set()
        for start, end in zip(edges[::2].tolist(), edges[1::2].tolist()):
            if end - start >= self.shortest:  # an unknown word ends every match, so runs of known words are all there is to stream
                self._stream(known[start:end].tolist(), start, spans, names)
        return spans, names

    def _stream(self, run: list[int], at: int, spans: list[tuple[int, int]], names: set[str]) -> None:
        size, link, moves, window = self.size, self.link, self.moves, self.window
        v = length = 0
        for end, w in enumerate(run, at + 1):
            while v and w not in moves[v]:
                v = link[v]
                length = size[v]
            if w in moves[v]:
                v, length = moves[v][w], length + 1
            if length >= window:
                spans.append((end - window, end))
                names |= self.owners[self._window_state(v)]
            u = self.nearest[v]
            while u:
                n, owners = self.short[u]
                if n <= length:
                    spans.append((end - n, end))
                    names |= owners
                u = self.nearest[link[u]]


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without these words and what stands between them."""
    places = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(PLAIN))]
    parts, start = [], 0
    for a, b in spans:
        parts.append(text[start : places[a][0]])
        start = places[b - 1][1]
    return b"".join([*parts, text[start:]])


@lru_cache(maxsize=1)
def _automaton(items: tuple[tuple[str | None, bytes], ...], window: int) -> Automaton:
    return Automaton(list(items), window)


def _blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[str | None, bytes]]]:
    """The items in blocks of about BLOCK_BYTES, one block at a time on the driver."""
    plain = items.select(F.col(f"`{id_col}`").cast("string").alias("name"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    total = plain.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = 1 + total // BLOCK_BYTES
    for k in range(blocks):
        rows = plain.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == k).collect()
        yield sorted(((r["name"], r["text"].encode()) for r in rows), key=repr)


def annotate(docs: DataFrame, items: DataFrame, text_col: str, id_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> tuple[DataFrame, dict[str, str]]:
    """All columns of `docs` and three more, whose names are returned: `n_words`, `spans` of words, `items`."""
    names = {n: fresh(docs, f"_{n}") for n in ("n_words", "spans", "items")}
    span = T.StructType([T.StructField("start", T.IntegerType(), False), T.StructField("end", T.IntegerType(), False)])
    schema = T.StructType([
        *docs.schema, T.StructField(names["n_words"], T.LongType()), T.StructField(names["spans"], T.ArrayType(span, False)),
        T.StructField(names["items"], T.ArrayType(T.StringType(), False)),
    ])
    kinds = [pa.int64(), pa.list_(pa.struct([pa.field("start", pa.int32(), False), pa.field("end", pa.int32(), False)])), pa.list_(pa.string())]
    at, width = docs.columns.index(text_col), len(docs.columns)
    context = docs.sparkSession.sparkContext
    df = docs
    for block in _blocks(items, id_col, item_text_col):
        shared, first = context.broadcast(tuple(block)), df is docs

        def work(batches: Iterator[pa.RecordBatch], shared=shared, first=first) -> Iterator[pa.RecordBatch]:
            automaton = _automaton(shared.value, window)
            for batch in batches:
                for start in range(0, batch.num_rows, BATCH_ROWS):
                    part = batch.slice(start, BATCH_ROWS)
                    made: list[list] = [[], [], []]
                    for k, text in enumerate(part.column(at)):
                        words = words_of((text.as_py() or "").encode())
                        spans, found = automaton.matches(words)
                        if not first:
                            spans += [(s["start"], s["end"]) for s in part.column(width + 1)[k].as_py()]
                            found |= set(part.column(width + 2)[k].as_py())
                        made[0].append(len(words))
                        made[1].append([{"start": a, "end": b} for a, b in merged(spans)])
                        made[2].append(sorted(found))
                    yield pa.RecordBatch.from_arrays([*part.columns[:width], *[pa.array(x, kind) for x, kind in zip(made, kinds)]], names=schema.names)

        df = df.mapInArrow(work, schema)
    return df, names


def _hit(spans: Column) -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])


def _contaminated(n_hit: Column, n_words: Column, coverage: float) -> Column:
    return (n_hit > 0) & (n_hit >= coverage * n_words) if coverage != COVERAGE else (n_hit > 0) & (20 * n_hit >= n_words)


def contamination(docs: DataFrame, items: DataFrame, doc_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """One row per document: n_words, n_hit, the items found (as strings, sorted), `contaminated`, and the hit spans of words.

    Null and empty texts have no words. Items without words do nothing; items without id mark words but are not listed;
    rows of one item id are one item. Repeated rows and null ids of documents give a row each. No rows move: each task
    streams its texts through automata whose size is bounded by BLOCK_BYTES.
    """
    made, n = annotate(id_and_text(docs, doc_col, text_col), items, "text", window=window)
    n_hit = _hit(F.col(n["spans"]))
    return made.select(
        "doc_id", F.col(n["n_words"]).alias("n_words"), n_hit.alias("n_hit"), F.col(n["items"]).alias("items"),
        _contaminated(n_hit, F.col(n["n_words"]), coverage).alias("contaminated"), F.col(n["spans"]).alias("spans"),
    )


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, coverage: float = COVERAGE) -> DataFrame:
    """The rows of `docs`, with their columns, without documents beyond the coverage limit; others stay word for word."""
    made, n = annotate(docs, items, text_col, window=window)
    return made.where(~_contaminated(_hit(F.col(n["spans"])), F.col(n["n_words"]), coverage)).select(*[F.col(f"`{c}`") for c in docs.columns])


def remove_spans(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with every span cut out of its text that windows of items cover; null stays null."""
    made, n = annotate(docs, items, text_col, window=window)
    names, at, spans_at = docs.columns, docs.columns.index(text_col), made.columns.index(n["spans"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [
                cut(t.as_py().encode(), [(x["start"], x["end"]) for x in s.as_py()]).decode() if len(s) and t.is_valid else t.as_py()
                for t, s in zip(batch.column(at), batch.column(spans_at))
            ]
            columns = batch.columns[: len(names)]
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return made.mapInArrow(work, docs.schema)
