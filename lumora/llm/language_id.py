"""Language identification by a convolutional network over bytes, trained here in numpy."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql import types as T

from lumora.llm.shared import id_and_text

#: Bytes per window, widths of the filters, filters per width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: Bounds of the training sample: documents, windows of each, and languages (the most frequent).
SAMPLE_DOCS, SAMPLE_WINDOWS, LANGUAGES = 1600, 3, 500
UNKNOWN = "und"
#: Windows computed at once.
BATCH_WINDOWS = 128


class Network(NamedTuple):
    """Per width, responses of all filters to a byte at each place: (width, 256, FILTERS); byte 0 pads and says nothing."""

    languages: list[str]
    filters: list[np.ndarray]
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, side by side; the last is padded."""
    count = max(1, -(-len(data) // WINDOW))
    return np.frombuffer(data.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


def _responses(x: np.ndarray, filters: np.ndarray) -> np.ndarray:
    width = len(filters)
    places = x.shape[1] - width + 1
    total = filters[0][x[:, :places]]
    for k in range(1, width):
        total += filters[k][x[:, k : k + places]]
    return total


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def train_network(x: np.ndarray, labels: list[str], epochs: int = 8, batch: int = 64, rate: float = 0.01, seed: int = 7) -> Network:
    """Fit by Adam on cross-entropy. The gradient of a filter reaches only the bytes at its largest response."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    target = np.array([languages.index(name) for name in labels])
    size = FILTERS * len(WIDTHS)
    p = [rng.normal(0, 0.1, (w, 256, FILTERS)).astype(np.float32) for w in WIDTHS]
    p += [np.zeros(size, np.float32), rng.normal(0, 0.1, (size, len(languages))).astype(np.float32), np.zeros(len(languages), np.float32)]
    first, second = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(len(x)), max(1, len(x) // batch)):
            rows, n, step = x[part], len(part), step + 1
            pooled, best = [], []
            for w, _ in enumerate(WIDTHS):
                r = _responses(rows, p[w])
                at = r.argmax(axis=1)
                best.append(at)
                pooled.append(np.take_along_axis(r, at[:, None], axis=1)[:, 0])
            raw = np.concatenate(pooled, axis=1) + p[-3]
            hidden = np.maximum(raw, 0)
            error = _softmax(hidden @ p[-2] + p[-1])
            error[np.arange(n), target[part]] -= 1
            error /= n
            back = (error @ p[-2].T) * (raw > 0)
            slopes = []
            for w, width in enumerate(WIDTHS):
                slope = np.zeros_like(p[w])
                for k in range(width):
                    seen = np.take_along_axis(rows, best[w] + k, axis=1)
                    np.add.at(slope[k], (seen, np.arange(FILTERS)[None, :]), back[:, w * FILTERS : (w + 1) * FILTERS])
                slope[:, 0] = 0
                slopes.append(slope)
            slopes += [back.sum(axis=0), hidden.T @ error, error.sum(axis=0)]
            for a, m, v, g in zip(p, first, second, slopes):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    for w, _ in enumerate(WIDTHS):
        p[w][:, 0] = 0
    return Network(languages, p[:-3], p[-3], p[-2], p[-1])


class Scorer:
    """The network with its filters tabulated for pairs of bytes."""

    def __init__(self, network: Network):
        self.network = network
        self.tables = []
        for f in network.filters:
            pairs = [(f[k][:, None, :] + f[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, len(f) - 1, 2)]
            self.tables.append((len(f), pairs, f[-1] if len(f) % 2 else None))

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        pair = x[:, :-1].astype(np.int32) << 8 | x[:, 1:]
        pooled = []
        for width, pairs, single in self.tables:
            places = WINDOW - width + 1
            total = np.take(pairs[0], pair[:, :places], axis=0)
            for k, table in enumerate(pairs[1:], 1):
                total += np.take(table, pair[:, 2 * k : 2 * k + places], axis=0)
            if single is not None:
                total += np.take(single, x[:, width - 1 : width - 1 + places], axis=0)
            pooled.append(total.max(axis=1))
        hidden = np.maximum(np.concatenate(pooled, axis=1) + self.network.bias, 0)
        return _softmax((hidden @ self.network.weights + self.network.offset).astype(np.float64))


def held_out(doc_id: Column) -> Column:
    """The fold that is never learned from: crc32 of the id as text leaves no remainder by 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> tuple[np.ndarray, list[str]]:
    """Windows of at most SAMPLE_DOCS documents outside the held-out fold, about as many of each language.

    Documents are ordered by an exponential variable, made from a hash of the id and scaled by how often their language
    occurs, and the first ones taken; windows lie at hashed places anywhere in the text. A limit on the variable, below
    which four times the sample is expected at most, holds before anything is gathered.
    """
    rows = id_and_text(docs, id_col, text_col, lang_col).withColumnRenamed(lang_col, "language")
    rows = rows.where(~held_out(F.col("doc_id")) & F.col("language").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = rows.groupBy("language").count().orderBy(F.desc("count"), "language").limit(LANGUAGES).collect()
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), []
    scale = F.create_map(*[F.lit(v) for r in counts for v in (r["language"], float(r["count"]))])[F.col("language")]
    uniform = (F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 11).cast("double") + 0.5) * 2.0**-53
    data = F.col("text").cast("binary")
    room = F.greatest(F.lit(1), F.octet_length("text") - WINDOW + 1)
    parts = [F.substring(data, F.pmod(F.xxhash64("text", F.lit(k)), room).cast("int") + 1, F.lit(WINDOW)) for k in range(SAMPLE_WINDOWS)]
    taken = rows.where(scale.isNotNull()).select((-F.log(uniform) * scale).alias("order"), "language", F.array_distinct(F.array(*parts)).alias("parts"))
    taken = taken.where(F.col("order") <= 4.0 * SAMPLE_DOCS / len(counts))
    found = [(r["language"], bytes(part)) for r in taken.orderBy("order", "language", "parts").limit(SAMPLE_DOCS).collect() for part in r["parts"]]
    return np.concatenate([windows_of(part) for _, part in found] or [np.zeros((0, WINDOW), np.uint8)]), [name for name, _ in found]


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Network | None:
    """A network from the bounded sample; none if no document has a language."""
    x, labels = training_sample(docs, id_col, text_col, lang_col)
    return train_network(x, labels) if labels else None


def predict(docs: DataFrame, network: Network | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Every window of a text is judged and the probabilities are averaged. Null texts, texts without a letter, and all texts
    if there is no network, are `und` with score 0. Repeated rows and null ids give a row each; other columns are not read.
    """
    docs = id_and_text(docs, id_col, text_col)
    fold = held_out(F.col("doc_id")).alias("held_out")
    if network is None:
        return docs.select("doc_id", fold, F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    judged = F.when(F.col("text").rlike(r"\p{L}"), F.col("text"))
    schema = T.StructType([docs.schema["doc_id"], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(shared.value)
        names = scorer.network.languages

        def judge(texts: list[bytes | None]) -> tuple[list[str], list[float]]:
            found = [None if t is None else windows_of(t) for t in texts]
            there = [w for w in found if w is not None]
            if not there:
                return [UNKNOWN] * len(texts), [0.0] * len(texts)
            x = np.concatenate(there)
            p = np.concatenate([scorer.probabilities(x[k : k + BATCH_WINDOWS]) for k in range(0, len(x), BATCH_WINDOWS)])
            starts = np.cumsum([0, *map(len, there[:-1])])
            means = iter(np.add.reduceat(p, starts, axis=0) / np.array([[len(w)] for w in there]))
            rows = [None if w is None else next(means) for w in found]
            return [UNKNOWN if r is None else names[int(r.argmax())] for r in rows], [0.0 if r is None else float(min(r.max(), 1.0)) for r in rows]

        for batch in batches:
            start = 0
            while start < batch.num_rows:
                texts, size = [], 0
                while start + len(texts) < batch.num_rows and size < BATCH_WINDOWS * WINDOW:
                    value = batch.column(1)[start + len(texts)].as_py()
                    texts.append(None if value is None else value.encode())
                    size += len(texts[-1] or b"") + WINDOW
                predicted, score = judge(texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(texts)), pa.array(predicted, pa.string()), pa.array(score, pa.float64())], names=schema.names)
                start += len(texts)

    return docs.select("doc_id", judged.alias("text")).mapInArrow(work, schema).select("doc_id", fold, "lang_pred", "score")
