"""BPE encoding and decoding with a public vocabulary of word-end BPE (lower case, white space dropped).

Words are cut where two neighbouring bytes stand side by side in no vocabulary token: no merge can cross such a place,
so the fragments between cuts are encoded by themselves and their ids are put one after the other.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lumora.llm.shared import id_and_text

#: Bound of the vocabulary file, which every executor gets.
VOCABULARY_BYTES = 64 * 1024 * 1024
#: Words whose ids a worker remembers, and the longest of them.
REMEMBERED, REMEMBERED_CHARS = 1 << 19, 48
#: Texts handed on at once; a batch ends sooner when it holds this many bytes.
BATCH_ROWS, BATCH_BYTES = 256, 8 * 1024 * 1024
#: Up to this many symbols a plain search finds the next merge faster than a heap.
SHORT = 48
NO_MERGE = (1 << 60, 0)
END = "</w>"
#: White space of the vocabulary's normaliser. str.split() takes four control characters more.
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
NOT_SPACE = re.compile("[\x1c-\x1f]")


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    others = (b for b in range(256) if b not in letters)
    letters |= {b: chr(256 + k) for k, b in enumerate(others)}
    return [letters[b] for b in range(256)]


@cache
def character_tables() -> dict:
    """Letters and numbers as character classes, and lower-case forms that differ from Python's.

    They come from the Unicode tables that the vocabulary's own library was built with, which may be older or newer;
    some thousand characters are asked for at once.
    """
    from tokenizers import Regex, normalizers, pre_tokenizers

    lower = normalizers.Lowercase()
    runs = {name: pre_tokenizers.Split(Regex(rf"\p{{{name}}}+"), "removed", invert=True) for name in "LN"}
    classes: dict[str, list[str]] = {name: [] for name in runs}
    forms: dict[str, str] = {}
    for start in range(0, sys.maxunicode + 1, 4096):
        block = [chr(c) for c in range(start, start + 4096) if not 0xD800 <= c < 0xE000 and c != 10]
        if not block:
            continue
        for name, split in runs.items():
            classes[name] += [f"{re.escape(run[0])}-{re.escape(run[-1])}" for run, _ in split.pre_tokenize_str("".join(block))]
        forms |= {c: low for c, low in zip(block, lower.normalize_str("\n".join(block)).split("\n")) if low != c.lower()}
    return {**{name: "".join(found) for name, found in classes.items()}, "lower": forms}


class Vocabulary:
    """Encoder and decoder; one per Python worker."""

    def __init__(self, spec: str):
        shared = json.loads(spec)
        model, tables = shared["model"], shared["tables"]
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        self.names = {i: name for name, i in model["model"]["vocab"].items()} | {i: name for name, i in self.special.items()}
        ids = model["model"]["vocab"]
        self.merged = {}
        for rank, pair in enumerate(model["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.merged.setdefault((ids[left], ids[right]), (rank, ids[left + right]))
        letters = _byte_letters()
        of_letter = {c: b for b, c in enumerate(letters)}
        self.inner = [ids[c] for c in letters]
        self.final = [ids[c + END] for c in letters]
        #: Pairs of bytes, and pairs that end a word, which stand side by side in some token.
        self.beside, self.beside_end = bytearray(1 << 16), bytearray(1 << 16)
        for name in ids:
            ends = name.endswith(END) and name != END
            inside = [of_letter[c] for c in (name[: -len(END)] if ends else name) if c in of_letter]
            for k, (a, b) in enumerate(zip(inside, inside[1:])):
                (self.beside_end if ends and k == len(inside) - 2 else self.beside)[a << 8 | b] = 1
        letter, number = tables["L"], tables["N"]
        self.lower = str.maketrans(tables["lower"] | {"Σ": "σ"})
        self.unusual = re.compile("[" + "".join(map(re.escape, map(chr, self.lower))) + "]")
        self.piece = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letter}]+|[{number}]|[^{letter}{number}]+")
        self.specials = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, bytes] = {}

    def _fragment(self, symbols: list[int]) -> list[int]:
        """Merge the pair of the lowest rank, the leftmost first, until none is left. A heap keeps long fragments cheap."""
        merged, n = self.merged, len(symbols)
        if n <= SHORT:
            found = merged.get
            pairs = [found(pair, NO_MERGE) for pair in zip(symbols, symbols[1:])]
            while pairs and (best := min(pairs)) is not NO_MERGE:
                i = pairs.index(best)
                symbols[i : i + 2] = [best[1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = found((symbols[i - 1], best[1]), NO_MERGE)
                if i < len(pairs):
                    pairs[i] = found((best[1], symbols[i + 1]), NO_MERGE)
            return symbols
        after, before, live = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(*found, i) for i in range(n - 1) if (found := merged.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            rank, made, i = heapq.heappop(heap)
            j = after[i] if live[i] else n
            if j >= n or merged.get((symbols[i], symbols[j])) != (rank, made):
                continue
            symbols[i], live[j], after[i] = made, False, after[j]
            if after[i] < n:
                before[after[i]] = i
                if found := merged.get((made, symbols[after[i]])):
                    heapq.heappush(heap, (*found, i))
            if before[i] >= 0 and (found := merged.get((symbols[before[i]], made))):
                heapq.heappush(heap, (*found, before[i]))
        return [s for s, there in zip(symbols, live) if there]

    def _piece(self, data: bytes) -> list[int]:
        """Ids of one word: cut at the forced boundaries, encode each fragment."""
        last = len(data) - 1
        symbols = [self.inner[b] for b in data[:-1]] + [self.final[data[-1]]]
        beside, out, start = self.beside, [], 0
        for i in range(1, last + 1):
            if not (beside if i < last else self.beside_end)[data[i - 1] << 8 | data[i]]:
                out += self._fragment(symbols[start:i])
                start = i
        return out + self._fragment(symbols[start:])

    def _chunk(self, chunk: str) -> bytes:
        """Ids of text without white space. Words are remembered without the marks around them."""
        pieces = self.piece.findall(chunk)
        if len(pieces) > 1:
            known, make = self.known.get, self._chunk
            return b"".join([known(p) or make(p) for p in pieces])
        found = _little(array("I", self._piece(chunk.encode())))
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[chunk] = found
        return found

    def _plain(self, text: str) -> list[bytes]:
        text = unicodedata.normalize("NFC", text)
        if self.unusual.search(text):
            text = text.translate(self.lower)
        text = text.lower()
        chunks = SPACE.split(text) if NOT_SPACE.search(text) else text.split()
        known, make = self.known.get, self._chunk
        return [known(c) or make(c) for c in chunks if c]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not self.specials or not self.specials.search(text):
            return b"".join(self._plain(text))
        out = []
        for k, part in enumerate(self.specials.split(text)):
            out += [_little(array("I", [self.special[part]]))] if k % 2 else self._plain(part)
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        """The names of the tokens with spaces between them, as this vocabulary, which has no decoder, is decoded."""
        numbers = array("I", ids)
        if sys.byteorder == "big":
            numbers.byteswap()
        return " ".join(map(self.names.__getitem__, numbers))


def _little(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids.byteswap()
    return ids.tobytes()


def with_tables(spec: str) -> str:
    """What a `Vocabulary` is made of: the vocabulary file's content and the character tables."""
    return json.dumps({"model": json.loads(spec), "tables": character_tables()})


@lru_cache(maxsize=2)
def _vocabulary(spec: str) -> Vocabulary:
    return Vocabulary(spec)


def _shared_spec(spark: SparkSession, path: str):
    with open(path, encoding="utf-8") as f:
        spec = f.read(VOCABULARY_BYTES + 1)
    if len(spec) > VOCABULARY_BYTES:
        raise ValueError(f"{path} holds more than {VOCABULARY_BYTES} characters")
    return spark.sparkContext.broadcast(with_tables(spec))


def _mapped(df: DataFrame, path: str, schema: str, columns: Callable[[Vocabulary, list], list[tuple[pa.DataType, list]]]) -> DataFrame:
    """Rows (id, value) to rows (id, what `columns` makes of the values), a few texts at a time."""
    shared = _shared_spec(df.sparkSession, path)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(shared.value)
        for batch in batches:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, BATCH_ROWS)
                values, size = [], 0
                for value in part.column(1):
                    values.append(value.as_py())
                    size += len(values[-1] or "")
                    if size >= BATCH_BYTES:
                        break
                part = part.slice(0, len(values))
                start += len(values)
                made = columns(vocabulary, values)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x, kind) for kind, x in made]], names=names)

    names = [x.split(" ")[0] for x in schema.split(", ")]
    return df.mapInArrow(work, schema)


def _id_type(df: DataFrame) -> str:
    return df.schema["doc_id"].dataType.simpleString()


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ids are little-endian unsigned 32-bit integers.

    Null is encoded as an empty text. Special tokens written out in a text are taken as such. Repeated rows and null
    ids give a row each, other columns are not read. A worker holds a batch of at most 256 texts or 8 MB, or one text.
    """
    docs = id_and_text(docs, id_col, text_col)
    return _mapped(docs, path, f"doc_id {_id_type(docs)}, ids binary", lambda v, texts: [(pa.binary(), [v.encode(t or "") for t in texts])])


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows of ids; null counts as no ids."""
    encoded = id_and_text(encoded, id_col, ids_col)
    return _mapped(encoded, path, f"doc_id {_id_type(encoded)}, text string", lambda v, rows: [(pa.string(), [v.decode(x or b"") for x in rows])])


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, decoded): `encode` and `decode` of its ids in one pass."""
    docs = id_and_text(docs, id_col, text_col)

    def both(v: Vocabulary, texts: list) -> list[tuple[pa.DataType, list]]:
        ids = [v.encode(t or "") for t in texts]
        return [(pa.binary(), ids), (pa.string(), [v.decode(x) for x in ids])]

    return _mapped(docs, path, f"doc_id {_id_type(docs)}, ids binary, decoded string", both)
