"""Registered corpus queries against their SQL, or against plain versions over the same whole tables."""

import hashlib
import re
import zlib
from array import array

import public_tokenizers
import pytest
from conftest import SF
from oracle_check import compare
from tokenizers import Tokenizer

from lumora.llm import near_dedup, pii
from lumora.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", list(ORACLES))
def test_same_rows_as_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), SF, ORACLES[name]) is None


@pytest.fixture(scope="module")
def docs(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_tokens_are_those_of_the_library(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for row in QUERIES["op3_bpe"](spark, SF).collect():
        ids = library.encode(docs[row["doc_id"]]["text"], add_special_tokens=False).ids
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(array("I", ids).tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def plain_classes(texts, least=near_dedup.SIMILARITY):
    """All pairs compared."""
    sets = {i: near_dedup.shingles(near_dedup.words_of((t or "").encode())) for i, t in texts.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if near_dedup.similarity(sets[a], sets[b]) >= least:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


def test_near_duplicates_are_those_of_all_pairs(spark, docs):
    got = {r["doc_id"]: r["class_id"] for r in QUERIES["op4_minhash"](spark, SF).collect()}
    assert got == plain_classes({i: r["text"] for i, r in docs.items()})
    assert len(set(got.values())) < len(got)


def test_languages_of_the_held_out_fold(spark, docs):
    rows = QUERIES["op7_language_id"](spark, SF).collect()
    assert len(rows) == len(docs)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and 0 <= r["score"] <= 1 for r in rows)
    unseen = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == docs[r["doc_id"]]["lang"] for r in unseen) >= 0.95 * len(unseen)


def luhn(digits):
    values = [int(c) * (1 + k % 2) for k, c in enumerate(reversed(digits))]
    return sum(v - 9 if v > 9 else v for v in values) % 10 == 0


def plain_private(text):
    found = []
    for kind, pattern in (
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
    ):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            right = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if kind == "ip" else False, "card": 16 <= len(digits) <= 19 and luhn(digits), "phone": 8 <= len(digits) <= 15}
            if right[kind]:
                found.append(f"{kind}:{m.start()}:{m.end()}")
    return found


def test_private_spans_hold_those_of_the_plain_patterns(spark, docs):
    total = 0
    for row in QUERIES["op10_pii"](spark, SF).collect():
        base = plain_private(docs[row["doc_id"]]["text"])
        total += len(base)
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) | {""}
        assert [row[f"n_{r.kind}"] for r in pii.BASE] == [sum(x.startswith(r.kind) for x in base) for r in pii.BASE]
    assert total
