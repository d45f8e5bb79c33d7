"""Suffix-array dedup, whitening and the manifest beside plain versions, and on odd inputs."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumora.llm import manifest, suffix_dedup, whitening
from lumora.llm.queries import QUERIES
from lumora.llm.suffix_array import permuted_prefixes, suffix_array

SF = "/root/testdata/sf0.001"
EXTRA = "spans string, n long, task int, grp string, pos long, digest string, at int"


# ---------------------------------------------------------------- 11

def test_suffix_arrays_and_prefixes():
    rng = random.Random(1)
    for _ in range(1500):
        n, k = rng.randint(0, 60), rng.choice([1, 2, 3, 5, 300])
        t = [rng.randrange(k) for _ in range(n)]
        t = (t[:7] * 10)[:n] if rng.random() < 0.3 else t
        sa = suffix_array(np.array(t, np.int32 if k > 256 else np.uint8), max(k, 257 if k > 256 else k)).tolist()
        assert sa == sorted(range(len(t)), key=lambda i: t[i:])
        if k <= 256 and len(t) > 1:
            got = permuted_prefixes(np.array(t, np.uint8), np.array(sa, np.int32), np.arange(0, len(t), 20), 64)
            for i, j in zip(sa[1:], sa):
                m = 0
                while i + m < len(t) and j + m < len(t) and t[i + m] == t[j + m]:
                    m += 1
                assert got[i] == m


def plain_dedup(rows):
    key = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            w = b[p : p + 50]
            first[w] = min(first.get(w, key(i)), key(i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < key(i):
                gone[p : p + 50] = b"\1" * 50
        spans = sum(1 for p in range(len(b)) if gone[p] and (p == 0 or not gone[p - 1]))
        out.append((i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("shard,array", [(4 << 20, 8 << 20), (3000, 300)])
def test_dedup_of_mixed_passages(spark, monkeypatch, shard, array):
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", shard)
    monkeypatch.setattr(suffix_dedup, "ARRAY_BYTES", array)
    rng = random.Random(4)
    pool = ["".join(rng.choice("abc é\n") for _ in range(rng.randint(20, 200))) for _ in range(40)] + ["a" * 300, "ab" * 400, " *" * 90]
    rows = [(rng.choice([None] + [i] * 9 + [7]), None if rng.random() < 0.02 else "".join(rng.choice(pool)[rng.randint(0, 30) :] for _ in range(rng.randint(0, 6)))) for i in range(300)]
    rows += [(1000, "x" * 49), (1001, "x" * 49), (1002, "y" * 50), (1003, "y" * 50), (1004, ""), (1005, "z" * 5000), (1006, "z" * 70)]
    df = spark.createDataFrame([(*r, "s", 1, 2, "g", 3, "d", 4) for r in rows], f"doc_id long, text string, {EXTRA}").repartition(5)
    assert sorted(map(tuple, suffix_dedup.digests(suffix_dedup.repeated_bytes(df)).collect()), key=repr) == plain_dedup(rows)


def test_pieces_alone_with_their_anchor_are_not_sorted(monkeypatch):
    sorted_bytes, classes = [], suffix_dedup.window_classes

    def counted(text, *more):
        sorted_bytes.append(len(text))
        return classes(text, *more)

    monkeypatch.setattr(suffix_dedup, "window_classes", counted)
    rng = np.random.default_rng(3)
    passage = rng.integers(97, 123, 60, np.uint8)
    texts = [rng.integers(97, 123, 60, np.uint8), np.concatenate([passage, passage[:1]]), passage, np.full(84, 97, np.uint8)]
    sizes = np.array([len(t) for t in texts])
    raw, begins = np.concatenate(texts), np.cumsum(sizes) - sizes
    found = suffix_dedup._classes_of(raw, begins, sizes, np.array([1, 2, 2, 3], np.uint64), np.array([9, 4, 3, 8]))
    assert found.tolist() == [9] * 11 + [3] * 11 + [4] + [3] * 11 + [8] * 35
    assert sorted_bytes == [61 + 60 + 2]


def test_windows_like_no_other_are_not_sorted(monkeypatch):
    sorted_bytes, sort = [], suffix_dedup.suffix_array

    def counted(text, size):
        sorted_bytes.append(len(text))
        return sort(text, size)

    monkeypatch.setattr(suffix_dedup, "suffix_array", counted)
    rng = np.random.default_rng(4)
    passage = rng.integers(97, 123, 60, np.uint8)
    texts = [np.concatenate([passage, rng.integers(97, 123, 24, np.uint8)]), np.concatenate([rng.integers(97, 123, 24, np.uint8), passage]), rng.integers(97, 123, 84, np.uint8)]
    text = np.concatenate([np.append(t, suffix_dedup.GAP).astype(np.uint8) for t in texts])
    begins, counts = np.arange(3) * 85, np.full(3, 35)
    found = suffix_dedup.window_classes(text, begins, counts, np.array([5, 3, 4]))
    assert found.tolist() == [3] * 11 + [5] * 24 + [3] * 35 + [4] * 35
    assert sorted_bytes == [2 * 61]
    assert suffix_dedup.window_classes(text[85:], begins[:2], counts[:2], np.array([3, 4])).tolist() == [3] * 35 + [4] * 35
    assert sorted_bytes == [2 * 61]


@pytest.mark.parametrize("block", [1, 7, 64, 1 << 15])
def test_runs_in_blocks(monkeypatch, block):
    monkeypatch.setattr(suffix_dedup, "BLOCK", block)
    rng = np.random.default_rng(6)
    texts = [rng.integers(97, 100, n, np.uint8) for n in (0, 49, 50, 51, 200, 3)] + [np.full(130, 97, np.uint8), rng.integers(97, 100, 90, np.uint8)]
    ends = np.cumsum([len(t) for t in texts])
    first, count, anchor = suffix_dedup.runs(np.concatenate(texts), ends)
    windows = [k for t, end in zip(texts, ends) for k in range(end - len(t), end - 49)]
    assert [k for a, n in zip(first.tolist(), count.tolist()) for k in range(a, a + n)] == windows
    assert 1 <= count.min() and count.max() <= suffix_dedup.RUN
    of = np.repeat(anchor, count)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1 << 15)
    alone = [suffix_dedup.runs(np.concatenate(texts)[k : k + 50], np.array([50]))[2][0] for k in windows]
    assert of.tolist() == alone


def test_dedup_of_the_given_documents_and_of_none(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op11_suffix_dedup"](spark, SF).collect()), key=repr)
    assert got == plain_dedup([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert suffix_dedup.repeated_bytes(docs.where("false")).count() == 0
    found = suffix_dedup.repeated_bytes(docs.limit(5)).join(docs, "doc_id").collect()
    for r in found:
        b = r["text"].encode()
        assert r["kept"] == b"".join(b[x:y] for x, y in zip([0, *[s["end"] for s in r["spans"]]], [*[s["start"] for s in r["spans"]], len(b)]))


def test_bucketed_shards_stay_where_they_are(spark):
    shards, total = suffix_dedup.shard_texts(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"))
    plan = suffix_dedup.pieces(shards, suffix_dedup.repeated_anchors(shards, total), total)._jdf.queryExecution().executedPlan().toString()
    left = plan[plan.index("FlatMapCoGroupsInArrow") :].split("FileScan")[0]
    assert "Exchange" not in left and "Bucketed: true" in plan


# ---------------------------------------------------------------- 12

def plain_whitening(vectors):
    x = np.floor(np.array(vectors, dtype=float) * 1024) + 100_000
    centred = x - x.mean(axis=0)
    e, v = np.linalg.eigh(centred.T @ centred / len(x))
    return centred, e[::-1], v[:, ::-1]


@pytest.mark.parametrize("d,n", [(64, 400), (5, 300), (40, 30)])
def test_whitening_beside_a_plain_decomposition(spark, d, n):
    rng = np.random.default_rng(d)
    own = (rng.normal(size=(n, d)) * np.linspace(2, 0.3, d)).astype(np.float32)
    df = spark.createDataFrame([(i, [float(c) for c in r]) for i, r in enumerate(own)], "vec_id long, embedding array<float>").repartition(3)
    rows = whitening.whitened_embeddings(df).collect()
    centred, e, v = plain_whitening(own)
    count = min(8, d, n - 1)
    assert len(rows) == n * count
    made = np.zeros((n, count))
    for r in rows:
        made[r["vec_id"], r["component"] - 1] = r["whitened"]
        assert r["n"] == n and abs(r["explained"] / (e[r["component"] - 1] / e.sum()) - 1) < 1e-9 and r["identity_error"] < 1e-9
    wanted = centred @ v[:, :count] / np.sqrt(e[:count])
    sign = np.sign((wanted * made).sum(axis=0))
    assert np.abs(made * sign - wanted).max() < 1e-7
    whole = [[int(np.floor(float(c) * 1024)) + 100_000 for c in r] for r in own.astype(float)]
    sums = [sum(c) for c in zip(*whole)]
    for r in rows[:40]:
        assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(whole[r["vec_id"]], sums))


def test_whitening_of_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 3), float(i % 5), 1.0]) for i in range(30)] + [(None, [1.0, 2.0, 1.0]), (3, [0.0, 3.0, 1.0])]
    bad = [(90, None), (91, [1.0, None, 2.0]), (92, [nan, 1.0, 2.0]), (93, [inf, 1.0, 2.0]), (94, []), (95, [1.0, 2.0]), (96, [1e30, 0.0, 0.0])]
    df = spark.createDataFrame([(*r, 1, "s", 2, 3, 4) for r in good + bad], "vec_id long, embedding array<double>, n int, x string, v int, d int, at int")
    rows = whitening.whitened_embeddings(df).collect()
    assert len(rows) == 2 * len(good)  # the third dimension is constant
    assert {r["vec_id"] for r in rows} == {i for i, _ in good} and all(r["identity_error"] < 1e-9 for r in rows)
    assert whitening.whitened_embeddings(df.where("false")).count() == 0
    assert whitening.whitened_embeddings(df.where("vec_id = 0")).count() == 0  # no variance, no component


def test_exact_deviation_where_64_bits_do_not_hold_the_steps():
    x = np.array([[1 << 40, -(1 << 40)], [0, 5]], np.int64)
    assert whitening._deviation(x, 3, [7, 9]) == [None, 49 + 36]
    assert whitening._deviation(np.array([[10, 20]], np.int64), 2, [15, 44]) == [41]


# ---------------------------------------------------------------- 13

def plain_manifest(rows, fan=2):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    said = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def tree(leaves):
        """(root, proofs): per leaf the sides of each level."""
        proofs, level, at = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
        while len(level) > 1:
            runs = [level[i : i + fan] for i in range(0, len(level), fan)]
            for k, place in enumerate(at):
                run = runs[place // fan]
                proofs[k].append((run[: place % fan], run[place % fan + 1 :]))
            level, at = [sha("".join(r)) for r in runs], [p // fan for p in at]
        return level[0], proofs

    leaf = lambda r, n: sha("".join(map(said, (r[0], r[3], r[2], n, r[1]))))
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {}
    for g in order:
        groups[g].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[4])))
        subs[g] = tree([leaf(r, r[4]) for r in groups[g]])
    root, tops = tree([subs[g][0] for g in order])
    out = []
    for g, top in zip(order, tops):
        for r, proof in zip(groups[g], subs[g][1]):
            path = proof + top
            bad = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[4] is not None
            now = leaf(r, r[4] + 1 if bad else r[4])
            for left, right in path:
                now = sha("".join(left) + now + "".join(right))
            out.append((r[0], leaf(r, r[4]), subs[g][0], root, sha("".join(x for a, b in path for x in a + b)), now, now == root))
    return sorted(out, key=repr)


@pytest.mark.parametrize("fan,levels", [(2, 10), (2, 1), (3, 2)])
def test_manifest_beside_a_plain_tree(spark, fan, levels):
    rng = random.Random(fan)
    rows = [(i, rng.choice(["", "text", None, "ü 😀"]), rng.choice(["en", "de", "é", None, ""]), rng.choice(["s", None]), rng.choice([None, i])) for i in range(120)]
    rows += [(7, "same", "en", "s", 4), (7, "same", "en", "s", 4), (None, "a", "en", "s", 1), (None, None, None, None, None), (500, "alone", "xx", "s", 5), (-3, "x" * 50_000, "de", "s", (1 << 63) - 1)]
    df = spark.createDataFrame([(*r, "g", 1, 2, "d", True) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, grp string, pos int, m int, digest string, verified boolean").repartition(4)
    got = manifest.manifest(df, fan_in=fan, levels=levels)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_manifest(rows, fan)


def test_manifest_of_no_and_of_one_row(spark):
    df = spark.createDataFrame([(1, "t", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest.manifest(df.where("false")).count() == 0
    row = manifest.manifest(df, with_proof=True).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof"] == ""
    assert row["proof_sha256"] == hashlib.sha256(b"").hexdigest()
    changed = manifest.manifest(df.withColumn("text", F.lit("u"))).first()
    assert changed["root"] != row["root"]


# ---------------------------------------------------------------- 10

def plain_private(text):
    import re

    def luhn(digits):
        total = 0
        for k, d in enumerate(reversed(digits)):
            v = int(d) * (2 if k % 2 else 1)
            total += v - 9 if v > 9 else v
        return total % 10 == 0

    digits = lambda m: re.sub("[^0-9]", "", m)
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(digits(m)) <= 19 and luhn(digits(m))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(digits(m)) <= 15),
    ]
    return [f"{kind}:{m.start()}:{m.end()}" for kind, pattern, keep in kinds for m in re.finditer(pattern, text) if keep(m.group())]


def test_base_spans_of_random_texts_are_those_of_the_plain_patterns(spark):
    from lumora.llm import pii

    rng = random.Random(10)
    pieces = ["a@b.co", "x.y-z@", "@c.d", "1.2.3.4", "255.256.1.0", "010.000.1.2", "4111 1111 1111 1111", "4111-1111", "+49 (30) 123-4567", "+1", "5" * 17, ".", " ", "-", "ü", "+", "12", "a", "(", ")", "\n", "4242424242424242"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    model = pii.Model(-50.0, dict.fromkeys(pii.features(F.col("c")), 0.0), {})  # adds nothing
    got = {r["doc_id"]: r["spans"] for r in pii.digests(pii.find_private(df, model)).collect()}
    assert all(got[i] == ",".join(plain_private(t)) for i, t in enumerate(texts))
