"""Random texts of awkward characters against plain Python versions of the fixed parts."""

import random
import re

from lumora.llm import decontamination, quality_rules, secret_scan


def texts_of(alphabet, pieces, seed, count=1500):
    rng = random.Random(seed)
    return ["".join(rng.choices(pieces, k=rng.randint(0, 12)) if rng.random() < 0.7 else rng.choices(alphabet, k=rng.randint(0, 60))) for _ in range(count)]


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_secrets(spark):
    pieces = ["password", "PassWD", "token", "api_key", "APIKEY", "secret", "=", ":", " ", "  ", '"', "'", "abc", "abcdef", "a1b2c3d4", "AKIA", "ABCDEFGH12345678", "0123456789abcdef01234567", "é", "😀", "ſecret", "\n", "AKIAAKIA"]
    texts = texts_of("abcdef0123456789=: \"'", pieces, 1)
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan(frame(spark, texts)).collect()}
    for k, text in enumerate(texts):
        want = [("assign", *m.span()) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""".replace("(?i:", "(?ai:"), text) if len(m[2]) >= 6] if text.isascii() else None
        plain = re.compile(r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
        assign = [("assign", *m.span()) for m in plain.finditer(text) if len(m[2]) >= 6]
        assert want is None or want == assign
        base = assign + [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20] + [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [(s["kind"], s["start"], s["end"]) for s in got[k] if s["rank"] < 3] == base, text


def test_quality_counts(spark):
    pieces = ["the ", "a\tb ", "x\n", "\n", "\x0b", "\x0c", "\r", " ", "é ", "# ", "$%&", "<|>", "one two three four five ", "\xa0", "\x85", "\x1c", "😀 ", "line\n", "line\n"]
    texts = texts_of("ab \n\t#", pieces, 2)
    for r in quality_rules.quality_report(frame(spark, texts)).collect():
        text = texts[r["doc_id"]]
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[p : p + 5]) for p in range(len(words) - 4)]
        covered = {p + k for p, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)), text
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words)) and not (r["base_failed"] and r["kept"])


def test_words_of_the_benchmark_operator():
    rng = random.Random(3)
    for text in ["".join(rng.choices("aB9_É\x00\x7f-' \n一ſK", k=40)) for _ in range(2000)]:
        lower = re.sub("[A-Z]", lambda m: m[0].lower(), text)
        assert decontamination.words_of(text.encode()) == [w.encode() for w in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]
