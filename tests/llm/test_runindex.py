import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm import runindex as R


def brute(texts, length=400, keep_first=False):
    """(n_removed, n_spans, kept) of each text, by counting every window; texts in the order that tells the first."""
    seen, met = {}, set()
    for t in texts:
        for p in range(len(t) - length + 1):
            seen[t[p:p + length]] = seen.get(t[p:p + length], 0) + 1
    out = []
    for t in texts:
        gone = np.zeros(len(t) + 2, np.int8)
        for p in range(len(t) - length + 1):
            w = t[p:p + length]
            if w in met if keep_first else seen[w] > 1:
                gone[1 + p:1 + p + length] = 1
            met.add(w)
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((int(gone.sum()), int((np.diff(gone) == 1).sum()), kept))
    return out


def texts(seed=1, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 9)))
    prose = lambda k: " ".join(word() for _ in range(k))
    shared = [prose(k) for k in (70, 75, 90, 200, 400)]
    out = []
    for _ in range(n):
        parts = [prose(rnd.randint(0, 150))]
        for _ in range(rnd.choice([0, 1, 1, 2])):
            x = rnd.choice(shared)
            a = rnd.randint(0, len(x) // 6)
            parts += [x[a:len(x) - rnd.randint(0, len(x) // 6)], prose(rnd.randint(0, 60))]
        out.append(rnd.choice(["", " "]).join(parts))
    out += [out[0], out[0], "a" * 3000, "a" * 450, "ab" * 700, "ba" * 700, "", None, "x" * 399, "y" * 400, "z" * 401,
            shared[4] + shared[4][:420], shared[3] + "!" + shared[3]]
    return out


def test_index_matches_counts():
    rnd = random.Random(3)
    strings = [bytes(rnd.choice(b"ab") for _ in range(rnd.randint(1, 60))) for _ in range(40)]
    strings += [strings[0] * 2, strings[1][:20] + strings[2]]
    for length in (5, 12, 30):
        seen = {}
        for s in strings:
            for p in range(len(s) - length + 1):
                seen[s[p:p + length]] = seen.get(s[p:p + length], 0) + 1
        want = [[p for p in range(len(s) - length + 1) if seen[s[p:p + length]] > 1] for s in strings]
        assert [x.tolist() for x in R.repeated_starts(strings, length)] == want
        met, later = set(), []
        for s in strings:
            later.append([p for p in range(len(s) - length + 1) if s[p:p + length] in met or met.add(s[p:p + length])])
        assert [x.tolist() for x in R.repeated_starts(strings, length, True)] == later
    assert [x.tolist() for x in R.repeated_starts([b"abc"], 2, True)] == [[]]


def check(spark, rows, length=400, keep_first=False):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("h", F.lit("clash")).withColumn("s", F.lit(1))
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "", r._n_bytes, r._n_removed, r._n_spans,
                  hashlib.sha256(bytes(r._kept)).hexdigest()) for r in R.remove_repeats(df, length=length, keep_first=keep_first).collect())
    if keep_first:  # ids are unique there, null last
        rows = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    raw = [(t or "").encode() for _, t in rows]
    want = sorted((-1 if i is None else i, t or "", len(b), n, k, hashlib.sha256(kept).hexdigest())
                  for (i, t), b, (n, k, kept) in zip(rows, raw, brute(raw, length, keep_first)))
    assert got == want


def test_matches_brute_force(spark):
    rows = list(enumerate(texts()))
    check(spark, rows + [(None, rows[3][1]), (rows[5][0], rows[5][1]), (7, "q" * 900)])


@pytest.mark.parametrize("length,keep_first", [(400, False), (400, True), (200, False), (200, True), (64, True)])
def test_large_cores_are_divided(spark, monkeypatch, length, keep_first):
    monkeypatch.setattr(R, "CORE_STRINGS", 1)
    check(spark, list(enumerate(texts(2, 40))) + [(2**60 + 1, texts(2, 40)[4])] + [(None, texts(9, 1)[0])] * (not keep_first), length, keep_first)


@pytest.mark.parametrize("length", [400, 200])
def test_first_places_stay(spark, length):
    rows = list(enumerate(texts(5, 50)))
    random.Random(1).shuffle(rows)
    check(spark, rows + [(None, rows[3][1])], length, True)


def test_equal_rows_keep_what_the_first_keeps(spark):
    t = texts(4, 2)[0] + "tail " * 100
    df = spark.createDataFrame([(1, t), (1, t), (2, "x" + t)], "doc_id long, text string")
    got = {r.doc_id: r._n_removed for r in R.remove_repeats(df, keep_first=True).collect()}
    first = brute([t.encode(), ("x" + t).encode()], keep_first=True)
    assert got == {1: first[0][0], 2: first[1][0]}


def test_rows_without_id_are_told_apart(spark):
    """Texts with equal crc32 and no id: only the one with a repeat loses bytes."""
    rnd = random.Random(8)
    shared, clean = ("".join(rnd.choice("abcdefgh ") for _ in range(450)) for _ in range(2))
    want = zlib.crc32((shared + "tail-one").encode())

    def forged(prefix: bytes) -> bytes:
        """Four bytes behind ``prefix`` that bring its crc32 to ``want``."""
        base = [(zlib.crc32(bytes([b])) ^ zlib.crc32(b"\0")) for b in range(256)]
        top = {x >> 24: (b, x) for b, x in enumerate(base)}
        state, order = want ^ 0xFFFFFFFF, []
        for _ in range(4):
            b, x = top[state >> 24]
            order.append(b)
            state = (state ^ x) << 8 & 0xFFFFFFFF
        state = zlib.crc32(prefix) ^ 0xFFFFFFFF
        out = b""
        for b in order[::-1]:
            out += bytes([b ^ state & 255])
            state = state >> 8 ^ base[b]
        return out

    for k in range(10_000):  # until the four bytes are plain characters
        text = f"{clean}{k}".encode()
        text += forged(text)
        if all(32 < c < 127 for c in text[-4:]):
            break
    assert zlib.crc32(text) == want
    rows = [(None, shared + "tail-one"), (None, text.decode()), (5, shared)]
    check(spark, rows)


def test_empty_and_text_of_pipeline(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert R.remove_repeats(empty).collect() == []
    t = "é" * 300 + "w" * 300
    df = spark.createDataFrame([(1, t), (2, "keep " + t), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in R.drop_repeats(df).collect()} == {1: "", 2: "keep ", 3: None}
