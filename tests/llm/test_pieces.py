import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm.pieces import ChunkPaths, Lattice, decode, nbest_segmentations
from seqlens.llm.tokens import tokenizer_path


@pytest.fixture(scope="module")
def lattice():
    return Lattice(tokenizer_path("piece_bpe_32k.model"))


def brute(lattice, s):
    """All segmentations of a lattice string, by recursion: (score, ids)."""
    if not s:
        return [(0.0, ())]
    out = []
    for k in range(1, len(s) + 1):
        hit = lattice.pieces.get(s[:k])
        if hit:
            out += [(hit[1] + a, (hit[0],) + b) for a, b in brute(lattice, s[k:])]
    if s[0] not in lattice.pieces:
        ids = tuple(lattice.bytes[b] for b in s[0].encode())
        out += [(lattice.unknown + a, ids + b) for a, b in brute(lattice, s[1:])]
    return out


def ids_of(raw):
    return tuple(np.frombuffer(raw, np.uint32).tolist())


def test_chunk_and_text_against_all_paths(lattice):
    rnd = random.Random(1)
    texts = ["a", "ab", " a", "a  b", "the in", "x\ny", "\n", " ", "aaaaaaa", "né é", "日本", "t\x00q", "ꙮa", "er he on"]
    texts += ["".join(rnd.choice("therino a") for _ in range(rnd.randint(1, 10))) for _ in range(60)]
    for n in (1, 2, 5):
        paths = ChunkPaths(lattice, n)
        for t in texts:
            every = brute(lattice, "▁" + t.replace(" ", "▁"))
            got = paths.nbest(t)
            want = sorted((s for s, _ in every), reverse=True)[:n]
            assert [s for s, _ in got] == pytest.approx(want)
            assert len({ids for _, ids in got}) == len(got)
            legal = {ids: s for s, ids in every}
            assert all(legal[ids_of(raw)] == pytest.approx(s) for s, raw in got)


def test_forward_scores_keep_the_search_small(lattice):
    assert len(lattice.nbest("▁" + "a" * 3000, 4)) == 4  # ties everywhere


def test_frame(spark):
    rows = [(1, "Hello  world,\n\tÅé 日本語"), (2, ""), (3, None), (None, "no id"), (4, "aaaa " * 4000), (4, "twice"),
            (5, "literal ▁ mark")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash"))
    out = nbest_segmentations(df, 3)
    got = decode(out).collect()
    for r in got:
        assert r.rank == 1 or r.doc_id not in (2, 3)
        assert bytes(r.decoded).decode() in [(t or "").replace("▁", " ") for i, t in rows if i == r.doc_id]
    assert {(r.doc_id, r.round_trip) for r in got} >= {(1, True), (2, True), (3, True), (None, True), (5, False)}
    scores = [r.score for r in sorted(got, key=lambda r: r.rank) if r.doc_id == 1]
    assert len(scores) == 3 and scores == sorted(scores, reverse=True)
    assert nbest_segmentations(spark.createDataFrame([], "doc_id long, text string")).collect() == []
