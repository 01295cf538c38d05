import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlens.llm import orcids, packing
from seqlens.llm.tokens import ChunkIds, tokenizer_path

TEXTS = ["", "one", " lead", "trail  ", "a  b\n\n c\t\td", "don't  stop　now\x85x\xa0y", "é́ ΑΣ ΑΣ. Σ", "x" * 5000,
         "<|endoftext|> <|startoftext|>hi", "\n\n\n", " \n \t ", "日本 語 12345 67", "a\x1cb \x1f c​d", "tab\t word",
         "word " * 20000, "!!! ??? '' 's 're", " para  x y", "\x00 nul", "﻿bom é"]
TEXTS += ["a<|endoftext|>b <|endoftext|>", "<|startoftext|>", "x <| endoftext|> <|y|>"]
TEXTS += ["\u0130stanbul \u0130. \u01c5 \ufb01 x\u00b2 \u00bd. a\u00b7b", "Word word, WORD; na\u00efve. Stra\u00dfe! \u6771\u4eac. \u0661\u0662\u0663, x.",
          "it's. can't, 'Tis; y'all'd.", "\u0930\u093e\u092e, \u0e44\u0e17\u0e22. e\u0301. ok"]
DOCS = [(i, t) for i, t in enumerate(TEXTS)] + [(None, None), (None, "no id"), (2, "again"), (1, "one")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_chunks_equal_whole_texts(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    chunks = ChunkIds(tokenizer_path(name), limit=5)
    for x in TEXTS + TEXTS[::-1]:
        assert np.frombuffer(chunks.encode(x), np.uint32).tolist() == t.encode(x, add_special_tokens=False).ids


def test_broken_utf8_and_batches():
    t = Tokenizer.from_file(tokenizer_path("byte_bpe_50k.json"))
    raw = [b"ok text", b"\xff broken \xc3", None, b"", "nbsp\u00a0x".encode(), b"tail\xe2\x80", b"word \xf0\x9f"] * 3
    got = ChunkIds(tokenizer_path("byte_bpe_50k.json")).encode_many(raw)
    for x, g in zip(raw, got):
        assert np.frombuffer(g, np.uint32).tolist() == t.encode((x or b"").decode("utf-8", "replace"), add_special_tokens=False).ids


def whole(name, end=2):
    t = Tokenizer.from_file(tokenizer_path(name))
    return [(i, t.encode(x or "", add_special_tokens=False).ids + [end]) for i, x in DOCS]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_assign_is_balanced_and_whole():
    rng = np.random.default_rng(0)
    sizes = [int(x) for x in rng.integers(1, 9000, 300)] + [4096, 8192, 1, 1]
    rows = packing.assign(sizes)
    seqs = {}
    for d, s, n, q, o in rows:
        seqs.setdefault(q, []).append((o, n, d, s))
    for q, ps in seqs.items():
        ps.sort()
        assert [p[0] for p in ps] == list(np.cumsum([0] + [p[1] for p in ps])[:-1])
        total = sum(p[1] for p in ps)
        assert total == 4096 or total & (total - 1) == 0
    got = sorted((d, s, n) for d, s, n, _, _ in rows)
    for d, size in enumerate(sizes):
        ps = [(s, n) for e, s, n in got if e == d]
        assert [s for s, _ in ps] == list(np.cumsum([0] + [n for _, n in ps])[:-1]) and sum(n for _, n in ps) == size
    cost = [sum(p[1] + p[1] ** 2 / 4096 for p in ps) for ps in seqs.values() if len(ps) > 1 and sum(p[1] for p in ps) == 4096]
    assert np.std(cost) < .2 * np.mean(cost)
    assert packing.assign([]) == [] and packing.assign([1]) == [(0, 0, 1, 0, 0)]


def test_pack(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_TOKENS", 3000)
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("length", F.lit("clash")).repartition(3)
    out = packing.pack(df).collect()
    want = sorted(((i, len(x), crc(x)) for i, x in whole("word_bpe_49k.json")), key=str)
    ids = {(i, len(x), x[0]): x for i, x in whole("word_bpe_49k.json")}
    by_seq = {}
    for r in out:
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
        by_seq.setdefault(r.sequence_id, []).append(r)
    for rs in by_seq.values():
        rs.sort(key=lambda r: r.offset)
        assert [r.offset for r in rs] == list(np.cumsum([0] + [r.length for r in rs])[:-1])
    docs = {}
    for r in out:
        docs.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    assert {k for k in docs} == {(i, n) for i, n, _ in want}
    for (i, n), rs in docs.items():
        copies = sum(1 for w in want if w[:2] == (i, n))
        assert sum(r.length for r in rs) == n * copies
        if copies == 1:
            x = b"".join(r.ids for r in sorted(rs, key=lambda r: r.start))
            assert (i, n, zlib.crc32(x)) in want
    assert ids and packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    assert "ids" not in packing.pack(df, with_ids=False).columns


def test_orc_round_trip(spark, tmp_path):
    df = spark.createDataFrame(DOCS, "doc_id long, text string").withColumn("ids", F.lit("clash"))
    path = f"file://{tmp_path}/ids"
    got = orcids.ids_through_files(df, path)
    rows = got.collect()
    want = sorted((("" if i is None else i, len(x), crc(x)) for i, x in whole("byte_bpe_50k.json")), key=str)
    assert sorted((("" if r.doc_id is None else r.doc_id, r.n_tokens, r.ids_crc32) for r in rows), key=str) == want
    rows.sort(key=lambda r: r.start)
    assert [r.start for r in rows] == list(np.cumsum([0] + [r.n_tokens for r in rows])[:-1])
    order = [-1 if r.doc_id is None else r.doc_id for r in rows]
    assert order == sorted(order)
    one = orcids.read_ids(spark, path).where("doc_id = 11")
    assert one.collect()[0].ids == dict(whole("byte_bpe_50k.json"))[11]
    assert "EqualTo(doc_id,11)" in one._jdf.queryExecution().toString()
    assert orcids.ids_through_files(spark.createDataFrame([], "doc_id long, text string"), f"{path}-none").collect() == []
