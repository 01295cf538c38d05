import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from seqlens.llm import prefixbpe
from seqlens.llm.tokens import tokenizer_path
from tests.llm.test_tokens import DOCS, TEXTS


def odd_texts():
    rnd = random.Random(1)
    made = ["".join(rnd.choice("aabcetx zé漢🙂'.!\n01") for _ in range(rnd.randint(0, 200))) for _ in range(500)]
    return TEXTS + made + [c * n for c in ("a", "ab", "=", "xx y") for n in range(1, 120)]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_equals_the_library(name):
    t = Tokenizer.from_file(tokenizer_path(name))
    mine = prefixbpe.PrefixIds(tokenizer_path(name), limit=100)
    texts = odd_texts()
    for x, got in zip(texts, mine.encode_many([x.encode() for x in texts])):
        want = t.encode(x, add_special_tokens=False).ids
        assert np.frombuffer(got, np.uint32).tolist() == want
        assert mine.decode(got).decode() == t.decode(want, skip_special_tokens=False)


def plain_bpe(symbols, ranks):
    """Merges of the lowest rank, from the left, one at a time."""
    s = list(symbols)
    while True:
        best = min(((ranks.get((a, b), 10**9), i) for i, (a, b) in enumerate(zip(s, s[1:]))), default=(10**9, 0))
        if best[0] == 10**9:
            return s
        s[best[1]:best[1] + 2] = [s[best[1]] + s[best[1] + 1]]


def test_every_prefix_of_small_vocabularies():
    """Random merges (some tokens can't be reached), all prefixes and the compatibility of all pairs."""
    for seed in range(40):
        rnd = random.Random(seed)
        letters = prefixbpe.byte_letters()
        vocab, merges, tokens = {c: i for i, c in enumerate(letters)}, [], ["a", "b", "c"]
        while len(merges) < 14:
            pair = rnd.choice(tokens), rnd.choice(tokens)
            if "".join(pair) not in vocab:
                vocab["".join(pair)] = len(vocab)
                tokens.append("".join(pair))
                merges.append(pair)
        model = prefixbpe.Merges(vocab, merges, "")
        ranks = {p: r for r, p in enumerate(merges)}
        name = {i: t for t, i in vocab.items()}
        good = [t for t in tokens if plain_bpe(t, ranks) == [t]]
        for a in good:
            for b in good:
                alone = bool(model.compatible(np.array([vocab[a]]), np.array([vocab[b]]))[0])
                assert alone == (plain_bpe(a + b, ranks) == [a, b]), (seed, a, b)
        words = ["".join(rnd.choice("aabbc") for _ in range(rnd.randint(0, 70))) for _ in range(60)]
        for w, ids in zip(words, model.encode([w.encode() for w in words])):
            assert [name[i] for i in ids.tolist()] == plain_bpe(w, ranks), (seed, w)


def test_frame(spark):
    t = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    big = 2**60 + 1
    rows = DOCS + [(big, "large id"), (None, "large id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).withColumn("id", F.lit(1)).repartition(3)
    want = []
    for i, x in rows:
        ids = t.encode(x or "", add_special_tokens=False).ids
        text = t.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = prefixbpe.encode_decode(df)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for r in prefixbpe.encode_decode(df, with_data=True).collect():
        assert hashlib.sha256(r.ids).hexdigest() == r.ids_sha256 and hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256
    assert prefixbpe.encode_decode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
