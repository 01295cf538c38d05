import math
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from seqlens.llm import hybridrank as H
from tests.conftest import SF001


def words(t):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute(docs, items, k):
    docs = [(i, Counter(words(t))) for i, t in docs if words(t)]
    n, total = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(w for _, c in docs for w in c)
    asked = {}
    for i, t in items:
        if i is not None:
            asked.setdefault(i, set()).update(words(t))
    out = []
    for q, terms in asked.items():
        found = []
        for i, c in docs:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * c[w] // (1000 * c[w] + 20 * m))
                    for w in terms if w in c)
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(q, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(n=700):
    rnd = random.Random(6)
    vocab = [f"t{i}é" if i % 7 == 0 else f"T{i}" for i in range(900)]
    pick = lambda: vocab[min(int(rnd.expovariate(.02)), 899)]
    text = lambda a, b: " ".join(pick() + rnd.choice(["", ".", "_x", "\x00"]) for _ in range(rnd.randint(a, b)))
    docs = [(i, text(1, 90)) for i in range(n)]
    docs += [(n, docs[0][1]), (n + 1, None), (n + 2, ""), (n + 3, "T1 " * 70_000), (None, docs[5][1]), (7, docs[5][1]), (2**60 + 1, docs[5][1])]
    items = [(j, text(3, 40)) for j in range(25)] + [(25, docs[5][1]), (25, "T3"), (None, "T1 T2"), (26, None), (27, ""), (28, "nowhere"),
                                                    (29, " ".join(vocab))]
    return docs, items


@pytest.mark.parametrize("k,shard,window,short", [(50, 8192, 2048, 32), (5, 90, 16, 4), (3, 700, 64, 1), (1000, 100, 32, 10**6)])
def test_matches_brute_force(spark, monkeypatch, k, shard, window, short):
    docs, items = corpus()
    made = []
    ids, terms = zip(*[(i, t) for (i, _), t in zip(docs, H.term_hashes([(t or "").encode() for _, t in docs])) if len(t)])
    monkeypatch.setattr(H, "WINDOW", window)
    monkeypatch.setattr(H, "SHORT", short)
    for a in range(0, len(ids), shard):
        made.append(H.build_shard(ids[a:a + shard], terms[a:a + shard]))
    n, total = len(ids), sum(map(len, terms))
    df = Counter(x for t in terms for x in set(t.tolist()))
    rows = {}
    import numpy as np
    import pandas as pd
    for i, t in items:
        if i is not None:
            rows.setdefault(i, set()).update(H.term_hashes([(t or "").encode()])[0].tolist())
    table = pd.DataFrame([(i, np.uint64(x).view(np.int64), math.floor(1000 * math.log((2 * n + 2) / (2 * df[x] + 1))))
                          for i, s in rows.items() for x in s if x in df], columns=["item", "term", "w"])
    block = H._block((0,), table).iloc[0].to_dict()
    got = []
    for f in H._search(n, total, k)(iter([pd.DataFrame([m | block for m in made])])):
        got += [(int(r.item_id), -int(r.score), r.doc_id is pd.NA, 0 if r.doc_id is pd.NA else int(r.doc_id)) for r in f.itertuples()]
    want = sorted((q, -s, i is None, i or 0) for q, _, i, s in brute(docs, items, k))
    assert sorted(got) == want


@pytest.mark.parametrize("broadcast,block", [(10**6, 65_536), (0, 60)])
def test_frame(spark, monkeypatch, broadcast, block):
    monkeypatch.setattr(H, "BROADCAST_TERMS", broadcast)
    monkeypatch.setattr(H, "BLOCK_TERMS", block)
    docs, items = corpus(300)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("id", F.lit(1)).repartition(3)
    it = spark.createDataFrame(items, "item_id long, text string").withColumn("rank", F.lit("clash")).repartition(2)
    got = [tuple(r) for r in H.rank_documents(df, it, 20).collect()]
    assert sorted(got, key=str) == sorted(brute(docs, items, 20), key=str)


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    asks = spark.createDataFrame([(1, "b")], "item_id long, text string")
    assert H.rank_documents(docs, asks).collect() == [] and H.rank_documents(some, items).collect() == []
    assert H.rank_documents(some.where("doc_id = 2"), asks).collect() == []
    assert [tuple(r) for r in H.rank_documents(some, asks).collect()] == brute([(1, "a b")], [(1, "b")], 5)


def test_sql_twin(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF001}/{t}.parquet'")
    want = sorted(con.execute(H.SQL).fetchall())
    got = H.rank_documents(spark.read.parquet(f"{SF001}/documents.parquet"), spark.read.parquet(f"{SF001}/benchmark.parquet"))
    assert sorted(tuple(r) for r in got.collect()) == want
