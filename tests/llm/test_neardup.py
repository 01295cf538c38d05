import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqlens.llm import neardup as N
from seqlens.llm.components import connected_components
from seqlens.llm.neardup import drop_near_duplicates, near_duplicates


def brute(rows, k, percent=80):
    """{id: (size, component)} by comparing all pairs."""
    import re
    sets = {}
    for i, t in rows:
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in (t or ""))
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets[i] = {tuple(w[j:j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    ids = sorted(sets)
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = find(ids[x]), find(ids[y])
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def corpus(n=260):
    rnd = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    rows, i = [], 0
    while len(rows) < n:
        base = [rnd.choice(vocab) for _ in range(rnd.randint(3, 120))]
        for _ in range(rnd.choice([1, 1, 1, 2, 6])):
            t = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 5])):
                t[rnd.randrange(len(t))] = rnd.choice(vocab)
            rows.append((i, rnd.choice([" ", "\n"]).join(t).upper() if rnd.random() < .2 else " ".join(t)))
            i += 1
    base = [rnd.choice(vocab) for _ in range(90)]  # a large group of copies at mixed distances from one text
    for _ in range(150):
        t = list(base)
        for _ in range(rnd.randint(0, 9)):
            t[rnd.randrange(len(t))] = rnd.choice(vocab)
        rows.append((i, " ".join(t)))
        i += 1
    rows += [(i, None), (i + 1, ""), (i + 2, " \t\n"), (i + 3, "one two"), (i + 4, "One  TWO"),
             (i + 5, "x " * 3000), (i + 6, "x " * 9000), (i + 7, "é" * 50)]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("k", [4, 5])
def test_matches_brute_force(spark, k):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("c", F.lit("clash")).withColumn("n", F.lit(1))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(df, words=k).collect()}
    assert got == brute(rows, k)


def test_kept_rows_repeats_and_nulls(spark):
    t = "a b c d e f g h"
    df = spark.createDataFrame([(5, t), (3, t), (3, t), (None, t), (None, "p q r s t"), (9, "z z z z z z z")],
                               "doc_id long, text string")
    out = near_duplicates(df).collect()
    assert sorted((r.component_id, r.kept) for r in out if r.doc_id == 3) == [(3, True), (3, True)]
    assert [(r.component_id, r.kept) for r in out if r.doc_id == 5] == [(3, False)]
    assert sorted(((r.component_id, r.kept) for r in out if r.doc_id is None), key=str) == [(3, False), (None, True)]
    left = drop_near_duplicates(df.withColumn("root", F.lit(1)))
    assert left.columns == ["doc_id", "text", "root"]
    assert {r.doc_id for r in left.collect()} == {3, 9, None}


def test_one_row_of_each_group_stays(spark):
    t, u = "a b c d e f g h", "p q r s t u v w"
    own = [f"{x}1 {x}2 {x}3 {x}4 {x}5 {x}6" for x in "klmn"]
    rows = [(1, t, 0), (1, t, 1), (2, t, 2), (None, t, 3), (None, u, 4), (None, u, 5), (2, own[0], 6), (4, own[1], 7),
            (4, own[2], 8), (None, own[3], 9), (None, None, 10), (None, None, 11), (8, "", 12), (8, "", 13)]
    df = spark.createDataFrame(rows, "doc_id long, text string, h int")
    left = drop_near_duplicates(df)
    assert left.columns == df.columns
    got = sorted(r.h for r in left.collect())
    assert len([x for x in got if x < 2]) == 1 and len([x for x in got if x in (4, 5)]) == 1
    assert [x for x in got if x not in (0, 1, 4, 5)] == [6, 7, 8, 9, 10, 11, 12, 13]


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_components_chain_and_star(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101 + i) for i in range(30)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(31)}} or got == {
        **{i: 0 for i in range(1, 41)}, **{101 + i: 100 for i in range(30)}}


def test_parity_bits_bound_the_difference():
    rng = np.random.default_rng(4)
    sets = [np.unique(rng.integers(0, 2**63, k, dtype=np.uint64)) for k in (1, 5, 60, 400, 5000)]
    sets += [np.unique(np.concatenate([s[len(s) // 3:], sets[0]])) for s in sets]
    bits = N._parity(sets)
    assert bits.shape == (len(sets), N.WORDS)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            apart = sum(int(x).bit_count() for x in np.bitwise_xor(bits[i], bits[j]).view(np.uint64))
            assert apart <= len(np.setxor1d(a, b)) and (apart == 0) >= (i == j)
