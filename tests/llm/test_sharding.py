import random
import zlib

import pytest
from pyspark.sql import functions as F

from seqlens.llm.sharding import kd_shards
from tests.conftest import SF001


def rows(n=700):
    rnd = random.Random(4)
    out = []
    for i in range(n):
        hot = rnd.random() < .4
        t = "hot copy " * 20 if hot and rnd.random() < .6 else rnd.choice(["", None, "é" * rnd.randint(1, 900)])
        out.append((i, t, rnd.choice(["en", "de", None]), "src0" if hot else f"s{rnd.randint(1, 9)}",
                    None if rnd.random() < .1 else len(t or "")))
    return out + [(None, "null id", "en", "src0", 7), (3, "again", "en", "src0", 5), (3, "again", "en", "src0", 5)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def laws(out, src, shards):
    got = sorted(((r.doc_id, r.size, r.text_crc32) for r in out), key=str)
    want = sorted(((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in src), key=str)
    assert got == want
    by = {s: [] for s in range(shards)}
    for r in out:
        by[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None
    for s, rs in by.items():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    sizes = [sum(r.size for r in rs) for rs in by.values()]
    largest = max(r.size for r in out)
    return sizes, largest


@pytest.mark.parametrize("shards", [16, 5, 1])
def test_sizes_slots_and_bytes(spark, shards):
    src = rows()
    df = spark.createDataFrame(src, SCHEMA).withColumn("node", F.lit(9)).withColumn("size", F.lit("x"))
    sizes, largest = laws(kd_shards(df, ["lang", "source", "n_chars", "doc_id"], shards).collect(), src, shards)
    assert max(sizes) - min(sizes) <= 8 * largest and all(sizes)


def test_weighted_median_on_one_dimension(spark):
    src = [(i, "x" * (i % 50), "en", "s", i) for i in range(999)]
    out = kd_shards(spark.createDataFrame(src, SCHEMA), ["n_chars"], 2).collect()
    left = [r.doc_id for r in out if r.shard == 0]
    assert sorted(left) == list(range(len(left)))  # a cut along the dimension
    sizes, largest = laws(out, src, 2)
    assert abs(sizes[0] - sizes[1]) <= largest


def test_target_bytes_copies_and_empty(spark):
    same = [(i, "copy" * 30, "en", "s", 120) for i in range(600)]  # nothing to tell rows apart but the salt
    df = spark.createDataFrame(same, SCHEMA)
    out = kd_shards(df, ["lang", "source", "n_chars"], target_bytes=121 * 75).collect()
    sizes, _ = laws(out, same, 8)
    assert max(sizes) < 1.5 * min(sizes)
    assert kd_shards(spark.createDataFrame([], SCHEMA), ["lang"], 16).collect() == []


def test_plan_has_no_python(spark):
    df = kd_shards(spark.read.parquet(f"{SF001}/documents.parquet"), ["lang", "source", "n_chars", "doc_id"], 4)
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan
