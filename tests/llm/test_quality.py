import re
from collections import Counter

import duckdb
from pyspark.sql import functions as F

from seqlens.llm import quality as Q
from tests.conftest import SF001

TEXTS = ["", None, " \t\n ", "one two", "a b c d e f g h i j", "a b c d e a b c d e x",
         "the same line here\nthe same line here\n\n\n other #*$ line<>", "x " * 300, "é ñ 日本 " * 4,
         "\x0b\x0cfoo\x0dbar baz\x85qux quux corge grault garply waldo fred plugh", " ".join(map(str, range(9000)))]


def brute(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    win = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
    n = Counter(win)
    hit = {i + j for i, x in enumerate(win) if n[x] > 1 for j in range(5)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(hit),
            len(w) < 10 or 100 * len(hit) > 20 * len(w))


def test_base_rules(spark):
    rows = [(i, t, "h") for i, t in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit(1))
    got = {r.doc_id: tuple(r)[1:7] for r in Q.quality_rules(df).collect()}
    assert got == {i: brute(t) for i, t, _ in rows}


def test_host_verdict_shrinks(spark):
    good, bad = "a b c d e f g h i j k l", "x"
    rows = [(i, bad if i % 10 else good, "spam") for i in range(200)] + [(200 + i, good, f"s{i % 7}") for i in range(140)]
    rows += [(400, bad, "tiny"), (401, good, None), (402, bad, None), (403, good, "s1"), (403, good, "s1")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = Q.quality_rules(df)
    by = {r.host: r for r in Q.host_verdicts(out.join(df.select("doc_id", "source").distinct(), "doc_id")
                                             .select(F.col("source").alias("host"), "base_failed")).collect()}
    assert by["spam"].rejected and not by["s1"].rejected
    assert by["tiny"].shrunk_rate < 1.0 and 0 < by["s1"].shrunk_rate < 0.2
    kept = {r.doc_id: r.kept for r in out.collect()}
    assert not kept[0] and kept[200] and kept[401] and not kept[402] and out.where("doc_id = 403").count() == 2
    assert {r.doc_id for r in Q.keep_quality(df).collect()} == {i for i, k in kept.items() if k}


def test_salted_join_gives_the_same(spark, monkeypatch):
    df = spark.createDataFrame([(i, t, s) for i, t in enumerate(TEXTS) for s in ("u", None)],
                               "doc_id long, text string, source string")
    want = sorted(map(str, Q.quality_rules(df).collect()))
    monkeypatch.setattr(Q, "BROADCAST_HOSTS", 0)
    assert sorted(map(str, Q.quality_rules(df).collect())) == want
    kept = sorted(str(r) for r in want if "kept=True" in r)
    assert Q.keep_quality(df).count() == len(kept)


def test_empty(spark):
    assert Q.quality_rules(spark.createDataFrame([], "doc_id long, text string, source string")).collect() == []


def test_plan_has_no_python(spark):
    plan = Q.quality_rules(spark.read.parquet(f"{SF001}/documents.parquet"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def test_sql_twin(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF001}/documents.parquet'")
    rel = con.execute(Q.SQL)
    cols = [d[0] for d in rel.description]
    want = sorted(map(str, rel.fetchall()))
    got = sorted(str(tuple(r)) for r in Q.quality_rules(spark.read.parquet(f"{SF001}/documents.parquet")).select(cols).collect())
    assert got == want
