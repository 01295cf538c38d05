"""Distributed metrics against brute force on small random fixtures."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqlens.operators import metrics as M
from seqlens.operators import threshold as T
from seqlens.operators.corr import spearman_matrix
from seqlens.operators.ranking import RANGES, average_ranks, cumulative, quantiles, value_ranges


def brute_ap(y, p):
    order = sorted(set(p), reverse=True)
    P = sum(y)
    ap, prev_r = 0.0, 0.0
    for t in order:
        tp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 1)
        fp = sum(1 for yi, pi in zip(y, p) if pi >= t and yi == 0)
        r = tp / P
        ap += (r - prev_r) * tp / (tp + fp)
        prev_r = r
    return ap


def brute_auc(y, p):
    pos = [pi for yi, pi in zip(y, p) if yi == 1]
    neg = [pi for yi, pi in zip(y, p) if yi == 0]
    s = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg)
    return s / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(7)
    n = 400
    p = np.round(rng.random(n), 2)          # many ties
    y = (rng.random(n) < p * 0.3).astype(int)
    rows = [(int(a), float(b), "m1" if i % 2 else "m2") for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, "y int, p double, model string"), rows


def test_ap_and_auc_match_brute_force(scores):
    df, rows = scores
    for m in ("m1", "m2"):
        y = [r[0] for r in rows if r[2] == m]
        p = [r[1] for r in rows if r[2] == m]
        got_ap = {r["model"]: r["average_precision"] for r in M.average_precision(df, "model").collect()}[m]
        got_auc = {r["model"]: r["roc_auc"] for r in M.roc_auc(df, "model").collect()}[m]
        assert got_ap == pytest.approx(brute_ap(y, p), abs=1e-12)
        assert got_auc == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_auc_null_for_one_score_or_one_class(spark):
    one_score = spark.createDataFrame([(0, 0.3), (1, 0.3)], "y int, p double")
    assert M.roc_auc(one_score).first()[0] is None
    one_class = spark.createDataFrame([(0, 0.3), (0, 0.5)], "y int, p double")
    assert M.roc_auc(one_class).first()[0] is None
    assert M.average_precision(one_class).first()[0] is None


def test_threshold_f1_lowest_on_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, p double")
    pts = M.pr_points(df)
    best = T.threshold_f1(pts).first()
    # F1 at 0.9: 2*1*.5/1.5 = .667; at 0.7: 2*(2/3)*1/(5/3) = .8 -> threshold 0.7
    assert best["threshold"] == 0.7
    r = T.threshold_recall_target(pts, 0.6).first()
    assert r["policy"] == "recall_target" and r["threshold"] == 0.7
    f = T.threshold_recall_target(pts, 1.5).first()
    assert f["policy"] == "fbeta2_fallback"


def test_cumulative_matches_cumsum(spark):
    rng = np.random.default_rng(3)
    vals = rng.choice(10000, 500, replace=False)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame([(int(a), int(b), int(a) % 3) for a, b in zip(vals, w)], "v long, w long, g int")
    got = {(r["g"], r["v"]): r["cum_w"] for r in cumulative(df, "v", ["w"], by=["g"]).collect()}
    for g in range(3):
        sub = sorted((int(a), int(b)) for a, b in zip(vals, w) if int(a) % 3 == g)
        run = 0
        for a, b in sub:
            run += b
            assert got[(g, a)] == run


@pytest.mark.parametrize("kind", ["long", "double", "string", "date", "timestamp", "struct"])
@pytest.mark.parametrize("descending", [False, True])
def test_cumulative_of_every_kind(spark, kind, descending):
    """Nulls, NaN, infinities, common prefixes, null groups and totals."""
    values = [None, "-inf", "-3.5", "0", "1e-9", "2", "1e17", "inf", "nan"] if kind == "double" else [None, *map(str, range(-40, 400, 3))]
    df = spark.createDataFrame([(v, g, i + 1) for i, v in enumerate(values) for g in ("a", None)], "s string, g string, w int")
    v = {"long": F.col("s").cast("long"), "double": F.col("s").cast("double"), "string": F.concat(F.lit("prefix-"), "s"),
         "date": F.date_add(F.lit("2020-01-01").cast("date"), F.col("s").cast("int")), "timestamp": F.timestamp_micros(F.col("s").cast("long")),
         "struct": F.struct(F.floor(F.col("s").cast("int") / 50).alias("x"), F.col("s").cast("int").alias("y"))}[kind]
    df = df.withColumn("v", v)
    out = cumulative(df, "v", ["w"], by=["g"], descending=descending, totals=True)
    got = out.collect()
    from pyspark.sql import Window
    o = F.col("v").desc() if descending else F.col("v").asc()
    want = df.withColumn("c", F.sum("w").over(Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, 0))).collect()
    assert {(r.g, r.s): r.cum_w for r in got} == {(r.g, r.s): r.c for r in want} and len(got) == 2 * len(values)
    assert {r.all_w for r in got} == {sum(range(1, len(values) + 1))}


def test_ranges_are_even(spark):
    df = spark.range(20_000).select(F.pow(F.col("id") / 1000.0, 9).alias("v"))
    plan = cumulative(df.withColumn("w", F.lit(1)), "v", ["w"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in plan and "Range" in plan  # nothing is written out
    sizes = [r["count"] for r in value_ranges(df, "v").groupBy("_range").count().collect()]
    assert len(sizes) > RANGES * .9 and max(sizes) <= 4 * 20_000 / RANGES


def test_spearman_with_nulls_matches_pandas(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"a": rng.integers(0, 9, 300).astype(float), "b": rng.normal(size=300).round(1), "c": rng.normal(size=300), "d": rng.normal(size=300)})
    x.loc[rng.random(300) < .3, "b"] = np.nan
    x.loc[rng.random(300) < .2, "c"] = np.nan
    x["d"] += x["a"]
    rows = [tuple(None if v != v else float(v) for v in r) for r in x.itertuples(index=False)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double")
    want = x.corr(method="spearman")
    got = {(r.a, r.b): r.spearman for r in spearman_matrix(df, list("abcd")).collect()}
    assert len(got) == 16 and all(got[p, q] == pytest.approx(want.loc[p, q], abs=1e-9) for p in "abcd" for q in "abcd")


def test_average_ranks_ties(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (3.0,)], "x double")
    got = {r["value"]: r["rank"] for r in average_ranks(df, ["x"]).collect()}
    assert got == {1.0: 1.0, 2.0: 2.5, 3.0: 4.0}


def test_quantiles_match_numpy(spark):
    rng = np.random.default_rng(11)
    x = np.round(rng.normal(size=301), 1)
    g = rng.integers(0, 3, 301)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(x, g)], "x double, g int")
    qs = [0.01, 0.25, 0.5, 0.75, 0.99]
    got = {(r["g"], r["q"]): r["value"] for r in quantiles(df, ["x"], qs, by=["g"]).collect()}
    for gi in range(3):
        arr = x[g == gi]
        for q in qs:
            assert got[(gi, q)] == pytest.approx(float(np.quantile(arr, q)), abs=1e-9)


def test_brier_and_threshold_metrics(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.6), (1, 0.2), (0, 0.1)], "y int, p double")
    assert M.brier(df).first()[0] == pytest.approx((0.01 + 0.36 + 0.64 + 0.01) / 4)
    t = M.threshold_metrics(df, 0.5).first()
    assert (t["precision"], t["recall"]) == (0.5, 0.5)
    none = M.threshold_metrics(df, 2.0).first()
    assert (none["precision"], none["recall"], none["f1"]) == (0.0, 0.0, 0.0)


def test_quantiles_are_found_in_brackets(spark, monkeypatch):
    """Rows are neither counted by value nor ordered whole; a bracket that misses is made up for."""
    from seqlens.operators import ranking as R
    rng = np.random.default_rng(3)
    xs = {g: np.round(rng.normal(size=9000) ** 3, 2 + 4 * g) for g in (0, 1)}
    rows = [(g, float(v), None if i % 3 else float(i % 5)) for g in xs for i, v in enumerate(xs[g])] + [(None, 4.0, None), (2, None, None)]
    df = spark.createDataFrame(rows, "g int, x double, t double")
    want = {(g, q): float(np.quantile(xs[g], q)) for g in xs for q in (0.0, 0.25, 0.99)} | {(None, q): 4.0 for q in (0.0, 0.25, 0.99)}
    tied = np.array([float(i % 5) for i in range(0, 9000, 3)])

    def check():
        got = {(r["g"], r["column"], r["q"]): r["value"] for r in R.quantiles(df, ["x", "t"], [0.0, 0.25, 0.99], by=["g"]).collect()}
        assert {(g, q): v for (g, c, q), v in got.items() if c == "x"} == pytest.approx(want, abs=1e-12)
        assert got[0, "t", 0.25] == got[1, "t", 0.25] == np.quantile(tied, 0.25)

    counted, plain = [], R.value_counts_long
    monkeypatch.setattr(R, "value_counts_long", lambda *a: counted.append(a) or plain(*a))
    check()
    monkeypatch.setattr(R, "_FEW", 0)
    check()
    assert not counted
    # a sketch that is far off
    off = R.F.percentile_approx
    monkeypatch.setattr(R.F, "percentile_approx", lambda c, s, a: off(c, [1.0] * len(s) if isinstance(s, list) else s, a))
    check()
    assert counted


def test_quantiles_of_infinite_values(spark):
    df = spark.createDataFrame([(float(v),) for v in ("-inf", "1", "2", "inf", "nan")], "x double")
    got = {r["q"]: r["value"] for r in quantiles(df, ["x"], [0.0, 0.25, 0.5, 0.75]).collect()}
    assert got[0.25] == 1.0 and all(np.isnan(got[q]) for q in (0.5, 0.75)), got  # 2 + 0 * (inf - 2), inf + 0 * (nan - inf)
    assert not quantiles(df.limit(0), ["x"], [0.5]).collect()


def test_ranges_without_bounds_in_rows(spark):
    df = spark.range(1000).select(F.col("id").cast("double").alias("x"))
    plan = value_ranges(df, "x")._jdf.queryExecution().executedPlan().toString()
    assert "lambda" not in plan  # such projections copy the bounds into every row


def test_split_sequences_are_read_once(spark):
    from seqlens.operators.halo import with_neighbours
    rows = spark.createDataFrame([("a", "b", 1, i) for i in range(40)], "driver string, race string, yr int, lap int")
    plan = with_neighbours(rows.where("lap < 99"), after=1, hot_rows=10)[0]._jdf.queryExecution().executedPlan().toString()
    assert "lap#" in plan and "< 99" not in plan
