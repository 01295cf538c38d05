from pyspark.sql import functions as F

from seqlens.operators import buckets as B
from seqlens.operators import metrics as M
from seqlens.operators import profile as P
from seqlens.operators import score as SC


def test_coerce_rows_takes_defaults_and_rounds_half_even(spark):
    df = spark.createDataFrame([(None, 2.5, None), ("B", 3.5, 7.0)], "compound string, lap double, life double")
    got = SC.coerce_rows(df, ["compound", "driver"], ["lap", "stint"], ["life"], {"compound": "A", "stint": 1.5, "life": 4.0}).collect()
    assert [tuple(r) for r in got] == [("A", "UNKNOWN", 2, 2, 4.0), ("B", "UNKNOWN", 4, 2, 7.0)]


def test_scenario_level_and_fallback_levels(spark, synthetic):
    levels = B.quantile_levels(synthetic, "cumulative_degradation")
    rows = synthetic.limit(1).select("race_progress", "tyre_life").crossJoin(
        spark.createDataFrame([("Low",), ("High",), ("odd",)], "asked string"))
    got = {r.asked: r.level_value for r in SC.scenario_rows(rows, synthetic, level="asked", levels=levels).collect()}
    want = {r.level: r.value for r in levels.collect()}
    assert got == {"Low": want["Low"], "High": want["High"], "odd": None}
    empty = B.quantile_levels(synthetic.limit(0), "cumulative_degradation", fallback={"Low": 0.5, "High": 2.0})
    assert {r.level: r.value for r in empty.collect()} == {"Low": 0.5, "Medium": None, "High": 2.0}


def test_best_by_roc(spark):
    c = spark.createDataFrame([("a", 0.7), ("b", 0.9), ("c", None)], "model string, roc_auc double")
    assert M.best_by_roc(c, "a").first()["model"] == "a"
    assert M.best_by_roc(c, "c").first()["model"] == "c"
    assert M.best_by_roc(c, "zz").first()["model"] == M.best_by_roc(c).first()["model"] == "b"


def test_numeric_bounds_fall_back_per_column(spark):
    df = spark.createDataFrame([(1.0, 5.0, None), (2.0, 5.0, None), (3.0, 5.0, None)], "x double, y double, z double")
    got = {r["column"]: (r.lo, r.hi, r.used_fallback) for r in B.numeric_bounds(df, {"x": (0, 1), "y": (0, 9), "z": (-1, 1)}).collect()}
    assert got == {"x": (1.02, 2.98, False), "y": (0.0, 9.0, True), "z": (-1.0, 1.0, True)}


def test_assert_no_null_and_approx_quantiles(spark, synthetic):
    import pytest

    from seqlens.operators.ranking import approx_quantile_wide, quantile_wide
    P.assert_no_null(synthetic, ["driver", "lap"])
    with pytest.raises(Exception):
        out = P.assert_no_null(synthetic, ["lap_time"])
        out.collect() if out is not None else None
    a = approx_quantile_wide(synthetic, ["position"], [0.5]).first()
    b = quantile_wide(synthetic, ["position"], [0.5]).first()
    assert abs(a["q50"] - b["q50"]) <= 2


def test_input_columns_without_the_present_ones(synthetic):
    wanted = set(synthetic.columns) | {"pit_stop", "next_stint"}
    assert wanted - set(synthetic.columns) == {"pit_stop", "next_stint"}
    assert synthetic.where(F.col("lap") < 0).columns == synthetic.columns
