import functools
import random

import pytest
from pyspark.sql import functions as F

from seqlens.operators import label as L
from seqlens.operators.halo import with_neighbours
from seqlens.operators.temporal import add_temporal_features, add_temporal_features_split, temporal_feature_names


def rows(df, driver):
    return [r.asDict() for r in df.where(F.col("driver") == driver).orderBy("lap").collect()]


def test_feature_names_are_17(spark):
    assert len(temporal_feature_names()) == 17


def test_hand_checked_values(synthetic):
    out = add_temporal_features(synthetic)
    k = rows(out, "kestrel")
    assert [r["lap_time_lag1"] for r in k] == [0, 70.5, 71.25, 0, 74]          # a null lag is filled with 0
    assert [r["lap_time_lag2"] for r in k] == [0, 0, 70.5, 71.25, 0]
    assert [r["lap_time_lag3"] for r in k] == [0, 0, 0, 70.5, 71.25]
    assert [r["lap_time_rolling_mean_3"] for r in k] == [0, 70.5, 70.875, 70.875, 72.625]
    assert [r["lap_time_diff_from_rolling_mean3"] for r in k] == [0, 0.75, 0, 3.125, 0.375]
    assert [r["compound_changed_last_lap"] for r in k] == [0, 0, 1, 0, 1]      # null against B is a change
    assert [r["lap_history_count"] for r in k] == [0, 1, 2, 3, 3]
    std = [r["lap_time_rolling_std_3"] for r in k]
    assert std[:2] == [0, 0]
    assert std[2:] == pytest.approx([0.75 / 2 ** .5, 0.75 / 2 ** .5, 2.75 / 2 ** .5])
    assert [r["position_lag1"] for r in k] == [0, 9, 9, 8, 10]
    assert [r["position_change_lag1"] for r in k] == [0, 0, 0, -1, 2]
    assert k[4]["cumulative_degradation_rolling_mean_3"] == pytest.approx((0.75 + 0.75 + 3.5) / 3)
    p = rows(out, "plover")
    assert p[0]["lap_time_lag1"] == 0 and p[0]["lap_history_count"] == 0
    # sequence boundary: plover's first step never sees kestrel's
    assert p[1]["lap_time_lag1"] == 64.0 and p[2]["lap_time_rolling_mean_3"] == 65.0


def test_no_nulls_after_fill(synthetic):
    out = add_temporal_features(synthetic)
    names = temporal_feature_names()
    nulls = out.select(*[F.sum(F.col(c).isNull().cast("int")).alias(c) for c in names]).first()
    assert all(nulls[c] == 0 for c in names)


def test_causality_future_change_does_not_move_past(synthetic):
    base = add_temporal_features(synthetic)
    changed = synthetic.withColumn("lap_time", F.when((F.col("driver") == "kestrel") & (F.col("lap") == 3),
                                                      F.lit(500.0)).otherwise(F.col("lap_time")))
    alt = add_temporal_features(changed)
    names = temporal_feature_names()
    a = {r["lap"]: r for r in rows(base, "kestrel")}
    b = {r["lap"]: r for r in rows(alt, "kestrel")}
    for lap in (1, 2):
        assert all(a[lap][n] == b[lap][n] for n in names)


def test_null_value_inside_window(spark, synthetic):
    d = synthetic.withColumn("lap_time", F.when((F.col("driver") == "kestrel") & (F.col("lap") == 2), None)
                             .otherwise(F.col("lap_time")))
    k = rows(add_temporal_features(d), "kestrel")
    # mean over the non-null previous values, std needs two of them
    assert [r["lap_time_rolling_mean_3"] for r in k] == [0, 70.5, 70.5, 70.5, 74.0]
    assert [r["lap_time_rolling_std_3"] for r in k] == [0, 0, 0, 0, 0]


def test_null_category_counts_as_change(spark, synthetic):
    d = synthetic.withColumn("compound", F.when((F.col("driver") == "plover") & (F.col("lap") == 2), None)
                             .otherwise(F.col("compound")))
    p = rows(add_temporal_features(d), "plover")
    assert p[1]["compound_changed_last_lap"] == 1      # null against C
    assert p[2]["compound_changed_last_lap"] == 0      # previous is null


def test_single_row_group_and_empty(spark, synthetic):
    one = synthetic.where((F.col("driver") == "kestrel") & (F.col("lap") == 4))
    r = add_temporal_features(one).first()
    assert r["lap_history_count"] == 0 and r["lap_time_lag1"] == 0.0
    assert add_temporal_features(synthetic.limit(0)).count() == 0


def test_one_exchange_one_window(synthetic):
    plan = add_temporal_features(synthetic)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert plan.count("Window [") <= 2


def test_missing_columns_raise(synthetic):
    with pytest.raises(ValueError):
        add_temporal_features(synthetic.drop("compound"))


def hot_table(spark):
    """One sequence with most of the rows, others short, a null key, a null step, steps with gaps."""
    rnd = random.Random(4)
    rows = []
    for driver, n in (("hot", 900), ("b", 40), (None, 120), ("c", 1), ("d", 3)):
        steps = sorted(rnd.sample(range(3 * n), n))
        stint = 1
        for lap in steps:
            stint += rnd.random() < .2
            rows.append((driver, "r", 2020, lap, rnd.choice(["A", "B", None]), stint, rnd.choice([None, rnd.random()]), rnd.random(),
                         rnd.random(), rnd.randint(1, 20), rnd.random(), rnd.randint(0, 1), rnd.randint(0, 1)))
    rows.append(("hot", "r", 2020, None, "A", 0, 1.0, 2.0, 3.0, 4, 5.0, 0, 1))
    return spark.createDataFrame(rows, "driver string, race string, yr int, lap int, compound string, stint int, lap_time double, "
                                       "lap_time_delta double, cumulative_degradation double, position int, position_change double, "
                                       "will_pit int, pit_next_lap int").repartition(5)


def equal(a, b):
    assert a.columns == b.columns and a.count() == b.count()
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


@pytest.mark.parametrize("hot_rows", [7, 100])
def test_split_forms_equal_window_forms(spark, synthetic, hot_rows):
    names = temporal_feature_names()
    for df in (hot_table(spark), synthetic, synthetic.limit(0)):
        pick = lambda x: x.select("driver", "race", "yr", "lap", *[F.round(c, 9).alias(c) for c in names])
        equal(pick(add_temporal_features(df)), pick(add_temporal_features_split(df, hot_rows=hot_rows)))
        equal(L.rebuild_label(df), L.rebuild_label_split(df, hot_rows=hot_rows))
        equal(L.next_value(df, "stint"), L.next_value_split(df, "stint", hot_rows=hot_rows))


def test_audits_of_hot_sequences(spark):
    df, split = hot_table(spark), functools.partial(L.rebuild_label_split, hot_rows=50)
    for f in (functools.partial(L.mismatch_profile, a="will_pit", b="pit_next_lap"),
              functools.partial(L.label_decision, a="will_pit", b="pit_next_lap"), L.sequence_groups):
        equal(f(df), f(df, rebuild=split))


def test_copies_are_few(spark):
    df = spark.range(100_000).select(F.lit("d").alias("driver"), F.lit("r").alias("race"), F.lit(1).alias("yr"), F.col("id").alias("lap"))
    rows, spec = with_neighbours(df, before=3, after=1, hot_rows=1_000)
    got = rows.groupBy("_part").agg(F.count_if("_own").alias("own"), F.count_if(~F.col("_own")).alias("copies")).collect()
    assert spec.keys == ["driver", "race", "yr", "_part"] and len(got) == 100
    assert sum(r.own for r in got) == 100_000 and max(r.own for r in got) < 2_000 and max(r.copies for r in got) == 4
