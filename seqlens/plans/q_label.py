"""Flagship slice: label rebuild, temporal features, label audit."""

from pyspark.sql import functions as F

from seqlens.functions.util import r6
from seqlens.operators import label as L
from seqlens.operators.temporal import add_temporal_features, temporal_feature_names
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps
from seqlens.spec import LAPS

KEYS = ["driver", "race", "yr", "lap"]


@register("q_next_stint", with_laps("""
SELECT driver, race, yr, lap, stint,
       lead(stint) OVER (PARTITION BY driver, race, yr ORDER BY lap) AS next_stint_rebuilt
FROM laps"""))
def q_next_stint(spark, sf):
    df = L.next_value(laps(spark, sf), "stint", LAPS, "next_stint_rebuilt")
    return df.select(*KEYS, "stint", "next_stint_rebuilt")


@register("q_label_rebuild", with_laps("""
SELECT driver, race, yr, lap,
       cast(coalesce(cast(lead(stint) OVER w > stint AS INT), 0) AS INT) AS label_rebuilt,
       lead(stint) OVER w IS NULL AS is_final
FROM laps WINDOW w AS (PARTITION BY driver, race, yr ORDER BY lap)"""))
def q_label_rebuild(spark, sf):
    return L.rebuild_label(laps(spark, sf)).select(*KEYS, "label_rebuilt", "is_final")


_ROUNDED = {"lap_time_rolling_mean_3", "lap_time_rolling_std_3", "lap_time_delta_rolling_mean_3",
            "lap_time_delta_rolling_std_3", "cumulative_degradation_rolling_mean_3",
            "position_rolling_mean_3", "lap_time_diff_from_rolling_mean3",
            "lap_time_delta_lag1", "lap_time_delta_lag2", "lap_time_delta_lag3"}


def temporal_select(df):
    out = []
    for c in temporal_feature_names(LAPS):
        out.append(r6(c).alias(c) if c in _ROUNDED else F.col(c))
    return df.select(*KEYS, "compound", "will_pit", *out)


TEMPORAL_SQL = """
SELECT driver, race, yr, lap, compound, will_pit,
 coalesce(lag(lap_time, 1) OVER w, 0.0) AS lap_time_lag1,
 coalesce(lag(lap_time, 2) OVER w, 0.0) AS lap_time_lag2,
 coalesce(lag(lap_time, 3) OVER w, 0.0) AS lap_time_lag3,
 round(coalesce(lag(lap_time_delta, 1) OVER w, 0.0), 6) AS lap_time_delta_lag1,
 round(coalesce(lag(lap_time_delta, 2) OVER w, 0.0), 6) AS lap_time_delta_lag2,
 round(coalesce(lag(lap_time_delta, 3) OVER w, 0.0), 6) AS lap_time_delta_lag3,
 round(coalesce(avg(lap_time) OVER p3, 0.0), 6) AS lap_time_rolling_mean_3,
 round(coalesce(stddev_samp(lap_time) OVER p3, 0.0), 6) AS lap_time_rolling_std_3,
 round(coalesce(avg(lap_time_delta) OVER p3, 0.0), 6) AS lap_time_delta_rolling_mean_3,
 round(coalesce(stddev_samp(lap_time_delta) OVER p3, 0.0), 6) AS lap_time_delta_rolling_std_3,
 round(coalesce(avg(cumulative_degradation) OVER p3, 0.0), 6) AS cumulative_degradation_rolling_mean_3,
 coalesce(cast(lag(position, 1) OVER w AS DOUBLE), 0.0) AS position_lag1,
 round(coalesce(avg(position) OVER p3, 0.0), 6) AS position_rolling_mean_3,
 coalesce(lag(position_change, 1) OVER w, 0.0) AS position_change_lag1,
 round(coalesce(lap_time - avg(lap_time) OVER p3, 0.0), 6) AS lap_time_diff_from_rolling_mean3,
 cast(CASE WHEN lag(compound, 1) OVER w IS NOT NULL AND coalesce(compound, 'nan') <> lag(compound, 1) OVER w
      THEN 1 ELSE 0 END AS INT) AS compound_changed_last_lap,
 cast(least(row_number() OVER w - 1, 3) AS INT) AS lap_history_count
FROM laps
WINDOW w AS (PARTITION BY driver, race, yr ORDER BY lap),
       p3 AS (PARTITION BY driver, race, yr ORDER BY lap ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)"""


@register("q_temporal_features", with_laps(TEMPORAL_SQL))
def q_temporal_features(spark, sf):
    return temporal_select(add_temporal_features(laps(spark, sf)))


@register("q_label_agreement", with_laps("""
SELECT cast(count(*) AS BIGINT) AS total,
 cast(sum(CASE WHEN pit_next_lap = will_pit THEN 1 ELSE 0 END) AS BIGINT) AS matches,
 cast(sum(CASE WHEN pit_next_lap = will_pit THEN 0 ELSE 1 END) AS BIGINT) AS mismatches,
 round(avg(CASE WHEN pit_next_lap = will_pit THEN 1.0 ELSE 0.0 END), 6) AS match_rate,
 round(avg(CASE WHEN pit_next_lap = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate_a,
 round(avg(CASE WHEN will_pit = 1 THEN 1.0 ELSE 0.0 END), 6) AS rate_b,
 round(abs(avg(CASE WHEN pit_next_lap = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN will_pit = 1 THEN 1.0 ELSE 0.0 END)) * 100, 6) AS gap_pp
FROM laps"""))
def q_label_agreement(spark, sf):
    return L.label_agreement(laps(spark, sf), "pit_next_lap", "will_pit")


@register("q_label_crosstab", with_laps("""
, t AS (SELECT count(*) AS n FROM laps WHERE pit_next_lap IS NOT NULL AND will_pit IS NOT NULL)
SELECT pit_next_lap,
 cast(sum(CASE WHEN will_pit = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_will_pit_0,
 round(sum(CASE WHEN will_pit = 0 THEN 1 ELSE 0 END) / (SELECT n FROM t), 6) AS share_will_pit_0,
 cast(sum(CASE WHEN will_pit = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_will_pit_1,
 round(sum(CASE WHEN will_pit = 1 THEN 1 ELSE 0 END) / (SELECT n FROM t), 6) AS share_will_pit_1
FROM laps WHERE pit_next_lap IS NOT NULL AND will_pit IS NOT NULL GROUP BY pit_next_lap"""))
def q_label_crosstab(spark, sf):
    return L.label_crosstab(laps(spark, sf), "pit_next_lap", "will_pit")


@register("q_label_mismatches", with_laps("""
SELECT yr, race, driver, lap, stint, next_stint, pit_stop, pit_next_lap, will_pit, compound, tyre_life, race_progress
FROM laps WHERE NOT coalesce(pit_next_lap = will_pit, false)"""))
def q_label_mismatches(spark, sf):
    return L.mismatches(laps(spark, sf), "pit_next_lap", "will_pit",
                        keep=["yr", "race", "driver", "lap", "stint", "next_stint", "pit_stop",
                              "pit_next_lap", "will_pit", "compound", "tyre_life", "race_progress"])


@register("q_mismatch_profile", with_laps("""
, rb AS (SELECT *, lead(stint) OVER (PARTITION BY driver, race, yr ORDER BY lap) IS NULL AS is_final FROM laps),
mm AS (SELECT * FROM rb WHERE NOT coalesce(pit_next_lap = will_pit, false)),
g AS (SELECT race AS value, count(*) AS n FROM mm GROUP BY race ORDER BY n DESC, value ASC LIMIT 10)
SELECT 'final_row' AS facet, CASE WHEN is_final THEN 'true' ELSE 'false' END AS value, cast(count(*) AS BIGINT) AS n FROM mm GROUP BY is_final
UNION ALL SELECT 'direction', cast(pit_next_lap AS VARCHAR) || '->' || cast(will_pit AS VARCHAR), cast(count(*) AS BIGINT) FROM mm GROUP BY pit_next_lap, will_pit
UNION ALL SELECT 'top_group', value, cast(n AS BIGINT) FROM g
UNION ALL SELECT 'category', compound, cast(count(*) AS BIGINT) FROM mm WHERE compound IS NOT NULL GROUP BY compound"""))
def q_mismatch_profile(spark, sf):
    return L.mismatch_profile(laps(spark, sf), "pit_next_lap", "will_pit")


@register("q_label_decision", with_laps("""
, rb AS (SELECT *, lead(stint) OVER (PARTITION BY driver, race, yr ORDER BY lap) IS NULL AS is_final,
         CASE WHEN coalesce(pit_next_lap = will_pit, false) THEN 1 ELSE 0 END AS m FROM laps),
s AS (SELECT avg(m) AS match_rate,
        abs(avg(CASE WHEN pit_next_lap = 1 THEN 1.0 ELSE 0.0 END) - avg(CASE WHEN will_pit = 1 THEN 1.0 ELSE 0.0 END)) * 100 AS gap_pp,
        sum(1 - m) AS mm, sum(CASE WHEN is_final THEN 1 - m ELSE 0 END) AS fm FROM rb)
SELECT round(match_rate, 6) AS match_rate, round(gap_pp, 6) AS gap_pp,
 cast(mm AS BIGINT) AS mismatches, cast(fm AS BIGINT) AS final_row_mismatches,
 cast(mm - fm AS BIGINT) AS other_mismatches,
 round(CASE WHEN mm > 0 THEN fm / mm ELSE 0.0 END, 6) AS final_row_share,
 CASE WHEN match_rate >= 0.99 AND gap_pp <= 0.2 THEN 'USE_ORIGINAL' ELSE 'USE_RECONSTRUCTED' END AS decision
FROM s"""))
def q_label_decision(spark, sf):
    return L.label_decision(laps(spark, sf), "pit_next_lap", "will_pit")


@register("q_sequence_groups", with_laps("""
, rb AS (SELECT *, lead(stint) OVER w IS NULL AS is_final,
         coalesce(cast(lead(stint) OVER w > stint AS INT), 0) AS rbl FROM laps
         WINDOW w AS (PARTITION BY driver, race, yr ORDER BY lap))
SELECT cast((SELECT count(*) FROM (SELECT DISTINCT driver, race, yr FROM laps)) AS BIGINT) AS n_sequences,
 cast(sum(CASE WHEN is_final THEN 1 ELSE 0 END) AS BIGINT) AS n_final_rows,
 cast(sum(CASE WHEN is_final AND rbl = 1 THEN 1 ELSE 0 END) AS BIGINT) AS final_positive,
 cast(sum(CASE WHEN is_final AND rbl = 0 THEN 1 ELSE 0 END) AS BIGINT) AS final_negative
FROM rb"""))
def q_sequence_groups(spark, sf):
    return L.sequence_groups(laps(spark, sf))


@register("q_label_comparison", with_laps("""
, s AS (SELECT sum(CASE WHEN pit_next_lap = 1 THEN 1 ELSE 0 END) AS pa, sum(CASE WHEN pit_next_lap = 0 THEN 1 ELSE 0 END) AS na,
   sum(CASE WHEN pit_next_lap IS NULL THEN 1 ELSE 0 END) AS ma,
   sum(CASE WHEN will_pit = 1 THEN 1 ELSE 0 END) AS pb, sum(CASE WHEN will_pit = 0 THEN 1 ELSE 0 END) AS nb,
   sum(CASE WHEN will_pit IS NULL THEN 1 ELSE 0 END) AS mb FROM laps)
SELECT 'positive_count' AS metric, cast(pa AS DOUBLE) AS pit_next_lap, cast(pb AS DOUBLE) AS will_pit FROM s
UNION ALL SELECT 'negative_count', cast(na AS DOUBLE), cast(nb AS DOUBLE) FROM s
UNION ALL SELECT 'positive_rate', CASE WHEN pa + na > 0 THEN round(pa / (pa + na), 6) END,
                 CASE WHEN pb + nb > 0 THEN round(pb / (pb + nb), 6) END FROM s
UNION ALL SELECT 'missing', cast(ma AS DOUBLE), cast(mb AS DOUBLE) FROM s"""))
def q_label_comparison(spark, sf):
    return L.label_comparison(laps(spark, sf), "pit_next_lap", "will_pit")


@register("q_temporal_features_split", with_laps(TEMPORAL_SQL))
def q_temporal_features_split(spark, sf):
    """Skew-safe twin of q_temporal_features (row index + bounded fan-out)."""
    from seqlens.operators.temporal import add_temporal_features_split
    needed = laps(spark, sf).select(*KEYS, "compound", "will_pit", LAPS.value, LAPS.delta, LAPS.degradation, LAPS.position,
                                    LAPS.position_change)
    return temporal_select(add_temporal_features_split(needed, hot_rows=20))


@register("q_label_rebuild_split", with_laps("""
SELECT driver, race, yr, lap,
       cast(coalesce(cast(lead(stint) OVER w > stint AS INT), 0) AS INT) AS label_rebuilt,
       lead(stint) OVER w IS NULL AS is_final
FROM laps WINDOW w AS (PARTITION BY driver, race, yr ORDER BY lap)"""))
def q_label_rebuild_split(spark, sf):
    """Skew-safe twin of q_label_rebuild (row index + equi-join)."""
    return L.rebuild_label_split(laps(spark, sf).select(*KEYS, "stint"), hot_rows=20).select(*KEYS, "label_rebuilt", "is_final")
