"""Projection / scalar-function queries (fill, clip, coercion, labels)."""

from pyspark.sql import functions as F

from seqlens.functions import expr as X
from seqlens.functions.util import r6
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.session import cut_lineage
from seqlens.sources.testdata import laps
from seqlens.spec import LAPS

KEYS = ["driver", "race", "yr", "lap"]


@register("q_drop_leakage", with_laps("""
SELECT driver, race, yr, lap, compound, stint, tyre_life, position, lap_time, lap_time_delta, position_change,
 cumulative_degradation, race_progress, normalized_tyre_life, will_pit, risk_score FROM laps"""))
def q_drop_leakage(spark, sf):
    return laps(spark, sf).drop(*LAPS.leakage)


@register("q_fill_unknown", with_laps("""
SELECT driver, race, yr, lap, coalesce(compound, 'UNKNOWN') AS compound FROM laps"""))
def q_fill_unknown(spark, sf):
    return laps(spark, sf).select(*KEYS, X.fill_unknown("compound").alias("compound"))


CLIPS = {"lap_time_delta": (-60.0, 60.0), "position_change": (-5.0, 5.0),
         "cumulative_degradation": (-150.0, 150.0), "lap_time": (-30.0, 30.0)}


@register("q_clip", with_laps("SELECT driver, race, yr, lap, " + ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN greatest(least({c}, {hi}), {lo}) END AS {c}_clipped"
    for c, (lo, hi) in CLIPS.items()) + " FROM laps"))
def q_clip(spark, sf):
    return laps(spark, sf).select(*KEYS, *[X.clip(c, lo, hi).cast("double").alias(f"{c}_clipped")
                                           for c, (lo, hi) in CLIPS.items()])


@register("q_try_numeric", with_laps("""
SELECT driver, race, yr, lap, TRY_CAST(cast(lap_time AS VARCHAR) AS DOUBLE) AS lap_time_num,
       TRY_CAST(compound AS DOUBLE) AS compound_num,
       TRY_CAST(CASE WHEN lap % 2 = 0 THEN cast(position AS VARCHAR) ELSE 'p' || cast(position AS VARCHAR) END AS DOUBLE) AS position_num
FROM laps"""))
def q_try_numeric(spark, sf):
    mixed = F.when(F.col("lap") % 2 == 0, F.col("position").cast("string")) \
             .otherwise(F.concat(F.lit("p"), F.col("position").cast("string")))
    return laps(spark, sf).select(*KEYS, X.try_numeric("lap_time").alias("lap_time_num"),
                                  X.try_numeric("compound").alias("compound_num"),
                                  X.try_numeric(mixed).alias("position_num"))


@register("q_coerce_rows", with_laps("""
SELECT driver, race, yr, lap, coalesce(compound, 'UNKNOWN') AS compound_in,
 cast(round_even(lap / 2.0, 0) AS INT) AS lap_in, cast(round_even(stint + 0.5, 0) AS INT) AS stint_in,
 cast(round_even(position / 2.0, 0) AS INT) AS position_in, cast(round_even(yr + 0.5, 0) AS INT) AS year_in,
 cast(tyre_life AS DOUBLE) AS tyre_life_in FROM laps"""))
def q_coerce_rows(spark, sf):
    """Form-style coercion: text or UNKNOWN; four integers by half-even rounding."""
    from seqlens.operators.score import coerce_rows
    form = laps(spark, sf).select(*[F.col(c).alias(c) for c in KEYS], F.col("compound").alias("compound_in"),
                                  (F.col("lap") / 2.0).alias("lap_in"), (F.col("stint") + 0.5).alias("stint_in"),
                                  (F.col("position") / 2.0).alias("position_in"), (F.col("yr") + 0.5).alias("year_in"),
                                  F.col("tyre_life").alias("tyre_life_in"))
    return coerce_rows(form, ["driver", "race", "compound_in"], ["yr", "lap", "lap_in", "stint_in", "position_in", "year_in"],
                       ["tyre_life_in"])


@register("q_display_names", with_laps("""
, m AS (SELECT CASE WHEN position <= 5 THEN 'front_runner' WHEN position <= 15 THEN 'mid_field_pack' END AS model,
          avg(race_progress) AS v FROM laps GROUP BY 1)
SELECT model, CASE WHEN model IS NULL THEN 'Unknown' ELSE
  list_aggregate(list_transform(string_split(replace(model, '_', ' '), ' '), lambda x: upper(x[1]) || lower(x[2:])), 'string_agg', ' ') END AS display,
  CASE WHEN v IS NOT NULL AND NOT isnan(v) THEN printf('%.3f', v) ELSE 'n/a' END AS value_text FROM m"""))
def q_display_names(spark, sf):
    l = laps(spark, sf)
    band = F.when(F.col("position") <= 5, "front_runner").when(F.col("position") <= 15, "mid_field_pack")
    m = l.groupBy(band.alias("model")).agg(F.avg("race_progress").alias("v"))
    return m.select("model", X.display_name("model").alias("display"), X.format_metric("v").alias("value_text"))


@register("q_score_labels", with_laps("""
, s AS (SELECT driver, race, yr, lap, cast(least(risk_score / 200.0, 1.0) AS DOUBLE) AS p FROM laps)
SELECT driver, race, yr, lap, p, cast(p >= 0.5 AS INT) AS prediction,
 CASE WHEN p >= 0.5 THEN 'Pit Next Lap' ELSE 'Stay Out' END AS label,
 CASE WHEN abs(p - 0.5) >= 0.25 THEN 'High' WHEN abs(p - 0.5) >= 0.12 THEN 'Medium' ELSE 'Low' END AS confidence,
 CASE WHEN p >= 0.5 AND p >= 0.75 THEN 'strong_pit_signal' WHEN p >= 0.5 THEN 'pit_signal'
      WHEN p <= 0.25 THEN 'continue_stint' ELSE 'monitor' END AS reason FROM s"""))
def q_score_labels(spark, sf):
    from seqlens.operators.score import label_scores
    s = laps(spark, sf).select(*KEYS, F.least(F.col("risk_score") / 200.0, F.lit(1.0)).cast("double").alias("p"))
    return label_scores(s, 0.5).select(*KEYS, "p", "prediction", "label", "confidence", "reason")


@register("q_scenario_rows", with_laps("""
, mx AS (SELECT max(lap) AS max_lap, max(tyre_life) AS max_life, quantile_cont(cumulative_degradation, 0.25) AS lo,
  quantile_cont(cumulative_degradation, 0.5) AS me, quantile_cont(cumulative_degradation, 0.75) AS hi FROM laps)
SELECT driver, race, yr, lap,
 cast(greatest(1, round_even(max_lap * greatest(race_progress, 0.01), 0)) AS INT) AS lap_number,
 round(greatest(least(tyre_life / greatest(max_life, 1.0), 1.0), 0.0), 6) AS normalized_life,
 round(CASE WHEN compound = 'SOFT' THEN hi WHEN compound = 'MEDIUM' THEN me WHEN compound = 'HARD' THEN lo END, 6) AS level_value
FROM laps, mx"""))
def q_scenario_rows(spark, sf):
    """Quick-scenario derivation against dataset maxima and degradation levels."""
    from seqlens.operators.buckets import quantile_levels
    from seqlens.operators.score import scenario_rows
    l = cut_lineage(laps(spark, sf).select(*KEYS, "compound", "race_progress", "tyre_life", "cumulative_degradation"))
    name = F.when(F.col("compound") == "SOFT", "High").when(F.col("compound") == "MEDIUM", "Medium") \
            .when(F.col("compound") == "HARD", "Low")
    out = scenario_rows(l.withColumn("asked", name), l, level="asked", levels=quantile_levels(l, "cumulative_degradation"))
    return out.select(*KEYS, "lap_number", r6("normalized_life").alias("normalized_life"), r6("level_value").alias("level_value"))
