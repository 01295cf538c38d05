"""Profiling queries (single scans) on the laps view."""

from pyspark.sql import functions as F

from seqlens.functions.util import r6
from seqlens.operators import profile as P
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps

LAPS_COLUMNS = ["driver", "race", "yr", "lap", "compound", "stint", "tyre_life", "position", "lap_time",
                "lap_time_delta", "position_change", "cumulative_degradation", "race_progress",
                "normalized_tyre_life", "pit_stop", "pit_next_lap", "next_stint", "will_pit", "risk_score"]
BASE_NUMERIC = ["lap", "stint", "tyre_life", "position", "lap_time", "yr", "lap_time_delta",
                "cumulative_degradation", "race_progress", "normalized_tyre_life", "position_change"]
CATEGORICAL = ["compound", "yr", "race", "driver"]
OUTLIER_COLS = ["lap_time", "lap_time_delta", "cumulative_degradation", "tyre_life"]



def _union(parts):
    return "\nUNION ALL ".join(parts)


@register("q_shape", with_laps(f"""
SELECT cast(count(*) AS BIGINT) AS n_rows, cast({len(LAPS_COLUMNS)} AS INT) AS n_columns FROM laps"""))
def q_shape(spark, sf):
    return P.shape(laps(spark, sf))


@register("q_null_profile", with_laps(", n AS (" + _union(
    [f"SELECT '{c}' AS column, cast(count(*) - count({c}) AS BIGINT) AS n_null FROM laps" for c in LAPS_COLUMNS])
    + ") SELECT * FROM n WHERE n_null > 0"))
def q_null_profile(spark, sf):
    return P.null_profile(laps(spark, sf))


@register("q_duplicate_rows", with_laps(f"""
, g AS (SELECT count(*) AS n FROM laps GROUP BY {", ".join(LAPS_COLUMNS)})
SELECT cast(coalesce(sum(n - 1), 0) AS BIGINT) AS duplicate_rows FROM g"""))
def q_duplicate_rows(spark, sf):
    return P.duplicate_rows(laps(spark, sf))


@register("q_cardinality", with_laps(_union(
    [f"SELECT '{c}' AS column, cast(count(DISTINCT {c}) AS BIGINT) AS n_unique FROM laps" for c in CATEGORICAL])))
def q_cardinality(spark, sf):
    return P.cardinality(laps(spark, sf), CATEGORICAL)


@register("q_encoding_advice", with_laps(_union(
    [f"SELECT '{c}' AS column, cast(count(DISTINCT {c}) AS BIGINT) AS n_unique, "
     f"CASE WHEN count(DISTINCT {c}) <= 10 THEN 'one-hot' ELSE 'target-encode' END AS encoding FROM laps"
     for c in CATEGORICAL])))
def q_encoding_advice(spark, sf):
    return P.encoding_advice(laps(spark, sf), CATEGORICAL)


@register("q_year_range", with_laps("""
SELECT min(yr) AS min_value, max(yr) AS max_value,
       array_to_string(list_sort(list(DISTINCT cast(yr AS VARCHAR))), ',') AS "values" FROM laps"""))
def q_year_range(spark, sf):
    return P.value_range(laps(spark, sf), "yr")


@register("q_describe", with_laps(_union([
    f"SELECT '{c}' AS column, cast(count({c}) AS BIGINT) AS count, round(avg({c}), 6) AS mean, "
    f"round(stddev_samp({c}), 6) AS std, cast(min({c}) AS DOUBLE) AS min, "
    f"round(quantile_cont({c}, 0.25), 6) AS q25, round(quantile_cont({c}, 0.5), 6) AS q50, "
    f"round(quantile_cont({c}, 0.75), 6) AS q75, cast(max({c}) AS DOUBLE) AS max FROM laps"
    for c in BASE_NUMERIC])))
def q_describe(spark, sf):
    d = P.describe_exact(laps(spark, sf), BASE_NUMERIC)
    return d.select("column", "count", *[r6(c).alias(c) for c in ("mean", "std")], "min",
                    *[r6(c).alias(c) for c in ("q25", "q50", "q75")], "max")


@register("q_zscore_outliers", with_laps(", st AS (SELECT " + ", ".join(
    [f"avg({c}) AS m_{c}, stddev_pop({c}) AS s_{c}" for c in OUTLIER_COLS]) + " FROM laps)\n" + _union([
        f"SELECT '{c}' AS column, round(avg(CASE WHEN abs(({c} - m_{c}) / s_{c}) > 3 THEN 1.0 ELSE 0.0 END), 6) "
        f"AS outlier_share, cast(min({c}) AS DOUBLE) AS min, cast(max({c}) AS DOUBLE) AS max FROM laps, st"
        for c in OUTLIER_COLS])))
def q_zscore_outliers(spark, sf):
    z = P.zscore_outliers(laps(spark, sf), OUTLIER_COLS)
    return z.select("column", r6("outlier_share").alias("outlier_share"), "min", "max")


@register("q_predicate_share", with_laps("""
SELECT 'tyre_life_le_20' AS name, round(avg(CASE WHEN tyre_life <= 20 THEN 1.0 ELSE 0.0 END), 6) AS share FROM laps
UNION ALL SELECT 'abs_delta_le_5', round(avg(CASE WHEN abs(lap_time_delta) <= 5 THEN 1.0 ELSE 0.0 END), 6) FROM laps"""))
def q_predicate_share(spark, sf):
    s = P.predicate_share(laps(spark, sf), {"tyre_life_le_20": F.col("tyre_life") <= 20,
                                            "abs_delta_le_5": F.abs("lap_time_delta") <= 5})
    return s.select(F.col("column").alias("name"), r6("share").alias("share"))


@register("q_counters", with_laps(f"""
SELECT cast(count(*) AS BIGINT) AS rows, cast(count(DISTINCT race) AS BIGINT) AS n_groups,
       cast(count(DISTINCT driver) AS BIGINT) AS n_entities, {len(LAPS_COLUMNS) - 1} AS features FROM laps"""))
def q_counters(spark, sf):
    return P.counters(laps(spark, sf), "race", "driver")


DEFAULT_NUMERIC = ["lap", "stint", "tyre_life", "position", "lap_time", "yr", "lap_time_delta",
                   "cumulative_degradation", "race_progress", "normalized_tyre_life", "position_change"]
DEFAULT_INTEGER = ("lap", "stint", "position", "yr")
DEFAULT_TEXT = ["driver", "race", "compound"]


@register("q_column_defaults", with_laps(_union(
    [f"SELECT '{c}' AS column, "
     + (f"round_even(quantile_cont({c}, 0.5), 0)" if c in DEFAULT_INTEGER else f"round(quantile_cont({c}, 0.5), 6)")
     + " AS numeric_default, NULL::VARCHAR AS text_default FROM laps" for c in DEFAULT_NUMERIC]
    + [f"(SELECT '{c}' AS column, NULL::DOUBLE AS numeric_default, {c} AS text_default FROM laps "
       f"WHERE {c} IS NOT NULL GROUP BY {c} ORDER BY count(*) DESC, {c} ASC LIMIT 1)" for c in DEFAULT_TEXT])))
def q_column_defaults(spark, sf):
    d = P.column_defaults(laps(spark, sf), DEFAULT_NUMERIC, DEFAULT_TEXT, DEFAULT_INTEGER)
    return d.select("column", r6("numeric_default").alias("numeric_default"), "text_default")


@register("q_distinct_options", with_laps(_union(
    [f"SELECT '{c}' AS column, v AS value, cast(row_number() OVER (ORDER BY v) AS INT) AS ordinal "
     f"FROM (SELECT DISTINCT cast({c} AS VARCHAR) AS v FROM laps WHERE {c} IS NOT NULL)" for c in DEFAULT_TEXT])))
def q_distinct_options(spark, sf):
    return P.distinct_options(laps(spark, sf), DEFAULT_TEXT)


HEAD_COLS = ["yr", "race", "driver", "lap", "stint", "next_stint", "pit_stop", "pit_next_lap", "will_pit"]


@register("q_head", with_laps(f"""
SELECT {", ".join(HEAD_COLS)} FROM laps ORDER BY yr, race, driver, lap LIMIT 12"""))
def q_head(spark, sf):
    return P.head(laps(spark, sf), ["yr", "race", "driver", "lap"], 12, HEAD_COLS)


@register("q_tail", with_laps(f"""
SELECT {", ".join(HEAD_COLS)} FROM laps ORDER BY yr DESC, race DESC, driver DESC, lap DESC LIMIT 5"""))
def q_tail(spark, sf):
    return P.tail(laps(spark, sf), ["yr", "race", "driver", "lap"], 5, HEAD_COLS)
