"""Event-rate slices, value counts, top-n, class weights, ordered categories."""

from pyspark.sql import functions as F

from seqlens.functions.expr import POSITION_BAND_ORDER, position_band, target_label
from seqlens.functions.util import r6
from seqlens.operators import rates as RT
from seqlens.operators.ranking import quantile_wide
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.session import cut_lineage
from seqlens.sources.testdata import laps

TARGET = "will_pit"
# Fixed category order of the compound axis.
COMPOUND_ORDER = ("SOFT", "MEDIUM", "HARD", "INTERMEDIATE", "WET")


def _rate_sql(key, where=""):
    return f"""SELECT {key}, cast(sum(will_pit) AS BIGINT) AS events, cast(count(will_pit) AS BIGINT) AS rows,
 round(avg(will_pit), 6) AS rate FROM laps WHERE {key} IS NOT NULL {where} GROUP BY {key}"""


@register("q_class_balance", with_laps("""
, s AS (SELECT sum(CASE WHEN will_pit = 1 THEN 1 ELSE 0 END) AS p, sum(CASE WHEN will_pit = 0 THEN 1 ELSE 0 END) AS n,
               sum(CASE WHEN will_pit IS NULL THEN 1 ELSE 0 END) AS m FROM laps)
SELECT cast(p AS BIGINT) AS positive, cast(n AS BIGINT) AS negative,
       round(CASE WHEN p + n > 0 THEN p / (p + n) END, 6) AS positive_rate,
       round(CASE WHEN p > 0 THEN n / p END, 6) AS imbalance_ratio, cast(m AS BIGINT) AS missing FROM s"""))
def q_class_balance(spark, sf):
    return RT.class_balance(laps(spark, sf), TARGET)


@register("q_rate_by_group", with_laps(_rate_sql("race")))
def q_rate_by_group(spark, sf):
    return RT.event_rate(laps(spark, sf), "race", TARGET)


@register("q_rate_by_category", with_laps(_rate_sql("compound")))
def q_rate_by_category(spark, sf):
    return RT.event_rate(laps(spark, sf), "compound", TARGET)


@register("q_rate_by_stint", with_laps(_rate_sql("stint")))
def q_rate_by_stint(spark, sf):
    return RT.event_rate(laps(spark, sf), "stint", TARGET)


@register("q_rate_by_entity", with_laps(", r AS (" + _rate_sql("driver") + """)
(SELECT 'top' AS side, * FROM r ORDER BY rate DESC, driver ASC LIMIT 10)
UNION ALL (SELECT 'bottom' AS side, * FROM r ORDER BY rate ASC, driver DESC LIMIT 10)"""))
def q_rate_by_entity(spark, sf):
    r = RT.event_rate(laps(spark, sf), "driver", TARGET)
    top = RT.top_n(r, [F.desc("rate"), F.asc("driver")], 10).withColumn("side", F.lit("top"))
    bottom = RT.top_n(r, [F.asc("rate"), F.desc("driver")], 10).withColumn("side", F.lit("bottom"))
    return top.unionByName(bottom).select("side", "driver", "events", "rows", "rate")


@register("q_top_entities", with_laps(", r AS (" + _rate_sql("driver") + """)
SELECT driver, rate, rows FROM (SELECT * FROM r ORDER BY rate DESC, driver ASC LIMIT 15)"""))
def q_top_entities(spark, sf):
    r = RT.event_rate(laps(spark, sf), "driver", TARGET)
    # top 15 by rate; the chart re-sorts them ascending (order is presentation only)
    return RT.top_n(r, [F.desc("rate"), F.asc("driver")], 15).select("driver", "rate", "rows") \
        .orderBy("rate", "driver")


@register("q_life_by_category", with_laps("""
SELECT compound, round(avg(tyre_life), 6) AS mean_life, round(quantile_cont(tyre_life, 0.5), 6) AS median_life,
       cast(count(tyre_life) AS BIGINT) AS n FROM laps WHERE compound IS NOT NULL GROUP BY compound"""))
def q_life_by_category(spark, sf):
    l = cut_lineage(laps(spark, sf).where(F.col("compound").isNotNull()).select("compound", "tyre_life"))
    m = l.groupBy("compound").agg(F.avg("tyre_life").alias("mean_life"),
                                  F.count("tyre_life").cast("long").alias("n"))
    med = quantile_wide(l, ["tyre_life"], [0.5], by=["compound"], names=["median_life"], written=True).drop("column")
    return m.join(med, "compound").select("compound", r6("mean_life").alias("mean_life"),
                                          r6("median_life").alias("median_life"), "n")


@register("q_degradation_by_category", with_laps("""
SELECT compound, round(avg(cumulative_degradation), 6) AS mean_degradation FROM laps GROUP BY compound"""))
def q_degradation_by_category(spark, sf):
    # the NULL compound group is kept (dropna=False)
    return laps(spark, sf).groupBy("compound").agg(r6(F.avg("cumulative_degradation")).alias("mean_degradation"))


MEDIAN_COLS = ["tyre_life", "race_progress", "lap_time_delta", "cumulative_degradation", "position",
               "position_change"]


@register("q_median_by_class", with_laps("\nUNION ALL ".join(
    [f"SELECT will_pit, '{c}' AS column, round(quantile_cont({c}, 0.5), 6) AS median FROM laps "
     f"WHERE will_pit IS NOT NULL GROUP BY will_pit" for c in MEDIAN_COLS])))
def q_median_by_class(spark, sf):
    l = laps(spark, sf).where(F.col(TARGET).isNotNull())
    q = quantile_wide(l, MEDIAN_COLS, [0.5], by=[TARGET], names=["median"])
    return q.select(TARGET, "column", r6("median").alias("median"))


@register("q_value_counts", with_laps("""
SELECT compound, cast(count(*) AS BIGINT) AS n,
       round(count(*) / (SELECT count(compound) FROM laps), 6) AS share FROM laps WHERE compound IS NOT NULL GROUP BY compound"""))
def q_value_counts(spark, sf):
    return RT.value_counts(laps(spark, sf), "compound")


@register("q_target_labels", with_laps("""
SELECT CASE WHEN will_pit = 1 THEN 'Pit Next Lap' WHEN will_pit = 0 THEN 'Stay Out' END AS outcome,
       cast(count(*) AS BIGINT) AS rows FROM laps WHERE will_pit IN (0, 1) GROUP BY outcome"""))
def q_target_labels(spark, sf):
    l = laps(spark, sf).select(target_label(TARGET).alias("outcome")).where(F.col("outcome").isNotNull())
    return l.groupBy("outcome").agg(F.count(F.lit(1)).cast("long").alias("rows"))


@register("q_rows_per_group", with_laps("""
, g AS (SELECT race, count(*) AS n FROM laps GROUP BY race)
SELECT cast(min(n) AS BIGINT) AS min_rows, arg_min(race, (n, race)) AS min_group,
       cast(max(n) AS BIGINT) AS max_rows, arg_min(race, (-n, race)) AS max_group FROM g"""))
def q_rows_per_group(spark, sf):
    g = laps(spark, sf).groupBy("race").agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min("n").cast("long").alias("min_rows"),
                 F.min(F.struct("n", "race"))["race"].alias("min_group"),
                 F.max("n").cast("long").alias("max_rows"),
                 F.min(F.struct(F.lit(0) - F.col("n"), F.col("race")))["race"].alias("max_group"))


POS_ORDER_SQL = " ".join(f"WHEN '{b}' THEN {i}" for i, b in enumerate(POSITION_BAND_ORDER))
POS_BAND_SQL = ("CASE WHEN position <= 5 THEN 'Front (1-5)' WHEN position <= 15 THEN 'Midfield (6-15)' "
                "WHEN position IS NOT NULL THEN 'Backmarker (16+)' END")


@register("q_rate_by_position_group", with_laps(f"""
, d AS (SELECT * FROM (VALUES {", ".join(f"('{b}', {i})" for i, b in enumerate(POSITION_BAND_ORDER))}) t(band, ordinal)),
r AS (SELECT {POS_BAND_SQL} AS band, avg(will_pit) AS rate, count(will_pit) AS n FROM laps GROUP BY band)
SELECT d.band, cast(d.ordinal AS INT) AS ordinal, round(r.rate, 6) AS rate, cast(coalesce(r.n, 0) AS BIGINT) AS n
FROM d LEFT JOIN r ON d.band = r.band"""))
def q_rate_by_position_group(spark, sf):
    l = laps(spark, sf).withColumn("band", position_band("position"))
    agg = l.where(F.col("band").isNotNull()).groupBy("band").agg(
        F.avg(TARGET).alias("rate"), F.count(TARGET).alias("n"))
    dim = spark.createDataFrame([(b, i) for i, b in enumerate(POSITION_BAND_ORDER)], "band string, ordinal int")
    out = RT.ordered_categories(agg, dim, "band")
    return out.select("band", "ordinal", r6("rate").alias("rate"), F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@register("q_rate_extremes", with_laps(f"""
, r AS (SELECT {POS_BAND_SQL} AS band, avg(will_pit) AS rate FROM laps WHERE position IS NOT NULL GROUP BY band)
SELECT arg_min(band, (-rate, band)) AS max_label, round(max(rate), 6) AS max_rate,
       arg_min(band, (rate, band)) AS min_label, round(min(rate), 6) AS min_rate,
       round((max(rate) - min(rate)) * 100, 6) AS spread_pp FROM r"""))
def q_rate_extremes(spark, sf):
    l = laps(spark, sf).withColumn("band", position_band("position")).where(F.col("band").isNotNull())
    r = l.groupBy("band").agg(F.avg(TARGET).alias("rate"))
    e = RT.rate_extremes(r, "band")
    return e.select("max_label", r6("max_rate").alias("max_rate"), "min_label", r6("min_rate").alias("min_rate"),
                    "spread_pp")


@register("q_category_ordered", with_laps(f"""
, d AS (SELECT * FROM (VALUES {", ".join(f"('{c}', {i})" for i, c in enumerate(COMPOUND_ORDER))}) t(compound, ordinal)),
r AS (SELECT compound, avg(will_pit) AS rate, count(will_pit) AS n FROM laps WHERE compound IS NOT NULL GROUP BY compound)
SELECT d.compound, cast(d.ordinal AS INT) AS ordinal, round(r.rate, 6) AS rate, cast(r.n AS BIGINT) AS n
FROM d LEFT JOIN r USING (compound)"""))
def q_category_ordered(spark, sf):
    l = laps(spark, sf).where(F.col("compound").isNotNull())
    agg = l.groupBy("compound").agg(F.avg(TARGET).alias("rate"), F.count(TARGET).cast("long").alias("n"))
    dim = spark.createDataFrame([(c, i) for i, c in enumerate(COMPOUND_ORDER)], "compound string, ordinal int")
    out = RT.ordered_categories(agg, dim, "compound")
    return out.select("compound", "ordinal", r6("rate").alias("rate"), "n")


@register("q_largest_sequence", with_laps("""
SELECT driver, race, yr, cast(count(*) AS BIGINT) AS n FROM laps GROUP BY driver, race, yr
ORDER BY n DESC, driver, race, yr LIMIT 1"""))
def q_largest_sequence(spark, sf):
    g = laps(spark, sf).groupBy("driver", "race", "yr").agg(F.count(F.lit(1)).cast("long").alias("n"))
    return RT.top_n(g, [F.desc("n"), "driver", "race", "yr"], 1)


@register("q_class_weights", with_laps("""
, s AS (SELECT count(*) AS n, sum(CASE WHEN will_pit = 1 THEN 1 ELSE 0 END) AS p,
        sum(CASE WHEN will_pit = 0 THEN 1 ELSE 0 END) AS q FROM laps)
SELECT round(q / greatest(p, 1), 6) AS pos_weight,
       round(CASE WHEN q > 0 THEN n / (2.0 * q) END, 6) AS balanced_weight_0,
       round(CASE WHEN p > 0 THEN n / (2.0 * p) END, 6) AS balanced_weight_1 FROM s"""))
def q_class_weights(spark, sf):
    from seqlens.operators.encode import class_weights
    w = class_weights(laps(spark, sf), TARGET)
    return w.select(*[r6(c).alias(c) for c in ("pos_weight", "balanced_weight_0", "balanced_weight_1")])


@register("q_rate_grouping_sets", with_laps("""
SELECT CASE WHEN GROUPING(race) = 0 THEN 'race' WHEN GROUPING(driver) = 0 THEN 'driver'
            WHEN GROUPING(compound) = 0 THEN 'compound' ELSE 'stint' END AS dimension,
       coalesce(race, driver, compound, cast(stint AS VARCHAR)) AS value,
       cast(sum(will_pit) AS BIGINT) AS events, cast(count(will_pit) AS BIGINT) AS rows, round(avg(will_pit), 6) AS rate
FROM laps GROUP BY GROUPING SETS ((race), (driver), (compound), (stint))"""))
def q_rate_grouping_sets(spark, sf):
    """All four slices in one scan and one shuffle (Expand + HashAggregate)."""
    l = laps(spark, sf)
    g = l.groupingSets([["race"], ["driver"], ["compound"], ["stint"]], "race", "driver", "compound", "stint") \
         .agg(F.sum(TARGET).cast("long").alias("events"), F.count(TARGET).cast("long").alias("rows"),
              r6(F.avg(TARGET)).alias("rate"), F.grouping("race").alias("_gr"), F.grouping("driver").alias("_gd"),
              F.grouping("compound").alias("_gc"))
    dim = F.when(F.col("_gr") == 0, "race").when(F.col("_gd") == 0, "driver") \
           .when(F.col("_gc") == 0, "compound").otherwise("stint")
    return g.select(dim.alias("dimension"),
                    F.coalesce("race", "driver", "compound", F.col("stint").cast("string")).alias("value"),
                    "events", "rows", "rate")


@register("q_hash_sample", with_laps("""
SELECT driver, race, yr, lap, will_pit FROM laps
ORDER BY md5(driver || '|' || race || '|' || cast(yr AS VARCHAR) || '|' || cast(lap AS VARCHAR) || '|42'), driver, race, yr, lap
LIMIT 10000"""))
def q_hash_sample(spark, sf):
    from seqlens.operators.split import hash_sample
    return hash_sample(laps(spark, sf), ["driver", "race", "yr", "lap"], 10000, seed=42) \
        .select("driver", "race", "yr", "lap", TARGET)


@register("q_isin_filter", with_laps("""
SELECT driver, race, yr, lap FROM laps WHERE race IN ('Brand#11', 'Brand#22', 'Brand#33')"""))
def q_isin_filter(spark, sf):
    return laps(spark, sf).where(F.col("race").isin("Brand#11", "Brand#22", "Brand#33")) \
        .select("driver", "race", "yr", "lap")
