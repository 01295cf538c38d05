"""Bucket rates, histograms, box statistics, density, bounds and levels."""

from pyspark.sql import functions as F

from seqlens.functions.expr import clip
from seqlens.functions.util import r6, stats_row
from seqlens.operators import buckets as B
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps

TARGET = "will_pit"
# Fixed bucket definitions (edges are right-closed; the lowest edge included).
LIFE_EDGES = [0, 5, 10, 15, 20, 30]          # + (max life + 1) as the last edge
LIFE_LABELS = ["0-5", "6-10", "11-15", "16-20", "21-30", "31+"]
PROGRESS_EDGES = [0, 0.20, 0.40, 0.60, 0.80, 1.01]
PROGRESS_LABELS = ["0-20%", "21-40%", "41-60%", "61-80%", "81-100%"]
FULL_EDGES = [0, 5, 10, 15, 20, 30, 45, float("inf")]
FULL_LABELS = ["1-5", "6-10", "11-15", "16-20", "21-30", "31-45", "46+"]
HISTOGRAMS = [("tyre_life", None, 40), ("lap_time_delta", (-60.0, 60.0), 80), ("tyre_life", None, 36),
              ("race_progress", None, 32)]
DENSITY_GRID = 200


def _case(col, edges, labels, as_ordinal=False):
    out = []
    for i, lab in enumerate(labels):
        a, b = edges[i], edges[i + 1]
        lo = f"{col} >= {a}" if i == 0 else f"{col} > {a}"
        val = str(i) if as_ordinal else f"'{lab}'"
        out.append(f"WHEN {lo} AND {col} <= {b} THEN {val}")
    return "CASE " + " ".join(out) + " END"


def _bucket_sql(col, edges, labels):
    return (f"SELECT bucket, cast(ordinal AS INT) AS ordinal, round(avg(will_pit), 6) AS rate, "
            f"cast(count(will_pit) AS BIGINT) AS n FROM (SELECT {_case(col, edges, labels)} AS bucket, "
            f"{_case(col, edges, labels, True)} AS ordinal, will_pit FROM laps{{src}}) WHERE bucket IS NOT NULL "
            f"GROUP BY bucket, ordinal")


@register("q_rate_by_life_bucket", with_laps(
    ", mx AS (SELECT max(tyre_life) + 1 AS top FROM laps)\n"
    + _bucket_sql("tyre_life", LIFE_EDGES + ["top"], LIFE_LABELS).replace("{src}", ", mx")))
def q_rate_by_life_bucket(spark, sf):
    l = laps(spark, sf)
    top = stats_row(l.agg((F.max("tyre_life") + 1).alias("top")))["top"]
    r = B.rate_by_bucket(l, "tyre_life", LIFE_EDGES + [top], LIFE_LABELS, TARGET)
    return r.select("bucket", "ordinal", r6("rate").alias("rate"), "n")


@register("q_rate_by_progress_bucket", with_laps(
    _bucket_sql("race_progress", PROGRESS_EDGES, PROGRESS_LABELS).replace("{src}", "")))
def q_rate_by_progress_bucket(spark, sf):
    r = B.rate_by_bucket(laps(spark, sf), "race_progress", PROGRESS_EDGES, PROGRESS_LABELS, TARGET)
    return r.select("bucket", "ordinal", r6("rate").alias("rate"), "n")


@register("q_rate_by_bucket_full", with_laps(
    ", d AS (SELECT * FROM (VALUES " + ", ".join(f"('{lab}', {i})" for i, lab in enumerate(FULL_LABELS))
    + ") t(bucket, ordinal)),\nr AS (" + _bucket_sql("tyre_life", [str(e) if e != float('inf') else "'inf'::DOUBLE"
                                                                   for e in FULL_EDGES], FULL_LABELS).replace("{src}", "")
    + ")\nSELECT d.bucket, cast(d.ordinal AS INT) AS ordinal, r.rate, cast(coalesce(r.n, 0) AS BIGINT) AS n "
      "FROM d LEFT JOIN r ON d.bucket = r.bucket"))
def q_rate_by_bucket_full(spark, sf):
    r = B.rate_by_bucket(laps(spark, sf), "tyre_life", FULL_EDGES, FULL_LABELS, TARGET, keep_empty=True)
    return r.select("bucket", "ordinal", r6("rate").alias("rate"), "n")


def _hist_sql(i, col, clip_to, bins):
    x = f"greatest(least({col}, {clip_to[1]}), {clip_to[0]})" if clip_to else col
    return (f"SELECT {i} AS hist, '{col}' AS column, cast(bin AS INT) AS bin, round(lo + bin * w, 6) AS lo, "
            f"round(lo + (bin + 1) * w, 6) AS hi, cast(count(*) AS BIGINT) AS n FROM ("
            f"SELECT CASE WHEN w > 0 THEN least(floor((x - lo) / w), {bins - 1}) ELSE 0 END AS bin, lo, w FROM ("
            f"SELECT {x} AS x FROM laps WHERE {col} IS NOT NULL) v, "
            f"(SELECT min({x}) AS lo, (max({x}) - min({x})) / {bins} AS w FROM laps) s) GROUP BY bin, lo, w")


@register("q_histogram", with_laps("\nUNION ALL ".join(
    _hist_sql(i, c, cl, b) for i, (c, cl, b) in enumerate(HISTOGRAMS))))
def q_histogram(spark, sf):
    l = laps(spark, sf)
    out = None
    for i, (c, cl, b) in enumerate(HISTOGRAMS):
        src = l.select(clip(c, *cl).alias(c)) if cl else l.select(c)
        h = B.histogram(src, c, b).select(F.lit(i).alias("hist"), F.lit(c).alias("column"), "bin",
                                          r6("lo").alias("lo"), r6("hi").alias("hi"), "n")
        out = h if out is None else out.unionByName(h)
    return out


BOX_COLUMNS = ["tyre_life", "lap_time", "lap_time_delta", "cumulative_degradation", "position", "race_progress"]


@register("q_box_stats", with_laps("""
, s AS (""" + " UNION ALL ".join(f"SELECT will_pit, '{c}' AS feature, cast({c} AS DOUBLE) AS x FROM laps WHERE {c} IS NOT NULL"
                                 for c in BOX_COLUMNS) + """),
q AS (SELECT will_pit, feature, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median,
             quantile_cont(x, 0.75) AS q3 FROM s GROUP BY will_pit, feature),
j AS (SELECT s.*, q1, median, q3, q1 - 1.5 * (q3 - q1) AS flo, q3 + 1.5 * (q3 - q1) AS fhi FROM s JOIN q USING (will_pit, feature))
SELECT will_pit, feature, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
 round(min(CASE WHEN x >= flo AND x <= fhi THEN x END), 6) AS whisker_low,
 round(max(CASE WHEN x >= flo AND x <= fhi THEN x END), 6) AS whisker_high,
 cast(sum(CASE WHEN x >= flo AND x <= fhi THEN 0 ELSE 1 END) AS BIGINT) AS outliers
FROM j GROUP BY will_pit, feature, q1, median, q3"""))
def q_box_stats(spark, sf):
    b = B.box_stats(laps(spark, sf), BOX_COLUMNS, TARGET)
    return b.select(TARGET, F.col("column").alias("feature"), *[r6(c).alias(c) for c in ("q1", "median", "q3", "whisker_low", "whisker_high")], "outliers")


@register("q_density", with_laps(f"""
, st AS (SELECT min(tyre_life) AS lo, max(tyre_life) AS hi, stddev_samp(tyre_life) AS sd, count(tyre_life) AS n FROM laps),
bw AS (SELECT lo, hi, n, sd * pow(cast(n AS DOUBLE), -0.2) AS h, (hi - lo) / {DENSITY_GRID - 1} AS step FROM st),
vc AS (SELECT tyre_life AS v, count(*) AS c FROM laps WHERE tyre_life IS NOT NULL GROUP BY tyre_life),
g AS (SELECT range AS point FROM range({DENSITY_GRID}))
SELECT cast(point AS INT) AS point, round(lo + point * step, 6) AS x,
 round(sum(c * exp(-0.5 * pow(((lo + point * step) - v) / h, 2))) * (1.0 / sqrt(2 * pi())) / (n * h), 6) AS density
FROM g, bw, vc GROUP BY point, lo, step, n, h"""))
def q_density(spark, sf):
    d = B.density(laps(spark, sf), "tyre_life", DENSITY_GRID)
    return d.select(F.col("point").cast("int").alias("point"), r6("x").alias("x"), r6("density").alias("density"))


BOUNDS = {"tyre_life": (1.0, 60.0), "lap_time_delta": (-10.0, 10.0), "position_change": (-5.0, 5.0)}


@register("q_numeric_bounds", with_laps("\nUNION ALL ".join(
    f"SELECT '{c}' AS column, CASE WHEN bad THEN {fb[0]} ELSE lo END AS lo, CASE WHEN bad THEN {fb[1]} ELSE hi END AS hi, "
    f"bad AS used_fallback FROM (SELECT lo, hi, (lo IS NULL OR hi IS NULL OR isnan(lo) OR isnan(hi) OR lo = hi) AS bad "
    f"FROM (SELECT quantile_cont({c}, 0.01) AS lo, quantile_cont({c}, 0.99) AS hi FROM laps))"
    for c, fb in BOUNDS.items())))
def q_numeric_bounds(spark, sf):
    out = B.numeric_bounds(laps(spark, sf), BOUNDS)
    return out.select("column", r6("lo").alias("lo"), r6("hi").alias("hi"), "used_fallback")


@register("q_quantile_levels", with_laps("""
SELECT 'Low' AS level, round(quantile_cont(cumulative_degradation, 0.25), 6) AS value FROM laps
UNION ALL SELECT 'Medium', round(quantile_cont(cumulative_degradation, 0.5), 6) FROM laps
UNION ALL SELECT 'High', round(quantile_cont(cumulative_degradation, 0.75), 6) FROM laps"""))
def q_quantile_levels(spark, sf):
    return B.quantile_levels(laps(spark, sf), "cumulative_degradation").select("level", r6("value").alias("value"))
