"""Spearman matrix and target correlation over the laps view."""

from itertools import combinations

from pyspark.sql import functions as F

from seqlens.functions.util import r6
from seqlens.operators import corr as C
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps

NUM_COLS = ["lap", "stint", "tyre_life", "position", "lap_time", "lap_time_delta", "cumulative_degradation",
            "race_progress", "normalized_tyre_life", "position_change"]
TARGET = "will_pit"


def _rank_sql(cols):
    return ", rk AS (SELECT " + ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in cols
    ) + " FROM laps)"


@register("q_spearman_matrix", with_laps(_rank_sql(NUM_COLS) + ", up AS (" + "\nUNION ALL ".join(
    f"SELECT '{a}' AS a, '{b}' AS b, corr(r_{a}, r_{b}) AS s FROM rk" for a, b in combinations(NUM_COLS, 2))
    + ")\nSELECT a, b, round(s, 6) AS spearman FROM up UNION ALL SELECT b, a, round(s, 6) FROM up"
    + "".join(f"\nUNION ALL SELECT '{c}', '{c}', 1.0" for c in NUM_COLS)))
def q_spearman_matrix(spark, sf):
    m = C.spearman_matrix(laps(spark, sf), NUM_COLS)
    return m.select("a", "b", r6("spearman").alias("spearman"))


@register("q_target_correlation", with_laps(_rank_sql(NUM_COLS + [TARGET]) + "\n" + "\nUNION ALL ".join(
    f"SELECT '{c}' AS feature, round((SELECT corr(r_{c}, r_{TARGET}) FROM rk), 6) AS spearman, "
    f"round((SELECT corr({c}, {TARGET}) FROM laps), 6) AS pearson" for c in NUM_COLS)))
def q_target_correlation(spark, sf):
    t = C.target_correlation(laps(spark, sf), NUM_COLS, TARGET)
    return t.select("feature", r6("spearman").alias("spearman"), r6("pearson").alias("pearson"))
