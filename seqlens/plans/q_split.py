"""Group split, folds and split-quality queries."""

from pyspark.sql import functions as F

from seqlens.functions.util import r6
from seqlens.operators import split as S
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps

GROUP_ORDER = """
, grp AS (SELECT race, row_number() OVER (ORDER BY md5(race || '|42')) AS rk, count(*) OVER () AS n
          FROM (SELECT DISTINCT race FROM laps WHERE race IS NOT NULL)),
asg AS (SELECT race, CASE WHEN rk <= ceil(n * 0.2) THEN 'test' ELSE 'train' END AS split FROM grp),
sp AS (SELECT laps.*, asg.split FROM laps JOIN asg USING (race))"""


@register("q_group_split", with_laps(GROUP_ORDER + """
SELECT driver, race, yr, lap, split FROM sp"""))
def q_group_split(spark, sf):
    return S.group_split(laps(spark, sf), "race", 0.2, 42).select("driver", "race", "yr", "lap", "split")


@register("q_test_groups", with_laps(GROUP_ORDER + """
SELECT array_to_string(list_sort(list(race)), ',') AS test_groups, cast(count(*) AS BIGINT) AS n_test_groups
FROM asg WHERE split = 'test'"""))
def q_test_groups(spark, sf):
    return S.test_groups(S.group_assignment(laps(spark, sf), "race", 0.2, 42), "race")


@register("q_split_overlap", with_laps(GROUP_ORDER + """
SELECT cast(count(*) AS BIGINT) AS overlap FROM
 (SELECT race FROM sp WHERE split = 'train' INTERSECT SELECT race FROM sp WHERE split = 'test')"""))
def q_split_overlap(spark, sf):
    return S.split_overlap(S.group_split(laps(spark, sf), "race"), "race")


@register("q_split_metadata", with_laps(GROUP_ORDER + """
SELECT split, cast(count(*) AS BIGINT) AS rows, round(avg(will_pit), 6) AS positive_rate FROM sp GROUP BY split"""))
def q_split_metadata(spark, sf):
    m = S.split_metadata(S.group_split(laps(spark, sf), "race"), "will_pit")
    return m.select("split", "rows", r6("positive_rate").alias("positive_rate"))


@register("q_group_folds", with_laps("""
, sz AS (SELECT race, count(*) AS n FROM laps WHERE race IS NOT NULL GROUP BY race),
rk AS (SELECT race, n, row_number() OVER (ORDER BY n DESC, race) - 1 AS i FROM sz),
fd AS (SELECT race, n, cast(CASE WHEN (i // 5) % 2 = 0 THEN i % 5 ELSE 4 - i % 5 END AS INT) AS fold FROM rk)
SELECT fold, cast(sum(n) AS BIGINT) AS rows, cast(count(*) AS BIGINT) AS groups FROM fd GROUP BY fold"""))
def q_group_folds(spark, sf):
    """Rows and groups of each fold of the serpentine assignment."""
    l = laps(spark, sf)
    sizes = l.groupBy("race").agg(F.count(F.lit(1)).alias("n"))
    return sizes.join(S.group_folds(l, "race", 5), "race").groupBy("fold").agg(
        F.sum("n").cast("long").alias("rows"), F.count(F.lit(1)).cast("long").alias("groups"))


@register("q_hash_folds", with_laps("""
SELECT driver, race, yr, lap,
 cast((('x' || substr(md5(driver || '|' || race || '|' || cast(yr AS VARCHAR) || '|' || cast(lap AS VARCHAR) || '|42'), 1, 8))::BIT::BIGINT) % 5 AS INT) AS fold
FROM laps"""))
def q_hash_folds(spark, sf):
    keys = ["driver", "race", "yr", "lap"]
    return laps(spark, sf).select(*keys, S.hash_fold(keys, 5, 42).alias("fold"))


@register("q_lag_selfjoin", with_laps("""
SELECT driver, race, yr, lap, lap_time,
  lag(lap_time) OVER (PARTITION BY driver, race, yr ORDER BY lap) AS prev_lap_time FROM laps"""))
def q_lag_selfjoin(spark, sf):
    """Independent check of lag 1: self equi-join on (keys, step - 1)."""
    l = laps(spark, sf)
    prev = l.select("driver", "race", "yr", (F.col("lap") + 1).alias("lap"), F.col("lap_time").alias("prev_lap_time"))
    return l.select("driver", "race", "yr", "lap", "lap_time").join(prev, ["driver", "race", "yr", "lap"], "left")
