"""DuckDB-side twin of the ``laps`` view, used as the prefix of every oracle.

Same definition as :func:`seqlens.sources.testdata.laps`, written in plain
SQL over the driver's pre-registered tables.
"""

LAPS_CTES = """
base AS (
 SELECT n.n_name AS driver, p.p_brand AS race, year(l.l_shipdate) AS yr,
  row_number() OVER (PARTITION BY n.n_name, p.p_brand, year(l.l_shipdate) ORDER BY l.l_shipdate, l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_extendedprice) AS lap,
  CASE WHEN l.l_linenumber = 7 AND l.l_quantity < 5 THEN NULL WHEN l.l_returnflag='A' THEN 'SOFT' WHEN l.l_returnflag='N' THEN 'MEDIUM' ELSE 'HARD' END AS compound,
  l.l_quantity + 60.0 AS lap_time, 1 + (p.p_size % 20) AS position, l.l_linestatus AS ls, l.l_discount AS disc
 FROM lineitem l JOIN part p ON l.l_partkey=p.p_partkey JOIN supplier s ON l.l_suppkey=s.s_suppkey JOIN nation n ON s.s_nationkey=n.n_nationkey),
s1 AS (SELECT *, 1 + sum(CASE WHEN disc >= 0.10 AND lap > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY driver,race,yr ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS stint FROM base),
s2 AS (SELECT *, row_number() OVER (PARTITION BY driver,race,yr,stint ORDER BY lap) AS tyre_life,
  lap_time - lag(lap_time) OVER (PARTITION BY driver,race,yr ORDER BY lap) AS d,
  position - lag(position) OVER (PARTITION BY driver,race,yr ORDER BY lap) AS pc,
  lead(stint) OVER (PARTITION BY driver,race,yr ORDER BY lap) AS next_stint FROM s1),
s3 AS (SELECT *, coalesce(d, 0.0) AS delta, CASE WHEN next_stint > stint THEN 1 ELSE 0 END AS wp FROM s2),
laps AS (
SELECT driver, race, cast(yr AS INT) AS yr, cast(lap AS INT) AS lap, compound, cast(stint AS INT) AS stint,
 cast(tyre_life AS DOUBLE) AS tyre_life, cast(position AS INT) AS position, cast(lap_time AS DOUBLE) AS lap_time,
 cast(delta AS DOUBLE) AS lap_time_delta, cast(coalesce(pc, 0) AS DOUBLE) AS position_change,
 sum(cast(delta AS DOUBLE)) OVER (PARTITION BY driver,race,yr ORDER BY lap ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cumulative_degradation,
 cast(lap AS DOUBLE) / cast(max(lap) OVER (PARTITION BY driver,race,yr) AS DOUBLE) AS race_progress,
 cast(tyre_life AS DOUBLE) / cast(max(tyre_life) OVER (PARTITION BY driver,race,yr) AS DOUBLE) AS normalized_tyre_life,
 cast(CASE WHEN disc >= 0.10 AND lap > 1 THEN 1 ELSE 0 END AS INT) AS pit_stop,
 cast(CASE WHEN lap % 11 = 0 THEN 1 - wp ELSE wp END AS INT) AS pit_next_lap,
 cast(next_stint AS INT) AS next_stint, cast(wp AS INT) AS will_pit,
 cast(floor((tyre_life*7 + lap_time*3 + position*5)/10) AS DOUBLE) AS risk_score
FROM s3)"""


def with_laps(body: str) -> str:
    """Prefix a query with the laps CTEs.

    ``body`` is either a bare SELECT or further CTEs starting with a comma:
    ``", x AS (...) SELECT ..."``.
    """
    body = body.strip()
    if body.startswith(","):
        return "WITH " + LAPS_CTES.strip() + body
    return "WITH " + LAPS_CTES.strip() + "\n" + body
