"""Parquet scans of the driver tables and the ``laps`` sequence view.

The ``laps`` view maps the TPC-H-like tables onto the sequence schema the
operators expect: nation -> entity, brand -> group, ship year -> season,
ship order -> step.  It is declared with joins and windows only, so Catalyst
prunes every unused column at the scan and picks the join strategies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Fixed values of the fixture definition (must equal the oracle view):
# compound by return flag A -> SOFT, N -> MEDIUM, else HARD; NULL compound
# when line number is 7 and quantity < 5; lap time = quantity + 60;
# position = 1 + size mod 20; a pit stop when discount >= 0.10 after lap 1;
# the supplied label is flipped on every 11th lap;
# risk score = floor((7 tyre_life + 3 lap_time + 5 position) / 10).
PIT_DISCOUNT = 0.10
FLIP_EVERY = 11


def laps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
        "l_extendedprice", "l_discount", "l_returnflag", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    supp = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    # nation has 25 rows by definition of the schema: a bounded broadcast.
    nation = F.broadcast(read_table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))

    base = (li.join(part, li.l_partkey == part.p_partkey)
              .join(supp, li.l_suppkey == supp.s_suppkey)
              .join(nation, supp.s_nationkey == nation.n_nationkey)
              .select(F.col("n_name").alias("driver"),
                      F.col("p_brand").alias("race"),
                      F.year("l_shipdate").cast("int").alias("yr"),
                      "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                      "l_suppkey", "l_extendedprice",
                      F.when((F.col("l_linenumber") == 7) & (F.col("l_quantity") < 5), F.lit(None))
                       .when(F.col("l_returnflag") == "A", "SOFT")
                       .when(F.col("l_returnflag") == "N", "MEDIUM")
                       .otherwise("HARD").alias("compound"),
                      (F.col("l_quantity") + F.lit(60.0)).alias("lap_time"),
                      (F.lit(1) + F.col("p_size") % 20).cast("int").alias("position"),
                      F.col("l_discount").alias("disc")))

    seq = Window.partitionBy("driver", "race", "yr")
    by_ship = seq.orderBy("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey",
                          "l_suppkey", "l_extendedprice")
    by_lap = seq.orderBy("lap")
    upto = by_lap.rowsBetween(Window.unboundedPreceding, Window.currentRow)

    s1 = base.withColumn("lap", F.row_number().over(by_ship))
    pit = ((F.col("disc") >= PIT_DISCOUNT) & (F.col("lap") > 1)).cast("int")
    s1 = s1.withColumn("pit_stop", pit).withColumn("stint", F.lit(1) + F.sum("pit_stop").over(upto))
    s2 = (s1.withColumn("tyre_life", F.row_number().over(
                Window.partitionBy("driver", "race", "yr", "stint").orderBy("lap")))
            .withColumn("lap_time_delta", F.coalesce(
                F.col("lap_time") - F.lag("lap_time").over(by_lap), F.lit(0.0)))
            .withColumn("position_change", F.coalesce(
                F.col("position") - F.lag("position").over(by_lap), F.lit(0)).cast("double"))
            .withColumn("next_stint", F.lead("stint").over(by_lap)))
    wp = F.coalesce((F.col("next_stint") > F.col("stint")).cast("int"), F.lit(0))
    s3 = s2.withColumn("will_pit", wp)
    return s3.select(
        "driver", "race", "yr", F.col("lap").cast("int").alias("lap"), "compound",
        F.col("stint").cast("int").alias("stint"),
        F.col("tyre_life").cast("double").alias("tyre_life"),
        "position", "lap_time", "lap_time_delta", "position_change",
        F.sum("lap_time_delta").over(upto).alias("cumulative_degradation"),
        (F.col("lap").cast("double") / F.max("lap").over(seq).cast("double")).alias("race_progress"),
        (F.col("tyre_life").cast("double") / F.max("tyre_life").over(seq).cast("double"))
        .alias("normalized_tyre_life"),
        F.col("pit_stop").cast("int").alias("pit_stop"),
        F.when(F.col("lap") % FLIP_EVERY == 0, F.lit(1) - F.col("will_pit"))
         .otherwise(F.col("will_pit")).cast("int").alias("pit_next_lap"),
        F.col("next_stint").cast("int").alias("next_stint"),
        F.col("will_pit").cast("int").alias("will_pit"),
        F.floor((F.col("tyre_life") * 7 + F.col("lap_time") * 3 + F.col("position") * 5) / 10)
        .cast("double").alias("risk_score"))
