"""Buckets, histograms, box statistics, density and quantile bounds."""

from __future__ import annotations

import math

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlens.functions.expr import bucket_ordinal, bucket_right
from seqlens.functions.util import join_small, stats_row
from seqlens.operators.ranking import quantile_wide, quantiles, quantiles_of_counts, value_counts_long
from seqlens.session import cut_lineage


def bucket_dimension(spark: SparkSession, labels: list[str]) -> DataFrame:
    """Literal (bucket, ordinal) table; size fixed by the caller's label list."""
    return spark.createDataFrame([(lab, i) for i, lab in enumerate(labels)], "bucket string, ordinal int")


def rate_by_bucket(df: DataFrame, col: str, edges: list[float], labels: list[str], target: str,
                   keep_empty: bool = False) -> DataFrame:
    """Mean target and count per right-closed bucket.

    ``keep_empty`` adds buckets with no rows (mean NULL, count 0) from the
    label dimension, as ``observed=False`` does.
    """
    b = df.select(bucket_right(col, edges, labels).alias("bucket"),
                  bucket_ordinal(col, edges).alias("ordinal"), F.col(target))
    agg = (b.where(F.col("bucket").isNotNull()).groupBy("bucket", "ordinal")
            .agg(F.avg(target).alias("rate"), F.count(target).cast("long").alias("n")))
    if not keep_empty:
        return agg
    dim = bucket_dimension(df.sparkSession, labels)  # as many rows as labels, like the aggregate
    return dim.join(agg.drop("ordinal"), "bucket", "left").select(
        "bucket", "ordinal", "rate", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def histogram(df: DataFrame, col: str, bins: int, lo=None, hi=None) -> DataFrame:
    """Equal-width bins over [min, max]; the last bin is closed.

    Bounds come from a scalar subquery, so counting is one map + partial
    aggregate.  Output ``(bin, lo, hi, n)`` for non-empty bins.
    """
    x = F.col(col).cast("double")
    if lo is None or hi is None:
        st = stats_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi")))
        lo_c, hi_c = st["lo"], st["hi"]
    else:
        lo_c, hi_c = F.lit(float(lo)), F.lit(float(hi))
    w = (hi_c - lo_c) / F.lit(bins)
    idx = F.when(w > 0, F.least(F.floor((x - lo_c) / w), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    agg = df.where(x.isNotNull()).groupBy(idx.alias("bin")).agg(F.count(F.lit(1)).cast("long").alias("n"))
    return agg.select("bin", (lo_c + F.col("bin") * w).alias("lo"),
                      (lo_c + (F.col("bin") + 1) * w).alias("hi"), "n")


def box_stats(df: DataFrame, col, by: str) -> DataFrame:
    """Q1, median, Q3, whiskers (furthest values inside 1.5 IQR) and outliers.

    ``col`` is a column or a list of columns (then with a ``column`` column).
    Rows are read once and counted by (class, column, value); quartiles,
    whiskers and outliers all come from these counts.
    """
    cols = [col] if isinstance(col, str) else list(col)
    vc = cut_lineage(value_counts_long(df.where(F.col(by).isNotNull()), cols, [by]))
    q = quantiles_of_counts(vc, [0.25, 0.5, 0.75], [by])
    q = q.groupBy(by, "column").agg(*[F.max(F.when(F.col("q") == F.lit(v), F.col("value"))).alias(n)
                                      for v, n in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    lo = F.col("q1") - 1.5 * (F.col("q3") - F.col("q1"))
    hi = F.col("q3") + 1.5 * (F.col("q3") - F.col("q1"))
    j = join_small(vc, q, [by, "column"])
    inside = (F.col("value") >= lo) & (F.col("value") <= hi)
    out = j.groupBy(by, "column", "q1", "median", "q3").agg(
        F.min(F.when(inside, F.col("value"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("value"))).alias("whisker_high"),
        F.sum(F.when(inside, 0).otherwise(F.col("n"))).cast("long").alias("outliers"))
    return out.drop("column") if isinstance(col, str) else out


def density(df: DataFrame, col: str, grid: int = 200) -> DataFrame:
    """Gaussian KDE on ``grid`` points over [min, max], Scott bandwidth.

    bandwidth = sample std * n^(-1/5).  The data are first reduced to
    (value, count); a distinct value's contributions to all points are one
    vector, and the vectors are added up map-side, so a task sends one vector
    however many values it has.  No row is made per value and point.  Without
    values, or without spread, the densities are NULL.
    """
    x = F.col(col).cast("double")
    vc = df.where(x.isNotNull()).groupBy(x.alias("v")).agg(F.count(F.lit(1)).alias("c"))
    st = stats_row(df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.stddev_samp(x).alias("sd"),
                          F.count(x).alias("n")))
    with_st = vc.select("v", "c", st.alias("st"))
    lo, hi, n = F.col("st.lo"), F.col("st.hi"), F.col("st.n").cast("double")
    bw = F.col("st.sd") * F.pow(n, F.lit(-0.2))
    step = (hi - lo) / F.lit(grid - 1)
    pts = F.sequence(F.lit(0), F.lit(grid - 1))
    each = F.transform(pts, lambda i: F.exp(F.lit(-0.5) * F.pow(((lo + i * step) - F.col("v")) / bw, 2)))
    spark = df.sparkSession
    none = spark.range(1).select(array_to_vector(F.array_repeat(F.lit(0.0), grid)).alias("k"), F.lit(1.0).alias("c"))  # a sum needs a row
    vectors = with_st.where(bw > 0).select(array_to_vector(each).alias("k"), F.col("c").cast("double").alias("c")).unionAll(none)
    total = vectors.agg(vector_to_array(Summarizer.metrics("sum").summary(F.col("k"), F.col("c"))["sum"]).alias("k"))
    out = spark.range(grid).select(F.col("id").cast("int").alias("point"), stats_row(total).alias("all"), st.alias("st"))
    scale = F.lit(math.sqrt(2 * math.pi)) * n * F.when(bw > 0, bw)
    return out.select("point", (lo + F.col("point") * step).alias("x"), (F.col("all.k")[F.col("point")] / scale).alias("density"))


def numeric_bounds(df: DataFrame, fallbacks: dict[str, tuple[float, float]], lo_q: float = 0.01,
                   hi_q: float = 0.99) -> DataFrame:
    """(column, lo, hi, used_fallback) of several columns from one quantile pass.

    The fallback holds when a column is empty, non-finite or has equal bounds.
    """
    cols = list(fallbacks)
    q = quantile_wide(df, cols, [lo_q, hi_q], names=["_lo", "_hi"])
    dim = df.sparkSession.createDataFrame([(c, float(a), float(b)) for c, (a, b) in fallbacks.items()],
                                          "column string, _a double, _b double")
    j = dim.join(q, "column", "left")  # one row a column on both sides
    bad = (F.col("_lo").isNull() | F.col("_hi").isNull() | F.isnan("_lo") | F.isnan("_hi") | (F.col("_lo") == F.col("_hi")))
    return j.select("column", F.when(bad, F.col("_a")).otherwise(F.col("_lo")).alias("lo"),
                    F.when(bad, F.col("_b")).otherwise(F.col("_hi")).alias("hi"), bad.alias("used_fallback"))


def quantile_bounds(df: DataFrame, col: str, lo_q: float = 0.01, hi_q: float = 0.99,
                    fallback: tuple[float, float] = (0.0, 1.0)) -> DataFrame:
    """(lo, hi, used_fallback) of one column, as :func:`numeric_bounds`."""
    return numeric_bounds(df, {col: fallback}, lo_q, hi_q).drop("column")


def quantile_levels(df: DataFrame, col: str, levels=(("Low", 0.25), ("Medium", 0.5), ("High", 0.75)),
                    fallback: dict[str, float] | None = None) -> DataFrame:
    """Named quantile levels ``(level, value)``; an empty column gives the ``fallback`` values (NULL without them)."""
    q = quantiles(df, [col], [p for _, p in levels]).select(F.col("q"), F.col("value").alias("_v"))
    fall = fallback or {}
    dim = df.sparkSession.createDataFrame([(lab, float(p), fall.get(lab)) for lab, p in levels],
                                          "level string, q double, _f double")
    return dim.join(q, "q", "left").select("level", F.coalesce("_v", "_f").alias("value"))
