"""Event rates by category, bucket and entity; class balance; top-n."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.session import cut_lineage


def _cols(by) -> list[str]:
    return [by] if isinstance(by, str) else list(by)


def event_rate(df: DataFrame, by, target: str, keep_null_keys: bool = False) -> DataFrame:
    """events = sum, rows = non-null count, rate = mean of ``target`` per key.

    Rows with a NULL key are dropped, as a pandas group-by does, unless
    ``keep_null_keys``.  Partial aggregation runs map-side before the shuffle.
    """
    keys = _cols(by)
    src = df
    if not keep_null_keys:
        for k in keys:
            src = src.where(F.col(k).isNotNull())
    return src.groupBy(*keys).agg(
        F.sum(target).cast("long").alias("events"),
        F.count(target).cast("long").alias("rows"),
        F.round(F.avg(target), 6).alias("rate"))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Positive / negative counts, positive rate, neg:pos imbalance, missing."""
    pos = F.sum((F.col(target) == 1).cast("long"))
    neg = F.sum((F.col(target) == 0).cast("long"))
    s = df.agg(pos.alias("positive"), neg.alias("negative"),
               F.sum(F.col(target).isNull().cast("long")).alias("missing"))
    tot = F.col("positive") + F.col("negative")
    return s.select(
        F.col("positive").cast("long").alias("positive"),
        F.col("negative").cast("long").alias("negative"),
        F.round(F.when(tot > 0, F.col("positive") / tot), 6).alias("positive_rate"),
        F.round(F.when(F.col("positive") > 0, F.col("negative") / F.col("positive")), 6)
        .alias("imbalance_ratio"),
        F.col("missing").cast("long").alias("missing"))


def rate_extremes(rates: DataFrame, label: str, rate: str = "rate") -> DataFrame:
    """Highest and lowest rate group and the spread between them in points.

    Ties go to the smallest label, so the result is deterministic.
    """
    return rates.agg(
        F.min(F.struct(F.lit(0) - F.col(rate), F.col(label)))[label].alias("max_label"),
        F.max(F.col(rate)).alias("max_rate"),
        F.min(F.struct(F.col(rate), F.col(label)))[label].alias("min_label"),
        F.min(F.col(rate)).alias("min_rate"),
    ).withColumn("spread_pp", F.round((F.col("max_rate") - F.col("min_rate")) * 100, 6))


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """``TakeOrderedAndProject``: a bounded top-k, never a global sort."""
    return df.orderBy(*order).limit(n)


def value_counts(df: DataFrame, col: str, normalize_total: bool = True) -> DataFrame:
    """Counts per value (NULL dropped) with the share of all non-null rows."""
    c = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).cast("long").alias("n"))
    if not normalize_total:
        return c
    c = cut_lineage(c)  # the total comes from the counts, not from the rows again
    total = c.agg(F.sum("n")).scalar()
    return c.select(col, "n", F.round(F.col("n") / total, 6).alias("share"))


def ordered_categories(agg: DataFrame, dim: DataFrame, key: str, ordinal: str = "ordinal") -> DataFrame:
    """Left join an aggregate onto a fixed category order; missing -> NULL.

    ``dim`` is the fixed order, one row a category, as is the aggregate; the
    strategy is left to their sizes at run time.
    """
    return dim.join(agg, key, "left").orderBy(ordinal)
