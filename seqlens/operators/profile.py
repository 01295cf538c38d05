"""Single-scan table profiles: shape, nulls, duplicates, cardinality, describe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import stats_row
from seqlens.operators.ranking import quantile_wide
from seqlens.session import cut_lineage

ONE_HOT_MAX = 10  # fixed rule: at most 10 distinct values -> one-hot


def shape(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).cast("long").alias("n_rows")) \
             .select("n_rows", F.lit(len(df.columns)).cast("int").alias("n_columns"))


def _long(agg: DataFrame, cols: list[str], name: str) -> DataFrame:
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias(name)) for c in cols])
    return agg.select(F.inline(pairs))


def null_profile(df: DataFrame, only_positive: bool = True) -> DataFrame:
    """(column, n_null) in one pass; NaN in doubles counts as missing too."""
    exprs = []
    for f in df.schema.fields:
        miss = F.col(f.name).isNull()
        if f.dataType.typeName() in ("double", "float"):
            miss = miss | F.isnan(F.col(f.name))
        exprs.append(F.sum(miss.cast("long")).alias(f.name))
    out = _long(df.agg(*exprs), df.columns, "n_null")
    return out.where(F.col("n_null") > 0) if only_positive else out


def duplicate_rows(df: DataFrame) -> DataFrame:
    """Rows beyond the first copy of each distinct row.

    128-bit digests of the rows are counted first; only rows whose digest was
    met twice are shuffled and compared whole.
    """
    cols = [F.col(f"`{c}`") for c in df.columns]
    keyed = df.withColumns({"_d1": F.xxhash64(*cols), "_d2": F.xxhash64(F.lit(1), *cols)})
    twice = keyed.groupBy("_d1", "_d2").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).drop("_n")
    return (keyed.join(twice, ["_d1", "_d2"], "left_semi").groupBy(*cols).agg(F.count(F.lit(1)).alias("_n"))
            .agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("long").alias("duplicate_rows")))


def cardinality(df: DataFrame, cols: list[str], approx: bool = False) -> DataFrame:
    """Distinct non-null values per column (``approx`` for HyperLogLog++)."""
    fn = (lambda c: F.approx_count_distinct(c)) if approx else (lambda c: F.count_distinct(c))
    agg = df.agg(*[fn(c).cast("long").alias(c) for c in cols])
    return _long(agg, cols, "n_unique")


def encoding_advice(df: DataFrame, cols: list[str]) -> DataFrame:
    return cardinality(df, cols).withColumn(
        "encoding", F.when(F.col("n_unique") <= ONE_HOT_MAX, "one-hot").otherwise("target-encode"))


def value_range(df: DataFrame, col: str) -> DataFrame:
    """min, max and the sorted distinct values joined by commas."""
    return df.agg(F.min(col).alias("min_value"), F.max(col).alias("max_value"),
                  F.array_join(F.array_sort(F.collect_set(F.col(col).cast("string"))), ",").alias("values"))


def describe_exact(df: DataFrame, cols: list[str]) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max per column."""
    rows = cut_lineage(df.select(*[F.col(c).cast("double").alias(c) for c in cols]))  # moments and quantiles read it
    stacked = rows.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in cols])).alias("_kv")).select("_kv.*")
    moments = stacked.groupBy("column").agg(
        F.count("value").cast("long").alias("count"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantile_wide(rows, cols, [0.25, 0.5, 0.75], names=["q25", "q50", "q75"], written=True)
    return moments.join(qs, "column", "left").select(
        "column", "count", "mean", "std", "min", "q25", "q50", "q75", "max")


def zscore_outliers(df: DataFrame, cols: list[str], k: float = 3.0) -> DataFrame:
    """Share of rows with |z| > k (population std) and the value range.

    Means and stds come from a one-row scalar subquery, so the second pass is
    a plain map + partial aggregate.
    """
    st = stats_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols],
                          *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    exprs = []
    for c in cols:
        z = (F.col(c) - st[f"m_{c}"]) / st[f"s_{c}"]
        exprs += [F.avg(F.coalesce((F.abs(z) > k).cast("double"), F.lit(0.0))).alias(f"share_{c}"),
                  F.min(c).cast("double").alias(f"min_{c}"), F.max(c).cast("double").alias(f"max_{c}")]
    agg = df.agg(*exprs)
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"share_{c}").alias("outlier_share"),
                              F.col(f"min_{c}").alias("min"), F.col(f"max_{c}").alias("max"))
                     for c in cols])
    return agg.select(F.inline(rows))


def predicate_share(df: DataFrame, preds: dict) -> DataFrame:
    """(name, share) of rows where each predicate holds (NULL counts as false)."""
    agg = df.agg(*[F.avg(F.coalesce(p.cast("double"), F.lit(0.0))).alias(n) for n, p in preds.items()])
    return _long(agg, list(preds), "share")


def counters(df: DataFrame, group: str, entity: str) -> DataFrame:
    """Dashboard counters: rows, features (= columns - 1), groups, entities."""
    return df.agg(F.count(F.lit(1)).cast("long").alias("rows"),
                  F.count_distinct(group).cast("long").alias("n_groups"),
                  F.count_distinct(entity).cast("long").alias("n_entities")) \
             .withColumn("features", F.lit(len(df.columns) - 1))


def column_defaults(df: DataFrame, numeric: list[str], categorical: list[str],
                    integer: tuple[str, ...] = ()) -> DataFrame:
    """Median for numerics (half-even rounded for integer columns); mode for text.

    The mode breaks ties by the smallest value.  Output ``(column,
    numeric_default, text_default)``.
    """
    df = cut_lineage(df.select(*dict.fromkeys([*numeric, *categorical])))  # medians and modes read it
    med = quantile_wide(df, numeric, [0.5], names=["median"], written=True)
    med = med.select("column", F.when(F.col("column").isin(*integer) if integer else F.lit(False),
                                      F.bround("median", 0)).otherwise(F.col("median")).alias("numeric_default"),
                     F.lit(None).cast("string").alias("text_default"))
    if not categorical:
        return med
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical]))
        .alias("_kv")).select("_kv.*").where(F.col("value").isNotNull())
    counts = stacked.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    mode = counts.groupBy("column").agg(
        F.min(F.struct(F.lit(0) - F.col("n"), F.col("value")))["value"].alias("text_default"))
    return med.unionByName(mode.select("column", F.lit(None).cast("double").alias("numeric_default"),
                                       "text_default"))


def distinct_options(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct values as text: ``(column, value, ordinal)``.

    The ordinal is a distributed running count, so a column with very many
    distinct values is still spread over range partitions.
    """
    from seqlens.operators.ranking import cumulative
    stacked = df.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
        .alias("_kv")).select("_kv.*").where(F.col("value").isNotNull()).distinct() \
        .withColumn("_one", F.lit(1))
    return cumulative(stacked, "value", ["_one"], by=["column"]) \
        .select("column", "value", F.col("cum__one").cast("int").alias("ordinal"))


def head(df: DataFrame, order: list[str], n: int = 5, cols: list[str] | None = None) -> DataFrame:
    """First ``n`` rows in key order: a bounded top-k, not a global sort."""
    out = df.orderBy(*order).limit(n)
    return out.select(*cols) if cols else out


def tail(df: DataFrame, order: list[str], n: int = 5, cols: list[str] | None = None) -> DataFrame:
    out = df.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return out.select(*cols) if cols else out


def assert_no_null(df: DataFrame, cols: list[str], label: str = "X") -> None:
    """Raise when any of ``cols`` holds NULL or NaN (one aggregate pass)."""
    exprs = []
    for c in cols:
        miss = F.col(c).isNull()
        if dict(df.dtypes)[c] in ("double", "float"):
            miss = miss | F.isnan(c)
        exprs.append(F.sum(miss.cast("long")))
    n = df.agg(sum(exprs[1:], exprs[0]).alias("n")).first()["n"] if exprs else 0
    if n:
        raise AssertionError(f"{label} contains {n} missing values")
