"""Feature encoders fitted on training rows and applied by expression or join.

Fitted statistics are DataFrames (one row per column or per category); the
apply step reads them through a scalar subquery (per-column stats) or a join
(per-category maps, strategy left to AQE).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import join_small, stats_row
from seqlens.operators.ranking import cumulative, quantile_wide
from seqlens.session import cut_lineage

UNKNOWN_CODE = -1


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """neg/pos ratio (positives floored at 1) and balanced n / (2 n_class)."""
    s = df.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col(target) == 1).cast("long")).alias("p"),
               F.sum((F.col(target) == 0).cast("long")).alias("q"))
    return s.select((F.col("q") / F.greatest(F.col("p"), F.lit(1))).alias("pos_weight"),
                    F.when(F.col("q") > 0, F.col("n") / (2.0 * F.col("q"))).alias("balanced_weight_0"),
                    F.when(F.col("p") > 0, F.col("n") / (2.0 * F.col("p"))).alias("balanced_weight_1"))


def add_weight(df: DataFrame, target: str, weights: DataFrame, col: str = "weight",
               kind: str = "balanced") -> DataFrame:
    w = stats_row(weights)
    if kind == "balanced":
        e = F.when(F.col(target) == 1, w["balanced_weight_1"]).otherwise(w["balanced_weight_0"])
    else:
        e = F.when(F.col(target) == 1, w["pos_weight"]).otherwise(F.lit(1.0))
    return df.withColumn(col, e.cast("double"))


# -- robust scaling ------------------------------------------------------------

def fit_robust(train: DataFrame, cols: list[str], written: bool = False) -> DataFrame:
    """(column, median, iqr) with exact quartiles; a zero IQR scales by 1 (``written``: ``train`` is, see ``quantiles``)."""
    q = quantile_wide(train, cols, [0.25, 0.5, 0.75], names=["q1", "median", "q3"], written=written)
    return q.select("column", "median",
                    F.when((F.col("q3") - F.col("q1")) == 0, F.lit(1.0))
                     .otherwise(F.col("q3") - F.col("q1")).alias("iqr"))


def apply_robust(df: DataFrame, stats: DataFrame, cols: list[str], suffix: str = "") -> DataFrame:
    wide = stats.agg(*[F.max(F.when(F.col("column") == c, F.col("median"))).alias(f"m_{c}") for c in cols],
                     *[F.max(F.when(F.col("column") == c, F.col("iqr"))).alias(f"i_{c}") for c in cols])
    s = stats_row(wide)
    return df.select("*", *[((F.col(c).cast("double") - s[f"m_{c}"]) / s[f"i_{c}"]).alias(f"{c}{suffix}")
                            for c in cols]) if suffix else \
        df.select(*[((F.col(c).cast("double") - s[f"m_{c}"]) / s[f"i_{c}"]).alias(c) if c in cols else F.col(c)
                    for c in df.columns])


# -- one-hot -------------------------------------------------------------------

def fit_onehot(train: DataFrame, col: str) -> list[str]:
    """Sorted categories of a low-cardinality column; each becomes a column, so their number is a schema's, not a table's."""
    cats = train.where(F.col(col).isNotNull()).select(F.col(col).cast("string").alias("v")).distinct().orderBy("v").collect()
    return [r["v"] for r in cats]


def apply_onehot(df: DataFrame, col: str, categories: list[str]) -> DataFrame:
    """One 0/1 column per fitted category; unknown values give all zeros."""
    return df.select("*", *[(F.col(col).cast("string") == F.lit(c)).cast("double").alias(f"{col}_{c}")
                            for c in categories]).na.fill(0.0, [f"{col}_{c}" for c in categories])


# -- ordinal -------------------------------------------------------------------

def fit_ordinal(train: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, code): code = rank of the sorted distinct value - 1."""
    st = train.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols]))
        .alias("_kv")).select("_kv.*").where(F.col("value").isNotNull()).distinct().withColumn("_one", F.lit(1))
    return cumulative(st, "value", ["_one"], by=["column"]).select(
        "column", "value", (F.col("cum__one") - 1).cast("int").alias("code"))


def apply_ordinal(df: DataFrame, codes: DataFrame, cols: list[str], suffix: str = "_code") -> DataFrame:
    out = df
    for c in cols:
        m = codes.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("code").alias(f"{c}{suffix}"))
        out = join_small(out, m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}") \
                 .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), F.lit(UNKNOWN_CODE)))
    return out


# -- target encoding -----------------------------------------------------------

def _shrunk(n, mean_c, var_c, mean_all, var_all):
    lam = (n * var_all) / (n * var_all + var_c)
    enc = lam * mean_c + (1 - lam) * mean_all
    return F.when((var_all > 0) & (n > 0), enc).otherwise(mean_all)


def fit_target(train: DataFrame, cols: list[str], target: str) -> DataFrame:
    """(column, value, encoding) with empirical-Bayes ("auto") shrinkage.

    lambda = n var_all / (n var_all + var_cat) with population variances;
    enc = lambda mean_cat + (1 - lambda) mean_all.
    """
    y = F.col(target).cast("double")
    g = stats_row(train.agg(F.avg(y).alias("m"), F.var_pop(y).alias("v")))
    st = train.select(y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv")) \
        .select("_y", "_kv.*")
    cat = st.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"), F.avg("_y").alias("m"),
                                            F.var_pop("_y").alias("v"))
    return cat.select("column", "value", _shrunk(F.col("n"), F.col("m"), F.col("v"), g["m"], g["v"])
                      .alias("encoding"))


def target_prior(train: DataFrame, target: str) -> DataFrame:
    return train.agg(F.avg(F.col(target).cast("double")).alias("prior"))


def apply_target(df: DataFrame, enc: DataFrame, cols: list[str], prior: DataFrame, suffix: str = "_te") -> DataFrame:
    """Join each column's category map; unknown categories get the prior."""
    p = stats_row(prior)["prior"]
    out = df
    for c in cols:
        m = enc.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("encoding").alias(f"{c}{suffix}"))
        out = join_small(out, m, F.col(c).cast("string") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}") \
                 .withColumn(f"{c}{suffix}", F.coalesce(F.col(f"{c}{suffix}"), p))
    return out


def target_encode_oof(train: DataFrame, cols: list[str], target: str, fold: str, suffix: str = "_te") -> DataFrame:
    """Cross-fitted target encoding of training rows, by subtraction.

    For a row in fold k, the statistics come from all rows outside fold k:
    category totals minus (category, fold) totals.  One grouped count over
    (column, value, fold) serves all columns; its encodings are a map table
    that is joined once for each column.  Binary target: var = m (1 - m).
    """
    y = F.col(target).cast("double")
    stack = train.select(F.col(fold).alias("_f"), y.alias("_y"), F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in cols])).alias("_kv"))
    part = cut_lineage(stack.groupBy("_f", "_kv.column", "_kv.value").agg(F.count(F.lit(1)).alias("n"), F.sum("_y").alias("s")))
    folds = part.where(F.col("column") == cols[0]).groupBy("_f").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    glob = folds.agg(F.map_from_entries(F.collect_list(F.struct("_f", F.struct("n", "s")))).alias("of"),
                     F.sum("n").alias("n"), F.sum("s").alias("s"))  # one entry a fold
    g = stats_row(glob)
    whole = part.groupBy("column", "value").agg(F.sum("n").alias("wn"), F.sum("s").alias("ws"))
    all_n, all_s = g["n"] - g["of"][F.col("_f")]["n"], g["s"] - g["of"][F.col("_f")]["s"]
    mean_all = all_s / all_n
    n, s = F.col("wn") - F.coalesce(F.col("n"), F.lit(0)), F.col("ws") - F.coalesce(F.col("s"), F.lit(0.0))
    enc = F.when(n > 0, _shrunk(n, s / n, (s / n) * (1 - s / n), mean_all, mean_all * (1 - mean_all))).otherwise(mean_all)
    maps = cut_lineage(part.withColumnsRenamed({"column": "c2", "value": "v2"})
                       .join(whole, (F.col("c2") == F.col("column")) & F.col("v2").eqNullSafe(F.col("value")))
                       .select("column", "value", "_f", enc.alias("x")))
    out = train
    for c in cols:
        m = maps.where(F.col("column") == c).select(F.col("value").alias("_v"), F.col("_f"), F.col("x").alias(f"{c}{suffix}"))
        out = join_small(out, m, F.col(c).cast("string").eqNullSafe(F.col("_v")) & (F.col(fold) == F.col("_f")), "left") \
            .drop("_v", "_f")
    return out
