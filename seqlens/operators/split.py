"""Group-level train/test split, group folds and seeded hash sampling.

Randomness is a hash of the key and the seed (never ``rand()``), so a re-run
after executor loss, or on another engine, gives the same membership.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import join_small, stats_row
from seqlens.operators.ranking import cumulative


def _hash_key(cols, seed) -> F.Column:
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in cols], F.lit(str(seed))))


def group_assignment(df: DataFrame, group: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """(group, split): the first ceil(test_frac * n_groups) groups in md5 order are 'test'."""
    groups = df.where(F.col(group).isNotNull()).select(group).distinct() \
               .withColumn("_h", _hash_key([group], seed)).withColumn("_one", F.lit(1))
    ranked = cumulative(groups, "_h", ["_one"])
    n = stats_row(ranked.agg(F.count(F.lit(1)).alias("n")))["n"]  # from the table just ranked, not from the rows again
    n_test = F.ceil(n * F.lit(float(test_frac)))
    return ranked.select(group, F.when(F.col("cum__one") <= n_test, "test").otherwise("train").alias("split"))


def group_split(df: DataFrame, group: str, test_frac: float = 0.2, seed: int = 42) -> DataFrame:
    """Rows with a ``split`` column; whole groups go to one side.

    The group map has one row per group; it is broadcast after a check of its
    size, so no row is shuffled to its group.
    """
    return join_small(df, group_assignment(df, group, test_frac, seed), group)


def test_groups(assign: DataFrame, group: str) -> DataFrame:
    return assign.where(F.col("split") == "test").agg(
        F.array_join(F.array_sort(F.collect_list(group)), ",").alias("test_groups"),
        F.count(F.lit(1)).cast("long").alias("n_test_groups"))


def split_overlap(split_df: DataFrame, group: str) -> DataFrame:
    """Groups present on both sides (must be 0)."""
    tr = split_df.where(F.col("split") == "train").select(group)
    te = split_df.where(F.col("split") == "test").select(group)
    return tr.intersect(te).agg(F.count(F.lit(1)).cast("long").alias("overlap"))


def split_metadata(split_df: DataFrame, target: str) -> DataFrame:
    return split_df.groupBy("split").agg(F.count(F.lit(1)).cast("long").alias("rows"),
                                         F.avg(target).alias("positive_rate"))


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """(group, fold): groups dealt to k folds in serpentine order of their size.

    Groups are ranked by size (largest first, ties by name) with the
    distributed running count, and dealt 0..k-1, k-1..0, 0..k-1 and so on: one
    rule at any number of groups, and nothing on the driver.  Two folds
    differ by no more than the largest group.
    """
    sizes = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    order = sizes.select(group, F.struct((-F.col("n")).alias("n"), F.col(group).alias("g")).alias("_o"), F.lit(1).alias("_one"))
    i = (F.col("cum__one") - 1).cast("long")
    turn, place = F.floor(i / k) % 2, (i % k).cast("int")
    ranked = cumulative(order, "_o", ["_one"])
    return ranked.select(group, F.when(turn == 0, place).otherwise(F.lit(k - 1) - place).cast("int").alias("fold"))


def hash_fold(cols, k: int = 5, seed: int = 42) -> F.Column:
    """Row-level fold from the md5 of the row key (for cross-fitting)."""
    h = F.conv(F.substring(_hash_key(cols, seed), 1, 8), 16, 10).cast("long")
    return F.pmod(h, F.lit(k)).cast("int")


def hash_sample(df: DataFrame, keys: list[str], n: int, seed: int = 42) -> DataFrame:
    """Exactly min(n, rows) rows, chosen by md5(key | seed) order.

    ``orderBy(...).limit(n)`` plans as a bounded top-k per partition.
    """
    return df.orderBy(_hash_key(keys, seed), *keys).limit(n)
