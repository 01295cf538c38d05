"""Spearman (average ranks) and Pearson correlation matrices.

Pairs are complete-case: a value's rank in column ``a`` beside column ``b``
counts the rows where both are known.  One table holds, for each distinct
value of each column, how often it occurs beside every column that has nulls,
and how often at all (the count for partners without nulls).  Running sums of
these counts give the ranks for all pairs at once; each column's rank map is
joined back on the value (broadcast when it is small), and every pair's
correlation is one aggregate expression of a single pass.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import BROADCAST_ROWS
from seqlens.operators.ranking import cumulative
from seqlens.session import cut_lineage


def _null_columns(df: DataFrame, cols: list[str]) -> list[str]:
    row = df.agg(*[F.max(F.col(c).isNull().cast("int")).alias(c) for c in cols]).first()
    return [c for c in cols if row[c]]


def pair_ranks(df: DataFrame, cols: list[str], partners: list[str]) -> DataFrame:
    """``(column, value, rank, rank_<b>...)``: average ranks in all rows, and in those where partner ``b`` is known."""
    known = [F.col(b).isNotNull().cast("long").alias(f"n_{b}") for b in partners]
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
    rows = df.select(*known, cells.alias("_kv")).select("_kv.*", F.lit(1).cast("long").alias("n"), *[f"n_{b}" for b in partners])
    counts = ["n", *[f"n_{b}" for b in partners]]
    vc = rows.where(F.col("value").isNotNull()).groupBy("column", "value").agg(*[F.sum(c).alias(c) for c in counts])
    cum = cumulative(vc, "value", counts, by=["column"])
    mean = lambda c: F.col(f"cum_{c}") - F.col(c) + (F.col(c) + 1) / 2.0
    return cum.select("column", "value", *[mean(c).alias("rank" + c[1:]) for c in counts])


def with_ranks(df: DataFrame, cols: list[str], partners: list[str], prefix: str = "_r_") -> DataFrame:
    """``df`` with ``<prefix><c>``, the rank of each column, and ``<prefix><c>_<b>``, that beside each partner.

    A column's rank map (one row per distinct value) is broadcast if it is
    small, so the rows aren't moved; else it is joined by a shuffle.
    """
    ranks = cut_lineage(pair_ranks(df, cols, partners))
    size = {r["column"]: r["count"] for r in ranks.groupBy("column").count().collect()}  # one row a column
    out = df
    for c in cols:
        m = ranks.where(F.col("column") == c).select(F.col("value").alias(f"_v_{c}"), F.col("rank").alias(f"{prefix}{c}"),
                                                     *[F.col(f"rank_{b}").alias(f"{prefix}{c}_{b}") for b in partners if b != c])
        if size.get(c, 0) <= BROADCAST_ROWS:
            m = F.broadcast(m)
        out = out.join(m, F.col(c).cast("double") == F.col(f"_v_{c}"), "left").drop(f"_v_{c}")
    return out


def spearman_pairs(df: DataFrame, pairs: list[tuple[str, str]], materialize: bool = True) -> DataFrame:
    """(a, b, spearman) for the given pairs.

    The input is read three times (null check, rank counts, rank join), so
    the needed columns are first written once to the shared checkpoint
    folder unless ``materialize`` is off.
    """
    cols = sorted({c for p in pairs for c in p})
    if materialize:
        df = cut_lineage(df.select(*cols))
    partners = _null_columns(df, cols)
    r = with_ranks(df.select(*cols), cols, partners)
    rank = lambda c, b: F.when(F.col(b).isNotNull(), F.col(f"_r_{c}_{b}" if b in partners else f"_r_{c}"))
    agg = r.agg(*[F.corr(rank(a, b), rank(b, a)).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("spearman"))
                                         for i, (a, b) in enumerate(pairs)])))


def spearman_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Full (a, b, spearman) matrix: diagonal 1, both triangles."""
    pairs = list(combinations(cols, 2))
    up = spearman_pairs(df, pairs)
    low = up.select(F.col("b").alias("a"), F.col("a").alias("b"), "spearman")
    diag = df.sparkSession.createDataFrame([(c, c, 1.0) for c in cols], "a string, b string, spearman double")
    return up.unionByName(low).unionByName(diag)


def target_correlation(df: DataFrame, cols: list[str], target: str) -> DataFrame:
    """Spearman and Pearson of each feature against the target."""
    df = cut_lineage(df.select(*cols, target))
    sp = spearman_pairs(df, [(c, target) for c in cols], materialize=False) \
        .select(F.col("a").alias("feature"), "spearman")
    pe = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    pe = pe.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("pearson"))
                                      for c in cols])))
    return sp.join(pe, "feature")
