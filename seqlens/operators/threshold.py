"""Decision thresholds chosen on the precision-recall points."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS = 1e-12
BETA_SQ = 4.0  # F-beta with beta = 2 favours recall in the fallback
TARGET_RECALL = 0.60


def _f1(p, r):
    return 2 * p * r / (p + r + F.lit(EPS))


def _pick(points: DataFrame, by: list[str], score, where=None) -> DataFrame:
    """Best row per group by ``score`` desc, ties to the lowest threshold.

    A grouped ``min`` over a struct (partial aggregation on every partition),
    so a group with millions of distinct thresholds never sits in one task.
    """
    src = points if where is None else points.where(where)
    keep = [c for c in src.columns if c not in by]
    best = src.groupBy(*by).agg(F.min(F.struct((F.lit(0.0) - score).alias("_k"),
                                                 F.col("threshold").alias("_t"),
                                                 F.struct(*keep).alias("_row"))).alias("_b"))
    # a global aggregate over no rows still yields one (NULL) row: drop it
    return best.where(F.col("_b").isNotNull()).select(*by, "_b._row.*")


def _or_default(best: DataFrame, **extra) -> DataFrame:
    """Without groups, an empty curve gives the defined row (0.5, 0, 0, 0)."""
    none = best.sparkSession.range(1).select(F.lit(0.5).alias("threshold"), F.lit(0.0).alias("precision"),
                                             F.lit(0.0).alias("recall"), F.lit(0.0).alias("f1"),
                                             *[F.lit(v).alias(k) for k, v in extra.items()])
    return best.unionByName(none.where(best.agg(F.count(F.lit(1))).scalar() == 0))


def threshold_f1(points: DataFrame, by=None) -> DataFrame:
    """Threshold of maximum F1 (lowest threshold on ties).

    ``points`` come from :func:`seqlens.operators.metrics.pr_points`; its row
    count per group is the number of distinct scores, so the ranking window
    works on that small table, one partition per group.
    """
    by = list(by or [])
    best = _pick(points.withColumn("f1", _f1(F.col("precision"), F.col("recall"))), by, F.col("f1"))
    best = best.select(*by, "threshold", "precision", "recall", "f1")
    return best if by else _or_default(best)


def threshold_recall_target(points: DataFrame, target: float = TARGET_RECALL, by=None) -> DataFrame:
    """Highest-precision threshold with recall >= target; else best F-beta(2).

    ``policy`` says which branch chose the row.
    """
    by = list(by or [])
    hit = _pick(points, by, F.col("precision"), F.col("recall") >= F.lit(target)) \
        .withColumn("policy", F.lit("recall_target"))
    fb = (1 + BETA_SQ) * F.col("precision") * F.col("recall") / \
         (BETA_SQ * F.col("precision") + F.col("recall") + F.lit(EPS))
    fall = _pick(points.withColumn("_fb", fb), by, F.col("_fb")).drop("_fb") \
        .withColumn("policy", F.lit("fbeta2_fallback"))
    if by:
        fall = fall.join(hit.select(*by), by, "left_anti")
        both = hit.unionByName(fall)
    else:
        # fallback only when no threshold reaches the target
        both = hit.unionByName(fall.where(hit.agg(F.count(F.lit(1))).scalar() == 0))
    both = both.select(*by, "threshold", "precision", "recall",
                       _f1(F.col("precision"), F.col("recall")).alias("f1"), "policy")
    return both if by else _or_default(both, policy="no_scores")
