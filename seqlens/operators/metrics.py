"""Exact rare-event metrics over a long score table ``(by..., y, p)``.

Scores are first aggregated per distinct value (map-side combine), then the
distributed running sum of :mod:`seqlens.operators.ranking` gives the curve;
no step orders the whole table inside one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import join_small, stats_row
from seqlens.operators.ranking import cumulative

EPS = 1e-12


def _by(by) -> list[str]:
    return [] if by is None else ([by] if isinstance(by, str) else list(by))


def score_groups(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """(by..., p, pos, neg) per distinct score."""
    by = _by(by)
    return (scores.where(F.col(p).isNotNull())
                  .groupBy(*by, F.col(p).alias("p"))
                  .agg(F.sum(F.col(y).cast("long")).alias("pos"),
                       F.sum((1 - F.col(y)).cast("long")).alias("neg")))


def _curve(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """Cumulative positives/negatives at each distinct threshold (p >= t)."""
    by = _by(by)
    g = score_groups(scores, by, y, p)
    return cumulative(g, "p", ["pos", "neg"], by=by, descending=True, totals=True).withColumnsRenamed(
        {"all_pos": "_P", "all_neg": "_N"})


def pr_points(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """Precision / recall at every distinct threshold (ascending thresholds)."""
    by = _by(by)
    c = _curve(scores, by, y, p)
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    return c.select(*by, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"),
                    (tp / (tp + fp)).alias("precision"),
                    F.when(F.col("_P") > 0, tp / F.col("_P")).otherwise(F.lit(1.0)).alias("recall"))


def roc_points(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """(fpr, tpr) per distinct threshold plus the (0, 0) start (threshold NULL)."""
    by = _by(by)
    c = _curve(scores, by, y, p)
    pts = c.select(*by, F.col("p").alias("threshold"),
                   (F.col("cum_neg") / F.col("_N")).alias("fpr"),
                   (F.col("cum_pos") / F.col("_P")).alias("tpr"))
    start = (scores.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
                   .select(*by, F.lit(None).cast("double").alias("threshold"),
                           F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")))
    return pts.unionByName(start)


def average_precision(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """Step AP = sum over thresholds of (recall gain) x precision; NULL without positives."""
    by = _by(by)
    c = _curve(scores, by, y, p)
    contrib = F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))
    a = c.groupBy(*by).agg(F.sum(contrib).alias("_s"), F.first("_P").alias("_P"))
    return a.select(*by, F.when(F.col("_P") > 0, F.col("_s") / F.col("_P")).alias("average_precision"))


def roc_auc(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """Tie-corrected Mann-Whitney AUC; NULL with one class or one distinct score."""
    by = _by(by)
    g = score_groups(scores, by, y, p)
    cum = cumulative(g, "p", ["neg"], by=by)
    part = F.col("pos") * ((F.col("cum_neg") - F.col("neg")) + F.col("neg") / 2.0)
    a = cum.groupBy(*by).agg(F.sum(part).alias("_s"), F.sum("pos").alias("_P"),
                             F.sum("neg").alias("_N"), F.count(F.lit(1)).alias("_d"))
    ok = (F.col("_P") > 0) & (F.col("_N") > 0) & (F.col("_d") > 1)
    return a.select(*by, F.when(ok, F.col("_s") / (F.col("_P") * F.col("_N"))).alias("roc_auc"))


def brier(scores: DataFrame, by=None, y: str = "y", p: str = "p") -> DataFrame:
    by = _by(by)
    return scores.groupBy(*by).agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def threshold_metrics(scores: DataFrame, threshold, by=None, y: str = "y", p: str = "p") -> DataFrame:
    """Precision, recall, F1 at ``p >= threshold``; zero division -> 0."""
    by = _by(by)
    t = threshold if not isinstance(threshold, (int, float)) else F.lit(float(threshold))
    pred = (F.col(p) >= t).cast("long")
    a = scores.groupBy(*by).agg(
        F.sum(pred * F.col(y)).alias("tp"), F.sum(pred * (1 - F.col(y))).alias("fp"),
        F.sum((1 - pred) * F.col(y)).alias("fn"))
    prec = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)
    rec = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return a.select(*by, "tp", "fp", "fn", prec.alias("precision"), rec.alias("recall")) \
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def confusion(scores: DataFrame, by=None, y: str = "y", pred: str = "pred") -> DataFrame:
    by = _by(by)
    return scores.groupBy(*by, F.col(y).alias("y"), F.col(pred).alias("pred")) \
                 .agg(F.count(F.lit(1)).alias("n"))


def recall_by_group(scores: DataFrame, group: str, y: str = "y", pred: str = "pred", by=None) -> DataFrame:
    """Positives and recall per group; recall NULL when a group has no positives."""
    by = _by(by)
    a = scores.groupBy(*by, group).agg(F.sum(F.col(y)).alias("positives"),
                                       F.sum(F.col(y) * F.col(pred)).alias("_tp"))
    return a.select(*by, group, F.col("positives").cast("long").alias("positives"),
                    F.when(F.col("positives") > 0, F.col("_tp") / F.col("positives")).alias("recall"))


def compare_models(scores: DataFrame, threshold=0.5, model: str = "model",
                   y: str = "y", p: str = "p") -> DataFrame:
    """All metrics per model in long-form scores; one row per model.

    ``threshold`` is a number or a column (each model's own).  The scores are
    read once: per distinct score the classes are counted, with the flagged
    rows of each class beside them; average precision and ROC-AUC come from
    one running count over that table, the rest from plain sums.
    """
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    hit = (F.col(p) >= t).cast("long")
    g = scores.where(F.col(p).isNotNull()).groupBy(model, F.col(p).alias("p")).agg(
        F.sum(F.col(y).cast("long")).alias("pos"), F.sum((1 - F.col(y)).cast("long")).alias("neg"),
        F.sum(hit * F.col(y)).alias("tp"), F.sum(hit * (1 - F.col(y))).alias("fp"))
    c = cumulative(g, "p", ["pos", "neg"], by=[model], descending=True)
    # pairs (positive, negative) ordered right: negatives scored below, half of those tied
    above = F.col("cum_neg") - F.col("neg") / 2.0
    a = c.groupBy(model).agg(
        F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("_ap"),
        F.sum(F.col("pos") * above).alias("_wrong"), F.sum("pos").alias("_P"), F.sum("neg").alias("_N"),
        F.count(F.lit(1)).alias("_d"), F.sum("tp").alias("_tp"), F.sum("fp").alias("_fp"),
        F.sum(F.col("pos") * F.pow(F.col("p") - 1, 2) + F.col("neg") * F.pow(F.col("p"), 2)).alias("_sq"))
    two = (F.col("_P") > 0) & (F.col("_N") > 0) & (F.col("_d") > 1)
    prec = F.when(F.col("_tp") + F.col("_fp") > 0, F.col("_tp") / (F.col("_tp") + F.col("_fp"))).otherwise(0.0)
    rec = F.when(F.col("_P") > 0, F.col("_tp") / F.col("_P")).otherwise(0.0)
    return a.select(model, F.when(F.col("_P") > 0, F.col("_ap") / F.col("_P")).alias("average_precision"),
                    F.when(two, 1 - F.col("_wrong") / (F.col("_P") * F.col("_N"))).alias("roc_auc"),
                    (F.col("_sq") / (F.col("_P") + F.col("_N"))).alias("brier"), prec.alias("precision"), rec.alias("recall")) \
            .withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0,
                                     2 * F.col("precision") * F.col("recall")
                                     / (F.col("precision") + F.col("recall"))).otherwise(0.0))


def select_best(cmp: DataFrame, target_recall: float = 0.60, model: str = "model") -> DataFrame:
    """Model reaching the recall target with the best AP; else the best AP.

    Ties go to the smallest model name.  A grouped-free global ``min`` over a
    struct keeps this a two-stage aggregate.
    """
    key = F.struct(F.col("recall") < F.lit(target_recall),
                   F.lit(0.0) - F.coalesce(F.col("average_precision"), F.lit(-1.0)),
                   F.col(model))
    best = cmp.agg(F.min(F.struct(key.alias("_k"), F.struct(*cmp.columns).alias("_row"))).alias("_b"))
    return best.where(F.col("_b").isNotNull()).select("_b._row.*").withColumn(
        "reached_target", F.col("recall") >= F.lit(target_recall))


def best_by_roc(cmp: DataFrame, named: str | None = None, model: str = "model", roc: str = "roc_auc") -> DataFrame:
    """The named model's row if it is listed, else the row with the highest numeric ROC-AUC."""
    pri = F.when(F.col(model) == F.lit(named), 0).otherwise(1)
    num = F.col(roc).cast("string").try_cast("double")
    cand = cmp.withColumn("_pri", pri).where((F.col("_pri") == 0) | num.isNotNull())
    return cand.orderBy("_pri", num.desc_nulls_last(), model).limit(1).drop("_pri")
