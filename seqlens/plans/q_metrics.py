"""Metric, curve and threshold queries over deterministic score columns.

Scores come from the laps view (no model needed) so every metric has an
exact oracle: risk = min(risk_score / 200, 1), tyre = normalized tyre life,
progress = race progress, majority = constant 0.
"""

from pyspark.sql import functions as F

from seqlens.functions.util import r6
from seqlens.operators import metrics as M
from seqlens.operators import threshold as T
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.registry import register
from seqlens.session import cut_lineage
from seqlens.sources.testdata import laps

THRESHOLD = 0.5


def model_scores(spark, sf):
    l = laps(spark, sf)
    models = [("risk", F.least(F.col("risk_score") / 200.0, F.lit(1.0))),
              ("tyre", F.col("normalized_tyre_life")),
              ("progress", F.col("race_progress")),
              ("majority", F.lit(0.0))]
    arr = F.array(*[F.struct(F.lit(n).alias("model"), e.cast("double").alias("p")) for n, e in models])
    return (l.select("driver", "race", "yr", "lap", F.col("will_pit").alias("y"), F.explode(arr).alias("m"))
             .select("m.model", "driver", "race", "yr", "lap", "y", "m.p"))


def risk_scores(spark, sf):
    return model_scores(spark, sf).where(F.col("model") == "risk")


SCORES = """
, scores AS (
 SELECT 'risk' AS model, driver, race, yr, lap, will_pit AS y, cast(least(risk_score / 200.0, 1.0) AS DOUBLE) AS p FROM laps
 UNION ALL SELECT 'tyre', driver, race, yr, lap, will_pit, normalized_tyre_life FROM laps
 UNION ALL SELECT 'progress', driver, race, yr, lap, will_pit, race_progress FROM laps
 UNION ALL SELECT 'majority', driver, race, yr, lap, will_pit, 0.0::DOUBLE FROM laps),
g AS (SELECT model, p, sum(y) AS pos, sum(1 - y) AS neg FROM scores GROUP BY model, p),
cd AS (SELECT model, p, pos, neg,
        sum(pos) OVER (PARTITION BY model ORDER BY p DESC) AS cp,
        sum(neg) OVER (PARTITION BY model ORDER BY p DESC) AS cn,
        sum(pos) OVER (PARTITION BY model) AS tp_all, sum(neg) OVER (PARTITION BY model) AS tn_all FROM g),
ap AS (SELECT model, CASE WHEN sum(pos) > 0 THEN sum(pos * cp / (cp + cn)) / sum(pos) END AS average_precision
       FROM cd GROUP BY model),
ca AS (SELECT model, p, pos, neg, sum(neg) OVER (PARTITION BY model ORDER BY p ASC) AS cna FROM g),
auc AS (SELECT model, CASE WHEN sum(pos) > 0 AND sum(neg) > 0 AND count(*) > 1
          THEN sum(pos * ((cna - neg) + neg / 2.0)) / (sum(pos) * sum(neg)) END AS roc_auc FROM ca GROUP BY model),
tm AS (SELECT model, sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) AS tp, sum(CASE WHEN p >= 0.5 THEN 1 - y ELSE 0 END) AS fp,
        sum(CASE WHEN p < 0.5 THEN y ELSE 0 END) AS fn, avg((p - y) * (p - y)) AS brier FROM scores GROUP BY model),
tm2 AS (SELECT model, tp, fp, fn, brier,
        CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END AS precision,
        CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END AS recall FROM tm),
tm3 AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END AS f1 FROM tm2),
pr AS (SELECT model, p AS threshold, cp AS tp, cn AS fp, cp / (cp + cn) AS precision,
        CASE WHEN tp_all > 0 THEN cp / tp_all ELSE 1.0 END AS recall FROM cd)
"""


@register("q_average_precision", with_laps(SCORES + """
SELECT model, round(average_precision, 6) AS average_precision FROM ap"""))
def q_average_precision(spark, sf):
    return M.average_precision(model_scores(spark, sf), "model") \
        .select("model", r6("average_precision").alias("average_precision"))


@register("q_roc_auc", with_laps(SCORES + """
SELECT model, round(roc_auc, 6) AS roc_auc FROM auc"""))
def q_roc_auc(spark, sf):
    return M.roc_auc(model_scores(spark, sf), "model").select("model", r6("roc_auc").alias("roc_auc"))


@register("q_pr_curve", with_laps(SCORES + """
SELECT model, round(threshold, 6) AS threshold, cast(tp AS BIGINT) AS tp, cast(fp AS BIGINT) AS fp,
       round(precision, 6) AS precision, round(recall, 6) AS recall FROM pr"""))
def q_pr_curve(spark, sf):
    pts = M.pr_points(model_scores(spark, sf), "model")
    return pts.select("model", r6("threshold").alias("threshold"), F.col("tp").cast("long").alias("tp"),
                      F.col("fp").cast("long").alias("fp"), r6("precision").alias("precision"),
                      r6("recall").alias("recall"))


@register("q_roc_curve", with_laps(SCORES + """
SELECT model, round(p, 6) AS threshold, round(cn / tn_all, 6) AS fpr, round(cp / tp_all, 6) AS tpr FROM cd
UNION ALL SELECT DISTINCT model, NULL, 0.0, 0.0 FROM scores"""))
def q_roc_curve(spark, sf):
    pts = M.roc_points(model_scores(spark, sf), "model")
    return pts.select("model", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@register("q_brier", with_laps(SCORES + """
SELECT model, round(brier, 6) AS brier FROM tm"""))
def q_brier(spark, sf):
    return M.brier(model_scores(spark, sf), "model").select("model", r6("brier").alias("brier"))


@register("q_threshold_metrics", with_laps(SCORES + """
SELECT model, cast(tp AS BIGINT) AS tp, cast(fp AS BIGINT) AS fp, cast(fn AS BIGINT) AS fn,
       round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM tm3"""))
def q_threshold_metrics(spark, sf):
    t = M.threshold_metrics(model_scores(spark, sf), THRESHOLD, "model")
    return t.select("model", F.col("tp").cast("long").alias("tp"), F.col("fp").cast("long").alias("fp"),
                    F.col("fn").cast("long").alias("fn"), r6("precision").alias("precision"),
                    r6("recall").alias("recall"), r6("f1").alias("f1"))


@register("q_confusion", with_laps(SCORES + """
SELECT model, y, cast(p >= 0.5 AS INT) AS pred, cast(count(*) AS BIGINT) AS n FROM scores GROUP BY ALL"""))
def q_confusion(spark, sf):
    s = model_scores(spark, sf).withColumn("pred", (F.col("p") >= THRESHOLD).cast("int"))
    return M.confusion(s, "model").select("model", "y", "pred", F.col("n").cast("long").alias("n"))


@register("q_recall_by_group", with_laps(SCORES + """
SELECT model, race, cast(sum(y) AS BIGINT) AS positives,
       round(CASE WHEN sum(y) > 0 THEN sum(CASE WHEN p >= 0.5 THEN y ELSE 0 END) / sum(y) END, 6) AS recall
FROM scores GROUP BY model, race"""))
def q_recall_by_group(spark, sf):
    s = model_scores(spark, sf).withColumn("pred", (F.col("p") >= THRESHOLD).cast("int"))
    return M.recall_by_group(s, "race", by="model").select("model", "race", "positives", r6("recall").alias("recall"))


@register("q_threshold_f1", with_laps(SCORES + """
, f AS (SELECT model, threshold, precision, recall, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr),
b AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold ASC) AS rk FROM f)
SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1
FROM b WHERE rk = 1"""))
def q_threshold_f1(spark, sf):
    best = T.threshold_f1(M.pr_points(model_scores(spark, sf), "model"), ["model"])
    return best.select("model", "threshold", r6("precision").alias("precision"),
                       r6("recall").alias("recall"), r6("f1").alias("f1"))


def _recall_target_sql(target):
    return with_laps(SCORES + f"""
, hit AS (SELECT model, threshold, precision, recall,
          row_number() OVER (PARTITION BY model ORDER BY precision DESC, threshold ASC) AS rk
          FROM pr WHERE recall >= {target}),
fb AS (SELECT model, threshold, precision, recall,
          row_number() OVER (PARTITION BY model ORDER BY
            5.0 * precision * recall / (4.0 * precision + recall + 1e-12) DESC, threshold ASC) AS rk FROM pr),
pick AS (SELECT model, threshold, precision, recall, 'recall_target' AS policy FROM hit WHERE rk = 1
  UNION ALL SELECT model, threshold, precision, recall, 'fbeta2_fallback' FROM fb
  WHERE rk = 1 AND model NOT IN (SELECT model FROM hit))
SELECT model, threshold, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(2 * precision * recall / (precision + recall + 1e-12), 6) AS f1, policy FROM pick""")


def _recall_target(spark, sf, target):
    points = cut_lineage(M.pr_points(model_scores(spark, sf), "model"))  # read for the target and for the fallback
    best = T.threshold_recall_target(points, target, ["model"])
    return best.select("model", "threshold", r6("precision").alias("precision"),
                       r6("recall").alias("recall"), r6("f1").alias("f1"), "policy")


@register("q_threshold_recall_target", _recall_target_sql(0.6))
def q_threshold_recall_target(spark, sf):
    return _recall_target(spark, sf, 0.6)


# Recall reaches 1.0 at the lowest threshold, so the F-beta fallback is only
# reachable with a target above 1; this query exercises that branch.
@register("q_threshold_fallback", _recall_target_sql(1.5))
def q_threshold_fallback(spark, sf):
    return _recall_target(spark, sf, 1.5)


COMPARE_SQL = SCORES + """
, cmp AS (SELECT ap.model, average_precision, roc_auc, brier, precision, recall, f1
          FROM ap JOIN auc USING (model) JOIN tm3 USING (model))"""


@register("q_compare_models", with_laps(COMPARE_SQL + """
SELECT model, round(average_precision, 6) AS average_precision, round(roc_auc, 6) AS roc_auc,
 round(brier, 6) AS brier, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM cmp"""))
def q_compare_models(spark, sf):
    c = M.compare_models(model_scores(spark, sf), THRESHOLD)
    return c.select("model", *[r6(x).alias(x) for x in
                               ("average_precision", "roc_auc", "brier", "precision", "recall", "f1")])


@register("q_select_best", with_laps(COMPARE_SQL + """
SELECT model, round(average_precision, 6) AS average_precision, round(recall, 6) AS recall,
       recall >= 0.6 AS reached_target FROM cmp
ORDER BY recall < 0.6, coalesce(average_precision, -1.0) DESC, model LIMIT 1"""))
def q_select_best(spark, sf):
    b = M.select_best(M.compare_models(model_scores(spark, sf), THRESHOLD), 0.6)
    return b.select("model", r6("average_precision").alias("average_precision"),
                    r6("recall").alias("recall"), "reached_target")


@register("q_unpivot_scores", with_laps(COMPARE_SQL + """
SELECT model, metric, round(value, 6) AS value FROM cmp
UNPIVOT (value FOR metric IN (average_precision, roc_auc, brier, precision, recall, f1))"""))
def q_unpivot_scores(spark, sf):
    """Wide comparison table -> long (model, metric, value); NULL metrics are dropped like SQL UNPIVOT."""
    c = M.compare_models(model_scores(spark, sf), THRESHOLD)
    long = c.unpivot("model", ["average_precision", "roc_auc", "brier", "precision", "recall", "f1"],
                     "metric", "value")
    return long.where(F.col("value").isNotNull()).select("model", "metric", r6("value").alias("value"))


@register("q_best_by_roc", with_laps(COMPARE_SQL + """
, best AS (SELECT model, roc_auc FROM cmp WHERE roc_auc IS NOT NULL ORDER BY roc_auc DESC, model LIMIT 1)
SELECT 'tyre' AS asked, model, round(roc_auc, 6) AS roc_auc FROM cmp WHERE model = 'tyre'
UNION ALL SELECT 'best_model_not_listed', model, round(roc_auc, 6) FROM best"""))
def q_best_by_roc(spark, sf):
    """The named model's row if it is listed; else the highest numeric ROC-AUC."""
    c = M.compare_models(model_scores(spark, sf), THRESHOLD)
    pick = lambda name: M.best_by_roc(c, name).select(F.lit(name).alias("asked"), "model", r6("roc_auc").alias("roc_auc"))
    return pick("tyre").unionByName(pick("best_model_not_listed"))
