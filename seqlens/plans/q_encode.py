"""Encoder queries: fitted on the training groups only, applied to all rows."""

from pyspark.sql import functions as F

from seqlens.functions.expr import fill_unknown
from seqlens.functions.util import r6
from seqlens.operators import encode as E
from seqlens.operators import split as S
from seqlens.plans.oracle_base import with_laps
from seqlens.plans.q_split import GROUP_ORDER
from seqlens.plans.registry import register
from seqlens.sources.testdata import laps

KEYS = ["driver", "race", "yr", "lap"]
ROBUST_COLS = ["lap_time", "tyre_life", "position", "lap_time_delta", "race_progress"]
ORDINAL_COLS = ["compound", "driver", "race"]
TE_COLS = ["driver", "race"]


def split_laps(spark, sf):
    """Split frame, written once: every encoder reads it for fit and apply."""
    from seqlens.session import cut_lineage
    l = laps(spark, sf).withColumn("compound", fill_unknown("compound"))
    return cut_lineage(S.group_split(l, "race", 0.2, 42))


SPLIT_SQL = GROUP_ORDER.replace("sp AS (SELECT laps.*, asg.split FROM laps JOIN asg USING (race))",
                                "sp AS (SELECT * REPLACE (coalesce(compound, 'UNKNOWN') AS compound), asg.split "
                                "FROM laps JOIN asg USING (race)),\ntr AS (SELECT * FROM sp WHERE split = 'train')")


@register("q_robust_scale", with_laps(SPLIT_SQL + ", st AS (SELECT " + ", ".join(
    f"quantile_cont({c}, 0.5) AS m_{c}, CASE WHEN quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) = 0 THEN 1.0 "
    f"ELSE quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) END AS i_{c}" for c in ROBUST_COLS) + " FROM tr)\n"
    "SELECT driver, race, yr, lap, " + ", ".join(
        f"round(({c} - m_{c}) / i_{c}, 6) AS {c}" for c in ROBUST_COLS) + " FROM sp, st"))
def q_robust_scale(spark, sf):
    sp = split_laps(spark, sf)
    stats = E.fit_robust(sp.where(F.col("split") == "train"), ROBUST_COLS, written=True)
    out = E.apply_robust(sp.select(*KEYS, *[c for c in ROBUST_COLS if c not in KEYS]), stats, ROBUST_COLS)
    return out.select(*KEYS, *[r6(c).alias(c) for c in ROBUST_COLS])


ONE_HOT = ["HARD", "MEDIUM", "SOFT", "UNKNOWN"]


@register("q_one_hot", with_laps(SPLIT_SQL + "\nSELECT driver, race, yr, lap, " + ", ".join(
    f"CASE WHEN compound = '{c}' AND '{c}' IN (SELECT compound FROM tr) THEN 1.0 ELSE 0.0 END AS compound_{c}"
    for c in ONE_HOT) + " FROM sp"))
def q_one_hot(spark, sf):
    sp = split_laps(spark, sf)
    cats = E.fit_onehot(sp.where(F.col("split") == "train"), "compound")
    out = E.apply_onehot(sp, "compound", cats)
    return out.select(*KEYS, *[f"compound_{c}" for c in cats])


@register("q_ordinal_encode", with_laps(SPLIT_SQL + ", " + ", ".join(
    f"m_{c} AS (SELECT v, cast(row_number() OVER (ORDER BY v) - 1 AS INT) AS code FROM "
    f"(SELECT DISTINCT cast({c} AS VARCHAR) AS v FROM tr WHERE {c} IS NOT NULL))" for c in ORDINAL_COLS)
    + "\nSELECT driver, race, yr, lap, " + ", ".join(
        f"cast(coalesce(m_{c}.code, -1) AS INT) AS {c}_code" for c in ORDINAL_COLS) + " FROM sp "
    + " ".join(f"LEFT JOIN m_{c} ON cast(sp.{c} AS VARCHAR) = m_{c}.v" for c in ORDINAL_COLS)))
def q_ordinal_encode(spark, sf):
    sp = split_laps(spark, sf)
    codes = E.fit_ordinal(sp.where(F.col("split") == "train"), ORDINAL_COLS)
    out = E.apply_ordinal(sp.select(*KEYS, "compound"), codes, ORDINAL_COLS)
    return out.select(*KEYS, *[f"{c}_code" for c in ORDINAL_COLS])


def _te_map_sql(c):
    return (f"te_{c} AS (SELECT cast({c} AS VARCHAR) AS v, CASE WHEN (SELECT va FROM g) > 0 THEN "
            f"(count(*) * (SELECT va FROM g)) / (count(*) * (SELECT va FROM g) + var_pop(will_pit)) * avg(will_pit) "
            f"+ (1 - (count(*) * (SELECT va FROM g)) / (count(*) * (SELECT va FROM g) + var_pop(will_pit))) * (SELECT m FROM g) "
            f"ELSE (SELECT m FROM g) END AS enc FROM tr GROUP BY {c})")


@register("q_target_encode", with_laps(SPLIT_SQL + ", g AS (SELECT avg(will_pit) AS m, var_pop(will_pit) AS va FROM tr), "
    + ", ".join(_te_map_sql(c) for c in TE_COLS)
    + "\nSELECT driver, race, yr, lap, " + ", ".join(
        f"round(coalesce(te_{c}.enc, (SELECT m FROM g)), 6) AS {c}_te" for c in TE_COLS) + " FROM sp "
    + " ".join(f"LEFT JOIN te_{c} ON cast(sp.{c} AS VARCHAR) = te_{c}.v" for c in TE_COLS)))
def q_target_encode(spark, sf):
    sp = split_laps(spark, sf)
    tr = sp.where(F.col("split") == "train")
    enc = E.fit_target(tr, TE_COLS, "will_pit")
    out = E.apply_target(sp.select(*KEYS), enc, TE_COLS, E.target_prior(tr, "will_pit"))
    return out.select(*KEYS, *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_COLS])


def _oof_sql():
    fold = ("cast((('x' || substr(md5(driver || '|' || race || '|' || cast(yr AS VARCHAR) || '|' || "
            "cast(lap AS VARCHAR) || '|42'), 1, 8))::BIT::BIGINT) % 5 AS INT)")
    parts = [f", trf AS (SELECT *, {fold} AS fold FROM tr),",
             "tot AS (SELECT count(*) AS n, sum(will_pit) AS s FROM trf),",
             "tk AS (SELECT fold, (SELECT n FROM tot) - count(*) AS gn, (SELECT s FROM tot) - sum(will_pit) AS gs FROM trf GROUP BY fold)"]
    for c in TE_COLS:
        parts.append(f", c_{c} AS (SELECT {c} AS v, count(*) AS cn, sum(will_pit) AS cs FROM trf GROUP BY {c}),"
                     f" k_{c} AS (SELECT {c} AS v, fold, count(*) AS kn, sum(will_pit) AS ks FROM trf GROUP BY {c}, fold)")
    sel = []
    for c in TE_COLS:
        n = f"(c_{c}.cn - coalesce(k_{c}.kn, 0))"
        s = f"(c_{c}.cs - coalesce(k_{c}.ks, 0))"
        ma = "(tk.gs / tk.gn)"
        va = f"({ma} * (1 - {ma}))"
        mc = f"({s} / {n})"
        vc = f"({mc} * (1 - {mc}))"
        lam = f"(({n} * {va}) / ({n} * {va} + {vc}))"
        sel.append(f"round(CASE WHEN {n} > 0 AND {va} > 0 THEN {lam} * {mc} + (1 - {lam}) * {ma} ELSE {ma} END, 6) AS {c}_te")
    joins = " ".join(f"LEFT JOIN c_{c} ON trf.{c} = c_{c}.v LEFT JOIN k_{c} ON trf.{c} = k_{c}.v AND trf.fold = k_{c}.fold"
                     for c in TE_COLS)
    return ("\n".join(parts) + "\nSELECT trf.driver, trf.race, trf.yr, trf.lap, trf.fold, " + ", ".join(sel)
            + " FROM trf JOIN tk ON trf.fold = tk.fold " + joins)


@register("q_target_encode_oof", with_laps(SPLIT_SQL + _oof_sql()))
def q_target_encode_oof(spark, sf):
    sp = split_laps(spark, sf)
    tr = sp.where(F.col("split") == "train").withColumn("fold", S.hash_fold(KEYS, 5, 42))
    out = E.target_encode_oof(tr.select(*KEYS, "fold", "will_pit"), TE_COLS, "will_pit", "fold")
    return out.select(*KEYS, "fold", *[r6(f"{c}_te").alias(f"{c}_te") for c in TE_COLS])
