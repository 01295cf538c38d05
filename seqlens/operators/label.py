"""Label audit: rebuild a next-row label and compare it with a supplied one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.operators.temporal import sequence_window
from seqlens.session import cut_lineage
from seqlens.spec import LAPS, SequenceSpec

# Fixed decision rule: keep the supplied label only when it agrees on at
# least 99 % of rows and the positive rates differ by at most 0.2 points.
KEEP_MATCH_RATE = 0.99
KEEP_GAP_PP = 0.2
FINAL_SHARE = 0.5


def next_value(df: DataFrame, col: str, spec: SequenceSpec = LAPS, name: str | None = None) -> DataFrame:
    """Value of ``col`` on the next row of the same sequence (NULL on the last)."""
    return df.withColumn(name or f"next_{col}", F.lead(col, 1).over(sequence_window(spec)))


def rebuild_label(df: DataFrame, spec: SequenceSpec = LAPS, name: str = "label_rebuilt") -> DataFrame:
    """1 when the next row of the sequence has a higher stint; last row -> 0."""
    nxt = F.lead(spec.stint, 1).over(sequence_window(spec))
    return (df.withColumn("_next", nxt)
              .withColumn(name, F.coalesce((F.col("_next") > F.col(spec.stint)).cast("int"), F.lit(0)))
              .withColumn("is_final", F.col("_next").isNull())
              .drop("_next"))


def same(a: str, b: str) -> Column:
    """pandas ``==``: a missing value on either side never matches."""
    return F.coalesce(F.col(a) == F.col(b), F.lit(False))


def label_agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows, matches, mismatches, match rate, both positive rates and the gap."""
    m = same(a, b).cast("int")
    return df.agg(
        F.count(F.lit(1)).cast("long").alias("total"),
        F.sum(m).cast("long").alias("matches"),
        F.sum(1 - m).cast("long").alias("mismatches"),
        F.round(F.avg(m), 6).alias("match_rate"),
        F.round(F.avg((F.col(a) == 1).cast("double")), 6).alias("rate_a"),
        F.round(F.avg((F.col(b) == 1).cast("double")), 6).alias("rate_b"),
        F.round(F.abs(F.avg((F.col(a) == 1).cast("double"))
                      - F.avg((F.col(b) == 1).cast("double"))) * 100, 6).alias("gap_pp"))


def label_crosstab(df: DataFrame, a: str, b: str, values=(0, 1)) -> DataFrame:
    """Crosstab rows = ``a``, one count and one share-of-total column per ``b`` value."""
    counts = (df.where(F.col(a).isNotNull() & F.col(b).isNotNull())
                .groupBy(a).agg(*[F.count(F.when(F.col(b) == v, 1)).alias(str(v)) for v in values],
                                F.count(F.lit(1)).alias("_all")))
    counts = cut_lineage(counts)  # the total comes from the counts, not from the rows again
    total = counts.agg(F.sum("_all")).scalar()
    cols = [F.col(a)]
    for v in values:
        cols.append(F.col(str(v)).cast("long").alias(f"n_{b}_{v}"))
        cols.append(F.round(F.col(str(v)) / total, 6).alias(f"share_{b}_{v}"))
    return counts.select(*cols)


def mismatches(df: DataFrame, a: str, b: str, keep=None) -> DataFrame:
    out = df.where(~same(a, b))
    return out.select(*keep) if keep else out


def mismatch_profile(df: DataFrame, a: str, b: str, spec: SequenceSpec = LAPS,
                     top: int = 10, rebuild=rebuild_label) -> DataFrame:
    """Mismatches by final-row flag, by direction, top groups, by category.

    Long form ``(facet, value, n)``: each mismatch names its four facets in
    one array, so the rows are read and windowed once.  ``rebuild``:
    :func:`rebuild_label_split` for hot sequences (also below).
    """
    mm = mismatches(rebuild(df, spec, "_rb"), a, b)
    pick = lambda facet, v: F.struct(F.lit(facet).alias("facet"), v.cast("string").alias("value"))
    facets = F.array(pick("final_row", F.col("is_final")),
                     pick("direction", F.concat_ws("->", F.col(a).cast("string"), F.col(b).cast("string"))),
                     pick("top_group", F.col(spec.group)), pick("category", F.col(spec.category)))
    c = mm.select(F.inline(facets)).groupBy("facet", "value").agg(F.count(F.lit(1)).cast("long").alias("n"))
    c = cut_lineage(c.where(F.col("value").isNotNull() | F.col("facet").isin("top_group", "final_row")))
    best = c.where("facet = 'top_group'").orderBy(F.desc("n"), F.asc("value")).limit(top)
    return c.where("facet <> 'top_group'").unionByName(best)


def label_decision(df: DataFrame, a: str, b: str, spec: SequenceSpec = LAPS, rebuild=rebuild_label) -> DataFrame:
    """One row: agreement numbers and the recommended label."""
    rb = rebuild(df, spec, "_rb")
    m = same(a, b).cast("int")
    s = rb.agg(
        F.avg(m).alias("match_rate"),
        (F.abs(F.avg((F.col(a) == 1).cast("double")) - F.avg((F.col(b) == 1).cast("double"))) * 100)
        .alias("gap_pp"),
        F.sum(1 - m).cast("long").alias("mismatches"),
        F.sum(((1 - m) * F.col("is_final").cast("int"))).cast("long").alias("final_row_mismatches"))
    share = F.when(F.col("mismatches") > 0, F.col("final_row_mismatches") / F.col("mismatches")).otherwise(0.0)
    keep = (F.col("match_rate") >= KEEP_MATCH_RATE) & (F.col("gap_pp") <= KEEP_GAP_PP)
    return s.select(
        F.round("match_rate", 6).alias("match_rate"), F.round("gap_pp", 6).alias("gap_pp"),
        "mismatches", "final_row_mismatches",
        (F.col("mismatches") - F.col("final_row_mismatches")).alias("other_mismatches"),
        F.round(share, 6).alias("final_row_share"),
        # both remaining branches of the rule recommend the rebuilt label
        F.when(keep, "USE_ORIGINAL").otherwise("USE_RECONSTRUCTED").alias("decision"))


def sequence_groups(df: DataFrame, spec: SequenceSpec = LAPS, rebuild=rebuild_label) -> DataFrame:
    """Number of sequences, final rows and the rebuilt label on final rows."""
    rb = rebuild(df, spec, "_rb")
    return rb.agg(
        F.count_distinct(*spec.keys).cast("long").alias("n_sequences"),
        F.sum(F.col("is_final").cast("int")).cast("long").alias("n_final_rows"),
        F.sum(F.when(F.col("is_final") & (F.col("_rb") == 1), 1).otherwise(0)).cast("long")
        .alias("final_positive"),
        F.sum(F.when(F.col("is_final") & (F.col("_rb") == 0), 1).otherwise(0)).cast("long")
        .alias("final_negative"))


def label_comparison(df: DataFrame, a: str, b: str) -> DataFrame:
    """Positive count, negative count, positive rate, missing for two labels."""
    def stats(c):
        pos = F.sum((F.col(c) == 1).cast("int"))
        neg = F.sum((F.col(c) == 0).cast("int"))
        miss = F.sum(F.col(c).isNull().cast("int"))
        return pos, neg, miss
    pa, na, ma = stats(a)
    pb, nb, mb = stats(b)
    s = df.agg(pa.alias("pa"), na.alias("na"), ma.alias("ma"), pb.alias("pb"), nb.alias("nb"), mb.alias("mb"))

    def rate(p, n):
        return F.when((F.col(p) + F.col(n)) > 0, F.round(F.col(p) / (F.col(p) + F.col(n)), 6))

    rows = F.array(
        F.struct(F.lit("positive_count").alias("metric"), F.col("pa").cast("double").alias(a),
                 F.col("pb").cast("double").alias(b)),
        F.struct(F.lit("negative_count").alias("metric"), F.col("na").cast("double").alias(a),
                 F.col("nb").cast("double").alias(b)),
        F.struct(F.lit("positive_rate").alias("metric"), rate("pa", "na").alias(a),
                 rate("pb", "nb").alias(b)),
        F.struct(F.lit("missing").alias("metric"), F.col("ma").cast("double").alias(a),
                 F.col("mb").cast("double").alias(b)))
    return s.select(F.inline(rows))


def rebuild_label_split(df: DataFrame, spec: SequenceSpec = LAPS, name: str = "label_rebuilt",
                        hot_rows: int | None = None) -> DataFrame:
    """:func:`rebuild_label` for tables with hot sequences: their parts hold a copy of the row that follows."""
    from seqlens.operators.halo import HOT_ROWS, with_neighbours
    rows, parts = with_neighbours(df, spec, after=1, hot_rows=hot_rows or HOT_ROWS)
    return rebuild_label(rows, parts, name).where("_own").drop("_own", "_part")


def next_value_split(df: DataFrame, col: str, spec: SequenceSpec = LAPS, name: str | None = None,
                     hot_rows: int | None = None) -> DataFrame:
    """:func:`next_value` for tables with hot sequences."""
    from seqlens.operators.halo import HOT_ROWS, with_neighbours
    rows, parts = with_neighbours(df, spec, after=1, hot_rows=hot_rows or HOT_ROWS)
    return next_value(rows, col, parts, name).where("_own").drop("_own", "_part")
