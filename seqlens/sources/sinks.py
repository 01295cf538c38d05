"""Sinks: datasets, split tables, metadata and nested summaries.

Writes are plain DataFrame writers (parquet by default, overwrite), so they
are atomic per job through the output committer and restart-safe.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_dataset(df: DataFrame, path: str, cols: list[str] | None = None, fmt: str = "parquet") -> None:
    """Validated dataset: original columns + rebuilt columns, in the given order."""
    out = df.select(*cols) if cols else df
    w = out.write.mode("overwrite")
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


def write_split(df: DataFrame, path: str) -> None:
    """Train/test rows partitioned by ``split`` (readers prune to one side)."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def write_rows_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def write_report_csv(df: DataFrame, path: str, order=None) -> None:
    """Small report tables (one row per model / group) as one CSV file."""
    out = df.orderBy(*order) if order else df
    out.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def summary_frame(comparison: DataFrame, per_group: DataFrame, best_model: str) -> DataFrame:
    """Nested summary row: best model, comparison list, per-group recall list.

    NaN is not valid JSON: metrics are written as NULL instead.
    """
    def clean(df):
        return df.select(*[F.when(~F.isnan(F.col(c)), F.col(c)).alias(c) if t == "double" else F.col(c)
                           for c, t in df.dtypes])
    cmp_ = clean(comparison).agg(F.collect_list(F.struct(*comparison.columns)).alias("comparison"))
    grp = clean(per_group).agg(F.collect_list(F.struct(*per_group.columns)).alias("per_group_recall"))
    # both sides are one-row aggregates of small report tables
    return cmp_.select(F.lit(best_model).alias("best_model"), "comparison",
                       grp.select("per_group_recall").scalar().alias("per_group_recall"))
