"""Causal lag / rolling features per sequence (one shuffle, one sort).

All features of :func:`add_temporal_features` are declared in a single
``select`` over one window specification, so Catalyst plans exactly one
Exchange (hash on the sequence keys), one Sort and one Window node.  Frames
are ROWS frames: lags step by row, not by step value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.spec import LAPS, SequenceSpec

FILL_VALUE = 0.0
HISTORY_CAP = 3
WIDTH = 3


def sequence_window(spec: SequenceSpec = LAPS):
    return Window.partitionBy(*spec.keys).orderBy(*spec.order)


def require_columns(df: DataFrame, cols, where: str = "operator") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{where} needs these columns, which the table lacks: {missing}")


def _past(spec: SequenceSpec, width: int):
    return sequence_window(spec).rowsBetween(-width, -1)


def lag_col(col: str, k: int, spec: SequenceSpec = LAPS) -> Column:
    return F.lag(F.col(col).cast("double"), k).over(sequence_window(spec))


def past_mean(col: str, spec: SequenceSpec = LAPS, width: int = WIDTH) -> Column:
    """Mean of the previous ``width`` rows; NULL only when none is non-null."""
    return F.avg(F.col(col).cast("double")).over(_past(spec, width))


def past_std(col: str, spec: SequenceSpec = LAPS, width: int = WIDTH) -> Column:
    """Sample std of the previous ``width`` rows; NULL below two values."""
    return F.stddev_samp(F.col(col).cast("double")).over(_past(spec, width))


def change_flag(col: str, spec: SequenceSpec = LAPS) -> Column:
    """1 when the previous row has a value and the current one differs.

    A NULL current value compares as the text 'nan', so it counts as a change
    against any present previous value.
    """
    prev = F.lag(F.col(col).cast("string"), 1).over(sequence_window(spec))
    cur = F.coalesce(F.col(col).cast("string"), F.lit("nan"))
    return F.when(prev.isNotNull() & (cur != prev), 1).otherwise(0).cast("int")


def history_count(spec: SequenceSpec = LAPS, cap: int = HISTORY_CAP) -> Column:
    return F.least(F.row_number().over(sequence_window(spec)) - 1, F.lit(cap)).cast("int")


def temporal_columns(spec: SequenceSpec = LAPS) -> dict[str, Column]:
    """The 17 feature expressions, un-filled, in output order."""
    v, d, deg = spec.value, spec.delta, spec.degradation
    pos, pc = spec.position, spec.position_change
    mean_v = past_mean(v, spec)
    return {
        f"{v}_lag1": lag_col(v, 1, spec),
        f"{v}_lag2": lag_col(v, 2, spec),
        f"{v}_lag3": lag_col(v, 3, spec),
        f"{d}_lag1": lag_col(d, 1, spec),
        f"{d}_lag2": lag_col(d, 2, spec),
        f"{d}_lag3": lag_col(d, 3, spec),
        f"{v}_rolling_mean_3": mean_v,
        f"{v}_rolling_std_3": past_std(v, spec),
        f"{d}_rolling_mean_3": past_mean(d, spec),
        f"{d}_rolling_std_3": past_std(d, spec),
        f"{deg}_rolling_mean_3": past_mean(deg, spec),
        f"{pos}_lag1": lag_col(pos, 1, spec),
        f"{pos}_rolling_mean_3": past_mean(pos, spec),
        f"{pc}_lag1": lag_col(pc, 1, spec),
        # computed before the fill: the first row gives 0, not the value itself
        f"{v}_diff_from_rolling_mean3": F.col(v).cast("double") - mean_v,
        f"{spec.category}_changed_last_lap": change_flag(spec.category, spec),
        "lap_history_count": history_count(spec),
    }


def temporal_feature_names(spec: SequenceSpec = LAPS) -> list[str]:
    return list(temporal_columns(spec))


def add_temporal_features(df: DataFrame, spec: SequenceSpec = LAPS,
                          fill: float = FILL_VALUE) -> DataFrame:
    """Append the 17 causal features; float features NULL -> ``fill``."""
    require_columns(df, [*spec.keys, spec.step, spec.category], "add_temporal_features")
    cols = temporal_columns(spec)
    out = []
    for name, c in cols.items():
        if name.endswith("_changed_last_lap") or name == "lap_history_count":
            out.append(c.alias(name))
        else:
            out.append(F.coalesce(c, F.lit(float(fill))).alias(name))
    return df.select("*", *out)


# -- skew-safe form -------------------------------------------------------------

def add_temporal_features_split(df: DataFrame, spec: SequenceSpec = LAPS, fill: float = FILL_VALUE,
                                hot_rows: int | None = None) -> DataFrame:
    """:func:`add_temporal_features` for tables with hot (very long) sequences.

    Sequences of more than ``hot_rows`` rows are cut to parts, each with copies
    of the ``WIDTH`` rows before it, which is as far as a feature looks back;
    the same expressions then run over (keys, part).
    """
    from seqlens.operators.halo import HOT_ROWS, with_neighbours
    require_columns(df, [*spec.keys, spec.step, spec.category], "add_temporal_features_split")
    rows, parts = with_neighbours(df, spec, before=WIDTH, hot_rows=hot_rows or HOT_ROWS)
    return add_temporal_features(rows, parts, fill).where("_own").drop("_own", "_part")
