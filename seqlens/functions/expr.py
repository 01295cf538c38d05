"""Scalar column expressions (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Position bands, confidence bands, decision labels.
POSITION_BANDS = (("Front (1-5)", 5), ("Midfield (6-15)", 15))
POSITION_BAND_LAST = "Backmarker (16+)"
POSITION_BAND_ORDER = ("Front (1-5)", "Midfield (6-15)", "Backmarker (16+)")
CONFIDENCE_HIGH = 0.25
CONFIDENCE_MEDIUM = 0.12
EXPLAIN_HIGH = 0.75
EXPLAIN_LOW = 0.25
LABEL_POSITIVE = "Pit Next Lap"
LABEL_NEGATIVE = "Stay Out"
UNKNOWN = "UNKNOWN"


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def clip(x, lo: float, hi: float) -> Column:
    """Clamp to [lo, hi]; NULL stays NULL (greatest/least would skip it)."""
    c = _c(x)
    return F.when(c.isNotNull(), F.greatest(F.least(c, F.lit(hi)), F.lit(lo)))


def fill_unknown(x, value: str = UNKNOWN) -> Column:
    return F.coalesce(_c(x).cast("string"), F.lit(value))


def position_band(x) -> Column:
    c = _c(x)
    out = None
    for label, hi in POSITION_BANDS:
        out = F.when(c <= hi, label) if out is None else out.when(c <= hi, label)
    return out.when(c.isNotNull(), POSITION_BAND_LAST)


def bucket_right(x, edges: list[float], labels: list[str], include_lowest: bool = True) -> Column:
    """Right-closed interval label (a, b]; the lowest edge included if asked.

    Values outside every interval give NULL.  (``Bucketizer`` is left-closed,
    so it cannot express these buckets.)
    """
    c = _c(x)
    lo0 = edges[0]
    first = (c >= lo0) if include_lowest else (c > lo0)
    out = F.when(first & (c <= edges[1]), labels[0])
    for (a, b), lab in zip(zip(edges[1:-1], edges[2:]), labels[1:]):
        out = out.when((c > a) & (c <= b), lab)
    return out


def bucket_ordinal(x, edges: list[float], include_lowest: bool = True) -> Column:
    c = _c(x)
    first = (c >= edges[0]) if include_lowest else (c > edges[0])
    out = F.when(first & (c <= edges[1]), 0)
    for i, (a, b) in enumerate(zip(edges[1:-1], edges[2:]), start=1):
        out = out.when((c > a) & (c <= b), i)
    return out


def try_numeric(x) -> Column:
    """Text to double, bad values to NULL (``pd.to_numeric(errors='coerce')``)."""
    return _c(x).cast("string").try_cast("double")


def format_metric(x) -> Column:
    c = _c(x)
    return F.when(c.isNotNull() & ~F.isnan(c), F.format_string("%.3f", c)).otherwise(F.lit("n/a"))


def display_name(x) -> Column:
    """'random_forest' -> 'Random Forest'; missing -> 'Unknown'."""
    c = _c(x)
    return F.when(c.isNull(), F.lit("Unknown")).otherwise(F.initcap(F.replace(c, F.lit("_"), F.lit(" "))))


def half_even_int(x) -> Column:
    """Python ``int(round(x))``: round half to even, then integer."""
    return F.bround(_c(x).cast("double"), 0).cast("int")


def decision(p, t) -> Column:
    return (_c(p) >= _c(t)).cast("int")


def decision_label(p, t) -> Column:
    return F.when(_c(p) >= _c(t), LABEL_POSITIVE).otherwise(LABEL_NEGATIVE)


def confidence(p, t) -> Column:
    d = F.abs(_c(p) - _c(t))
    return F.when(d >= CONFIDENCE_HIGH, "High").when(d >= CONFIDENCE_MEDIUM, "Medium").otherwise("Low")


def explanation_code(p, pred) -> Column:
    """Reason code behind the explanation text (wording kept to the UI)."""
    pc, pr = _c(p), _c(pred)
    return (F.when((pr == 1) & (pc >= EXPLAIN_HIGH), "strong_pit_signal")
             .when(pr == 1, "pit_signal")
             .when(pc <= EXPLAIN_LOW, "continue_stint")
             .otherwise("monitor"))


def target_label(x) -> Column:
    c = _c(x)
    return F.when(c == 1, LABEL_POSITIVE).when(c == 0, LABEL_NEGATIVE)
