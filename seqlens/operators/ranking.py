"""Global running sums, average ranks and exact quantiles without a hot task.

``Window.orderBy`` with no partition moves every row into one task.  Instead
(SURVEY 4.3) the values are cut to ``RANGES`` ranges, and a row's range is a
function of its value alone: the bounds are approximate quantiles, taken once
as a scalar subquery, and found again by comparisons.  Sums inside a range,
the exclusive prefix of the ranges' totals (a table of at most ``RANGES`` rows
a group) and the running sum inside the range give the global running sum.
Nothing has to be frozen, collected or checkpointed: a task that runs again
finds the same ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqlens.functions.util import join_small, stats_row
from seqlens.session import cut_lineage

RANGES = 4096           # ranges of a table, a power of two; each holds about as many rows
_ACCURACY = 2 * RANGES  # a range is off by half its size at most
_SKETCH = 4096          # accuracy of the sketch that brackets a quantile
_FEW = 16 * _SKETCH     # up to this many values all are put in order


def position(c: Column, kind: T.DataType) -> Column:
    """A double that never falls where ``c`` rises in Spark's order (equal values give equal ones)."""
    if isinstance(kind, T.StructType):
        return position(c[kind.fields[0].name], kind.fields[0].dataType)
    if isinstance(kind, T.StringType):  # its first six bytes
        x = F.conv(F.rpad(F.hex(F.substring(F.encode(c, "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    elif isinstance(kind, T.DateType):
        x = F.unix_date(c).cast("double")
    elif isinstance(kind, T.TimestampType):
        x = F.unix_micros(c).cast("double")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        x = c.cast("double")
        x = F.when(F.isnan(x), F.lit(float("inf"))).otherwise(x)
    else:
        raise TypeError(f"no ranges for columns of type {kind.simpleString()}")
    return F.coalesce(x, F.lit(float("-inf")))


def value_ranges(df: DataFrame, order: str, name: str = "_range", shared: bool = True) -> DataFrame:
    """``df`` with the range (0 to ``RANGES`` - 1, rising with ``order``) of each row.

    Equal values lie in one range.  If ``shared``, the subquery of the bounds
    reads all columns, so that it shares the shuffle of an aggregated ``df``
    with what follows; else it reads the order alone.
    """
    pos = position(F.col(order), df.schema[order].dataType)
    shares = F.expr("array(" + ", ".join(f"{i / RANGES}D" for i in range(1, RANGES)) + ")")
    read = df.columns if shared else []
    bounds = df.select(pos.alias("_p"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(read)]).agg(
        F.percentile_approx("_p", shares, _ACCURACY).alias("fine"), *[F.max(f"_c{i}").alias(f"_c{i}") for i in range(len(read))])
    # a binary search in plain expressions, so that the bounds are not copied into every row
    out = df.withColumns({"_p": pos, "_b": stats_row(bounds)["fine"], "_k": F.lit(0)})
    step = RANGES
    while step > 1:
        step //= 2
        out = out.withColumn("_k", F.col("_k") + F.when(F.col("_b")[F.col("_k") + (step - 1)] <= F.col("_p"), step).otherwise(0))
    return out.withColumn(name, F.col("_k")).drop("_p", "_k", "_b")


def _before(ranged: DataFrame, values: list[str], by: list[str], descending: bool = False) -> DataFrame:
    """(by..., _range, _t_<v>, _o_<v>, _a_<v>): what lies in a range, before it and in all; at most ``RANGES`` rows a group."""
    totals = ranged.groupBy(*by, "_range").agg(*[F.sum(v).alias(f"_t_{v}") for v in values])
    group = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    before = group.orderBy(F.col("_range").desc() if descending else F.col("_range").asc()).rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("*", *[F.coalesce(F.sum(f"_t_{v}").over(before), F.lit(0)).alias(f"_o_{v}") for v in values],
                         *[F.sum(f"_t_{v}").over(group).alias(f"_a_{v}") for v in values])


def _matched(left: DataFrame, right: DataFrame, by: list[str], on: list[str]) -> DataFrame:
    """Inner join on ``by`` (null groups too) and ``on`` (never null), ``right``'s copies dropped."""
    r = right.withColumnsRenamed({c: f"_n_{c}" for c in [*by, *on]})
    cond = [F.col(c).eqNullSafe(F.col(f"_n_{c}")) for c in by] + [F.col(c) == F.col(f"_n_{c}") for c in on]
    return left.join(r, cond).drop(*[f"_n_{c}" for c in [*by, *on]])


def cumulative(df: DataFrame, order: str, values: list[str], by: list[str] | None = None,
               descending: bool = False, totals: bool = False) -> DataFrame:
    """Inclusive running sums ``cum_<v>`` of ``values`` ordered by ``order``; with ``totals`` the groups' sums ``all_<v>`` too.

    ``df`` must be unique on ``by + [order]`` (aggregate first) and the same
    when it is read again.  Within each ``by`` group rows are ordered by
    ``order`` (descending if asked), as Spark orders nulls and NaN.
    """
    by = list(by or [])
    ranged = value_ranges(df, order).withColumn("_row", F.lit(1))
    # a range's first row brings what lies before it, so nothing is joined
    first = _before(ranged, values, by, descending).select(
        *by, "_range", F.lit(0).alias("_row"), *[F.col(f"_o_{v}").alias(v) for v in values], *[f"_a_{v}" for v in values])
    o = F.col(order).desc() if descending else F.col(order).asc()
    upto = Window.partitionBy(*by, "_range").orderBy("_row", o).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = ranged.unionByName(first, allowMissingColumns=True)
    out = both.select("*", *[F.sum(v).over(upto).alias(f"cum_{v}") for v in values],
                      *[F.first(f"_a_{v}").over(upto).alias(f"all_{v}") for v in values if totals])
    return out.where("_row = 1").drop("_range", "_row", *[f"_a_{v}" for v in values])


def value_counts_long(df: DataFrame, cols: list[str], by: list[str] | None = None) -> DataFrame:
    """(by..., column, value, n) over the non-null values of numeric ``cols``.

    Map-side partial aggregation shrinks every partition to its distinct
    values before the shuffle.
    """
    by = list(by or [])
    stacked = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("_kv")).select(*by, "_kv.column", "_kv.value").where(F.col("value").isNotNull())
    return stacked.groupBy(*by, "column", "value").agg(F.count(F.lit(1)).alias("n"))


def average_ranks(df: DataFrame, cols: list[str]) -> DataFrame:
    """(column, value, rank): 1-based rank with ties given their average."""
    vc = value_counts_long(df, cols)
    cum = cumulative(vc, "value", ["n"], by=["column"])
    return cum.select("column", "value",
                      (F.col("cum_n") - F.col("n") + (F.col("n") + 1) / 2.0).alias("rank"))


def quantiles(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
              written: bool = False) -> DataFrame:
    """Exact quantiles with linear interpolation (pandas / numpy default).

    Long output ``(by..., column, q, value)``.  A sketch brackets each
    quantile between two values; one pass then counts the rows between the
    brackets and keeps the values inside them, so that neither the rows nor
    their distinct values are shuffled.  The counts are exact: should a
    quantile lie outside its bracket, all values are counted instead.  ``df``
    is read twice; its columns are written once before that unless it is
    ``written`` already.
    """
    by, qs = list(by or []), list(dict.fromkeys(float(q) for q in qs))
    rows = df.select(*by, *[F.col(c).cast("double").alias(f"_x{i}") for i, c in enumerate(cols)])
    rows = rows if written else cut_lineage(rows)
    place = lambda x: F.when(F.isnan(x), F.lit(float("inf"))).otherwise(F.col(x))
    near = 4 / _SKETCH
    shares = [s for q in qs for s in (max(q - near, 0.0), min(q + near, 1.0))]
    sketch = rows.groupBy(*by).agg(*[e for i in range(len(cols)) for e in (
        F.percentile_approx(place(f"_x{i}"), shares, _SKETCH).alias(f"_s{i}"), F.count(f"_x{i}").alias(f"_c{i}"))])
    cuts = F.array(*[F.when(F.col(f"_c{i}") <= _FEW, F.lit(float("-inf") if j % 2 == 0 else float("inf")))
                      .otherwise(F.col(f"_s{i}")[j]) for i in range(len(cols)) for j in range(len(shares))])
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"_n_{c}"))
    # stacked before they are compared: one short expression for all columns
    cells = join_small(rows, sketch.select(*[F.col(c).alias(f"_n_{c}") for c in by], cuts.alias("_k")), on).select(
        *by, "_k", F.inline(F.array(*[F.struct(F.lit(i).alias("_i"), F.col(f"_x{i}").alias("_x")) for i in range(len(cols))])))
    cells = cells.where(F.col("_x").isNotNull()).withColumn("_p", place("_x"))
    ks = [F.col("_k")[F.col("_i") * len(shares) + j] for j in range(len(shares))]
    inside = reduce(lambda x, y: x | y, [(F.col("_p") >= lo) & (F.col("_p") <= hi) for lo, hi in zip(ks[::2], ks[1::2])])
    cells = cells.select(*by, "_i", "_x", sum([(F.col("_p") >= k).cast("int") for k in ks], F.lit(0)).alias("_s"), inside.alias("_in"))
    cells = cells.select(*by, "_i", "_s", (~F.col("_in")).cast("int").alias("_o"), F.when(F.col("_in"), F.col("_x")).alias("value"))
    counts = cells.groupBy(*by, "_i", "_s", "_o", "value").agg(F.count(F.lit(1)).alias("n"))
    # between two cuts the values of a bracket come first: a lone one equals the lower cut
    group = Window.partitionBy(*by, "_i")
    upto = group.orderBy("_s", "_o", "value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.select(*by, "_i", "_o", "value", F.sum("n").over(upto).alias("_end"), F.sum("n").over(group).alias("_size"), "n")
    placed = placed.withColumn("_start", F.col("_end") - F.col("n"))
    aggs = []
    for j, q in enumerate(qs):
        h = (F.col("_size") - 1) * F.lit(q)
        lo = F.floor(h).cast("long")
        hi = F.least(lo + 1, F.col("_size") - 1)
        for name, at in (("lo", lo), ("hi", hi)):
            hit = (at >= F.col("_start")) & (at < F.col("_end"))
            aggs += [F.max(F.when(hit, F.col("value"))).alias(f"_v{name}{j}"), F.max(F.when(hit, F.col("_o"))).alias(f"_m{name}{j}")]
        aggs.append(F.max(h - F.floor(h)).alias(f"_f{j}"))
    found = cut_lineage(placed.groupBy(*by, "_i").agg(*aggs))
    missed = reduce(lambda x, y: x | y, [F.col(f"_m{name}{j}") == 1 for name in ("lo", "hi") for j in range(len(qs))])
    if found.where(missed).limit(1).count():
        return quantiles_of_counts(value_counts_long(df, cols, by), qs, by)
    each = F.array(*[F.struct(F.lit(q).alias("q"), (F.col(f"_vlo{j}") + F.col(f"_f{j}") * (F.col(f"_vhi{j}") - F.col(f"_vlo{j}")))
                              .alias("value")) for j, q in enumerate(qs)])
    return found.select(*by, F.array(*[F.lit(c) for c in cols])[F.col("_i")].alias("column"), F.inline(each))


def quantiles_of_counts(vc: DataFrame, qs: list[float], by: list[str] | None = None) -> DataFrame:
    """:func:`quantiles` of values that are already counted: ``(by..., column, value, n)``.

    The value at 0-based index ``i`` is found from the counts of distinct
    values: the totals of the ranges tell in which range it lies, and only
    such ranges are ordered.
    """
    by = list(by or [])
    keys = [*by, "column"]
    ranged = value_ranges(vc, "value")
    part = _before(ranged, ["n"], keys).withColumn("_end", F.col("_o_n") + F.col("_t_n"))
    size = part.groupBy(*keys).agg(F.first("_a_n").alias("_size"))
    # targets: one row per (group, column, q); bounded by groups x columns x len(qs)
    h = (F.col("_size") - 1) * F.col("q")
    targets = size.select(*keys, "_size", F.explode(F.array(*[F.lit(float(q)) for q in qs])).alias("q")).select(
        *keys, "q", F.floor(h).cast("long").alias("_lo"), F.least(F.floor(h).cast("long") + 1, F.col("_size") - 1).alias("_hi"),
        (h - F.floor(h)).alias("_frac"))
    asked = _matched(part, targets, keys, [])
    inside = lambda i: (F.col(i) >= F.col("_o_n")) & (F.col(i) < F.col("_end"))
    asked = asked.where(inside("_lo") | inside("_hi"))
    # only the ranges that hold a target are put in order: a few rows of ``RANGES``
    few = asked.groupBy(*keys, "_range").agg(F.first("_o_n").alias("_o_n"),
                                             F.collect_list(F.struct("q", "_lo", "_hi", "_frac")).alias("_asked"))
    rows = _matched(ranged, few, keys, ["_range"])
    local = Window.partitionBy(*keys, "_range").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_end", F.sum("n").over(local) + F.col("_o_n")).withColumn("_start", F.col("_end") - F.col("n"))
    rows = rows.select(*keys, "value", "_start", "_end", F.inline("_asked"))
    hit = lambda i: (F.col(i) >= F.col("_start")) & (F.col(i) < F.col("_end"))
    g = rows.where(hit("_lo") | hit("_hi")).groupBy(*keys, "q").agg(
        F.max(F.when(hit("_lo"), F.col("value"))).alias("_vlo"), F.max(F.when(hit("_hi"), F.col("value"))).alias("_vhi"),
        F.first("_frac").alias("_frac"))
    return g.select(*keys, "q", (F.col("_vlo") + F.col("_frac") * (F.col("_vhi") - F.col("_vlo"))).alias("value"))


def quantile_wide(df: DataFrame, cols: list[str], qs: list[float], by: list[str] | None = None,
                  names: list[str] | None = None, written: bool = False) -> DataFrame:
    """One row per (by..., column) with a column per quantile (``written``: see :func:`quantiles`)."""
    by = list(by or [])
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    long = quantiles(df, cols, qs, by, written)
    return long.groupBy(*by, "column").agg(*[
        F.max(F.when(F.col("q") == F.lit(float(q)), F.col("value"))).alias(n) for q, n in zip(qs, names)])


def approx_quantile_wide(df: DataFrame, cols: list[str], qs: list[float], by=None,
                         names=None, accuracy: int = 10000) -> DataFrame:
    """Bounded-memory alternative for very large tables (relative error 1/accuracy)."""
    by = list(by or [])
    names = names or [f"q{int(round(q * 100)):02d}" for q in qs]
    stacked = df.select(*by, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols]))
        .alias("_kv")).select(*by, "_kv.column", "_kv.value")
    a = stacked.groupBy(*by, "column").agg(
        F.percentile_approx("value", [float(q) for q in qs], accuracy).alias("_qs"))
    return a.select(*by, "column", *[F.col("_qs")[i].alias(n) for i, n in enumerate(names)])


