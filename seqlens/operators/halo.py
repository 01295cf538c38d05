"""Long sequences cut to parts that know their neighbours' edge rows.

A window over a sequence puts it into one task.  Here a sequence of more than
``hot_rows`` rows is cut to parts by ranges of its step, and each part gets
copies of the last rows before it and the first rows after it.  A window over
(keys, part) then sees for every own row what a window over the whole sequence
would show it, as far as it looks no further than the copies reach.  Besides
the rows themselves only the parts' edge rows are shuffled.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.functions.util import join_small
from seqlens.operators.ranking import RANGES, value_ranges
from seqlens.session import cut_lineage
from seqlens.spec import LAPS, SequenceSpec

HOT_ROWS = 1_000_000


def _edges(parts: DataFrame, spec: SequenceSpec, cols: list[str], n: int, last: bool) -> DataFrame:
    """(_part, _r): the ``n`` last rows before each part, or the ``n`` first after it."""
    order = [F.col(c).desc() if last else F.col(c).asc() for c in spec.order]
    at = F.row_number().over(Window.partitionBy(*spec.keys, "_part").orderBy(*order))
    rows = parts.withColumn("_at", at).where(F.col("_at") <= n)  # limited in each task before the shuffle
    held = rows.groupBy(*spec.keys, "_part").agg(F.sort_array(F.collect_list(F.struct("_at", F.struct(*cols).alias("_r")))).alias("_e"))
    # nearest part first, each with its rows from the nearest on; a part has a row at least, so n parts are enough
    side = Window.partitionBy(*spec.keys).orderBy(F.col("_part").asc() if last else F.col("_part").desc())
    none = F.array().cast(held.schema["_e"].dataType)
    near = F.concat(*[F.coalesce(F.lag("_e", k).over(side), none) for k in range(1, n + 1)])
    out = held.select("_part", F.slice(near, 1, n).alias("_e")).select("_part", F.explode("_e").alias("_x"))
    return out.select("_part", "_x._r")


def with_neighbours(df: DataFrame, spec: SequenceSpec = LAPS, before: int = 0, after: int = 0,
                    hot_rows: int = HOT_ROWS) -> tuple[DataFrame, SequenceSpec]:
    """``df`` with ``_part`` and ``_own`` (false for copies), and the spec whose keys include the part.

    Apply window expressions of the returned spec, then keep the rows with
    ``_own``.  Rows of a sequence with equal steps stay in one part; null steps
    come first, null keys are keys like others.
    """
    cols = df.columns
    df = cut_lineage(df)  # lengths, ranges, edges and rows are read from it
    n = df.groupBy(*spec.keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = n.select(*[F.col(k).alias(f"_h_{k}") for k in spec.keys],
                   F.least(F.lit(RANGES), F.ceil(F.col("_n") / hot_rows)).cast("long").alias("_parts"))
    on = F.lit(True)
    for k in spec.keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_h_{k}"))
    rows = value_ranges(df, spec.step, "_part", shared=False)
    rows = join_small(rows, hot, on, "left").withColumn(
        "_part", F.coalesce(F.floor(F.col("_part") * F.col("_parts") / RANGES), F.lit(0)).cast("int"))
    split = rows.where("_parts IS NOT NULL").select(*cols, "_part")
    out = rows.select(*cols, "_part", F.lit(True).alias("_own"))
    for count, last in ((before, True), (after, False)):
        if count:
            copies = _edges(split, spec, cols, count, last)
            out = out.unionByName(copies.select("_r.*", "_part", F.lit(False).alias("_own")))
    return out, replace(spec, part=("_part",))
