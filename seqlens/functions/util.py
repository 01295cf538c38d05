"""Small column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stats_row(agg: DataFrame) -> Column:
    """A one-row aggregate as a scalar-subquery struct column.

    Catalyst runs the aggregate once and inlines its value into the outer
    plan (no join, nothing collected by the caller).  Fields are read with
    ``stats_row(s)["name"]``.
    """
    return agg.select(F.struct(*agg.columns).alias("_s")).scalar()


def r6(c) -> Column:
    """Round a double to 6 places (summation order differs across engines)."""
    return F.round(c if isinstance(c, Column) else F.col(c), 6)


def nan_to_null(df: DataFrame, cols=None) -> DataFrame:
    """NaN poisons Spark averages; turn every double NaN into NULL at ingest."""
    dbl = {f.name for f in df.schema.fields if f.dataType.typeName() in ("double", "float")}
    cols = [c for c in (cols or df.columns) if c in dbl]
    return df.select(*[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) if c in cols else F.col(c)
                       for c in df.columns])


#: rows up to which a map table is broadcast (a few MB)
BROADCAST_ROWS = 100_000


def join_small(df: DataFrame, small: DataFrame, on, how: str = "inner", limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join a map table that is expected to be small (one row per fold, group, class, category ...).

    Such keys are few and hot, so a shuffle on them would put much of ``df``
    into a few tasks.  The map is written out and counted: up to ``limit`` rows
    it is broadcast; a larger one has many keys, and a plain join (whose skewed
    partitions AQE splits) is right.
    """
    from seqlens.session import cut_lineage
    small = cut_lineage(small)
    if small.limit(limit + 1).count() <= limit:
        small = F.broadcast(small)
    return df.join(small, on, how)
