"""K-d tree sharding by distributed weighted medians (operator 1), DataFrame functions only.

A node that must become k shards is split along its widest metadata dimension
at the point that gives k // 2 of k parts of its bytes (the weighted median
when k is even), until every leaf is one shard.  The split point is found
exactly by radix descent: bytes are summed by (node, next 15 bits of the key)
with map-side combine, and the digit that crosses the target is followed.
Only one row for each node comes to the driver, at most ``MAX_SHARDS``.

A row's key in a dimension is its normalised value, then bits of its text's
hash, then a salt.  So ties are cut too: a source or a group of copies that
holds a third of all rows is spread over as many shards as its bytes need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.base import settle

MAX_SHARDS = 100_000     # bounds the split table that is broadcast and what the driver holds
DIGIT = 15               # bits of a round; 4 rounds cover the 60-bit key
SLOT_ROWS, SLOT_BUCKETS = 2_000, 10_000


def _number(df: DataFrame, c: str) -> Column:
    """A dimension as a double: numbers and times as they are, other values by a hash in [0, 1]."""
    kind = df.schema[c].dataType.typeName()
    col = F.col(f"`{c}`")
    if kind in ("byte", "short", "integer", "long", "float", "double", "decimal", "boolean"):
        col = col.cast("double")
        return F.nanvl(col, F.lit(None).cast("double"))
    if kind in ("timestamp", "timestamp_ntz", "date"):
        return F.unix_micros(col.cast("timestamp")).cast("double")
    return F.crc32(col.cast("string").cast("binary")) / F.lit(2.0**32)


def _key() -> Column:
    return F.shiftleft(F.floor(F.element_at("v", F.col("dim") + 1) * (2**30 - 1)).cast("long"), 30) + F.col("low")


def _table(spark, rows: list[tuple], ddl: str) -> DataFrame:
    return F.broadcast(spark.createDataFrame(rows, ddl))


def _cuts(points: DataFrame, nodes: dict[int, tuple[int, float]]) -> dict[int, int]:
    """For each node (dim, target bytes) the key below which its left part lies."""
    spark = points.sparkSession
    state = {n: (dim, 0, 0.0, goal) for n, (dim, goal) in nodes.items()}  # prefix, bytes before it, target
    for shift in (45, 30, 15, 0):
        s = _table(spark, [(n, *v) for n, v in state.items()], "node int, dim int, prefix long, seen double, goal double")
        x = points.join(s, "node").withColumn("key", _key())
        x = x.where(F.shiftright("key", shift + DIGIT) == F.col("prefix"))
        x = (x.withColumn("digit", F.shiftright("key", shift).bitwiseAND(F.lit(2**DIGIT - 1)))
             .groupBy("node", "digit", "seen", "goal").agg(F.sum("size").cast("double").alias("b")))
        run = F.sum("b").over(Window.partitionBy("node").orderBy("digit"))  # at most 2^15 rows a node
        hit = (x.withColumn("upto", F.col("seen") + run).where("upto >= goal").groupBy("node")
               .agg(F.min(F.struct("digit", "upto", "b")).alias("h")).collect())
        for r in hit:
            dim, prefix, _, goal = state[r["node"]]
            h = r["h"]
            state[r["node"]] = (dim, (prefix << DIGIT) + h["digit"], h["upto"] - h["b"], goal)
            if shift == 0:  # the crossing row goes where it fits better
                left_in = h["upto"] - goal <= goal - (h["upto"] - h["b"])
                nodes[r["node"]] = (dim, (prefix << DIGIT) + h["digit"] + (1 if left_in else 0))
    return {n: v[1] for n, v in nodes.items()}


def kd_shards(docs: DataFrame, dims: list[str], shards: int | None = None, target_bytes: int | None = None,
              id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard)``, one row per input row.

    ``size`` is the text's UTF-8 bytes plus 1 (null: 1; crc32 of a null text:
    0).  Give the number of ``shards``, or ``target_bytes`` for leaves of about
    that size.  Law ``bytes``: shard sizes differ by about one document.
    ``slot`` counts a shard's rows without gaps from 0.  Null metadata sorts
    before any value; repeated rows are rows of their own; an empty table gives
    an empty result; more shards than rows leave shards empty.
    """
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`").cast("binary")
    crc = F.coalesce(F.crc32(text), F.lit(0).cast("long"))
    raw = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.octet_length(text) + 1, F.lit(1)).cast("long").alias("size"),
                      crc.alias("crc"), F.array(*[_number(docs, c) for c in dims]).alias("raw"),
                      F.monotonically_increasing_id().alias("row"))
    low = F.shiftleft(F.pmod(F.xxhash64("crc"), F.lit(2**18)), 12) + F.pmod(F.xxhash64("row", "doc_id"), F.lit(2**12))
    raw = settle(raw.withColumn("low", low).drop("row"))
    n = len(dims)
    ends = raw.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"),
                   *[f(F.get("raw", F.lit(i))).alias(f"{k}{i}") for i in range(n) for k, f in (("lo", F.min), ("hi", F.max))]).first()
    if shards is None:
        shards = max(1, -(-(ends["bytes"] or 0) // target_bytes))
    if shards > MAX_SHARDS:
        raise ValueError(f"{shards} shards: at most {MAX_SHARDS}")

    def scaled(i: int) -> Column:
        lo, hi = ends[f"lo{i}"], ends[f"hi{i}"]
        if lo is None or hi <= lo:
            return F.lit(0.0)
        return F.coalesce((F.get("raw", F.lit(i)) - lo) / (hi - lo), F.lit(0.0))

    points = raw.select("doc_id", "size", "crc", "low", F.array(*[scaled(i) for i in range(n)]).alias("v"),
                        F.lit(0).alias("node"))
    parts = {0: shards}  # node = its first shard -> shards it must become
    while todo := {k: v for k, v in parts.items() if v > 1}:
        stats = points.where(F.col("node").isin(list(todo)) if len(todo) <= 64 else F.lit(True)).groupBy("node").agg(
            F.sum("size").alias("bytes"),
            *[(F.max(F.get("v", F.lit(i))) - F.min(F.get("v", F.lit(i)))).alias(f"w{i}") for i in range(n)]).collect()
        nodes = {}
        for r in stats:
            if (k := todo.get(r["node"])) is not None:
                widths = [r[f"w{i}"] for i in range(n)]
                nodes[r["node"]] = (widths.index(max(widths)), r["bytes"] * (k // 2) / k)
        dim = {node: d for node, (d, _) in nodes.items()}
        cuts = _cuts(points, nodes)
        rows = [(node, dim[node], cut, todo[node] // 2) for node, cut in cuts.items()]
        if rows:
            s = _table(spark, rows, "node int, dim int, cut long, step int")
            right = F.col("cut").isNotNull() & (_key() >= F.col("cut"))
            points = settle(points.join(s, "node", "left").withColumn(
                "node", F.col("node") + F.when(right, F.col("step")).otherwise(0)).drop("dim", "cut", "step"))
        parts = reduce(lambda a, b: a | b, [{k: v} if v <= 1 else {k: v // 2, k + v // 2: v - v // 2}
                                            for k, v in parts.items()])

    # slots: row numbers inside small buckets of a shard, plus the rows of the buckets before
    many = min(SLOT_BUCKETS, max(1, -(-ends["rows"] // (shards * SLOT_ROWS))))
    points = points.withColumn("bucket", F.pmod(F.xxhash64("low", "doc_id"), F.lit(many)))
    before = points.groupBy("node", "bucket").agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy("node").orderBy("bucket")
    before = before.withColumn("before", F.sum("k").over(w) - F.col("k")).drop("k")
    inside = F.row_number().over(Window.partitionBy("node", "bucket").orderBy("doc_id", "crc", "low")) - 1
    out = points.withColumn("inside", inside).join(before, ["node", "bucket"])
    return out.select("doc_id", "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"),
                      F.col("node").alias("shard"), (F.col("before") + F.col("inside")).cast("long").alias("slot"),
                      F.lit(None).cast("int").alias("grown_shard"))
