"""Token ids in ORC files (operator 7).

Documents are range-partitioned by id and written in ascending order, one
file for each range.  ORC stores the ids with integer run-length encoding,
keeps a row index for every ``stride`` rows, stripes that are read in
parallel, and Bloom filters on the document id, so a lookup by id skips files,
stripes and row groups from metadata alone.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqlens.llm.base import tidy
from seqlens.llm.tokens import shared, tokenizer_path
from seqlens.session import ensure_checkpoint_dir

END_ID = 2
SLICE = 1024 # documents encoded at a time


def _encoder(path: str, end_id: int):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pa.RecordBatch]):
        chunks = shared(path)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                ids = [x + end for x in chunks.encode_many(t.as_py() for t in part.column("text"))]
                sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
                values = pa.array(np.frombuffer(b"".join(ids), np.int32))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tie"), pa.array(sizes.astype(np.int32)),
                                                  pa.ListArray.from_arrays(offsets, values)],
                                                 names=["doc_id", "tie", "n_tokens", "ids"])
    return tidy(run)


def write_ids(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text",
              tokenizer: str | None = None, end_id: int = END_ID, stride: int = 1000,
              stripe_bytes: int = 64 << 20) -> None:
    """Write ``(doc_id, tie, n_tokens, ids)`` to ORC files under ``path``, ascending in doc_id over all files.

    ``tie`` is a hash of the text: rows that share an id (or have none) are
    dealt over ranges by it, and a row repeated whole stays beside its copy.
    Null ids come first; a null text has just the end id.
    """
    model = tokenizer or tokenizer_path("byte_bpe_50k.json")
    text = F.col(f"`{text_col}`").cast("binary")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tie"), text.alias("text"))
    d = d.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")
    (d.mapInArrow(_encoder(model, end_id), "doc_id long, tie long, n_tokens int, ids array<int>")
     .write.mode("errorifexists").option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
     .option("orc.create.index", "true").option("orc.row.index.stride", str(stride))
     .option("orc.stripe.size", str(stripe_bytes)).option("compression", "zstd").orc(path))


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, tie, n_tokens, ids)``; a filter on doc_id is pushed to the files' statistics and Bloom filters."""
    return spark.read.schema("doc_id long, tie long, n_tokens int, ids array<int>").orc(path)


def _checksums(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        ids = batch.column("ids")
        o = ids.offsets.to_numpy()
        values = ids.values.to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
        sums = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(o[:-1], o[1:])]
        yield pa.RecordBatch.from_arrays(
            [batch.column("file"), batch.column("doc_id"), batch.column("tie"),
             pa.array((o[1:] - o[:-1]).astype(np.int64)), pa.array(sums, pa.int64())],
            names=["file", "doc_id", "tie", "n_tokens", "ids_crc32"])


def digest(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` from the files; ``start`` = ids of all documents before."""
    raw = read_ids(spark, path).select(F.col("_metadata.file_name").alias("file"), "doc_id", "tie", "ids")
    rows = raw.mapInArrow(_checksums, "file string, doc_id long, tie long, n_tokens long, ids_crc32 long")
    # a file's ids come after those of all files before; names carry the range number
    files = read_ids(spark, path).groupBy(F.col("_metadata.file_name").alias("file")).agg(
        F.sum(F.col("n_tokens").cast("long")).alias("k"))
    w = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    files = files.select("file", F.coalesce(F.sum("k").over(w), F.lit(0)).alias("before"))
    inside = Window.partitionBy("file").orderBy(F.col("doc_id").asc_nulls_first(), "tie").rowsBetween(
        Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(files, "file").select("doc_id", (F.col("before") + F.col("inside")).alias("start"), "n_tokens",
                                           "ids_crc32")


def ids_through_files(docs: DataFrame, path: str | None = None, **kw) -> DataFrame:
    """Write ``docs`` to ORC (a new folder beside the checkpoints unless named) and read the digest back.

    An empty table writes a valid, empty data set and gives an empty result.
    """
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/ids-{uuid.uuid4().hex}"
    write_ids(docs, path, **kw)
    return digest(spark, path)
