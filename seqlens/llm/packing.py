"""Cost-balanced packing into sequences (operator 3).

Documents become token ids (plus an end id) and are cut to pieces that fit a
sequence.  A piece of n tokens is taken to cost ``linear * n + quadratic * n^2``
(attention stays inside a piece).  Pieces are assigned in descending cost,
each to the lowest-cost sequence that still has token room for it.  The open
sequences together hold exactly the tokens there are (the remainder goes to
power-of-two lengths, which need no padding), so a piece that fits nowhere
whole is cut over the sequences with most room and no sequence is padded.

Packing runs where the documents are read: a task packs its rows in groups of
about ``GROUP_TOKENS`` tokens.  Nothing is shuffled, memory is bounded by a
group, a hot source or long document changes nothing, and a task that runs
again on the same split gives the same pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import tidy
from seqlens.llm.tokens import shared, tokenizer_path

LENGTH = 4096
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
GROUP_TOKENS = 2_000_000
SLICE = 1024             # documents encoded at a time
END_ID = 2
SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "ids binary")


def capacities(tokens: int, length: int) -> list[int]:
    """Sequence lengths that sum to ``tokens``: full ones, then descending powers of two."""
    rest = tokens % length
    return [length] * (tokens // length) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(sizes: list[int], length: int = LENGTH, linear: float = LINEAR, quadratic: float = QUADRATIC
           ) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of ``sizes`` tokens.

    Parts of ``length`` tokens are sequences of their own.  Ties in cost go to
    the earlier document and the earlier sequence, so the result is repeatable.
    """
    out, rest, made = [], [], 0
    for d, n in enumerate(sizes):
        for at in range(0, n - n % length, length):
            out.append((d, at, length, made, 0))
            made += 1
        if n % length:
            rest.append((n % length, d))
    room = np.array(capacities(sum(n for n, _ in rest), length), np.int64)
    used, cost = np.zeros(len(room), np.int64), np.zeros(len(room))

    def put(i: int, d: int, start: int, n: int) -> None:
        out.append((d, start, n, made + i, int(used[i])))
        used[i] += n
        room[i] -= n
        cost[i] += linear * n + quadratic * n * n

    for n, d in sorted(rest, key=lambda x: (-x[0], x[1])):  # descending length is descending cost
        start = sizes[d] - n
        fit = np.where(room >= n, cost, np.inf)
        i = int(fit.argmin())
        if fit[i] < np.inf:
            put(i, d, start, n)
            continue
        while n:
            i = int(room.argmax())
            take = min(n, int(room[i]))
            put(i, d, start, take)
            start, n = start + take, n - take
    return out


def _packer(path: str, length: int, end_id: int, linear: float, quadratic: float, with_ids: bool):
    end = np.uint32(end_id).tobytes()

    def run(batches: Iterator[pd.DataFrame]):
        chunks = shared(path)
        base = TaskContext.get().partitionId() << 36  # sequences of a task: up to 2^36
        made = 0

        def pieces(docs, ids):
            nonlocal made
            rows = assign([len(x) // 4 for x in ids], length, linear, quadratic)
            cut = [ids[d][4 * s:4 * (s + n)] for d, s, n, _, _ in rows]
            frame = pd.DataFrame({
                "doc_id": pd.array([docs[r[0]] for r in rows], "Int64"), "start": [r[1] for r in rows],
                "length": [r[2] for r in rows], "ids_crc32": [zlib.crc32(x) for x in cut],
                "doc_tokens": [len(ids[r[0]]) // 4 for r in rows], "sequence_id": [base + made + r[3] for r in rows],
                "offset": [r[4] for r in rows], "ids": cut if with_ids else [None] * len(rows)})
            made += max(r[3] for r in rows) + 1
            return frame

        docs, ids, held = [], [], 0
        for pdf in batches:
            for at in range(0, len(pdf), SLICE):
                part = pdf.iloc[at:at + SLICE]
                for i, x in zip(part["id"], chunks.encode_many(part["text"])):
                    docs.append(i)
                    ids.append(x + end)
                    held += len(x) // 4 + 1
                    if held >= GROUP_TOKENS:
                        yield pieces(docs, ids)
                        docs, ids, held = [], [], 0
        if ids:
            yield pieces(docs, ids)
    return tidy(run)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
         tokenizer: str | None = None, end_id: int = END_ID, linear: float = LINEAR, quadratic: float = QUADRATIC,
         with_ids: bool = True) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids``.

    ``ids`` are the piece's token ids, unsigned 32-bit little-endian (null
    without ``with_ids``).  Every id of every document, its end id included,
    lies in one piece.  ``sequence_id`` is unique; offsets run without gaps.
    Null and empty texts are documents of just the end id; repeated rows and
    null ids are documents of their own; an empty table gives no piece.
    """
    path = tokenizer or tokenizer_path("word_bpe_49k.json")
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    out = d.mapInPandas(_packer(path, length, end_id, linear, quadratic, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")
