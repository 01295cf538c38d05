"""SentencePiece encoding and decoding with n-best segmentation (operator 4).

A text becomes ``▁`` + text with spaces as ``▁``.  Its lattice has an edge for
every vocabulary piece that matches somewhere; a character that is no piece
has one edge of its UTF-8 byte pieces (score: the lowest piece score minus
10).  Control pieces and longer never-merged pieces (score -1e9, runs of ``▁``)
are no edges; a never-merged single character has the lowest score.  So no
edge crosses the start of a ``▁`` or a line feed (nor the place between a letter
and a mark, if no piece of the vocabulary does), and the lattice of a text is a
chain of small lattices, one for each such chunk.

In a chunk, forward Viterbi gives the best score of every prefix; a search
backward from the end takes those as exact heuristics (A-star): states leave
the heap in order of the best whole path through them, so segmentations come
out best first and no state is expanded that none of them needs.  The n best
of a text are merged from its chunks: only the n - 1 chunks with the cheapest
second choice can differ from their best, which keeps the merge exact.
"""

from __future__ import annotations

import functools
import heapq
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import tidy
from seqlens.llm.shingles import span_hashes
from seqlens.llm.tokens import _ALNUM, _is_utf8, text_of, tokenizer_path

UNKNOWN_PENALTY = 10.0
NEVER_MERGED = -1e8


class Lattice:
    """Pieces of a model, and the n best paths of a chunk."""

    def __init__(self, path: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes = [0] * 256
        self.surface = [b""] * sp.get_piece_size()
        for i in range(sp.get_piece_size()):
            p, s = sp.id_to_piece(i), sp.get_score(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:5], 16)] = i
                self.surface[i] = bytes([int(p[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                self.surface[i] = p.replace("▁", " ").encode()
                if s > NEVER_MERGED or len(p) == 1:
                    self.pieces[p] = (i, s)
        #: punctuation that no piece holds right after an ASCII letter or digit: the lattice is cut before it there
        joined = {b for p in self.pieces for a, b in zip(p, p[1:]) if a.isascii() and a.isalnum()}
        self.marks = np.zeros(256, bool)
        self.marks[[ord(c) for c in ".,;:!?" if c not in joined]] = True
        self.prefixes = {p[:k] for p in self.pieces for k in range(1, len(p) + 1)}
        low = min(s for _, s in self.pieces.values() if s > NEVER_MERGED)
        self.pieces = {p: (i, max(s, low)) for p, (i, s) in self.pieces.items()}
        self.unknown = low - UNKNOWN_PENALTY

    def edges(self, chunk: str) -> list[list[tuple[int, float, tuple[int, ...]]]]:
        """For each end position its edges (start, score, ids)."""
        n, pieces, prefixes = len(chunk), self.pieces, self.prefixes
        into: list[list[tuple[int, float, tuple[int, ...]]]] = [[] for _ in range(n + 1)]
        for i in range(n):
            if chunk[i] not in pieces:
                ids = tuple(self.bytes[b] for b in chunk[i].encode("utf-8", "surrogatepass"))
                into[i + 1].append((i, self.unknown, ids))
            j = i + 1
            while j <= n and (sub := chunk[i:j]) in prefixes:
                if (hit := pieces.get(sub)) is not None:
                    into[j].append((i, hit[1], (hit[0],)))
                j += 1
        return into

    def nbest(self, chunk: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """At most ``n`` (score, ids), best first."""
        into = self.edges(chunk)
        best = [0.0]
        for edges in into[1:]:
            best.append(max([best[i] + s for i, s, _ in edges], default=-np.inf))
        out, count = [], 0
        heap = [(-best[-1], len(chunk), 0, 0.0, None)]  # ties: nearer to the start first
        while heap and len(out) < n:
            _, j, _, g, tail = heapq.heappop(heap)
            if j == 0:
                ids: list[int] = []
                while tail is not None:
                    ids += tail[0]
                    tail = tail[1]
                out.append((g, tuple(ids)))
                continue
            for i, s, ids_ in into[j]:
                count += 1
                heapq.heappush(heap, (-(best[i] + s + g), i, count, s + g, (ids_, tail)))
        return out

    def decode(self, ids: np.ndarray) -> bytes:
        raw = b"".join(map(self.surface.__getitem__, ids.tolist()))
        return raw[1:] if raw[:1] == b" " else raw


class ChunkPaths:
    """The n best paths of texts, with a bounded memory of chunks.

    The chunks of a batch are found and hashed by array operations; of each
    different one the best ids, its score and the loss of the second choice are
    remembered.  Further choices are searched again for the few chunks that
    need them.
    """

    def __init__(self, lattice: Lattice, n: int, limit: int = 1_500_000):
        self.lattice, self.n, self.limit = lattice, n, limit
        self._reset()

    def _reset(self) -> None:
        self.names = np.zeros(0, np.uint64)      # hashes of the remembered chunks, ascending
        self.spans = np.zeros((0, 2), np.int64)  # of each, the first id and the number of ids in ``pool``
        self.score, self.second = np.zeros(0), np.zeros(0)
        self.back = np.zeros(0, bool)            # whether its best ids decode to it
        self.pool = np.zeros(1 << 18, np.uint32)
        self.used = 0

    def _store(self, at: np.ndarray, names: np.ndarray, chunks: list[str]) -> None:
        best, score, second, back = [], [], [], []
        surface = self.lattice.surface
        for c in chunks:
            got = self.lattice.nbest(c, min(self.n, 2))
            best.append(got[0][1])
            score.append(got[0][0])
            second.append(got[0][0] - got[1][0] if len(got) > 1 else np.inf)
            back.append(b"".join([surface[i] for i in got[0][1]]) == c.replace("▁", " ").encode())
        sizes = np.fromiter(map(len, best), np.int64, len(best))
        flat = np.fromiter((i for ids in best for i in ids), np.uint32, int(sizes.sum()))
        while self.used + len(flat) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        self.pool[self.used:self.used + len(flat)] = flat
        spans = np.stack([self.used + np.cumsum(sizes) - sizes, sizes], 1)
        self.used += len(flat)
        self.names = np.insert(self.names, at, names)
        self.spans = np.insert(self.spans, at, spans, axis=0)
        self.score, self.second = np.insert(self.score, at, score), np.insert(self.second, at, second)
        self.back = np.insert(self.back, at, back)

    def nbest(self, text: str) -> list[tuple[float, bytes]]:
        return self.batch([text.encode()])[0][1]

    def batch(self, texts: list[bytes]) -> list[tuple[bool, list[tuple[float, bytes]]]]:
        """For each UTF-8 text whether its best ids decode to it, and its n best (score, ids as unsigned 32-bit little-endian)."""
        if len(self.names) > self.limit:
            self._reset()
        spaced = [b" " + t.replace("▁".encode(), b" ") if t else b"" for t in texts]
        sizes = np.fromiter(map(len, spaced), np.int64, len(spaced))
        raw = b"".join(spaced)
        buf = np.frombuffer(raw, np.uint8)
        stop = np.cumsum(sizes)
        cut = (buf == 32) | (buf == 10)  # a chunk starts at a space, at a line feed, after one, and at some marks
        cut[1:] |= (buf[:-1] == 10) | self.lattice.marks[buf[1:]] & _ALNUM[buf[:-1]]
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(buf))
        h = span_hashes(buf, start, end)
        names, where, inverse = np.unique(h, return_index=True, return_inverse=True)
        at = np.searchsorted(self.names, names)
        known = np.zeros(len(names), bool)
        inside = at < len(self.names)
        known[inside] = self.names[at[inside]] == names[inside]
        if not known.all():
            new = np.flatnonzero(~known)
            a, b = start[where[new]].tolist(), end[where[new]].tolist()
            self._store(at[new], names[new], [raw[x:y].decode().replace(" ", "▁") for x, y in zip(a, b)])
            at = np.searchsorted(self.names, names)
        k = at[inverse]
        span, second = self.spans[k], self.second[k]
        size = span[:, 1]
        upto = np.append(0, np.cumsum(size))
        ids = self.pool[np.repeat(span[:, 0] - upto[:-1], size) + np.arange(int(upto[-1]))].tobytes()
        of = np.append(0, np.searchsorted(start, stop))
        score, back = np.append(0.0, np.cumsum(self.score[k])), np.append(0, np.cumsum(~self.back[k]))
        out = []
        for i, (p, q) in enumerate(zip(of.tolist(), of[1:].tolist())):
            total = float(score[q] - score[p])
            same = bool(back[q] == back[p]) and len(spaced[i]) - 1 == len(texts[i]) or not texts[i]
            near = self._nearest(second[p:q]) + p
            if not len(near):
                out.append((same, [(total, ids[4 * upto[p]:4 * upto[q]])]))
                continue
            options = []
            for c in near.tolist():
                more = self.lattice.nbest(raw[start[c]:end[c]].decode().replace(" ", "▁"), self.n)
                options.append((c, [(more[0][0] - s, array("I", x).tobytes()) for s, x in more[1:]]))
            found = []
            for loss, changes in self._merge(options):
                parts, last = [], p
                for c, x in changes:
                    parts += [ids[4 * upto[last]:4 * upto[c]], x]
                    last = c + 1
                found.append((total - loss, b"".join([*parts, ids[4 * upto[last]:4 * upto[q]]])))
            out.append((same, found))
        return out

    def _nearest(self, second: np.ndarray) -> np.ndarray:
        """Places of the n - 1 smallest finite losses, the earlier of equal ones."""
        near = np.flatnonzero(second < np.inf) if self.n > 1 else np.zeros(0, np.int64)
        if len(near) <= self.n - 1:
            return near
        loss = second[near]
        bar = np.partition(loss, self.n - 2)[self.n - 2]
        below, tied = near[loss < bar], near[loss == bar]
        return np.sort(np.concatenate([below, tied[:self.n - 1 - len(below)]]))

    def _merge(self, options: list[tuple[int, list[tuple[float, bytes]]]]) -> list[tuple[float, tuple]]:
        """The n cheapest sets of changes (loss, ((chunk, ids), ...)); each chunk keeps its best or takes one option."""
        combos: list[tuple[float, tuple]] = [(0.0, ())]
        for c, more in options:
            combos = heapq.nsmallest(self.n, ((a + d, x + (((c, ids),) if ids is not None else ()))
                                              for a, x in combos for d, ids in [(0.0, None), *more]), key=lambda v: v[0])
        return combos


@functools.cache
def shared(path: str, n: int) -> ChunkPaths:
    """The worker process's own memory."""
    return ChunkPaths(Lattice(path), n)


SCHEMA = "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, round_trip boolean, ids binary"
BATCH_BYTES = 1_000_000


def _segmenter(path: str, n: int, with_ids: bool):
    def rows(paths: ChunkPaths, ids: list, texts: list[bytes]) -> pd.DataFrame:
        out = []
        for i, t, (back, found) in zip(ids, texts, paths.batch([text_of(t).encode() for t in texts])):
            back = back and (not t or _is_utf8(t))
            for rank, (score, x) in enumerate(found, 1):
                out.append((i, rank, score, len(x) // 4, zlib.crc32(x), back, x if with_ids else None))
        out = pd.DataFrame(out, columns=["doc_id", "rank", "score", "n_pieces", "ids_crc32", "round_trip", "ids"])
        return out.astype({"doc_id": "Int64"})

    def run(batches: Iterator[pd.DataFrame]):
        paths = shared(path, n)
        for pdf in batches:
            ids, texts, held = [], [], 0
            for i, t in zip(pdf["id"], pdf["text"]):
                ids.append(i)
                texts.append(t)
                held += len(t or b"")
                if held >= BATCH_BYTES:
                    yield rows(paths, ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield rows(paths, ids, texts)
    return tidy(run)


def nbest_segmentations(docs: DataFrame, n: int = 4, id_col: str = "doc_id", text_col: str = "text",
                        model: str | None = None, with_ids: bool = True) -> DataFrame:
    """``(doc_id, rank, score, n_pieces, ids_crc32, round_trip, ids)``: up to ``n`` rows per input row, best first.

    ``ids`` are unsigned 32-bit little-endian.  ``round_trip`` tells whether
    the best ids decode to the text again (they do unless it holds U+2581,
    which decodes to a space, or broken UTF-8).  Null and empty texts have one
    segmentation, without pieces.  Equal scores come in a fixed order.  Repeated
    rows and null ids are segmented as any; an empty table gives no row.
    """
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    out = d.mapInPandas(_segmenter(model or tokenizer_path("piece_bpe_32k.model"), n, with_ids), SCHEMA)
    return out if with_ids else out.drop("ids")


def decode(rows: DataFrame, ids_col: str = "ids", model: str | None = None, to: str = "decoded") -> DataFrame:
    """``rows`` with the text of ``ids_col`` (unsigned 32-bit little-endian ids) as a binary column; null stays null."""
    path = model or tokenizer_path("piece_bpe_32k.model")

    @F.pandas_udf("binary")
    def back(ids: Iterator[pd.Series]) -> Iterator[pd.Series]:
        lattice = Lattice(path)
        for s in ids:
            yield s.map(lambda x: None if x is None else lattice.decode(np.frombuffer(x, np.uint32)))
    return rows.withColumn(to, back(F.col(f"`{ids_col}`")))
