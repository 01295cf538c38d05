"""Exact removal of long repeated byte strings with a run-length index (operator 6).

A byte goes if some ``length``-byte string covers it that also starts anywhere
else in the corpus.  The corpus can't be suffix-sorted whole, so windows that
may match are first brought together, and each bucket of them is indexed:

* **Anchors.** The anchor of a window is its smallest gram hash among the first
  ``reach`` positions; it depends on the window's bytes only, so equal windows
  have equal anchors.  Neighbouring windows with one anchor form a *segment*,
  and all windows of a segment share a ``core`` string behind the anchor.
  Equal windows therefore lie in segments with equal cores.
* **Classes.** Segments of one core with equal bytes are one class.  A class
  met twice repeats whole; cores met once drop out.  This is a count with
  map-side combine: a passage in a third of all documents costs one row for
  each task, and nothing is gathered by key.
* **Index.** One string for each class of the other cores goes, with all
  classes of its core, to a bucket of about ``BUCKET_BYTES``.  There a
  Burrows-Wheeler transform is built and run-compressed; suffix positions are
  sampled at run heads and tails with the length of the match to the row above
  or below; the streamed matching statistics follow from these samples alone,
  for inside a run the match is one longer than that of the next position.
  Windows whose longest other match reaches ``length`` are marked.
* **Large cores** (over ``CORE_STRINGS`` different strings, as at the edge of a
  passage that very many documents share) don't fit a bucket.  Their windows are
  divided: one that reaches further to the right of the core than to the left
  takes the bytes to the right into its core, another those to the left; equal
  windows go the same way. The longer cores are counted again, and so on until
  a core fits, is met once, or is a whole window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import broadcast_if_small, buckets_for, release, settle, tidy
from seqlens.llm.shingles import mix, powers

GRAM = 32
REACH = 256            # windows look for their anchor among so many positions at most
BUCKET_BYTES = 400_000
CORE_STRINGS = 800
BATCH_BYTES = 600_000
_A = np.uint64(0x9E3779B97F4A7C15)
_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


class SpanHashes:
    """64-bit hashes of any spans of a buffer, from prefix sums of a polynomial with scrambled bytes as coefficients."""

    def __init__(self, buf: np.ndarray, table: np.ndarray = _TABLE):
        up, self.down = powers(len(buf) + 1)
        self.sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(table[buf] * up[:len(buf)], out=self.sums[1:])

    def __call__(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def grams(self, n: int) -> np.ndarray:
        """Hash of the ``n`` bytes from each position; short by n - 1."""
        return mix((self.sums[n:] - self.sums[:-n]) * self.down[:len(self.sums) - n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each ``w`` neighbours, by block prefixes and suffixes."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(x.dtype).max, x.dtype)
    pad[:len(x)] = x
    rows = pad.reshape(-1, w)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n], left[w - 1:w - 1 + n])


def place(start, anchor, more):
    """A segment's first window, and from there its anchor and its last window, in one number."""
    return (start << 20) | (anchor << 10) | more


def reach_of(length: int) -> int:
    """Positions among which a window of ``length`` bytes looks for its anchor: a power of two, so that cores can be halved."""
    return min(REACH, 1 << ((2 * length // 3).bit_length() - 1))


def _segments(texts: list[bytes], length: int, reach: int, gram: int):
    """(text no., place, core hash, class hash) of every segment; a place packs first window, anchor and last window."""
    buf = np.frombuffer(b"".join(texts), np.uint8)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    begins = np.cumsum(sizes) - sizes
    spans = SpanHashes(buf)
    grams = spans.grams(gram)
    low = np.uint64(0xFFFFFFFF)
    keyed = (grams & ~low) | np.arange(len(grams), dtype=np.uint64)  # ties: the leftmost
    anchor = (sliding_min(keyed, reach) & low).astype(np.int64)
    count = sizes - length + 1
    no = np.repeat(np.arange(len(texts)), count)
    at = np.arange(len(no)) + np.repeat(begins - (np.cumsum(count) - count), count)
    anchor = anchor[at]
    new = np.ones(len(at), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (no[1:] != no[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(at)) - 1
    s, e, a, no = at[first], at[last], anchor[first], no[first]
    core = spans(a, a + length - reach + 1)
    whole = mix(spans(s, e + length) * _A + (a - s).astype(np.uint64) * np.uint64(1024) + (e - s).astype(np.uint64))
    return no, place(s - begins[no], a - s, e - s), core, whole


def _segment_rows(length: int, reach: int, gram: int):
    def rows(keys, texts):
        no, at, core, whole = _segments(texts, length, reach, gram)
        z, i, h = (np.array(x)[no] for x in zip(*keys))
        return pd.DataFrame({"z": z, "id": i, "h": h, "at": at, "core": core.view(np.int64), "whole": whole.view(np.int64)})

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            keys, texts, held = [], [], 0
            for z, i, h, t in zip(pdf["z"], pdf["id"], pdf["h"], pdf["text"]):
                keys.append((z, i, h)), texts.append(t)
                held += len(t)
                if held >= BATCH_BYTES:
                    yield rows(keys, texts)
                    keys, texts, held = [], [], 0
            if keys:
                yield rows(keys, texts)
    return tidy(run)


# ---- the run-length index of one bucket ----

def suffix_array(sym: np.ndarray) -> np.ndarray:
    """Suffix order by prefix doubling; only suffixes that are still tied are sorted again."""
    n = len(sym)
    pad = np.concatenate([sym.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for i in range(7):  # 7 symbols of 9 bits
        key = (key << 9) | pad[i:i + n]
    sa = np.argsort(key, kind="stable")
    k = key[sa]
    head = np.ones(n, bool)
    head[1:] = k[1:] != k[:-1]
    rank = np.empty(n, np.int64)
    rank[sa] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    h = 7
    while True:
        alone = head & np.append(head[1:], True)
        slots = np.flatnonzero(~alone)
        if not len(slots):
            return sa
        pos = sa[slots]
        far = pos + h
        nxt = np.where(far < n, rank[np.minimum(far, n - 1)], -1)
        key = rank[pos] * (n + 1) + nxt + 1
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        sa[slots] = pos
        new = np.ones(len(slots), bool)
        new[1:] = key[1:] != key[:-1]
        head[slots] = new
        rank[pos] = np.maximum.accumulate(np.where(new, slots, 0))
        h *= 2


def match_lengths(sym: np.ndarray, x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of the suffixes at x and y, ``most`` at the longest."""
    n = len(sym)
    pad = np.concatenate([sym, np.zeros(8, sym.dtype)]).astype(np.uint64)
    words = np.zeros(n + 1, np.uint64)
    for i in range(7):
        words[:n] = (words[:n] << np.uint64(9)) | pad[i:i + n]
    out = np.zeros(len(x), np.int64)
    live = np.arange(len(x))
    while len(live):
        d = out[live]
        same7 = words[np.minimum(x[live] + d, n)] == words[np.minimum(y[live] + d, n)]
        out[live[same7]] += 7
        go = same7 & (out[live] < most[live])
        stop = live[~same7]
        for i in range(6):  # where it ends within the 7 symbols
            px, py = np.minimum(x[stop] + out[stop], n), np.minimum(y[stop] + out[stop], n)
            stop = stop[pad[px] == pad[py]]
            out[stop] += 1
        live = live[go]
    return np.minimum(out, most)


def repeated_starts(strings: list[bytes], length: int, keep_first: bool = False) -> list[np.ndarray]:
    """For each string the starts of its ``length``-byte windows that start elsewhere among ``strings`` too.

    With ``keep_first`` a window that starts nowhere before isn't named.

    Run-compressed BWT with sampled run ends: only rows at the head or tail of
    a run have their match to the neighbouring row measured; for the others
    the statistics are streamed in text order from the last sample.
    """
    sizes = np.fromiter(map(len, strings), np.int64, len(strings))
    begins = np.cumsum(sizes + 1) - sizes - 1
    sym = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8).astype(np.int64) + 1
    ends = begins + sizes
    sym[ends] = 0
    n = len(sym)
    left = np.repeat(ends, sizes + 1) - np.arange(n)  # bytes to the string's end
    sa = suffix_array(sym)
    bwt = sym[sa - 1]
    change = np.ones(n + 1, bool)
    change[1:n] = (bwt[1:] != bwt[:-1]) | (bwt[1:] == 0)  # string starts are runs of their own
    longest = np.zeros(n, np.int64)
    for row, other in ((np.flatnonzero(change[:n]), -1), (np.flatnonzero(change[1:]), 1)):
        row = row[(row + other >= 0) & (row + other < n)]
        x = sa[row]
        got = match_lengths(sym, x, sa[row + other], left[x] + 1)
        sample = np.zeros(n, np.int64)  # match + position: constant until the next sample
        mark = np.zeros(n, np.int64)
        sample[x], mark[x] = got + x, x
        mark = np.maximum.accumulate(mark)
        longest = np.maximum(longest, sample[mark] - np.arange(n))
    found = (longest >= length) & (left >= length)
    if keep_first:  # equal windows are neighbours in the suffix order
        x = sa[found[sa]]
        alike = match_lengths(sym, x[1:], x[:-1], np.full(max(0, len(x) - 1), length)) >= length
        group = np.append(0, np.cumsum(~alike))[:len(x)]
        first = np.full(len(x), n)
        np.minimum.at(first, group, x)
        found[first[:group[-1] + 1 if len(x) else 0]] = False
    return [np.flatnonzero(found[b:b + s]) for b, s in zip(begins, sizes)]


def _runs(starts: np.ndarray) -> list[tuple[int, int]]:
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), starts[np.append(cut, len(starts) - 1)].tolist()))


def _index_bucket(length: int, keep_first: bool):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["z", "id", "h", "at"]).drop_duplicates(["z", "id", "h", "at"])  # equal rows came once each
        out = {k: [] for k in ("z", "id", "h", "s", "e")}
        for z, i, h, at, n, starts in zip(pdf["z"], pdf["id"], pdf["h"], pdf["at"], pdf["n"],
                                          repeated_starts(list(pdf["str"]), length, keep_first)):
            for a, b in _runs(starts) if n == 1 or keep_first else ():
                out["z"].append(z), out["id"].append(i), out["h"].append(h)
                out["s"].append((at >> 20) + a), out["e"].append((at >> 20) + b + length)
        release()
        return pd.DataFrame(out).astype({"z": bool, "id": "int64", "h": "int64", "s": "int64", "e": "int64"})
    return run


STRINGS = "z boolean, id long, h long, at long, core long, whole long, n int, big boolean, str binary"


def _cut_strings(length: int):
    def run(batches):
        for pdf in batches:
            out = []
            for z, i, h, t, wants in zip(pdf["z"], pdf["id"], pdf["h"], pdf["text"], pdf["wants"]):
                for x in wants:
                    s, more = x["at"] >> 20, x["at"] & 1023
                    out.append((z, i, h, x["at"], x["core"], x["whole"], x["n"], x["big"], t[s:s + more + length]))
            yield pd.DataFrame(out, columns=["z", "id", "h", "at", "core", "whole", "n", "big", "str"])
    return tidy(run)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"".join(parts), digest_size=8).digest(), "little", signed=True)


def _halved(length: int, core: int):
    """Segments with the window's core of ``core`` bytes to such with longer cores (by half of what is missing)."""
    x = (length - core + 1) // 2

    def run(batches):
        for pdf in batches:
            out = []
            for z, i, h, at, n, t in zip(pdf["z"], pdf["id"], pdf["h"], pdf["at"], pdf["n"], pdf["str"]):
                s, anchor, more = at >> 20, (at >> 10) & 1023, at & 1023
                cut = anchor + core + x - length  # windows from here on have x bytes to the right of the core
                for first, last, a, side in ((max(0, cut), more, anchor - max(0, cut), b"r"), (0, min(more, cut - 1), anchor - x, b"l")):
                    if first <= last:
                        str_ = t[first:last + length]
                        key = _digest(side, str_[a:a + core + x])
                        out.append((z, i, h, place(s + first, a, last - first), key,
                                    _digest(a.to_bytes(4, "little"), str_), n, True, str_))
            yield pd.DataFrame(out, columns=["z", "id", "h", "at", "core", "whole", "n", "big", "str"])
    return tidy(run)


ROW = ("z", "id", "h")


def row_key(text_col: str, id_col: str) -> list:
    """Columns that name a row: whether its id is null, the id (else a hash of the text), a second hash of the text."""
    text, i = F.col(f"`{text_col}`").cast("binary"), F.col(f"`{id_col}`").cast("long")
    return [i.isNull().alias("z"), F.coalesce(i, F.xxhash64(F.lit(7), text)).alias("id"), F.xxhash64(text).alias("h")]


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   keep_first: bool = False) -> DataFrame:
    """``(z, id, h, spans)``: the maximal removed runs of each document that has some.

    ``z, id, h`` are those of ``row_key``; ``spans`` are disjoint, ascending
    (s, e) byte offsets, e exclusive.  With ``keep_first`` the first place of a
    string, by id (null ids last), hash of the text and offset, doesn't count.
    """
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} or more")
    reach = reach_of(length)
    d = docs.select(*row_key(text_col, id_col), F.col(f"`{text_col}`").cast("binary").alias("text")).where(
        F.octet_length("text") >= length)
    seg = d.mapInPandas(_segment_rows(length, reach, GRAM), "z boolean, id long, h long, at long, core long, whole long")
    cores = seg.groupBy("core").agg(F.count(F.lit(1)).alias("k"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    # written out, so that the join below is between two plain shuffles and AQE can split a core met very often
    cores = settle(cores.where("k > 1").select("core", (F.col("lo") == F.col("hi")).alias("alike")))
    seg = settle(seg.join(cores, "core"))
    order = F.struct(*ROW, "at")

    def gone(rows: DataFrame, kinds: DataFrame) -> DataFrame:
        """Segments that repeat whole: all of a class met twice, or all but its first."""
        twice = rows.join(kinds.where("n > 1").select("core", "whole", F.col("r").alias("__r")), ["core", "whole"])
        return (twice.where(order != F.col("__r")) if keep_first else twice).select(*ROW, "at")

    mixed = seg.where("NOT alike").drop("alike")
    kinds = settle(mixed.groupBy("core", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("r")))
    alike = seg.where("alike")
    if keep_first:
        alike = alike.join(settle(alike.groupBy("core").agg(F.min(order).alias("__r"))), "core").where(order != F.col("__r"))
    whole = [alike.select(*ROW, "at"), gone(mixed, kinds)]

    large = kinds.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > CORE_STRINGS).select(
        "core", F.lit(True).alias("big"))
    wants = (kinds.join(large, "core", "left")
             .select("r.*", F.struct("core", "whole", F.least("n", F.lit(2)).cast("int").alias("n"),
                                     F.coalesce("big", F.lit(False)).alias("big"), "r.at").alias("w"))
             .groupBy(*ROW).agg(F.collect_list("w").alias("wants")))
    wants = broadcast_if_small(settle(wants), "wants")
    strings = settle(d.join(wants, list(ROW)).select(*ROW, "text", "wants").mapInPandas(_cut_strings(length), STRINGS))
    fit, big, core = [strings.where("NOT big")], strings.where("big"), length - reach + 1
    while core < length and big.limit(1).count():
        rows = settle(big.mapInPandas(_halved(length, core), STRINGS))
        core += (length - core + 1) // 2
        made = settle(rows.groupBy("core", "whole").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"),
                                                        F.min(F.struct(*ROW, "at", "str")).alias("x"))
                      .withColumn("r", F.struct("x.z", "x.id", "x.h", "x.at")))
        # segments that stand for others are gone already, unless first places stay
        whole.append(gone(rows if keep_first else rows.where("n = 1"), made))
        size = made.groupBy("core").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select(
            "core", (F.col("k") > CORE_STRINGS).alias("big"))
        made = settle(made.join(size, "core").select("x.z", "x.id", "x.h", "x.at", "core", "whole",
                                                     F.least("n", F.lit(2)).cast("int").alias("n"), "big", "x.str"))
        fit.append(made.where("NOT big"))
        big = made.where("big")
    fit = reduce(DataFrame.unionAll, fit)
    held = fit.agg(F.coalesce(F.sum(F.octet_length("str")), F.lit(0))).first()[0]
    buckets = buckets_for(held, BUCKET_BYTES)
    indexed = (fit.withColumn("bucket", F.pmod(F.xxhash64("core"), F.lit(buckets))).groupBy("bucket")
               .applyInPandas(_index_bucket(length, keep_first), "z boolean, id long, h long, s long, e long"))
    start = F.shiftright("at", 20)
    whole = reduce(DataFrame.unionAll, whole).select(
        *ROW, start.alias("s"), (start + F.col("at").bitwiseAND(F.lit(1023)) + length).alias("e"))
    return merge_spans(whole.unionAll(indexed), ROW)


def merge_spans(parts: DataFrame, keys: tuple[str, ...] = ROW) -> DataFrame:
    """Union of the (s, e) intervals of each row key: disjoint, ascending, touching ones joined."""
    got = parts.groupBy(*keys).agg(F.sort_array(F.collect_set(F.struct("s", "e"))).alias("x"))
    kinds = dict(got.dtypes)
    return got.mapInPandas(_merger(keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", spans array<struct<s:bigint,e:bigint>>")


def _merger(keys):
    def run(batches):
        for pdf in batches:
            yield pdf[list(keys)].assign(spans=[_joined(x) for x in pdf["x"]])
    return run


def _joined(intervals) -> list[dict]:
    out: list[list[int]] = []
    for r in intervals:
        if out and r["s"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r["e"])
        else:
            out.append([r["s"], r["e"]])
    return [{"s": a, "e": b} for a, b in out]


def without_spans(binary, spans):
    """The bytes of ``binary`` outside ``spans`` (ascending, disjoint), as a Column."""
    edges = F.concat(F.transform(spans, lambda x: x["s"]), F.array(F.octet_length(binary).cast("long")))
    begin = F.concat(F.array(F.lit(0).cast("long")), F.transform(spans, lambda x: x["e"]))
    return F.aggregate(F.arrays_zip(begin.alias("b"), edges.alias("f")), F.lit(b""),
                       lambda acc, x: F.concat(acc, F.substring(binary, (x["b"] + 1).cast("int"),
                                                                (x["f"] - x["b"]).cast("int"))))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                   keep_first: bool = False) -> DataFrame:
    """``docs`` (all columns) with ``_n_bytes``, ``_n_removed``, ``_n_spans``, ``_kept`` (binary).

    Every whole text is taken as UTF-8 bytes, null as empty; matches don't
    cross rows, but a row that repeats another, id and all, is a repeat of it
    (with ``keep_first`` equal rows count as one: all of them keep what the
    first keeps).  Strings are judged on the input.  Texts shorter than
    ``length`` are left whole.  Empty table: empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, length, keep_first)
    text = F.coalesce(F.col(f"`{text_col}`").cast("binary"), F.lit(b""))
    named = {k: f"__seqlens_{k}" for k in (*ROW, "spans")}
    spans = broadcast_if_small(settle(spans.withColumnsRenamed(named)), "__seqlens_spans")
    key = [F.col(f"__seqlens_{k}") == c for k, c in zip(ROW, row_key(text_col, id_col))]
    out = docs.join(spans, key[0] & key[1] & key[2], "left")
    none = F.array().cast("array<struct<s:bigint,e:bigint>>")
    out = out.withColumn("__seqlens_spans", F.coalesce("__seqlens_spans", none))
    size = F.aggregate("__seqlens_spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"])
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.octet_length(text).cast("long").alias("_n_bytes"),
                      size.alias("_n_removed"), F.size("__seqlens_spans").cast("long").alias("_n_spans"),
                      F.when(F.size("__seqlens_spans") == 0, text).otherwise(without_spans(text, F.col("__seqlens_spans"))).alias("_kept"))


def kept_text(out: DataFrame, text_col: str):
    """The text after removal; broken characters at a cut become U+FFFD."""
    return F.when(F.col("_n_removed") > 0, F.make_valid_utf8(F.col("_kept").cast("string"))).otherwise(F.col(f"`{text_col}`"))


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400,
                 keep_first: bool = False) -> DataFrame:
    """``docs`` with repeated strings cut out of the text, everywhere or (``keep_first``) but in their first place."""
    out = remove_repeats(docs, id_col, text_col, length, keep_first)
    return out.select(*[kept_text(out, text_col).alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
