"""MinHash near-dedup with tensored banding (operator 10).

Two collections of ``m`` small hashes are computed per document, each small
hash joining ``r`` minhashes.  A table key is a *pair* (i-th hash of the first
collection, j-th of the second): m*m tables of 2r minhashes each come from
only 2*m*r minhashes instead of 2*m*m*r.  Two texts with similarity s share
some key with probability (1 - (1 - s^r)^m)^2: 0.99993 at s = 0.8 with the
default m = 10, r = 2 (1.0000 at 0.9).

Candidates are confirmed on the full shingle sets and linked:

1. documents with equal shingle sets collapse to one class (linked: similarity 1);
2. a small hash met once in the corpus can't be part of a shared key, so pairs
   are formed from the colliding small hashes only;
3. a bucket stands for its smallest class; every class is compared with the
   ``FIRST`` of these that it shares most buckets with, and the confirmed links
   give components;
4. in ``PIVOTS`` rounds each bucket that still holds several components names
   one class, by a hash, and every class is compared with the one that it
   meets in most of its buckets; this costs as much as there are classes, and
   leaves few components of a large group;
5. in buckets that still hold several components, classes of different
   components are compared if they share a rare shingle (found in at most
   ``RARE`` of these classes), or if both have so many that aren't rare that
   these alone could make the link, and if the parities of their shingles in
   ``64 * WORDS`` bits differ in no more places than linked sets may differ in
   shingles.  All are necessary conditions, so no link
   between classes that share a bucket is lost, while a large group of copies
   at mixed distances costs far less than its pairs.  Of these pairs each
   class has one confirmed at a time; pairs that the links found so far have
   brought into one component need no confirmation.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.base import broadcast_if_small, compact, narrow, same, settle, sized, store, tidy
from seqlens.llm.components import connected_components
from seqlens.llm.shingles import batched, coefficients, minhashes, mix, shingle_set, word_hashes

RARE = 8            # a shingle in so many unresolved classes or fewer names its pairs directly
BROADCAST_IDS = 300_000
WIDE_ROWS = 20_000  # rows with a sketch that one task takes
FIRST = 2           # buckets' smallest classes that a class is compared with first
PIVOTS = 4          # rounds in which a bucket's classes are compared with one of them
ROUNDS = 4          # rounds in which a class has one pair confirmed
WORDS = 8           # 64-bit words of a set's parity bits


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    """(sets, WORDS) longs; a bit is set if an odd number of a set's hashes fall on it."""
    width = 64 * WORDS
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    at = (mix(flat * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(width)).astype(np.int64)
    odd = np.bincount(np.repeat(np.arange(len(sets)), size) * width + at, minlength=len(sets) * width) & 1
    return np.packbits(odd.astype(np.uint8).reshape(len(sets), width), axis=1).view(np.int64)


def _fold(s: np.ndarray) -> tuple[np.uint64, np.uint64]:
    """Two order-free 64-bit sums that identify a set."""
    return mix(s).sum(dtype=np.uint64), mix(s * np.uint64(0xD6E8FEB86659FD93)).sum(dtype=np.uint64)


def _sketcher(words: int, m: int, r: int, seed: int):
    def run(batches):
        a, b = coefficients(2 * m * r, seed)

        def sketch(ids, hs, sets):
            n = np.fromiter(map(len, sets), np.int64, len(sets))
            some = [s for s in sets if len(s)]
            small = np.zeros((len(sets), 2 * m), np.uint64)
            fold = np.zeros((len(sets), 2), np.uint64)
            if some:
                mh = minhashes(some, a, b).reshape(len(some), 2 * m, r)
                h = np.zeros((len(some), 2 * m), np.uint64)
                for i in range(r):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + mh[:, :, i])
                small[n > 0] = h
                fold[n > 0] = [_fold(s) for s in some]
            small, fold = small.view(np.int64), fold.view(np.int64)
            return pd.DataFrame({"id": ids, "h": hs, "n": n, "s1": fold[:, 0], "s2": fold[:, 1],
                                 "small": [list(x) if k else [] for x, k in zip(small, n)], "bits": list(_parity(sets))})

        for pdf in batches:
            for part in batched(zip(pdf["id"], pdf["h"], pdf["text"]), lambda r: len(r[2] or b"")):
                sets = [shingle_set(w, words) for w in word_hashes([t for _, _, t in part])]
                yield sketch(pd.array([i for i, _, _ in part], "Int64"), [h for _, h, _ in part], sets)
    return tidy(run)


def _set_maker(words: int):
    def run(batches):
        for pdf in batches:
            for part in batched(pdf["text"], lambda t: len(t or b"")):
                sets = [s for s in (shingle_set(w, words) for w in word_hashes(part)) if len(s)]
                if not sets:
                    continue
                fold = np.array([_fold(s) for s in sets], np.uint64).reshape(len(sets), 2).view(np.int64)
                yield pd.DataFrame({"n": [len(s) for s in sets], "s1": fold[:, 0], "s2": fold[:, 1],
                                    "s": [s.view(np.int64) for s in sets]})
    return tidy(run)


def _class_key():
    """A class is a distinct shingle set, known by 128 hashed bits and its size."""
    return F.xxhash64("s1", "s2", "n")


def _confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sets satisfy 100 * intersection >= percent * union."""
    x = pairs.join(sets.select(F.col("c").alias("b"), F.col("s").alias("sb")), "b")
    x = x.join(sets.select(F.col("c").alias("a"), F.col("s").alias("sa")), "a")
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    return x.where((100 + percent) * both >= percent * (F.size("sa") + F.size("sb")).cast("long")).select("a", "b")


def _mixed(mem: DataFrame) -> DataFrame:
    """Rows of the buckets that hold more than one component."""
    keys = mem.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("key")
    return mem.join(keys, "key", "left_semi")


def fits(x, y, percent: int):
    """Sizes of two sets that can reach the similarity."""
    return (100 + percent) * F.least(x, y) >= percent * (x + y)


def cross_pairs(cand: DataFrame, roots: DataFrame, sets: DataFrame, percent: int, detail: DataFrame | None = None,
                first_bucket=None) -> DataFrame:
    """Pairs (a, b) of classes in one bucket but different components that may still link.

    ``cand``: (key, c, n, ...), ``roots``: (node, root), ``sets``: (c, s).  A
    link needs a common shingle that is rare among these classes, or enough
    common ones; pairs that meet neither are left out, which loses no link.
    ``first_bucket`` (on the columns of ``cand`` and ``detail``, those of the
    other class prefixed ``l_``) tells the one bucket that names a pair.
    """
    mem = cand.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    mem = compact(_mixed(mem))
    # written step by step, so that the shuffle files of only one step are there at a time
    who = store(mem.select("c", "n", "root").distinct())
    words_in = sets.join(who.select("c", "root"), "c").select("c", "root", F.explode("s").alias("x"))
    found = words_in.groupBy("x").agg(F.count(F.lit(1)).alias("k"), (F.min("root") != F.max("root")).alias("across"))
    rare = (F.col("k") <= RARE) & F.col("across")
    found = store(found.where("k > 1").select("x", (F.col("k") > RARE).alias("often"), rare.alias("rare")))
    held = words_in.select("c", "x").join(found, "x").groupBy("c").agg(
        F.count_if("often").alias("f"), F.collect_list(F.when(F.col("rare"), F.col("x"))).alias("rare"))
    held = store(held.join(who, "c").select("c", "n", "root", "f", "rare"))
    left = held.select(F.col("c").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.explode("rare").alias("x"))
    right = held.select("c", "n", "root", F.explode("rare").alias("x"))
    by_rare = store(left.join(right, "x").where((F.col("root") != F.col("ra")) & (F.col("a") < F.col("c")))
                    .where(fits(F.col("n"), F.col("na"), percent)).select("a", F.col("c").alias("b")).distinct())

    held = held.where(100 * F.col("f") >= percent * F.col("n")).select("c", "f")
    mem = mem.join(held if detail is None else held.join(detail, "c"), "c")
    mem = compact(_mixed(mem))
    big = (mem.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k")).groupBy("key")
           .agg(F.max_by("root", F.struct("k", "root")).alias("main")))
    rest = mem.join(big, "key").where("root <> main").select(
        "key", "main", *[F.col(x).alias(f"l_{x}") for x in mem.columns if x != "key"])
    by_key = (rest.join(mem, "key").where("root <> l_root AND (root = main OR l_c < c)")
              .where(fits(F.col("n"), F.col("l_n"), percent))
              .where((100 + percent) * F.least("f", "l_f") >= percent * (F.col("n") + F.col("l_n"))))
    if first_bucket is not None:
        by_key = by_key.where(first_bucket)
    return by_rare.unionAll(by_key.select(F.least("l_c", "c").alias("a"), F.greatest("l_c", "c").alias("b"))).distinct()


def _grown(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components of the stars ``roots`` (node, root) and new ``links`` (a, b), which are written out."""
    if not links.limit(1).count():
        return roots
    return connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionAll(links))


def _pivot_components(cand: DataFrame, roots: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``roots`` after ``PIVOTS`` rounds in which a class is compared with one class that a bucket of its names.

    ``cand``: (key, c, n).  A round asks for as many pairs as there are
    classes at most, however large a bucket is.
    """
    mem = cand.select("key", "c", "n")
    for turn in range(PIVOTS):
        mem = mem.join(roots.select(F.col("node").alias("c"), "root"), "c", "left").withColumn("root", F.coalesce("root", "c"))
        mem = compact(_mixed(mem))
        named = mem.groupBy("key").agg(F.min(F.struct(F.xxhash64("c", F.lit(turn)).alias("o"), "c", "n", "root")).alias("l"))
        met = (mem.join(named, "key").where((F.col("root") != F.col("l.root")) & fits(F.col("n"), F.col("l.n"), percent))
               .groupBy("c", F.col("l.c").alias("other")).agg(F.count(F.lit(1)).alias("k")))
        asked = met.groupBy("c").agg(F.max(F.struct("k", "other")).alias("x")).select(
            F.least("c", "x.other").alias("a"), F.greatest("c", "x.other").alias("b")).distinct()
        roots = _grown(roots, compact(_confirm(compact(asked), sets, percent)))
        mem = mem.drop("root")
    return roots


def _link_components(roots: DataFrame, pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``roots`` (node, root) after all links among ``pairs`` (a, b).

    In each of ``ROUNDS`` rounds a class has one of its pairs confirmed, if
    the pair still lies in two components; what is left then, all at once.  A
    round's components are those of the stars found before and its new links.
    """
    pairs = compact(pairs)
    for turn in range(ROUNDS + 1):
        for end in ("a", "b"):
            pairs = pairs.join(roots.withColumnsRenamed({"node": end, "root": f"r{end}"}), end, "left")
        pairs = settle(pairs.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b"))
        left = pairs.count()
        if not left:
            break
        asked = pairs = sized(pairs, left)
        if turn < ROUNDS:
            ends = pairs.select(F.explode(F.array("a", "b")).alias("c"), F.struct(F.xxhash64("a", "b").alias("h"), "a", "b").alias("x"))
            asked = compact(sized(ends.groupBy("c").agg(F.min("x").alias("x")), 2 * left).select("x.a", "x.b").distinct())
            pairs = sized(pairs.join(asked, ["a", "b"], "left_anti"), left)
        roots = _grown(roots, compact(_confirm(asked, sets, percent)))
    return roots


def _linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: float = 0.8,
            m: int = 10, r: int = 2, seed: int = 7) -> DataFrame:
    """``(id, h, n, low)``, one row per input row; ``h`` is a hash of the text, ``low`` the first (z, id, h) of the
    component (null ids, marked z, come last), null without shingles."""
    percent = round(100 * similarity)
    d = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"),
                                                      F.col("text").cast("binary").alias("text"))
    sk = compact(d.select("id", F.xxhash64("text").alias("h"), "text")
                .mapInPandas(_sketcher(words, m, r, seed), "id long, h long, n long, s1 long, s2 long, small array<long>, bits array<long>")
                .withColumn("c", F.when(F.col("n") > 0, _class_key())), WIDE_ROWS)
    classes = compact(sk.where("n > 0").groupBy("c", "n").agg(F.first("small").alias("small"), F.first("bits").alias("bits"), F.min("id").alias("id"),
                                                              F.min(F.struct(F.col("id").isNull().alias("z"), "id", "h")).alias("low")), WIDE_ROWS)

    # tensored keys, from the small hashes that some other class shares
    flat = classes.select("c", "n", F.posexplode("small").alias("p", "h"))
    shared = flat.groupBy("p", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("p", "h")
    rows = (flat.join(shared, ["p", "h"], "left_semi").groupBy("c", "n")
            .agg(F.collect_list(F.struct("p", "h")).alias("e")))  # at most 2m entries
    left, right = (F.filter("e", lambda x: x["p"] < m), F.filter("e", lambda x: x["p"] >= m))
    keys = F.flatten(F.transform(left, lambda x: F.transform(right, lambda y: F.struct(
        F.xxhash64(x["p"], x["h"], y["p"], y["h"]).alias("key"), x["p"].alias("p"), y["p"].alias("q")))))
    cand = rows.select("c", "n", F.inline(keys))
    full = cand.groupBy("key").agg(F.min(F.struct("c", "n")).alias("low"), F.count(F.lit(1)).alias("k")).where("k > 1")
    cand = compact(cand.join(full.select("key", "low"), "key"))

    met_often = (cand.where((F.col("c") != F.col("low.c")) & fits(F.col("n"), F.col("low.n"), percent))
                 .groupBy(F.col("c").alias("b"), F.col("low.c").alias("a")).agg(F.count(F.lit(1)).alias("k")))
    turn = F.row_number().over(Window.partitionBy("b").orderBy(F.col("k").desc(), "a"))  # a class has at most m * m buckets
    first = compact(met_often.withColumn("turn", turn).where(F.col("turn") <= FIRST).select("a", "b"))

    in_bucket = cand.select("c").distinct()
    readers = settle(classes.join(in_bucket, "c", "left_semi").select("id").distinct())
    if readers.count() <= BROADCAST_IDS:  # a few MB; else the texts are shuffled to the ids
        readers = F.broadcast(readers)
    sets = settle(d.join(readers, same(d["id"], readers["id"]), "left_semi")
                  .mapInPandas(_set_maker(words), "n long, s1 long, s2 long, s array<long>")
                  .select(_class_key().alias("c"), "s").join(in_bucket, "c", "left_semi").dropDuplicates(["c"]))
    roots = _pivot_components(cand, connected_components(_confirm(first, sets, percent)), sets, percent)

    met = lambda at, k: F.exists(F.zip_with(F.slice("small", at, k), F.slice("l_small", at, k), lambda x, y: x == y),
                                 lambda x: x)
    apart = sum((F.bit_count(F.col("bits")[i].bitwiseXOR(F.col("l_bits")[i])) for i in range(1, WORDS)),
                F.bit_count(F.col("bits")[0].bitwiseXOR(F.col("l_bits")[0])))
    near = (100 + percent) * apart <= (100 - percent) * (F.col("n") + F.col("l_n"))
    second = cross_pairs(cand.drop("low"), roots, sets, percent, classes.select("c", "small", "bits"),
                         near & ~met(F.lit(1), F.col("p")) & ~met(F.lit(m + 1), F.col("q") - m))
    done = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    roots = _link_components(roots, second.join(done, ["a", "b"], "left_anti"), sets, percent)

    # component of each class, and the first row in it
    roots = roots.select(F.col("node").alias("c"), "root")
    of = classes.select("c", "low").join(roots, "c", "left").withColumn("root", F.coalesce("root", "c"))
    low = of.groupBy("root").agg(F.min("low").alias("low"))
    of = of.select("c", "root").join(low, "root").select("c", "low")
    return sk.select("id", "h", "n", "c").join(of, "c", "left").select("id", "h", "n", "low")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5,
                    similarity: float = 0.8, m: int = 10, r: int = 2, seed: int = 7) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, one row per input row.

    Words are ``[^\\x20\\x09-\\x0D]+`` of the text with A-Z lowered; the set
    is the distinct ``words``-word shingles, or the whole sequence as one
    shingle when there are fewer words.  Rows link when 100 * intersection >=
    (100 * similarity) * union.  ``component_id`` is the smallest id reachable,
    and a row is kept if that is its own id.

    Defined results: null, empty or blank text: n_shingles 0, linked with
    nothing, kept.  Every row is a document of its own, so rows that repeat an
    id link only through their texts.  A null id is larger than any id; a
    component of null ids only has component_id null and keeps its rows.
    Empty table: empty result.  Ids must be integers.
    """
    out = _linked(docs, id_col, text_col, words, similarity, m, r, seed)
    comp = F.when(F.col("n") > 0, F.col("low.id")).otherwise(F.col("id"))
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.col("id").eqNullSafe(comp).alias("kept"))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """One row of each component of ``near_duplicates``, with all its columns, and the rows without shingles.

    The row that stays is the first by (id, hash of the text), null ids last;
    of rows equal in both any one.  Rows that share an id only are judged
    each by its own text.
    """
    rows = settle(_linked(docs, id_col, text_col, **kw).where("n > 0").withColumn(
        "stays", F.col("id").eqNullSafe(F.col("low.id")) & (F.col("h") == F.col("low.h"))).select("id", "h", "stays"))
    names = {"id": "__seqlens_i2", "h": "__seqlens_h2"}
    gone = broadcast_if_small(settle(rows.where("NOT stays").select("id", "h").distinct().withColumnsRenamed(names)))
    again = settle(rows.where("stays").groupBy("id", "h").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
                   .select("id", "h").withColumnsRenamed(names))
    on = same(F.col("__seqlens_id"), F.col("__seqlens_i2")) & (F.col("__seqlens_h") == F.col("__seqlens_h2"))
    left = docs.withColumns({"__seqlens_id": F.col(f"`{id_col}`").cast("long"),
                             "__seqlens_h": F.xxhash64(F.col(f"`{text_col}`").cast("binary"))}).join(gone, on, "left_anti")
    if again.limit(1).count():  # equal rows: one of each
        again = broadcast_if_small(again)
        left = left.join(again, on, "left_anti").unionAll(
            left.join(again, on, "left_semi").dropDuplicates(["__seqlens_id", "__seqlens_h"]))
    return left.drop("__seqlens_id", "__seqlens_h")
