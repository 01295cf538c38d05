"""Ranked search: short lists by term, long lists by document (operator 11).

* **Index.** Each task cuts its documents to shards of at most ``SHARD_DOCS``
  and writes an inverted index of each as one row of binary columns: for each
  term the documents, ascending, and the occurrences.  Document frequencies,
  the number of documents and of terms are of all shards, so a shard's scores
  are those of an unsharded search.
* **Short lists, term at a time.** In a shard, an item's lists of at most
  ``1 / SHORT`` of the documents are summed up, giving one list of documents
  with accumulated scores.  It goes on as *one* iterator, bounded by its
  greatest sum.
* **Long lists, document at a time.** That iterator and the long lists, each
  bounded by its weight times its greatest impact, pass the documents together
  in windows.  Iterators whose bounds add up to less than the k-th best score
  so far can't bring a document in by themselves; they are only asked, greatest
  bound first, about documents that the others have found and that may still
  reach that score, and skip all else.
* **Merge.** A task carries an item's k best from shard to shard (their last
  score is the next shard's bar); the tasks' results are merged by item in two
  steps.

Items go in blocks of bounded size; blocks and shards meet in one job, by a
broadcast of the blocks if they are small together, else by a shuffle in which
every shard meets every block once (the items are the stated query set).

Score: the sum over an item's distinct terms of ``w * ((10^9 tf) div (1000 tf +
20 m))``; ``w = floor(1000 ln((2N + 2) / (2 df + 1)))``, ``m = 100 - b + ((b n
N) div L)`` with b = 50.  Terms are runs of ASCII letters (lower-cased), digits
and characters beyond ASCII, known by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqlens.llm.base import broadcast_if_small, buckets_for, narrow, settle, tidy
from seqlens.llm.shingles import run_hashes

B = 50                      # weight of a document's length, in hundredths
SHARD_DOCS, SHARD_TERMS = 8_192, 3_000_000
SHORT = 32                  # a list of at most this part of a shard's documents is short
WINDOW = 2_048              # documents that the iterators pass together
BLOCK_TERMS = 65_536        # (item, term) pairs of a block of items
BROADCAST_TERMS = 1_000_000  # pairs up to which all blocks go to every executor (16 MB)
MERGE = 64                  # parts in which an item's results are merged first
_FOLD = bytes(c if c >= 128 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))


def term_hashes(texts: list[bytes | None]) -> list[np.ndarray]:
    return run_hashes([bytes(t).translate(_FOLD) if t is not None else b"" for t in texts])


INDEX = ("shard binary, n_docs long, n_terms long, ids binary, no_id binary, length binary, names binary, df binary, "
         "doc binary, tf binary")


def build_shard(ids: list[int | None], terms: list[np.ndarray]) -> dict:
    """Inverted index of documents that have terms."""
    size = np.fromiter(map(len, terms), np.int64, len(terms))
    names, local = np.unique(np.concatenate(terms), return_inverse=True)
    pair, tf = np.unique(local.astype(np.int64) * len(ids) + np.repeat(np.arange(len(ids)), size), return_counts=True)
    raw = {"n_docs": len(ids), "n_terms": int(size.sum()), "ids": np.array([i or 0 for i in ids], np.int64).tobytes(),
           "no_id": np.array([i is None for i in ids]).tobytes(), "length": size.tobytes(), "names": names.tobytes(),
           "df": np.bincount(pair // len(ids), minlength=len(names)).astype(np.int32).tobytes(),
           "doc": (pair % len(ids)).astype(np.uint16).tobytes(), "tf": tf.astype(np.int32).tobytes()}
    return {"shard": raw["ids"][:64] + raw["names"][:64], **raw}


@tidy
def _build(frames):
    ids, terms, held = [], [], 0
    for pdf in frames:
        for at in range(0, len(pdf), 500):
            part = pdf.iloc[at:at + 500]
            for i, t in zip(part["id"], term_hashes(list(part["text"]))):
                if not len(t):
                    continue
                ids.append(None if i is None else int(i))
                terms.append(t)
                held += len(t)
                if len(ids) >= SHARD_DOCS or held >= SHARD_TERMS:
                    yield pd.DataFrame([build_shard(ids, terms)])
                    ids, terms, held = [], [], 0
    if ids:
        yield pd.DataFrame([build_shard(ids, terms)])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows of ``INDEX``, one a shard, written out; documents without a term are left out."""
    rows = narrow(docs, id=id_col, text=text_col).select(F.col("id").cast("long").cast("string").alias("id"),
                                                         F.col("text").cast("binary").alias("text"))
    return settle(rows.mapInPandas(_build, INDEX))


def _frequencies(frames):
    for pdf in frames:
        for names, df in zip(pdf["names"], pdf["df"]):
            yield pd.DataFrame({"term": np.frombuffer(names, np.int64), "df": np.frombuffer(df, np.int32).astype(np.int64)})


def _item_terms(frames):
    for pdf in frames:
        for i, t in zip(pdf["id"], term_hashes(list(pdf["text"]))):
            yield pd.DataFrame({"item": int(i), "term": np.unique(t).view(np.int64)})


def _block(key, pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["item", "term"])
    items, size = np.unique(pdf["item"].to_numpy(np.int64), return_counts=True)
    return pd.DataFrame([{"block": key[0], "items": items.tobytes(), "sizes": size.astype(np.int64).tobytes(),
                          "terms": pdf["term"].to_numpy(np.int64).tobytes(), "weights": pdf["w"].to_numpy(np.int64).tobytes()}])


class Shard:
    """One shard's lists, with impacts for the whole table's numbers."""

    def __init__(self, row, n: int, total: int):
        self.n = row.n_docs
        self.ids = np.frombuffer(row.ids, np.int64)
        self.no_id = np.frombuffer(row.no_id, bool)
        self.names = np.frombuffer(row.names, np.uint64)
        df = np.frombuffer(row.df, np.int32).astype(np.int64)
        self.end = np.cumsum(df)
        self.begin = self.end - df
        self.doc = np.frombuffer(row.doc, np.uint16).astype(np.int64)
        m = 100 - B + (B * np.frombuffer(row.length, np.int64) * n) // total
        tf = np.frombuffer(row.tf, np.int32).astype(np.int64)
        self.impact = 1_000_000_000 * tf // (1000 * tf + 20 * m[self.doc])
        self.most = np.maximum.reduceat(self.impact, self.begin)

    def lists(self, terms: np.ndarray, weights: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
        """(bound, documents, scores) of an item's iterators: the summed short lists, then each long list."""
        at = np.minimum(np.searchsorted(self.names, terms), len(self.names) - 1)
        met = self.names[at] == terms
        at, weights = at[met], weights[met]
        size = self.end[at] - self.begin[at]
        short = size * SHORT <= self.n
        out = []
        if short.any():
            s = size[short]
            post = np.repeat(self.begin[at[short]] - (np.cumsum(s) - s), s) + np.arange(s.sum())
            docs, score = self.doc[post], np.repeat(weights[short], s) * self.impact[post]
            order = np.argsort(docs, kind="stable")
            docs, score = docs[order], score[order]
            first = np.flatnonzero(np.append(True, docs[1:] != docs[:-1]))
            score = np.add.reduceat(score, first)
            out.append((int(score.max()), docs[first], score))
        for t, w in zip(at[~short].tolist(), weights[~short].tolist()):
            part = slice(self.begin[t], self.end[t])
            out.append((int(w * self.most[t]), self.doc[part], w * self.impact[part]))
        return out

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int, bar: int) -> tuple[np.ndarray, np.ndarray]:
        """(documents, scores) of this shard that may be among the k best, if ``bar`` is reached k times elsewhere."""
        lists = sorted(self.lists(terms, weights), key=lambda x: x[0])
        bounds = np.cumsum([0] + [b for b, _, _ in lists])  # what the first j iterators can give together
        edges = np.arange(0, self.n + WINDOW, WINDOW)
        cuts = [np.searchsorted(d, edges) for _, d, _ in lists]
        docs, scores = np.zeros(0, np.int64), np.zeros(0, np.int64)
        bar = max(bar, 1)  # scores above 0 only
        for v, a in enumerate(edges[:-1]):
            asked = int(np.searchsorted(bounds[1:], bar, side="left"))  # the first ``asked`` ones give less than the bar
            if asked == len(lists):
                break  # nor do all of them
            part = np.zeros(WINDOW, np.int64)
            for j in range(asked, len(lists)):
                s = slice(cuts[j][v], cuts[j][v + 1])
                part[lists[j][1][s] - a] += lists[j][2][s]
            alive = np.flatnonzero((part + bounds[asked] >= bar) & (part > 0))
            for j in range(asked - 1, -1, -1):
                if not len(alive):
                    break
                own = lists[j][1][cuts[j][v]:cuts[j][v + 1]] - a
                if len(own):
                    at = np.minimum(np.searchsorted(own, alive), len(own) - 1)
                    hit = own[at] == alive
                    part[alive[hit]] += lists[j][2][cuts[j][v] + at[hit]]
                alive = alive[part[alive] + bounds[j] >= bar]
            if not len(alive):
                continue
            docs, scores = np.append(docs, alive + a), np.append(scores, part[alive])
            if len(docs) > k:
                bar = max(bar, int(-np.partition(-scores, k - 1)[k - 1]))
                docs, scores = docs[scores >= bar], scores[scores >= bar]
        return docs, scores


def _search(n: int, total: int, k: int):
    @tidy
    def run(frames):
        best: dict[int, tuple] = {}  # of an item: scores, no id, ids of its best so far
        held = 0

        def rows():
            for item, (s, none, ids) in best.items():
                yield pd.DataFrame({"item_id": item, "doc_id": pd.Series(ids).astype("Int64").mask(pd.Series(none)), "score": s})

        for pdf in frames:
            for row in pdf.itertuples():
                shard = Shard(row, n, total)
                items = np.frombuffer(row.items, np.int64).tolist()
                stop = np.cumsum(np.frombuffer(row.sizes, np.int64)).tolist()
                terms, weights = np.frombuffer(row.terms, np.uint64), np.frombuffer(row.weights, np.int64)
                for item, a, b in zip(items, [0, *stop], stop):
                    old = best.get(item)
                    bar = int(old[0][-1]) if old and len(old[0]) == k else 0
                    docs, scores = shard.top(terms[a:b], weights[a:b], k, bar)
                    if not len(docs):
                        continue
                    new = scores, shard.no_id[docs], shard.ids[docs]
                    if old:
                        new = tuple(np.concatenate(x) for x in zip(old, new))
                        held -= len(old[0])
                    order = np.lexsort((new[2], new[1], -new[0]))[:k]
                    best[item] = tuple(x[order] for x in new)
                    held += len(order)
                if held > 1_000_000:
                    yield from rows()
                    best, held = {}, 0
        yield from rows()
    return run


def _merged(found: DataFrame, k: int, *keys) -> DataFrame:
    order = Window.partitionBy("item_id", *keys).orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: DataFrame, items: DataFrame, k: int = 50, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``(item_id, rank, doc_id, score)``: for every item the k best documents of ``index`` with a score above 0.

    Rows with the same item id are one item (the union of their terms); rows
    without an id ask nothing; null and empty texts match nothing.  Equal
    scores go by ascending document id, documents without an id last; rows
    that repeat an id or a text are documents of their own.  Empty tables give
    an empty result.
    """
    spark = index.sparkSession
    size = index.agg(F.sum("n_docs").alias("n"), F.sum("n_terms").alias("t"), F.count(F.lit(1)).alias("shards")).first()
    if not size["n"]:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    asked = narrow(items, id=id_col, text=text_col).where("id IS NOT NULL").select(
        F.col("id").cast("long").cast("string").alias("id"), F.col("text").cast("binary").alias("text"))
    asked = settle(asked.mapInPandas(_item_terms, "item long, term long").distinct())
    wanted = broadcast_if_small(settle(asked.select("term").distinct()))
    df = (index.select("names", "df").mapInPandas(_frequencies, "term long, df long").join(wanted, "term")
          .groupBy("term").agg(F.sum("df").alias("df")))
    w = F.floor(1000 * F.log((2.0 * F.lit(size["n"]) + 2) / (2.0 * F.col("df") + 1))).cast("long")
    asked = settle(asked.join(df, "term").select("item", "term", w.alias("w")).where("w > 0"))
    pairs = asked.count()
    blocks = buckets_for(pairs, BLOCK_TERMS)
    packed = settle(asked.groupBy(F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int").alias("block")).applyInPandas(
        _block, "block int, items binary, sizes binary, terms binary, weights binary"))
    shards = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    if pairs <= BROADCAST_TERMS:
        met = shards.join(F.broadcast(packed), "block")
    else:  # a block's copies meet some 64 shards each
        copies = buckets_for(size["shards"], 64)
        met = shards.withColumn("copy", F.pmod(F.xxhash64("shard"), F.lit(copies)).cast("int")).join(
            packed.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))), ["block", "copy"]).drop("copy")
    met = met.drop("shard", "block")
    found = met.mapInPandas(_search(size["n"], size["t"], k), "item_id long, doc_id long, score long")
    found = _merged(settle(found), k, F.pmod(F.xxhash64("doc_id"), F.lit(MERGE)))
    return _merged(found, k).select("item_id", "rank", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """``search`` in an index of all ``docs`` (``doc_id``, ``text``)."""
    return search(build_index(docs), items, k)


#: the query's SQL twin
SQL = rf"""
WITH fold AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z0-9\x{{80}}-\x{{10FFFF}}]+') AS t FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(t) AS term FROM fold) GROUP BY ALL),
len AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
g AS (SELECT count(*)::BIGINT AS n, sum(n)::BIGINT AS l FROM len),
w AS (SELECT term, floor(1000 * ln((2.0::DOUBLE * g.n + 2) / (2.0::DOUBLE * count(*) + 1)))::BIGINT AS w FROM tf, g GROUP BY term, g.n),
m AS (SELECT doc_id, {100 - B} + ({B} * len.n * g.n) // g.l AS m FROM len, g),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[a-z0-9\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark WHERE item_id IS NOT NULL),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN w USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY item_id, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50
"""
