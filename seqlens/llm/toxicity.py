"""Toxicity by weak supervision (operator 9).

1. **Voters.** Lexicon voters (one for each word list and language), shape
   voters (patterns of characters), and pattern voters: words, word beginnings
   and word endings mined from the labelled training rows by significance.  A
   voter says toxic, clean or nothing; one voter says clean where no other
   found anything, and the annotators' labels are a voter too.
2. **Label model.** A generative model P(votes, y) is fitted by EM: for each
   voter its rates of speaking given y (so its accuracy), and the correlation
   of each pair of voters given y.  A voter's evidence is divided by the
   number of voters it moves with, so ten spellings of one clue count once.
3. **Classifier.** A logistic regression on the presence of mined features is
   trained on the model's posterior labels, and scores every whole text.

Mining and voting are Spark jobs over the sample of labelled rows; what comes
to the driver is bounded by ``SAMPLE`` rows and ``FEATURES`` features.  The
sample is the rows with the smallest hash, so it doesn't depend on order.
Scoring is one pass over all texts, without a shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqlens.llm.base import tidy
from seqlens.llm.tokens import text_of

SAMPLE = 20_000        # labelled rows that mining and training read at most
FEATURES = 2_000       # mined features kept at most
VOTERS = 200           # of these, the ones that vote
MIN_SUPPORT = 6        # labelled rows a feature must be found in
MIN_Z = 4.5            # standard errors between its rates in toxic and clean rows
ANNOTATOR = 0.995      # accuracy assumed of a label

# Fixed word lists: common insults
LEXICON = {
    "en": "stupid idiot moron loser pathetic worthless disgusting scum trash clown dumb ugly hate garbage filth vermin "
          "imbecile jerk creep freak bastard coward liar fool",
    "de": "dumm idiot trottel versager erbärmlich wertlos widerlich abschaum müll depp hässlich hass dreck arschloch "
          "ekelhaft feigling lügner schwachkopf",
    "fr": "stupide idiot crétin minable pathétique nul dégoûtant ordure déchet clown débile laid haine salaud connard "
          "imbécile lâche menteur",
    "es": "estúpido idiota imbécil perdedor patético inútil asqueroso escoria basura payaso tonto feo odio cabrón "
          "cobarde mentiroso gilipollas",
}
SHAPES = {"shouting": re.compile(r"[^\W\d_a-zß-ÿ]{4,}!+"), "many marks": re.compile(r"[!?]{3,}"), "grawlix": re.compile(r"[a-z][*#@$%]{2,}[a-z]")}

_WORD = re.compile(r"[^\W\d_]+")


def word_features(word: str) -> list[str]:
    """A word, its beginnings and its endings."""
    out = ["=" + word]
    out += ["^" + word[:k] for k in (3, 4, 5, 6) if len(word) > k]
    out += [word[-k:] + "$" for k in (4, 5, 6) if len(word) > k]
    return out


class Known(dict):
    """word -> numbers of the model's features it has; bounded."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self.numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 100_000:
            self.clear()
        got = self[word] = tuple(self.numbers[f] for f in word_features(word) if f in self.numbers)
        return got

    def of(self, text: str) -> list[int]:
        found: set[int] = set()
        for w in set(_WORD.findall(text.lower())):
            if ids := self[w]:
                found.update(ids)
        return sorted(found)


def held_out(id_col) -> F.Column:
    """Rows that no label is learned from: crc32 of the id as text, modulo 3, is 1 (null: false)."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_features(batches: Iterator[pd.DataFrame]):
    pos, neg = Counter(), Counter()
    for pdf in batches:
        for t, y in zip(pdf["text"], pdf["toxic"]):
            words = set(_WORD.findall(text_of(t).lower()))
            (pos if y else neg).update({f for w in words for f in word_features(w)})
        if len(pos) + len(neg) > 200_000:
            yield _counts(pos, neg)
            pos, neg = Counter(), Counter()
    if pos or neg:
        yield _counts(pos, neg)


def _counts(pos: Counter, neg: Counter) -> pd.DataFrame:
    keys = list(pos.keys() | neg.keys())
    return pd.DataFrame({"f": keys, "p": [pos[k] for k in keys], "n": [neg[k] for k in keys]}).astype({"p": "int64", "n": "int64"})


def _voter_names() -> list[str]:
    return [f"lexicon {k}" for k in LEXICON] + [f"shape {k}" for k in SHAPES]


def _vote_rows(numbers: dict[str, int]):
    lists = [frozenset(v.split()) for v in LEXICON.values()]

    def run(batches):
        known = Known(numbers)
        for pdf in batches:
            ids, shows = [], []
            for t in pdf["text"]:
                t = text_of(t)
                words = set(_WORD.findall(t.lower()))
                ids.append(known.of(t))
                shows.append([int(not x.isdisjoint(words)) for x in lists] + [int(bool(x.search(t))) for x in SHAPES.values()])
            yield pd.DataFrame({"toxic": pdf["toxic"], "ids": ids, "fixed": shows})
    return tidy(run)


def fit_label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> tuple[np.ndarray, dict]:
    """Posterior P(y = 1 | votes) of each row, and what was estimated.

    ``votes``: rows x voters, True where a voter speaks; ``labels``: the
    annotators' 0/1.  Rates of speaking given y come from EM, correlations of
    voters given y from the posterior-weighted residuals; evidence of voter j
    is divided by 1 + sum of its squared correlations with the others.
    """
    x = votes.astype(np.float32)
    q = np.where(labels == 1, ANNOTATOR, 1 - ANNOTATOR).astype(np.float64)
    found = {}
    for _ in range(rounds):
        w1, w0 = q.sum(), (1 - q).sum()
        prior = (w1 + 1) / (w1 + w0 + 2)
        r1, r0 = (x.T @ q + .5) / (w1 + 1), (x.T @ (1 - q) + .5) / (w0 + 1)
        cov = np.zeros((x.shape[1],) * 2)
        for rate, w in ((r1, q), (r0, 1 - q)):
            cov += (x * w[:, None].astype(np.float32)).T.astype(np.float64) @ x - w.sum() * np.outer(rate, rate)
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        corr = np.clip(cov / np.outer(sd, sd), -1, 1)
        share = 1 / np.maximum((corr ** 2).sum(1), 1)
        on, off = np.log(r1 / r0) * share, np.log((1 - r1) / (1 - r0)) * share
        # the annotators are a voter of known accuracy
        said = np.log(ANNOTATOR / (1 - ANNOTATOR)) * np.where(labels == 1, 1, -1)
        logit = np.log(prior / (1 - prior)) + x @ on + (1 - x) @ off + said
        new = 1 / (1 + np.exp(-np.clip(logit, -40, 40)))
        moved = np.abs(new - q).max(initial=0)
        q = new
        found = {"prior": prior, "rate_toxic": r1, "rate_clean": r0, "share": share, "correlation": corr}
        if moved < 1e-4:
            break
    return q, found


def fit_linear(rows: list[np.ndarray], target: np.ndarray, width: int, l2: float = 3e-6, steps: int = 500
               ) -> tuple[np.ndarray, float]:
    """Logistic regression on binary features with soft targets (full-batch Adam); weights and intercept."""
    n = len(rows)
    sizes = np.fromiter(map(len, rows), np.int64, n)
    cols = np.concatenate(rows).astype(np.int64) if sizes.sum() else np.zeros(0, np.int64)
    row = np.repeat(np.arange(n), sizes)
    base = np.clip(target.mean(), 1e-4, 1 - 1e-4)
    w = np.zeros(width + 1)
    w[-1] = np.log(base / (1 - base))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        z = np.bincount(row, w[cols], n) + w[-1]
        d = 1 / (1 + np.exp(-np.clip(z, -40, 40))) - target
        g = np.append(np.bincount(cols, d[row], width), d.sum()) / n
        g[:-1] += l2 * w[:-1]
        m, v = .9 * m + .1 * g, .999 * v + .001 * g * g
        w -= .1 * (m / (1 - .9 ** t)) / (np.sqrt(v / (1 - .999 ** t)) + 1e-9)
    return w[:-1], float(w[-1])


@dataclass
class ToxicityModel:
    """Features and weights; plain values, so it travels in a task's closure."""

    weights: dict[str, float] = field(default_factory=dict)
    intercept: float = -6.0
    label_model: dict = field(default_factory=dict)

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """``(id, score)`` of every row; a null or empty text has the score of a text without any feature."""
        names, bias = list(self.weights), self.intercept
        numbers, w = {f: i for i, f in enumerate(names)}, np.array([self.weights[f] for f in names] or [0.0])

        def run(batches):
            known = Known(numbers)
            for pdf in batches:
                z = [bias + float(w[known.of(text_of(t))].sum()) if t else bias for t in pdf["text"]]
                yield pd.DataFrame({"id": pdf["id"], "score": 1 / (1 + np.exp(-np.clip(z, -40, 40)))})
        d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
        return d.mapInPandas(tidy(run), f"id {docs.schema[id_col].dataType.simpleString()}, score double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE
          ) -> ToxicityModel:
    """Fit on labelled rows that aren't held out, at most ``sample`` ids of them (those with the smallest hash).

    A label repeated for an id counts once (toxic wins); null labels and ids
    don't count.  Without both toxic and clean rows the model is constant.
    """
    lab = (labels.select(F.col(id_col).alias("lid"), F.col("toxic").cast("int").alias("toxic")).dropna()
           .where(~held_out(F.col("lid"))).groupBy("lid").agg(F.max("toxic").alias("toxic")))
    lab = lab.orderBy(F.xxhash64("lid"), "lid").limit(sample)
    d = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("binary").alias("text"))
    rows = d.join(F.broadcast(lab), F.col("id") == F.col("lid")).select("text", "toxic")

    size = lab.agg(F.coalesce(F.sum("toxic"), F.lit(0)).alias("p"), F.count(F.lit(1)).alias("n")).first()
    n1, n0 = size["p"], size["n"] - size["p"]
    if not n1 or not n0:
        return ToxicityModel(intercept=6.0 if n1 else -6.0)
    counts = rows.mapInPandas(_count_features, "f string, p long, n long").groupBy("f").agg(
        F.sum("p").alias("p"), F.sum("n").alias("n")).where(F.col("p") + F.col("n") >= MIN_SUPPORT)
    both = (F.col("p") + F.col("n") + 1) / F.lit(float(n1 + n0 + 2))
    z = (F.col("p") / float(n1) - F.col("n") / float(n0)) / F.sqrt(both * (1 - both) * (1 / n1 + 1 / n0))
    mined = counts.withColumn("z", z).where(F.abs("z") >= MIN_Z).orderBy(F.abs("z").desc(), "f").limit(FEATURES).collect()
    names = [r["f"] for r in mined]
    got = rows.mapInPandas(_vote_rows({f: i for i, f in enumerate(names)}),
                           "toxic int, ids array<int>, fixed array<int>").toPandas()

    if got.empty:  # labelled ids that no document has
        return ToxicityModel()
    y = got["toxic"].to_numpy()
    feats = [np.asarray(x, np.int64) for x in got["ids"]]
    voting = [i for i, r in enumerate(mined) if r["z"] > 0][:VOTERS]
    place = np.full(len(names) + 1, -1)
    place[voting] = np.arange(len(voting))
    fixed = len(_voter_names())
    votes = np.zeros((len(y), fixed + len(voting) + 1), bool)
    votes[:, :fixed] = np.array(got["fixed"].tolist(), bool).reshape(len(y), fixed)
    for i, x in enumerate(feats):
        p = place[x]
        votes[i, fixed + p[p >= 0]] = True
    votes[:, -1] = ~votes[:, :-1].any(1)  # speaks for clean
    q, found = fit_label_model(votes, y)
    w, b = fit_linear(feats, q, len(names))
    found["voters"] = _voter_names() + [names[i] for i in voting] + ["nothing found"]
    return ToxicityModel({f: float(x) for f, x in zip(names, w)}, b, found)


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.7, sample: int = SAMPLE) -> DataFrame:
    """``(doc_id, held_out, score, predicted)``, one row per input row; predicted = score >= ``threshold``.

    Only the text is an input of a score.  Repeated rows and null ids are
    scored as any; an empty table gives an empty result.
    """
    model = train(docs, labels, id_col, text_col, sample)
    return model.score(docs, id_col, text_col).select(
        F.col("id").alias("doc_id"), held_out(F.col("id")).alias("held_out"), "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``threshold``; one pass, each row judged by itself."""
    model = train(docs, labels, id_col, text_col)
    names, bias, at = list(model.weights), model.intercept, docs.columns.index(text_col)
    numbers, w = {f: i for i, f in enumerate(names)}, np.array([model.weights[f] for f in names] or [0.0])

    def run(batches):
        known = Known(numbers)
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                z = [bias + float(w[known.of(text_of(t.as_py()))].sum()) for t in part.column(at)]
                yield part.filter(pa.array(1 / (1 + np.exp(-np.clip(np.array(z), -40, 40))) < threshold))
    raw = docs.select(*[F.col(f"`{c}`").cast("binary").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
    out = raw.mapInArrow(tidy(run), raw.schema)
    return out.select(*[F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns])
