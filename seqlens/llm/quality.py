"""Host-level quality rules (operator 2), DataFrame functions only.

Each document gets its base rules in one projection over its text: words and
5-word windows are arrays, repeated windows are found by sorting (hash,
position) pairs inside the row, so no word or window is ever shuffled.  Rule
failures are then aggregated by host, each host's failure rate is shrunk
towards the corpus with a beta prior fitted to the hosts' own rates (method of
moments), and the verdict on a host is joined back to its documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqlens.functions.util import stats_row
from seqlens.llm.base import same, settle

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
#: a host is rejected when its shrunk failure rate reaches this
HOST_RATE = 0.6
#: hosts up to this many are joined by broadcast (a few MB); beyond it by a salted join
BROADCAST_HOSTS = 50_000
SALT = 32


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def _repeat_words(words: Column, k: int) -> Column:
    """Words that lie in a k-word window found twice or more in the array."""
    n = F.size(words)
    windows = F.transform(F.sequence(F.lit(0), n - k),
                          lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))

    def covered(at: Column) -> Column:  # ascending positions of repeated windows
        step = F.aggregate(at, F.struct(F.lit(-k).alias("p"), F.lit(0).alias("c")),
                           lambda a, x: F.struct(x.alias("p"), (a["c"] + F.least(F.lit(k), x - a["p"])).alias("c")))
        return step["c"]

    def from_sorted(s: Column) -> Column:
        again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"] == x["h"]) | (F.get(s, i + 1)["h"] == x["h"]))
        return covered(F.array_sort(F.transform(again, lambda x: x["i"])))

    def from_windows(w: Column) -> Column:
        pairs = F.transform(w, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(
            let(F.sort_array(pairs), from_sorted))

    return F.when(n < k + 1, F.lit(0)).otherwise(let(windows, from_windows)).cast("long")


def base_rules(text: Column) -> Column:
    """Struct (n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text; null counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def of(w: Column) -> Column:
        chars = F.aggregate(w, F.lit(0).cast("long"), lambda a, x: a + F.char_length(x))
        dup = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))
        return F.struct(F.size(w).cast("long").alias("n_words"), chars.alias("word_chars"),
                        F.size(F.regexp_extract_all(text, F.lit(r"[#*$%&|<>]"), F.lit(0))).cast("long").alias("n_symbols"),
                        dup.cast("long").alias("n_dup_lines"), _repeat_words(w, WINDOW).alias("n_repeat_words"))
    return let(words_of(text), of)


def _failed(r) -> Column:
    return (r["n_words"] < MIN_WORDS) | (100 * r["n_repeat_words"] > REPEAT_PERCENT * r["n_words"])


def host_verdicts(rules: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """``(host, docs, failures, shrunk_rate, rejected)`` from rows ``(host, base_failed)``.

    Prior: with m and v the mean and the variance of the hosts' rates,
    strength = m(1-m)/v - 1, alpha = m * strength, beta = (1-m) * strength.
    Equal rates (v = 0, as with one host) pool fully: every host gets the
    corpus rate.  A strength below 0 counts as 0.  Null is a host of its own.
    """
    hosts = rules.groupBy("host").agg(F.count(F.lit(1)).alias("docs"),
                                      F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = settle(hosts)
    p = stats_row(hosts.agg(F.avg(F.col("failures") / F.col("docs")).alias("m"),
                            F.var_pop(F.col("failures") / F.col("docs")).alias("v"),
                            (F.sum("failures") / F.sum("docs")).alias("all")))
    strength = F.greatest(p["m"] * (1 - p["m"]) / F.nullif(p["v"], F.lit(0.0)) - 1, F.lit(0.0))
    rate = F.when(p["v"] == 0, p["all"]).otherwise((F.col("failures") + p["m"] * strength) / (F.col("docs") + strength))
    return hosts.withColumn("shrunk_rate", rate).withColumn("rejected", F.col("shrunk_rate") >= host_rate)


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
                  host_rate: float = HOST_RATE) -> DataFrame:
    """One row per input row: id, the base rules, ``base_failed``, ``kept``, and the host's figures.

    base_failed: fewer than 10 words, or over 20 % of the words in repeated
    5-word windows.  kept: not base_failed and the host not rejected.

    Defined results: null, empty or blank text has no words and fails; a null
    host is a host of its own; repeated rows count each; an empty table gives
    an empty result.
    """
    rules = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{host_col}`").cast("string").alias("host"),
                        base_rules(F.col(f"`{text_col}`").cast("string")).alias("r")).select("doc_id", "host", "r.*")
    failed = _failed({c: F.col(c) for c in ("n_words", "n_repeat_words")})
    rules = settle(rules.withColumn("base_failed", failed))
    hosts = settle(host_verdicts(rules, host_rate)).withColumnRenamed("host", "h2")
    if hosts.count() <= BROADCAST_HOSTS:
        out = rules.join(F.broadcast(hosts), same(F.col("host"), F.col("h2")))
    else:
        salted = hosts.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
        salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALT)).cast("int")
        out = rules.withColumn("z1", salt).join(salted, same(F.col("host"), F.col("h2")) & (F.col("z1") == F.col("z")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                      (~F.col("base_failed") & ~F.col("rejected")).alias("kept"),
                      F.col("docs").alias("host_docs"), F.col("failures").alias("host_failures"),
                      F.round("shrunk_rate", 6).alias("host_shrunk_rate"))


def keep_quality(docs: DataFrame, text_col: str = "text", host_col: str = "source",
                 host_rate: float = HOST_RATE) -> DataFrame:
    """The rows of ``docs``, all columns, that pass the base rules and whose host isn't rejected.

    The texts are read twice (for the hosts' counts, then to filter), so they
    are never shuffled; only rejected hosts are joined.
    """
    host, text = F.col(f"`{host_col}`").cast("string"), F.col(f"`{text_col}`").cast("string")
    failed = let(base_rules(text), _failed)
    hosts = host_verdicts(docs.select(host.alias("host"), failed.alias("base_failed")), host_rate)
    bad = settle(hosts.where("rejected").select(F.col("host").alias("__seqlens_host")))
    passed = docs.where(~failed)
    if bad.count() <= BROADCAST_HOSTS:
        return passed.join(F.broadcast(bad), same(host, F.col("__seqlens_host")), "left_anti")
    salted = bad.withColumn("__seqlens_z", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    salt = F.pmod(F.xxhash64(text), F.lit(SALT)).cast("int")
    return passed.join(salted, same(host, F.col("__seqlens_host")) & (salt == F.col("__seqlens_z")), "left_anti")


#: the query's SQL twin
SQL = rf"""
WITH w AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
win AS (
  SELECT doc_id, i, words[i:i + 4] AS x FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM w WHERE len(words) >= 5)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, x) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, sum(least(5, i - coalesce(p, -5))) AS n FROM
  (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM rep) GROUP BY doc_id),
ln AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w),
dup AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM ln WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
base AS (
  SELECT w.doc_id, host, cast(len(words) AS BIGINT) AS n_words,
    cast(coalesce(list_sum([length(x) for x in words]), 0) AS BIGINT) AS word_chars,
    cast(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    cast(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, cast(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN cov ON w.doc_id = cov.doc_id),
f AS (SELECT *, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {REPEAT_PERCENT} * n_words) AS base_failed FROM base),
h AS (SELECT host, count(*) AS docs, cast(sum(CASE WHEN base_failed THEN 1 ELSE 0 END) AS BIGINT) AS failures FROM f GROUP BY host),
p AS (SELECT avg(failures / docs) AS m, var_pop(failures / docs) AS v, sum(failures) / sum(docs) AS a FROM h),
s AS (SELECT m, v, a, greatest(m * (1 - m) / nullif(v, 0) - 1, 0) AS k FROM p),
r AS (SELECT host, docs, failures, CASE WHEN v = 0 THEN a ELSE (failures + m * k) / (docs + k) END AS rate FROM h, s)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  (NOT base_failed AND NOT rate >= {HOST_RATE}) AS kept, docs AS host_docs, failures AS host_failures,
  round(rate, 6) AS host_shrunk_rate
FROM f JOIN r ON f.host IS NOT DISTINCT FROM r.host
"""
