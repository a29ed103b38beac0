"""Quality rules by hashed n-gram importance, in DataFrame operations only.

Words and pairs of words are hashed into ``buckets``.  Two multinomials over the buckets are counted, one over the whole
raw corpus and one over a trusted target (rows labelled as good), both with add-one smoothing.  The score of a document
is the mean of log(target / raw) over its n-grams: the log-likelihood ratio, length-normalised.  A document is kept if
it passes the base rules and its score is at least the threshold; nothing is drawn at random, every document is judged.

The trusted rows are split by a hash: one half is counted as the target, the other, which the counts have not seen, sets
the threshold together with rows labelled bad.  Of the unseen good rows that pass the base rules at most a share of ``quantile`` may
fall below it; from there it goes down half the way to the best of the bad rows below, which costs none of these and spares
good rows.  Without such bad rows it is the quantile of all unseen good rows less ``slack + 3 / sqrt(n)`` times the spread between it
and the median, since a low quantile of few scores (n) is uncertain.  Trusted rows are all rows labelled good and not toxic, bad rows all
labelled bad, however many: each of them is counted or helps to set the threshold, and the raw counts cover every document.

The measures are made inside the row (repeats are found by sorting the row's own 3-word windows).  Shuffled are counts per bucket and,
twice, ``(doc_id, text)`` to the labels of the id, since labels grow with the corpus and may be too many to broadcast.  The quantiles
are exact, by ranks over written ranges.  The log ratios go to the rows as one array of ``buckets`` numbers.

Defined cases: a null, empty or blank text has no words and fails the base rules with score 0; null doc_ids are judged
but never trusted; repeated rows are judged one by one and counted as often as they are there; without trusted rows
nothing is rejected by score; a document at the threshold is kept; a very long text is scored whole, in memory of some tens
of bytes a word; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyra.operators.records import with_rank
from papyra.workspace import Workspace

BUCKETS = 8192
QUANTILE = 0.005
SLACK = 0.15
MIN_WORDS = 50
_SPACE = r"[\\x20\\x09-\\x0D]"
_SYMBOLS = "[#*$%&|<>]"


def _words(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns``, the text t, its words, and a 64-bit hash h of each word, from which all n-grams are hashed."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    words = F.expr(r"filter(split(t, '[\\x20\\x09-\\x0D]+'), w -> w <> '')")
    return docs.select(*columns, text.alias("t")).withColumn("words", words).withColumn("h", F.expr("transform(words, w -> xxhash64(w))"))


def base_rules(docs: DataFrame, *columns: str) -> DataFrame:
    """``columns`` and h with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed."""
    rows = _words(docs, *columns)
    n_words = F.size("h").cast("long")
    chars = F.char_length(F.array_join("words", "")).cast("long")
    symbols = F.regexp_count("t", F.lit(_SYMBOLS)).cast("long")
    lines = F.expr(r"filter(split(t, '\n', -1), x -> x rlike '[^\\x20\\x09-\\x0D]')")
    rows = rows.select(*columns, "h", n_words.alias("n_words"), chars.alias("word_chars"), symbols.alias("n_symbols"), lines.alias("lines"))
    dups = (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long")
    threes = F.expr("case when n_words < 3 then cast(array() as array<bigint>) else transform(sequence(0, size(h) - 3), i -> xxhash64(h[i], h[i + 1], h[i + 2])) end")
    rows = rows.select(*columns, "h", "n_words", "word_chars", "n_symbols", dups.alias("n_dup_lines"), threes.alias("threes"))
    # places of windows that occur twice or more: neighbours in the order of (window, place); then the words they cover
    ordered = F.expr("case when size(array_distinct(threes)) = size(threes) then cast(array() as array<struct<h:bigint,i:int>>) else sort_array(transform(threes, (h, i) -> struct(h as h, i as i))) end")
    rows = rows.withColumn("o", ordered)
    again = F.expr("sort_array(transform(filter(transform(o, (x, k) -> struct(x.i as i, x.h = get(o, k - 1).h as before, x.h = get(o, k + 1).h as after)), y -> coalesce(y.before, false) or coalesce(y.after, false)), y -> y.i))")
    rows = rows.withColumn("again", again)
    covered = F.expr("cast(aggregate(again, named_struct('n', 0L, 'upto', 0), (s, i) -> named_struct('n', s.n + i + 3 - greatest(i, s.upto), 'upto', i + 3), s -> s.n) as bigint)")
    rows = rows.select(*columns, "h", "n_words", "word_chars", "n_symbols", "n_dup_lines", covered.alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def _grams(buckets: int) -> str:
    """Buckets of the words and of the pairs of neighbours."""
    return f"concat(transform(h, x -> cast(pmod(x, {buckets}) as int)), transform(slice(h, 2, greatest(size(h) - 1, 0)), (x, i) -> cast(pmod(xxhash64(h[i], x), {buckets}) as int)))"


def _counted(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    """``(bucket, name)``: how often the n-grams of ``docs`` fall into each bucket."""
    grams = _words(docs).select(F.explode_outer(F.expr(_grams(buckets))).alias("bucket")).where("bucket is not null")  # the outer form spares a filter that computes all n-grams once more
    return grams.groupBy("bucket").agg(F.count("*").alias(name))


def _labelled(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``marks(doc_id, ...)`` names, dealt by id: only ids are held in memory."""
    return docs.select("doc_id", "text").join(marks.hint("shuffle_hash"), "doc_id")


def gram_counts(docs: DataFrame, trusted: DataFrame, buckets: int) -> DataFrame:
    """``(bucket, raw, target)`` over all documents and over those in ``trusted(doc_id)``."""
    # written, so that the shuffled texts are removed once they are counted
    target = Workspace(docs.sparkSession, "quality").table(_counted(_labelled(docs, trusted), buckets, "target"), "target")
    return _counted(docs, buckets, "raw").join(target, "bucket", "left").na.fill(0, ["target"])


def trusted_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled good and not toxic."""
    return labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()


def bad_ids(labels: DataFrame) -> DataFrame:
    """All doc_ids labelled bad."""
    return labels.where("quality = 0 and doc_id is not null").select("doc_id").distinct()


def _quantiles(scores: DataFrame, shares: list[float]) -> tuple[int, list[float]]:
    """Rows of ``scores(score, doc_id)`` and their exact quantiles, in proportion between two neighbours; no task gets all scores."""
    n = scores.count()
    if not n:
        return 0, []
    places = [share * (n - 1) for share in shares]
    ranks = sorted({1 + f(p) for p in places for f in (math.floor, math.ceil)})
    at = {r["rank"] - 1: r["score"] for r in with_rank(scores, "score", "doc_id").where(F.col("rank").isin(ranks)).select("rank", "score").collect()}  # two rows a share
    return n, [at[lo] if lo == hi else (hi - p) * at[lo] + (p - lo) * at[hi] for p, lo, hi in ((p, math.floor(p), math.ceil(p)) for p in places)]


def _threshold(judged: DataFrame, quantile: float, slack: float) -> float:
    """The threshold by ``judged(doc_id, good, score, base_failed)``, rows that the counts have not seen as good."""
    # written before it is filtered: a filter moves to the words and would compute the rules once more for each of their parts
    judged = Workspace(judged.sparkSession, "quality").table(judged.select("doc_id", "good", "score", "base_failed", (F.size("h") > 0).alias("worded")), "judged")
    n, levels = _quantiles(judged.where("good and not base_failed").select("score", "doc_id"), [quantile])
    if n:
        worse = judged.where(~F.col("good") & ~F.col("base_failed") & (F.col("score") < levels[0])).agg(F.max("score").alias("x")).first()["x"]
        if worse is not None:
            return round((levels[0] + worse) / 2, 9)
    n, levels = _quantiles(judged.where("good and worded").select("score", "doc_id"), [quantile, 0.5])
    return round(levels[0] - (slack + 3 / n**0.5) * (levels[1] - levels[0]), 9) if n else float("-inf")


def log_ratios(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[float]:
    counts = {r["bucket"]: (r["raw"], r["target"]) for r in gram_counts(docs, trusted, buckets).collect()}  # one row a bucket
    raw, target = sum(r for r, _ in counts.values()) + buckets, sum(t for _, t in counts.values()) + buckets
    if target == buckets:
        return [0.0] * buckets
    return [round(math.log((counts.get(k, (0, 0))[1] + 1) / target) - math.log((counts.get(k, (0, 0))[0] + 1) / raw), 9) for k in range(buckets)]


def _scored(rows: DataFrame, ratios: list[float]) -> DataFrame:
    table, n = f"from_json('{json.dumps(ratios)}', 'array<double>')", len(ratios)
    one, two = f"{table}[cast(pmod(x, {n}) as int)]", f"{table}[cast(pmod(xxhash64(h[i - 1], x), {n}) as int)]"
    total = f"aggregate(transform(h, (x, i) -> case when i = 0 then {one} else {one} + {two} end), 0D, (a, x) -> a + x)"
    return rows.withColumn("score", F.expr(f"round(case when size(h) = 0 then 0D else {total} / (2 * size(h) - 1) end, 9)"))


def judge(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, quantile: float = QUANTILE, slack: float = SLACK) -> DataFrame:
    """One row per document: the base measures, score, threshold and kept."""
    trusted = trusted_ids(labels)
    half = F.pmod(F.xxhash64("doc_id", F.lit("half")), F.lit(2))
    ratios = log_ratios(docs, trusted.where(half == 0), buckets)
    marks = trusted.where(half == 1).select("doc_id", F.lit(True).alias("good")).unionByName(bad_ids(labels).select("doc_id", F.lit(False).alias("good")))
    threshold = _threshold(_scored(base_rules(_labelled(docs, marks), "doc_id", "good"), ratios), quantile, slack)
    rows = _scored(base_rules(docs, "doc_id"), ratios).withColumn("threshold", F.lit(threshold))
    kept = ~F.col("base_failed") & (F.col("score") >= F.col("threshold"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "score", "threshold")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {"op8_likelihood_ratio_quality": op8_quality}
