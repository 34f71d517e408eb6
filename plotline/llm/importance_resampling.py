"""Quality classifier by importance resampling: the ratio of two hashed n-gram models,
of target and of raw text, sampled by Gumbel top-k.

Both models are bags of words, runs of marks and pairs of these, hashed into ``BUCKETS``.  The raw model
counts every document; the target model counts documents labelled good (every label row
of the id says quality 1 and none says toxic), a bounded sample of them, picked by a hash.
A document's log weight is the sum over its n-grams of log(target / raw), its own counts
left out of both, lest labelled documents be favoured and rare words counted against,
and less what an n-gram of target text adds on average (both models given the length).  As
such a sum grows with the length, for good text that is a hair below the average too, it is
sampled at one scale for all lengths: the mean over the n-grams (and ``PRIOR`` n-grams of
average target text, as few tell little) times ``SCALE``.  With Gumbel noise from a hash of
the document, the k highest keys are an exact sample without replacement in proportion to
the exponentials of that; k is the share of documents of quality 1 among
the labelled times the number of documents.

Defined results: a text that is null or has no word has weight 0 and is never taken; if
no document is labelled good, nothing can be told apart and every other document is taken;
documents that tie with the k-th key are all taken (so rows repeated in id and text are
taken together); an empty table gives no rows; other columns are passed through.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BUCKETS = 1 << 17
TARGET_ROWS = 50_000
SMOOTHING = 2.0
SCALE, PRIOR = 100.0, 40.0


def ngram_buckets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of every word and word pair, and the row it stands in."""
    w = common.words_of(texts, marks=True)
    row = w.row()
    two, first = common.window_hashes(w.hash, w.ptr, 2)
    return (np.concatenate([w.hash, two]) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate([row, row[first]])


def _count(batches):
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        texts, good = batch.column("text"), batch.column("good").to_numpy(zero_copy_only=False)
        for a, b in common.chunks(texts):
            bucket, row = ngram_buckets(texts.slice(a, b - a))
            raw += np.bincount(bucket, minlength=BUCKETS)
            target += np.bincount(bucket[good[a:b][row]], minlength=BUCKETS)
    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.arange(BUCKETS, dtype=np.int32)),
                                      "raw": pa.array(raw), "target": pa.array(target)})


def good_ids(labels: DataFrame) -> DataFrame:
    """One row per labelled id: ``doc_id``, ``sound`` (quality), ``good`` (and not toxic)."""
    return labels.where(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(
        (F.min(F.coalesce("quality", F.lit(0))) == 1).alias("q"),
        (F.max(F.coalesce("toxic", F.lit(0))) == 0).alias("t")).select(
            "doc_id", F.col("q").alias("sound"), (F.col("q") & F.col("t")).alias("good"))


def flagged(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id``, ``text`` and ``good``: whether the id is among ``target``, which is of
    bounded number and broadcast."""
    ids = target.select(F.col("doc_id"), F.lit(True).alias("good"))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id", "left") \
        .select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))


def bucket_counts(docs: DataFrame, target: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Raw and target counts of each bucket; None without target text."""
    rows = flagged(docs, target).select("text", "good").mapInArrow(_count, "bucket int, raw long, target long") \
        .groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect()
    raw, tgt = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for b, r, t in rows:
        raw[b], tgt[b] = r, t
    return (raw, tgt) if tgt.sum() else None


def score(docs: DataFrame, models: tuple[np.ndarray, np.ndarray] | None, target: DataFrame, seed: int) -> DataFrame:
    """``doc_id``, ``h`` (hash of the text), ``log_weight`` (the sum), ``key`` (the mean at
    ``SCALE``, with noise) of each document that has a word."""
    if models is not None:
        # what an n-gram of target text adds on average: taking it off makes 0 the weight of
        # average target text, to which PRIOR draws the short ones
        p, q = ((x + SMOOTHING) / (x + SMOOTHING).sum() for x in (models[1], models[0]))
        usual = float((p * np.log(p / q)).sum())

    def weigh(texts: pa.Array, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log weight and number of n-grams."""
        bucket, row = ngram_buckets(texts)
        if models is None:
            return np.zeros(len(texts)), np.bincount(row, minlength=len(texts))
        raw, tgt = models
        key, own = np.unique(row * BUCKETS + bucket, return_counts=True)
        row, bucket = key // BUCKETS, key % BUCKETS
        # a document is weighed by the counts of all others
        size = np.bincount(row, own, minlength=len(texts))
        r_all, t_all = raw.sum() - size, tgt.sum() - size * good
        share = np.maximum(t_all, 1) / np.maximum(r_all, 1)
        ratio = np.log(tgt[bucket] - own * good[row] + SMOOTHING * share[row]) \
            - np.log(raw[bucket] - own + SMOOTHING) - np.log(share[row])
        return np.bincount(row, own * (ratio - usual), minlength=len(texts)), size.astype(np.int64)

    def run(batches):
        for batch in batches:
            texts, good = batch.column("text"), batch.column("good").to_numpy(zero_copy_only=False)
            got = [weigh(texts.slice(a, b - a), good[a:b]) for a, b in common.chunks(texts)]
            weight = np.concatenate([np.zeros(0), *(w for w, _ in got)])
            size = np.concatenate([np.zeros(0, np.int64), *(n for _, n in got)])
            out = pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("h"), pa.array(weight),
                 pa.array(SCALE * weight / (size + PRIOR)), batch.column("gumbel")],
                names=["doc_id", "h", "log_weight", "level", "gumbel"])
            yield out.filter(pa.array(size > 0))
    uniform = (F.pmod(F.xxhash64(F.lit(seed), "doc_id", "text"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    return flagged(docs, target).select("doc_id", "text", "good", F.xxhash64("text").alias("h"), (-F.log(-F.log(uniform))).alias("gumbel")) \
        .mapInArrow(run, "doc_id long, h long, log_weight double, level double, gumbel double") \
        .select("doc_id", "h", "log_weight", (F.col("level") + F.col("gumbel")).alias("key"))


def kth_largest(df: DataFrame, column: str, k: int, bins: int = 2048, few: int = 10_000) -> float | None:
    """The k-th largest value, exactly, by narrowing histograms: each round counts the
    values left in ``bins`` equal parts of their range; at most ``few`` reach the driver.
    None if there are fewer than k values (or k < 1)."""
    part = df.select(F.col(column).alias("x"))
    low, high, n = part.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if k < 1 or n < k:
        return None
    while True:
        if low == high:
            return low
        part = part.where((F.col("x") >= low) & (F.col("x") <= high))
        if n <= few:
            return sorted((r.x for r in part.collect()), reverse=True)[k - 1]
        at = F.least(F.lit(bins - 1), F.floor((F.col("x") - low) / ((high - low) / bins)).cast("int"))
        hist = sorted(part.groupBy(at.alias("b")).agg(F.count(F.lit(1)), F.min("x"), F.max("x")).collect(), reverse=True)
        for _, n, lo, hi in map(tuple, hist):
            if k <= n:
                low, high = lo, hi
                break
            k -= n


def resample(docs: DataFrame, labels: DataFrame, target_rows: int = TARGET_ROWS, seed: int = 11) -> DataFrame:
    """The documents taken: ``doc_id``, ``h`` (xxhash64 of the text), ``log_weight``, ``key``."""
    known = good_ids(labels)
    n_good, n_sound, n_known = known.agg(F.count_if("good"), F.count_if("sound"), F.count(F.lit(1))).first()
    pick = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    target = known.where(F.col("good") & (pick < target_rows / max(1, n_good)))
    models = bucket_counts(docs, target) if n_good else None
    scored = common.checkpointed(score(docs, models, target, seed))
    if models is None:
        return scored
    k = round(docs.count() * n_sound / n_known)
    kth = kth_largest(scored, "key", k)
    return scored if kth is None else scored.where(F.col("key") >= kth)


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the resampling takes, all columns."""
    taken = resample(docs, labels, **options).select("doc_id", "h")
    return common.rows_with(docs, taken, F.xxhash64(docs["text"]), "left_semi")


def op4(spark, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return resample(common.documents(spark, sf_dir), labels).select("doc_id", "log_weight", "key")
