"""Quality by importance resampling: two hashed n-gram models and Gumbel top-k.

Unigrams and bigrams of words and runs of punctuation are hashed into a fixed number of buckets; a word followed by itself is one bigram,
whatever the word. One model counts them in the documents known to be good (the target), the other in all documents. A document's log
ratio of the two models is the logarithm of its importance weight. Adding Gumbel noise to the logarithms and taking the ``k`` largest
draws ``k`` documents without replacement with chances in proportion to their weights.

``k`` is the number of documents above the log ratio that best tells good from bad in the labelled sample. The models' counts and ``k`` come from all
documents; only the labels are a sample of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.keyed import SCALE, digest, uniform
from veilgauge.llm.common import staged, text_key
from veilgauge.llm.textscan import WORD_OR_PUNCT, mix, pieces, words_of

BUCKETS = 10_000
LABEL_ROWS = 20_000
SEED = 42
U = np.uint64
_SAME = 0x5A5E
RANK_STEP, RANK_ZERO, RANK_BITS = 2.0**16, 2**47, 48


def features(column: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket of every unigram and bigram."""
    words = words_of(column, WORD_OR_PUNCT)
    value, doc = words.hashes(lower=True), words.doc
    pair = np.flatnonzero(doc[1:] == doc[:-1]) if len(doc) else np.zeros(0, dtype=np.int64)
    left, right = value[pair], value[pair + 1]
    double = np.where(left == right, U(_SAME), mix(left * U(3) + right))
    both = np.concatenate([value, double])
    return np.concatenate([doc, doc[pair]]), (mix(both) % U(buckets)).astype(np.int64)


def _count(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, dtype=np.int64), np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for piece in pieces(batch):
                doc, bucket = features(piece.column("text"), buckets)
                good = piece.column("good").to_numpy(zero_copy_only=False)
                raw += np.bincount(bucket, minlength=buckets)
                target += np.bincount(bucket[good[doc]], minlength=buckets)
        seen = np.flatnonzero(raw)
        yield pa.record_batch([pa.array(seen.astype(np.int32)), pa.array(raw[seen]), pa.array(target[seen])], names=["bucket", "raw", "target"])

    return run


def _score(ratio, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                doc, bucket = features(piece.column("text"), buckets)
                total = np.bincount(doc, weights=ratio.value[bucket], minlength=piece.num_rows)
                rest = [piece.column(c) for c in ("doc_id", "key", "noise")]
                yield pa.record_batch([*rest, pa.array(total)], names=["doc_id", "key", "noise", "log_ratio"])

    return run


def log_ratios(docs: DataFrame, known: DataFrame, buckets: int) -> np.ndarray:
    """``log(target / all)`` for each bucket, both with one added to every bucket. ``known``: ``doc_id, good``, a bounded sample."""
    flagged = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id", "left")
    rows = flagged.select("text", F.coalesce("good", F.lit(False)).alias("good")).mapInArrow(_count(buckets), "bucket int, raw long, target long")
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for bucket, a, b in rows.groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        raw[bucket], target[bucket] = a, b
    if not target.sum():
        return np.zeros(buckets)
    return np.log((target + 1) / (target.sum() + buckets)) - np.log((raw + 1) / (raw.sum() + buckets))


def best_cut(score: np.ndarray, good: np.ndarray) -> float:
    """The middle of the gap between scores where most of the sample is told apart; the lowest such gap."""
    order = np.argsort(score, kind="stable")
    score, good = score[order], good[order]
    right = np.concatenate([[good.sum()], good.sum() + np.cumsum(np.where(good, -1, 1))])
    edges = np.concatenate([[-np.inf], (score[1:] + score[:-1]) / 2, [np.inf]])
    usable = np.concatenate([[True], score[1:] > score[:-1], [True]])
    return float(edges[np.argmax(np.where(usable, right, -1))])


def kth_largest(rows: DataFrame, column: str, k: int) -> int:
    """The ``k``-th largest value of a long column of ``RANK_BITS`` bits, by counting 12 bits at a time."""
    head = 0
    for shift in range(RANK_BITS - 12, -1, -12):
        inside = rows.filter(F.shiftright(column, shift + 12) == head)
        counts = inside.groupBy(F.shiftright(column, shift).alias("r")).count().collect()
        for value, n in sorted(counts, reverse=True):
            head = value
            if k <= n:
                break
            k -= n
    return head


def resample(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, label_rows: int = LABEL_ROWS, seed: int = SEED, k: int | None = None) -> DataFrame:
    """``doc_id, key, log_ratio, noisy, kept`` for each row of ``docs``; ``labels`` has ``doc_id`` and ``quality`` (1: good).

    At most ``label_rows`` labels, chosen by a hash of the id, say which documents are the target. ``k`` may be given; else it is found as the module says.
    The noise depends on id and text, so reruns agree. Rows tied with the ``k``-th stay with it.

    Null and empty texts have no n-grams: log ratio 0, which is neutral. Null ids are never labelled. Ids labelled twice are good only if all
    their labels are. Rows given twice are judged alike. Without good labels all ratios are 0; without labels of both kinds everything is kept.
    Other columns are not read. No rows in, no rows out.
    """
    sample = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") == 1).alias("good"))
    sample = staged(sample.orderBy(F.xxhash64("doc_id"), "doc_id").limit(label_rows))
    ratio = docs.sparkSession.sparkContext.broadcast(log_ratios(docs, sample, buckets))
    number = uniform(digest(seed, "gumbel", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    noise = -F.ln(-F.ln(number + F.lit(0.5 / SCALE)))
    keyed = docs.select("doc_id", text_key().alias("key"), noise.alias("noise"), "text")
    scored = keyed.mapInArrow(_score(ratio, buckets), "doc_id long, key long, noise double, log_ratio double")
    noisy = F.col("log_ratio") + F.col("noise")
    step = F.floor(F.least(F.greatest(noisy * RANK_STEP, F.lit(-float(RANK_ZERO))), F.lit(float(RANK_ZERO - 1)))) + F.lit(RANK_ZERO)
    scored = staged(scored.select("doc_id", "key", "log_ratio", noisy.alias("noisy"), step.cast("long").alias("rank")))
    if k is None:
        known = scored.join(F.broadcast(sample), "doc_id").select("log_ratio", "good").collect()
        good = np.array([r[1] for r in known], dtype=bool)
        cut = best_cut(np.array([r[0] for r in known]), good) if good.any() and not good.all() else -np.inf
        k = scored.filter(F.col("log_ratio") >= F.lit(cut)).count()
    kept = F.lit(False) if k < 1 else F.col("rank") >= F.lit(kth_largest(scored, "rank", k))
    return scored.select("doc_id", "key", "log_ratio", "noisy", kept.alias("kept"))


def keep_good(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that :func:`resample` draws, with all their columns."""
    gone = resample(docs, labels, **options).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_key() == gone["__key"]), "left_anti")
