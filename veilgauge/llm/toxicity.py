"""Toxicity by non-negative positive-unlabelled learning.

Known toxic documents (P) and unlabelled text (U) are all that is learned from. With the class prior ``c`` the risk is
``c * E_P[l(g, +)] + max(0, E_U[l(g, -)] - c * E_P[l(g, -)])``: the text without labels stands for the negatives, corrected for the toxic part
in it, and the corrected part may not turn negative, which is where such models begin to overfit. The prior is the share of toxic labels times ``CAUTION``: too
large a prior would take clean text for the toxic part. The cut between the two classes minimises the same estimate for counted errors.

Features are the presence of hashed words and of runs of four bytes in words, which also find compounds of a root. Every bucket whose document frequencies differ between P and U by some standard errors is used;
the frequencies of U are counted over all documents that are not held out.
The documents are dealt into blocks of about ``text_rows``, and linear classifiers are trained on each block and the toxic sample, at least ``MODELS`` in
all and one task each: half of the rows gives the weights, the other half the cut. Their weights are averaged by one aggregate, so all unlabelled text is learned from, in tasks of bounded size. Only the toxic
sample is bounded by a parameter; scoring runs over all documents in one scan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import staged, text_key
from veilgauge.llm.textscan import LETTERS, Words, pieces, words_of

BUCKET_BITS = 20
TOXIC_ROWS = 4_000
TEXT_ROWS = 16_000
LEAST_DOCS = 5
LEAST_Z = 4.0
MODELS = 4
CAUTION = 0.9
STEPS = 300
RATE = 0.1
SHRINK = 1e-4
U = np.uint64
_SMALL = np.arange(256, dtype=np.uint32)
_SMALL[65:91] += 32


def _grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Place and bucket of every run of four bytes inside a word, A-Z in lower case."""
    data = words.data
    if len(data) < 4:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    inside = LETTERS[data] != 0
    ok = inside[:-3] & inside[1:-2] & inside[2:-1] & inside[3:]
    for j in (1, 2, 3):
        edge = words.offsets - j
        ok[edge[(edge >= 0) & (edge < len(ok))]] = False
    small = _SMALL[data]
    code = small[:-3] | (small[1:-2] << 8) | (small[2:-1] << 16) | (small[3:] << 24)
    return np.flatnonzero(ok), (code * np.uint32(2654435761) >> np.uint32(32 - BUCKET_BITS)).astype(np.int64)


def presence(column: pa.Array, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Text index and bucket, once per text, of each lower-cased word and of each four bytes of a word; only ``known`` buckets if given."""
    words = words_of(column, LETTERS)
    bucket, doc = (words.hashes(lower=True) >> U(64 - BUCKET_BITS)).astype(np.int64), words.doc
    at, gram = _grams(words)
    if known is not None:
        use = known[bucket]
        bucket, doc = bucket[use], doc[use]
        at = at[known[gram[at]]]
    gram = gram[at]
    owner = np.searchsorted(words.offsets, at, side="right") - 1
    pair = np.unique(np.concatenate([(doc << BUCKET_BITS) | bucket, (owner << BUCKET_BITS) | gram]))
    return pair >> BUCKET_BITS, pair & (2**BUCKET_BITS - 1)


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of each bucket, summed over a task's rows."""
    seen = {False: np.zeros(2**BUCKET_BITS, dtype=np.int64), True: np.zeros(2**BUCKET_BITS, dtype=np.int64)}
    for batch in batches:
        for piece in pieces(batch):
            toxic = piece.column("toxic").to_numpy(zero_copy_only=False).astype(bool)
            doc, bucket = presence(piece.column("text"))
            for side, counts in seen.items():
                counts += np.bincount(bucket[toxic[doc] == side], minlength=len(counts))
    some = np.flatnonzero(seen[False] + seen[True])
    if len(some):
        yield pa.record_batch([pa.array(some), pa.array(seen[True][some]), pa.array(seen[False][some])], names=["bucket", "p", "u"])


def _pick(lookup):
    """The used buckets of each text, numbered from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = lookup.value
        known = index >= 0
        for batch in batches:
            for piece in pieces(batch):
                doc, bucket = presence(piece.column("text"), known)
                offsets = np.searchsorted(doc, np.arange(piece.num_rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(index[bucket]))
                yield pa.record_batch([*(piece.column(c) for c in ("toxic", "h")), lists], names=["toxic", "h", "picked"])

    return run


def train(rows: list[np.ndarray], toxic: np.ndarray, width: int, prior: float, steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights and offset of one linear classifier: Adam on the non-negative risk with logistic loss. ``rows``: features present in each text."""
    row = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    col = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
    n_p, n_u = toxic.sum(), (~toxic).sum()
    w = np.zeros(width + 1)
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        g = np.bincount(row, weights=w[col], minlength=len(rows)) + w[width]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        minus = np.logaddexp(0, g)
        negative = minus[~toxic].mean() - prior * minus[toxic].mean()
        as_negative = np.where(toxic, -prior * s / n_p, s / n_u)  # gradient of the corrected part
        if negative >= 0:
            r = as_negative + np.where(toxic, -prior * (1 - s) / n_p, 0.0)
        else:
            r = np.where(toxic, -prior * (1 - s) / n_p, 0.0)
        grad = np.bincount(col, weights=r[row], minlength=width + 1) + SHRINK * w
        grad[width] = r.sum()
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:width], float(w[width])


def best_offset(margin: np.ndarray, toxic: np.ndarray, prior: float) -> float:
    """The margin to subtract: the cut of the least estimated error, ``c * P(missed) + max(0, U(found) - c * P(found))``, in the
    middle of the gap between margins; of equal cuts the one with the widest gap."""
    order = np.argsort(margin, kind="stable")
    margin, toxic = margin[order], toxic[order]
    missed = np.cumsum(toxic)[:-1] / toxic.sum()
    found = 1 - np.cumsum(~toxic)[:-1] / (~toxic).sum()
    risk = prior * missed + np.maximum(0, found - prior * (1 - missed))
    gap = np.diff(margin)
    risk = np.where(gap > 1e-9, np.round(risk, 12), np.inf)
    if not np.isfinite(risk).any():
        return 0.0
    at = min(np.flatnonzero(risk == risk.min()), key=lambda i: (-gap[i], i))
    return float((margin[at] + margin[at + 1]) / 2)


def _train(prior: float, width: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("toxic", "ascending"), ("h", "ascending")])
        picked = table.column("picked").combine_chunks()
        ends = np.cumsum(picked.value_lengths().to_numpy(zero_copy_only=False))
        rows = np.split(picked.flatten().to_numpy(zero_copy_only=False).astype(np.int64), ends[:-1])
        toxic = table.column("toxic").to_numpy().astype(bool)
        learn = table.column("learn").to_numpy().astype(bool)
        some = [(toxic[part].any() and not toxic[part].all()) for part in (learn, ~learn)]
        if not all(some):
            learn = np.ones(len(rows), dtype=bool)
        w, b = train([r for r, use in zip(rows, learn) if use], toxic[learn], width, prior)
        other = ~learn if all(some) else learn
        b -= best_offset(np.array([w[r].sum() + b for r, use in zip(rows, other) if use]), toxic[other], prior)
        used = np.flatnonzero(w)
        return pa.table({"j": pa.array(np.append(used, width)), "w": pa.array(np.append(w[used], b))})

    return run


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known, offset = model.value
        for batch in batches:
            for piece in pieces(batch):
                doc, bucket = presence(piece.column("text"), known)
                total = np.bincount(doc, weights=weights[bucket], minlength=piece.num_rows)
                score = 1 / (1 + np.exp(-np.clip(total + offset, -500, 500)))
                yield pa.record_batch([piece.column("doc_id"), piece.column("key"), pa.array(score)], names=["doc_id", "key", "score"])

    return run


def held_out(column: str = "doc_id", folds: int = 5):
    """Rows whose labels are never learned from."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string")), F.lit(folds)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, toxic_rows: int = TOXIC_ROWS, text_rows: int = TEXT_ROWS):
    """Bucket weights, which buckets are used, and the offset. ``labels``: ``doc_id, toxic``; held-out rows take no part, neither as labels nor as text."""
    usable = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    usable = usable.filter(~held_out())
    prior = usable.agg(F.avg((F.col("toxic") == 1).cast("double"))).first()[0]
    weights, known = np.zeros(2**BUCKET_BITS), np.zeros(2**BUCKET_BITS, dtype=bool)
    if not prior:
        return weights, known, -4.0
    prior = min(max(CAUTION * prior, 1e-4), 0.9)
    positive = staged(usable.filter("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(toxic_rows).select("doc_id"))
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).filter(~held_out())
    n = rows.count()
    p = rows.join(F.broadcast(positive), "doc_id").select(F.lit(True).alias("toxic"), "h", "text")
    u = rows.select(F.lit(False).alias("toxic"), "h", "text")
    n_p = p.count()
    if not n_p or not n:
        return weights, known, -4.0
    seen = p.unionByName(u).select("toxic", "text").mapInArrow(_frequencies, "bucket long, p long, u long")
    seen = seen.groupBy("bucket").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).filter(F.col("p") + F.col("u") >= LEAST_DOCS)
    rate = (F.col("p") + F.col("u")) / (n_p + n)
    error = F.sqrt(rate * (1 - rate) * (1 / n_p + 1 / n))
    z = F.abs(F.col("p") / n_p - F.col("u") / n) / F.nullif(error, F.lit(0.0))
    chosen = sorted(r[0] for r in seen.filter(z >= LEAST_Z).select("bucket").collect())
    if not chosen:
        return weights, known, -4.0
    index = np.full(2**BUCKET_BITS, -1, dtype=np.int32)
    index[chosen] = np.arange(len(chosen))
    lookup = docs.sparkSession.sparkContext.broadcast(index)
    blocks = -(-n // text_rows)
    each = -(-MODELS // blocks)
    block = F.pmod(F.xxhash64("h", F.lit("block")), F.lit(blocks))
    kind = "toxic boolean, h long, picked array<int>"
    positives = p.mapInArrow(_pick(lookup), kind).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    every = positives.unionByName(u.mapInArrow(_pick(lookup), kind).withColumn("block", block.cast("int")))
    halves = every.withColumn("part", F.explode(F.array(*map(F.lit, range(each))))).withColumn("model", F.col("block") * each + F.col("part"))
    halves = halves.select("model", "toxic", "h", "picked", (F.pmod(F.xxhash64("h", "model"), F.lit(2)) == 0).alias("learn"))
    models = halves.groupBy("model").applyInArrow(_train(prior, len(chosen)), "j long, w double")
    # Summed in Spark: at most one number for each bucket comes to the driver, however many blocks there are.
    total = {j: (w, n) for j, w, n in models.groupBy("j").agg(F.sum("w"), F.count("*")).collect()}
    if not total:
        return weights, known, -4.0
    offset, n_models = total.pop(len(chosen))
    place = np.array(chosen)
    for j, (w, _) in total.items():
        weights[place[j]] = w / n_models
    known[chosen] = True
    return weights, known, offset / n_models


def score(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id, key, score, held_out, predicted`` for each row of ``docs``; ``score`` is from 0 to 1, ``predicted`` is 1 from 0.5 up.

    Learned from at most ``toxic_rows`` toxic labels, chosen by hashes, and all other text in blocks of about ``text_rows``; rows whose id has a CRC-32 of remainder 0
    modulo 5 are not learned from at all. A score depends on the text alone.

    Null and empty texts have no words and get the score of the offset. Null ids are scored, never learned from. Ids labelled twice are toxic if
    any label says so. Rows given twice get equal scores. Without toxic labels or without text every score is that of a rare event. Other columns
    are not read. No rows in, no rows out.
    """
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, **options))
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    found = keyed.mapInArrow(_score(model), "doc_id long, key long, score double")
    return found.select("doc_id", "key", "score", held_out().alias("held_out"), (F.col("score") >= 0.5).cast("int").alias("predicted"))
