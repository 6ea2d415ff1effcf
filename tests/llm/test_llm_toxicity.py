"""Parts of the toxicity operator against plain computations."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from veilgauge.llm import textscan, toxicity

BITS = toxicity.BUCKET_BITS


def texts(n=60):
    rng = random.Random(41)
    return ["".join(rng.choice("abcdé,. XYZ_\n-") for _ in range(rng.randrange(0, 60))) for _ in range(n)] + [None, "", "abcd", "ABCDE abcde", "a"]


def plain_presence(text):
    """Buckets of the lower-cased words and of every four bytes of a word."""
    out = set()
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    punctuation = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum() and chr(i) != "_")
    for word in re.split(rf"[\x20\x09-\x0D{re.escape(punctuation)}]+", low):
        if word:
            (h,) = textscan.words_of(pa.array([word])).hashes()
            out.add(int(h) >> (64 - BITS))
            raw = word.encode()
            for i in range(len(raw) - 3):
                code = int.from_bytes(raw[i : i + 4], "little")
                out.add((code * 2654435761 % 2**32) >> (32 - BITS))
    return out


def test_presence_like_plain():
    rows = texts()
    doc, bucket = toxicity.presence(pa.array(rows, pa.string()))
    got = [set(bucket[doc == i].tolist()) for i in range(len(rows))]
    assert got == [plain_presence(t) for t in rows]
    known = np.zeros(2**BITS, dtype=bool)
    known[list(plain_presence(rows[0]) | plain_presence(rows[3]))] = True
    doc, bucket = toxicity.presence(pa.array(rows, pa.string()), known)
    assert [set(bucket[doc == i].tolist()) for i in range(len(rows))] == [{b for b in plain_presence(t) if known[b]} for t in rows]


def test_frequencies_like_plain():
    rows, rng = texts(), random.Random(42)
    toxic = [rng.random() < 0.3 for _ in rows]
    want: dict = {}
    for text, t in zip(rows, toxic):
        for b in plain_presence(text):
            want.setdefault(b, [0, 0])[0 if t else 1] += 1
    batches = [pa.record_batch([pa.array(toxic[a:z]), pa.array(rows[a:z], pa.string())], names=["toxic", "text"]) for a, z in ((0, 30), (30, len(rows)))]
    got = {r["bucket"]: [r["p"], r["u"]] for b in toxicity._frequencies(iter(batches)) for r in b.to_pylist()}
    assert got == want


def plain_train(x, toxic, prior, steps):
    """Adam on the risk written out, with gradients by differences."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)

    def parts(w):
        g = x @ w[:-1] + w[-1]
        plus, minus = np.log1p(np.exp(-g)), np.log1p(np.exp(g))
        return prior * plus[toxic].mean(), minus[~toxic].mean() - prior * minus[toxic].mean()

    def risk(w, with_negative):
        positive, negative = parts(w)
        return positive + negative if with_negative else positive

    for step in range(1, steps + 1):
        on = parts(w)[1] >= 0
        grad = np.array([(risk(w + e, on) - risk(w - e, on)) / 2e-5 for e in np.eye(len(w)) * 1e-5])
        grad[:-1] += toxicity.SHRINK * w[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        w = w - toxicity.RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


@pytest.mark.parametrize("prior", [0.2, 0.7])
def test_training_follows_the_risk(prior):
    rng = np.random.default_rng(43)
    toxic = rng.random(80) < 0.4
    x = (rng.random((80, 6)) < np.where(toxic[:, None], [0.9, 0.7, 0.3, 0.2, 0.5, 0.4], [0.1, 0.3, 0.3, 0.5, 0.5, 0.4])).astype(float)
    w, b = toxicity.train([np.flatnonzero(r) for r in x], toxic, 6, prior, 25)
    want = plain_train(x, toxic, prior, 25)
    assert np.allclose([*w, b], want, atol=2e-3)


def test_offset_like_all_cuts():
    rng = np.random.default_rng(44)
    for _ in range(30):
        n = int(rng.integers(4, 40))
        toxic = rng.random(n) < 0.5
        if toxic.all() or not toxic.any():
            continue
        margin, prior = np.round(rng.normal(size=n) + toxic, 1), float(rng.uniform(0.05, 0.6))
        levels = np.unique(margin)
        best = None
        for low, high in zip(levels, levels[1:]):
            cut = (low + high) / 2
            missed = (margin[toxic] < cut).mean()
            risk = prior * missed + max(0.0, (margin[~toxic] > cut).mean() - prior * (1 - missed))
            rank = (round(risk, 12), -round(high - low, 9))
            if best is None or rank < best[0]:
                best = (rank, cut)
        got = toxicity.best_offset(margin, toxic, prior)
        missed = (margin[toxic] < got).mean()
        risk = prior * missed + max(0.0, (margin[~toxic] > got).mean() - prior * (1 - missed))
        assert round(risk, 9) == round(best[0][0], 9)
