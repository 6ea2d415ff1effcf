"""Quality rules as a ledger: every rule is evaluated once, its outcome kept as a bit, and policies are masks over the bits.

One scan measures each text and writes a ledger row: the measurements and ``failures``, in which bit *i* says that rule *i* fails.
A policy is a version with the rules it enforces; applying another version, or asking what a rule adds to a version, reads the ledger and never a text.

Ablations come from bitwise aggregates over the distinct failure patterns, of which there are at most two to the power of the number of
rules, so a policy with any number of rules is taken apart by one partial aggregate of the ledger.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import text_key
from veilgauge.llm.textscan import SPACED, hash_spans, pieces, windows, words_of

REPEAT_WINDOW = 5
MEASURES = ("n_words", "word_chars", "n_upper", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
LEDGER = "doc_id long, key long, " + ", ".join(f"{m} long" for m in MEASURES)

# Rules in bit order, as conditions of failure over the measurements. A published rule keeps its number for good; new ones go to the end.
RULES: dict[str, str] = {
    "few_words": "n_words < 10",
    "repeated_runs": "100 * n_repeat_words > 20 * n_words",
    "short_words": "word_chars < 3 * n_words",
    "long_words": "word_chars > 10 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "shouting": "100 * n_upper > 30 * word_chars",
    "repeated_lines": "n_dup_lines > 2 and 100 * n_dup_lines > 30 * n_lines",
}
BASE = ("few_words", "repeated_runs")
POLICIES: dict[str, tuple[str, ...]] = {
    "base": BASE,
    "v1": (*BASE, "short_words", "long_words", "symbols"),
    "v2": tuple(RULES),
}
CURRENT = "v2"

_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return upto[offsets[1:]] - upto[offsets[:-1]]


def _grouped(owner: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by owner and value, and where a new pair begins in it. There are few owners."""
    order = np.argsort(value)
    order = order[np.argsort(owner[order].astype(np.uint16), kind="stable")]
    o, v = owner[order], value[order]
    return order, np.concatenate([np.ones(min(len(o), 1), dtype=bool), (o[1:] != o[:-1]) | (v[1:] != v[:-1])])


def _lines(words) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word and repeated ones among them, for each text."""
    data, offsets, n = words.data, words.offsets, len(words.offsets) - 1
    breaks = np.flatnonzero(data == 10)
    inner = offsets[1:-1]
    begin = np.sort(np.concatenate([offsets[:1], breaks + 1, inner]))
    stop = np.sort(np.concatenate([breaks, inner, offsets[-1:]]))
    # Where texts meet, lines of no length may appear twice; they have no word.
    some = np.searchsorted(words.start, begin) < np.searchsorted(words.start, stop)
    begin, stop = begin[some], stop[some]
    owner = np.searchsorted(offsets, begin, side="right") - 1
    _, new = _grouped(owner, hash_spans(data, begin, stop, False))
    total = np.bincount(owner, minlength=n)
    order_owner = np.sort(owner)
    return total, total - np.bincount(order_owner[new], minlength=n)


def _repeats(words) -> np.ndarray:
    """Words inside runs of ``REPEAT_WINDOW`` words that the same text holds twice or more, for each text."""
    at, value = windows(words, words.hashes(), REPEAT_WINDOW)
    total = int(words.first[-1])
    if not len(at):
        return np.zeros(len(words.first) - 1, dtype=np.int64)
    order, new = _grouped(words.doc[at], value)
    group = np.cumsum(new) - 1
    twice = at[order[np.bincount(group)[group] > 1]]
    edges = np.bincount(twice, minlength=total + 1) - np.bincount(twice + REPEAT_WINDOW, minlength=total + 1)
    return _per_text(np.cumsum(edges)[:total] > 0, words.first)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            words = words_of(piece.column("text"))
            data, offsets = words.data, words.offsets
            lines, repeated = _lines(words)
            found = [
                words.counts,
                _per_text(((data & 0xC0) != 0x80) & (SPACED[data] != 0), offsets),
                _per_text((data >= 65) & (data <= 90), offsets),
                _per_text(_SYMBOL[data], offsets),
                lines,
                repeated,
                _repeats(words),
            ]
            rest = [piece.column(c) for c in ("doc_id", "key")]
            yield pa.record_batch([*rest, *(pa.array(f.astype(np.int64)) for f in found)], names=["doc_id", "key", *MEASURES])


def bits(rules: Sequence[str], known: Mapping[str, str] = RULES) -> int:
    """The mask of some rules."""
    names = list(known)
    return sum(1 << names.index(r) for r in rules)


def ledger(docs: DataFrame, rules: Mapping[str, str] = RULES) -> DataFrame:
    """``doc_id, key``, the measurements and ``failures`` for each row of ``docs``; ``rules`` are SQL conditions of failure, at most 63.

    Words are runs of anything but white space, characters are code points. ``n_lines`` and ``n_dup_lines`` count lines that hold a word,
    and those of them that are equal to an earlier one; ``n_repeat_words`` counts words in runs of five that the text holds twice or more.

    Null and empty texts have no words: every measurement is 0. Null ids and rows given twice are rows like others. Other columns are
    not read. No rows in, no rows out.
    """
    if len(rules) > 63:
        raise ValueError("a ledger has room for 63 rules")
    measured = docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(_measure, LEDGER)
    failed = F.lit(0).cast("long")
    for i, condition in enumerate(rules.values()):
        failed = failed.bitwiseOR(F.when(F.expr(condition), F.lit(1 << i)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("failures", failed)


def enforce(rows: DataFrame, policy: Sequence[str], rules: Mapping[str, str] = RULES) -> Column:
    """Whether a ledger row passes a policy."""
    return rows["failures"].bitwiseAND(F.lit(bits(policy, rules)).cast("long")) == 0


def ablations(rows: DataFrame, policies: Mapping[str, Sequence[str]] = POLICIES, rules: Mapping[str, str] = RULES) -> DataFrame:
    """``policy, rule, n_docs, n_kept, n_fails, n_only, n_kept_without, implies``: what each rule adds to each policy.

    ``n_only`` documents fail this rule and no other of the policy, so ``n_kept_without`` would be kept without it. ``implies`` is the mask
    of the policy's other rules that every document failing this one fails too (0 if no document does): a rule implied by none of the
    others and with ``n_only`` 0 is covered by them together. Without documents the counts are 0.
    """
    patterns = rows.groupBy("failures").agg(F.count("*").alias("n"))
    cells = []
    for version, names in policies.items():
        mask = bits(names, rules)
        for name in names:
            bit = bits([name], rules)
            got = F.col("failures").bitwiseAND(F.lit(mask).cast("long"))
            hit = F.col("failures").bitwiseAND(F.lit(bit).cast("long")) != 0
            kept = F.sum(F.when(got == 0, F.col("n")).otherwise(0))
            only = F.sum(F.when(got == bit, F.col("n")).otherwise(0))
            cells.append(
                F.struct(
                    F.lit(version).alias("policy"), F.lit(name).alias("rule"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_docs"),
                    F.coalesce(kept, F.lit(0)).alias("n_kept"), F.coalesce(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.lit(0)).alias("n_fails"),
                    F.coalesce(only, F.lit(0)).alias("n_only"), F.coalesce(kept + only, F.lit(0)).alias("n_kept_without"),
                    F.coalesce(F.bit_and(F.when(hit, got)).bitwiseAND(F.lit(~bit).cast("long")), F.lit(0)).alias("implies"),
                )
            )
    return patterns.agg(F.array(*cells).alias("cells")).select(F.explode("cells").alias("c")).select("c.*")


def verdicts(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The ledger of ``docs`` with ``base_failed`` (policy ``base``), ``kept`` (not ``base_failed``, and passed by ``policy``) and ``policy``."""
    rows = ledger(docs)
    passed = enforce(rows, BASE)
    return rows.withColumns({"base_failed": ~passed, "kept": passed & enforce(rows, POLICIES[policy]), "policy": F.lit(policy)})


def keep(docs: DataFrame, policy: str = CURRENT) -> DataFrame:
    """The rows of ``docs`` that a policy keeps, with all their columns."""
    gone = verdicts(docs, policy).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_key() == gone["__key"]), "left_anti")
