"""Mutual information between binned columns."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.functions.encoding import literal_array
from veilgauge.operators.distributions import weight, weighted


HELD_CELLS = 2**21


def _score(joint: DataFrame, by: Sequence[str]) -> DataFrame:
    """MI in nats and both entropies from joint counts ``x, y, n`` within ``by``."""
    # The joint table is already reduced to the domain, so windows over it are small.
    j = joint.withColumns(
        {
            "nx": F.sum("n").over(Window.partitionBy(*by, "x")),
            "ny": F.sum("n").over(Window.partitionBy(*by, "y")),
            "nn": F.sum("n").over(Window.partitionBy(*by)),
        }
    )
    p = F.col("n") / F.col("nn")
    return j.groupBy(*by).agg(
        F.sum(p * F.ln(F.col("n") * F.col("nn") / (F.col("nx") * F.col("ny")).cast("double"))).alias("mi"),
        (-F.sum(p * F.ln(F.col("nx") / F.col("nn")))).alias("hx"),
        (-F.sum(p * F.ln(F.col("ny") / F.col("nn")))).alias("hy"),
    )


def _pair_counts(d: int, radix: int):
    """Counts ``__c, n`` of the cells of all column pairs over a task's rows; the cells of all pairs are held at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros((d * d, radix * radix), dtype=np.int64)
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            codes = np.ascontiguousarray(batch.column("bins").flatten().fill_null(-1).to_numpy(zero_copy_only=False).reshape(rows, d).T).astype(np.int64)
            times = batch.column("n").to_numpy(zero_copy_only=False)
            known = codes >= 0
            full, once = known.all(axis=1), bool((times == 1).all())
            for i in range(d):
                high = codes[i] * radix
                for j in range(i + 1, d):
                    cell, n = high + codes[j], times
                    if not (full[i] and full[j]):
                        both = known[i] & known[j]
                        cell, n = cell[both], n[both]
                    held[i * d + j] += np.bincount(cell, minlength=radix * radix) if once else np.bincount(cell, n, radix * radix).astype(np.int64)
        flat = held.ravel()
        found = np.flatnonzero(flat)
        if len(found):
            yield pa.record_batch([pa.array(found), pa.array(flat[found])], names=["__c", "n"])

    return run


def pair_information(coded: DataFrame, d: int, radix: int, keys: Sequence[str] = ()) -> DataFrame:
    """``(i, j, mi, hx, hy)`` for all column pairs ``i < j`` of a ``bins`` array, in one job.

    A table without keys whose pairs have few cells is counted by its tasks, which emit a number for each cell that occurs. Otherwise a row (or counted row, see ``Binning.compact``)
    contributes one packed number per column pair to the partial aggregate. Nothing is joined.
    """
    if not keys and d * d * radix * radix <= HELD_CELLS:
        rows = coded.where("bins is not null").select("bins", *(weighted(coded) or [F.lit(1).cast("bigint").alias("n")]))
        counts = rows.mapInArrow(_pair_counts(d, radix), "__c long, n long").groupBy("__c").agg(F.sum("n").alias("n"))
        return _pair_scores(counts, d, radix, [])
    # A missing code becomes so negative that every pair with it is negative too; no null checks per pair are compiled.
    missing = -(2**50)
    flat = coded.select(
        *keys, *weighted(coded),
        *[F.coalesce(F.element_at("bins", i + 1).cast("bigint"), F.lit(missing)).alias(f"b{i}") for i in range(d)],
    )
    packed = [
        F.lit((i * d + j) * radix * radix) + F.col(f"b{i}") * radix + F.col(f"b{j}")
        for i in range(d) for j in range(i + 1, d)
    ]
    counts = flat.select(*keys, *weighted(coded), F.explode(F.array(*packed)).alias("__c")).where("__c >= 0")
    return _pair_scores(counts.groupBy(*keys, "__c").agg(weight(coded).alias("n")), d, radix, keys)


def _pair_scores(counts: DataFrame, d: int, radix: int, keys: Sequence[str]) -> DataFrame:
    pair = F.floor(F.col("__c") / (radix * radix))
    joint = counts.select(
        *keys,
        F.floor(pair / d).cast("int").alias("i"),
        (pair % d).cast("int").alias("j"),
        (F.floor(F.col("__c") / radix) % radix).alias("x"),
        (F.col("__c") % radix).alias("y"),
        "n",
    )
    return _score(joint, [*keys, "i", "j"])


def normalised(pairs: DataFrame) -> DataFrame:
    """Add ``nmi``, MI over the mean entropy; two constant columns have 1."""
    both = F.col("hx") + F.col("hy")
    return pairs.withColumn("nmi", F.when(both > 0, 2 * F.col("mi") / both).otherwise(1.0))


def candidate_information(coded: DataFrame, sizes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """``(child, parents, mi)`` for rows that carry ``cands``, an array of ``(child, parents)`` to score; ``sizes`` are the columns' domain sizes."""
    one = coded.select(*keys, "bins", *weighted(coded), F.explode("cands").alias("__cand"))
    codes = F.transform("__cand.parents", lambda p: F.element_at("bins", p + 1))
    known = ~F.exists(codes, lambda c: c.isNull()) & F.expr("element_at(bins, __cand.child + 1) is not null")
    joint = one.where(known).select(
        *keys, F.col("__cand.child").alias("child"), F.col("__cand.parents").alias("parents"), codes.alias("x"),
        F.expr("element_at(bins, __cand.child + 1)").alias("y"), *weighted(coded),
    )
    if math.prod(sorted(sizes)) < 2**62:
        # Any set of columns has a number in the mixed base of their sizes; it is shorter than the list of codes.
        base = literal_array(sizes)
        pairs = F.arrays_zip(F.col("parents").alias("p"), F.col("x").alias("c"))
        joint = joint.withColumn("x", F.aggregate(pairs, F.lit(0).cast("bigint"), lambda acc, e: acc * F.element_at(base, e["p"] + 1) + e["c"]))
    joint = joint.groupBy(*keys, "child", "parents", "x", "y").agg(weight(coded).alias("n"))
    return _score(joint, [*keys, "child", "parents"]).drop("hx", "hy")
