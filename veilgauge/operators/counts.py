"""Label counts of several columns in one pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_counts(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, attr, label, n)`` for all columns, nulls included.

    Rows are unpivoted before the partial aggregate, so only distinct labels per task are shuffled and a label that
    fills most of a column costs no more than any other.
    """
    pairs = F.array(*[F.struct(F.lit(c).alias("attr"), F.col(f"`{c}`").cast("string").alias("label")) for c in cols])
    return df.select(*keys, F.explode(pairs).alias("__p")).groupBy(
        *keys, F.col("__p.attr").alias("attr"), F.col("__p.label").alias("label")
    ).agg(F.count("*").alias("n"))


def modes(counts: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), numbers: Sequence[str] = ()) -> DataFrame:
    """One row per table: most frequent label of each column, the smallest one on ties.

    Columns listed in ``numbers`` compare tied labels as numbers.
    """
    as_number = F.when(F.col("attr").isin(list(numbers)), F.expr("try_cast(label as double)"))
    best = counts.where(F.col("label").isNotNull()).groupBy(*keys, "attr").agg(
        F.min_by("label", F.struct(-F.col("n"), as_number, F.col("label"))).alias("label")
    )
    return best.groupBy(*keys).agg(*[F.max(F.when(F.col("attr") == c, F.col("label"))).alias(c) for c in cols])
