"""Row encodings that first need values of the whole table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import RANGE_TOL, decode_scaled, scaled_vector
from veilgauge.meta import TableMeta
from veilgauge.operators.joining import attach


def column_ranges(df: DataFrame, meta: TableMeta, keys: Sequence[str] = ()) -> DataFrame:
    """``low_<i>, high_<i>`` of every numeric column, one row per table."""
    aggs = []
    for i, c in enumerate(meta.columns):
        if c.numeric:
            aggs += [F.min(F.col(f"`{c.name}`").cast("double")).alias(f"low_{i}"), F.max(F.col(f"`{c.name}`").cast("double")).alias(f"high_{i}")]
    return df.groupBy(*keys).agg(*aggs)


def _range_columns(meta: TableMeta) -> dict:
    return {c.name: (F.col(f"low_{i}"), F.col(f"high_{i}")) for i, c in enumerate(meta.columns) if c.numeric}


def encode_with_ranges(df: DataFrame, meta: TableMeta, keys: Sequence[str] = (), tol: float = RANGE_TOL) -> DataFrame:
    """Input rows with ``vector``, scaled by the ranges found in their own table, and those ranges."""
    wide = attach(df, column_ranges(df, meta, keys), keys)
    return wide.withColumn("vector", scaled_vector(meta, tol, _range_columns(meta)))


def decode_with_ranges(df: DataFrame, meta: TableMeta, tol: float = RANGE_TOL) -> DataFrame:
    """Undo :func:`encode_with_ranges` for rows that still carry their ranges."""
    return decode_scaled(df, "vector", meta, tol, _range_columns(meta))


def centre(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Subtract the mean of its table from every listed column."""
    means = df.groupBy(*keys).agg(*[F.avg(F.col(f"`{c}`")).alias(f"__mean_{i}") for i, c in enumerate(cols)])
    wide = attach(df, means, keys)
    out = wide.withColumns({c: F.col(f"`{c}`") - F.col(f"__mean_{i}") for i, c in enumerate(cols)})
    return out.drop(*[f"__mean_{i}" for i in range(len(cols))])
