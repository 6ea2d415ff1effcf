"""Frames of rows to be generated, keyed by table, copy and row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgauge.functions.keyed import digest
from veilgauge.operators.joining import attach, hold

ROWS_PER_TASK = 4_000_000


def row_frame(spark: SparkSession, n: int, copies: int = 1, tables: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, copy, row`` for ``copies`` tables of ``n`` rows per fitted table.

    Rows come from a range that is already split over tasks, never from exploding one row per table.
    """
    keys = list(keys)
    per_table = n * copies
    count = 1
    if keys:
        listed = hold(tables.select(*keys).distinct())
        count = listed.count()
    total = per_table * count
    parts = max(spark.sparkContext.defaultParallelism, -(-total // ROWS_PER_TASK))
    frame = spark.range(0, total, 1, parts)
    frame = frame.select(
        F.floor(F.col("id") / per_table).alias("__table"),
        F.floor(F.pmod("id", F.lit(per_table)) / n).cast("int").alias("copy"),
        F.pmod("id", F.lit(n)).alias("row"),
    )
    if keys:
        numbered = listed.withColumn("__table", (F.row_number().over(Window.orderBy(*keys)) - 1).cast("bigint"))
        frame = attach(frame, numbered, ["__table"], "inner", bound=count)
    return frame.select(*keys, "copy", "row")


def cell_digest(seed: int, tag: str, keys: Sequence[str], what: Column | str) -> Column:
    part = F.lit(what) if isinstance(what, str) else what
    return digest(seed, tag, *keys, "copy", "row", part)


def value_in_bin(edges: Column, b: Column, u: Column, integer: bool) -> Column:
    """A number drawn uniformly between the edges of a bin; whole numbers are rounded half to even."""
    lo = F.element_at(edges, b + 1)
    hi = F.element_at(edges, b + 2)
    x = lo + u * (hi - lo)
    return F.bround(x).cast("bigint") if integer else x


def key_value(n: int, kind: str, low: float = 0.0, high: float = 1.0, prefix: str = "", number: str = "id") -> Column:
    """Key value of one of ``n`` numbered rows: whole numbers from 0, even steps from ``low`` below ``high``, or a prefix and a number."""
    i = F.col(number)
    values = {
        "Integer": i,
        "Float": F.lit(float(low)) + i * F.lit((high - low) / max(n, 1)),
        "Categorical": F.concat(F.lit(prefix), i.cast("string")),
    }
    if kind not in values:
        raise ValueError(f"unknown kind {kind!r}")
    return values[kind]


def candidate_keys(spark: SparkSession, n: int, kind: str, low: float = 0.0, high: float = 1.0, prefix: str = "") -> DataFrame:
    """``n`` different key values (:func:`key_value`)."""
    return spark.range(n).select(F.col("id").alias("row"), key_value(n, kind, low, high, prefix).alias("key"))
