"""Attaching lookups to large tables without assuming how large the lookup or its hottest key is."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence
from functools import reduce

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

BROADCAST_BYTES = 64 * 2**20

_held: list[DataFrame] = []


def hold(df: DataFrame) -> DataFrame:
    """Persist a reduced table that is used more than once. A lost block is recomputed from its lineage."""
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    _held.append(df)
    return df


def release() -> None:
    """Drop everything held so far."""
    while _held:
        _held.pop().unpersist()


def checkpoint_folder(spark) -> str:
    """The checkpoint folder the session names; one is made up only in local mode when none is set."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
            folder = tempfile.mkdtemp(prefix="veilgauge-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write a stage's result to the checkpoint folder and go on from there."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def table_values(facts: DataFrame, one_row: DataFrame) -> DataFrame:
    """Add the columns of a one-row aggregate to every row, as an uncorrelated scalar subquery."""
    packed = one_row.select(F.struct(*one_row.columns).alias("v")).scalar()
    return facts.withColumn("__v", packed).select(*facts.columns, *[F.col(f"__v.`{c}`").alias(c) for c in one_row.columns])


def row_bytes(df: DataFrame) -> Column:
    """Bytes of one row as far as values vary in length; complex values count as long as their JSON."""
    parts = []
    for field in df.schema.fields:
        col, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.StringType, T.BinaryType)):
            size = F.octet_length(col)
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.NumericType):
            size = F.greatest(F.size(col), F.lit(0)) * 8
        elif isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            size = F.octet_length(F.to_json(col))
        else:
            size = F.lit(0)
        parts.append(F.coalesce(size, F.lit(0)) + 8)
    return reduce(lambda a, b: a + b, parts, F.lit(16)).cast("bigint")


def attach(facts: DataFrame, lookup: DataFrame, on: Sequence[str], how: str = "left", bound: int | None = None, width: int = 64) -> DataFrame:
    """Join ``lookup`` to ``facts`` on columns of which nulls are equal.

    The lookup is broadcast if its size is known to stay below ``BROADCAST_BYTES``: ``bound`` rows of ``width`` bytes where both are proven,
    otherwise the bytes of its rows, which are summed. Beyond that both sides are shuffled by key once; adaptive execution splits the
    partitions of hot keys on the side of the facts, so no row of the lookup has to be repeated for them beforehand.
    """
    on = list(on)
    if not on:
        return table_values(facts, lookup)
    if bound is None:
        lookup = hold(lookup)
        size = lookup.agg(F.sum(row_bytes(lookup))).first()[0] or 0
    else:
        size = bound * width
    rest = [c for c in lookup.columns if c not in on]
    side = lookup.select(*[F.col(f"`{c}`").alias(f"__on_{i}") for i, c in enumerate(on)], *[F.col(f"`{c}`") for c in rest])
    match = reduce(lambda a, b: a & b, [F.col(f"`{c}`").eqNullSafe(F.col(f"__on_{i}")) for i, c in enumerate(on)])
    joined = facts.join(F.broadcast(side) if size <= BROADCAST_BYTES else side, match, how)
    return joined.drop(*[f"__on_{i}" for i in range(len(on))])
