"""Linking target records to published tables by a unique combination of labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.operators.joining import attach


def _groups(published: DataFrame, targets: DataFrame, on: Sequence[str], keys: Sequence[str], extra: Sequence = ()) -> DataFrame:
    """Sizes of the published combinations that some target has.

    Published rows that match no target are dropped where they are, and counting is partial per task, so a combination
    with many rows is never brought together.
    """
    wanted = targets.select(*[F.col(f"`{c}`") for c in on]).distinct()
    hits = attach(published, wanted, on, "left_semi")
    return hits.groupBy(*keys, *[F.col(f"`{c}`") for c in on]).agg(F.count("*").alias("group_size"), *extra)


def link_members(published: DataFrame, targets: DataFrame, on: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Targets with ``group_size`` and ``linked``: 1 where exactly one published row has the target's labels, else null.

    With ``keys`` the targets frame carries them too: one row per target and table to judge.
    """
    out = attach(targets, _groups(published, targets, on, keys), [*keys, *on])
    size = F.coalesce("group_size", F.lit(0))
    return out.withColumn("group_size", size).withColumn("linked", F.when(size == 1, 1))


def link_attribute(published: DataFrame, targets: DataFrame, on: Sequence[str], sensitive: str, keys: Sequence[str] = ()) -> DataFrame:
    """Targets with the sensitive value of the one published row that has their known labels, null when not unique."""
    value = F.max(F.col(f"`{sensitive}`")).alias("__value")
    out = attach(targets, _groups(published, targets, on, keys, [value]), [*keys, *on])
    size = F.coalesce("group_size", F.lit(0))
    return out.withColumn("group_size", size).withColumn("linked", F.when(size == 1, F.col("__value"))).drop("__value")
