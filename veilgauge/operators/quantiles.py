"""Exact quantiles with linear interpolation, per table, by one path for every size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.operators.joining import attach, durable, row_bytes

BUCKETS = 65_536
STEPS = 15  # buckets for each power of two
LEVELS = 4
RANK_ROWS = 100_000


def quantiles(df: DataFrame, cols: Sequence[str], q: float, keys: Sequence[str] = ()) -> DataFrame:
    """One row per table with the ``q`` quantile of each column; nulls are ignored, a column of nulls gives null."""
    keys = list(keys)
    rows = quantile_rows(df, cols, [q], keys)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("__c") == i, F.col("__v"))).alias(c) for i, c in enumerate(cols)])


def spread(df: DataFrame, col: str, levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """One row per table with several quantiles of one column, named ``q0, q1, …``."""
    keys = list(keys)
    rows = quantile_rows(df, [col], levels, keys)
    return rows.groupBy(*keys).agg(*[F.max(F.when(F.col("__j") == j, F.col("__v"))).alias(f"q{j}") for j in range(len(levels))])


def _magnitude(x: Column) -> Column:
    """A bucket number that grows with the value, ``STEPS`` to a power of two, whatever the spread of the values."""
    size = F.abs(x)
    step = F.floor((F.log2(size) + 1075) * STEPS) + 1
    top = F.lit(2100 * STEPS)
    bucket = F.when(size == 0, F.lit(0)).when(F.isnan(x) | (size == float("inf")), top).otherwise(step)
    return F.when(F.isnan(x), top + 1).when(x < 0, -bucket).otherwise(bucket).cast("bigint")


def quantile_rows(df: DataFrame, cols: Sequence[str], levels: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """``keys, __c, __j, __v``: quantile ``levels[j]`` of column ``cols[c]`` for every table, null where it has no values.

    One pass counts buckets of the values' magnitude, which are known beforehand and fine enough for any spread. The
    bucket that holds a wanted rank is the bracket; its rows alone are reduced to distinct values and ranked. A bracket of more than
    ``RANK_ROWS`` rows that are not all equal is first divided into ``BUCKETS`` equal widths, again and again, until it is small or one
    value: each division leaves 16 bits less of a double. Counts are partial aggregates, so no column is ever brought
    together.
    """
    keys = list(keys)
    by = [*keys, "__c"]
    cells = F.array(*[F.struct(F.lit(i).alias("c"), F.col(f"`{c}`").cast("double").alias("x")) for i, c in enumerate(cols)])
    values = df.select(*keys, F.explode(cells).alias("__e")).select(*keys, F.col("__e.c").alias("__c"), F.col("__e.x").alias("__x"))
    asks = F.array(*[F.struct(F.lit(j).alias("j"), F.lit(float(q)).alias("q")) for j, q in enumerate(levels)])
    measure = [F.count("__x").alias("__k"), F.min("__x").alias("__lo"), F.max("__x").alias("__hi")]

    # Nulls have a bucket of their own with a count of 0, which keeps tables that have nothing else.
    counts = values.groupBy(*by, _magnitude(F.col("__x")).alias("__b")).agg(*measure)
    order = Window.partitionBy(*by).orderBy(F.col("__b").asc_nulls_first())
    ranked = counts.withColumns(
        {
            "__cum": F.sum("__k").over(order.rowsBetween(Window.unboundedPreceding, 0)),
            "__n": F.sum("__k").over(Window.partitionBy(*by)),
            "__next": F.lead("__lo").over(order),
        }
    )
    ranked = ranked.withColumn("__a", F.explode(asks)).withColumn("__pos", F.col("__a.q") * (F.col("__n") - 1))
    ranked = ranked.withColumn("__r", F.floor("__pos"))
    here = (F.col("__cum") > F.col("__r")) & (F.col("__cum") - F.col("__k") <= F.col("__r")) & (F.col("__k") > 0)
    names = [*by, "__j", "__pos", "__r", "__below", "__k", "__lo", "__hi", "__next"]
    state = ranked.where(here | (F.col("__n") == 0)).withColumns({"__j": F.col("__a.j"), "__below": F.col("__cum") - F.col("__k")})
    state = durable(state.select(*names))

    for _ in range(LEVELS):
        wide = (F.col("__k") > RANK_ROWS) & (F.col("__lo") < F.col("__hi"))
        # The brackets are a few numbers per table, column and level; their size is measured once for all joins below.
        size, open_ = state.agg(F.sum(row_bytes(state)), F.count_if(wide)).first()
        if not open_:
            break
        brackets = state.where(wide)
        width = (F.col("__x") - F.col("__from")) / (F.col("__to") - F.col("__from"))
        ends = brackets.select(*by, "__j", F.col("__lo").alias("__from"), F.col("__hi").alias("__to"))
        inside = attach(values, ends, by, "inner", size, 1).where(F.col("__x").between(F.col("__from"), F.col("__to")))
        parts = inside.groupBy(*by, "__j", F.floor(width * BUCKETS).alias("__b")).agg(*measure)
        order = Window.partitionBy(*by, "__j").orderBy("__b")
        parts = parts.withColumns({"__run": F.sum("__k").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead("__lo").over(order)})
        old = brackets.select(*by, "__j", "__pos", "__r", "__below", F.col("__next").alias("__beyond"))
        parts = attach(parts, old, [*by, "__j"], "inner", size, 1)
        parts = parts.withColumns({"__below": F.col("__below") + F.col("__run") - F.col("__k"), "__next": F.coalesce("__after", "__beyond")})
        found = parts.where((F.col("__below") <= F.col("__r")) & (F.col("__below") + F.col("__k") > F.col("__r")))
        state = durable(state.where(~F.coalesce(wide, F.lit(False))).unionByName(found.select(*names)))

    size = state.agg(F.sum(row_bytes(state))).first()[0] if open_ else size
    size = size or 0
    ends = state.where(F.col("__k") > 0).select(*by, "__j", "__r", "__below", "__next", F.col("__lo").alias("__from"), F.col("__hi").alias("__to"))
    inside = attach(values, ends.select(*by, "__j", "__from", "__to"), by, "inner", size, 1)
    inside = inside.where(F.col("__x").between(F.col("__from"), F.col("__to")))
    distinct = inside.groupBy(*by, "__j", "__x").agg(F.count("*").alias("__m"))
    order = Window.partitionBy(*by, "__j").orderBy("__x")
    distinct = distinct.withColumns({"__run": F.sum("__m").over(order.rowsBetween(Window.unboundedPreceding, 0)), "__after": F.lead("__x").over(order)})
    distinct = attach(distinct, ends.select(*by, "__j", "__r", "__below", "__next"), [*by, "__j"], "inner", size, 1)
    upto = F.col("__below") + F.col("__run")
    hit = distinct.where((upto > F.col("__r")) & (upto - F.col("__m") <= F.col("__r")))
    second = F.when(upto > F.col("__r") + 1, F.col("__x")).otherwise(F.coalesce("__after", "__next"))
    pairs = hit.select(*by, "__j", F.col("__x").alias("__one"), second.alias("__two"))
    both = attach(state.select(*by, "__j", "__pos", "__r"), pairs, [*by, "__j"], "left", size, 1)
    between = (F.col("__r") + 1 - F.col("__pos")) * F.col("__one") + (F.col("__pos") - F.col("__r")) * F.col("__two")
    exact = (F.col("__pos") == F.col("__r")) | (F.col("__one") == F.col("__two"))
    return both.select(*by, "__j", F.when(exact, F.col("__one")).otherwise(between).alias("__v"))
