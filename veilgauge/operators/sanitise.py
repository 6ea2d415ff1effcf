"""The sanitising publisher: imputation, capping, binning, rare-label removal, k-anonymity."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import bin_columns
from veilgauge.meta import TableMeta
from veilgauge.operators.counts import label_counts, modes
from veilgauge.operators.joining import attach, durable, hold
from veilgauge.operators.quantiles import quantiles


def impute_values(df: DataFrame, meta: TableMeta, keys: Sequence[str] = ()) -> DataFrame:
    """One row per table with a fill value per column: mode of labels, median of numbers."""
    keys = list(keys)
    kinds = dict(df.dtypes)
    discrete = [c.name for c in meta.discrete]
    numeric = [c.name for c in meta.numeric]
    parts = []
    if numeric:
        parts.append(quantiles(df, numeric, 0.5, keys))
    if discrete:
        numbers = [n for n in discrete if kinds[n] != "string"]
        parts.append(modes(label_counts(df, discrete, keys), discrete, keys, numbers))
    if len(parts) == 1:
        return parts[0]
    return attach(parts[0], parts[1], keys)


def impute(df: DataFrame, meta: TableMeta, keys: Sequence[str] = (), values: DataFrame | None = None) -> DataFrame:
    """Fill nulls per table. ``values`` re-uses fill values taken from another (training) table."""
    # A row per table; written out so that later passes over the filled table do not compute the fills again.
    values = durable(impute_values(df, meta, keys)) if values is None else values
    names = [c.name for c in meta.columns]
    fills = values.select(*keys, *[F.col(f"`{n}`").alias(f"__fill_{i}") for i, n in enumerate(names)])
    kinds = dict(df.dtypes)
    filled = attach(df, fills, keys)
    out = {}
    for i, n in enumerate(names):
        fill = F.col(f"__fill_{i}")
        if not meta[n].numeric:
            out[n] = F.coalesce(F.col(f"`{n}`"), fill.cast(kinds[n]))
        else:
            # Medians of whole numbers may end in .5; the column becomes double so that nothing is lost.
            out[n] = F.coalesce(F.col(f"`{n}`").cast("double"), fill.cast("double"))
    return filled.withColumns(out).select(*df.columns)


def winsorise(df: DataFrame, cols: Sequence[str], max_quantile: float, keys: Sequence[str] = ()) -> DataFrame:
    """Truncate numbers to whole ones, then cap the upper tail at the whole part of a quantile."""
    whole = df.withColumns({c: F.col(f"`{c}`").cast("bigint") for c in cols})
    if max_quantile >= 1 or not cols:
        return whole
    caps = durable(quantiles(whole, cols, max_quantile, keys))
    caps = caps.select(*keys, *[F.col(f"`{c}`").alias(f"__cap_{i}") for i, c in enumerate(cols)])
    capped = attach(whole, caps, keys)
    return capped.withColumns(
        {
            c: F.when(F.col(f"`{c}`") > F.col(f"__cap_{i}"), F.col(f"__cap_{i}").cast("bigint")).otherwise(F.col(f"`{c}`"))
            for i, c in enumerate(cols)
        }
    ).select(*df.columns)


def drop_rare(df: DataFrame, cols: Sequence[str], threshold: int, keys: Sequence[str] = ()) -> DataFrame:
    """Drop rows with any label seen at most ``threshold`` times in its column, counted once on the whole table."""
    if threshold < 1 or not cols:
        return df
    rare = hold(label_counts(df, cols, keys).where((F.col("n") <= threshold) & F.col("label").isNotNull()))
    sizes = {r["attr"]: r["count"] for r in rare.groupBy("attr").count().collect()}
    for c in cols:
        if sizes.get(c):
            hits = rare.where(F.col("attr") == c).select(*keys, F.col("label").alias(c))
            df = attach(df, hits, [*keys, c], "left_anti")
    return df


def k_anonymise(df: DataFrame, quids: Sequence[str], k: int, keys: Sequence[str] = ()) -> DataFrame:
    """Drop rows whose combination of quasi-identifiers occurs fewer than ``k`` times; nulls form groups too.

    Group sizes come from a partial aggregate and only the small groups are joined back, so rows never have to be
    brought together by group and a group with a third of all rows stays where it is.
    """
    if k <= 1 or not quids:
        return df
    by = [*keys, *quids]
    small = df.groupBy(*[F.col(f"`{c}`") for c in by]).agg(F.count("*").alias("__n")).where(F.col("__n") < k).drop("__n")
    return attach(df, small, by, "left_anti")


@dataclass(frozen=True)
class Sanitiser:
    """Parameters of the sanitising publisher, in the order run configurations list them."""

    meta: TableMeta
    nbins: int = 10
    thresh_rare: int = 0
    max_quantile: float = 1
    anonymity_set_size: int = 1
    drop_cols: tuple[str, ...] = ()
    quids: tuple[str, ...] = ()

    generates = False

    @property
    def name(self) -> str:
        return f"SanitiserNHSk{self.anonymity_set_size}"

    @property
    def out_meta(self) -> TableMeta:
        return self.meta.derive([q for q in self.quids or () if q not in (self.drop_cols or ())], self.drop_cols)

    def sanitise(self, df: DataFrame, keys: Sequence[str] = (), row_key: Sequence[str] = ("id",)) -> DataFrame:
        """Sanitised tables with their ids; columns outside the metadata that are neither keys nor ids are dropped."""
        meta = self.out_meta
        meta.check(df.columns)
        keep = [c for c in dict.fromkeys([*keys, *row_key]) if c in df.columns]
        df = df.select(*keep, *[F.col(f"`{n}`") for n in meta.names])
        df = impute(df, meta, keys)
        df = winsorise(df, [c.name for c in meta.numeric], self.max_quantile, keys)
        df = bin_columns(df, meta)
        if self.thresh_rare >= 1:
            df = drop_rare(df, [c.name for c in meta.discrete], self.thresh_rare, keys)
        return k_anonymise(df, [q for q in self.quids or () if q in meta.names], self.anonymity_set_size, keys)
