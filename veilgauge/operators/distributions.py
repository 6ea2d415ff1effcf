"""Binned codes, profiles, frequency tables and probability helpers, for many tables at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.functions.encoding import bin_by_array, bin_position, edge_array, literal_array
from veilgauge.meta import INTEGER, NULL_LABEL, TableMeta
from veilgauge.operators.joining import attach

CELL_BLOCK = 65_536
COMPACT_CELLS = 2_000_000


@dataclass(frozen=True)
class Binning:
    """How the columns of a table become small integers: equal-width bins for numbers, positions for labels."""

    meta: TableMeta
    bins: int = 10
    infer_ranges: bool = False

    @property
    def sizes(self) -> list[int]:
        return [c.domain_size(self.bins) for c in self.meta.columns]

    @property
    def radix(self) -> int:
        return max(self.sizes)

    def ranges(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Edges per numeric column taken from the data itself, one row per table."""
        spans = df.groupBy(*keys).agg(
            *[f(F.col(f"`{c.name}`").cast("double")).alias(f"__{n}_{i}") for i, c in enumerate(self.meta.columns) if c.numeric
              for n, f in (("lo", F.min), ("hi", F.max))]
        )
        return spans.select(
            *keys,
            *[
                edge_array(F.col(f"__lo_{i}"), F.col(f"__hi_{i}"), self.bins, c.kind == INTEGER).alias(f"__edges_{i}")
                for i, c in enumerate(self.meta.columns) if c.numeric
            ],
        )

    def edges(self, i: int) -> Column:
        """Edges of column ``i``: an attached array when ranges are inferred, otherwise a literal."""
        if self.infer_ranges:
            return F.col(f"__edges_{i}")
        return literal_array([float(e) for e in self.meta.columns[i].edges(self.bins)])

    def code(self, i: int, clip: bool = True) -> Column:
        """Code of a value, null for nulls and values outside the domain.

        With ``clip`` a number above its range belongs to the last bin, as in the codes networks are built on; without,
        it is outside, as in distributions.
        """
        c = self.meta.columns[i]
        col = F.col(f"`{c.name}`")
        if not c.numeric:
            found = F.array_position(literal_array(c.labels), F.coalesce(col, F.lit(NULL_LABEL)) if NULL_LABEL in c.labels else col)
            known = F.coalesce(col, F.lit(NULL_LABEL)).isin(list(c.labels))
            return F.when(known, (found - 1).cast("int"))
        if self.infer_ranges:
            return bin_by_array(col.cast("double"), self.edges(i))
        inside = col >= F.lit(c.low)
        return F.when(inside if clip else inside & (col <= F.lit(c.high)), bin_position(col, c, self.bins))

    def encode(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """``keys`` plus ``bins``, an array of codes in metadata order; null marks values outside every bin."""
        self.meta.check(df.columns)
        if self.infer_ranges:
            df = attach(df, self.ranges(df, keys), keys)
        return df.select(*keys, F.array(*[self.code(i) for i in range(len(self.meta))]).alias("bins"))

    @property
    def cells(self) -> int:
        total = 1
        for s in self.sizes:
            total *= s + 1
        return total

    def compact(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """:meth:`encode` with a weight ``n``: equal rows are counted first when the domain bounds how many there can be.

        The product of the domain sizes, known from the metadata, limits the distinct rows of a table. When that is small
        everything later works on the counted rows instead of the data.
        """
        if self.cells > COMPACT_CELLS:
            return self.encode(df, keys).withColumn("n", F.lit(1).cast("bigint"))
        self.meta.check(df.columns)
        if self.infer_ranges:
            df = attach(df, self.ranges(df, keys), keys)
        names = [f"__b{i}" for i in range(len(self.meta))]
        flat = df.select(*keys, *[self.code(i).alias(n) for i, n in enumerate(names)])
        counts = flat.groupBy(*keys, *names).agg(F.count("*").alias("n"))
        return counts.select(*keys, F.array(*names).alias("bins"), "n")


def weight(coded: DataFrame) -> Column:
    """Number of data rows behind coded rows."""
    return F.sum("n") if "n" in coded.columns else F.count("*")


def weighted(coded: DataFrame) -> list[str]:
    return ["n"] if "n" in coded.columns else []


def cell_counts(df: DataFrame, binning: Binning, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, __cell, __n``: how often each cell of each column is hit, for all columns in one pass; a table contributes at most its domain sizes to
    the shuffle. Such counts add up: those of a table with one more record are its own and the record's."""
    keys = list(keys)
    meta = binning.meta
    meta.check(df.columns)
    radix = max(binning.sizes) + 2
    source = attach(df, binning.ranges(df, keys), keys) if binning.infer_ranges else df
    cells = []
    for i in range(len(meta)):
        col = F.col(f"`{meta.columns[i].name}`")
        other = F.when(col.isNull(), F.lit(radix - 1)).otherwise(F.lit(radix - 2))
        cell = F.coalesce(binning.code(i, clip=False), other)
        cells.append((cell + F.lit(i * radix)).cast("int"))
    return source.select(*keys, F.explode(F.array(*cells)).alias("__cell")).groupBy(*keys, "__cell").agg(F.count("*").alias("__n"))


def profile(df: DataFrame, binning: Binning, keys: Sequence[str] = ()) -> DataFrame:
    """One row per table and column: ``counts, probs, cdf`` over the whole domain, edges or labels, missing share."""
    ranges = binning.ranges(df, keys) if binning.infer_ranges else None
    return profile_of_counts(cell_counts(df, binning, keys), binning, keys, ranges)


def profile_of_counts(counts: DataFrame, binning: Binning, keys: Sequence[str] = (), ranges: DataFrame | None = None) -> DataFrame:
    """:func:`profile` from :func:`cell_counts`."""
    keys = list(keys)
    meta, sizes = binning.meta, binning.sizes
    radix = max(sizes) + 2
    per_table = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("__cell", "__n"))).alias("__m"))
    if ranges is not None:
        per_table = attach(per_table, ranges, keys)
    attrs = []
    for i, c in enumerate(meta.columns):
        attrs.append(
            F.struct(
                F.lit(i).alias("attr_idx"),
                F.lit(c.name).alias("attr"),
                F.lit(c.numeric).alias("numeric"),
                F.lit(sizes[i]).alias("size"),
                (binning.edges(i) if c.numeric else F.lit(None).cast("array<double>")).alias("edges"),
                (F.lit(None).cast("array<string>") if c.numeric else literal_array(c.labels)).alias("labels"),
            )
        )
    wide = per_table.select(*keys, "__m", F.explode(F.array(*attrs)).alias("a")).select(*keys, "__m", "a.*")

    def cell(b: Column) -> Column:
        return F.coalesce(F.try_element_at("__m", F.col("attr_idx") * radix + b), F.lit(0).cast("bigint"))

    wide = wide.withColumn("counts", F.transform(F.sequence(F.lit(0), F.col("size") - 1), cell))
    wide = wide.withColumn("nulls", cell(F.lit(radix - 1))).withColumn("outside", cell(F.lit(radix - 2)))
    return with_probabilities(wide.drop("__m")).withColumn(
        "missing_rate", F.col("nulls") / (F.col("total") + F.col("nulls") + F.col("outside"))
    )


def with_probabilities(df: DataFrame) -> DataFrame:
    """Add ``total, probs, cdf`` for an array column ``counts``; an empty distribution becomes uniform."""
    n = F.size("counts")
    df = df.withColumn("total", F.aggregate("counts", F.lit(0).cast(_element(df, "counts")), lambda a, x: a + x))
    df = df.withColumn(
        "cum",
        F.transform(
            F.sequence(F.lit(1), n),
            lambda i: F.aggregate(F.slice("counts", F.lit(1), i), F.lit(0).cast(_element(df, "counts")), lambda a, x: a + x),
        ),
    )
    empty = F.col("total") <= 0
    probs = F.when(empty, F.transform("counts", lambda x: F.lit(1.0) / n)).otherwise(
        F.transform("counts", lambda x: x / F.col("total"))
    )
    cdf = F.when(empty, F.transform(F.sequence(F.lit(1), n), lambda i: i / n)).otherwise(
        F.transform("cum", lambda x: x / F.col("total"))
    )
    return df.withColumns({"probs": probs, "cdf": cdf}).drop("cum")


def _element(df: DataFrame, col: str) -> str:
    return df.schema[col].dataType.elementType.simpleString()


def profile_cells(prof: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """The profile as one row per bin: ``attr, bin, lo, hi, label, n, prob, cdf``."""
    long = prof.select(*keys, "attr", "edges", "labels", "cdf", "probs", F.posexplode("counts").alias("bin", "n"))
    at = F.col("bin") + 1
    return long.select(
        *keys, "attr", "bin",
        F.try_element_at("edges", at).alias("lo"),
        F.try_element_at("edges", at + 1).alias("hi"),
        F.try_element_at("labels", at).alias("label"),
        "n",
        F.element_at("probs", at).alias("prob"),
        F.element_at("cdf", at).alias("cdf"),
    )


def normalise(df: DataFrame, value: str, by: Sequence[str], out: str = "prob") -> DataFrame:
    """Share of each cell in its group: negatives count as 0, an all-zero group is uniform, infinities take all."""
    w = Window.partitionBy(*by)
    x = F.col(value).cast("double")
    infinite = x == F.lit(float("inf"))
    df = df.withColumn("__inf", F.sum(infinite.cast("int")).over(w))
    mass = F.when(F.col("__inf") > 0, infinite.cast("double")).otherwise(F.greatest(x, F.lit(0.0)))
    df = df.withColumn("__mass", mass).withColumn("__sum", F.sum("__mass").over(w)).withColumn("__size", F.count("*").over(w))
    share = F.when(F.col("__sum") > 0, F.col("__mass") / F.col("__sum")).otherwise(F.lit(1.0) / F.col("__size"))
    return df.withColumn(out, share).drop("__inf", "__mass", "__sum", "__size")


def numbered_cells(tables: DataFrame, total: Column, name: str) -> DataFrame:
    """Every row of ``tables`` with each number from 0 below ``total``, made in blocks of bounded size."""
    whole = total.cast("bigint")
    blocks = tables.withColumn("__block", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((whole - 1) / CELL_BLOCK))))
    first = F.col("__block") * CELL_BLOCK
    numbers = F.sequence(first, F.least(first + CELL_BLOCK, whole) - 1)
    return blocks.withColumn(name, F.explode(numbers)).drop("__block")


def frequency(coded: DataFrame, attrs: Sequence[int], sizes: Sequence[int], keys: Sequence[str] = ()) -> DataFrame:
    """Counts over the full domain of some columns of a ``bins`` array; combinations never seen count 0.

    Columns ``c0, c1, …`` hold the codes. The domain is spelled out from the metadata in blocks, which are made by many tasks.
    """
    total = 1
    for s in sizes:
        total *= s
    code = F.lit(0).cast("bigint")
    for a, s in zip(attrs, sizes):
        code = code * s + F.element_at("bins", a + 1)
    counts = coded.select(*keys, code.alias("cell"), *weighted(coded)).where("cell is not null")
    counts = counts.groupBy(*keys, "cell").agg(weight(coded).alias("n"))
    tables = coded.select(*keys).distinct() if keys else coded.sparkSession.range(1).select()
    skeleton = numbered_cells(tables, F.lit(total), "cell")
    full = skeleton.join(counts, [*keys, "cell"], "left").fillna(0, ["n"])
    digits, rest = [], F.col("cell")
    for k, s in reversed(list(enumerate(sizes))):
        digits.append((rest % s).cast("int").alias(f"c{k}"))
        rest = F.floor(rest / s)
    return full.select(*keys, *reversed(digits), "n")
