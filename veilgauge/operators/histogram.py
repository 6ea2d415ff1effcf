"""Independent histograms: every column is drawn from its own distribution."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import literal_array
from veilgauge.functions.keyed import invert_cdf, invert_constants, uniform
from veilgauge.meta import INTEGER, TableMeta
from veilgauge.operators.distributions import Binning, cell_counts, profile, profile_of_counts
from veilgauge.operators.generate import cell_digest, row_frame, value_in_bin
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.sampling import OUT, with_targets


# Above this many cells the comparisons would make the generated method too long to be compiled.
INLINE_CELLS = 200


@dataclass(frozen=True)
class HistogramModel:
    binning: Binning
    keys: tuple[str, ...]
    prof: DataFrame

    def generate(self, n: int, seed: int = 42, copies: int = 1) -> DataFrame:
        """``keys, copy, row`` and the columns of the table."""
        keys, meta = list(self.keys), self.binning.meta
        known, cdf = {}, {}
        spark = self.prof.sparkSession
        if keys:
            wide = self.prof.groupBy(*keys).agg(
                *[F.max(F.when(F.col("attr_idx") == i, F.col("cdf"))).alias(f"__cdf_{i}") for i in range(len(meta))],
                *[F.max(F.when(F.col("attr_idx") == i, F.col("edges"))).alias(f"__e_{i}") for i in range(len(meta))],
            )
            rows = row_frame(spark, n, copies, self.prof, keys)
            cells = sum(self.binning.sizes) * 16
            rows = attach(rows, wide, keys, "inner")
            cdf = {i: F.col(f"__cdf_{i}") for i in range(len(meta))}
            edges = {i: F.col(f"__e_{i}") for i in range(len(meta))}
        else:
            # One table: its profile is one bounded row per column, so it goes into the plan as constants.
            rows = row_frame(spark, n, copies)
            got = {r["attr_idx"]: r for r in self.prof.select("attr_idx", "cdf", "edges").collect()}
            known = {i: list(got[i]["cdf"]) for i in range(len(meta))}
            edges = {i: literal_array(got[i]["edges"] or [0.0]) for i in range(len(meta))}
        # One digest per cell serves both draws. Bins are projected first because a number reads its bin twice.
        rows = rows.withColumns({f"__h{i}": cell_digest(seed, "hist", keys, c.name) for i, c in enumerate(meta.columns)})
        rows = rows.withColumns({f"__u{i}": uniform(F.col(f"__h{i}"), 0) for i in range(len(meta))})
        if known and sum(self.binning.sizes) <= INLINE_CELLS:
            bins = {f"__b{i}": invert_constants(known[i], F.col(f"__u{i}")) for i in known}
        else:
            cdf = cdf or {i: literal_array(known[i]) for i in known}
            bins = {f"__b{i}": invert_cdf(cdf[i], F.col(f"__u{i}")) for i in range(len(meta))}
        rows = rows.withColumns(bins)
        out: list[Column] = []
        for i, c in enumerate(meta.columns):
            b = F.col(f"__b{i}")
            if c.numeric:
                out.append(value_in_bin(edges[i], b, uniform(F.col(f"__h{i}"), 1), c.kind == INTEGER).alias(c.name))
            else:
                out.append(F.element_at(literal_array(c.labels), b + 1).alias(c.name))
        return rows.select(*keys, "copy", "row", *out)


@dataclass(frozen=True)
class IndependentHistogram:
    meta: TableMeta
    histogram_bins: int = 10
    infer_ranges: bool = False

    generates = True
    name = "IndependentHistogram"

    @property
    def out_meta(self) -> TableMeta:
        return self.meta

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> HistogramModel:
        binning = Binning(self.meta, self.histogram_bins, bool(self.infer_ranges))
        return HistogramModel(binning, tuple(keys), durable(profile(df, binning, keys)))

    def fit_variants(self, drawn: DataFrame, targets: DataFrame, ids: Sequence, draws: int, id_col: str = "id") -> HistogramModel:
        """What :meth:`fit` gives for the tables of :func:`..sampling.with_targets`, without making them: the rows of each draw are counted once, and the
        table with a target has these counts and the target's. Only counts are repeated for the targets."""
        if self.infer_ranges:
            return self.fit(with_targets(drawn, targets, ids, draws, id_col), ["dataset_id"])
        binning = Binning(self.meta, self.histogram_bins)
        names = F.array(*[F.lit(t) for t in [OUT, *[str(i) for i in ids]]])
        base = durable(cell_counts(drawn, binning, ["draw"])).withColumn("target", F.explode(names))
        own = cell_counts(targets.withColumn("target", F.col(id_col).cast("string")), binning, ["target"])
        own = own.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
        both = base.unionByName(own).withColumn("dataset_id", F.concat_ws(":", F.col("draw").cast("string"), "target"))
        counts = both.groupBy("dataset_id", "__cell").agg(F.sum("__n").alias("__n"))
        return HistogramModel(binning, ("dataset_id",), durable(profile_of_counts(counts, binning, ["dataset_id"])))
