"""Gaussian models of the numeric columns."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.functions.keyed import invert_cdf, normal, uniform
from veilgauge.meta import TableMeta
from veilgauge.operators.generate import cell_digest, row_frame
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.mixtures import Mixture

REGULARISER = 1e-6  # fixed value: added to the diagonal of a covariance


def gaussian_moments(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = (), shifts: dict | None = None) -> DataFrame:
    """``n``, ``means`` and row-major ``cov`` (population) of several columns, one row per table, in one aggregate.

    Products are summed around ``shifts``, a known value near the middle of each column, so that the difference of
    large sums does not eat the result. Rows with a null in any column are left out.
    """
    d, at = len(cols), shifts or {}
    x = [F.col(f"`{c}`").cast("double") - F.lit(float(at.get(c, 0.0))) for c in cols]
    rows = df.select(*keys, *[v.alias(f"__x{i}") for i, v in enumerate(x)]).dropna(subset=[f"__x{i}" for i in range(d)])
    sums = [F.count("*").cast("double").alias("n"), *[F.sum(f"__x{i}").alias(f"s{i}") for i in range(d)]]
    sums += [F.sum(F.col(f"__x{i}") * F.col(f"__x{j}")).alias(f"p{i}_{j}") for i in range(d) for j in range(i, d)]
    wide = rows.groupBy(*keys).agg(*sums)

    def cov(i: int, j: int):
        lo, hi = min(i, j), max(i, j)
        return (F.col(f"p{lo}_{hi}") - F.col(f"s{lo}") * F.col(f"s{hi}") / F.col("n")) / F.col("n")

    means = F.array(*[F.col(f"s{i}") / F.col("n") + F.lit(float(at.get(c, 0.0))) for i, c in enumerate(cols)])
    return wide.where("n > 0").select(*keys, "n", means.alias("means"), F.array(*[cov(i, j) for i in range(d) for j in range(d)]).alias("cov"))


def _factor(batches):
    for pdf in batches:
        out = []
        for flat in pdf["cov"]:
            d = int(round(len(flat) ** 0.5))
            out.append(np.linalg.cholesky(np.asarray(flat).reshape(d, d) + REGULARISER * np.eye(d)).ravel().tolist())
        yield pdf.assign(factor=pd.Series(out, index=pdf.index))


@dataclass(frozen=True)
class GaussianModel:
    meta: TableMeta
    keys: tuple[str, ...]
    components: DataFrame  # keys, means, factor, weight cdf position

    def generate(self, n: int, seed: int = 42, copies: int = 1) -> DataFrame:
        keys, cols = list(self.keys), [c.name for c in self.meta.numeric]
        spark = self.components.sparkSession
        rows = row_frame(spark, n, copies, self.components, keys)
        packed = self.components.groupBy(*keys).agg(
            F.sort_array(F.collect_list(F.struct("component", "weight", "means", "factor"))).alias("parts")
        )
        packed = packed.withColumn(
            "cdf",
            F.transform(F.sequence(F.lit(1), F.size("parts")), lambda i: F.aggregate(F.slice("parts", F.lit(1), i), F.lit(0.0), lambda a, p: a + p["weight"])),
        )
        rows = attach(rows, packed, keys, "inner")
        which = invert_cdf(F.col("cdf"), uniform(cell_digest(seed, "component", keys, "component")))
        rows = rows.withColumn("part", F.element_at("parts", which + 1)).drop("parts", "cdf")
        for i, c in enumerate(cols):
            hexed = cell_digest(seed, "normal", keys, c)
            rows = rows.withColumn(f"__z{i}", normal(uniform(hexed, 0), uniform(hexed, 1)))
        out = []
        for i, c in enumerate(cols):
            x = F.element_at("part.means", i + 1)
            for j in range(i + 1):
                x = x + F.element_at("part.factor", i * len(cols) + j + 1) * F.col(f"__z{j}")
            out.append(x.alias(c))
        return rows.select(*keys, "copy", "row", *out)


@dataclass(frozen=True)
class Gaussian:
    """Gaussian mixture over the numeric columns: moments for one component, expectation maximisation for more (:class:`Mixture`)."""

    meta: TableMeta
    components: int = 1
    seed: int = 42
    steps: int = 100
    tolerance: float = 1e-3

    generates = True
    name = "GaussianMixtureModel"

    @property
    def out_meta(self) -> TableMeta:
        return TableMeta(tuple(self.meta.numeric))

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> GaussianModel:
        cols = [c.name for c in self.meta.numeric]
        if self.components == 1:
            fitted = gaussian_moments(df, cols, keys, {c.name: (c.low + c.high) / 2 for c in self.meta.numeric})
            fitted = fitted.select(*keys, F.lit(0).alias("component"), F.lit(1.0).alias("weight"), "means", "cov")
        else:
            ranges = [(c.low, c.high) for c in self.meta.numeric]
            fitted = Mixture(self.components, self.seed, self.steps, self.tolerance).fit(df, cols, ranges, keys)
            fitted = fitted.select(*keys, "component", "weight", "means", "cov")
        schema = T.StructType([*fitted.schema.fields, T.StructField("factor", T.ArrayType(T.DoubleType()))])
        parts = fitted.mapInPandas(_factor, schema).select(*keys, "component", "weight", "means", "factor")
        return GaussianModel(self.meta, tuple(keys), durable(parts))
