"""Attribute attacks: recover one column of a target from the others, given a published table."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.functions.encoding import code_label, code_vector, label_code
from veilgauge.meta import TableMeta
from veilgauge.operators import forests
from veilgauge.operators.gaussian import gaussian_moments
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.learners import likeliest


def known_columns(meta: TableMeta, sensitive: str) -> TableMeta:
    if sensitive not in meta.names:
        raise ValueError(f"unknown column {sensitive!r}")
    return meta.select([n for n in meta.names if n != sensitive])


def _solve(batches):
    """Batch function: least squares from covariances (known columns first, sensitive column last).

    Columns are brought to unit variance before solving and constant ones get coefficient 0. The residual variance
    divides by rows minus known columns.
    """
    for pdf in batches:
        betas, sigmas = [], []
        for n, flat in zip(pdf["n"], pdf["cov"]):
            d = int(round(len(flat) ** 0.5))
            cov = np.asarray(flat, dtype=float).reshape(d, d)
            sd = np.sqrt(np.clip(np.diag(cov), 0, None))
            live = sd[:-1] > 1e-9 * max(sd.max(), 1e-300)
            beta = np.zeros(d - 1)
            if live.any():
                s = sd[:-1][live]
                corr = cov[:-1, :-1][np.ix_(live, live)] / np.outer(s, s)
                beta[live] = np.linalg.lstsq(corr, cov[:-1, -1][live] / s, rcond=1e-10)[0] / s
            rest = cov[-1, -1] - 2 * beta @ cov[:-1, -1] + beta @ cov[:-1, :-1] @ beta
            betas.append(beta.tolist())
            free = n - (d - 1)
            sigmas.append(float(max(rest, 0.0) * n / free) if free > 0 else None)
        yield pdf.assign(beta=pd.Series(betas, index=pdf.index), sigma=pd.Series(sigmas, index=pdf.index, dtype=float)).drop(columns="cov")


def normal_density(x: Column, mean: Column, variance: Column) -> Column:
    """Normal density; null without variance, since the density is not defined there."""
    z = (x - mean) * (x - mean) / (2 * variance)
    return F.when(variance > 0, F.exp(-z) / F.sqrt(2 * math.pi * variance))


@dataclass(frozen=True)
class LinearAttribute:
    """Linear regression of a numeric column on the codes and numbers of all others, one model per table in one job."""

    meta: TableMeta
    sensitive: str

    def __post_init__(self):
        if not self.meta[self.sensitive].numeric:
            raise ValueError(f"linear attack needs a numeric column, {self.sensitive!r} is not")

    def fit(self, df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Models as rows: ``keys, n, means, beta, sigma``. Means end with the mean of the sensitive column."""
        known = known_columns(self.meta, self.sensitive)
        names = [f"__k{i}" for i in range(len(known))]
        shift = {"__y": (self.meta[self.sensitive].low + self.meta[self.sensitive].high) / 2}
        cols = []
        for name, c in zip(names, known.columns):
            code = F.col(f"`{c.name}`") if c.numeric else label_code(F.col(f"`{c.name}`"), c.labels)
            cols.append(code.cast("double").alias(name))
            shift[name] = (c.low + c.high) / 2 if c.numeric else (len(c.labels) - 1) / 2
        data = df.select(*keys, *cols, F.col(f"`{self.sensitive}`").cast("double").alias("__y"))
        moments = gaussian_moments(data, [*names, "__y"], keys, shift)
        schema = T.StructType(
            [f for f in moments.schema.fields if f.name != "cov"]
            + [T.StructField("beta", T.ArrayType(T.DoubleType())), T.StructField("sigma", T.DoubleType())]
        )
        return moments.mapInPandas(_solve, schema)

    def guess(self, targets: DataFrame, models: DataFrame, keys: Sequence[str] = (), secret: str | None = None) -> DataFrame:
        """Targets with ``model_guess`` and the ``likelihood`` of their real value (a density, so it may exceed 1)."""
        known = known_columns(self.meta, self.sensitive)
        out = attach(targets, models.select(*keys, "means", "beta", "sigma"), keys)
        out = out.withColumn("__x", code_vector(known))
        centred = F.zip_with("__x", F.slice("means", 1, len(known)), lambda x, m: x - m)
        part = F.aggregate(F.zip_with(centred, F.col("beta"), lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
        out = out.withColumn("model_guess", F.element_at("means", -1) + part)
        real = F.col(f"`{secret or self.sensitive}`").cast("double")
        out = out.withColumn("likelihood", normal_density(real, F.col("model_guess"), F.col("sigma")))
        return out.drop("__x", "means", "beta", "sigma")


@dataclass(frozen=True)
class ForestAttribute:
    """Random forest on the codes and numbers of all other columns, one for each table, all grown in the same jobs (:mod:`.forests`).

    Labels are cut between their codes, numbers between their own values or quantiles; nulls stay left of every cut.
    """

    meta: TableMeta
    sensitive: str
    seed: int = 42
    trees: int = 100
    depth: int = 30

    def __post_init__(self):
        if self.meta[self.sensitive].numeric:
            raise ValueError(f"classification needs a label column, {self.sensitive!r} is numeric")

    def fit(self, df: DataFrame, keys: Sequence[str] = (), row: Column | None = None) -> forests.Forests:
        """``row`` tells the rows of a table apart: their ``id``, the number ``row`` that a generator gave them, or all their values, unless given."""
        known = known_columns(self.meta, self.sensitive)
        labels = self.meta[self.sensitive].labels
        code = label_code(F.col(f"`{self.sensitive}`"), labels, append_null=False).cast("int")
        rows = df.select(*keys, (forests.row_id(df) if row is None else row).alias("row"), code_vector(known).alias("features"), code.alias("label"))
        return forests.grow(durable(rows.where("label >= 0")), keys, len(known), len(labels), self.trees, self.depth, self.seed)

    def guess(self, targets: DataFrame, model: forests.Forests, keys: Sequence[str] = (), secret: str | None = None) -> DataFrame:
        """Targets with ``model_guess`` (a label, the first of equally likely ones) and the ``likelihood`` of their real label.

        Labels a forest never saw get 0. Targets of tables without a forest stay, with nulls.
        """
        known = known_columns(self.meta, self.sensitive)
        labels = self.meta[self.sensitive].labels
        real = label_code(F.col(f"`{secret or self.sensitive}`"), labels, append_null=False)
        asked = durable(targets).withColumn("__row", F.monotonically_increasing_id())
        probs = forests.probabilities(model, asked.select(*keys, F.col("__row").alias("row"), code_vector(known).alias("features")), len(known))
        out = asked.join(durable(probs.select(F.col("row").alias("__row"), "probs")), "__row", "left")
        p = F.try_element_at("probs", (F.when(real >= 0, real) + 1).cast("int"))
        best = likeliest(F.col("probs"))
        found = F.col("probs").isNotNull()
        out = out.withColumns({"likelihood": F.when(found, F.coalesce(p, F.lit(0.0))), "model_guess": F.when(found, code_label(best, labels))})
        return out.drop("__row", "probs")


def with_links(guesses: DataFrame, linked: str = "linked") -> DataFrame:
    """``guess`` (text), ``prob_correct``, ``guess_source``: a unique link replaces the model and is taken as certain."""
    link = F.col(linked)
    return guesses.withColumns(
        {
            "guess": F.coalesce(link.cast("string"), F.col("model_guess").cast("string")),
            "prob_correct": F.when(link.isNotNull(), F.lit(1.0)).otherwise(F.col("likelihood")),
            "guess_source": F.when(link.isNotNull(), F.lit("linkage")).otherwise(F.lit("model")),
        }
    )
