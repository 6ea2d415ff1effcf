"""Mixtures of Gaussians for many tables in the same jobs: a step of expectation maximisation is one aggregate for all of them, models are rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.functions.keyed import digest, uniform
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.learners import HELD_BYTES, added

RIDGE = 1e-6  # fixed value: added to the diagonal of a covariance of scaled columns
SPREAD = 3**0.5  # fixed value: uniform numbers between minus and plus this have unit variance
EMPTY = 1e-9  # a component with less than this many rows keeps its place and gets no weight


def log_densities(x: np.ndarray, weights: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    """Log of weight times density, by row and component."""
    out = np.empty((len(x), len(weights)))
    for c, (w, m, s) in enumerate(zip(weights, means, covs)):
        factor = np.linalg.cholesky(s)
        z = np.linalg.solve(factor, (x - m).T)
        out[:, c] = np.log(max(w, 1e-300)) - np.log(np.diag(factor)).sum() - 0.5 * (z * z).sum(axis=0) - 0.5 * len(m) * np.log(2 * np.pi)
    return out


def _split(flat, k: int, d: int):
    flat = np.asarray(flat)
    return flat[:k], flat[k : k + k * d].reshape(k, d), flat[k + k * d :].reshape(k, d, d)


def _start(k: int, d: int):
    """The first models: means at their offsets along the factor of the table's covariance, all with that covariance made narrower."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            models = []
            for mean, cov, offsets in zip(*(batch.column(c) for c in ("means", "cov", "offsets"))):
                full = np.asarray(cov.values).reshape(d, d) + RIDGE * np.eye(d)
                means = np.asarray(mean.values) + np.asarray(offsets.values).reshape(k, d) @ np.linalg.cholesky(full).T
                models.append(np.concatenate([np.full(k, 1 / k), means.ravel(), np.tile((full / k**2).ravel(), k)]).tolist())
            rest = [c for c in batch.schema.names if c not in ("means", "cov", "offsets")]
            yield pa.record_batch([*[batch.column(c) for c in rest], pa.array(models, pa.list_(pa.float64()))], names=[*rest, "model"])

    return run


def _packed(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([v.ravel().tolist() for v in held.values()], pa.list_(pa.float64()))], names=["__t", "sums"])


def _expected(k: int, d: int):
    """Of each table over a task's rows: the log likelihood and each component's products of a one and all columns, weighted by its shares."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.ones((n, d + 1))
            x[:, 1:] = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(n, d)
            t = batch.column("__t").to_numpy(zero_copy_only=False)
            order = np.argsort(t, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
            for part in np.split(order, head[1:]):
                row = int(part[0])
                logs = log_densities(x[part, 1:], *_split(batch.column("model")[row].values, k, d))
                top = logs.max(axis=1, keepdims=True)
                shares = np.exp(logs - top)
                total = shares.sum(axis=1, keepdims=True)
                shares /= total
                found = [((x[part] * shares[:, c : c + 1]).T @ x[part]).ravel() for c in range(k)]
                found = np.concatenate([[(top + np.log(total)).sum()], *found])
                key = int(t[row])
                held[key] = held[key] + found if key in held else found
            if len(held) * (1 + k * (d + 1) ** 2) * 8 > HELD_BYTES:
                yield _packed(held)
                held = {}
        if held:
            yield _packed(held)

    return run


def _maximised(k: int, d: int, tolerance: float):
    """A table's model and the sums of all tasks over its rows: the model after one more step. A model whose likelihood no longer grows stays."""

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        old = next(r for r in rows if r["model"] is not None)
        parts = [r["sums"] for r in rows if r["sums"] is not None]
        model, fit, done = old["model"], old["fit"], old["done"]
        if parts:
            sums = np.sum(parts, axis=0)
            fit = float(sums[0]) / old["n"]
            done = old["fit"] is not None and fit - old["fit"] < tolerance
            weights, means, covs = (v.copy() for v in _split(model, k, d))
            for c, products in enumerate(sums[1:].reshape(k, d + 1, d + 1)):
                n = products[0, 0]
                weights[c] = n / old["n"] if n > EMPTY else 0.0
                if n > EMPTY:
                    means[c] = products[0, 1:] / n
                    covs[c] = products[1:, 1:] / n - np.outer(means[c], means[c]) + RIDGE * np.eye(d)
            model = np.concatenate([weights, means.ravel(), covs.ravel()]).tolist()
        return pa.table({"__t": [old["__t"]], "n": [old["n"]], "model": pa.array([model], pa.list_(pa.float64())), "fit": pa.array([fit], pa.float64()), "done": [bool(done)]})

    return run


MODEL = "__t long, n long, model array<double>, fit double, done boolean"


@dataclass(frozen=True)
class Mixture:
    """``components`` Gaussians over numeric columns, fitted by ``steps`` steps of expectation maximisation.

    Columns are scaled by known ranges. The first means are spread over the ellipsoid of the table's covariance at offsets keyed by seed, component
    and column. So a fit can be rerun and does not depend on other tables or on the partitioning.
    A table stops early when a step adds less than ``tolerance`` to its mean log likelihood.
    """

    components: int
    seed: int = 42
    steps: int = 100
    tolerance: float = 1e-3

    def offsets(self, d: int) -> Column:
        """Where the first means lie in the table's own directions: in unit variance, evenly spread over the first direction."""
        k, out = self.components, []
        for c in range(k):
            u = [uniform(digest(self.seed, "mixture", F.lit(c), F.lit(j))) for j in range(d)]
            out += [((v + c) / k if j == 0 else v) * (2 * SPREAD) - SPREAD for j, v in enumerate(u)]
        return F.array(*out)

    def fit(self, df: DataFrame, cols: Sequence[str], ranges: Sequence[tuple[float, float]], keys: Sequence[str] = ()) -> DataFrame:
        """``keys, n, fit, component, weight, means, cov`` (row-major), a row for each component of each table, in the columns' own units.

        ``fit`` is the mean log likelihood of the scaled rows before the last step. Rows with a null or a number that is not finite in any column are left
        out; a table without other rows has no model."""
        from veilgauge.operators.gaussian import gaussian_moments

        d, k, by = len(cols), self.components, list(keys) or ["__all"]
        widths = [(high - low) or 1.0 for low, high in ranges]
        scaled = [(F.col(f"`{c}`").cast("double") - F.lit((low + high) / 2)) / F.lit(w) for c, (low, high), w in zip(cols, ranges, widths)]
        rows = df.select(*keys, *([] if keys else [F.lit(0).alias("__all")]), F.array(*scaled).alias("__x"))
        rows = durable(rows.where(F.forall("__x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))))
        flat = rows.select(*by, *[F.element_at("__x", j + 1).alias(f"__v{j}") for j in range(d)])
        moments = gaussian_moments(flat, [f"__v{j}" for j in range(d)], by)
        models = durable(moments.select(*by, F.col("n").cast("long").alias("n"), "means", "cov", self.offsets(d).alias("offsets")))
        models = models.withColumn("__t", F.monotonically_increasing_id())
        schema = T.StructType([f for f in models.schema.fields if f.name not in ("means", "cov", "offsets")]).add("model", T.ArrayType(T.DoubleType()))
        models = durable(models.mapInArrow(_start(k, d), schema))
        tables, n_tables, size = models.select(*by, "__t"), models.count(), 8 * k * (1 + d + d * d) + 64
        rows = durable(attach(rows, tables, by, "inner", n_tables).select("__t", "__x"))
        models = models.select("__t", "n", "model", F.lit(None).cast("double").alias("fit"), F.lit(False).alias("done"))
        for step in range(self.steps):
            joined = attach(rows, models.where(~F.col("done")).select("__t", "model"), ["__t"], "inner", n_tables, size)
            sums = added(joined.mapInArrow(_expected(k, d), "__t long, sums array<double>"))
            both = models.unionByName(sums, allowMissingColumns=True)
            models = durable(both.groupBy("__t").applyInArrow(_maximised(k, d, self.tolerance), MODEL))
            if step % 5 == 4 and models.where(~F.col("done")).isEmpty():
                break
        out = attach(models, tables, ["__t"], "inner", n_tables)
        part = F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("component")
        out = out.select(*keys, "n", "fit", "model", part)
        at = F.col("component")
        means = [F.element_at("model", k + at * d + j + 1) * F.lit(widths[j]) + F.lit((ranges[j][0] + ranges[j][1]) / 2) for j in range(d)]
        cov = [F.element_at("model", k + k * d + at * d * d + i * d + j + 1) * F.lit(widths[i] * widths[j]) for i in range(d) for j in range(d)]
        return durable(out.select(*keys, "n", "fit", "component", F.element_at("model", at + 1).alias("weight"), F.array(*means).alias("means"), F.array(*cov).alias("cov")))
