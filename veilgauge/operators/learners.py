"""Logistic regression for many tables in the same jobs: a Newton step is one aggregate for all of them, models are rows.

A step joins each row with its table's model, sums gradient and Hessian of the table in every task, adds the sums up by table and solves one small
system for each. The number of steps is fixed, so a model is the same whenever it is fitted, up to the order of summation. A single table without keys is
the same job with one model.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.operators.joining import attach, durable

HELD_BYTES = 64 * 2**20
SLOTS = 64
NO_CLASS = -1e300  # logit of a class that a table does not have


def clean(values: Column) -> Column:
    """Features as numbers: undefined ones count as 0."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x.cast("double")))


def likeliest(shares: Column) -> Column:
    """The class of the largest share, the first of equal ones; shares that differ by the order of summation only are equal."""
    rounded = F.transform(shares, lambda p: F.round(p, 9))
    return (F.array_position(rounded, F.array_max(rounded)) - 1).cast("int")


def free_classes(counts: np.ndarray) -> np.ndarray:
    """Classes with parameters: all that occur, or the last one if only two do (its odds against the other)."""
    present = np.flatnonzero(counts > 0)
    return present[-1:] if len(present) == 2 else present if len(present) > 2 else present[:0]


def class_shares(logits: np.ndarray, counts: np.ndarray) -> np.ndarray:
    logits = np.where(counts > 0, logits, NO_CLASS)
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def _upper(classes: int) -> list[tuple[int, int]]:
    return [(c, d) for c in range(classes) for d in range(c, classes)]


def _sums(classes: int, width: int):
    """Gradient, Hessian (blocks of class pairs) and loss of each table over a task's rows."""
    pairs = _upper(classes)
    size = 1 + classes * width + len(pairs) * width * width

    def packed(held):
        return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64()))], names=["__t", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.ones((n, width))
            x[:, :-1] = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(n, width - 1)
            y = batch.column("__y").to_numpy(zero_copy_only=False)
            t = batch.column("__t").to_numpy(zero_copy_only=False)
            weight = batch.column("__w").to_numpy(zero_copy_only=False)
            order = np.argsort(t, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
            for part in np.split(order, head[1:]):
                row = int(part[0])
                w = np.asarray(batch.column("weights")[row].values).reshape(classes, width)
                counts = np.asarray(batch.column("counts")[row].values)
                xs, ys = x[part], y[part]
                p, by = class_shares(xs @ w.T, counts), weight[part]
                own = p[np.arange(len(part)), ys]
                miss = p.copy()
                miss[np.arange(len(part)), ys] -= 1
                hess = [(xs * (by * p[:, c] * ((c == d) - p[:, d]))[:, None]).T @ xs for c, d in pairs]
                found = np.concatenate([[-(by * np.log(np.maximum(own, 1e-300))).sum()], (miss.T @ (xs * by[:, None])).ravel(), *[h.ravel() for h in hess]])
                key = int(t[row])
                held[key] = held[key] + found if key in held else found
            if len(held) * size * 8 > HELD_BYTES:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    return run


def _add(table: pa.Table) -> pa.Table:
    total = np.sum([np.asarray(v.values) for v in table.column("sums")], axis=0)
    return table.slice(0, 1).select(["__t"]).append_column("sums", pa.array([total.tolist()], pa.list_(pa.float64())))


def added(sums: DataFrame) -> DataFrame:
    """Sums of tasks, added up beforehand where there are so many tasks that one table's would be a large group."""
    if sums.rdd.getNumPartitions() <= SLOTS:
        return sums
    return sums.withColumn("slot", F.spark_partition_id() % SLOTS).groupBy("__t", "slot").applyInArrow(_add, "__t long, sums array<double>")


def newton(w: np.ndarray, sums: np.ndarray, counts: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """The next weights and the loss at the present ones. Offsets are not penalised; with several classes their sum stays 0."""
    classes, width = w.shape
    loss = float(sums[0]) + penalty / 2 * float((w[:, :-1] ** 2).sum())
    use = free_classes(counts)
    if not len(use):
        return w, loss
    ridge = np.full(width, penalty)
    ridge[-1] = 0.0
    grad = sums[1 : 1 + w.size].reshape(classes, width) + w * ridge
    blocks = sums[1 + w.size :].reshape(-1, width, width)
    at = {pair: i for i, pair in enumerate(_upper(classes))}
    hess = np.zeros((len(use), width, len(use), width))
    for i, c in enumerate(use):
        for j, d in enumerate(use):
            hess[i, :, j, :] = blocks[at[c, d]] if c <= d else blocks[at[d, c]].T
        hess[i, :, i, :] += np.diag(ridge)
    if len(use) > 1:
        hess[:, -1, :, -1] += 1.0  # moving all offsets alike changes nothing, so this only makes the system regular
    size = len(use) * width
    step = np.linalg.lstsq(hess.reshape(size, size), grad[use].ravel(), rcond=1e-12)[0].reshape(len(use), width)
    out = w.copy()
    out[use] -= step
    return out, loss


def _step(classes: int, width: int, penalty: float):
    """A table's model and the sums of all tasks over its rows: the model after one more step."""
    numbers = pa.list_(pa.float64())

    def run(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        model = next(r for r in rows if r["counts"] is not None)
        sums = np.sum([r["sums"] for r in rows if r["sums"] is not None], axis=0)
        w = np.array(model["weights"]).reshape(classes, width)
        new, loss = newton(w, sums, np.array(model["counts"]), penalty)
        if model["loss"] is not None and not loss <= model["loss"] + 1e-9 * abs(model["loss"]):
            # The step went too far: half of it.
            old = np.array(model["before"]).reshape(classes, width)
            new, w, loss = (w + old) / 2, old, model["loss"]
        weights, before = (pa.array([v.ravel().tolist()], numbers) for v in (new, w))
        return pa.table({"__t": [model["__t"]], "n": [model["n"]], "counts": [model["counts"]], "weights": weights, "before": before, "loss": [loss]})

    return run


MODEL = "__t long, n long, counts array<long>, weights array<double>, before array<double>, loss double"


@dataclass(frozen=True)
class Logistic:
    """L2-penalised logistic regression of ``classes`` classes: minimises the log loss plus ``penalty / 2`` times the squared weights.

    A table with two classes has one set of weights, one with more has a set for each class that it holds. Classes that a table does not hold have
    probability 0 there; a table with one class always answers it.
    """

    classes: int
    penalty: float = 1.0
    steps: int = 10

    def fit(self, rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """Models as rows ``keys, n, counts, weights`` from ``keys, features, label``: ``weights`` holds for each class the features' weights, then the offset.
        A column ``weight`` says how often a row counts. Rows with a label outside of ``0 … classes - 1`` are left out; tables without rows have no model."""
        by = list(keys) or ["__all"]
        known = F.col("label").cast("int").between(0, self.classes - 1)
        weight = F.col("weight") if "weight" in rows.columns else F.lit(1.0)
        rows = rows.where(known).select(*keys, *([] if keys else [F.lit(0).alias("__all")]), clean(F.col("features")).alias("__x"), F.col("label").cast("int").alias("__y"), weight.cast("double").alias("__w"))
        rows = durable(rows)
        width = (rows.agg(F.max(F.size("__x"))).first()[0] or 0) + 1
        counts = F.array(*[F.sum((F.col("__y") == c).cast("long")) for c in range(self.classes)])
        zero = F.array_repeat(F.lit(0.0), self.classes * width)
        models = durable(rows.groupBy(*by).agg(F.count("*").alias("n"), counts.alias("counts")))
        models = durable(models.withColumn("__t", F.monotonically_increasing_id()))
        tables, n_models, size = models.select(*by, "__t"), models.count(), 8 * (self.classes * (width + 2) + 16)
        rows = durable(attach(rows, tables, by, "inner", n_models).select("__t", "__x", "__y", "__w"))
        models = models.select("__t", "n", "counts", zero.alias("weights"), zero.alias("before"), F.lit(None).cast("double").alias("loss"))
        for _ in range(self.steps):
            joined = attach(rows, models.select("__t", "counts", "weights"), ["__t"], "inner", n_models, size)
            sums = added(joined.mapInArrow(_sums(self.classes, width), "__t long, sums array<double>"))
            both = models.unionByName(sums, allowMissingColumns=True)
            models = durable(both.groupBy("__t").applyInArrow(_step(self.classes, width, self.penalty), MODEL))
        return attach(models, tables, ["__t"], "inner", n_models).select(*keys, "n", "counts", "weights")

    def predict(self, rows: DataFrame, models: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
        """``rows`` with ``probs`` (by class) and ``guess`` (the likeliest class, the first of equals); null where a table has no model."""
        out = attach(rows, models.select(*keys, "counts", "weights"), keys) if keys else rows.crossJoin(F.broadcast(models.select("counts", "weights")))
        width = F.size("weights") / self.classes
        x = F.concat(clean(F.col("features")), F.array(F.lit(1.0)))

        def logit(c: Column) -> Column:
            w = F.slice("weights", (c * width + 1).cast("int"), width.cast("int"))
            dot = F.aggregate(F.zip_with(w, x, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
            return F.when(F.element_at("counts", c + 1) > 0, dot).otherwise(F.lit(NO_CLASS))

        logits = F.transform(F.sequence(F.lit(0), F.lit(self.classes - 1)), logit)
        out = out.withColumn("__l", F.when(F.col("weights").isNotNull(), logits))
        out = out.withColumn("__l", F.transform("__l", lambda v: F.exp(v - F.array_max("__l"))))
        total = F.aggregate("__l", F.lit(0.0), lambda s, v: s + v)
        out = out.withColumn("probs", F.transform("__l", lambda v: v / total))
        return out.withColumn("guess", likeliest(F.col("probs"))).drop("counts", "weights", "__l")


def _moments(width: int, middle: float):
    """Of each table over a task's rows: the products of all features, a one and the label, which is taken around ``middle``."""

    def packed(held):
        return pa.record_batch([pa.array(list(held), pa.int64()), pa.array([v.ravel().tolist() for v in held.values()], pa.list_(pa.float64()))], names=["__t", "sums"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = np.ones((n, width + 2))
            x[:, :width] = batch.column("__x").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
            x[:, -1] = batch.column("__y").to_numpy(zero_copy_only=False) - middle
            t = batch.column("__t").to_numpy(zero_copy_only=False)
            order = np.argsort(t, kind="stable")
            head = np.flatnonzero(np.concatenate([[True], np.diff(t[order]) != 0]))
            for part in np.split(order, head[1:]):
                key = int(t[part[0]])
                held[key] = held.get(key, 0.0) + x[part].T @ x[part]
            if len(held) * (width + 2) ** 2 * 8 > HELD_BYTES:
                yield packed(held)
                held = {}
        if held:
            yield packed(held)

    return run


def solve_moments(products: np.ndarray) -> tuple[np.ndarray, float]:
    """Least squares from the products of features, one and label: weights and offset. Constant features get 0, and of features that
    repeat each other all get a share."""
    n = products[-2, -2]
    means = products[-2] / n
    cov = products / n - np.outer(means, means)
    sd = np.sqrt(np.clip(np.diag(cov)[:-2], 0, None))
    live = sd > 1e-9 * max(sd.max(initial=0.0), 1e-300)
    beta = np.zeros(len(sd))
    if live.any():
        s = sd[live]
        beta[live] = np.linalg.lstsq(cov[:-2, :-2][np.ix_(live, live)] / np.outer(s, s), cov[:-2, -1][live] / s, rcond=1e-10)[0] / s
    return beta, float(means[-1] - beta @ means[:-2])


def least_squares(rows: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Models as rows ``keys, n, beta, offset`` of ``label`` on ``features``, from one aggregate of moments for all tables."""
    by = list(keys) or ["__all"]
    rows = rows.where("label is not null").select(*keys, *([] if keys else [F.lit(0).alias("__all")]), clean(F.col("features")).alias("__x"), F.col("label").cast("double").alias("__y"))
    rows = durable(rows)
    shape = rows.agg(F.max(F.size("__x")), F.avg("__y")).first()
    width, middle = shape[0] or 0, shape[1] or 0.0
    tables = durable(durable(rows.select(*by).distinct()).withColumn("__t", F.monotonically_increasing_id()))
    n_tables = tables.count()

    def solved(table: pa.Table) -> pa.Table:
        products = np.sum([np.asarray(v.values) for v in table.column("sums")], axis=0).reshape(width + 2, width + 2)
        beta, offset = solve_moments(products)
        return pa.table({"__t": table.column("__t")[:1], "n": [int(products[-2, -2])], "beta": pa.array([beta.tolist()], pa.list_(pa.float64())), "offset": [offset + middle]})

    sums = added(attach(rows, tables, by, "inner", n_tables).mapInArrow(_moments(width, middle), "__t long, sums array<double>"))
    models = sums.groupBy("__t").applyInArrow(solved, "__t long, n long, beta array<double>, offset double")
    return durable(attach(models, tables, ["__t"], "inner", n_tables).select(*keys, "n", "beta", "offset"))


def platt(margins: DataFrame, keys: Sequence[str] = (), steps: int = 10) -> DataFrame:
    """``keys, slope, offset`` of ``P(label 1) = 1 / (1 + exp(-(slope * margin + offset)))`` for the tables of ``keys, margin, label``.

    As in Platt's method the labels are drawn in a little, to ``(n1 + 1) / (n1 + 2)`` and ``1 / (n0 + 2)``, so that a margin which tells all rows apart
    does not give certainty. A table with one label only has no slope."""
    known = margins.where("label in (0, 1) and margin is not null")
    sizes = known.groupBy(*keys).agg(F.sum("label").alias("__n1"), F.count("*").alias("__n"))
    rows = attach(known, sizes, keys)
    soft = F.when(F.col("label") == 1, (F.col("__n1") + 1) / (F.col("__n1") + 2)).otherwise(1 / (F.col("__n") - F.col("__n1") + 2))
    sides = F.array(F.struct(F.lit(1).alias("label"), soft.alias("weight")), F.struct(F.lit(0).alias("label"), (1 - soft).alias("weight")))
    both = rows.where("__n1 > 0 and __n1 < __n").select(*keys, F.array(F.col("margin").cast("double")).alias("features"), F.explode(sides).alias("s"))
    models = Logistic(2, 0.0, steps).fit(both.select(*keys, "features", "s.label", "s.weight"), keys)
    return models.select(*keys, F.element_at("weights", 3).alias("slope"), F.element_at("weights", 4).alias("offset"))
