"""Prediction tasks that measure how useful published tables are.

The models of all tables are fitted in the same jobs and are rows. A table of real records is scored against all of them in one scan: models go to the
records in blocks of bounded size, a task adds up the scores of each model, and only the sums and the records that are asked for one by one are returned.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import PREDICTOR_TOL, bin_columns, code_label, label_code, one_hot, scaled
from veilgauge.meta import TableMeta
from veilgauge.operators import forests
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.learners import Logistic, class_shares, least_squares, likeliest
from veilgauge.operators.sanitise import impute, impute_values

# Names of the tasks in result files.
TASKS = {"forest": "RandomForestClassifier", "logistic": "LogisticRegression", "linear": "LinearRegression"}
BLOCK_BYTES = 64 * 2**20


def open_vector(meta: TableMeta) -> Column:
    """Predictor inputs of a record, with null in the cells that a fill value would decide: numbers scaled, labels one-hot."""
    parts = []
    for c in meta.columns:
        value = F.col(f"`{c.name}`")
        if c.numeric:
            parts.append(F.array(scaled(value, c.low, c.high, PREDICTOR_TOL)))
        else:
            none = F.array(*[F.lit(None).cast("double")] * len(c.labels))
            parts.append(F.when(value.isNull(), none).otherwise(one_hot(value, c.labels)))
    return F.flatten(F.array(*parts))


@dataclass(frozen=True)
class TaskModels:
    """``models``: keys, ``fill`` (the vector of fill values) and what the kind needs: weights and counts, or beta and offset; a forest is in ``forest``."""

    keys: tuple[str, ...]
    models: DataFrame
    forest: forests.Forests | None = None


def _score_block(kind: str, block, classes: int, width: int):
    """Scores of every record under every model of a block: sums for each model, and the asked records one by one."""

    def guess(model, x: np.ndarray) -> np.ndarray:
        if kind == "linear":
            return x @ model["beta"] + model["offset"]
        if kind == "logistic":
            shares = class_shares(x @ model["weights"][:, :-1].T + model["weights"][:, -1], model["counts"])
        else:
            shares = np.zeros((len(x), classes))
            for tree in model["trees"]:
                shares += tree["share"][forests._leaves(tree, x)]
            shares /= max(len(model["trees"]), 1)
        return np.round(shares, 9).argmax(axis=1)  # sums of different order do not decide between equal shares

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = block.value
        total, count = np.zeros(len(models)), np.zeros(len(models), dtype=np.int64)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            x = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, width)
            y = batch.column("label").to_numpy(zero_copy_only=False).astype(float)
            asked = np.flatnonzero(batch.column("asked").to_numpy(zero_copy_only=False))
            gaps = np.isnan(x)
            some = gaps.any()
            for i, model in enumerate(models):
                full = np.where(gaps, model["fill"], x) if some else x
                got = guess(model, full)
                score = y - got if kind == "linear" else (y == got).astype(float)
                known = score[~np.isnan(score)]
                total[i] += known.sum()
                count[i] += len(known)
                if len(asked):
                    yield pa.record_batch(
                        [pa.array(np.full(len(asked), model["t"])), batch.column("record").take(pa.array(asked)), pa.array(score[asked], from_pandas=True), pa.array(np.zeros(len(asked), np.int64))],
                        names=["__t", "record", "score", "n"],
                    )
        if count.any():
            yield pa.record_batch(
                [pa.array([m["t"] for m in models], pa.int64()), pa.nulls(len(models), pa.string()), pa.array(total), pa.array(count)], names=["__t", "record", "score", "n"]
            )

    return run


@dataclass
class PredictTask:
    """Train on published tables, score on real records. Test nulls are filled with the training values of each table.

    ``options``: ``numTrees`` and ``maxDepth`` of forests, ``maxIter`` and ``penalty`` of the logistic task.
    """

    kind: str
    meta: TableMeta
    label: str
    seed: int = 42
    options: dict = field(default_factory=dict)
    strict: bool = False
    fitted: TaskModels | None = None

    def __post_init__(self):
        if self.kind not in TASKS:
            raise ValueError(f"unknown task {self.kind!r}; one of {tuple(TASKS)}")
        if self.label not in self.meta.names:
            raise ValueError(f"unknown label column {self.label!r}")
        if self.meta[self.label].numeric != (self.kind == "linear"):
            raise ValueError(f"task {self.kind!r} does not fit the type of {self.label!r}")

    @property
    def name(self) -> str:
        return TASKS[self.kind] + self.label

    @property
    def known(self) -> TableMeta:
        return self.meta.select([n for n in self.meta.names if n != self.label])

    @property
    def width(self) -> int:
        return sum(1 if c.numeric else len(c.labels) for c in self.known.columns)

    @property
    def classes(self) -> int:
        return 0 if self.kind == "linear" else len(self.meta[self.label].labels)

    def _check(self, df: DataFrame) -> None:
        for c in self.known.discrete if self.strict else ():
            if df.where(F.col(f"`{c.name}`").isNotNull() & ~F.col(f"`{c.name}`").isin(list(c.labels))).limit(1).count():
                raise ValueError(f"column {c.name!r} has labels outside its domain")

    def _target(self) -> Column:
        c = self.meta[self.label]
        value = F.col(f"`{self.label}`")
        return value.cast("double") if c.numeric else label_code(value, c.labels, append_null=False).cast("double")

    def fit(self, df: DataFrame, keys: Sequence[str] = (), repeats: int = 1) -> PredictTask:
        """One model for each table of ``keys``, in the same jobs for all. With ``repeats`` a forest is grown so many times, with a key ``repeat``;
        the other kinds would only repeat themselves and are copied."""
        keys = list(keys)
        self.meta.check(df.columns)
        df = df.withColumn("__row", forests.row_id(df))
        df = durable(bin_columns(df, self.meta, keep_null=True).select(*keys, "__row", *[F.col(f"`{n}`") for n in self.meta.names]))
        fills = durable(impute_values(df, self.meta, keys))
        full = impute(df, self.meta, keys, values=fills)
        self._check(full)
        rows = full.select(*keys, F.col("__row").alias("row"), F.transform(open_vector(self.known), lambda v: F.coalesce(v, F.lit(0.0))).alias("features"), self._target().alias("label"))
        rows = durable(rows.where("label is not null" if self.kind == "linear" else "label >= 0"))
        fill = fills.select(*keys, F.transform(open_vector(self.known), lambda v: F.coalesce(v, F.lit(0.0))).alias("fill"))
        forest = None
        if self.kind == "forest":
            trees, depth = self.options.get("numTrees", 100), self.options.get("maxDepth", 30)
            forest = forests.grow(rows, keys, self.width, self.classes, trees * repeats, depth, self.seed)
            if repeats > 1:
                mine = forest.trees.withColumns({"repeat": F.floor(F.col("tree") / trees).cast("int"), "tree": F.col("tree") % trees})
                forest = forests.Forests((*keys, "repeat"), self.classes, mine)
            models = forest.trees.select(*forest.keys).distinct() if forest.keys else forest.trees.limit(1).select(F.lit(0).alias("__one"))
            models = attach(models, fill, keys) if keys else models.crossJoin(F.broadcast(fill))
        else:
            if self.kind == "logistic":
                found = Logistic(self.classes, self.options.get("penalty", 1.0), self.options.get("maxIter", 10)).fit(rows, keys)
            else:
                found = least_squares(rows, keys)
            models = attach(found, fill, keys) if keys else found.crossJoin(F.broadcast(fill))
            if repeats > 1:
                models = models.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
        by = (*keys, "repeat") if repeats > 1 else tuple(keys)
        models = durable(durable(models).withColumn("__t", F.monotonically_increasing_id()))
        self.fitted = TaskModels(by, models, forest)
        return self

    def _blocks(self):
        """Models as plain arrays, in blocks of bounded size: all trees of a table are in one block."""
        f = self.fitted
        sizes = {r["__t"]: 8 * (self.width + 4) * max(self.classes, 1) + 256 for r in f.models.select("__t").toLocalIterator()}
        trees = None
        if f.forest is not None:
            trees = attach(f.forest.trees, f.models.select(*f.keys, "__t"), f.keys, "inner", len(sizes)) if f.keys else f.forest.trees.withColumn("__t", f.models.select("__t").scalar())
            weigh = trees.groupBy("__t").agg(F.sum(F.size("node") * 24 + F.size("leaf") * 8 * (1 + self.classes) + 256).alias("b"))
            for r in weigh.toLocalIterator():
                sizes[r["__t"]] += r["b"]
        block, held = [], 0
        for t, size in sorted(sizes.items()):
            if block and held + size > BLOCK_BYTES:
                yield self._plain(block, trees)
                block, held = [], 0
            block.append(t)
            held += size
        if block:
            yield self._plain(block, trees)

    def _plain(self, numbers: list[int], trees: DataFrame | None) -> list[dict]:
        lo, hi = numbers[0], numbers[-1]
        out = {}
        for r in self.fitted.models.where(F.col("__t").between(lo, hi)).toLocalIterator():
            model = {"t": r["__t"], "fill": np.array(r["fill"], dtype=float)}
            if self.kind == "logistic":
                model |= {"weights": np.array(r["weights"]).reshape(self.classes, -1), "counts": np.array(r["counts"])}
            elif self.kind == "linear":
                model |= {"beta": np.array(r["beta"], dtype=float), "offset": float(r["offset"])}
            else:
                model["trees"] = []
            out[r["__t"]] = model
        if trees is not None:
            for r in trees.where(F.col("__t").between(lo, hi)).orderBy("__t", "tree").toLocalIterator():
                out[r["__t"]]["trees"].append(forests._plain(r, self.classes))
        return [out[t] for t in sorted(out)]

    def score(self, df: DataFrame, asked: Column | None = None, record: str = "id") -> DataFrame:
        """``keys, record, score, n`` over all models: for each model one row with null ``record``, the sum of the scores and the number of records, and a row with the score
        of each record for which ``asked`` holds (``n`` is 0 there). One scan of ``df`` for each block of models."""
        f = self.fitted
        rows = bin_columns(df, self.meta, keep_null=True)
        rows = rows.select(
            open_vector(self.known).alias("features"), self._target().alias("label"), (F.lit(False) if asked is None else asked).alias("asked"), F.col(record).cast("string").alias("record")
        )
        if self.strict:
            self._check(bin_columns(df, self.meta, keep_null=True))
        parts = []
        for models in self._blocks():
            block = df.sparkSession.sparkContext.broadcast(models)
            parts.append(rows.mapInArrow(_score_block(self.kind, block, self.classes, self.width), "__t long, record string, score double, n long"))
        if not parts:
            none = f.models.where("false").select("__t", F.lit("").alias("record"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("n"))
            parts = [none]
        both = durable(reduce(DataFrame.unionByName, parts))
        sums = both.where("record is null").groupBy("__t", "record").agg(F.sum("score").alias("score"), F.sum("n").alias("n"))
        every = sums.unionByName(both.where("record is not null"))
        return attach(every, f.models.select("__t", *f.keys), ["__t"], "inner", f.models.count()).select(*f.keys, "record", "score", "n")

    def predict(self, df: DataFrame) -> DataFrame:
        """Input rows with ``predicted``, by the one model of a fit without keys: a label, or a number for the linear task.

        The label column may be null in the input; its own nulls are not filled.
        """
        f = self.fitted
        if f.keys:
            raise ValueError("predict is for one table; score works on many")
        rows = durable(df).withColumn("__row", F.monotonically_increasing_id())
        vector = F.zip_with(open_vector(self.known), F.col("__fill"), lambda v, fill: F.coalesce(v, fill))
        coded = bin_columns(rows, self.meta, keep_null=True).withColumn("__fill", f.models.select("fill").scalar())
        coded = coded.select(F.col("__row").alias("row"), vector.alias("features"))
        c = self.meta[self.label]
        if self.kind == "forest":
            probs = forests.probabilities(f.forest, coded, self.width)
            found = probs.select("row", code_label(likeliest(F.col("probs")), c.labels).alias("predicted"))
        elif self.kind == "logistic":
            found = Logistic(self.classes).predict(coded, f.models).select("row", code_label(F.col("guess"), c.labels).alias("predicted"))
        else:
            model = coded.crossJoin(F.broadcast(f.models.select("beta", "offset")))
            dot = F.aggregate(F.zip_with("features", "beta", lambda x, b: x * b), F.lit(0.0), lambda a, v: a + v)
            found = model.select("row", (dot + F.col("offset")).alias("predicted"))
        return rows.join(found.withColumnRenamed("row", "__row"), "__row", "left").drop("__row")

    def evaluate(self, df: DataFrame, keep: Sequence[str] = ("id",)) -> DataFrame:
        """``score`` per record: 1/0 for a right or wrong label, or the residual of the linear task."""
        out = self.predict(df)
        real = F.col(f"`{self.label}`")
        if self.kind == "linear":
            return out.select(*keep, (real.cast("double") - F.col("predicted")).alias("score"))
        return out.select(*keep, F.coalesce((real == F.col("predicted")).cast("double"), F.lit(0.0)).alias("score"))
