"""Membership attack: guess from the features of a published table whether a target was in the raw one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.ml.classification import LinearSVC, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.operators import forests
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.learners import Logistic, clean, platt
from veilgauge.operators.neighbours import nearest

KINDS = ("forest", "logistic", "svc", "knn", "mlp")
# Kinds whose attacks on many targets are fitted in the same jobs.
GROUPED = ("forest", "logistic")
FOLDS = 5


def as_vector(df: DataFrame) -> DataFrame:
    """Feature arrays as vectors; a feature that is undefined for a table (too few rows) counts as 0."""
    return df.withColumn("vector", array_to_vector(clean(F.col("features"))))


@dataclass
class MembershipAttack:
    """One training row per published table: ``features`` and ``label`` (1 when the target was in).

    Defaults follow the usual settings of such classifiers: 100 deep trees, unit regularisation strength, 5
    neighbours, one hidden layer of 200. ``options``: ``numTrees`` and ``maxDepth`` of forests, ``penalty`` and ``maxIter`` of the logistic attack, ``k`` of
    the nearest neighbours, and those of Spark ML for the others.

    Forests and logistic attacks take ``keys``: one attack for each of them, all fitted in the same jobs.
    """

    kind: str = "forest"
    seed: int = 42
    options: dict = field(default_factory=dict)
    model: object = None
    train: DataFrame | None = None
    keys: tuple[str, ...] = ()
    width: int = 0
    id_col: str = "dataset_id"

    def __post_init__(self):
        if self.kind not in KINDS:
            raise ValueError(f"unknown attack {self.kind!r}; one of {KINDS}")

    def _logistic(self) -> Logistic:
        return Logistic(2, self.options.get("penalty", 1.0), self.options.get("maxIter", 10))

    def _estimator(self, n: int):
        common = {"featuresCol": "vector", "labelCol": "label"}
        if self.kind == "svc":
            return LinearSVC(**common, **({"regParam": 1 / n, "standardization": False} | self.options))
        layers = [self.width, 200, 2]
        return MultilayerPerceptronClassifier(**common, layers=layers, solver="l-bfgs", seed=self.seed, **self.options)

    def fit(self, vectors: DataFrame, id_col: str = "dataset_id", keys: Sequence[str] = ()) -> MembershipAttack:
        """``id_col`` tells the training tables apart."""
        if keys and self.kind not in GROUPED:
            raise ValueError(f"attack {self.kind!r} is fitted for one target at a time")
        self.keys, self.id_col = tuple(keys), id_col
        if self.kind == "knn":
            self.train = vectors.select(F.col(id_col).cast("string").alias("train_id"), clean(F.col("features")).alias("features"), "label")
            return self
        rows = durable(vectors.select(*keys, F.col(id_col).cast("string").alias("row"), clean(F.col("features")).alias("features"), F.col("label").cast("int").alias("label")))
        n, self.width = rows.agg(F.count("*"), F.max(F.size("features"))).first()
        if not n:
            raise ValueError("no tables to train on")
        if self.kind == "forest":
            trees, depth = self.options.get("numTrees", 100), self.options.get("maxDepth", 30)
            self.model = forests.grow(rows, keys, self.width, 2, trees, depth, self.seed)
        elif self.kind == "logistic":
            self.model = self._logistic().fit(rows, keys)
        else:
            self.train = rows
            self.model = self._spark(rows, n)
        return self

    def _spark(self, rows: DataFrame, n: int):
        # The labels are named, so that tables of one kind only are still those of a question with two answers.
        label = F.col("label").cast("double").alias("label", metadata={"ml_attr": {"type": "nominal", "name": "label", "vals": ["0", "1"]}})
        return self._estimator(n).fit(as_vector(rows).select("vector", label))

    def _neighbours(self, vectors: DataFrame, id_col: str) -> DataFrame:
        k = self.options.get("k", 5)
        test = vectors.select(F.col(id_col).alias("test_id"), clean(F.col("features")).alias("features"))
        return nearest(test, self.train, k, "test_id", "train_id")

    def score(self, vectors: DataFrame, id_col: str = "dataset_id") -> DataFrame:
        """Input rows with ``model_guess`` and, where the classifier has one, ``p_in``: the probability of membership; both are null where a target has no attack.

        ``id_col`` identifies a row (needed by the nearest-neighbour attack only).
        """
        vectors = vectors.drop("p_in", "model_guess")
        if self.kind == "knn":
            near = self._neighbours(vectors, id_col).groupBy("test_id").agg(F.avg(F.col("label").cast("double")).alias("p_in"))
            near = near.withColumn("model_guess", (F.col("p_in") > 0.5).cast("int"))
            return vectors.join(near.withColumnRenamed("test_id", id_col), id_col)
        if self.kind == "logistic":
            out = self._logistic().predict(vectors, self.model, self.keys)
            p = F.element_at("probs", 2)
            return out.withColumns({"p_in": p, "model_guess": (F.round(p, 9) > 0.5).cast("int")}).drop("probs", "guess")
        if self.kind == "forest":
            rows = durable(vectors).withColumn("__row", F.monotonically_increasing_id())
            asked = rows.select(*self.keys, F.col("__row").alias("row"), clean(F.col("features")).alias("features"))
            probs = forests.probabilities(self.model, asked, self.width)
            out = rows.join(probs.select(F.col("row").alias("__row"), F.element_at("probs", 2).alias("p_in")), "__row", "left")
            return out.withColumn("model_guess", (F.round("p_in", 9) > 0.5).cast("int")).drop("__row")
        out = self.model.transform(as_vector(vectors))
        out = out.withColumn("model_guess", F.round("prediction").cast("int"))
        if "probability" in out.columns:
            # A classifier that saw one class only has no cell for the other.
            p = F.coalesce(F.try_element_at(vector_to_array("probability"), F.lit(2)), F.lit(0.0))
        else:
            p = F.lit(None).cast("double")
        return out.withColumn("p_in", p).drop("vector", "prediction", "rawPrediction", "probability")

    def attack(self, vectors: DataFrame, id_col: str = "dataset_id", linked: str | None = None) -> DataFrame:
        """``guess`` and ``guess_source``: a unique link in column ``linked`` decides, else the classifier."""
        out = self.score(vectors, id_col)
        link = F.col(linked) if linked else F.lit(None).cast("int")
        return out.withColumn("guess", F.coalesce(link, F.col("model_guess"))).withColumn(
            "guess_source", F.when(link.isNotNull(), F.lit("linkage")).otherwise(F.lit("model"))
        )

    def held_out_margins(self) -> DataFrame:
        """``margin, label`` of the training tables of a support vector attack, each from a machine that did not see it: tables are dealt into folds by
        their id."""
        fold = F.pmod(F.crc32(F.col("row").cast("binary")), F.lit(FOLDS))
        parts = []
        for k in range(FOLDS):
            rest = self.train.where(fold != k)
            n, kinds = rest.agg(F.count("*"), F.count_distinct("label")).first()
            if kinds == 2:
                machine = self._spark(rest, n)
                raw = F.element_at(vector_to_array("rawPrediction"), 2)
                parts.append(machine.transform(as_vector(self.train.where(fold == k))).select(raw.alias("margin"), "label"))
        if not parts:
            return self.train.where("false").select(F.lit(0.0).alias("margin"), "label")
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return durable(out.coalesce(FOLDS))  # a row for each training table

    def _curve(self) -> DataFrame:
        """``slope, offset`` of Platt's calibration. Held-out margins that do not have both kinds tell no slope: the minimum is then at a flat curve, the share of members drawn in
        as Platt's labels are, ``(n1 + 1) / (n + 2)``."""
        curve = platt(self.held_out_margins())
        flat = self.train.agg(F.lit(0.0).alias("slope"), F.ln((F.count_if(F.col("label") == 1) + 1) / (F.count_if(F.col("label") == 0) + 1)).alias("offset"))
        return flat if curve.isEmpty() else curve

    def confidence(self, vectors: DataFrame, id_col: str = "dataset_id", secret: str = "label") -> DataFrame:
        """``confidence``: probability given to the true secret. A support vector attack gets its probabilities from Platt's calibration of held-out margins."""
        if self.kind == "svc":
            curve = self._curve()
            raw = F.element_at(vector_to_array("rawPrediction"), 2)
            scored = self.model.transform(as_vector(vectors)).withColumn("__m", raw).drop("vector", "prediction", "rawPrediction")
            scored = scored.crossJoin(F.broadcast(curve))  # one row
            out = scored.withColumn("p_in", 1 / (1 + F.exp(-(F.col("slope") * F.col("__m") + F.col("offset"))))).drop("__m", "slope", "offset")
        else:
            out = self.score(vectors, id_col)
        return out.withColumn("confidence", F.when(F.col(secret) == 1, F.col("p_in")).otherwise(1 - F.col("p_in")))


def train_many(attack_of, groups: Sequence, threads: int = 4) -> list:
    """Fit several small attacks at once from a bounded driver pool; every fit is its own set of Spark jobs."""
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(max_workers=max(1, threads)) as pool:
        return list(pool.map(attack_of, groups))
