"""Rates, advantages and gains from result facts. Facts are flat: one row per guess or score."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import camel
from veilgauge.operators.joining import attach
from veilgauge.operators.quantiles import spread

RAW = "Raw"
LINKAGE_BY = ("dataset", "target_id", "model", "feature_set", "run")


def rate(value: Column, where: Column) -> Column:
    """Mean of ``value`` over the rows that satisfy ``where``; null without such rows."""
    return F.avg(F.when(where, value.cast("double")))


def linkage_gain(facts: DataFrame, by: Sequence[str] = LINKAGE_BY) -> DataFrame:
    """``tp, fp, advantage_syn, advantage_raw, privacy_gain`` of membership guesses (``secret, guess``)."""
    hit = F.col("guess") == 1
    out = facts.groupBy(*by).agg(
        rate(hit, F.col("secret") == 1).alias("tp"), rate(hit, F.col("secret") == 0).alias("fp")
    )
    out = out.withColumn("advantage_syn", F.col("tp") - F.col("fp")).withColumn("advantage_raw", F.lit(1.0))
    return out.withColumn("privacy_gain", F.col("advantage_raw") - F.col("advantage_syn"))


def inference_gain(facts: DataFrame, truth: DataFrame | None = None) -> DataFrame:
    """Attribute-inference advantage of every model against the raw table of the same game.

    ``facts`` hold ``dataset, target_id, attribute, model, run, guess, prob_correct, presence, numeric`` and
    ``target_secret``, or the latter is looked up in ``truth (target_id, attribute, target_secret)``. Label attributes
    are scored by correct guesses, numeric ones by likelihood capped at 1.
    """
    if truth is not None:
        facts = attach(facts, truth, ["target_id", "attribute"], "inner")
    score = F.when(F.col("numeric"), F.least(F.col("prob_correct"), F.lit(1.0))).otherwise(
        (F.col("guess") == F.col("target_secret")).cast("double")
    )
    by = ["dataset", "target_id", "attribute", "run"]
    rates = facts.groupBy(*by, "model").agg(
        rate(score, F.col("presence") == 1).alias("p_in"), rate(score, F.col("presence") == 0).alias("p_out")
    )
    # One reduced row per game and model: the raw branch is spread over its game instead of joined back.
    raw = F.struct("p_in", "p_out")
    games = rates.groupBy(*by).agg(
        F.max(F.when(F.col("model") == RAW, raw)).alias("raw"),
        F.collect_list(F.when(F.col("model") != RAW, F.struct("model", "p_in", "p_out"))).alias("models"),
    )
    out = games.where("raw is not null").select(*by, "raw", F.explode("models").alias("m"))
    out = out.select(
        *by, F.col("m.model").alias("model"),
        F.col("raw.p_in").alias("p_raw_in"), F.col("raw.p_out").alias("p_raw_out"),
        (F.col("raw.p_in") - F.col("raw.p_out")).alias("advantage_raw"),
        F.col("m.p_in").alias("p_syn_in"), F.col("m.p_out").alias("p_syn_out"),
        (F.col("m.p_in") - F.col("m.p_out")).alias("advantage_syn"),
    )
    return out.withColumn("privacy_gain", F.col("advantage_raw") - F.col("advantage_syn"))


def utility_records(facts: DataFrame) -> DataFrame:
    """Mean score of each test record over copies (``score`` per ``dataset, task, model, run, target_id, record_id``)."""
    return facts.groupBy("dataset", "task", "model", "run", "target_id", "record_id").agg(F.avg("score").alias("accuracy"))


def utility_totals(facts: DataFrame) -> DataFrame:
    """Mean score over copies and test records per game."""
    return facts.groupBy("dataset", "task", "model", "run", "target_id").agg(F.avg("score").alias("accuracy"))


def utility_advantage(facts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score with the target in the training table minus the score without it."""
    out = facts.groupBy(*by).agg(
        rate(F.col("score"), F.col("presence") == 1).alias("p_in"), rate(F.col("score"), F.col("presence") == 0).alias("p_out")
    )
    return out.withColumn("utility_advantage", F.col("p_in") - F.col("p_out"))


def probability_removed(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``1 - mean(after)`` over records that were linkable before."""
    return facts.groupBy(*by).agg((F.lit(1.0) - rate(F.col("after"), F.col("before") == 1)).alias("prob_removed"))


def membership_gain(probability: Column) -> Column:
    """Gain measured from the attacker's probability of a correct guess."""
    return 2 * (1 - probability)


def accuracy(facts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Share of predictions that equal the label."""
    return facts.groupBy(*by).agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def average_gain(gains: DataFrame, feature_set: str | None = None) -> DataFrame:
    """Mean privacy gain per model and target, optionally for one feature set."""
    rows = gains if feature_set is None else gains.where(F.col("feature_set") == feature_set)
    return rows.groupBy("model", "target_id").agg(F.avg("privacy_gain").alias("privacy_gain"), F.count("*").alias("games"))


LETTERS = (0.125, 0.25, 0.5, 0.75, 0.875)


def accuracy_spread(totals: DataFrame) -> DataFrame:
    """Mean and letter-value quantiles of accuracy per model and label over games without a target."""
    by = ["model", "label_var"]
    rows = totals.where(F.col("target_id") == "OUT")
    quantile_of = spread(rows, "accuracy", LETTERS, by)
    means = rows.groupBy(*by).agg(F.avg("accuracy").alias("mean"))
    out = attach(means, quantile_of, by)
    return out.select(*by, "mean", *[F.col(f"q{i}").alias(f"q{int(q * 1000)}") for i, q in enumerate(LETTERS)])


def camel_names(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, camel(F.col(col)))
