"""Result facts to nested JSON files and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veilgauge.functions.encoding import camel
from veilgauge.operators.joining import attach, hold

# File prefixes and prediction model names of result files.
LINKAGE, INFERENCE = "ResultsMIA_", "ResultsMLEAI_"
UTILITY_TARGETS, UTILITY_TOTALS = "ResultsUtilTargets_", "ResultsUtilAgg_"
PREDICTION_MODELS = ("RandomForestClassifier", "LogisticRegression", "LinearRegression")

LINE_ROWS = 65536  # a leaf with more rows becomes several lines

_LINKAGE_LEAF = "struct<Secret:array<int>,AttackerGuess:array<int>>"
_INFERENCE_LEAF = "struct<AttackerGuess:array<string>,ProbCorrect:array<double>,TargetPresence:array<int>>"
_TARGET_LEAF = "struct<TestRecordID:array<string>,Accuracy:array<double>>"
_TOTAL_LEAF = "struct<TargetID:array<string>,Accuracy:array<double>>"


def _maps(depth: int, leaf: str) -> str:
    return "map<string," * depth + leaf + ">" * depth


def _read(spark: SparkSession, folder: str, prefix: str, levels: list[str], leaf: str, lines: bool) -> DataFrame:
    """One row per leaf, with the dataset name taken from the path.

    ``<prefix><dataset>.json`` is one document in one file, or with ``lines`` a file or folder of JSON lines, each of
    them a document with part of the results.
    """
    text = spark.read.text(f"{folder}/{prefix}*.json", wholetext=not lines)
    name = F.regexp_extract(F.input_file_name(), r"_([^_/]*)\.json(?:/|$)", 1)
    df = text.select(name.alias("dataset"), F.from_json("value", _maps(len(levels), leaf)).alias("v"))
    for level in levels:
        df = df.select(*[c for c in df.columns if c != "v"], F.explode("v").alias(level, "v"))
    return df


def read_linkage(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    leaves = _read(spark, folder, LINKAGE, ["target_id", "model", "run", "feature_set"], _LINKAGE_LEAF, lines)
    return leaves.select(
        "dataset", "target_id", "model", "run", "feature_set", F.inline(F.arrays_zip("v.Secret", "v.AttackerGuess")).alias("secret", "guess")
    )


def read_inference(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    leaves = _read(spark, folder, INFERENCE, ["target_id", "attribute", "model", "run"], _INFERENCE_LEAF, lines)
    zipped = F.arrays_zip("v.AttackerGuess", "v.ProbCorrect", "v.TargetPresence")
    return leaves.select("dataset", "target_id", "attribute", "model", "run", F.inline(zipped).alias("guess", "prob_correct", "presence"))


def _task_columns() -> list[Column]:
    known = "|".join(PREDICTION_MODELS)
    return [
        F.regexp_extract("task", f"({known})", 1).alias("prediction_model"),
        camel(F.regexp_extract("task", f"(?:{known})(.*)$", 1)).alias("label_var"),
    ]


def read_utility_targets(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    leaves = _read(spark, folder, UTILITY_TARGETS, ["task", "model", "run", "target_id"], _TARGET_LEAF, lines)
    zipped = F.arrays_zip("v.TestRecordID", "v.Accuracy")
    rows = leaves.select("dataset", "task", "model", "run", "target_id", F.inline(zipped).alias("record_id", "accuracy"))
    return rows.select(*rows.columns, *_task_columns())


def read_utility_totals(spark: SparkSession, folder: str, lines: bool = False) -> DataFrame:
    leaves = _read(spark, folder, UTILITY_TOTALS, ["task", "model"], _TOTAL_LEAF, lines)
    rows = leaves.select("dataset", "task", "model", F.inline(F.arrays_zip("v.TargetID", "v.Accuracy")).alias("target_id", "accuracy"))
    return rows.select(*rows.columns, *_task_columns())


def _pieces(facts: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct rows of each leaf with ``__n``, how often they occur, and ``__part``, the line of the leaf that they go to.

    Equal rows are counted first, and one that occurs very often is cut. The rest of a leaf is spread over as many slots as it needs and cut there
    by a running position. So no line holds more than ``LINE_ROWS`` rows and no task more than a few of them, however large a leaf is.
    """
    half, rest = max(1, LINE_ROWS // 2), [c for c in facts.columns if c not in keys]
    counted = facts.groupBy(*facts.columns).agg(F.count("*").alias("__all"))
    starts = F.sequence(F.lit(0).cast("bigint"), F.col("__all") - 1, F.lit(half).cast("bigint"))
    cut = counted.withColumn("__at", F.explode(starts)).withColumn("__n", F.least(F.lit(half).cast("bigint"), F.col("__all") - F.col("__at")))
    sizes = counted.groupBy(*keys).agg(F.ceil(F.sum("__all") / half).alias("__slots"))
    slot = F.pmod(F.xxhash64(*[F.col(c) for c in rest], "__at"), F.col("__slots"))
    placed = attach(cut, sizes, keys).withColumn("__slot", slot)
    before = Window.partitionBy(*keys, "__slot").orderBy(*rest, "__at").rowsBetween(Window.unboundedPreceding, -1)
    line = F.floor(F.coalesce(F.sum("__n").over(before), F.lit(0)) / half)
    return placed.withColumn("__part", F.struct("__slot", line.alias("line"))).drop("__all", "__at", "__slots", "__slot")


def _nest(facts: DataFrame, levels: list[str], leaf: Column, lines: bool) -> DataFrame:
    """Fold flat rows into nested maps, innermost level first.

    With ``lines`` a document is a leaf or, if it is long, a part of one: the reader puts the parts together. Otherwise a dataset becomes a single
    document, as the one-file format demands.
    """
    if lines:
        df = _pieces(facts, ["dataset", *levels]).groupBy("dataset", *levels, "__part").agg(leaf.alias("v"))
        value = F.col("v")
        for level in reversed(levels):
            value = F.create_map(F.col(level).cast("string"), value)
        return df.select("dataset", F.to_json(value).alias("value"))
    df = facts.withColumn("__n", F.lit(1)).groupBy("dataset", *levels).agg(leaf.alias("v"))
    for i in range(len(levels) - 1, -1, -1):
        entries = F.map_from_entries(F.collect_list(F.struct(F.col(levels[i]).cast("string").alias("k"), "v")))
        df = df.groupBy("dataset", *levels[:i]).agg(entries.alias("v"))
    return df.select("dataset", F.to_json("v").alias("value"))


def _leaves(facts: DataFrame, levels: list[str], order: list[str], lines: bool, **cols: str) -> DataFrame:
    return _nest(facts.select("dataset", *levels, *cols.values()), levels, _zipped(order, **cols), lines)


def _zipped(order: list[str], **cols: str) -> Column:
    """Struct of parallel arrays, in a fixed order of rows, each row as often as its ``__n`` says."""
    counted = F.sort_array(F.collect_list(F.struct(*[F.col(c) for c in dict.fromkeys([*order, *cols.values()])], "__n")))
    rows = F.flatten(F.transform(counted, lambda row: F.array_repeat(row, row["__n"].cast("int"))))
    return F.struct(*[F.transform(rows, _field(c)).alias(name) for name, c in cols.items()])


def _field(name: str):
    return lambda row: row[name]


def linkage_documents(facts: DataFrame, lines: bool = True) -> DataFrame:
    """``dataset, value``: JSON documents of membership guesses."""
    return _leaves(facts, ["target_id", "model", "run", "feature_set"], ["secret", "guess"], lines, Secret="secret", AttackerGuess="guess")


def inference_documents(facts: DataFrame, lines: bool = True) -> DataFrame:
    cols = {"AttackerGuess": "guess", "ProbCorrect": "prob_correct", "TargetPresence": "presence"}
    return _leaves(facts, ["target_id", "attribute", "model", "run"], ["presence"], lines, **cols)


def utility_target_documents(facts: DataFrame, lines: bool = True) -> DataFrame:
    return _leaves(facts, ["task", "model", "run", "target_id"], ["record_id"], lines, TestRecordID="record_id", Accuracy="accuracy")


def utility_total_documents(facts: DataFrame, lines: bool = True) -> DataFrame:
    return _leaves(facts, ["task", "model"], ["target_id"], lines, TargetID="target_id", Accuracy="accuracy")


DOCUMENTS = {
    LINKAGE: linkage_documents,
    INFERENCE: inference_documents,
    UTILITY_TARGETS: utility_target_documents,
    UTILITY_TOTALS: utility_total_documents,
}


def write_json(facts: DataFrame, folder: str, prefix: str, lines: bool = True, mode: str = "error") -> list[str]:
    """``<prefix><dataset>.json`` per dataset, written by the executors. Returns the dataset names."""
    docs = hold(DOCUMENTS[prefix](facts, lines))
    names = sorted(r[0] for r in docs.select("dataset").distinct().collect())
    for name in names:
        docs.where(F.col("dataset") == name).select("value").write.mode(mode).text(f"{folder}/{prefix}{name}.json")
    return names
