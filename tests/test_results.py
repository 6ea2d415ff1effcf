import json

import pytest
from pyspark.sql import functions as F

from veilgauge.operators import evaluate
from veilgauge.plans.games import GameConfig, publishers_from
from veilgauge.plans.population import META, WIDE
from veilgauge.sources import results, tables

FACTS = [("d", "t1", "M", "0", "Naive", s, g) for s, g in ((0, 1), (0, 0), (1, 1), (1, 1))] + [("d", "t2", "M", "0", "Naive", 0, 0)]
SCHEMA = "dataset string, target_id string, model string, run string, feature_set string, secret int, guess int"


def test_reads_one_document_per_file(spark, tmp_path):
    doc = {"t1": {"BayesianNet": {"0": {"Naive": {"Secret": [0, 1], "AttackerGuess": [1, 1]}}}}}
    (tmp_path / "ResultsMIA_texas.json").write_text(json.dumps(doc, indent=2))
    got = results.read_linkage(spark, str(tmp_path)).orderBy("secret").collect()
    assert [tuple(r) for r in got] == [("texas", "t1", "BayesianNet", "0", "Naive", 0, 1), ("texas", "t1", "BayesianNet", "0", "Naive", 1, 1)]


@pytest.mark.parametrize("lines", [True, False])
def test_linkage_round_trip(spark, tmp_path, lines):
    facts = spark.createDataFrame(FACTS, SCHEMA)
    folder = str(tmp_path / "out")
    assert results.write_json(facts, folder, results.LINKAGE, lines=lines) == ["d"]
    back = results.read_linkage(spark, folder, lines=lines)
    assert sorted(map(tuple, back.select(*facts.columns).collect())) == sorted(map(tuple, facts.collect()))


def test_long_leaves_become_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(results, "LINE_ROWS", 10)
    rows = [("d", "t", "M", "0", "Naive", i % 2, 0) for i in range(500)] + [("d", "t", "M", "0", "Naive", 0, g) for g in range(70)]
    rows += [("d", None, "M", "1", "Naive", None, 1), ("e", "u", "M", "1", "Naive", 1, 1)]
    facts = spark.createDataFrame(rows, SCHEMA).na.fill({"target_id": "none"})
    folder = str(tmp_path / "out")
    results.write_json(facts.repartition(5), folder, results.LINKAGE)
    documents = spark.read.text(f"{folder}/*.json").collect()
    sizes = [len(json.loads(r.value)[t][m][run][f]["Secret"]) for r in documents for t, m, run, f in [_path(json.loads(r.value))]]
    assert sum(sizes) == len(rows) and max(sizes) <= 10 and len(sizes) >= 58
    back = results.read_linkage(spark, folder, lines=True).select(*facts.columns)
    assert sorted(map(str, back.collect())) == sorted(map(str, facts.collect()))
    assert results.linkage_documents(facts.limit(0)).isEmpty()


def _path(document):
    """The only key of each level."""
    out = []
    for _ in range(4):
        (key, document), = document.items()
        out.append(key)
    return out


def test_other_files_round_trip(spark, tmp_path):
    folder = str(tmp_path / "out")
    inf = spark.createDataFrame([("d", "t", "RACE", "Raw", "0", "white", 0.5, 1)], "dataset string, target_id string, attribute string, model string, run string, guess string, prob_correct double, presence int")
    results.write_json(inf, folder, results.INFERENCE)
    assert results.read_inference(spark, folder, lines=True).select(*inf.columns).collect() == inf.collect()
    tgt = spark.createDataFrame([("d", "RandomForestClassifierRISK_MORTALITY", "Raw", "0", "OUT", "ID1", 1.0)], "dataset string, task string, model string, run string, target_id string, record_id string, accuracy double")
    results.write_json(tgt, folder, results.UTILITY_TARGETS)
    row = results.read_utility_targets(spark, folder, lines=True).first()
    assert (row["prediction_model"], row["label_var"], row["accuracy"]) == ("RandomForestClassifier", "RiskMortality", 1.0)
    tot = spark.createDataFrame([("d", "LinearRegressionAge", "Raw", "OUT", 0.25)], "dataset string, task string, model string, target_id string, accuracy double")
    results.write_json(tot, folder, results.UTILITY_TOTALS)
    row = results.read_utility_totals(spark, folder, lines=True).first()
    assert (row["label_var"], row["target_id"], row["accuracy"]) == ("Age", "OUT", 0.25)


def test_linkage_gain_and_empty_sides(spark):
    got = {r["target_id"]: r for r in evaluate.linkage_gain(spark.createDataFrame(FACTS, SCHEMA)).collect()}
    assert (got["t1"]["tp"], got["t1"]["fp"], got["t1"]["privacy_gain"]) == (1.0, 0.5, 0.5)
    assert got["t2"]["tp"] is None and got["t2"]["privacy_gain"] is None


def test_inference_gain_caps_densities(spark):
    cols = "dataset string, target_id string, attribute string, model string, run int, guess string, prob_correct double, presence int, numeric boolean, target_secret string"
    rows = [("d", "t", "a", m, 0, "x", p, s, True, "1") for m, p, s in (("Raw", 9.0, 1), ("Raw", 0.5, 0), ("M", 0.25, 1), ("M", 0.25, 0))]
    got = evaluate.inference_gain(spark.createDataFrame(rows, cols)).first()
    assert (got["p_raw_in"], got["advantage_raw"], got["advantage_syn"], got["privacy_gain"]) == (1.0, 0.5, 0.0, 0.5)


def test_run_configurations():
    doc = {
        "nIter": 2, "sizeRawT": 50, "nSynT": 3, "nTargets": 0, "Targets": ["ID1"],
        "generativeModels": {"BayesianNet": [[25, 1]], "PrivBayes": [[25, 1, 1.0]], "IndependentHistogram": [[]]},
        "sanitisationTechniques": {"SanitiserNHS": [[10, 1, 0.99, 10, [], ["status", "year"]]]},
        "sensitiveAttributes": {"total": "LinReg"}, "utilityTasks": {"RandForestClass": [["segment"]]},
        "dataFilter": {"train": "year <= 1998", "test": "year > 1998"},
    }
    c = GameConfig.from_dict(doc, META)
    assert [p.name for p in c.publishers] == ["BayesianNet", "PrivBayesEps1.0", "IndependentHistogram", "SanitiserNHSk10"]
    assert (c.n_iter, c.targets, c.sensitive, c.tasks) == (2, ("ID1",), (("total", "LinReg"),), (("RandForestClass", "segment"),))
    assert c.publishers[3].out_meta["year"].binned
    with pytest.raises(ValueError):
        publishers_from({"generativeModels": {"Unknown": [[]]}}, META)
    with pytest.raises(ValueError):
        GameConfig.from_dict({"sensitiveAttributes": {"total": "Guess"}}, META)


def test_metadata_through_a_folder(spark, tmp_path):
    tables.write_meta(spark, WIDE, str(tmp_path / "meta"))
    assert tables.read_meta(spark, str(tmp_path / "meta")) == WIDE
    (tmp_path / "one.json").write_text(json.dumps(META.to_dict(), indent=2))
    assert tables.read_meta(spark, str(tmp_path / "one.json")) == META
    with pytest.raises(ValueError):
        tables.write_meta(spark, META, str(tmp_path / "meta"), "append")
        tables.read_meta(spark, str(tmp_path / "meta"))


def test_utility_means(spark):
    cols = "dataset string, task string, model string, run int, target_id string, record_id string, score double"
    facts = spark.createDataFrame([("d", "t", "m", 0, "OUT", r, s) for r, s in (("a", 1.0), ("a", 0.0), ("b", 1.0), ("b", 1.0))], cols)
    assert {r["record_id"]: r["accuracy"] for r in evaluate.utility_records(facts).collect()} == {"a": 0.5, "b": 1.0}
    assert evaluate.utility_totals(facts).first()["accuracy"] == 0.75
    assert facts.select(evaluate.membership_gain(F.lit(0.75))).first()[0] == 0.5
