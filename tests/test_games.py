import pytest
from pyspark.sql import functions as F

from veilgauge.operators import evaluate
from veilgauge.operators.histogram import IndependentHistogram
from veilgauge.operators.sanitise import Sanitiser
from veilgauge.plans import games
from veilgauge.plans.population import META, population

QUIDS = ("status", "priority", "segment", "year")
SAN = Sanitiser(META, 10, 0, 1, 1, (), QUIDS)


@pytest.fixture(scope="module")
def pop(spark, sf_dir):
    return games.durable(population(spark, sf_dir))


def config(**more):
    base = {"n_iter": 1, "size_raw_a": 400, "size_raw_t": 120, "size_syn_t": 120, "n_shadows": 2, "n_syn_a": 2, "n_syn_t": 2, "targets": (3, 9)}
    return games.GameConfig(**{**base, **more})


def test_linkage_game(pop):
    c = config(publishers=(IndependentHistogram(META), SAN), feature_sets=("Histogram",), attack_options=(("numTrees", 5), ("maxDepth", 4)))
    facts = games.linkage_game(pop, META, c).toPandas()
    syn = facts[facts.model == "IndependentHistogram"]
    assert len(syn) == 2 * 2 * 2 and set(syn.guess_source) == {"model"}
    san = facts[facts.model == SAN.name]
    assert set(san.feature_set) == {"Histogram", "Ensemble"} and len(san) == 2 * 2 * 2
    # Nothing is suppressed, so a linked target is certainly in a table it was put into.
    assert (san[san.guess_source == "linkage"].guess == 1).all()
    assert set(facts.target_id) == {"3", "9"} and set(facts.secret) == {0, 1}


def test_inference_game(pop):
    c = config(publishers=(SAN,), sensitive=(("total", "LinReg"), ("segment", "Classification")), attack_options=(("trees", 5), ("depth", 4)))
    facts = games.inference_game(pop, META, c)
    got = facts.toPandas()
    assert len(got) == 2 * 2 * 2 * 2 and set(got.model) == {"Raw", SAN.name}
    linked = got[(got.guess_source == "linkage") & (got.presence == 1) & (got.model == "Raw")]
    assert (linked.guess == linked.target_secret).all() and (linked.prob_correct == 1.0).all()
    gains = evaluate.inference_gain(facts)
    assert gains.count() == 4 and gains.where(F.col("privacy_gain").isNull()).count() == 0


def test_utility_game(pop):
    c = config(publishers=(SAN,), tasks=(("RandForestClass", "segment"),), targets=(3,), train="year <= 1998", test="year > 1998", n_test_records=3, n_syn_t=1, attack_options=(("trees", 5), ("depth", 4)))
    train_id = pop.where("year <= 1998").agg(F.min("id")).first()[0]
    c = games.GameConfig(**{**c.__dict__, "targets": (train_id,)})
    records, totals = games.utility_game(pop, META, c)
    assert records.count() == 3 * 2 * 2
    got = totals.collect()
    assert len(got) == 4 and {r["records"] for r in got} == {pop.where("year > 1998").count()}
    assert all(0 <= r["score"] <= 1 for r in got)


def test_utility_of_a_suppressed_table_is_null(pop):
    nothing = Sanitiser(META, 10, 0, 1, 10_000, (), QUIDS)
    train_id = pop.where("year <= 1998").agg(F.min("id")).first()[0]
    c = config(publishers=(nothing,), tasks=(("RandForestClass", "segment"),), targets=(train_id,), train="year <= 1998", test="year > 1998", n_test_records=3, n_syn_t=1, attack_options=(("trees", 2), ("depth", 2)))
    records, totals = games.utility_game(pop, META, c)
    lost = records.where(F.col("model") == nothing.name).collect()
    assert len(lost) == 3 * 2 and {r["score"] for r in lost} == {None}
    assert records.where("model = 'Raw' AND score IS NOT NULL").count() == 3 * 2
    got = totals.where(F.col("model") == nothing.name).collect()
    assert len(got) == 2 and all(r["score"] is None and r["records"] > 0 for r in got)
