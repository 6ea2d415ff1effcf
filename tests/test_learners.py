"""Logistic and linear models of many tables, forests on raw numbers, and scoring in one scan."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgauge.meta import CATEGORICAL, FLOAT, ColumnMeta, TableMeta
from veilgauge.operators import forests, learners
from veilgauge.operators.attribute import ForestAttribute
from veilgauge.operators.predict import PredictTask

ROWS = "t string, row long, features array<double>, label int"


def tables(seed=1, n=90):
    """Tables with three classes, with two of three, with one, and with a class that is a guess."""
    rng = np.random.default_rng(seed)
    out = []
    for t, classes in (("three", [0, 1, 2]), ("two", [0, 2]), ("one", [1]), ("noise", [0, 1, 2])):
        for i in range(n):
            x = rng.normal(size=3)
            y = rng.choice(classes) if t == "noise" else classes[int(np.clip(np.floor(x[0] + 0.3 * rng.normal() + len(classes) / 2), 0, len(classes) - 1))]
            out.append((t, i, [float(v) for v in x], int(y)))
    return out


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_logistic_models_are_at_the_minimum(spark):
    rows = tables()
    df = spark.createDataFrame(rows, ROWS)
    model = learners.Logistic(3, 1.0, 12)
    found = {r["t"]: r for r in model.fit(df, ["t"]).collect()}
    assert {t: r["n"] for t, r in found.items()} == {"three": 90, "two": 90, "one": 90, "noise": 90}
    for t, r in found.items():
        x = np.array([[*v[2], 1.0] for v in rows if v[0] == t])
        y = np.array([v[3] for v in rows if v[0] == t])
        w = np.array(r["weights"]).reshape(3, 4)
        present = np.flatnonzero(np.array(r["counts"]))
        free = present[-1:] if len(present) == 2 else present if len(present) > 2 else []
        assert all((w[c] == 0).all() for c in range(3) if c not in free)
        p = softmax(x @ w[present].T)
        for c in free:
            grad = x.T @ (p[:, list(present).index(c)] - (y == c)) + w[c] * np.array([1, 1, 1, 0])
            assert np.abs(grad).max() < 1e-6
    scored = model.predict(df, model.fit(df.repartition(7), ["t"]), ["t"]).collect()
    assert all(abs(sum(r["probs"]) - 1) < 1e-9 for r in scored)
    for t, least in (("three", 0.7), ("two", 0.85), ("one", 1.0)):
        mine = [r for r in scored if r["t"] == t]
        assert np.mean([r["guess"] == r["label"] for r in mine]) >= least
    assert all(r["probs"][1] == 0 for r in scored if r["t"] == "two")


def test_logistic_of_one_table_is_the_same(spark):
    df = spark.createDataFrame(tables(), ROWS)
    model = learners.Logistic(3, 0.5, 8)
    keyed = model.fit(df, ["t"]).where("t = 'noise'").first()
    alone = model.fit(df.where("t = 'noise'")).first()
    assert np.allclose(keyed["weights"], alone["weights"], atol=1e-8)
    with_rows = model.predict(df.where("t = 'noise'"), model.fit(df.where("t = 'noise'")))
    assert with_rows.where("guess is null").count() == 0


def test_separable_tables_stay_finite(spark):
    df = spark.createDataFrame([("t", i, [float(i % 2) * 1000, None, float("nan")], i % 2) for i in range(40)], ROWS)
    model = learners.Logistic(2, 1.0, 15)
    out = model.predict(df, model.fit(df, ["t"]), ["t"])
    assert out.where("guess = label").count() == 40 and out.where("isnan(probs[0])").count() == 0


def test_sums_of_many_tasks_are_added_beforehand(spark, monkeypatch):
    df = spark.createDataFrame(tables(), ROWS)
    want = learners.Logistic(3, 1.0, 4).fit(df, ["t"]).orderBy("t").collect()
    monkeypatch.setattr(learners, "SLOTS", 2)
    got = learners.Logistic(3, 1.0, 4).fit(df.repartition(9), ["t"]).orderBy("t").collect()
    for a, b in zip(want, got):
        assert np.allclose(a["weights"], b["weights"], atol=1e-8)


def test_platt_is_at_the_minimum(spark):
    rng = np.random.default_rng(3)
    rows = [(t, float(m), int(rng.random() < 1 / (1 + np.exp(-2 * m + 0.5)))) for t in ("a", "b") for m in rng.normal(size=150)] + [("one", 1.0, 1)]
    got = {r["t"]: r for r in learners.platt(spark.createDataFrame(rows, "t string, margin double, label int"), ["t"]).collect()}
    assert set(got) == {"a", "b"}
    for t, r in got.items():
        m = np.array([v[1] for v in rows if v[0] == t])
        y = np.array([v[2] for v in rows if v[0] == t])
        n1, n0 = y.sum(), (1 - y).sum()
        soft = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
        miss = 1 / (1 + np.exp(-(r["slope"] * m + r["offset"]))) - soft
        assert abs(miss.sum()) < 1e-8 and abs((miss * m).sum()) < 1e-8 and r["slope"] > 1


def test_least_squares_like_numpy(spark):
    rng = np.random.default_rng(4)
    rows = []
    for t in ("a", "b"):
        x = rng.random((80, 3))
        x[:, 2] = x[:, 0] if t == "a" else 0.25  # repeated, or constant
        y = 4e5 + x @ [3e4, -2e4, 5e3] + rng.normal(size=80)
        rows += [(t, [float(v) for v in a], float(b)) for a, b in zip(x, y)]
    got = {r["t"]: r for r in learners.least_squares(spark.createDataFrame(rows, "t string, features array<double>, label double"), ["t"]).collect()}
    for t in ("a", "b"):
        x = np.array([[*r[1], 1.0] for r in rows if r[0] == t])
        y = np.array([r[2] for r in rows if r[0] == t])
        want = x @ np.linalg.lstsq(x, y, rcond=None)[0]
        assert np.abs(x[:, :3] @ got[t]["beta"] + got[t]["offset"] - want).max() < 1e-4


def skewed(spark, n=1500):
    """A column of which nearly all values lie in a thousandth of its range, and which decides the label there."""
    rng = np.random.default_rng(7)
    v = np.exp(rng.normal(0, 2.5, n))
    label = np.where(v > np.median(v), "yes", "no")
    pdf = pd.DataFrame({"id": range(n), "t": "a", "v": v, "g": rng.choice(["x", "y"], n), "s": label})
    pdf.loc[::97, "v"] = None
    meta = TableMeta((ColumnMeta("v", FLOAT, 0, 1e6), ColumnMeta("g", CATEGORICAL, labels=("x", "y")), ColumnMeta("s", CATEGORICAL, labels=("no", "yes"))))
    return spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))), meta, float(np.median(v))


def test_forests_see_skewed_numbers_with_and_without_keys(spark):
    df, meta, middle = skewed(spark)
    attack = ForestAttribute(meta, "s", 3, trees=8, depth=4)
    keyed = attack.guess(df, attack.fit(df, ["t"]), ["t"]).toPandas().sort_values("id")
    alone = attack.guess(df, attack.fit(df)).toPandas().sort_values("id")
    sure = keyed.v.notna() & ((keyed.v > middle * 1.15) | (keyed.v < middle / 1.15))
    for out in (keyed, alone):
        assert (out.model_guess == out.s)[sure].mean() > 0.97
    assert (keyed.model_guess == alone.model_guess)[sure].mean() > 0.97


def test_forests_do_not_depend_on_partitions(spark):
    df, meta, _ = skewed(spark)
    attack = ForestAttribute(meta, "s", 3, trees=6, depth=5)
    first, again = (attack.guess(part, attack.fit(part, ["t"]), ["t"]).toPandas().sort_values("id") for part in (df.repartition(2), df.repartition(7, "v")))
    assert (first.model_guess.values == again.model_guess.values).all() and np.allclose(first.likelihood, again.likelihood)


def test_cuts_are_values_or_quantiles(spark):
    rows = [("t", i, [float(i % 5), float(i), None if i % 2 else 3.0], 0) for i in range(1000)]
    cuts = forests.cut_points(spark.createDataFrame(rows, ROWS), ["t"], 3).first()["cuts"]
    assert cuts[0] == [0.0, 1.0, 2.0, 3.0] and cuts[2] == []
    assert np.allclose(cuts[1], [999 * j / 32 for j in range(1, 32)])


def test_drawn_features_are_even(spark):
    got = spark.range(3000).select(forests.features_of(5, ["id"], F.lit(1), 7, 3).alias("f")).collect()
    sets = [r["f"] for r in got]
    assert all(len(set(s)) == 3 and min(s) >= 0 and max(s) <= 6 for s in sets)
    counts = np.bincount(np.concatenate(sets), minlength=7)
    assert np.abs(counts - 3000 * 3 / 7).max() < 130


def test_large_forests_are_scored_in_blocks(spark, monkeypatch):
    df, meta, _ = skewed(spark, 300)
    attack = ForestAttribute(meta, "s", 3, trees=9, depth=6)
    model = attack.fit(df, ["t"])
    want = attack.guess(df, model, ["t"]).toPandas().sort_values("id")
    monkeypatch.setattr(forests, "BLOCK_BYTES", 2000)
    got = attack.guess(df, model, ["t"]).toPandas().sort_values("id")
    assert np.allclose(want.likelihood, got.likelihood) and (want.model_guess.values == got.model_guess.values).all()


@pytest.mark.parametrize("kind,label", [("forest", "s"), ("logistic", "s"), ("linear", "v")])
def test_one_scan_scores_like_each_table_alone(spark, monkeypatch, kind, label):
    from veilgauge.operators import predict

    monkeypatch.setattr(predict, "BLOCK_BYTES", 1500)
    df, meta, _ = skewed(spark, 240)
    df = df.withColumn("t", F.concat(F.lit("t"), (F.col("id") % 3).cast("string"))).withColumn("g", F.when(F.col("id") % 11 != 0, F.col("g")))
    options = {"numTrees": 5, "maxDepth": 3}
    task = PredictTask(kind, meta, label, 1, options).fit(df, ["t"], repeats=2)
    found = task.score(df, F.col("id") < 10).collect()
    totals = {(r["t"], r["repeat"]): (r["score"], r["n"]) for r in found if r["record"] is None}
    singles = {(r["t"], r["repeat"], int(r["record"])): r["score"] for r in found if r["record"] is not None}
    assert set(totals) == {(f"t{i}", j) for i in range(3) for j in range(2)} and len(singles) == 60
    if kind != "forest":
        for t in ("t0", "t2"):
            alone = PredictTask(kind, meta, label, 1, options).fit(df.where(F.col("t") == t)).evaluate(df).collect()
            known = [r["score"] for r in alone if r["score"] is not None]
            assert totals[t, 0] == totals[t, 1] == (pytest.approx(sum(known), rel=1e-6, abs=1e-4), len(known))
            for r in alone:
                if r["id"] < 10 and r["score"] is not None:
                    assert singles[t, 1, r["id"]] == pytest.approx(r["score"], rel=1e-6, abs=1e-4)
    else:
        assert totals["t0", 0] != totals["t0", 1] or totals["t1", 0] != totals["t1", 1]
        assert all(0.4 * 240 < v[0] <= 240 == v[1] for v in totals.values())


def test_variants_of_histograms_are_counted_not_copied(spark, sf_dir):
    from veilgauge.operators import sampling
    from veilgauge.operators.histogram import IndependentHistogram
    from veilgauge.plans.population import META, population_nulls

    df = population_nulls(spark, sf_dir)
    ids = sampling.pick_targets(df, 3, seed=1)
    drawn = sampling.draw(sampling.without(df, ids), 100, 5, 2)
    publisher = IndependentHistogram(META)
    plain = publisher.fit(sampling.with_targets(drawn, sampling.only(df, ids), ids, 2), ["dataset_id"]).prof
    found = publisher.fit_variants(drawn, sampling.only(df, ids), ids, 2).prof
    columns = ["dataset_id", "attr_idx", "counts", "nulls", "outside", "total", "cdf"]
    assert sorted(map(str, plain.select(columns).collect())) == sorted(map(str, found.select(columns).collect()))
    infers = IndependentHistogram(META, 10, True).fit_variants(drawn, sampling.only(df, ids), ids, 2)
    assert infers.prof.select("dataset_id").distinct().count() == 8


def test_draws_are_permutations(spark):
    from veilgauge.operators import sampling

    for total in (1, 2, 3, 17, 64, 100):
        got = spark.range(total).select(F.explode(F.sequence(F.lit(0), F.lit(1))).alias("d"), "id").select("d", sampling.shuffled(F.col("id"), total, 7, "x", "d").alias("p")).collect()
        for d in (0, 1):
            assert sorted(r["p"] for r in got if r["d"] == d) == list(range(total))
    df = spark.range(5, 2005).withColumn("v", F.col("id") * 2)
    firsts = np.array([r["id"] for r in sampling.draw(df.repartition(5), 1, 3, 1500).collect()])
    assert abs(firsts.mean() - 1004.5) < 60 and len(set(firsts.tolist())) > 900
    plan = sampling.draw(df, 10, 3, 50)._jdf.queryExecution().toString()
    assert "Generate explode" not in plan
    with pytest.raises(ValueError):
        sampling.draw(df, 2001, 3)


def test_positions_are_permuted_as_by_a_plain_network(spark):
    import hashlib

    from veilgauge.operators import sampling

    def plain(draw, position, total):
        half = max(1, -(-max(total - 1, 1).bit_length() // 2))
        value, mask = position, 2**half - 1
        while True:
            left, right = value >> half, value & mask
            for i in range(4):
                left, right = right, left ^ (int(hashlib.md5(f"7:x:{draw}:{i}:{right}".encode()).hexdigest()[:12], 16) & mask)
            value = left << half | right
            if value < total:
                return value

    for total in (1, 2, 5, 17, 64, 65, 70_000):
        rows = spark.range(min(total, 80)).selectExpr("cast(id % 2 as int) d", "id", "id p")
        got = sampling.permuted(rows, "p", total, 7, "x", "d").collect()
        assert {(r.id, r.p) for r in got} == {(r.id, plain(r.d, r.id, total)) for r in got} and len(got) == min(total, 80)
