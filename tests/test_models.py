import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgauge.functions.keyed import digest, uniform
from veilgauge.meta import CATEGORICAL, FLOAT, ColumnMeta, TableMeta
from veilgauge.operators import bayes, forests, joining
from veilgauge.operators.attribute import ForestAttribute, LinearAttribute, with_links
from veilgauge.operators.distributions import Binning, profile
from veilgauge.operators.gaussian import Gaussian
from veilgauge.operators.generate import candidate_keys
from veilgauge.operators.histogram import IndependentHistogram
from veilgauge.operators.membership import GROUPED, KINDS, MembershipAttack
from veilgauge.operators.mixtures import Mixture
from veilgauge.operators.neighbours import nearest
from veilgauge.operators.predict import PredictTask
from veilgauge.plans.population import META, as_tables, population


def chain(spark, n=4000):
    """a decides b nine times out of ten, b decides c; d is noise."""
    rng = np.random.default_rng(1)
    a = rng.integers(0, 3, n)
    b = np.where(rng.random(n) < 0.9, a, rng.integers(0, 3, n))
    c = np.where(rng.random(n) < 0.8, b, rng.integers(0, 3, n))
    pdf = pd.DataFrame({"a": a, "b": b, "c": c}).astype(str).assign(d=rng.random(n) * 10)
    lab = ("0", "1", "2")
    meta = TableMeta(tuple(ColumnMeta(x, "Categorical", labels=lab) for x in "abc") + (ColumnMeta("d", "Float", 0, 10),))
    return spark.createDataFrame(pdf), meta


def shares(df, col):
    total = df.count()
    return {r[0]: r["count"] / total for r in df.groupBy(col).count().collect()}


def distance(p, q):
    return sum(abs(p.get(k, 0) - q.get(k, 0)) for k in set(p) | set(q)) / 2


@pytest.mark.parametrize("infer", [False, True])
def test_histogram_marginals(spark, sf_dir, infer):
    df = population(spark, sf_dir)
    made = joining.hold(IndependentHistogram(META, 10, infer).fit(df).generate(10_000, 3))
    assert made.columns == ["copy", "row", *META.names] and made.count() == 10_000
    for col in ("status", "priority", "region"):
        assert distance(shares(df, col), shares(made, col)) < 0.05
    assert made.where("total is null or year is null").count() == 0


def test_generated_rows_do_not_depend_on_partitions(spark, sf_dir):
    model = IndependentHistogram(META).fit(population(spark, sf_dir))
    first = model.generate(300, 5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = model.generate(300, 5).collect()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert sorted(first) == sorted(again)
    assert sorted(first) != sorted(model.generate(300, 6).collect())


@pytest.mark.parametrize("degree", [1, 2])
def test_network_finds_the_chain_and_keeps_it(spark, degree):
    df, meta = chain(spark)
    model = bayes.BayesianNet(meta, 5, degree).fit(df)
    net = {r["child"]: r["parents"] for r in bayes.structure_rows(model.network, meta.names).collect()}
    assert set(net) == set(meta.names)
    if degree == 1:
        linked = {frozenset((c, p)) for c, ps in net.items() for p in ps}
        assert {frozenset("ab"), frozenset("bc")} <= linked
    made = joining.hold(model.generate(6000, 2))
    agree = made.agg(F.avg((F.col("a") == F.col("b")).cast("int"))).first()[0]
    assert abs(agree - df.agg(F.avg((F.col("a") == F.col("b")).cast("int"))).first()[0]) < 0.04


def test_rounds_agree_with_the_tree(spark, sf_dir):
    df, keys = as_tables(population(spark, sf_dir)), ["dataset_id"]
    binning = Binning(META.select(["status", "priority", "segment", "region"]), 10)
    coded = joining.durable(binning.compact(df, keys))
    facts = joining.durable(bayes.table_facts(profile(df, binning, keys), keys))
    for epsilon in (None, 0.7):
        a = bayes.tree_structure(coded, binning, facts, keys, 7, epsilon)
        b = bayes.network_structure(coded, binning, facts, keys, 7, 1, epsilon)
        assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_conditional_distributions_cover_all_parents(spark):
    df, meta = chain(spark, 300)
    model = bayes.BayesianNet(meta, 5, 2).fit(df.where("not (a = '0' and b = '2')"))
    sums = model.cpt.select("step", F.aggregate("probs", F.lit(0.0), lambda x, y: x + y).alias("s"), F.element_at("cdf", -1).alias("last"))
    assert sums.agg(F.min("s"), F.max("s")).first() == pytest.approx((1.0, 1.0))
    assert sums.where("abs(last - 1) > 1e-9").count() == 0
    sizes = model.binning.sizes
    for order, parents in model.network.select("order", "parents").collect():
        for step, ps in enumerate(parents):
            assert model.cpt.where(F.col("step") == step).count() == int(np.prod([sizes[p] for p in ps] or [1]))


def test_private_counts(spark):
    df, meta = chain(spark)
    plain = bayes.BayesianNet(meta, 5, 1).fit(df)
    loose = bayes.PrivBayes(meta, 5, 1, epsilon=1e7).fit(df, network=plain.network)
    joined = plain.cpt.select("step", "parent_code", F.col("probs").alias("p")).join(loose.cpt, ["step", "parent_code"])
    gap = joined.select(F.array_max(F.zip_with("p", "probs", lambda a, b: F.abs(a - b))).alias("g")).agg(F.max("g")).first()[0]
    assert gap < 1e-3
    tight = bayes.PrivBayes(meta, 5, 1, epsilon=1e-9)
    assert tight.name == "PrivBayesEps1e-09"
    made = tight.fit(df).generate(500, 1)
    assert made.columns == ["copy", "row", *meta.names] and made.count() == 500
    cells = bayes.cell_counts(Binning(meta, 5).compact(df), plain.network, Binning(meta, 5), [], 1, 50.0, 3)
    assert cells.agg(F.min("n")).first()[0] >= 0


def test_private_networks_of_higher_degree_for_many_tables(spark):
    df, meta = chain(spark, 400)
    df = df.withColumn("t", (F.rand(1) * 2).cast("int"))
    df = joining.durable(df)
    made = bayes.PrivBayes(meta, 4, 2, epsilon=5.0).fit(df, ["t"]).generate(50, 1, 2)
    assert made.groupBy("t", "copy").count().select("count").distinct().collect() == [(50,)]


def test_wide_domains_beside_narrow_ones(spark):
    labels = tuple(f"p{i}" for i in range(1500))
    meta = TableMeta((ColumnMeta("part", CATEGORICAL, labels=labels), ColumnMeta("even", CATEGORICAL, labels=("y", "n"))))
    df = spark.range(3000).select(F.concat(F.lit("p"), F.col("id") % 1500).alias("part"), F.when(F.col("id") % 2 == 0, "y").otherwise("n").alias("even"))
    made = bayes.BayesianNet(meta, 10, 1).fit(df).generate(500)
    assert made.where((F.substring("part", 2, 9).cast("int") % 2 == 0) == (F.col("even") == "y")).count() == 500
    with pytest.raises(ValueError):
        bayes.BayesianNet(chain(spark, 10)[1], 2**21, 2).fit(chain(spark, 50)[0])


def test_gaussian(spark, sf_dir):
    df = population(spark, sf_dir)
    made = Gaussian(META).fit(df).generate(8000, 1)
    real, got = (d.agg(F.avg("total"), F.stddev("total"), F.avg("balance")).first() for d in (df, made))
    assert got[0] == pytest.approx(real[0], rel=0.05) and got[1] == pytest.approx(real[1], rel=0.05)
    assert Gaussian(META, 2).fit(df).generate(50).count() == 50


def test_mixtures_of_many_tables(spark):
    """Well separated clouds are found, a table's model does not depend on other tables or partitions, odd rows are left out."""
    rng = np.random.default_rng(3)
    rows = []
    for t, (a, b) in {"p": (20.0, 80.0), "q": (10.0, 40.0)}.items():
        rows += [(t, float(rng.normal(a, 2)), float(rng.normal(-a, 1))) for _ in range(300)]
        rows += [(t, float(rng.normal(b, 3)), float(rng.normal(-b, 2))) for _ in range(100)]
    rows += [("p", None, 1.0), ("p", float("nan"), 1.0), ("p", 1.0, float("inf")), ("none", None, None), ("one", 5.0, 5.0), ("same", 7.0, 7.0), ("same", 7.0, 7.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    fit = Mixture(2, 1).fit
    ranges = [(0.0, 100.0), (-100.0, 0.0)]
    got = {(r["k"], r["component"]): r for r in fit(df, ["x", "y"], ranges, ["k"]).collect()}
    assert {k for k, _ in got} == {"p", "q", "one", "same"}
    for t, (a, b) in {"p": (20.0, 80.0), "q": (10.0, 40.0)}.items():
        parts = sorted((got[t, c] for c in (0, 1)), key=lambda r: r["means"][0])
        assert parts[0]["n"] == 400 and [round(p["weight"], 2) for p in parts] == [0.75, 0.25]
        assert parts[0]["means"] == pytest.approx([a, -a], abs=0.6) and parts[1]["means"] == pytest.approx([b, -b], abs=1.5)
        assert parts[0]["cov"][0] ** 0.5 == pytest.approx(2, rel=0.2)
    alone = {r["component"]: r for r in fit(df.where("k = 'q'").repartition(5), ["x", "y"], ranges).collect()}
    for c in (0, 1):
        assert alone[c]["means"] == pytest.approx(got["q", c]["means"], rel=1e-9)
    assert fit(df.limit(0), ["x", "y"], ranges, ["k"]).isEmpty()


def test_candidate_keys(spark):
    assert [r[1] for r in candidate_keys(spark, 3, "Float", 1.0, 4.0).orderBy("row").collect()] == [1.0, 2.0, 3.0]
    assert candidate_keys(spark, 40, "Categorical", prefix="k").select("key").distinct().count() == 40


# ---- attacks and tasks ----


@pytest.mark.parametrize("kind", KINDS)
def test_membership_attack_separates(spark, kind):
    rng = np.random.default_rng(2)
    data = [(str(i), [float(v) for v in rng.normal(3.0 * (i % 2), 0.3, 4)], i % 2) for i in range(60)]
    df = spark.createDataFrame(data, "dataset_id string, features array<double>, label int")
    options = {"forest": {"numTrees": 10, "maxDepth": 5}, "mlp": {"maxIter": 30}, "svc": {"maxIter": 15}}.get(kind, {})
    attack = MembershipAttack(kind, 1, options).fit(df)
    out = attack.attack(df)
    assert out.count() == 60
    assert out.where("guess = label").count() >= 57
    assert attack.confidence(df).agg(F.avg("confidence")).first()[0] > 0.8
    if kind not in GROUPED:
        with pytest.raises(ValueError):
            MembershipAttack(kind).fit(df.withColumn("target_id", F.lit("a")), keys=["target_id"])


@pytest.mark.parametrize("members, others", [(12, 0), (0, 6), (1, 9)])
def test_confidence_of_margins_of_one_kind(spark, members, others):
    data = [(str(i), [float(i), float(i < members)], int(i < members)) for i in range(members + others)]
    df = spark.createDataFrame(data, "dataset_id string, features array<double>, label int")
    got = {r["label"]: r["confidence"] for r in MembershipAttack("svc", 1, {"maxIter": 5}).fit(df).confidence(df).collect()}
    p = (members + 1) / (members + others + 2)
    assert got == {k: pytest.approx(v) for k, v, n in ((1, p, members), (0, 1 - p, others)) if n}


def test_a_unique_link_overrules_the_model(spark):
    df = spark.createDataFrame([(str(i), [float(i % 2)], i % 2) for i in range(20)], "dataset_id string, features array<double>, label int")
    attack = MembershipAttack("forest", 1, {"numTrees": 5, "maxDepth": 3}).fit(df)
    asked = df.withColumn("linked", F.when(F.col("dataset_id") == "0", 1))
    got = {r["dataset_id"]: (r["guess"], r["guess_source"]) for r in attack.attack(asked, linked="linked").collect()}
    assert got["0"] == (1, "linkage") and got["2"] == (0, "model")


def test_rows_are_sent_to_many_rings_in_small_batches():
    import pandas as pd

    from veilgauge.operators import neighbours

    rings = neighbours.Rings(np.zeros((1, 64)), np.zeros(400, int), np.zeros(400), np.ones(400), np.ones(400, int))
    batch = pd.DataFrame({"id": range(200), "features": list(np.full((200, 64), 0.5)), "__tau": np.inf})
    sent = list(neighbours._choose(rings, 5, False)([batch]))
    assert sum(map(len, sent)) == 200 * 400
    assert max(map(len, sent)) * 64 * 8 <= 8 * 2**20
    assert pd.concat(sent).groupby("__ring")["id"].nunique().eq(200).all()


@pytest.mark.parametrize("sizes", [(512, 8192, 1024), (7, 11, 10), (3, 4, 30)])
def test_nearest_equals_brute_force(spark, monkeypatch, sizes):
    from veilgauge.operators import neighbours

    for name, size in zip(("TEST_BLOCK", "TRAIN_BLOCK", "CELL_ROWS"), sizes):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(4)
    # Ties, repeated points, one very common point and far ones.
    pts = np.concatenate([rng.integers(0, 4, (60, 2)), np.full((30, 2), 9), rng.normal(1e6, 1, (20, 2))]).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in p], i % 3) for i, p in enumerate(pts)], "id int, features array<double>, label int")
    odd = spark.createDataFrame([(900, None, 1), (901, [float("nan"), 1.0], 1), (902, [None, 1.0], 1)], df.schema)
    got = {}
    for r in nearest(df.unionByName(odd), df.unionByName(odd), 5, same_table=True).collect():
        got.setdefault(r["id"], []).append((r["distance"], r["neighbour"]))
    assert len(got) == len(pts)
    for i, p in enumerate(pts):
        want = sorted((float(((p - q) ** 2).sum()), j) for j, q in enumerate(pts) if j != i)[:5]
        assert sorted(got[i]) == want
    few = {r["id"]: r["neighbour"] for r in nearest(df.where("id < 2"), df.where("id = 1"), 5, same_table=True).collect()}
    assert few == {0: 1}
    assert nearest(df, df.limit(0)).isEmpty() and nearest(df.limit(0), df).isEmpty()


def test_far_blocks_are_ruled_out_before_the_shuffle(spark, monkeypatch):
    """Of all pairs of a row and a block less than a tenth is compared when points lie in clouds."""
    from veilgauge.operators import neighbours

    monkeypatch.setattr(neighbours, "CELL_ROWS", 50)
    monkeypatch.setattr(neighbours, "TRAIN_BLOCK", 100)
    rng = np.random.default_rng(6)
    pts = rng.uniform(0, 100, (40, 3))[rng.integers(0, 40, 4000)] + rng.normal(0, 0.3, (4000, 3))
    df = spark.createDataFrame([(i, [float(v) for v in p], 0) for i, p in enumerate(pts)], "id int, features array<double>, label int")
    search = neighbours.Search(df)
    blocks = search.rows.select("__ring", "__block").distinct().count()
    exact = {}
    for r in search.nearest(df, 5, same_table=True).collect():
        exact.setdefault(r["id"], []).append(r["distance"])
    tau = spark.createDataFrame([(i, max(d)) for i, d in exact.items()], "id int, __tau double")
    late = search.visits(df.select("id", "features").join(tau, "id"), 6, False).count()
    early = search.visits(df.select("id", "features"), 6, True).count()
    assert blocks >= 40 and (early + late) / (4000 * blocks) < 0.1
    dist = ((pts[:50, None, :] - pts[None, :, :]) ** 2).sum(axis=2)
    assert all(sorted(exact[i]) == pytest.approx(sorted(dist[i])[1:6]) for i in range(50))


def _plain_nearest(rows, k):
    out = {}
    for a, x, _ in rows:
        if x is not None:
            d = sorted(((((np.array(x) - np.array(y)) ** 2).sum(), b, lab) for b, y, lab in rows if y is not None and a != b), key=lambda r: (r[0], r[1]))
            out[a] = sorted([*out.get(a, []), *d[:k]], key=lambda r: (r[0], r[1]))[:k]
    return out


@pytest.mark.parametrize("few", [0, 256])
def test_nearest_by_packs_equals_brute_force(spark, monkeypatch, few):
    """Clouds, far points, a point more common than a pack is large, ids that come twice, labels that are null; packs sent to each other and read in place."""
    from veilgauge.operators import neighbours

    for name, size in (("TRAIN_BLOCK", 20), ("CELL_ROWS", 10), ("PACK_ROWS", 25), ("FEW_TASKS", few), ("SPARSE", 1)):
        monkeypatch.setattr(neighbours, name, size)
    rng = np.random.default_rng(8)
    pts = np.concatenate([rng.integers(-50, 50, (12, 3))[rng.integers(0, 12, 150)] + rng.normal(0, 0.1, (150, 3)), np.full((70, 3), 7.0), rng.normal(0, 1e6, (10, 3))])
    rows = [(f"r{i:03}", [float(v) for v in p], None if i % 7 == 0 else i % 3) for i, p in enumerate(pts)]
    rows += rows[:160:40] + [("none", None, 1)]
    df = spark.createDataFrame(rows, "id string, features array<double>, label int").repartition(5)
    asked = {}
    for r in nearest(df, df, 4, same_table=True).collect():
        asked.setdefault(r["id"], []).append((r["distance"], r["neighbour"], r["label"]))
    want = _plain_nearest(rows, 4)
    assert asked.keys() == want.keys()
    for key, got in asked.items():
        assert [(d, b, lab) for d, b, lab in sorted(got, key=lambda r: r[:2])] == want[key], key
    # Rows of another table, ids that are the same by chance.
    other = df.where("features is not null").dropDuplicates(["id"]).select("id", "features")
    found = nearest(other.limit(30), df, 1)
    assert found.count() == 30 and found.where("distance > 0").isEmpty()


@pytest.mark.parametrize("scale, offset", [(1.0, 0.0), (1.0, 1e7), (1e-25, 0.0), (1e30, 0.0), (1e-3, -1.0)])
def test_single_precision_only_finds_candidates(scale, offset):
    from veilgauge.operators import neighbours

    rng = np.random.default_rng(9)
    points = offset + scale * np.concatenate([rng.normal(0, 1, (300, 6)), np.repeat(rng.normal(0, 1, (20, 6)), 10, axis=0)])
    n = len(points)
    codes, rank = np.arange(n), np.arange(n)[::-1]
    plain = ((points[:, None, :] - points[None, :, :]) ** 2).sum(axis=2)
    plain[codes, codes] = np.inf
    for tau in (np.full(n, np.inf), np.sort(plain, axis=1)[:, 5], np.sort(plain, axis=1)[:, 40]):
        blocks = neighbours._best(5, points, tau, lambda start, part: np.ones((len(part), 1), bool), points, np.zeros(n, int), rank, (codes, codes), 64)
        row, pos, dist = (np.concatenate(parts) for parts in zip(*blocks))
        want = [np.lexsort((rank, plain[i]))[:5] for i in range(n)]
        assert (row == np.repeat(codes, 5)).all() and (pos == np.concatenate(want)).all()
        assert (dist == plain[row, pos]).all()


def test_vectors_are_not_written_for_each_ring(spark, monkeypatch):
    """What is written grows with the rows where bounds rule nothing out, not with rows times rings."""
    from pathlib import Path

    from veilgauge.operators import neighbours
    from veilgauge.operators.joining import checkpoint_folder, durable

    folder, sizes = Path(checkpoint_folder(spark).removeprefix("file:")), []

    def written(df):
        df = durable(df)
        sizes.append(sum(f.stat().st_size for f in folder.rglob("*") if f.is_file()))
        return df

    for name, value in (("TRAIN_BLOCK", 40), ("CELL_ROWS", 40), ("durable", written)):
        monkeypatch.setattr(neighbours, name, value)
    rng = np.random.default_rng(10)
    df = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 1, 32)], 0) for i in range(2000)], "id int, features array<double>, label int")
    start = sum(f.stat().st_size for f in folder.rglob("*") if f.is_file())
    assert nearest(df, df, 5, same_table=True).count() == 10_000
    assert max(sizes) - start < 10 * 2000 * 32 * 8


def test_linear_attack_recovers_a_plane(spark):
    rng = np.random.default_rng(5)
    x, k = rng.random(500) * 10, rng.integers(0, 3, 500)
    pdf = pd.DataFrame({"x": x, "c": k.astype(str), "const": "u", "y": 3 * x - 2 * k + 7 + rng.normal(0, 0.5, 500)})
    meta = TableMeta((
        ColumnMeta("x", "Float", 0, 10), ColumnMeta("c", "Ordinal", labels=("0", "1", "2")),
        ColumnMeta("const", "Categorical", labels=("u", "v")), ColumnMeta("y", "Float", -10, 50),
    ))
    attack = LinearAttribute(meta, "y")
    df = spark.createDataFrame(pdf)
    model = attack.fit(df).first()
    assert model["beta"][0] == pytest.approx(3, abs=0.05) and model["beta"][1] == pytest.approx(-2, abs=0.1) and model["beta"][2] == 0
    design = np.column_stack([np.ones(500), x - x.mean(), k - k.mean()])
    rest = pdf["y"] - design @ np.linalg.lstsq(design, pdf["y"], rcond=None)[0]
    assert model["sigma"] == pytest.approx(float((rest**2).sum() / (500 - 3)), rel=1e-6)
    out = attack.guess(df, attack.fit(df)).toPandas()
    assert np.abs(out["model_guess"] - (pdf["y"] - rest)).max() < 1e-6
    assert out["likelihood"].between(0, 1).all()


def test_forest_attack_reads_probabilities_by_label(spark):
    lab = ("never", "low", "high")
    meta = TableMeta((ColumnMeta("x", "Float", 0, 1), ColumnMeta("s", "Categorical", labels=lab)))
    df = spark.createDataFrame([(float(i % 2) + i / 1000, "high" if i % 2 else "low") for i in range(80)], "x double, s string")
    attack = ForestAttribute(meta, "s", 1, trees=10, depth=4)
    out = with_links(attack.guess(df, attack.fit(df)).withColumn("linked", F.lit(None).cast("string"))).collect()
    assert all(r["guess"] == r["s"] and r["prob_correct"] > 0.7 for r in out)
    unseen = attack.guess(df.withColumn("s", F.lit("never")), attack.fit(df))
    assert unseen.agg(F.max("likelihood")).first()[0] == 0.0


@pytest.mark.parametrize("kind,label", [("forest", "c"), ("logistic", "c"), ("linear", "y")])
def test_tasks_learn(spark, kind, label):
    rng = np.random.default_rng(6)
    x = rng.random(400)
    pdf = pd.DataFrame({"id": range(400), "x": x, "g": np.where(x > 0.3, "a", "b"), "c": np.where(x > 0.5, "p", "q"), "y": 5 * x})
    pdf.loc[::50, "g"] = None
    meta = TableMeta((
        ColumnMeta("x", "Float", 0, 1), ColumnMeta("g", "Categorical", labels=("a", "b")),
        ColumnMeta("c", "Categorical", labels=("p", "q")), ColumnMeta("y", "Float", 0, 5),
    ))
    df = spark.createDataFrame(pdf)
    options = {"numTrees": 10, "maxDepth": 5} if kind == "forest" else {"penalty": 0.001, "maxIter": 12} if kind == "logistic" else {}
    task = PredictTask(kind, meta.select([n for n in meta.names if not (kind == "linear" and n == "c")]), label, 1, options).fit(df)
    score = task.evaluate(df).agg(F.avg("score"), F.max(F.abs("score"))).first()
    if kind == "linear":
        assert score[1] < 1e-3
    else:
        assert score[0] > 0.95
    with pytest.raises(ValueError):
        PredictTask("linear", meta, "c")


def test_forests_of_many_tables(spark):
    """Separable tables are learned, tables without rows give nulls, and the forests do not depend on partitions."""
    rng = np.random.default_rng(5)
    meta = TableMeta((ColumnMeta("a", CATEGORICAL, labels=("x", "y", "z")), ColumnMeta("v", FLOAT, low=0.0, high=10.0), ColumnMeta("s", CATEGORICAL, labels=("no", "yes"))))
    data = []
    for t in range(6):
        for i in range(120):
            a, v = "xyz"[rng.integers(3)], float(rng.uniform(0, 10))
            said = (a == "x") if t % 2 else (v > 5)
            data.append((f"t{t}", i, a, v, "yes" if said else "no"))
    df = spark.createDataFrame(data, "t string, i int, a string, v double, s string")
    attack = ForestAttribute(meta, "s", 3, trees=12, depth=5)
    out = attack.guess(df, attack.fit(df, ["t"]), ["t"]).toPandas()
    assert len(out) == len(df.collect()) and (out.model_guess == out.s).mean() > 0.93
    assert out.groupby("t").apply(lambda g: (g.model_guess == g.s).mean(), include_groups=False).min() > 0.85
    assert ((out.likelihood >= 0) & (out.likelihood <= 1)).all()
    other = spark.createDataFrame([("none", 0, "x", 1.0, "no"), ("t0", 1, None, None, None)], df.schema)
    got = {r.t: (r.model_guess, r.likelihood) for r in attack.guess(other, attack.fit(df, ["t"]), ["t"]).collect()}
    assert got["none"] == (None, None) and got["t0"][0] in ("no", "yes") and got["t0"][1] == 0.0


def test_first_cut_is_the_best_gini_cut(spark):
    rng = np.random.default_rng(6)
    codes = rng.integers(0, 6, (200, 3))
    label = ((codes[:, 1] > 2) ^ (rng.random(200) < 0.1)).astype(int)
    rows_ = spark.createDataFrame([("t", i, c.astype(float).tolist(), int(y)) for i, (c, y) in enumerate(zip(codes, label))], "t string, row long, features array<double>, label int")
    model = forests.grow(rows_, ["t"], 3, 2, 3, 1, 9, per_node=3)
    boot = rows_.select("row", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("tree"), F.lit("t").alias("t"))
    u = uniform(digest(9, "bootstrap", "t", "row", "tree"))
    weight = boot.select("row", "tree", u.alias("u")).toPandas()
    weight["w"] = sum((weight.u >= c).astype(int) for c in forests.DRAWS)
    trees = model.trees.collect()
    for s in trees:
        w = weight[weight.tree == s.tree].sort_values("row").w.to_numpy()

        def value(f, b):
            parts = [np.bincount(label[m], w[m], 2) for m in (codes[:, f] <= b, codes[:, f] > b)]
            return sum((p**2).sum() / p.sum() for p in parts if p.sum())

        best = max(((value(f, b), -f, -b) for f in range(3) for b in range(5)))
        assert (s.f, s.cut, s.node, s.leaf) == ([-best[1]], [-best[2]], [1], [2, 3])
    assert len(trees) == 3


def test_forests_of_scans_and_of_rows_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(8)
    data = [(k, str(i), [float(rng.integers(0, 50)), None if i % 11 == 0 else float(rng.normal()), float(i % 3)], int(rng.integers(0, 3))) for k in ("a", None) for i in range(150)]
    data += [("empty", "0", [None, None, None], 1)]
    df = spark.createDataFrame(data, "k string, row string, features array<double>, label int").repartition(3)
    got = []
    # Scans only, scans and then rows, rows only.
    for trees, cells in ((4096, 2**23), (4096, 3 * 4 * 2 * 33 * 3), (0, 0)):
        monkeypatch.setattr(forests, "SCAN_TREES", trees)
        monkeypatch.setattr(forests, "SCAN_CELLS", cells)
        found = forests.grow(df, ["k"], 3, 3, 3, 3, 5, per_node=2).trees
        got.append(sorted((tuple(map(str, r)) for r in found.collect())))
    assert got[0] == got[1] == got[2] and len(got[0]) >= 6


def test_scanned_forests_do_not_repeat_rows_for_trees(spark, monkeypatch):
    seen = []
    keep = forests.durable
    monkeypatch.setattr(forests, "durable", lambda df: seen.append(keep(df)) or seen[-1])
    df = spark.range(400).selectExpr("string(id) row", "array(double(id % 7), double(id % 5)) features", "int(id % 2) label")
    forests.grow(df, [], 2, 2, 10, 3, 1)
    assert max(x.count() for x in seen) == 400
