import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from veilgauge.meta import CATEGORICAL, FLOAT, ColumnMeta, TableMeta
from veilgauge.operators import distributions, features, joining, quantiles, sampling, sanitise
from veilgauge.operators.linkage import link_attribute, link_members
from veilgauge.plans.population import META, as_tables, population, population_nulls
from veilgauge.sources import tables

QUIDS = ("status", "priority", "segment", "year")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- joining and quantiles ----


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_salted_join_equals_broadcast_join(spark, monkeypatch, how):
    hot = [(i, "hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}") for i in range(600)]
    facts = spark.createDataFrame(hot, "id int, k string")
    lookup = spark.createDataFrame([("hot", 1), (None, 2), ("k5", 3)], "k string, v int")
    small = rows(joining.attach(facts, lookup, ["k"], how))
    monkeypatch.setattr(joining, "BROADCAST_BYTES", -1)
    assert rows(joining.attach(facts, lookup, ["k"], how)) == small
    assert joining.attach(facts, lookup, ["k"], "inner").count() == sum(k in ("hot", None, "k5") for _, k in hot)


@pytest.mark.parametrize("rank_rows", [5, 100_000])
@pytest.mark.parametrize("q", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_quantiles_are_exact(spark, monkeypatch, q, rank_rows):
    monkeypatch.setattr(quantiles, "RANK_ROWS", rank_rows)
    rng = np.random.default_rng(3)
    spread = 10.0 ** rng.uniform(-9, 9, 3000) * rng.choice([-1, 1], 3000)
    data = [("a", float(v), int(w)) for v, w in zip(rng.lognormal(0, 4, 3000), rng.integers(0, 3, 3000))]
    data += [("d", float(v), None) for v in spread] + [("e", 1e-300, 1), ("e", 1e300, 2), ("e", float("inf"), 3), ("e", -0.0, 4)]
    data += [("b", 5.0, None), ("b", 5.0, 7), ("c", None, 1), ("n", None, None)]
    df = spark.createDataFrame(data, "t string, x double, y int")
    want = df.groupBy("t").agg(*[F.percentile(F.col(c).cast("double"), q).alias(c) for c in "xy"])
    assert rows(quantiles.quantiles(df, ["x", "y"], q, ["t"]).select("t", "x", "y")) == rows(want)
    whole = quantiles.quantiles(df, ["x"], q).first()[0]
    assert whole == df.agg(F.percentile("x", q)).first()[0]


def test_several_quantiles_at_once(spark):
    df = spark.range(100).select((F.col("id") % 7).alias("x"))
    assert tuple(quantiles.spread(df, "x", [0.0, 0.5, 1.0]).first()) == (0.0, 3.0, 6.0)
    assert quantiles.quantiles(df.where("x < 0"), ["x"], 0.5).first()[0] is None


def test_null_numbers_do_not_cost_the_label_fills(spark):
    data = [("a", None, "red"), ("a", None, "red"), ("a", None, None), ("b", 2.0, None), ("b", None, "blue")]
    df = spark.createDataFrame(data, "t string, x double, c string")
    meta = TableMeta((ColumnMeta("x", FLOAT, low=0.0, high=9.0), ColumnMeta("c", CATEGORICAL, labels=("red", "blue"))))
    out = rows(sanitise.impute(df, meta, ["t"]).select("t", "x", "c"))
    assert out == rows(spark.createDataFrame([("a", None, "red")] * 3 + [("b", 2.0, "blue")] * 2, df.schema))


# ---- sanitiser ----


def test_defaults_keep_every_row(spark, sf_dir):
    df = population(spark, sf_dir)
    out = sanitise.Sanitiser(META).sanitise(df)
    assert out.count() == df.count() and out.columns == ["id", *META.names]


def test_sanitiser_post_conditions(spark, sf_dir):
    df = population_nulls(spark, sf_dir)
    s = sanitise.Sanitiser(META, 10, 2, 0.9, 7, ("region",), QUIDS)
    out = joining.hold(s.sanitise(df))
    assert "region" not in out.columns
    assert dict(out.dtypes)["year"] == "string" and dict(out.dtypes)["total"] == "bigint"
    assert out.groupBy(*QUIDS).count().agg(F.min("count")).first()[0] >= 7
    cap = df.select(F.col("total").cast("bigint").alias("t")).agg(F.percentile("t", 0.9)).first()[0]
    assert out.agg(F.max("total")).first()[0] <= int(cap)
    assert out.where("segment is null or balance is null").count() == 0


def test_rare_labels_are_counted_on_the_whole_table(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "a", "y"), (4, "b", "y"), (5, "b", "x")], "id int, p string, q string")
    kept = sanitise.drop_rare(df, ["p", "q"], 2)
    # b and y are seen twice; dropping them leaves three a's although fewer x's remain afterwards.
    assert [r[0] for r in kept.orderBy("id").collect()] == [1, 2]


def test_null_quasi_identifiers_form_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id int, q string")
    assert [r[0] for r in sanitise.k_anonymise(df, ["q"], 2).orderBy("id").collect()] == [1, 2]


def test_small_groups_beyond_the_broadcast_limit(spark, sf_dir, monkeypatch):
    df = population(spark, sf_dir, nation=True)
    by = ["status", "priority", "segment", "nation"]
    want = rows(sanitise.k_anonymise(df, by, 3).select("id"))
    monkeypatch.setattr(joining, "BROADCAST_BYTES", -1)
    assert rows(sanitise.k_anonymise(df, by, 3).select("id")) == want


def test_mode_takes_the_smallest_on_ties(spark):
    meta = TableMeta((ColumnMeta("c", "Categorical", labels=("a", "b")), ColumnMeta("n", "Integer", 0, 20, bins=(0, 9, 20))))
    df = spark.createDataFrame([("b", 9), ("a", 10), ("b", 9), ("a", 10), (None, None)], "c string, n bigint")
    filled = sanitise.impute(df, meta.derive(quids=["n"])).collect()
    assert ("a", 9.0) in [tuple(r) for r in filled]


def test_batched_equals_one_by_one(spark, sf_dir):
    df = as_tables(population_nulls(spark, sf_dir))
    s = sanitise.Sanitiser(META, 10, 1, 0.95, 2, (), QUIDS)
    together = s.sanitise(df, ["dataset_id"])
    for name in ("F-0", "P-1"):
        alone = s.sanitise(df.where(F.col("dataset_id") == name))
        assert rows(together.where(F.col("dataset_id") == name).drop("dataset_id")) == rows(alone)


# ---- sampling ----


def test_draws_are_exact_and_independent_of_partitions(spark, sf_dir):
    df = population(spark, sf_dir)
    a = sampling.draw(df.repartition(1), 137, 5, 3)
    b = sampling.draw(df.repartition(8), 137, 5, 3)
    assert rows(a.select("draw", "id")) == rows(b.select("draw", "id"))
    sizes = a.groupBy("draw").agg(F.count("*"), F.countDistinct("id")).collect()
    assert [tuple(r)[1:] for r in sizes] == [(137, 137)] * 3
    assert a.select("id").distinct().count() > 137


def test_drawing_more_than_there_is_is_refused(spark):
    assert sampling.draw(spark.range(20), 20, 1, 2).groupBy("draw").count().orderBy("draw").collect() == [(0, 20), (1, 20)]
    for n in (1, 50):
        with pytest.raises(ValueError):
            sampling.draw(spark.range(20).where("id < 0" if n == 1 else "true"), n, 1, 2)


def test_in_tables_are_out_tables_plus_one_row(spark, sf_dir):
    df = population(spark, sf_dir)
    ids = sampling.pick_targets(df, 2, listed=[3], seed=9)
    drawn = sampling.draw(sampling.without(df, ids), 50, 9, 2)
    every = joining.hold(sampling.with_targets(drawn, sampling.only(df, ids), ids, 2))
    assert every.select("dataset_id").distinct().count() == 2 * (1 + len(ids))
    for t in ids:
        base = set(r[0] for r in every.where("dataset_id = '1:OUT'").select("id").collect())
        more = set(r[0] for r in every.where(F.col("dataset_id") == f"1:{t}").select("id").collect())
        assert more - base == {t} and base - more == set()


def test_listed_targets_do_not_repeat(spark):
    df = spark.range(100)
    drawn = sampling.pick_targets(df, 3, seed=1)
    assert sampling.pick_targets(df, 3, listed=drawn[:1], seed=1) == drawn


# ---- distributions and features ----


def test_normalise(spark):
    inf = float("inf")
    df = spark.createDataFrame([("a", 0, -1.0), ("a", 1, 0.0), ("a", 2, 0.0), ("b", 0, inf), ("b", 1, 5.0), ("c", 0, 1.0), ("c", 1, 3.0)], "g string, i int, v double")
    got = {(r["g"], r["i"]): r["prob"] for r in distributions.normalise(df, "v", ["g"]).collect()}
    assert got[("a", 0)] == got[("a", 1)] == pytest.approx(1 / 3)
    assert (got[("b", 0)], got[("b", 1)]) == (1.0, 0.0)
    assert (got[("c", 0)], got[("c", 1)]) == (0.25, 0.75)


def test_histogram_feature_orders(spark):
    meta = TableMeta((ColumnMeta("x", "Float", 0, 10),))
    df = spark.createDataFrame([(float(v),) for v in (0, 1, 1, 5, 5, 5, 9, 10, 11)], "x double")
    assert features.histogram(df, meta, nbins=5).first()[0] == [3.0, 0.0, 3.0, 0.0, 2.0]
    assert features.histogram(df, meta, nbins=5, order="count").first()[0] == [3.0, 3.0, 2.0, 0.0, 0.0]


def test_profile_counts_nulls_and_outside_apart(spark):
    meta = TableMeta((ColumnMeta("x", "Float", 0, 10), ColumnMeta("c", "Categorical", labels=("a", "b"))))
    df = spark.createDataFrame([(0.0, "a"), (10.0, "z"), (11.0, None), (None, "b"), (-1.0, "b")], "x double, c string")
    prof = {r["attr"]: r for r in distributions.profile(df, distributions.Binning(meta, 5)).collect()}
    assert prof["x"]["counts"] == [1, 0, 0, 0, 1] and prof["x"]["outside"] == 2 and prof["x"]["nulls"] == 1
    assert prof["c"]["counts"] == [1, 2] and prof["c"]["outside"] == 1
    assert prof["x"]["missing_rate"] == pytest.approx(0.2)


def test_compact_counts_equal_plain_counts(spark, sf_dir, monkeypatch):
    binning = distributions.Binning(META.select(["status", "segment", "year"]), 10)
    df = as_tables(population_nulls(spark, sf_dir))
    compact = binning.compact(df, ["dataset_id"])
    plain = binning.encode(df, ["dataset_id"]).groupBy("dataset_id", "bins").agg(F.count("*").alias("n"))
    assert rows(compact) == rows(plain)
    monkeypatch.setattr(distributions, "COMPACT_CELLS", 0)
    assert binning.compact(df, ["dataset_id"]).count() == df.count()


@pytest.mark.parametrize("limit", [2_000_000, 0])
def test_correlations_match_pandas(spark, sf_dir, monkeypatch, limit):
    monkeypatch.setattr(features, "COMPACT_CELLS", limit)
    df = population_nulls(spark, sf_dir).withColumn("year", F.when(F.col("id") % 5 != 0, F.col("year")))
    pdf = df.toPandas()
    cols = [pdf[[c.name]].astype(float) for c in META.numeric]
    cols += [pd.get_dummies(pdf[c.name].astype(pd.CategoricalDtype(c.labels))).iloc[:, 1:].astype(float) for c in META.discrete]
    want = pd.concat(cols, axis=1).corr().fillna(0).to_numpy()
    got = np.array(features.correlations(df, META).first()[0])
    assert np.abs(got - want[np.triu_indices_from(want, 1)]).max() < 1e-10
    assert len(got) == len(features.correlation_names(META))


def test_correlation_with_a_constant_is_zero(spark):
    meta = TableMeta((ColumnMeta("x", "Float", 0, 10), ColumnMeta("y", "Float", 0, 10)))
    df = spark.createDataFrame([(1.0, 0.1), (2.0, 0.1), (3.0, 0.1)], "x double, y double")
    assert features.correlations(df, meta).first()[0] == [0.0]


def test_naive_order_and_ties(spark):
    meta = TableMeta((ColumnMeta("c", "Categorical", labels=("a", "b", "d")), ColumnMeta("x", "Float", 0, 9)))
    df = spark.createDataFrame([("b", 1.0), ("a", 2.0), (None, 6.0)], "c string, x double")
    assert features.naive(df, meta).first()[0] == [-1.0, 3.0, -1.0, 2.0, 3.0, 7.0]


# ---- linkage and sources ----


def test_unique_match(spark):
    pub = spark.createDataFrame([("x", 1, 5.0), ("x", 1, 6.0), ("y", 2, 7.0), ("y", 3, 8.0)], "a string, b int, v double")
    asked = spark.createDataFrame([(1, "y", 2), (2, "x", 1), (3, "z", 9)], "id int, a string, b int")
    got = {r["id"]: (r["group_size"], r["linked"]) for r in link_members(pub, asked, ["a", "b"]).collect()}
    assert got == {1: (1, 1), 2: (2, None), 3: (0, None)}
    got = {r["id"]: r["linked"] for r in link_attribute(pub, asked, ["a", "b"], "v").collect()}
    assert got == {1: 7.0, 2: None, 3: None}


def test_csv_ids_follow_position(spark, tmp_path):
    meta = TableMeta((ColumnMeta("n", "Integer", 0, 9), ColumnMeta("f", "Float", 0, 1), ColumnMeta("c", "Categorical", labels=("a", "b"))))
    path = tmp_path / "t.csv"
    path.write_text("n,f,c\n1,0.5,a\n2,NaN,b\n3,,a\n")
    got = tables.load_table(spark, str(path), meta).orderBy("id").collect()
    assert [tuple(r) for r in got] == [("ID0", 1, 0.5, "a"), ("ID1", 2, None, "b"), ("ID2", 3, None, "a")]
    folder = tmp_path / "parts"
    folder.mkdir()
    for i, rows_ in enumerate((40, 3, 500, 1)):
        (folder / f"part-{i}.csv").write_text("n,f,c\n" + "".join(f"{j % 10},0.{i},a\n" for j in range(rows_)))
    several = tables.load_table(spark, str(folder), meta).collect()
    order = sorted((int(r["id"][2:]), r["f"], r["n"]) for r in several)
    assert [o[0] for o in order] == list(range(544))
    assert [o[1:] for o in order] == [(i / 10, j % 10) for i, n in enumerate((40, 3, 500, 1)) for j in range(n)]
    many = tables.with_row_ids(spark.range(1000, numPartitions=7).withColumn("v", F.lit(1))).select("id").distinct().count()
    assert many == 1000


def test_inferred_metadata(spark, sf_dir):
    meta = tables.infer_metadata(population(spark, sf_dir).drop("id"), ordinal=["priority"])
    assert meta["priority"].kind == "Ordinal" and meta["status"].labels == ("F", "O", "P")
    assert meta["year"].kind == "Integer" and meta["total"].kind == "Float"
    with pytest.raises(ValueError):
        tables.infer_metadata(population(spark, sf_dir).select("segment"), max_labels=2)
    many = spark.range(200_000).select(F.concat(F.lit("v"), "id").alias("c"))
    assert tables.profile_columns(many).first()["size"] == 200_000


def test_pairs_are_counted_in_tasks_and_equal_plain_counts(spark):
    import math
    from collections import Counter

    from veilgauge.operators.information import pair_information

    rows = [([i % 3, None if i % 7 == 0 else i % 4, (i * i) % 5], 1 + i % 2) for i in range(200)]
    df = spark.createDataFrame(rows, "bins array<int>, n bigint").repartition(3)
    for frame, times in ((df, True), (df.drop("n"), False)):
        out = pair_information(frame, 3, 5)
        assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()
        found = {(r["i"], r["j"]): (r["mi"], r["hx"], r["hy"]) for r in out.collect()}
        assert set(found) == {(0, 1), (0, 2), (1, 2)}
        for (i, j), got in found.items():
            joint = Counter()
            for bins, n in rows:
                if bins[i] is not None and bins[j] is not None:
                    joint[bins[i], bins[j]] += n if times else 1
            total, x, y = sum(joint.values()), Counter(), Counter()
            for (a, b), n in joint.items():
                x[a] += n
                y[b] += n
            mi = sum(n / total * math.log(n * total / (x[a] * y[b])) for (a, b), n in joint.items())
            want = (mi, *(-sum(n / total * math.log(n / total) for n in c.values()) for c in (x, y)))
            assert got == pytest.approx(want)
    none = pair_information(df.where("false"), 3, 5)
    assert none.count() == 0
