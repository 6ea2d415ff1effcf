"""Registered queries: one per operator, each over the whole given tables."""

from __future__ import annotations

import uuid
from dataclasses import replace
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.functions import encoding as enc
from veilgauge.meta import CATEGORICAL, ColumnMeta, TableMeta
from veilgauge.operators import bayes, distributions, evaluate, features, information, quantiles, sampling, sanitise
from veilgauge.operators.attribute import ForestAttribute, LinearAttribute
from veilgauge.operators.encode import centre, decode_with_ranges, encode_with_ranges
from veilgauge.operators.gaussian import Gaussian
from veilgauge.operators.generate import key_value
from veilgauge.operators.histogram import IndependentHistogram
from veilgauge.operators.joining import checkpoint_folder, durable, release
from veilgauge.operators.linkage import link_attribute, link_members
from veilgauge.operators.learners import platt
from veilgauge.operators.membership import MembershipAttack
from veilgauge.operators.mixtures import Mixture
from veilgauge.operators.neighbours import nearest, vote
from veilgauge.operators.predict import PredictTask
from veilgauge.plans import games
from veilgauge.plans.population import META, PRIORITY, SEGMENT, WIDE, order_lines, population, population_nulls, table, as_tables
from veilgauge.sources import results, tables

QUIDS = ("status", "priority", "segment", "year")
SEED = 42
NAMES = META.names
DISCRETE = [c.name for c in META.discrete]

# A fixed network over the population, for queries whose SQL has to know the structure.
NETWORK = [
    ("status", []), ("priority", ["status"]), ("segment", ["priority"]), ("region", ["segment"]),
    ("year", ["status"]), ("total", ["year"]), ("balance", ["total"]),
]
INFO_COLUMNS = tuple(NAMES)


def tidy(x: Column) -> Column:
    """A float rounded so that the order of summation does not show."""
    x = x.cast("double")
    return F.when(F.abs(x) < 1e6, F.round(x, 6)).otherwise(F.round(x / 1e6, 6) * 1e6) + F.lit(0.0)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, which all executors can reach."""
    return f"{checkpoint_folder(spark)}/veilgauge/{name}-{uuid.uuid4().hex}"


def _spread(df: DataFrame, vector: str, n: int, keep: list[str]) -> DataFrame:
    return df.select(*keep, *[F.round(F.element_at(vector, i + 1), 9).alias(f"v{i}") for i in range(n)])


def _by_table(spark, sf_dir, nulls: bool = False) -> DataFrame:
    return as_tables(population_nulls(spark, sf_dir) if nulls else population(spark, sf_dir))


KEYS = ["dataset_id"]

# ---- sources ----------------------------------------------------------------------------------------------------


def load_typed(spark, sf_dir):
    path = scratch(spark, "csv")
    tables.publish(population(spark, sf_dir), path, "csv")
    return tables.load_table(spark, path, META, "csv", id_col="id").withColumn("id", F.col("id").cast("bigint"))


def encode_codes(spark, sf_dir):
    return enc.encode_codes(population_nulls(spark, sf_dir), META).select("id", *DISCRETE)


def decode_codes(spark, sf_dir):
    coded = enc.encode_codes(population_nulls(spark, sf_dir), META)
    return enc.decode_codes(coded, META).select("id", *DISCRETE)


def union_decode(spark, sf_dir):
    coded = enc.encode_codes(population_nulls(spark, sf_dir), META)
    train, test = tables.split(coded, "year <= 1998", "year > 1998")
    return tables.union_decode([train, test], META).select("id", *DISCRETE)


def infer_metadata(spark, sf_dir):
    df = population(spark, sf_dir, nation=True).drop("id")
    prof = tables.profile_columns(df, ordinal=["priority"])
    return prof.select(
        "position", "name", "type", F.coalesce("min", F.lit(0.0)).alias("low"), F.coalesce("max", F.lit(0.0)).alias("high"),
        F.coalesce("size", F.lit(0)).alias("size"), F.coalesce(F.array_join("labels", "|"), F.lit("")).alias("labels"),
    )


def train_test_filter(spark, sf_dir):
    df = population(spark, sf_dir)
    train, test = tables.split(df, "year IN (1995, 1996, 1997)", "year IN (1998, 1999)")
    return train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test"))).select("id", "year", "part")


def _linkage_facts(spark, sf_dir) -> DataFrame:
    """Membership guesses read off the population: the label columns name the game, parity is the secret."""
    return population(spark, sf_dir).select(
        F.col("status").alias("dataset"), F.col("region").alias("target_id"), F.col("segment").alias("model"),
        F.col("priority").alias("feature_set"), F.col("year").cast("string").alias("run"),
        F.pmod("id", F.lit(2)).cast("int").alias("secret"), (F.col("total") > 250000).cast("int").alias("guess"),
    )


def results_json_roundtrip(spark, sf_dir):
    folder = scratch(spark, "json")
    results.write_json(_linkage_facts(spark, sf_dir), folder, results.LINKAGE)
    back = results.read_linkage(spark, folder, lines=True)
    return back.groupBy(*back.columns).agg(F.count("*").alias("n"))


def load_results_linkage(spark, sf_dir):
    folder = scratch(spark, "json")
    results.write_json(_linkage_facts(spark, sf_dir), folder, results.LINKAGE)
    return _gain_columns(evaluate.linkage_gain(results.read_linkage(spark, folder, lines=True)))


# ---- encodings --------------------------------------------------------------------------------------------------


def encode_onehot(spark, sf_dir):
    df = population_nulls(spark, sf_dir)
    return _spread(df.withColumn("v", enc.ordinal_onehot_vector(META)), "v", 17, ["id"])


def encode_scaled(spark, sf_dir):
    known = META.select([n for n in NAMES if n != "segment"])
    return _spread(population(spark, sf_dir).withColumn("v", enc.scaled_vector(known)), "v", 16, ["id"])


def encode_inferred_ranges(spark, sf_dir):
    return _spread(encode_with_ranges(_by_table(spark, sf_dir), META, KEYS), "vector", 21, ["dataset_id", "id"])


def decode_scaled(spark, sf_dir):
    coded = encode_with_ranges(_by_table(spark, sf_dir), META, KEYS).drop(*NAMES)
    out = decode_with_ranges(coded, META).select("dataset_id", "id", *NAMES)
    return out.withColumns({c: F.round(c, 6) for c in ("total", "balance")})


def bin_quids(spark, sf_dir):
    meta = META.derive(quids=("year", "total"))
    return enc.bin_columns(population(spark, sf_dir), meta).select("id", "year", "total")


def bin_edges(spark, sf_dir):
    df = _by_table(spark, sf_dir)
    ranges = distributions.Binning(META, 10, True).ranges(df, KEYS)
    parts = [
        ranges.select("dataset_id", F.lit(c.name).alias("attr"), F.posexplode(f"__edges_{i}").alias("pos", "edge"))
        for i, c in enumerate(META.columns) if c.numeric
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("edge", F.round("edge", 6))


def bin_encode(spark, sf_dir):
    df = population_nulls(spark, sf_dir)
    coded = distributions.Binning(META, 10).encode(df, ["id"])
    return coded.select("id", *[F.coalesce(F.element_at("bins", i + 1), F.lit(-9)).alias(n) for i, n in enumerate(NAMES)])


def centre_columns(spark, sf_dir):
    out = centre(_by_table(spark, sf_dir), ["total", "balance"], KEYS)
    return out.select("dataset_id", "id", F.round("total", 4).alias("total"), F.round("balance", 4).alias("balance"))


def camel_names(spark, sf_dir):
    part = table(spark, sf_dir, "part").select(
        "p_partkey",
        F.when(F.col("p_partkey") % 3 == 0, F.concat_ws("_", "p_type", "p_brand", "p_name"))
        .when(F.col("p_partkey") % 3 == 1, F.concat_ws("-", "p_type", "p_brand"))
        .otherwise(F.col("p_type")).alias("name"),
    )
    return evaluate.camel_names(part, "name")


def candidate_key(spark, sf_dir):
    span = population(spark, sf_dir).agg(F.count("*").alias("n"), F.min("total").alias("lo"), F.max("total").alias("hi")).first()
    real = key_value(span["n"], "Float", span["lo"], span["hi"])
    columns = [key_value(span["n"], "Integer").alias("whole"), F.round(real, 6).alias("real"), key_value(span["n"], CATEGORICAL, prefix="key").alias("text")]
    return spark.range(span["n"]).select(F.col("id").alias("row"), *columns)


# ---- sanitising -------------------------------------------------------------------------------------------------


def impute(spark, sf_dir):
    return sanitise.impute(_by_table(spark, sf_dir, nulls=True), META, KEYS).select("dataset_id", "id", "segment", F.round("balance", 6).alias("balance"))


def impute_null_table(spark, sf_dir):
    """One of the tables has no numbers at all; its labels are filled all the same."""
    df = _by_table(spark, sf_dir, nulls=True)
    df = df.withColumns({n: F.when(F.col("dataset_id") != "F-0", F.col(n)) for n in ("total", "balance")})
    return sanitise.impute(df, META, KEYS).select("dataset_id", "id", "segment", *[F.round(n, 6).alias(n) for n in ("total", "balance")])


def quantiles_refined(spark, sf_dir):
    levels = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    found = quantiles.spread(_by_table(spark, sf_dir, nulls=True), "balance", levels, KEYS)
    return found.select("dataset_id", *[F.round(f"q{i}", 6).alias(f"q{i}") for i in range(len(levels))])


def sanitise_cap(spark, sf_dir):
    return sanitise.winsorise(_by_table(spark, sf_dir), ["year", "total", "balance"], 0.99, KEYS).select("dataset_id", "id", "year", "total", "balance")


def sanitise_drop(spark, sf_dir):
    out = sanitise.Sanitiser(META, drop_cols=("region", "year")).sanitise(population_nulls(spark, sf_dir))
    return out


def sanitise_rare(spark, sf_dir):
    df = population(spark, sf_dir, nation=True)
    df = df.withColumn("cell", F.concat_ws("/", "status", "priority", "segment", "nation"))
    return sanitise.drop_rare(df, ["cell", "nation"], 4).select("id", "cell")


def sanitise_k_anonymity(spark, sf_dir):
    df = population(spark, sf_dir, nation=True)
    return sanitise.k_anonymise(df, ["status", "priority", "segment", "nation"], 5).select("id", "status", "priority", "segment", "nation")


def sanitise_full(spark, sf_dir):
    return sanitise.Sanitiser(META, 10, 1, 0.99, 9, (), QUIDS).sanitise(population_nulls(spark, sf_dir))


# ---- sampling and membership ------------------------------------------------------------------------------------


def _tenth(df: DataFrame, part: int = 10) -> int:
    return max(1, df.count() // part)


def sample_members(spark, sf_dir):
    df = population(spark, sf_dir)
    return sampling.draw(df, _tenth(df), SEED, 3).select("draw", "id")


def drop_targets(spark, sf_dir):
    df = population(spark, sf_dir)
    return sampling.without(df, sampling.pick_targets(df, 5, seed=SEED)).select("id")


def _tables(spark, sf_dir, draws: int, tag: str, nulls: bool = False) -> DataFrame:
    df = population_nulls(spark, sf_dir) if nulls else population(spark, sf_dir)
    ids = sampling.pick_targets(df, 3, seed=SEED)
    rest = sampling.without(df, ids)
    drawn = sampling.draw(rest, _tenth(df), SEED, draws, tag=tag)
    return sampling.with_targets(drawn, sampling.only(df, ids), ids, draws)


def game_members(spark, sf_dir):
    return _tables(spark, sf_dir, 2, "game").select("dataset_id", "id", "label")


def shadow_members(spark, sf_dir):
    return _tables(spark, sf_dir, 4, "shadow").select("dataset_id", "draw", "target", "id", "label")


def new_categories(spark, sf_dir):
    narrow = TableMeta((ColumnMeta("priority", CATEGORICAL, labels=PRIORITY[:3]), ColumnMeta("segment", CATEGORICAL, labels=SEGMENT[1:])))
    return sampling.new_categories(population_nulls(spark, sf_dir), narrow)


# ---- distributions ----------------------------------------------------------------------------------------------


def _cells(spark, sf_dir, numeric: bool) -> DataFrame:
    df = _by_table(spark, sf_dir, nulls=True)
    prof = distributions.profile(df, distributions.Binning(META, 10), KEYS).where(F.col("numeric") == numeric)
    return distributions.profile_cells(prof, KEYS)


def hist_distribution(spark, sf_dir):
    return _cells(spark, sf_dir, True).select("dataset_id", "attr", "bin", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi"), "n", F.round("prob", 9).alias("prob"))


def cat_distribution(spark, sf_dir):
    return _cells(spark, sf_dir, False).select("dataset_id", "attr", "bin", "label", "n", F.round("prob", 9).alias("prob"))


def cdf(spark, sf_dir):
    prof = distributions.profile(population(spark, sf_dir), distributions.Binning(META, 10))
    return distributions.profile_cells(prof).select("attr", "bin", F.round("cdf", 9).alias("cdf"))


def attr_profile(spark, sf_dir):
    prof = distributions.profile(population_nulls(spark, sf_dir), distributions.Binning(META, 10))
    return prof.select(
        "attr", "size", "total", "nulls", "outside", F.round("missing_rate", 9).alias("missing_rate"),
        F.coalesce(F.element_at("edges", 1), F.lit(0.0)).alias("low"), F.coalesce(F.element_at("edges", -1), F.lit(0.0)).alias("high"),
    )


def freq_full_domain(spark, sf_dir):
    binning = distributions.Binning(META, 10)
    return distributions.frequency(binning.encode(population(spark, sf_dir)), [0, 4, 5, 6], [3, 10, 10, 10])


def normalise(spark, sf_dir):
    sums = population(spark, sf_dir).groupBy("segment", "priority").agg(F.sum(F.col("balance") - 4450).alias("value"))
    return distributions.normalise(sums, "value", ["segment"]).select("segment", "priority", F.round("prob", 9).alias("prob"))


def _info_coded(spark, sf_dir):
    binning = distributions.Binning(META.select(INFO_COLUMNS), 10)
    return binning, binning.compact(population(spark, sf_dir))


def _pairs(spark, sf_dir):
    binning, coded = _info_coded(spark, sf_dir)
    pairs = information.normalised(information.pair_information(coded, len(INFO_COLUMNS), binning.radix))
    names = enc.literal_array(INFO_COLUMNS)
    return pairs.withColumns({"a": F.element_at(names, F.col("i") + 1), "b": F.element_at(names, F.col("j") + 1)})


def mi_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("mi", 9).alias("mi"))


def nmi_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("nmi", 9).alias("nmi"))


def _wide_meta(spark) -> TableMeta:
    """The metadata of the order lines as a user has it: read from a file."""
    path = scratch(spark, "meta")
    tables.write_meta(spark, WIDE, path)
    return tables.read_meta(spark, path)


def wide_nmi_pairs(spark, sf_dir):
    """All pairs of sixteen columns, whose domains are too many to count whole rows first."""
    meta = _wide_meta(spark)
    binning = distributions.Binning(meta, 10)
    pairs = information.normalised(information.pair_information(binning.compact(order_lines(spark, sf_dir)), len(meta), binning.radix))
    names = enc.literal_array(meta.names)
    return pairs.select(F.element_at(names, F.col("i") + 1).alias("a"), F.element_at(names, F.col("j") + 1).alias("b"), F.round("mi", 9).alias("mi"), F.round("nmi", 9).alias("nmi"))


def wide_distribution(spark, sf_dir):
    meta = _wide_meta(spark)
    df = order_lines(spark, sf_dir).withColumn("dataset_id", F.col("returned"))
    made = features.histogram(df, meta, KEYS)
    return made.select("dataset_id", F.posexplode("features").alias("cell", "n")).select("dataset_id", "cell", F.col("n").cast("bigint").alias("n"))


def mi_degree2(spark, sf_dir):
    binning, coded = _info_coded(spark, sf_dir)
    d = len(INFO_COLUMNS)
    cands = [(c, list(ps)) for c in range(d) for ps in combinations([p for p in range(d) if p != c], 2)]
    listed = F.array(*[F.struct(F.lit(c).alias("child"), enc.literal_array(ps).alias("parents")) for c, ps in cands])
    scored = information.candidate_information(coded.withColumn("cands", listed), binning.sizes)
    names = enc.literal_array(INFO_COLUMNS)
    return scored.select(
        F.element_at(names, F.col("child") + 1).alias("child"),
        F.array_join(F.transform("parents", lambda p: F.element_at(names, p + 1)), " ").alias("parents"),
        F.round("mi", 9).alias("mi"),
    )


# ---- features ---------------------------------------------------------------------------------------------------


def _rows(vectors: DataFrame, names: list[str]) -> DataFrame:
    out = features.feature_rows(vectors, names, KEYS)
    return out.withColumn("value", tidy(F.col("value")))


def feat_naive(spark, sf_dir):
    return _rows(features.naive(_by_table(spark, sf_dir, nulls=True), META, KEYS), features.naive_names(META))


def feat_naive_array(spark, sf_dir):
    vectors = features.naive_array(table(spark, sf_dir, "embeddings"), "embedding", ["label"])
    return vectors.select("label", *[F.round(F.element_at("features", i + 1), 6).alias(n) for i, n in enumerate(("mean", "median", "variance"))])


def feat_histogram(spark, sf_dir):
    return _rows(features.histogram(_by_table(spark, sf_dir, nulls=True), META, KEYS), features.histogram_names(META))


def feat_histogram_sorted(spark, sf_dir):
    return _rows(features.histogram(_by_table(spark, sf_dir, nulls=True), META, KEYS, order="count"), features.histogram_names(META))


def feat_corr(spark, sf_dir):
    return _rows(features.correlations(_by_table(spark, sf_dir, nulls=True), META, KEYS), features.correlation_names(META))


def corr_features(spark, sf_dir):
    out = features.indicator_columns(population(spark, sf_dir), META, ["id"])
    return out.toDF("id", *[f"v{i}" for i in range(len(out.columns) - 1)])


def feat_bayes(spark, sf_dir):
    return _rows(features.bayes(_by_table(spark, sf_dir), META, KEYS), features.histogram_names(META) + features.correlation_names(META))


def feat_ensemble(spark, sf_dir):
    names = features.naive_names(META) + features.histogram_names(META) + features.correlation_names(META)
    return _rows(features.ensemble(_by_table(spark, sf_dir), META, KEYS), names)


# ---- publishers -------------------------------------------------------------------------------------------------


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c, t in df.dtypes if t == "double"})


def synth_hist(spark, sf_dir):
    df = population(spark, sf_dir)
    return _rounded(IndependentHistogram(META).fit(df).generate(df.count(), SEED).drop("copy"))


def publish_roundtrip(spark, sf_dir):
    df = _by_table(spark, sf_dir)
    path = scratch(spark, "published")
    made = IndependentHistogram(META).fit(df, KEYS).generate(_tenth(df), SEED)
    tables.publish(made, path, "parquet", KEYS)
    return _rounded(spark.read.schema(made.schema).parquet(path).select(*made.columns))


def _fixed(spark):
    return bayes.fixed_network(spark, NAMES, NETWORK)


def bayes_structure(spark, sf_dir):
    df = population(spark, sf_dir)
    binning = distributions.Binning(META, 10)
    facts = bayes.table_facts(distributions.profile(df, binning))
    net = bayes.tree_structure(binning.compact(df), binning, facts, [], SEED, None)
    return bayes.structure_rows(net, NAMES).select("step", "child", F.array_join("parents", " ").alias("parents"))


def _searched(model):
    def query(spark, sf_dir):
        net = model.fit(population(spark, sf_dir)).network
        return bayes.structure_rows(net, NAMES).select("step", "child", F.array_join("parents", " ").alias("parents"))

    return query


def synth_bayes_many(spark, sf_dir):
    """One network for each table, all along the fixed edges, generated together."""
    df = _by_table(spark, sf_dir)
    net = df.select(*KEYS).distinct().crossJoin(F.broadcast(_fixed(spark)))  # one row
    made = bayes.BayesianNet(META).fit(df, KEYS, net).generate(_tenth(df), SEED)
    return _rounded(made).drop("copy")


def cpt_fit(spark, sf_dir):
    df, binning, net = population(spark, sf_dir), distributions.Binning(META, 10), _fixed(spark)
    cells = bayes.cell_counts(binning.compact(df), net, binning, [], 1)
    cpt = bayes.conditional_distributions(cells, net, binning, [], 1)
    out = bayes.distribution_rows(cpt, net, binning)
    return out.select("step", "child", "parent_codes", "bin", F.col("n").cast("bigint").alias("n"), F.round("prob", 9).alias("prob"))


def synth_bayes(spark, sf_dir):
    df = population(spark, sf_dir)
    model = bayes.BayesianNet(META).fit(df, network=_fixed(spark))
    return _rounded(model.generate(df.count(), SEED).drop("copy"))


def privbayes_counts(spark, sf_dir):
    df, binning, net = population(spark, sf_dir), distributions.Binning(META, 10), _fixed(spark)
    scale = bayes.PrivBayes(META, epsilon=1.0).noise_scale
    cells = bayes.cell_counts(binning.compact(df), net, binning, [], 1, scale, SEED)
    return cells.select("tab", F.array_join(F.col("codes").cast("array<string>"), " ").alias("codes"), F.round("n", 6).alias("n"))


def synth_privbayes(spark, sf_dir):
    df = population(spark, sf_dir)
    model = bayes.PrivBayes(META, epsilon=1.0).fit(df, network=_fixed(spark))
    return _rounded(model.generate(df.count(), SEED).drop("copy"))


def exp_mechanism(spark, sf_dir):
    df = population(spark, sf_dir)
    n = df.count()
    pairs = _pairs(spark, sf_dir)
    cands = pairs.select("a", "b", "mi", F.lit(n).alias("n"), (F.col("b") == "segment").alias("binary"))
    out = bayes.exponential_weights(cands, 0.5, len(INFO_COLUMNS), ["a"])
    return out.select("a", "b", F.round("score", 6).alias("score"), F.round("prob", 9).alias("prob"))


def digits(c: ColumnMeta) -> int:
    """Decimals that the order of summation leaves alone in drawn numbers: six places of the column's range."""
    return 6 - len(str(int(c.high - c.low)))


def _drawn_numbers() -> list[Column]:
    return [F.round(c.name, digits(c)).alias(c.name) for c in META.numeric]


def synth_gaussian(spark, sf_dir):
    df = population(spark, sf_dir)
    made = Gaussian(META).fit(df).generate(df.count(), SEED)
    return made.select("copy", "row", *_drawn_numbers())


def mixture_many(spark, sf_dir):
    """Two Gaussians for each table after six steps."""
    cols, ranges = [c.name for c in META.numeric], [(c.low, c.high) for c in META.numeric]
    fitted = Mixture(2, SEED, 6, float("-inf")).fit(_by_table(spark, sf_dir, True), cols, ranges, KEYS)
    means = [F.round(F.element_at("means", i + 1), 3).alias(f"mean_{n}") for i, n in enumerate(cols)]
    sds = [F.round(F.sqrt(F.element_at("cov", i * len(cols) + i + 1)), 3).alias(f"sd_{n}") for i, n in enumerate(cols)]
    return fitted.select("dataset_id", "n", F.round("fit", 7).alias("fit"), "component", F.round("weight", 7).alias("weight"), *means, *sds)


def synth_mixture_many(spark, sf_dir):
    """Tables drawn from the mixtures of :func:`mixture_many`, each with a tenth of the population's rows."""
    model = Gaussian(META, 2, SEED, 6, float("-inf")).fit(_by_table(spark, sf_dir, True), KEYS)
    made = model.generate(_tenth(population(spark, sf_dir)), SEED)
    return made.select("dataset_id", "copy", "row", *_drawn_numbers())


# ---- linkage and results ----------------------------------------------------------------------------------------

LINK_ON = ["status", "priority", "segment", "nation", "year"]


def _link_sides(spark, sf_dir):
    df = enc.bin_columns(population(spark, sf_dir, nation=True), META.derive(quids=("year",)))
    return df, sampling.draw(df, _tenth(df, 4), SEED, tag="probe").drop("draw")


def link_unique_member(spark, sf_dir):
    published, targets = _link_sides(spark, sf_dir)
    out = link_members(published, targets.select("id", *LINK_ON), LINK_ON)
    return out.select("id", "group_size", F.coalesce("linked", F.lit(0)).alias("linked"))


def link_unique_attribute(spark, sf_dir):
    published, targets = _link_sides(spark, sf_dir)
    out = link_attribute(published, targets.select("id", *LINK_ON), LINK_ON, "balance")
    return out.select("id", "group_size", F.coalesce("linked", F.lit(-99999.0)).alias("linked"))


def _gain_columns(df: DataFrame) -> DataFrame:
    rates = ("tp", "fp", "advantage_syn", "advantage_raw", "privacy_gain")
    return df.select(*evaluate.LINKAGE_BY, *[F.coalesce(F.round(c, 9), F.lit(-9.0)).alias(c) for c in rates])


def linkage_gain(spark, sf_dir):
    return _gain_columns(evaluate.linkage_gain(_linkage_facts(spark, sf_dir)))


def _inference_sides(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    base = population(spark, sf_dir).select(
        F.col("status").alias("dataset"), F.col("region").alias("target_id"), F.col("year").alias("run"),
        F.when(F.col("priority") == PRIORITY[0], evaluate.RAW).otherwise(F.col("priority")).alias("model"),
        F.pmod("id", F.lit(2)).cast("int").alias("presence"), "segment", "total",
    )
    label = base.withColumns({"attribute": F.lit("segment"), "guess": F.col("segment"), "prob_correct": F.lit(None).cast("double"), "numeric": F.lit(False)})
    number = base.withColumns({"attribute": F.lit("total"), "guess": F.col("total").cast("string"), "prob_correct": F.col("total") / 300000, "numeric": F.lit(True)})
    truth = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").cast("string").alias("target_id"),
        F.explode(F.array(
            F.struct(F.lit("segment").alias("attribute"), F.element_at(enc.literal_array(SEGMENT), F.col("r_regionkey") + 1).alias("target_secret")),
            F.struct(F.lit("total").alias("attribute"), F.lit("0").alias("target_secret")),
        )).alias("t"),
    ).select("target_id", "t.*")
    return label.unionByName(number), truth


def inference_gain(spark, sf_dir):
    return _inference_columns(evaluate.inference_gain(*_inference_sides(spark, sf_dir)))


def load_results_inference(spark, sf_dir):
    facts, truth = _inference_sides(spark, sf_dir)
    folder = scratch(spark, "json")
    results.write_json(facts, folder, results.INFERENCE)
    back = results.read_inference(spark, folder, lines=True).withColumn("numeric", F.col("attribute") == "total")
    return _inference_columns(evaluate.inference_gain(back.withColumn("run", F.col("run").cast("bigint")), truth))


def load_results_utility(spark, sf_dir):
    folder = scratch(spark, "json")
    results.write_json(evaluate.utility_records(_utility_facts(spark, sf_dir)), folder, results.UTILITY_TARGETS)
    back = results.read_utility_targets(spark, folder, lines=True)
    keys = ["dataset", "task", "model", F.col("run").cast("bigint").alias("run"), "target_id", "record_id"]
    return back.select(*keys, F.round("accuracy", 9).alias("accuracy"))


def load_results_totals(spark, sf_dir):
    """Accuracies of whole test tables, written by prediction task and label and read back."""
    facts = _utility_facts(spark, sf_dir).withColumn("task", F.concat(F.lit("RandomForestClassifier"), "task"))
    folder = scratch(spark, "json")
    results.write_json(evaluate.utility_totals(facts), folder, results.UTILITY_TOTALS)
    back = results.read_utility_totals(spark, folder, lines=True)
    keys = ["dataset", "prediction_model", "label_var", "model", "target_id"]
    return back.groupBy(*keys).agg(F.count("*").alias("runs"), F.round(F.avg("accuracy"), 9).alias("accuracy"))


def _inference_columns(out: DataFrame) -> DataFrame:
    keys = ["dataset", "target_id", "attribute", "run", "model"]
    return out.select(*keys, *[F.coalesce(F.round(c, 9), F.lit(-9.0)).alias(c) for c in out.columns if c not in keys])


def _utility_facts(spark, sf_dir) -> DataFrame:
    return population(spark, sf_dir).select(
        F.col("status").alias("dataset"), F.col("segment").alias("task"), F.col("priority").alias("model"), F.col("year").alias("run"),
        F.when(F.pmod("id", F.lit(2)) == 0, "OUT").otherwise(F.col("region")).alias("target_id"), F.col("region").alias("record_id"),
        (F.col("total") > F.col("balance") * 50).cast("double").alias("score"), F.pmod("id", F.lit(2)).cast("int").alias("presence"),
    )


def utility_gain(spark, sf_dir):
    facts = _utility_facts(spark, sf_dir)
    records = evaluate.utility_records(facts).withColumn("level", F.lit("record"))
    totals = evaluate.utility_totals(facts).withColumns({"level": F.lit("total"), "record_id": F.lit("all")})
    return records.unionByName(totals).withColumn("accuracy", F.round("accuracy", 9))


def utility_advantage(spark, sf_dir):
    out = evaluate.utility_advantage(_utility_facts(spark, sf_dir), ["task", "model"])
    return out.select("task", "model", *[F.round(c, 9).alias(c) for c in ("p_in", "p_out", "utility_advantage")])


def prob_removed(spark, sf_dir):
    facts = population(spark, sf_dir).select(
        "segment", (F.col("balance") > 2000).cast("int").alias("before"), (F.col("total") > 250000).cast("int").alias("after")
    )
    return evaluate.probability_removed(facts, ["segment"]).withColumn("prob_removed", F.round("prob_removed", 9))


def mia_gain_alt(spark, sf_dir):
    facts = _linkage_facts(spark, sf_dir).select("model", F.col("guess").alias("prediction"), F.col("secret").alias("label"))
    acc = evaluate.accuracy(facts, ["model"])
    return acc.select("model", F.round("accuracy", 9).alias("accuracy"), F.round(evaluate.membership_gain(F.col("accuracy")), 9).alias("gain"))


def avg_privacy_gain(spark, sf_dir):
    gains = evaluate.linkage_gain(_linkage_facts(spark, sf_dir))
    return evaluate.average_gain(gains, PRIORITY[0]).withColumn("privacy_gain", F.round("privacy_gain", 9))


def avg_accuracy(spark, sf_dir):
    totals = population(spark, sf_dir).select(
        F.col("priority").alias("model"), F.col("segment").alias("label_var"),
        F.when(F.pmod("id", F.lit(2)) == 0, "OUT").otherwise(F.col("region")).alias("target_id"),
        ((F.col("balance") + 1000) / 11000).alias("accuracy"),
    )
    out = evaluate.accuracy_spread(totals)
    return out.select("model", "label_var", *[F.round(c, 9).alias(c) for c in out.columns if c not in ("model", "label_var")])


# ---- attacks ----------------------------------------------------------------------------------------------------


def shadow_data(spark, sf_dir):
    df = population(spark, sf_dir)
    ids = sampling.pick_targets(df, 3, seed=SEED)
    drawn = sampling.draw(sampling.without(df, ids), _tenth(df), SEED, 2, tag="shadow")
    made = games.publish_variants(IndependentHistogram(META), drawn, sampling.only(df, ids), ids, 2, _tenth(df, 20), 2, SEED)
    label = F.when(F.col("dataset_id").endswith(":OUT"), 0).otherwise(1)
    return _rounded(made.withColumn("label", label))


def shadow_data_sanitised(spark, sf_dir):
    shadow = durable(_tables(spark, sf_dir, 2, "shadow", nulls=True))
    out = sanitise.Sanitiser(META, 10, 1, 0.99, 3, (), QUIDS).sanitise(shadow, KEYS)
    label = F.when(F.col("dataset_id").endswith(":OUT"), 0).otherwise(1)
    return out.withColumn("label", label)


def attack_knn(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features"), "label")
    near = nearest(vectors, vectors, 5, same_table=True)
    return vote(near).select("id", "prediction", F.round("confidence", 6).alias("confidence"))


def _many_tables(spark, sf_dir) -> DataFrame:
    """Histogram features of the population cut into many small tables, labelled by whether a table holds an order of status P."""
    df = population(spark, sf_dir).withColumn("dataset_id", F.concat_ws("-", "region", "year", "priority", (F.col("id") % 4).cast("string")))
    vectors = features.histogram(df, META, KEYS)
    labels = df.groupBy(*KEYS).agg(F.max((F.col("status") == "P").cast("int")).alias("label"))
    return durable(vectors.join(labels, KEYS))


def _attack(kind: str, out: str, **options):
    def query(spark, sf_dir):
        # Fitted on the tables of the years up to 1995, asked about those of the later years.
        every = _many_tables(spark, sf_dir)
        late = F.split_part("dataset_id", F.lit("-"), F.lit(2)) > "1995"
        attack = MembershipAttack(kind, SEED, options).fit(every.where(~late))
        vectors = every.where(late)
        if out == "confidence":
            return attack.confidence(vectors).select("dataset_id", "label", F.round(F.col("confidence") + 1e-9, 5).alias("confidence"))
        linked = None
        if out == "linkage":
            # A published table with a single row stands for a unique link; the last cells count rows per segment.
            rows = F.aggregate(F.slice("features", -len(SEGMENT), len(SEGMENT)), F.lit(0.0), lambda a, x: a + x)
            vectors, linked = vectors.withColumn("linked", F.when(rows == 1, 1)), "linked"
        return attack.attack(vectors, linked=linked).select("dataset_id", "label", "guess", "guess_source")

    return query


def attr_linreg(spark, sf_dir):
    df = _by_table(spark, sf_dir)
    attack = LinearAttribute(META, "total")
    models = durable(attack.fit(df, KEYS))
    out = attack.guess(df, models, KEYS)
    return out.select("dataset_id", "id", F.round("model_guess", 2).alias("guess"), F.round(F.col("likelihood") * 1e6, 5).alias("likelihood"))


def linreg_sigma(spark, sf_dir):
    models = LinearAttribute(META, "total").fit(_by_table(spark, sf_dir), KEYS)
    known = [n for n in NAMES if n != "total"]
    slopes = [F.round(F.element_at("beta", i + 1), 4).alias(f"slope_{n}") for i, n in enumerate(known)]
    return models.select("dataset_id", *slopes, tidy(F.element_at("means", -1)).alias("mean"), tidy(F.col("sigma") / 1e6).alias("sigma"))


def _attribute_forest(keys: list, **options):
    def query(spark, sf_dir):
        attack = ForestAttribute(META, "segment", SEED, **options)
        train, test = tables.split(as_tables(population(spark, sf_dir)) if keys else population(spark, sf_dir), "year <= 1998", "year > 1998")
        out = attack.guess(test, attack.fit(train, keys), keys)
        return out.select(*keys, "id", "model_guess", F.round(F.col("likelihood") + 1e-9, 6).alias("likelihood"))

    return query


def _task(kind: str, label: str, **options):
    def query(spark, sf_dir):
        train, test = tables.split(population_nulls(spark, sf_dir), "year <= 1998", "year > 1998")
        return PredictTask(kind, META, label, SEED, options).fit(train).evaluate(test).select("id", F.round("score", 2).alias("score"))

    return query


def _tasks(kind: str, label: str, **options):
    """One table for each region, each scored on all later records."""

    def query(spark, sf_dir):
        train, test = tables.split(population_nulls(spark, sf_dir).withColumn("dataset_id", F.col("region")), "year <= 1998", "year > 1998")
        found = PredictTask(kind, META, label, SEED, options).fit(train, KEYS).score(test, F.col("id") % 100 == 0)
        return found.select("dataset_id", F.coalesce("record", F.lit("all")).alias("record"), F.round("score", 1).alias("score"), "n")

    return query


def svc_calibration(spark, sf_dir):
    """Platt's curve for given margins: how well the total tells urgent orders, by table."""
    df = _by_table(spark, sf_dir).select("dataset_id", ((F.col("total") - 250000) / 100000 + F.col("balance") / 5000).alias("margin"), F.col("priority").isin("1-URGENT", "2-HIGH").cast("int").alias("label"))
    return platt(df, KEYS).select("dataset_id", F.round("slope", 6).alias("slope"), F.round("offset", 6).alias("offset"))


# ---- games ------------------------------------------------------------------------------------------------------


def _game(spark, sf_dir, **more):
    df = durable(population(spark, sf_dir))
    n = df.count()
    config = games.GameConfig(
        publishers=(bayes.BayesianNet(META), sanitise.Sanitiser(META, 10, 1, 0.99, 2, (), QUIDS)),
        n_iter=1, size_raw_a=n // 2, size_raw_t=n // 10, size_syn_t=n // 10, n_shadows=3, n_syn_a=2, n_syn_t=1, n_targets=1,
        seed=SEED, **more,
    )
    return df, config


def game_linkage(spark, sf_dir):
    df, config = _game(spark, sf_dir, feature_sets=("Naive", "Histogram"), attack_options=(("numTrees", 10), ("maxDepth", 5)))
    return games.linkage_game(df, META, config)


def game_inference(spark, sf_dir):
    sensitive = (("total", "LinReg"), ("segment", "Classification"))
    df, config = _game(spark, sf_dir, sensitive=sensitive, attack_options=(("trees", 10), ("depth", 5)))
    return games.inference_game(df, META, config)


def game_utility(spark, sf_dir):
    tasks = (("RandForestClass", "segment"),)
    df, config = _game(spark, sf_dir, tasks=tasks, train="year <= 1998", test="year > 1998", n_test_records=3, attack_options=(("trees", 10), ("depth", 5)))
    config = replace(config, size_raw_t=df.where("year <= 1998").count() // 10)
    return games.utility_game(df, META, config)[1]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k-anonymous release of the population: labels and binned order year, small groups suppressed."""
    df = enc.bin_columns(population(spark, sf_dir), META.derive(quids=("year",)))
    return sanitise.k_anonymise(df, list(QUIDS), 5)


_PLAIN = [
    load_typed, encode_codes, decode_codes, union_decode, infer_metadata, train_test_filter, results_json_roundtrip,
    load_results_linkage, encode_onehot, encode_scaled, encode_inferred_ranges, decode_scaled, bin_quids, bin_edges,
    bin_encode, camel_names, candidate_key, impute, impute_null_table, quantiles_refined, sanitise_cap, sanitise_drop, sanitise_rare,
    sanitise_k_anonymity, sanitise_full, sample_members, drop_targets, game_members, shadow_members, new_categories,
    hist_distribution, cat_distribution, cdf, attr_profile, freq_full_domain, normalise, mi_pairs, nmi_pairs, wide_nmi_pairs, wide_distribution, mi_degree2,
    feat_naive, feat_naive_array, feat_histogram, feat_histogram_sorted, feat_corr, corr_features, feat_bayes,
    feat_ensemble, synth_hist, publish_roundtrip, bayes_structure, cpt_fit, synth_bayes, synth_bayes_many, privbayes_counts,
    synth_privbayes, exp_mechanism, synth_gaussian, mixture_many, synth_mixture_many, link_unique_member, link_unique_attribute, linkage_gain,
    inference_gain, load_results_inference, load_results_utility, load_results_totals, utility_gain, utility_advantage, prob_removed, mia_gain_alt, avg_privacy_gain, avg_accuracy,
    shadow_data, shadow_data_sanitised, attack_knn, attr_linreg, linreg_sigma, svc_calibration, game_linkage,
    game_inference, game_utility,
]


def queries() -> dict:
    named = {f.__name__: f for f in _PLAIN}
    named["centre"] = centre_columns
    named["bayes_structure_degree2"] = _searched(bayes.BayesianNet(META, 10, 2))
    named["bayes_structure_private"] = _searched(bayes.PrivBayes(META, 10, 1, epsilon=2.0))
    named["bayes_structure_private_degree2"] = _searched(bayes.PrivBayes(META, 10, 2, epsilon=2.0))
    named["attr_forest"] = _attribute_forest([], trees=10, depth=5)
    named["attr_forest_many"] = _attribute_forest(KEYS, trees=10, depth=5)
    named["mia_train_rf"] = _attack("forest", "guess", numTrees=20, maxDepth=8)
    named["mia_attack"] = _attack("forest", "linkage", numTrees=20, maxDepth=8)
    named["mia_confidence"] = _attack("forest", "confidence", numTrees=20, maxDepth=8)
    named["mia_train_logreg"] = _attack("logistic", "guess")
    named["mia_confidence_logreg"] = _attack("logistic", "confidence")
    named["mia_train_knn"] = _attack("knn", "guess")
    named["mia_train_svc"] = _attack("svc", "guess")
    named["mia_confidence_svc"] = _attack("svc", "confidence")
    named["mia_train_mlp"] = _attack("mlp", "guess", maxIter=20)
    named["util_forest"] = _task("forest", "segment", numTrees=20, maxDepth=8)
    named["util_logreg"] = _task("logistic", "segment", maxIter=6)
    named["util_linreg"] = _task("linear", "total")
    named["util_forest_many"] = _tasks("forest", "segment", numTrees=10, maxDepth=5)
    named["util_logreg_many"] = _tasks("logistic", "priority", maxIter=6)
    named["util_linreg_many"] = _tasks("linear", "total")

    def fresh(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            release()
            return f(spark, sf_dir)

        return run

    return {name: fresh(f) for name, f in named.items()}
