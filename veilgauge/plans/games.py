"""The linkage, inference and utility games as batch jobs.

A game draws raw tables, makes a variant of each with a target inserted, publishes all variants and attacks them. All
drawn tables live in one DataFrame keyed by ``dataset_id``; each publisher is fitted to all of them in one job, features
of all published tables come from one job, and so do the forests and the logistic and linear models of all tables and targets. Only support vector and
neural attacks are fitted one by one.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import bin_columns
from veilgauge.meta import TableMeta
from veilgauge.operators import features as feats
from veilgauge.operators.attribute import ForestAttribute, LinearAttribute, with_links
from veilgauge.operators.bayes import BayesianNet, PrivBayes
from veilgauge.operators.evaluate import RAW
from veilgauge.operators.gaussian import Gaussian
from veilgauge.operators.histogram import IndependentHistogram
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.linkage import link_attribute, link_members
from veilgauge.operators.membership import GROUPED, MembershipAttack, train_many
from veilgauge.operators.predict import PredictTask
from veilgauge.operators.sampling import OUT, draw, only, pick_targets, with_targets, without
from veilgauge.operators.sanitise import Sanitiser

# Names in run configurations.
GENERATORS = {
    "IndependentHistogram": lambda meta, *p: IndependentHistogram(meta, *p[:2]),
    "BayesianNet": lambda meta, bins=10, degree=1, infer=False, _parallel=True, seed=42: BayesianNet(meta, bins, degree, infer, 42 if seed is None else seed),
    "PrivBayes": lambda meta, bins=10, degree=1, epsilon=0.1, infer=False, _parallel=True, seed=42: PrivBayes(
        meta, bins, degree, infer, 42 if seed is None else seed, epsilon
    ),
    "GaussianMixtureModel": lambda meta, *p: Gaussian(meta, *p),
}
SANITISERS = {
    "SanitiserNHS": lambda meta, nbins=10, rare=0, q=1, k=1, drop=(), quids=(): Sanitiser(
        meta, nbins, rare, q, k, tuple(drop or ()), tuple(quids or ())
    )
}
TASK_KINDS = {"RandForestClass": "forest", "LogRegClass": "logistic", "LinReg": "linear"}
ATTACK_KINDS = ("LinReg", "Classification")


def publishers_from(config: dict, meta: TableMeta) -> list:
    """Publishers named in a run configuration; unknown names are refused."""
    out = []
    for section, registry in (("generativeModels", GENERATORS), ("sanitisationTechniques", SANITISERS)):
        for name, params in (config.get(section) or {}).items():
            if name not in registry:
                raise ValueError(f"unknown publisher {name!r} in {section}")
            out += [registry[name](meta, *p) for p in params]
    return out


@dataclass(frozen=True)
class GameConfig:
    publishers: tuple = ()
    n_iter: int = 15
    size_raw_a: int = 10_000
    size_raw_t: int = 1_000
    size_syn_t: int = 1_000
    n_shadows: int = 10
    n_syn_a: int = 10
    n_syn_t: int = 5
    n_targets: int = 0
    targets: tuple = ()
    n_test_records: int = 0
    test_records: tuple = ()
    sensitive: tuple = ()  # (column, "LinReg" | "Classification")
    tasks: tuple = ()  # (kind name, label)
    train: str | None = None
    test: str | None = None
    feature_sets: tuple = ("Naive", "Histogram", "Correlations")
    attack: str = "forest"
    attack_options: tuple = ()
    dataset: str = "population"
    seed: int = 42
    threads: int = 4

    @staticmethod
    def from_dict(doc: dict, meta: TableMeta, **more) -> GameConfig:
        """Run configuration with the usual keys. Filters are SQL texts."""
        sensitive = tuple((doc.get("sensitiveAttributes") or {}).items())
        for col, kind in sensitive:
            if kind not in ATTACK_KINDS:
                raise ValueError(f"unknown attack {kind!r} for {col!r}")
        tasks = []
        for kind, labels in (doc.get("utilityTasks") or {}).items():
            if kind not in TASK_KINDS:
                raise ValueError(f"unknown task {kind!r}")
            tasks += [(kind, p[0]) for p in labels]
        names = {
            "nIter": "n_iter", "sizeRawA": "size_raw_a", "sizeRawT": "size_raw_t", "sizeSynT": "size_syn_t",
            "nShadows": "n_shadows", "nSynA": "n_syn_a", "nSynT": "n_syn_t", "nTargets": "n_targets",
            "nTestRecords": "n_test_records",
        }
        plain = {ours: doc[theirs] for theirs, ours in names.items() if theirs in doc}
        # As many random test records as random targets, unless the configuration says otherwise.
        plain.setdefault("n_test_records", plain.get("n_targets", 0))
        filters = doc.get("dataFilter") or {}
        return GameConfig(
            publishers=tuple(publishers_from(doc, meta)), targets=tuple(doc.get("Targets") or ()),
            test_records=tuple(doc.get("TestRecords") or ()), sensitive=sensitive, tasks=tuple(tasks),
            train=filters.get("train"), test=filters.get("test"), **{**plain, **more},
        )


KEYS = ["dataset_id"]
COPIES = ["dataset_id", "copy"]


def publish_tables(publisher, tables: DataFrame, n: int, copies: int, seed: int) -> DataFrame:
    """Published variants of all tables, keyed by ``dataset_id`` and ``copy``. A sanitiser makes one copy and keeps ids."""
    if publisher.generates:
        return publisher.fit(tables, KEYS).generate(n, seed, copies)
    return publisher.sanitise(tables, KEYS).withColumn("copy", F.lit(0))


def publish_variants(publisher, drawn: DataFrame, targets: DataFrame, ids: Sequence, draws: int, n: int, copies: int, seed: int) -> DataFrame:
    """:func:`publish_tables` for every draw without a target and with each. A publisher that adds up counts never sees the tables with a target as rows."""
    if hasattr(publisher, "fit_variants"):
        return publisher.fit_variants(drawn, targets, ids, draws).generate(n, seed, copies)
    return publish_tables(publisher, durable(with_targets(drawn, targets, ids, draws)), n, copies, seed)


def _where(df: DataFrame) -> DataFrame:
    """Split a dataset id into ``run`` and ``target``."""
    parts = F.split("dataset_id", ":", 2)
    return df.withColumns({"run": parts[0].cast("int"), "target": parts[1]})


def _features(published: DataFrame, publisher, name: str) -> DataFrame:
    extract = feats.FEATURE_SETS[name]
    if name in ("Naive", "Correlations"):
        return extract(published, publisher.out_meta, COPIES)
    nbins = publisher.nbins if isinstance(publisher, Sanitiser) else 10
    return extract(published, publisher.out_meta, COPIES, nbins)


def _complete(vectors: DataFrame, dims: DataFrame) -> DataFrame:
    """A zero vector for tables of which nothing was published."""
    width = vectors.agg(F.max(F.size("features"))).first()[0] or 1
    joined = dims.join(vectors, COPIES, "left")
    return joined.withColumn("features", F.coalesce("features", F.array_repeat(F.lit(0.0), width)))


def _dims(tables: DataFrame, copies: int) -> DataFrame:
    return tables.select(*KEYS).distinct().withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))


def _variants(spark, ids: Sequence, draws: int, copies: int) -> DataFrame:
    """``dataset_id, copy`` of every published copy of every draw, without a target and with each."""
    names = F.array(*[F.lit(t) for t in [OUT, *[str(i) for i in ids]]])
    rows = spark.range(draws * copies).select(F.floor(F.col("id") / copies).cast("string").alias("draw"), F.pmod("id", F.lit(copies)).cast("int").alias("copy"))
    return rows.withColumn("target", F.explode(names)).select(F.concat_ws(":", "draw", "target").alias("dataset_id"), "copy")


def _ask(tables: DataFrame, probes: DataFrame, ids: Sequence) -> DataFrame:
    """Which target is judged on which table: all of them on a table without target, otherwise the one inserted."""
    everyone = F.array(*[F.lit(str(i)) for i in ids])
    asked = tables.withColumn("target_id", F.explode(F.when(F.col("target") == OUT, everyone).otherwise(F.array("target"))))
    return attach(asked, probes, ["target_id"], "inner", bound=len(ids))


def _for_targets(vectors: DataFrame, ids: Sequence) -> DataFrame:
    """Feature rows once for each target they concern: tables without a target for all of them, others for their own. Only features are repeated, never tables."""
    everyone = F.array(*[F.lit(str(i)) for i in ids])
    rows = vectors.withColumn("target_id", F.explode(F.when(F.col("target") == OUT, everyone).otherwise(F.array("target"))))
    return rows.withColumn("row", F.concat_ws("/", "dataset_id", F.col("copy").cast("string")))


def linkage_game(population: DataFrame, meta: TableMeta, config: GameConfig) -> DataFrame:
    """``dataset, target_id, model, run, feature_set, secret, guess, guess_source``: one row per attacked table.

    The adversary's tables without a target do not depend on the target, so all targets share them.
    """
    c = config
    ids = pick_targets(population, c.n_targets, c.targets, c.seed)
    targets, rest = only(population, ids), without(population, ids)
    prior = durable(draw(rest, c.size_raw_a, c.seed, tag="prior").drop("draw"))
    games = durable(with_targets(draw(rest, c.size_raw_t, c.seed, c.n_iter, tag="game"), targets, ids, c.n_iter))
    facts: list[DataFrame] = []
    for pub in c.publishers:
        splits = c.n_shadows if pub.generates else c.n_shadows * c.n_syn_a
        shadow = durable(draw(prior, c.size_raw_t, c.seed, splits, tag="shadow"))
        copies_a, copies_t = (c.n_syn_a, c.n_syn_t) if pub.generates else (1, 1)
        pub_a = durable(publish_variants(pub, shadow, targets, ids, splits, c.size_syn_t, copies_a, c.seed))
        pub_t = durable(publish_tables(pub, games, c.size_syn_t, copies_t, c.seed + 1))
        linked = None
        if not pub.generates:
            cats = [m.name for m in pub.out_meta.discrete]
            asked = _where(games.select(*KEYS).distinct())
            probes = bin_columns(targets, pub.out_meta).select(F.col("id").cast("string").alias("target_id"), *cats)
            asked = _ask(asked, probes, ids)
            linked = durable(link_members(pub_t, asked, cats, KEYS).select(*KEYS, "target_id", "linked"))
        sets = list(c.feature_sets) + (["Ensemble"] if not pub.generates and "Ensemble" not in c.feature_sets else [])
        for name in sets:
            train = durable(_where(_complete(_features(pub_a, pub, name), _variants(prior.sparkSession, ids, splits, copies_a))))
            play = durable(_where(_complete(_features(pub_t, pub, name), _variants(prior.sparkSession, ids, c.n_iter, copies_t))))
            train = _for_targets(train.withColumn("label", (F.col("target") != OUT).cast("int")), ids)
            play = _for_targets(play, ids)
            if linked is not None:
                play = play.join(linked, [*KEYS, "target_id"], "left")
            mia = MembershipAttack(c.attack, c.seed, dict(c.attack_options))
            by_link = "linked" if linked is not None else None
            if c.attack in GROUPED:
                played = [mia.fit(train, "row", ["target_id"]).attack(play, "row", by_link)]
            else:

                def attack_one(tid, train=train, play=play, by_link=by_link):
                    mine = F.col("target_id") == str(tid)
                    one = MembershipAttack(c.attack, c.seed, dict(c.attack_options)).fit(train.where(mine), "row")
                    return one.attack(play.where(mine), "row", by_link)

                played = train_many(attack_one, ids, c.threads)
            facts += [
                out.select(
                    F.lit(c.dataset).alias("dataset"), "target_id", F.lit(pub.name).alias("model"), "run",
                    F.lit(name).alias("feature_set"), (F.col("target") != OUT).cast("int").alias("secret"), "guess", "guess_source",
                )
                for out in played
            ]
    return _union(facts)


def inference_game(population: DataFrame, meta: TableMeta, config: GameConfig) -> DataFrame:
    """``dataset, target_id, attribute, model, run, guess, prob_correct, presence, guess_source, numeric, target_secret``.

    The raw tables are attacked with the model trained without the target; published tables are attacked with a model
    trained on each of them. Raw and sanitised tables are linked first.
    """
    c = config
    ids = pick_targets(population, c.n_targets, c.targets, c.seed)
    targets, rest = only(population, ids), without(population, ids)
    games = durable(with_targets(draw(rest, c.size_raw_t, c.seed, c.n_iter, tag="game"), targets, ids, c.n_iter))
    published: list[tuple] = [(None, RAW, meta, games.withColumn("copy", F.lit(0)), 1)]
    for pub in c.publishers:
        copies = c.n_syn_t if pub.generates else 1
        published.append((pub, pub.name, pub.out_meta, durable(publish_tables(pub, games, c.size_syn_t, copies, c.seed)), copies))
    facts = []
    for pub, name, out_meta, tables, copies in published:
        asked = _where(_dims(games, copies))
        for column, kind in c.sensitive:
            attack = LinearAttribute(out_meta, column) if kind == "LinReg" else ForestAttribute(out_meta, column, c.seed, **dict(c.attack_options))
            probes = bin_columns(targets, out_meta).withColumn("target_id", F.col("id").cast("string"))
            probes = probes.select("target_id", *out_meta.names)
            rows = _ask(asked, probes, ids)
            if pub is None or not pub.generates:
                known = [m.name for m in out_meta.discrete if m.name != column]
                rows = link_attribute(tables, rows, known, column, KEYS)
            else:
                rows = rows.withColumn("linked", F.lit(None).cast("string"))
            rows = rows.withColumn("present", (F.col("target") != OUT).cast("int"))
            if pub is None:
                # One model per run, trained on the table without a target, judges all variants of that run.
                base = _where(tables).where(F.col("target") == OUT).drop("dataset_id", "copy", "target", "draw", "label")
                models = attack.fit(base, ["run"])
                guesses = attack.guess(rows, models, ["run"])
            else:
                models = attack.fit(tables, COPIES)
                guesses = attack.guess(rows, models, COPIES)
            numeric = kind == "LinReg"
            facts.append(
                with_links(guesses).select(
                    F.lit(c.dataset).alias("dataset"), "target_id", F.lit(column).alias("attribute"), F.lit(name).alias("model"), "run",
                    "guess", "prob_correct", F.col("present").alias("presence"), "guess_source", F.lit(numeric).alias("numeric"),
                    F.col(f"`{column}`").cast("string").alias("target_secret"),
                )
            )
    return _union(facts)


def utility_game(population: DataFrame, meta: TableMeta, config: GameConfig) -> tuple[DataFrame, DataFrame]:
    """Scores per test record and mean scores over the whole test table, for every published table.

    Both frames carry ``dataset, task, model, run, target_id, copy``; the first has ``record_id, score``, the second
    ``score`` (mean of one training) and ``records``. A table of which nothing was published has all its rows, with null scores.
    """
    c = config
    train = population.where(F.expr(c.train)) if c.train else population
    test = durable(population.where(F.expr(c.test)) if c.test else population)
    ids = pick_targets(train, c.n_targets, c.targets, c.seed)
    targets, rest = only(train, ids), without(train, ids)
    asked = durable(only(test, pick_targets(test, c.n_test_records, c.test_records, c.seed + 7)))
    games = durable(with_targets(draw(rest, c.size_raw_t, c.seed, c.n_iter, tag="game"), targets, ids, c.n_iter))
    published: list[tuple] = [(RAW, meta, games.withColumn("copy", F.lit(0)), False)]
    for pub in c.publishers:
        copies = c.n_syn_t if pub.generates else 1
        published.append((pub.name, pub.out_meta, durable(publish_tables(pub, games, c.size_syn_t, copies, c.seed)), pub.generates))
    n_test = test.count()
    wanted = [r[0] for r in asked.select("id").collect()]
    kind = dict(test.dtypes)["id"]
    flag = F.col("id").isin(wanted) if wanted else F.lit(False)
    ones, means = [], []
    for name, out_meta, tables, generates in published:
        copies = c.n_syn_t
        dims = _where(_dims(games, copies))
        for task_kind, label in c.tasks:
            options = dict(c.attack_options) if TASK_KINDS[task_kind] == "forest" else {}
            options = {{"trees": "numTrees", "depth": "maxDepth"}.get(k, k): v for k, v in options.items()}
            task = PredictTask(TASK_KINDS[task_kind], out_meta, label, c.seed, options)
            # Without a generator there is one published table; repeats differ by the randomness of the learner only.
            repeats = 1 if generates else copies
            task.fit(tables, COPIES if generates else KEYS, repeats)
            scored = task.score(test, flag)
            if not generates:
                scored = scored.withColumn("copy", F.col("repeat") if repeats > 1 else F.lit(0))
            scored = durable(scored)
            tags = [F.lit(c.dataset).alias("dataset"), F.lit(task.name).alias("task"), F.lit(name).alias("model"), "run", F.col("target").alias("target_id"), "copy"]
            sums = attach(dims, scored.where("record is null").select(*COPIES, "score", "n"), COPIES, "left", dims.count())
            means.append(sums.select(*tags, F.when(F.col("n") > 0, F.col("score") / F.col("n")).alias("score"), F.lit(n_test).cast("long").alias("records")))
            each = dims.withColumn("record", F.explode(F.array(*[F.lit(str(i)) for i in wanted]))) if wanted else dims.where("false").withColumn("record", F.lit(""))
            each = attach(each, scored.where("record is not null").select(*COPIES, "record", "score"), [*COPIES, "record"], "left")
            ones.append(each.select(*tags, F.col("record").cast(kind).alias("record_id"), "score"))
    return durable(_union(ones)), durable(_union(means))


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    if not parts:
        raise ValueError("nothing to attack: no publishers, attributes or tasks")
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole
