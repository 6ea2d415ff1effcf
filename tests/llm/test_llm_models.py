"""Quality, toxicity, search, chat, mixing, sharding and the pipeline."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veilgauge.llm import chat, knn, mixing, quality, sharding, toxicity
from veilgauge.llm.common import parquet

ODD = [(900, None), (901, ""), (None, "alone here"), (None, None), (903, "word " * 40_000), (904, "twice"), (904, "twice")]


def prose(rng, n):
    return " ".join(f"w{rng.randrange(300)}" for _ in range(n))


@pytest.fixture(scope="module")
def judged(make_docs):
    """300 clean documents, 60 of junk, 60 with an insult."""
    rng = random.Random(1)
    rows = [(i, prose(rng, rng.randrange(5, 80))) for i in range(300)]
    rows += [(300 + i, " ".join(w + "!!" for w in prose(rng, rng.randrange(30, 80)).split())) for i in range(60)]
    rows += [(400 + i, prose(rng, 20) + " brutish " + prose(rng, 20)) for i in range(60)]
    return rows


def test_quality_tells_junk(spark, make_docs, judged):
    labels = spark.createDataFrame([(i, int(not 300 <= i < 360), 0) for i, _ in judged if i % 2], "doc_id long, quality int, toxic int")
    labels = labels.unionByName(labels.limit(3)).unionByName(spark.createDataFrame([(None, 1, 0), (2, None, 0)], labels.schema))
    docs = make_docs(judged + ODD)
    out = quality.resample(docs, labels).collect()
    assert len(out) == len(judged) + len(ODD)
    kept = {r.doc_id for r in out if r.kept}
    unseen = [i for i, _ in judged if i % 2 == 0]
    assert np.mean([(i in kept) == (not 300 <= i < 360) for i in unseen]) > 0.97
    again = quality.resample(docs.repartition(5), labels).collect()
    assert sorted(out, key=str) == sorted(again, key=str)
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_quality_draws_the_k_largest(spark, make_docs, judged):
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in judged], "doc_id long, quality int")
    out = quality.resample(make_docs(judged), labels, k=100).collect()
    cut = sorted((r.noisy for r in out), reverse=True)[99]
    assert {r.doc_id for r in out if r.kept} == {r.doc_id for r in out if r.noisy >= cut}
    none = quality.resample(make_docs(judged[:5]), labels.filter("doc_id < 0")).collect()
    assert all(r.kept and r.log_ratio == 0 for r in none)
    assert quality.resample(make_docs(judged).filter("doc_id < 0"), labels).isEmpty()


def test_log_ratios_like_plain(make_docs, spark):
    rows = [(1, "a b b a"), (2, "a, c"), (3, "")]
    known = spark.createDataFrame([(1, True), (2, False)], "doc_id long, good boolean")
    got = quality.log_ratios(make_docs(rows), known, 50)
    import pyarrow as pa

    raw, target = np.zeros(50), np.zeros(50)
    for i, text in rows:
        _, bucket = quality.features(pa.array([text]), 50)
        assert len(bucket) == (0 if not text else 7 if i == 1 else 5)
        np.add.at(raw, bucket, 1)
        if i == 1:
            np.add.at(target, bucket, 1)
    assert np.allclose(got, np.log((target + 1) / (target.sum() + 50)) - np.log((raw + 1) / (raw.sum() + 50)))


def test_best_cut():
    assert quality.best_cut(np.array([1.0, 2.0, 5.0, 6.0]), np.array([False, False, True, True])) == 3.5


def test_toxicity_finds_unseen_insults(spark, make_docs, judged):
    labels = spark.createDataFrame([(i, int(i >= 400)) for i, _ in judged if i % 3], "doc_id long, toxic int")
    labels = labels.unionByName(spark.createDataFrame([(None, 1), (5, None)], labels.schema))
    out = toxicity.score(make_docs(judged + ODD), labels).collect()
    assert len(out) == len(judged) + len(ODD)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
    unseen = [r for r in out if r.held_out and r.doc_id < 900]
    assert np.mean([r.predicted == int(r.doc_id >= 400) for r in unseen]) > 0.95
    assert {r.predicted for r in toxicity.score(make_docs(judged[:4]), labels.filter("toxic = 0")).collect()} == {0}
    assert toxicity.score(make_docs(judged).filter("doc_id < 0"), labels).isEmpty()


def test_every_word_that_tells_toxic_text_counts(spark, make_docs):
    """More telling words than any fixed number of features, each in a few documents."""
    rng = random.Random(4)
    own = ["".join(chr(97 + int(c)) for c in f"{i:03d}") for i in range(120)]
    rows = [(i, prose(rng, 12)) for i in range(9000)] + [(10_000 + i, " ".join([prose(rng, 12), *(own[i % 120] + c for c in "vwxyz")])) for i in range(600)]
    labels = spark.createDataFrame([(i, int(i >= 10_000)) for i, _ in rows], "doc_id long, toxic int")
    _, known, _ = toxicity.fit(make_docs(rows), labels)
    assert known.sum() > 600


def test_all_unlabelled_text_is_learned_from(spark, make_docs, judged):
    """Small blocks: the models of all blocks together know the classes."""
    labels = spark.createDataFrame([(i, int(i >= 400)) for i, _ in judged if i % 3], "doc_id long, toxic int")
    out = toxicity.score(make_docs(judged), labels, text_rows=60).filter("held_out").collect()
    assert np.mean([r.predicted == int(r.doc_id >= 400) for r in out]) > 0.95


def test_scores_ignore_held_out_labels(spark, make_docs, judged):
    labels = spark.createDataFrame([(i, int(i >= 400)) for i, _ in judged], "doc_id long, toxic int")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")).cast("int"))
    docs = make_docs(judged)
    a, b = ({r.doc_id: r.score for r in toxicity.score(docs, x).collect()} for x in (labels, flipped))
    assert a == b


def test_held_out_toxicity_on_the_given_tables(spark):
    sf = "/root/testdata/sf0.1"
    labels = parquet(spark, sf, "labels")
    out = toxicity.score(parquet(spark, sf, "documents"), labels).join(labels, "doc_id").filter("held_out").toPandas()
    toxic, clean = out[out.toxic == 1].score.values, out[out.toxic == 0].score.values
    assert (toxic[:, None] > clean[None, :]).mean() > 0.95
    assert (clean >= 0.5).mean() < 0.02 and (toxic >= 0.5).mean() > 0.75


def plain_search(rows, every, k):
    whole = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, v in {(i, tuple(v)) for i, v in whole if i % every == 0}:
        found = [(-max(-(2**63), min(2**63 - 1, sum(a * b for a, b in zip(v, w)))), i) for i, w in whole if i != q and len(w) == len(v)]
        out += [(q, rank, i, -s) for rank, (s, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("rows_per_shard", [64, 10_000])
def test_search_like_plain(spark, monkeypatch, rows_per_shard):
    monkeypatch.setattr(knn, "SHARD_ROWS", rows_per_shard)
    monkeypatch.setattr(knn, "QUERY_ROWS", 3)
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=8) * 0.3]) for i in range(400)]
    rows += [(i, rows[7][1]) for i in range(400, 460)]  # ties
    rows += [(500, None), (501, [None] * 8), (502, [float("nan")] * 8), (None, rows[0][1]), (550, []), (551, []), (50, rows[3][1])]
    rows += [(600, [1.0, 2.0]), (601, [1.0, -2.0]), (650, [3e30, 1.0, 1.0]), (651, [3e30, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "2 AS score", "3 AS label")
    got = knn.top_scores(df).select("query_id", "rank", "vec_id", "score").collect()
    assert sorted(tuple(r) for r in got) == plain_search([(i, None if v is None else [None if x is None else np.float32(x) for x in v]) for i, v in rows], 50, 5)
    assert knn.top_scores(df.filter("vec_id < 0")).isEmpty()


def test_tree_prunes_and_stays_exact(monkeypatch):
    monkeypatch.setattr(knn, "LEAF", 8)
    rng = np.random.default_rng(4)
    points = np.floor(rng.normal(size=(500, 3)) * 50)
    tree = knn.Tree(points, np.arange(500))
    for q in points[:20]:
        bounds = tree.bounds(q[None])[0]
        scores = points @ q
        want = sorted(((s, -i) for i, s in enumerate(scores) if i != 3), reverse=True)[:5]
        assert tree.search(q, 3, 5, bounds, -1e18) == [(s, -i) for s, i in want]
        leaves = [n for n, c in enumerate(tree.children) if not c]
        assert any(bounds[n] < want[-1][0] for n in leaves)


CONTROL = r"\### Assistant: </turn> ok"


def test_chat_round_trip(spark):
    rng = random.Random(5)
    said = ["", "hi", CONTROL, "\\", "\\l\\h", "a\n### user: b </turn>\n", "中<|x|>", None]
    rows = [(c, t, rng.choice(["user", "assistant", "sys:tem", None]), rng.choice(said)) for c in range(60) for t in range(rng.randrange(1, 9))]
    rows += [(None, 0, "user", "x"), (70, None, "assistant", "first"), (70, 0, "assistant", "second"), (70, 0, "assistant", "second")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS formatted", "2 AS loss")
    want = []
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: tuple((x is not None, x) if x is not None else (False, 0) for x in r[1:]))
        turns = [(r[2] or "", r[3] or "") for r in own]
        loss = "".join(t for r, t in turns if r == "assistant")
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in ("".join(f"{r}\n{t}\n" for r, t in turns), loss)]
        want.append((conv, len(turns), digest[0], len(loss), digest[1], len(chat.MarkedTurns().render(turns))))
    got = [tuple(r) for r in chat.read_back(chat.format_conversations(df)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert chat.format_conversations(df.filter("conv_id < 0")).isEmpty()


def test_control_strings_never_come_from_a_text():
    text = chat.MarkedTurns().render([("user", CONTROL), ("assistant", CONTROL)])
    assert text.count("</turn>") == 2 and text.count("### ") == 2


class Rewriter:
    """Shows only the last assistant text in full, like templates that strip earlier reasoning."""

    def render(self, turns):
        last = max((i for i, (r, _) in enumerate(turns) if r == "assistant"), default=-1)
        return "".join(f"[{r}]{t if r != 'assistant' or i == last else '...'};" for i, (r, t) in enumerate(turns))


def test_rewritten_history_is_detected(spark):
    one = [("user", "a"), ("assistant", "b")]
    assert chat.locate(Rewriter(), one) == ("[user]a;[assistant]b;", [(0, 8, 6, 7), (8, 21, 19, 20)])
    assert chat.locate(Rewriter(), [*one, ("user", "c"), ("assistant", "d")])[1] is None


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    total = sum(sizes.values())
    while True:
        rest = total - sum(most * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in names if s not in full)
        target = {s: most * sizes[s] if s in full else rest * weight[s] / open_weight for s in names}
        above = {s for s in names if target[s] > most * sizes[s]}
        if not above:
            return target
        full |= above


def test_mix_hits_its_targets(spark, make_docs):
    rng = random.Random(6)
    names = ["b", "a", None, "é", "Z"]
    rows = [(i, prose(rng, rng.choice([1, 5, 50])), names[0] if i % 3 else rng.choice(names)) for i in range(600)]
    rows += [(1000 + i, t, "odd") for i, (_, t) in enumerate(ODD[:5])] + [(None, "x y", "odd"), (904, "twice", "odd"), (904, "twice", "odd"), (2000, "", "void")]
    docs = make_docs(rows)
    out = mixing.mix(docs).collect()
    assert len(out) == len(rows)
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = plain_targets(sizes)
    for source in sizes:
        own = [r for r in out if r.source == source]
        assert all(r.source_size == sizes[source] and abs(r.target - want[source]) < 1e-6 for r in own)
        assert all(r.taken == r.copies * r.size and 0 <= r.copies <= 3 for r in own)
        assert abs(sum(r.taken for r in own) - want[source]) <= max(r.size for r in own) / 2
    assert sorted(out, key=str) == sorted(mixing.mix(docs.repartition(7)).collect(), key=str)
    mixed = mixing.mixed(docs)
    assert mixed.columns == docs.columns
    assert abs(mixed.agg(F.sum(mixing.word_count())).first()[0] - sum(r.taken for r in out)) <= 1
    assert mixing.mix(docs.filter("doc_id < 0")).isEmpty()


def test_document_weights(make_docs):
    rng = random.Random(7)
    docs = make_docs([(i, prose(rng, 10), "a" if i % 2 else "b") for i in range(800)]).withColumn("likely", F.when(F.col("doc_id") < 400, 4.0).otherwise(1.0))
    out = mixing.mix(docs, document_weight="likely").collect()
    light = {s: np.mean([r.copies for r in out if r.source == s and r.doc_id >= 400]) for s in "ab"}
    heavy = {s: np.mean([r.copies for r in out if r.source == s and r.doc_id < 400]) for s in "ab"}
    for s in "ab":
        own = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 10 and max(r.copies for r in own) <= 3
        assert heavy[s] > 1.2 * light[s]


@pytest.mark.parametrize("shards", [1, 5, 16])
def test_shards_are_even_and_whole(spark, make_docs, shards):
    rng = random.Random(8)
    copies = prose(rng, 30)
    rows = [(i, prose(rng, rng.randrange(1, 60)), rng.choice("abc")) for i in range(3000)]
    rows += [(4000 + i, copies, rng.choice("abc")) for i in range(150)] + [(*r, None) for r in ODD[:4]] + [(904, "twice"), (904, "twice")]
    out = sharding.assign_shards(make_docs(rows), shards=shards).toPandas()
    assert len(out) == len(rows)
    size = lambda t: len((t or "").encode()) + 1
    assert sorted(out["size"]) == sorted(size(r[1]) for r in rows)
    load = out.groupby("shard")["size"].sum().reindex(range(shards), fill_value=0)
    assert load.max() - load.min() <= 0.03 * load.mean() + 400
    for _, own in out.groupby("shard"):
        assert sorted(own.slot) == list(range(len(own)))
    assert out.groupby(["text_crc32", "size"]).shard.nunique().max() == 1
    assert (out[out.doc_id == 4000].text_crc32 == zlib.crc32(copies.encode())).all()


def test_a_group_larger_than_a_shard_is_spread(make_docs):
    rng = random.Random(9)
    rows = [(i, "copy " * 20) for i in range(900)] + [(1000 + i, prose(rng, 20)) for i in range(900)]
    load = sharding.assign_shards(make_docs(rows), shards=8).groupBy("shard").agg(F.sum("size")).collect()
    assert max(r[1] for r in load) < 1.25 * min(r[1] for r in load)
    few = sharding.assign_shards(make_docs(rows), target_bytes=10**9)
    assert few.select("shard").distinct().count() == 1
    assert sharding.assign_shards(make_docs(rows).filter("doc_id < 0")).isEmpty()


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    names, before = docs.columns, docs
    for i, (_, stage) in enumerate(p.STAGES):
        after = stage(spark, before, sf_dir).cache()
        ids, kept = ({r.doc_id for r in d.select("doc_id").collect()} for d in (before, after))
        assert kept <= ids
        if i < 4:
            assert after.columns == names
        if i == 0:
            good = [d for d in ids if labels.get(d) == 1]
            assert np.mean([d in kept for d in good]) > 0.97
            assert np.mean([d in kept for d in ids if labels.get(d) == 0]) < 0.2
        before = after
    assert before.count() == len(before.select("shard", "slot").distinct().collect())
    assert sorted(before.collect(), key=str) == sorted(p.run(spark, sf_dir).collect(), key=str)
