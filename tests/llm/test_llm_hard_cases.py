"""Texts built to fool hashes, shared row keys, runs of one document, clashing names."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_text import plain_groups, plain_lines, plain_repeats, prose, shingles

from veilgauge.llm import decontaminate, line_dedup, minhash_dedup, mixing, substring_dedup, textscan


def thue_morse(n, a="a", b="b"):
    return "".join(b if bin(i).count("1") % 2 else a for i in range(n))


TWIN, OTHER = thue_morse(1024), thue_morse(1024, "b", "a")


def test_regular_words_have_hashes_of_their_own():
    for n in (16, 64, 1024, 4096):
        words = textscan.words_of(pa.array([f"{thue_morse(n)} {thue_morse(n, 'b', 'a')}"]))
        x, y = words.hashes().tolist()
        assert x != y
    shifted = textscan.words_of(pa.array([f"{'a' * i} " for i in range(1, 40)])).hashes()
    assert len(set(shifted.tolist())) == 39


def test_hashes_spread_evenly():
    words = textscan.words_of(pa.array([" ".join(f"{i:x}" for i in range(60_000))]))
    hashes = words.hashes()
    assert len(np.unique(hashes)) == 60_000
    for shift in (0, 24, 56):
        counts = np.bincount(((hashes >> np.uint64(shift)) & np.uint64(255)).astype(int), minlength=256)
        assert ((counts - 60_000 / 256) ** 2).sum() / (60_000 / 256) < 400


def test_lines_of_regular_texts(make_docs):
    rows = [(1, TWIN), (2, TWIN), (3, OTHER), (4, OTHER), (5, "x")]
    docs = make_docs(rows)
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, min_docs=3)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows, 40, 3)
    assert all(r.n_dropped == 0 for r in got)


def test_near_duplicates_of_regular_texts(make_docs):
    rows = [(1, f"{TWIN} one two three"), (2, f"{OTHER} one two three"), (3, f"{TWIN} one two three")]
    got = minhash_dedup.near_duplicates(make_docs(rows), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows, 4, 80)


def test_contained_items_of_regular_texts(spark, make_docs):
    bench = spark.createDataFrame([(1, f"{TWIN} b c d e")], "item_id long, text string")
    docs = make_docs([(1, f"x {OTHER} b c d e y"), (2, f"x {TWIN} B c d e y")])
    assert [r.doc_id for r in decontaminate.contained_items(docs, bench).collect()] == [2]


def test_repeats_where_short_keys_collide(spark, make_docs):
    """Rows of null ids whose texts agree in a 32-bit hash stay rows of their own."""
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: F.concat(F.lit("w"), F.col("id").cast("string"), F.lit("-"), i.cast("string"))))
    some = spark.range(300_000).select(words.alias("text"))
    alike = some.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter("size(t) > 1").limit(5).collect()
    assert alike
    rows = [(None, t) for r in alike for t in r.t] + [(4, r.t[0]) for r in alike]
    got = substring_dedup.remove_repeats(make_docs(rows)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 20)


def test_settled_lists_of_null_ids_are_spread():
    rng = random.Random(31)
    passage = prose(rng, 30)
    texts = [f"{prose(rng, i % 50)} {passage} {prose(rng, 3)}" for i in range(400)]
    batch = pa.record_batch([pa.array([substring_dedup.NO_ID] * 400), pa.array(np.arange(400) * 977), pa.array(texts)], names=["doc", "key", "text"])
    settled = [b for out in substring_dedup._cells(20, 6)(iter([batch])) for b, d in zip(out.column("bucket").to_pylist(), out.column("doc").to_pylist()) if d is not None]
    assert len(settled) > 200 and len(set(settled)) > 32


@pytest.mark.parametrize("pending", [3, 50, 10**6])
def test_long_runs_of_few_documents_stay_bounded(monkeypatch, pending):
    monkeypatch.setattr(line_dedup, "PENDING", pending)
    rng = random.Random(32)
    rows = [(h, doc, rng.randrange(100), pos) for h, docs in ((1, 2), (2, 3), (3, 7), (4, 1), (5, 9)) for doc in range(docs) for pos in range(rng.choice([1, 40]))]
    rows.sort(key=lambda r: (r[0], -r[1], r[3], r[2]))
    cuts = [0, *sorted(rng.sample(range(1, len(rows)), 12)), len(rows)]
    parts = [rows[a:b] for a, b in zip(cuts, cuts[1:])]
    batches = [pa.record_batch([pa.array([r[i] for r in p], pa.int32() if i == 3 else pa.int64()) for i in range(4)], names=["h", "doc", "key", "pos"]) for p in parts]
    out = [tuple(r.values()) for b in line_dedup._stream(5)(iter(batches)) for r in b.to_pylist()]
    dropped = {r[:4] for r in out if r[4] == line_dedup.DROP}
    undecided = [r for r in out if r[4] != line_dedup.DROP]
    docs = {h: {r[1] for r in undecided if r[0] == h} for h in {r[0] for r in undecided}}
    dropped |= {r[:4] for r in undecided if r[4] == line_dedup.OPEN and len(docs[r[0]]) >= 5 and r[1] != max(docs[r[0]])}
    assert dropped == {r for r in rows if (r[0] == 3 and r[1] != 6) or (r[0] == 5 and r[1] != 8)}


def test_items_under_five_words(spark, make_docs):
    rng = random.Random(33)
    items = [(1, "Solo"), (2, "two words"), (3, "three short words"), (4, "now four short words"), (5, "now five short words here"), (6, "")]
    rows = [(i, " ".join(rng.choice(["solo", "two", "words", "three", "short", "now", "four", "five", "here"]) for _ in range(rng.randrange(0, 30)))) for i in range(200)]
    want = []
    for doc, text in rows:
        for item, said in items:
            k = min(len(said.split()), 5)
            theirs = shingles(said, k, False) if k else set()
            if theirs and theirs <= shingles(text, k, False):
                want.append((doc, item, 1, 1))
    got = decontaminate.contained_items(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert {r[1] for r in want} >= {1, 2, 3} and sorted(tuple(r) for r in got) == sorted(want)


def test_sketches_find_most_pairs_by_themselves(spark, make_docs):
    """The sketches' own recall, by the size of the items; the union with the rarest shingles is lossless elsewhere."""
    rng = random.Random(34)
    items = [(i, prose(rng, n, 50_000)) for i, n in enumerate([5] * 60 + [8] * 60 + [30] * 60)]
    rows = [(i, " ".join([prose(rng, rng.choice([10, 500, 4000]), 50_000), *(t for _, t in rng.sample(items, 20)), prose(rng, 50, 50_000)])) for i in range(60)]
    found = decontaminate.contained_items(make_docs(rows), spark.createDataFrame(items, "item_id long, text string")).select("n_item", "sketched").collect()
    assert len(found) >= 60 * 20
    for size, least in ((1, 0.95), (4, 0.999), (26, 1.0)):
        of = [r.sketched for r in found if r.n_item == size]
        assert len(of) > 300 and sum(of) >= least * len(of)


def test_mix_with_clashing_names(spark):
    rows = [(i, "word " * (i + 1), f"s{i % 3}") for i in range(60)] + [(None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    for name in ("__n", "__sum", "__copy", "copy", "_copy", "__rows", "__copies", "__id", "__key"):
        docs = docs.selectExpr("*", f"7 AS `{name}`")
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    taken = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    copies = {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert taken == copies


def test_mix_without_clashes_leaves_sources_in_place(spark):
    docs = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(20)], "doc_id long, text string, source string")
    assert not re.search(r"hashpartitioning\(coalesce\(source", mixing.mix(docs)._jdf.queryExecution().toString())
