"""Scanning, line dedup, substring dedup, near-dedup and decontamination against plain Python."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from veilgauge.llm import decontaminate, line_dedup, minhash_dedup, substring_dedup, textscan

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LONG = "word " * 40_000


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def shingles(text, k, whole):
    words = WORD.findall(low(text))
    if whole and 0 < len(words) < k:
        return {tuple(words)}
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)}


def test_words_are_those_of_the_pattern():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abé中 \t\n\x0b\x1c .A") for _ in range(rng.randrange(60))) for _ in range(300)]
    texts += [None, "", " ", "a", "\na\n"]
    words = textscan.words_of(pa.array(texts, pa.string()))
    got = [bytes(words.data[a:b]).decode() for a, b in zip(words.start, words.end)]
    assert got == [w for t in texts for w in WORD.findall(t or "")]
    assert words.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]


def test_hashes_depend_on_the_words_only(monkeypatch):
    texts = pa.array(["Xyz abc xyz", "abc", "xyz Xyz"])
    words = textscan.words_of(texts)
    plain, lower = words.hashes(), words.hashes(lower=True)
    assert plain[0] != plain[2] and lower[0] == lower[2] == plain[2] and plain[1] == plain[3]
    monkeypatch.setattr(textscan, "BLOCK", 4)
    assert (textscan.words_of(texts).hashes() == plain).all()


def test_shingles_have_the_right_count():
    rng = random.Random(2)
    texts = [prose(rng, rng.randrange(0, 40), 5) for _ in range(200)] + [None, "", "one", "One two THREE"]
    for whole in (True, False):
        _, _, first = textscan.shingle_sets(pa.array(texts, pa.string()), 4, whole)
        assert np.diff(first).tolist() == [len(shingles(t, 4, whole)) for t in texts]


def test_pieces_are_whole_rows(monkeypatch):
    monkeypatch.setattr(textscan, "PIECE_BYTES", 10)
    batch = pa.record_batch([pa.array(["aaaa", "bbbb", None, "c" * 50, "d"])], names=["text"])
    assert [p.column("text").to_pylist() for p in textscan.pieces(batch)] == [["aaaa", "bbbb", None], ["c" * 50], ["d"]]


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alone"), (None, None), (5, LONG), (5, LONG), (6, "x"), (6, "x"), (6, "other text")]


def plain_lines(rows, min_chars, min_docs):
    key = lambda line: low(re.sub(r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "", line))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(-(2**63) if doc is None else doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        own = -(2**63) if doc is None else doc
        gone = [len(key(x)) >= min_chars and len(holders[key(x)]) >= min_docs and max(holders[key(x)]) != own for x in lines]
        out.append((doc, len(lines), sum(gone), "\n".join(x for x, g in zip(lines, gone) if not g)))
    return sorted(out, key=str)


def test_lines_like_plain(make_docs):
    rng = random.Random(3)
    pool = [prose(rng, 12) for _ in range(12)]
    rows = [(i, "\n".join(rng.choice([pool[0], rng.choice(pool).upper() + " ", "short", prose(rng, 12)]) for _ in range(rng.randrange(1, 9)))) for i in range(300)]
    rows += ODD + [(i, pool[0]) for i in range(400, 420)]
    docs = make_docs(rows, 7)
    got = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs)).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_lines(rows, 40, 5)


def test_line_bitmap_round_trip(make_docs):
    rows = [(i, "a\n" + "common line that is longer than forty characters\nb") for i in range(6)]
    maps = line_dedup.keep_bitmaps(make_docs(rows)).collect()
    kept = {r.doc_id: line_dedup.unpack(r.keep, r.n_lines).tolist() for r in maps}
    assert kept == {i: [True, i == 5, True] for i in range(6)}


def plain_repeats(rows, width):
    ident = lambda d: -(2**63) if d is None else d
    first = {}
    for doc, text in rows:
        words = WORD.findall(text or "")
        for i in range(len(words) - width + 1):
            at = (ident(doc), i)
            seq = tuple(words[i : i + width])
            first[seq] = min(first.get(seq, at), at)
    out = []
    for doc, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - width + 1):
            if first[tuple(words[i : i + width])] < (ident(doc), i):
                gone |= set(range(i, i + width))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [50, 2**20])
def test_repeats_like_plain(make_docs, monkeypatch, block):
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", block)  # only the driver's copy: the default also has to hold
    rng = random.Random(4)
    shared = [prose(rng, 30) for _ in range(4)]
    rows = [(i, " ".join([prose(rng, rng.randrange(0, 30)), rng.choice(shared), prose(rng, 5), rng.choice(shared)])) for i in range(120)]
    rows += ODD + [(200 - i, shared[0]) for i in range(20)] + [(300, "same " * 25)]
    got = substring_dedup.remove_repeats(make_docs(rows, 5)).select("doc_id", "n_words", "n_removed", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_repeats(rows, 20)


def test_intervals_are_maximal():
    assert substring_dedup.intervals(np.array([0, 3, 23, 50]), 20) == [(0, 43), (50, 70)]
    assert substring_dedup.intervals(np.array([], dtype=int), 20) == []


def plain_groups(rows, k, percent):
    sets = [shingles(t, k, True) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if common and 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common):
                a, b = group[i], group[j]
                group = [b if g == a else g for g in group]
    least = {}
    for (doc, _), g in zip(rows, group):
        if doc is not None:
            least[g] = min(least.get(g, doc), doc)
    return sorted(((d, len(s), least.get(g), d == least.get(g)) for (d, _), s, g in zip(rows, sets, group)), key=str)


def edited(rng, text, n):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = f"n{rng.randrange(10**6)}"
    return " ".join(words)


def test_near_duplicates_like_plain(make_docs):
    rng = random.Random(5)
    rows = []
    for g in range(12):
        base = prose(rng, 120, 5000)
        rows += [(rng.randrange(10**6), edited(rng, base, rng.randrange(0, 9))) for _ in range(10)]
    rows += ODD + [(7, "one two"), (8, "ONE two"), (9, "one")]
    got = minhash_dedup.near_duplicates(make_docs(rows), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows, 4, 80)


def test_bands_of_single_nodes_are_not_sorted(spark, make_docs, monkeypatch):
    plans, plain = [], minhash_dedup.staged

    def record(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df)

    monkeypatch.setattr(minhash_dedup, "staged", record)
    rng = random.Random(9)
    rows = [(i, prose(rng, 40, 5000)) for i in range(600)]
    rows += [(1000, rows[0][1] + " more"), (1001, rows[1][1])]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "20000")  # below the size of 600 nodes with 32 bands
    try:
        got = minhash_dedup.near_duplicates(make_docs(rows), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows, 4, 80)
    bucketed = [p for p in plans if "explode(bands" in p and "Join" in p]
    assert len(bucketed) == 1 and "BroadcastHashJoin" in bucketed[0] and "SortMergeJoin" not in bucketed[0]


def test_memory_of_a_batch_of_sketches():
    rng = random.Random(10)
    texts = [prose(rng, 300, 5000) for _ in range(2000)]
    ids = pa.array(range(len(texts)), pa.int64())
    batch = pa.record_batch([ids, ids, pa.array(texts, pa.string())], names=["doc_id", "key", "text"])
    assert batch.column("text").nbytes > 2**21
    run = minhash_dedup._sketches(4)
    list(run([batch.slice(0, 10)]))
    tracemalloc.start()
    for _ in run([batch]):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 2**20


def test_large_group_around_the_threshold(make_docs, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "BLOCK_NODES", 16)
    rng = random.Random(6)
    base = prose(rng, 100, 5000)
    rows = [(i, edited(rng, base, rng.randrange(0, 14))) for i in range(150)]
    got = minhash_dedup.near_duplicates(make_docs(rows), k=4, percent=80).select("doc_id", "n_shingles", "component_id", "kept").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_groups(rows, 4, 80)


def test_sketch_agreement_estimates_similarity():
    rng = np.random.default_rng(7)
    values = [rng.integers(0, 2**52, n, dtype=np.uint64) for n in (1, 3, 90, 2000)]
    pairs = [np.concatenate([v[: max(1, len(v) * 3 // 4)], rng.integers(0, 2**52, len(v) // 4, dtype=np.uint64)]) for v in values]
    for a, b in zip(values, pairs):
        a, b = np.unique(a), np.unique(b)
        table = minhash_dedup.sketch(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.array([0, len(a), len(a) + len(b)]))
        assert (table != ~np.uint64(0)).all()
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs((table[0] == table[1]).mean() - true) < 0.2
        assert (minhash_dedup.bands(table)[0] == minhash_dedup.bands(table)[1]).any() or true < 0.5


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)]
    got = {r.node: r.comp for r in minhash_dedup.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100 + i: 100 for i in range(30)}


def test_keep_one_keeps_columns(make_docs):
    rng = random.Random(8)
    text = prose(rng, 60)
    docs = make_docs([(3, text), (1, text), (2, prose(rng, 60)), (4, None)])
    out = minhash_dedup.keep_one(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == [1, 2, 4]


def test_contained_items_like_plain(spark, make_docs):
    rng = random.Random(9)
    items = [(i, prose(rng, rng.choice([5, 6, 12, 40]), 5000)) for i in range(30)] + [(30, None), (31, "too short"), (None, prose(rng, 9)), (3, prose(rng, 9))]
    rows = []
    for i in range(120):
        parts = [prose(rng, rng.choice([0, 30, 3000]), 5000)]
        for _ in range(rng.randrange(3)):
            text = rng.choice(items)[1] or ""
            parts.insert(rng.randrange(len(parts) + 1), edited(rng, text.upper(), rng.choice([0, 0, 1, 3])) if text else "")
        rows.append((i, " ".join(parts)))
    rows += ODD
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS doc_id", "2 AS key")
    want = []
    for doc, text in rows:
        for item, said in items:
            k = max(min(len(WORD.findall(said or "")), 5), 1)  # a shorter item is one run of words
            own, theirs = shingles(text, k, False), shingles(said, k, False)
            if theirs and 100 * len(own & theirs) >= 80 * len(theirs):
                want.append((doc, item, len(theirs), len(own & theirs)))
    got = decontaminate.contained_items(make_docs(rows), bench).select("doc_id", "item_id", "n_item", "n_shared").collect()
    assert want and sorted((tuple(r) for r in got), key=str) == sorted(want, key=str)


def test_items_of_one_shingle_are_never_missed(spark, make_docs):
    rng = random.Random(10)
    items = [(i, f"a{i} b{i} c{i} d{i} e{i}") for i in range(400)]
    rows = [(i, " ".join([prose(rng, 40 + i), *(t for _, t in items)])) for i in range(20)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.contained_items(make_docs(rows), bench).select("doc_id", "item_id").collect()
    assert sorted(tuple(r) for r in found) == [(d, i) for d in range(20) for i in range(400)]


def test_empty_tables(spark, make_docs):
    none = make_docs([(1, "x")]).filter("doc_id < 0")
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert line_dedup.apply_bitmaps(none, line_dedup.keep_bitmaps(none)).isEmpty()
    assert substring_dedup.remove_repeats(none).isEmpty()
    assert minhash_dedup.near_duplicates(none).isEmpty()
    assert decontaminate.contained_items(none, bench).isEmpty()
    assert decontaminate.contained_items(make_docs([(1, "x")]), bench.filter("item_id < 0")).isEmpty()
    assert decontaminate.decontaminate(make_docs([(1, "a b c d e f g"), (2, "y")]), bench).count() == 1
