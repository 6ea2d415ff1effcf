"""Quality rules, filter audit and the trie of conversations against plain Python."""

import hashlib
import random
import re
import zlib
from fractions import Fraction
from itertools import combinations, permutations

import pytest
from pyspark.sql import functions as F

from veilgauge.llm import filter_audit, prefix_trie, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alone"), (None, None), (None, "alone"), (5, "word " * 30_000), (6, "x"), (6, "x"), (6, "other text")]


def junk(rng):
    lines = []
    for _ in range(rng.randrange(1, 8)):
        kind = rng.random()
        words = [f"{rng.choice(['wö', 'Ab', 'long', 'x'])}{rng.randrange(30)}" for _ in range(rng.randrange(0, 12))]
        line = " ".join(words).upper() if kind < 0.2 else " ".join(w + "###" for w in words) if kind < 0.3 else " ".join(words)
        lines += [line] * rng.choice([1, 1, 1, 2, 3]) + ["  "] * (kind > 0.9)
    return "\n".join(lines)


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, r in enumerate(runs) if runs.count(r) > 1 for j in range(i, i + 5)} if len(runs) < 1000 else set(range(len(words)))
    return {
        "n_words": len(words), "word_chars": sum(map(len, words)), "n_upper": len(re.findall("[A-Z]", text)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
        "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(inside),
    }


def plain_failures(m):
    return sum(1 << i for i, rule in enumerate(quality_rules.RULES.values()) if eval(rule, {}, m))


def some_texts(n=150):
    rng = random.Random(21)
    return [(i, junk(rng)) for i in range(100, 100 + n)] + ODD


def test_ledger_like_plain(make_docs):
    rows = some_texts()
    got = quality_rules.verdicts(make_docs(rows, 4)).collect()
    want = []
    for doc, text in rows:
        m = plain_measures(text)
        bits = plain_failures(m)
        want.append((doc, *m.values(), bits, bool(bits & 3), not bits & quality_rules.bits(quality_rules.POLICIES["v2"])))
    seen = [(r.doc_id, *(r[m] for m in quality_rules.MEASURES), r.failures, r.base_failed, r.kept) for r in got]
    assert sorted(seen, key=str) == sorted(want, key=str)
    assert len({r[-3] for r in want}) > 5


def test_ablations_like_plain(make_docs):
    rows = some_texts()
    ledger = quality_rules.ledger(make_docs(rows))
    bits = [plain_failures(plain_measures(t)) for _, t in rows]
    for r in quality_rules.ablations(ledger).collect():
        mask, bit = quality_rules.bits(quality_rules.POLICIES[r.policy]), quality_rules.bits([r.rule])
        hit = [b & mask & ~bit for b in bits if b & bit]
        common = 2**63 - 1 if hit else 0
        for b in hit:
            common &= b
        kept = sum(not b & mask for b in bits)
        assert (r.n_docs, r.n_kept, r.n_fails, r.n_kept_without, r.implies) == (len(bits), kept, len(hit), sum(not b & mask & ~bit for b in bits), common)
        assert r.n_only == r.n_kept_without - kept


def test_rules_keep_clean_text_and_columns(make_docs):
    rng = random.Random(22)
    clean = [(i, ". ".join(" ".join(f"word{rng.randrange(3000)}" for _ in range(9)) for _ in range(20))) for i in range(20)]
    docs = make_docs([*clean, (50, "BUY!! NOW!! " * 30), (51, "a | b | c | d " * 20), *ODD])
    out = quality_rules.keep(docs)
    assert out.columns == docs.columns and sorted(r.doc_id for r in out.collect()) == list(range(20))
    none = docs.filter("doc_id = -1")
    assert quality_rules.verdicts(none).isEmpty()
    assert {r.n_docs for r in quality_rules.ablations(quality_rules.ledger(none)).collect()} == {0}


def plain_audit(rows, labels):
    """Every order replayed on the documents."""
    failed = []
    for doc, text, lang in rows:
        t = text or ""
        w = WORD.findall(t)
        copies = [d for d, x, _ in rows if (x or "") == t]
        smaller = any((c is None and doc is not None) or (c is not None and doc is not None and c < doc) for c in copies)
        conditions = (len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * len(re.findall("[A-Z]", t)) > 3 * len(t), bool(re.search(r"[#$%&*|]", t)), smaller)
        failed.append((lang or "", {x for x, c in zip("ABCDE", conditions) if c}, doc))
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, x in labels if x == 1}
    out = {}
    for part in {p for p, _, _ in failed}:
        mine = [(f, d) for p, f, d in failed if p == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            for k, x in enumerate(order):
                left = [(f, d) for f, d in mine if not f & set(order[:k])]
                here = [d for f, d in left if x in f]
                total[x] += len(here)
                out[part, "".join(order), k + 1] = [
                    len(left) - len(here), len(here), sum(x in f for f, _ in mine) - len(here), sum(f == {x} for f, _ in mine),
                    sum(d is not None and d in good for d in here), sum(d is not None and d in toxic for d in here), x,
                ]
        for (p, _, _), v in out.items():
            if p == part:
                v[-1] = total[v[-1]]
    return out


def test_audit_like_replayed_orders(spark):
    rng = random.Random(23)
    long = [" ".join(f"w{rng.randrange(900)}" for _ in range(n)) for n in (199, 200, 400)]
    texts = [*long, long[2] + " #", long[1].upper(), "same " * 300, "", None, "short one", long[0] + " A"]
    rows = [(rng.choice([None, *range(40)]), rng.choice(texts), rng.choice([None, "", "en", "de"])) for _ in range(120)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1])) for i in range(30)] + [(3, 1, 0), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3).selectExpr("*", "1 AS part", "2 AS n", "3 AS h", "4 AS good", "5 AS quality")
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").selectExpr("*", "'x' AS text")
    got = {(r.part, r.filter_order, r.step): list(r)[3:] for r in filter_audit.audit(docs, marks).collect()}
    assert got == plain_audit(rows, labels)
    assert filter_audit.audit(docs.filter("doc_id = -1"), marks).isEmpty()


def test_potential_gives_shapley_values(spark):
    rng = random.Random(24)
    worth = [0] + [rng.randrange(1000) for _ in range(31)]
    row = spark.createDataFrame([(worth,)], "w array<long>").select(filter_audit.potential(F.col("w")).alias("p")).first()
    for i in range(5):
        others = [j for j in range(5) if j != i]
        value = Fraction(0)
        for size in range(5):
            for s in combinations(others, size):
                mask = sum(1 << j for j in s)
                value += Fraction(1, 5 * len(list(combinations(others, size)))) * (worth[mask | 1 << i] - worth[mask])
        assert Fraction(row.p[31] - row.p[31 - (1 << i)], 120) == value


def plain_trie(convs):
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    leaves, saved = {}, {}
    for p in sorted(members, key=len, reverse=True):
        below = kids.get(p, [])
        leaves[p] = sum(leaves[k] for k in below) or 1
        saved[p] = sum(saved[k] for k in below) + ((len(members[p]) - 1) * len(p[-1][1]) if p else 0)
    out = []
    for p, cs in members.items():
        ends = ",".join(map(str, sorted(c for c in cs if len(convs[c]) == len(p))))
        above = min(members[p[:-1]]) if p else None
        out.append((min(cs), len(p), above, len(cs), len(kids.get(p, [])), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def as_turns(spark, convs, parts=3):
    rows = [(c, i, r, t) for c, turns in convs.items() for i, (r, t) in enumerate(turns)]
    listed = prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(parts))
    empty = [(c,) for c, turns in convs.items() if not turns]
    if empty:
        none = spark.createDataFrame(empty, "conv_id long").withColumn("turns", F.array().cast(f"array<{prefix_trie.TURN}>"))
        listed = listed.unionByName(none)
    return listed


def some_conversations():
    rng = random.Random(25)
    pool = [("user", f"t{i}é" * rng.randrange(1, 4)) for i in range(4)]
    convs = {c: [rng.choice(pool) for _ in range(rng.choice([0, 1, 2, 3, 5, 9]))] for c in range(-60, 240)}
    spine = [("assistant", f"s{i}") for i in range(70)]
    convs |= {1000 + i: spine[:i] for i in range(0, 70, 3)}  # each one the beginning of the next
    convs |= {2000 + i: spine[:i] + [("user", f"off{i}")] * 3 for i in range(0, 70, 5)}
    convs |= {3000 + i: spine for i in range(40)}
    return convs


def test_trie_like_plain(spark):
    convs = some_conversations()
    got = prefix_trie.nodes(prefix_trie.build(as_turns(spark, convs)))
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == plain_trie(convs)


def test_fat_search_finds_the_deepest_common_prefix(spark):
    convs = some_conversations()
    half = {c: t for c, t in convs.items() if c % 2}
    trie = prefix_trie.build(as_turns(spark, half))
    nodes = prefix_trie.compacted(trie.segments, trie.ended)
    asked = prefix_trie.sequences(as_turns(spark, convs)).select("seg", "len", "h")
    got = {r.seg: (r.at, r.place) for r in prefix_trie.locate(nodes, asked, 8).select("seg", "at", F.element_at(F.concat(F.array(F.struct(F.lit(0).cast("long").alias("seg"), F.lit(0).alias("depth"))), "path"), -1)["depth"].alias("place")).collect()}
    known = {tuple(t[:d]) for t in half.values() for d in range(len(t) + 1)}
    for seg, (at, place) in got.items():
        want = max(d for d in range(len(convs[seg]) + 1) if tuple(convs[seg][:d]) in known)
        assert (at, place) == (want, want)


def test_handles_are_two_fattest(spark):
    pairs = [(a, b) for a in range(0, 40) for b in range(a + 1, 41)] + [(6, 8), (0, 1), (1023, 1025)]
    got = spark.createDataFrame(pairs, "a int, b int").select("a", "b", prefix_trie.two_fattest(F.col("a"), F.col("b")).alias("f")).collect()
    for a, b, f in got:
        assert f == max(range(a + 1, b + 1), key=lambda x: x & -x)


def test_rebuilt_conversations(spark):
    rng = random.Random(26)
    own = {c: [(rng.choice(["user", "assistant"]), f"{c}-{i}") for i in range(rng.randrange(1, 8))] for c in [*range(100, 130), *range(305, 330), -3, 0]}
    rows = [(c, i, r, t) for c, turns in own.items() for i, (r, t) in enumerate(turns)]
    listed = prefix_trie.with_shared_heads(prefix_trie.turn_lists(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        convs[c] = own.get(c - int(c / abs(c) if c else 1) * (abs(c) % 100), [])[:h] + turns[h:]
    got = sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.build(listed)).collect()), key=str)
    assert got == plain_trie(convs)


def test_odd_conversations(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, None, None, "first"), (1, 0, "user", None), (1, 0, "user", None), (None, 0, "user", "nobody"), (2, 5, "", "first"), (3, 0, "user", "x" * 300_000)]
    table = spark.createDataFrame(rows, schema).selectExpr("*", "'clash' AS seg", "1 AS len", "2 AS name", "3 AS t", "4 AS k")
    got = sorted((tuple(r) for r in prefix_trie.nodes(prefix_trie.build(prefix_trie.turn_lists(table))).collect()), key=str)
    convs = {1: [("", "first"), ("user", ""), ("user", "")], 2: [("", "first")], 3: [("user", "x" * 300_000)]}
    assert got == plain_trie(convs)
    assert prefix_trie.nodes(prefix_trie.build(prefix_trie.turn_lists(table.filter("conv_id = 99")))).isEmpty()


def test_conversations_without_turns(spark):
    none = spark.createDataFrame([(7,), (9,)], "conv_id long").withColumn("turns", F.array().cast(f"array<{prefix_trie.TURN}>"))
    got = [tuple(r) for r in prefix_trie.nodes(prefix_trie.build(none)).collect()]
    assert got == plain_trie({7: [], 9: []})


@pytest.mark.parametrize("cuts", [[3], [1, 2, 3, 4, 5], [5, 6]])
def test_digests_of_ids_go_on_over_batches(cuts):
    import pyarrow as pa

    names = [b"a"] * 3 + [b"b"] + [b"c"] * 3
    ids = [1, 2, 30, 4, -5, 6, 7]
    edges = [0, *cuts, 7]
    batches = [pa.record_batch([pa.array(names[a:b], pa.binary()), pa.array(ids[a:b])], names=["name", "conv_id"]) for a, b in zip(edges, edges[1:])]
    got = {r["name"]: r["ends"] for out in prefix_trie._digest_ids(iter(batches)) for r in out.to_pylist()}
    assert got == {n: hashlib.sha256(s).hexdigest() for n, s in ((b"a", b"1,2,30"), (b"b", b"4"), (b"c", b"-5,6,7"))}
