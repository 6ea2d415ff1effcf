"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

**Sketch.** A set of shingles is thrown into 128 bins, in rounds. In round *i* < 128 each element falls into one hashed bin with
the value ``i + hash``; in the later rounds every element goes to bin *i* - 128. Each bin keeps its smallest value and the rounds end
when all bins are filled, after one or two for sets of some hundred elements. Two sketches agree in a coordinate with
the probability of the sets' Jaccard similarity, and the number of agreements is concentrated like that of independent samples.

**Bands.** 32 bands of 4 coordinates: a pair of similarity 0.8 shares none with a chance of ``(1 - 0.8**4)**32`` = 5e-8.

**Links.** Equal sets become one node first, so a group of copies costs one row. Only the classes of linked nodes are asked for, so
the pairs of a bucket are never listed: each bucket names a pivot, its other members are compared with the pivot on their full sets, and linked nodes
are joined into components. A bucket whose members all belong to one component is done. The others go on without their pivot, whose
pairs are all settled. What is left after ``ROUNDS`` rounds are large groups around the threshold. Buckets with common members are joined into clusters, a cluster is cut
into blocks of some hundred nodes, and a task compares two blocks by one matrix product over the shingles they share; it emits no pairs, only links that
join components. Blocks inside one component are not compared. So no link is lost and no bucket is capped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import discard, staged, text_key
from veilgauge.llm.textscan import mix, pieces, seeds, shingle_sets

BINS, BAND_SIZE = 128, 4
ROUNDS = 2
BLOCK_NODES = 256
SKETCH_BYTES = 2**20  # text sketched at once; a worker's memory goes with it
COLUMNS = 4096
U = np.uint64
_ROUND_SEEDS = seeds(BINS, 11)
_BAND_SEEDS = seeds(BINS, 12)
_LAST = ~U(0)


def sketch(values: np.ndarray, owner: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Fast similarity sketches of several sets (``owner`` ascending, ``first``: first index per set and one past the
    last): one row of ``BINS`` values for each set; an empty set has the largest value everywhere."""
    n_sets = len(first) - 1
    out = np.full(n_sets * BINS, _LAST, dtype=np.uint64)
    active = np.diff(first) > 0
    at, who = np.arange(len(values)), owner
    for i in range(BINS):
        hashed = mix(values[at] ^ _ROUND_SEEDS[i])
        bins = who * BINS + (hashed & U(BINS - 1)).astype(np.int64)
        np.minimum.at(out, bins, (U(i) << U(56)) | (hashed >> U(8)))
        full = (out.reshape(n_sets, BINS) != _LAST).all(axis=1)
        if (active & ~full).sum() < active.sum():
            active &= ~full
            stay = active[who]
            at, who = at[stay], who[stay]
        if not len(at):
            return out.reshape(n_sets, BINS)
    left = np.flatnonzero(active)
    head = np.flatnonzero(np.concatenate([[True], who[1:] != who[:-1]]))
    table = out.reshape(n_sets, BINS)
    for i in range(BINS):
        hashed = mix(values[at] ^ _ROUND_SEEDS[i] ^ U(1)) >> U(8)
        least = np.minimum.reduceat(hashed, head) | (U(BINS + i) << U(56))
        table[left, i] = np.minimum(table[left, i], least)
    return table


def bands(table: np.ndarray) -> np.ndarray:
    """One hash for each band of each sketch; different bands never share one on purpose."""
    parts = table.reshape(len(table), -1, BAND_SIZE)
    out = np.broadcast_to(_BAND_SEEDS[: parts.shape[1]], parts.shape[:2]).copy()
    for j in range(BAND_SIZE):
        out = mix(out + parts[:, :, j])
    return out


def _node(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name for each set, whatever the order of its elements."""
    sums = np.concatenate([[U(0)], np.cumsum(mix(values + U(77)))])
    more = np.concatenate([[U(0)], np.cumsum(mix(values ^ U(0xABCDEF)))])
    size = np.diff(first).astype(np.uint64)
    return mix(mix(sums[first[1:]] - sums[first[:-1]]) + mix((more[first[1:]] - more[first[:-1]]) ^ size))


def _sketches(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch, limit=SKETCH_BYTES):
                values, owner, first = shingle_sets(piece.column("text"), k, True)
                size = np.diff(first)
                empty = size == 0
                banded = bands(sketch(values, owner, first)).view(np.int64)
                offsets = np.arange(len(banded) + 1, dtype=np.int32) * banded.shape[1]
                yield pa.record_batch(
                    [
                        piece.column("doc_id"),
                        piece.column("key"),
                        pa.array(size.astype(np.int64)),
                        pa.array(_node(values, first).view(np.int64), mask=empty),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(banded.ravel())),
                    ],
                    names=["doc_id", "key", "n_shingles", "node", "bands"],
                )

    return run


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for piece in pieces(batch):
            texts = [pack.compress(t or b"") for t in piece.column("text").cast(pa.binary()).to_pylist()]
            rest = [piece.column(c) for c in ("doc_id", "key")]
            yield pa.record_batch([*rest, pa.array(texts, pa.binary())], names=["doc_id", "key", "packed"])


def _verify(k: int, percent: int):
    """Exact similarity of the pairs ``a, b`` with their packed texts; yields the linked ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                a, b = (part.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b"))
                nodes, where = np.unique(np.concatenate([a, b]), return_index=True)
                packed = part.column("text_a").to_pylist() + part.column("text_b").to_pylist()
                texts = pa.record_batch([pa.array([unpack.decompress(packed[i]) for i in where], pa.binary())], names=["text"])
                sets = {}
                at = 0
                for piece in pieces(texts):
                    values, _, first = shingle_sets(piece.column("text"), k, True)
                    for i in range(piece.num_rows):
                        sets[int(nodes[at + i])] = values[first[i] : first[i + 1]]
                    at += piece.num_rows
                linked = np.zeros(len(a), dtype=bool)
                for i, (x, y) in enumerate(zip(a.tolist(), b.tolist())):
                    p, q = sets[x], sets[y]
                    if 100 * min(len(p), len(q)) < percent * max(len(p), len(q)):
                        continue
                    both = np.sort(np.concatenate([p, q]))
                    common = int((both[1:] == both[:-1]).sum())
                    linked[i] = 100 * common >= percent * (len(p) + len(q) - common)
                yield pa.record_batch([pa.array(a[linked]), pa.array(b[linked])], names=["a", "b"])

    return run


def _sets(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles, owner and sizes of packed texts."""
    unpack = zstandard.ZstdDecompressor()
    values, owner, at = [], [], 0
    for piece in pieces(pa.record_batch([pa.array([unpack.decompress(t) for t in texts], pa.binary())], names=["text"])):
        v, o, _ = shingle_sets(piece.column("text"), k, True)
        values.append(v)
        owner.append(o + at)
        at += piece.num_rows
    owner = np.concatenate([np.zeros(0, dtype=np.int64), *owner])
    return np.concatenate([np.zeros(0, dtype=np.uint64), *values]), owner, np.bincount(owner, minlength=len(texts))


def _common(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Sizes of all intersections of ``n`` sets. Only shingles that at least two sets hold can count."""
    known, column, count = np.unique(values, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    column, owner = column[shared], owner[shared]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    out = np.zeros((n, n), dtype=np.float32)
    for lo in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        a, b = np.searchsorted(column, [lo, lo + COLUMNS])
        table = np.zeros((n, COLUMNS), dtype=np.float32)
        table[owner[a:b], column[a:b] - lo] = 1
        out += table @ table.T
    return out.astype(np.int64)


def _compare_blocks(k: int, percent: int):
    """Links between components among the nodes of one or two blocks: as many as it takes to join them."""

    def run(table: pa.Table) -> pa.Table:
        node, comp = table.column("node").to_numpy(), table.column("comp").to_numpy()
        values, owner, size = _sets(table.column("packed").to_pylist(), k)
        common = _common(values, owner, len(node))
        linked = 100 * common >= percent * (size[:, None] + size[None, :] - common)
        _, label = np.unique(comp, return_inverse=True)
        out = []
        while True:
            i, j = np.nonzero(linked & (label[:, None] < label[None, :]))
            if not len(i):
                break
            _, first = np.unique(label[j], return_index=True)  # every component is joined to one below it
            for x, y in zip(i[first], j[first]):
                out.append((int(node[x]), int(node[y])))
            below = {int(label[y]): int(label[x]) for x, y in zip(i[first], j[first])}
            root = np.arange(label.max() + 1)
            for one in sorted(below):
                root[one] = root[below[one]]
            label = root[label]
        a, b = zip(*out) if out else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def components(links: DataFrame) -> DataFrame:
    """``node, comp`` (smallest node reachable) for the nodes of ``links(a, b)``, by alternating large-star and small-star
    steps: each step keeps the components and shortens every path, so that a few steps end in stars."""
    edges = staged(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        new = staged(small.select("e.u", "e.v").filter("u <> v").distinct())
        # Stars: nobody who has a parent is a parent, and nobody has two.
        if new.select("u").intersect(new.select("v")).isEmpty() and new.groupBy("u").count().filter("count > 1").isEmpty():
            root = new.select("v").distinct()
            return new.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(root.select(F.col("v").alias("node"), F.col("v").alias("comp")))
        discard(edges)
        edges = new


def _labelled(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """Rows with a column ``node``, with the component of the node (a node without links is its own)."""
    if comps is None:
        return rows.withColumn("comp", F.col("node"))
    return rows.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))


def near_links(nodes: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame | None:
    """``node, comp`` of all nodes with a link. ``nodes``: node, bands, and doc_id and key of one row that has the set."""
    hits = nodes.select("node", F.explode("bands").alias("band"))
    # Staged first: few of all bands are shared, and a small table spares the join the sort of 32 rows for each node.
    shared = staged(hits.groupBy("band").agg(F.count("*").alias("n")).filter("n > 1").select("band"))
    members = staged(hits.join(shared, "band"))
    wanted = members.select("node").distinct()
    rows = nodes.select("node", "doc_id", "key").join(wanted, "node")
    packed = docs.select("doc_id", text_key().alias("key"), "text").mapInArrow(_squeeze, "doc_id long, key long, packed binary").alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("d.key") == F.col("r.key"))
    texts = staged(packed.join(rows.alias("r"), same).select("node", "packed").dropDuplicates(["node"]))

    def check(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("p", "q").alias("b"), F.greatest("p", "q").alias("a")).distinct()
        one = pairs.join(texts.select(F.col("node").alias("a"), F.col("packed").alias("text_a")), "a")
        two = one.join(texts.select(F.col("node").alias("b"), F.col("packed").alias("text_b")), "b")
        return two.select("a", "b", "text_a", "text_b").mapInArrow(_verify(k, percent), "a long, b long")

    links, comps = None, None
    for turn in range(ROUNDS):
        now = _labelled(members, comps)
        order = F.col("node") if turn == 0 else F.xxhash64("node", F.lit(turn))
        pivots = now.groupBy("band").agg(
            F.min_by(F.struct("node", "comp"), order).alias("first"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
        ).filter("lo <> hi").select("band", F.col("first.node").alias("pivot"), F.col("first.comp").alias("pivot_comp"))
        now = staged(now.join(pivots, "band"))
        members = now.filter("node <> pivot").select("band", "node")
        new = staged(check(now.filter("comp <> pivot_comp").select(F.col("node").alias("p"), F.col("pivot").alias("q"))))
        links = new if links is None else links.unionByName(new)
        comps = components(links)
    last = _between(_labelled(members, comps), texts, k, percent)
    return comps if last is None else components(links.unionByName(last))


def _between(members: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame | None:
    """Links between components of one bucket, for ``band, node, comp``; None if no bucket has several."""
    mixed = members.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.min("node").alias("least")).filter("lo <> hi")
    left = staged(members.join(mixed.select("band", "least"), "band"))
    if left.isEmpty():
        return None
    cluster = components(left.select(F.col("node").alias("a"), F.col("least").alias("b"))).withColumnRenamed("comp", "cluster")
    rows = left.select("node", "comp").distinct().join(cluster, "node")
    # Components of at least a block have blocks of their own (kind: the component), the others share blocks (kind: null).
    large = rows.groupBy("cluster", "comp").agg(F.count("*").alias("n")).filter(F.col("n") >= BLOCK_NODES)
    rows = rows.join(large.select("cluster", "comp", F.col("comp").alias("kind")), ["cluster", "comp"], "left")
    size = rows.groupBy("cluster", F.struct("kind").alias("of")).agg(F.count("*").alias("n"))
    rows = rows.withColumn("of", F.struct("kind")).join(size, ["cluster", "of"])
    block = F.pmod(F.xxhash64("node", F.lit(5)), F.ceil(F.col("n") / BLOCK_NODES))
    rows = staged(rows.select("cluster", "node", "comp", F.struct("kind", block.alias("no")).alias("block")))
    blocks = rows.select("cluster", "block").distinct()
    pairs = blocks.select("cluster", F.col("block").alias("x")).join(blocks.select("cluster", F.col("block").alias("y")), "cluster")
    pairs = staged(pairs.filter((F.col("x") <= F.col("y")) & F.coalesce(F.col("x.kind") != F.col("y.kind"), F.lit(True))))
    one = pairs.withColumn("block", F.col("x"))
    two = pairs.filter(F.col("x") < F.col("y")).withColumn("block", F.col("y"))
    sides = rows.join(one.unionByName(two), ["cluster", "block"]).join(texts, "node")
    return staged(sides.groupBy("cluster", "x", "y").applyInArrow(_compare_blocks(k, percent), "a long, b long"))


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, key, n_shingles, component_id, kept`` for each row of ``docs``.

    A text's set are its distinct ``k``-word shingles, A-Z in lower case; a text of fewer words is one shingle. Documents are linked if
    ``100 * intersection >= percent * union``; ``component_id`` is the smallest ``doc_id`` reachable by links, ``kept`` says that it is the row's own.

    Null, empty and blank texts have the empty set and are linked with nothing. Null ids are never a component's smallest unless all are null
    (then ``component_id`` is null and the rows are kept). Rows that share an id are told apart by text; rows equal in both stay or go
    together. Other columns are not read. No rows in, no rows out.
    """
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    sketched = staged(keyed.mapInArrow(_sketches(k), "doc_id long, key long, n_shingles long, node long, bands array<long>"))
    nodes = staged(
        sketched.filter("node is not null").groupBy("node").agg(
            F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("row"), F.any_value("bands").alias("bands")
        ).select("node", "row.doc_id", "row.key", "bands")
    )
    comps = near_links(nodes, docs, k, percent)
    named = _labelled(nodes.select("node", "doc_id"), comps)
    least = named.groupBy("comp").agg(F.min("doc_id").alias("component_id"))
    label = named.select("node", "comp").join(least, "comp").select("node", "component_id")
    rows = sketched.select("doc_id", "key", "n_shingles", "node").join(label, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return rows.select("doc_id", "key", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that :func:`near_duplicates` keeps, with all their columns. Copies of the kept text under the
    same id count as the kept document."""
    gone = near_duplicates(docs, k, percent).filter(~F.col("kept")).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]) & (text_key() == gone["__key"]), "left_anti")
