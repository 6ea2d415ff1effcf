"""Random forests for one table or many in one job.

Trees see the numbers themselves. A numeric column can be cut at each of its values if a table has few of them, else at exact quantiles of the
table's rows; undefined values stay left of every cut. A row becomes one small code for each column, the number of cuts below it.

All trees of all tables grow together, one level at a time, and one aggregate over (table, tree, node, feature, code) counts labels for every open node.
While trees are small, rows are stored once with their weights in all trees; a task sends them down the trees so far and adds up the cells of the open nodes. From
the level on where nodes are too many for that, rows carry their table, tree and node. The best cut of each node is a grouped maximum of these counts. Bootstrap weights are
keyed by the row's own id and the features that a node may use by the node, so a forest does not depend on how the rows are partitioned.

Models are rows, one for each tree. Scoring packs trees into blocks of bounded size and sends each block to the asked rows, which are never shuffled.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.functions.keyed import SCALE, digest, uniform
from veilgauge.operators.joining import attach, durable
from veilgauge.operators.quantiles import quantile_rows

LEAST_GAIN = 1e-9
CUTS = 32
BLOCK_BYTES = 64 * 2**20
# Trees are followed by the tasks that scan the rows while they have so few nodes, and their open nodes so few cells.
SCAN_TREES, SCAN_NODES, SCAN_CELLS = 4096, 2**18, 2**23
DIGESTS = 2**18  # computed at once
# Chances that Poisson(1) is at most 0, 1, ... 7.
DRAWS = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


@dataclass(frozen=True)
class Forests:
    """``trees``: keys, tree, and for its nodes in ascending order ``node, f, cut`` (values of feature ``f`` above ``cut`` go right to ``2 * node + 1``,
    the others to ``2 * node``), for its leaves ``leaf`` and ``counts`` (labels of each leaf in turn). ``tables``: keys with their number ``t``."""

    keys: tuple[str, ...]
    classes: int
    trees: DataFrame


def row_id(df: DataFrame) -> Column:
    """What tells the rows of a table apart wherever they are stored: their id, the number a generator gave them, or all their values."""
    for name in ("id", "row"):
        if name in df.columns:
            return F.col(name).cast("string")
    return F.md5(F.to_json(F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])))


def cut_points(rows: DataFrame, keys: Sequence[str], width: int, most: int = CUTS) -> DataFrame:
    """``keys, cuts``: ascending cuts of each feature of ``features``, as an array of arrays. A feature with up to ``most`` distinct values is cut at each of them but
    the largest, any other one at the distinct ones of its ``most - 1`` inner quantiles."""
    by = [*keys, "f"]
    values = rows.select(*keys, F.posexplode("features").alias("f", "v")).where(F.col("v").isNotNull() & ~F.isnan("v"))
    # The estimate merges maxima, so it does not depend on the order of rows; at twice the number it never hides a feature with few values.
    size = durable(values.groupBy(*by).agg(F.approx_count_distinct("v").alias("d")))
    few = attach(values, size.where(F.col("d") <= 2 * most).drop("d"), by, "left_semi")
    listed = few.groupBy(*by).agg(F.sort_array(F.collect_set("v")).alias("c"))
    listed = durable(listed)
    small = listed.where(F.size("c") <= most).select(*by, F.slice("c", F.lit(1), F.size("c") - 1).alias("c"))
    wide = attach(values, small.drop("c"), by, "left_anti")
    parts = small
    if not size.join(small.select(*by), by, "left_anti").isEmpty():
        edges = quantile_rows(wide, ["v"], [j / most for j in range(1, most)], by)
        parts = small.unionByName(edges.groupBy(*by).agg(F.sort_array(F.collect_set("__v")).alias("c")))
    listed = F.collect_list(F.struct("f", "c"))
    none = F.array().cast("array<double>")
    found = parts.groupBy(*keys).agg(F.map_from_entries(listed).alias("m")) if keys else parts.agg(F.map_from_entries(listed).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda f: F.coalesce(F.try_element_at("m", f), none))
    return durable(found.select(*keys, every.alias("cuts")))


def features_of(seed: int, by: Sequence[Column | str], node: Column, width: int, per_node: int) -> Column:
    """``per_node`` different features for a node, each set of them as likely as any other (Floyd's draw)."""

    def take(got: Column, j: Column) -> Column:
        t = F.floor(uniform(digest(seed, "feature", *by, node, j)) * (j + 1)).cast("int")
        return F.concat(got, F.array(F.when(F.array_contains(got, t), j).otherwise(t)))

    return F.aggregate(F.sequence(F.lit(width - per_node), F.lit(width - 1)), F.array().cast("array<int>"), take)


def bootstrap_weight(seed: int, by: Sequence[Column | str], row: Column | str, tree: Column | str) -> Column:
    u = uniform(digest(seed, "bootstrap", *by, row, tree))
    return reduce(add, [(u >= F.lit(c)).cast("int") for c in DRAWS])


def grow(
    rows: DataFrame, keys: Sequence[str], width: int, classes: int, trees: int, depth: int, seed: int, per_node: int | None = None, most: int = CUTS
) -> Forests:
    """One forest for each table of ``keys, row, features, label``: ``features`` are ``width`` numbers, ``row`` is an id of the row within its table that does not depend on where it
    is stored (equal rows may share it). A node looks at ``per_node`` features, the square root of all unless given, and cuts by Gini impurity; ties go to
    the first feature and the lowest cut."""
    keys = list(keys)
    by = [*keys, "tree", "node"]
    per_node = min(per_node or max(1, round(math.sqrt(width))), width)
    cuts = cut_points(rows, keys, width, most)
    coded = attach(rows, cuts, keys) if keys else rows.withColumn("cuts", cuts.select("cuts").scalar())

    def code(x: Column, i: Column) -> Column:
        below = F.size(F.filter(F.element_at("cuts", i + 1), lambda c: c < x))
        return F.when(x.isNull() | F.isnan(x), F.lit(-1)).otherwise(below).cast("int")

    coded = coded.select(*keys, "row", F.transform("features", code).alias("codes"), F.col("label").cast("int").alias("label"))
    coded = durable(coded.where(F.col("label").between(0, classes - 1)))
    splits, leaves = [], []
    names = [f"n{i}" for i in range(classes)]
    columns = [*by, "codes", "label", "w", "looks"]
    level, active = 0, None
    scan = Scan.of(coded, keys, width, classes, trees, seed, per_node, most)
    while scan is not None and scan.fits():
        best = durable(attach(_best(scan.counts(names), ["__t", "tree", "node"], names, level < depth), scan.tables, ["__t"], "inner", scan.n).drop("__t"))
        leaves.append(best.where(~F.col("split")).select(*by, "counts"))
        found = best.where("split").select(*by, "f", "b")
        if level == depth or not scan.descend(found):
            return _packed(splits, leaves, cuts, keys, classes)
        splits.append(found)
        level += 1
    if level:
        active = scan.rows().select(*columns)
    else:
        active = coded.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))))
        active = active.withColumns({"w": bootstrap_weight(seed, keys, "row", "tree"), "node": F.lit(1).cast("bigint")}).where("w > 0")
        active = active.withColumn("looks", features_of(seed, [*keys, "tree"], F.lit(1), width, per_node)).select(*columns)
    active = durable(active)
    for level in range(level, depth + 1):
        cells = active.select(*by, "codes", "label", "w", F.explode("looks").alias("f"))
        cells = cells.withColumn("b", F.element_at("codes", F.col("f") + 1))
        counts = cells.groupBy(*by, "f", "b").agg(*[F.sum(F.when(F.col("label") == i, F.col("w")).otherwise(0)).alias(n) for i, n in enumerate(names)])
        best = durable(_best(counts, by, names, level < depth))
        leaves.append(best.where(~F.col("split")).select(*by, "counts"))
        found = best.where("split").select(*by, "f", "b")
        if level == depth or found.isEmpty():
            break
        splits.append(found)
        child = _children(seed, keys, width, per_node)
        moved = attach(active.drop("looks"), found.withColumns({"__l": child[0], "__r": child[1]}), by, "inner")
        goes = F.element_at("codes", F.col("f") + 1) > F.col("b")
        moved = moved.withColumns({"node": 2 * F.col("node") + goes.cast("bigint"), "looks": F.when(goes, F.col("__r")).otherwise(F.col("__l"))})
        active = durable(moved.select(*columns))
    return _packed(splits, leaves, cuts, keys, classes)


def _children(seed: int, keys: list[str], width: int, per_node: int) -> list[Column]:
    """Features that the left and the right child of a node look at."""
    return [features_of(seed, [*keys, "tree"], 2 * F.col("node") + side, width, per_node) for side in (0, 1)]


def _best(counts: DataFrame, by: list[str], names: list[str], may_split: bool) -> DataFrame:
    """``by, f, b, counts, split``: the best cut of each node, from its counts of labels ``names`` by feature ``f`` and code ``b``."""
    upto = Window.partitionBy(*by, "f").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*by, "f")
    left = F.array(*[F.sum(n).over(upto).cast("double") for n in names])
    total = F.array(*[F.sum(n).over(whole).cast("double") for n in names])
    # No drawn row lies between a code and the next one that occurs, so the cut goes to the middle of the gap.
    after = F.lead("b").over(Window.partitionBy(*by, "f").orderBy("b"))
    middle = F.ceil((F.col("b") + after - 1) / 2).cast("int")
    counts = counts.select(*by, "f", F.coalesce(middle, "b").alias("b"), left.alias("left"), total.alias("total"))
    counts = counts.withColumn("right", F.zip_with("total", "left", lambda t, x: t - x))
    gain = _purity(F.col("left")) + _purity(F.col("right")) - _purity(F.col("total"))
    counts = counts.withColumn("gain", F.when(_sum(F.col("right")) > 0, gain).otherwise(0.0))
    best = counts.groupBy(*by).agg(
        F.max_by(F.struct("f", "b", "gain"), F.struct("gain", -F.col("f"), -F.col("b"))).alias("s"), F.max("total").alias("counts")
    )
    cut = (F.col("s.gain") > LEAST_GAIN) & F.lit(may_split)
    return best.select(*by, "s.f", "s.b", "counts", cut.alias("split"))


def _weights(trees: int):
    """:func:`bootstrap_weight` of each row in all trees; ``name`` is what the digest takes before the number of a tree."""
    tails = [str(i).encode() for i in range(trees)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, DIGESTS // trees)
        for whole in batches:
            for start in range(0, whole.num_rows, step):
                batch = whole.slice(start, step)
                digests = []
                for name in batch.column("name").to_pylist():
                    begun = hashlib.md5(name.encode(), usedforsecurity=False)
                    for tail in tails:
                        one = begun.copy()
                        one.update(tail)
                        digests.append(one.digest())
                first = np.zeros((len(digests), 8), dtype=np.uint8)
                first[:, 2:] = np.frombuffer(b"".join(digests), dtype=np.uint8).reshape(-1, 16)[:, :6]
                drawn = np.searchsorted(DRAWS, first.view(">u8").ravel() / SCALE, side="right").astype(np.int8)
                offsets = pa.array(np.arange(0, len(drawn) + 1, trees, dtype=np.int32))
                lists = pa.ListArray.from_arrays(offsets, pa.array(drawn))
                yield pa.record_batch([batch.column("__t"), batch.column("codes"), batch.column("label"), lists], names=["__t", "codes", "label", "w"])

    return run


@dataclass
class Scan:
    """The rows of all tables once each, with their weights in all trees; trees are small enough that each task follows them and counts the cells of all open nodes.

    ``inner`` and ``open`` hold, for table and tree, the split nodes ``node: (f, b)`` and the open ones ``node: looks``."""

    coded: DataFrame
    tables: DataFrame
    n: int
    keys: list[str]
    shape: tuple[int, int, int]
    seed: int
    per_node: int
    inner: dict
    open: dict

    @classmethod
    def of(cls, coded: DataFrame, keys: list[str], width: int, classes: int, trees: int, seed: int, per_node: int, most: int) -> Scan | None:
        """None where there are too many tables and trees to hold their roots."""
        if keys:
            tables = durable(durable(coded.select(*keys).distinct()).withColumn("__t", F.monotonically_increasing_id()))
        else:
            tables = durable(coded.limit(1).select(F.lit(0).cast("bigint").alias("__t")))
        n = tables.count()
        if not n or n * trees > SCAN_TREES:
            return None
        coded = attach(coded, tables, keys, "inner", n) if keys else coded.withColumn("__t", F.lit(0).cast("bigint"))
        every = F.sequence(F.lit(0), F.lit(trees - 1))
        none = F.array_repeat(F.lit(-1), width)
        name = F.concat_ws(":", F.lit(str(seed)), F.lit("bootstrap"), *[F.col(f"`{k}`").cast("string") for k in keys], F.col("row").cast("string"), F.lit(""))
        named = coded.select("__t", F.coalesce("codes", none).alias("codes"), "label", name.alias("name"))
        rows = durable(named.mapInArrow(_weights(trees), "__t long, codes array<int>, label int, w array<tinyint>"))
        roots = tables.withColumn("tree", F.explode(every)).select("__t", "tree", features_of(seed, [*keys, "tree"], F.lit(1), width, per_node).alias("looks"))
        open_ = {(r["__t"], r["tree"]): {1: r["looks"]} for r in roots.toLocalIterator()}
        return cls(rows, tables, n, keys, (width, classes, most + 1), seed, per_node, {k: {} for k in open_}, open_)

    def fits(self) -> bool:
        _, classes, codes = self.shape
        nodes = sum(map(len, self.open.values()))
        return nodes * self.per_node * codes * classes <= SCAN_CELLS and nodes + sum(map(len, self.inner.values())) <= SCAN_NODES

    def _broadcast(self):
        """By table: number of a tree, its split nodes in order with their cuts, its open nodes in order with their features and the place of the first of them."""
        held, at = {}, 0
        for (t, tree), nodes in sorted(self.open.items()):
            inner = sorted(self.inner[t, tree].items())
            cuts = np.array([c for _, c in inner], dtype=np.int64).reshape(-1, 2)
            names = sorted(nodes)
            looks = np.array([nodes[k] for k in names], dtype=np.int64).reshape(-1, self.per_node)
            held.setdefault(t, []).append((tree, np.array([k for k, _ in inner], dtype=np.int64), cuts[:, 0], cuts[:, 1], np.array(names, dtype=np.int64), looks, at))
            at += len(names)
        return self.coded.sparkSession.sparkContext.broadcast(held)

    def counts(self, names: list[str]) -> DataFrame:
        """``__t, tree, node, f, b`` and the counts of each label, over all open nodes."""
        fields = ", ".join(["__t long", "tree int", "node long", "f int", "b int", *[f"{n} long" for n in names]])
        found = self.coded.mapInArrow(_open_cells(self._broadcast(), self.shape, self.per_node, names), fields)
        return found.groupBy("__t", "tree", "node", "f", "b").agg(*[F.sum(n).alias(n) for n in names])

    def descend(self, found: DataFrame) -> bool:
        """Nodes ``found`` are split and their children open; whether there are any."""
        child = _children(self.seed, self.keys, self.shape[0], self.per_node)
        split = attach(found, self.tables, self.keys, "inner", self.n) if self.keys else found.withColumn("__t", F.lit(0).cast("bigint"))
        self.open = {k: {} for k in self.open}
        some = False
        for r in split.select("__t", "tree", "node", "f", "b", child[0].alias("l"), child[1].alias("r")).toLocalIterator():
            some, key = True, (r["__t"], r["tree"])
            self.inner[key][r["node"]] = (r["f"], r["b"])
            self.open[key] |= {2 * r["node"]: r["l"], 2 * r["node"] + 1: r["r"]}
        return some

    def rows(self) -> DataFrame:
        """A row for each row and tree that reaches an open node, with the node and its features, for when the nodes are too many to hold."""
        placed = self.coded.mapInArrow(_places(self._broadcast(), self.shape[0]), "__t long, tree int, node long, codes array<int>, label int, w int")
        open_ = F.col("node")
        out = attach(placed, self.tables, ["__t"], "inner", self.n) if self.keys else placed
        return out.withColumn("looks", features_of(self.seed, [*self.keys, "tree"], open_, self.shape[0], self.per_node))


def _reached(batch: pa.RecordBatch, held: dict, width: int):
    """For each table and tree in a batch: the tree, the numbers of its drawn rows in open nodes, the places of these among the open nodes, and all codes and weights."""
    n = batch.num_rows
    codes = batch.column("codes").flatten().to_numpy(zero_copy_only=False).reshape(n, width)
    w = batch.column("w").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
    t = batch.column("__t").to_numpy(zero_copy_only=False)
    for one in np.unique(t).tolist():
        mine = np.flatnonzero(t == one)
        for entry in held.get(one, ()):
            tree, inner, f, b, names, _, _ = entry
            if not len(names):
                continue
            rows = mine[w[mine, tree] > 0]
            at = np.ones(len(rows), dtype=np.int64)
            going = np.arange(len(rows)) if len(inner) else np.zeros(0, dtype=np.int64)
            while len(going):
                place = np.minimum(np.searchsorted(inner, at[going]), len(inner) - 1)
                split = inner[place] == at[going]
                going, place = going[split], place[split]
                at[going] = 2 * at[going] + (codes[rows[going], f[place]] > b[place])
            slot = np.minimum(np.searchsorted(names, at), len(names) - 1)
            still = names[slot] == at
            yield one, entry, rows[still], slot[still], codes, w


def _open_cells(block, shape: tuple[int, int, int], per_node: int, names: list[str]):
    """Counts of labels in all cells of the open nodes over a task's rows."""
    width, classes, codes_of = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        entries = [(t, e) for t, mine in held.items() for e in mine]
        nodes = sum(len(e[4]) for _, e in entries)
        cells = np.zeros(nodes * per_node * codes_of * classes, dtype=np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            label = batch.column("label").to_numpy(zero_copy_only=False)
            for _, (tree, *_, opened, looks, first), rows, slot, codes, w in _reached(batch, held, width):
                size = per_node * codes_of * classes
                mine = cells[first * size : (first + len(opened)) * size]
                for i in range(per_node):
                    b = codes[rows, looks[slot, i]] + 1
                    cell = ((slot * per_node + i) * codes_of + b) * classes + label[rows]
                    np.add.at(mine, cell, w[rows, tree])
        table = cells.reshape(nodes * per_node, codes_of, classes)
        at, b = np.nonzero(table.any(axis=2))
        if len(at):
            whose = np.concatenate([np.stack([np.full(len(e[4]), t), np.full(len(e[4]), e[0]), e[4]]) for t, e in sorted(entries, key=lambda x: x[1][6])], axis=1)
            look = np.concatenate([e[5] for _, e in sorted(entries, key=lambda x: x[1][6])])
            slot = at // per_node
            arrays = [pa.array(whose[0, slot]), pa.array(whose[1, slot].astype(np.int32)), pa.array(whose[2, slot]), pa.array(look[slot, at % per_node].astype(np.int32)), pa.array((b - 1).astype(np.int32))]
            yield pa.record_batch([*arrays, *[pa.array(table[at, b, i]) for i in range(classes)]], names=["__t", "tree", "node", "f", "b", *names])

    return run


def _places(block, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = block.value
        for batch in batches:
            for t, (tree, *_, opened, _, _), rows, slot, _, w in _reached(batch, held, width) if batch.num_rows else ():
                some = pa.array(rows)
                head = [pa.array(np.full(len(rows), t)), pa.array(np.full(len(rows), tree, np.int32)), pa.array(opened[slot])]
                tail = [batch.column("codes").take(some), batch.column("label").take(some), pa.array(w[rows, tree].astype(np.int32))]
                yield pa.record_batch([*head, *tail], names=["__t", "tree", "node", "codes", "label", "w"])

    return run


def _packed(splits: list[DataFrame], leaves: list[DataFrame], cuts: DataFrame, keys: list[str], classes: int) -> Forests:
    """Trees as rows, from the split nodes and leaves of each level."""
    by = [*keys, "tree", "node"]
    none = leaves[0].where("false").select(*by, F.lit(0).alias("f"), F.lit(0).alias("b"))
    inner = reduce(DataFrame.unionByName, splits, none)
    inner = attach(inner, cuts, keys) if keys else inner.withColumn("cuts", cuts.select("cuts").scalar())
    value = F.coalesce(F.try_element_at(F.element_at("cuts", F.col("f") + 1), F.col("b") + 1), F.lit(float("-inf")))
    inner = inner.select(*by, "f", F.when(F.col("b") >= 0, value).otherwise(F.lit(float("-inf"))).alias("cut"))
    one = [*keys, "tree"]
    cut_rows = inner.groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("node", "f", "cut"))).alias("s"))
    ends = reduce(DataFrame.unionByName, leaves).groupBy(*one).agg(F.sort_array(F.collect_list(F.struct("node", "counts"))).alias("e"))
    packed = attach(ends, cut_rows, one)
    return Forests(
        tuple(keys), classes,
        durable(
            packed.select(
                *one, F.coalesce("s.node", F.array().cast("array<bigint>")).alias("node"), F.coalesce("s.f", F.array().cast("array<int>")).alias("f"),
                F.coalesce("s.cut", F.array().cast("array<double>")).alias("cut"), F.col("e.node").alias("leaf"), F.flatten("e.counts").alias("counts"),
            )
        ),
    )


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def _purity(counts: Column) -> Column:
    """Sum of squared counts over the sum of counts: what Gini impurity takes off the size of a node."""
    squares = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x * x)
    return F.when(_sum(counts) > 0, squares / _sum(counts)).otherwise(0.0)


def _leaves(tree: dict, x: np.ndarray) -> np.ndarray:
    """Index of the leaf of each row of ``x``."""
    nodes, at = tree["node"], np.ones(len(x), dtype=np.int64)
    open_ = np.arange(len(x)) if len(nodes) else np.zeros(0, dtype=np.int64)
    while len(open_):
        place = np.minimum(np.searchsorted(nodes, at[open_]), len(nodes) - 1)
        inner = nodes[place] == at[open_]
        open_, place = open_[inner], place[inner]
        at[open_] = 2 * at[open_] + (x[open_, tree["f"][place]] > tree["cut"][place])
    return np.searchsorted(tree["leaf"], at)


def _shares(block, classes: int, width: int, by: list[str]):
    """Summed label shares of each asked row over the trees of its table in a block. Without keys every row is asked of the one table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forests = block.value
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            flat = batch.column("features").flatten().to_numpy(zero_copy_only=False).astype(float)
            x = flat.reshape(n, width)
            t = batch.column("__t").to_numpy(zero_copy_only=False)
            total, trees = np.zeros((n, classes)), np.zeros(n, dtype=np.int32)
            for one in np.unique(t).tolist():
                rows = np.flatnonzero(t == one)
                for tree in forests.get(one, ()):
                    with np.errstate(invalid="ignore"):
                        total[rows] += tree["share"][_leaves(tree, x[rows])]
                    trees[rows] += 1
            offsets = pa.array(np.arange(0, (n + 1) * classes, classes, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))
            yield pa.record_batch([batch.column("__t"), batch.column("row"), lists, pa.array(trees)], names=["__t", "row", "total", "trees"]).select([*by, "total", "trees"])

    return run


def _plain(row, classes: int) -> dict:
    counts = np.array(row["counts"]).reshape(-1, classes)
    return {
        "node": np.array(row["node"], dtype=np.int64), "f": np.array(row["f"], dtype=np.int64), "cut": np.array(row["cut"], dtype=float),
        "leaf": np.array(row["leaf"], dtype=np.int64), "share": counts / counts.sum(axis=1, keepdims=True),
    }


def blocks_of(forests: Forests) -> tuple[DataFrame, DataFrame, int]:
    """``keys, __t`` of every table, its trees as ``__t, __block`` and the model, and the number of blocks: tables in order, cut where ``BLOCK_BYTES`` are reached."""
    keys = list(forests.keys)
    tables = forests.trees.select(*keys).distinct() if keys else forests.trees.limit(1).select(F.lit(0).alias("__one"))
    tables = durable(durable(tables).withColumn("__t", F.monotonically_increasing_id())).select(*keys, "__t")
    size = (F.size("node") * 20 + F.size("leaf") * 8 * (1 + forests.classes) + 64).cast("long")
    trees = attach(forests.trees, tables, keys, "inner", tables.count()) if keys else forests.trees.withColumn("__t", tables.select("__t").scalar())
    trees = trees.withColumn("__size", size)
    total = trees.agg(F.sum("__size")).first()[0] or 0
    blocks = max(-(-total // BLOCK_BYTES), 1)
    # Trees are dealt out by number, so that a block holds a like share of every table.
    return tables, trees.withColumn("__block", F.pmod(F.xxhash64("__t", "tree"), F.lit(blocks))), blocks


def probabilities(forests: Forests, asked: DataFrame, width: int) -> DataFrame:
    """``keys, row, probs`` for rows ``keys, row, features``: shares of each label, averaged over the trees of the row's table. Rows of tables
    without a forest are left out; rows that agree in keys and ``row`` have to be equal."""
    keys = list(forests.keys)
    tables, trees, blocks = blocks_of(forests)
    n = tables.count()
    asked = attach(asked, tables, keys, "inner", n) if keys else asked.withColumn("__t", tables.select("__t").scalar())
    asked = asked.where("__t is not null").select("__t", "row", "features")
    kind = dict(asked.dtypes)["row"]
    parts = []
    for b in range(blocks):
        held: dict[int, list] = {}
        for r in trees.where(F.col("__block") == b).orderBy("__t", "tree").toLocalIterator():
            held.setdefault(r["__t"], []).append(_plain(r, forests.classes))
        block = asked.sparkSession.sparkContext.broadcast(held)
        parts.append(asked.mapInArrow(_shares(block, forests.classes, width, ["__t", "row"]), f"__t long, row {kind}, total array<double>, trees int"))
    both = reduce(DataFrame.unionByName, parts)
    if blocks > 1:
        sums = [F.sum(F.element_at("total", i + 1)) for i in range(forests.classes)]
        both = both.groupBy("__t", "row").agg(F.array(*sums).alias("total"), F.sum("trees").alias("trees"))
    both = both.where("trees > 0").withColumn("probs", F.transform("total", lambda v: v / F.col("trees"))).select("__t", "row", "probs")
    return attach(both, tables, ["__t"], "inner", n).select(*keys, "row", "probs") if keys else both.select("row", "probs")
