"""Bayesian networks over binned columns, plain and differentially private."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.functions.encoding import literal_array
from veilgauge.functions.keyed import SCALE, digest, invert_cdf, laplace, uniform
from veilgauge.meta import INTEGER, TableMeta
from veilgauge.operators.distributions import COMPACT_CELLS, Binning, numbered_cells, profile, weight, weighted, with_probabilities
from veilgauge.operators.generate import cell_digest, row_frame, value_in_bin
from veilgauge.operators.information import candidate_information, pair_information
from veilgauge.operators.joining import attach, durable

CHECKPOINT_EVERY = 20


# ---- exponential mechanism --------------------------------------------------------------------------------------


def sensitivity(n: float, binary: bool) -> float:
    """How far the mutual information of one candidate can move when one of ``n`` rows changes."""
    if binary:
        return math.log(n) / n + (n - 1) / n * math.log(n / (n - 1))
    return 2 / n * math.log((n + 1) / 2) + (1 - 1 / n) * math.log(1 + 2 / (n - 1))


def sensitivity_column(n: Column, binary: Column) -> Column:
    n = n.cast("double")
    small = F.ln(n) / n + (n - 1) / n * F.ln(n / (n - 1))
    large = 2 / n * F.ln((n + 1) / 2) + (1 - 1 / n) * F.ln(1 + 2 / (n - 1))
    return F.when(binary, small).otherwise(large)


def exponential_weights(cands: DataFrame, epsilon: float, d: int, by: Sequence[str]) -> DataFrame:
    """Add ``score`` and ``prob`` of each candidate (``mi, binary, n``) within its group.

    The largest score is subtracted before the exponential, which leaves the shares as they are and cannot overflow.
    """
    delta = (d - 1) * sensitivity_column(F.col("n"), F.col("binary")) / epsilon
    out = cands.withColumn("score", F.col("mi") / (2 * delta))
    w = Window.partitionBy(*by)
    out = out.withColumn("__w", F.exp(F.col("score") - F.max("score").over(w)))
    return out.withColumn("prob", F.col("__w") / F.sum("__w").over(w)).drop("__w")


def _hex(seed: int, tag: str, *parts) -> str:
    return hashlib.md5(":".join([str(seed), tag, *[str(p) for p in parts]]).encode()).hexdigest()


def _gumbel(hexed: str) -> float:
    u = (int(hexed[:12], 16) + 0.5) / SCALE
    return -math.log(-math.log(u))


# ---- structure --------------------------------------------------------------------------------------------------

ORDER_FIELDS = [
    T.StructField("order", T.ArrayType(T.IntegerType())),
    T.StructField("parents", T.ArrayType(T.ArrayType(T.IntegerType()))),
]


def root_of(seed: int, names: Sequence[str], key: Sequence) -> int:
    """The column the network grows from: smallest keyed hash."""
    return min(range(len(names)), key=lambda i: (_hex(seed, "root", *key, names[i]), names[i]))


def _tree(names: list[str], seed: int, keys: list[str], epsilon: float | None):
    """Grouped function: grow a network with one parent per column from the pair table of one data table.

    Every step takes the best edge between a chosen and an open column; ties go to the smaller child, then parent.
    With ``epsilon`` the edge is drawn by the exponential mechanism instead.
    """
    d = len(names)

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in keys]
        mi = {}
        for i, j, m in zip(pdf["i"], pdf["j"], pdf["mi"]):
            mi[int(i), int(j)] = mi[int(j), int(i)] = round(float(m), 12)
        n = float(pdf["rows"].iloc[0])
        binary = list(pdf["binary"].iloc[0])
        order, parents = [root_of(seed, names, key)], [[]]
        while len(order) < d:
            best = None
            for child in set(range(d)) - set(order):
                for parent in order:
                    score = mi.get((child, parent), 0.0)
                    if epsilon is not None:
                        delta = (d - 1) * sensitivity(n, binary[child] or binary[parent]) / epsilon
                        noise = _gumbel(_hex(seed, "edge", *key, len(order), names[child], names[parent]))
                        score = score / (2 * delta) + noise
                    rank = (-score, names[child], names[parent])
                    if best is None or rank < best[0]:
                        best = (rank, child, parent)
            order.append(best[1])
            parents.append([best[2]])
        return pd.DataFrame([[*key, order, parents]], columns=[*keys, "order", "parents"])

    return grow


def table_facts(prof: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Per table: number of ``rows`` and which columns have at most two different values."""
    per = prof.withColumn("used", F.size(F.filter("counts", lambda c: c > 0)) + (F.col("nulls") > 0).cast("int"))
    return per.groupBy(*keys).agg(
        F.max(F.col("total") + F.col("nulls") + F.col("outside")).alias("rows"),
        F.transform(F.sort_array(F.collect_list(F.struct("attr_idx", (F.col("used") <= 2).alias("b")))), lambda s: s["b"]).alias("binary"),
    )


def tree_structure(
    coded: DataFrame, binning: Binning, facts: DataFrame, keys: Sequence[str], seed: int, epsilon: float | None
) -> DataFrame:
    """``keys, order, parents`` for degree 1. Pair information is computed once; a pair table has d² rows."""
    keys = list(keys)
    names = binning.meta.names
    pairs = pair_information(coded, len(names), binning.radix, keys)
    pairs = attach(pairs, facts, keys)
    schema = T.StructType([*[coded.schema[k] for k in keys], *ORDER_FIELDS])
    by = keys or [F.lit(0).alias("__all")]
    return pairs.select(*keys, "i", "j", "mi", "rows", "binary").groupBy(*by).applyInPandas(_tree(names, seed, keys, epsilon), schema)


def _candidates(degree: int, d: int, keys: list[str]):
    """Batch function: parent sets that became possible with the newest column, for each open column."""

    def expand(batches):
        for pdf in batches:
            out = []
            for order in pdf["order"]:
                order = [int(a) for a in order]
                size = min(len(order), degree)
                newest = order[-1]
                older = combinations(order[:-1], size - 1)
                sets = [sorted([*rest, newest]) for rest in older]
                out.append([{"child": c, "parents": s} for c in range(d) if c not in order for s in sets])
            pdf = pdf[[*keys]].copy()
            pdf["cands"] = out
            yield pdf

    return expand


def network_structure(
    coded: DataFrame, binning: Binning, facts: DataFrame, keys: Sequence[str], seed: int, degree: int, epsilon: float | None
) -> DataFrame:
    """``keys, order, parents`` for any degree: one scoring job per added column.

    Scores of earlier rounds are kept, so a parent set is scored once. While fewer columns than ``degree`` are chosen the
    sets still grow, and only sets of the current size compete.
    """
    keys = list(keys)
    d, names = len(binning.meta), binning.meta.names
    spark = coded.sparkSession
    root = digest(seed, "root", *keys, F.col("name"))
    tables = facts.select(*keys, "rows", "binary")
    listed = tables.select(*keys, F.posexplode(literal_array(names)).alias("pos", "name"))
    first = listed.groupBy(*keys).agg(F.min_by("pos", F.struct(root, "name")).alias("root"))
    state = first.select(
        *keys, F.array("root").alias("order"), F.array(F.array().cast("array<int>")).alias("parents")
    )
    state = durable(state)
    scores = None
    cand_type = T.ArrayType(T.StructType([T.StructField("child", T.IntegerType()), T.StructField("parents", T.ArrayType(T.IntegerType()))]))
    schema = T.StructType([*[coded.schema[k] for k in keys], T.StructField("cands", cand_type)])
    for step in range(1, d):
        cands = state.select(*keys, "order").mapInPandas(_candidates(degree, d, keys), schema)
        new = candidate_information(attach(coded, cands, keys, "inner"), binning.sizes, keys)
        scores = new if scores is None else scores.unionByName(new)
        scores = durable(scores)
        open_ = attach(scores, state.select(*keys, "order"), keys, "inner")
        open_ = open_.where(~F.array_contains("order", F.col("child")) & (F.size("parents") == min(step, degree)))
        child_name = F.element_at(literal_array(names), F.col("child") + 1)
        rank = F.round("mi", 12)
        if epsilon is not None:
            open_ = attach(open_, tables, keys, "inner")
            one = F.size("parents") == 1
            binary = F.element_at("binary", F.col("child") + 1) | (one & F.element_at("binary", F.element_at("parents", 1) + 1))
            delta = (d - 1) * sensitivity_column(F.col("rows"), binary) / epsilon
            named = F.array_join(F.transform("parents", lambda p: F.element_at(literal_array(names), p + 1)), ",")
            # The noise of an edge is the same number in both searches.
            u = uniform(digest(seed, "edge", *keys, F.lit(step), child_name, named)) + F.lit(0.5 / SCALE)
            rank = rank / (2 * delta) - F.ln(-F.ln(u))
        best = open_.groupBy(*keys).agg(
            F.min_by(F.struct("child", "parents"), F.struct(-rank, child_name, F.col("parents"))).alias("best")
        )
        state = attach(state, best, keys, "inner").select(
            *keys,
            F.concat("order", F.array("best.child")).alias("order"),
            F.concat("parents", F.array("best.parents")).alias("parents"),
        )
        state = durable(state)
    return state


def structure_rows(network: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The network as ``(keys, step, child, parents)``; step 0 is the root and has no parents."""
    labels = literal_array(names)
    rows = network.select(*keys, F.posexplode(F.arrays_zip("order", "parents")).alias("step", "e"))
    return rows.select(
        *keys, "step", F.element_at(labels, F.col("e.order") + 1).alias("child"),
        F.transform("e.parents", lambda p: F.element_at(labels, p + 1)).alias("parents"),
    )


def fixed_network(spark, names: Sequence[str], edges: Sequence[tuple[str, Sequence[str]]]) -> DataFrame:
    """A given network for one table: ``[(root, []), (child, [parents]), …]``."""
    at = {n: i for i, n in enumerate(names)}
    row = ([at[c] for c, _ in edges], [[at[p] for p in ps] for _, ps in edges])
    return spark.createDataFrame([row], T.StructType(ORDER_FIELDS))


def check_cells(network: DataFrame, binning: Binning) -> None:
    """Refuse networks with a table of more cells than numbers of 63 bits, which could not be listed anyway. Only the columns of a table count."""
    sizes = literal_array([float(x) for x in binning.sizes])
    bits = F.transform(F.arrays_zip("order", "parents"), lambda e: F.aggregate(e["parents"], F.log2(F.element_at(sizes, e["order"] + 1)), lambda acc, p: acc + F.log2(F.element_at(sizes, p + 1))))
    if (network.agg(F.max(F.array_max(bits))).first()[0] or 0) >= 62.9:
        raise ValueError("a table of the network has too many cells to be numbered in 63 bits; use fewer bins or a lower degree")


# ---- conditional distributions ----------------------------------------------------------------------------------


def cell_counts(
    coded: DataFrame, network: DataFrame, binning: Binning, keys: Sequence[str], degree: int,
    noise_scale: float | None = None, seed: int = 42,
) -> DataFrame:
    """``keys, tab, attrs, codes, n``: counts over the full domain of every table the network needs.

    Table 0 joins the first ``degree + 1`` columns; table ``s`` holds the parents and the child of a later step ``s``.
    With a noise scale every cell gets Laplace noise keyed by table and cell, so that all steps that read table 0 see
    the same noisy counts; negative counts become 0.
    """
    keys = list(keys)
    d, sizes = len(binning.meta), literal_array(binning.sizes)
    k = min(degree, d - 1)
    steps = F.sequence(F.lit(k + 1), F.lit(d - 1)) if d - 1 > k else F.array().cast("array<int>")
    tabs = F.concat(
        F.array(F.struct(F.lit(0).alias("tab"), F.slice("order", 1, k + 1).alias("attrs"))),
        F.transform(
            steps,
            lambda s: F.struct(
                s.alias("tab"),
                F.concat(F.element_at("parents", s + 1), F.array(F.element_at("order", s + 1))).alias("attrs"),
            ),
        ),
    )
    needs = network.select(*keys, tabs.alias("tabs"))
    facts = attach(coded, needs, keys, "inner")
    facts = facts.select(*keys, "bins", *weighted(coded), F.explode("tabs").alias("__t"))
    cell = F.aggregate("__t.attrs", F.lit(0).cast("bigint"), lambda acc, a: acc * F.element_at(sizes, a + 1) + F.element_at("bins", a + 1))
    counts = facts.select(*keys, F.col("__t.tab").alias("tab"), cell.alias("cell"), *weighted(coded)).where("cell is not null")
    counts = counts.groupBy(*keys, "tab", "cell").agg(weight(coded).alias("n"))
    space = needs.select(*keys, F.explode("tabs").alias("__t")).select(*keys, "__t.*")
    size_of = F.transform("attrs", lambda a: F.element_at(sizes, a + 1))
    space = space.withColumn("sizes", size_of)
    total = F.aggregate("sizes", F.lit(1).cast("bigint"), lambda acc, s: acc * s)
    space = numbered_cells(space, total, "cell")
    # The number of a cell in the mixed base of its columns' sizes, last column fastest; here are its digits.
    digits = F.transform(
        "sizes",
        lambda s, i: (
            F.floor(F.col("cell") / F.aggregate(F.slice("sizes", i + 2, F.size("sizes")), F.lit(1).cast("bigint"), lambda acc, x: acc * x)) % s
        ).cast("int"),
    )
    full = space.withColumn("codes", digits).join(counts, [*keys, "tab", "cell"], "left")
    n = F.coalesce(F.col("n"), F.lit(0)).cast("double")
    if noise_scale is not None:
        names = literal_array(binning.meta.names)
        what = F.array_join(F.transform("attrs", lambda a: F.element_at(names, a + 1)), ",")
        where = F.array_join(F.col("codes").cast("array<string>"), ",")
        n = F.greatest(n + laplace(uniform(digest(seed, "cell", *keys, what, where)), noise_scale), F.lit(0.0))
    return full.select(*keys, "tab", "attrs", "codes", n.alias("n"))


def conditional_distributions(cells: DataFrame, network: DataFrame, binning: Binning, keys: Sequence[str], degree: int) -> DataFrame:
    """``keys, step, parent_code, counts, probs, cdf``: one distribution per step and combination of parent codes.

    The root has parent code 0. Steps up to ``degree`` are sums over table 0; later ones have their own table.
    """
    keys = list(keys)
    k, sizes = min(degree, len(binning.meta) - 1), literal_array(binning.sizes)
    net = network.select(*keys, F.col("order").alias("__order"), F.col("parents").alias("__parents"))
    rows = attach(cells, net, keys, "inner")

    def code(positions: Column) -> Column:
        base = lambda p: F.element_at(sizes, F.element_at("attrs", p) + 1)
        return F.aggregate(positions, F.lit(0).cast("bigint"), lambda acc, p: acc * base(p) + F.element_at("codes", p))

    shared = F.transform(
        F.sequence(F.lit(0), F.lit(k)),
        lambda s: F.struct(
            s.alias("step"),
            code(F.transform(F.element_at("__parents", s + 1), lambda p: F.array_position("attrs", p).cast("int"))).alias("parent_code"),
            F.element_at("codes", s + 1).alias("child"),
        ),
    )
    last = F.size("codes")
    own = F.array(
        F.struct(F.col("tab").alias("step"), code(F.sequence(F.lit(1), last - 1)).alias("parent_code"), F.element_at("codes", last).alias("child"))
    )
    rows = rows.select(*keys, "n", "__order", F.explode(F.when(F.col("tab") == 0, shared).otherwise(own)).alias("__e"))
    rows = rows.withColumn("size", F.element_at(sizes, F.element_at("__order", F.col("__e.step") + 1) + 1))
    rows = rows.select(*keys, "n", "size", "__e.*")
    sums = rows.groupBy(*keys, "step", "parent_code", "child").agg(F.sum("n").alias("n"), F.first("size").alias("size"))
    dist = sums.groupBy(*keys, "step", "parent_code").agg(
        F.map_from_entries(F.collect_list(F.struct("child", "n"))).alias("m"), F.first("size").alias("size")
    )
    dist = dist.withColumn(
        "counts", F.transform(F.sequence(F.lit(0), F.col("size") - 1), lambda b: F.coalesce(F.try_element_at("m", b), F.lit(0.0)))
    )
    return with_probabilities(dist.drop("m")).select(*keys, "step", "parent_code", "counts", "probs", "cdf")


def distribution_rows(cpt: DataFrame, network: DataFrame, binning: Binning, keys: Sequence[str] = ()) -> DataFrame:
    """``keys, step, child, parent_codes, bin, n, prob`` with parent codes as text (``""`` for the root)."""
    keys = list(keys)
    steps = network.select(*keys, F.posexplode(F.arrays_zip("order", "parents")).alias("step", "e"))
    sizes = literal_array(binning.sizes)
    bases = F.transform("e.parents", lambda p: F.element_at(sizes, p + 1))
    steps = steps.select(*keys, "step", F.element_at(literal_array(binning.meta.names), F.col("e.order") + 1).alias("child"), F.size("e.parents").alias("np"), bases.alias("bases"))
    rows = attach(cpt, steps, [*keys, "step"], "inner")
    digits = F.transform(
        "bases",
        lambda s, i: F.floor(F.col("parent_code") / F.aggregate(F.slice("bases", i + 2, F.size("bases")), F.lit(1).cast("bigint"), lambda acc, x: acc * x)) % s,
    )
    text = F.when(F.col("np") == 0, F.lit("")).otherwise(F.array_join(digits.cast("array<string>"), " "))
    rows = rows.select(*keys, "step", "child", text.alias("parent_codes"), "probs", F.posexplode("counts").alias("bin", "n"))
    return rows.select(*keys, "step", "child", "parent_codes", "bin", "n", F.element_at("probs", F.col("bin") + 1).alias("prob"))


# ---- models -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class BayesModel:
    binning: Binning
    keys: tuple[str, ...]
    degree: int
    network: DataFrame
    cpt: DataFrame
    prof: DataFrame

    def generate(self, n: int, seed: int = 42, copies: int = 1) -> DataFrame:
        """``keys, copy, row`` and the columns of the table, drawn column by column along the network.

        Each step looks up the distribution for the parents drawn so far. A step's distributions number at most
        tables × parent combinations, which is known beforehand, so nothing has to be counted and generated rows do not
        move as long as that is small.
        """
        keys, meta = list(self.keys), self.binning.meta
        tables = self.network.count() if keys else 1
        rows = row_frame(self.network.sparkSession, n, copies, self.network, keys)
        # One digest per cell serves both the draw of the bin and the place in it.
        rows = rows.withColumns({f"__h{i}": cell_digest(seed, "net", keys, c.name) for i, c in enumerate(meta.columns)})
        rows = self._draw_many(rows, tables) if keys else self._draw_one(rows)
        if self.binning.infer_ranges:
            edges = self.prof.groupBy(*keys).agg(
                *[F.max(F.when(F.col("attr_idx") == i, F.col("edges"))).alias(f"__edges_{i}") for i, c in enumerate(meta.columns) if c.numeric]
            )
            rows = attach(rows, edges, keys, "inner", bound=tables, width=8 * len(meta) * self.binning.radix)
        out = []
        for i, c in enumerate(meta.columns):
            b = F.col(f"__b{i}")
            if c.numeric:
                out.append(value_in_bin(self.binning.edges(i), b, uniform(F.col(f"__h{i}"), 1), c.kind == INTEGER).alias(c.name))
            else:
                out.append(F.element_at(literal_array(c.labels), b + 1).alias(c.name))
        return rows.select(*keys, "copy", "row", *out)

    def _draw_one(self, rows: DataFrame) -> DataFrame:
        """One table: its network and marginals (at most columns × bins numbers) are constants of the plan."""
        radix = self.binning.radix
        net = self.network.first()
        marginal = {r["attr_idx"]: r["cdf"] for r in self.prof.select("attr_idx", "cdf").collect()}
        for step, (attr, parents) in enumerate(zip(net["order"], net["parents"])):
            code = F.lit(0).cast("bigint")
            for p in parents:
                code = code * self.binning.sizes[p] + F.col(f"__b{p}")
            table = self.cpt.where(F.col("step") == step).select(F.col("parent_code").alias("__code"), F.col("cdf").alias("__cdf"))
            rows = attach(rows.withColumn("__code", code), table, ["__code"], bound=math.prod(self.binning.sizes[p] for p in parents), width=8 * radix + 64)
            pick = invert_cdf(F.coalesce(F.col("__cdf"), literal_array(marginal[attr])), uniform(F.col(f"__h{attr}")))
            rows = rows.withColumn(f"__b{attr}", pick).drop("__code", "__cdf")
            if step and step % CHECKPOINT_EVERY == 0:
                rows = durable(rows)
        return rows

    def _draw_many(self, rows: DataFrame, tables: int) -> DataFrame:
        """Many tables, each with its own network: step ``s`` draws whatever column comes ``s``-th in its table."""
        keys, meta = list(self.keys), self.binning.meta
        d, radix, sizes = len(meta), self.binning.radix, literal_array(self.binning.sizes)
        rows = attach(rows, self.network, keys, "inner", bound=tables, width=16 * d * (self.degree + 2))
        marginal = self.prof.select(*keys, "attr_idx", F.col("cdf").alias("__marginal"))
        rows = rows.withColumn("drawn", F.array().cast("array<int>"))
        width = 8 * radix + 64
        for step in range(d):
            parents = min(step, self.degree)
            code = F.lit(0).cast("bigint")
            for p in range(1, parents + 1):
                parent = F.element_at(F.element_at("parents", step + 1), p)
                at = F.array_position("order", parent).cast("int")
                code = code * F.element_at(sizes, parent + 1) + F.element_at("drawn", at)
            attr = F.element_at("order", step + 1)
            rows = rows.withColumns({"__code": code, "attr_idx": attr})
            table = self.cpt.where(F.col("step") == step).select(*keys, F.col("parent_code").alias("__code"), F.col("cdf").alias("__cdf"))
            rows = attach(rows, table, [*keys, "__code"], bound=tables * math.prod(sorted(self.binning.sizes)[d - parents :]), width=width)
            rows = attach(rows, marginal, [*keys, "attr_idx"], bound=tables * d, width=width)
            hexed = F.element_at(F.array(*[F.col(f"__h{i}") for i in range(d)]), F.col("attr_idx") + 1)
            pick = invert_cdf(F.coalesce("__cdf", "__marginal"), uniform(hexed))
            rows = rows.withColumn("drawn", F.concat("drawn", F.array(pick))).drop("__code", "__cdf", "__marginal", "attr_idx")
            if step and step % CHECKPOINT_EVERY == 0:
                rows = durable(rows)
        return rows.withColumns({f"__b{i}": F.element_at("drawn", F.array_position("order", i).cast("int")) for i in range(d)})


@dataclass(frozen=True)
class BayesianNet:
    meta: TableMeta
    histogram_bins: int = 10
    degree: int = 1
    infer_ranges: bool = False
    seed: int = 42

    generates = True

    def __post_init__(self):
        if len(self.meta) < 2:
            raise ValueError("a network needs at least two columns")

    @property
    def name(self) -> str:
        return "BayesianNet"

    @property
    def out_meta(self) -> TableMeta:
        return self.meta

    @property
    def structure_epsilon(self) -> float | None:
        return None

    @property
    def noise_scale(self) -> float | None:
        return None

    def fit(self, df: DataFrame, keys: Sequence[str] = (), network: DataFrame | None = None) -> BayesModel:
        """Fit one network per table. A given ``network`` skips the search."""
        keys = list(keys)
        binning = Binning(self.meta, self.histogram_bins, bool(self.infer_ranges))
        coded = binning.compact(df, keys)
        if binning.cells <= COMPACT_CELLS:
            # Bounded by the domain, and read by the search and by the counting.
            coded = durable(coded)
        prof = durable(profile(df, binning, keys))
        if network is None:
            facts = table_facts(prof, keys)
            if self.degree == 1:
                network = tree_structure(coded, binning, facts, keys, self.seed, self.structure_epsilon)
            else:
                network = network_structure(coded, binning, facts, keys, self.seed, self.degree, self.structure_epsilon)
        network = durable(network)
        check_cells(network, binning)
        cells = cell_counts(coded, network, binning, keys, self.degree, self.noise_scale, self.seed)
        cpt = durable(conditional_distributions(cells, network, binning, keys, self.degree))
        return BayesModel(binning, tuple(keys), self.degree, network, cpt, prof)


@dataclass(frozen=True)
class PrivBayes(BayesianNet):
    """Half of the privacy budget chooses the structure, half is spent on noisy counts.

    Ranges inferred from the data, and which columns are binary, are read without noise and are not private.
    """

    epsilon: float = 0.1

    @property
    def name(self) -> str:
        return f"PrivBayesEps{float(self.epsilon)}"

    @property
    def structure_epsilon(self) -> float | None:
        return self.epsilon / 2

    @property
    def noise_scale(self) -> float | None:
        return 2 * (len(self.meta) - self.degree) / (self.epsilon / 2)
