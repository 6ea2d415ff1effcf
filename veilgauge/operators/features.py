"""Features of published tables: one array per table, or one row per feature."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.encoding import label_code, literal_array, right_closed_bin
from veilgauge.functions.keyed import once
from veilgauge.meta import NULL_LABEL, TableMeta
from veilgauge.operators.distributions import COMPACT_CELLS
from veilgauge.operators.joining import attach
from veilgauge.operators.quantiles import quantiles


def feature_rows(vectors: DataFrame, names: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """``(keys, feature_idx, feature_name, value)`` from one vector per table."""
    return vectors.select(*keys, F.posexplode("features").alias("feature_idx", "value")).select(
        *keys, "feature_idx", F.element_at(literal_array(names), F.col("feature_idx") + 1).alias("feature_name"), "value"
    )


def naive_names(meta: TableMeta) -> list[str]:
    stats = (("mean", "most"), ("median", "least"), ("variance", "distinct"))
    return [f"{c.name}_{s[0] if c.numeric else s[1]}" for s in stats for c in meta.columns]


def naive(df: DataFrame, meta: TableMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median, sample variance of numbers; most common, least common and number of codes of labels.

    All first values come first, then all second and third ones. Equal counts are decided by the smaller code; null and
    unknown labels share code -1.
    """
    keys = list(keys)
    meta.check(df.columns)
    parts: list[DataFrame] = []
    numbers = [(i, c) for i, c in enumerate(meta.columns) if c.numeric]
    labels = [(i, c) for i, c in enumerate(meta.columns) if not c.numeric]
    if numbers:
        nums = {f"__x{i}": F.col(f"`{c.name}`").cast("double") for i, c in numbers}
        source = df.select(*keys, *[e.alias(n) for n, e in nums.items()])
        parts.append(
            source.groupBy(*keys).agg(
                *[F.avg(n).alias(f"{n}_a") for n in nums],
                *[F.var_samp(n).alias(f"{n}_c") for n in nums],
            )
        )
        mid = quantiles(source, list(nums), 0.5, keys)
        parts.append(mid.select(*keys, *[F.col(n).alias(f"{n}_b") for n in nums]))
    if labels:
        codes = F.array(
            *[F.struct(F.lit(i).alias("i"), label_code(F.col(f"`{c.name}`"), c.labels, append_null=False).alias("code")) for i, c in labels]
        )
        counts = df.select(*keys, F.explode(codes).alias("e")).groupBy(*keys, "e.i", "e.code").agg(F.count("*").alias("n"))
        stat = counts.groupBy(*keys, "i").agg(
            F.min_by("code", F.struct(-F.col("n"), F.col("code"))).alias("a"),
            F.min_by("code", F.struct(F.col("n"), F.col("code"))).alias("b"),
            F.count("*").alias("c"),
        )
        parts.append(
            stat.groupBy(*keys).agg(
                *[F.max(F.when(F.col("i") == i, F.col(s))).cast("double").alias(f"__x{i}_{s}") for i, _ in labels for s in "abc"]
            )
        )
    wide = parts[0]
    for p in parts[1:]:
        wide = attach(wide, p, keys)
    vector = F.array(*[F.col(f"__x{i}_{s}") for s in "abc" for i in range(len(meta))])
    return wide.select(*keys, vector.alias("features"))


def naive_array(df: DataFrame, vector: str, keys: Sequence[str] = ()) -> DataFrame:
    """Mean, median and population variance over all numbers of all rows of a numeric matrix (NaN and null ignored)."""
    cells = df.select(*keys, F.explode(F.col(vector).cast("array<double>")).alias("x"))
    cells = cells.where(F.col("x").isNotNull() & ~F.isnan("x"))
    sums = cells.groupBy(*keys).agg(F.avg("x").alias("mean"), F.var_pop("x").alias("variance"))
    mid = quantiles(cells, ["x"], 0.5, keys).withColumnRenamed("x", "median")
    return attach(sums, mid, keys).select(*keys, F.array("mean", "median", "variance").alias("features"))


def histogram_names(meta: TableMeta, nbins: int = 10) -> list[str]:
    out = []
    for c in meta.numeric:
        e = c.edges(nbins) if c.kind == "Float" else [c.low + i * (c.high - c.low) / nbins for i in range(nbins + 1)]
        out += [f"{c.name}({int(lo)},{int(hi)}]" for lo, hi in zip(e, e[1:])]
    return out + [f"{c.name}_{lab}" for c in meta.discrete for lab in c.labels]


def histogram(df: DataFrame, meta: TableMeta, keys: Sequence[str] = (), nbins: int = 10, order: str = "bin") -> DataFrame:
    """Counts per equal-width bin of numbers (right-closed, lowest edge included) and per label, numbers first.

    ``order="count"`` sorts the counts of each number column in descending order, as value counting would.
    """
    keys = list(keys)
    meta.check(df.columns)
    cells, at, numeric_blocks = [], 0, []
    for c in meta.numeric:
        cells.append(F.lit(at) + right_closed_bin(F.col(f"`{c.name}`"), c, nbins))
        numeric_blocks.append((at, nbins))
        at += nbins
    for c in meta.discrete:
        code = label_code(F.col(f"`{c.name}`"), c.labels, append_null=False).cast("int")
        code = code if NULL_LABEL in c.labels else F.when(F.col(f"`{c.name}`").isNotNull(), code)
        cells.append(F.when(code >= 0, F.lit(at) + code))
        at += len(c.labels)
    # Cells that fall outside are kept as -1 so that a table without any usable value still gets its zero vector.
    coded = F.array(*[F.coalesce(x, F.lit(-1)) for x in cells])
    counts = df.select(*keys, F.explode(coded).alias("f")).groupBy(*keys, "f").agg(F.count("*").alias("n"))
    packed = counts.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("f", "n"))).alias("m"))
    vector = F.transform(
        F.sequence(F.lit(0), F.lit(at - 1)), lambda f: F.coalesce(F.try_element_at("m", f), F.lit(0)).cast("double")
    )
    if order == "count" and numeric_blocks:
        packed = packed.withColumn("v", vector)
        blocks = [F.sort_array(F.slice("v", s + 1, n), asc=False) for s, n in numeric_blocks]
        tail = F.slice("v", len(numeric_blocks) * nbins + 1, at)
        return packed.select(*keys, F.flatten(F.array(*blocks, tail)).alias("features"))
    return packed.select(*keys, vector.alias("features"))


def _dummies(meta: TableMeta) -> list[tuple]:
    return [(c, lab) for c in meta.discrete for lab in c.labels[1:]]


def indicator_columns(df: DataFrame, meta: TableMeta, keep: Sequence[str] = ()) -> DataFrame:
    """Numbers and label indicators of each row side by side, first label of every column left out."""
    meta.check(df.columns)
    numbers = [F.col(f"`{c.name}`").cast("double").alias(c.name) for c in meta.numeric]
    marks = [
        F.when(F.col(f"`{c.name}`") == lab, 1.0).otherwise(0.0).alias(f"{c.name}_{lab}") for c, lab in _dummies(meta)
    ]
    return df.select(*keep, *numbers, *marks)


def correlation_names(meta: TableMeta) -> list[str]:
    cols = [c.name for c in meta.numeric] + [f"{c.name}_{lab}" for c, lab in _dummies(meta)]
    return [f"{a}~{b}" for a, b in combinations(cols, 2)]


def _number_sums(flat: DataFrame, n_num: int, width: int, keys: list[str]) -> DataFrame:
    """Sums of products of all pairs of numbers (``p = i * width + j``), over rows that have both."""
    slots = [(i, j) for i in range(n_num) for j in range(i, n_num)]
    pairs = F.array(
        *[F.struct(F.lit(i * width + j).alias("p"), F.col(f"x{i}").alias("x"), F.col(f"x{j}").alias("y")) for i, j in slots]
    )
    rows = flat.select(*keys, F.explode(pairs).alias("e")).select(*keys, "e.*").where("x is not null and y is not null")
    return rows.groupBy(*keys, "p").agg(
        F.count("*").alias("n"), F.sum("x").alias("sx"), F.sum("y").alias("sy"),
        F.sum(F.col("x") * F.col("y")).alias("sxy"), F.sum(F.col("x") * F.col("x")).alias("sxx"), F.sum(F.col("y") * F.col("y")).alias("syy"),
        (F.max("x") > F.min("x")).alias("vx"), (F.max("y") > F.min("y")).alias("vy"),
    )


def _label_sums(flat: DataFrame, n_num: int, start: list[int], width: int, combos: int, keys: list[str]) -> DataFrame:
    """Sums of products that involve an indicator, and the number of rows under ``p = -1``.

    When the metadata bounds the combinations of labels, rows are first reduced to one per combination (how often it
    occurs, and the count and sum of each number in it) and pairs are formed from those. Code 0 is the label left out.
    """
    labels = [f"c{k}" for k in range(len(start))]
    if combos <= COMPACT_CELLS:
        rows = flat.groupBy(*keys, *labels).agg(
            F.count("*").alias("w"), *[f(f"x{i}").alias(f"{n}{i}") for i in range(n_num) for n, f in (("k", F.count), ("s", F.sum))]
        )
    else:
        one = [F.col(f"x{i}").isNotNull().cast("bigint").alias(f"k{i}") for i in range(n_num)]
        rows = flat.select(*keys, *labels, F.lit(1).cast("bigint").alias("w"), *one, *[F.col(f"x{i}").alias(f"s{i}") for i in range(n_num)])

    def entry(p: Column, n: Column, sx: Column) -> Column:
        return F.struct(p.cast("int").alias("p"), n.alias("n"), sx.alias("sx"))

    zero = F.lit(0.0)
    entries = [entry(F.lit(-1), F.col("w"), zero)]
    for k, at in enumerate(start):
        mine = F.col(f"c{k}") + at
        here = F.col(f"c{k}") > 0
        entries.append(F.when(here, entry(mine * width + mine, F.col("w"), zero)))
        for m in range(k + 1, len(start)):
            there = F.col(f"c{m}") > 0
            entries.append(F.when(here & there, entry(mine * width + F.col(f"c{m}") + start[m], F.col("w"), zero)))
        for i in range(n_num):
            entries.append(F.when(here, entry(F.lit(i * width) + mine, F.col(f"k{i}"), F.coalesce(f"s{i}", zero))))
    long = rows.select(*keys, F.explode(F.array(*entries)).alias("e")).where("e is not null").select(*keys, "e.*")
    out = long.groupBy(*keys, "p").agg(F.sum("n").alias("n"), F.sum("sx").alias("sx"))
    # With an indicator for y (and a number for x): sum of y, of y² and the count of rows with y = 1 are the same.
    between = (F.col("p") >= 0) & (F.col("p") < n_num * width)
    count = F.col("n").cast("double")
    return out.select(
        *keys, "p", "n", F.when(between, F.col("sx")).otherwise(count).alias("sx"), count.alias("sy"),
        F.when(between, F.col("sx")).otherwise(count).alias("sxy"), count.alias("sxx"), count.alias("syy"),
        F.lit(True).alias("vx"), F.lit(True).alias("vy"),
    )


def correlations(df: DataFrame, meta: TableMeta, keys: Sequence[str] = ()) -> DataFrame:
    """Pearson correlations of numbers and label indicators (first label left out), strict upper triangle by rows.

    Undefined correlations are 0. A row has one non-zero indicator per label column at most, so only products of
    non-zero cells are summed; every other product is zero and is never formed. Numbers are shifted by the middle of
    their range to keep the sums small. Nulls are left out pair by pair.
    """
    keys = list(keys)
    meta.check(df.columns)
    n_num = len(meta.numeric)
    width = n_num + len(_dummies(meta))
    numbers = [F.col(f"`{c.name}`").cast("double") - F.lit((c.low + c.high) / 2) for c in meta.numeric]
    codes, start, at, combos = [], [], n_num, 1
    for c in meta.discrete:
        code = label_code(F.col(f"`{c.name}`"), c.labels, append_null=False).cast("int")
        codes.append(F.greatest(code, F.lit(0)))
        start.append(at - 1)
        at += len(c.labels) - 1
        combos *= len(c.labels)
    flat = df.select(*keys, *[x.alias(f"x{i}") for i, x in enumerate(numbers)], *[x.alias(f"c{i}") for i, x in enumerate(codes)])
    sums = _label_sums(flat, n_num, start, width, combos, keys)
    if n_num:
        sums = sums.unionByName(_number_sums(flat, n_num, width, keys))
    entry = F.struct("p", F.struct("n", "sx", "sy", "sxy", "sxx", "syy", "vx", "vy"))
    diagonal = (F.col("p") < 0) | (F.col("p") % (width + 1) == 0)
    packed = sums.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.when(diagonal, entry))).alias("own"),
        F.map_from_entries(F.collect_list(F.when(~diagonal, entry))).alias("pair"),
    )
    packed = packed.withColumn("rows", F.element_at("own", -1)["n"])
    zero = F.lit(0.0)

    def pearson(i: Column, j: Column, s: Column) -> Column:
        numeric_i, numeric_j, both = i < n_num, j < n_num, s["both"]
        n = F.when(numeric_j, both["n"]).when(numeric_i, s["i"]["n"]).otherwise(F.col("rows")).cast("double")
        sxy = F.coalesce(both["sxy"], zero)
        sx = F.when(numeric_j, both["sx"]).otherwise(F.coalesce(s["i"]["sx"], zero))
        sxx = F.when(numeric_j, both["sxx"]).otherwise(F.coalesce(s["i"]["sxx"], zero))
        # An indicator next to a number is summed over the rows that have the number.
        sy = F.when(numeric_i, F.coalesce(both["sy"], zero)).otherwise(F.coalesce(s["j"]["sy"], zero))
        syy = F.when(numeric_i, F.coalesce(both["syy"], zero)).otherwise(F.coalesce(s["j"]["syy"], zero))
        varies_i = F.when(numeric_j, both["vx"]).when(numeric_i, s["i"]["vx"]).otherwise((sx > 0) & (sx < n))
        varies_j = F.when(numeric_j, both["vy"]).otherwise((sy > 0) & (sy < n))
        vx, vy = n * sxx - sx * sx, n * syy - sy * sy
        defined = varies_i & varies_j & (vx > 0) & (vy > 0)
        return F.coalesce(F.when(defined, (n * sxy - sx * sy) / (F.sqrt(vx) * F.sqrt(vy))), zero)

    def r(i: Column, j: Column) -> Column:
        sums_of = F.struct(
            F.try_element_at("own", i * width + i).alias("i"),
            F.try_element_at("own", j * width + j).alias("j"),
            F.try_element_at("pair", i * width + j).alias("both"),
        )
        return once(sums_of, lambda s: pearson(i, j, s))

    rows = F.transform(
        F.sequence(F.lit(0), F.lit(width - 2)),
        lambda i: F.transform(F.sequence(i + 1, F.lit(width - 1)), lambda j: r(i, j)),
    )
    return packed.select(*keys, F.flatten(rows).alias("features"))


def combine(parts: Sequence[DataFrame], keys: Sequence[str] = ()) -> DataFrame:
    """Feature vectors of several sets, one after the other."""
    wide = parts[0].withColumnRenamed("features", "f0")
    for i, p in enumerate(parts[1:], 1):
        wide = attach(wide, p.withColumnRenamed("features", f"f{i}"), keys)
    return wide.select(*keys, F.concat(*[F.col(f"f{i}") for i in range(len(parts))]).alias("features"))


def bayes(df: DataFrame, meta: TableMeta, keys: Sequence[str] = (), nbins: int = 10) -> DataFrame:
    return combine([histogram(df, meta, keys, nbins), correlations(df, meta, keys)], keys)


def ensemble(df: DataFrame, meta: TableMeta, keys: Sequence[str] = (), nbins: int = 10) -> DataFrame:
    return combine([naive(df, meta, keys), histogram(df, meta, keys, nbins), correlations(df, meta, keys)], keys)


FEATURE_SETS = {"Naive": naive, "Histogram": histogram, "Correlations": correlations, "Bayes": bayes, "Ensemble": ensemble}
