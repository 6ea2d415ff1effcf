"""Exact-size sampling without replacement and the membership of sampled tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.functions.keyed import digest, once
from veilgauge.meta import TableMeta
from veilgauge.operators.counts import label_counts
from veilgauge.operators.joining import attach, durable

OUT = "OUT"


ROUNDS, WALKS = 4, 128
SHORT_WALK = 4


def numbered(ids: DataFrame, id_col: str = "id") -> tuple[DataFrame, int]:
    """``__pos, id`` with positions 0, 1, … in the order of the ids, and how many there are. Ids are sorted by range; only the counts of the ranges are collected."""
    ranged = ids.select(id_col).repartitionByRange(id_col).sortWithinPartitions(id_col)
    ranged = durable(ranged.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1))}))
    before, offsets = 0, []
    for part, n in sorted(map(tuple, ranged.groupBy("__part").count().collect())):
        offsets.append((part, before))
        before += n
    starts = ids.sparkSession.createDataFrame(offsets, "__part int, __before bigint")
    placed = ranged.join(F.broadcast(starts), "__part")
    return placed.select((F.col("__before") + F.col("__at")).alias("__pos"), id_col), before


def _half(total: int) -> int:
    return max(1, -(-max(total - 1, 1).bit_length() // 2))


def _round(half: int, seed: int, tag: str, parts: Sequence[Column | str], i: Column, right: Column) -> Column:
    """What one round adds to the left half: the last bits of the first 12 digits of a digest."""
    figures = -(-half // 4)
    return F.conv(F.substring(digest(seed, tag, *parts, i, right), 13 - figures, figures), 16, 10).cast("bigint").bitwiseAND(F.lit(2**half - 1).cast("bigint"))


def _turn(value: Column, half: int, seed: int, tag: str, parts: Sequence[Column | str]) -> Column:
    start = F.struct(F.shiftright(value, half).alias("l"), value.bitwiseAND(F.lit(2**half - 1).cast("bigint")).alias("r"))

    def step(s: Column, i: Column) -> Column:
        return F.struct(s["r"].alias("l"), s["l"].bitwiseXOR(_round(half, seed, tag, parts, i, s["r"])).alias("r"))

    end = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)
    return once(end, lambda e: F.shiftleft(e["l"], half).bitwiseOR(e["r"]))


def _settled(value: Column, total: int, turn: Callable[[Column], Column]) -> Column:
    """``value`` if it is below ``total``, else what comes of further turns: a few, and for what is still above as many as it takes."""

    def walk(start: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda v, _: F.when(v < total, v).otherwise(turn(v)))

    def below(v: Column, other: Callable[[Column], Column]) -> Column:
        return F.when(v < total, v).otherwise(other(v))

    return once(value, lambda v: below(v, lambda x: once(walk(x, SHORT_WALK), lambda w: below(w, lambda y: walk(y, WALKS - SHORT_WALK)))))


def shuffled(position: Column, total: int, seed: int, tag: str, *parts: Column | str) -> Column:
    """Where a keyed permutation of ``0 … total - 1`` sends a position: a Feistel network over the next power of four, applied again until the value is
    below ``total`` (which fails after ``WALKS`` times with a chance of under 1e-15)."""
    half = _half(total)

    def turn(value: Column) -> Column:
        return _turn(value, half, seed, tag, parts)

    return _settled(turn(position.cast("bigint")), total, turn)


def permuted(rows: DataFrame, position: str, total: int, seed: int, tag: str, *parts: str) -> DataFrame:
    """``rows`` with a column of positions sent through :func:`shuffled`. The first turn is made of projections, which Spark compiles;
    functions of arrays, which it does not, only see the values above ``total``."""
    half, rest = _half(total), [c for c in rows.columns if c != position]
    mask = F.lit(2**half - 1).cast("bigint")
    at = F.col(position).cast("bigint")
    rows = rows.select(*rest, F.shiftright(at, half).alias("__l"), at.bitwiseAND(mask).alias("__r"))
    for i in range(ROUNDS):
        rows = rows.select(*rest, F.col("__r").alias("__l"), F.col("__l").bitwiseXOR(_round(half, seed, tag, parts, F.lit(i), F.col("__r"))).alias("__r"))
    value = F.shiftleft("__l", half).bitwiseOR(F.col("__r"))
    return rows.select(*rest, _settled(value, total, lambda v: _turn(v, half, seed, tag, parts)).alias(position))


def draw(df: DataFrame, n: int, seed: int, draws: int = 1, id_col: str = "id", tag: str = "draw") -> DataFrame:
    """``n`` whole rows per draw, without replacement, with a ``draw`` column; ids are unique and not null.

    Rows are numbered in the order of their ids. A draw is the image of ``0 … n - 1`` under a permutation of these numbers keyed by the draw, so the wanted positions are
    computed instead of ranked: ``n * draws`` of them are joined with the numbered ids and these with the rows, whatever the size of the population.
    Fewer than ``n`` rows are an error.
    """
    ids, total = numbered(df, id_col)
    if n > total:
        raise ValueError(f"{n} rows cannot be drawn without replacement: there are {total}")
    if not n:
        return df.where("false").withColumn("draw", F.lit(0))
    wanted = df.sparkSession.range(n * draws).select(F.floor(F.col("id") / n).cast("int").alias("draw"), F.pmod("id", F.lit(n)).alias("__i"))
    wanted = permuted(wanted.withColumnRenamed("__i", "__pos"), "__pos", total, seed, tag, "draw")
    chosen = durable(ids.join(wanted, "__pos").select(F.col(id_col).alias("__id"), "draw"))
    return attach(df.withColumn("__id", F.col(id_col)), chosen, ["__id"], "inner", n * draws).select(*df.columns, "draw")


def without(df: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    """Population with a list of targets removed."""
    gone = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], df.select(id_col).schema)
    return df.join(F.broadcast(gone), id_col, "left_anti")


def only(df: DataFrame, ids: Sequence, id_col: str = "id") -> DataFrame:
    """The listed records; an id listed twice counts once."""
    wanted = df.sparkSession.createDataFrame([(i,) for i in dict.fromkeys(ids)], df.select(id_col).schema)
    return df.join(F.broadcast(wanted), id_col, "left_semi")


def pick_targets(df: DataFrame, n_random: int, listed: Sequence = (), seed: int = 42, id_col: str = "id") -> list:
    """Ids of the targets of a game: random ones first, then listed ones, without repeats."""
    drawn = []
    if n_random:
        drawn = [r[0] for r in draw(df, n_random, seed, tag="targets", id_col=id_col).select(id_col).orderBy(id_col).collect()]
    return list(dict.fromkeys([*drawn, *listed]))


def with_targets(drawn: DataFrame, targets: DataFrame, ids: Sequence, draws: int = 1, id_col: str = "id") -> DataFrame:
    """Every one of ``draws`` drawn tables once without any target and once per target with that record added.

    Adds ``target`` (``OUT`` or the target's id), ``dataset_id`` and ``label``. A table is the same set of rows in all
    its variants but for the one inserted record.
    """
    names = F.array(*[F.lit(t) for t in [OUT, *[str(i) for i in ids]]])
    base = drawn.withColumn("target", F.explode(names))
    extra = targets.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    extra = extra.withColumn("target", F.col(id_col).cast("string")).select(*base.columns)
    both = base.unionByName(extra)
    return both.withColumn("dataset_id", F.concat_ws(":", F.col("draw").cast("string"), "target")).withColumn(
        "label", (F.col("target") != OUT).cast("int")
    )


def new_categories(df: DataFrame, meta: TableMeta) -> DataFrame:
    """Labels found in a table that its metadata does not list: ``(attr, label)``."""
    found = label_counts(df, [c.name for c in meta.discrete]).where(F.col("label").isNotNull())
    known = df.sparkSession.createDataFrame([(c.name, lab) for c in meta.discrete for lab in c.labels], "attr string, label string")
    return found.join(F.broadcast(known), ["attr", "label"], "left_anti").select("attr", "label")
