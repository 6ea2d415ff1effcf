"""Sharding by a k-d tree: recursive weighted medians along the widest metadata dimension.

Equal texts are one atom, so copies meet in one shard. Atoms are points of three dimensions: the size, the first document's id, and its
source. A node of the tree splits the dimension in which its atoms spread widest, at the value that divides their bytes as its
shards' targets ask for. That value is found by summing bytes over ranges of a 48-bit coordinate, each time refining the range that holds
the median, so the driver only sees a few thousand sums for a level and atoms are never gathered.

Atoms of more than 1/64 of a shard (at most 64 for each shard) could not be divided by a median without unbalancing
its sides. They are placed first, largest first into the emptiest shard, and the tree fills up what is left of each shard's target. Only a text whose copies
are more than a whole shard is spread over several.
"""

from __future__ import annotations

import heapq
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.llm.common import discard, staged

SHARDS = 16
HEAVY = 64
COORD_BITS = 24
KEY_BITS = 2 * COORD_BITS
SLOT_ROWS = 16384
DIMS = ("size", "doc", "source")


def _place_heavy(heavy: list[tuple], shards: int, target: float) -> tuple[list[tuple], list[float]]:
    """Rows ``(key, crc, size, part, parts, shard)`` for heavy groups ``(key, crc, size, bytes)``, and the bytes left for each shard."""
    atoms = []
    for key, crc, size, total in heavy:
        parts = 1 if total <= target else math.ceil(8 * total / target)
        atoms += [(total / parts, key, crc, size, i, parts) for i in range(parts)]
    load = [(0.0, s) for s in range(shards)]
    rows = []
    for weight, key, crc, size, i, parts in sorted(atoms, key=lambda a: (-a[0], *a[1:])):
        used, shard = heapq.heappop(load)
        rows.append((key, crc, size, i, parts, shard))
        heapq.heappush(load, (used + weight, shard))
    room = [0.0] * shards
    for used, shard in load:
        room[shard] = max(target - used, 0.0)
    return rows, room


def _split_points(atoms: DataFrame, nodes: dict[int, tuple[int, float]], key, bits: int) -> dict[int, int]:
    """For each node ``(dimension, bytes wanted on the left)``: the smallest key of the right side."""
    low, base = dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0.0)
    for shift in range(KEY_BITS - bits, -1, -bits):
        table = F.create_map(*[F.lit(x) for n, v in low.items() for x in (n, v)])
        inside = atoms.filter(F.shiftright(key, shift + bits) == F.element_at(table, F.col("node")))
        sums = inside.groupBy("node", F.shiftright(key, shift).alias("r")).agg(F.sum("weight").alias("w")).collect()
        by_node: dict[int, list] = {n: [] for n in nodes}
        for node, r, w in sums:
            by_node[node].append((r, w))
        for node, ranges in by_node.items():
            want = nodes[node][1]
            place = low[node] << bits
            for r, w in sorted(ranges):
                place = r
                if base[node] + w > want:
                    break
                base[node] += w
            else:
                place += 1  # everything lies on the left
            low[node] = place
    return low


def shard_atoms(atoms: DataFrame, room: list[float]) -> DataFrame:
    """Adds ``shard`` to light atoms ``weight, tie, c_size, c_doc, c_source`` (coordinates of ``COORD_BITS``)."""
    spans = {0: (0, len(room))}
    atoms = staged(atoms.withColumn("node", F.lit(0)))
    while any(b - a > 1 for a, b in spans.values()):
        split = {n: s for n, s in spans.items() if s[1] - s[0] > 1}
        stats = {
            r[0]: r
            for r in atoms.groupBy("node").agg(
                F.sum("weight").alias("w"), *[(F.max(f"c_{d}") - F.min(f"c_{d}")).alias(d) for d in DIMS]
            ).collect()
        }
        plan: dict[int, tuple[int, float]] = {}
        middle = {}
        for node, (a, b) in split.items():
            middle[node] = (a + b) // 2
            left, total = sum(room[a : middle[node]]), sum(room[a:b])
            row = stats.get(node)
            widest = 0 if row is None else max(range(len(DIMS)), key=lambda i: (row[2 + i], -i))
            weight = 0 if row is None else row[1]
            share = left / total if total else (middle[node] - a) / (b - a)
            plan[node] = (widest, weight * share)
        number = F.create_map(*[F.lit(x) for n, (d, _) in plan.items() for x in (n, d)])
        coord = F.element_at(F.array(*[F.col(f"c_{d}") for d in DIMS]), F.element_at(number, F.col("node")) + 1)
        keyed = atoms.withColumn("k", F.shiftleft(coord, COORD_BITS) + F.col("tie"))
        points = _split_points(keyed.filter(F.col("node").isin(list(plan))), plan, F.col("k"), 12 if len(plan) <= 16 else 8)
        table = F.create_map(*[F.lit(x) for n, v in points.items() for x in (n, v)])
        right = (F.col("k") >= F.element_at(table, F.col("node"))).cast("int")
        moved = F.when(F.col("node").isin(list(plan)), 2 * F.col("node") + right).otherwise(2 * F.col("node"))
        before, atoms = atoms, staged(keyed.withColumn("node", moved).drop("k"))
        discard(before)
        spans = {
            child: span
            for n, (a, b) in spans.items()
            for child, span in ([(2 * n, (a, middle[n])), (2 * n + 1, (middle[n], b))] if n in split else [(2 * n, (a, b))])
        }
    table = F.create_map(*[F.lit(x) for n, (a, _) in spans.items() for x in (n, a)])
    return atoms.withColumn("shard", F.element_at(table, F.col("node"))).drop("node")


def _scaled(column: str, lo: float | None, hi: float | None):
    if lo is None or hi is None or hi <= lo:
        return F.lit(0).cast("long")
    part = (F.col(column).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))
    return F.least(F.floor(part * F.lit(float(2**COORD_BITS))), F.lit(2**COORD_BITS - 1)).cast("long")


def assign_shards(docs: DataFrame, shards: int = SHARDS, target_bytes: int | None = None) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for each row of ``docs``; ``target_bytes`` sets the number of shards instead.

    ``size`` is the text's UTF-8 bytes plus one. Shards have nearly equal bytes; rows of equal texts are in one shard, unless they are more
    than a shard. ``slot`` numbers a shard's rows from 0 without gaps, in an order that depends on the rows only.

    Null and empty texts are one group of size 1. Null ids and sources lie below all others. Rows given twice are rows of their own with their own
    slots. Other columns are not read. No rows in, no rows out.
    """
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")
    text = F.coalesce("text", F.lit(""))
    source = F.when(F.col("source").isNull(), F.lit(-1.0)).otherwise(F.shiftrightunsigned(F.xxhash64("source"), 11).cast("double"))
    rows = staged(
        docs.select(
            "doc_id", size.alias("size"), F.crc32(text).alias("crc"), F.xxhash64(text).alias("key"), source.alias("source"),
            F.xxhash64("doc_id", text).alias("h"),
        )
    )
    group = ["key", "crc", "size"]
    groups = staged(
        rows.groupBy(*group).agg(F.sum("size").alias("weight"), F.min("doc_id").alias("doc"), F.min_by("source", "doc_id").alias("source"), F.count("*").alias("n"))
    )
    ends = groups.agg(
        F.sum("weight"), F.sum("n"), *[f(d) for d in ("size", "doc", "source") for f in (F.min, F.max)]
    ).first()
    total, n_rows = ends[0] or 0, ends[1] or 0
    if target_bytes is not None:
        shards = max(1, math.ceil(total / target_bytes))
    target = total / shards
    # Groups of more than target / HEAVY bytes: fewer than HEAVY * shards.
    heavy = [tuple(r) for r in groups.filter(F.col("weight") * HEAVY > F.lit(target)).select(*group, "weight").collect()] if total else []
    placed, room = _place_heavy(heavy, shards, target)
    schema = "key long, crc long, size long, part int, parts int, shard int"
    big = F.broadcast(docs.sparkSession.createDataFrame(placed, schema))
    light = groups.filter(F.col("weight") * HEAVY <= F.lit(target))
    coords = [_scaled(d, ends[2 + 2 * i], ends[3 + 2 * i]).alias(f"c_{d}") for i, d in enumerate(DIMS)]
    tie = F.shiftrightunsigned(F.xxhash64("key", F.lit(7)), 64 - COORD_BITS)
    atoms = light.select(*group, "weight", tie.alias("tie"), *[F.coalesce(c, F.lit(0).cast("long")).alias(f"c_{d}") for c, d in zip(coords, DIMS)])
    where = shard_atoms(atoms, room).select(*group, "shard")
    names = big.select("key", "crc", "size").distinct()
    small_rows = rows.join(names, group, "left_anti").join(where, group)
    split = big.withColumnRenamed("part", "__part")
    big_rows = rows.join(split, group).filter(F.pmod("h", F.col("parts")) == F.col("__part"))
    columns = ["doc_id", "size", "crc", "h", "shard"]
    found = small_rows.select(*columns).unionByName(big_rows.select(*columns))
    return _numbered(found, max(16, math.ceil(n_rows / (shards * SLOT_ROWS))))


def _numbered(rows: DataFrame, buckets: int) -> DataFrame:
    """Slots from 0 in each shard: ranks in small buckets of a hash, plus the counts of the buckets before."""
    rows = staged(rows.withColumn("bucket", F.pmod("h", F.lit(buckets)).cast("int")))
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    rank = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("h", "doc_id", "crc")) - 1
    numbered = rows.withColumn("rank", rank).join(starts, ["shard", "bucket"])
    return numbered.select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"))
