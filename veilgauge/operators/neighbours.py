"""Exact k nearest neighbours: rings around pivots, ruled out by the triangle inequality before vectors are sent to them.

Training rows belong to their nearest pivot and, within a large cell, to a ring of distances from it. A first search of a test row's nearest ring gives a
bound on its ``k``-th distance; then the row is compared only with rings that can hold something as near.

Vectors travel in packs, not by the row: rings that lie near each other share a shelf, test rows that lie near each other a deck, each a row of bounded bytes.
A deck meets a shelf as a whole if a ring on it is wanted by one of its rows; there each row is compared with the strips that it wants. So what is sent grows
with the number of decks and shelves that meet, not with that of rows and rings, and where nearly all meet, the packs are read from where they were written.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.operators.joining import BROADCAST_BYTES, attach, durable

TEST_BLOCK, TRAIN_BLOCK = 512, 8192
CELL_ROWS, MAX_PIVOTS, PIVOT_BYTES = 1024, 2048, 16 * 2**20
RINGS = 64
SLICE_CELLS = 2**21
SENT_BYTES = 8 * 2**20  # vectors sent to rings in one batch
PACK_ROWS, PACK_BYTES = 4 * TRAIN_BLOCK, 16 * 2**20  # most rows and bytes of vectors in a deck or a shelf
FIRST_STRIP, STRIP = 512, 4096  # training rows in one matrix product
COARSE = 0.02  # share of a strip that single precision may leave before double precision is taken
FEW_TASKS, SPARSE = 256, 4  # packs are sent to each other when they are many and less than a fourth of the pairs meet
SLACK = 1e-9  # share of a distance by which bounds are widened against rounding


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype("float64")


def _to_pivots(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1)[None, :] - 2 * (x @ pivots.T)
    return np.sqrt(np.maximum(square, 0))


def _in_order(pivots: np.ndarray) -> np.ndarray:
    """Pivots so that those near each other have near numbers: halved along the widest dimension."""

    def halves(at: np.ndarray) -> list[np.ndarray]:
        if len(at) <= 2 or not pivots.shape[1]:
            return [at]
        at = at[np.argsort(pivots[at, np.ptp(pivots[at], axis=0).argmax()], kind="stable")]
        return halves(at[: len(at) // 2]) + halves(at[len(at) // 2 :])

    return pivots[np.concatenate(halves(np.arange(len(pivots))))]


def _place(pivots: np.ndarray):
    """Rows with their nearest pivot and the distance to it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            if len(rows):
                x = _matrix(rows["features"])
                step = max(1, SLICE_CELLS // len(pivots))
                near = np.concatenate([_to_pivots(x[i : i + step], pivots).argmin(axis=1) for i in range(0, len(x), step)])
                yield rows.assign(__p=near.astype("int32"), __d=np.sqrt(((x - pivots[near]) ** 2).sum(axis=1)))

    return run


@dataclass(frozen=True)
class Rings:
    """Numbered rings: pivot, least and greatest distance of their rows from it, and how many there are. There are at most ``MAX_PIVOTS * RINGS``."""

    pivots: np.ndarray
    at: np.ndarray
    low: np.ndarray
    high: np.ndarray
    rows: np.ndarray

    def only(self, some: np.ndarray) -> Rings:
        used, at = np.unique(self.at[some], return_inverse=True)
        return Rings(self.pivots[used], at, self.low[some], self.high[some], self.rows[some])

    def home(self, dist: np.ndarray, k: int) -> np.ndarray:
        """The rings around the nearest pivot, and of these the nearest first, that together hold ``k`` rows, by row: rows near each other share them."""
        far = dist + np.maximum(np.maximum(dist - self.high, self.low - dist), 0)
        order = np.argsort(far, axis=1, kind="stable")
        before = np.cumsum(self.rows[order], axis=1) - self.rows[order]
        out = np.zeros(far.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out

    def least(self, dist: np.ndarray, x: np.ndarray) -> np.ndarray:
        """A bound below the distance to every row of a ring, lowered by what rounding can do to distances taken from products."""
        size = np.sqrt((x**2).sum(axis=1)) + np.sqrt((self.pivots**2).sum(axis=1).max(initial=0.0))
        rounding = np.sqrt(8 * np.finfo(float).eps * (x.shape[1] + 4)) * size
        return np.maximum(dist - self.high, self.low - dist) - SLACK * (dist + self.high) - rounding[:, None]

    def wanted(self, x: np.ndarray, k: int, tau: np.ndarray | None = None) -> np.ndarray:
        """The rings to search, by row: those at home or, where the squared distance ``tau`` is known, all that it does not rule out."""
        dist = _to_pivots(x, self.pivots)[:, self.at]
        return self.home(dist, k) if tau is None else self.least(dist, x) <= np.sqrt(tau)[:, None]

    def slices(self, n: int) -> Iterator[slice]:
        step = max(1, SLICE_CELLS // max(len(self.at), len(self.pivots)))
        return (slice(i, min(i + step, n)) for i in range(0, n, step))


def _choose(rings: Rings, k: int, first: bool):
    """Test rows with the numbers of the rings to search: those at home at first, then all that the distance ``__tau`` does not rule out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for part in rings.slices(len(batch)):
                rows = batch.iloc[part]
                x = _matrix(rows["features"])
                row, ring = np.nonzero(rings.wanted(x, k, None if first else rows["__tau"].to_numpy()))
                rows = rows.drop(columns=["features"] if first else ["features", "__tau"])
                # Where little is ruled out a row goes to nearly all rings, so what is sent can be far larger than what came.
                some = max(1, SENT_BYTES // (8 * (x.shape[1] + 4)))
                for j in range(0, len(row), some):
                    yield rows.iloc[row[j : j + some]].assign(__ring=ring[j : j + some].astype("int32"))

    return run


def _pack(by: str, order: str, kept: dict[str, str], vectors_as: str):
    """The rows of a partition, all of one number ``by``, as one row: arrays of ``kept`` (names after and before) and the bytes of the vectors, in the order of
    ``order``, so that rows near each other are compared together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = [batch for batch in batches if batch.num_rows]
        if batches:
            rows = pa.Table.from_batches(batches).sort_by(order)
            vectors = rows.column("features").combine_chunks()
            if len(set(np.diff(vectors.offsets.to_numpy()))) > 1:
                raise ValueError("vectors are of different lengths")
            whole = [pa.ListArray.from_arrays([0, len(rows)], rows.column(c).combine_chunks()) for c in kept.values()]
            x = vectors.flatten().to_numpy(zero_copy_only=False).astype("float64")
            with np.errstate(over="ignore"):
                short = x.astype("float32")
            x = short if (short == x).all() else x  # half the bytes where that loses nothing
            yield pa.RecordBatch.from_arrays([rows.column(by).combine_chunks()[:1], *whole, pa.array([x.tobytes()], pa.binary())], [by, *kept, vectors_as])

    return run


def _unpack(x: pa.Scalar, rows: int, width: int) -> np.ndarray:
    kind = "float32" if len(x.as_buffer()) == 4 * rows * width else "float64"
    return np.frombuffer(x.as_buffer(), kind).reshape(rows, width).astype("float64")


def _bounds(batch: pa.RecordBatch, i: int, rows: int) -> np.ndarray:
    """The squared distance within which each row of a deck looks; without a bound where less than ``k`` rows were found at home."""
    tau = np.full(rows, np.inf)
    if "__tau" in batch.schema.names and batch.column("__tau")[i].is_valid:
        tau[batch.column("__row")[i].values.to_numpy()] = batch.column("__tau")[i].values.to_numpy()
    return tau


def _meets(rings: Rings, k: int, first: bool, low: np.ndarray, high: np.ndarray):
    """The shelves that decks meet; those that hold a ring are numbered from ``low`` to ``high``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(len(batch)):
                n = len(batch.column("ids")[i].values)
                x, tau, hit = _unpack(batch.column("x")[i], n, rings.pivots.shape[1]), _bounds(batch, i, n), np.zeros(len(rings.at), bool)
                for part in rings.slices(n):
                    hit |= rings.wanted(x[part], k, None if first else tau[part]).any(axis=0)
                found.append(sorted({s for ring in np.flatnonzero(hit) for s in range(low[ring], high[ring] + 1)}))
            yield pa.RecordBatch.from_arrays([batch.column("__deck"), pa.array(found, pa.list_(pa.int32()))], ["__deck", "__shelves"])

    return run


def _same(ids: pa.Array, near: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of ids that are equal if the ids are; a null equals nothing."""
    codes = pa.concat_arrays([ids, near]).dictionary_encode().indices
    own, other = codes[: len(ids)], codes[len(ids) :]
    return own.fill_null(-1).to_numpy(zero_copy_only=False), other.fill_null(-2).to_numpy(zero_copy_only=False)


def _merge(k: int, bound: np.ndarray, rank: np.ndarray, row: np.ndarray, pos: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` nearest by row; the ``k``-th lowers ``bound``."""
    order = np.lexsort((rank[pos], dist, row))
    row, pos, dist = row[order], pos[order], dist[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    last = place == k - 1
    bound[row[last]] = np.minimum(bound[row[last]], dist[last])
    keep = place < k
    return row[keep], pos[keep], dist[keep]


def _best(k: int, x: np.ndarray, tau: np.ndarray, wanted, points: np.ndarray, ring: np.ndarray, rank: np.ndarray, same: tuple[np.ndarray, np.ndarray] | None, strip: int):
    """For blocks of rows of ``x`` the rows, positions and squared distances of the ``k`` nearest ``points`` (lower ``rank`` on ties) that are no farther than
    ``tau``. Products of centred vectors find those that can be among them, in single precision where its rounding is small beside the bounds; their distances
    are then computed as differences. ``wanted`` tells which rings a block searches, ``ring`` where each of them, in order, lies among the points."""
    centre = points.mean(axis=0)
    moved = points - centre
    norms = (moved**2).sum(axis=1)
    exact = np.column_stack([moved * -2, norms])
    top, width = norms.max(), points.shape[1]
    with np.errstate(over="ignore"):
        single = exact.astype("float32")
    some = max(1, SENT_BYTES // (8 * (width + 4)))
    room = {t: np.empty(TEST_BLOCK * strip, t) for t in ("float32", "float64")}
    flags = np.empty(TEST_BLOCK * strip + 8, bool)

    def product(rows: np.ndarray, a: int, b: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        out = room[right.dtype.name][: len(rows) * (b - a)].reshape(len(rows), b - a)
        return np.matmul(left if len(rows) == len(left) else left[rows], right[a:b].T, out=out)

    def within(rows: np.ndarray, a: int, b: int, left: np.ndarray, right: np.ndarray, limit: np.ndarray) -> np.ndarray:
        cells = len(rows) * (b - a)
        with np.errstate(over="ignore"):
            limit = limit.astype(right.dtype)
        np.less_equal(product(rows, a, b, left, right), limit[:, None], out=flags[:cells].reshape(len(rows), b - a))
        flags[cells : cells + -cells % 8] = False
        # Few are set, so eight are looked at together first.
        eights = np.flatnonzero(flags[: cells + -cells % 8].view("uint64"))
        return ((eights * 8)[:, None] + np.arange(8))[flags[: cells + -cells % 8].reshape(-1, 8)[eights]]

    for start in range(0, len(x), TEST_BLOCK):
        part = x[start : start + TEST_BLOCK]
        bound, want = tau[start : start + TEST_BLOCK].copy(), wanted(start, part)
        own = ((part - centre) ** 2).sum(axis=1)
        asked = np.column_stack([part - centre, np.ones(len(part))])
        with np.errstate(over="ignore"):
            asked_single = asked.astype("float32")
        slack = SLACK * (own + top)
        # Twice what rounding can do to a sum of products, and what is lost where they are too small for single precision.
        reach = (np.sqrt(own) + np.sqrt(top)) ** 2
        slack_single = (width + 8) * (2.0**-23 * reach + 1e-37)
        coarse = bool((reach < 1e37).all())
        best = np.zeros(0, "int64"), np.zeros(0, "int64"), np.zeros(0)
        for a in range(0, len(points), strip):
            b = min(a + strip, len(points))
            rows = np.flatnonzero(want[:, ring[a] : ring[b - 1] + 1].any(axis=1))
            if not len(rows):
                continue
            free = np.isinf(bound[rows])
            for left, right, spare, most in ((asked_single, single, slack_single, COARSE * len(rows) * (b - a) + 4 * k * len(rows)), (asked, exact, slack, np.inf)):
                if right is single and not coarse:
                    continue
                limit = bound[rows] - own[rows]
                if free.any():
                    others = product(rows[free], a, b, left, right)
                    if same is not None:
                        others[same[0][start + rows[free]][:, None] == same[1][a:b]] = np.inf
                    limit[free] = np.partition(others, k - 1, axis=1)[:, k - 1] if b - a >= k else np.inf
                hit = within(rows, a, b, left, right, limit + spare[rows] + np.finfo(right.dtype).eps * np.abs(limit))
                if len(hit) <= most:
                    break
                coarse = False
            for i in range(0, len(hit), some):
                row, pos = np.divmod(hit[i : i + some], b - a)
                row, pos = rows[row], pos + a
                if same is not None:
                    other = same[0][start + row] != same[1][pos]
                    row, pos = row[other], pos[other]
                dist = ((points[pos] - part[row]) ** 2).sum(axis=1)
                keep = dist <= bound[row]
                if keep.any():
                    best = _merge(k, bound, rank, *[np.concatenate([o, n[keep]]) for o, n in zip(best, (row, pos, dist))])
        yield start + best[0], best[1], best[2]


def _search(rings: Rings, k: int, reach: int, first: bool, names: list[str], same_table: bool):
    """The ``k`` nearest rows on a shelf for each row of a deck, for decks beside shelves: at first only the distances in the rings where a row is at home."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                ids, near, labels, ring = (batch.column(c)[i].values for c in ("ids", "near", "labels", "rings"))
                x, points = (_unpack(batch.column(c)[i], len(n), rings.pivots.shape[1]) for c, n in (("x", ids), ("points", near)))
                tau = _bounds(batch, i, len(ids))
                numbers, ring = np.unique(ring.to_numpy(), return_inverse=True)
                held = rings.only(numbers)

                def wanted(start: int, part: np.ndarray, tau=tau, numbers=numbers, held=held) -> np.ndarray:
                    if first:
                        return np.concatenate([rings.wanted(part[s], reach)[:, numbers] for s in rings.slices(len(part))])
                    return np.concatenate([held.wanted(part[s], reach, tau[start : start + len(part)][s]) for s in held.slices(len(part))])

                rank = np.empty(len(near), "int64")
                rank[pc.sort_indices(pa.table({"id": near, "label": labels}), sort_keys=[("id", "ascending"), ("label", "ascending")], null_placement="at_start")] = np.arange(len(near))
                blocks = _best(k, x, tau, wanted, points, ring, rank, _same(ids, near) if same_table else None, FIRST_STRIP if first else STRIP)
                row, pos, dist = (np.concatenate(parts) for parts in zip(*blocks))
                if first:
                    found = [pa.array(np.full(len(row), batch.column("__deck")[i].as_py(), "int32")), pa.array(row.astype("int32")), pa.array(dist)]
                else:
                    found = [ids.take(pa.array(row)), near.take(pa.array(pos)), pa.array(dist), labels.take(pa.array(pos))]
                yield pa.RecordBatch.from_arrays(found, names)

    return run


def _nearest(k: int, test_id: str, train_id: str, same_table: bool):
    """Grouped function: the ``k`` closest training rows of one block for each test row of one chunk. One matrix product finds those that can be among
    them; their distances are then computed as differences."""

    def search(key, test: pd.DataFrame, train: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(test) and len(train):
            points, asked = _matrix(train["features"]), _matrix(test["features"])
            ids, labels = train[train_id].to_numpy(), train["label"].to_numpy()
            norms = (points**2).sum(axis=1)
            for start in range(0, len(asked), TEST_BLOCK):
                part = asked[start : start + TEST_BLOCK]
                own = (part**2).sum(axis=1)
                rough = own[:, None] + norms[None, :] - 2 * (part @ points.T)
                for vec, tid, size, near in zip(part, test[test_id].to_numpy()[start:], own, rough):
                    if same_table:
                        near = np.where(ids == tid, np.inf, near)
                    take = min(k, len(near))
                    edge = np.partition(near, take - 1)[take - 1]
                    some = np.flatnonzero((near <= edge + SLACK * (size + norms.max())) & np.isfinite(near))
                    dist = ((points[some] - vec) ** 2).sum(axis=1)
                    best = np.lexsort((ids[some], dist))[:k]
                    out += [(tid, ids[some[i]], dist[i], labels[some[i]]) for i in best]
        return pd.DataFrame(out, columns=[test_id, "neighbour", "distance", "label"])

    return search


def _usable(df: DataFrame) -> DataFrame:
    x = F.col("features")
    return df.where(x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))))


def _block(row_id: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), row_id), F.col("__subs")).cast("int")


def _pack_number(row_id: str, rows: int, last: int) -> Column:
    """Packs of about ``rows`` rows, in the order of ``__start``, the number of rows before the group of a row; within its group a row is placed by its id."""
    share = F.pmod(F.xxhash64(F.lit("pack"), row_id), F.lit(2**30)) / 2**30
    return F.least(F.floor((F.col("__start") + share * F.col("__rows")) / rows), F.lit(last)).cast("int")


class Search:
    """Training rows ``train_id, features, label`` placed in rings, ready to be searched by any number of test rows."""

    def __init__(self, train: DataFrame, train_id: str = "id"):
        train = durable(_usable(train.select(train_id, "features", "label")))
        self.spark, self.train_id, self.schema = train.sparkSession, train_id, train.schema
        self.n, width = train.agg(F.count("*"), F.max(F.size("features"))).first()
        if self.n <= TRAIN_BLOCK:
            self.rows = train  # one block, nothing to rule out
            return
        self.width = max(width, 1)
        wanted = min(MAX_PIVOTS, -(-self.n // CELL_ROWS), max(1, PIVOT_BYTES // (8 * self.width)))
        # A bounded number of rows in the order of a hash of their ids.
        drawn = train.select("features", F.xxhash64(train_id).alias("h"), train_id).orderBy("h", train_id).limit(wanted).collect()
        pivots = _in_order(np.unique(np.array([r["features"] for r in drawn], dtype="float64").reshape(len(drawn), -1), axis=0))
        placed = self._place(train, pivots)
        cuts = F.percentile_approx("__d", F.array(*[F.lit(i / RINGS) for i in range(1, RINGS)]), 10000)
        cells = placed.groupBy("__p").agg(F.count("*").alias("__n"), cuts.alias("__cuts"))
        # As few of the cuts as leave about a block to a ring.
        every = F.greatest(F.lit(1), F.floor(F.lit(RINGS * TRAIN_BLOCK) / F.col("__n"))).cast("int")
        cells = durable(cells.select("__p", F.filter("__cuts", lambda c, i: (i + 1) % every == 0).alias("__cuts")))
        placed = attach(placed, cells, ["__p"], "inner", len(pivots), 8 * RINGS + 64)
        placed = placed.withColumn("__r", F.size(F.filter("__cuts", lambda c: c < F.col("__d")))).drop("__cuts")
        found = placed.groupBy("__p", "__r").agg(F.min("__d").alias("low"), F.max("__d").alias("high"), F.count("*").alias("rows")).orderBy("__p", "__r").collect()
        self.rings = Rings(pivots, *[np.array([r[c] for r in found]) for c in ("__p", "low", "high", "rows")])
        start = np.cumsum(self.rings.rows) - self.rings.rows
        numbers = [(r["__p"], r["__r"], i, -(-r["rows"] // TRAIN_BLOCK), int(start[i]), r["rows"]) for i, r in enumerate(found)]
        self.numbers = self.spark.createDataFrame(numbers, "__p int, __r int, __ring int, __subs int, __start long, __rows long")
        size, self.count = self._sizes(self.n)
        self.low, self.high = start // size, (start + self.rings.rows - 1) // size
        self.rows = attach(placed, self.numbers, ["__p", "__r"], "inner", len(found)).withColumn("__block", _block(train_id))
        self.rows = self.rows.withColumn("__shelf", _pack_number(train_id, size, self.count - 1)).drop("__p", "__r", "__d", "__subs", "__start", "__rows")
        kept = {"near": train_id, "labels": "label", "rings": "__ring"}
        self.shelves = self._packed(self.rows.drop("__block"), "__shelf", "__ring", kept, "points", self.count)

    def _place(self, rows: DataFrame, pivots: np.ndarray) -> DataFrame:
        fields = [*rows.schema.fields, T.StructField("__p", T.IntegerType()), T.StructField("__d", T.DoubleType())]
        return durable(rows.mapInPandas(_place(pivots), T.StructType(fields)))

    def _sizes(self, n: int) -> tuple[int, int]:
        """Rows of a pack and how many packs there are: as few as bounds allow, but enough for all cores."""
        enough = -(-n // math.isqrt(4 * self.spark.sparkContext.defaultParallelism))
        size = max(1, min(PACK_ROWS, PACK_BYTES // (8 * self.width), max(TRAIN_BLOCK, enough)))
        return size, max(1, -(-n // size))

    def _packed(self, rows: DataFrame, by: str, order: str, kept: dict[str, str], vectors: str, count: int) -> DataFrame:
        """One row and one partition for each pack."""
        fields = [T.StructField(by, T.IntegerType()), *[T.StructField(name, T.ArrayType(rows.schema[c].dataType)) for name, c in kept.items()]]
        schema = T.StructType([*fields, T.StructField(vectors, T.BinaryType())])
        return durable(rows.repartitionById(count, by).mapInArrow(_pack(by, order, kept, vectors), schema))

    def visits(self, test: DataFrame, k: int, first: bool) -> DataFrame:
        """``test`` with ``__ring, __block`` for each block that a row has to be compared with; ``k`` counts the row itself if it is in the table."""
        fields = [f for f in test.schema.fields if f.name not in ("features", "__tau")] + [T.StructField("__ring", T.IntegerType())]
        sent = attach(test.mapInPandas(_choose(self.rings, k, first), T.StructType(fields)), self.numbers.select("__ring", "__subs"), ["__ring"], "inner", len(self.rings.at))
        return sent.withColumn("__block", F.explode(F.sequence(F.lit(0), F.lit(0) if first else F.col("__subs") - 1))).drop("__subs")

    def _decks(self, test: DataFrame, test_id: str) -> tuple[DataFrame, int, int]:
        """Test rows in packs, how many packs there are and how many rows."""
        placed = self._place(test, self.rings.pivots)
        counts = placed.groupBy("__p").count().orderBy("__p").collect()
        total = sum(r["count"] for r in counts)
        size, count = self._sizes(total)
        start = np.cumsum([0, *[r["count"] for r in counts]])
        groups = self.spark.createDataFrame([(r["__p"], int(s), r["count"]) for r, s in zip(counts, start)], "__p int, __start long, __rows long")
        rows = attach(placed, groups, ["__p"], "inner", len(counts)).withColumn("__deck", _pack_number(test_id, size, count - 1))
        return self._packed(rows.drop("__d", "__start", "__rows"), "__deck", "__p", {"ids": test_id}, "x", count), count, total

    def _beside(self, decks: DataFrame, count: int, k: int, first: bool) -> DataFrame:
        """Decks beside the shelves that they meet, a pair in a row."""
        low, high = self.low, self.high
        if first:
            # Of a ring that fills a shelf, one such shelf is enough for a bound.
            long = high - low > 1
            low, high = low + long, np.where(long, low + 1, high)
        meets = durable(decks.mapInArrow(_meets(self.rings, k, first, low, high), "__deck int, __shelves array<int>"))
        pairs = meets.agg(F.sum(F.size("__shelves"))).first()[0] or 0
        asked = attach(decks, meets, ["__deck"], "inner", count, 4 * self.count + 64)
        if count * self.count > FEW_TASKS and pairs * SPARSE < count * self.count:
            return asked.withColumn("__shelf", F.explode("__shelves")).drop("__shelves").join(self.shelves, "__shelf")
        # Each task reads a deck and a shelf where they were written; nothing is shuffled.
        both = asked.hint("shuffle_replicate_nl").join(self.shelves, F.array_contains("__shelves", F.col("__shelf")))
        return both.drop("__shelves")

    def _meet(self, test: DataFrame, train: DataFrame, on: list[str], k: int, test_id: str, same_table: bool) -> DataFrame:
        """The ``k`` best among training rows of equal ``on``; test rows are dealt to ``__chunks`` tasks."""
        left = test.withColumn("__chunk", F.pmod(F.xxhash64(test_id), F.col("__chunks")).cast("int"))
        right = train.withColumn("__chunk", F.explode(F.sequence(F.lit(0), F.col("__chunks") - 1)))
        by = [*on, "__chunk"]
        found = left.groupBy(*by).cogroup(right.groupBy(*by))
        return found.applyInPandas(_nearest(k, test_id, self.train_id, same_table), self._fields(test, test_id))

    def _fields(self, test: DataFrame, test_id: str) -> T.StructType:
        fields = [T.StructField(test_id, test.schema[test_id].dataType), T.StructField("neighbour", self.schema[self.train_id].dataType)]
        return T.StructType([*fields, T.StructField("distance", T.DoubleType()), T.StructField("label", self.schema["label"].dataType)])

    def nearest(self, test: DataFrame, k: int, test_id: str = "id", same_table: bool = False) -> DataFrame:
        test = _usable(test.select(test_id, "features"))
        if self.n <= TRAIN_BLOCK:
            chunks = F.lit(max(1, -(-test.count() // (2 * TEST_BLOCK)))).alias("__chunks")
            both = self._meet(test.select("*", chunks), self.rows.select("*", chunks), [], k, test_id, same_table)
        else:
            both = self._rounds(test, k, test_id, same_table)
        merged = both.groupBy(test_id).agg(F.slice(F.sort_array(F.collect_list(F.struct("distance", "neighbour", "label"))), 1, k).alias("n"))
        return merged.select(test_id, F.inline("n"))

    def _rounds(self, test: DataFrame, k: int, test_id: str, same_table: bool) -> DataFrame:
        """The best at home give bounds; then the best of each shelf among all rings that the bounds do not rule out."""
        decks, count, total = self._decks(test, test_id)
        reach = k + 1 if same_table else k
        early = self._beside(decks, count, reach, True).mapInArrow(
            _search(self.rings, k, reach, True, ["__deck", "__row", "distance"], same_table), "__deck int, __row int, distance double"
        )
        tau = early.groupBy("__deck", "__row").agg(F.sort_array(F.collect_list("distance")).alias("d")).where(F.size("d") >= k)
        tau = tau.groupBy("__deck").agg(F.collect_list(F.struct("__row", F.element_at("d", k).alias("__tau"))).alias("t"))
        tau = durable(tau.select("__deck", F.col("t")["__row"].alias("__row"), F.col("t")["__tau"].alias("__tau")))
        bounded = attach(decks, tau, ["__deck"], "left", total, 12)
        if 12 * total > BROADCAST_BYTES:
            bounded = durable(bounded.repartitionById(count, "__deck"))  # still a deck to a partition
        fields = self._fields(test, test_id)
        late = self._beside(bounded, count, reach, False)
        return late.mapInArrow(_search(self.rings, k, reach, False, fields.names, same_table), fields)


def nearest(test: DataFrame, train: DataFrame, k: int = 5, test_id: str = "id", train_id: str = "id", same_table: bool = False) -> DataFrame:
    """``test_id, neighbour, distance, label`` of the ``k`` nearest training rows (squared distance, smaller id on ties).

    With ``same_table`` a row is not its own neighbour. Ids are unique. Rows without a vector, or with one that holds a null or a number that is not finite, take no part.
    """
    return Search(train, train_id).nearest(test, k, test_id, same_table)


def vote(neighbours: DataFrame, test_id: str = "id") -> DataFrame:
    """``test_id, prediction, confidence`` by majority; the smaller label wins ties."""
    counts = neighbours.groupBy(test_id, "label").agg(F.count("*").alias("n"))
    return counts.groupBy(test_id).agg(
        F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("prediction"), (F.max("n") / F.sum("n")).alias("confidence")
    )

