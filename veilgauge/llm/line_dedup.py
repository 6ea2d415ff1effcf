"""Lines that many documents share: hashes dealt out by range, streamed in order, answered by keep bitmaps.

Each line that may be dropped becomes ``(hash, document, position)``. The rows are range-partitioned and sorted by hash,
then document (largest first), then position. The range bounds are made of all three columns, so that a line which a third of
all documents hold is spread over as many tasks as its rows deserve. A task streams its rows once and keeps those of the run of equal hashes that it
is in: the run is decided when its fifth document comes by. A run that goes on in a neighbouring task is left open, and so is one that has
more than ``PENDING`` rows in fewer documents (one document may hold a line very often): at most two runs for each task and one for each ``PENDING`` rows. These
are decided by one more small aggregate. Text never moves: the result is one compressed bitmap for each document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import staged, text_key, total_bytes
from veilgauge.llm.textscan import hash_spans, pieces, words_of

MIN_CHARS = 40
MIN_DOCS = 5
PENDING = 200_000
PART_BYTES = 256 * 2**20
LINE_ROWS = "h long, doc long, key long, pos int"
MARKED = LINE_ROWS + ", open int"
DROP, OPEN, SEEN = 0, 1, 2
NO_ID = -(2**63)


def line_spans(column: pa.Array):
    """Stripped byte spans of all lines of several texts: data, start, end (start = end: blank), first line per text."""
    words = words_of(column)
    breaks = np.flatnonzero(words.data == 10)
    count = np.diff(np.searchsorted(breaks, words.offsets)) + 1
    first = np.concatenate([[0], np.cumsum(count)])
    begin = np.empty(first[-1], dtype=np.int64)
    stop = np.empty(first[-1], dtype=np.int64)
    is_first = np.zeros(first[-1], dtype=bool)
    is_first[first[:-1]] = True
    is_last = np.roll(is_first, -1)
    begin[is_first], stop[is_last] = words.offsets[:-1], words.offsets[1:]
    begin[~is_first] = breaks + 1
    stop[~is_last] = breaks
    lo, hi = np.searchsorted(words.start, begin), np.searchsorted(words.start, stop)
    some = lo < hi
    start = end = begin
    if some.any():
        start, end = begin.copy(), begin.copy()
        start[some], end[some] = words.start[lo[some]], words.end[hi[some] - 1]
    return words.data, start, end, first


def _lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                data, start, end, first = line_spans(piece.column("text"))
                points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
                use = np.flatnonzero((points[end] - points[start] >= min_chars) & (end > start))
                owner = np.repeat(np.arange(piece.num_rows), np.diff(first))[use]
                doc, key = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                yield pa.record_batch(
                    [
                        pa.array(hash_spans(data, start[use], end[use], True).view(np.int64)),
                        pa.array(doc[owner]),
                        pa.array(key[owner]),
                        pa.array((use - first[owner]).astype(np.int32)),
                    ],
                    names=["h", "doc", "key", "pos"],
                )

    return run


def _stream(min_docs: int):
    """Decide runs of equal hashes; the rows come sorted by hash, document descending, position."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["h", "doc", "key", "pos"]
        carry: list[np.ndarray] | None = None
        open_hash: int | None = None  # a run of which this task decides nothing
        hot: tuple[int, np.ndarray] | None = None  # a run of this task that is decided and may go on

        def out(cols, open_) -> pa.RecordBatch:
            kinds = np.full(len(cols[0]), open_, dtype=np.int32)
            return pa.record_batch([*map(pa.array, cols), pa.array(kinds)], names=[*names, "open"])

        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            if open_hash is None:
                open_hash = int(cols[0][0])
            here = cols[0] == open_hash
            if here.any():
                yield out([c[here] for c in cols], OPEN)
                cols = [c[~here] for c in cols]
            if hot is not None and len(cols[0]):
                here = cols[0] == hot[0]
                drop = here & (cols[1] != hot[1][0])
                if drop.any():
                    yield out([c[drop] for c in cols], DROP)
                if not here.all():
                    hot = None
                cols = [c[~here] for c in cols]
            if carry is not None:
                cols = [np.concatenate([a, b]) for a, b in zip(carry, cols)]
                carry = None
            if not len(cols[0]):
                continue
            h, doc = cols[0], cols[1]
            new_run = np.concatenate([[True], h[1:] != h[:-1]])
            new_doc = new_run | np.concatenate([[True], doc[1:] != doc[:-1]])
            run_at = np.flatnonzero(new_run)
            run_no = np.cumsum(new_run) - 1
            docs_before = np.cumsum(new_doc)
            rank = docs_before - docs_before[run_at][run_no]
            n_docs = np.maximum.reduceat(rank, run_at) + 1
            drop = (rank > 0) & (n_docs[run_no] >= min_docs)
            last = run_no == run_no[-1]
            if n_docs[-1] >= min_docs:
                hot = (int(h[-1]), doc[np.flatnonzero(last & new_doc)][:min_docs])
            else:
                carry = [c[last] for c in cols]
                if len(carry[0]) > PENDING:
                    open_hash = int(h[-1])
                    yield out(carry, OPEN)
                    carry = None
            if drop.any():
                yield out([c[drop] for c in cols], DROP)
        if carry is not None:
            yield out(carry, OPEN)
        elif hot is not None:  # the next task's first run needs to know
            n = len(hot[1])
            yield out([np.full(n, hot[0]), hot[1], np.zeros(n, dtype=np.int64), np.full(n, -1, dtype=np.int32)], SEEN)

    return run


def dropped_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc, key, pos`` of every line to drop (``doc``: the id, or the smallest long for a null id)."""
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("key"), "text")
    lines = keyed.mapInArrow(_lines(min_chars), LINE_ROWS)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total_bytes(docs) // PART_BYTES), 1)
    order = [F.col("h"), F.col("doc").desc(), F.col("pos"), F.col("key")]
    marked = staged(lines.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(_stream(min_docs), MARKED))
    undecided = marked.filter(F.col("open") != DROP)
    # Two runs of each task are open at most, and one more for each PENDING rows, so this is small.
    shared = undecided.select("h", "doc").distinct().groupBy("h").agg(F.count("*").alias("n"), F.max("doc").alias("last"))
    shared = shared.filter(F.col("n") >= min_docs).select("h", "last")
    late = undecided.filter(F.col("open") == OPEN).join(F.broadcast(shared), "h").filter(F.col("doc") != F.col("last"))
    return marked.filter(F.col("open") == DROP).select("doc", "key", "pos").unionByName(late.select("doc", "key", "pos"))


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for n, gone in zip(batch.column("n_lines").to_pylist(), batch.column("gone")):
            bits = np.ones(n, dtype=bool)
            if gone.is_valid:
                bits[gone.values.to_numpy(zero_copy_only=False)] = False
            keep.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        rest = [batch.column(c) for c in ("doc_id", "key", "n_lines", "n_dropped")]
        yield pa.record_batch([*rest, pa.array(keep, pa.binary())], names=["doc_id", "key", "n_lines", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """``doc_id, key, n_lines, n_dropped, keep``: which lines of each document stay.

    A line's key is the line without white space at its ends, A-Z in lower case. Keys of at least ``min_chars`` code
    points that at least ``min_docs`` documents hold lose all their lines except those of the largest ``doc_id``. ``keep`` is
    a zlib-compressed bitmap, first line in the highest bit (:func:`unpack`).

    Null or empty texts have one empty line. A null id counts as one document, smaller than all others. Rows of the same id
    are one document; rows equal in id and text get one row here (``key`` tells the others apart). Other columns are not read.
    """
    gone = dropped_lines(docs, min_chars, min_docs).groupBy("doc", "key").agg(F.collect_set("pos").alias("gone"))
    n_lines = F.coalesce(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1, F.lit(1)).cast("long")
    base = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("key"), n_lines.alias("n_lines"))
    joined = base.distinct().join(gone, ["doc", "key"], "left")
    counted = joined.withColumn("n_dropped", F.coalesce(F.size("gone"), F.lit(0)).cast("long"))
    counted = counted.withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
    return counted.select("doc_id", "key", "n_lines", "n_dropped", "gone").mapInArrow(
        _bitmaps, "doc_id long, key long, n_lines long, n_dropped long, keep binary"
    )


def unpack(keep: bytes, n_lines: int) -> np.ndarray:
    """One boolean per line."""
    return np.unpackbits(np.frombuffer(zlib.decompress(keep), dtype=np.uint8), count=n_lines).astype(bool)


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for piece in pieces(batch):
            kept = []
            rows = zip(*(piece.column(c).to_pylist() for c in ("text", "n_lines", "n_dropped", "keep")))
            for text, n, dropped, keep in rows:
                if dropped:
                    bits = unpack(keep, n)
                    text = "\n".join(line for line, stays in zip(text.split("\n"), bits) if stays)
                kept.append(text or "")
            rest = [piece.column(c) for c in ("doc_id", "n_lines", "n_dropped")]
            yield pa.record_batch([*rest, pa.array(kept, pa.string())], names=["doc_id", "n_lines", "n_dropped", "kept"])


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """``doc_id, n_lines, n_dropped, kept``: the texts that are left (a null text: empty), one row per row of ``docs``."""
    left = docs.select("doc_id", text_key().alias("key"), "text").alias("d")
    right = bitmaps.alias("b")
    on = F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d.key") == F.col("b.key"))
    both = left.join(right, on).select("d.doc_id", "d.text", "b.n_lines", "b.n_dropped", "b.keep")
    return both.mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, kept string")
