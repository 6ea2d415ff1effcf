"""Repeated passages: rolling hashes of every window of words, counted in Spark, merged into removal intervals.

Each window of 20 words has a rolling (Rabin-Karp) hash. A task first settles repeats among the windows it holds, so that a passage which
a third of all documents share leaves it once. The rest travels as packed cells, one for each task's block of windows and
bucket of hash values: seven bytes of the hash, the position packed to about one byte, and the documents once. A bucket holds
about two million windows whatever the input's size. It returns, per document, the windows that begin earlier elsewhere; these
are merged into maximal intervals of words when the document is read again.

The hash has 62 bits or more; two different windows fall together with a chance of 2**-62 a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import text_key, total_bytes
from veilgauge.llm.textscan import mix, pieces, windows, words_of

WINDOW = 20
BLOCK_WINDOWS = 2**20
BUCKET_WINDOWS = 2 * 2**20
CELL_WINDOWS = 16
NO_ID = -(2**63)
CELLS = "bucket int, doc long, key long, cell binary"
FOUND = "doc long, key long, starts binary"


def _planes(values: np.ndarray) -> bytes:
    """Bytes of equal rank together, which makes small numbers compress well."""
    return values.view(np.uint8).reshape(len(values), values.itemsize).T.tobytes()


def _from_planes(raw: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T).view(dtype).ravel()


def pack_starts(starts: np.ndarray) -> bytes:
    return zstandard.compress(_planes(np.diff(starts, prepend=starts.dtype.type(0)).astype(np.uint32)), 1)


def unpack_starts(raw: bytes) -> np.ndarray:
    plain = zstandard.decompress(raw)
    return np.cumsum(_from_planes(plain, np.uint32, len(plain) // 4).astype(np.int64))


def _pack_cell(value: np.ndarray, owner: np.ndarray, start: np.ndarray, doc: np.ndarray, key: np.ndarray) -> bytes:
    """Windows in order of document and position."""
    head = np.concatenate([[0], np.flatnonzero(np.diff(owner)) + 1])
    step = np.diff(start, prepend=start.dtype.type(0))
    step[head] = start[head]
    who = owner[head]
    count = np.diff(np.append(head, len(owner)))
    parts = [_planes(doc[who]), _planes(key[who]), _planes(count.astype(np.uint32)), _planes(step.astype(np.uint32))]
    meta = zstandard.compress(b"".join(parts), 1)
    sizes = np.array([len(value), len(head), len(meta)], dtype=np.uint32).tobytes()
    return sizes + meta + value.view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _unpack_cell(raw: bytes):
    n, heads, size = np.frombuffer(raw[:12], dtype=np.uint32).astype(int)
    meta = zstandard.decompress(raw[12 : 12 + size])
    cuts = np.cumsum([0, 8 * heads, 8 * heads, 4 * heads, 4 * n])
    doc, key, count, step = (
        _from_planes(meta[a:b], t, m)
        for a, b, t, m in zip(cuts[:-1], cuts[1:], (np.int64, np.int64, np.uint32, np.uint32), (heads, heads, heads, n))
    )
    total = np.cumsum(step.astype(np.int64))
    first = np.cumsum(count.astype(np.int64)) - count
    start = total - np.repeat(total[first] - step[first], count)
    value = np.zeros((n, 8), dtype=np.uint8)
    value[:, :7] = np.frombuffer(raw[12 + size :], dtype=np.uint8).reshape(n, 7)
    return value.view(np.uint64).ravel(), np.repeat(doc, count), np.repeat(key, count), start


def _later(value: np.ndarray, doc: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For windows in order of (document, start) within equal values after a stable sort: indices of windows that begin
    later than the first of their value, and of the firsts themselves (several if document and start are equal)."""
    order = np.argsort(value, kind="stable")
    ranked = value[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    head = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = (doc[order] != doc[head]) | (start[order] != start[head])
    return order[later], order[~later]


def _rows(doc: np.ndarray, key: np.ndarray, start: np.ndarray):
    """One packed list of starts for each document row; the input is sorted by document row and start."""
    if not len(doc):
        return [], [], []
    head = np.concatenate([[0], np.flatnonzero((np.diff(doc) != 0) | (np.diff(key) != 0)) + 1])
    packed = [pack_starts(start[a:b]) for a, b in zip(head, np.append(head[1:], len(doc)))]
    return doc[head], key[head], packed


def _cells(width: int, bits: int):
    # With many buckets a block has to be larger, so that a cell still holds some windows.
    block = min(max(BLOCK_WINDOWS, CELL_WINDOWS << bits), 4 * BLOCK_WINDOWS)

    def flush(held) -> Iterator[pa.RecordBatch]:
        doc = np.concatenate([h[0] for h in held])
        key = np.concatenate([h[1] for h in held])
        base = np.cumsum([0, *(len(h[0]) for h in held[:-1])])
        owner = np.concatenate([h[2] + np.int32(b) for h, b in zip(held, base)])
        start = np.concatenate([h[3] for h in held])
        value = np.concatenate([h[4] for h in held])
        held.clear()
        rank = np.empty(len(doc), dtype=np.int64)
        rank[np.lexsort((key, doc))] = np.arange(len(doc))
        if (np.diff(rank) < 0).any() or (np.diff(doc) == 0).any():
            order = np.lexsort((rank[owner], start, doc[owner]))
            owner, start, value = owner[order], start[order], value[order]
        later, first = _later(value, doc[owner], start)
        later = later[np.lexsort((start[later], rank[owner[later]]))]
        docs, keys, packed = _rows(doc[owner[later]], key[owner[later]], start[later])
        if packed:
            # Settled lists pass through any bucket; their texts spread them, also where all ids are null.
            spread = (mix(np.asarray(keys).view(np.uint64) ^ mix(np.asarray(docs).view(np.uint64))) >> np.uint64(64 - bits)).astype(np.int32)
            yield pa.record_batch(
                [pa.array(spread), pa.array(docs), pa.array(keys), pa.array(packed, pa.binary())], names=["bucket", "doc", "key", "cell"]
            )
        first = first[np.lexsort((start[first], rank[owner[first]]))]
        bucket = (value[first] >> np.uint64(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(bucket, kind="stable")
        first, bucket = first[order], bucket[order]
        edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
        which, cells = [], []
        for a, b in zip(edges[:-1], edges[1:]):
            if b > a:
                pick = first[a:b]
                which.append(int(bucket[a]))
                cells.append(_pack_cell(value[pick], owner[pick], start[pick], doc, key))
        none = [None] * len(cells)
        yield pa.record_batch(
            [pa.array(which, pa.int32()), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(cells, pa.binary())],
            names=["bucket", "doc", "key", "cell"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for piece in pieces(batch):
                words = words_of(piece.column("text"))
                at, value = windows(words, words.hashes(), width)
                if not len(at):
                    continue
                owner = words.doc[at]
                doc, key = (piece.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "key"))
                held.append((doc, key, owner.astype(np.int32), (at - words.first[owner]).astype(np.int32), value))
                n += len(at)
                if n >= block:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return run


def _bucket(table: pa.Table) -> pa.Table:
    """Windows of one bucket of hash values: which begin earlier elsewhere. Lists that are settled pass through."""
    settled = pc.is_valid(table.column("doc"))
    ready = table.filter(settled).select(["doc", "key", "cell"]).rename_columns(["doc", "key", "starts"])
    cells = [_unpack_cell(c) for c in table.filter(pc.invert(settled)).column("cell").to_pylist()]
    if cells:
        value = np.concatenate([c[0] for c in cells])
        ranked = np.sort(value)
        again = np.unique(ranked[1:][ranked[1:] == ranked[:-1]])
        if len(again):
            at = np.minimum(np.searchsorted(again, value), len(again) - 1)
            use = np.flatnonzero(again[at] == value)
            value = value[use]
            doc, key, start = (np.concatenate([c[i] for c in cells])[use] for i in (1, 2, 3))
            order = np.lexsort((key, start, doc))
            value, doc, key, start = value[order], doc[order], key[order], start[order]
            later, _ = _later(value, doc, start)
            later = later[np.lexsort((start[later], key[later], doc[later]))]
            docs, keys, packed = _rows(doc[later], key[later], start[later])
            if packed:
                found = pa.table({"doc": pa.array(docs), "key": pa.array(keys), "starts": pa.array(packed, pa.binary())})
                ready = pa.concat_tables([ready.cast(found.schema), found])
    return ready


def repeated_windows(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc, key, starts``: packed first words of the windows that begin earlier elsewhere; several rows a document."""
    bits = min(max(math.ceil(math.log2(max(total_bytes(docs) / 6 / BUCKET_WINDOWS, 1))), 6), 30)
    keyed = docs.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("key"), "text")
    return keyed.mapInArrow(_cells(width, bits), CELLS).groupBy("bucket").applyInArrow(_bucket, FOUND)


def intervals(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Maximal runs of words covered by windows that begin at ``starts`` (ascending): first word, one past the last."""
    if not len(starts):
        return []
    gap = np.flatnonzero(np.diff(starts) > width)
    return list(zip(starts[np.concatenate([[0], gap + 1])].tolist(), (starts[np.append(gap, len(starts) - 1)] + width).tolist()))


def _squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        for piece in pieces(batch):
            texts = [pack.compress(t or b"") for t in piece.column("text").cast(pa.binary()).to_pylist()]
            rest = [piece.column(c) for c in ("doc_id", "doc", "key")]
            yield pa.record_batch([*rest, pa.array(texts, pa.binary())], names=["doc_id", "doc", "key", "packed"])


def _cut(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            n_words, removed, spans, kept = [], [], [], []
            for packed, found in zip(batch.column("packed").to_pylist(), batch.column("found").to_pylist()):
                words = unpack.decompress(packed).split()
                cuts = []
                if found:
                    cuts = intervals(np.unique(np.concatenate([unpack_starts(f) for f in found])), width)
                stays = np.ones(len(words), dtype=bool)
                for a, b in cuts:
                    stays[a:b] = False
                n_words.append(len(words))
                removed.append(int(len(words) - stays.sum()))
                spans.append([{"first": a, "end": b} for a, b in cuts])
                kept.append(b" ".join(compress(words, stays.tolist()) if cuts else words))
            span = pa.struct([("first", pa.int64()), ("end", pa.int64())])
            yield pa.record_batch(
                [
                    batch.column("doc_id"),
                    pa.array(n_words, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.list_(span)),
                    pa.array(kept, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "n_removed", "removed", "kept"],
            )

    return run


def remove_repeats(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, removed, kept``: words left when every window seen earlier is cut out.

    Words are runs of anything but white space, unchanged. A word goes if a window of ``width`` words that covers it also
    begins earlier: in a smaller ``doc_id``, or at an earlier word of the same one. Windows are judged on the input.
    ``removed`` has the maximal intervals of word positions, ``kept`` the other words joined by one space.

    Null or empty texts have no words. A null id is smaller than all others. Rows that share an id are places in the same
    document: equal starts remove nothing from each other, so that a row given twice stays twice. Other columns are not read.
    """
    found = repeated_windows(docs, width).groupBy("doc", "key").agg(F.collect_list("starts").alias("found"))
    keyed = docs.select("doc_id", F.coalesce("doc_id", F.lit(NO_ID)).alias("doc"), text_key().alias("key"), "text")
    texts = keyed.mapInArrow(_squeeze, "doc_id long, doc long, key long, packed binary")
    joined = texts.join(found, ["doc", "key"], "left").select("doc_id", "packed", "found")
    out = "doc_id long, n_words long, n_removed long, removed array<struct<first long, end long>>, kept string"
    return joined.mapInArrow(_cut(width), out)
