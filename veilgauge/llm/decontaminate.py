"""Benchmark items inside documents: containment search with MinHash sketches for document sizes, completed and verified exactly.

Containment ``|item & document| / |item|`` is turned into a question of equal minima: with the documents partitioned by
the size of their shingle sets (powers of two), a partition of at most *u* shingles is sketched with ``2 * u`` bins, each keeping its
smallest hash. An item's shingle that the document holds is then the minimum of its bin in both with a chance of about 0.8, however long the
document is, and the sketches are made in three independent placements; an item is a candidate as soon as one of its shingles agrees.

The sketches miss some items of very few shingles. The search is completed by each item's rarest shingles: a document that holds at least *need* of an
item's *n* shingles lacks at most ``n - need`` of them, so it holds one of any ``n - need + 1``; these are chosen as the rarest by the number of items that
hold them. A document with one of them is a candidate too, so none is missed. Each candidate is verified on the document's full set.

An item of fewer words than a shingle is one run of words as a whole, and is found where a document holds that run.

Items are the stated query set: they are sketched for all partitions and sent to the documents in blocks of bounded, measured
size, one scan of the documents for each block. Documents are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import text_key
from veilgauge.llm.textscan import mix, pieces, seeds, shingle_sets

SHINGLE = 5
PERCENT = 80
PLACEMENTS = 3
BLOCK_BYTES = 8 * 2**20
U = np.uint64
_SEEDS = seeds(PLACEMENTS, 21)
PAIRS = "doc_id long, key long, item_id long, n_item long, n_shared long, sketched boolean"


def _level(size: np.ndarray) -> np.ndarray:
    """Size partition: the least power of two that is not smaller."""
    return np.ceil(np.log2(np.maximum(size, 1))).astype(np.int64)


def _minima(values: np.ndarray, owner: np.ndarray, level: int, placement: int) -> np.ndarray:
    """Indices of the elements that are the smallest of their bin in their set, in the sketches of a size partition."""
    hashed = mix(values ^ _SEEDS[placement])
    bins = (hashed >> U(32)) & ((U(2) << U(level)) - U(1))
    order = np.lexsort((hashed, bins, owner))
    o, b = owner[order], bins[order]
    return order[np.concatenate([[True], (o[1:] != o[:-1]) | (b[1:] != b[:-1])])]


def _contested(values: np.ndarray, owner: np.ndarray, level: np.ndarray, is_known: np.ndarray, placement: int) -> np.ndarray:
    """Indices of the documents' known shingles that are the minimum of their bin among all shingles of the document. Bins without a
    known shingle are left out: they cannot agree with an item's."""
    hashed = mix(values ^ _SEEDS[placement])
    bins = (hashed >> U(32)) & ((U(2) << level[owner].astype(np.uint64)) - U(1))
    cell = mix((owner.astype(np.uint64) << U(40)) ^ bins)
    hit = np.flatnonzero(is_known)
    wanted = np.sort(cell[hit])
    if not len(wanted):
        return hit
    rival = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, cell), len(wanted) - 1)] == cell)
    cells, where = np.unique(cell[rival], return_inverse=True)
    least = np.full(len(cells), ~U(0))
    np.minimum.at(least, where, hashed[rival])
    return rival[is_known[rival] & (hashed[rival] == least[where])]


class Items:
    """Items of one block with at least one shingle of ``k`` words: distinct shingles, the items of each, which of them are an item's
    rarest, and which are sketch values by size partition. ``exact``: only items of exactly ``k`` words."""

    def __init__(self, texts: list, percent: int, k: int = SHINGLE, exact: bool = False) -> None:
        self.n = len(texts)
        owner, values = [], []
        at = 0
        for piece in pieces(pa.record_batch([pa.array(texts, pa.string())], names=["text"])):
            column = piece.column("text")
            if exact:  # a shorter item has no run of k words, a longer one has a longer run
                longer = np.diff(shingle_sets(column, k + 1, False)[2]) > 0
                column = pa.array([None if skip else t for t, skip in zip(column.to_pylist(), longer)], pa.string())
            v, o, _ = shingle_sets(column, k, False)
            owner.append(o + at)
            values.append(v)
            at += piece.num_rows
        self.owner, self.values = np.concatenate([np.zeros(0, np.int64), *owner]), np.concatenate([np.zeros(0, np.uint64), *values])
        self.size = np.bincount(self.owner, minlength=self.n)
        self.known = np.unique(self.values)
        self.group = np.searchsorted(self.known, self.values)
        self.order = np.argsort(self.group, kind="stable")
        self.by_shingle = self.owner[self.order]
        self.start = np.searchsorted(self.group[self.order], np.arange(len(self.known) + 1))
        rare = np.lexsort((self.values, np.diff(self.start)[self.group], self.owner))
        rank = np.arange(len(rare)) - (np.cumsum(self.size) - self.size)[self.owner[rare]]
        need = np.maximum(-(-percent * self.size // 100), 1)
        searched = np.zeros(len(rare), dtype=bool)
        searched[rare] = rank <= (self.size - need)[self.owner[rare]]
        self.searched = searched[self.order]
        self.rare = np.zeros(len(self.known), dtype=bool)
        self.rare[self.group[searched]] = True
        self.in_sketch: dict[tuple[int, int], np.ndarray] = {}

    def sketched(self, level: int, placement: int) -> np.ndarray:
        """For each item shingle, by shingle: is it the minimum of its bin in its item's sketch for this partition?"""
        if (level, placement) not in self.in_sketch:
            flags = np.zeros(len(self.values), dtype=bool)
            flags[_minima(self.values, self.owner, level, placement)] = True
            self.in_sketch[level, placement] = flags[self.order]
        return self.in_sketch[level, placement]

    def pairs(self, owner: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Every (document, item, slot) for documents' occurrences of known shingles."""
        count = self.start[known + 1] - self.start[known]
        slot = np.repeat(self.start[known] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        return np.repeat(owner, count), self.by_shingle[slot], slot

    def agreeing(self, values, owner, level, is_known, place) -> np.ndarray:
        """Candidates, ``document * n + item``: a sketch value of the item is one of the document's in the same bin."""
        found = [np.zeros(0, dtype=np.int64)]
        for p in range(PLACEMENTS):
            hit = _contested(values, owner, level, is_known, p)
            doc, item, slot = self.pairs(owner[hit], place[hit])
            for one in np.unique(level[doc]):
                here = np.flatnonzero(level[doc] == one)
                here = here[self.sketched(int(one), p)[slot[here]]]
                found.append(doc[here] * self.n + item[here])
        return np.unique(np.concatenate(found))

    def rarest(self, owner, is_known, place) -> np.ndarray:
        """Candidates by the items' rarest shingles."""
        hit = np.flatnonzero(is_known)
        hit = hit[self.rare[place[hit]]]
        doc, item, slot = self.pairs(owner[hit], place[hit])
        return np.unique((doc * self.n + item)[self.searched[slot]])


def _found(items: Items, column: pa.Array, percent: int, k: int):
    """Document, item, shared shingles, and whether the sketches named the pair, for the texts of a piece."""
    values, owner, first = shingle_sets(column, k, False)
    none = np.zeros(0, dtype=np.int64)
    if not len(values) or not len(items.known):
        return none, none, none, none.astype(bool)
    place = np.minimum(np.searchsorted(items.known, values), len(items.known) - 1)
    is_known = items.known[place] == values
    by_sketch = items.agreeing(values, owner, _level(np.diff(first)), is_known, place)
    candidates = np.union1d(by_sketch, items.rarest(owner, is_known, place))
    use = is_known & np.isin(owner, candidates // items.n)
    doc, item, _ = items.pairs(owner[use], place[use])
    pair = doc * items.n + item
    pair, shared = np.unique(pair[np.isin(pair, candidates)], return_counts=True)
    doc, item = pair // items.n, pair % items.n
    good = 100 * shared >= percent * items.size[item]
    return doc[good], item[good], shared[good], np.isin(pair[good], by_sketch)


def _search(block, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts = block.value
        searched = [(SHINGLE, Items(texts, percent))]
        searched += [(k, items) for k in range(1, SHINGLE) if len((items := Items(texts, percent, k, True)).known)]
        for batch in batches:
            for piece in pieces(batch):
                for k, items in searched:
                    doc, item, shared, by_sketch = _found(items, piece.column("text"), percent, k)
                    if len(doc):
                        yield pa.record_batch(
                            [
                                piece.column("doc_id").take(pa.array(doc)),
                                piece.column("key").take(pa.array(doc)),
                                pa.array([ids[i] for i in item], pa.int64()),
                                pa.array(items.size[item].astype(np.int64)),
                                pa.array(shared.astype(np.int64)),
                                pa.array(by_sketch),
                            ],
                            names=["doc_id", "key", "item_id", "n_item", "n_shared", "sketched"],
                        )

    return run


def contained_items(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, key, item_id, n_item, n_shared, sketched``: each document row with each item that it contains; ``sketched`` says that the sketches alone name the pair.

    Sets are distinct five-word shingles, A-Z in lower case; an item is contained if ``100 * shared >= percent * n_item``. An item of one to four
    words is one shingle, contained where its words follow each other. ``items`` has ``item_id`` (may be null or repeated: each row is an item) and ``text``.

    Null, empty and blank texts have no shingles: such items are found nowhere, such documents contain nothing. Rows given twice appear
    twice. Other columns are not read. Without documents or items there are no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select("doc_id", text_key().alias("key"), "text")
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    blocks = -(-size // BLOCK_BYTES)
    part = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    found = None
    for i in range(blocks):
        rows = items.filter(part == i).select("item_id", "text").filter("text is not null").orderBy("item_id", "text").collect()
        block = spark.sparkContext.broadcast(([r[0] for r in rows], [r[1] for r in rows]))
        pairs = keyed.mapInArrow(_search(block, percent), PAIRS)
        found = pairs if found is None else found.unionByName(pairs)
    return spark.createDataFrame([], PAIRS) if found is None else found


def decontaminate(docs: DataFrame, items: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that contain no item, with all their columns."""
    hit = contained_items(docs, items, percent).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key")).distinct()
    return docs.join(hit, docs["doc_id"].eqNullSafe(hit["__id"]) & (text_key() == hit["__key"]), "left_anti")
