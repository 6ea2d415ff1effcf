"""Conversations that begin alike: a z-fast trie over sequences of turns, built in batches of Spark joins.

**Names.** A turn is a digest of its role and text. A prefix is named by a chain of digests, so equal names mean equal prefixes and a conversation is one
packed string of 16 bytes for each turn. Texts are read once and never shuffled.

**Trie.** Compacted nodes are prefixes at which conversations part or end. A node whose edge covers the depths ``(p, e]`` is hashed by its *handle*, the
name of its prefix at the two-fattest depth in ``(p, e]``, the one divisible by the largest power of two. The deepest node on a conversation's way is
found by fat binary search: a probe of the two-fattest depth of the interval that is left, one join for all conversations
at once, which halves the interval. One more join with the edges that leave this node gives the exit node and the depth at which the conversation leaves it.

**Insertion in batches.** Each batch is located in the trie of the batches before it. Conversations that leave it at the same depth with the same next turn then
form a group; the group's smallest hash becomes one new path, the others are compared with it and leave it further down, where they form smaller
groups. The choice is random, so a conversation takes about the logarithm of its group's size in rounds, also if a third of all conversations begin alike. No group
is ever gathered: the path is a minimum, the comparison a join.

**Storage.** A path is written once, as the segment below the depth where it left the trie; nodes split it by depth and nothing is rewritten. The nodes
of a batch are cut out of the segments when the next batch comes. At the end edges are expanded into one row for each distinct prefix.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.llm.common import discard, staged

NAME = 16
# Upper ends of the batches in 64ths of the conversations.
BATCHES = (1, 8, 64)
HEADS, EVERY = 6, 100
TURN = "struct<k: binary, n: long>"
PATH = "array<struct<seg: long, depth: int>>"


def turn_lists(conversations: DataFrame) -> DataFrame:
    """``conv_id, turns``: for each conversation its turns in order, as digests ``k`` of role and text with the text's code points ``n``.

    Turns are ordered by ``turn``, null first; ties by digest, so equal rows stay turns of their own. Null roles and texts are empty. Rows
    without ``conv_id`` belong to no conversation and are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    key = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.filter("conv_id is not null").select("conv_id", F.struct("turn", key.alias("k"), F.length(text).cast("long").alias("n")).alias("t"))
    listed = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda t: F.struct(t["k"].alias("k"), t["n"].alias("n"))).alias("turns"))


def with_shared_heads(turns: DataFrame, heads: int = HEADS, every: int = EVERY) -> DataFrame:
    """Conversations whose first ``h`` turns are those of conversation ``c - c % every`` (all if it has fewer, none if there is no such
    conversation), followed by their own turns after the first ``h``; ``h`` is the CRC-32 of the decimal id modulo ``heads``."""
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    own = turns.withColumns({"h": h, "base": F.col("conv_id") - F.col("conv_id") % every})
    first = turns.filter(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("base"), F.slice("turns", 1, heads - 1).alias("head"))
    both = own.join(first, "base", "left")
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(f"array<{TURN}>"))
    rest = F.filter("turns", lambda _, i: i >= F.col("h"))
    return both.select("conv_id", F.concat(head, rest).alias("turns"))


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Packed prefix names and code points of each conversation."""
    for batch in batches:
        turns = batch.column("turns")
        ends = np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))
        flat = turns.flatten()
        keys = flat.field("k").to_pylist()
        chars = flat.field("n").to_numpy(zero_copy_only=False).astype("<i8")
        packed, sizes, names, at = [], [], [], 0
        for end in ends.tolist():
            name, out = b"", []
            for key in keys[at:end]:
                name = hashlib.blake2b(name + key, digest_size=NAME).digest()
                out.append(name)
            packed.append(b"".join(out))
            names.append(name)
            sizes.append(chars[at:end].tobytes())
            at = end
        length = turns.value_lengths().cast(pa.int32())
        yield pa.record_batch(
            [batch.column("conv_id"), pa.array(names, pa.binary()), length, pa.array(packed, pa.binary()), pa.array(sizes, pa.binary())],
            names=["conv_id", "name", "len", "h", "chars"],
        )


def _digest_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the ids of each name, comma-joined; rows come sorted by name and id. Only the state of one digest is held."""
    name, state = None, None
    for batch in batches:
        names, ids = batch.column("name").to_pylist(), batch.column("conv_id").to_pylist()
        done, at = ([], []), 0
        cuts = [i for i in range(1, len(names)) if names[i] != names[i - 1]]
        for end in [*cuts, len(names)] if names else []:
            said = ",".join(map(str, ids[at:end])).encode()
            if state is not None and names[at] == name:
                state.update(b"," + said)
            else:
                if state is not None:
                    done[0].append(name)
                    done[1].append(state.hexdigest())
                name, state = names[at], hashlib.sha256(said)
            at = end
        yield pa.record_batch([pa.array(done[0], pa.binary()), pa.array(done[1], pa.string())], names=["name", "ends"])
    if state is not None:
        yield pa.record_batch([pa.array([name], pa.binary()), pa.array([state.hexdigest()], pa.string())], names=["name", "ends"])


def sequences(turns: DataFrame) -> DataFrame:
    """``seg, len, h, chars, n, ends``: each distinct sequence of turns once, named by its smallest ``conv_id``; ``n`` conversations have it and
    ``ends`` digests their ids. Conversations that are equal as a whole are counted where they are read; only their ids meet, sorted, in one stream."""
    named = staged(turns.mapInArrow(_names, "conv_id long, name binary, len int, h binary, chars binary"))
    one = named.groupBy("name").agg(F.min("conv_id").alias("seg"), F.count("*").alias("n"))
    ids = named.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = ids.mapInArrow(_digest_ids, "name binary, ends string")
    known = one.join(ends, "name").select(F.col("seg").alias("conv_id"), "n", "ends")
    return staged(named.join(known, "conv_id").select(F.col("conv_id").alias("seg"), "len", "h", "chars", "n", "ends"))


def _block(packed: Column | str, depth: Column) -> Column:
    """Name at a depth (from 1) of a packed string."""
    return F.substring(packed, (depth - 1) * NAME + 1, F.lit(NAME))


def two_fattest(above: Column, depth: Column) -> Column:
    """The number in ``(above, depth]`` divisible by the largest power of two."""
    bit = F.length(F.bin(above.bitwiseXOR(depth))) - 1
    return depth - F.pmod(depth, F.pow(F.lit(2.0), bit).cast("int"))


def _agree(x: Column, y: Column, most: Column, bits: int) -> Column:
    """How many of ``most`` names two packed strings share at their beginning. Names are chained, so one equal name means equal names before it."""

    def longer(known: Column, step: Column) -> Column:
        tried = known + step
        return F.when((tried <= most) & (_block(x, tried) == _block(y, tried)), tried).otherwise(known)

    return F.aggregate(F.array(*[F.lit(1 << i) for i in range(bits, -1, -1)]), F.lit(0), longer)


def _tail(packed: Column | str, depth: Column) -> Column:
    """Names below a depth."""
    return F.substring(packed, depth * NAME + 1, F.length(packed))


def _step(seg: Column, depth: Column) -> Column:
    return F.array(F.struct(seg.cast("long").alias("seg"), depth.cast("int").alias("depth")))


@dataclass(frozen=True)
class Trie:
    """``segments``: seg (the sequence written), start, len, path (segments and depths at which its ancestors were left), h (names below start).
    ``ended``: seg of each sequence with the path to its end (empty: the root). ``bits``: binary digits of the greatest depth."""

    sequences: DataFrame
    segments: DataFrame
    ended: DataFrame
    bits: int


def compacted(segments: DataFrame, ended: DataFrame) -> DataFrame:
    """One row for each compacted node but the root: ``seg, path`` of its segment, edge ``(p, e]``, ``handle``, ``extent`` (name at ``e``), ``first``
    (name at ``p + 1``) and ``edge``, the packed names between."""
    ends = ended.filter(F.size("path") > 0).select(F.try_element_at("path", F.lit(-1)).alias("s"))
    left = segments.filter(F.size("path") > 0).select(F.try_element_at("path", F.lit(-1)).alias("s"))
    splits = ends.unionByName(left).select("s.seg", "s.depth").distinct().groupBy("seg").agg(F.sort_array(F.collect_list("depth")).alias("depths"))
    rows = segments.join(splits, "seg")
    lower = F.concat(F.array("start"), F.slice("depths", F.lit(1), F.size("depths") - 1))
    rows = rows.withColumn("cut", F.explode(F.arrays_zip(lower.alias("p"), F.col("depths").alias("e")))).select("seg", "path", "start", "h", "cut.p", "cut.e")
    fat = two_fattest(F.col("p"), F.col("e"))
    return rows.select(
        "seg", "path", "start", "p", "e", _block("h", fat - F.col("start")).alias("handle"), _block("h", F.col("e") - F.col("start")).alias("extent"),
        _block("h", F.col("p") - F.col("start") + 1).alias("first"),
        F.substring("h", (F.col("p") - F.col("start")) * NAME + 1, (F.col("e") - F.col("p")) * NAME).alias("edge"),
    )


def locate(nodes: DataFrame, asked: DataFrame, bits: int) -> DataFrame:
    """``asked`` (``seg, len, h`` and other columns) with ``at``, the depth to which the trie knows the sequence, and ``path`` to that place.

    ``bits`` rounds of fat binary search over the handles, each one join, then one join with the edges that leave the node found. Probes of
    sequences that have arrived carry the sequence's own last name, which spreads them.
    """
    handles = nodes.select(
        "handle", F.col("p").alias("__p"), F.col("e").alias("__e"), "extent",
        F.concat("path", _step(F.col("seg"), F.col("e"))).alias("__to_e"),
        F.when(F.col("p") > F.col("start"), F.concat("path", _step(F.col("seg"), F.col("p")))).otherwise(F.col("path")).alias("__to_p"),
    )
    columns = asked.columns
    rows = asked.withColumns({"a": F.lit(0), "b": F.col("len"), "path": F.array().cast(PATH)})
    last = _block("h", F.greatest("len", F.lit(1)))
    for _ in range(bits + 1):
        open_ = F.col("a") < F.col("b")
        fat = two_fattest(F.col("a"), F.when(open_, F.col("b")).otherwise(F.col("a") + 1))
        rows = rows.withColumns({"__f": F.when(open_, fat), "__probe": F.when(open_, _block("h", fat)).otherwise(last)})
        found = rows.join(handles, F.col("__probe") == F.col("handle"), "left")
        hit = F.col("__f").isNotNull() & F.col("handle").isNotNull()
        whole = hit & (F.col("__e") <= F.col("len")) & (_block("h", F.col("__e")) == F.col("extent"))
        rows = found.select(
            *columns,
            F.when(whole, F.col("__e")).when(hit, F.col("__p")).otherwise(F.col("a")).alias("a"),
            F.when(whole, F.col("b")).when(hit, F.col("__p")).when(F.col("__f").isNotNull(), F.col("__f") - 1).otherwise(F.col("b")).alias("b"),
            F.when(whole, F.col("__to_e")).when(hit, F.col("__to_p")).otherwise(F.col("path")).alias("path"),
        )
    edges = nodes.select("first", F.col("p").alias("__p"), F.col("e").alias("__e"), F.col("seg").alias("__seg"), F.col("path").alias("__path"), "edge")
    more = F.col("a") < F.col("len")
    rows = rows.withColumn("__next", F.when(more, _block("h", F.col("a") + 1)).otherwise(last))
    found = rows.join(edges, F.col("__next") == F.col("first"), "left")
    on_edge = more & F.col("first").isNotNull()
    agreed = _agree(_tail("h", F.col("a")), F.col("edge"), F.least(F.col("len"), F.col("__e")) - F.col("a"), bits)
    # Where the edge belongs to the segment of the node above it, the place on it replaces that node in the path.
    at = F.when(on_edge, F.col("a") + agreed).otherwise(F.col("a"))
    place = F.concat("__path", _step(F.col("__seg"), at))
    return found.select(*columns, at.alias("at"), F.when(on_edge, place).otherwise(F.col("path")).alias("path"))


def _insert(rows: DataFrame, bits: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Put located sequences (``seg, len, h, at, path``) into the trie: new segments and ended sequences."""
    segments, ended = [], [rows.filter("at = len").select("seg", "path")]
    active = rows.filter("at < len")
    while not active.isEmpty():
        active = active.withColumn("next", _block("h", F.col("at") + 1))
        order = F.struct(F.xxhash64("seg").alias("order"), "seg", "len", "h")
        ways = active.groupBy("next").agg(F.min(order).alias("w")).select(
            "next", F.col("w.seg").alias("__seg"), F.col("w.len").alias("__len"), F.col("w.h").alias("__h")
        )
        both = active.join(ways, "next")
        shared = F.col("at") + _agree(_tail("h", F.col("at")), _tail("__h", F.col("at")), F.least("len", "__len") - F.col("at"), bits)
        turn = staged(
            both.withColumn("to", shared).select(
                "seg", "len", "h", "at", "path", "to", (F.col("seg") == F.col("__seg")).alias("way"), F.concat("path", _step(F.col("__seg"), F.col("to"))).alias("new")
            )
        )
        segments.append(turn.filter("way").select("seg", F.col("at").alias("start"), "len", "path", _tail("h", F.col("at")).alias("h")))
        ended.append(turn.filter("to = len").select("seg", F.col("new").alias("path")))
        active = turn.filter("to < len").select("seg", "len", "h", F.col("to").alias("at"), F.col("new").alias("path"))
    return segments, ended


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def build(turns: DataFrame) -> Trie:
    """The trie of conversations ``conv_id, turns``, inserted in batches of growing size, each located in what is there already."""
    known = sequences(turns)
    deepest = known.agg(F.max("len")).first()[0] or 0
    bits = max(int(deepest).bit_length(), 1)
    none = known.filter("false")
    segments = [none.select("seg", F.lit(0).alias("start"), "len", F.array().cast(PATH).alias("path"), "h")]
    ended = [none.select("seg", F.array().cast(PATH).alias("path"))]
    slot = F.pmod(F.xxhash64("seg", F.lit("batch")), F.lit(BATCHES[-1]))
    asked = known.select("seg", "len", "h", slot.alias("slot"))
    for low, high in zip((0, *BATCHES[:-1]), BATCHES):
        batch = asked.filter((F.col("slot") >= low) & (F.col("slot") < high)).drop("slot")
        if low == 0:
            rows = batch.withColumns({"at": F.lit(0), "path": F.array().cast(PATH)})
        else:
            nodes = staged(compacted(_all(segments), _all(ended)))
            rows = locate(nodes, batch, bits)
        rows = staged(rows)
        new, done = _insert(rows, bits)
        segments, ended = segments + new, ended + done
        if low:
            discard(nodes)
    return Trie(known, staged(_all(segments)), staged(_all(ended)), bits)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each depth of a segment, from what ends on it and leaves it at each depth."""
    names = ("at", "n", "least", "leaves", "children", "saved", "ends")
    for batch in batches:
        for row in batch.select(["seg", "start", "len", "chars", "events"]).to_pylist():
            size = row["len"] - row["start"]
            chars = np.frombuffer(row["chars"], dtype="<i8")[row["start"] :]
            cells = {c: [e[c] for e in row["events"]] for c in names}
            at = np.array(cells["at"], dtype=np.int64) - row["start"] - 1
            own = {c: np.zeros(size, dtype=np.int64) for c in ("n", "leaves", "children", "saved")}
            for c, into in own.items():
                into[at] = cells[c]
            least = np.full(size, np.iinfo(np.int64).max)
            least[at] = cells["least"]
            below = {c: np.cumsum(v[::-1])[::-1] for c, v in own.items()}
            least = np.minimum.accumulate(least[::-1])[::-1]
            saved = np.cumsum(((below["n"] - 1) * chars)[::-1])[::-1] + below["saved"]
            children = own["children"] + (np.arange(size) < size - 1)
            ends = [None] * size
            for i, e in zip(at.tolist(), cells["ends"]):
                ends[i] = e
            yield pa.record_batch(
                [
                    pa.array(np.full(size, row["seg"])), pa.array(np.arange(row["start"] + 1, row["len"] + 1)), pa.array(least),
                    pa.array(np.concatenate([[0], least[:-1]]), mask=np.arange(size) == 0), pa.array(below["n"]), pa.array(children),
                    pa.array(below["leaves"]), pa.array(saved), pa.array(ends, pa.string()),
                ],
                names=["seg", "depth", "conv_id", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"],
            )


NODE = "seg long, depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
NOBODY = hashlib.sha256(b"").hexdigest()


def _spared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Code points that the members of a segment's depths share, summed over the segment."""
    for batch in batches:
        out = []
        for row in batch.select(["start", "len", "chars", "events"]).to_pylist():
            n = np.zeros(row["len"] - row["start"], dtype=np.int64)
            for e in row["events"]:
                n[e["at"] - row["start"] - 1] += e["n"]
            chars = np.frombuffer(row["chars"], dtype="<i8")[row["start"] :]
            out.append(int(((np.cumsum(n[::-1])[::-1] - 1) * chars).sum()))
        yield pa.record_batch([batch.column("seg"), batch.column("path"), pa.array(out, pa.int64())], names=["seg", "path", "saved"])


def nodes(trie: Trie) -> DataFrame:
    """One row for each distinct prefix, the empty one included: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (null for the root),
    ``n_convs`` (conversations that begin with it), ``n_children``, ``n_leaves`` (prefixes without children in its subtree), ``saved_tokens`` (over the
    subtree, members but one times code points of the last text) and ``ends_sha256`` (over the decimal ids of the conversations that it is the whole of).

    What ends at a place counts for every place above it on the segments of its path, which are about as many as the logarithm of the number of conversations:
    so sums over subtrees are one aggregate, at whatever depth the trie branches. A segment's sums over its own depths are made where its row is.

    Conversations without turns are members of the root alone. Without conversations there are no rows, not even the root.
    """
    ended = trie.ended.join(trie.sequences.select("seg", "n", "ends"), "seg")
    left = trie.segments.filter(F.size("path") > 0).select(F.try_element_at("path", F.lit(-1)).alias("s")).select("s.seg", F.col("s.depth").alias("at"))
    tips = trie.segments.select("seg", F.col("len").alias("at"))
    leaves = tips.join(left.distinct(), ["seg", "at"], "left_anti").select("seg", F.lit(1).alias("leaf"))
    ended = staged(ended.join(leaves, "seg", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0)).cast("long")))
    zero = F.lit(0).cast("long")
    last = F.col("i") == F.size("path") - 1
    met = ended.select("seg", "n", "ends", "leaf", "path", F.posexplode("path").alias("i", "s")).select(
        F.col("s.seg").alias("on"), F.col("s.depth").alias("at"), "n", F.col("seg").alias("least"), F.col("leaf").alias("leaves"), zero.alias("children"),
        F.when(last, F.col("ends")).alias("ends"),
    )
    hung = left.select(F.col("seg").alias("on"), "at", zero.alias("n"), F.lit(None).cast("long").alias("least"), zero.alias("leaves"), F.lit(1).cast("long").alias("children"), F.lit(None).cast("string").alias("ends"))
    places = staged(
        met.unionByName(hung).groupBy("on", "at").agg(
            F.sum("n").alias("n"), F.min("least").alias("least"), F.sum("leaves").alias("leaves"), F.sum("children").alias("children"), F.max("ends").alias("ends")
        )
    )
    chars = trie.sequences.select("seg", "chars")
    listed = places.groupBy(F.col("on").alias("seg")).agg(F.collect_list(F.struct("at", "n")).alias("events"))
    spared = trie.segments.select("seg", "start", "len", "path").join(chars, "seg").join(listed, "seg")
    spared = staged(spared.mapInArrow(_spared, f"seg long, path {PATH}, saved long"))
    passed = spared.select("saved", F.explode("path").alias("s")).select(F.col("s.seg").alias("on"), F.col("s.depth").alias("at"), "saved")
    passed = passed.groupBy("on", "at").agg(F.sum("saved").alias("saved"))
    events = places.join(passed, ["on", "at"], "left").withColumn("saved", F.coalesce("saved", zero))
    events = events.groupBy(F.col("on").alias("seg")).agg(F.collect_list(F.struct("at", "n", "least", "leaves", "children", "saved", "ends")).alias("events"))
    rows = trie.segments.select("seg", "start", "len").join(chars, "seg").join(events, "seg")
    found = staged(rows.mapInArrow(_expand, NODE))

    top = ended.agg(F.sum("n").alias("n_convs"), F.min("seg").alias("conv_id"), F.sum("leaf").alias("n_leaves"), F.max(F.when(F.size("path") == 0, F.col("ends"))).alias("ends_sha256"))
    first = trie.segments.filter(F.size("path") == 0).agg(F.count("*").alias("n_children"))
    saved = spared.agg(F.coalesce(F.sum("saved"), zero).alias("saved_tokens"))
    root = top.filter("n_convs > 0").withColumns({c: t.scalar() for c, t in (("n_children", first), ("saved_tokens", saved))})
    root = root.withColumns({"depth": zero, "parent_conv_id": F.lit(None).cast("long"), "n_leaves": F.greatest("n_leaves", F.lit(1).cast("long"))})

    # The first depth of a segment has its parent on another one, or in the root.
    heads = found.join(trie.segments.select("seg", (F.col("start") + 1).cast("long").alias("depth"), "path"), ["seg", "depth"], "left")
    inner = heads.filter("path is null")
    under_root = heads.filter("size(path) = 0").withColumn("parent_conv_id", top.select("conv_id").scalar())
    above = found.select(F.col("seg").alias("__seg"), F.col("depth").alias("__depth"), F.col("conv_id").alias("__parent"))
    hung = heads.filter("size(path) > 0").withColumn("s", F.try_element_at("path", F.lit(-1)))
    hung = hung.join(above, (F.col("s.seg") == F.col("__seg")) & (F.col("s.depth") == F.col("__depth"))).withColumn("parent_conv_id", F.col("__parent"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    out = _all([part.select(columns) for part in (root, inner, under_root, hung)])
    return out.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NOBODY)))
