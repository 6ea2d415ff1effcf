"""Mixing sources to target weights by Pareto order sampling.

A source's target gives each of its documents an expected number of copies. Its whole part is certain. The rest is drawn without
replacement: documents are ranked by their random odds divided by their inclusion odds, ``u / (1 - u) : p / (1 - p)``, and taken from
the top. The sample's fixed size is counted in words, so a source comes as near to its target as the document at the cut allows.

The random number is a digest of the document, not of its place, so reruns, retries and other partitionings agree. The cut is found
by summing words over 256 ranges of the rank, then over 256 ranges of the range that holds the cut, and so on: no source is
ever sorted or gathered, however many of the rows it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilgauge.functions.keyed import digest, uniform
from veilgauge.llm.common import free_name, staged, text_key
from veilgauge.operators.joining import attach, row_bytes

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
SEED = 42
LEVELS = (40, 32, 24)
RANK_BITS = 48


def word_count(column: str = "text") -> Column:
    return F.coalesce(F.regexp_count(column, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` from ``source, size`` rows. Sources in code point order, null last, weigh ``weights`` repeating and
    share all words; a target stops at ``most`` times its source and the excess goes to the others by weight.

    The sources that stop are the first ones by size over weight, so the repeated sharing has a closed form over running sums. The windows
    run over one row for each source.
    """
    table = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    table = table.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    room = F.lit(float(most)) * F.col("source_size")
    order = Window.orderBy(room / F.col("w"), F.col("source").asc_nulls_last())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    table = (
        table.withColumn("room", room)
        .withColumn("total", F.sum("source_size").over(everything).cast("double"))
        .withColumn("used", F.coalesce(F.sum("room").over(before), F.lit(0.0)))
        .withColumn("others", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("full", F.col("room") * F.col("others") <= F.col("w") * (F.col("total") - F.col("used")))
        .withColumn("full_room", F.sum(F.when(F.col("full"), F.col("room")).otherwise(0.0)).over(everything))
        .withColumn("open_weight", F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("w"))).over(everything))
    )
    share = F.col("w") * (F.col("total") - F.col("full_room")) / F.nullif(F.col("open_weight"), F.lit(0.0))
    return table.select("source", "source_size", F.when(F.col("full"), F.col("room")).otherwise(share).alias("target"))


def _beside(rows: DataFrame, table: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join with a table of one row for each source, on keys of which nulls are equal. The table is measured first: as long as it is small, which
    hundred thousands of sources are, the rows stay where they are, so that no source gathers in a task."""
    table = staged(table)
    n, size = table.agg(F.count("*"), F.sum(row_bytes(table))).first()
    return attach(rows, table, keys, how, bound=n, width=-(-(size or 0) // max(n, 1)))


def _copies(rows: DataFrame, most: int) -> DataFrame:
    """Adds ``copies``, the expected number: ``target / source_size`` times the document's relative weight, never above ``most``;
    what a stopped document leaves goes to the others of its source by weight, until none is above."""
    rows = rows.withColumn("stopped", F.lit(False))
    while True:
        left = rows.groupBy("source", "target").agg(
            F.sum(F.when(F.col("stopped"), F.lit(0.0)).otherwise(F.col("weight") * F.col("size"))).alias("open"),
            F.sum(F.when(F.col("stopped"), F.lit(float(most)) * F.col("size")).otherwise(0.0)).alias("taken"),
        )
        rate = F.when(F.col("open") > 0, F.greatest(F.col("target") - F.col("taken"), F.lit(0.0)) / F.col("open")).otherwise(0.0)
        rated = _beside(rows, left.select("source", rate.alias("rate")), ["source"])
        rated = rated.withColumn("copies", F.when(F.col("stopped"), F.lit(float(most))).otherwise(F.col("rate") * F.col("weight")))
        above = F.col("copies") > most
        if rated.filter(above & ~F.col("stopped")).isEmpty():
            return rated.drop("rate", "stopped")
        rows = staged(rated.withColumn("stopped", F.col("stopped") | above).drop("rate", "copies"))


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = SEED, document_weight: str | None = None
) -> DataFrame:
    """``doc_id, key, size, source, source_size, target, copies, taken``: one row for each row of ``docs``; ``copies`` is how often the mix
    takes the document, ``taken`` the words of all its copies.

    ``document_weight`` names a column of positive numbers that makes documents of one source more or less likely; without it they
    are alike. Without limits that bind, a source's words differ from its target by at most half of the document at the cut.

    Null and empty texts have size 0 and take no words. A null source is a source, the last one. Documents with null ids, ids
    given twice and equal rows are drawn by id and text; among equal rows any one may be the last taken. A null document weight
    counts as 1. Other columns are not read. No rows in, no rows out.
    """
    weight = F.lit(1.0) if document_weight is None else F.coalesce(F.col(document_weight).cast("double"), F.lit(1.0))
    number = uniform(digest(seed, "pareto", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.md5(F.coalesce("text", F.lit("")))))
    rows = staged(docs.select("doc_id", text_key().alias("key"), "source", word_count().alias("size"), weight.alias("weight"), number.alias("u")))
    rows = _copies(_beside(rows, source_targets(rows.select("source", "size"), weights, most), ["source"]), most)
    whole = F.floor("copies")
    part = F.col("copies") - whole
    odds = F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")
    rows = rows.withColumn("whole", whole).withColumn("p", part)
    rows = rows.withColumn("rank", F.when(F.col("p") > 0, F.floor(odds / (1 + odds) * F.lit(float(2**RANK_BITS)))))
    rows = staged(rows.drop("weight", "u"))
    budget = rows.groupBy("source", "target").agg(F.sum(F.col("whole") * F.col("size")).alias("certain"))
    cut = budget.select("source", (F.col("target") - F.col("certain")).alias("budget"), F.lit(0.0).alias("base"), F.lit(0).cast("long").alias("head"))
    drawn = rows.filter("rank is not null").select("source", "size", "rank")
    for shift in LEVELS:
        prefix = F.shiftright("rank", shift)
        inside = _beside(drawn, cut, ["source"]).filter(F.shiftright(prefix, 8) == F.col("head"))
        ranges = inside.groupBy("source", "budget", "base", prefix.alias("range")).agg(F.sum("size").alias("words"))
        upto = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
        ranges = ranges.withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(upto), F.lit(0)))
        # The last range that begins within the budget; all before it lie within.
        last = ranges.filter(F.col("base") <= F.col("budget")).groupBy("source", "budget").agg(F.max(F.struct("range", "base")).alias("c"))
        cut = staged(last.select("source", "budget", F.col("c.base").alias("base"), F.col("c.range").alias("head")))
    marked = _beside(rows, cut.select("source", "budget", "base", "head"), ["source"], "left")
    place = F.shiftright("rank", LEVELS[-1])
    at_cut = marked.filter(place == F.col("head"))
    order = Window.partitionBy("source", "head").orderBy("rank", "doc_id", "key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    at_cut = at_cut.withColumn("more", (before + F.col("size") / 2 <= F.col("budget")).cast("long"))
    rest = marked.filter(~F.coalesce(place == F.col("head"), F.lit(False)))
    rest = rest.withColumn("more", F.coalesce((place < F.col("head")).cast("long"), F.lit(0)))
    both = rest.unionByName(at_cut).withColumn("copies", F.col("whole") + F.col("more"))
    return both.select("doc_id", "key", "size", "source", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, with all their columns, each as often as the mix takes it."""
    taken = mix(docs, **options).select(F.col("doc_id").alias("__id"), F.col("key").alias("__key"), F.col("copies").alias("__copies"))
    # Equal rows share their copies: the sum over them, dealt out evenly again, keeps the mix as it is.
    taken = taken.groupBy("__id", "__key").agg(F.sum("__copies").alias("__sum"), F.count("*").alias("__rows")).filter("__sum > 0")
    each = F.when(F.col("__rows") == 1, F.col("__sum")).otherwise(F.floor((F.col("__sum") + F.col("__rows") - 1) / F.col("__rows")))
    copy = free_name(docs, "copy")
    taken = taken.select("__id", "__key", F.sequence(F.lit(1), each.cast("int")).alias(copy))
    joined = docs.join(taken, docs["doc_id"].eqNullSafe(taken["__id"]) & (text_key() == taken["__key"]))
    return joined.select(*[docs[c] for c in docs.columns], F.explode(taken[copy]).alias(copy)).drop(copy)
