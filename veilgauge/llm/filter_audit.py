"""How five filters interact: the Hart-Mas-Colell potential of the removal game.

A coalition is a set of filters; its worth is the number of documents that at least one of them fails. The potential is found by
recursion over the 32 coalitions, ``P(S) = (worth(S) + sum of P(S without i)) / |S|``, and a filter's Shapley value is the potential of
all filters minus that of all but this one. What a filter removes at a step of any order is the difference of two worths, so no
order is ever replayed on documents.

Documents become counts of failure patterns: one scan judges each text, rows that share a text are counted by partial aggregates, and what
is left are at most 32 patterns for each part. All numbers are whole: the potential is scaled by 5! so that no division leaves a rest.
"""

from __future__ import annotations

import math
from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LETTERS = "ABCDE"
ALL = 2 ** len(LETTERS) - 1
SCALE = math.factorial(len(LETTERS))
GAMES = ("n", "good", "toxic")
SPACE = r"[\x20\x09-\x0D]+"
NO_ID = -(2**63)


def text_failures(text: Column) -> Column:
    """Bits of the filters that look at one text. A: under 200 words; B: fewer than half of the words are different; C: over 3% of the
    characters are A-Z; D: holds one of ``#$%&*|``."""
    words = F.filter(F.split(text, SPACE), lambda w: w != "")

    def judge(w: Column) -> Column:
        few = F.size(w) < 200
        alike = 100 * F.size(F.array_distinct(w)) < 50 * F.size(w)
        upper = 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text)
        signs = text.rlike(r"[#$%&*|]")
        return sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate((few, alike, upper, signs))), F.lit(0))

    return F.element_at(F.transform(F.array(words), judge), 1)


def failure_patterns(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, pattern, good, toxic, n``: documents by part, failed filters and labels.

    E is failed by a text that a smaller ``doc_id`` also has, in whatever part. Rows of a text are first counted by id, then by part, so that a
    text which a third of all documents share is summed where it is read.
    """
    text = F.coalesce("text", F.lit(""))
    facts = docs.select(
        "doc_id", F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"), text_failures(text).alias("bits")
    )
    marks = labels.filter("doc_id is not null").groupBy("doc_id").agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    # Rows without an id have no label. They are spread by their text instead of meeting under one key.
    facts = facts.withColumns({"__id": F.coalesce("doc_id", F.xxhash64("h")), "__none": F.col("doc_id").isNull()})
    marks = marks.select(F.col("doc_id").alias("__id"), F.lit(False).alias("__none"), "good", "toxic")
    by = ["h", "part", "bits", "good", "toxic"]
    rows = facts.join(marks, ["__id", "__none"], "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("good", "toxic")})
    ids = rows.groupBy("__id", "__none", *by).agg(F.count("*").alias("n"))
    ids = ids.withColumn("id", F.when(F.col("__none"), F.lit(NO_ID)).otherwise(F.col("__id")))
    texts = ids.groupBy(*by).agg(F.sum("n").alias("n"), F.min("id").alias("id"), F.min_by("n", "id").alias("n_first"), F.count("*").alias("ids"))
    least = F.min("id").over(Window.partitionBy("h"))
    texts = texts.withColumn("first", F.when(F.col("id") == least, F.col("n_first")).otherwise(0))
    shares = F.array(F.struct(F.col("bits").alias("pattern"), F.col("first").alias("n")), F.struct((F.col("bits") + 16).alias("pattern"), (F.col("n") - F.col("first")).alias("n")))
    split = texts.select("part", "good", "toxic", F.explode(shares).alias("s")).select("part", "s.pattern", "good", "toxic", "s.n").filter("n > 0")
    return split.groupBy("part", "pattern", "good", "toxic").agg(F.sum("n").alias("n"))


def coalition_worths(patterns: DataFrame) -> DataFrame:
    """``part, docs, n, good, toxic``: for each part the number of documents, and for each of three games (all, good, toxic documents) an array of the
    worths of coalitions 0 to 31, bit *i* standing for filter *i*."""
    counted = {"n": F.col("n"), "good": F.when(F.col("good"), F.col("n")).otherwise(0), "toxic": F.when(F.col("toxic"), F.col("n")).otherwise(0)}
    cells = patterns.groupBy("part", "pattern").agg(*[F.sum(v).alias(g) for g, v in counted.items()])
    listed = cells.groupBy("part").agg(F.sum("n").alias("docs"), F.collect_list(F.struct("pattern", *GAMES)).alias("cells"))

    def worths(game: str) -> Column:
        def worth(s: Column) -> Column:
            return F.aggregate("cells", F.lit(0).cast("long"), lambda acc, c: acc + F.when(c["pattern"].bitwiseAND(s) != 0, c[game]).otherwise(0))

        return F.transform(F.sequence(F.lit(0), F.lit(ALL)), worth)

    return listed.select("part", "docs", *[worths(g).alias(g) for g in GAMES])


def potential(worth: Column) -> Column:
    """``SCALE`` times the potential of coalitions 0 to 31, each from those with one filter less, which have smaller numbers."""

    def extend(known: Column, s: Column) -> Column:
        total = F.lit(SCALE) * F.element_at(worth, s + 1)
        for i in range(len(LETTERS)):
            total = total + F.when(s.bitwiseAND(F.lit(1 << i)) != 0, F.element_at(known, s - (1 << i) + 1)).otherwise(0)
        return F.concat(known, F.array((total / F.bit_count(s)).cast("long")))

    return F.aggregate(F.sequence(F.lit(1), F.lit(ALL)), F.array(F.lit(0).cast("long")), extend)


def steps(worths: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley`` for every part, order and step."""
    rows = [(order, k) for order in permutations(range(len(LETTERS))) for k in range(len(LETTERS))]
    table = F.array(
        *[
            F.struct(
                F.lit("".join(LETTERS[i] for i in order)).alias("filter_order"), F.lit(k + 1).alias("step"),
                F.lit(sum(1 << i for i in order[:k])).alias("before"), F.lit(1 << order[k]).alias("own"),
            )
            for order, k in rows
        ]
    )
    listed = worths.withColumn("potential", potential(F.col("n"))).withColumn("s", F.explode(table)).select("*", "s.*")
    after = F.col("before") + F.col("own")

    def at(game: str, coalition: Column) -> Column:
        return F.element_at(game, coalition + 1)

    removed = at("n", after) - at("n", F.col("before"))
    return listed.select(
        "part", "filter_order", "step",
        (F.col("docs") - at("n", after)).alias("kept"), removed.alias("removed"), (at("n", F.col("own")) - removed).alias("redundant"),
        (at("n", F.lit(ALL)) - at("n", F.lit(ALL) - F.col("own"))).alias("unique_fails"),
        (at("good", after) - at("good", F.col("before"))).alias("good_lost"), (at("toxic", after) - at("toxic", F.col("before"))).alias("toxic_lost"),
        (at("potential", F.lit(ALL)) - at("potential", F.lit(ALL) - F.col("own"))).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """:func:`steps` of the filters A to E on ``docs`` by ``lang``.

    ``shapley`` is the Shapley value times 120, which is what the filter removes summed over all orders.

    A null text is empty, a null language the part ``''``. A null id is smaller than all others and has no label; rows that share
    an id and a text are not copies of each other. An id labelled twice is good, or toxic, if any of its labels says so. Rows given twice count twice. Other columns are not read.
    Without documents there are no parts and no rows.
    """
    return steps(coalition_worths(failure_patterns(docs, labels)))
