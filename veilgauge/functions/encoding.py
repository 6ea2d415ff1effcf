"""Encodings between labels, codes, bins and numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.meta import INTEGER, NULL_LABEL, OUT_OF_BINS, ColumnMeta, TableMeta

PREDICTOR_TOL = 1e-12
RANGE_TOL = 1e-8


def literal_array(values: Sequence) -> Column:
    return F.array(*[F.lit(v) for v in values])


def label_code(col: Column, labels: Sequence[str], append_null: bool = True) -> Column:
    """Position of a label in its ordered domain; unknown labels give -1.

    A null stands for the label ``NaN``, which follows the domain when it is not part of it. With
    ``append_null=False`` a null outside the domain gives -1.
    """
    domain = list(labels)
    if append_null and NULL_LABEL not in domain:
        domain.append(NULL_LABEL)
    return F.array_position(literal_array(domain), F.coalesce(col.cast("string"), F.lit(NULL_LABEL))) - 1


def code_label(code: Column, labels: Sequence[str]) -> Column:
    """Label at a code; codes outside the domain give null."""
    return F.try_element_at(literal_array(labels), F.when(code >= 0, code + 1).cast("int"))


def encode_codes(df: DataFrame, meta: TableMeta) -> DataFrame:
    meta.check(df.columns)
    return df.withColumns({c.name: label_code(F.col(c.name), c.labels) for c in meta.discrete})


def decode_codes(df: DataFrame, meta: TableMeta) -> DataFrame:
    meta.check(df.columns)
    wide = [(c.name, [*c.labels] + ([] if NULL_LABEL in c.labels else [NULL_LABEL])) for c in meta.discrete]
    return df.withColumns({name: code_label(F.col(name), domain) for name, domain in wide})


def one_hot(col: Column, labels: Sequence[str]) -> Column:
    """Array of 0.0/1.0, all zero for labels outside the domain."""
    value = F.coalesce(col.cast("string"), F.lit(NULL_LABEL))
    return F.array(*[F.when(value == lab, 1.0).otherwise(0.0) for lab in labels])


def scaled(col: Column, low: float | Column, high: float | Column, tol: float) -> Column:
    """``(x - low) / (high + tol)``: shifted by the minimum, divided by the maximum."""
    lo = low if isinstance(low, Column) else F.lit(float(low))
    hi = high if isinstance(high, Column) else F.lit(float(high))
    return (col.cast("double") - lo) / (hi + F.lit(tol))


def unscaled(value: Column, c: ColumnMeta, tol: float = RANGE_TOL, low=None, high=None) -> Column:
    lo = F.lit(float(c.low)) if low is None else low
    hi = F.lit(float(c.high)) if high is None else high
    x = value * (hi + F.lit(tol)) + lo
    return x.cast("bigint") if c.kind == INTEGER else x


def one_hot_label(block: Column, labels: Sequence[str]) -> Column:
    """Label of the first largest cell of a block."""
    return F.element_at(literal_array(labels), F.array_position(block, F.array_max(block)).cast("int"))


def ordinal_onehot_vector(meta: TableMeta) -> Column:
    """Ordinal columns as codes, categorical ones one-hot, numbers unchanged, in one array."""
    parts = []
    for c in meta.columns:
        if c.numeric:
            parts.append(F.array(F.col(c.name).cast("double")))
        elif c.kind == "Ordinal":
            parts.append(F.array(label_code(F.col(c.name), c.labels).cast("double")))
        else:
            parts.append(one_hot(F.col(c.name), c.labels))
    return F.flatten(F.array(*parts))


def code_vector(meta: TableMeta) -> Column:
    """All discrete columns as codes, numbers unchanged."""
    return F.array(
        *[
            F.col(c.name).cast("double") if c.numeric else label_code(F.col(c.name), c.labels).cast("double")
            for c in meta.columns
        ]
    )


def scaled_vector(meta: TableMeta, tol: float = PREDICTOR_TOL, ranges: dict | None = None) -> Column:
    """Predictor inputs: scaled numbers and one-hot blocks. ``ranges`` maps a column to its (low, high) columns."""
    parts = []
    for c in meta.columns:
        if c.numeric:
            low, high = (ranges or {}).get(c.name, (c.low, c.high))
            parts.append(F.array(scaled(F.col(c.name), low, high, tol)))
        else:
            parts.append(one_hot(F.col(c.name), c.labels))
    return F.flatten(F.array(*parts))


def scaled_names(meta: TableMeta) -> list[str]:
    return [n for c in meta.columns for n in ([c.name] if c.numeric else [f"{c.name}_{lab}" for lab in c.labels])]


def decode_scaled(df: DataFrame, vector: str, meta: TableMeta, tol: float = RANGE_TOL, ranges: dict | None = None):
    """Columns of the table back from a scaled vector; other columns are kept."""
    out, at = {}, 1
    for c in meta.columns:
        if c.numeric:
            low, high = (ranges or {}).get(c.name, (None, None))
            out[c.name] = unscaled(F.element_at(F.col(vector), at), c, tol, low, high)
            at += 1
        else:
            out[c.name] = one_hot_label(F.slice(F.col(vector), at, len(c.labels)), c.labels)
            at += len(c.labels)
    return df.withColumns(out)


def cut(col: Column, edges: Sequence) -> Column:
    """Label of the right-closed bin; the lowest edge, nulls and values outside give the text ``nan``."""
    expr = F.when(col.isNull() | (col <= edges[0]) | (col > edges[-1]), F.lit(OUT_OF_BINS))
    for lo, hi in zip(edges, edges[1:]):
        expr = expr.when(col <= hi, F.lit(f"({lo},{hi}]"))
    return expr.otherwise(F.lit(OUT_OF_BINS))


def bin_columns(df: DataFrame, meta: TableMeta, keep_null: bool = False) -> DataFrame:
    """Replace columns whose derived metadata has bins by their bin labels; labels are left alone."""
    kinds = dict(df.dtypes)
    todo = {}
    for c in meta.discrete:
        if c.binned and kinds[c.name] != "string":
            label = cut(F.col(f"`{c.name}`"), c.bins)
            todo[c.name] = F.when(F.col(f"`{c.name}`").isNotNull(), label) if keep_null else label
    return df.withColumns(todo) if todo else df


def _steps(col: Column, inner: Sequence, op) -> Column:
    return reduce(add, [op(col, e).cast("int") for e in inner], F.lit(0))


def bin_position(col: Column, c: ColumnMeta, n: int, right_closed: bool = False) -> Column:
    """Bin of a number inside the column's range; larger values get the last bin, smaller ones are not checked.

    For real columns the bin is computed and then corrected against the two edges next to it, which gives the same
    answer as comparing with every edge but compiles to little code. Whole-number edges may repeat, so they are compared.
    """
    if c.kind == INTEGER and not right_closed:
        return _steps(col, c.edges(n)[1:-1], lambda x, e: x >= F.lit(e))
    low, step = float(c.low), (c.high - c.low) / n
    x = col.cast("double")
    guess = F.floor((x - F.lit(low)) / F.lit(step)).cast("int")

    def edge(i: Column) -> Column:
        return F.lit(low) + i * F.lit(step)

    if right_closed:
        fixed = guess + (x > edge(guess + 1)).cast("int") - (x <= edge(guess)).cast("int")
    else:
        fixed = guess + (x >= edge(guess + 1)).cast("int") - (x < edge(guess)).cast("int")
    return F.least(F.greatest(fixed, F.lit(0)), F.lit(n - 1))


def left_closed_bin(col: Column, c: ColumnMeta, n: int) -> Column:
    """Bin of a number as generators see it: below the range -1, above it the last bin, null stays null."""
    return F.when(col < F.lit(c.low), F.lit(-1)).when(col.isNotNull(), bin_position(col, c, n))


def right_closed_bin(col: Column, c: ColumnMeta, n: int) -> Column:
    """Bin of a number as histogram features see it: the lowest edge belongs to bin 0, outside gives null."""
    return F.when((col >= F.lit(c.low)) & (col <= F.lit(c.high)), bin_position(col, c, n, right_closed=True))


def edge_array(low: Column, high: Column, n: int, integer: bool) -> Column:
    """Equal-width edges between two columns, for ranges that differ per table."""
    step = (high - low) / F.lit(float(n))
    edges = F.transform(
        F.sequence(F.lit(0), F.lit(n)), lambda i: F.when(i == n, high).otherwise(low + i.cast("double") * step)
    )
    return F.transform(edges, lambda e: F.floor(F.abs(e)).cast("double") * F.signum(e)) if integer else edges


def bin_by_array(col: Column, edges: Column) -> Column:
    """:func:`left_closed_bin` for edges held in an array column."""
    inner = F.slice(edges, F.lit(2), F.size(edges) - 2)
    return F.when(
        col.isNotNull(),
        F.when(col < F.element_at(edges, 1), F.lit(-1)).otherwise(F.size(F.filter(inner, lambda e: e <= col))),
    )


def camel(col: Column) -> Column:
    """``a_b`` or ``a-b`` to ``AB`` with capitals; names without a separator stay as they are."""

    def joined(sep: str) -> Column:
        def capital(s: Column) -> Column:
            return F.concat(F.upper(F.substring(s, 1, 1)), F.lower(s.substr(F.lit(2), F.length(s))))

        return F.array_join(F.transform(F.split(col, sep), capital), "")

    return F.when(F.contains(col, F.lit("_")), joined("_")).when(F.contains(col, F.lit("-")), joined("-")).otherwise(col)
