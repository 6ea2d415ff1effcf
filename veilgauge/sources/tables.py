"""Loading typed tables and profiling tables into metadata."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilgauge.functions.encoding import decode_codes, literal_array
from veilgauge.meta import CATEGORICAL, FLOAT, INTEGER, ORDINAL, ColumnMeta, TableMeta
from veilgauge.operators.counts import label_counts
from veilgauge.operators.joining import attach, hold

DRIVER_LABELS = 100_000


def typed(df: DataFrame, meta: TableMeta, keep: Sequence[str] = ()) -> DataFrame:
    """Cast to the metadata's types. NaN becomes null, since it would rank as the largest number."""
    meta.check(df.columns)
    out = []
    for c in meta.columns:
        col = F.col(f"`{c.name}`")
        if c.kind == FLOAT:
            x = col.cast("double")
            out.append(F.when(~F.isnan(x), x).alias(c.name))
        elif c.kind == INTEGER:
            if dict(df.dtypes)[c.name] in ("double", "float"):
                col = F.when(~F.isnan(col), col)
            out.append(col.cast("bigint").alias(c.name))
        else:
            out.append(col.cast("string").alias(c.name))
    return df.select(*keep, *out)


def load_table(
    spark: SparkSession, path: str, meta: TableMeta, fmt: str = "csv", id_col: str | None = None, header: bool = True
) -> DataFrame:
    """Table with an ``id`` and typed columns. CSV is read with the metadata's schema, never an inferred one.

    ``id_col`` names a key column; without it ids ``ID{i}`` follow the row position in the files.
    """
    if fmt == "csv":
        if header:
            names = spark.read.option("header", True).csv(path).columns
            types = {f.name: f for f in meta.struct().fields}
            schema = T.StructType([types.get(n, T.StructField(n, T.StringType())) for n in names])
        else:
            schema = meta.struct()
        raw = spark.read.schema(schema).option("header", header).csv(path)
    elif fmt in ("parquet", "json", "orc"):
        raw = spark.read.format(fmt).load(path)
    else:
        raise ValueError(f"unknown format {fmt!r}")
    if id_col is not None:
        named = typed(raw, meta, keep=[id_col] if id_col not in meta.names else [])
        return named if id_col == "id" else named.withColumn("id", F.col(f"`{id_col}`")).select("id", *meta.names)
    return with_row_ids(raw, of_files=True).transform(lambda df: typed(df, meta, keep=["id"]))


def with_row_ids(df: DataFrame, prefix: str = "ID", of_files: bool = False) -> DataFrame:
    """``ID{i}`` by position, in place of any ``id`` column.

    Rows of each scan partition are counted, then each starts at its offset. ``of_files`` is for a frame read straight from files:
    the pieces counted are then blocks of files in the order of path and place, however a scan deals them out.
    """
    names = [c for c in df.columns if c != "id"]
    place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start")] if of_files else [F.spark_partition_id(), F.lit(0)]
    parts = [c.alias(f"__part_{i}") for i, c in enumerate(place)]
    marked = df.select(*[F.col(f"`{c}`") for c in names], *parts, F.monotonically_increasing_id().alias("__pos"))
    keys = ["__part_0", "__part_1"]
    # One row for each piece; a piece's rows are consecutive within its scan partition.
    counts = marked.groupBy(*keys).agg(F.count("*").alias("__n"), F.min("__pos").alias("__first"))
    before = Window.orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, "__first", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__off"))
    out = attach(marked, offsets, keys, "inner")
    at = F.col("__off") + F.col("__pos") - F.col("__first")
    return out.select(F.concat(F.lit(prefix), at.cast("string")).alias("id"), *[F.col(f"`{c}`") for c in names])


def union_decode(parts: Sequence[DataFrame], meta: TableMeta) -> DataFrame:
    """Coded train and test tables put together and decoded through the metadata."""
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return decode_codes(whole, meta)


def profile_columns(df: DataFrame, ordinal: Iterable[str] = (), discrete: Iterable[str] = (), max_labels: int | None = None) -> DataFrame:
    """One row per column: ``name, type, min, max, size, labels`` (labels sorted).

    With ``max_labels`` a column with more distinct labels is refused before they are gathered.
    """
    ordinal, discrete = set(ordinal), set(discrete)
    kinds: dict[str, str] = {}
    for name, t in df.dtypes:
        if name in ordinal:
            kinds[name] = ORDINAL
        elif name in discrete or t in ("string", "boolean"):
            kinds[name] = CATEGORICAL
        elif t in ("double", "float") or t.startswith("decimal"):
            kinds[name] = FLOAT
        else:
            kinds[name] = INTEGER
    order = literal_array(list(kinds))
    empty = F.lit(None)
    out = None
    labelled = [n for n, k in kinds.items() if k in (CATEGORICAL, ORDINAL)]
    numbers = [n for n in kinds if n not in labelled]
    if labelled:
        counts = hold(label_counts(df, labelled).where(F.col("label").isNotNull()))
        if max_labels is not None:
            for r in counts.groupBy("attr").agg(F.count("*").alias("n")).where(F.col("n") > max_labels).collect():
                raise ValueError(f"column {r['attr']!r} has {r['n']} labels; at most {max_labels} are asked for")
        out = counts.groupBy("attr").agg(F.sort_array(F.collect_list("label")).alias("labels")).select(
            F.col("attr").alias("name"), empty.cast("double").alias("min"), empty.cast("double").alias("max"),
            F.size("labels").alias("size"), "labels",
        )
    if numbers:
        spans = df.agg(*[f(F.col(f"`{n}`").cast("double")).alias(f"{s}{i}") for i, n in enumerate(numbers) for s, f in (("lo", F.min), ("hi", F.max))])
        rows = spans.select(
            F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"lo{i}").alias("min"), F.col(f"hi{i}").alias("max")) for i, n in enumerate(numbers)])).alias("s")
        ).select("s.*", empty.cast("int").alias("size"), empty.cast("array<string>").alias("labels"))
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError("no columns to profile")
    kind = F.create_map(*[F.lit(v) for pair in kinds.items() for v in pair])
    return out.select(
        F.array_position(order, F.col("name")).cast("int").alias("position"), "name",
        F.element_at(kind, F.col("name")).alias("type"), "min", "max", "size", "labels",
    )


def infer_metadata(
    df: DataFrame, ordinal: Iterable[str] | dict = (), discrete: Iterable[str] = (), bins: dict | None = None, max_labels: int = DRIVER_LABELS
) -> TableMeta:
    """Metadata of a table, which the driver holds: a column may have ``max_labels`` labels. A dict gives ordinal columns an explicit label order instead of the sorted one."""
    given = ordinal if isinstance(ordinal, dict) else {}
    cols = []
    for r in profile_columns(df, list(ordinal), discrete, max_labels).orderBy("position").collect():
        whole = r["type"] == INTEGER
        span = (int(r["min"]), int(r["max"])) if whole and r["min"] is not None else (r["min"], r["max"])
        labels = given.get(r["name"]) or r["labels"]
        cols.append(
            ColumnMeta(r["name"], r["type"], *span, labels=tuple(labels) if labels else None, bins=(bins or {}).get(r["name"]))
        )
    return TableMeta(tuple(cols))


def publish(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] = (), mode: str = "error") -> None:
    """Write a published table; many tables are laid out in one folder per table."""
    writer = df.write.mode(mode).format(fmt)
    if fmt == "csv":
        writer = writer.option("header", True)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.save(path)


def split(df: DataFrame, train: str, test: str) -> tuple[DataFrame, DataFrame]:
    """Train and test rows from two SQL filter texts."""
    return df.where(F.expr(train)), df.where(F.expr(test))


def write_meta(spark: SparkSession, meta: TableMeta, path: str, mode: str = "error") -> None:
    """Metadata as one JSON document in a folder that all of a cluster can read."""
    spark.createDataFrame([(json.dumps(meta.to_dict()),)], "value string").coalesce(1).write.mode(mode).text(path)


def read_meta(spark: SparkSession, path: str) -> TableMeta:
    """Metadata from a JSON file, or a folder with one, on any file system that Spark reads."""
    documents = [r[0] for r in spark.read.text(path, wholetext=True).collect() if r[0].strip()]
    if len(documents) != 1:
        raise ValueError(f"{path} holds {len(documents)} metadata documents")
    return TableMeta.from_dict(json.loads(documents[0]))
