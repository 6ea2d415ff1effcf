"""Storage and keys shared by the operators of this subpackage."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgauge.operators.joining import checkpoint_folder


def text_key(column: str = "text") -> Column:
    """Tells rows that share a document id apart. Rows equal in both are the same row twice and are treated alike."""
    return F.xxhash64(F.col(column))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores in front as it takes to be none of the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from there: later steps read it instead of
    computing it again, also after the loss of an executor."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/stage-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._stage_path = path
    return table


def discard(table: DataFrame) -> None:
    """Remove a staged table that nothing reads any more."""
    spark = table.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(table._stage_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark) -> None:
    """Let Spark hand texts to Python workers in Arrow batches of at most 16 MB, whatever the texts' lengths."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 * 2**20))


def total_bytes(docs: DataFrame, column: str = "text") -> int:
    """UTF-8 bytes of a text column."""
    return docs.agg(F.sum(F.octet_length(column))).first()[0] or 0


def parquet(spark, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
