"""The population all registered queries work on: orders with their customer and nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgauge.meta import CATEGORICAL, FLOAT, INTEGER, ORDINAL, ColumnMeta, TableMeta

# Label domains and ranges of the population columns, in domain order.
STATUS = ("F", "O", "P")
PRIORITY = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
SEGMENT = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
REGION = ("0", "1", "2", "3", "4")

META = TableMeta(
    (
        ColumnMeta("status", CATEGORICAL, labels=STATUS),
        ColumnMeta("priority", ORDINAL, labels=PRIORITY),
        ColumnMeta("segment", CATEGORICAL, labels=SEGMENT),
        ColumnMeta("region", CATEGORICAL, labels=REGION),
        ColumnMeta("year", INTEGER, 1995, 2001, bins=(1994, 1996, 1998, 2000, 2002)),
        ColumnMeta("total", FLOAT, 1000, 500000, bins=(0, 100000, 200000, 300000, 400000, 500000)),
        ColumnMeta("balance", FLOAT, -1000, 10000),
    )
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def population(spark: SparkSession, sf_dir: str, nation: bool = False) -> DataFrame:
    o, c, n = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    df = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    cols = [
        F.col("o_orderkey").alias("id"),
        F.col("o_orderstatus").alias("status"),
        F.col("o_orderpriority").alias("priority"),
        F.col("c_mktsegment").alias("segment"),
        F.col("n_regionkey").cast("string").alias("region"),
        F.year("o_orderdate").cast("bigint").alias("year"),
        F.col("o_totalprice").alias("total"),
        F.col("c_acctbal").alias("balance"),
    ]
    if nation:
        cols.append(F.col("n_name").alias("nation"))
    return df.select(*cols)


def population_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population(spark, sf_dir).withColumns(
        {
            "segment": F.when(F.col("id") % 17 != 0, F.col("segment")),
            "balance": F.when(F.col("id") % 13 != 0, F.col("balance")),
        }
    )


def as_tables(df: DataFrame) -> DataFrame:
    """The population as several tables: one ``dataset_id`` per order status and order year parity."""
    return df.withColumn("dataset_id", F.concat_ws("-", "status", (F.col("year") % 2).cast("string")))


# Label domains and ranges of the order lines, a table too wide to be counted by whole rows.
NATIONS = tuple(str(i) for i in range(25))
WIDE = TableMeta(
    (
        *META.columns,
        ColumnMeta("line", INTEGER, 1, 7),
        ColumnMeta("quantity", FLOAT, 1, 50),
        ColumnMeta("price", FLOAT, 900, 105000),
        ColumnMeta("discount", FLOAT, 0, 0.1),
        ColumnMeta("tax", FLOAT, 0, 0.08),
        ColumnMeta("returned", CATEGORICAL, labels=("A", "N", "R")),
        ColumnMeta("line status", CATEGORICAL, labels=("F", "O")),
        ColumnMeta("ship month", ORDINAL, labels=tuple(str(i) for i in range(1, 13))),
        ColumnMeta("supplier nation", CATEGORICAL, labels=NATIONS),
    )
)


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with the order, its customer and the supplier's nation; some names hold a space."""
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    df = line.join(population(spark, sf_dir), line.l_orderkey == F.col("id")).join(supplier, line.l_suppkey == supplier.s_suppkey)
    return df.select(
        *META.names, F.col("l_linenumber").cast("bigint").alias("line"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"), F.col("l_returnflag").alias("returned"), F.col("l_linestatus").alias("line status"),
        F.month("l_shipdate").cast("string").alias("ship month"), F.col("s_nationkey").cast("string").alias("supplier nation"),
    )
