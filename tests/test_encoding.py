import pytest
from pyspark.sql import functions as F

from veilgauge.functions import encoding as enc
from veilgauge.functions.keyed import digest, uniform
from veilgauge.meta import ColumnMeta, TableMeta, bin_labels
from veilgauge.operators.encode import decode_with_ranges, encode_with_ranges

AGE = (18, 25, 30, 40, 50, 60, 80)
META = TableMeta(
    (
        ColumnMeta("Age", "Integer", 19, 75, bins=AGE),
        ColumnMeta("Saving accounts", "Ordinal", labels=("no_info", "little", "rich")),
        ColumnMeta("Credit amount", "Float", 250.0, 18424.0),
    )
)


def test_metadata_rules():
    assert bin_labels(AGE)[0] == "(18,25]"
    derived = META.derive(quids=["Age"], drop=["Credit amount"])
    assert derived.names == ["Age", "Saving accounts"]
    assert derived["Age"].binned and derived["Age"].labels == bin_labels(AGE)
    assert TableMeta.from_dict(META.to_dict()) == META
    with pytest.raises(ValueError):
        ColumnMeta("x", "DateTime", 0, 1)
    with pytest.raises(ValueError):
        META.derive(quids=["Credit amount"])
    with pytest.raises(ValueError):
        META.check(["Age"])


def test_integer_edges_are_truncated():
    assert ColumnMeta("Duration", "Integer", 4, 72).edges(10) == [4, 10, 17, 24, 31, 38, 44, 51, 58, 65, 72]


def test_cut_excludes_lowest_edge(spark):
    df = spark.createDataFrame([(v,) for v in (18, 19, 25, 26, 80, 81, None)], "Age int")
    got = [r[0] for r in df.select(enc.cut(F.col("Age"), AGE)).collect()]
    assert got == ["nan", "(18,25]", "(18,25]", "(25,30]", "(60,80]", "nan", "nan"]


@pytest.mark.parametrize("kind", ["Integer", "Float"])
@pytest.mark.parametrize("n", [3, 7, 10, 25])
def test_bins_equal_comparing_with_every_edge(spark, kind, n):
    c = ColumnMeta("x", kind, 4, 72)
    edges = c.edges(n)
    real = [4 + i * (68 / n) for i in range(n)] + [72.0]
    values = sorted({float(v) for e in edges for v in (e, e - 1, e + 1)} | ({e for e in real} if kind == "Float" else set()))
    df = spark.createDataFrame([(v,) for v in values], "x double")
    rows = df.select("x", enc.left_closed_bin(F.col("x"), c, n).alias("l"), enc.right_closed_bin(F.col("x"), c, n).alias("r")).collect()
    for x, left, right in rows:
        want = -1 if x < 4 else min(sum(x >= e for e in edges[1:-1]), n - 1)
        assert left == want, (x, left, want)
        assert right == (None if x < 4 or x > 72 else sum(x > e for e in real[1:-1])), (x, right)


def test_codes_round_trip_with_nulls_and_unknown(spark):
    meta = META.select(["Saving accounts"])
    df = spark.createDataFrame([("no_info",), ("rich",), (None,), ("other",)], "`Saving accounts` string")
    coded = enc.encode_codes(df, meta)
    assert [r[0] for r in coded.collect()] == [0, 2, 3, -1]
    assert [r[0] for r in enc.decode_codes(coded, meta).collect()] == ["no_info", "rich", "NaN", None]


def test_scaled_round_trip(spark):
    df = spark.createDataFrame([(20, "little", 300.5), (70, "rich", 9000.25)], "Age bigint, `Saving accounts` string, `Credit amount` double")
    coded = df.withColumn("v", enc.scaled_vector(META, enc.RANGE_TOL))
    assert len(coded.first()["v"]) == len(enc.scaled_names(META)) == 5
    back = enc.decode_scaled(coded.select("v"), "v", META).collect()
    assert [r["Saving accounts"] for r in back] == ["little", "rich"]
    assert back[0]["Credit amount"] == pytest.approx(300.5)
    ranged = decode_with_ranges(encode_with_ranges(df, META).drop(*META.names), META).collect()
    assert ranged[1]["Credit amount"] == pytest.approx(9000.25)


def test_camel(spark):
    df = spark.createDataFrame([("RISK_MORTALITY",), ("a-bC",), ("Age",)], "s string")
    assert [r[0] for r in df.select(enc.camel(F.col("s"))).collect()] == ["RiskMortality", "ABc", "Age"]


def test_keyed_uniform_does_not_depend_on_partitions(spark):
    a = spark.range(1000, numPartitions=1).select("id", uniform(digest(1, "t", "id")).alias("u"))
    b = spark.range(1000, numPartitions=7).select("id", uniform(digest(1, "t", "id")).alias("u"))
    assert sorted(a.collect()) == sorted(b.collect())
    assert 0.47 < a.agg(F.avg("u")).first()[0] < 0.53
