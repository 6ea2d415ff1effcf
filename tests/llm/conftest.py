import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session", autouse=True)
def _checkpoints(spark, tmp_path_factory):
    if spark.conf.get("spark.checkpoint.dir", None) is None:
        spark.conf.set("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents from (id, text) or (id, text, source), with columns that clash with internal names."""

    def make(rows, n_parts=3):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src", len(r[1] or "")) for r in rows]
        df = spark.createDataFrame(full, DOCS).repartition(n_parts)
        for name in ("key", "node", "h", "doc", "size", "u", "found", "bucket", "rank", "weight", "taken", "band", "comp"):
            df = df.selectExpr("*", f"'clash' AS `{name}`")
        return df

    return make
