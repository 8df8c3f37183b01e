import pytest

CLASHING = ["score", "row", "key", "n", "fp", "bucket", "seg", "drops", "kept", "copy", "rank", "shard", "slot", "spans",
            "items", "path", "site", "host", "size", "u", "p", "predicted", "evidence", "component_id", "code", "term", "mix"]


@pytest.fixture(scope="session")
def awkward(spark, tmp_path_factory):
    """Documents with nulls in any column, empty and very long texts, repeated rows, and columns of all names in use."""
    long = " ".join(f"word{i % 977} tail{i % 13}" for i in range(60_000))
    rows = [(0, "The same text of a few plain words that come again.", "en", "a", 1),
            (1, "The same text of a few plain words that come again.", "en", "a", 1),
            (1, "The same text of a few plain words that come again.", "en", "a", 1),
            (2, "", "en", None, None), (3, None, None, "b", None), (4, long, "de", "b", 1), (5, "\n\n", None, None, 0),
            (None, "A text without an id, but with words in it.", "en", "c", 3), (None, None, None, None, None),
            (6, "ÄÖÜ ß é   \U0001f600 123", "de", "c", 2), (7, "word", "en", "c", 4)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    path = str(tmp_path_factory.mktemp("awkward") / "documents.parquet")
    frame.selectExpr("*", *[f"{i} as `{name}`" for i, name in enumerate(CLASHING)]).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="session")
def nothing(awkward):
    return awkward.limit(0)
