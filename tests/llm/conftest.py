import pytest

#: Names that operators use inside; as extra columns they must not matter.
CLASH = ("k", "t", "fp", "key", "u", "v", "size", "score", "next", "rank", "bin", "s", "node", "component", "address", "own", "kept_id", "copies")


@pytest.fixture
def extra():
    """Adds columns with clashing names."""

    def add(df):
        from pyspark.sql import functions as F

        for c in CLASH:
            if c not in df.columns:
                df = df.withColumn(c, F.lit(1))
        return df

    return add


ODD_TEXTS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away home"),
    (2, "the quick brown fox jumps over the lazy dog and runs away home"),
    (3, ""),
    (4, None),
    (5, "  \t\n "),
    (6, "one"),
    (7, "Ünïcödé – 日本語 ▁ text \U0001f600 with  two spaces \nand lines\n\n"),
    (8, "a b " * 3000),
    (9, "x" * 20000),
    (10, "The quick brown fox jumps over the lazy dog and runs away HOME"),
    (10, "The quick brown fox jumps over the lazy dog and runs away HOME"),
    (None, "a row without a key"),
]


@pytest.fixture
def odd(spark):
    rows = [(k, t, "en", None if i % 3 else f"src{i % 2}", len(t or "")) for i, (k, t) in enumerate(ODD_TEXTS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.fixture
def nothing(odd):
    return odd.where("doc_id = -1")
