import pytest

#: Texts that every operator must take: null, empty, white space only, one word, repeats, ties, long, and characters of many widths.
LONG = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
ODD = [
    (1, None, "a"), (2, "", "a"), (3, " \t\n", None), (4, "one", "a"), (5, "one", "b"), (5, "one", "b"), (6, "ünï cödé ▁▁ x y 漢字🙂 \x0b end", None),
    (None, "no id here at all, none", "b"), (None, None, None), (7, "x" * 20_000, "c"), (8, LONG, "c"), (9, LONG + " tail", "c"), (10, "One. Two! Three?\nFour", ""),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that are hard to handle, with extra columns whose names clash with helpers'."""
    rows = [(i, t, s, "clash", 1, "row") for i, t, s in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, key string, h int, row string")


@pytest.fixture(scope="session")
def none(odd):
    return odd.where("doc_id > 1000")
