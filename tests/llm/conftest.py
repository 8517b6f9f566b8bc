import pytest

#: Columns whose names the operators use themselves.
CLASHING = "doc_id long, text string, lang string, source string, n_chars long, ids string, fp binary, part long, to long, bands array<long>, key long, x double, n_tokens long, base_failed string, kept int"
CASES = [
    None, "", " \t\n ", "a", "one two three", "word " * 60, "Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 40, "x" * 20_000, "é" * 300 + " " + "漢字" * 50, "a b c d e f g h i j k l m n o p",
    "a b c d e f g h i j k l m n o p", "mail bob@example.com token = \"0123456789abcdef0123456789abcdef01234567\" +1 (415) 555-2671", "\x00 odd \x1c controls   and　spaces", "!!! ### $$$ " * 30,
]


def rows_of(texts, ids=None):
    ids = ids or range(len(texts))
    return [(i, t, "en", "s", None, "old", b"f", 1, 2, [3], 4, 5.0, 6, "b", 7) for i, t in zip(ids, texts, strict=True)]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, odd characters, a null id, a repeated row, clashing columns."""
    rows = [*rows_of(CASES), *rows_of(["same row twice of a text that is long enough for a window of words"] * 2, [90, 90]), *rows_of(["text without an id but long enough for a whole window of words"], [None])]
    return spark.createDataFrame(rows, CLASHING)


@pytest.fixture(scope="session")
def empty(edge):
    return edge.where("false")


@pytest.fixture(scope="session")
def lasting():
    from ledgerlake.llm.lasting import lasting

    return lasting
