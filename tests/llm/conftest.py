import pytest

LONG = "word " * 60_000
DOCS = "doc_id long, text string, lang string, source string, n_chars long, n_lines string, ids string, kept string, fp string"


def doc(i, text, lang="en", source="s"):
    """A document row with columns whose names clash with what operators add."""
    return (i, text, lang, source, len(text or ""), "x", "x", "x", "x")


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long and repeated rows, null keys, and clashing extra columns."""
    return spark.createDataFrame(
        [
            doc(1, None), doc(2, ""), doc(3, LONG), doc(4, "a line that is long enough\nshort\n\n"),
            doc(5, " A LINE that is long enough \nother"), doc(5, " A LINE that is long enough \nother"),
            doc(5, "same id, other text, which is longer\nother"), doc(None, "a line that is long enough"),
            doc(7, "é" * 3000, None, None), doc(8, "\n\n", "de", None), doc(9, "<|endoftext|> it's 12,5  \t x\x00y "),
        ],
        DOCS,
    )


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
