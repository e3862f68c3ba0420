import pytest

from parlance.llm.common import prepare


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


DOC = "doc_id long, text string, lang string, source string, n_chars int, key long, row string, sid long"


@pytest.fixture()
def docs(llm):
    """Rows of ``documents`` with extra columns whose names the operators use inside."""
    def make(rows):
        return llm.createDataFrame([(i, t, None, "s", 0, 1, "r", 2) for i, t in rows], DOC)
    return make


#: Nulls, empty and very long texts, ties and repeated rows.
LONG = " ".join(f"w{i * 7919 % 10007}" for i in range(30_000))
ODD = [(None, None), (1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Two words"), (6, LONG), (7, LONG), (7, LONG),
       (8, "same line of text here\nsame line of text here\nother"), (None, "same line of text here"),
       (9, "a" * 5000), (10, "é" * 300 + " x"), (11, "<|endoftext|> it's  ok\r\n\n x ")]
