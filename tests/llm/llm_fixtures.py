import pytest

from tallyspark.llm.common import workers_ready

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
VOCABULARIES = "/opt/tokenizers"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents from texts or (doc_id, text[, lang, source]) tuples, with columns that clash with
    names used inside the operators."""
    workers_ready(spark)

    def build(rows):
        full = []
        for i, row in enumerate(rows):
            row = row if isinstance(row, tuple) else (i, row)
            doc_id, text, *rest = row
            lang, source = (*rest, *("en", "s")[len(rest) :])
            full.append((doc_id, text, lang, source, len(text or "")))
        frame = spark.createDataFrame(full, DOCS)
        for name in ("_text", "_norm", "_fp", "_n", "_k", "size", "key", "fp", "line", "no", "_lost", "_rank", "_bucket", "_mark", "_row", "_id", "spans"):
            frame = frame.selectExpr("*", f"'x' AS {name}")
        return frame

    return build


#: Rows every operator must bear: nulls, empty and white texts, repeated rows, ties, a long text.
ODD = [
    (0, None, None, None), (1, "", "en", "a"), (2, " \n\t ", "en", "a"), (3, "a", None, "a"), (3, "a", None, "a"),
    (4, "word " * 30_000, "en", "b"), (5, "é́ 日本語 \U0001f600 <|endoftext|>", "ja", "b"), (None, "no id here", "en", None),
    (None, None, None, None), (6, "12345\n\n67890", "de", "ä"),
]


@pytest.fixture
def odd(docs_of):
    return docs_of(ODD)


@pytest.fixture
def none(docs_of):
    return docs_of([])
