import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) or (doc_id, text, source)."""
    def make(*rows):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "a",
                 None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOCS)
    return make


@pytest.fixture
def odd_docs(docs):
    """Nulls, empty and blank texts, a very long one, ties and repeated rows."""
    long = " ".join(f"word{i % 977} runs on" for i in range(40_000))
    return docs((1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (5, "one"),
                (None, "no name here at all"), (None, None, None), (7, long, "b"),
                (8, "tab\tand\nline  two   spaces", None), (9, "ÄÖ ß 日本 語", "b"))
