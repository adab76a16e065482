import pytest

#: Columns of other tables and of results: they must not clash with an operator's own.
EXTRA = "score string, fp string, root string, part string, file string, keep_id string, label string, held_out string, codes string"
DOCS = f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}"


def row(doc_id, text, lang="en"):
    return (doc_id, text, lang, "s", None if text is None else len(text), *["x"] * 9)


LONG = "lorem ipsum dolor sit amet consetetur. " * 6000
EDGE = [
    row(1, None), row(2, ""), row(3, " \n\t "), row(4, "... !!"), row(5, "one"), row(6, "one two three four five six seven"),
    row(6, "one two three four five six seven"), row(7, "one two three four five six seven"), row(None, "null id text of words"),
    row(None, None), row(8, LONG), row(9, "x" * 50_000), row(10, "Ünïcode ſ K 日本語 🙂 a\x00b"), row(11, "no lang here", None),
    row(12, "1 2 3 4 5 6"), row(13, "password=abcdef123 mail me a@b.co")
]


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)
