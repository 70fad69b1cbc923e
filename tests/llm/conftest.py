import pytest

#: A row of documents, with further columns whose names operators might use themselves.
SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, "
    "id bigint, h bigint, digest string, n bigint, size bigint, pos int, line string, score double, path string, bucket int, copies int"
)
EXTRA = (7, 7, "x", 7, 7, 7, "x", 0.5, "x", 7, 7)
LONG = "palabra otra\nLarga " * 40_000
LINE = "this line is longer than forty characters, and common"


def make(spark, rows):
    """Rows of (doc_id, text, source)."""
    return spark.createDataFrame([(i, t, "en", s, len(t) if t else None, *EXTRA) for i, t, s in rows], SCHEMA)


ROWS = [
    (1, "One two three four five six seven.\n" + LINE, "a"),
    (2, "One two three four five six seven.\n" + LINE, "a"),
    (3, "one TWO three four five six seven.\n" + LINE.upper(), "b"),
    (4, None, "b"),
    (5, "", None),
    (6, "   \n \t\n", "c"),
    (7, LONG, "c"),
    (8, "short", None),
    (9, "Released under the MIT License.\n" + LINE, "a"),
    (9, "Released under the MIT License.\n" + LINE, "a"),
    (10, "émile 😀 ﬁ\x00 the <|endoftext|> end  two  blanks \n " + LINE, "d"),
    (None, "a text without id\n" + LINE, "a"),
    (11, "Released under the mit licence", "a"),
]


@pytest.fixture(scope="session")
def docs(spark):
    return make(spark, ROWS)


@pytest.fixture(scope="session")
def empty(spark):
    return make(spark, ROWS).where("false")
