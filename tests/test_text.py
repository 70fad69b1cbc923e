"""Text expressions against the goldens of FIXTURES.md and a plain-Python model."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction

STORIES = [
    ("story_1", "fiction", "Într-o zi, Ana se plimba prin parc. Acolo era și Mihai."),
    ("emoji", "fiction", "xAna Ștefan … 😀 Mihai Viteazul. Pe drum era Ion Popescu-Creangă! Ce?"),
    ("none", "history", ""),
    ("blank", "history", "  \n "),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(STORIES, "doc_id string, source string, text string")


def one(spark, expression):
    return spark.range(1).select(expression.alias("x")).first()["x"]


def test_ids_and_norms(spark):
    assert one(spark, T.stable_id("x", F.lit("a"), F.lit("b"))) == "x_9cbfbf30fde023d2"
    assert one(spark, T.normalize_mention(F.lit(" Ana,  Maria! "))) == "ana maria"
    assert one(spark, T.comma_below(F.lit("Ţara ş"))) == "Țara ș"
    assert one(spark, T.normalize_text(F.lit("é"))) == "é"
    assert one(spark, T.safe_int(F.lit("x"))) == 0
    assert one(spark, T.compact(F.lit("a  b\n" * 200))).endswith("…")


def test_offsets_are_code_points(docs):
    for r in docs.select("text", T.match_spans(F.col("text"), T.NAME).alias("m"), T.match_spans(F.col("text"), T.WORD).alias("w"), T.sentences(F.col("text")).alias("s")).collect():
        pattern = T.NAME.removeprefix("(?U)")
        assert [(m.start, m.end, m.token) for m in r.m] == [(*m.span(), m[0]) for m in re.finditer(pattern, r.text)]
        assert [(m.start, m.end) for m in r.w] == [m.span() for m in re.finditer(r"\S+", r.text)]
        assert "".join(s.sentence for s in r.s) == r.text
        assert all(r.text[s.start : s.end] == s.sentence for s in r.s)


def test_long_texts(spark):
    text = "word " * 30_000
    spans = one(spark, T.match_spans(F.lit(text), T.WORD))
    assert len(spans) == 30_000 and (spans[-1].start, spans[-1].end) == (149_995, 149_999)


@pytest.mark.parametrize(("n", "starts"), [(600, [0, 210, 420]), (250, [0]), (0, []), (251, [0, 210]), (460, [0, 210])])
def test_chunks(spark, n, starts):
    text = "ab " * n
    docs = spark.createDataFrame([("d", "s", text)], "doc_id string, source string, text string")
    rows = sorted((r.start_char, r.end_char, r.text) for r in extraction.chunk_documents(docs).collect())
    assert [r[0] for r in rows] == [3 * s for s in starts]
    assert all(t == text[a:b] for a, b, t in rows)
    assert not n or rows[-1][1] == len(text.rstrip())


def test_chunk_arguments():
    for target, overlap in ((0, 0), (10, 10), (10, -1)):
        with pytest.raises(ValueError):
            T.chunks(F.lit(None), target, overlap)


def test_regex_mentions(docs):
    rows = extraction.regex_mentions(extraction.chunk_documents(docs), "fiction").collect()
    found = sorted((r.doc_id, r.start_char, r.surface) for r in rows)
    assert ("story_1", 11, "Ana") in found and ("story_1", 49, "Mihai") in found
    assert not any(s in ("Într-o", "Acolo", "Ce") for _, _, s in found)


def test_bio(spark):
    rows = [("d", 0, 0, 3, "B-PER"), ("d", 1, 4, 7, "I-PER"), ("d", 2, 8, 9, "O"), ("d", 3, 10, 14, "B-LOC"), ("e", 0, 0, 3, "B-PER"), ("e", 1, 4, 8, "I-LOC"), ("f", 0, 0, 2, "ORG"), ("f", 1, 3, 5, None)]
    tokens = spark.createDataFrame(rows, "doc_id string, pos int, start int, end int, label string")
    found = sorted((r.doc_id, r.start_char, r.end_char, r.label) for r in extraction.bio_spans(tokens).collect())
    assert found == [("d", 0, 7, "PER"), ("d", 10, 14, "LOC"), ("e", 0, 3, "PER"), ("e", 4, 8, "LOC"), ("f", 0, 2, "ORG")]


def test_detokenize(spark):
    tokens = ["Ana", "(", "mare", ")", "", None, ",", "zice", ":", "„", "Da", "”", "."]
    got = one(spark, T.detokenize(F.array(*(F.lit(t) for t in tokens))))
    assert got.text == "Ana (mare), zice: „Da”."
    assert [got.text[s.start : s.end] for s in got.spans] == [t or "" for t in tokens]


def test_json_salvage(spark):
    text = 'Sure: [{"a": [1, 2]}] and [more] }'
    assert one(spark, T.first_json_array(F.lit(text))) == '[{"a": [1, 2]}]'
    assert one(spark, T.json_between(F.lit(text))) == '[{"a": [1, 2]}] and [more]'
    assert one(spark, T.json_between(F.lit("x {1} y"))) == "{1}"
    assert one(spark, T.first_json_array(F.lit("[[1]"))) is None


def test_overlap_vote(spark):
    rows = [("m1", 0, 10, "A", "Person", 0.5), ("m2", 5, 20, "B", "Location", 0.9), ("m3", 12, 15, "C", "Person", 0.3)]
    mentions = spark.createDataFrame([("d", "c", "s", *r) for r in rows], "doc_id string, chunk_id string, source string, mention_id string, start_char int, end_char int, surface string, entity_type string, confidence double")
    found = sorted((r.start_char, r.surface, r.entity_type, round(r.confidence, 6), r.merged_from) for r in extraction.vote_overlaps(mentions).collect())
    # the third mention begins before the second ends but after the first does: it is a run of its own
    assert found == [(5, "B", "Location", 0.7, 2), (12, "C", "Person", 0.3, 1)]


def test_gold_spans(spark):
    text = "În 1918, Ion Ionescu a locuit la Cluj."
    docs = spark.createDataFrame([("d", "h", text, [(9, 20, "PER", None), (33, 99, "LOC", None), (2, 3, "DATE", None)])], "doc_id string, source string, text string, spans array<struct<start_char:int,end_char:int,label:string,surface:string>>")
    docs = extraction.normalize_documents(docs)
    rows = extraction.extract_mentions(docs, extraction.chunk_documents(docs), "h", "f").collect()
    assert sorted((r.surface, r.entity_type, r.confidence) for r in rows) == [("Cluj.", "Location", 0.99), ("Ion Ionescu", "Person", 0.99)]
