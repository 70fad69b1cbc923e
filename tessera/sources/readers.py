"""Readers: JSONL documents, triples, nested triples, question records, token tables, configs, logs."""

from __future__ import annotations

import json
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import has_text
from tessera.session import qualified

DOCUMENT = "doc_id string, title string, text string, spans array<struct<start_char:int,end_char:int,label:string,surface:string>>, meta map<string,string>, author string, year int, genre string"
QUESTION = "question_id string, question string, graph array<array<string>>, q_entity array<string>, a_entity array<string>, answer array<string>"


#: What a line is stripped of before it counts as blank.
BLANKS = " \t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0"


def numbered_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(value, file, pos) of the lines that aren't blank: ``pos`` counts them from 0 in each file.

    A file is read as blocks in any number of tasks. Lines are counted by block, and the sum of the counts before a
    block is the place of its first line; a line's rank in its block is what its running id is above the block's
    smallest. So places depend neither on how files are split nor on other files, and no task has more than a block;
    the window runs over the blocks of one file.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.where(F.btrim("value", F.lit(BLANKS)) != "").withColumn("row", F.monotonically_increasing_id())
    blocks = lines.groupBy("file", "block").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = blocks.select("file", "block", (before - F.col("first")).alias("base"))
    return lines.join(bases, ["file", "block"]).select("value", "file", (F.col("base") + F.col("row")).alias("pos"))


def _named_as_given(spark: SparkSession, path: str | list[str], file: Column) -> Column:
    """A file's path as the caller wrote it where ``path`` is that file, else the whole path without a local scheme."""
    plain = F.regexp_replace(F.url_decode(F.replace(file, F.lit("+"), F.lit("%2B"))), "^file:/+", "/")
    given = [path] if isinstance(path, str) else path
    names = {re.sub("^file:/+", "/", qualified(spark, p)): p for p in given}
    return reduce(lambda other, name: F.when(plain == name, names[name]).otherwise(other), names, plain)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON-lines files with an explicit schema, with ``file`` and ``pos``, the place among a file's lines; blank lines are skipped."""
    return numbered_lines(spark, path).select("file", "pos", F.from_json("value", schema).alias("r")).select("file", "pos", "r.*")


def _own_id(spark: SparkSession, path: str | list[str]) -> Column:
    """What stands for a missing id: the place in the file, with the file's name where there are more files than one."""
    place = F.col("pos").cast("string")
    return place if len(spark.read.text(path).inputFiles()) == 1 else F.concat_ws(":", _named_as_given(spark, path, F.col("file")), place)


def read_documents(spark: SparkSession, path: str | list[str], source: str, limit: int | None = None) -> DataFrame:
    """Documents of JSON-lines files; author, year and genre go into ``meta``; ``limit`` takes the first by file and line.

    A document without an id gets one of its source, its file's path and its line, so two files never give the same.
    """
    from tessera.operators.extraction import ingest

    rows = read_jsonl(spark, path, DOCUMENT)
    if limit is not None:
        rows = rows.where(has_text(F.col("text"))).orderBy("file", "pos").limit(limit)
    extra = F.map_filter(F.create_map(*(x for c in ("author", "year", "genre") for x in (F.lit(c), F.col(c).cast("string")))), lambda k, v: v.isNotNull())
    rows = rows.withColumn("meta", F.map_concat(F.coalesce(F.map_filter("meta", lambda k, v: ~k.isin("author", "year", "genre")), F.create_map().cast("map<string,string>")), extra))
    return ingest(rows.withColumn("file", _named_as_given(spark, path, F.col("file"))), source)


def text_field(row_columns: list[str], candidates: tuple[str, ...] = ("text", "content", "paragraph")):
    """The first of some columns that is not empty."""
    return F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in candidates if c in row_columns))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """(s, p, o) of a tab-separated file; lines without exactly three fields are skipped."""
    parts = F.split(F.trim("value"), "\t", -1)
    return spark.read.text(path).select(parts.alias("t")).where(F.size("t") == 3).select(F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question rows; the id falls back to the position."""
    rows = read_jsonl(spark, path, QUESTION)
    return rows.withColumn("question_id", F.coalesce(F.col("question_id"), _own_id(spark, path)))


def read_answers(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, answers, entities) of records that write these fields in different ways.

    Answers may be strings or objects with ``answer``; entities may be a list or one string.
    """
    lines = numbered_lines(spark, path)
    get = lambda *names: F.coalesce(*(F.get_json_object("value", f"$.{n}") for n in names))
    answers = get("answers", "Answers")
    items = F.from_json(answers, "array<string>")
    one = F.transform(items, lambda a: F.coalesce(F.get_json_object(a, "$.answer"), F.get_json_object(a, "$.AnswerArgument"), a))
    entities = get("entities", "TopicEntityMid")
    many = F.coalesce(F.from_json(entities, "array<string>"), F.when(entities.isNotNull(), F.array(entities)))
    empty = F.array().cast("array<string>")
    return lines.select(F.coalesce(get("id", "ID"), _own_id(spark, path)).alias("id"), get("question", "Question").alias("question"), F.coalesce(one, empty).alias("answers"), F.coalesce(many, empty).alias("entities"))


def first_answer(answers):
    return F.coalesce(F.try_element_at(answers, F.lit(1)), F.lit(""))


def token_documents(rows: DataFrame) -> DataFrame:
    """Documents of token rows (doc_id, pos, tokens, labels): rows joined by line ends, spans moved along.

    Running lengths give each row its offset; one window over the rows of a document.
    """
    from pyspark.sql import Window

    from tessera.functions import text as T
    from tessera.operators.extraction import bio_spans

    joined = rows.select("doc_id", "pos", "labels", T.detokenize(F.col("tokens")).alias("d"))
    order = Window.partitionBy("doc_id").orderBy("pos")
    base = F.sum(F.length("d.text") + 1).over(order) - F.length("d.text") - 1
    placed = joined.withColumn("base", base.cast("int"))
    texts = placed.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.col("d.text").alias("t")))), lambda x: x["t"]), "\n").alias("text"))
    tokens = placed.select("doc_id", "pos", "base", F.posexplode(F.arrays_zip(F.col("d.spans").alias("s"), F.col("labels").alias("l"))).alias("i", "t"))
    flat = tokens.select(F.struct("doc_id", "pos").alias("doc_id"), F.col("i").alias("pos"), (F.col("base") + F.col("t.s.start")).alias("start"), (F.col("base") + F.col("t.s.end")).alias("end"), F.col("t.l").alias("label"))
    spans = bio_spans(flat).select("doc_id.doc_id", F.struct("start_char", "end_char", "label").alias("s")).groupBy("doc_id").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    return texts.join(spans, "doc_id", "left")


def read_config(path: str) -> dict:
    """A JSON or YAML file."""
    with open(path, encoding="utf-8") as file:
        text = file.read()
    try:
        return json.loads(text)
    except ValueError:
        import yaml

        return yaml.safe_load(text)


def read_progress(spark: SparkSession, path: str) -> DataFrame:
    """(stage, done, total) of log lines like ``stage: 12/40``."""
    found = spark.read.text(path).select(F.regexp_extract("value", "(\\w+):\\s*(\\d+)/(\\d+)", 1).alias("stage"), F.regexp_extract("value", "(\\w+):\\s*(\\d+)/(\\d+)", 2).try_cast("bigint").alias("done"), F.regexp_extract("value", "(\\w+):\\s*(\\d+)/(\\d+)", 3).try_cast("bigint").alias("total"))
    return found.where("stage <> ''")
