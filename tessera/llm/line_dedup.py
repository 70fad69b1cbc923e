"""Line dedup: explode normalised lines, hash, count the documents of each hash, drop, reassemble by position.

A line's key is the line without blanks (``[\\x20\\x09-\\x0D]``) at both ends and with A-Z in lower case. Keys of at
least ``min_chars`` code points that stand in at least ``min_docs`` documents lose all their lines except those of
the largest ``id_col`` that holds them. Only 16-byte digests of eligible keys are exploded and counted, never the
lines; counts are combined before each exchange, so a line found in a third of all documents is a few partial rows.

Cases: null and empty texts are one empty line; rows that repeat an id are one document when documents are counted
and each keep their own lines by the same rule; equal keys within a document count once and go together; a null id
is a document of its own kind (all rows with a null id are one document, smaller than every other); empty tables
give empty results; columns other than the two named are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.session import cut

#: The blanks [\\x20\\x09-\\x0D].
BLANKS = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The normalised form of a stripped line; ``lower`` is A-Z to a-z, and faster, where all characters are ASCII."""
    return F.when(F.length(line) == F.octet_length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def _digest(key: Column) -> Column:
    """16 bytes of the key, the MD5: chance gives no two lines one digest at any corpus size; lines made to collide count as one."""
    return F.unhex(F.md5(key.cast("binary")))


def drop_common_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """``id_col``, n_lines (before dropping), n_dropped and the reassembled ``text`` of every row.

    Exchanges: digests by (digest, document), partial counts by digest, digests again to meet the common ones (unless
    those are few enough for Spark to broadcast), dropped positions by row, and each text once to meet its positions.
    The digests and the common ones are written in between: texts are split into keys once, and the join starts from
    exchanges of its own, which adaptive execution can split where one line is hot.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"))
    # array functions, one after another, so that each line is stripped and lower-cased once
    stripped = F.transform(F.split("text", "\n", -1), lambda line: F.btrim(line, F.lit(BLANKS)))
    keys = F.transform(stripped, lambda line: F.when(F.length(line) >= min_chars, line_key(line)))
    marks = F.transform(keys, lambda key, pos: F.struct(pos.alias("pos"), _digest(key).alias("digest")))
    lines = cut(
        rows.select("id", F.xxhash64("text").alias("h"), F.inline(F.filter(marks, lambda m: m["digest"].isNotNull()))).select("id", "h", "pos", "digest"),
        "lines",
    )
    common = cut(
        lines.groupBy("digest", "id").agg(F.lit(1).alias("one"))
        .groupBy("digest").agg(F.count("one").alias("n_docs"), F.max("id").alias("keep"))
        .where(F.col("n_docs") >= min_docs)
        .select("digest", "keep"),
        "common-lines",
    )
    # a row is known by id and text hash: rows that repeat both have the same lines and lose the same ones
    dropped = (
        lines.join(common, "digest")
        .where(~F.col("id").eqNullSafe(F.col("keep")))
        .groupBy("id", "h").agg(F.collect_set("pos").alias("gone"))
    )
    kept = F.array_except(F.sequence(F.lit(0), F.size("all") - 1), F.col("gone"))
    joined = (
        rows.withColumn("h", F.xxhash64("text")).alias("r")
        .join(dropped.alias("d"), F.col("r.id").eqNullSafe(F.col("d.id")) & (F.col("r.h") == F.col("d.h")), "left")
        .select("r.id", "r.text", "d.gone", F.split("r.text", "\n", -1).alias("all"))
    )
    return joined.select(
        F.col("id").alias(id_col),
        F.size("all").cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get("all", i)), "\n")).alias("text"),
    )
