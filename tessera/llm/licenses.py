"""Licence scan by canonical digest lookup.

A text is brought to a canonical form and its digest is looked up among the digests of known licence texts by a
hash join over entire texts. The form: A-Z in lower case (licence texts are English: other letters keep their case);
lines of copyright or that reserve all rights go; ``©`` and ``(c)`` read
"copyright"; every run of characters other than letters and digits becomes one blank; equivalent spellings become
one spelling; blanks at both ends go. Built from DataFrame functions alone.

Cases: null and empty texts (and texts of copyright lines and punctuation only) have the empty form, which is no
licence; whole texts of any length are digested; two known texts with one form give the smallest licence id;
repeated rows give repeated results; empty ``docs`` or ``known`` tables work; columns of ``docs`` other than the
two named are left out, so no names clash.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A line that begins with a copyright sign or word (after blanks or comment marks), and has a year or a sign; a line that
#: reserves all rights.
COPYRIGHT_LINE = "^[ \\t*#/;-]*(?:(?:copyright[ \\t]+(?:\\(c\\)|©|[0-9]{4})|\\(c\\)[ \\t]*[0-9]{4}|©)[^\\n]*|all rights reserved[^\\n\\p{L}\\p{N}]*)$"
COPYRIGHT_SIGN = "©|\\(c\\)"
NOT_WORD = "[^\\p{L}\\p{N}]+"
#: Spellings read as equal, the left one as the right one; words stand between single blanks.
SPELLINGS = (
    ("acknowledgement", "acknowledgment"),
    ("analogue", "analog"),
    ("analyse", "analyze"),
    ("artefact", "artifact"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("calibre", "caliber"),
    ("cancelled", "canceled"),
    ("capitalisations", "capitalizations"),
    ("catalogue", "catalog"),
    ("categorise", "categorize"),
    ("centre", "center"),
    ("colour", "color"),
    ("copyright owner", "copyright holder"),
    ("copyright owners", "copyright holders"),
    ("favour", "favor"),
    ("favourite", "favorite"),
    ("fulfil", "fulfill"),
    ("fulfilment", "fulfillment"),
    ("honour", "honor"),
    ("https", "http"),
    ("initialise", "initialize"),
    ("judgement", "judgment"),
    ("labelling", "labeling"),
    ("labour", "labor"),
    ("licence", "license"),
    ("licences", "licenses"),
    ("maximise", "maximize"),
    ("modelled", "modeled"),
    ("modelling", "modeling"),
    ("non commercial", "noncommercial"),
    ("offence", "offense"),
    ("optimise", "optimize"),
    ("organisation", "organization"),
    ("organisations", "organizations"),
    ("organise", "organize"),
    ("per cent", "percent"),
    ("practise", "practice"),
    ("programme", "program"),
    ("realise", "realize"),
    ("recognise", "recognize"),
    ("signalling", "signaling"),
    ("sub license", "sublicense"),
    ("sub licence", "sublicense"),
    ("sublicence", "sublicense"),
    ("utilisation", "utilization"),
    ("whilst", "while"),
    ("wilful", "willful"),
)
ANY_SPELLING = " (?:" + "|".join(old for old, _ in SPELLINGS) + ") "


def canonical(text: Column) -> Column:
    """The canonical form of a text column. The spellings are rewritten only in texts that hold one of them."""
    form = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    form = F.regexp_replace(form, f"(?dm){COPYRIGHT_LINE}", "")  # d: lines end at \\n alone
    form = F.regexp_replace(form, COPYRIGHT_SIGN, " copyright ")
    form = F.concat(F.lit(" "), F.regexp_replace(form, NOT_WORD, " "), F.lit(" "))
    return form


def _spelled(form: Column) -> Column:
    out = form
    for old, new in SPELLINGS:
        # twice: words that follow one another share the blank between them
        for _ in range(2):
            out = F.replace(out, F.lit(f" {old} "), F.lit(f" {new} "))
    return out


def with_digest(rows: DataFrame, text_col: str, to: str = "digest") -> DataFrame:
    """``rows`` with the SHA-256 of the canonical form of ``text_col``; null where the form is empty."""
    form = rows.withColumn("__form", canonical(F.col(text_col)))
    spelled = form.withColumn("__form", F.trim(F.when(F.col("__form").rlike(ANY_SPELLING), _spelled(F.col("__form"))).otherwise(F.col("__form"))))
    return spelled.withColumn(to, F.when(F.col("__form") != "", F.sha2("__form", 256))).drop("__form")


#: Whole licence texts, one file each: the SPDX identifier, ``__`` and a word where an identifier has several texts.
TEXTS = Path(__file__).parent / "license_texts"
#: Title lines that stand above a text that has none of its own, or don't.
TITLES = (
    ("0BSD", "BSD Zero Clause License"),
    ("0BSD", "Zero-Clause BSD"),
    ("BSD-2-Clause", "BSD 2-Clause License"),
    ("BSD-2-Clause", "The BSD 2-Clause License"),
    ("BSD-3-Clause", "BSD 3-Clause License"),
    ("BSD-3-Clause", "The BSD 3-Clause License"),
    ("ISC", "ISC License"),
    ("ISC", "The ISC License"),
    ("ISC", "ISC License (ISC)"),
    ("MIT", "MIT License"),
    ("MIT", "The MIT License"),
    ("MIT", "The MIT License (MIT)"),
    ("Unlicense", "The Unlicense"),
    ("Zlib", "zlib License"),
    ("Zlib", "The zlib/libpng License"),
)

#: Usual one-line notices, for texts that are nothing else.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
)


def known_texts(folder: Path = TEXTS) -> list[tuple[str, str]]:
    """(license_id, text) of the files of a folder, with and without the usual titles, and of the notices."""
    plain = [(f.stem.partition("__")[0], f.read_text(encoding="utf-8")) for f in sorted(folder.glob("*.txt"))]
    return plain + [(name, f"{title}\n\n{text}") for name, text in plain for of, title in TITLES if of == name] + list(NOTICES)


def known_licenses(spark: SparkSession, texts: list[tuple[str, str]] | None = None) -> DataFrame:
    """(license_id, text) of the known licences; a caller may bring a table of its own."""
    return spark.createDataFrame(known_texts() if texts is None else texts, "license_id string, text string")


def find_licenses(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``digest`` of the canonical form and ``license_id`` (null: none known) of every row of ``docs``.

    Spark chooses the join: it broadcasts the digests only below its own size limit and shuffles digests, never
    texts, beyond it; digests shared by many rows are split by adaptive execution.
    """
    digests = with_digest(known.select("license_id", F.col(text_col).alias("text") if text_col in known.columns else F.col("text")), "text", "known").where(F.col("known").isNotNull())
    lookup = digests.groupBy("known").agg(F.min("license_id").alias("license_id"))
    rows = with_digest(docs.select(F.col(id_col), F.col(text_col).alias("__text")), "__text").drop("__text")
    return rows.join(lookup, F.col("digest") == F.col("known"), "left").select(id_col, "digest", "license_id")


def canonical_sql(text: str) -> str:
    """DuckDB SQL of the trimmed canonical form."""
    form = f"translate(coalesce({text}, ''), '{UPPER}', '{LOWER}')"
    form = f"regexp_replace({form}, '(?m){COPYRIGHT_LINE}', '', 'g')"
    form = f"regexp_replace({form}, '{COPYRIGHT_SIGN}', ' copyright ', 'g')"
    form = f"' ' || regexp_replace({form}, '{NOT_WORD}', ' ', 'g') || ' '"
    for old, new in SPELLINGS:
        for _ in range(2):
            form = f"replace({form}, ' {old} ', ' {new} ')"
    return f"trim({form})"
