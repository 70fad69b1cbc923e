"""Text expressions: ids, normal forms, offsets, sentences, chunks. Built-in functions only, but for NFC."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tessera.functions import vocab

#: Separator of the parts of an id.
UNIT = "␟"
CEDILLA, COMMA_BELOW = "şţŞŢ", "șțȘȚ"
#: White space and marks that a mention's normal form turns into blanks; the hyphen is kept.
MENTION_MARKS = "[\\s\\.,;:\\!\\?\\(\\)\\[\\]\\{\\}\"'`“”„«»/\\\\]+"
SENTENCE_END = "[.!?]\\s+"
WORD = "\\S+"
YEAR = "\\b(1[0-9]{3}|20[0-9]{2})\\b"
#: One to four capitalised words, and the same for one word in two steps that every regular-expression engine has.
NAME = "(?U)\\b[A-ZĂÂÎȘȚ][A-Za-zĂÂÎȘȚăâîșț\\-']+(?:\\s+[A-ZĂÂÎȘȚ][A-Za-zĂÂÎȘȚăâîșț\\-']+){0,3}\\b"
CAPITAL_RUN = "(?:^|[^\\p{L}\\p{N}_'\\-])([A-ZĂÂÎȘȚ][\\p{L}\\p{N}_'\\-]*)"
CAPITAL_WORD = "^[A-ZĂÂÎȘȚ][A-Za-zĂÂÎȘȚăâîșț\\-']+$"


def stable_id(prefix: str, *parts: Column) -> Column:
    """``prefix_`` and 16 hex digits of the SHA-1 of the parts; a null part counts as empty."""
    joined = F.concat_ws(UNIT, *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit(f"{prefix}_"), F.substring(F.sha1(joined.cast("binary")), 1, 16))


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode normal form C; Spark has no function for it."""
    return text.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def comma_below(text: Column) -> Column:
    return F.translate(text, CEDILLA, COMMA_BELOW)


def normalize_text(text: Column) -> Column:
    """NFC, then comma-below letters. ASCII texts are NFC already and skip the Python worker's work."""
    return comma_below(nfc(text))


def normalize_mention(surface: Column) -> Column:
    """Lower case without marks, single blanks. The surface is taken from normalised text."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.lower(comma_below(surface))), MENTION_MARKS, " "), "\\s+", " "))


def has_text(text: Column) -> Column:
    """Whether a text is there and holds more than blanks."""
    return text.isNotNull() & (F.trim(F.regexp_replace(text, "\\s+", " ")) != "")


def compact(text: Column, most: int = 240) -> Column:
    """Single blanks; beyond ``most`` characters cut one short of that, with an ellipsis."""
    flat = F.trim(F.regexp_replace(text, "\\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.rtrim(F.substring(flat, 1, most - 1)), F.lit("…"))).otherwise(flat)


def clamp(start: Column, end: Column, size: Column) -> tuple[Column, Column]:
    """A span within 0 .. size whose end isn't before its start."""
    a = F.greatest(F.lit(0), F.least(start, size))
    return a, F.greatest(a, F.least(end, size))


def span_text(text: Column, start: Column, end: Column) -> Column:
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def safe_int(value: Column, default: int = 0) -> Column:
    return F.coalesce(value.try_cast("int"), F.lit(default))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once: what a lambda mentions is computed at every element otherwise."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


#: Elements whose running sums are built together.
SUM_BLOCK = 64


def running_sums(lengths: Column) -> Column:
    """Running sums of an array of integers: in blocks, so that long arrays are not copied at every element."""

    def within(block: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        add = lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"] + n)).alias("out"))
        return F.aggregate(block, start, add)["out"]

    def joined(blocks: Column) -> Column:
        bases = within(F.transform(blocks, lambda b: F.element_at(b, -1)))
        return let(bases, lambda base: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda n: n + F.coalesce(F.get(base, i - 1), F.lit(0))))))

    def summed(all_: Column) -> Column:
        begins = F.when(F.size(all_) > 0, F.sequence(F.lit(0), F.size(all_) - 1, F.lit(SUM_BLOCK))).otherwise(F.array().cast("array<int>"))
        return let(F.transform(begins, lambda i: within(F.slice(all_, i + 1, F.lit(SUM_BLOCK)))), joined)

    return let(F.coalesce(lengths, F.array().cast("array<int>")), summed)


def match_spans(text: Column, pattern: str, group: int = 0) -> Column:
    """array<struct<start, end, token>> of the matches, in code points: gaps and matches one after another.

    ``group`` 1 takes a group that ends where the match ends.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    columns = [F.split(text, pattern, -1).alias("gap"), whole.alias("whole")]
    zipped = F.arrays_zip(*columns, *([F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("part")] if group else []))
    part = "part" if group else "whole"

    def spans(steps: Column) -> Column:
        ends = running_sums(F.transform(steps, lambda z: F.length(z["gap"]) + F.length(z["whole"])))
        return F.zip_with(steps, ends, lambda z, end: F.struct((end - F.length(z[part])).alias("start"), end.alias("end"), z[part].alias("token")))

    return let(F.filter(zipped, lambda z: z["whole"].isNotNull()), spans)


def sentence_pieces(text: Column, pattern: str = SENTENCE_END) -> Column:
    """Array of the pieces with the separator behind them, without their places; an empty tail goes."""
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("piece"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("gap"))
    return F.filter(F.transform(zipped, lambda z: F.concat(z["piece"], F.coalesce(z["gap"], F.lit("")))), lambda s: s != "")


def sentences(text: Column, pattern: str = SENTENCE_END) -> Column:
    """array<struct<start, end, sentence>> of :func:`sentence_pieces`."""
    place = lambda ps: F.zip_with(ps, running_sums(F.transform(ps, F.length)), lambda s, end: F.struct((end - F.length(s)).alias("start"), end.alias("end"), s.alias("sentence")))
    return let(sentence_pieces(text, pattern), place)


def chunks(tokens: Column, target: int = 250, overlap: int = 40) -> Column:
    """array<struct<start, end>> of overlapping windows of ``target`` tokens; the last one reaches the end."""
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("chunking needs target > 0 and 0 <= overlap < target")
    n = F.size(tokens)
    last = F.greatest(F.lit(0), F.ceil((n - target) / F.lit(target - overlap)).cast("int"))
    begins = F.transform(F.sequence(F.lit(0), last), lambda i: i * (target - overlap))
    window = F.transform(begins, lambda b: F.struct(F.get(tokens, b)["start"].alias("start"), F.get(tokens, F.least(b + target, n) - 1)["end"].alias("end")))
    return F.when(n > 0, window).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def word_chunks(text: Column, target: int = 250, overlap: int = 40) -> Column:
    """:func:`chunks` of the words of a text, without a place for every word.

    Chunks begin every ``target - overlap`` words: lengths are summed by such steps, and only the sums of steps are run up.
    """
    if target <= 0 or not 0 <= overlap < target:
        raise ValueError("chunking needs target > 0 and 0 <= overlap < target")
    step = target - overlap
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda s, x: s + x)

    def place(lengths: Column) -> Column:
        # (length of the gap before a word, of both): a text of n words has n of them
        whole = F.transform(lengths, lambda z: z["gap"] + z["word"])
        last = F.greatest(F.lit(0), F.ceil((F.size(lengths) - target) / F.lit(step)).cast("int"))
        begins = F.transform(F.sequence(F.lit(0), last), lambda i: i * step)

        def windows(w: Column) -> Column:
            sums = F.transform(begins, lambda b: total(F.slice(w, b + 1, F.lit(step))))
            spans = lambda upto: F.zip_with(begins, upto, lambda b, end: F.struct((end - total(F.slice(w, b + 1, F.lit(step))) + F.get(lengths, b)["gap"]).alias("start"), (end - total(F.slice(w, b + 1, F.lit(step))) + total(F.slice(w, b + 1, F.lit(target)))).alias("end")))
            return let(running_sums(sums), spans)

        return let(whole, windows)

    zipped = F.arrays_zip(F.split(text, WORD, -1).alias("gap"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("word"))
    lengths = F.transform(F.filter(zipped, lambda z: z["word"].isNotNull()), lambda z: F.struct(F.length(z["gap"]).alias("gap"), F.length(z["word"]).alias("word")))
    return let(lengths, lambda ls: F.when(F.size(ls) > 0, place(ls)).otherwise(F.array().cast("array<struct<start:int,end:int>>")))


def names(text: Column) -> Column:
    """Surfaces of single capitalised words that are no stopwords, in order."""
    found = F.regexp_extract_all(text, F.lit(CAPITAL_RUN), F.lit(1))
    return F.filter(found, lambda w: w.rlike(CAPITAL_WORD) & is_name(w))


def is_name(word: Column, lower: tuple[str, ...] = vocab.STOPWORDS, title: tuple[str, ...] = vocab.STOPWORDS_TITLE) -> Column:
    keep = (F.length(word) >= 2) & ~F.lower(word).isin(*lower)
    return keep & ~word.isin(*title) if title else keep


def year(text: Column) -> Column:
    return F.regexp_extract(text, YEAR, 1).try_cast("int")


def url_slug(url: Column) -> Column:
    """The last part of a URL's path."""
    return F.regexp_extract(url, "([^/]+)/?$", 1)


def entity_slug(name: Column) -> Column:
    return F.translate(F.lower(name), " -", "__")


def query_path(sparql: Column) -> Column:
    """Names in ``ns:`` of a SPARQL text, in order."""
    return F.regexp_extract_all(sparql, F.lit("ns:([\\w.]+)"), F.lit(1))


def json_between(text: Column) -> Column:
    """From the first bracket to the last of its kind: an array if there is one, else an object, else null."""
    array, thing = F.regexp_extract(F.trim(text), "(?s)(\\[.*\\])", 1), F.regexp_extract(F.trim(text), "(?s)(\\{.*\\})", 1)
    return F.when(array != "", array).when(thing != "", thing)


def first_json_array(text: Column) -> Column:
    """From the first ``[`` to the ``]`` that closes it; null if none does."""
    begin = F.locate("[", text)
    tail = F.substring(text, begin, F.length(text))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(acc: Column, c: Column) -> Column:
        depth = acc["depth"] + F.when(c == "[", 1).when(c == "]", -1).otherwise(0)
        at = acc["at"] + 1
        return F.struct(depth.alias("depth"), at.alias("at"), F.when((acc["end"] == 0) & (c == "]") & (depth == 0), at).otherwise(acc["end"]).alias("end"))

    end = F.aggregate(F.split(tail, ""), start, step)["end"]
    return F.when((begin > 0) & (end > 0), F.substring(tail, F.lit(1), end))


def _pieces(ts: Column) -> Column:
    """Each token with the blank that it has before it, by itself and the last non-empty token before it."""

    def piece(t: Column, i: Column) -> Column:
        def spaced(before: Column) -> Column:
            last = F.right(before, F.lit(1))
            tight = (t == "") | (before == "") | t.isin(*vocab.NO_SPACE_BEFORE) | last.isin(" ", "\n", *vocab.NO_SPACE_AFTER)
            return F.when(tight, t).otherwise(F.concat(F.lit(" "), t))

        near = F.when(i == 0, F.lit("")).otherwise(F.get(ts, i - 1))
        far = F.try_element_at(F.filter(F.slice(ts, 1, i), lambda t: t != ""), F.lit(-1))
        # behind an empty token the last one that isn't is looked for
        return let(near, lambda n: F.when((n != "") | (i == 0), spaced(n)).otherwise(let(F.coalesce(far, F.lit("")), spaced)))

    return F.transform(ts, piece)


def _no_nulls(tokens: Column) -> Column:
    return F.transform(tokens, lambda t: F.coalesce(t, F.lit("")))


def detokenized(tokens: Column) -> Column:
    """The text of :func:`detokenize` alone, without a place for every token."""
    return let(_no_nulls(tokens), lambda ts: F.array_join(_pieces(ts), ""))


def detokenize(tokens: Column) -> Column:
    """struct<text, spans>: tokens joined with blanks where they belong, and the span of each token.

    A token's blank depends on it and the last non-empty token before it; empty tokens have empty spans.
    """

    def build(ts: Column) -> Column:
        def spans(ps: Column) -> Column:
            ends = running_sums(F.transform(ps, F.length))
            place = F.zip_with(ts, ends, lambda t, end: F.struct((end - F.length(t)).alias("start"), end.alias("end")))
            return F.struct(F.array_join(ps, "").alias("text"), place.alias("spans"))

        return let(_pieces(ts), spans)

    return let(_no_nulls(tokens), build)


def normalize_answer(text: Column) -> Column:
    """Lower case without ASCII marks and articles, single blanks; null is empty."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[!-/:-@\\[-`{-~]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(bare, "(?U)\\b(a|an|the)\\b", " "), "\\s+", " "))


def answer_tokens(text: Column) -> Column:
    """Words of the normal form; for a single word its runs of letters and digits, or the parts of its CamelCase."""
    form = normalize_answer(text)
    words = F.filter(F.split(form, "\\s+"), lambda w: w != "")
    runs = F.regexp_extract_all(form, F.lit("[a-z0-9]+"), F.lit(0))
    # fixed value: the parts of a CamelCase word
    parts = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[A-Z][a-z]+|[A-Z]+(?![a-z])|[0-9]+"), F.lit(0))
    camel = F.filter(F.transform(parts, normalize_answer), lambda w: w != "")
    return F.when(F.size(words) != 1, words).when(F.size(runs) > 1, runs).when(F.size(parts) > 0, camel).otherwise(words)


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def cypher_string(text: Column) -> Column:
    """A quoted Cypher string, or null."""
    escaped = F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'"))
    return F.when(text.isNull(), F.lit("null")).otherwise(F.concat(F.lit("'"), escaped, F.lit("'")))


def cypher_value(value: Column, kind: str) -> Column:
    """A Cypher literal of a column of simple type ``kind``; arrays of strings too."""
    if kind == "array<string>":
        return F.when(value.isNull(), F.lit("null")).otherwise(F.concat(F.lit("["), F.array_join(F.transform(value, cypher_string), ", "), F.lit("]")))
    if kind == "string":
        return cypher_string(value)
    return F.coalesce(value.cast("string"), F.lit("null"))
