"""Documents -> chunks, sentences and mentions. Per-document work stays in array expressions: no join, no shuffle."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocab
from tessera.session import cut
from tessera.sources.store import KeyedStore


def ingest(raw: DataFrame, source: str) -> DataFrame:
    """Documents of raw rows: those with text; ids made up from position where missing; well-formed spans; text meta.

    ``raw``: text and optionally doc_id, title, spans, meta, ``file`` and ``pos`` (place in the file).
    """
    has = set(raw.columns)
    col = lambda name, kind: F.col(name) if name in has else F.lit(None).cast(kind)
    kind = "array<struct<start_char:int,end_char:int,label:string,surface:string>>"
    spans = F.filter(F.coalesce(col("spans", kind), F.array().cast(kind)), lambda s: s["start_char"].isNotNull() & s["end_char"].isNotNull() & s["label"].isNotNull())
    doc_id = F.coalesce(F.nullif(col("doc_id", "string").cast("string"), F.lit("")), T.stable_id("doc", F.lit(source), *([F.col("file")] if "file" in has else []), col("pos", "string")))
    return raw.where(T.has_text(F.col("text"))).select(
        doc_id.alias("doc_id"), F.lit(source).alias("source"), col("title", "string").cast("string").alias("title"), T.normalize_text(F.col("text")).alias("text"), spans.alias("spans"), col("meta", "map<string,string>").alias("meta")
    )


def normalize_documents(docs: DataFrame) -> DataFrame:
    """Normal text, spans clamped to it, surfaces normalised or filled from the text."""

    def fix(s: Column) -> Column:
        a, b = T.clamp(s["start_char"], s["end_char"], F.length("text"))
        surface = F.coalesce(T.comma_below(s["surface"]), T.span_text(F.col("text"), a, b))
        return F.struct(a.alias("start_char"), b.alias("end_char"), s["label"].alias("label"), surface.alias("surface"))

    return docs.withColumn("text", T.normalize_text(F.col("text"))).withColumn("spans", F.transform("spans", fix))


def chunk_documents(docs: DataFrame, target: int = 250, overlap: int = 40, tokenizer=None) -> DataFrame:
    """(chunk_id, doc_id, source, start_char, end_char, text) of every chunk; documents without words have none.

    Tokens are words, or those of ``tokenizer``: a provider with ``offsets(texts)``, a list of (start, end) in code points for
    each text, which is sent to the workers and called once a batch.
    """
    if tokenizer is None:
        places = T.word_chunks(F.col("text"), target, overlap)
    else:

        @F.pandas_udf("array<struct<start:int,end:int>>")
        def offsets(text: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in spans] for spans in tokenizer.offsets(text.fillna("").tolist())])

        docs = docs.select("doc_id", "source", "text", offsets("text").alias("__tokens"))
        places = T.chunks(F.col("__tokens"), target, overlap)
    # outer: else Spark first asks whether there are places, and makes all of them for that once more
    spans = docs.select("doc_id", "source", "text", F.explode_outer(places).alias("c")).where("c IS NOT NULL")
    return spans.select(
        T.stable_id("chunk", F.col("doc_id"), F.col("c.start"), F.col("c.end")).alias("chunk_id"),
        "doc_id", "source", F.col("c.start").alias("start_char"), F.col("c.end").alias("end_char"), T.span_text(F.col("text"), F.col("c.start"), F.col("c.end")).alias("text"),
    )


def sentence_rows(docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` but the text, with sent, start_char, end_char and sentence."""
    rest = [c for c in docs.columns if c != "text"]
    return docs.select(*rest, F.posexplode(T.sentences(F.col("text"))).alias("sent", "s")).select(*rest, "sent", F.col("s.start").alias("start_char"), F.col("s.end").alias("end_char"), F.col("s.sentence").alias("sentence"))


def _with_ids(mentions: DataFrame) -> DataFrame:
    mention_id = T.stable_id("m", F.col("doc_id"), F.col("chunk_id"), F.col("start_char"), F.col("end_char"), F.col("surface"))
    return mentions.withColumn("mention_id", mention_id).withColumn("entity_id", T.stable_id("ent", F.lit("mention"), F.col("mention_id")))


def regex_mentions(chunks: DataFrame, fictional_source: str, confidence: float = 0.5, advanced: bool = False) -> DataFrame:
    """Mentions of one to four capitalised words; characters in the fictional source, persons elsewhere."""
    found = chunks.select("chunk_id", "doc_id", "source", F.col("start_char").alias("base"), F.explode(T.match_spans(F.col("text"), T.NAME)).alias("m"))
    keep = T.is_name(F.col("surface"), vocab.STOPWORDS_SHORT, ()) if advanced else T.is_name(F.col("surface"))
    rows = found.select("chunk_id", "doc_id", "source", F.col("m.token").alias("surface"), (F.col("base") + F.col("m.start")).alias("start_char"), (F.col("base") + F.col("m.end")).alias("end_char")).where(keep)
    kind = F.when(F.col("source") == fictional_source, "Character").otherwise("Person")
    return _with_ids(rows.withColumn("entity_type", kind).withColumn("confidence", F.lit(0.6 if advanced else confidence)))


def advanced_mentions(chunks: DataFrame, fictional_source: str, confidence: float = 0.5) -> DataFrame:
    """The rows of :func:`regex_mentions` and of its ``advanced`` form; the expression runs once a chunk and an id is made once for both."""
    found = chunks.select("chunk_id", "doc_id", "source", F.col("start_char").alias("base"), F.explode(T.match_spans(F.col("text"), T.NAME)).alias("m"))
    rows = found.select("chunk_id", "doc_id", "source", F.col("m.token").alias("surface"), (F.col("base") + F.col("m.start")).alias("start_char"), (F.col("base") + F.col("m.end")).alias("end_char"))
    first, second = T.is_name(F.col("surface")), T.is_name(F.col("surface"), vocab.STOPWORDS_SHORT, ())
    kind = F.when(F.col("source") == fictional_source, "Character").otherwise("Person")
    lists = F.array_compact(F.array(F.when(first, F.lit(confidence)), F.when(second, F.lit(0.6))))
    ids = _with_ids(rows.where(first | second).withColumn("entity_type", kind).withColumn("lists", lists))
    return ids.select(*rows.columns, "entity_type", F.explode("lists").alias("confidence"), "mention_id", "entity_id")


FOUND = "array<struct<surface:string,start:int,end:int,label:string,score:double>>"


def _found_words(text: str, items: list[dict]) -> list[dict]:
    """A model's words with their places: where start and end are left out, behind the word before, else anywhere, else dropped."""
    rows, behind = [], 0
    for item in items:
        surface = str(item.get("word") or "").strip()
        begin, end = item.get("start"), item.get("end")
        if begin is None or end is None:
            begin = text.find(surface, behind)
            begin = text.find(surface) if begin < 0 else begin
            end = begin + len(surface)
            behind = end if begin >= 0 else behind
        if surface and begin >= 0:
            rows.append({"surface": surface, "start": int(begin), "end": int(end), "label": str(item.get("label") or "").upper(), "score": float(item.get("score", 0.5))})
    return rows


def model_mentions(chunks: DataFrame, provider, fictional_source: str, cache: str | None = None) -> DataFrame:
    """Mentions that a model finds. ``provider.find(texts)`` gives, for each text, dicts of word, label, score, start and end.

    Where a model leaves start and end out, the word is looked up behind the one before it, then in the whole text, and
    dropped if it isn't there. Model labels are mapped; characters stand in the fictional source only. What a model
    found is kept below the folder ``cache`` by a digest of model, document, chunk and text (:class:`KeyedStore`).
    """
    name = getattr(provider, "name", type(provider).__name__)
    digest = F.sha1(F.concat_ws(T.UNIT, F.lit(name), "doc_id", "chunk_id", "text").cast("binary"))
    keyed = chunks.select("chunk_id", "doc_id", "source", "start_char", "text", digest.alias("key"))

    def find(batches):
        for pdf in batches:
            found = zip(pdf["text"], provider.find(pdf["text"].tolist()), strict=True)
            yield pdf[["key"]].assign(value=[json.dumps(_found_words(text, items)) for text, items in found])

    ask = lambda rows: rows.select("key", "text").mapInPandas(find, "key string, value string")
    found = cut(ask(keyed), "model-mentions") if cache is None else KeyedStore(chunks.sparkSession, cache).fill(keyed.select("key", "text"), ask)
    items = keyed.drop("text").join(found.dropDuplicates(["key"]), "key").select("chunk_id", "doc_id", "source", F.col("start_char").alias("base"), F.inline(F.from_json("value", FOUND)))
    fictional = F.col("source") == fictional_source
    kind = label_type(F.col("label"), vocab.MODEL_LABELS, "")
    kind = F.when(kind == "", F.when(fictional, "Character").otherwise("Person")).when((kind == "Character") & ~fictional, "Person").otherwise(kind)
    placed = items.select("chunk_id", "doc_id", "source", "surface", (F.col("base") + F.col("start")).alias("start_char"), (F.col("base") + F.col("end")).alias("end_char"), F.col("score").alias("confidence"), kind.alias("entity_type"))
    return _with_ids(placed)


def label_type(label: Column, mapping: dict[str, str], default: str) -> Column:
    known = F.create_map(*(F.lit(x) for pair in mapping.items() for x in pair))
    return F.coalesce(known[F.upper(label)], F.lit(default))


#: Characters of one bin of the interval join; above the usual length of a chunk, so that most chunks stand in one bin.
BIN = 8192


def _bins(start: Column, end: Column) -> Column:
    """The bins that an interval touches; an empty one touches that of its place."""
    return F.sequence(F.floor(start / BIN), F.floor(F.greatest(start, end - 1) / BIN))


def span_mentions(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Gold spans clipped to each chunk they overlap: an interval join by document and bins of characters.

    A span and a chunk meet in every bin they share and count in the first, so each pair is made once and a long
    document with many spans is many keys.
    """
    spans = docs.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start_char").alias("a"), F.col("s.end_char").alias("b"), F.col("s.label").alias("label"))
    left = chunks.withColumn("bin", F.explode(_bins(F.col("start_char"), F.col("end_char"))))
    right = spans.where("b >= a").withColumn("bin", F.explode(_bins(F.col("a"), F.col("b"))))
    first = F.col("bin") == F.floor(F.greatest("a", "start_char") / BIN)
    joined = left.join(right, ["doc_id", "bin"]).where(first & (F.col("b") > F.col("start_char")) & (F.col("a") < F.col("end_char")))
    begin, end = F.greatest("a", "start_char"), F.least("b", "end_char")
    raw = F.substring(F.col("text"), begin - F.col("start_char") + 1, end - begin)
    rows = joined.select("chunk_id", "doc_id", "source", begin.alias("start_char"), end.alias("end_char"), F.trim(F.regexp_replace(raw, "^\\s+|\\s+$", "")).alias("surface"), label_type(F.col("label"), vocab.GOLD_LABELS, "Person").alias("entity_type"))
    return _with_ids(rows.where(F.col("surface") != "").withColumn("confidence", F.lit(0.99)))


def extract_mentions(docs: DataFrame, chunks: DataFrame, gold_source: str, fictional_source: str, engine: str = "regex", provider=None, cache: str | None = None) -> DataFrame:
    """Gold spans for documents of the gold source that have some, ``engine`` for all others.

    Engines: ``regex``; ``model`` (of ``provider``); ``ensemble``, both merged; ``advanced``, the second expression's and the
    first's mentions by vote.
    """
    gold = docs.where((F.col("source") == gold_source) & (F.size("spans") > 0))
    spanned = span_mentions(chunks.join(gold.select("doc_id"), "doc_id", "left_semi"), gold)
    rest = chunks.join(gold.select("doc_id"), "doc_id", "left_anti")
    if engine == "regex":
        found = regex_mentions(rest, fictional_source)
    elif engine == "model":
        found = model_mentions(rest, provider, fictional_source, cache)
    elif engine == "ensemble":
        found = merge_mentions(regex_mentions(rest, fictional_source), model_mentions(rest, provider, fictional_source, cache))
    elif engine == "advanced":
        found = vote_overlaps(advanced_mentions(rest, fictional_source)).drop("merged_from")
    else:
        raise ValueError(f"unknown engine {engine!r}")
    return spanned.unionByName(found)


def merge_mentions(first: DataFrame, second: DataFrame) -> DataFrame:
    """One mention for each (document, span, normal form): the more confident, then the first list's."""
    both = first.withColumn("__from", F.lit(0)).unionByName(second.withColumn("__from", F.lit(1)))
    key = Window.partitionBy("doc_id", "start_char", "end_char", T.normalize_mention(F.col("surface"))).orderBy(F.desc("confidence"), "__from", "mention_id")
    return both.withColumn("__n", F.row_number().over(key)).where("__n = 1").drop("__n", "__from")


def vote_overlaps(mentions: DataFrame) -> DataFrame:
    """One mention for each run of overlaps in a chunk, with the type of most confidence.

    A run is what begins before the end of its first mention. That sweep depends on order, so it is one pass over
    the sorted array of a chunk's mentions.
    """
    item = F.struct("start_char", "end_char", "mention_id", "surface", "entity_type", "confidence")
    sorted_ = mentions.groupBy("doc_id", "chunk_id", "source").agg(F.array_sort(F.collect_list(item)).alias("ms"))
    start = F.struct(F.lit(-1).alias("anchor"), F.lit(-1).alias("run"), F.array().cast("array<int>").alias("runs"))

    def step(acc: Column, m: Column) -> Column:
        fresh = (acc["run"] < 0) | (m["start_char"] >= acc["anchor"])
        run = acc["run"] + F.when(fresh, 1).otherwise(0)
        return F.struct(F.when(fresh, m["end_char"]).otherwise(acc["anchor"]).alias("anchor"), run.alias("run"), F.concat(acc["runs"], F.array(run)).alias("runs"))

    rows = sorted_.withColumn("runs", F.aggregate("ms", start, step)["runs"]).select("doc_id", "chunk_id", "source", F.inline(F.arrays_zip("ms", "runs"))).select("doc_id", "chunk_id", "source", F.col("runs").alias("run"), "ms.*")
    # rows stay where their chunk is: a run is one group, and its votes by type are counted in its row
    best = F.max_by(F.struct("start_char", "end_char", "surface"), F.struct("confidence", (-F.col("start_char")).alias("a"), (-F.col("end_char")).alias("b")))
    ballots = F.collect_list(F.struct("entity_type", "confidence", "start_char", "end_char", "mention_id"))
    merged = rows.groupBy("doc_id", "chunk_id", "source", "run").agg(best.alias("m"), F.least(F.avg("confidence"), F.lit(1.0)).alias("confidence"), F.count(F.lit(1)).alias("merged_from"), ballots.alias("ballots"))

    def stand(kind: Column) -> Column:
        mine = F.filter("ballots", lambda v: v["entity_type"] == kind)
        first = F.array_min(F.transform(mine, lambda v: F.struct(v["start_char"].alias("a"), v["end_char"].alias("b"), v["mention_id"].alias("id"))))
        votes = F.aggregate(mine, F.lit(0.0), lambda n, v: n + v["confidence"])
        return F.struct(votes.alias("votes"), (-first["a"]).alias("a"), (-first["b"]).alias("b"), kind.alias("entity_type"))

    kinds = F.array_distinct(F.transform("ballots", lambda v: v["entity_type"]))
    chosen = F.when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise(F.array_max(F.transform(kinds, stand))["entity_type"])
    out = merged.select("doc_id", "chunk_id", "source", "m.*", chosen.alias("entity_type"), "confidence", "merged_from")
    return _with_ids(out)


def bio_spans(tokens: DataFrame) -> DataFrame:
    """Spans of BIO labels. ``tokens``: doc_id, pos, start, end, label. A change of label or a B begins a span."""
    label = F.upper(F.trim(F.coalesce("label", F.lit("O"))))
    dash = F.locate("-", label)
    t = tokens.withColumn("__l", label).withColumn("prefix", F.when(dash > 0, F.substring_index(label, "-", 1)).otherwise("B"))
    t = t.withColumn("kind", F.when(dash > 0, F.trim(F.substring(label, dash + 1, F.length(label)))).otherwise(label)).withColumn("out", F.col("__l").isin("O", ""))
    order = Window.partitionBy("doc_id").orderBy("pos")
    fresh = F.lag("out", 1, True).over(order) | (F.col("prefix") == "B") | (F.lag("kind").over(order) != F.col("kind"))
    marked = t.withColumn("fresh", (~F.col("out") & fresh).cast("int")).withColumn("island", F.sum("fresh").over(order)).where("NOT out")
    spans = marked.groupBy("doc_id", "island").agg(F.min("start").alias("start_char"), F.max_by("end", "pos").alias("end_char"), F.min_by("kind", "pos").alias("label"))
    return spans.where("end_char > start_char").drop("island")


def bio_spans_of(tokens: Column) -> Column:
    """array<struct<start_char, end_char, label>>: :func:`bio_spans` of an array of structs with start, end and label, in order."""

    def read(x: Column) -> Column:
        label = F.upper(F.trim(F.coalesce(x["label"], F.lit("O"))))
        dash = F.locate("-", label)
        kind = F.when(dash > 0, F.trim(F.substring(label, dash + 1, F.length(label)))).otherwise(label)
        return F.struct(x["start"].alias("start"), x["end"].alias("end"), kind.alias("kind"), F.when(dash > 0, F.substring_index(label, "-", 1)).otherwise("B").alias("prefix"))

    outside = lambda x: F.upper(F.trim(F.coalesce(x["label"], F.lit("O")))).isin("O", "")
    # what stands outside goes first; its place shows where a span can't go on
    placed = F.filter(F.transform(tokens, lambda x, i: F.when(~outside(x), F.struct(i.alias("i"), read(x).alias("x")))), lambda t: t.isNotNull())

    def spans(ts: Column) -> Column:
        def fresh(t: Column, k: Column) -> Column:
            before = F.get(ts, k - 1)
            return (k == 0) | (before["i"] < t["i"] - 1) | (t["x"]["prefix"] == "B") | (before["x"]["kind"] != t["x"]["kind"])

        begins = F.filter(F.transform(ts, lambda t, k: F.when(fresh(t, k), k)), lambda k: k.isNotNull())

        def one(bs: Column) -> Column:
            def span(b: Column, n: Column) -> Column:
                end = F.coalesce(F.get(bs, n + 1), F.size(ts))
                start = F.array_min(F.transform(F.slice(ts, b + 1, end - b), lambda t: t["x"]["start"]))
                return F.struct(start.alias("start_char"), F.get(ts, end - 1)["x"]["end"].alias("end_char"), F.get(ts, b)["x"]["kind"].alias("label"))

            return F.filter(F.transform(bs, span), lambda s: s["end_char"] > s["start_char"])

        return T.let(begins, one)

    return T.let(placed, spans)


def contexts(mentions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(chunk_id, context_chunk_id): the previous chunk of a document, if both share a normal form."""
    forms = mentions.groupBy("chunk_id").agg(F.collect_set(T.normalize_mention(F.col("surface"))).alias("forms"))
    order = Window.partitionBy("doc_id").orderBy("start_char")
    rows = chunks.join(forms, "chunk_id", "left").withColumn("before", F.lag("chunk_id").over(order)).withColumn("before_forms", F.lag("forms").over(order))
    return rows.select("chunk_id", F.when(F.arrays_overlap("forms", "before_forms"), F.col("before")).alias("context_chunk_id"))
