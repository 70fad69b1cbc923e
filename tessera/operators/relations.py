"""Mentions -> relations: co-occurrence, keyword patterns, temporal order, checked model answers, events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocab
from tessera.session import cut
from tessera.sources.store import KeyedStore

#: Places of pairs within one sentence or under one keyword class: the unit of the sentences' places.
PLACES = 1 << 32
#: Pairs that one sentence gives at most; pairs of types that make no relation count too.
SENTENCE_PAIRS = 40


def ordered_pairs(items: Column, most: int | None = SENTENCE_PAIRS) -> Column:
    """array<struct<a, b>> of items i < j in order of (i, j), the first ``most`` of them.

    The first ``most`` pairs need only the first ``most`` partners of the first ``most`` items.
    """
    heads = F.slice(items, 1, most) if most else items

    def partners(a: Column, i: Column) -> Column:
        rest = F.slice(items, i + 2, F.lit(most) if most else F.greatest(F.size(items), F.lit(1)))
        return F.transform(rest, lambda b: F.struct(a.alias("a"), b.alias("b")))

    pairs = F.flatten(F.transform(heads, partners))
    return F.slice(pairs, 1, most) if most else pairs


def sentence_groups(chunks: DataFrame, mentions: DataFrame) -> DataFrame:
    """The sentences of each chunk with the mentions that overlap them; a mention across a border stands in both.

    Columns of ``chunks`` but start_char, end_char and text, with ``sentence``, its number ``sent`` and ``mentions`` (in order of place). A chunk
    has a bounded number of mentions, so they are gathered by chunk and no interval is joined.
    """
    item = F.struct("start_char", "end_char", "mention_id", "entity_id", "entity_type", "confidence", "surface")
    gathered = mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("__all"))
    rest = [c for c in chunks.columns if c not in ("start_char", "end_char", "text", "__all")]
    rows = chunks.join(gathered, "chunk_id").select(*rest, F.col("start_char").alias("__base"), "__all", F.posexplode(T.sentences(F.col("text"))).alias("sent", "__s"))
    here = F.filter("__all", lambda m: (m["end_char"] > F.col("__base") + F.col("__s.start")) & (m["start_char"] < F.col("__base") + F.col("__s.end")))
    return rows.select(*rest, "sent", F.col("__s.sentence").alias("sentence"), here.alias("mentions")).where(F.size("mentions") > 1)


def distinct_mentions(mentions: Column) -> Column:
    """One mention an entity: in the place of its first, with the values of its last."""
    first = F.filter(mentions, lambda m, i: ~F.exists(F.slice(mentions, 1, i), lambda e: e["entity_id"] == m["entity_id"]))
    return F.transform(first, lambda m: F.element_at(F.filter(mentions, lambda e: e["entity_id"] == m["entity_id"]), -1))


def cooccurrence(rows: DataFrame, mentions: str = "mentions", most: int = SENTENCE_PAIRS) -> DataFrame:
    """Relations of the mentions that stand together in a row's sentence.

    ``rows``: any columns and ``mentions``, an array of structs with entity_id, entity_type and confidence, in order.
    Of an entity that a sentence names again the last mention counts, in the place of the first. Two characters
    interact; whatever is no location is located in a location; other pairs give nothing, but count for ``most``.
    ``pos`` is the place of a pair among those of its sentence, and of a chunk where rows have a ``sent``.
    """
    rest = [c for c in rows.columns if c != mentions]
    # a column of its own: the pairs refer to it at every item
    pairs = rows.select(*rest, distinct_mentions(F.col(mentions)).alias("__first")).select(*rest, F.posexplode(ordered_pairs(F.col("__first"), most)).alias("n", "p"))
    a, b = F.col("p.a"), F.col("p.b")
    place_a, place_b = a["entity_type"] == "Location", b["entity_type"] == "Location"
    located = place_a != place_b
    return pairs.where(located | (a["entity_type"] == "Character") & (b["entity_type"] == "Character")).select(
        *rest,
        F.when(place_a, b["entity_id"]).otherwise(a["entity_id"]).alias("source_entity_id"),
        F.when(located, "LOCATED_IN").otherwise("INTERACTS_WITH").alias("predicate"),
        F.when(place_a, a["entity_id"]).otherwise(b["entity_id"]).alias("target_entity_id"),
        F.least(a["confidence"], b["confidence"], F.when(located, 0.55).otherwise(0.60)).alias("confidence"),
        F.lit("cooccur_sentence").alias("rel_type"),
        ((F.col("sent").cast("bigint") if "sent" in rest else F.lit(0).cast("bigint")) * PLACES + F.col("n")).alias("pos"),
    )


def mention_relations(chunks: DataFrame, mentions: DataFrame, most: int = SENTENCE_PAIRS) -> DataFrame:
    """Co-occurrence relations of chunks and their mentions, with the sentence as evidence."""
    found = cooccurrence(sentence_groups(chunks.select("chunk_id", "doc_id", "source", "start_char", "text"), mentions), most=most)
    return found.select("source_entity_id", "predicate", "target_entity_id", "doc_id", "chunk_id", "source", "confidence", T.compact(F.col("sentence")).alias("evidence_text"), "rel_type", "pos")


def all_pairs(rows: DataFrame, items: str) -> DataFrame:
    """``rows`` with a, b and n of all pairs i < j of the array ``items``, which goes; n is the place of a pair in order of (i, j).

    Items meet by two explodes: no array of all pairs is built, and what isn't asked of a pair isn't copied.
    """
    rest = [c for c in rows.columns if c != items]
    # outer: else Spark first asks whether the array is empty, and makes all of it for that once more
    heads = rows.select(*rest, items, F.posexplode_outer(items).alias("__i", "a")).where("__i IS NOT NULL")
    pairs = heads.select(*rest, "__i", "a", F.size(items).alias("__size"), F.posexplode(F.slice(items, F.col("__i") + 2, F.size(items))).alias("__d", "b"))
    i, size = F.col("__i").cast("bigint"), F.col("__size")
    return pairs.select(*rest, "a", "b", (F.shiftright(i * (2 * size - i - 1), 1) + F.col("__d")).alias("n"))


def semantic_relations(chunks: DataFrame, mentions: str = "mentions", between_only: bool = False, patterns: tuple = vocab.SEMANTIC_PATTERNS, evidence: bool = True, digits: int | None = None) -> DataFrame:
    """Relations whose keywords stand between two mentions or, unless ``between_only``, anywhere in their chunk.

    ``chunks``: chunk_id, doc_id, source, start_char, text and ``mentions`` (structs with entity_id, start_char,
    end_char). Keywords are counted once a chunk; symmetric predicates give both directions. Without ``evidence`` the
    text between two mentions is not cut out and ``evidence_text`` is null; then mentions need no places. ``digits``
    rounds the confidence, where it is that of the chunk before the pairs are made.
    """
    places = evidence or between_only
    item = F.col(mentions) if places else F.transform(mentions, lambda m: F.struct(m["entity_id"].alias("entity_id")))
    kinds = F.array(*(F.struct(F.lit(p).alias("predicate"), F.array(*map(F.lit, k)).alias("keywords"), F.lit(c).alias("base"), F.lit(s).alias("symmetric")) for p, k, c, s in patterns))
    rest = ["chunk_id", "doc_id", "source", *(["start_char", "text"] if places else [])]
    rows = chunks.select(*rest, F.lower("text").alias("low"), item.alias("items")).select("*", F.posexplode(kinds).alias("k", "kind"))
    # no keyword in the chunk, none between its mentions
    rows = rows.select(*rest, "items", "k", "kind", F.filter("kind.keywords", lambda k: F.contains(F.col("low"), k)).alias("here")).where(F.size("here") > 0)

    def confidence(hits: Column) -> Column:
        found = F.least(F.col("kind.base") + 0.05 * (hits - 1), F.lit(0.95))
        return found if digits is None else F.round(found, digits)

    # directions before pairs: a pair is then two rows and no array
    forward = F.explode(F.when(F.col("kind.symmetric"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True)))).alias("forward")
    if between_only:
        rows = rows.select(*rest, "items", "k", "kind", "here", forward)
    else:
        rows = rows.select(*rest, "items", "k", F.col("kind.predicate").alias("predicate"), confidence(F.size("here")).alias("confidence"), forward)
    pairs = all_pairs(rows, "items")
    a, b = F.col("a"), F.col("b")
    evidence_text = F.lit(None).cast("string")
    if places:
        lo, hi = F.least(a["end_char"], b["end_char"]), F.greatest(a["start_char"], b["start_char"])
        pairs = pairs.withColumn("between", T.span_text(F.col("text"), lo - F.col("start_char"), hi - F.col("start_char")))
    if evidence:
        evidence_text = F.substring("between", 1, 200)
    if between_only:
        hits = F.size(F.filter("here", lambda k: F.contains(F.lower("between"), k)))
        pairs = pairs.withColumn("hits", hits).where("hits > 0").withColumn("predicate", F.col("kind.predicate")).withColumn("confidence", confidence(F.col("hits")))
    return pairs.select(
        F.when(F.col("forward"), a["entity_id"]).otherwise(b["entity_id"]).alias("source_entity_id"), "predicate", F.when(F.col("forward"), b["entity_id"]).otherwise(a["entity_id"]).alias("target_entity_id"), "doc_id", "chunk_id", "source",
        "confidence", evidence_text.alias("evidence_text"), F.lit("semantic_pattern").alias("rel_type"),
        (F.col("k").cast("bigint") * PLACES + F.col("n")).alias("pos"),
    )


def temporal_relations(chunks: DataFrame, mentions: str = "mentions", indicators: tuple = vocab.TEMPORAL_INDICATORS) -> DataFrame:
    """Pairs of event mentions of a chunk under the first temporal class that has an indicator in the chunk."""
    low = F.lower("text")
    kind = F.coalesce(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w)), F.lit(name)) for name, words in indicators))
    events = F.transform(F.filter(mentions, lambda m: m["entity_type"] == "Event"), lambda m: m["entity_id"])
    rows = chunks.withColumn("predicate", kind).where("predicate IS NOT NULL").select("chunk_id", "doc_id", "source", "predicate", events.alias("items"))
    pairs = all_pairs(rows, "items")
    return pairs.select(F.col("a").alias("source_entity_id"), "predicate", F.col("b").alias("target_entity_id"), "doc_id", "chunk_id", "source", F.lit(0.7).alias("confidence"), F.lit("temporal").alias("rel_type"), (F.lit(len(vocab.SEMANTIC_PATTERNS)).cast("bigint") * PLACES + F.col("n")).alias("pos"))


def type_allows(predicate: Column, source_type: Column, target_type: Column, owns_places: bool = False) -> Column:
    """The graph's type rule; with ``owns_places`` the rule for model answers, where locations may be owned."""
    person, place = source_type != "Location", target_type == "Location"
    rule = F.when(predicate.isin("LOCATED_IN", "TRAVELS_TO"), person & place)
    if owns_places:
        rule = rule.when(predicate == "OWNS", person)
    return rule.when(predicate.isin("INTERACTS_WITH", "LOVES", "HATES", "KILLS", "OWNS", "DESCENDS_FROM"), person & ~place).otherwise(True)


def entity_table(mentions: DataFrame, most: int = 25) -> DataFrame:
    """The entities a model is asked about, for each chunk: one mention a normal form, the ``most`` most confident."""
    form = T.normalize_mention(F.col("surface"))
    one = Window.partitionBy("chunk_id", "form").orderBy(F.desc("confidence"), F.length("surface"), "start_char", "mention_id")
    top = Window.partitionBy("chunk_id").orderBy(F.desc("confidence"), F.length("surface"), "entity_id")
    rows = mentions.withColumn("form", form).where("form <> ''").withColumn("n", F.row_number().over(one)).where("n = 1")
    return rows.withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= most).select("chunk_id", "rank", "entity_id", "surface", "entity_type")


RESPONSE = "array<struct<source_entity_id:string,predicate:string,target_entity_id:string,confidence:string,evidence_text:string>>"


def checked_answers(answers: DataFrame, chunks: DataFrame, entities: DataFrame, most: int = 30) -> DataFrame:
    """Relations of model answers that hold up: known ids and predicate, no loop, a quote from the chunk, the type rule.

    ``answers``: chunk_id and ``response``, the text of the answer. Its first ``most`` relations count; equal ones once.
    """
    parsed = F.from_json(F.coalesce(T.first_json_array(F.col("response")), T.json_between(F.col("response"))), RESPONSE)
    rows = answers.select("chunk_id", F.posexplode(F.slice(parsed, 1, most)).alias("pos", "r"))
    r = rows.select("chunk_id", "pos", F.trim("r.source_entity_id").alias("source_entity_id"), F.upper(F.trim("r.predicate")).alias("predicate"), F.trim("r.target_entity_id").alias("target_entity_id"), F.coalesce(F.col("r.confidence").try_cast("double"), F.lit(0.75)).alias("c"), F.trim("r.evidence_text").alias("evidence_text"))
    kinds = entities.select("chunk_id", F.col("entity_id"), "entity_type")
    s, t = (kinds.select("chunk_id", F.col("entity_id").alias(f"{x}_entity_id"), F.col("entity_type").alias(f"{x}_type")) for x in ("source", "target"))
    ok = r.where(F.col("predicate").isin(*vocab.LLM_PREDICATES) & (F.col("source_entity_id") != F.col("target_entity_id")) & (F.col("evidence_text") != ""))
    ok = ok.join(s, ["chunk_id", "source_entity_id"]).join(t, ["chunk_id", "target_entity_id"]).join(chunks.select("chunk_id", "doc_id", "source", "text"), "chunk_id")
    ok = ok.where(F.contains("text", "evidence_text") & type_allows(F.col("predicate"), F.col("source_type"), F.col("target_type"), True))
    once = Window.partitionBy("chunk_id", "source_entity_id", "predicate", "target_entity_id").orderBy("pos")
    return ok.withColumn("n", F.row_number().over(once)).where("n = 1").select(
        "source_entity_id", "predicate", "target_entity_id", "doc_id", "chunk_id", "source", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "c")).alias("confidence"), "evidence_text", F.lit("llm_json").alias("rel_type")
    )


def with_fallback(answers: DataFrame, fallback: DataFrame) -> DataFrame:
    """Model relations, and the fallback's for chunks that have none."""
    return answers.unionByName(fallback.join(answers.select("chunk_id").distinct(), "chunk_id", "left_anti"), allowMissingColumns=True)


def cached(keys: DataFrame, cache: DataFrame, key: str = "cache_key") -> tuple[DataFrame, DataFrame]:
    """(rows found in a content-addressed cache, rows to compute)."""
    return keys.join(cache, key), keys.join(cache.select(key), key, "left_anti")


def model_answers(chunks: DataFrame, mentions: DataFrame, provider, cache: str | None = None) -> DataFrame:
    """(chunk_id, response): what a model says to the entity table and the text of each chunk that has mentions.

    ``provider`` has ``name`` and ``answer(prompts) -> answers``; it is sent to the workers and called once a batch.
    Answers are kept below the folder ``cache`` by a digest of model and prompt: what is there is never asked again, an
    interruption keeps the finished rounds, and builds that share the folder don't ask twice (:class:`KeyedStore`).
    """
    table_ = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "entity_id", "surface", "entity_type"))), lambda e: F.struct(e["entity_id"].alias("entity_id"), e["surface"].alias("name"), e["entity_type"].alias("type"))))
    asked = entity_table(mentions).groupBy("chunk_id").agg(table_.alias("table")).join(chunks.select("chunk_id", "text"), "chunk_id")
    prompt = F.concat(F.lit("Entities: "), F.col("table"), F.lit("\nPredicates: " + ", ".join(vocab.LLM_PREDICATES) + "\nText: "), F.col("text"))
    keyed = asked.select("chunk_id", prompt.alias("prompt")).withColumn("key", F.sha1(F.concat_ws(T.UNIT, F.lit(provider.name), "prompt").cast("binary")))

    def ask(batches):
        for pdf in batches:
            yield pdf[["key"]].assign(value=provider.answer(pdf["prompt"].tolist()))

    answer = lambda rows: rows.select("key", "prompt").mapInPandas(ask, "key string, value string")
    if cache is None:
        found = cut(answer(keyed.dropDuplicates(["key"])), "model-answers")
    else:
        keyed = cut(keyed, "model-prompts")
        found = KeyedStore(chunks.sparkSession, cache).fill(keyed.select("key", "prompt"), answer)
    return keyed.join(found, "key").select("chunk_id", F.col("value").alias("response"))


def derive_events(relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event entities, their edges): one event for each relation of the event predicates, with its participants."""
    evidence = F.coalesce("evidence_text", F.lit(""))
    rows = relations.where(F.col("predicate").isin(*vocab.EVENT_PREDICATES)).withColumn("evidence_text", evidence)
    key = T.stable_id("evt", *(F.col(c) for c in ("doc_id", "chunk_id", "predicate", "source_entity_id", "target_entity_id", "evidence_text")))
    rows = rows.withColumn("event_id", key)
    events = rows.select(F.col("event_id").alias("entity_id"), F.lit("Event").alias("entity_type"), F.col("predicate").alias("canonical_name"), "source", "doc_id", "chunk_id", "evidence_text", T.year(F.col("evidence_text")).alias("year"))
    edge = lambda s, p, t: F.struct(s.alias("source_entity_id"), F.lit(p).alias("predicate"), t.alias("target_entity_id"))
    e, s, t = F.col("event_id"), F.col("source_entity_id"), F.col("target_entity_id")
    both = F.array(edge(s, "PARTICIPATES_IN", e), edge(e, "HAS_PARTICIPANT", s))
    more = F.when(F.col("predicate") == "INTERACTS_WITH", F.array(edge(t, "PARTICIPATES_IN", e), edge(e, "HAS_PARTICIPANT", t))).when(F.col("predicate") == "TRAVELS_TO", F.array(edge(e, "HAS_DESTINATION", t))).otherwise(F.slice(both, 1, 0))
    edges = rows.select("doc_id", "chunk_id", "source", "confidence", "evidence_text", F.inline(F.concat(both, more)), F.lit("derived_event").alias("rel_type"))
    return events.dropDuplicates(["entity_id"]), edges


def coreference(mentions: DataFrame) -> DataFrame:
    """Edges from an entity's first mention in a document to its mentions of another surface."""
    order = Window.partitionBy("doc_id", "entity_id").orderBy("start_char", "mention_id")
    rows = mentions.withColumn("rep", F.first(F.struct("mention_id", "surface")).over(order)).where("surface <> rep.surface")
    return rows.select(F.col("rep.mention_id").alias("source_mention_id"), F.col("mention_id").alias("target_mention_id"), "doc_id", "entity_id")
