"""Shapes that only large inputs have: long chains, long documents, common names."""

import random

from pyspark.sql import functions as F

from tessera.operators import extraction, graph, mining, resolution


def plain_chains(parents):
    """leaf -> chain from the root, walked one by one."""
    found = {}
    for leaf in parents.keys() - set(parents.values()):
        chain = [leaf]
        while chain[-1] in parents and parents[chain[-1]] not in chain:
            chain.append(parents[chain[-1]])
        found[leaf] = chain[::-1]
    return found


def family(spark, parents):
    rows = [(c, "DESCENDS_FROM", p) for c, p in parents.items()]
    return spark.createDataFrame(rows, "source_entity_id bigint, predicate string, target_entity_id bigint")


def test_ten_thousand_generations(spark):
    parents = {i: i - 1 for i in range(1, 10_001)}
    found = graph.lineages(family(spark, parents)).collect()
    assert [(r["leaf"], r["depth"], r["chain"]) for r in found] == [(10_000, 10_001, list(range(10_001)))]


def test_lineages_of_forests_and_cycles(spark):
    rng = random.Random(4)
    parents = {i: rng.choice([rng.randrange(i), rng.randrange(400)]) for i in range(1, 400)}
    parents = {c: p for c, p in parents.items() if c != p}
    parents |= {1000 + i: 1000 + (i + 1) % 7 for i in range(7)} | {2000: 1003, 2001: 2000, 2002: 1005, 3000: 3001, 3001: 3000}
    got = {r["leaf"]: r["chain"] for r in graph.lineages(family(spark, parents)).collect()}
    assert got == plain_chains(parents) and any(len(c) != len(set(c) | {0}) for c in got.values())
    assert graph.lineages(family(spark, {}).where("false")).count() == 0
    assert graph.lineages(family(spark, {1: 2, 2: 1})).count() == 0  # a cycle alone has no leaf


def test_interval_join_by_bins(spark):
    rng = random.Random(5)
    text = "".join(rng.choice("abc ") for _ in range(60_000))
    chunks = [(f"c{i}", "d", "s", a, min(a + rng.choice([1, 300, 20_000]), len(text))) for i, a in enumerate(range(0, len(text), 700))]
    spans = [(a, min(a + rng.choice([0, 3, 40, 30_000]), len(text)), "PER") for a in (rng.randrange(len(text)) for _ in range(500))]
    chunk_rows = spark.createDataFrame([(*c, text[c[3] : c[4]]) for c in chunks], "chunk_id string, doc_id string, source string, start_char int, end_char int, text string")
    docs = spark.createDataFrame([("d", spans), ("e", [(0, 5, "PER")])], "doc_id string, spans array<struct<start_char:int,end_char:int,label:string>>")
    got = sorted((r["chunk_id"], r["start_char"], r["end_char"], r["surface"]) for r in extraction.span_mentions(chunk_rows, docs).collect())
    want = []
    for c, _, _, s, e in chunks:
        for a, b, _ in spans:
            if b > s and a < e and text[max(a, s) : min(b, e)].strip():
                want.append((c, max(a, s), min(b, e), text[max(a, s) : min(b, e)].strip()))
    assert got == sorted(want)


def test_a_document_of_many_spans_stays_linear(spark):
    """A million characters, 100,000 spans, 10,000 chunks: the join makes about a row a pair that overlaps."""
    chunks = spark.range(10_000).select(F.concat(F.lit("c"), "id").alias("chunk_id"), F.lit("d").alias("doc_id"), F.lit("s").alias("source"), (F.col("id") * 100).cast("int").alias("start_char"), (F.col("id") * 100 + 120).cast("int").alias("end_char"), F.lit("x" * 120).alias("text"))
    docs = spark.createDataFrame([("d",)], "doc_id string").withColumn("spans", F.transform(F.sequence(F.lit(0), F.lit(99_999)), lambda i: F.struct((i * 10).alias("start_char"), (i * 10 + 4).alias("end_char"), F.lit("PER").alias("label"))))
    found = extraction.span_mentions(chunks, docs)
    assert found.count() == 119_998
    assert "bin" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_name_of_many_entities(spark):
    n = 100_000
    entities = spark.range(2 * n).select(F.format_string("e%07d", "id").alias("entity_id"), F.when(F.col("id") % 2 == 0, "Character").otherwise("Person").alias("entity_type"), F.lit("Ana").alias("canonical_name"))
    classes, members = resolution.lexical_classes(entities)
    assert [(r["norm"], r["first"], r["n"], r["pairs"]) for r in classes.collect()] == [("ana", "e0000000", 2 * n, n * (2 * n - 1))] and members.count() == 2 * n
    assert resolution.lexical_stars(entities).count() == 2 * n - 1
    mentions = entities.select("entity_id", F.when(F.expr("int(substr(entity_id, 2)) % 10 < 5"), "f").otherwise("h").alias("source")).unionByName(entities.limit(10).select("entity_id", F.lit("h").alias("source")))
    rows = {(r["predicate"], r["source_type"]): (r["sources"], r["targets"], r["links"]) for r in resolution.grounding_classes(entities, mentions, "f", "h")[0].collect()}
    here = entities.join(mentions, "entity_id").groupBy("entity_type", "source").agg(F.count_distinct("entity_id").alias("n"))
    size = {(r["entity_type"], r["source"]): r["n"] for r in here.collect()}
    both = {r["entity_type"]: r["n"] for r in mentions.groupBy("entity_id").agg(F.count_distinct("source").alias("s")).where("s = 2").join(entities, "entity_id").groupBy("entity_type").agg(F.count(F.lit(1)).alias("n")).collect()}
    for kind in ("Character", "Person"):
        assert rows["SAME_AS", kind] == (size[kind, "f"], size[kind, "h"], size[kind, "f"] * size[kind, "h"] - both.get(kind, 0))
    assert rows["BASED_ON", "Character"][2] == size["Character", "f"] * size["Person", "h"] and len(rows) == 3


def test_paths_through_a_hub(spark):
    """A start of a thousand neighbours with a thousand each: three hops don't walk a million edges further."""
    n = 1000
    out = spark.range(n).select(F.lit("q").alias("question_id"), F.lit("a").alias("s"), F.concat(F.lit("m"), "id").alias("o"))
    wide = spark.range(n * n).select(F.lit("q").alias("question_id"), F.concat(F.lit("m"), F.col("id") % n).alias("s"), F.concat(F.lit("l"), "id").alias("o"))
    last = spark.createDataFrame([("q", "l5", "z"), ("q", "l1700", "z"), ("q", "l1700", "z")], "question_id string, s string, o string")
    triples = out.unionByName(wide).unionByName(last).withColumn("p", F.lit("r")).withColumn("idx", F.monotonically_increasing_id())
    ends = spark.createDataFrame([("q", "a", "z"), ("q", "a", "gone")], "question_id string, start string, goal string")
    assert sorted(r["path"] for r in mining.simple_paths(triples, ends).collect()) == [["a", "m5", "l5", "z"], *[["a", "m700", "l1700", "z"]] * 2]
    assert [r["path"] for r in mining.shortest_paths(triples, ends, 3).collect()] == [["a", "m5", "l5", "z"]]


def test_paths_of_random_graphs(spark):
    rng = random.Random(8)
    rows, ends = [], []
    for q in range(60):
        nodes = [f"n{i}" for i in range(rng.randint(3, 9))]
        rows += [(q, i, rng.choice(nodes), "r", rng.choice(nodes)) for i in range(rng.randint(3, 14))]
        ends += [(q, *rng.choices([*nodes, "gone"], k=2)) for _ in range(3)]
    ends = sorted(set(ends))
    triples = spark.createDataFrame(rows, "question_id int, idx int, s string, p string, o string")
    asked = spark.createDataFrame(ends, "question_id int, start string, goal string")
    simple, shortest = [], []
    for q, start, goal in ends:
        mine = [(i, s, o) for k, i, s, _, o in rows if k == q]
        walks, level = [[start]], []
        for _ in range(3):
            walks = [[*w, o] for w in walks for _, s, o in mine if s == w[-1] and o not in w and w[-1] != goal]
            simple += [(q, start, goal, tuple(w)) for w in walks if w[-1] == goal]
        at = {}
        for i, s, o in mine:
            for u, v, place in ((s, o, 2 * i), (o, s, 2 * i + 1)):
                at[u, v] = min(place, at.get((u, v), place))
        level = [((), (start,))]
        for _ in range(4 if start != goal else 0):
            level = [((*key, place), (*path, v)) for key, path in level for (u, v), place in at.items() if u == path[-1] and v not in path]
            if hits := [x for x in level if x[1][-1] == goal]:
                shortest.append((q, start, goal, min(hits)[1]))
                break
    got = sorted((r["question_id"], r["start"], r["goal"], tuple(r["path"])) for r in mining.simple_paths(triples, asked).collect())
    assert got == sorted(x for x in simple if x[1] != x[2]) and len(got) > 20
    found = sorted((r["question_id"], r["start"], r["goal"], tuple(r["path"])) for r in mining.shortest_paths(triples, asked).collect())
    assert found == sorted(shortest) and {len(x[3]) for x in found} >= {2, 3, 4}
