"""Relations, resolution, quality control, analytics, mining and metrics on small graphs."""

import json

import pytest
from pyspark.sql import functions as F

from tessera.operators import graph, metrics, mining, quality_control, relations, resolution
from tessera.operators.components import connected_components
from tessera.sources import readers, writers


def edge_rows(spark, rows):
    return spark.createDataFrame([(s, p, t, "d", "c", 0.5, None) for s, p, t in rows], "source_entity_id string, predicate string, target_entity_id string, doc_id string, chunk_id string, confidence double, evidence_text string")


def entity_rows(spark, rows):
    return spark.createDataFrame([(i, k, n, "s", []) for i, k, n in rows], "entity_id string, entity_type string, canonical_name string, source string, aliases array<string>")


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (101, 101), (7, 7), (200, 200)], "u int, v int")
    found = {r.node: r.component for r in connected_components(edges).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 200}
    assert connected_components(edges.where("false")).count() == 0


def test_components_of_a_random_graph(spark):
    import random

    rng = random.Random(2)
    pairs = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)]
    label = {x: x for p in pairs for x in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    found = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "u int, v int")).collect()}
    assert found == label


def test_pairs_are_capped_in_order(spark):
    mentions = [(f"e{i}", "Character" if i else "Location", 0.5) for i in range(60)]
    rows = spark.createDataFrame([(1, mentions)], "sent int, mentions array<struct<entity_id:string,entity_type:string,confidence:double>>")
    found = relations.cooccurrence(rows).collect()
    assert len(found) == 40 and {r.predicate for r in found} == {"LOCATED_IN"} and {r.target_entity_id for r in found} == {"e0"}


def test_semantic_and_temporal(spark):
    text = "Ana iubește pe Ion după ploaie"
    ms = [("a", 0, 3, "Event"), ("i", 15, 18, "Event")]
    chunks = spark.createDataFrame([("c", "d", "s", 0, text, ms)], "chunk_id string, doc_id string, source string, start_char int, text string, mentions array<struct<entity_id:string,start_char:int,end_char:int,entity_type:string>>")
    for between in (False, True):
        found = relations.semantic_relations(chunks, between_only=between).collect()
        assert sorted((r.source_entity_id, r.predicate, r.target_entity_id, r.confidence) for r in found) == [("a", "LOVES", "i", 0.85), ("i", "LOVES", "a", 0.85)]
    assert [(r.predicate, r.confidence) for r in relations.temporal_relations(chunks).collect()] == [("AFTER", 0.7)]


def test_checked_answers(spark):
    good = {"source_entity_id": "e1", "predicate": "loves", "target_entity_id": "e3", "evidence_text": "quote", "confidence": 7}
    bad = [good | {"target_entity_id": "e9"}, good | {"target_entity_id": "e1"}, good | {"evidence_text": "nowhere"}, good | {"predicate": "KILLS", "target_entity_id": "e2"}, good]
    chunks = spark.createDataFrame([("c", "d", "s", "a quote here")], "chunk_id string, doc_id string, source string, text string")
    entities = spark.createDataFrame([("c", "e1", "Character"), ("c", "e2", "Location"), ("c", "e3", "Character")], "chunk_id string, entity_id string, entity_type string")
    answers = spark.createDataFrame([("c", "Answer: " + json.dumps([good, *bad]))], "chunk_id string, response string")
    found = relations.checked_answers(answers, chunks, entities)
    assert [(r.source_entity_id, r.predicate, r.target_entity_id, r.confidence) for r in found.collect()] == [("e1", "LOVES", "e3", 1.0)]
    fallback = edge_rows(spark, [("x", "INTERACTS_WITH", "y")])
    assert relations.with_fallback(found, fallback.withColumn("chunk_id", F.lit("z"))).count() == 2
    hits, misses = relations.cached(spark.createDataFrame([("k",), ("m",)], "cache_key string"), spark.createDataFrame([("k", "v")], "cache_key string, value string"))
    assert hits.count() == misses.count() == 1


def test_events(spark):
    rows = edge_rows(spark, [("a", "INTERACTS_WITH", "b"), ("a", "TRAVELS_TO", "l"), ("a", "OWNS", "b")]).withColumn("source", F.lit("s")).withColumn("evidence_text", F.lit("in 1848 and 1918"))
    events, edges = relations.derive_events(rows)
    assert sorted((r.canonical_name, r.year) for r in events.collect()) == [("INTERACTS_WITH", 1848), ("TRAVELS_TO", 1848)]
    assert sorted(r.predicate for r in edges.collect()) == ["HAS_DESTINATION", *["HAS_PARTICIPANT"] * 3, *["PARTICIPATES_IN"] * 3]


def test_quality_control(spark):
    entities = entity_rows(spark, [("A", "Character", "Ana"), ("B", "Character", "Barbu"), ("P", "Person", "Petre"), ("N", "Character", "Nu")])
    mentions = spark.createDataFrame([("m1", "A"), ("m2", "N")], "mention_id string, entity_id string")
    edges = edge_rows(spark, [("A", "INTERACTS_WITH", "B"), ("B", "INTERACTS_WITH", "A"), ("A", "LOCATED_IN", "P"), ("A", "KILLS", "A"), ("A", "KILLS", "N"), ("A", "KILLS", "B")])
    e, m, r, report = quality_control.quality_control(entities, mentions, edges)
    assert {x.entity_id for x in e.collect()} == {"A", "B", "P"} and [x.mention_id for x in m.collect()] == ["m1"]
    assert sorted((x.source_entity_id, x.predicate, x.target_entity_id) for x in r.collect()) == [("A", "INTERACTS_WITH", "B"), ("A", "KILLS", "B")]
    got = report.first().asDict()
    assert {k: got[f"removed_{k}"] for k in ("self_loops", "missing_ends", "type_violations", "duplicates", "entities")} == {"self_loops": 1, "missing_ends": 1, "type_violations": 1, "duplicates": 1, "entities": 1}
    again = quality_control.quality_control(e, m, r)[3].first()
    assert again.kept_relations == 2 and again.removed_duplicates == 0
    spans = mentions.withColumns({"start_char": F.lit(5), "end_char": F.lit(3)})
    with pytest.raises(quality_control.InvalidGraph):
        quality_control.validate(spans, entities, edges)


def test_lexical_resolution(spark):
    names = [f"name{i % 10}" + (" Jr" if i % 7 == 0 else "") for i in range(100)]
    mentions = spark.createDataFrame([(f"m{i}", f"e{i:03}", n.title() if i % 3 else n, "Character", "s", f"d{i // 10}", i) for i, n in enumerate(names)], "mention_id string, entity_id string, surface string, entity_type string, source string, doc_id string, start_char int")
    found, mapping = resolution.resolve_lexical(mentions)
    assert found.count() == len(set(names)) and mapping.count() == 100
    assert resolution.resolve_lexical(mentions, "per_doc")[0].count() > found.count()
    assert resolution.members(mapping).select(F.sum(F.size("member_entity_ids"))).first()[0] == 100
    with pytest.raises(ValueError):
        resolution.resolve_lexical(mentions, "nowhere")


def test_similarity_and_linkage(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    base = rng.normal(size=(60, 16))
    vectors = np.concatenate([base, base + 0.05 * rng.normal(size=base.shape)])
    rows = spark.createDataFrame([(i, "x", v.tolist()) for i, v in enumerate(vectors)], "id int, scope string, embedding array<double>")
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    want = {(i, j) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.9), strict=True)}
    assert {(r.i, r.j) for r in resolution.similar_pairs(rows, 0.9).collect()} == want
    near = {(r.i, r.j) for r in resolution.lsh_pairs(rows, 0.9).collect()}
    assert near <= want and len(near) >= 0.9 * len(want)
    assert resolution.average_linkage(["ana", "ana", "ion"], np.array([[1.0, 0], [1, 0.01], [0, 1]]), [1, 2, 1], 0.8) == [0, 0, 2]
    entities = entity_rows(spark, [("1", "Person", "Mihai Eminescu"), ("2", "Person", "Mihai Eminescul"), ("3", "Person", "Zoe")])
    mentions = spark.createDataFrame([("1",), ("2",), ("2",)], "entity_id string")
    merged, mapping = resolution.resolve_embedding(entities, mentions, 0.8, 0.7)[:2]
    assert sorted((r.canonical_name, r.mention_count) for r in merged.collect()) == [("Mihai Eminescul", 3), ("Zoe", 0)]
    assert mapping.count() == 3


def test_pagerank_and_communities(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",), ("D",)], "entity_id string")
    edges = edge_rows(spark, [("A", "X", "B"), ("B", "X", "C")])
    ranks = {r.entity_id: r.pagerank for r in graph.pagerank(nodes.where("entity_id <> 'D'"), edges).collect()}
    assert ranks["B"] > ranks["A"] == pytest.approx(ranks["C"]) and sum(ranks.values()) == pytest.approx(1)
    assert [(r["size"], r["members"]) for r in graph.communities(nodes, edges).collect()] == [(3, ["A", "B", "C"])]
    assert {r.entity_id: r.degree for r in graph.degree_centrality(nodes, edges).collect()} == {"A": 1, "B": 2, "C": 1, "D": 0}
    assert graph.pagerank(nodes.where("false"), edges).count() == 0
    report = writers.analytics_report(graph.summary(nodes, edges), graph.communities(nodes, edges), graph.pagerank(nodes, edges, tolerance=1e-2))
    assert report["node_count"] == 4 and report["community_count"] == 1 and report["communities"][0]["members"] == ["A", "B", "C"]
    assert "node_count: 4" in writers.markdown_report(report)


def test_lineage(spark):
    edges = edge_rows(spark, [("a", "DESCENDS_FROM", "b"), ("b", "DESCENDS_FROM", "c"), ("x", "DESCENDS_FROM", "y"), ("y", "DESCENDS_FROM", "x")])
    assert [(r.chain, r.depth) for r in graph.lineages(edges).collect()] == [(["c", "b", "a"], 3)]
    assert [r.target for r in graph.patterns(edges).collect()] == ["a"]


def test_mining(spark):
    graph_rows = [["a", "r", "b"], ["b", "r"], ["b", "r", "c"], ["a", "r", "d"], ["d", "r", "c"], ["c", "r", "e"]]
    questions = spark.createDataFrame([("q", graph_rows, ["a"], ["c"], ["z"])], "question_id string, graph array<array<string>>, q_entity array<string>, a_entity array<string>, answer array<string>")
    triples = mining.flatten_graph(questions)
    assert [r.idx for r in triples.orderBy("idx").collect()] == [0, 1, 2, 3, 4]
    ends = mining.question_ends(questions)
    assert [r.path for r in mining.shortest_paths(triples, ends).collect()] == [["a", "b", "c"]]
    assert sorted(r.path for r in mining.simple_paths(triples, ends).collect()) == [["a", "b", "c"], ["a", "d", "c"]]
    labelled = mining.label_edges(triples, mining.shortest_paths(triples, ends))
    assert [r.label for r in labelled.orderBy("idx").collect()] == [1, 1, 0, 0, 0]
    assert mining.trainable(labelled).count() == mining.valid_samples(triples, mining.simple_paths(triples, ends)).count() == 1
    seeds = spark.createDataFrame([("q", "c", 0)], "question_id string, node string, rank int")
    assert [r.path for r in mining.fallback_paths(triples, seeds).collect()] == [["c", "b"], ["c", "d"], ["c", "e"]]
    assert [r.path for r in mining.fallback_paths(triples, seeds.where("false")).collect()] == [["a", "b"]]
    assert [r.path for r in mining.direct_paths(questions).collect()] == [["a", "c"]]
    parses = spark.createDataFrame([("q", "m.1", ["r1", "r2"], [("m.2", "x"), ("", "New York"), ("", "")])], "question_id string, topic string, chain array<string>, answers array<struct<argument:string,text:string>>")
    assert [r.path for r in mining.parse_paths(parses).collect()] == [["m.1", "r1", "r2", "m.2"], ["m.1", "r1", "r2", "new_york"]]
    codes = mining.encode(spark.createDataFrame([("x", 3), ("y", 1), ("x", 0), ("z", 9)], "v string, pos int"), "v", "pos")
    assert {r.v: r.id for r in codes.collect()} == {"x": 0, "y": 1, "z": 2}


def test_metrics(spark):
    rows = [(1, "a b b", ["b b c"], True), (2, "", ["the"], False), (3, "The Answer is Paris.", ["Paris", "London"], True), (4, "DavidDavid", ["David"], False), (5, None, [], False)]
    scores = {r.question_id: (r.hits, r.em, round(r.f1, 6)) for r in metrics.answer_scores(spark.createDataFrame(rows, "question_id int, prediction string, golds array<string>, any_relevant boolean")).collect()}
    assert scores[1] == (0.0, 0.0, 0.8) and scores[2] == (0.0, 1.0, 1.0) and scores[3][0] == 1.0
    assert scores[4] == (1.0, 0.0, round(2 / 3, 6)) and scores[5] == (0.0, 0.0, 0.0)
    facts = spark.createDataFrame([("q", 0, 0.9, 1), ("q", 1, 0.2, 0), ("q", 2, 0.02, 0)], "question_id string, fact_idx int, prob double, label int")
    assert [r.fact_idx for r in graph.select_facts(facts, 2, 0.5).collect()] == [0] == [r.fact_idx for r in graph.select_facts(facts, 2, 0.95).collect()]
    got = metrics.retrieval_scores(facts).first()
    assert (got.precision, got.recall, got.f1, got.any_relevant) == (1.0, 1.0, 1.0, True)
    assert metrics.losses(facts, margin=1.0).first().ranking == pytest.approx((0.3 + 0.12) / 2)
    assert "hits" in metrics.report(metrics.macro(metrics.answer_scores(spark.createDataFrame(rows, "question_id int, prediction string, golds array<string>, any_relevant boolean"))).first())


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "d.jsonl").write_text('{"text": "Ana.", "author": "X"}\n\n{"text": "  "}\n{"text": "Ion", "doc_id": "i", "spans": [{"start_char": 0, "label": "PER"}]}\n')
    docs = readers.read_documents(spark, str(tmp_path / "d.jsonl"), "s").collect()
    assert len(docs) == 2 and {d.meta.get("author") for d in docs} == {"X", None} and all(d.spans == [] for d in docs)
    (tmp_path / "t.tsv").write_text("a\tb\tc\nx\ty\n")
    assert [tuple(r) for r in readers.read_triples(spark, str(tmp_path / "t.tsv")).collect()] == [("a", "b", "c")]
    (tmp_path / "q.jsonl").write_text('{"Question": "who", "Answers": [{"answer": "x"}], "TopicEntityMid": "m.1", "ID": "7"}\n{"question": "w", "answers": ["y"]}\n')
    got = {r.question: (r.answers, r.entities) for r in readers.read_answers(spark, str(tmp_path / "q.jsonl")).collect()}
    assert got == {"who": (["x"], ["m.1"]), "w": (["y"], [])}
    (tmp_path / "c.yaml").write_text("a: 1\n")
    assert readers.read_config(str(tmp_path / "c.yaml")) == {"a": 1}
    (tmp_path / "log").write_text("extract: 3/10\nnoise\n")
    assert [tuple(r) for r in readers.read_progress(spark, str(tmp_path / "log")).collect()] == [("extract", 3, 10)]
    rows = spark.createDataFrame([("d", 0, ["Ana", "vine"], ["B-PER", "O"]), ("d", 1, ["La", "Cluj"], ["O", "B-LOC"])], "doc_id string, pos int, tokens array<string>, labels array<string>")
    doc = readers.token_documents(rows).first()
    assert doc.text == "Ana vine\nLa Cluj" and [(s.label, doc.text[s.start_char : s.end_char]) for s in doc.spans] == [("PER", "Ana"), ("LOC", "Cluj")]
    writers.write_artifacts({"docs": spark.createDataFrame([("d", "abc")], "doc_id string, text string")}, str(tmp_path / "out"), "_raw")
    assert spark.read.parquet(str(tmp_path / "out/docs_raw")).first().text_len == 3
    train, val = writers.split_last(spark.range(10).withColumnRenamed("id", "pos"), 3)
    assert sorted(r.pos for r in val.collect()) == [7, 8, 9] and train.count() == 7
    line = writers.cypher_script(
        spark.createDataFrame([("w", "O'Neil", "s")], "work_id string, title string, source string"), entity_rows(spark, [("e", "Person", "A")]).limit(0),
        spark.createDataFrame([], "mention_id string, surface string, start_char int, end_char int, work_id string, entity_id string, entity_type string"), edge_rows(spark, []), spark.createDataFrame([], "source_mention_id string, target_mention_id string"),
    ).first()
    assert line.section == 1 and "'O\\'Neil'" in line.line
