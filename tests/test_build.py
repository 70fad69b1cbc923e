"""The whole build on three documents, its goldens, resume, export, load and providers."""

import json
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import build
from tessera.operators import extraction, quality_control, relations, resolution
from tessera.session import read_text
from tessera.sources import readers, writers

STORIES = [
    {"doc_id": "p1", "title": "Una", "author": "A", "text": "Într-o dimineață Ana a plecat singură spre București. Acolo locuia vechiul ei prieten Mihai. Seara, Ana și Mihai au cântat împreună."},
    {"doc_id": "p2", "text": "Ion a trecut prin Cluj și apoi prin Sibiu. Pe drum Ion a întâlnit-o pe Maria. În Sibiu, Maria l-a ajutat pe Ion."},
]
CHRONICLE = {"doc_id": "c1", "text": "În 1918 Petru Rareș a venit. La Iași a stat Elena Cuza."}


def span(surface, label):
    begin = CHRONICLE["text"].index(surface)
    return {"start_char": begin, "end_char": begin + len(surface), "label": label, "surface": surface}


@pytest.fixture(scope="module")
def sources(tmp_path_factory):
    folder = tmp_path_factory.mktemp("sources")
    spans = [span("1918", "DATE"), span("Petru Rareș", "PER"), span("Iași", "LOC"), span("Elena Cuza", "PER"), {"start_char": 90, "end_char": 95, "label": "LOC", "surface": "Sibiu"}]
    (folder / "stories.jsonl").write_text("\n".join(json.dumps(d, ensure_ascii=False) for d in STORIES) + "\n")
    (folder / "chronicle.jsonl").write_text(json.dumps(CHRONICLE | {"spans": spans}, ensure_ascii=False) + "\n")
    return [{"name": "stories", "path": str(folder / "stories.jsonl")}, {"name": "chronicle", "path": str(folder / "chronicle.jsonl")}]


def test_build_and_resume(spark, sources, tmp_path):
    out = str(tmp_path / "out")
    summary = build.build(spark, {"sources": sources, "run_name": "golden", "tolerance": 1e-2}, out)
    stats = summary["stats"]
    assert (stats["documents"], stats["chunks"], stats["mentions"], stats["entities_pre_resolution"]) == (3, 3, 17, 17)
    assert stats["entities_post_resolution"] == 12 and stats["relations_extracted"] == 10 and stats["relations_grounding"] == 0
    raw = spark.read.parquet(f"{out}/stages/relations_raw").collect()
    assert Counter((r["predicate"], r["confidence"]) for r in raw) == {("INTERACTS_WITH", 0.5): 9, ("LOCATED_IN", 0.55): 1}
    assert Counter(r["doc_id"] for r in raw) == {"p1": 2, "p2": 7, "c1": 1}
    mentions = {r["entity_id"]: r["surface"] for r in spark.read.parquet(f"{out}/stages/mentions_raw").collect()}
    (located,) = [r for r in raw if r["predicate"] == "LOCATED_IN"]
    assert (mentions[located["source_entity_id"]], mentions[located["target_entity_id"]]) == ("Elena Cuza", "Iași")
    assert located["evidence_text"] == "La Iași a stat Elena Cuza."
    kinds = Counter(r["entity_type"] for r in spark.read.parquet(f"{out}/artifacts/entities").collect())
    assert kinds == {"Character": 8, "Person": 2, "Location": 1, "Event": 1}
    # Ion and Maria meet in two sentences of one chunk: one edge after quality control
    assert stats["relations_total"] == 9 and json.loads(read_text(spark, f"{out}/reports/qc.json"))["first"]["removed_duplicates"] == 1
    assert "text" not in spark.read.parquet(f"{out}/artifacts/docs").columns
    report = json.loads(read_text(spark, f"{out}/reports/analytics.json"))
    assert report["node_count"] == 12 and report["edge_count"] == 9 and summary["analytics"]
    lines = [r["value"] for r in spark.read.text(f"{out}/cypher/load").collect()]
    assert sum("MERGE (w:Work" in line for line in lines) == 3 and sum("[r:INTERACTS_WITH {doc_id: " in line and "evidence_text = " in line for line in lines) == 8
    assert json.loads(read_text(spark, f"{out}/summary.json"))["stats"] == stats and "chunks: 3" in read_text(spark, f"{out}/reports/report.md")
    # an interrupted run goes on behind its last finished stage
    os.remove(f"{out}/stages/mapping/_SUCCESS")
    again = build.build(spark, {"sources": sources, "run_name": "golden", "tolerance": 1e-2}, out, resume=True)
    assert again["taken_from_an_earlier_run"] == ["documents", "chunks", "mentions_raw", "entities_raw", "relations_raw"] and again["stats"] == stats


def test_other_modes(spark, sources, tmp_path):
    config = {"sources": sources, "engine": "advanced", "relations": "semantic", "resolution": "hybrid", "events": True, "tolerance": 1e-2}
    stats = build.build(spark, config, str(tmp_path / "out"))["stats"]
    assert stats["documents"] == 3 and stats["entities_post_resolution"] <= stats["entities_pre_resolution"]
    with pytest.raises(ValueError):
        build.build(spark, {"sources": sources, "resolution": "guess"}, str(tmp_path / "bad"))


def test_cooccurrence_takes_characters_and_the_last_mention(spark):
    schema = "sent int, mentions array<struct<entity_id:string,entity_type:string,confidence:double>>"
    rows = [(1, [("a", "Person", 0.9), ("b", "Person", 0.9)]), (2, [("a", "Character", 0.2), ("l", "Location", 0.9), ("a", "Character", 0.5), ("e", "Event", 0.9)]), (3, [("a", "Character", 0.9), ("c", "Character", 0.9)])]
    got = sorted((r["sent"], r["source_entity_id"], r["predicate"], r["target_entity_id"], r["confidence"]) for r in relations.cooccurrence(spark.createDataFrame(rows, schema)).collect())
    assert got == [(2, "a", "LOCATED_IN", "l", 0.5), (2, "e", "LOCATED_IN", "l", 0.55), (3, "a", "INTERACTS_WITH", "c", 0.6)]


class Model:
    """A model for tests: answers with the first two entities of the table, and notes each call."""

    name = "test-model"

    def __init__(self, log):
        self.log = log

    def answer(self, prompts):
        out = []
        for p in prompts:
            with open(self.log, "a") as file:
                file.write("x\n")
            ents = json.loads(p[len("Entities: ") : p.index("\nPredicates")])
            quote = p[p.index("Text: ") + 6 :][:10]
            out.append("Here: " + json.dumps([{"source_entity_id": ents[0]["entity_id"], "predicate": "LOVES", "target_entity_id": ents[-1]["entity_id"], "evidence_text": quote}]))
        return out

    def find(self, texts):
        return [[{"word": " Ana ", "label": "PER", "score": 0.9}, {"word": "Ana", "label": "PER"}, {"word": "Cluj", "start": t.find("Cluj"), "end": t.find("Cluj") + 4, "label": "loc"}, {"word": "Nowhere", "label": "MISC"}] if "Ana" in t else [] for t in texts]

    def offsets(self, texts):
        return [[(i, i + 3) for i in range(0, len(t) - 2, 3)] for t in texts]


def test_providers(spark, tmp_path):
    model = Model(str(tmp_path / "calls"))
    docs = spark.createDataFrame([("d1", "s", "Ana vede Cluj și Ana pleacă spre Mihai"), ("d2", "s", "Ion și Maria merg"), ("d3", "h", "Ana")], "doc_id string, source string, text string")
    chunks = extraction.chunk_documents(docs)
    found = sorted((r["doc_id"], r["surface"], r["start_char"], r["entity_type"], r["confidence"]) for r in extraction.model_mentions(chunks.where("doc_id <> 'd3'"), model, "s").collect())
    assert found == [("d1", "Ana", 0, "Character", 0.9), ("d1", "Ana", 17, "Character", 0.5), ("d1", "Cluj", 9, "Location", 0.5)]
    assert {r["entity_type"] for r in extraction.model_mentions(chunks.where("doc_id = 'd3'"), model, "s").where("surface = 'Ana'").collect()} == {"Person"}
    pieces = extraction.chunk_documents(docs.where("doc_id = 'd1'"), 4, 1, model).collect()
    assert sorted((r["start_char"], r["end_char"]) for r in pieces) == [(0, 12), (9, 21), (18, 30), (27, 36)]
    mentions = extraction.regex_mentions(chunks, "s")
    cache = str(tmp_path / "cache")
    for _ in range(2):  # the second time nothing is asked
        answers = relations.model_answers(chunks, mentions, model, cache)
        kept = relations.checked_answers(answers, chunks, mentions.select("chunk_id", "entity_id", "entity_type"))
        assert {(r["doc_id"], r["predicate"]) for r in kept.collect()} == {("d1", "LOVES"), ("d2", "LOVES")}
    assert len((tmp_path / "calls").read_text().split()) == 3


class Failing:
    dim = 4

    def embed(self, names):
        raise OSError("down")


def test_a_provider_that_is_down_is_noticed(spark):
    entities = spark.createDataFrame([("1", "Ana")], "entity_id string, canonical_name string")
    with pytest.raises(resolution.EmbeddingFailed):
        resolution.embed_names(entities, Failing())


def driver_at(path):
    class Driver:
        def run(self, statement, rows=None):
            with open(path, "a") as file:
                file.write(json.dumps([statement, len(rows or [])]) + "\n")

        def close(self):
            pass

    return Driver


def test_load(spark, tmp_path):
    path = str(tmp_path / "sent")
    works = spark.createDataFrame([("w", "t", "a", "s")], "work_id string, title string, author string, source string")
    entities = spark.createDataFrame([(str(i), "Person", "n") for i in range(5)], "entity_id string, entity_type string, canonical_name string").coalesce(1)
    mentions = spark.createDataFrame([("m", "0", "s", "d")], "mention_id string, entity_id string, source string, doc_id string")
    edges = spark.createDataFrame([("0", p, "1") for p in ("INTERACTS_WITH", "LOVES", "SAME_AS")], "source_entity_id string, predicate string, target_entity_id string")
    writers.load_tables(works, entities, mentions, edges, lambda: driver_at(path)(), batch=2)
    sent = [json.loads(line) for line in open(path)]
    assert [s for s, n in sent[:4]] == list(writers.CONSTRAINTS)
    assert [n for s, n in sent if "(e:Entity {entity_id: row.entity_id}) SET" in s] == [2, 2, 1]
    assert Counter(p for s, n in sent for p in writers.LOADED_PREDICATES if f"[r:{p} " in s) == {"INTERACTS_WITH": 1, "SAME_AS": 1}
    assert not any("LOVES" in s for s, _ in sent)


def test_small_sinks_and_sources(spark, tmp_path):
    writers.write_json(spark, {"ț": [1, None]}, str(tmp_path / "a/x.json"))
    assert json.loads(read_text(spark, str(tmp_path / "a/x.json"))) == {"ț": [1, None]} and "ț" in read_text(spark, str(tmp_path / "a/x.json"))
    writers.write_jsonl(spark.createDataFrame([("ș", None)], "a string, b int"), str(tmp_path / "rows"))
    assert [json.loads(r["value"]) for r in spark.read.text(str(tmp_path / "rows")).collect()] == [{"a": "ș", "b": None}]
    script = spark.createDataFrame([(2, "b"), (1, "z"), (1, "a")], "section int, line string")
    writers.write_cypher(script, str(tmp_path / "script"))
    files = sorted(p for p in os.listdir(tmp_path / "script") if p.startswith("part-"))
    assert [x for f in files for x in (tmp_path / "script" / f).read_text().split()] == ["a", "z", "b"]
    (tmp_path / "q.jsonl").write_text('{"question": "who", "graph": [["a", "r", "b"]]}\n{"question_id": "7", "question": "what"}\n')
    got = readers.read_questions(spark, str(tmp_path / "q.jsonl"))
    assert {r["question"]: r["question_id"] for r in got.collect()}["what"] == "7" and got.where("question_id IS NULL").count() == 0
    first = spark.createDataFrame([(["x", "y"],), ([],)], "a array<string>").select(readers.first_answer(F.col("a")).alias("f"))
    assert sorted(r["f"] for r in first.collect()) == ["", "x"]
    entities = spark.createDataFrame([("1", "Person"), ("2", "Theme")], "entity_id string, entity_type string")
    edges = spark.createDataFrame([("BEFORE",), ("LOVES",), ("BEFORE",)], "predicate string")
    assert {(r["kind"], r["value"], r["n"]) for r in quality_control.unknown_values(entities, edges).collect()} == {("entity_type", "Theme", 1), ("predicate", "BEFORE", 2)}


def plain_linkage(items, threshold, share):
    """Average linkage from its definition: (id, form, unit vector) of all entities at once."""
    clusters = [[x] for x in items]
    alike = lambda a, b: share * (a[1] == b[1]) + (1 - share) * float(a[2] @ b[2])
    while True:
        best, at = -1.0, None
        for i, a in enumerate(clusters):
            for j in range(i + 1, len(clusters)):
                mean = sum(alike(x, y) for x in a for y in clusters[j]) / (len(a) * len(clusters[j]))
                if mean > best:
                    best, at = mean, (i, j)
        if at is None or best < threshold:
            return {frozenset(x[0] for x in c) for c in clusters}
        clusters[at[0]] += clusters.pop(at[1])


@pytest.mark.parametrize("threshold", [0.85, 0.5])
def test_hybrid_resolution_is_average_linkage(spark, threshold):
    import numpy as np

    names = ["Ana Pop", "ana pop", "Ana  Pop!", "Ana Popa", "Ana Popescu", "Ion", "ION", "Ioan", "Ioana", "Maria", "Mariana", "Marian", "Maria", "Ana Pop"]
    rows = [(f"e{i:02}", "Person", n, "s" if i % 7 else "t", []) for i, n in enumerate(names)]
    entities = spark.createDataFrame(rows, "entity_id string, entity_type string, canonical_name string, source string, aliases array<string>")
    vectors = resolution.HashedNames().embed(names).astype(np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    forms = [" ".join("".join(c if c.isalnum() else " " for c in n.lower()).split()) for n in names]
    want = set()
    for source in "st":
        want |= plain_linkage([(rows[i][0], forms[i], unit[i]) for i in range(len(rows)) if rows[i][3] == source], threshold, 0.4)
    merged, mapping, edges = resolution.resolve_hybrid(entities, spark.createDataFrame([("e01",)], "entity_id string"), threshold, threshold - 0.2)
    got = {}
    for r in mapping.collect():
        got.setdefault(r["new_id"], set()).add(r["old_id"])
    assert {frozenset(x) for x in got.values()} == want
    assert {r["entity_id"]: r["merged"] for r in merged.collect()} == {k: len(v) for k, v in got.items()}
    found = edges.collect()
    assert all(r["source_entity_id"] in got and threshold - 0.2 <= r["confidence"] < threshold for r in found)


def test_recall_of_the_approximate_join(spark):
    """Against all pairs that are among the 20 nearest of one of their ends."""
    from tessera.plans import graphs

    sf_dir = "/root/testdata/sf0.01"
    exact = {(r["i"], r["j"]) for r in resolution.similar_pairs(graphs._vectors(spark, sf_dir).withColumn("scope", F.lit(0)), graphs.MERGE).collect()}
    found = {(r["i"], r["j"]) for r in resolution.lsh_pairs(graphs._vectors(spark, sf_dir), graphs.MERGE, neighbours=500).collect()}
    assert found <= exact and len(found) >= 0.9 * len(exact), (len(found), len(exact))


def test_ids_are_of_file_and_line(spark, tmp_path):
    """Whatever the splits and the other files: the id of a document is that of its source, path and line."""
    import hashlib

    from tessera.functions.text import UNIT

    lines = ["" if i % 7 == 3 else '{"text": "Ana a plecat %d."}' % i for i in range(400)]
    for name in ("a", "b"):
        (tmp_path / f"{name}.jsonl").write_text("\n".join(lines))
    ident = lambda path, i: "doc_" + hashlib.sha1(UNIT.join(["s", path, str(i)]).encode()).hexdigest()[:16]
    paths = [str(tmp_path / f"{name}.jsonl") for name in ("a", "b")]
    n = sum(bool(x) for x in lines)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for split in ("128m", "1k"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", split)
            one = readers.read_documents(spark, paths[0], "s")
            assert (one.rdd.getNumPartitions() > 4) == (split == "1k")
            assert {r["doc_id"] for r in one.collect()} == {ident(paths[0], i) for i in range(n)}
            both = [r["doc_id"] for r in readers.read_documents(spark, paths, "s").collect()]
            assert sorted(both) == sorted(ident(p, i) for p in paths for i in range(n))
            assert sorted(r["doc_id"] for r in readers.read_documents(spark, str(tmp_path / "*.jsonl"), "s").collect()) == sorted(both)
            first = readers.read_documents(spark, paths[0], "s", 3).collect()
            assert {r["doc_id"] for r in first} == {ident(paths[0], i) for i in range(3)}
            questions = readers.read_questions(spark, str(tmp_path))
            assert questions.select("question_id").distinct().count() == 2 * n
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_repeated_ids_are_refused(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"doc_id": "x", "text": "Ana."}\n{"doc_id": "x", "text": "Ion."}\n')
    with pytest.raises(ValueError, match="share their ids"):
        build.build(spark, {"sources": [{"name": "s", "path": str(tmp_path / "a.jsonl")}]}, str(tmp_path / "out"))


def test_the_first_of_equal_edges_stays(spark):
    entities = spark.createDataFrame([("a", "Character", "Ana"), ("b", "Character", "Ion")], "entity_id string, entity_type string, canonical_name string")
    mentions = spark.createDataFrame([("m", "a", 0, 1)], "mention_id string, entity_id string, start_char int, end_char int")
    rows = [("a", "INTERACTS_WITH", "b", "d", "c", 0.5, "first", 4), ("b", "INTERACTS_WITH", "a", "d", "c", 0.9, "second", 9), ("a", "INTERACTS_WITH", "b", "d", "c", 0.7, "unplaced", None)]
    edges = spark.createDataFrame(rows, "source_entity_id string, predicate string, target_entity_id string, doc_id string, chunk_id string, confidence double, evidence_text string, pos bigint")
    kept = quality_control.quality_control(entities, mentions, edges.repartition(3))[2].collect()
    assert [(r["confidence"], r["evidence_text"]) for r in kept] == [(0.5, "first")]
    # without places the same one stays in every run
    left = {quality_control.quality_control(entities, mentions, edges.drop("pos").repartition(n))[2].first()["evidence_text"] for n in (1, 2, 5)}
    assert len(left) == 1
