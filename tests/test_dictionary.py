"""Graphs of several files in numbers that stay."""

import json
import random
import threading

from pyspark.sql import functions as F

from tessera.sources.dictionary import Dictionary, encode_graph, read_graphs


def plain(files):
    entities, relations, edges = {}, {}, []
    for lines in files:
        for graph in lines:
            for t in graph:
                if len(t) == 3:
                    s = entities.setdefault(t[0], len(entities))
                    p = relations.setdefault(t[1], len(relations))
                    edges.append((s, p, entities.setdefault(t[2], len(entities))))
    return entities, relations, edges


def test_a_then_b_is_both_at_once(spark, tmp_path):
    rng = random.Random(2)
    word = lambda: f"v{rng.randrange(80)}"
    files = [[[[word(), f"r{rng.randrange(5)}", word()] if rng.random() < 0.9 else [word()] for _ in range(rng.randrange(6))] for _ in range(40)] for _ in range(3)]
    paths = []
    for i, lines in enumerate(files):
        paths.append(str(tmp_path / f"{i}.jsonl"))
        (tmp_path / f"{i}.jsonl").write_text("\n\n".join(json.dumps({"graph": g, "question": "q"}) for g in lines))
    gone = str(tmp_path / "gone.jsonl")
    triples, missing = read_graphs(spark, [paths[0], gone, *paths[1:]])
    assert missing == [gone]
    edges, entities, relations = encode_graph(triples, str(tmp_path / "once"))
    want = plain(files)
    ids = lambda d: {r["value"]: r["id"] for r in d.known().collect()}
    assert (ids(entities), ids(relations)) == want[:2]
    assert [tuple(r)[:3] for r in edges.orderBy("place").collect()] == want[2]
    for some in (paths[:1], paths[1:]):
        _, later, later_relations = encode_graph(read_graphs(spark, some)[0], str(tmp_path / "twice"))
    assert (ids(later), ids(later_relations)) == want[:2]
    nothing, missing = read_graphs(spark, [gone])
    assert nothing.count() == 0 and missing == [gone]


def test_two_writers_give_no_number_twice(spark, tmp_path):
    def work(start):
        Dictionary(spark, str(tmp_path / "d")).extend(spark.range(start, start + 50).select(F.col("id").cast("string").alias("v"), F.col("id").alias("at")), "v", "at")

    threads = [threading.Thread(target=work, args=(s,)) for s in (0, 30, 100)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    rows = Dictionary(spark, str(tmp_path / "d")).known().collect()
    assert sorted(r["id"] for r in rows) == list(range(130)) and len({r["value"] for r in rows}) == 130
