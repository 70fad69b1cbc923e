"""Work that must not grow faster than the input: what is exchanged, how much a task holds, what the driver gets."""

from __future__ import annotations

import random
import re

from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessera import session
from tessera.functions import text
from tessera.operators import graph, mining

SMALL = "/root/testdata/sf0.01"


def exchanges(df) -> list[str]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange (hashpartitioning\(.*)", plan.split("== Initial Plan ==")[-1])


def test_paths_exchange_lines_alone(spark):
    """Orders are small graphs: their paths, labels and counts need no exchange but that which deals lines by order."""
    for name in ("hm02_paths_of_all_lengths", "hm02_shortest_paths", "hm10_circular_paths", "hm10_simple_paths", "hm11_path_edges", "hm12_valid_samples", "hm13_jn18_edge_labels", "hm14_trainable"):
        found = exchanges(queries()[name](spark, SMALL))
        assert found and all(x.startswith("hashpartitioning(l_orderkey") for x in found), (name, found)


def test_small_and_large_graphs_have_the_same_paths(spark, monkeypatch):
    rng = random.Random(12)
    rows, ends = [], []
    for q in range(40):
        nodes = [f"n{i}" for i in range(rng.randint(3, 8))]
        rows += [(q, i, rng.choice(nodes), "r", rng.choice(nodes)) for i in range(rng.randint(3, 20))]
        ends += [(q, *rng.choices([*nodes, "gone"], k=2)) for _ in range(3)]
    triples = spark.createDataFrame([*rows, (3, 900, None, "r", "n1"), (3, 901, "n1", "r", None)], "question_id int, idx int, s string, p string, o string").persist()
    asked = spark.createDataFrame([*ends, ends[0], (3, None, "n1")], "question_id int, start string, goal string").persist()
    every = []
    # all graphs by joins, some, none
    for most in (0, 10, 64):
        monkeypatch.setattr(mining, "ROW_TRIPLES", most)
        every.append([sorted((r["question_id"], r["start"], r["goal"], *r["path"]) for r in f(triples, asked).collect()) for f in (mining.simple_paths, mining.shortest_paths)])
    assert every[0] == every[1] == every[2] and min(map(len, every[0])) > 20
    triples.unpersist()
    asked.unpersist()


def test_tasks_of_dealt_rows_grow_in_number(spark, monkeypatch):
    lines = session.table(spark, "/root/testdata/sf0.1", "lineitem").select("l_orderkey", "l_suppkey")
    parts = session.dealt(lines, "l_orderkey").rdd.getNumPartitions()
    monkeypatch.setattr(session, "DEAL_BYTES", session.DEAL_BYTES // 32)
    more = session.dealt(lines, "l_orderkey")
    assert more.rdd.getNumPartitions() > 2 * parts
    assert more.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] < 600_000 / parts


def test_adjacency_tasks_grow_in_number(spark, monkeypatch):
    tasks = lambda: [int(n) for n in re.findall(r"(\d+)\), REPARTITION_BY_NUM", " ".join(exchanges(queries()["hm01_adjacency"](spark, "/root/testdata/sf0.1"))))]
    before = tasks()
    monkeypatch.setattr(session, "DEAL_BYTES", session.DEAL_BYTES // 32)
    assert len(before) == 1 and tasks()[0] > 2 * before[0]


def test_lineages_send_nothing_through_the_driver(spark, monkeypatch):
    """Every table of a doubling is written from a plan without a broadcast."""
    plans, write = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df, *a, **b: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, *a, **b))[1])
    edges = spark.range(1, 3000).select(F.col("id").alias("source_entity_id"), F.expr("id div 2").alias("target_entity_id"), F.lit("DESCENDS_FROM").alias("predicate"))
    found = graph.lineages(edges)
    assert sum("Join" in p for p in plans) > 10 and not any("Broadcast" in p for p in plans)
    assert found.count() == 1500 and found.agg(F.max("depth")).first()[0] == 13
    assert spark.conf.get("spark.sql.autoBroadcastJoinThreshold") != "-1"


def test_detokenized_text_needs_no_places(spark):
    tokens = [["", "", "a", ",", "", "b", "(", "c", ")", None, ".", "", "", "d"], ["(", "", "x"], [], [""], ["a", "\n", "b"], ["„", "", "", "w", "”", "!"]]
    rows = spark.createDataFrame([(t,) for t in tokens], "t array<string>")
    found = rows.select(text.detokenized(F.col("t")).alias("x"), text.detokenize(F.col("t")).alias("y")).collect()
    assert all(r["x"] == r["y"]["text"] for r in found) and found[0]["x"] == "a, b (c). d"
    # running sums are folds: the query asks for none
    plan = queries()["txt09_detokenize"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "aggregate(" not in plan and "detoken" not in plan and "array_join" in plan


def test_merged_mentions_tasks_grow_in_number(spark, monkeypatch):
    """Names and chunks are dealt by document, by the size of the scan; merging moves no row again."""
    monkeypatch.setattr(session, "DEAL_BYTES", 64 << 10)
    found = [x for x in exchanges(queries()["txt14_merge_mentions"](spark, SMALL)) if "RoundRobin" not in x]
    assert found and all(x.startswith("hashpartitioning(doc_id") and "REPARTITION_BY_NUM" in x for x in found), found
    assert all(int(re.search(r", (\d+)\)", x)[1]) > 8 for x in found)
