"""Faults that the third round found."""

from __future__ import annotations

import time
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessera import session
from tessera.operators import blocks, extraction, linkage, relations, resolution
from tessera.plans import graphs, knowledge
from tessera.session import cut

from .test_build import plain_linkage


def shuffle_files(spark) -> set[str]:
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {f for f in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in f}


def test_cut_leaves_no_shuffle_files(spark):
    before = shuffle_files(spark)
    rows = cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count(F.lit(1)).alias("n")))
    end = time.time() + 10
    while (left := shuffle_files(spark) - before) and time.time() < end:
        time.sleep(0.2)
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) is None
    assert rows.count() == 7


def test_lsh_pairs_are_not_written_out(spark):
    """All vectors share buckets: 3,000 vectors alike are 54 million joined rows a table set, but 20 neighbours each."""
    rng = np.random.default_rng(4)
    vectors = rng.normal(size=8) + 0.3 * rng.normal(size=(3000, 8))
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, embedding array<double>")
    found = resolution.lsh_pairs(rows, 0.9)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sim = unit @ unit.T
    np.fill_diagonal(sim, -1)
    order = np.lexsort((np.broadcast_to(np.arange(3000), sim.shape), -sim), axis=1)[:, :20]
    want = {(min(i, j), max(i, j)) for i in range(3000) for j in map(int, order[i]) if sim[i, j] >= 0.9}
    got = {(r["i"], r["j"]) for r in found.collect()}
    assert got <= want and len(got) >= 0.99 * len(want), (len(got), len(want))


def test_blocks_do_not_change_the_nearest(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = spark.createDataFrame([(i, v.tolist(), [0]) for i, v in enumerate(rng.normal(size=(300, 6)))], "id bigint, v array<double>, tags array<bigint>").persist()
    best = lambda: sorted((r["i"], r["j"]) for r in blocks.nearest(rows, 0.5, 300).collect())
    whole = best()
    monkeypatch.setattr(blocks, "BLOCK", 70)
    assert best() == whole and len(whole) > 1000
    rows.unpersist()


def test_ann_clusters_lose_no_link(spark):
    """The search misses some of these links; the check ties their clusters together."""
    rng = np.random.default_rng(6)
    vectors = rng.normal(size=(400, 12))
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    rows = spark.createDataFrame([(i, v.tolist(), [i]) for i, v in enumerate(vectors)], "id bigint, v array<double>, tags array<bigint>")
    links = {(min(r["i"], r["j"]), max(r["i"], r["j"])) for r in blocks.missing_links(rows, 0.6).collect()}
    assert links == {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(unit @ unit.T, 1) >= 0.6), strict=True)}
    one = rows.withColumn("tags", F.array(F.lit(1).cast("bigint")))
    assert blocks.missing_links(one, 0.6).count() == 0


def test_registered_clusters_equal_all_pairs(spark):
    """er4_ann_clusters and er6_merge on 2,000 vectors, whose ids are no longer of one length."""
    sf_dir = "/root/testdata/sf0.1"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "label", "embedding").orderBy("vec_id").collect()
    vectors = np.array([r["embedding"] for r in rows], np.float64)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    sim, label = unit @ unit.T, np.array([r["label"] for r in rows])

    def parts(near):
        name = np.arange(len(near))
        while True:
            new = np.minimum(name, np.where(near, name[None, :], len(name)).min(axis=1))
            if (new == name).all():
                return [rows[x]["vec_id"] for x in name]
            name = new

    want = dict(zip((r["vec_id"] for r in rows), parts(sim >= graphs.ANN_MERGE), strict=True))
    assert {r["entity_id"]: r["cluster"] for r in queries()["er4_ann_clusters"](spark, sf_dir).collect()} == want
    merged = Counter(parts((sim >= graphs.MERGE) & (label[:, None] == label[None, :])))
    assert {r["cluster"]: r["merged"] for r in queries()["er6_merge"](spark, sf_dir).collect()} == merged


def test_questions_are_dealt_once(spark, monkeypatch):
    """Joins by question and node take rows where their question is; with a hot question all keys deal them."""
    rows = spark.createDataFrame([(q, f"n{i}") for q in range(20) for i in range(5)], "question_id bigint, node string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for hot, exchanges in ((1_000_000, 2), (3, 2)):
            monkeypatch.setattr(session, "HOT", hot)
            with session.together(rows, "question_id") as deal:
                both = deal(rows).join(deal(rows.withColumn("k", F.length("node"))), ["question_id", "node"]).groupBy("question_id", "node").agg(F.sum("k").alias("k"))
                plan = both._jdf.queryExecution().executedPlan().toString()
                assert both.count() == 100
            assert plan.count("Exchange hashpartitioning(question_id") == exchanges
            assert ("REPARTITION_BY_COL" in plan) == (hot > 100)
        assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_average_linkage_writes_no_pairs(spark, monkeypatch):
    """clusters look for their best partner block by block; the result is that of the definition, copies and groups included."""
    rng = np.random.default_rng(7)
    vectors = np.repeat(rng.normal(size=(10, 6)), 8, axis=0) + 0.4 * rng.normal(size=(80, 6))
    vectors[40:48] = vectors[41]
    vectors[79] = 0
    forms = [f"f{rng.integers(0, 9)}" for _ in range(80)]
    unit = np.divide(vectors, n := np.linalg.norm(vectors, axis=1, keepdims=True), out=np.zeros_like(vectors), where=n > 0)
    rows = [(i, forms[i], [float(x) for x in vectors[i]], 1, i % 2) for i in range(80)] + [(99, "f1", [float("nan")] * 6, 1, 0)]
    items = spark.createDataFrame(rows, "id bigint, norm string, embedding array<double>, weight bigint, part int")
    monkeypatch.setattr(linkage, "LEAST_BLOCK", 9)
    for many_forms, group in ((False, None), (True, "part")):
        monkeypatch.setattr(linkage, "FORMS", 0 if many_forms else 128)
        want = set()
        for g in (0, 1) if group else (None,):
            want |= {x for x in plain_linkage([(i, forms[i], unit[i]) for i in range(80) if g is None or i % 2 == g], 0.6, 0.2) if len(x) > 1}
        got = {}
        for r in linkage.link_all(items, 0.6, 0.2, group).collect():
            got.setdefault(r["cluster"], set()).add(r["id"])
        assert {frozenset(x) for x in got.values()} == want and all(c == min(x) for c, x in got.items())

    def refuse(*_, **__):
        raise AssertionError("pairs are written out")

    monkeypatch.setattr(resolution, "similar_pairs", refuse)
    assert queries()["er5_average_linkage"](spark, "/root/testdata/sf0.001").count() > 0


def test_neighbouring_mentions_are_not_joined(spark):
    """both ends of a relation stand in one row and their ids are projections."""
    found = queries()["jn09_remapped_relations"](spark, "/root/testdata/sf0.001")
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count() > 0


def test_spans_of_a_row_are_those_of_its_labels(spark):
    """labels of any kind, in one array or as rows, give the same spans; the query exchanges no token."""
    rng = np.random.default_rng(8)
    kinds = ["O", "", None, "B-PER", "I-PER", "I-LOC", "b-loc", "PER", "LOC", " i-per "]
    rows = [(d, p, 10 * p, 10 * p + int(rng.integers(0, 4)), kinds[rng.integers(0, len(kinds))]) for d in range(40) for p in range(int(rng.integers(1, 25)))]
    tokens = spark.createDataFrame(rows, "doc_id bigint, pos int, start int, end int, label string")
    arrays = tokens.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "label"))).alias("t"))
    got = arrays.select("doc_id", F.inline(extraction.bio_spans_of(F.col("t"))))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, extraction.bio_spans(tokens).select("doc_id", "start_char", "end_char", "label").collect()))
    plan = queries()["txt10_bio_spans"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_names_of_both_lists_are_found_once(spark):
    """one scan and one expression make both lists, and a vote is no join."""
    chunks = spark.createDataFrame([("c", 1, "narrative", 5, "Then Ana Maria met The King. Ion slept")], "chunk_id string, doc_id bigint, source string, start_char int, text string")
    two = extraction.regex_mentions(chunks, "narrative").unionByName(extraction.regex_mentions(chunks, "narrative", advanced=True))
    one = extraction.advanced_mentions(chunks, "narrative")
    assert one.count() > 0 and sorted(map(tuple, one.select(*two.columns).collect())) == sorted(map(tuple, two.collect()))
    plan = queries()["txt16_overlap_vote"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and plan.count("parquet") == 1


def test_pairs_just_at_the_threshold_are_found(spark, monkeypatch):
    """cosines of small integers that are 0.8 to the digit count, in any number of cells; a cell asks each other once."""
    rng = np.random.default_rng(11)
    rows = [(f"n{i}", s, rng.integers(-1, 2, 12).astype(float).tolist()) for i in range(130) for s in ("a", "b") if s == "a" or i % 9 == 0] + [("alone", "c", [1.0] * 12)]
    v = spark.createDataFrame(rows, "id string, scope string, embedding array<float>")
    want = set()
    for i, s, x in rows:
        for j, t, y in rows:
            dot = sum(p * q for p, q in zip(x, y, strict=True))
            if i < j and s == t and dot > 0 and 25 * dot * dot >= 16 * sum(p * p for p in x) * sum(p * p for p in y):
                want.add((i, j))
    for most in (8192, 40, 30):
        monkeypatch.setattr(resolution, "BLOCK", most)
        got = [(r["i"], r["j"]) for r in resolution.similar_pairs(v, 0.8).collect()]
        assert len(got) == len(set(got)) and set(got) == want, most


def test_resolving_reads_no_mention_again(spark):
    """entities are written once with their counts; no step after that reads documents or mentions."""
    found = queries()["er3_er9_resolve_embedding"](spark, "/root/testdata/sf0.001")
    assert not [f for f in found.inputFiles() if "sentence-mentions" in f or "documents" in f]
    total = knowledge.mentions(spark, "/root/testdata/sf0.001").count()
    assert found.agg(F.sum("mention_count")).first()[0] == total > 0


def test_names_of_a_chunk_are_found_once(spark):
    """no filter makes the names or the chunks once more, and no array holds all pairs."""
    plan = queries()["rel03_semantic_patterns"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("sha1") == 2 and plan.count("\\S+, 0)") == 1 and "flatten(transform(slice" not in plan


def test_pairs_of_an_array_are_in_order(spark):
    rows = spark.createDataFrame([(1, list("abcde")), (2, ["x"]), (3, []), (4, None), (5, ["y", "y"])], "k int, items array<string>")
    got = sorted((r["k"], r["n"], r["a"], r["b"]) for r in relations.all_pairs(rows, "items").collect())
    want = [(1, n, a, b) for n, (a, b) in enumerate(combinations("abcde", 2))]
    assert got == [*want, (5, 0, "y", "y")]
