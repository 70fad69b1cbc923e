"""Faults that the fourth round found."""

from __future__ import annotations

from fractions import Fraction

import numpy as np
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessera.llm import ngram_jaccard
from tessera.operators import blocks, neighbours, retrieval
from tessera.operators.components import connected_components
from tessera.plans import graphs
from tessera.plans import retrieval as plans
from tessera.session import cut


def cosines(vectors: np.ndarray) -> np.ndarray:
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    return unit @ unit.T


def test_lsh_query_drops_no_pair(spark, monkeypatch):
    """vectors with more than 20 partners keep all of them, those without a common bucket too, in blocks of any size."""
    sf_dir = "/root/testdata/sf0.01"
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").orderBy("vec_id").collect()
    sim = cosines(np.array([r["embedding"] for r in rows], np.float64))
    ids = [r["vec_id"] for r in rows]
    want = {(ids[i], ids[j]) for i, j in zip(*np.nonzero(np.triu(sim, 1) >= graphs.MERGE), strict=True)}
    for size in (blocks.BLOCK, 90):
        monkeypatch.setattr(blocks, "BLOCK", size)
        found = [(r["i"], r["j"]) for r in queries()["er4_lsh_pairs"](spark, sf_dir).collect()]
        assert len(found) == len(set(found)) and set(found) == want


def test_blocks_meet_without_copies(spark, monkeypatch):
    """no block is exchanged, whatever their number, and a task gives fewer links than vectors that tie together what all links do."""
    monkeypatch.setattr(blocks, "BLOCK", 40)
    rng = np.random.default_rng(8)
    vectors = np.repeat(rng.normal(size=(40, 12)), 10, axis=0) + 0.1 * rng.normal(size=(400, 12))
    vectors[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "id bigint, v array<double>")
    plan = blocks._met_in_files(blocks.packed(rows))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    vectors[7, 0] = np.nan  # no cosine of the zero vector reaches anything
    near = np.nan_to_num(cosines(vectors), nan=-1) >= 0.7
    name = np.arange(400)
    while True:
        new = np.minimum(name, np.where(near, name[None, :], 400).min(axis=1))
        if (new == name).all():
            break
        name = new
    found = blocks.ties(rows, 0.7)
    got = {r["node"]: r["component"] for r in connected_components(found, "i", "j").collect()}
    assert [got.get(i, i) for i in range(400)] == name.tolist() and 7 not in got
    assert found.count() < np.triu(near, 1).sum()


def test_ann_clusters_write_no_vector_twice(spark, monkeypatch):
    """the query writes each vector once; it wrote one for each probe, and one for each probe of each probe in cells within cells."""
    written = []
    for module in (blocks, neighbours):
        monkeypatch.setattr(module, "cut", lambda df, name="cut", **more: written.append((df.schema, made := cut(df, name, **more))) or made)
        monkeypatch.setattr(module, "drop_cut", lambda *frames: None)
    sf_dir = "/root/testdata/sf0.1"
    assert queries()["er4_ann_clusters"](spark, sf_dir).count() == 2000
    vectors = 0
    for schema, made in written:
        if "ids" in schema.names:
            vectors += made.select(F.sum(F.size("ids"))).first()[0]
        elif "v" in schema.names:
            vectors += made.count()
    assert vectors == 2000


def question_graphs(spark):
    """Four questions: a hub, a line with ends that are missing or null, one without edges, one without an instruction."""
    rng = np.random.default_rng(9)
    vector = lambda n: [float(v) for v in rng.normal(size=n) * 3]
    nodes, edges, told = [], [], []
    for question, size in (("hub", 60), ("line", 4), ("bare", 2), ("mute", 3)):
        nodes += [(question, f"n{i}", vector(plans.NODE)) for i in range(size)]
        ends = [] if question == "bare" else [(f"n{i}", "n0") for i in range(1, size)] + [("n0", "n1"), ("n0", "n0"), ("gone", "n0"), ("n0", None)]
        edges += [(question, k, s, t, vector(plans.ATTR), vector(plans.RELATION), f"{s} to {t}") for k, (s, t) in enumerate(ends)]
        told += [] if question == "mute" else [(question, vector(plans.TOLD))]
    nodes.append(("line", None, vector(plans.NODE)))
    return (
        spark.createDataFrame(nodes, "question_id string, node string, x array<double>").repartition(5),
        spark.createDataFrame(edges, "question_id string, idx int, source string, target string, attr array<double>, relation array<double>, fact string"),
        spark.createDataFrame(told, "question_id string, instruction array<double>"),
    )


def test_questions_in_rows_and_by_joins_are_one(spark, monkeypatch):
    """a question gives the same in its row and by joins, prompts too."""
    nodes, edges, told = question_graphs(spark)
    questions = spark.createDataFrame([(q, f"{q}?") for q in ("hub", "line", "bare", "mute", "other")], "question_id string, question string")
    found = []
    for most in (1024, 20, 0):  # all in rows, the hub by joins, all by joins
        monkeypatch.setattr(retrieval, "ROW_PARTS", most)
        facts, after = retrieval.retrieve(nodes, edges.drop("fact"), told, plans.weights())
        texts = retrieval.retrieved_prompts(nodes, edges, told, questions, plans.weights(), 3)
        found.append((
            {(r["question_id"], r["idx"]): round(r["prob"], 9) for r in facts.collect()}, sorted((r["question_id"], *(round(v, 9) for v in r["x"])) for r in after.where("node IS NOT NULL").collect()),
            sorted((r["question_id"], r["prompt"], r["n_facts"]) for r in texts.collect()),
        ))
    assert found[0] == found[1] == found[2]
    assert len(found[0][0]) == 61 + 5 and len(found[0][1]) == 66 and {t[0]: t[2] for t in found[0][2]} == {"hub": 3, "line": 3, "bare": 0, "mute": 0, "other": 0}


def test_messages_and_prompts_stay_with_their_question(spark, monkeypatch):
    """lines are dealt by order and nothing else is exchanged; no state of nodes and no fact is written."""
    names = []
    monkeypatch.setattr(retrieval, "cut", lambda df, name="cut", **more: names.append(name) or cut(df, name, **more))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "262144")
    for query in ("ml_message_passing", "ml_prompts"):
        plan = queries()[query](spark, "/root/testdata/sf0.1")._jdf.queryExecution().executedPlan().toString()
        dealt = [line for line in plan.split("\n") if "Exchange" in line and "Broadcast" not in line]
        assert dealt and all("REPARTITION_BY_NUM" in line and "l_orderkey" in line for line in dealt), dealt
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert names == ["large-questions"] * 2


def test_bundles_are_exchanged_in_passes(spark, monkeypatch):
    """each pass exchanges its share of the bundles; all of them together find what one pass finds."""
    rng = np.random.default_rng(10)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 3000, 120)) for _ in range(60)]
    texts += [t.rsplit(" ", 2)[0] + " new end" for t in texts[:20]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    sketched = cut(ngram_jaccard.sketch(docs, 5, Fraction(4, 5), "doc_id", "text"))
    rows = lambda tables: [{tuple(r) for r in t.select("bundle", F.hex("digest"), F.hex("first")).collect()} for t in tables]
    (whole,) = rows(ngram_jaccard._shared_bundles(sketched))
    groups = lambda: {tuple(r) for r in ngram_jaccard.components(docs).collect()}
    found = groups()
    monkeypatch.setattr(ngram_jaccard, "PASS_BUNDLES", 100)
    passes = rows(ngram_jaccard._shared_bundles(sketched))
    assert len(passes) == ngram_jaccard.PASSES and set().union(*passes) == whole and sum(map(len, passes)) == len(whole)
    assert max(map(len, passes)) < len(whole) / 2
    assert groups() == found and len({r[2] for r in found}) == 60
