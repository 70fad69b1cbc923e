"""Message passing with fixed weights against loops over nodes and edges; prompts."""

import math

import numpy as np

from tessera.operators import retrieval
from tessera.plans import retrieval as plans


def plain(nodes, edges, told, w):
    dense = lambda m, x: np.array(m["weight"]) @ x + np.array(m["bias"])
    sigmoid = lambda v: 1 / (1 + np.exp(-v))

    def norm(m, x):
        return (x - x.mean()) / math.sqrt(x.var() + retrieval.EPSILON) * np.array(m["weight"]) + np.array(m["bias"])

    x = {n: dense(w["node_init"], np.array(v)) for n, v in nodes.items()}
    told = np.array(told)
    dim, heads = len(w["layers"][0]["query"]["bias"]), w["heads"]
    part = dim // heads
    for i, layer in enumerate(w["layers"]):
        h = {n: dense(layer["node_transform"], np.concatenate([v, told])) for n, v in x.items()}
        new = {}
        for n in x:
            into = [e for e in edges if e[2] == n and e[1] in x]
            out = np.zeros(dim)
            for g in range(heads):
                s = slice(g * part, (g + 1) * part)
                q = dense(layer["query"], h[n])[s]
                logits = np.array([q @ (dense(layer["key"], h[e[1]]) + dense(layer["edge_transform"], np.array(e[3])))[s] / math.sqrt(part) for e in into])
                if len(into):
                    a = np.exp(logits - logits.max())
                    out[s] = sum(a[k] / a.sum() * dense(layer["value"], h[e[1]])[s] for k, e in enumerate(into))
            new[n] = norm(layer["layer_norm"], h[n] + dense(layer["out_proj"], out))
        x = new
        if i < len(w["layers"]) - 1 and x:
            u = w["instruction_update"]
            a = np.exp([dense(u["score"], np.tanh(dense(u["hidden"], np.concatenate([v, told]))))[0] for v in x.values()])
            context = sum(k * v for k, v in zip(a / a.sum(), x.values(), strict=True))
            gi, gs = np.split(dense(u["gru"]["input"], context), 3), np.split(dense(u["gru"]["state"], told), 3)
            r, z = sigmoid(gi[0] + gs[0]), sigmoid(gi[1] + gs[1])
            told = norm(u["layer_norm"], (1 - z) * np.tanh(gi[2] + r * gs[2]) + z * told)
    return {e[0]: float(sigmoid(dense(w["fact_scorer"], np.concatenate([x[e[1]], e[4], x[e[2]]])))[0]) for e in edges if e[1] in x and e[2] in x}


def test_layers_and_facts(spark):
    rng = np.random.default_rng(2)
    vector = lambda n: [float(v) for v in rng.normal(size=n) * 3]
    graphs = {}
    for question, size in (("hub", 60), ("line", 3), ("alone", 1)):
        nodes = {f"n{i}": vector(plans.NODE) for i in range(size)}
        ends = [(f"n{i}", "n0") for i in range(1, size)] + [("n0", "n1"), ("n0", "n0"), ("gone", "n0"), ("n0", "gone")]
        graphs[question] = nodes, [(k, s, t, vector(plans.ATTR), vector(plans.RELATION)) for k, (s, t) in enumerate(ends)], vector(plans.TOLD)
    rows = [(q, n, x) for q, (nodes, _, _) in graphs.items() for n, x in nodes.items()]
    lines = [(q, *e) for q, (_, edges, _) in graphs.items() for e in edges]
    told = [(q, t) for q, (_, _, t) in graphs.items()] + [("empty", [0.0] * plans.TOLD)]
    facts, after = retrieval.retrieve(
        spark.createDataFrame(rows, "question_id string, node string, x array<double>").repartition(5),
        spark.createDataFrame(lines, "question_id string, idx int, source string, target string, attr array<double>, relation array<double>"),
        spark.createDataFrame(told, "question_id string, instruction array<double>"), plans.weights(),
    )
    got = {(r["question_id"], r["idx"]): r["prob"] for r in facts.collect()}
    want = {(q, idx): p for q, (nodes, edges, t) in graphs.items() for idx, p in plain(nodes, edges, t, plans.weights()).items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert after.count() == len(rows)


def test_relation_vectors(spark):
    maps = [plans._map(1, 3, 2), plans._map(2, 2, 3)]
    rows = spark.createDataFrame([([0.5, -1.0],), ([2.0, 3.0],)], "v array<double>")
    got = [r[0] for r in rows.select(retrieval.encode_relations(maps, rows["v"])).collect()]
    want = [retrieval.dense(maps[1], np.maximum(retrieval.dense(maps[0], np.array([v])), 0))[0] for v in ([0.5, -1.0], [2.0, 3.0])]
    assert np.allclose(got, want)


def test_prompts(spark):
    questions = spark.createDataFrame([(1, "who?"), (2, None)], "question_id int, question string")
    facts = spark.createDataFrame([(1, 0, 0.2, "a, r, b"), (1, 1, 0.9, "  c, r, d\n"), (1, 2, 0.9, None)], "question_id int, idx int, prob double, fact string")
    got = {r["question_id"]: (r["prompt"], r["n_facts"]) for r in retrieval.prompts(questions, facts, 2).collect()}
    assert got[1] == ("Answer the question based on the provided facts.\n\nQuestion: who?\n\nProvided facts:\n\nc, r, d\n\n\nAnswer:", 2)
    assert got[2] == ("Answer the question based on the provided facts.\n\nQuestion: \n\nProvided facts:\n\n\nAnswer:", 0)
