"""Queries of fact retrieval with fixed weights: every order is a question, its nodes and relations have vectors from ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import retrieval
from tessera.plans import graphs
from tessera.plans.registry import Registry
from tessera.session import cut, table

R = Registry()
R.parts = dict(graphs.R.parts)

#: Sizes of node vectors (also the hidden size), instructions, edge attributes and relations.
NODE, TOLD, ATTR, RELATION, HEADS, LAYERS = 4, 3, 2, 2, 2, 2
#: Node features are vectors of this many ids, which every size of the test tables has.
VECTORS = 500


def _map(seed: int, out: int, width: int) -> dict:
    """A dense map by rule: entries between -0.5 and 0.5."""
    entry = lambda r, c: ((r * 7 + c * 3 + seed) % 11 - 5) / 10
    return {"weight": [[entry(r, c) for c in range(width)] for r in range(out)], "bias": [entry(r, width) for r in range(out)]}


def _norm(seed: int, width: int) -> dict:
    return {"weight": [1 + ((i + seed) % 3) / 10 for i in range(width)], "bias": [((i + seed) % 5 - 2) / 10 for i in range(width)]}


def weights() -> dict:
    layers = [
        {
            "node_transform": _map(s, NODE, NODE + TOLD), "query": _map(s + 1, NODE, NODE), "key": _map(s + 2, NODE, NODE), "value": _map(s + 4, NODE, NODE),
            "edge_transform": _map(s + 5, NODE, ATTR), "out_proj": _map(s + 6, NODE, NODE), "layer_norm": _norm(s, NODE),
        }
        for s in range(LAYERS)
    ]
    update = {"hidden": _map(3, NODE, NODE + TOLD), "score": _map(8, 1, NODE), "gru": {"input": _map(1, 3 * TOLD, NODE), "state": _map(5, 3 * TOLD, TOLD)}, "layer_norm": _norm(1, TOLD)}
    return {"node_init": _map(9, NODE, NODE), "layers": layers, "instruction_update": update, "fact_scorer": _map(2, 1, 2 * NODE + RELATION), "heads": HEADS}


# ---------------------------------------------------------------- the same in SQL


def _dense(w: dict, x: str) -> str:
    rows = [[*row, bias] for row, bias in zip(w["weight"], w["bias"], strict=True)]
    return f"list_transform({rows}::DOUBLE[][], lambda w: list_dot_product(w, list_append({x}, 1.0::DOUBLE)))"


def _normed(w: dict, x: str, width: int) -> str:
    """``x`` is a column."""
    off = f"list_transform({x}, lambda v: v - list_avg({x}))"
    return "[" + ", ".join(f"({off})[{i + 1}] / sqrt(list_avg(list_transform({off}, lambda v: v * v)) + {retrieval.EPSILON}) * {w['weight'][i]} + {w['bias'][i]}" for i in range(width)) + "]"


def _plus(a: str, b: str, width: int) -> str:
    return "[" + ", ".join(f"{a}[{i + 1}] + {b}[{i + 1}]" for i in range(width)) + "]"


def _first(vector: str, start: int, n: int) -> str:
    return f"list_transform({vector}[{start}:{start + n - 1}], lambda v: v::DOUBLE)"


w = weights()
R.cte("node_keys", "SELECT DISTINCT question_id, node, CAST(substr(node, 2) AS BIGINT) AS key FROM (SELECT question_id, s AS node FROM triples UNION ALL SELECT question_id, o FROM triples)")
R.cte("net0", f"SELECT question_id, node, {_dense(w['node_init'], _first('embedding', 1, NODE))} AS x FROM node_keys JOIN embeddings ON vec_id = key % {VECTORS}")
R.cte("told0", f"SELECT question_id, {_first('embedding', 5, TOLD)} AS ins FROM (SELECT DISTINCT question_id FROM triples) JOIN embeddings ON vec_id = question_id % {VECTORS}")
R.cte(
    "net_edges",
    f"SELECT question_id, idx, s AS source, o AS target, CASE WHEN p = 'has_part' THEN [1.0::DOUBLE, 0.0] ELSE [0.5::DOUBLE, 1.0] END AS attr, {_first('embedding', 9, RELATION)} AS relation FROM triples JOIN embeddings ON vec_id = idx % {VECTORS}",
)
for _i, _w in enumerate(w["layers"]):
    _part = NODE // HEADS
    _logit = lambda h: " + ".join(f"t.q[{i + 1}] * (s.k[{i + 1}] + e.line[{i + 1}])" for i in range(h * _part, (h + 1) * _part))
    R.cte(f"hid{_i}", f"SELECT question_id, node, {_dense(_w['node_transform'], 'list_concat(x, ins)')} AS h FROM net{_i} JOIN told{_i} USING (question_id)")
    R.cte(f"state{_i}", f"SELECT question_id, node, h, {_dense(_w['query'], 'h')} AS q, {_dense(_w['key'], 'h')} AS k, {_dense(_w['value'], 'h')} AS v FROM hid{_i}")
    R.cte(f"lines{_i}", f"SELECT question_id, source, target, {_dense(_w['edge_transform'], 'attr')} AS line FROM net_edges")
    R.cte(
        f"met{_i}",
        f"SELECT e.question_id, e.target AS node, [{', '.join(f'exp(({_logit(h)}) / sqrt({_part}))' for h in range(HEADS))}] AS a, s.v FROM lines{_i} e "
        f"JOIN state{_i} s ON s.question_id = e.question_id AND s.node = e.source JOIN state{_i} t ON t.question_id = e.question_id AND t.node = e.target",
    )
    R.cte(f"mean{_i}", f"SELECT question_id, node, [{', '.join(f'sum(a[{i // _part + 1}] * v[{i + 1}]) / sum(a[{i // _part + 1}])' for i in range(NODE))}] AS m FROM met{_i} GROUP BY ALL")
    R.cte(f"out{_i}", f"SELECT question_id, node, h, {_dense(_w['out_proj'], f'coalesce(m, {[0.0] * NODE}::DOUBLE[])')} AS o FROM state{_i} LEFT JOIN mean{_i} USING (question_id, node)")
    R.cte(f"sum{_i}", f"SELECT question_id, node, {_plus('h', 'o', NODE)} AS y FROM out{_i}")
    R.cte(f"net{_i + 1}", f"SELECT question_id, node, {_normed(_w['layer_norm'], 'y', NODE)} AS x FROM sum{_i}")
    if _i < LAYERS - 1:
        _u = w["instruction_update"]
        R.cte(f"look{_i}", f"SELECT question_id, x, ins, list_transform({_dense(_u['hidden'], 'list_concat(x, ins)')}, lambda v: (exp(v) - exp(-v)) / (exp(v) + exp(-v))) AS t FROM net{_i + 1} JOIN told{_i} USING (question_id)")
        R.cte(f"weighed{_i}", f"SELECT question_id, x, ins, exp(({_dense(_u['score'], 't')})[1]) AS a FROM look{_i}")
        R.cte(f"context{_i}", f"SELECT question_id, any_value(ins) AS ins, [{', '.join(f'sum(a * x[{i + 1}]) / sum(a)' for i in range(NODE))}] AS c FROM weighed{_i} GROUP BY question_id")
        R.cte(f"gates{_i}", f"SELECT question_id, ins, {_dense(_u['gru']['input'], 'c')} AS gi, {_dense(_u['gru']['state'], 'ins')} AS gs FROM context{_i}")
        _s = lambda x: f"(1 / (1 + exp(-({x}))))"
        _r = lambda i: _s(f"gi[{i + 1}] + gs[{i + 1}]")
        _z = lambda i: _s(f"gi[{TOLD + i + 1}] + gs[{TOLD + i + 1}]")
        _n = lambda i: f"(2 * {_s(f'2 * (gi[{2 * TOLD + i + 1}] + {_r(i)} * gs[{2 * TOLD + i + 1}])')} - 1)"
        R.cte(f"moved{_i}", f"SELECT question_id, [{', '.join(f'(1 - {_z(i)}) * {_n(i)} + {_z(i)} * ins[{i + 1}]' for i in range(TOLD))}] AS y FROM gates{_i}")
        R.cte(f"told{_i + 1}", f"SELECT question_id, {_normed(_u['layer_norm'], 'y', TOLD)} AS ins FROM moved{_i}")
R.cte(
    "net_facts",
    f"SELECT e.question_id, e.idx, 1 / (1 + exp(-({_dense(w['fact_scorer'], 'list_concat(list_concat(a.x, e.relation), b.x)')})[1])) AS prob FROM net_edges e "
    f"JOIN net{LAYERS} a ON a.question_id = e.question_id AND a.node = e.source JOIN net{LAYERS} b ON b.question_id = e.question_id AND b.node = e.target",
)


# ---------------------------------------------------------------- plans


def _vector(start: int, n: int):
    return F.transform(F.slice("embedding", start, n), lambda v: v.cast("double"))


def _graphs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges with their text, instructions) of all orders, dealt by order."""
    triples = graphs._triples(spark, sf_dir)
    # the few vectors that are asked for, written so that Spark knows how small they are
    vectors = cut(table(spark, sf_dir, "embeddings").where(F.col("vec_id").between(1 - VECTORS, VECTORS - 1)).select("vec_id", "embedding"), "fact-vectors", few=True)
    keys = triples.select("question_id", F.explode(F.array("s", "o")).alias("node")).distinct().withColumn("vec_id", F.substring("node", 2, 20).cast("bigint") % VECTORS)
    nodes = keys.join(vectors, "vec_id").select("question_id", "node", _vector(1, NODE).alias("x"))
    told = triples.select("question_id").distinct().withColumn("vec_id", F.col("question_id") % VECTORS).join(vectors, "vec_id").select("question_id", _vector(5, TOLD).alias("instruction"))
    attr = F.when(F.col("p") == "has_part", F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.5), F.lit(1.0)))
    edges = triples.withColumn("vec_id", (F.col("idx") % VECTORS).cast("bigint")).join(vectors, "vec_id")
    edges = edges.select("question_id", "idx", F.col("s").alias("source"), F.col("o").alias("target"), attr.alias("attr"), _vector(9, RELATION).alias("relation"), F.concat_ws(", ", "s", "p", "o").alias("fact"))
    return nodes, edges, told


@R.query("ml_message_passing", "SELECT question_id, idx, round(prob, 6) AS prob FROM net_facts")
def _(spark, sf_dir):
    nodes, edges, told = _graphs(spark, sf_dir)
    return retrieval.retrieve(nodes, edges.drop("fact"), told, weights())[0].select("question_id", "idx", F.round("prob", 6).alias("prob"))


@R.query(
    "ml_prompts",
    f"""SELECT question_id, '{retrieval.INSTRUCTION}Question: what is in ' || question_id || '?' || chr(10) || chr(10) || '{retrieval.FACTS_HEADER}' || string_agg(s || ', ' || p || ', ' || o || chr(10), '' ORDER BY n) || '{retrieval.ANSWER_HEADER}' AS prompt,
CAST(count(*) AS INT) AS n_facts FROM (SELECT t.*, row_number() OVER (PARTITION BY question_id ORDER BY round(prob, 9) DESC, idx) AS n FROM triples t JOIN net_facts USING (question_id, idx)) WHERE n <= 5 GROUP BY question_id""",
)
def _(spark, sf_dir):
    nodes, edges, told = _graphs(spark, sf_dir)
    questions = graphs._triples(spark, sf_dir).select("question_id").distinct().withColumn("question", F.concat(F.lit("what is in "), F.col("question_id").cast("string"), F.lit("?")))
    return retrieval.retrieved_prompts(nodes, edges, told, questions, weights(), 5)
