"""Graph analytics: degree, PageRank, communities, patterns, lineages. Edges: source_entity_id, predicate, target_entity_id."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.components import connected_components
from tessera.session import EXCHANGED, cut, drop_cut, setting

#: Rounds of an iterative operator between two writes of its state.
CUT_EVERY = 5


def undirected(edges: DataFrame) -> DataFrame:
    """(u, v) of every edge in both directions; repeats stay."""
    return edges.select(F.inline(F.array(F.struct(F.col("source_entity_id").alias("u"), F.col("target_entity_id").alias("v")), F.struct(F.col("target_entity_id").alias("u"), F.col("source_entity_id").alias("v")))))


def degree_centrality(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(entity_id, degree) of every node; repeated edges count, a loop counts twice."""
    found = undirected(edges).groupBy(F.col("u").alias("entity_id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("entity_id").distinct().join(found, "entity_id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))


def summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_count, edge_count, avg_degree, density; 0 where undefined."""
    n = nodes.select("entity_id").distinct().agg(F.count(F.lit(1)).alias("node_count"))
    m = edges.agg(F.count(F.lit(1)).alias("edge_count"))
    nodes_, edges_ = F.col("node_count"), F.col("edge_count")
    return n.crossJoin(m).select("node_count", "edge_count", F.when(nodes_ > 0, 2 * edges_ / nodes_).otherwise(0.0).alias("avg_degree"), F.when(nodes_ > 1, edges_ / (nodes_ * (nodes_ - 1))).otherwise(0.0).alias("density"))  # one row each


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 100, damping: float = 0.85, tolerance: float | None = 1e-6) -> DataFrame:
    """(entity_id, pagerank) on the undirected multigraph, without redistribution of dangling mass.

    Out-degrees count neighbours that are no nodes, which get nothing. On convergence the iterate before the last
    is the result; with ``tolerance`` None exactly ``iterations`` steps are made. Links are dealt by sender once; a step is
    one join and one aggregation. A link of weight 0 from each node to itself brings its ranks so far along, so that
    ``CUT_EVERY`` steps are one job, and the change in each of them is a sum over what that job has written.
    """
    ids = cut(nodes.select("entity_id").distinct(), "pagerank-nodes", few=True)
    n = ids.count()
    if not n:
        return ids.withColumn("pagerank", F.lit(0.0))
    both = cut(undirected(edges).groupBy("u", "v").agg(F.count(F.lit(1)).alias("k")), "pagerank-edges", few=True)
    out = both.groupBy("u").agg(F.sum("k").alias("out"))
    sent = both.join(out, "u").join(ids.withColumnRenamed("entity_id", "v"), "v", "left_semi").select("u", "v", (F.col("k") / F.col("out")).alias("w"), F.lit(False).alias("own"))
    links = cut(sent.unionByName(ids.select(F.col("entity_id").alias("u"), F.col("entity_id").alias("v"), F.lit(0.0).alias("w"), F.lit(True).alias("own"))), "pagerank-links", few=True)
    drop_cut(both)
    now, held = ids.withColumn("pagerank", F.lit(1.0 / n)), None
    for begin in range(0, iterations, CUT_EVERY):
        steps = min(CUT_EVERY, iterations - begin)
        state = now.select("entity_id", F.array("pagerank").alias("h"))
        for _ in range(steps):
            got = links.join(state, F.col("u") == F.col("entity_id")).select(F.col("v").alias("to"), (F.element_at("h", -1) * F.col("w")).alias("got"), F.when(F.col("own"), F.col("h")).alias("h"))
            rank = F.lit((1 - damping) / n) + damping * F.col("got")
            state = got.groupBy("to").agg(F.sum("got").alias("got"), F.max("h").alias("h")).select(F.col("to").alias("entity_id"), F.concat("h", F.array(rank)).alias("h"))
        state = cut(state, "pagerank", few=True)
        if held is not None:
            drop_cut(held)
        held = state
        if tolerance is not None:
            moved = state.agg(*(F.sum(F.abs(F.get("h", F.lit(k)) - F.get("h", F.lit(k - 1)))).alias(f"m{k}") for k in range(1, steps + 1))).first()
            settled = next((k for k in range(1, steps + 1) if moved[k - 1] is not None and moved[k - 1] < tolerance), None)
            if settled is not None:
                return state.select("entity_id", F.get("h", F.lit(settled - 1)).alias("pagerank"))
        now = state.select("entity_id", F.get("h", F.lit(steps)).alias("pagerank"))
    return now


#: Names that a row shows of a group that may be of any size.
SHOWN = 10


def _first(rows: DataFrame, key: str, value: str, shown: int) -> DataFrame:
    """(key, first): the ``shown`` smallest values of each key, sorted; a group is cut before it is gathered."""
    order = Window.partitionBy(key).orderBy(value)
    near = rows.select(key, value).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= shown)
    return near.groupBy(key).agg(F.array_sort(F.collect_list(value)).alias("first"))


def community_members(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community) of every node in a component of more than one node."""
    ids = cut(nodes.select("entity_id").distinct(), "community-nodes")
    inner = edges.join(ids.withColumnRenamed("entity_id", "source_entity_id"), "source_entity_id", "left_semi").join(ids.withColumnRenamed("entity_id", "target_entity_id"), "target_entity_id", "left_semi")
    found = connected_components(inner.where("source_entity_id <> target_entity_id"), "source_entity_id", "target_entity_id")
    return found.select("node", F.col("component").alias("community"))


def communities(nodes: DataFrame, edges: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(community, size, members): components of more than one node with their first ``shown`` members.

    All members are the rows of :func:`community_members`; a giant component is never one row.
    """
    found = cut(community_members(nodes, edges), "communities", few=True)
    sizes = found.groupBy("community").agg(F.count(F.lit(1)).alias("size"))
    return sizes.join(_first(found, "community", "node", shown), "community").select("community", "size", F.col("first").alias("members"))


def top_communities(found: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest communities; equals by id."""
    return found.orderBy(F.desc("size"), "community").limit(n)


def love_triangles(edges: DataFrame, shown: int = 3) -> DataFrame:
    """(target, suitors, first_suitors) of nodes that are loved at least twice; repeats count, but show once."""
    loved = edges.where("predicate = 'LOVES'").select(F.col("target_entity_id").alias("target"), F.col("source_entity_id").alias("suitor"))
    counts = loved.groupBy("target").agg(F.count(F.lit(1)).alias("suitors")).where("suitors >= 2")
    return counts.join(_first(loved.distinct(), "target", "suitor", shown), "target").select("target", "suitors", F.col("first").alias("first_suitors"))


def deaths(edges: DataFrame, shown: int = SHOWN) -> DataFrame:
    """(target, killers, first_killers) of nodes that are killed: distinct killers, and the first of them."""
    killed = edges.where("predicate = 'KILLS'").select(F.col("target_entity_id").alias("target"), F.col("source_entity_id").alias("killer")).distinct()
    counts = killed.groupBy("target").agg(F.count(F.lit(1)).alias("killers"))
    return counts.join(_first(killed, "target", "killer", shown), "target").select("target", "killers", F.col("first").alias("first_killers"))


def _pointers(parent: DataFrame) -> list[DataFrame]:
    """(child, up) tables: ``up`` is the ancestor 1, 2, 4, … generations above; rows end where a chain does.

    The last table is empty, or, where there are cycles, reaches beyond all nodes that are left: its ``up`` are the nodes
    on cycles.
    """
    tables = [cut(parent.select("child", F.col("parent").alias("up")), "pointers", few=True)]
    alive = n = tables[0].count()
    # a node with an ancestor more generations above than there are children runs into a cycle
    while alive and 1 << (len(tables) - 1) <= n:
        below = tables[-1]
        above = below.select(F.col("child").alias("up"), F.col("up").alias("far"))
        tables.append(cut(below.join(above, "up").select("child", F.col("far").alias("up")), "pointers", few=True))
        alive = tables[-1].count()
    return tables


def _ends(parent: DataFrame) -> DataFrame:
    """(child, end, dist) of an acyclic parent table: the last ancestor and its distance, doubled until nothing moves."""
    now = cut(parent.select("child", F.col("parent").alias("end"), F.lit(1).cast("bigint").alias("dist")), "chain-ends", few=True)
    while not now.join(now.select(F.col("child").alias("end")), "end", "left_semi").isEmpty():
        further = now.select(F.col("child").alias("end"), F.col("end").alias("far"), F.col("dist").alias("more"))
        was, now = now, cut(now.join(further, "end", "left").select("child", F.coalesce("far", "end").alias("end"), (F.col("dist") + F.coalesce("more", F.lit(0))).alias("dist")), "chain-ends", few=True)
        drop_cut(was)
    return now


def _cycle_sizes(on_cycle: DataFrame, parent: DataFrame) -> DataFrame:
    """(node, len) of the nodes on cycles: a cycle is named by its smallest node, found over doubled steps."""
    now = cut(on_cycle.join(parent.withColumnRenamed("child", "node"), "node").select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("name")), "cycles", few=True)
    n, reach = now.count(), 1
    while reach < n:
        ahead = now.select(F.col("node").alias("up"), F.col("up").alias("far"), F.col("name").alias("other"))
        was, now = now, cut(now.join(ahead, "up").select("node", F.col("far").alias("up"), F.least("name", "other").alias("name")), "cycles", few=True)
        drop_cut(was)
        reach *= 2
    return now.join(now.groupBy("name").agg(F.count(F.lit(1)).alias("len")), "name").select("node", "len")


def lineages(edges: DataFrame) -> DataFrame:
    """(leaf, depth, chain from the root) for every child that is no parent; a cycle ends where it would repeat.

    Of several parents the largest counts. Ancestors are found by doubling: tables of the ancestor 1, 2, 4, …
    generations above, as many as the logarithm of the longest chain; from the farthest table down each leaf's
    ancestors double, each found once, and chains are gathered at the end, at the size they have in the result. All joins
    exchange rows: tables of pointers are small as files, and Spark would send each of them through the driver.
    """
    with setting(edges.sparkSession, **EXCHANGED):
        return _lineages(edges)


def _lineages(edges: DataFrame) -> DataFrame:
    parent = cut(edges.where("predicate = 'DESCENDS_FROM' AND source_entity_id <> target_entity_id").groupBy(F.col("source_entity_id").alias("child")).agg(F.max("target_entity_id").alias("parent")), "parents", few=True)
    if parent.isEmpty():
        return parent.select(F.col("child").alias("leaf"), F.lit(0).alias("depth"), F.array("child").alias("chain"))
    tables = _pointers(parent)
    on_cycle = cut(tables[-1].select(F.col("up").alias("node")).distinct(), "on-cycle", few=True)
    open_ = parent.join(on_cycle.select(F.col("node").alias("child")), "child", "left_anti")
    ends = _ends(open_)
    leaves = parent.join(parent.select(F.col("parent").alias("child")).distinct(), "child", "left_anti").select("child")
    need = leaves.join(ends, "child").join(_cycle_sizes(on_cycle, parent).withColumnRenamed("node", "end"), "end", "left")
    # a chain that runs into a cycle goes once around it
    walk = need.select(F.col("child").alias("leaf"), F.col("child").alias("node"), F.lit(0).cast("bigint").alias("up_by"), (F.col("dist") + F.coalesce(F.col("len") - 1, F.lit(0))).alias("need"))
    for k in range(len(tables) - 1, -1, -1):
        jump = F.lit(1 << k).cast("bigint")
        far = walk.where(F.col("up_by") + jump <= F.col("need")).join(tables[k].withColumnRenamed("child", "node"), "node").select("leaf", F.col("up").alias("node"), (F.col("up_by") + jump).alias("up_by"), "need")
        walk = cut(walk.unionByName(far), "ancestors", few=True)
    drop_cut(*tables, ends, on_cycle)
    chain = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("up_by")).alias("o"), "node"))), lambda x: x["node"])
    return walk.groupBy("leaf").agg(chain.alias("chain")).select("leaf", F.size("chain").alias("depth"), "chain")


def top_lineages(chains: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` deepest lineages; equals by leaf."""
    return chains.orderBy(F.desc("depth"), "leaf").limit(n)


def patterns(edges: DataFrame, n: int = 50) -> DataFrame:
    """(kind, target, size) of love triangles, deaths and the ten deepest lineages, in that order, the first ``n``."""
    loved = love_triangles(edges).select(F.lit(1).alias("place"), F.lit("love_triangle").alias("kind"), "target", F.col("suitors").alias("size"))
    killed = deaths(edges).select(F.lit(2), F.lit("death"), "target", "killers")
    family = top_lineages(lineages(edges)).select(F.lit(3), F.lit("family_lineage"), "leaf", F.col("depth").cast("bigint"))
    return loved.union(killed).union(family).orderBy("place", F.desc("size"), "target").limit(n).select("kind", "target", "size")


def top(rows: DataFrame, score: str, n: int, id_col: str = "entity_id") -> DataFrame:
    """The ``n`` rows of highest score; equals by id."""
    return rows.orderBy(F.desc(score), id_col).limit(n)


def select_facts(scores: DataFrame, cap: int | None = None, threshold: float | None = None, fallback: bool = True) -> DataFrame:
    """Facts of each question: the ``cap`` most probable that reach ``threshold``; with ``fallback`` at least the first."""
    order = Window.partitionBy("question_id").orderBy(F.desc("prob"), "fact_idx")
    keep = (F.col("rank") <= cap) if cap is not None else F.lit(True)
    if threshold is not None:
        keep = keep & ((F.col("prob") >= threshold) | ((F.col("rank") == 1) if fallback else F.lit(False)))
    return scores.withColumn("rank", F.row_number().over(order)).where(keep)
