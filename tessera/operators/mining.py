"""Subgraph mining for question answering: adjacency, bounded paths, labels, samples.

``triples``: question_id, idx (position), s, p, o. Paths are arrays of node names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.session import cut, drop_cut

#: Paths of a question and, where it has none, edges; triples that a sample keeps.
PATHS, FALLBACK_PATHS, SAMPLE_TRIPLES = 8, 4, 50
#: Triples of a graph that is searched inside one row; larger graphs are searched by joins.
ROW_TRIPLES = 64


def flatten_graph(rows: DataFrame, graph: str = "graph", most: int = 2000, id_col: str = "question_id") -> DataFrame:
    """Triples of nested graphs: the first ``most`` of a row, those of three parts, numbered after that filter."""
    good = F.filter(F.slice(F.col(graph), 1, most), lambda t: F.size(t) == 3)
    return rows.select(F.col(id_col).alias("question_id"), F.posexplode(good).alias("idx", "t")).select("question_id", "idx", F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"))


def adjacency(triples: DataFrame) -> DataFrame:
    """(question_id, u, v, at): both directions of every triple in order; ``at`` is the place of insertion."""
    ends = F.array(F.struct(F.col("s").alias("u"), F.col("o").alias("v"), (F.col("idx") * 2).alias("at")), F.struct(F.col("o").alias("u"), F.col("s").alias("v"), (F.col("idx") * 2 + 1).alias("at")))
    return triples.select("question_id", F.inline(ends))


ENDS = ["question_id", "start", "goal"]


def _by_graph_size(triples: DataFrame, ends: DataFrame, in_row: Column, by_joins) -> DataFrame:
    """(question_id, start, goal, path) of ``ends``: ``in_row`` makes the paths of small graphs, ``by_joins(triples, ends)`` those of others.

    A small graph is one array of at most ``ROW_TRIPLES`` triples beside each pair of ends, so rows that are dealt by question stay
    where they are and no walk is exchanged or written.
    """
    large = cut(triples.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > ROW_TRIPLES).select("question_id"), "large-graphs", few=True)
    some = not large.isEmpty()
    few = triples.join(large, "question_id", "left_anti") if some else triples
    graphs = few.groupBy("question_id").agg(F.collect_list(F.struct(F.col("idx").cast("bigint").alias("idx"), "s", "o")).alias("graph"))
    found = ends.where("start <> goal").select(*ENDS).join(graphs, "question_id").select(*ENDS, F.explode(in_row).alias("path"))
    if not some:
        return found
    of_large = lambda rows: rows.join(large, "question_id", "left_semi")
    return found.unionByName(by_joins(of_large(triples), of_large(ends)))


def _walks_in_row(hops: int) -> Column:
    """All walks of ``graph`` from start to goal without repeated nodes, of 1 to ``hops`` directed edges."""
    none = F.array().cast("array<array<string>>")
    last = lambda w: F.element_at(w, -1)

    def step(acc: Column, hop: Column) -> Column:
        on = lambda w: lambda e: (e["s"] == last(w)) & ~F.array_contains(w, e["o"]) & ((hop < hops) | (e["o"] == F.col("goal")))
        grown = F.flatten(F.transform(acc["open"], lambda w: F.transform(F.filter("graph", on(w)), lambda e: F.concat(w, F.array(e["o"])))))
        return T.let(grown, lambda ws: F.struct(F.filter(ws, lambda w: last(w) != F.col("goal")).alias("open"), F.concat(acc["found"], F.filter(ws, lambda w: last(w) == F.col("goal"))).alias("found")))

    start = F.struct(F.array(F.array("start")).alias("open"), none.alias("found"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), start, step, lambda acc: acc["found"])


def _breadth_first_in_row(hops: int) -> Column:
    """The first shortest path of ``graph`` from start to goal in either direction of edges, as an array of at most one path.

    A front holds the parts of one length in order of insertion; a node is kept where it is reached first.
    """
    last = lambda part: F.element_at(part["path"], -1)
    both = F.flatten(F.transform("graph", lambda e: F.array(F.struct((e["idx"] * 2).alias("at"), e["s"].alias("u"), e["o"].alias("v")), F.struct((e["idx"] * 2 + 1).alias("at"), e["o"].alias("u"), e["s"].alias("v")))))

    def search(steps: Column) -> Column:
        def grown(acc: Column) -> Column:
            longer = lambda part: F.transform(
                F.filter(steps, lambda e: (e["u"] == last(part)) & ~F.array_contains(acc["seen"], e["v"])),
                lambda e: F.struct(F.concat(part["key"], F.array(e["at"])).alias("key"), F.concat(part["path"], F.array(e["v"])).alias("path")),
            )
            return F.array_sort(F.flatten(F.transform(acc["front"], longer)))

        def step(acc: Column, hop: Column) -> Column:
            def next_(parts: Column) -> Column:
                return T.let(
                    F.transform(parts, last),
                    lambda nodes: F.struct(
                        F.filter(parts, lambda part, i: F.array_position(nodes, last(part)) == i + 1).alias("front"),
                        F.array_union(acc["seen"], nodes).alias("seen"),
                        F.transform(F.slice(F.filter(parts, lambda part: last(part) == F.col("goal")), 1, 1), lambda part: part["path"]).alias("found"),
                    ),
                )

            return F.when(F.size(acc["found"]) > 0, acc).otherwise(T.let(grown(acc), next_))

        start = F.struct(
            F.array(F.struct(F.array().cast("array<bigint>").alias("key"), F.array("start").alias("path"))).alias("front"), F.array("start").alias("seen"), F.array().cast("array<array<string>>").alias("found")
        )
        return F.aggregate(F.sequence(F.lit(1), F.lit(hops)), start, step, lambda acc: acc["found"])

    return T.let(both, search)


def _meet_in_the_middle(ends: DataFrame, hops: int, grow, join, settle: bool) -> DataFrame:
    """Paths of 1 to ``hops`` edges of ``ends``, of parts from both ends: (question_id, start, goal, path).

    ``grow(part, forward)`` makes the parts of one side longer by an edge, ``join(heads, tails)`` puts parts that meet
    in a node together. Each round grows the side that has fewer parts, so a hub is walked through only where
    the other end is no nearer; ends of which one side has no parts left are dropped, and with ``settle`` those that
    have met too. Ends have a number here; parts are (pair, question_id, node, far, path, key), ``far`` the other end,
    a state of the shared folder each.
    """
    pairs = cut(ends.where("start <> goal").select(*ENDS, F.monotonically_increasing_id().alias("pair")), "path-ends", few=True)
    part = lambda node, far: pairs.select("pair", "question_id", F.col(node).alias("node"), F.col(far).alias("far"), F.array(node).alias("path"), F.array().cast("array<bigint>").alias("key"))
    sides, sizes, states, found = {True: part("start", "goal"), False: part("goal", "start")}, {True: 0, False: 0}, [], None
    open_ = pairs.count()
    for hop in range(1, hops + 1):
        forward = sizes[True] <= sizes[False]
        # after the first growth of either side a pair that it has lost is lost for good
        grows = sides[forward] if hop == 1 else sides[forward].join(sides[not forward].select("pair").distinct(), "pair", "left_semi")
        grown = cut(grow(grows, forward), "path-parts", few=True)
        states.append(grown)
        sides[forward], sizes[forward] = grown, grown.count()
        hit = cut(join(sides[True], sides[False]).select("pair", "path"), "paths", few=True)
        found = hit if found is None else found.unionByName(hit)
        if settle:
            open_ -= hit.count()
            sides = {side: rows.join(hit.select("pair"), "pair", "left_anti") for side, rows in sides.items()}
        if not sizes[forward] or not open_:
            break
    drop_cut(*states)
    return found.join(pairs, "pair").select(*ENDS, "path")


def shortest_paths(triples: DataFrame, ends: DataFrame, hops: int = 4) -> DataFrame:
    """(question_id, start, goal, path): the first shortest path that breadth-first search finds in insertion order.

    ``ends``: question_id, start, goal. The search goes from both ends: each round is one join and keeps one part for
    every node reached, the one whose edges were inserted first along the way; where parts meet, the first of
    the joined paths is the one that breadth-first search keeps. A start that is its goal has no path of two nodes and is left out.
    Graphs of few triples are searched in a row each, with the same result.
    """
    joined = lambda t, e: _shortest_by_joins(t, e, hops)
    return _by_graph_size(triples, ends.select(*ENDS).distinct(), _breadth_first_in_row(hops), joined)


def _shortest_by_joins(triples: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    steps = cut(adjacency(triples).select("question_id", "u", "v", F.col("at").cast("bigint").alias("at")), "steps")

    def grow(part: DataFrame, forward: bool) -> DataFrame:
        here, there = ("u", "v") if forward else ("v", "u")
        met = part.join(steps.withColumnRenamed(here, "node"), ["question_id", "node"]).where(~F.array_contains("path", F.col(there)))
        path = F.concat("path", F.array(there)) if forward else F.concat(F.array(there), F.col("path"))
        key = F.concat("key", F.array("at")) if forward else F.concat(F.array("at"), F.col("key"))
        longer = met.select("pair", "question_id", F.col(there).alias("node"), "far", F.struct(key.alias("key"), path.alias("path")).alias("best"))
        # parallel edges and ways to one node: the first in order of insertion
        best = longer.groupBy("pair", "node").agg(F.min("best").alias("best"), F.first("question_id").alias("question_id"), F.first("far").alias("far"))
        return best.select("pair", "question_id", "node", "far", "best.path", "best.key")

    def join(heads: DataFrame, tails: DataFrame) -> DataFrame:
        rest = tails.select("pair", "node", F.slice("path", 2, 1000).alias("rest"), F.col("key").alias("more"))
        both = heads.join(rest, ["pair", "node"]).select("pair", F.struct(F.concat("key", "more").alias("key"), F.concat("path", "rest").alias("path")).alias("best"))
        return both.groupBy("pair").agg(F.min("best").alias("best")).select("pair", "best.path")

    found = _meet_in_the_middle(ends, hops, grow, join, settle=True)
    drop_cut(steps)
    return found


def capped_paths(paths: DataFrame, ends: DataFrame, most: int = PATHS) -> DataFrame:
    """(question_id, path): the first ``most`` paths of a question in the order of its ends (question_id, start, goal, rank)."""
    order = Window.partitionBy("question_id").orderBy("rank", "start", "goal")
    ranked = paths.join(ends, ["question_id", "start", "goal"]).withColumn("__n", F.row_number().over(order))
    return ranked.where(F.col("__n") <= most).select("question_id", "path")


def simple_paths(triples: DataFrame, ends: DataFrame, hops: int = 3) -> DataFrame:
    """(question_id, start, goal, path) of all directed paths without repeated nodes; parallel edges repeat a path.

    Walks start from both ends and are joined where they meet, each path at one place of it alone. Graphs of few triples
    are walked in a row each.
    """
    return _by_graph_size(triples, ends, _walks_in_row(hops), lambda t, e: _walks_by_joins(t, e, hops))


def _walks_by_joins(triples: DataFrame, ends: DataFrame, hops: int) -> DataFrame:
    steps = triples.select("question_id", F.col("s").alias("u"), F.col("o").alias("v"))

    def grow(part: DataFrame, forward: bool) -> DataFrame:
        here, there = ("u", "v") if forward else ("v", "u")
        # a walk that has come to the other end is a whole path and was found before
        on = part.where(F.col("node") != F.col("far"))
        met = on.join(steps.withColumnRenamed(here, "node"), ["question_id", "node"]).where(~F.array_contains("path", F.col(there)))
        path = F.concat("path", F.array(there)) if forward else F.concat(F.array(there), F.col("path"))
        return met.select("pair", "question_id", F.col(there).alias("node"), "far", path.alias("path"), "key")

    def join(heads: DataFrame, tails: DataFrame) -> DataFrame:
        rest = tails.select("pair", "node", F.slice("path", 2, 1000).alias("rest"))
        both = heads.join(rest, ["pair", "node"]).select("pair", F.concat("path", "rest").alias("path"))
        return both.where(F.size(F.array_distinct("path")) == F.size("path"))

    return _meet_in_the_middle(ends, hops, grow, join, settle=False)


def question_ends(questions: DataFrame, most: int = 3) -> DataFrame:
    """(question_id, start, goal, rank): the first question entities with the first answer entities, else answers."""
    answers = F.when(F.size("a_entity") > 0, F.col("a_entity")).otherwise(F.col("answer"))
    starts = questions.select("question_id", F.posexplode(F.slice("q_entity", 1, most)).alias("i", "start"), F.slice(answers, 1, most).alias("goals"))
    return starts.select("question_id", "start", "i", F.posexplode("goals").alias("j", "goal")).select("question_id", "start", "goal", (F.col("i") * most + F.col("j")).alias("rank"))


def fallback_paths(triples: DataFrame, seeds: DataFrame, most: int = FALLBACK_PATHS) -> DataFrame:
    """(question_id, path): first edges at the seeds (question_id, node, rank), at most ``most``; else the first triple."""
    order = Window.partitionBy("question_id").orderBy("rank", "at")
    near = seeds.join(adjacency(triples).withColumnRenamed("u", "node"), ["question_id", "node"])
    edges = near.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).groupBy("question_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", F.array("node", "v").alias("path")))), lambda x: x["path"]).alias("paths"))
    first = triples.groupBy("question_id").agg(F.min_by(F.array("s", "o"), "idx").alias("first"))
    return first.join(edges, "question_id", "left").select("question_id", F.explode(F.coalesce("paths", F.array("first"))).alias("path"))


def answer_value(answers: Column) -> Column:
    """Answers without blanks, as a sample keeps them: one answer as it is, several as a JSON list."""
    kept = F.filter(answers, lambda a: F.trim(F.coalesce(a, F.lit(""))) != "")
    return F.when(F.size(kept) == 1, F.get(kept, F.lit(0))).otherwise(F.coalesce(F.to_json(kept), F.lit("")))


def joined_answers(answers: Column) -> Column:
    """Answers that are not blank, with bars between them: what a generator is taught to write."""
    return F.array_join(F.filter(answers, lambda a: F.trim(F.coalesce(a, F.lit(""))) != ""), " | ")


def direct_paths(questions: DataFrame, most: int = 2) -> DataFrame:
    """(question_id, path): [question entity, answer entity] of the first ``most`` of each."""
    return question_ends(questions, most).select("question_id", F.array("start", "goal").alias("path"))


def subgraph_samples(questions: DataFrame, most: int = 2, shown: int = SAMPLE_TRIPLES) -> DataFrame:
    """(question_id, paths, answer, graph_size, triples) of questions with a graph, by direct paths.

    Without a pair of entities the path goes from the first head to the last tail. ``triples`` are the first ``shown``.
    """
    triples = flatten_graph(questions.where(F.size("graph") > 0))
    ordered = F.array_sort(F.collect_list(F.struct("idx", "s", "p", "o")))
    graphs = triples.groupBy("question_id").agg(ordered.alias("t"))
    direct = direct_paths(questions, most).groupBy("question_id").agg(F.array_sort(F.collect_set("path")).alias("direct"))
    rows = questions.where(F.size("graph") > 0).select("question_id", "answer").join(graphs, "question_id", "left").join(direct, "question_id", "left")
    n = F.coalesce(F.size("t"), F.lit(0))
    ends = F.when(n > 0, F.array(F.array(F.col("t")[0]["s"], F.element_at("t", -1)["o"]))).otherwise(F.array().cast("array<array<string>>"))
    size = F.when(F.col("t").isNull(), 0).otherwise(n)
    kept = F.transform(F.slice(F.coalesce("t", F.array().cast("array<struct<idx:int,s:string,p:string,o:string>>")), 1, shown), lambda x: F.array(x["s"], x["p"], x["o"]))
    return rows.select("question_id", F.coalesce("direct", ends).alias("paths"), F.coalesce(F.get("answer", F.lit(0)), F.lit("")).alias("answer"), size.alias("graph_size"), kept.alias("triples"))


def url_samples(rows: DataFrame, most: int = 3) -> DataFrame:
    """(question, paths, answer, topic_entity) of rows (question, url, answers): from the URL's topic to the first answers."""
    topic = T.url_slug(F.col("url"))
    good = rows.where((F.coalesce("question", F.lit("")) != "") & (F.size("answers") > 0)).withColumn("topic_entity", topic).where("topic_entity <> ''")
    paths = F.transform(F.slice("answers", 1, most), lambda a: F.array(F.col("topic_entity"), T.entity_slug(a)))
    return good.select("question", paths.alias("paths"), F.get("answers", F.lit(0)).alias("answer"), "topic_entity")


def parse_paths(parses: DataFrame) -> DataFrame:
    """(question_id, path): topic, relation chain, answer. ``parses``: question_id, topic, chain, answers (structs of argument, text)."""
    entity = lambda a: F.when(F.coalesce(a["argument"], F.lit("")) != "", a["argument"]).when(F.coalesce(a["text"], F.lit("")) != "", F.replace(F.lower(a["text"]), F.lit(" "), F.lit("_")))
    ends = F.filter(F.transform(F.slice("answers", 1, 3), entity), lambda a: a.isNotNull())
    return parses.where((F.coalesce("topic", F.lit("")) != "") & (F.size("answers") > 0)).select("question_id", F.explode(ends).alias("a"), "topic", "chain").select("question_id", F.concat(F.array("topic"), F.coalesce("chain", F.array().cast("array<string>")), F.array("a")).alias("path"))


#: The templates of synthetic questions are the three below.
def template_question(triples: DataFrame) -> DataFrame:
    """(s, p, o, question) from one of three templates, chosen by hash of the triple."""
    clean = lambda c: F.replace(F.replace(c, F.lit("/m/"), F.lit("")), F.lit("_"), F.lit(" "))
    s, p = clean(F.col("s")), F.replace(F.substring_index("p", "/", -1), F.lit("_"), F.lit(" "))
    pick = F.conv(F.substring(F.md5(F.concat_ws("\t", "s", "p", "o").cast("binary")), 1, 8), 16, 10).cast("bigint") % 3
    question = F.when(pick == 0, F.concat(F.lit("What is the "), p, F.lit(" of "), s, F.lit("?"))).when(pick == 1, F.concat(F.lit("Find the "), p, F.lit(" for "), s)).otherwise(F.concat(F.lit("Which "), p, F.lit(" does "), s, F.lit(" have?")))
    return triples.select("s", "p", "o", question.alias("question"))


def path_edges(paths: DataFrame) -> DataFrame:
    """(question_id, a, b): neighbouring nodes of paths, the smaller first, each once."""
    steps = F.greatest(F.size("path") - 1, F.lit(1))
    pairs = F.zip_with(F.slice("path", 1, steps), F.slice("path", 2, steps), lambda a, b: F.struct(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")))
    return paths.where(F.size("path") > 1).select("question_id", F.inline(pairs)).distinct()


def label_edges(triples: DataFrame, paths: DataFrame) -> DataFrame:
    """``triples`` with label 1 where a path steps along the edge in either direction, else 0.

    Marks and triples are rows of one frame and meet in a window, which takes rows that are dealt by question where they are.
    """
    kept = F.struct(*(c for c in triples.columns if c != "question_id"))
    keyed = triples.select("question_id", F.least("s", "o").alias("a"), F.greatest("s", "o").alias("b"), kept.alias("t"), F.lit(0).alias("hit"))
    marks = path_edges(paths).select("question_id", "a", "b", F.lit(None).cast(keyed.schema["t"].dataType).alias("t"), F.lit(1).alias("hit"))
    label = F.max("hit").over(Window.partitionBy("question_id", "a", "b"))
    return keyed.unionByName(marks).withColumn("label", label).where("t IS NOT NULL").select(*(c if c == "question_id" else f"t.{c}" for c in triples.columns), "label")


def label_facts(triples: DataFrame, relevant: DataFrame) -> DataFrame:
    """``triples`` with label 1 for those in ``relevant`` (question_id, s, p, o)."""
    return triples.join(relevant.select("question_id", "s", "p", "o").distinct().withColumn("hit", F.lit(1)), ["question_id", "s", "p", "o"], "left").select(*triples.columns, F.coalesce("hit", F.lit(0)).alias("label"))


def valid_samples(triples: DataFrame, paths: DataFrame, least: int = 3) -> DataFrame:
    """question_id of samples with at least ``least`` triples and one path."""
    enough = triples.groupBy("question_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("question_id")
    return enough.join(paths.select("question_id").distinct(), "question_id", "left_semi")


def trainable(labelled: DataFrame) -> DataFrame:
    """question_id of samples with a positive label."""
    return labelled.groupBy("question_id").agg(F.sum("label").alias("n")).where("n > 0").select("question_id")


def encode(values: DataFrame, column: str, position: str) -> DataFrame:
    """(column, id): dense numbers in order of first appearance.

    Ranks are taken in ranges of first position with running counts of ranges, so no task sorts all values.
    """
    firsts = values.groupBy(column).agg(F.min(position).alias("first"))
    bounds = firsts.agg(F.min("first").alias("lo"), F.max("first").alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if not bounds["n"]:
        return firsts.select(column, F.lit(0).cast("bigint").alias("id"))
    parts = max(1, min(10_000, bounds["n"] // 10_000))
    width = (bounds["hi"] - bounds["lo"]) // parts + 1
    ranged = firsts.withColumn("part", F.floor((F.col("first") - bounds["lo"]) / width))
    before = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("c")).withColumn("before", F.sum("c").over(Window.orderBy("part")) - F.col("c"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy("first", column))
    return ranged.withColumn("rank", rank).join(before, "part").select(column, (F.col("before") + F.col("rank") - 1).alias("id"))


def coverage(questions: DataFrame, known: DataFrame) -> DataFrame:
    """total, found and coverage (percent) of question entities among known ones. Both: a column ``entity``."""
    hits = questions.join(known.select("entity").distinct().withColumn("hit", F.lit(1)), "entity", "left")
    found = F.coalesce(F.sum("hit"), F.lit(0))
    return hits.agg(F.count(F.lit(1)).alias("total"), found.alias("found"), F.when(F.count(F.lit(1)) > 0, found * 100.0 / F.count(F.lit(1))).otherwise(0.0).alias("coverage"))


def _gumbel(seed: int) -> Column:
    """Seeded Gumbel noise of a fact, by hash: the same whatever the order of rows."""
    u = (F.pmod(F.xxhash64("question_id", "fact_idx", F.lit(seed)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    return -F.log(-F.log(u))


def gumbel_select(scores: DataFrame, temperature: float = 1.0, seed: int | None = None, threshold: float = 0.5) -> DataFrame:
    """``scores`` (question_id, fact_idx, logit) with ``selected``: the sigmoid of the logit, with seeded hash noise if asked, above ``threshold``."""
    logit = F.col("logit")
    if seed is not None:
        logit = (logit + _gumbel(seed)) / temperature
    return scores.withColumn("selected", 1 / (1 + F.exp(-logit)) > threshold)


def gumbel_softmax(scores: DataFrame, temperature: float = 0.5, seed: int | None = None) -> DataFrame:
    """``scores`` (question_id, fact_idx, logit) with ``weight``: the categorical form, a softmax over a question's facts."""
    noisy = (F.col("logit") + (_gumbel(seed) if seed is not None else F.lit(0.0))) / temperature
    rows = scores.withColumn("__z", noisy)
    most = rows.groupBy("question_id").agg(F.max("__z").alias("__most"))
    shifted = rows.join(most, "question_id").withColumn("__e", F.exp(F.col("__z") - F.col("__most")))
    total = shifted.groupBy("question_id").agg(F.sum("__e").alias("__total"))
    return shifted.join(total, "question_id").select(*scores.columns, (F.col("__e") / F.col("__total")).alias("weight"))


def training_selection(facts: DataFrame, cap: int = 100, temperature: float = 1.0, seed: int | None = None) -> DataFrame:
    """The facts (question_id, fact_idx, prob) that a training step sees.

    The logit of the probability, with seeded noise if asked, above 0, among the ``cap`` most probable; where none is
    left, the most probable fact.
    """
    odds = F.log(F.col("prob") + 1e-8) - F.log(1 - F.col("prob") + 1e-8)
    drawn = gumbel_select(facts.withColumn("logit", odds), temperature, seed)
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("prob"), "fact_idx"))
    near = drawn.withColumn("__rank", rank).where(F.col("__rank") <= cap)
    # the last resort is known from the first ``cap`` rows of a question alone
    some = F.max("selected").over(Window.partitionBy("question_id"))
    return near.withColumn("__some", some).where("selected OR (NOT __some AND __rank = 1)").select(*facts.columns)


def fact_probability(head: Column, relation: Column, tail: Column, weights: list[float], bias: float = 0.0) -> Column:
    """The fact scorer with given weights: the logistic of a dot product with head, relation and tail, one after another."""
    w = F.array(*(F.lit(float(x)) for x in weights))
    dot = F.aggregate(F.zip_with(F.concat(head, relation, tail), w, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    return 1 / (1 + F.exp(-(dot + bias)))
