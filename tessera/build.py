"""The whole build: documents to graph, reports and load script, stage by stage, with resume.

    build(spark, {"sources": [{"name": "stories", "path": ".../*.jsonl"}, {"name": "chronicles", "path": "..."}]}, out)

Every stage is a table below ``out/stages``; a run with ``resume`` takes those that an earlier run of the same
configuration has finished and goes on behind them. The tables before resolution are the checkpoint set.
"""

from __future__ import annotations

import hashlib
import json
import logging
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import extraction, graph, quality_control, relations, resolution
from tessera.session import path_exists, read_text, write_text
from tessera.sources import readers, writers

LOG = logging.getLogger(__name__)
#: Settings and their defaults; ``sources`` are dicts of name, path and optionally limit.
DEFAULTS = {
    "run_name": "run",
    "fictional_source": None,
    "gold_source": None,
    "chunk_tokens": 250,
    "chunk_overlap": 40,
    "engine": "regex",
    "relations": "heuristic",  # heuristic, semantic, model; model falls back to heuristic where ``fallback``
    "fallback": True,
    "cache": None,  # folder of what models have said; by default one of the run's own, which a rerun goes on with
    "resolution": "lexical",  # lexical, by_name, embedding (all pairs), ann (cells and probes), hybrid, none
    "scope": "per_source",
    "min_norm_length": 2,
    "merge": 0.85,
    "candidate": 0.70,
    "emit_candidates": True,
    "events": False,
    "audit": 200,
    "seed": 42,
    "tolerance": 1e-6,
}
#: Predicates whose edges count as degree in the report.
HUB_PREDICATES = ("INTERACTS_WITH", "LOCATED_IN", "PARTICIPATES_IN", "SAME_AS", "BASED_ON")
RELATION = ("source_entity_id", "predicate", "target_entity_id", "doc_id", "chunk_id", "source", "confidence", "evidence_text", "rel_type", "pos")
RELATION_KINDS = {"confidence": "double", "pos": "bigint"}


class Run:
    """Stages of one build below a folder."""

    def __init__(self, spark: SparkSession, out: str, config: dict, resume: bool):
        self.spark, self.out = spark, out.rstrip("/")
        mark, path = hashlib.sha1(json.dumps(config, sort_keys=True, default=str).encode()).hexdigest(), f"{self.out}/stages/config"
        self.resume = resume and path_exists(spark, path) and read_text(spark, path) == mark
        if not self.resume:
            write_text(spark, path, mark)
        self.taken: list[str] = []

    def stage(self, name: str, make: Callable[[], DataFrame]) -> DataFrame:
        """The table of a stage: written now, or taken from the run before."""
        path = f"{self.out}/stages/{name}"
        if self.resume and path_exists(self.spark, f"{path}/_SUCCESS"):
            self.taken.append(name)
        else:
            self.resume = False  # what lies behind a stage that is made anew is made anew
            make().write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)


def _counts(rows: DataFrame, *columns: str) -> dict[str, int]:
    return {"::".join(str(x) for x in r[:-1]): r[-1] for r in rows.groupBy(*columns).agg(F.count(F.lit(1))).collect()}


def _relations(found: DataFrame) -> DataFrame:
    """``found`` with the columns of a relation; those it lacks are null."""
    return found.select(*(F.col(c) if c in found.columns else F.lit(None).cast(RELATION_KINDS.get(c, "string")).alias(c) for c in RELATION))


def _extract_relations(config: dict, chunks: DataFrame, mentions: DataFrame, provider) -> DataFrame:
    heuristic = relations.mention_relations(chunks, mentions)
    if config["relations"] == "heuristic":
        return heuristic
    if config["relations"] == "semantic":
        item = F.struct("start_char", "end_char", "mention_id", "entity_id", "entity_type")
        gathered = chunks.join(mentions.groupBy("chunk_id").agg(F.array_sort(F.collect_list(item)).alias("mentions")), "chunk_id")
        return _relations(relations.semantic_relations(gathered)).unionByName(_relations(relations.temporal_relations(gathered)))
    if config["relations"] != "model":
        raise ValueError(f"unknown relations {config['relations']!r}")
    answers = relations.model_answers(chunks, mentions, provider, f"{config['cache']}/answers")
    found = _relations(relations.checked_answers(answers, chunks, mentions.select("chunk_id", "entity_id", "entity_type").distinct()))
    return relations.with_fallback(found, heuristic) if config["fallback"] else found


def _resolve(config: dict, mentions: DataFrame, entities: DataFrame, provider) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(entities, old id -> new id, candidate edges or None)."""
    mode = config["resolution"]
    if mode == "none":
        return entities, mentions.select(F.col("entity_id").alias("old_id"), F.col("entity_id").alias("new_id")).distinct(), None
    if mode == "lexical":
        found, mapping = resolution.resolve_lexical(mentions, config["scope"], config["min_norm_length"])
        own = mentions.select(F.col("entity_id").alias("old_id"), F.col("source")).join(mapping, "old_id").groupBy(F.col("new_id").alias("entity_id")).agg(F.min("source").alias("source"))
        return found.join(own, "entity_id"), mapping, None
    if mode == "by_name":
        return *resolution.resolve_by_name(entities, mentions, config["scope"]), None
    if mode in ("embedding", "ann"):
        method = "ann" if mode == "ann" else "exact"
        return resolution.resolve_embedding(entities, mentions, config["merge"], config["candidate"], provider, method, config["scope"])
    if mode == "hybrid":
        return resolution.resolve_hybrid(entities, mentions, config["merge"], config["candidate"], provider)
    raise ValueError(f"unknown resolution {mode!r}")


ENTITY_COLUMNS = {"entity_id": "string", "entity_type": "string", "canonical_name": "string", "aliases": "array<string>", "is_fictional": "boolean", "source": "string", "norm": "string", "mention_count": "bigint", "year": "int"}


def _entities(found: DataFrame) -> DataFrame:
    have = set(found.columns)
    fill = {"norm": T.normalize_mention(F.col("canonical_name")), "is_fictional": F.when(F.col("entity_type") == "Character", True).when(F.col("entity_type") == "Person", False)}
    return found.select(*((F.col(c) if c in have else fill.get(c, F.lit(None))).cast(kind).alias(c) for c, kind in ENTITY_COLUMNS.items()))


def build(spark: SparkSession, config: dict, out: str, resume: bool = False, extractor=None, relator=None, embedder=None, tokenizer=None) -> dict:
    """Run all stages and give the summary, which is also written. ``extractor``, ``relator``, ``embedder`` and ``tokenizer`` are providers."""
    config, began = DEFAULTS | config, time.time()
    names = [s["name"] for s in config["sources"]]
    fiction, gold = config["fictional_source"] or names[0], config["gold_source"] or names[-1]
    run = Run(spark, out, config, resume)
    # what models have said is kept with the run unless a folder is given that runs share
    config["cache"] = config["cache"] or f"{run.out}/cache"
    docs = run.stage("documents", lambda: extraction.normalize_documents(reduce(DataFrame.unionByName, (readers.read_documents(spark, s["path"], s["name"], s.get("limit")) for s in config["sources"]))))
    repeated = [r["doc_id"] for r in docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(5).collect()]
    if repeated:
        raise ValueError(f"documents share their ids, such as {repeated}")
    chunks = run.stage("chunks", lambda: extraction.chunk_documents(docs, config["chunk_tokens"], config["chunk_overlap"], tokenizer))
    # the checkpoint set before resolution: each mention is an entity of its own
    raw_mentions = run.stage("mentions_raw", lambda: extraction.extract_mentions(docs, chunks, gold, fiction, config["engine"], extractor, f"{config['cache']}/mentions"))
    raw_entities = run.stage("entities_raw", lambda: _entities(raw_mentions.select("entity_id", "entity_type", F.col("surface").alias("canonical_name"), F.array().cast("array<string>").alias("aliases"), "source", F.lit(1).alias("mention_count"))))
    raw_relations = run.stage("relations_raw", lambda: _relations(_extract_relations(config, chunks, raw_mentions, relator)))
    validation = quality_control.validate(raw_mentions, raw_entities, raw_relations)
    warnings = [r.asDict() for r in quality_control.unknown_values(raw_entities, raw_relations).limit(200).collect()]

    # resolution is lazy until its stages are written: on resume none of it runs again
    plan: list = []

    def resolved():
        if not plan:
            plan.extend(_resolve(config, raw_mentions, raw_entities, embedder))
        return plan

    mapping = run.stage("mapping", lambda: resolved()[1])
    merged = run.stage("entities_resolved", lambda: _entities(resolved()[0]))
    none = spark.createDataFrame([], raw_relations.schema)
    candidates = run.stage("candidates", lambda: none if resolved()[2] is None or not config["emit_candidates"] else _relations(resolved()[2].withColumns({"doc_id": F.lit(""), "chunk_id": F.lit(""), "source": F.lit("resolution")})))
    mentions = run.stage("mentions_resolved", lambda: resolution.remap(raw_mentions, mapping, "entity_id"))
    linked = run.stage("relations_resolved", lambda: resolution.remap(raw_relations, mapping, "source_entity_id", "target_entity_id"))

    def control(number: int, e: DataFrame, m: DataFrame, r: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, dict]:
        held: list = []

        def part(i: int) -> DataFrame:
            if not held:
                held.extend(quality_control.quality_control(e, m, r))
            return held[i]

        tables = [run.stage(f"qc{number}_{name}", lambda i=i: part(i)) for i, name in enumerate(("entities", "mentions", "relations", "report"))]
        return *tables[:3], tables[3].first().asDict()

    entities, mentions, kept, first_report = control(1, merged, mentions, linked)
    if config["events"]:
        events, event_edges = relations.derive_events(kept)
        entities = entities.unionByName(_entities(events))
        kept = kept.unionByName(_relations(event_edges))
    grounding = run.stage("grounding", lambda: _relations(resolution.ground(entities, mentions, fiction, gold).withColumns({"doc_id": F.lit(""), "chunk_id": F.lit(""), "source": F.lit("grounding"), "evidence_text": F.lit(None).cast("string")})))
    entities, mentions, edges, last_report = control(2, entities, mentions, kept.unionByName(grounding).unionByName(candidates))

    tables = {"docs": writers.artifact_documents(docs.drop("spans")), "chunks": chunks, "mentions": mentions, "entities": entities, "relations": edges.drop("pos")}
    writers.write_artifacts(tables, f"{run.out}/artifacts")
    hubs = graph.top(quality_control.degrees(edges.where(F.col("predicate").isin(*HUB_PREDICATES))), "degree", 15).collect()
    rate = quality_control.grounding_rate(mentions.select("entity_id", "source"), edges, fiction).first()[0]
    metrics = {
        "docs": _counts(docs, "source"), "chunks": chunks.count(), "mentions": _counts(mentions, "source"), "mentions_by_source_type": _counts(mentions, "source", "entity_type"),
        "entities_total": entities.count(), "entities_by_type": _counts(entities, "entity_type"), "relations_total": edges.count(), "relations_by_predicate": _counts(edges, "predicate"),
        "grounding_rate": rate, "top_hubs": [(r["entity_id"], r["degree"]) for r in hubs],
    }
    writers.write_json(spark, metrics, f"{run.out}/reports/metrics.json")
    writers.write_json(spark, {"counts": validation, "warnings": warnings}, f"{run.out}/reports/validation.json")
    writers.write_json(spark, {"first": first_report, "last": last_report}, f"{run.out}/reports/qc.json")
    write_text(spark, f"{run.out}/reports/report.md", writers.markdown_report(metrics))
    writers.write_jsonl(quality_control.audit_sample(edges, config["audit"], config["seed"]), f"{run.out}/reports/audit")
    try:
        report = writers.analytics_report(graph.summary(entities, edges), graph.communities(entities, edges), graph.pagerank(entities, edges, tolerance=config["tolerance"]))
        report["patterns"] = [r.asDict() for r in graph.patterns(edges).collect()]
        writers.write_json(spark, report, f"{run.out}/reports/analytics.json")
    except Exception:  # the graph is built: a report that fails must not take it away
        LOG.exception("graph analytics failed")
        report = None
    write_text(spark, f"{run.out}/cypher/constraints.cypher", "\n".join(writers.CONSTRAINTS) + "\n")
    works = writers.artifact_documents(docs).withColumn("author", F.col("meta")["author"])
    writers.write_cypher(writers.cypher_script(works, entities, mentions, edges, relations.coreference(mentions)), f"{run.out}/cypher/load")
    summary = {
        "run_name": config["run_name"], "elapsed_seconds": round(time.time() - began, 3), "taken_from_an_earlier_run": run.taken,
        "stats": {
            "documents": sum(metrics["docs"].values()), "chunks": metrics["chunks"], "mentions": sum(metrics["mentions"].values()), "entities_pre_resolution": raw_entities.count(),
            "entities_post_resolution": merged.count(), "relations_extracted": raw_relations.count(), "relations_grounding": grounding.count(), "relations_candidates": candidates.count(),
            "relations_total": metrics["relations_total"], "entities_total": metrics["entities_total"],
        },
        "analytics": report is not None,
        "config": {k: v for k, v in config.items() if k != "sources"} | {"sources": config["sources"]},
    }
    writers.write_json(spark, summary, f"{run.out}/summary.json")
    return summary
