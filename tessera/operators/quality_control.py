"""Validation, quality control and corpus metrics of a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions import vocab
from tessera.operators.relations import type_allows
from tessera.session import cut


class InvalidGraph(ValueError):
    """The graph has references to missing entities or spans that end before they begin."""


def missing_references(mentions: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, id) of every reference to an entity that is not there, and of every reversed span."""
    ids = entities.select("entity_id")
    rows = mentions.join(ids, "entity_id", "left_anti").select(F.lit("mention_entity").alias("kind"), "entity_id")
    for end in ("source", "target"):
        c = f"{end}_entity_id"
        rows = rows.unionByName(relations.select(F.col(c).alias("entity_id")).join(ids, "entity_id", "left_anti").select(F.lit(f"relation_{end}").alias("kind"), "entity_id"))
    return rows.unionByName(mentions.where("end_char < start_char").select(F.lit("reversed_span").alias("kind"), F.col("mention_id").alias("entity_id")))


def unknown_values(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(kind, value, n): types and predicates outside the vocabulary; these are warnings."""
    types = entities.where(~F.col("entity_type").isin(*vocab.ENTITY_TYPES)).groupBy(F.lit("entity_type").alias("kind"), F.col("entity_type").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return types.unionByName(relations.where(~F.col("predicate").isin(*vocab.PREDICATES)).groupBy(F.lit("predicate").alias("kind"), F.col("predicate").alias("value")).agg(F.count(F.lit(1)).alias("n")))


def validate(mentions: DataFrame, entities: DataFrame, relations: DataFrame, shown: int = 50) -> dict[str, int]:
    """Raise :class:`InvalidGraph` with the first errors; else counts by entity type and predicate."""
    errors = [tuple(r) for r in missing_references(mentions, entities, relations).limit(shown).collect()]
    if errors:
        raise InvalidGraph(f"{len(errors)} errors or more: {errors}")
    both = entities.groupBy(F.col("entity_type").alias("k")).count().unionByName(relations.groupBy(F.col("predicate").alias("k")).count())
    return {r["k"]: r["count"] for r in both.collect()}


def degrees(relations: DataFrame, predicate: str | None = None) -> DataFrame:
    """(entity_id, degree): both ends of every edge count."""
    rows = relations if predicate is None else relations.where(F.col("predicate") == predicate)
    return rows.select(F.explode(F.array("source_entity_id", "target_entity_id")).alias("entity_id")).groupBy("entity_id").agg(F.count(F.lit(1)).alias("degree"))


def junk(name: Column, degree: Column) -> Column:
    norm = T.normalize_mention(F.coalesce(name, F.lit("")))
    hub = (F.length(norm) <= 2) & (degree >= 20) | ~F.contains(norm, F.lit(" ")) & (F.length(norm) <= 6) & (degree >= 5000)
    return (norm == "") | norm.isin(*vocab.JUNK_NAMES) | hub


def quality_control(entities: DataFrame, mentions: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(entities, mentions, relations, report of counters). Each edge is removed for its first reason only.

    Order: self loop, missing end, type rule, then repeats of the canonical edge (symmetric ends sorted): the first by
    ``pos``, the place where it was extracted, stays; edges of one place or without one go by all their other columns,
    so that the same one stays in every run.
    """
    # both are read several times below
    relations = cut(relations, "qc-relations")
    rated = cut(entities.join(degrees(relations), "entity_id", "left").withColumn("junk", junk(F.col("canonical_name"), F.coalesce("degree", F.lit(0)))), "qc-entities")
    kept = rated.where("NOT junk").drop("degree", "junk")
    kept_mentions = mentions.join(kept.select("entity_id"), "entity_id", "left_semi")
    kinds = kept.select("entity_id", "entity_type")
    for end in ("source", "target"):
        relations = relations.join(kinds.select(F.col("entity_id").alias(f"{end}_entity_id"), F.col("entity_type").alias(f"__{end}")), f"{end}_entity_id", "left")
    reason = (
        F.when(F.col("source_entity_id") == F.col("target_entity_id"), "self_loop")
        .when(F.col("__source").isNull() | F.col("__target").isNull(), "missing_end")
        .when(~type_allows(F.col("predicate"), F.col("__source"), F.col("__target")), "type_violation")
    )
    flip = F.col("predicate").isin(*vocab.SYMMETRIC_PREDICATES) & (F.col("source_entity_id") > F.col("target_entity_id"))
    checked = relations.withColumn("reason", reason).withColumns({"source_entity_id": F.when(flip, F.col("target_entity_id")).otherwise(F.col("source_entity_id")), "target_entity_id": F.when(flip, F.col("source_entity_id")).otherwise(F.col("target_entity_id"))})
    rest = [c for c in relations.columns if not c.startswith("__")]
    key = ["source_entity_id", "predicate", "target_entity_id", "doc_id", "chunk_id"]
    nth = F.row_number().over(Window.partitionBy(*key, F.col("reason").isNull()).orderBy(*([F.col("pos").asc_nulls_last()] if "pos" in rest else []), *(c for c in sorted(rest) if c != "pos")))
    judged = checked.withColumn("reason", F.when(F.col("reason").isNull() & (nth > 1), "duplicate").otherwise(F.col("reason")))
    count = lambda r: F.count_if(F.col("reason") == r)
    report = judged.agg(count("self_loop").alias("removed_self_loops"), count("missing_end").alias("removed_missing_ends"), count("type_violation").alias("removed_type_violations"), count("duplicate").alias("removed_duplicates"), F.count_if(F.col("reason").isNull()).alias("kept_relations"))
    report = report.crossJoin(rated.agg(F.count_if("junk").alias("removed_entities"), F.count_if(~F.col("junk")).alias("kept_entities")))  # one row each
    return kept, kept_mentions, judged.where("reason IS NULL").select(*rest), report


def grounding_rate(entities_by_source: DataFrame, edges: DataFrame, source: str) -> DataFrame:
    """Share of a corpus' entities that begin a SAME_AS or BASED_ON edge; 0 without entities."""
    own = entities_by_source.where(F.col("source") == source).select("entity_id").distinct()
    grounded = edges.where(F.col("predicate").isin("SAME_AS", "BASED_ON")).select(F.col("source_entity_id").alias("entity_id")).distinct().withColumn("hit", F.lit(1))
    return own.join(grounded, "entity_id", "left").agg(F.coalesce(F.sum("hit") / F.nullif(F.count(F.lit(1)), F.lit(0)), F.lit(0.0)).alias("grounding_rate"))


def audit_sample(relations: DataFrame, n: int, seed: int, predicates: tuple[str, ...] = ()) -> DataFrame:
    """``n`` relations in the order of an MD5 of seed and columns (by name): it doesn't depend on partitions."""
    rows = relations.where(F.col("predicate").isin(*predicates)) if predicates else relations
    order = F.md5(F.concat_ws("\t", F.lit(str(seed)), *(F.col(c).cast("string") for c in sorted(rows.columns))).cast("binary"))
    return rows.orderBy(order).limit(n)
