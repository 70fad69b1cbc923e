"""Writers: artifact tables, splits, Cypher scripts, reports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators.graph import top_communities
from tessera.session import write_text

#: The statements that a graph database gets first.
CONSTRAINTS = (
    "CREATE CONSTRAINT work_id_unique IF NOT EXISTS FOR (w:Work) REQUIRE w.work_id IS UNIQUE;",
    "CREATE CONSTRAINT entity_id_unique IF NOT EXISTS FOR (e:Entity) REQUIRE e.entity_id IS UNIQUE;",
    "CREATE CONSTRAINT mention_id_unique IF NOT EXISTS FOR (m:Mention) REQUIRE m.mention_id IS UNIQUE;",
    "CREATE INDEX mention_doc_id IF NOT EXISTS FOR (m:Mention) ON (m.doc_id);",
)


def write_jsonl(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json(spark: SparkSession, value: object, path: str) -> None:
    """One small JSON value, readable, without ASCII escapes, on any file system that Spark knows."""
    write_text(spark, path, json.dumps(value, ensure_ascii=False, indent=2, default=str))


def artifact_documents(docs: DataFrame) -> DataFrame:
    """Documents as kept: the length of the text instead of the text, and the work's id."""
    return docs.select(*[c for c in docs.columns if c != "text"], F.length("text").alias("text_len"), T.stable_id("work", F.col("source"), F.col("doc_id")).alias("work_id"))


def write_artifacts(tables: dict[str, DataFrame], folder: str, suffix: str = "") -> None:
    """Each table as Parquet below ``folder``; also the checkpoint sets before resolution (suffix ``_raw``)."""
    for name, rows in tables.items():
        kept = rows.withColumn("text_len", F.length("text")).drop("text") if name in ("docs", "chunks") and "text" in rows.columns else rows
        kept.write.mode("overwrite").parquet(f"{folder}/{name}{suffix}")


def split_last(rows: DataFrame, n: int, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """(all but the last ``n`` rows, the last ``n``) by position, without a global window."""
    last = rows.orderBy(F.desc(order)).limit(n).select(order)
    return rows.join(last, order, "left_anti"), rows.join(last, order, "left_semi")


def _properties(rows: DataFrame, prefix: str, names: tuple[str, ...], assign: str) -> Column:
    """``prefix.name = literal`` or ``name: literal`` of some columns, with commas; a column that isn't there is null."""
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}

    def literal(name: str) -> Column:
        if name not in kinds:
            return F.lit("null")
        if kinds[name].startswith("map<"):
            return T.cypher_string(F.to_json(F.coalesce(F.col(name), F.create_map().cast(kinds[name]))))
        return T.cypher_value(F.col(name), kinds[name])

    return F.concat_ws(", ", *(F.concat(F.lit(f"{prefix}{n}{assign}"), literal(n)) for n in names))


WORK = ("title", "author", "source")
ENTITY = ("entity_type", "canonical_name", "aliases", "is_fictional", "source", "meta")
MENTION = ("surface", "start_char", "end_char", "doc_id", "chunk_id", "source", "entity_type", "confidence")
#: A relation is known by where it was found: another place is another edge.
PLACE = ("doc_id", "chunk_id", "source", "evidence_chunk_id")
EVIDENCE = ("confidence", "evidence_text", "rel_type")


def cypher_script(works: DataFrame, entities: DataFrame, mentions: DataFrame, relations: DataFrame, coref: DataFrame) -> DataFrame:
    """(section, line) of a load script: works, entities, mentions, links, relations, coreference, in that order.

    Every statement merges, so a script may run again. Columns that a table doesn't have are null properties, but for
    the place of a relation, which is a key: an empty string there.
    """
    s = T.cypher_string
    key = lambda c: s(F.col(c))
    put = lambda rows, var, names: F.concat(F.lit(" SET "), _properties(rows, f"{var}.", names, " = "), F.lit(";"))
    work_id = T.stable_id("work", F.col("source"), F.col("doc_id")) if "work_id" not in mentions.columns else F.col("work_id")
    placed = mentions.withColumn("__work", work_id)
    linked = relations.where("predicate <> 'MENTIONS'").withColumn("evidence_chunk_id", F.col("chunk_id") if "chunk_id" in relations.columns else F.lit(None).cast("string"))
    for c in PLACE:
        linked = linked.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit("")) if c in linked.columns else F.lit(""))
    say = lambda section, *parts: (F.lit(section).alias("section"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("line"))
    parts = [
        works.select(*say(1, "MERGE (w:Work {work_id: ", key("work_id"), "})", put(works, "w", WORK))),
        entities.select(*say(2, "MERGE (e:Entity:", F.col("entity_type"), " {entity_id: ", key("entity_id"), "})", put(entities, "e", ENTITY))),
        mentions.select(*say(3, "MERGE (m:Mention {mention_id: ", key("mention_id"), "})", put(mentions, "m", MENTION))),
        placed.select(*say(4, "MATCH (w:Work {work_id: ", key("__work"), "}), (m:Mention {mention_id: ", key("mention_id"), "}) MERGE (w)-[:HAS_MENTION]->(m);")),
        placed.select(*say(4, "MATCH (m:Mention {mention_id: ", key("mention_id"), "}), (e:Entity {entity_id: ", key("entity_id"), "}) MERGE (m)-[:REFERS_TO]->(e);")),
        placed.where("entity_type = 'Character'").select("__work", "entity_id").distinct().select(*say(4, "MATCH (w:Work {work_id: ", key("__work"), "}), (e:Entity:Character {entity_id: ", key("entity_id"), "}) MERGE (w)-[:HAS_CHARACTER]->(e);")),
        linked.select(*say(5, "MATCH (a:Entity {entity_id: ", key("source_entity_id"), "}), (b:Entity {entity_id: ", key("target_entity_id"), "}) MERGE (a)-[r:", F.col("predicate"), " {", _properties(linked, "", PLACE, ": "), "}]->(b)", put(linked, "r", EVIDENCE))),
        coref.select(*say(6, "MATCH (a:Mention {mention_id: ", key("source_mention_id"), "}), (b:Mention {mention_id: ", key("target_mention_id"), "}) MERGE (a)-[:COREFERS_WITH {", _properties(coref, "", ("doc_id", "entity_id"), ": "), "}]->(b);")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def write_cypher(script: DataFrame, path: str) -> None:
    script.repartitionByRange("section", "line").sortWithinPartitions("section", "line").select("line").write.mode("overwrite").text(path)


def load_graph(records: DataFrame, make_driver, statement: str, batch: int = 2000) -> None:
    """Send rows to a graph database in batches through a driver made in each task; ``make_driver`` is the caller's."""

    def send(rows) -> None:
        driver, held = make_driver(), []
        for row in rows:
            held.append(row.asDict(recursive=True))
            if len(held) == batch:
                driver.run(statement, rows=held)
                held = []
        if held:
            driver.run(statement, rows=held)
        driver.close()

    records.foreachPartition(send)


#: Relations that the direct load knows; a statement can't take its type from a row.
LOADED_PREDICATES = ("INTERACTS_WITH", "LOCATED_IN", "SAME_AS", "BASED_ON")


def _from_row(var: str, names: tuple[str, ...]) -> str:
    return ", ".join(f"{var}.{n} = row.{n}" for n in names)


def load_statements() -> dict[str, str]:
    """Statement of each table of the direct load; ``row`` is one of a batch."""
    found = {
        "works": f"UNWIND $rows AS row MERGE (w:Work {{work_id: row.work_id}}) SET {_from_row('w', WORK)}",
        "entities": f"UNWIND $rows AS row MERGE (e:Entity {{entity_id: row.entity_id}}) SET {_from_row('e', ENTITY)}",
        "mentions": f"UNWIND $rows AS row MERGE (m:Mention {{mention_id: row.mention_id}}) SET {_from_row('m', MENTION)}",
        "links": "UNWIND $rows AS row MATCH (m:Mention {mention_id: row.mention_id}), (e:Entity {entity_id: row.entity_id}) MERGE (m)-[:MENTIONS]->(e) WITH row, m MATCH (w:Work {work_id: row.work_id}) MERGE (w)-[:MENTIONED_IN]->(m)",
    }
    place = ", ".join(f"{n}: row.{'chunk_id' if n == 'evidence_chunk_id' else n}" for n in PLACE)
    for predicate in LOADED_PREDICATES:
        found[predicate] = f"UNWIND $rows AS row MATCH (a:Entity {{entity_id: row.source_entity_id}}), (b:Entity {{entity_id: row.target_entity_id}}) MERGE (a)-[r:{predicate} {{{place}}}]->(b) SET {_from_row('r', EVIDENCE)}"
    return found


def load_tables(works: DataFrame, entities: DataFrame, mentions: DataFrame, relations: DataFrame, make_driver, batch: int = 2000) -> None:
    """Constraints, works, entities, mentions, their links and the relations of the known predicates, one table after another."""
    driver = make_driver()
    for line in CONSTRAINTS:
        driver.run(line)
    driver.close()
    statements = load_statements()
    links = mentions.select("mention_id", "entity_id", T.stable_id("work", F.col("source"), F.col("doc_id")).alias("work_id"))
    for name, rows in (("works", works), ("entities", entities), ("mentions", mentions), ("links", links)):
        load_graph(rows, make_driver, statements[name], batch)
    for predicate in LOADED_PREDICATES:
        load_graph(relations.where(F.col("predicate") == predicate), make_driver, statements[predicate], batch)


def analytics_report(summary: DataFrame, communities: DataFrame, ranks: DataFrame, n: int = 10) -> dict:
    """Numbers of a graph for a report: rounded, communities and members cut to ``n``."""
    one = summary.select("node_count", "edge_count", F.round("avg_degree", 2).alias("avg_degree"), F.round("density", 4).alias("density")).first().asDict()
    top = top_communities(communities, n).select("community", "size", F.slice("members", 1, n).alias("members"))
    ranked = ranks.orderBy(F.desc("pagerank"), "entity_id").limit(20).select("entity_id", F.round("pagerank", 4).alias("pagerank"))
    return one | {"community_count": communities.count(), "communities": [r.asDict() for r in top.collect()], "top_pagerank": [r.asDict() for r in ranked.collect()]}


def markdown_report(metrics: dict[str, object]) -> str:
    return "\n".join(["# Knowledge graph", "", *(f"- {name}: {value}" for name, value in metrics.items())]) + "\n"
