"""An append-only dictionary: values keep their numbers, new ones follow in the order of their first place.

A state is one small file, numbered by a step that fails if the number is taken: folders of (value, id) and the next
id. Two writers that extend at once get one after the other: who comes second numbers its values anew, behind the
other's.
"""

from __future__ import annotations

import json
import logging
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.mining import encode
from tessera.session import drop_path, list_names, path_exists, publish, read_text
from tessera.sources.readers import numbered_lines

LOG = logging.getLogger(__name__)
SCHEMA = "value string, id bigint"
#: Extensions tried when other writers come first.
TRIES = 100
#: Triples of one line, at most; the unit of the lines' places.
LINE_TRIPLES = 1 << 20


class Dictionary:
    """value -> id below ``root``; ids are dense from 0."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _state(self) -> tuple[int, dict]:
        versions = [int(n[:-5]) for n in list_names(self.spark, f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit()]
        return (max(versions), json.loads(read_text(self.spark, f"{self.root}/log/{max(versions):08d}.json"))) if versions else (0, {"data": [], "next": 0})

    def _read(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], SCHEMA)

    def known(self) -> DataFrame:
        return self._read(self._state()[1]["data"])

    def extend(self, values: DataFrame, column: str, position: str) -> DataFrame:
        """Number the new ones of ``values``; all (value, id) afterwards. Nulls have no number."""
        rows = values.select(F.col(column).alias("value"), F.col(position).alias("position")).where("value IS NOT NULL")
        for _ in range(TRIES):
            version, state = self._state()
            new = encode(rows.join(self._read(state["data"]).select("value"), "value", "left_anti"), "value", "position")
            data = f"{self.root}/data/{uuid.uuid4().hex}"
            new.select("value", (F.col("id") + state["next"]).alias("id")).write.parquet(data)
            n = self._read([data]).count()
            if not n:
                drop_path(self.spark, data)
                return self.known()
            if publish(self.spark, f"{self.root}/log/{version + 1:08d}.json", json.dumps({"data": [*state["data"], data], "next": state["next"] + n})):
                return self.known()
            drop_path(self.spark, data)
        raise RuntimeError(f"{TRIES} extensions came first")


def read_graphs(spark: SparkSession, paths: list[str]) -> tuple[DataFrame, list[str]]:
    """(triples: s, p, o, place; paths that aren't there) of the ``graph`` fields of JSON-lines files.

    ``place`` follows the files as they are given, their lines and the triples of a line; what has not three parts is
    skipped, and so is a missing file, which is named and logged. The driver counts lines by file.
    """
    there = [p for p in paths if path_exists(spark, p)]
    missing = [p for p in paths if p not in there]
    for p in missing:
        LOG.warning("%s is not there and is skipped", p)
    parts, base = [], 0
    for p in there:
        lines = numbered_lines(spark, p)
        graph = F.from_json("value", "graph array<array<string>>")["graph"]
        triples = lines.select("pos", F.posexplode(graph).alias("i", "t")).where(F.size("t") == 3)
        parts.append(triples.select(F.col("t")[0].alias("s"), F.col("t")[1].alias("p"), F.col("t")[2].alias("o"), ((F.col("pos") + base) * LINE_TRIPLES + F.col("i")).alias("place")))
        base += lines.count()
    found = spark.createDataFrame([], "s string, p string, o string, place bigint")
    for part in parts:
        found = found.unionByName(part)
    return found, missing


def encode_graph(triples: DataFrame, root: str) -> tuple[DataFrame, Dictionary, Dictionary]:
    """(edges: s_id, p_id, o_id, place; entities; relations): triples in numbers of dictionaries below ``root``.

    A head comes before its tail. Datasets that come later go on with the numbers of the earlier ones: encoding A and
    then B gives what encoding both at once gives.
    """
    spark = triples.sparkSession
    entities, relations = Dictionary(spark, f"{root}/entities"), Dictionary(spark, f"{root}/relations")
    ends = F.array(F.struct(F.col("s").alias("value"), (F.col("place") * 2).alias("position")), F.struct(F.col("o").alias("value"), (F.col("place") * 2 + 1).alias("position")))
    names = entities.extend(triples.select(F.inline(ends)), "value", "position")
    kinds = relations.extend(triples.select(F.col("p").alias("value"), "place"), "value", "place")
    edges = triples
    for c, ids in (("s", names), ("p", kinds), ("o", names)):
        edges = edges.join(ids.select(F.col("value").alias(c), F.col("id").alias(f"{c}_id")), c)
    return edges.select("s_id", "p_id", "o_id", "place"), entities, relations
