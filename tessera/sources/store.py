"""A content-addressed store of what a model said: each key is asked once, by any number of builds at a time.

A state is one small file, numbered by a step that fails if the number is taken (:func:`tessera.session.publish`): the
folders of finished values and the claims of those that are being asked. A writer claims the keys that are neither
there nor claimed, asks for them, and puts the values in place of its claim; what others have claimed it waits for. So
two fills at once ask for no key twice and no key is stored twice. A claim of a writer that died ends with its lease, and
values that come after the lease are thrown away.

A fill goes round by round, each with a share of the keys and a commit of its own: whoever is interrupted keeps what
is finished, and the next fill asks for the rest alone.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.session import drop_path, list_ages, list_names, publish, read_text

#: Commits tried when other writers come first.
TRIES = 100
#: Keys that one round asks for, about: what an interruption loses at the most.
ROUND_KEYS = 20_000
SCHEMA = "key string, value string"


class KeyedStore:
    """key -> value below ``root``, on any file system that Spark reads and writes."""

    def __init__(self, spark: SparkSession, root: str, lease: float = 6 * 3600, poll: float = 1.0):
        self.spark, self.root, self.lease, self.poll = spark, root.rstrip("/"), lease, poll

    def _state(self) -> tuple[int, dict]:
        versions = [int(n[:-5]) for n in list_names(self.spark, f"{self.root}/log") if n.endswith(".json") and n[:-5].isdigit()]
        if not versions:
            return 0, {"data": [], "claims": []}
        return max(versions), json.loads(read_text(self.spark, f"{self.root}/log/{max(versions):08d}.json"))

    def _put(self, version: int, state: dict) -> bool:
        return publish(self.spark, f"{self.root}/log/{version:08d}.json", json.dumps(state, sort_keys=True))

    def _replace(self, claim: str, data: str | None) -> bool:
        """Take a claim away and put ``data`` in its place; False if the claim has ended."""
        for _ in range(TRIES):
            version, state = self._state()
            if claim not in [c["path"] for c in state["claims"]]:
                return False
            new = {"data": state["data"] + ([data] if data else []), "claims": [c for c in state["claims"] if c["path"] != claim]}
            if self._put(version + 1, new):
                return True
        raise RuntimeError(f"{TRIES} commits came first")

    def _read(self, folders: list[str], schema: str = SCHEMA) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def known(self) -> DataFrame:
        """(key, value) of everything that is finished."""
        return self._read(self._state()[1]["data"])

    def _claim(self, keys: DataFrame) -> str | None:
        """The folder of newly claimed keys; None where all are there or claimed."""
        for _ in range(TRIES):
            version, state = self._state()
            claims = [c for c in state["claims"] if c["until"] > time.time()]
            free = keys.join(self._read(state["data"]).select("key"), "key", "left_anti").join(self._read([c["path"] for c in claims], "key string"), "key", "left_anti")
            path = f"{self.root}/claims/{uuid.uuid4().hex}"
            free.write.parquet(path)
            if self._read([path], "key string").limit(1).count() == 0:
                drop_path(self.spark, path)
                return None
            if self._put(version + 1, {"data": state["data"], "claims": [*claims, {"path": path, "until": time.time() + self.lease}]}):
                return path
            drop_path(self.spark, path)
        raise RuntimeError(f"{TRIES} commits came first")

    def fill(self, rows: DataFrame, ask: Callable[[DataFrame], DataFrame], round_keys: int = ROUND_KEYS) -> DataFrame:
        """(key, value) of all keys of ``rows``; ``ask`` gives (key, value) of the rows it gets, one row a key.

        A key that ``ask`` leaves out stays open and is asked again by the next fill; here it has no row.
        """
        self._sweep()
        rows = rows.dropDuplicates(["key"])
        missing = rows.select("key").join(self.known().select("key"), "key", "left_anti").count()
        rounds = -(-missing // round_keys)
        for number in range(rounds):
            part = rows.where(F.pmod(F.xxhash64("key"), F.lit(rounds)) == number)
            while (claim := self._claim(part.select("key"))) is not None:
                data = f"{self.root}/data/{uuid.uuid4().hex}"
                try:
                    ask(part.join(self._read([claim], "key string"), "key", "left_semi")).select("key", "value").write.parquet(data)
                except BaseException:
                    self._replace(claim, None)
                    drop_path(self.spark, data)
                    raise
                if self._replace(claim, data):
                    break
                drop_path(self.spark, data)  # the lease has ended and others may have asked
            self._wait(part.select("key"))
        return rows.select("key").join(self.known(), "key")

    def _sweep(self) -> None:
        """Delete claims that have ended; others may be reading one until its lease is over."""
        named = {c["path"].rpartition("/")[2] for c in self._state()[1]["claims"]}
        for name, seconds in list_ages(self.spark, f"{self.root}/claims").items():
            if name not in named and seconds > self.lease:
                drop_path(self.spark, f"{self.root}/claims/{name}")

    def _wait(self, keys: DataFrame) -> None:
        """Wait until no one else's claim holds any of ``keys``."""
        while True:
            claims = [c["path"] for c in self._state()[1]["claims"] if c["until"] > time.time()]
            if not claims or self._read(claims, "key string").join(keys, "key", "left_semi").limit(1).count() == 0:
                return
            time.sleep(self.poll)
