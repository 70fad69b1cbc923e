"""The store of model answers: concurrent fills, interruptions, leases; the build goes on inside a stage."""

import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera import build
from tessera.operators import extraction
from tessera.sources.store import KeyedStore

from .test_build import Model


def asker(log, fail_on=None, pause=0.0):
    """An ``ask`` that notes each key it is asked for."""

    def batches(frames):
        for pdf in frames:
            for key in pdf["key"]:
                if fail_on is not None and key in fail_on:
                    raise OSError("down")
                with open(log, "a") as file:
                    file.write(key + "\n")
            time.sleep(pause)
            yield pdf[["key"]].assign(value=["v" + k for k in pdf["key"]])

    return lambda rows: rows.mapInPandas(batches, "key string, value string")


def keys(spark, start, stop):
    return spark.range(start, stop).select(F.col("id").cast("string").alias("key"))


def test_two_fills_at_once_ask_once(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    got = {}

    def work(name, start, stop):
        store = KeyedStore(spark, root, poll=0.1)
        got[name] = {r["key"]: r["value"] for r in store.fill(keys(spark, start, stop), asker(log, pause=0.2), round_keys=25).collect()}

    threads = [threading.Thread(target=work, args=a) for a in (("a", 0, 60), ("b", 20, 80))]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert got["a"] == {str(i): f"v{i}" for i in range(60)} and got["b"] == {str(i): f"v{i}" for i in range(20, 80)}
    asked = Counter((tmp_path / "log").read_text().split())
    assert set(asked) == {str(i) for i in range(80)} and set(asked.values()) == {1}
    assert KeyedStore(spark, root).known().count() == 80


def test_an_interruption_keeps_what_is_finished(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    store = KeyedStore(spark, root)
    with pytest.raises(Exception, match="down"):
        store.fill(keys(spark, 0, 100), asker(log, fail_on={"77"}), round_keys=10)
    kept = {r["key"] for r in store.known().collect()}
    assert 0 < len(kept) < 100 and not store._state()[1]["claims"]
    (tmp_path / "log").unlink()
    assert store.fill(keys(spark, 0, 100), asker(log), round_keys=10).count() == 100
    assert set((tmp_path / "log").read_text().split()) == {str(i) for i in range(100)} - kept
    assert store.fill(keys(spark, 0, 100), asker(log, fail_on=set(map(str, range(100))))).count() == 100


def test_the_claim_of_a_dead_writer_ends(spark, tmp_path):
    log, root = str(tmp_path / "log"), str(tmp_path / "store")
    dead = KeyedStore(spark, root, lease=0.5)
    claim = dead._claim(keys(spark, 0, 10))
    assert KeyedStore(spark, root)._claim(keys(spark, 0, 10)) is None
    time.sleep(0.6)
    assert KeyedStore(spark, root, poll=0.1).fill(keys(spark, 0, 20), asker(log)).count() == 20
    assert not dead._replace(claim, f"{root}/data/late")  # what comes after the lease is thrown away
    assert KeyedStore(spark, root).known().groupBy("key").count().where("count > 1").count() == 0


class Finder(Model):
    """Finds words, and is down after a number of texts until a file is there."""

    name = "finder"

    def find(self, texts):
        for t in texts:
            said = len(open(self.log).read().split()) if os.path.exists(self.log) else 0
            if said >= 9 and not os.path.exists(self.log + ".up"):
                raise OSError("down")
            with open(self.log, "a") as file:
                file.write("x\n")
        return super().find(texts)


def test_mentions_are_kept(spark, tmp_path):
    model = Finder(str(tmp_path / "calls"))
    docs = spark.createDataFrame([("d1", "s", "Ana vede Cluj"), ("d2", "s", "Ana doarme")], "doc_id string, source string, text string")
    chunks = extraction.chunk_documents(docs)
    rows = [sorted(map(tuple, extraction.model_mentions(chunks, model, "s", str(tmp_path / "cache")).collect())) for _ in range(2)]
    assert rows[0] == rows[1] == sorted(map(tuple, extraction.model_mentions(chunks, model, "s").collect()))
    assert len((tmp_path / "calls").read_text().split()) == 4  # two with the store, two without


def test_a_build_goes_on_inside_a_stage(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("tessera.sources.store.ROUND_KEYS", 4)
    monkeypatch.setattr(KeyedStore.fill, "__defaults__", (4,))
    (tmp_path / "s.jsonl").write_text("\n".join('{"doc_id": "d%d", "text": "Ana vede Cluj."}' % i for i in range(20)))
    model = Finder(str(tmp_path / "calls"))
    config = {"sources": [{"name": "s", "path": str(tmp_path / "s.jsonl")}], "engine": "model", "gold_source": "none"}
    with pytest.raises(Exception, match="down"):
        build.build(spark, config, str(tmp_path / "out"), extractor=model)
    before = len((tmp_path / "calls").read_text().split())
    assert 0 < before < 20
    kept = KeyedStore(spark, str(tmp_path / "out/cache/mentions")).known().count()
    assert 0 < kept <= before
    (tmp_path / "calls").unlink()
    (tmp_path / "calls.up").write_text("")
    build.build(spark, config, str(tmp_path / "out"), resume=True, extractor=model)
    assert len((tmp_path / "calls").read_text().split()) == 20 - kept
