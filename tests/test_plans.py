"""The driver's contract, plan shapes and streams."""

import __spark_entry__ as entry_module
from tessera.plans import catalog, knowledge
from tessera.streaming import windows

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    names, sql = entry_module.queries(), entry_module.oracle_sql()
    assert set(sql) <= set(names) and set(catalog.queries()) <= set(names)
    assert entry_module.entry(spark).count() > 0


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_native_stages_have_no_python(spark):
    for rows in (knowledge.sentence_mentions(spark, SF), knowledge.edges(spark, SF), knowledge.entities(spark, SF)[0], knowledge.chunks(spark, SF)):
        assert not any(word in plan(rows) for word in ("Python", "NestedLoop", "Cartesian"))


def test_extraction_needs_no_exchange(spark):
    assert "Exchange" not in plan(knowledge.edges(spark, SF))


def test_scans_are_pruned(spark):
    text = plan(knowledge.documents(spark, SF).where("doc_id = 5").select("doc_id"))
    assert "ReadSchema: struct<doc_id:bigint>" in text and "EqualTo(doc_id,5)" in text


def test_streams_agree_with_tables(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "events"))
    got = windows.run_available(spark, str(tmp_path / "events"), events.schema, windows.tumbling)
    key = lambda r: (r.window_start, r.event_type)
    table = {key(r): r.n for r in windows.tumbling(events).collect()}
    stream = {key(r): r.n for r in got.collect()}
    assert stream.items() <= table.items() and len(stream) > 0
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.write.parquet(str(tmp_path / "docs"))
    names = windows.run_available(spark, str(tmp_path / "docs"), docs.schema, windows.mentions_stream)
    assert names.count() == windows.mentions_stream(docs).count()
