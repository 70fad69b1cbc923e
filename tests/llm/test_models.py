"""Operators against plain models: mixing, quality votes, size tiers, media index, whole licences, chunk pairs."""

import hashlib
import math
import os
import re
import struct
import threading
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import decontamination, licenses, media, mixing, ngram_jaccard, quality, sharding
from tessera.session import fresh_path

from .conftest import LONG, make


def plain_targets(sizes, weights=(5.0, 2.0, 1.0), most=3):
    """Targets by repeated sharing, from the rule's text."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    fixed = {}
    while True:
        free = [s for s in order if s not in fixed]
        rest = sum(sizes.values()) - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > most * sizes[s]]
        if not over:
            return fixed | share
        fixed |= {s: most * sizes[s] for s in over}


def plain_copies(sizes, target, most=3):
    """Whole copies of all documents of each size of one source: bisection on the dual, then rounding from the largest size."""
    count = Counter(sizes)
    words = lambda k: sum(n * s * min(most, math.exp(min(k * s, 700))) for s, n in count.items())
    low, high = -50.0, 50.0
    for _ in range(300):
        middle = (low + high) / 2
        low, high = (middle, high) if words(middle) < target else (low, middle)
    out, carry = {}, 0.0
    for s in sorted(count, reverse=True):
        want = count[s] * s * min(most, math.exp(min(low * s, 700))) + carry if s else 0
        out[s] = min(most * count[s], max(0, math.floor(want / s + 0.5))) if s else count[s]
        carry = want - out[s] * s
    return out


def test_mixing_is_the_optimum_of_the_dual(spark):
    import random

    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(0, 60), rng.choice(["a", "a", "b", "c", None])) for i in range(400)]
    got = mixing.mix_counts(make(spark, rows)).collect()
    by_source = defaultdict(list)
    for _, t, s in rows:
        by_source[s].append(len(t.split()))
    targets = plain_targets({s: sum(v) for s, v in by_source.items()})
    source = {i: s for i, _, s in rows}
    for s, sizes in by_source.items():
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert mine[0]["target"] == pytest.approx(targets[s]) and mine[0]["source_size"] == sum(sizes)
        want, found = plain_copies(sizes, targets[s]), Counter()
        for r in mine:
            found[r["size"]] += r["copies"]
        assert {k: found[k] for k in want} == want
        for size in want:  # documents of one size differ by one copy at most
            copies = [r["copies"] for r in mine if r["size"] == size]
            assert max(copies) - min(copies) <= 1
        assert abs(sum(r["taken"] for r in mine) - targets[s]) <= min(x for x in sizes if x)


def test_mixing_of_rows_that_differ_in_source_alone(spark):
    rows = [(1, "one two three four", "a"), (1, "one two three four", "b"), (2, "five six", "a"), (3, "seven", "b")]
    docs = make(spark, rows)
    counts = Counter({(r["doc_id"], r["source_key"]): r["copies"] for r in mixing.mix_counts(docs).collect()})
    for parts in (1, 4):
        out = Counter((r["doc_id"], "s" + r["source"]) for r in mixing.mixed(docs.repartition(parts)).collect())
        assert out == +counts


def test_mixing_says_when_it_does_not_settle(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_ITERATIONS", 1)
    with pytest.raises(RuntimeError, match="settle"):
        mixing.mix_counts(make(spark, [(i, "w " * (i + 1), "ab"[i % 2]) for i in range(20)]))


def test_votes_are_those_of_the_nearest(spark):
    rows = [(i, " ".join(("good plain words", "BAD!! $$$")[i % 2].split() * (1 + i % 7)) + f" w{i % 11}", "a") for i in range(60)]
    rows += [(100 + i, rows[i][1], "b") for i in range(10)]  # repeated texts: ties among the neighbours
    docs = make(spark, rows)
    labels = spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(60)] + [(100 + i, i % 2, 0) for i in range(4)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in quality.scores(docs, model).collect()}
    for i, t, _ in rows:
        mine = quality._unit(quality._weighted(quality.terms(pa.array([t])), model.idf) @ model.axes)[0]
        near = sorted(((float(np.dot(mine, p)), -k) for k, p in enumerate(model.points)), reverse=True)[: quality.NEIGHBOURS]
        weight = [(max(c, 0) ** quality.SHARPNESS * model.votes[-k], model.labels[-k]) for c, k in near]
        want = sum(w * y for w, y in weight) / sum(w for w, _ in weight)
        assert got[i] == pytest.approx(want, abs=2e-3), t


def test_nearest_takes_the_first_of_equals():
    rng = np.random.default_rng(1)
    cosines = rng.integers(0, 6, (200, 50)).astype(np.float32)
    for row, found in zip(cosines, quality.nearest(cosines, 7), strict=True):
        assert sorted(found) == sorted(sorted(range(50), key=lambda k: (-row[k], k))[:7])


def test_long_words_keep_their_whole_shape():
    a, b = quality.terms(pa.array(["!" * 10 + "a" * 3 + "#" * 9, "!" * 10 + "a" * 3 + "1" * 9]))
    shapes = slice(quality.WORD_TERMS, quality.WORD_TERMS + quality.SHAPE_TERMS)
    assert not np.array_equal(a[shapes], b[shapes])


def test_tiers_merge_in_order(spark, monkeypatch):
    """Arrivals go up tier by tier, every version reads whole, and what a dead writer left goes when it is old."""
    monkeypatch.setattr(sharding, "LEAST_BYTES", 1)
    docs = make(spark, [(0, "x", "a")])
    store = sharding.ShardStore(spark, fresh_path(spark, "tiers"), docs.schema)
    steps, merge = [], store._merge
    monkeypatch.setattr(store, "_merge", lambda groups: steps.append([s for g in groups for s in g]) or merge(groups))
    rows = []
    for k in range(16):
        new = [(10 * k + i, os.urandom(30_000).hex(), "a") for i in range(3)]
        rows += new
        store.append(make(spark, new).coalesce(1))
        store.compact()
    assert len(steps) >= 5 and all(max(s["bytes"] for s in step) <= sharding.SIMILAR * min(s["bytes"] for s in step) for step in steps)
    assert max(s["merged"] for s in store.shards()) >= 2  # merged shards were merged again, with their like
    assert len(store.shards()) < 8
    ids = lambda v=None: sorted(r["doc_id"] for r in store.read(v).select("doc_id").collect())
    assert ids() == sorted(r[0] for r in rows)
    assert set(ids(store.version() - 1)) <= set(ids())  # the version before is still there for its readers
    left = store.root.removeprefix("file://") + "/data/dead"
    os.makedirs(left)
    with open(left + "/part-0.parquet", "w") as file:
        file.write("half")
    assert store.vacuum() == 0 and os.path.exists(left + "/part-0.parquet")  # it might still be written
    time.sleep(1.1)
    store.vacuum(orphan_seconds=1)
    assert not os.path.exists(left + "/part-0.parquet") and ids() == sorted(r[0] for r in rows)


def test_a_table_arrives_in_appends_and_is_merged_twice(spark):
    docs = make(spark, [(i, os.urandom(300).hex(), "a") for i in range(400)])
    for rows in (docs.coalesce(1), docs.repartition(40)):
        store = sharding.shard(rows, fresh_path(spark, "arrivals"))
        assert len(store.appended) == sharding.ARRIVALS and sum(store.appended) == 400 and store.version() > sharding.ARRIVALS
        assert max(s["merged"] for s in store.shards()) >= 2 and len(store.shards()) < 8
        assert sorted(r["doc_id"] for r in store.read().select("doc_id").collect()) == list(range(400))


def test_two_writers_lose_nothing(spark):
    """Appends and merges of four writers at once: every commit is one writer's, every row is there once."""
    docs = make(spark, [(0, "x", "a")])
    root = fresh_path(spark, "writers")
    stores = [sharding.ShardStore(spark, root, docs.schema) for _ in range(4)]
    written = [store._write(make(spark, [(100 * k + i, os.urandom(50).hex(), "a")]).coalesce(1)) for k, store in enumerate(stores) for i in range(5)]

    def work(k):
        for i in range(5):
            stores[k]._commit_added(written[5 * k + i])
            if i % 2:
                stores[k].compact()

    threads = [threading.Thread(target=work, args=(k,)) for k in range(4)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    stores[0].compact()
    assert [len(s.appended) for s in stores] == [5] * 4
    assert sorted(r["doc_id"] for r in stores[1].read().select("doc_id").collect()) == sorted(100 * k + i for k in range(4) for i in range(5))
    # one name, many takers
    for version in range(stores[0].version(), stores[0].version() + 10):
        wins = []

        def take(k, version=version, wins=wins):
            try:
                wins.append(stores[k].commit(version, stores[k].shards(version)))
            except sharding.Conflict:
                pass

        threads = [threading.Thread(target=take, args=(k,)) for k in range(4)]
        for t in threads:
            t.start()
        for t in threads:
            t.join()
        assert wins == [version + 1]


def test_a_merge_gives_way_to_another(spark, monkeypatch):
    docs = make(spark, [(i, os.urandom(50).hex(), "a") for i in range(4)])
    root = fresh_path(spark, "merges")
    mine, other = (sharding.ShardStore(spark, root, docs.schema) for _ in range(2))
    for i in range(4):
        mine.append(docs.where(F.col("doc_id") == i).coalesce(1))
    merge, calls = mine._merge, []

    def late(groups):
        made = merge(groups)
        if not calls:
            calls.append(1)
            other.compact()  # the same shards, committed first
            other.append(make(spark, [(9, "y", "a")]))
        return made

    monkeypatch.setattr(mine, "_merge", late)
    mine.compact()
    assert sorted(r["doc_id"] for r in mine.read().collect()) == [0, 1, 2, 3, 9]
    files = {s["path"] for s in mine.shards()}
    assert len(files) == 2


def test_sharding_of_columns_with_its_names(spark):
    docs = make(spark, [(1, "x", "a"), (2, None, None)]).withColumns({"shard": F.lit("mine"), "manifest_version": F.lit(0)})
    out = sharding.shard(docs, fresh_path(spark, "clash")).read_with_shard()
    assert [*docs.columns, "shard_", "manifest_version_"] == out.columns
    assert {(r["shard"], r["manifest_version"]) for r in out.collect()} == {("mine", 0)} and out.where("shard_ LIKE '%.parquet'").count() == 2


def test_media_index_and_features(spark):
    texts = [None, "", "a", "b" * 64, "c" * 65, "d" * 5000, "é" * 100_000, LONG]
    docs = make(spark, [(i, t, "a") for i, t in enumerate(texts)])
    stored = {r["doc_id"]: r for r in media.store(docs).collect()}
    got = {r["doc_id"]: r for r in media.stored_digests(docs).collect()}
    for i, t in enumerate(texts):
        payload = media.padded((t or "").encode())
        file, n = media.mux(payload), len(payload) // 64
        assert stored[i]["media"] == file and stored[i]["error"] is None
        (track,) = stored[i]["tracks"]
        assert (track["codec"], track["handler"], track["timescale"], track["duration"], track["n_samples"]) == ("raw ", "soun", 8000, 64 * n, n)
        # keyframes are every 16th sample, and the payload is the last box
        first = len(file) - len(payload)
        assert [(k["offset"], k["size"]) for k in track["keyframes"]] == [(first + 64 * k, 64) for k in range(0, n, 16)]
        r = got[i]
        assert (r["media_bytes"], r["media_sha256"]) == (len(file), hashlib.sha256(file).hexdigest())
        assert r["feature"].startswith(f"raw/8000/{64 * n}/{n}/{-(-n // 16)}/")
    assert got[0]["feature"] == got[1]["feature"] != got[4]["feature"]
    assert got[0]["media_sha256"] == got[1]["media_sha256"]


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def test_foreign_container():
    """Samples of several sizes in chunks apart, a nested box that no one asked for, no table of keyframes."""
    sizes, payload = [3, 5, 7, 2, 9], bytes(range(29))
    chunks = [(0, 2), (10, 2), (20, 1)]  # place in the payload, samples
    table = lambda kind, fmt, rows: box(kind, bytes(4), struct.pack(">I", len(rows)), *(struct.pack(fmt, *r) for r in rows))

    def file(first):
        stbl = box(
            b"stbl", table(b"stts", ">II", [(5, 10)]), table(b"stsc", ">III", [(1, 2, 1), (3, 1, 1)]),
            box(b"stsz", bytes(4), struct.pack(">II", 0, 5), *(struct.pack(">I", s) for s in sizes)),
            table(b"stco", ">I", [(first + at,) for at, _ in chunks]), box(b"stsd", bytes(4), struct.pack(">I", 1), box(b"mp4a", bytes(8))),
        )
        mdia = box(b"mdia", box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, 1000, 50)), box(b"hdlr", bytes(8), b"soun"), box(b"minf", stbl))
        return box(b"ftyp", b"isom") + box(b"free", b"xyz") + box(b"moov", box(b"udta", box(b"name", b"n")), box(b"trak", mdia)) + box(b"mdat", payload)

    data = file(len(file(0)) - len(payload))
    at = len(data) - len(payload)
    (track,) = media.probe(data)["tracks"]
    assert (track["codec"], track["timescale"], track["duration"], track["n_samples"]) == ("mp4a", 1000, 50, 5)
    assert track["offsets"].tolist() == [at, at + 3, at + 10, at + 17, at + 20] and track["sizes"].tolist() == sizes
    with pytest.raises(ValueError):
        media._tracks(data[:-5])
    short = file(len(file(0)) - len(payload) + 5)  # the last sample would end behind the file
    assert media.probe(short)["error"]


def test_whole_licences(spark):
    """Every licence is found after changes of case, marks, line ends, copyright lines and spelling, and not after a change of words."""
    swap = {"license": "licence", "color": "colour", "organization": "organisation", "http": "https", "favor": "favour"}
    known = [(n, t) for n, t in licenses.known_texts() if len(t) > 500]
    assert len({n for n, _ in known}) >= 20
    rows, want = [], {}
    for k, (name, text) in enumerate(known):
        british = re.sub(r"\b(" + "|".join(swap) + r")\b", lambda m: swap[m[0]], text)
        changed = "/* Copyright (c) 2019-2024 Some One <a@b.c>\n" + "Copyright © 2021 Any Body\n  All rights reserved.\n" + " ;\r\n".join(british.upper().split("\n")).replace("COPYRIGHT HOLDER", "Copyright Owner")
        words = text.split()
        words[len(words) // 2] = "otherwise" if words[len(words) // 2] != "otherwise" else "elsewhere"
        for i, (t, found) in enumerate(((text, True), (changed, True), (" ".join(words), False), (text + " more", False), (text[: len(text) // 2], False))):
            rows.append((10 * k + i, t, "a"))
            want[10 * k + i] = name if found else None
    rows.append((9999, known[0][1], None))
    want[9999] = known[0][0]
    found = licenses.find_licenses(make(spark, rows).withColumn("known", F.lit("x")), licenses.known_licenses(spark)).collect()
    assert {r["doc_id"]: r["license_id"] for r in found} == want


def test_tiles_give_every_pair_once(spark, monkeypatch):
    monkeypatch.setattr(ngram_jaccard, "TILE", 3)
    lists = [[1, 2], [5], [2, 4, 6], [1, 2, 3, 4, 5, 6, 7], list(range(10, 30)), list(range(10, 30))]
    found = [(r["a"], r["b"]) for r in ngram_jaccard._chunk_pairs(spark.createDataFrame([(x,) for x in lists], "chunks array<bigint>")).collect()]
    want = {(a, b) for x in lists for a in x for b in x if a < b}
    assert len(found) == len(set(found)) and set(found) == want


def test_one_row_of_each_component_stays(spark):
    copy = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    rows = [
        (5, copy, "a"), (3, copy.upper(), "b"), (3, copy, "c"), (3, copy, "c"), (3, "quite another text under the id of a copy", "a"),
        (None, "first text without an id at all", "a"), (None, "second text that has no id", "a"), (None, copy, "a"), (None, None, "a"), (8, "", "b"), (8, " \n", "b"),
    ]
    kept = sorted(((r["doc_id"], r["text"]) for r in ngram_jaccard.keep_one(make(spark, rows), 3, Fraction(4, 5)).collect()), key=repr)
    copies = [t for _, t in kept if t and t.lower() == copy]
    assert len(copies) == 1
    others = [(3, rows[4][1]), (None, rows[5][1]), (None, rows[6][1]), (None, None), (8, ""), (8, " \n")]
    assert kept == sorted([*others, (3, copies[0])], key=repr)


def test_items_in_long_texts_and_ids_of_other_types(spark):
    items = [(1, "Nine small birds sat upon the wire above the empty road and sang until the sun went down behind the hills"), (2, "Water boils at a lower temperature on a mountain because the air presses less on it than at the sea")]
    text = LONG + items[0][1].replace("small", "smal") + " " + LONG + items[1][1].upper() + " end"
    table = spark.createDataFrame([(i, t) for i, t in items], "item_id int, text string")
    found = decontamination.matches(make(spark, [(7, text, "a"), (8, LONG, "a")]), table).collect()
    assert sorted((r["doc_id"], r["item_id"], r["distance"]) for r in found) == [(7, 1, 1), (7, 2, 0)]
    assert decontamination.decontaminated(make(spark, [(7, text, "a"), (8, LONG, "a")]), table).first()["doc_id"] == 8
