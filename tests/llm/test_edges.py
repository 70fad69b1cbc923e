"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

import hashlib
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest

from tessera.llm import decontamination, licenses, line_dedup, media, mixing, ngram_jaccard, quality, sharding, token_counts, token_files
from tessera.session import fresh_path

from .conftest import ROWS, make

BPE, PIECE = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def test_token_files(spark, docs, empty):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(BPE)
    got = [tuple(r) for r in token_files.token_files(docs, BPE).collect()]
    want, start = [], 0
    for i, text, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert token_files.token_files(empty, BPE).count() == 0


def test_simple8b_round_trip():
    rng = np.random.default_rng(5)
    for n in (0, 1, 1023, 1024, 1025, 5000):
        for high in (1, 2, 40, 60_000, 1 << 33, 1 << 62):
            ids = rng.integers(0, high, n).astype(np.uint64) << rng.integers(0, 2, n).astype(np.uint64)
            words, offsets = token_files.encode(ids)
            assert (token_files.decode(words, offsets, n) == ids).all()


def test_token_counts(spark, docs, empty):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = Counter(tuple(r) for r in token_counts.token_counts(docs, PIECE).collect())
    assert got == Counter((i, len((t or "").encode()), len(library.encode(t or ""))) for i, t, _ in ROWS)
    assert token_counts.token_counts(empty, PIECE).count() == 0


def test_media(spark, docs, empty):
    got = Counter(tuple(r) for r in media.stored_digests(docs).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect())
    want = Counter()
    for i, t, _ in ROWS:
        raw = (t or "").encode()
        payload = raw + bytes(max(1, -(-len(raw) // 64)) * 64 - len(raw))
        want[i, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])] += 1
    assert got == want
    assert media.stored_digests(empty).count() == 0
    tracks = media.index(media.store(docs)).where("doc_id = 7").first()
    assert tracks["error"] is None and tracks["tracks"][0]["codec"] == "raw "


@pytest.mark.parametrize("damage", [b"", b"\0\0\0\1", b"\0\0\0\x10moov\0\0\0\x20trak", media.mux(bytes(640))[:-700], b"text that is no media file at all"])
def test_media_damage(damage):
    assert media.probe(damage)["error"] and media.probe(damage)["tracks"] == []


def test_line_dedup(spark, docs, empty):
    blanks = " \t\n\x0b\f\r"
    key = lambda line: line.strip(blanks).translate(str.maketrans(line_dedup.UPPER, line_dedup.LOWER))
    held = defaultdict(set)
    for i, t, _ in ROWS:
        for line in (t or "").split("\n"):
            held[key(line)].add(i)
    common = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(k) >= 40 and len(v) >= 5}
    assert common
    want = Counter()
    for i, t, _ in ROWS:
        lines = (t or "").split("\n")
        kept = [line for line in lines if key(line) not in common or common[key(line)] == i]
        want[i, len(lines), len(lines) - len(kept), "\n".join(kept)] += 1
    got = Counter(tuple(r) for r in line_dedup.drop_common_lines(docs).select("doc_id", "n_lines", "n_dropped", "text").collect())
    assert got == want
    assert line_dedup.drop_common_lines(empty).count() == 0


def test_licenses(spark, docs, empty):
    known = licenses.known_licenses(spark)
    got = {(r["doc_id"], r["license_id"]) for r in licenses.find_licenses(docs, known).collect()}
    assert (11, "MIT") in got and (8, None) in got and (4, None) in got and (9, None) in got
    assert licenses.find_licenses(docs, known).count() == len(ROWS)
    assert licenses.find_licenses(empty, known).count() == 0
    assert {r["license_id"] for r in licenses.find_licenses(docs, known.where("false")).collect()} == {None}
    mit = next(t for n, t in licenses.known_texts() if n == "MIT")
    changed = "Copyright (c) 2020 Some One\n\n" + mit.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;")
    assert licenses.find_licenses(make(spark, [(1, changed, "a")]), known).first()["license_id"] == "MIT"


def brute_components(rows, n, threshold):
    sets = []
    for i, t, _ in rows:
        words = (t or "").encode().lower().split()
        sets.append((i, {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else {tuple(words)} if words else set()))
    label = list(range(len(sets)))
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and len(x & y) * threshold.denominator >= threshold.numerator * len(x | y):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = [new if v == old else v for v in label]
    least = {}
    for (i, _), v in zip(sets, label, strict=True):
        if i is not None:
            least[v] = min(least.get(v, i), i)
    return Counter((i, len(s), least.get(v) if s else i) for (i, s), v in zip(sets, label, strict=True))


@pytest.mark.parametrize(("n", "threshold"), [(3, Fraction(9, 10)), (5, Fraction(4, 5)), (1, Fraction(1, 2))])
def test_ngram_jaccard(spark, docs, empty, n, threshold):
    import random

    rng = random.Random(n)
    words = [f"w{k}" for k in range(300)]
    rows = list(ROWS)
    for i in range(20, 120):
        base = rng.choice(rows[13:])[1].split() if i > 40 and rng.random() < 0.8 else [rng.choice(words) for _ in range(rng.randint(2, 60))]
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base), "z"))
    got = Counter(tuple(r) for r in ngram_jaccard.components(make(spark, rows), n, threshold).collect())
    assert got == brute_components(rows, n, threshold)
    if n == 3:
        assert ngram_jaccard.components(empty, n, threshold).count() == 0
        kept = ngram_jaccard.keep_one(docs, n, threshold)
        assert kept.columns == docs.columns
        assert sorted(r["doc_id"] for r in kept.collect() if r["doc_id"] is not None) == [1, 4, 5, 6, 7, 8, 9, 10, 11]


@pytest.mark.parametrize("threshold", [Fraction(9, 10), Fraction(4, 5), Fraction(1, 2)])
def test_linked_sets_share_a_bundle(threshold):
    """Sets that are linked, but only just, meet in a bundle that not only guests hold."""
    rng, levels, pairs = np.random.default_rng(7), ngram_jaccard.Levels(threshold), 0
    for size in range(1, 41):
        for other in range(size, int(size / threshold) + 1):
            both = -(-threshold.numerator * (size + other) // (threshold.numerator + threshold.denominator))
            if both > size:
                continue
            for _ in range(10):
                tokens = np.unique(rng.integers(0, 1 << 63, size + other - both, dtype=np.uint64))
                rng.shuffle(tokens)
                a, b = np.sort(tokens[:size]), np.sort(tokens[size - both :])
                shown = [{v >> 1: v & 1 for v in ngram_jaccard.bundles(s, levels).tolist()[::-1]} for s in (a, b)]
                assert any(not (shown[0][v] and shown[1][v]) for v in shown[0].keys() & shown[1].keys()), (size, other)
                pairs += 1
    assert pairs > 500


def test_near_copies_in_chunks(spark, monkeypatch):
    """A group larger than a chunk, in which only neighbours link."""
    monkeypatch.setattr(ngram_jaccard, "CHUNK_DOCS", 4)
    words = [f"v{k}" for k in range(200)]
    rows = [(i, " ".join(words[4 * i : 4 * i + 60]), "a") for i in range(30)]
    got = Counter(tuple(r) for r in ngram_jaccard.components(make(spark, rows), 2, Fraction(4, 5)).collect())
    assert got == brute_components(rows, 2, Fraction(4, 5))


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_decontamination(spark, docs, empty):
    item = "The quick brown fox jumps over the lazy dog while seventeen grey herons watch from the river bank"
    near = item.replace("quick", "quikc").replace("herons", "heron").upper()
    rows = [(1, "before " + item + " after", "a"), (2, "x " * 50 + near + "\n" + "y " * 50, "a"), (3, "the quick brown fox jumps over a lazy cat", "b"), (4, None, "b"), (5, "", "c"), (1, "before " + item + " after", "a")]
    table = bench(spark, [(1, item), (2, None), (3, ""), (4, item), (5, "?!")])
    found = decontamination.matches(make(spark, rows), table)
    assert Counter((r["doc_id"], r["item_id"], r["distance"]) for r in found.collect()) == Counter({(1, 1, 0): 2, (1, 4, 0): 2, (2, 1, 3): 1, (2, 4, 3): 1})
    kept = decontamination.decontaminated(make(spark, rows), table)
    assert sorted(r["doc_id"] for r in kept.collect()) == [3, 4, 5]
    for none in (table.where("false"), bench(spark, [(1, None)])):
        assert decontamination.matches(docs, none).count() == 0
        assert decontamination.decontaminated(docs, none).count() == len(ROWS)
    assert decontamination.matches(empty, table).count() == 0


def test_edit_matching_is_exact():
    import random

    rng = random.Random(1)

    def nearest(pattern, text):
        row = [0] * (len(text) + 1)
        for i, p in enumerate(pattern, 1):
            new = [i]
            for j, c in enumerate(text, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
            row = new
        return min(row)

    for _ in range(200):
        item = "".join(rng.choice("abc ") for _ in range(rng.randint(4, 60)))
        form = decontamination.normalised(item)
        if not form:
            continue
        changed = list(form)
        for _ in range(rng.randint(0, 9)):
            changed[rng.randrange(len(changed))] = rng.choice(["", "a", "bb", "c"])
        text = "".join(rng.choice("abc ") for _ in range(40)) + "".join(changed) + "cab"
        budget, distance = int(0.15 * len(form)), nearest(form, decontamination.normalised(text))
        found = decontamination.Matcher([(1, item)], 0.15).find(text)
        assert [d for _, d, _ in found] == ([distance] if distance <= budget else [])


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 30)
    items = [(k, f"item number {k} with words of its own {k * 7919}") for k in range(5)]
    rows = [(k, "text and " + t, "a") for k, t in items]
    found = decontamination.matches(make(spark, rows), bench(spark, items), rate=0.0)
    assert sorted((r["doc_id"], r["item_id"]) for r in found.collect()) == [(k, k) for k in range(5)]
    assert decontamination.decontaminated(make(spark, rows), bench(spark, items), rate=0.0).count() == 0


def test_mixing(spark, docs, empty):
    counts = mixing.mix_counts(docs)
    rows = counts.collect()
    assert len(rows) == len(ROWS)
    assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len((t or "").split())) for i, t, _ in ROWS)
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert sorted(map(tuple, rows), key=repr) == sorted(map(tuple, mixing.mix_counts(docs.repartition(5)).collect()), key=repr)
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and out.count() == sum(r["copies"] for r in rows)
    assert mixing.mix_counts(empty).count() == 0 and mixing.mixed(empty).count() == 0


def test_targets():
    found = mixing.fill_targets({"sa": 100, "sb": 100, "n": 100, "sc": 0})
    assert found == {"sa": 187.5, "sb": 75.0, "sc": 0.0, "n": 37.5} or abs(sum(found.values()) - 300) < 1e-9
    small = mixing.fill_targets({"sa": 10, "sb": 1000})
    assert small == {"sa": 30.0, "sb": 980.0}


def test_mixing_meets_targets(spark):
    rows = [(i, "w " * (1 + i * 37 % 90), "abc"[i % 3]) for i in range(600)]
    got = mixing.mix_counts(make(spark, rows)).collect()
    source = {i: s for i, _, s in rows}
    for s in "abc":
        mine = [r for r in got if source[r["doc_id"]] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 90


def test_quality(spark, docs, empty):
    rows = [(i, "good plain words in a row number " + "abcdefghij"[i % 10] * 5 if i % 2 else "BAD!! BAD!! $$$ ### " * 5, "a") for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(999, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    model = quality.fit(make(spark, rows), labels)
    got = {r["doc_id"]: r["score"] for r in quality.scores(make(spark, rows), model).collect()}
    assert all((got[i] >= 0.7) == bool(i % 2) for i in range(80))
    edge = quality.scores(docs, model).collect()
    assert len(edge) == len(ROWS) and all(0 <= r["score"] <= 1 for r in edge)
    assert quality.scores(empty, model).count() == 0
    kept = quality.keep_good(make(spark, rows), model)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == list(range(1, 80, 2))
    assert quality.fit(docs, labels.where("false")) is None
    assert {r["score"] for r in quality.scores(docs, None).collect()} == {0.5}


def test_held_out_accuracy(spark):
    from tessera.llm import registry

    sf_dir = "/root/testdata/sf0.01"
    rows = registry.op8_quality(spark, sf_dir).where("held_out").join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) >= 0.9 * len(rows)


def test_sharding(spark, docs, empty):
    store = sharding.shard(docs, fresh_path(spark, "test-shards"))
    rows = lambda df: Counter(map(tuple, df.select(*docs.columns).collect()))
    assert rows(store.read()) == rows(docs)
    first = store.version()
    for k in range(5):
        store.append(make(spark, [(100 + k, f"arrival {k}", "z")]))
    assert len(store.shards()) >= 6
    store.compact(full=True)
    assert len(store.shards()) == 1 and store.read().count() == len(ROWS) + 5 and store.version() > first
    assert set(store.read_with_shard().columns) == {*docs.columns, "shard", "manifest_version"}
    with pytest.raises(sharding.Conflict):
        store.commit(first, [])
    none = sharding.shard(empty, fresh_path(spark, "test-shards"))
    assert none.read().count() == 0 and none.read_with_shard().count() == 0 and none.read().columns == docs.columns


def test_size_tiers():
    shard = lambda size, k=0: {"path": f"p{size}-{k}", "bytes": size, "rows": 1}
    small = [shard(1000, k) for k in range(3)]
    assert sharding.plan(small) == []
    assert sharding.plan([*small, shard(1000, 9)]) == [[*small, shard(1000, 9)]]
    assert sharding.plan([*small, shard(40 << 20), shard(sharding.TARGET_BYTES)]) == []
    merged = sharding.plan([shard(30 << 20, k) for k in range(9)])
    assert [len(g) for g in merged] == [4, 4]
