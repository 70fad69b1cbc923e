"""The pipeline, the driver's contract and the SQL of the training-data queries."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
import pyarrow as pa
from tessera.llm import quality, registry

from .test_models import plain_copies, plain_targets

SF = "/root/testdata/sf0.001"


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {*docs.columns, "shard", "manifest_version"} == set(out.columns)
    assert rows and all(texts[r.doc_id] == r.text for r in rows)
    counts = {i: sum(r.doc_id == i for r in rows) for i in {r.doc_id for r in rows}}
    assert max(counts.values()) <= 3
    items = [re.sub(r"[\W_]+", " ", r.text.lower()).strip() for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [re.sub(r"[\W_]+", " ", texts[i].lower()) for i in counts]
    assert not any(item in text for item in items for text in kept)


def test_clean_documents_stay(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1")
    kept = corpus_pipeline.quality_stage(spark, docs, SF).join(labels, "doc_id", "left_semi").count()
    assert kept >= 0.95 * docs.join(labels, "doc_id", "left_semi").count()


def test_registry():
    names = registry.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in names) == list(range(1, 11))
    assert set(registry.oracle_sql()) <= set(names)


def nearest_stretch(pattern, text):
    """Least edit distance of a pattern to any stretch of a text, by the whole matrix."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != c)))
        row = new
    return min(row)


def fixture(rng):
    """Documents with junk, near and exact copies, changed benchmark items and empty texts; labels; benchmark."""
    words = [f"{a}{b}" for a in ("ta", "re", "mo", "li", "su", "ne", "ka") for b in ("ran", "vel", "dor", "min", "sto", "pel", "gar", "hin")]
    sentence = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, sentence(24)) for k in range(3)]
    rows = [(i, sentence(rng.randint(20, 70)), rng.choice(["a", "a", "b", None])) for i in range(60)]
    rows += [(100 + i, " ".join(["$$$", "!!", "BUY", "%%%", "NOW!!!"][rng.randrange(5)] for _ in range(40)) + f" {i}", "a") for i in range(30)]
    for k in range(12):  # one word of a long text changed: linked; half of a text: not
        base = rows[k][1].split()
        base[len(base) // 2] = "other"
        rows.append((200 + k, " ".join(base), "b"))
        rows.append((300 + k, " ".join(rows[20 + k][1].split()[: 8]) + " " + sentence(30), "a"))
    rows += [(400, rows[3][1], "b"), (401, None, "a"), (402, "", "a"), (403, rows[5][1].upper(), "a")]
    for k, item in items:
        changed = item.split()
        changed[5] = "zzz"
        rows += [(500 + k, sentence(15) + " " + item + " " + sentence(9), "b"), (510 + k, sentence(9) + ", " + " ".join(changed).upper() + "! " + sentence(9), "a")]
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 30, 2)]
    return rows, labels, items


def test_pipeline_against_a_model_of_its_stages(spark, tmp_path):
    rows, labels, items = fixture(random.Random(9))
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    # 1. quality: every vote by a full sort of all cosines
    model = quality.fit(docs, quality.training_rows(spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")))

    def score(text):
        mine = quality._unit(quality._weighted(quality.terms(pa.array([text], pa.string())), model.idf) @ model.axes)[0]
        near = sorted(((float(mine @ p), -k) for k, p in enumerate(model.points)), reverse=True)[: quality.NEIGHBOURS]
        votes = [(max(c, 0) ** quality.SHARPNESS * model.votes[-k], model.labels[-k]) for c, k in near]
        total = sum(w for w, _ in votes)
        return sum(w * y for w, y in votes) / total if total > 1e-12 else model.share

    good = [r for r in rows if score(r[1]) >= quality.THRESHOLD]
    assert {r[0] for r in rows} - {r[0] for r in good} >= set(range(100, 130)) and {r[0] for r in good} >= set(range(60))
    # 2. near duplicates: all pairs
    shingled = []
    for i, t, _ in good:
        w = (t or "").lower().split()
        shingled.append((i, {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()))
    label = {i: i for i, _ in shingled}
    for i, x in shingled:
        for j, y in shingled:
            if i < j and x and y and len(x & y) * 5 >= 4 * len(x | y):
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = {k: new if v == old else v for k, v in label.items()}
    unique = [r for r in good if label[r[0]] == r[0]]
    assert not {400, 403} & {r[0] for r in unique} and len(good) - len(unique) >= 5
    # 3. decontamination: whole matrices
    form = lambda t: f" {x} " if (x := re.sub(r"[\W_]+", " ", (t or "").lower()).strip()) else ""
    clean = [r for r in unique if not any(nearest_stretch(form(t), form(r[1])) <= int(0.12 * len(form(t))) for _, t in items if form(r[1]))]
    assert {r[0] for r in unique} - {r[0] for r in clean} >= {500, 501, 502, 510, 511, 512}
    # 4. mixing: copies of each source and size; 5. sharding keeps the rows
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    text = {i: t for i, t, _ in rows}
    copies = Counter(r["doc_id"] for r in out)
    assert set(copies) <= {r[0] for r in clean} and all(r["text"] == text[r["doc_id"]] for r in out)
    by_source = defaultdict(list)
    for i, t, s in clean:
        by_source[s].append((len((t or "").split()), i))
    targets = plain_targets({s: sum(n for n, _ in v) for s, v in by_source.items()})
    for s, mine in by_source.items():
        want = plain_copies([n for n, _ in mine], targets[s])
        for size in want:
            each = [copies[i] for n, i in mine if n == size]
            assert sum(each) == want[size] and max(each) - min(each) <= 1
    assert all(r["shard"].endswith(".parquet") and r["manifest_version"] >= 1 for r in out)
