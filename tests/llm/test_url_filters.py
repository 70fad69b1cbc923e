"""The Bloom filter cascade against a plain search of the longest rule."""

import hashlib
import random

import numpy as np
import pytest

from tessera.llm import url_filters

SCHEMA = "page_id bigint, url string, html string, host string, keys string, found int, at bigint, mark binary"
RULES = "host string, path string, verdict string, note string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "x", "x", "x", 1, 2, b"x") for i, u in urls], SCHEMA)


def rules(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], RULES)


def plain(url, listed):
    mark = (url or "").find("://")
    rest = url[mark + 3 :] if mark >= 0 else ""
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = host.translate(str.maketrans(url_filters.UPPER, url_filters.LOWER))
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in listed if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, key=lambda f: (f[:3], f[3] == "block"), default=(0, 0, None, "allow"))
    return host, path, best[2], best[3]


def judged(spark, urls, listed, **options):
    got = url_filters.judge(pages(spark, urls).repartition(4), rules(spark, listed), **options).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(((i, *plain(u, listed)) for i, u in urls), key=repr)


def random_case(n, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "c", "com", "net", "www", "é", ""])
    host = lambda: ".".join(label() for _ in range(rng.randint(1, 4))) or "x"
    path = lambda: "".join(rng.choice(["/", "/a", "/b/", "/é", "/a/b"]) for _ in range(rng.randint(0, 3)))
    urls = [(i, f"http{rng.choice(['', 's'])}://{rng.choice([host(), host().upper()])}{path()}{rng.choice(['', '?q=/a', '#t', '?', 'x'])}") for i in range(n)]
    listed = {(host(), path()): rng.choice(["allow", "block"]) for _ in range(n // 4)}
    return urls, [(h.lower(), p, v) for (h, p), v in listed.items()]


AWKWARD = [
    (1, None), (2, ""), (3, "no scheme"), (4, "://"), (5, "http://"), (6, "http:///path"), (7, "http://COM/"), (8, "http://com"), (9, "http://x.com/a://b"), (9, "http://x.com/a://b"),
    (None, "http://user@x.com:80/en/"), (10, "http://x.com?en/"), (11, "http://x.com#/en/"), (12, "http://xcom/"), (13, "http://" + "a." * 3000 + "com/" + "en/" * 30_000), (14, "a b\nhttp://X.com/\nen/ c"),
]
FEW = [("com", "/", "allow"), ("x.com", "/", "block"), ("x.com", "/a", "allow"), ("com", "/en/en/", "block"), ("net", "", "block")]


@pytest.mark.parametrize("bytes_", [url_filters.MAX_BYTES, 0])
def test_urls(spark, bytes_):
    judged(spark, AWKWARD, FEW, max_bytes=bytes_)
    urls, listed = random_case(2000, 4)
    judged(spark, urls + AWKWARD, listed, max_bytes=bytes_)
    judged(spark, [], FEW, max_bytes=bytes_)
    judged(spark, AWKWARD, [], max_bytes=bytes_)


def test_hot_host(spark):
    judged(spark, [(i, f"http://www.hot.example.com/{'en' if i % 3 else 'es'}/{i}") for i in range(3000)], [("hot.example.com", "/en/", "block"), ("com", "/", "allow"), ("example.com", "/en/7", "block")])


def test_rules_are_checked(spark):
    with pytest.raises(ValueError):
        url_filters.judge(pages(spark, AWKWARD), rules(spark, [("com", "/", "perhaps")]))
    with pytest.raises(ValueError):
        url_filters.judge(pages(spark, AWKWARD), rules(spark, [(None, "/", "block")]))
    both = url_filters.judge(pages(spark, [(1, "http://com/")]), rules(spark, [("com", "/", "allow"), ("COM", "/", "block")]))
    assert both.first()["verdict"] == "block"


def test_cascade_is_exact_over_its_universe(spark):
    digest = lambda i: hashlib.sha256(str(i).encode()).digest()
    frame = lambda ids: spark.createDataFrame([(digest(i),) for i in ids], "mark binary")
    listed, others = range(500), range(500, 8000)
    # others stand there more than once and some of them are listed, as keys of a corpus are
    found = url_filters.cascade(frame(listed), frame([*others, *others, *range(100)]), 500, 7500)
    assert len(found.levels) >= 3 and sum(x.size for x in found.levels) / 8 < 500 * 8
    words = np.frombuffer(b"".join(digest(i) for i in range(8000)), "<u8").reshape(-1, 4)
    assert (found.listed(words) == (np.arange(8000) < 500)).all()


def test_no_level_beyond_the_bound(spark):
    marks = spark.range(2000).selectExpr("unhex(sha2(string(id), 256)) AS mark")
    assert url_filters.cascade(marks, marks.limit(0), 2000, 10**9, max_bytes=4096) is None
