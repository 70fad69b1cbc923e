"""Queries of the training-data operators, one ``opN_`` for each, with production parameters and whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from fractions import Fraction

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import clustering, decontamination, licenses, line_dedup, media, mixing, ngram_jaccard, quality, sharding, token_counts, token_files, url_filters, whitening
from tessera.session import fresh_path, table

#: op10: texts with more tokens are marked.
TOKEN_LIMIT = 4096


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    store = sharding.shard(docs, fresh_path(spark, "shards"))
    shards = store.shards()
    return store.read().select(
        "doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"),
        F.lit(len(store.appended)).alias("n_appends"), F.lit(sum(store.appended)).cast("bigint").alias("appended_rows"),
        F.lit(sum(s["rows"] for s in shards)).cast("bigint").alias("manifest_rows"), F.lit(max((s["merged"] for s in shards), default=0) >= 2).alias("merged_again"),
    )


#: The store's own counts and whether merged shards were merged again stand beside the rows.
OP2_SQL = f"""SELECT doc_id, lang, source, n_chars, sha256(text) AS text_sha256, {sharding.ARRIVALS} AS n_appends, count(*) OVER () AS appended_rows,
count(*) OVER () AS manifest_rows, true AS merged_again FROM documents"""


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard.components(table(spark, sf_dir, "documents"), n=3, threshold=Fraction(90, 100))


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.stored_digests(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_common_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_STRIPPED = "regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g')"
OP6_SQL = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT doc_id, pos, line, translate({_STRIPPED}, '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key FROM lines
), common AS (
  SELECT key, max(doc_id) AS keep FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT k.doc_id, k.pos, k.line, c.key IS NOT NULL AND k.doc_id <> c.keep AS gone FROM keyed k LEFT JOIN common c ON k.key = c.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, quality.training_rows(table(spark, sf_dir, "labels")))
    found = quality.scores(docs, model)
    return found.select("doc_id", quality.held_out().alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.find_licenses(table(spark, sf_dir, "documents"), licenses.known_licenses(spark))


def _plain_form(text: str) -> str:
    """The canonical form of a known licence, word by word: the SQL's own way to it."""
    lines = []
    for line in text.translate(str.maketrans(licenses.UPPER, licenses.LOWER)).split("\n"):
        bare = line.lstrip(" \t*#/;-")
        word, _, rest = bare.partition("copyright")
        owned = not word and (rest[:1] in " \t" and rest.lstrip(" \t")[:3] == "(c)" or rest.lstrip(" \t")[:1] == "©" or rest[:1] in " \t" and rest.lstrip(" \t")[:4].isdigit() and len(rest.lstrip(" \t")) >= 4)
        owned = owned or bare.startswith("©") or bare.startswith("(c)") and len(bare[3:].lstrip(" \t")) >= 4 and bare[3:].lstrip(" \t")[:4].isdigit()
        while bare and not bare[-1].isalnum():
            bare = bare[:-1]
        if not owned and bare != "all rights reserved":
            lines.append(line)
    words = "".join(c if c.isalnum() else " " for c in "\n".join(lines).replace("(c)", " copyright ").replace("©", " copyright ")).split()
    form = f" {' '.join(words)} "
    for old, new in licenses.SPELLINGS:
        while f" {old} " in form:
            form = form.replace(f" {old} ", f" {new} ")
    return form.strip()


def _op9_sql() -> str:
    digests = sorted({(hashlib.sha256(_plain_form(text).encode()).hexdigest(), name) for name, text in licenses.known_texts()})
    values = ", ".join(f"('{digest}', '{name}')" for digest, name in digests)
    return f"""
WITH known AS (SELECT digest, min(license_id) AS license_id FROM (VALUES {values}) v(digest, license_id) GROUP BY digest),
forms AS (SELECT doc_id, {licenses.canonical_sql('text')} AS form FROM documents),
digests AS (SELECT doc_id, CASE WHEN form <> '' THEN sha256(form) END AS digest FROM forms)
SELECT d.doc_id, d.digest, k.license_id FROM digests d LEFT JOIN known k ON d.digest = k.digest
"""


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


#: op11: entries become floor(scale * c) + offset; so many components are given.
WHITENING = {"scale": 1024, "offset": 100_000, "components": 8}


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"), **WHITENING)


#: op12: (host, path, verdict).
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def op12_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filters.judge(table(spark, sf_dir, "pages"), rules)


OP12_SQL = f"""
WITH rules(host, path, verdict) AS (VALUES {", ".join(str(r) for r in URL_RULES)}),
split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), urls AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{url_filters.UPPER}', '{url_filters.LOWER}') AS host,
         regexp_extract(regexp_replace(rest, '^[^/?#]*', ''), '^[^?#]*') AS path FROM split
), fits AS (
  SELECT u.page_id, u.host, u.path, r.host || r.path AS rule, r.verdict,
         row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host || r.path) DESC NULLS LAST) AS n
  FROM urls u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM fits WHERE n = 1
"""

#: op13: 40 centroids, five rounds, on floor(256 * x) of vectors of 64 components; the first are drawn with salt 2.
CLUSTERING = {"k": 40, "rounds": 5, "scale": 256, "dim": 64, "salt": "2"}


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.cluster(table(spark, sf_dir, "embeddings"), **CLUSTERING)


def _op13_sql() -> str:
    c = CLUSTERING
    parts = [f"""kept AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor({c['scale']} * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {c['dim']} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {c['dim']}
), c0 AS (
  SELECT row_number() OVER (ORDER BY sha256('{c['salt']}:' || vec_id)) - 1 AS c, v FROM kept QUALIFY c < {c['k']}
)"""]  # fmt: skip
    near = """SELECT vec_id, any_value(v) AS v, min(struct_pack(d := d, c := c)) AS m FROM (
  SELECT k.vec_id, k.v, c.c, CAST(list_sum(list_transform(list_zip(k.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS d FROM kept k CROSS JOIN c{} c
) GROUP BY vec_id"""
    for r in range(c["rounds"]):
        parts.append(f"a{r} AS MATERIALIZED ({near.format(r)})")
        parts.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT o.c, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN (
    SELECT c, list(f ORDER BY i) AS v FROM (
      SELECT c, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS f FROM (
        SELECT m.c AS c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{r}, generate_series(1, {c['dim']}) g(i) GROUP BY ALL)
    ) GROUP BY c
  ) n ON o.c = n.c)""")
    last = c["rounds"]
    return f"""WITH {", ".join(parts)}, last AS ({near.format(last)})
SELECT vec_id, CAST(m.c AS INT) AS cluster, m.d AS distance, CAST(sum(m.d) OVER (PARTITION BY m.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(m.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM last JOIN c{last} c ON c.c = m.c"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_token_files": op1_token_files,
        "op2_sharding": op2_sharding,
        "op3_mixing": op3_mixing,
        "op4_ngram_jaccard": op4_ngram_jaccard,
        "op5_media": op5_media,
        "op6_line_dedup": op6_line_dedup,
        "op7_decontamination": op7_decontamination,
        "op8_quality": op8_quality,
        "op9_licenses": op9_licenses,
        "op10_token_counts": op10_token_counts,
        "op11_whitening": op11_whitening,
        "op12_url_filters": op12_url_filters,
        "op13_clustering": op13_clustering,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_sharding": OP2_SQL, "op6_line_dedup": OP6_SQL, "op9_licenses": _op9_sql(), "op12_url_filters": OP12_SQL, "op13_clustering": _op13_sql()}
