"""Mixing sources to target weights by entropy balancing.

A document's rate r is its expected number of copies. Among all rates between 0 and ``MAX_COPIES`` that meet the
token constraint of their source (sum of size * r = target), entropy balancing takes those closest to 1 in relative
entropy. The dual has one variable a source and gives exponentially tilted rates r = min(MAX_COPIES,
exp(lambda * size / mean size)); it is solved for all sources at once by Newton iterations, each one distributed
aggregation. The iterations run over exact counts by (source, size), which are all that the dual needs, and their
sums are exact decimals, so reruns agree whatever the order of rows. The driver holds a few numbers for each source.

Rates become whole copies by error diffusion: from the largest size down, the copies of all documents of one source
and size are rounded together and the words left over go to the next size, so a source misses its target by less
than its small documents. A source has at most sqrt(2 * its words) different sizes, which bounds the rows of that
step whatever the number of documents. Within one (source, size), base copies go to all and the rest to the
documents of smallest hash; ranks are taken in about sqrt(n) hash buckets with running counts of buckets, so no task
gets more than about sqrt(n) of them.

Cases: null and empty texts have size 0, take no words and keep one copy; a null source is a source of its own and
the last; one source, a source without words and an empty table work; ties in size are broken by hash of id and
text, so equal rows share copies in a fixed total (rows that differ in other columns by a hash of all of them); extra columns pass through ``mixed`` and are left out of
``mix_counts``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.session import cut, row_hash

WEIGHTS = (5.0, 2.0, 1.0)
MAX_COPIES = 3
WORD = "[^\\x20\\x09-\\x0D]+"
#: Newton iterations stop when every source is this near its target; more than so many are an error. Bisection alone, the
#: fallback of a step, needs about 60 to use up a double.
TOLERANCE, MAX_ITERATIONS = 1e-7, 120


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(WORD)).cast("bigint")


def _key(source: Column) -> Column:
    """A join key that is never null and keeps null apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), source.cast("string")), F.lit("n"))


def fill_targets(sizes: dict[str, int], weights: Sequence[float] = WEIGHTS, most: float = MAX_COPIES) -> dict[str, float]:
    """Target words by source key; weights repeat along the sources by code point, null last.

    Targets share all words by weight; one above ``most`` times its source's size stops there and the excess is
    shared again by weight among the others, until none is above.
    """
    order = sorted(sizes, key=lambda k: (k == "n", k))
    weight = {k: weights[i % len(weights)] for i, k in enumerate(order)}
    targets: dict[str, float] = {}
    left, open_ = float(sum(sizes.values())), list(order)
    while open_:
        share = left / sum(weight[k] for k in open_)
        full = [k for k in open_ if share * weight[k] > most * sizes[k]]
        if not full:
            targets |= {k: share * weight[k] for k in open_}
            break
        for k in full:
            targets[k] = float(most * sizes[k])
            left -= targets[k]
        open_ = [k for k in open_ if k not in targets]
    return targets


def solve_dual(cells: DataFrame, sizes: dict[str, int], counts: dict[str, int], targets: dict[str, float], most: float = MAX_COPIES) -> dict[str, float]:
    """lambda / mean size by source key. ``cells``: (key, size, n), one row for each source and size."""
    spark = cells.sparkSession
    mean = {k: sizes[k] / counts[k] for k in sizes if sizes[k]}
    tilt = {k: 0.0 for k in mean}
    low, high = {k: -math.inf for k in mean}, {k: math.inf for k in mean}
    todo = {k for k in mean if 0 < targets[k] < most * sizes[k]}
    tilt |= {k: math.inf for k in mean if targets[k] >= most * sizes[k]} | {k: -math.inf for k in mean if targets[k] <= 0}
    for _ in range(MAX_ITERATIONS):
        if not todo:
            break
        state = spark.createDataFrame([(k, tilt[k] / mean[k]) for k in sorted(todo)], "key string, slope double")
        rate = F.exp(F.least(F.col("slope") * F.col("size"), F.lit(math.log(most))))
        words = F.col("n") * F.col("size")
        inside = F.col("slope") * F.col("size") < math.log(most)
        exact = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
        sums = cells.join(state, "key").groupBy("key").agg(exact(words * rate).alias("f"), exact(F.when(inside, words * rate * F.col("size")).otherwise(0.0)).alias("g"))
        for key, f, g in sums.collect():
            miss = f - targets[key]
            if abs(miss) <= TOLERANCE * targets[key]:
                todo.discard(key)
                continue
            if miss > 0:
                high[key] = tilt[key]
            else:
                low[key] = tilt[key]
            step = tilt[key] - miss / (g / mean[key]) if g > 0 else math.nan
            if not low[key] < step < high[key]:  # Newton left the bracket: halve it, or widen its open side
                a, b = low[key], high[key]
                step = (a + b) / 2 if math.isfinite(a) and math.isfinite(b) else tilt[key] + (1 if b == math.inf else -1) * max(1.0, abs(tilt[key]))
            tilt[key] = step
    else:
        if todo:
            raise RuntimeError(f"entropy balancing did not settle for the sources {sorted(todo)}")
    return {k: t / mean[k] if math.isfinite(t) else t for k, t in tilt.items()}


def _round_source(cells: pd.DataFrame, most: int) -> pd.DataFrame:
    """Whole copies of each (source, size): rounded from the largest size down, the words left over carried on."""
    cells = cells.sort_values("size", ascending=False, ignore_index=True)
    carry, copies = 0.0, []
    for size, n, slope in zip(cells["size"], cells["n"], cells["slope"], strict=True):
        rate = 1.0 if not size else most if slope == math.inf else 0.0 if slope == -math.inf else math.exp(min(math.log(most), slope * size))
        want = n * rate * size + carry
        got = min(most * n, max(0, math.floor(want / size + 0.5))) if size else n
        carry = want - got * size
        copies.append(got)
    cells["base"] = [c // n for c, n in zip(copies, cells["n"], strict=True)]
    cells["more"] = [c % n for c, n in zip(copies, cells["n"], strict=True)]
    return cells[["key", "size", "n", "base", "more"]]


def mix_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """``id_col``, ``text_hash``, ``source_key``, size, source_size, target, copies and taken (copies * size) of every row.

    Exchanges carry a few numbers a row: sizes are counted in one pass over the texts and written first.
    """
    spark = docs.sparkSession
    rows = cut(docs.select(F.col(id_col).alias("id"), _key(F.col(source_col)).alias("key"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text_hash")), "mix-sizes")
    cells = cut(rows.groupBy("key", "size").agg(F.count(F.lit(1)).alias("n")), "mix-cells")
    totals = cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("words"), F.sum("n").alias("n")).collect()
    sizes, counts = {r.key: int(r.words) for r in totals}, {r.key: int(r.n) for r in totals}
    targets = fill_targets(sizes, weights, most)
    slopes = solve_dual(cells, sizes, counts, targets, most)
    state = spark.createDataFrame([(k, sizes[k], targets[k], slopes.get(k, 0.0)) for k in sorted(sizes)], "key string, source_size bigint, target double, slope double")
    rounded = cells.join(state.select("key", "slope"), "key").groupBy("key").applyInPandas(lambda cells: _round_source(cells, most), "key string, size bigint, n bigint, base bigint, more bigint")
    h = F.xxhash64("id", "text_hash")
    dealt = (
        rows.join(cut(rounded, "mix-rounded"), ["key", "size"])
        .withColumn("h", h)
        .withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.sqrt("n")).cast("bigint")))
    )
    buckets = dealt.where("more > 0").groupBy("key", "size", "bucket").agg(F.count(F.lit(1)).alias("here"))
    upto = Window.partitionBy("key", "size").orderBy("bucket")
    before = buckets.withColumn("before", F.sum("here").over(upto) - F.col("here")).select("key", "size", "bucket", "before")
    rank = F.row_number().over(Window.partitionBy("key", "size", "bucket").orderBy("h", "id", "text_hash"))
    ranked = dealt.withColumn("rank", rank).join(before, ["key", "size", "bucket"], "left")
    copies = (F.col("base") + (F.coalesce(F.col("before"), F.lit(0)) + F.col("rank") <= F.col("more")).cast("bigint")).alias("copies")
    out = ranked.select("id", "text_hash", "key", "size", copies).join(state.drop("slope"), "key")
    return out.select(F.col("id").alias(id_col), "text_hash", F.col("key").alias("source_key"), "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, most: int = MAX_COPIES) -> DataFrame:
    """The mix itself: each row of ``docs`` as often as its copies say, with the columns of ``docs``."""
    counts = (
        mix_counts(docs, id_col, text_col, source_col, weights, most)
        .groupBy(F.col(id_col).alias("__id"), F.col("text_hash").alias("__h"), F.col("source_key").alias("__key"))
        .agg(F.sum("copies").alias("__copies"), F.count(F.lit(1)).alias("__rows"))
    )
    rows = docs.withColumns({"__h2": F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), "__key2": _key(F.col(source_col))})
    joined = rows.join(counts, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__h2") == F.col("__h")) & (F.col("__key2") == F.col("__key")))
    # rows that repeat id, text and source share their copies: the first ones take what doesn't divide
    nth = F.when(F.col("__rows") > 1, F.row_number().over(Window.partitionBy("__id", "__h", "__key").orderBy(row_hash(docs)))).otherwise(1)
    own = F.floor(F.col("__copies") / F.col("__rows")) + (nth <= F.col("__copies") % F.col("__rows")).cast("bigint")
    return joined.withColumn("__own", own).where("__own > 0").withColumn("__i", F.explode(F.sequence(F.lit(1), F.col("__own").cast("int")))).select(*docs.columns)
