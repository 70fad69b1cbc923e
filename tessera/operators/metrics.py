"""Answer and retrieval metrics. Predictions: question_id, prediction, golds (array), any_relevant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T


def hits_at_1(prediction: Column, golds: Column) -> Column:
    form = T.normalize_answer(prediction)
    return F.exists(golds, lambda g: (T.normalize_answer(g) != "") & F.contains(form, T.normalize_answer(g))).cast("double")


def exact_match(prediction: Column, golds: Column) -> Column:
    return F.exists(golds, lambda g: T.normalize_answer(g) == T.normalize_answer(prediction)).cast("double")


def _overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two token arrays."""
    count = lambda xs, w: F.size(F.filter(xs, lambda x: x == w))
    return F.aggregate(F.transform(F.array_distinct(a), lambda w: F.least(count(a, w), count(b, w))), F.lit(0), lambda s, n: s + n)


def token_f1(prediction: Column, golds: Column) -> Column:
    """The best token F1 over the golds; two answers without tokens agree."""

    def f1(mine: Column, theirs: Column) -> Column:
        def of(same: Column) -> Column:
            p, r = same / F.size(mine), same / F.size(theirs)
            return F.when(same == 0, 0.0).otherwise(2 * p * r / (p + r))

        none = (F.size(mine) == 0) | (F.size(theirs) == 0)
        return F.when(none, (F.size(mine) == F.size(theirs)).cast("double")).otherwise(T.let(_overlap(mine, theirs), of))

    tokens = F.transform(golds, T.answer_tokens)
    best = T.let(T.answer_tokens(prediction), lambda mine: F.array_max(F.transform(tokens, lambda theirs: f1(mine, theirs))))
    return F.coalesce(best, F.lit(0.0))


def answer_scores(predictions: DataFrame) -> DataFrame:
    p, g = F.col("prediction"), F.col("golds")
    return predictions.select("question_id", "any_relevant", hits_at_1(p, g).alias("hits"), exact_match(p, g).alias("em"), token_f1(p, g).alias("f1"))


def retrieval_scores(facts: DataFrame, threshold: float = 0.5, top_k: int | None = None) -> DataFrame:
    """precision, recall, f1 and any_relevant of each question. ``facts``: question_id, fact_idx, prob, label."""
    rank = F.row_number().over(Window.partitionBy("question_id").orderBy(F.desc("prob"), "fact_idx"))
    rows = facts.withColumn("chosen", (rank <= top_k) if top_k is not None else F.col("prob") >= threshold)
    hit = F.col("chosen") & (F.col("label") == 1)
    sums = rows.groupBy("question_id").agg(F.count_if("chosen").alias("chosen"), F.count_if(F.col("label") == 1).alias("relevant"), F.count_if(hit).alias("hit"))
    p = F.when(F.col("chosen") > 0, F.col("hit") / F.col("chosen")).otherwise(0.0)
    r = F.when(F.col("relevant") > 0, F.col("hit") / F.col("relevant")).otherwise(0.0)
    return sums.select("question_id", p.alias("precision"), r.alias("recall"), F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0).alias("f1"), (F.col("hit") > 0).alias("any_relevant"))


def macro(answers: DataFrame) -> DataFrame:
    """Averages over all questions and over those with a relevant fact retrieved, and their share."""
    mean = lambda c, only=False: F.coalesce(F.avg(F.when(F.col("any_relevant"), F.col(c)) if only else F.col(c)), F.lit(0.0))
    parts = [mean(c).alias(c) for c in ("hits", "em", "f1")] + [mean(c, True).alias(f"{c}_retrieved") for c in ("hits", "em", "f1")]
    return answers.agg(F.count(F.lit(1)).alias("n"), *parts, F.coalesce(F.avg(F.col("any_relevant").cast("double")), F.lit(0.0)).alias("retrieved_share"))


def losses(facts: DataFrame, margin: float = 0.5, bce_weight: float = 0.7) -> DataFrame:
    """bce, ranking and total loss of each question; ranking is 0 where a class is empty.

    The mean hinge over all positive-negative pairs comes from sorted running sums: a positive with probability p
    meets the negatives above p - margin, whose number and sum are running totals. No pair is made.
    """
    p = F.col("prob")
    clipped = lambda x: F.greatest(F.when(x > 0, F.log(x)).otherwise(-100.0), F.lit(-100.0))
    bce = facts.groupBy("question_id").agg(F.avg(-F.when(F.col("label") == 1, clipped(p)).otherwise(clipped(1 - p))).alias("bce"), F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    key = F.when(F.col("label") == 1, p - margin).otherwise(p)
    order = Window.partitionBy("question_id").orderBy(F.desc("key"), F.desc("label")).rowsBetween(Window.unboundedPreceding, 0)
    rows = facts.withColumn("key", key)
    negative = F.col("label") == 0
    rows = rows.withColumn("above", F.sum(F.when(negative, 1).otherwise(0)).over(order)).withColumn("mass", F.sum(F.when(negative, p).otherwise(0.0)).over(order))
    hinge = rows.where("label = 1").groupBy("question_id").agg(F.sum(F.col("mass") - F.col("above") * (F.col("prob") - margin)).alias("hinge"))
    ranking = F.when((F.col("pos") > 0) & (F.col("neg") > 0), F.col("hinge") / (F.col("pos") * F.col("neg"))).otherwise(0.0)
    return bce.join(hinge, "question_id", "left").select("question_id", "bce", ranking.alias("ranking"), (bce_weight * F.col("bce") + (1 - bce_weight) * ranking).alias("total"))


def report(row) -> str:
    """Lines of a macro row for people."""
    values = row.asDict()
    return "\n".join(f"{name}: {value:.4f}" if isinstance(value, float) else f"{name}: {value}" for name, value in values.items())
