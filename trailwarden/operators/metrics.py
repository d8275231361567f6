"""Ranking and classification metrics on (label, score) tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import ordering as o


def ranking_metrics(scored: DataFrame, label: str = "label", score: str = "score") -> DataFrame:
    """ROC-AUC (ties count half) and step-wise average precision; null for one class.

    Rows collapse to one per distinct score first; the running counts over the
    scores then use the two-level prefix of :mod:`.ordering`.
    """
    per_score = scored.groupBy(F.col(score).alias("score")).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count("*").alias("n"))
    placed = o.positions(per_score, [F.desc("score")], "score-order")
    parts = placed.groupBy(o.PART).agg(F.sum("pos").alias("_p"), F.sum("n").alias("_n"))
    before = parts.select(o.PART, o.earlier_sum("_p").alias("_p0"), o.earlier_sum("_n").alias("_n0"))
    cumulated = o.with_part_state(placed, before).select(
        "pos", "n",
        (F.col("_p0") + F.sum("pos").over(o.running())).alias("tp"),
        (F.col("_n0") + F.sum("n").over(o.running())).alias("seen"),
    )
    neg = F.col("n") - F.col("pos")
    # each negative is beaten by all positives above it and half of those it ties with
    beaten = neg * (F.col("tp") - F.col("pos")) + neg * F.col("pos") / 2.0
    sums = cumulated.agg(
        F.sum(beaten).alias("wins"), F.sum("pos").alias("positives"), F.sum(neg).alias("negatives"),
        F.sum(F.col("pos") * (F.col("tp") / F.col("seen"))).alias("steps"),
    )
    return sums.select(
        F.round(F.try_divide("wins", F.col("positives").cast("double") * F.col("negatives")), 6).alias("roc_auc"),
        F.round(F.try_divide("steps", F.col("positives").cast("double")), 6).alias("average_precision"),
    )


def classification_report(scored: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """Precision, recall, f1 and support per class plus accuracy and averages.

    The confusion counts are one row per (label, prediction) pair, so all that
    follows runs on a handful of rows.
    """
    pairs = scored.groupBy(F.col(label).cast("string").alias("y"), F.col(prediction).cast("string").alias("p")).agg(
        F.count("*").alias("n"))
    actual = pairs.select(F.col("y").alias("cls"), F.col("n").alias("support"), F.lit(0).alias("predicted"),
                          F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("hit"))
    guessed = pairs.select(F.col("p").alias("cls"), F.lit(0).alias("support"), F.col("n").alias("predicted"),
                           F.lit(0).alias("hit"))
    per_class = actual.unionByName(guessed).groupBy("cls").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit"))
    rate = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    rows = per_class.select(
        "cls", "support", "hit", rate("hit", "predicted").alias("precision"), rate("hit", "support").alias("recall"),
        F.coalesce(F.try_divide(2.0 * F.col("hit"), (F.col("predicted") + F.col("support")).cast("double")),
                   F.lit(0.0)).alias("f1"),
    )
    names = ("precision", "recall", "f1")
    macro = rows.agg(*[F.avg(c).alias(c) for c in names], F.sum("support").alias("support"))
    mean = rows.agg(*[(F.sum(F.col(c) * F.col("support")) / F.sum("support")).alias(c) for c in names],
                    F.sum("support").alias("support"))
    accuracy = rows.agg((F.sum("hit") / F.sum("support")).alias("f1"), F.sum("support").alias("support"))
    tables = [
        rows.select("cls", *names, "support"),
        macro.select(F.lit("macro avg").alias("cls"), *names, "support"),
        mean.select(F.lit("weighted avg").alias("cls"), *names, "support"),
        accuracy.select(F.lit("accuracy").alias("cls"), F.lit(None).cast("double").alias("precision"),
                        F.lit(None).cast("double").alias("recall"), "f1", "support"),
    ]
    report = tables[0]
    for table in tables[1:]:
        report = report.unionByName(table)
    return report.select("cls", *[F.round(c, 6).alias(c) for c in names], "support")
