"""Evaluation of binary scores: ``label`` 0/1, ``score``, ``prediction`` 0/1.

Rows are first counted per distinct value, so every metric works on a table of
distinct scores, and curves use running totals over range-sorted slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from binroute.functions import safe_div
from binroute.operators.totals import running_totals


def confusion(scored: DataFrame) -> DataFrame:
    """Rows per (label, prediction)."""
    return scored.groupBy("label", "prediction").agg(F.count("*").alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    hit = F.col("label") == F.col("prediction")
    return confusion(scored).agg(safe_div(F.sum(F.when(hit, F.col("n")).otherwise(0)), F.sum("n")).alias("accuracy"))


def _per_score(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score."""
    return scored.groupBy("score").agg(
        F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg")
    )


def _cumulative(scored: DataFrame) -> tuple[DataFrame, Column]:
    """Rows at or above each distinct score, and the two class sizes."""
    points = running_totals(_per_score(scored), [F.desc("score")], {"tp": "pos", "fp": "neg"})
    sizes = points.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    return points, sizes.select(F.struct("*")).scalar()


def auc(scored: DataFrame) -> DataFrame:
    """Area under the ROC curve; a tie between classes counts half."""
    points, sizes = _cumulative(scored)
    # Negatives below a score: those not at or above it.
    below = sizes.getField("n") - F.col("fp")
    won = F.sum(F.col("pos").cast("double") * (below.cast("double") + F.col("neg").cast("double") / 2))
    pairs = sizes.getField("p").cast("double") * sizes.getField("n").cast("double")
    return points.agg(won.alias("won")).select(safe_div(F.col("won"), pairs).alias("auc"))


def roc(scored: DataFrame) -> DataFrame:
    """One point per distinct score, and the origin with a NULL threshold."""
    points, sizes = _cumulative(scored)
    origin = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    return points.select(
        F.col("score").cast("double").alias("threshold"),
        safe_div(F.col("fp"), sizes.getField("n")).alias("fpr"),
        safe_div(F.col("tp"), sizes.getField("p")).alias("tpr"),
    ).unionByName(origin)


def precision_recall(scored: DataFrame) -> DataFrame:
    """One point per distinct score, and the end point (precision 1, recall 0)."""
    points, sizes = _cumulative(scored)
    end = scored.sparkSession.range(1).select(
        F.lit(None).cast("double").alias("threshold"), F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")
    )
    return points.select(
        F.col("score").cast("double").alias("threshold"),
        safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        safe_div(F.col("tp"), sizes.getField("p")).alias("recall"),
    ).unionByName(end)


def classification_report(scored: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class, accuracy, and both means.

    A quotient with a zero denominator is 0, as when nothing is predicted
    positive.
    """
    counts = confusion(scored).agg(
        *[
            F.coalesce(
                F.sum(F.when((F.col("label") == label) & (F.col("prediction") == guess), F.col("n"))), F.lit(0)
            ).alias(f"n{label}{guess}")
            for label in (0, 1)
            for guess in (0, 1)
        ]
    )

    def zero_safe(part: Column, whole: Column) -> Column:
        return F.coalesce(safe_div(part, whole), F.lit(0.0))

    def of_class(c: int) -> dict[str, Column]:
        other = 1 - c
        hit = F.col(f"n{c}{c}")
        support = hit + F.col(f"n{c}{other}")
        guessed = hit + F.col(f"n{other}{c}")
        return {
            f"precision{c}": zero_safe(hit, guessed),
            f"recall{c}": zero_safe(hit, support),
            f"f1{c}": zero_safe(2 * hit, guessed + support),
            f"support{c}": support,
        }

    wide = counts.withColumns({**of_class(0), **of_class(1)})
    total = F.col("support0") + F.col("support1")
    correct = zero_safe(F.col("n00") + F.col("n11"), total)

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            support.alias("support"),
        )

    def mean(metric: str) -> Column:
        return (F.col(f"{metric}0") + F.col(f"{metric}1")) / 2

    def weighted(metric: str) -> Column:
        part = F.col(f"{metric}0") * F.col("support0") + F.col(f"{metric}1") * F.col("support1")
        return zero_safe(part, total)

    metrics = ("precision", "recall", "f1")
    lines = F.array(
        line("0", *[F.col(f"{m}0") for m in metrics], F.col("support0")),
        line("1", *[F.col(f"{m}1") for m in metrics], F.col("support1")),
        line("accuracy", correct, correct, correct, total),
        line("macro avg", *[mean(m) for m in metrics], total),
        line("weighted avg", *[weighted(m) for m in metrics], total),
    )
    return wide.select(F.inline(lines))
