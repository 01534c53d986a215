"""Accuracy and support-weighted F1 from one confusion-table aggregation
(the numbers of MLlib's MulticlassClassificationEvaluator)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def confusion_matrix(preds: DataFrame, label_col: str = "label",
                     prediction_col: str = "prediction", group_cols: Sequence[str] = ()) -> DataFrame:
    """``([group...], label, prediction, n)``; at most classes^2 rows per group."""
    return (preds.groupBy(*group_cols, F.col(label_col).alias("label"),
                          F.col(prediction_col).alias("prediction"))
            .agg(F.count(F.lit(1)).alias("n")))


def metrics_from_confusion(cm: DataFrame, group_cols: Sequence[str] = ()) -> DataFrame:
    """``([group...], accuracy, f1, n)``.

    F1 of a label = 2 tp / (support + predicted); a label that is never
    predicted scores 0; predictions of a class absent from the labels lower
    recall only.  Weighted by support over all rows.
    """
    g = list(group_cols)
    support = cm.groupBy(*g, "label").agg(
        F.sum("n").alias("support"),
        F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)).alias("tp"))
    predicted = cm.groupBy(*g, F.col("prediction").alias("label")).agg(F.sum("n").alias("npred"))
    per_label = support.join(predicted, g + ["label"], "left").withColumn(
        "f1_label", 2.0 * F.col("tp") / (F.col("support") + F.coalesce(F.col("npred"), F.lit(0))))
    return per_label.groupBy(*g).agg(
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        (F.sum(F.col("support") * F.col("f1_label")) / F.sum("support")).alias("f1"),
        F.sum("support").alias("n"))


def evaluate(preds: DataFrame, label_col: str = "label", prediction_col: str = "prediction") -> DataFrame:
    """One row: accuracy, weighted F1, n."""
    return metrics_from_confusion(confusion_matrix(preds, label_col, prediction_col))


def metrics_report(preds: DataFrame, prediction_cols: dict[str, str],
                   label_col: str = "label") -> DataFrame:
    """Every model's accuracy and F1 in one pass: the prediction columns are
    unpivoted to ``(model, prediction)`` and one confusion table is grouped by model."""
    long = preds.unpivot([label_col], list(prediction_cols.values()), "column", "prediction")
    names = F.create_map(*[F.lit(x) for kv in
                           ((col, model) for model, col in prediction_cols.items()) for x in kv])
    long = long.withColumn("model", names[F.col("column")]).drop("column")
    return metrics_from_confusion(confusion_matrix(long, label_col, "prediction", ["model"]), ["model"])
