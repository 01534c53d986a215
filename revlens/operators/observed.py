"""Metrics taken while predictions are written: no second pass over them.

The confusion table of every prediction column is counted by the write job
itself (an accumulator: per-task counts, merged as tasks end), so scoring,
writing and reporting read the features once.  Not an ``Observation``: Spark
4.1 keeps its manager in the session, the summary of a fitted binary
classifier holds the session, and from then on no such model can be sent to
executors.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.accumulators import AccumulatorParam
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.evaluate import metrics_from_confusion

#: Classes of an observed table at most: it has classes^2 counts per prediction column.
MAX_OBSERVED = 40


class _Counts(AccumulatorParam):
    """Arrays of counts, added."""

    def zero(self, value):
        return np.zeros_like(value)

    def addInPlace(self, value1, value2):
        return value1 + value2


def _counted(seen, shape: tuple[int, int]):
    """UDF that adds every row's cells, one per prediction column, to ``seen``; true for every row."""
    models, cells = shape

    @F.pandas_udf("boolean")
    def count(rows: pd.Series) -> pd.Series:
        if len(rows):
            at = np.stack(rows.to_list()).astype(np.int64) + np.arange(models) * cells
            seen.add(np.bincount(at.ravel(), minlength=models * cells).reshape(shape))
        return pd.Series(np.ones(len(rows), dtype=bool))

    return count.asNondeterministic()


def write_with_metrics(preds: DataFrame, path: str, prediction_cols: dict[str, str], classes: Sequence[float],
                       label_col: str = "label") -> DataFrame:
    """Write ``preds`` as Parquet and return ``(model, accuracy, f1, n)`` of its prediction columns.

    ``classes`` are the labels that may occur.  Rows whose label or prediction
    is another one, or NULL, are written too, but then no metrics are given:
    ``ValueError`` names their number.  An empty input gives no rows.
    """
    classes = sorted(set(float(c) for c in classes))
    if not classes or len(classes) > MAX_OBSERVED:
        raise ValueError(f"1 to {MAX_OBSERVED} classes can be observed, not {len(classes)}")
    spark, k = preds.sparkSession, len(classes)
    known = F.array(*[F.lit(c) for c in classes])

    def place(name: str) -> Column:
        return F.array_position(known, F.col(name).cast("double"))   # from 1; 0: none of the classes

    # cell 0 of a prediction column: rows outside the classes
    cells = [F.when((place(label_col) > 0) & (place(c) > 0), (place(label_col) - 1) * k + place(c)).otherwise(0)
             for c in prediction_cols.values()]
    shape = (len(cells), k * k + 1)
    seen = spark.sparkContext.accumulator(np.zeros(shape, dtype=np.int64), _Counts())
    # the label passes through the count, or Spark would leave the count out
    hit = _counted(seen, shape)(F.array(*cells))
    preds.withColumn(label_col, F.when(hit, F.col(label_col))).write.mode("overwrite").parquet(path)
    counts = {model: row.tolist() for model, row in zip(prediction_cols, seen.value)}
    outside = {model: row[0] for model, row in counts.items()}
    if any(outside.values()):
        raise ValueError(f"written, but rows outside the classes {classes}: {outside}")
    table = [(model, classes[i // k], classes[i % k], n) for model, row in counts.items() for i, n in enumerate(row[1:]) if n]
    return metrics_from_confusion(spark.createDataFrame(table, "model string, label double, prediction double, n long"), ["model"])
