"""Multinomial naive Bayes as relational jobs (same numbers as MLlib's NaiveBayes).

Model, for classes c present in training, features t of a space of size V and
smoothing s:
    pi_c      = ln(n_c + s) - ln(n + C s)
    theta_ct  = ln(N_ct + s) - ln(N_c + V s)
    theta0_c  = ln(s) - ln(N_c + V s)         (any t never seen with c)
The model is stored sparse: one row per observed (class, feature) plus one
prior row per class, so no classes x vocabulary grid is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.operators.skew import hot_cold_join, top_keys
from revlens.operators.termstats import count_rows
from revlens.session import keep

#: Classes a model may have: the prior is read as a list and each class is a column.
MAX_CLASSES = 1000
#: Cells (classes x features) of a model that may be broadcast for scoring.
BROADCAST_CELLS = 2_000_000


def fit_nb(features: DataFrame, docs: DataFrame, n_features: Column | int,
           smoothing: float = 1.0, label_col: str = "label",
           feature_col: str = "idx", value_col: str = "value") -> tuple[DataFrame, DataFrame]:
    """Fit on ``features (doc_id, label, feature, value)`` and ``docs (doc_id, label)``.

    Returns ``(prior, theta)``: ``prior (label, pi, theta0)`` with one row per
    class and ``theta (label, feature, theta)`` for observed pairs.  Both are
    bounded (classes, and classes x feature space).
    """
    classes = docs.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_c"))
    # prior and parameters both read the sums: they are aggregated once
    sums = keep(features.groupBy(label_col, feature_col).agg(F.sum(value_col).alias("n_ct")))
    return nb_parameters(classes, sums, count_rows(docs), n_features, smoothing, label_col, feature_col)


def nb_parameters(classes: DataFrame, sums: DataFrame, n_docs: Column, n_features: Column | int,
                  smoothing: float = 1.0, label_col: str = "label", feature_col: str = "idx") -> tuple[DataFrame, DataFrame]:
    """``(prior, theta)`` as ``fit_nb`` gives them, from ``classes (label, n_c)`` and ``sums (label, feature, n_ct)``."""
    s = F.lit(float(smoothing))
    v = (n_features if isinstance(n_features, Column) else F.lit(n_features)).cast("double")
    n = n_docs.cast("double")
    n_classes = count_rows(classes).cast("double")
    totals = sums.groupBy(label_col).agg(F.sum("n_ct").alias("n_c_total"))
    prior = (classes.join(totals, label_col, "left")
             .select(label_col,
                     (F.log(F.col("n_c") + s) - F.log(n + n_classes * s)).alias("pi"),
                     F.coalesce(F.col("n_c_total"), F.lit(0.0)).alias("n_c_total")))
    denom = F.log(F.col("n_c_total") + v * s)
    prior = prior.select(label_col, "pi", (F.log(s) - denom).alias("theta0"), "n_c_total")
    theta = (sums.join(F.broadcast(prior.select(label_col, "n_c_total")), label_col)
             .select(label_col, feature_col,
                     (F.log(F.col("n_ct") + s) - denom).alias("theta")))
    return prior.drop("n_c_total"), theta


def score_nb(features: DataFrame, docs: DataFrame, prior: DataFrame, theta: DataFrame,
             label_col: str = "label", feature_col: str = "idx", value_col: str = "value",
             id_col: str = "doc_id", max_features: int | None = None) -> DataFrame:
    """``docs`` plus ``prediction`` and ``score`` (the winning log-posterior).

    Every row of ``docs`` is scored; one without any known feature gets the
    prior-only prediction.  Ties go to the smallest label, as MLlib's argmax.

    The prior has one row per class, so it is read once (a bounded list) and
    the per-class sums become plain columns: one hash aggregation per
    document, then ``greatest`` for the argmax -- no documents x classes rows.
    ``theta`` is one array of per-class log-probabilities per feature.  It is
    broadcast only if ``max_features``, the caller's bound on the feature space,
    keeps it within ``BROADCAST_CELLS``; otherwise it takes the join that
    broadcasts hot features alone.
    """
    classes = prior.select(label_col, "pi", "theta0").orderBy(label_col).limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    if not classes:
        raise ValueError("empty model: no classes")
    labels = [float(r[label_col]) for r in classes]
    per_feature = (theta.groupBy(feature_col)
                   .agg(F.map_from_entries(F.collect_list(F.struct(label_col, "theta"))).alias("m"))
                   .select(feature_col,
                           F.array(*[F.coalesce(F.col("m")[F.lit(lab)], F.lit(float(r["theta0"])))
                                     for lab, r in zip(labels, classes)]).alias("tv")))
    feats = features.select(id_col, feature_col, value_col)
    if max_features is not None and max_features * len(classes) <= BROADCAST_CELLS:
        joined = feats.join(F.broadcast(per_feature), feature_col, "left")
    else:
        counts = feats.groupBy(feature_col).agg(F.count(F.lit(1)).alias("_n"))
        joined = hot_cold_join(feats, per_feature, feature_col, top_keys(counts, feature_col, "_n"), "left")
    sums = joined.groupBy(id_col).agg(*[
        F.sum(F.col(value_col) * F.coalesce(F.col("tv")[i], F.lit(float(r["theta0"])))).alias(f"_s{i}")
        for i, r in enumerate(classes)])
    scored = docs.join(sums, id_col, "left")
    scores = [F.lit(float(r["pi"])) + F.coalesce(F.col(f"_s{i}"), F.lit(0.0)) for i, r in enumerate(classes)]
    scored = scored.select("*", *[sc.alias(f"_p{i}") for i, sc in enumerate(scores)])
    best = F.greatest(*[F.col(f"_p{i}") for i in range(len(classes))]) if len(classes) > 1 else F.col("_p0")
    prediction = F.coalesce(*[F.when(F.col(f"_p{i}") == best, F.lit(lab)) for i, lab in enumerate(labels)])
    return scored.select(*docs.columns, prediction.alias("prediction"), best.alias("score"))
