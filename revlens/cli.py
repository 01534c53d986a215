"""Command line: train a model, score files with it.

    python -m revlens.cli train --extractor ngram --data <sf_dir> --model <dir>
    python -m revlens.cli evaluate --model <dir> --data <sf_dir> [--output <dir>]
    python -m revlens.cli score --model <dir> --classifier lr --input <text dir/file> --output <dir>

``train`` fits on the labelled documents or on review CSV files (hash split, 90 % train) and prints
accuracy and weighted F1 on the held-out 10 %.  ``score`` reads one review
per line, applies the same preparation as training (cleaning included),
and writes ``(line_id, text, prediction)`` as Parquet -- distributed, no
collect.  The classifier choice is checked before any job runs.
"""

from __future__ import annotations

import argparse
import sys

EXTRACTORS = ("tfidf", "word2vec", "ngram")
CLASSIFIERS = ("lr", "nb", "svm")


def _labelled(spark, data: str):
    """Labelled texts: a folder with the documents and labels tables, or review CSV files (``*.csv``)."""
    from revlens.sources import labelled_documents, labelled_reviews
    return labelled_reviews(spark, data) if data.rstrip("/").endswith(".csv") else labelled_documents(spark, data)


def train(spark, extractor: str, data_dir: str, model_dir: str, classifiers=None,
          stem: bool | None = None, **params):
    """Fit on the train split, save, return the test-split metrics per classifier."""
    from revlens.operators.prepare import hash_split
    from revlens.plans.persist import save_fitted
    from revlens.plans.pipelines import fit_extractor
    train_df, test_df = hash_split(_labelled(spark, data_dir))
    fitted = fit_extractor(train_df, extractor, classifiers, stem, **params)
    save_fitted(spark, fitted, model_dir, extractor)
    return _report(fitted, test_df)


def _report(fitted, test_df):
    from revlens.operators.evaluate import metrics_report
    from revlens.plans.pipelines import prediction_col
    cols = {c: prediction_col(c) for c in fitted.classifiers}
    return metrics_report(fitted.transform(test_df), cols)


def evaluate_saved(spark, model_dir: str, data_dir: str, output: str | None = None):
    """Reload a saved model and report accuracy and weighted F1 on the test split.

    With ``output`` the predictions are written there, and the job that writes
    them counts the metrics.
    """
    from revlens.operators.prepare import hash_split
    from revlens.plans.persist import load_fitted
    fitted, _ = load_fitted(spark, model_dir)
    _, test_df = hash_split(_labelled(spark, data_dir))
    if output is None:
        return _report(fitted, test_df)
    from revlens.operators.observed import write_with_metrics
    from revlens.plans.pipelines import prediction_col
    cols = {c: prediction_col(c) for c in fitted.classifiers}
    scored = fitted.transform(test_df).select(fitted.id_col, "label", *cols.values())
    classes = max(getattr(stage, "numClasses", 0) for stage in fitted.model.stages)
    return write_with_metrics(scored, output, cols, range(classes))


def score_lines(spark, model_dir: str, classifier: str, input_path: str, output_path: str):
    from revlens.plans.persist import load_fitted
    from revlens.plans.pipelines import CLASSIFIER_PREFIX, score
    from revlens.sources import read_numbered_lines
    if classifier not in CLASSIFIER_PREFIX:
        raise ValueError(f"classifier must be one of {sorted(CLASSIFIER_PREFIX)}")
    fitted, extractor = load_fitted(spark, model_dir)
    if classifier not in fitted.classifiers:
        raise ValueError(f"the {extractor} model has no {classifier!r} classifier "
                         f"(has {list(fitted.classifiers)})")
    lines = read_numbered_lines(spark, input_path).withColumnsRenamed({"id": "line_id", "line": "text"})
    out = score(lines, fitted, classifier, id_col=["line_id", "text"])
    out.write.mode("overwrite").parquet(output_path)
    return output_path


def main(argv=None):
    p = argparse.ArgumentParser(prog="revlens")
    sub = p.add_subparsers(dest="cmd", required=True)
    t = sub.add_parser("train")
    t.add_argument("--extractor", choices=EXTRACTORS, required=True)
    t.add_argument("--data", required=True, help="folder with documents/labels parquet, or review CSV (*.csv)")
    t.add_argument("--model", required=True)
    t.add_argument("--stem", action="store_true", help="stem words before tfidf / ngram features")
    e = sub.add_parser("evaluate")
    e.add_argument("--model", required=True)
    e.add_argument("--data", required=True)
    e.add_argument("--output", help="also write the test split's predictions here (Parquet)")
    s = sub.add_parser("score")
    s.add_argument("--model", required=True)
    s.add_argument("--classifier", choices=CLASSIFIERS, required=True)
    s.add_argument("--input", required=True)
    s.add_argument("--output", required=True)
    args = p.parse_args(argv)
    from revlens.session import get_session
    spark = get_session(app=f"revlens-{args.cmd}")
    if args.cmd == "train":
        train(spark, args.extractor, args.data, args.model, stem=args.stem or None).show(truncate=False)
    elif args.cmd == "evaluate":
        evaluate_saved(spark, args.model, args.data, args.output).show(truncate=False)
    else:
        print(score_lines(spark, args.model, args.classifier, args.input, args.output))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
