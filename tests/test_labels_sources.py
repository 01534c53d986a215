"""Labels, annotations, CSV and line sources."""

import os
import tempfile

from pyspark.sql import functions as F

from revlens.functions import map_class_labels
from revlens.operators.prepare import binarize, prepare
from revlens.sources import read_lines, read_reviews_csv


def test_binarize_double_column(spark):
    df = spark.createDataFrame([(1.0,), (4.0,), (2.5,), (0.0,), (5.0,), (3.0,)], "score double")
    got = [r.score for r in binarize(df).collect()]
    assert got == [0.0, 1.0, 2.5, 0.0, 1.0, 0.0]


def test_binarize_string_column_unchanged(spark):
    df = spark.createDataFrame([("1",), ("abc",)], "score string")
    assert [r.score for r in binarize(df).collect()] == ["1", "abc"]


def test_class_map_and_try_cast(spark):
    df = spark.createDataFrame([("neg",), ("neutral",), ("pos",), ("other",)], "p string")
    got = [r[0] for r in df.select(map_class_labels("p")).collect()]
    assert got == [0.0, 0.0, 1.0, None]


def test_explode_empty_gives_no_row(spark):
    df = spark.createDataFrame([([],), (["pos"],)], "r array<string>")
    assert df.select(F.explode("r")).count() == 1


def test_csv_quotes_and_newlines(spark):
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    with open(os.path.join(d, "r.csv"), "w") as f:
        f.write('doc_id,score,text\n1,4.0,"He said ""hi"",\nline two"\n2,,"no score"\n3,5.0,\n')
    df = read_reviews_csv(spark, d)
    rows = {r.doc_id: r for r in df.collect()}
    assert rows[1].text == 'He said "hi",\nline two'
    prepared = prepare(df, keep=["doc_id"]).collect()
    assert [(r.doc_id, r.score, r.text) for r in prepared] == [(1, 1.0, "he said hi\nline two")]


def test_csv_columns_by_name(spark):
    import pytest
    from revlens.sources import labelled_reviews
    d = tempfile.mkdtemp(prefix="revlens-csv-")
    with open(os.path.join(d, "r.csv"), "w") as f:
        f.write('Id,Title,review/score,review/text\n7,t,4.0,"fine, book"\n8,t,9.0,odd\n9,t,,none\n10,t,2.0,\n11,t,bad,x\n12,t,1.0,poor\n')
    names = {"doc_id": "Id", "score": "review/score", "text": "review/text"}
    assert sorted(tuple(r) for r in labelled_reviews(spark, d, names).collect()) == [(7, "fine, book", 1.0), (12, "poor", 0.0)]
    assert labelled_reviews(spark, d).select("label").count() == 2
    with pytest.raises(ValueError):
        read_reviews_csv(spark, d)


def test_read_lines_one_row_per_line(spark):
    d = tempfile.mkdtemp(prefix="revlens-txt-")
    with open(os.path.join(d, "in.txt"), "w") as f:
        f.write("first review\nsecond review\n")
    assert [r.text for r in read_lines(spark, d).collect()] == ["first review", "second review"]


def test_out_of_range_scores_are_rejected(spark):
    from revlens.operators.prepare import split_valid_scores
    df = spark.createDataFrame([(1.0,), (5.0,), (7.0,), (None,), (2.5,)], "score double")
    ok, bad = split_valid_scores(df)
    assert sorted(r.score for r in ok.collect()) == [1.0, 5.0]
    assert sorted((r.score is None, r.score) for r in bad.collect()) == [(False, 2.5), (False, 7.0), (True, None)]


def test_labelled_documents_drop_incomplete_rows(spark):
    from revlens.sources import labelled_documents
    d = tempfile.mkdtemp(prefix="revlens-lab-")
    spark.createDataFrame([(1, "good book"), (2, None), (3, "bad book"), (4, "no label")],
                          "doc_id long, text string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 1)],
                          "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    rows = [tuple(r) for r in labelled_documents(spark, d).collect()]
    assert rows == [(1, "good book", 1.0)]
