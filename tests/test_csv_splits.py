"""The splittable CSV scan against Spark's multi-line reader, and ids that do not depend on the scan."""

import csv
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from revlens.cli import _labelled
from revlens.operators.prepare import hash_split
from revlens.sources import CSV_OPTIONS, read_numbered_lines, read_reviews_csv
from revlens.sources.splits import FILE_IDS, read_records, scanned_lines

COLUMNS = {"score": "score", "text": "text"}


@pytest.fixture
def small_splits(spark):
    """Set the split size; the session's own comes back afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(n) for n in names]

    def use(size):
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "0")
    yield use
    for n, v in zip(names, before):
        spark.conf.set(n, v)


@pytest.fixture(scope="module")
def folder():
    """Three files: all fields quoted, only where needed, CR LF at the ends of lines; texts with quotes and newlines, some long."""
    draw, d = random.Random(11), tempfile.mkdtemp(prefix="revlens-csv-")
    marks = ["a", "\n", '"', ",", "é", "word ", " ", "\n\n", '""']
    for f in range(3):
        with open(f"{d}/f{f}.csv", "w", newline="") as o:
            w = csv.writer(o, quoting=csv.QUOTE_ALL if f == 0 else csv.QUOTE_MINIMAL, lineterminator="\r\n" if f == 2 else "\n")
            w.writerow(["score", "text"])
            for i in range(400):
                size = 3000 if i % 150 == 7 else draw.choice([0, 3, 30])
                w.writerow([draw.choice(["1.0", "5", "x", ""]), "".join(draw.choice(marks) for _ in range(size))])
    return d


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("size", ["700", "9000", "128m"])
def test_equals_the_multi_line_reader(spark, folder, small_splits, size):
    want = rows(spark.read.options(**CSV_OPTIONS).csv(folder).select(F.col("score").try_cast("double"), "text"))
    small_splits(size)
    got = read_reviews_csv(spark, folder, COLUMNS)
    assert rows(got.select("score", "text")) == want
    assert got.select("doc_id").distinct().count() == len(want) == 1200


def test_one_file_is_read_by_many_tasks(spark, folder, small_splits):
    path = f"{folder}/f1.csv"
    whole = rows(read_reviews_csv(spark, path, COLUMNS))
    small_splits("2000")
    df = read_reviews_csv(spark, path, COLUMNS)
    assert scanned_lines(spark, path).rdd.getNumPartitions() > 10
    assert rows(df) == whole


def test_ids_and_train_test_split_are_stable(spark, folder, small_splits):
    splits = []
    for size in ("128m", "5000"):
        small_splits(size)
        train, test = hash_split(read_reviews_csv(spark, folder, COLUMNS))
        splits.append((rows(train), rows(test)))
    assert splits[0] == splits[1] and all(splits[0])
    ids = [r[0] for r in splits[0][0] + splits[0][1]]
    assert {i // FILE_IDS for i in ids} == {0, 1, 2} and len(set(ids)) == len(ids)


def test_train_and_evaluate_see_the_same_split(spark, small_splits):
    """What one scan trains on, another scan of the same files never tests on."""
    d = tempfile.mkdtemp(prefix="revlens-rev-") + "/reviews.csv"
    os.mkdir(d)
    for f in range(4):
        with open(f"{d}/part-{f}.csv", "w", newline="") as o:
            w = csv.writer(o)
            w.writerow(["review/score", "review/text"])
            w.writerows([[1 + i % 5, f"review {f} {i}\nwith a second line"] for i in range(100)])
    small_splits("128m")
    train = {r.text for r in hash_split(_labelled(spark, d))[0].collect()}
    small_splits("1500")
    test = {r.text for r in hash_split(_labelled(spark, d))[1].collect()}
    assert train and test and not train & test and len(train | test) == 400


def test_odd_files(spark, small_splits):
    """Empty files, a header only, no newline at the end, blank lines, a quote that never closes."""
    d = tempfile.mkdtemp(prefix="revlens-odd-")
    for name, text in {"a": "", "b": "score,text\n", "c": 'score,text\n1,"x\n\ny"\n\n2,z', "d": 'score,text\n1,a\n2,"open\n3,b\n'}.items():
        with open(f"{d}/{name}.csv", "w") as o:
            o.write(text)
    for size in ("128m", "9"):
        small_splits(size)
        got = {(r["id"] // FILE_IDS, r["id"] % FILE_IDS): r["record"] for r in read_records(spark, d).collect()}
        by_file = {}
        for (f, n), text in sorted(got.items()):
            by_file.setdefault(f, []).append(text)
        assert sorted(by_file.values()) == [["score,text"], ["score,text", '1,"x\n\ny"', "", "2,z"], ["score,text", "1,a", '2,"open\n3,b']]


def test_numbered_lines(spark, small_splits):
    d = tempfile.mkdtemp(prefix="revlens-lines-")
    for f in range(2):
        with open(f"{d}/l{f}.txt", "w", newline="") as o:
            o.write("".join(f"line {f} {i}\r\n" for i in range(300)))
    want = sorted((f * FILE_IDS + i, f"line {f} {i}") for f in range(2) for i in range(300))
    for size in ("128m", "500"):
        small_splits(size)
        assert rows(read_numbered_lines(spark, d)) == sorted(want, key=str)
