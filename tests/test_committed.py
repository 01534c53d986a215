"""The committed sink: commits, replaced and added rows, failed jobs, tasks tried twice."""

import os
import subprocess
import sys

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from revlens.sources.committed import commits, read_committed, write_committed

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _files(path):
    return sorted(os.path.join(d, f) for d, _, names in os.walk(path / "data") for f in names)


def test_overwrite_and_append(spark, tmp_path):
    path = tmp_path / "out"
    df = spark.range(1000).select(F.col("id").alias("doc_id"), F.concat(F.lit("é\n\""), F.col("id")).alias("text"),
                                  F.when(F.col("id") > 5, F.col("id") / 3).alias("prediction"), F.array(F.lit(1.5)).alias("v"),
                                  F.timestamp_seconds("id").alias("at"))
    write_committed(df.repartition(7), str(path))
    assert sorted(read_committed(spark, str(path)).collect()) == sorted(df.collect())
    write_committed(df.where("doc_id < 10"), str(path), append=True)
    assert read_committed(spark, str(path)).count() == 1010
    write_committed(df.where("doc_id < 20").repartition(3), "file:" + str(path))
    assert sorted(read_committed(spark, str(path)).collect()) == sorted(df.where("doc_id < 20").collect())
    got = [(r.n, r.overwrite, r.rows) for r in commits(spark, str(path)).orderBy("n").collect()]
    assert got == [(1, True, 1000), (2, False, 10), (3, True, 20)]
    write_committed(df.limit(0), str(path))
    assert read_committed(spark, str(path)).count() == 0 and read_committed(spark, str(path)).dtypes == df.dtypes


def test_failed_job_leaves_the_last_commit(spark, tmp_path):
    path = tmp_path / "out"
    write_committed(spark.range(50).repartition(2), str(path))
    before = _files(path)
    broken = spark.range(0, 100, 1, 4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("broken row")).cast("long")).otherwise(F.col("id")).alias("id"))
    for append in (False, True):
        with pytest.raises(Exception, match="broken row"):
            write_committed(broken, str(path), append)
    assert commits(spark, str(path)).count() == 1 and read_committed(spark, str(path)).count() == 50
    assert set(before) <= set(_files(path))


def test_files_that_no_commit_names_are_not_read(spark, tmp_path):
    """What a lost attempt leaves: a complete file, and one cut off under its hidden name."""
    path = tmp_path / "out"
    write_committed(spark.range(50).repartition(2), str(path))
    one = _files(path)[0]
    pq.write_table(pq.read_table(one), os.path.join(os.path.dirname(one), "part-lost.parquet"))
    with open(os.path.join(os.path.dirname(one), "_part-cut.parquet"), "wb") as f:
        f.write(b"PAR1 and then nothing")
    assert sorted(r.id for r in read_committed(spark, str(path)).collect()) == list(range(50))


RETRY = """
import os, sys
from pyspark import TaskContext
from revlens.session import get_session
from revlens.sources.committed import commits, read_committed, write_committed
spark = get_session("local[2,3]", app="retry", shuffle_partitions=2, driver_memory="1g")
def fails_once(batches):
    for i, batch in enumerate(batches):
        yield batch
        if TaskContext.get().attemptNumber() == 0 and TaskContext.get().partitionId() == 1:
            raise RuntimeError("first attempt of this task")
spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 10)
df = spark.range(0, 300, 1, 3).mapInArrow(fails_once, "id long")
write_committed(df, sys.argv[1])
print("rows", sorted(r.id for r in read_committed(spark, sys.argv[1]).collect()) == list(range(300)))
print("commit", [(r.n, r.files, r.rows) for r in commits(spark, sys.argv[1]).collect()])
"""


def test_a_task_that_fails_mid_write_is_tried_again(tmp_path):
    env = {**os.environ, "PYTHONPATH": REPO}
    run = subprocess.run([sys.executable, "-c", RETRY, str(tmp_path / "out")], capture_output=True, text=True, timeout=240, env=env)
    assert "rows True" in run.stdout and "commit [(1, 3, 300)]" in run.stdout, run.stdout + run.stderr[-3000:]
    assert "first attempt of this task" in run.stderr
