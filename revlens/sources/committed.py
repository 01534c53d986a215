"""A prediction sink whose results become visible at once, when the whole job has succeeded.

``df.write.format("committed")`` writes Parquet files by Arrow batches:

    data/<job>/part-*.parquet   one file a task that had rows
    commits/<n>-<job>.json      the files of one committed job

A task writes to a hidden name and renames the file when it is complete, and
reports its name.  The driver writes the job's commit last, again by a rename.
``read_committed`` reads only files that a commit names, so a task that was
tried twice leaves no row twice, and readers never see half a result: until the
commit they see what was there before.  A failed job removes its own files.

``mode("append")`` adds to what is there, ``mode("overwrite")`` replaces it for
readers (the older files stay, so running reads end well).  One writer at a
time.  The folder must be on storage that pyarrow can write (local, HDFS, S3,
GCS); tasks and driver must see the same one.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "committed"
COMMIT = "n long, job string, overwrite boolean, schema string, file string, rows long"


def _store(path: str):
    """File system and path in it."""
    from pyarrow import fs
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), posixpath.abspath(path))


@dataclass
class Part(WriterCommitMessage):
    """The file of one task (None: it had no rows)."""

    file: str | None
    rows: int


class CommittedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, schema: StructType, overwrite: bool):
        self.path, self.schema, self.overwrite = path.rstrip("/"), schema.json(), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator) -> Part:
        import pyarrow.parquet as pq
        files, root = _store(self.path)
        folder, name = f"{root}/data/{self.job}", f"part-{uuid.uuid4().hex}.parquet"
        rows, out = 0, None
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    files.create_dir(folder, recursive=True)
                    out = pq.ParquetWriter(f"{folder}/_{name}", batch.schema, filesystem=files)
                out.write_batch(batch)
                rows += batch.num_rows
        finally:
            if out is not None:
                out.close()
        if out is None:
            return Part(None, 0)
        files.move(f"{folder}/_{name}", f"{folder}/{name}")
        return Part(name, rows)

    def commit(self, messages) -> None:
        files, root = _store(self.path)
        for folder in ("commits", f"data/{self.job}"):
            files.create_dir(f"{root}/{folder}", recursive=True)
        n = 1 + max((int(name.split("-")[0]) for name in _names(files, f"{root}/commits")), default=0)
        head = {"n": n, "job": self.job, "overwrite": self.overwrite, "schema": self.schema}
        parts = [{"file": m.file, "rows": m.rows} for m in messages if m is not None and m.file]
        # the first line tells of the job, whether it has files or not
        lines = [head, *({"n": n, "job": self.job, **p} for p in parts)]
        name = f"{n:010d}-{self.job}.json"
        with files.open_output_stream(f"{root}/commits/_{name}") as out:
            out.write("".join(json.dumps(line) + "\n" for line in lines).encode())
        files.move(f"{root}/commits/_{name}", f"{root}/commits/{name}")

    def abort(self, messages) -> None:
        from pyarrow import fs
        files, root = _store(self.path)
        folder = f"{root}/data/{self.job}"
        if files.get_file_info(folder).type == fs.FileType.Directory:
            files.delete_dir(folder)


def _names(files, folder: str) -> list[str]:
    from pyarrow import fs
    return [i.base_name for i in files.get_file_info(fs.FileSelector(folder)) if not i.base_name.startswith("_")]


class CommittedSink(DataSource):
    """Write side only; see ``read_committed``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def writer(self, schema: StructType, overwrite: bool) -> CommittedWriter:
        return CommittedWriter(self.options["path"], schema, overwrite)


def write_committed(df: DataFrame, path: str, append: bool = False) -> None:
    """Write ``df`` as one commit; until it is complete readers see the state before."""
    df.sparkSession.dataSource.register(CommittedSink)
    df.write.format(FORMAT).mode("append" if append else "overwrite").save(path)


def commits(spark: SparkSession, path: str) -> DataFrame:
    """``n, job, overwrite, files, rows`` of every committed job; earlier ones than the last overwrite are out of use."""
    log = spark.read.schema(COMMIT).json(f"{path.rstrip('/')}/commits")
    return log.groupBy("n", "job").agg(F.bool_or("overwrite").alias("overwrite"), F.count("file").alias("files"),
                                       F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


def read_committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all commits in use: the last overwrite and what was appended since."""
    path = path.rstrip("/")
    log = spark.read.schema(COMMIT).json(f"{path}/commits")
    heads = log.where(F.col("schema").isNotNull()).orderBy("n", "job").collect()   # one row a commit
    start = max((i for i, h in enumerate(heads) if h["overwrite"]), default=0)
    live = heads[start:]
    rows = spark.read.schema(StructType.fromJson(json.loads(live[-1]["schema"]))) \
        .parquet(*[f"{path}/data/{h['job']}" for h in live])
    # one name a task that wrote; complete files of lost attempts are not among them
    named = log.where(F.col("file").isNotNull()).select(F.col("file").alias("_file"))
    kept = rows.withColumn("_name", F.col("_metadata.file_name"))
    return kept.join(F.broadcast(named), F.col("_name") == F.col("_file"), "left_semi").drop("_name")
