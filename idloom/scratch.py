"""Intermediate tables in the folder that all executors share: ``spark.checkpoint.dir`` of the session.

A table written there ends its lineage and outlives executors. Results are lazy and read such tables, so that an operator can't
delete what its caller still needs: the caller does, by ``clear`` when results are consumed, or ``clear`` from a ``mark`` on when they
are written elsewhere. What is left at the end of the process is deleted then, in local mode with the folder.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, in local mode alone, a temporary folder is made and set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="idloom-")
        spark.conf.set("spark.checkpoint.dir", root)
        atexit.register(shutil.rmtree, root.removeprefix("file://"), ignore_errors=True)
    return root.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path that nothing has been written to yet."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    _written.append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The table, written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mark() -> int:
    """Tables written from now on can be deleted by ``clear(spark, mark)``."""
    return len(_written)


def clear(spark: SparkSession, since: int = 0, keep: DataFrame | None = None) -> None:
    """Deletes the tables written since, but those that ``keep`` reads."""
    kept = keep.inputFiles() if keep is not None else []
    kept = {p for p in _written[since:] if any(f"/{p.rsplit('/', 1)[1]}/" in f for f in kept)}
    for p in _written[since:]:
        if p not in kept:
            _delete(spark, p)
    _written[since:] = [p for p in _written[since:] if p in kept]


def release(df: DataFrame) -> None:
    """Deletes the one written table that ``df`` is, which nothing reads any more."""
    name = next((f.rsplit("/", 2)[1] for f in df.inputFiles()), None)
    for p in _written:
        if p.rsplit("/", 1)[1] == name:
            _delete(df.sparkSession, p)
            _written.remove(p)
            return


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
