"""Work tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

_TABLES: list[str] = []
#: Written tables get no checksum files on local folders; there Hadoop starts a `chmod` for each file and folder it makes,
#: a child that shares all memory of the Java process until it is loaded. Other stores do not read these options.
_PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


@lru_cache(maxsize=1)
def _own_folder() -> str:
    path = tempfile.mkdtemp(prefix="strataframe-")
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path


def work_dir(spark: SparkSession) -> str:
    """The folder that all executors share; a folder of our own only in local mode, where none is set."""
    if shared := spark.conf.get("spark.checkpoint.dir", None):
        return shared
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return _own_folder()


@contextlib.contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Remove the tables that are written inside once their reader, inside too, has stored its result."""
    first = len(_TABLES)
    try:
        yield
    finally:
        for path in _TABLES[first:]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
        del _TABLES[first:]


@contextlib.contextmanager
def each_key_in_one_task(spark: SparkSession, tasks: int | None = None) -> Iterator[None]:
    """What is written inside keeps rows dealt by fewer columns than a join has keys where they are, and drops its shuffle
    files when it has ended; `tasks` sets how many tasks it deals rows to. All are settings of the session, put back after."""
    inside = {"spark.sql.requireAllClusterKeysForCoPartition": "false", "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
    inside |= {"spark.sql.shuffle.partitions": str(tasks)} if tasks else {}
    before = {name: spark.conf.get(name, None) for name in inside}
    try:
        for name, value in inside.items():
            spark.conf.set(name, value)
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def new_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A path for a table that is removed when the application ends, or before by `dropping_tables` unless `keep`."""
    path = f"{work_dir(spark)}/strataframe/{name}-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    if not keep:
        _TABLES.append(path)
    return path


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write `df` as Parquet in the shared folder and read it back: cuts lineage and outlives lost executors."""
    path = new_path(df.sparkSession, name, keep)
    df.write.options(**_PLAIN_FILES).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
