"""Stored indexes: names are analysed once and searched often."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from onomast.sources.schema import index

_written: dict[tuple, tuple[tuple, str, object]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; a temporary one where all run on one machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='onomast-')}"
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The table written to the shared folder and read again: its rows are fixed and executors may be lost."""
    path = f"{shared_folder(df.sparkSession)}/onomast-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def write_index(df: DataFrame, path: str, synonyms: dict[str, dict[str, list[str]]] | None = None) -> DataFrame:
    """Analyses the columns of df, writes them below path and reads them again."""
    made = index(df, synonyms)
    made.write.mode("overwrite").parquet(path)
    return open_index(made.sparkSession, path, made.schema)


def open_index(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """A stored index; searches read the columns that they need only."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def version_of(spark: SparkSession, path: str) -> tuple:
    """Names, sizes and times of a table's files, by which a change on disk is noticed."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in files))


def kept(spark: SparkSession, key: tuple, version: tuple, make: Callable[[str], object]) -> object:
    """What `make` writes below a new folder and returns, made once an application, key and version; what an older version left behind is deleted."""
    key = (spark.sparkContext.applicationId, *key)
    if key in _written and _written[key][0] != version:
        removed(spark, _written.pop(key)[1])
    if key not in _written:
        path = f"{shared_folder(spark)}/onomast-index-{uuid.uuid4().hex}"
        _written[key] = version, path, make(path)
    return _written[key][2]


def stored(spark: SparkSession, key: tuple, make: Callable[[], DataFrame], version: tuple = ()) -> DataFrame:
    """The table that `make` gives, written once an application, key and version, and read from then on."""

    def write(path: str) -> DataFrame:
        df = make()
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    return kept(spark, key, version, write)
