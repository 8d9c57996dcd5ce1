"""A session with what the engine relies on: UTC and adaptive execution; tables that are written once and read again."""

from __future__ import annotations

import os
import shutil
import tempfile

from uuid import uuid4
from weakref import WeakKeyDictionary

from pyspark.sql import DataFrame, SparkSession


def get_session(name: str = "vesselwatch", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, once per application: they need not have it installed."""
    sc = spark.sparkContext
    if any(f.endswith("/vesselwatch-package.zip") for f in sc.listFiles):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="spark-package-")
    shutil.copytree(package, f"{made}/tree/vesselwatch", ignore=shutil.ignore_patterns("__pycache__"))
    sc.addPyFile(shutil.make_archive(f"{made}/vesselwatch-package", "zip", f"{made}/tree"))


#: By application: the temporary folder of one that has none set.
_own_folders: dict[str, str] = {}


def _setting(spark: SparkSession) -> str | None:
    return spark.conf.get("spark.checkpoint.dir", None)


def shared_dir(spark: SparkSession) -> str:
    """This application's folder for intermediate tables, below ``spark.checkpoint.dir``; it goes when the application ends.

    Where that setting is missing a session on one machine gets a temporary folder; on a cluster only the
    user knows a folder that driver and executors share.
    """
    base = _setting(spark)
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_folders:
            _own_folders[app] = "file://" + tempfile.mkdtemp(prefix="spark-tables-")
        base = _own_folders[app]
    path = f"{base.rstrip('/')}/tables-{spark.sparkContext.applicationId}"
    folder, files = _folder(spark, path)
    files.deleteOnExit(folder)
    return path


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark._jsc.hadoopConfiguration())


_stored: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: it is computed once and its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _stored[back] = path
    return back


def discard(*tables: DataFrame) -> None:
    """Delete tables of ``stored`` that nothing will read any more."""
    for df in tables:
        folder, files = _folder(df.sparkSession, _stored.pop(df))
        files.delete(folder, True)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate data if it is there."""
    folder, files = _folder(spark, path)
    files.delete(folder, True)


def write_small_file(spark: SparkSession, path: str, text: str) -> None:
    """A file of a few lines in any store that Spark reaches, replaced if it is there."""
    file, files = _folder(spark, path)
    out = files.create(file, True)
    out.write(bytearray(text.encode()))
    out.close()
