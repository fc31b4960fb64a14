"""Sessions and intermediate tables."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import sys
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Local folders of very many files, to be deleted when Python ends, for so many seconds; as long as Hadoop's hooks have.
_MANY: list[str] = []
REMOVAL_S = 30


def session(name: str = "plumbline", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; what conf names wins."""
    builder = SparkSession.builder.appName(name)
    for k, v in {"spark.sql.adaptive.enabled": "true", "spark.sql.session.timeZone": "UTC", **conf}.items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shipped(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once a context: they need not find it on their own path."""
    context = spark.sparkContext
    if not getattr(context, "_plumbline_shipped", False):
        package = os.path.dirname(os.path.abspath(__file__))
        archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "plumbline"), "zip", os.path.dirname(package), os.path.basename(package))
        context.addPyFile(archive)
        context._plumbline_shipped = True


def _removed(folder: str, until: float) -> bool:
    """Deletes a local folder and what it holds, one entry after another; no list of them is held, however many there are. False if
    time.monotonic() got to until before that was done."""
    found = os.path.isdir(folder)
    with contextlib.suppress(FileNotFoundError):  # gone meanwhile
        while found:  # some stores leave out entries while others are deleted
            found = False
            with os.scandir(folder) as entries:
                for e in entries:
                    found = True
                    if time.monotonic() >= until or e.is_dir(follow_symlinks=False) and not _removed(e.path, until):
                        return False
                    if not e.is_dir(follow_symlinks=False):
                        os.unlink(e.path)
        os.rmdir(folder)
    return True


@atexit.register
def _ended() -> None:
    until = time.monotonic() + REMOVAL_S
    for folder in [f for f in _MANY if not _removed(f, until)]:
        print(f"{folder} holds very many files; some are left", file=sys.stderr)
    _MANY.clear()


def scratch(spark: SparkSession, name: str, many: bool = False) -> str:
    """A new path in the folder that spark.checkpoint.dir names (one of our own where unset); goes with the session's JVM.

    many: it is to hold a file for each row of a table. Hadoop would list all of them in the JVM's memory to delete a local folder, so
    that goes when Python ends, entry by entry. As with Hadoop, what 30 seconds aren't enough for stays. Other stores delete folders
    themselves.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.gettempdir()}/plumbline-checkpoints"
    folder = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = jpath.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(jpath)  # what isn't there can't be marked
    if many and files.getUri().getScheme() == "file":
        _MANY.append(jpath.toUri().getPath())
    else:
        files.deleteOnExit(jpath)
    return f"{folder}/data"


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df written to scratch() and read again.

    Cuts the lineage of iterative plans so that lost executors cost no recomputation; goes with the session's JVM.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
