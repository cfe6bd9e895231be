"""Tables that cut lineage, written to the folder all machines of a cluster share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``. Only a local master may leave it unset; it then gets a private folder, removed at exit."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        app = spark.sparkContext.applicationId
        if app not in _own:
            _own[app] = tempfile.mkdtemp(prefix="quireflow-")
            atexit.register(shutil.rmtree, _own[app], ignore_errors=True)
        found = "file://" + _own[app]
    return found.rstrip("/")


def written(df: DataFrame, label: str, packed: bool = False) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    ``packed`` columns are compressed already: Parquet leaves them as they are, and
    neither writer nor readers hold a second copy of each page outside the heap. A lost executor then costs a re-read, not the whole lineage. A table that
    is replaced is given to ``dropped``; the folder's owner removes the rest,
    which nothing reads after the result is written.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quireflow/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression="none" if packed else None)
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    return out


@contextmanager
def tidied(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of each query in here go when it ends, not when the driver happens to collect its garbage: for steps that are all ``written``."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


#: Bytes of files up to which a table is broadcast.
SMALL = 8 << 20


def small(table: DataFrame) -> DataFrame:
    """A table made by ``written``, marked for a broadcast if its files have ``SMALL`` bytes at most; a larger one is joined by a shuffle."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._written_at)
    size = path.getFileSystem(table.sparkSession.sparkContext._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    return F.broadcast(table) if size <= SMALL else table


def dropped(*tables: DataFrame | None) -> None:
    """Remove tables made by ``written`` that no later step and no result reads."""
    for t in tables:
        if t is not None:
            path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(t._written_at)
            path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
