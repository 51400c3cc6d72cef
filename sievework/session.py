"""Session settings and the shared scratch folder used to cut lineage."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cores: str | int = "*", app: str = "sievework", **conf: str) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    share_package(spark)
    return spark


def share_package(spark: SparkSession) -> None:
    """Let the executors import this package wherever the driver was started from.

    The driver serves a zip of the sources to every executor, later ones included.
    """
    if spark.conf.get("sievework.shared", None):
        return
    package = Path(__file__).resolve().parent
    # Only the driver reads this folder; Spark sends the file on.
    made = shutil.make_archive(
        f"{tempfile.mkdtemp(prefix='run-')}/sievework", "zip", package.parent, package.name
    )
    spark.sparkContext.addPyFile(made)
    spark.conf.set("sievework.shared", made)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist: a machine-local folder would not be visible to other
    executors. Only a local master without the setting gets a folder of its own.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    if context.master != "local" and not context.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder; nothing is ever overwritten."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


#: Paths given out by this process and not yet cleared.
_made: list[str] = []


def clear_scratch(spark: SparkSession, since: int = 0) -> int:
    """Delete what this process has written to the shared folder; tables read from it are gone then.

    ``since`` keeps the first so many paths. Returns how many were deleted.
    """
    paths, _made[since:] = _made[since:], []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return len(paths)


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Everything written to the shared folder inside the block is deleted at its end."""
    since = len(_made)
    try:
        yield
    finally:
        clear_scratch(spark, since)


class TooMany(ValueError):
    """A table that should have been small is not."""


def collect_few(df: DataFrame, what: str, most: int = 1_000_000) -> list:
    """Rows of a table that is small by nature; raises instead of filling the driver if it is not."""
    found = df.limit(most + 1).collect()
    if len(found) > most:
        raise TooMany(f"more than {most} {what}")
    return found


def materialize(df: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and lets later passes reuse the rows; a lost executor re-reads the files.
    With ``by`` the files are split by those columns, so a filter on them reads only its part.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
