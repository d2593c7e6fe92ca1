"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, a local folder is set if the whole of Spark is in this
    process (tests, one machine); on a cluster that is an error, since executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="inkstone-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_deleted(spark: SparkSession) -> Iterator[None]:
    """Has Spark delete the shuffle files of a write when it ends, and not when the driver next collects its garbage. The session's
    setting is put back."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


class Scratch:
    """Writes DataFrames as Parquet to cut their lineage; a lost executor takes nothing of them along."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        self.kept: set[str] = set()

    def path(self, name: str) -> str:
        return f"{self.base}/{name}"

    def keep(self, df: DataFrame, name: str, options: dict[str, int | str] | None = None) -> DataFrame:
        with _shuffles_deleted(self.spark):
            df.write.mode("overwrite").options(**options or {}).parquet(self.path(name))
        self.kept.add(name)
        return self.spark.read.parquet(self.path(name))

    def keep_parts(self, df: DataFrame, name: str, by: str, options: dict[str, int | str] | None = None) -> None:
        """As :meth:`keep`, with a folder for each value of the column ``by``: see :meth:`part`."""
        with _shuffles_deleted(self.spark):
            df.write.mode("overwrite").options(**options or {}).partitionBy(by).parquet(self.path(name))
        self.kept.add(name)

    def part(self, df: DataFrame, name: str, by: str, value: str) -> DataFrame:
        """The rows of one value in the table that ``df`` was written as. ``drop(f"{name}/{by}={value}")`` deletes them alone."""
        return self.spark.read.schema(df.schema).parquet(self.path(name)).where(F.col(by) == value).drop(by)

    def drop(self, *names: str) -> None:
        """Deletes tables that no lazy result refers to any more."""
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(conf).delete(path, True)
            self.kept.discard(name)

    def drop_all_but(self, *names: str) -> None:
        self.drop(*sorted(self.kept - set(names)))
