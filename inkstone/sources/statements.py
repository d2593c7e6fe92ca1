"""Reading and writing SQL statements."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Parts that each part of a table is dealt into. Spark reads 128 MB of a file at once, which may be millions of statements.
PARTS = 16


def parts_of(table: DataFrame) -> int:
    """Parts in which to work on the statements of a table that is read from files: they grow in number with it, not in size."""
    return max(table.sparkSession.sparkContext.defaultParallelism, PARTS * table.rdd.getNumPartitions())


def spread(table: DataFrame) -> DataFrame:
    """A table dealt over its parts: the work on a statement is far more than moving it."""
    return table.repartition(parts_of(table))


def read_statements(spark: SparkSession, path: str, format: str = "text", sql_col: str = "sql", **options) -> DataFrame:
    """Statements in a column ``sql``.

    ``text``: one statement per file; line ends become line feeds and the last one is dropped. ``lines``: one per line.
    Any other format that Spark reads, such as ``parquet``, ``json``, ``csv`` or ``orc``: those of column ``sql_col``.
    """
    if format == "text":
        whole = F.regexp_replace(F.regexp_replace("value", "\r\n", "\n"), r"\r?\n\z", "")
        return spark.read.text(path, wholetext=True, **options).select(whole.alias("sql"))
    if format == "lines":
        return spark.read.text(path, **options).select(F.col("value").alias("sql"))
    return spark.read.format(format).options(**options).load(path).withColumnRenamed(sql_col, "sql")


def write_results(df: DataFrame, path: str, format: str = "parquet", mode: str = "errorifexists", **options) -> None:
    """Any format that Spark writes; ``text`` needs a single string column."""
    df.write.format(format).mode(mode).options(**options).save(path)


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, or the warehouse where it is unset. On a cluster the warehouse may be a folder of the driver, so there
    it is an error if neither is set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master) and not spark.sparkContext.getConf().get("spark.sql.warehouse.dir"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    return root.rstrip("/")


def write_file(df: DataFrame, path: str) -> None:
    """One text file of a single string column. The parts are written by all tasks, then appended in order through the file
    system, a buffer at a time; a file that is there is replaced once all are."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    work = f"{path}.{uuid.uuid4().hex}"
    parts, whole = jvm.org.apache.hadoop.fs.Path(f"{work}.parts"), jvm.org.apache.hadoop.fs.Path(f"{work}.whole")
    try:
        df.write.text(parts.toString())
        out = files.create(whole, True)
        try:
            for status in sorted(files.listStatus(parts), key=lambda s: s.getPath().getName()):
                if status.getPath().getName().startswith("part-"):
                    read = files.open(status.getPath())
                    try:
                        jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 20, False)
                    finally:
                        read.close()
        finally:
            out.close()
        files.delete(target, True)
        files.rename(whole, target)
    finally:
        files.delete(parts, True)
        files.delete(whole, True)
