"""The operations for use from SQL: a view with their results as columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.dialects import Dialect
from inkstone.functions.normalize import NormalizerConfig, obfuscate_and_normalize
from inkstone.functions.obfuscate import ObfuscatorConfig, obfuscate
from inkstone.functions.tokens import tokenize


def create_statement_view(df: DataFrame, name: str, sql_col: str = "sql", dialect: Dialect | str | None = None, obfuscator: ObfuscatorConfig | None = None, config: NormalizerConfig | None = None) -> SparkSession:
    """A temporary view with ``tokens``, ``obfuscated_sql``, ``normalized_sql`` and ``metadata`` beside the columns of ``df``.

    A query pays only for the columns that it names; ``normalized_sql`` and ``metadata`` are made together.
    """
    sql = F.col(sql_col)
    made = df.withColumns({"tokens": tokenize(sql, dialect), "obfuscated_sql": obfuscate(sql, obfuscator, dialect), "__made": obfuscate_and_normalize(sql, obfuscator, config, dialect)})
    made.withColumns({"normalized_sql": F.col("__made.sql"), "metadata": F.col("__made.metadata")}).drop("__made").createOrReplaceTempView(name)
    return df.sparkSession
