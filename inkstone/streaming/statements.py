"""Streams of SQL statements. The operations are projections, so a stream needs no state for them; counts per fingerprint and
time window keep state under a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkstone.functions.dialects import Dialect
from inkstone.functions.normalize import NormalizerConfig
from inkstone.functions.obfuscate import ObfuscatorConfig
from inkstone.operators.statements import with_normalized


def normalized_stream(stream: DataFrame, obfuscator: ObfuscatorConfig | None = None, config: NormalizerConfig | None = None, sql_col: str = "sql", dialect: Dialect | str | None = None) -> DataFrame:
    """The stream with ``normalized_sql`` and ``metadata``."""
    return with_normalized(stream, config, obfuscator or ObfuscatorConfig(), sql_col, dialect)


def windowed_fingerprints(stream: DataFrame, ts_col: str, window: str = "5 minutes", late: str = "10 minutes", **options) -> DataFrame:
    """Statements per time window and fingerprint; rows later than ``late`` are left out."""
    made = normalized_stream(stream.withWatermark(ts_col, late), **options)
    counts = made.groupBy(F.window(ts_col, window), "normalized_sql").agg(F.count("*").alias("statements"))
    return counts.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "normalized_sql", "statements")
