"""Operations on DataFrames of SQL statements. Each is one projection, with no shuffle but where counts ask for one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.functions.dialects import Dialect
from inkstone.functions.normalize import NormalizerConfig, normalize, obfuscate_and_normalize
from inkstone.functions.obfuscate import ObfuscatorConfig, obfuscate
from inkstone.functions.tokens import described, token_pieces, tokenize


def _dialect(dialect: Dialect | str | None, dialect_col: str | None) -> Dialect | str | Column | None:
    return dialect if dialect_col is None else F.col(dialect_col)


def with_tokens(df: DataFrame, sql_col: str = "sql", dialect: Dialect | str | None = None, dialect_col: str | None = None, out: str = "tokens") -> DataFrame:
    return df.withColumn(out, tokenize(F.col(sql_col), _dialect(dialect, dialect_col)))


def token_rows(df: DataFrame, sql_col: str = "sql", dialect: Dialect | str | None = None, dialect_col: str | None = None) -> DataFrame:
    """One row per token, with its position from 0; the other columns but the text stay."""
    kept = [c for c in df.columns if c != sql_col]
    cut = df.withColumn("__pieces", token_pieces(F.col(sql_col), _dialect(dialect, dialect_col)))
    # described as rows, where expressions are compiled; fields that nobody asks for are left out
    # outer: else Spark infers a filter on the size of the array, and cuts each text a second time to check it, before any exchange
    rows = cut.select(*kept, F.posexplode_outer("__pieces").alias("pos", "__piece")).where("__piece IS NOT NULL")
    return rows.select(*kept, "pos", *described(F.col("__piece")))


def with_obfuscated(df: DataFrame, config: ObfuscatorConfig | None = None, sql_col: str = "sql", dialect: Dialect | str | None = None, dialect_col: str | None = None, out: str = "obfuscated_sql") -> DataFrame:
    return df.withColumn(out, obfuscate(F.col(sql_col), config, _dialect(dialect, dialect_col)))


def with_normalized(df: DataFrame, config: NormalizerConfig | None = None, obfuscator: ObfuscatorConfig | None = None, sql_col: str = "sql", dialect: Dialect | str | None = None, dialect_col: str | None = None) -> DataFrame:
    """``normalized_sql`` and ``metadata``; with an obfuscator, of the obfuscated statement."""
    sql, name = F.col(sql_col), _dialect(dialect, dialect_col)
    made = df.withColumn("__made", normalize(sql, config, name) if obfuscator is None else obfuscate_and_normalize(sql, obfuscator, config, name))
    return made.withColumns({"normalized_sql": F.col("__made.sql"), "metadata": F.col("__made.metadata")}).drop("__made")


#: Most combinations of configurations in one table for :func:`with_normalized_by_row`.
MOST_CONFIGS = 128


def with_normalized_by_row(df: DataFrame, sql_col: str = "sql", dialect_col: str | None = None, obfuscator_col: str = "obfuscator", normalizer_col: str = "normalizer") -> DataFrame:
    """As :func:`with_normalized`, each row by its own configurations: maps from option to boolean, of which missing options are
    false. A null obfuscator map leaves a statement as it is, a null normalizer map has no option. Options that are not known, and more
    than ``MOST_CONFIGS`` combinations, are errors.

    The combinations that occur are found first, summed before the shuffle; then one pass over the rows chooses among them.
    """

    def text(col: str) -> Column:
        on = F.filter(F.map_entries(F.col(col)), lambda e: e["value"])
        return F.array_join(F.array_sort(F.transform(on, lambda e: F.lower(e["key"]))), ",")

    rows = df.withColumns({"__o": text(obfuscator_col), "__n": F.coalesce(text(normalizer_col), F.lit(""))})
    found = rows.select("__o", "__n").distinct().limit(MOST_CONFIGS + 1).collect()
    if len(found) > MOST_CONFIGS:
        raise ValueError(f"more than {MOST_CONFIGS} combinations of configurations")
    made, sql, name = None, F.col(sql_col), _dialect(None, dialect_col)
    for o, n in found:
        options = lambda listed: dict.fromkeys(filter(None, listed.split(",")), True)
        config = NormalizerConfig(**options(n))
        of = normalize(sql, config, name) if o is None else obfuscate_and_normalize(sql, ObfuscatorConfig(**options(o)), config, name)
        made = (F if made is None else made).when(F.col("__o").eqNullSafe(F.lit(o)) & (F.col("__n") == n), of)
    made = normalize(sql, None, name) if made is None else made
    return rows.withColumn("__made", made).withColumns({"normalized_sql": F.col("__made.sql"), "metadata": F.col("__made.metadata")}).drop("__made", "__o", "__n")


def distinct_statements(df: DataFrame, *cols: str) -> DataFrame:
    """Each distinct row of ``cols`` with the number of ``statements`` that it stands for."""
    return df.groupBy(*cols).agg(F.count("*").alias("statements"))


#: Statements looked at to tell whether a table repeats its texts, and the part of distinct ones from which it doesn't.
LOOKED_AT, DISTINCT = 20_000, 0.5


def repeats_texts(df: DataFrame, *cols: str) -> bool:
    """Whether few of the first ``LOOKED_AT`` rows are distinct. The driver gets their hashes."""
    seen = df.select(F.xxhash64(*cols)).limit(LOOKED_AT).toArrow().column(0).to_pylist()
    return len(set(seen)) < DISTINCT * len(seen)


def fingerprint_counts(df: DataFrame, obfuscator: ObfuscatorConfig | None = None, config: NormalizerConfig | None = None, sql_col: str = "sql", dialect: Dialect | str | None = None, dialect_col: str | None = None, repeats: bool | None = None) -> DataFrame:
    """Statements per fingerprint, that is per obfuscated and normalized text; counts are summed before each shuffle.

    ``repeats``: whether texts repeat, so that it pays to bring equal ones together and read them once, at the price of a shuffle of
    texts. Else each is read where it is and only fingerprints are shuffled. None: a look at the first rows tells; results
    do not depend on it. Streams have no first rows, and aren't brought together.
    """
    cols = [sql_col, *([dialect_col] if dialect_col else [])]
    if repeats is None:
        repeats = not df.isStreaming and repeats_texts(df, *cols)
    texts = distinct_statements(df, *cols) if repeats else df.select(*cols, F.lit(1).cast("long").alias("statements"))
    made = with_normalized(texts, config, obfuscator or ObfuscatorConfig(), sql_col, dialect, dialect_col)
    return made.groupBy("normalized_sql").agg(F.sum("statements").alias("statements"))
