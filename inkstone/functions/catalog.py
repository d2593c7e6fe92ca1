"""The functions for use in SQL, made from the same expressions as the column functions."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from inkstone.functions.normalize import NormalizerConfig, normalize, obfuscate_and_normalize
from inkstone.functions.obfuscate import ObfuscatorConfig, obfuscate
from inkstone.functions.tokens import tokenize

METADATA = "STRUCT<size: INT, tables: ARRAY<STRING>, comments: ARRAY<STRING>, commands: ARRAY<STRING>, procedures: ARRAY<STRING>>"
STATEMENT = f"STRUCT<sql: STRING, metadata: {METADATA}>"
TOKENS = "ARRAY<STRUCT<type: STRING, value: STRING, is_table_indicator: BOOLEAN, has_digits: BOOLEAN, is_simple_identifier: BOOLEAN>>"


#: Operators, which an expression's text has as functions before a parenthesis, and texts in quotes, which stay as they are.
_CALLED = re.compile(r"('(?:[^'\\]|\\.)*')|(?<![\w`])(<=>|[=<>+*/%!-]+|and|or|not|in)(?=\()", re.S)


def _text(column: Column) -> str:
    """An expression as SQL."""
    return _CALLED.sub(lambda m: m[1] or f"`{m[2]}`", column._jc.node().sql())


def create_functions(spark: SparkSession, obfuscator: ObfuscatorConfig | None = None, config: NormalizerConfig | None = None, prefix: str = "", database: str | None = None) -> list[str]:
    """``tokenize``, ``obfuscate``, ``normalize`` and ``obfuscate_and_normalize``, each of a text and the name of a dialect, which may be
    left out; returns their names. They are temporary unless a ``database`` is named that is to keep them. Configurations are
    part of the functions: a prefix tells several sets apart. A constant dialect costs as much as none."""
    sql, dialect = F.col("sql"), F.col("dialect")
    made: dict[str, tuple[str, Callable[[], Column]]] = {
        "tokenize": (TOKENS, lambda: tokenize(sql, dialect)),
        "obfuscate": ("STRING", lambda: obfuscate(sql, obfuscator, dialect)),
        "normalize": (STATEMENT, lambda: normalize(sql, config, dialect)),
        "obfuscate_and_normalize": (STATEMENT, lambda: obfuscate_and_normalize(sql, obfuscator, config, dialect)),
    }
    names = []
    for name, (kind, column) in made.items():
        full = f"{database}.{prefix}{name}" if database else prefix + name
        spark.sql(f"CREATE OR REPLACE {'' if database else 'TEMPORARY '}FUNCTION {full}(sql STRING, dialect STRING DEFAULT '') RETURNS {kind} RETURN ({_text(column())})")
        names.append(full)
    return names
