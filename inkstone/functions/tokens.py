"""SQL text to tokens, as column expressions that stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import dialects as D
from inkstone.functions.marks import ESCAPE, MARK, TIGHT, AnyDialect, dialect_of, escaped, marked, pieces, unescaped

ALL = {letter: letter for letter in D.LETTERS}
#: Also of what follows a NUL.
PAST_NUL = ALL | {"": "z"}
FIELDS = ("type", "value", "is_table_indicator", "has_digits", "is_simple_identifier")


def token_pieces(sql: Column, dialect: AnyDialect = None, past_nul: bool = False, escapes: bool = True) -> Column:
    """array<string>: each token as a letter for its type and its text. For :func:`described`, also of tokens as rows. ``escapes``:
    whether the text may hold marks."""
    return pieces(marked(escaped(sql) if escapes else sql, dialect_of(dialect), PAST_NUL if past_nul else ALL, spaced=True))


def described(piece: Column, escapes: bool = True) -> list[Column]:
    """The fields of a token. ``escapes``: whether its text may hold escaped marks."""
    text = F.substr(piece, F.lit(2))
    kind = F.get(F.array(*[F.lit(D.LETTERS.get(chr(code))) for code in range(128)]), F.ascii(piece))
    # by how a piece begins: its letter need not be cut out for each
    is_a = lambda letters: reduce(or_, [F.startswith(piece, F.lit(x)) for x in letters])
    return [
        kind.alias("type"),
        (unescaped(text) if escapes else text).alias("value"),
        is_a("DT").alias("is_table_indicator"),
        (is_a("iqQf") & text.rlike("[0-9]")).alias("has_digits"),
        is_a("q").alias("is_simple_identifier"),
    ]


def tokenize(sql: Column, dialect: AnyDialect = None, fields: Sequence[str] = FIELDS, past_nul: bool = False) -> Column:
    """array<struct<type, value, is_table_indicator, has_digits, is_simple_identifier>>; joined values give the text.

    Null gives null. Text from a NUL character on is left out, unless it is inside a dollar quote; with ``past_nul`` the NUL is a token
    of type EOF, and the lexer begins anew after it. ``fields``: those wanted; Spark makes all fields of an array's structs, also those
    that nobody reads.
    """
    at = [FIELDS.index(f) for f in fields]

    def each(escapes: bool) -> Column:
        return F.transform(token_pieces(sql, dialect, past_nul, escapes), lambda p: F.struct(*[described(p, escapes)[i] for i in at]))

    return F.when(reduce(or_, [F.contains(sql, F.lit(c)) for c in (MARK, TIGHT, ESCAPE)]), each(True)).otherwise(each(False))
