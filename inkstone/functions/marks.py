"""Texts in which each token is marked with its type: what the statement functions rewrite.

One regular expression cuts a text and says of each token what it is: each type has a group, and each token is replaced by a mark
and a letter for every group, of which only the one that matched has text; the empty ones are removed after. Rules over tokens
are then replacements over the marked text, all in compiled code and in time that grows with the text. Nothing is done per token
by a lambda function.

A token is ``MARK letter text``, or ``TIGHT letter text`` if no space goes before it. Characters of the text that are marks
themselves are escaped first and put back last.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import dialects as D
from inkstone.functions.dialects import Dialect

MARK, TIGHT, ESCAPE = "\x01", "\x02", "\x03"
_ESCAPES = {"\x03": "\x03\x06", "\x01": "\x03\x04", "\x02": "\x03\x05"}
#: The letter of tokens of which no more is asked.
OTHER = "x"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def any_of(column: Column, values: Iterable[str]) -> Column:
    """Whether a column has one of the values; unlike ``isin`` it can be written as SQL."""
    return reduce(or_, [column == v for v in values])


def escaped(text: Column) -> Column:
    for plain, sent in _ESCAPES.items():
        text = F.replace(text, F.lit(plain), F.lit(sent))
    return text


def unescaped(text: Column) -> Column:
    for plain, sent in reversed(_ESCAPES.items()):
        text = F.replace(text, F.lit(sent), F.lit(plain))
    return text


#: A dialect, its name, or a column with names.
AnyDialect = Dialect | str | Column | None


def dialect_of(dialect: AnyDialect) -> Dialect | Column:
    return dialect if isinstance(dialect, Column) else Dialect.of(dialect)


def by_dialect(dialect: Dialect | Column, of: Callable[[Dialect], Column]) -> Column:
    """The expression for a dialect. For a column of names it is a choice, so it should be no more than what dialects read
    differently, which is the cut alone. Case doesn't matter; other names, and null, are generic. A constant leaves one branch."""
    if isinstance(dialect, Dialect):
        return of(dialect)
    name = F.lower(dialect)
    plain = of(Dialect.GENERIC)
    chosen = None
    for d in (Dialect.MSSQL, Dialect.MYSQL, Dialect.ORACLE, Dialect.SNOWFLAKE):  # PostgreSQL has no rule of its own
        names = [d.value, *(alias for alias, of_ in D.ALIASES.items() if of_ == d.value)]
        chosen = (F if chosen is None else chosen).when(any_of(name, names), of(d))
    return chosen.otherwise(plain)


def marking(dialect: Dialect, letters: Mapping[str, str], spaced: bool = False) -> tuple[str, str, int]:
    """Pattern and replacement that put a mark and a letter before each token, and the number of the group that a NUL which ends the
    text is. ``letters``: those shown instead of the letters of
    :data:`~inkstone.functions.dialects.LETTERS`; the others are shown as ``OTHER``. What follows a NUL is left out, unless a letter is
    given for ``""``, as which NULs are shown. ``spaced``: spaces and the token after them are found at once, so that marks are written
    half as often, and words are looked for at once before they are told apart; spaces must have a letter of their own."""
    parts, groups, n = [], {}, 0
    for letter, pattern in D.token_patterns(dialect):
        if not letter and not letters.get(letter):  # the last one
            parts.append(rf"({pattern})[\s\S]*+")
            continue
        n += 1
        groups.setdefault(letters.get(letter, OTHER), []).append(n)
        if "{tag}" in pattern:
            n += 1
            pattern = pattern.replace("{tag}", str(n))
        parts.append(f"({pattern})")
    if spaced:
        at = [i for i, (letter, _) in enumerate(D.token_patterns(dialect)) if letter in D.WORDS]
        parts[at[0] : at[-1] + 1] = [f"(?={D.ANY_WORD})(?:{'|'.join(parts[at[0] : at[-1] + 1])})"]
        spaces, *rest = parts  # at any place spaces come first
        parts = [rf"{spaces.replace('++', '*+')}(?:{'|'.join(rest)}|\z)"]
    # a group's number ends where no digit follows it: the next is a mark or another group
    return "|".join(parts), "".join(f"{MARK}{shown}" + "".join(f"${k}" for k in numbers) for shown, numbers in groups.items()), n + 1


def marked(text: Column, dialect: Dialect | Column, letters: Mapping[str, str], spaced: bool = False) -> Column:
    """An escaped text with its tokens marked. ``spaced``: see :func:`marking`."""
    cut = by_dialect(dialect, lambda d: F.regexp_replace(text, *marking(d, letters, spaced)[:2]))
    # marks up to the last one of a run, which is the token's own: given back at its end, and not asked for at each mark
    return F.regexp_replace(cut, rf"(?:{MARK}[A-Za-z])+(?={MARK}|\z)", "")


def pieces(marks: Column) -> Column:
    """array<string>: letter and text of each token."""
    return F.array_remove(F.split(marks, MARK), "")  # what stands before the first mark
