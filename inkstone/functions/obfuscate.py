"""Literals and other sensitive values to placeholders."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions import dialects as D
from inkstone.functions.dialects import Dialect
from inkstone.functions.marks import MARK, AnyDialect, by_dialect, dialect_of, escaped, let, marked, marking, unescaped

PLACEHOLDER = "?"
_BODY = "$func$"
#: Letters of literals.
LITERALS = "SOnd"


@dataclass(frozen=True)
class ObfuscatorConfig:
    replace_digits: bool = False
    replace_positional_parameter: bool = False
    replace_boolean: bool = False
    replace_null: bool = False
    dollar_quoted_func: bool = False
    keep_json_path: bool = False
    replace_bind_parameter: bool = False

    @property
    def hidden(self) -> str:
        """Letters of the tokens that are replaced whatever stands before them."""
        wanted = (("P", self.replace_positional_parameter), ("b", self.replace_bind_parameter), ("B", self.replace_boolean), ("N", self.replace_null), ("F", not self.dollar_quoted_func))
        return "".join(letter for letter, hide in wanted if hide)


def trim(text: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def shown_letters(config: ObfuscatorConfig) -> dict[str, str]:
    """What :func:`hide` needs to know of tokens: ``l`` literals, ``r`` others to replace, ``F`` function bodies that stay."""
    letters = dict.fromkeys(LITERALS, "l") | dict.fromkeys(config.hidden, "r" if config.keep_json_path else "l")
    letters |= {"f": "f", "i": "i", "q": "q", "Q": "q", "K": "K", "T": "K", "s": "s", "c": "s", "m": "s"}
    return letters | ({"j": "j"} if config.keep_json_path else {}) | ({"F": "F"} if config.dollar_quoted_func else {})


def each_body(marks: Column, rewrite: Callable[[Column], Column]) -> Column:
    """The bodies of ``$func$`` quotes rewritten. Statements without one, which are most, pass as they are."""

    def one(piece: Column) -> Column:
        body = F.substring(piece, F.lit(8), F.length(piece) - 13)
        return F.when(piece.startswith(f"F{_BODY}"), F.concat(F.lit(f"F{_BODY}"), rewrite(body), F.lit(_BODY))).otherwise(piece)

    return let(marks, lambda m: F.when(F.contains(m, F.lit(f"{MARK}F")), F.array_join(F.transform(F.split(m, MARK), one), MARK)).otherwise(m))


def hide(marks: Column, config: ObfuscatorConfig, dialect: Dialect | Column, trivia: bool) -> Column:
    """A marked text with placeholders. ``trivia``: whether spaces and comments are still in it, under ``s``."""
    gap = rf"(?:{MARK}s[^{MARK}]*+)*+" if trivia else ""
    if config.keep_json_path:
        marks = F.regexp_replace(marks, rf"({MARK}j[^{MARK}]*+{gap}{MARK})l", "$1y")
    # the field of EXTRACT(field FROM ...)
    marks = F.regexp_replace(marks, rf"({MARK}f(?i:EXTRACT){MARK}x\({gap}{MARK}[iKT])(?i:{D.words_pattern(D.EXTRACT_FIELDS)})(?={MARK}|\z)", f"$1{PLACEHOLDER}")
    marks = F.regexp_replace(marks, rf"{MARK}[lr][^{MARK}]*+", f"{MARK}x{PLACEHOLDER}")
    if config.replace_digits:
        marks = F.regexp_replace(marks, rf"({MARK}[iqQ][^{MARK}0-9]*+|(?!\A)\G[^{MARK}0-9]*+)[0-9]++", f"$1{PLACEHOLDER}")
    if config.dollar_quoted_func:
        # a body holds no further $func$ quote, so one level is all there is
        marks = each_body(marks, lambda body: _obfuscated(body, replace(config, dollar_quoted_func=False), dialect))
    return marks


def _obfuscated(text: Column, config: ObfuscatorConfig, dialect: Dialect | Column) -> Column:
    """Of an escaped text."""
    hidden = hide(marked(text, dialect, shown_letters(config)), config, dialect, trivia=True)
    whole = F.regexp_replace(hidden, rf"{MARK}[A-Za-z]", "")
    if not (config.keep_json_path or config.replace_digits or config.dollar_quoted_func):
        # only an EXTRACT call needs to know what tokens are; else the text of a token to replace is left out as it is cut
        def cut_in(d: Dialect) -> Column:
            pattern, shown, end = marking(d, dict.fromkeys(LITERALS + config.hidden, "l"))
            kept = next(part for part in shown.split(MARK) if part.startswith("x"))
            return F.regexp_replace(text, pattern, f"{MARK}{kept[1:]}${end}")  # a NUL is no token to replace

        cut = by_dialect(dialect, cut_in)
        cut = F.when(F.contains(text, F.lit("\0")), F.regexp_replace(cut, rf"{MARK}\x00\z", "")).otherwise(cut)
        plain = F.replace(F.regexp_replace(cut, rf"{MARK}(?={MARK}|\z)", PLACEHOLDER), F.lit(MARK), F.lit(""))
        whole = F.when(text.rlike(r"(?i)extract\("), whole).otherwise(plain)
    return trim(whole)


def obfuscate(sql: Column, config: ObfuscatorConfig | None = None, dialect: AnyDialect = None) -> Column:
    """The text with placeholders; white space and comments stay, but for white space at the ends."""
    return unescaped(_obfuscated(escaped(sql), config or ObfuscatorConfig(), dialect_of(dialect)))


def obfuscate_token_value(kind: Column, value: Column, last_kind: Column | None = None, config: ObfuscatorConfig | None = None, dialect: AnyDialect = None) -> Column:
    """A token's value after obfuscation, for tokens as rows. ``last_kind``: type of the value token before it, null if there is none."""
    config = config or ObfuscatorConfig()
    literal = kind.isin([D.LETTERS[x] for x in LITERALS])
    if config.keep_json_path and last_kind is not None:
        literal &= ~F.coalesce(last_kind == "JSON_OP", F.lit(False))
    out = F.when(literal | kind.isin([D.LETTERS[x] for x in config.hidden] or [""]), PLACEHOLDER)
    if config.dollar_quoted_func:
        body = F.substring(value, F.lit(7), F.greatest(F.length(value) - 12, F.lit(0)))
        inner = obfuscate(body, replace(config, dollar_quoted_func=False), dialect)
        out = out.when(kind == "DOLLAR_QUOTED_FUNCTION", F.concat(F.lit(_BODY), inner, F.lit(_BODY)))
    if config.replace_digits:
        out = out.when(kind.isin("IDENT", "QUOTED_IDENT"), F.regexp_replace(value, "[0-9]+", PLACEHOLDER))
    return out.otherwise(value)
