"""Canonical SQL text and statement metadata, as a chain of replacements over marked texts (see :mod:`inkstone.functions.marks`).

Each rule is one replacement over all tokens of a statement, so its cost grows with the statement's length. Rules that look at
the token before run while all tokens are still there; a token that a rule drops may leave an empty one behind. Only a statement that
begins with a parenthesis is taken apart into an array, to find where that parenthesis ends.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from inkstone.functions.dialects import Dialect
from inkstone.functions.marks import ESCAPE, MARK, TIGHT, AnyDialect, any_of, dialect_of, escaped, let, marked, unescaped
from inkstone.functions.obfuscate import ObfuscatorConfig, each_body, hide, shown_letters, trim

STRINGS = "array<string>"

SEP, TEXT = f"[{MARK}{TIGHT}]", f"[^{MARK}{TIGHT}]"
END = rf"(?={SEP}|\z)"
HOLE, COMMA, CLOSE = (rf"[A-Za-z]{what}{END}" for what in (r"\?", ",", r"[)\]]"))
#: Letters of identifiers; G: a quoted one that keeps its quotes as an alias. Those of names: identifiers and functions.
IDENTS, NAMES = "[iqQG]", "[iqQf]"
#: An empty token that the collapse of lists leaves behind.
EMPTY = rf"(?:{TIGHT}b{END})?+"


@dataclass(frozen=True)
class NormalizerConfig:
    collect_tables: bool = False
    collect_commands: bool = False
    collect_comments: bool = False
    collect_procedures: bool = False
    keep_sql_alias: bool = False
    uppercase_keywords: bool = False
    remove_space_between_parentheses: bool = False
    keep_trailing_semicolon: bool = False
    keep_identifier_quotation: bool = False


def _letters(config: NormalizerConfig, obfuscator: ObfuscatorConfig | None) -> dict[str, str]:
    letters = shown_letters(obfuscator) if obfuscator else {"F": "F"}
    letters |= {x: x for x in "CKAfiqQ"} | {"D": "D" if config.collect_tables else "C", "T": "T" if config.collect_tables else "K"}
    letters |= dict.fromkeys("scm", "s") | (dict.fromkeys("cm", "c") if config.collect_comments else {})
    return letters | ({"W": "W"} if config.collect_tables else {}) | ({"R": "R"} if config.collect_procedures else {})


def _values(marks: Column, obfuscator: ObfuscatorConfig | None, dialect: Dialect | Column) -> Column:
    """Without spaces and comments, and obfuscated."""
    values = F.regexp_replace(marks, rf"{MARK}[sc][^{MARK}]*+", "")
    return values if obfuscator is None else hide(values, obfuscator, dialect, trivia=False)


def _without_quotes(marks: Column, only_if: str = "") -> Column:
    """``only_if``: a pattern that a quoted identifier must match."""
    return F.regexp_replace(marks, rf'({MARK}[qQ]{only_if}[^{MARK}"\[\]`]*+|(?!\A)\G[^{MARK}"\[\]`]*+)["\[\]`]++', "$1")


def _spaced(values: Column, config: NormalizerConfig) -> Column:
    """``TIGHT`` before tokens that no space goes before."""
    # a colon after a name is a label or a path, others belong to a bind variable
    values = F.regexp_replace(values, rf"({MARK}{IDENTS}[^{MARK}]*+{MARK})x(?=:(?:{MARK}|\z))", "$1y")
    tight = [rf"{MARK}(?=[A-Za-z][,;](?:{MARK}|\z))", rf"(?<={MARK}[xy]:){MARK}(?=[A-Za-z]=(?:{MARK}|\z))", rf"(?<={MARK}x:){MARK}(?={IDENTS})", rf"(?<=[^{MARK}][^{MARK}]\.){MARK}(?={IDENTS})"]
    if config.remove_space_between_parentheses:
        tight += [rf"(?<={MARK}[A-Za-z][(\[]){MARK}", rf"{MARK}(?=[A-Za-z][)\]](?:{MARK}|\z))"]
    values = F.regexp_replace(values, "|".join(tight), TIGHT)
    return F.regexp_replace(values, rf"({SEP}f{TEXT}*+){MARK}", f"$1{TIGHT}") if config.remove_space_between_parentheses else values


def _collapsed(values: Column, config: NormalizerConfig) -> Column:
    """Lists of placeholders as one. From a placeholder right after an opening bracket to the next closing one, placeholders after
    commas go, and commas after placeholders. A comma before anything else is put back, under ``b``, even if it never went."""
    after_hole = rf"(?<={SEP}[A-Za-z]\?)"
    last = rf"(?={SEP}(?:{CLOSE}{'' if config.keep_sql_alias else '|A'})|\z)"
    inside = [
        rf"{after_hole}{SEP}{COMMA}{SEP}{HOLE}",
        rf"{after_hole}{SEP}{COMMA}{last}",
        rf"{after_hole}{SEP}[A-Za-z](,){END}",
        rf"({SEP}{COMMA}){SEP}{HOLE}",
        rf"({SEP}{COMMA}){last}",
        rf"({SEP}[A-Za-z](,){END})",
        rf"({SEP}(?!{CLOSE}){TEXT}++)",
    ]
    pattern = rf"({SEP}[A-Za-z][(\[]{SEP}{HOLE})|(?!\A)\G(?:{'|'.join(inside)})"
    return F.regexp_replace(values, pattern, f"$1$3$4$5$7{TIGHT}b$2$6")


def _without_aliases(values: Column) -> Column:
    """AS goes, and an identifier after it; before anything else AS is put back."""
    values = F.regexp_replace(values, rf"{SEP}A({TEXT}*+){EMPTY}({SEP})(?=[^AiqQG])", f"{TIGHT}e$2b$1$2")
    return F.regexp_replace(values, rf"{SEP}A{TEXT}*+(?:{EMPTY}{SEP}{IDENTS}{TEXT}*+)?+", f"{TIGHT}e")


def _led(values: Column) -> Column:
    """A parenthesis that begins the statement is kept when a command is inside or nothing follows it. What was put back inside it
    goes before it."""

    def taken_apart(tokens: Column) -> Column:
        def step(acc: Column, token: Column) -> Column:
            value = F.substring(token, F.lit(2), F.length(token))
            depth = acc["depth"] + F.when(value == "x(", 1).when(value == "x)", -1).otherwise(0)
            return F.struct(depth.alias("depth"), (acc["at"] + 1).alias("at"), F.when((acc["end"] == 0) & (depth == 0), acc["at"] + 1).otherwise(acc["end"]).alias("end"))

        zero = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))
        end = F.aggregate(tokens, zero, step, lambda acc: F.when(acc["end"] > 0, acc["end"]).otherwise(acc["at"]))
        return let(end, lambda e: joined(F.slice(tokens, F.lit(1), e), F.slice(tokens, e + 1, F.size(tokens))))

    def joined(lead: Column, rest: Column) -> Column:
        put_back = lambda t: F.substring(t, 2, 1) == "b"
        command = F.exists(lead, lambda t: any_of(F.substring(t, 2, 1), "CD"))
        inside = F.array_join(F.filter(lead, lambda t: ~put_back(t)), "")
        inside = F.concat(F.lit(TIGHT), F.substring(inside, F.lit(2), F.length(inside)))
        return F.concat(F.array_join(F.filter(lead, put_back), ""), F.when(command | (F.size(rest) == 0), inside).otherwise(""), F.array_join(rest, ""))

    tokens = F.regexp_extract_all(values, F.lit(f"{SEP}{TEXT}++"), F.lit(0))
    return F.when(values.startswith(f"{MARK}x("), let(tokens, taken_apart)).otherwise(values)


def _text(values: Column, config: NormalizerConfig, bodies: bool) -> Column:
    """The canonical text, still escaped. ``bodies``: whether function bodies may be there, which are statements of their own."""
    if not config.keep_identifier_quotation:
        # an alias that is no plain name keeps its quotes, and so does a name with white space inside
        values = _without_quotes(F.regexp_replace(values, rf"({MARK}A[^{MARK}]*+{MARK})Q", "$1G"), rf"(?![^{MARK}]*[ \t\n\r])")
    if bodies:
        values = each_body(values, lambda body: _text(_values(marked(body, Dialect.GENERIC, _letters(config, None)), None, Dialect.GENERIC), config, bodies=False))
    if config.uppercase_keywords:
        upper = lambda t: F.when(t.rlike(r"\A[CDKT]"), F.concat(F.substring(t, 1, 1), F.upper(F.substring(t, F.lit(2), F.length(t))))).otherwise(t)
        values = F.array_join(F.transform(F.split(values, MARK), upper), MARK)
    values = _collapsed(_spaced(values, config), config)
    if not config.keep_sql_alias:
        values = _without_aliases(values)
    values = let(values, _led)
    text = F.translate(F.regexp_replace(values, rf"{TIGHT}[A-Za-z]|({MARK})[A-Za-z]", "$1"), MARK, " ")
    return trim(text if config.keep_trailing_semicolon else F.regexp_replace(text, r";\z", ""))


def _tables(names: Column) -> Column:
    """Names right after a table word, and after commas in the list that one begins; not the first name after WITH."""
    end = rf"(?:[CDKT]|x[()](?:{MARK}|\z))"
    comma = rf"{MARK}x,(?={MARK}{NAMES})"
    before = rf"{MARK}[DT][^{MARK}]*+|(?!\A)\G(?:(?!{comma}){MARK}(?!{end})[^{MARK}]*+)*+{comma}"
    plain = F.array_distinct(F.regexp_extract_all(names, F.lit(rf"(?:{before}){MARK}{NAMES}([^{MARK}]*+)"), F.lit(1)))

    def first_seen(found: Column) -> Column:
        """Tables whose names did not come first as those of common table expressions."""
        name = lambda t: F.regexp_extract(t, rf"[A-Za-z]([^{MARK}]*)\z", 1)
        every = F.transform(found, name)
        return F.transform(F.filter(found, lambda t, i: t.startswith(f"{MARK}t") & (F.array_position(every, name(t)) == i + 1)), name)

    tagged = F.regexp_replace(names, rf"({before}){MARK}{NAMES}([^{MARK}]*+)", f"$1{MARK}t$2")
    found = F.regexp_extract_all(tagged, F.lit(rf"{MARK}(?:t|W[^{MARK}]*+{MARK}{NAMES})[^{MARK}]*+"), F.lit(0))
    return F.when(F.contains(names, F.lit(f"{MARK}W")), let(found, first_seen)).otherwise(plain)


def _metadata(marks: Column, values: Column, config: NormalizerConfig) -> Column:
    none = F.array().cast(STRINGS)
    texts = lambda of, pattern: F.array_distinct(F.regexp_extract_all(of, F.lit(pattern), F.lit(1)))
    found = {
        "tables": let(_without_quotes(values), _tables) if config.collect_tables else none,
        "comments": texts(marks, rf"{MARK}c([^{MARK}]*+)") if config.collect_comments else none,
        # upper case changes letters of types too, but makes no other a C or D
        "commands": texts(F.upper(values), rf"{MARK}[CD]([^{MARK}]*+)") if config.collect_commands else none,
        "procedures": texts(_without_quotes(values), rf"{MARK}R[^{MARK}]*+{MARK}{NAMES}([^{MARK}]*+)") if config.collect_procedures else none,
    }
    plain = {k: v if v is none else let(v, lambda a: F.when(F.contains(marks, F.lit(ESCAPE)), F.transform(a, unescaped)).otherwise(a)) for k, v in found.items()}
    lists = F.struct(*[v.alias(k) for k, v in plain.items()])
    return let(lists, lambda m: F.struct(F.octet_length(F.array_join(F.concat(*[m[k] for k in plain]), "")).alias("size"), *[m[k].alias(k) for k in plain]))


def _statement(sql: Column, config: NormalizerConfig, obfuscator: ObfuscatorConfig | None, dialect: Dialect | Column) -> Column:
    bodies = obfuscator is None or obfuscator.dollar_quoted_func

    def both(marks: Column) -> Column:
        return let(_values(marks, obfuscator, dialect), lambda values: F.struct(unescaped(_text(values, config, bodies)).alias("sql"), _metadata(marks, values, config).alias("metadata")))

    return F.when(sql.isNotNull(), let(marked(escaped(sql), dialect, _letters(config, obfuscator)), both))


def normalize(sql: Column, config: NormalizerConfig | None = None, dialect: AnyDialect = None) -> Column:
    """struct<sql, metadata struct<size, tables, comments, commands, procedures>>; null for null."""
    return _statement(sql, config or NormalizerConfig(), None, dialect_of(dialect))


def obfuscate_and_normalize(sql: Column, obfuscator: ObfuscatorConfig | None = None, config: NormalizerConfig | None = None, dialect: AnyDialect = None) -> Column:
    """As :func:`normalize`, of the obfuscated tokens."""
    return _statement(sql, config or NormalizerConfig(), obfuscator or ObfuscatorConfig(), dialect_of(dialect))
