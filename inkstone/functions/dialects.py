"""Dialects of SQL, the words the lexer knows, and one token pattern per dialect."""

from __future__ import annotations

from enum import Enum
from functools import lru_cache

# Words and their token types. A word in two lists has the type of the later one.
COMMANDS = "SELECT INSERT UPDATE DELETE CREATE ALTER DROP JOIN GRANT REVOKE COMMIT BEGIN TRUNCATE MERGE EXECUTE EXEC EXPLAIN STRAIGHT_JOIN USE CLONE VACUUM".split()
KEYWORDS = (
    "ADD ALL AND ANY ASC BETWEEN BY CASE CHECK COLUMN CONSTRAINT DATABASE DECLARE DEFAULT DESC DISTINCT ELSE END ESCAPE EXISTS FOREIGN FROM GROUP HAVING IN INDEX INNER INTO IS KEY LATERAL LEFT LIKE LIMIT NOT ON OR ORDER OUT OUTER PRIMARY PROCEDURE "
    "REPLACE RETURNS RIGHT ROLLBACK ROWNUM SET SOME TABLE TOP UNION UNIQUE VALUES VIEW WHERE CUBE ROLLUP LITERAL WINDOW ANALYZE ILIKE USING ASSERTION DOMAIN CLUSTER COPY PLPGSQL TRIGGER TEMPORARY UNLOGGED RECURSIVE RETURNING OFFSET OF SKIP IF ONLY"
).split()
TABLE_INDICATORS = "JOIN UPDATE STRAIGHT_JOIN CLONE FROM INTO TABLE EXISTS ONLY".split()
BOOLEANS = ["TRUE", "FALSE"]
NULLS = ["NULL"]
PROCEDURE_WORDS = ["PROCEDURE", "PROC"]
CTE_WORDS = ["WITH"]
ALIAS_WORDS = ["AS"]
EXTRACT_FIELDS = "CENTURY DAY DECADE DOW DOY EPOCH HOUR ISODOW ISOYEAR JULIAN MICROSECONDS MILLENNIUM MILLISECONDS MINUTE MONTH QUARTER SECOND TIMEZONE TIMEZONE_HOUR TIMEZONE_MINUTE WEEK YEAR".split()

# Names of the token types.
TOKEN_TYPES = (
    "ERROR EOF SPACE STRING INCOMPLETE_STRING NUMBER IDENT QUOTED_IDENT OPERATOR WILDCARD COMMENT MULTILINE_COMMENT PUNCTUATION DOLLAR_QUOTED_FUNCTION DOLLAR_QUOTED_STRING POSITIONAL_PARAMETER BIND_PARAMETER FUNCTION SYSTEM_VARIABLE UNKNOWN "
    "COMMAND KEYWORD JSON_OP BOOLEAN NULL PROC_INDICATOR CTE_INDICATOR ALIAS_INDICATOR"
).split()


#: Other names of dialects.
ALIASES = {"sql-server": "mssql", "sqlserver": "mssql", "postgres": "postgresql"}


class Dialect(str, Enum):
    GENERIC = ""
    MSSQL = "mssql"
    POSTGRESQL = "postgresql"
    MYSQL = "mysql"
    ORACLE = "oracle"
    SNOWFLAKE = "snowflake"

    @classmethod
    def of(cls, name: str | Dialect | None) -> Dialect:
        """By name or alias; any other name is generic."""
        if isinstance(name, cls):
            return name
        alias = ALIASES.get(name or "", name or "")
        return cls(alias) if alias in {d.value for d in cls} else cls.GENERIC

    @property
    def backslash_escapes(self) -> bool:
        return self not in (Dialect.MSSQL, Dialect.ORACLE)


LETTER = r"[\p{L}_]"
ALNUM = r"[\p{L}\p{N}_]"
CONTINUES = r"[\p{L}_0-9\".?$#/@!]"
OPERATOR = r"[-+*/=<>!&|^%~?@:#]"
#: What may follow a keyword.
BOUNDARY = r"[(),;.:\[\]{} \t\n\r\x00]|/\*|\z"

#: A letter for each type of token; keywords and commands that a table name may follow and quoted names that need no quotes have
#: letters of their own.
LETTERS = {
    "s": "SPACE", "c": "COMMENT", "m": "MULTILINE_COMMENT",
    "C": "COMMAND", "D": "COMMAND", "K": "KEYWORD", "T": "KEYWORD", "B": "BOOLEAN", "N": "NULL", "R": "PROC_INDICATOR", "W": "CTE_INDICATOR", "A": "ALIAS_INDICATOR",
    "f": "FUNCTION", "i": "IDENT", "q": "QUOTED_IDENT", "Q": "QUOTED_IDENT",
    "S": "STRING", "O": "INCOMPLETE_STRING", "n": "NUMBER", "d": "DOLLAR_QUOTED_STRING", "F": "DOLLAR_QUOTED_FUNCTION",
    "P": "POSITIONAL_PARAMETER", "b": "BIND_PARAMETER", "v": "SYSTEM_VARIABLE",
    "p": "PUNCTUATION", "o": "OPERATOR", "w": "WILDCARD", "j": "JSON_OP", "E": "ERROR", "U": "UNKNOWN", "z": "EOF",
}


def string(quote: str, escapes: bool) -> str:
    """A closed string."""
    return rf"{quote}[^{quote}\\\x00]*+(?:\\[^\x00][^{quote}\\\x00]*+)*+{quote}" if escapes else rf"{quote}[^{quote}\x00]*+{quote}"


def quoted(opening: str, closing: str) -> tuple[str, str]:
    """A closed quoted identifier that is a plain name, and any; ``"a"."b"`` is one."""
    o, c = f"\\{opening}", f"\\{closing}"
    return rf"{o}{LETTER}{ALNUM}*+{c}(?!\.{o})", rf"{o}(?:[^{c}\x00]++|{c}\.{o})*+{c}"


def words_pattern(words: list[str]) -> str:
    """Any of the words, as a tree of their letters: a text is compared once with each common beginning."""
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}

    def shown(node: dict) -> str:
        if not node:
            return ""
        ways = [letter + shown(below) for letter, below in sorted(node.items(), reverse=True)]  # the longer word first
        return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})"

    return shown(tree)


#: Words by letter; a word in two lists has the type of the later one.
WORDS: dict[str, list[str]] = {}
for _word, _letter in {
    word: letter
    for words, letter in (
        *(((c,), "D" if c in TABLE_INDICATORS else "C") for c in COMMANDS),
        *(((k,), "T" if k in TABLE_INDICATORS else "K") for k in KEYWORDS),
        (BOOLEANS, "B"), (NULLS, "N"), (PROCEDURE_WORDS, "R"), (CTE_WORDS, "W"), (ALIAS_WORDS, "A"),
    )
    for word in words
}.items():
    WORDS.setdefault(_letter, []).append(_word)
#: Any word of any letter, as it stands before a token is tried for each letter: most names are none.
ANY_WORD = f"(?i:{words_pattern([word for words in WORDS.values() for word in words])})(?={BOUNDARY})"


@lru_cache(maxsize=None)
def token_patterns(dialect: Dialect) -> tuple[tuple[str, str], ...]:
    """Ordered alternatives that cut any text into tokens without loss, each with its letter. A token that may be left open is
    followed by its open form, to the end of the text. The last one is a NUL, which ends the text but inside a dollar quote; it has no letter. ``{tag}``
    stands for the number of a dollar quote's tag as a group."""
    mysql, mssql, oracle, snowflake = (dialect == d for d in (Dialect.MYSQL, Dialect.MSSQL, Dialect.ORACLE, Dialect.SNOWFLAKE))
    rest = r"[^\x00]*+"
    escapes = dialect.backslash_escapes
    #: left open, but the last escape was of the quote itself, as in ESCAPE '\\'
    escaped = lambda q: [("S", rf"{q}(?=[^\x00]*\\{q}[^\\\x00]*+\\?(?:\x00|\z)){rest}")] if escapes else []
    strings = lambda q: [("S", string(q, escapes)), *escaped(q), ("O", q + rest)]
    names = lambda o, c: [("q", quoted(o, c)[0]), ("Q", quoted(o, c)[1]), ("E", f"\\{o}{rest}")]
    ident = lambda pattern: [("f", rf"{pattern}(?=\()"), ("i", pattern)]
    return (
        ("s", r"[ \t\n\r]++"),
        ("p", r"[(),;.\]{}]" if mssql else r"[(),;.\[\]{}]"),
        *((letter, f"(?i:{words_pattern(words)})(?={BOUNDARY})") for letter, words in WORDS.items()),
        ("f", rf"[A-Za-z_]{CONTINUES}*+(?=\()"),
        ("i", f"{LETTER}{CONTINUES}*+"),
        *(strings('"') if mysql else names('"', '"')),
        *strings("'"),
        ("c", r"--[^\n\x00]*+"),
        ("m", r"/\*[^\x00]*?\*/"),
        ("E", rf"/\*{rest}"),
        ("n", r"[+-](?=[0-9.])(?:[0-9.]++|[eE][+-]?+)*+"),
        ("n", r"0[xX][0-9a-fA-F]*+"),
        ("n", r"0[0-7]++"),
        ("n", r"[0-9](?:[0-9.]++|[eE][+-]?+)*+"),
        ("w", r"\*"),
        ("P", r"\$[0-9]++"),
        *(ident(rf"\$(?={LETTER}){CONTINUES}*+") if mssql else []),
        ("F", r"\$func\$[\s\S]*?\$func\$"),
        ("d", r"\$([^$]*+)\$[\s\S]*?\$\{tag}\$"),
        ("E", r"\$[\s\S]*+"),
        *([("b", f":{ALNUM}++")] if oracle else []),
        *(names("`", "`") if mysql else []),
        *(ident(f"#{CONTINUES}*+") if mssql else [("c", r"#[^\n\x00]*+")] if mysql else []),
        ("v", f"@@{ALNUM}++"),
        ("j", "@@"),
        *(ident(f"@(?={ALNUM}){CONTINUES}*+") if snowflake else [("b", f"@{ALNUM}++")]),
        ("j", "@[?>]"),
        *(names("[", "]") if mssql else []),
        ("j", r"->>?|#>>?|#-|\?[|&]|<@"),
        ("o", f"{OPERATOR}(?:(?!(?<==)[?@]){OPERATOR})*+"),
        ("U", r"\x03[\x04-\x06]|[^\x00]"),
        ("", r"\x00"),
    )
