"""The rules of statements once more, one text at a time in plain Python: what the expressions are compared with.

Nothing here comes from the expressions but the fixed word lists. A text is read from left to right; a token is (type, text).
"""

import unicodedata

from inkstone.functions import dialects as D

SPACES = " \t\n\r"
MARKS = "(),;.:[]{}"


def letter(c):
    return c == "_" or unicodedata.category(c)[0] == "L"


def name_char(c):
    return letter(c) or c in '0123456789".?$#/@!'


def word_char(c):
    return letter(c) or unicodedata.category(c)[0] == "N"


class Reader:
    def __init__(self, text, dialect):
        self.text, self.dialect, self.at = text, dialect, 0

    def peek(self, k=0):
        i = self.at + k
        return self.text[i] if i < len(self.text) else "\0"

    def run(self, start, fits):
        """End of the run of fitting characters from ``start``."""
        while start < len(self.text) and self.text[start] != "\0" and fits(self.text[start]):
            start += 1
        return start

    def stop(self):
        """Where the text ends for everything but a dollar quote."""
        found = self.text.find("\0", self.at)
        return len(self.text) if found < 0 else found

    def tokens(self):
        out = []
        while self.peek() != "\0":
            kind, end = self.one()
            out.append((kind, self.text[self.at : end]))
            self.at = end
        return out

    def one(self):
        c, d, i = self.peek(), self.dialect, self.at
        if c in SPACES:
            return "SPACE", self.run(i, lambda x: x in SPACES)
        if letter(c):
            return self.word()
        if c == '"':
            return self.string('"') if d == "mysql" else self.quoted('"', '"')
        if c == "'":
            return self.string("'")
        if c == "`" and d == "mysql":
            return self.quoted("`", "`")
        if c == "[" and d == "mssql":
            return self.quoted("[", "]")
        if self.text.startswith("--", i) or (c == "#" and d == "mysql"):
            return "COMMENT", self.run(i, lambda x: x != "\n")
        if self.text.startswith("/*", i):
            end = self.text.find("*/", i + 2, self.stop())
            return ("ERROR", self.stop()) if end < 0 else ("MULTILINE_COMMENT", end + 2)
        if c in "0123456789" or (c in "+-" and self.peek(1) in "0123456789."):
            return "NUMBER", self.number()
        if c == "$":
            return self.dollar()
        if c == "*":
            return "WILDCARD", i + 1
        if c == ":" and d == "oracle" and word_char(self.peek(1)):
            return "BIND_PARAMETER", self.run(i + 1, word_char)
        if c == "#" and d == "mssql":
            return self.named(self.run(i + 1, name_char))
        if c == "@":
            if self.peek(1) == "@":
                return ("SYSTEM_VARIABLE", self.run(i + 2, word_char)) if word_char(self.peek(2)) else ("JSON_OP", i + 2)
            if word_char(self.peek(1)):
                return self.named(self.run(i + 1, name_char)) if d == "snowflake" else ("BIND_PARAMETER", self.run(i + 1, word_char))
            if self.peek(1) in "?>":
                return "JSON_OP", i + 2
        for sign in ("->>", "#>>", "->", "#>", "#-", "?|", "?&", "<@"):
            if self.text.startswith(sign, i):
                return "JSON_OP", i + len(sign)
        if c in "-+*/=<>!&|^%~?@:#":
            end = i + 1
            while end < len(self.text) and self.text[end] in "-+*/=<>!&|^%~?@:#" and not (self.text[end - 1] == "=" and self.text[end] in "?@"):
                end += 1
            return "OPERATOR", end
        return ("PUNCTUATION" if c in MARKS else "UNKNOWN"), i + 1

    def named(self, end):
        return ("FUNCTION" if self.text[end : end + 1] == "(" else "IDENT"), end

    def word(self):
        i = self.at
        for end in range(self.run(i, lambda x: x.isascii() and (x.isalpha() or x == "_")), i, -1):
            kind = KINDS.get(self.text[i:end].upper())
            after = self.text[end : end + 1] or "\0"
            if kind and (after in MARKS + SPACES + "\0" or self.text.startswith("/*", end)):
                return kind, end
        end = self.run(i, name_char)
        return (self.named(end)[0] if self.text[i].isascii() else "IDENT"), end

    def string(self, quote):
        i, stop, escapes, last = self.at + 1, self.stop(), self.dialect not in ("mssql", "oracle"), False
        while i < stop:
            if escapes and self.text[i] == "\\":
                last = i + 1 < stop and self.text[i + 1] == quote if i + 1 < stop else last
                i += 2
                continue
            if self.text[i] == quote:
                return "STRING", i + 1
            i += 1
        return ("STRING" if last else "INCOMPLETE_STRING"), stop

    def quoted(self, opening, closing):
        i, stop = self.at + 1, self.stop()
        while i < stop:
            if self.text[i] == closing:
                if not self.text.startswith("." + opening, i + 1):
                    return "QUOTED_IDENT", i + 1
                i += 3
            else:
                i += 1
        return "ERROR", stop

    def number(self):
        i = self.at
        if self.peek() == "0" and self.peek(1) in "xX":
            return self.run(i + 2, lambda x: x in "0123456789abcdefABCDEF")
        if self.peek() == "0" and self.peek(1) in "01234567":
            return self.run(i + 1, lambda x: x in "01234567")
        i += 1
        while i < len(self.text):
            if self.text[i] in "0123456789.":
                i += 1
            elif self.text[i] in "eE":
                i += 1 + (self.text[i + 1 : i + 2] in ("+", "-"))
            else:
                break
        return i

    def dollar(self):
        i = self.at
        if self.peek(1) in "0123456789":
            return "POSITIONAL_PARAMETER", self.run(i + 1, lambda x: x in "0123456789")
        if self.dialect == "mssql" and letter(self.peek(1)):
            return self.named(self.run(i + 1, name_char))
        close = self.text.find("$", i + 1)
        tag = self.text[i : close + 1]
        end = self.text.find(tag, close + 1) if close > 0 else -1
        if end < 0:
            return "ERROR", len(self.text)
        return ("DOLLAR_QUOTED_FUNCTION" if tag == "$func$" else "DOLLAR_QUOTED_STRING"), end + len(tag)


KINDS = {}
for _words, _kind in ((D.COMMANDS, "COMMAND"), (D.KEYWORDS, "KEYWORD"), (D.BOOLEANS, "BOOLEAN"), (D.NULLS, "NULL"), (D.PROCEDURE_WORDS, "PROC_INDICATOR"), (D.CTE_WORDS, "CTE_INDICATOR"), (D.ALIAS_WORDS, "ALIAS_INDICATOR")):
    KINDS |= dict.fromkeys(_words, _kind)

TRIVIA = ("SPACE", "COMMENT", "MULTILINE_COMMENT")
IDENTS = ("IDENT", "QUOTED_IDENT")
WHITE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def tokenize(text, dialect):
    return Reader(text, dialect).tokens()


def hidden(tokens, config, dialect):
    """Tokens after obfuscation, as [type, text, text before]."""
    out, seen = [], []
    for kind, value in tokens:
        before = seen[-1] if seen else ("", "")
        shown = value
        if kind in ("IDENT", "KEYWORD") and value.upper() in D.EXTRACT_FIELDS and before == ("PUNCTUATION", "(") and len(seen) > 1 and seen[-2][0] == "FUNCTION" and seen[-2][1].upper() == "EXTRACT":
            shown = "?"
        elif kind in ("NUMBER", "STRING", "INCOMPLETE_STRING", "DOLLAR_QUOTED_STRING"):
            shown = value if config.keep_json_path and before[0] == "JSON_OP" else "?"
        elif kind == "DOLLAR_QUOTED_FUNCTION":
            shown = f"$func${obfuscate(value[6:-6], config, dialect)}$func$" if config.dollar_quoted_func else "?"
        elif (kind == "POSITIONAL_PARAMETER" and config.replace_positional_parameter) or (kind == "BIND_PARAMETER" and config.replace_bind_parameter) or (kind == "BOOLEAN" and config.replace_boolean) or (kind == "NULL" and config.replace_null):
            shown = "?"
        elif kind in IDENTS and config.replace_digits:
            shown, was = "", ""
            for c in value:
                shown += ("" if was == "0" else "?") if c in "0123456789" else c
                was = "0" if c in "0123456789" else c
        out.append([kind, shown, value])
        if kind not in TRIVIA:
            seen.append((kind, value))
    return out


def obfuscate(text, config, dialect):
    return "".join(t[1] for t in hidden(tokenize(text, dialect), config, dialect)).strip(WHITE)


def bare(value):
    return "".join(c for c in value if c not in '"[]`')


def plain_name(raw):
    inner = raw[1:-1]
    return len(inner) > 0 and letter(inner[0]) and all(map(word_char, inner))


def normalize(text, config, obfuscator, dialect, inside=False):
    """(text, [tables, comments, commands, procedures])"""
    tokens = tokenize(text, dialect)
    tokens = [[k, v, v] for k, v in tokens] if obfuscator is None else hidden(tokens, obfuscator, dialect)
    values = [t for t in tokens if t[0] not in TRIVIA]
    names = [bare(v) if k == "QUOTED_IDENT" else v for k, v, _ in values]
    shown = []
    for i, (kind, value, raw) in enumerate(values):
        if kind == "QUOTED_IDENT" and not config.keep_identifier_quotation:
            alias = i > 0 and values[i - 1][0] == "ALIAS_INDICATOR"
            if not (alias and not plain_name(raw)) and not any(c in value for c in SPACES):
                value = bare(value)
        elif kind == "DOLLAR_QUOTED_FUNCTION" and value != "?" and not inside:
            value = f"$func${normalize(value[6:-6], config, None, '', True)[0]}$func$"
        shown.append(value)
    return written(values, shown, config), gathered(tokens, values, names, config)


def gap(i, values, shown, config):
    kind, value = values[i][0], shown[i]
    last, last_kind = (shown[i - 1], values[i - 1][0]) if i else ("", "")
    if config.remove_space_between_parentheses and (last_kind == "FUNCTION" or last in ("(", "[") or value in (")", "]")):
        return ""
    if kind in IDENTS and ((len(last) > 1 and last[-1] == ".") or (last == ":" and not (i > 1 and values[i - 2][0] in IDENTS))):
        return ""
    return "" if value in (",", ";") or (value == "=" and last == ":") else " "


def written(values, shown, config):
    main, lead, depth, command, closed, grouping = "", "", 0, False, False, False
    for i, (kind, _, _) in enumerate(values):
        value, last, last_kind = shown[i], shown[i - 1] if i else "", values[i - 1][0] if i else ""
        if i == 0 and kind == "PUNCTUATION" and value == "(":
            lead, depth = "(", 1
            continue
        if closed:
            main, closed = main + (lead if command else ""), False
        space = gap(i, values, shown, config)
        if not config.keep_sql_alias:
            if kind == "ALIAS_INDICATOR" or (last_kind == "ALIAS_INDICATOR" and kind in IDENTS):
                continue
            if last_kind == "ALIAS_INDICATOR":
                main += space + last
        if value == "?" and last in ("(", "["):
            grouping = True
        elif grouping and ((value == "?" and last == ",") or (value == "," and last == "?")):
            continue
        if grouping and value in (")", "]"):
            grouping = False
        elif grouping and value != "?" and last == ",":
            main += ","
        text = space + (value.upper() if config.uppercase_keywords and kind in ("COMMAND", "KEYWORD") else value)
        if not depth:
            main += text
            continue
        lead += text
        command |= kind == "COMMAND"
        if kind == "PUNCTUATION":
            depth += (value == "(") - (value == ")")
        closed = depth == 0
    if closed or depth:
        main += lead
    if not config.keep_trailing_semicolon and main.endswith(";"):
        main = main[:-1]
    return main.strip(WHITE)


def gathered(tokens, values, names, config):
    tables, ctes, commands, procedures, listing = [], set(), [], [], False
    for i, (kind, value, raw) in enumerate(values):
        last_kind, last = (values[i - 1][0], values[i - 1][1]) if i else ("", "")
        if kind in ("COMMAND", "KEYWORD"):
            listing = False
            commands += [value.upper()] * (kind == "COMMAND")
        elif kind == "PUNCTUATION" and value in ("(", ")"):
            listing = False
        elif kind in (*IDENTS, "FUNCTION") and i:
            starts = last_kind in ("COMMAND", "KEYWORD") and values[i - 1][2].upper() in D.TABLE_INDICATORS
            if last_kind == "CTE_INDICATOR":
                ctes.add(names[i])
            elif starts or (listing and (last_kind, last) == ("PUNCTUATION", ",")):
                listing = True
                tables += [names[i]] * (names[i] not in ctes)
            procedures += [names[i]] * (last_kind == "PROC_INDICATOR")
    comments = [v for k, v, _ in tokens if k in ("COMMENT", "MULTILINE_COMMENT")]
    wanted = (config.collect_tables, config.collect_comments, config.collect_commands, config.collect_procedures)
    return [list(dict.fromkeys(found)) if on else [] for on, found in zip(wanted, (tables, comments, commands, procedures), strict=True)]
