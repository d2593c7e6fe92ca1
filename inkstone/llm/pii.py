"""Personal data by anchor expansion.

An Aho-Corasick automaton finds the anchors of a text (at-signs, digits, plus signs, URL schemes, account cues, street
words); at each anchor a small deterministic parser expands to the left and right and validates what it has found. The
parsers for e-mail, IP, card and phone find exactly the leftmost non-overlapping matches of the patterns below, per kind:

    email  [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+
    ip     [0-9]+(\\.[0-9]+)(\\.[0-9]+)(\\.[0-9]+)            each part at most 255
    card   [0-9]([\\x20-]?[0-9])+                            14 to 19 digits, Luhn
    phone  \\+[0-9][\\x20().0-9-]+[0-9]                       10 to 15 digits

A match that fails its validation is dropped and stays consumed. Kinds ``url``, ``account`` and ``address`` come on top.

Defined cases: null and empty texts have no spans; offsets are code points, ends exclusive; repeated rows each get their
own result; other columns pass through, and an output column replaces an input column of the same name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release

#: In the order in which spans with the same start are listed. The first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "url", "account", "address")
BASE = KINDS[:4]
SPANS = "array<struct<kind:string,start:int,end:int,value:string>>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DIGITS = re.compile(r"[0-9]+")
PHONE_TAIL = re.compile(r"[ ().0-9-]+")
URL_TAIL = re.compile(r"[^\s<>\"'`{}|\\^]+")
ACCOUNT_TAIL = re.compile(r"(?:\s*(?:no\.?|nr\.?|number))?\s{0,2}[:#=]?\s{0,2}([A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){8,30}|[0-9](?:[ -]?[0-9]){5,17})(?![A-Za-z0-9])", re.I)
HOUSE = re.compile(r"(?<![A-Za-z0-9])[0-9]{1,5}[A-Za-z]?(?: [A-Z][a-z'.-]+){1,4}\Z")

SCHEMES = ("http://", "https://", "ftp://")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")
STREETS = (" Street", " Road", " Avenue", " Lane", " Drive", " Boulevard", " Square")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    anchors = [("@", "email"), ("+", "phone"), *((d, "digit") for d in "0123456789"), *((s, "url") for s in SCHEMES), *((s, "address") for s in STREETS)]
    anchors += [(v, "account") for c in CUES for v in (c, c.title(), c.upper())]
    for word, kind in anchors:
        a.add_word(word, (kind, len(word)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def iban(value: str) -> bool:
    v = value.replace(" ", "").upper()
    return 15 <= len(v) <= 34 and int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _card_end(text: str, at: int) -> int:
    """End of the run of digits with single separators that starts at ``at``."""
    end, n = at + 1, len(text)
    while end < n:
        if "0" <= text[end] <= "9":
            end += 1
        elif text[end] in " -" and end + 1 < n and "0" <= text[end + 1] <= "9":
            end += 2
        else:
            break
    return end


def _ip_end(text: str, at: int) -> int:
    """End of four dotted digit runs from ``at``, or 0."""
    m = DIGITS.match(text, at)
    for _ in range(3):
        if not m or text[m.end() : m.end() + 1] != ".":
            return 0
        m = DIGITS.match(text, m.end() + 1)
    return m.end() if m else 0


def spans_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, by start and then kind."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    free = dict.fromkeys(KINDS, 0)
    digits_to = 0

    def take(kind: str, start: int, end: int, valid: bool = True) -> None:
        free[kind] = end
        if valid:
            found.append((kind, start, end))

    for last, (kind, width) in automaton().iter(text):
        at = last - width + 1
        if kind == "digit":
            if at < digits_to:
                continue
            digits_to = DIGITS.match(text, at).end()
            if at >= free["card"] and (end := _card_end(text, at)) > at + 1:
                number = text[at:end].replace(" ", "").replace("-", "")
                take("card", at, end, 14 <= len(number) <= 19 and luhn(number))
            if at >= free["ip"] and (end := _ip_end(text, at)):
                take("ip", at, end, all(len(d) <= 3 and int(d or "0") <= 255 for d in (p.lstrip("0") for p in text[at:end].split("."))))
        elif kind == "email":
            if m := DOMAIN.match(text, at + 1):
                start = at
                while start > free["email"] and text[start - 1] in LOCAL_CHARS:
                    start -= 1
                if start < at:
                    take("email", start, m.end())
        elif kind == "phone":
            if at >= free["phone"] and at + 1 < len(text) and "0" <= text[at + 1] <= "9" and (m := PHONE_TAIL.match(text, at + 2)):
                end = m.end()
                while end > at + 3 and not "0" <= text[end - 1] <= "9":
                    end -= 1
                if end > at + 3:
                    take("phone", at, end, 10 <= sum("0" <= c <= "9" for c in text[at:end]) <= 15)
        elif kind == "url":
            if at >= free["url"] and not text[at - 1 : at].isalnum() and (m := URL_TAIL.match(text, last + 1)):
                end = last + 1 + len(m[0].rstrip(".,;:!?)]"))
                take("url", at, end, end > last + 1)
        elif kind == "account":
            if at >= free["account"] and not text[at - 1 : at].isalnum() and (m := ACCOUNT_TAIL.match(text, last + 1)):
                take("account", m.start(1), m.end(1), m[1][0].isdigit() or iban(m[1]))
        elif kind == "address" and at >= free["address"] and not text[last + 1 : last + 2].isalnum():
            low = max(free["address"], at - 100)
            if m := HOUSE.search(text[low:at]):
                take("address", low + m.start(), last + 1)
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def mask(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    out, at, i = [], 0, 0
    while i < len(spans):
        kind, start, end = spans[i]
        i += 1
        while i < len(spans) and spans[i][1] < end:
            end = max(end, spans[i][2])
            i += 1
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find_pii(text: Column) -> Column:
    """Column of spans with their values."""

    @F.arrow_udf(SPANS)
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())]))
        for batch in batches:
            yield pa.array([[{"kind": k, "start": s, "end": e, "value": t[s:e]} for k, s, e in spans_of(t)] for t in batch.to_pylist()], kind)
        release()

    return find(text)


def redact(text: Column) -> Column:
    """The text with everything found replaced by its kind; null stays null."""

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([t and mask(t, spans_of(t)) for t in batch.to_pylist()], pa.string())
        release()

    return run(text)


def pii_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its spans and the digests of them."""
    listed = lambda a: F.concat_ws(",", F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])))
    count = lambda k: F.size(F.filter("pii", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    modest_batches(docs.sparkSession)
    found = docs.select(F.col(id_col), find_pii(F.col(text_col)).alias("pii"))
    base = F.filter("pii", lambda x: x["kind"].isin(*BASE))
    return found.select(id_col, *[count(k) for k in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("pii")).alias("spans"), "pii")


def redact_documents(docs: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The same rows with masked texts and, if there is such a column, their new lengths."""
    modest_batches(docs.sparkSession)
    out = docs.withColumn(text_col, redact(F.col(text_col)))
    if length_col and length_col in docs.columns:
        out = out.withColumn(length_col, F.char_length(text_col).cast(docs.schema[length_col].dataType))
    return out
