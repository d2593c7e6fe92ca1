import hashlib
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import pii
from tests.llm.common import awkward, documents, empty, run

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def plain(text):
    """The patterns themselves."""
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False, "card": 14 <= len(digits) <= 19 and luhn(digits), "phone": 10 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, kind, m.end()))
    return [(kind, start, end) for start, _, kind, end in sorted(out)]


def test_query_against_the_patterns(spark, sf_dir):
    got = {r.doc_id: r for r in run(spark, "op10_pii", sf_dir).itertuples()}
    found = 0
    for i, text in documents(spark, sf_dir):
        want = plain(text)
        found += len(want)
        assert [getattr(got[i], f"n_{k}") for k in PATTERNS] == [sum(s[0] == k for s in want) for k in PATTERNS]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in want).encode()).hexdigest()
        assert set(f"{k}:{s}:{e}" for k, s, e in want) <= set(got[i].spans.split(","))
    assert found


@settings(max_examples=600, deadline=None)
@given(st.text(alphabet="a1230459. -+()@é%_x", max_size=50))
def test_any_text(text):
    assert [s for s in pii.spans_of(text) if s[0] in PATTERNS] == plain(text)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="0123456789 -", min_size=10, max_size=40))
def test_any_number(text):
    assert [s for s in pii.spans_of(text) if s[0] in PATTERNS] == plain(text)


TEXTS = [None, "", "mail bob@example.com now", "1.2.3.4 and 1.2.3.4.5", "999.1.1.1", "4111 1111 1111 1111", "+49 (30) 123456-78", "é" * 9 + " a@b.c", "9" * 100_000, "see https://a.example/x?y, or IBAN DE89 3704 0044 0532 0130 00", "lives at 12 Long Meadow Lane today", "@" * 50_000]


def test_awkward_texts(spark):
    rows = {r.doc_id: r for r in pii.pii_report(awkward(spark, TEXTS)).collect()}
    for i, t in enumerate(TEXTS):
        assert [(x.kind, x.start, x.end) for x in rows[i].pii if x.kind in PATTERNS] == plain(t)
        assert all(x.value == t[x.start : x.end] for x in rows[i].pii)
    assert {"url", "account"} <= {x.kind for x in rows[9].pii} and [x.value for x in rows[10].pii] == ["12 Long Meadow Lane"]
    assert pii.pii_report(empty(spark)).count() == 0


def test_redaction_leaves_nothing_and_keeps_columns(spark):
    docs = awkward(spark, TEXTS)
    out = pii.redact_documents(docs)
    assert out.columns == docs.columns
    rows = {r.doc_id: r for r in out.collect()}
    assert rows[2].text == "mail [EMAIL] now" and rows[0].text is None and rows[2].n_chars == len(rows[2].text)
    assert not any(plain(r.text) for r in rows.values())


def test_addresses_of_very_many_zeros(spark):
    zeros = "0" * 5000
    texts = [f"{zeros}.1.2.3", f"1.2.3.{zeros}255", f"1.{zeros}256.2.3", f"{zeros}.{zeros}.{zeros}.{zeros}"]
    rows = pii.pii_report(awkward(spark, texts)).orderBy("doc_id").collect()
    assert [[(x.start, x.end) for x in r.pii if x.kind == "ip"] for r in rows] == [[(0, 5006)], [(0, 5009)], [], [(0, 20003)]]
    assert pii.redact_documents(awkward(spark, texts)).orderBy("doc_id").first().text == "[IP]"
