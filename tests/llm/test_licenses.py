import re

from inkstone.llm import licenses
from tests.llm.common import awkward, documents, empty, run


def plain(text):
    """Every unit against every template."""
    grams = lambda t: (lambda w: set(zip(w, w[1:], strict=False)))(re.findall(r"[^\W_]+", t.lower()))
    units, at = [("text", 0, len(text))], 0
    for p in re.split(r"(\n[ \t\r]*\n)", text):
        if not re.fullmatch(r"\n[ \t\r]*\n", p):
            if p != text:
                units.append(("paragraph", at, at + len(p)))
            low = at
            for line in p.split("\n") if p else []:
                if line != p and low < at + len(p):
                    units.append(("line", low, low + len(line)))
                low += len(line) + 1
        at += len(p)
    out = []
    for unit, start, end in units:
        g = grams(text[start:end])
        scores = [(2 * len(g & t) / (len(g) + len(t)) if g else 0.0, -i, name) for i, (name, (_, body)) in enumerate(licenses.TEMPLATES.items()) for t in [grams(body)]]
        best = max(scores)
        if best[0] >= licenses.THRESHOLD:
            out.append((best[2], unit, start, end, best[0]))
    return out


def check(rows, docs):
    for i, t in docs:
        assert [(m.template, m.unit, m.start, m.end, m.score) for m in rows[i].matches] == plain(t or "")


def test_documents_against_all_templates(spark, sf_dir):
    docs = documents(spark, sf_dir)
    rows = {r.doc_id: r for r in licenses.scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()}
    check(rows, docs)
    got = run(spark, "op6_licenses", sf_dir)
    assert len(got) == len(docs) and got.n_matches.sum() == sum(len(r.matches) for r in rows.values()) > 0


MIT = licenses.TEMPLATES["mit"][1]
TEXTS = [None, "", "word", MIT, MIT.replace("Software", "Program"), f"intro\n\n{MIT}\n \nend", "x\nAll rights reserved.\ny", "all  RIGHTS, reserved", "a " * 100_000, MIT[:200], "\n\n\n", MIT]


def test_awkward_texts(spark):
    rows = {r.doc_id: r for r in licenses.scan_licenses(awkward(spark, TEXTS)).collect()}
    check(rows, enumerate(TEXTS))
    assert rows[3].licenses == ["MIT"] and rows[0].best_score == 0 and rows[3].matches == rows[11].matches
    assert licenses.scan_licenses(empty(spark)).count() == 0


def layout(name, *breaks):
    """A template in paragraphs that start at the given words, in lines of 70."""
    import textwrap

    text = licenses.TEMPLATES[name][1]
    cuts = [0, *(text.index(b) for b in breaks), len(text)]
    return "\n\n".join(textwrap.fill(text[a:b].strip(), 70) for a, b in zip(cuts, cuts[1:], strict=False))


CODE = "\n".join(f"def step_{i}(value): return value * {i} + offset_{i}" for i in range(60))
LAYOUTS = {
    "mit": layout("mit", "The above copyright", "THE SOFTWARE IS"),
    "bsd-2-full": layout("bsd-2-full", "1. Redis", "2. Redis", "THIS SOFTWARE"),
    "bsd-3-full": layout("bsd-3-full", "1. Redis", "2. Redis", "3. Neither", "THIS SOFTWARE"),
    "gpl3-header": layout("gpl3-header", "This program is distributed", "You should have"),
    "apache-header": layout("apache-header", "You may obtain", "Unless required"),
    "isc": layout("isc", "THE SOFTWARE IS"),
    "unlicense-full": layout("unlicense-full", "Anyone is", "In jurisdictions", "THE SOFTWARE IS", "For more"),
}


def test_licences_of_several_paragraphs_inside_longer_texts(spark):
    texts, want = [], []
    for name, body in LAYOUTS.items():
        comment = "\n".join(f"# {line}".rstrip() for line in body.split("\n"))
        texts += [f"Copyright (c) 2020 Someone\n\n{body}\n\n{CODE}", f"{CODE}\n{comment}\n{CODE}", f"İ {CODE} {body} {CODE}".replace("\n", " ")]
        want += [(name, body), (name, comment[2:]), (name, body.replace("\n", " "))]
    rows = licenses.scan_licenses(awkward(spark, texts)).orderBy("doc_id").collect()
    for row, text, (name, body) in zip(rows, texts, want, strict=True):
        assert row.licenses == [licenses.TEMPLATES[name][0]], (name, row.licenses)
        (m,) = [m for m in row.matches if m.template == name and m.unit == "passage"]
        got, whole = (re.findall(r"[^\W_]+", t) for t in (text[m.start : m.end], body))
        # the shortest run with all bigrams: words at an edge that come again inside are left out
        assert m.score == 1.0 and " ".join(got) in " ".join(whole) and len(whole) - len(got) <= 4


def test_complete_bsd_file_and_copies_and_mixtures(spark):
    bsd, mit = LAYOUTS["bsd-2-full"], LAYOUTS["mit"]
    notice = "Licensed under CC BY-NC 4.0."
    texts = [f"Copyright (c) 2020, Someone\nAll rights reserved.\n\n{bsd}\n", f"{CODE}\n\n{mit}\n\n{CODE}\n\n{mit}\n\n{CODE}\n\n{bsd}", f"{CODE}\n\n{mit}\n\n{CODE} {notice} {CODE}", f"{CODE}\n\n{mit[:300]}\n\n{CODE}"]
    rows = licenses.scan_licenses(awkward(spark, texts)).orderBy("doc_id").collect()
    assert rows[0].licenses == ["All-rights-reserved", "BSD-2-Clause"] and rows[1].licenses == ["BSD-2-Clause", "MIT"] and rows[1].n_matches == 3
    assert rows[2].licenses == ["CC-BY-NC-4.0", "MIT"] and rows[3].licenses == []


def plain_windows(grams, wanted, threshold):
    """All runs, best first; then those left that share no word with one taken."""
    runs = sorted((-2 * len(set(grams[a:b]) & wanted) / (len(set(grams[a:b])) + len(wanted)), b - a, a) for a in range(len(grams)) for b in range(a + 1, len(grams) + 1))
    out = []
    for score, n, a in runs:
        if -score >= threshold and all(a + n < c or d < a for _, c, d in out):
            out.append((-score, a, a + n))
    return out


def test_windows_against_all_runs():
    import random

    draw = random.Random(5)
    for _ in range(300):
        words = draw.choices("abcdef", k=draw.randint(2, 45))
        wanted = frozenset(licenses.bigrams(draw.choices("abcd", k=draw.randint(2, 9))))
        grams = list(zip(words, words[1:], strict=False))
        threshold = draw.choice([0.5, 0.66, 0.8])
        assert licenses.windows(grams, wanted, threshold) == plain_windows(grams, wanted, threshold)


def test_whole_licences(spark):
    """A complete file of each licence is one match of the whole text."""
    whole = {name: text for name, (_, text) in licenses.standard_templates().items() if name.endswith("-whole") or name in ("mit", "isc", "bsd-2-full", "bsd-3-full", "unlicense-full")}
    assert len(whole) == 12
    names = sorted(whole)
    docs = awkward(spark, ["Copyright 2020 Someone\n\n" + whole[n] for n in names])
    rows = licenses.scan_licenses(docs).orderBy("doc_id").collect()
    for name, row in zip(names, rows, strict=True):
        spdx = licenses.standard_templates()[name][0]
        assert [(m.license, m.template) for m in row.matches if m.unit == "text"] == [(spdx, name)]
