import hashlib
import re

from inkstone.llm import decontamination
from tests.llm.common import awkward, documents, empty, run

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain(docs, items, window=13):
    """Every window at every place."""
    words = lambda t: tuple(WORD.findall(t.translate(LOWER))) if t else ()
    windows = {}
    for item_id, text in items:
        w = words(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(w[i : i + window], set()).add(str(item_id))
    lengths = {len(w) for w in windows}
    out = {}
    for doc_id, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if w[i : i + k] in windows:
                    hit.update(range(i, i + k))
                    found |= windows[w[i : i + k]]
        out[doc_id] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_query_against_every_window_at_every_place(spark, sf_dir):
    got = run(spark, "op1_decontamination", sf_dir)
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain(documents(spark, sf_dir), items)
    assert any(v[3] for v in want.values())
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.itertuples()} == {k: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), c) for k, (n, h, i, c) in want.items()}


ITEMS = [(10, "the quick brown fox"), (9, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (9, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"), (None, "null id item"), (11, None), (12, "  ...  "), (13, "a a a"), (14, "Ünï Çode  ")]
TEXTS = [
    None,
    "",
    "...",
    "The QUICK, brown--fox",
    "the quick brown foxes",
    "x one two three four five six seven eight nine ten eleven twelve thirteen fourteen y",
    "two three four five six seven eight nine ten eleven twelve thirteen",
    "a a a a a",
    "null id item",
    "ünï çode",
    "Ünï Çode  ",
    "filler " * 30_000 + "the quick brown fox",
    "a" * 100_000,
]


def test_awkward_texts(spark):
    docs = awkward(spark, [*TEXTS, TEXTS[3]])
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    want = plain(list(enumerate([*TEXTS, TEXTS[3]])), [i for i in ITEMS if i[0] is not None])
    for slice_bytes in (1 << 20, 40):  # one slice of the benchmark, or several
        rows = decontamination.contamination(docs, items, slice_bytes=slice_bytes).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r["items"], r.contaminated) for r in rows} == want
        assert rows[0].score == "x"


def test_empty_tables(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontamination.contamination(empty(spark), items).count() == 0
    got = decontamination.contamination(awkward(spark, TEXTS), items.limit(0)).collect()
    assert len(got) == len(TEXTS) and not any(r.n_hit or r.contaminated for r in got)


def test_proximity(spark):
    items = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    docs = awkward(spark, ["alpha x beta y gamma", "gamma beta alpha", "alpha beta gamma", "alpha x x x x beta gamma", "alpha beta"])
    rows = decontamination.find_benchmark(docs, items, slop=2).orderBy("doc_id").collect()
    assert [[(m.start, m.end, m.kind) for m in r.matches] for r in rows] == [[(0, 5, "near")], [(0, 3, "near")], [(0, 3, "phrase")], [], []]


def plain_near(text, items, window=13, slop=decontamination.SLOP):
    """Per item, the words of all stretches of up to ``slop`` more words than a window that hold its words, by first and last."""
    w = WORD.findall(text.translate(LOWER)) if text else []
    out = {}
    for item_id, body in items:
        b = WORD.findall(body.translate(LOWER))
        for i in range(max(1, len(b) - window + 1) if b else 0):
            win = b[i : i + window]
            exact = [(s, s + len(win)) for s in range(len(w) - len(win) + 1) if w[s : s + len(win)] == win]
            wanted = set(win)
            held = [(s, s + len(win) + slop) for s in range(-len(win) - slop, len(w)) if wanted <= set(w[max(s, 0) : max(s, 0) + len(win) + slop + min(s, 0)])]
            if any(not any(a < e and s < z for a, z in exact) for s, e in held):
                out.setdefault(str(item_id), []).append((exact, held))
    return out


LONG = [f"w{i}" for i in range(20)]
NEAR_ITEMS = [(1, " ".join(LONG)), (2, "alpha beta gamma"), (3, "red red blue")]
INSERTED = [*LONG[:6], "x", *LONG[6:10], "y", *LONG[10:]]
SWAPPED = [*LONG[:9], LONG[10], LONG[9], *LONG[11:]]
NEAR_TEXTS = [" ".join(INSERTED), " ".join(SWAPPED), " ".join(LONG), " ".join(LONG[:6] + ["x"] * 3 + LONG[6:]), "gamma x beta y ALPHA", "alpha x x x beta gamma", "blue z red", None, ""]


def test_proximity_columns_of_one_or_two_inserted_or_swapped_words(spark):
    items = spark.createDataFrame(NEAR_ITEMS, "item_id long, text string")
    docs = awkward(spark, NEAR_TEXTS)
    for slice_bytes in (1 << 20, 40):
        rows = decontamination.proximity(docs, items, slice_bytes=slice_bytes).orderBy("doc_id").collect()
        assert [r.near_items for r in rows] == [["1"], ["1"], [], [], ["2"], [], ["3"], [], []] == [sorted(plain_near(t, NEAR_ITEMS)) for t in NEAR_TEXTS]
        assert [r.n_near for r in rows] == [22, 20, 0, 0, 5, 0, 3, 0, 0]
        exact = decontamination.contamination(docs, items).orderBy("doc_id").collect()
        assert [(r.n_hit, r["items"], r.contaminated) for r in rows] == [(r.n_hit, r["items"], r.contaminated) for r in exact]


def test_proximity_query(spark, sf_dir):
    got = {r.doc_id: r for r in run(spark, "op1_proximity", sf_dir).itertuples()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = plain(documents(spark, sf_dir), items)
    assert {i: (r.n_words, r.n_hit) for i, r in got.items()} == {i: v[:2] for i, v in want.items()}
    # of all documents, those with many of an item's words; the others cannot hold a window of 13
    bodies = [(i, t, set(WORD.findall(t.translate(LOWER)))) for i, t in items if t]
    for i, text in documents(spark, sf_dir):
        w = set(WORD.findall(text.translate(LOWER))) if text else set()
        able = [(k, t) for k, t, b in bodies if len(b & w) >= min(5, len(b))]
        assert got[i].near_items.split(",") == (sorted(plain_near(text, able)) or [""]) and got[i].n_near_items == len(plain_near(text, able))


def test_few_contaminated_documents_move_no_text(spark):
    """The keys of contaminated documents are a table of their own, whose size Spark knows."""
    passage = " ".join(f"w{i}" for i in range(20))
    docs = spark.createDataFrame([(i, f"{passage} x{i}" if i % 500 == 0 else f"words of document {i}") for i in range(3_000)], "doc_id long, text string")
    tests = spark.createDataFrame([("a", passage)], "item_id string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "8k")
    try:
        got = decontamination.without_contaminated(docs, tests)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert got.count() == 3_000 - 6
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan, plan
