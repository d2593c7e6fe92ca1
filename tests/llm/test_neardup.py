import random

import pytest
from pyspark.sql import functions as F

from inkstone.llm import neardup
from inkstone.llm.scratch import Scratch
from tests.llm.common import awkward, documents, empty, run


def shingles(text):
    w = text.encode().lower().split() if text else []
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain(docs):
    """All pairs that share a shingle, compared on their sets."""
    sets, places, root = {}, {}, {}
    for i, t in docs:
        sets[i], root[i] = shingles(t), i
    for i, s in sets.items():
        for x in s:
            places.setdefault(x, []).append(i)

    def find(i):
        while root[i] != i:
            i = root[i] = root[root[i]]
        return i

    for i, s in sets.items():
        for j in {j for x in s for j in places[x] if j < i}:
            n = len(s & sets[j])
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(s), find(i)) for i, s in sets.items()}


def check(got, docs):
    want = plain(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (n, c, i == c) for i, (n, c) in want.items()}
    return want


def test_query_against_all_pairs(spark, sf_dir):
    want = check(run(spark, "op4_near_duplicates", sf_dir).itertuples(), documents(spark, sf_dir))
    assert any(i != c for i, (_, c) in want.items())


def near_copies(n, words, seed):
    """A text and copies with a few words changed, similar to it or to each other, or just not."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        t = list(base)
        for _ in range(rng.randrange(0, max(2, words // 18))):
            t[rng.randrange(words)] = f"x{rng.randrange(5000)}"
        out.append(" ".join(t))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies_of_all_degrees(spark, seed):
    texts = near_copies(60, 120, seed) + near_copies(60, 400, seed + 10) + near_copies(20, 30, seed + 20)
    docs = list(enumerate(texts))
    check(neardup.near_duplicates(awkward(spark, texts)).collect(), docs)


TEXTS = [None, "", " \t\n", "one", "One", "one two three four", "one two three four five", "ONE two three four five", " a b c d e", "É b c d e", "é b c d e", "w " * 50_000, "w " * 50_000 + "v", " ".join(map(str, range(40_000))), " ".join(map(str, range(40_100))), None, ""]


def test_awkward_texts(spark):
    check(neardup.near_duplicates(awkward(spark, TEXTS)).collect(), list(enumerate(TEXTS)))
    left = neardup.without_near_duplicates(awkward(spark, TEXTS))
    assert sorted(r.doc_id for r in left.collect()) == sorted(i for i, (_, c) in plain(list(enumerate(TEXTS))).items() if i == c)
    assert left.columns == awkward(spark, TEXTS).columns


def test_empty_table_and_repeated_rows(spark):
    assert neardup.near_duplicates(empty(spark)).count() == 0
    docs = awkward(spark, ["a b c d e f", "g h i j k l"])
    assert sorted(r.doc_id for r in neardup.without_near_duplicates(docs.union(docs)).collect()) == [0, 1]


def test_a_chain(spark):
    """Each text is linked with the next alone; the component is all of them."""
    texts = [" ".join(f"w{k}" for k in range(i * 8, i * 8 + 100)) for i in range(30)]
    want = check(neardup.near_duplicates(awkward(spark, texts)).collect(), list(enumerate(texts)))
    assert {c for _, c in want.values()} == {0}


def test_a_template_makes_few_pairs(spark, monkeypatch):
    """3,000 texts that share two thirds of their shingles, too few for links, but for some near copies among them."""
    rng = random.Random(4)
    common = " ".join(f"t{k}" for k in range(200))
    texts = [common + " " + " ".join(f"w{rng.randrange(10**9)}" for _ in range(50)) for _ in range(3000)]
    texts += [texts[i][:-12] + " changed" for i in (5, 17, 99)]
    compared = []
    alike = neardup._alike
    monkeypatch.setattr(neardup, "_alike", lambda pairs, sketches: (compared.append(pairs.count()), alike(pairs, sketches))[1])
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(awkward(spark, texts)).collect()}
    assert got == {i: i for i in range(3000)} | {3000: 5, 3001: 17, 3002: 99}
    # pivots: a bucket's members once each; prefixes: no pair but of copies
    assert sum(compared) < 60 * len(texts) and compared[-1] < 100


def test_rare_shingles_find_every_pair(spark):
    """All pairs of one component apiece at similarities from 0.5 to 0.9: none that is similar enough is left out."""
    rng = random.Random(6)
    base = [f"b{k}" for k in range(120)]
    texts = []
    for _ in range(80):
        t = list(base)
        for k in rng.sample(range(24), rng.randrange(0, 6)):
            t[5 * k] = f"x{rng.randrange(3)}"
        texts.append(" ".join(t))
    sets = [shingles(t) for t in texts]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    held = spark.createDataFrame([(i, len(s), i) for i, s in enumerate(sets)], "id long, n long, component long")
    pairs = neardup.sharing_rare(held, rows, Scratch(spark, "test"))
    got = {(r.a, r.b) for r in pairs.collect()}
    want = {(i, j) for i in range(80) for j in range(i) if 4 * len(sets[i] & sets[j]) >= 3 * len(sets[i] | sets[j]) and texts[i] != texts[j]}
    assert want and want <= got and all(a > b for a, b in got)


def test_one_id_with_two_texts(spark):
    """Rows of one id are of one component; one of their texts stands for them, the same one each time."""
    rows = [(1, "a b c d e f"), (1, "u v w x y z"), (2, "a b c d e f"), (3, "u v w x y z"), (4, "q r s t u v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = [sorted((r.doc_id, r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs.repartition(n)).collect()) for n in (1, 3)]
    assert got[0] == got[1] == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (4, 2, 4)]


def test_no_join_gathers_a_large_group(spark, monkeypatch):
    """Near copies of one text: their pairs all name one class, and no key of a join gets more than its part of them."""
    largest, attached = [], neardup.attached

    def watched(pairs, side, rows):
        other = "a" if side == "b" else "b"
        keys = pairs.groupBy(side, F.pmod(F.xxhash64(other), F.lit(neardup.SPREAD))).count()
        largest.append((pairs.groupBy(side).count().agg(F.max("count")).first()[0] or 0, keys.agg(F.max("count")).first()[0] or 0))
        return attached(pairs, side, rows)

    monkeypatch.setattr(neardup, "attached", watched)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join([*words[: i % 199], f"x{i}", *words[i % 199 + 1 :]]) for i in range(2_000)] + [""] * 50
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = neardup.near_duplicates(rows).collect()
    assert {r.component_id for r in got if r.n_shingles} == {0} and sum(r.kept for r in got) == 51
    assert max(whole for whole, _ in largest) > 500 and max(part for _, part in largest) < 20


def test_texts_are_dealt_once_to_drop_copies(spark, monkeypatch):
    """One exchange has the texts, whatever the size; rows without an id stay, and of repeated rows one."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "u v w x y z"), (3, "u v w x y z"), (4, None), (None, "k l m n o p"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.without_near_duplicates(docs)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert sorted((r.doc_id or 0, r.text or "") for r in got.collect()) == [(0, ""), (0, "k l m n o p"), (1, "a b c d e f"), (3, "u v w x y z"), (4, "")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert plan.count("hashpartitioning(doc_id") == 1, plan
