"""Bigram scores against plain Python: counts, expectation-maximisation and sums."""

import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from inkstone.llm import ngramlm
from tests.llm import common


def tokens(text):
    words, word = [], b""
    for byte in (text or "").encode():
        if byte in b" \t\n\x0b\x0c\r":
            words, word = words + [word] * bool(word), b""
        else:
            word += bytes([byte + 32 if 65 <= byte <= 90 else byte])
    return words + [word] * bool(word) + [b""]


def counts(docs):
    words, pairs = Counter(), Counter()
    for t in docs:
        words.update(t)
        pairs.update(zip([b""] + t[:-1], t))
    return words, pairs


def context(n):
    return n.bit_length()


def plain(docs, gone, held_out):
    """Scores by the definition; docs: id to tokens."""
    train = [t for i, t in docs.items() if not held_out(i)]
    kept, deleted = [t for i, t in docs.items() if not held_out(i) and not gone(i)], [t for i, t in docs.items() if not held_out(i) and gone(i)]
    words, pairs = counts(train)
    vocabulary, n = len(words), sum(words.values())
    kept_words, kept_pairs = counts(kept)
    kept_n = sum(kept_words.values())
    weights = {b: [1 / 3] * 3 for b in range(64)} | {0: [0, 0.5, 0.5]}
    seen = counts(deleted)[1]
    for _ in range(ngramlm.ROUNDS):
        sums = {}
        for (v, w), h in seen.items():
            b = context(kept_words[v])
            parts = [weights[b][0] * (kept_pairs[v, w] / kept_words[v] if kept_words[v] else 0), weights[b][1] * kept_words[w] / max(kept_n, 1), weights[b][2] / (vocabulary + 1)]
            for k in range(3):
                sums.setdefault(b, [0, 0, 0])[k] += h * parts[k] / sum(parts)
        new = weights | {b: [x / sum(s) for x in s] for b, s in sums.items()}
        still = max(abs(new[b][k] - weights[b][k]) for b in new for k in range(3)) < 1e-4
        weights = new
        if still:
            break
    weights = {b: [w[0], w[1], max(w[2], ngramlm.FLOOR)] for b, w in weights.items()}
    weights = {b: [x / sum(w) for x in w] for b, w in weights.items()}
    out = {}
    for i, t in docs.items():
        score = base = 0.0
        for v, w in zip([b""] + t[:-1], t):
            a, b, c = weights[context(words[v])]
            score += math.log10(a * (pairs[v, w] / words[v] if words[v] else 0) + b * words[w] / max(n, 1) + c / (vocabulary + 1))
            base += math.log10((words[w] + 0.1) / (n + 0.1 * (vocabulary + 1)))
        out[i] = (held_out(i), len(t), sum(words[w] > 0 for w in t), n, base, score)
    return out


def deleted_ids(spark, ids):
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", (F.pmod(F.xxhash64(F.lit("deleted"), "i"), F.lit(ngramlm.DELETED)) == 0).alias("gone")).collect()
    return {r.i for r in rows if r.gone}


def by_crc(i):
    return i is not None and zlib.crc32(str(i).encode()) % 10 == 0


@pytest.mark.parametrize("page, bucket", [(8 << 20, 3 << 20), (20_000, 5_000)])
def test_query_against_plain_counts(spark, sf_dir, monkeypatch, page, bucket):
    monkeypatch.setattr(ngramlm, "PAGE", page)
    monkeypatch.setattr(ngramlm, "BUCKET", bucket)
    docs = {i: tokens(t) for i, t in common.documents(spark, sf_dir)}
    gone = deleted_ids(spark, docs)
    want = plain(docs, lambda i: i in gone, by_crc)
    got = common.run(spark, "op12_lm_scores", sf_dir)
    assert got.columns.tolist() == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    for r in got.itertuples(index=False):
        assert tuple(r[1:5]) == want[r.doc_id][:4]
        assert r.base_score == pytest.approx(want[r.doc_id][4], rel=1e-9) and r.score == pytest.approx(want[r.doc_id][5], rel=1e-6)
    held = got[got.held_out]
    assert held.score.sum() > 0.85 * held.base_score.sum()  # logarithms: the model finds unseen documents likelier


def test_awkward_texts(spark):
    texts = [None, "", " \t\n\x0b\x0c\r", "A b\x1cc a", " x y", "a " * 3000, "É é é", "a\0b A\0B", "İI"] + ["same text here"] * 4
    rows = [(None if i == 4 else 7 if i == 5 else i, t, *[None] * 7) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, common.SCHEMA)
    got = ngramlm.lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
    assert sorted(r.n_tokens for r in got) == sorted(len(tokens(t)) for t in texts)
    assert all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert [r.held_out for r in got if r.id is None] == [False]
    train = counts([tokens(t) for (i, t, *_) in rows if not by_crc(i)])[0]
    assert {r.train_tokens for r in got} == {sum(train.values())}


def test_nothing_to_learn_from(spark):
    assert ngramlm.lm_scores(common.empty(spark), F.lit(False)).count() == 0
    got = ngramlm.lm_scores(common.awkward(spark, ["a b", None]), F.lit(True)).collect()
    assert [(r.train_tokens, r.n_known, r.held_out) for r in got] == [(0, 0, True)] * 2
    assert all(r.base_score == 0 and math.isfinite(r.score) and r.score < 0 for r in got)
    # no deleted part: the weights stay as they began, but for the floor
    one = ngramlm.lm_scores(spark.createDataFrame([(None, "a b a", *[None] * 7)], common.SCHEMA), F.lit(False)).first()
    assert (one.n_tokens, one.n_known, one.train_tokens) == (4, 4, 4)
