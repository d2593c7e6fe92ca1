from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import quality
from inkstone.llm.sampling import least_hashed
from tests.llm.common import awkward, documents, empty, run


def test_query_against_plain_counts(spark, sf_dir):
    """Raw and target counts, ratios, scores and the draw, made again in one place."""
    docs = documents(spark, sf_dir)
    labels = {r.doc_id: r.quality > 0 for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect() if r.quality is not None}
    grams, raw, target = quality.Grams(), Counter(), Counter()
    for i, t in docs:
        if t and t.split():
            c = Counter(np.concatenate(grams.of(t)).tolist())
            raw += c
            target += c if labels.get(i) else Counter()
    ratio = quality.ratios(*(np.array([c[k] for k in range(quality.BUCKETS)]) for c in (raw, target)))
    model = quality.Model(ratio)
    want = {i: model.score(t, grams)[1:] for i, t in docs}
    got = run(spark, "op7_quality", sf_dir)
    assert all(np.allclose((r.log_weight, r.score), want[r.doc_id]) for r in got.itertuples())
    assert len(got) == len(docs) and got.sampled.sum() == min(int(0.5 * len(docs)), got.kept.sum()) and not (got.sampled & ~got.kept).any()
    judged = [(r.kept, labels[r.doc_id]) for r in got.itertuples() if r.doc_id in labels]
    good, bad = [k for k, y in judged if y], [k for k, y in judged if not y]
    assert np.mean(good) >= 0.9 and np.mean(bad) <= 0.5


def test_held_out_labels(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/../sf0.01/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/../sf0.01/labels.parquet")
    model = quality.train(docs, labels.where("doc_id % 2 = 0"))
    judged = quality.classify(docs, model).join(labels.where("doc_id % 2 = 1"), "doc_id").select("accepted", "quality").toPandas()
    assert judged[judged.quality == 1].accepted.mean() >= 0.9 and judged[judged.quality == 0].accepted.mean() <= 0.5


def test_threshold_scores_labelled_texts_once(spark, tmp_path, monkeypatch):
    """No other text is scored for the threshold, and labelled ones without words have no part in it."""
    seen = str(tmp_path / "seen")

    class Noting(quality.Model):
        def score(self, text, grams):
            with open(seen, "a") as out:
                out.write(f"{text!r}\n")
            return super().score(text, grams)

    monkeypatch.setattr(quality, "Model", Noting)
    texts = [None, "", " \n", "good plain words here.", "more plain words, as good.", "BUY!!! $$$ NOW!!!", *(f"text {i} has no label." for i in range(50))]
    docs = awkward(spark, texts).repartition(3)
    labels = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (3, 1), (4, 1), (5, 0), (9999, 0)], "doc_id long, quality int")
    model = quality.train(docs, labels)
    with open(seen) as lines:
        assert sorted(line.rstrip("\n") for line in lines) == sorted(map(repr, texts[:6]))
    plain, grams = quality.Model(model.ratio), quality.Grams()
    assert model.threshold == quality.best_threshold(np.array([plain.score(t, grams)[2] for t in texts[3:6]]), np.array([True, True, False]))


def test_awkward_texts_and_labels(spark):
    docs = awkward(spark, [None, "", " \n", "good plain words here.", "BUY!!! $$$ NOW!!!", "word " * 50_000, "good plain words here."])
    labels = spark.createDataFrame([(3, 1), (4, 0), (None, 1), (5, None), (3, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.classify(docs, quality.train(docs, labels)).collect()}
    assert [rows[i].accepted for i in (0, 1, 2, 3, 4, 6)] == [False, False, False, True, False, True]
    for some in (labels.limit(0), labels.where("quality = 1"), labels.where("quality = 0")):
        rows = {r.doc_id: r.accepted for r in quality.classify(docs, quality.train(docs, some)).collect()}
        assert not any(rows[i] for i in (0, 1, 2)) and rows[3]
    model = quality.train(empty(spark), labels)
    assert quality.classify(empty(spark), model).count() == 0


def test_resample_is_the_top_k_with_ties(spark):
    rows = [(i, float(i % 50), i % 7 != 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "doc_id long, gumbel double, accepted boolean")
    for k in (0, 1, 333, 1999, 5000):
        got = {r.doc_id for r in quality.resample(df, k).where(F.col("sampled")).collect()}
        assert got == {i for i, _, _ in sorted((r for r in rows if r[2]), key=lambda r: (-r[1], r[0]))[:k]}
    last = quality.largest(df, "gumbel", "doc_id", 500, F.col("accepted"), bins=7, few=10)
    assert last == sorted(((g, i) for i, g, a in rows if a), key=lambda r: (-r[0], r[1]))[499]


def test_draw_with_one_key_and_null_ids(spark, monkeypatch):
    """All keys tie, and the rows of the tied key are too many for the driver: the k-th id is found by ranges."""
    ids = [None, *range(1, 3000)]
    df = spark.createDataFrame([(i, 1.0, True) for i in ids], "doc_id long, gumbel double, accepted boolean").repartition(5)
    monkeypatch.setattr(quality.largest, "__defaults__", (4096, 100))
    for k in (1, 2, 700, 2999):
        got = {r.doc_id for r in quality.resample(df, k).where("sampled").collect()}
        assert got == set(ids[:k])
    assert quality.resample(df, -1).where("sampled").count() == 0


def test_query_draw_without_the_module(spark, sf_dir):
    """``sampled`` from the query's own weights and the stated noise: the largest of those kept."""
    got = run(spark, "op7_quality", sf_dir)
    rows = spark.createDataFrame(got[["doc_id"]])
    hashes = {r.doc_id: r.h for r in rows.select("doc_id", F.xxhash64(F.lit("gumbel"), "doc_id").alias("h")).collect()}
    noise = {i: -np.log(-np.log((((h % (1 << 64)) >> 11) + 0.5) * 2.0**-53)) for i, h in hashes.items()}
    kept = sorted((r.doc_id for r in got.itertuples() if r.kept), key=lambda i: -(dict(zip(got.doc_id, got.log_weight, strict=True))[i] + noise[i]))
    assert set(got.doc_id[got.sampled]) == set(kept[: len(got) // 2])


def test_samples_of_a_hot_group(spark):
    """The least hashes of each group, where one holds most rows; nothing is lost and no group is ranked whole."""
    rows = [(i, "hot" if i % 10 else "cold" if i % 20 else "few") for i in range(20_000)] + [(20_000, None), (20_001, "one")]
    df = spark.createDataFrame(rows, "id long, g string").repartition(7)
    hashed = {r.id: r.h for r in df.select("id", F.shiftrightunsigned(F.xxhash64(F.lit("s"), "id"), 1).alias("h")).collect()}
    for k in (1, 50, 1500):
        got = sorted((r.g, r.id) for r in least_hashed(df, "id", "g", k, "s").collect())
        want = sorted((g, i) for g in ("hot", "cold", "few", "one") for i in sorted((i for i, x in rows if x == g), key=hashed.get)[:k])
        assert got == want
    assert least_hashed(df.limit(0), "id", "g", 5, "s").count() == 0
