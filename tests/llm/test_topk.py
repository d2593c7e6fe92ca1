import numpy as np
import pytest
from pyspark.sql import functions as F

from inkstone.llm import topk
from tests.llm.common import run


def plain(rows, k, asked):
    """All inner products in whole numbers."""
    usable = {i: [int(x) for x in v] for i, v in rows if i is not None and v is not None}
    out = []
    for q in sorted(i for i in usable if asked(i)):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v, strict=False)), i) for i, v in usable.items() if i != q)
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def scaled(rows):
    bad = lambda v: v is None or any(x is None or not np.isfinite(x) for x in v)
    return [(i, None if bad(v) else [np.floor(256 * np.float64(x)) for x in v]) for i, v in rows]


def test_query_against_all_products(spark, sf_dir):
    got = run(spark, "op2_topk", sf_dir)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding").collect()]
    assert sorted(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == plain(scaled(rows), 5, lambda i: i % 50 == 0)


def search(spark, rows, k=3, **options):
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("v"))
    found = topk.PivotIndex(vectors, k, **options).search(vectors.where("id % 2 = 0"))
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, None), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, [None, 1.0]), (6, [0.0, 0.0]), (7, [-1.0, -0.25]), (8, [1.0, 0.5]), (9, [1.0, 0.5]), (10, [1.0, 0.5]), (11, [1.0, 0.5]), (12, [0.1, 3.0]), (None, [9.0, 9.0])]
    assert search(spark, rows) == plain(scaled(rows), 3, lambda i: i % 2 == 0)


def test_few_and_no_vectors(spark):
    assert search(spark, []) == []
    assert search(spark, [(2, [1.0])]) == []
    assert search(spark, [(2, [1.0]), (4, [2.0])]) == [(2, 1, 4, 512 * 256), (4, 1, 2, 512 * 256)]


@pytest.mark.parametrize("ring", [8, 4096])
def test_a_hot_group_and_many_rings(spark, ring):
    """A third of the vectors are the same, and a third nearly so."""
    rng = np.random.default_rng(1)
    rows = [(i, [0.5] * 8) for i in range(200)] + [(200 + i, (0.5 + 0.01 * rng.standard_normal(8)).tolist()) for i in range(200)] + [(400 + i, rng.standard_normal(8).tolist()) for i in range(200)]
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
    assert search(spark, rows, ring=ring) == plain(scaled(rows), 3, lambda i: i % 2 == 0)


def test_scores_beyond_doubles(spark):
    """Components of 3e8 and more: sums beyond 2^53 that differ in their last digits."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-(3 * 10**8), 3 * 10**8, 6)]) for i in range(60)]
    rows += [(60 + i, [3e8, 3e8, 3e8, 3e8, 3e8, float(3 * 10**8 - i)]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "id long, v array<double>")
    found = topk.PivotIndex(vectors, 4, ring=8).search(vectors.where("id % 3 = 0"))
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in found.collect())
    assert got == plain(rows, 4, lambda i: i % 3 == 0) and max(s for *_, s in got) > 2**53


def test_scores_beyond_longs_are_clamped(spark):
    vectors = spark.createDataFrame([(i, [s * 1e12, 1e12]) for i, s in enumerate((1.0, 1.0, -1.0, 3.0))], "id long, v array<double>")
    got = topk.PivotIndex(vectors, 2).search(vectors.where("id = 0")).collect()
    assert [(r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(1, 1, topk.LONG), (2, 3, topk.LONG)]


def test_one_id_with_two_vectors_and_other_columns(spark):
    rows = [(0, [1.0, 2.0], "a"), (0, [3.0, 0.0], "b"), (1, [1.0, 1.0], "c"), (1, [1.0, 1.0], "d"), (2, [0.0, 1.0], "e")]
    vectors = spark.createDataFrame(rows, "id long, v array<double>, score string")
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in topk.PivotIndex(vectors, 2).search(vectors.where("id < 2")).collect())
    assert got == plain([(0, [1.0, 2.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])], 2, lambda i: i < 2)
