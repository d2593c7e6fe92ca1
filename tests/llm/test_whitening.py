"""Whitening against numpy's eigenvectors and Python's integers."""

import math

import numpy as np
from pyspark.sql import functions as F

from inkstone.llm import whitening
from tests.llm import common


def test_query_against_numpy(spark, sf_dir):
    got = common.run(spark, "op11_whitening", sf_dir)
    rows = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()}
    ids = sorted(rows)
    x = [[math.floor(64 * c) + 1_000_000 for c in rows[i]] for i in ids]
    n, dims = len(x), len(x[0])
    sums = [sum(r[d] for r in x) for d in range(dims)]
    centred = np.array([[(n * r[d] - sums[d]) / n for d in range(dims)] for r in x])
    e, u = np.linalg.eigh(centred.T @ centred / n)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    assert len(got) == n * 32 and set(got.n) == {n}
    exact = {i: sum((n * v - s) ** 2 for v, s in zip(r, sums)) for i, r in zip(ids, x)}
    assert all(exact[i] == d for i, d in zip(got.vec_id, got.deviation))
    found = got.pivot(index="vec_id", columns="component", values="whitened").loc[ids].to_numpy()
    want = centred @ u / np.sqrt(e)
    signs = np.sign((found * want).sum(axis=0))
    assert np.abs(found * signs - want).max() < 1e-8
    assert np.allclose(got.groupby("component").explained.first(), e / (sum(exact.values()) / n**3), rtol=1e-10)
    assert got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    assert abs(np.abs(found.T @ found / n - np.eye(32)).max() - got.identity_error[0]) < 1e-9


SCHEMA = "vec_id long, embedding array<double>, n string, deviation string, component string, x string"


def test_awkward_vectors(spark):
    inf, nan = math.inf, math.nan
    vectors = [[1.0, 2.0], [2.0, 1.0], [2.0, 1.0], [0.5, -3.0], None, [None, 1.0], [nan, 1.0], [inf, 1.0], [], [1.0, 2.0, 3.0]]
    rows = [(None if i == 3 else min(i, 2), v, *"abcd") for i, v in enumerate(vectors)]
    got = whitening.components(spark.createDataFrame(rows, SCHEMA)).toPandas()
    assert len(got) == 8 and set(got.n) == {4} and got.vec_id.isna().sum() == 2
    twice = got[got.vec_id == 2]
    assert len(twice) == 2 * 1 and got.groupby("component").size().tolist() == [4, 4]
    w = got[got.component == 1].whitened
    assert abs(w.mean()) < 1e-12 and abs((w**2).mean() - 1) < 1e-9 and abs(got.groupby("component").explained.first().sum() - 1) < 1e-12


def test_tables_in_which_little_varies(spark):
    for rows in ([], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(5)], [(1, None)]):
        out = whitening.components(spark.createDataFrame([(*r, *"abcd") for r in rows], SCHEMA))
        assert out.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and out.count() == 0
    # one direction of three: what the others have is rounding
    line = spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], *"abcd") for i in range(20)], SCHEMA)
    got = whitening.components(line).toPandas()
    assert set(got.component) == {1} and abs(got.explained[0] - 1) < 1e-12


def test_large_entries_stay_exact(spark):
    values = [2.0**33, -(2.0**33), 2.0**33, 1e300]
    got = whitening.components(spark.createDataFrame([(i, [v, float(i)], *"abcd") for i, v in enumerate(values)], SCHEMA)).toPandas()
    x = [[math.floor(min(64 * v, 2.0**40)) + 1_000_000, 64 * i + 1_000_000] for i, v in enumerate(values)]
    sums = [sum(c) for c in zip(*x)]
    for r in got.itertuples():
        assert int(r.deviation) == sum((4 * v - s) ** 2 for v, s in zip(x[r.vec_id], sums))


def test_deviation_beyond_a_long_is_null(spark):
    frame = spark.createDataFrame([(1,)], "i int").select(F.lit("9" * 30).cast("decimal(38,0)").alias("d"))
    assert frame.select(F.col("d").try_cast("long")).first()[0] is None
