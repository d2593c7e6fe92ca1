"""Exact top-k search by inner product with a pivot-distance index.

Vectors are put on a sphere by one more component, sqrt(M - |x|^2) with M the largest squared norm; queries get 0 there.
Then |q - x|^2 = |q|^2 + M - 2 q.x, and the largest inner products are the least distances. Each vector is keyed by its
nearest pivot and its distance to it, and the keys of a pivot are cut into annuli (rings). A query expands over the rings
in two steps: the rings next to its own distance at its nearest pivots give its k-th best score so far; by the triangle
inequality that bounds the distances to every other pivot at which a better vector can be, and only those rings are read
then. Distances are floating-point, so bounds are widened by ``SLACK`` of the vectors' lengths; scores and ties are compared in exact
integers (beyond 2^53 in Python's, clamped to the range of a long).

Of equal vectors only the k + 1 with the least ids are indexed: no other can be among the k results of a query other than
itself. So copies, however many, fill no ring. Rings are read as (ring, block of queries) groups; both are of bounded size,
rings by splitting those that hold more than ``RING`` vectors.

The pivots are picked from a bounded sample, ``SAMPLE`` vectors of least hash; the rings hold every vector.

Defined cases: vectors that are null or have null or non-finite components take no part; shorter vectors count as ended by
zeros; equal scores go to the smaller id; of rows with the same id the one with the least vector counts, as query and as
candidate; a query with fewer than k other vectors gets them all; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches
from inkstone.llm.scratch import Scratch

#: At least so many pivots; more where there are many vectors (the square root of their number over 64), up to ``SAMPLE`` / 4.
PIVOTS = 32
RING = 1024
QUERIES = 2048
SAMPLE = 4096
#: Nearest pivots whose nearest rings make the first step.
FIRST = 3
#: Of the lengths of query and vectors: what rounding can add to a distance (squares of them have 53 bits, so roots have half).
SLACK = 1e-6
EXACT = 2.0**53
LONG = (1 << 63) - 1


def scaled(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component, as double; null for vectors that take no part."""
    usable = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.when(usable, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double")))


def pick_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """Means of a few rounds of clustering, begun from points far from each other."""
    if not len(sample):
        return sample
    chosen = [0]
    far = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    centres = sample[chosen].astype(float)
    for _ in range(5):
        own = distances(sample, centres).argmin(1)
        for i in range(len(centres)):
            if (own == i).any():
                centres[i] = sample[own == i].mean(0)
    return centres


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    squared = (x**2).sum(1)[:, None] + (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    return np.sqrt(np.maximum(squared, 0))


def lifted(x: np.ndarray, largest: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(largest - (x**2).sum(1), 0))])


def matrix(column, width: int) -> np.ndarray:
    out = np.zeros((len(column), width))
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def whole(x: np.ndarray) -> np.ndarray:
    """Python's integers of any size."""
    return np.array([[int(v) for v in row] for row in x.tolist()], object).reshape(x.shape)


def below(x: np.ndarray, error: np.ndarray | float) -> np.ndarray:
    """A bound for scores that were worked out, or rounded, in floating point: exact ones as they are."""
    return np.where(np.abs(x) + error < EXACT, x, x - error - np.abs(x) * 2.0**-50)


def best(queries: np.ndarray, query_ids: np.ndarray, vectors: np.ndarray, ids: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of query, id, score) of each query's k best in a block of vectors, none below the query's floor."""
    order = np.argsort(ids, kind="stable")
    vectors, ids = vectors[order], ids[order]
    bound = np.abs(queries).max(initial=0) * np.abs(vectors).max(initial=0) * vectors.shape[1]
    exact = bound < EXACT
    scores = queries @ vectors.T if exact else np.clip(whole(queries) @ whole(vectors).T, -LONG - 1, LONG)
    rows, found, values = [], [], []
    for i in range(len(queries)):
        s = scores[i]
        usable = np.flatnonzero((s >= floor[i]) & (ids != query_ids[i]))
        if len(usable) > k:
            kth = np.partition(s[usable], len(usable) - k)[len(usable) - k] if exact else sorted(s[usable])[-k]
            usable = usable[s[usable] >= kth]
            usable = usable[np.lexsort((ids[usable], -s[usable].astype(float) if exact else -s[usable]))][:k] if exact else np.array(sorted(usable, key=lambda j: (-s[j], ids[j]))[:k])
        rows.append(np.full(len(usable), i))
        found.append(ids[usable])
        values.append(s[usable])
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0)
    return join(rows).astype(np.int64), join(found).astype(np.int64), np.array([int(v) for v in join(values)], np.int64)


class PivotIndex:
    """The index of a table of vectors, (``id``, ``v`` array<double>), and searches in it."""

    def __init__(self, vectors: DataFrame, k: int, pivots: int | None = None, ring: int = RING):
        self.spark, self.k = vectors.sparkSession, k
        self.scratch = Scratch(self.spark, "topk")
        modest_batches(self.spark)
        vectors = vectors.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))
        few = Window.partitionBy("v").orderBy("id")
        kept = vectors.withColumn("__k", F.row_number().over(few)).where(F.col("__k") <= k + 1).drop("__k")
        kept = self.scratch.keep(kept, "vectors")
        norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)
        self.rows, largest, width = kept.agg(F.count("*"), F.max(norm), F.max(F.size("v"))).first()
        self.largest, self.width = float(largest or 0), int(width or 0)
        sample = kept.orderBy(F.xxhash64("v"), "id").limit(SAMPLE).collect() if self.rows else []
        points = matrix([r.v for r in sample], self.width)
        self.centres = pick_pivots(lifted(points, self.largest), pivots or min(SAMPLE // 4, max(PIVOTS, math.isqrt(self.rows) // 64)))
        self.first_scores = points, np.array([r.id for r in sample], np.int64)
        self.ring = ring
        if self.rows:
            self._place(kept)

    def _place(self, vectors: DataFrame) -> None:
        centres, width, largest = self.centres, self.width, self.largest

        @F.pandas_udf("struct<pivot:int,d:double>")
        def nearest(v: pd.Series) -> pd.DataFrame:
            d = distances(lifted(matrix(v, width), largest), centres)
            own = d.argmin(1)
            return pd.DataFrame({"pivot": own.astype(np.int32), "d": d[np.arange(len(own)), own]})

        keyed = self.scratch.keep(vectors.withColumn("__n", nearest("v")).select("id", "v", "__n.pivot", "__n.d"), "keyed")
        # rings of equal width per pivot, about RING vectors in each; those that are denser are split
        span = keyed.groupBy("pivot").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high"))
        self.pivots = {r.pivot: (r.low, max((r.high - r.low) / math.ceil(r.n / self.ring), 1e-9), math.ceil(r.n / self.ring)) for r in span.collect()}
        bounds = self.spark.createDataFrame([(p, *x) for p, x in self.pivots.items()], "pivot int, low double, width double, rings int")
        placed = keyed.join(F.broadcast(bounds), "pivot").withColumn("ring", F.least(F.floor((F.col("d") - F.col("low")) / F.col("width")), F.col("rings") - 1).cast("int"))
        self.vectors = self.scratch.keep(placed.select("id", "v", "pivot", "ring", "d"), "placed")
        self.scratch.drop("vectors", "keyed")
        stats = self.vectors.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("d").alias("least"), F.max("d").alias("most"))
        self.rings = self.scratch.keep(stats, "rings")

    def _first_floor(self, queries: DataFrame) -> DataFrame:
        """Queries with their distances to all pivots and a score that k others reach at least, from the sample alone."""
        points, ids = self.first_scores
        centres, width, k, largest = self.centres, self.width, self.k, self.largest

        @F.pandas_udf("struct<d:array<double>,floor:double,reach:double,squared:double,slack:double>")
        def prepare(q: pd.Series, qid: pd.Series) -> pd.DataFrame:
            x = matrix(q, width)
            d = distances(np.column_stack([x, np.zeros(len(x))]), centres)
            scores = x @ points.T
            scores[qid.to_numpy()[:, None] == ids[None, :]] = -np.inf
            floor = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k] if scores.shape[1] >= k else np.full(len(x), -np.inf)
            squared = (x**2).sum(1)
            floor = np.minimum(below(floor, np.sqrt(squared * largest) * width * 2.0**-50), LONG * (1 - 2.0**-40))
            slack = SLACK * (1 + np.sqrt(squared) + np.sqrt(largest))
            return pd.DataFrame({"d": list(d), "floor": floor, "reach": np.sqrt(np.maximum(squared + largest - 2 * floor, 0)) + slack, "squared": squared, "slack": slack})

        return queries.withColumn("__p", prepare("v", "id")).select("id", "v", "__p.*")

    def _visits(self, queries: DataFrame) -> DataFrame:
        """(id, pivot, ring, n, away) of the rings that a query's reach touches; away: the least distance that the ring allows.

        A pivot's rings are equally wide, so those in reach are counted off, and one more at either end.
        """
        nearest = F.array_min("d")
        by_pivot = queries.select("id", "reach", nearest.alias("nearest"), F.posexplode("d").alias("pivot", "dq"))
        # a vector of this pivot is no farther from it than from the query's nearest pivot
        by_pivot = by_pivot.where((F.col("dq") - F.col("nearest")) / 2 <= F.col("reach"))
        spans = self.spark.createDataFrame([(p, *x) for p, x in self.pivots.items()], "pivot int, low double, width double, rings int")
        at = by_pivot.join(F.broadcast(spans), "pivot")  # a row for each pivot
        ring = lambda d: F.greatest(F.lit(-1.0), F.least(F.floor((d - F.col("low")) / F.col("width")).cast("double"), F.col("rings").cast("double")))
        low, high = (ring(F.col("dq") + side * F.col("reach")) for side in (-1, 1))
        touched = F.sequence(F.greatest(low - 1, F.lit(0.0)).cast("int"), F.greatest(F.lit(0.0), F.least(high + 1, F.col("rings") - 1.0)).cast("int"))
        at = at.withColumn("ring", F.explode(touched)).join(self.rings, ["pivot", "ring"])
        away = F.greatest(F.lit(0.0), F.col("dq") - F.col("most"), F.col("least") - F.col("dq"), (F.col("dq") - F.col("nearest")) / 2)
        return at.withColumn("away", away).where(F.col("away") <= F.col("reach")).select("id", "pivot", "ring", "n", "away")

    def _read(self, visits: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
        """(query, vec_id, score): the k best of each ring visited, by groups of a part of a ring and a block of queries."""
        k, width, ring = self.k, self.width, self.ring
        block = F.pmod(F.xxhash64("id"), F.lit(blocks))
        parts = F.ceil(F.col("n") / (2 * ring)).cast("int")
        asked = visits.join(queries.select("id", "v", "floor"), "id").withColumn("block", block)
        wanted = visits.select("pivot", "ring", "n", block.alias("block")).distinct()
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).select("pivot", "ring", "part", "block", F.col("id").alias("query"), "v", "floor")
        held = self.vectors.join(wanted, ["pivot", "ring"]).withColumn("part", F.pmod(F.xxhash64("id"), parts).cast("int")).select("pivot", "ring", "part", "block", "id", "v")

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({"query": [], "vec_id": [], "score": []}).astype("int64")
            rows, ids, scores = best(matrix(left["v"], width), left["query"].to_numpy(), matrix(right["v"], width), right["id"].to_numpy(), k, left["floor"].to_numpy())
            return pd.DataFrame({"query": left["query"].to_numpy()[rows], "vec_id": ids, "score": scores})

        keys = ["pivot", "ring", "part", "block"]
        return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInPandas(run, "query long, vec_id long, score long")

    def _ranked(self, found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= self.k)

    def search(self, queries: DataFrame) -> DataFrame:
        """(query_id, rank, vec_id, score) of the k best for each query (``id``, ``v``), other than its own id."""
        if not self.rows:
            return self.spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        queries = self.scratch.keep(self._first_floor(queries.where("id is not null and v is not null").groupBy("id").agg(F.min("v").alias("v"))), "queries")
        blocks = max(1, math.ceil(queries.count() / QUERIES))
        nearest = Window.partitionBy("id").orderBy("away", "pivot", "ring")
        touched = self.scratch.keep(self._visits(queries).withColumn("nth", F.row_number().over(nearest)), "visits")
        first = self.scratch.keep(self._ranked(self._read(touched.where(F.col("nth") <= FIRST), queries, blocks)), "first")
        # the k-th best so far bounds what is left to read
        score = F.col("score").cast("double")
        kth = first.where(F.col("rank") == self.k).select(F.col("query").alias("id"), F.when(F.abs(score) < EXACT, score).otherwise(score - F.abs(score) * 2.0**-50).alias("kth"))
        tighter = queries.join(kth, "id", "left").withColumn("floor", F.greatest("floor", F.coalesce("kth", "floor")))
        tighter = tighter.withColumn("reach", F.sqrt(F.greatest(F.col("squared") + self.largest - 2 * F.col("floor"), F.lit(0.0))) + F.col("slack")).drop("kth")
        tighter = self.scratch.keep(tighter, "tighter")
        rest = touched.where(F.col("nth") > FIRST).join(tighter.select("id", "reach"), "id").where(F.col("away") <= F.col("reach")).drop("reach")
        found = self._ranked(first.drop("rank").union(self._read(rest, tighter, blocks)))
        out = self.scratch.keep(found.select(F.col("query").alias("query_id"), F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "result")
        self.scratch.drop("queries", "visits", "first", "tighter")
        return out
