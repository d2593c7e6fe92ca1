"""Quality classifier by importance resampling.

Two generative models over hashed n-grams, one of target text (documents labelled as good) and one of raw text (all
documents), give each document an importance weight: the log of the ratio of its likelihoods. The ratio per n-gram is the
quality score; a threshold on it, set where it best tells the labelled documents apart, rejects documents. Of the accepted
ones a sample in proportion to their weights is drawn by Gumbel top-k: the k largest of log weight plus Gumbel noise, the
noise being a hash of the document's id.

The n-grams are those of words (hashed to ``WORD_BUCKETS``) and of word shapes: letter case, symbols, and whether the word
repeats one of the two words before it or its line repeats the line before it. Each n-gram model is a multinomial; the two
kinds are independent of each other in the model.

Raw counts cover all documents. Target counts and the threshold come from a bounded sample of labelled documents: at most
``SAMPLE`` of either label, those with the least hashes of their ids.

Defined cases: null texts and texts without words have score and weight 0 and are rejected; rows of the labels with null id
or label take no part; without good or without bad labels nothing is rejected but texts without words; repeated documents
each get a row; other columns pass through, and output columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.sampling import least_hashed
from inkstone.llm.scratch import Scratch

WORD_BUCKETS = 1 << 13
SHAPES = 24
SHAPE_GRAMS = SHAPES**2
BUCKETS = WORD_BUCKETS + SHAPE_GRAMS
SAMPLE = 20_000
#: Added to every count: half an n-gram a bucket for words, more for shapes, of which each stands for many words.
SMOOTH_WORD, SMOOTH_SHAPE = 0.5, 20.0
#: Of a text's score, the part that the words have; the shapes have the rest.
WORD_PART = 0.25
SCORED = "struct<n_grams:long,log_weight:double,score:double>"
_SCORED = pa.struct([("n_grams", pa.int64()), ("log_weight", pa.float64()), ("score", pa.float64())])
#: Words whose codes a worker keeps; beyond, they are forgotten and made anew.
_MOST_WORDS = 100_000


def shape(word: str) -> int:
    """0 to 5: case and symbols of a word."""
    if word.isalpha():
        return 3 if len(word) > 1 and word.isupper() else 4
    letters = sum(map(str.isalpha, word))
    marks = sum(not c.isalnum() for c in word)
    if not letters:
        return 0 if marks < len(word) else 1
    if marks > 1:
        return 2
    if len(word) - marks > 1 and word.isupper():
        return 3
    return 4 if marks == 0 or word[-1] in ".,;:?!" else 5


class Codes(dict):
    """Hash and shape of a word, made on first sight."""

    def __missing__(self, word: str) -> int:
        code = self[word] = crc32(word.lower().encode()) << 3 | shape(word)
        return code


class Grams:
    """Counts of the n-grams of whole texts, with a bounded memory of words seen."""

    def __init__(self):
        self.codes = Codes()

    def of(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of word n-grams and of shape n-grams of one text."""
        if len(self.codes) > _MOST_WORDS:
            self.codes.clear()
        found = text.split()
        codes = np.fromiter(map(self.codes.__getitem__, found), np.uint64, len(found))
        h = codes >> np.uint64(3)
        words = np.concatenate([h, (h[:-1] * np.uint64(0x9E3779B1) ^ h[1:]) * np.uint64(0x85EBCA77) >> np.uint64(9)]) % np.uint64(WORD_BUCKETS)
        kind = (codes & np.uint64(7)).astype(np.int64)
        again = np.zeros(len(h), bool)
        for back in (1, 2):
            again[back:] |= codes[back:] == codes[:-back]
        kind += 6 * again
        lines = text.split("\n")
        if any(map(eq, lines, islice(lines, 1, None))):
            kind += 12 * self._repeated(lines)
        return words.astype(np.int64), np.concatenate([kind[:-1] * SHAPES + kind[1:], kind[:1] * SHAPES + kind[:1]]) + WORD_BUCKETS

    @staticmethod
    def _repeated(lines: list[str]) -> np.ndarray:
        """For each word, whether its line equals the line before."""
        sizes = [len(line.split()) for line in lines]
        return np.repeat([line == before for before, line in zip([None, *lines], lines, strict=False)], sizes).astype(np.int64)

    def counts(self, text: str) -> np.ndarray:
        return np.bincount(np.concatenate(self.of(text)), minlength=BUCKETS)


@dataclass
class Model:
    """Log ratio of each bucket, and the score below which a document is rejected."""

    ratio: np.ndarray
    threshold: float = -np.inf

    def score(self, text: str | None, grams: Grams) -> tuple[int, float, float]:
        """n-grams, log weight, score."""
        words, shapes = grams.of(text) if text else ((), ())
        if not len(words):
            return 0, 0.0, 0.0
        w, s = self.ratio[words], self.ratio[shapes]
        return len(words) + len(shapes), float(w.sum() + s.sum()), float(WORD_PART * w.mean() + (1 - WORD_PART) * s.mean())


def ratios(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log of target over raw probability, word and shape buckets apart."""
    out = np.zeros(BUCKETS)
    for part, smooth in ((slice(0, WORD_BUCKETS), SMOOTH_WORD), (slice(WORD_BUCKETS, BUCKETS), SMOOTH_SHAPE)):
        r, t = raw[part].astype(float), target[part].astype(float)
        # the target is smoothed towards the raw text, so that a bucket without evidence has ratio 0
        p = (r + 1e-9) / (r.sum() + 1e-9 * len(r))
        out[part] = np.log((t + smooth * len(r) * p) / ((t.sum() + smooth * len(r)) * p))
    return out


def sample_ids(labels: DataFrame, id_col: str, label_col: str, sample: int) -> DataFrame:
    """At most ``sample`` ids of either label; an id with both labels counts as bad."""
    rows = labels.select(F.col(id_col).alias("__id"), (F.col(label_col) > 0).alias("__good")).dropna().groupBy("__id").agg(F.min("__good").alias("__good"))
    return least_hashed(rows, "__id", "__good", sample, "quality")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of one task: raw counts, and target counts of the sampled good documents."""
    grams, raw, target = Grams(), np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for text, good in zip(batch.column("text").to_pylist(), batch.column("good").to_pylist(), strict=True):
            if text and not text.isspace():
                c = grams.counts(text)
                raw += c
                if good:
                    target += c
    found = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(found.astype(np.int32)), pa.array(raw[found]), pa.array(target[found])], ["bucket", "raw", "target"])
    del grams
    release()


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model:
    """Counts over all documents, then the threshold from the sample's scores (at most 2 x ``sample`` of them)."""
    modest_batches(docs.sparkSession)
    # 2 x sample ids at most
    chosen = F.broadcast(sample_ids(labels, id_col, label_col, sample))
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("text")).join(chosen, "__id", "left")
    sums = rows.select("text", F.col("__good").alias("good")).mapInArrow(_count, "bucket int, raw long, target long")
    got = sums.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()
    raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in got:
        raw[r.bucket], target[r.bucket] = r.raw, r.target
    if not target.any():
        return Model(np.zeros(BUCKETS))
    model = Model(ratios(raw, target))
    scored = rows.where("__good is not null").select("__good", score(F.col("text"), model).alias("s"))
    # texts without n-grams are left out here: Spark would push a filter on scores below the join, where every text is scored for it
    pairs = scored.select("__good", "s.n_grams", "s.score").toArrow().filter(pc.field("n_grams") > 0)
    model.threshold = best_threshold(pairs["score"].to_numpy(), pairs["__good"].to_numpy(zero_copy_only=False))
    return model


def best_threshold(scores: np.ndarray, good: np.ndarray) -> float:
    """Where the shares of bad documents above and of good ones below are least in sum, the latter counted four times: the middle of the widest such gap."""
    if not len(scores) or good.all() or not good.any():
        return -np.inf
    order = np.argsort(scores, kind="stable")
    s, g = scores[order], good[order].astype(bool)
    lost = np.concatenate(([0], np.cumsum(g))) / g.sum()
    kept = 1 - np.concatenate(([0], np.cumsum(~g))) / (~g).sum()
    cost = 4 * lost + kept
    edges = np.concatenate(([s[0] - 1], s, [s[-1] + 1]))
    gap = edges[1:] - edges[:-1]
    best = np.flatnonzero((cost <= cost.min() + 1e-12) & (gap > 0))
    k = best[np.argmax(gap[best])]
    return float((edges[k] + edges[k + 1]) / 2)


def score(text: Column, model: Model) -> Column:
    @F.arrow_udf(SCORED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            found = np.array([model.score(t, grams) for t in batch.to_pylist()], float).reshape(-1, 3)
            yield pa.StructArray.from_arrays([pa.array(found[:, 0].astype(np.int64)), pa.array(found[:, 1]), pa.array(found[:, 2])], fields=list(_SCORED))
        del grams
        release()

    return run(text)


def classify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``log_weight``, ``score``, ``accepted`` and ``gumbel``, the key of the top-k draw."""
    modest_batches(docs.sparkSession)
    found = docs.withColumn("__s", score(F.col(text_col), model))
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit("gumbel"), F.col(id_col)), 11) + F.lit(0.5)) * F.lit(2.0**-53)
    found = found.withColumns({"log_weight": F.col("__s.log_weight"), "score": F.col("__s.score"), "accepted": (F.col("__s.n_grams") > 0) & (F.col("__s.score") >= F.lit(float(model.threshold)))})
    return found.withColumn("gumbel", F.col("log_weight") - F.log(-F.log(uniform))).drop("__s")


def largest(df: DataFrame, key: str, tie: str, k: int, where: Column, bins: int = 4096, few: int = 10_000) -> tuple[float, object] | None:
    """The (key, tie) of the k-th row by descending key and ascending tie, among the rows of ``where``; None if there are at most k. k is 1 or more.

    Counts per bin of the key narrow the range until few rows are left; only those come to the driver.
    """
    rows = df.where(where & F.col(key).isNotNull())
    low, high, n = rows.agg(F.min(key), F.max(key), F.count("*")).first()
    if n <= k:
        return None
    left = k
    inside = F.lit(True)
    while n > few and low < high:
        width = (high - low) / bins
        number = F.least(F.floor((F.col(key) - F.lit(low)) / F.lit(width)), F.lit(bins - 1))
        counts = rows.where(inside).groupBy(number.alias("bin")).agg(F.count("*").alias("n"), F.min(key).alias("low"), F.max(key).alias("high")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if left <= r.n:
                break
            left -= r.n
        if r.n == n:
            break
        low, high, n = r.low, r.high, r.n
        inside = F.col(key).between(low, high)
    if low == high and n > few:
        return low, kth_smallest(rows.where(inside), tie, left)
    rest = rows.where(inside).select(key, tie).collect()
    r = sorted(rest, key=lambda r: (-r[0], *_nulls_first(r[1])))[left - 1]
    return r[0], r[1]


def _nulls_first(value) -> tuple:
    return (False, 0) if value is None else (True, value)


def kth_smallest(rows: DataFrame, column: str, k: int) -> object:
    """The k-th smallest value of any number of rows: they are counted by value and dealt out by ranges, the ranges' sums tell
    which one holds it, and only in that one are values passed over."""
    scratch = Scratch(rows.sparkSession, "kth")
    counts = rows.groupBy(column).agg(F.count("*").alias("__n"))
    # written once: ranges are cut by a sample, and must stay the same for the second look
    dealt = scratch.keep(counts.repartitionByRange(column).withColumn("__range", F.spark_partition_id()), "ranges")
    for r in sorted(dealt.groupBy("__range").agg(F.sum("__n").alias("n"), F.min(column).alias("low")).collect(), key=lambda r: _nulls_first(r.low)):
        if k <= r.n:
            break
        k -= r.n
    before = Window.partitionBy("__range").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = dealt.where(F.col("__range") == r["__range"]).withColumn("__to", F.sum("__n").over(before)).where(F.col("__to") >= k).agg(F.min_by(column, "__to")).first()[0]
    scratch.drop("ranges")
    return found


def resample(scored: DataFrame, k: int, id_col: str = "doc_id") -> DataFrame:
    """``scored`` (of :func:`classify`) with ``sampled``: the accepted documents with the k largest Gumbel keys, ties to smaller
    ids, null before any; none if k is not positive. Rows with the id of the last one are all in."""
    if k <= 0:
        return scored.withColumn("sampled", F.lit(False))
    last = largest(scored, "gumbel", id_col, k, F.col("accepted"))
    if last is None:
        return scored.withColumn("sampled", F.col("accepted"))
    key, tie = last
    first = F.col(id_col).isNull() if tie is None else F.col(id_col).isNull() | (F.col(id_col) <= F.lit(tie))
    return scored.withColumn("sampled", F.col("accepted") & ((F.col("gumbel") > F.lit(key)) | ((F.col("gumbel") == F.lit(key)) & first)))
