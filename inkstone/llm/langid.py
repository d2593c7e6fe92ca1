"""Language identification by error-correcting output codes.

Each language gets a binary codeword; for each bit a linear classifier over hashed character n-grams is fitted to tell the
languages with a 1 from those with a 0. A text is scored by all bit classifiers at once. Decoding is loss-weighted: a
codeword's distance is the exponential loss of the margins against its bits, each bit weighted by how well its classifier
does on that language in training. The nearest codeword wins; a text whose two nearest are close is flagged as ambiguous.

The classifiers are fitted on a bounded sample: ``SAMPLE`` labelled documents in all, dealt evenly over the languages,
those with the least hashes of their ids. The counts behind a prediction come from the whole text.

Defined cases: null texts and texts without a letter are ``und`` with score 0; rows without a language are not learned from;
with one language every text with letters gets it, with none every text is ``und``; repeated rows each get a prediction;
other columns pass through, and output columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches
from inkstone.llm.sampling import least_hashed

BUCKETS = 1 << 11
SAMPLE = 2_000
ORDERS = (1, 2, 3)
AMBIGUOUS = 0.6
UNDETERMINED = "und"
PREDICTED = "struct<lang:string,score:double,ambiguous:boolean>"
_PREDICTED = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("ambiguous", pa.bool_())])
#: Code points are cut into stretches for the counts, so that the memory beside a text stays small.
STRETCH = 1 << 18


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point, itself if it is a letter, else a space."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha():
            table[c] = c
    return table


class Grams:
    """Hashed counts of character n-grams; everything that isn't a letter is a space, and spaces run together."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.table = buckets, _letters()

    def points(self, text: str) -> np.ndarray:
        p = self.table[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)]
        p = np.concatenate(([32], p, [32])).astype(np.uint32)
        return p[np.concatenate(([True], (p[1:] != 32) | (p[:-1] != 32)))]

    def counts(self, text: str) -> np.ndarray | None:
        """Counts of all n-grams of a whole text, or None if it has no letter."""
        p = self.points(text)
        if len(p) < 3:
            return None
        total = np.zeros(self.buckets, np.int64)
        for low in range(0, len(p), STRETCH):
            part = p[low : low + STRETCH + max(ORDERS) - 1]
            h = np.zeros(len(part), np.uint32)
            for k in range(max(ORDERS)):
                h = (h[: len(part) - k] ^ part[k:]) * np.uint32(0x9E3779B1)
                h ^= h >> np.uint32(15)
                if k + 1 in ORDERS:
                    total += np.bincount(h[: min(STRETCH, len(h))] % np.uint32(self.buckets), minlength=self.buckets)
        return total

    def features(self, text: str) -> np.ndarray | None:
        c = self.counts(text)
        if c is None:
            return None
        x = np.sqrt(c.astype(np.float32))
        return x / np.linalg.norm(x)


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1. Up to 5 classes: the exhaustive code (every way to split the classes). More: random columns from a
    fixed seed, of which those are kept that split the classes and differ from each other and their complements."""
    if n <= 5:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns, np.float32).T.reshape(n, -1)
    rng, columns = np.random.default_rng(5), {}
    while len(columns) < 10 * int(np.ceil(np.log2(n))):
        bits = rng.choice((-1, 1), n)
        bits = bits * bits[0]
        if 0 < (bits > 0).sum() < n:
            columns[tuple(bits)] = None
    return np.array(list(columns), np.float32).T


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray

    def decode(self, x: np.ndarray) -> tuple[str, float, bool]:
        if len(self.languages) < 2:
            return (self.languages[0], 1.0, False) if self.languages else (UNDETERMINED, 0.0, False)
        margins = x @ self.weights + self.bias
        loss = (self.trust * np.exp(-np.clip(2 * self.code * margins, -30, 30))).sum(1)
        odds = np.exp(loss.min() - loss)
        best = int(np.argmin(loss))
        score = float(odds[best] / odds.sum())
        return self.languages[best], score, score < AMBIGUOUS


def fit(features: np.ndarray, labels: list[str], ridge: float = 1e-3) -> Model:
    languages = sorted(set(labels))
    if len(languages) < 2:
        return Model(languages, *[np.zeros(0, np.float32)] * 4)
    code = codewords(len(languages))
    own = np.array([languages.index(v) for v in labels])
    target = code[own]
    # least squares in the dual, each language with the same weight in all
    w = np.sqrt(len(own) / (len(languages) * np.bincount(own)[own])).astype(np.float32)[:, None]
    bias = np.ones((len(own), 1), np.float32)
    a = np.hstack([features, bias]) * w
    dual = np.linalg.solve(a @ a.T + ridge * len(own) * np.eye(len(own), dtype=np.float32) / 100, target * w)
    full = a.T @ dual
    right = np.sign(np.hstack([features, bias]) @ full) == target
    trust = np.array([right[own == k].mean(0) for k in range(len(languages))], np.float32)
    trust /= np.maximum(trust.sum(1, keepdims=True), 1e-9)
    return Model(languages, code, full[:-1].astype(np.float32), full[-1], trust)


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> Model:
    """Fits the classifiers on ``sample`` documents at most. Their features, ``sample`` x ``BUCKETS`` numbers, come to the driver."""
    modest_batches(labelled.sparkSession)
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    # ids first: choosing them moves no texts
    ids = rows.select("id", "lang")
    n = max(1, ids.select("lang").distinct().count())
    chosen = rows.join(F.broadcast(least_hashed(ids, "id", "lang", max(1, sample // n), "language").distinct()), ["id", "lang"])

    @F.arrow_udf("array<float>")
    def features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            yield pa.array([grams.features(t) for t in batch.to_pylist()], pa.list_(pa.float32()))

    got = chosen.select("id", "lang", features("text").alias("x")).where("x is not null").toArrow().sort_by([("id", "ascending"), ("lang", "ascending")])
    x = np.asarray(got["x"].combine_chunks().flatten()).reshape(-1, BUCKETS) if got.num_rows else np.zeros((0, BUCKETS), np.float32)
    return fit(x, got["lang"].to_pylist())


def predict(text: Column, model: Model) -> Column:
    """Struct column: language, score and whether it is ambiguous."""

    @F.arrow_udf(PREDICTED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        grams = Grams()
        for batch in batches:
            out = []
            for t in batch.to_pylist():
                x = grams.features(t) if t else None
                out.append(dict(zip(("lang", "score", "ambiguous"), (UNDETERMINED, 0.0, False) if x is None else model.decode(x), strict=True)))
            yield pa.array(out, _PREDICTED)

    return run(text)


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    modest_batches(docs.sparkSession)
    found = docs.withColumn("__found", predict(F.col(text_col), model))
    return found.withColumns({"lang_pred": F.col("__found.lang"), "score": F.col("__found.score"), "ambiguous": F.col("__found.ambiguous")}).drop("__found")
