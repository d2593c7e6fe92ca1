"""Deleted interpolation: texts scored by word bigrams, mixed with words and a uniform share.

Tokens are words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end of the text. A token w after v has the probability
a f(w | v) + b f(w) + c / (V + 1), where f are maximum-likelihood estimates and the weights a, b, c belong to the bucket of
v's count (powers of two). The weights are learned by expectation-maximisation on an eighth of the training documents, with the
counts of the other seven; the model then has the counts of all of them.

How it runs: documents are gathered in pages, written once: the page's distinct words, its tokens as their numbers. Each page
sends each bucket of a hash one block with its distinct words and bigrams of that bucket and their counts; a bucket sums the
blocks and sends each page back the counts of what the page asked for. So each distinct word or bigram of a page moves twice,
however often it occurs, and one that a third of all tokens are costs one entry a page. The number of buckets grows with the
tokens. Nothing of the vocabulary is ever in one place; the driver gets totals and sums by bucket of counts.

Words are told apart by their bytes, so that ``base_score`` is exact; bigrams by ``KEY_BITS`` bits of a hash, so that among 10^9
distinct ones some seven pairs are taken as one. Keys are sent sorted, as differences, which leaves under five bytes each.

Defined results: a null text is empty (its end alone is scored); a null id is in training and not held out. With no training
document all counts are zero: ``base_score`` is log10(1) a token, ``score`` is finite too. Repeated rows and ids count as often
as they stand there. Texts are taken whole; a page holds at least one text, however long. Columns of other names are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

#: Bytes of text in a page, but for a text that is longer.
PAGE = 8 << 20
#: Tokens for each bucket of words and bigrams.
BUCKET = 2 << 20
#: One of so many training documents gives the weights, not the counts, while the weights are learned.
DELETED = 8
#: Buckets of context counts: 0, 1, 2-3, 4-7 and so on.
CONTEXTS = 64
ROUNDS = 12
KEY_BITS = 56
#: Least weight of the uniform share, so that no word is impossible.
FLOOR = 1e-6

TRAIN, GONE, HELD_OUT = 0, 1, 2  # counted; counted, but not for the weights; only scored

PAGES = "page long, ids array<{id}>, parts binary, lengths binary, words binary, tokens binary, n_tokens long, n_train long, n_gone long"
BLOCKS = "bucket int, page long, words binary, word_counts binary, bigrams binary, bigram_counts binary"
ANSWERS = "page long, bucket int, word_counts binary, bigram_counts binary, distinct long"
COUNTED = "page long, ids array<{id}>, parts binary, lengths binary, tokens binary, words binary, pairs binary, distinct long"

_codec = pa.Codec("zstd", 1)


def packed(a: np.ndarray) -> bytes:
    """An array of integers by planes of bytes, compressed, with its length and type before it."""
    planes = np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.itemsize).T
    return np.array([len(a), a.itemsize], dtype=np.int64).tobytes() + _codec.compress(planes.tobytes(), asbytes=True)


def unpacked(b: bytes, dtype) -> np.ndarray:
    n, size = np.frombuffer(b[:16], dtype=np.int64)
    planes = np.frombuffer(_codec.decompress(b[16:], int(n * size), asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(planes.reshape(size, n).T).view(dtype).reshape(n)


def packed_words(words: pa.Array) -> bytes:
    """A large binary array, compressed."""
    lengths = pc.binary_length(words).to_numpy(zero_copy_only=False).astype(np.uint32)
    start, end = (words.offset, words.offset + len(words))
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int64)[start : end + 1] if len(words) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]] if len(words) and words.buffers()[2] else np.zeros(0, dtype=np.uint8)
    head = packed(lengths)
    return np.array([len(head)], dtype=np.int64).tobytes() + head + packed(data)


def unpacked_words(b: bytes) -> pa.Array:
    n = int(np.frombuffer(b[:8], dtype=np.int64)[0])
    lengths, data = unpacked(b[8 : 8 + n], np.uint32), unpacked(b[8 + n :], np.uint8)
    offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _strings(column: pa.Array) -> pa.Array:
    return column.cast(pa.large_string()).fill_null("")


def tokenized(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Distinct words, the end of a text being an empty one; the tokens as numbers of words; the tokens of each text."""
    split = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words = split.flatten()
    there = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)  # white space at the ends leaves empty words
    ends = np.asarray(split.offsets)
    before = np.concatenate([[0], np.cumsum(there)])
    lengths = np.diff(before[ends - ends[0]])
    coded = words.filter(pa.array(there)).dictionary_encode()
    known, numbers = coded.dictionary.cast(pa.large_binary()), coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
    at = np.cumsum(lengths + 1) - 1
    tokens = np.full(len(numbers) + len(lengths), len(known), dtype=np.int32)
    inside = np.ones(len(tokens), dtype=bool)
    inside[at] = False
    tokens[inside] = numbers
    return pa.concat_arrays([known, pa.array([b""], pa.large_binary())]), tokens, lengths + 1


def pages(rows: DataFrame) -> DataFrame:
    """``id``, ``text`` and ``part`` as pages."""
    id_type = rows.schema["id"].dataType.simpleString()

    def page(number: int, batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        column = lambda name: table.column(name).combine_chunks() if table.num_rows else table.column(name).chunk(0)
        words, tokens, lengths = tokenized(_strings(column("text")))
        parts = column("part").to_numpy(zero_copy_only=False).astype(np.int8)
        of = np.bincount(parts, weights=lengths, minlength=3).astype(np.int64)
        ids = column("id")
        row = [pa.array([number]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), *(pa.array([packed(a)]) for a in (parts, lengths.astype(np.int64))), pa.array([packed_words(words)])]
        row += [pa.array([packed(tokens)]), *(pa.array([int(v)]) for v in (len(tokens), of[TRAIN] + of[GONE], of[GONE]))]
        return pa.RecordBatch.from_arrays(row, ["page", "ids", "parts", "lengths", "words", "tokens", "n_tokens", "n_train", "n_gone"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            lengths = pc.binary_length(_strings(batch.column("text"))).to_numpy(zero_copy_only=False)
            start = 0
            for i, n in enumerate(lengths):
                size += int(n)
                if size >= PAGE:
                    held.append(batch.slice(start, i + 1 - start))
                    yield page(number, held)
                    number, held, size, start = number + 1, [], 0, i + 1
            if start < len(lengths):
                held.append(batch.slice(start))
        if held:
            yield page(number, held)
        release()

    return rows.mapInArrow(run, PAGES.format(id=id_type))


class Page:
    """What a page asks the buckets for, in the same order each time it is read."""

    def __init__(self, words: pa.Array, tokens: np.ndarray, parts: np.ndarray, lengths: np.ndarray, buckets: int):
        self.words, self.tokens = words, tokens
        self.part = np.repeat(parts, lengths)
        hashed = pd.util.hash_array(np.array(words.to_pylist(), dtype=object), categorize=False)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
        last = np.empty_like(tokens)
        last[1:] = tokens[:-1]
        last[starts] = len(words) - 1  # the end of a text is also what stands before its first word
        pairs, self.pair_of = np.unique(last.astype(np.int64) * len(words) + tokens, return_inverse=True)
        keys = hashed[pairs // len(words)] * np.uint64(0x9E3779B97F4A7C15) ^ hashed[pairs % len(words)]
        keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        keys = (keys ^ (keys >> np.uint64(32))) >> np.uint64(64 - KEY_BITS)
        word_bucket = (hashed % np.uint64(buckets)).astype(np.int64)
        self.word_order = np.argsort(word_bucket, kind="stable")
        self.word_cuts = np.searchsorted(word_bucket[self.word_order], np.arange(buckets + 1))
        # buckets are ranges of keys
        self.pair_order, self.n_pairs = np.argsort(keys), len(pairs)
        self.keys = keys[self.pair_order]
        bounds = np.array([(b << KEY_BITS) // buckets for b in range(buckets)], dtype=np.uint64)
        self.pair_cuts = np.append(np.searchsorted(self.keys, bounds), len(pairs))

    def counts(self, of: np.ndarray, size: int, order: np.ndarray) -> np.ndarray:
        """[counted, deleted] of each distinct word or bigram."""
        return np.stack([np.bincount(of[keep], minlength=size)[order] for keep in (self.part != HELD_OUT, self.part == GONE)], axis=1).astype(np.uint32)


def _page_of(row: dict, buckets: int) -> Page:
    return Page(unpacked_words(row["words"].as_py()), unpacked(row["tokens"].as_py(), np.int32), unpacked(row["parts"].as_py(), np.int8), unpacked(row["lengths"].as_py(), np.int64), buckets)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: batch.column(name)[i] for name in batch.schema.names}


def blocks(paged: DataFrame, buckets: int) -> DataFrame:
    """What each page has for each bucket; a row even where that is nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                page = _page_of(row, buckets)
                word_counts, pair_counts = page.counts(page.tokens, len(page.words), page.word_order), page.counts(page.pair_of, page.n_pairs, page.pair_order)
                words = page.words.take(pa.array(page.word_order))
                made = []
                for b in range(buckets):
                    w, p = slice(page.word_cuts[b], page.word_cuts[b + 1]), slice(page.pair_cuts[b], page.pair_cuts[b + 1])
                    keys = page.keys[p]
                    made.append((packed_words(words.slice(w.start, w.stop - w.start)), packed(word_counts[w].ravel()), packed(np.diff(keys, prepend=np.uint64(0))), packed(pair_counts[p].ravel())))
                columns = [pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, row["page"].as_py())), *(pa.array([m[i] for m in made], pa.binary()) for i in range(4))]
                yield pa.RecordBatch.from_arrays(columns, ["bucket", "page", "words", "word_counts", "bigrams", "bigram_counts"])
        release()

    return paged.select("page", "parts", "lengths", "words", "tokens").mapInArrow(run, BLOCKS)


def _summed(numbers: np.ndarray, size: int, counts: np.ndarray) -> np.ndarray:
    """Totals by number, as each entry's answer: [counted, deleted]."""
    return np.stack([np.bincount(numbers, weights=counts[:, k], minlength=size).astype(np.int64) for k in (0, 1)], axis=1)


def answers(asked: DataFrame) -> DataFrame:
    """For each page and bucket the counts over all pages, in the order of the block; and the words of the bucket in training."""

    def run(table: pa.Table) -> pa.Table:
        words = pa.concat_arrays([unpacked_words(b.as_py()) for b in table.column("words")])
        word_counts = [unpacked(b.as_py(), np.uint32).reshape(-1, 2) for b in table.column("word_counts")]
        keys = [np.cumsum(unpacked(b.as_py(), np.uint64), dtype=np.uint64) for b in table.column("bigrams")]
        pair_counts = [unpacked(b.as_py(), np.uint32).reshape(-1, 2) for b in table.column("bigram_counts")]
        coded = words.dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False)
        totals = _summed(numbers, len(coded.dictionary), np.concatenate(word_counts))
        distinct = int((totals[:, 0] > 0).sum())
        found = totals[numbers]
        _, pair_numbers = np.unique(np.concatenate(keys), return_inverse=True)
        pair_totals = _summed(pair_numbers, int(pair_numbers.max()) + 1 if len(pair_numbers) else 0, np.concatenate(pair_counts))[pair_numbers]
        cuts, pair_cuts = (np.cumsum([0, *map(len, c)]) for c in (word_counts, keys))
        back = lambda a, c: pa.array([packed(a[c[i] : c[i + 1]].ravel()) for i in range(table.num_rows)], pa.binary())
        out = pa.table([table.column("page"), table.column("bucket"), back(found, cuts), back(pair_totals, pair_cuts), pa.array(np.full(table.num_rows, distinct))], names=["page", "bucket", "word_counts", "bigram_counts", "distinct"])
        release()
        return out

    return asked.groupBy("bucket").applyInArrow(run, ANSWERS)


def counted(paged: DataFrame, answered: DataFrame, buckets: int) -> DataFrame:
    """The pages with the counts of their words (by word) and bigrams (by token)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        by_bucket = right.sort_by("bucket")
        distinct = sum(by_bucket.column("distinct").to_pylist())
        for row in _rows(left.combine_chunks().to_batches()[0]) if left.num_rows else ():
            page = _page_of(row, buckets)
            join = lambda name: np.concatenate([unpacked(b.as_py(), np.int64) for b in by_bucket.column(name)]).reshape(-1, 2)
            words, pairs = np.empty((len(page.words), 2), dtype=np.int64), np.empty((page.n_pairs, 2), dtype=np.int64)
            words[page.word_order], pairs[page.pair_order] = join("word_counts"), join("bigram_counts")
            pairs = pairs[page.pair_of]
            pairs[page.part != GONE, 1] = 0  # asked for in deleted documents alone
            out.append({"page": row["page"], "ids": row["ids"], "parts": row["parts"], "lengths": row["lengths"], "tokens": row["tokens"], "words": packed(words.ravel()), "pairs": packed(pairs.ravel()), "distinct": distinct})
        release()
        id_type = left.schema.field("ids").type
        types = [("page", pa.int64()), ("ids", id_type), ("parts", pa.binary()), ("lengths", pa.binary()), ("tokens", pa.binary()), ("words", pa.binary()), ("pairs", pa.binary()), ("distinct", pa.int64())]
        value = lambda v: v.as_py() if isinstance(v, pa.Scalar) else v
        return pa.table([pa.array([value(o[name]) for o in out], kind) for name, kind in types], schema=pa.schema(types))

    id_type = paged.schema["ids"].dataType.elementType.simpleString()
    asked = paged.select("page", "ids", "parts", "lengths", "words", "tokens")
    return asked.groupBy("page").cogroup(answered.groupBy("page")).applyInArrow(run, COUNTED.format(id=id_type))


class Tokens:
    """The tokens of a counted page, with the counts that the model asks for."""

    def __init__(self, row: dict):
        self.parts, self.lengths = unpacked(row["parts"].as_py(), np.int8), unpacked(row["lengths"].as_py(), np.int64)
        tokens = unpacked(row["tokens"].as_py(), np.int32)
        words, self.pairs = unpacked(row["words"].as_py(), np.int64).reshape(-1, 2), unpacked(row["pairs"].as_py(), np.int64).reshape(-1, 2)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]]).astype(np.int64)
        last = np.empty_like(tokens)
        last[1:] = tokens[:-1]
        last[self.starts] = len(words) - 1
        self.words, self.contexts = words[tokens], words[last]

    def estimates(self, n: int, kept: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bucket of the context, f(w | v), f(w). A context's count as such is that of the word: each is followed by one token,
        the end by the first of a text."""
        of = lambda a: a[:, 0] - a[:, 1] * kept
        context, pair, word = of(self.contexts), of(self.pairs), of(self.words)
        return context_bucket(context), pair / np.maximum(context, 1), word / max(n, 1)


def context_bucket(count: np.ndarray) -> np.ndarray:
    return np.where(count > 0, np.frexp(np.maximum(count, 1).astype(np.float64))[1], 0)


def evidence(counts: DataFrame, n_kept: int) -> DataFrame:
    """A row for each token of the deleted documents that is unlike the page's others: bucket, estimates, how many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                t = Tokens(row)
                gone = np.repeat(t.parts, t.lengths) == GONE
                b, f2, f1 = (a[gone] for a in t.estimates(n_kept, kept=True))
                found = pd.DataFrame({"b": b.astype(np.int32), "f2": f2, "f1": f1}).value_counts(sort=False)
                yield pa.RecordBatch.from_arrays([*(pa.array(found.index.get_level_values(k).to_numpy()) for k in range(3)), pa.array(found.to_numpy(dtype=np.int64))], ["b", "f2", "f1", "h"])
        release()

    return counts.select("parts", "lengths", "tokens", "words", "pairs").mapInArrow(run, "b int, f2 double, f1 double, h long")


def learned(held: DataFrame, vocabulary: int) -> np.ndarray:
    """Weights by bucket of the context's count, by expectation-maximisation: of f(w | v), f(w) and the uniform share."""
    weights = np.full((CONTEXTS, 3), 1 / 3)
    weights[0] = 0, 0.5, 0.5  # no context, no estimate from it
    uniform = 1 / (vocabulary + 1)
    for _ in range(ROUNDS):
        listed = F.array(*[F.array(*[F.lit(float(v)) for v in w]) for w in weights])
        shares = [F.get(F.get(listed, F.col("b")), F.lit(k)) * p for k, p in enumerate((F.col("f2"), F.col("f1"), F.lit(uniform)))]
        rows = held.select("b", "h", *[s.alias(f"s{k}") for k, s in enumerate(shares)])
        rows = rows.withColumn("all", F.col("s0") + F.col("s1") + F.col("s2"))
        sums = rows.groupBy("b").agg(*[F.sum(F.col("h") * F.try_divide(F.col(f"s{k}"), F.col("all"))).alias(f"s{k}") for k in range(3)]).collect()
        was = weights.copy()
        for r in sums:
            found = np.array([r["s0"] or 0.0, r["s1"] or 0.0, r["s2"] or 0.0])
            if found.sum() > 0:
                weights[r["b"]] = found / found.sum()
        if np.abs(weights - was).max() < 1e-4:
            break
    weights[:, 2] = np.maximum(weights[:, 2], FLOOR)
    return weights / weights.sum(axis=1, keepdims=True)


def scored(counts: DataFrame, weights: np.ndarray, n: int, vocabulary: int) -> DataFrame:
    """``id held_out n_tokens n_known base_score score``"""
    id_type = counts.schema["ids"].dataType.elementType.simpleString()
    uniform = 1 / (vocabulary + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                t = Tokens(row)
                b, f2, f1 = t.estimates(n, kept=False)
                w = weights[b]
                score = np.log10(w[:, 0] * f2 + w[:, 1] * f1 + w[:, 2] * uniform)
                count = t.words[:, 0]
                base = np.log10((count + 0.1) / (n + 0.1 * (vocabulary + 1)))
                total = lambda a: np.add.reduceat(a, t.starts) if len(t.starts) else a[:0]
                ids = row["ids"].values
                columns = [ids, pa.array(t.parts == HELD_OUT), pa.array(t.lengths), pa.array(total((count > 0).astype(np.int64))), pa.array(total(base)), pa.array(total(score))]
                yield pa.RecordBatch.from_arrays(columns, ["id", "held_out", "n_tokens", "n_known", "base_score", "score"])
        release()

    return counts.select("ids", "parts", "lengths", "tokens", "words", "pairs").mapInArrow(run, f"id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")


def lm_scores(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id held_out n_tokens n_known train_tokens base_score score`` of each document; those not held out are learned from."""
    spark = docs.sparkSession
    modest_batches(spark)
    scratch = Scratch(spark, "ngramlm")
    part = F.when(F.coalesce(held_out, F.lit(False)), HELD_OUT).when(F.pmod(F.xxhash64(F.lit("deleted"), F.col(id_col)), F.lit(DELETED)) == 0, GONE).otherwise(TRAIN)
    paged = scratch.keep(pages(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), part.cast("int").alias("part"))), "pages")
    size, n, gone = (int(v or 0) for v in paged.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_gone")).first())
    buckets = max(1, -(-size // BUCKET))
    answered = answers(blocks(paged, buckets))
    counts = scratch.keep(counted(paged, answered, buckets), "counted")
    scratch.drop("pages")
    vocabulary = int(counts.agg(F.max("distinct")).first()[0] or 0)
    held = scratch.keep(evidence(counts, n - gone), "evidence")
    weights = learned(held, vocabulary)
    scratch.drop("evidence")
    return scored(counts, weights, n, vocabulary).withColumn("train_tokens", F.lit(n).cast("long"))
