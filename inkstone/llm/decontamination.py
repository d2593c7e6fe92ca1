"""Benchmark decontamination with a positional inverted index.

The training texts are indexed by the terms of the benchmark. A task numbers the words of its documents through, with a gap
between documents, in *segments* of about ``SEGMENT`` words, and stores a posting list for each test term of a segment: (segment,
term, gaps between positions). A segment also has a row for each document with its first position. The index is written once to
shared scratch, and everything else is read from it.

Benchmark items are cut into windows of consecutive words. Frequencies of the terms, summed over the index, order the terms of
each window from the rarest; windows with a term that no document has are left out. The postings of the others' terms, found
by a join of index and terms, meet by segment, where a window is looked up by its rarest term's list, and the other lists,
shifted by their offsets in the window, are intersected one by one in that order until nothing is left. What survives all terms
is an exact phrase occurrence. Around the rarest term's positions the same lists answer proximity: all distinct terms of the
window within ``slop`` words more than its length, in any order.

Words: A-Z in lower case, then maximal runs of 0-9, a-z and non-ASCII characters.

The benchmark is taken in slices of about ``slice_bytes`` of text, each a job of its own over the same index, so the driver and
the tasks hold the windows of one slice at a time. Which words are test terms is known to the indexing tasks as ``TERM_BITS``
hash bits, whatever the benchmark's size; a word that is none but shares a bit is indexed in vain.

Defined cases: null texts have no words; an item without words has no window, an item shorter than a window is one window;
items with the same id count as one item; a null item id takes no part; an empty benchmark or table gives no matches;
repeated documents each get their own result, null ids too; other columns pass through, and output columns replace those of the
same name. A text's words are one list of 32-bit positions, and lie in one segment.
"""

from __future__ import annotations

import math
import random
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

WINDOW = 13
#: Words that may stand among a window's words in a near match: one or two inserted, or any number swapped.
SLOP = 2
SLICE_BYTES = 1 << 20
SEGMENT = 1 << 21
TERM_BITS = 1 << 22
#: Words whose numbers a task keeps beside the test terms.
MOST_WORDS = 100_000
MATCHES = "array<struct<item_id:string,start:int,end:int,kind:string>>"
_MATCH = pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())])

_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: Maps A-Z to lower case and every byte outside words to a space. Works on UTF-8: all bytes of non-ASCII characters are word bytes.
FOLD = bytes(b if b in _WORD else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def _bit(word: bytes) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(word) % TERM_BITS


class TestWindows:
    """The windows of one slice of the benchmark, as tuples of term numbers."""

    def __init__(self, items: list[tuple[str, bytes]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        seen: dict[tuple[int, ...], set[str]] = {}
        for item_id, text in items:
            terms = tuple(self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(text))
            for i in range(max(1, len(terms) - window + 1) if terms else 0):
                seen.setdefault(terms[i : i + window], set()).add(item_id)
        self.windows = [(w, sorted(ids)) for w, ids in seen.items()]

    def order(self, frequency: dict[bytes, int]) -> list[bytes]:
        """Fixes each window's probes, (term, offset) from the rarest term, and leaves out windows with a term that no document
        has. The terms that are still needed."""
        n = [frequency.get(w, 0) for w in self.vocabulary]
        self.windows = [(terms, ids) for terms, ids in self.windows if all(n[t] for t in terms)]
        self.probes = [sorted(((t, k) for k, t in enumerate(terms)), key=lambda p: (n[p[0]], p)) for terms, _ in self.windows]
        needed = {t for terms, _ in self.windows for t in terms}
        return [w for w, t in self.vocabulary.items() if t in needed]

    def matches(self, postings: dict[int, np.ndarray], slop: int | None) -> list[tuple[int, int, int, str]]:
        """(window, start, end, kind) of all occurrences in a segment, given the positions of its terms."""
        out = []
        none = np.zeros(0, np.int64)
        for i, probes in enumerate(self.probes):
            length, anchors = len(probes), postings.get(probes[0][0], none)
            if not len(anchors):
                continue
            starts = anchors - probes[0][1]
            for term, offset in probes[1:]:
                listed = postings.get(term, none) - offset
                starts = starts[listed[np.minimum(np.searchsorted(listed, starts), len(listed) - 1)] == starts] if len(listed) else none
                if not len(starts):
                    break
            out += [(i, s, s + length, "phrase") for s in starts.tolist()]
            if slop is not None and all(len(postings.get(t, none)) for t, _ in probes):
                near = self._near(anchors, [postings[t] for t in {t for t, _ in probes[1:]} - {probes[0][0]}], length + slop)
                # not those that overlap an exact match
                out += [(i, s, e, "near") for s, e in near if np.searchsorted(starts, s - length, "right") == np.searchsorted(starts, e)]
        return out

    @staticmethod
    def _near(anchors: np.ndarray, lists: list[np.ndarray], span: int) -> list[tuple[int, int]]:
        """For each anchor, the first stretch of at most ``span`` words that holds it and a position of every list; overlapping stretches count once."""
        for x in lists:
            anchors = anchors[np.searchsorted(x, anchors - span + 1) < np.searchsorted(x, anchors + span)]
        out: list[tuple[int, int]] = []
        for p in anchors.tolist():
            close = [x[np.searchsorted(x, p - span + 1) : np.searchsorted(x, p + span)] for x in lists]
            for low in sorted({p, *(v for x in close for v in x.tolist() if v <= p)}):
                last = [x[np.searchsorted(x, low)] if x[-1] >= low else None for x in close]
                if all(v is not None for v in last) and (high := max([p, *last])) < low + span:
                    if not out or low >= out[-1][1]:
                        out.append((int(low), int(high) + 1))
                    break
        return out


class Numbers(dict):
    """Word to the number of the test term that it may be, or -1."""

    def __init__(self, bits: np.ndarray):
        self.bits, self.terms = bits, []

    def __missing__(self, word: bytes) -> int:
        bit = _bit(word)
        n = -1
        if self.bits[bit >> 3] >> (bit & 7) & 1:
            n = len(self.terms)
            self.terms.append(word)
        self[word] = n
        return n

    def forget(self) -> None:
        kept = {w: n for w, n in self.items() if n >= 0}
        self.clear()
        self.update(kept)


INDEX = ["segment", "term", "n", "gaps", "id", "h"]


def _segments(bits: np.ndarray, gap: int, id_type: pa.DataType):
    """Rows (id, h, text) to those of the index: a term's (segment, term, n, gaps), and a document's with its id and hash, the
    number of its words as n and its first position as gaps."""
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), id_type, pa.int64()]

    def written(numbers: Numbers, found: list[np.ndarray], starts: list[int], docs: list[tuple]) -> pa.RecordBatch:
        segment = random.getrandbits(63)
        sizes = np.array([len(x) for x in found], np.int64)
        codes = np.concatenate(found)
        at = np.repeat(np.array(starts, np.int64) - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(codes))
        held = np.flatnonzero(codes >= 0)
        held = held[np.argsort(codes[held], kind="stable")]
        codes, at = codes[held], at[held]
        edges = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else np.zeros(0, np.int64)
        gaps = np.diff(at, prepend=0)
        gaps[edges] = at[edges]
        ends = np.concatenate((edges, [len(codes)]))
        n_terms, n_docs = len(edges), len(docs)
        lists = pa.ListArray.from_arrays(np.concatenate((ends, ends[-1] + 1 + np.arange(n_docs))).astype(np.int32), pa.array(np.concatenate((gaps, starts)).astype(np.int32)))
        terms = pa.array([numbers.terms[c].decode() for c in codes[edges].tolist()] + [None] * n_docs, pa.string())
        columns = [pa.array(np.full(n_terms + n_docs, segment)), terms, pa.array(np.concatenate((np.diff(ends), sizes))), lists]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array([None] * n_terms + [d[k] for d in docs], kinds[4 + k]) for k in (0, 1))], INDEX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = Numbers(bits)
        found: list[np.ndarray] = []
        starts: list[int] = []
        docs: list[tuple] = []
        to = 0
        for batch in batches:
            for doc_id, h, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if to > SEGMENT:
                    yield written(numbers, found, starts, docs)
                    numbers, found, starts, docs, to = Numbers(bits), [], [], [], 0
                elif len(numbers) - len(numbers.terms) > MOST_WORDS:
                    numbers.forget()
                listed = words(text)
                found.append(np.fromiter(map(numbers.__getitem__, listed), np.int32, len(listed)))
                starts.append(to)
                docs.append((doc_id, h))
                to += len(listed) + gap
        if docs:
            yield written(numbers, found, starts, docs)
        del numbers, found
        release()

    return run


def test_bits(items: DataFrame) -> np.ndarray:
    """One bit for the hash of each word of the benchmark: ``TERM_BITS`` bits from each task, united by the driver."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(TERM_BITS, bool)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                bits[[_bit(w) for w in set(words(text))]] = True
        yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits, bitorder="little").tobytes()])], ["bits"])

    parts = items.select("text").coalesce(16).mapInArrow(mark, "bits binary").collect()
    return reduce(np.bitwise_or, [np.frombuffer(r.bits, np.uint8) for r in parts], np.zeros(TERM_BITS // 8, np.uint8))


def _search(tests: TestWindows, slop: int | None, id_type: pa.DataType):
    """The rows of one segment to its documents with matches."""
    schema = pa.schema([("id", id_type), ("h", pa.int64()), ("matches", pa.list_(_MATCH))])
    kinds = np.array(["phrase", "near"])

    def run(rows: pa.Table) -> pa.Table:
        terms = rows["term"].to_pylist()
        gaps = rows["gaps"].combine_chunks()
        edges, flat = gaps.offsets.to_numpy(), gaps.values.to_numpy()
        postings = {tests.vocabulary[t.encode()]: np.cumsum(flat[edges[i] : edges[i + 1]], dtype=np.int64) for i, t in enumerate(terms) if t is not None}
        found = tests.matches(postings, slop)
        if not found:
            return schema.empty_table()
        docs = np.array([i for i, t in enumerate(terms) if t is None], np.int64)
        starts = flat[edges[docs]].astype(np.int64)
        docs = docs[np.argsort(starts)]
        starts = np.sort(starts)
        window, low, high = (np.array([m[k] for m in found], np.int64) for k in range(3))
        kind = np.array([m[3] == "near" for m in found], np.int64)
        # a row for each match and item of its window
        items = [tests.windows[w][1] for w in window.tolist()]
        times = np.array(list(map(len, items)))
        low, high, kind = (np.repeat(x, times) for x in (low, high, kind))
        names = pa.array([i for listed in items for i in listed], pa.string())
        own = np.searchsorted(starts, low, "right") - 1
        order = np.argsort(own, kind="stable")
        own, low, high, kind = own[order], low[order], high[order], kind[order]
        firsts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        spans = pa.StructArray.from_arrays([names.take(pa.array(order)), pa.array((low - starts[own]).astype(np.int32)), pa.array((high - starts[own]).astype(np.int32)), pa.array(kinds[kind], pa.string())], fields=list(_MATCH))
        whose = pa.array(docs[own[firsts]])
        lists = pa.ListArray.from_arrays(np.concatenate((firsts, [len(own)])).astype(np.int32), spans)
        return pa.table([rows["id"].combine_chunks().take(whose), rows["h"].combine_chunks().take(whose), lists], schema)

    return run


class Index:
    """The stored index of a table of documents for the terms of a benchmark, and searches in it."""

    def __init__(self, docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most_slop: int = SLOP):
        from pyspark.sql.pandas.types import to_arrow_type

        modest_batches(docs.sparkSession)
        self.scratch, self.window, self.most_slop = Scratch(docs.sparkSession, "decontamination"), window, most_slop
        self.items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.encode(item_text_col, "UTF-8").alias("text")).dropna()
        kind = docs.schema[id_col].dataType
        self.id_type = to_arrow_type(kind)
        rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("h"), F.encode(text_col, "UTF-8").alias("text"))
        self.row = f"id {kind.simpleString()}, h long"
        made = rows.mapInArrow(_segments(test_bits(self.items), window + most_slop, self.id_type), f"segment long, term string, n long, gaps array<int>, {self.row}")
        self.index = self.scratch.keep(made, "index")
        self.postings, self.docs = self.index.where("term is not null"), self.index.where("term is null")

    def slices(self, slice_bytes: int) -> Iterator[TestWindows]:
        total = self.items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        n = max(1, math.ceil(total / slice_bytes))
        for i in range(n):
            part = self.items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == i)
            yield TestWindows([(r.item, bytes(r.text)) for r in part.collect()], self.window)

    def search(self, slop: int | None = None, slice_bytes: int = SLICE_BYTES) -> DataFrame:
        """(id, h, n_words, matches): one row for each document row; h is the hash of its text."""
        if slop is not None and slop > self.most_slop:
            raise ValueError("the index leaves no gaps between documents for such a slop")
        spark, found = self.index.sparkSession, []
        # the words of one slice
        terms = lambda listed: F.broadcast(spark.createDataFrame([(w.decode(),) for w in listed], "term string"))
        for i, tests in enumerate(self.slices(slice_bytes)):
            counts = self.postings.join(terms(tests.vocabulary), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n"))
            needed = tests.order({r.term.encode(): r.n for r in counts.collect()})
            if needed:
                met = self.postings.join(terms(needed), "term", "left_semi").select(*INDEX).unionByName(self.docs.select(*INDEX))
                met = met.groupBy("segment").applyInArrow(_search(tests, slop, self.id_type), f"{self.row}, matches {MATCHES}")
                found.append(self.scratch.keep(met, f"found{i}"))
        out = self.docs.select("id", "h", F.col("n").alias("n_words"))
        none = F.array().cast(MATCHES)
        if found:
            merged = reduce(DataFrame.unionByName, (x.dropDuplicates(["id", "h"]) for x in found)).groupBy("id", "h").agg(F.flatten(F.collect_list("matches")).alias("matches"))
            out = _joined(out, merged).withColumn("matches", F.coalesce("matches", none))
        else:
            out = out.withColumn("matches", none)
        out = self.scratch.keep(out, "result")
        self.scratch.drop(*[f"found{i}" for i in range(len(found))])
        return out

    def drop(self) -> None:
        """Deletes the index; results stay."""
        self.scratch.drop("index")


def _joined(rows: DataFrame, found: DataFrame, how: str = "left", id_col: str = "id", h_col: str = "h") -> DataFrame:
    """``rows`` with the columns of ``found`` for their id, null or not, and hash."""
    f = found.select(F.col("id").alias("__fid"), F.col("h").alias("__fh"), *[c for c in found.columns if c not in ("id", "h")])
    return rows.join(f, rows[id_col].eqNullSafe(f["__fid"]) & (rows[h_col] == f["__fh"]), how).drop("__fid", "__fh")


def search(docs: DataFrame, benchmark: DataFrame, slop: int | None = None, slice_bytes: int = SLICE_BYTES, **options) -> DataFrame:
    """(id, h, n_words, matches) of all rows, from an index that is made and deleted here."""
    index = Index(docs, benchmark, most_slop=max(SLOP, slop or 0), **options)
    out = index.search(slop, slice_bytes)
    index.drop()
    return out


def find_benchmark(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``n_words`` and ``matches``: the spans of words, by kind ``phrase`` or (with ``slop``) ``near``, and their items."""
    found = search(docs, benchmark, id_col=id_col, text_col=text_col, **options).dropDuplicates(["id", "h"])
    rows = docs.drop("n_words", "matches").withColumn("__h", F.xxhash64(F.col(text_col)))
    return _joined(rows, found, "left", id_col, "__h").drop("__h")


def _covered(spans: Column) -> Column:
    """Number of words inside any of the spans, given as structs with start and end."""
    step = lambda acc, s: F.struct((acc["n"] + F.greatest(s["end"] - F.greatest(s["start"], acc["to"]), F.lit(0))).alias("n"), F.greatest(acc["to"], s["end"]).alias("to"))
    ordered = F.array_sort(F.array_distinct(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))))
    return F.aggregate(ordered, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), step, lambda acc: acc["n"].cast("long"))


def _with_contamination(found: DataFrame) -> DataFrame:
    phrases = F.filter("matches", lambda m: m["kind"] == "phrase")
    found = found.withColumn("n_hit", _covered(phrases)).withColumn("items", F.array_sort(F.array_distinct(F.transform(phrases, lambda m: m["item_id"]))))
    return found.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def _with_near(found: DataFrame) -> DataFrame:
    near = F.filter("matches", lambda m: m["kind"] == "near")
    return found.withColumn("n_near", _covered(near)).withColumn("near_items", F.array_sort(F.array_distinct(F.transform(near, lambda m: m["item_id"]))))


def contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``docs`` with ``n_words``, ``n_hit`` (words inside exact matches), ``items`` (their items), ``contaminated`` and ``matches``."""
    return _with_contamination(find_benchmark(docs, benchmark, **options))


def proximity(docs: DataFrame, benchmark: DataFrame, slop: int = SLOP, **options) -> DataFrame:
    """``docs`` with ``contamination``'s columns, ``n_near`` (words inside near matches) and ``near_items`` (their items).

    A near match is a stretch of at most ``slop`` words more than a window that holds all of its words in any order and
    overlaps no exact match of that window. The exact columns do not depend on it.
    """
    return _with_near(contamination(docs, benchmark, slop=slop, **options))


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", slop: int | None = None, **options) -> DataFrame:
    """One row for each row of ``docs``: its id and the columns of :func:`contamination`, or with ``slop`` of :func:`proximity`. The
    index has the ids, so the documents are read once."""
    found = _with_contamination(search(docs, benchmark, slop, id_col=id_col, **options))
    return (found if slop is None else _with_near(found)).withColumnRenamed("id", id_col).drop("h")


def without_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated. Only the keys of the others meet them; they are written, so that Spark knows how few
    they are before it moves a text."""
    found = _with_contamination(search(docs, benchmark, id_col=id_col, text_col=text_col, **options)).where("contaminated").select("id", "h")
    found = Scratch(docs.sparkSession, "contaminated").keep(found, "keys")
    return _joined(docs.withColumn("__h", F.xxhash64(F.col(text_col))), found, "left_anti", id_col, "__h").select(*docs.columns)
