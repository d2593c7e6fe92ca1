"""Byte-level BPE encoding and decoding by a distinct-word table.

Texts are split into words by the tokenizer's own rule; a merge never crosses words, so each distinct word of the whole table of
documents is encoded once and its ids are joined back to all its places. Tokens are decoded by a join of ids and pieces.

    documents -> (page, words)            written once: blocks of the page's distinct words by bucket; deleted when they are encoded
              -> (page, packed)           written with them: the page's documents as word numbers
    words     -> (bucket, block)          shuffled, taken apart by Spark into (word, page, place) and sorted: each distinct word is one
                                          run, encoded once
              -> (page, block of ids)     places in the page with their ids; shuffled, one row a page; written
              -> (page, id)               the page's distinct ids, joined with the table of pieces by id: (page, id, piece)
    pages     -> documents                cogrouped by page: ids by position, pieces by id

Places are kept small: the documents of a task are gathered in *pages* of about ``PAGE`` characters, and words go to their buckets and ids come
back in packed blocks, not in a row for each token. A word has at most one row a page, however common it
is, and the rows of equal words are read as a stream, so a task holds one batch of them. Documents are read and split once: pages are
written, and all later steps read them. No stage has two Python steps one behind the other, since each would be a worker of its own in
every running task.

Defined cases: null and empty texts have no ids and decode to the empty text; the strings of special tokens are those tokens,
as the library has it; repeated rows each get their own result; an empty table gives an empty result; only the id and text
columns are read, and other columns are left out of the result.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm.memory import modest_batches, release
from inkstone.llm.scratch import Scratch

PAGE = 16_000_000
#: Rows of words with ids that a task gathers before it gives them out as one block for each page.
BLOCK_ROWS = 1 << 18
#: Stretches whose words a page remembers at a time.
STRETCHES = 1 << 16
_BLOCKS = ["page", "rows", "tokens", "packed"]
#: Words of documents whose ids and texts are one batch of the result.
RESULT = 1 << 18
#: Bytes of a row group of the written pages: what Spark's reader holds of them at a time.
ROW_GROUP = 16 << 20
#: The split rule of byte-level BPE.
RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Uneven(Exception):
    """A stretch between spaces that cannot be split on its own."""


class Splitter:
    """Splits texts as the tokenizer does."""

    def __init__(self, path: str):
        import unicodedata

        import regex
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.findall = regex.compile(RULE).findall
        added = self.tokenizer.get_added_tokens_decoder().values()
        if any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added):
            raise ValueError("added tokens with options are not supported")
        self.special = [t.content for t in added]
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # characters on whose class two versions of Unicode may differ: those texts are split by the library
        kinds = regex.compile(r"[\p{L}\p{N}]")
        odd = [c for c in map(chr, range(0x378, 0x32400)) if unicodedata.category(c) == "Cn" and kinds.match(c)]
        self.odd = regex.compile("[" + "".join(odd) + "]").search if odd else lambda _: None

    def words(self, text: str) -> list[str]:
        """The words of any text; a special token is a word of its own."""
        if self.at_special and any(s in text for s in self.special):
            parts = self.at_special.split(text)
            return [w for i, p in enumerate(parts) for w in ([p] if i % 2 else self._plain(p))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        if not text.isascii() and self.odd(text):
            return [text[a:b] for _, (a, b) in self._offsets(text)]
        return self.findall(text)

    def _offsets(self, text: str) -> list:
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def encode(self, words: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(words, add_special_tokens=False)]


@lru_cache(maxsize=2)
def splitter(path: str) -> Splitter:
    return Splitter(path)


class Numbers(dict):
    """Word to its number in the page."""

    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


class Stretches(dict):
    """What stands between two spaces or line ends, with the one before it, to the numbers of its words. ``STRETCHES`` of them are
    remembered; then it begins anew."""

    def __init__(self, split: Splitter, numbers: Numbers):
        self.split, self.numbers = split, numbers

    def __missing__(self, stretch: str) -> tuple[int, ...]:
        number = self.numbers.__getitem__
        if stretch.isalpha():  # letters in Python's Unicode are letters in later ones
            found = (number(" " + stretch),)
        elif stretch[-1:] in ".,;:" and stretch[:-1].isalpha():
            found = (number(" " + stretch[:-1]), number(stretch[-1]))
        else:
            body = stretch[1:] if stretch[:1] == "\n" else stretch
            if not body or body[0].isspace() or body[-1].isspace() or not (body.isascii() or not self.split.odd(body)):
                raise Uneven
            found = tuple(map(number, self.split.findall(stretch if stretch[0] == "\n" else " " + stretch)))
        if len(self) >= STRETCHES:
            self.clear()
        self[stretch] = found
        return found


class Page:
    """Documents as rows of word numbers. Splitting is per distinct stretch between single spaces; a text with other white
    space next to a space or line end, or with special tokens, is split as a whole."""

    def __init__(self, split: Splitter):
        self.split, self.numbers = split, Numbers()
        self.stretches = Stretches(split, self.numbers)
        self.rows: list[np.ndarray] = []
        self.ids: list = []
        self.size = 0

    def add(self, doc_id, text: str | None) -> None:
        text = text or ""
        self.ids.append(doc_id)
        self.size += len(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            if any(s in text for s in self.split.special) or first[-1:].isspace():
                raise Uneven
            rest = list(chain.from_iterable(map(self.stretches.__getitem__, rest)))
            words = self.split._plain(first)
        except Uneven:
            words, rest = self.split.words(text), []
        self.rows.append(np.array([self.numbers[w] for w in words] + rest, np.int32))

    def packed(self, id_type: pa.DataType, buckets: int) -> tuple[pa.Array, bytes]:
        """Blocks of the distinct words, ordered by bucket and then by themselves, and ids of documents and rows, compressed. In the
        rows a word's number is its rank by frequency, which packs best; the numbers' halves, and of ranks in order all bytes, are laid out by
        significance. The page is empty afterwards."""
        self.stretches.clear()
        words = pa.array(list(self.numbers), pa.string())
        bucket = np.fromiter((crc32(w.encode()) % buckets for w in self.numbers), np.int64, len(words))
        self.numbers.clear()
        order = pc.sort_indices(words).to_numpy()
        order = order[np.argsort(bucket[order], kind="stable")]
        place = np.empty(len(words), np.int32)
        place[order] = np.arange(len(words), dtype=np.int32)
        docs = pa.record_batch([pa.array(self.ids, id_type), pa.array([len(r) for r in self.rows], pa.int64())], ["id", "n"])
        numbers = np.concatenate([np.zeros(0, np.int32), *self.rows])
        self.rows, self.ids = [], []
        numbers = place[numbers]
        by_rank = np.argsort(-np.bincount(numbers, minlength=len(words)), kind="stable").astype(np.int32)
        rank = np.empty_like(by_rank)
        rank[by_rank] = np.arange(len(words), dtype=np.int32)
        numbers = rank[numbers]
        sink = pa.BufferOutputStream()
        for batch in (docs, planes(numbers, 2), planes(by_rank, 1)):
            with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 9))) as writer:
                writer.write_batch(batch)
        sizes = np.bincount(bucket, minlength=buckets)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        lines = pc.binary_join(pa.ListArray.from_arrays(ends.astype(np.int32), as_lines(words.take(order))), "\n")
        used = np.flatnonzero(sizes)
        blocks = pa.StructArray.from_arrays([pa.array(used.astype(np.int32)), pa.array(ends[used].astype(np.int32)), lines.take(used)], ["bucket", "first", "words"])
        return blocks, sink.getvalue().to_pybytes()


def as_lines(words: pa.Array) -> pa.Array:
    """Words without line ends, one to one; :func:`of_line` has them back."""
    return pc.replace_substring(pc.replace_substring(words, "%", "%25"), "\n", "%0A")


def of_line(line: Column) -> Column:
    return F.when(line.contains("%"), F.replace(F.replace(line, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))).otherwise(line)


def planes(numbers: np.ndarray, width: int) -> pa.RecordBatch:
    """Numbers laid out by the significance of their parts of ``width`` bytes."""
    return pa.record_batch([pa.array(np.ascontiguousarray(numbers.astype("<u4").view(f"<u{width}").reshape(-1, 4 // width).T).ravel())], ["plane"])


def unpacked(payload: bytes) -> tuple[pa.Table, np.ndarray]:
    """Ids of documents with the lengths of their rows, and the rows one after another."""
    source = pa.BufferReader(payload)
    docs, ranks, by_rank = (pa.ipc.open_stream(source).read_all().combine_chunks() for _ in range(3))
    whole = lambda t, width: np.ascontiguousarray(t["plane"].to_numpy().reshape(4 // width, -1).T).view("<u4").ravel()
    return docs, whole(by_rank, 1)[whole(ranks, 2)]


def _paged(path: str, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()  # what tasks of other kinds left in this worker
        number, kind, page = TaskContext.get().partitionId() << 32, None, Page(splitter(path))

        def closed() -> pa.RecordBatch:
            blocks, packed = page.packed(kind, buckets)
            words = pa.ListArray.from_arrays(pa.array([0, len(blocks), len(blocks)], pa.int32()), blocks, mask=pa.array([False, True]))
            columns = [pa.array(["words", "documents"]), pa.array([number] * 2), words, pa.array([None, packed], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["of", "page", "words", "packed"])

        for batch in batches:
            kind = batch.column(0).type
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                page.add(doc_id, text)
                if page.size >= PAGE:
                    yield closed()
                    release()
                    number, page = number + 1, Page(splitter(path))
        if page.ids:
            yield closed()
        del page
        release()

    return run


def by_significance(*columns: np.ndarray) -> bytes:
    """Numbers laid out by the significance of their bytes."""
    return b"".join(c.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes() for c in columns)


def from_significance(raw: bytes, counts: list[int]) -> list[np.ndarray]:
    at = np.frombuffer(raw, np.uint8)
    ends = np.cumsum(counts).tolist()
    return [np.ascontiguousarray(at[4 * (end - n) : 4 * end].reshape(4, -1).T).view("<u4").ravel() for n, end in zip(counts, ends, strict=True)]


def block(place: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """Rising places in a page, and the ids of the words there, one after another."""
    return pa.Codec("zstd", 5).compress(by_significance(np.diff(place, prepend=0), lengths, ids), asbytes=True)


def unblocked(packed: bytes, rows: int, tokens: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    steps, lengths, ids = from_significance(pa.Codec("zstd").decompress(packed, 4 * (2 * rows + tokens), asbytes=True), [rows, rows, tokens])
    return np.cumsum(steps.astype(np.int64)), lengths.astype(np.int64), ids.astype(np.int32)


def joined(blocks: pa.Table) -> tuple[np.ndarray, Gather]:
    """The row of each place of a page, and the rows' ids."""
    parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)), *(unblocked(**r) for r in blocks.select(["packed", "rows", "tokens"]).to_pylist())]
    place, lengths, flat = map(np.concatenate, zip(*parts, strict=True))
    return row_of(place), Gather(flat, lengths)


def _merged(blocks: pa.Table) -> pa.Table:
    """The blocks of one page as one, with the distinct ids. Every place of the page is in one of them."""
    row, lists = joined(blocks)
    ids, lengths = lists.of(row), lists.lengths[row]
    found = [blocks["page"][:1].combine_chunks(), pa.array([len(row)], pa.int32()), pa.array([len(ids)], pa.int32()), pa.array([block(np.arange(len(row)), lengths, ids)], pa.binary())]
    return pa.table([*found, pa.array([np.unique(ids)], pa.list_(pa.int32()))], ["page", "rows", "tokens", "packed", "ids"])


def _blocks(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    """Rows (page, place, ids) as one row (page, rows, tokens, packed) for each page."""
    rows = pa.Table.from_batches(held).combine_chunks()
    page, place, lists = rows["page"].to_numpy(), rows["place"].to_numpy(), rows["ids"].combine_chunks()
    order = np.lexsort((place, page))
    page, place = page[order], place[order]
    lengths = pc.list_value_length(lists).to_numpy().astype(np.int64)
    flat = Gather(pc.list_flatten(lists).to_numpy(), lengths).of(order)
    lengths = lengths[order]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    names, low = np.unique(page, return_index=True)
    high = np.append(low[1:], len(page))
    packed = [block(place[a:b], lengths[a:b], flat[ends[a] : ends[b]]) for a, b in zip(low, high, strict=True)]
    counts = [pa.array(n.astype(np.int32)) for n in (high - low, ends[high] - ends[low])]
    return pa.RecordBatch.from_arrays([pa.array(names), *counts, pa.array(packed, pa.binary())], _BLOCKS)


def _encoded(path: str):
    """Rows sorted by word to blocks of ids: each run of equal words is encoded once, also where it goes on in the next batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, last, known, held, n = splitter(path).encode, None, [], [], 0
        for batch in batches:
            runs = batch.column("word").dictionary_encode()
            words = runs.dictionary.to_pylist()
            if words:
                again = [known] if words[0] == last else []
                ids = again + encode(words[len(again) :])
                last, known = words[-1], ids[-1]
                held.append(pa.RecordBatch.from_arrays([batch.column("page"), batch.column("place"), pa.array(ids, pa.list_(pa.int32())).take(runs.indices)], ["page", "place", "ids"]))
                n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield _blocks(held)
                held, n = [], 0
        if held:
            yield _blocks(held)
        del held
        release()

    return run


def pages_of(docs: DataFrame, path: str) -> DataFrame:
    """Rows (of, page, words, packed) of a table of ids and texts: for each page one of its ``words`` and one of its ``documents``. A page's
    number is that of its task and its place there: it holds for one reading of the table, so pages must be written before they are used twice."""
    # as many buckets as tasks could share, twice over
    buckets = max(256, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return docs.mapInArrow(_paged(path, buckets), "of string, page long, words array<struct<bucket:int,first:int,words:string>>, packed binary")


def words_of(pages: DataFrame) -> DataFrame:
    """Rows (word, page, place), a bucket's in one task. The number of tasks is fixed: by the size of blocks, of which one becomes many
    times as many bytes of rows, Spark would put too many into one. (The outer generator keeps Spark from splitting twice, for a filter.)"""
    blocks = pages.where("words IS NOT NULL").select("page", F.inline("words"))
    blocks = blocks.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "bucket")
    lines = blocks.select("page", "first", F.posexplode_outer(F.split("words", "\n")).alias("at", "line"))
    return lines.select(of_line(F.col("line")).alias("word"), "page", (F.col("first") + F.col("at")).alias("place"))


def encode_words(words: DataFrame, path: str) -> DataFrame:
    """A row (page, rows, tokens, packed, ids) for each page of rows (word, page, place), of which equal words are in one task: they are
    sorted, and each distinct one is encoded once for all its pages. ``ids`` are the page's distinct ones."""
    kinds = "page long, rows int, tokens int, packed binary"
    blocks = words.sortWithinPartitions("word").mapInArrow(_encoded(path), kinds)
    return blocks.groupBy("page").applyInArrow(_merged, f"{kinds}, ids array<int>")


def with_pieces(coded: DataFrame, path: str) -> DataFrame:
    """Rows (page, id, piece): the distinct ids of each page, joined with the table of pieces, which the vocabulary bounds."""
    held = coded.select("page", F.explode("ids").alias("id"))
    return held.join(F.broadcast(pieces(coded.sparkSession, path)), "id").select("page", "id", F.unhex("piece").alias("piece"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table: bytes of each token, in hexadecimal."""
    return spark.createDataFrame([(i, b.hex()) for i, b in enumerate(piece_bytes(path))], "id int, piece string")


def piece_bytes(path: str) -> list[bytes]:
    """Bytes of each token by id. In the vocabulary a byte is written as the printable Latin-1 character of that number, and
    the others, in order, as the characters from 256."""
    split = splitter(path)
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    as_char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    out = []
    for i in range(split.tokenizer.get_vocab_size()):
        token = split.tokenizer.id_to_token(i)
        out.append(token.encode() if token in split.special else bytes(as_char[c] for c in token))
    return out


def decode(tokens: DataFrame, spark_pieces: DataFrame, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Texts from rows of an id and an array of token ids, by a join of ids and pieces; ids of rows must be distinct."""
    rows = tokens.select(F.col(id_col).alias("__key"), F.posexplode_outer(ids_col).alias("pos", "id"))
    joined = rows.join(F.broadcast(spark_pieces), "id", "left")
    parts = joined.groupBy("__key").agg(F.array_sort(F.collect_list(F.when(F.col("id").isNotNull(), F.struct("pos", "piece")))).alias("p"))
    return parts.select(F.col("__key").alias(id_col), F.decode(F.unhex(F.array_join(F.transform("p", lambda x: x["piece"]), "")), "UTF-8").alias("text"))


class Gather:
    """Runs of a flat array, picked by number."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        self.flat, self.lengths = flat, lengths
        self.starts = np.cumsum(lengths) - lengths

    def of(self, rows: np.ndarray) -> np.ndarray:
        n = self.lengths[rows]
        ends = np.cumsum(n)
        if not len(n) or not ends[-1]:
            return self.flat[:0]
        return self.flat[np.repeat(self.starts[rows] - (ends - n), n) + np.arange(ends[-1])]


def row_of(numbers: np.ndarray) -> np.ndarray:
    """The row that holds each number."""
    at = np.zeros(numbers.max(initial=-1) + 1, np.int64)
    at[numbers] = np.arange(len(numbers))
    return at


def _assemble(id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def run(pages: pa.Table, found: pa.Table) -> pa.Table:
        word_row, of_word = joined(found.filter(pc.is_valid(found["rows"])))
        pieces = found.filter(pc.is_valid(found["id"])).combine_chunks()
        listed = pieces["piece"].combine_chunks()
        piece_row, of_id = row_of(pieces["id"].to_numpy()), Gather(np.frombuffer(b"".join(listed.to_pylist()), np.uint8), pc.binary_length(listed).to_numpy().astype(np.int64))
        out = []
        for packed in pages["packed"]:
            docs, numbers = unpacked(packed.as_py())
            named, sizes = docs["id"].combine_chunks(), docs["n"].to_numpy()
            ends = np.cumsum(sizes)
            # batches of about ``RESULT`` words: what Spark takes back at a time
            cuts = np.append(np.unique(ends // RESULT, return_index=True)[1], len(sizes))
            for low, high in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                ids = [of_word.of(word_row[numbers[end - n : end]]) for n, end in zip(sizes[low:high].tolist(), ends[low:high].tolist(), strict=True)]
                texts = pa.array([of_id.of(piece_row[i]).tobytes().decode("utf-8", "replace") for i in ids], pa.string())
                offsets = np.cumsum([0, *map(len, ids)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                out.append(pa.table([named[low:high], lists, texts], schema))
            del docs, numbers
        release()
        return pa.concat_tables(out) if out else schema.empty_table()

    return run


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, its token ids and the text that they decode to."""
    from pyspark.sql.pandas.types import to_arrow_type

    modest_batches(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "bpe")
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    id_type = rows.schema["id"].dataType
    made = pages_of(rows, path)
    scratch.keep_parts(made, "pages", "of", {"parquet.block.size": ROW_GROUP, "parquet.block.size.row.check.min": 1, "compression": "zstd"})
    coded = scratch.keep(encode_words(words_of(scratch.part(made, "pages", "of", "words")), path), "coded")
    scratch.drop("pages/of=words")
    pages = scratch.part(made, "pages", "of", "documents")
    found = coded.drop("ids").unionByName(with_pieces(coded, path), allowMissingColumns=True)
    out = pages.select("page", "packed").groupBy("page").cogroup(found.groupBy("page")).applyInArrow(_assemble(to_arrow_type(id_type)), f"id {id_type.simpleString()}, ids array<int>, decoded string")
    return out.withColumnRenamed("id", id_col)
