import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import bpe
from inkstone.llm.queries import tokenizer
from tests.llm.common import awkward, documents, empty, run

PATH = tokenizer("byte_bpe_50k.json")
TEXTS = [None, "", " ", "Hello world", "it's  two   spaces \n\n and\tlines\n", "<|endoftext|>", "a<|endoftext|> b", "日本語 🙂🙂 é é", "a" * 5000, "word " * 20_000, "x\u0000y  z w", "١٢٣ ⅷ ²", " lead", "trail ", "don't DON'T we'll", "a \nb \n c\n d", "ﬁ ẞ́ \U0001e030 \U00031350"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()

    def both(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return ids, t.decode(ids, skip_special_tokens=False)

    return both


def test_query_against_the_library(spark, sf_dir, library):
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = {i: (len(ids), sha(",".join(map(str, ids))), sha(text)) for i, (ids, text) in ((i, library(t)) for i, t in documents(spark, sf_dir))}
    got = run(spark, "op9_bpe", sf_dir)
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got.itertuples()} == want


@pytest.mark.parametrize("page", [10, bpe.PAGE])
def test_awkward_texts_and_pages(spark, library, monkeypatch, page):
    monkeypatch.setattr(bpe, "PAGE", page)
    docs = awkward(spark, TEXTS)
    rows = bpe.encode_decode(docs, PATH).collect()
    assert {r.doc_id: (r.ids, r.decoded) for r in rows} == {i: library(t) for i, t in enumerate(TEXTS)}
    assert len(bpe.encode_decode(docs.union(docs), PATH).collect()) == 2 * len(TEXTS)
    assert bpe.encode_decode(empty(spark), PATH).count() == 0


def test_decode_by_join(spark, library):
    coded = bpe.encode_decode(awkward(spark, TEXTS[:8]), PATH)
    rows = bpe.decode(coded, bpe.pieces(spark, PATH)).collect()
    assert {r.doc_id: r.text for r in rows} == {i: library(t)[1] for i, t in enumerate(TEXTS[:8])}


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_split_words_encode_as_the_text(library, text):
    split = bpe.splitter(PATH)
    assert [i for ids in split.encode(split.words(text)) for i in ids] == library(text)[0]


def test_each_distinct_word_is_encoded_once(spark, library, monkeypatch):
    """Many pages that share words: the word table has a row a word, and equal words get equal ids in all pages."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(bpe, "PAGE", 60)
    docs = spark.createDataFrame([(i, "the shared words and one of its own " + "abcdefgh"[i % 8] * (i + 1)) for i in range(40)], "doc_id long, text string")
    pages = bpe.pages_of(docs.select(F.col("doc_id").alias("id"), "text"), PATH)
    words = bpe.words_of(pages)
    assert pages.count() > 10 and words.select("word").distinct().count() == 8 + 40
    coded = []  # the words that the library is given
    encode = bpe.Splitter.encode
    monkeypatch.setattr(bpe.Splitter, "encode", lambda self, w: coded.extend(w) or encode(self, w))
    rows = sorted((r.word, r.page, r.place) for r in words.collect())
    batches = [pa.RecordBatch.from_pylist([dict(zip(("word", "page", "place"), r, strict=True)) for r in rows[i : i + 7]]) for i in range(0, len(rows), 7)]
    monkeypatch.setattr(bpe, "BLOCK_ROWS", 20)
    found = [r for b in bpe._encoded(PATH)(iter(batches)) for r in b.to_pylist()]
    assert len(coded) == len(set(coded)) == 48
    got = []
    for r in found:
        place, lengths, ids = bpe.unblocked(r["packed"], r["rows"], r["tokens"])
        got += [(r["page"], p, i.tolist()) for p, i in zip(place.tolist(), np.split(ids, np.cumsum(lengths)[:-1]), strict=True)]
    assert sorted(got) == sorted((p, n, library(w)[0]) for w, p, n in rows)
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(docs, PATH).collect()} == {r.doc_id: library(r.text) for r in docs.collect()}


def test_words_are_deleted_and_results_come_in_batches(spark, library, monkeypatch):
    """When the result is read, the blocks of words are gone, and a page's documents come back in several batches."""
    import glob

    monkeypatch.setattr(bpe, "RESULT", 50)
    docs = spark.createDataFrame([(i, f"the words of document {i} " * (i % 5)) for i in range(60)], "doc_id long, text string")
    before = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/bpe-*"))
    got = bpe.encode_decode(docs, PATH)
    (made,) = set(glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/bpe-*")) - before
    assert [p.rsplit("/", 1)[1] for p in glob.glob(f"{made}/pages/of=*")] == ["of=documents"]
    assert {r.doc_id: (r.ids, r.decoded) for r in got.collect()} == {r.doc_id: library(r.text) for r in docs.collect()}
    page = bpe.Page(bpe.splitter(PATH))
    for i in range(60):
        page.add(i, "one two three")
    _, packed = page.packed(pa.int64(), 1)
    ids = [library(w)[0] for w in ("one", " two", " three")]
    order = sorted(range(3), key=["one", " two", " three"].__getitem__)
    flat = [i for k in order for i in ids[k]]
    coded = {"rows": [3], "tokens": [len(flat)], "packed": [bpe.block(np.arange(3), np.array([len(ids[k]) for k in order]), np.array(flat))], "id": [None], "piece": [None]}
    named = {"rows": [None] * len(flat), "tokens": [None] * len(flat), "packed": [None] * len(flat), "id": flat, "piece": [bpe.piece_bytes(PATH)[i] for i in flat]}
    kinds = pa.schema([("rows", pa.int32()), ("tokens", pa.int32()), ("packed", pa.binary()), ("id", pa.int32()), ("piece", pa.binary())])
    found = pa.table({k: coded[k] + named[k] for k in coded}, kinds)
    out = bpe._assemble(pa.int64())(pa.table({"packed": pa.array([packed], pa.binary())}), found)
    assert out["decoded"].to_pylist() == ["one two three"] * 60 and 3 <= out["decoded"].num_chunks <= 5


def test_no_stage_has_two_python_steps(spark, library):
    """Words are taken out of their blocks by Spark, also those with line ends and signs of the blocks' own, and dealt into as many tasks
    as the session says, so that no running task has two workers and none gets many small-looking blocks."""
    from pyspark.sql import functions as F

    texts = ["100% %25 %0A\n\n%0A \n x%\ty", "%", "\n", " % \n\n\n%%", "plain words", None]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    pages = bpe.pages_of(docs.select(F.col("doc_id").alias("id"), "text").coalesce(1), PATH).localCheckpoint()
    words = bpe.words_of(pages)
    plan = words._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "REPARTITION_BY_NUM" in plan
    split = bpe.splitter(PATH).words
    assert sorted(r.word for r in words.collect()) == sorted({w for t in texts if t for w in split(t)})
    assert words.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert {r.doc_id: (r.ids, r.decoded) for r in bpe.encode_decode(docs, PATH).collect()} == {i: library(t) for i, t in enumerate(texts)}


def test_stretches_are_forgotten(library, monkeypatch):
    """A page remembers a bounded number of stretches, and its words are the same."""
    monkeypatch.setattr(bpe, "STRETCHES", 3)
    page = bpe.Page(bpe.splitter(PATH))
    texts = [" ".join(f"w{j % 7} don't, {j % 5}" for j in range(i)) for i in range(1, 20)]
    for i, t in enumerate(texts):
        page.add(i, t)
        assert len(page.stretches) <= 3
    words = list(page.numbers)
    assert [[words[n] for n in r] for r in page.rows] == [bpe.splitter(PATH).words(t) for t in texts]
    page.packed(pa.int64(), 4)
    assert not page.numbers and not page.rows
