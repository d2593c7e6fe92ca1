import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkstone.llm import tokencount
from inkstone.llm.queries import tokenizer
from tests.llm.common import awkward, documents, empty, run

PATH = tokenizer("piece_bpe_32k.model")
TEXTS = [None, "", " ", "   a  b ", "Hello world, the quick brown fox", "<s></s><unk> <0x0A>", "\n\n\t", "日本語のテキスト 漢字", "🙂🙂 emoji", "▁▁x ▁y", "a" * 3000, " x y\u0000z", "word " * 20_000, "é é ﬁ", "aaaa bbbb" * 500]


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PATH)
    return lambda t: len(sp.encode(t or ""))


def test_query_against_the_library(spark, sf_dir, library):
    got = run(spark, "op3_token_counts", sf_dir)
    want = {i: (len((t or "").encode()), library(t), library(t) > 4096) for i, t in documents(spark, sf_dir)}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in got.itertuples()} == want


@pytest.mark.parametrize("chunk", [7, 64, 1 << 16])
def test_awkward_texts_and_cuts(spark, library, chunk):
    rows = tokencount.token_counts(awkward(spark, [*TEXTS, TEXTS[3], TEXTS[12]]), PATH, chunk=chunk).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: library(t) for i, t in enumerate([*TEXTS, TEXTS[3], TEXTS[12]])}


def test_repeated_rows_and_empty_table(spark, library):
    docs = awkward(spark, ["a b c " * 50])
    assert [r.n_tokens for r in tokencount.token_counts(docs.union(docs), PATH, chunk=20).collect()] == [library("a b c " * 50)] * 2
    assert tokencount.token_counts(empty(spark), PATH).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("  abcdehilnorst.,'-▁éß漢字\n0123456789<>/s🙂")), max_size=60))
def test_any_text(library, text):
    machine = tokencount.transducer(PATH)
    assert (machine.count(tokencount.SPACE + tokencount.escape(text)) if text else 0) == library(text)


@pytest.mark.parametrize("text", ["aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "internationalisation", "日本語のテキスト漢字", "a  b\n\nc"])
def test_wrong_entry_states_are_mended(spark, library, text):
    """Without characters to go over first, chunks begin in states that aren't theirs; rounds add the right ones."""
    rows = tokencount.token_counts(awkward(spark, [text, None, text]), PATH, chunk=7, warm=0).collect()
    assert sorted((r.doc_id, r.n_tokens) for r in rows) == [(0, library(text)), (1, 0), (2, library(text))]


def test_maps_compose(library):
    machine = tokencount.transducer(PATH)
    text = tokencount.SPACE + tokencount.escape("the state after one part is where the next one begins 漢字漢字 " * 9)
    state, total = tokencount.START, 0
    for k in range(0, len(text), 11):
        n, state = machine.map(text[k : k + 11], state)
        total += n
    assert total == machine.count(text) == library(text[1:].replace(tokencount.SPACE, " "))


@pytest.mark.parametrize("text, most", [("a" * (20 << 16), 9), ("word " * (3 << 16), 1), (("ab" * 40_000 + " ") * 9, 9)])
def test_rounds_do_not_grow_with_chunks(spark, library, monkeypatch, text, most):
    """At the production size of chunks: the rounds are those that looked up a state, and one that found none lacking."""
    kept, keep = [], tokencount.Scratch.keep
    monkeypatch.setattr(tokencount.Scratch, "keep", lambda self, df, name: kept.append(name) or keep(self, df, name))
    rows = tokencount.token_counts(awkward(spark, [text, "a b"]), PATH).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {0: library(text), 1: library("a b")}
    assert sum(name.startswith("maps") for name in kept) - 1 <= most
    assert sum(name.startswith("composed") for name in kept) <= (len(text) >> 16).bit_length()
