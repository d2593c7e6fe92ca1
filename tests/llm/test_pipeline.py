import corpus_pipeline
from inkstone.llm import pii
from inkstone.llm.queries import tokenizer
from tests.llm.common import SCHEMA, awkward, empty
from tests.llm.test_decontamination import plain as contaminated
from tests.llm.test_neardup import plain as components
from tests.llm.test_pii import plain as personal


def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def test_stages_against_plain_ones(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "pii", "bpe"]
    texts = {r.doc_id: r.text for r in stages["quality"](spark, docs, sf_dir).collect()}
    assert 0 < len(texts) < docs.count()
    texts = {i: texts[i] for i, (_, c) in components(list(texts.items())).items() if i == c}
    bad = contaminated(list(texts.items()), items)
    texts = {i: t for i, t in texts.items() if not bad[i][3]}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert set(out) == set(texts)
    encode = library().encode
    for i, t in texts.items():
        masked = pii.mask(t, pii.spans_of(t))
        assert out[i].decoded == masked and not personal(masked)
        assert out[i].ids == encode(masked, add_special_tokens=False).ids


TEXTS = [None, "", " \n", "plain words of a quiet day by the river", "plain words of a quiet day by the river", "ask joe@mail.example.org about it, he knows all of it", "word " * 30_000, "日本語 🙂 text with a few words more", "A B C D E F G"]


def test_each_stage_on_awkward_documents(spark, sf_dir):
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing columns, and no row at all. What a stage
    may drop is dropped; all but the last return the columns of documents."""
    docs = awkward(spark, TEXTS)
    docs = docs.unionByName(docs.where("doc_id = 5")).unionByName(spark.createDataFrame([(None, "a text whose id is null, for once", *[None] * 7)], SCHEMA))
    stages = dict(corpus_pipeline.STAGES)
    kept = {name: stages[name](spark, docs, sf_dir) for name in stages}
    assert all(kept[n].columns == docs.columns for n in list(stages)[:-1])
    ids = {n: [r.doc_id for r in df.select("doc_id").collect()] for n, df in kept.items()}
    listed = lambda n: sorted(-1 if i is None else i for i in ids[n])
    assert not {0, 1, 2} & set(ids["quality"])  # without words
    assert listed("near_duplicates") == [-1, 0, 1, 2, 3, 5, 6, 7, 8]  # one of equal texts and of repeated rows
    assert listed("decontamination") == listed("pii") == listed("bpe") == [-1, 0, 1, 2, 3, 4, 5, 5, 6, 7, 8]
    masked = {r.doc_id: r.text for r in kept["pii"].collect()}
    assert masked[5] == "ask [EMAIL] about it, he knows all of it" and masked[0] is None and masked[6] == TEXTS[6]
    encode = library().encode
    assert all(r.ids == encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids and r.decoded == (TEXTS[r.doc_id] or "") for r in kept["bpe"].collect() if r.doc_id is not None)
    assert all(stage(spark, empty(spark), sf_dir).count() == 0 for stage in stages.values())
