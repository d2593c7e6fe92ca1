import zlib

from inkstone.llm import langid
from tests.llm.common import awkward, empty, run


def test_query_on_held_out_documents(spark, sf_dir):
    got = run(spark, "op8_language_id", sf_dir)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len(got) == len(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in got.itertuples())
    judged = [r.lang_pred == docs[r.doc_id].lang for r in got.itertuples() if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert sum(judged) >= 0.9 * len(judged)
    assert all((r.lang_pred == "und") == (not any(c.isalpha() for c in docs[r.doc_id].text or "")) for r in got.itertuples())


EN, DE = "the house and the river were quiet in the morning ", "das Haus und der Fluss waren still am frühen Morgen "


def test_few_languages_and_awkward_texts(spark):
    docs = spark.createDataFrame([(1, EN, "en"), (2, EN * 2, "en"), (3, DE, "de"), (4, DE * 3, "de"), (5, None, "de"), (6, "12", "fr"), (7, DE, None)], "doc_id long, text string, lang string")
    model = langid.train(docs)
    assert model.languages == ["de", "en"]
    asked = awkward(spark, [None, "", "123 !?", "the river", "der Fluss", EN * 30_000, "x" * 100_000, "the river"])
    rows = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert [rows[i].lang_pred for i in (0, 1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "de", "en"]
    assert rows[3][1:] != rows[4][1:] and rows[3].lang_pred == rows[7].lang_pred and rows[0].score == 0
    one = langid.train(docs.where("lang = 'en'"))
    assert {r.lang_pred for r in langid.identify(asked, one).collect()} == {"en", "und"}
    none = langid.train(empty(spark))
    assert {r.lang_pred for r in langid.identify(asked, none).collect()} == {"und"}
    assert langid.identify(empty(spark), model).count() == 0
