"""The corpus pipeline: five stages over whole documents, each written as Parquet and read again by the next.

What all stages do with awkward rows: an empty table stays empty; columns beside ``doc_id`` and ``text`` are carried along, whatever
their names and nulls; texts are read whole, however long; nothing depends on the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from inkstone.llm import bpe, decontamination, neardup, pii, quality
from inkstone.llm.queries import table, tokenizer
from inkstone.llm.scratch import Scratch

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects. A null text is judged as an empty one; labels without a document, and
    null labels, teach nothing; equal texts get equal verdicts, and repeated rows go or stay together."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.classify(docs, model).where("accepted").select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least id; of repeated rows with one id, one. Null and empty texts are
    like nothing and stay."""
    return neardup.without_near_duplicates(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that benchmark passages contaminate. Null and empty texts hold no passage and stay, also under a null id;
    null items of the benchmark are left out; repeated rows go or stay together."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data in the texts and updates their lengths. Null texts stay null; every row stays."""
    return pii.redact_documents(docs)


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the text that they decode to. A null text is an empty one, without ids; every row stays, and
    repeated rows are encoded alike."""
    return bpe.encode_decode(docs, tokenizer("byte_bpe_50k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("pii", pii_stage),
    ("bpe", bpe_stage),
]

#: Hashed n-gram models and tokenizers are beyond SQL; tests compare the pipeline with a plain one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table of documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), name)
        if i:
            scratch.drop(STAGES[i - 1][0])
    return docs
