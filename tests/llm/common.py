"""Documents that are awkward in one way each, with an extra column that clashes with outputs."""

import pandas as pd

from inkstone.llm import queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, id string, shard string"


def awkward(spark, texts):
    rows = [(i, t, None if i % 7 == 3 else "en", None, None, "x", None, "y", None) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def run(spark, name, sf_dir) -> pd.DataFrame:
    return queries.queries()[name](spark, sf_dir).toPandas()


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
