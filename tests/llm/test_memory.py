from pyspark.sql import functions as F

from inkstone.llm import pii
from inkstone.llm.memory import modest_batches

KEY = "spark.sql.parquet.columnarReaderBatchSize"


def batches_read(df) -> int:
    """How many batches the reader of Parquet made of a table."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    while plan.nodeName() != "ColumnarToRow":
        plan = plan.children().head()
    return plan.metrics().apply("numInputBatches").value()


def test_texts_are_read_in_small_batches(spark, tmp_path):
    n, before = 3000, spark.conf.get(KEY, None)
    spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("a@b.cd "), "id").alias("text")).coalesce(1).write.parquet(str(tmp_path / "docs"))
    spark.conf.unset(KEY)
    try:
        out = pii.redact_documents(spark.read.parquet(str(tmp_path / "docs")))
        assert sorted(r.text for r in out.collect()) == sorted(f"[EMAIL] {i}" for i in range(n))
        assert batches_read(spark.read.parquet(str(tmp_path / "docs"))) >= n // 256
        spark.conf.set(KEY, "100")  # a smaller one stays
        modest_batches(spark)
        assert spark.conf.get(KEY) == "100"
    finally:
        spark.conf.unset(KEY) if before is None else spark.conf.set(KEY, before)
