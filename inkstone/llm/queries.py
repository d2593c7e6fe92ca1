"""The operators of this subpackage as registered queries, each over its whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkstone.llm import bpe, decontamination, langid, licenses, neardup, ngramlm, oracles, pii, quality, repair, sharding, tokencount, topk, whitening
from inkstone.llm.scratch import Scratch

#: The part of all documents that op7 draws.
SAMPLED = 0.5
#: Tokens beyond which a text is over the limit of a training window.
TOKEN_LIMIT = 4096
#: 40 shards, numbered 0 to 39: 4 regions of 2 racks of 5 shards.
TREE = sharding.Topology.regular(4, 2, 5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Where a public vocabulary file is on this machine; the operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.report(docs, table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")


def op1_proximity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near matches; a query of its own, since ``op1_decontamination`` has the columns of its SQL."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.report(docs, table(spark, sf_dir, "benchmark"), slop=decontamination.SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_near", F.size("near_items").cast("long").alias("n_near_items"), F.concat_ws(",", "near_items").alias("near_items"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), topk.scaled(F.col("embedding")).alias("v"))
    return topk.PivotIndex(vectors, 5).search(vectors.where(F.col("id") % 50 == 0))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = tokencount.token_counts(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard_documents(table(spark, sf_dir, "documents"), TREE, TREE.with_region())
    return out.withColumn("law", F.lit("key"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its licences, and each match as template:unit:start:end:score in millionths."""
    found = licenses.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = F.transform("matches", lambda m: F.concat_ws(":", m["template"], m["unit"], m["start"], m["end"], F.round(m["score"] * 1e6).cast("long")))
    return found.select("doc_id", "n_matches", F.concat_ws(",", "licenses").alias("licenses"), "best_score", F.concat_ws(",", listed).alias("matches"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; ``sampled`` are the ``SAMPLED`` part of all documents, of those kept, by Gumbel top-k."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs, model).select("doc_id", "log_weight", "score", "gumbel", "accepted")
    scored = Scratch(spark, "quality").keep(scored, "scored")
    drawn = quality.resample(scored, int(SAMPLED * scored.count()))
    return drawn.select("doc_id", "score", "log_weight", F.col("accepted").alias("kept"), "sampled")


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.train(docs.where(~held_out))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "ambiguous")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_decode(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents")).drop("pii")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``deviation`` is exact; beyond the range of a long, which takes over ten million vectors of common size, it is null."""
    return whitening.components(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    found = ngramlm.lm_scores(table(spark, sf_dir, "documents"), held_out)
    return found.select(F.col("id").alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(table(spark, sf_dir, "conversations"), damage=True)


def queries() -> dict:
    return {
        "op1_decontamination": op1_decontamination,
        "op1_proximity": op1_proximity,
        "op2_topk": op2_topk,
        "op3_token_counts": op3_token_counts,
        "op4_near_duplicates": op4_near_duplicates,
        "op5_sharding": op5_sharding,
        "op6_licenses": op6_licenses,
        "op7_quality": op7_quality,
        "op8_language_id": op8_language_id,
        "op9_bpe": op9_bpe,
        "op10_pii": op10_pii,
        "op11_whitening": op11_whitening,
        "op12_lm_scores": op12_lm_scores,
        "op13_repair": op13_repair,
    }


def oracle_sql() -> dict[str, str]:
    """Those that SQL can express; tests hold the others against brute force."""
    return {"op1_decontamination": oracles.DECONTAMINATION, "op2_topk": oracles.TOPK, "op4_near_duplicates": oracles.NEAR_DUPLICATES, "op5_sharding": oracles.sharding(TREE, TREE.with_region())}
