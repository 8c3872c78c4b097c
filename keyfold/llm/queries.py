"""The subpackage's queries over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyfold.llm import decontamination, mixing, pii, secret_scan, simhash_dedup, substring_dedup, token_counts, token_files, topk_search, toxicity
from keyfold.llm.common import new_path, table
from keyfold.llm.sql import MIX_SQL, PII_SQL, REPEATS_SQL, SECRETS_SQL, TOP_K_SQL

#: Shares of output rows; sources not named share REST.
WEIGHTS = {"src0": 0.10, "src1": 0.15, "src2": 0.15, "src3": 0.10, "src4": 0.05}
REST = 0.45
MIX_SEED = 17
#: The id that ends each document in token files.
END_ID = 1


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return token_counts.count_tokens(docs, tokenizer("byte_bpe_50k.json"), new_path(spark, "token-cache"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors.where(F.col("vec_id") % 100 == 0), vectors, 10)


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, WEIGHTS, rest=REST, seed=MIX_SEED, copy_col="copy")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), min_words=1)


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    manifest = token_files.write_token_files(docs, token_files.token_folder(spark), tokenizer("word_bpe_49k.json"), end_id=END_ID)
    return token_files.read_token_files(spark, manifest)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents"))
    return pii.digest(found, tuple(r.name for r in secret_scan.BASE))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_dedup.components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), digest=True)
    return found.withColumnRenamed("kept", "kept_sha256")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))
    surest = F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s.score))
    return pii.digest(found, tuple(k.name for k in pii.BASE), "doc_id", surest.alias("max_score"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (
        op1_token_counts, op2_topk_search, op3_mixing, op4_decontamination, op5_token_files,
        op6_secret_scan, op7_simhash_dedup, op8_substring_dedup, op9_toxicity, op10_pii,
    )
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_topk_search": TOP_K_SQL,
        "op3_mixing": MIX_SQL.format(
            named=", ".join(f"('{s}', {w}::DOUBLE)" for s, w in WEIGHTS.items()), rest=REST, seed=MIX_SEED, part=mixing.PART
        ),
        "op6_secret_scan": SECRETS_SQL,
        "op8_substring_dedup": REPEATS_SQL,
        "op10_pii": PII_SQL,
    }
