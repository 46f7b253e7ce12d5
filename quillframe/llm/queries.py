"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillframe.llm import decontam, html, langid, packing, passages, quality, rules, simhash, sql, tokenfile, urls
from quillframe.llm.common import Workspace, table

#: Bytes of pieces that a worker remembers in the packing query, which shares its executors with no other operator.
PACKING_CACHE_BYTES = 192 << 20
#: (host, path, verdict)
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def op2_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.report(table(spark, sf_dir, "pages"), URL_RULES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.evaluate(table(spark, sf_dir, "documents"), Workspace(spark, "language"))


def op3_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{Workspace(spark, 'tokens').path}/store"
    tokenfile.write_store(table(spark, sf_dir, "documents"), path, tokenizer_path(), end_id=2)
    rows = tokenfile.stored_documents(spark, path)
    return rows.select(F.col("key").cast("long").alias("doc_id"), "start", "n_tokens", "ids_crc32", "indexed")


def op4_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.report(table(spark, sf_dir, "pages"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), cache_bytes=PACKING_CACHE_BYTES)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.report(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op9_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(table(spark, sf_dir, "documents"))


def op10_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language": op1_language,
        "op2_urls": op2_urls,
        "op3_token_file": op3_token_file,
        "op4_html": op4_html,
        "op5_packing": op5_packing,
        "op6_decontaminate": op6_decontaminate,
        "op7_quality": op7_quality,
        "op8_simhash": op8_simhash,
        "op9_rules": op9_rules,
        "op10_passages": op10_passages,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_urls": sql.OP2, "op6_decontaminate": sql.OP6}
