"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import spread
from .chat_format import format_chats
from .decontaminate import find_benchmark
from .html_extract import extract_pages
from .mixing import schedule, token_sizes
from .near_dedup import near_duplicates
from .oracles import SQL
from .pii import KINDS, pseudonymise
from .quality_rules import quality_rules
from .sharding import shard_documents
from .storage import new_folder
from .substring_dedup import remove_repeats
from .token_count import count_tokens

#: A key for tests; a deployment passes its own.
TEST_KEY = b"a key for tests only"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Tools whose calls the chat query checks.
SCHEMAS = """
SELECT * FROM VALUES ('search', 'query', 'string', true), ('search', 'limit', 'integer', false), ('calculate', 'expression', 'string', true) AS t(name, param, type, required)
"""


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"), "lang")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(_read(spark, sf_dir, "conversations"), spark.sql(SCHEMAS))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pseudonymise(_read(spark, sf_dir, "documents"), TEST_KEY)
    return found.select("doc_id", "text", *(f"n_{k}" for k in KINDS))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_read(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return schedule(token_sizes(_read(spark, sf_dir, "documents")), entropy=0.97)


def op6_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(_read(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(_read(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_benchmark(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(_read(spark, sf_dir, "documents"), new_folder(spark, "shards"))


def op10_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(_read(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_rules, op2_chat_format, op3_pii, op4_near_dedup, op5_mixing, op6_token_count, op7_substring_dedup, op8_decontaminate, op9_sharding, op10_html_extract)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
