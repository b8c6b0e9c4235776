"""One query for each corpus operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import licenses, oracles, quality_model, secret_scan, sentence_pieces, top_k, url_filter
from .near_dup import near_duplicates
from .packing import pack
from .quality_rules import quality_rules
from .record_files import token_records
from .shared import table


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.digest(licenses.license_scan(table(spark, sf_dir, "documents")))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=4, percent=80)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op5_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_records(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(table(spark, sf_dir, "pages"))


def op8_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), with_ids=False)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(table(spark, sf_dir, "documents")))


QUERIES = {
    "op1_top_k": op1_top_k,
    "op2_license_scan": op2_license_scan,
    "op3_minhash": op3_minhash,
    "op4_quality_classifier": op4_quality_classifier,
    "op5_token_records": op5_token_records,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_url_filter": op7_url_filter,
    "op8_sentence_pieces": op8_sentence_pieces,
    "op9_quality_rules": op9_quality_rules,
    "op10_secret_scan": op10_secret_scan,
}
#: Training, tokenizers and packing can't be put in SQL; the tests hold those against brute force.
ORACLES: dict[str, str] = {
    "op1_top_k": top_k.oracle(),
    "op2_license_scan": oracles.license_labels(),
    "op3_minhash": oracles.near_duplicates(size=4, percent=80),
    "op7_url_filter": oracles.urls(),
    "op9_quality_rules": oracles.quality(),
    "op10_secret_scan": oracles.secret_spans(),
}
