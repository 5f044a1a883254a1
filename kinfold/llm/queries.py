"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import ann, bpe, chat, lines, media, minhash, mixing, pii, quality, suffix

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), TOKENIZER)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digests(table(spark, sf_dir, "documents"))


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.link(table(spark, sf_dir, "documents"), words=2)


def op4_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.digests(table(spark, sf_dir, "documents"))


def op5_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(table(spark, sf_dir, "conversations"))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(table(spark, sf_dir, "documents"))


def page_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sequences of :func:`op6_media`'s operator over the web pages."""
    return media.page_digests(table(spark, sf_dir, "pages"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digests(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op10_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_pii": op2_pii,
    "op3_minhash": op3_minhash,
    "op4_suffix": op4_suffix,
    "op5_chat": op5_chat,
    "op6_media": op6_media,
    "op7_lines": op7_lines,
    "op8_mixing": op8_mixing,
    "op9_quality": op9_quality,
    "op10_ann": op10_ann,
    "page_sequences": page_sequences,
}

#: DuckDB SQL over the same tables, where SQL can express the operator.
ORACLE: dict[str, str] = {
    "op3_minhash": minhash.ORACLE,
    "op5_chat": chat.ORACLE,
    "op7_lines": lines.ORACLE,
}
