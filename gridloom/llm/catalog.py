"""Registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import chat, decontaminate, lines, pii, repair, substrings
from gridloom.llm.alignment import alignment_links
from gridloom.llm.common import table
from gridloom.llm.embeddings import SQL as EMBEDDINGS_SQL
from gridloom.llm.embeddings import near_embeddings
from gridloom.llm.mixing import mix
from gridloom.llm.quality import score_quality
from gridloom.llm.simhash import simhash_components
from gridloom.llm.sstable import token_shards
from gridloom.llm.token_counts import count_tokens


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find_pii(table(spark, sf_dir, "documents")))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents")).drop("row", "group")


def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest(substrings.find_repeats(table(spark, sf_dir, "documents")))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.find_benchmark(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents")).drop("row")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).drop("row")


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.digest(lines.repeated_lines(table(spark, sf_dir, "documents")))


def op8_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_shards(table(spark, sf_dir, "documents"))


def op9_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_embeddings(table(spark, sf_dir, "embeddings"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repair(repair.damaged(table(spark, sf_dir, "conversations")))


def op12_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digest(chat.format_chats(chat.with_planted(table(spark, sf_dir, "conversations"))))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment_links(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_simhash": op2_simhash,
    "op3_substrings": op3_substrings,
    "op4_decontaminate": op4_decontaminate,
    "op5_quality": op5_quality,
    "op6_mixing": op6_mixing,
    "op7_lines": op7_lines,
    "op8_sstable": op8_sstable,
    "op9_embeddings": op9_embeddings,
    "op10_token_counts": op10_token_counts,
    "op11_repair": op11_repair,
    "op12_chat": op12_chat,
    "op13_alignment": op13_alignment,
}
ORACLE_SQL: dict[str, str] = {
    "op1_pii": pii.SQL,
    "op3_substrings": substrings.SQL,
    "op4_decontaminate": decontaminate.SQL,
    "op7_lines": lines.SQL,
    "op9_embeddings": EMBEDDINGS_SQL,
    "op11_repair": repair.SQL,
    "op12_chat": chat.SQL,
}
