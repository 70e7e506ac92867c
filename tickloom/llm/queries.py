"""Queries pN_ of the problems on texts; each runs its operator over whole tables with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.functions.plans import table
from tickloom.llm import byte_bpe, mixing, mojibake


def p6_ids(spark: SparkSession, folder: str) -> DataFrame:
    return byte_bpe.encoded(table(spark, folder, "documents"))


def _mix(spark: SparkSession, folder: str) -> mixing.Mix:
    return mixing.Mix(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).documents


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder).shares()


def p8_restored(spark: SparkSession, folder: str) -> DataFrame:
    return mojibake.restored(table(spark, folder, "documents"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return p8_restored(spark, folder).where(F.col("garbled_lines") > 0).select("doc_id")


QUERIES = {f.__name__: f for f in (p6_ids, p7_mix, p7_shares, p8_found, p8_restored)}
#: No query here has a SQL form: encoding, its sizes and the mix built on them are checked against brute force in tests/llm.
ORACLE: dict[str, str] = {}
