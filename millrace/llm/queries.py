"""Queries of the problems on texts: name -> (session, folder) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from ..tables import load
from . import credentials, mojibake, packing, tokenization


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return credentials.found(load(spark, folder, "entries")).select("entry_id", "line_no").distinct()


def p6_redacted(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return credentials.redacted(load(spark, folder, "entries"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return tokenization.encoded(load(spark, folder, "documents"))


def p7_counts(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return tokenization.counted(load(spark, folder, "documents"))


def p8_packed(spark: SparkSession, folder: str) -> DataFrame:
    return packing.packed(spark, load(spark, folder, "documents"), load(spark, folder, "budgets"))


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    return packing.fill(p8_packed(spark, folder), load(spark, folder, "budgets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return mojibake.repaired(load(spark, folder, "documents")).select("doc_id").distinct()


def p9_restored(spark: SparkSession, folder: str) -> DataFrame:
    ship(spark)
    return mojibake.repaired(load(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (p6_found, p6_redacted, p7_ids, p7_counts, p8_packed, p8_fill, p9_found, p9_restored)}
