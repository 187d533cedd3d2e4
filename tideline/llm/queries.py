"""Queries of this subpackage by name, and SQL where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm import bpe, mixing, subjects

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query()
def p6_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, sf, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _mix(spark: SparkSession, sf: str) -> mixing.Mix:
    """Longer documents of a source are likelier, by the logarithm of their length."""
    documents = table(spark, sf, "documents").select("doc_id", "text", "source", F.log2(F.length("text") + 2).alias("weight"))
    return mixing.mix(documents, table(spark, sf, "mix_targets"), weight="weight")


@query()
def p7_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The mix: documents with their number of copies."""
    return _mix(spark, sf).copies


@query()
def p7_report(spark: SparkSession, sf: str) -> DataFrame:
    """Target and actual share of every source in the mix, and repeats used."""
    return _mix(spark, sf).report


@query()
def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with the subjects that a substantial part of them is about."""
    return subjects.subject_areas(*(table(spark, sf, t) for t in ("documents", "subjects", "subject_labels")))
