"""The registered queries of the training-data operators, over whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontam, exact_dedup, html_extract, line_dedup, mixing, pii, quality, sharding, simhash, warc
from .shared import table

Query = Callable[[SparkSession, str], DataFrame]


def _quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs.select("doc_id", "text"), model).where(f"score >= {quality.THRESHOLD}").select("doc_id", "score")


QUERIES: dict[str, Query] = {
    "op1_quality_rules": _quality,
    "op2_mixing": lambda spark, sf_dir: mixing.report(table(spark, sf_dir, "documents")),
    "op3_decontamination": lambda spark, sf_dir: decontam.holds(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")),
    "op4_warc": lambda spark, sf_dir: warc.report(table(spark, sf_dir, "pages")),
    "op5_pii": lambda spark, sf_dir: pii.spans(table(spark, sf_dir, "documents")),
    "op6_exact_dedup": lambda spark, sf_dir: exact_dedup.duplicates(table(spark, sf_dir, "documents")),
    "op7_sharding": lambda spark, sf_dir: sharding.assign(table(spark, sf_dir, "documents")),
    "op8_line_dedup": lambda spark, sf_dir: line_dedup.dedup(table(spark, sf_dir, "documents")),
    "op9_simhash": lambda spark, sf_dir: simhash.groups(table(spark, sf_dir, "documents")),
    "op10_html_content": lambda spark, sf_dir: html_extract.content(table(spark, sf_dir, "pages")),
}

ORACLE_SQL: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op3_decontamination": decontam.SQL,
    "op4_warc": warc.SQL,
    "op6_exact_dedup": exact_dedup.SQL,
    "op8_line_dedup": line_dedup.SQL,
}
