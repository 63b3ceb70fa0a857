"""Exact duplicates by a 128-bit content hash, with a comparison of bytes inside groups.

Only hashes and ids are shuffled for all documents.  The texts of the groups
that have more than one document are then compared with the text of the group's
smallest ``doc_id``; a document that differs from it, a collision, goes through
the same again with the others that do, so equal hashes never drop a text that
isn't equal.

Defined cases: a null text equals nothing; empty texts are equal to each other.
Rows whose ``doc_id`` is null or no whole number can't be named and are left out.
Rows that share a ``doc_id`` are no duplicates of each other.  Other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import opened, small_or_not, whole_number, written


def content_hash(text: Column) -> Column:
    """128 bits as 16 bytes."""
    return F.unhex(F.md5(text))


def duplicates(docs: DataFrame, digest: Callable[[Column], Column] = content_hash) -> DataFrame:
    """``doc_id, keep_id`` of each document whose bytes equal those of one of smaller id; ``keep_id`` is the smallest."""
    named = opened(docs, "doc_id", "text")[0].select(whole_number("doc_id").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null and text is not null")
    return _pairs(named, digest).distinct()


def _pairs(named: DataFrame, digest: Callable[[Column], Column]) -> DataFrame:
    keyed = named.withColumn("hash", digest(F.col("text")))
    shared = keyed.groupBy("hash").agg(F.min("doc_id").alias("keep_id"), F.max("doc_id").alias("last")).where("keep_id < last").select("hash", "keep_id")
    shared = written(shared, "exact-groups")
    members = keyed.join(small_or_not(shared, 64), "hash")
    first = members.where("doc_id = keep_id").groupBy("hash").agg(F.min("text").alias("keep_text"))
    compared = members.where("doc_id > keep_id").join(first.hint("shuffle_hash"), "hash").select("doc_id", "keep_id", "hash", (F.col("text") == F.col("keep_text")).alias("equal"))
    compared = written(compared, "exact-compared")
    same, rest = compared.where("equal").select("doc_id", "keep_id"), compared.where("not equal")
    if rest.isEmpty():
        return same
    others = keyed.join(small_or_not(written(rest.select("doc_id", "hash").distinct(), "exact-rest"), 64), ["doc_id", "hash"], "left_semi").select("doc_id", "text")
    held = members.where("doc_id = keep_id").groupBy("hash").agg(F.min("text").alias("text"))
    others = others.withColumn("hash", digest(F.col("text"))).join(held.hint("shuffle_hash"), ["hash", "text"], "left_anti").select("doc_id", "text")
    return same.unionByName(_pairs(others, digest))


SQL = """
SELECT DISTINCT doc_id, keep_id FROM (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS keep_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
WHERE doc_id <> keep_id
"""
