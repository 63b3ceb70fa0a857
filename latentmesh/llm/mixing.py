"""Mixing sources to target weights by repetition.

A source's rate is its target share of the tokens over its own tokens.  Each
document is emitted floor(rate) times, and once more with a probability equal
to the fraction that is left, decided by a hash of ``doc_id`` and the seed, so
a run can be repeated.  A token is a run of characters other than blanks.

The target shares are given by source, or are those of temperature sampling:
tokens to the power ``ALPHA``.  The total is the corpus's own unless
``target_tokens`` is given.

Defined cases: a null source is a source of its own, named by None in given
weights.  A source that is absent from given weights has weight 0 and goes.  A
null or empty text has no tokens; it is emitted at its source's rate, and a
source without any token has the rate 0.  A null ``doc_id`` draws as the empty
string does; ids of any type draw by their text.  Repeated rows draw alike.
Other columns are carried along, whatever their names; one named like ``copy``
but for case is replaced.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_BYTES, opened, small_or_not, written

ALPHA = 0.5
SEED = 17
_HEX = 13


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^ \t\n\r\f]++")), F.lit(0)).cast("long")


def rates(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, target_tokens: int | None = None) -> DataFrame:
    """``source, tokens, rate`` of every source in ``docs``."""
    sums = opened(docs, "source", "text")[0].groupBy(F.col("source").cast("string").alias("source")).agg(F.sum(tokens(F.col("text"))).alias("tokens"))
    if weights is None:
        weighed = sums.withColumn("w", F.when(F.col("tokens") > 0, F.pow(F.col("tokens").cast("double"), F.lit(float(alpha)))).otherwise(F.lit(0.0)))
    else:
        given = docs.sparkSession.createDataFrame([(k, float(v)) for k, v in weights.items()] or [(None, 0.0)], "name string, w double")
        weighed = sums.join(given, F.col("source").eqNullSafe(F.col("name")), "left").select("source", "tokens", F.coalesce("w", F.lit(0.0)).alias("w"))
        weighed = weighed.withColumn("w", F.when(F.col("tokens") > 0, F.col("w")).otherwise(F.lit(0.0)))
    weighed = written(weighed, "mixing-weights")
    whole = weighed.agg(F.sum("tokens").alias("all_tokens"), F.sum("w").alias("all_w")).first()
    goal = float(whole.all_tokens or 0) if target_tokens is None else float(target_tokens)
    share = F.lit(goal) * (F.col("w") / F.lit(whole.all_w or 1.0)) / F.col("tokens")
    return weighed.select("source", "tokens", F.when((F.col("tokens") > 0) & (F.col("w") > 0), share).otherwise(F.lit(0.0)).alias("rate"))


def draw(doc_id: Column, seed: int) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, _HEX), 16, 10).cast("long") / F.lit(float(16**_HEX))


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, alpha: float = ALPHA, target_tokens: int | None = None, seed: int = SEED, copy: str | None = None) -> DataFrame:
    """``docs`` with each row as often as its source's rate says; ``copy`` names a column for the number of the copy, from 0."""
    held, closed = opened(docs, "doc_id", "source", "text")
    by_source = rates(held, weights, alpha, target_tokens).select(F.col("source").alias("mix_source"), F.col("rate").alias("mix_rate"))
    joined = held.join(small_or_not(by_source, 128, BROADCAST_BYTES), F.col("source").cast("string").eqNullSafe(F.col("mix_source")))
    whole = F.floor("mix_rate")
    times = whole + F.when(draw(F.col("doc_id"), seed) < F.col("mix_rate") - whole, 1).otherwise(0)
    many = joined.withColumn("mix_copies", times.cast("int")).where("mix_copies > 0")
    emitted = many.select(*held.columns, F.explode(F.sequence(F.lit(0), F.col("mix_copies") - 1)).alias("mix_copy"))
    return closed(emitted, **({copy: "mix_copy"} if copy else {}))


def report(docs: DataFrame) -> DataFrame:
    """``doc_id, source, copy`` of everything that the default mix emits."""
    return mix(opened(docs, "doc_id", "source", "text")[0].select("doc_id", "source", "text"), copy="copy").select("doc_id", "source", "copy")


SQL = rf"""
WITH t AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f]+')))::BIGINT AS tokens FROM documents GROUP BY source),
r AS (SELECT source, tokens, CASE WHEN tokens > 0 THEN pow(tokens::DOUBLE, {ALPHA}) ELSE 0 END AS w FROM t),
s AS (SELECT source, CASE WHEN tokens > 0 THEN (SELECT sum(tokens)::DOUBLE FROM r) * (w / (SELECT sum(w) FROM r)) / tokens ELSE 0 END AS rate FROM r),
d AS (
  SELECT d.doc_id, d.source, floor(rate)::BIGINT
    + CASE WHEN ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, '')), 1, {_HEX}))::BIGINT / {float(16**_HEX)!r} < rate - floor(rate) THEN 1 ELSE 0 END AS n
  FROM documents d JOIN s ON d.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, source, unnest(range(n))::INTEGER AS copy FROM d WHERE n > 0
"""
