"""Small tables with the awkward rows that operators must stand."""

from __future__ import annotations

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8))) for _ in range(n))


def documents(spark, rows):
    """Rows (doc_id, text) or whole rows."""
    full = [(*r, "en", "s1", None if r[1] is None else len(r[1])) if len(r) == 2 else r for r in rows]
    return spark.createDataFrame(full, DOCS)


def awkward(rng: random.Random):
    base = words(rng, 60)
    return [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, ""), (None, base), (None, None), (6, "one"), (7, " \n\t "), (8, words(rng, 60_000)), (9, words(rng, 40)), (10, base + " " + words(rng, 2)), (11, "é" * 50)]


def with_clashes(df):
    """Extra columns named like what operators make."""
    from pyspark.sql import functions as F

    names = ["score", "shard", "keep_id", "f0", "copy", "rate", "mix_source", "mix_rate", "hash", "lines", "count_chars", "stat_upper", "shard_key", "row_order", "label", "kind"]
    return df.withColumns({n: F.lit(None).cast("string") if i % 2 else F.lit(i) for i, n in enumerate(names)})


def odd_names(df):
    """The needed columns in other cases, and columns with dots, blanks and operators' names in other cases."""
    from pyspark.sql import functions as F

    names = ["Doc_ID", "TEXT", "lang", "Source", "n_chars"]
    return df.toDF(*names).select("*", *[F.lit(k).alias(n) for k, n in enumerate(["a.b", "x y", "Copy", "SHARD", "Score", "simhash_id", "_0", "`q`"])])
