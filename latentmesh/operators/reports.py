"""Text tables of results; they are small, so they are put together on the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .counts import base_gene, hypermutators
from .fit import pair_name

_ESCAPES = {"_": r"\_", "&": r"\&", "%": r"\%", "#": r"\#"}


def number(x: float | None) -> str:
    """Two decimals without trailing zeros from 0.01 up, else mantissa and power of ten; empty for none."""
    if x is None or x != x:
        return ""
    if x == 0 or abs(x) >= 0.01:
        return f"{x:.2f}".rstrip("0").rstrip(".")
    mantissa, power = f"{x:.1e}".split("e")
    return f"{mantissa.rstrip('0').rstrip('.')}\\times10^{{{int(power)}}}"


def escaped(text: str) -> str:
    return "".join(_ESCAPES.get(c, c) for c in text)


def latex(table: DataFrame, columns: dict[str, str], caption: str, label: str, rows: int = 100) -> str:
    """A LaTeX table of the first rows, numbers as ``number`` writes them."""
    found = table.select(*columns).limit(rows).collect()

    def cell(v: object) -> str:
        return f"${number(v)}$" if isinstance(v, float) else "" if v is None else escaped(str(v))

    body = " \\\\\n".join(" & ".join(cell(v) for v in r) for r in found)
    head = " & ".join(escaped(t) for t in columns.values())
    return f"\\begin{{table}}\n\\centering\n\\caption{{{escaped(caption)}}}\n\\label{{{label}}}\n\\begin{{tabular}}{{{'l' * len(columns)}}}\n\\toprule\n{head} \\\\\n\\midrule\n{body} \\\\\n\\bottomrule\n\\end{{tabular}}\n\\end{{table}}\n"


def cohort_summary(counts: DataFrame, names: DataFrame) -> DataFrame:
    """``cohort, name, samples, missense, nonsense``: sizes of cohorts beside their long names."""
    at = lambda s: F.sum(F.when(F.col("feature").endswith(s), F.col("c")).otherwise(0))
    sizes = counts.groupBy("cohort").agg(F.count_distinct("sample").alias("samples"), at("_M").alias("missense"), at("_N").alias("nonsense"))
    return sizes.join(names, "cohort").select("cohort", "name", "samples", "missense", "nonsense")


def supplement(called: DataFrame, burdens: DataFrame, times: float = 10.0) -> DataFrame:
    """By background the numbers of significant pairs of either direction, in columns, with the cohort's burden."""
    hit = F.col("significant")
    flat = called.groupBy("bmr").agg(F.count_if(hit & (F.col("direction") == "CO")).alias("co"), F.count_if(hit & (F.col("direction") == "ME")).alias("me"))
    return flat.crossJoin(F.broadcast(hypermutators(burdens, times)))  # one row is broadcast


def count_histogram(values: DataFrame, column: str, below: int = 25) -> DataFrame:
    """How often each count below a limit occurs."""
    return values.where(F.col(column) < below).groupBy(column).agg(F.count("*").alias("n"))


def is_rate(pi: Column) -> Column:
    return (pi >= 0) & (pi < 1)


def is_distribution(tolerance: float = 1e-2) -> Column:
    """Whether t00, t01, t10 and t11 are rates that sum to 1, with t11 below 1."""
    taus = [F.col(f"t{k}") for k in ("00", "01", "10", "11")]
    inside = taus[0].between(0, 1)
    for t in taus[1:]:
        inside = inside & t.between(0, 1)
    return inside & (F.abs(sum(taus[1:], taus[0]) - 1) <= tolerance) & (taus[3] != 1)


def sensitivity(rates: DataFrame, gene: str, passengers: DataFrame, k: int) -> DataFrame:
    """By background: a gene's highest rate, and how many genes among the first ``k`` features by rate are likely passengers."""
    ranked = rates.withColumns({"gene": base_gene(F.col("feature")), "rn": F.row_number().over(Window.partitionBy("bmr").orderBy(F.desc_nulls_last("pi"), "feature"))})
    marked = ranked.join(passengers.select("gene").distinct().withColumn("passenger", F.lit(True)), "gene", "left")
    first = (F.col("rn") <= k) & F.col("passenger")
    return marked.groupBy("bmr").agg(F.max(F.when(F.col("gene") == gene, F.col("pi"))).alias("pi_of_one"), F.count_distinct(F.when(first, F.col("gene"))).cast("int").alias("passengers_top"))


def burden_and_pairs(burdens: DataFrame, pairs: DataFrame, backgrounds: Sequence[str]) -> DataFrame:
    """By cohort its samples, their median burden, and the number of pairs found under each background, which are listed."""
    sizes = burdens.groupBy("cohort").agg(F.count("*").alias("samples"), F.median("burden").alias("median_burden"))
    found = pairs.groupBy("cohort").agg(*[F.count_if(F.col("bmr") == b).alias(f"co_{b}") for b in backgrounds])
    return sizes.join(found, "cohort", "left").na.fill(0, [f"co_{b}" for b in backgrounds])


def top_names(ranked: DataFrame, k: int) -> DataFrame:
    """``cohort, bmr, names``: the first ``k`` pairs by their genes' names."""
    name = pair_name(base_gene(F.col("a")), base_gene(F.col("b")))
    first = ranked.where(F.col("rk") <= k).groupBy("cohort", "bmr").agg(F.array_sort(F.collect_list(F.struct("rk", name.alias("name")))).alias("x"))
    return first.select("cohort", "bmr", F.array_join(F.col("x.name"), ", ").alias("names"))


def shared(sets: DataFrame, reference: DataFrame, by: str = "cohort") -> DataFrame:
    """How many genes of each set are in the reference, and their share."""
    marked = sets.join(reference.select("gene").distinct().withColumn("hit", F.lit(1)), "gene", "left")
    return marked.groupBy(by).agg(F.count("hit").alias("shared"), F.avg(F.coalesce("hit", F.lit(0))).alias("share"))
