"""The file formats of cohorts, background distributions and results.

Readers have explicit schemas and return lazy, long DataFrames; a problem in a
row raises when the row is read.  Writers take a folder, as Spark's do.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAF_COLUMNS = {"Chromosome": "chrom", "Start_Position": "pos", "Entrez_Gene_Id": "id", "Reference_Allele": "ref", "Tumor_Seq_Allele2": "alt", "Tumor_Sample_Barcode": "sample"}
DIG_COLUMNS = ("GENE", "ALPHA", "THETA", "Pi_MIS", "Pi_NONS")


def _header(spark: SparkSession, path: str, sep: str, comment: str | None = None) -> list[str]:
    lines = spark.read.text(path)
    if comment:
        lines = lines.where(~F.col("value").startswith(comment))
    first = lines.first()
    if first is None:
        raise ValueError(f"{path} is empty")
    return first[0].split(sep)


def _strings(spark: SparkSession, path: str, sep: str, comment: str | None = None) -> DataFrame:
    names = _header(spark, path, sep, comment)
    reader = spark.read.option("header", True).option("sep", sep).schema(", ".join(f"`{n or '_first'}` string" for n in names))
    return (reader.option("comment", comment) if comment else reader).csv(path)


def first_column(spark: SparkSession, path: str, sep: str = "\t") -> str:
    return _header(spark, path, sep)[0] or "_first"


def exists(spark: SparkSession, path: str) -> bool:
    """Whether Hadoop's file system has the path."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def require(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        if not exists(spark, path):
            raise FileNotFoundError(path)


def read_maf(spark: SparkSession, path: str) -> DataFrame:
    """``chrom, pos, id, ref, alt, sample`` of a tab-separated mutation file; other columns are left out."""
    raw = _strings(spark, path, "\t", "#")
    missing = [c for c in MAF_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    kinds = {"pos": "long", "id": "long"}
    return raw.select(*[F.col(c).cast(kinds.get(to, "string")).alias(to) for c, to in MAF_COLUMNS.items()])


def read_kept_mutations(spark: SparkSession, path: str) -> DataFrame:
    """``gene, sample, effect``."""
    return _strings(spark, path, "\t").select("gene", "sample", "effect")


def read_counts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A wide count matrix as ``sample, feature, c`` of the cells above 0, its samples, and ``feature, ord`` in the order of the file."""
    raw = _strings(spark, path, ",")
    first, *features = raw.columns
    long = raw.select(F.col(first).alias("sample"), *[F.col(f"`{f}`").cast("long").alias(f) for f in features]).unpivot("sample", list(features), "feature", "c")
    order = spark.createDataFrame(list(zip(features, range(len(features)))) or [("", 0)], "feature string, ord int").limit(len(features))
    return long.where("c > 0"), raw.select(F.col(first).alias("sample")), order


def read_pmfs(spark: SparkSession, path: str) -> DataFrame:
    """``feature, pmf``: ragged rows without their empty cells, over their sum; a row without a positive sum raises."""
    raw = _strings(spark, path, ",")
    first, *cells = raw.columns
    values = F.filter(F.array(*[F.col(f"`{c}`").cast("double") for c in cells]), lambda x: x.isNotNull() & ~F.isnan(x))
    total = F.aggregate("pmf", F.lit(0.0), lambda s, x: s + x)
    checked = F.when(total > 0, total).otherwise(F.raise_error(F.concat(F.lit("no positive probability for "), F.col("feature"))).cast("double"))
    return raw.select(F.col(first).alias("feature"), values.alias("pmf")).withColumn("total", checked).select("feature", F.when(F.abs(F.col("total") - 1) > 1e-6, F.transform("pmf", lambda x: x / F.col("total"))).otherwise(F.col("pmf")).alias("pmf"))


def read_dig(spark: SparkSession, path: str) -> DataFrame:
    """``gene, alpha, theta, pi_mis, pi_nons``; raises where a column is missing."""
    raw = _strings(spark, path, "\t")
    missing = [c for c in DIG_COLUMNS if c not in raw.columns]
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    return raw.select(F.col("GENE").alias("gene"), *[F.col(c).cast("double").alias(c.lower()) for c in DIG_COLUMNS[1:]])


def read_selection(spark: SparkSession, path: str) -> DataFrame | None:
    """``feature, phi, p`` for both effects of each gene from a table after one line of title; None without the file."""
    if not exists(spark, path):
        return None
    lines = spark.read.text(path, wholetext=False).withColumn("n", F.monotonically_increasing_id()).orderBy("n")
    names = lines.limit(2).collect()[1][0].split("\t")
    cells = F.split("value", "\t")
    rows = lines.where(F.col("value").contains("\t") & (F.element_at(cells, 1) != names[0]))
    at = {n: F.get(cells, F.lit(i)) for i, n in enumerate(names)}
    pairs = {"_M": ("phi_m_pos_or_p(m=0|s)", "p_phi_m_pos"), "_N": ("phi_k_pos_or_p(k=0|s)", "p_phi_k_pos")}
    both = F.array(*[F.struct(F.concat(at["gene"], F.lit(s)).alias("feature"), at[phi].cast("double").alias("phi"), at[p].cast("double").alias("p")) for s, (phi, p) in pairs.items()])
    return rows.select(F.inline(both))


def read_pmf_lines(spark: SparkSession, path: str, suffix: str) -> DataFrame:
    """``feature, pmf`` of a text in which every second line has a name and its probabilities."""
    lines = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("n", "line")).where("n % 2 = 1 and line <> ''")
    cells = F.split("line", "\t")
    return lines.select(F.concat(F.regexp_replace(F.element_at(cells, 1), "_[^_]*$", ""), F.lit(suffix)).alias("feature"), F.transform(F.filter(F.slice(cells, 2, 1 << 20), lambda x: F.trim(x) != ""), lambda x: x.cast("double")).alias("pmf"))


def read_passengers(spark: SparkSession, folder: str) -> DataFrame:
    """``cohort, feature`` of a folder of lists, one text for each cohort."""
    return spark.read.option("pathGlobFilter", "*.txt").text(folder).select(F.regexp_extract(F.input_file_name(), r"([^/]+)\.txt$", 1).alias("cohort"), F.trim("value").alias("feature")).where("feature <> ''")


def read_drivers(spark: SparkSession, path: str, column: str = "Hugo Symbol") -> DataFrame:
    """``feature`` for both effects of each gene in a table."""
    return _strings(spark, path, "\t").select(F.explode(F.array(F.concat(F.col(f"`{column}`"), F.lit("_M")), F.concat(F.col(f"`{column}`"), F.lit("_N")))).alias("feature")).distinct()


def read_clinical(spark: SparkSession, path: str, key: str, field: str) -> DataFrame:
    """``key, type`` of a clinical table whose comments start with #."""
    return _strings(spark, path, "\t", "#").select(F.col(f"`{key}`").alias("key"), F.col(f"`{field}`").alias("type"))


def read_patient_rates(spark: SparkSession, path: str) -> DataFrame:
    """``sample, factor``: a patient's mutations by coverage, over those of all."""
    # by place, as two of the columns' names differ in case alone
    more = "".join(f", _{k} string" for k in range(3, len(_header(spark, path, "\t"))))
    return patient_factors(spark.read.option("header", True).option("sep", "\t").option("enforceSchema", True).schema("sample string, n double, size double" + more).csv(path).select("sample", "n", "size"))


def patient_factors(rates: DataFrame) -> DataFrame:
    """``sample, factor`` from ``sample, n, size``."""
    total = rates.agg((F.sum("n") / F.sum("size")).alias("mean"))
    return rates.crossJoin(F.broadcast(total)).select("sample", (F.col("n") / F.col("size") / F.col("mean")).alias("factor"))  # one row is broadcast


def _decode_rates(genes: list[str], patients: list[str]):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                cube = np.frombuffer(content, "<f4").reshape((len(genes), len(patients), 2), order="F")
                for k, suffix in enumerate(("_M", "_N")):
                    yield pd.DataFrame({"feature": np.repeat([g + suffix for g in genes], len(patients)), "sample": np.tile(patients, len(genes)), "lambda": cube[:, :, k].astype(float).ravel()})

    return run


def read_rate_cube(spark: SparkSession, folder: str) -> DataFrame:
    """``feature, sample, lambda`` of a little-endian f32 cube (genes, patients, effects) in column-major order, with its names beside it."""
    names = [[r[0] for r in spark.read.text(f"{folder}/persample_{x}.txt").collect()] for x in ("genes", "patients")]
    return spark.read.format("binaryFile").load(f"{folder}/persample_lambda.f32").select("content").mapInPandas(_decode_rates(*names), "feature string, sample string, lambda double")


def write_rate_cube(folder: str, genes: Sequence[str], patients: Sequence[str], cube: np.ndarray) -> None:
    """The counterpart for small cubes, as the tool that makes them writes them."""
    with open(f"{folder}/persample_lambda.f32", "wb") as out:
        out.write(struct.pack(f"<{cube.size}f", *cube.ravel(order="F")))
    for name, values in (("genes", genes), ("patients", patients)):
        with open(f"{folder}/persample_{name}.txt", "w") as out:
            out.write("\n".join(values))


def write_csv(df: DataFrame, path: str, one_file: bool = True) -> None:
    """A table of results, as large as the number of features or pairs; one that grows with the samples isn't put in one file."""
    (df.coalesce(1) if one_file else df).write.mode("overwrite").option("header", True).csv(path)


def write_table(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)


def write_maf_input(maf: DataFrame, path: str) -> None:
    """The six fields without a header."""
    maf.select("chrom", "pos", "id", "ref", "alt", "sample").write.mode("overwrite").option("sep", "\t").option("header", False).csv(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_json(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").json(path)


def read_results(spark: SparkSession, root: str) -> DataFrame:
    """All results below ``root`` by their ``study=/cohort=/bmr=`` folders, which filters prune."""
    return spark.read.option("basePath", root).parquet(root)


def read_runs(spark: SparkSession, pattern: str) -> DataFrame:
    """Results of many runs in one read; ``run`` is the number in ``R<run>`` of a file's folder."""
    return spark.read.option("header", True).csv(pattern).withColumn("run", F.regexp_extract(F.input_file_name(), r"/R(\d+)/", 1).cast("int"))


def read_simulation(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Simulated counts and the parameters they were drawn with."""
    return spark.read.parquet(f"{folder}/counts"), spark.read.option("multiLine", True).json(f"{folder}/params")


def write_simulation(counts: DataFrame, params: DataFrame, folder: str) -> None:
    counts.write.mode("overwrite").parquet(f"{folder}/counts")
    write_json(params, f"{folder}/params")


def write_truth(spark: SparkSession, truth: Mapping[str, object], folder: str) -> None:
    """What was planted in a simulated matrix, as one JSON object."""
    spark.createDataFrame([(json.dumps(truth),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/truth")


def read_truths(spark: SparkSession, pattern: str) -> DataFrame:
    """``run, direction, a, b, num_samples`` of the pairs planted in many runs; ``run`` is the number in ``R<run>`` of the path."""
    raw = spark.read.text(pattern, wholetext=True).withColumn("run", F.regexp_extract(F.input_file_name(), r"/R(\d+)/", 1).cast("int"))
    held = raw.select("run", F.from_json("value", "`ME Pairs` array<array<string>>, `CO Pairs` array<array<string>>, num_samples long").alias("t"))
    both = F.array(*[F.struct(F.lit(d).alias("direction"), F.col("t").getField(f"{d} Pairs").alias("pairs")) for d in ("ME", "CO")])
    each = held.select("run", F.col("t.num_samples").alias("num_samples"), F.inline(both)).select("run", "num_samples", "direction", F.explode("pairs").alias("p"))
    return each.select("run", "direction", F.col("p")[0].alias("a"), F.col("p")[1].alias("b"), "num_samples")


def read_matrix_counts(spark: SparkSession, folder: str) -> DataFrame:
    """``sample, feature, c`` of a simulated matrix."""
    return spark.read.parquet(f"{folder}/counts")
