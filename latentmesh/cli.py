"""``python -m latentmesh.cli generate|identify|compare|merge|simulate``."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import api
from .operators import evaluation, simulation
from .operators.counts import count_features, totals, wide
from .sources import files

VERBOSE = 15
logging.addLevelName(VERBOSE, "VERBOSE")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="latentmesh")
    p.add_argument("-v", "--verbose", action="store_true")
    verbs = p.add_subparsers(dest="verb", required=True)
    g = verbs.add_parser("generate", help="counts and a background from annotated mutations")
    g.add_argument("--mutations", required=True)
    g.add_argument("--out", required=True)
    g.add_argument("--background", default="poisson", choices=["poisson", "negative_binomial"])
    g.add_argument("--dig-results")
    g.add_argument("--dig-samples", type=int)
    i = verbs.add_parser("identify", help="rates of features and pairs")
    c = verbs.add_parser("compare", help="other tests of the pairs")
    for v in (i, c):
        v.add_argument("--counts", required=True)
        v.add_argument("--out", required=True)
        v.add_argument("-k", "--top-k", type=int, default=api.TOP_K)
    i.add_argument("--pmfs", required=True)
    i.add_argument("--selection")
    c.add_argument("--gene-level", action="store_true")
    m = verbs.add_parser("merge", help="join both tables of pairs")
    for name in ("--pairs", "--comparison", "--out"):
        m.add_argument(name, required=True)
    s = verbs.add_parser("simulate", help="draw counts of known rates")
    s.add_argument("action", choices=["create", "evaluate"])
    s.add_argument("kind", choices=["single", "pair", "matrix"])
    s.add_argument("--out", required=True)
    s.add_argument("--samples", type=int, default=1000)
    s.add_argument("--simulations", type=int, default=2500)
    s.add_argument("--pi", type=float, default=0.1)
    s.add_argument("--tau", type=float, nargs=4, default=[0.7, 0.1, 0.1, 0.1])
    s.add_argument("--driver-proportion", type=float, default=1.0)
    s.add_argument("--length", type=int, default=10_000)
    s.add_argument("--rate", type=float, default=1e-6)
    s.add_argument("--counts", help="matrix: the counts whose features are simulated")
    s.add_argument("--pmfs", help="matrix: their backgrounds")
    s.add_argument("--drivers", help="matrix: a table of driver genes")
    s.add_argument("--me-pairs", type=int, default=25)
    s.add_argument("--co-pairs", type=int, default=25)
    s.add_argument("--tau-low", type=float, default=0.05)
    s.add_argument("--tau-high", type=float, default=0.15)
    s.add_argument("--passengers", type=int, default=100)
    s.add_argument("--results", help="matrix: a folder of runs R1, R2, ... with the tables of pairs and what was planted")
    s.add_argument("--direction", choices=["ME", "CO"], default="ME")
    s.add_argument("--seed", type=int, default=0)
    return p


def simulate_matrix(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Draws a matrix of counts with planted pairs and writes it; what was planted."""
    long, _, _ = files.read_counts(spark, a.counts)
    pmfs = files.read_pmfs(spark, a.pmfs)
    known = totals(long).join(pmfs.select("feature"), "feature", "left_semi")
    drivers, passengers = simulation.chosen_features(known, files.read_drivers(spark, a.drivers, files.first_column(spark, a.drivers)), 2 * (a.me_pairs + a.co_pairs), a.passengers)
    drawn, planted = simulation.matrix(pmfs, drivers, passengers, a.me_pairs, a.co_pairs, a.samples, a.tau_low, a.tau_high, a.driver_proportion, a.seed)
    drawn.write.mode("overwrite").parquet(f"{a.out}/counts")
    return planted


def main(argv: Sequence[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(level=VERBOSE if a.verbose else logging.INFO)
    spark = SparkSession.builder.getOrCreate()
    if a.verb == "generate":
        if a.background == "negative_binomial" and not (a.dig_results and a.dig_samples):
            raise SystemExit("--dig-results and --dig-samples are needed")
        found = count_features(files.read_kept_mutations(spark, a.mutations))
        options = {"dig": files.read_dig(spark, a.dig_results), "n_samples": a.dig_samples} if a.background == "negative_binomial" else {}
        made = api.estimate_background(found, a.background, **options)
        names = [r[0] for r in found.select("feature").distinct().orderBy("feature").collect()]  # the columns of a wide file
        files.write_csv(wide(found, names), f"{a.out}/count_matrix", one_file=False)
        pmfs = made.pmfs
        most = pmfs.agg(F.max(F.size("pmf"))).first()[0] or 1
        files.write_csv(pmfs.select(F.col("feature").alias("gene"), *[F.get("pmf", F.lit(k)).alias(str(k)) for k in range(most)]), f"{a.out}/bmr_pmfs")
    elif a.verb == "identify":
        api.identify_interactions(spark, a.counts, a.pmfs, a.out, a.top_k, a.selection)
    elif a.verb == "compare":
        api.compare_methods(spark, a.counts, a.out, a.top_k, a.gene_level)
    elif a.verb == "merge":
        read = lambda p: spark.read.option("header", True).csv(p)
        rename = lambda d: d.withColumnsRenamed({"Gene A": "a", "Gene B": "b"})
        api.merge_results(rename(read(a.pairs)), rename(read(a.comparison)), a.out)
    elif a.kind == "matrix":
        if a.action == "create":
            if not (a.counts and a.pmfs and a.drivers):
                raise SystemExit("--counts, --pmfs and --drivers are needed")
            planted = simulate_matrix(spark, a)
            files.write_truth(spark, planted, a.out)
        else:
            if not a.results:
                raise SystemExit("--results is needed")
            api.evaluate_matrix(spark, a.results, a.direction, a.out)
    else:
        pmf = simulation.binomial_pmf(a.length, a.rate)
        if a.action == "evaluate":
            drawn, _ = files.read_simulation(spark, a.out)
            if a.kind == "single":
                summary = evaluation.error_summary(evaluation.simulated_features(drawn, pmf, a.samples), F.lit(a.pi))
            else:
                summary = evaluation.joint_error(evaluation.simulated_pairs(drawn, pmf, pmf), tuple(a.tau))
            files.write_json(summary, f"{a.out}/evaluation")
            return
        if a.kind == "single":
            drawn, params = simulation.single(spark, pmf, a.pi, a.samples, a.simulations, a.seed), {"pi": a.pi}
        else:
            drawn, params = simulation.pair(spark, pmf, pmf, tuple(a.tau), a.samples, a.simulations, a.driver_proportion, a.seed), {"tau": a.tau, "driver_proportion": a.driver_proportion}
        files.write_simulation(drawn, spark.createDataFrame([params | {"samples": a.samples, "simulations": a.simulations, "seed": a.seed}]), a.out)


if __name__ == "__main__":
    main()
