"""Readers and writers, and the command line."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentmesh import api, cli
from latentmesh.operators import counts
from latentmesh.sources import files


def put(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_maf(spark, tmp_path):
    head = "Hugo\t" + "\t".join(files.MAF_COLUMNS)
    path = put(tmp_path, "a.maf", f"#version 2.4\n{head}\nTP53\t17\t7577120\t7157\tC\tT\tP-1\n")
    row = files.read_maf(spark, path).first()
    assert (row.chrom, row.pos, row.id, row.ref, row.alt, row["sample"]) == ("17", 7577120, 7157, "C", "T", "P-1")
    with pytest.raises(ValueError, match="missing required columns"):
        files.read_maf(spark, put(tmp_path, "b.maf", "x\ty\n1\t2\n"))


def test_counts_round_trip(spark, tmp_path):
    path = put(tmp_path, "c.csv", "sample,A_M,B_N\ns1,1,0\ns2,0,0\ns3,2,3\n")
    long, samples, order = files.read_counts(spark, path)
    assert sorted(map(tuple, long.collect())) == [("s1", "A_M", 1), ("s3", "A_M", 2), ("s3", "B_N", 3)]
    assert samples.count() == 3 and [r.feature for r in order.orderBy("ord").collect()] == ["A_M", "B_N"]
    files.write_csv(counts.wide(long, ["A_M", "B_N"]), str(tmp_path / "out"))
    again, _, _ = files.read_counts(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, long.collect()))


def test_pmfs(spark, tmp_path):
    path = put(tmp_path, "p.csv", "gene,0,1,2\nA_M,0.5,0.5,\nB_M,2,1,1\n")
    assert {r.feature: r.pmf for r in files.read_pmfs(spark, path).collect()} == {"A_M": [0.5, 0.5], "B_M": [0.5, 0.25, 0.25]}
    with pytest.raises(Exception, match="no positive probability"):
        files.read_pmfs(spark, put(tmp_path, "q.csv", "gene,0\nA_M,0\n")).collect()


def test_pmf_lines_and_selection(spark, tmp_path):
    path = put(tmp_path, "pofmigivens.txt", "skip\nTP53_x\t0.9\t0.1\nskip\nAB_C_x\t1.0\n")
    assert {r.feature: r.pmf for r in files.read_pmf_lines(spark, path, "_M").collect()} == {"TP53_M": [0.9, 0.1], "AB_C_M": [1.0]}
    text = "title\ngene\tphi_m_pos_or_p(m=0|s)\tp_phi_m_pos\tphi_k_pos_or_p(k=0|s)\tp_phi_k_pos\nTP53\t1.5\t0.01\t2.5\t0.02\n"
    got = files.read_selection(spark, put(tmp_path, "q.txt", text))
    assert sorted(map(tuple, got.collect())) == [("TP53_M", 1.5, 0.01), ("TP53_N", 2.5, 0.02)]
    assert files.read_selection(spark, str(tmp_path / "none")) is None


def test_sets_and_tables(spark, tmp_path):
    put(tmp_path, "pass/BRCA.txt", "A_M\nB_M\n")
    put(tmp_path, "pass/README.md", "no\n")
    assert sorted(map(tuple, files.read_passengers(spark, str(tmp_path / "pass")).collect())) == [("BRCA", "A_M"), ("BRCA", "B_M")]
    drivers = files.read_drivers(spark, put(tmp_path, "d.tsv", "Hugo Symbol\tx\nTP53\t1\n"))
    assert sorted(r.feature for r in drivers.collect()) == ["TP53_M", "TP53_N"]
    clinical = files.read_clinical(spark, put(tmp_path, "cl.txt", "#c\n#d\nSAMPLE_ID\tCANCER_TYPE\nP-1\tLung, small-cell\n"), "SAMPLE_ID", "CANCER_TYPE")
    assert clinical.select(counts.slug(F.col("type"))).first()[0] == "Lung_small_cell"
    with pytest.raises(ValueError, match="missing required columns"):
        files.read_dig(spark, put(tmp_path, "dig.tsv", "GENE\tALPHA\nG\t1\n"))
    rates = files.read_patient_rates(spark, put(tmp_path, "r.txt", "name\tn\tN\na\t10\t100\nb\t30\t100\n"))
    assert {r["sample"]: r.factor for r in rates.collect()} == pytest.approx({"a": 0.5, "b": 1.5})


def test_rate_cube(spark, tmp_path):
    cube = np.arange(12, dtype=np.float32).reshape(2, 3, 2)
    files.write_rate_cube(str(tmp_path), ["A", "B"], ["p", "q", "r"], cube)
    got = {(r.feature, r["sample"]): r["lambda"] for r in files.read_rate_cube(spark, str(tmp_path)).collect()}
    assert got["A_M", "p"] == cube[0, 0, 0] and got["B_N", "r"] == cube[1, 2, 1] and len(got) == 12


def test_partitioned_results_are_pruned(spark, tmp_path):
    t = spark.createDataFrame([("t", "BRCA", "x", 1), ("t", "LAML", "x", 2)], "study string, cohort string, bmr string, v int")
    files.write_table(t, str(tmp_path / "r"), "study", "cohort", "bmr")
    got = files.read_results(spark, str(tmp_path / "r")).where("cohort = 'LAML'")
    assert got.first().v == 2
    assert "PartitionFilters: [isnotnull(cohort" in got._jdf.queryExecution().toString()


def test_missing_file(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        api.load_cohort(spark, str(tmp_path / "no.csv"), str(tmp_path / "no2.csv"))


def test_verbs(spark, tmp_path):
    rows = "\n".join(f"s{i},{a},{b},{c}" for i, (a, b, c) in enumerate(zip([1, 0, 1, 0, 2, 1, 0, 1], [0, 1, 0, 1, 0, 0, 1, 0], [1, 1, 0, 0, 1, 0, 0, 1])))
    c = put(tmp_path, "c.csv", f"sample,TP53_M,KRAS_M,EGFR_M\n{rows}\n")
    p = put(tmp_path, "p.csv", "gene,0,1,2,3\n" + "\n".join(f"{g},0.7,0.2,0.08,0.02" for g in ("TP53_M", "KRAS_M", "EGFR_M")) + "\n")
    out = str(tmp_path / "out")
    cli.main(["identify", "--counts", c, "--pmfs", p, "--out", out, "-k", "3"])
    cli.main(["compare", "--counts", c, "--out", out, "-k", "3"])
    named = spark.read.option("header", True).csv(f"{out}/pairwise_interaction_results")
    assert named.columns == ["Gene A", "Gene B", "Tau_00", "Tau_10", "Tau_01", "Tau_11", "_00_", "_10_", "_01_", "_11_", "Tau_1X", "Tau_X1", "Rho", "Log Odds Ratio", "Likelihood Ratio", "Wald Statistic"]
    x = named.where("`Gene B` = 'EGFR_M'").first()
    assert (x["_00_"], x["_10_"], x["_01_"], x["_11_"]) == ("3", "1", "2", "2")
    cli.main(["merge", "--pairs", f"{out}/pairwise_interaction_results", "--comparison", f"{out}/comparison_interaction_results", "--out", out])
    assert spark.read.option("header", True).csv(f"{out}/complete_pairwise_interaction_results").count() == 3
    cli.main(["simulate", "create", "pair", "--out", str(tmp_path / "sim"), "--samples", "50", "--simulations", "2"])
    drawn, params = files.read_simulation(spark, str(tmp_path / "sim"))
    assert drawn.count() == 100 and params.first().samples == 50
    cli.main(["simulate", "evaluate", "pair", "--out", str(tmp_path / "sim"), "--samples", "50"])
    assert spark.read.json(str(tmp_path / "sim/evaluation")).count() == 4
    m = put(tmp_path, "m.tsv", "gene\tsample\teffect\nTP53\ta\tmissense\nTP53\tb\tnonsense\nTP53\tb\tsilent\n")
    cli.main(["generate", "--mutations", m, "--out", str(tmp_path / "gen")])
    assert files.read_pmfs(spark, str(tmp_path / "gen/bmr_pmfs")).count() == 2


def test_a_matrix_is_simulated(spark, tmp_path):
    names = [f"G{k}_M" for k in range(12)]
    c = put(tmp_path, "c.csv", "sample," + ",".join(names) + "\n" + "\n".join(f"s{i}," + ",".join(str(int((i + k) % (k + 2) == 0)) for k in range(12)) for i in range(40)) + "\n")
    p = put(tmp_path, "p.csv", "gene,0,1\n" + "\n".join(f"{g},0.9,0.1" for g in names) + "\n")
    d = put(tmp_path, "d.tsv", "Hugo\tx\n" + "\n".join(f"G{k}\t1" for k in (0, 2, 4, 6, 8)) + "\n")
    out = str(tmp_path / "R7")
    cli.main(["simulate", "create", "matrix", "--out", out, "--counts", c, "--pmfs", p, "--drivers", d, "--me-pairs", "1", "--co-pairs", "1", "--passengers", "3", "--samples", "60", "--tau-low", "0.2", "--tau-high", "0.3"])
    drawn = files.read_matrix_counts(spark, out)
    planted = files.read_truths(spark, f"{tmp_path}/R*/truth").collect()
    assert sorted((r.run, r.direction, r.num_samples) for r in planted) == [(7, "CO", 60), (7, "ME", 60)]
    drivers = {x for r in planted for x in (r.a, r.b)}
    assert drivers == {"G0_M", "G2_M", "G4_M", "G6_M"}  # those with the most events
    passengers = {r.feature for r in drawn.select("feature").distinct().collect()} - drivers
    assert passengers <= {"G1_M", "G3_M", "G5_M"}
    with pytest.raises(SystemExit):
        cli.main(["simulate", "create", "matrix", "--out", out])
    with pytest.raises(ValueError, match="drivers"):
        cli.main(["simulate", "create", "matrix", "--out", out, "--counts", c, "--pmfs", p, "--drivers", d, "--me-pairs", "9"])


def test_a_simulated_matrix_is_evaluated(spark, tmp_path):
    names = "abcd"
    for run in (1, 2):
        folder = tmp_path / f"R{run}"
        files.write_truth(spark, {"ME Pairs": [["a", "b"]], "CO Pairs": [["c", "d"]], "Likely Passengers": [], "num_samples": 1000}, str(folder))
        rows = []
        for i, x in enumerate(names):
            for y in names[i + 1 :]:
                true = (x, y) == ("a", "b")
                rho = -0.9 if true else -0.1 * (1 + names.index(y))
                fisher = 0.5 if true and run == 2 else 1e-9 if true else 0.01 * (1 + names.index(x))
                rows.append((x, y, 0.3, 0.3, rho, 5.0 * -rho, 1.0, None, fisher))
        spark.createDataFrame(rows, "`Gene A` string, `Gene B` string, Tau_1X double, Tau_X1 double, Rho double, `Likelihood Ratio` double, `Log Odds Ratio` double, `Wald Statistic` double, fisher_me_p double").write.option("header", True).csv(f"{folder}/complete_pairwise_interaction_results")
    out = str(tmp_path / "out")
    cli.main(["simulate", "evaluate", "matrix", "--results", str(tmp_path), "--direction", "ME", "--out", out])
    read = lambda name: spark.read.option("header", True).option("inferSchema", True).csv(f"{out}/{name}")
    ap = {r.method: r.average_precision for r in read("average_precision").collect()}
    assert ap["rho"] == ap["lrt"] == 1 and ap["fisher"] == pytest.approx(0.5 + 0.5 * 2 / 12) and ap["lor"] == pytest.approx(2 / 12)
    hits = {(r.method, r.rk): r.hits for r in read("hits").collect()}
    assert hits["rho", 1] == 1 and hits["fisher", 1] == 0.5 and hits["fisher", 6] == 1
    mean = {round(r.recall, 4): r["mean"] for r in read("mean_pr_curve").where("method = 'rho'").collect()}
    assert len(mean) == 10_001 and mean[1.0] == 1
    assert read("pr_curve").where("method = 'rho' and recall = 1 and precision = 1").count() == 1
