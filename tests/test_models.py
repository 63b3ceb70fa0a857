"""Values that are known in closed form or from a per-sample evaluation of the formulas."""

from __future__ import annotations

import math
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from latentmesh.functions import em, special
from latentmesh.operators import background, baselines, calls, counts, evaluation, fit, networks, reports, simulation
from latentmesh.plans.identify import Cohort, compare, identify, pairs

MATRIX = {"TP53_M": [1, 0, 1, 0, 2, 1, 0, 1], "KRAS_M": [0, 1, 0, 1, 0, 0, 1, 0], "EGFR_M": [1, 1, 0, 0, 1, 0, 0, 1]}
PMF = [0.7, 0.2, 0.08, 0.02]


@pytest.fixture(scope="module")
def cohort(spark):
    rows = [(f"s{i}", f, c) for f, v in MATRIX.items() for i, c in enumerate(v) if c]
    samples = spark.createDataFrame([(f"s{i}",) for i in range(8)], "sample string")
    return Cohort(spark.createDataFrame(rows, "sample string, feature string, c long"), spark.createDataFrame([(f, PMF) for f in MATRIX], "feature string, pmf array<double>"), samples)


@pytest.fixture(scope="module")
def found(cohort):
    r = identify(cohort, 3)
    return {x.feature: x for x in r.features.collect()}, {(x.a, x.b): x for x in r.pairs.collect()}


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_features(found):
    want = {"TP53_M": (0.46817297634402877, -0.12748045776491632, 3.4747024482548454), "EGFR_M": (0.31336465674758546, -0.7844358055095542, 1.6206100725946815), "KRAS_M": (0.14073098048477206, -1.8092319223859084, 0.29201178301676656)}
    for name, (pi, lor, lrt) in want.items():
        x = found[0][name]
        assert (x.pi, x.lor, x.lrt) == pytest.approx((pi, lor, lrt), rel=1e-9)
        assert x.expected == pytest.approx(0.42)


def test_pairs(found):
    x = found[1]["TP53_M", "EGFR_M"]
    assert (x.t00, x.t01, x.t10, x.t11) == pytest.approx((0.472262793, 0.061527181, 0.219284860, 0.246925166), abs=1e-8)
    assert (x.rho, x.lrt, x.lor, x.wald) == pytest.approx((0.447577753668437, 0.45600037028186335, -2.1567702587172035, -0.41522034524805423), rel=1e-8)
    assert (x.n11, x.n10, x.n01, x.n00) == (3, 2, 1, 2)
    x = found[1]["TP53_M", "KRAS_M"]
    assert x.t11 == 0 and x.lor is None and x.wald is None
    assert (x.rho, x.lrt) == pytest.approx((-0.9987693335004178, 6.544180572390566), rel=1e-8)
    assert (x.n11, x.n10, x.n01, x.n00) == (0, 5, 3, 0)
    x = found[1]["EGFR_M", "KRAS_M"]
    assert (x.rho, x.lrt, x.lor, x.wald) == pytest.approx((-0.28931882220819305, 0.33387786602904157, 6.903243391791666, 0.06619550926663614), rel=1e-8)


def test_fisher_and_q_values(spark, found):
    rows = [(x.a, x.b, x.n11, x.n10, x.n01, x.n00, x.lrt, x.rho) for x in found[1].values()]
    table = spark.createDataFrame(rows, "a string, b string, n11 long, n10 long, n01 long, n00 long, lrt double, rho double")
    got = {(r.a[:4], r.b[:4]): (r.me_p, r.co_p, r.me_q, r.co_q) for r in calls.fisher(table).collect()}
    assert got["TP53", "EGFR"] == pytest.approx((0.928571428571, 0.5, 0.928571428571, 1))
    assert got["TP53", "KRAS"] == pytest.approx((1 / 56, 1, 0.053571428571, 1))
    assert got["EGFR", "KRAS"] == pytest.approx((0.5, 0.928571428571, 0.75, 1))
    p = {(r.a[:4], r.b[:4]): r.p for r in calls.pair_calls(table).collect()}
    assert [p["TP53", "EGFR"], p["TP53", "KRAS"], p["EGFR", "KRAS"]] == pytest.approx([0.499499161855, 0.010522778320, 0.563384532895])


def test_restart_constants():
    one_, two = special.restarts(10, 0)
    assert one_[:3] == [0.5, 0.6342224535750253, 0.2743909794885929]
    assert two[1] == pytest.approx([0.394941, 0.592236, 0.011505, 0.001318], abs=1e-6)


def test_lookups(spark):
    pmf = F.array(F.lit(0.5), F.lit(None).cast("double"), F.lit(0.5))
    c = lambda k: F.lit(k)
    row = one(spark, *[f(pmf, c(k)) for f in (special.as_count, special.as_shifted, special.in_support) for k in range(5)])
    assert list(row) == [0.5, 1e-100, 0.5, 1e-100, 1e-100, 0.0, 0.5, 0.0, 0.5, 1e-100, 0.5, 0.0, 0.5, 0.0, 0.0]


def test_analytic_rates():
    n, here, below, ok = np.array([[1.0, 1.0]]), np.array([[0.8, 0.2]]), np.array([[0.0, 0.8]]), np.array([[True, True]])
    assert em.fit_pi(n, here, below, ok, [0.5])[0][0] > 0
    a, b = np.array([[0.63 / 0.7, 0.5]]), np.array([[0.0, 0.0]])
    ll = (np.log(a * 0.7 + b * 0.3)).sum()
    assert ll == pytest.approx(math.log(0.63) + math.log(0.35))
    assert em.fit_pi(n, here, below, np.array([[False, False]]), [0.5])[2][0]


def test_pair_without_support_falls_back(spark):
    rows = [(f"s{i}", f, c) for f, v in {"A_M": [9, 9, 1, 0], "B_M": [0, 1, 1, 9]}.items() for i, c in enumerate(v) if c]
    c = Cohort(spark.createDataFrame(rows, "sample string, feature string, c long"), spark.createDataFrame([("A_M", PMF), ("B_M", PMF)], "feature string, pmf array<double>"))
    top = counts.top(counts.totals(c.counts), 2)
    rates = spark.createDataFrame([("A_M", 0.25), ("B_M", 0.5)], "feature string, pi double")
    x = pairs(c, top, 4, rates)[0].first()
    assert x.status == "independent" and (x.t00, x.t11) == pytest.approx((0.375, 0.125))


def test_negative_binomial(spark):
    dig = spark.createDataFrame([("SHORT", 50.0, 0.3, 0.04, 0.002), ("LONG", 300.0, 0.3, 0.04, 0.002), ("BAD", -1.0, 0.3, 0.04, 0.002), ("ZERO", 50.0, 0.3, 0.0, float("nan"))], "gene string, alpha double, theta double, pi_mis double, pi_nons double")
    got = {r.feature: r.pmf for r in background.negative_binomial(dig, 36, 10).collect()}
    assert got["SHORT_M"][:3] == pytest.approx([0.983569026043, 0.016198435870, 0.000229424487])
    assert got["LONG_N"][:3] == pytest.approx([0.995013971116, 0.004972086604, 1.39135e-05], rel=1e-4)
    assert all(len(p) == 11 for p in got.values())
    assert "BAD_M" not in got and "ZERO_N" not in got and got["ZERO_M"] == [1.0] + [0.0] * 10
    reach = {r.feature: len(r.pmf) for r in background.negative_binomial(dig.where("gene = 'LONG'"), 36).collect()}
    assert set(reach.values()) == {6}


def test_special_functions(spark):
    n = [0, 1, 5, 31, 32, 33, 1000, 10**7]
    got = one(spark, *[special.log_factorial(F.lit(k).cast("long")) for k in n])
    assert list(got) == pytest.approx([math.lgamma(k + 1) for k in n], rel=1e-12)
    assert special.epsilon(50) == pytest.approx(0.160362891042788) and special.epsilon(1000) == pytest.approx(0.009459204693115)
    tail = one(spark, special.chi2_tail(F.lit(3.841458820694124)), special.chi2_tail(F.lit(-1.0)), special.chi2_tail(F.lit(None).cast("double")))
    assert tail[0] == pytest.approx(0.05) and tail[1] == 1 and tail[2] is None
    assert sum(one(spark, special.poisson_pmf(F.lit(0.7), 8))[0]) == pytest.approx(1)


def test_q_values_leave_nulls_out(spark):
    t = spark.createDataFrame([("a", 0.01), ("b", None), ("c", 0.04), ("d", 0.04), ("e", 0.9)], "k string, p double")
    got = {r.k: r.q for r in calls.benjamini_hochberg(t, "p", "q", ties=["k"]).collect()}
    assert got["b"] is None and [got[k] for k in "acde"] == pytest.approx([0.04, 0.16 / 3, 0.16 / 3, 0.9])


def test_zero_k_raises(cohort):
    with pytest.raises(ValueError, match="positive"):
        identify(cohort, 0)


def test_resume_fits_only_the_rest(spark, cohort):
    cells = fit.with_pmfs(fit.histogram(cohort.counts, F.lit(8)), cohort.pmfs)
    before = spark.createDataFrame([("TP53_M", 0.123), ("GONE_M", 0.5)], "feature string, pi double")
    got = {r.feature: (r.pi, r.status) for r in fit.resumed(cells, before).collect()}
    assert got["TP53_M"] == (0.123, "resumed") and got["KRAS_M"][1] == "ok" and "GONE_M" not in got


def test_compare_weighs_samples_by_all_features(cohort, spark):
    more = [(f"s{i}", f"X{k}_M", 1) for i in (0, 4, 8, 9) for k in range(12)]  # most of them beyond the top
    wide = Cohort(cohort.counts.unionByName(spark.createDataFrame(more, cohort.counts.schema)))
    top = counts.top(counts.totals(wide.counts), 3)
    tables = fit.contingency(fit.joint_counts(wide.counts, top), wide.counts, top, F.lit(10))
    per = {}
    for r in wide.counts.collect():
        per[r["sample"]] = per.get(r["sample"], 0) + 1
    sums = spark.createDataFrame([(s, list(per.values()).count(s)) for s in set(per.values())], "sample_sum long, n long")
    want = {(r.a, r.b): (r.me_p, r.co_p) for r in baselines.weighted_test(tables, sums).collect()}
    got, wrong = compare(wide, 3)
    assert not wrong and {(r.a, r.b): (r.weighted_me_p, r.weighted_co_p) for r in got.collect()} == want


def test_compare_isolates_failures(cohort, spark):
    table, wrong = compare(cohort, 3)
    assert not wrong and table.count() == 3
    with pytest.raises(RuntimeError, match="every method"):
        baselines.compare({"x": lambda: spark.sql("select raise_error('no') as a, 'b' as b")})
    good, wrong = baselines.compare({"x": lambda: spark.sql("select raise_error('no') as a, 'b' as b"), "y": lambda: spark.sql("select 'a' as a, 'b' as b, 1 as v")})
    assert list(wrong) == ["x"] and good.first().y_v == 1


def test_poisson_binomial():
    low, high = baselines.poisson_binomial(np.array([0.2, 0.5]), np.array([3, 2]), 2)
    p = np.array([1.0])
    for q in (0.2, 0.2, 0.2, 0.5, 0.5):
        p = np.convolve(p, [1 - q, q])
    assert low == pytest.approx(p[:3].sum()) and high == pytest.approx(p[2:].sum())
    chances, many = np.array([0.01, 0.2]), np.array([3000, 500])
    p = np.array([1.0])
    for q, k in zip(chances, many):
        for _ in range(k):
            p = np.convolve(p, [1 - q, q])
    for x in (0, 5, 100, 130, 160, 300, 600):  # tails of 1e-267 among them
        assert baselines.poisson_binomial(chances, many, x) == pytest.approx((p[: x + 1].sum(), p[x:].sum()), rel=1e-8)
    assert baselines.poisson_binomial(chances, many, 3501) == (1.0, 0.0) and baselines.poisson_binomial(chances, many, -1) == (0.0, 1.0)
    assert baselines.poisson_binomial(np.array([0.3]), np.array([4]), 4)[1] == pytest.approx(0.3**4)


def test_max_entropy_margins():
    rows, many, columns, times = np.array([1.0, 3, 5]), np.array([1, 2, 1]), np.array([2.0, 3]), np.array([3, 2])
    a, b = background.max_entropy(rows, many, columns, times)
    p = 1 / (1 + np.exp(a[:, None] + b[None]))
    assert (p * times).sum(1) == pytest.approx(rows, abs=1e-4) and (p * many[:, None]).sum(0) == pytest.approx(columns, abs=1e-4)


def test_logit_equals_the_table():
    y, x, w = np.array([1.0, 1, 0, 0]), np.array([[1.0], [0], [1], [0]]), np.array([30.0, 20, 10, 40])
    z = math.log(30 * 40 / (20 * 10)) / math.sqrt(1 / 30 + 1 / 20 + 1 / 10 + 1 / 40)
    assert baselines.logit_p(y, x, w) == pytest.approx(math.erfc(z / math.sqrt(2)), rel=1e-6)


def test_exclusivity_ratio():
    cells = np.array([(0, 40, 40, 20), (25, 25, 25, 25), (3, 40, 30, 500), (0, 0, 7, 9)])
    s = baselines.exclusivity_ratio(*cells.T)
    assert s[0] > 20 and s[1] == pytest.approx(0, abs=1e-6)
    for k, (n11, n10, n01, n00) in enumerate(cells):  # against a grid of all shares and rates
        n, best = n11 + n10 + n01 + n00, -np.inf
        g, a, b = np.meshgrid(*[np.linspace(0, 0.999, 80)] * 3)
        p = [g * (a + b) / 2 + (1 - g) * a * b, g * (1 - b) / 2 + (1 - g) * a * (1 - b), g * (1 - a) / 2 + (1 - g) * (1 - a) * b, (1 - g) * (1 - a) * (1 - b)]
        best = sum(c * np.log(np.maximum(q, 1e-300)) for c, q in zip((n11, n10, n01, n00), p)).max()
        x, y = (n11 + n10) / n, (n11 + n01) / n
        null = sum(c * math.log(max(q, 1e-300)) for c, q in zip((n11, n10, n01, n00), (x * y, x * (1 - y), (1 - x) * y, (1 - x) * (1 - y))) if c)
        assert s[k] >= 2 * (best - null) - 1e-3


def test_average_precision(spark):
    t = spark.createDataFrame([("m", 3.0, 1), ("m", 2.0, 0), ("m", 2.0, 1), ("m", 1.0, 0)], "method string, score double, label int")
    assert evaluation.average_precision(t).first().average_precision == pytest.approx(0.5 + 0.5 * 2 / 3)


def test_labels_take_both_orientations(spark):
    p = spark.createDataFrame([("a", "b"), ("c", "d")], "a string, b string")
    t = spark.createDataFrame([("b", "a")], "a string, b string")
    assert [r.label for r in evaluation.labels(p, t).orderBy("a").collect()] == [1, 0]


def test_passenger_curve_goes_on(spark):
    ranked = spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "a string, b string, rk int")
    curve = calls.passenger_curve(ranked, spark.createDataFrame([("b",)], "feature string"), 4)
    assert [r.share for r in curve.orderBy("rk").collect()] == [0.5, 0.25, 0.25, 0.25]
    assert calls.curve_area(curve, 4).first().auc == pytest.approx((1.25 - 0.375) / 4)


def test_simulations_recover_the_rate(spark):
    drawn = simulation.single(spark, PMF, 0.3, 4000, 1, seed=5)
    cells = fit.with_pmfs(fit.histogram(drawn.where("c > 0").select("sample", F.lit("f").alias("feature"), "c"), F.lit(4000)), spark.createDataFrame([("f", PMF)], "feature string, pmf array<double>"))
    assert fit.fit_rates(cells).first().pi == pytest.approx(0.3, abs=0.05)
    assert drawn.collect() == simulation.single(spark, PMF, 0.3, 4000, 1, seed=5).repartition(3).orderBy("sim", "sample").collect()


def test_planted_pairs_are_exclusive_and_together(spark):
    names = [f"G{i}_M" for i in range(8)]
    pmfs = spark.createDataFrame([(f, [0.97, 0.03]) for f in names], "feature string, pmf array<double>")
    drawn, truth = simulation.matrix(pmfs, names[:4], names[4:], 1, 1, 3000, 0.2, 0.3, seed=1)
    r = {frozenset((x.a, x.b)): x.rho for x in identify(Cohort(drawn, pmfs), 8, n_inits=2).pairs.collect()}
    assert r[frozenset(truth["ME Pairs"][0])] < -0.2 and r[frozenset(truth["CO Pairs"][0])] > 0.8


def test_consensus_and_edges(spark):
    ranked = spark.createDataFrame([("c", "x", "ME", "A_M", "B_N", 1), ("c", "x", "ME", "B_M", "A_M", 4), ("c", "y", "ME", "A_M", "B_M", 3)], "cohort string, bmr string, direction string, a string, b string, rk int").withColumns({"rho": F.lit(-0.5), "lrt": F.lit(2.0)})
    x = networks.consensus(ranked).first()
    assert (x.a, x.b, x.supported_by, x.n_bmr, x.best_rank) == ("A", "B", ["x", "y"], 2, 1) and x.per_bmr["x"].rk == 4
    me, co = spark.createDataFrame([("b", "a", 1)], "a string, b string, rk int"), spark.createDataFrame([("a", "b", 1), ("a", "c", 2)], "a string, b string, rk int")
    assert {tuple(r) for r in networks.edges(me, co).collect()} == {("a", "b", "ME"), ("a", "c", "CO")}


def test_providers(spark, cohort):
    assert background.available() == ["negative_binomial", "poisson", "table"]
    with pytest.raises(ValueError, match="nothing"):
        background.provider("nothing")
    made = background.provider("poisson")
    assert isinstance(made, background.Provider)
    assert made.estimate(cohort.counts).pmfs.count() == 3


def test_maximum_equals_a_fine_grid(cohort):
    cells = fit.with_pmfs(fit.histogram(cohort.counts, F.lit(8)), cohort.pmfs)
    grid = {}
    for r in evaluation.profile(cells, 2000, 0.999).collect():
        if r.feature not in grid or r.loglik > grid[r.feature][1]:
            grid[r.feature] = (r.pi, r.loglik)
    assert {r.feature: r.pi for r in fit.maximise_rates(cells).collect()} == pytest.approx({f: p for f, (p, _) in grid.items()}, abs=6e-4)


def test_text_tables(spark):
    assert [reports.number(x) for x in (0.5, 12.0, 0.0, 0.00123, -3e-7, None)] == ["0.5", "12", "0", "1.2\\times10^{-3}", "-3\\times10^{-7}", ""]
    text = reports.latex(spark.createDataFrame([("A_M", 0.25)], "a string, rho double"), {"a": "Gene A", "rho": "Rho"}, "Top & best", "tab:x")
    assert "A\\_M & $0.25$" in text and "Top \\& best" in text


def test_simulation_errors_are_small(spark):
    drawn = simulation.single(spark, PMF, 0.3, 800, 6)
    x = evaluation.error_summary(evaluation.simulated_features(drawn, PMF, 800), F.lit(0.3)).first()
    assert x.error < 0.06


def exact_tails(n11, n10, n01, n00):
    """Both tails by summing logarithms over every table with the margins."""
    a, b, n = n11 + n10, n11 + n01, n11 + n10 + n01 + n00
    lf = np.vectorize(lambda v: math.lgamma(v + 1))
    k = np.arange(max(0, a + b - n), min(a, b) + 1)
    log = lf(a) + lf(b) + lf(n - a) + lf(n - b) - lf(n) - lf(k) - lf(a - k) - lf(b - k) - lf(n - a - b + k)
    return float(np.exp(np.logaddexp.reduce(log[k <= n11]))), float(np.exp(np.logaddexp.reduce(log[k >= n11])))


def test_exact_tails_of_any_table(spark):
    tables = [(600, 0, 0, 600), (0, 800, 800, 0), (0, 0, 0, 9), (5, 0, 3, 0), (0, 0, 7, 2), (3, 4, 5, 6), (30, 400, 350, 20_000), (9000, 1000, 1200, 90_000), (200_000, 300_000, 300_000, 200_000), (0, 500, 400, 999_100), (100, 1000, 900, 998_000), (1, 0, 0, 0)]
    df = spark.createDataFrame([(f"{k}", "b", *t) for k, t in enumerate(tables)], "a string, b string, n11 long, n10 long, n01 long, n00 long")
    for r in calls.fisher(df).collect():
        want = exact_tails(*tables[int(r.a)])
        assert (r.me_p, r.co_p) == pytest.approx(want, rel=1e-6, abs=1e-300), tables[int(r.a)]


def test_chi2_tail_is_right_everywhere(spark):
    x = [0.0, 1e-9, 0.3, 1.0, 7.9, 8.0, 8.1, 30.0, 300.0, 1400.0, float("nan"), None]
    got = [r.p for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double").orderBy("i").select(special.chi2_tail(F.col("x")).alias("p")).collect()]
    assert got[:10] == pytest.approx([math.erfc(math.sqrt(v / 2)) for v in x[:10]], rel=1e-12) and got[10:] == [None, None]


def poisson(rate, kmax):
    p = np.array([math.exp(-rate) * rate**k / math.factorial(k) for k in range(kmax + 1)])
    return p / p.sum()


def test_backgrounds_of_samples_are_used(spark):
    """Rates and joint rates by classes of burdens against the same fits sample by sample."""
    rng = np.random.default_rng(4)
    n, names = 300, ["A_M", "B_M", "C_N"]
    scale = rng.integers(1, 5, n)
    m = np.stack([rng.poisson(0.15 * scale) + (rng.random(n) < 0.2) for _ in names], axis=1)
    m[:, 1] += m[:, 0] * (rng.random(n) < 0.5)
    long = spark.createDataFrame([(i, f, int(m[i, k])) for i in range(n) for k, f in enumerate(names) if m[i, k]], "sample long, feature string, c long")
    samples = spark.range(n).select(F.col("id").alias("sample"))
    burdens = counts.burden(long, samples)
    expected = spark.createDataFrame([(f, 0.3) for f in names], "feature string, expected double")
    kmax = background.largest(long)
    assert kmax == m.max()
    pmfs, classes = background.by_burden_class(expected, burdens, kmax), background.burden_classes(burdens)
    got = identify(Cohort(long, pmfs, samples, classes=classes), 3, n_inits=1)
    burden = m.sum(1)
    own = [[poisson(max(0.3 * b / burden.mean(), 1e-9), kmax) for b in burden] for _ in names]
    here = np.array([[own[k][i][m[i, k]] for i in range(n)] for k in range(3)])
    below = np.array([[own[k][i][m[i, k] - 1] if m[i, k] else 0 for i in range(n)] for k in range(3)])
    one_, two_ = np.ones((3, n)), [(0, 1), (0, 2), (1, 2)]
    pi = em.fit_pi(one_, here, below, np.ones((3, n), bool), [0.5])[0]
    rows = {r.feature: r for r in got.features.collect()}
    assert [rows[f].pi for f in names] == pytest.approx(pi, rel=1e-9)
    mean = np.mean([(np.arange(kmax + 1) * own[0][i]).sum() for i in range(n)])
    assert rows["A_M"].expected == pytest.approx(mean)
    side = lambda j: (np.stack([here[p[j]] for p in two_]), np.stack([below[p[j]] for p in two_]))
    tau = em.fit_tau(np.ones((3, n)), side(0), side(1), side(0), side(1), [[0.25] * 4])[0]
    want = {frozenset((names[a], names[b])): (t[0], t[1] + t[2], t[3]) for (a, b), t in zip(two_, tau)}
    for r in got.pairs.collect():
        assert (r.t00, r.t01 + r.t10, r.t11) == pytest.approx(want[frozenset((r.a, r.b))], rel=1e-8)
    with pytest.raises(ValueError, match="classes"):
        identify(Cohort(long, pmfs, samples), 3)


def test_given_rates_and_their_fallbacks(spark):
    samples = spark.createDataFrame([("s1",), ("s2",), ("s3",)], "sample string")
    rates = spark.createDataFrame([("A_M", "s1", 0.5), ("A_M", "s2", 1.5)], "feature string, sample string, lambda double")
    shared_ = spark.createDataFrame([("A_M", [1.0]), ("B_M", [0.9, 0.1])], "feature string, pmf array<double>")
    got = {(r.feature, r["class"]): r for r in background.by_rates(rates, samples, 6, shared_).collect()}
    assert len(got) == 6 and got["A_M", "s3"]["lambda"] == 1.0 and list(got["B_M", "s2"].pmf) == [0.9, 0.1]
    assert got["A_M", "s2"].pmf == pytest.approx(poisson(1.5, 6))
    large = background.by_rates(spark.createDataFrame([("A_M", "s1", 20.0)], rates.schema), samples, 60).first()
    assert sum(k * p for k, p in enumerate(large.pmf)) == pytest.approx(20, abs=1e-6)
    genes = spark.createDataFrame([("G", 1e-3, 4.0, 100.0, 10.0, 5.0)], "gene string, mutrate double, n_eff double, nmis double, nnon double, nspl double")
    found = {r.feature: r["lambda"] for r in background.exposure_rates(genes, spark.createDataFrame([("s1", 2.0)], "sample string, factor double"), 10).collect()}
    assert found == pytest.approx({"G_M": 100 / 10 * 1e-3 * 2, "G_N": 15 / 10 * 1e-3 * 2})


def test_equal_totals_go_by_the_order_of_the_file(spark):
    long = spark.createDataFrame([("s1", "B_M", 1), ("s1", "A_M", 1), ("s2", "C_M", 1)], "sample string, feature string, c long")
    order = spark.createDataFrame([("C_M", 0), ("B_M", 1), ("A_M", 2)], "feature string, ord int")
    assert [r.feature for r in Cohort(long, order=order).top(2).orderBy("rk").collect()] == ["C_M", "B_M"]
    assert [r.feature for r in Cohort(long).top(2).orderBy("rk").collect()] == ["A_M", "B_M"]


def test_method_constants():
    assert list(calls.ME_METHODS) == ["rho", "lrt", "lor", "wald", "overlap", "fisher", "ratio", "weighted"]
    assert list(calls.CO_METHODS) == ["rho", "lrt", "lor", "wald", "overlap", "fisher", "weighted"]
    cutoffs = {n: m.cutoff for n, m in (calls.ME_METHODS | calls.CO_METHODS).items() if m.cutoff is not None}
    assert cutoffs == {"overlap": 0.01, "fisher": 0.01, "ratio": 1e-3, "weighted": 0.01}
    up = {d: [n for n, m in calls.METHODS[d].items() if m.ascending] for d in calls.METHODS}
    assert up == {"ME": ["rho", "overlap", "fisher", "weighted"], "CO": ["lor", "wald", "overlap", "fisher", "weighted"]}


def test_method_tables_count_before_they_cut(spark):
    rows = [("a", str(k), -0.1 * k, 0.001 * k, 0.2, 0.2) for k in range(1, 6)] + [("a", "x", None, None, 0.2, 0.2), ("a", "y", -0.9, 0.5, 0.001, 0.2)]
    t = spark.createDataFrame(rows, "a string, b string, rho double, fisher_me_q double, t1x double, tx1 double").withColumn("fisher_me_p", F.col("fisher_me_q") / 2)
    got = calls.method_tables(t, "ME", 0.01, 2, {"rho": -0.25}, ["rho", "fisher"])
    by = {m: [(r.b, r.significant, r.n_significant) for r in got.where(F.col("method") == m).orderBy("rk").collect()] for m in ("rho", "fisher")}
    assert by == {"rho": [("5", True, 3), ("4", True, 3)], "fisher": [("1", True, 5), ("2", True, 5)]}
    last = calls.rank_by(t, "ME", "fisher", 0.01).orderBy(F.desc("rk")).first()
    assert last.b == "x" and last.significant is False


def test_mean_curve_is_an_interpolation(spark):
    curves = {1: ([0.0, 0.25, 1.0], [1.0, 0.8, 0.3]), 2: ([0.0, 0.5, 1.0], [1.0, 0.5, 0.4])}
    df = spark.createDataFrame([("m", run, x, y) for run, (xs, ys) in curves.items() for x, y in zip(xs, ys)], "method string, run int, recall double, precision double")
    got = {round(r.recall * 100): (r.mean, r.sd) for r in evaluation.mean_curve(df, 101).collect()}
    grid = np.arange(101) / 100
    want = np.stack([np.interp(grid, *c) for c in curves.values()])
    assert sorted(got) == list(range(101))
    assert [got[k][0] for k in range(101)] == pytest.approx(want.mean(0)) and [got[k][1] for k in range(101)] == pytest.approx(want.std(0), abs=1e-12)


def test_hits_are_counted_over_runs(spark):
    ranked = spark.createDataFrame([("m", 1, "a", "b", 1), ("m", 1, "a", "c", 2), ("m", 2, "b", "a", 2), ("m", 2, "c", "d", 1)], "method string, run int, a string, b string, rk int")
    truth = spark.createDataFrame([(1, "b", "a"), (2, "a", "b")], "run int, a string, b string")
    assert [(r.rk, r.hits) for r in evaluation.hit_curve(ranked, truth, 5, 2).orderBy("rk").collect()] == [(1, 0.5), (2, 1.0)]


def test_weighted_draws_are_those_of_single_samples():
    rng = np.random.default_rng(0)
    weight, many = np.array([1.0, 2, 5]), np.array([300, 200, 50])
    for k in (0, 10, 100, 300, 550):
        x = baselines.weighted_draws(rng, weight, many, k, 1500)
        assert (x.sum(1) == k).all() and (x <= many).all() and (x >= 0).all()
        keys = rng.exponential(size=(1500, 550)) / np.repeat(weight, many)
        first = np.repeat([0, 1, 2], many)[np.argsort(keys, axis=1)[:, :k]]
        y = np.stack([(first == c).sum(1) for c in range(3)], axis=1)
        assert x.mean(0) == pytest.approx(y.mean(0), abs=0.4) and x.std(0) == pytest.approx(y.std(0), abs=0.4)
    many_first = baselines._first_of(rng, weight, np.tile([30, 20, 10], (3000, 1)), np.full(3000, 7), np.full(3000, 0.5))
    t = -np.log1p(-rng.random((3000, 60)) * -np.expm1(-np.repeat(weight, [30, 20, 10]) * 0.5)) / np.repeat(weight, [30, 20, 10])
    ring = np.repeat([0, 1, 2], [30, 20, 10])[np.argsort(t, axis=1)[:, :7]]
    assert many_first.mean(0) == pytest.approx([(ring == c).sum(1).mean() for c in range(3)], abs=0.15)


def test_weighted_test_equals_drawing_samples(spark):
    sums, n = [(1, 60), (2, 40), (6, 20)], 120
    t = spark.createDataFrame([("a", "b", 9, 21, 31, 59), ("a", "c", 2, 28, 20, 70)], "a string, b string, n11 long, n10 long, n01 long, n00 long")
    got = {(r.a, r.b): (r.me_p, r.co_p, r.me_q) for r in baselines.weighted_test(t, spark.createDataFrame(sums, "sample_sum long, n long"), 4000).collect()}
    rng, weight = np.random.default_rng(1), np.repeat([1.0, 2, 6], [60, 40, 20])
    for (a, b), (n11, k1, k2) in {("a", "b"): (9, 30, 40), ("a", "c"): (2, 30, 22)}.items():
        hit = [np.argsort(np.argsort(rng.exponential(size=(4000, n)) / weight, axis=1), axis=1) < k for k in (k1, k2)]
        both = (hit[0] & hit[1]).sum(1)
        assert got[a, b][:2] == pytest.approx(((both <= n11).mean(), (both >= n11).mean()), abs=0.05)
        assert got[a, b][2] >= got[a, b][0]


def test_burden_aware_calls(spark):
    conditioned = spark.createDataFrame([("a", "b", 0.001, 0.02), ("a", "c", 0.001, 0.3), ("b", "c", 0.2, 0.001), ("c", "d", 0.01, None)], "a string, b string, p_plain double, p_burden double")
    table = conditioned.select("a", "b")
    got = {(r.a, r.b): (r.q_burden, r.robust) for r in baselines.burden_aware(conditioned, table).collect()}
    assert got["a", "b"] == (pytest.approx(0.03), True) and got["b", "c"] == (pytest.approx(0.003), True)
    assert got["a", "c"] == (pytest.approx(0.3), False) and got["c", "d"] == (None, False)
    x = baselines.explained_by_burden(conditioned).first()
    assert (x.pairs, x.marginal, x.explained) == (4, 3, 2)


def test_burden_regression_equals_one_sample_by_sample(spark):
    rng = np.random.default_rng(3)
    n = 400
    burden = rng.integers(1, 6, n)
    a, b = (rng.random(n) < 0.1 * burden), (rng.random(n) < 0.08 * burden)
    rows = [(i, "A_M", 1) for i in range(n) if a[i]] + [(i, "B_M", 1) for i in range(n) if b[i]]
    long = spark.createDataFrame(rows, "sample long, feature string, c long")
    top = counts.top(counts.totals(long), 2)
    burdens = spark.createDataFrame([(i, int(burden[i])) for i in range(n)], "sample long, burden long")
    r = baselines.burden_conditioned(long, top, burdens).first()
    x, y = (a, b) if r.a == "A_M" else (b, a)
    want = baselines.logit_p(y.astype(float), np.column_stack([x, np.log1p(burden)]), np.ones(n)), baselines.logit_p(y.astype(float), x[:, None].astype(float), np.ones(n))
    assert (r.p_burden, r.p_plain) == pytest.approx(want, rel=1e-6)


def test_names_and_marginal_rates(spark):
    df = spark.createDataFrame([("A_M", "B_N", 0.4, 0.3, 0.2, 0.1), ("C_M", "A_M", 0.4, 0.3, 0.2, 0.1), ("C_M", "B_N", 0.4, 0.3, 0.2, 0.1)], "a string, b string, t00 double, t01 double, t10 double, t11 double")
    assert {r.partner: round(r.rate, 9) for r in fit.marginal_rates(df, "A_M").collect()} == {"B_N": 0.3, "C_M": 0.4}
    name = df.select(fit.pair_name(F.col("a"), F.col("b")).alias("name"))
    assert [tuple(r) for r in name.select(*fit.pair_ends(F.col("name"))).collect()] == [("A_M", "B_N"), ("C_M", "A_M"), ("C_M", "B_N")]
    assert one(spark, special.rate_of(F.lit(0.3)))[0] == pytest.approx(-math.log(0.7))


def test_tails_cost_the_same_whatever_the_number_of_events():
    n = 10**9
    tracemalloc.start()
    _, least = baselines.poisson_binomial(np.array([0.2, 0.5, 0.8]), np.array([n, n + 1, n]), 3 * n // 2 + 1)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert least == pytest.approx(0.5, abs=1e-10) and most < 100_000  # an odd number of events, symmetric


def test_overlap_test_spreads_pairs_over_tasks(spark):
    tables = spark.range(200).selectExpr("concat('x', id) as a", "concat('y', id) as b", "1 as n11", "2 as n10", "2 as n01", "5 as n00").coalesce(1)
    sums = spark.createDataFrame([(100, 4), (50, 6)], "sample_sum long, n long")
    chances = spark.createDataFrame([(3, 100, 0.4), (3, 50, 0.2)], "feature_sum long, sample_sum long, p double")
    plan = baselines.overlap_test(tables, chances, sums)._jdf.queryExecution().toString().split("== Physical Plan ==")[1]
    below = plan[plan.index("MapInPandas") :].split("\n")
    assert "REPARTITION_BY_NUM" in next(x for x in below if "Exchange" in x)


def test_overlap_by_margins_equals_that_of_the_samples(cohort, spark):
    n, top = cohort.size(), cohort.top(3)
    few = cohort.counts.join(top.select("feature"), "feature", "left_semi")
    tables = fit.contingency(fit.joint_counts(cohort.counts, top), cohort.counts, top, F.lit(n)).cache()
    sums = counts.sample_sums(cohort.counts, top).cache()
    assert sums.agg(F.sum("n")).first()[0] == cohort.counts.select("sample").distinct().count()
    held = few.groupBy("sample").agg(F.count("*").alias("sample_sum")).groupBy("sample_sum").agg(F.count("*").alias("n"))
    want = {(r.a, r.b): r for r in baselines.overlap_test(tables, background.max_entropy_background(few), held).collect()}
    got = {(r.a, r.b): r for r in baselines.overlap_by_margins(tables, sums).collect()}
    assert got == want and len(got) == 3


def test_sample_sums_count_samples_without_ranked_features(spark):
    table = spark.createDataFrame([("s", "a", 1), ("s", "b", 2), ("t", "b", 1), ("u", "c", 5)], "sample string, feature string, c long")
    top = spark.createDataFrame([("a", 1), ("b", 2)], "feature string, rk int")
    assert {tuple(r) for r in counts.sample_sums(table, top).collect()} == {(2, 1), (1, 1), (0, 1)}
