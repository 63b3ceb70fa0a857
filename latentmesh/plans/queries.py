"""The registered queries over the driver's tables, with their SQL where it can express them.

An order is a sample, a brand a gene, a return flag an effect; see
``sources.driver_tables``.  Statistics are rounded so that the engines' orders
of summation don't show.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import special
from ..operators import background, baselines, calls, counts, evaluation, fit, networks, reports, simulation
from ..sources import driver_tables as tables
from ..sources.staging import staged
from .identify import Cohort, pairs
from .oracle import BASE, CALLS, CHI2, CLASS_CELLS, CLASS_PI, CLASSES, EPS_N, K, PAIRS, PI, SINGLE, TAU, TOP, end, pi_restarts, tau_restarts
from .oracle import r as sql_r

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

#: Reference sets by rule: brands that end in an even digit count as drivers.
_DRIVER = "right(split_part({f}, '_', 1), 1) IN ('2', '4')"


def _query(sql: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def r(c: Column | str, digits: int = 6) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_features(tables.events(spark, sf_dir, kept=True))


def _size(c: DataFrame) -> int:
    return c.agg(F.count_distinct("sample")).first()[0]


class _Parts:
    """What the model queries share: the counts as a written table, the top features, the backgrounds."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.counts = staged(_counts(spark, sf_dir), "counts")
        self.totals = counts.totals(self.counts)

    @cached_property
    def n(self) -> int:
        return _size(self.counts)

    @cached_property
    def pmfs(self) -> DataFrame:
        return background.poisson(self.totals, F.lit(self.n), 0.8, K)

    @cached_property
    def cells(self) -> DataFrame:
        return fit.with_pmfs(fit.histogram(self.counts, F.lit(self.n)), self.pmfs)

    @cached_property
    def top(self) -> DataFrame:
        return staged(counts.top(self.totals, TOP), "top")

    @cached_property
    def classed(self) -> tuple[DataFrame, DataFrame]:
        """The backgrounds of classes of burdens, and the class of each sample."""
        burdens = staged(counts.burden(self.counts), "burdens")
        return background.by_burden_class(background.expected(self.pmfs), burdens, background.largest(self.counts)), background.burden_classes(burdens)

    def single(self, n_inits: int = 1) -> DataFrame:
        rates = staged(fit.fit_rates(self.cells, n_inits), "rates")
        return fit.feature_statistics(self.cells, rates, self.totals, background.expected(self.pmfs))

    def pairs(self, n_inits: int = 1) -> DataFrame:
        fits, contingency = pairs(Cohort(self.counts, self.pmfs), self.top, self.n, None, n_inits=n_inits)
        return staged(fit.pair_statistics(fits, contingency), "pairs")

    def contingency(self) -> DataFrame:
        top = self.top
        return fit.contingency(staged(fit.joint_counts(self.counts, top), "joint"), self.counts, top, F.lit(self.n))


def _is_driver(feature: Column) -> Column:
    return F.substring(F.split_part(feature, F.lit("_"), F.lit(1)), -1, 1).isin("2", "4")


def _drivers(totals: DataFrame) -> DataFrame:
    return totals.where(_is_driver(F.col("feature"))).select("feature")


# counts


@_query(end("SELECT sample, feature, c FROM counts"))
def count_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir)


@_query("SELECT sample, gene AS feature, count(*) AS c FROM (" + BASE.rstrip().rstrip(",").replace("WITH RECURSIVE ", "WITH ", 1) + " SELECT * FROM ev WHERE effect <> 'silent') GROUP BY ALL")
def gene_level_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.count_genes(tables.events(spark, sf_dir, kept=True))


_FIVE = [f"Brand#1{k}_M" for k in range(1, 6)]


@_query(end("SELECT sample, " + ", ".join(f"sum(CASE WHEN feature = '{f}' THEN c ELSE 0 END)::BIGINT AS \"{f}\"" for f in _FIVE) + f" FROM counts WHERE feature IN ({', '.join(repr(f) for f in _FIVE)}) GROUP BY sample"))
def count_matrix_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.wide(_counts(spark, sf_dir).where(F.col("feature").isin(_FIVE)), _FIVE)


@_query(end("SELECT feature, total, rk FROM top"))
def feature_totals_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.top(counts.totals(_counts(spark, sf_dir)), TOP)


_BURDEN = "b AS (SELECT sample, sum(c)::BIGINT AS burden FROM counts GROUP BY sample),"


@_query(end(f"SELECT {sql_r('median(burden)')} AS median, {sql_r('avg(burden)')} AS mean, {sql_r('avg((burden > 2 * (SELECT median(burden) FROM b))::INT)')} AS fraction FROM b", _BURDEN))
def sample_burden_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.hypermutators(counts.burden(_counts(spark, sf_dir)), 2.0).select(r("median").alias("median"), r("mean").alias("mean"), r("fraction").alias("fraction"))


@_query(end("SELECT sample, burden FROM b WHERE burden < (SELECT quantile_cont(burden, 0.9) FROM b)", _BURDEN))
def hypermutator_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.without_top_decile(counts.burden(_counts(spark, sf_dir)))


@_query(end("SELECT sample, burden FROM b WHERE burden BETWEEN (SELECT quantile_cont(burden, 0.05) FROM b) AND (SELECT quantile_cont(burden, 0.95) FROM b)", _BURDEN))
def burden_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.trimmed(counts.burden(_counts(spark, sf_dir)), "burden")


_COHORT = "cc AS (SELECT c.*, o_orderpriority AS cohort FROM counts c JOIN orders ON sample = o_orderkey),"


def _by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _counts(spark, sf_dir).join(tables.sample_cohorts(spark, sf_dir), "sample")


@_query(end(f"SELECT cohort, {sql_r('s / k')} AS mean, {sql_r('sqrt(q / k - s / k * s / k) / (s / k)')} AS cv FROM (SELECT cohort, sum(c)::DOUBLE AS s, sum(c * c)::DOUBLE AS q, count(DISTINCT sample) * count(DISTINCT feature) AS k FROM cc GROUP BY cohort)", _COHORT))
def cv_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.variation(_by_cohort(spark, sf_dir)).select("cohort", r("mean").alias("mean"), r("cv").alias("cv"))


@_query(end(f"SELECT feature, {sql_r('s / n')} AS mean, {sql_r('sqrt((q - s * s / n) / (n - 1))')} AS sd FROM (SELECT feature, sum(c)::DOUBLE AS s, sum(c * c)::DOUBLE AS q FROM counts GROUP BY feature), size"))
def feature_mean_sd(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return counts.spread(c, F.lit(_size(c))).select("feature", r("mean").alias("mean"), r("sd").alias("sd"))


@_query(end("SELECT sum(CASE WHEN feature LIKE '%\\_M' ESCAPE '\\' THEN c ELSE 0 END)::BIGINT AS missense, sum(CASE WHEN feature LIKE '%\\_N' ESCAPE '\\' THEN c ELSE 0 END)::BIGINT AS nonsense, count(DISTINCT sample) AS samples FROM counts"))
def effect_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.effect_totals(_counts(spark, sf_dir))


@_query(end("SELECT sample, feature, c, regexp_replace(cohort, '[^0-9A-Za-z]+', '_', 'g') AS cohort FROM cc WHERE cohort IN (SELECT cohort FROM cc GROUP BY cohort HAVING count(DISTINCT sample) >= 100)", _COHORT))
def split_cohort_min_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    types = tables.sample_cohorts(spark, sf_dir).select(F.col("sample").alias("key"), F.col("cohort").alias("type"))
    return counts.split_by(_counts(spark, sf_dir), types, 100)


@_query(end("SELECT feature, total, row_number() OVER (ORDER BY total DESC, feature)::INTEGER AS rk FROM totals WHERE NOT " + _DRIVER.format(f="feature") + " QUALIFY rk <= 10"))
def likely_passengers(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = counts.totals(_counts(spark, sf_dir))
    return counts.likely_passengers(t, _drivers(t), 10)


@_query(end("SELECT feature, total FROM totals WHERE " + _DRIVER.format(f="feature")))
def driver_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = counts.totals(_counts(spark, sf_dir))
    return t.join(_drivers(t), "feature", "left_semi")


@_query(end("SELECT gene, array_to_string(list_sort(list(DISTINCT cohort)), '|') AS cohorts FROM (SELECT cohort, gene, row_number() OVER (PARTITION BY cohort ORDER BY t DESC, gene) AS rn FROM (SELECT cohort, split_part(feature, '_', 1) AS gene, sum(c) AS t FROM cc GROUP BY ALL)) WHERE rn <= 12 GROUP BY gene HAVING count(*) >= 4", _COHORT))
def upset_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _by_cohort(spark, sf_dir).groupBy("cohort", counts.base_gene(F.col("feature")).alias("gene")).agg(F.sum("c").alias("t"))
    tops = sums.withColumn("rn", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("t"), "gene"))).where("rn <= 12")
    return networks.in_many(tops.select("cohort", "gene"), 4).select("gene", F.array_join("cohorts", "|").alias("cohorts"))


@_query(end("(SELECT feature, total, true AS driver FROM totals WHERE " + _DRIVER.format(f="feature") + " ORDER BY total DESC, feature LIMIT 5) UNION ALL (SELECT feature, total, false FROM totals WHERE NOT " + _DRIVER.format(f="feature") + " ORDER BY total DESC, feature LIMIT 5)"))
def top_nlargest_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = counts.totals(_counts(spark, sf_dir)).withColumn("driver", _is_driver(F.col("feature")))
    return calls.largest_of_each(t, 5, "total", "driver")


# backgrounds


@_query(end(f"SELECT feature, k::INTEGER AS k, {sql_r('p', 9)} AS p FROM pn"))
def bmr_poisson(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    pmfs = background.poisson(counts.totals(c), F.lit(_size(c)), 0.8, K)
    return pmfs.select("feature", F.posexplode("pmf").alias("k", "p")).select("feature", "k", r("p", 9).alias("p"))


@_query(end(f"SELECT feature, {sql_r('expected', 9)} AS expected FROM expected"))
def pmf_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts(spark, sf_dir)
    return background.expected(background.poisson(counts.totals(c), F.lit(_size(c)), 0.8, K)).select("feature", r("expected", 9).alias("expected"))


@_query("SELECT p_brand AS feature, " + sql_r("avg(p_size) / sum(avg(p_size)) OVER ()", 9) + " AS p FROM part GROUP BY p_brand")
def pmf_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("feature")).agg(F.avg("p_size").alias("w"))
    one = sizes.agg(F.array_sort(F.collect_list(F.struct("feature", "w"))).alias("rows"))  # one row for each of the brands
    whole = one.select("rows", special.scaled(F.transform("rows", lambda x: x.w)).alias("p")).select(F.explode(F.arrays_zip("rows", "p")).alias("x"))
    return whole.select("x.rows.feature", r("x.p", 9).alias("p"))


_GENES = "g AS (SELECT gene, 20 + 10 * avg(q) AS alpha, 0.3::DOUBLE AS theta, 0.04::DOUBLE * avg(d) * 20 AS pi_mis, 0.002::DOUBLE AS pi_nons FROM (SELECT p_brand AS gene, l_quantity AS q, l_discount AS d FROM lineitem JOIN part ON l_partkey = p_partkey) GROUP BY gene),"


def _gamma_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    return joined.groupBy(F.col("p_brand").alias("gene")).agg((20 + 10 * F.avg("l_quantity")).alias("alpha"), F.lit(0.3).alias("theta"), (F.lit(0.04) * F.avg("l_discount") * 20).alias("pi_mis"), F.lit(0.002).alias("pi_nons"))


@_query(end(
    f"""SELECT feature, k::INTEGER AS k, {sql_r("p / sum(p) OVER (PARTITION BY feature)", 9)} AS p FROM nb WHERE k <= (SELECT greatest(max(reach), 6) FROM (SELECT feature, count(*) FILTER (before < 1 - 1e-7) - 1 AS reach FROM (SELECT feature, k, coalesce(sum(p) OVER (PARTITION BY feature ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM nb) GROUP BY feature))""",
    _GENES,
    "fp AS (SELECT gene || '_M' AS feature, alpha / 36.0 AS size, 1 / (1 + theta * pi_mis) AS pr FROM g UNION ALL SELECT gene || '_N', alpha / 36.0, 1 / (1 + theta * pi_nons) FROM g), nb AS (SELECT feature, k, exp(lgamma(k + size) - lgamma(size) - lgamma(k + 1) + size * ln(pr) + k * ln(1 - pr)) AS p FROM fp, range(0, 51) t(k)),",
))
def bmr_negbin(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmfs = background.negative_binomial(_gamma_genes(spark, sf_dir), 36, 6)
    return pmfs.select("feature", F.posexplode("pmf").alias("k", "p")).select("feature", "k", r("p", 9).alias("p"))


@_query(end(f"SELECT feature, sample, {sql_r('greatest(expected * burden / (SELECT avg(burden) FROM b), 1e-9)', 9)} AS lambda FROM expected, b WHERE feature IN (SELECT feature FROM top)", _BURDEN))
def bmr_persample_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    made = background.by_burden(background.expected(p.pmfs).join(p.top, "feature", "left_semi"), counts.burden(p.counts), background.largest(p.counts))
    return made.select("feature", "sample", r("lambda", 9).alias("lambda"))


_LINE_RATES = "lr AS (SELECT l_orderkey AS sample, p_brand || CASE l_returnflag WHEN 'A' THEN '_M' ELSE '_N' END AS feature, avg(l_tax) AS rate FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') AND l_quantity > 25 GROUP BY ALL), lm AS (SELECT feature, avg(rate) AS mean FROM lr GROUP BY feature),"


@_query(end(f"SELECT feature, count(*) AS samples, {sql_r('avg(greatest(coalesce(rate, mean), 1e-12))')} AS mean, {sql_r('max(greatest(coalesce(rate, mean), 1e-12))')} AS most FROM lm CROSS JOIN (SELECT DISTINCT sample FROM counts) s LEFT JOIN lr USING (feature, sample) GROUP BY feature", _LINE_RATES))
def bmr_given_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backgrounds of given rates; a sample without one has the feature's mean."""
    lines = tables.table(spark, sf_dir, "lineitem").where(F.col("l_returnflag").isin("A", "R") & (F.col("l_quantity") > 25)).join(tables.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rates = lines.groupBy(F.col("l_orderkey").alias("sample"), F.concat("p_brand", F.when(F.col("l_returnflag") == "A", "_M").otherwise("_N")).alias("feature")).agg(F.avg("l_tax").alias("lambda"))
    samples = staged(_counts(spark, sf_dir), "counts").select("sample").distinct()
    made = background.by_rates(rates, samples, 2)
    return made.groupBy("feature").agg(F.count("*").alias("samples"), r(F.avg("lambda")).alias("mean"), r(F.max("lambda")).alias("most"))


@_query(f"SELECT feature, count(*) AS samples, {sql_r('avg(rate)', 9)} AS mean, {sql_r('max(rate)', 9)} AS most FROM (SELECT p_brand || s AS feature, CASE s WHEN '_M' THEN nmis ELSE nnon + nspl END / 1000.0::DOUBLE * mutrate * factor AS rate FROM (SELECT p_brand, avg(p_retailprice)::DOUBLE / 1e6 AS mutrate, sum(p_size)::DOUBLE AS nmis, count(*)::DOUBLE AS nnon, 3::DOUBLE AS nspl FROM part GROUP BY p_brand) g, (VALUES ('_M'), ('_N')) e(s), (SELECT o_totalprice::DOUBLE / (SELECT avg(o_totalprice)::DOUBLE FROM orders) AS factor FROM orders) f) GROUP BY feature")
def bmr_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of genes' sites in proportion to each sample's exposure."""
    genes = tables.table(spark, sf_dir, "part").groupBy(F.col("p_brand").alias("gene")).agg((F.avg("p_retailprice").cast("double") / 1e6).alias("mutrate"), F.lit(1000).alias("n_eff"), F.sum("p_size").cast("double").alias("nmis"), F.count("*").cast("double").alias("nnon"), F.lit(3.0).alias("nspl"))
    orders = tables.table(spark, sf_dir, "orders")
    mean = orders.agg(F.avg("o_totalprice").cast("double").alias("mean"))
    factors = orders.crossJoin(F.broadcast(mean)).select(F.col("o_orderkey").alias("sample"), (F.col("o_totalprice").cast("double") / F.col("mean")).alias("factor"))  # one row is broadcast
    made = background.exposure_rates(genes, factors, 1000)
    return made.groupBy("feature").agg(F.count("*").alias("samples"), r(F.avg("lambda"), 9).alias("mean"), r(F.max("lambda"), 9).alias("most"))


@_query(end(f"SELECT feature, {sql_r('-ln(1 - m / n::DOUBLE)')} AS rate FROM (SELECT feature, count(*) AS m FROM counts GROUP BY feature), size WHERE m < n"))
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The Poisson rate that has an event as often as the feature has one."""
    c = _counts(spark, sf_dir)
    n = _size(c)
    return c.groupBy("feature").agg(F.count("*").alias("m")).where(F.col("m") < n).select("feature", r(special.rate_of(F.col("m") / F.lit(float(n)))).alias("rate"))


@_query(end("SELECT feature, total FROM totals WHERE feature NOT IN (SELECT feature FROM totals WHERE total >= (SELECT avg(total) FROM totals))"))
def features_missing_bmr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    mean = p.totals.agg(F.avg("total").alias("m"))
    some = p.pmfs.join(p.totals, "feature").crossJoin(F.broadcast(mean)).where("total >= m")  # one row is broadcast
    return fit.missing_background(p.totals, some)


# features


@_query(end(f"SELECT feature, {sql_r('pi')} AS pi, {sql_r('sum(n * ln(greatest(here * (1 - pi) + below * pi, 1e-300)))', 4)} AS loglik FROM cells, (SELECT k * (0.99::DOUBLE / 99) AS pi FROM range(0, 100) t(k)) GROUP BY feature, pi"))
def pi_loglik_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.profile(_Parts(spark, sf_dir).cells).select("feature", r("pi").alias("pi"), r("loglik", 4).alias("loglik"))


_GRID = "grid AS (SELECT feature, pi, sum(n * ln(greatest(here * (1 - pi) + below * pi, 1e-300))) AS ll FROM cells, (SELECT k * (0.99::DOUBLE / 99) AS pi FROM range(0, 100) t(k)) GROUP BY feature, pi), slopes AS (SELECT feature, pi, sign(ll - lag(ll) OVER (PARTITION BY feature ORDER BY pi)) AS s FROM grid),"


@_query(end("SELECT feature, count(*) FILTER (turn)::BIGINT AS turns FROM (SELECT feature, s <> lag(s) OVER (PARTITION BY feature ORDER BY pi) AS turn FROM slopes) GROUP BY feature", _GRID))
def pi_profile_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.turns(evaluation.profile(_Parts(spark, sf_dir).cells))


@_query(end(f"SELECT feature, {sql_r('pi')} AS pi FROM pis", PI))
def pi_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fit_rates(_Parts(spark, sf_dir).cells, n_inits=1).select("feature", r("pi").alias("pi"))


@_query(end(f"SELECT feature, {sql_r('arg_max(pi, i)', 5)} AS pi, max(used)::INTEGER AS inits_used, 'ok' AS status FROM fold GROUP BY feature", pi_restarts(special.restarts(10, 0)[0])))
def pi_em_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.fit_rates(_Parts(spark, sf_dir).cells).withColumn("pi", r("pi", 5))


@_query(end(f"SELECT feature, {sql_r('low')} AS pi FROM mle WHERE it = 60", "mle AS (SELECT feature, 0 AS it, 0::DOUBLE AS low, 1 - 1e-9::DOUBLE AS high FROM totals UNION ALL SELECT feature, it + 1, CASE WHEN up THEN (low + high) / 2 ELSE low END, CASE WHEN up THEN high ELSE (low + high) / 2 END FROM (SELECT m.feature, it, low, high, sum(n * (below - here) / greatest(here * (1 - (low + high) / 2) + below * (low + high) / 2, 1e-300)) > 0 AS up FROM mle m JOIN cells USING (feature) WHERE it < 60 GROUP BY m.feature, it, low, high)),"))
def pi_mle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.maximise_rates(_Parts(spark, sf_dir).cells).select("feature", r("pi").alias("pi"))


@_query(end(f"SELECT feature, {sql_r('pi')} AS pi FROM pis", CLASSES, CLASS_PI))
def persample_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates under backgrounds in proportion to each sample's burden."""
    p = _Parts(spark, sf_dir)
    pmfs, classes = p.classed
    cells = fit.with_pmfs(fit.histogram(p.counts, F.lit(p.n), classes), pmfs)
    return fit.fit_rates(cells, n_inits=1).select("feature", r("pi").alias("pi"))


_SINGLE = ("pi", "lor", "lrt", "expected", "excess")


@_query(end("SELECT feature, observed, " + ", ".join(f"{sql_r(c, 5)} AS {c}" for c in _SINGLE) + " FROM single", PI, SINGLE))
def single_gene_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).single().select("feature", "observed", *[r(c, 5).alias(c) for c in _SINGLE])


@_query(end(f"SELECT feature, {sql_r('p')} AS p, {sql_r('least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC))')} AS q FROM (SELECT *, row_number() OVER (ORDER BY p, feature) AS rn, count(*) OVER () AS m FROM (SELECT feature, {CHI2.format(x='lrt')} AS p FROM single))", PI, SINGLE))
def single_gene_drivers_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.driver_calls(_Parts(spark, sf_dir).single()).select("feature", r("p").alias("p"), r("q").alias("q"))


@_query(end("SELECT feature, observed, s.avg_d AS phi, s.avg_t AS p FROM single JOIN (SELECT p_brand || CASE l_returnflag WHEN 'A' THEN '_M' ELSE '_N' END AS feature, round(avg(l_discount), 6) AS avg_d, round(avg(l_tax), 6) AS avg_t FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag IN ('A', 'R') GROUP BY ALL) s USING (feature)", PI, SINGLE))
def annotate_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").join(tables.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).where(F.col("l_returnflag").isin("A", "R"))
    stats = lines.groupBy(F.concat("p_brand", F.when(F.col("l_returnflag") == "A", "_M").otherwise("_N")).alias("feature")).agg(F.round(F.avg("l_discount"), 6).alias("phi"), F.round(F.avg("l_tax"), 6).alias("p"))
    named = fit.named_single(_Parts(spark, sf_dir).single(), stats)
    return named.select(F.col("Gene Name").alias("feature"), F.col("Observed Mutations").alias("observed"), F.col("`CBaSE Pos. Sel. Phi`").alias("phi"), F.col("`CBaSE Pos. Sel. P-Val`").alias("p"))


# pairs


@_query(end("SELECT a, b, n11, n10, n01, n00 FROM cont", PAIRS))
def pair_contingency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).contingency()


@_query(end("SELECT a, b, ca, cb, n FROM ph", PAIRS))
def pair_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    top = p.top
    return fit.pair_histogram(staged(fit.joint_counts(p.counts, top), "joint"), p.counts, top, F.lit(p.n))


@_query(end("SELECT x.feature AS a, y.feature AS b, array_to_string(list_sort(list(x.sample)), ',') AS samples FROM tc x JOIN tc y ON x.sample = y.sample AND x.rk < y.rk GROUP BY ALL", PAIRS))
def cooccurring_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return fit.cooccurring(p.counts, p.top).select("a", "b", F.array_join(F.col("samples").cast("array<string>"), ",").alias("samples"))


_HYPER = "list_sum(list_transform(range({lo}, {hi} + 1), lambda k: exp(lgamma(ra + 1) + lgamma(rb + 1) + lgamma(t - ra + 1) + lgamma(t - rb + 1) - lgamma(t + 1) - lgamma(k + 1) - lgamma(ra - k + 1) - lgamma(rb - k + 1) - lgamma(t - ra - rb + k + 1))))"
_FISHER = f"""
fe AS (SELECT a, b, least(1.0, {_HYPER.format(lo="greatest(0, ra + rb - t)", hi="n11")}) AS me_p, least(1.0, {_HYPER.format(lo="n11", hi="least(ra, rb)")}) AS co_p FROM (SELECT a, b, n11, n11 + n10 AS ra, n11 + n01 AS rb, n11 + n10 + n01 + n00 AS t FROM cont)),
fr AS (SELECT *, row_number() OVER (ORDER BY me_p, a, b) AS r1, row_number() OVER (ORDER BY co_p, a, b) AS r2, count(*) OVER () AS m FROM fe),
fq AS (SELECT a, b, me_p, co_p, least(1.0, min(me_p * m / r1) OVER (ORDER BY r1 DESC)) AS me_q, least(1.0, min(co_p * m / r2) OVER (ORDER BY r2 DESC)) AS co_q FROM fr),
"""
_FOUR = ("me_p", "co_p", "me_q", "co_q")


@_query(end("SELECT a, b, " + ", ".join(f"{sql_r(c)} AS {c}" for c in _FOUR) + " FROM fq", PAIRS, _FISHER))
def fisher_pairs_bh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.fisher(_Parts(spark, sf_dir).contingency()).select("a", "b", *[r(c).alias(c) for c in _FOUR])


@_query(end(f"SELECT a, b, {sql_r('sum(n * ln(a0 * b0 * 0.85 + a0 * b1 * 0.05 + a1 * b0 * 0.05 + a1 * b1 * 0.05))', 4)} AS loglik FROM pc GROUP BY a, b", PAIRS, TAU))
def pair_loglik_fixed_tau(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return _loglik(fit.pair_cells(fit.pair_histogram(staged(fit.joint_counts(p.counts, p.top), "joint"), p.counts, p.top, F.lit(p.n)), p.pmfs))


def _loglik(cells: DataFrame) -> DataFrame:
    mixed = F.expr("a0 * b0 * 0.85D + a0 * b1 * 0.05D + a1 * b0 * 0.05D + a1 * b1 * 0.05D")
    return cells.groupBy("a", "b").agg(r(F.sum(F.col("n") * F.ln(mixed)), 4).alias("loglik"))


_TAUS = ("t00", "t01", "t10", "t11")


@_query(end("SELECT a, b, " + ", ".join(f"{sql_r(c)} AS {c}" for c in _TAUS) + " FROM taus", PAIRS, TAU))
def tau_em(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).pairs().select("a", "b", *[r(c).alias(c) for c in _TAUS])


@_query(end("SELECT a, b, " + ", ".join(f"{sql_r(f'arg_max({c}, i)', 5)} AS {c}" for c in _TAUS) + " FROM fold GROUP BY a, b", PAIRS, tau_restarts(special.restarts(10, 0)[1])))
def tau_em_restarts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).pairs(10).select("a", "b", *[r(c, 5).alias(c) for c in _TAUS])


@_query(end(f"SELECT a, b, {sql_r('sum(n * ln(a0 * b0 * 0.85 + a0 * b1 * 0.05 + a1 * b0 * 0.05 + a1 * b1 * 0.05))', 4)} AS loglik FROM pc GROUP BY a, b", CLASSES, PAIRS, CLASS_CELLS))
def persample_pair_loglik(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The likelihood of one set of joint rates under backgrounds in proportion to each sample's burden."""
    p = _Parts(spark, sf_dir)
    pmfs, classes = p.classed
    joint = staged(fit.joint_counts(p.counts, p.top, classes), "joint")
    return _loglik(fit.pair_cells(fit.pair_histogram(joint, p.counts, p.top, F.lit(p.n), classes), pmfs))


@_query()
def persample_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint rates under those backgrounds; the fit in SQL takes minutes, so the test compares it with a fit sample by sample."""
    p = _Parts(spark, sf_dir)
    pmfs, classes = p.classed
    fits, _ = pairs(Cohort(p.counts, pmfs, classes=classes), p.top, p.n, None, n_inits=1)
    return fits.select("a", "b", *[r(c).alias(c) for c in _TAUS])


#: The feature whose marginal rates are asked for.
_ONE = "Brand#13_M"


@_query(end(f"SELECT CASE WHEN a = '{_ONE}' THEN b ELSE a END AS partner, {sql_r(f'CASE WHEN a = {_ONE!r} THEN t1x ELSE tx1 END')} AS rate FROM stats WHERE a = '{_ONE}' OR b = '{_ONE}'", PAIRS, TAU))
def marginal_taus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.marginal_rates(_Parts(spark, sf_dir).pairs(), _ONE).select("partner", r("rate").alias("rate"))


_STATS = ("t1x", "tx1", "rho", "lor", "wald", "lrt")


@_query(end("SELECT a, b, n11, n10, n01, n00, " + ", ".join(f"{sql_r(c, 5)} AS {c}" for c in _STATS) + " FROM stats", PAIRS, TAU))
def pairwise_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).pairs().select("a", "b", "n11", "n10", "n01", "n00", *[r(c, 5).alias(c) for c in _STATS])


@_query(end(f"SELECT a, b, direction, {sql_r('p')} AS p, {sql_r('q')} AS q FROM called", PAIRS, TAU, CALLS))
def pair_fdr_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.pair_calls(_Parts(spark, sf_dir).pairs()).select("a", "b", "direction", r("p").alias("p"), r("q").alias("q"))


_SUSPECT = ("Brand#11", "Brand#22")


@_query(end("SELECT count(*) AS pairs, count(*) FILTER (q < 0.5) AS significant, count(*) FILTER (q < 0.5 AND direction = 'ME') AS me, count(*) FILTER (q < 0.5 AND direction = 'CO') AS co, round(coalesce(avg(CASE WHEN q < 0.5 THEN (split_part(a, '_', 1) IN ('Brand#11', 'Brand#22') OR split_part(b, '_', 1) IN ('Brand#11', 'Brand#22'))::INT END), 0), 3) + 0.0 AS suspicious FROM called", PAIRS, TAU, CALLS))
def fdr_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.call_summary(calls.pair_calls(_Parts(spark, sf_dir).pairs(), 0.5, _SUSPECT), [])


_ACTIVE = f"act AS (SELECT s.*, {EPS_N!r} / ((SELECT n FROM size) + {EPS_N!r}) AS eps FROM stats s), ok AS (SELECT * FROM act WHERE t1x > eps AND tx1 > eps AND split_part(a, '_', 1) <> split_part(b, '_', 1)), rme AS (SELECT *, row_number() OVER (ORDER BY rho, a, b)::INTEGER AS rk FROM ok WHERE rho < 0), rco AS (SELECT *, row_number() OVER (ORDER BY lrt DESC, a, b)::INTEGER AS rk FROM ok WHERE rho > 0),"


@_query(end(f"SELECT a, b, {sql_r('rho', 5)} AS rho, rk FROM rme WHERE rk <= 20", PAIRS, TAU, _ACTIVE))
def rank_me(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return calls.rank_pairs(p.pairs(), "ME", special.epsilon(p.n)).where("rk <= 20").select("a", "b", r("rho", 5).alias("rho"), "rk")


@_query(end(f"SELECT a, b, {sql_r('lrt', 5)} AS lrt, rk FROM rco WHERE rk <= 20", PAIRS, TAU, _ACTIVE))
def rank_co(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return calls.rank_pairs(p.pairs(), "CO", special.epsilon(p.n)).where("rk <= 20").select("a", "b", r("lrt", 5).alias("lrt"), "rk")


_NULLS = "nul AS (SELECT s.*, 'c' || (length(a) + length(b) + n11) % 3 AS cohort FROM stats s), thr AS (SELECT coalesce(cohort, 'TOTAL') AS cohort, quantile_cont(CASE WHEN rho < 0 THEN rho END, 0.01) AS me_rho, quantile_cont(CASE WHEN rho > 0 THEN lrt END, 0.99) AS co_lrt FROM nul GROUP BY ROLLUP (cohort)),"


def _null_pairs(p: _Parts) -> DataFrame:
    return p.pairs().withColumn("cohort", F.concat(F.lit("c"), (F.length("a") + F.length("b") + F.col("n11")) % 3))


@_query(end(f"SELECT cohort, {sql_r('me_rho', 5)} AS me_rho, {sql_r('co_lrt', 5)} AS co_lrt FROM thr", PAIRS, TAU, _NULLS))
def thresholds_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.thresholds(_null_pairs(_Parts(spark, sf_dir))).select("cohort", r("me_rho", 5).alias("me_rho"), r("co_lrt", 5).alias("co_lrt"))


@_query(end(f"SELECT {sql_r('min(me_rho)', 5)} AS me_rho, {sql_r('max(co_lrt)', 5)} AS co_lrt FROM thr WHERE cohort <> 'TOTAL'", PAIRS, TAU, _NULLS))
def strictest_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return calls.strictest(calls.thresholds(_null_pairs(_Parts(spark, sf_dir)))).select(r("me_rho", 5).alias("me_rho"), r("co_lrt", 5).alias("co_lrt"))


@_query(end("SELECT count(*) AS pairs, count(*) FILTER (split_part(a, '_', 1) = split_part(b, '_', 1)) AS dropped FROM pairs", PAIRS))
def intra_gene_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = fit.pairs_of(_Parts(spark, sf_dir).top)
    return every.agg(F.count("*").alias("pairs"), F.count_if(counts.base_gene(F.col("a")) == counts.base_gene(F.col("b"))).alias("dropped"))


_ALL_RANKED = "ar AS (SELECT a, b, (NOT " + _DRIVER.format(f="a") + ")::INT + (NOT " + _DRIVER.format(f="b") + ")::INT AS hit, row_number() OVER (ORDER BY n11 DESC, a, b)::INTEGER AS rk FROM cont), pcurve AS (SELECT rk, sum(hit) OVER (ORDER BY rk) / (2.0::DOUBLE * rk) AS share FROM ar),"


@_query(end(f"SELECT {sql_r('(sum(share) - (min_by(share, rk) + max_by(share, rk)) / 2) / 50')} AS auc FROM pcurve WHERE rk <= 50", PAIRS, _ALL_RANKED))
def passenger_curve_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    ranked = p.contingency().withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n11"), "a", "b")))
    passengers = p.totals.where(~_is_driver(F.col("feature"))).select("feature")
    return calls.curve_area(calls.passenger_curve(ranked, passengers, 50), 50).select(r("auc").alias("auc"))


@_query(end(f"SELECT a, b, n11, {sql_r('rho', 5)} AS rho, {sql_r('me_p')} AS me_p FROM stats JOIN fq USING (a, b)", PAIRS, TAU, _FISHER))
def merge_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair_table = _Parts(spark, sf_dir).pairs()
    both = calls.merged(pair_table, calls.fisher(pair_table.select("a", "b", "n11", "n10", "n01", "n00")))
    return both.select("a", "b", "n11", r("rho", 5).alias("rho"), r("me_p").alias("me_p"))


# evaluation: pairs of brands with the same first digit count as true


_TRUTH = "tl AS (SELECT s.*, (substr(a, 7, 1) = substr(b, 7, 1))::INT AS label FROM cont s),"


def _truth(pair_table: DataFrame) -> DataFrame:
    return pair_table.where(F.substring("a", 7, 1) == F.substring("b", 7, 1)).select(F.col("b").alias("a"), F.col("a").alias("b"))


@_query(end("SELECT a, b, label FROM tl", PAIRS, _TRUTH))
def labels_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _Parts(spark, sf_dir).contingency()
    return evaluation.labels(t, _truth(t)).select("a", "b", "label")


_SCORED = "scored AS (SELECT a, b, method, CASE WHEN t1x < eps OR tx1 < eps THEN 0 ELSE coalesce(score, 0) END AS score FROM (SELECT a, b, t1x, tx1, eps, 'rho' AS method, -rho AS score FROM act UNION ALL SELECT a, b, t1x, tx1, eps, 'lrt', CASE WHEN -rho > 0 THEN lrt ELSE 0 END FROM act UNION ALL SELECT a, b, t1x, tx1, eps, 'lor', lor FROM act UNION ALL SELECT a, b, t1x, tx1, eps, 'wald', wald FROM act) UNION ALL SELECT a, b, 'fisher', -log10(me_p + 1e-300) FROM fq),"


def _with_fisher(pair_table: DataFrame) -> DataFrame:
    """The table of pairs with the exact test's columns beside it."""
    exact = calls.fisher(pair_table.select("a", "b", "n11", "n10", "n01", "n00"))
    return calls.merged(pair_table, exact.withColumnsRenamed({c: f"fisher_{c}" for c in _FOUR}))


@_query(end("SELECT a, b, method, round(score, 5) + 0.0 AS score FROM scored", PAIRS, TAU, _ACTIVE, _FISHER, _SCORED))
def method_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return evaluation.all_scores(_with_fisher(p.pairs()), "ME", special.epsilon(p.n)).select("a", "b", "method", r("score", 5).alias("score"))


_LABELLED = "sl AS (SELECT s.*, (substr(a, 7, 1) = substr(b, 7, 1))::INT AS label, 'g' || (length(a) + length(b) + n11) % 3 AS factor FROM scored s JOIN cont USING (a, b)),"
_STEPS = "st AS (SELECT factor, method, round(score, 6) AS score, sum(label)::DOUBLE AS hits, count(*) AS m FROM sl GROUP BY ALL), cu AS (SELECT factor, method, hits, sum(hits) OVER w AS tp, sum(m) OVER w AS called, sum(hits) OVER (PARTITION BY factor, method) AS p FROM st WINDOW w AS (PARTITION BY factor, method ORDER BY score DESC)),"


def _labelled_scores(p: _Parts) -> DataFrame:
    """All methods' scores with labels, pairs put in three groups as if they came from runs of three settings."""
    table = staged(_with_fisher(p.pairs()), "methods")
    factors = table.select("a", "b", F.concat(F.lit("g"), (F.length("a") + F.length("b") + F.col("n11")) % 3).alias("factor"))
    scored = evaluation.all_scores(table, "ME", special.epsilon(p.n)).withColumn("score", F.round("score", 6))
    return evaluation.labels(scored, _truth(table)).join(factors, ["a", "b"])


@_query(end(f"SELECT factor, method, {sql_r('coalesce(sum(CASE WHEN p > 0 THEN hits / p * tp / called END), 0)')} AS average_precision FROM cu GROUP BY factor, method", PAIRS, TAU, _ACTIVE, _FISHER, _SCORED, _LABELLED, _STEPS))
def average_precision_by_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _labelled_scores(_Parts(spark, sf_dir))
    return evaluation.average_precision(scored, ["factor", "method"]).select("factor", "method", r("average_precision").alias("average_precision"))


@_query(end(f"SELECT factor, method, {sql_r('tp / p')} AS recall, {sql_r('tp / called')} AS precision FROM cu WHERE p > 0 UNION ALL SELECT DISTINCT factor, method, 0, 1 FROM cu WHERE p > 0", PAIRS, TAU, _ACTIVE, _FISHER, _SCORED, _LABELLED, _STEPS))
def precision_recall_curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _labelled_scores(_Parts(spark, sf_dir))
    return evaluation.precision_recall(scored, ["factor", "method"]).select("factor", "method", r("recall").alias("recall"), r("precision").alias("precision"))


_ME_RANKED = """
ok1 AS (SELECT act.*, me_p, me_q, t1x > eps AND tx1 > eps AND rho < 0 AS fits FROM act JOIN fq USING (a, b)),
mt AS (
  SELECT a, b, 'rho' AS method, rho AS value, rho < -0.01 AS significant, row_number() OVER (ORDER BY rho, a, b)::INTEGER AS rk FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'lrt', lrt, NULL, row_number() OVER (ORDER BY lrt DESC NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'lor', lor, NULL, row_number() OVER (ORDER BY lor DESC NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'wald', wald, NULL, row_number() OVER (ORDER BY wald DESC NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'fisher', me_p, me_q < 0.01, row_number() OVER (ORDER BY me_p, a, b)::INTEGER FROM ok1),
"""
_CO_RANKED = """
ok1 AS (SELECT act.*, co_p, co_q, t1x > eps AND tx1 > eps AND rho > 0 AS fits FROM act JOIN fq USING (a, b)),
mt AS (
  SELECT a, b, 'rho' AS method, rho AS value, NULL AS significant, row_number() OVER (ORDER BY rho DESC, a, b)::INTEGER AS rk FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'lrt', lrt, lrt > 1.5, row_number() OVER (ORDER BY lrt DESC NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'lor', lor, NULL, row_number() OVER (ORDER BY lor NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'wald', wald, NULL, row_number() OVER (ORDER BY wald NULLS LAST, a, b)::INTEGER FROM ok1 WHERE fits
  UNION ALL SELECT a, b, 'fisher', co_p, co_q < 0.01, row_number() OVER (ORDER BY co_p, a, b)::INTEGER FROM ok1),
"""
_MT = f"SELECT rk, method, {sql_r('value', 5)} AS value, significant::INT::DOUBLE AS significant, n_significant::DOUBLE AS n_significant FROM (SELECT *, CASE WHEN significant IS NOT NULL THEN sum(significant::INT) OVER (PARTITION BY method)::BIGINT END AS n_significant FROM mt) WHERE rk <= 15"
_SQL_METHODS = ("rho", "lrt", "lor", "wald", "fisher")


def _method_tables(spark: SparkSession, sf_dir: str, direction: str, cutoffs: dict[str, float]) -> DataFrame:
    p = _Parts(spark, sf_dir)
    made = calls.method_tables(staged(_with_fisher(p.pairs()), "methods"), direction, special.epsilon(p.n), 15, cutoffs, _SQL_METHODS)
    # numbers with nulls: without a cutoff there is nothing to call
    return made.select("rk", "method", r("value", 5).alias("value"), *[F.col(c).cast("int").cast("double").alias(c) for c in ("significant", "n_significant")])


@_query(end(_MT, PAIRS, TAU, _ACTIVE, _FISHER, _ME_RANKED))
def method_tables_me(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of each method and how many it calls; which pairs tie in value depends on the last digits, so ranks have values."""
    return _method_tables(spark, sf_dir, "ME", {"rho": -0.01})


@_query(end(_MT, PAIRS, TAU, _ACTIVE, _FISHER, _CO_RANKED))
def method_tables_co(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _method_tables(spark, sf_dir, "CO", {"lrt": 1.5})


@_query(end(f"SELECT rk, {sql_r('sum(hit) OVER (ORDER BY rk) / (2.0::DOUBLE * rk)')} AS share FROM (SELECT rk, (NOT " + _DRIVER.format(f="a") + ")::INT + (NOT " + _DRIVER.format(f="b") + ")::INT AS hit FROM mt WHERE method = 'rho' AND rk <= 50)", PAIRS, TAU, _ACTIVE, _FISHER, _ME_RANKED))
def method_passenger_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of a method's first pairs are likely passengers."""
    p = _Parts(spark, sf_dir)
    ranked = calls.rank_by(p.pairs(), "ME", "rho", special.epsilon(p.n))
    passengers = p.totals.where(~_is_driver(F.col("feature"))).select("feature")
    return calls.passenger_curve(ranked, passengers, 50).select("rk", r("share").alias("share"))


@_query(end(f"SELECT {sql_r('sum(hits / p * tp / called)')} AS average_precision FROM (SELECT n11, sum(label)::DOUBLE AS hits, sum(sum(label)) OVER (ORDER BY n11 DESC) AS tp, sum(count(*)) OVER (ORDER BY n11 DESC) AS called, sum(sum(label)) OVER () AS p FROM tl GROUP BY n11)", PAIRS, _TRUTH))
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _Parts(spark, sf_dir).contingency()
    scored = evaluation.labels(t, _truth(t)).withColumn("score", F.col("n11").cast("double"))
    return evaluation.average_precision(scored, []).select(r("average_precision").alias("average_precision"))


@_query(end(f"SELECT rk, {sql_r('tp / p')} AS recall FROM (SELECT row_number() OVER w::INTEGER AS rk, sum(label) OVER w AS tp, sum(label) OVER () AS p FROM tl WINDOW w AS (ORDER BY n11 DESC, a, b)) WHERE rk <= 20", PAIRS, _TRUTH).replace("row_number() OVER w::INTEGER", "(row_number() OVER w)::INTEGER"))
def recall_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _Parts(spark, sf_dir).contingency()
    ranked = evaluation.labels(t, _truth(t)).withColumn("rk", F.row_number().over(Window.orderBy(F.desc("n11"), "a", "b")))
    return evaluation.recall_at(ranked, 20).select("rk", r("recall").alias("recall"))


# networks: each priority's ten most frequent pairs under one of two backgrounds


_RANKS = f"""
cj AS (SELECT cohort, x.feature AS a, y.feature AS b, count(*) AS n11, x.rk + y.rk AS o FROM cc x0 JOIN top x ON x0.feature = x.feature JOIN counts y0 ON y0.sample = x0.sample JOIN top y ON y0.feature = y.feature AND x.rk < y.rk GROUP BY ALL),
cr AS (SELECT cohort, bmr, 'CO' AS direction, a, b, n11, row_number() OVER (PARTITION BY cohort, bmr ORDER BY CASE bmr WHEN 'x' THEN -n11 ELSE o END, a, b)::INTEGER AS rk FROM cj, (VALUES ('x'), ('y')) v(bmr) QUALIFY rk <= 10),
cons AS (SELECT cohort, least(split_part(a, '_', 1), split_part(b, '_', 1)) AS a, greatest(split_part(a, '_', 1), split_part(b, '_', 1)) AS b, list_sort(list(DISTINCT bmr)) AS supported_by, count(DISTINCT bmr) AS n_bmr, min(rk) AS best_rank FROM cr GROUP BY 1, 2, 3),
"""


def _cohort_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``cohort, a, b, o, n11``: the samples of each cohort that have both features, and the sum of the features' ranks."""
    p = _Parts(spark, sf_dir)
    narrow = p.counts.join(p.top.select("feature", "rk"), "feature").select("sample", "feature", "rk").join(tables.sample_cohorts(spark, sf_dir), "sample")
    x, y = narrow.alias("x"), narrow.alias("y")
    return x.join(y, (F.col("x.sample") == F.col("y.sample")) & (F.col("x.rk") < F.col("y.rk"))).groupBy(F.col("x.cohort").alias("cohort"), F.col("x.feature").alias("a"), F.col("y.feature").alias("b"), (F.col("x.rk") + F.col("y.rk")).alias("o")).agg(F.count("*").alias("n11"))


def _ranked_by_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    two = _cohort_pairs(spark, sf_dir).select("*", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("bmr"))
    order = F.when(F.col("bmr") == "x", -F.col("n11")).otherwise(F.col("o"))
    return two.withColumn("rk", F.row_number().over(Window.partitionBy("cohort", "bmr").orderBy(order, "a", "b"))).where("rk <= 10")


def _consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _ranked_by_cohort(spark, sf_dir)
    return networks.consensus(ranked.withColumns({"direction": F.lit("CO"), "rho": F.lit(None).cast("double"), "lrt": F.col("n11").cast("double")}))


@_query(end("SELECT cohort, a, b, array_to_string(supported_by, '|') AS supported_by, n_bmr, best_rank FROM cons", _COHORT, _RANKS))
def consensus_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _consensus(spark, sf_dir).select("cohort", "a", "b", F.array_join("supported_by", "|").alias("supported_by"), "n_bmr", "best_rank")


@_query(end("SELECT CASE WHEN substr(cohort, 1, 1) < '3' THEN 'high' ELSE 'low' END AS \"group\", a, b, count(DISTINCT cohort) AS n_cohorts, array_to_string(list_sort(list_distinct(flatten(list(supported_by)))), '|') AS supported_by, min(best_rank) AS best_rank, CASE (right(a, 1) IN ('2', '4'))::INT + (right(b, 1) IN ('2', '4'))::INT WHEN 0 THEN 'pp' WHEN 1 THEN 'dp' ELSE 'dd' END AS kind FROM cons GROUP BY 1, 2, 3", _COHORT, _RANKS))
def group_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = staged(_consensus(spark, sf_dir).drop("per_bmr"), "consensus")
    groups = edges.select("cohort", F.when(F.substring("cohort", 1, 1) < "3", "high").otherwise("low").alias("group")).distinct()
    genes = edges.select(F.col("a").alias("gene")).union(edges.select("b")).distinct()
    pooled = networks.grouped(edges, groups, genes.where(F.substring("gene", -1, 1).isin("2", "4")))
    return pooled.select("group", "a", "b", "n_cohorts", F.array_join("supported_by", "|").alias("supported_by"), "best_rank", "kind")


_BMR_JSON = """'"' || bmr || '":{"rk":' || rk || ',"lrt":' || n11 || '.0}'"""
_ATLAS = f"""
cl AS (SELECT cohort, least(split_part(a, '_', 1), split_part(b, '_', 1)) AS a, greatest(split_part(a, '_', 1), split_part(b, '_', 1)) AS b, bmr, arg_max(n11, rk) AS n11, max(rk) AS rk, min(rk) AS best FROM cr GROUP BY 1, 2, 3, 4),
ce AS (SELECT cohort, a, b, count(*) AS n_bmr, min(best) AS best_rank, to_json(list(bmr ORDER BY bmr)) AS supported, to_json('{{' || string_agg({_BMR_JSON}, ',' ORDER BY bmr) || '}}') AS per_bmr FROM cl GROUP BY cohort, a, b),
"""


@_query(end("""SELECT cohort, '{"cohort":' || to_json(cohort) || ',"ME":[],"CO":[' || string_agg('{"order":' || -n_bmr || ',"best_rank":' || best_rank || ',"a":' || to_json(a) || ',"b":' || to_json(b) || ',"supported_by":' || supported || ',"per_bmr":' || per_bmr || '}', ',' ORDER BY n_bmr DESC, best_rank, a, b) || ']}' AS record FROM ce GROUP BY cohort""", _COHORT, _RANKS, _ATLAS))
def atlas_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.as_json(_consensus(spark, sf_dir))


@_query(end("SELECT least(a, b) AS a, greatest(a, b) AS b, kind FROM (SELECT a, b, 'ME' AS kind, 0 AS o, rk FROM rme WHERE rk <= 10 UNION ALL SELECT a, b, 'CO', 1, rk FROM rco WHERE rk <= 10)", PAIRS, TAU, _ACTIVE))
def network_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    found, eps = p.pairs(), special.epsilon(p.n)
    first = lambda d: calls.rank_pairs(found, d, eps).where("rk <= 10")
    return networks.edges(first("ME"), first("CO"))


_RANK2 = "rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE"


@_query(end(f"SELECT {sql_r('corr(x, y)')} AS spearman, count(*) AS n FROM (SELECT {_RANK2.format(c='degree')} AS x, {_RANK2.format(c='total')} AS y FROM (SELECT feature, count(*) AS degree FROM (SELECT a AS feature FROM cont WHERE n11 >= (SELECT median(n11) FROM cont) UNION ALL SELECT b FROM cont WHERE n11 >= (SELECT median(n11) FROM cont)) GROUP BY feature) JOIN totals USING (feature))", PAIRS))
def co_degree_spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    t = staged(p.contingency(), "contingency")
    middle = t.agg(F.median("n11").alias("m"))
    strong = t.crossJoin(F.broadcast(middle)).where("n11 >= m")  # one row is broadcast
    return networks.spearman(networks.degrees(strong).join(p.totals, "feature"), "degree", "total").select(r("spearman").alias("spearman"), "n")


_HALDANE = "median(ln((n11 + 0.5::DOUBLE) * (n00 + 0.5::DOUBLE) / ((n10 + 0.5::DOUBLE) * (n01 + 0.5::DOUBLE))))"


@_query(end(f"SELECT {sql_r(_HALDANE)} AS median_lor, count(*) AS pairs FROM cont", PAIRS))
def median_haldane_lor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.median_log_odds(_Parts(spark, sf_dir).contingency()).select(r("median_lor").alias("median_lor"), "pairs")


@_query(end(f"SELECT {sql_r(_HALDANE)} AS median_lor, count(*) AS pairs FROM cont", PAIRS).replace("size AS (SELECT", "b0 AS (SELECT sample, sum(c) AS burden FROM counts GROUP BY sample), keep AS (SELECT sample FROM b0 WHERE burden < (SELECT quantile_cont(burden, 0.9) FROM b0)), size AS (SELECT", 1).replace("count(DISTINCT sample) AS n FROM counts)", "count(DISTINCT sample) AS n FROM counts WHERE sample IN (SELECT sample FROM keep))", 1).replace("FROM counts JOIN top USING (feature))", "FROM counts JOIN top USING (feature) WHERE sample IN (SELECT sample FROM keep))", 1))
def hypermutator_leverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    top = p.top
    few = staged(p.counts.join(counts.without_top_decile(counts.burden(p.counts)).select("sample"), "sample", "left_semi"), "few")
    joint = staged(fit.joint_counts(few, top), "joint")
    return networks.median_log_odds(fit.contingency(joint, few, top, F.lit(_size(few)))).select(r("median_lor").alias("median_lor"), "pairs")


@_query(end(f"SELECT sum(total)::DOUBLE AS observed, {sql_r('sum(expected * n)', 4)} AS expected, {sql_r('corr(total::DOUBLE, expected * n)')} AS correlation FROM totals JOIN expected USING (feature), size"))
def calibration_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    expected = background.expected(p.pmfs).select(F.col("feature").alias("key"), (F.col("expected") * p.n).alias("expected"))
    both = networks.calibration(p.totals.select(F.col("feature").alias("key"), F.col("total").alias("observed")), expected)
    return both.select("observed", r("expected", 4).alias("expected"), r("correlation").alias("correlation"))


@_query(end(f"SELECT feature, total AS observed, {sql_r('expected * n', 5)} AS expected, {sql_r('total / (expected * n)')} AS ratio FROM totals JOIN expected USING (feature), size"))
def obs_over_exp(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    found = networks.observed_over_expected(p.totals, background.expected(p.pmfs), F.lit(p.n))
    return found.select("feature", "observed", r("expected", 5).alias("expected"), r("ratio").alias("ratio"))


_SHARES = {"low": 0.5, "high": 0.8}
_PI_LOW = PI.replace("cells", "cells_low").replace("em AS", "em_low AS").replace("FROM em ", "FROM em_low ").replace("JOIN em ", "JOIN em_low ").replace("pis AS", "pis_low AS")
_LOW = f"""
pn_low AS (SELECT feature, k, p / sum(p) OVER (PARTITION BY feature) AS p FROM (SELECT feature, k, exp(-rate * 0.625::DOUBLE) * pow(rate * 0.625::DOUBLE, k) / gamma(k + 1) AS p FROM raw, range(0, {K} + 1) t(k))),
pmf_low AS (SELECT feature, list(p ORDER BY k) AS pmf FROM pn_low GROUP BY feature),
cells_low AS (SELECT feature, c, n, CASE WHEN c > {K} THEN 1e-100 ELSE pmf[c + 1] END AS here, CASE WHEN c < 1 THEN 0.0 WHEN c - 1 > {K} THEN 1e-100 ELSE pmf[c] END AS below, c <= {K} AS support FROM hist JOIN pmf_low USING (feature) WHERE n > 0),
"""


@_query(end(f"SELECT bmr, {sql_r('max(pi) FILTER (gene = {0})', 3).format(repr('Brand#13'))} AS pi_of_one, count(DISTINCT gene) FILTER (rn <= 20 AND right(gene, 1) NOT IN ('2', '4'))::INTEGER AS passengers_top FROM (SELECT *, row_number() OVER (PARTITION BY bmr ORDER BY round(pi, 9) DESC, feature) AS rn FROM (SELECT 'high' AS bmr, feature, split_part(feature, '_', 1) AS gene, pi FROM pis UNION ALL SELECT 'low', feature, split_part(feature, '_', 1), pi FROM pis_low)) GROUP BY bmr", PI, _LOW, _PI_LOW))
def bmr_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under backgrounds of two shares of the mean count: a gene's rate, and how many likely passengers are among the highest rates."""
    p = _Parts(spark, sf_dir)
    cells = fit.histogram(p.counts, F.lit(p.n))
    each = [fit.fit_rates(fit.with_pmfs(cells, background.poisson(p.totals, F.lit(p.n), share, K)), n_inits=1).select(F.lit(bmr).alias("bmr"), "feature", F.round("pi", 9).alias("pi")) for bmr, share in _SHARES.items()]
    rates = each[0].unionByName(each[1])
    passengers = p.totals.select(counts.base_gene(F.col("feature")).alias("gene")).where(~F.substring("gene", -1, 1).isin("2", "4")).distinct()
    return reports.sensitivity(rates, "Brand#13", passengers, 20).select("bmr", r("pi_of_one", 3).alias("pi_of_one"), "passengers_top")


@_query(end("SELECT cohort, samples, " + sql_r("median", 1) + " AS median_burden, co_x, co_y FROM (SELECT cohort, count(*) AS samples, median(burden) AS median FROM (SELECT cohort, sample, sum(c) AS burden FROM cc GROUP BY ALL) GROUP BY cohort) JOIN (SELECT cohort, count(*) FILTER (n11 >= 3) AS co_x, count(*) FILTER (o < 40) AS co_y FROM cj GROUP BY cohort) USING (cohort)", _COHORT, _RANKS))
def burden_and_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By cohort the median burden beside the number of co-occurring pairs under each of two rules."""
    kept = _cohort_pairs(spark, sf_dir).select("cohort", F.explode(F.array(F.when(F.col("n11") >= 3, "x"), F.when(F.col("o") < 40, "y"))).alias("bmr")).where("bmr is not null")
    burdens = _by_cohort(spark, sf_dir).groupBy("cohort", "sample").agg(F.sum("c").alias("burden"))
    found = reports.burden_and_pairs(burdens, kept, ["x", "y"])
    return found.select("cohort", "samples", r("median_burden", 1).alias("median_burden"), "co_x", "co_y")


@_query(end("SELECT cohort, bmr, string_agg(split_part(a, '_', 1) || ':' || split_part(b, '_', 1), ', ' ORDER BY rk) FILTER (rk <= 6) AS names FROM cr GROUP BY cohort, bmr", _COHORT, _RANKS))
def top_pair_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first pairs of each cohort and background by name."""
    return reports.top_names(_ranked_by_cohort(spark, sf_dir), 6)


@_query(end(f"SELECT cohort, count(*) FILTER (hit) AS shared, {sql_r('avg(hit::INT)')} AS share FROM (SELECT cohort, right(gene, 1) IN ('2', '4') AS hit, row_number() OVER (PARTITION BY cohort ORDER BY t DESC, gene) AS rn FROM (SELECT cohort, split_part(feature, '_', 1) AS gene, sum(c) AS t FROM cc GROUP BY ALL)) WHERE rn <= 12 GROUP BY cohort", _COHORT))
def top_shared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of each cohort's first genes are in a reference set."""
    sums = _by_cohort(spark, sf_dir).groupBy("cohort", counts.base_gene(F.col("feature")).alias("gene")).agg(F.sum("c").alias("t"))
    tops = sums.withColumn("rn", F.row_number().over(Window.partitionBy("cohort").orderBy(F.desc("t"), "gene"))).where("rn <= 12")
    reference = sums.select("gene").distinct().where(F.substring("gene", -1, 1).isin("2", "4"))
    return reports.shared(tops.select("cohort", "gene"), reference).select("cohort", "shared", r("share").alias("share"))


@_query(end("SELECT cohort, count(DISTINCT sample) AS samples, sum(c)::BIGINT AS events, count(DISTINCT feature) AS features, " + sql_r("sum(c) / count(DISTINCT sample)") + " AS burden FROM cc GROUP BY cohort", _COHORT))
def supp_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_cohort(spark, sf_dir).groupBy("cohort").agg(F.count_distinct("sample").alias("samples"), F.sum("c").alias("events"), F.count_distinct("feature").alias("features"), r(F.sum("c") / F.count_distinct("sample")).alias("burden"))


@_query(end("SELECT burden, count(*) AS n FROM b WHERE burden < 25 GROUP BY burden", _BURDEN))
def burden_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.count_histogram(counts.burden(_counts(spark, sf_dir)), "burden")


@_query(end("SELECT cohort, 'priority ' || lower(substr(cohort, 3)) AS name, count(DISTINCT sample) AS samples, sum(CASE WHEN feature LIKE '%\\_M' ESCAPE '\\' THEN c ELSE 0 END)::BIGINT AS missense, sum(CASE WHEN feature LIKE '%\\_N' ESCAPE '\\' THEN c ELSE 0 END)::BIGINT AS nonsense FROM cc GROUP BY cohort", _COHORT))
def cohort_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = tables.sample_cohorts(spark, sf_dir).select("cohort").distinct().withColumn("name", F.concat(F.lit("priority "), F.lower(F.substring("cohort", 3, 100))))
    return reports.cohort_summary(_by_cohort(spark, sf_dir), names)


@_query(end("SELECT feature, total, substr(feature, 1, instr(feature, '_') - 1) AS gene FROM totals"))
def base_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.totals(_counts(spark, sf_dir)).withColumn("gene", counts.base_gene(F.col("feature")))


@_query(end("SELECT CASE WHEN x.rk < o.rk THEN x.feature ELSE o.feature END AS a, CASE WHEN x.rk < o.rk THEN o.feature ELSE x.feature END AS b FROM ranked o, (SELECT * FROM ranked WHERE feature = 'Brand#11_M') x WHERE o.feature <> x.feature"))
def pairs_of_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fit.pairs_with("Brand#11_M", counts.ranked(counts.totals(_counts(spark, sf_dir))))


@_query(end("SELECT a, b, t00 + t01 + t10 + t11 BETWEEN 0.99 AND 1.01 AND t11 <> 1 AS valid FROM taus", PAIRS, TAU))
def valid_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _Parts(spark, sf_dir).pairs().select("a", "b", reports.is_distribution().alias("valid"))


@_query(end("SELECT count(*) FILTER (q < 0.5 AND direction = 'CO') AS co, count(*) FILTER (q < 0.5 AND direction = 'ME') AS me, " + sql_r("(SELECT median(burden) FROM b)") + " AS median FROM called", _BURDEN, PAIRS, TAU, CALLS))
def supplement_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    called = calls.pair_calls(p.pairs(), 0.5).withColumn("bmr", F.lit("poisson"))
    return reports.supplement(called, counts.burden(p.counts)).select("co", "me", r("median").alias("median"))


@_query(end("SELECT rk, method, round(v, 5) + 0.0 AS value FROM (SELECT rk, 'rho' AS method, rho AS v FROM rme WHERE rk <= 5 UNION ALL SELECT rk, 'lrt', lrt FROM rco WHERE rk <= 5)", PAIRS, TAU, _ACTIVE))
def top_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    found, eps = p.pairs(), special.epsilon(p.n)
    one = lambda d, c: calls.rank_pairs(found, d, eps).where("rk <= 5").select("rk", F.lit(c).alias("method"), r(c, 5).alias("value"))
    return one("ME", "rho").unionByName(one("CO", "lrt"))


# what SQL can't express


@_query()
def burden_aware_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    conditioned = baselines.burden_conditioned(p.counts, p.top, counts.burden(p.counts))
    return baselines.burden_aware(conditioned, p.contingency())


@_query()
def burden_explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return baselines.explained_by_burden(baselines.burden_conditioned(p.counts, p.top, counts.burden(p.counts)))


@_query()
def eval_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf = simulation.binomial_pmf(10_000, 1e-5)
    fits = evaluation.simulated_features(simulation.single(spark, pmf, 0.1, 1000, 20), pmf, 1000)
    return evaluation.error_summary(fits, F.lit(0.1))


@_query()
def eval_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf, tau = simulation.binomial_pmf(10_000, 1e-5), (0.7, 0.1, 0.1, 0.1)
    return evaluation.joint_error(evaluation.simulated_pairs(simulation.pair(spark, pmf, pmf, tau, 1000, 20), pmf, pmf), tau)


@_query()
def sim_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simulation.single(spark, simulation.binomial_pmf(10_000, 1e-5), 0.1, 1000, 20)


@_query()
def sim_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    pmf = simulation.binomial_pmf(10_000, 1e-5)
    return simulation.pair(spark, pmf, pmf, (0.7, 0.1, 0.1, 0.1), 1000, 20, 0.8)


@_query()
def sim_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    names = [x.feature for x in counts.top(p.totals, 40).orderBy("rk").collect()]
    return simulation.matrix(p.pmfs, names[:12], names[20:40], 3, 3, 500, 0.05, 0.15)[0]


@_query()
def maxent_background(spark: SparkSession, sf_dir: str) -> DataFrame:
    return background.max_entropy_background(_counts(spark, sf_dir))


@_query()
def logit_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    return baselines.burden_conditioned(p.counts, p.top, counts.burden(p.counts))


@_query()
def discover_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    sums = staged(counts.sample_sums(p.counts, p.top), "sums")
    p.n = sums.agg(F.sum("n")).first()[0] or 0  # in place of another pass over the counts
    return baselines.overlap_by_margins(staged(p.contingency(), "tables"), sums)


_LL = "n11 * ln(greatest(g * (a_ + b_) / 2 + (1 - g) * a_ * b_, 1e-300)) + n10 * ln(greatest(g * (1 - b_) / 2 + (1 - g) * a_ * (1 - b_), 1e-300)) + n01 * ln(greatest(g * (1 - a_) / 2 + (1 - g) * (1 - a_) * b_, 1e-300)) + n00 * ln(greatest((1 - g) * (1 - a_) * (1 - b_), 1e-300))"
_MEGSA = f"""
mg0 AS (SELECT a, b, n11::DOUBLE AS n11, n10::DOUBLE AS n10, n01::DOUBLE AS n01, n00::DOUBLE AS n00, (n11 + n10 + n01 + n00)::DOUBLE AS n FROM cont),
mgn AS (SELECT *, {_LL} AS ll0 FROM (SELECT *, 0::DOUBLE AS g, (n11 + n10) / n AS a_, (n11 + n01) / n AS b_ FROM mg0)),
mg AS (SELECT a, b, n11, n10, n01, n00, n, ll0, 0 AS it, (n10 + n01) / n AS g, a_ / 2 AS a_, b_ / 2 AS b_, ll0 AS best, false AS done FROM mgn
  UNION ALL
  SELECT a, b, n11, n10, n01, n00, n, ll0, it + 1, g, a_, b_, CASE WHEN abs(ll - best) < 1e-10 THEN best ELSE ll END, abs(ll - best) < 1e-10 FROM (
    SELECT *, {_LL} AS ll FROM (
      SELECT a, b, n11, n10, n01, n00, n, ll0, it, best, (ba + bb) / n AS g, (n11 + n10 - ba) / greatest(n - ba, 1e-9) AS a_, (n11 + n01 - bb) / greatest(n - bb, 1e-9) AS b_ FROM (
        SELECT *, n11 * g * b_ / 2 / s11 + n10 * g * (1 - b_) / 2 / s10 AS ba, n11 * g * a_ / 2 / s11 + n01 * g * (1 - a_) / 2 / s01 AS bb FROM (
          SELECT *, CASE WHEN n11 > 0 THEN g * (a_ + b_) / 2 + (1 - g) * a_ * b_ ELSE 1 END AS s11, CASE WHEN n10 > 0 THEN g * (1 - b_) / 2 + (1 - g) * a_ * (1 - b_) ELSE 1 END AS s10, CASE WHEN n01 > 0 THEN g * (1 - a_) / 2 + (1 - g) * (1 - a_) * b_ ELSE 1 END AS s01
          FROM mg WHERE NOT done AND it < 2000))))),
ms AS (SELECT a, b, greatest(0, 2 * (greatest(arg_max(best, it), any_value(ll0)) - any_value(ll0))) AS s FROM mg GROUP BY a, b),
mp AS (SELECT a, b, s, {CHI2.format(x='s')} / 2 AS p FROM ms),
"""


@_query(end(f"SELECT a, b, {sql_r('s', 4)} AS s, {sql_r('p', 4)} AS p FROM mp", PAIRS, _MEGSA))
def megsa_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baselines.exclusivity_test(_Parts(spark, sf_dir).contingency()).select("a", "b", r("s", 4).alias("s"), r("p", 4).alias("p"))


@_query()
def wesme_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _Parts(spark, sf_dir)
    sums = p.counts.groupBy("sample").agg(F.count("*").alias("sample_sum")).groupBy("sample_sum").agg(F.count("*").alias("n"))
    return baselines.weighted_test(p.contingency(), sums)
