"""DuckDB SQL of the registered queries, put together from shared parts."""

from __future__ import annotations

#: As many features as the verbs take unless told otherwise.
TOP = 100
K = 8
EPS_N = 3.0902323061678132**2

BASE = f"""
WITH RECURSIVE ev AS (SELECT l_orderkey AS sample, p_brand AS gene, CASE l_returnflag WHEN 'A' THEN 'missense' WHEN 'R' THEN 'nonsense' ELSE 'silent' END AS effect
  FROM lineitem JOIN part ON l_partkey = p_partkey),
counts AS (SELECT sample, gene || '_' || upper(substr(effect, 1, 1)) AS feature, count(*) AS c FROM ev WHERE effect IN ('missense', 'nonsense') GROUP BY ALL),
size AS (SELECT count(DISTINCT sample) AS n FROM counts),
totals AS (SELECT feature, sum(c)::BIGINT AS total FROM counts GROUP BY feature),
ranked AS (SELECT feature, total, row_number() OVER (ORDER BY total DESC, feature)::INTEGER AS rk FROM totals),
top AS (SELECT * FROM ranked WHERE rk <= {TOP}),
raw AS (SELECT feature, 0.8::DOUBLE * total / n AS rate FROM totals, size),
pk AS (SELECT feature, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM raw, range(0, {K} + 1) t(k)),
pn AS (SELECT feature, k, p / sum(p) OVER (PARTITION BY feature) AS p FROM pk),
pmf AS (SELECT feature, list(p ORDER BY k) AS pmf FROM pn GROUP BY feature),
expected AS (SELECT feature, sum(k * p) AS expected FROM pn GROUP BY feature),
h1 AS (SELECT feature, c, count(*) AS n FROM counts GROUP BY ALL),
hist AS (SELECT * FROM h1 UNION ALL SELECT feature, 0, (SELECT n FROM size) - sum(n)::BIGINT FROM h1 GROUP BY feature),
cells AS (SELECT feature, c, n, CASE WHEN c > {K} THEN 1e-100 ELSE pmf[c + 1] END AS here, CASE WHEN c < 1 THEN 0.0 WHEN c - 1 > {K} THEN 1e-100 ELSE pmf[c] END AS below, c <= {K} AS support FROM hist JOIN pmf USING (feature) WHERE n > 0),
"""
PAIRS = """
tc AS (SELECT sample, feature, rk, c FROM counts JOIN top USING (feature)),
pairs AS (SELECT x.feature AS a, y.feature AS b, x.rk AS rk_a, y.rk AS rk_b FROM top x JOIN top y ON x.rk < y.rk),
j AS (SELECT x.feature AS a, y.feature AS b, x.c AS ca, y.c AS cb, count(*) AS n FROM tc x JOIN tc y ON x.sample = y.sample AND x.rk < y.rk GROUP BY ALL),
hits AS (SELECT feature, count(*) AS m FROM tc GROUP BY feature),
both_ AS (SELECT a, b, sum(n)::BIGINT AS n11 FROM j GROUP BY ALL),
cont AS (SELECT p.a, p.b, coalesce(n11, 0) AS n11, ha.m - coalesce(n11, 0) AS n10, hb.m - coalesce(n11, 0) AS n01, (SELECT n FROM size) - ha.m - hb.m + coalesce(n11, 0) AS n00
  FROM pairs p JOIN hits ha ON p.a = ha.feature JOIN hits hb ON p.b = hb.feature LEFT JOIN both_ t ON t.a = p.a AND t.b = p.b),
one AS (SELECT feature, c, count(*) AS m FROM tc GROUP BY ALL),
ja AS (SELECT a, b, ca AS c, sum(n) AS n FROM j GROUP BY ALL),
jb AS (SELECT a, b, cb AS c, sum(n) AS n FROM j GROUP BY ALL),
seen AS (SELECT a, b, ca, cb, n FROM j
  UNION ALL SELECT p.a, p.b, o.c, 0, o.m - coalesce(ja.n, 0) FROM pairs p JOIN one o ON o.feature = p.a LEFT JOIN ja ON ja.a = p.a AND ja.b = p.b AND ja.c = o.c
  UNION ALL SELECT p.a, p.b, 0, o.c, o.m - coalesce(jb.n, 0) FROM pairs p JOIN one o ON o.feature = p.b LEFT JOIN jb ON jb.a = p.a AND jb.b = p.b AND jb.c = o.c),
ph AS (SELECT a, b, ca, cb, n::BIGINT AS n FROM (SELECT * FROM seen UNION ALL SELECT p.a, p.b, 0, 0, (SELECT n FROM size) - coalesce(sum(s.n), 0) FROM pairs p LEFT JOIN seen s ON s.a = p.a AND s.b = p.b GROUP BY p.a, p.b) WHERE n > 0),
"""
_P = f"CASE WHEN {{c}} > {K} THEN 1e-100 ELSE {{p}}[{{c}} + 1] END"
_Q = f"CASE WHEN {{c}} < 1 THEN 0.0 WHEN {{c}} - 1 > {K} THEN 1e-100 ELSE {{p}}[{{c}}] END"
PI = """
em AS (SELECT feature, 0 AS it, 0.5::DOUBLE AS pi, false AS done FROM totals
  UNION ALL
  SELECT feature, it + 1, CASE WHEN abs(l1 - l0) < 1e-3 THEN pi ELSE pi1 END, abs(l1 - l0) < 1e-3 FROM (
    SELECT feature, it, pi, pi1, sum(n * ln(here * (1 - pi1) + below * pi1)) AS l1, sum(n * ln(here * (1 - pi) + below * pi)) AS l0 FROM (
      SELECT e.feature, it, pi, n, here, below, sum(CASE WHEN support THEN n * (pi * below) / (pi * below + (1 - pi) * here) END) OVER (PARTITION BY e.feature) / sum(CASE WHEN support THEN n END) OVER (PARTITION BY e.feature) AS pi1
      FROM em e JOIN cells USING (feature) WHERE NOT done AND it < 1000) GROUP BY feature, it, pi, pi1)),
pis AS (SELECT feature, pi FROM em WHERE done),
"""
SINGLE = """
lr AS (SELECT feature, pi, -2 * (sum(n * ln(here)) - sum(n * ln(here * (1 - pi) + below * pi))) AS lrt FROM pis JOIN cells USING (feature) GROUP BY feature, pi),
single AS (SELECT feature, pi, CASE WHEN pi > 0 AND pi < 1 THEN ln(pi / (1 - pi)) END AS lor, lrt, total AS observed, expected, total - expected AS excess FROM lr JOIN totals USING (feature) JOIN expected USING (feature)),
"""
_SIDES = f"""{_P.format(c="ca", p="pa.pmf")} AS a0, {_Q.format(c="ca", p="pa.pmf")} AS a1, {_P.format(c="cb", p="pb.pmf")} AS b0, {_Q.format(c="cb", p="pb.pmf")} AS b1"""
CELLS = f"""
pc AS (SELECT h.a, h.b, ca, cb, n, {_SIDES} FROM ph h JOIN pmf pa ON pa.feature = h.a JOIN pmf pb ON pb.feature = h.b),
"""
_EM = """
te AS (SELECT a, b, 0 AS it, 0.25::DOUBLE AS t00, 0.25::DOUBLE AS t01, 0.25::DOUBLE AS t10, 0.25::DOUBLE AS t11, false AS done FROM pairs
  UNION ALL
  SELECT a, b, it + 1, if(stop, t00, u00), if(stop, t01, u01), if(stop, t10, u10), if(stop, t11, u11), stop FROM (
    SELECT a, b, it, t00, t01, t10, t11, u00, u01, u10, u11,
      abs(sum(n * ln(a0 * b0 * u00 + a0 * b1 * u01 + a1 * b0 * u10 + a1 * b1 * u11)) - sum(n * ln(a0 * b0 * t00 + a0 * b1 * t01 + a1 * b0 * t10 + a1 * b1 * t11))) < 1e-3 AS stop
    FROM (SELECT *, sum(n * a0 * b0 * t00 / w) OVER p / sum(n) OVER p AS u00, sum(n * a0 * b1 * t01 / w) OVER p / sum(n) OVER p AS u01, sum(n * a1 * b0 * t10 / w) OVER p / sum(n) OVER p AS u10, sum(n * a1 * b1 * t11 / w) OVER p / sum(n) OVER p AS u11
      FROM (SELECT e.*, c.n, a0, a1, b0, b1, a0 * b0 * t00 + a0 * b1 * t01 + a1 * b0 * t10 + a1 * b1 * t11 AS w FROM te e JOIN pc c ON e.a = c.a AND e.b = c.b WHERE NOT done AND it < 1000)
      WINDOW p AS (PARTITION BY a, b))
    GROUP BY a, b, it, t00, t01, t10, t11, u00, u01, u10, u11)),
taus AS (SELECT a, b, t00, t01, t10, t11 FROM te WHERE done),
tn AS (SELECT *, (t00 + t01) * (t00 + t10) AS n00_, (t00 + t01) * (t01 + t11) AS n01_, (t10 + t11) * (t00 + t10) AS n10_, (t10 + t11) * (t01 + t11) AS n11_ FROM taus),
pl AS (SELECT a, b, -2 * (sum(n * ln(a0 * b0 * n00_ + a0 * b1 * n01_ + a1 * b0 * n10_ + a1 * b1 * n11_)) - sum(n * ln(a0 * b0 * t00 + a0 * b1 * t01 + a1 * b0 * t10 + a1 * b1 * t11))) AS lrt FROM tn JOIN pc USING (a, b) GROUP BY a, b),
stats AS (SELECT a, b, t00, t10, t01, t11, n11, n10, n01, n00, t10 + t11 AS t1x, t01 + t11 AS tx1,
  CASE WHEN (t00 + t01) * (t10 + t11) * (t00 + t10) * (t01 + t11) > 0 THEN (t11 * t00 - t01 * t10) / sqrt((t00 + t01) * (t10 + t11) * (t00 + t10) * (t01 + t11)) END AS rho,
  CASE WHEN t01 * t10 > 0 AND t00 * t11 > 0 THEN ln(t01 * t10 / (t00 * t11)) END AS lor,
  CASE WHEN t00 > 0 AND t01 > 0 AND t10 > 0 AND t11 > 0 THEN ln(t01 * t10 / (t00 * t11)) / sqrt(1 / t00 + 1 / t01 + 1 / t10 + 1 / t11) END AS wald, lrt FROM taus JOIN cont USING (a, b) JOIN pl USING (a, b)),
"""
TAU = CELLS + _EM

#: Backgrounds by class: samples of one burden, with the rate of a feature in proportion to it.
CLASSES = """
b AS (SELECT sample, sum(c)::BIGINT AS burden FROM counts GROUP BY sample),
bn AS (SELECT burden AS class, count(*) AS size FROM b GROUP BY burden),
most AS (SELECT max(c) AS kmax FROM counts),
lam AS (SELECT feature, class, greatest(expected * class / (SELECT avg(burden) FROM b), 1e-9) AS rate FROM expected, bn),
ck AS (SELECT feature, class, k, exp(-rate) * pow(rate, k) / gamma(k + 1) AS p FROM lam, (SELECT unnest(range(0, kmax + 1)) AS k FROM most)),
cp AS (SELECT feature, class, list(p ORDER BY k) AS pmf FROM (SELECT feature, class, k, p / sum(p) OVER (PARTITION BY feature, class) AS p FROM ck) GROUP BY feature, class),
"""
CLASS_PI = """
ch AS (SELECT feature, burden AS class, c, count(*) AS n FROM counts JOIN b USING (sample) GROUP BY ALL),
czero AS (SELECT f.feature, bn.class, 0 AS c, size - coalesce((SELECT sum(n) FROM ch WHERE ch.feature = f.feature AND ch.class = bn.class), 0)::BIGINT AS n FROM totals f, bn),
ccells AS (SELECT feature, class, c, n, pmf[c + 1] AS here, CASE WHEN c < 1 THEN 0.0 ELSE pmf[c] END AS below, true AS support FROM (SELECT * FROM ch UNION ALL SELECT * FROM czero) JOIN cp USING (feature, class) WHERE n > 0),
""" + PI.replace("cells", "ccells")
CLASS_CELLS = """
cfill AS (SELECT p.a, p.b, s.burden AS class, coalesce(x.c, 0) AS ca, coalesce(y.c, 0) AS cb FROM pairs p CROSS JOIN b s
  LEFT JOIN tc x ON x.sample = s.sample AND x.feature = p.a LEFT JOIN tc y ON y.sample = s.sample AND y.feature = p.b),
cph AS (SELECT a, b, class, ca, cb, count(*) AS n FROM cfill GROUP BY ALL),
pc AS (SELECT h.a, h.b, ca, cb, n, pa.pmf[ca + 1] AS a0, CASE WHEN ca < 1 THEN 0.0 ELSE pa.pmf[ca] END AS a1, pb.pmf[cb + 1] AS b0, CASE WHEN cb < 1 THEN 0.0 ELSE pb.pmf[cb] END AS b1
  FROM cph h JOIN cp pa ON pa.feature = h.a AND pa.class = h.class JOIN cp pb ON pb.feature = h.b AND pb.class = h.class),
"""


def _fold(key: str, values: str) -> str:
    """The best of the starts in turn: a better one must gain a thousandth, and after three that don't the rest aren't tried."""
    k, names = key.split(", "), values.split(", ")
    on = " AND ".join(f"x.{c} = f.{c}" for c in k)
    best = ", ".join(f"CASE WHEN x.ll > f.top + 1e-3 THEN x.{v} ELSE f.{v} END" for v in names)
    return f"""
fold AS (SELECT {key}, 0 AS i, {values}, ll AS top, 0 AS stale, 1 AS used FROM fin WHERE i = 0
  UNION ALL SELECT {", ".join("f." + c for c in k)}, f.i + 1, {best}, CASE WHEN x.ll > f.top + 1e-3 THEN x.ll ELSE f.top END, CASE WHEN x.ll > f.top + 1e-3 THEN 0 ELSE f.stale + 1 END, f.used + 1
  FROM fold f JOIN fin x ON {on} AND x.i = f.i + 1 WHERE f.stale < 3),
"""


def pi_restarts(starts: list[float]) -> str:
    """``fold`` with the rate from each of the starts in turn; its last row by feature is the result."""
    rows = ", ".join(f"({i}, {x!r}::DOUBLE)" for i, x in enumerate(starts))
    return f"""
em AS (SELECT feature, i, 0 AS it, pi, false AS done FROM totals, (VALUES {rows}) v(i, pi)
  UNION ALL
  SELECT feature, i, it + 1, CASE WHEN abs(l1 - l0) < 1e-3 THEN pi ELSE pi1 END, abs(l1 - l0) < 1e-3 FROM (
    SELECT feature, i, it, pi, pi1, sum(n * ln(here * (1 - pi1) + below * pi1)) AS l1, sum(n * ln(here * (1 - pi) + below * pi)) AS l0 FROM (
      SELECT e.feature, i, it, pi, n, here, below, sum(CASE WHEN support THEN n * (pi * below) / (pi * below + (1 - pi) * here) END) OVER w / sum(CASE WHEN support THEN n END) OVER w AS pi1
      FROM em e JOIN cells USING (feature) WHERE NOT done AND it < 1000 WINDOW w AS (PARTITION BY e.feature, i)) GROUP BY feature, i, it, pi, pi1)),
fin AS (SELECT e.feature, i, pi, sum(n * ln(here * (1 - pi) + below * pi)) AS ll FROM em e JOIN cells USING (feature) WHERE done GROUP BY e.feature, i, pi),
""" + _fold("feature", "pi")


def tau_restarts(starts: list[list[float]]) -> str:
    """The same for the joint rates of pairs."""
    rows = ", ".join(f"({i}, {', '.join(f'{x!r}::DOUBLE' for x in t)})" for i, t in enumerate(starts))
    em = _EM[: _EM.index("taus AS (")]
    em = em.replace("te AS (SELECT a, b, 0 AS it, 0.25::DOUBLE AS t00, 0.25::DOUBLE AS t01, 0.25::DOUBLE AS t10, 0.25::DOUBLE AS t11, false AS done FROM pairs", f"te AS (SELECT a, b, i, 0 AS it, t00, t01, t10, t11, false AS done FROM pairs, (VALUES {rows}) v(i, t00, t01, t10, t11)")
    em = em.replace("SELECT a, b, it", "SELECT a, b, i, it").replace("GROUP BY a, b, it", "GROUP BY a, b, i, it").replace("PARTITION BY a, b)", "PARTITION BY a, b, i)")
    mixed = "a0 * b0 * t00 + a0 * b1 * t01 + a1 * b0 * t10 + a1 * b1 * t11"
    return CELLS + em + f"fin AS (SELECT e.a, e.b, i, t00, t01, t10, t11, sum(n * ln({mixed})) AS ll FROM te e JOIN pc c ON e.a = c.a AND e.b = c.b WHERE done GROUP BY ALL)," + _fold("a, b", "t00, t01, t10, t11")


#: The tail of chi-squared with one degree of freedom from a series of erf; 0 beyond 72.
CHI2 = "CASE WHEN {x} IS NULL THEN NULL WHEN {x} > 72 THEN 0.0 ELSE 1 - 2 / sqrt(pi()) * exp(-greatest({x}, 0) / 2) * list_sum(list_transform(range(0, 140), lambda k: exp(k * ln(2.0) + (2 * k + 1) * ln(greatest(sqrt(greatest({x}, 0) / 2), 1e-30)) - (lgamma(2 * k + 2) - k * ln(2.0) - lgamma(k + 1))))) END"
CALLS = f"""
tested AS (SELECT *, {CHI2.format(x="lrt")} AS p FROM stats),
prank AS (SELECT *, row_number() OVER (ORDER BY p, a, b) AS rn, count(*) OVER () AS m FROM tested),
called AS (SELECT *, least(1.0, min(p * m / rn) OVER (ORDER BY rn DESC)) AS q, CASE WHEN rho < 0 THEN 'ME' ELSE 'CO' END AS direction FROM prank),
"""


def end(sql: str, *parts: str) -> str:
    """A query after the shared parts."""
    return (BASE + "".join(parts)).rstrip().rstrip(",") + "\n" + sql


def r(x: str, digits: int = 6) -> str:
    return f"round(({x})::DOUBLE, {digits}) + 0.0"
