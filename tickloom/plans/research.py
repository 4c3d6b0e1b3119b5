"""Queries of factors, stat-arb, regimes, portfolios, validation, meta-labels and performance."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.functions.numeric import normal_cdf_sql, normal_ppf, rows
from tickloom.functions.running import running
from tickloom.operators import factors as X
from tickloom.operators import meta as L
from tickloom.operators import perf as A
from tickloom.operators import portfolio as P
from tickloom.operators import regime as G
from tickloom.operators import statarb as R
from tickloom.operators import validate as V
from tickloom.operators import windows as W
from tickloom.plans import base
from tickloom.plans.base import EQ, PANEL, RET, TR, TS, XS, iso, q6, r6
from tickloom.session import cut_lineage, load

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ------------------------------------------------------------------ factor stack

_Z = "CASE WHEN stddev_pop({0}_w) OVER d = 0 THEN 0 ELSE ({0}_w - avg({0}_w) OVER d) / stddev_pop({0}_w) OVER d END"
_LIM = "list_sort(list({0})) AS v_{0}"
_CLAMP = "least(greatest({0}, v_{0}[least(CAST(floor(len(v_{0}) * 0.01) AS INT) + 1, len(v_{0}))]), v_{0}[least(CAST(floor(len(v_{0}) * 0.99) AS INT) + 1, len(v_{0}))]) AS {0}_w"


@query(f"""WITH {XS}, lm AS (SELECT date, {', '.join(_LIM.format(f) for f in ('f1', 'f2', 'f3'))} FROM xs GROUP BY date), wz AS (SELECT xs.date, symbol, {', '.join(_CLAMP.format(f) for f in ('f1', 'f2', 'f3'))} FROM xs JOIN lm USING (date))
 SELECT date, symbol, round(0.5 * {_Z.format('f1')} + 0.3 * {_Z.format('f2')} + 0.2 * {_Z.format('f3')}, 6) + 0.0 AS alpha FROM wz WINDOW d AS (PARTITION BY date)""")
def f1_composite_alpha(spark: SparkSession, d: str) -> DataFrame:
    return X.composite_alpha(base.cross_section(spark, d), {"f1": 0.5, "f2": 0.3, "f3": 0.2}).select("date", "symbol", *r6("alpha"))


def _clamp_sql(src: str, by: str) -> str:
    at = lambda c, q: f"v_{c}[least(CAST(floor(len(v_{c}) * {q}) AS INT) + 1, len(v_{c}))]"
    cols = ("f1", "f2", "ret")
    clamped = ", ".join(f"least(greatest({c}, {at(c, 0.01)}), {at(c, 0.99)}) AS {c}" for c in cols)
    return f"lim_ AS (SELECT {by}, {', '.join(f'list_sort(list({c})) AS v_{c}' for c in cols)} FROM {src} GROUP BY 1), cl_ AS (SELECT s.* REPLACE ({clamped}) FROM (SELECT * FROM {src} JOIN lim_ USING ({by})) s)"


def _two_sql(src: str, by: str) -> str:
    return f"""{_clamp_sql(src, by)}, sm AS (SELECT {by}, count(*) AS n, sum(f1 * f1) AS aa, sum(f1 * f2) AS ab, sum(f2 * f2) AS bb, sum(f1 * ret) AS ay, sum(f2 * ret) AS by_, sum(ret * ret) AS yy, sum(ret) AS sy FROM cl_ GROUP BY 1),
 b AS (SELECT *, (ay * bb - by_ * ab) / nullif(aa * bb - ab * ab, 0) AS b1, (by_ * aa - ay * ab) / nullif(aa * bb - ab * ab, 0) AS b2, yy - sy * sy / n AS tss FROM sm), fit AS (SELECT *, yy - b1 * ay - b2 * by_ AS rss FROM b)"""


@query(f"WITH {XS}, {_two_sql('xs', 'date')} SELECT date, n, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2, round(1 - rss / nullif(tss, 0), 6) + 0.0 AS r2, round(b1 / nullif(sqrt(greatest(rss, 0) / nullif(n - 2, 0) / aa), 0), 5) + 0.0 AS t1, round(b2 / nullif(sqrt(greatest(rss, 0) / nullif(n - 2, 0) / bb), 0), 5) + 0.0 AS t2, round(1 - (yy - ay * ay / aa) / nullif(tss, 0), 6) + 0.0 AS r2_1 FROM fit")
def f2_f4_regression(spark: SparkSession, d: str) -> DataFrame:
    return X.regress_two(base.cross_section(spark, d), "ret", "f1", "f2", "date").select("date", "n", *r6("b1", "b2", "r2"), *r6("t1", "t2", digits=5), *r6("r2_1"))


def _three_sql() -> str:
    at = lambda c, q: f"v_{c}[least(CAST(floor(len(v_{c}) * {q}) AS INT) + 1, len(v_{c}))]"
    cols, xs = ("f1", "f2", "f3", "ret"), ("f1", "f2", "f3")
    clamped = ", ".join(f"least(greatest({c}, {at(c, 0.01)}), {at(c, 0.99)}) AS {c}" for c in cols)
    sums = ", ".join(f"sum({a} * {b}) AS {a}{b}" for i, a in enumerate(xs) for b in (*xs[i:], "ret"))
    det = lambda m: f"({m[0]} * ({m[4]} * {m[8]} - {m[5]} * {m[7]}) - {m[1]} * ({m[3]} * {m[8]} - {m[5]} * {m[6]}) + {m[2]} * ({m[3]} * {m[7]} - {m[4]} * {m[6]}))"
    x = ["f1f1", "f1f2", "f1f3", "f1f2", "f2f2", "f2f3", "f1f3", "f2f3", "f3f3"]
    y = ["f1ret", "f2ret", "f3ret"]
    beta = [f"round({det([y[i // 3] if i % 3 == k else x[i] for i in range(9)])} / {det(x)}, 5) + 0.0 AS b{k + 1}" for k in range(3)]
    return f"""WITH {XS}, lim_ AS (SELECT date, {', '.join(f'list_sort(list({c})) AS v_{c}' for c in cols)} FROM xs GROUP BY 1), cl_ AS (SELECT s.* REPLACE ({clamped}) FROM (SELECT * FROM xs JOIN lim_ USING (date)) s), sm AS (SELECT date, count(*) AS n, {sums} FROM cl_ GROUP BY date)
 SELECT date, n, {', '.join(beta)} FROM sm WHERE n >= 10"""


@query(_three_sql())
def f2_three_factors(spark: SparkSession, d: str) -> DataFrame:
    """Dates of at least ten names: below that three factors nearly explain the returns, and two solvers differ in the last digits."""
    b = X.regress_many(base.cross_section(spark, d), "ret", ["f1", "f2", "f3"], "date").where("n >= 10")
    return b.select("date", "n", *[(F.round(F.col("betas")[i], 5) + F.lit(0.0)).alias(f"b{i + 1}") for i in range(3)])


@query()
def f2_many_factors(spark: SparkSession, d: str) -> DataFrame:
    return X.regress_many(base.cross_section(spark, d), "ret", ["f1", "f2", "f3"], "date")


@query(f"WITH {XS}, {_two_sql('xs', 'date')} SELECT cl_.date, symbol, round(ret - b1 * f1 - b2 * f2, 6) + 0.0 AS resid FROM cl_ JOIN fit ON cl_.date = fit.date")
def f5_residuals(spark: SparkSession, d: str) -> DataFrame:
    x = base.cross_section(spark, d)
    fit = X.regress_two(x, "ret", "f1", "f2", "date")
    return X.residuals(x, fit, "ret", "f1", "f2", "date").select("date", "symbol", *r6("resid"))


_BLOCKS = f"{XS}, nb AS (SELECT *, (row_number() OVER (PARTITION BY symbol ORDER BY date) - 1) // 20 AS block FROM xs), fb AS (SELECT * FROM (SELECT *, CAST(symbol AS VARCHAR) || '|' || CAST(block AS VARCHAR) AS cell, count(*) OVER (PARTITION BY symbol, block) AS c FROM nb) WHERE c = 20), {_two_sql('fb', 'cell')}"


def _blocks(spark: SparkSession, d: str) -> DataFrame:
    b = X.row_blocks(base.cross_section(spark, d), ["date"], 20, by="symbol").withColumn("cell", F.concat_ws("|", "symbol", "block"))
    return X.regress_two(b, "ret", "f1", "f2", "cell", least=10)


@query(f"WITH {_BLOCKS} SELECT cell, n, round(b1, 6) + 0.0 AS b1, round(b2, 6) + 0.0 AS b2 FROM fit")
def f6_block_regression(spark: SparkSession, d: str) -> DataFrame:
    return _blocks(spark, d).select("cell", "n", *r6("b1", "b2"))


@query(f"WITH {_BLOCKS} SELECT round(avg(b1), 6) + 0.0 AS avg_b1, round(avg(b2), 6) + 0.0 AS avg_b2, round(avg(b1 / nullif(sqrt(rss / (n - 2) / aa), 0)), 5) + 0.0 AS avg_t1, round(avg(b2 / nullif(sqrt(rss / (n - 2) / bb), 0)), 5) + 0.0 AS avg_t2, round(avg(1 - rss / nullif(tss, 0)), 6) + 0.0 AS avg_r2 FROM fit")
def f8_attribution(spark: SparkSession, d: str) -> DataFrame:
    return X.attribution(_blocks(spark, d)).select(*r6("avg_b1", "avg_b2", "avg_r2"), *r6("avg_t1", "avg_t2", digits=5))


_FRET = f"{XS}, fr AS (SELECT date, CASE WHEN count(ret) >= 4 THEN coalesce(regr_slope(ret, f1), 0) ELSE 0 END AS ret_f1, CASE WHEN count(ret) >= 4 THEN coalesce(regr_slope(ret, f2), 0) ELSE 0 END AS ret_f2 FROM xs GROUP BY date)"


@query(f"WITH {_FRET} SELECT date, {q6('ret_f1', 'ret_f2')} FROM fr")
def f9_factor_returns(spark: SparkSession, d: str) -> DataFrame:
    return X.factor_returns(base.cross_section(spark, d), "ret", ["f1", "f2"]).select("date", *r6("ret_f1", "ret_f2"))


@query(f"WITH {_FRET}, c AS (SELECT sum(ret_f1 * ret_f1) / (count(*) - 1) AS aa, sum(ret_f1 * ret_f2) / (count(*) - 1) AS ab, sum(ret_f2 * ret_f2) / (count(*) - 1) AS bb FROM fr) SELECT round(aa * 0.36 + 2 * ab * -0.24 + bb * 0.16, 9) AS variance, round(aa * 0.36 + ab * -0.24, 9) AS from_ret_f1, round(bb * 0.16 + ab * -0.24, 9) + 0.0 AS from_ret_f2 FROM c")
def f7_risk_decomposition(spark: SparkSession, d: str) -> DataFrame:
    fr = X.factor_returns(base.cross_section(spark, d), "ret", ["f1", "f2"])
    out = X.factor_risk(fr, {"ret_f1": 0.6, "ret_f2": -0.4}, ["ret_f1", "ret_f2"])
    return out.select(*[(F.round(c, 9) + F.lit(0.0)).alias(c) for c in out.columns])


_IC = f"{XS}, rk AS (SELECT date, row_number() OVER (PARTITION BY date ORDER BY f1, symbol) AS ra, row_number() OVER (PARTITION BY date ORDER BY ret, symbol) AS rb FROM xs), ic AS (SELECT date, count(*) AS n, CASE WHEN count(*) >= 3 THEN corr(ra, rb) END AS ic FROM rk GROUP BY date)"


@query(f"WITH {_IC} SELECT date, n, round(ic, 6) + 0.0 AS ic, round(avg(ic) OVER w, 6) + 0.0 AS ic_mean, round(stddev_pop(ic) OVER w, 6) + 0.0 AS ic_std FROM ic WINDOW w AS (ORDER BY date ROWS 11 PRECEDING)")
def f10_f11_rank_ic(spark: SparkSession, d: str) -> DataFrame:
    return X.rolling_ic(X.rank_ic(base.cross_section(spark, d), "f1", "ret"), 12).select("date", "n", *r6("ic", "ic_mean", "ic_std"))


_BW = f"{XS}, cr AS (SELECT greatest(0.05, least(0.6, abs(coalesce(corr(f1, ret), 0)))) AS a, greatest(0.05, least(0.6, abs(coalesce(corr(f2, ret), 0)))) AS b, greatest(0.05, least(0.6, abs(coalesce(corr(f3, ret), 0)))) AS c FROM xs)"


@query(f"WITH {_BW} SELECT round(a / (a + b + c), 6) AS w_f1, round(b / (a + b + c), 6) AS w_f2, round(c / (a + b + c), 6) AS w_f3 FROM cr")
def f12_f13_blend_weights(spark: SparkSession, d: str) -> DataFrame:
    return X.blend_weights(base.cross_section(spark, d), ["f1", "f2", "f3"], "ret", 0.05, 0.6).select(*[F.round(c, 6).alias(c) for c in ("w_f1", "w_f2", "w_f3")])


@query(f"WITH {XS} SELECT date, symbol, round(f1 * 0.6 + f2 * 0.4, 6) AS blend FROM xs")
def f14_blend(spark: SparkSession, d: str) -> DataFrame:
    return X.blend(base.cross_section(spark, d), {"f1": 0.6, "f2": 0.4, "absent": 1.0}).select("date", "symbol", F.round("blend", 6).alias("blend"))


def _optimised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    x = base.cross_section(spark, d).select("date", "symbol", F.col("ret").alias("alpha"), (F.col("f2") / 25).alias("beta"), (F.lit(0.05) + F.col("f1")).alias("sigma"))
    return X.optimise(x, 0.01, 1.0, 0.15, 2.0), x


@query()
def f15_f18_mean_variance(spark: SparkSession, d: str) -> DataFrame:
    return _optimised(spark, d)[0]


@query()
def f17_exposures(spark: SparkSession, d: str) -> DataFrame:
    w, x = _optimised(spark, d)
    return X.exposures(w.join(x.select("date", "symbol", "beta"), ["date", "symbol"])).select("date", *r6("net", "gross", "beta", digits=5))


@query()
def f19_frontier(spark: SparkSession, d: str) -> DataFrame:
    x = base.cross_section(spark, d).groupBy("symbol").agg(F.avg("ret").alias("alpha"), (F.avg("f2") / 25).alias("beta"), (F.lit(0.05) + F.avg("f1")).alias("sigma"))
    return X.frontier(x)


# with equal specific risk the optimum is the alpha free of net and beta, over the curvature, scaled to the gross limit
_FREE = f"{XS}, rg AS (SELECT date, regr_slope(ret, f2) AS h, regr_intercept(ret, f2) AS c FROM xs GROUP BY date HAVING var_pop(f2) > 0), fr AS (SELECT xs.date, symbol, f2 / 25 AS beta, ret, ret - c - h * f2 AS free FROM xs JOIN rg ON rg.date = xs.date), sz AS (SELECT *, free / (2 * 0.01 + 0.04) AS raw, sum(abs(free / (2 * 0.01 + 0.04))) OVER (PARTITION BY date) AS gross FROM fr)"


@query(f"WITH {_FREE} SELECT date, symbol, round(raw * least(1.0, 2.0 / nullif(gross, 0)), 5) + 0.0 AS weight FROM sz")
def f15_f18_equal_risk(spark: SparkSession, d: str) -> DataFrame:
    x = base.cross_section(spark, d).select("date", "symbol", F.col("ret").alias("alpha"), (F.col("f2") / 25).alias("beta"), F.lit(0.2).alias("sigma"))
    x = x.join(x.groupBy("date").agg(F.var_pop("beta").alias("v")).where("v > 0"), "date")
    return X.optimise(x, 0.01, 1.0, 0.15, 2.0).select("date", "symbol", *r6("weight", digits=5))


@query(f"WITH {XS}, dt AS (SELECT date, count(*) AS n FROM xs GROUP BY date) SELECT date, CAST(0 AS DOUBLE) AS net, CAST(0 AS DOUBLE) AS beta, true AS within FROM dt")
def f16_f17_limits(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for every optimised book: no net, no beta, gross within its limit."""
    w, x = _optimised(spark, d)
    e = X.exposures(w.join(x.select("date", "symbol", "beta"), ["date", "symbol"]))
    return e.select("date", *r6("net", "beta", digits=5), (F.col("gross") <= 2.0 + 1e-9).alias("within"))


_FRONT = f"{XS}, av AS (SELECT symbol, avg(ret) AS alpha, avg(f2) / 25 AS beta FROM xs GROUP BY symbol), rg AS (SELECT regr_slope(alpha, beta) AS h, regr_intercept(alpha, beta) AS c FROM av), fr AS (SELECT alpha, alpha - c - h * beta AS free FROM av, rg), sm AS (SELECT sum(abs(free)) AS g, sum(free * alpha) AS fa, sum(free * free) AS ff FROM fr), kk AS (SELECT unnest(generate_series(0, 19)) AS k), lv AS (SELECT CAST(k AS INT) AS k, 0.25 * power(1.5, k) AS aversion FROM kk), sc AS (SELECT k, aversion, g, fa, ff, least(1 / (aversion * 0.04), 4.0 / g) AS m FROM lv, sm)"


@query(f"WITH {_FRONT} SELECT k, round(aversion, 6) AS aversion, round(fa * m, 5) AS alpha, round(0.2 * sqrt(ff) * m, 5) AS stdev, round(g * m, 3) AS gross FROM sc")
def f19_equal_risk_frontier(spark: SparkSession, d: str) -> DataFrame:
    x = base.cross_section(spark, d).groupBy("symbol").agg(F.avg("ret").alias("alpha"), (F.avg("f2") / 25).alias("beta")).withColumn("sigma", F.lit(0.2))
    return X.frontier(x).select("k", *r6("aversion"), *r6("alpha", "stdev", digits=5), *r6("gross", digits=3))


@query(f"WITH {XS} SELECT date, symbol, CAST([0.5, 1.0, 4.0][CAST(least(greatest(CAST(floor(f2) AS INT) % 5 - 1, 0), 2) + 1 AS INT)] AS DOUBLE) AS aversion FROM xs")
def f20_regime_aversion(spark: SparkSession, d: str) -> DataFrame:
    return base.cross_section(spark, d).select("date", "symbol", X.regime_aversion(F.floor("f2") % 5 - 1, [0.5, 1.0, 4.0]).alias("aversion"))


# ------------------------------------------------------------------ stat-arb

def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return R.vectors(base.returns(spark, d))


@query()
def r1_r5_spectrum(spark: SparkSession, d: str) -> DataFrame:
    return R.spectrum(_vectors(spark, d), 60)


@query()
def r5_factor_returns(spark: SparkSession, d: str) -> DataFrame:
    return R.factor_rows(R.spectrum(_vectors(spark, d), 60, "fixed", 3))


def _scores(spark: SparkSession, d: str, window: int = 60, v: DataFrame | None = None) -> DataFrame:
    return R.reversion(R.rolling_residuals(_vectors(spark, d) if v is None else v, window))


@query()
def r6_r11_s_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d).select("date", "symbol", "r2", "beta", "overlap", "kappa", "tau", "s")


# two portfolios: eigenvectors (1, 1) and (1, -1), eigenvalues 1 + |rho| and 1 - |rho|, so that SQL can follow the whole chain
_W2 = f"""{TS}, wv AS (SELECT t.i AS w, t.date, x.i, x.a, x.b FROM nt t JOIN nt x ON x.i BETWEEN t.i - 59 AND t.i WHERE t.i >= 60),
 st AS (SELECT w, any_value(date) AS date, avg(a) AS ma, avg(b) AS mb, stddev_samp(a) AS sa, stddev_samp(b) AS sb, corr(a, b) AS rho FROM wv GROUP BY w)"""


@query(f"""WITH {_W2} SELECT strftime(st.date, '%Y-%m-%d') AS date, round(1 + abs(rho), 6) AS largest, round(1 - abs(rho), 6) AS smallest, CAST(CASE WHEN 1 + abs(rho) > {R.noise_edge(2, 60)!r} THEN 1 ELSE 0 END AS INT) AS kept_mp, CAST(CASE WHEN (1 + abs(rho)) / 2 >= 0.55 THEN 1 ELSE 2 END AS INT) AS kept_variance,
 round(abs(nt.a / sa + sign(rho) * nt.b / sb) / sqrt(2), 5) AS first_return FROM st JOIN nt ON nt.i = st.w""")
def r1_r5_two_portfolios(spark: SparkSession, d: str) -> DataFrame:
    """The spectrum of two portfolios; the sign of an eigenvector is free where rho is negative, so the return is absolute."""
    s = R.spectrum(R.vectors(base.two_sides(spark, d)), 60, "fixed", 1)
    return s.select(iso(), F.round(F.col("eigenvalues")[0], 6).alias("largest"), F.round(F.col("eigenvalues")[1], 6).alias("smallest"), "kept_mp", "kept_variance", F.round(F.abs(F.col("factor_returns")[0]), 5).alias("first_return"))


@query(f"""WITH {_W2}, rs AS (SELECT wv.w, st.date, wv.i, rho, (a - ma) / 2 - sign(rho) * sa * (b - mb) / (2 * sb) AS ra, (b - mb) / 2 - sign(rho) * sb * (a - ma) / (2 * sa) AS rb FROM wv JOIN st ON st.w = wv.w),
 lg AS (SELECT w, date, i, rho, 'even' AS symbol, ra AS r FROM rs UNION ALL SELECT w, date, i, rho, 'odd', rb FROM rs), pt AS (SELECT *, sum(r) OVER (PARTITION BY w, symbol ORDER BY i) AS y FROM lg), pq AS (SELECT *, lag(y) OVER (PARTITION BY w, symbol ORDER BY i) AS x FROM pt),
 ar AS (SELECT any_value(date) AS date, symbol, w, any_value(rho) AS rho, regr_slope(y, x) AS b, regr_intercept(y, x) AS a, (regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / 57 AS var, arg_max(y, i) AS last FROM pq GROUP BY w, symbol), ok AS (SELECT *, CASE WHEN b > 0 AND b < 1 AND var > 0 THEN b END AS g FROM ar)
 SELECT strftime(date, '%Y-%m-%d') AS date, symbol, round((1 + abs(rho)) / 2, 6) AS r2, round(-1 / ln(g), 5) AS tau, round(CASE WHEN -1 / ln(g) < 30 THEN (last - a / (1 - g)) / sqrt(var / (1 - g * g)) END, 5) AS s FROM ok""")
def r6_r11_two_portfolios(spark: SparkSession, d: str) -> DataFrame:
    s = R.reversion(R.rolling_residuals(R.vectors(base.two_sides(spark, d)), 60, "fixed", 1))
    return s.select(iso(), "symbol", F.round("r2", 6).alias("r2"), F.round("tau", 5).alias("tau"), F.round("s", 5).alias("s"))


@query(f"WITH {RET}, sz AS (SELECT date, count(*) AS c FROM ret GROUP BY date), nd AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sz WHERE c = (SELECT max(c) FROM sz)) SELECT strftime(date, '%Y-%m-%d') AS date, CAST((SELECT max(c) FROM sz) AS DOUBLE) AS total, true AS apart, true AS descending FROM nd WHERE i >= 60")
def r2_r7_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold for any universe: eigenvalues add up to the number of names and descend, residuals are free of the factors."""
    v = _vectors(spark, d)
    ev = R.spectrum(v, 60).select("date", F.round(F.aggregate("eigenvalues", F.lit(0.0), lambda a, x: a + x), 6).alias("total"), (F.reverse(F.array_sort("eigenvalues")) == F.col("eigenvalues")).alias("descending"))
    rs = R.rolling_residuals(v, 60).groupBy("date").agg((F.max("overlap") < 1e-6).alias("apart"))
    return ev.join(rs, "date").select(iso(), "total", "apart", "descending")


_ZS = f"""{RET}, zs AS (SELECT date, symbol, CASE WHEN count(ret) OVER w = 20 THEN round((ret - avg(ret) OVER w) / nullif(stddev_samp(ret) OVER w, 0), 8) END AS s FROM ret WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS 19 PRECEDING)), nz AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM zs)"""
_STEP = "CASE WHEN {s} IS NULL THEN 0 WHEN {s} < -1.25 THEN 1 WHEN {s} > 1.25 THEN -1 WHEN {p} = 1 AND {s} <= -0.5 THEN 1 WHEN {p} = -1 AND {s} >= 0.75 THEN -1 ELSE 0 END"
_POS = f"{_ZS}, fold AS (SELECT i, symbol, date, s, CAST({_STEP.format(s='s', p='0')} AS INT) AS pos FROM nz WHERE i = 1 UNION ALL SELECT nz.i, nz.symbol, nz.date, nz.s, CAST({_STEP.format(s='nz.s', p='fold.pos')} AS INT) FROM nz JOIN fold ON nz.symbol = fold.symbol AND nz.i = fold.i + 1)"


def _zscores(spark: SparkSession, d: str) -> DataFrame:
    """A cheap score for position machines: the standardised return."""
    w = rows("symbol", "date", 20)
    r = base.returns(spark, d)
    return r.select("date", "symbol", F.when(F.count("ret").over(w) == 20, F.round(F.try_divide(F.col("ret") - F.avg("ret").over(w), F.stddev_samp("ret").over(w)), 8)).alias("s"))


@query(f"WITH RECURSIVE {_POS} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, pos FROM fold")
def r25_banded_positions(spark: SparkSession, d: str) -> DataFrame:
    return R.banded_positions(_zscores(spark, d)).select(iso(), "symbol", "pos")


_NW = f"{_POS}, sd AS (SELECT *, count(*) FILTER (WHERE pos > 0) OVER (PARTITION BY date) AS lg, count(*) FILTER (WHERE pos < 0) OVER (PARTITION BY date) AS sh FROM fold), wt AS (SELECT date, symbol, pos, CASE WHEN lg > 0 AND sh > 0 AND pos > 0 THEN 0.5 / lg WHEN lg > 0 AND sh > 0 AND pos < 0 THEN -0.5 / sh ELSE 0.0 END AS weight FROM sd)"


def _book(spark: SparkSession, d: str) -> DataFrame:
    return R.neutral_weights(R.banded_positions(_zscores(spark, d)))


@query(f"WITH RECURSIVE {_NW} SELECT strftime(date, '%Y-%m-%d') AS date, symbol, {q6('weight')} FROM wt")
def r26_neutral_weights(spark: SparkSession, d: str) -> DataFrame:
    return _book(spark, d).select(iso(), "symbol", *r6("weight"))


@query(f"WITH RECURSIVE {_NW}, dw AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY symbol ORDER BY date), 0)) AS d FROM wt) SELECT strftime(date, '%Y-%m-%d') AS date, round(sum(weight), 6) + 0.0 AS net, round(sum(abs(weight)), 6) AS gross, count(*) FILTER (WHERE weight > 0) AS longs, count(*) FILTER (WHERE weight < 0) AS shorts, round(sum(d) / 2, 6) AS turnover FROM dw GROUP BY 1")
def r27_book_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return R.book_diagnostics(_book(spark, d)).select(iso(), *r6("net", "gross"), "longs", "shorts", *r6("turnover"))


_PNL = f"{_NW}, hd AS (SELECT ret.date, ret.symbol, ret.ret, lag(weight, 2) OVER (PARTITION BY ret.symbol ORDER BY ret.date) AS h FROM ret LEFT JOIN wt ON wt.date = ret.date AND wt.symbol = ret.symbol), pnl AS (SELECT date, sum(coalesce(h * ret, 0)) AS pnl FROM hd GROUP BY date)"


def _pnl(spark: SparkSession, d: str) -> DataFrame:
    return R.paper_pnl(_book(spark, d), base.returns(spark, d))


@query(f"WITH RECURSIVE {_PNL} SELECT strftime(date, '%Y-%m-%d') AS date, {q6('pnl')} FROM pnl")
def r28_paper_pnl(spark: SparkSession, d: str) -> DataFrame:
    return _pnl(spark, d).select(iso(), *r6("pnl"))


@query(f"WITH RECURSIVE {_PNL} SELECT count(*) AS days, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) AS sharpe FROM pnl WHERE pnl <> 0")
def r29_active_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return R.active_sharpe(_pnl(spark, d)).select("days", F.round("sharpe", 5).alias("sharpe"))


_BANDS = [(-1.25, 1.25, -0.5, 0.75), (-1.5, 1.5, -0.5, 0.5), (-1.0, 1.0, -0.25, 0.25), (-2.0, 2.0, -0.5, 0.75)]


_SWEEP_STEP = "CASE WHEN nz.s IS NULL THEN 0 WHEN nz.s < ol THEN 1 WHEN nz.s > os THEN -1 WHEN {p} = 1 AND nz.s <= cl THEN 1 WHEN {p} = -1 AND nz.s >= cs THEN -1 ELSE 0 END"
_SWEEP = f"""{_ZS}, bands(config, ol, os, cl, cs) AS (VALUES {', '.join(str((i, *b)) for i, b in enumerate(_BANDS))}), fold AS (SELECT config, ol, os, cl, cs, i, symbol, date, CAST({_SWEEP_STEP.format(p='0')} AS INT) AS pos FROM nz, bands WHERE i = 1
 UNION ALL SELECT config, ol, os, cl, cs, nz.i, nz.symbol, nz.date, CAST({_SWEEP_STEP.format(p='fold.pos')} AS INT) FROM nz JOIN fold ON nz.symbol = fold.symbol AND nz.i = fold.i + 1),
 sd AS (SELECT *, count(*) FILTER (WHERE pos > 0) OVER (PARTITION BY config, date) AS lg, count(*) FILTER (WHERE pos < 0) OVER (PARTITION BY config, date) AS sh FROM fold), wt AS (SELECT config, date, symbol, CASE WHEN lg > 0 AND sh > 0 AND pos > 0 THEN 0.5 / lg WHEN lg > 0 AND sh > 0 AND pos < 0 THEN -0.5 / sh ELSE 0.0 END AS weight FROM sd),
 hd AS (SELECT wt.config, ret.date, ret.ret, lag(weight, 2) OVER (PARTITION BY wt.config, ret.symbol ORDER BY ret.date) AS h FROM ret JOIN wt ON wt.date = ret.date AND wt.symbol = ret.symbol), pnl AS (SELECT config, date, sum(coalesce(h * ret, 0)) AS pnl FROM hd GROUP BY 1, 2)"""


@query(f"WITH RECURSIVE {_SWEEP} SELECT CAST(config AS INT) AS config, count(*) AS days, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) AS sharpe FROM pnl WHERE pnl <> 0 GROUP BY config")
def v14_band_sweep(spark: SparkSession, d: str) -> DataFrame:
    return R.band_sweep(_zscores(spark, d), base.returns(spark, d), _BANDS).select("config", "days", F.round("sharpe", 5).alias("sharpe"))


# the books and the sweep on the s-scores of R1-R11; an eigen-decomposition has no SQL

def _scored_book(spark: SparkSession, d: str) -> DataFrame:
    return R.neutral_weights(R.banded_positions(_scores(spark, d).select("date", "symbol", "s")))


@query()
def r25_r26_scored_book(spark: SparkSession, d: str) -> DataFrame:
    return _scored_book(spark, d).select("date", "symbol", "s", "pos", "weight")


@query()
def r27_scored_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return R.book_diagnostics(_scored_book(spark, d))


@query()
def r28_scored_pnl(spark: SparkSession, d: str) -> DataFrame:
    return R.paper_pnl(_scored_book(spark, d), base.returns(spark, d))


@query()
def r29_scored_sharpe(spark: SparkSession, d: str) -> DataFrame:
    return R.active_sharpe(R.paper_pnl(_scored_book(spark, d), base.returns(spark, d)))


_BAND_SETS = [(-1.25, 1.25, -0.5, 0.75), (-1.0, 1.0, -0.25, 0.5), (-1.5, 1.5, -0.75, 1.0), (-2.0, 2.0, -0.5, 0.5)]
_WINDOWS = [40, 60, 80]


@query()
def v14_scored_sweep(spark: SparkSession, d: str) -> DataFrame:
    """The search of V14: four sets of bands times three estimation windows, on s-scores."""
    v = cut_lineage(_vectors(spark, d))  # date-level rows, read once per window
    scores = None
    for n in _WINDOWS:
        one = _scores(spark, d, n, v).select("date", "symbol", "s", F.lit(n).alias("window"))
        scores = one if scores is None else scores.unionByName(one)
    grid = spark.range(len(_BAND_SETS) * len(_WINDOWS)).select(F.col("id").cast("int").alias("config"))
    out = grid.join(R.band_sweep(scores, base.returns(spark, d), _BAND_SETS, _WINDOWS), "config", "left")  # a flat book counts as a trial
    place = lambda values: F.array(*[F.lit(x) for x in values])
    band = F.floor(F.col("config") / len(_WINDOWS)).cast("int")
    return out.select("config", F.get(place(_WINDOWS), F.col("config") % len(_WINDOWS)).alias("window"), *[F.get(place([b[k] for b in _BAND_SETS]), band).alias(n) for k, n in enumerate(("open_long", "open_short", "close_long", "close_short"))], F.coalesce("days", F.lit(0)).alias("days"), "sharpe")


# ------------------------------------------------------------------ regimes

def _market(spark: SparkSession, d: str) -> DataFrame:
    r = base.returns(spark, d).groupBy("date").agg(F.avg("ret").alias("ret"), F.avg("close").alias("close"), F.sum("volume").cast("double").alias("volume")).withColumn("symbol", F.lit("mkt"))
    return W.regime_features(r)


@query()
def r30_r32_causal_states(spark: SparkSession, d: str) -> DataFrame:
    return G.causal_states(_market(spark, d), ["rv_long", "rv_short", "vov", "range_short", "volume_ratio"], 3, 252, 63)


@query(f"WITH {RET}, nd AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM (SELECT DISTINCT date FROM ret)) SELECT strftime(date, '%Y-%m-%d') AS date, CAST(1 AS DOUBLE) AS total, true AS named FROM nd WHERE i >= 63 + 251")
def r30_r32_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of filtered states: one row a date from the warm-th on, chances that add up to 1, the likeliest state named."""
    s = r30_r32_causal_states(spark, d)
    ps = [F.col(f"p_state_{j}") for j in range(3)]
    return s.select(iso(), F.round(ps[0] + ps[1] + ps[2], 9).alias("total"), (F.get(F.array(*ps), F.col("state")) == F.greatest(*ps)).alias("named"))


_STATES = f"{RET}, vs AS (SELECT symbol AS series, date, CAST(row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS BIGINT) AS i, CASE WHEN abs(ret) > 0.6 THEN 2 WHEN abs(ret) > 0.2 THEN 1 ELSE 0 END AS state, 0.5 + (volume % 50) / 100.0 AS p FROM ret)"
_DEB = f"""{_STATES}, q AS (SELECT *, p >= 0.6 AS ok, coalesce(lag(p >= 0.6) OVER w, false) AS pok, lag(state) OVER w AS ps FROM vs WINDOW w AS (PARTITION BY series ORDER BY date)), isl AS (SELECT *, sum(CASE WHEN NOT ok OR NOT pok OR state IS DISTINCT FROM ps THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY date) AS isle FROM q),
 rn AS (SELECT *, CASE WHEN ok THEN row_number() OVER (PARTITION BY series, isle ORDER BY date) ELSE 0 END AS run FROM isl), cm AS (SELECT series, date, state, coalesce(last_value(CASE WHEN run >= 2 AND i > 0 THEN state END IGNORE NULLS) OVER (PARTITION BY series ORDER BY date), first_value(state) OVER (PARTITION BY series ORDER BY date)) AS committed FROM rn)"""


def _states(spark: SparkSession, d: str) -> DataFrame:
    r = base.returns(spark, d)
    s = r.select(F.col("symbol").alias("series"), "date", F.when(F.abs("ret") > 0.6, 2).when(F.abs("ret") > 0.2, 1).otherwise(0).alias("state"), (0.5 + F.col("volume") % 50 / 100.0).alias("p"))
    return G.debounced(s, 2, 0.6)


@query(f"WITH {_DEB} SELECT series, strftime(date, '%Y-%m-%d') AS date, state, committed FROM cm")
def r33_debounced(spark: SparkSession, d: str) -> DataFrame:
    return _states(spark, d).select("series", iso(), "state", "committed")


@query(f"WITH {_DEB}, mv AS (SELECT *, CASE WHEN committed <> lag(committed) OVER (PARTITION BY series ORDER BY date) THEN 1 ELSE 0 END AS m FROM cm), ag AS (SELECT series, committed, count(*) AS rows, CAST(sum(m) AS BIGINT) AS entered FROM mv GROUP BY 1, 2) SELECT series, committed, rows, entered, round(rows / sum(rows) OVER (PARTITION BY series), 6) AS share FROM ag")
def r34_regime_stats(spark: SparkSession, d: str) -> DataFrame:
    return G.regime_stats(_states(spark, d), "committed").select("series", "committed", "rows", "entered", F.round("share", 6).alias("share"))


@query(f"WITH {_DEB} SELECT vs.series, committed, round(avg(ret), 6) + 0.0 AS mean_ret FROM cm JOIN ret ON ret.symbol = cm.series AND ret.date = cm.date JOIN vs ON vs.series = cm.series AND vs.date = cm.date GROUP BY 1, 2")
def r34_means_by_state(spark: SparkSession, d: str) -> DataFrame:
    s = _states(spark, d).join(base.returns(spark, d).select(F.col("symbol").alias("series"), "date", "ret"), ["series", "date"])
    return G.regime_stats(s, "committed", means=("ret",)).select("series", "committed", *r6("mean_ret"))


# ------------------------------------------------------------------ portfolios

@query(f"WITH {RET}, v AS (SELECT symbol, var_samp(ret) AS v FROM ret GROUP BY 1) SELECT symbol, round((1 / v) / sum(1 / v) OVER (), 6) AS ivp, round(1.0 / count(*) OVER (), 6) AS equal FROM v WHERE v > 0")
def p1_simple_allocators(spark: SparkSession, d: str) -> DataFrame:
    v = base.returns(spark, d).groupBy("symbol").agg(F.var_samp("ret").alias("v")).where("v > 0")
    all_ = Window.partitionBy(F.lit(0))  # one row per name
    return v.select("symbol", F.round((1 / F.col("v")) / F.sum(1 / F.col("v")).over(all_), 6).alias("ivp"), F.round(F.lit(1.0) / F.count("*").over(all_), 6).alias("equal"))


def _walk(spark: SparkSession, d: str) -> DataFrame:
    return P.walk_forward(_vectors(spark, d), 252, 21)


@query()
def p2_p4_walk_forward(spark: SparkSession, d: str) -> DataFrame:
    return _walk(spark, d)


@query()
def p5_allocator_scores(spark: SparkSession, d: str) -> DataFrame:
    return P.allocator_scores(_walk(spark, d))


# two portfolios again: hierarchical parity is inverse variance, and the least variance has a closed form
_WALK2 = f"""{TS}, rb AS (SELECT CAST(k AS INT) AS k FROM (SELECT unnest(generate_series(0, (SELECT CAST(max(total) AS BIGINT) FROM nt) // 21)) AS k) WHERE (SELECT max(total) FROM nt) >= 252 + 21 * (k + 1)),
 cv AS (SELECT k, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS c FROM rb JOIN nt ON i > k * 21 AND i <= k * 21 + 252 GROUP BY k),
 al AS (SELECT k, unnest(['equal', 'ivp', 'mvo', 'hrp']) AS allocator, unnest([0.5, vb / (va + vb), (vb - c) / (va + vb - 2 * c), vb / (va + vb)]) AS w FROM cv),
 wk AS (SELECT allocator, k AS rebalance, date, i, w * a + (1 - w) * b AS ret, w, i = k * 21 + 253 AS head FROM al JOIN nt ON i > k * 21 + 252 AND i <= k * 21 + 273),
 tn AS (SELECT *, CASE WHEN head THEN coalesce(2 * abs(w - lag(w) OVER (PARTITION BY allocator ORDER BY i)), abs(w) + abs(1 - w)) ELSE 0 END AS turnover FROM wk)"""


def _walk2(spark: SparkSession, d: str) -> DataFrame:
    return P.walk_forward(R.vectors(base.two_sides(spark, d)), 252, 21)


@query(f"WITH {_WALK2} SELECT allocator, rebalance, strftime(date, '%Y-%m-%d') AS date, {q6('ret', 'turnover')} FROM tn")
def p2_p4_two_portfolios(spark: SparkSession, d: str) -> DataFrame:
    return _walk2(spark, d).select("allocator", "rebalance", iso(), *r6("ret", "turnover"))


def _scores2_sql() -> str:
    law = NormalDist()
    bar = f"sqrt(v) * ({1 - V.EULER!r} * {law.inv_cdf(1 - 1 / 4)!r} + {V.EULER!r} * {law.inv_cdf(1 - 1 / (4 * math.e))!r})"
    mom = "avg(ret) AS m, stddev_samp(ret) AS sd, count(*) AS n, avg(ret * ret) AS e2, avg(ret * ret * ret) AS e3, avg(ret * ret * ret * ret) AS e4"
    return f"""WITH {_WALK2}, ix AS (SELECT *, row_number() OVER (PARTITION BY allocator ORDER BY i) - 1 AS j, count(*) OVER (PARTITION BY allocator) AS n FROM tn), gp AS (SELECT *, CASE WHEN j < (n % 6) * (n // 6 + 1) THEN j // (n // 6 + 1) ELSE n % 6 + (j - (n % 6) * (n // 6 + 1)) // (n // 6) END AS grp FROM ix),
 bs AS (SELECT allocator, avg(s) AS block_mean, stddev_samp(s) AS block_sd, min(s) AS block_min FROM (SELECT allocator, grp, avg(ret) / stddev_samp(ret) AS s FROM gp GROUP BY 1, 2) GROUP BY 1),
 tv AS (SELECT allocator, avg(t) AS turnover FROM (SELECT allocator, rebalance, sum(turnover) AS t FROM tn WHERE rebalance > 0 GROUP BY 1, 2) GROUP BY 1), mo AS (SELECT allocator, count(DISTINCT rebalance) AS rebalances, {mom} FROM tn GROUP BY 1),
 sr AS (SELECT *, m / sd AS sharpe, (e3 - 3 * m * e2 + 2 * m * m * m) / power(e2 - m * m, 1.5) AS skew, (e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m) / power(e2 - m * m, 2) AS kurt FROM mo), vv AS (SELECT var_samp(sharpe) AS v FROM sr), be AS (SELECT allocator, sharpe, skew, kurt, n, {bar} AS bar FROM sr, vv ORDER BY sharpe DESC, allocator DESC LIMIT 1),
 ds AS (SELECT allocator, (sharpe - bar) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS x FROM be)
 SELECT sr.allocator, rebalances, round(sharpe * sqrt(252), 5) AS sharpe, round(sd * sqrt(252), 6) AS vol, round(coalesce(turnover, 0), 6) AS turnover, round(block_mean, 5) AS block_mean, round(block_sd, 5) AS block_sd, round(block_min, 5) AS block_min, round({normal_cdf_sql('ds.x')}, 5) AS best_dsr FROM sr JOIN bs USING (allocator) LEFT JOIN tv USING (allocator) LEFT JOIN ds ON ds.allocator = sr.allocator"""


@query(_scores2_sql())
def p5_two_portfolios(spark: SparkSession, d: str) -> DataFrame:
    s = P.allocator_scores(_walk2(spark, d))
    return s.select("allocator", "rebalances", *[F.round(c, 5).alias(c) for c in ("sharpe", "block_mean", "block_sd", "block_min", "best_dsr")], *r6("vol", "turnover"))


# ------------------------------------------------------------------ validation

def _label_rows(spark: SparkSession, d: str) -> tuple[DataFrame, int]:
    o = load(spark, d, "orders").select(F.col("o_orderkey").alias("idx"))
    return V.label_windows(o, 10), o.count()


# a window is [i, i + 10], so a test group [lo, hi] purges rows from lo - 10 to hi + 10 and embargoes those after
_CP = """nn AS (SELECT count(*) AS n FROM orders), ix AS (SELECT o_orderkey AS idx, CASE WHEN o_orderkey < (n % 6) * (n // 6 + 1) THEN o_orderkey // (n // 6 + 1) ELSE n % 6 + (o_orderkey - (n % 6) * (n // 6 + 1)) // (n // 6) END AS grp, CAST(floor(n * 0.01) AS BIGINT) AS gap FROM orders, nn),
 gb AS (SELECT grp AS g, min(idx) AS lo, max(idx) AS hi FROM ix GROUP BY 1), cb AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split_id, a.g AS ga, a.lo AS la, a.hi AS ha, b.g AS gb, b.lo AS lb, b.hi AS hb FROM gb a JOIN gb b ON a.g < b.g),
 rl AS (SELECT split_id, idx, CASE WHEN grp = ga OR grp = gb THEN 'test' WHEN (idx + 10 >= la AND idx <= ha + 10) OR (idx + 10 >= lb AND idx <= hb + 10) THEN 'purged' WHEN (idx > ha + 10 AND idx <= ha + 10 + gap) OR (idx > hb + 10 AND idx <= hb + 10 + gap) THEN 'embargoed' ELSE 'train' END AS role FROM ix, cb)"""


@query(f"WITH {_CP} SELECT CAST(split_id AS INT) AS split_id, role, count(*) AS n, CAST(sum(idx) AS BIGINT) AS idxs FROM rl GROUP BY 1, 2")
def v1_v5_purged_splits(spark: SparkSession, d: str) -> DataFrame:
    r, n = _label_rows(spark, d)
    return V.purged_train(r, spark, n, 6, 2, 0.01).groupBy("split_id", "role").agg(F.count("*").alias("n"), F.sum("idx").alias("idxs"))


@query("WITH cb AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split_id, a.g AS ga, b.g AS gb FROM (SELECT unnest(generate_series(0, 5)) AS g) a JOIN (SELECT unnest(generate_series(0, 5)) AS g) b ON a.g < b.g), ex AS (SELECT split_id, unnest([ga, gb]) AS grp FROM cb) SELECT CAST(split_id AS INT) AS split_id, CAST(grp AS INT) AS grp, CAST(row_number() OVER (PARTITION BY grp ORDER BY split_id) - 1 AS INT) AS path FROM ex")
def v6_paths(spark: SparkSession, d: str) -> DataFrame:
    return V.splits(spark, 6, 2)


_MOM = "avg(ret) AS m, stddev_samp(ret) AS sd, count(*) AS n, avg(ret * ret) AS e2, avg(ret * ret * ret) AS e3, avg(ret * ret * ret * ret) AS e4"
_SR = """SELECT *, m / sd AS sharpe, (e3 - 3 * m * e2 + 2 * m * m * m) / power(e2 - m * m, 1.5) AS skew, (e4 - 4 * m * e3 + 6 * m * m * e2 - 3 * m * m * m * m) / power(e2 - m * m, 2) AS kurt FROM """
_SHR = f"{RET}, mo AS (SELECT symbol AS trial_id, {_MOM} FROM ret GROUP BY 1), sr AS ({_SR} mo)"


@query(f"WITH {_SHR} SELECT trial_id, n, round(sharpe, 6) AS sharpe, round(skew, 5) AS skew, round(kurt, 4) AS kurt FROM sr")
def v7_v8_moments(spark: SparkSession, d: str) -> DataFrame:
    s = V.sharpe_per_period(base.returns(spark, d).withColumnRenamed("symbol", "trial_id"), "ret", ["trial_id"])
    return s.select("trial_id", "n", F.round("sharpe", 6).alias("sharpe"), F.round("skew", 5).alias("skew"), F.round("kurt", 4).alias("kurt"))


@query(f"WITH {_SHR}, ps AS (SELECT trial_id, (sharpe - 0.2) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe) AS x FROM sr) SELECT trial_id, round({normal_cdf_sql('x')}, 6) AS psr FROM ps")
def v9_probabilistic_sharpe(spark: SparkSession, d: str) -> DataFrame:
    s = V.sharpe_per_period(base.returns(spark, d).withColumnRenamed("symbol", "trial_id"), "ret", ["trial_id"])
    return s.select("trial_id", F.round(V.probabilistic_sharpe(F.col("sharpe"), F.lit(0.2), F.col("n"), F.col("skew"), F.col("kurt")), 6).alias("psr"))


def _deflated_sql() -> str:
    """The universe has twelve names, so the two quantiles of twelve trials are constants."""
    law = NormalDist()
    bar = f"sqrt(v) * ({1 - V.EULER!r} * {law.inv_cdf(1 - 1 / 12)!r} + {V.EULER!r} * {law.inv_cdf(1 - 1 / (12 * math.e))!r})"
    x = "(sharpe - {0}) * sqrt(n - 1) / sqrt(1 - skew * sharpe + (kurt - 1) / 4 * sharpe * sharpe)"
    return f"""WITH {_SHR}, vv AS (SELECT var_samp(sharpe) AS v, count(*) AS trials FROM sr), be AS (SELECT * FROM sr ORDER BY sharpe DESC, trial_id DESC LIMIT 1), bb AS (SELECT be.*, trials, {bar} AS bar FROM be, vv),
 xx AS (SELECT *, {x.format('0')} AS x0, {x.format('bar')} AS x1 FROM bb) SELECT trial_id, trials, round(sharpe, 6) AS sharpe, round(bar, 6) AS expected_best, round({normal_cdf_sql('x0')}, 6) AS psr, round({normal_cdf_sql('x1')}, 6) AS dsr FROM xx"""


@query(_deflated_sql())
def v10_v11_deflated(spark: SparkSession, d: str) -> DataFrame:
    out = V.deflated_sharpe(base.returns(spark, d).withColumnRenamed("symbol", "trial_id"), "ret")
    return out.select("trial_id", "trials", *[F.round(c, 6).alias(c) for c in ("sharpe", "expected_best", "psr", "dsr")])


@query("SELECT vec_id, round(p, 6) AS p FROM (SELECT vec_id, ((vec_id % 997) + 0.5) / 998 AS p FROM embeddings)")
def v10_inverse_normal(spark: SparkSession, d: str) -> DataFrame:
    """The inverse normal law, put back through the law: the identity."""
    from tickloom.functions.numeric import normal_cdf

    return load(spark, d, "embeddings").select("vec_id", F.round(normal_cdf(normal_ppf((F.col("vec_id") % 997 + 0.5) / 998)), 6).alias("p"))


@query()
def v12_noise_experiment(spark: SparkSession, d: str) -> DataFrame:
    return V.deflated_sharpe(V.noise_trials(spark), "ret").select("trial_id", "trials", *[F.round(c, 6).alias(c) for c in ("sharpe", "expected_best", "psr", "dsr")])


@query("""SELECT n_nationkey AS k, substr(sha1('{"name": "' || n_name || '", "region": ' || n_regionkey || '}'), 1, 12) AS trial_id FROM nation""")
def v13_trial_ids(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit('{"name": "'), "n_name", F.lit('", "region": '), F.col("n_regionkey").cast("string"), F.lit("}"))
    return load(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.substring(F.sha1(text), 1, 12).alias("trial_id"))


@query(f"WITH {RET}, ii AS (SELECT symbol, ret, row_number() OVER (PARTITION BY symbol ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY symbol) AS n FROM ret), bl AS (SELECT symbol, CAST(CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1) ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS INT) AS grp, {_MOM} FROM ii GROUP BY 1, 2), sr AS ({_SR} bl) SELECT symbol, grp, n, round(sharpe, 6) AS sharpe FROM sr")
def v15_block_sharpes(spark: SparkSession, d: str) -> DataFrame:
    r = base.returns(spark, d)
    n = r.select("date").distinct().count()
    r = r.withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("date")) - 1)
    return V.block_sharpes(r, "ret", n, 6, ["symbol"]).select("symbol", "grp", "n", F.round("sharpe", 6).alias("sharpe"))


# ------------------------------------------------------------------ meta-labels

_EV = f"{_POS}, pi AS (SELECT fold.symbol, fold.date, fold.i AS idx, fold.pos, panel.close FROM fold JOIN panel ON panel.symbol = fold.symbol AND panel.date = fold.date), en AS (SELECT * FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY idx), 0) AS pp FROM pi) WHERE pos <> 0 AND pos <> pp)"
_TB = f"""{_EV}, hz AS (SELECT en.symbol, en.idx AS t0, en.pos AS side, p.idx AS i, en.pos * (p.close / en.close - 1) AS r FROM en JOIN pi p ON p.symbol = en.symbol AND p.idx > en.idx AND p.idx <= en.idx + 10), tc AS (SELECT *, CASE WHEN r >= 0.5 THEN 1 WHEN r <= -0.5 THEN 0 END AS hit FROM hz),
 lb AS (SELECT symbol, t0, side, coalesce(min(i) FILTER (WHERE hit IS NOT NULL), max(i)) AS t1, coalesce(arg_min(r, i) FILTER (WHERE hit IS NOT NULL), arg_max(r, i)) AS ret, coalesce(arg_min(hit, i) FILTER (WHERE hit IS NOT NULL), CAST(arg_max(r, i) > 0 AS INT)) AS label FROM tc GROUP BY 1, 2, 3)"""


def _positions(spark: SparkSession, d: str) -> DataFrame:
    p = R.banded_positions(_zscores(spark, d)).withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("bigint"))
    return p.join(base.panel(spark, d).select("date", "symbol", "close"), ["date", "symbol"])


def _labels(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    p = _positions(spark, d)
    return L.triple_barrier(p, L.entries(p), 0.5, 0.5, 10), p


@query(f"WITH RECURSIVE {_EV} SELECT symbol, idx, pos FROM en")
def l1_entries(spark: SparkSession, d: str) -> DataFrame:
    return L.entries(_positions(spark, d)).select("symbol", "idx", "pos")


@query(f"WITH RECURSIVE {_TB} SELECT symbol, t0, side, t1, round(ret, 6) + 0.0 AS ret, label FROM lb")
def l2_triple_barrier(spark: SparkSession, d: str) -> DataFrame:
    return _labels(spark, d)[0].select("symbol", "t0", "side", "t1", *r6("ret"), "label")


_UQ = f"{_TB}, cc AS (SELECT symbol, i, count(*) AS open FROM (SELECT symbol, unnest(generate_series(t0, t1)) AS i FROM lb) GROUP BY 1, 2), uq AS (SELECT lb.symbol, lb.t0, lb.ret, avg(1.0 / open) AS uniqueness FROM lb JOIN cc ON cc.symbol = lb.symbol AND cc.i BETWEEN lb.t0 AND lb.t1 GROUP BY 1, 2, 3)"


@query(f"WITH RECURSIVE {_UQ} SELECT symbol, i, open FROM cc")
def l3_concurrency(spark: SparkSession, d: str) -> DataFrame:
    return L.concurrency(_labels(spark, d)[0]).select("symbol", "i", "open")


@query(f"WITH RECURSIVE {_UQ} SELECT symbol, t0, round(uniqueness, 6) AS uniqueness, round(uniqueness * abs(ret) / avg(uniqueness * abs(ret)) OVER (), 6) AS weight FROM uq")
def l4_l5_sample_weights(spark: SparkSession, d: str) -> DataFrame:
    w = L.sample_weights(L.uniqueness(cut_lineage(_labels(spark, d)[0])), by_return=True)  # a row an event, used four times
    return w.select("symbol", "t0", F.round("uniqueness", 6).alias("uniqueness"), F.round("weight", 6).alias("weight"))


@query()
def l6_sequential_bootstrap(spark: SparkSession, d: str) -> DataFrame:
    return L.sequential_bootstrap(_labels(spark, d)[0])


def _stand_in_regimes(p: DataFrame) -> DataFrame:
    """A state by a rule that SQL can follow, known on every fifth date only, so that it is carried forward between."""
    return p.select("idx").distinct().where("idx % 5 = 0").select("idx", (F.col("idx") % 3).alias("state"))


def _meta(spark: SparkSession, d: str, p: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    labels, p = _labels(spark, d) if p is None else (L.triple_barrier(p, L.entries(p), 0.5, 0.5, 10), p)
    scores = p.select("symbol", "idx", "date", "s", "close")
    regimes = _stand_in_regimes(p)
    m = L.meta_dataset(L.sample_weights(L.uniqueness(cut_lineage(labels))), scores, regimes)
    numbered = running(m, [], ["t0", "symbol"], F.floor(F.col("t0") / 64), sums={"event": F.lit(1)})  # in order of start
    ev = cut_lineage(numbered.withColumn("event", F.col("event").cast("int") - 1).select("event", "symbol", "t0", "t1", "label", "ret", "weight", "s", "abs_s", "regime", "dow"))
    n, bars = ev.count(), p.agg(F.max("idx").alias("bars")).head()["bars"] or 0
    rows_ = ev.select(F.col("event").cast("bigint").alias("idx"), "t0", "t1")
    roles = V.purged_train(rows_, ev.sparkSession, n, 6, 2, 0.01, bars).withColumnRenamed("idx", "event")
    return ev.withColumn("event", F.col("event").cast("bigint")), roles


@query()
def l7_l9_out_of_sample(spark: SparkSession, d: str) -> DataFrame:
    ev, roles = _meta(spark, d)
    return L.out_of_sample(ev, roles, ["abs_s", "regime", "dow"])


@query()
def l10_importance(spark: SparkSession, d: str) -> DataFrame:
    ev, roles = _meta(spark, d)
    return L.importance(ev, roles, ["abs_s", "regime", "dow"], 10)


@query(f"WITH RECURSIVE {_TB}, ns AS (SELECT symbol, i AS idx, date, s FROM nz), rg AS (SELECT DISTINCT i AS idx, max(CASE WHEN i % 5 = 0 THEN i END) OVER (ORDER BY i) AS last FROM (SELECT DISTINCT i FROM nz)) SELECT lb.symbol, t0, round(abs(s), 6) AS abs_s, CAST(coalesce(last % 3, -1) AS BIGINT) AS regime, CAST((dayofweek(date) + 6) % 7 AS INT) AS dow, label FROM lb JOIN ns ON ns.symbol = lb.symbol AND ns.idx = lb.t0 JOIN rg ON rg.idx = lb.t0")
def l11_meta_dataset(spark: SparkSession, d: str) -> DataFrame:
    labels, p = _labels(spark, d)
    regimes = _stand_in_regimes(p)
    m = L.meta_dataset(labels, p.select("symbol", "idx", "date", "s"), regimes)
    return m.select("symbol", "t0", F.round("abs_s", 6).alias("abs_s"), "regime", "dow", "label")


@query()
def l12_accuracy(spark: SparkSession, d: str) -> DataFrame:
    ev, roles = _meta(spark, d)
    p = L.out_of_sample(ev, roles, ["abs_s", "regime", "dow"])
    return L.accuracy(ev.join(p, "event"))


@query(f"WITH RECURSIVE {_TB} SELECT symbol, count(*) AS draws, true AS known FROM lb GROUP BY symbol")
def l6_draws(spark: SparkSession, d: str) -> DataFrame:
    """What must hold of the bootstrap: as many draws as labels, each of a label."""
    labels = cut_lineage(_labels(spark, d)[0])
    drawn = L.sequential_bootstrap(labels).join(labels.select("symbol", "t0", F.lit(True).alias("is_label")), ["symbol", "t0"], "left")
    return drawn.groupBy("symbol").agg(F.count("*").alias("draws"), F.every(F.coalesce("is_label", F.lit(False))).alias("known"))


@query(f"WITH RECURSIVE {_TB} SELECT count(*) AS n, round(greatest(avg(label), 1 - avg(label)), 6) AS baseline, true AS within FROM lb")
def l7_l12_invariants(spark: SparkSession, d: str) -> DataFrame:
    """What must hold out of sample: every event is predicted, by a chance, beside the share of the commoner class."""
    ev, roles = _meta(spark, d)
    scored = ev.join(L.out_of_sample(ev, roles, ["abs_s", "regime", "dow"]), "event")
    within = scored.agg(F.every((F.col("p") > 0) & (F.col("p") < 1)).alias("within"))
    return L.accuracy(scored).select("n", F.round("baseline", 6).alias("baseline"), within.scalar().alias("within"))


_PSIZE = "0.3 + (t0 * 7 % 60) / 100.0"
_SZ = f"""{_TB}, sz AS (SELECT symbol, t0 AS idx, least(greatest(({_PSIZE} - 0.5) / 0.5, 0), 1) AS size FROM lb), ru AS (SELECT *, sum(CASE WHEN pos <> pp THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY idx), 0) AS pp FROM pi)),
 cs AS (SELECT ru.symbol, ru.idx, ru.date, ru.pos, coalesce(first_value(size IGNORE NULLS) OVER (PARTITION BY ru.symbol, run ORDER BY ru.idx ROWS UNBOUNDED PRECEDING), 1.0) AS size FROM ru LEFT JOIN sz ON sz.symbol = ru.symbol AND sz.idx = ru.idx),
 sw AS (SELECT *, sum(CASE WHEN pos = 1 THEN size ELSE 0 END) OVER (PARTITION BY date) AS lg, sum(CASE WHEN pos = -1 THEN size ELSE 0 END) OVER (PARTITION BY date) AS sh FROM cs)"""


@query(f"WITH RECURSIVE {_SZ} SELECT symbol, idx, round(size, 6) AS size, round(CASE WHEN lg > 0 AND sh > 0 AND pos = 1 THEN 0.5 * size / lg WHEN lg > 0 AND sh > 0 AND pos = -1 THEN -0.5 * size / sh ELSE 0 END, 6) + 0.0 AS weight FROM sw")
def l13_l15_sized_weights(spark: SparkSession, d: str) -> DataFrame:
    labels, p = _labels(spark, d)
    sized = labels.withColumn("size", L.bet_size(0.3 + F.col("t0") * 7 % 60 / 100.0, "size", 0.5))
    return L.sized_weights(L.carry_size(p, sized)).select("symbol", "idx", F.round("size", 6).alias("size"), *r6("weight"))


def _verdict_sql() -> str:
    parts, ends = [], []
    sizes = {"off": "1.0", "gate": f"CASE WHEN {_PSIZE} >= 0.5 THEN 1.0 ELSE 0.0 END", "size": f"least(greatest(({_PSIZE} - 0.5) / 0.5, 0), 1)"}
    for m, size in sizes.items():
        parts.append(f"""z_{m} AS (SELECT symbol, t0 AS idx, {size} AS size FROM lb), c_{m} AS (SELECT ru.date, ru.symbol, ru.pos, coalesce(first_value(size IGNORE NULLS) OVER (PARTITION BY ru.symbol, run ORDER BY ru.idx ROWS UNBOUNDED PRECEDING), 1.0) AS size FROM ru LEFT JOIN z_{m} z ON z.symbol = ru.symbol AND z.idx = ru.idx),
 s_{m} AS (SELECT *, sum(CASE WHEN pos = 1 THEN size ELSE 0 END) OVER (PARTITION BY date) AS lg, sum(CASE WHEN pos = -1 THEN size ELSE 0 END) OVER (PARTITION BY date) AS sh FROM c_{m}), w_{m} AS (SELECT date, symbol, CASE WHEN lg > 0 AND sh > 0 AND pos = 1 THEN 0.5 * size / lg WHEN lg > 0 AND sh > 0 AND pos = -1 THEN -0.5 * size / sh ELSE 0 END AS weight FROM s_{m}),
 h_{m} AS (SELECT ret.date, ret.ret, lag(weight, 2) OVER (PARTITION BY ret.symbol ORDER BY ret.date) AS h FROM ret LEFT JOIN w_{m} w ON w.date = ret.date AND w.symbol = ret.symbol), p_{m} AS (SELECT date, sum(coalesce(h * ret, 0)) AS pnl FROM h_{m} GROUP BY 1)""")
        ends.append(f"SELECT '{m}' AS mode, count(*) AS days, round(avg(pnl) / stddev_samp(pnl) * sqrt(252), 5) AS sharpe FROM p_{m} WHERE pnl <> 0")
    runs = "ru AS (SELECT *, sum(CASE WHEN pos <> pp THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY idx) AS run FROM (SELECT *, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY idx), 0) AS pp FROM pi))"
    return f"WITH RECURSIVE {_TB}, {runs}, {', '.join(parts)} {' UNION ALL '.join(ends)}"


@query(_verdict_sql())
def l16_l17_meta_verdict(spark: SparkSession, d: str) -> DataFrame:
    """Sharpe ratio of the book without meta-labels, and gated or sized by them, on one set of returns."""
    labels, p = _labels(spark, d)
    r = base.returns(spark, d)
    out = None
    for mode, floor in (("off", 0.0), ("gate", 0.5), ("size", 0.5)):
        sized = labels.withColumn("size", L.bet_size(0.3 + F.col("t0") * 7 % 60 / 100.0, mode, floor))
        w = L.sized_weights(L.carry_size(p, sized))
        one = R.active_sharpe(R.paper_pnl(w, r)).withColumn("mode", F.lit(mode))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "days", F.round("sharpe", 5).alias("sharpe"))


def _engine_b_sql() -> str:
    parts = []
    for m in ("off", "gate", "size"):
        parts.append(f"""SELECT '{m}' AS mode, ret.date, ret.symbol, ret.ret, ret.close, lag(coalesce(weight, 0)) OVER s AS h0, lag(coalesce(weight, 0), 2) OVER s AS h FROM ret LEFT JOIN w_{m} w ON w.date = ret.date AND w.symbol = ret.symbol WINDOW s AS (PARTITION BY ret.symbol ORDER BY ret.date)""")
    sql = _verdict_sql()
    body = sql[: sql.index(" SELECT 'off' AS mode")]
    return f"""{body}, eb AS ({' UNION ALL '.join(parts)}), sn AS (SELECT CAST(unnest([100000.0, 10000000.0]) AS DOUBLE) AS notional), sh AS (SELECT mode, notional, date, coalesce(h * ret, 0) * notional AS gain, floor(abs(coalesce(h0, 0) - coalesce(h, 0)) * notional / close) AS q FROM eb, sn),
 co AS (SELECT mode, notional, date, gain - (q * 0.01 + 0.01 * (100 * floor(q / 100) * (floor(q / 100) - 1) / 2 + (q - 100 * floor(q / 100)) * floor(q / 100))) AS net FROM sh), dy AS (SELECT mode, notional, date, sum(net) AS net FROM co GROUP BY 1, 2, 3)
 SELECT mode, notional, round(sum(net), 2) + 0.0 AS net_pnl, round(avg(net) / stddev_samp(net) * sqrt(252), 4) + 0.0 AS net_sharpe FROM dy GROUP BY 1, 2"""


@query(_engine_b_sql())
def l17_engine_b(spark: SparkSession, d: str) -> DataFrame:
    """Profit and Sharpe ratio net of walking a ladder, per mode of the meta search and size of the book."""
    labels, p = _labels(spark, d)
    scored = labels.select("symbol", "t0", (0.3 + F.col("t0") * 7 % 60 / 100.0).alias("p"))
    modes = [("off", 0.0), ("gate", 0.5), ("size", 0.5)]
    books = L.family_weights(p, scored, modes)
    out = L.engine_b(books, base.returns(spark, d), len(modes), [100_000.0, 10_000_000.0], 0.01, 0.01, 100)
    name = F.get(F.array(*[F.lit(m) for m, _ in modes]), F.col("config"))
    return out.select(name.alias("mode"), "notional", *r6("net_pnl", digits=2), *r6("net_sharpe", digits=4))


# sizing by the model's out-of-sample p, on the positions of the s-scores; a fitted model has no SQL
_FLOORS = [0.5, 0.52, 0.54, 0.56, 0.58, 0.6]


def _scored_events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Positions of the s-scores, and (symbol, t0, p) of their events."""
    p = R.banded_positions(_scores(spark, d).select("date", "symbol", "s")).withColumn("idx", F.row_number().over(Window.partitionBy("symbol").orderBy("date")).cast("bigint"))
    p = cut_lineage(p.join(base.panel(spark, d).select("date", "symbol", "close"), ["date", "symbol"]))  # a row a day and name
    ev, roles = _meta(spark, d, p)
    return p, ev.join(L.out_of_sample(ev, roles, ["abs_s", "regime", "dow"]), "event").select("symbol", "t0", "p")


@query()
def l13_l15_model_weights(spark: SparkSession, d: str) -> DataFrame:
    return L.family_weights(*_scored_events(spark, d), [("size", 0.5)]).select("date", "symbol", "idx", "size", "weight")


@query()
def l16_l17_deflated_verdict(spark: SparkSession, d: str) -> DataFrame:
    """All 13 configurations of the meta search with PSR and DSR; ``verdict`` marks the book without meta-labels and
    the best of those with them."""
    configs = L.family(_FLOORS)
    pnl = R.grid_pnl(L.family_weights(*_scored_events(spark, d), configs), base.returns(spark, d), len(configs))
    of = lambda k: F.get(F.array(*[F.lit(c[k]) for c in configs]), F.col("config"))
    out = V.deflated_trials(pnl, "pnl", "config").withColumn("mode", of(0)).withColumn("floor", of(1))
    rank = F.row_number().over(Window.partitionBy(F.col("mode") == "off").orderBy(F.desc("sharpe"), "config"))  # a row a configuration
    verdict = F.when(rank == 1, F.when(F.col("mode") == "off", "off").otherwise("best"))
    return out.withColumn("verdict", verdict).select("config", "mode", "floor", "verdict", "n", (F.col("sharpe") * 252**0.5).alias("sharpe"), "expected_best", "psr", "dsr")


# ------------------------------------------------------------------ performance

_CR = f"{EQ}, cr AS (SELECT * FROM (SELECT *, equity / lag(equity) OVER (PARTITION BY account ORDER BY date) - 1 AS ret FROM eq) WHERE ret IS NOT NULL)"


@query(f"WITH {_CR} SELECT account, strftime(date, '%Y-%m-%d') AS date, {q6('ret')} FROM cr")
def a1_returns(spark: SparkSession, d: str) -> DataFrame:
    return A.curve_returns(base.equity(spark, d), "account").select("account", iso(), *r6("ret"))


_SUM = f"{_CR}, dd AS (SELECT *, equity / max(equity) OVER (PARTITION BY account ORDER BY date) - 1 AS dd FROM eq), gr AS (SELECT account, count(*) AS n, min(dd) AS max_drawdown, power(arg_max(equity, date) / arg_min(equity, date), 252.0 / (count(*) - 1)) - 1 AS cagr FROM dd GROUP BY 1), sh AS (SELECT account, coalesce(avg(ret) / stddev_samp(ret) * sqrt(252), 0) AS sharpe FROM cr GROUP BY 1)"


@query(f"WITH {_SUM} SELECT account, n, round(max_drawdown, 6) AS max_drawdown, round(cagr, 6) AS cagr, round(cagr / abs(max_drawdown), 6) AS calmar, round(sharpe, 5) AS sharpe FROM gr JOIN sh USING (account)")
def a2_a3_a6_summary(spark: SparkSession, d: str) -> DataFrame:
    return A.summary(base.equity(spark, d), "account").select("account", "n", *r6("max_drawdown", "cagr", "calmar"), *r6("sharpe", digits=5))


@query(f"WITH {EQ}, t AS (SELECT o_custkey % 5 AS account, sum(o_totalprice / 100 * 2) AS traded FROM orders GROUP BY 1) SELECT account, round(any_value(traded) / avg(equity) / (count(*) / 252.0), 4) AS turnover FROM eq JOIN t USING (account) GROUP BY account")
def a4_turnover(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "orders").select((F.col("o_custkey") % 5).alias("account"), F.lit(-2).alias("quantity"), (F.col("o_totalprice") / 100).alias("price"))
    return A.turnover(t, base.equity(spark, d), "account").select("account", F.round("turnover", 4).alias("turnover"))


@query(f"WITH {_CR}, bm AS (SELECT date, ret AS bench FROM cr WHERE account = 0) SELECT account, count(*) AS n, round(regr_slope(ret, bench), 6) + 0.0 AS beta, round(regr_intercept(ret, bench) * 252, 6) + 0.0 AS alpha FROM cr JOIN bm USING (date) GROUP BY account")
def a5_alpha_beta(spark: SparkSession, d: str) -> DataFrame:
    r = A.curve_returns(base.equity(spark, d), "account")
    return A.alpha_beta(r, r.where("account = 0"), "account").select("account", "n", *r6("beta", "alpha"))


@query(f"WITH {_CR}, r AS (SELECT account, avg(ret) AS m, stddev_samp(ret) AS sd FROM cr GROUP BY 1), t AS (SELECT account, arg_max(equity, date) / arg_min(equity, date) - 1 AS total_return FROM eq GROUP BY 1) SELECT account, round(total_return, 6) AS total_return, round(sd, 6) AS volatility, round(total_return / sd, 5) AS ratio, round(m / sd * sqrt(362880), 4) AS sharpe FROM t JOIN r USING (account)")
def a7_crude_measures(spark: SparkSession, d: str) -> DataFrame:
    return A.crude_measures(base.equity(spark, d), "account", "date", 252 * 1440).select("account", *[F.round(c, 6).alias(c) for c in ("total_return", "volatility")], F.round("ratio", 5).alias("ratio"), F.round("sharpe", 4).alias("sharpe"))


@query(f"WITH {TR} SELECT symbol, count(*) AS trades, count(*) FILTER (WHERE type = 'BUY') AS buys, count(*) FILTER (WHERE type = 'SELL') AS sells, CAST(sum(quantity) AS BIGINT) AS shares, round(sum(quantity * price), 2) AS value, round(sum(CASE WHEN type = 'SELL' THEN quantity * price WHEN type = 'BUY' THEN -quantity * price ELSE 0 END), 2) + 0.0 AS net_cash FROM tr GROUP BY symbol")
def a8_trade_stats(spark: SparkSession, d: str) -> DataFrame:
    return A.trade_stats(base.ledger_trades(spark, d), "symbol").select("symbol", "trades", "buys", "sells", "shares", *r6("value", "net_cash", digits=2))


@query(f"WITH {TR} SELECT symbol, type, round(sum(quantity * price) / nullif(sum(quantity), 0), 6) AS vwap FROM tr GROUP BY 1, 2")
def a9_side_vwap(spark: SparkSession, d: str) -> DataFrame:
    return A.side_vwap(base.ledger_trades(spark, d), "symbol").select("symbol", "type", F.round("vwap", 6).alias("vwap"))


_PAIRS = f"{PANEL}, pr AS (SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, corr(a.close, b.close) AS corr, regr_slope(a.close, b.close) AS hedge, regr_r2(a.close, b.close) AS r2 FROM panel a JOIN panel b ON a.date = b.date AND a.symbol < b.symbol GROUP BY 1, 2)"


@query(f"WITH {_PAIRS} SELECT a, b, n, {q6('corr', 'hedge', 'r2')} FROM pr")
def a10_pair_search(spark: SparkSession, d: str) -> DataFrame:
    return A.pair_search(base.panel(spark, d)).select("a", "b", "n", *r6("corr", "hedge", "r2"))


# the unit root test without lagged differences has a closed form
_POLY = lambda cs: " + ".join(f"{c!r} * power(t, {i})" for i, c in enumerate(cs))
_EG = f"""{_PAIRS}, co AS (SELECT a.symbol AS a, b.symbol AS b, a.date, a.close AS xa, b.close AS xb FROM panel a JOIN panel b ON a.date = b.date AND a.symbol < b.symbol), fi AS (SELECT a, b, regr_slope(xa, xb) AS h, regr_intercept(xa, xb) AS alpha FROM co GROUP BY 1, 2),
 re AS (SELECT co.a, co.b, date, alpha, xa - alpha - h * xb AS e FROM co JOIN fi ON fi.a = co.a AND fi.b = co.b), lg AS (SELECT *, lag(e) OVER (PARTITION BY a, b ORDER BY date) AS x FROM re), su AS (SELECT a, b, any_value(alpha) AS alpha, count(x) AS n, sum(x * (e - x)) AS xd, sum(x * x) AS xx, sum((e - x) * (e - x)) AS dd FROM lg WHERE x IS NOT NULL GROUP BY 1, 2),
 tt AS (SELECT *, xd / xx / sqrt((dd - xd * xd / xx) / (n - 1) / xx) AS t FROM su), pz AS (SELECT *, CASE WHEN t <= {A.P_PARTING!r} THEN {_POLY(A.P_SMALL)} ELSE {_POLY(A.P_LARGE)} END AS z FROM tt), pv AS (SELECT a, b, alpha, t, CASE WHEN t > {A.P_HIGHEST!r} THEN 1.0 WHEN t < {A.P_LOWEST!r} THEN 0.0 ELSE {normal_cdf_sql('z')} END AS p FROM pz)"""


def _tested(spark: SparkSession, d: str, lags: int | None) -> DataFrame:
    p = base.panel(spark, d)
    return A.cointegration(p, A.pair_search(p), lags=lags)


@query(f"WITH {_EG} SELECT pr.a, pr.b, {q6('corr', 'hedge', 'r2')}, round(alpha, 5) + 0.0 AS alpha, round(t, 5) AS t, round(p, 6) AS p FROM pr JOIN pv ON pv.a = pr.a AND pv.b = pr.b")
def a10_engle_granger(spark: SparkSession, d: str) -> DataFrame:
    return _tested(spark, d, 0).select("a", "b", *r6("corr", "hedge", "r2"), *r6("alpha", digits=5), F.round("t", 5).alias("t"), F.round("p", 6).alias("p"))


@query(f"WITH {_EG} SELECT pr.a, pr.b, round(0.4 * (1 - p) + 0.4 * r2 + 0.2 * abs(corr), 6) AS score FROM pr JOIN pv ON pv.a = pr.a AND pv.b = pr.b WHERE p < 0.05")
def a11_pair_ranking(spark: SparkSession, d: str) -> DataFrame:
    return A.rank_pairs(A.cointegrated(_tested(spark, d, 0))).select("a", "b", F.round("score", 6).alias("score"))


@query()
def a10_cointegrated_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The pair search as it is run: lagged differences chosen per pair, p below 0.05, ranked."""
    return A.rank_pairs(A.cointegrated(_tested(spark, d, None)))


@query(f"WITH {TR} SELECT type AS strategy, count(*) AS trades, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM tr GROUP BY type")
def a12_strategy_counts(spark: SparkSession, d: str) -> DataFrame:
    return A.strategy_counts(base.ledger_trades(spark, d).withColumnRenamed("type", "strategy")).select("strategy", "trades", F.round("share", 6).alias("share"))


@query("SELECT count(*) AS rows, round(count(*) / 800000.0, 6) AS seconds FROM tick")
def a12_runtime_estimate(spark: SparkSession, d: str) -> DataFrame:
    return A.runtime_estimate(load(spark, d, "tick"), 800_000.0).select("rows", F.round("seconds", 6).alias("seconds"))

