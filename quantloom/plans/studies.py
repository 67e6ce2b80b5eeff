"""Splits (L), metrics and inference (M), portfolios (P), models (N)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..operators import experiments as E
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import models as N
from ..operators import portfolio as P
from ..operators import splits as L
from ..operators import windows as W

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def returns_month(spark, d):
    return W.with_returns(A.bars_nation_month(spark, d), (1,)).select("date", "ticker", "sector", "close", "volume", r6(F.col("return_1d") / 10).alias("r"))


_RET = A.NATION_MONTH + ", ret AS (SELECT date, ticker, sector, close, volume, round(coalesce(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) / 10, 6) + 0.0 AS r FROM bars)"
_WK = A.TYPE_WEEK + ", ds AS (SELECT date, row_number() OVER (ORDER BY date) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars))"


@query("l01_chronological", f"WITH {_WK} SELECT b.date, ticker, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM bars b JOIN ds USING (date)")
def chronological(spark, d):
    return L.chronological(A.bars_type_week(spark, d)).select("date", "ticker", "split")


def _walk(expanding):
    return f"""WITH {_WK}, w AS (SELECT s, row_number() OVER (ORDER BY s) AS wn FROM (SELECT unnest(range(0, (SELECT max(n) FROM ds) - 156 + 1, 26)) AS s))
SELECT CAST(wn AS INT) AS "window", CASE WHEN i < s + 104 THEN 'train' WHEN i < s + 130 THEN 'validation' ELSE 'test' END AS split, date FROM ds JOIN w ON i >= {'0' if expanding else 's'} AND i < s + 156"""


@query("l02_rolling_windows", _walk(False))
def rolling(spark, d):
    return L.walk_forward(A.bars_type_week(spark, d), 104, 26, 26, 26)


@query("l02_expanding_windows", _walk(True))
def expanding(spark, d):
    return L.walk_forward(A.bars_type_week(spark, d), 104, 26, 26, 26, expanding=True)


@query("l03_window_summary", f"SELECT \"window\", split, min(date) AS first_date, max(date) AS last_date, count(*) AS sessions FROM ({_walk(False)}) GROUP BY 1, 2")
def window_summary(spark, d):
    return rolling(spark, d).groupBy("window", "split").agg(F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.count("*").alias("sessions"))


@query("l04_context", f"WITH {_WK}, f AS (SELECT min(i) AS f FROM ds WHERE date >= DATE '1999-01-01') SELECT b.date, ticker, i < f AS context FROM bars b JOIN ds USING (date), f WHERE i >= f - 20")
def context(spark, d):
    return L.with_context(A.bars_type_week(spark, d), "1999-01-01", 20).select("date", "ticker", "context")


@query("l05_yearly_folds", "SELECT y AS year, make_date(y, 1, 1) AS start, least(make_date(y, 12, 31), DATE '2001-06-30') AS stop FROM (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM orders)")
def yearly(spark, d):
    y = A.table(spark, d, "orders").select(F.year("o_orderdate").alias("year")).distinct()
    return y.select("year", F.make_date("year", F.lit(1), F.lit(1)).alias("start"), F.least(F.make_date("year", F.lit(12), F.lit(31)), F.lit("2001-06-30").cast("date")).alias("stop"))


_FOLDS = [(f"{y}-{m}-01", f"{y if m == '01' else y + 1}-{'07' if m == '01' else '01'}-01") for y in (1998, 1999, 2000) for m in ("01", "07")]
_HALF = f"""WITH {_WK}, f(fold, a, b) AS (VALUES {', '.join(f"({k + 1}, DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(_FOLDS))}), x AS (SELECT date, lead(date) OVER (ORDER BY date) AS next_date FROM ds),
sched AS (SELECT fold, date, CASE WHEN date >= a THEN 'test' WHEN next_date >= a THEN 'unused' ELSE 'train' END AS role, next_date FROM x JOIN f ON date < b)"""


@query("l06_half_year_folds", _HALF + " SELECT * FROM sched")
def half_years(spark, d):
    return L.half_year_folds(A.bars_type_week(spark, d), _FOLDS)


@query("l07_transitions", _HALF + " SELECT fold, role, date AS decision_date, next_date AS outcome_date, row_number() OVER (PARTITION BY fold, role ORDER BY date) AS step FROM sched WHERE role <> 'unused' AND next_date IS NOT NULL")
def transitions(spark, d):
    s = half_years(spark, d).where("role != 'unused' and next_date is not null")
    return s.select("fold", "role", F.col("date").alias("decision_date"), F.col("next_date").alias("outcome_date"), F.row_number().over(Window.partitionBy("fold", "role").orderBy("date")).cast("long").alias("step"))


_SCALE = f"WITH {_WK}, st AS (SELECT avg(close) AS cm, coalesce(nullif(stddev_pop(close), 0), 1) AS cs, avg(volume) AS vm, coalesce(nullif(stddev_pop(volume), 0), 1) AS vs FROM bars JOIN ds USING (date) WHERE i < floor(n * 0.6) AND volume > 100)"


@query("l09_scaler", _SCALE + " SELECT round(cm, 6) + 0.0 AS close__mean, round(cs, 6) + 0.0 AS close__scale, round(vm, 6) + 0.0 AS volume__mean, round(vs, 6) + 0.0 AS volume__scale FROM st")
def fit_scaler(spark, d):
    s = L.scaler(L.chronological(A.bars_type_week(spark, d)), ["close", "volume"], (F.col("split") == "train") & (F.col("volume") > 100))
    return s.select(*(r6(F.col(c)).alias(c) for c in s.columns))


@query("l10_scaled", _SCALE + " SELECT date, ticker, round((close - cm) / cs, 6) + 0.0 AS close, round((volume - vm) / vs, 6) + 0.0 AS volume FROM bars, st")
def scale(spark, d):
    panel = L.chronological(A.bars_type_week(spark, d))
    state = L.scaler(panel, ["close", "volume"], (F.col("split") == "train") & (F.col("volume") > 100))
    out = L.scaled(panel.select("date", "ticker", "close", F.col("volume").cast("double").alias("volume")), state, ["close", "volume"])
    return out.select("date", "ticker", r6(F.col("close")).alias("close"), r6(F.col("volume")).alias("volume"))


_GRID = "SELECT a, l, c, row_number() OVER (ORDER BY a, l, c) - 1 AS cell FROM (VALUES ('a2c'), ('ddpg'), ('ppo'), ('sac'), ('td3')) x(a), (VALUES (10), (30)) y(l), (VALUES ('core'), ('full'), ('market')) z(c)"


@query("l11_candidate_grid", f"SELECT a AS algorithm, CAST(l AS BIGINT) AS lookback, c AS features, cell FROM ({_GRID})")
def candidates(spark, d):
    return L.grid(spark, algorithm=["a2c", "ddpg", "ppo", "sac", "td3"], lookback=[10, 30], features=["core", "full", "market"]).withColumn("cell", F.col("cell").cast("long"))


_PLAN = f"""SELECT CAST(cell AS BIGINT) AS candidate, CAST(f AS BIGINT) AS fold, CAST(s AS BIGINT) AS seed, CASE WHEN f <= 2 THEN 'array_batch_01' WHEN f <= 4 THEN 'array_batch_02' ELSE 'array_batch_03' END AS batch,
row_number() OVER (PARTITION BY CASE WHEN f <= 2 THEN 1 WHEN f <= 4 THEN 2 ELSE 3 END ORDER BY cell, f, s) - 1 AS task FROM ({_GRID}), (SELECT unnest(range(1, 7)) AS f), (SELECT unnest(range(3)) AS s)"""


@query("l12_execution_plan", _PLAN)
def plan(spark, d):
    """Cells of 30 candidates, six folds and three seeds; a batch is a pair of folds, with tasks numbered from 0."""
    return L.execution_plan(spark, list(range(30)), list(range(1, 7)), list(range(3)))


@query("l13_regimes", f"WITH {A.TYPE_WEEK} SELECT name, count(DISTINCT date) AS sessions, min(date) AS first_date FROM bars JOIN (VALUES ('calm', DATE '1996-01-01', DATE '1996-12-31'), ('late', DATE '2001-06-01', DATE '2002-12-31')) r(name, a, b) ON date BETWEEN a AND b GROUP BY 1")
def regimes(spark, d):
    r = spark.createDataFrame([("calm", "1996-01-01", "1996-12-31"), ("late", "2001-06-01", "2002-12-31")], "name string, a string, b string").select("name", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    dates = A.bars_type_week(spark, d).select("date").distinct()
    return dates.join(F.broadcast(r), F.col("date").between(F.col("a"), F.col("b"))).groupBy("name").agg(F.count("*").alias("sessions"), F.min("date").alias("first_date"))


@query("l15_eligibility", f"""WITH {A.NATION_MONTH}, {A.MEMBERSHIP}, h AS (SELECT *, count(*) OVER z = 6 AND coalesce(sum(CAST(volume > 3 AS INT)) OVER z, 0) = 6 AS history FROM bars WINDOW z AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))
SELECT h.date, h.ticker, m.ticker IS NOT NULL AS member, volume > 3 AS has_bar, history, m.ticker IS NOT NULL AND volume > 3 AND history AS eligible FROM h LEFT JOIN members m ON m.ticker = h.ticker AND effective_from <= h.date AND h.date < effective_to""")
def eligibility(spark, d):
    b = A.bars_nation_month(spark, d).withColumn("has_bar", F.col("volume") > 3)
    b = b.withColumn("history", W.history_complete("has_bar", 6))
    m = A.membership(spark, d).select(F.col("ticker").alias("__t"), "effective_from", "effective_to")
    j = b.join(m, (F.col("ticker") == F.col("__t")) & (F.col("effective_from") <= F.col("date")) & (F.col("date") < F.col("effective_to")), "left")
    member = F.col("__t").isNotNull()
    return j.select("date", "ticker", member.alias("member"), "has_bar", "history", (member & F.col("has_bar") & F.col("history")).alias("eligible"))


@query("l16_exit_paths", f"""WITH {A.NATION_MONTH}, s AS (SELECT date, ticker, volume % 5 <> 0 AS member, CASE WHEN volume % 3 = 0 THEN 'halted' ELSE 'tradable' END AS status FROM bars),
e AS (SELECT date, ticker FROM (SELECT *, lag(member) OVER (PARTITION BY ticker ORDER BY date) AS b FROM s) WHERE b AND NOT member)
SELECT e.ticker, e.date AS exit_date, min(s.date) AS exit_session, count(DISTINCT s.date) > 0 AS resolved FROM e LEFT JOIN s ON s.ticker = e.ticker AND s.date >= e.date AND s.status = 'tradable' GROUP BY 1, 2""")
def exit_paths(spark, d):
    """The first tradable session at or after an exit: the next such date by a backward running minimum."""
    s = A.bars_nation_month(spark, d).select("date", "ticker", (F.pmod("volume", F.lit(5)) != 0).alias("member"), (F.pmod("volume", F.lit(3)) != 0).alias("tradable"))
    w = W.ordered()
    ahead = F.min(F.when(F.col("tradable"), F.col("date"))).over(w.rowsBetween(0, Window.unboundedFollowing))
    x = s.withColumns({"before": F.lag("member").over(w), "exit_session": ahead}).where("before and not member")
    return x.select("ticker", F.col("date").alias("exit_date"), "exit_session", F.col("exit_session").isNotNull().alias("resolved"))


@query("l18_plan_summary", f"SELECT batch, count(*) AS cells, count(DISTINCT candidate) AS candidates, min(fold) AS first_fold, max(fold) AS last_fold, max(task) + 1 AS tasks FROM ({_PLAN}) GROUP BY 1")
def plan_summary(spark, d):
    return plan(spark, d).groupBy("batch").agg(F.count("*").alias("cells"), F.count_distinct("candidate").alias("candidates"), F.min("fold").alias("first_fold"), F.max("fold").alias("last_fold"), (F.max("task") + 1).alias("tasks"))


_CR = A.CURVES + ", cr AS (SELECT *, coalesce(value / lag(value) OVER (PARTITION BY policy ORDER BY date) - 1, 0) AS r, value / max(value) OVER (PARTITION BY policy ORDER BY date) - 1 AS dd FROM curve)"
_M01 = f"""WITH {_CR}, a AS (SELECT policy, count(*) AS n, arg_max(value, date) / arg_min(value, date) AS g, arg_max(value, date) AS fv, stddev_pop(r) * sqrt(252) AS vol, sqrt(avg(least(r, 0) * least(r, 0))) * sqrt(252) AS dn, min(dd) AS mdd, avg(CAST(r > 0 AS DOUBLE)) AS win,
  sum(greatest(r, 0)) AS gain, sum(greatest(-r, 0)) AS loss, quantile_cont(r, 0.05) AS var, avg(turnover) AS mt, sum(turnover) AS tt, sum(cost) AS tc, sum(slippage) AS ts, count(*) FILTER (turnover > 1e-6) AS act, avg(cash_weight) AS cash FROM cr GROUP BY 1),
t AS (SELECT policy, avg(r) AS cvar FROM cr JOIN a USING (policy) WHERE r <= var GROUP BY 1), y AS (SELECT *, pow(g, 252.0 / n) - 1 AS ann FROM a LEFT JOIN t USING (policy))
SELECT policy, round(g - 1, 6) + 0.0 AS cumulative_return, round(ann, 4) + 0.0 AS annual_return, round(vol, 6) + 0.0 AS volatility, round(coalesce(ann / nullif(vol, 0), 0), 4) + 0.0 AS sharpe, round(coalesce(ann / nullif(dn, 0), 0), 4) + 0.0 AS sortino, round(mdd, 6) + 0.0 AS max_drawdown,
  round(coalesce(ann / nullif(abs(mdd), 0), 0), 4) + 0.0 AS calmar, round(win, 6) + 0.0 AS win_rate, round(coalesce(gain / nullif(loss, 0), 0), 6) + 0.0 AS profit_factor, round(dn, 6) + 0.0 AS downside_deviation, round(var, 6) + 0.0 AS var_95, round(coalesce(cvar, 0), 6) + 0.0 AS cvar_95,
  round(mt, 6) + 0.0 AS average_turnover, round(tt, 5) + 0.0 AS total_turnover, round(tc, 4) + 0.0 AS total_cost, round(ts, 4) + 0.0 AS total_slippage, act AS active_steps, round(cash, 6) + 0.0 AS average_cash, fv AS final_value FROM y"""


@query("m01_equity_metrics", _M01)
def equity(spark, d):
    m = M.equity_metrics(A.curves(spark, d))
    four, whole = {"annual_return", "sharpe", "sortino", "calmar", "total_cost", "total_slippage"}, {"policy", "active_steps", "final_value"}
    return m.select(*(F.col(c) if c in whole else (F.round(c, 5 if c == "total_turnover" else 4 if c in four else 6) + 0.0).alias(c) for c in m.columns))


_BM = f"""WITH {A.CURVES}, x AS (SELECT c.policy, c.date, c.value / lag(c.value) OVER w - 1 AS r, b.value / lag(b.value) OVER w - 1 AS b FROM curve c JOIN curve b ON c.date = b.date AND b.policy = 'BUILDING' WINDOW w AS (PARTITION BY c.policy ORDER BY c.date)),
y AS (SELECT policy, covar_pop(r, b) / nullif(var_pop(b), 0) AS beta, avg(r) AS mr, avg(b) AS mb, stddev_pop(r - b) * sqrt(252) AS te, pow(exp(sum(ln(1 + r))), 252.0 / count(*)) - pow(exp(sum(ln(1 + b))), 252.0 / count(*)) AS ex, coalesce(corr(r, b), 0) AS co,
  avg(r) FILTER (b > 0) / nullif(avg(b) FILTER (b > 0), 0) AS up, avg(r) FILTER (b < 0) / nullif(avg(b) FILTER (b < 0), 0) AS dn FROM x WHERE r IS NOT NULL GROUP BY 1)
SELECT policy, round(beta, 6) + 0.0 AS beta, round((mr - beta * mb) * 252, 6) + 0.0 AS alpha, round(te, 6) + 0.0 AS tracking_error, round(coalesce(ex / nullif(te, 0), 0), 5) + 0.0 AS information_ratio, round(ex, 6) + 0.0 AS excess_return, round(co, 6) + 0.0 AS correlation,
  round(coalesce(up, 0), 6) + 0.0 AS up_capture, round(coalesce(dn, 0), 6) + 0.0 AS down_capture FROM y WHERE policy <> 'BUILDING'"""


@query("m02_benchmark_metrics", _BM)
def benchmark(spark, d):
    c = A.curves(spark, d)
    m = M.benchmark_metrics(c.where("policy != 'BUILDING'"), c.where("policy = 'BUILDING'"))
    return m.select("policy", *((F.round(x, 5 if x == "information_ratio" else 6) + 0.0).alias(x) for x in m.columns if x != "policy"))


_R = f"WITH {A.CURVES}, x AS (SELECT policy, date, value / lag(value) OVER (PARTITION BY policy ORDER BY date) - 1 AS r FROM curve)"


@query("m03_sharpe", _R + " SELECT policy, round(avg(r) / stddev_samp(r) * sqrt(252), 6) + 0.0 AS sharpe, count(r) AS n FROM x WHERE r IS NOT NULL GROUP BY 1")
def sharpe(spark, d):
    return M.sharpe(A.curves(spark, d)).select("policy", r6(F.col("sharpe")).alias("sharpe"), "n")


def _returns(spark, d):
    c = A.curves(spark, d)
    return c.select("date", "policy", r6(F.col("value") / F.lag("value").over(W.ordered("policy")) - 1).alias("r")).where("r is not null")


@query("m05_bootstrap_sharpe", None)
def bootstrap_sharpe(spark, d):
    return I.bootstrap_sharpe(_returns(spark, d), "policy", "date", "r")


@query("m06_bootstrap_difference", None)
def bootstrap_difference(spark, d):
    r = _returns(spark, d)
    base = r.where("policy = 'BUILDING'").select("date", F.col("r").alias("b"))
    return I.bootstrap_difference(r.where("policy != 'BUILDING'").join(base, "date"), "policy", "date", "r", "b")


@query("m07_probabilistic_z", _R + """, y AS (SELECT policy, count(r) AS n, avg(r) AS m, stddev_samp(r) AS s, avg(r * r) AS a, avg(r * r * r) AS b, avg(r * r * r * r) AS c FROM x WHERE r IS NOT NULL GROUP BY 1),
z AS (SELECT *, m / s AS sr, (b - 3 * m * a + 2 * m * m * m) / pow(a - m * m, 1.5) AS sk, (c - 4 * m * b + 6 * m * m * a - 3 * m * m * m * m) / ((a - m * m) * (a - m * m)) AS ku FROM y)
SELECT policy, n, round(sr, 6) + 0.0 AS sharpe, round(sk, 4) + 0.0 AS skew, round(ku, 4) + 0.0 AS kurtosis, round(sr * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr), 4) + 0.0 AS z FROM z""")
def probabilistic(spark, d):
    m = M.probabilistic_z(A.curves(spark, d))
    return m.select("policy", "n", r6(F.col("sharpe")).alias("sharpe"), *((F.round(c, 4) + 0.0).alias(c) for c in ("skew", "kurtosis", "z")))


@query("m08_deflated", None)
def deflated(spark, d):
    return I.deflated(M.probabilistic_z(A.curves(spark, d)), trials=30, spread=0.1)


@query("m09_significance", None)
def significance(spark, d):
    return bootstrap_sharpe(spark, d).join(deflated(spark, d), "policy").join(bootstrap_difference(spark, d).select("policy", "difference", "p"), "policy", "left")


@query("m10_sign_flip", None)
def sign_flip(spark, d):
    e = returns_month(spark, d)
    return I.sign_flip(e, "sector", "r", order=["date", "ticker"])


@query("m11_holm", "WITH p AS (SELECT s_suppkey, s_nationkey, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE (s_suppkey % 50 + 1) / 1000.0::DOUBLE END AS p FROM supplier), k AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey, p IS NULL ORDER BY p, s_suppkey) AS k, count(p) OVER (PARTITION BY s_nationkey, p IS NULL) AS m FROM p) SELECT s_suppkey, s_nationkey, round(CASE WHEN p IS NOT NULL THEN least(max((m - k + 1) * p) OVER (PARTITION BY s_nationkey, p IS NULL ORDER BY k), 1.0) END, 6) AS holm FROM k")
def holm(spark, d):
    p = A.table(spark, d, "supplier").select("s_suppkey", "s_nationkey", F.when(F.pmod("s_suppkey", F.lit(7)) != 0, (F.pmod("s_suppkey", F.lit(50)) + 1) / 1000.0).alias("p"))
    return M.holm(p, order=["s_suppkey"], within=["s_nationkey"]).select("s_suppkey", "s_nationkey", F.round("holm", 6).alias("holm"))


@query("m12_bootstrap_mean", None)
def bootstrap_mean(spark, d):
    return I.bootstrap_mean(returns_month(spark, d).orderBy("date", "ticker"), "sector", "r", cluster="date")


@query("m13_group_summary", f"WITH {_RET} SELECT sector, round(avg(r), 6) + 0.0 AS mean, round(median(r), 6) + 0.0 AS median, round(stddev_samp(r), 6) + 0.0 AS std, count(*) AS runs, count(DISTINCT ticker) AS seeds, count(DISTINCT date) AS windows FROM ret GROUP BY 1")
def group_summary(spark, d):
    f = I.group_figures(returns_month(spark, d), ["sector"], "r", {"seeds": "ticker", "windows": "date"})
    return f.select("sector", "runs", "seeds", "windows", *(r6(F.col(c)).alias(c) for c in ("mean", "median", "std")))


@query("m14_paired_excess", f"WITH {A.CURVES} SELECT c.date, c.policy, b.policy AS baseline, c.value, round(c.value - b.value, 6) + 0.0 AS excess FROM curve c JOIN curve b ON c.date = b.date AND b.policy IN ('BUILDING', 'MACHINERY') WHERE c.policy NOT IN ('BUILDING', 'MACHINERY')")
def paired(spark, d):
    return M.paired_excess(A.curves(spark, d), ["BUILDING", "MACHINERY"], ["date"], "value").select("date", "policy", "baseline", "value", r6(F.col("excess")).alias("excess"))


@query("m15_paired_summary", f"WITH {A.CURVES}, e AS (SELECT c.policy, c.value - b.value AS x FROM curve c JOIN curve b ON c.date = b.date AND b.policy = 'BUILDING' WHERE c.policy <> 'BUILDING') SELECT policy, round(avg(x), 4) + 0.0 AS mean_excess, round(avg(CAST(x > 0 AS DOUBLE)), 6) + 0.0 AS positive_rate, count(*) AS n FROM e GROUP BY 1")
def paired_summary(spark, d):
    e = M.paired_excess(A.curves(spark, d), ["BUILDING"], ["date"], "value")
    return e.groupBy("policy").agg((F.round(F.avg("excess"), 4) + 0.0).alias("mean_excess"), r6(I.positive_rate("excess")).alias("positive_rate"), F.count("*").alias("n"))


@query("m16_ablation_pairs", f"WITH {_RET}, a AS (SELECT sector, date, avg(r) AS x FROM ret GROUP BY 1, 2) SELECT c.sector, round(avg(c.x - b.x), 6) + 0.0 AS difference, count(*) AS n FROM a c JOIN a b ON c.date = b.date AND b.sector = 'ASIA' WHERE c.sector <> 'ASIA' GROUP BY 1")
def ablation(spark, d):
    a = returns_month(spark, d).groupBy("sector", "date").agg(F.avg("r").alias("x"))
    e = M.paired_excess(a, ["ASIA"], ["date"], "x", by="sector")
    return e.groupBy("sector").agg(r6(F.avg("excess")).alias("difference"), F.count("*").alias("n"))


@query("m17_attribution", None)
def attribution(spark, d):
    """Change of a linear policy's weights when one feature's dates are shuffled: half the L1 shift."""
    b = W.technical_features(A.bars_type_week(spark, d)).select("date", "ticker", "return_5d", "rsi_14", "ma_ratio_10")
    return N.permutation_shift(b, ["return_5d", "rsi_14", "ma_ratio_10"], seed=0)


@query("m18_transition_summary", f"WITH {_CR} SELECT policy, round(sum(ln(1 + r)), 6) + 0.0 AS log_return, round(min(dd), 6) + 0.0 AS max_drawdown, round(sum(turnover), 5) + 0.0 AS turnover, count(*) AS transitions FROM cr GROUP BY 1")
def transition_summary(spark, d):
    m = M.transition_summary(A.curves(spark, d))
    return m.select("policy", r6(F.col("log_return")).alias("log_return"), r6(F.col("max_drawdown")).alias("max_drawdown"), (F.round("turnover", 5) + 0.0).alias("turnover"), "transitions")


@query("m20_annual_log_excess", f"WITH {_CR}, a AS (SELECT policy, sum(ln(1 + r)) AS l, min(dd) AS m, count(*) AS n FROM cr GROUP BY 1) SELECT a.policy, round(252.0 / a.n * (a.l - b.l), 6) + 0.0 AS log_excess, round(a.m - b.m, 6) + 0.0 AS drawdown_excess FROM a JOIN a b ON b.policy = 'BUILDING' WHERE a.policy <> 'BUILDING'")
def log_excess(spark, d):
    m = M.transition_summary(A.curves(spark, d))
    b = m.where("policy = 'BUILDING'").select(F.col("log_return").alias("l"), F.col("max_drawdown").alias("m"))
    return m.where("policy != 'BUILDING'").crossJoin(F.broadcast(b)).select("policy", r6(252.0 / F.col("transitions") * (F.col("log_return") - F.col("l"))).alias("log_excess"), r6(F.col("max_drawdown") - F.col("m")).alias("drawdown_excess"))


@query("m23_full_row", f"SELECT a.policy, cumulative_return, max_drawdown, beta, correlation FROM ({_M01}) a JOIN ({_BM}) b ON a.policy = b.policy")
def full_row(spark, d):
    return equity(spark, d).select("policy", "cumulative_return", "max_drawdown").join(benchmark(spark, d).select("policy", "beta", "correlation"), "policy")


_SIM = f"""WITH {_RET}, w AS (SELECT 'equal_weight' AS policy, date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM bars),
mv AS (SELECT *, abs(weight - coalesce(lag(weight) OVER (PARTITION BY policy, ticker ORDER BY date), 0)) AS mv FROM w),
s AS (SELECT policy, date, sum(mv) AS mv, sum(weight) AS inv, sum(weight * coalesce(r, 0)) AS gross FROM mv LEFT JOIN ret USING (date, ticker) GROUP BY 1, 2),
t AS (SELECT *, mv + abs((1 - inv) - coalesce(lag(1 - inv) OVER (PARTITION BY policy ORDER BY date), 1)) AS turnover FROM s), n AS (SELECT *, gross - turnover * 0.0015::DOUBLE - turnover * 0.0005::DOUBLE AS net FROM t),
v AS (SELECT *, 100000 * exp(sum(ln(1 + net)) OVER (PARTITION BY policy ORDER BY date)) AS value FROM n)"""


@query("p01_closed_form", _SIM + " SELECT policy, date, round(value, 4) + 0.0 AS value, round(net + 1e-9, 6) + 0.0 AS net, round(turnover, 6) + 0.0 AS turnover, round(1 - value / greatest(100000, max(value) OVER (PARTITION BY policy ORDER BY date)), 6) + 0.0 AS drawdown FROM v")
def closed_form(spark, d):
    c = P.closed_form(P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d), 0.0015, 0.0005)
    return c.select("policy", "date", (F.round("value", 4) + 0.0).alias("value"), r6(F.col("net") + 1e-9).alias("net"), r6(F.col("turnover")).alias("turnover"), r6(F.col("drawdown")).alias("drawdown"))


@query("p02_turnover_cap", None)
def capped(spark, d):
    return P.simulate(P.momentum(W.with_returns(A.bars_type_week(spark, d), (5,)), "return_5d"), W.with_returns(A.bars_type_week(spark, d), (1,)).select("date", "ticker", (F.col("return_1d") / 10).alias("r")), 0.002, cap=0.2, drift=False)


@query("p03_self_financing", None)
def self_financing(spark, d):
    return P.simulate(P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d), 0.002, every=3)


@query("p04_rewards", f"WITH {_CR} SELECT date, policy, round(ln(1 + r), 6) + 0.0 AS log_reward, round(dd, 6) + 0.0 AS drawdown_level, round(dd - coalesce(lag(dd) OVER (PARTITION BY policy ORDER BY date), 0), 6) + 0.0 AS drawdown_step FROM cr")
def rewards(spark, d):
    w = W.ordered("policy")
    c = W.with_drawdown(A.curves(spark, d)).withColumn("r", F.coalesce(F.col("value") / F.lag("value").over(w) - 1, F.lit(0.0)))
    return c.select("date", "policy", r6(F.log1p("r")).alias("log_reward"), r6(F.col("drawdown")).alias("drawdown_level"), r6(F.col("drawdown") - F.coalesce(F.lag("drawdown").over(w), F.lit(0.0))).alias("drawdown_step"))


@query("p04_differential_sharpe", None)
def differential(spark, d):
    return N.differential_sharpe(_returns(spark, d), decay=0.04)


@query("p05_execution", f"""WITH {A.NATION_MONTH}, o AS (SELECT 'x' AS policy, date, ticker, 1.0::DOUBLE / 40 AS held, (volume % 10) / 200.0::DOUBLE AS target, volume % 4 <> 0 AS can_buy, volume % 6 <> 0 AS can_sell, volume % 5 = 0 AS forced FROM bars),
a AS (SELECT *, CASE WHEN forced AND can_sell THEN 0.0 WHEN NOT can_sell THEN greatest(target, held) ELSE target END AS w0 FROM o), b AS (SELECT *, (CASE WHEN NOT can_buy THEN least(w0, held) ELSE w0 END) - held AS mv, forced AND can_sell AS must FROM a),
c AS (SELECT *, sum(CASE WHEN NOT must THEN abs(mv) ELSE 0 END) OVER (PARTITION BY date) AS fr FROM b), e AS (SELECT *, CASE WHEN NOT must AND fr > 0.2 THEN mv * 0.2::DOUBLE / fr ELSE mv END AS m2 FROM c),
f AS (SELECT *, 1 - sum(held) OVER (PARTITION BY date) + sum(greatest(-m2, 0)) OVER (PARTITION BY date) * (1 - 0.002::DOUBLE) AS cash, sum(greatest(m2, 0)) OVER (PARTITION BY date) * (1 + 0.002::DOUBLE) AS need FROM e),
g AS (SELECT *, CASE WHEN m2 > 0 THEN m2 * CASE WHEN need > cash THEN greatest(cash, 0) / nullif(need, 0) ELSE 1.0 END ELSE m2 END AS tr FROM f)
SELECT date, ticker, round(tr, 6) + 0.0 AS trade, round(held + tr, 6) + 0.0 AS after, round(abs(tr) * 0.002::DOUBLE, 6) + 0.0 AS paid FROM g""")
def execution(spark, d):
    v = F.col("volume")
    o = A.bars_nation_month(spark, d).select(F.lit("x").alias("policy"), "date", "ticker", F.lit(1.0 / 40).alias("held"), (F.pmod(v, F.lit(10)) / 200.0).alias("target"), (F.pmod(v, F.lit(4)) != 0).alias("can_buy"), (F.pmod(v, F.lit(6)) != 0).alias("can_sell"), (F.pmod(v, F.lit(5)) == 0).alias("forced_exit"))
    return P.execute(o, 0.002, 0.2).select("date", "ticker", *(r6(F.col(c)).alias(c) for c in ("trade", "after", "paid")))


@query("p07_momentum", f"WITH {A.NATION_MONTH}, r AS (SELECT *, coalesce(close / nullif(lag(close, 5) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS r5 FROM bars), s AS (SELECT date, ticker, greatest(coalesce(lag(r5) OVER (PARTITION BY ticker ORDER BY date), 0), 0) AS s FROM r) SELECT 'momentum' AS policy, date, ticker, round(coalesce(s / nullif(sum(s) OVER (PARTITION BY date), 0), 0), 6) + 0.0 AS weight FROM s")
def momentum(spark, d):
    return P.momentum(W.with_returns(A.bars_nation_month(spark, d), (5,)), "return_5d").withColumn("weight", r6(F.col("weight")))


@query("p07_single_name", f"WITH {A.NATION_MONTH} SELECT 'hold_NATION_12' AS policy, date, ticker, CAST(ticker = 'NATION_12' AS DOUBLE) AS weight FROM bars")
def single(spark, d):
    return P.single_name(A.bars_nation_month(spark, d), "NATION_12")


@query("p08_mean_variance", None)
def mean_variance(spark, d):
    return P.mean_variance(W.with_returns(A.bars_type_week(spark, d), (1,)).select("date", "ticker", F.col("return_1d").alias("r")))


_IDX = f"WITH {A.TYPE_WEEK}, i AS (SELECT date, round(sum(close), 6) + 0.0 AS c FROM bars GROUP BY 1)"


@query("p10_price_benchmark", _IDX + ", n AS (SELECT *, row_number() OVER (ORDER BY date) AS k FROM i) SELECT date, CASE WHEN k = 1 THEN 100000.0 ELSE round(100000 * (1 - 0.0015::DOUBLE - 0.0005::DOUBLE) * c / first_value(c) OVER (ORDER BY date), 4) + 0.0 END::DOUBLE AS value, CASE WHEN k = 2 THEN 1.0 ELSE 0.0 END::DOUBLE AS turnover FROM n")
def price_benchmark(spark, d):
    """The series is bought after its first value: that is the capital, those that follow bear the cost."""
    i = A.bars_type_week(spark, d).groupBy("date").agg(r6(F.sum("close")).alias("c"))
    p = P.price_benchmark(i, "c", 0.0015, 0.0005)
    return p.select("date", F.when(F.col("value") == 100000, F.col("value")).otherwise(F.round("value", 4) + 0.0).alias("value"), "turnover")


@query("p11_buy_and_hold", f"WITH {A.NATION_MONTH}, f AS (SELECT date, close / first_value(close) OVER (PARTITION BY ticker ORDER BY date) AS x FROM bars) SELECT date, round(avg(x), 6) + 0.0 AS growth FROM f GROUP BY 1")
def buy_and_hold(spark, d):
    x = A.bars_nation_month(spark, d).select("date", (F.col("close") / F.first("close").over(W.ordered())).alias("x"))
    return x.groupBy("date").agg(r6(F.avg("x")).alias("growth"))


@query("p12_masked_equal", f"WITH {A.NATION_MONTH}, m AS (SELECT *, CAST(volume % 3 <> 0 AS DOUBLE) AS o FROM bars) SELECT 'active_equal' AS policy, date, ticker, round(coalesce(o / nullif(sum(o) OVER (PARTITION BY date), 0), 0), 6) + 0.0 AS weight FROM m")
def masked(spark, d):
    b = A.bars_nation_month(spark, d).withColumn("on", F.pmod("volume", F.lit(3)) != 0)
    return P.masked_equal(b, "on").withColumn("weight", r6(F.col("weight")))


@query("p13_stress", _SIM.replace("0.0015::DOUBLE", "k").replace("0.0005::DOUBLE", "h").replace("n AS (SELECT *, gross", "sc(scenario, k, h) AS (VALUES ('base', 0.0015::DOUBLE, 0.0005::DOUBLE), ('double', 0.003::DOUBLE, 0.001::DOUBLE), ('free', 0.0::DOUBLE, 0.0::DOUBLE)), n AS (SELECT *, gross").replace("AS net FROM t)", "AS net FROM t, sc)").replace("PARTITION BY policy ORDER BY date)) AS value FROM n", "PARTITION BY policy, scenario ORDER BY date)) AS value FROM n") + " SELECT scenario, round(arg_max(value, date), 3) + 0.0 AS final_value, round(sum(turnover), 5) + 0.0 AS turnover FROM v GROUP BY 1")
def stress(spark, d):
    """The steps are made once; each scenario is a curve of them."""
    w, r = P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d)
    x = P.stress(w, r, {"base": (0.0015, 0.0005), "double": (0.003, 0.001), "free": (0.0, 0.0)}, P.closed_form(w, r, 0.0015, 0.0005))
    return x.select("scenario", (F.round("final_value", 3) + 0.0).alias("final_value"), (F.round("turnover", 5) + 0.0).alias("turnover"))


@query("p15_chained", f"WITH {A.CURVES}, f AS (SELECT *, CAST(year(date) AS INT) AS fold FROM curve), g AS (SELECT *, value / first_value(value) OVER (PARTITION BY policy, fold ORDER BY date) AS rel FROM f), e AS (SELECT policy, fold, arg_max(rel, date) AS en FROM g GROUP BY 1, 2), k AS (SELECT policy, fold, coalesce(exp(sum(ln(en)) OVER (PARTITION BY policy ORDER BY fold ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), 1.0) AS k FROM e) SELECT policy, fold, date, round(rel * k, 6) + 0.0 AS growth FROM g JOIN k USING (policy, fold)")
def chained(spark, d):
    c = A.curves(spark, d).withColumn("fold", F.year("date"))
    return P.chained(c).withColumn("growth", r6(F.col("growth")))


@query("p16_random_slices", None)
def random_slices(spark, d):
    return N.random_slices(A.bars_type_week(spark, d), length=52, count=5, seed=0)


def suite_panel(spark, d):
    return W.with_returns(A.bars_nation_month(spark, d), (1, 5))


@query("p18_baseline_suite", None)
def suite(spark, d):
    """Every baseline policy and buy-and-hold of every name, with all metrics."""
    return M.equity_metrics(P.closed_form(E.baselines(suite_panel(spark, d)), returns_month(spark, d), 0.0015, 0.0005))


_P18 = _SIM.split("w AS (SELECT", 1)[0] + f"""p AS (SELECT date, ticker, last_value(close IGNORE NULLS) OVER (PARTITION BY ticker ORDER BY date) AS c, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING) > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING) AS up FROM bars),
m AS (SELECT *, coalesce(c / nullif(lag(c, 5) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS r5 FROM p), q AS (SELECT *, greatest(coalesce(lag(r5) OVER (PARTITION BY ticker ORDER BY date), 0), 0) AS sig FROM m),
w AS (SELECT 'equal_weight' AS policy, date, ticker, 1.0::DOUBLE / count(*) OVER (PARTITION BY date) AS weight FROM bars
  UNION ALL SELECT 'momentum', date, ticker, coalesce(sig / nullif(sum(sig) OVER (PARTITION BY date), 0), 0) FROM q
  UNION ALL SELECT 'ma_crossover', date, ticker, coalesce(CAST(up AS DOUBLE) / nullif(sum(CAST(up AS DOUBLE)) OVER (PARTITION BY date), 0), 0) FROM q
  UNION ALL SELECT 'buy_hold_' || t.ticker, s.date, t.ticker, CASE WHEN b.ticker IS NULL THEN 0.0 ELSE 1.0 END FROM (SELECT DISTINCT date FROM bars) s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.date = s.date AND b.ticker = t.ticker),
mv AS""" + _SIM.split("mv AS", 1)[1]


@query("p18_suite_values", _P18 + " SELECT policy, count(*) AS steps, round(max_by(value, date), 4) + 0.0 AS final_value, round(sum(turnover), 5) + 0.0 AS turnover, round(avg(1 - inv), 6) + 0.0 AS average_cash FROM v GROUP BY 1")
def suite_values(spark, d):
    """The baselines that neither draw nor solve, by their last values, turnover and cash."""
    m = P.closed_form(E.baselines(suite_panel(spark, d)).where("policy not in ('random', 'mean_variance')"), returns_month(spark, d), 0.0015, 0.0005)
    return m.groupBy("policy").agg(F.count("*").alias("steps"), (F.round(F.max_by("value", "date"), 4) + 0.0).alias("final_value"), (F.round(F.sum("turnover"), 5) + 0.0).alias("turnover"), r6(F.avg("cash_weight")).alias("average_cash"))


@query("n01_ridge_forecast", None)
def ridge(spark, d):
    f = W.technical_features(A.bars_type_week(spark, d)).withColumn("y", W.forward_return("close", 21))
    return N.ridge(f, ["return_1d", "return_5d", "volatility_20d", "rsi_14", "bollinger_z"], "y", alpha=1.0, until="1999-12-31")


@query("n01_ridge_folds", None)
def ridge_folds(spark, d):
    """A refit every year, each forecasting the rows up to the next."""
    f = W.technical_features(A.bars_type_week(spark, d)).withColumn("y", W.forward_return("close", 21))
    return N.ridge_folds(f, ["return_1d", "return_5d", "volatility_20d", "rsi_14", "bollinger_z"], "y", 1.0, [f"{y}-12-31" for y in range(1993, 1998)])


@query("n03_expected_score", "SELECT doc_id, round(1.0 * p1 - p0, 6) + 0.0 AS score FROM (SELECT doc_id, (doc_id % 7 + 1)::DOUBLE / (doc_id % 7 + 1 + doc_id % 3 + 1 + 2) AS p1, (doc_id % 3 + 1)::DOUBLE / (doc_id % 7 + 1 + doc_id % 3 + 1 + 2) AS p0 FROM documents)")
def expected(spark, d):
    x = A.table(spark, d, "documents").select("doc_id", F.array(F.struct(F.lit("positive").alias("label"), (F.pmod("doc_id", F.lit(7)) + 1).cast("double").alias("p")), F.struct(F.lit("negative").alias("label"), (F.pmod("doc_id", F.lit(3)) + 1).cast("double").alias("p")), F.struct(F.lit("neutral").alias("label"), F.lit(2.0).alias("p"))).alias("s"))
    return x.select("doc_id", r6(N.expected_value(F.col("s"), {"positive": 1.0, "negative": -1.0, "neutral": 0.0})).alias("score"))


@query("n04_pca", None)
def pca(spark, d):
    return N.pca_scores(A.table(spark, d, "embeddings"), "vec_id", "embedding", 4, F.col("vec_id") < 300)


@query("n05_availability_flags", f"WITH {A.NATION_MONTH}, {A.FUNDAMENTALS}, p AS (SELECT ticker, CAST(period_end + INTERVAL 60 DAY AS DATE) AS eff, count(DISTINCT metric) AS k FROM fund WHERE value > 150000 GROUP BY 1, 2), j AS (SELECT b.date, b.ticker, p.eff, p.k FROM bars b ASOF LEFT JOIN p ON b.ticker = p.ticker AND b.date >= p.eff) SELECT date, ticker, CAST(eff IS NOT NULL AS DOUBLE) AS available, round(coalesce(date - eff, 0) / 365.25::DOUBLE, 6) + 0.0 AS age_years, round(coalesce(k, 0) / 5.0::DOUBLE, 6) + 0.0 AS coverage FROM j")
def availability(spark, d):
    from ..operators import asof as J

    p = A.fundamentals(spark, d).where("value > 150000").groupBy("ticker", F.date_add("period_end", 60).alias("eff")).agg(F.count_distinct("metric").alias("k"))
    j = J.asof_join(A.bars_nation_month(spark, d).select("date", "ticker"), p, ["ticker"], "date", "eff", ["k"])
    return j.select("date", "ticker", F.col("matched_at").isNotNull().cast("double").alias("available"), r6(F.coalesce(F.datediff("date", "matched_at"), F.lit(0)) / 365.25).alias("age_years"), r6(F.coalesce("k", F.lit(0)) / 5.0).alias("coverage"))


@query("n08_task_mapping", "SELECT CAST(t AS BIGINT) AS task, CAST(t // 6 AS BIGINT) AS algorithm, CAST(t % 6 AS BIGINT) AS trial FROM range(30) r(t)")
def tasks(spark, d):
    return spark.range(30).select(F.col("id").alias("task"), F.floor(F.col("id") / 6).alias("algorithm"), F.pmod("id", F.lit(6)).alias("trial"))


QUERIES = Q
