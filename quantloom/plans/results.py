"""Results of experiments: metrics with inference (M), portfolios (P), schedules and exits (L), experiments (G, N, X)."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..operators import exits
from ..operators import experiments as E
from ..operators import grid as G
from ..operators import inference as I
from ..operators import metrics as M
from ..operators import models as N
from ..operators import portfolio as P
from ..operators import splits as L
from ..operators import windows as W
from .checks import _checks
from .studies import _CR, _FOLDS, _M01, _RET, _SIM, _WK, _returns, returns_month
from .windows import _TECH

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


# metrics and inference


@query("m04_bootstrap_indices", None)
def bootstrap_indices(spark, d):
    """Rows of one stationary bootstrap sample of each policy's returns: the drawn row and whether a block begins."""
    return I.bootstrap_rows(_returns(spark, d), "policy", "date", "r", mean_block=10.0, seed=0)


@query("m07_probabilistic", None)
def probabilistic(spark, d):
    """The probability itself, of the deviate of m07_probabilistic_z."""
    m = M.probabilistic_z(A.curves(spark, d))
    return m.withColumn("probability", I.probability_over(m, 0.0)).select("policy", "n", "sharpe", "probability")


@query("m13_group_intervals", None)
def group_intervals(spark, d):
    """Runs, months and names, mean, median, deviation and a bootstrap interval of the mean, drawn by month."""
    return I.group_summary(returns_month(spark, d), ["sector"], "r", cluster="date", counts={"seeds": "ticker", "windows": "date"})


@query("m15_paired_inference", None)
def paired_inference(spark, d):
    """Excess over each baseline: mean, interval, share of wins, sign-flip p and Holm's adjusted p."""
    e = M.paired_excess(A.curves(spark, d), ["BUILDING", "MACHINERY"], ["date"], "value")
    return I.paired_summary(e, ["policy", "baseline"], "excess", order=["date"])


@query("m16_ablation_inference", None)
def ablation_inference(spark, d):
    a = returns_month(spark, d).groupBy("sector", "date").agg(F.avg("r").alias("x"))
    e = M.paired_excess(a, ["ASIA"], ["date"], "x", by="sector")
    return I.paired_summary(e, ["sector"], "excess", order=["date"]).withColumn("control", F.lit("ASIA"))


@query("m17_attribution_metrics", None)
def attribution_metrics(spark, d):
    """What shuffling the dates of a group of features does to the return, the Sharpe ratio and the weights of a policy."""
    b = W.technical_features(A.bars_type_week(spark, d)).withColumn("market", F.avg("return_5d").over(Window.partitionBy("date")))
    groups = {"technical": ["return_5d", "rsi_14", "ma_ratio_10"], "range": ["atr_14", "bollinger_z"], "market": ["market"]}

    def policy(x):
        score = np.maximum(x[:, 0] + x[:, 1] + x[:, 2] - x[:, 3] + 0.01 * x[:, 4] + x[:, 5], 0.0)
        return score / score.sum() if score.sum() > 0 else np.zeros(len(x))

    return N.group_attribution(b, groups, policy, "return_1d", repeats=2, seed=0)


_M18 = A.CURVES + """, x AS (SELECT c.policy, c.date, c.value AS v, c.turnover, c.cost / 10000 AS cost, c.slippage / 10000 AS slip, lag(c.value) OVER w AS v0, b.value AS e, lag(b.value) OVER w AS e0, i.value AS s, lag(i.value) OVER w AS s0, row_number() OVER w AS k
  FROM curve c JOIN curve b ON b.date = c.date AND b.policy = 'BUILDING' JOIN curve i ON i.date = c.date AND i.policy = 'MACHINERY' WHERE c.policy NOT IN ('BUILDING', 'MACHINERY') WINDOW w AS (PARTITION BY c.policy ORDER BY c.date)),
y AS (SELECT *, v / max(v) OVER (PARTITION BY policy ORDER BY date) - 1 AS dd, e / max(e) OVER (PARTITION BY policy ORDER BY date) - 1 AS ed FROM x),
t AS (SELECT policy, count(*) AS transitions, arg_max(v, date) / arg_min(v0, date) - 1 AS total, sum(ln(v / v0)) AS lr, sum(turnover) AS tt, avg(turnover) AS mt, sum(cost) AS tc, sum(slip) AS ts, sum(ln(e / e0)) AS el, sum(ln(s / s0)) AS sl, stddev_pop(v / v0 - 1) AS sd FROM y WHERE k > 1 GROUP BY 1),
z AS (SELECT policy, min(dd) AS mdd, min(ed) AS edd FROM y GROUP BY 1)"""
_R4 = {"total_turnover", "total_cost"}


def _transitions(spark, d):
    """Transitions of each policy, beside an equal-weight and an index curve."""
    c = A.curves(spark, d)
    one = lambda p, n: c.where(F.col("policy") == p).select("date", F.col("value").alias(n))
    x = c.where("policy not in ('BUILDING', 'MACHINERY')").join(one("BUILDING", "e"), "date").join(one("MACHINERY", "s"), "date")
    w = W.ordered("policy")
    return x.select("policy", "date", F.lag("value").over(w).alias("portfolio_value_before"), F.col("value").alias("portfolio_value_after"), F.lag("e").over(w).alias("equal_weight_value_before"), F.col("e").alias("equal_weight_value_after"), F.lag("s").over(w).alias("set_index_value_before"), F.col("s").alias("set_index_value_after"), "turnover", (F.col("cost") / 10000).alias("transaction_cost_paid"), (F.col("slippage") / 10000).alias("slippage_paid")).where("portfolio_value_before is not null")


@query("m18_evidence_summary", f"WITH {_M18} SELECT policy, transitions, round(total, 6) + 0.0 AS net_cumulative_return, round(lr, 6) + 0.0 AS net_log_return, round(mdd, 6) + 0.0 AS max_drawdown, round(mt, 6) + 0.0 AS mean_turnover, round(tt, 5) + 0.0 AS total_turnover, round(tc, 6) + 0.0 AS total_cost, round(ts, 6) + 0.0 AS total_slippage, round(el, 6) + 0.0 AS equal_weight_net_log_return, round(edd, 6) + 0.0 AS equal_weight_max_drawdown, round(sl, 6) + 0.0 AS set_index_net_log_return FROM t JOIN z USING (policy)")
def evidence_summary(spark, d):
    m = M.evidence_summary(_transitions(spark, d), ["policy"], "date")
    return m.select("policy", "transitions", *((F.round(c, 5 if c == "total_turnover" else 6) + 0.0).alias(c) for c in m.columns if c not in ("policy", "transitions", "__sd")))


@query("m19_metric_row", f"WITH {_M18} SELECT policy AS candidate_id, 'complete' AS status, round(total, 6) + 0.0 AS net_cumulative_return, round(lr, 6) + 0.0 AS net_log_return, round(coalesce((pow(1 + total, 252.0 / transitions) - 1) / nullif(sd * sqrt(252), 0), 0), 4) + 0.0 AS sharpe, round(mdd, 6) + 0.0 AS max_drawdown, round(mt, 6) + 0.0 AS turnover, round(el, 6) + 0.0 AS equal_weight_net_log_return, round(edd, 6) + 0.0 AS equal_weight_max_drawdown, round(sl, 6) + 0.0 AS set_index_net_log_return FROM t JOIN z USING (policy)")
def metric_row(spark, d):
    m = M.metric_row(_transitions(spark, d).withColumnRenamed("policy", "candidate_id"), ["candidate_id"], "date")
    return m.select("candidate_id", "status", *((F.round(c, 4 if c == "sharpe" else 6) + 0.0).alias(c) for c in m.columns if c not in ("candidate_id", "status")))


@query("m21_comparison", f"SELECT policy, sharpe, cumulative_return, max_drawdown, row_number() OVER (ORDER BY sharpe DESC, cumulative_return DESC, policy) AS place FROM ({_M01})")
def comparison(spark, d):
    m = M.equity_metrics(A.curves(spark, d)).select("policy", (F.round("sharpe", 4) + 0.0).alias("sharpe"), *(r6(F.col(c)).alias(c) for c in ("cumulative_return", "max_drawdown")))
    return m.withColumn("place", F.row_number().over(Window.orderBy(F.desc("sharpe"), F.desc("cumulative_return"), "policy")).cast("long"))


_ACTS = A.NATION_MONTH + ", a AS (SELECT sector AS policy, ticker, CASE WHEN volume % 3 = 0 THEN 0.0 ELSE (volume % 10) / 20.0 END::DOUBLE AS weight FROM bars)"


@query("m21_action_summary", f"WITH {_ACTS} SELECT policy, ticker, round(avg(weight), 6) + 0.0 AS mean_weight, max(weight) AS max_weight, count(*) FILTER (weight > 1e-6) AS active_days FROM a GROUP BY 1, 2")
def action_summary(spark, d):
    v = F.col("volume")
    a = A.bars_nation_month(spark, d).select(F.col("sector").alias("policy"), "ticker", F.when(F.pmod(v, F.lit(3)) == 0, 0.0).otherwise(F.pmod(v, F.lit(10)) / 20.0).alias("weight"))
    return M.action_summary(a).withColumn("mean_weight", r6(F.col("mean_weight")))


@query("m22_seed_mean_curves", f"WITH {A.CURVES}, c AS (SELECT CASE WHEN policy IN ('BUILDING', 'MACHINERY', 'FURNITURE') THEN 'a' ELSE 'b' END AS variant, date, value FROM curve) SELECT variant, date, round(avg(value), 4) + 0.0 AS value FROM c GROUP BY 1, 2")
def seed_mean_curves(spark, d):
    return M.seed_means(_seeded(spark, d)).withColumn("value", F.round("value", 4) + 0.0)


def _seeded(spark, d):
    """Curves of two variants with a seed each: the policies under the names that runs give them."""
    c = A.curves(spark, d).withColumn("n", F.dense_rank().over(Window.orderBy("policy")))
    a = F.col("policy").isin("BUILDING", "MACHINERY", "FURNITURE")
    return c.select(F.concat(F.when(a, "a").otherwise("b"), F.lit("_seed"), F.col("n").cast("string")).alias("policy"), "date", "value")


@query("m22_chained_significance", None)
def chained_significance(spark, d):
    """Bootstrap, probabilistic and deflated Sharpe ratios of seed-mean curves, and each against a reference."""
    return I.significance_table(M.seed_means(_seeded(spark, d)).withColumnRenamed("variant", "policy"), reference="a", trials=30)


# portfolios


@query("p04_reward_terms", f"WITH {_CR}, s AS (SELECT *, -dd AS drawdown FROM cr) SELECT date, policy, round(ln(1 + greatest(r, -0.999999)), 6) + 0.0 AS log_reward, round(r, 6) + 0.0 AS simple_reward, round(drawdown, 6) + 0.0 AS drawdown_level, round(greatest(drawdown - coalesce(lag(drawdown) OVER (PARTITION BY policy ORDER BY date), 0), 0), 6) + 0.0 AS drawdown_increment, round(ln(1 + greatest(r, -0.999999)) - 0.1 * turnover - 0.5 * drawdown, 6) + 0.0 AS reward FROM s")
def reward_terms(spark, d):
    """Log return with its floor, drawdown by level and by increment (never negative), and the weighted sum."""
    return P.reward_terms(A.curves(spark, d), turnover_penalty=0.1, drawdown_penalty=0.5).select("date", "policy", *(r6(F.col(c)).alias(c) for c in ("log_reward", "simple_reward", "drawdown_level", "drawdown_increment", "reward")))


@query("p04_ratio_terms", None)
def ratio_terms(spark, d):
    """Clipped differential Sharpe and downside ratios from the moments before each step."""
    return N.differential_ratios(_returns(spark, d), decay=0.04, clip=10.0)


_P05 = f"""WITH {A.NATION_MONTH}, o AS (SELECT 'x' AS policy, date, ticker, 1.0::DOUBLE / 40 AS held, (volume % 10) / 300.0::DOUBLE AS target, volume % 4 <> 0 AS can_buy, volume % 6 <> 0 AS can_sell, volume % 5 = 0 AS forced, (volume % 7 - 3) / 100.0::DOUBLE AS r FROM bars),
a AS (SELECT *, forced AND NOT can_sell AS pending, forced AND can_sell AS must, CASE WHEN forced AND can_sell THEN 0 WHEN forced THEN held WHEN NOT can_buy AND target > held THEN held WHEN NOT can_sell AND target < held THEN held ELSE target END AS permitted FROM o),
b AS (SELECT *, CASE WHEN must THEN 0 ELSE held END AS mt FROM a), c AS (SELECT *, sum(held - mt) OVER w AS mand, sum(abs(permitted - mt)) OVER w AS disc FROM b WINDOW w AS (PARTITION BY policy, date)),
e AS (SELECT *, mt + CASE WHEN disc > greatest(0.2 - mand, 0) + 1e-12 THEN greatest(0.2 - mand, 0) / disc ELSE 1 END * (permitted - mt) AS tg FROM c), f AS (SELECT *, tg - held AS dl FROM e),
g AS (SELECT *, 1 - sum(held + least(dl, 0)) OVER w + 0.002::DOUBLE * sum(least(dl, 0)) OVER w AS cash, sum(greatest(dl, 0)) OVER w AS buys FROM f WINDOW w AS (PARTITION BY policy, date)),
h AS (SELECT *, held + least(dl, 0) + CASE WHEN buys * 1.002::DOUBLE > greatest(cash, 0) + 1e-12 THEN greatest(cash, 0) / (buys * 1.002::DOUBLE) ELSE 1 END * greatest(dl, 0) AS t2 FROM g),
k AS (SELECT *, sum(abs(t2 - held)) OVER w AS turnover, sum(t2) OVER w AS inv, sum(t2 * (1 + r)) OVER w AS ends FROM h WINDOW w AS (PARTITION BY policy, date)), l AS (SELECT *, ends + 1 - inv - 0.002::DOUBLE * turnover AS mult FROM k)"""


@query("p05_ledger_weights", _P05 + " SELECT date, ticker, round(t2, 6) + 0.0 AS executed, round(t2 - held, 6) + 0.0 AS trade, pending, round(t2 * (1 + r) / mult, 6) + 0.0 AS ending_weight FROM l")
def ledger_weights(spark, d):
    """One rebalance of each date: mandatory exits, frozen holdings, a cap on the rest, costs out of cash."""
    return P.ledger_step(_orders(spark, d), 0.0015, 0.0005, 0.2).select("date", "ticker", r6(F.col("executed")).alias("executed"), r6(F.col("trade")).alias("trade"), "pending", r6(F.col("ending_weight")).alias("ending_weight"))


@query("p05_ledger_totals", _P05 + " SELECT date, round(any_value(turnover), 6) + 0.0 AS turnover, round(any_value(mult) - 1, 6) + 0.0 AS net_return, round(any_value(0.0015::DOUBLE * turnover), 8) + 0.0 AS transaction_cost_paid, round(any_value((1 - inv - 0.002::DOUBLE * turnover) / mult), 6) + 0.0 AS ending_cash, any_value(mand) > 0.2 + 1e-12 AS limit_overridden, true AS reconciles FROM l GROUP BY 1")
def ledger_totals(spark, d):
    t = P.ledger_totals(P.ledger_step(_orders(spark, d), 0.0015, 0.0005, 0.2), 0.0015, 0.0005, 0.2)
    return t.select("date", *(r6(F.col(c)).alias(c) for c in ("turnover", "net_return", "ending_cash")), (F.round("transaction_cost_paid", 8) + 0.0).alias("transaction_cost_paid"), "limit_overridden", "reconciles")


def _orders(spark, d):
    v = F.col("volume")
    m = lambda k: F.pmod(v, F.lit(k))
    return A.bars_nation_month(spark, d).select(F.lit("x").alias("policy"), "date", "ticker", F.lit(1.0 / 40).alias("held"), (m(10) / 300.0).alias("target"), (m(4) != 0).alias("can_buy"), (m(6) != 0).alias("can_sell"), (m(5) == 0).alias("forced_exit"), ((m(7) - 3) / 100.0).alias("r"))


@query("p06_masked_targets", f"WITH {A.NATION_MONTH}, e AS (SELECT date, ticker, volume % 3 <> 0 AS eligible, (volume % 10) / 10.0 AS action FROM bars), a AS (SELECT *, CASE WHEN eligible THEN action ELSE 0 END AS w, lag(eligible) OVER (PARTITION BY ticker ORDER BY date) AS was FROM e), s AS (SELECT *, sum(w) OVER (PARTITION BY date) AS t FROM a) SELECT date, ticker, eligible, coalesce(was AND NOT eligible, false) AS forced_exit, round(CASE WHEN t > 1 THEN w / t ELSE w END, 6) + 0.0 AS weight FROM s")
def masked_targets(spark, d):
    """Actions of eligible names only, within the capital; a name that stops being eligible must be sold."""
    e = A.bars_nation_month(spark, d).select("date", "ticker", (F.pmod("volume", F.lit(3)) != 0).alias("eligible"), (F.pmod("volume", F.lit(10)) / 10.0).alias("action"))
    return P.masked_targets(e).select("date", "ticker", "eligible", "forced_exit", r6(F.col("weight")).alias("weight"))


@query("p07_random_policy", None)
def random_policy(spark, d):
    """Seeded random weights of each date, in a task of their own."""
    return P.random_weights(A.bars_nation_month(spark, d), seed=42)


_P09 = f"WITH {A.TYPE_WEEK}, i AS (SELECT date, round(sum(close), 6) + 0.0 AS c FROM bars GROUP BY 1), r AS (SELECT date, coalesce(c / lag(c) OVER (ORDER BY date) - 1, 0) / 10 AS r, row_number() OVER (ORDER BY date) AS k FROM i), n AS (SELECT date, k, CASE WHEN k = 21 THEN 0 ELSE r - CASE WHEN k = 22 THEN 2.0 * 0.002::DOUBLE ELSE 0 END END AS net, CASE WHEN k = 22 THEN 2.0 ELSE 0.0 END::DOUBLE AS turnover FROM r WHERE k >= 21), v AS (SELECT *, 100000 * exp(sum(ln(1 + net)) OVER (ORDER BY date)) AS value FROM n)"


@query("p09_index_benchmark", _P09 + " SELECT date, round(value, 3) + 0.0 AS value, round(net, 6) + 0.0 AS net, turnover, round(1 - value / greatest(100000, max(value) OVER (ORDER BY date)), 6) + 0.0 AS drawdown FROM v")
def index_benchmark(spark, d):
    """Opens with the capital after a lookback of 20; the first step bears a turnover of 2."""
    i = A.bars_type_week(spark, d).groupBy("date").agg(r6(F.sum("close")).alias("c"))
    r = i.select("date", (F.coalesce(F.col("c") / F.lag("c").over(Window.orderBy("date")) - 1, F.lit(0.0)) / 10).alias("r"))
    b = P.return_benchmark(r, 20, 0.0015, 0.0005)
    return b.select("date", (F.round("value", 3) + 0.0).alias("value"), r6(F.col("net")).alias("net"), "turnover", r6(F.col("drawdown")).alias("drawdown"))


@query("p11_rebalanced", f"""WITH {A.NATION_MONTH}, n AS (SELECT date, ticker, close, (dense_rank() OVER (ORDER BY date) - 1) // 6 AS block FROM bars), s AS (SELECT block, min(date) AS a FROM n GROUP BY 1), p AS (SELECT n.block, n.date, n.ticker, n.close / b.close AS x FROM n JOIN s ON s.block = n.block JOIN n b ON b.date = s.a AND b.ticker = n.ticker),
g AS (SELECT block, date, avg(x) AS g FROM p GROUP BY 1, 2), e AS (SELECT block, min(date) AS a FROM g GROUP BY 1), q AS (SELECT n.block, avg(c.close / b.close) AS growth FROM (SELECT block, a, lead(a) OVER (ORDER BY block) AS nx FROM e) n JOIN n b ON b.date = n.a JOIN n c ON c.date = n.nx AND c.ticker = b.ticker GROUP BY 1),
k AS (SELECT block, exp(coalesce(sum(ln(growth)) OVER (ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS k FROM (SELECT block, growth FROM q UNION ALL SELECT max(block), 1 FROM e WHERE block NOT IN (SELECT block FROM q)))
SELECT date, round(g * k, 5) + 0.0 AS growth FROM g JOIN k USING (block)""")
def rebalanced(spark, d):
    """Equal weights every six dates, drifting between them: blocks in parallel, chained at their ends."""
    g = P.rebalanced_growth(A.bars_nation_month(spark, d).select("date", "ticker", "close"), 6)
    return g.select("date", (F.round("growth", 5) + 0.0).alias("growth"))


@query("p13_stress_replay", _SIM.replace("0.0015::DOUBLE", "k").replace("0.0005::DOUBLE", "h").replace("n AS (SELECT *, gross", "sc(scenario, k, h) AS (VALUES ('base', 0.0015::DOUBLE, 0.0005::DOUBLE), ('double', 0.003::DOUBLE, 0.001::DOUBLE), ('free', 0.0::DOUBLE, 0.0::DOUBLE)), n AS (SELECT *, gross").replace("AS net FROM t)", "AS net FROM t, sc)").replace("PARTITION BY policy ORDER BY date)) AS value FROM n", "PARTITION BY policy, scenario ORDER BY date)) AS value FROM n") + ", f AS (SELECT scenario, arg_max(value, date) AS v, sum(turnover) AS t FROM v GROUP BY 1) SELECT scenario, round(v, 3) + 0.0 AS final_value, round(t, 5) + 0.0 AS turnover, round(v - (SELECT v FROM f WHERE scenario = 'base'), 3) + 0.0 AS change, scenario = 'base' AS replays FROM f")
def stress_replay(spark, d):
    """All scenarios of one set of steps, and whether the base scenario replays the stored curve."""
    w, r = P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d)
    s = P.stress(w, r, {"base": (0.0015, 0.0005), "double": (0.003, 0.001), "free": (0.0, 0.0)}, P.closed_form(w, r, 0.0015, 0.0005))
    return s.select("scenario", (F.round("final_value", 3) + 0.0).alias("final_value"), (F.round("turnover", 5) + 0.0).alias("turnover"), (F.round("change", 3) + 0.0).alias("change"), "replays")


_ROLL = _SIM + ", w2 AS (SELECT policy, date, ticker, weight FROM w)"


@query("p14_rollout_curve", _ROLL + " SELECT policy, date, row_number() OVER (PARTITION BY policy ORDER BY date) - 1 AS step, round(value, 4) + 0.0 AS portfolio_value, round(turnover, 6) + 0.0 AS turnover, round(1 - inv, 6) + 0.0 AS cash_weight FROM v")
def rollout_curve(spark, d):
    return P.rollout(P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d), 0.0015, 0.0005)[0].select("policy", "date", "step", (F.round("value", 4) + 0.0).alias("portfolio_value"), r6(F.col("turnover")).alias("turnover"), r6(F.col("cash_weight") + 1e-12).alias("cash_weight"))


@query("p14_rollout_actions", _ROLL + ", k AS (SELECT *, dense_rank() OVER (PARTITION BY policy ORDER BY date) - 1 AS step FROM w2) SELECT policy, date, step, ticker, round(weight, 6) + 0.0 AS weight FROM k")
def rollout_actions(spark, d):
    return P.rollout(P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d), 0.0015, 0.0005)[1].withColumn("weight", r6(F.col("weight")))


@query("p19_regime_metrics", None)
def regime_metrics(spark, d):
    """Every baseline in every regime that has enough dates, with its metrics."""
    b = W.with_returns(A.bars_nation_month(spark, d), (1, 5))
    return E.regime_suite(b, returns_month(spark, d), {"early": ("1995-06-01", "1997-12-31"), "late": ("2000-01-01", "2001-12-31"), "short": ("1999-01-01", "1999-03-31")}, lookback=10)


@query("p20_walk_forward", None)
def walk_forward_run(spark, d):
    """Windows of the panel; in each the baselines are evaluated on the splits that follow the training."""
    b = W.with_returns(A.bars_nation_month(spark, d), (1, 5))
    return E.walk_forward_run(b, returns_month(spark, d), train=36, validation=12, test=12, step=12)


@query("p22_stress_slices", f"WITH {_WK}, s AS (SELECT unnest(range(0, (SELECT max(n) FROM ds) - 156 + 1, 52)) AS s), w AS (SELECT 'window_' || row_number() OVER (ORDER BY s) AS slice, s + 130 AS a, s + 156 AS b FROM s UNION ALL SELECT 'test', floor(max(n) * 0.8), max(n) FROM ds) SELECT slice, min(date) AS first_date, max(date) AS last_date, count(*) AS sessions FROM ds JOIN w ON i >= a AND i < b GROUP BY 1")
def stress_slices(spark, d):
    """The test parts of locked windows, and the chronological test."""
    return L.stress_slices(A.bars_type_week(spark, d), 104, 26, 26, 52)


# schedules and exits

_PER = ", ".join(f"('fold_0{k + 1}', DATE '{a}', DATE '{b}')" for k, (a, b) in enumerate(_FOLDS))
_SCHED = f"""WITH {_WK}, f(fold, a, b) AS (VALUES {_PER}), v AS (SELECT fold, min(i) AS v0, max(i) AS v1 FROM ds JOIN f ON date >= a AND date < b GROUP BY 1), x AS (SELECT fold, date, i, v0, v1, lead(date) OVER (PARTITION BY fold ORDER BY date) AS nx FROM v JOIN ds ON i <= v1),
y AS (SELECT *, i >= 10 AND i < v0 - 1 AS td, i >= v0 AND i < v1 AS vd FROM x)"""


@query("l06_schedule", _SCHED + " SELECT fold, date, i AS session_index, i < 10 AS train_context, td AS train_decision, i >= 11 AND i < v0 AS train_outcome, i >= v0 - 20 AND i < v0 AS validation_context, vd AS validation_decision, i > v0 AS validation_outcome, i = v0 - 1 AS unused_boundary, CASE WHEN td THEN 'train' WHEN vd THEN 'validation' ELSE '' END AS owner, CASE WHEN td OR vd THEN nx END AS outcome_date FROM y")
def schedule(spark, d):
    """Roles of each session in each fold, who owns the transition that begins there, and the one at the boundary that nobody owns."""
    return L.fold_schedule(A.bars_type_week(spark, d), [(f"fold_0{k + 1}", a, b) for k, (a, b) in enumerate(_FOLDS)], 10, 20)


@query("q33_fold_registry", _SCHED + ", s AS (SELECT fold, count(*) FILTER (td) AS train_decisions, count(*) FILTER (vd) AS validation_decisions, min(date) FILTER (td) AS t0, max(date) FILTER (td) AS t1, min(date) FILTER (i = v0) AS w0, max(date) FILTER (vd) AS w1, max(date) AS w2 FROM y GROUP BY 1) " + _checks(
    folds="SELECT CASE WHEN count(*) = 6 AND count(DISTINCT fold) = 6 THEN 0 ELSE 1 END FROM s", train_before_validation="SELECT count(*) FROM s WHERE NOT (t0 <= t1 AND t1 < w0)", validation_order="SELECT count(*) FROM s WHERE NOT (w0 <= w1 AND w1 < w2)", enough_train="SELECT count(*) FROM s WHERE train_decisions < 200", enough_validation="SELECT count(*) FROM s WHERE validation_decisions < 25", expanding="SELECT count(*) FROM (SELECT train_decisions <= lag(train_decisions) OVER (ORDER BY fold) AS bad FROM s) WHERE bad",
))
def fold_registry(spark, d):
    """The summary of the schedule against the registry: six folds, in order, growing, and with enough decisions."""
    return L.fold_registry_checks(schedule(spark, d), 6, 200, 25)


_L08 = _SCHED + ", b AS (SELECT date, ticker, close, volume::DOUBLE AS volume, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars), e AS (SELECT *, volume > 100 AS eligible FROM b), j AS (SELECT y.fold, y.td, y.vd, e.* FROM y JOIN e USING (date)), st AS (SELECT fold, avg(close) AS cm, coalesce(nullif(stddev_pop(close), 0), 1) AS cs, avg(volume) AS vm, coalesce(nullif(stddev_pop(volume), 0), 1) AS vs FROM j WHERE td AND eligible GROUP BY 1)"


@query("l08_scaled_folds", _L08 + " SELECT fold, CASE WHEN td THEN 'train' WHEN vd THEN 'validation' ELSE 'context' END AS role, count(*) AS rows, count(*) FILTER (eligible) AS eligible, round(avg((close - cm) / cs), 4) + 0.0 AS close_mean, round(avg((volume - vm) / vs), 4) + 0.0 AS volume_mean FROM j JOIN st USING (fold) GROUP BY 1, 2")
def scaled_folds(spark, d):
    """Each fold's rows scaled by the state of its own eligible training rows, two columns, summed up by role."""
    s = L.scaled_folds(A.bars_type_week(spark, d).withColumn("eligible", F.col("volume") > 100).withColumn("volume", F.col("volume").cast("double")), schedule(spark, d), ["close", "volume"], "eligible")
    r4 = lambda c: F.round(F.avg(c), 4) + F.lit(0.0)
    return s.groupBy("fold", "role").agg(F.count("*").alias("rows"), F.count_if("eligible").alias("eligible"), r4("close").alias("close_mean"), r4("volume").alias("volume_mean"))


_L16 = f"""WITH {A.NATION_MONTH}, p AS (SELECT DISTINCT date FROM bars), t AS (SELECT DISTINCT ticker FROM bars), g AS (SELECT p.date, t.ticker, b.volume FROM p CROSS JOIN t LEFT JOIN bars b ON b.date = p.date AND b.ticker = t.ticker),
s AS (SELECT date, ticker, coalesce(volume, 1) % 5 <> 0 AS member, CASE WHEN volume IS NULL OR volume % 23 = 0 THEN NULL WHEN volume % 3 = 0 THEN 'halted' WHEN volume % 7 = 0 THEN 'delisted' WHEN volume % 19 = 0 THEN 'not_yet_listed' ELSE 'trading' END AS status, coalesce(volume, 0) % 11 <> 0 AS bar, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM g),
e AS (SELECT ticker, date AS exit_date, i AS i0 FROM (SELECT *, lag(member) OVER (PARTITION BY ticker ORDER BY date) AS b FROM s) WHERE b AND NOT member),
n AS (SELECT e.ticker, e.exit_date, min(s.i) AS i1, e.i0 FROM e LEFT JOIN s ON s.ticker = e.ticker AND s.i >= e.i0 AND (s.status IS NULL OR s.status NOT IN ('suspended', 'halted', 'no_trade')) GROUP BY ALL)
SELECT n.ticker, n.exit_date, CASE WHEN s.status = 'trading' AND s.bar OR s.status = 'delisted' AND n.ticker <> 'NATION_3' THEN s.date END AS liquidation_date, CASE WHEN s.status = 'trading' AND s.bar OR s.status = 'delisted' AND n.ticker <> 'NATION_3' THEN n.i1 - n.i0 END AS lag_sessions,
  CASE WHEN s.status = 'trading' AND s.bar THEN 'tradable_liquidation' WHEN s.status = 'delisted' AND n.ticker <> 'NATION_3' THEN 'terminal_settlement' ELSE 'unresolved' END AS path_status,
  CASE WHEN s.i IS NULL THEN 'exit_path_ends_before_resolution' WHEN s.status IS NULL THEN 'missing_contiguous_exit_status' WHEN s.status = 'trading' AND NOT s.bar THEN 'trading_exit_without_valid_bar' WHEN s.status = 'delisted' AND n.ticker = 'NATION_3' THEN 'delisting_without_explicit_resolution' WHEN s.status = 'not_yet_listed' THEN 'inconsistent_exit_status:not_yet_listed' ELSE '' END AS blocking_reason
FROM n LEFT JOIN s ON s.ticker = n.ticker AND s.i = n.i1"""


@query("l16_exit_ledger", _L16)
def exit_ledger(spark, d):
    """Each exit from membership to the first session that decides it: sold, settled, or why not."""
    b = A.bars_nation_month(spark, d).select("date", "ticker", "volume")
    grid = b.select("date").distinct().crossJoin(F.broadcast(b.select("ticker").distinct())).join(b, ["date", "ticker"], "left")
    v = F.col("volume")
    m = lambda k: F.pmod(v, F.lit(k)) == 0
    s = grid.select("date", "ticker", (F.pmod(F.coalesce(v, F.lit(1)), F.lit(5)) != 0).alias("member"), F.when(v.isNull() | m(23), None).when(m(3), "halted").when(m(7), "delisted").when(m(19), "not_yet_listed").otherwise("trading").alias("status"), (F.pmod(F.coalesce(v, F.lit(0)), F.lit(11)) != 0).alias("valid_bar"), F.when(F.col("ticker") != "NATION_3", F.lit("a1")).alias("terminal_action"))
    return E.exit_ledger(s)


_EXITS = """WITH b AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_nationkey AS k FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey),
x AS (SELECT date, k, concat('N', CAST(k AS STRING)) AS ticker, (year(date) * 84 + month(date) * 7 + k * k) % 97 AS x FROM b),
panel AS (SELECT date, ticker, k AS asset_slot, x % 4 <> 1 AS is_member FROM x),
sessions AS (SELECT DISTINCT date FROM b WHERE NOT (year(date) = 1996 AND month(date) = 4) AND date < make_date(1998, 7, 1)),
status0 AS (SELECT date, ticker, CASE WHEN x % 16 = 1 THEN 'delisted' WHEN x % 16 = 9 THEN 'not_yet_listed' WHEN x % 3 = 0 THEN 'halted' WHEN x % 3 = 1 THEN 'no_trade' ELSE 'trading' END AS trading_status, x FROM x WHERE x % 23 <> 5),
status AS (SELECT date, ticker, trading_status FROM status0 UNION ALL SELECT date, ticker, 'halted' AS trading_status FROM status0 WHERE x = 30),
bars AS (SELECT date, ticker FROM x WHERE x % 11 <> 2),
actions AS (SELECT concat('a', CAST(s_suppkey AS STRING)) AS action_id, concat('N', CAST(s_nationkey AS STRING)) AS ticker, CASE s_suppkey % 3 WHEN 0 THEN 'dividend' WHEN 1 THEN 'merger' ELSE 'delisting' END AS action_type, make_date(CAST(1993 + s_suppkey % 5 AS INT), 6, 1) AS effective_date,
  CASE WHEN s_suppkey % 4 = 0 THEN 1.0 WHEN s_suppkey % 4 = 1 THEN -1.0 ELSE NULL END AS cash_amount, CASE WHEN s_suppkey % 5 = 0 THEN 'N1' WHEN s_suppkey % 5 = 1 THEN ' ' ELSE NULL END AS successor_ticker FROM {supplier}),
symbols AS (SELECT CASE WHEN n_nationkey = 2 THEN ' ' ELSE concat('i', CAST(n_nationkey AS STRING)) END AS instrument_id, concat('N', CAST(n_nationkey AS STRING)) AS ticker, make_date(1990, 1, 1) AS effective_from, CASE WHEN n_nationkey % 5 = 4 THEN make_date(1996, 1, 1) ELSE make_date(2030, 1, 1) END AS effective_to FROM {nation}
  UNION ALL SELECT 'twice' AS instrument_id, 'N7' AS ticker, make_date(1995, 1, 1) AS effective_from, make_date(1997, 1, 1) AS effective_to)"""
_L16P = A.bare(_EXITS) + """, e AS (SELECT ticker, asset_slot, was_on AS last_active_date, date AS exit_date FROM (SELECT *, lag(is_member) OVER w AS was, lag(date) OVER w AS was_on FROM panel WINDOW w AS (PARTITION BY ticker ORDER BY date)) WHERE was AND NOT is_member),
n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sessions), s AS (SELECT ticker, i, any_value(n.date) AS date, any_value(trading_status) AS st FROM status JOIN n USING (date) GROUP BY 1, 2 HAVING count(*) = 1),
k AS (SELECT e.*, (SELECT CASE WHEN count(*) = 1 THEN nullif(trim(max(instrument_id)), '') END FROM symbols y WHERE y.ticker = e.ticker AND effective_from <= exit_date AND exit_date < effective_to) AS instrument_id, (SELECT min(i) FROM n WHERE n.date >= exit_date) AS i0 FROM e),
f AS (SELECT k.*, (SELECT min(n.i) FROM n WHERE n.i >= k.i0 AND NOT EXISTS (SELECT 1 FROM s WHERE s.ticker = k.ticker AND s.i = n.i AND st IN ('suspended', 'halted', 'no_trade'))) AS i1 FROM k),
g AS (SELECT f.*, n.date AS d, s.st, b.ticker IS NOT NULL AS bar, (SELECT min_by(action_id, (effective_date, action_id)) FROM actions a WHERE a.ticker = f.ticker AND action_type IN ('delisting', 'merger') AND effective_date <= n.date AND (coalesce(cash_amount >= 0, false) OR coalesce(trim(successor_ticker), '') <> '')) AS act
  FROM f LEFT JOIN n ON n.i = f.i1 LEFT JOIN s ON s.ticker = f.ticker AND s.i = f.i1 LEFT JOIN (SELECT DISTINCT date, ticker FROM bars) b ON b.date = n.date AND b.ticker = f.ticker),
h AS (SELECT *, CASE WHEN instrument_id IS NULL THEN 'missing_stable_instrument_identity' WHEN i0 IS NULL THEN 'missing_authoritative_exit_sessions' WHEN i1 IS NULL THEN 'exit_path_ends_before_resolution' WHEN st IS NULL THEN 'missing_contiguous_exit_status'
  WHEN st = 'trading' AND bar OR st = 'delisted' AND act IS NOT NULL THEN '' WHEN st = 'trading' THEN 'trading_exit_without_valid_bar' WHEN st = 'delisted' THEN 'delisting_without_explicit_resolution' ELSE 'inconsistent_exit_status:' || st END AS blocking_reason FROM g)
SELECT ticker, exit_date, asset_slot, last_active_date, instrument_id, CASE WHEN blocking_reason = '' THEN d END AS liquidation_date, CASE WHEN blocking_reason = '' THEN i1 - i0 END AS lag_sessions,
  CASE WHEN instrument_id IS NULL OR i0 IS NULL THEN 0 WHEN i1 IS NULL THEN (SELECT max(i) FROM n) - i0 + 1 WHEN st IS NULL THEN i1 - i0 ELSE i1 - i0 + 1 END AS observed_sessions, CASE WHEN blocking_reason = '' AND st = 'delisted' THEN act END AS terminal_action_id,
  CASE WHEN blocking_reason <> '' THEN 'unresolved' WHEN st = 'trading' THEN 'tradable_liquidation' ELSE 'terminal_settlement' END AS path_status, blocking_reason = '' AS path_covered, blocking_reason FROM h"""


@query("l16_exit_paths", _L16P)
def exit_paths(spark, d):
    """Each exit from membership to the session that decides it, with its instrument, the sessions looked at and the settling action."""
    t = lambda name: A.portable(spark, d, f"{_EXITS} SELECT * FROM {name}")
    out = exits.membership_exits(t("panel"))
    return exits.exit_paths(out, t("sessions"), t("status"), t("bars"), t("actions"), t("symbols"))


# experiments


@query("g20_guarded_trials", f"WITH {_RET}, s AS (SELECT sector, CAST(year(date) AS INT) AS \"window\", ticker, round(avg(r), 6) + 0.0 AS m FROM ret GROUP BY 1, 2, 3), k AS (SELECT sector, \"window\", count(*) AS trials FROM s GROUP BY 1, 2) SELECT s.sector, s.\"window\", ticker, m, trials, trials = 5 AS complete FROM s JOIN k USING (sector, \"window\") QUALIFY row_number() OVER (PARTITION BY s.sector, s.\"window\" ORDER BY m DESC, ticker) = 1")
def guarded_trials(spark, d):
    """The best validation trial of each algorithm and window, and whether all its trials are there."""
    s = returns_month(spark, d).groupBy("sector", F.year("date").alias("window"), "ticker").agg(r6(F.avg("r")).alias("m")).withColumn("split", F.lit("validation"))
    return E.best_trials(s, ["sector", "window"], "m", "ticker", trials=5).drop("split")


@query("n03_label_scores", "SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0.0 ELSE round((1.0 * (doc_id % 7 + 1) - (doc_id % 3 + 1)) / (doc_id % 7 + doc_id % 3 + 4)::DOUBLE, 6) + 0.0 END::DOUBLE AS score FROM documents")
def label_scores(spark, d):
    """Labels are resolved by their names before scores are weighed; a text that is empty scores 0."""
    p = lambda name, x: F.struct(F.lit(name).alias("label"), x.cast("double").alias("p"))
    x = A.table(spark, d, "documents").select("doc_id", "text", F.array(p("Positive", F.pmod("doc_id", F.lit(7)) + 1), p("NEGATIVE", F.pmod("doc_id", F.lit(3)) + 1), p("neutral", F.lit(2.0))).alias("s"))
    values = N.label_values(["Positive", "NEGATIVE", "neutral"])
    return x.select("doc_id", r6(F.when(F.coalesce("text", F.lit("")) == "", 0.0).otherwise(N.expected_value(F.col("s"), values))).alias("score"))


_N01 = f"""WITH {_TECH}, ff AS (SELECT date, ticker, return_5d, rsi_14, round(lead(close, 21) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1, 6) + 0.0 AS y FROM tech), tt AS (SELECT * FROM ff WHERE date <= DATE '1999-12-31' AND y IS NOT NULL),
ss AS (SELECT count(*)::DOUBLE AS n, avg(return_5d) AS m1, stddev_pop(return_5d) AS s1, avg(rsi_14) AS m2, stddev_pop(rsi_14) AS s2, corr(return_5d, rsi_14) AS c12, avg(y) AS my, covar_pop(return_5d, y) AS c1, covar_pop(rsi_14, y) AS c2 FROM tt),
bb AS (SELECT *, n * c1 / s1 AS g1, n * c2 / s2 AS g2, (n + 1) * (n + 1) - n * c12 * n * c12 AS det FROM ss), kk AS (SELECT *, ((n + 1) * g1 - n * c12 * g2) / det AS b1, ((n + 1) * g2 - n * c12 * g1) / det AS b2 FROM bb)
SELECT date, ticker, round((return_5d - m1) / s1 * b1 + (rsi_14 - m2) / s2 * b2 + my, 6) + 0.0 AS forecast FROM ff, kk"""


@query("n01_ridge_two_features", _N01)
def ridge_two(spark, d):
    """Two features, whose normal equations SQL can solve as well."""
    p = W.technical_features(A.bars_type_week(spark, d)).withColumn("y", r6(W.forward_return("close", 21)))
    f = N.ridge(p.select("date", "ticker", "y", *(r6(F.col(c)).alias(c) for c in ("return_5d", "rsi_14"))), ["return_5d", "rsi_14"], "y", alpha=1.0, until="1999-12-31")
    return f.withColumn("forecast", r6(F.col("forecast")))


@query("n08_trial_mapping", "SELECT CAST(t AS BIGINT) AS trial_id, ['a2c', 'ddpg', 'ppo', 'sac', 'td3'][t % 5 + 1] AS algorithm, CAST(t // 5 AS BIGINT) AS trial FROM range(40) r(t)")
def trial_mapping(spark, d):
    return E.trial_algorithms(spark.range(40).withColumnRenamed("id", "trial_id"), ["a2c", "ddpg", "ppo", "sac", "td3"])


@query("n08_sampled_parameters", None)
def sampled_parameters(spark, d):
    """Seeded draws from the search space of each algorithm, one task a trial."""
    return E.sample_parameters(trial_mapping(spark, d), seed=42)


_STAGES = [("acquire", ""), ("features", "acquire"), ("splits", "acquire"), ("train", "features,splits"), ("evaluate", "train"), ("report", "evaluate,features")]


@query("x01_stage_order", "SELECT * FROM (VALUES ('acquire', 0), ('features', 1), ('splits', 1), ('train', 2), ('evaluate', 3), ('report', 4)) v(stage, level)")
def stage_order(spark, d):
    """Levels of a graph of stages; a cycle is an error."""
    s = spark.createDataFrame(_STAGES, "stage string, needs string")
    return E.stage_levels(s.select("stage", F.explode_outer(F.filter(F.split("needs", ","), lambda x: x != "")).alias("needs")))


@query("x03_manifests", "SELECT c_mktsegment AS experiment, count(*) AS runs, count(*) FILTER (c_custkey % 7 <> 0) AS complete, max(c_custkey) AS last_run FROM customer GROUP BY 1")
def manifests(spark, d):
    """Manifests as JSON texts, gathered by experiment; one that can't be read counts as not complete."""
    c = A.table(spark, d, "customer")
    texts = c.select(F.to_json(F.struct(F.col("c_mktsegment").alias("experiment"), F.col("c_custkey").alias("run"), F.when(F.pmod("c_custkey", F.lit(7)) != 0, "complete").otherwise("failed").alias("status"))).alias("text"))
    return E.manifest_summary(texts)


@query("x04_exact_resume", "SELECT c_custkey, c_custkey % 3 = 0 AND c_custkey % 5 <> 0 AS reusable FROM customer")
def exact_resume(spark, d):
    """A completed trial is used again only if its whole identity is the same and its objective is finite."""
    c = A.table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment")
    n = lambda k: F.pmod("c_custkey", F.lit(k)) == 0
    done = c.where(n(3)).select("c_custkey", "c_name", F.when(n(10), "OTHER").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"), F.when(n(5), float("nan")).otherwise(1.0).alias("objective"))
    return E.reusable(c, done, ["c_custkey", "c_name", "c_mktsegment"], "objective").select("c_custkey", "reusable")


@query("x06_benchmark_choice", "WITH m AS (SELECT l_linenumber AS n, count(*) AS k, round(avg(l_quantity) * 10, 6) AS v FROM lineitem GROUP BY 1) SELECT min(n) AS environments FROM m WHERE v >= 0.95 * (SELECT max(v) FROM m)")
def benchmark_choice(spark, d):
    """The fewest environments whose throughput is within 95 % of the best."""
    m = A.table(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("environments")).agg(F.round(F.avg("l_quantity") * 10, 6).alias("v"))
    return G.nearest_peak(m, "environments", "v", 0.95)


@query("x08_trajectory_digest", f"{_SIM} SELECT policy, count(*) AS steps, sha256(string_agg(CAST(date AS VARCHAR) || ':' || CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR), ',' ORDER BY date)) AS digest, true AS same FROM v GROUP BY 1")
def trajectory_digest(spark, d):
    """The digest of a trajectory made twice, and whether both are the same."""
    w, r = P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d)
    one = lambda n: E.trajectory_digest(P.closed_form(w.repartition(n), r, 0.0015, 0.0005))
    other = one(7).select("policy", F.col("digest").alias("d2"))
    return one(3).join(other, "policy").select("policy", "steps", "digest", (F.col("digest") == F.col("d2")).alias("same"))


QUERIES = Q
