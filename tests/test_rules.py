"""Figures worked out by hand, or by a plain loop, for the rules of costs, metrics, bars, flows, dates, plans and ledgers."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import asof, experiments, grid, inference, metrics, models, portfolio, quality, splits, windows
from quantloom.sources import ingest

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def values(spark, column, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("t"))).collect()]


def test_side_cost_has_fees_and_tax_on_their_sum(spark):
    df = spark.createDataFrame([(1e6,), (5e6,), (5_000_001.0,), (2e7,), (3e7,), (-1.0,)], "v double")
    got = df.select(S.commission_rate(F.col("v")), S.side_cost(F.col("v"))).collect()
    assert [r[0] for r in got] == [0.00157, 0.00157, 0.00137, 0.00117, 0.00107, None]
    assert got[0][1] == pytest.approx(round((0.00157 + 0.00007) * 1.07, 7)) == 0.0017548 and got[5][1] is None


def test_equity_metrics_by_hand(spark):
    v = [100.0, 110.0, 99.0, 99.0, 108.9]
    c = spark.createDataFrame([("p", D(i), x, 0.1 * i, 1.0, 0.5, 0.2) for i, x in enumerate(v)], "policy string, date date, value double, turnover double, cost double, slippage double, cash_weight double")
    m = metrics.equity_metrics(c).first().asDict()
    r = np.array([0.0, 0.1, -0.1, 0.0, 0.1])
    annual = 1.089 ** (252 / 5) - 1
    assert len(m) == 20 and m["downside_deviation"] == pytest.approx(math.sqrt(0.01 / 5) * math.sqrt(252)) and m["total_slippage"] == pytest.approx(2.5) and m["total_cost"] == pytest.approx(5)
    assert m["volatility"] == pytest.approx(r.std() * math.sqrt(252)) and m["sharpe"] == pytest.approx(annual / (r.std() * math.sqrt(252))) and m["sortino"] == pytest.approx(annual / m["downside_deviation"])
    assert m["max_drawdown"] == pytest.approx(-0.1) and m["profit_factor"] == pytest.approx(2.0) and m["win_rate"] == pytest.approx(0.4)
    assert m["var_95"] == pytest.approx(np.quantile(r, 0.05)) and m["cvar_95"] == pytest.approx(-0.1)


def test_benchmark_metrics_by_numpy(spark):
    a, b = np.array([100, 102, 101, 105, 104.0]), np.array([50, 50.5, 51, 50, 52.0])
    c = spark.createDataFrame([("p", D(i), float(x)) for i, x in enumerate(a)], "policy string, date date, value double")
    base = spark.createDataFrame([(D(i), float(x)) for i, x in enumerate(b)], "date date, value double")
    m = metrics.benchmark_metrics(c, base).first()
    r, q = a[1:] / a[:-1] - 1, b[1:] / b[:-1] - 1
    excess = np.prod(1 + r) ** (252 / 4) - np.prod(1 + q) ** (252 / 4)
    error = (r - q).std() * math.sqrt(252)
    assert m.tracking_error == pytest.approx(error) and m.excess_return == pytest.approx(excess) and m.information_ratio == pytest.approx(excess / error)
    assert m.beta == pytest.approx(np.cov(r, q, ddof=0)[0, 1] / q.var()) and m.down_capture == pytest.approx(r[q < 0].mean() / q[q < 0].mean())
    assert metrics.benchmark_metrics(c.limit(2), base).count() == 0


def test_prototype_metrics_by_numpy(spark):
    r = [0.1, -0.2, 0.05, -0.1, None, float("nan")]
    df = spark.createDataFrame([("p", D(i), x) for i, x in enumerate(r)], "policy string, date date, r double")
    m, x = metrics.prototype_metrics(df).first(), np.array(r[:4], float)
    g = np.cumprod(1 + x)
    assert m.total_return == pytest.approx((g[-1] - 1) * 100) and m.sharpe_ratio == pytest.approx(x.mean() / x.std() * math.sqrt(252)) and m.sortino_ratio == pytest.approx(x.mean() / x[x < 0].std() * math.sqrt(252))
    assert m.max_drawdown == pytest.approx((g / np.maximum.accumulate(g) - 1).min() * 100) and m.volatility == pytest.approx(x.std() * math.sqrt(252) * 100)


def test_bars_take_only_open_and_close_into_the_envelope(spark):
    raw = spark.createDataFrame([(D(0), "a", 6.0, 5.0, 10.0, 7.0, "3"), (D(1), "a", 6.0, 8.0, 5.0, 7.0, "3"), (D(2), "a", 6.0, None, 5.0, 7.0, "3")], "date date, ticker string, open double, high double, low double, close double, volume string")
    got = [(r.high, r.low, r.ohlc_repaired) for r in ingest.normal_bars(raw, {}).orderBy("date").collect()]
    assert got == [(7.0, 6.0, True), (8.0, 5.0, False)]


def test_flow_share_is_of_the_market(spark):
    rows = [(D(i), g, b, s) for i in range(6) for g, b, s in (("x", 60.0, 20.0), ("y", 40.0, 80.0)) if not (i == 3 and g == "y")]
    got = {(r.date, r.investor_type): r for r in windows.flow_features(spark.createDataFrame(rows, "date date, investor_type string, buy_value double, sell_value double")).collect()}
    assert got[D(0), "x"].net_share == pytest.approx(0.4) and got[D(0), "y"].net_share == pytest.approx(-0.4)
    assert got[D(3), "y"].net_share is None and got[D(3), "x"].net_share == pytest.approx(40 / 60)
    assert got[D(4), "x"].net_5d == pytest.approx(200 / 460) and got[D(5), "y"].net_5d is None and got[D(5), "x"].net_z60 is None


def test_conservation_is_against_what_was_bought(spark):
    rows = [(D(0), "x", 100.0, 99.0), (D(0), "y", 0.0, 0.0), (D(1), "x", 100.0, 98.5), (D(1), "y", 0.0, 0.0), (D(2), "x", 1.0, 1.0), (D(3), "x", -1.0, 1.0), (D(3), "y", 2.0, 0.0)]
    got = quality.flow_conservation(spark.createDataFrame(rows, "date date, investor_type string, buy_value double, sell_value double"), 2)
    assert [r.passed for r in got.orderBy("date").collect()] == [True, False, False, False]


def test_dates_by_form(spark):
    texts = ["2024-01-15", " 2024/1/5 ", "2024-03-09T10:00", "2024-02-30", "2024-02", "2024/11", "2024", "15/01/2024", "20240115", "2024-1-5 10:00", "", None, "soon", "0000-01-01"]
    got = values(spark, S.parse_date, texts)
    assert got == [dt.date(2024, 1, 15), dt.date(2024, 1, 5), dt.date(2024, 3, 9), dt.date(2024, 2, 1), dt.date(2024, 2, 1), dt.date(2024, 11, 1), dt.date(2024, 1, 1), None, dt.date(2024, 1, 1), dt.date(2024, 1, 1), None, None, None, None]


def test_decisions_votes_and_meeting_days(spark):
    assert values(spark, S.decision_points, ["Hold", " RAISE 25 bps. ", "cut 50 bps", "hold at 2.5", "Raise by 25 bps", None, "lower 25 bps"]) == [0.0, 25.0, -50.0, None, None, None, None]
    assert values(spark, S.vote_count, ["6", "65/", "12", "", None, "7."]) == [6.0, 6.0, None, None, None, 7.0]
    assert values(spark, S.announcement_date, ["28-29 May 2013", "5 Feb 2020", "5-February-2020", "43831", "43831.0", "May 2013", ""]) == [dt.date(2013, 5, 29), dt.date(2020, 2, 5), dt.date(2020, 2, 5), dt.date(2020, 1, 1), dt.date(2020, 1, 1), None, None]


def test_batches_are_pairs_of_folds(spark):
    p = splits.execution_plan(spark, list(range(30)), list(range(1, 7)), [0, 1, 2])
    assert p.count() == 540
    got = {r.batch: (r.a, r.b, r.n, r.t) for r in p.groupBy("batch").agg(F.min("fold").alias("a"), F.max("fold").alias("b"), F.count("*").alias("n"), F.max("task").alias("t")).collect()}
    assert got == {f"array_batch_0{k + 1}": (2 * k + 1, 2 * k + 2, 180, 179) for k in range(3)}


def test_work_units_of_both_kinds(spark):
    df = spark.createDataFrame([("ppo",), ("sac",)], "a string").select("a", S.work_units(F.col("a"), F.lit(1100), 100, 4, 2, 64).alias("u"))
    assert {r.a: r.u for r in df.collect()} == {"ppo": 1100, "sac": 1100 + 250 * 2 * 64}


def test_price_benchmark_opens_with_the_capital(spark):
    s = spark.createDataFrame([(D(i), p) for i, p in enumerate((50.0, 55.0, 60.0))], "date date, p double")
    got = portfolio.price_benchmark(s, "p", 0.0015, 0.0005, 1000.0).orderBy("date").collect()
    assert [r.value for r in got] == pytest.approx([1000.0, 998 * 1.1, 998 * 1.2]) and [r.turnover for r in got] == [0.0, 1.0, 0.0]


def test_return_benchmark_pays_on_the_second_row(spark):
    s = spark.createDataFrame([(D(i), r) for i, r in enumerate((0.5, 0.1, 0.2, float("nan"), -0.1))], "date date, r double")
    got = portfolio.return_benchmark(s, 1, 0.001, 0.0005, 1000.0).orderBy("date").collect()
    v = 1000 * (1 + 0.2 - 0.003)
    assert [r.value for r in got] == pytest.approx([1000.0, v, v, v * 0.9]) and got[-1].drawdown == pytest.approx(0.1) and [r.turnover for r in got] == [0.0, 2.0, 0.0, 0.0]


def test_turnover_cap_counts_cash():
    got = portfolio.limit_turnover(np.array([0.5, 0.0]), np.zeros(2), 0.5)
    assert portfolio.turnover_of(np.array([0.5, 0.0]), np.zeros(2)) == 1.0 and np.allclose(got, [0.25, 0.0])


def test_mean_variance_against_a_loop(spark):
    draw = np.random.default_rng(7)
    r = draw.normal(0.0, 0.02, (30, 3))
    df = spark.createDataFrame([(D(t), f"t{i}", float(r[t, i])) for t in range(30) for i in range(3)], "date date, ticker string, r double").repartition(4)
    got = portfolio.mean_variance(df, window=10).toPandas().pivot(index="date", columns="ticker", values="weight").sort_index().to_numpy()
    for t in range(30):
        past = r[max(1, t - 9) : t + 1]
        if len(past) < 2:
            expected = np.full(3, 1 / 3)
        else:
            raw = np.maximum(np.linalg.pinv(np.cov(past, rowvar=False) + 1e-4 * np.eye(3)) @ past.mean(0), 0)
            expected = raw / raw.sum() if raw.sum() > 0 else np.zeros(3)
        assert np.allclose(got[t], expected)


def test_ledger_step_against_a_loop(spark):
    draw = np.random.default_rng(11)
    cols = "policy string, date date, ticker string, held double, target double, can_buy boolean, can_sell boolean, forced_exit boolean, r double"
    rows, n = [], 5
    for t in range(12):
        held, target = draw.dirichlet(np.ones(n + 1))[:n], draw.dirichlet(np.ones(n + 1))[:n]
        rows += [("p", D(t), str(i), float(held[i]), float(target[i]), *(bool(b) for b in draw.integers(0, 2, 2)), bool(draw.integers(0, 3) == 0), float(draw.normal(0, 0.05))) for i in range(n)]
    df = spark.createDataFrame(rows, cols).repartition(3)
    step = portfolio.ledger_step(df, 0.0015, 0.0005, 0.3)
    got, totals = {(r.date, r.ticker): r for r in step.collect()}, {r.date: r for r in portfolio.ledger_totals(step, 0.0015, 0.0005, 0.3).collect()}
    for t in range(12):
        part = [x for x in rows if x[1] == D(t)]
        held, target = np.array([x[3] for x in part]), np.array([x[4] for x in part])
        buy, sell, force, r = (np.array([x[k] for x in part]) for k in (5, 6, 7, 8))
        want = np.where((~buy & (target > held)) | (~sell & (target < held)), held, target)
        want = np.where(force & ~sell, held, np.where(force & sell, 0.0, want))
        base = np.where(force & sell, 0.0, held)
        free, room = np.abs(want - base).sum(), max(0.3 - (held - base).sum(), 0.0)
        moved = base + (want - base) * (room / free if free > room + 1e-12 else 1.0) - held
        sold, bought = np.minimum(moved, 0), np.maximum(moved, 0)
        cash = 1 - (held + sold).sum() + 0.002 * sold.sum()
        done = held + sold + bought * (cash / (bought.sum() * 1.002) if bought.sum() * 1.002 > cash + 1e-12 else 1.0)
        turnover = np.abs(done - held).sum()
        wealth = (done * (1 + r)).sum() + 1 - done.sum() - 0.002 * turnover
        assert np.allclose([got[D(t), str(i)].executed for i in range(n)], done) and np.allclose([got[D(t), str(i)].ending_weight for i in range(n)], done * (1 + r) / wealth)
        assert totals[D(t)].net_return == pytest.approx(wealth - 1) and totals[D(t)].turnover == pytest.approx(turnover) and totals[D(t)].reconciles
        assert totals[D(t)].limit_overridden == ((held - base).sum() > 0.3 + 1e-12)


def test_positions_over_many_ranges(spark):
    draw = np.random.default_rng(1)
    x = [(int(a), int(b)) for a, b in zip(draw.integers(0, 4, 3000), draw.permutation(3000), strict=True)]
    df = spark.createDataFrame(x, "a int, b int").repartition(5)
    got = {(r.a, r.b): r.place for r in grid.positions(df, [F.col("a"), -F.col("b")], ranges=9).collect()}
    assert got == {v: k for k, v in enumerate(sorted(x, key=lambda v: (v[0], -v[1])), 1)}


@pytest.mark.parametrize("kind", ["spread", "ties", "one"])
def test_group_percentiles_against_numpy(spark, kind):
    draw = np.random.default_rng(2)
    v = {"spread": draw.normal(size=900), "ties": draw.integers(0, 3, 900).astype(float), "one": np.full(900, 7.0)}[kind]
    rows = [("ab"[i % 2] if i % 5 else None, float(x)) for i, x in enumerate(v)] + [("c", None), ("d", 4.0)]
    got = {r.g: (r.lo, r.mid) for r in grid.group_percentiles(spark.createDataFrame(rows, "g string, x double").repartition(4), ["g"], "x", {"lo": 0.05, "mid": 0.5}).collect()}
    by: dict = {}
    for g, x in rows:
        if x is not None:
            by.setdefault(g, []).append(x)
    assert got.keys() == by.keys()
    for g, x in by.items():
        assert got[g] == pytest.approx(tuple(np.quantile(x, [0.05, 0.5])))


def test_exit_paths(spark):
    rows, states = [], {"sold": ["halted", "trading"], "settled": ["delisted"], "gap": ["suspended", None, "trading"], "no_bar": ["trading"], "ends": ["halted"], "odd": ["not_yet_listed"], "no_action": ["delisted"]}
    for t, path in states.items():
        rows += [(D(0), t, True, "trading", True, None)] + [(D(1 + i), t, False, s, t != "no_bar", "a" if t == "settled" else None) for i, s in enumerate(path)]
    got = {r.ticker: (r.path_status, r.lag_sessions, r.blocking_reason) for r in experiments.exit_ledger(spark.createDataFrame(rows, "date date, ticker string, member boolean, status string, valid_bar boolean, terminal_action string")).collect()}
    assert got == {
        "sold": ("tradable_liquidation", 1, ""), "settled": ("terminal_settlement", 0, ""), "gap": ("unresolved", None, "missing_contiguous_exit_status"), "no_bar": ("unresolved", None, "trading_exit_without_valid_bar"),
        "ends": ("unresolved", None, "exit_path_ends_before_resolution"), "odd": ("unresolved", None, "inconsistent_exit_status:not_yet_listed"), "no_action": ("unresolved", None, "delisting_without_explicit_resolution"),
    }


def test_ranking_falls_back(spark):
    cols = "c string, primary_score double, worst_fold_score double, median_excess_max_drawdown double, median_turnover double, timestep_budget int"
    df = spark.createDataFrame([("b", 0.1, 0.0, 0.0, 1.0, 10), ("a", 0.1, 0.0, 0.0, 1.0, 10), ("c", 0.1, 0.0, 0.0, 0.5, 10), ("d", 0.2, -1.0, -1.0, 9.0, 99)], cols)
    r = grid.ranked_candidates(df, "c")
    assert [x.c for x in r.orderBy("rank").collect()] == ["d", "c", "a", "b"]
    assert {x.selected for x in grid.selected(r, "c", "none").collect()} == {"d"}
    assert {x.selected for x in grid.selected(grid.ranked_candidates(df.withColumn("primary_score", F.lit(0.0)), "c"), "c", "none").collect()} == {"none"}


def test_differential_ratios_against_a_loop(spark):
    r = [0.01, -0.02, 0.03, -0.01, 0.2]
    got = models.differential_ratios(spark.createDataFrame([("p", D(i), x) for i, x in enumerate(r)], "policy string, date date, r double"), 0.1, 5.0).orderBy("date").collect()
    a = b = d = 0.0
    for x, row in zip(r, got, strict=True):
        v = b - a * a
        s = 0.0 if v <= 1e-12 else (b * (x - a) - 0.5 * a * (x * x - b)) / v**1.5
        q = 0.0 if d <= 1e-12 else (x - 0.5 * a) / math.sqrt(d) if x > 0 else (d * (x - 0.5 * a) - 0.5 * a * x * x) / d**1.5
        assert row.sharpe_term == pytest.approx(max(-5, min(5, s))) and row.downside_term == pytest.approx(max(-5, min(5, q)))
        a, b, d = a + 0.1 * (x - a), b + 0.1 * (x * x - b), d + 0.1 * (min(x, 0) ** 2 - d)


def test_summaries_with_inference(spark):
    rows = [(g, D(i), (0.5 if g == "up" else 0.0) + math.sin(i)) for g in ("up", "flat") for i in range(60)]
    df = spark.createDataFrame(rows, "policy string, date date, excess double").repartition(3)
    got = {r.policy: r for r in inference.paired_summary(df, ["policy"], "excess", ["date"]).collect()}
    x = np.array([v for g, _, v in rows if g == "up"])
    assert got["up"].mean == pytest.approx(x.mean()) and got["up"].std == pytest.approx(x.std(ddof=1)) and got["up"].low < x.mean() < got["up"].high and got["up"].positive_rate == pytest.approx((x > 0).mean())
    assert got["up"].p < 0.01 < got["flat"].p and got["up"].holm == pytest.approx(min(1, 2 * got["up"].p)) and got["flat"].holm == pytest.approx(got["flat"].p)
    again = {r.policy: r for r in inference.paired_summary(df.repartition(5), ["policy"], "excess", ["date"]).collect()}
    assert again == got


def test_significance_of_seed_means(spark):
    draw = np.random.default_rng(0)
    rows = [(f"{v}_seed{s}", D(i), 100 * math.exp(0.001 * i * (v == "a") + 0.01 * draw.normal())) for v in "ab" for s in range(3) for i in range(80)]
    means = metrics.seed_means(spark.createDataFrame(rows, "policy string, date date, value double"))
    assert means.count() == 160
    got = {r.policy: r for r in inference.significance_table(means.withColumnRenamed("variant", "policy"), reference="b", trials=5, resamples=50).collect()}
    assert got["a"].deflated < got["a"].probabilistic and got["a"].difference_low <= got["a"].difference_high and got["b"].p is None


def test_synthetic_panel_laws(spark):
    """Sound bars on business days, the same whatever the partitions and the other names, and another panel for another seed."""
    names = lambda *x: spark.createDataFrame([(t,) for t in x], "ticker string")
    make = lambda df, seed=42: ingest.synthetic_panel(df, "2024-01-01", "2024-03-31", seed).orderBy("ticker", "date").toPandas()
    a = make(names("x", "y", "z", "x", None))
    assert len(a) == 3 * 65 and set(a.ticker) == {"x", "y", "z"} and (a.groupby("date").size() == 3).all() and all(d.weekday() < 5 for d in a.date)
    assert (a.high >= a[["open", "close"]].max(axis=1)).all() and (a.low <= a[["open", "close"]].min(axis=1)).all() and (a.low > 0).all() and (a.volume > 0).all()
    assert a.groupby("date").market_return_1d.nunique().max() == 1 and a.sentiment_score.abs().max() <= 1
    assert (a.groupby(["ticker", a.date.map(lambda d: d.month)]).macro_rate_change.agg(lambda r: (r != 0).sum()) <= 1).all()
    assert make(names("z", "y", "x").repartition(3)).equals(a) and make(names("y")).equals(a[a.ticker == "y"].reset_index(drop=True))
    assert not make(names("x", "y", "z"), 43).close.equals(a.close) and a[a.ticker == "x"].close.nunique() > 60
    returns = a.pivot(index="date", columns="ticker", values="close").pct_change().dropna()
    assert returns.corr().to_numpy()[0, 1] < 0.99


def test_canonical_sectors_and_normal_back_and_forth(spark):
    sector = S.canonical_sector(["Food & Beverage", "Banking"])
    assert values(spark, sector, ["ＦＯＯＤ and  beverage", "food&BEVERAGE", "banking ", "bank", None]) == ["Food & Beverage", "Food & Beverage", "Banking", None, None]
    df = spark.createDataFrame([(x,) for x in (-2.0, 0.0, 1.5)], "z double").withColumn("p", S.normal_cdf()("z"))
    assert [r[0] for r in df.select(S.normal_quantile()("p")).collect()] == pytest.approx([-2.0, 0.0, 1.5])
    assert [r[0] for r in spark.createDataFrame([(0.0,), (1.0,), (None,)], "p double").select(S.normal_quantile()("p")).collect()] == [None, None, None]


def test_labels_are_resolved_or_refused():
    assert models.label_values(["POS", "neg", "LABEL_2"]) == {"POS": 1.0, "neg": -1.0, "LABEL_2": 0.0}
    assert models.label_values(["a", "b"], {"a": 2.0}) == {"a": 2.0, "b": 0.0}
    for labels, given in ((["LABEL_0", "LABEL_1"], None), (["a"], {"b": 1.0})):
        with pytest.raises(ValueError):
            models.label_values(labels, given)


def test_best_trials_refuse_test_scores(spark):
    s = spark.createDataFrame([("a", 1, "x", 0.5, "validation"), ("a", 1, "y", 0.5, "validation"), ("a", 1, "z", 0.1, "validation")], "algo string, w int, t string, m double, split string")
    got = experiments.best_trials(s, ["algo", "w"], "m", "t", 3).first()
    assert (got.t, got.m, got.trials, got.complete) == ("x", 0.5, 3, True)
    with pytest.raises(Exception, match="not a validation score"):
        experiments.best_trials(s.withColumn("split", F.lit("test")), ["algo", "w"], "m", "t", 3).collect()


def test_stage_levels_refuse_a_cycle(spark):
    with pytest.raises(ValueError, match="a cycle"):
        experiments.stage_levels(spark.createDataFrame([("a", "b"), ("b", "a"), ("c", None)], "stage string, needs string"))


def test_sampled_parameters_can_be_made_alone(spark):
    t = experiments.trial_algorithms(spark.range(20).withColumnRenamed("id", "trial_id"), ["ppo", "sac"])
    full = {r.trial_id: r.params for r in experiments.sample_parameters(t.repartition(3), 1).collect()}
    assert {r.trial_id: r.params for r in experiments.sample_parameters(t.where("trial_id = 7"), 1).collect()} == {7: full[7]}
    assert all(int(p["batch_size"]) <= int(p["n_steps"]) for k, p in full.items() if k % 2 == 0) and "tau" in full[1]


def test_ema_follows_pandas_with_nulls(spark):
    v = [None, 1.0, None, None, 3.0, 2.0, None, 5.0]
    df = spark.createDataFrame([(D(i), "a", x) for i, x in enumerate(v)], "date date, ticker string, close double")
    got = [r[0] for r in windows.with_ema(df, (3,)).orderBy("date").select("ema_3").collect()]
    expected = pd.Series(v, dtype=float).ewm(span=3, adjust=False).mean()
    assert [None if pd.isna(x) else round(x, 12) for x in expected] == [None if x is None else round(x, 12) for x in got]


def test_one_row_a_date_before_dates_meet(spark):
    dates = spark.createDataFrame([(D(5),), (D(9),)], "date date")
    facts = spark.createDataFrame([(D(1), 1.0), (D(5), 2.0), (D(5), 3.0), (None, 9.0)], "f date, v double")
    assert {r.date: r.v for r in asof.dates_asof(dates, facts, "date", "f", ["v"]).collect()} == {D(5): 3.0, D(9): 3.0}
    assert {r.date: r.v for r in asof.dates_asof(dates, facts, "date", "f", ["v"], strict=True).collect()} == {D(5): 1.0, D(9): 3.0}


def test_leakage_order_over_ranges(spark):
    rows = [(i, D(i // 2), "fine") for i in range(200)] + [(1000 + i, D(i), "late") for i in range(100)] + [(1100, D(0), "late"), (1101, None, "late")]
    df = spark.createDataFrame(rows, "id long, date date, ticker string").withColumn("x_release_date", F.col("date"))
    got = {r.check: r.failures for r in quality.leakage_report(df, "id").collect()}
    assert got["monotonic"] == 1 and got["valid_dates"] == 1 and got["unique_keys"] == 101 and got["x_release_date_valid"] == 1 and got["x_release_date_not_future"] == 0
