"""Exact values, look-ahead and accounting laws of the panel operators on small frames."""

from __future__ import annotations

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quantloom.functions import scalars as S
from quantloom.operators import asof, grid, inference, metrics, models, portfolio, quality, splits, windows
from quantloom.sources import ingest
from quantloom.streaming import bars

D = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)


def panel(spark, closes, ticker="a"):
    rows = [(D(i), ticker, c, c, c, c, 100) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "date date, ticker string, open double, high double, low double, close double, volume long")


def column(df, name, order="date"):
    return [r[0] for r in df.orderBy(order).select(name).collect()]


def test_returns_pad_nulls_and_zero_denominators(spark):
    out = windows.with_returns(panel(spark, [1.0, None, 2.0, 0.0, 5.0]), (1,))
    assert column(out, "return_1d") == [0.0, 0.0, 1.0, -1.0, 0.0]


def test_rising_series(spark):
    out = windows.technical_features(panel(spark, [float(i) for i in range(1, 31)]))
    assert column(out, "rsi_14") == [0.5] * 30
    assert column(out, "volatility_20d")[0] == 0.0


def test_constant_prices_have_no_bollinger(spark):
    assert set(column(windows.technical_features(panel(spark, [3.0] * 25)), "bollinger_z")) == {0.0}


def test_ema_of_null(spark):
    assert column(windows.with_ema(panel(spark, [1.0, None, 3.0]).select("date", "ticker", "close"), (3,)), "ema_3")[-1] == pytest.approx(2.333333, abs=1e-5)


def test_future_does_not_change_the_past(spark):
    a, b = [float(10 + (i * 7) % 5) for i in range(40)], [float(10 + (i * 7) % 5) for i in range(39)] + [999.0]
    names = ["return_5d", "volatility_20d", "rsi_14", "bollinger_z", "atr_14", "volume_ratio_20"]
    x, y = (windows.technical_features(panel(spark, v)).where(F.col("date") < D(39)).select("date", *names).orderBy("date").collect() for v in (a, b))
    assert x == y


def test_asof_ties_strictness_and_age(spark):
    left = spark.createDataFrame([("k", D(0)), ("k", D(3)), ("k", D(10)), ("k", D(11)), ("z", D(3))], "k string, date date")
    right = spark.createDataFrame([("k", D(3), 1.0), ("k", D(3), 2.0), (None, D(0), 9.0)], "k string, at date, v double")
    get = lambda **o: {(r.k, r.date): r.v for r in asof.asof_join(left, right, ["k"], "date", "at", ["v"], **o).collect()}
    assert get() == {("k", D(0)): None, ("k", D(3)): 2.0, ("k", D(10)): 2.0, ("k", D(11)): 2.0, ("z", D(3)): None}
    assert get(strict=True)[("k", D(3))] is None
    assert get(max_days=7) | {} == {("k", D(0)): None, ("k", D(3)): 2.0, ("k", D(10)): 2.0, ("k", D(11)): None, ("z", D(3)): None}


def test_asof_matches_pandas(spark):
    draw = np.random.default_rng(5)
    left = pd.DataFrame({"k": draw.integers(0, 3, 120).astype(str), "date": [D(int(i)) for i in draw.integers(0, 60, 120)]}).drop_duplicates()
    right = pd.DataFrame({"k": draw.integers(0, 3, 25).astype(str), "at": [D(int(i)) for i in draw.integers(0, 60, 25)], "v": range(25)})
    got = {(r.k, r.date): r.v for r in asof.asof_join(spark.createDataFrame(left), spark.createDataFrame(right), ["k"], "date", "at", ["v"], max_days=3).collect()}
    l, r = left.assign(date=pd.to_datetime(left.date)).sort_values("date"), right.assign(at=pd.to_datetime(right["at"])).sort_values(["at", "v"], kind="stable")
    expected = pd.merge_asof(l, r, left_on="date", right_on="at", by="k", tolerance=pd.Timedelta(days=3))
    assert got == {(x.k, x.date.date()): (None if pd.isna(x.v) else int(x.v)) for x in expected.itertuples()}


def test_revision_waits_a_session(spark):
    sessions = spark.createDataFrame([(D(10),), (D(11),)], "date date")
    records = spark.createDataFrame([(D(0), D(99), D(5), False, "old", "t"), (D(1), D(99), D(10), True, "new", "t")], "effective_from date, effective_to date, published_at date, revised boolean, record_id string, ticker string")
    assert {r.date: r.record_id for r in asof.latest_eligible(sessions, records, ["ticker"]).collect()} == {D(10): "old", D(11): "new"}


def test_sessions_after(spark):
    sessions = asof.calendar(spark.createDataFrame([(D(1),), (D(3),), (D(4),)], "date date"))
    facts = spark.createDataFrame([(D(0),), (D(1),), (D(4),)], "f date")
    assert {r.f: r.available_at for r in asof.sessions_after(facts, sessions, "f").collect()} == {D(0): D(1), D(1): D(3), D(4): None}


def test_many_to_one_rejects_repeats(spark):
    left, right = spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(Exception, match="repeated key"):
        asof.many_to_one(left, right, ["k"]).collect()


def test_first_values_are_by_column(spark):
    df = spark.createDataFrame([("g", 1, None, "x"), ("g", 2, 5, "y")], "g string, o int, a int, b string")
    assert grid.first_values(df, ["g"], F.col("o"), ["a", "b"]).collect()[0][1:] == (5, "x")


def test_closed_form_equals_a_loop(spark):
    draw = np.random.default_rng(1)
    w, r = draw.dirichlet(np.ones(4), 30)[:, :3], draw.normal(0, 0.02, (30, 3))
    rows = [("p", D(t), str(i), float(w[t, i]), float(r[t, i])) for t in range(30) for i in range(3)]
    df = spark.createDataFrame(rows, "policy string, date date, ticker string, weight double, r double")
    got = portfolio.closed_form(df.drop("r"), df.drop("weight", "policy"), 0.0015, 0.0005).orderBy("date").toPandas()
    value, held, cash, values = 100_000.0, np.zeros(3), 1.0, []
    for t in range(30):
        turnover = np.abs(w[t] - held).sum() + abs((1 - w[t].sum()) - cash)
        held, cash = w[t], 1 - w[t].sum()
        value *= 1 + w[t] @ r[t] - turnover * 0.002
        values.append(value)
    assert np.allclose(got["value"], values, rtol=1e-12)


def test_turnover_cap_holds(spark):
    rows = [("p", D(t), str(i), float(t % 3 == i), 0.0) for t in range(9) for i in range(3)]
    df = spark.createDataFrame(rows, "policy string, date date, ticker string, weight double, r double")
    got = portfolio.simulate(df.drop("r"), df.drop("weight", "policy"), 0.001, cap=0.3).toPandas()
    assert got.turnover.max() <= 0.3 + 1e-12 and got.value.is_monotonic_decreasing


def test_execution_pays_from_cash(spark):
    cols = "policy string, date date, ticker string, held double, target double, can_buy boolean, can_sell boolean, forced_exit boolean"
    rows = [("p", D(0), "out", 0.5, 0.5, True, True, True), ("p", D(0), "stuck", 0.3, 0.0, True, False, False), ("p", D(0), "in", 0.2, 0.9, True, True, False)]
    got = {r.ticker: r for r in portfolio.execute(spark.createDataFrame(rows, cols), 0.01, 5.0).collect()}
    assert got["out"].after == 0 and got["stuck"].trade == 0
    assert sum(r.after + r.paid for r in got.values()) <= 1 + 1e-12


def test_holm_against_a_loop(spark):
    p = [0.04, 0.01, None, 0.03, 0.5]
    got = {r.i: r.holm for r in metrics.holm(spark.createDataFrame(list(enumerate(p)), "i int, p double"), order=["i"]).collect()}
    order, best, expected = sorted((x, i) for i, x in enumerate(p) if x is not None), 0.0, {2: None}
    for k, (x, i) in enumerate(order):
        best = max(best, min(1.0, (4 - k) * x))
        expected[i] = best
    assert {i: None if v is None else round(v, 12) for i, v in got.items()} == {i: None if v is None else round(v, 12) for i, v in expected.items()}


def test_beta_of_itself(spark):
    c = spark.createDataFrame([("p", D(i), float(v), 0.0, 0.0, 0.0) for i, v in enumerate([100, 101, 99, 104, 103])], "policy string, date date, value double, turnover double, cost double, cash_weight double")
    m = metrics.benchmark_metrics(c, c.drop("policy")).first()
    assert m.beta == pytest.approx(1) and m.tracking_error == pytest.approx(0) and m.correlation == pytest.approx(1)


def test_bootstrap_is_seeded(spark):
    r = spark.createDataFrame([("p", D(i), float(np.sin(i)) / 100) for i in range(60)], "policy string, date date, r double")
    a, b = (inference.bootstrap_sharpe(r, "policy", "date", "r", resamples=50).first() for _ in range(2))
    assert a == b and a.low <= a.sharpe <= a.high


def test_sign_flip_bounds(spark):
    r = spark.createDataFrame([("up", 0.01 + i / 1e5) for i in range(20)] + [("mixed", (-1.0) ** i) for i in range(20)], "g string, x double")
    got = {x.g: x.p for x in inference.sign_flip(r, "g", "x").collect()}
    assert got["up"] < 0.01 and got["mixed"] > 0.5


def test_splits_cover_all_dates(spark):
    out = splits.chronological(panel(spark, [1.0] * 10))
    assert {r.split: r["count"] for r in out.groupBy("split").count().collect()} == {"train": 6, "validation": 2, "test": 2}
    assert {r.split for r in splits.chronological(panel(spark, [1.0] * 3)).collect()} == {"train", "validation", "test"}


def test_scaler_of_a_constant(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    state = splits.scaler(df, ["a", "b"], F.lit(True))
    assert [tuple(r) for r in splits.scaled(df, state, ["a", "b"]).orderBy("a").collect()] == [(-1.0, 0.0), (1.0, 0.0)]


def test_checks_fail_closed(spark):
    checks = quality.check_rows(spark.createDataFrame([(1,), (None,)], "x int"), {"positive": F.col("x") > 0})
    with pytest.raises(ValueError, match="positive: 1"):
        quality.assert_checks(checks)
    with pytest.raises(ValueError, match="missing columns: y"):
        quality.require_columns(checks, ["y"])


def test_code_points(spark):
    df = spark.createDataFrame([("aé😀",), ("",), (None,)], "t string")
    total = sum(map(ord, "aé😀"))
    assert [r[0] for r in df.select(S.codepoint_sentiment(F.col("t"))).collect()] == [(total % 200 - 100) / 100, -1.0, -1.0]


def test_ridge_and_pca_match_numpy(spark):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(50, 2))
    y = x @ [1.0, -2.0] + 3
    df = spark.createDataFrame([(D(i), "t", float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y, strict=True))], "date date, ticker string, a double, b double, y double")
    got = models.ridge(df, ["a", "b"], "y", 1.0, "2030-01-01").orderBy("date").toPandas().forecast
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    assert np.allclose(got, z @ beta + y.mean())
    v = spark.createDataFrame([(i, [float(k) for k in row]) for i, row in enumerate(draw.normal(size=(40, 3)))], "i int, v array<float>")
    pcs = models.pca_scores(v, "i", "v", 2, F.lit(True)).toPandas()
    assert abs(pcs.pc_1.mean()) < 1e-6 and pcs.pc_1.var() >= pcs.pc_2.var()


def test_ingest_round_trip(spark, tmp_path):
    df = panel(spark, [1.0, 2.0])
    ingest.save_table(df, f"{tmp_path}/a/x.csv")
    assert ingest.load_table(spark, f"{tmp_path}/none", f"{tmp_path}/a/x.csv").count() == 2
    tree = ingest.result_tree(spark, str(tmp_path), "part-*.csv")
    assert tree.count() == 2 and tree.where(F.col("source_path").contains("/a/x.csv/")).count() == 2


def test_streaming_bars_equal_the_batch(spark, tmp_path):
    rows = [(i, dt.datetime(2024, 1, 1, i // 6, i % 6 * 10), "e", float(i % 5)) for i in range(36)]
    ticks = spark.createDataFrame(rows, "event_id long, ts timestamp, event_type string, value double")
    ticks.write.parquet(f"{tmp_path}/in")
    stream = bars.tick_bars(bars.read_ticks(spark, f"{tmp_path}/in", ticks.schema))
    q = stream.writeStream.format("memory").queryName("hourly").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    order = ["bar_start"]
    assert spark.table("hourly").orderBy(order).collect() == bars.tick_bars(ticks).orderBy(order).collect()
