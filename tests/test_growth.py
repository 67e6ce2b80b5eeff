"""Trees that grow, memberships of any size, suites against a loop, and contracts on planted tables."""

from __future__ import annotations

import datetime as dt
import hashlib
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quantloom.operators import contracts, experiments, grid, portfolio
from quantloom.streaming import manifest

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)


def checks(df):
    return {r.check: r.failures for r in df.collect()}


def test_second_run_reads_new_files_only(spark, tmp_path):
    tree, at, state = f"{tmp_path}/tree", f"{tmp_path}/manifest", f"{tmp_path}/state"
    write = lambda name, *x: spark.createDataFrame([(v,) for v in x], "x int").coalesce(1).write.csv(f"{tree}/{name}", header=True)
    seen = []
    source, summary = F.regexp_extract("source_path", "tree/([^/]*)/", 1), [F.count("*").alias("rows"), F.sum("x").alias("total"), F.count_distinct("source_path").alias("files")]
    run = lambda: {r.source: (r.rows, r.total, r.files, r.batch) for r in manifest.scan_new(spark, tree, "x int", at, state, source, summary, header="true").collect()}
    write("a/1", 1, 2)
    write("b/1", 5)
    assert run() == {"a": (2, 3, 1, 0), "b": (1, 5, 1, 0)}
    assert run() == {"a": (2, 3, 1, 0), "b": (1, 5, 1, 0)} and manifest.versions(spark, at) == [0]
    write("b/2", 7, 8)
    write("c/1", 9)
    # the new files alone: b's earlier file is not read again
    assert run() == {"a": (2, 3, 1, 0), "b": (2, 15, 1, 1), "c": (1, 9, 1, 1)}
    # a batch that is taken again writes the same rows once
    before = sorted(map(tuple, manifest.read_manifest(spark, at).collect()))
    rows = spark.createDataFrame([("b", 7), ("b", 8), ("c", 9)], "s string, x int").withColumn("source_path", F.lit("f"))
    for _ in range(2):
        manifest.write_batch(rows, 1, at, F.col("s"), summary)
    assert sorted(map(tuple, manifest.read_manifest(spark, at).collect())) == before and seen == []
    # a version without its mark was not written whole
    (tmp_path / "manifest" / "version=000000000001" / "_SUCCESS").unlink()
    assert {r.source for r in manifest.read_manifest(spark, at).collect()} == {"a", "b"}


def test_changes_of_memberships(spark):
    draw = random.Random(2)
    records = [set(draw.sample(range(50), draw.randrange(0, 40))) for _ in range(12)]
    rows = [(D(30 * k), f"k{x:02d}") for k, r in enumerate(records) for x in r] + [(D(0), None), (D(330), "k01"), (D(330), "k01")]
    records[11].add(1)
    records = [r for r in records]
    got = {r.date: (r.added, r.removed) for r in grid.membership_changes(spark.createDataFrame(rows, "date date, key string").repartition(3), "date", "key").collect()}
    last: set = set()
    there = [(k, r) for k, r in enumerate(records) if r or k == 0]
    for k, r in there:
        name = lambda s: ",".join(f"k{x:02d}" for x in sorted(s))
        assert got[D(30 * k)] == (name(r - last), name(last - r))
        last = r
    assert len(got) == len(there)


def test_a_record_of_many_keys_is_never_a_list(spark):
    df = spark.range(200_000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("at"), F.col("id").alias("key")).where("not (at = 2 and key < 10)").unionByName(spark.range(3).select(F.lit(2).alias("at"), (F.col("id") + 1_000_000).alias("key")))
    got = grid.membership_counts(df, "at", "key")
    assert sorted(map(tuple, got.collect())) == [(1, 200_000, 200_000, 0), (2, 199_993, 3, 10)]
    assert "collect_" not in got._jdf.queryExecution().toString()


def loop(weights, returns, cost, slippage):
    """Values of one policy, step by step."""
    held, cash, value, out = {}, 1.0, 100_000.0, []
    for day in sorted({d for d, _, _ in weights}):
        target = {t: w for d, t, w in weights if d == day}
        left = 1 - sum(target.values())
        turnover = sum(abs(w - held.get(t, 0.0)) for t, w in target.items()) + abs(left - cash)
        value *= 1 + sum(w * returns.get((day, t), 0.0) for t, w in target.items()) - turnover * (cost + slippage)
        out.append((value, turnover))
        held, cash = target, left
    return out


def test_suite_follows_the_loop(spark):
    draw = np.random.default_rng(5)
    tickers, days = ["a", "b", "c"], 45
    close = 50 * np.exp(np.cumsum(draw.normal(0, 0.02, (days, 3)), 0))
    r = np.vstack([np.zeros((1, 3)), close[1:] / close[:-1] - 1])
    r5 = np.vstack([np.zeros((5, 3)), close[5:] / close[:-5] - 1])
    rows = [(D(t), n, float(close[t, i]), float(r[t, i]), float(r5[t, i])) for t in range(days) for i, n in enumerate(tickers)]
    panel = spark.createDataFrame(rows, "date date, ticker string, close double, return_1d double, return_5d double").repartition(4)
    w = experiments.baselines(panel, seed=3)
    every = {}
    for x in w.collect():
        every.setdefault(x.policy, []).append((x.date, x.ticker, x.weight))
    assert set(every) == {"equal_weight", "random", "momentum", "ma_crossover", "mean_variance", "buy_hold_a", "buy_hold_b", "buy_hold_c"}
    by_day = lambda p, t: [x for _, x in sorted((n, x) for d, n, x in every[p] if d == D(t))]
    for t in range(days):
        on = close[max(0, t - 9) : t + 1].mean(0) > close[max(0, t - 29) : t + 1].mean(0)
        assert by_day("ma_crossover", t) == pytest.approx((on / max(on.sum(), 1)).tolist())
        s = np.maximum(r5[t - 1] if t else 0 * r5[0], 0)
        assert by_day("momentum", t) == pytest.approx((s / s.sum() if s.sum() else s).tolist())
        u = np.random.default_rng([3, D(t).toordinal()]).random(3)
        assert by_day("random", t) == pytest.approx((u / max(u.sum(), 1)).tolist())
        assert by_day("buy_hold_b", t) == [1.0] and by_day("equal_weight", t) == pytest.approx([1 / 3] * 3)
    nxt = {(D(t), n): float(r[t, i]) for t in range(days) for i, n in enumerate(tickers)}
    returns = spark.createDataFrame([(d, n, x) for (d, n), x in nxt.items()], "date date, ticker string, r double")
    got = {}
    for x in portfolio.closed_form(w, returns, 0.0015, 0.0005).orderBy("policy", "date").collect():
        got.setdefault(x.policy, []).append((x.value, x.turnover))
    for p, own in every.items():
        for a, b in zip(got[p], loop(own, nxt, 0.0015, 0.0005), strict=True):
            assert a == pytest.approx(b, rel=1e-9)


PANEL = "date date, ticker string, asset_slot int, is_member string, published_at date, revision_status string, mask_kind string, rule string, index_name string, record_id string, sector string, symbol string"


def test_slots_and_expected_grids(spark):
    def panel(*days):
        return spark.createDataFrame([(D(k), t, s, "true", D(k), "original", "m", "r", "i", f"r{k}", "s", "y") for k, names in enumerate(days) for s, t in enumerate(names)], PANEL)

    dates, slots = spark.createDataFrame([(D(0),), (D(1),)], "date date"), spark.createDataFrame([(0, "A"), (1, "B")], "asset_slot int, ticker string")
    fine = checks(contracts.membership_panel(panel("AB", "AB"), "m", "r", 2, dates, slots))
    assert set(fine.values()) == {0} and {"one_ticker_a_slot", "date_missing", "slot_foreign"} <= set(fine)
    swapped = checks(contracts.membership_panel(panel("AB", "BA"), "m", "r", 2, dates, slots))
    assert (swapped["one_ticker_a_slot"], swapped["one_slot_a_ticker"], swapped["slot_foreign"], swapped["stable_slots"]) == (2, 2, 2, 0)
    other = checks(contracts.membership_panel(panel("AB", "AB", "AB"), "m", "r", 2, spark.createDataFrame([(D(0),), (D(9),)], "date date"), slots))
    assert (other["date_missing"], other["date_foreign"]) == (1, 2)


def test_bound_results_find_a_changed_row(spark):
    rows = [("1", "c1", 7, k, D(k), 0.1 + k / 7) for k in range(6)]
    columns = ["schema_version", "candidate_id", "seed", "transition_index", "decision_date", "net_return"]
    df = spark.createDataFrame(rows, "schema_version string, candidate_id string, seed int, transition_index int, decision_date date, net_return double")
    sealed = contracts.seal(df, columns)
    for r in sealed.collect():
        text = json.dumps({c: str(r[c]) if c == "decision_date" else r[c] for c in columns}, sort_keys=True, separators=(",", ":"), ensure_ascii=True)
        assert r.result_row_sha256 == hashlib.sha256(text.encode()).hexdigest()
    binding = {"candidate_id": "c1", "seed": 7}
    assert set(checks(contracts.bound_results(sealed, binding, "1", columns)).values()) == {0}
    k = F.col("transition_index")
    changed = sealed.withColumns({"net_return": F.when(k == 2, F.col("net_return") + 2.0**-50).otherwise(F.col("net_return")), "seed": F.when(k == 3, 8).otherwise(F.col("seed")), "result_row_sha256": F.when(k != 5, F.col("result_row_sha256"))})
    got = checks(contracts.bound_results(changed, binding, "2", columns))
    assert got == {"foreign_candidate_id": 0, "foreign_seed": 1, "schema_version": 6, "row_digest": 3}
