"""Exit paths by instrument against a plain loop over sessions."""

from __future__ import annotations

import datetime as dt
import random

import pytest

from quantloom.operators import exits

D = lambda k: dt.date(2024, 1, 1) + dt.timedelta(days=k)
STATUS, BARS = "date date, ticker string, trading_status string", "date date, ticker string"
ACTIONS = "action_id string, ticker string, action_type string, effective_date date, cash_amount double, successor_ticker string"
SYMBOLS = "instrument_id string, ticker string, effective_from date, effective_to date"
EXITS = "ticker string, asset_slot int, last_active_date date, exit_date date"


def loop(exit_row, sessions, status, bars, actions, symbols):
    """(instrument, liquidation date, lag, observed, action, path, covered, reason) of one exit, session by session."""
    ticker, _, _, day = exit_row
    names = [i for i, t, a, b in symbols if t == ticker and a <= day < b]
    name = names[0].strip() if len(names) == 1 else ""
    if not name:
        return None, None, None, 0, None, "unresolved", False, "missing_stable_instrument_identity"
    left = [x for x in sorted(sessions) if x >= day]
    if not left:
        return name, None, None, 0, None, "unresolved", False, "missing_authoritative_exit_sessions"
    seen = 0
    for lag, x in enumerate(left):
        states = [s for d, t, s in status if (d, t) == (x, ticker)]
        if len(states) != 1:
            return name, None, None, seen, None, "unresolved", False, "missing_contiguous_exit_status"
        seen += 1
        if states[0] in ("suspended", "halted", "no_trade"):
            continue
        if states[0] == "trading":
            if (x, ticker) in bars:
                return name, x, lag, seen, None, "tradable_liquidation", True, ""
            return name, None, None, seen, None, "unresolved", False, "trading_exit_without_valid_bar"
        if states[0] == "delisted":
            ok = sorted((e, i) for i, t, kind, e, cash, to in actions if t == ticker and kind in ("delisting", "merger") and e <= x and ((cash is not None and cash >= 0) or (to or "").strip()))
            if ok:
                return name, x, lag, seen, ok[0][1], "terminal_settlement", True, ""
            return name, None, None, seen, None, "unresolved", False, "delisting_without_explicit_resolution"
        return name, None, None, seen, None, "unresolved", False, f"inconsistent_exit_status:{states[0]}"
    return name, None, None, seen, None, "unresolved", False, "exit_path_ends_before_resolution"


@pytest.fixture(scope="module")
def package():
    draw = random.Random(7)
    sessions = [D(k) for k in range(0, 60) if k % 7 < 5]
    tickers = [f"T{k}" for k in range(40)]
    status, bars = [], []
    for t in tickers:
        for x in sessions:
            s = draw.choices(["trading", "halted", "suspended", "no_trade", "delisted", "not_yet_listed", None], [1, 6, 4, 4, 1, 0.2, 0.5])[0]
            if s:
                status.append((x, t, s))
            if draw.random() < 0.5:
                bars.append((x, t))
    status += [status[5], (status[9][0], status[9][1], "halted")]
    actions = [(f"a{k:02d}", draw.choice(tickers), draw.choice(["delisting", "merger", "dividend"]), D(draw.randrange(60)), draw.choice([None, -1.0, 0.0, 2.0]), draw.choice([None, " ", "T1"])) for k in range(90)]
    symbols = [(f"i{k}", t, D(-100), D(100)) for k, t in enumerate(tickers) if k not in (3, 4)] + [("  ", "T3", D(-100), D(100)), ("j5", "T5", D(10), D(20)), ("i4", "T4", D(-100), D(15)), ("i4b", "T4", D(15), D(100))]
    rows = [(t, k, D(e - 1), D(e)) for k, t in enumerate(tickers) for e in sorted(draw.sample(range(58), 3))] + [("T0", 0, D(90), D(99)), ("T9", 9, D(3), D(5)), ("none", 99, D(0), D(1))]
    return rows, sessions, status, bars, actions, symbols


def frames(spark, rows, sessions, status, bars, actions, symbols):
    return [spark.createDataFrame(rows, EXITS).repartition(3), spark.createDataFrame([(x,) for x in sessions], "date date"), spark.createDataFrame(status, STATUS).repartition(5), spark.createDataFrame(bars, BARS), spark.createDataFrame(actions, ACTIONS), spark.createDataFrame(symbols, SYMBOLS)]


def test_paths_follow_the_loop(spark, package):
    rows = package[0]
    got = {(r.ticker, r.exit_date): tuple(r)[4:] for r in exits.exit_paths(*frames(spark, *package)).collect()}
    assert len(got) == len(rows)
    for row in rows:
        expected = loop(row, *package[1:])
        assert got[row[0], row[3]] == expected, row
    reasons = {x[-1] for x in got.values()}
    assert len(reasons) >= 7 and {x[5] for x in got.values()} == {"unresolved", "tradable_liquidation", "terminal_settlement"}


def test_exits_are_the_ends_of_membership(spark):
    rows = [(D(k), t, 1, m) for t, flags in {"a": "1101101", "b": "0000011", "c": "1"}.items() for k, m in enumerate(x == "1" for x in flags)]
    got = exits.membership_exits(spark.createDataFrame(rows, "date date, ticker string, asset_slot int, is_member boolean")).collect()
    assert sorted((r.ticker, r.last_active_date, r.exit_date) for r in got) == [("a", D(1), D(2)), ("a", D(4), D(5))]


def test_an_instrument_is_followed_under_its_names(spark):
    """old is renamed to mid and mid to new while it is halted: by ticker the path breaks off, by instrument it goes on."""
    sessions = [D(k) for k in range(10)]
    symbols = [("i1", "old", D(-9), D(3)), ("i2", "mid", D(3), D(5)), ("i3", "new", D(5), D(99)), ("x", "other", D(-9), D(99))]
    actions = [("a1", "old", "symbol_change", D(3), None, "mid"), ("a2", "mid", "symbol_change", D(5), None, "new"), ("a3", "new", "delisting", D(7), 1.0, None)]
    status = [(D(k), "old", "halted") for k in range(3)] + [(D(k), "mid", "suspended") for k in (3, 4)] + [(D(k), "new", "halted") for k in (5, 6)] + [(D(7), "new", "delisted"), (D(2), "other", "trading")]
    given = frames(spark, [("old", 0, D(0), D(1)), ("other", 1, D(1), D(2))], sessions, status, [(D(2), "other")], actions, symbols)
    by_ticker = {r.ticker: (r.path_status, r.observed_sessions, r.blocking_reason) for r in exits.exit_paths(*given).collect()}
    assert by_ticker == {"old": ("unresolved", 2, "missing_contiguous_exit_status"), "other": ("tradable_liquidation", 1, "")}
    found = {r.ticker: (r.path_status, r.liquidation_date, r.observed_sessions, r.terminal_action_id) for r in exits.exit_paths(*given, follow=True).collect()}
    assert found == {"old": ("terminal_settlement", D(7), 7, "a3"), "other": ("tradable_liquidation", D(2), 1, None)}


def test_chains_of_names(spark):
    links = [(f"n{k + 1}", f"n{k}") for k in range(37)] + [("b", "a"), ("same", "same"), (None, "x")]
    got = {r.name: r.root for r in exits.first_of_chain(spark.createDataFrame(links, "name string, before string")).collect()}
    assert got == {f"n{k + 1}": "n0" for k in range(37)} | {"b": "a"}
    for circle in ([("a", "b"), ("b", "a")], [("a", "b"), ("b", "c"), ("c", "a")]):
        with pytest.raises(ValueError, match="circle"):
            exits.first_of_chain(spark.createDataFrame(circle, "name string, before string"), 6)
