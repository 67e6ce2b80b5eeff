"""Contracts over whole packages of tables, as rows check, passed, failures (see quality).

Each contract is a list of named predicates; those over the rows of one table share one scan, those about keys,
intervals and other tables are a grouping or an anti join each. Nothing fails silently: a null breaks a test."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.digests import row_digest
from . import quality as K

#: States of trading, and the kinds of corporate actions.
TRADING_STATES = ("trading", "suspended", "halted", "no_trade", "delisted", "not_yet_listed")
NONTRADING_STATES = ("suspended", "halted", "no_trade")
ACTION_TYPES = ("dividend", "split", "reverse_split", "rights", "spin_off", "merger", "symbol_change", "delisting")
FACTOR_TYPES, SUCCESSOR_TYPES = ("split", "reverse_split", "rights", "spin_off"), ("merger", "symbol_change")


def filled(name: str) -> Column:
    return F.coalesce(F.trim(F.col(name)), F.lit("")) != ""


def flag(name: str) -> Column:
    """A boolean written as text in any case; anything else is null."""
    low = F.lower(F.trim(F.col(name).cast("string")))
    return F.when(low == "true", True).when(low == "false", False)


def _one_if(name: str, bad: DataFrame) -> DataFrame:
    """A check of a whole table: 1 failure if bad has a row."""
    return bad.agg(F.least(F.count("*"), F.lit(1)).alias("failures")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures")


def _groups(name: str, df: DataFrame, keys: list[str], ok: Column) -> DataFrame:
    """How many groups break a test over their rows."""
    return K.count_check(name, df.groupBy(*keys).agg(F.coalesce(ok, F.lit(False)).alias("ok")).where("not ok"))


def membership_history(frame: DataFrame, outer: int, inner: int, start: str, end: str) -> DataFrame:
    """The contract of a membership archive(record_id, symbol, ticker, sector, effective_from, effective_to,
    published_at, in_inner, in_outer): rows, intervals without gap or overlap from start to end, and the sizes
    of each record."""
    rows = K.check_rows(frame, {
        "valid_dates": F.col("effective_from").isNotNull() & F.col("effective_to").isNotNull() & F.col("published_at").isNotNull(),
        "boolean_flags": flag("in_inner").isNotNull() & flag("in_outer").isNotNull(), "ticker_form": F.col("ticker").rlike("^[A-Z0-9&.-]+\\.BK$"), "sector_present": filled("sector"),
        "inside_outer": flag("in_outer"), "inner_inside_outer": ~flag("in_inner") | flag("in_outer"), "published_in_time": F.col("published_at") <= F.col("effective_from"),
    })
    spans = frame.select("record_id", "effective_from", "effective_to", "published_at").distinct()
    w = Window.orderBy("effective_from", "record_id")  # one row a record: a dimension
    steps = spans.withColumns({"before": F.lag("effective_to").over(w), "first": F.row_number().over(w) == 1, "last": F.lead("record_id").over(w).isNull()})
    intervals = K.check_rows(steps, {
        "positive_intervals": F.col("effective_from") < F.col("effective_to"), "no_gap": F.col("before").isNull() | (F.col("before") >= F.col("effective_from")), "no_overlap": F.col("before").isNull() | (F.col("before") <= F.col("effective_from")),
        "starts_at": ~F.col("first") | (F.col("effective_from") == F.lit(start).cast("date")), "ends_at": ~F.col("last") | (F.col("effective_to") == F.lit(end).cast("date")),
    })
    return K.union_checks(
        rows, intervals, K.count_check("unique_symbols", K.repeated_keys(frame, ["record_id", "symbol"])), K.count_check("one_interval_a_record", K.repeated_keys(spans, ["record_id"])),
        _groups("record_size", frame, ["record_id"], F.count("*") == outer), _groups("record_symbols", frame, ["record_id"], F.count_distinct("symbol") == outer), _groups("record_inner", frame, ["record_id"], F.count_if(flag("in_inner")) == inner),
    )


def membership_panel(panel: DataFrame, mask_kind: str, rule: str, active: int, expected_dates: DataFrame | None = None, expected_slots: DataFrame | None = None) -> DataFrame:
    """The contract of a dense panel(date, ticker, asset_slot, is_member, published_at, revision_status, mask_kind,
    rule, index_name, record_id, sector, symbol): original records are public on their day, revisions a session later.

    A ticker keeps its slot on all dates and a slot its ticker. Where they are given, the dates are exactly expected_dates(date) and
    the slots exactly expected_slots(asset_slot, ticker)."""
    member = flag("is_member")
    rows = K.check_rows(panel, {
        "valid_dates": F.col("date").isNotNull() & F.col("published_at").isNotNull(), "boolean_membership": member.isNotNull(), "mask_kind": F.col("mask_kind") == mask_kind, "revision_rule": F.col("rule") == rule,
        "record_present": filled("record_id"), "public_in_time": F.when(F.col("revision_status") == "revised", F.col("published_at") < F.col("date")).otherwise(F.col("published_at") <= F.col("date")),
        "member_sector": ~member | filled("sector"), "member_symbol": ~member | filled("symbol"),
    })
    size = panel.select(F.count_distinct("date").alias("d"), F.count_distinct("ticker").alias("t"), F.count("*").alias("n"))
    n = panel.select(F.count_distinct("ticker").alias("n_slots"))
    slots = panel.groupBy("date").agg(F.sort_array(F.collect_list("asset_slot")).alias("s"), F.count_if(member).alias("m")).crossJoin(F.broadcast(n))  # a date's assets are a bounded list
    held = panel.select("asset_slot", "ticker").distinct()
    asked = [("date", ["date"], expected_dates), ("slot", ["asset_slot", "ticker"], expected_slots)]
    grid = [f for n, on, want in asked if want is not None for f in (missing(f"{n}_missing", want, panel, on), missing(f"{n}_foreign", panel, want, on))]
    return K.union_checks(
        *grid, _groups("one_ticker_a_slot", held, ["asset_slot"], F.count("*") == 1), _groups("one_slot_a_ticker", held, ["ticker"], F.count("*") == 1),
        rows, K.count_check("unique_keys", K.repeated_keys(panel, ["date", "ticker"])), _one_if("one_index", panel.select("index_name").distinct().agg(F.count("*").alias("k")).where("k != 1")),
        _groups("one_record_a_session", panel, ["date"], F.count_distinct("record_id") == 1), _one_if("dense", size.where("n != d * t")),
        K.count_check("stable_slots", slots.where(F.col("s") != F.sequence(F.lit(0), F.col("n_slots").cast("int") - 1))), K.count_check("active_count", slots.where(F.col("m") != active)),
    )


def missing(name: str, a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """How many keys of a the table b lacks."""
    return K.count_check(name, a.select(*on).distinct().join(b.select(*on).distinct(), on, "left_anti"))


def corporate_actions(actions: DataFrame, tickers: DataFrame) -> DataFrame:
    """Domain and lineage of actions(action_id, ticker, action_type, announcement_at, effective_date,
    adjustment_factor, cash_amount, successor_ticker, source_record_id): known kinds and tickers, announced by
    their date, a factor or a successor where the kind needs one, no negative cash, a source."""
    kind = F.col("action_type")
    rows = K.check_rows(actions, {
        "action_type": kind.isin(*ACTION_TYPES), "action_dates": F.to_date("announcement_at") <= F.col("effective_date"), "action_factor": ~kind.isin(*FACTOR_TYPES) | (F.col("adjustment_factor").isNotNull() & (F.col("adjustment_factor") > 0)),
        "action_cash": F.col("cash_amount").isNull() | (F.col("cash_amount") >= 0), "action_successor": ~kind.isin(*SUCCESSOR_TYPES) | filled("successor_ticker"), "action_source": filled("source_record_id"),
    })
    return K.union_checks(rows, K.count_check("unique_actions", K.repeated_keys(actions, ["action_id"])), missing("action_ticker_known", actions, tickers, ["ticker"]))


def market_package(bars: DataFrame, status: DataFrame, sessions: DataFrame, actions: DataFrame, symbols: DataFrame, members: DataFrame, expected_sessions: DataFrame, tickers: DataFrame) -> DataFrame:
    """The contract of a package of five tables against members(date, ticker), the expected sessions(date) and tickers(ticker).

    bars(date, ticker, open, high, low, close, adjusted_close, volume, bar_available_at, source_record_id),
    status(date, ticker, trading_status, status_available_at, source_record_id), sessions(date,
    session_available_at, source_record_id), actions(action_id, ticker, action_type, announcement_at,
    effective_date, adjustment_factor, cash_amount, successor_ticker, source_record_id) and symbols(instrument_id,
    ticker, effective_from, effective_to, source_record_id)."""
    key, prices = ["date", "ticker"], ["open", "high", "low", "close", "adjusted_close"]
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    domain = F.lit(True)
    for c in prices:
        domain = domain & fine(c) & (F.col(c) > 0)
    low, high = F.least("open", "close"), F.greatest("open", "close")
    same_day = lambda c: F.to_date(F.col(c)) == F.col("date")
    at_bars = K.check_rows(bars, {
        "bar_numeric_domain": domain & F.col("volume").isNotNull() & (F.col("volume") >= 0), "bar_envelope": (F.col("high") + 1e-8 >= high) & (F.col("low") - 1e-8 <= low) & (F.col("low") <= F.col("high") + 1e-8),
        "bar_available_on_its_day": same_day("bar_available_at"), "bar_source": filled("source_record_id"),
    })
    at_status = K.check_rows(status, {"status_values": F.col("trading_status").isin(*TRADING_STATES), "status_available_on_its_day": same_day("status_available_at"), "status_source": filled("source_record_id")})
    at_sessions = K.check_rows(sessions, {"session_source": filled("source_record_id"), "session_known_in_time": F.to_date("session_available_at") <= F.col("date")})
    at_symbols = K.check_rows(symbols.withColumn("before", F.lag("effective_to").over(Window.partitionBy("instrument_id").orderBy("effective_from"))), {
        "symbol_intervals": F.col("effective_from") < F.col("effective_to"), "symbol_instrument": filled("instrument_id"), "symbol_source": filled("source_record_id"), "symbol_no_overlap": F.col("before").isNull() | (F.col("before") <= F.col("effective_from")),
    })
    seen = members.select(*key).distinct().join(status.select(*key, "trading_status"), key, "left").join(bars.select(*key).distinct().withColumn("bar", F.lit(True)), key, "left")
    state = F.col("trading_status")
    at_members = K.check_rows(seen, {
        "member_has_status": state.isNotNull(), "member_is_listed": state.isNull() | ~state.isin("delisted", "not_yet_listed"), "trading_has_bar": state.isNull() | (state != "trading") | F.col("bar").isNotNull(),
        "member_observed": F.coalesce(((state == "trading") & F.col("bar").isNotNull()) | state.isin(*NONTRADING_STATES), F.lit(False)),
    })
    covered = members.select(*key).distinct().join(symbols.select(F.col("ticker").alias("t"), "effective_from", "effective_to"), (F.col("ticker") == F.col("t")) & (F.col("effective_from") <= F.col("date")) & (F.col("date") < F.col("effective_to")), "left_anti")
    return K.union_checks(
        at_bars, at_status, at_sessions, corporate_actions(actions, tickers), at_symbols, at_members, K.count_check("bar_grain", K.repeated_keys(bars, key)), K.count_check("status_grain", K.repeated_keys(status, key)),
        missing("bar_ticker_known", bars, tickers, ["ticker"]), missing("ticker_has_bar", tickers, bars, ["ticker"]), missing("status_ticker_known", status, tickers, ["ticker"]), missing("symbol_ticker_known", symbols, tickers, ["ticker"]), missing("ticker_has_symbol", tickers, symbols, ["ticker"]),
        missing("session_expected", sessions, expected_sessions, ["date"]), missing("session_present", expected_sessions, sessions, ["date"]), missing("bar_on_session", bars, sessions, ["date"]), missing("status_on_session", status, sessions, ["date"]),
        K.count_check("member_has_symbol", covered),
    )


def market_coverage(bars: DataFrame, status: DataFrame, members: DataFrame, tickers: DataFrame) -> DataFrame:
    """coverage, covered, required and share (1 where nothing is required) of a package: tickers with any bar, sessions of members with a
    bar, with a status, and observed: with a bar, or a state without trading."""
    key = ["date", "ticker"]
    flagged = lambda df, on, name: df.select(*on).distinct().withColumn(name, F.lit(True))
    states = status.groupBy(*key).agg(F.bool_or(F.col("trading_status").isin(*NONTRADING_STATES)).alias("quiet"), F.lit(True).alias("state"))
    names = tickers.select("ticker").distinct().join(flagged(bars, ["ticker"], "bar"), "ticker", "left").agg(F.count("*").alias("required"), F.count("bar").alias("covered")).select(F.lit("ticker_has_bar").alias("coverage"), "covered", "required")
    seen = members.select(*key).distinct().join(flagged(bars, key, "bar"), key, "left").join(states, key, "left")
    n = seen.agg(F.count("*").alias("required"), F.count("bar").alias("member_has_bar"), F.count("state").alias("member_has_status"), F.count_if(F.col("bar").isNotNull() | F.coalesce("quiet", F.lit(False))).alias("member_observed"))
    rows = n.select("required", F.explode(F.array(*(F.struct(F.lit(c).alias("coverage"), F.col(c).alias("covered")) for c in ("member_has_bar", "member_has_status", "member_observed")))).alias("x")).select("x.coverage", "x.covered", "required")
    return names.unionByName(rows).withColumn("share", F.coalesce(F.try_divide("covered", "required"), F.lit(1.0)))


def close_to(a: Column, b: Column) -> Column:
    return F.abs(a - b) <= 1e-10 + 1e-12 * F.abs(b)


def value_chain(df: DataFrame, name: str, before: str, step: str, after: str, by: list[str], at: str) -> DataFrame:
    """Positive values, steps over -1, after = before (1 + step), and before = after of the row before."""
    last = F.lag(after).over(Window.partitionBy(*by).orderBy(at))
    b, s, a = F.col(before), F.col(step), F.col(after)
    return K.check_rows(df.withColumn("__last", last), {
        f"{name}_positive": (b > 0) & (a > 0), f"{name}_step": s > -1, f"{name}_reconciles": close_to(a, b * (1 + s)), f"{name}_continuous": F.col("__last").isNull() | close_to(b, F.col("__last")),
    })


def seal(results: DataFrame, columns: list[str], name: str = "result_row_sha256") -> DataFrame:
    """results with the digest of these columns of each row: SHA-256 of their canonical JSON (see digests)."""
    return results.withColumn(name, row_digest(results, columns))


def bound_results(results: DataFrame, binding: dict[str, object], version: str, columns: list[str], name: str = "result_row_sha256") -> DataFrame:
    """What ties sealed rows to one run: each identity column has the value it is bound to, the schema version is this one,
    and the digest is that of the row's columns. A null, also of a digest that can't be made, fails."""
    tests = {f"foreign_{c}": F.col(c) == F.lit(v) for c, v in binding.items()}
    return K.check_rows(results, tests | {"schema_version": F.col("schema_version") == version, "row_digest": F.col(name) == row_digest(results, columns)})


def transition_results(results: DataFrame, expected: DataFrame, by: list[str]) -> DataFrame:
    """The contract of transition results against the expected(transition_index, decision_date, outcome_date).

    Indices run from 0 without a gap in each group of by, dates are those expected, costs are not negative, net
    return is gross less costs, self-financing closes, and the three value chains hold: candidate, equal weight, index."""
    rows = K.check_rows(results, {
        "turnover": F.col("turnover") >= 0, "cost": F.col("transaction_cost_paid") >= 0, "slippage": F.col("slippage_paid") >= 0,
        "net_return": close_to(F.col("net_return"), F.col("gross_return") - F.col("transaction_cost_paid") - F.col("slippage_paid")), "self_financing": F.abs("reconciliation_error") <= 1e-10,
    })
    index = F.col("transition_index")
    both = ["transition_index", "decision_date", "outcome_date"]
    strange = results.select(*both).join(expected.select(*both), both, "left_anti")
    lacking = results.select(*by).distinct().crossJoin(F.broadcast(expected.select(*both))).join(results.select(*by, *both), [*by, *both], "left_anti")
    chains = [value_chain(results, n, f"{p}_before", r, f"{p}_after", by, "transition_index") for n, p, r in (("candidate", "portfolio_value", "net_return"), ("equal_weight", "equal_weight_value", "equal_weight_net_return"), ("index", "set_index_value", "set_index_net_return"))]
    return K.union_checks(rows, _groups("contiguous_index", results, by, (F.min(index) == 0) & (F.max(index) == F.count("*") - 1) & (F.count_distinct(index) == F.count("*"))), K.count_check("foreign_transition", strange), K.count_check("missing_transition", lacking), *chains)


def metric_ledger(metrics: DataFrame, candidates: DataFrame, folds: DataFrame, seeds: DataFrame) -> DataFrame:
    """The contract of candidate metrics: the exact grid of candidates, folds and seeds, complete, finite and in
    range; the log return is that of the cumulative return."""
    key = ["candidate_id", "fold_id", "seed"]
    grid = candidates.select("candidate_id").crossJoin(F.broadcast(folds.select("fold_id"))).crossJoin(F.broadcast(seeds.select("seed")))
    figures = ["net_cumulative_return", "net_log_return", "sharpe", "max_drawdown", "turnover", "equal_weight_net_log_return", "equal_weight_max_drawdown", "set_index_net_log_return"]
    finite = F.lit(True)
    for c in figures:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    total = F.col("net_cumulative_return")
    inside = lambda c: F.col(c).between(-1.0, 0.0)
    rows = K.check_rows(metrics, {
        "complete": F.col("status") == "complete", "finite": finite, "over_total_loss": total > -1, "log_return": F.when(total > -1, F.abs(F.log1p(total) - F.col("net_log_return")) <= 1e-12).otherwise(True),
        "drawdown": inside("max_drawdown") & inside("equal_weight_max_drawdown"), "turnover": F.col("turnover") >= 0,
    })
    return K.union_checks(rows, K.count_check("unique_cells", K.repeated_keys(metrics, key)), K.count_check("missing_cells", grid.join(metrics.select(*key), key, "left_anti")), K.count_check("foreign_cells", metrics.select(*key).distinct().join(grid, key, "left_anti")))


def masked_valuation(panel: DataFrame, features: list[str], lookback: int, by: str = "ticker", at: str = "date") -> DataFrame:
    """What an eligible asset needs at each decision of panel(date, ticker, eligible, close, features...), one row a ticker and
    date: finite features in the lookback rows before it, and finite prices over 0 on its date and the next.

    Decisions are the dates with lookback dates before them and one after; earlier and later rows are only looked at."""
    dates = panel.select(at).distinct().withColumns({"__i": F.row_number().over(Window.orderBy(at)), "__n": F.count("*").over(Window.partitionBy())})
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    whole = F.lit(True)
    for c in features:
        whole = whole & fine(c)
    w = Window.partitionBy(by).orderBy(at)
    past = w.rowsBetween(-lookback, -1)
    x = panel.join(F.broadcast(dates), at).withColumns({"__whole": whole, "__priced": fine("close") & (F.col("close") > 0)})
    x = x.withColumns({"__seen": F.count_if("__whole").over(past), "__next": F.lead("__priced").over(w)})
    decided = x.where((F.col("__i") > lookback) & (F.col("__i") < F.col("__n")) & F.col("eligible"))
    return K.check_rows(decided, {"finite_lookback": F.col("__seen") == lookback, "price_now": F.col("__priced"), "price_next": F.col("__next")})


def scaler_state(state: DataFrame, protected: list[str], fit_rows: int) -> DataFrame:
    """The self-check of a fitted scaler(feature, position, count, mean, scale, constant): one row a feature."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = K.check_rows(state, {
        "same_count": F.col("count") == fit_rows, "finite": finite("mean") & finite("scale"), "positive_scale": F.col("scale") > 0, "constant_has_unit_scale": ~F.col("constant") | (F.col("scale") == 1.0), "not_protected": ~F.col("feature").isin(*protected),
    })
    order = state.agg(F.count("*").alias("n"), F.count_distinct("position").alias("d"), F.max("position").alias("m"))
    return K.union_checks(rows, K.count_check("unique_features", K.repeated_keys(state, ["feature"])), _one_if("order", order.where("n = 0 or d != n or m != n - 1")))


def intervals(manifest: DataFrame, start: str, end: str) -> DataFrame:
    """The contract of manifest(record_id, effective_from, effective_to, published_at, revision_status, supersedes, basis)."""
    w = Window.orderBy("effective_from")
    steps = manifest.withColumns({"before": F.lag("effective_to").over(w), "first": F.row_number().over(w) == 1, "last": F.lead("record_id").over(w).isNull()})
    revised = F.col("revision_status") == "revised"
    known = manifest.select(F.col("record_id").alias("supersedes")).distinct().withColumn("known", F.lit(True))
    rows = K.check_rows(steps.join(known, "supersedes", "left"), {
        "positive": F.col("effective_from") < F.col("effective_to"), "published_in_time": F.col("published_at") <= F.col("effective_from"), "no_gap": F.col("before").isNull() | (F.col("before") >= F.col("effective_from")),
        "no_overlap": F.col("before").isNull() | (F.col("before") <= F.col("effective_from")), "revision_status": F.col("revision_status").isin("original", "revised"), "has_predecessor": ~revised | filled("supersedes"),
        "predecessor_known": ~revised | ~filled("supersedes") | F.col("known").isNotNull(), "publication_gated": ~revised | (F.col("basis") == "publication_date_conservative"),
        "starts_at": ~F.col("first") | (F.col("effective_from") == F.lit(start).cast("date")), "ends_at": ~F.col("last") | (F.col("effective_to") == F.lit(end).cast("date")),
    })
    return rows
