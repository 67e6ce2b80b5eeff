"""Exits from membership and the sessions that decide them, by stable instrument.

Sessions are a numbered dimension. A status row that trades, delists or does not fit decides; so does the session after a row that
has no next one. What decides an exit is the first such row at or after it: one exchange by ticker (or instrument), carried backwards."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .asof import interval_join
from .contracts import NONTRADING_STATES

#: Why an exit has no path, and how it is resolved.
NO_IDENTITY, NO_SESSIONS = "missing_stable_instrument_identity", "missing_authoritative_exit_sessions"
NO_STATUS, NO_BAR, NO_ACTION = "missing_contiguous_exit_status", "trading_exit_without_valid_bar", "delisting_without_explicit_resolution"
ENDS, ODD = "exit_path_ends_before_resolution", "inconsistent_exit_status:"
SOLD, SETTLED, UNRESOLVED = "tradable_liquidation", "terminal_settlement", "unresolved"
TERMINAL_TYPES = ("delisting", "merger")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Go on from df's rows in the folder that the session names for checkpoints; without one the plan goes on growing."""
    sc = df.sparkSession.sparkContext
    return df.checkpoint() if sc.getCheckpointDir() is not None else df


def membership_exits(panel: DataFrame) -> DataFrame:
    """ticker, asset_slot, last_active_date and exit_date: rows of panel(date, ticker, asset_slot, is_member) that are no
    member where the row before was one."""
    w = Window.partitionBy("ticker").orderBy("date")
    x = panel.select("*", F.lag("is_member").over(w).alias("__was"), F.lag("date").over(w).alias("last_active_date"))
    return x.where(F.col("__was") & ~F.col("is_member")).select("ticker", "asset_slot", "last_active_date", F.col("date").alias("exit_date"))


def instrument_at(rows: DataFrame, symbols: DataFrame, at: str, key: list[str]) -> DataFrame:
    """rows with instrument_id: that of the one interval of symbols(instrument_id, ticker, effective_from, effective_to) which holds
    the ticker's date; null with none, several, or a blank one. key tells rows apart."""
    found = interval_join(rows.select(*key, "ticker", at).distinct(), symbols.select("ticker", "instrument_id", "effective_from", "effective_to").where("effective_to is not null"), at, "effective_from", "effective_to", ["ticker"])
    one = found.groupBy(*key, "ticker", at).agg(F.when(F.count("*") == 1, F.nullif(F.trim(F.max("instrument_id")), F.lit(""))).alias("instrument_id"))
    return rows.join(one, [*key, "ticker", at], "left")


def first_of_chain(links: DataFrame, most: int = 64) -> DataFrame:
    """name and root of links(name, before), at most one a name: the name that a chain of names began with, by pointer jumping, so
    a chain of n names takes log2 n rounds. A circle of names is an error."""
    jumps = links.where("name is not null and before is not null and name != before").select("name", "before")
    for _ in range(most):
        ahead = jumps.select(F.col("name").alias("before"), F.col("before").alias("__next"))
        both = cut_lineage(jumps.join(ahead, "before", "left").select("name", "before", "__next"))
        if not both.where("__next = name").isEmpty():
            raise ValueError("names that succeed each other in a circle")
        jumps = both.select("name", F.coalesce("__next", "before").alias("before"))
        if both.where("__next is not null").isEmpty():
            return jumps.select("name", F.col("before").alias("root"))
    raise ValueError("names that succeed each other in a circle")


def exit_paths(exits: DataFrame, sessions: DataFrame, status: DataFrame, bars: DataFrame, actions: DataFrame, symbols: DataFrame, follow: bool = False) -> DataFrame:
    """The ledger of exits(ticker, asset_slot, last_active_date, exit_date).

    sessions(date), status(date, ticker, trading_status), bars(date, ticker, close, ...: valid ones), actions(action_id, ticker,
    action_type, effective_date, cash_amount, successor_ticker) and symbols (see instrument_at). From the exit on sessions without
    trading are passed over. Trading with a bar liquidates; a delisting settles if a delisting or merger of the ticker, effective by
    then, pays cash or names a successor, the first of these by date and id; all else leaves the exit unresolved for the reason
    given. observed_sessions counts the status rows that were looked at, terminal_action_id names the settling action.

    follow: statuses and bars are those of the instrument, under whatever ticker it then has, and instruments that a symbol change
    made of each other are one. Without it they are those of the exit's ticker."""
    days = sessions.select("date").where("date is not null").distinct().withColumn("i", F.row_number().over(Window.orderBy("date")).cast("long"))
    last = days.agg(F.max("i").alias("__last"))
    key = ["ticker", "exit_date"]
    named = instrument_at(exits, symbols, "exit_date", []).crossJoin(F.broadcast(last))
    # the first session at or after the exit: dates are a dimension
    w = Window.orderBy("date", "__side").rowsBetween(0, Window.unboundedFollowing)
    starts = days.select("date", "i", F.lit(1).alias("__side")).unionByName(exits.select(F.col("exit_date").alias("date"), F.lit(None).cast("long").alias("i"), F.lit(0).alias("__side")).distinct())
    starts = starts.withColumn("start", F.min("i").over(w)).where("__side = 0").select(F.col("date").alias("exit_date"), "start")
    named = named.join(F.broadcast(starts), "exit_date", "left")
    seen = status.select("date", "ticker", "trading_status").join(F.broadcast(days), "date")
    valid = bars.select("date", "ticker").distinct().withColumn("bar", F.lit(True))
    seen = seen.join(valid, ["date", "ticker"], "left")
    if follow:
        seen = instrument_at(seen, symbols, "date", []).where("instrument_id is not null")
        old = actions.where("action_type = 'symbol_change' and successor_ticker is not null")
        when = lambda name, on: symbols.select(F.col("ticker").alias(name), F.col("instrument_id").alias(on), "effective_from", "effective_to")
        before = interval_join(old.select("ticker", "successor_ticker", F.date_sub("effective_date", 1).alias("d"), "effective_date"), when("ticker", "before"), "d", "effective_from", "effective_to", ["ticker"]).drop("effective_from", "effective_to")
        links = interval_join(before, when("successor_ticker", "name"), "effective_date", "effective_from", "effective_to", ["successor_ticker"]).groupBy("name").agg(F.min("before").alias("before"))
        roots = first_of_chain(links)
        rooted = lambda df: df.join(roots, df["instrument_id"] == roots["name"], "left").withColumn("__key", F.coalesce("root", "instrument_id")).drop("name", "root")
        named, seen = rooted(named), rooted(seen)
    else:
        named, seen = named.withColumn("__key", F.col("ticker")), seen.withColumn("__key", F.col("ticker"))
    # repeated status rows of a key and session contradict each other: the session counts as without status
    rows = seen.groupBy("__key", "i").agg(F.count("*").alias("n"), F.max("date").alias("date"), F.max("trading_status").alias("state"), F.max("bar").alias("bar"), F.max("ticker").alias("of")).where("n = 1")
    order = Window.partitionBy("__key").orderBy("i")
    gaps = rows.select("__key", F.col("i").alias("__i"), F.lead("i").over(order).alias("__next")).crossJoin(F.broadcast(last)).where("__i < __last and (__next is null or __next > __i + 1)")
    decide = F.struct("i", "date", "state", "bar", "of")
    deciding = rows.where(~F.col("state").isin(*NONTRADING_STATES) | F.col("state").isNull()).select("__key", "i", decide.alias("d"))
    none = F.struct((F.col("__i") + 1).alias("i"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("string").alias("state"), F.lit(None).cast("boolean").alias("bar"), F.lit(None).cast("string").alias("of"))
    deciding = deciding.unionByName(gaps.select("__key", (F.col("__i") + 1).alias("i"), none.alias("d")))
    at_start = rows.select("__key", F.col("i").alias("start"), F.lit(True).alias("present"))
    asked = named.join(at_start, ["__key", "start"], "left").withColumn("__side", F.lit(0))
    both = asked.withColumn("i", F.col("start")).unionByName(deciding.withColumn("__side", F.lit(1)), allowMissingColumns=True)
    ahead = Window.partitionBy("__key").orderBy("i", "__side").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("d", F.first("d", ignorenulls=True).over(ahead)).where("__side = 0").drop("i", "__side")
    pays = F.coalesce(F.col("cash_amount") >= 0, F.lit(False)) | (F.coalesce(F.trim("successor_ticker"), F.lit("")) != "")
    terminal = actions.where(F.lower(F.trim("action_type")).isin(*TERMINAL_TYPES) & pays).groupBy(F.col("ticker").alias("__of")).agg(F.min(F.struct("effective_date", "action_id")).alias("a"))
    found = found.withColumn("__of", F.col("d.of")).join(terminal, "__of", "left")
    action = F.when(F.col("a.effective_date") <= F.col("d.date"), F.col("a.action_id"))
    d, known, began = F.col("d"), F.col("instrument_id").isNotNull(), F.col("start").isNotNull()
    here = known & began & F.coalesce("present", F.lit(False))
    state = F.when(here, d["state"])
    sold, settled = F.coalesce((state == "trading") & d["bar"], F.lit(False)), F.coalesce((state == "delisted") & action.isNotNull(), F.lit(False))
    reason = (
        F.when(~known, NO_IDENTITY).when(~began, NO_SESSIONS).when(~here, NO_STATUS).when(d.isNull(), ENDS).when(d["date"].isNull(), NO_STATUS).when(sold | settled, "")
        .when(state == "trading", NO_BAR).when(state == "delisted", NO_ACTION).otherwise(F.concat(F.lit(ODD), F.coalesce(state, F.lit("null"))))
    )
    seen_rows = F.when(~here, 0).when(d.isNull(), F.col("__last") - F.col("start") + 1).when(d["date"].isNull(), d["i"] - F.col("start")).otherwise(d["i"] - F.col("start") + 1)
    covered = sold | settled
    return found.select(
        *key, "asset_slot", "last_active_date", "instrument_id", F.when(covered, d["date"]).alias("liquidation_date"), F.when(covered, d["i"] - F.col("start")).alias("lag_sessions"), seen_rows.cast("long").alias("observed_sessions"),
        F.when(settled, action).alias("terminal_action_id"), F.when(sold, SOLD).when(settled, SETTLED).otherwise(UNRESOLVED).alias("path_status"), covered.alias("path_covered"), reason.alias("blocking_reason"),
    )
