"""Data-quality checks as rows: check, passed, failures. assert_checks turns them into an error."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def check_rows(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """One row for each test: how many rows break it. All tests are one aggregate over one scan."""
    counts = df.agg(*(F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in tests.items()))
    pairs = F.array(*(F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in tests))
    return counts.select(F.explode(pairs).alias("x")).select("x.check", (F.col("x.failures") == 0).alias("passed"), "x.failures")


def repeated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).count().where("count > 1")


def count_check(name: str, failing: DataFrame) -> DataFrame:
    return failing.agg(F.count("*").alias("failures")).select(F.lit(name).alias("check"), (F.col("failures") == 0).alias("passed"), "failures")


def union_checks(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def assert_checks(checks: DataFrame) -> None:
    """Raise with all failed checks; the rows are a fixed few."""
    failed = checks.where("not passed").orderBy("check").collect()
    if failed:
        raise ValueError("; ".join(f"{r.check}: {r.failures}" for r in failed))


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


#: How columns of release dates end.
RELEASE_SUFFIXES = ("release_date", "available_date", "asof_date")


def release_columns(columns: list[str], at: str = "date") -> list[str]:
    return [c for c in columns if c != at and any(c == s or c.endswith(f"_{s}") for s in RELEASE_SUFFIXES)]


def leakage_report(panel: DataFrame, row_id: str, released: list[str] | None = None, by: str = "ticker", at: str = "date") -> DataFrame:
    """Valid dates, unique keys, tickers whose dates are not in the order of the source rows, and for each release
    column (those named, else found by their ending) missing dates and dates after the row's own.

    A ticker may hold a third of all rows: its order is tested in ranges of row_id, each against the greatest
    date of the ranges before it, and never in one sort."""
    columns = release_columns(panel.columns, at) if released is None else released
    rows = panel.where(F.col(at).isNotNull())
    ends = rows.agg(F.min(row_id).alias("a"), F.max(row_id).alias("b"))
    ranges = 64
    share = F.try_divide(F.col(row_id) - F.col("a"), F.col("b") - F.col("a"))
    dealt = rows.crossJoin(F.broadcast(ends)).withColumn("__g", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * ranges), F.lit(ranges - 1)))
    greatest = dealt.groupBy(by, "__g").agg(F.max(at).alias("__m"))
    before = greatest.select(by, "__g", F.max("__m").over(Window.partitionBy(by).orderBy("__g").rowsBetween(Window.unboundedPreceding, -1)).alias("__before"))
    inside = dealt.withColumn("__last", F.lag(at).over(Window.partitionBy(by, "__g").orderBy(row_id))).join(F.broadcast(before), [by, "__g"])
    disorder = inside.where((F.col(at) < F.col("__last")) | (F.col(at) < F.col("__before"))).select(by).distinct()
    tests = {"valid_dates": F.col(at).isNotNull()}
    for c in columns:
        tests |= {f"{c}_valid": F.col(c).isNotNull(), f"{c}_not_future": F.col(c).isNull() | F.col(at).isNull() | (F.col(c) <= F.col(at))}
    return union_checks(check_rows(panel, tests), count_check("monotonic", disorder), count_check("unique_keys", repeated_keys(rows, [at, by])))


def boundary_checks(labelled: DataFrame, order: list[str], at: str = "date") -> DataFrame:
    """No date in two splits, and each split ends before the next begins."""
    ends = labelled.groupBy("split").agg(F.min(at).alias("a"), F.max(at).alias("b"))
    shared = labelled.select(at, "split").distinct().groupBy(at).count().where("count > 1")
    parts = [count_check("dates_in_one_split", shared)]
    for x, y in zip(order, order[1:], strict=False):
        both = ends.where(F.col("split") == x).select("b").crossJoin(ends.where(F.col("split") == y).select("a"))
        parts.append(count_check(f"{x}_before_{y}", both.where("b >= a")))
    return union_checks(*parts)


def coverage(panel: DataFrame, by: str = "ticker", at: str = "date") -> DataFrame:
    total = panel.agg(F.count_distinct(at).alias("total"))
    each = panel.groupBy(by).agg(F.count_distinct(at).alias("dates"), F.min(at).alias("first_date"), F.max(at).alias("last_date"))
    return each.crossJoin(F.broadcast(total)).withColumn("coverage", F.col("dates") / F.col("total"))


def missingness(df: DataFrame) -> DataFrame:
    """column, missing, share: one aggregate, unpivoted."""
    counts = df.agg(F.count("*").alias("__n"), *(F.count_if(F.col(c).isNull()).alias(c) for c in df.columns))
    return counts.unpivot("__n", df.columns, "column", "missing").select("column", "missing", F.coalesce(F.try_divide("missing", "__n"), F.lit(0.0)).alias("share"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one side only, as two checks: a recomputed table must equal the stored one."""
    return union_checks(count_check("not_stored", a.exceptAll(b)), count_check("not_recomputed", b.exceptAll(a)))


def varying(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Keys whose attributes differ between rows, nulls included."""
    return df.groupBy(key).agg(F.count_distinct(F.struct(*(F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns))).alias("n")).where("n > 1")


def flow_conservation(flows: DataFrame, groups: int, at: str = "date", by: str = "investor_type", share: float = 0.01) -> DataFrame:
    """date, groups and passed: all groups are there, no value is negative, and the net of all of them is at
    most this share of the value bought."""
    bought, net = F.sum("buy_value"), F.abs(F.sum(F.col("buy_value") - F.col("sell_value")))
    fine = (F.count_distinct(by) == groups) & ~((net > share * bought) & (bought > 0)) & (F.min("buy_value") >= 0) & (F.min("sell_value") >= 0)
    return flows.groupBy(at).agg(F.count_distinct(by).alias("groups"), F.coalesce(fine, F.lit(False)).alias("passed"))


def failure_message(checks: DataFrame) -> DataFrame:
    """One row, message: the failed checks by name; no row where all passed."""
    failed = checks.where("not passed").agg(F.array_sort(F.collect_list(F.concat_ws(": ", "check", F.col("failures").cast("string")))).alias("f"))
    return failed.where(F.size("f") > 0).select(F.array_join("f", "; ").alias("message"))


def member_coverage(members: DataFrame, bars: DataFrame) -> DataFrame:
    """ticker, required, covered, share and ready: how many of its member sessions have a bar."""
    seen = members.select("date", "ticker").distinct().join(bars.select("date", "ticker").distinct().withColumn("__b", F.lit(1)), ["date", "ticker"], "left")
    c = seen.groupBy("ticker").agg(F.count("*").alias("required"), F.count("__b").alias("covered"))
    return c.select("ticker", "required", "covered", (F.col("covered") / F.col("required")).alias("share"), (F.col("covered") == F.col("required")).alias("ready"))


def calendar_checks(calendar: DataFrame, expected: DataFrame, most_days: int, at: str = "date") -> DataFrame:
    """Sessions there are, once each, on weekdays, no further apart than most_days, and none of those expected missing."""
    steps = calendar.withColumn("__b", F.lag(at).over(Window.orderBy(at)))  # one row a session: a dimension
    rows = check_rows(steps, {"weekday": F.weekday(at) < 5, "no_long_gap": F.col("__b").isNull() | (F.datediff(at, "__b") <= most_days)})
    empty = calendar.agg(F.count("*").alias("n")).where("n = 0")
    return union_checks(rows, count_check("not_empty", empty), count_check("unique_date", repeated_keys(calendar, [at])), count_check("complete", expected.join(calendar, at, "left_anti")))


def rank_checks(df: DataFrame, keys: list[str], rank: str, value: str, tie: str) -> DataFrame:
    """keys, n, complete (ranks are exactly 1 to n) and out_of_order (rows whose value is over that of the rank before)."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(rank, tie))
    return df.withColumn("__b", before).groupBy(*keys).agg(F.count("*").alias("n"), ((F.min(rank) == 1) & (F.max(rank) == F.count("*")) & (F.count_distinct(rank) == F.count("*"))).alias("complete"), F.count_if(F.col("__b") < F.col(value)).alias("out_of_order"))


def subset_check(name: str, part: DataFrame, whole: DataFrame, key: str) -> DataFrame:
    """How many keys of part the whole lacks."""
    return count_check(name, part.select(key).distinct().join(whole.select(key).distinct(), key, "left_anti"))


def overlap_check(name: str, df: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """Whether there are dates, and from the least to the greatest of them the window is touched."""
    ends = df.agg(F.min(at).alias("a"), F.max(at).alias("b"))
    apart = F.col("a").isNull() | (F.col("b") < F.lit(start).cast("date")) | (F.col("a") > F.lit(end).cast("date"))
    return count_check(name, ends.where(apart))


def source_ready(name: str, df: DataFrame, columns: list[str], least: int) -> DataFrame:
    """source, rows, missing_columns, ready and reason: the columns it must have, and its least number of rows."""
    missing = [c for c in columns if c not in df.columns]
    n = df.agg(F.count("*").alias("rows"))
    reason = F.lit("missing required columns") if missing else F.when(F.col("rows") >= least, "ready").otherwise("too few rows")
    return n.select(F.lit(name).alias("source"), "rows", F.lit(",".join(missing)).alias("missing_columns"), (F.lit(not missing) & (F.col("rows") >= least)).alias("ready"), reason.alias("reason"))


def environment_checks(panel: DataFrame, features: list[str], price: str, eligible: str, lookback: int, by: str = "ticker", at: str = "date") -> DataFrame:
    """Rows that are eligible and have an outcome: finite features in the whole lookback before, positive prices now and next."""
    w = Window.partitionBy(by).orderBy(at)
    fine = F.lit(True)
    for c in features:
        fine = fine & F.coalesce(~F.isnan(c) & (F.abs(c) < float("inf")), F.lit(False)) & F.col(c).isNotNull()
    past = w.rowsBetween(-lookback, -1)
    x = panel.withColumn("__f", fine)
    x = x.withColumns({"__fine": F.coalesce(F.bool_and("__f").over(past), F.lit(False)) & (F.count("*").over(past) == lookback), "__next": F.lead(price).over(w)})
    return check_rows(x.where(F.col(eligible) & F.col("__next").isNotNull()), {"lookback_finite": F.col("__fine"), "decision_price": F.col(price) > 0, "outcome_price": F.col("__next") > 0})


def objective_checks(metrics: DataFrame, actions: DataFrame) -> DataFrame:
    """metrics(objective, max_drawdown, turnover) and actions(date, weight) of trials: finite, in range, and no more than the capital a date."""
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    a = check_rows(metrics, {"finite_objective": finite("objective"), "drawdown": F.col("max_drawdown").between(-1.0, 0.0), "not_negative": F.col("turnover") >= 0})
    b = check_rows(actions, {"weights": finite("weight") & F.col("weight").between(-1e-8, 1 + 1e-8)})
    over = actions.groupBy("date").agg(F.sum("weight").alias("s")).where(F.col("s") > 1 + 1e-6)
    return union_checks(a, b, count_check("daily_sum", over))


def rate_checks(history: DataFrame) -> DataFrame:
    """history(announced, rate, decision), one row a meeting: texts that fit the form, one decision a date, and levels
    that move by what was decided."""
    from ..functions.scalars import decision_points

    x = history.withColumns({"__bp": decision_points(F.col("decision")), "__b": F.lag("rate").over(Window.orderBy("announced"))})
    moved = F.round((F.col("rate") - F.col("__b")) * 100, 6)
    rows = check_rows(x, {"recognised": F.col("__bp").isNotNull(), "level_follows_decision": F.col("__b").isNull() | (moved == F.col("__bp"))})
    return rows.unionByName(count_check("one_a_date", repeated_keys(history, ["announced"])))
