"""Joins by time that never read the future.

An as-of join by key is the union of both sides, one exchange on the key and one running last();
ties take the last right row. A frequent key is cut into blocks of time (see blocks), and the last right row of a
block is carried to the next ones, so no task sorts a key of many rows. A calendar as-of without a key runs on distinct dates only, then
joins back as a dimension, so no large side meets in one partition."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import LEAST_ROWS, Cuts, cuts_of, small_input


def _carried(both: DataFrame, cuts: Cuts, at: str) -> DataFrame:
    """by, __b and __c: the last right row of the blocks before each block of a cut key. One row a block."""
    ends = both.where("__cut and __r is not null").groupBy(*cuts.by, "__b").agg(F.max_by("__r", F.struct(at, "__side", "__r")).alias("__e"))
    before = Window.partitionBy(*cuts.by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    rows = cuts.blocks().join(ends, [*cuts.by, "__b"], "left").withColumn("__c", F.last("__e", ignorenulls=True).over(before))
    return rows.where("__c is not null").select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(cuts.by)), F.col("__b").alias("__kb"), "__c")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], at: str, right_at: str, values: list[str], max_days: int | None = None, strict: bool = False, least_rows: int | None = LEAST_ROWS) -> DataFrame:
    """left with values of the last right row at or before (strict: before) its date.

    matched_at is that row's date. Beyond max_days the values and matched_at are null. A right row
    with a null key or date never matches; left rows are all kept. Of right rows with equal dates the
    one that is last in the order of values counts. Keys of over twice least_rows rows are cut into blocks
    (None: never)."""
    names = left.columns
    r = right.where(" AND ".join(f"{c} IS NOT NULL" for c in [*by, right_at])).select(*by, F.col(right_at).alias(at), F.struct(F.col(right_at).alias("__at"), *values).alias("__r"), F.lit(0 if not strict else 2).alias("__side"))
    both = left.withColumn("__side", F.lit(1)).unionByName(r, allowMissingColumns=True)
    cuts = None if least_rows is None else cuts_of(both.select(*by, at), by, at, least_rows)
    parts = list(by)
    if cuts:
        both, parts = cuts.with_block(both), [*by, "__b"]
    w = Window.partitionBy(*parts).orderBy(at, "__side", "__r").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("__m", F.last("__r", ignorenulls=True).over(w)).where("__side = 1")
    if cuts:
        on = F.col("__b") == F.col("__kb")
        for i, c in enumerate(by):
            on = on & (F.col(c) == F.col(f"__k{i}"))
        # a null date is in the first block, which nothing is carried to
        out = out.join(F.broadcast(_carried(both, cuts, at)), on, "left").withColumn("__m", F.coalesce("__m", "__c"))
    ok = F.lit(True) if max_days is None else F.datediff(F.col(at), F.col("__m.__at")) <= max_days
    return out.select(*names, *(F.when(ok, F.col(f"__m.{v}")).alias(v) for v in values), F.when(ok, F.col("__m.__at")).alias("matched_at"))


def calendar(panel: DataFrame, at: str = "date") -> DataFrame:
    """Distinct sessions with their number from 1. The dates are a small dimension."""
    return panel.select(at).where(F.col(at).isNotNull()).distinct().withColumn("session", F.row_number().over(Window.orderBy(at)))


def one_a_date(facts: DataFrame, fact_at: str, values: list[str]) -> DataFrame:
    """The last row of each date in the order of values: a dimension, whatever the number of facts."""
    last = facts.where(F.col(fact_at).isNotNull()).groupBy(fact_at).agg(F.max(F.struct(*values)).alias("__v"))
    return last.select(fact_at, "__v.*")


def dates_asof(dates: DataFrame, facts: DataFrame, at: str, fact_at: str, values: list[str], max_days: int | None = None, strict: bool = False) -> DataFrame:
    """As-of without a key: both sides are one row a date before they meet, so the one partition they meet in is small."""
    zero = F.lit(0)
    return asof_join(dates.withColumn("__k", zero), one_a_date(facts, fact_at, values).withColumn("__k", zero), ["__k"], at, fact_at, values, max_days, strict, None).drop("__k")


def calendar_asof(panel: DataFrame, facts: DataFrame, at: str, fact_at: str, values: list[str], max_days: int | None = None, strict: bool = False) -> DataFrame:
    """As-of on the distinct dates of panel, joined back by date."""
    return panel.join(F.broadcast(dates_asof(panel.select(at).distinct(), facts, at, fact_at, values, max_days, strict)), at, "left")


def sessions_after(facts: DataFrame, sessions: DataFrame, fact_at: str, lag: int = 1) -> DataFrame:
    """facts with available_at: the lag-th session strictly after fact_at, null past the end.

    sessions(date, session) is a calendar. One running minimum over the union finds the next session."""
    w = Window.orderBy("__d", "__side").rowsBetween(1, Window.unboundedFollowing)
    dates = facts.select(F.col(fact_at).alias("__d")).distinct().withColumn("__side", F.lit(1)).withColumn("session", F.lit(None).cast("int"))
    both = dates.unionByName(sessions.select(F.col("date").alias("__d"), F.lit(0).alias("__side"), "session"))
    following = both.withColumn("__next", F.min("session").over(w)).where("__side = 1").select("__d", (F.col("__next") + (lag - 1)).alias("__n"))
    named = following.join(sessions.select(F.col("session").alias("__n"), F.col("date").alias("available_at")), "__n", "left").select(F.col("__d").alias(fact_at), "available_at")
    return facts.join(F.broadcast(named), fact_at, "left")


#: Levels of the interval index: ranges of 1, 2, 4 ... days, up to all days that a date can have; and the last of these days.
LEVELS, LAST_DAY = 23, 2_932_896


def _day(x: Column) -> Column:
    return F.unix_date(x.cast("date")).cast("long")


def _indexed(intervals: DataFrame, start: str, end: str) -> DataFrame:
    """intervals with __level and __i: the ranges of 2**level days, aligned, that make up an interval's days, two a level at most."""
    lo, hi = _day(F.col(start)), F.coalesce(_day(F.col(end)), F.lit(LAST_DAY))
    ranges = []
    for level in range(LEVELS):
        first, last = F.shiftright(lo + ((1 << level) - 1), level), F.shiftright(hi + 1, level) - 1
        of = lambda i, level=level: F.struct(F.lit(level).alias("level"), i.alias("i"))
        ranges.append(F.when((first <= last) & (first % 2 != 0), of(first)))
        ranges.append(F.when((first <= last) & (last % 2 == 0), of(last)))
    kept = F.array_distinct(F.filter(F.array(*ranges), lambda x: x.isNotNull()))
    return intervals.where(F.col(start).isNotNull()).withColumn("__e", F.explode(kept)).select(*intervals.columns, F.col("__e.level").alias("__level"), F.col("__e.i").alias("__i"))


def interval_join(left: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: list[str], published: str | None = None, how: str = "inner") -> DataFrame:
    """Rows of left with the intervals [start, end) of their key that hold their date and were published by then.

    An open end holds for ever, an interval without a start for no date. An interval is cut into aligned ranges of a power of two of days, two of
    each length at most, and a date lies in one range of each length, so the join is on key, length and range: equal values
    whatever the key, with by empty too, and however long intervals overlap. Unless left is small only lengths that occur are looked
    up. A left join
    finds the intervals of each distinct key and date first."""
    indexed = _indexed(intervals, start, end)
    levels = list(range(LEVELS)) if small_input(left) else sorted(r[0] for r in indexed.select("__level").distinct().collect())
    right = indexed.select(*(F.col(c).alias(f"__{c}") if c in by else F.col(c) for c in indexed.columns))
    ranges = F.array(*(F.struct(F.lit(level).alias("level"), F.shiftright(_day(F.col(at)), level).alias("i")) for level in levels)) if levels else F.array().cast("array<struct<level:int,i:bigint>>")

    def met(rows: DataFrame) -> DataFrame:
        on: Column = (F.col("__p.level") == F.col("__level")) & (F.col("__p.i") == F.col("__i"))
        on = on & (F.col(start) <= F.col(at)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))
        if published:
            on = on & (F.col(published) <= F.col(at))
        for c in by:
            on = on & (F.col(c) == F.col(f"__{c}"))
        return rows.withColumn("__p", F.explode(ranges)).join(right, on).drop("__p", "__level", "__i", *(f"__{c}" for c in by))

    if how == "inner":
        return met(left)
    return left.join(met(left.select(*by, at).distinct()), [*by, at], how).select(*left.columns, *(c for c in intervals.columns if c not in by))


def latest_eligible(sessions: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """For each session and key the last record that was public: revisions only strictly before the session.

    records has effective_from, effective_to, published_at, revised and record_id; sessions has distinct
    dates. A record becomes a row for each day on which it holds and is public, and these meet the sessions by
    date: no more rows than days in force, and no comparison of every record with every session."""
    first = F.greatest("effective_from", F.when(F.col("revised"), F.date_add("published_at", 1)).otherwise(F.col("published_at")))
    last = F.date_sub("effective_to", 1)
    days = records.where(first <= last).withColumn("date", F.explode(F.sequence(first, last)))
    found = days.join(sessions.select("date"), "date")
    w = Window.partitionBy("date", *by).orderBy(F.desc("effective_from"), F.desc("published_at"), F.desc("record_id"))
    return found.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def only_match(left: DataFrame, intervals: DataFrame, key: list[str], at: str, start: str, end: str, by: list[str], value: str) -> DataFrame:
    """value where exactly one interval holds the date, else null."""
    found = interval_join(left, intervals, at, start, end, by, how="left")
    return found.groupBy(*key).agg(F.when(F.count(value) == 1, F.max(value)).alias(value), F.count(value).alias("n_matches"))


def first_event(left: DataFrame, events: DataFrame, by: list[str], at: str, event_at: str, value: str) -> DataFrame:
    """left with the first event at or before its date: value and event_at.

    First events are one row for each key, so the join is on the key alone."""
    first = events.groupBy(*by).agg(F.min(F.struct(event_at, value)).alias("__e"))
    return left.join(first, by, "left").withColumns({value: F.when(F.col(f"__e.{event_at}") <= F.col(at), F.col(f"__e.{value}")), event_at: F.when(F.col(f"__e.{event_at}") <= F.col(at), F.col(f"__e.{event_at}"))}).drop("__e")


def replace_join(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join in which the columns of right replace those of left with the same names."""
    return left.drop(*(c for c in right.columns if c not in on)).join(right, on, "left")


def many_to_one(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """Left join that fails at run time when right repeats a key."""
    counted = right.withColumn("__n", F.count("*").over(Window.partitionBy(*on)))
    checked = counted.where(F.when(F.col("__n") > 1, F.raise_error(F.concat(F.lit("repeated key: "), F.to_json(F.struct(*on))))).otherwise(F.lit(None).cast("int")).isNull()).drop("__n")
    return left.join(checked, on, "left")
