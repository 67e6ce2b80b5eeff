"""Chronological splits, folds and fold-bound scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(panel: DataFrame, at: str = "date") -> DataFrame:
    """Distinct dates with a number from 0; a small dimension."""
    return panel.select(at).distinct().withColumn("i", F.row_number().over(Window.orderBy(at)) - 1)


def chronological(panel: DataFrame, train: float = 0.6, validation: float = 0.2, at: str = "date") -> DataFrame:
    """panel with split by the place of its date among all dates; each split has a date at least where three exist."""
    dates = numbered(panel, at)
    sized = dates.crossJoin(F.broadcast(dates.agg(F.count("*").alias("n"))))
    a = F.least(F.greatest(F.floor(F.col("n") * train), F.lit(1)), F.greatest(F.col("n") - 2, F.lit(1)))
    b = F.least(F.greatest(F.floor(F.col("n") * (train + validation)), a + 1), F.greatest(F.col("n") - 1, F.lit(1)))
    named = sized.select(at, F.when(F.col("i") < a, "train").when(F.col("i") < b, "validation").otherwise("test").alias("split"))
    return panel.join(F.broadcast(named), at)


def walk_forward(panel: DataFrame, train: int, validation: int, test: int, step: int, expanding: bool = False, at: str = "date") -> DataFrame:
    """(window, split, date): rolling or expanding windows over the numbered dates, while a test fits."""
    dates = numbered(panel, at)
    n = dates.agg(F.count("*").alias("n"))
    length = train + validation + test
    starts = n.where(F.col("n") >= length).select(F.explode(F.sequence(F.lit(0), F.col("n") - length, F.lit(step))).alias("s")).withColumn("window", F.row_number().over(Window.orderBy("s")))
    first = F.lit(0) if expanding else F.col("s")
    at_train, at_validation = F.col("s") + train, F.col("s") + train + validation
    inside = dates.join(F.broadcast(starts), (F.col("i") >= first) & (F.col("i") < F.col("s") + length))
    return inside.select("window", F.when(F.col("i") < at_train, "train").when(F.col("i") < at_validation, "validation").otherwise("test").alias("split"), at)


def with_context(panel: DataFrame, start: str, sessions: int, at: str = "date") -> DataFrame:
    """Rows from start on and of so many sessions before it, marked as context."""
    dates = numbered(panel, at)
    first = dates.where(F.col(at) >= F.lit(start).cast("date")).agg(F.min("i").alias("__f"))
    kept = dates.crossJoin(F.broadcast(first)).where(F.col("i") >= F.col("__f") - sessions).select(at, (F.col("i") < F.col("__f")).alias("context"))
    return panel.join(F.broadcast(kept), at)


def half_year_folds(panel: DataFrame, folds: list[tuple[str, str]], at: str = "date") -> DataFrame:
    """(fold, date, role, next_date): an expanding train part before each test period, its last session unused.

    A decision at a date has its outcome at the next date; the boundary session before a test period
    would have its outcome in the test and is owned by neither."""
    dates = numbered(panel, at).withColumn("next_date", F.lead(at).over(Window.orderBy(at)))
    table = panel.sparkSession.createDataFrame([(k + 1, a, b) for k, (a, b) in enumerate(folds)], "fold int, a string, b string").select("fold", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    j = dates.join(F.broadcast(table), F.col(at) < F.col("b"))
    role = F.when(F.col(at) >= F.col("a"), "test").when(F.col("next_date") >= F.col("a"), "unused").otherwise("train")
    return j.select("fold", at, role.alias("role"), "next_date")


def scaler(rows: DataFrame, columns: list[str], where: Column) -> DataFrame:
    """One row: mean and population deviation of each column over the eligible train rows; no deviation counts as 1."""
    fit = rows.where(where)
    return fit.agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__scale"))))


def scaled(rows: DataFrame, state: DataFrame, columns: list[str]) -> DataFrame:
    """rows with the columns scaled by a fitted state of one row; nothing is fitted again."""
    return rows.crossJoin(F.broadcast(state)).withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in columns}).select(*rows.columns)


def grid(spark, **dims: list) -> DataFrame:
    """The product of small lists, in order, with a number from 0."""
    out = None
    for name, values in dims.items():
        one = spark.createDataFrame([(v,) for v in values], [name])
        out = one if out is None else out.crossJoin(one)
    return out.withColumn("cell", F.row_number().over(Window.orderBy(*dims)) - 1)


def execution_plan(spark, candidates: list[int], folds: list[int], seeds: list[int], folds_in_batch: int = 2) -> DataFrame:
    """candidate, fold, seed, batch and task of every cell; a batch has so many folds in a row."""
    g = grid(spark, candidate=candidates, fold=folds, seed=seeds).select(*(F.col(c).cast("long").alias(c) for c in ("candidate", "fold", "seed")))
    place = F.dense_rank().over(Window.orderBy("fold")) - 1
    g = g.withColumn("batch", F.format_string("array_batch_%02d", F.floor(place / folds_in_batch) + 1))
    return g.withColumn("task", F.row_number().over(Window.partitionBy("batch").orderBy("candidate", "fold", "seed")).cast("long") - 1)


def fold_schedule(panel: DataFrame, folds: list[tuple[str, str, str]], train_context: int, validation_context: int, at: str = "date") -> DataFrame:
    """Roles of every session in every fold up to the fold's last validation session.

    The first sessions are context; training decisions run to the last session but one before the validation, so
    that their outcomes lie before it; the transition from the last training session is nobody's; the last
    validation session is an outcome only."""
    dates = numbered(panel, at)
    table = panel.sparkSession.createDataFrame(folds, "fold string, a string, b string").select("fold", F.col("a").cast("date").alias("a"), F.col("b").cast("date").alias("b"))
    spans = dates.join(F.broadcast(table), (F.col(at) >= F.col("a")) & (F.col(at) < F.col("b"))).groupBy("fold").agg(F.min("i").alias("v0"), F.max("i").alias("v1"))
    x = dates.join(F.broadcast(spans), F.col("i") <= F.col("v1")).withColumn("next", F.lead(at).over(Window.partitionBy("fold").orderBy("i")))
    i, v0, v1 = F.col("i"), F.col("v0"), F.col("v1")
    train, validation = (i >= train_context) & (i < v0 - 1), (i >= v0) & (i < v1)
    return x.select(
        "fold", at, i.cast("long").alias("session_index"), (i < train_context).alias("train_context"), train.alias("train_decision"), ((i > train_context) & (i < v0)).alias("train_outcome"), ((i >= v0 - validation_context) & (i < v0)).alias("validation_context"),
        validation.alias("validation_decision"), (i > v0).alias("validation_outcome"), (i == v0 - 1).alias("unused_boundary"), F.when(train, "train").when(validation, "validation").otherwise("").alias("owner"), F.when(train | validation, F.col("next")).alias("outcome_date"),
    )


def fold_registry_checks(schedule: DataFrame, folds: int, least_train: int, least_validation: int, at: str = "date") -> DataFrame:
    """The folds of a schedule, summed up and checked: their number, order, sizes, and that training grows."""
    from . import quality as K

    day = lambda c: F.when(F.col(c), F.col(at))
    s = schedule.groupBy("fold").agg(F.count_if("train_decision").alias("t"), F.count_if("validation_decision").alias("v"), F.min(day("train_decision")).alias("t0"), F.max(day("train_decision")).alias("t1"), F.min(day("validation_decision")).alias("w0"), F.max(day("validation_decision")).alias("w1"), F.max(at).alias("w2"))
    s = s.withColumn("before", F.lag("t").over(Window.orderBy("fold")))
    rows = K.check_rows(s, {
        "train_before_validation": (F.col("t0") <= F.col("t1")) & (F.col("t1") < F.col("w0")), "validation_order": (F.col("w0") <= F.col("w1")) & (F.col("w1") < F.col("w2")), "enough_train": F.col("t") >= least_train, "enough_validation": F.col("v") >= least_validation, "expanding": F.col("before").isNull() | (F.col("t") > F.col("before")),
    })
    return rows.unionByName(K.count_check("folds", s.agg(F.count("*").alias("n")).where(F.col("n") != folds)))


def scaled_folds(panel: DataFrame, schedule: DataFrame, columns: list[str], eligible: str, at: str = "date") -> DataFrame:
    """The rows of each fold with role, scaled by mean and population deviation of its own eligible training rows."""
    rows = schedule.select("fold", at, F.when(F.col("owner") == "", "context").otherwise(F.col("owner")).alias("role")).join(panel, at)
    fit = rows.where((F.col("role") == "train") & F.col(eligible))
    state = fit.groupBy("fold").agg(*(x for c in columns for x in (F.avg(c).alias(f"{c}__mean"), F.coalesce(F.nullif(F.stddev_pop(c), F.lit(0.0)), F.lit(1.0)).alias(f"{c}__scale"))))
    return rows.join(F.broadcast(state), "fold").withColumns({c: (F.col(c) - F.col(f"{c}__mean")) / F.col(f"{c}__scale") for c in columns}).select(*rows.columns)


def stress_slices(panel: DataFrame, train: int, validation: int, test: int, step: int, at: str = "date") -> DataFrame:
    """slice, first_date, last_date and sessions: the test of each rolling window, and the chronological test."""
    windows = walk_forward(panel, train, validation, test, step, at=at).where("split = 'test'").select(F.concat(F.lit("window_"), F.col("window").cast("string")).alias("slice"), at)
    last = chronological(panel.select(at).distinct(), at=at).where("split = 'test'").select(F.lit("test").alias("slice"), at)
    return windows.unionByName(last).groupBy("slice").agg(F.min(at).alias("first_date"), F.max(at).alias("last_date"), F.count("*").alias("sessions"))
