"""Grids, set operations, ordered dedupe, pivots and top-k selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def first_values(df: DataFrame, keys: list[str], order: Column, values: list[str]) -> DataFrame:
    """For each key and column the first non-null value in the order: not always of one row."""
    return df.groupBy(*keys).agg(*(F.min_by(F.col(v), F.when(F.col(v).isNotNull(), order)).alias(v) for v in values))


def agreeing(df: DataFrame, keys: list[str], values: list[str], tolerance: float = 1e-9) -> DataFrame:
    """One row a key, and agrees: whether repeats of the key differ by tolerance at most."""
    same = reduce(lambda a, b: a & b, ((F.max(v) - F.min(v)) <= tolerance for v in values))
    return df.groupBy(*keys).agg(*(F.min(v).alias(v) for v in values), F.coalesce(same, F.lit(True)).alias("agrees"))


def densify(df: DataFrame, rows: str, columns: str, values: list[str]) -> DataFrame:
    """All pairs of the distinct rows and columns, two small dimensions, with zeros for what is missing."""
    grid = df.select(rows).distinct().crossJoin(df.select(columns).distinct())
    return grid.join(df, [rows, columns], "left").select(rows, columns, *(F.coalesce(v, F.lit(0)).alias(v) for v in values))


def completeness(df: DataFrame, dims: dict[str, DataFrame]) -> DataFrame:
    """Keys that are missing from the product of the dimensions, or not in it: key columns and problem."""
    keys = list(dims)
    expected = reduce(lambda a, b: a.crossJoin(b), (dims[k].select(k).distinct() for k in keys))
    present = df.select(*keys).distinct()
    return expected.join(present, keys, "left_anti").withColumn("problem", F.lit("missing")).unionByName(present.join(expected, keys, "left_anti").withColumn("problem", F.lit("unexpected")))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old without the keys that new has, and new."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def top_per_group(df: DataFrame, keys: list[str], order: list, n: int) -> DataFrame:
    """The first n rows of each key, with rank. Spark limits groups before the exchange."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def nearest_peak(df: DataFrame, size: str, value: str, share: float = 0.95) -> DataFrame:
    """The smallest size whose value is at least share of the greatest value."""
    peak = df.agg(F.max(value).alias("__peak"))
    return df.join(F.broadcast(peak), F.col(value) >= share * F.col("__peak")).agg(F.min(size).alias(size))


def ranked_candidates(scores: DataFrame, key: str) -> DataFrame:
    """rank of each candidate by six keys in turn: score, worst fold and drawdown falling, turnover, budget and
    name rising. Candidates are a preregistered few."""
    order = [F.desc("primary_score"), F.desc("worst_fold_score"), F.desc("median_excess_max_drawdown"), "median_turnover", "timestep_budget", key]
    return scores.withColumn("rank", F.row_number().over(Window.orderBy(*order)).cast("long"))


def selected(ranked: DataFrame, key: str, fallback: str) -> DataFrame:
    """ranked with selected: the first candidate where its primary score is positive, else the fallback."""
    best = ranked.where("rank = 1").select(F.when(F.col("primary_score") > 0, F.col(key)).otherwise(fallback).alias("selected"))
    return ranked.crossJoin(F.broadcast(best))


def membership_steps(members: DataFrame, at: str, key: str) -> DataFrame:
    """at, key and change (added, removed): what each record has more and less than the one before; the first has everything more.

    Records are numbered, a dimension. A key's own records are few, so one exchange by key tells where it comes and goes; a record
    of any number of keys is never held together."""
    numbers = members.select(at).distinct().withColumns({"__r": F.row_number().over(Window.orderBy(at)), "__next": F.lead(at).over(Window.orderBy(at))})
    rows = members.where(F.col(key).isNotNull()).select(at, key).distinct().join(F.broadcast(numbers), at)
    w = Window.partitionBy(key).orderBy("__r")
    x = rows.withColumns({"__new": F.coalesce(F.lag("__r").over(w) != F.col("__r") - 1, F.lit(True)), "__gone": F.col("__next").isNotNull() & F.coalesce(F.lead("__r").over(w) != F.col("__r") + 1, F.lit(True))})
    step = lambda when, flag, name: x.where(flag).select(F.col(when).alias(at), key, F.lit(name).alias("change"))
    return step(at, "__new", "added").unionByName(step("__next", "__gone", "removed"))


def membership_counts(members: DataFrame, at: str, key: str) -> DataFrame:
    """at, members, added and removed: how many keys each record has, and how many more and less than the one before."""
    sizes = members.groupBy(at).agg(F.count_distinct(key).alias("members"))
    steps = membership_steps(members, at, key).groupBy(at).agg(F.count_if(F.col("change") == "added").alias("added"), F.count_if(F.col("change") == "removed").alias("removed"))
    return sizes.join(steps, at, "left").select(at, "members", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("added", "removed")))


def membership_changes(members: DataFrame, at: str, key: str) -> DataFrame:
    """Added and removed keys of each record against the one before, sorted and joined by commas: lists of what changes, not of records."""
    listed = lambda name: F.array_join(F.array_sort(F.collect_list(F.when(F.col("change") == name, F.col(key)))), ",").alias(name)
    changes = membership_steps(members, at, key).groupBy(at).agg(listed("added"), listed("removed"))
    return members.select(at).distinct().join(changes, at, "left").select(at, *(F.coalesce(c, F.lit("")).alias(c) for c in ("added", "removed")))


#: Sampled rows for each range of positions(), about.
SAMPLED = 50


def positions(df: DataFrame, order: list[Column], name: str = "place", ranges: int | None = None) -> DataFrame:
    """df with the place of each row, from 1, in a total order of ascending columns; no task sorts it all.

    Bounds from a sample cut the order into ranges; a row's range is a comparison with these, so it does not
    change when a task is run again. Places are counted inside each range, after the rows of those before it."""
    spark = df.sparkSession
    n = ranges or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    key = F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)))
    rows = df.count()
    share = min(1.0, n * SAMPLED / max(rows, 1))
    sample = df.select(key.alias("__o")).sample(fraction=share, seed=1) if share < 1 else df.select(key.alias("__o"))
    ordered = sample.withColumn("__i", F.row_number().over(Window.orderBy("__o"))).withColumn("__n", F.count("*").over(Window.partitionBy()))
    step = F.ceil(F.col("__n") / n)
    bounds = [r[0] for r in ordered.where((F.col("__i") % step == 0) & (F.col("__i") < F.col("__n"))).orderBy("__o").select("__o").collect()]
    types = sample.schema["__o"].dataType

    def range_of(lo: int, hi: int) -> Column:
        """The number of bounds before a row, by halving."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = F.struct(*(F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(bounds[mid], types.fields, strict=True)))
        return F.when(F.col("__o") <= bound, range_of(lo, mid)).otherwise(range_of(mid + 1, hi))

    dealt = df.withColumn("__o", key).withColumn("__r", range_of(0, len(bounds)))
    before = dealt.groupBy("__r").agg(F.count("*").alias("__c")).withColumn("__before", F.coalesce(F.sum("__c").over(Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__c")
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__o"))
    return dealt.withColumn("__p", inside).join(F.broadcast(before), "__r").select(*df.columns, (F.col("__p") + F.col("__before")).cast("long").alias(name))


#: Buckets of one pass of group_percentiles().
BUCKETS = 4096


def group_percentiles(df: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Exact interpolated percentiles of each group, by name, where groups are few and of any size.

    A first pass counts the values of a group in equal steps between its least and its greatest, a partial sum
    in each task. The running counts tell which steps hold the wanted ranks, and only the values of these steps
    are counted one by one. Null values are left out; a group without values is no row."""
    same = lambda names: reduce(lambda a, b: a & b, (F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in names))
    left = lambda *more: [*(F.col(f"l.{k}") for k in keys), *more]
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("__x"))
    ends = rows.groupBy(*keys).agg(F.min("__x").alias("__lo"), F.max("__x").alias("__hi"), F.count("*").alias("__n"))
    share = F.try_divide(F.col("__x") - F.col("__lo"), F.col("__hi") - F.col("__lo"))
    step = F.least(F.floor(F.coalesce(share, F.lit(0.0)) * BUCKETS), F.lit(BUCKETS - 1)).cast("int")
    stepped = rows.alias("l").join(F.broadcast(ends).alias("r"), same(keys)).select(*left("__x", "__n", step.alias("__s")))
    run = lambda *by: Window.partitionBy(*keys, *by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, 0)
    steps = stepped.groupBy(*keys, "__s", "__n").agg(F.count("*").alias("__c")).withColumn("__from", F.sum("__c").over(run("__s")) - F.col("__c"))
    at = F.col("q.share") * (F.col("__n") - 1)
    asked = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(q).alias("share")) for n, q in shares.items()))).alias("q")
    ranks = steps.select("*", asked).select(*keys, "__s", "__c", "__from", "q.name", F.explode(F.array(F.struct(F.floor(at).alias("k"), F.lit(True).alias("low")), F.struct(F.ceil(at).alias("k"), F.lit(False).alias("low")))).alias("z"), (at - F.floor(at)).alias("__f"))
    wanted = ranks.where((F.col("z.k") >= F.col("__from")) & (F.col("z.k") < F.col("__from") + F.col("__c"))).select(*keys, "__s", "__from", "name", "z.k", "z.low", "__f")
    found = stepped.alias("l").join(F.broadcast(wanted.select(*keys, "__s", "__from").distinct()).alias("r"), same([*keys, "__s"])).select(*left("l.__s", "__x", "__from"))
    counted = found.groupBy(*keys, "__s", "__from", "__x").agg(F.count("*").alias("__m")).withColumn("__to", F.col("__from") + F.sum("__m").over(run("__s", "__x")))
    hit = counted.alias("l").join(F.broadcast(wanted.drop("__from")).alias("r"), same([*keys, "__s"]) & (F.col("r.k") >= F.col("__to") - F.col("__m")) & (F.col("r.k") < F.col("__to"))).select(*left("name", "low", "__f", "__x"))
    low, high = F.max(F.when(F.col("low"), F.col("__x"))), F.max(F.when(~F.col("low"), F.col("__x")))
    each = hit.groupBy(*keys, "name").agg((low + (high - low) * F.max("__f")).alias("__v"))
    return each.groupBy(*keys).agg(*(F.max(F.when(F.col("name") == n, F.col("__v"))).alias(n) for n in shares))
