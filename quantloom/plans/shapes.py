"""Predicates (B), aggregates (G), selections (S), sets and grids (T), scalar functions (F)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..functions import scalars as S
from ..operators import grid as G

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def T(spark, d, name):
    return A.table(spark, d, name)


@query("b01_date_range", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1997-01-01' AND DATE '1997-06-30'")
def date_range(spark, d):
    o = T(spark, d, "orders").where(F.col("o_orderdate").cast("date").between("1997-01-01", "1997-06-30"))
    return o.select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"))


@query("b02_is_in", "SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND CAST(o_orderdate AS DATE) IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 50)")
def is_in(spark, d):
    days = T(spark, d, "lineitem").where("l_quantity = 50").select(F.col("l_shipdate").cast("date").alias("day")).distinct()
    o = T(spark, d, "orders").where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).withColumn("day", F.col("o_orderdate").cast("date"))
    return o.join(days, "day", "left_semi").select("o_orderkey", "o_orderpriority")


@query("b03_numeric_coercion", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS none_of FROM events")
def coercion(spark, d):
    return T(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("none_of"))


@query("b04_fill", "SELECT event_id, round(coalesce(value / nullif(CAST(json_extract_string(props, '$.k') AS INT) % 4, 0), 0), 6) + 0.0 AS filled FROM events")
def fill(spark, d):
    return T(spark, d, "events").select("event_id", r6(F.coalesce(F.try_divide("value", F.pmod(F.get_json_object("props", "$.k").cast("int"), F.lit(4))), F.lit(0.0))).alias("filled"))


_RULES = [("fundamental_", "fundamental"), ("flow_", "flow"), ("sector_", "sector"), ("policy_", "policy"), ("macro_", "macro")]
_NAMES = "CASE event_id % 6 WHEN 0 THEN 'fundamental_' WHEN 1 THEN 'flow_' WHEN 2 THEN 'sector_' WHEN 3 THEN 'policy_' WHEN 4 THEN 'macro_' ELSE 'close_' END || event_type"
_GROUP = "CASE " + " ".join(f"WHEN starts_with(n, '{p}') THEN '{g}'" for p, g in _RULES) + " ELSE 'technical' END"


@query("b06_feature_group", f"SELECT {_GROUP} AS feature_group, count(*) AS n FROM (SELECT {_NAMES} AS n FROM events) GROUP BY 1")
def feature_groups(spark, d):
    heads = F.array(*(F.lit(p) for p, _ in _RULES), F.lit("close_"))
    names = T(spark, d, "events").select(F.concat(F.get(heads, F.pmod("event_id", F.lit(6)).cast("int")), "event_type").alias("n"))
    return names.groupBy(S.feature_group(F.col("n"), _RULES).alias("feature_group")).agg(F.count("*").alias("n"))


@query("b08_one_hot", "SELECT r_name, " + ", ".join(f"CAST(r_name = '{v}' AS DOUBLE) AS region_{v.lower().replace(' ', '_')}" for v in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")) + " FROM region")
def one_hot(spark, d):
    r = T(spark, d, "region")
    return r.select("r_name", *((F.col("r_name") == v).cast("double").alias(f"region_{v.lower().replace(' ', '_')}") for v in ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")))


@query("b09_boolean", "SELECT event_id, CASE lower(trim(t)) WHEN 'true' THEN true WHEN 'false' THEN false END AS flag, lower(trim(t)) NOT IN ('true', 'false') AS rejected FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN ' True' WHEN 1 THEN 'FALSE' ELSE 'yes' END AS t FROM events)")
def booleans(spark, d):
    t = T(spark, d, "events").select("event_id", F.get(F.array(F.lit(" True"), F.lit("FALSE"), F.lit("yes")), F.pmod("event_id", F.lit(3)).cast("int")).alias("t"))
    return t.select("event_id", S.strict_boolean(F.col("t")).alias("flag"), S.strict_boolean(F.col("t")).isNull().alias("rejected"))


@query("b10_valid_bar", f"WITH {A.EVENT_DAY} SELECT date, ticker, open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume >= 0 AS valid FROM bars")
def valid_bars(spark, d):
    return A.bars_event_day(spark, d).select("date", "ticker", S.valid_bar().alias("valid"))


@query("b11_first_alias", "SELECT c_custkey, coalesce(nullif(c_acctbal, round(c_acctbal)), c_custkey, 0)::DOUBLE AS value FROM customer")
def aliases(spark, d):
    c = T(spark, d, "customer").withColumns({"a": F.nullif(F.col("c_acctbal"), F.round("c_acctbal")), "b": F.col("c_custkey").cast("double")})
    return c.select("c_custkey", S.first_alias(["total_assets", "a", "b"], c.columns).alias("value"))


@query("b12_envelope", f"WITH {A.EVENT_DAY} SELECT date, ticker FROM (SELECT date, ticker, open * 1.2 AS open, high, low, close FROM bars) WHERE high < greatest(open, close, low) - 1e-8 OR low > least(open, close, high) + 1e-8")
def envelope(spark, d):
    return A.bars_event_day(spark, d).withColumn("open", F.col("open") * 1.2).where(S.outside_envelope()).select("date", "ticker")


@query("g01_grouped", "SELECT l_returnflag, l_linestatus, CAST(sum(l_quantity) AS BIGINT) AS sum_qty, round(avg(l_extendedprice), 4) AS mean_price, count(*) AS n, min(l_discount) AS least, max(l_tax) AS most, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2")
def grouped(spark, d):
    return T(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").cast("long").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price"), F.count("*").alias("n"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"), F.count_distinct("l_suppkey").alias("suppliers"))


@query("g02_mean_median_std", "SELECT c_mktsegment, round(avg(c_acctbal), 6) + 0.0 AS mean, round(median(c_acctbal), 6) + 0.0 AS median, round(stddev_samp(c_acctbal), 6) + 0.0 AS std FROM customer GROUP BY 1")
def mean_median_std(spark, d):
    c = T(spark, d, "customer")
    both = c.groupBy("c_mktsegment").agg(r6(F.avg("c_acctbal")).alias("mean"), r6(F.stddev_samp("c_acctbal")).alias("std"))
    return both.join(G.group_percentiles(c, ["c_mktsegment"], "c_acctbal", {"median": 0.5}), "c_mktsegment").withColumn("median", r6(F.col("median")))


@query("g03_count_if", "SELECT event_type, count(*) FILTER (value > 0.5) AS active, count(*) AS n FROM events GROUP BY 1")
def count_if(spark, d):
    return T(spark, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 0.5).alias("active"), F.count("*").alias("n"))


@query("g04_two_levels", f"WITH {A.NATION_MONTH}, a AS (SELECT sector, ticker, avg(close) AS m FROM bars GROUP BY 1, 2) SELECT sector, round(avg(m), 6) + 0.0 AS mean, round(median(m), 6) + 0.0 AS median, round(min(m), 6) + 0.0 AS worst, count(*) FILTER (m > 150000) AS wins FROM a GROUP BY 1")
def two_levels(spark, d):
    a = A.bars_nation_month(spark, d).groupBy("sector", "ticker").agg(F.avg("close").alias("m"))
    return a.groupBy("sector").agg(r6(F.avg("m")).alias("mean"), r6(F.median("m")).alias("median"), r6(F.min("m")).alias("worst"), F.count_if(F.col("m") > 150000).alias("wins"))


@query("g06_pivot_last", f"WITH {A.FUNDAMENTALS} SELECT ticker, " + ", ".join(f"arg_max(value, period_end) FILTER (metric = '{m}') AS {m}" for m in A.METRICS) + " FROM fund GROUP BY 1")
def pivot_last(spark, d):
    return A.fundamentals(spark, d).groupBy("ticker").pivot("metric", list(A.METRICS)).agg(F.max_by("value", "period_end"))


@query("g07_pivot_sum", "SELECT n_name, " + ", ".join(f"CAST(coalesce(count(*) FILTER (c_mktsegment = '{s}'), 0) AS BIGINT) AS {s.lower()}" for s in ("BUILDING", "MACHINERY", "FURNITURE")) + " FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def pivot_sum(spark, d):
    c = T(spark, d, "customer").join(F.broadcast(T(spark, d, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    wide = c.groupBy("n_name").pivot("c_mktsegment", ["BUILDING", "MACHINERY", "FURNITURE"]).agg(F.count("c_custkey"))
    return wide.select("n_name", *(F.coalesce(s, F.lit(0)).alias(s.lower()) for s in ("BUILDING", "MACHINERY", "FURNITURE")))


@query("g08_wide_returns", f"WITH {A.CURVES}, r AS (SELECT date, policy, value / lag(value) OVER (PARTITION BY policy ORDER BY date) - 1 AS r FROM curve) SELECT date, " + ", ".join(f"round(max(r) FILTER (policy = '{p}'), 6) + 0.0 AS {p.lower()}" for p in ("BUILDING", "MACHINERY")) + " FROM r GROUP BY 1 HAVING count(r) > 0")
def wide_returns(spark, d):
    c = A.curves(spark, d)
    r = c.withColumn("r", F.col("value") / F.lag("value").over(Window.partitionBy("policy").orderBy("date")) - 1)
    return r.groupBy("date").agg(*(r6(F.max(F.when(F.col("policy") == p, F.col("r")))).alias(p.lower()) for p in ("BUILDING", "MACHINERY")), F.count("r").alias("n")).where("n > 0").drop("n")


@query("g09_keep_last", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def keep_last(spark, d):
    return G.first_by(T(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("g10_agreeing", "SELECT l_partkey, min(l_tax) AS l_tax, max(l_tax) - min(l_tax) <= 0.05 AS agrees FROM lineitem GROUP BY 1")
def agreeing(spark, d):
    return G.agreeing(T(spark, d, "lineitem"), ["l_partkey"], ["l_tax"], 0.05)


@query("g11_flattened", "SELECT p_type, round(avg(p_retailprice), 6) + 0.0 AS p_retailprice_mean, round(stddev_samp(p_retailprice), 6) + 0.0 AS p_retailprice_std, count(p_retailprice) AS p_retailprice_count, round(avg(p_size), 6) + 0.0 AS p_size_mean, round(stddev_samp(p_size), 6) + 0.0 AS p_size_std, count(p_size) AS p_size_count FROM part GROUP BY 1")
def flattened(spark, d):
    aggs = [x for c in ("p_retailprice", "p_size") for x in (r6(F.avg(c)).alias(f"{c}_mean"), r6(F.stddev_samp(c)).alias(f"{c}_std"), F.count(c).alias(f"{c}_count"))]
    return T(spark, d, "part").groupBy("p_type").agg(*aggs)


@query("g12_quantile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 6) + 0.0 AS q05, round(quantile_cont(l_extendedprice, 0.95), 6) + 0.0 AS q95 FROM lineitem GROUP BY 1")
def quantiles(spark, d):
    q = G.group_percentiles(T(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q95": 0.95})
    return q.select("l_returnflag", r6(F.col("q05")).alias("q05"), r6(F.col("q95")).alias("q95"))


@query("g13_tail_mean", "WITH q AS (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.05) AS v FROM lineitem GROUP BY 1) SELECT l_returnflag, round(avg(l_extendedprice), 6) + 0.0 AS tail_mean FROM lineitem JOIN q USING (l_returnflag) WHERE l_extendedprice <= v GROUP BY 1")
def tail_mean(spark, d):
    x = T(spark, d, "lineitem")
    q = G.group_percentiles(x, ["l_returnflag"], "l_extendedprice", {"v": 0.05})
    return x.join(F.broadcast(q), "l_returnflag").where("l_extendedprice <= v").groupBy("l_returnflag").agg(r6(F.avg("l_extendedprice")).alias("tail_mean"))


@query("g14_product", f"WITH {A.NATION_MONTH}, r AS (SELECT ticker, 1 + (close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1) / 100 AS g FROM bars) SELECT ticker, round(exp(sum(ln(g))), 6) + 0.0 AS growth FROM r GROUP BY 1")
def product(spark, d):
    b = A.bars_nation_month(spark, d)
    g = b.select("ticker", (1 + (F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1) / 100).alias("g"))
    return g.groupBy("ticker").agg(r6(F.product("g")).alias("growth"))


@query("g15_covariance", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 4) + 0.0 AS covariance, round(var_pop(l_quantity), 6) + 0.0 AS variance, round(corr(l_quantity, l_extendedprice), 6) + 0.0 AS correlation, round(covar_pop(l_quantity, l_extendedprice) / var_pop(l_quantity), 6) + 0.0 AS beta FROM lineitem GROUP BY 1")
def covariance(spark, d):
    c, v = F.covar_pop("l_quantity", "l_extendedprice"), F.var_pop("l_quantity")
    return T(spark, d, "lineitem").groupBy("l_returnflag").agg((F.round(c, 4) + 0.0).alias("covariance"), r6(v).alias("variance"), r6(F.corr("l_quantity", "l_extendedprice")).alias("correlation"), r6(c / v).alias("beta"))


@query("g16_value_counts", "SELECT string_agg(event_type || ':' || n, ',' ORDER BY event_type) AS counts FROM (SELECT event_type, CAST(count(*) AS VARCHAR) AS n FROM events GROUP BY 1)")
def value_counts(spark, d):
    c = T(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    m = c.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("event_type", "n")))).alias("m"))
    return m.select(F.array_join(F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",").alias("counts"))


@query("g17_best_per_group", "SELECT c_nationkey, arg_max(c_name, c_acctbal) AS c_name, max(c_acctbal) AS c_acctbal FROM customer GROUP BY 1")
def best(spark, d):
    return G.first_values(T(spark, d, "customer"), ["c_nationkey"], -F.col("c_acctbal"), ["c_name", "c_acctbal"])


@query("g18_throughput", "SELECT l_linenumber, count(*) AS trials, round(median(l_extendedprice), 6) + 0.0 AS median, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem GROUP BY 1")
def throughput(spark, d):
    x = T(spark, d, "lineitem")
    both = x.groupBy("l_linenumber").agg(F.count("*").alias("trials"), F.min("l_extendedprice").alias("least"), F.max("l_extendedprice").alias("most"))
    return both.join(G.group_percentiles(x, ["l_linenumber"], "l_extendedprice", {"median": 0.5}), "l_linenumber").withColumn("median", r6(F.col("median")))


@query("g19_all_any", f"WITH {A.TYPE_WEEK} SELECT date, bool_and(volume > 100) AS all_traded, bool_or(volume > 500) AS any_heavy FROM bars GROUP BY 1")
def all_any(spark, d):
    return A.bars_type_week(spark, d).groupBy("date").agg(F.bool_and(F.col("volume") > 100).alias("all_traded"), F.bool_or(F.col("volume") > 500).alias("any_heavy"))


@query("g21_merge_first", "SELECT policy, v, source FROM (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY source) AS n FROM (SELECT c_mktsegment AS policy, count(*) AS v, 1 AS source FROM customer WHERE c_nationkey < 5 AND c_mktsegment <> 'BUILDING' GROUP BY 1 UNION ALL SELECT c_mktsegment, count(*), 2 FROM customer GROUP BY 1)) WHERE n = 1")
def merge_first(spark, d):
    c = T(spark, d, "customer")
    part = lambda x, n: x.groupBy(F.col("c_mktsegment").alias("policy")).agg(F.count("*").alias("v")).withColumn("source", F.lit(n))
    return G.first_by(part(c.where("c_nationkey < 5 and c_mktsegment != 'BUILDING'"), 1).unionByName(part(c, 2)), ["policy"], ["source"])


@query("s01_sorted", "SELECT s_suppkey, s_nationkey, s_acctbal, row_number() OVER (ORDER BY s_nationkey, s_acctbal DESC, s_suppkey) AS place FROM supplier")
def ordered(spark, d):
    s = G.positions(T(spark, d, "supplier"), [F.col("s_nationkey"), -F.col("s_acctbal"), F.col("s_suppkey")])
    return s.select("s_suppkey", "s_nationkey", "s_acctbal", "place")


@query("s02_top_per_group", "SELECT c_nationkey, c_custkey, c_acctbal, n AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS n FROM customer) WHERE n <= 3")
def top3(spark, d):
    return G.top_per_group(T(spark, d, "customer"), ["c_nationkey"], [F.desc("c_acctbal"), "c_custkey"], 3).select("c_nationkey", "c_custkey", "c_acctbal", F.col("rank").cast("long").alias("rank"))


@query("s03_top_forecasts", f"""WITH {A.NATION_MONTH}, r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS p FROM bars), n AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY p DESC, ticker DESC) AS k FROM r WHERE p > 0),
t AS (SELECT date, ticker, round(1.0::DOUBLE / count(*) OVER (PARTITION BY date), 6) + 0.0 AS weight FROM n WHERE k <= 5) SELECT * FROM t""")
def top_forecasts(spark, d):
    b = A.bars_nation_month(spark, d)
    p = b.withColumn("p", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).where("p > 0")
    top = G.top_per_group(p, ["date"], [F.desc("p"), F.desc("ticker")], 5)
    return top.select("date", "ticker", r6(1.0 / F.count("*").over(Window.partitionBy("date"))).alias("weight"))


_PEAK = "WITH m AS (SELECT l_linenumber AS n, median(l_extendedprice) AS v FROM lineitem GROUP BY 1)"


@query("s04_near_peak", f"{_PEAK} SELECT min(n) AS n FROM m WHERE v >= 0.95 * (SELECT max(v) FROM m)")
def near_peak(spark, d):
    m = G.group_percentiles(T(spark, d, "lineitem").withColumnRenamed("l_linenumber", "n"), ["n"], "l_extendedprice", {"v": 0.5})
    return G.nearest_peak(m, "n", "v")


_FOLD_SCORES = f"""WITH {A.NATION_MONTH}, r AS (SELECT date, ticker, sector, volume, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars),
f AS (SELECT ticker, CAST(year(date) AS INT) AS fold, sum(r) AS score, min(r) AS drawdown, avg(volume) AS turnover FROM r WHERE r IS NOT NULL GROUP BY 1, 2),
c AS (SELECT ticker, round(median(score), 2) + 0.0 AS primary_score, round(min(score), 2) + 0.0 AS worst_fold_score, round(median(drawdown), 2) + 0.0 AS median_excess_max_drawdown, round(median(turnover), 2) + 0.0 AS median_turnover, CAST(length(ticker) AS INT) AS timestep_budget FROM f GROUP BY 1)"""
_RANKED = "row_number() OVER (ORDER BY primary_score DESC, worst_fold_score DESC, median_excess_max_drawdown DESC, median_turnover, timestep_budget, ticker)"


def fold_scores(spark, d):
    """A candidate's figures by fold, of nations and years: their medians and the worst, rounded for ties."""
    b = A.bars_nation_month(spark, d)
    r = b.withColumn("r", F.col("close") / F.lag("close").over(Window.partitionBy("ticker").orderBy("date")) - 1).where("r is not null")
    f = r.groupBy("ticker", F.year("date").alias("fold")).agg(F.sum("r").alias("score"), F.min("r").alias("drawdown"), F.avg("volume").alias("turnover"))
    r2 = lambda x: F.round(x, 2) + F.lit(0.0)
    return f.groupBy("ticker").agg(r2(F.median("score")).alias("primary_score"), r2(F.min("score")).alias("worst_fold_score"), r2(F.median("drawdown")).alias("median_excess_max_drawdown"), r2(F.median("turnover")).alias("median_turnover")).withColumn("timestep_budget", F.length("ticker"))


@query("s07_ranking", f"{_FOLD_SCORES}, k AS (SELECT *, {_RANKED} AS rank FROM c) SELECT ticker, primary_score, rank, CASE WHEN (SELECT primary_score FROM k WHERE rank = 1) > 0 THEN (SELECT ticker FROM k WHERE rank = 1) ELSE 'active_equal_weight' END AS selected FROM k")
def ranking(spark, d):
    """Six keys in turn; the first candidate is selected if its score is positive, else the plain baseline."""
    return G.selected(G.ranked_candidates(fold_scores(spark, d), "ticker"), "ticker", "active_equal_weight").select("ticker", "primary_score", "rank", "selected")


@query("s07_no_candidate", f"{_FOLD_SCORES}, n AS (SELECT ticker, primary_score - 100 AS primary_score, worst_fold_score, median_excess_max_drawdown, median_turnover, timestep_budget FROM c) SELECT ticker, {_RANKED} AS rank, 'active_equal_weight' AS selected FROM n")
def no_candidate(spark, d):
    """No score is positive: the fallback."""
    f = fold_scores(spark, d).withColumn("primary_score", F.col("primary_score") - 100)
    return G.selected(G.ranked_candidates(f, "ticker"), "ticker", "active_equal_weight").select("ticker", "rank", "selected")


@query("s08_latest_steps", "SELECT event_id, day FROM (SELECT event_id, CAST(ts AS DATE) AS day, dense_rank() OVER (ORDER BY CAST(ts AS DATE) DESC) AS n FROM events) WHERE n <= 2")
def latest_steps(spark, d):
    """The last two days are found on distinct days; the events only join them."""
    e = T(spark, d, "events").select("event_id", F.col("ts").cast("date").alias("day"))
    return e.join(F.broadcast(e.select("day").distinct().orderBy(F.desc("day")).limit(2)), "day").select("event_id", "day")


@query("s09_strided", "SELECT p_partkey, CAST(p_partkey % 7 AS BIGINT) AS task FROM part WHERE p_partkey % 7 IN (2, 5)")
def strided(spark, d):
    return T(spark, d, "part").select("p_partkey", F.pmod("p_partkey", F.lit(7)).alias("task")).where("task in (2, 5)")


@query("t01_union", "SELECT 'customer' AS side, c_nationkey AS nation, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal, NULL FROM supplier")
def union(spark, d):
    c = T(spark, d, "customer").select(F.lit("customer").alias("side"), F.col("c_nationkey").alias("nation"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    s = T(spark, d, "supplier").select(F.lit("supplier").alias("side"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    return c.unionByName(s, allowMissingColumns=True)


@query("t02_difference", "SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 40")
def difference(spark, d):
    return T(spark, d, "part").select("p_partkey").subtract(T(spark, d, "lineitem").where("l_quantity > 40").select("l_partkey"))


@query("t03_intersection", "SELECT CAST(o_orderdate AS DATE) AS day FROM orders INTERSECT SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_quantity = 1")
def intersection(spark, d):
    return T(spark, d, "orders").select(F.col("o_orderdate").cast("date").alias("day")).intersect(T(spark, d, "lineitem").where("l_quantity = 1").select(F.col("l_shipdate").cast("date")))


@query("t04_key_equality", "SELECT (SELECT count(*) FROM (SELECT o_orderkey FROM orders EXCEPT SELECT l_orderkey FROM lineitem)) = 0 AND (SELECT count(*) FROM (SELECT l_orderkey FROM lineitem EXCEPT SELECT o_orderkey FROM orders)) = 0 AS equal")
def key_equality(spark, d):
    o, x = T(spark, d, "orders").select(F.col("o_orderkey").alias("k")), T(spark, d, "lineitem").select(F.col("l_orderkey").alias("k")).distinct()
    odd = o.join(x, "k", "left_anti").unionByName(x.join(o, "k", "left_anti"))
    return odd.agg((F.count("*") == 0).alias("equal"))


@query("t05_completeness", f"WITH {A.NATION_MONTH}, p AS (SELECT DISTINCT date, ticker FROM bars WHERE volume > 4), e AS (SELECT * FROM (SELECT DISTINCT date FROM bars) CROSS JOIN (SELECT n_name AS ticker FROM nation WHERE n_nationkey < 24)) SELECT *, 'missing' AS problem FROM (SELECT * FROM e EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'unexpected' FROM (SELECT * FROM p EXCEPT SELECT * FROM e)")
def complete(spark, d):
    b = A.bars_nation_month(spark, d)
    return G.completeness(b.where("volume > 4"), {"date": b, "ticker": T(spark, d, "nation").where("n_nationkey < 24").select(F.col("n_name").alias("ticker"))})


@query("t06_densify", f"WITH {A.NATION_MONTH} SELECT s.date, t.ticker, coalesce(volume, 0) AS volume FROM (SELECT DISTINCT date FROM bars) s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.date = s.date AND b.ticker = t.ticker")
def dense(spark, d):
    return G.densify(A.bars_nation_month(spark, d).select("date", "ticker", "volume"), "date", "ticker", ["volume"])


@query("t07_month_grid", f"WITH {A.NATION_MONTH}, s AS (SELECT ticker, min(date) AS a, max(date) AS b FROM bars WHERE volume > 5 GROUP BY 1), g AS (SELECT ticker, CAST(unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 MONTH)) AS DATE) AS date FROM s) SELECT ticker, date FROM g EXCEPT SELECT ticker, date FROM bars WHERE volume > 5")
def month_grid(spark, d):
    b = A.bars_nation_month(spark, d).where("volume > 5")
    g = b.groupBy("ticker").agg(F.min("date").alias("a"), F.max("date").alias("b")).select("ticker", F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("date"))
    return g.join(b.select("ticker", "date"), ["ticker", "date"], "left_anti")


@query("t08_collapse", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderstatus = 'P'")
def collapse(spark, d):
    o = T(spark, d, "orders").select("o_orderstatus", "o_orderpriority")
    return o.where("o_orderstatus = 'F'").distinct().unionByName(o.where("o_orderstatus = 'P'"))


@query("t09_membership_changes", f"WITH {A.MEMBERSHIP}, p AS (SELECT effective_from + INTERVAL 1 YEAR AS d, ticker FROM members), y AS (SELECT DISTINCT effective_from FROM members) SELECT y.effective_from, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM members m WHERE m.effective_from = y.effective_from AND NOT EXISTS (SELECT 1 FROM p WHERE p.d = y.effective_from AND p.ticker = m.ticker)), '') AS added, coalesce((SELECT string_agg(ticker, ',' ORDER BY ticker) FROM p WHERE p.d = y.effective_from AND NOT EXISTS (SELECT 1 FROM members m WHERE m.effective_from = y.effective_from AND m.ticker = p.ticker)), '') AS removed FROM y")
def membership_changes(spark, d):
    return G.membership_changes(A.membership(spark, d), "effective_from", "ticker")


@query("t10_universe", f"WITH {A.MEMBERSHIP} SELECT DISTINCT ticker FROM members")
def universe(spark, d):
    return A.membership(spark, d).select("ticker").distinct()


@query("f01_slug", "SELECT p_partkey, trim(regexp_replace(lower(trim(p_type || ' (' || p_brand || ')')), '[^a-z0-9]+', '_', 'g'), '_') AS slug FROM part")
def slugs(spark, d):
    return T(spark, d, "part").select("p_partkey", S.slug(F.concat("p_type", F.lit(" ("), "p_brand", F.lit(")"))).alias("slug"))


@query("f02_ticker", "SELECT n_nationkey, CASE WHEN t LIKE '%.BK' THEN t ELSE t || '.BK' END AS ticker, regexp_full_match(CASE WHEN t LIKE '%.BK' THEN t ELSE t || '.BK' END, '[A-Z0-9&.-]+\\.BK') AS valid FROM (SELECT n_nationkey, upper(trim(CASE WHEN n_nationkey % 2 = 0 THEN n_name || '.bk' ELSE ' ' || n_name END)) AS t FROM nation)")
def tickers(spark, d):
    n = T(spark, d, "nation").withColumn("t", S.ticker(F.when(F.pmod("n_nationkey", F.lit(2)) == 0, F.concat("n_name", F.lit(".bk"))).otherwise(F.concat(F.lit(" "), "n_name")), ".BK"))
    return n.select("n_nationkey", F.col("t").alias("ticker"), F.col("t").rlike("^[A-Z0-9&.-]+\\.BK$").alias("valid"))


@query("f04_seed_suffix", "SELECT regexp_replace(n, '_seed([0-9]+)$', '') AS variant, CAST(regexp_extract(n, '_seed([0-9]+)$', 1) AS INT) AS seed, count(*) AS k FROM (SELECT lower(c_mktsegment) || '_seed' || CAST(c_custkey % 3 AS VARCHAR) AS n FROM customer) GROUP BY 1, 2")
def seeds(spark, d):
    n = T(spark, d, "customer").select(F.concat(F.lower("c_mktsegment"), F.lit("_seed"), F.pmod("c_custkey", F.lit(3)).cast("string")).alias("n"))
    return n.groupBy(F.regexp_replace("n", "_seed([0-9]+)$", "").alias("variant"), F.regexp_extract("n", "_seed([0-9]+)$", 1).cast("int").alias("seed")).agg(F.count("*").alias("k"))


@query("f05_parse_number", "SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE CAST(floor(o_totalprice) AS DOUBLE) END AS value FROM orders")
def numbers(spark, d):
    text = F.when(F.pmod("o_orderkey", F.lit(5)) == 0, F.lit("n.a.")).otherwise(F.format_number(F.floor("o_totalprice"), 0))
    return T(spark, d, "orders").select("o_orderkey", S.parse_number(text).alias("value"))


@query("f06_alias_map", "SELECT event_id, CASE event_type WHEN 'click' THEN 'retail' WHEN 'view' THEN 'foreign' ELSE 'other' END AS investor FROM events")
def alias_map(spark, d):
    m = F.create_map(F.lit("click"), F.lit("retail"), F.lit("view"), F.lit("foreign"))
    return T(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit("other")).alias("investor"))


@query("f08_codepoint_sentiment", "SELECT doc_id, (coalesce(list_sum(list_transform(string_split(text, ''), lambda c: unicode(c))), 0) % 200 - 100) / 100.0::DOUBLE AS score FROM documents")
def sentiment(spark, d):
    return T(spark, d, "documents").select("doc_id", S.codepoint_sentiment(F.col("text")).alias("score"))


_F09 = """WITH t AS (SELECT event_id, event_id % 9 AS k, CAST(ts AS DATE) AS d FROM events),
s AS (SELECT event_id, d, k, CASE k WHEN 0 THEN 'Raise 25 bps' WHEN 1 THEN ' cut  50 BPS. ' WHEN 2 THEN 'Hold' WHEN 3 THEN 'hold at 2.50' WHEN 4 THEN 'Raise by 25 bps' WHEN 5 THEN 'raise 2.5 bps' WHEN 6 THEN 'HOLD.' WHEN 7 THEN NULL ELSE 'lower 25 bps' END AS decision,
  CASE k WHEN 0 THEN '6' WHEN 1 THEN '65/' WHEN 2 THEN '' WHEN 3 THEN '12' WHEN 4 THEN '7 ' WHEN 5 THEN 'n' WHEN 6 THEN '31/' WHEN 7 THEN NULL ELSE '0.' END AS votes,
  CASE k WHEN 0 THEN strftime(d, '%-d %B %Y') WHEN 1 THEN '1-' || strftime(d, '%-d %B %Y') WHEN 2 THEN CAST(d - DATE '1899-12-30' AS VARCHAR) || '.0' WHEN 3 THEN strftime(d, '%-d-%b-%Y') WHEN 4 THEN strftime(d, '%Y-%m-%d') WHEN 5 THEN '' ELSE strftime(d, '%d %b %Y') END AS announced FROM t),
c AS (SELECT *, rtrim(trim(regexp_replace(lower(coalesce(decision, '')), '\\s+', ' ', 'g')), '.') AS a, rtrim(trim(regexp_replace(coalesce(votes, ''), '\\s+', ' ', 'g')), '.') AS v FROM s)
SELECT event_id, CASE WHEN a = 'hold' THEN 0.0 WHEN regexp_full_match(a, 'raise [0-9]+ bps') THEN CAST(split_part(a, ' ', 2) AS DOUBLE) WHEN regexp_full_match(a, 'cut [0-9]+ bps') THEN -CAST(split_part(a, ' ', 2) AS DOUBLE) END AS change_bp,
  CASE WHEN regexp_full_match(v, '[0-9]([0-9]+/)?') THEN CAST(v[1] AS DOUBLE) END AS votes, CASE WHEN k IN (4, 5) THEN NULL ELSE d END AS announced FROM c"""


@query("f09_decisions", _F09)
def decisions(spark, d):
    """Texts that fit the whole form, and texts that do not: those are null."""
    k, day = F.pmod("event_id", F.lit(9)).cast("int"), F.col("ts").cast("date")
    pick = lambda *x: F.get(F.array(*(F.lit(v) if v is None or isinstance(v, str) else v for v in x)), k)
    t = T(spark, d, "events").select(
        "event_id", pick("Raise 25 bps", " cut  50 BPS. ", "Hold", "hold at 2.50", "Raise by 25 bps", "raise 2.5 bps", "HOLD.", None, "lower 25 bps").alias("decision"), pick("6", "65/", "", "12", "7 ", "n", "31/", None, "0.").alias("votes"),
        pick(F.date_format(day, "d MMMM yyyy"), F.concat(F.lit("1-"), F.date_format(day, "d MMMM yyyy")), F.concat(F.datediff(day, F.lit("1899-12-30").cast("date")).cast("string"), F.lit(".0")), F.date_format(day, "d-MMM-yyyy"), F.date_format(day, "yyyy-MM-dd"), "", *[F.date_format(day, "dd MMM yyyy")] * 3).alias("announced"),
    )
    return t.select("event_id", S.decision_points(F.col("decision")).alias("change_bp"), S.vote_count(F.col("votes")).alias("votes"), S.announcement_date(F.col("announced")).alias("announced"))


_F10 = """WITH t AS (SELECT event_id, CASE event_id % 10 WHEN 0 THEN strftime(ts, '%Y-%m-%d') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M') WHEN 2 THEN strftime(ts, '%Y/%m/%d ') WHEN 3 THEN strftime(ts, '%Y-%m') WHEN 4 THEN strftime(ts, '%Y/%m') WHEN 5 THEN strftime(ts, '%Y') WHEN 6 THEN strftime(ts, '%d/%m/%Y') WHEN 7 THEN strftime(ts, '%Y-02-30') WHEN 8 THEN '' ELSE 'soon' END AS t FROM events)
SELECT event_id, CAST(coalesce(try_strptime(substr(trim(t), 1, 10), '%Y-%m-%d'), try_strptime(substr(trim(t), 1, 10), '%Y/%m/%d'), try_strptime(substr(trim(t), 1, 7), '%Y-%m'), try_strptime(substr(trim(t), 1, 7), '%Y/%m'), try_strptime(substr(trim(t), 1, 4), '%Y')) AS DATE) AS day FROM t"""


@query("f10_parse_date", _F10)
def dates(spark, d):
    form = lambda f: F.date_format("ts", f)
    t = F.get(F.array(form("yyyy-MM-dd"), form("yyyy-MM-dd'T'HH:mm"), form("yyyy/MM/dd' '"), form("yyyy-MM"), form("yyyy/MM"), form("yyyy"), form("dd/MM/yyyy"), form("yyyy-'02-30'"), F.lit(""), F.lit("soon")), F.pmod("event_id", F.lit(10)).cast("int"))
    return T(spark, d, "events").select("event_id", S.parse_date(t).alias("day"))


@query("f11_month_label", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period, o_orderkey % 2 = 0 AS preliminary FROM orders")
def month_labels(spark, d):
    label = F.concat(F.upper(F.date_format("o_orderdate", "MMM yyyy")), F.when(F.pmod("o_orderkey", F.lit(2)) == 0, " p").otherwise(""))
    o = T(spark, d, "orders").select("o_orderkey", label.alias("label"))
    return o.select("o_orderkey", F.to_date(F.initcap(F.substring("label", 1, 8)), "MMM yyyy").alias("period"), F.endswith("label", F.lit(" p")).alias("preliminary"))


_LBD = "CAST(e - INTERVAL 1 DAY * greatest(isodow(e) - 5, 0) AS DATE)"


@query("f12_last_business_day", f"SELECT o_orderkey, {_LBD} AS release_date FROM (SELECT o_orderkey, last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS e FROM orders)")
def business_day(spark, d):
    return T(spark, d, "orders").select("o_orderkey", S.last_business_day(F.col("o_orderdate").cast("date")).alias("release_date"))


@query("f13_business_calendar", "SELECT CAST(x AS DATE) AS day FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-12-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6")
def calendar(spark, d):
    days = spark.sql("select explode(sequence(date'2024-01-01', date'2024-12-31')) as day")
    return days.where(F.weekday("day") < 5)


@query("f14_age", "SELECT o_orderkey, CAST(DATE '2002-01-01' - CAST(o_orderdate AS DATE) AS BIGINT) AS days, round((DATE '2002-01-01' - CAST(o_orderdate AS DATE)) / 365.25::DOUBLE, 6) + 0.0 AS years FROM orders")
def ages(spark, d):
    n = F.datediff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date"))
    return T(spark, d, "orders").select("o_orderkey", n.cast("long").alias("days"), r6(n / 365.25).alias("years"))


@query("f15_session_date", "SELECT event_id, CAST(ts + INTERVAL 7 HOUR AS DATE) AS session FROM events")
def session_date(spark, d):
    return T(spark, d, "events").select("event_id", F.from_utc_timestamp(F.col("ts").cast("timestamp"), "Asia/Bangkok").cast("date").alias("session"))


_TIER = "CASE WHEN v < 0 THEN NULL WHEN v <= 5e6 THEN 0.00157 WHEN v <= 1e7 THEN 0.00137 WHEN v <= 2e7 THEN 0.00117 ELSE 0.00107 END::DOUBLE"


@query("f16_commission", f"SELECT c_custkey, {_TIER} AS rate, round(({_TIER} + 0.00005::DOUBLE + 0.00001::DOUBLE + 0.00001::DOUBLE) * 1.07::DOUBLE, 7) AS side_cost FROM (SELECT c_custkey, c_acctbal * 3000 AS v FROM customer)")
def commission(spark, d):
    v = F.col("c_acctbal") * 3000
    return T(spark, d, "customer").select("c_custkey", S.commission_rate(v).alias("rate"), S.side_cost(v).alias("side_cost"))


@query("f27_cost_settings", f"SELECT c_mktsegment, round(({_TIER} + 0.00007::DOUBLE) * 1.07::DOUBLE, 7) AS transaction_cost, 0.0005::DOUBLE AS slippage FROM (SELECT c_mktsegment, CAST(count(*) AS DOUBLE) * 100000 AS v FROM customer GROUP BY 1)")
def cost_settings(spark, d):
    """Settings of an environment from a day's traded value, here a value for each segment."""
    v = T(spark, d, "customer").groupBy("c_mktsegment").agg((F.count("*").cast("double") * 100000).alias("v"))
    return v.select("c_mktsegment", S.side_cost(F.col("v")).alias("transaction_cost"), F.lit(0.0005).alias("slippage"))


@query("f17_budget", f"WITH {A.EVENT_DAY}, w AS (SELECT date, ticker, close - 0.3 AS w FROM bars), s AS (SELECT *, sum(greatest(w, 0)) OVER (PARTITION BY date) AS t FROM w) SELECT date, ticker, round(CASE WHEN t > 1 THEN greatest(w, 0) / t ELSE greatest(w, 0) END, 6) + 0.0 AS weight FROM s")
def budgets(spark, d):
    b = A.bars_event_day(spark, d).withColumn("w", F.col("close") - 0.3)
    return b.select("date", "ticker", r6(S.budget(F.col("w"), F.sum(F.greatest("w", F.lit(0.0))).over(Window.partitionBy("date")))).alias("weight"))


@query("f18_softmax", f"WITH {A.NATION_MONTH}, x AS (SELECT date, ticker, close / 100000 AS z, greatest(max(close / 100000) OVER (PARTITION BY date), 0) AS m FROM bars) SELECT date, ticker, round(exp(z - m) / (exp(0 - m) + sum(exp(z - m)) OVER (PARTITION BY date)), 6) + 0.0 AS weight FROM x")
def softmax(spark, d):
    w = Window.partitionBy("date")
    x = A.bars_nation_month(spark, d).withColumn("z", F.col("close") / 100000).withColumn("m", F.greatest(F.max("z").over(w), F.lit(0.0)))
    e = F.exp(F.col("z") - F.col("m"))
    return x.select("date", "ticker", r6(e / (F.exp(-F.col("m")) + F.sum(e).over(w))).alias("weight"))


@query("f19_log_reconcile", f"WITH {A.CURVES} SELECT policy, abs(exp(sum(l)) - arg_max(value, date) / arg_min(value, date)) < 1e-9 AS reconciles FROM (SELECT policy, date, value, coalesce(ln(value / lag(value) OVER (PARTITION BY policy ORDER BY date)), 0) AS l FROM curve) GROUP BY 1")
def reconcile(spark, d):
    c = A.curves(spark, d)
    step = F.coalesce(F.log1p(F.col("value") / F.lag("value").over(Window.partitionBy("policy").orderBy("date")) - 1), F.lit(0.0))
    return c.withColumn("l", step).groupBy("policy").agg((F.abs(F.expm1(F.sum("l")) + 1 - F.max_by("value", "date") / F.min_by("value", "date")) < 1e-9).alias("reconciles"))


@query("f20_row_hash", "SELECT c_custkey, sha256('{\"c_custkey\":' || c_custkey || ',\"c_mktsegment\":\"' || c_mktsegment || '\"}') AS digest FROM customer")
def row_hash(spark, d):
    return T(spark, d, "customer").select("c_custkey", F.sha2(S.canonical_json("c_mktsegment", "c_custkey"), 256).alias("digest"))


@query("f24_scaled_ceiling", "SELECT s_suppkey, CAST(ceil(CAST(s_acctbal AS DECIMAL(18,2)) * CAST(1.25 AS DECIMAL(5,2))) AS BIGINT) AS projected, greatest(10000 - s_acctbal, 0) AS headroom FROM supplier")
def ceiling(spark, d):
    return T(spark, d, "supplier").select("s_suppkey", F.ceil(F.col("s_acctbal").cast("decimal(18,2)") * F.lit("1.25").cast("decimal(5,2)")).cast("long").alias("projected"), F.greatest(10000 - F.col("s_acctbal"), F.lit(0.0)).alias("headroom"))


@query("f26_release_rule", f"SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN d ELSE {_LBD} END AS release_date FROM (SELECT o_orderkey, o_orderpriority, CAST(o_orderdate AS DATE) AS d, last_day(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH) AS e FROM orders)")
def release_rule(spark, d):
    rule = F.when(F.col("o_orderpriority") == "1-URGENT", "same_day").otherwise("next_month")
    return T(spark, d, "orders").select("o_orderkey", S.release_date(F.col("o_orderdate").cast("date"), rule).alias("release_date"))


@query("f28_work_units", "SELECT c_custkey, CAST(t + CASE WHEN a IN ('ddpg', 'td3', 'sac') THEN greatest(t - 1000, 0) // 4 * 2 * 64 ELSE 0 END AS BIGINT) AS units FROM (SELECT c_custkey, c_custkey * 100 AS t, ['ppo', 'a2c', 'ddpg', 'td3', 'sac'][c_custkey % 5 + 1] AS a FROM customer)")
def work_units(spark, d):
    """Steps, and the updates of those algorithms that learn from a replay buffer."""
    a = F.get(F.array(*(F.lit(x) for x in ("ppo", "a2c", "ddpg", "td3", "sac"))), F.pmod("c_custkey", F.lit(5)).cast("int"))
    return T(spark, d, "customer").select("c_custkey", S.work_units(a, F.col("c_custkey") * 100, 1000, 4, 2, 64).alias("units"))


QUERIES = Q
