"""Panel views over the star-schema tables, each as a DataFrame and as the SQL of the same rows.

Every view is one scan and one partial-then-final aggregate; prices are rounded to six places so
that two engines go on from equal inputs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(x: Column) -> Column:
    """Six places, without a negative zero."""
    return F.round(x, 6) + F.lit(0.0)


def _start(unit: str, x: str) -> Column:
    return F.date_trunc(unit, F.col(x)).cast("date")


def bars_type_week(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars by part type: the main panel."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    bars = rows.groupBy(_start("week", "l_shipdate").alias("date"), F.col("p_type").alias("ticker")).agg(
        r6(F.avg(F.when(F.col("l_linenumber") == 1, price))).alias("o"), r6(F.max(price)).alias("high"), r6(F.min(price)).alias("low"), r6(F.avg(price)).alias("close"),
        F.sum("l_quantity").cast("long").alias("volume"),
    )
    return bars.select("date", "ticker", F.coalesce("o", "close").alias("open"), "high", "low", "close", "volume")


TYPE_WEEK = """bars AS (
  SELECT date, ticker, coalesce(o, close) AS open, high, low, close, volume FROM (
    SELECT CAST(date_trunc('week', l_shipdate) AS DATE) AS date, p_type AS ticker,
      round(avg(CASE WHEN l_linenumber = 1 THEN l_extendedprice / l_quantity END), 6) + 0.0 AS o, round(max(l_extendedprice / l_quantity), 6) + 0.0 AS high,
      round(min(l_extendedprice / l_quantity), 6) + 0.0 AS low, round(avg(l_extendedprice / l_quantity), 6) + 0.0 AS close, CAST(sum(l_quantity) AS BIGINT) AS volume
    FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2))"""


def bars_nation_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly bars by nation, with the region as the sector."""
    rows = (
        table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(F.broadcast(table(spark, sf_dir, "region")), F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return rows.groupBy(_start("month", "o_orderdate").alias("date"), F.col("n_name").alias("ticker"), F.col("r_name").alias("sector")).agg(
        r6(F.avg("o_totalprice")).alias("close"), F.count("*").alias("volume")
    )


NATION_MONTH = """bars AS (
  SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_name AS ticker, r_name AS sector, round(avg(o_totalprice), 6) + 0.0 AS close, count(*) AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3)"""


def bars_event_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by event type."""
    rows = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("ticker"))
    key = F.struct("ts", "event_id")
    return rows.agg(r6(F.min_by("value", key)).alias("open"), r6(F.max("value")).alias("high"), r6(F.min("value")).alias("low"), r6(F.max_by("value", key)).alias("close"), F.count("*").alias("volume"))


EVENT_DAY = """bars AS (
  SELECT date, ticker, max(value) FILTER (a = 1) AS open, max(value) AS high, min(value) AS low, max(value) FILTER (z = 1) AS close, count(*) AS volume FROM (
    SELECT CAST(ts AS DATE) AS date, event_type AS ticker, round(value, 6) + 0.0 AS value,
      row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts, event_id) AS a, row_number() OVER (PARTITION BY CAST(ts AS DATE), event_type ORDER BY ts DESC, event_id DESC) AS z
    FROM events) GROUP BY 1, 2)"""


def macro_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily series by order priority."""
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("name")).agg(r6(F.avg("o_totalprice")).alias("close"))


MACRO_DAILY = """macro AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS name, round(avg(o_totalprice), 6) + 0.0 AS close FROM orders GROUP BY 1, 2)"""


def fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quarterly statement values by nation and order priority, as entity-attribute-value rows."""
    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    end = F.date_sub(F.add_months(_start("quarter", "o_orderdate"), 3), 1)
    metric = F.regexp_replace(F.lower("o_orderpriority"), "[^a-z]+", "")
    return rows.groupBy(F.col("n_name").alias("ticker"), metric.alias("metric"), end.alias("period_end")).agg(F.round(F.sum("o_totalprice"), 2).alias("value"))


FUNDAMENTALS = """fund AS (
  SELECT n_name AS ticker, regexp_replace(lower(o_orderpriority), '[^a-z]+', '', 'g') AS metric,
    CAST(date_trunc('quarter', o_orderdate) + INTERVAL 3 MONTH - INTERVAL 1 DAY AS DATE) AS period_end, round(sum(o_totalprice), 2) AS value
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2, 3)"""
METRICS = ("urgent", "high", "medium", "notspecified", "low")


def flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily buy and sell values of investor groups, from event types and the parity of props.k."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = table(spark, sf_dir, "events").groupBy(F.col("ts").cast("date").alias("date"), F.col("event_type").alias("investor_type"))
    value = lambda p: F.round(F.coalesce(F.sum(F.when(F.pmod(k, F.lit(2)) == p, F.abs("value"))), F.lit(0.0)), 4)
    return rows.agg(value(0).alias("buy_value"), value(1).alias("sell_value"))


FLOWS = """flow AS (
  SELECT CAST(ts AS DATE) AS date, event_type AS investor_type,
    round(coalesce(sum(abs(value)) FILTER (CAST(json_extract_string(props, '$.k') AS INT) % 2 = 0), 0.0), 4) AS buy_value,
    round(coalesce(sum(abs(value)) FILTER (CAST(json_extract_string(props, '$.k') AS INT) % 2 = 1), 0.0), 4) AS sell_value
  FROM events GROUP BY 1, 2)"""


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """News items: documents with their source as ticker, dated by doc_id."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("ticker"), F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("doc_id", F.lit(30)).cast("int")).alias("date"), "doc_id", "text")


NEWS = """news AS (SELECT source AS ticker, CAST(DATE '2024-01-01' + CAST(doc_id % 30 AS INT) AS DATE) AS date, doc_id, text FROM documents)"""


def membership(spark: SparkSession, sf_dir: str, members: int = 10) -> DataFrame:
    """Yearly membership records: the nations with the most revenue in the year before.

    Records of even years are published on 20 December before they start, those of odd years are revisions of 5 January."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    revenue = rows.groupBy((F.year("o_orderdate") + 1).alias("y"), F.col("n_name").alias("ticker")).agg(F.round(F.sum("o_totalprice"), 2).alias("v"))
    top = revenue.withColumn("n", F.row_number().over(Window.partitionBy("y").orderBy(F.desc("v"), "ticker"))).where(F.col("n") <= members)
    odd = F.pmod("y", F.lit(2)) == 1
    return top.select(
        F.make_date("y", F.lit(1), F.lit(1)).alias("effective_from"), F.make_date(F.col("y") + 1, F.lit(1), F.lit(1)).alias("effective_to"),
        F.when(odd, F.make_date("y", F.lit(1), F.lit(5))).otherwise(F.make_date(F.col("y") - 1, F.lit(12), F.lit(20))).alias("published_at"),
        odd.alias("revised"), "ticker", F.concat(F.col("y").cast("string"), F.lit("-"), F.col("ticker")).alias("record_id"),
    )


MEMBERSHIP = """members AS (
  SELECT make_date(y, 1, 1) AS effective_from, make_date(y + 1, 1, 1) AS effective_to, CASE WHEN y % 2 = 1 THEN make_date(y, 1, 5) ELSE make_date(y - 1, 12, 20) END AS published_at,
    y % 2 = 1 AS revised, ticker, CAST(y AS VARCHAR) || '-' || ticker AS record_id
  FROM (SELECT *, row_number() OVER (PARTITION BY y ORDER BY v DESC, ticker) AS n FROM (
    SELECT CAST(year(o_orderdate) + 1 AS INT) AS y, n_name AS ticker, round(sum(o_totalprice), 2) AS v
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2)) WHERE n <= 10)"""


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly equity curves: a policy for each market segment, value the product of damped returns."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    level = rows.groupBy(_start("month", "o_orderdate").alias("date"), F.col("c_mktsegment").alias("policy")).agg(r6(F.avg("o_totalprice")).alias("v"), F.count("*").alias("n"))
    w = Window.partitionBy("policy").orderBy("date")
    damped = level.withColumn("r", r6(F.coalesce((F.col("v") / F.lag("v").over(w) - 1) / 10, F.lit(0.0))))
    share = F.least(F.col("n") / 1000.0, F.lit(1.0))
    return damped.select("date", "policy", r6(100000 * F.exp(F.sum(F.log1p("r")).over(w))).alias("value"), r6(share).alias("turnover"), r6(share * 10).alias("cost"), r6(share * 4).alias("slippage"), r6(F.lit(1.0) - share).alias("cash_weight"))


CURVES = """curve AS (
  SELECT date, policy, round(100000 * exp(sum(ln(1 + r)) OVER (PARTITION BY policy ORDER BY date)), 6) + 0.0 AS value, round(least(n / 1000.0, 1.0), 6) + 0.0 AS turnover,
    round(least(n / 1000.0, 1.0) * 10, 6) + 0.0 AS cost, round(least(n / 1000.0, 1.0) * 4, 6) + 0.0 AS slippage, round(1.0 - least(n / 1000.0, 1.0), 6) + 0.0 AS cash_weight FROM (
    SELECT *, round(coalesce((v / lag(v) OVER (PARTITION BY policy ORDER BY date) - 1) / 10, 0.0), 6) + 0.0 AS r FROM (
      SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, c_mktsegment AS policy, round(avg(o_totalprice), 6) + 0.0 AS v, CAST(count(*) AS DOUBLE) AS n
      FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)))"""


def portable(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Rows of a SQL text that both engines read alike; tables are named in braces."""
    names = set(re.findall(r"\{(\w+)\}", sql))
    return spark.sql(sql, **{n: table(spark, sf_dir, n) for n in names})


def bare(sql: str) -> str:
    """The text of portable() for the other engine."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)
