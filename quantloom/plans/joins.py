"""Joins (C): as-of, interval, availability and validated joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..operators import asof as J
from ..operators import windows as W


def asof_fundamentals(spark, d):
    f = A.fundamentals(spark, d).where("metric = 'high'").select("ticker", F.date_add("period_end", 60).alias("effective"), "value")
    return J.asof_join(A.bars_nation_month(spark, d).select("date", "ticker"), f, ["ticker"], "date", "effective", ["value"]).withColumnRenamed("matched_at", "effective")


_FUND60 = A.FUNDAMENTALS + ", f AS (SELECT ticker, CAST(period_end + INTERVAL 60 DAY AS DATE) AS effective, value FROM fund WHERE metric = 'high')"
_ASOF = f"WITH {A.NATION_MONTH}, {_FUND60} SELECT b.date, b.ticker, f.value, f.effective FROM bars b ASOF LEFT JOIN f ON b.ticker = f.ticker AND b.date >= f.effective"


def asof_tolerance(spark, d):
    n = A.news(spark, d).where("length(text) > 1500").groupBy("ticker", F.col("date").alias("news_date")).agg(F.count("*").alias("news_count"))
    grid = A.news(spark, d).select("ticker").distinct().crossJoin(F.broadcast(spark.range(40).select(F.date_add(F.lit("2024-01-01").cast("date"), F.col("id").cast("int")).alias("date"))))
    out = J.asof_join(grid, n, ["ticker"], "date", "news_date", ["news_count"], max_days=7)
    return out.select("ticker", "date", F.coalesce("news_count", F.lit(0)).alias("news_count"), F.datediff("date", "matched_at").cast("long").alias("age_days"))


_TOL = f"""WITH {A.NEWS}, n AS (SELECT ticker, date AS nd, count(*) AS c FROM news WHERE length(text) > 1500 GROUP BY 1, 2),
g AS (SELECT ticker, CAST(DATE '2024-01-01' + CAST(i AS INT) AS DATE) AS date FROM (SELECT DISTINCT ticker FROM news), range(40) r(i)),
j AS (SELECT g.ticker, g.date, n.c, g.date - n.nd AS age FROM g ASOF LEFT JOIN n ON g.ticker = n.ticker AND g.date >= n.nd)
SELECT ticker, date, CASE WHEN age <= 7 THEN c ELSE 0 END AS news_count, CAST(CASE WHEN age <= 7 THEN age END AS BIGINT) AS age_days FROM j"""


def calendar_asof(spark, d):
    m = A.macro_daily(spark, d).where("name = '1-URGENT' and day(date) = 10").select(F.date_add("date", 20).alias("release_date"), F.col("close").alias("macro_value"))
    return J.calendar_asof(A.bars_type_week(spark, d).select("date", "ticker"), m, "date", "release_date", ["macro_value"]).select("date", "ticker", r6(F.coalesce("macro_value", F.lit(0.0))).alias("macro_value"), F.coalesce(F.datediff("date", "matched_at"), F.lit(-1)).cast("long").alias("age_days"))


_CAL = f"""WITH {A.TYPE_WEEK}, {A.MACRO_DAILY}, m AS (SELECT CAST(date + INTERVAL 20 DAY AS DATE) AS rd, close FROM macro WHERE name = '1-URGENT' AND day(date) = 10)
SELECT b.date, b.ticker, round(coalesce(m.close, 0.0), 6) + 0.0 AS macro_value, CAST(coalesce(b.date - m.rd, -1) AS BIGINT) AS age_days FROM bars b ASOF LEFT JOIN m ON b.date >= m.rd"""


def availability_shift(spark, d):
    bars = A.bars_event_day(spark, d).where("dayofweek(date) not in (1, 7)")
    sessions = J.calendar(bars)
    f = A.flows(spark, d).select("date", "investor_type", "buy_value").withColumnRenamed("date", "source_date")
    return J.sessions_after(f, sessions, "source_date", 1).select("source_date", "investor_type", "buy_value", "available_at")


_EVSESS = A.EVENT_DAY + ", sess AS (SELECT DISTINCT date FROM bars WHERE dayofweek(date) NOT IN (0, 6))"
_SHIFT = f"""WITH {_EVSESS}, {A.FLOWS} SELECT f.date AS source_date, investor_type, buy_value, (SELECT min(s.date) FROM sess s WHERE s.date > f.date) AS available_at FROM flow f"""


def strict_asof(spark, d):
    """Flows of weekdays reach a session strictly after their date, for 7 days at most."""
    f = A.flows(spark, d).where("investor_type = 'click' or investor_type = 'view'").groupBy("date").agg(r6(F.sum(F.col("buy_value") - F.col("sell_value"))).alias("net")).where("dayofweek(date) not in (1, 7)").withColumnRenamed("date", "flow_date")
    return J.dates_asof(A.bars_event_day(spark, d).select("date").distinct(), f, "date", "flow_date", ["net"], max_days=7, strict=True).select("date", "net", F.col("matched_at").alias("flow_date"))


_STRICT = f"""WITH {A.EVENT_DAY}, {A.FLOWS}, f AS (SELECT date AS fd, round(sum(buy_value - sell_value), 6) + 0.0 AS net FROM flow WHERE investor_type IN ('click', 'view') AND dayofweek(date) NOT IN (0, 6) GROUP BY 1),
j AS (SELECT s.date, f.net, f.fd FROM (SELECT DISTINCT date FROM bars) s ASOF LEFT JOIN f ON s.date > f.fd) SELECT date, CASE WHEN date - fd <= 7 THEN net END AS net, CASE WHEN date - fd <= 7 THEN fd END AS flow_date FROM j"""


def rate_history(spark, d):
    """Level, level a year ago, and last change other than a hold, of one dated history."""
    m = A.macro_daily(spark, d).where("name = '2-HIGH' and day(date) in (5, 20)").select(F.col("date").alias("announced"), F.round(F.col("close") / 1000).alias("rate"))
    h = m.withColumn("g", F.lit(0)).withColumn("change", F.coalesce(F.col("rate") - F.lag("rate").over(W.ordered("g", "announced")), F.lit(0.0))).drop("g")
    days = A.bars_type_week(spark, d).select("date").distinct()
    a = J.dates_asof(days, h, "date", "announced", ["rate"]).withColumnRenamed("matched_at", "level_at")
    b = J.dates_asof(a.withColumn("year_ago", F.date_sub("date", 365)), h.select("announced", F.col("rate").alias("rate_year_ago")), "year_ago", "announced", ["rate_year_ago"]).drop("matched_at")
    c = J.dates_asof(b, h.where("change != 0").select("announced", F.col("change").alias("last_change")), "date", "announced", ["last_change"])
    return c.select("date", "rate", "rate_year_ago", "last_change", F.datediff("date", "matched_at").cast("long").alias("days_since_change"))


_RATE = f"""WITH {A.TYPE_WEEK}, {A.MACRO_DAILY}, m AS (SELECT date AS a, round(close / 1000) AS rate FROM macro WHERE name = '2-HIGH' AND day(date) IN (5, 20)), h AS (SELECT *, coalesce(rate - lag(rate) OVER (ORDER BY a), 0.0) AS ch FROM m),
d0 AS (SELECT DISTINCT date FROM bars), c AS (SELECT * FROM h WHERE ch <> 0)
SELECT d0.date, h1.rate, h2.rate AS rate_year_ago, c.ch AS last_change, CAST(d0.date - c.a AS BIGINT) AS days_since_change FROM d0 ASOF LEFT JOIN h h1 ON d0.date >= h1.a ASOF LEFT JOIN h h2 ON CAST(d0.date - INTERVAL 365 DAY AS DATE) >= h2.a ASOF LEFT JOIN c ON d0.date >= c.a"""


def outer_chain(spark, d):
    m = A.macro_daily(spark, d)
    return m.groupBy("date").pivot("name", ["1-URGENT", "2-HIGH", "5-LOW"]).agg(F.max("close")).toDF("date", "urgent", "high", "low").where("urgent is not null or high is not null or low is not null")


_OUTER = f"""WITH {A.MACRO_DAILY} SELECT date, a.close AS urgent, b.close AS high, c.close AS low FROM (SELECT * FROM macro WHERE name = '1-URGENT') a FULL JOIN (SELECT * FROM macro WHERE name = '2-HIGH') b USING (date) FULL JOIN (SELECT * FROM macro WHERE name = '5-LOW') c USING (date)"""


def reindex_ffill(spark, d):
    m = A.macro_daily(spark, d).where("name = '3-MEDIUM'").select(F.col("date").alias("seen"), "close")
    days = A.bars_event_day(spark, d).select("date").distinct().unionByName(A.bars_type_week(spark, d).select("date").distinct())
    return J.dates_asof(days, m, "date", "seen", ["close"]).select("date", "close")


_REINDEX = f"""WITH {A.TYPE_WEEK}, {A.EVENT_DAY.replace('bars AS', 'eb AS')}, {A.MACRO_DAILY}, s AS (SELECT DISTINCT date FROM eb UNION ALL SELECT DISTINCT date FROM bars), m AS (SELECT * FROM macro WHERE name = '3-MEDIUM') SELECT s.date, m.close FROM s ASOF LEFT JOIN m ON s.date >= m.date"""


def interval_containment(spark, d):
    out = J.interval_join(A.bars_nation_month(spark, d).select("date", "ticker"), A.membership(spark, d), "date", "effective_from", "effective_to", ["ticker"], "published_at")
    return out.select("date", "ticker", "record_id", "effective_from", "published_at")


_INTERVAL = f"WITH {A.NATION_MONTH}, {A.MEMBERSHIP} SELECT b.date, b.ticker, record_id, effective_from, published_at FROM bars b JOIN members m ON b.ticker = m.ticker AND effective_from <= b.date AND b.date < effective_to AND published_at <= b.date"


def latest_record(spark, d):
    sessions = A.bars_nation_month(spark, d).select("date").distinct()
    return J.latest_eligible(sessions, A.membership(spark, d), ["ticker"]).select("date", "ticker", "record_id", "revised")


_LATEST = f"""WITH {A.NATION_MONTH}, {A.MEMBERSHIP}, j AS (SELECT s.date, m.*, row_number() OVER (PARTITION BY s.date, m.ticker ORDER BY effective_from DESC, published_at DESC, record_id DESC) AS n
  FROM (SELECT DISTINCT date FROM bars) s JOIN members m ON effective_from <= s.date AND s.date < effective_to AND CASE WHEN revised THEN published_at < s.date ELSE published_at <= s.date END) SELECT date, ticker, record_id, revised FROM j WHERE n = 1"""


def grid_cross(spark, d):
    b = A.bars_nation_month(spark, d)
    slots = b.select("ticker").distinct()
    grid = b.select("date").distinct().crossJoin(F.broadcast(slots))
    return grid.join(b.select("date", "ticker", "close"), ["date", "ticker"], "left").select("date", "ticker", F.coalesce("close", F.lit(0.0)).alias("close"), F.col("close").isNotNull().alias("present"))


_GRID = f"WITH {A.NATION_MONTH} SELECT s.date, t.ticker, coalesce(close, 0.0) AS close, close IS NOT NULL AS present FROM (SELECT DISTINCT date FROM bars) s CROSS JOIN (SELECT DISTINCT ticker FROM bars) t LEFT JOIN bars b ON b.date = s.date AND b.ticker = t.ticker"


def semi_join(spark, d):
    p = A.table(spark, d, "part")
    return p.join(A.table(spark, d, "lineitem").where("l_discount > 0.09").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_semi").select("p_partkey", "p_brand")


def paired(spark, d):
    """Candidate and baseline curves by month, with their difference."""
    c = A.curves(spark, d)
    base = c.where("policy = 'BUILDING'").select("date", F.col("value").alias("baseline"))
    return c.where("policy != 'BUILDING'").join(base, "date").select("date", "policy", "value", "baseline", r6(F.col("value") - F.col("baseline")).alias("excess"))


_PAIRED = f"WITH {A.CURVES} SELECT c.date, c.policy, c.value, b.value AS baseline, round(c.value - b.value, 6) + 0.0 AS excess FROM curve c JOIN curve b ON c.date = b.date AND b.policy = 'BUILDING' WHERE c.policy <> 'BUILDING'"


def positional(spark, d):
    c = A.curves(spark, d)
    w = Window.partitionBy("policy").orderBy("date")
    n = c.withColumn("i", F.row_number().over(w))
    return n.where("policy = 'MACHINERY'").select("i", F.col("value").alias("a")).join(n.where("policy = 'FURNITURE'").select("i", F.col("value").alias("b")), "i").select(F.col("i").cast("long").alias("i"), "a", "b")


_POS = f"WITH {A.CURVES}, n AS (SELECT *, row_number() OVER (PARTITION BY policy ORDER BY date) AS i FROM curve) SELECT x.i, x.value AS a, y.value AS b FROM n x JOIN n y ON x.i = y.i AND y.policy = 'FURNITURE' WHERE x.policy = 'MACHINERY'"


def validated(spark, d):
    c = A.table(spark, d, "customer").select("c_custkey", "c_nationkey")
    n = A.table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    return J.many_to_one(c, n, ["c_nationkey"])


def replaced(spark, d):
    b = A.bars_nation_month(spark, d).withColumn("score", F.lit(0.5))
    new = b.groupBy("ticker").agg(r6(F.avg("close")).alias("score"))
    return J.replace_join(b.select("date", "ticker", "score"), new, ["ticker"])


_REPL = f"WITH {A.NATION_MONTH} SELECT date, ticker, score FROM bars JOIN (SELECT ticker, round(avg(close), 6) + 0.0 AS score FROM bars GROUP BY 1) USING (ticker)"


def first_action(spark, d):
    b = A.bars_nation_month(spark, d)
    events = b.where("close > 180000").select("ticker", F.col("date").alias("event_date"), F.concat(F.lit("v"), F.col("volume").cast("string")).alias("action"))
    return J.first_event(b.select("date", "ticker"), events, ["ticker"], "date", "event_date", "action").select("date", "ticker", "event_date", "action")


_FIRST = f"""WITH {A.NATION_MONTH}, e AS (SELECT ticker, min(date) AS event_date, 'v' || CAST(arg_min(volume, date) AS VARCHAR) AS action FROM bars WHERE close > 180000 GROUP BY 1)
SELECT b.date, b.ticker, CASE WHEN event_date <= b.date THEN event_date END AS event_date, CASE WHEN event_date <= b.date THEN action END AS action FROM bars b LEFT JOIN e USING (ticker)"""


def exactly_one(spark, d):
    m = A.membership(spark, d)
    both = m.select("ticker", "effective_from", "effective_to", "record_id").unionByName(m.where("revised").select("ticker", "effective_from", F.add_months("effective_from", 6).alias("effective_to"), F.concat("record_id", F.lit("b")).alias("record_id")))
    return J.only_match(A.bars_nation_month(spark, d).select("date", "ticker"), both, ["date", "ticker"], "date", "effective_from", "effective_to", ["ticker"], "record_id")


_ONE = f"""WITH {A.NATION_MONTH}, {A.MEMBERSHIP}, i AS (SELECT ticker, effective_from, effective_to, record_id FROM members UNION ALL SELECT ticker, effective_from, CAST(effective_from + INTERVAL 6 MONTH AS DATE), record_id || 'b' FROM members WHERE revised)
SELECT b.date, b.ticker, CASE WHEN count(i.record_id) = 1 THEN max(i.record_id) END AS record_id, count(i.record_id) AS n_matches FROM bars b LEFT JOIN i ON b.ticker = i.ticker AND effective_from <= b.date AND b.date < effective_to GROUP BY 1, 2"""


def session_lag(spark, d):
    sessions = J.calendar(A.bars_event_day(spark, d).where("dayofweek(date) not in (1, 7)"))
    days = A.flows(spark, d).select("date").distinct().withColumnRenamed("date", "source_date")
    return J.sessions_after(days, sessions, "source_date", 2)


_LAG = f"""WITH {_EVSESS}, {A.FLOWS}, n AS (SELECT date, row_number() OVER (ORDER BY date) AS i FROM sess), f AS (SELECT DISTINCT date FROM flow), x AS (SELECT f.date, (SELECT min(i) FROM n WHERE n.date > f.date) + 1 AS k FROM f)
SELECT x.date AS source_date, n.date AS available_at FROM x LEFT JOIN n ON n.i = x.k"""

QUERIES = {
    "c01_many_to_one": (validated, "SELECT c_custkey, c_nationkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey"),
    "c03_paired_inner": (paired, _PAIRED), "c05_outer_chain": (outer_chain, _OUTER), "c06_asof_by_key": (asof_fundamentals, _ASOF), "c07_asof_tolerance": (asof_tolerance, _TOL), "c08_calendar_asof": (calendar_asof, _CAL),
    "c09_availability_shift": (availability_shift, _SHIFT), "c09_strict_asof": (strict_asof, _STRICT), "c10_rate_history": (rate_history, _RATE), "c11_reindex_ffill": (reindex_ffill, _REINDEX),
    "c12_interval": (interval_containment, _INTERVAL), "c13_latest_eligible": (latest_record, _LATEST), "c14_grid": (grid_cross, _GRID),
    "c16_semi": (semi_join, "SELECT p_partkey, p_brand FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.09)"),
    "c18_positional": (positional, _POS), "c20_replace": (replaced, _REPL), "c21_first_action": (first_action, _FIRST), "c22_exactly_one": (exactly_one, _ONE), "c23_session_lag": (session_lag, _LAG),
}
