"""Ingestion (A), quality contracts (Q), control-plane tables (X) and streaming bars."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..functions import scalars as S
from ..operators import asof as J
from ..operators import grid as G
from ..operators import quality as K
from ..operators import splits as L
from ..operators import windows as W
from ..sources import ingest as N
from ..streaming.bars import tick_bars

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def T(spark, d, name):
    return A.table(spark, d, name)


@query("a04_trials", "SELECT c_custkey AS trial_id, c_acctbal::DOUBLE AS metric_sharpe, CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment END AS param_kind FROM customer")
def trials(spark, d):
    c = T(spark, d, "customer")
    raw = c.select(F.col("c_custkey").alias("trial_id"), F.to_json(F.create_map(F.lit("sharpe"), F.col("c_acctbal"))).alias("metrics"), F.to_json(F.when(F.pmod("c_custkey", F.lit(2)) == 0, F.create_map(F.lit("kind"), F.col("c_mktsegment"))).otherwise(F.create_map(F.lit("x"), F.lit("1")))).alias("params"))
    return N.flatten_trials(raw, ["sharpe"], ["kind"])


@query("a05_path_part", "SELECT c_custkey, lower(c_mktsegment) AS feature_group FROM customer")
def path_parts(spark, d):
    c = T(spark, d, "customer").select("c_custkey", F.concat(F.lit("/out/"), F.lower("c_mktsegment"), F.lit("/window_1/metrics.csv")).alias("p"))
    return c.select("c_custkey", N.path_part(F.col("p"), 3).alias("feature_group"))


@query("a08_upsert", "SELECT n_nationkey, n_name, 'old' AS v FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT n_nationkey, lower(n_name), 'new' FROM nation WHERE n_regionkey = 2")
def upserted(spark, d):
    n = T(spark, d, "nation")
    return G.upsert(n.select("n_nationkey", "n_name", F.lit("old").alias("v")), n.where("n_regionkey = 2").select("n_nationkey", F.lower("n_name").alias("n_name"), F.lit("new").alias("v")), "n_nationkey")


@query("a09_bars", f"WITH {A.EVENT_DAY}, x AS (SELECT date, ticker, open * 1.1 AS o, high AS h, low AS l, close AS c, volume FROM bars WHERE volume % 9 <> 0) SELECT date, ticker, round(o, 6) + 0.0 AS open, round(greatest(o, h, c), 6) + 0.0 AS high, round(least(o, l, c), 6) + 0.0 AS low, c AS close, volume, greatest(o, h, c) - h > 1e-10 OR l - least(o, l, c) > 1e-10 AS ohlc_repaired FROM x")
def bars(spark, d):
    b = A.bars_event_day(spark, d)
    raw = b.select("date", F.col("ticker").alias("Symbol"), (F.col("open") * 1.1).alias("Open"), F.when(F.pmod("volume", F.lit(9)) != 0, F.col("high")).alias("High"), F.col("low").alias("Low"), F.col("close").alias("Close"), F.col("volume").cast("string").alias("Volume"))
    out = N.normal_bars(raw, {"Symbol": "ticker", "Open": "open", "High": "high", "Low": "low", "Close": "close", "Volume": "volume"})
    return out.withColumns({c: r6(F.col(c)) for c in ("open", "high", "low")})


@query("a10_market_return", f"WITH {A.TYPE_WEEK}, r AS (SELECT date, ticker, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r FROM bars) SELECT date, ticker, round(coalesce(avg(r) OVER (PARTITION BY date), 0), 6) + 0.0 AS market_return_1d FROM r")
def market_return(spark, d):
    b = A.bars_type_week(spark, d)
    r = b.select("date", "ticker", (F.col("close") / F.lag("close").over(W.ordered()) - 1).alias("r"))
    return r.select("date", "ticker", r6(F.coalesce(F.avg("r").over(Window.partitionBy("date")), F.lit(0.0))).alias("market_return_1d"))


@query("a11_statements", "SELECT s_suppkey, 'income' AS statement_type, 's_acctbal' AS metric, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'income', 's_nationkey', s_nationkey::DOUBLE FROM supplier")
def statements(spark, d):
    return N.statements_long(T(spark, d, "supplier").select("s_suppkey", "s_acctbal", "s_nationkey", "s_name"), ["s_suppkey"], "income")


@query("a12_tagged_union", "SELECT c_acctbal AS balance, 'customer' AS side FROM customer UNION ALL SELECT s_acctbal, 'supplier' FROM supplier")
def tagged(spark, d):
    return N.tagged_union({"customer": T(spark, d, "customer").select(F.col("c_acctbal").alias("balance")), "supplier": T(spark, d, "supplier").select(F.col("s_acctbal").alias("balance"))}, "side")


@query("a13_news", "SELECT DISTINCT user_id AS ticker, CAST(date_trunc('second', ts) AS TIMESTAMP) AS published_at, event_type AS title, CASE WHEN event_type = 'click' THEN event_type ELSE event_type || '. more' END AS text FROM events QUALIFY row_number() OVER (PARTITION BY user_id, date_trunc('second', ts), event_type ORDER BY event_id) = 1")
def news(spark, d):
    e = T(spark, d, "events")
    summary = F.when(F.col("event_type") != "click", F.lit("more"))
    nested = F.to_json(F.struct(F.struct(F.date_format(F.date_trunc("second", "ts"), "yyyy-MM-dd HH:mm:ss").alias("pubDate"), F.col("event_type").alias("title"), summary.alias("summary")).alias("content")))
    flat = F.to_json(F.struct(F.unix_timestamp(F.col("ts").cast("timestamp")).alias("providerPublishTime"), F.col("event_type").alias("title"), summary.alias("summary")))
    raw = e.select(F.col("user_id").alias("ticker"), F.when(F.pmod("event_id", F.lit(4)) == 0, nested).otherwise(flat).alias("item"))
    return N.normal_news(raw).select("ticker", F.col("published_at").cast("timestamp_ntz").alias("published_at"), "title", "text")


@query("a16_flows", f"WITH {A.FLOWS} SELECT date, CASE investor_type WHEN 'click' THEN 'retail' ELSE 'foreign' END AS investor_type, floor(buy_value) AS buy_value, CASE WHEN day(date) % 5 = 0 THEN NULL ELSE floor(sell_value) END AS sell_value, floor(buy_value) - coalesce(CASE WHEN day(date) % 5 = 0 THEN NULL ELSE floor(sell_value) END, 0) AS net_value FROM flow WHERE investor_type IN ('click', 'view')")
def flows(spark, d):
    f = A.flows(spark, d)
    name = F.when(F.col("investor_type") == "click", "  Local   Individuals ").when(F.col("investor_type") == "view", "Foreign Investors").otherwise(F.col("investor_type"))
    raw = f.select("date", name.alias("investor"), F.format_number(F.floor("buy_value"), 0).alias("buy"), F.when(F.dayofmonth("date") % 5 == 0, "-").otherwise(F.format_number(F.floor("sell_value"), 0)).alias("sell"))
    return N.normal_flows(raw, {"local individuals": "retail", "foreign investors": "foreign"})


@query("a17_release_dates", f"WITH {A.MACRO_DAILY}, m AS (SELECT name, CAST(date_trunc('month', date) AS DATE) AS period, round(avg(close) + 1e-9, 4) + 0.0 AS value FROM macro GROUP BY 1, 2), e AS (SELECT *, last_day(period + INTERVAL 1 MONTH) AS e FROM m) SELECT trim(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '_') AS metric, period, CAST(e - INTERVAL 1 DAY * greatest(isodow(e) - 5, 0) AS DATE) AS release_date, value FROM e")
def releases(spark, d):
    m = A.macro_daily(spark, d).groupBy("name", F.date_trunc("month", "date").cast("date").alias("period")).agg((F.round(F.avg("close") + 1e-9, 4) + 0.0).alias("value"))
    return m.select(S.slug(F.col("name")).alias("metric"), "period", S.last_business_day(F.col("period")).alias("release_date"), "value")


@query("a21_dissent", f"WITH {A.FLOWS}, v AS (SELECT date, max(CAST(floor(buy_value) AS BIGINT)) AS most, sum(CAST(floor(buy_value) AS BIGINT)) AS total FROM flow GROUP BY 1) SELECT date, round(CASE WHEN total > 0 THEN 1 - most / total::DOUBLE END, 6) + 0.0 AS dissent_share FROM v")
def dissent(spark, d):
    v = A.flows(spark, d).groupBy("date").agg(F.max(F.floor("buy_value")).alias("most"), F.sum(F.floor("buy_value")).alias("total"))
    return v.select("date", r6(1 - F.try_divide("most", "total")).alias("dissent_share"))


@query("a22_membership_counts", f"WITH {A.MEMBERSHIP} SELECT ticker, min(effective_from) AS first_seen, max(effective_to) AS last_seen, count(*) AS records, count(DISTINCT revised) AS kinds FROM members GROUP BY 1")
def archive(spark, d):
    return A.membership(spark, d).groupBy("ticker").agg(F.min("effective_from").alias("first_seen"), F.max("effective_to").alias("last_seen"), F.count("*").alias("records"), F.count_distinct("revised").alias("kinds"))


@query("a23_universe", "SELECT upper(trim(p_brand)) AS p_brand, min(p_partkey) AS p_partkey FROM part GROUP BY 1")
def universe(spark, d):
    return N.ordered_universe(T(spark, d, "part").select("p_partkey", F.concat(F.lit(" "), F.lower("p_brand")).alias("p_brand")), "p_partkey", "p_brand")


@query("a24_probe", "SELECT n_regionkey, arg_min(n_name, n_nationkey) AS candidate FROM nation JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) ON n_nationkey = c_nationkey WHERE k >= 60 GROUP BY 1")
def probe(spark, d):
    k = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("k"))
    c = T(spark, d, "nation").join(k, "n_nationkey").withColumnRenamed("n_name", "candidate")
    return N.first_with_history(c, 60, "n_regionkey", "n_nationkey", "k")


@query("a26_coverage", f"WITH {A.TYPE_WEEK} SELECT ticker, CASE WHEN date < DATE '2000-01-01' THEN 'development' ELSE 'holdout' END AS part, count(*) AS sessions, count(*) FILTER (volume < 100) AS thin, min(date) AS first_date FROM bars WHERE close > 0 GROUP BY 1, 2")
def history(spark, d):
    b = A.bars_type_week(spark, d).where("close > 0")
    return b.groupBy("ticker", F.when(F.col("date") < "2000-01-01", "development").otherwise("holdout").alias("part")).agg(F.count("*").alias("sessions"), F.count_if(F.col("volume") < 100).alias("thin"), F.min("date").alias("first_date"))


@query("a27_traded_dates", f"WITH {A.EVENT_DAY}, z AS (SELECT date, ticker, CASE WHEN day(date) % 7 = 0 THEN 0 ELSE volume END AS volume FROM bars) SELECT date, ticker, volume FROM z WHERE date NOT IN (SELECT date FROM z GROUP BY 1 HAVING bool_and(volume <= 0))")
def traded(spark, d):
    b = A.bars_event_day(spark, d).select("date", "ticker", F.when(F.dayofmonth("date") % 7 == 0, F.lit(0)).otherwise(F.col("volume")).cast("long").alias("volume"))
    return N.traded_dates(b)


def _checks(**tests: str) -> str:
    return " UNION ALL ".join(f"SELECT '{n}' AS \"check\", ({sql}) = 0 AS passed, CAST(({sql}) AS BIGINT) AS failures" for n, sql in tests.items())


@query("q03_coverage", f"WITH {A.NATION_MONTH} SELECT ticker, count(DISTINCT date) AS dates, min(date) AS first_date, max(date) AS last_date, (SELECT count(DISTINCT date) FROM bars) AS total, round(count(DISTINCT date) / (SELECT count(DISTINCT date) FROM bars)::DOUBLE, 6) + 0.0 AS coverage FROM bars GROUP BY 1")
def covered(spark, d):
    return K.coverage(A.bars_nation_month(spark, d)).withColumn("coverage", r6(F.col("coverage")))


@query("q04_missingness", "SELECT c AS \"column\", m AS missing, round(m / n::DOUBLE, 6) + 0.0 AS share FROM (SELECT count(*) AS n, count(*) FILTER (event_type = 'click') AS a, count(*) FILTER (value < 0) AS b FROM events), LATERAL (VALUES ('event_type', a), ('value', b)) v(c, m)")
def missing(spark, d):
    e = T(spark, d, "events").select(F.when(F.col("event_type") != "click", F.col("event_type")).alias("event_type"), F.when(F.col("value") >= 0, F.col("value")).alias("value"))
    return K.missingness(e).withColumn("share", r6(F.col("share")))


@query("q05_membership_size", f"WITH {A.MEMBERSHIP} SELECT effective_from, count(*) AS n, count(*) = 10 AS passed FROM members GROUP BY 1")
def membership_size(spark, d):
    return A.membership(spark, d).groupBy("effective_from").agg(F.count("*").alias("n"), (F.count("*") == 10).alias("passed"))


_BARS_BAD = f"WITH {A.EVENT_DAY} "


@query("q07_bar_checks", _BARS_BAD + _checks(positive_close="SELECT count(*) FROM bars WHERE NOT close > 0", envelope="SELECT count(*) FROM bars WHERE high < greatest(open, close, low) - 1e-8 OR low > least(open, close, high) + 1e-8", traded="SELECT count(*) FROM bars WHERE volume <= 60"))
def bar_checks(spark, d):
    return K.check_rows(A.bars_event_day(spark, d), {"positive_close": F.col("close") > 0, "envelope": ~S.outside_envelope(), "traded": F.col("volume") > 60})


@query("q09_peer_coverage", f"WITH {A.NATION_MONTH} SELECT date, sector, count(DISTINCT ticker) AS covered, count(DISTINCT ticker) >= 2 AS passed FROM bars WHERE volume > 5 GROUP BY 1, 2")
def peer_coverage(spark, d):
    return A.bars_nation_month(spark, d).where("volume > 5").groupBy("date", "sector").agg(F.count_distinct("ticker").alias("covered"), (F.count_distinct("ticker") >= 2).alias("passed"))


@query("q11_conservation", f"WITH {A.FLOWS} SELECT date, count(DISTINCT investor_type) AS groups, count(DISTINCT investor_type) = 5 AND NOT (abs(sum(buy_value - sell_value)) > 0.01 * sum(buy_value) AND sum(buy_value) > 0) AND min(buy_value) >= 0 AND min(sell_value) >= 0 AS passed FROM flow GROUP BY 1")
def conservation(spark, d):
    """All groups, none negative, and a net of at most 1 % of what was bought: every buy has a seller."""
    return K.flow_conservation(A.flows(spark, d), groups=5)


@query("q12_references", _checks(lineitem_part="SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part)", orders_customer="SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)", customer_orders="SELECT count(*) FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"))
def references(spark, d):
    l, p, o, c = (T(spark, d, n) for n in ("lineitem", "part", "orders", "customer"))
    return K.union_checks(
        K.count_check("lineitem_part", l.join(p, l.l_partkey == p.p_partkey, "left_anti")), K.count_check("orders_customer", o.join(c, o.o_custkey == c.c_custkey, "left_anti")),
        K.count_check("customer_orders", c.join(o, o.o_custkey == c.c_custkey, "left_anti")),
    )


@query("q20_unique_mapping", "SELECT p_brand, count(DISTINCT p_type) AS n FROM part GROUP BY 1 HAVING count(DISTINCT p_type) > 1")
def unique_mapping(spark, d):
    return T(spark, d, "part").groupBy("p_brand").agg(F.count_distinct("p_type").alias("n")).where("n > 1")


@query("q23_constancy", "SELECT l_orderkey, count(DISTINCT (l_returnflag, l_linestatus)) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT (l_returnflag, l_linestatus)) > 1")
def constancy(spark, d):
    return K.varying(T(spark, d, "lineitem"), "l_orderkey", ["l_returnflag", "l_linestatus"])


@query("q30_weight_sums", f"WITH {A.NATION_MONTH}, w AS (SELECT date, sum((volume % 10) / 100.0::DOUBLE) AS s FROM bars GROUP BY 1) SELECT date, round(s, 6) + 0.0 AS total, s <= 1 + 1e-9 AS passed FROM w")
def weight_sums(spark, d):
    w = A.bars_nation_month(spark, d).groupBy("date").agg(F.sum(F.pmod("volume", F.lit(10)) / 100.0).alias("s"))
    return w.select("date", r6(F.col("s")).alias("total"), (F.col("s") <= 1 + 1e-9).alias("passed"))


@query("x04_resume", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linestatus = 'F')")
def resume(spark, d):
    done = T(spark, d, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("o_orderkey"))
    return T(spark, d, "orders").where("o_orderstatus = 'O'").select("o_orderkey").join(done, "o_orderkey", "left_anti")


@query("x02_workload", f"WITH {A.TYPE_WEEK} SELECT ticker, CAST(sum(volume) AS BIGINT) AS units, count(*) AS steps FROM bars GROUP BY 1")
def workload(spark, d):
    return A.bars_type_week(spark, d).groupBy("ticker").agg(F.sum("volume").alias("units"), F.count("*").alias("steps"))


@query("stream_hourly_bars", "SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS bar_start, event_type AS ticker, max(value) AS high, min(value) AS low, count(*) AS volume FROM events GROUP BY 1, 2")
def hourly(spark, d):
    b = tick_bars(T(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")))
    return b.select(F.col("bar_start").cast("timestamp_ntz").alias("bar_start"), "ticker", "high", "low", "volume")


QUERIES = Q
