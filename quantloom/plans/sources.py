"""Ingestion (A), column and scalar rules (B, F), context features (W) and row contracts (Q) in full."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..functions import scalars as S
from ..operators import quality as K
from ..operators import windows as W
from ..sources import ingest as N
from .checks import _checks
from .windows import _FEATURES, _TECH, feature_panel

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_CODE = "(coalesce(list_sum(list_transform(string_split({0}, ''), lambda c: unicode(c))), 0) % 200 - 100) / 100.0::DOUBLE"


@query("a15_daily_sentiment", f"WITH {A.NEWS}, s AS (SELECT ticker, date, CASE WHEN doc_id % 4 = 0 THEN {_CODE.format('text')} ELSE doc_id % 5 / 4.0::DOUBLE END AS s FROM news) SELECT ticker, date, round(avg(s) + 1e-9, 6) + 0.0 AS sentiment_score, count(*) AS news_count, 'scored' AS sentiment_source FROM s GROUP BY 1, 2")
def daily_sentiment(spark, d):
    """A row without a score takes the one of its text."""
    n = A.news(spark, d).withColumn("sentiment_score", F.when(F.pmod("doc_id", F.lit(4)) != 0, F.pmod("doc_id", F.lit(5)) / 4.0))
    s = N.daily_sentiment(n, F.coalesce("sentiment_score", S.codepoint_sentiment(F.col("text"))), source="scored")
    return s.withColumn("sentiment_score", r6(F.col("sentiment_score") + 1e-9))


_MONTHS = A.MACRO_DAILY + ", m AS (SELECT name, CAST(date_trunc('month', date) AS DATE) AS period, round(avg(close) + 1e-9, 2) + 0.0 AS value FROM macro GROUP BY 1, 2)"
_LBD = "CAST(e - INTERVAL 1 DAY * greatest(isodow(e) - 5, 0) AS DATE)"
_MACRO_ROWS = f"SELECT period, {_LBD} AS release_date, trim(regexp_replace(lower(label), '[^a-z0-9]+', '_', 'g'), '_') AS metric, label AS metric_label, value FROM (SELECT period, last_day(period + INTERVAL 1 MONTH) AS e, label, value FROM x WHERE value IS NOT NULL)"


def _months(spark, d):
    m = A.macro_daily(spark, d).groupBy("name", F.date_trunc("month", "date").cast("date").alias("period"))
    return m.agg((F.round(F.avg("close") + 1e-9, 2) + 0.0).alias("value"))


@query("a17_long_table", f"WITH {_MONTHS}, x AS (SELECT period, name AS label, CASE WHEN month(period) = 4 THEN NULL ELSE value END AS value FROM m) {_MACRO_ROWS}")
def long_table(spark, d):
    raw = _months(spark, d).select(F.date_format("period", "yyyy-MM-dd").alias("period"), F.concat(F.lit(" "), "name").alias("metric"), F.when(F.month("period") != 4, F.format_number("value", 2)).otherwise("n/a").alias("value"))
    return N.macro_table(raw)


@query("a17_wide_table", f"WITH {_MONTHS}, x AS (SELECT period, name AS label, value FROM m WHERE name IN ('1-URGENT', '5-LOW')) {_MACRO_ROWS}")
def wide_table(spark, d):
    """The same figures as columns: a table without the columns metric and value is a wide one."""
    wide = _months(spark, d).groupBy("period").pivot("name", ["1-URGENT", "5-LOW"]).agg(F.format_number(F.max("value"), 2))
    return N.macro_table(wide.withColumn("period", F.date_format("period", "yyyy-MM-dd")))


_EXPORT = f"WITH {_MONTHS}, x AS (SELECT upper(strftime(period, '%b %Y')) || CASE WHEN month(period) >= 11 THEN ' p' WHEN month(period) = 6 THEN ' r' ELSE '' END AS label, name, period, value FROM m WHERE NOT (name = '5-LOW' AND month(period) = 3) UNION ALL SELECT upper(strftime(period, '%b %Y')), '9-NEW', period, value FROM m WHERE name = '1-URGENT' AND year(period) = 1997)"


@query("a19_history_export", _EXPORT + " SELECT period, label AS period_label, CASE WHEN label LIKE '% p' THEN 'p' WHEN label LIKE '% r' THEN 'r' ELSE '' END AS revision_flag, name AS metric, value, 'latest_revised_full_history_export' AS vintage_kind, false AS point_in_time_eligible FROM x WHERE period BETWEEN DATE '1996-04-01' - INTERVAL 3 MONTH AND DATE '1998-12-01'")
def history_export(spark, d):
    """Month labels with their revision flags, from three months before the window on."""
    return N.history_window(_export(spark, d), "1996-04-01", "1998-12-01", 3)


def _export(spark, d):
    m = _months(spark, d)
    label = F.upper(F.date_format("period", "MMM yyyy"))
    old = m.where("not (name = '5-LOW' and month(period) = 3)").select(F.concat(label, F.when(F.month("period") >= 11, " p").when(F.month("period") == 6, " r").otherwise("")).alias("period_label"), F.col("name").alias("metric"), "value")
    return old.unionByName(m.where("name = '1-URGENT' and year(period) = 1997").select(label.alias("period_label"), F.lit("9-NEW").alias("metric"), "value"))


@query("a19_export_contract", _EXPORT + ", w AS (SELECT * FROM x WHERE period BETWEEN DATE '1996-01-01' AND DATE '1998-12-01'), g AS (SELECT CAST(unnest(generate_series(TIMESTAMP '1996-01-01', TIMESTAMP '1998-12-01', INTERVAL 1 MONTH)) AS DATE) AS period), k AS (SELECT DISTINCT name FROM x), n(name) AS (VALUES ('1-URGENT'), ('2-HIGH'), ('3-MEDIUM'), ('4-NOT SPECIFIED'), ('5-LOW')) " + _checks(
    extra_metrics="SELECT count(*) FROM (SELECT name FROM k EXCEPT SELECT name FROM n)", missing_metrics="SELECT count(*) FROM (SELECT name FROM n EXCEPT SELECT name FROM k)", missing_months="SELECT count(*) FROM (SELECT period FROM g EXCEPT SELECT period FROM w)", missing_cells="SELECT count(*) FROM (SELECT period, name FROM g CROSS JOIN n EXCEPT SELECT period, name FROM w)",
    repeated_cells="SELECT count(*) FROM (SELECT 1 FROM x GROUP BY period, name HAVING count(*) > 1)", no_value="SELECT count(*) FROM x WHERE value IS NULL", enough_months="SELECT CASE WHEN count(DISTINCT period) >= 300 THEN 0 ELSE 1 END FROM x",
))
def export_contract(spark, d):
    """The exact metrics, every month of the window for each of them, and a long enough history."""
    return N.export_checks(N.with_period(_export(spark, d)), ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"], "1996-04-01", "1998-12-01", 3, 300)


_RATES = "m AS (SELECT CAST(date_trunc('quarter', o_orderdate) AS DATE) AS announced, round(avg(o_totalprice) / 2000) * 0.25 AS rate FROM {orders} GROUP BY 1), d AS (SELECT *, CAST(round((rate - lag(rate) OVER (ORDER BY announced)) * 100) AS INT) AS bp FROM m), history AS (SELECT announced, rate, CASE WHEN month(announced) = 7 AND year(announced) = 1997 THEN 'Raise 75 bps' WHEN month(announced) = 10 AND year(announced) = 1998 THEN 'Keep' WHEN coalesce(bp, 0) = 0 THEN 'Hold' WHEN bp > 0 THEN concat('Raise ', CAST(bp AS STRING), ' bps') ELSE concat('Cut ', CAST(-bp AS STRING), ' bps') END AS decision FROM d)"


@query("a21_level_check", f"WITH {A.bare(_RATES)}, x AS (SELECT *, lower(decision) AS t, lag(rate) OVER (ORDER BY announced) AS before FROM history), y AS (SELECT *, CASE WHEN t = 'hold' THEN 0 WHEN regexp_full_match(t, 'raise [0-9]+ bps') THEN CAST(split_part(t, ' ', 2) AS INT) WHEN regexp_full_match(t, 'cut [0-9]+ bps') THEN -CAST(split_part(t, ' ', 2) AS INT) END AS bp FROM x) " + _checks(recognised="SELECT count(*) FROM y WHERE bp IS NULL", one_a_date="SELECT count(*) FROM (SELECT 1 FROM history GROUP BY announced HAVING count(*) > 1)", level_follows_decision="SELECT count(*) FROM y WHERE before IS NOT NULL AND (bp IS NULL OR round((rate - before) * 100, 6) <> bp)"))
def level_check(spark, d):
    """Each level must differ from the one before by the decision announced with it."""
    return K.rate_checks(A.portable(spark, d, f"WITH {_RATES} SELECT announced, CAST(rate AS DOUBLE) AS rate, decision FROM history"))


@query("a22_interval_changes", f"WITH {A.MEMBERSHIP}, y AS (SELECT effective_from, list(DISTINCT ticker) AS m FROM members GROUP BY 1), z AS (SELECT *, lag(m) OVER (ORDER BY effective_from) AS b FROM y) SELECT effective_from, len(m) AS members, CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(m, lambda t: NOT list_contains(b, t))) END AS added, CASE WHEN b IS NULL THEN 0 ELSE len(list_filter(b, lambda t: NOT list_contains(m, t))) END AS removed FROM z")
def interval_changes(spark, d):
    """How many names each record adds and drops; the first has no record before it."""
    return N.interval_changes(A.membership(spark, d), "effective_from", "ticker")


@query("a22_name_history", f"WITH {A.MEMBERSHIP}, s AS (SELECT ticker, effective_from, effective_to, CASE WHEN revised THEN 'late' ELSE 'early' END AS sector FROM members) SELECT ticker, min(effective_from) AS first_seen, max(effective_to) AS last_seen, count(*) AS records, count(DISTINCT sector) AS sector_versions FROM s GROUP BY 1")
def name_history(spark, d):
    m = A.membership(spark, d).withColumn("sector", F.when(F.col("revised"), "late").otherwise("early"))
    return m.groupBy("ticker").agg(F.min("effective_from").alias("first_seen"), F.max("effective_to").alias("last_seen"), F.count("*").alias("records"), F.count_distinct("sector").alias("sector_versions"))


@query("a25_synthetic_panel", None)
def synthetic_panel(spark, d):
    """A seeded panel of all brands on business days; draws are those of this package."""
    return N.synthetic_panel(A.table(spark, d, "part").select(F.col("p_brand").alias("ticker")), "2024-01-01", "2024-12-31", seed=42)


@query("b05_prefix_columns", f"WITH {_TECH} SELECT date, ticker, return_1d, return_5d, return_20d, ma_ratio_10, ma_ratio_30 FROM tech")
def prefix_columns(spark, d):
    p = feature_panel(spark, d)
    return p.select("date", "ticker", *S.by_prefix(p.columns, ("return_", "ma_ratio_")))


_TECH_RULES = [("return_", "returns"), ("ma_ratio_", "trend"), ("volatility_", "risk"), ("volume_", "liquidity")]


@query("b07_group_counts", f"WITH {_TECH}, c AS (SELECT {', '.join(f'count(*) FILTER ({n} <> 0) AS {n}' for n in _FEATURES)} FROM tech), uu AS (SELECT * FROM c UNPIVOT (k FOR n IN ({', '.join(_FEATURES)}))) SELECT CASE WHEN starts_with(n, 'return_') THEN 'returns' WHEN starts_with(n, 'ma_ratio_') THEN 'trend' WHEN starts_with(n, 'volatility_') THEN 'risk' WHEN starts_with(n, 'volume_') THEN 'liquidity' ELSE 'technical' END AS feature_group, count(*) AS n_columns, CAST(sum(k) AS BIGINT) AS filled FROM uu GROUP BY 1")
def group_counts(spark, d):
    """Columns of each group of features, and how many of their values are not 0."""
    p = feature_panel(spark, d)
    counts = p.agg(*(F.count_if(F.col(c) != 0).alias(c) for c in _FEATURES)).unpivot([], list(_FEATURES), "n", "k")
    return counts.groupBy(S.feature_group(F.col("n"), _TECH_RULES).alias("feature_group")).agg(F.count("*").alias("n_columns"), F.sum("k").alias("filled"))


_BOOLS = ["true", "False", " TRUE ", "1", "yes", "", "no"]


@query("b09_boolean_rejection", "WITH t AS (SELECT event_id, [" + ", ".join(f"'{b}'" for b in _BOOLS) + "][event_id % 7 + 1] AS t FROM events) " + _checks(boolean="SELECT count(*) FROM t WHERE lower(trim(t)) NOT IN ('true', 'false')"))
def boolean_rejection(spark, d):
    """Anything but true and false is refused, 1 and yes too."""
    t = A.table(spark, d, "events").select(F.get(F.array(*(F.lit(b) for b in _BOOLS)), F.pmod("event_id", F.lit(7)).cast("int")).alias("t"))
    return K.check_rows(t, {"boolean": S.strict_boolean(F.col("t")).isNotNull()})


@query("c15_anti", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti(spark, d):
    urgent = A.table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return A.table(spark, d, "customer").join(urgent, "c_custkey", "left_anti").select("c_custkey", "c_mktsegment")


_SECTORS = ["Banking", "Food & Beverage", "Energy & Utilities"]


@query("f07_canonical_sector", "SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'Banking' WHEN 1 THEN 'Food & Beverage' WHEN 2 THEN 'Food & Beverage' WHEN 3 THEN 'Energy & Utilities' WHEN 4 THEN NULL WHEN 5 THEN 'Banking' ELSE NULL END AS sector FROM events")
def canonical_sector(spark, d):
    """Full-width letters, 'and' for &, odd spaces and case; what fits no sector is null."""
    texts = ["ＢＡＮＫＩＮＧ", "food and  beverage", " Food&Beverage ", "Energy & Utilities", "Foods", "bank​ing".replace("​", ""), None]
    t = A.table(spark, d, "events").select("event_id", F.get(F.array(*(F.lit(x) for x in texts)), F.pmod("event_id", F.lit(7)).cast("int")).alias("t"))
    return t.select("event_id", S.canonical_sector(_SECTORS)("t").alias("sector"))


@query("f17_masked_budget", f"WITH {A.EVENT_DAY}, w AS (SELECT date, ticker, volume % 3 <> 0 AS active, CASE WHEN volume % 3 <> 0 THEN least(greatest(close - 0.3, 0), 0.4) ELSE 0 END AS w FROM bars), s AS (SELECT *, sum(w) OVER (PARTITION BY date) AS t FROM w) SELECT date, ticker, active, round(CASE WHEN t > 0.95 THEN w / t * 0.95 ELSE w END, 6) + 0.0 AS weight FROM s")
def masked_budget(spark, d):
    """Weights clipped to a most, none for names outside the mask, scaled to a budget that leaves some cash."""
    b = A.bars_event_day(spark, d).select("date", "ticker", (F.pmod("volume", F.lit(3)) != 0).alias("active"), (F.col("close") - 0.3).alias("raw"))
    return S.masked_budget(b, "raw", "active", ["date"], most=0.4, least_cash=0.05).select("date", "ticker", "active", r6(F.col("weight")).alias("weight"))


@query("f22_normal", None)
def normal(spark, d):
    """The normal distribution function of standardised balances, and back."""
    z = A.table(spark, d, "supplier").select("s_suppkey", (F.col("s_acctbal") / 3000).alias("z"))
    p = z.withColumn("p", S.normal_cdf()("z"))
    return p.withColumn("back", S.normal_quantile()("p"))


@query("f25_headroom", "SELECT s_suppkey, greatest(5000 - s_acctbal, 0) AS headroom, s_acctbal <= 5000 AS fits FROM supplier")
def headroom(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", S.headroom(F.lit(5000.0), F.col("s_acctbal")).alias("headroom"), (F.col("s_acctbal") <= 5000).alias("fits"))


_NM_R = A.NATION_MONTH + ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r1 FROM bars), a AS (SELECT *, volume % 7 <> 0 AS active, r1 IS NOT NULL AND volume % 5 <> 0 AS observed FROM r)"


@query("w13_sector_context", f"""WITH {_NM_R}, c AS (SELECT *, active AND observed AS k FROM a), g AS (SELECT *, count(*) FILTER (active) OVER w AS members, count(*) FILTER (k) OVER w AS n, coalesce(sum(r1) FILTER (k) OVER w, 0) AS s, max(date) FILTER (k) OVER w AS info FROM c WINDOW w AS (PARTITION BY date, sector)),
p AS (SELECT *, n - CAST(k AS INT) AS pn, s - CASE WHEN k THEN r1 ELSE 0 END AS ps FROM g)
SELECT date, ticker, sector, CASE WHEN active THEN members ELSE 0 END AS members, CASE WHEN active THEN n ELSE 0 END AS contributors, round(CASE WHEN active AND members > 0 THEN n / members::DOUBLE ELSE 0 END, 6) + 0.0 AS coverage, active AND n > 0 AS available, round(CASE WHEN active AND n > 0 THEN s / n ELSE 0 END, 6) + 0.0 AS mean_return,
  active AND n > 0 AND observed AS relative_available, round(CASE WHEN active AND n > 0 AND observed THEN r1 - s / n ELSE 0 END, 6) + 0.0 AS relative_return, CASE WHEN active THEN pn ELSE 0 END AS peers, active AND pn > 0 AS peer_available, round(CASE WHEN active AND pn > 0 THEN ps / pn ELSE 0 END, 6) + 0.0 AS peer_return,
  active AND pn > 0 AND observed AS relative_peer_available, round(CASE WHEN active AND pn > 0 AND observed THEN r1 - ps / pn ELSE 0 END, 6) + 0.0 AS relative_peer_return, CASE WHEN active AND n > 0 THEN info END AS information_at FROM p""")
def sector_context(spark, d):
    """The mean of a sector with and without the name itself, how many stand behind it, and what is known when."""
    b = A.bars_nation_month(spark, d).withColumn("r", F.col("close") / F.lag("close").over(W.ordered()) - 1)
    x = b.select("date", "ticker", "sector", "r", (F.pmod("volume", F.lit(7)) != 0).alias("active"), (F.col("r").isNotNull() & (F.pmod("volume", F.lit(5)) != 0)).alias("observed"), F.col("date").alias("known_at"))
    c = W.sector_context(x, "r", "active", "observed", "known_at", ("date", "sector"))
    return c.select("date", "ticker", "sector", *(r6(F.col(n)).alias(n) if t == "double" else F.col(n) for n, t in c.drop("date", "ticker", "sector", "r", "active", "observed", "known_at").dtypes))


_P14 = "rows BETWEEN 13 PRECEDING AND CURRENT ROW"


@query("w27_rsi_14", f"WITH {A.TYPE_WEEK}, s AS (SELECT *, close - lag(close) OVER (PARTITION BY ticker ORDER BY date) AS d FROM bars), m AS (SELECT date, ticker, count(d) OVER w AS n, avg(CASE WHEN d > 0 THEN d ELSE 0 END) OVER w AS u, avg(CASE WHEN d < 0 THEN -d ELSE 0 END) OVER w AS l, count(*) OVER w AS k FROM s WINDOW w AS (PARTITION BY ticker ORDER BY date {_P14})) SELECT date, ticker, round(CASE WHEN k < 14 OR (u = 0 AND l = 0) THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + u / l) END, 5) + 0.0 AS rsi_14 FROM m")
def prototype_rsi(spark, d):
    """The prototype's strength on a scale of 100: simple means of gains and losses, the first step counting as none."""
    b = A.bars_type_week(spark, d).select("date", "ticker", "close")
    return W.prototype_rsi(b, 14).select("date", "ticker", (F.round("rsi_14", 5) + 0.0).alias("rsi_14"))


@query("w28_bands", f"WITH {A.TYPE_WEEK}, m AS (SELECT date, ticker, close, count(*) OVER w20 AS n20, avg(close) OVER w20 AS m, stddev_pop(close) OVER w20 AS s, min(low) OVER w14 AS lo, max(high) OVER w14 AS hi, count(*) OVER w14 AS n14 FROM bars WINDOW w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING)), k AS (SELECT *, CASE WHEN n14 = 14 THEN 100 * (close - lo) / nullif(hi - lo, 0) END AS k FROM m) SELECT date, ticker, round(CASE WHEN n20 = 20 THEN m END, 5) + 0.0 AS middle, round(CASE WHEN n20 = 20 THEN m - 2 * s END, 5) + 0.0 AS lower, round(CASE WHEN n20 = 20 THEN m + 2 * s END, 5) + 0.0 AS upper, round(k, 5) + 0.0 AS stoch_k, round(CASE WHEN count(k) OVER w3 = 3 THEN avg(k) OVER w3 END, 5) + 0.0 AS stoch_d FROM k WINDOW w3 AS (PARTITION BY ticker ORDER BY date ROWS 2 PRECEDING)")
def bands(spark, d):
    """Bollinger bands of 20 rows and two deviations, and the stochastic oscillator of 14 and 3: the usual settings."""
    b = W.bands(A.bars_type_week(spark, d))
    return b.select("date", "ticker", *((F.round(c, 5) + 0.0).alias(c) for c in ("middle", "lower", "upper", "stoch_k", "stoch_d")))


@query("w28_macd_signal", f"""WITH RECURSIVE {A.TYPE_WEEK}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars),
e AS (SELECT date, ticker, i, close AS a, close AS b, 0.0::DOUBLE AS s FROM n WHERE i = 1 UNION ALL SELECT n.date, n.ticker, n.i, e.a * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13), e.b * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27),
  e.s * (1 - 2.0::DOUBLE / 10) + (2.0::DOUBLE / 10) * ((e.a * (1 - 2.0::DOUBLE / 13) + n.close * (2.0::DOUBLE / 13)) - (e.b * (1 - 2.0::DOUBLE / 27) + n.close * (2.0::DOUBLE / 27))) FROM n JOIN e ON n.ticker = e.ticker AND n.i = e.i + 1)
SELECT date, ticker, round(a - b, 6) + 0.0 AS macd, round(s, 6) + 0.0 AS signal, round(a - b - s, 6) + 0.0 AS histogram FROM e""")
def macd_signal(spark, d):
    m = W.macd(A.bars_type_week(spark, d).select("date", "ticker", "close"))
    return m.select("date", "ticker", *(r6(F.col(c)).alias(c) for c in ("macd", "signal", "histogram")))


_INTAKE = """WITH u AS (SELECT concat('C', CAST(c_custkey AS STRING)) AS ticker FROM {customer} WHERE c_custkey % 4 <> 0), sectors AS (SELECT concat('C', CAST(c_custkey AS STRING)) AS ticker FROM {customer} WHERE c_custkey % 5 <> 0 AND c_custkey % 3 <> 0),
news AS (SELECT concat('C', CAST(o_custkey AS STRING)) AS ticker, CAST(o_orderdate AS DATE) AS d FROM {orders} WHERE o_orderstatus = 'O'), macro AS (SELECT CAST(o_orderdate AS DATE) AS d FROM {orders} WHERE o_orderstatus = 'Z'), facts AS (SELECT concat('C', CAST(o_custkey AS STRING)) AS ticker, CAST(o_orderdate AS DATE) AS d FROM {orders})"""


@query("q12_intake", A.bare(_INTAKE) + " " + _checks(
    sector_covers_universe="SELECT count(*) FROM (SELECT ticker FROM u EXCEPT SELECT ticker FROM sectors)", sector_has_no_extra="SELECT count(*) FROM (SELECT ticker FROM sectors EXCEPT SELECT ticker FROM u)", news_in_universe="SELECT count(*) FROM (SELECT ticker FROM news EXCEPT SELECT ticker FROM u)", facts_in_universe="SELECT count(*) FROM (SELECT ticker FROM facts EXCEPT SELECT ticker FROM u)",
    macro_overlaps="SELECT CASE WHEN count(*) > 0 AND max(d) >= DATE '1997-01-01' AND min(d) <= DATE '1998-12-31' THEN 0 ELSE 1 END FROM macro", news_overlaps="SELECT CASE WHEN count(*) > 0 AND max(d) >= DATE '1997-01-01' AND min(d) <= DATE '1998-12-31' THEN 0 ELSE 1 END FROM news", facts_overlap="SELECT CASE WHEN count(*) > 0 AND max(d) >= DATE '2010-01-01' AND min(d) <= DATE '2011-12-31' THEN 0 ELSE 1 END FROM facts",
))
def intake(spark, d):
    """Tickers of each source against the universe, and whether its dates reach into the window."""
    t = lambda n: A.portable(spark, d, f"{_INTAKE} SELECT * FROM {n}")
    return K.union_checks(
        K.subset_check("sector_covers_universe", t("u"), t("sectors"), "ticker"), K.subset_check("sector_has_no_extra", t("sectors"), t("u"), "ticker"), K.subset_check("news_in_universe", t("news"), t("u"), "ticker"), K.subset_check("facts_in_universe", t("facts"), t("u"), "ticker"),
        K.overlap_check("macro_overlaps", t("macro"), "d", "1997-01-01", "1998-12-31"), K.overlap_check("news_overlaps", t("news"), "d", "1997-01-01", "1998-12-31"), K.overlap_check("facts_overlap", t("facts"), "d", "2010-01-01", "2011-12-31"),
    )


_LEAK = "WITH p AS (SELECT o_orderkey, CASE WHEN o_orderkey % 97 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date, o_orderstatus AS ticker, CASE WHEN o_orderkey % 89 = 0 THEN NULL WHEN o_orderkey % 83 = 0 THEN CAST(o_orderdate AS DATE) + 1 ELSE CAST(o_orderdate AS DATE) - 5 END AS macro_release_date, CAST(o_orderdate AS DATE) - CAST(o_orderkey % 3 AS INT) + 1 AS asof_date FROM orders)"


@query("q01_leakage", _LEAK + " " + _checks(
    valid_dates="SELECT count(*) FROM p WHERE date IS NULL", unique_keys="SELECT count(*) FROM (SELECT 1 FROM p WHERE date IS NOT NULL GROUP BY date, ticker HAVING count(*) > 1)", monotonic="SELECT count(DISTINCT ticker) FROM (SELECT ticker, date < lag(date) OVER (PARTITION BY ticker ORDER BY o_orderkey) AS bad FROM p WHERE date IS NOT NULL) WHERE bad",
    macro_release_date_valid="SELECT count(*) FROM p WHERE macro_release_date IS NULL", macro_release_date_not_future="SELECT count(*) FROM p WHERE macro_release_date > date", asof_date_valid="SELECT 0", asof_date_not_future="SELECT count(*) FROM p WHERE asof_date > date",
))
def leakage(spark, d):
    """Planted: dates that are missing, released late or out of order; the release columns are found by their names."""
    day, k = F.col("o_orderdate").cast("date"), F.col("o_orderkey")
    n = lambda m: F.pmod(k, F.lit(m)) == 0
    p = A.table(spark, d, "orders").select(
        "o_orderkey", F.when(~n(97), day).alias("date"), F.col("o_orderstatus").alias("ticker"), F.when(n(89), None).when(n(83), F.date_add(day, 1)).otherwise(F.date_sub(day, 5)).alias("macro_release_date"),
        F.date_add(F.date_sub(day, F.pmod(k, F.lit(3)).cast("int")), 1).alias("asof_date"),
    )
    return K.leakage_report(p, "o_orderkey")


@query("q13_source_readiness", "SELECT * FROM (SELECT 'nation' AS source, count(*) AS rows, '' AS missing_columns, count(*) >= 25 AS ready, 'ready' AS reason FROM nation UNION ALL SELECT 'region', count(*), 'r_population', false, 'missing required columns' FROM region UNION ALL SELECT 'supplier', count(*), '', count(*) >= 1000000, 'too few rows' FROM supplier)")
def source_readiness(spark, d):
    """Required columns and a least number of rows of each source."""
    t = lambda n: A.table(spark, d, n)
    return K.union_checks(*(K.source_ready(n, t(n), cols, least) for n, cols, least in (("nation", ["n_name"], 25), ("region", ["r_name", "r_population"], 1), ("supplier", ["s_name"], 1_000_000))))


_ENV = A.NATION_MONTH + ", x AS (SELECT date, ticker, volume > 3 AS eligible, CASE WHEN volume % 13 = 0 THEN NULL WHEN volume % 17 = 0 THEN 'inf'::DOUBLE ELSE close END AS f1, CASE WHEN volume % 19 = 0 THEN 'nan'::DOUBLE ELSE close / 2 END AS f2, CASE WHEN volume % 11 = 0 THEN -close ELSE close END AS price FROM bars), o AS (SELECT *, bool_and(coalesce(isfinite(f1) AND isfinite(f2), false)) OVER w AS fine, count(*) OVER w AS n, lead(price) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM x WINDOW w AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))"


@query("q26_environment", f"WITH {_ENV} " + _checks(lookback_finite="SELECT count(*) FROM o WHERE eligible AND nx IS NOT NULL AND NOT (n = 3 AND fine)", decision_price="SELECT count(*) FROM o WHERE eligible AND nx IS NOT NULL AND NOT price > 0", outcome_price="SELECT count(*) FROM o WHERE eligible AND nx IS NOT NULL AND NOT nx > 0"))
def environment(spark, d):
    """Eligible names need finite features in the whole lookback, and positive prices at decision and outcome."""
    v = F.col("volume")
    n = lambda m: F.pmod(v, F.lit(m)) == 0
    x = A.bars_nation_month(spark, d).select("date", "ticker", (v > 3).alias("eligible"), F.when(n(13), None).when(n(17), float("inf")).otherwise(F.col("close")).alias("f1"), F.when(n(19), float("nan")).otherwise(F.col("close") / 2).alias("f2"), F.when(n(11), -F.col("close")).otherwise(F.col("close")).alias("price"))
    return K.environment_checks(x, ["f1", "f2"], "price", "eligible", 3)


_OBS = A.NATION_MONTH + ", r AS (SELECT *, close / lag(close) OVER (PARTITION BY ticker ORDER BY date) - 1 AS r, volume % 10 <> 0 AS observed, CASE WHEN volume % 9 = 0 THEN date + 1 WHEN volume % 8 = 0 THEN NULL ELSE date END AS known_at FROM bars)"


@query("q28_observed", f"WITH {_OBS} " + _checks(observed_finite="SELECT count(*) FROM r WHERE observed AND r IS NULL", unobserved_null="SELECT count(*) FROM r WHERE NOT observed AND r IS NOT NULL", same_session="SELECT count(*) FROM r WHERE observed AND (known_at IS NULL OR known_at <> date)"))
def observed(spark, d):
    v = F.col("volume")
    r = A.bars_nation_month(spark, d).select("date", (F.col("close") / F.lag("close").over(W.ordered()) - 1).alias("r"), (F.pmod(v, F.lit(10)) != 0).alias("observed"), F.when(F.pmod(v, F.lit(9)) == 0, F.date_add("date", 1)).when(F.pmod(v, F.lit(8)) == 0, None).otherwise(F.col("date")).alias("known_at"))
    return K.check_rows(r, {"observed_finite": ~F.col("observed") | (F.col("r").isNotNull() & ~F.isnan("r")), "unobserved_null": F.col("observed") | F.col("r").isNull(), "same_session": ~F.col("observed") | (F.col("known_at") == F.col("date"))})


_OBJ = "m AS (SELECT p_partkey AS trial, CASE WHEN p_partkey % 31 = 0 THEN 'nan'::DOUBLE ELSE p_retailprice END AS objective, CASE WHEN p_partkey % 29 = 0 THEN 0.5 WHEN p_partkey % 23 = 0 THEN -1.5 ELSE -0.2 END AS max_drawdown, CASE WHEN p_partkey % 19 = 0 THEN -1.0 ELSE 1.0 END AS turnover FROM part)"
_ACT = A.NATION_MONTH + ", a AS (SELECT date, ticker, CASE WHEN volume % 37 = 0 THEN -0.5 WHEN volume % 41 = 0 THEN 1.5 WHEN volume % 43 = 0 THEN NULL ELSE (volume % 8) / 100.0::DOUBLE END AS weight FROM bars)"


@query("q30_objective", f"WITH {_ACT}, {_OBJ} " + _checks(finite_objective="SELECT count(*) FROM m WHERE NOT isfinite(objective)", drawdown="SELECT count(*) FROM m WHERE max_drawdown NOT BETWEEN -1 AND 0", not_negative="SELECT count(*) FROM m WHERE turnover < 0", weights="SELECT count(*) FROM a WHERE weight IS NULL OR weight < -1e-8 OR weight > 1 + 1e-8", daily_sum="SELECT count(*) FROM (SELECT 1 FROM a GROUP BY date HAVING sum(weight) > 1 + 1e-6)"))
def objective(spark, d):
    """A trial's metrics and its actions: finite, in range, and within the capital on each date."""
    k, v = F.col("p_partkey"), F.col("volume")
    m = A.table(spark, d, "part").select(F.when(F.pmod(k, F.lit(31)) == 0, float("nan")).otherwise(F.col("p_retailprice")).alias("objective"), F.when(F.pmod(k, F.lit(29)) == 0, 0.5).when(F.pmod(k, F.lit(23)) == 0, -1.5).otherwise(-0.2).alias("max_drawdown"), F.when(F.pmod(k, F.lit(19)) == 0, -1.0).otherwise(1.0).alias("turnover"))
    a = A.bars_nation_month(spark, d).select("date", F.when(F.pmod(v, F.lit(37)) == 0, -0.5).when(F.pmod(v, F.lit(41)) == 0, 1.5).when(F.pmod(v, F.lit(43)) == 0, None).otherwise(F.pmod(v, F.lit(8)) / 100.0).alias("weight"))
    return K.objective_checks(m, a)


QUERIES = Q
