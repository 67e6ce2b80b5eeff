"""Contracts (Q) over tables with planted violations: rows that pass and rows that fail each check.

The planted tables are SQL that both engines read alike, so that only the checks are written twice."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..operators import asof as J
from ..operators import contracts as C
from ..operators import metrics as M
from ..operators import quality as K
from ..operators import splits as L
from ..operators import windows as W
from .checks import _checks
from .studies import _FOLDS, _HALF, _WK

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


_HISTORY = """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM {orders}),
b AS (SELECT y, n_nationkey AS k, concat('r', CAST(y AS STRING)) AS record_id, n_name AS symbol, CASE WHEN y = 1997 AND n_nationkey = 3 THEN 'bad name' ELSE concat('N', CAST(n_nationkey AS STRING), '.BK') END AS ticker,
  CASE WHEN y = 1998 AND n_nationkey = 5 THEN ' ' ELSE 'sector' END AS sector, make_date(y, 1, 1) AS effective_from, CASE WHEN y = 1998 THEN make_date(y, 12, 1) WHEN y = 1999 THEN make_date(y + 1, 2, 1) WHEN y = 2001 THEN make_date(y, 1, 1) ELSE make_date(y + 1, 1, 1) END AS effective_to,
  CASE WHEN y = 1999 AND n_nationkey = 8 THEN NULL WHEN y = 1996 THEN make_date(y, 1, 5) ELSE make_date(y - 1, 12, 20) END AS published_at, CASE WHEN y = 2000 AND n_nationkey = 20 THEN 'yes' WHEN n_nationkey < 12 OR (y = 1997 AND n_nationkey = 12) THEN 'TRUE' ELSE 'False' END AS in_inner,
  CASE WHEN y = 1997 AND n_nationkey IN (2, 17) THEN 'false' ELSE 'true' END AS in_outer FROM y CROSS JOIN {nation}),
history AS (SELECT * FROM b WHERE NOT (y = 2001 AND k = 11) UNION ALL SELECT * FROM b WHERE y = 2000 AND k = 7)"""
_FLAG = "CASE lower(trim({0})) WHEN 'true' THEN true WHEN 'false' THEN false END"
_IN, _OUT = _FLAG.format("in_inner"), _FLAG.format("in_outer")


@query("q05_membership_history", A.bare(_HISTORY) + ", s AS (SELECT DISTINCT record_id, effective_from, effective_to, published_at FROM history), o AS (SELECT *, lag(effective_to) OVER (ORDER BY effective_from, record_id) AS before FROM s) " + _checks(
    valid_dates="SELECT count(*) FROM history WHERE effective_from IS NULL OR effective_to IS NULL OR published_at IS NULL", boolean_flags="SELECT count(*) FROM history WHERE lower(trim(in_inner)) NOT IN ('true', 'false') OR lower(trim(in_outer)) NOT IN ('true', 'false')",
    ticker_form="SELECT count(*) FROM history WHERE NOT regexp_full_match(ticker, '[A-Z0-9&.-]+\\.BK')", sector_present="SELECT count(*) FROM history WHERE trim(sector) = ''", inside_outer=f"SELECT count(*) FROM history WHERE NOT coalesce({_OUT}, false)",
    inner_inside_outer=f"SELECT count(*) FROM history WHERE NOT coalesce(NOT {_IN} OR {_OUT}, false)", published_in_time="SELECT count(*) FROM history WHERE NOT coalesce(published_at <= effective_from, false)", positive_intervals="SELECT count(*) FROM s WHERE effective_from >= effective_to",
    no_gap="SELECT count(*) FROM o WHERE before < effective_from", no_overlap="SELECT count(*) FROM o WHERE before > effective_from", starts_at="SELECT CASE WHEN min(effective_from) = DATE '1994-01-01' THEN 0 ELSE 1 END FROM s", ends_at="SELECT CASE WHEN max(effective_to) = DATE '1999-01-01' THEN 0 ELSE 1 END FROM s",
    unique_symbols="SELECT count(*) FROM (SELECT 1 FROM history GROUP BY record_id, symbol HAVING count(*) > 1)", one_interval_a_record="SELECT count(*) FROM (SELECT 1 FROM s GROUP BY record_id HAVING count(*) > 1)", record_size="SELECT count(*) FROM (SELECT 1 FROM history GROUP BY record_id HAVING count(*) <> 25)",
    record_symbols="SELECT count(*) FROM (SELECT 1 FROM history GROUP BY record_id HAVING count(DISTINCT symbol) <> 25)", record_inner=f"SELECT count(*) FROM (SELECT 1 FROM history GROUP BY record_id HAVING count(*) FILTER ({_IN}) <> 12)",
))
def membership_history(spark, d):
    return C.membership_history(A.portable(spark, d, _HISTORY + " SELECT * FROM history"), 25, 12, "1994-01-01", "1999-01-01")


_PANEL = """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM {orders}),
b AS (SELECT date, CASE WHEN month(date) = 3 AND n_nationkey = 4 THEN 'N3' ELSE concat('N', CAST(n_nationkey AS STRING)) END AS ticker, CASE WHEN month(date) = 5 AND n_nationkey = 24 THEN 25 ELSE n_nationkey END AS asset_slot, CASE WHEN year(date) = 1997 AND n_nationkey = 1 THEN 'maybe' WHEN n_nationkey < 10 OR (month(date) = 7 AND n_nationkey = 10) THEN 'True' ELSE 'FALSE' END AS is_member,
  CASE WHEN year(date) = 1998 AND month(date) = 2 THEN NULL WHEN year(date) = 1999 AND month(date) = 6 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE date END AS published_at, CASE WHEN month(date) = 9 THEN 'revised' ELSE 'original' END AS revision_status,
  CASE WHEN year(date) = 1996 AND month(date) = 8 THEN 'other' ELSE 'dated' END AS mask_kind, CASE WHEN month(date) = 11 AND n_nationkey = 2 THEN 'same_day' ELSE 'next_session' END AS rule, CASE WHEN year(date) = 1999 AND n_nationkey = 0 THEN 'B' ELSE 'A' END AS index_name,
  CASE WHEN month(date) = 4 AND n_nationkey = 6 THEN '' WHEN month(date) = 10 AND n_nationkey > 20 THEN 'r0' ELSE concat('r', CAST(year(date) AS STRING)) END AS record_id, CASE WHEN month(date) = 12 AND n_nationkey IN (7, 15) THEN ' ' ELSE 's' END AS sector, CASE WHEN month(date) = 1 AND n_nationkey IN (8, 16) THEN '' ELSE n_name END AS symbol, n_nationkey AS k FROM m CROSS JOIN {nation}),
panel AS (SELECT * FROM b WHERE NOT (year(date) = 2000 AND month(date) = 2 AND k = 3)),
expected_dates AS (SELECT date FROM m WHERE NOT (year(date) = 1995 AND month(date) = 3) UNION ALL SELECT make_date(2031, 1, 1) AS date),
slots AS (SELECT n_nationkey AS asset_slot, CASE WHEN n_nationkey = 9 THEN 'N99' ELSE concat('N', CAST(n_nationkey AS STRING)) END AS ticker FROM {nation})"""
_MEM = _FLAG.format("is_member")


@query("q06_panel_contract", A.bare(_PANEL) + ", g AS (SELECT date, list_sort(list(asset_slot)) AS s, count(*) FILTER (" + _MEM + ") AS m FROM panel GROUP BY 1) " + _checks(
    valid_dates="SELECT count(*) FROM panel WHERE date IS NULL OR published_at IS NULL", boolean_membership="SELECT count(*) FROM panel WHERE lower(trim(is_member)) NOT IN ('true', 'false')", mask_kind="SELECT count(*) FROM panel WHERE mask_kind <> 'dated'", revision_rule="SELECT count(*) FROM panel WHERE rule <> 'next_session'",
    record_present="SELECT count(*) FROM panel WHERE trim(record_id) = ''", public_in_time="SELECT count(*) FROM panel WHERE published_at IS NULL OR (revision_status <> 'revised' AND published_at > date) OR (revision_status = 'revised' AND published_at >= date)",
    member_sector=f"SELECT count(*) FROM panel WHERE NOT coalesce(NOT {_MEM} OR trim(sector) <> '', false)", member_symbol=f"SELECT count(*) FROM panel WHERE NOT coalesce(NOT {_MEM} OR trim(symbol) <> '', false)", unique_keys="SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY date, ticker HAVING count(*) > 1)",
    one_index="SELECT CASE WHEN count(DISTINCT index_name) = 1 THEN 0 ELSE 1 END FROM panel", one_record_a_session="SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY date HAVING count(DISTINCT record_id) <> 1)", dense="SELECT CASE WHEN count(*) = count(DISTINCT date) * count(DISTINCT ticker) THEN 0 ELSE 1 END FROM panel",
    date_missing="SELECT count(*) FROM (SELECT date FROM expected_dates EXCEPT SELECT date FROM panel)", date_foreign="SELECT count(*) FROM (SELECT date FROM panel EXCEPT SELECT date FROM expected_dates)",
    slot_missing="SELECT count(*) FROM (SELECT asset_slot, ticker FROM slots EXCEPT SELECT asset_slot, ticker FROM panel)", slot_foreign="SELECT count(*) FROM (SELECT asset_slot, ticker FROM panel EXCEPT SELECT asset_slot, ticker FROM slots)",
    one_ticker_a_slot="SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY asset_slot HAVING count(DISTINCT ticker) > 1)", one_slot_a_ticker="SELECT count(*) FROM (SELECT 1 FROM panel GROUP BY ticker HAVING count(DISTINCT asset_slot) > 1)",
    stable_slots="SELECT count(*) FROM g WHERE s <> range(25)", active_count="SELECT count(*) FROM g WHERE m <> 10",
))
def panel_contract(spark, d):
    t = lambda name: A.portable(spark, d, f"{_PANEL} SELECT * FROM {name}")
    return C.membership_panel(t("panel"), "dated", "next_session", 10, t("expected_dates"), t("slots"))


_MARKET = """WITH b AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS date, n_nationkey AS k, concat('N', CAST(n_nationkey AS STRING)) AS ticker, round(avg(o_totalprice), 4) AS p, round(min(o_totalprice), 4) AS lo, round(max(o_totalprice), 4) AS hi, count(*) AS v FROM {orders} JOIN {customer} ON o_custkey = c_custkey JOIN {nation} ON c_nationkey = n_nationkey GROUP BY 1, 2, 3),
x AS (SELECT *, (year(date) * 84 + month(date) * 7 + k) % 97 AS x FROM b),
bars0 AS (SELECT date, CASE WHEN x = 1 THEN 'ZZ' ELSE ticker END AS ticker, p AS open, CASE WHEN x = 2 THEN p / 2 ELSE hi END AS high, CASE WHEN x = 3 THEN p * 2 ELSE lo END AS low, CASE WHEN x = 4 THEN -p ELSE p END AS close, CASE WHEN x = 5 THEN 0.0 ELSE p END AS adjusted_close, CASE WHEN x = 6 THEN -1 ELSE v END AS volume,
  CASE WHEN x = 7 THEN NULL WHEN x = 8 THEN CAST(date AS TIMESTAMP) + INTERVAL 30 HOUR ELSE CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR END AS bar_available_at, CASE WHEN x = 9 THEN ' ' ELSE concat('b', CAST(x AS STRING)) END AS source_record_id, x FROM x WHERE x NOT IN (10, 11)),
bars AS (SELECT * FROM bars0 UNION ALL SELECT * FROM bars0 WHERE x = 12),
status0 AS (SELECT date, CASE WHEN x = 13 THEN 'YY' ELSE ticker END AS ticker, CASE x WHEN 10 THEN 'halted' WHEN 14 THEN 'delisted' WHEN 15 THEN 'open' WHEN 16 THEN 'suspended' WHEN 17 THEN 'not_yet_listed' ELSE 'trading' END AS trading_status,
  CASE WHEN x = 18 THEN CAST(date AS TIMESTAMP) - INTERVAL 1 HOUR ELSE CAST(date AS TIMESTAMP) + INTERVAL 18 HOUR END AS status_available_at, CASE WHEN x = 19 THEN '' ELSE 's' END AS source_record_id, x FROM x WHERE x <> 20),
status AS (SELECT * FROM status0 UNION ALL SELECT date, ticker, 'no_trade' AS trading_status, status_available_at, source_record_id, x FROM status0 WHERE x = 21),
expected AS (SELECT DISTINCT date FROM b),
sessions AS (SELECT CASE WHEN month(date) = 2 AND year(date) = 1997 THEN make_date(1997, 2, 2) ELSE date END AS date, CASE WHEN month(date) = 5 THEN CAST(date AS TIMESTAMP) + INTERVAL 30 HOUR ELSE CAST(date AS TIMESTAMP) END AS session_available_at, CASE WHEN month(date) = 8 THEN '' ELSE 'c' END AS source_record_id FROM expected),
actions AS (SELECT CASE WHEN s_suppkey % 10 = 9 THEN 'a0' ELSE concat('a', CAST(s_suppkey AS STRING)) END AS action_id, CASE WHEN s_suppkey % 11 = 10 THEN 'XX' ELSE concat('N', CAST(s_nationkey AS STRING)) END AS ticker,
  CASE s_suppkey % 9 WHEN 0 THEN 'dividend' WHEN 1 THEN 'split' WHEN 2 THEN 'reverse_split' WHEN 3 THEN 'rights' WHEN 4 THEN 'spin_off' WHEN 5 THEN 'merger' WHEN 6 THEN 'symbol_change' WHEN 7 THEN 'delisting' ELSE 'bonus' END AS action_type,
  CASE WHEN s_suppkey % 7 = 0 THEN CAST(make_date(1998, 1, 2) AS TIMESTAMP) ELSE CAST(make_date(1997, 12, 1) AS TIMESTAMP) END AS announcement_at, make_date(1998, 1, 1) AS effective_date, CASE WHEN s_suppkey % 5 = 0 THEN NULL WHEN s_suppkey % 5 = 1 THEN 0.0 ELSE 2.0 END AS adjustment_factor,
  CASE WHEN s_suppkey % 6 = 0 THEN -1.0 WHEN s_suppkey % 6 = 1 THEN NULL ELSE 1.0 END AS cash_amount, CASE WHEN s_suppkey % 4 = 0 THEN '' ELSE 'N1' END AS successor_ticker, CASE WHEN s_suppkey % 13 = 0 THEN ' ' ELSE 'p' END AS source_record_id FROM {supplier}),
symbols0 AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey = 2 THEN ' ' ELSE concat('i', CAST(n_nationkey AS STRING)) END AS instrument_id, CASE WHEN n_nationkey = 3 THEN 'QQ' ELSE concat('N', CAST(n_nationkey AS STRING)) END AS ticker, CASE WHEN n_nationkey = 4 THEN make_date(2040, 1, 1) ELSE make_date(1990, 1, 1) END AS effective_from,
  CASE WHEN n_nationkey = 5 THEN make_date(1998, 1, 1) ELSE make_date(2030, 1, 1) END AS effective_to, CASE WHEN n_nationkey = 6 THEN '' ELSE 'h' END AS source_record_id FROM {nation}),
symbols AS (SELECT * FROM symbols0 UNION ALL SELECT k, instrument_id, ticker, make_date(2029, 6, 1) AS effective_from, make_date(2035, 1, 1) AS effective_to, source_record_id FROM symbols0 WHERE k = 7 UNION ALL SELECT k, instrument_id, ticker, make_date(2030, 1, 1) AS effective_from, make_date(2035, 1, 1) AS effective_to, source_record_id FROM symbols0 WHERE k = 8),
members AS (SELECT date, ticker FROM b WHERE k < 12), tickers AS (SELECT concat('N', CAST(n_nationkey AS STRING)) AS ticker FROM {nation} UNION ALL SELECT 'N98' AS ticker)"""
_ANTI = "SELECT count(*) FROM (SELECT {2} FROM {0} EXCEPT SELECT {2} FROM {1})"
_SEEN = "seen AS (SELECT m.date, m.ticker, s.trading_status AS st, b.ticker IS NOT NULL AS bar FROM (SELECT DISTINCT date, ticker FROM members) m LEFT JOIN status s ON s.date = m.date AND s.ticker = m.ticker LEFT JOIN (SELECT DISTINCT date, ticker FROM bars) b ON b.date = m.date AND b.ticker = m.ticker)"


_ACTIONS = dict(
    action_type="SELECT count(*) FROM actions WHERE action_type = 'bonus'", action_dates="SELECT count(*) FROM actions WHERE CAST(announcement_at AS DATE) > effective_date", action_factor="SELECT count(*) FROM actions WHERE action_type IN ('split', 'reverse_split', 'rights', 'spin_off') AND coalesce(adjustment_factor, 0) <= 0",
    action_cash="SELECT count(*) FROM actions WHERE cash_amount < 0", action_successor="SELECT count(*) FROM actions WHERE action_type IN ('merger', 'symbol_change') AND trim(successor_ticker) = ''", action_source="SELECT count(*) FROM actions WHERE trim(source_record_id) = ''",
    unique_actions="SELECT count(*) FROM (SELECT 1 FROM actions GROUP BY action_id HAVING count(*) > 1)", action_ticker_known=_ANTI.format("actions", "tickers", "ticker"),
)


@query("q10_action_domain", A.bare(_MARKET) + " " + _checks(**_ACTIONS))
def action_domain(spark, d):
    t = lambda name: A.portable(spark, d, f"{_MARKET} SELECT * FROM {name}")
    return C.corporate_actions(t("actions"), t("tickers"))


@query("q08_package", A.bare(_MARKET) + f", {_SEEN}, o AS (SELECT *, lag(effective_to) OVER (PARTITION BY instrument_id ORDER BY effective_from) AS before FROM symbols) " + _checks(
    bar_numeric_domain="SELECT count(*) FROM bars WHERE least(open, high, low, close, adjusted_close) <= 0 OR volume < 0", bar_envelope="SELECT count(*) FROM bars WHERE high + 1e-8 < greatest(open, close) OR low - 1e-8 > least(open, close) OR low > high + 1e-8",
    bar_available_on_its_day="SELECT count(*) FROM bars WHERE bar_available_at IS NULL OR CAST(bar_available_at AS DATE) <> date", bar_source="SELECT count(*) FROM bars WHERE trim(source_record_id) = ''", status_values="SELECT count(*) FROM status WHERE trading_status NOT IN ('trading', 'suspended', 'halted', 'no_trade', 'delisted', 'not_yet_listed')",
    status_available_on_its_day="SELECT count(*) FROM status WHERE CAST(status_available_at AS DATE) <> date", status_source="SELECT count(*) FROM status WHERE trim(source_record_id) = ''", session_source="SELECT count(*) FROM sessions WHERE trim(source_record_id) = ''", session_known_in_time="SELECT count(*) FROM sessions WHERE CAST(session_available_at AS DATE) > date",
    **_ACTIONS,
    symbol_intervals="SELECT count(*) FROM symbols WHERE effective_from >= effective_to", symbol_instrument="SELECT count(*) FROM symbols WHERE trim(instrument_id) = ''", symbol_source="SELECT count(*) FROM symbols WHERE trim(source_record_id) = ''", symbol_no_overlap="SELECT count(*) FROM o WHERE effective_from < before",
    member_has_status="SELECT count(*) FROM seen WHERE st IS NULL", member_is_listed="SELECT count(*) FROM seen WHERE st IN ('delisted', 'not_yet_listed')", trading_has_bar="SELECT count(*) FROM seen WHERE st = 'trading' AND NOT bar", member_observed="SELECT count(*) FROM seen WHERE NOT coalesce((st = 'trading' AND bar) OR st IN ('suspended', 'halted', 'no_trade'), false)",
    bar_grain="SELECT count(*) FROM (SELECT 1 FROM bars GROUP BY date, ticker HAVING count(*) > 1)", status_grain="SELECT count(*) FROM (SELECT 1 FROM status GROUP BY date, ticker HAVING count(*) > 1)",
    bar_ticker_known=_ANTI.format("bars", "tickers", "ticker"), ticker_has_bar=_ANTI.format("tickers", "bars", "ticker"), status_ticker_known=_ANTI.format("status", "tickers", "ticker"), symbol_ticker_known=_ANTI.format("symbols", "tickers", "ticker"), ticker_has_symbol=_ANTI.format("tickers", "symbols", "ticker"),
    session_expected=_ANTI.format("sessions", "expected", "date"), session_present=_ANTI.format("expected", "sessions", "date"), bar_on_session=_ANTI.format("bars", "sessions", "date"), status_on_session=_ANTI.format("status", "sessions", "date"),
    member_has_symbol="SELECT count(*) FROM (SELECT DISTINCT date, ticker FROM members) m WHERE NOT EXISTS (SELECT 1 FROM symbols s WHERE s.ticker = m.ticker AND s.effective_from <= m.date AND m.date < s.effective_to)",
))
def package(spark, d):
    t = lambda name: A.portable(spark, d, f"{_MARKET} SELECT * FROM {name}")
    return C.market_package(t("bars"), t("status"), t("sessions"), t("actions"), t("symbols"), t("members"), t("expected"), t("tickers"))


_COVERED = "SELECT '{0}' AS coverage, count(*) FILTER ({1}) AS covered, count(*) AS required FROM c"


@query("q08_coverage", A.bare(_MARKET) + """, c AS (SELECT m.date, m.ticker, EXISTS (SELECT 1 FROM bars b WHERE b.date = m.date AND b.ticker = m.ticker) AS bar, EXISTS (SELECT 1 FROM status s WHERE s.date = m.date AND s.ticker = m.ticker) AS st,
  EXISTS (SELECT 1 FROM status s WHERE s.date = m.date AND s.ticker = m.ticker AND trading_status IN ('suspended', 'halted', 'no_trade')) AS quiet FROM (SELECT DISTINCT date, ticker FROM members) m),
u AS (SELECT 'ticker_has_bar' AS coverage, count(*) FILTER (ticker IN (SELECT ticker FROM bars)) AS covered, count(*) AS required FROM (SELECT DISTINCT ticker FROM tickers) UNION ALL """ + " UNION ALL ".join(_COVERED.format(*x) for x in (("member_has_bar", "bar"), ("member_has_status", "st"), ("member_observed", "bar OR quiet"))) + """)
SELECT coverage, covered, required, round(covered / required, 6) + 0.0 AS share FROM u""")
def coverage(spark, d):
    t = lambda name: A.portable(spark, d, f"{_MARKET} SELECT * FROM {name}")
    return C.market_coverage(t("bars"), t("status"), t("members"), t("tickers")).withColumn("share", A.r6(F.col("share")))


@query("q07_readiness", A.bare(_MARKET) + ", c AS (SELECT m.ticker, count(*) AS required, count(b.ticker) AS covered FROM (SELECT DISTINCT date, ticker FROM members) m LEFT JOIN (SELECT DISTINCT date, ticker FROM bars) b ON b.date = m.date AND b.ticker = m.ticker GROUP BY 1) SELECT ticker, required, covered, round(covered / required::DOUBLE, 6) + 0.0 AS share, covered = required AS ready FROM c")
def readiness(spark, d):
    """Required member sessions of each ticker, and how many of them have a bar."""
    t = lambda name: A.portable(spark, d, f"{_MARKET} SELECT * FROM {name}")
    return K.member_coverage(t("members"), t("bars")).withColumn("share", A.r6(F.col("share")))


_LEDGER = """WITH c AS (SELECT p_partkey AS c FROM {part} WHERE p_partkey <= 30), f AS (SELECT CAST(n_nationkey + 1 AS INT) AS f FROM {nation} WHERE n_nationkey < 6), s AS (SELECT CAST(r_regionkey AS INT) AS s FROM {region} WHERE r_regionkey < 3),
candidates AS (SELECT concat('c', CAST(c AS STRING)) AS candidate_id FROM c), folds AS (SELECT concat('fold_0', CAST(f AS STRING)) AS fold_id FROM f), seeds AS (SELECT s AS seed FROM s),
g AS (SELECT c, f, s, (c * 31 + f * 7 + s) AS i FROM c CROSS JOIN f CROSS JOIN s),
m0 AS (SELECT CASE WHEN i % 83 = 0 THEN 'c999' ELSE concat('c', CAST(c AS STRING)) END AS candidate_id, concat('fold_0', CAST(f AS STRING)) AS fold_id, CASE WHEN i % 79 = 0 THEN 7 ELSE s END AS seed, CASE WHEN i % 41 = 0 THEN 'failed' ELSE 'complete' END AS status,
  CASE WHEN i % 53 = 0 THEN -1.5 ELSE (i % 40 - 20) / 100.0 END AS total, CASE WHEN i % 37 = 0 THEN NULL ELSE i / 100.0 END AS sharpe, CASE WHEN i % 43 = 0 THEN 0.1 WHEN i % 61 = 0 THEN -1.2 ELSE -0.2 END AS max_drawdown, CASE WHEN i % 47 = 0 THEN -0.1 ELSE 0.3 END AS turnover, CASE WHEN i % 59 = 0 THEN 0.5 ELSE -0.1 END AS equal_weight_max_drawdown, i FROM g WHERE i % 71 <> 0),
m1 AS (SELECT *, CAST(total AS DOUBLE) AS net_cumulative_return, CASE WHEN total <= -1 THEN 0.0 WHEN i % 67 = 0 THEN 0.5 ELSE ln(1 + CAST(total AS DOUBLE)) END AS net_log_return, 0.01 AS equal_weight_net_log_return, CASE WHEN i % 71 = 0 THEN NULL ELSE 0.02 END AS set_index_net_log_return FROM m0),
metrics AS (SELECT * FROM m1 UNION ALL SELECT * FROM m1 WHERE i % 73 = 0)"""
_CELLS = "SELECT candidate_id, fold_id, seed FROM candidates CROSS JOIN folds CROSS JOIN seeds"


@query("q14_metric_ledger", A.bare(_LEDGER) + " " + _checks(
    complete="SELECT count(*) FROM metrics WHERE status <> 'complete'", finite="SELECT count(*) FROM metrics WHERE sharpe IS NULL OR set_index_net_log_return IS NULL", over_total_loss="SELECT count(*) FROM metrics WHERE net_cumulative_return <= -1", log_return="SELECT count(*) FROM metrics WHERE net_cumulative_return > -1 AND abs(ln(1 + net_cumulative_return) - net_log_return) > 1e-12",
    drawdown="SELECT count(*) FROM metrics WHERE max_drawdown NOT BETWEEN -1 AND 0 OR equal_weight_max_drawdown NOT BETWEEN -1 AND 0", turnover="SELECT count(*) FROM metrics WHERE turnover < 0", unique_cells="SELECT count(*) FROM (SELECT 1 FROM metrics GROUP BY candidate_id, fold_id, seed HAVING count(*) > 1)",
    missing_cells=f"SELECT count(*) FROM ({_CELLS} EXCEPT SELECT candidate_id, fold_id, seed FROM metrics)", foreign_cells=f"SELECT count(*) FROM (SELECT candidate_id, fold_id, seed FROM metrics EXCEPT {_CELLS})",
))
def metric_ledger(spark, d):
    t = lambda name: A.portable(spark, d, f"{_LEDGER} SELECT * FROM {name}")
    m = t("metrics").select("candidate_id", "fold_id", "seed", "status", *(F.col(c).cast("double").alias(c) for c in ("net_cumulative_return", "net_log_return", "sharpe", "max_drawdown", "turnover", "equal_weight_net_log_return", "equal_weight_max_drawdown", "set_index_net_log_return")))
    return C.metric_ledger(m, t("candidates"), t("folds"), t("seeds"))


_STEPS = """WITH m AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS date FROM {orders}), n AS (SELECT date, CAST(row_number() OVER (ORDER BY date) AS INT) - 1 AS i, lead(date) OVER (ORDER BY date) AS nx FROM m),
expected AS (SELECT i AS transition_index, date AS decision_date, nx AS outcome_date FROM n WHERE nx IS NOT NULL),
b AS (SELECT r_name AS candidate, r_regionkey AS r, e.*, (transition_index * 13 + r_regionkey * 5) % 89 AS x FROM expected e CROSS JOIN {region}),
v AS (SELECT *, CAST(100000 * (1 + transition_index) AS DOUBLE) AS v0, CAST(100000 * (2 + transition_index) AS DOUBLE) AS v1 FROM b),
results AS (SELECT candidate, CASE WHEN x = 1 THEN transition_index + 500 ELSE transition_index END AS transition_index, CASE WHEN x = 2 THEN outcome_date ELSE decision_date END AS decision_date, outcome_date, CASE WHEN x = 3 THEN -0.1 ELSE 0.1 END AS turnover, CASE WHEN x = 4 THEN -0.001 ELSE 0.001 END AS transaction_cost_paid, CASE WHEN x = 5 THEN -0.0005 ELSE 0.0005 END AS slippage_paid,
  CASE WHEN x = 6 THEN 0.5 ELSE v1 / v0 - 1 + CASE WHEN x = 4 THEN -0.001 ELSE 0.001 END + CASE WHEN x = 5 THEN -0.0005 ELSE 0.0005 END END AS gross_return, CASE WHEN x = 7 THEN -1.5 ELSE v1 / v0 - 1 END AS net_return, CASE WHEN x = 8 THEN 0.001 ELSE 0.0 END AS reconciliation_error,
  CASE WHEN x = 9 THEN v0 * 1.01 ELSE v0 END AS portfolio_value_before, CASE WHEN x = 10 THEN -v1 ELSE v1 END AS portfolio_value_after, v0 AS equal_weight_value_before, CASE WHEN x = 11 THEN v1 * 1.02 WHEN x = 15 THEN -v1 ELSE v1 END AS equal_weight_value_after, CASE WHEN x = 12 THEN -2.0 ELSE v1 / v0 - 1 END AS equal_weight_net_return,
  CASE WHEN x = 13 THEN 0.0 ELSE v0 END AS set_index_value_before, v1 AS set_index_value_after, CASE WHEN x = 16 THEN -2.0 ELSE v1 / v0 - 1 END AS set_index_net_return FROM v WHERE x <> 14)"""


def _chain_sql(name, before, step, after):
    near = lambda a, b: f"abs({a} - ({b})) <= 1e-10 + 1e-12 * abs({b})"
    return {
        f"{name}_positive": f"SELECT count(*) FROM results WHERE {before} <= 0 OR {after} <= 0", f"{name}_step": f"SELECT count(*) FROM results WHERE {step} <= -1", f"{name}_reconciles": f"SELECT count(*) FROM results WHERE NOT {near(after, f'{before} * (1 + {step})')}",
        f"{name}_continuous": f"SELECT count(*) FROM (SELECT {before} AS b, lag({after}) OVER (PARTITION BY candidate ORDER BY transition_index) AS p FROM results) WHERE p IS NOT NULL AND NOT {near('b', 'p')}",
    }


@query("q15_transitions", A.bare(_STEPS).replace("(transition_index * 13", "(CAST(transition_index AS BIGINT) * 13") + " " + _checks(
    turnover="SELECT count(*) FROM results WHERE turnover < 0", cost="SELECT count(*) FROM results WHERE transaction_cost_paid < 0", slippage="SELECT count(*) FROM results WHERE slippage_paid < 0", net_return="SELECT count(*) FROM results WHERE NOT abs(net_return - (gross_return - transaction_cost_paid - slippage_paid)) <= 1e-10 + 1e-12 * abs(gross_return - transaction_cost_paid - slippage_paid)",
    self_financing="SELECT count(*) FROM results WHERE abs(reconciliation_error) > 1e-10", contiguous_index="SELECT count(*) FROM (SELECT 1 FROM results GROUP BY candidate HAVING NOT (min(transition_index) = 0 AND max(transition_index) = count(*) - 1 AND count(DISTINCT transition_index) = count(*)))",
    foreign_transition="SELECT count(*) FROM results r WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.transition_index = r.transition_index AND e.decision_date = r.decision_date AND e.outcome_date = r.outcome_date)",
    missing_transition="SELECT count(*) FROM (SELECT candidate, transition_index, decision_date, outcome_date FROM (SELECT DISTINCT candidate FROM results) CROSS JOIN expected EXCEPT SELECT candidate, transition_index, decision_date, outcome_date FROM results)",
    **_chain_sql("candidate", "portfolio_value_before", "net_return", "portfolio_value_after"), **_chain_sql("equal_weight", "equal_weight_value_before", "equal_weight_net_return", "equal_weight_value_after"), **_chain_sql("index", "set_index_value_before", "set_index_net_return", "set_index_value_after"),
))
def transition_results(spark, d):
    t = lambda name: A.portable(spark, d, f"{_STEPS} SELECT * FROM {name}")
    r = t("results")
    return C.transition_results(r.select(*(F.col(n).cast("double").alias(n) if t.simpleString().startswith("decimal") else F.col(n) for n, t in ((f.name, f.dataType) for f in r.schema.fields))), t("expected"), ["candidate"])


_PRICED = f"""WITH {A.NATION_MONTH}, v AS (SELECT date, ticker, volume % 3 <> 0 AS eligible, CASE WHEN volume % 29 = 0 THEN NULL WHEN volume % 31 = 0 THEN 0.0 ELSE close END AS close, CASE WHEN volume % 37 = 0 THEN NULL ELSE 1.0 END AS f FROM bars),
n AS (SELECT date, row_number() OVER (ORDER BY date) AS i, count(*) OVER () AS n FROM (SELECT DISTINCT date FROM bars)), x AS (SELECT v.*, i, n, count(f) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS seen, lead(coalesce(close > 0, false)) OVER (PARTITION BY ticker ORDER BY date) AS nx FROM v JOIN n USING (date)),
y AS (SELECT * FROM x WHERE i > 5 AND i < n AND eligible) """


@query("p06_valuation", _PRICED + _checks(finite_lookback="SELECT count(*) FROM y WHERE seen <> 5", price_now="SELECT count(*) FROM y WHERE NOT coalesce(close > 0, false)", price_next="SELECT count(*) FROM y WHERE NOT coalesce(nx, false)"))
def valuation(spark, d):
    """What eligible names need at each decision: features in the lookback, and prices on the day and the next."""
    b, v = A.bars_nation_month(spark, d), F.col("volume")
    gone = lambda k: F.pmod(v, F.lit(k)) == 0
    p = b.select("date", "ticker", (~gone(3)).alias("eligible"), F.when(gone(29), None).when(gone(31), 0.0).otherwise(F.col("close")).alias("close"), F.when(~gone(37), 1.0).alias("f"))
    return C.masked_valuation(p, ["f"], 5)


_SEALED = ["schema_version", "candidate", "fold_id", "transition_index", "decision_date", "net_return", "turnover"]
_BOUND = A.bare(_STEPS).replace("(transition_index * 13", "(CAST(transition_index AS BIGINT) * 13") + """, sealed AS (SELECT *, (CAST(transition_index AS BIGINT) * 7 + r) % 31 AS z FROM v) """


@query("q15_bound_results", _BOUND + _checks(
    foreign_fold_id="SELECT count(*) FROM sealed WHERE z = 3", foreign_candidate="SELECT count(*) FROM sealed WHERE candidate <> 'ASIA'", schema_version="SELECT count(*) FROM sealed WHERE z = 5", row_digest="SELECT count(*) FROM sealed WHERE z IN (7, 8, 9)",
))
def bound_results(spark, d):
    """Rows sealed by their digests, of which some are changed after that: a figure, a date, a digest itself."""
    v = A.portable(spark, d, f"{_STEPS} SELECT *, (transition_index * 7 + r) % 31 AS z FROM v")
    z, ratio = F.col("z"), (F.col("v1") / F.col("v0") - 1).cast("double")
    rows = v.select("candidate", "transition_index", "decision_date", "z", F.when(z == 3, "fold_02").otherwise("fold_01").alias("fold_id"), F.when(z == 5, "0").otherwise("1").alias("schema_version"), ratio.alias("net_return"), F.lit(0.1).alias("turnover"))
    kept = C.seal(rows, _SEALED)
    moved = kept.withColumns({"net_return": F.when(z == 7, F.col("net_return") * (1 + 2.0**-50)).otherwise(F.col("net_return")), "decision_date": F.when(z == 8, F.date_add("decision_date", 1)).otherwise(F.col("decision_date")), "result_row_sha256": F.when(z != 9, F.col("result_row_sha256"))})
    return C.bound_results(moved, {"fold_id": "fold_01", "candidate": "ASIA"}, "1", _SEALED)


@query("q32_scaler_state", "WITH s AS (SELECT p_partkey % 20 AS i, CASE WHEN p_partkey % 20 = 3 THEN 'f2' WHEN p_partkey % 20 = 4 THEN 'close' ELSE 'f' || CAST(p_partkey % 20 AS VARCHAR) END AS feature, CASE WHEN p_partkey % 20 = 5 THEN 6 ELSE p_partkey % 20 END AS pos, CASE WHEN p_partkey % 20 = 7 THEN 99 ELSE 100 END AS n, CASE WHEN p_partkey % 20 = 8 THEN NULL ELSE 1.0 END AS mean, CASE p_partkey % 20 WHEN 9 THEN 0.0 WHEN 10 THEN -1.0 WHEN 11 THEN 2.0 ELSE 1.0 END AS scale, p_partkey % 20 IN (11, 12) AS constant FROM part WHERE p_partkey <= 20) " + _checks(
    same_count="SELECT count(*) FROM s WHERE n <> 100", finite="SELECT count(*) FROM s WHERE mean IS NULL", positive_scale="SELECT count(*) FROM s WHERE scale <= 0", constant_has_unit_scale="SELECT count(*) FROM s WHERE constant AND scale <> 1", not_protected="SELECT count(*) FROM s WHERE feature IN ('close', 'volume')",
    unique_features="SELECT count(*) FROM (SELECT 1 FROM s GROUP BY feature HAVING count(*) > 1)", order="SELECT CASE WHEN count(*) = 0 OR count(DISTINCT pos) <> count(*) OR max(pos) <> count(*) - 1 THEN 1 ELSE 0 END FROM s",
))
def scaler_state(spark, d):
    """A fitted state of 20 features, several of them spoilt."""
    i = F.pmod("p_partkey", F.lit(20)).cast("int")
    s = A.table(spark, d, "part").where("p_partkey <= 20").select(
        F.when(i == 3, "f2").when(i == 4, "close").otherwise(F.concat(F.lit("f"), i.cast("string"))).alias("feature"), F.when(i == 5, 6).otherwise(i).alias("position"), F.when(i == 7, 99).otherwise(100).alias("count"),
        F.when(i != 8, 1.0).alias("mean"), F.when(i == 9, 0.0).when(i == 10, -1.0).when(i == 11, 2.0).otherwise(1.0).alias("scale"), i.isin(11, 12).alias("constant"),
    )
    return C.scaler_state(s, ["close", "volume"], 100)


_MANIFEST = """WITH y AS (SELECT DISTINCT CAST(year(o_orderdate) AS INT) AS y FROM {orders}),
manifest AS (SELECT concat('r', CAST(y AS STRING)) AS record_id, make_date(y, 1, 1) AS effective_from, CASE WHEN y = 1997 THEN make_date(y + 1, 2, 1) WHEN y = 1998 THEN make_date(y, 12, 1) WHEN y = 2000 THEN make_date(y, 1, 1) ELSE make_date(y + 1, 1, 1) END AS effective_to, CASE WHEN y = 1999 THEN make_date(y, 1, 3) ELSE make_date(y, 1, 1) END AS published_at,
  CASE y WHEN 1996 THEN 'revised' WHEN 1997 THEN 'revised' WHEN 1998 THEN 'revised' WHEN 1999 THEN 'draft' ELSE 'original' END AS revision_status, CASE y WHEN 1996 THEN 'r1995' WHEN 1997 THEN '' WHEN 1998 THEN 'r1900' ELSE NULL END AS supersedes, CASE y WHEN 1998 THEN 'announced' ELSE 'publication_date_conservative' END AS basis FROM y)"""


@query("q24_intervals", A.bare(_MANIFEST) + ", o AS (SELECT *, lag(effective_to) OVER (ORDER BY effective_from) AS before FROM manifest) " + _checks(
    positive="SELECT count(*) FROM manifest WHERE effective_from >= effective_to", published_in_time="SELECT count(*) FROM manifest WHERE published_at > effective_from", no_gap="SELECT count(*) FROM o WHERE before < effective_from", no_overlap="SELECT count(*) FROM o WHERE before > effective_from",
    revision_status="SELECT count(*) FROM manifest WHERE revision_status NOT IN ('original', 'revised')", has_predecessor="SELECT count(*) FROM manifest WHERE revision_status = 'revised' AND coalesce(trim(supersedes), '') = ''",
    predecessor_known="SELECT count(*) FROM manifest WHERE revision_status = 'revised' AND trim(supersedes) <> '' AND supersedes NOT IN (SELECT record_id FROM manifest)", publication_gated="SELECT count(*) FROM manifest WHERE revision_status = 'revised' AND basis <> 'publication_date_conservative'",
    starts_at="SELECT CASE WHEN min(effective_from) = DATE '1994-01-01' THEN 0 ELSE 1 END FROM manifest", ends_at="SELECT CASE WHEN arg_max(effective_to, effective_from) = DATE '2003-01-01' THEN 0 ELSE 1 END FROM manifest",
))
def intervals(spark, d):
    return C.intervals(A.portable(spark, d, _MANIFEST + " SELECT * FROM manifest"), "1994-01-01", "2003-01-01")


# checks of what other operators made, with planted departures


_SPLIT = f"WITH {_WK}, s AS (SELECT b.date, ticker, CASE WHEN i < floor(n * 0.6) THEN 'train' WHEN i < floor(n * 0.8) THEN 'validation' ELSE 'test' END AS split FROM bars b JOIN ds USING (date)), p AS (SELECT date, CASE WHEN split = 'train' AND dayofmonth(date) = 1 THEN 'validation' ELSE split END AS split, ticker FROM s), q AS (SELECT date, CASE WHEN split = 'validation' AND ticker = 'PROMO' THEN 'train' WHEN split = 'test' AND ticker = 'SMALL' AND dayofmonth(date) = 2 THEN 'validation' ELSE split END AS split FROM p)"


@query("q02_boundaries", _SPLIT + " " + _checks(
    dates_in_one_split="SELECT count(*) FROM (SELECT 1 FROM q GROUP BY date HAVING count(DISTINCT split) > 1)", train_before_validation="SELECT CASE WHEN max(date) FILTER (split = 'train') >= min(date) FILTER (split = 'validation') THEN 1 ELSE 0 END FROM q",
    validation_before_test="SELECT CASE WHEN max(date) FILTER (split = 'validation') >= min(date) FILTER (split = 'test') THEN 1 ELSE 0 END FROM q",
))
def boundaries(spark, d):
    """A chronological split of which some rows were moved."""
    s = L.chronological(A.bars_type_week(spark, d))
    s = s.withColumn("split", F.when((F.col("split") == "train") & (F.dayofmonth("date") == 1), "validation").otherwise(F.col("split")))
    s = s.withColumn("split", F.when((F.col("split") == "validation") & (F.col("ticker") == "PROMO"), "train").when((F.col("split") == "test") & (F.col("ticker") == "SMALL") & (F.dayofmonth("date") == 2), "validation").otherwise(F.col("split")))
    return K.boundary_checks(s, ["train", "validation", "test"])


@query("q16_sector_recompute", f"WITH {A.NATION_MONTH}, a AS (SELECT date, ticker, round(avg(close) OVER (PARTITION BY date, sector), 3) + 0.0 AS m FROM bars), s AS (SELECT date, ticker, CASE WHEN ticker = 'NATION_12' AND month(date) = 6 THEN m + 1 ELSE m END AS m FROM a WHERE NOT (ticker = 'NATION_18' AND month(date) = 2)) " + _checks(not_recomputed="SELECT count(*) FROM (SELECT * FROM s EXCEPT ALL SELECT * FROM a)", not_stored="SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM s)"))
def sector_recompute(spark, d):
    """Stored sector means, some changed and some lost, against means computed by grouping and joining back."""
    b = A.bars_nation_month(spark, d)
    again = b.join(b.groupBy("date", "sector").agg((F.round(F.avg("close"), 3) + 0.0).alias("m")), ["date", "sector"]).select("date", "ticker", "m")
    stored = b.select("date", "ticker", (F.round(F.avg("close").over(Window.partitionBy("date", "sector")), 3) + 0.0).alias("m")).where("not (ticker = 'NATION_18' and month(date) = 2)")
    stored = stored.withColumn("m", F.when((F.col("ticker") == "NATION_12") & (F.month("date") == 6), F.col("m") + 1).otherwise(F.col("m")))
    return K.same_rows(again, stored)


_LOOK = f"WITH {A.NATION_MONTH}, {A.FUNDAMENTALS}, f AS (SELECT ticker, CAST(period_end + INTERVAL 60 DAY AS DATE) AS effective, value FROM fund WHERE metric = 'high'), j AS (SELECT b.date, b.ticker, f.effective FROM bars b ASOF LEFT JOIN f ON b.ticker = f.ticker AND b.date >= f.effective), p AS (SELECT date, ticker, CASE WHEN ticker = 'NATION_6' AND month(date) = 4 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE effective END AS effective FROM j)"


@query("q17_no_look_ahead", _LOOK + " " + _checks(no_look_ahead="SELECT count(*) FROM p WHERE effective > date", within_age="SELECT count(*) FROM p WHERE effective < date - 150"))
def look_ahead(spark, d):
    """A merged table in which some rows were dated after their session."""
    f = A.fundamentals(spark, d).where("metric = 'high'").select("ticker", F.date_add("period_end", 60).alias("effective"), "value")
    j = J.asof_join(A.bars_nation_month(spark, d).select("date", "ticker"), f, ["ticker"], "date", "effective", ["value"])
    p = j.withColumn("matched_at", F.when((F.col("ticker") == "NATION_6") & (F.month("date") == 4), F.date_add("date", 1)).otherwise(F.col("matched_at")))
    return K.check_rows(p, {"no_look_ahead": F.col("matched_at").isNull() | (F.col("matched_at") <= F.col("date")), "within_age": F.col("matched_at").isNull() | (F.datediff("date", "matched_at") <= 150)})


@query("q18_merge_preserves", f"WITH {A.NATION_MONTH}, k AS (SELECT n_name AS ticker, n_regionkey AS r FROM nation WHERE n_nationkey < 20 UNION ALL SELECT n_name, 9 FROM nation WHERE n_nationkey = 3), m AS (SELECT b.date, b.ticker, b.close FROM bars b JOIN k USING (ticker)), a AS (SELECT date, ticker, close FROM bars) " + _checks(not_recomputed="SELECT count(*) FROM (SELECT * FROM m EXCEPT ALL SELECT * FROM a)", not_stored="SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM m)"))
def preserves(spark, d):
    """A merge that loses rows without a partner and repeats those with two."""
    b = A.bars_nation_month(spark, d).select("date", "ticker", "close")
    n = A.table(spark, d, "nation").select(F.col("n_name").alias("ticker"), "n_nationkey")
    keys = n.where("n_nationkey < 20").unionByName(n.where("n_nationkey = 3"))
    return K.same_rows(b, b.join(keys, "ticker").select(*b.columns))


@query("q21_calendar", f"WITH {A.TYPE_WEEK}, s AS (SELECT DISTINCT date FROM bars), c AS (SELECT CASE WHEN dayofmonth(date) = 2 THEN CAST(date + INTERVAL 5 DAY AS DATE) WHEN dayofmonth(date) = 5 THEN CAST(date + INTERVAL 7 DAY AS DATE) ELSE date END AS date FROM s WHERE dayofmonth(date) <> 3), o AS (SELECT *, lag(date) OVER (ORDER BY date) AS before FROM c) " + _checks(
    not_empty="SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM c", unique_date="SELECT count(*) FROM (SELECT 1 FROM c GROUP BY date HAVING count(*) > 1)", weekday="SELECT count(*) FROM c WHERE isodow(date) > 5", no_long_gap="SELECT count(*) FROM o WHERE date - before > 7", complete="SELECT count(*) FROM (SELECT * FROM s EXCEPT SELECT * FROM c)",
))
def calendar_contract(spark, d):
    """A calendar with a lost week, doubled dates and weekends."""
    s = A.bars_type_week(spark, d).select("date").distinct()
    day = F.dayofmonth("date")
    c = s.where(day != 3).select(F.when(day == 2, F.date_add("date", 5)).when(day == 5, F.date_add("date", 7)).otherwise(F.col("date")).alias("date"))
    return K.calendar_checks(c, s, 7)


@query("q22_schedule_recompute", _HALF + ", t AS (SELECT fold, date, CASE WHEN fold = 3 AND role = 'unused' THEN 'train' ELSE role END AS role, next_date FROM sched WHERE NOT (fold = 5 AND dayofmonth(date) = 4)) " + _checks(not_recomputed="SELECT count(*) FROM (SELECT * FROM t EXCEPT ALL SELECT * FROM sched)", not_stored="SELECT count(*) FROM (SELECT * FROM sched EXCEPT ALL SELECT * FROM t)"))
def schedule_recompute(spark, d):
    """A stored schedule with a changed role and lost dates, against the one computed from the sessions."""
    again = L.half_year_folds(A.bars_type_week(spark, d), _FOLDS)
    stored = again.where("not (fold = 5 and day(date) = 4)").withColumn("role", F.when((F.col("fold") == 3) & (F.col("role") == "unused"), "train").otherwise(F.col("role")))
    return K.same_rows(again, stored)


_RANKS = "WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k, s_acctbal FROM supplier), p AS (SELECT s_nationkey, s_suppkey, s_acctbal, CASE WHEN s_nationkey = 2 AND k = 1 THEN 0 WHEN s_nationkey = 3 AND k = 2 THEN 1 WHEN s_nationkey % 5 = 4 AND k = 1 THEN 2 WHEN s_nationkey % 5 = 4 AND k = 2 THEN 1 ELSE k END AS k FROM r)"


@query("q25_ranks", _RANKS + ", o AS (SELECT *, lag(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY k, s_suppkey) AS before FROM p) SELECT s_nationkey, count(*) AS n, min(k) = 1 AND max(k) = count(*) AND count(DISTINCT k) = count(*) AS complete, count(*) FILTER (before < s_acctbal) AS out_of_order FROM o GROUP BY 1")
def ranks(spark, d):
    """Stored ranks with a wrong start, ties and swapped places."""
    w = Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")
    n, s = F.col("s_nationkey"), A.table(spark, d, "supplier").withColumn("k", F.row_number().over(w))
    k, swap = F.col("k"), F.pmod("s_nationkey", F.lit(5)) == 4
    p = s.withColumn("k", F.when((n == 2) & (k == 1), 0).when((n == 3) & (k == 2), 1).when(swap & (k == 1), 2).when(swap & (k == 2), 1).otherwise(k))
    return K.rank_checks(p, ["s_nationkey"], "k", "s_acctbal", "s_suppkey")


@query("q27_eligibility_contract", f"WITH {A.NATION_MONTH}, x AS (SELECT date, ticker, volume % 5 <> 0 AS member, volume > 3 AS has_bar, volume % 7 <> 0 AS history, volume FROM bars WHERE NOT (ticker = 'NATION_14' AND month(date) = 3)), e AS (SELECT *, CASE WHEN volume % 11 = 0 THEN NULL WHEN volume % 13 = 0 THEN true ELSE member AND has_bar AND history END AS eligible FROM x) " + _checks(
    conjunction="SELECT count(*) FROM e WHERE eligible IS DISTINCT FROM (member AND has_bar AND history)", known="SELECT count(*) FROM e WHERE eligible IS NULL", dense="SELECT CASE WHEN count(*) = count(DISTINCT date) * count(DISTINCT ticker) THEN 0 ELSE 1 END FROM e",
))
def eligibility_contract(spark, d):
    """Stored flags of which some are unknown, some set without their reasons, and some keys lost."""
    v = F.col("volume")
    rule = (F.pmod(v, F.lit(5)) != 0, v > 3, F.pmod(v, F.lit(7)) != 0)
    e = A.bars_nation_month(spark, d).where("not (ticker = 'NATION_14' and month(date) = 3)").select("date", "ticker", *(c.alias(n) for c, n in zip(rule, ("member", "has_bar", "history"), strict=True)), F.when(F.pmod(v, F.lit(11)) == 0, None).when(F.pmod(v, F.lit(13)) == 0, True).otherwise(rule[0] & rule[1] & rule[2]).alias("eligible"))
    size = e.agg(F.count("*").alias("n"), F.count_distinct("date").alias("a"), F.count_distinct("ticker").alias("b"))
    both = K.check_rows(e, {"conjunction": F.col("eligible").eqNullSafe(F.col("member") & F.col("has_bar") & F.col("history")), "known": F.col("eligible").isNotNull()})
    return both.unionByName(K.count_check("dense", size.where("n != a * b")))


@query("q19_trials", "WITH t AS (SELECT CASE WHEN c_custkey % 50 = 0 THEN 'a' ELSE c_name END AS trial, CASE WHEN c_custkey % 17 = 0 THEN NULL WHEN c_custkey % 19 = 0 THEN 'nan'::DOUBLE WHEN c_custkey % 23 = 0 THEN 'inf'::DOUBLE ELSE c_acctbal END AS v FROM customer) " + _checks(finite="SELECT count(*) FROM t WHERE v IS NULL OR NOT isfinite(v)", unique_trial="SELECT count(*) FROM (SELECT 1 FROM t GROUP BY trial HAVING count(*) > 1)"))
def trials(spark, d):
    """Objectives that are null, no number or infinite, and repeated trials."""
    n = lambda k: F.pmod("c_custkey", F.lit(k)) == 0
    t = A.table(spark, d, "customer").select(F.when(n(50), "a").otherwise(F.col("c_name")).alias("trial"), F.when(n(17), None).when(n(19), float("nan")).when(n(23), float("inf")).otherwise(F.col("c_acctbal")).alias("v"))
    return K.check_rows(t, {"finite": F.col("v").isNotNull() & ~F.isnan("v") & (F.abs("v") < float("inf"))}).unionByName(K.count_check("unique_trial", K.repeated_keys(t, ["trial"])))


@query("q29_failed_checks", "SELECT 'finite: ' || count(*) FILTER (c_custkey % 17 = 0) || '; positive: ' || count(*) FILTER (c_acctbal <= 0 OR c_custkey % 17 = 0) AS message FROM customer")
def failed_checks(spark, d):
    """The message that assert_checks raises: all failed checks in one line."""
    v = F.when(F.pmod("c_custkey", F.lit(17)) != 0, F.col("c_acctbal"))
    return K.failure_message(K.check_rows(A.table(spark, d, "customer"), {"positive": v > 0, "finite": v.isNotNull(), "fine": F.lit(True)}))


QUERIES = Q
