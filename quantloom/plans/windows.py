"""Ordered features (W) over the derived panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..operators import windows as W

_TECH = A.TYPE_WEEK + """,
s AS (SELECT *, lag(close) OVER w AS p1, lag(close, 5) OVER w AS p5, lag(close, 20) OVER w AS p20 FROM bars WINDOW w AS (PARTITION BY ticker ORDER BY date)),
t AS (SELECT *, coalesce(close / nullif(p1, 0) - 1, 0) AS r1, coalesce(close / nullif(p5, 0) - 1, 0) AS r5, coalesce(close / nullif(p20, 0) - 1, 0) AS r20,
  close - p1 AS step, greatest(high - low, abs(high - p1), abs(low - p1)) AS tr FROM s),
u AS (SELECT *, CASE WHEN count(r1) OVER w20 >= 2 THEN stddev_samp(r1) OVER w20 END AS vol, avg(close) OVER w10 AS m10, avg(close) OVER w30 AS m30, avg(close) OVER w20 AS m20, stddev_samp(close) OVER w20 AS s20,
  CASE WHEN count(step) OVER w14 >= 14 THEN avg(greatest(step, 0)) FILTER (step IS NOT NULL) OVER w14 END AS up, CASE WHEN count(step) OVER w14 >= 14 THEN avg(greatest(-step, 0)) FILTER (step IS NOT NULL) OVER w14 END AS down,
  CASE WHEN count(tr) OVER w14 >= 2 THEN avg(tr) OVER w14 END AS atr, avg(volume) OVER w20 AS mv FROM t
  WINDOW w10 AS (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING), w14 AS (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING), w20 AS (PARTITION BY ticker ORDER BY date ROWS 19 PRECEDING), w30 AS (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING)),
tech AS (SELECT date, ticker, close, volume, round(r1, 6) + 0.0 AS return_1d, round(r5, 6) + 0.0 AS return_5d, round(r20, 6) + 0.0 AS return_20d, round(coalesce(vol, 0), 6) + 0.0 AS volatility_20d,
  round(coalesce(close / nullif(m10, 0) - 1, 0), 6) + 0.0 AS ma_ratio_10, round(coalesce(close / nullif(m30, 0) - 1, 0), 6) + 0.0 AS ma_ratio_30, round(coalesce((100 - 100 / (1 + up / nullif(down, 0))) / 100, 0.5), 6) + 0.0 AS rsi_14,
  round(coalesce((close - m20) / nullif(s20, 0), 0), 6) + 0.0 AS bollinger_z, round(coalesce(coalesce(atr, 0) / nullif(close, 0), 0), 6) + 0.0 AS atr_14, round(coalesce(volume / nullif(mv, 0) - 1, 0), 6) + 0.0 AS volume_ratio_20 FROM u)"""
_FEATURES = ("return_1d", "return_5d", "return_20d", "volatility_20d", "ma_ratio_10", "ma_ratio_30", "rsi_14", "bollinger_z", "atr_14", "volume_ratio_20")


def _tech(columns):
    def run(spark, d):
        return W.technical_features(A.bars_type_week(spark, d)).select("date", "ticker", *(r6(F.col(c)).alias(c) for c in columns))

    return run, f"WITH {_TECH} SELECT date, ticker, {', '.join(columns)} FROM tech"


def feature_panel(spark, d):
    full = W.technical_features(A.bars_type_week(spark, d))
    return full.select("date", "ticker", "close", "volume", *(r6(F.col(c)).alias(c) for c in _FEATURES))


def macd(spark, d):
    e = W.with_ema(A.bars_type_week(spark, d).select("date", "ticker", "close"), (12, 26))
    return e.select("date", "ticker", r6(F.col("ema_12")).alias("ema_12"), r6(F.col("ema_26")).alias("ema_26"), r6(F.coalesce(F.try_divide(F.col("ema_12") - F.col("ema_26"), F.col("close")), F.lit(0.0))).alias("macd"))


_MACD = f"""WITH RECURSIVE {A.TYPE_WEEK},
n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars),
e AS (SELECT date, ticker, close, i, close AS a, close AS b FROM n WHERE i = 1
  UNION ALL SELECT n.date, n.ticker, n.close, n.i, e.a * (1 - 2.0 / 13) + n.close * (2.0 / 13), e.b * (1 - 2.0 / 27) + n.close * (2.0 / 27) FROM n JOIN e ON n.ticker = e.ticker AND n.i = e.i + 1)
SELECT date, ticker, round(a, 6) + 0.0 AS ema_12, round(b, 6) + 0.0 AS ema_26, round(coalesce((a - b) / nullif(close, 0), 0), 6) + 0.0 AS macd FROM e"""


def index_context(spark, d):
    """The summed price as an index, known in weeks of at least the mean trade, carried forward, with a flag where it was seen."""
    bars = A.bars_type_week(spark, d)
    weeks = bars.groupBy("date").agg(r6(F.sum("close")).alias("index_close"), F.sum("volume").alias("v"))
    index = weeks.crossJoin(F.broadcast(weeks.agg(F.avg("v").alias("m")))).where("v >= m").select("date", "index_close")
    dates = weeks.select("date").join(index, "date", "left").withColumn("name", F.lit("all")).withColumn("index_available", F.when(F.col("index_close").isNotNull(), 1.0).otherwise(0.0))
    full = W.index_features(dates, "index_close", by="name")
    names = ["return_1d", "return_5d", "return_20d", "volatility_20d", "ma_ratio_20"]
    named = full.select("date", "index_available", r6(F.coalesce("level", F.lit(0.0))).alias("index_level"), *(r6(F.col(c)).alias(f"index_{c}") for c in names))
    return bars.select("date", "ticker").join(F.broadcast(named), "date").withColumn("market_return_1d", F.col("index_return_1d"))


_RC = lambda n: f"coalesce(close / nullif(lag(close, {n}) OVER (ORDER BY date), 0) - 1, 0) AS r{n}"
_INDEX = f"""WITH {A.TYPE_WEEK},
k AS (SELECT date, round(sum(close), 6) + 0.0 AS c, sum(volume) AS v FROM bars GROUP BY 1), x AS (SELECT date, c FROM k WHERE v >= (SELECT avg(v) FROM k)),
f AS (SELECT date, c, last_value(c IGNORE NULLS) OVER (ORDER BY date) AS close FROM (SELECT date FROM k) LEFT JOIN x USING (date)),
g AS (SELECT *, {_RC(1)}, {_RC(5)}, {_RC(20)} FROM f),
h AS (SELECT date, CASE WHEN c IS NULL THEN 0.0 ELSE 1.0 END AS index_available, round(coalesce(close, 0.0), 6) + 0.0 AS index_level, round(r1, 6) + 0.0 AS index_return_1d, round(r5, 6) + 0.0 AS index_return_5d, round(r20, 6) + 0.0 AS index_return_20d,
  round(coalesce(CASE WHEN count(r1) OVER w20 >= 2 THEN stddev_samp(r1) OVER w20 END, 0), 6) + 0.0 AS index_volatility_20d, round(coalesce(close / nullif(avg(close) OVER w20, 0) - 1, 0), 6) + 0.0 AS index_ma_ratio_20 FROM g
  WINDOW w20 AS (ORDER BY date ROWS 19 PRECEDING))
SELECT date, ticker, CAST(index_available AS DOUBLE) AS index_available, index_level, index_return_1d, index_return_5d, index_return_20d, index_volatility_20d, index_ma_ratio_20, index_return_1d AS market_return_1d FROM bars JOIN h USING (date)"""


def macro_changes(spark, d):
    m = A.macro_daily(spark, d)
    w = W.ordered("name")
    full = W.with_returns(m, (1, 5), by="name")
    return full.select("date", "name", "close", r6(F.coalesce(F.col("close") - F.lag("close").over(w), F.lit(0.0))).alias("diff_1d"), r6(F.col("return_1d")).alias("return_1d"), r6(F.col("return_5d")).alias("return_5d"), r6(W.volatility("return_1d", 20, "name")).alias("volatility_20d"))


_MACRO = f"""WITH {A.MACRO_DAILY}, r AS (SELECT *, close - lag(close) OVER w AS df, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS r1, coalesce(close / nullif(lag(close, 5) OVER w, 0) - 1, 0) AS r5 FROM macro WINDOW w AS (PARTITION BY name ORDER BY date))
SELECT date, name, close, round(coalesce(df, 0), 6) + 0.0 AS diff_1d, round(r1, 6) + 0.0 AS return_1d, round(r5, 6) + 0.0 AS return_5d, round(coalesce(CASE WHEN count(r1) OVER w >= 2 THEN stddev_samp(r1) OVER w END, 0), 6) + 0.0 AS volatility_20d
FROM r WINDOW w AS (PARTITION BY name ORDER BY date ROWS 19 PRECEDING)"""


def sector_context(spark, d):
    b = W.with_returns(A.bars_nation_month(spark, d), (1,))
    w = Window.partitionBy("date", "sector")
    mean = F.avg("return_1d").over(w)
    return b.select("date", "ticker", "sector", r6(F.col("return_1d")).alias("return_1d"), r6(mean).alias("sector_mean_return"), F.count("*").over(w).alias("sector_peers"), r6(F.col("return_1d") - mean).alias("sector_relative_return"))


_NM_R = A.NATION_MONTH + ", r AS (SELECT *, coalesce(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS r1 FROM bars)"
_SECTOR = f"""WITH {_NM_R} SELECT date, ticker, sector, round(r1, 6) + 0.0 AS return_1d, round(avg(r1) OVER w, 6) + 0.0 AS sector_mean_return, count(*) OVER w AS sector_peers, round(r1 - avg(r1) OVER w, 6) + 0.0 AS sector_relative_return
FROM r WINDOW w AS (PARTITION BY date, sector)"""


def peer_ex_self(spark, d):
    b = W.with_returns(A.bars_nation_month(spark, d), (1,)).withColumn("active", F.pmod("volume", F.lit(7)) != 0)
    mean, n = W.peer_mean("return_1d", "active", ("date", "sector"))
    total = F.count_if("active").over(Window.partitionBy("date", "sector")) - F.col("active").cast("int")
    return b.select("date", "ticker", "sector", "active", r6(F.coalesce(mean, F.lit(0.0))).alias("peer_return"), n.cast("long").alias("contributors"), mean.isNotNull().cast("double").alias("peer_available"), r6(F.coalesce(F.try_divide(n, total), F.lit(0.0))).alias("peer_coverage"))


_PEER = f"""WITH {_NM_R}, a AS (SELECT *, volume % 7 <> 0 AS active FROM r),
s AS (SELECT *, coalesce(sum(r1) FILTER (active) OVER w, 0) - CASE WHEN active THEN r1 ELSE 0 END AS others, count(*) FILTER (active) OVER w - CAST(active AS INT) AS n FROM a WINDOW w AS (PARTITION BY date, sector))
SELECT date, ticker, sector, active, round(coalesce(others / nullif(n, 0), 0), 6) + 0.0 AS peer_return, CAST(n AS BIGINT) AS contributors, CAST(n > 0 AS DOUBLE) AS peer_available, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS peer_coverage FROM s"""


def flow_features(spark, d):
    f = W.flow_features(A.flows(spark, d))
    return f.select("date", "investor_type", *(r6(F.col(c)).alias(c) for c in ("net_share", "net_5d", "net_20d", "net_z60")))


_FLOW = f"""WITH {A.FLOWS}, m AS (SELECT date, nullif(sum(buy_value), 0) AS market FROM flow GROUP BY 1), g AS (SELECT m.date, t.investor_type, market, f.buy_value - f.sell_value AS net FROM m CROSS JOIN (SELECT DISTINCT investor_type FROM flow) t LEFT JOIN flow f ON f.date = m.date AND f.investor_type = t.investor_type),
s AS (SELECT *, net / market AS share FROM g)
SELECT date, investor_type, round(share, 6) + 0.0 AS net_share, round(CASE WHEN count(net) OVER w5 = 5 AND count(market) OVER w5 = 5 THEN sum(net) OVER w5 / nullif(sum(market) OVER w5, 0) END, 6) + 0.0 AS net_5d,
  round(CASE WHEN count(net) OVER w20 = 20 AND count(market) OVER w20 = 20 THEN sum(net) OVER w20 / nullif(sum(market) OVER w20, 0) END, 6) + 0.0 AS net_20d,
  round(CASE WHEN count(share) OVER z >= 20 THEN (share - avg(share) OVER z) / nullif(stddev_pop(share) OVER z, 0) END, 6) + 0.0 AS net_z60 FROM s
WINDOW w5 AS (PARTITION BY investor_type ORDER BY date ROWS 4 PRECEDING), w20 AS (PARTITION BY investor_type ORDER BY date ROWS 19 PRECEDING), z AS (PARTITION BY investor_type ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""


def lagged_z(spark, d):
    return A.bars_type_week(spark, d).select("date", "ticker", r6(W.lagged_z("close", 60)).alias("z"))


_Z = f"""WITH {A.TYPE_WEEK} SELECT date, ticker, round(coalesce(CASE WHEN count(close) OVER z >= 20 THEN (close - avg(close) OVER z) / nullif(stddev_pop(close) OVER z, 0) END, 0), 6) + 0.0 AS z
FROM bars WINDOW z AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING)"""


def growth(spark, d):
    f = A.fundamentals(spark, d).withColumn("key", F.concat_ws("/", "ticker", "metric"))
    return W.with_returns(f, (1,), "value", "key", "period_end").select("ticker", "metric", "period_end", "value", r6(F.col("return_1d")).alias("growth_qoq"))


_GROWTH = f"""WITH {A.FUNDAMENTALS} SELECT ticker, metric, period_end, value, round(coalesce(value / nullif(lag(value) OVER (PARTITION BY ticker, metric ORDER BY period_end), 0) - 1, 0), 6) + 0.0 AS growth_qoq FROM fund"""


def eligibility_history(spark, d):
    b = A.bars_type_week(spark, d).withColumn("valid", (F.col("close") > 0) & (F.pmod("volume", F.lit(11)) != 0))
    return b.select("date", "ticker", "valid", W.history_complete("valid", 10).alias("history_10"))


_HIST = f"""WITH {A.TYPE_WEEK}, v AS (SELECT *, close > 0 AND volume % 11 <> 0 AS valid FROM bars)
SELECT date, ticker, valid, count(*) OVER z = 10 AND coalesce(sum(CAST(valid AS INT)) OVER z, 0) = 10 AS history_10 FROM v WINDOW z AS (PARTITION BY ticker ORDER BY date ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"""


def drawdown(spark, d):
    return W.with_drawdown(A.curves(spark, d)).select("date", "policy", "value", r6(F.col("drawdown")).alias("drawdown"))


_DD = f"WITH {A.CURVES} SELECT date, policy, value, round(value / max(value) OVER (PARTITION BY policy ORDER BY date) - 1, 6) + 0.0 AS drawdown FROM curve"


def exits(spark, d):
    b = A.bars_nation_month(spark, d).withColumn("member", F.pmod("volume", F.lit(5)) != 0)
    return b.withColumn("before", F.lag("member").over(W.ordered())).where("before and not member").select("date", "ticker")


_EXITS = f"""WITH {A.NATION_MONTH}, m AS (SELECT *, volume % 5 <> 0 AS member, lag(volume % 5 <> 0) OVER (PARTITION BY ticker ORDER BY date) AS before FROM bars) SELECT date, ticker FROM m WHERE before AND NOT member"""


def forward_returns(spark, d):
    return A.bars_type_week(spark, d).select("date", "ticker", r6(W.forward_return("close", 21)).alias("target_21")).where("target_21 is not null")


_FWD = f"""WITH {A.TYPE_WEEK}, f AS (SELECT date, ticker, round(lead(close, 21) OVER (PARTITION BY ticker ORDER BY date) / nullif(close, 0) - 1, 6) + 0.0 AS target_21 FROM bars) SELECT * FROM f WHERE target_21 IS NOT NULL"""


def volatile_episodes(spark, d):
    """Candidates by falling volatility of the mean return; the greedy choice works on one row a date."""
    b = W.with_returns(A.bars_type_week(spark, d), (1,))
    mean = b.groupBy("date").agg(F.avg("return_1d").alias("m")).withColumn("g", F.lit(0))
    vol = mean.withColumn("v", r6(F.when(F.count("m").over(W.last_rows(20, "g")) >= 20, F.stddev_samp("m").over(W.last_rows(20, "g"))))).where("v is not null")

    def choose(rows):
        rows, taken = rows.sort_values(["v", "date"], ascending=[False, True]), []
        for i, day in zip(rows.index, rows["date"], strict=True):
            if all(abs((day - t).days) >= 140 for _, t in taken):
                taken.append((i, day))
            if len(taken) == 5:
                break
        out = rows.loc[[i for i, _ in taken]].copy()
        out["rank"] = range(1, len(out) + 1)
        return out[["date", "v", "rank"]]

    return vol.groupBy("g").applyInPandas(choose, "date date, v double, rank long").withColumnRenamed("v", "volatility")


_EPISODES = f"""WITH RECURSIVE {A.TYPE_WEEK}, r AS (SELECT date, coalesce(close / nullif(lag(close) OVER (PARTITION BY ticker ORDER BY date), 0) - 1, 0) AS r FROM bars), m AS (SELECT date, avg(r) AS m FROM r GROUP BY 1),
x AS (SELECT date, count(m) OVER w AS n, stddev_samp(m) OVER w AS v FROM m WINDOW w AS (ORDER BY date ROWS 19 PRECEDING)), vol AS (SELECT date, round(v, 6) + 0.0 AS v FROM x WHERE n >= 20),
pick AS (SELECT 1 AS rank, max({{'v': v, 'd': -epoch(date)}}) AS best, [max({{'v': v, 'd': -epoch(date)}})] AS taken FROM vol
  UNION ALL SELECT rank + 1, (SELECT max({{'v': v, 'd': -epoch(date)}}) FROM vol WHERE len(list_filter(taken, lambda t: abs(t.d + epoch(date)) < 140 * 86400)) = 0), list_append(taken, (SELECT max({{'v': v, 'd': -epoch(date)}}) FROM vol WHERE len(list_filter(taken, lambda t: abs(t.d + epoch(date)) < 140 * 86400)) = 0)) FROM pick WHERE rank < 5)
SELECT CAST(make_timestamp(CAST(-best.d * 1000000 AS BIGINT)) AS DATE) AS date, best.v AS volatility, CAST(rank AS BIGINT) AS rank FROM pick WHERE best IS NOT NULL"""


def contiguity(spark, d):
    b = A.bars_nation_month(spark, d).select("ticker", F.col("date").alias("start"), F.add_months("date", 1).alias("end"))
    w = Window.partitionBy("ticker").orderBy("start")
    return b.withColumn("before", F.lag("end").over(w)).where("before is not null and before != start").select("ticker", "start", "before", F.when(F.col("before") < F.col("start"), "gap").otherwise("overlap").alias("kind"))


_CONT = f"""WITH {A.NATION_MONTH}, c AS (SELECT ticker, date AS start, CAST(lag(date) OVER (PARTITION BY ticker ORDER BY date) + INTERVAL 1 MONTH AS DATE) AS before FROM bars)
SELECT ticker, start, before, CASE WHEN before < start THEN 'gap' ELSE 'overlap' END AS kind FROM c WHERE before IS NOT NULL AND before <> start"""


def value_chain(spark, d):
    c = A.curves(spark, d)
    before = F.lag("value").over(W.ordered("policy"))
    claimed = F.when(F.pmod(F.month("date"), F.lit(6)) == 0, before * 1.01).otherwise(before)
    return c.withColumns({"after_before": before, "claimed": claimed}).where("after_before is not null").select("date", "policy", (F.abs(F.col("claimed") - F.col("after_before")) <= 1e-9 * F.abs("after_before")).alias("continuous"))


_CHAIN = f"""WITH {A.CURVES}, c AS (SELECT *, lag(value) OVER (PARTITION BY policy ORDER BY date) AS b FROM curve) SELECT date, policy, abs(CASE WHEN month(date) % 6 = 0 THEN b * 1.01 ELSE b END - b) <= 1e-9 * abs(b) AS continuous FROM c WHERE b IS NOT NULL"""


def crossover_signal(spark, d):
    b = A.bars_type_week(spark, d).withColumn("on", W.crossover())
    n = F.count_if("on").over(Window.partitionBy("date"))
    return b.select("date", "ticker", r6(F.when(F.col("on"), 1 / n).otherwise(0.0)).alias("weight"))


_CROSS = f"""WITH {A.TYPE_WEEK}, s AS (SELECT date, ticker, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING) > avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 29 PRECEDING) AS sig FROM bars)
SELECT date, ticker, round(CASE WHEN sig THEN 1.0::DOUBLE / count(*) FILTER (sig) OVER (PARTITION BY date) ELSE 0.0 END, 6) + 0.0 AS weight FROM s"""


def lookback(spark, d):
    b = A.bars_type_week(spark, d)
    both = b.withColumns({"seen": W.lookback("close", 5), "padded": W.lookback("close", 5, pad=True)})
    return both.select("date", "ticker", F.size("seen").cast("long").alias("n_seen"), F.array_join(F.transform("padded", lambda x: F.round(x * 1000).cast("long").cast("string")), ",").alias("padded"))


_LOOK = f"""WITH {A.TYPE_WEEK}, l AS (SELECT date, ticker, coalesce(list(close) OVER (PARTITION BY ticker ORDER BY date ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING), []) AS seen FROM bars)
SELECT date, ticker, CAST(len(seen) AS BIGINT) AS n_seen, array_to_string(list_transform(list_concat(list_transform(range(5 - len(seen)), lambda i: 0.0::DOUBLE), seen), lambda x: CAST(CAST(round(x * 1000) AS BIGINT) AS VARCHAR)), ',') AS padded FROM l"""


def prototype_indicators(spark, d):
    b = A.bars_type_week(spark, d).select("date", "ticker", "close", "high", "low")
    e = W.with_ema(b, (10,))
    low, high = F.min("low").over(W.last_rows(14)), F.max("high").over(W.last_rows(14))
    return e.select("date", "ticker", r6(F.avg("close").over(W.last_rows(10)) + 1e-9).alias("sma_10"), r6(F.avg("close").over(W.last_rows(50)) + 1e-9).alias("sma_50"), r6(F.col("ema_10")).alias("ema_10"), r6(F.coalesce(F.try_divide(100 * (F.col("close") - low), high - low), F.lit(50.0))).alias("stochastic_14"))


_PROTO = f"""WITH RECURSIVE {A.TYPE_WEEK}, n AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY date) AS i FROM bars),
e AS (SELECT date, ticker, i, close AS a FROM n WHERE i = 1 UNION ALL SELECT n.date, n.ticker, n.i, e.a * (1 - 2.0 / 11) + n.close * (2.0 / 11) FROM n JOIN e ON n.ticker = e.ticker AND n.i = e.i + 1),
m AS (SELECT date, ticker, close, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 9 PRECEDING) AS s10, avg(close) OVER (PARTITION BY ticker ORDER BY date ROWS 49 PRECEDING) AS s50,
  min(low) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) AS lo, max(high) OVER (PARTITION BY ticker ORDER BY date ROWS 13 PRECEDING) AS hi FROM bars)
SELECT date, ticker, round(s10 + 1e-9, 6) + 0.0 AS sma_10, round(s50 + 1e-9, 6) + 0.0 AS sma_50, round(a, 6) + 0.0 AS ema_10, round(coalesce(100 * (close - lo) / nullif(hi - lo, 0), 50), 6) + 0.0 AS stochastic_14 FROM m JOIN e USING (date, ticker)"""

QUERIES = {
    "feature_panel": (feature_panel, f"WITH {_TECH} SELECT * FROM tech"),
    "w01_returns": _tech(_FEATURES[:3]), "w02_volatility": _tech(("volatility_20d",)), "w03_ma_ratio": _tech(("ma_ratio_10", "ma_ratio_30")), "w04_rsi": _tech(("rsi_14",)),
    "w05_bollinger_z": _tech(("bollinger_z",)), "w06_atr": _tech(("atr_14",)), "w07_macd": (macd, _MACD), "w08_volume_ratio": _tech(("volume_ratio_20",)),
    "w09_index_context": (index_context, _INDEX), "w11_macro_changes": (macro_changes, _MACRO), "w12_sector_context": (sector_context, _SECTOR), "w13_peer_ex_self": (peer_ex_self, _PEER),
    "w14_flow_features": (flow_features, _FLOW), "w15_lagged_z": (lagged_z, _Z), "w16_growth": (growth, _GROWTH), "w17_history": (eligibility_history, _HIST), "w18_drawdown": (drawdown, _DD),
    "w19_exits": (exits, _EXITS), "w20_forward_return": (forward_returns, _FWD), "w21_volatile_episodes": (volatile_episodes, _EPISODES), "w22_contiguity": (contiguity, _CONT), "w23_value_chain": (value_chain, _CHAIN),
    "w24_crossover": (crossover_signal, _CROSS), "w25_lookback": (lookback, _LOOK), "w27_prototype_indicators": (prototype_indicators, _PROTO),
}
