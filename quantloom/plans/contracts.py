"""Composed operators: package and panel contracts, pairings, selections and suites."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .. import adapters as A
from ..adapters import r6
from ..functions import scalars as S
from ..operators import asof as J
from ..operators import grid as G
from ..operators import metrics as M
from ..operators import portfolio as P
from ..operators import quality as K
from ..operators import splits as L
from ..operators import windows as W
from ..sources import ingest as N
from ..streaming import manifest
from .checks import _checks
from .studies import _FOLDS, _HALF, _M01, _RET, _SIM, _WK, returns_month

Q: dict = {}


def query(name: str, sql: str | None):
    def add(f):
        Q[name] = (f, sql)
        return f

    return add


def T(spark, d, name):
    return A.table(spark, d, name)


_A14 = f"WITH {A.NEWS}, u AS (SELECT upper(trim(ticker)) AS ticker, date, CASE WHEN doc_id % 4 = 0 THEN NULL ELSE doc_id % 5 / 4.0::DOUBLE END AS score, CASE WHEN doc_id % 6 = 0 THEN '' ELSE trim(substr(text, 1, 5)) END AS title, CASE WHEN doc_id % 3 = 0 THEN ' ' ELSE trim(substr(text, 1, 2)) END AS text, doc_id FROM news), v AS (SELECT *, CASE WHEN trim(text) <> '' THEN trim(text) ELSE trim(title) END AS t FROM u)"


@query("a14_sentiment_rows", _A14 + " SELECT ticker, date, title, t AS text, score AS sentiment_score FROM v WHERE score IS NOT NULL OR t <> '' QUALIFY row_number() OVER (PARTITION BY ticker, date, title, t ORDER BY doc_id) = 1")
def sentiment_rows(spark, d):
    """A row needs a text or a score; of rows with the same ticker, time, title and text the first stays."""
    n = A.news(spark, d).select(F.lower("ticker").alias("ticker"), "date", F.when(F.pmod("doc_id", F.lit(4)) != 0, F.pmod("doc_id", F.lit(5)) / 4.0).alias("sentiment_score"), F.when(F.pmod("doc_id", F.lit(6)) == 0, "").otherwise(F.substring("text", 1, 5)).alias("title"), F.when(F.pmod("doc_id", F.lit(3)) == 0, " ").otherwise(F.substring("text", 1, 2)).alias("text"), "doc_id")
    return N.sentiment_rows(n, "date", "doc_id").select("ticker", "date", "title", "text", "sentiment_score")


@query("a14_rejected_rows", _A14 + """ SELECT 'text_or_score' AS "check", count(*) = 0 AS passed, count(*) AS failures FROM v WHERE score IS NULL AND coalesce(t, '') = ''""")
def rejected_rows(spark, d):
    n = A.news(spark, d).select(F.when(F.pmod("doc_id", F.lit(4)) != 0, F.lit(1.0)).alias("sentiment_score"), F.when(F.pmod("doc_id", F.lit(6)) == 0, "").otherwise(F.substring("text", 1, 5)).alias("title"), F.when(F.pmod("doc_id", F.lit(3)) == 0, " ").otherwise(F.substring("text", 1, 2)).alias("text"))
    return K.check_rows(n, {"text_or_score": F.col("sentiment_score").isNotNull() | (N.joined_text() != "")})


@query("a19_month_history", f"WITH {A.MACRO_DAILY}, m AS (SELECT name AS metric, CAST(date_trunc('month', date) AS DATE) AS period, count(*) AS days FROM macro GROUP BY 1, 2) SELECT metric, period, CASE WHEN days < 28 THEN 'provisional' ELSE 'final' END AS revision FROM m")
def month_history(spark, d):
    m = A.macro_daily(spark, d).groupBy(F.col("name").alias("metric"), F.date_trunc("month", "date").cast("date").alias("period")).agg(F.count("*").alias("days"))
    return m.select("metric", "period", F.when(F.col("days") < 28, "provisional").otherwise("final").alias("revision"))


@query("c02_one_to_one", "SELECT n_nationkey, n_name, s.k AS suppliers, c.k AS customers FROM nation LEFT JOIN (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY 1) s ON n_nationkey = s_nationkey LEFT JOIN (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1) c ON n_nationkey = c_nationkey")
def one_to_one(spark, d):
    s = T(spark, d, "supplier").groupBy(F.col("s_nationkey").alias("n_nationkey")).agg(F.count("*").alias("suppliers"))
    c = T(spark, d, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("customers"))
    return J.many_to_one(J.many_to_one(T(spark, d, "nation").select("n_nationkey", "n_name"), s, ["n_nationkey"]), c, ["n_nationkey"])


@query("c04_candidate_control", f"WITH {_RET} SELECT a.date, a.ticker, round(a.r - b.r, 6) + 0.0 AS difference FROM ret a JOIN ret b ON a.date = b.date AND b.ticker = 'NATION_12' WHERE a.ticker IN ('NATION_18', 'NATION_8')")
def control(spark, d):
    r = returns_month(spark, d).select("date", "ticker", "r")
    base = r.where("ticker = 'NATION_12'").select("date", F.col("r").alias("b"))
    return r.where("ticker in ('NATION_18', 'NATION_8')").join(base, "date").select("date", "ticker", r6(F.col("r") - F.col("b")).alias("difference"))


@query("c17_aligned", f"WITH {A.CURVES} SELECT a.date, a.value AS candidate, b.value AS benchmark FROM curve a JOIN curve b USING (date) WHERE a.policy = 'HOUSEHOLD' AND b.policy = 'BUILDING'")
def aligned(spark, d):
    c = A.curves(spark, d)
    return c.where("policy = 'HOUSEHOLD'").select("date", F.col("value").alias("candidate")).join(c.where("policy = 'BUILDING'").select("date", F.col("value").alias("benchmark")), "date")


@query("c19_mapped", f"WITH {A.TYPE_WEEK}, m AS (SELECT date, CAST(sum(volume) AS BIGINT) AS v FROM bars GROUP BY 1) SELECT date, ticker, v AS market_volume FROM bars JOIN m USING (date)")
def mapped(spark, d):
    b = A.bars_type_week(spark, d)
    return b.select("date", "ticker").join(F.broadcast(b.groupBy("date").agg(F.sum("volume").alias("market_volume"))), "date")


@query("g05_fold_medians", f"WITH {_RET}, s AS (SELECT ticker, CAST(year(date) AS INT) AS fold, avg(r) AS m FROM ret GROUP BY 1, 2) SELECT ticker, round(median(m), 6) + 0.0 AS median, round(min(m), 6) + 0.0 AS worst FROM s GROUP BY 1")
def fold_medians(spark, d):
    s = returns_month(spark, d).groupBy("ticker", F.year("date").alias("fold")).agg(F.avg("r").alias("m"))
    return s.groupBy("ticker").agg(r6(F.median("m")).alias("median"), r6(F.min("m")).alias("worst"))


@query("g20_best_trials", f"WITH {_RET}, s AS (SELECT sector, CAST(year(date) AS INT) AS \"window\", ticker, round(avg(r), 6) + 0.0 AS m FROM ret GROUP BY 1, 2, 3) SELECT sector, \"window\", ticker, m FROM (SELECT *, row_number() OVER (PARTITION BY sector, \"window\" ORDER BY m DESC, ticker) AS n FROM s) WHERE n = 1")
def best_trials(spark, d):
    s = returns_month(spark, d).groupBy("sector", F.year("date").alias("window"), "ticker").agg(r6(F.avg("r")).alias("m"))
    return G.first_by(s, ["sector", "window"], [F.desc("m"), "ticker"])


@query("s05_smallest_budget", "WITH m AS (SELECT l_linenumber AS n, avg(l_extendedprice) AS v FROM lineitem GROUP BY 1) SELECT min(n) AS n FROM m WHERE v >= 0.99 * (SELECT max(v) FROM m)")
def smallest_budget(spark, d):
    m = T(spark, d, "lineitem").groupBy(F.col("l_linenumber").alias("n")).agg(F.avg("l_extendedprice").alias("v"))
    return G.nearest_peak(m, "n", "v", 0.99)


@query("s06_first_algorithms", "SELECT c_mktsegment, row_number() OVER (ORDER BY k DESC, c_mktsegment) AS rank, row_number() OVER (ORDER BY k DESC, c_mktsegment) <= 2 AS selected FROM (SELECT c_mktsegment, count(*) AS k FROM customer GROUP BY 1)")
def first_algorithms(spark, d):
    k = T(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("k"))
    rank = F.row_number().over(Window.orderBy(F.desc("k"), "c_mktsegment"))
    return k.select("c_mktsegment", rank.cast("long").alias("rank"), (rank <= 2).alias("selected"))


@query("w26_rank", f"WITH {_RET}, k AS (SELECT *, round(r, 2) + 0.0 AS score, round(close, -4) + 0.0 AS level, lag(volume, 1, 0) OVER (PARTITION BY ticker ORDER BY date) AS before FROM ret) SELECT date, ticker, row_number() OVER (PARTITION BY date ORDER BY score DESC, level DESC, volume DESC, before, length(ticker), ticker) AS rank FROM k")
def rank(spark, d):
    """Six keys in turn; the first two are rounded, so that the later ones decide."""
    k = returns_month(spark, d).select("date", "ticker", "volume", (F.round("r", 2) + 0.0).alias("score"), (F.round("close", -4) + 0.0).alias("level"), F.lag("volume", 1, 0).over(W.ordered()).alias("before"))
    n = F.row_number().over(Window.partitionBy("date").orderBy(F.desc("score"), F.desc("level"), F.desc("volume"), "before", F.length("ticker"), "ticker"))
    return k.select("date", "ticker", n.cast("long").alias("rank"))


@query("w10_primary_alias", f"WITH {A.MACRO_DAILY} SELECT date, round(coalesce(close / nullif(lag(close) OVER (ORDER BY date), 0) - 1, 0), 6) + 0.0 AS macro_rate_change FROM macro WHERE name = '1-URGENT'")
def primary_alias(spark, d):
    m = A.macro_daily(spark, d).where("name = '1-URGENT'")
    return W.with_returns(m, (1,), by="name").select("date", r6(F.col("return_1d")).alias("macro_rate_change"))


@query("f03_full_match", "SELECT p_partkey, regexp_full_match(p_brand, 'Brand#[0-9]{2}') AS two_digits FROM part")
def full_match(spark, d):
    return T(spark, d, "part").select("p_partkey", F.col("p_brand").rlike("^Brand#[0-9]{2}$").alias("two_digits"))


@query("f21_json", "SELECT n_nationkey, '{\"n_name\":\"' || n_name || '\",\"n_regionkey\":' || n_regionkey || '}' AS row_json FROM nation")
def row_json(spark, d):
    return T(spark, d, "nation").select("n_nationkey", S.canonical_json("n_regionkey", "n_name").alias("row_json"))


@query("l08_fold_dataset", _HALF + ", st AS (SELECT fold, avg(close) AS m, coalesce(nullif(stddev_pop(close), 0), 1) AS s FROM sched JOIN bars USING (date) WHERE role = 'train' GROUP BY 1) SELECT fold, date, ticker, role, round((close - m) / s, 6) + 0.0 AS close FROM sched JOIN bars USING (date) JOIN st USING (fold) WHERE role <> 'unused'")
def fold_dataset(spark, d):
    """Each fold scaled by the state of its own train rows."""
    b = A.bars_type_week(spark, d)
    rows = L.half_year_folds(b, _FOLDS).where("role != 'unused'").join(b.select("date", "ticker", "close"), "date")
    state = rows.where("role = 'train'").groupBy("fold").agg(F.avg("close").alias("m"), F.coalesce(F.nullif(F.stddev_pop("close"), F.lit(0.0)), F.lit(1.0)).alias("s"))
    return rows.join(F.broadcast(state), "fold").select("fold", "date", "ticker", "role", r6((F.col("close") - F.col("m")) / F.col("s")).alias("close"))


@query("l14_membership_panel", f"""WITH {A.NATION_MONTH}, {A.MEMBERSHIP}, j AS (SELECT s.date, m.*, row_number() OVER (PARTITION BY s.date, m.ticker ORDER BY effective_from DESC, published_at DESC, record_id DESC) AS n FROM (SELECT DISTINCT date FROM bars) s JOIN members m ON effective_from <= s.date AND s.date < effective_to AND CASE WHEN revised THEN published_at < s.date ELSE published_at <= s.date END)
SELECT s.date, t.ticker, j.record_id, j.record_id IS NOT NULL AS is_member FROM (SELECT DISTINCT date FROM bars) s CROSS JOIN (SELECT DISTINCT ticker FROM members) t LEFT JOIN j ON j.date = s.date AND j.ticker = t.ticker AND n = 1""")
def membership_panel(spark, d):
    sessions, m = A.bars_nation_month(spark, d).select("date").distinct(), A.membership(spark, d)
    found = J.latest_eligible(sessions, m, ["ticker"]).select("date", "ticker", "record_id")
    grid = sessions.crossJoin(F.broadcast(m.select("ticker").distinct()))
    return grid.join(found, ["date", "ticker"], "left").withColumn("is_member", F.col("record_id").isNotNull())


@query("l17_one_split", f"WITH {_WK} SELECT b.date, ticker, close FROM bars b JOIN ds USING (date) WHERE i >= floor(n * 0.8)")
def one_split(spark, d):
    return L.chronological(A.bars_type_week(spark, d)).where("split = 'test'").select("date", "ticker", "close")


@query("m19_candidate_row", f"WITH {A.CURVES}, r AS (SELECT *, coalesce(ln(value / lag(value) OVER (PARTITION BY policy ORDER BY date)), 0) AS l FROM curve) SELECT policy, CAST(year(date) AS INT) AS fold, round(sum(l), 6) + 0.0 AS log_return, round(sum(turnover), 5) + 0.0 AS turnover, round(sum(cost), 4) + 0.0 AS cost FROM r GROUP BY 1, 2")
def candidate_row(spark, d):
    c = A.curves(spark, d).withColumn("l", F.coalesce(F.log(F.col("value") / F.lag("value").over(W.ordered("policy"))), F.lit(0.0)))
    return c.groupBy("policy", F.year("date").alias("fold")).agg(r6(F.sum("l")).alias("log_return"), (F.round(F.sum("turnover"), 5) + 0.0).alias("turnover"), (F.round(F.sum("cost"), 4) + 0.0).alias("cost"))


@query("p17_backtest", f"""WITH {A.CURVES}, x AS (SELECT policy, date, value / lag(value) OVER (PARTITION BY policy ORDER BY date) - 1 AS r FROM curve), g AS (SELECT *, exp(sum(ln(1 + r)) OVER (PARTITION BY policy ORDER BY date)) AS g FROM x WHERE r IS NOT NULL), h AS (SELECT *, g / max(g) OVER (PARTITION BY policy ORDER BY date) - 1 AS dd FROM g)
SELECT policy, round((arg_max(g, date) - 1) * 100, 5) + 0.0 AS total_return, round(coalesce(avg(r) / nullif(stddev_pop(r), 0) * sqrt(252), 0), 4) + 0.0 AS sharpe_ratio, round(coalesce(avg(r) / nullif(stddev_pop(r) FILTER (r < 0), 0) * sqrt(252), 0), 4) + 0.0 AS sortino_ratio,
  round(min(dd) * 100, 5) + 0.0 AS max_drawdown, round(stddev_pop(r) * sqrt(252) * 100, 5) + 0.0 AS volatility FROM h GROUP BY 1""")
def backtest(spark, d):
    r = A.curves(spark, d).withColumn("r", F.col("value") / F.lag("value").over(W.ordered("policy")) - 1)
    m = M.prototype_metrics(r)
    return m.select("policy", *((F.round(c, 4 if "ratio" in c else 5) + 0.0).alias(c) for c in m.columns if c != "policy"))


@query("p19_regime_suite", _SIM + ", g(name, a, b) AS (VALUES ('early', DATE '1995-06-01', DATE '1997-12-31'), ('late', DATE '2000-01-01', DATE '2001-12-31')) SELECT name, count(*) AS sessions, round(sum(net), 5) + 0.0 AS net FROM v JOIN g ON date BETWEEN a AND b GROUP BY 1 HAVING count(*) >= 12")
def regime_suite(spark, d):
    curve = P.closed_form(P.equal_weight(A.bars_nation_month(spark, d)), returns_month(spark, d), 0.0015, 0.0005)
    r = spark.createDataFrame([("early", "1995-06-01", "1997-12-31"), ("late", "2000-01-01", "2001-12-31")], "name string, a string, b string")
    j = curve.join(F.broadcast(r), F.col("date").between(F.col("a").cast("date"), F.col("b").cast("date")))
    return j.groupBy("name").agg(F.count("*").alias("sessions"), (F.round(F.sum("net"), 5) + 0.0).alias("net")).where("sessions >= 12")


@query("q33_fold_summary", _HALF + " SELECT fold, count(*) FILTER (role = 'train') AS train, count(*) FILTER (role = 'test') AS test, count(*) FILTER (role = 'unused') AS unused, count(*) FILTER (role = 'unused') = 1 AS passed FROM sched GROUP BY 1")
def fold_summary(spark, d):
    s = L.half_year_folds(A.bars_type_week(spark, d), _FOLDS)
    n = lambda r: F.count_if(F.col("role") == r)
    return s.groupBy("fold").agg(n("train").alias("train"), n("test").alias("test"), n("unused").alias("unused"), (n("unused") == 1).alias("passed"))


@query("a01_load_fallback", "SELECT r_regionkey, r_name FROM region")
def load_fallback(spark, d):
    """No Parquet file is there, so the CSV file is read."""
    folder = N.scratch(spark)
    N.save_table(T(spark, d, "region").select("r_regionkey", "r_name"), f"{folder}/region.csv")
    return N.load_table(spark, f"{folder}/none.parquet", f"{folder}/region.csv").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name")


@query("a02_write_both", "SELECT n_nationkey, n_name, 2 AS copies FROM nation")
def write_both(spark, d):
    """Written as Parquet and as CSV, and read back from both."""
    folder, n = N.scratch(spark), T(spark, d, "nation").select("n_nationkey", "n_name")
    N.write_features(n, f"{folder}/n.parquet", f"{folder}/n.csv")
    both = N.load_table(spark, f"{folder}/n.parquet").unionByName(N.load_table(spark, f"{folder}/n.csv").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), "n_name"))
    return both.groupBy("n_nationkey", "n_name").agg(F.count("*").cast("int").alias("copies"))


@query("a03_result_tree", "SELECT lower(c_mktsegment) AS feature_group, count(*) AS rows, min(c_custkey) AS first_key FROM customer GROUP BY 1")
def result_tree(spark, d):
    """A tree of result files, one folder a segment, scanned as one table with where each row came from."""
    folder = N.scratch(spark)
    T(spark, d, "customer").select("c_custkey", F.lower("c_mktsegment").alias("s")).write.partitionBy("s").csv(f"{folder}/out", header=True)
    tree = N.result_tree(spark, f"{folder}/out", "part-*.csv", schema="c_custkey long")
    group = F.regexp_extract(N.path_part(F.col("source_path"), 2), "^s=(.*)$", 1)
    return tree.groupBy(group.alias("feature_group")).agg(F.count("*").alias("rows"), F.min("c_custkey").alias("first_key"))


@query("a03_growing_tree", "SELECT lower(c_mktsegment) AS source, count(*) AS rows, min(c_custkey) AS first_key, CASE WHEN c_mktsegment < 'F' THEN 0 WHEN c_mktsegment = 'MACHINERY' THEN 2 ELSE 1 END AS batch FROM customer GROUP BY 1, 4")
def growing_tree(spark, d):
    """A tree that grows twice; each run reads the new files alone, and a source that comes again replaces its row."""
    folder, c = N.scratch(spark), T(spark, d, "customer").select("c_custkey", "c_acctbal", F.col("c_mktsegment").alias("s"))
    source, summary = F.regexp_extract(F.col("source_path"), "/s=([^/]*)/", 1), [F.count("*").alias("rows"), F.min("c_custkey").alias("first_key")]
    for k, some in enumerate(("s < 'F'", "s >= 'F' and (s <> 'MACHINERY' or c_acctbal < 0)", "s = 'MACHINERY'")):
        c.where(some).select("c_custkey", F.lower("s").alias("s")).write.partitionBy("s").csv(f"{folder}/out/run={k}", header=True)
        out = manifest.scan_new(spark, f"{folder}/out", "c_custkey long", f"{folder}/manifest", f"{folder}/state", source, summary, header="true")
    return out


@query("a06_suffix_dispatch", "SELECT r_regionkey, r_name, 'parquet' AS kind FROM region UNION ALL SELECT r_regionkey, r_name, 'csv' FROM region")
def dispatch(spark, d):
    """The suffix of a path decides how it is written and read."""
    folder, r = N.scratch(spark), T(spark, d, "region").select("r_regionkey", "r_name")
    out = None
    for kind in ("parquet", "csv"):
        N.save_table(r, f"{folder}/r.{kind}")
        one = N.load_table(spark, f"{folder}/r.{kind}").select(F.col("r_regionkey").cast("long").alias("r_regionkey"), "r_name", F.lit(kind).alias("kind"))
        out = one if out is None else out.unionByName(one)
    return out


@query("a07_replaced_whole", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal > 0")
def replaced_whole(spark, d):
    """A table written twice: readers find the second writing and nothing of the first."""
    folder, s = N.scratch(spark), T(spark, d, "supplier").select("s_suppkey", "s_acctbal")
    N.save_table(s, f"{folder}/s.csv")
    N.save_table(s.where("s_acctbal > 0"), f"{folder}/s.csv")
    return N.load_table(spark, f"{folder}/s.csv").select(F.col("s_suppkey").cast("long").alias("s_suppkey"), F.col("s_acctbal").cast("double").alias("s_acctbal"))


@query("a26_sealed_holdout", "SELECT CASE WHEN o_orderdate < TIMESTAMP '2000-01-01' THEN 'development' ELSE 'holdout' END AS part, count(*) AS rows, false AS overwritten FROM orders GROUP BY 1")
def sealed_holdout(spark, d):
    """Development rows may be written again; the holdout is written once, and a second writing is refused."""
    folder, o = N.scratch(spark), T(spark, d, "orders").select("o_orderkey", "o_orderdate")
    dev, held = N.split_at(o, "o_orderdate", "2000-01-01")
    for rows in (dev.limit(1), dev):
        N.save_table(rows, f"{folder}/dev.parquet")
    N.seal(held, f"{folder}/holdout.parquet")
    again = N.is_sealed(spark, held.limit(1), f"{folder}/holdout.parquet")
    parts = [spark.read.parquet(f"{folder}/{n}.parquet").agg(F.lit(p).alias("part"), F.count("*").alias("rows"), F.lit(not again).alias("overwritten")) for n, p in (("dev", "development"), ("holdout", "holdout"))]
    return parts[0].unionByName(parts[1])


QUERIES = Q
