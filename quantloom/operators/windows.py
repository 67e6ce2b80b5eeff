"""Ordered features of each entity. All of them share one exchange on the entity."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .blocks import LEAST_ROWS, cuts_of


def ordered(by: str = "ticker", at: str = "date") -> WindowSpec:
    return Window.partitionBy(by).orderBy(at)


def last_rows(n: int, by: str = "ticker", at: str = "date") -> WindowSpec:
    return ordered(by, at).rowsBetween(-(n - 1), 0)


def guarded(value: Column, counted: Column, least: int, frame: WindowSpec) -> Column:
    """value where the frame has at least so many non-null inputs, else null."""
    return F.when(F.count(counted).over(frame) >= least, value)


def padded(x: Column, w: WindowSpec) -> Column:
    """x with a null taken from the last value before it."""
    return F.last(x, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))


def ratio_change(now: Column, then: Column) -> Column:
    """now / then - 1; 0 for a null or a zero denominator, as after replacing infinities."""
    return F.coalesce(F.try_divide(now, then) - 1, F.lit(0.0))


def with_returns(panel: DataFrame, periods: tuple[int, ...] = (1, 5, 20), price: str = "close", by: str = "ticker", at: str = "date") -> DataFrame:
    """return_{n}d: change over n rows of the padded price, null and infinite as 0."""
    w = ordered(by, at)
    full = panel.withColumn("__p", padded(F.col(price), w))
    return full.withColumns({f"return_{n}d": ratio_change(F.col("__p"), F.lag("__p", n).over(w)) for n in periods}).drop("__p")


def volatility(x: str = "return_1d", n: int = 20, by: str = "ticker", at: str = "date") -> Column:
    f = last_rows(n, by, at)
    return F.coalesce(guarded(F.stddev_samp(x).over(f), F.col(x), 2, f), F.lit(0.0))


def mean_ratio(x: str, n: int, by: str = "ticker", at: str = "date") -> Column:
    return ratio_change(F.col(x), F.avg(x).over(last_rows(n, by, at)))


def rsi(price: str = "close", n: int = 14, by: str = "ticker", at: str = "date") -> tuple[Column, Column]:
    """(step, strength): the change of price, and simple-mean relative strength in [0, 1] over columns
    __up and __down made of it; 0.5 where there is no loss or too little history."""
    f = last_rows(n, by, at)
    step = F.col(price) - F.lag(price).over(ordered(by, at))
    mean = lambda x: guarded(F.avg(x).over(f), x, n, f)
    strength = F.try_divide(mean(F.col("__up")), F.nullif(mean(F.col("__down")), F.lit(0.0)))
    return step, F.coalesce((100 - 100 / (1 + strength)) / 100, F.lit(0.5))


def bollinger_z(price: str = "close", n: int = 20, by: str = "ticker", at: str = "date") -> Column:
    f = last_rows(n, by, at)
    return F.coalesce(F.try_divide(F.col(price) - F.avg(price).over(f), F.nullif(F.stddev_samp(price).over(f), F.lit(0.0))), F.lit(0.0))


def true_range(by: str = "ticker", at: str = "date") -> Column:
    """high - low on the first row, since greatest skips nulls."""
    before = F.lag("close").over(ordered(by, at))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def technical_features(panel: DataFrame, by: str = "ticker", at: str = "date") -> DataFrame:
    """panel(date, ticker, open, high, low, close, volume) with eleven features but the recursive one."""
    w, f14 = ordered(by, at), last_rows(14, by, at)
    out = with_returns(panel, by=by, at=at)
    step, strength = rsi(by=by, at=at)
    out = out.withColumns({"__step": step, "__tr": true_range(by, at)})
    out = out.withColumns({"__up": F.greatest(F.col("__step"), F.lit(0.0)), "__down": F.greatest(-F.col("__step"), F.lit(0.0))})
    out = out.withColumns({"__up": F.when(F.col("__step").isNotNull(), F.col("__up")), "__down": F.when(F.col("__step").isNotNull(), F.col("__down"))})
    atr = F.coalesce(guarded(F.avg("__tr").over(f14), F.col("__tr"), 2, f14), F.lit(0.0))
    return out.withColumns({
        "volatility_20d": volatility("return_1d", 20, by, at), "ma_ratio_10": mean_ratio("close", 10, by, at), "ma_ratio_30": mean_ratio("close", 30, by, at), "rsi_14": strength,
        "bollinger_z": bollinger_z(by=by, at=at), "atr_14": F.coalesce(F.try_divide(atr, F.col("close")), F.lit(0.0)), "volume_ratio_20": mean_ratio("volume", 20, by, at),
    }).drop("__step", "__tr", "__up", "__down")


def _fold(values: list, keep: float, e: float | None, gap: int) -> tuple[list, float | None, int]:
    """The recursive means of values from a mean e that gap nulls have followed, and what comes out at the end."""
    out, new = [], 1 - keep
    for x in values:
        if x is None:
            gap += 1
        elif e is None:
            e, gap = x, 0
        else:
            w = keep if not gap else keep ** (gap + 1)
            e, gap = (w * e + new * x) / (w + new), 0
        out.append(e)
    return out, e, gap


def _summed_up(values: list, keep: float) -> tuple[int, float | None, float, float, int]:
    """A block as a map of what comes in: nulls before its first value, that value, the scale and the shift of the mean
    from there to the end, and the nulls after its last value."""
    lead = next((i for i, x in enumerate(values) if x is not None), len(values))
    if lead == len(values):
        return lead, None, 1.0, 0.0, 0
    scale, shift, gap, new = 1.0, 0.0, 0, 1 - keep
    for x in values[lead + 1 :]:
        if x is None:
            gap += 1
        else:
            w = keep if not gap else keep ** (gap + 1)
            a, gap = w / (w + new), 0
            scale, shift = a * scale, a * shift + new * x / (w + new)
    return lead, values[lead], scale, shift, gap


def _chained(summaries: list, keeps: list[float]) -> dict:
    """What comes into each block, (key, block) -> (mean, nulls since) of each span, from summaries in the order of blocks."""
    states: dict = {}
    for key, block, i, lead, first, scale, shift, trail in summaries:
        e, gap = states.setdefault((key, i), (None, 0))
        states[key, i, block] = (e, gap)
        if first is None:
            states[key, i] = (e, gap + lead)
            continue
        (e,), _, _ = _fold([first], keeps[i], e, gap + lead)
        states[key, i] = (scale * e + shift, trail)
    return states


def _runs(keys: list, blocks: list) -> list[tuple[int, int]]:
    """Ranges of rows of one key and block."""
    starts = [i for i in range(len(keys)) if not i or keys[i] != keys[i - 1] or blocks[i] != blocks[i - 1]]
    return list(zip(starts, [*starts[1:], len(keys)], strict=True))


def with_ema(panel: DataFrame, spans: tuple[int, ...], price: str = "close", by: str = "ticker", at: str = "date", least_rows: int = LEAST_ROWS) -> DataFrame:
    """ema_{span}: recursive mean, e = e' (1 - a) + a x with a = 2 / (span + 1), from the first value on.

    A null carries the last value and lets its weight fade. A value turns the mean before it into the mean after it by an affine map, and
    these compose: blocks of an entity are summed up side by side into one map each, the maps are chained block by block, and each
    block is replayed from what comes into it. An entity of few rows is one block and is only replayed. Rows stream past in
    order, so the work is linear and no task holds a history."""
    keeps = [1 - 2 / (s + 1) for s in spans]
    cuts = cuts_of(panel, [by], at, least_rows)
    rows = panel.withColumn("__v", F.col(price).cast("double"))
    rows = cuts.with_block(rows) if cuts else rows.withColumns({"__b": F.lit(0), "__cut": F.lit(False)})
    placed = rows.repartition(by, "__b").sortWithinPartitions(by, "__b", at)
    starts: dict = {}

    def summarise(batches):
        # a block may span batches: its values wait until the next one begins
        here, values = None, []

        def out():
            found = [(*here, i, *_summed_up(values, k)) for i, k in enumerate(keeps)] if here else []
            return pd.DataFrame(found, columns=["key", "block", "i", "lead", "first", "scale", "shift", "trail"]).astype({"first": object})

        for batch in batches:
            keys, blocks, x = (batch.column(c).to_pylist() for c in (by, "__b", "__v"))
            for a, b in _runs(keys, blocks):
                if here is not None and (keys[a], blocks[a]) != here:
                    yield out()
                    values = []
                here = (keys[a], blocks[a])
                values += x[a:b]
        yield out()

    def as_arrow(frames, schema):
        for f in frames:
            yield pa.RecordBatch.from_arrays([pa.array(f[c].tolist(), t.type) for c, t in zip(f.columns, schema, strict=True)], names=list(f.columns))

    if cuts:
        key_type = panel.schema[by].dataType
        schema = StructType([StructField("key", key_type), StructField("block", LongType()), StructField("i", LongType()), StructField("lead", LongType()), StructField("first", DoubleType()), StructField("scale", DoubleType()), StructField("shift", DoubleType()), StructField("trail", LongType())])
        arrow = to_arrow_schema(schema)
        found = placed.where("__cut").select(by, "__b", "__v").mapInArrow(lambda batches: as_arrow(summarise(batches), arrow), schema)
        starts = _chained([tuple(r) for r in sorted(found.collect(), key=lambda r: r["block"])], keeps)

    names = panel.columns

    def replay(batches):
        here, state = None, [(None, 0)] * len(keeps)
        for batch in batches:
            keys, blocks, x = (batch.column(c).to_pylist() for c in (by, "__b", "__v"))
            means: list[list] = [[] for _ in keeps]
            for a, b in _runs(keys, blocks):
                if (keys[a], blocks[a]) != here:
                    here = (keys[a], blocks[a])
                    state = [starts.get((keys[a], i, blocks[a]), (None, 0)) for i in range(len(keeps))]
                for i, keep in enumerate(keeps):
                    out, *state[i] = _fold(x[a:b], keep, *state[i])
                    means[i] += out
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *(pa.array(m, pa.float64()) for m in means)], names=[*names, *(f"ema_{s}" for s in spans)])

    full = StructType([*panel.schema.fields, *(StructField(f"ema_{s}", DoubleType()) for s in spans)])
    return placed.select(*names, "__b", "__v").mapInArrow(replay, full)


def with_drawdown(curve: DataFrame, value: str = "value", by: str = "policy", at: str = "date") -> DataFrame:
    """drawdown: value over its greatest so far, minus one."""
    peak = F.max(value).over(ordered(by, at).rowsBetween(Window.unboundedPreceding, 0))
    return curve.withColumn("drawdown", F.col(value) / peak - 1)


def lagged_z(x: str, n: int = 60, by: str = "ticker", at: str = "date") -> Column:
    """(x - mean) / population deviation of the n rows before this one; 0 below max(10, n / 3) rows or at no deviation."""
    f = ordered(by, at).rowsBetween(-n, -1)
    z = F.try_divide(F.col(x) - F.avg(x).over(f), F.nullif(F.stddev_pop(x).over(f), F.lit(0.0)))
    return F.coalesce(guarded(z, F.col(x), max(10, n // 3), f), F.lit(0.0))


def index_features(dates: DataFrame, level: str, by: str = "name", at: str = "date") -> DataFrame:
    """dates with level carried forward, its returns over 1, 5 and 20 rows, its volatility and its ratio to its mean of 20."""
    full = dates.withColumn("level", padded(F.col(level), ordered(by, at)))
    out = with_returns(full, (1, 5, 20), "level", by, at)
    return out.withColumns({"volatility_20d": volatility("return_1d", 20, by, at), "ma_ratio_20": mean_ratio("level", 20, by, at)})


def flow_features(flows: DataFrame, z_rows: int = 60, at: str = "date", by: str = "investor_type") -> DataFrame:
    """net_share, net_5d, net_20d and net_z60 of each investor group on every date of flows(date, investor_type,
    buy_value, sell_value, ...).

    The net value of a group stands over the market's value: what all groups bought that date. Rolling figures
    need all their rows, the score against the rows before at least max(10, rows / 3); else they are null, and
    null is what a date without a market value or a group without a row has. Dates and groups are dimensions."""
    market = flows.groupBy(at).agg(F.nullif(F.sum("buy_value"), F.lit(0.0)).alias("market"))
    grid = market.crossJoin(F.broadcast(flows.select(by).distinct()))
    net = flows.groupBy(at, by).agg(F.sum(F.col("buy_value") - F.col("sell_value")).alias("net"))
    x = grid.join(net, [at, by], "left").withColumn("net_share", F.try_divide("net", "market"))

    def rolled(n: int) -> Column:
        f = last_rows(n, by, at)
        return F.when((F.count("net").over(f) == n) & (F.count("market").over(f) == n), F.try_divide(F.sum("net").over(f), F.sum("market").over(f)))

    past = ordered(by, at).rowsBetween(-z_rows, -1)
    z = guarded(F.try_divide(F.col("net_share") - F.avg("net_share").over(past), F.nullif(F.stddev_pop("net_share").over(past), F.lit(0.0))), F.col("net_share"), max(10, z_rows // 3), past)
    return x.withColumns({"net_5d": rolled(5), "net_20d": rolled(20), f"net_z{z_rows}": z})


def history_complete(valid: str, n: int, by: str = "ticker", at: str = "date") -> Column:
    """Whether all n rows before this one exist and are valid."""
    f = ordered(by, at).rowsBetween(-n, -1)
    return (F.count("*").over(f) == n) & (F.sum(F.col(valid).cast("int")).over(f) == n)


def crossover(price: str = "close", short: int = 10, long: int = 30, by: str = "ticker", at: str = "date") -> Column:
    """Whether the short mean is over the long one; frames may be partial."""
    return F.avg(price).over(last_rows(short, by, at)) > F.avg(price).over(last_rows(long, by, at))


def lookback(x: str, n: int, by: str = "ticker", at: str = "date", pad: bool = False) -> Column:
    """The n values before this row, in order; padded with zeros on the left if asked."""
    seen = F.collect_list(x).over(ordered(by, at).rowsBetween(-n, -1))
    return F.concat(F.array_repeat(F.lit(0.0), F.lit(n) - F.size(seen)), seen) if pad else seen


def forward_return(price: str, n: int, by: str = "ticker", at: str = "date") -> Column:
    return F.try_divide(F.lead(price, n).over(ordered(by, at)), F.col(price)) - 1


def peer_mean(x: str, active: str, within: tuple[str, ...]) -> tuple[Column, Column]:
    """(mean of x over the other active rows of the group, how many have x)."""
    w = Window.partitionBy(*within)
    own = F.when(F.col(active), F.col(x))
    n = F.count(own).over(w) - F.when(own.isNotNull(), 1).otherwise(0)
    return F.when(n > 0, (F.sum(own).over(w) - F.coalesce(own, F.lit(0.0))) / n), n


def sector_context(panel: DataFrame, x: str, active: str, observed: str, known_at: str, within: tuple[str, ...], neutral: float = 0.0) -> DataFrame:
    """panel with the mean of its group and of its group without the row itself.

    Rows that are active and observed contribute. Counts and coverage are 0, means and differences neutral, and
    information_at null for rows that are not active or have none to stand on. All share one exchange."""
    w = Window.partitionBy(*within)
    on, seen = F.col(active), F.col(observed)
    own = F.when(on & seen, F.col(x))
    n, total, members = F.count(own).over(w), F.coalesce(F.sum(own).over(w), F.lit(0.0)), F.count_if(on).over(w)
    df = panel.withColumns({"__n": n, "__s": total, "__m": members, "__k": F.when(own.isNotNull(), 1).otherwise(0), "__own": F.coalesce(own, F.lit(0.0)), "__info": F.max(F.when(own.isNotNull(), F.col(known_at))).over(w)})
    peers, peer_sum = F.col("__n") - F.col("__k"), F.col("__s") - F.col("__own")
    some, others = on & (F.col("__n") > 0), on & (peers > 0)
    mean, peer_mean = F.col("__s") / F.col("__n"), peer_sum / peers
    either = lambda cond, value: F.when(cond, value).otherwise(F.lit(neutral))
    return df.select(
        *panel.columns, F.when(on, F.col("__m")).otherwise(0).cast("long").alias("members"), F.when(on, F.col("__n")).otherwise(0).cast("long").alias("contributors"), F.when(on & (F.col("__m") > 0), F.col("__n") / F.col("__m")).otherwise(0.0).alias("coverage"),
        some.alias("available"), either(some, mean).alias("mean_return"), (some & seen).alias("relative_available"), either(some & seen, F.col(x) - mean).alias("relative_return"), F.when(on, peers).otherwise(0).cast("long").alias("peers"),
        others.alias("peer_available"), either(others, peer_mean).alias("peer_return"), (others & seen).alias("relative_peer_available"), either(others & seen, F.col(x) - peer_mean).alias("relative_peer_return"), F.when(some, F.col("__info")).alias("information_at"),
    )


def prototype_rsi(panel: DataFrame, n: int, price: str = "close", by: str = "ticker", at: str = "date") -> DataFrame:
    """panel with rsi_{n} on a scale of 100: 100 without a loss, null without any step or before n rows."""
    step = F.col(price) - F.lag(price).over(ordered(by, at))
    x = panel.withColumn("__d", step)
    f = last_rows(n, by, at)
    up, down = F.avg(F.greatest(F.coalesce("__d", F.lit(0.0)), F.lit(0.0))).over(f), F.avg(F.greatest(-F.coalesce("__d", F.lit(0.0)), F.lit(0.0))).over(f)
    x = x.withColumns({"__u": up, "__l": down, "__n": F.count("*").over(f)})
    value = F.when((F.col("__n") < n) | ((F.col("__u") == 0) & (F.col("__l") == 0)), None).when(F.col("__l") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("__u") / F.col("__l")))
    return x.withColumn(f"rsi_{n}", value).drop("__d", "__u", "__l", "__n")


def bands(panel: DataFrame, rows: int = 20, width: float = 2.0, k_rows: int = 14, d_rows: int = 3, by: str = "ticker", at: str = "date") -> DataFrame:
    """panel with middle, lower and upper (mean and population deviations), stoch_k and stoch_d; null before a frame is full."""
    f, g, h = last_rows(rows, by, at), last_rows(k_rows, by, at), last_rows(d_rows, by, at)
    full = lambda frame, n, value: F.when(F.count("*").over(frame) == n, value)
    mean, dev = F.avg("close").over(f), F.stddev_pop("close").over(f)
    low, high = F.min("low").over(g), F.max("high").over(g)
    x = panel.withColumns({"middle": full(f, rows, mean), "lower": full(f, rows, mean - width * dev), "upper": full(f, rows, mean + width * dev), "stoch_k": full(g, k_rows, F.try_divide(100 * (F.col("close") - low), high - low))})
    return x.withColumn("stoch_d", F.when(F.count("stoch_k").over(h) == d_rows, F.avg("stoch_k").over(h)))


def macd(panel: DataFrame, short: int = 12, long: int = 26, signal: int = 9, price: str = "close", by: str = "ticker", at: str = "date") -> DataFrame:
    """panel with macd, its recursive mean as signal, and their difference as histogram."""
    e = with_ema(panel, (short, long), price, by, at).withColumn("macd", F.col(f"ema_{short}") - F.col(f"ema_{long}")).drop(f"ema_{short}", f"ema_{long}")
    s = with_ema(e, (signal,), "macd", by, at).withColumnRenamed(f"ema_{signal}", "signal")
    return s.withColumn("histogram", F.col("macd") - F.col("signal"))
