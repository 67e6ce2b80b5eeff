"""Small models over panels: Gram-matrix regression, principal components, scores, permutations.

Sums over all rows are Spark aggregates; only matrices of the number of features reach the driver."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def summed(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys and v: sums of the arrays v of parts(keys, v), added up row by row as they stream past in the order of their keys."""
    tasks = int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        here, total = None, None
        for batch in batches:
            names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
            values = batch.column("v")
            for i, name in enumerate(names):
                v = values[i].values.to_numpy(zero_copy_only=False)
                if name == here:
                    total = total + v
                    continue
                if here is not None:
                    yield _one(keys, here, total)
                here, total = name, v
        if here is not None:
            yield _one(keys, here, total)

    types = dict(parts.dtypes)
    schema = ", ".join(f"{k} {types[k]}" for k in keys) + ", v array<double>"
    return parts.select(*keys, "v").repartition(tasks, *keys).sortWithinPartitions(*keys).mapInArrow(run, schema)


def _one(keys: list[str], here: tuple, total: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([x]) if not isinstance(x, int) else pa.array([x], pa.int32()) for x in here), pa.array([total.tolist()], pa.list_(pa.float64()))], names=[*keys, "v"])


def segment_grams(rows: DataFrame, columns: list[str], segment: str, segments: int) -> np.ndarray:
    """(segments, n + 1, n + 1): for each segment (from 0) the sums of products of the columns and of 1, in one scan.

    A task adds up its rows' matrices; one row for each segment and column leaves it. Rows with a null are left out. Only the sums,
    of a size that follows the columns, reach the driver."""
    n = len(columns) + 1

    def partial(batches):
        total = np.zeros((segments, n, n))
        for b in batches:
            k = b.column(0).to_numpy(zero_copy_only=False)
            x = np.column_stack([*(c.to_numpy(zero_copy_only=False) for c in b.columns[1:]), np.ones(b.num_rows)]) if b.num_rows else np.zeros((0, n))
            for s in np.unique(k):
                own = x[k == s]
                total[s] += own.T @ own
        used = [s for s in range(segments) if total[s, -1, -1]]
        yield pa.RecordBatch.from_arrays([pa.array([s for s in used for _ in range(n)], pa.int32()), pa.array([i for _ in used for i in range(n)], pa.int32()), pa.array([total[s, i].tolist() for s in used for i in range(n)], pa.list_(pa.float64()))], names=["s", "i", "v"])

    clean = rows.select(F.col(segment).cast("int").alias("s"), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns))).dropna()
    out = np.zeros((segments, n, n))
    for r in summed(clean.mapInArrow(partial, "s int, i int, v array<double>"), ["s", "i"]).collect():
        out[r.s, r.i] = r.v
    return out


def _solved(gram: np.ndarray, alpha: float) -> tuple[np.ndarray, float]:
    """Weights and constant of the ridge regression of the last column but one on those before it, from its sums of products."""
    n = max(gram[-1, -1], 1.0)
    mean = gram[-1, :-1] / n
    cov = gram[:-1, :-1] - n * np.outer(mean, mean)
    scale = np.sqrt(np.maximum(np.diag(cov)[:-1] / n, 0))
    scale[scale == 0] = 1.0
    beta = np.linalg.solve(cov[:-1, :-1] / np.outer(scale, scale) + alpha * np.eye(len(scale)), cov[:-1, -1] / scale) / scale
    return beta, float(mean[-1] - mean[:-1] @ beta)


def ridge_folds(panel: DataFrame, features: list[str], target: str, alpha: float, untils: list[str], at: str = "date") -> DataFrame:
    """fold, date, ticker, forecast: ridge regressions refitted at each date of untils (ascending), and for each the forecasts of the
    rows after it up to the next.

    Fold k is fitted on all rows up to its date: the sums of products of the segments between the dates are made in one scan, and
    a fold is the sum of the first k of them and a small solve. Rows without a target are not fitted on; a null feature gives a
    null forecast. Weights are an array a fold, a dimension."""
    if sorted(untils) != list(untils) or len(set(untils)) < len(untils):
        raise ValueError("dates of refits must ascend")
    bounds = [F.lit(u).cast("date") for u in untils]
    segment = sum(((F.col(at) > b).cast("int") for b in bounds), F.lit(0))
    grams = segment_grams(panel.withColumn("__s", segment).where(F.col("__s") < len(untils)), [*features, target], "__s", len(untils))
    models = [(k, *(v.tolist() if isinstance(v, np.ndarray) else v for v in _solved(g, alpha))) for k, g in enumerate(np.cumsum(grams, axis=0))]
    table = panel.sparkSession.createDataFrame(models, "fold int, __w array<double>, __c double")
    x = F.array(*(F.col(c).cast("double") for c in features))
    dot = F.aggregate(F.zip_with(x, "__w", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    rows = panel.withColumn("fold", segment - 1).where("fold >= 0").join(F.broadcast(table), "fold")
    return rows.select("fold", at, "ticker", (dot + F.col("__c")).alias("forecast"))


def ridge(panel: DataFrame, features: list[str], target: str, alpha: float, until: str, at: str = "date") -> DataFrame:
    """Forecasts of target for all rows by ridge regression on standardised features, fitted on dates up to until.

    (X'X + alpha I) b = X'(y - mean y); a feature without deviation counts with scale 1."""
    fit = panel.where((F.col(at) <= F.lit(until).cast("date")) & F.col(target).isNotNull()).withColumn("__s", F.lit(0))
    beta, constant = _solved(segment_grams(fit, [*features, target], "__s", 1)[0], alpha)
    forecast = sum((F.col(c) * float(b) for c, b in zip(features, beta, strict=True)), F.lit(constant))
    return panel.select(at, "ticker", forecast.alias("forecast"))


def expected_value(scores: Column, values: dict[str, float]) -> Column:
    """sum(value p) / sum(p) over an array of (label, p); unknown labels have value 0."""
    table = F.create_map(*(F.lit(x) for kv in values.items() for x in kv))
    total = F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["p"])
    return F.coalesce(F.try_divide(F.aggregate(scores, F.lit(0.0), lambda a, s: a + s["p"] * F.coalesce(F.try_element_at(table, s["label"]), F.lit(0.0))), total), F.lit(0.0))


#: Vectors of up to so many components are decomposed from their whole covariance; longer ones by a random range.
WHOLE_DIMS = 128


def _products(fit: DataFrame, dims: int, onto: np.ndarray | None) -> np.ndarray:
    """[X 1]' [X 1] where onto is None, else [X 1]' (X onto, 1): partial products of Arrow batches, added up by Spark."""
    width = (dims if onto is None else onto.shape[1]) + 1

    def partial(batches):
        total = np.zeros((dims + 1, width))
        for b in batches:
            if b.num_rows:
                x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, dims)
                one = np.ones((len(x), 1))
                total += np.hstack([x, one]).T @ np.hstack([x if onto is None else x @ onto, one])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims + 1), pa.int32()), pa.array(total.tolist(), pa.list_(pa.float64()))], names=["i", "v"])

    out = np.zeros((dims + 1, width))
    for r in summed(fit.mapInArrow(partial, "i int, v array<double>"), ["i"]).collect():
        out[r.i] = r.v
    return out


def _leading(fit: DataFrame, dims: int, n: int, passes: int, spare: int, seed: int, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """(mean, basis): the leading n eigenvectors of the covariance, in columns."""
    if whole:
        gram = _products(fit, dims, None)
        count = max(gram[-1, -1], 1.0)
        mean = gram[-1, :-1] / count
        return mean, np.linalg.eigh(gram[:-1, :-1] / count - np.outer(mean, mean))[1][:, ::-1][:, :n]
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, min(dims, n + spare))))[0]
    for _ in range(passes):
        sums = _products(fit, dims, basis)
        count = max(sums[-1, -1], 1.0)
        mean = sums[:-1, -1] / count
        turned = sums[:-1, :-1] / count - np.outer(mean, mean @ basis)  # the covariance times the basis
        inside = basis.T @ turned
        rotation = np.linalg.eigh((inside + inside.T) / 2)[1][:, ::-1]
        basis = np.linalg.qr(turned @ rotation)[0]
    return mean, basis[:, :n]


def pca_scores(rows: DataFrame, key: str, vector: str, n: int, fit_where: Column, passes: int = 4, spare: int = 10, seed: int = 0, whole: bool | None = None) -> DataFrame:
    """The first n principal components, fitted on some rows; each has its largest loading positive.

    Vectors must be of one length: another one is an error, and so is a null component. Null vectors are not fitted on and have null scores.
    Up to WHOLE_DIMS components the covariance is summed whole (whole: always or never). Longer vectors go through a random
    range of n + spare directions (Halko, Martinsson and Tropp 2011): each pass over the rows multiplies it by the covariance and
    makes it orthogonal again, so partial sums are of dims x (n + spare) and not dims x dims."""
    lengths = rows.where(F.col(vector).isNotNull()).agg(F.min(F.size(vector)).alias("a"), F.max(F.size(vector)).alias("b"), F.count_if(F.exists(vector, lambda x: x.isNull())).alias("nulls")).first()
    if lengths.a is None:
        return rows.select(key, *(F.lit(None).cast("double").alias(f"pc_{k + 1}") for k in range(n)))
    if lengths.a != lengths.b or lengths.nulls or n > lengths.a:
        raise ValueError(f"{n} components of vectors of {lengths.a} to {lengths.b} numbers, {lengths.nulls} of them with nulls")
    dims = lengths.a
    fit = rows.where(fit_where & F.col(vector).isNotNull()).select(F.col(vector).alias("v"))
    mean, basis = _leading(fit, dims, n, passes, spare, seed, dims <= WHOLE_DIMS if whole is None else whole)
    basis = basis * np.sign(basis[np.abs(basis).argmax(0), np.arange(n)])
    shift, types = mean @ basis, dict(rows.dtypes)

    def project(batches):
        for b in batches:
            given = b.column(1)
            x = given.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dims) @ basis - shift
            out = np.full((b.num_rows, n), np.nan)
            there = given.is_valid().to_numpy(zero_copy_only=False)
            out[there] = x
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(out[:, k], mask=~there) for k in range(n))], names=[key, *(f"pc_{k + 1}" for k in range(n))])

    return rows.select(key, vector).mapInArrow(project, f"{key} {types[key]}, " + ", ".join(f"pc_{k + 1} double" for k in range(n)))


def permutation_shift(panel: DataFrame, features: list[str], seed: int, at: str = "date") -> DataFrame:
    """Mean half L1 shift of the weights of a linear long-only policy when a feature's dates are shuffled.

    The permutation of dates is a small table; each feature is one join on the shuffled date."""
    dates = [r[0] for r in panel.select(at).distinct().orderBy(at).collect()]
    draw, out = np.random.default_rng(seed), None
    weight = lambda x: F.coalesce(F.try_divide(F.greatest(x, F.lit(0.0)), F.sum(F.greatest(x, F.lit(0.0))).over(w)), F.lit(0.0))
    from pyspark.sql import Window

    w = Window.partitionBy(at)
    for name in features:
        mixed = [dates[i] for i in draw.permutation(len(dates))]
        table = panel.sparkSession.createDataFrame(list(zip(dates, mixed, strict=True)), f"{at} date, __from date")
        other = panel.select(F.col(at).alias("__from"), "ticker", F.col(name).alias("__x"))
        both = panel.join(F.broadcast(table), at).join(other, ["__from", "ticker"])
        score = sum((F.col(c) for c in features), F.lit(0.0))
        moved = score - F.col(name) + F.col("__x")
        part = both.withColumns({"a": weight(score), "b": weight(moved)}).groupBy(at).agg((F.sum(F.abs(F.col("a") - F.col("b"))) / 2).alias("s")).agg(F.lit(name).alias("feature"), F.avg("s").alias("shift"))
        out = part if out is None else out.unionByName(part)
    return out


def differential_sharpe(returns: DataFrame, decay: float, by: str = "policy", at: str = "date", value: str = "r") -> DataFrame:
    """Step-wise change of an exponentially weighted Sharpe ratio (Moody and Saffell 2001)."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, a, b, out = rows.sort_values(at), 0.0, 0.0, []
        for r in rows[value]:
            spread = b - a * a
            out.append((b * (r - a) - 0.5 * a * (r * r - b)) / spread**1.5 if spread > 1e-12 else 0.0)
            a, b = a + decay * (r - a), b + decay * (r * r - b)
        return pd.DataFrame({by: rows[by], at: rows[at], "reward": out})

    return returns.select(by, at, value).groupBy(by).applyInPandas(run, f"{by} string, {at} date, reward double")


def random_slices(panel: DataFrame, length: int, count: int, seed: int, at: str = "date") -> DataFrame:
    """(slice, date, ticker): so many runs of sessions with seeded starts."""
    from .splits import numbered

    dates = numbered(panel, at)
    n = dates.count()
    starts = np.random.default_rng(seed).choice(max(n - length + 1, 1), size=min(count, max(n - length + 1, 1)), replace=False)
    table = panel.sparkSession.createDataFrame([(k, int(s)) for k, s in enumerate(sorted(starts))], "slice int, s int")
    kept = dates.join(F.broadcast(table), (F.col("i") >= F.col("s")) & (F.col("i") < F.col("s") + length)).select("slice", at)
    return panel.join(F.broadcast(kept), at).select("slice", at, "ticker")


#: Names that labels of a sentiment model may have.
POSITIVE_NAMES, NEGATIVE_NAMES, NEUTRAL_NAMES = ("positive", "pos", "bullish"), ("negative", "neg", "bearish"), ("neutral", "neu", "none")


def label_values(labels: list[str], given: dict[str, float] | None = None) -> dict[str, float]:
    """1, -1 or 0 for each label by its name, or the values given. Labels that can't be told apart are an error."""
    if given:
        if unknown := set(given) - set(labels):
            raise ValueError(f"no such labels: {', '.join(sorted(unknown))}")
        return {x: float(given.get(x, 0.0)) for x in labels}
    kind = lambda x: next((v for v, names in ((1.0, POSITIVE_NAMES), (-1.0, NEGATIVE_NAMES), (0.0, NEUTRAL_NAMES)) if x.strip().lower() in names), 0.0)
    values = {x: kind(x) for x in labels}
    if not {1.0, -1.0} <= set(values.values()):
        raise ValueError(f"no positive and negative label among {', '.join(labels)}")
    return values


def differential_ratios(returns: DataFrame, decay: float, clip: float, by: str = "policy", at: str = "date", value: str = "r") -> DataFrame:
    """Differential Sharpe and downside ratios (Moody and Saffell 2001) of each step, from the moments before it, clipped."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, a, b, d, out = rows.sort_values(at), 0.0, 0.0, 0.0, []
        for r in rows[value]:
            spread = b - a * a
            sharpe = (b * (r - a) - 0.5 * a * (r * r - b)) / spread**1.5 if spread > 1e-12 else 0.0
            if d <= 1e-12:
                down = 0.0
            elif r > 0:
                down = (r - 0.5 * a) / d**0.5
            else:
                down = (d * (r - 0.5 * a) - 0.5 * a * r * r) / d**1.5
            out.append((min(max(sharpe, -clip), clip), min(max(down, -clip), clip)))
            a, b, d = a + decay * (r - a), b + decay * (r * r - b), d + decay * (min(r, 0.0) ** 2 - d)
        return pd.DataFrame({by: rows[by], at: rows[at], "sharpe_term": [x for x, _ in out], "downside_term": [x for _, x in out]})

    return returns.select(by, at, value).groupBy(by).applyInPandas(run, f"{by} string, {at} date, sharpe_term double, downside_term double")


def group_attribution(panel: DataFrame, groups: dict[str, list[str]], policy: Callable[[np.ndarray], np.ndarray], realised: str, repeats: int, seed: int, at: str = "date") -> DataFrame:
    """What shuffling the dates of a group of features does to a policy: group, repeat, features, the change of its return and Sharpe
    ratio, action_shift (mean half L1 distance of its weights) and base_cumulative_return.

    policy turns a date's features (names x features, in the order of groups) into weights of the names. A group and repeat has one
    permutation of dates, drawn by its own counter, for all of its features. A date is one row with a matrix of its names in order;
    it meets the matrices that the permutations put in its place, and all of them are scored in one call of a task. A name that the drawn
    date lacks keeps its own features. Weights of a date earn each name's next realised return, without costs."""
    from pyspark.sql import Window

    from .metrics import equity_metrics
    from .resampling import stream

    names = [c for g in groups.values() for c in g]
    ahead = F.coalesce(F.lead(realised).over(Window.partitionBy("ticker").orderBy(at)), F.lit(0.0))
    item = F.struct("ticker", F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in names)).alias("x"), "__next")
    dated = panel.withColumn("__next", ahead).groupBy(at).agg(F.array_sort(F.collect_list(item)).alias("s"))  # a date's names are a dimension
    days = [r[0] for r in panel.select(at).distinct().orderBy(at).collect()]
    table = [(g, k, d, days[i]) for g in groups for k in range(repeats) for d, i in zip(days, stream(seed, g, k).permutation(len(days)), strict=True)]
    drawn = panel.sparkSession.createDataFrame(table, f"group string, repeat int, {at} date, __from date")
    mixed = drawn.join(dated.select(F.col(at).alias("__from"), F.struct(F.transform("s", lambda x: x["ticker"]).alias("t"), F.transform("s", lambda x: x["x"]).alias("x")).alias("m")), "__from")
    met = mixed.groupBy(at).agg(F.collect_list(F.struct("group", "repeat", "m")).alias("drawn")).join(dated, at)
    places = {g: [names.index(c) for c in own] for g, own in groups.items()}

    def score(batches):
        for batch in batches:
            out = []
            for day, own, others in zip(batch[at], batch["s"], batch["drawn"], strict=True):
                tickers = [r["ticker"] for r in own]
                x, ahead = np.stack([np.asarray(r["x"], float) for r in own]), np.array([r["__next"] for r in own], float)
                base = np.asarray(policy(x.copy()), float)
                for o in others:
                    at_name = {t: k for k, t in enumerate(o["m"]["t"])}
                    rows = [at_name.get(t, -1) for t in tickers]
                    there = np.array([r >= 0 for r in rows])
                    y, columns = x.copy(), places[o["group"]]
                    if there.any():
                        y[np.ix_(there, columns)] = np.stack([np.asarray(o["m"]["x"][r], float) for r in rows if r >= 0])[:, columns]
                    w = np.asarray(policy(y), float)
                    out.append((o["group"], o["repeat"], day, float(base @ ahead), float(w @ ahead), float(np.abs(base - w).sum() / 2)))
            yield pd.DataFrame(out, columns=["group", "repeat", at, "base", "mixed", "shift"])

    steps = met.mapInPandas(score, f"group string, repeat int, {at} date, base double, mixed double, shift double")
    kinds = F.explode(F.array(*(F.struct(F.lit(n).alias("n"), F.col(n).alias("r")) for n in ("base", "mixed")))).alias("e")
    long = steps.select("group", "repeat", at, kinds).withColumn("policy", F.to_json(F.struct("group", "repeat", "e.n")))
    past = Window.partitionBy("policy").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    m = equity_metrics(long.withColumn("value", F.product(1 + F.col("e.r")).over(past)), at=at)
    read = m.withColumn("p", F.from_json("policy", "group string, repeat int, n string")).select("p.*", "cumulative_return", "sharpe")
    side = lambda n: read.where(F.col("n") == n).select("group", "repeat", F.col("cumulative_return").alias(f"{n}_return"), F.col("sharpe").alias(f"{n}_sharpe"))
    shifts = steps.groupBy("group", "repeat").agg(F.avg("shift").alias("action_shift"))
    sizes = F.create_map(*(F.lit(v) for g, own in groups.items() for v in (g, len(own))))
    return side("base").join(side("mixed"), ["group", "repeat"]).join(shifts, ["group", "repeat"]).select(
        "group", "repeat", F.try_element_at(sizes, F.col("group")).alias("features"), (F.col("mixed_return") - F.col("base_return")).alias("delta_cumulative_return"),
        (F.col("mixed_sharpe") - F.col("base_sharpe")).alias("delta_sharpe"), "action_shift", F.col("base_return").alias("base_cumulative_return"),
    )
