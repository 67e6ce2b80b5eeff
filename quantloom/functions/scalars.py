"""Scalar functions as column expressions; all stay inside generated code."""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def slug(x: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.trim(x)), "[^a-z0-9]+", "_"), F.lit("_"))


def ticker(x: Column, suffix: str) -> Column:
    """Upper case with the exchange suffix appended once."""
    up = F.upper(F.trim(x))
    return F.when(F.endswith(up, F.lit(suffix)), up).otherwise(F.concat(up, F.lit(suffix)))


def parse_number(x: Column) -> Column:
    """A number written with thousands commas; blanks and dashes are null."""
    bare = F.trim(F.regexp_replace(x, ",", ""))
    return F.when(bare.isin("", "-", "n.a.", "N/A"), None).otherwise(bare).try_cast("double")


def codepoint_sentiment(text: Column) -> Column:
    """((sum of code points) mod 200 - 100) / 100. The sum runs over distinct-free characters in the JVM."""
    total = F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), F.lit(0).cast("long"), lambda a, c: a + F.when(c == "", 0).otherwise(F.ascii(c)).cast("long"))
    return (F.pmod(total, F.lit(200)) - 100) / 100


def first_alias(columns: list[str], available: list[str]) -> Column:
    """The first non-null of the aliases that exist; 0 if none does."""
    return F.coalesce(*(F.col(c) for c in columns if c in available), F.lit(0.0))


def feature_group(name: Column, rules: list[tuple[str, str]], other: str = "technical") -> Column:
    """The group of the first prefix that fits."""
    return reduce(lambda rest, rule: F.when(F.startswith(name, F.lit(rule[0])), F.lit(rule[1])).otherwise(rest), reversed(rules), F.lit(other))


def strict_boolean(x: Column) -> Column:
    """true and false in any case; other text is null, for a check to reject."""
    low = F.lower(F.trim(x))
    return F.when(low == "true", True).when(low == "false", False)


def valid_bar(open_: str = "open", high: str = "high", low: str = "low", close: str = "close", volume: str = "volume") -> Column:
    """All prices finite and positive, volume not negative."""
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.col(c) > 0) & (F.col(c) < float("inf"))
    return fine(open_) & fine(high) & fine(low) & fine(close) & F.col(volume).isNotNull() & (F.col(volume) >= 0)


def outside_envelope(tolerance: float = 1e-8) -> Column:
    """high below, or low above, any other price by more than the tolerance."""
    return (F.col("high") < F.greatest("open", "close", "low") - tolerance) | (F.col("low") > F.least("open", "close", "high") + tolerance)


#: Forms of a date as (characters looked at, year-month separator, parts that follow the year).
DATE_FORMS = [(10, "-", 2), (10, "/", 2), (7, "-", 1), (7, "/", 1), (4, "", 0)]


def parse_date(x: Column) -> Column:
    """year-month-day, year/month/day, year-month, year/month or year, at the beginning of the text.

    Each form is tried on as many leading characters as it has in full, so what follows is not looked at, and
    a day that does not exist falls back to its month. Missing parts are 1. Anything else is null."""
    text = F.trim(x)
    out = None
    for length, mark, parts in reversed(DATE_FORMS):
        head = F.substring(text, 1, length)
        month = f"{mark}(1[0-2]|0[1-9]|[1-9])" if parts else ""
        day = f"{mark}(3[01]|[12][0-9]|0[1-9]|[1-9])" if parts > 1 else ""
        pattern = f"^([0-9]{{4}}){month}{day}$"
        piece = lambda k: F.lpad(F.regexp_extract(head, pattern, k), 2, "0")  # noqa: B023, E731
        iso = F.concat_ws("-", F.regexp_extract(head, pattern, 1), piece(2) if parts else F.lit("01"), piece(3) if parts > 1 else F.lit("01"))
        day_of = F.when(head.rlike(pattern) & ~F.startswith(head, F.lit("0000")), F.try_to_timestamp(iso, F.lit("yyyy-MM-dd")).cast("date"))
        out = day_of if out is None else F.coalesce(day_of, out)
    return out


def last_business_day(day: Column, months: int = 1) -> Column:
    """The last weekday of the month so many months later."""
    end = F.last_day(F.add_months(day, months))
    return F.date_sub(end, F.greatest(F.weekday(end) - 4, F.lit(0)))


def release_date(day: Column, rule: Column) -> Column:
    """The date a figure is out: the same day, or the last business day of the next month."""
    return F.when(rule == "same_day", day).otherwise(last_business_day(day))


def clean_text(x: Column) -> Column:
    """White space, the no-break space too, as single spaces; none at the ends, and no final full stops."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "[\\s\\u00a0]+", " ")), "\\.+$", "")


def decision_points(text: Column) -> Column:
    """Signed basis points of a decision: 'hold', 'raise 25 bps', 'cut 50 bps' in any case. Any other text is
    null, for a check to reject."""
    low = clean_text(F.lower(text))
    form = "^(raise|cut) ([0-9]+) bps$"
    size = F.regexp_extract(low, form, 2).try_cast("double")
    return F.when(low == "hold", 0.0).when(low.rlike(form), F.when(F.startswith(low, F.lit("raise")), size).otherwise(-size))


def vote_count(text: Column) -> Column:
    """A single digit, with a footnote mark of digits and a slash behind it or not; else null."""
    return F.regexp_extract(clean_text(text), "^([0-9])([0-9]+/)?$", 1).try_cast("double")


def announcement_date(english: Column, serial: Column | None = None) -> Column:
    """A spreadsheet serial, or day month year with the month's name or short name; of a two-day meeting
    the last day. The other column's serial serves where the first is no serial."""
    number = lambda c: F.when(F.trim(c).rlike("^[0-9]+([.]0+)?$"), F.date_add(F.lit("1899-12-30").cast("date"), F.trim(c).try_cast("double").cast("int")))
    low = F.regexp_replace(clean_text(english), "^[0-9]{1,2}\\s*-\\s*([0-9]{1,2} [A-Za-z]+ [0-9]{4})$", "$1")
    named = F.initcap(F.lower(F.regexp_replace(low, "^([0-9]{1,2})-([A-Za-z]+)-([0-9]{4})$", "$1 $2 $3")))
    forms = [F.try_to_timestamp(named, F.lit(f)).cast("date") for f in ("d MMMM yyyy", "d MMM yyyy")]
    return F.coalesce(*([number(english)] if serial is None else [number(english), number(serial)]), *forms)


#: Rate of commission for a day's traded value up to each bound, and the fees of the exchange,
#: of clearing and of the regulator.
COMMISSION_TIERS = [(5_000_000.0, 0.00157), (10_000_000.0, 0.00137), (20_000_000.0, 0.00117), (float("inf"), 0.00107)]
EXCHANGE_FEES = (0.00005, 0.00001, 0.00001)
VAT = 0.07


def commission_rate(value: Column, tiers: list[tuple[float, float]] | None = None) -> Column:
    """Rate of the first tier whose bound the value does not pass; null for a negative value."""
    out = None
    for bound, rate in reversed(tiers or COMMISSION_TIERS):
        out = F.lit(rate) if out is None else F.when(value <= bound, F.lit(rate)).otherwise(out)
    return F.when(value >= 0, out)


def side_cost(value: Column) -> Column:
    """Cost of one side as a share of its value: commission and fees, and tax on their sum, to seven places."""
    return F.round((commission_rate(value) + sum(EXCHANGE_FEES)) * (1 + VAT), 7)


def budget(weight: Column, total: Column) -> Column:
    """Long-only weight scaled down where the weights add up to more than one."""
    w = F.greatest(weight, F.lit(0.0))
    return F.when(total > 1, w / total).otherwise(w)


def canonical_json(*columns: str) -> Column:
    """A row as JSON with its keys in order."""
    return F.to_json(F.struct(*sorted(columns)))


def normal_cdf() -> callable:
    """Standard normal distribution function; neither engine has erf."""

    @F.pandas_udf("double")
    def cdf(x: pd.Series) -> pd.Series:
        n = NormalDist()
        return x.map(lambda v: None if pd.isna(v) else n.cdf(v))

    return cdf


#: Algorithms that learn from a replay buffer.
OFF_POLICY = ("ddpg", "td3", "sac")


def work_units(algorithm: Column, steps: Column, learning_starts: int = 0, train_freq: int = 1, gradient_steps: int = 1, batch_size: int = 1) -> Column:
    """Environment steps; for off-policy algorithms also the rows of all gradient steps after the start."""
    updates = F.floor(F.greatest(steps - learning_starts, F.lit(0)) / max(train_freq, 1))
    return (steps + F.when(algorithm.isin(*OFF_POLICY), updates * max(gradient_steps, 1) * max(batch_size, 1)).otherwise(0)).cast("long")


def by_prefix(columns: list[str], prefixes: tuple[str, ...]) -> list[str]:
    """The columns that begin with one of the prefixes, in their order."""
    return [c for c in columns if c.startswith(prefixes)]


def headroom(limit: Column, used: Column) -> Column:
    return F.greatest(limit - used, F.lit(0.0))


def masked_budget(df: DataFrame, raw: str, mask: str, by: list[str], most: float = 1.0, least_cash: float = 0.0) -> DataFrame:
    """df with weight: raw clipped to [0, most], 0 outside the mask or where raw is null, scaled down where the
    weights of a group add up to more than 1 - least_cash."""
    w = F.when(F.coalesce(F.col(mask), F.lit(False)), F.least(F.greatest(F.coalesce(raw, F.lit(0.0)), F.lit(0.0)), F.lit(most))).otherwise(0.0)
    x = df.withColumn("__w", w).withColumn("__t", F.sum("__w").over(Window.partitionBy(*by)))
    return x.withColumn("weight", F.when(F.col("__t") > 1 - least_cash, F.col("__w") / F.col("__t") * (1 - least_cash)).otherwise(F.col("__w"))).drop("__w", "__t")


def canonical_sector(sectors: list[str]) -> callable:
    """Text to one of the sectors: compatibility forms (NFKC), ' and ' as &, single spaces, any case; else null.

    Neither engine has NFKC, so whole Arrow batches go through Python."""
    table = {s.casefold(): s for s in sectors}

    @F.pandas_udf("string")
    def sector(x: pd.Series) -> pd.Series:
        def one(v):
            text = unicodedata.normalize("NFKC", v).replace(" and ", " & ")
            return table.get(re.sub(r"\s+", " ", re.sub(r"\s*&\s*", " & ", text)).strip().casefold())

        return x.map(lambda v: None if v is None else one(v))

    return sector


def normal_quantile() -> callable:
    """The inverse of normal_cdf; null at and outside 0 and 1."""

    @F.pandas_udf("double")
    def quantile(p: pd.Series) -> pd.Series:
        n = NormalDist()
        return p.map(lambda v: n.inv_cdf(v) if not pd.isna(v) and 0 < v < 1 else None)

    return quantile
