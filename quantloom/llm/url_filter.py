"""URL filters by dated lists.

A list is a log of dated entries: a key (a host or a domain) is added to a category or taken off
it. An entry is active from its date until the next entry of the same key and category: its
validity interval. A capture is looked up under its host and every parent domain, and is judged by
the entries active at its fetch time, as an equi join on the key with a containment in the
interval. Intervals of a key and category don't overlap, so each gives one entry at most: the as-of entry.

A host may hold a third of all captures. Captures are first counted into distinct (host, day)
pairs, a partial sum in each task, so lists meet days and not captures; the verdicts go back to
the captures by (host, day), where the side with the verdicts is unique and Spark splits a large
partition of the other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A host that is an address: four numbers, or anything in brackets.
ADDRESS = "^([0-9]{1,3}([.][0-9]{1,3}){3}|\\[.*\\])$"


def url_host(url: Column) -> Column:
    """The lower-case host of a URL without user, port and final dot; null where there is none. An address in brackets keeps them."""
    host = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), "^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\\[[^\\]/?#@]*\\]|[^/?#:@\\[\\]]+)", 1))
    return F.nullif(F.rtrim(host, F.lit(".")), F.lit(""))


def host_keys(host: Column) -> Column:
    """The host and its parent domains of two labels or more; an IP address has none."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    lengths = F.sequence(F.lit(1), F.greatest(n, F.lit(1)))
    parents = F.transform(F.filter(lengths, lambda k: k >= 2), lambda k: F.array_join(F.slice(parts, n - k + 1, k), "."))
    return F.when(host.rlike(ADDRESS), F.array(host)).otherwise(F.array_distinct(F.concat(F.array(host), parents)))


def validity(entries: DataFrame) -> DataFrame:
    """key, category, valid_from, valid_to (exclusive, null: open) of the additions in entries(key,
    category, action, entry_date). Of entries of one day a removal counts before an addition."""
    clean = entries.where("key is not null and category is not null and entry_date is not null and action in ('add', 'remove')").groupBy("key", "category", "entry_date").agg(F.min("action").alias("action"))
    steps = clean.groupBy("key", "category").agg(F.sort_array(F.collect_list(F.struct("entry_date", "action"))).alias("s"))
    pairs = steps.select("key", "category", F.posexplode("s").alias("i", "e"), "s")
    return pairs.where("e.action = 'add'").select("key", "category", F.col("e.entry_date").alias("valid_from"), F.get(F.col("s"), F.col("i") + 1)["entry_date"].alias("valid_to"))


def url_filter(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures(url, fetch_date, ...) with host, categories (sorted, comma-joined), n_active and blocked.

    Every row of captures gives one row with its columns; host, categories, n_active and blocked
    replace columns of these names. An active entry of category 'allow' for a key frees a capture
    from entries of shorter keys; blocked is true if an entry of another category is active on a
    key at least as long as the longest allowed one, and not allowed itself. Without a URL, host or
    fetch date nothing is active. Repeated entries count once; entries with a null are left out."""
    names = [c for c in captures.columns if c not in ("host", "categories", "n_active", "blocked")]
    hosts = captures.select(*names, url_host(F.col("url")).alias("host"))
    days = hosts.select("host", "fetch_date").where("host is not null and fetch_date is not null").distinct()
    keyed = days.select("host", "fetch_date", F.explode(host_keys(F.col("host"))).alias("key"))
    on = (F.col("k.key") == F.col("v.key")) & (F.col("v.valid_from") <= F.col("k.fetch_date")) & (F.col("v.valid_to").isNull() | (F.col("k.fetch_date") < F.col("v.valid_to")))
    active = keyed.alias("k").join(validity(entries).alias("v"), on).select("k.host", "k.fetch_date", "k.key", "v.category")
    allowed, listed = F.max(F.when(F.col("category") == "allow", F.length("key"))), F.max(F.when(F.col("category") != "allow", F.length("key")))
    verdicts = active.groupBy("host", "fetch_date").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"), F.count("*").alias("n_active"),
        F.coalesce(listed > F.coalesce(allowed, F.lit(-1)), F.lit(False)).alias("blocked"),
    )
    return hosts.join(verdicts, ["host", "fetch_date"], "left").select(
        *names, "host", F.coalesce("categories", F.lit("")).alias("categories"), F.coalesce("n_active", F.lit(0)).cast("long").alias("n_active"), F.coalesce("blocked", F.lit(False)).alias("blocked")
    )
