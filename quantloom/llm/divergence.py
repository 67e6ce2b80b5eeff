"""Source divergence audit: how far the word shares of the sources of a language lie apart, and which terms tell a source.

Terms are runs of ASCII letters and of characters beyond ASCII; only A-Z are lower-cased. A language keeps the terms
found in MIN_DOCS of its documents. A group's (language and source, or the whole language) share of a term is the integer
p = 1 + floor(SCALE * (count + 2) / (N + 2 V)), V the kept terms and N their count in the group, and two groups differ
at a term by floor((p - q)**2 / (p + q)).

Tasks count the terms of their rows by (language, source), so that one row a task, group and term is exchanged, whatever
the length of texts or the size of a group. Counts meet by (language, term) and become one array a term, indexed by the
language's sources (their sorted list, one row a language). Array functions in the JVM make the shares and the contribution of
each pair of sources, which partial sums add up before anything is exchanged.

The arrays' index grows with the groups: it is broadcast up to BROADCAST_GROUPS of them, and beyond that meets the terms by
language and a salt. All arithmetic is in longs: shares are long division in steps of 1000, exact to counts of 9 * 10**15."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, map_arrow

MIN_DOCS, TOP, SCALE_STEPS = 10, 10, 3
#: Groups whose index is broadcast, a few hundred bytes each, and the salts that it meets the terms by beyond.
BROADCAST_GROUPS, SALTS = 20_000, 64
#: Entries of a task's tables of terms before they are handed on.
HELD_TERMS = 400_000

#: The bytes of a term, with A-Z in lower case; every other byte becomes a space.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in UTF-8; null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_LETTERS).split() if text else []


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n, docs: occurrences and documents, one row a task, group and term at least; and for each
    group of a task a row whose term is null."""
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("docs", pa.int64())])

    def out(held):
        for (lang, source), (n, d) in held.items():
            terms = list(n)
            columns = [[lang] * (len(terms) + 1), [source] * (len(terms) + 1), [None, *(t.decode("utf-8", "surrogatepass") for t in terms)], [0, *n.values()], [0, *(d[t] for t in terms)]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def count(batches):
        held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, d = held.setdefault((lang, source), (Counter(), Counter()))
                terms = terms_of(text)
                n.update(terms)
                d.update(set(terms))
            if sum(len(n) for n, _ in held.values()) > HELD_TERMS:
                yield from out(held)
                held = {}
        yield from out(held)

    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return map_arrow(docs.select(blank("lang"), blank("source"), blank("text")), count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column) -> Column:
    """1 + floor(10**9 * count / total) for 0 <= count <= total, in longs: long division, three digits at a time."""
    q, rest = F.lit(0).cast("long"), count.cast("long")
    for _ in range(SCALE_STEPS):
        q, rest = q * 1000 + F.call_function("div", rest * 1000, total), (rest * 1000) % total
    return q + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _index(groups: DataFrame, kept: DataFrame) -> DataFrame:
    """One row a language: sources (sorted), totals (N + 2 V in their order), whole (the language's) and v."""
    v = kept.groupBy("lang").agg(F.count("*").alias("v"))
    n = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("n"))
    rows = groups.join(v, "lang", "left").join(n, ["lang", "source"], "left").select("lang", "source", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("n", F.lit(0)).alias("n"))
    lists = rows.groupBy("lang", "v").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("s"), F.sum("n").alias("n"))
    return lists.select("lang", "v", F.transform("s", lambda x: x["source"]).alias("sources"), F.transform("s", lambda x: x["n"] + 2 * F.col("v")).alias("totals"), (F.col("n") + 2 * F.col("v")).alias("whole"))


def _vectors(kept: DataFrame, index: DataFrame, n_groups: int, broadcast_groups: int) -> DataFrame:
    """lang, term, sources, counts (indexed by source), p (the shares) and q (the language's share)."""
    if n_groups <= broadcast_groups:
        met = kept.join(F.broadcast(index), "lang")
    else:
        salted = index.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        met = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"]).drop("salt")
    at = F.map_from_entries("counts")
    dense = met.withColumn("n", F.transform("sources", lambda s: F.coalesce(F.try_element_at(at, s), F.lit(0).cast("long"))))
    pairs = F.transform(F.arrays_zip("n", "totals"), lambda x: share(x["n"] + 2, x["totals"]))
    total = F.aggregate("n", F.lit(0).cast("long"), lambda a, x: a + x)
    return dense.select("lang", "term", "sources", "n", pairs.alias("p"), share(total + 2, F.col("whole")).alias("q"))


def divergence_audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """lang, source, part, item, value (long), rank (int) of documents(text, lang, source, ...).

    Part 'pair': item is each other source of the language and value the sum of the differences over its kept terms (0
    without any). Part 'term': item is each kept term that the group has, and has more of than the language, value the
    difference from the language, for ranks up to top. Ranks run from 1 in each group and part, by value descending and
    item ascending in UTF-8. Null and empty text, lang and source are ''; a group whose texts are all empty takes part, an
    empty table gives no rows. Every row counts as a document, repeated ones too. Other columns are ignored."""
    parts = term_counts(docs)
    groups_and_terms = cut_lineage(
        parts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        .groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("counts"))
        .where(f"term is null or docs >= {int(min_docs)}")
    )
    groups = groups_and_terms.where("term is null").select("lang", F.explode("counts.source").alias("source"))
    kept = groups_and_terms.where("term is not null").select("lang", "term", "counts")
    index = cut_lineage(_index(groups, kept))
    n_groups = index.agg(F.coalesce(F.sum(F.size("sources")), F.lit(0))).first()[0]
    vectors = _vectors(kept, index, n_groups, broadcast_groups)

    # a row for each term and source, then one for each later source: no row holds more than the sources of a language
    first = vectors.select("lang", "p", F.posexplode("p").alias("i", "pi"))
    later = F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x, k: F.struct((F.col("i") + 1 + k).alias("j"), apart(F.col("pi"), x).alias("f")))
    sums = first.select("lang", "i", F.explode(later).alias("x")).groupBy("lang", "i", "x.j").agg(F.sum("x.f").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value"))
    named = index.select("lang", F.posexplode("sources").alias("i", "source"), "sources").select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).where("i != j")
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = named.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).withColumn("rank", F.row_number().over(w))

    each = vectors.select("lang", "term", "q", F.explode(F.arrays_zip("sources", "n", "p")).alias("x")).where("x.n > 0 and x.p > q")
    term = each.select("lang", F.col("x.sources").alias("source"), F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("x.p"), F.col("q")).alias("value"))
    return pair.unionByName(term.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top))


#: The same rows in DuckDB.
ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
k AS (SELECT lang, term FROM o GROUP BY 1, 2 HAVING count(DISTINCT r) >= 10),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT g.lang, g.source, k.term, coalesce(n, 0)::HUGEINT AS n FROM g JOIN k USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM o GROUP BY 1, 2, 3) USING (lang, source, term)),
s AS (SELECT *, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * count(*) OVER (PARTITION BY lang, source)) AS p FROM c),
l AS (SELECT lang, term, 1 + (1000000000 * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * count(*) OVER (PARTITION BY lang)) AS q FROM (SELECT lang, term, sum(n)::HUGEINT AS n FROM c GROUP BY 1, 2)),
pr AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS v FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
rows AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(v, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pr ON pr.lang = a.lang AND pr.source = a.source AND pr.item = b.source
  UNION ALL SELECT s.lang, s.source, 'term', s.term, ((p - q) * (p - q)) // (p + q) FROM s JOIN l ON s.lang = l.lang AND s.term = l.term WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM rows)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INT) AS rank FROM ranked WHERE part = 'pair' OR rank <= 10"""
