"""Quality rules: length and repetition rules, then a hashed n-gram log-likelihood ratio.

The n-grams of a text, of all orders up to ORDER (single words by default), are hashed into BUCKETS buckets.
Two multinomials over the buckets are counted: of the trusted target and of the raw corpus, each over all of
its rows. A text's score is the sum of log(target / raw) over its n-grams, divided by their number; it is kept
at a score of at least MIN_SCORE. Added to each bucket alike, SMOOTHING makes all scores lower while the trusted
words are few against the buckets. With a prior, a bucket's trusted words are held against those expected from
its share of the raw corpus, with so many words added to both: a bucket with too little evidence weighs about 0
whatever the size. Everything is DataFrame functions: one pass counts (a partial sum in each task, so at most
BUCKETS rows leave it). Texts do not meet their labels, ids do: a fixed bit filter of trusted ids (common.FILTER_WORDS
numbers, one bit an id) tells most texts to be not trusted, and one of the ids that pass it wrongly tells most others
to be trusted. What passes both is joined, which is exact. A second pass scores without an exchange.

The filters and the table of weights have a fixed size whatever the input, and reach the tasks as scalar
subqueries. Arrays that a lambda indexes are bound by let(), since an expression inside a lambda
would be computed again for each element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import may_hold, packed

BUCKETS = 1 << 15
MIN_SCORE = -0.1
#: Words of the longest n-grams.
ORDER = 1
#: Added to the count of each bucket in both multinomials.
SMOOTHING = 1.0
#: What the registered query and the pipeline use: words and word pairs, and five words added to a bucket's
#: trusted and expected words. The share of unlabelled documents kept was compared at three table sizes.
PRODUCTION = {"buckets": 1 << 17, "order": 2, "prior": 5.0, "min_score": -0.15}
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "[#*$%&|<>]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _blank(text: Column) -> Column:
    """The text with a space for each white space; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in "\t\n\x0b\x0c\r":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return out


def words_of(text: Column) -> Column:
    """The words of a text; null has none."""
    return F.array_remove(F.split(_blank(text), " "), "")


def _starts(items: Column, order: int) -> Column:
    """The elements that an n-gram of this order starts at."""
    return items if order == 1 else F.slice(items, 1, F.greatest(F.size(items) - (order - 1), F.lit(0)))


def grams(hashes: Column, n: int) -> Column:
    """A hash of each run of n words, from the hashes of words. hashes must be a bound variable."""
    return hashes if n == 1 else F.transform(_starts(hashes, n), lambda x, i: F.xxhash64(x, *(F.get(hashes, i + d) for d in range(1, n))))


def ngram_hashes(hashes: Column, order: int) -> Column:
    """The hashes of all n-grams of 1 to order words."""
    return hashes if order == 1 else F.concat(*(grams(hashes, n) for n in range(1, order + 1)))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _ngrams(texts: DataFrame, buckets: int, order: int) -> DataFrame:
    """t and bucket of each n-gram of texts(t, text)."""
    if order == 1:
        rows = texts.select("t", F.explode(F.split(_blank(F.col("text")), " ")).alias("w")).where("w != ''").select("t", F.xxhash64("w").alias("h"))
    else:
        rows = texts.select("t", F.explode(let(word_hashes(words_of(F.col("text"))), lambda h: ngram_hashes(h, order))).alias("h"))
    return rows.select("t", F.pmod("h", F.lit(buckets)).alias("bucket"))


def marked_texts(docs: DataFrame, target: DataFrame) -> DataFrame:
    """text, and t: whether target has the row's doc_id; a null doc_id is never trusted.

    Texts that the filter holds back are surely not trusted. Nearly all others are, so first only their ids meet the
    trusted ones, and a second filter, of the ids that passed wrongly, tells which texts are surely trusted. Both kinds
    stay where they are; only texts that pass both filters are joined."""
    trusted = target.select(F.col("doc_id").alias("__id")).where("__id is not null").distinct().hint("shuffle_hash")
    near = F.col("doc_id").isNotNull() & may_hold(trusted, F.col("doc_id"))
    wrong = docs.select("doc_id").where(near).join(trusted, F.col("doc_id") == F.col("__id"), "left_anti")
    screened = docs.select("doc_id", "text").withColumn("__near", near).withColumn("__open", F.col("__near") & may_hold(wrong, F.col("doc_id")))
    joined = screened.where("__open").join(trusted, F.col("doc_id") == F.col("__id"), "left").select("text", F.col("__id").isNotNull().alias("t"))
    return joined.unionByName(screened.where("not __open").select("text", F.col("__near").alias("t")))


def bucket_weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, smoothing: float = SMOOTHING, order: int = ORDER, prior: float | None = None) -> DataFrame:
    """One row, w: log(target / raw) of each bucket, in the order of the buckets.

    target has the doc_ids of the trusted rows. Without any trusted n-gram all weights are 0. With a
    prior, smoothing is not used and the weight is log((tgt + prior) / (n_tgt * raw / n_raw + prior))."""
    marked = marked_texts(docs.select(F.col("doc_id").cast("long"), "text"), target.select(F.col("doc_id").cast("long")))
    counts = _ngrams(marked, buckets, order).groupBy("bucket").agg(F.count("*").alias("raw"), F.count_if("t").alias("tgt"))
    full = docs.sparkSession.range(buckets).select(F.col("id").alias("bucket")).join(counts, "bucket", "left").select("bucket", F.coalesce("raw", F.lit(0)).alias("raw"), F.coalesce("tgt", F.lit(0)).alias("tgt"))
    lists = full.agg(F.sort_array(F.collect_list(F.struct("bucket", "raw", "tgt"))).alias("c"), F.sum("raw").alias("n_raw"), F.sum("tgt").alias("n_tgt"))
    extra = smoothing * buckets
    ratio = lambda x: F.log((x["tgt"] + smoothing) / (F.col("n_tgt") + extra)) - F.log((x["raw"] + smoothing) / (F.col("n_raw") + extra))
    if prior is not None:
        ratio = lambda x: F.log((x["tgt"] + prior) / (F.col("n_tgt") * x["raw"] / F.col("n_raw") + prior))
    return lists.select(F.transform("c", lambda x: F.when(F.col("n_tgt") == 0, F.lit(0.0)).otherwise(ratio(x))).alias("w"))


def _repeat_words(words: Column, hashes: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more, the first occurrence included.

    words and hashes are bound variables. Two hashes stand for a window's words (96 bits): one tells
    almost all texts to have no repeat, both together sort the windows of the others."""

    def exact(found: Column) -> Column:
        both = F.sort_array(F.transform(found, lambda g, i: F.struct(g.alias("g"), F.hash(*(F.get(words, i + d) for d in range(window))).alias("k"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, j: F.get(s, j)["g"].eqNullSafe(x["g"]) & F.get(s, j)["k"].eqNullSafe(x["k"])
            return F.sort_array(F.transform(F.filter(s, lambda x, j: ((j > 0) & same(x, j - 1)) | same(x, j + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(-window).alias("at"), F.lit(0).alias("n"))
        return F.aggregate(let(both, positions), start, lambda a, i: F.struct(i.alias("at"), (a["n"] + F.least(F.lit(window), i - a["at"])).alias("n")), lambda a: a["n"])

    screened = lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(exact(g))
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(let(grams(hashes, window), screened))


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _judged(rows: DataFrame, target: DataFrame, buckets: int, min_score: float, order: int, counts: bool, prior: float | None) -> DataFrame:
    """rows(doc_id, text, rest) with a struct f of the figures and the verdict; see quality_rules. Without
    counts the struct has no n_symbols and n_dup_lines.

    The struct is one expression that computes everything once, so a filter on it that the
    optimizer moves down still does."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    extra = [F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), _dup_lines(text).cast("long").alias("n_dup_lines")] if counts else []

    def of_hashes(w: Column, h: Column) -> Column:
        total = lambda g: F.aggregate(g, F.lit(0.0), lambda a, x: a + F.get(F.col("w"), F.pmod(x, F.lit(buckets)).cast("int")))
        score = let(ngram_hashes(h, order), lambda g: F.when(F.size(g) == 0, F.lit(0.0)).otherwise(total(g) / F.size(g)))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), *extra, _repeat_words(w, h).cast("long").alias("n_repeat_words"), score.alias("score"))

    def verdict(p: Column) -> Column:
        failed = (p["n_words"] < MIN_WORDS) | (100 * p["n_repeat_words"] > MAX_REPEAT_PERCENT * p["n_words"])
        names = ["n_words", "word_chars", *(["n_symbols", "n_dup_lines"] if counts else []), "n_repeat_words", "score"]
        return F.struct(*(p[c].alias(c) for c in names), failed.alias("base_failed"), (~failed & (p["score"] >= min_score)).alias("kept"))

    figures = let(let(words_of(text), lambda w: let(word_hashes(w), lambda h: of_hashes(w, h))), verdict)
    weighted = rows.withColumn("w", bucket_weights(rows.select("doc_id", F.col("text").cast("string")), target, buckets, order=order, prior=prior).scalar())
    return weighted.select("doc_id", "text", "rest", figures.alias("f"))


def quality_rules(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_score: float = MIN_SCORE, order: int = ORDER, prior: float | None = None) -> DataFrame:
    """The figures and the verdict for each row of documents(doc_id, text, ...).

    Returns doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long), score
    (double, 0 without n-grams), base_failed (under 10 words, or over 20 % of the words in repeated
    windows) and kept (not base_failed and score >= min_score). Null and empty texts have no words
    and fail. Rows that repeat a doc_id each get a row; a null doc_id is never trusted. Other
    columns are ignored. With no trusted rows all scores are 0. For prior see bucket_weights."""
    rows, _ = packed(docs.select("doc_id", "text"))
    return _judged(rows, target, buckets, min_score, order, True, prior).select("doc_id", "f.*")


def filter_documents(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, min_score: float = MIN_SCORE, order: int = ORDER, prior: float | None = None) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns, whatever their names."""
    rows, back = packed(docs)
    return back(_judged(rows, target, buckets, min_score, order, False, prior).where("f.kept"))
