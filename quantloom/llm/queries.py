"""The queries of the training-data operators, over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, divergence, jaccard_join, license_scan, line_dedup, quality_classifier, quality_rules, simhash, substring_dedup, token_files, url_filter, vector_codes, wordpieces


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return quality_rules.quality_rules(_table(spark, sf_dir, "documents"), target, **quality_rules.PRODUCTION)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = wordpieces.recode_documents(_table(spark, sf_dir, "documents"), _byte_bpe())
    return both.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "utf-8"), 256).alias("decoded_sha256"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"), license_scan.known_texts(spark))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = decontaminate.contamination(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"]).cast("long"))
    return marked.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kept = line_dedup.apply_bitmaps(docs, line_dedup.line_dedup(docs))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_files.write_token_files(_table(spark, sf_dir, "documents"), token_files.new_folder(spark), _byte_bpe())
    return token_files.read_token_files(manifest)


def _list_entries(pages: DataFrame) -> DataFrame:
    """A dated list made of the pages' own hosts: about a quarter of the hosts and of their domains,
    added on one day of 2024, most taken off and some of these added again; some hosts are allowed."""
    host = url_filter.url_host(F.col("url"))
    keys = pages.select(F.explode(url_filter.host_keys(host)).alias("key")).where("key is not null").distinct().withColumn("n", F.conv(F.substring(F.md5("key"), 1, 6), 16, 10).cast("int"))
    day = lambda x: F.date_add(F.lit("2024-01-01").cast("date"), x)
    first, steps = F.pmod("n", F.lit(200)), F.array(F.struct(F.lit("add").alias("action"), F.lit(0).alias("d")), F.struct(F.lit("remove").alias("action"), F.lit(60).alias("d")), F.struct(F.lit("add").alias("action"), F.lit(90).alias("d")))
    taken = keys.where(F.pmod("n", F.lit(4)) == 0).withColumn("category", F.when(F.pmod("n", F.lit(20)) == 0, "allow").when(F.pmod("n", F.lit(8)) == 0, "malware").otherwise("spam"))
    return taken.select("key", "category", F.explode(F.slice(steps, F.lit(1), F.pmod("n", F.lit(3)) + 1)).alias("s"), first.alias("first")).select("key", "category", "s.action", day(F.col("first") + F.col("s.d")).alias("entry_date"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    captures = pages.withColumn("fetch_date", F.date_add(F.lit("2024-01-01").cast("date"), F.pmod("page_id", F.lit(365)).cast("int")))
    return url_filter.url_filter(captures, _list_entries(pages)).drop("url")


_OP8 = r"""
WITH h AS (SELECT page_id, DATE '2024-01-01' + CAST(page_id % 365 AS INT) AS fetch_date, nullif(rtrim(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)', 1)), '.'), '') AS host FROM pages),
p AS (SELECT DISTINCT host, string_split(host, '.') AS parts FROM h WHERE host IS NOT NULL),
k AS (SELECT DISTINCT host, key FROM (SELECT host, host AS key FROM p UNION ALL SELECT host, array_to_string(parts[len(parts) - n + 1 : len(parts)], '.') FROM (SELECT host, parts, unnest(range(2, len(parts) + 1)) AS n FROM p WHERE NOT regexp_matches(host, '^([0-9]{1,3}([.][0-9]{1,3}){3}|\[.*\])$')))),
m AS (SELECT key, CAST('0x' || substr(md5(key), 1, 6) AS INT) AS n FROM (SELECT DISTINCT key FROM k)),
e AS (SELECT key, CASE WHEN n % 20 = 0 THEN 'allow' WHEN n % 8 = 0 THEN 'malware' ELSE 'spam' END AS category, a, DATE '2024-01-01' + CAST(n % 200 + d AS INT) AS entry_date FROM m JOIN (VALUES (0, 'add', 0), (1, 'remove', 60), (2, 'add', 90)) s(i, a, d) ON i <= n % 3 WHERE n % 4 = 0),
v AS (SELECT key, category, a, entry_date AS valid_from, lead(entry_date) OVER (PARTITION BY key, category ORDER BY entry_date) AS valid_to FROM e),
j AS (SELECT h.page_id, k.key, v.category FROM h JOIN k USING (host) JOIN v ON v.key = k.key AND a = 'add' AND valid_from <= fetch_date AND (valid_to IS NULL OR fetch_date < valid_to)),
g AS (SELECT page_id, string_agg(DISTINCT category, ',' ORDER BY category) AS categories, count(*) AS n_active, coalesce(max(length(key)) FILTER (category <> 'allow') > coalesce(max(length(key)) FILTER (category = 'allow'), -1), false) AS blocked FROM j GROUP BY 1)
SELECT page_id, fetch_date, host, coalesce(categories, '') AS categories, coalesce(n_active, 0) AS n_active, coalesce(blocked, false) AS blocked FROM h LEFT JOIN g USING (page_id)"""


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.substring_dedup(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(_table(spark, sf_dir, "documents"))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_table(spark, sf_dir, "documents"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = vector_codes.encode_vectors(_table(spark, sf_dir, "embeddings"))
    full = vector_codes.with_label_error(coded)
    return full.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", "label_error", F.lit(vector_codes.books_digest(books)).alias("codebooks_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {f.__name__: f for f in (op1_quality_rules, op2_simhash, op3_bpe, op4_license_scan, op5_decontaminate, op6_line_dedup, op7_token_files, op8_url_filter, op9_quality_classifier, op10_substring_dedup, op11_source_divergence, op12_jaccard_join, op13_vector_codes, pipeline)}


def oracle_sql() -> dict[str, str]:
    return {"op4_license_scan": license_scan.oracle(), "op8_url_filter": _OP8, "op11_source_divergence": divergence.ORACLE, "op12_jaccard_join": jaccard_join.ORACLE, "op13_vector_codes": vector_codes.oracle()}
