"""Licence scans by digest of canonical text.

A text becomes canonical when copyright lines are dropped, case and punctuation go, and spellings
that licences treat as equal become one. Entire texts that are equal after that have the same
digest. A document's units are its whole text and each of its lines, so a notice on a line of its
own is found as well; units meet the known digests in a hash join.

The work is one pass of string functions over the text, then a join of digests. Known digests are
few; Spark broadcasts them below its size limit and shuffles beyond it."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Notices and short licence texts by SPDX name.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("All-rights-reserved", "All rights reserved."),
]
#: Spellings that count as equal, as (pattern, replacement) over lower-case text.
SPELLINGS = [("licence", "license"), ("sub[ -]license", "sublicense"), ("sub[ -]licensable", "sublicensable"), ("organisation", "organization"), ("modelling", "modeling"), ("favour", "favor"), ("https", "http")]
#: A line that names the owner of the rights: it has a year or a sign. A line of running text may begin with the
#: word as well, where a licence is wrapped so; it stays.
COPYRIGHT = "(?m)^[ \\t]*(copyright[^\\n]*([0-9]{4}|\\(c\\)|©)|\\(c\\)|©)[^\\n]*$"
#: What stands between words: anything but letters, digits and line ends.
BETWEEN = "[^a-z0-9\\x80-\\x{10FFFF}\\n]+"


def canonical_lines(text: Column) -> Column:
    """The canonical text with its line ends; null is empty."""
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT, "")
    for pattern, plain in SPELLINGS:
        out = F.regexp_replace(out, pattern, plain)
    return F.regexp_replace(out, BETWEEN, " ")


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, whole (whether the unit is the entire text) and digest of each unit with any word."""
    lines = F.transform(F.split(F.col("c"), "\n"), lambda x: F.trim(x))
    whole = F.trim(F.regexp_replace(F.col("c"), "[ \\n]+", " "))
    units = docs.select("doc_id", canonical_lines(F.col("text").cast("string")).alias("c")).select("doc_id", F.explode(F.concat(F.array(F.struct(F.lit(True).alias("whole"), whole.alias("u"))), F.transform(lines, lambda x: F.struct(F.lit(False).alias("whole"), x.alias("u"))))).alias("x"))
    return units.where("x.u != '' or x.whole").select("doc_id", "x.whole", F.md5("x.u").alias("digest"))


def known_digests(texts: DataFrame) -> DataFrame:
    """digest and license of texts(license, text); of licences with the same text the first by name."""
    whole = F.trim(F.regexp_replace(canonical_lines(F.col("text")), "[ \\n]+", " "))
    return texts.where("license is not null and text is not null").groupBy(F.md5(whole).alias("digest")).agg(F.min("license").alias("license"))


def whole_texts() -> list[tuple[str, str]]:
    """(name, text) of the whole licences in the folder licenses; the name is the file's without .titled.txt or .txt."""
    files = sorted((Path(__file__).parent / "licenses").glob("*.txt"))
    return [(f.name.removesuffix(".txt").removesuffix(".titled"), f.read_text("utf-8")) for f in files]


def known_texts(spark: SparkSession) -> DataFrame:
    """The notices and the whole licence texts. oracle() has the notices alone, so it is the same where no document is a whole licence."""
    return spark.createDataFrame(KNOWN + whole_texts(), "license string, text string")


def license_scan(docs: DataFrame, texts: DataFrame) -> DataFrame:
    """The licences of each doc_id of documents(doc_id, text, ...).

    Returns doc_id, whole_license (of the entire text, null if unknown), licenses (names found in
    whole texts or lines, sorted, comma-joined, empty if none) and n_license_lines. Null and empty
    texts have no licence. Rows that repeat a doc_id are one result; null is a doc_id like any
    other. Other columns are ignored. Copyright lines alone are no licence."""
    joined = digests(docs).join(known_digests(texts), "digest", "left")
    return joined.groupBy("doc_id").agg(
        F.min(F.when(F.col("whole"), F.col("license"))).alias("whole_license"),
        F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"),
        F.count_if(~F.col("whole") & F.col("license").isNotNull()).alias("n_license_lines"),
    )


def _sql_canonical(text: str) -> str:
    out = f"regexp_replace(lower(coalesce({text}, '')), '{COPYRIGHT}', '', 'g')"
    for pattern, plain in SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{plain}', 'g')"
    return f"regexp_replace({out}, '[^a-z0-9\\x{{80}}-\\x{{10FFFF}}\\n]+', ' ', 'g')"


def oracle() -> str:
    values = ", ".join("('{}', '{}')".format(a, b.replace("'", "''")) for a, b in KNOWN)
    whole = lambda c: f"trim(regexp_replace({c}, '[ \\n]+', ' ', 'g'))"
    return f"""
    WITH known AS (SELECT md5({whole(_sql_canonical('t'))}) AS digest, min(l) AS license FROM (VALUES {values}) k(l, t) GROUP BY 1),
    c AS (SELECT doc_id, {_sql_canonical('text')} AS c FROM documents),
    units AS (
      SELECT doc_id, true AS whole, {whole('c')} AS u FROM c
      UNION ALL SELECT doc_id, false, u FROM (SELECT doc_id, trim(unnest(string_split(c, chr(10)))) AS u FROM c) WHERE u <> ''),
    j AS (SELECT doc_id, whole, license FROM units LEFT JOIN known ON md5(u) = digest)
    SELECT doc_id, min(CASE WHEN whole THEN license END) AS whole_license,
      coalesce(string_agg(DISTINCT license, ',' ORDER BY license), '') AS licenses,
      CAST(count(*) FILTER (NOT whole AND license IS NOT NULL) AS BIGINT) AS n_license_lines
    FROM j GROUP BY doc_id"""
