"""Operator 2, line dedup: explode, hash, count documents, drop, reassemble. DataFrame functions only."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BLANKS, row_key, table, written

MIN_CHARS, MIN_DOCS = 40, 5


def line_dedup(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """Drop lines whose key is in at least `min_docs` documents, except in the largest doc_id that holds it.

    Returns all columns of `docs` (a column named like a new one is replaced) with `text` rewritten, and
    `n_lines`, `n_dropped`. Null or empty text is one empty line. A null doc_id counts as no document and is
    never the largest. Repeated rows are decided alike. An empty table gives an empty table.
    """
    r1, r2 = row_key(F.col("doc_id"), F.col("text"))
    base = docs.drop("n_lines", "n_dropped").withColumns({"__r1": r1, "__r2": r2})
    lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    key = F.translate(F.btrim(F.col("line"), F.lit(BLANKS)), string.ascii_uppercase, string.ascii_lowercase)
    keyed = (
        base.select("doc_id", "__r1", "__r2", F.posexplode(lines).alias("pos", "line"))
        .where(F.length("line") >= min_chars)
        .select("doc_id", "__r1", "__r2", "pos", key.alias("key"))
        .where(F.length("key") >= min_chars)
        .select("doc_id", "__r1", "__r2", "pos", F.xxhash64(F.lit(1), "key").alias("k1"), F.xxhash64("key", F.lit(2)).alias("k2"))
    )
    common = (
        keyed.groupBy("k1", "k2", "doc_id").agg(F.lit(1).alias("one"))
        .groupBy("k1", "k2").agg(F.count("doc_id").alias("n"), F.max("doc_id").alias("keeper"))
        .where(F.col("n") >= min_docs).select("k1", "k2", "keeper")
    )
    # Written, so that both sides of the join are plain exchanges, which Spark can split where a line is very common.
    common = written(common, "common-lines")
    dropped = (
        keyed.join(common, ["k1", "k2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
        .groupBy("__r1", "__r2").agg(F.collect_set("pos").alias("__gone"))
    )
    left = F.when(F.col("__gone").isNull(), F.col("__lines")).otherwise(
        F.transform(F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone")), lambda i: F.col("__lines")[i])
    )
    return (
        base.join(dropped, ["__r1", "__r2"], "left")
        .withColumn("__lines", lines)
        .withColumns({"text": F.array_join(left, "\n"), "n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")})
        .withColumn("n_dropped", F.greatest("n_dropped", F.lit(0).cast("long")))
        .drop("__r1", "__r2", "__gone", "__lines")
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """line_dedup() of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines
), hot AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (keeper IS NOT NULL AND keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM keyed LEFT JOIN hot USING (k) GROUP BY doc_id
"""
