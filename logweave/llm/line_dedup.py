"""Cross-site boilerplate lines: a line that stands on many sites is removed from every document.

Spread of a line is the number of distinct sites (``source``) that have it.  Lines of one site only are
dropped by a min/max aggregate; for the others HyperLogLog sketches of the sites are built per line hash and
merged by aggregation.  Where a sketch's estimate lies near the threshold, the sites are counted exactly.

Defined cases: a null text has no lines; a null source is no site; lines are compared after trimming
spaces, blank lines are neither counted nor removed; repeated rows are cleaned alike and all returned; an
empty table gives an empty result; extra columns, whatever their names, are kept by ``strip_boilerplate``, whose own two
columns get underscores behind their names where these are taken.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import free_name, saved, skewed_join, table


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_sites(docs: DataFrame) -> DataFrame:
    """One row (h, source) per distinct non-blank line of each document with a site."""
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    return docs.filter(F.col("source").isNotNull() & F.col("text").isNotNull()).select("source", F.explode(hashes).alias("h"))


def boilerplate(docs: DataFrame, min_sites: int = 5, lg_k: int = 12, margin: float = 0.15) -> DataFrame:
    """Hashes ``h`` of lines on at least ``min_sites`` sites.

    A sketch of 2**lg_k registers errs by about 1.04 / 2**(lg_k / 2); estimates within ``margin`` (or 2) of
    the threshold are counted exactly, so ``margin`` must exceed a few such errors.
    """
    # one row per line and site: hot lines shrink to their sites map-side, before anything is dealt out by line
    all_pairs = saved(line_sites(docs).distinct(), "line-sites")
    several = all_pairs.groupBy("h").agg(F.min("source").alias("lo"), F.max("source").alias("hi")).filter("lo <> hi").select("h")
    pairs = saved(all_pairs.join(several, "h", "left_semi"), "line-pairs")
    est = saved(pairs.groupBy("h").agg(F.hll_sketch_agg("source", F.lit(lg_k)).alias("sketch")).select("h", F.hll_sketch_estimate("sketch").alias("sites")), "line-estimates")
    slack = max(2, int(min_sites * margin))
    near = est.filter(F.col("sites").between(min_sites - slack, min_sites + slack)).select("h")
    exact = pairs.join(near, "h", "left_semi").groupBy("h").agg(F.count_distinct("source").alias("n")).filter(F.col("n") >= min_sites)
    return est.filter(F.col("sites") > min_sites + slack).select("h").unionByName(exact.select("h"))


def strip_boilerplate(docs: DataFrame, broadcast_lines: int = 500_000, **params) -> DataFrame:
    """``docs`` with text cleaned, plus n_lines (non-blank) and n_removed.

    Up to ``broadcast_lines`` boilerplate lines are broadcast (8 bytes each); more are joined, hot ones apart.
    """
    bad = saved(boilerplate(docs, **params), "line-boilerplate")
    key, hit, before, lines_name, removed_name = (free_name(docs, x) for x in ("row_key", "bad_lines", "lines_before", "n_lines", "n_removed"))
    row = F.xxhash64("doc_id", "text")
    hashes = F.array_distinct(F.transform(F.filter(F.transform(_lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != ""), lambda x: F.xxhash64(x)))
    own = docs.filter(F.col("text").isNotNull()).select(row.alias(key), F.explode(hashes).alias("h"))
    few = bad.count() <= broadcast_lines
    met = own.join(F.broadcast(bad), "h") if few else skewed_join(saved(own, "line-own"), bad, ["h"])
    hits = met.groupBy(key).agg(F.collect_set("h").alias(hit))
    out = docs.withColumn(key, row).join(hits, key, "left")
    full = lambda x: F.trim(x) != ""
    keep = F.filter(_lines(F.col("text")), lambda x: F.col(hit).isNull() | ~full(x) | ~F.array_contains(F.col(hit), F.xxhash64(F.trim(x))))
    n = F.coalesce(F.size(F.filter(_lines(F.col("text")), full)), F.lit(0))
    kept = F.when(F.col(hit).isNull(), F.col("text")).otherwise(F.array_join(keep, "\n"))
    out = out.withColumn(before, F.when(F.col("text").isNull(), 0).otherwise(n)).withColumn("text", kept)
    left = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.filter(_lines(F.col("text")), full)))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns], F.col(before).alias(lines_name), (F.col(before) - left).alias(removed_name))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = strip_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("n_lines").cast("int").alias("n_lines"), F.col("n_removed").cast("int").alias("n_removed"), F.coalesce(F.length("text"), F.lit(0)).alias("clean_chars"), F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256).alias("clean_sha256"))


OP9_SQL = r"""
WITH l AS (
  SELECT rowid AS r, doc_id, text, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM (SELECT row_number() OVER () AS rowid, * FROM documents)),
b AS (
  SELECT trim(line, ' ') AS t FROM l WHERE trim(line, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT source) >= 5),
k AS (
  SELECT l.r, l.doc_id, l.line, l.pos, trim(l.line, ' ') <> '' AS full_line, b.t IS NOT NULL AS bad
  FROM l LEFT JOIN b ON trim(l.line, ' ') = b.t),
g AS (
  SELECT r, doc_id, CAST(count_if(full_line) AS INT) AS n_lines, CAST(count_if(bad) AS INT) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT bad), '') AS clean
  FROM k GROUP BY r, doc_id)
SELECT doc_id, n_lines, n_removed, CAST(length(clean) AS INT) AS clean_chars, sha256(clean) AS clean_sha256 FROM g
UNION ALL
SELECT doc_id, 0, 0, 0, sha256('') FROM documents WHERE text IS NULL
"""
