"""Mixing sources to target weights by hash thresholds.

Every document has a 60-bit hash.  For a source and a word budget the mix takes the documents whose
hash lies below a threshold.  The threshold is found from histograms: words are summed by source and
hash bucket, the bucket in which the running sum passes the budget is refined, and so on until it holds one
hash; documents are never sorted.  Thresholds of one source are nested, so a smaller budget takes a
subset of what a larger one takes.

Defined cases: a null text has size 0; a null source is a source of its own and comes last; an empty
table gives an empty result; rows with equal doc_id and text share a hash and are taken together; a
null doc_id is hashed as an empty string.  Extra columns, whatever their names, are ignored by ``plan_mix`` and kept by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import free_name, ranked, saved, skewed_join, table

WORDS = r"[^\x20\x09-\x0D]+"
HASH_BITS = 60
LEVEL_BITS = 12


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column) -> Column:
    """60 bits of an MD5 over id and text, the same in every run and on every engine."""
    key = F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share_pct: int, max_epochs: int) -> DataFrame:
    """(source, source_size, weight, target): ``share_pct`` percent of all words dealt by weight, at most ``max_epochs`` times a source.

    ``sizes`` has one row per source.  What a full source cannot take is dealt again by weight among the
    others; each pass is one aggregate of two sums, and only those sums reach the driver.
    """
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    src = saved(ranked(sizes, [F.col("source").asc_nulls_last()], "mix-sources").select("source", "source_size", w.cast("long").alias("weight")), "mix-weights")
    total = src.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    cap = F.col("source_size") * max_epochs
    full_words, open_weight = 0, None
    while True:
        if open_weight is None:
            full = F.lit(False)
        else:
            # cap <= weight * (total * share - full_words) / open_weight, in whole numbers
            full = cap.cast("decimal(38,0)") * F.lit(100 * open_weight).cast("decimal(20,0)") <= F.col("weight").cast("decimal(10,0)") * F.lit(total * share_pct - 100 * full_words).cast("decimal(25,0)")
        got = src.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("f"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("w")).first()
        if open_weight is not None and (got["f"], got["w"]) == (full_words, open_weight):
            break
        full_words, open_weight = got["f"], got["w"]
        if open_weight == 0:
            full = F.lit(True)
            break
    dealt = (F.col("weight") * F.lit(total * share_pct - 100 * full_words).cast("double")) / F.lit(float(100 * max(1, open_weight)))
    return src.withColumn("target", F.when(full, cap.cast("double")).otherwise(dealt))


def thresholds(sized: DataFrame, budgets: DataFrame) -> DataFrame:
    """(source, epoch, cut): the mix takes a document in ``epoch`` if its hash is below ``cut``.

    ``sized(source, size, h)``, ``budgets(source, epoch, budget double)``.  Documents at the last hash are
    taken if that brings the sum nearer to the budget.
    """
    # state: what is below prefix is taken (cum words), the boundary lies in the bucket with this prefix
    state = budgets.withColumn("cum", F.lit(0).cast("long")).withColumn("prefix", F.lit(0).cast("long"))
    for level in range(1, HASH_BITS // LEVEL_BITS + 1):
        shift = HASH_BITS - LEVEL_BITS * level
        bucket = F.shiftright("h", shift)
        sums = (F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        if level == 1:
            inside = sized.groupBy("source", bucket.alias("b")).agg(*sums)
            near = state.alias("s").join(inside.alias("i"), F.col("s.source").eqNullSafe(F.col("i.source"))).select("s.*", "i.b", "i.words", "i.lo", "i.hi")
        else:
            rows = sized.alias("d").join(state.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source")) & (F.shiftright("d.h", shift + LEVEL_BITS) == F.col("s.prefix")))
            near = rows.select("s.source", "s.epoch", "s.budget", "s.cum", bucket.alias("b"), "d.size", "d.h").groupBy("source", "epoch", "budget", "cum", "b").agg(*sums)
        order = Window.partitionBy("source", "epoch").orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
        run = near.withColumn("upto", F.col("cum") + F.sum("words").over(order)).withColumn("below", F.col("upto") - F.col("words"))
        # the boundary bucket: the first whose running sum passes the budget; none if the whole source fits
        hit = run.filter(F.col("upto") > F.col("budget")).groupBy("source", "epoch").agg(F.min(F.struct("b", "below", "words", "budget", "lo", "hi")).alias("x"))
        state = saved(hit.select("source", "epoch", F.col("x.budget").alias("budget"), F.col("x.below").alias("cum"), F.col("x.b").alias("prefix"), F.col("x.words").alias("words"), "x.lo", "x.hi"), "mix-level")
        if not state.filter("lo <> hi").take(1):  # every boundary bucket holds one hash
            break
    take = F.col("budget") - F.col("cum") >= F.col("cum") + F.col("words") - F.col("budget")
    done = state.select("source", "epoch", F.when(take, F.col("lo") + 1).otherwise(F.col("lo")).alias("cut"))
    rest = budgets.select("source", "epoch")
    cuts = rest.alias("r").join(done.alias("c"), F.col("r.source").eqNullSafe(F.col("c.source")) & (F.col("r.epoch") == F.col("c.epoch")), "left")
    return cuts.select("r.source", "r.epoch", F.coalesce("c.cut", F.lit(1 << HASH_BITS)).alias("cut"))


def plan_mix(docs: DataFrame, weights: list[int] = [5, 2, 1], share_pct: int = 150, max_epochs: int = 2) -> tuple[DataFrame, DataFrame]:
    """(sized documents, sources with target and one cut per epoch as array ``cuts``)."""
    sized = saved(docs.select("doc_id", "source", n_words(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text")).alias("h")), "mix-sized")
    targets = saved(source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share_pct, max_epochs), "mix-targets")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))
    budgets = targets.select("source", "source_size", "target", epoch.alias("epoch")).select("source", "epoch", F.greatest(F.lit(0.0), F.least(F.col("source_size").cast("double"), F.col("target") - F.col("epoch") * F.col("source_size"))).alias("budget"))
    cuts = thresholds(sized, saved(budgets, "mix-budgets")).groupBy("source").agg(F.sort_array(F.collect_list("cut"), asc=False).alias("cuts"))
    plan = targets.alias("t").join(cuts.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select("t.*", "c.cuts")
    return sized, saved(plan, "mix-plan")


def copies(h: Column, cuts: Column) -> Column:
    return F.size(F.filter(cuts, lambda c: h < c))


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def _with_plan(rows: DataFrame, plan: DataFrame, key: str) -> DataFrame:
    """``rows`` (with source) with its source's row of the plan; sources may be many, and one may have any share of the rows."""
    rows, plan = rows.withColumn(key, _source_key(F.col("source"))), plan.withColumn(key, _source_key(F.col("source"))).drop("source")
    if plan.count() <= 100_000:  # some 10 MB
        return rows.join(F.broadcast(plan), key)
    return skewed_join(rows, plan, [key])


def mix(docs: DataFrame, **params) -> DataFrame:
    """The mixed documents with the columns of ``docs``: each row as often as the mix takes it."""
    _, plan = plan_mix(docs, **params)
    key, cuts, times = (free_name(docs, x) for x in ("source_key", "source_cuts", "times_taken"))
    out = _with_plan(docs, plan.select("source", F.col("cuts").alias(cuts)), key)
    n = copies(doc_hash(F.col("doc_id"), F.col("text")), F.col(cuts))
    out = out.withColumn(times, n).filter(F.col(times) > 0)
    return out.withColumn(times, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*[F.col(f"`{c}`") for c in docs.columns])


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, plan = plan_mix(table(spark, sf_dir, "documents"))
    joined = _with_plan(sized, plan, "source_key")
    n = copies(F.col("h"), F.col("cuts"))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * n).cast("long").alias("taken"), n.alias("epochs"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before_cap,
         sum(w) OVER (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w
  FROM s),
f AS (
  SELECT *, (2 * source_size * 100 * open_w <= w * (150 * total - 100 * before_cap)) AS is_full FROM o),
z AS (
  SELECT coalesce(sum(CASE WHEN is_full THEN 2 * source_size END), 0) AS full_words, coalesce(sum(CASE WHEN NOT is_full THEN w END), 0) AS open_weight FROM f),
t AS (
  SELECT source, source_size,
         CASE WHEN is_full THEN CAST(2 * source_size AS DOUBLE)
              ELSE (w * CAST(150 * total - 100 * full_words AS DOUBLE)) / CAST(100 * open_weight AS DOUBLE) END AS target
  FROM f, z),
b AS (
  SELECT source, source_size, target, e,
         greatest(0.0, least(CAST(source_size AS DOUBLE), target - e * source_size)) AS budget FROM t, (VALUES (0), (1)) x(e)),
g AS (
  SELECT source, h, sum(size) AS words, sum(sum(size)) OVER (PARTITION BY source ORDER BY h) AS upto FROM d GROUP BY source, h),
c AS (
  SELECT b.source, b.e, coalesce(min(CASE WHEN g.upto > b.budget THEN CASE WHEN b.budget - (g.upto - g.words) >= g.upto - b.budget THEN g.h + 1 ELSE g.h END END), 1152921504606846976) AS cut
  FROM b JOIN g ON b.source IS NOT DISTINCT FROM g.source GROUP BY b.source, b.e),
k AS (
  SELECT t.source, t.source_size, t.target, max(CASE WHEN c.e = 0 THEN c.cut END) AS c0, max(CASE WHEN c.e = 1 THEN c.cut END) AS c1
  FROM t JOIN c ON t.source IS NOT DISTINCT FROM c.source GROUP BY t.source, t.source_size, t.target)
SELECT d.doc_id, d.size, k.source_size, k.target,
       CAST(d.size * (CAST(d.h < k.c0 AS INT) + CAST(d.h < k.c1 AS INT)) AS BIGINT) AS taken,
       CAST(CAST(d.h < k.c0 AS INT) + CAST(d.h < k.c1 AS INT) AS INT) AS epochs
FROM d JOIN k ON d.source IS NOT DISTINCT FROM k.source
"""
