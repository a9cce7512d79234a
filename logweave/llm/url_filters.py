"""URL filter: curated host/path rules first, association rules mined by Spark's FP-growth for the rest.

A labelled URL is a basket of tokens (host labels, path segments, query keys, ...).  FP-growth finds the token combinations
that at least ``min_rows`` bad URLs have, which is the support of the rule "these tokens, so block"; its confidence comes
from counting the combination among the good URLs too.  Rules below ``min_confidence`` are dropped, and so are
rules that hold another one of no less confidence.  A URL is blocked if all tokens of some rule are among its own.
Rules are found through an inverted index: each rule stands under its rarest token only, so a URL meets the few rules
that start with one of its tokens and not every rule.

Support is a number of rows, alike for every size of the label table; at most about ``max_labels`` labelled URLs are mined (those
with the least hash of page_id), so the frequent tokens and combinations do not grow with the corpus.  Tokens of
more than ``max_share`` of the labelled URLs tell nothing and are left out.

Only DataFrame functions and Spark ML (JVM) are used; no Python runs on the executors.

Defined cases: a URL that is null or has no ``://`` has empty host and path, no tokens, fits no rule and
gets the verdict ``allow``; repeated rows are judged alike and all returned; without labelled rows no rule
is mined; rules of equal confidence are told apart by their names; an empty table gives an empty result.  Extra columns
of the pages are ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import saved, skewed_join, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"

#: (verdict, host, path): the policy of the contract.
CURATED = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a URL; empty for an empty host and path."""
    labels = F.filter(F.split(host, r"\."), lambda x: x != "")
    # parts of labels that have several; a plain label is one token
    words = F.flatten(F.transform(F.filter(labels, lambda x: x.rlike("[-_]")), lambda x: F.filter(F.split(x, "[-_]"), lambda y: y != "")))
    segments = F.filter(F.split(F.lower(path), r"[/._-]+"), lambda x: x != "")
    keys = F.filter(F.transform(F.split(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), "&"), lambda x: F.split_part(x, F.lit("="), F.lit(1))), lambda x: x != "")
    every = F.concat(
        F.transform(labels, lambda x: F.concat(F.lit("h:"), x)),
        F.transform(words, lambda x: F.concat(F.lit("w:"), x)),
        F.transform(segments, lambda x: F.when(x.rlike("^[0-9]+$"), F.lit("p:#")).otherwise(F.concat(F.lit("p:"), x))),
        F.transform(keys, lambda x: F.concat(F.lit("q:"), x)),
    )
    return F.when((host == "") & (path == ""), F.array().cast("array<string>")).otherwise(F.array_distinct(every))


def parsed(pages: DataFrame) -> DataFrame:
    p = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    return p.select("page_id", "host", "path", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))


def curated_verdicts(rules: list[tuple[str, str, str]]) -> Column:
    """Struct (size, rule, verdict) of the longest rule that fits, null if none does.

    The policy is a Python list and so of bounded size; it becomes one array expression without a join.
    """
    spec = F.array(*[F.struct(F.lit(len(h + q)).alias("size"), F.lit(h + q).alias("rule"), F.lit(v).alias("verdict"), F.lit(h).alias("h"), F.lit(q).alias("q")) for v, h, q in rules])
    fits = F.filter(spec, lambda r: ((F.col("host") == r["h"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["h"]))) & F.startswith(F.col("path"), r["q"]))
    return F.array_max(fits)


def useful(labelled: DataFrame, min_rows: int, max_share: float) -> DataFrame:
    """``labelled`` with ``tokens`` that ``min_rows`` bad rows have and no more than ``max_share`` of all rows."""
    rows = labelled.filter(F.size("tokens") > 0).select("bad", "tokens")
    n = rows.count()
    per = rows.select("bad", F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("b"))
    kept = per.filter((F.col("b") >= min_rows) & (F.col("n") <= max_share * n)).agg(F.collect_list("token").alias("kept"))
    kept = kept.withColumn("bad", F.explode(F.array(F.lit(True), F.lit(False))))
    # two rows with at most (bad rows x tokens of a URL) / min_rows tokens, a bound that max_labels sets
    return rows.join(F.broadcast(kept), "bad").select("bad", F.array_sort(F.array_intersect("tokens", "kept")).alias("tokens")).filter(F.size("tokens") > 0)


def mine_rules(labelled: DataFrame, min_rows: int, min_confidence: float, max_share: float = 0.5) -> DataFrame:
    """(rule_id, tokens, confidence, support) of rules ``tokens -> block`` from ``labelled(tokens, bad boolean)``.

    Rows with equal tokens and label count as often as they occur.  Of nested rules the shorter one stays
    if it is at least as confident.
    """
    spark = labelled.sparkSession
    baskets = saved(useful(labelled, min_rows, max_share), "url-baskets")
    bad = baskets.filter("bad").select(F.col("tokens").alias("items"))
    n = bad.count()
    if n < min_rows:
        return spark.range(0).selectExpr("cast(id as string) rule_id", "array('') tokens", "0D confidence", "0L support")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the limit lies between two whole numbers of rows, so rounding does not move it
    model = FPGrowth(itemsCol="items", minSupport=(min_rows - 0.5) / n, numPartitions=parts).fit(bad)
    items = model.freqItemsets.select(F.array_sort("items").alias("tokens"), F.col("freq").alias("support"))
    found = saved(items.select(F.concat_ws(" ", "tokens").alias("rule_id"), "tokens", "support"), "url-itemsets")
    good = baskets.filter("not bad").groupBy("tokens").agg(F.count(F.lit(1)).alias("n"))
    against = matches(good.withColumnRenamed("tokens", "basket"), rule_index(found, good)).groupBy("rule_id").agg(F.sum("n").alias("against"))
    confidence = F.col("support") / (F.col("support") + F.coalesce("against", F.lit(0)))
    rules = saved(found.join(against, "rule_id", "left").withColumn("confidence", confidence).filter(F.col("confidence") >= min_confidence), "url-found")
    parts_of = rules.withColumn("m", F.explode(F.sequence(F.lit(0).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), F.size("tokens")) - 2))).filter("m > 0")
    inner = parts_of.select(F.col("rule_id").alias("outer_id"), F.col("confidence").alias("own"), F.concat_ws(" ", F.expr("filter(tokens, (x, i) -> (shiftright(m, i) & 1) = 1)")).alias("rule_id"))
    spare = inner.join(rules.select("rule_id", "confidence"), "rule_id").filter("confidence >= own").select(F.col("outer_id").alias("rule_id"))
    return rules.join(spare, "rule_id", "left_anti").select("rule_id", "tokens", "confidence", "support")


def matches(baskets: DataFrame, index: DataFrame) -> DataFrame:
    """``baskets(basket, ...)``, distinct ones, with every rule whose tokens are all in the basket; no basket is expanded into pairs."""
    met = baskets.withColumn("token", F.explode("basket")).join(index, "token")
    return met.filter(F.size(F.array_except("needed", "basket")) == 0)


def rule_index(rules: DataFrame, pages: DataFrame) -> DataFrame:
    """Rules under the token that is rarest among ``pages(tokens)``: token, needed and the rules' other columns."""
    each = rules.select("rule_id", F.explode("tokens").alias("token"))
    used = each.select("token").distinct()
    freq = pages.select(F.explode("tokens").alias("token")).join(used, "token", "left_semi").groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    rarest = each.join(freq, "token", "left").groupBy("rule_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "token")).alias("x"))
    return rules.join(rarest, "rule_id").withColumn("token", F.col("x.token")).withColumnRenamed("tokens", "needed").drop("x")


def judge(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str, str]] = CURATED, min_rows: int = 20, min_confidence: float = 0.6, max_labels: int = 200_000) -> DataFrame:
    """Every page with host, path, rule, verdict, mined_rule and mined_confidence.

    ``labels(page_id, bad boolean)``: rows with a null ``bad`` or without a page are not used.
    """
    p = saved(parsed(pages).withColumn("tokens", F.array_sort("tokens")).withColumn("c", curated_verdicts(rules)), "url-pages")
    known = labels.filter("bad is not null and page_id is not null").groupBy("page_id").agg(F.max("bad").alias("bad"))
    n = known.count()
    unit = F.pmod(F.xxhash64("page_id", F.lit("url labels")), F.lit(1_000_000)) / 1_000_000.0
    mined = saved(mine_rules(p.join(known.filter(unit < max_labels / max(1, n)), "page_id").select("tokens", "bad"), min_rows, min_confidence), "url-rules")
    index = saved(rule_index(mined, p), "url-index")
    # distinct baskets meet the index once each; pages without tokens meet nothing
    some = p.filter(F.size("tokens") > 0)
    best = matches(some.select(F.col("tokens").alias("basket")).distinct(), index).groupBy("basket").agg(F.max(F.struct("confidence", "rule_id")).alias("m"))
    best = saved(best.withColumnRenamed("basket", "tokens"), "url-matches")
    none = F.lit(None).cast(best.schema["m"].dataType)
    out = skewed_join(some, best, ["tokens"], "left").unionByName(p.filter(F.size("tokens") == 0).withColumn("m", none))
    verdict = F.coalesce("c.verdict", F.when(F.col("m").isNotNull(), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", F.col("c.rule").alias("rule"), verdict.alias("verdict"), F.col("m.rule_id").alias("mined_rule"), F.col("m.confidence").alias("mined_confidence"))


def quality_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of low quality are the bad examples; a page and a document of one id are one item."""
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), (F.col("quality") == 0).alias("bad"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), quality_labels(spark, sf_dir))
