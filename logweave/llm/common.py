"""Helpers that the training-data operators share: scratch tables, code shipping, global row order."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

TABLES_DIR = "scratch"
ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the cluster names it in spark.checkpoint.dir.

    Only a session that runs in one process (master ``local``) may leave it unset; it gets a temporary folder then.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="logweave-")
        spark.conf.set("spark.checkpoint.dir", base)
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder, in the application's own part of it; no two calls return the same one."""
    return f"{shared_dir(spark)}/{TABLES_DIR}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete the scratch tables of this application, once their results have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{TABLES_DIR}/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores behind it, such that ``df`` has no column of that name in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it again: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that tasks can import it wherever they run.

    Where the session has Spark's own 10,000 rows per Arrow batch, it gets 2,000: rows are whole documents, and a batch of
    them stands in memory on both sides of a task.
    """
    sc = spark.sparkContext
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")
    if getattr(sc, "_logweave_shipped", False):
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    # the file stays: executors that join later fetch it from the driver then
    folder = os.path.realpath(tempfile.mkdtemp(prefix="logweave-ship-"))
    target = os.path.join(folder, "logweave_code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for root, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(package)))
    sc.addPyFile(target)
    sc._logweave_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """Add ``position`` (0, 1, 2, ... in ``order``) without a single-task sort.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the
    partitions' row counts (one row per partition) give the offsets.
    """
    local = saved(
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id() % F.lit(1 << 33)),
        name,
    )
    counts = local.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").withColumn("position", F.col("_offset") + F.col("_seq")).drop("_part", "_seq", "_offset")


def skewed_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000, least: int = 1000) -> DataFrame:
    """``left`` joined with ``right``, which has one narrow row per key, on keys that may hold any share of ``left``.

    Rows of keys with at least 1/``share`` of all rows meet their rows of ``right`` (at most ``share`` of them) by
    broadcast and stay where they are; the rest is an ordinary join.  ``left`` is read twice more, so it should be a table.
    """
    total = left.count()
    heavy = left.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= max(least, -(-total // share))).select(*keys)
    hot = saved(heavy, "hot-keys")
    if not hot.take(1):
        return left.join(right, keys, how)
    few = saved(right.join(F.broadcast(hot), keys, "left_semi"), "hot-rows")
    usual = left.join(F.broadcast(hot), keys, "left_anti").join(right, keys, how)
    return usual.unionByName(left.join(F.broadcast(hot), keys, "left_semi").join(F.broadcast(few), keys, how))


def range_bounds(df: DataFrame, order: list[Column], key: str, rows_per_bucket: int, name: str) -> list:
    """Exact, repeatable split points of ``key``: every ``rows_per_bucket``-th value in ``order`` (nulls dropped).

    One value per bucket reaches the driver, so callers choose ``rows_per_bucket`` for buckets of many megabytes.
    """
    rows = ranked(df.filter(F.col(key).isNotNull()), order, name).filter((F.col("position") > 0) & (F.col("position") % rows_per_bucket == 0)).select(key).distinct().collect()
    return sorted(r[0] for r in rows)


def bucket_of(value: Column, bounds: list[int]) -> Column:
    """Number of bounds that are <= value, found in two steps of about sqrt(len(bounds)) comparisons each."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    first = F.array(*[F.lit(g[0]) for g in groups])
    all_groups = F.array(*[F.array(*[F.lit(x) for x in g]) for g in groups])
    g = F.size(F.filter(first, lambda x: x <= value))
    inside = F.size(F.filter(F.element_at(all_groups, g), lambda x: x <= value))
    return F.when(value < F.lit(bounds[0]), F.lit(0)).otherwise((g - 1) * step + inside)


def components(edges: DataFrame, name: str, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges(a long, b long)``: rows (node, root), root the smallest node reachable.

    Alternating large-star and small-star steps, until all components are stars; each is one aggregation and one join, and
    every round is written to the shared folder.  Edges that are stars already need no round.  Hot nodes are pre-aggregated (``min``) before the shuffle, and joined by
    ``skewed_join`` in the first round.
    Nodes without an edge do not appear.  Raises RuntimeError if ``max_rounds`` do not suffice.
    """
    cur = saved(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-cc")
    if not cur.take(1):
        return cur.select(F.col("a").alias("node"), F.col("b").alias("root"))
    for turn in range(max_rounds + 1):
        if _are_stars(cur):
            return cur.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        if turn == max_rounds:
            raise RuntimeError("connected components did not settle")
        both = cur.select("a", "b").unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # stars of any size come with the edges; later rounds hang their leaves on ever fewer nodes, which AQE splits if need be
        up = both.filter("b > a")
        large = (up.join(low, "a") if turn else skewed_join(up, low, ["a"])).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lowest.select("a", F.col("m").alias("b"))).distinct()
        cur = saved(small, f"{name}-cc")


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges(a, b)``, b < a, either has one edge down and none up or none down: then each b is its component's least node."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    each = ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not each.agg(F.max((F.col("down") + F.col("up") > 1) & (F.col("down") > 0))).first()[0]
