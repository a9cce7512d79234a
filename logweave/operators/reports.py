"""Benchmark and evidence analytics: quantiles, pooled ratios, deltas, windows, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percentiles(samples: DataFrame, by: list[str], value: str, percents: list[int]) -> DataFrame:
    """Exact, linearly interpolated; null for no samples."""
    return samples.groupBy(*by).agg(*[F.percentile(value, p / 100).alias(f"p{p}") for p in percents])


def reservoir(samples: DataFrame, key: str, size: int, seed: int = 0) -> DataFrame:
    """A uniform sample of ``size`` rows that reruns repeat, those with the least hash of the key, and ``seen``, how many rows there were."""
    seen = samples.count()
    unit = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")).cast("binary"))
    return samples.orderBy(unit, key).limit(size).withColumn("seen", F.lit(seen).cast("long"))


def pooled(runs: DataFrame, mode: str = "mode") -> DataFrame:
    """Rates of all runs of a mode together: sums over sums, never means of rates."""
    rate = F.sum("success") / F.sum("elapsed_seconds")
    cpu = F.sum("cpu_seconds") * 1e6 / F.sum("success")
    return runs.groupBy(mode).agg(F.sum("success").alias("success"), rate.alias("goodput"), cpu.alias("cpu_us_per_op"))


def change_pct(before: Column, after: Column) -> Column:
    return F.when(before != 0, 100 * (after / before - 1))


def counter_deltas(samples: DataFrame, by: list[str], order: str, counters: list[str], strict: bool = False) -> DataFrame:
    """Differences of running counters to the sample before; null for the first sample.

    Where a counter went back its difference is null, or the query fails if ``strict``.
    """
    w = Window.partitionBy(*by).orderBy(order)
    out = samples
    for c in counters:
        d = F.col(c) - F.lag(c).over(w)
        back = F.raise_error(F.lit(f"counter moved backwards: {c}")).cast("long") if strict else F.lit(None)
        out = out.withColumn(f"d_{c}", F.when(d < 0, back).otherwise(d))
    return out


def stage_summary(before: DataFrame, after: DataFrame, stages: list[str]) -> DataFrame:
    """(node_id, stage, count, mean_us, mean_entries) between two snapshots with the columns node_id, term, state and
    <stage>_count, <stage>_total_us, and <stage>_entries where a stage has entries.

    Means are of the differences, null without samples.  The query fails if a node's term or role changed or a counter went back.
    """
    a, b = before.alias("a"), after.alias("b")
    both = a.join(b, F.col("a.node_id") == F.col("b.node_id"))
    same = F.col("a.term").eqNullSafe(F.col("b.term")) & F.col("a.state").eqNullSafe(F.col("b.state"))

    def moved(name: str) -> Column:
        d = F.col(f"b.{name}") - F.col(f"a.{name}")
        return F.when(~same, F.raise_error(F.lit("term or role changed; stages are not comparable")).cast("long")).when(d < 0, F.raise_error(F.lit(f"counter moved backwards: {name}")).cast("long")).otherwise(d)

    rows = []
    for s in stages:
        entries = moved(f"{s}_entries") if f"{s}_entries" in before.columns else F.lit(None).cast("long")
        rows.append(F.struct(F.lit(s).alias("stage"), moved(f"{s}_count").alias("count"), moved(f"{s}_total_us").alias("total"), entries.alias("entries")))
    each = both.select(F.col("a.node_id").alias("node_id"), F.explode(F.array(*rows)).alias("x")).select("node_id", "x.*")
    mean = lambda c: F.try_divide(F.col(c).cast("double"), F.col("count"))
    return each.select("node_id", "stage", "count", mean("total").alias("mean_us"), mean("entries").alias("mean_entries"))


def cpu_shares(deltas: DataFrame, by: str, field: str, delta: str) -> DataFrame:
    """Share of every field in its group's sum; null for the whole group if a difference is negative or all are zero."""
    w = Window.partitionBy(by)
    share = F.try_divide(100.0 * F.col(delta), F.sum(delta).over(w))
    return deltas.withColumn("share_pct", F.when(F.min(delta).over(w) >= 0, share)).select(by, field, delta, "share_pct")


def process_shares(start: DataFrame, end: DataFrame) -> DataFrame:
    """(process, cpu_seconds, percent_of_one_core) between two samples (process, at, cpu_seconds); fails if a counter or the clock went back."""
    both = start.alias("a").join(end.alias("b"), F.col("a.process") == F.col("b.process"), "full")
    seconds, elapsed = F.col("b.cpu_seconds") - F.col("a.cpu_seconds"), F.col("b.at") - F.col("a.at")
    wrong = F.coalesce((seconds < 0) | (elapsed <= 0), F.lit(True))  # also a process that one side lacks
    checked = F.when(wrong, F.raise_error(F.lit("not comparable CPU samples")).cast("double")).otherwise(seconds)
    return both.select(F.col("a.process").alias("process"), checked.alias("cpu_seconds"), (100 * checked / elapsed).alias("percent_of_one_core"))


def head_tail_growth(samples: DataFrame, by: str, order: str, value: str, n: int = 10, least: int = 30) -> DataFrame:
    """Median of the last n less that of the first n, and the peak; groups of fewer than ``least`` samples give null growth.

    Blocks of ``order`` are cut to their own first and last n first, so no task sorts a whole group.
    """
    row = samples.select(by, F.struct(F.col(order).alias("o"), F.col(value).alias("v")).alias("x"), F.pmod(F.xxhash64(order), F.lit(64)).alias("_part"))
    up, down = Window.partitionBy(by, "_part").orderBy(F.col("x.o")), Window.partitionBy(by, "_part").orderBy(F.col("x.o").desc())
    near = row.withColumn("a", F.row_number().over(up)).withColumn("z", F.row_number().over(down)).filter((F.col("a") <= n) | (F.col("z") <= n))
    ends = near.groupBy(by).agg(F.array_sort(F.collect_list("x")).alias("xs"))  # 64 x 2n rows at most
    value_of = lambda xs: F.transform(xs, lambda x: x["v"])
    median = lambda xs: F.when(F.size(xs) % 2 == 1, F.get(xs, F.floor(F.size(xs) / 2).cast("int"))).otherwise((F.get(xs, (F.size(xs) / 2 - 1).cast("int")) + F.get(xs, (F.size(xs) / 2).cast("int"))) / 2)
    first = F.array_sort(value_of(F.slice("xs", 1, n)))
    final = F.array_sort(value_of(F.slice("xs", F.greatest(F.lit(1), F.size("xs") - n + 1), n)))
    medians = ends.select(by, median(first).alias("head"), median(final).alias("tail"))
    totals = samples.groupBy(by).agg(F.count(F.lit(1)).alias("samples"), F.max(value).alias("peak"))
    out = totals.join(medians, by).withColumn("growth", F.when(F.col("samples") >= least, F.col("tail") - F.col("head")))
    return out.select(by, "samples", "head", "tail", "peak", "growth")


def in_windows(samples: DataFrame, windows: DataFrame, at: str, width: int = 1000) -> DataFrame:
    """Samples with the measurement window [start, stop) they lie in: an equality join on buckets of ``width``, whatever the number of windows."""
    dealt = windows.filter("stop > start").withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor((F.col("stop") - 1) / width))))
    return samples.withColumn("_bucket", F.floor(F.col(at) / width)).join(dealt, "_bucket").filter((F.col(at) >= F.col("start")) & (F.col(at) < F.col("stop"))).drop("_bucket")


def info_summary(samples: DataFrame) -> DataFrame:
    """Per run of ``samples(run, at, node, state, leader_id, term, lag)``: samples, largest lag of the leader, disagreements, term changes.

    Samples whose nodes name several leaders or terms, or of which not exactly one is leader, disagree; only the others
    count for lag and terms.
    """
    seen = lambda c: F.countDistinct(F.coalesce(F.col(c).cast("string"), F.lit("")))
    leader = F.col("state") == "leader"
    each = samples.groupBy("run", "at").agg(F.count_if(leader).alias("leaders"), seen("leader_id").alias("ids"), seen("term").alias("terms"), F.max(F.when(leader, F.col("term"))).alias("term"), F.max(F.when(leader, F.col("lag"))).alias("lag"))
    agrees = (F.col("leaders") == 1) & (F.col("ids") == 1) & (F.col("terms") == 1)
    w = Window.partitionBy("run").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    known = each.withColumn("agrees", agrees).withColumn("agreed", F.when(agrees, F.col("term"))).withColumn("before", F.last("agreed", ignorenulls=True).over(w))
    changes = F.count_if(F.col("agreed") != F.col("before"))
    return known.groupBy("run").agg(F.count(F.lit(1)).alias("samples"), F.max(F.when(F.col("agrees"), F.col("lag"))).alias("max_lag"), F.count_if(~F.col("agrees")).alias("disagreements"), changes.alias("term_increases"))


def refusals(counts: DataFrame, limit: int) -> DataFrame:
    """Total of refused connections and whether it keeps the limit; raises on a negative count."""
    checked = counts.select(F.when(F.assert_true(F.col("refused") >= 0).isNull(), F.col("refused")).alias("r"))
    return checked.agg(F.sum("r").alias("refused")).withColumn("within", F.col("refused") <= limit)


def longest_mount(paths: DataFrame, mounts: DataFrame) -> DataFrame:
    """Each path with the deepest mount point that holds it: an equality join on the path's own prefixes."""
    pieces = F.filter(F.split("path", "/"), lambda x: x != "")
    prefixes = F.transform(F.sequence(F.lit(0), F.size(pieces)), lambda i: F.concat(F.lit("/"), F.array_join(F.slice(pieces, 1, i), "/")))
    asked = paths.withColumn("mount", F.explode(prefixes))
    return asked.join(mounts, "mount").groupBy("path").agg(F.max_by(F.struct("mount", "fs"), F.length("mount")).alias("x")).select("path", "x.mount", "x.fs")


def crossing_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """Edges whose ends lie in different partition groups."""
    a, b = groups.select(F.col("node").alias("src"), F.col("g").alias("ga")), groups.select(F.col("node").alias("dst"), F.col("g").alias("gb"))
    return edges.join(a, "src").join(b, "dst").withColumn("crossing", F.col("ga") != F.col("gb")).drop("ga", "gb")


def alternating_plan(pipelines: DataFrame, repeats: int) -> DataFrame:
    """Cells in alternating order: sync first in even repeats, async first in odd ones.  ``repeats`` x 2 rows per pipeline."""
    r = pipelines.withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("slot", F.explode(F.array(F.lit(0), F.lit(1))))
    return r.withColumn("async_apply", F.when(F.col("repeat") % 2 == 0, F.col("slot") == 1).otherwise(F.col("slot") == 0))


def vmstat_summary(lines: DataFrame) -> DataFrame:
    """Mean idle, samples below 10 % idle, samples with swapping, of text lines of 17 whole numbers."""
    cols = F.split(F.trim("value"), r"\s+")
    rows = lines.filter(F.trim("value").rlike(r"\A([0-9]+\s+){16}[0-9]+\z")).select(cols[14].cast("int").alias("idle"), (cols[6].cast("long") + cols[7].cast("long")).alias("swap"))
    return rows.agg(F.count(F.lit(1)).alias("samples"), F.round(F.avg("idle"), 2).alias("mean_idle"), F.count_if(F.col("idle") < 10).alias("busy"), F.count_if(F.col("swap") > 0).alias("swapping"))


def process_status(text: Column) -> Column:
    """Struct rss_bytes, threads of a /proc status text."""
    return F.struct((F.regexp_extract(text, r"VmRSS:\s+([0-9]+) kB", 1).try_cast("long") * 1024).alias("rss_bytes"), F.regexp_extract(text, r"Threads:\s+([0-9]+)", 1).try_cast("int").alias("threads"))
