"""Listings, summaries and reports over tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import snippet
from loomdex.shared import cut

#: Groups whose percentiles are broadcast to their values at most.
BROADCAST_GROUPS = 100_000


def session_summaries(sessions: DataFrame, messages: DataFrame, session: str, turn: str, text: str, size: int = 80) -> DataFrame:
    """Every session with its number of messages (0 if none) and a snippet of the last."""
    last = messages.groupBy(session).agg(F.count("*").alias("messages"), F.max_by(text, turn).alias("last"))
    rows = sessions.join(last, session, "left")
    return rows.select(*sessions.columns, F.coalesce("messages", F.lit(0)).cast("long").alias("messages"), snippet(F.col("last"), size).alias("last"))


def recent(rows: DataFrame, group: str, order: str, n: int) -> DataFrame:
    """The last `n` rows of each group."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(order)))
    return rows.withColumn("__place", place).where(F.col("__place") <= n).drop("__place")


def with_totals(rows: DataFrame, key: str, sums: list[str], means: list[str], label: str = "Total") -> DataFrame:
    """A row for each key and one over everything: sums of some columns, means of others."""
    grouped = rows.rollup(key).agg(F.grouping(key).alias("__all"), *[F.sum(c).alias(c) for c in sums], *[F.avg(c).alias(c) for c in means])
    return grouped.withColumn(key, F.when(F.col("__all") == 1, label).otherwise(F.col(key))).drop("__all")


def nearest_rank(rows: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """Mean and exact percentiles at sorted place round((n - 1) p) of each group.

    Equal values are counted before they meet. Groups and values are sorted in ranges,
    counted apart and moved up by what the group has in the ranges before, so a group
    of any number of different values is no single task.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count("*").alias("c"))
    ranges = cut(counts.repartitionByRange(group, value).withColumn("range", F.spark_partition_id()))
    # a row for each group of a shuffle partition
    parts = ranges.groupBy(group, "range").agg(F.sum("c").alias("own"))
    order = Window.partitionBy(group).orderBy("range")
    parts = parts.select(F.col(group).alias("__group"), F.col("range").alias("__range"), (F.sum("own").over(order) - F.col("own")).alias("before"), F.sum("own").over(Window.partitionBy(group)).alias("n"))
    within = F.sum("c").over(Window.partitionBy(group, "range").orderBy(value))
    counts = ranges.withColumn("within", within).join(parts, F.col(group).eqNullSafe(F.col("__group")) & (F.col("range") == F.col("__range")))
    upto = F.col("within") + F.col("before")
    picks = [F.min(F.when(upto > F.round((F.col("n") - 1) * p), F.col(value))).alias(name) for name, p in shares.items()]
    return counts.groupBy(group).agg(F.max("n").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.max("n")).alias("mean"), *picks)


def value_sketches(rows: DataFrame, keys: list[str], value: str, size: int = 400) -> DataFrame:
    """(keys, n, sketch) with a KLL sketch of each group's values, of bounded size; groups of coarser keys are merged from it. Null values are left out."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size)).alias("sketch"))


def sketched_percentiles(sketches: DataFrame, group: str, shares: dict[str, float]) -> DataFrame:
    """(group, n, sketches, percentiles) from sketches of finer groups: about nearest_rank(), without reading the values again."""
    merged = sketches.groupBy(group).agg(F.sum("n").alias("n"), F.count("*").alias("sketches"), F.kll_merge_agg_double("sketch").alias("sketch"))
    return merged.select(group, "n", "sketches", *[F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in shares.items()])


def rank_errors(rows: DataFrame, group: str, value: str, found: DataFrame, shares: dict[str, float]) -> DataFrame:
    """(group, errors by name): how far from its share of the group's values each found percentile lies, 0 if the share is among the ranks of its equals."""
    f = found.select(F.col(group).alias("__group"), *shares)
    # one row a group
    counted = rows.where(F.col(value).isNotNull()).join(F.broadcast(f) if f.count() <= BROADCAST_GROUPS else f, F.col(group).eqNullSafe(F.col("__group")))
    below = [F.avg((F.col(value) < F.col(name)).cast("double")).alias(f"__below_{name}") for name in shares]
    upto = [F.avg((F.col(value) <= F.col(name)).cast("double")).alias(f"__upto_{name}") for name in shares]
    ranks = counted.groupBy(group).agg(*below, *upto)
    return ranks.select(group, *[F.greatest(F.lit(0.0), F.col(f"__below_{n}") - p, p - F.col(f"__upto_{n}")).alias(n) for n, p in shares.items()])


def budget_report(spent: DataFrame, budgets: DataFrame, phase: str, gate: float) -> DataFrame:
    """Phases with what they spent against their budget, and a row "total" against the gate."""
    total = spent.groupBy(phase).agg(F.sum("spent").alias("spent"))
    rows = total.join(budgets, phase, "left").select(phase, "spent", F.col("budget").cast("double").alias("budget"))
    everything = rows.agg(F.lit("total").alias(phase), F.sum("spent").alias("spent"), F.lit(float(gate)).alias("budget"))
    verdict = F.when(F.col("budget").isNull(), "NO BUDGET").when(F.col("spent") > F.col("budget"), "FAIL").otherwise("PASS")
    return rows.union(everything).withColumn("verdict", verdict)


def distinct_first(rows: DataFrame, keys: list, order: str) -> DataFrame:
    """The first row of each key."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__place", place).where("__place = 1").drop("__place")
