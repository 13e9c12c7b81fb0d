"""Retrieval evaluation and its statistics, for all questions and strategies at once."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import tokenize
from loomdex.operators.index import Index, postings
from loomdex.operators.retrieval import BROADCAST_WORDS
from loomdex.shared import cut

METRICS = ["recall", "rr", "precision"]
#: Strategies that are broadcast to the questions at most; every question meets each of them.
BROADCAST_STRATEGIES = 10_000
#: Deltas that are broadcast to the draws of a bootstrap at most; more are joined by shuffle.
BROADCAST_DELTAS = 1_000_000


def resolve_anchors(anchors: DataFrame, docs: DataFrame, index: Index, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(query_id, id): documents that contain all anchors (query_id, anchor) of a question.

    An anchor's inner words stand whole in any text that contains it, so the rarest of
    them names the few documents whose text is searched. Anchors without inner words are
    searched in documents with a word that holds their longest piece.
    """
    anchors = anchors.select("query_id", "anchor").distinct()
    words = tokenize(F.col("anchor"))
    inner = anchors.withColumn("inner", F.when(F.size(words) > 2, F.slice(words, 2, F.size(words) - 2)))
    tokens = inner.select("query_id", "anchor", F.explode("inner").alias("token")).distinct()
    rarest = Window.partitionBy("query_id", "anchor").orderBy("df", "token")
    # a word that no document has (null, first in order) rules its anchor out
    chosen = cut(tokens.join(index.words.select("token", "df"), "token", "left").withColumn("n", F.row_number().over(rarest)).where("n = 1").select("query_id", "anchor", "token"))
    holding = postings(index, chosen, BROADCAST_WORDS).select("token", "id")
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    candidates = chosen.join(holding, "token").select("query_id", "anchor", "id")
    found = candidates.join(texts, "id").where(F.col("text").contains(F.col("anchor"))).select("query_id", "anchor", "id")
    # an anchor without inner words stands in texts of which a word holds its longest piece; one without any letter is searched in all
    pieces = F.transform(words, lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))
    short = cut(inner.where("inner is null").select("query_id", "anchor", F.array_max(pieces)["w"].alias("piece")))
    if short.count():
        fragments = short.where("piece is not null")
        fitting = index.words.select("token").join(F.broadcast(fragments) if fragments.count() <= BROADCAST_WORDS else fragments, F.col("token").contains(F.col("piece")))
        fitting = cut(fitting.select("query_id", "anchor", "token"))
        near = fitting.join(postings(index, fitting, BROADCAST_WORDS).select("token", "id"), "token").select("query_id", "anchor", "id").distinct()
        found = found.union(near.join(texts, "id").where(F.col("text").contains(F.col("anchor"))).select("query_id", "anchor", "id"))
        bare = short.where("piece is null")
        found = found.union(texts.join(bare, F.col("text").contains(F.col("anchor"))).select("query_id", "anchor", "id"))
    needed = anchors.groupBy("query_id").agg(F.count("*").alias("needed"))
    matched = found.distinct().groupBy("query_id", "id").agg(F.count("*").alias("matched"))
    return matched.join(needed, "query_id").where("matched = needed").select("query_id", "id")


def unresolved(anchors: DataFrame, relevant: DataFrame) -> DataFrame:
    return anchors.select("query_id").distinct().join(relevant, "query_id", "left_anti")


def score_questions(retrieved: DataFrame, relevant: DataFrame, ks: list[int], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, k, query_id, recall, rr, precision) of ranked rows (keys, query_id, id, rank) for answerable questions.

    recall is 1 if any hit is relevant, rr the inverse place of the first, precision the
    share of the hits returned; questions without hits score 0. All ks in one pass.
    """
    keys = list(keys)
    named = retrieved.select(*keys).distinct()
    if keys:
        named = F.broadcast(named) if named.count() <= BROADCAST_STRATEGIES else named
    hits = retrieved.join(relevant.select("query_id", "id", F.lit(1).alias("hit")), ["query_id", "id"], "left")
    hits = hits.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks]))).where(F.col("rank") < F.col("k"))
    place = F.min(F.when(F.col("hit") == 1, F.col("rank")))
    scored = hits.groupBy(*keys, "k", "query_id").agg(place.alias("place"), F.count("hit").alias("hits"), F.count("*").alias("returned"))
    # every question meets every strategy: that many rows are asked for
    asked = relevant.select("query_id").distinct().crossJoin(named) if keys else relevant.select("query_id").distinct()
    asked = asked.withColumn("k", F.explode(F.array(*[F.lit(k) for k in ks])))
    rows = asked.join(scored, [*keys, "k", "query_id"], "left")
    return rows.select(
        *keys, "k", "query_id", F.when(F.col("place").isNotNull(), 1.0).otherwise(0.0).alias("recall"), F.coalesce(1.0 / (F.col("place") + 1), F.lit(0.0)).alias("rr"), F.coalesce(F.col("hits") / F.least("returned", "k"), F.lit(0.0)).alias("precision")
    )


def report(outcomes: DataFrame, probes: DataFrame) -> DataFrame:
    """(probe, questions, recall, rr, precision, failures): a row for each probe and one, of probe "all", over everything."""
    rows = outcomes.join(probes, "query_id")
    means = [F.avg(m).alias(m) for m in METRICS]
    grouped = rows.rollup("probe").agg(F.grouping("probe").alias("all"), F.count("*").alias("questions"), *means, F.count_if(F.col("recall") == 0).alias("failures"))
    return grouped.withColumn("probe", F.when(F.col("all") == 1, "all").otherwise(F.col("probe"))).drop("all")


def compare_paired(a: DataFrame, b: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(metric, n, mean_a, mean_b, delta, wins, losses, ties) of outcomes joined by question."""
    long = lambda rows, name: rows.select("query_id", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value")) for m in METRICS])).alias("m")).select("query_id", "m.metric", F.col("m.value").alias(name))
    both = long(a, "a").join(long(b, "b"), ["query_id", "metric"]).withColumn("d", F.col("a") - F.col("b"))
    wins, losses = F.count_if(F.col("d") > epsilon), F.count_if(F.col("d") < -epsilon)
    return both.groupBy("metric").agg(F.count("*").alias("n"), F.avg("a").alias("mean_a"), F.avg("b").alias("mean_b"), F.avg("d").alias("delta"), wins.alias("wins"), losses.alias("losses"), F.count_if(F.abs("d") <= epsilon).alias("ties"))


def _stirling_error(k: Column) -> Column:
    """log k! less Stirling's formula, for whole k from 0 on: exact up to 15, then by its series."""
    exact = [0.0] + [math.lgamma(i + 1) - (i + 0.5) * math.log(i) + i - 0.5 * math.log(2 * math.pi) for i in range(1, 16)]
    x = F.greatest(k, F.lit(16.0))
    y = 1 / (x * x)
    series = (1 / 12 - (1 / 360 - (1 / 1260 - (1 / 1680 - y / 1188) * y) * y) * y) / x
    return F.when(k < 16, F.get(F.array(*map(F.lit, exact)), F.least(k, F.lit(15.0)).cast("int"))).otherwise(series)


def sign_test(wins: Column, losses: Column) -> Column:
    """Two-sided exact p: twice the binomial tail, at most 1; 1 without decided pairs.

    The tail is its largest term, taken as a logarithm, times the sum of all terms
    relative to it. They fall by at least exp(-2 j^2 / n) with their distance j, so from
    12 sqrt(n) on they add less than 1e-100 and are left out; no count is too large.
    """
    n, m = (wins + losses).cast("double"), F.least(wins, losses).cast("double")
    other, lean = n - m, (n - 2 * m) / n
    # the logarithm of C(n, m) / 2^n, without the large numbers that cancel in it
    spread = n / 2 * ((1 - lean) * F.log1p(-lean) + (1 + lean) * F.log1p(lean))
    log_term = _stirling_error(n) - _stirling_error(m) - _stirling_error(other) - spread + 0.5 * F.log(n / (2 * math.pi * m * other))
    steps = F.least(m, F.ceil(12 * F.sqrt(n)) + 60).cast("long")
    start = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum"))

    def step(state: Column, j: Column) -> Column:
        term = state["term"] * (m - j + 1) / (other + j)
        return F.struct(term.alias("term"), (state["sum"] + term).alias("sum"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), F.greatest(steps, F.lit(1).cast("long"))), start, step)["sum"]
    # one of each at least, or all on one side
    p = F.when(m > 0, 2 * F.exp(log_term) * tail).otherwise(2 * F.exp(-n * math.log(2)))
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), p))


def _numbered(rows: DataFrame, order: str) -> DataFrame:
    """Rows with `i`, their place in order from 0: ranges of the order are numbered apart and moved up by what stands before them."""
    ranges = cut(rows.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n"))
    # a row a shuffle partition
    before = sizes.select(F.col("range").alias("r"), (F.sum("n").over(Window.orderBy("range")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), F.col("range") == F.col("r")).withColumn("i", (F.col("place") + F.col("before")).cast("long")).drop("range", "r", "before", "place")


def bootstrap_ci(deltas: DataFrame, reps: int = 10_000) -> DataFrame:
    """(low, high): percentile interval of the mean of resampled deltas (query_id, delta); draws are md5 of `rep:i`, so reruns agree."""
    spark = deltas.sparkSession
    numbered = cut(_numbered(deltas.select("query_id", "delta"), "query_id").select("i", "delta"))
    n = numbered.count()
    draws = spark.range(reps).withColumnRenamed("id", "rep").select("rep", F.explode(F.sequence(F.lit(0), F.lit(max(n, 1) - 1))).alias("draw"))
    index = F.conv(F.substring(F.md5(F.concat_ws(":", "rep", "draw")), 1, 8), 16, 10).cast("long") % max(n, 1)
    numbered = F.broadcast(numbered) if n <= BROADCAST_DELTAS else numbered
    means = draws.withColumn("i", index).join(numbered, "i").groupBy("rep").agg(F.round(F.avg("delta"), 9).alias("mean"))
    # one value a repetition
    ordered = means.agg(F.sort_array(F.collect_list("mean")).alias("means"))
    low, high = int(reps * 0.025), min(int(reps * 0.975), reps - 1)
    return ordered.select(F.get("means", F.lit(low)).alias("low"), F.get("means", F.lit(high)).alias("high"))


def wilson(successes: Column, total: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of a rate, clamped to [0, 1]; (0, 1) without observations."""
    n, z2 = total.cast("double"), z * z
    p = successes / n
    scale = 1 + z2 / n
    centre = (p + z2 / (2 * n)) / scale
    half = z / scale * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    return F.when(total == 0, 0.0).otherwise(clamp(centre - half)), F.when(total == 0, 1.0).otherwise(clamp(centre + half))
