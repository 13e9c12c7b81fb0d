"""Mixing sources to target weights along a time-varying curriculum. DataFrame functions only.

Each source has a weight schedule over training time 0..1, linear from
w(1 - slope) to w(1 + slope), whose integral is its weight w. Integrals share out
the corpus' words; a source that would need more than `MAX_EPOCHS` passes is held
there and the excess goes to the others by weight, round after round. Inside a
source, documents stand in hash order; a document's cumulative words over its
source's target, in each pass, are the share of demand before it, and the inverse
of the integrated schedule turns that share into a training position.

Cumulative sums never gather a source: hash order is bucket order, buckets hold
about `BUCKET_ROWS` rows whatever the source's size, and only bucket totals are
summed per source. Nor are sources gathered: their order is found in ranges, and
what the full ones leave is a sum in each round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.shared import cut

WEIGHTS = (5.0, 2.0, 1.0)
SLOPES = (0.5, 0.0, -0.5)
MAX_EPOCHS = 3
BUCKET_ROWS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _places(sources: DataFrame) -> DataFrame:
    """Sources with `place`, their number by code point from 0, null last: ranges are numbered apart and moved up by what stands before them."""
    order = F.col("source").asc_nulls_last()
    ranges = cut(sources.repartitionByRange(order).withColumn("range", F.spark_partition_id()))
    # a row a shuffle partition
    sizes = ranges.groupBy("range").agg(F.count("*").alias("n")).select(F.col("range").alias("r"), "n")
    before = sizes.select("r", (F.sum("n").over(Window.orderBy("r")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1
    return ranges.withColumn("place", place).join(F.broadcast(before), F.col("range") == F.col("r")).withColumn("place", F.col("place") + F.col("before")).drop("range", "r", "before")


def targets(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, rows, target, slope) of rows (source, size): one row a source."""
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    pick = lambda values: F.element_at(F.array(*[F.lit(float(v)) for v in values]), (F.col("place") % len(values) + 1).cast("int"))
    cap = F.lit(float(max_epochs)) * F.col("source_size")
    sources = cut(_places(sources).withColumns({"weight": pick(weights), "slope": pick(slopes), "cap": cap}))
    # words a unit of weight gets: what the sources that are full at the last level leave, shared by the others; the level only rises
    level, total = 0.0, sources.agg(F.sum("source_size")).first()[0] or 0
    while True:
        full = F.col("cap") < F.lit(level) * F.col("weight")
        taken, sharing = sources.agg(F.sum(F.when(full, F.col("cap"))), F.sum(F.when(~full, F.col("weight")))).first()
        if not sharing or (total - (taken or 0.0)) / sharing <= level:
            break
        level = (total - (taken or 0.0)) / sharing
    return sources.withColumn("target", F.least("cap", F.lit(level) * F.col("weight"))).select("source", "source_size", "rows", "target", "slope")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, slopes=SLOPES, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """A row for each document, range-sorted by training position.

    (id, source, size, source_size, target, taken, position, takes): `taken` counts
    the words the mix takes, repeats included: whole passes over the source, then
    documents in hash order until the target is met, the last one in part.
    `takes` lists them, (position, words) a pass, with the training time 0..1 of
    the middle of each; `position` is the first, null if nothing is taken. Null
    texts have no words; a null source is one source, last in order; repeated rows
    are mixed as rows of their own, null ids as an id.
    """
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    sizes = cut(sizes)
    plan = targets(sizes, weights, slopes, max_epochs)
    joined = sizes.join(plan.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    buckets = F.ceil(F.col("rows") / BUCKET_ROWS)
    joined = joined.withColumn("hash", F.xxhash64("id", F.lit("mix"))).withColumn("bucket", F.pmod("hash", buckets))
    totals = joined.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("bucket_size").over(ahead), F.lit(0)).alias("ahead"))
    inside = Window.partitionBy("source", "bucket").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = joined.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(totals, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    start = F.col("ahead") + F.col("within")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long")
    placed = placed.withColumn("start", start).withColumn("epochs", epochs)
    taken = F.col("epochs") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("start")))
    placed = placed.withColumn("taken", taken.cast("long"))
    flat = 1 - F.col("slope")

    def position(share):
        """The training time at which the source's schedule has given out this share of its words."""
        return 2 * share / (flat + F.sqrt(flat * flat + 4 * F.col("slope") * share))

    def take(number):
        words = F.least(F.col("size"), F.col("taken") - number * F.col("size"))
        share = F.least(F.lit(1.0), (number * F.col("source_size") + F.col("start") + words / 2) / F.col("target"))
        return F.struct(position(share).alias("position"), words.alias("words"))

    passes = F.when(F.col("taken") > 0, F.ceil(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    numbers = F.filter(F.sequence(F.lit(0), passes), lambda n: n < passes)
    placed = placed.withColumn("takes", F.transform(numbers, take))
    return placed.select("id", "source", "size", "source_size", "target", "taken", F.get("takes", F.lit(0))["position"].alias("position"), "takes").orderBy("position", "id")


def training_order(mixed: DataFrame) -> DataFrame:
    """(position, id, number, words): every take of a mix, range-sorted by training position; a document comes once a pass."""
    takes = mixed.select("id", F.posexplode("takes").alias("number", "take"))
    return takes.select("take.position", "id", "number", "take.words").orderBy("position", "id", "number")
