"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its `PREFIX` nearest of `PIVOTS` pivots. Some
pivots, about one for `FILE_ROWS` vectors, own inverted files: a vector is posted in
the files of its `POSTED` nearest owners. A query is sent to the files of its nearest
owners only. There the footrule distance between orders (places in steps of `STEP`,
places beyond the prefix are the last) ranks the file, and the nearest `FRACTION` of
it is reranked by exact inner products. Orders know directions only: where vectors differ
in length, the cosines of a few rows tell what a distance means, and rows are ranked by
the inner product that their distance and length let expect.

How many files a query asks is fitted: for `FIT_QUERIES` sampled queries the true
neighbours are found in one pass over the table, and the number is the smallest that
reaches `RECALL` of them. It follows from how the data cluster: vectors in groups take a
few files, vectors without any structure a large share. Files are asked in rounds, the
nearest first, each round `WIDER` times as many: the score of the k-th row found so far
goes with a query, and a file answers only with rows that reach it. A query that finds
fewer than k rows asks all files.

Files are dealt into blocks of about `BLOCK_ROWS`, so a crowded file is several tasks.
Of equal vectors only the k + 1 of the smallest ids can be among anyone's nearest, so
the others are no candidates, and equal queries are searched once. Pivots and fitting
queries are bounded samples; every vector is indexed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.shared import cut

K = 20
PIVOTS, PREFIX, STEP = 256, 128, 16
FILE_ROWS, FILES = 256, 16_384
POSTED = 2
FRACTION = 0.35
BLOCK_ROWS = 4096
WIDER = 8
FIT_QUERIES, RECALL = 128, 0.95
#: Lengths of a block's vectors that differ by less than this are one; rows that tell what a distance means where they differ.
EVEN, TRIED = 1.001, 64
#: Pairs of a query and a vector whose footrule distances are in memory at once.
CHUNK_PAIRS = 1 << 20


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, vector) of rows with an id and a vector that is not null, empty or zero and has only finite components."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector")).where("id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.where(finite).where(F.exists("vector", lambda x: x != 0))


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and distinct vectors of the first n rows by hash of the id."""
    taken = rows.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(n).select("id", "vector").toArrow()
    if not taken.num_rows:
        return np.zeros(0, np.int64), np.zeros((0, 0))
    matrix = _matrix(taken["vector"])
    first = np.sort(np.unique(matrix, axis=0, return_index=True)[1])
    return taken["id"].to_numpy()[first], matrix[first]


def _unit(matrix: np.ndarray) -> np.ndarray:
    return matrix / np.linalg.norm(matrix, axis=1, keepdims=True)


def _order(matrix: np.ndarray, pivots: np.ndarray, n: int) -> np.ndarray:
    """The n nearest pivots of each vector, nearest first."""
    return np.argsort(-(matrix @ pivots.T), axis=1, kind="stable")[:, :n]


def _codes(matrix: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Bits whose Hamming distance is the footrule distance between orders, in steps: bit t of a pivot says that its place is before step t."""
    near = _order(matrix, pivots, PREFIX)
    place = np.full((len(matrix), len(pivots)), PREFIX, np.int16)
    np.put_along_axis(place, near, np.arange(near.shape[1], dtype=np.int16)[None, :], axis=1)
    bits = place[:, :, None] < np.arange(STEP, PREFIX + 1, STEP, dtype=np.int16)
    packed = np.packbits(bits.reshape(len(matrix), -1), axis=1)
    return np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8))).view(np.uint64)


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy().reshape(len(column), -1)


def _post_rows(owners: np.ndarray, start: int, stop: int):
    """The rows of a batch once for each of a vector's nearest owners from `start` to `stop`, with the owner as `file`."""

    def rows(batches):
        for batch in batches:
            if not len(batch):
                continue
            near = _order(_matrix(batch.column("vector")), owners, stop)[:, start:]
            for at in range(0, len(batch), 1024):
                part = near[at : at + 1024]
                row = pa.array(np.repeat(np.arange(at, at + len(part)), part.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(part.ravel()), *(c.take(row) for c in batch.columns)], ["file", *batch.schema.names])

    return rows


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    return np.lexsort((ids, -scores))[:k]


def _estimates(distance: np.ndarray, norms: np.ndarray, cosines: np.ndarray, tried: np.ndarray) -> np.ndarray:
    """What inner products are by footrule distance and length: a line through the cosines of tried rows, times the length."""
    x = distance[:, tried]
    middle = x.mean(axis=1, keepdims=True)
    spread = ((x - middle) ** 2).sum(axis=1, keepdims=True)
    slope = ((x - middle) * cosines).sum(axis=1, keepdims=True) / np.where(spread > 0, spread, 1)
    # nearer rows are never taken for worse
    return (cosines.mean(axis=1, keepdims=True) + np.minimum(slope, -1e-9) * (distance - middle)) * norms


def _search(pivots: np.ndarray, k: int):
    """Each query's nearest of a block of a file, as far as they reach its floor."""

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if left.num_rows and right.num_rows:
            # by id, so that equal distances favour the smaller
            left = left.sort_by("id")
            ids, matrix, codes = left["id"].to_numpy(), _matrix(left["vector"]), _codes(_matrix(left["vector"]), pivots)
            queries, asked, floor = right["id"].to_numpy(), _matrix(right["vector"]), right["floor"].to_numpy()
            n = min(len(ids), max(4 * k, int(np.ceil(FRACTION * len(ids)))))
            step = max(1, CHUNK_PAIRS // len(ids))
            norms = np.linalg.norm(matrix, axis=1)
            # vectors of one length are ranked by distance alone
            even = norms.max() <= EVEN * norms.min()
            tried = np.linspace(0, len(ids) - 1, min(len(ids), TRIED)).astype(np.int64)
            for at in range(0, len(queries), step):
                own = _codes(asked[at : at + step], pivots)
                distance = np.zeros((len(own), len(ids)), np.int64)
                for word in range(codes.shape[1]):
                    distance += np.bitwise_count(own[:, word, None] ^ codes[None, :, word])
                if even:
                    near = np.argpartition(distance * len(ids) + np.arange(len(ids)), n - 1, axis=1)[:, :n]
                else:
                    cosines = (_unit(asked[at : at + step]) @ matrix[tried].T) / norms[tried]
                    near = np.argpartition(-_estimates(distance, norms, cosines, tried), n - 1, axis=1)[:, :n]
                for q, row in enumerate(near):
                    scores = (matrix[row] * asked[at + q]).sum(axis=1)
                    row, scores = row[scores >= floor[at + q]], scores[scores >= floor[at + q]]
                    best = _best(ids[row], scores, k)
                    found.append((np.full(len(best), queries[at + q]), ids[row[best]], scores[best]))
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    return search


def _true_rows(asked: np.ndarray, k: int):
    """The k nearest of a batch for each fitting query: (query, id, score, vector)."""

    def rows(batches):
        for batch in batches:
            if len(batch):
                matrix = _matrix(batch.column("vector"))
                scores = asked @ matrix.T
                n = min(k, len(matrix))
                near = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                row = pa.array(near.ravel())
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(asked)), n)), batch.column("id").take(row), pa.array(np.take_along_axis(scores, near, 1).ravel()), batch.column("vector").take(row)], ["query", "id", "score", "vector"])

    return rows


def _files_to_ask(rows: DataFrame, asked: DataFrame, owners: np.ndarray, k: int) -> int:
    """The smallest number of a query's nearest owners among which RECALL of the true neighbours are posted."""
    names, queries = _sample(asked, FIT_QUERIES)
    if not len(queries):
        return 1
    order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    own = F.element_at(F.array(*map(F.lit, names.tolist())), (F.col("query") + 1).cast("int"))
    true = rows.mapInArrow(_true_rows(queries, k + 1), "query long, id long, score double, vector array<double>").where(F.col("id") != own)
    true = true.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).toArrow()
    if not true.num_rows:
        return 1
    place = np.argsort(_order(queries, owners, len(owners)), axis=1)
    posted = _order(_matrix(true["vector"]), owners, POSTED)
    needed = np.sort(place[true["query"].to_numpy()[:, None], posted].min(axis=1)) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(RECALL * len(needed))) - 1)])


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the `k` rows of `vectors` found nearest by inner product.

    Rows of the query's own id are left out; ties go to the smaller id; fewer rows
    than `k` are all returned. Rows without an id and null, zero, empty or non-finite
    vectors take no part, nor do vectors of another length than most. Of rows that
    repeat an id with the same vector one takes part; with other vectors, each does.
    """
    rows = usable(vectors, id_col, vector_col)
    counts = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if counts is None:
        return rows.select(F.col("id").alias("query_id"), F.lit(0).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    keys = [F.xxhash64("vector"), F.xxhash64("vector", F.lit("second"))]
    rows, asked = (x.where(F.size("vector") == counts["n"]).withColumns(dict(zip(("h", "h2"), keys, strict=True))) for x in (rows, usable(queries, id_col, vector_col)))
    # ranks by group with a limit: each task sends k + 1 rows of an equal vector at most
    among = F.dense_rank().over(Window.partitionBy("h", "h2").orderBy("id"))
    rows = cut(rows.withColumn("among", among).where(F.col("among") <= k + 1).dropDuplicates(["id", "h", "h2"]).select("id", "vector"))
    asked = cut(asked.dropDuplicates(["id"]))
    first = F.row_number().over(Window.partitionBy("h", "h2").orderBy("id"))
    once = cut(asked.withColumn("among", first).where(F.col("among") == 1).select("id", "h", "h2", "vector"))
    total = rows.count()
    n_files = int(min(FILES, max(1, total // FILE_ROWS)))
    sample = _unit(_sample(rows, 2 * max(PIVOTS, n_files))[1])
    pivots, owners = sample[:PIVOTS], sample[:n_files]
    ask = _files_to_ask(rows, once, owners, k)

    posted = rows.mapInArrow(_post_rows(owners, 0, POSTED), "file long, id long, vector array<double>")
    sizes = posted.groupBy("file").count().select(F.col("file").alias("f"), F.ceil(F.col("count") / BLOCK_ROWS).cast("int").alias("blocks"))
    sizes = F.broadcast(cut(sizes))  # a row a file, at most FILES
    posted = posted.join(sizes, F.col("file") == F.col("f")).withColumn("block", F.pmod(F.xxhash64("id", F.lit("block")), F.col("blocks")).cast("int"))
    key = ["file", "block", "part"]

    def search(asked: DataFrame, start: int, stop: int) -> DataFrame:
        """What rows (id, vector, floor) find in their nearest files from `start` to `stop`."""
        sent = asked.select("id", "vector", "floor").mapInArrow(_post_rows(owners, start, stop), "file long, id long, vector array<double>, floor double").join(sizes, F.col("file") == F.col("f"))
        # queries of a file are dealt too, so that neither side of a task grows with the table
        parts = sent.groupBy("file").count().select(F.col("file").alias("g"), F.ceil(F.col("count") / F.lit(BLOCK_ROWS)).cast("int").alias("parts"))
        parts = F.broadcast(cut(parts))
        sent = sent.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        sent = sent.join(parts, F.col("file") == F.col("g")).withColumn("part", F.pmod(F.xxhash64("id", F.lit("part")), F.col("parts")).cast("int"))
        held = posted.join(parts, F.col("file") == F.col("g")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        return held.select(*key, "id", "vector").groupBy(key).cogroup(sent.select(*key, "id", "vector", "floor").groupBy(key)).applyInArrow(_search(pivots, k + 1), "query_id long, vec_id long, score double")

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best_of = lambda found: cut(found.distinct().withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n"))
    none = F.lit(float("-inf"))
    found, start = best_of(search(once.withColumn("floor", none), 0, 1)), 1
    while start < ask:
        stop = min(ask, WIDER * start)
        # the score to reach is that of the last row of a full list
        full = found.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") > k).select(F.col("query_id").alias("id"), "least")
        found = best_of(found.union(search(once.join(full, "id", "left").withColumn("floor", F.coalesce("least", none)), start, stop)))
        start = stop
    if ask < len(owners):
        full = found.groupBy(F.col("query_id").alias("id")).count().where(F.col("count") >= min(k + 1, total)).select("id")
        short = cut(once.join(full, "id", "left_anti"))
        if short.count():
            found = best_of(found.union(search(short.withColumn("floor", none), ask, len(owners))))
    # every query takes what its vector found, without itself
    same = once.select("h", "h2", F.col("id").alias("query_id"))
    of = asked.select(F.col("id").alias("asked_id"), "h", "h2").join(same, ["h", "h2"]).select("asked_id", "query_id")
    out = of.join(found, "query_id").where("asked_id <> vec_id").withColumnRenamed("query_id", "searched")
    rank = F.row_number().over(Window.partitionBy("asked_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k).select(F.col("asked_id").alias("query_id"), "rank", "vec_id", "score")
