"""Vector columns: normalising, products, validation, hashed embeddings, pooling and exact top-k."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.operators.index import count_words

#: Queries that one pass over the corpus holds in memory.
QUERY_BLOCK = 2048
#: Corpus rows multiplied at once.
CORPUS_BLOCK = 4096


def as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v: Column) -> Column:
    """The unit vector; a zero vector stays."""
    size = norm(v)
    return F.when(size > 0, F.transform(v, lambda x: x / size)).otherwise(v)


def cosine(a: Column, b: Column) -> Column:
    """0 for vectors of different lengths, empty or zero ones."""
    sizes = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (sizes > 0), dot(a, b) / sizes).otherwise(F.lit(0.0))


def validate(rows: DataFrame, vector: str, dim: int) -> DataFrame:
    """Rows with `valid`: the right length and only finite components."""
    finite = F.forall(as_double(F.col(vector)), lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False)))
    return rows.withColumn("valid", F.coalesce((F.size(vector) == dim) & finite, F.lit(False)))


def hash_embed(rows: DataFrame, id_col: str, text_col: str, dim: int = 64) -> DataFrame:
    """(id, vector): unit vectors of hashed words, 1 in one slot and 0.5 in another for each word.

    Slots come from md5, which both Spark and a checking engine have; a row without
    words has no vector. Row-local: nothing is shuffled.
    """
    return count_words(rows, id_col, text_col, dim=dim).select("id", "vector").where("vector is not null")


def pool(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, vector): the mean of each group's vectors, normalised again."""
    parts = rows.select(key, F.posexplode(as_double(F.col(vector))).alias("i", "x")).groupBy(key, "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("p"))
    return means.select(key, l2_normalize(F.col("p.x")).alias("vector"))


def text_pieces(text: Column, budget: int) -> Column:
    """A text in pieces of at most `budget` characters: lines packed in order, and lines that are longer cut; white space at a cut goes, and blank pieces."""
    cut = lambda line: F.when(F.length(line) > budget, F.regexp_extract_all(line, F.lit(rf"(?s)\s*(.{{{budget}}}|.+)"), F.lit(1))).otherwise(F.array(line))
    blank = lambda t: F.trim(F.regexp_replace(t, r"\s", " ")) == ""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("held"))

    def pack(state: Column, line: Column) -> Column:
        full = (F.length(state["held"]) + F.length(line) + 1 > budget) & ~blank(state["held"])
        on = F.when(state["held"] == "", line).otherwise(F.concat(state["held"], F.lit("\n"), line))
        return F.struct(F.when(full, F.concat(state["done"], F.array(state["held"]))).otherwise(state["done"]).alias("done"), F.when(full, line).otherwise(on).alias("held"))

    packed = F.aggregate(F.flatten(F.transform(F.split(text, "\n"), cut)), start, pack, lambda s: F.filter(F.concat(s["done"], F.array(s["held"])), lambda p: ~blank(p)))
    whole = F.array(F.coalesce(text, F.lit("")))
    return F.when(F.length(text) > budget, F.when(F.size(packed) > 0, packed).otherwise(F.array(F.lit("")))).otherwise(whole)


def _embedded_pieces(model: Callable[[list[str]], np.ndarray], dim: int, batch: int):
    def vectors(texts: list[str]) -> list[np.ndarray | None]:
        try:
            return list(np.asarray(model(texts), float).reshape(len(texts), dim))
        except Exception:
            # a batch that fails is tried text by text
            return [None] if len(texts) == 1 else [v for t in texts for v in vectors([t])]

    def rows(batches):
        for b in batches:
            texts = b.column("piece").to_pylist()
            found = [v for i in range(0, len(texts), batch) for v in vectors(texts[i : i + batch])]
            good = np.array([v is not None for v in found], bool)
            matrix = np.array([np.zeros(dim) if v is None else v for v in found]).reshape(len(found), dim)
            # the pieces of a text stand together; what a batch has of it is one row
            at, key = b.column("at").to_numpy(), b.column("print").to_numpy()
            new = np.ones(len(b), bool)
            new[1:] = (at[1:] != at[:-1] + 1) | (key[1:] != key[:-1])
            heads = np.flatnonzero(new)
            total = np.add.reduceat(matrix, heads, axis=0) if len(heads) else matrix
            cuts = pa.array(np.arange(len(heads) + 1) * dim, pa.int32())
            sizes = np.diff(np.append(heads, len(b)))
            failed = np.add.reduceat((~good).astype(np.int64), heads) if len(heads) else np.zeros(0, np.int64)
            columns = [b.column("id").take(pa.array(heads)), pa.array(key[heads]), pa.ListArray.from_arrays(cuts, pa.array(total.ravel())), *map(pa.array, (sizes, failed, (at[heads] == 0).astype(np.int64)))]
            yield pa.RecordBatch.from_arrays(columns, ["id", "print", "total", "n", "failed", "copies"])

    return rows


def embed_batches(rows: DataFrame, id_col: str, text_col: str, model: Callable[[list[str]], np.ndarray], dim: int, batch: int = 16, budget: int = 1000, prefix: str = "", spread: int | None = None) -> DataFrame:
    """(id, vector, embedded, pieces) by a user's function from texts to a matrix; `pieces` is their number in the text.

    Texts over `budget` characters are embedded in pieces, whose vectors are averaged and
    normalised. Pieces of all texts fill the batches together; a task adds up what it has of
    a text, and sums of a text that several tasks have meet by its id. With `spread` the
    pieces are dealt over so many tasks first, so that no text is one task's. A batch that
    fails is tried text by text; a text of which a piece fails gets a zero vector and
    embedded = false. Null texts are empty; rows of one id and text have one vector each.
    """
    source = rows.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("print"), F.posexplode(text_pieces(F.col(text_col), budget)).alias("at", "piece"))
    source = source.select("id", "print", "at", F.concat(F.lit(prefix), "piece").alias("piece"))
    source = source.repartition(spread) if spread else source
    shape = f"id {source.schema['id'].dataType.simpleString()}, print long, total array<double>, n long, failed long, copies long"
    parts = source.mapInArrow(_embedded_pieces(model, dim, batch), shape)
    added = F.aggregate(F.collect_list("total"), F.array_repeat(F.lit(0.0), F.lit(dim)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    pooled = parts.groupBy("id", "print").agg(added.alias("total"), F.sum("n").alias("n"), F.sum("failed").alias("failed"), F.sum("copies").cast("int").alias("copies"))
    good = F.col("failed") == 0
    vector = F.when(good, l2_normalize(F.transform("total", lambda x: x / F.col("n")))).otherwise(F.array_repeat(F.lit(0.0), F.lit(dim)))
    return pooled.select("id", vector.alias("vector"), good.alias("embedded"), (F.col("n") / F.col("copies")).cast("long").alias("pieces"), F.explode(F.array_repeat(F.lit(1), F.col("copies")))).drop("col")


def top_k(rows: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The best `k` positive scores of each group with 0-based ranks; ties go to the smaller `tie`."""
    # the filter is on row_number itself, so that each task drops what cannot be among the first k before the shuffle
    place = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie)))
    return rows.where(F.col(score) > 0).withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def dense_top_k(corpus: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score, rank) of the largest positive inner products of queries (query_id, vector) with the corpus (id, vector).

    Exact: queries come in blocks of bounded size, each broadcast to one pass over
    the corpus; a task multiplies blocks and keeps k rows a query, so only those
    are shuffled. Vectors of another length than the query block's are left out.
    """
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    found = None
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).select("query_id", as_double(F.col("vector")).alias("vector")).toArrow().combine_chunks()
        if not rows.num_rows:
            continue
        dim = len(rows["vector"][0])
        rows = rows.filter(pc.equal(pc.list_value_length(rows["vector"]), dim)).combine_chunks()
        matrix = rows["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        block = queries.sparkSession.sparkContext.broadcast((rows["query_id"].to_numpy(), matrix))
        part = corpus.where(F.size("vector") == dim).select("id", as_double(F.col("vector")).alias("vector")).mapInArrow(_best(block, dim, k), "query_id long, id long, score double")
        found = part if found is None else found.union(part)
    if found is None:
        found = corpus.select(F.col("id").alias("query_id"), "id", F.lit(0.0).alias("score")).limit(0)
    return top_k(found.withColumn("score", F.round("score", 9)), "query_id", "score", "id", k)


def best_cells(names: np.ndarray, ids: pa.Array, scores: np.ndarray, k: int) -> pa.RecordBatch:
    """The k largest positive scores of each query (row) with the ids of their columns, which are in order: equal scores favour the first."""
    keep = scores > 0
    if scores.shape[1] > k:
        keep &= scores >= np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k, None]
    query, column = np.nonzero(keep)
    value = scores[query, column]
    order = np.lexsort((column, -value, query))
    query, column, value = query[order], column[order], value[order]
    first = np.searchsorted(query, np.arange(len(names)))
    near = np.arange(len(query)) - first[query] < k
    return pa.RecordBatch.from_arrays([pa.array(names[query[near]]), ids.take(pa.array(column[near])), pa.array(value[near])], ["query_id", "id", "score"])


def _best(block, dim: int, k: int):
    def rows(batches):
        names, matrix = block.value
        for batch in batches:
            batch = batch.take(pc.sort_indices(batch.column("id")))
            vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            for at in range(0, len(batch), CORPUS_BLOCK):
                yield best_cells(names, batch.column("id").slice(at, CORPUS_BLOCK), np.round(matrix @ vectors[at : at + CORPUS_BLOCK].T, 9), k)

    return rows
