"""Keyword ranking, fusion of ranked lists, gating and cited contexts, for whole batches of queries."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T
from loomdex.operators.index import SEGMENT, Index
from loomdex.operators.vectors import best_cells, top_k
from loomdex.shared import cut

K1, B = 1.5, 0.75
CANDIDATES = 40
#: A query vocabulary of at most this many words is broadcast to the table of words.
BROADCAST_WORDS = 200_000
#: Segments whose documents are scored first for each query, to know what its others have to reach.
FIRST_SEGMENTS = 2
#: Products of a query's word and a document that a task holds at once, and queries whose scores it holds.
CHUNK_PRODUCTS, SCORED_QUERIES = 1 << 20, 2048
#: Queries, and different words of queries, of a block: each block reads the buckets of its words again.
QUERY_BLOCK, WORD_BLOCK = 1 << 18, 1 << 20
#: A block of more queries asks every segment as a whole, so many queries at a time; else each query asks segments of its own. More queries have blocks of so many words.
BATCH_QUERIES, BATCH_ROWS, BATCH_WORDS = 2048, 2048, 1 << 21
#: Documents of a query's rarest words, for each of its k places, whose scores tell what it has to reach; a word of more takes part in some of the segments.
LEAD_DOCS, LEAD_WORD_DOCS = 8, 512
#: A word of at least one in so many documents of a segment is looked up there by document.
DENSE_SHARE = 16
#: Scores of leading words' documents that a task holds.
HELD_SCORES = 1 << 20
#: Scores are compared to nine digits.
_SLACK = 1e-8


def _share(tf, n, mean: float, k1: float, b: float):
    """What a word adds to the score of a document, but for its weight: grows with tf and falls with n."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * n / mean))


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... of each of several runs."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes, sizes)


class _Terms:
    """The words of a block of queries with their weights, by word."""

    def __init__(self, rows: pa.Table, size: int):
        words, names = rows["token"].combine_chunks().dictionary_encode(), rows["query_id"].combine_chunks().dictionary_encode()
        word = words.indices.to_numpy()
        order = np.argsort(word, kind="stable")
        df = rows["df"].to_numpy()
        self.words, self.names = words.dictionary, names.dictionary
        self.starts = np.searchsorted(word[order], np.arange(len(words.dictionary) + 1))
        self.query = names.indices.to_numpy()[order].astype(np.int64)
        self.weight = (rows["times"].to_numpy() * np.log((size - df + 0.5) / (df + 0.5) + 1))[order]
        self.df = df[order][self.starts[:-1]]

    def table(self) -> pa.Table:
        """(query_id, token, weight), a row for each word of a query."""
        word = np.repeat(np.arange(len(self.words)), np.diff(self.starts))
        return pa.table({"query_id": self.names.take(pa.array(self.query)), "token": self.words.take(pa.array(word)), "weight": pa.array(self.weight)})


class _Batch:
    """The words of a block of queries with their weights, by query: the least weight first."""

    def __init__(self, terms: _Terms, k: int):
        word = np.repeat(np.arange(len(terms.words)), np.diff(terms.starts))
        order = np.lexsort((terms.weight, terms.query))
        self.words, self.names, self.word, self.weight, query = terms.words, terms.names, word[order].astype(np.int32), terms.weight[order], terms.query[order]
        self.starts = np.searchsorted(query, np.arange(len(terms.names) + 1))
        # the rarest words of a query lead: until they have documents enough
        own = terms.df[self.word]
        rarest = np.lexsort((own, query))
        before = np.cumsum(own[rarest]) - own[rarest]
        lead = np.zeros(len(own), bool)
        lead[rarest] = before - before[self.starts[query]] < LEAD_DOCS * k
        self.lead = np.flatnonzero(lead)
        self.lead_query = query[self.lead]
        self.stride = np.maximum(1, own[self.lead] // LEAD_WORD_DOCS)


class _Segment:
    """What some counted documents have of the words of a block of queries; in the order of their ids, so that equal scores favour the smaller.

    Of each of their different words: its number in the block (-1 without), and how often it stands.
    """

    def __init__(self, ids: pa.Array, n: np.ndarray, n_each: np.ndarray, word: np.ndarray, times: np.ndarray, n_words: int, mean: float, k1: float, b: float):
        by_id = pc.sort_indices(ids).to_numpy()
        column = np.empty(len(by_id), np.int64)
        column[by_id] = np.arange(len(by_id))
        self.ids = ids.take(pa.array(by_id))
        asked = np.flatnonzero(word >= 0)
        asked = asked[np.argsort(word[asked], kind="stable")]
        at = np.repeat(np.arange(len(by_id)), n_each)[asked]
        self.doc, self.share, word = column[at], _share(times[asked], n[at], mean, k1, b), word[asked]
        starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])[: len(word)])
        self.word, self.sizes = word[starts], np.diff(np.append(starts, len(word)))
        # by word of the block of queries: postings, where they start, and the largest share
        self.size, self.start, self.top = np.zeros(n_words, np.int64), np.zeros(n_words, np.int64), np.zeros(n_words)
        self.size[self.word], self.start[self.word] = self.sizes, starts
        if len(starts):
            self.top[self.word] = np.maximum.reduceat(self.share, starts)
        # words of many documents are looked up by document
        dense = np.flatnonzero(self.sizes * DENSE_SHARE >= len(self.ids))
        self.dense = np.full(n_words, -1, np.int32)
        self.dense[self.word[dense]] = np.arange(len(dense))
        self.table = np.zeros((len(dense), len(self.ids)))
        n_each, at = self.postings(self.word[dense])
        self.table[np.repeat(np.arange(len(dense)), n_each), self.doc[at]] = self.share[at]

    def keyed(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys of word and document, in order, and the shares of these; one that fits nothing stands last."""
        key = np.repeat(self.word.astype(np.int64), self.sizes) * len(self.ids) + self.doc
        order = np.argsort(key)
        return np.append(key[order], -1), np.append(self.share[order], 0.0)

    def postings(self, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many postings each of these words has, and where all of them stand."""
        n = self.size[word]
        return n, np.repeat(self.start[word], n) + _within(n)


def _chunks(sizes: np.ndarray) -> list[np.ndarray]:
    """Places of runs of these sizes, in parts of about CHUNK_PRODUCTS in all."""
    ends = np.cumsum(sizes)
    parts = np.split(np.arange(len(sizes)), np.searchsorted(ends, np.arange(CHUNK_PRODUCTS, ends[-1], CHUNK_PRODUCTS))) if len(sizes) else []
    return [p for p in parts if len(p)]


def _best_of_rows(row: np.ndarray, doc: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each row, ties by smaller document."""
    order = np.lexsort((doc, -score, row))
    sizes = np.bincount(row)
    return order[_within(sizes[sizes > 0]) < k]


def _segments(batches, words: pa.Array, mean: float, k1: float, b: float):
    """Counted documents a segment at a time, with numbers that differ between tasks.

    Those of a batch that say one word most often, and of these such of like length, come
    together: they share a language or a subject, so bounds of a segment rule out more.
    """
    number = TaskContext.get().partitionId() * 7919
    for whole in batches:
        coded = whole.column("words").flatten().dictionary_encode()
        known, code = pc.index_in(coded.dictionary, value_set=words).fill_null(-1).to_numpy(), coded.indices.to_numpy()
        times, n = whole.column("times").flatten().to_numpy(), whole.column("n").to_numpy()
        n_each = whole.column("words").value_lengths().to_numpy().astype(np.int64)
        starts, topmost = np.cumsum(n_each) - n_each, np.full(len(whole), -1)
        if len(code):
            topmost[n_each > 0] = np.maximum.reduceat((times.astype(np.int64) << 32) + code, starts[n_each > 0]) & 0xFFFFFFFF
        order = np.lexsort((n, topmost))
        for at in range(0, len(whole), SEGMENT):
            docs = order[at : at + SEGMENT]
            own = np.repeat(starts[docs], n_each[docs]) + _within(n_each[docs])
            yield number, _Segment(whole.column("id").take(pa.array(docs)), n[docs], n_each[docs], known[code[own]], times[own], len(words), mean, k1, b)
            number += 1


def _lead_scores(batch, k: int, mean: float, k1: float, b: float):
    """(query, score): a task's k best scores of each query among the documents that its leading words name."""

    def best_so_far(query: list[np.ndarray], score: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        query, score = np.concatenate(query), np.concatenate(score)
        best = _best_of_rows(query, query, score, k)
        return [query[best]], [score[best]]

    def rows(batches):
        own, queries, scores, held = batch.value, [np.zeros(0, np.int64)], [np.zeros(0)], 0
        for number, segment in _segments(batches, own.words, mean, k1, b):
            n_docs, (keys, shares) = len(segment.ids), segment.keyed()
            # of a word of many documents some segments are enough, other ones for other words
            word = own.word[own.lead]
            terms = np.flatnonzero((segment.size[word] > 0) & ((number + word) % own.stride == 0))
            sizes = np.bincount(own.lead_query[terms], segment.size[word[terms]], len(own.names)).astype(np.int64)
            asking = np.flatnonzero(sizes)
            first = np.searchsorted(own.lead_query[terms], np.append(asking, len(own.names)))
            for part in _chunks(sizes[asking]):
                here = terms[first[part[0]] : first[part[-1] + 1]]
                n_each, at = segment.postings(word[here])
                row, doc = np.divmod(np.unique(np.repeat(own.lead_query[here], n_each) * n_docs + segment.doc[at]), n_docs)
                total, n_terms = np.zeros(len(row)), own.starts[row + 1] - own.starts[row]
                for some in _chunks(n_terms):
                    n = n_terms[some]
                    term = np.repeat(own.starts[row[some]], n) + _within(n)
                    wanted = own.word[term].astype(np.int64) * n_docs + np.repeat(doc[some], n)
                    place = np.searchsorted(keys[:-1], wanted)
                    total[some] = np.bincount(np.repeat(np.arange(len(some)), n), own.weight[term] * shares[place] * (keys[place] == wanted), len(some))
                queries.append(row)
                scores.append(total)
                held += len(row)
                if held > HELD_SCORES:
                    queries, scores = best_so_far(queries, scores)
                    held = 0
        (query,), (score,) = best_so_far(queries, scores)
        yield pa.RecordBatch.from_arrays([pa.array(query), pa.array(score)], ["query", "score"])

    return rows


def _batch_scores(batch, reached, k: int, mean: float, k1: float, b: float):
    """The k best documents of a segment for each query that reaches there what it has to (MaxScore).

    Words of many documents that cannot lift a document to that alone, not even together,
    name no documents: they are added only to those that the other words bring near enough.
    """

    def segment_rows(own: _Batch, segment: _Segment):
        n_docs = len(segment.ids)
        for low in range(0, len(own.names), BATCH_ROWS):
            high = min(low + BATCH_ROWS, len(own.names))
            starts, limit = own.starts[low : high + 1], reached.value[low:high] - _SLACK
            word, weight = own.word[starts[0] : starts[-1]], own.weight[starts[0] : starts[-1]]
            starts = starts - starts[0]
            row = np.repeat(np.arange(high - low), np.diff(starts))
            bound = weight * segment.top[word]
            sums = np.append(0.0, np.cumsum(bound))
            alive = (sums[starts[1:]] - sums[starts[:-1]] >= limit) & (sums[starts[1:]] > sums[starts[:-1]])
            here = np.flatnonzero(alive[row] & (bound > 0))
            names_docs = (segment.dense[word[here]] < 0) | (sums[here + 1] - sums[starts[row[here]]] >= limit[row[here]])
            terms, rest = here[names_docs], here[~names_docs]
            if not len(terms):
                continue
            # the rows that are left, and what the words that name no documents add to them at most
            rows, at_row = np.flatnonzero(alive), np.cumsum(alive) - 1
            more = np.bincount(at_row[row[rest]], bound[rest], len(rows))
            least = np.maximum(limit[rows] - more, np.finfo(float).tiny)
            scores = 0.0
            for part in _chunks(segment.size[word[terms]]):
                n_each, at = segment.postings(word[terms[part]])
                cell = np.repeat(at_row[row[terms[part]]] * n_docs, n_each) + segment.doc[at]
                scores += np.bincount(cell, np.repeat(weight[terms[part]], n_each) * segment.share[at], len(rows) * n_docs)
            near = np.flatnonzero(scores.reshape(len(rows), n_docs) >= least[:, None])
            total = scores[near]
            r, doc = np.divmod(near, n_docs)
            # words of the rest, the largest weight first, as long as a document can still reach enough
            first = np.searchsorted(at_row[row[rest]], np.arange(len(rows) + 1))
            left = np.append(0.0, np.cumsum(bound[rest]))
            for step in range(int(np.diff(first).max(initial=0))):
                last = first[r + 1] - 1 - step
                open_ = np.flatnonzero(last >= first[r])
                if not len(open_):
                    break
                term = rest[last[open_]]
                total[open_] += weight[term] * segment.table[segment.dense[word[term]], doc[open_]]
                rest_bound = left[np.maximum(last, first[r])] - left[first[r]]
                kept = total + rest_bound >= limit[rows[r]]
                r, doc, total = r[kept], doc[kept], total[kept]
            total = np.round(total, 9)
            best = _best_of_rows(r, doc, total, k)
            if len(best):
                yield pa.RecordBatch.from_arrays([own.names.take(pa.array(low + rows[r[best]])), segment.ids.take(pa.array(doc[best])), pa.array(total[best])], ["query_id", "id", "score"])

    return lambda batches: (out for _, segment in _segments(batches, batch.value.words, mean, k1, b) for out in segment_rows(batch.value, segment))


def _batch_top_k(spark, index: Index, block: _Terms, k: int, mean: float, k1: float, b: float) -> DataFrame:
    """(query_id, id, score) with the k best documents of each query of a large block, which asks every document where it lies.

    Documents of a query's rarest words tell a score that its k-th one has at least; with
    that, few of its words name documents in a segment, and few documents are scored.
    Only the best of each are shuffled; posting blocks are not needed.
    """
    counted, batch = index.documents.select("id", "n", "words", "times"), spark.sparkContext.broadcast(_Batch(block, k))
    lead = counted.mapInArrow(_lead_scores(batch, k, mean, k1, b), "query long, score double")
    # one row a query of the block
    rows = top_k(lead, "query", "score", "query", k).where(F.col("rank") == k - 1).select("query", "score").toArrow()
    reached = np.zeros(len(block.names))
    reached[rows["query"].to_numpy()] = rows["score"].to_numpy()
    kinds = [spark.createDataFrame(block.table().slice(0, 1)).schema["query_id"].dataType.simpleString(), index.documents.schema["id"].dataType.simpleString()]
    return counted.mapInArrow(_batch_scores(batch, spark.sparkContext.broadcast(reached), k, mean, k1, b), f"query_id {kinds[0]}, id {kinds[1]}, score double")


def _scored_segments(terms, k: int, mean: float, k1: float, b: float):
    """The k best documents of a segment for each query that asks it."""

    def score(blocks: pa.Table, asking: pa.Table) -> pa.Table:
        all_terms = terms.value
        empty = pa.table({"query_id": all_terms.names.slice(0, 0), "id": blocks["ids"].combine_chunks().flatten().slice(0, 0), "score": pa.array([], pa.float64())})
        if not len(blocks) or not len(asking):
            return empty
        row_of = np.full(len(all_terms.names), -1)
        asked = np.unique(pc.index_in(asking["query_id"].combine_chunks(), value_set=all_terms.names).to_numpy())
        row_of[asked] = np.arange(len(asked))
        word = pc.index_in(blocks["token"].combine_chunks(), value_set=all_terms.words).to_numpy()
        lists = [blocks[c].combine_chunks() for c in ("ids", "places", "tfs", "lengths")]
        sizes = lists[0].value_lengths().to_numpy().astype(np.int64)
        places, first = np.unique(lists[1].flatten().to_numpy(), return_index=True)
        ids, (doc, tf, n) = lists[0].flatten().take(pa.array(first)), (x.flatten().to_numpy() for x in lists[1:])
        # by id, so that equal scores favour the smaller
        by_id = pc.sort_indices(ids).to_numpy()
        column = np.empty(len(by_id), np.int64)
        column[by_id] = np.arange(len(by_id))
        doc, ordered = column[np.searchsorted(places, doc)], ids.take(pa.array(by_id))
        share = _share(tf, n, mean, k1, b)
        first = np.append(0, np.cumsum(sizes))
        # the queries' words that are here: a row of scores, a weight, and the word's postings
        times = np.diff(all_terms.starts)[word]
        term = np.repeat(all_terms.starts[word], times) + _within(times)
        row, weight, start, size = row_of[all_terms.query[term]], all_terms.weight[term], np.repeat(first[:-1], times), np.repeat(sizes, times)
        found = []
        for low in range(0, len(asked), SCORED_QUERIES):
            names = all_terms.names.take(pa.array(asked[low : low + SCORED_QUERIES]))
            own = np.flatnonzero((row >= low) & (row < low + len(names)))
            scores = np.zeros((len(names), len(ordered)))
            for terms_here in np.split(own, np.searchsorted(np.cumsum(size[own]), np.arange(CHUNK_PRODUCTS, size[own].sum(), CHUNK_PRODUCTS))):
                n_each = size[terms_here]
                at = np.repeat(start[terms_here], n_each) + _within(n_each)
                np.add.at(scores.ravel(), np.repeat(row[terms_here] - low, n_each) * len(ordered) + doc[at], np.repeat(weight[terms_here], n_each) * share[at])
            found.append(best_cells(names.to_numpy(zero_copy_only=False), ordered, np.round(scores, 9), k))
        return pa.Table.from_batches(found).cast(empty.schema)

    return score


def segment_bounds(index: Index, asked: DataFrame, buckets: list[int], mean: float, k1: float, b: float) -> DataFrame:
    """(query_id, segment, bound): what no document of the segment can pass for the query, from the blocks' bounds alone.

    Of queries' weighted words (query_id, token, weight), and read from the words' buckets.
    """
    heads = index.blocks.where(F.col("bucket").isin(buckets)).select("token", "segment", "max_tf", "min_n")
    bound = F.col("weight") * _share(F.col("max_tf"), F.col("min_n"), mean, k1, b)
    return heads.join(F.broadcast(asked), "token").groupBy("query_id", "segment").agg(F.sum(bound).alias("bound"))


def bm25_top_k(queries: DataFrame, index: Index, k: int, terms: Column | None = None, k1: float = K1, b: float = B, first: int = FIRST_SEGMENTS) -> DataFrame:
    """(query_id, id, score, rank) of queries (query_id, text): the best `k` by BM25, ties by smaller id.

    Query words count as often as they stand. `terms` replaces the words of a query.

    Queries come in blocks of bounded size, whose words and weights are broadcast. Of the
    postings only the buckets of these words are read. The blocks' bounds tell how much a
    query can score in a segment; its `first` segments by that are scored, and of the others
    only those that may still reach the k-th score found (block-max). Blocks of many queries
    ask every segment as a whole, where bounds tell which of a query's words name documents.
    The result is the one of scoring all. Segments are scored apart, each by its blocks of
    the words asked for.
    """
    terms = T.tokenize(F.col("text")) if terms is None else terms
    asked = queries.select("query_id", F.explode(terms).alias("token")).groupBy("query_id", "token").agg(F.count("*").alias("times"))
    vocabulary = asked.select("token").distinct()
    known = index.words.join(F.broadcast(vocabulary) if vocabulary.count() <= BROADCAST_WORDS else vocabulary, "token", "left_semi").select("token", "df")
    asked = asked.join(known, "token").withColumn("bucket", index.bucket_of(F.col("token")))
    n_words, n_queries = asked.agg(F.count("*"), F.count_distinct("query_id")).first()
    blocks = max(1, -(-n_queries // QUERY_BLOCK), -(-n_words // (WORD_BLOCK if n_queries <= BATCH_QUERIES else BATCH_WORDS)))
    spark, mean, found = queries.sparkSession, max(index.mean, 1.0), None
    for number in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == number).toArrow()
        if not rows.num_rows:
            continue
        part = _pruned_top_k(spark, index, _Terms(rows, index.size), pc.unique(rows["bucket"]).to_pylist(), k, mean, k1, b, first)
        found = part if found is None else found.union(part)
    if found is None:
        found = queries.select("query_id").limit(0).crossJoin(index.documents.select("id").limit(0)).withColumn("score", F.lit(0.0))
    return top_k(found, "query_id", "score", "id", k)


def _pruned_top_k(spark, index: Index, block: _Terms, buckets: list[int], k: int, mean: float, k1: float, b: float, first: int) -> DataFrame:
    """(query_id, id, score) with the k best documents of each query of a block, from the segments that can hold them."""
    if len(block.names) > BATCH_QUERIES:
        return _batch_top_k(spark, index, block, k, mean, k1, b)
    asked, terms = spark.createDataFrame(block.table()), spark.sparkContext.broadcast(block)
    kinds = [asked.schema["query_id"].dataType.simpleString(), index.blocks.schema["ids"].dataType.elementType.simpleString()]
    # blocks of words that no query asks for stay where they are read
    postings = index.blocks.where(F.col("bucket").isin(buckets)).select("token", "segment", "ids", "places", "tfs", "lengths").join(F.broadcast(asked.select("token").distinct()), "token", "left_semi")

    def scored(pairs: DataFrame) -> DataFrame:
        # joined by segment alone, as they are scored: blocks move at most once
        chosen = postings.join(pairs.select("segment").distinct(), "segment", "left_semi")
        return chosen.groupBy("segment").cogroup(pairs.groupBy("segment")).applyInArrow(_scored_segments(terms, k, mean, k1, b), f"query_id {kinds[0]}, id {kinds[1]}, score double")

    bounds = cut(segment_bounds(index, asked, buckets, mean, k1, b))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment"))
    head = cut(bounds.withColumn("place", place).where(F.col("place") <= first).select("query_id", "segment"))
    best = cut(top_k(scored(head), "query_id", "score", "id", k))
    # one row a query of the block
    reached = best.where(F.col("rank") == k - 1).select("query_id", F.col("score").alias("reached"))
    left = bounds.join(head, ["query_id", "segment"], "left_anti").join(F.broadcast(reached), "query_id", "left")
    left = left.where(F.col("bound") >= F.coalesce("reached", F.lit(0.0)) - _SLACK).select("query_id", "segment")
    return best.select("query_id", "id", "score").union(scored(left))


def any_term_top_k(queries: DataFrame, index: Index, k: int = CANDIDATES) -> DataFrame:
    """BM25 over the terms that a cleaned query keeps; a query without terms has no rows."""
    terms = F.flatten(F.transform(T.query_terms(F.col("text")), lambda t: T.tokenize(t)))
    return bm25_top_k(queries, index, k, terms=terms)


def _ranked(rows: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows of each query in this order, ranks from 0."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(*order))
    return rows.withColumn("rank", place).where(F.col("rank") <= k).withColumn("rank", (F.col("rank") - 1).cast("long"))


def rrf_fuse(lists: dict[str, tuple[DataFrame, float]], limit: int, k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of named, weighted lists (query_id, id, rank): (query_id, id, score, sources, rank)."""
    parts = [rows.select("query_id", "id", (F.lit(weight) / (k + F.col("rank") + 1)).alias("part"), F.lit(name).alias("source")) for name, (rows, weight) in lists.items()]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    fused = both.groupBy("query_id", "id").agg(F.round(F.sum("part"), 9).alias("score"), F.array_sort(F.collect_set("source")).alias("sources"))
    return _ranked(fused, limit, F.desc("score"), "id")


def merged(dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Full outer join of two ranked lists: ranks and scores of both sides."""
    d = dense.select("query_id", "id", F.col("rank").alias("d_rank"), F.col("score").alias("d_score"))
    return d.join(lexical.select("query_id", "id", F.col("rank").alias("l_rank"), F.col("score").alias("l_score")), ["query_id", "id"], "full_outer")


def dense_first(dense: DataFrame, lexical: DataFrame, limit: int, reserved: int, fill: bool = True) -> DataFrame:
    """Dense hits with `reserved` places for lexical ones: (query_id, id, score, sources, rank).

    First the dense hits below limit - reserved, then the best reserved lexical hits
    that are not among them, then other dense and, with `fill`, other lexical hits.
    """
    both = merged(dense, lexical)
    head = F.coalesce(F.col("d_rank") < limit - reserved, F.lit(False))
    lexical_place = F.row_number().over(Window.partitionBy("query_id", head).orderBy(F.col("l_rank").asc_nulls_last()))
    chosen = ~head & F.col("l_rank").isNotNull() & (lexical_place <= reserved)
    kind = F.when(head, 0).when(chosen, 1).when(F.col("d_rank").isNotNull(), 2).otherwise(3)
    by_dense = F.col("kind").isin(0, 2)
    placed = both.withColumn("kind", kind).where(F.lit(fill) | (F.col("kind") < 3))
    placed = placed.withColumn("own", F.when(by_dense, F.col("d_rank")).otherwise(F.col("l_rank"))).withColumn("score", F.when(by_dense, F.col("d_score")).otherwise(F.col("l_score")))
    sources = F.filter(F.array(F.when(F.col("d_rank").isNotNull(), "dense"), F.when(F.col("l_rank").isNotNull(), "lexical")), lambda s: s.isNotNull())
    return _ranked(placed.withColumn("sources", sources), limit, "kind", "own", "id").select("query_id", "id", "score", "sources", "rank")


def dense_then_lexical(dense: DataFrame, lexical: DataFrame, limit: int) -> DataFrame:
    """All dense hits first; lexical ones only fill what is left."""
    return dense_first(dense, lexical, limit, 0)


def load_hits(ranked: DataFrame, docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Ranked rows with their documents; hits whose document is gone drop out, and ranks close up."""
    hits = ranked.join(docs.withColumnRenamed(id_col, "id"), "id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("rank")) - 1
    return hits.withColumn("rank", rank.cast("long"))


def with_tops(hits: DataFrame, dense: DataFrame, lexical: DataFrame) -> DataFrame:
    """Hits with each query's best lexical and dense scores, 0 if there is none.

    The lists are read again here: give them written, or as plain scans.
    """
    best = lambda rows, name: rows.where("rank = 0").select("query_id", F.col("score").alias(name))
    joined = hits.join(best(lexical, "top_bm25"), "query_id", "left").join(best(dense, "top_cosine"), "query_id", "left")
    return joined.fillna(0.0, ["top_bm25", "top_cosine"])


def hybrid_search(dense: DataFrame, lexical: DataFrame, docs: DataFrame, limit: int = 8, reserved: int = 1, id_col: str = "doc_id") -> DataFrame:
    """Hits of both lists in dense-first order with their documents and each query's best scores; the lists (k rows a query) are written once."""
    dense, lexical = cut(dense), cut(lexical)
    return with_tops(load_hits(dense_first(dense, lexical, limit, reserved), docs, id_col), dense, lexical)


def relevance_gate(hits: DataFrame, min_cosine: float = 0.72, min_bm25: float = 0.35) -> DataFrame:
    """All hits of queries whose best dense or lexical score is high enough."""
    return hits.where((F.col("top_cosine") >= min_cosine) | (F.col("top_bm25") >= min_bm25))


def lead_fallback(questions: DataFrame, library: DataFrame, chunks: DataFrame, limit: int = 8) -> DataFrame:
    """(query_id, id, ordinal, rank) for questions (query_id, text) that passed no gate.

    The first chunks of the newest document of the library (id, stem, indexed) whose
    stem is in the question, or, if the question asks for documents, of the newest of all.
    Stems of three letters or more meet questions by their first three letters.
    """
    asked = questions.select("query_id", F.lower("text").alias("text"), T.document_intent(F.col("text")).alias("asks"))
    grams = asked.select("query_id", "text", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text") - 2)), lambda i: F.substring(F.col("text"), i, F.lit(3))))).alias("gram"))
    stems = library.select("id", F.lower("stem").alias("stem"), "indexed").where("length(stem) >= 3").withColumn("gram", F.left("stem", F.lit(3)))
    named = grams.join(stems, "gram").where(F.col("text").contains(F.col("stem"))).groupBy("query_id").agg(F.max(F.struct("indexed", "id")).alias("named"))
    newest = library.agg(F.max(F.struct("indexed", "id")).alias("newest"))
    chosen = asked.join(named, "query_id", "left").crossJoin(F.broadcast(newest))
    chosen = chosen.where(F.col("named").isNotNull() | F.col("asks")).select("query_id", F.coalesce("named", "newest")["id"].alias("id"))
    return _ranked(chosen.join(chunks.select("id", "ordinal"), "id"), limit, "ordinal")


def build_context(hits: DataFrame, top_k: int = 8, size: int = 6000) -> DataFrame:
    """(query_id, n_sources, context) of hits (query_id, rank, name, text): fenced, numbered sources of at most `size` bytes, the first in any case."""
    body = hits.where(F.col("rank") < top_k).select("query_id", "rank", T.sanitize_meta(F.col("name")).alias("name"), T.neutralize(F.col("text")).alias("body"))
    used = F.sum(F.octet_length("body")).over(Window.partitionBy("query_id").orderBy("rank"))
    kept = body.withColumn("used", used).where((F.col("rank") == 0) | (F.col("used") <= size))
    marker = (F.col("rank") + 1).cast("string")
    block = F.concat(F.lit("<<<SOURCE "), marker, F.lit(" "), F.col("name"), F.lit(">>>\n"), F.col("body"), F.lit("\n<<<END "), marker, F.lit(">>>"))
    blocks = kept.select("query_id", F.struct("rank", block.alias("block")).alias("s")).groupBy("query_id").agg(F.array_sort(F.collect_list("s")).alias("s"))
    return blocks.select("query_id", F.size("s").cast("long").alias("n_sources"), F.array_join("s.block", "\n\n").alias("context"))


def used_citations(answers: DataFrame, citations: DataFrame, keys: list[str]) -> DataFrame:
    """Citations (keys, marker, ...) that the answer (keys, answer) of the same keys names."""
    used = answers.select(*keys, F.explode(T.cited_markers(F.col("answer"))).alias("marker"))
    return citations.join(used, [*keys, "marker"], "left_semi")


def fit_prompt(rows: DataFrame, window: int, overhead: int) -> DataFrame:
    """Rows (message, context) cut to a window of characters: the message first, then the context, the rest for history."""
    room = max(0, window - overhead)
    fitted = rows.withColumn("message_out", T.truncate_marked(F.col("message"), room))
    left = F.greatest(F.lit(0), F.lit(room) - F.length("message_out"))
    fitted = fitted.withColumn("left", left).withColumn("context_out", T.truncate_marked(F.col("context"), F.col("left")))
    fitted = fitted.withColumn("history_chars", F.greatest(F.lit(0), F.col("left") - F.length("context_out")))
    return fitted.withColumns({"message_cut": F.length("message") > room, "context_cut": F.length("context") > F.col("left")}).drop("left")


def trim_history(messages: DataFrame, session: str, turn: str, text: str, budget: int) -> DataFrame:
    """The newest messages of each session within a budget of characters; the newest always, cut if it must be."""
    newest = F.row_number().over(Window.partitionBy(session).orderBy(F.desc(turn)))
    rows = messages.withColumn("n", newest)
    rows = rows.withColumn(text, F.when(F.col("n") == 1, T.truncate_marked(F.col(text), budget)).otherwise(F.col(text)))
    used = F.sum(F.length(text)).over(Window.partitionBy(session).orderBy("n"))
    return rows.withColumn("used", used).where((F.col("n") == 1) | (F.col("used") <= budget)).drop("n", "used")
