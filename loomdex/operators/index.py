"""A corpus index: postings of words in buckets, lengths and hashed vectors of documents, and totals of words.

Documents are counted in one pass over the texts and written to the shared folder. They
are then inverted in segments of at most `SEGMENT` documents: a posting block is what one
segment has of one word, ids with counts and lengths, and carries its largest count and
its shortest document, which bound the score of any of its documents under any setting of
BM25. Blocks lie in folders by a hash of their word, ordered by word, so a query opens the
buckets of its words and of these the columns it needs. They are dealt to tasks by bucket
and share of the segments: a word of most documents is many blocks, and no task's alone.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import LOWER, UPPER
from loomdex.shared import arrow_rows, exists, shared_path, written

DIM = 64
#: Documents of a segment (at most 32,767), and bytes of text that are cut into words at once: a worker's memory is some fifteen times that.
SEGMENT, SLICE_BYTES = 512, 2 << 20
#: Segments that totals of words are taken of at once.
WORD_ROWS = 4
#: Buckets at least and at most, and postings for each of them in between.
LEAST_BUCKETS, MOST_BUCKETS, BUCKET_POSTINGS = 16, 4096, 1 << 20
#: Shares of the segments in a bucket at least, and documents for each of them: what a task can get of one word.
LEAST_SHARES, SHARE_DOCS = 2, 1 << 20
NO_WORD = r"[^\p{L}\p{N}]+"
_WORD, _LOWER = regex.compile(r"[\p{L}\p{N}]+"), str.maketrans(UPPER, LOWER)


@dataclass(frozen=True)
class Index:
    """documents (id, n, words, times, vector), words (token, df, total) and posting blocks at `path`; `size` documents of `mean` words.

    A block is (bucket, token, segment, size, total, max_tf, min_n, ids, places, tfs, lengths);
    places tell the documents of a segment apart.
    """

    documents: DataFrame
    path: str
    buckets: int
    segment: int
    size: int
    mean: float

    @cached_property
    def blocks(self) -> DataFrame:
        """The posting blocks; documents are inverted when these are asked for first."""
        spark, kind = self.documents.sparkSession, self.documents.schema["id"].dataType.simpleString()
        shape = f"token string, segment long, size int, total long, max_tf int, min_n long, ids array<{kind}>, places array<smallint>, tfs array<int>, lengths array<long>"
        blocks = self.documents.select("id", "n", "words", "times").mapInArrow(_posting_blocks(self.segment), shape).withColumn("bucket", self.bucket_of(F.col("token")))
        if not exists(spark, self.path):
            # dealt by bucket and share of the segments, which is a file; ranges would invert the documents once more, to be sampled
            share = F.pmod(F.xxhash64("segment"), F.lit(max(LEAST_SHARES, self.size // SHARE_DOCS)))
            with arrow_rows(spark, self.segment):
                blocks.repartition("bucket", share).sortWithinPartitions("bucket", "token", "segment").write.partitionBy("bucket").parquet(self.path)
        return spark.read.schema(blocks.schema).parquet(self.path)

    @cached_property
    def words(self) -> DataFrame:
        """Totals of words, from the blocks if there are any."""
        if exists(self.documents.sparkSession, self.path):
            return written(self.blocks.groupBy("token").agg(F.sum("size").cast("long").alias("df"), F.sum("total").alias("total")), "index-words")
        with arrow_rows(self.documents.sparkSession, WORD_ROWS * self.segment):
            return written(word_totals(self.documents), "index-words")

    @property
    def vectors(self) -> DataFrame:
        """(id, vector) of documents with words."""
        return self.documents.select("id", "vector").where("vector is not null")

    def bucket_of(self, token: Column) -> Column:
        return bucket_of(token, self.buckets)

    def blocks_of(self, vocabulary: DataFrame, broadcast: int) -> DataFrame:
        """The blocks of the words of a vocabulary (token, each once): a scan of their buckets alone."""
        buckets = [r[0] for r in vocabulary.select(self.bucket_of(F.col("token"))).distinct().toLocalIterator()]
        known = F.broadcast(vocabulary) if vocabulary.count() <= broadcast else vocabulary
        return self.blocks.where(F.col("bucket").isin(buckets)).join(known, "token")


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _slots(words: list[str], dim: int) -> np.ndarray:
    """Two slots of each word, from the first and the second 32 bits of its md5."""
    hashed = b"".join([hashlib.md5(w.encode(), usedforsecurity=False).digest()[:8] for w in words])
    return (np.frombuffer(hashed, ">u4").astype(np.int64) % dim).reshape(-1, 2)


def hash_vectors(texts: list[str], dim: int = DIM) -> np.ndarray:
    """The hashed vectors of texts that are at hand, as a model for embed_batches(): a row each, zero without words."""
    out = np.zeros((len(texts), dim))
    for row, text in zip(out, texts, strict=True):
        words, times = np.unique(np.array(_WORD.findall(text.translate(_LOWER)), object), return_counts=True)
        for slot, weight in zip(_slots(words.tolist(), dim).T, (1.0, 0.5), strict=True):
            np.add.at(row, slot, weight * times)
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(length > 0, length, 1)


def _pieces(batch: pa.RecordBatch, size: int):
    """The batch in pieces of at most so many bytes of text, or one text; copied, as string kernels of Arrow misread offsets of slices."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(batch):
        to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, side="right"))
        to = max(to, at + 1)
        yield batch.take(pa.array(np.arange(at, to)))
        at = to


def _counted_rows(dim: int):
    def rows(batches):
        for batch in (piece for whole in batches for piece in _pieces(whole, SLICE_BYTES)):
            n = len(batch)
            tokens = pc.split_pattern_regex(pc.ascii_lower(batch.column("text").fill_null("").cast(pa.large_string())), pattern=NO_WORD)
            flat = tokens.flatten()
            filled = pc.not_equal(flat, "")
            coded = flat.filter(filled).dictionary_encode()
            words, codes = coded.dictionary.cast(pa.string()), coded.indices.to_numpy().astype(np.int64)
            ends = np.append(0, np.cumsum(filled.to_numpy(zero_copy_only=False)))[np.append(0, np.cumsum(tokens.value_lengths().to_numpy()))]
            sizes = np.diff(ends)
            pairs, times = np.unique(np.repeat(np.arange(n), sizes) * max(1, len(words)) + codes, return_counts=True)
            doc, code = np.divmod(pairs, max(1, len(words)))
            vectors = np.zeros((n, dim))
            if dim:
                slots = _slots(words.to_pylist(), dim)[code]
                vectors += (np.bincount(doc * dim + slots[:, 0], times, n * dim) + np.bincount(doc * dim + slots[:, 1], 0.5 * times, n * dim)).reshape(n, dim)
            length = np.linalg.norm(vectors, axis=1, keepdims=True)
            cuts = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
            unit = pa.array((vectors / np.where(length > 0, length, 1)).ravel())
            columns = [
                batch.column("id"),
                pa.array(sizes.astype(np.int64)),
                pa.ListArray.from_arrays(cuts, words.take(pa.array(code))),
                pa.ListArray.from_arrays(cuts, pa.array(times.astype(np.int32))),
                pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), unit, mask=pa.array(length.ravel() == 0)),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n", "words", "times", "vector"])

    return rows


def count_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM) -> DataFrame:
    """(id, n, words, times, vector): different words of each row and how often they stand, and its hashed vector.

    Words are those of functions.text.tokenize(), cut in Arrow. The vector adds 1 in
    one slot and 0.5 in another for each word, and is normalised; a row without words
    has none.
    """
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return source.mapInArrow(_counted_rows(dim), f"id {source.schema['id'].dataType.simpleString()}, n long, words array<string>, times array<int>, vector array<double>")


def _word_rows(batches):
    for batch in batches:
        coded = batch.column("words").flatten().dictionary_encode()
        codes, n = coded.indices.to_numpy(), len(coded.dictionary)
        total = np.bincount(codes, batch.column("times").flatten().to_numpy(), n)
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.bincount(codes, minlength=n)), pa.array(total.astype(np.int64))], ["token", "df", "total"])


def word_totals(counted: DataFrame) -> DataFrame:
    """(token, df, total) of counted rows; each task sends a word once a batch."""
    sent = counted.select("words", "times").mapInArrow(_word_rows, "token string, df long, total long")
    return sent.groupBy("token").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _posting_blocks(segment: int):
    """What each segment of counted documents has of each of its words."""

    def rows(batches):
        task, number = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, len(whole), segment):
                batch = whole.slice(at, segment)
                coded = batch.column("words").flatten().dictionary_encode()
                code = coded.indices.to_numpy().astype(np.int64)
                if not len(code):
                    continue
                doc = np.repeat(np.arange(len(batch)), batch.column("words").value_lengths().to_numpy())
                order = np.argsort(code, kind="stable")
                doc, tf = doc[order], batch.column("times").flatten().to_numpy()[order]
                n = batch.column("n").to_numpy()[doc]
                cuts = np.searchsorted(code[order], np.arange(len(coded.dictionary) + 1))
                lists = [pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), x) for x in (batch.column("id").take(pa.array(doc)), pa.array(doc.astype(np.int16)), pa.array(tf), pa.array(n))]
                heads = cuts[:-1]
                plain = [np.diff(cuts).astype(np.int32), np.add.reduceat(tf.astype(np.int64), heads), np.maximum.reduceat(tf, heads), np.minimum.reduceat(n, heads)]
                yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(heads), (task << 32) + number)), *map(pa.array, plain), *lists], ["token", "segment", "size", "total", "max_tf", "min_n", "ids", "places", "tfs", "lengths"])
                number += 1

    return rows


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", dim: int = DIM, segment: int = SEGMENT, inverted: bool = True) -> Index:
    """The index of documents (id, text), written to the shared folder. Null texts have no words; repeated ids are documents of their own. With `dim` 0 it has no vectors.

    Python workers get a segment at a time, so their memory does not grow with the files.
    If it is not `inverted`, documents are inverted once posting blocks are asked for.
    """
    spark = docs.sparkSession
    with arrow_rows(spark, segment):
        documents = written(count_words(docs, id_col, text_col, dim=dim), "index-documents")
    size, mean, n = documents.agg(F.count("*"), F.coalesce(F.avg("n"), F.lit(0.0)), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
    buckets = min(MOST_BUCKETS, max(LEAST_BUCKETS, n // BUCKET_POSTINGS))
    index = Index(documents, shared_path(spark, "index-postings"), buckets, segment, size, mean)
    if inverted:
        index.blocks, index.words  # noqa: B018
    return index


def postings(index: Index, vocabulary: DataFrame | None = None, broadcast: int = 0) -> DataFrame:
    """(token, id, tf, n) of all words, or of those of a vocabulary (token), which is broadcast if it has at most `broadcast` words."""
    blocks = index.blocks if vocabulary is None else index.blocks_of(vocabulary.select("token").distinct(), broadcast)
    rows = blocks.select("token", F.explode(F.arrays_zip("ids", "tfs", "lengths")).alias("p"))
    return rows.select("token", F.col("p.ids").alias("id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("n"))
