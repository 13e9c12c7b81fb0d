"""Cross-entropy difference scoring with matched bigram models.

A target model (documents labelled good) and a background model (all documents)
have one vocabulary, order and smoothing. A document's score is its mean loss a
token under the target model less that under the background model: the lower, the
more it is like the target.

Both models are whole: every word and every pair of neighbouring words of every
document counts. A pair's estimate leans on the word's own by `PRIOR` pseudo-tokens
(Dirichlet smoothing), a word's own on the uniform one by one pseudo-token a word:

    P(w | v) = (n(v w) + PRIOR P(w)) / (n(v) + PRIOR),  P(w) = (n(w) + 1) / (tokens + words)

The counts grow with the corpus, so they are never broadcast. Documents are read in
slices of about `SLICE_BYTES`. A slice sends each of its different words and pairs
once, with their number there, to the bucket of their hash; the bucket sums what all
slices sent and answers every slice with the sums, in the order of its keys. Answers
and the slice's texts meet by slice, where documents are scored. A word or pair that
all documents share is one entry a slice, in one of the buckets, so it is no hot key.
Slices are named by their content: a task that is run again makes the same ones.

Every document labelled good is a target. Few labels are broadcast, more joined by shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

from .blobs import run_starts
from .tokens import LOWER, mix, split_words, text_slices

#: Labelled ids that are broadcast to the documents at most; with more, labels and documents meet by shuffle and are written once.
BROADCAST_LABELS = 1_000_000
PRIOR = 5.0
#: Bytes of text in a slice, and bytes of text for which there is one bucket of counts.
SLICE_BYTES, BUCKET_BYTES = 20_000_000, 24_000_000

#: Keys of words are even, those of pairs odd; these two stand for the borders of a text.
START, END = (mix(np.array([k], np.uint64))[0] & ~np.uint64(1) for k in (101, 102))
_ONE = np.uint64(1)


def _token_keys(data: np.ndarray, offsets: np.ndarray):
    """Keys of the predicted tokens, of the pairs that they end, and where each text begins among them."""
    words = split_words(data, offsets, table=LOWER)
    n = words.counts + 1
    last = np.cumsum(n) - 1
    to = np.full(n.sum(), END, np.uint64)
    inner = np.ones(len(to), bool)
    inner[last] = False
    to[inner] = words.hashes() & ~_ONE
    came = np.empty(len(to), np.uint64)
    came[1:] = to[:-1]
    came[last - words.counts] = START
    with np.errstate(over="ignore"):
        return to, mix(came * np.uint64(0x9FB21C651E98DF25) + to) | _ONE, last - words.counts


def _merged(keys: list, counts: list) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sums of their counts (a column a model)."""
    k, c = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    heads = run_starts(k[order])
    return k[order][heads], np.add.reduceat(c[order], heads, axis=0) if len(heads) else c


def _packed(keys: np.ndarray) -> bytes:
    """Keys in order as differences, byte planes apart: the high planes are zeros, which shuffles compress away."""
    return np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(cell: bytes) -> np.ndarray:
    planes = np.frombuffer(cell, np.uint8).reshape(8, -1)
    with np.errstate(over="ignore"):
        return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def _small(counts: np.ndarray) -> bytes:
    return pa.compress(counts.astype(np.uint32).tobytes(), codec="zstd", asbytes=True)


def _large(cell: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(cell, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint32).astype(np.int64)


def _slices(batches, limit: int):
    """Yield (name, table) of runs of rows of at most `limit` bytes of text or so; the same rows always make the same slices."""
    held, size, name = [], 0, xxhash.xxh64()
    for batch in batches:
        for at, n, data, offsets in text_slices(batch.column("text"), limit):
            held.append(batch.slice(at, n))
            for part in (batch.column("id").slice(at, n).to_numpy(zero_copy_only=False), offsets, data):
                name.update(np.ascontiguousarray(part).view(np.uint8).data)
            size += len(data)
            if size >= limit // 2:
                yield name.intdigest() - 2**63, pa.Table.from_batches(held)
                held, size, name = [], 0, xxhash.xxh64()
    if held:
        yield name.intdigest() - 2**63, pa.Table.from_batches(held)


def _request_rows(buckets: int, limit: int):
    """What each slice asks of each bucket: its different keys there and their numbers in all and in target documents."""

    def rows(batches):
        for name, table in _slices(batches, limit):
            good = table["good"].to_numpy()
            keys, counts = [], []
            for at, n, data, offsets in text_slices(table["text"]):
                to, pairs, first = _token_keys(data, offsets)
                target = np.repeat(good[at : at + n], np.diff(np.append(first, len(to))))
                chunk = np.concatenate([to, pairs, np.full(n, START)])
                target = np.concatenate([target, target, good[at : at + n]]).astype(np.int64)
                order = np.argsort(chunk)
                heads = run_starts(chunk[order])
                keys.append(chunk[order][heads])
                counts.append(np.stack([np.diff(np.append(heads, len(chunk))), np.add.reduceat(target[order], heads)], axis=1))
            k, c = _merged(keys, counts)
            # buckets are ranges of keys, so the keys of a slice are those of its buckets in order
            bucket = ((k >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            heads = run_starts(bucket)
            for a, b in zip(heads, np.append(heads[1:], len(k)), strict=True):
                cells = [[_packed(k[a:b])], [_small(c[a:b, 0])], [_small(c[a:b, 1])]]
                yield pa.RecordBatch.from_arrays([pa.array([bucket[a]]), pa.array([name]), *(pa.array(x, pa.binary()) for x in cells)], ["bucket", "slice", "keys", "all", "target"])

    return rows


def _answers(table: pa.Table) -> pa.Table:
    """The sums of a bucket's keys, for each slice in the order of its own keys; the first row has the bucket's totals."""
    keys = [_unpacked(x.as_py()) for x in table["keys"]]
    cuts = np.append(0, np.cumsum([len(k) for k in keys]))
    k = np.concatenate(keys)
    c = np.stack([np.concatenate([_large(x.as_py(), len(own)) for x, own in zip(table[name], keys, strict=True)]) for name in ("all", "target")], axis=1)
    order = np.argsort(k, kind="stable")
    heads = run_starts(k[order])
    sums, k = np.add.reduceat(c[order], heads, axis=0), k[order][heads]
    place = np.empty(len(order), np.int64)
    place[order] = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(order))))
    word = (k & _ONE == 0) & (k != START)
    totals = [np.zeros(len(keys), np.int64) for _ in range(3)]
    for column, value in zip(totals, (word.sum(), *sums[word].sum(axis=0)), strict=True):
        column[0] = value
    cells = [pa.array([_small(sums[place[a:b], m]) for a, b in zip(cuts, cuts[1:])], pa.binary()) for m in range(2)]
    sizes = pa.array(np.diff(cuts))
    return pa.table([table["slice"], table["bucket"], sizes, *cells, *totals], names=["slice", "bucket", "size", "all", "target", "words", "tokens", "target_tokens"])


def _text_rows(limit: int):
    def rows(batches):
        for name, table in _slices(batches, limit):
            for batch in table.to_batches():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(batch), name)), batch.column("id"), batch.column("text")], ["slice", "id", "text"])

    return rows


def _score_rows(words: int, tokens: int, target_tokens: int):
    def rows(texts: pa.Table, answers: pa.Table) -> pa.Table:
        # different keys of each chunk, and of the slice, whose order is that of the answers
        chunks, keys = [], [np.zeros(0, np.uint64)]
        for _, _, data, offsets in text_slices(texts["text"]):
            to, pairs, first = _token_keys(data, offsets)
            own, place = np.unique(np.concatenate([to, pairs, [START]]), return_inverse=True)
            chunks.append((own, place.astype(np.int32), first))
            keys.append(own)
        keys = np.unique(np.concatenate(keys))
        parts = {r["bucket"]: r for r in answers.sort_by("bucket").to_pylist()}.values()
        if sum(r["size"] for r in parts) != len(keys):
            raise ValueError("documents changed between two reads; give a table")
        models = []
        for name, total in (("all", tokens), ("target", target_tokens)):
            n = np.concatenate([_large(r[name], r["size"]) for r in parts]).astype(float)
            models.append((n, PRIOR * (n + 1) / (total + words)))
        out = []
        for own, place, first in chunks:
            place = np.searchsorted(keys, own)[place]
            to, pairs, start = np.split(place, [len(place) // 2, len(place) - 1])
            came = np.empty(len(to), np.int64)
            came[1:] = to[:-1]
            came[first] = start
            losses = [np.add.reduceat(np.log((n[came] + PRIOR) / (n[pairs] + alone[to])), first) for n, alone in models]
            out.append(np.stack([np.diff(np.append(first, len(to))), *losses]))
        n, background, target = np.concatenate(out, axis=1)
        return pa.table([texts["id"], pa.array(n.astype(np.int64)), pa.array(target / n), pa.array(background / n)], names=["id", "n_tokens", "target_loss", "background_loss"])

    return rows


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", good_col: str = "quality") -> DataFrame:
    """(id, n_tokens, target_loss, background_loss, score) of every row with an id; rows without one take no part.

    Tokens are lower-cased words and the text's end, so null and empty texts have
    one. Losses are means in nats. Repeated rows count and are scored as often as
    they stand. Without labelled rows the target model is the uniform one. `docs` is
    read three times and has to be a table, or a plan that always gives the same rows.
    """
    good = labels.where((F.col(good_col) == 1) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.lit(True).alias("good")).distinct()
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    few = good.count() <= BROADCAST_LABELS
    rows = rows.join(F.broadcast(good) if few else good, "id", "left").withColumn("good", F.coalesce("good", F.lit(False)))
    # a shuffle may deal rows in another order when it is read again, and slices with it
    rows = rows if few else cut(rows)
    size = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    buckets = max(1, -(-size // BUCKET_BYTES))
    asked = rows.mapInArrow(_request_rows(buckets, SLICE_BYTES), "bucket long, slice long, keys binary, all binary, target binary")
    shape = "slice long, bucket long, size long, all binary, target binary, words long, tokens long, target_tokens long"
    answers = cut(asked.groupBy("bucket").applyInArrow(_answers, shape))
    totals = answers.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("words", "tokens", "target_tokens")]).first()
    texts = rows.drop("good").mapInArrow(_text_rows(SLICE_BYTES), "slice long, id long, text string")
    answers = answers.select("slice", "bucket", "size", "all", "target")
    scored = texts.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score_rows(*totals), "id long, n_tokens long, target_loss double, background_loss double")
    return scored.select("*", (F.col("target_loss") - F.col("background_loss")).alias("score"))
