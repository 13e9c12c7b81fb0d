"""Substring dedup by relative Lempel-Ziv parsing against sharded reference blocks.

A document is cut into overlapping phrases at content-defined anchors: of every
window of `WINDOW` words, the smallest hash of the word 4-grams inside is its
anchor, so equal windows have equal anchors wherever they stand. The anchor's
hash names the reference block that indexes the phrase, hence a phrase meets
every reference text that could hold one of its windows in a single block, and
work is linear in the corpus.

1. Anchors of all documents meet by hash; those of only one document can hold
   no repeated window and drop out (about four fifths of ordinary text).
2. Phrases around shared anchors go to their reference block. The block indexes
   each reference position by its next `WINDOW` words and the earliest document
   there; every phrase is then greedily factored. A factor starts at the first
   position whose next `WINDOW` words an earlier document has, and is as long as
   the words go on alike there. The next one starts at the first position behind
   whose words do not all lie in the last factor, so windows that cross a factor's
   border are judged too, and as phrases overlap by `WINDOW` - 1 words, those that
   cross a phrase's.
3. Factors are merged into each document's duplicate spans, and the words
   outside are kept.

Hot passages: a slice of input sends an anchor for two documents and a phrase for the
earliest, and a task remembers what it has sent lately; what that already settles is
echoed through evenly dealt rows, so no block gets a row for each copy, nor for each
slice that holds one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blobs import BUCKET_SCHEMA, binary_cells, by_bucket, by_document, documents_of, joined, run_starts
from .tokens import _power_tables, mix, owners, rolling, split_words, text_slices

WINDOW = 13
GRAM = 4
#: Bytes of text for which there is one reference block.
BLOCK_BYTES = 4 << 20
#: Anchors or phrases that a task remembers.
RECENT = 1 << 20

#: A factor: its first word and length in the document, and where the earlier document has it.
SPAN = np.dtype([("start", "<u4"), ("size", "<u4")])
FACTOR = np.dtype([*SPAN.descr, ("source", "<i8"), ("at", "<u4")])

# the low half of a packed hash is a position
_LOW = np.uint64((1 << 32) - 1)


def _windows(words, hashes: np.ndarray, window: int, gram: int):
    """First words of all windows, their anchors' words, and the 4-gram hashes."""
    n = len(hashes) - window + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = rolling(hashes, gram)
    least = (grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64)
    width, span = 1, window - gram + 1
    while width < span:
        step = min(width, span - width)
        least = np.minimum(least[:-step], least[step:])
        width += step
    owner = owners(words)
    start = np.flatnonzero(owner[:n] == owner[window - 1 :])
    return start, (least[start] & _LOW).astype(np.int64), grams


def _slices(batch: pa.RecordBatch):
    ids, keys = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("__id", "__key"))
    for at, n, data, offsets in text_slices(batch.column("__text")):
        words = split_words(data, offsets)
        yield slice(at, at + n), ids[at : at + n], keys[at : at + n], words


class _Recent:
    """Keys that a task has sent, with an id and a mark, in a table of fixed size: what it tells is true, but it forgets."""

    def __init__(self):
        self.keys, self.ids, self.marks = np.zeros(RECENT, np.uint64), np.zeros(RECENT, np.int64), np.zeros(RECENT, np.uint32)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether each key is known, its id and its mark."""
        slot = keys & np.uint64(RECENT - 1)
        return (self.keys[slot] == keys) & (keys != 0), self.ids[slot], self.marks[slot]

    def put(self, keys: np.ndarray, ids: np.ndarray, marks: np.ndarray) -> None:
        # of keys that share a slot one stays whole
        slot, first = np.unique(keys & np.uint64(RECENT - 1), return_index=True)
        self.keys[slot], self.ids[slot], self.marks[slot] = keys[first], ids[first], marks[first]


def _anchor_rows(blocks: int, window: int, gram: int):
    def rows(batches):
        sent = _Recent()
        for batch in batches:
            for _, ids, keys, words in _slices(batch):
                start, anchor, grams = _windows(words, words.hashes(), window, gram)
                if not len(start):
                    continue
                anchor = anchor[run_starts(anchor)]
                doc = np.searchsorted(words.first, anchor, side="right") - 1
                h = grams[anchor]
                # the first two documents of an anchor tell all others; the rest is known to be shared
                order = np.argsort(h, kind="stable")
                new_hash = np.zeros(len(h), bool)
                new_hash[run_starts(h[order])] = True
                new_doc = np.zeros(len(h), bool)
                new_doc[run_starts(h[order], ids[doc[order]])] = True
                nth = np.cumsum(new_doc)
                nth -= np.maximum.accumulate(np.where(new_hash, nth, 0))
                known = np.zeros(len(h), bool)
                known[order] = nth >= 2
                # two documents have been sent of an anchor that is marked, so it is known to be shared
                have, other, two = sent.look(h)
                two = two > 0
                known |= have & two
                heads = order[new_hash]
                several = np.maximum.reduceat(nth, np.flatnonzero(new_hash)) > 0
                different = have[heads] & (other[heads] != ids[doc[heads]])
                sent.put(h[heads], np.where(have[heads], other[heads], ids[doc[heads]]), several | different | (have & two)[heads])
                bucket = (h >> np.uint64(32)) % np.uint64(blocks)
                bucket = np.where(known, blocks + (doc + anchor) % blocks, bucket.astype(np.int64))
                yield by_bucket(bucket, ids[doc], keys[doc], hashes=h.astype(np.uint32), positions=(anchor - words.first[doc]).astype(np.uint32))

    return rows


def _shared_anchors(blocks: int):
    def shared(table: pa.Table) -> pa.Table:
        ids, keys = documents_of(table)
        at = joined(table["positions"], np.uint32)
        if table["bucket"][0].as_py() < blocks:
            h = joined(table["hashes"], np.uint32)
            order = np.lexsort((ids, h))
            heads = run_starts(h[order])
            several = np.zeros(len(h), bool)
            low, high = ids[order][heads], ids[order][np.append(heads[1:], len(h)) - 1]
            several[order] = np.repeat(low != high, np.diff(np.append(heads, len(h))))
            ids, keys, at = ids[several], keys[several], at[several]
        return pa.Table.from_batches([by_document(ids, keys, "positions", at)])

    return shared


def _phrase_rows(blocks: int, window: int, gram: int, sources: bool):
    def rows(batches):
        sent_before = _Recent()
        for batch in batches:
            positions = batch.column("__positions")
            for where, ids, keys, words in _slices(batch):
                cells = positions.slice(where.start, where.stop - where.start).to_pylist()
                shared = [np.frombuffer(b"".join(x), np.uint32).astype(np.int64) + words.first[i] for i, x in enumerate(cells) if x]
                if not shared:
                    continue
                h = words.hashes()
                start, anchor, grams = _windows(words, h, window, gram)
                is_shared = np.zeros(len(h) + 1, bool)
                is_shared[np.concatenate(shared)] = True
                keep = is_shared[anchor]
                start, anchor = start[keep], anchor[keep]
                if not len(start):
                    continue
                heads = run_starts(anchor, start - np.arange(len(start)))
                first, last = start[heads], start[np.append(heads[1:], len(start)) - 1]
                doc = np.searchsorted(words.first, first, side="right") - 1
                full = rolling(h, window)
                same = np.stack([full[first], full[last], (last - first).astype(np.uint64)])
                order = np.lexsort((ids[doc], *same))
                groups = run_starts(*(s[order] for s in same))
                # the earliest document of each phrase, and where it has it
                source, source_at = np.empty(len(order), np.int64), np.empty(len(order), np.uint32)
                member = np.diff(np.append(groups, len(order)))
                source[order] = np.repeat(ids[doc[order]][groups], member)
                source_at[order] = np.repeat((first - words.first[doc])[order][groups], member)
                known = ids[doc] > source
                # a phrase that a smaller document of the task has sent repeats it
                name = mix(mix(same[0] + mix(same[1])) + same[2])
                have, least, at = sent_before.look(name)
                before = have & (least < source)
                source, source_at = np.where(before, least, source), np.where(before, at, source_at)
                known |= ids[doc] > source
                heads_of = order[groups]
                sent_before.put(name[heads_of], source[heads_of], source_at[heads_of])
                bucket = ((grams[anchor[heads]] >> np.uint64(32)) % np.uint64(blocks)).astype(np.int64)
                bucket = np.where(known, blocks + (doc + first) % blocks, bucket)
                length = last - first + window
                sent = np.where(known, 0, length)
                # word hashes of the phrases that are sent, phrase after phrase in bucket order
                by = np.argsort(bucket, kind="stable")
                at = np.repeat(first[by], sent[by]) + np.arange(sent.sum()) - np.repeat(np.cumsum(sent[by]) - sent[by], sent[by])
                told = {"sources": source, "source_starts": source_at} if sources else {}
                out = by_bucket(bucket, ids[doc], keys[doc], starts=(first - words.first[doc]).astype(np.uint32), sizes=length.astype(np.uint32), **told)
                edges = np.append(run_starts(bucket[by]), len(by))
                ends = np.append(0, np.cumsum(sent[by]))[edges]
                yield out.append_column("words", binary_cells(h[at].astype(np.uint32), ends))

    return rows


def _common(words: np.ndarray, p: np.ndarray, r: np.ndarray, least: int, most: np.ndarray) -> np.ndarray:
    """How many words go on alike at the places p and r: `least` are known to, and no more than `most` are there."""
    power, inverse = _power_tables(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.append(np.zeros(1, np.uint64), np.cumsum(mix(words.astype(np.uint64) + np.uint64(1)) * power[: len(words)]))
        low, high = np.full(len(p), least), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            alike = (total[p + middle] - total[p]) * inverse[p] == (total[r + middle] - total[r]) * inverse[r]
            low, high = np.where(alike, middle, low), np.where(alike, high, middle - 1)
    return low


def _greedy(phrase: np.ndarray, p: np.ndarray, size: np.ndarray, window: int) -> np.ndarray:
    """Which of the rising places p, each with the length of its match, greedy parsing takes as factors."""
    if not len(p):
        return np.zeros(0, np.int64)
    behind = np.searchsorted(p, p + size - window + 1)
    now, taken = run_starts(phrase), []
    # the phrases are parsed side by side
    while len(now):
        taken.append(now)
        then = behind[now]
        go_on = then < len(p)
        go_on[go_on] = phrase[then[go_on]] == phrase[now[go_on]]
        now = then[go_on]
    return np.sort(np.concatenate(taken))


def _factor(blocks: int, window: int, sources: bool):
    kind = FACTOR if sources else SPAN

    def packed(start, size, source, at) -> np.ndarray:
        out = np.empty(len(start), kind)
        for name, values in zip(kind.names, (start, size, source, at), strict=False):
            out[name] = values
        return out

    def factors(table: pa.Table) -> pa.Table:
        ids, keys = documents_of(table)
        starts, sizes = joined(table["starts"], np.uint32).astype(np.int64), joined(table["sizes"], np.uint32).astype(np.int64)
        if table["bucket"][0].as_py() >= blocks:
            # whole phrases that an earlier document of the task has
            told = [joined(table["sources"], np.int64), joined(table["source_starts"], np.uint32)] if sources else [None, None]
            return pa.Table.from_batches([by_document(ids, keys, "spans", packed(starts, sizes, *told))])
        words = joined(table["words"], np.uint32)
        offset = np.cumsum(sizes) - sizes
        phrase = np.repeat(np.arange(len(sizes)), sizes)
        h = rolling(words.astype(np.uint64), window)
        at = np.flatnonzero(phrase[: len(h)] == phrase[window - 1 :])
        # the index: reference positions by their next words, the earliest document first
        own = ids[phrase[at]]
        order = np.lexsort((own, h[at]))
        heads = run_starts(h[at][order])
        earliest = np.empty(len(at), np.int64)
        earliest[order] = np.repeat(at[order][heads], np.diff(np.append(heads, len(at))))
        matched = ids[phrase[earliest]] < own
        p, r = at[matched], earliest[matched]
        ends = offset + sizes
        size = _common(words, p, r, window, np.minimum(ends[phrase[p]] - p, ends[phrase[r]] - r))
        taken = _greedy(phrase[p], p, size, window)
        p, r, size = p[taken], r[taken], size[taken]
        of, source = phrase[p], phrase[r]
        return pa.Table.from_batches([by_document(ids[of], keys[of], "spans", packed(starts[of] + p - offset[of], size, ids[source], starts[source] + r - offset[source]))])

    return factors


_LISTED = "array<struct<start:bigint,size:bigint,source:bigint,at:bigint>>"


def _kept(sources: bool):
    kind = FACTOR if sources else SPAN

    def rows(batches):
        for batch in batches:
            texts, spans = batch.column("__text").to_pylist(), batch.column("__spans").to_pylist()
            kept, n_words, n_removed, listed = [], [], [], []
            for text, cells in zip(texts, spans, strict=True):
                words = (text or "").encode().split()
                n_words.append(len(words))
                found = np.frombuffer(b"".join(cells or ()), kind)
                if len(found):
                    hit = np.zeros(len(words) + 1, np.int64)
                    np.add.at(hit, found["start"].astype(np.int64), 1)
                    np.add.at(hit, found["start"].astype(np.int64) + found["size"], -1)
                    stays = np.cumsum(hit[:-1]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                kept.append(b" ".join(words).decode())
                n_removed.append(n_words[-1] - len(words))
                listed.append([dict(zip(kind.names, f, strict=True)) for f in np.unique(found).tolist()] if sources else None)
            out = {"__row": batch.column("__row"), "__text": batch.column("__text"), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_text": pa.array(kept, pa.string())}
            if sources:
                out["factors"] = pa.array(listed, pa.list_(pa.struct([(n, pa.int64()) for n in kind.names])))
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, factors: bool = False) -> DataFrame:
    """Documents with the words removed that repeat from documents of smaller ids.

    Every column of `docs`, then n_words, n_removed and kept_text (kept words, one
    space between). With `factors` also the factors, an array of (start, size, source,
    at): `size` words from word `start` on stand in document `source` from word `at` on;
    they cover the removed words and no others. A null text has no words; rows with a null id are judged
    as copies of the smallest id (-2^63). Repeated rows of one id are judged alike
    and never against each other. Input columns of these names are replaced.
    """
    new = ("n_words", "n_removed", "kept_text", *(("factors",) if factors else ()))
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("__id"),
        F.col(text_col).alias("__text"),
        F.xxhash64(F.col(text_col)).alias("__key"),
        F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c not in (*new, text_col)]).alias("__row"),
    )
    size = rows.select(F.sum(F.octet_length("__text"))).first()[0] or 0
    blocks = max(8, -(-size // BLOCK_BYTES))

    anchors = rows.select("__id", "__key", "__text").mapInArrow(_anchor_rows(blocks, window, gram), f"{BUCKET_SCHEMA}, hashes binary, positions binary")
    shared = anchors.groupBy("bucket").applyInArrow(_shared_anchors(blocks), "id long, key long, positions binary")
    shared = shared.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list("positions").alias("__positions"))
    # both joins read the same columns, so Spark deals the texts once for the two
    phrases = rows.join(shared, ["__id", "__key"]).mapInArrow(_phrase_rows(blocks, window, gram, factors), f"{BUCKET_SCHEMA}, starts binary, sizes binary, {'sources binary, source_starts binary, ' if factors else ''}words binary")
    spans = phrases.groupBy("bucket").applyInArrow(_factor(blocks, window, factors), "id long, key long, spans binary")
    spans = spans.groupBy(F.col("id").alias("__id"), F.col("key").alias("__key")).agg(F.collect_list("spans").alias("__spans"))
    out = rows.join(spans, ["__id", "__key"], "left").select("__row", "__text", "__spans")
    row_type = rows.schema["__row"].dataType.simpleString()
    out = out.mapInArrow(_kept(factors), f"__row {row_type}, __text string, n_words long, n_removed long, kept_text string" + (f", factors {_LISTED}" if factors else ""))
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns if c not in new], *new)
