"""Benchmark decontamination: an FM-index per shard of training text, searched for all test phrases.

A shard is one Arrow batch of documents. Words that no phrase holds end a run,
as no phrase can cross them; the remaining runs are numbered words and form the
shard's index. Phrases are searched backwards, all at once, occurrences are
located by sampled positions and merged into spans. Documents never move.

Phrases come in blocks of a fixed size, collected and broadcast one at a time. All are
searched in one pass over the documents, so a task holds the benchmark's phrases
(about 130 bytes each), and one shard's index for one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

from .blobs import run_starts
from .fm_index import FMIndex
from .tokens import ALNUM, LOWER, owners, split_words, text_slices

WINDOW = 13
#: Phrases in one broadcast block (104 bytes each, and the ids of their items).
BLOCK_PHRASES = 250_000
#: Blocks of phrases that a pass over the documents searches; a worker holds no more of the benchmark.
BLOCKS_AT_ONCE = 4


def _phrase_rows(window: int):
    def rows(batches):
        for batch in batches:
            items = batch.column("item").to_pylist()
            out_items, out_phrases = [], []
            for at, n, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, ALNUM, LOWER)
                h = words.hashes()
                for i in range(n):
                    own = h[words.first[i] : words.first[i + 1]]
                    if not len(own):
                        continue
                    width = min(window, len(own))
                    for phrase in np.lib.stride_tricks.sliding_window_view(own, width):
                        out_items.append(items[at + i])
                        out_phrases.append(phrase.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out_items, pa.string()), pa.array(out_phrases, pa.binary())], ["item", "phrase"])

    return rows


class PhraseBlock:
    """Phrases as numbered words, by length, with the items that hold them."""

    def __init__(self, rows):
        by_width: dict[int, list] = {}
        for r in rows:
            by_width.setdefault(len(r["phrase"]) // 8, []).append(r)
        hashes = np.frombuffer(b"".join(bytes(r["phrase"]) for r in rows), np.uint64)
        self.vocabulary = np.unique(hashes)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.vocabulary >> np.uint64(44)] = True
        self.groups = []
        for width, group in sorted(by_width.items()):
            words = np.frombuffer(b"".join(bytes(r["phrase"]) for r in group), np.uint64).reshape(-1, width)
            self.groups.append((width, np.searchsorted(self.vocabulary, words) + 1, [list(r["items"]) for r in group]))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1, 2, ... for words of the vocabulary; 0 for others."""
        out = np.zeros(len(hashes), np.int64)
        may = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        at = np.searchsorted(self.vocabulary, hashes[may])
        hit = self.vocabulary[np.minimum(at, len(self.vocabulary) - 1)] == hashes[may]
        out[may[hit]] = at[hit] + 1
        return out


def _runs(block: PhraseBlock, column):
    """Number of words of each text; numbered runs of a shard, zeros between, with text and place of each word."""
    least = block.groups[0][0] if block.groups else 0
    counts, numbers, texts, places = [], [], [], []
    for at, n, data, offsets in text_slices(column):
        words = split_words(data, offsets, ALNUM, LOWER)
        counts.append(words.counts)
        if not block.groups or not len(words.start):
            continue
        number = block.numbers(words.hashes())
        text = owners(words)
        known = np.flatnonzero(number)
        heads = run_starts(known - np.arange(len(known)), text[known])
        sizes = np.diff(np.append(heads, len(known)))
        heads, sizes = heads[sizes >= least], sizes[sizes >= least]
        if not len(heads):
            continue
        # one place more for the zero that ends the run
        ends = np.cumsum(sizes + 1)
        index = np.arange(ends[-1]) - np.repeat(ends - sizes - 1, sizes + 1) + np.repeat(known[heads], sizes + 1)
        last = np.minimum(index, len(number) - 1)
        run = number[last]
        run[ends - 1] = 0
        numbers.append(run)
        texts.append(text[last] + at)
        places.append(index - words.first[text[last]])
    cat = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return cat(counts), cat(numbers), cat(texts), cat(places)


def _found(block: PhraseBlock, column, spans: dict[int, list], items: dict[int, set]) -> np.ndarray:
    """Adds the occurrences of a block's phrases in a shard to the spans and items of its texts; the number of words of each text."""
    n_words, numbers, texts, places = _runs(block, column)
    if not len(numbers):
        return n_words
    index = FMIndex(numbers, len(block.vocabulary))
    for width, phrases, holders in block.groups:
        low, high = index.search(phrases)
        found = np.flatnonzero(low < high)
        many = (high - low)[found]
        which = np.repeat(found, many)
        row = np.repeat(low[found], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        at = index.locate(row)
        text, start = texts[at], places[at]
        order = np.lexsort((start, text))
        text, start, which = text[order], start[order], which[order]
        heads = np.append(run_starts(text), len(text))
        for a, b in zip(heads[:-1].tolist(), heads[1:].tolist(), strict=True):
            spans.setdefault(int(text[a]), []).append(np.stack([start[a:b], start[a:b] + width], axis=1))
            own = items.setdefault(int(text[a]), set())
            for w in np.unique(which[a:b]).tolist():
                own.update(holders[w])
    return n_words


_FOUND = "n_words long, n_hit long, spans array<struct<start: long, stop: long>>, items array<string>"


def _search(blocks: list, more: bool):
    """Spans and items of each text, and those found before; blocks of phrases are searched one after the other in each shard. Texts stay if there is `more`."""

    def rows(batches):
        for batch in batches:
            spans: dict[int, list] = {}
            items: dict[int, set] = {}
            if "spans" in batch.schema.names:
                for i, (known, held) in enumerate(zip(batch.column("spans").to_pylist(), batch.column("items").to_pylist(), strict=True)):
                    if known:
                        spans[i], items[i] = [np.array([[s["start"], s["stop"]] for s in known])], set(held)
            for block in blocks:
                n_words = _found(block.value, batch.column("__text"), spans, items)
            merged = [_merge(spans[i]) if i in spans else [] for i in range(len(batch))]
            n_hit = np.array([sum(b - a for a, b in m) for m in merged], np.int64)
            cells = pa.array([[{"start": a, "stop": b} for a, b in m] for m in merged], pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])))
            held = pa.array([sorted(items.get(i, ())) for i in range(len(batch))], pa.list_(pa.string()))
            out = {"__row": batch.column("__row")} | ({"__text": batch.column("__text")} if more else {})
            out |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit), "spans": cells, "items": held}
            yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

    return rows


def _merge(parts: list[np.ndarray]) -> list[tuple[int, int]]:
    """Disjoint spans, in order, that cover what the given ones cover."""
    pairs = np.concatenate(parts).astype(np.int64)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    stop = np.maximum.accumulate(pairs[:, 1])
    heads = np.flatnonzero(np.append(True, pairs[1:, 0] > stop[:-1]))
    return list(zip(pairs[heads, 0].tolist(), stop[np.append(heads[1:], len(pairs)) - 1].tolist(), strict=True))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Documents with the benchmark passages that they hold.

    Every column of `docs`, then n_words, n_hit (words inside any occurrence of a
    phrase), spans (merged, by word number, stop excluded), items (sorted ids of
    items with occurring phrases) and contaminated (n_hit > 0 and at least a
    twentieth of the words). A phrase is `window` consecutive words of an item, or
    a whole shorter item. Null texts have no words, items without words no phrases,
    items with a null id are named "". Input columns of the five names are replaced.
    """
    new = ("n_words", "n_hit", "spans", "items", "contaminated")
    spark = docs.sparkSession
    phrases = (
        benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text_col).alias("text"))
        .mapInArrow(_phrase_rows(window), "item string, phrase binary")
        .groupBy("phrase")
        .agg(F.sort_array(F.collect_set("item")).alias("items"))
    )
    phrases = cut(phrases)
    blocks = max(1, -(-phrases.count() // BLOCK_PHRASES))
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("__row"), F.col(text_col).alias("__text"))
    of = lambda b: spark.sparkContext.broadcast(PhraseBlock(phrases.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == b).collect()))
    row_type = rows.schema["__row"].dataType.simpleString()
    for first in range(0, blocks, BLOCKS_AT_ONCE):
        own, more = [of(b) for b in range(first, min(blocks, first + BLOCKS_AT_ONCE))], first + BLOCKS_AT_ONCE < blocks
        found = rows.mapInArrow(_search(own, more), f"__row {row_type}, {'__text string, ' if more else ''}{_FOUND}")
        if more:
            # written with what it found, so that the next pass holds its own phrases only
            rows = cut(found)
            for block in own:
                block.unpersist()
    contaminated = (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))
    return found.select(*[F.col(f"__row.`{c}`") for c in docs.columns if c not in new], "n_words", "n_hit", "spans", "items", contaminated.alias("contaminated"))
