"""Alignment of two tokenizers' tokens by divide and conquer at shared cuts, and counts of linked tokens.

A text becomes tokens of a byte-level BPE (A) and of a SentencePiece model (B), each with
the byte at which it ends. A cut is a byte at which tokens of both end. An interval of a
text is split at the cut nearest to its middle, found by bisecting B's ends for A's ends
in ever wider steps around the middle; both halves go on likewise, and an interval without
an inner cut is a group. All open intervals of a slice of input take each step together.

Every A token of a group is linked to every B token of it. Slices of documents send their
linked pairs of ids with the number of documents that hold them; the sums tell in how many
documents a pair is linked, and whether another partner of its A id is linked in more.
The slices ask for the sums of their pairs, so neither documents nor the table of pairs
ever has to fit anywhere.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomdex.shared import written

from .blobs import run_starts
from .tokens import text_slices

#: Where the public tokenizers' files are.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that ask for counts at once, and that are cut into tokens at once.
SLICE_BYTES, PIECE_BYTES = 2 << 20, 1 << 19
#: Linked pairs that a task lists at once.
PAIRS = 1 << 21
_CODEC = pa.Codec("zstd", compression_level=3)

#: Fixed value: the pattern by which byte-level BPE splits text before its merges.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write for bytes: printable Latin-1 for itself, the others from U+0100 on."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class ByteBPE:
    """A byte-level BPE of a tokenizer's JSON: special tokens are plain text, and a space comes before each text."""

    def __init__(self, source: bytes):
        import tiktoken

        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in json.loads(source)["model"]["vocab"].items()}
        self._encoding = tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (max(ranks.values()) + 1)
        for piece, i in ranks.items():
            self.pieces[i] = piece

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [self._encoding.encode_ordinary(" " + t) for t in texts]


class PieceBPE:
    """A SentencePiece model, which puts a space before each text itself."""

    def __init__(self, source: bytes):
        import sentencepiece

        self._model = sentencepiece.SentencePieceProcessor(model_proto=source)
        ids = range(self._model.get_piece_size())
        self.pieces = [bytes([int(p[3:5], 16)]) if self._model.is_byte(i) else p.replace("▁", " ").encode() for i in ids for p in [self._model.id_to_piece(i)]]

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self._model.encode(texts, num_threads=1)


@lru_cache(4)
def _tokenizer(kind: type, source: bytes):
    return kind(source)


@lru_cache(4)
def _piece_table(kind: type, source: bytes) -> pa.Array:
    return pa.array(_tokenizer(kind, source).pieces, pa.large_binary())


def _joined(table: pa.Array, places: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The chosen entries of a table of strings as one, and where each begins and the last ends."""
    if not len(places):
        return b"", np.zeros(1, np.int64)
    _, offsets, data = table.take(pa.array(places)).buffers()
    offsets = np.frombuffer(offsets, np.int64)[: len(places) + 1]
    return data.to_pybytes()[offsets[0] : offsets[-1]], offsets - offsets[0]


def tokenizer_files(spark: SparkSession, folder: str = TOKENIZERS):
    """The two tokenizers' files, a few MB, for all tasks; the folder is one of the driver's."""
    sources = []
    for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"):
        with open(f"{folder}/{name}", "rb") as file:
            sources.append(file.read())
    return spark.sparkContext.broadcast(tuple(sources))


def _runs(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges lo..hi-1, one after the other, and the range of each."""
    size = np.maximum(hi - lo, 0)
    of = np.repeat(np.arange(len(lo)), size)
    return np.repeat(lo - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum()), of


def _middle_cuts(a: np.ndarray, b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of A's ends lo..hi-1 of each interval, the one nearest to the middle that B shares (the left of two), and its place in B; -1 if it shares none."""
    middle = np.maximum((lo + hi - 1) // 2, lo)
    at = np.minimum(np.searchsorted(b, a[middle]), len(b) - 1)
    hit = (b[at] == a[middle]) & (hi > lo)
    found, place = np.where(hit, middle, -1), np.where(hit, at, -1)
    # most middles are shared; around the others the search widens
    pending, near, far = np.flatnonzero(~hit & (hi - lo > 1)), 1, 2
    while len(pending):
        l, h, m = lo[pending], hi[pending], middle[pending]
        left, of_left = _runs(np.maximum(l, m - far + 1), m - near + 1)
        right, of_right = _runs(m + near, np.minimum(h, m + far))
        end, of = np.concatenate([left, right]), np.concatenate([of_left, of_right])
        at = np.minimum(np.searchsorted(b, a[end]), len(b) - 1)
        shared = b[at] == a[end]
        end, of, at = end[shared], of[shared], at[shared]
        # the nearest of each interval, the left one first
        order = np.lexsort((end > m[of], np.abs(end - m[of]), of))
        heads = order[run_starts(of[order])]
        found[pending[of[heads]]], place[pending[of[heads]]] = end[heads], at[heads]
        pending = pending[(found[pending] < 0) & ((m - far >= l) | (m + far < h))]
        near, far = far, 2 * far
    return found, place


def shared_groups(a: np.ndarray, b: np.ndarray, a_first: np.ndarray, b_first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the groups of texts end, as places behind their last A and B token.

    `a` and `b` are the tokens' ends in rising order over all texts, `a_first` and `b_first`
    the places of each text's first tokens and the total. Texts end at the same byte in both.
    """
    some = np.flatnonzero(np.diff(a_first) > 0)
    lo, hi, b_lo, b_hi = a_first[some], a_first[some + 1], b_first[some], b_first[some + 1]
    ends_a, ends_b = [], []
    while len(lo):
        # the last end of an interval is shared anyway; only those before it split it
        split = (hi - lo > 1) & (b_hi - b_lo > 1)
        ends_a.append(hi[~split])
        ends_b.append(b_hi[~split])
        lo, hi, b_lo, b_hi = lo[split], hi[split], b_lo[split], b_hi[split]
        cut, other = _middle_cuts(a, b, lo, hi - 1)
        leaf = cut < 0
        ends_a.append(hi[leaf])
        ends_b.append(b_hi[leaf])
        lo, hi, b_lo, b_hi, cut, other = (x[~leaf] for x in (lo, hi, b_lo, b_hi, cut + 1, other + 1))
        # halves side by side, so that all intervals stay in order
        lo, hi, b_lo, b_hi = (np.stack(x, axis=1).ravel() for x in ((lo, cut), (cut, hi), (b_lo, other), (other, b_hi)))
    if not ends_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.sort(np.concatenate(ends_a)), np.sort(np.concatenate(ends_b))


def _flat(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    first = np.append(0, np.cumsum([len(x) for x in lists])).astype(np.int64)
    return np.fromiter(chain.from_iterable(lists), np.int64, first[-1]), first


ARRAYS = ("a_ids", "b_ids", "a_sizes", "b_sizes")


def _bytes_to_sizes(values: np.ndarray) -> np.ndarray:
    heads = np.append(0, np.flatnonzero(values < 255) + 1)[:-1]
    return np.add.reduceat(values, heads) if len(heads) else values


def _sizes_to_bytes(sizes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sizes as bytes: 255 as often as it fits, then the rest; and where each row begins."""
    count = sizes // 255 + 1
    ends = np.append(0, np.cumsum(count))
    out = np.full(ends[-1], 255, np.uint8)
    out[ends[1:] - 1] = sizes % 255
    return out, ends[first]


def _by_frequency(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The different ids, the most frequent first, and the high and low bytes of each id's place among them."""
    times = np.bincount(ids)
    known = np.argsort(-times, kind="stable")[: np.count_nonzero(times)]
    place = np.empty(len(times), np.int64)
    place[known] = np.arange(len(known))
    return known.astype(np.uint16), (place[ids] >> 8).astype(np.uint8), (place[ids] & 255).astype(np.uint8)


@dataclass
class Aligned:
    """Tokens and group sizes of texts, and where those of each text begin."""

    a: np.ndarray
    b: np.ndarray
    a_sizes: np.ndarray
    b_sizes: np.ndarray
    a_first: np.ndarray
    b_first: np.ndarray
    first: np.ndarray

    def packed(self) -> tuple[bytes, int]:
        """All of it in compressed bytes, and how many there were."""
        sizes = [_sizes_to_bytes(x, self.first)[0] for x in (self.a_sizes, self.b_sizes)]
        counts = [np.diff(x).astype(np.uint32) for x in (self.a_first, self.b_first, self.first)]
        ids = [x for side in (self.a, self.b) for x in _by_frequency(side)]
        parts = [np.array([len(x) for x in (counts[0], *ids, *sizes)], np.int64), *counts, *ids, *sizes]
        whole = b"".join(x.tobytes() for x in parts)
        return _CODEC.compress(whole, asbytes=True), len(whole)

    @classmethod
    def of(cls, cells: list[bytes], raw: list[int]) -> Aligned:
        """All texts of packed cells, one cell after the other."""
        columns: list[list[np.ndarray]] = [[] for _ in range(7)]
        for cell, size in zip(cells, raw, strict=True):
            data, at = _CODEC.decompress(cell, size, asbytes=True), 9 * 8
            n, *lengths = np.frombuffer(data, np.int64, 9).tolist()
            counts = np.frombuffer(data, np.uint32, 3 * n, at).astype(np.int64).reshape(3, n)
            at, parts = at + 12 * n, []
            for count, kind in zip(lengths, (np.uint16, np.uint8, np.uint8) * 2 + (np.uint8, np.uint8), strict=True):
                parts.append(np.frombuffer(data, kind, count, at).astype(np.int64))
                at += count * np.dtype(kind).itemsize
            own = [known[(high << 8) | low] for known, high, low in (parts[:3], parts[3:6])]
            for out, values in zip(columns, (*own, *map(_bytes_to_sizes, parts[6:]), *counts), strict=True):
                out.append(values)
        whole = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in columns]
        return cls(*whole[:4], *(np.append(0, np.cumsum(x)) for x in whole[4:]))

    def lists(self) -> list[pa.Array]:
        """The four as list columns."""
        columns = ((self.a, self.a_first), (self.b, self.b_first), (self.a_sizes, self.first), (self.b_sizes, self.first))
        return [pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, pa.int32())) for values, first in columns]


def _aligned_rows(sources):
    """A row for each document; the first of a piece of text has the tokens of them all."""

    def rows(batches):
        tokenizers = [_tokenizer(k, s) for k, s in zip((ByteBPE, PieceBPE), sources.value, strict=True)]
        tables = [_piece_table(k, s) for k, s in zip((ByteBPE, PieceBPE), sources.value, strict=True)]
        # slices of a task, each of so many bytes
        read, piece, task = 0, 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for at, n, data, offsets in text_slices(batch.column("__text"), PIECE_BYTES):
                whole = data.tobytes()
                raw = [whole[offsets[i] : offsets[i + 1]] for i in range(n)]
                texts = [r.decode() for r in raw]
                coded, same = [], [bool(r) for r in raw]
                for t, table in zip(tokenizers, tables, strict=True):
                    ids, first = _flat(t.encode(texts))
                    spelled, at_byte = _joined(table, ids)
                    cuts = at_byte[first].tolist()
                    same = [s and spelled[x:y] == b" " + r for s, x, y, r in zip(same, cuts[:-1], cuts[1:], raw, strict=True)]
                    coded.append((ids, first, np.diff(at_byte)))
                sides = []
                for ids, first, sizes in coded:
                    counts = np.where(same, np.diff(first), 0)
                    stays = np.repeat(same, np.diff(first))
                    sides.append((ids[stays], np.append(0, np.cumsum(counts)), np.cumsum(sizes[stays])))
                (a, a_first, a_ends), (b, b_first, b_ends) = sides
                a_end, b_end = shared_groups(a_ends, b_ends, a_first, b_first)
                first = np.append(0, np.searchsorted(a_end, a_first[1:], side="right"))
                cell, size = Aligned(a, b, np.diff(np.append(0, a_end)), np.diff(np.append(0, b_end)), a_first, b_first, first).packed()
                columns = [np.full(n, task + read // SLICE_BYTES), np.full(n, piece), np.arange(n), np.where(np.arange(n) > 0, 0, size)]
                yield pa.RecordBatch.from_arrays([batch.column("__row").slice(at, n), *map(pa.array, columns), pa.array([cell] + [None] * (n - 1), pa.binary())], ["__row", "slice", "piece", "place", "size", "tokens"])
                read, piece = read + len(data), piece + 1

    return rows


def _align(docs: DataFrame, sources, text_col: str, keep_text: bool) -> DataFrame:
    """(__row, slice, piece, place, size, tokens) of documents; `__row` holds all other columns, the text only with `keep_text`."""
    kept = [F.col(f"`{c}`") for c in docs.columns if keep_text or c != text_col]
    rows = docs.select(F.struct(F.lit(0).alias("__none"), *kept).alias("__row"), F.col(f"`{text_col}`").alias("__text"))
    shape = rows.schema["__row"].dataType.simpleString()
    return rows.mapInArrow(_aligned_rows(sources), f"__row {shape}, slice long, piece long, place long, size long, tokens binary")


def _links(t: Aligned) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (A id << 16 | B id), their rows and how many links each stands for, `PAIRS` or so at a time.

    Equal ids of a group are taken together; the same pair may come again from another group of a row.
    """
    groups = len(t.a_sizes)
    row = np.repeat(np.arange(len(t.first) - 1), np.diff(t.first))
    # most groups are one token of each
    single = (t.a_sizes == 1) & (t.b_sizes == 1)
    a_at, b_at = np.cumsum(t.a_sizes) - t.a_sizes, np.cumsum(t.b_sizes) - t.b_sizes
    if single.any():
        yield (t.a[a_at[single]] << 16) | t.b[b_at[single]], row[single], np.ones(np.count_nonzero(single), np.int64)
    sides = []
    for ids, sizes in ((t.a, t.a_sizes), (t.b, t.b_sizes)):
        own = ~np.repeat(single, sizes)
        keys, times = np.unique((np.repeat(np.arange(groups), sizes)[own] << 16) | ids[own], return_counts=True)
        sides.append((keys & 0xFFFF, times, np.searchsorted(keys >> 16, np.arange(groups + 1))))
    (a, a_times, a_at), (b, b_times, b_at) = sides
    # each different A token of a group meets the B tokens of the group
    group = np.repeat(np.arange(groups), np.diff(a_at))
    load = np.append(0, np.cumsum(np.diff(b_at)[group]))
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(load, load[at] + PAIRS, side="right")) - 1)
        g = group[at:to]
        place, of = _runs(b_at[g], b_at[g + 1])
        of += at
        yield (a[of] << 16) | b[place], row[group[of]], a_times[of] * b_times[place]
        at = to


def _pair_rows(batches):
    """A row for each pair of ids that a slice's documents link, with the number of these documents."""
    for batch in batches:
        slices, cells, raw = batch.column("slice").to_numpy(), batch.column("tokens"), batch.column("size").to_pylist()
        edges = np.append(run_starts(slices), len(slices))
        for x, y in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            # a pair and a row of the slice are one number of 64 bits
            held = np.zeros(0, np.uint64)
            for pairs, rows, _ in _links(Aligned.of(cells.slice(x, y - x).to_pylist(), raw[x:y])):
                held = np.unique(np.append(held, (pairs.astype(np.uint64) << np.uint64(32)) | rows.astype(np.uint64)))
            pairs, times = np.unique((held >> np.uint64(32)).astype(np.int64), return_counts=True)
            if len(pairs):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(pairs), slices[x])), pa.array(pairs), pa.array(times)], ["slice", "pair", "n"])


def pair_counts(asked: DataFrame) -> DataFrame:
    """(pair, count, best) of asked pairs (pair, n): documents that link the two ids, and whether no other partner of the A id has more."""
    counts = asked.groupBy("pair").agg(F.sum("n").alias("count"))
    # an A id has no more partners than B's vocabulary
    highest = F.max("count").over(Window.partitionBy(F.shiftright("pair", 16)))
    return counts.withColumn("best", F.col("count") == highest)


@lru_cache(1)
def _decimals(a: int, b: int) -> pa.Array:
    """Ids of A, then of B, in decimal, each with what may follow it: comma, bar, semicolon, nothing."""
    return pa.array([f"{i}{s}" for size in (a, b) for i in range(size) for s in (",", "|", ";", "")], pa.large_string())


def group_texts(t: Aligned, a_size: int, b_size: int) -> pa.Array:
    """The groups of each text as `a1,a2|b1;a3|b2,b3`, ids in decimal; empty without tokens."""
    # A's tokens of a group, then B's: a comma behind each, but a bar behind A's last and a semicolon behind B's
    place_a = np.arange(len(t.a)) + np.repeat(np.cumsum(t.b_sizes) - t.b_sizes, t.a_sizes)
    place_b = np.arange(len(t.b)) + np.repeat(np.cumsum(t.a_sizes), t.b_sizes)
    code = np.empty(len(t.a) + len(t.b), np.int64)
    code[place_a], code[place_b] = 4 * t.a, 4 * (t.b + a_size)
    ends = np.cumsum(t.a_sizes + t.b_sizes)
    code[ends - t.b_sizes - 1] += 1
    code[ends - 1] += 2
    edges = np.append(0, ends)[t.first]
    code[edges[1:][np.diff(edges) > 0] - 1] += 1
    whole, at = _joined(_decimals(a_size, b_size), code)
    return pa.Array.from_buffers(pa.large_string(), len(edges) - 1, [None, pa.py_buffer(np.ascontiguousarray(at[edges])), pa.py_buffer(whole)]).cast(pa.string())


def _score(sources, lists: bool, texts: bool):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        pairs = right.column("pair").to_numpy()
        order = np.argsort(pairs, kind="stable")
        pairs, count, best = pairs[order], right.column("count").to_numpy()[order], right.column("best").to_numpy()[order]
        left = left.take(pa.array(np.lexsort((left.column("place").to_numpy(), left.column("piece").to_numpy()))))
        packed = left.filter(pc.is_valid(left.column("tokens")))
        tokens = Aligned.of(packed.column("tokens").to_pylist(), packed.column("size").to_pylist())
        n_links, n_best, count_sum = (np.zeros(len(left), np.int64) for _ in range(3))
        for p, row, times in _links(tokens):
            at = np.searchsorted(pairs, p)
            for out, weight in ((n_links, times), (n_best, times * best[at]), (count_sum, times * count[at])):
                # whole numbers below 2^53
                out += np.bincount(row, weight, len(left)).astype(np.int64)
        out = {"__row": left.column("__row")}
        out |= {name: pa.array(np.diff(first)) for name, first in (("n_a", tokens.a_first), ("n_b", tokens.b_first), ("n_groups", tokens.first))}
        out |= {name: pa.array(values) for name, values in (("n_links", n_links), ("n_best", n_best), ("count_sum", count_sum))}
        if lists:
            out |= dict(zip(ARRAYS, tokens.lists(), strict=True))
        if texts:
            width = [len(_tokenizer(k, s).pieces) for k, s in zip((ByteBPE, PieceBPE), sources.value, strict=True)]
            out["groups"] = group_texts(tokens, *width)
        return pa.table(out)

    return score


def align_tokens(docs: DataFrame, sources, text_col: str = "text", keep_text: bool = True, lists: bool = True, texts: bool = False) -> DataFrame:
    """Documents with their aligned tokens and how usual their links are.

    `sources` are tokenizer_files(). Every column of `docs` (the text only with `keep_text`),
    then n_a, n_b and n_groups; n_links (pairs of an A and a B token of one group), n_best
    (those whose ids are linked in as many documents as the A id with any B id) and count_sum
    (over all links, the documents that link their ids). With `lists` also a_ids and b_ids,
    the tokens in order, and a_sizes and b_sizes, how many of them each group has; with
    `texts` the groups as one text, see group_texts(). Each row is a document. Texts that are
    null or empty, or whose tokens of either kind do not spell a space and the text, have no
    tokens: zeros, empty lists and an empty text. Input columns of these names are replaced.
    Vocabularies have at most 65,536 ids.
    """
    new = {c: "long" for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")}
    new |= {c: "array<int>" for c in ARRAYS if lists} | ({"groups": "string"} if texts else {})
    aligned = written(_align(docs, sources, text_col, keep_text), "aligned-tokens")
    asked = written(aligned.where("tokens is not null").select("slice", "size", "tokens").mapInArrow(_pair_rows, "slice long, pair long, n long"), "linked-pairs")
    # a slice that is read in two parts asks twice, and gets the same answer
    answers = asked.select("slice", "pair").join(pair_counts(asked), "pair")
    shape = f"__row {aligned.schema['__row'].dataType.simpleString()}, {', '.join(f'{c} {t}' for c, t in new.items())}"
    scored = aligned.groupBy("slice").cogroup(answers.groupBy("slice")).applyInArrow(_score(sources, lists, texts), shape)
    kept = [c for c in docs.columns if c not in new and (keep_text or c != text_col)]
    return scored.select(*[F.col(f"__row.`{c}`") for c in kept], *new)
