"""Line dedup with two Bloom filters: lines that many documents hold are found without shuffling the others.

1. Every task adds the hashes of its documents' lines to two sets of filter positions:
   keys seen once and keys seen twice in its slice of input. The parts of a filter
   segment meet in one group, where a position that a second part has seen once moves
   from the once-seen filter to the twice-seen one. No key that stands in two documents
   is missing there; some others have both their positions set by chance.
2. The twice-seen filter goes to all tasks. Only lines that it suspects are shuffled, as
   SHA-256 digests with counts (and the first document, where it is to keep its line),
   which tells exactly in how many documents each stands.
3. Lines whose count is reached drop out. Few such keys are broadcast to the documents,
   more of them are joined to the digests of each document's suspected lines.

A segment of the filter is folded as far as `DENSITY` lets it, so the filter grows with
the repeated keys, up to `SEGMENTS` times `SEGMENT_BITS` bits (128 MiB). Beyond that it
suspects ever more lines that are unique; they are counted and stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

from .blobs import binary_cells, run_starts
from .tokens import LOWER, NOT_SPACE, Words, text_slices

LEAST_DOCUMENTS, LEAST_CHARS = 10, 1
SEGMENTS, SEGMENT_BITS = 1 << 10, 1 << 20
#: Set bits of a segment of the twice-seen filter at most, where it can be larger.
DENSITY = 1 / 32
#: Hashes of lines that a task holds before it sends its positions.
HELD = 1 << 20
#: Repeated keys that are broadcast at most (about 150 bytes each in a worker).
BROADCAST_KEYS = 250_000


@dataclass
class Lines:
    """Lines of the texts of a slice, in order: their bytes, the bounds of their keys in the lower-cased bytes, and their text's number."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    key_start: np.ndarray
    key_end: np.ndarray
    owner: np.ndarray
    counts: np.ndarray
    judged: np.ndarray


def split_lines(data: np.ndarray, offsets: np.ndarray, least_chars: int = LEAST_CHARS) -> Lines:
    """Lines of a slice at each new line; keys lack white space at both ends and A-Z, and are judged from `least_chars` code points on."""
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    end = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    counts = np.diff(np.searchsorted(breaks, offsets)) + 1
    filled = np.flatnonzero(NOT_SPACE[data])
    first, last = np.searchsorted(filled, start), np.searchsorted(filled, end)
    some = last > first
    filled = np.append(filled, 0)
    key_start, key_end = np.where(some, filled[first], start), np.where(some, filled[last - 1] + 1, start)
    # code points begin at bytes that continue none
    begins = np.append(0, np.cumsum((data & 0xC0) != 0x80))
    judged = begins[key_end] - begins[key_start] >= max(1, least_chars)
    return Lines(data, start, end, LOWER[data], key_start, key_end, np.repeat(np.arange(len(counts)), counts), counts, judged)


def _hashes(lines: Lines, which: np.ndarray) -> np.ndarray:
    return Words(lines.low, lines.key_start[which], lines.key_end[which], np.zeros(1, np.int64)).hashes()


def _once_a_text(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Where the first of each pair of text and value stands."""
    order = np.lexsort((value, owner))
    return order[run_starts(owner[order], value[order])]


def _positions(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Segments and positions in them of the two bits of each hash."""
    half = np.concatenate([h & np.uint64(0xFFFFFFFF), h >> np.uint64(32)])
    return (half % np.uint64(SEGMENTS)).astype(np.int64), (half // np.uint64(SEGMENTS) % np.uint64(SEGMENT_BITS)).astype(np.uint32)


def _part(held: list[np.ndarray]) -> pa.RecordBatch:
    keys, times = np.unique(np.concatenate(held), return_counts=True)
    columns = []
    for h in (keys, keys[times > 1]):
        segment, place = _positions(h)
        order = np.argsort(segment, kind="stable")
        columns.append(binary_cells(place[order], np.searchsorted(segment[order], np.arange(SEGMENTS + 1))))
    return pa.RecordBatch.from_arrays([pa.array(np.arange(SEGMENTS)), *columns], ["segment", "once", "twice"])


def _filter_parts(least_chars: int):
    def rows(batches):
        held, size = [], 0
        for batch in batches:
            for _, _, data, offsets in text_slices(batch.column("__text")):
                lines = split_lines(data, offsets, least_chars)
                which = np.flatnonzero(lines.judged)
                h = _hashes(lines, which)
                held.append(h[_once_a_text(lines.owner[which], h)])
                size += len(held[-1])
                if size >= HELD:
                    yield _part(held)
                    held, size = [], 0
        if size:
            yield _part(held)

    return rows


def _merged_segment(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Both filters of a segment, part by part; the twice-seen one folded to the smallest size that is sparse enough."""
    once, twice = np.zeros(SEGMENT_BITS, bool), np.zeros(SEGMENT_BITS, bool)
    for batch in batches:
        for a, b in zip(batch.column("once").to_pylist(), batch.column("twice").to_pylist(), strict=True):
            seen = np.frombuffer(a, np.uint32)
            twice[seen[once[seen]]] = True
            once[seen] = True
            twice[np.frombuffer(b, np.uint32)] = True
    while len(twice) > 64:
        half = twice.reshape(2, -1).any(axis=0)
        if half.mean() > DENSITY:
            break
        twice = half
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()]), pa.array([np.packbits(twice).tobytes()])], ["segment", "bits"])


@dataclass
class TwiceSeen:
    """The twice-seen filter: packed bits, where each segment's begin, and its size less one (-1: empty)."""

    bits: np.ndarray
    starts: np.ndarray
    masks: np.ndarray

    @classmethod
    def of(cls, rows: pa.Table) -> TwiceSeen:
        """The filter from rows (segment, bits)."""
        starts, masks, cells, at = np.zeros(SEGMENTS, np.int64), np.full(SEGMENTS, -1, np.int64), [], 0
        for segment, cell in zip(rows["segment"].to_pylist(), rows["bits"].to_pylist(), strict=True):
            starts[segment], masks[segment] = at, 8 * len(cell) - 1
            cells.append(cell)
            at += 8 * len(cell)
        return cls(np.frombuffer(b"".join(cells) or b"\0", np.uint8), starts, masks)

    def suspects(self, h: np.ndarray) -> np.ndarray:
        """Which hashes have both bits set."""
        segment, place = _positions(h)
        mask = self.masks[segment]
        bit = self.starts[segment] + (place & np.maximum(mask, 0))
        on = (mask >= 0) & ((self.bits[bit >> 3] >> (7 - (bit & 7)).astype(np.uint8)) & 1).astype(bool)
        return on[: len(h)] & on[len(h) :]


def _digests(lines: Lines, which: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """SHA-256 of the different keys among some lines, and which of them each line has."""
    size = lines.key_end[which] - lines.key_start[which]
    ends = np.append(0, np.cumsum(size))
    data = lines.low[np.repeat(lines.key_start[which] - ends[:-1], size) + np.arange(ends[-1])]
    keys = pa.Array.from_buffers(pa.large_binary(), len(which), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
    return [hashlib.sha256(k).digest() for k in keys.dictionary.to_pylist()], keys.indices.to_numpy().astype(np.int64)


def _suspected(lines: Lines, seen: TwiceSeen) -> np.ndarray:
    which = np.flatnonzero(lines.judged)
    return which[seen.suspects(_hashes(lines, which))]


def _suspect_rows(seen, least_chars: int, every: bool):
    """A row for each suspected key of a slice, with the number of its documents and the first of them, or with `every` one for each document."""

    def rows(batches):
        for batch in batches:
            place = np.empty(len(batch), np.int64)
            place[pc.sort_indices(pa.Table.from_batches([batch.select(["__id", "__key"])]), sort_keys=[("__id", "ascending"), ("__key", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(batch))
            for at, _, data, offsets in text_slices(batch.column("__text")):
                lines = split_lines(data, offsets, least_chars)
                which = _suspected(lines, seen.value)
                if not len(which):
                    continue
                digests, code = _digests(lines, which)
                owner = lines.owner[which] + at
                one = _once_a_text(owner, code)
                owner, code = owner[one], code[one]
                order = np.lexsort((place[owner], code))
                times = np.ones(len(code), np.int64)
                if not every:
                    heads = run_starts(code[order])
                    times = np.diff(np.append(heads, len(order)))
                    order = order[heads]
                row = pa.array(owner[order])
                yield pa.RecordBatch.from_arrays([pa.array([digests[c] for c in code[order]], pa.binary()), pa.array(times), batch.column("__id").take(row), batch.column("__key").take(row)], ["digest", "n", "id", "key"])

    return rows


def _kept_rows(seen, least_chars: int, sent, first: bool):
    """Documents without the lines of repeated keys, which are broadcast or stand in the row."""

    def rows(batches):
        for batch in batches:
            own = batch.column("__repeated").to_pylist() if sent is None else None
            names = list(zip(batch.column("__id").to_pylist(), batch.column("__key").to_pylist(), strict=True)) if first and sent is not None else None
            n_lines, n_dropped, kept = [], [], []
            for at, n, data, offsets in text_slices(batch.column("__text")):
                lines = split_lines(data, offsets, least_chars)
                drop = np.zeros(len(lines.start), bool)
                which = _suspected(lines, seen.value)
                if len(which):
                    digests, code = _digests(lines, which)
                    known = None if own is None else [{r["digest"]: r["first"] for r in x or ()} for x in own[at : at + n]]
                    held = set()
                    for line, text, c in zip(which.tolist(), lines.owner[which].tolist(), code.tolist(), strict=True):
                        # the first document of a repeated key, or whether this is it
                        found = sent.value.get(digests[c]) if known is None else known[text].get(digests[c])
                        if found is None:
                            continue
                        stays = first and (found == names[at + text] if known is None else found) and (text, c) not in held
                        held.add((text, c))
                        drop[line] = not stays
                whole = data.tobytes()
                dropped = np.bincount(lines.owner[drop], minlength=n)
                edges = np.append(0, np.cumsum(lines.counts))
                for i in range(n):
                    text = whole[offsets[i] : offsets[i + 1]]
                    if dropped[i]:
                        x, y = edges[i], edges[i + 1]
                        text = b"\n".join(whole[s:e] for s, e, d in zip(lines.start[x:y].tolist(), lines.end[x:y].tolist(), drop[x:y].tolist(), strict=True) if not d)
                    kept.append(text)
                n_lines.append(lines.counts)
                n_dropped.append(dropped)
            columns = [batch.column("__row"), batch.column("__text")]
            columns += [pa.array(np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)) for x in (n_lines, n_dropped)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(kept, pa.binary()).cast(pa.string())], ["__row", "__text", "n_lines", "n_dropped", "kept_text"])

    return rows


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    least_chars: int = LEAST_CHARS,
    keep_first: bool = False,
    broadcast_keys: int = BROADCAST_KEYS,
) -> DataFrame:
    r"""Documents without the lines whose key stands in at least `least_documents` of them (two or more).

    Every column of `docs`, then n_lines, n_dropped and kept_text (kept lines, one \n
    between). Lines end at \n; a null or empty text is one empty line. A line's key lacks
    white space (`[\x20\x09-\x0D]`) at both ends and has A-Z lower-cased; keys of fewer
    than `least_chars` code points (one or more) stay. With `keep_first` the first line of
    a key stays in the document of the smallest id (null before all, then by hash of the
    text). Each row is a document, those of a repeated id too; rows equal in id and text
    both keep a first line. Input columns of the three names are replaced.
    """
    if least_documents < 2:
        raise ValueError("lines of single documents are no repeats")
    new = ("n_lines", "n_dropped", "kept_text")
    rows = docs.select(
        F.col(f"`{id_col}`").alias("__id"),
        F.col(f"`{text_col}`").alias("__text"),
        F.xxhash64(F.col(f"`{text_col}`")).alias("__key"),
        F.struct(F.lit(0).alias("__none"), *[F.col(f"`{c}`") for c in docs.columns if c not in (*new, text_col)]).alias("__row"),
    )
    context = docs.sparkSession.sparkContext
    parts = rows.select("__text").mapInArrow(_filter_parts(least_chars), "segment long, once binary, twice binary")
    # of bounded size: SEGMENTS rows of SEGMENT_BITS bits
    seen = context.broadcast(TwiceSeen.of(parts.groupBy("segment").applyInArrow(_merged_segment, "segment long, bits binary").toArrow()))

    id_type = rows.schema["__id"].dataType.simpleString()
    judged = rows.select("__id", "__key", "__text")
    suspects = judged.mapInArrow(_suspect_rows(seen, least_chars, False), f"digest binary, n long, id {id_type}, key long")
    first = [F.min(F.struct("id", "key")).alias("first")] if keep_first else []
    repeated = cut(suspects.groupBy("digest").agg(F.sum("n").alias("n"), *first).where(F.col("n") >= least_documents).drop("n"))
    row_type = rows.schema["__row"].dataType.simpleString()
    schema = f"__row {row_type}, __text string, n_lines long, n_dropped long, kept_text string"
    if repeated.count() <= broadcast_keys:
        table = repeated.toArrow()
        firsts = [(r["id"], r["key"]) for r in table["first"].to_pylist()] if keep_first else [True] * len(table)
        sent = context.broadcast(dict(zip(table["digest"].to_pylist(), firsts, strict=True)))
        out = rows.mapInArrow(_kept_rows(seen, least_chars, sent, keep_first), schema)
    else:
        each = judged.mapInArrow(_suspect_rows(seen, least_chars, True), f"digest binary, n long, id {id_type}, key long").select("digest", "id", "key")
        is_first = F.col("first.id").eqNullSafe(F.col("id")) & (F.col("first.key") == F.col("key")) if keep_first else F.lit(False)
        each = each.distinct().join(repeated, "digest").select("id", "key", F.struct("digest", is_first.alias("first")).alias("repeated"))
        own = each.groupBy("id", "key").agg(F.collect_list("repeated").alias("__repeated"))
        out = rows.join(own, F.col("__id").eqNullSafe(F.col("id")) & (F.col("__key") == F.col("key")), "left").drop("id", "key")
        out = out.mapInArrow(_kept_rows(seen, least_chars, None, keep_first), schema)
    return out.select(*[F.col("__text").alias(c) if c == text_col else F.col(f"__row.`{c}`") for c in docs.columns if c not in new], *new)
