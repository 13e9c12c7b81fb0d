"""SimHash near-dedup with pivot distance tables.

Equal fingerprints are one node. Fingerprints that differ in at most two bits
agree in two of their four 16-bit quarters, so those that share such a pair of
quarters (and no others) are compared. Each comparison block first computes the
table of Hamming distances from its fingerprints to `PIVOTS` reference
fingerprints; a pair whose distances to some reference differ by more than the
radius cannot be close (triangle inequality) and is discarded, survivors are
verified bit by bit. A block returns a spanning star of each linked group instead
of all its links, and components() joins the stars.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomdex.shared import cut

from .blobs import run_starts
from .graph import components
from .tokens import LOWER, mix, owners, rolling, split_words, text_slices

SHINGLE = 3
RADIUS = 2
PIVOTS = 16
#: Fingerprint rows that one comparison block holds on average.
BLOCK_ROWS = 100_000
#: Rows of one key that are compared with each other in one task at most.
HOT_ROWS = 4096
#: Pairs compared at once.
CHUNK_PAIRS = 1 << 20

_BITS = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
_BYTE = np.arange(8) * 256
_REFERENCES = mix(np.arange(1, PIVOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_LOWER = LOWER.tobytes()


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles of a text, repeats included."""
    words = (text or "").encode().translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - shingle + 1]
    parts = [joined[a:b] for a, b in zip(starts.tolist(), ends[shingle - 1 :].tolist(), strict=True)]
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, len(parts))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is set if it is set in over half the hashes."""
    if not len(hashes):
        return 0
    counts = np.bincount((hashes.view(np.uint8).reshape(-1, 8) + _BYTE).ravel(), minlength=2048).reshape(8, 256)
    ones = (counts @ _BITS).ravel() * 2 > len(hashes)
    return int(np.packbits(ones, bitorder="little").view(np.uint64)[0])


def _fingerprint_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            prints = [fingerprint(shingle_hashes(t, shingle)) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.array(prints, np.uint64).view(np.int64))], ["id", "print"])

    return rows


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(id, print): the 64-bit fingerprint of each row's whole text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(_fingerprint_rows(shingle), "id long, print long")


def _chunks(sizes: np.ndarray, starts: np.ndarray):
    """Yield index pairs (i, j) inside runs of a sorted table, CHUNK_PAIRS or so at a time."""
    # row number within its run tells how many earlier rows it is compared with
    place = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    row = np.repeat(starts, sizes) + place
    total = np.append(0, np.cumsum(place))
    at = 0
    while at < len(place):
        to = max(at + 1, int(np.searchsorted(total, total[at] + CHUNK_PAIRS, side="right")) - 1)
        n = place[at:to]
        right = np.repeat(row[at:to], n)
        left = right - np.repeat(n, n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        yield left, right
        at = to


def close_pairs(prints: np.ndarray, keys: np.ndarray, radius: int):
    """Yield (order, left, right, distance) of rows with equal keys and prints at most `radius` bits apart."""
    order = np.argsort(keys, kind="stable")
    keys, prints = keys[order], prints[order]
    heads = run_starts(keys)
    sizes = np.diff(np.append(heads, len(keys)))
    several = sizes > 1
    table = [np.bitwise_count(prints ^ p).astype(np.int16) for p in _REFERENCES]
    for left, right in _chunks(sizes[several], heads[several]):
        for column in table:
            near = np.abs(column[left] - column[right]) <= radius
            left, right = left[near], right[near]
        distance = np.bitwise_count(prints[left] ^ prints[right])
        near = distance <= radius
        yield order, left[near], right[near], distance[near]


def _stars(radius: int):
    def stars(table: pa.Table) -> pa.Table:
        nodes, prints = table["node"].to_numpy(), table["print"].to_numpy().view(np.uint64)
        found = [(order[left], order[right]) for order, left, right, _ in close_pairs(prints, table["key"].to_numpy(), radius)]
        left, right = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
        left, right = nodes[left], nodes[right]
        names, index = np.unique(np.concatenate([left, right]), return_inverse=True)
        left, right = index[: len(left)], index[len(left) :]
        label = np.arange(len(names))
        while True:
            old = label.copy()
            np.minimum.at(label, left, old[right])
            np.minimum.at(label, right, old[left])
            label = label[label]
            if (label == old).all():
                break
        other = np.flatnonzero(label != np.arange(len(names)))
        return pa.table({"a": names[other], "b": names[label[other]]})

    return stars


def _quarter_keys(column):
    """Six keys, a pair of quarters and the bits in them, each with the 32 bits of the two other quarters."""
    quarter = [F.shiftrightunsigned(column, 16 * q).bitwiseAND(F.lit(0xFFFF)) for q in range(4)]
    joined = lambda i, j: F.shiftleft(quarter[i], 16) + quarter[j]
    pairs = list(combinations(range(4), 2))
    rest = [tuple(q for q in range(4) if q not in pair) for pair in pairs]
    return F.array(*[F.struct((F.lit(n << 32).cast("long") + joined(*pair)).alias("key"), joined(*other).alias("rest")) for n, (pair, other) in enumerate(zip(pairs, rest, strict=True))])


def _large_keys(rows: DataFrame) -> DataFrame | None:
    """(key, blocks) of the keys that more than HOT_ROWS rows have; None if there are none."""
    large = cut(rows.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT_ROWS).select("key", F.ceil(F.col("n") / HOT_ROWS).alias("blocks")))
    n = large.count()
    return None if not n else F.broadcast(large) if n <= BROADCAST_IDS else large


def _comparable(rows: DataFrame) -> DataFrame:
    """(node, print, key) of rows (node, print, key, rest): rows that are two bits apart at most still share a key, and no key has very many rows.

    Rows of a large key agree in half of the bits. Of three parts of the other half one
    is equal in close rows, so the key becomes three finer ones. If one of these is still
    large, its rows are dealt into blocks, and each block meets every other under a key of
    the two.
    """
    large = _large_keys(rows)
    if large is None:
        return rows.select("node", "print", "key")
    parts = F.array(*[F.shiftrightunsigned("rest", shift).bitwiseAND(F.lit((1 << width) - 1)) for shift, width in ((0, 11), (11, 11), (22, 10))])
    marked = rows.join(large, "key", "left")
    finer = F.transform(parts, lambda part, n: F.xxhash64("key", n, part))
    fine = marked.where("blocks is not null").select("node", "print", F.explode(finer).alias("key"))
    kept = marked.where("blocks is null").select("node", "print", "key")
    still = _large_keys(fine)
    if still is not None:
        dealt = fine.join(still, "key", "left").withColumn("block", F.coalesce(F.pmod(F.xxhash64("node"), F.col("blocks")), F.lit(0).cast("long")))
        others = F.filter(F.sequence(F.lit(0).cast("long"), F.coalesce("blocks", F.lit(1).cast("long")) - 1), lambda x: (x != F.col("block")) | F.col("blocks").isNull())
        dealt = dealt.withColumn("other", F.explode(others))
        pair = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")))
        fine = dealt.select("node", "print", pair.alias("key"))
    return kept.union(fine)


def link(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(node, component) of rows (node, print) with distinct prints, for those that have a link; `radius` is at most 2."""
    if radius > 2:
        raise ValueError("two of four quarters agree only up to a radius of 2")
    rows = _comparable(prints.select("node", "print", F.inline(_quarter_keys(F.col("print")))))
    blocks = max(1, -(-6 * prints.count() // BLOCK_ROWS))
    stars = rows.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks))).applyInArrow(_stars(radius), "a long, b long")
    return components(stars)


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, print, component) of every row: its fingerprint and the smallest id that links reach.

    Null and empty texts have fingerprint zero and link like any other. Repeated ids
    are one node. Rows with a null id have a fingerprint; only those equal to another
    row's or linked to one have a component.
    """
    prints = cut(fingerprints(docs, id_col, text_col, shingle))
    classes = cut(prints.groupBy("print").agg(F.min("id").alias("node")))
    linked = link(classes.where("node is not null"), radius)
    named = classes.join(linked, "node", "left").select("print", F.coalesce("component", "node").alias("component"))
    return prints.join(named, "print")


# ---- dedup by similarity: the form of the operator that keeps one document of each group ----

DEDUP_SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 24, 4
#: A bucket of more documents or shingles is dealt into blocks, and each pair of blocks is compared in one task.
BLOCK_DOCS, BLOCK_SHINGLES = 512, 500_000
#: Documents and shingles that a comparing task holds on average.
TASK_DOCS, TASK_SHINGLES = 256, 200_000
#: Ids of this many documents are broadcast to the scan of the texts; more are joined by shuffle.
BROADCAST_IDS = 200_000

_SEEDS = mix(np.arange(1, 2 * BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))
_FACTORS, _ADDENDS = _SEEDS[::2] | np.uint64(1), _SEEDS[1::2]


def _shingles(words, hashes, shingle: int):
    """Shingle hashes of a slice and the text of each; a shorter text has one, of all its words, an empty text none."""
    full = rolling(hashes, shingle)
    owner = owners(words)
    inside = np.flatnonzero(owner[: len(full)] == owner[shingle - 1 :]) if len(full) else np.zeros(0, np.int64)
    h, own = full[inside], owner[inside]
    short = np.flatnonzero((words.counts > 0) & (words.counts < shingle))
    if len(short):
        extra = np.array([rolling(hashes[words.first[i] : words.first[i + 1]], int(words.counts[i]))[0] for i in short.tolist()], np.uint64)
        h, own = np.append(h, extra), np.append(own, short)
        order = np.argsort(own, kind="stable")
        h, own = h[order], own[order]
    return mix(h), own


def _sketch_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column("id")
            for at, n, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, table=LOWER)
                hashes = words.hashes()
                h, own = _shingles(words, hashes, shingle)
                heads = run_starts(own)
                filled = own[heads]
                bands, content = np.zeros((n, BANDS), np.uint64), np.zeros((n, 2), np.uint64)
                counts = np.bincount(own, minlength=n)
                if len(h):
                    with np.errstate(over="ignore"):
                        for k in range(BANDS * BAND_ROWS):
                            least = np.minimum.reduceat(h * _FACTORS[k] + _ADDENDS[k], heads)
                            bands[filled, k // BAND_ROWS] = mix(bands[filled, k // BAND_ROWS] ^ least)
                        # the word sequence: two sums over words and places
                        place = (np.arange(len(hashes)) - np.repeat(words.first[:-1], words.counts)).astype(np.uint64)
                        some = np.flatnonzero(words.counts)
                        for c in range(2):
                            content[some, c] = np.add.reduceat(mix(hashes + mix(place * np.uint64(2) + np.uint64(c))), words.first[some])
                flat = pa.array(bands.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (n + 1) * BANDS, BANDS), pa.int32()), flat)
                empty = pa.array((words.counts == 0))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(at, n), pa.array(content[:, 0].view(np.int64)), pa.array(content[:, 1].view(np.int64)), pa.array(counts), lists, empty], ["id", "c0", "c1", "size", "bands", "empty"]
                )

    return rows


def _set_rows(shingle: int):
    def rows(batches):
        for batch in batches:
            ids = batch.column("id")
            for at, n, data, offsets in text_slices(batch.column("text")):
                words = split_words(data, offsets, table=LOWER)
                h, own = _shingles(words, words.hashes(), shingle)
                cuts = np.searchsorted(own, np.arange(n + 1))
                sets = [np.unique(h[cuts[i] : cuts[i + 1]]).tobytes() for i in range(n)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, n), pa.array(sets, pa.binary())], ["id", "shingles"])

    return rows


def _linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first set that similar pairs link each set to, by breadth-first search.

    A set is compared with all those that no search has reached, at once: no pairs
    are listed, and sets of one group are not compared again.
    """
    size = np.fromiter(map(len, sets), np.int64, len(sets))
    values, place = np.unique(np.concatenate(sets), return_inverse=True)
    cuts = np.append(0, np.cumsum(size))
    label, new, mark = np.arange(len(sets)), np.ones(len(sets), bool), np.zeros(len(values), bool)
    rest, inside, starts = label.copy(), place, cuts[:-1]
    for first in range(len(sets)):
        if not new[first]:
            continue
        new[first] = False
        queue = [first]
        while queue:
            i = queue.pop()
            keep = new[rest]
            if 2 * keep.sum() <= len(rest):
                inside, rest = inside[np.repeat(keep, size[rest])], rest[keep]
                starts = np.append(0, np.cumsum(size[rest]))[:-1]
            if not len(rest):
                return label
            own = place[cuts[i] : cuts[i + 1]]
            mark[own] = True
            common = np.add.reduceat(mark[inside], starts, dtype=np.int64)
            mark[own] = False
            similar = common >= similarity * (size[rest] + len(own) - common) - 1e-9
            found = rest[similar & new[rest]]
            label[found] = first
            new[found] = False
            queue.extend(found.tolist())
    return label


def _linked_rows(similarity: float):
    def stars(table: pa.Table) -> pa.Table:
        nodes, keys, i, j = (table[c].to_numpy() for c in ("node", "key", "i", "j"))
        sets = table["shingles"].combine_chunks()
        order = np.lexsort((nodes, j, i, keys))
        heads = run_starts(keys[order], i[order], j[order])
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for rows in np.split(order, heads[1:]):
            label = _linked([np.frombuffer(sets[int(r)].as_buffer(), np.uint64) for r in rows], similarity)
            other = np.flatnonzero(label != np.arange(len(rows)))
            a.append(nodes[rows[other]])
            b.append(nodes[rows[label[other]]])
        return pa.table({"a": np.concatenate(a), "b": np.concatenate(b)})

    return stars


def _comparisons(rows: DataFrame) -> DataFrame:
    """(node, size, key, i, j): who meets in which comparison, of rows (node, size, key); all that share a key meet.

    Keys of the same documents are one. The documents of a large key are dealt into
    blocks by hash, and each meets every other block.
    """
    members = rows.groupBy("key").agg(F.count("*").alias("n"), F.sum("size").alias("total"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit("members"))).alias("y")).where("n > 1")
    blocks = F.ceil(F.least(F.greatest(F.col("n") / BLOCK_DOCS, F.col("total") / BLOCK_SHINGLES), F.col("n") / 2))
    buckets = cut(members.groupBy("n", "x", "y").agg(F.min("key").alias("key"), F.min("total").alias("total")).select("key", blocks.alias("blocks")))
    buckets = F.broadcast(buckets) if buckets.count() <= BROADCAST_IDS else buckets
    met = rows.join(buckets, "key").withColumn("block", F.pmod(F.xxhash64("node", F.lit("block")), F.col("blocks")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: (x != F.col("block")) | (F.col("blocks") == 1))
    met = met.select("node", "size", "key", "block", F.explode(others).alias("other"))
    return cut(met.select("node", "size", "key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")))


def _links(texts: DataFrame, met: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Stars (a, b) of the groups that similar pairs of whole shingle sets make in each comparison."""
    ends = cut(met.select(F.col("node").alias("id")).distinct())
    ends = F.broadcast(ends) if ends.count() <= BROADCAST_IDS else ends
    sets = texts.join(ends, "id").mapInArrow(_set_rows(shingle), "id long, shingles binary").dropDuplicates(["id"]).withColumnRenamed("id", "node")
    n, size = met.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    tasks = max(1, -(-n // TASK_DOCS), -(-size // TASK_SHINGLES))
    task = F.pmod(F.xxhash64("key", "i", "j"), F.lit(tasks))
    return met.drop("size").join(sets, "node").groupBy(task).applyInArrow(_linked_rows(similarity), "a long, b long")


def near_duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = DEDUP_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """(id, component) of every row with an id, by equal words or shingle sets of at least `similarity` (Jaccard).

    Candidates are the documents of a fingerprint group, as simhash_groups() finds them,
    and, since 64-bit fingerprints at radius 2 miss most pairs of similarity 0.8, those of
    a band of minimal shingle hashes. Whole shingle sets of all documents of a group or a
    band are compared, in blocks, without a limit to their number. Texts without words are
    copies of each other.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    shape = "id long, c0 long, c1 long, size long, bands array<long>, empty boolean"
    sketches = cut(texts.mapInArrow(_sketch_rows(shingle), shape))
    classes = cut(sketches.groupBy("c0", "c1", "empty").agg(F.min(F.struct("id", "size", "bands")).alias("s")).select("c0", "c1", "empty", F.col("s.id").alias("node"), "s.size", "s.bands"))
    filled = classes.where("not empty")
    rows = filled.select("node", "size", F.posexplode("bands")).select("node", "size", F.xxhash64("pos", "col").alias("key"))
    prints = simhash_groups(texts, "id", "text").select(F.col("id").alias("node"), F.xxhash64(F.lit("fingerprint"), "component").alias("key")).distinct()
    rows = rows.union(filled.select("node", "size").join(prints, "node"))
    linked = components(_links(texts, _comparisons(rows), shingle, similarity))
    named = classes.join(linked, "node", "left").select("c0", "c1", "empty", F.coalesce("component", "node").alias("component"))
    return sketches.select("id", "c0", "c1", "empty").join(named, ["c0", "c1", "empty"]).select("id", "component")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = DEDUP_SHINGLE, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of `docs` whose id is the smallest of its group, each row once; rows without an id stay."""
    groups = near_duplicate_groups(docs, id_col, text_col, shingle, similarity)
    drop = groups.where("id <> component").select(F.col("id").alias("__drop")).distinct()
    kept = docs.join(drop, F.col(id_col).cast("long") == F.col("__drop"), "left_anti")
    return kept.withColumn("__key", F.xxhash64(F.col(text_col))).dropDuplicates([id_col, "__key"]).drop("__key")
