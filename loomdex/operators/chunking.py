"""Blocks to retrieval chunks: heading trails, pages, greedy packing."""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import split_sentences

TRAIL = " › "
#: Documents that a task packs at once.
PACK_ROWS = 32


@dataclass(frozen=True)
class Sizes:
    """Bytes of a chunk: at most, at least, and what it repeats of the one before."""

    most: int = 744
    least: int = 120
    overlap: int = 150

    @property
    def target(self) -> int:
        return self.most * 4 // 5


def heading_trails(blocks: DataFrame) -> DataFrame:
    """Body blocks of (id, pos, kind, level, text) with `trail`, the headings above them.

    A level is in the trail if its last heading stands after every heading of a
    smaller level, so the trail is six running values and no loop over blocks.
    """
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_heading = F.col("kind") == "heading"
    last = [F.last(F.when(is_heading & (F.col("level") == n), F.struct("pos", "text")), ignorenulls=True).over(so_far) for n in range(1, 7)]
    rows = blocks.withColumns({f"h{n}": c for n, c in enumerate(last, 1)})
    entries = []
    for n in range(1, 7):
        above = [F.coalesce(F.col(f"h{m}")["pos"], F.lit(-1)) for m in range(1, n)]
        covered = F.col(f"h{n}")["pos"] > (F.greatest(*above) if len(above) > 1 else above[0] if above else F.lit(-1))
        entries.append(F.when(covered, F.col(f"h{n}")["text"]))
    trail = F.filter(F.array(*entries), lambda t: t.isNotNull())
    return rows.where(~is_heading).withColumn("trail", F.array_join(trail, TRAIL)).drop(*[f"h{n}" for n in range(1, 7)])


def carry_pages(blocks: DataFrame) -> DataFrame:
    """Blocks that are no page breaks, with the number of the last break before them."""
    so_far = Window.partitionBy("id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return blocks.withColumn("page", F.last("page", ignorenulls=True).over(so_far)).where("kind <> 'page'")


def _size(text: str) -> int:
    return len(text.encode())


def _fitted(text: str, most: int) -> list[str]:
    """Pieces of a run without a better border, cut after spaces where there are any."""
    out = []
    raw = text.encode()
    while len(raw) > most:
        head = raw[:most].decode(errors="ignore")
        at = head.rfind(" ") + 1 or len(head)
        out.append(head[:at].strip())
        raw = raw[len(head[:at].encode()) :]
    out.append(raw.decode().strip())
    return [p for p in out if p]


def _pieces(unit: dict, sizes: Sizes) -> list[str]:
    """A block as pieces of at most the size: whole, or by cells, or by sentences."""
    text = unit["text"].strip()
    if _size(text) <= sizes.most:
        return [text] if text else []
    if text.startswith("|"):
        units, glue = [c + "|" for c in text.rstrip("|").split("|")], ""
    else:
        units, glue = [p for s in unit["sentences"] for p in _fitted(s, sizes.most)], " "
    out, held = [], ""
    for u in units:
        if held and _size(held) + len(glue) + _size(u) > sizes.target:
            out.append(held)
            held = ""
        held = f"{held}{glue}{u}" if held else u
    return [*out, *([held] if held.strip() else [])]


def _tail(text: str, size: int) -> str:
    """The end of a chunk that the next repeats: from after its first sentence end, no part of a table row."""
    end = text.encode()[-size:].decode(errors="ignore") if size else ""
    if text[: len(text) - len(end)].rpartition("\n")[2].startswith("|"):
        end = end.partition("\n")[2]
    _, stop, rest = end.partition(". ")
    return (rest if stop and rest else end).strip()


def pack_document(units: list[dict], sizes: Sizes) -> list[dict]:
    """Chunks of one document's body blocks in order; borders of trail and page are chunk borders."""
    chunks: list[dict] = []
    held: list[str] = []
    where = None

    def close(repeat: bool):
        body = "\n\n".join(held).strip()
        held.clear()
        if body:
            chunks.append({"trail": where[0], "page": where[1], "body": body})
        tail = _tail(body, sizes.overlap) if repeat and body else ""
        if tail:
            held.append(tail)

    for unit in units:
        here = (unit["trail"], unit["page"])
        if where != here:
            close(repeat=False) if where is not None else None
            where = here
        room = max(sizes.least, sizes.most - _size(unit["trail"]) - 1)
        fit = Sizes(min(sizes.most, room), sizes.least, sizes.overlap)
        for piece in _pieces(unit, fit):
            if held and sum(map(_size, held)) + 2 * len(held) + _size(piece) > fit.target:
                close(repeat=_size(piece) + sizes.overlap + 2 <= fit.target)
            held.append(piece)
    if where is not None:
        close(repeat=False)
    kept = [c for c in chunks if sum(ch.isalnum() for ch in c["body"]) >= 8]
    return _without_runts(kept, sizes)


def _without_runts(chunks: list[dict], sizes: Sizes) -> list[dict]:
    """Small chunks join a neighbour of the same trail and page if both fit."""
    out: list[dict] = []
    for c in chunks:
        before = out[-1] if out else None
        together = before and (before["trail"], before["page"]) == (c["trail"], c["page"]) and _size(before["body"]) + _size(c["body"]) + 2 + _size(c["trail"]) + 1 <= sizes.most
        if together and min(_size(before["body"]), _size(c["body"])) < sizes.least:
            before["body"] += "\n\n" + c["body"]
        else:
            out.append(dict(c))
    return out


def _packed_rows(sizes: Sizes):
    def rows(batches):
        # a few documents at a time are Python objects, however many a batch has
        for batch in (whole.slice(at, PACK_ROWS) for whole in batches for at in range(0, len(whole), PACK_ROWS)):
            out: list[list] = [[], [], [], [], [], []]
            for name, units in zip(batch.column("id").to_pylist(), batch.column("units").to_pylist(), strict=True):
                for i, c in enumerate(pack_document([u | {"trail": u["trail"] or ""} for u in units], sizes)):
                    text = f"{c['trail']}\n{c['body']}" if c["trail"] else c["body"]
                    for column, value in zip(out, (name, i, c["trail"], c["page"], c["body"], text), strict=True):
                        column.append(value)
            kinds = [batch.schema.field("id").type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["id", "index", "trail", "page", "body", "text"])

    return rows


def pack(blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """(id, index, trail, page, body, text) of body blocks (id, pos, trail, page, text): greedy packing, one document at a time.

    Packing is a fold over a document, so a document's blocks are one row, dealt by
    id as the windows of trails and pages have left them; documents are packed in
    parallel, an Arrow batch at a time. Sentences are cut before, in the JVM, and
    only of blocks that no chunk can take whole.
    """
    room = F.greatest(F.lit(sizes.least), sizes.most - F.octet_length(F.coalesce("trail", F.lit(""))) - 1)
    sentences = F.when(F.octet_length("text") > F.least(F.lit(sizes.most), room), split_sentences(F.col("text")))
    rows = blocks.select("id", F.struct("pos", "trail", F.col("page").cast("long").alias("page"), "text", sentences.alias("sentences")).alias("unit"))
    whole = rows.groupBy("id").agg(F.sort_array(F.collect_list("unit")).alias("units"))
    kind = blocks.schema["id"].dataType.simpleString()
    return whole.mapInArrow(_packed_rows(sizes), f"id {kind}, index long, trail string, page long, body string, text string")


def chunk_texts(blocks: DataFrame, sizes: Sizes = Sizes()) -> DataFrame:
    """Chunks of blocks (id, pos, kind, level, text) without pages."""
    body = heading_trails(blocks).withColumn("page", F.lit(None).cast("long"))
    return pack(body, sizes)
