"""Files of several formats as blocks: a table function that looks up a file's extractor by its format."""

from __future__ import annotations

import csv
import io
import re
import sys
from collections.abc import Callable, Iterable
from email import message_from_bytes, policy

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

#: (kind, level, text)
Block = tuple[str, int | None, str]
_SPACE = re.compile(r"\s+", re.ASCII)


def _collapsed(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def text_paragraphs(content: bytes) -> Iterable[Block]:
    """Paragraphs between blank lines."""
    for part in re.split(r"\n[ \t\r]*\n", content.decode()):
        if text := _collapsed(part):
            yield "paragraph", None, text


def delimited_facts(content: bytes) -> Iterable[Block]:
    """Rows as `header: value` facts; the first line tells commas from tabs."""
    text = content.decode()
    first = text.partition("\n")[0]
    csv.field_size_limit(sys.maxsize)
    rows = csv.reader(io.StringIO(text, newline=""), delimiter="\t" if first.count("\t") > first.count(",") else ",")
    names = [_collapsed(n) for n in next(rows, [])]
    for row in rows:
        facts = [f"{name}: {value}" for name, value in zip(names, map(_collapsed, row), strict=False) if value]
        if facts:
            yield "row", None, " · ".join(facts)


def mail_blocks(content: bytes) -> Iterable[Block]:
    """The subject as a heading, and the paragraphs of the plain text."""
    message = message_from_bytes(content, policy=policy.default)
    if subject := _collapsed(message.get("Subject", "")):
        yield "heading", 1, subject
    body = message.get_body(("plain",))
    yield from text_paragraphs(body.get_content().encode()) if body else ()


#: Extractors by format name; callers add their own.
EXTRACTORS: dict[str, Callable[[bytes], Iterable[Block]]] = {"Text": text_paragraphs, "CSV": delimited_facts, "Mail": mail_blocks}
SHAPE = "pos long, kind string, level int, text string, error string"


def extractor(extractors: dict[str, Callable[[bytes], Iterable[Block]]] = EXTRACTORS):
    """The table function (format, content) -> (pos, kind, level, text, error), to be called or registered as spark.udtf.register(name, ...).

    A file that fails, that no extractor knows, or that has no text gives one row with an error.
    """
    extractors = dict(extractors)

    class Extract:
        def eval(self, format: str, content: bytes):
            try:
                if format not in extractors:
                    raise LookupError(f"no extractor for {format}")
                blocks = list(extractors[format](bytes(content or b"")))
                if not blocks:
                    raise ValueError("no text")
            except Exception as error:
                yield None, None, None, None, f"{type(error).__name__}: {error}"
                return
            for pos, (kind, level, text) in enumerate(blocks):
                yield pos, kind, level, text, None

    return udtf(Extract, returnType=SHAPE, useArrow=True)


def extract_blocks(files: DataFrame, extractors: dict[str, Callable[[bytes], Iterable[Block]]] = EXTRACTORS) -> DataFrame:
    """Files (format, content, ...) joined laterally to their blocks (pos, kind, level, text, error); content is left out."""
    blocks = extractor(extractors)(F.col("format").outer(), F.col("content").outer())
    return files.lateralJoin(blocks).drop("content")
