"""Texts, pages, code, Markdown and tables as typed blocks (id, pos, kind, level, text)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions import text as T

# Line openings that define something in source code.
DEFINITIONS = ["fn ", "pub fn ", "def ", "class ", "function ", "struct ", "impl ", "interface ", "type "]
HEADING_BYTES = 200
#: What stands between blocks while a page is one string.
MARK, LEVEL = "\x1e", "\x1f"
SKIPPED = r"(?is)<!--.*?-->|<(?:script|style|noscript|svg)\b[^>]*>.*?</(?:script|style|noscript|svg)\s*>"
BREAKS = r"(?i)</?(?:p|div|section|article|li|tr|br|blockquote|h[1-6])\b[^>]*>"


def _numbered(rows: DataFrame) -> DataFrame:
    """Blocks with text only, counted from 0."""
    pos = F.row_number().over(Window.partitionBy("id").orderBy("at")) - 1
    return rows.where("text <> ''").withColumn("pos", pos.cast("long")).drop("at")


def text_blocks(docs: DataFrame, id_col: str, text_col: str, separator: str = r"\n\s*\n") -> DataFrame:
    parts = docs.select(F.col(id_col).alias("id"), F.posexplode(F.transform(F.split(text_col, separator), T.collapse)).alias("at", "text"))
    return _numbered(parts).select("id", "pos", F.lit("paragraph").alias("kind"), F.lit(None).cast("int").alias("level"), "text")


def html_blocks(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Headings and paragraphs of pages; comments, scripts, styles and drawings are skipped."""
    html = F.regexp_replace(html_col, SKIPPED, "")
    html = F.regexp_replace(html, r"(?i)<h([1-6])\b[^>]*>", f"{MARK}$1{LEVEL}")
    html = F.regexp_replace(html, BREAKS, MARK)
    html = F.regexp_replace(F.regexp_replace(html, r"(?i)</?t[dh]\b[^>]*>", " "), r"<[^>]*>", "")
    parts = pages.select(F.col(id_col).alias("id"), F.posexplode(F.split(html, MARK)).alias("at", "part"))
    level = F.regexp_extract("part", f"^([1-6]){LEVEL}", 1)
    text = T.replace_all(T.collapse(F.regexp_replace("part", f"^[1-6]{LEVEL}", "")), T.PAGE_ENTITIES)
    rows = _numbered(parts.select("id", "at", F.when(level != "", level.cast("int")).alias("level"), text.alias("text")))
    return rows.select("id", "pos", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), "level", "text")


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(text_col, r"\r?\n")).alias("at", "line"))


def _running(condition: Column) -> Column:
    return F.sum(condition.cast("int")).over(Window.partitionBy("id").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))


def markdown_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Fenced code as it stands (an open fence to the end), headings, table rows without their rule, and paragraphs."""
    fence = F.trim("line").startswith("```")
    rows = _lines(docs, id_col, text_col).withColumn("fences", _running(fence)).withColumn("is_fence", fence)
    inside = (F.col("fences") % 2 == 1) & ~F.col("is_fence")
    heading = F.regexp_extract("line", r"^\s*(#{1,6})\s+\S", 1)
    row = F.trim("line").startswith("|")
    rule = F.trim("line").rlike(r"^\|[\s:|-]+\|?$")
    kind = F.when(inside, "pre").when(F.col("is_fence") | (F.trim("line") == ""), "break").when(heading != "", "heading").when(row & rule, "skip").when(row, "row").otherwise("paragraph")
    rows = rows.withColumns({"kind": kind, "level": F.when(kind == "heading", F.length(heading))})
    previous = F.lag("kind").over(Window.partitionBy("id").orderBy("at"))
    alone = F.col("kind").isin("heading", "row", "break", "skip")
    rows = rows.withColumn("starts", alone | previous.isNull() | (previous != F.col("kind")))
    rows = rows.withColumn("group", _running(F.col("starts"))).where(~F.col("kind").isin("break", "skip"))
    grouped = rows.groupBy("id", "group", "kind", "level").agg(F.min("at").alias("at"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    joined = F.when(F.col("kind") == "pre", F.array_join("lines.line", "\n")).when(F.col("kind") == "heading", T.strip(F.regexp_replace(F.array_join("lines.line", " "), r"^\s*#+\s+|\s#+\s*$", ""))).otherwise(T.collapse(F.array_join("lines.line", " ")))
    return _numbered(grouped.select("id", "at", "kind", F.when(F.col("kind") == "heading", F.col("level")).alias("level"), joined.alias("text"))).select("id", "pos", "kind", "level", "text")


def code_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Source code cut before definition lines: the line as a heading of level 2, then its code."""
    opens = F.lit(False)
    for start in DEFINITIONS:
        opens = opens | F.ltrim("line").startswith(start)
    rows = _lines(docs, id_col, text_col).withColumn("opens", opens & (F.octet_length("line") < HEADING_BYTES))
    rows = rows.withColumn("group", _running(F.col("opens")))
    grouped = rows.groupBy("id", "group").agg(F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"), F.max(F.when(F.col("opens"), F.trim("line"))).alias("title"))
    heading = F.when(F.col("title").isNotNull(), F.struct(F.lit("heading").alias("kind"), F.lit(2).alias("level"), F.col("title").alias("text")))
    body = F.struct(F.lit("pre").alias("kind"), F.lit(None).cast("int").alias("level"), F.array_join("lines.line", "\n").alias("text"))
    parts = grouped.select("id", "group", F.posexplode(F.array_compact(F.array(heading, body))).alias("n", "b"))
    return _numbered(parts.select("id", (F.col("group") * 2 + F.col("n")).alias("at"), "b.kind", "b.level", F.when(F.col("b.kind") == "pre", F.regexp_replace("b.text", r"\s+\z", "")).otherwise(F.col("b.text")).alias("text"))).select("id", "pos", "kind", "level", "text")


#: A section number before a capital.
SECTION_NUMBER = r"^(\d{1,3}(?:\.\d{1,3}){0,5})\.?\s+\p{Lu}"


def heading_level(line: Column, following: Column) -> Column:
    """Level of a line of extracted page text that looks like a heading, else null.

    Section numbers by depth; short lines in capitals; up to eight words in title
    case with text after them.
    """
    clean = F.trim(line)
    number = F.regexp_extract(clean, SECTION_NUMBER, 1)
    letters = F.regexp_replace(clean, r"[^\p{L}]", "")
    capitals = (F.length(clean) <= 60) & (F.length(letters) >= 3) & (letters == F.upper(letters)) & (letters != F.lower(letters))
    words = F.filter(F.split(clean, r"\s+"), lambda w: w != "")
    titled = (F.size(words) <= 8) & F.forall(words, lambda w: w.rlike(r"^\p{Lu}|^\d") | (F.length(w) <= 3)) & clean.rlike(r"^\p{Lu}") & ~clean.rlike(r"[.!?,;:]\z") & (F.coalesce(F.trim(following), F.lit("")) != "")
    depth = F.least(F.lit(6), F.size(F.split(number, r"\.")))
    return F.when(clean == "", None).when((number != "") & (F.length(clean) <= 120) & ~clean.rlike(r"[.!?]\z"), depth).when(capitals, F.lit(1)).when(titled, F.lit(2))


def page_text_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Headings and paragraphs of a page's text layer: words cut by hyphens are joined, a short line that ends a sentence ends its paragraph."""
    order = Window.partitionBy("id").orderBy("at")
    rows = _lines(docs, id_col, text_col).withColumn("level", heading_level(F.col("line"), F.lead("line").over(order)))
    ends = F.lag((F.length(F.trim("line")) < 60) & F.trim("line").rlike(r"[.!?][\"')]?$") | F.col("level").isNotNull() | (F.trim("line") == "")).over(order)
    rows = rows.withColumn("starts", F.col("level").isNotNull() | F.coalesce(ends, F.lit(True)))
    rows = rows.withColumn("group", _running(F.col("starts"))).where("trim(line) <> ''")
    grouped = rows.groupBy("id", "group").agg(F.min("at").alias("at"), F.max("level").alias("level"), F.array_sort(F.collect_list(F.struct("at", "line"))).alias("lines"))
    text = T.collapse(F.regexp_replace(F.array_join("lines.line", "\n"), r"(\p{L})-\n\s*(\p{Ll})", "$1$2"))
    return _numbered(grouped.select("id", "at", "level", text.alias("text"))).select("id", "pos", F.when(F.col("level").isNotNull(), "heading").otherwise("paragraph").alias("kind"), "level", "text")


def row_facts(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """`header: value · header: value` of the cells that are not empty."""
    cells = [F.when(F.trim(F.col(c).cast("string")) != "", F.concat(F.lit(f"{c}: "), F.trim(F.col(c).cast("string")))) for c in columns or rows.columns]
    return F.concat_ws(" · ", *cells)


def read_facts(spark, path: str) -> DataFrame:
    """Facts of all rows of delimited files: tabs if the first line has more of them than commas, quotes doubled inside quotes."""
    first = spark.read.text(path).limit(1).select(F.regexp_count("value", F.lit("\t")) > F.regexp_count("value", F.lit(","))).first()
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', sep="\t" if first and first[0] else ",")
    return rows.select(row_facts(rows).alias("fact")).where("fact <> ''")


def markdown_tables(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, header, rows) of each text's first pipe table; cells with $ and , removed are numbers if they parse."""
    order = Window.partitionBy("id").orderBy("at")
    is_row = F.trim("line").startswith("|")
    rows = _lines(docs, id_col, text_col).withColumn("is_row", is_row)
    rows = rows.withColumn("is_rule", F.trim("line").rlike(r"^\|?[\s:|-]*-[\s:|-]*$") & F.lag("is_row").over(order))
    first = Window.partitionBy("id")
    rule = F.min(F.when(F.col("is_rule"), F.col("at"))).over(first)
    rows = rows.withColumn("rule", rule).where("at >= rule - 1")
    rows = rows.withColumn("stop", F.min(F.when(~F.col("is_row") & (F.col("at") > F.col("rule")), F.col("at"))).over(first)).where("at <> rule and (stop is null or at < stop)")
    cells = F.transform(F.split(F.regexp_replace(F.trim("line"), r"^\||\|$", ""), r"\|"), lambda c: F.trim(c))
    table = rows.withColumn("cells", cells).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "cells"))).alias("t"))
    number = lambda c: F.regexp_replace(c, r"[$,]", "").try_cast("double")
    typed = F.transform(F.slice("t", 2, F.size("t")), lambda r: F.transform(r["cells"], lambda c: F.struct(c.alias("text"), number(c).alias("number"))))
    return table.select("id", F.col("t")[0]["cells"].alias("header"), typed.alias("rows"))


def _section_lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, at, line, ...) of texts without fenced code, with what each line is and the section that it stands in."""
    bare = F.trim(F.regexp_replace(text_col, r"(?s)```.*?```", ""))
    rows = docs.select(F.col(id_col).alias("id"), F.posexplode(F.split(bare, r"\r?\n")).alias("at", "raw")).select("id", "at", T.strip(F.col("raw")).alias("line"))
    line = F.col("line")
    cells = F.transform(F.split(F.substring(line, F.lit(2), F.length("line") - 2), r"\|"), lambda c: T.strip(c))
    row = line.startswith("|") & line.endswith("|") & (F.length("line") > 1)
    rule = row & F.forall(cells, lambda c: c.rlike(r"^:?-+:?$"))
    hashes, strong = F.regexp_extract(line, r"^(#{1,3})\s+\S", 1), F.regexp_extract(line, r"^\*\*(\d+\.?[^*]+|[A-Z][^*]{2,50}?):?\*\*$", 1)
    kind = (
        F.when(line == "", "blank").when(rule, "rule").when(row, "row").when(hashes.isin("#", "##") | ((hashes == "") & (strong != "")), "heading").when(hashes == "###", "subheading")
        .when(line.rlike(r"^[-*•]\s+") | line.rlike(r"^\d+\.\s+"), "bullet").when(line.startswith(">"), "callout").otherwise("paragraph")
    )
    text = (
        F.when(kind.isin("heading", "subheading"), F.when(hashes != "", T.strip(F.regexp_replace(line, r"^#{1,3}\s+", ""))).otherwise(T.strip(strong)))
        .when(kind == "bullet", F.regexp_replace(line, r"^[-*•0-9.]+\s*", "")).when(kind == "callout", F.regexp_replace(line, r"^>\s*", "")).otherwise(line)
    )
    rows = rows.withColumns({"kind": kind, "level": F.when(kind == "heading", F.when(hashes != "", F.length(hashes)).otherwise(2)), "text": text, "cells": F.when(row, cells)})
    # a section begins at each heading; what stands before the first is one of its own, unless it is only tables
    rows = rows.withColumn("section", _running(F.col("kind") == "heading").cast("long"))
    # rows of pipes in one piece are a table
    return rows.withColumn("block", _running(~F.col("kind").isin("row", "rule")))


def markdown_sections(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, section, heading, level, subheading, paragraphs, bullets, callout, table) of texts cut at headings.

    Sections open at `#`, `##` and lines that are strong altogether; `###` is a subheading
    within one. What stands before the first heading is section 0, "Overview"; tables alone
    make none. Of several subheadings, callouts and tables of a section the last counts. A
    table has its last row before a rule as its header, and rows behind it; without either
    it is none. Fenced code is left out.
    """
    rows = _section_lines(docs, id_col, text_col)
    pipes = rows.where("kind in ('row', 'rule')")
    at_rule = F.min(F.when(F.col("kind") == "rule", F.col("at"))).over(Window.partitionBy("id", "block"))
    pipes = pipes.withColumn("at_rule", at_rule).where("kind = 'row' and at_rule is not null")
    before = F.col("at") < F.col("at_rule")
    ordered = lambda keep, value: F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct(F.col("at"), value.alias("value"))))), lambda s: s["value"])
    tables = pipes.groupBy("id", "section", "block").agg(F.max_by(F.when(before, F.col("cells")), F.when(before, F.col("at"))).alias("headers"), ordered(~before, F.col("cells")).alias("rows"), F.min("at").alias("begins"))
    tables = tables.where("headers is not null and size(rows) > 0")
    last = lambda kind: F.max_by(F.when(F.col("kind") == kind, F.col("text")), F.when(F.col("kind") == kind, F.col("at")))
    parts = rows.where("kind not in ('blank', 'row', 'rule')").groupBy("id", "section").agg(
        F.coalesce(last("heading"), F.lit("Overview")).alias("heading"), F.max("level").alias("level"), last("subheading").alias("subheading"),
        ordered(F.col("kind") == "paragraph", F.col("text")).alias("paragraphs"), ordered(F.col("kind") == "bullet", F.col("text")).alias("bullets"), last("callout").alias("callout"),
        F.min(F.when(~F.col("kind").isin("heading"), F.col("at"))).alias("__first"),
    )
    # a table before anything else of the overview belongs to no section
    tables = tables.join(parts.select("id", "section", "__first"), ["id", "section"]).where("section > 0 or __first < begins")
    tables = tables.groupBy("id", "section").agg(F.max_by(F.struct("headers", "rows"), "block").alias("table"))
    joined = parts.join(tables, ["id", "section"], "left")
    return joined.drop("__first").select("id", "section", "heading", "level", "subheading", "paragraphs", "bullets", "callout", "table")


def markdown_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, title, subtitle, sections) of texts: the sections in order, without the one that is only the title.

    The title is the first `#` heading among the first ten lines, else the first section's
    heading. The subtitle is the callout on the line behind the title, else the callout or
    the first paragraph of the section that the title opens. A text without sections has none.
    """
    rows = _section_lines(docs, id_col, text_col)
    top = rows.withColumn("next", F.lead(F.when(F.col("kind") == "callout", F.col("text"))).over(Window.partitionBy("id").orderBy("at"))).where("at < 10 and kind = 'heading' and level = 1")
    named = top.groupBy("id").agg(F.min(F.struct("at", "text", "next")).alias("named")).select("id", F.col("named.text").alias("named"), F.col("named.next").alias("next"))
    fields = ("section", "heading", "level", "subheading", "paragraphs", "bullets", "callout", "table")
    whole = markdown_sections(docs, id_col, text_col).groupBy("id").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("all"))
    rows = docs.select(F.col(id_col).alias("id")).join(whole, "id", "left").join(named, "id", "left")
    first = F.col("all")[0]
    opened = first["heading"] == F.col("named")
    own = F.coalesce(first["callout"], F.get(first["paragraphs"], F.lit(0)))
    rest = F.slice("all", 2, F.greatest(F.size("all") - 1, F.lit(1)))
    sections = F.when(opened & (F.size("all") > 1), rest).otherwise(F.coalesce("all", F.array().cast(whole.schema["all"].dataType)))
    return rows.select("id", F.coalesce("named", first["heading"]).alias("title"), F.coalesce("next", F.when(opened, own)).alias("subtitle"), sections.alias("sections"))
