"""The registered queries of this subpackage and their DuckDB oracles."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import oracles
from .ann import nearest
from .chat_format import format_conversations, read_back
from .decontam import decontaminate
from .html_template import extract_text
from .langid import identify, train
from .line_dedup import dedup_lines
from .lm_score import score
from .mixing import mix_sources
from .simhash import simhash_groups
from .substring import dedup_substrings
from .token_align import align_tokens, tokenizer_files
from .turn_repair import repair_conversations
from .url_filter import filter_urls, host_of, path_of

#: Hosts whose pages make up the list of the URL filter's query.
SPAM_HOSTS = r"(^|\.)(spam-farm|cheap-pills)\."


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: fingerprint and the smallest doc_id that links of two bits or fewer reach."""
    groups = simhash_groups(_table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, removed words and a digest of what is kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: words, words hit by benchmark phrases, and the items hit."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate(docs, _table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the language from text, markup, address and host; models are trained on labelled documents."""
    model = train(_table(spark, sf_dir, "documents"))
    url = F.col("url")
    suffix = F.regexp_extract(host_of(url), r"\.([a-z]{2})$", 1)
    folder = F.regexp_extract(path_of(url), r"^/([a-z]{2})/", 1)
    pages = _table(spark, sf_dir, "pages")
    markup = F.lower(F.regexp_extract("html", r"""(?is)^[^<]*(?:<![^>]*>\s*)?<html[^>]*\blang\s*=\s*["']?([a-z]{2})""", 1))
    judged = identify(pages, model, "html", host=host_of(url), markup_lang=markup, address_lang=F.when(suffix != "", suffix).otherwise(folder), markup=True)
    return judged.select("page_id", "url", "language", F.round("confidence", 6).alias("confidence"), "text_language")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the main text."""
    pages = extract_text(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per page: the rule that its URL falls under and the verdict; pages of known spam hosts are the listed URLs."""
    pages = _table(spark, sf_dir, "pages").select("page_id", "url")
    listed = pages.where(host_of(F.col("url")).rlike(SPAM_HOSTS)).select("url")
    return filter_urls(pages, listed).select("page_id", "host", "path", "rule", "verdict")


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: mean losses under the target and background models, and their difference."""
    scored = score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select(F.col("id").alias("doc_id"), "n_tokens", *[F.round(c, 9).alias(c) for c in ("target_loss", "background_loss", "score")])


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, read back from its formatted form: turns and masked text as digests."""
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.range(2).select(F.lit(-1).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit("</s>[INST] ok [/INST]"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.union(own).withColumn("n", F.row_number().over(order).cast("long"))
    messages = rows.select(F.col("conv_id").alias("conv"), F.col("n").alias("msg"), F.when(F.col("n") > 1, F.col("n") - 1).alias("parent"), F.length("text").cast("double").alias("score"), "role", "text")
    back = read_back(format_conversations(messages))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        F.col("conv").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its size, its source's size and target, and the words that the mix takes."""
    mixed = mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", "position")


def op8_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For every twentieth vector the 20 nearest found."""
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: lines, dropped lines and a digest of what is kept, without the lines that ten documents or more hold."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: tokens of two tokenizers, their groups and links, and how usual the links are."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = align_tokens(docs, tokenizer_files(spark), keep_text=False, lists=False, texts=True)
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("")
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def _damaged(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv, turn, role, text) with one row in four dropped, emptied, cut, repeated or given to the user, by its place."""
    place = F.concat(F.coalesce(F.col("conv").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    rows = rows.select("conv", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), (F.crc32(place) % 20).alias("n")).where("n <> 0")
    text = F.when(F.col("n") == 1, "").when(F.col("n") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv", "turn", F.when(F.col("n") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "n")
    return rows.withColumn("copy", F.explode(F.when(F.col("n") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).select("conv", "turn", "role", "text")


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per conversation, after damage: faults, and the cheapest repair as its cost, its audit and a digest."""
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), "turn", "role", "text")
    fixed = repair_conversations(_damaged(rows))
    said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["text"])), "\n")
    fixed = fixed.select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", said.alias("said"))
    every = rows.select(F.col("conv").alias("conv_id")).distinct()
    out = every.join(fixed, F.col("conv_id").eqNullSafe(F.col("conv")), "left")
    counts = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.sha2(F.coalesce("said", F.lit("")), 256).alias("repaired_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five stages of corpus_pipeline."""
    return corpus_pipeline.run(spark, sf_dir)


def queries():
    """All queries of the subpackage by name."""
    return {
        "op1_language_id": op1_language_id,
        "op2_html_extraction": op2_html_extraction,
        "op3_url_filter": op3_url_filter,
        "op4_lm_score": op4_lm_score,
        "op5_chat_format": op5_chat_format,
        "op6_simhash": op6_simhash,
        "op7_mixing": op7_mixing,
        "op8_nearest": op8_nearest,
        "op9_substring_dedup": op9_substring_dedup,
        "op10_decontamination": op10_decontamination,
        "op11_line_dedup": op11_line_dedup,
        "op12_token_align": op12_token_align,
        "op13_turn_repair": op13_turn_repair,
        "pipeline": pipeline,
    }


def oracle_sql():
    """DuckDB SQL of those queries that SQL expresses at reasonable cost."""
    return dict(oracles.SQL)
