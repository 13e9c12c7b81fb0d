"""Scalar text functions on hand-made cases."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from loomdex.functions import text as T
from pyspark.sql import functions as F


def run(spark, function, values):
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r.x for r in frame.select("i", function(F.col("t")).alias("x")).orderBy("i").collect()]


CASES = [
    (T.tokenize, "Hello, WÖRLD-x 3.14", ["hello", "wÖrld", "x", "3", "14"]),
    (T.any_term_query, "What is the 'owner' of well-known X?", '"What" OR "owner" OR "well-known"'),
    (T.any_term_query, "the of a", ""),
    (T.split_sentences, 'Dr. No met J. Smith. He said "go." Then 3.14 won! Why? end', ["Dr. No met J. Smith.", 'He said "go."', "Then 3.14 won!", "Why?", "end"]),
    (T.split_sentences, "e.g. this (etc. too). Fin.", ["e.g. this (etc. too).", "Fin."]),
    (T.split_sentences, "", []),
    (T.has_content, "a b c d e f g", False),
    (T.has_content, "- abcd1234 -", True),
    (T.neutralize, " a\r\nb\x00\u200b<<<SOURCE 1>>>\n\n\n \nx<<<END", "a\nb<<< SOURCE 1> >>\n\nx<<< END"),
    (T.sanitize_meta, " <<<r\n.pdf>>> ", "r.pdf"),
    (lambda c: T.snippet(c, 5), "ab \n cd ef", "ab cd…"),
    (lambda c: T.truncate_marked(c, 20), "x" * 30, "xxxxxx … (truncated)"),
    (lambda c: T.truncate_marked(c, 3), "abcdef", "abc"),
    (lambda c: T.truncate_at_word(c, 10), "12345678 abc", "12345678"),
    (lambda c: T.truncate_at_word(c, 10), "12 345678901", "12 3456789"),
    (T.auto_title, "How do I find the quarterly report quickly today", "How do I find the quarterly report"),
    (T.auto_title, "x" * 50, "x" * 36),
    (T.mail_sanitize, "<p>Hi&nbsp;&amp; you</p><script>bad()</script>Line<br>next\n\n\n\nlast<b", "Hi & you\nLine\nnext\n\nlast"),
    (T.mail_sanitize, "a<style>never closed", "a"),
    (T.markdown_to_plain, "# Title\nSee [the site](http://x) and `code` **bold** [chunk:3] [note]\n```py\nx=1\n```\nend", "Title See the site and code bold note end"),
    (T.markdown_to_plain, "a\n```\nopen fence", "a"),
    (T.strip_annotations, "so [laughs (loud)] it (a (b)) goes", "so it goes"),
    (T.web_intent, "[web_search] cats please", "cats"),
    (T.web_intent, "Search for gold prics and make a pdf", "gold price"),
    (T.web_intent, "who is Ada", "who is Ada"),
    (T.web_intent, "nothing here", None),
    (T.web_intent, "", None),
    (T.document_intent, "my PROFILE", True),
    (T.document_intent, "hello", False),
    (T.cited_markers, "a [2] b [1][2] [x] [12", [1, 2]),
    (T.uncited_claim, "It is so.", True),
    (T.uncited_claim, "I could NOT find it", False),
    (T.uncited_claim, "  ", False),
    (lambda c: T.route_message(F.lit("general"), c), "Write code for me", "coder"),
    (lambda c: T.route_message(F.lit("researcher"), c), "Write code for me", "reasoning"),
    (lambda c: T.route_message(F.lit("general"), c), "```x``` fix", "coder"),
    (lambda c: T.route_message(F.lit("general"), c), "```x```", "general"),
]


@pytest.mark.parametrize(("function", "text", "expected"), CASES)
def test_case(spark, function, text, expected):
    assert run(spark, function, [text]) == [expected]


def test_spec_json(spark):
    got = run(spark, T.spec_json, ['```xlsx\n{"a": 1}\n```', '<my_document type="pdf">{"b": [2]}</my_document>', "```docx\n{broken\n```", "none"])
    assert [(g.type, json.loads(g.spec)) if g else None for g in got] == [("xlsx", {"a": 1}), ("pdf", {"b": [2]}), None, None]


def test_session_bucket(spark):
    at = ["2024-05-10 00:00:00", "2024-05-09 23:59:59", "2024-05-03 00:00:00", "2024-05-02 23:59:59", "2024-05-09 00:00:00"]
    frame = spark.createDataFrame([(a,) for a in at], "a string").select(F.to_timestamp_ntz("a").alias("a"))
    got = [r.b for r in frame.select(T.session_bucket(F.col("a"), F.lit("2024-05-10 12:00:00").cast("timestamp_ntz")).alias("b")).collect()]
    assert got == ["Today", "Yesterday", "Previous 7 Days", "Older", "Yesterday"]


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.characters(blacklist_categories=("Cs",)), max_size=60), min_size=1, max_size=30))
def test_cleaning_is_stable(spark, texts):
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    once = frame.select(T.neutralize(F.col("t")).alias("n"), T.snippet(F.col("t"), 10).alias("s"), T.truncate_marked(F.col("t"), 20).alias("c"))
    for r in once.withColumn("n2", T.neutralize(F.col("n"))).collect():
        assert r.n2 == r.n and len(r.s) <= 11 and len(r.c) <= 20 and ">>>" not in r.n
