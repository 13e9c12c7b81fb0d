"""Conversation repair against a search over all edits and against a brute-force version of the query."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from loomdex.llm import turn_repair
from loomdex.llm.queries import _damaged, queries
from loomdex.llm.turn_repair import align, block_repairs, plan, repair_conversations
from pyspark.sql import functions as F

SPACE = " \t\n\v\f\r"


def naive(turns):
    """(cost, audit) of the cheapest repair by dynamic programming over place and last role, from the back."""
    follow, n = {"": "u", "s": "u", "u": "a", "a": "u"}, len(turns)
    rest = {(n, ""): (0, ""), (n, "a"): (0, ""), (n, "u"): (2, "I"), (n, "s"): (4, "II")}
    for i in range(n - 1, -1, -1):
        t = turns[i]
        def after(last, i=i, t=t):
            out = [(3 + rest[i + 1, last][0], "D" + rest[i + 1, last][1])]
            if t != "x":
                cut, role = int(t.isupper()), t.lower()
                if role == follow[last] or (role == "s" and not last):
                    c, a = rest[i + 1, role]
                    out.append((cut + c, "K" + a))
                c, a = rest[i + 1, follow[last]]
                out.append((2 + cut + c, "R" + a))
            return min(out)
        for last in follow:
            # up to two insertions before a turn; more are never cheaper
            one, two = follow[last], follow[follow[last]]
            (c1, a1), (c2, a2) = after(one), after(two)
            rest[i, last] = min(after(last), (2 + c1, "I" + a1), (4 + c2, "II" + a2))
    return rest[0, ""]


def test_plans_are_the_cheapest_and_least():
    rng = np.random.default_rng(13)
    for _ in range(3000):
        n = int(rng.integers(0, 12))
        turns = "".join("uasoUASOx"[k] for k in rng.choice(9, n, p=[0.28, 0.28, 0.08, 0.02, 0.1, 0.1, 0.02, 0.02, 0.1]))
        assert plan(turns) == naive(turns), turns


@pytest.mark.parametrize("block", [1, 2, 5])
def test_blocks_give_what_whole_conversations_give(monkeypatch, block):
    rng = np.random.default_rng(block)
    cases = ["".join(rng.choice(list("uasUAxo"), int(rng.integers(0, 40)), p=[0.3, 0.3, 0.1, 0.1, 0.1, 0.05, 0.05])) for _ in range(200)]
    monkeypatch.setattr(turn_repair, "BLOCK", block)
    block_repairs.cache_clear()
    plan.cache_clear()
    assert [plan(c) for c in cases] == [naive(c) for c in cases]
    block_repairs.cache_clear()
    plan.cache_clear()


def test_long_conversations_take_linear_time():
    rng = np.random.default_rng(1)
    turns = "".join(rng.choice(list("uasUAx"), 20_000))
    assert plan(turns) == naive_long(turns)


def naive_long(turns):
    """naive() without long audits: the cost, then the audit by what is cheapest in order."""
    follow, n = {"": "u", "s": "u", "u": "a", "a": "u"}, len(turns)
    rest = [{"": 0, "a": 0, "u": 2, "s": 4}]
    for t in reversed(turns):
        behind = rest[-1]
        own = {e: min([3 + behind[e]] + ([] if t == "x" else [2 + t.isupper() + behind[follow[e]]]) + ([t.isupper() + behind[t.lower()]] if t != "x" and (t.lower() == follow[e] or (t.lower() == "s" and not e)) else [])) for e in follow}
        for _ in range(3):
            own = {e: min(own[e], 2 + own[follow[e]]) for e in follow}
        rest.append(own)
    rest.reverse()
    audit, i, e = [], 0, ""
    while i < n or e not in ("", "a"):
        left = rest[i][e]
        if i < n and 3 + rest[i + 1][e] == left:
            audit.append("D")
            i += 1
        elif 2 + rest[i][follow[e]] == left:
            audit.append("I")
            e = follow[e]
        else:
            t = turns[i]
            keep = t.lower() == follow[e] or (t.lower() == "s" and not e)
            audit.append("K" if keep and t.isupper() + rest[i + 1][t.lower()] == left else "R")
            i, e = i + 1, t.lower() if audit[-1] == "K" else follow[e]
    return rest[0][""], "".join(audit)


def test_bands_and_bounds():
    assert align("ua", "ua", 0) == (0, "KK") and align("uu", "ua", 1) is None and align("uu", "ua", 2) == (2, "KR")
    assert align("x", "", 3) == (3, "D") and align("", "ua", 4) == (4, "II") and align("", "ua", 9, last=False) is None and align("u", "ua", 9, last=False) == (4, "IR")


def brute(rows):
    """The query's result of rows (conv_id, turn, role, text)."""
    out, whole = [], defaultdict(list)
    for conv, turn, role, text in rows:
        whole[conv]
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        whole[conv] += [(turn is not None, turn or 0, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)
    for conv, turns in whole.items():
        turns.sort()
        count, said, letters = dict.fromkeys(("blank", "duplicate", "truncated"), 0), [], ""
        for _, _, role, text in turns:
            bare = text.strip(SPACE)
            fault = "blank" if not bare else "duplicate" if (role, text) in said else "truncated" if bare[-1] not in ".!?" else ""
            if fault:
                count[fault] += 1
            said.append((role, text))
            letter = role[:1] if role[:1] in ("u", "a", "s") else "o"
            letters += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = naive(letters)
        kept, i = [], 0
        for edit in audit:
            role = "user" if not kept or kept[-1][:1] in "sa" else "assistant"
            if edit == "I":
                kept.append(f"{role}:")
                continue
            if edit != "D":
                kept.append(f"{turns[i][2] if edit == 'K' else role}:{turns[i][3]}")
            i += 1
        numbers = {t for known, t, _, _ in turns if known}
        gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        out.append((conv, gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, sf):
    frame = queries()["op13_turn_repair"](spark, f"/root/testdata/{sf}")
    rows = spark.read.parquet(f"/root/testdata/{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert frame.columns == COLUMNS
    assert sorted(map(tuple, frame.collect()), key=repr) == brute(rows)


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    texts = ["Yes.", "No", "", " \t", None, "Why? ", "ok!", "Überall.", "a\nb."]
    roles = ["user", "assistant", "system", None, "", "tool", "User"]
    rows = [(int(c), int(t) if rng.random() < 0.9 else None, roles[int(rng.integers(7))] if rng.random() < 0.3 else roles[t % 2], texts[int(rng.integers(9))]) for c in range(80) for t in range(int(rng.integers(1, 9)))]
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hello."), (None, None, None, None), rows[0], rows[0], (99, 5, "user", "long. " * 20000), (99, 9, "assistant", "long. " * 20000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    frame.withColumn("cost", F.lit("clash")).withColumn("t", F.lit(1)).write.parquet(str(tmp_path / "conversations.parquet"))
    got = queries()["op13_turn_repair"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == brute(rows)


def test_messages_follow_the_grammar(spark, tiny):
    rows = spark.read.parquet(f"{tiny}/conversations.parquet").select(F.col("conv_id").alias("conv"), "turn", "role", "text", F.lit(0).alias("gaps"))
    for r in repair_conversations(_damaged(rows)).collect():
        assert re.fullmatch("(s?(ua)+)?", "".join(m.role[0] for m in r.messages)) and len(r.messages) == len(r.audit.replace("D", ""))


def test_empty_table(spark):
    assert repair_conversations(spark.createDataFrame([], "conv long, turn long, role string, text string")).collect() == []
