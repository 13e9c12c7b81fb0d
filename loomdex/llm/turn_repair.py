"""Conversation structure repair by alignment to the strings of a grammar of roles.

A repaired conversation alternates user and assistant, ends with an assistant, and may
open with a system turn: its role initials are `(s?(ua)+)?`. Every turn is kept (0), given
the role user or assistant (2) or deleted (3, and required for blank and duplicate turns);
a user or assistant turn without text may be inserted anywhere (2); a truncated turn that
is not deleted costs 1 more. Of the cheapest repairs the one whose audit, the initials of
its edits in order, is the least in ASCII is chosen.

The grammar has one or two strings of each feasible length, and the turns are aligned to
them one by one (Wagner-Fischer), lengths near the number of turns first. The cheapest
alignment so far bounds the others: lengths that must cost more are passed over, and of a
table only the cells are filled that a repair within the bound can pass (Ukkonen's band).
Tables hold what the rest costs, so the least audit is read off them from the first turn
on; at equal costs audits are compared.

Conversations of more than `BLOCK` turns are aligned block by block, from every role that
a block may follow to every length it may get. Inserted turns belong to the turn behind
them, so no block's audit is the beginning of another's, and the cheapest, then least
chain of blocks is that of the whole conversation. Time is linear in the turns.
"""

from __future__ import annotations

from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
#: Turns that are aligned at once.
BLOCK = 24
#: Plans of conversations, and tables of blocks, that a worker remembers.
REMEMBERED = 1 << 16

ROLES = {"u": "user", "a": "assistant"}
#: What each role initial follows; "" is the beginning.
_NEXT = {"": "u", "s": "u", "u": "a", "a": "u"}
_NEVER = 1 << 40


def targets(entry: str, length: int) -> list[str]:
    """Strings of so many role initials that may follow `entry`."""
    first = _NEXT[entry]
    other = _NEXT[first]
    alternating = (first + other) * (length // 2) + first * (length % 2)
    if entry or not length:
        return [alternating]
    return [alternating, "s" + ("ua" * length)[: length - 1]]


def _moves(turn: str, letter: str) -> int:
    """What it costs that a turn stands for a letter: kept, or given another role."""
    kind, cut = turn.lower(), TRUNCATED * turn.isupper()
    if kind == "x":
        return _NEVER
    if kind == letter:
        return cut
    return REROLE + cut if letter in ROLES else _NEVER


def align(turns: str, target: str, bound: int, last: bool = True) -> tuple[int, str] | None:
    """(cost, audit) of the cheapest alignment of turns to a target, the least of equal ones; None if it costs more than `bound`.

    A turn is its role initial (any but u, a and s is o), a capital if it is truncated, or x
    if it has to be deleted. Insertions behind the last turn only with `last`.
    """
    n, m = len(turns), len(target)
    # what cells off the diagonal cost at least before and behind them
    least = lambda rows, letters: DELETE * (rows - letters) if rows >= letters else INSERT * (letters - rows)
    if least(n, m) > bound:
        return None
    rest = {(n, m): 0}
    for i in range(n, -1, -1):
        for j in range(min(m, i + bound // INSERT), max(0, i - bound // DELETE) - 1, -1):
            if (i, j) == (n, m) or least(i, j) + least(n - i, m - j) > bound:
                continue
            best = _NEVER
            if i < n:
                best = DELETE + rest.get((i + 1, j), _NEVER)
                if j < m:
                    best = min(best, _moves(turns[i], target[j]) + rest.get((i + 1, j + 1), _NEVER))
            if j < m and target[j] in ROLES and (i < n or last):
                best = min(best, INSERT + rest.get((i, j + 1), _NEVER))
            if best + least(i, j) <= bound:
                rest[i, j] = best
    cost = rest.get((0, 0), _NEVER)
    if cost > bound:
        return None
    audit, i, j = [], 0, 0
    while (i, j) != (n, m):
        left = rest[i, j]
        # in ASCII order: D, I, K, R
        if i < n and DELETE + rest.get((i + 1, j), _NEVER) == left:
            audit.append("D")
            i += 1
        elif j < m and target[j] in ROLES and (i < n or last) and INSERT + rest.get((i, j + 1), _NEVER) == left:
            audit.append("I")
            j += 1
        else:
            audit.append("K" if turns[i].lower() == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(audit)


def _ending(target: str, entry: str) -> str:
    return target[-1] if target else entry


@lru_cache(REMEMBERED)
def block_repairs(turns: str, entry: str, last: bool) -> dict[str, tuple[int, str]]:
    """The best (cost, audit) of a block's turns by the role initial that it ends with, from the one that it follows."""
    n = len(turns)
    best: dict[str, tuple[int, str]] = {}
    lengths = sorted(range(n + DELETE * n // INSERT + 3), key=lambda m: (abs(m - n), m))
    for length in lengths:
        for target in targets(entry, length):
            end = _ending(target, entry)
            if last and end not in ("", "a"):
                continue
            # deleting all turns, or inserting what is missing too, always works
            bound = best[end][0] if end in best else DELETE * n + INSERT * length
            found = align(turns, target, bound, last)
            if found and (end not in best or found < best[end]):
                best[end] = found
    return best


@lru_cache(REMEMBERED)
def plan(turns: str) -> tuple[int, str]:
    """(cost, audit) of the cheapest repair of a conversation, the least audit of equal ones."""
    blocks = [turns[i : i + BLOCK] for i in range(0, len(turns), BLOCK)] or [""]
    # per role initial that a block may follow: cost, place of its audit among the others, and the blocks' audits, the last first
    state: dict[str, tuple[int, int, tuple | None]] = {"": (0, 0, None)}
    for number, block in enumerate(blocks):
        reached: dict[str, tuple[int, int, str, tuple | None]] = {}
        for entry, (cost, place, before) in state.items():
            for end, (more, audit) in block_repairs(block, entry, number == len(blocks) - 1).items():
                found = (cost + more, place, audit, before)
                if end not in reached or found[:3] < reached[end][:3]:
                    reached[end] = found
        order = sorted(reached, key=lambda e: reached[e][1:3])
        state = {e: (reached[e][0], place, (reached[e][2], reached[e][3])) for place, e in enumerate(order)}
    cost, _, chain = min(state.values(), key=lambda s: s[:2])
    pieces = []
    while chain is not None:
        pieces.append(chain[0])
        chain = chain[1]
    return cost, "".join(reversed(pieces))


def repaired(roles: list[str], texts: list[str], audit: str) -> list[tuple[str, str]]:
    """(role, text) of the turns that an audit leaves."""
    out, i, entry = [], 0, ""
    for edit in audit:
        role, text = ROLES[_NEXT[entry]], ""
        if edit != "I":
            role, text = roles[i] if edit == "K" else role, texts[i]
            i += 1
        if edit != "D":
            out.append((role, text))
            entry = role[:1]
    return out


_SPACE, _ENDS = " \t\n\v\f\r", tuple(".!?")
_COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def faults(turns: list[dict]) -> tuple[str, dict[str, int]]:
    """The turns as align() takes them, and their counts of faults, of rows (turn, role, text) in order."""
    signature, count, said, before = [], dict.fromkeys(_COLUMNS, 0), set(), None
    for t in turns:
        role, text = t["role"], t["text"].strip(_SPACE)
        initial = role[:1] if role[:1] in ("u", "a", "s") else "o"
        fault = "blank" if not text else "duplicate" if (role, t["text"]) in said else "truncated" if not text.endswith(_ENDS) else None
        if fault:
            count[fault] += 1
        signature.append("x" if fault in ("blank", "duplicate") else initial.upper() if fault else initial)
        said.add((role, t["text"]))
        count["illegal"] += before is not None and before + role[:1] not in ("su", "ua", "au")
        before = role[:1]
    numbers = {t["turn"] for t in turns} - {None}
    if numbers:
        count["gaps"] = max(numbers) - min(numbers) + 1 - len(numbers)
    return "".join(signature), count


def _repair_rows(batches):
    shape = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for batch in batches:
        counts, audits, kept = [], [], []
        for turns in batch.column("turns").to_pylist():
            signature, count = faults(turns)
            count["cost"], audit = plan(signature)
            counts.append(count)
            audits.append(audit)
            kept.append([{"role": r, "text": x} for r, x in repaired([t["role"] for t in turns], [t["text"] for t in turns], audit)])
        columns = [pa.array([c[name] for c in counts], pa.int64()) for name in _COLUMNS]
        yield pa.RecordBatch.from_arrays([batch.column("conv"), *columns, pa.array(audits, pa.string()), pa.array(kept, shape)], ["conv", *_COLUMNS, "audit", "messages"])


def repair_conversations(rows: DataFrame) -> DataFrame:
    r"""(conv, gaps, blank, duplicate, truncated, illegal, cost, audit, messages) of rows (conv, turn, role, text): one row a conversation.

    Turns stand in the order of `turn` (null first), then role and text. A turn's first
    fault counts: blank (only white space, `[\x20\x09-\x0D]`), duplicate (an earlier turn
    has its role and text), truncated (the last character but white space is none of
    `.!?`). `gaps` are the numbers that the turns lack between the least and the largest,
    `illegal` the neighbours whose role initials are not su, ua or au. Null roles and texts
    are one space; rows of a null conversation are one conversation, and repeated rows are
    turns of their own. Extra columns are passed over. A conversation is one training
    sample and becomes one row, so its turns meet in one task.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    conversations = rows.select("conv", turn.alias("t")).groupBy("conv").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    kind = conversations.schema["conv"].dataType.simpleString()
    return conversations.mapInArrow(_repair_rows, f"conv {kind}, {', '.join(f'{c} long' for c in _COLUMNS)}, audit string, messages array<struct<role:string,text:string>>")
