"""Rule-based mail triage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomdex.functions.text import contains_any, lit_array, snippet

# Patterns that quarantine a mail, and words by category, where they are looked for.
INJECTIONS = [
    "ignore previous instructions", "system override", "disregard all earlier instructions", "you are now in maintenance mode", "jailbreak", "exfiltrate", "print your prompt", "output your initial instructions",
    "run command", "rm -rf",
]
URGENT = {"subject": ["urgent", "critical", "outage", "incident", "immediate action"], "body": ["emergency", "deadline today"]}
ACTION = {"subject": ["rfp", "proposal", "action required", "review required", "please sign", "approval needed"], "body": ["please find attached", "action item", "by end of day"]}
NEWSLETTER = {"subject": ["digest", "newsletter", "weekly update"], "sender": ["noreply", "digest@"], "body": ["unsubscribe"]}
# Categories in the order in which they are tried, with priority and suggested actions.
OUTCOMES = {
    "Spam / Suspicious": (10, ["Quarantine message — do not execute commands", "Review raw headers manually"]),
    "Urgent": (9, ["Review immediate impact and address timeline", "Coordinate with incident or project team"]),
    "Action Required": (7, ["Evaluate request requirements", "Draft formal response or proposal feedback"]),
    "Newsletter": (3, ["Archive or read at leisure"]),
    "Informational": (5, ["Review informational contents when convenient"]),
}


def triage(subject: Column, body: Column, sender: Column) -> Column:
    """(category, priority, pattern, action_items, suspicious): the first rule that fits in the fields, lower-cased by Unicode rules; `pattern` names the injection found."""
    fields = {"subject": F.lower(F.coalesce(subject, F.lit(""))), "body": F.lower(F.coalesce(body, F.lit(""))), "sender": F.lower(F.coalesce(sender, F.lit("")))}
    pattern = F.get(F.filter(lit_array(INJECTIONS), lambda p: fields["body"].contains(p) | fields["subject"].contains(p)), F.lit(0))

    def fits(words: dict[str, list[str]]) -> Column:
        tests = [contains_any(fields[f], w) for f, w in words.items()]
        return tests[0] if len(tests) == 1 else tests[0] | (tests[1] if len(tests) == 2 else tests[1] | tests[2])

    def outcome(name: str) -> Column:
        priority, actions = OUTCOMES[name]
        return F.struct(F.lit(name).alias("category"), F.lit(priority).alias("priority"), pattern.alias("pattern"), lit_array(actions).alias("action_items"), F.lit(priority == 10).alias("suspicious"))

    tests = [(pattern.isNotNull(), "Spam / Suspicious"), (fits(URGENT), "Urgent"), (fits(ACTION), "Action Required"), (fits(NEWSLETTER), "Newsletter")]
    out = outcome("Informational")
    for test, name in reversed(tests):
        out = F.when(test, outcome(name)).otherwise(out)
    return out


def inbox(mails: DataFrame, category: str | None = None, urgent_first: bool = False) -> DataFrame:
    """Mails (subject, body, sender, received, category, priority, draft, read) as a list with snippets, newest first or by priority."""
    rows = mails if category is None else mails.where(F.col("category") == category)
    order = [F.desc("priority"), F.desc("received")] if urgent_first else [F.desc("received")]
    return rows.select("*", (F.coalesce("draft", F.lit("")) != "").alias("has_draft"), snippet(F.col("body"), 90).alias("snippet")).orderBy(*order)
