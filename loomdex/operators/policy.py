"""Policy decisions on requests, paths, audit and undo logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomdex.functions.text import contains_any

# Tiers of action kinds.
TIERS = {
    "T0": ["read_file", "list_directory", "library_stats", "browser_snapshot", "browser_close", "desktop_snapshot"],
    "T1": ["write_draft"],
    "T2": ["overwrite_file", "delete_file", "rename_file", "browser_navigate", "browser_click", "browser_type", "desktop_launch_app", "desktop_click", "desktop_type", "desktop_hotkey"],
    "T3": ["execute_command", "network_request"],
    "Blocked": ["modify_config", "access_credentials", "access_system_path"],
}
# Actions on paths.
PATH_ACTIONS = ["read_file", "list_directory", "write_draft", "overwrite_file", "delete_file", "rename_file"]
# Substrings of sensitive paths, system folders, device names.
SENSITIVE = [".ssh", ".aws", ".gnupg", ".git/config", ".git/credentials", ".git-credentials", ".netrc", ".env", "id_rsa", "id_ed25519", "known_hosts", "authorized_keys", ".bashrc", ".zshrc", ".profile", ".bash_profile"]
SYSTEM_ROOTS = ["/etc", "/usr", "/bin", "/sbin", "/var/run", "/dev", "/proc", "/sys"]
DEVICES = r"(?i)(?:^|/)\s*(?:CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])\s*(?:\.[^/]*)?(?:/|\z)"


def path_verdict(path: Column, root: str) -> Column:
    """Why a path may not be used, null if it may: null byte, sensitive, system, device, or it leaves the root.

    Rules look at the text only: no file system is asked. `..` counts against the
    folders before it; an absolute path has to lie below the root.
    """
    lower = F.lower(path)
    depth = F.aggregate(
        F.filter(F.split(path, "/"), lambda p: (p != "") & (p != ".")),
        F.struct(F.lit(0).alias("depth"), F.lit(0).alias("least")),
        lambda s, p: F.struct((s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("depth"), F.least(s["least"], s["depth"] + F.when(p == "..", -1).otherwise(1)).alias("least")),
    )["least"]
    absolute = path.startswith("/") & ~((path == root) | path.startswith(root + "/"))
    system = F.lit(False)
    for r in SYSTEM_ROOTS:
        system = system | (lower == r) | lower.startswith(r + "/")
    climbs = F.when(path.startswith(root + "/"), F.substr(path, F.lit(len(root) + 2)).rlike(r"(?:^|/)\.\.(?:/|\z)")).otherwise(depth < 0)
    return F.when(path.contains("\x00"), "null byte").when(contains_any(lower, SENSITIVE), "sensitive").when(system, "system").when(path.rlike(DEVICES), "device").when(absolute | climbs, "outside")


def decide(requests: DataFrame, root: str) -> DataFrame:
    """Requests (action, trusted, path) with tier, decision and reason: the first rule that fits.

    Untrusted sources are rejected, blocked tiers and bad paths denied, T2 and T3 held
    for confirmation, the rest allowed. Unknown actions have no tier and are denied.
    """
    spark = requests.sparkSession
    tiers = spark.createDataFrame([(a, t) for t, actions in TIERS.items() for a in actions], "action string, tier string")
    rows = requests.join(F.broadcast(tiers), "action", "left")
    bad = F.when(F.col("action").isin(PATH_ACTIONS), path_verdict(F.col("path"), root))
    tier = F.col("tier")
    decision = F.when(~F.col("trusted"), "Rejected").when(tier.isNull() | (tier == "Blocked"), "Denied").when(bad.isNotNull(), "Denied").when(tier.isin("T2", "T3"), "Confirmed").otherwise("Allowed")
    reason = F.when(~F.col("trusted"), "untrusted source").when(tier.isNull() | (tier == "Blocked"), "blocked").when(bad.isNotNull(), bad).when(tier.isin("T2", "T3"), "held").otherwise("allowed")
    return rows.withColumns({"decision": decision, "reason": reason})


def audit_recent(log: DataFrame, n: int) -> DataFrame:
    """The newest entries of a log (id, ts, ...)."""
    return log.orderBy(F.desc("ts"), F.desc("id")).limit(n)


def restore_state(journal: DataFrame) -> DataFrame:
    """(target, id, before, existed): of each target the newest entry (id, ts, target, before, undone) that is not undone yet."""
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc("ts"), F.desc("id")))
    rows = journal.where(~F.col("undone")).withColumn("place", place).where("place = 1")
    return rows.select("target", "id", "before", F.col("before").isNotNull().alias("existed"))
