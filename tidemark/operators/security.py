"""Injection scans over text columns and query logs. Scans are map-only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.operators.ordered import running

# The ten substrings of the basic scan, in the order they are tried.
SUBSTRINGS = ["';", "--", "DROP ", "DELETE ", "INSERT ", "UPDATE ", "/*", "*/", "xp_", "sp_"]

# The patterns of the full scan as (family, text that must occur, regular expression).
PATTERNS = [
    ("statement", ";", r";\s*DROP\s+"),
    ("statement", ";", r";\s*DELETE\s+"),
    ("statement", ";", r";\s*UPDATE\s+"),
    ("statement", ";", r";\s*INSERT\s+"),
    ("statement", ";", r";\s*CREATE\s+"),
    ("statement", ";", r";\s*ALTER\s+"),
    ("statement", ";", r";\s*TRUNCATE\s+"),
    ("comment", "--", r"--"),
    ("comment", "/*", r"/\*.*\*/"),
    ("comment", "#", r"#"),
    ("logic", "'", r"'\s*OR\s+'1'\s*=\s*'1"),
    ("logic", "'", r"'\s*OR\s+1\s*=\s*1"),
    ("logic", "'", r"'\s*OR\s+'[^']+'\s*=\s*'"),
    ("union", "UNION", r"UNION\s+SELECT"),
    ("union", "UNION", r"UNION\s+ALL\s+SELECT"),
    ("procedure", "EXEC", r"EXEC\s*\("),
    ("procedure", "EXECUTE", r"EXECUTE\s*\("),
    ("procedure", "XP_", r"xp_"),
    ("procedure", "SP_", r"sp_"),
    ("time", "WAITFOR", r"WAITFOR\s+DELAY"),
    ("time", "SLEEP", r"SLEEP\s*\("),
    ("time", "BENCHMARK", r"BENCHMARK\s*\("),
    ("condition", "IF", r"IF\s*\("),
    ("condition", "CASE", r"CASE\s+WHEN"),
]
ALLOWED = ["DROP Shipping LLC", "UPDATE Corporation", "DELETE Industries"]
BLOCKED_VALUE = "INVALID_INPUT"
FORBIDDEN_WORDS = ["DROP", "DELETE", "TRUNCATE", "ALTER", "CREATE"]
ATTACK_COUNT, ATTACK_SECONDS = 5, 60


def _upper_once(rows: DataFrame, text: str) -> DataFrame:
    """The upper-case text as a column of its own: it is searched many times but made once."""
    return rows.withColumn("_upper", F.upper(text))


def basic_scan(rows: DataFrame, text: str, out: str = "matched_pattern", allowed: Sequence[str] = ()) -> DataFrame:
    """Adds the first of the ten substrings found, ignoring case; null for a clean or allowed value."""
    found = first_match([(F.contains("_upper", F.lit(p.upper())), p) for p in SUBSTRINGS])
    if allowed:
        found = F.when(~F.col(text).isin(list(allowed)), found)
    return _upper_once(rows, text).withColumn(out, found).drop("_upper")


def regex_scan(rows: DataFrame, text: str, family: str = "matched_family", pattern: str = "matched_pattern") -> DataFrame:
    """Adds family and pattern of the first regular expression found, null when none is.

    A plain search for the text a pattern needs comes first; the regular expression runs only on
    values that contain it.
    """
    match = first_match([
        (
            F.contains("_upper" if needed.isalpha() or "_" in needed else text, F.lit(needed)) & F.col(text).rlike(f"(?i){expression}"),
            F.struct(F.lit(kind).alias("family"), F.lit(expression).alias("pattern")),
        )
        for kind, needed, expression in PATTERNS
    ])
    matched = _upper_once(rows, text).withColumn("_match", match).drop("_upper")
    return matched.withColumns({family: F.col("_match.family"), pattern: F.col("_match.pattern")}).drop("_match")


def block_values(rows: DataFrame, value: str, allowed: Sequence[str] = ()) -> DataFrame:
    """Replaces flagged values and keeps the original and the pattern beside them."""
    scanned = basic_scan(rows, value, "matched_pattern", allowed)
    hit = F.col("matched_pattern").isNotNull()
    return scanned.withColumn("old_value", F.col(value)).withColumn(
        value, F.when(hit, BLOCKED_VALUE).otherwise(F.col(value))
    ).withColumn("security_violation", hit)


def repeat_attackers(
    hits: DataFrame, source: str, when: str, least: int = ATTACK_COUNT, seconds: int = ATTACK_SECONDS
) -> DataFrame:
    """Moments at which a source had at least ``least`` hits in the trailing ``seconds``.

    Every moment's hits enter when they happen and leave ``seconds`` later; the running sum of both is
    the trailing count. It is taken in even ranges of (source, time), so neither a busy source nor a
    busy minute lands in one task.
    """
    moments = hits.groupBy(source, when).agg(F.count(F.lit(1)).alias("_n")).withColumn(
        "_at", F.unix_micros(F.col(when).cast("timestamp"))
    )
    enter = moments.select(source, when, "_at", "_n", F.lit(1).alias("_turn"))
    leave = moments.select(
        source, when, (F.col("_at") + seconds * 1_000_000).alias("_at"), (-F.col("_n")).alias("_n"), F.lit(0).alias("_turn")
    )
    order = ["_at", "_turn"]
    counted = running(enter.unionByName(leave), [source], order, {"attacks": ("sum", F.col("_n"))})
    return counted.filter((F.col("_turn") == 1) & (F.col("attacks") >= least)).select(source, when, "attacks")


def query_log_guard(log: DataFrame, text: str) -> DataFrame:
    """Adds what is wrong with a statement: a forbidden word (as a whole word), a missing LIMIT."""
    words = "|".join(FORBIDDEN_WORDS)
    return log.withColumns({
        "forbidden": F.nullif(F.upper(F.regexp_extract(F.col(text), rf"(?i)\b({words})\b", 1)), F.lit("")),
        "no_limit": ~F.col(text).rlike(r"(?i)\blimit\b"),
    })
