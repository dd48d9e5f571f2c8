"""Audit of a log of value changes: loops, invented values and drift.

A log row has ``run``, ``seq`` (dense position within the run), ``field``, ``old_value``,
``new_value``, ``type`` and ``confidence``. Looks at earlier rows go through ``ordered``, which cuts
long runs into chunks, or through counts and first positions, which are plain aggregations; a run
that owns a third of the log is spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import cosine_distance, digit_overlap, normalize_value, parse_amount, share
from tidemark.operators.ordered import join_null_safe, last_before, with_previous

TRIPLE = ["field", "old_value", "new_value"]

# Limits of the checks, words that mark a date field, and value patterns.
LOOP_WINDOW = 3
MAX_STEPS = 50
HISTORY_KEPT = 100
LEAST_CONFIDENCE = 0.7
LEAST_DIGIT_OVERLAP = 0.5
LONGEST_ID = 50
REJECTION_ALERT = 0.05
DOMINANT_SHARE = 0.30
RECENT_ROWS = 5
EMBEDDING_LIMIT = 0.15
THRESHOLDS = [0.5, 0.7, 0.8, 0.9]
DATE_WORDS = ["date", "dob", "birth", "created", "updated"]
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$"
PHONE_PATTERN = r"^[0-9\s()\-+.]+$"


def _same(earlier: str, columns: Sequence[str] = TRIPLE) -> Column:
    same = F.col(earlier).isNotNull()
    for name in columns:
        same = same & F.col(name).eqNullSafe(F.col(f"{earlier}.{name}"))
    return same


def windowed_loop(log: DataFrame, window: int = LOOP_WINDOW) -> DataFrame:
    """Flags rows equal to one of the ``window - 1`` rows before; a run must have that many rows."""
    depth = window - 1
    seen = with_previous(log, ["run"], "seq", TRIPLE, depth)
    hit = F.lit(False)
    for i in range(1, depth + 1):
        hit = hit | _same(f"prev_{i}")
    return seen.withColumn("is_loop", hit & (F.col("seq") >= window)).drop(*[f"prev_{i}" for i in range(1, depth + 1)])


def repeat_loop(log: DataFrame) -> DataFrame:
    """Flags rows equal to the row just before."""
    return windowed_loop(log, 2)


def any_loop(log: DataFrame, window: int = 5) -> DataFrame:
    """Flags rows whose last ``window`` rows (their own included) hold two equal ones."""
    seen = with_previous(log, ["run"], "seq", TRIPLE, window - 1)
    rows = [F.struct(*TRIPLE), *[F.col(f"prev_{i}") for i in range(1, window)]]
    present = F.filter(F.array(*rows), lambda r: r.isNotNull())
    return seen.withColumn("is_loop", F.size(F.array_distinct(present)) < F.size(present)).drop(
        *[f"prev_{i}" for i in range(1, window)]
    )


def exact_repeat(log: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Flags rows whose triple came earlier in the run, and gives the last accepted value before."""
    first = log.groupBy("run", *TRIPLE).agg(F.min("seq").alias("_first"))
    marked = join_null_safe(log, first, ["run", *TRIPLE]).withColumn("rejected", F.col("seq") > F.col("_first"))
    kept = F.when(~F.col("rejected"), F.col("new_value"))
    cell = F.floor(F.col("seq") / chunk)
    return last_before(marked.drop("_first"), ["run"], ["seq"], kept, "last_accepted", cell)


def equivalent_repeat(log: DataFrame) -> DataFrame:
    """``repeat_loop`` after the new values are normalized."""
    normalized = log.withColumn("_plain", F.col("new_value")).withColumn("new_value", normalize_value(F.col("new_value")))
    return repeat_loop(normalized).withColumn("new_value", F.col("_plain")).drop("_plain")


def over_limit(log: DataFrame, limit: int = MAX_STEPS) -> DataFrame:
    """Runs with more than ``limit`` steps."""
    return log.groupBy("run").agg(F.count(F.lit(1)).alias("steps")).withColumn("exceeded", F.col("steps") > limit)


def history_tail(log: DataFrame, kept: int = HISTORY_KEPT) -> DataFrame:
    """The last rows of each run, by position from its end."""
    ends = log.groupBy("run").agg(F.max("seq").alias("_end"))
    return log.join(ends, "run").filter(F.col("seq") > F.col("_end") - kept).drop("_end")


def confident(confidence: Column, least: float = LEAST_CONFIDENCE) -> Column:
    """A missing confidence counts as certain."""
    return F.coalesce(confidence, F.lit(1.0)) >= least


def _named(field: Column, words: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(F.lower(field), F.lit(word))
    return hit


def digits_kept(field: Column, old: Column, new: Column, words: Sequence[str] = tuple(DATE_WORDS)) -> Column:
    """Date-like fields keep at least half of their digits; passes when either side has none."""
    overlap = digit_overlap(old, new)
    return ~_named(field, words) | overlap.isNull() | (overlap >= LEAST_DIGIT_OVERLAP)


def is_id_field(field: Column, strict: bool = False) -> Column:
    """Fields that hold identifiers: any name with ``id`` in it, or (strict) ``id`` and ``…_id`` only."""
    return F.lower(field).rlike("(^|_)id$") if strict else _named(field, ["id"])


def field_semantics_ok(field: Column, new: Column, strict_ids: bool = False) -> Column:
    """New values of e-mail, id and phone fields still look like one."""
    email = ~_named(field, ["email"]) | new.rlike(EMAIL_PATTERN)
    ident = ~is_id_field(field, strict_ids) | ((F.length(new) <= LONGEST_ID) & ~F.contains(new, F.lit(" ")))
    phone = ~_named(field, ["phone"]) | new.rlike(PHONE_PATTERN)
    return email & ident & phone


def username_kept(old: Column, new: Column) -> Column:
    return F.split_part(old, F.lit("@"), F.lit(1)) == F.split_part(new, F.lit("@"), F.lit(1))


def price_kept(old: Column, new: Column) -> Column:
    """New amount within a fifth of the old one; false when either is no number."""
    ratio = F.try_divide(parse_amount(new), parse_amount(old))
    return F.coalesce(ratio.between(0.8, 1.2), F.lit(False))


def numeric_ok(field: Column, new: Column) -> Column:
    """Revenue and amount fields stay digits, apart from dots and dashes."""
    return ~_named(field, ["revenue", "amount"]) | F.regexp_replace(new, "[.-]", "").rlike("^[0-9]+$")


def iso_code_ok(field: Column, new: Column) -> Column:
    return ~_named(field, ["country", "region"]) | (F.length(new) == 2)


def value_ok(field: Column, old: Column, new: Column) -> Column:
    """The per-field rule: digits for dates, user name for e-mail, size for prices."""
    return first_match(
        [
            (_named(field, DATE_WORDS), digits_kept(field, old, new)),
            (_named(field, ["email"]), username_kept(old, new)),
            (_named(field, ["price"]), price_kept(old, new)),
        ],
        True,
    )


def gate_metrics(rows: DataFrame, confident_enough: Column, meaning_kept: Column, by: Sequence[str] = ()) -> DataFrame:
    """Accepted and rejected rows, each rejection counted at the first gate it fails."""
    total = F.count(F.lit(1))
    accepted = F.count_if(confident_enough & meaning_kept)
    counted = rows.groupBy(*by).agg(
        total.alias("total"),
        accepted.alias("accepted"),
        F.count_if(~confident_enough).alias("rejected_confidence"),
        F.count_if(confident_enough & ~meaning_kept).alias("rejected_semantics"),
        share(accepted, total).alias("acceptance_rate"),
    )
    rejected = F.col("rejected_confidence") + F.col("rejected_semantics")
    return counted.withColumn("alert", share(rejected, F.col("total")) > REJECTION_ALERT)


def threshold_sweep(rows: DataFrame, confidence: Column, invented: Column, thresholds: Sequence[float] = tuple(THRESHOLDS)) -> DataFrame:
    """Invented values let through and good values refused at each threshold, in one pass."""
    counted = rows.agg(*[
        measure.alias(f"{name}_{i}")
        for i, least in enumerate(thresholds)
        for name, measure in (
            ("missed", F.count_if(confident(confidence, least) & invented)),
            ("refused", F.count_if(~confident(confidence, least) & ~invented)),
        )
    ])
    listed = F.array(*[
        F.struct(F.lit(least).alias("threshold"), F.col(f"missed_{i}").alias("missed"), F.col(f"refused_{i}").alias("refused"))
        for i, least in enumerate(thresholds)
    ])
    return counted.select(F.inline(listed))


def type_switch_drift(log: DataFrame) -> DataFrame:
    """Runs of three or more rows whose last two types differ.

    Each row carries the type before it, so the last row of a run is all that is needed: one maximum.
    """
    typed = log.select("run", "seq", F.coalesce("type", F.lit("")).alias("type"))
    seen = with_previous(typed, ["run"], "seq", ["type"])
    last = seen.groupBy("run").agg(F.max(F.struct("seq", "type", F.col("prev_1.type").alias("before"))).alias("_last"))
    switched = (F.col("_last.seq") >= 3) & (F.col("_last.type") != F.col("_last.before"))
    return last.select("run", F.col("_last.seq").alias("rows"), F.coalesce(switched, F.lit(False)).alias("drift"))


def type_shares(log: DataFrame) -> DataFrame:
    """Rows, first position and share of each type per run; the window runs over the counts."""
    counted = log.groupBy("run", F.coalesce("type", F.lit("unknown")).alias("type")).agg(
        F.count(F.lit(1)).alias("rows"), F.min("seq").alias("first_seq")
    )
    total = F.sum("rows").over(Window.partitionBy("run"))
    return counted.select("*", total.alias("run_rows"), share(F.col("rows"), total).alias("share"))


def type_dominance_drift(log: DataFrame, limit: float = DOMINANT_SHARE) -> DataFrame:
    """Types with more than ``limit`` of a run of five or more rows."""
    return type_shares(log).filter((F.col("run_rows") >= RECENT_ROWS) & (F.col("share") > limit)).drop("first_seq")


def new_type_drift(log: DataFrame, recent: int = RECENT_ROWS) -> DataFrame:
    """Types whose first row is among the last ``recent`` of a run that has at least as many."""
    shares = type_shares(log).filter(F.col("run_rows") >= recent)
    return shares.filter(F.col("first_seq") > F.col("run_rows") - recent).select("run", "type", "first_seq")


def embedding_drift(pairs: DataFrame, old: str, new: str, limit: float = EMBEDDING_LIMIT) -> DataFrame:
    """Cosine distance of paired vectors and whether it exceeds the limit."""
    distance = cosine_distance(F.col(old), F.col(new))
    return pairs.withColumn("distance", distance).withColumn("drift", F.col("distance") > limit).drop(old, new)


def value_meaning_drift(rows: DataFrame, period: str, value: str) -> DataFrame:
    """Share of each code value per period and its change; joins and windows see counts only."""
    counted = rows.groupBy(period, value).agg(F.count(F.lit(1)).alias("rows"))
    totals = counted.groupBy(period).agg(F.sum("rows").alias("_total"))
    shares = counted.join(totals, period).withColumn("share", share(F.col("rows"), F.col("_total"))).drop("_total")
    before = F.lag("share").over(Window.partitionBy(value).orderBy(period))
    return shares.withColumn("change", F.col("share") - before)
