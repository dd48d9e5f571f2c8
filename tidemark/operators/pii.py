"""Personal data: found by column name and by value, catalogued, located and erased.

Value scans count matches of every pattern in one pass over a table, for all its text columns at
once: one partial aggregate per column and pattern, no row is moved.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import parse_date, share
from tidemark.operators.analytics import union_tables

# Words in column names, value patterns with the confidence a match gives, and limits.
NAME_WORDS = [
    ("EMAIL", ["email", "e_mail"]),
    ("PHONE", ["phone", "mobile"]),
    ("SSN", ["ssn", "social_security"]),
    ("CREDIT_CARD", ["credit_card", "card_number"]),
    ("IP_ADDRESS", ["ip_address", "ip_addr"]),
    ("DATE_OF_BIRTH", ["dob", "birth"]),
    ("ADDRESS", ["address", "street", "zip"]),
    ("NAME", ["first_name", "last_name", "full_name"]),
]
NAME_CONFIDENCE = 0.90
VALUE_PATTERNS = {  # type: whole-value pattern, confidence
    "EMAIL": (r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$", 0.95),
    "SSN": (r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$", 0.95),
    "CREDIT_CARD": (r"^[0-9]{4}([ -]?[0-9]{4}){3}$", 0.95),
    "IP_ADDRESS": (r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$", 0.95),
    "PHONE": (r"^[+]?[(]?[0-9]{3}[)]?[ .-]?[0-9]{3}[ .-]?[0-9]{4}$", 0.95),
}
EMBEDDED_EMAIL = r"[A-Za-z0-9._%+-]@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"  # one character before the @ is enough to tell
EMBEDDED_CONFIDENCE = 0.85
IDENTIFIER_CHARACTERS = "A-Za-z0-9._%+@-"
LONGEST_NUMBER = 21  # no value pattern but that of e-mail matches more than 19 characters and a line end
BIRTH_CONFIDENCE = 0.75
YOUNGEST, OLDEST = 18, 80
MOST_VALUES = 0.5
STRONG = 0.8
CONTAINS_FROM = 0.5
USER_ID_COLUMN = r"^uid_|_user_id$"
USER_ID_VALUE = r"^uid_[0-9]{10}$"
USER_ID_CONFIDENCE = 0.90


def type_by_name(column: Column) -> Column:
    """Type suggested by the words in a column name; null when there is none."""
    lowered = F.lower(column)
    rules = []
    for kind, words in NAME_WORDS:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        rules.append((hit, kind))
    return first_match(rules)


def by_column_name(columns: DataFrame, name: str) -> DataFrame:
    kind = type_by_name(F.col(name))
    return columns.withColumn("name_type", kind).withColumn(
        "name_confidence", F.when(F.col("name_type").isNotNull(), NAME_CONFIDENCE).otherwise(0.0)
    )


def _is_birth_date(value: Column, as_of: Column) -> Column:
    born = parse_date(value, ["yyyy-MM-dd", "MM/dd/yyyy"])
    return F.coalesce(F.floor(F.months_between(as_of, born) / 12).between(YOUNGEST, OLDEST), F.lit(False))


def scan_values(table: str, df: DataFrame, columns: Sequence[str], as_of: str) -> DataFrame:
    """Per column: values, and how many match each pattern. One pass, then one row per column."""
    day = F.lit(as_of).cast("date")
    measures = {}
    for c in columns:
        value = F.col(c).cast("string")
        # A quick look for a needed character keeps the regular expressions off long texts.
        measures[(c, "values")] = F.count(value)
        for kind, (pattern, _) in VALUE_PATTERNS.items():
            possible = F.contains(value, F.lit("@")) if kind == "EMAIL" else F.length(value) <= LONGEST_NUMBER
            measures[(c, kind)] = F.count_if(possible & value.rlike(pattern))
        measures[(c, "IN_TEXT")] = F.count_if(F.contains(value, F.lit("@")) & value.rlike(EMBEDDED_EMAIL))
        measures[(c, "DATE_OF_BIRTH")] = F.count_if((F.length(value) == 10) & _is_birth_date(value, day))
        measures[(c, "USER_ID")] = F.count_if((F.length(value) == 14) & value.rlike(USER_ID_VALUE))
    counted = df.agg(*[m.alias(f"{c}__{kind}") for (c, kind), m in measures.items()])
    kinds = ["values", *VALUE_PATTERNS, "IN_TEXT", "DATE_OF_BIRTH", "USER_ID"]
    rows = F.array(*[
        F.struct(F.lit(table).alias("table"), F.lit(c).alias("column"), *[F.col(f"{c}__{k}").alias(k) for k in kinds])
        for c in columns
    ])
    return counted.select(F.inline(rows))


def scan_tables(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], as_of: str) -> DataFrame:
    return union_tables([scan_values(name, df, columns, as_of) for name, (df, columns) in tables.items()])


def by_values(scans: DataFrame) -> DataFrame:
    """Type, confidence and reason (``k/n``) per scanned column: the first pattern that most values match."""
    values = F.col("values")

    def most(kind: str) -> Column:
        return share(F.col(kind), values) > MOST_VALUES

    rules = [(most(kind), kind, confidence, kind) for kind, (_, confidence) in VALUE_PATTERNS.items()]
    rules += [
        (most("USER_ID") & F.col("column").rlike(USER_ID_COLUMN), "USER_ID", USER_ID_CONFIDENCE, "USER_ID"),
        (most("IN_TEXT"), "EMAIL", EMBEDDED_CONFIDENCE, "IN_TEXT"),
        (most("DATE_OF_BIRTH"), "DATE_OF_BIRTH", BIRTH_CONFIDENCE, "DATE_OF_BIRTH"),
    ]
    verdict = first_match(
        [
            (hit, F.struct(F.lit(kind).alias("t"), F.lit(c).alias("c"), F.col(counted).alias("k")))
            for hit, kind, c, counted in rules
        ]
    )
    return scans.withColumn("_v", verdict).select(
        "table",
        "column",
        F.col("_v.t").alias("value_type"),
        F.coalesce("_v.c", F.lit(0.0)).alias("value_confidence"),
        F.concat(F.col("_v.k").cast("string"), F.lit("/"), values.cast("string")).alias("reason"),
    )


def classify(found: DataFrame) -> DataFrame:
    """Values decide when sure, then the name when sure, then the surer of the two."""
    named = by_column_name(found, "column")
    by_value = (F.col("value_confidence") >= STRONG) | (
        (F.col("name_confidence") < STRONG) & (F.col("value_confidence") >= F.col("name_confidence"))
    )
    return named.select(
        "table",
        "column",
        F.when(by_value, F.col("value_type")).otherwise(F.col("name_type")).alias("pii_type"),
        F.when(by_value, F.col("value_confidence")).otherwise(F.col("name_confidence")).alias("confidence"),
        F.when(by_value, F.col("reason"))
        .otherwise(F.concat(F.lit("Column name '"), "column", F.lit("' suggests "), "name_type"))
        .alias("reason"),
    ).withColumn("contains_pii", F.col("confidence") >= CONTAINS_FROM)


def with_samples(classified: DataFrame, samples: DataFrame) -> DataFrame:
    """Adds up to three example values per column; ``samples`` comes from ``column_sample(..., most=3)``."""
    listed = samples.groupBy("table", "column").agg(F.array_sort(F.collect_set("value")).alias("sample_values"))
    return classified.join(listed, ["table", "column"], "left")


def catalog_summary(classified: DataFrame) -> DataFrame:
    """Fields and tables per type."""
    return classified.filter("contains_pii").groupBy("pii_type").agg(
        F.count(F.lit(1)).alias("fields"), F.count_distinct("table").alias("tables")
    )


def subject_pattern(identifier: Column) -> Column:
    """A regular expression for the identifier standing alone: as a whole value, or inside text or JSON
    with no further identifier character beside it. A full stop that ends a sentence may follow.
    """
    quoted = F.regexp_replace(identifier, r"([\x21-\x2f\x3a-\x40\x5b-\x5e\x60\x7b-\x7e])", r"\\$1")
    other = f"[^{IDENTIFIER_CHARACTERS}]"
    return F.concat(F.lit(f"(^|{other})"), quoted, F.lit(f"($|{other}|\\.($|[^A-Za-z0-9_]))"))


def holds_subject(column: Column, identifier: Column) -> Column:
    """Whether a value is, or contains as a whole, the identifier; a plain search spares most regular expressions."""
    value = column.cast("string")
    return F.coalesce(F.contains(value, identifier) & F.regexp_like(value, subject_pattern(identifier)), F.lit(False))


def find_subject(tables: Mapping[str, tuple[DataFrame, Sequence[str]]], identifier: Column) -> DataFrame:
    """(table, column) pairs that hold the identifier (``holds_subject``), nested text included, with row counts."""
    parts = []
    for name, (df, columns) in tables.items():
        counted = df.agg(*[F.count_if(holds_subject(F.col(c), identifier)).alias(c) for c in columns])
        rows = F.array(*[
            F.struct(F.lit(name).alias("table"), F.lit(c).alias("column"), F.col(c).alias("rows")) for c in columns
        ])
        parts.append(counted.select(F.inline(rows)))
    return union_tables(parts).filter("rows > 0")


def erasure_plan(locations: DataFrame, identifier: Column) -> DataFrame:
    """A statement per location, with the condition of ``erase_subject``; quotes are doubled."""
    safe = F.replace(subject_pattern(identifier), F.lit("'"), F.lit("''"))
    return locations.withColumn(
        "statement",
        F.concat(
            F.lit("DELETE FROM "), "table", F.lit(" WHERE regexp_like("), "column", F.lit(", '"), safe, F.lit("');")
        ),
    )


def erase_subject(df: DataFrame, columns: Sequence[str], identifier: Column) -> DataFrame:
    """The table without the rows that hold the identifier; rows of other people stay."""
    hit = F.lit(False)
    for c in columns:
        hit = hit | holds_subject(F.col(c), identifier)
    return df.filter(~hit)


def merge_catalogs(catalogs: Mapping[str, DataFrame]) -> DataFrame:
    """Regional catalogs as one, tagged with their region."""
    return union_tables([df.withColumn("region", F.lit(region)) for region, df in catalogs.items()])
