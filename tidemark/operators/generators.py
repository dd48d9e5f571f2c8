"""Deterministic test-data tables: every column is a formula over ``id``.

Each generator takes a DataFrame with a bigint ``id`` column (``ids`` makes one), so it runs as one
map-only stage whatever the size. The formulas are part of the contract: the same id always gives
the same row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.rules import banded, first_match, keyed, padded, pick

# Shares of id % 100, lists of names, and the numbers in the formulas below.
SEGMENT_BANDS = [(15, "Enterprise"), (50, "Mid-Market")]
INDUSTRY_BANDS = [(30, "Technology"), (55, "Finance"), (75, "Healthcare"), (85, "Retail"), (92, "Manufacturing")]
REGION_BANDS = [(25, "Northeast"), (48, "West"), (78, "South")]
STATE_BANDS = {
    "Northeast": ([(4, "NY"), (7, "MA"), (9, "PA")], "NJ"),
    "West": ([(5, "CA"), (8, "WA")], "OR"),
    "South": ([(4, "TX"), (7, "FL")], "GA"),
    "Midwest": ([(5, "IL"), (8, "OH")], "MI"),
}
CUSTOMER_STATUS_BANDS = [(85, "Active"), (95, "Inactive")]
CREATED_YEAR_BANDS = [(40, "2024-01-01"), (70, "2023-01-01"), (90, "2022-01-01")]
NAME_STARTS = ["Advanced", "Global", "Premier", "United", "National"]
INDUSTRY_WORDS = {"Technology": "Tech", "Finance": "Financial", "Healthcare": "Health"}
CATEGORY_BANDS = [(35, "Software"), (60, "Hardware"), (80, "Services"), (92, "Training")]
PRICE_FORMULAS = {  # category: base, factor, modulus
    "Software": (99, 17, 9901),
    "Hardware": (299, 19, 49701),
    "Services": (500, 23, 99500),
    "Training": (199, 13, 9801),
    "Consulting": (1000, 29, 49000),
}
EMPLOYEE_FORMULAS = {"Enterprise": (500, 37, 9500), "Mid-Market": (50, 31, 450), "SMB": (1, 23, 49)}
REVENUE_FORMULAS = {
    "Enterprise": (10_000_000, 47, 490_000_000),
    "Mid-Market": (1_000_000, 41, 49_000_000),
    "SMB": (100_000, 29, 4_900_000),
}
ORDER_AMOUNT_FORMULAS = {"Enterprise": (5000, 37, 95000), "Mid-Market": (1000, 31, 19000)}
ORDER_AMOUNT_OTHER = (100, 23, 4900)
FIRST_NAMES = ["James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "William", "Elizabeth"]
LAST_NAMES = ["Smith", "Johnson", "Williams", "Brown", "Jones", "Garcia", "Miller", "Davis", "Rodriguez", "Martinez"]
SOURCE_RULES = {  # source: accuracy, days behind, coverage limit of id % 100, skipped multiples of id
    "A": (0.95, 0, 80, None),
    "B": (0.90, 5, 70, 3),
    "C": (0.85, 10, 60, 5),
}
BASIC_SOURCES = {  # source: e-mail domain, lowest age, status
    "source_a": ("sourceA.com", 30, "active"),
    "source_b": ("sourceB.com", 35, "inactive"),
    "source_c": ("sourceC.com", 40, "pending"),
}
MONTH_WEIGHTS = [1.05, 1.00, 1.10, 0.95, 0.90, 0.85, 0.80, 0.88, 1.05, 1.15, 1.20, 1.25]
DEAL_BASE = {"New Business": 45000, "Renewal": 38000, "Upsell": 28000, "Cross-sell": 22000}
BRAND_FACTOR = {"Brand_A": 1.2, "Brand_C": 0.8}
CHANNEL_FACTOR = {"In-Person": 1.15, "Online": 0.95}
FOURTH_QUARTER_FACTOR = 1.08
SMALLEST_DEAL = 5000
STAGES = ["appointment", "qualified", "presentation", "decision", "contract", "closed"]
MAJOR_CODES = {"Computer Science": "CSC", "Business": "BUS", "Engineering": "ENG"}

ROWS_PER_PART = 1_000_000


def ids(spark: SparkSession, n: int, parts: int | None = None) -> DataFrame:
    """Ids 0 … n-1, by default about a million per partition."""
    return spark.range(0, n, numPartitions=parts or max(1, -(-n // ROWS_PER_PART)))


def _formula(number: Column, spec: tuple[int, int, int]) -> Column:
    base, factor, modulus = spec
    return base + number * factor % modulus


def customers(source: DataFrame) -> DataFrame:
    """Customer dimension of eleven columns."""
    number = F.col("id")
    hundred, ten = number % 100, number % 10
    segment = banded(hundred, SEGMENT_BANDS, "SMB")
    industry = banded(hundred, INDUSTRY_BANDS, "Other")
    region = banded(hundred, REGION_BANDS, "Midwest")
    base = source.select(
        number, segment.alias("segment"), industry.alias("industry"), region.alias("region")
    ).select(
        "*",
        keyed(F.col("segment"), {k: _formula(number, v) for k, v in REVENUE_FORMULAS.items()}).alias("annual_revenue"),
    )
    created_from = banded(hundred, CREATED_YEAR_BANDS, "2021-01-01")
    return base.select(
        padded("CUST", number, 10).alias("customer_id"),
        F.concat_ws(
            " ",
            pick(NAME_STARTS, number),
            keyed(F.col("industry"), INDUSTRY_WORDS, F.col("industry")),
            F.lit("Solutions"),
        ).alias("company_name"),
        "segment",
        "industry",
        keyed(F.col("segment"), {k: _formula(number, v) for k, v in EMPLOYEE_FORMULAS.items()}).alias("num_employees"),
        "annual_revenue",
        F.expr("annual_revenue * (0.15 + (id % 100) / 1000.0)").alias("lifetime_value"),
        "region",
        keyed(F.col("region"), {k: banded(ten, bands, last) for k, (bands, last) in STATE_BANDS.items()}).alias("state"),
        banded(hundred, CUSTOMER_STATUS_BANDS, "Churned").alias("status"),
        F.date_sub(created_from.cast("date"), (number % 365).cast("int")).alias("created_at"),
    )


def products(source: DataFrame) -> DataFrame:
    """Product dimension of five columns."""
    number = F.col("id")
    base = source.select(number, banded(number % 100, CATEGORY_BANDS, "Consulting").alias("category")).select(
        "*", keyed(F.col("category"), {k: _formula(number, v) for k, v in PRICE_FORMULAS.items()}).alias("unit_price")
    )
    return base.select(
        padded("PROD", number, 8).alias("product_id"),
        F.concat_ws(" ", "category", F.lit("Edition"), (number % 10 + 1).cast("string")).alias("product_name"),
        "category",
        "unit_price",
        F.expr("cast(100000 / (unit_price / 100 + 1) as int)").alias("inventory_quantity"),
    )


def orders(source: DataFrame, customer_table: DataFrame, wrap_at: int | None = None) -> DataFrame:
    """Order facts of seven columns; amounts follow the customer's segment.

    Orders without a matching customer keep the smallest price band. ``wrap_at`` (a number of
    customers) folds customer numbers into that range so that none is unmatched.
    """
    number = F.col("id")
    hundred = number % 100
    offset = banded(hundred, [(40, number % 15000), (75, 15000 + number % 35000)], 50000 + number % 50000)
    if wrap_at is not None:
        offset = offset % wrap_at
    numbered = source.select(
        number,
        padded("CUST", offset, 10).alias("customer_id"),
        F.when(hundred < 35, 10 + number % 3).otherwise(1 + number % 9).cast("int").alias("month"),
        F.when(hundred < 70, 9 + number % 9).otherwise(number % 24).cast("int").alias("hour"),
    )
    priced = numbered.join(customer_table.select("customer_id", "segment"), "customer_id", "left").select(
        "*",
        F.make_date(F.lit(2024), F.col("month"), (1 + number % 28).cast("int")).alias("order_date"),
        keyed(
            F.col("segment"),
            {k: _formula(number, v) for k, v in ORDER_AMOUNT_FORMULAS.items()},
            _formula(number, ORDER_AMOUNT_OTHER),
        ).alias("plain_amount"),
        banded(hundred, [(90, "Completed"), (97, "Processing")], "Cancelled").alias("status"),
    )
    amount = F.expr("CASE WHEN month >= 10 THEN plain_amount * 1.08 ELSE plain_amount END")
    days = first_match([
        (F.col("order_amount") > 50000, 5 + number % 10),
        (F.col("order_amount") > 10000, 3 + number % 7),
    ], 1 + number % 5)
    return priced.withColumn("order_amount", amount).select(
        padded("ORD", number, 12).alias("order_id"),
        "customer_id",
        "order_date",
        F.expr("to_timestamp(order_date) + make_dt_interval(0, hour)").alias("order_timestamp"),
        "order_amount",
        "status",
        F.when(F.col("status") == "Completed", days)
        .when(F.col("status") == "Cancelled", F.lit(0).cast("long"))
        .alias("days_to_fulfill"),
    )


def entities(source: DataFrame, keep_id: bool = False) -> DataFrame:
    """Canonical entities, the values before any source changes them."""
    number = F.col("id")
    named = source.select(
        number,
        pick(FIRST_NAMES, number).alias("first_name"),
        pick(LAST_NAMES, number).alias("last_name"),
        F.date_add(F.lit("2020-01-01").cast("date"), (number * 7 % 1460).cast("int")).alias("created_date"),
    )
    return named.select(
        *([number] if keep_id else []),
        padded("ENT", number, 10).alias("entity_id"),
        "first_name",
        "last_name",
        F.lower(F.concat_ws(".", "first_name", "last_name", F.lit("@company.com"))).alias("email"),
        F.concat(
            F.lit("555-"),
            F.lpad((number * 17 % 1000).cast("string"), 3, "0"),
            F.lit("-"),
            F.lpad((number * 23 % 10000).cast("string"), 4, "0"),
        ).alias("phone"),
        _formula(number, (50000, 37, 950000)).alias("annual_revenue"),
        _formula(number, (10, 13, 990)).alias("employee_count"),
        "created_date",
        F.date_add("created_date", (number * 11 % 365).cast("int")).alias("last_updated"),
    )


def inject_conflicts(
    table: DataFrame, source: str, accuracy: float, days_behind: int, gate: Column | None = None, kind: Column | None = None
) -> DataFrame:
    """One source's view of the entities: some rows differ in name, measure, date style or contact.

    ``gate`` decides which rows differ (its remainder by 100 is at or above the accuracy) and ``kind``
    which difference they get (by its remainder by 10). By default both are the hash of the entity
    id, so the two are tied; pass two expressions for independent draws.
    """
    gate = F.abs(F.hash("entity_id").cast("long")) if gate is None else gate
    kind = F.abs(F.hash("entity_id").cast("long")) if kind is None else kind
    flagged = table.withColumn("has_conflict", gate % 100 >= int(accuracy * 100)).withColumn(
        "conflict_type",
        first_match(
            [(~F.col("has_conflict"), "none")],
            banded(kind % 10, [(4, "name"), (7, "measure"), (9, "date")], "other"),
        ),
    )
    iso, changes = "yyyy-MM-dd", _changes(source)

    def changed(kind_name: str, name: str) -> Column:
        if name not in changes:
            return F.col(name)
        return F.when(F.col("conflict_type") == kind_name, changes[name]).otherwise(F.col(name))

    updated = F.date_add("last_updated", days_behind)
    style = changes.get("date_style", iso)
    return flagged.withColumn("last_updated", updated).select(
        F.md5(F.concat_ws("-", F.lit(source), "entity_id", F.col("last_updated").cast("string"))).alias("record_id"),
        F.lit(source).alias("source"),
        F.concat_ws("-", F.lit(source), "entity_id").alias("source_system_id"),
        "entity_id",
        changed("name", "first_name").alias("first_name"),
        changed("name", "last_name").alias("last_name"),
        changed("other", "email").alias("email"),
        changed("other", "phone").alias("phone"),
        changed("measure", "annual_revenue").cast("decimal(24,2)").alias("annual_revenue"),
        changed("measure", "employee_count").alias("employee_count"),
        "created_date",
        F.when(F.col("conflict_type") == "date", F.date_format("created_date", style))
        .otherwise(F.date_format("created_date", iso))
        .alias("created_date_str"),
        "last_updated",
        "has_conflict",
        "conflict_type",
    )


def _changes(source: str) -> dict:
    """How a source spells a differing value; sources without an entry act like C."""
    if source == "A":
        return {
            "first_name": F.substring("first_name", 1, 1),
            "email": F.replace(F.col("email"), F.lit("@company.com"), F.lit("@company.org")),
            "phone": F.replace(F.col("phone"), F.lit("-"), F.lit(".")),
            "annual_revenue": F.expr("annual_revenue * 1.05"),
            "employee_count": F.col("employee_count") + 5,
            "date_style": "MM/dd/yyyy",
        }
    if source == "B":
        return {
            "first_name": F.upper("first_name"),
            "last_name": F.upper("last_name"),
            "email": F.upper("email"),
            "phone": F.replace(F.col("phone"), F.lit("-"), F.lit("")),
            "annual_revenue": F.expr("annual_revenue * 0.95"),
            "employee_count": F.col("employee_count") - 3,
            "date_style": "dd-MM-yyyy",
        }
    return {"last_name": F.lower("last_name")}


def source_coverage(table: DataFrame, source: str) -> DataFrame:
    """Rows a source sees: a share of ``id % 100``, some multiples left out."""
    _, _, limit, skipped = SOURCE_RULES[source]
    kept = F.col("id") % 100 < limit
    return table.filter(kept if skipped is None else kept & (F.col("id") % skipped != 0))


def multi_source(source: DataFrame, gate: Column | None = None, kind: Column | None = None) -> dict[str, DataFrame]:
    """The three source tables over the same entities."""
    base = entities(source, keep_id=True)
    return {
        name: inject_conflicts(source_coverage(base, name), name, accuracy, behind, gate, kind)
        for name, (accuracy, behind, _, _) in SOURCE_RULES.items()
    }


def multi_source_basic(source: DataFrame, n: int, salt: str = "row") -> DataFrame:
    """Three sources of ``2n`` rows each over ids 0 … 2n-1; every entity twice per source."""
    number = F.col("id")
    listed = F.array(*[
        F.struct(F.lit(s).alias("source"), F.lit(d).alias("domain"), F.lit(a).alias("age"), F.lit(st).alias("status"))
        for s, (d, a, st) in BASIC_SOURCES.items()
    ])
    rows = source.select(
        number, F.concat(F.lit("entity_"), (number % n).cast("string")).alias("entity_id"), F.explode(listed).alias("s")
    )
    return rows.select(
        "id",
        "entity_id",
        "s.source",
        F.md5(F.concat_ws("-", F.lit(salt), "s.source", number.cast("string"))).alias("record_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 86400)").alias("timestamp"),
        F.concat("entity_id", F.lit("@"), "s.domain").alias("email"),
        (F.col("s.age") + number % 40).alias("age"),
        "s.status",
    )


def wide_baseline(source: DataFrame, fields: int = 400, salt: str = "row") -> DataFrame:
    """A wide table: ``fields`` columns in the cycle number, flag, text, and a map."""
    number = F.col("id")

    def field(i: int) -> Column:
        if i % 3 == 0:
            value = F.concat(F.lit("value_"), ((number + i) % 1000).cast("string"))
        elif i % 3 == 1:
            value = F.expr(f"((id * {i}) % 10000) / 10.0")
        else:
            value = (number + i) % 2 == 0
        return value.alias(f"field_{i:03d}")

    return source.select(
        "id",
        F.md5(F.concat_ws("-", F.lit(salt), number.cast("string"))).alias("record_id"),
        F.concat(F.lit("entity_"), (number % 1_000_000).cast("string")).alias("entity_id"),
        F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id % 31536000)").alias("timestamp"),
        *[field(i) for i in range(1, fields + 1)],
        F.create_map(F.lit("source"), F.lit("synthetic"), F.lit("version"), F.lit("1.0")).alias("metadata"),
    )


def weighted_choice(draw: Column, weights: dict[object, float]) -> Column:
    """Class for a draw in 0 … 999,999, by cumulative share."""
    total, limits, seen = sum(weights.values()), [], 0.0
    names = list(weights)
    for name in names[:-1]:
        seen += weights[name]
        limits.append((int(round(seen / total * 1_000_000)), name))
    return banded(draw, limits, names[-1])


def deal_amount(base: Column, brand: Column, channel: Column, month: Column) -> Column:
    """Base amount times brand, channel and fourth-quarter factors, never below the smallest deal."""
    factor = (
        keyed(brand, BRAND_FACTOR, 1.0)
        * keyed(channel, CHANNEL_FACTOR, 1.0)
        * F.when(month >= 10, F.lit(FOURTH_QUARTER_FACTOR)).otherwise(F.lit(1.0))
    )
    return F.greatest(F.lit(float(SMALLEST_DEAL)), base * factor)


def stage_dates(start: Column, delays: list[Column], reached: Column) -> dict[str, Column]:
    """Date of each stage; null for stages beyond the one reached (0-based)."""
    dates, current = {}, start
    for index, (stage, delay) in enumerate(zip(STAGES, delays)):
        current = F.date_add(current, F.greatest(delay, F.lit(0)).cast("int"))
        dates[f"{stage}_date"] = F.when(reached >= index, current)
    return dates


def performance(status: Column, draw: Column) -> tuple[Column, Column, Column]:
    """Grade point, letter and attendance that follow the status; ``draw`` runs over 0 … 100."""
    point = F.when(status.isin("Dropped", "In Progress"), F.lit(0.0)).otherwise(2.0 + draw * 2 / 100)
    letter = F.when(status == "Dropped", "F").when(status == "In Progress", "IP").otherwise(
        banded(point, [(2.5, "C"), (3.5, "B")], "A")
    )
    attendance = F.when(status == "Dropped", draw * 0.5 / 100).otherwise(0.8 + draw * 0.2 / 100)
    return point, letter, F.round(attendance.cast("decimal(10,4)"), 2).cast("double")


def closing_fields(is_closed: Column, is_won: Column, created: Column, days: Column, won: Column, lost: Column) -> dict[str, Column]:
    """Closing columns: all null while open, and only one of the two reasons set."""
    to_close = F.greatest(days, F.lit(1)).cast("int")
    return {
        "days_to_close": F.when(is_closed, to_close),
        "close_date": F.when(is_closed, F.date_add(created, to_close)),
        "won_reason": F.when(is_closed & is_won, won),
        "lost_reason": F.when(is_closed & ~is_won, lost),
    }


def course_code(major: Column, level: Column, number: Column) -> Column:
    """Major code and number, as in ``CSC201``."""
    return F.concat(keyed(major, MAJOR_CODES), (level * 100 + number).cast("string"))


def term_code(year: Column, semester: Column) -> Column:
    return F.concat(year.cast("string"), F.lit("-"), F.when(semester == "Fall", "01").otherwise("02"))


def first_courses(students: DataFrame, courses: DataFrame, per_term: int = 2) -> DataFrame:
    """Each student's first courses of their major: core before electives, then by course id.

    The choice depends only on the major, so it is ranked once per major on the course table; the
    students then join a list of at most ``per_term`` courses.
    """
    order = Window.partitionBy("major").orderBy(F.col("is_core").desc(), "course_id")
    chosen = courses.withColumn("course_rank", F.row_number().over(order)).filter(F.col("course_rank") <= per_term)
    return students.join(chosen, "major").select("student_id", "major", "course_id", "is_core", "course_rank")
