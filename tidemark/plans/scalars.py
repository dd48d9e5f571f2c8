"""Scalar functions applied to whole columns of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import values as v
from tidemark.functions.rules import banded
from tidemark.plans.quality import RECORDS, records
from tidemark.plans.registry import query


@query("conditional_chain", """
SELECT o_orderkey, CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band,
  o_orderkey % 97 AS remainder, (o_custkey - 700) % 100 + CASE WHEN (o_custkey - 700) % 100 < 0 THEN 100 ELSE 0 END AS positive_remainder, floor(o_totalprice / 7)::BIGINT AS whole FROM orders
""")
def conditional_chain(t):
    return t.orders.select(
        "o_orderkey",
        banded(F.col("o_totalprice"), [(100000, "low"), (300000, "mid")], "high").alias("band"),
        (F.col("o_orderkey") % 97).alias("remainder"),
        F.pmod(F.col("o_custkey") - 700, F.lit(100)).alias("positive_remainder"),
        F.floor(F.col("o_totalprice") / 7).alias("whole"),
    )


@query("text_functions", """
SELECT c_custkey, c_name || ' / ' || c_mktsegment AS joined, lpad(c_custkey::VARCHAR, 10, '0') AS padded, lower(c_mktsegment) AS lowered, upper(c_name) AS uppered,
  substr(c_mktsegment, 1, 3) AS head, split_part(c_name, '#', 2) AS number, replace(c_name, '#', '-') AS replaced, regexp_replace(c_name, '0+', '*', 'g') AS squeezed,
  regexp_extract(c_name, '([1-9][0-9]*)$', 1) AS tail, contains(lower(c_name), 'omer#00000001') AS contained FROM customer
""")
def text_functions(t):
    name, segment = F.col("c_name"), F.col("c_mktsegment")
    return t.customer.select(
        "c_custkey",
        F.concat_ws(" / ", name, segment).alias("joined"),
        F.lpad(F.col("c_custkey").cast("string"), 10, "0").alias("padded"),
        F.lower(segment).alias("lowered"),
        F.upper(name).alias("uppered"),
        F.substring(segment, 1, 3).alias("head"),
        F.split_part(name, F.lit("#"), F.lit(2)).alias("number"),
        F.replace(name, F.lit("#"), F.lit("-")).alias("replaced"),
        F.regexp_replace(name, "0+", "*").alias("squeezed"),
        F.regexp_extract(name, "([1-9][0-9]*)$", 1).alias("tail"),
        F.contains(F.lower(name), F.lit("omer#00000001")).alias("contained"),
    )


@query("key_hashes", """
SELECT o_orderkey, md5(o_orderkey || '-' || o_custkey) AS record_id, sha256(o_orderkey || '-' || o_custkey) AS checksum FROM orders
""")
def key_hashes(t):
    joined = F.concat_ws("-", F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string"))
    return t.orders.select("o_orderkey", F.md5(joined).alias("record_id"), F.sha2(joined, 256).alias("checksum"))


@query("hash_buckets", """
SELECT abs(('0x' || left(md5(o_orderkey::VARCHAR), 8))::BIGINT - 2147483648) % 16 AS bucket, count(*) AS rows FROM orders GROUP BY 1
""")
def hash_buckets(t):
    """Rows per bucket of a hash that every engine has; centred on 0, so that the sign has to be dropped."""
    hashed = F.conv(F.substring(F.md5(F.col("o_orderkey").cast("string")), 1, 8), 16, 10).cast("long") - 2147483648
    return t.orders.groupBy((F.abs(hashed) % 16).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"))


@query("date_functions", """
SELECT o_orderkey, (o_orderdate::DATE + 30) AS plus_30, make_date(year(o_orderdate)::INTEGER, month(o_orderdate)::INTEGER, 1) AS first_day, strftime(o_orderdate, '%m/%d/%Y') AS us, strftime(o_orderdate, '%d-%m-%Y') AS eu,
  date_trunc('month', o_orderdate)::DATE AS month, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age_days, o_orderdate + to_seconds(o_orderkey % 86400) AS later, (o_orderdate::DATE - 90) AS minus_90 FROM orders
""")
def date_functions(t):
    day = F.col("o_orderdate")
    return t.orders.select(
        "o_orderkey",
        F.date_add(day.cast("date"), 30).alias("plus_30"),
        F.make_date(F.year(day), F.month(day), F.lit(1)).alias("first_day"),
        F.date_format(day, "MM/dd/yyyy").alias("us"),
        F.date_format(day, "dd-MM-yyyy").alias("eu"),
        F.date_trunc("month", day).cast("date").alias("month"),
        F.datediff(F.lit("2002-01-01").cast("date"), day).cast("long").alias("age_days"),
        F.expr("o_orderdate + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("later"),
        F.date_sub(day.cast("date"), 90).alias("minus_90"),
    )


@query("json_path", """
SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events
""")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@query("map_literal", "SELECT event_type, 'synthetic' AS source, count(*) AS rows FROM events GROUP BY event_type")
def map_literal(t):
    tags = F.create_map(F.lit("source"), F.lit("synthetic"), F.lit("version"), F.lit("1.0"))
    rows = t.events.select("event_type", F.element_at(tags, F.lit("source")).alias("source"))
    return rows.groupBy("event_type", "source").agg(F.count(F.lit(1)).alias("rows"))


@query("token_estimate", "SELECT doc_id, length(text) // 4 AS tokens FROM documents")
def token_estimate(t):
    return t.documents.select("doc_id", v.token_estimate(F.col("text")).alias("tokens"))


@query("parse_dates", f"""
SELECT record, CASE WHEN placed <> 'soon' THEN o_orderdate::DATE END AS parsed FROM ({RECORDS}) JOIN orders ON o_orderkey = record
""")
def parse_dates(t):
    return records(t).select("record", v.parse_date(F.col("placed")).alias("parsed"))


@query("parse_amounts", """
SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN NULL ELSE p_retailprice END AS amount FROM part
""")
def parse_amounts(t):
    text = F.when(F.col("p_partkey") % 9 == 0, "free").otherwise(F.concat(F.lit("$"), F.format_number("p_retailprice", 2)))
    return t.part.select("p_partkey", v.parse_amount(text).alias("amount"))


@query("digit_jaccard", """
SELECT o_orderkey, len(list_intersect(a, b))::DOUBLE / len(list_distinct(list_concat(a, b))) AS overlap
FROM (SELECT o_orderkey, list_distinct(string_split(o_orderkey::VARCHAR, '')) AS a, list_distinct(string_split(o_custkey::VARCHAR, '')) AS b FROM orders)
""")
def digit_jaccard(t):
    return t.orders.select(
        "o_orderkey", v.digit_overlap(F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")).alias("overlap")
    )


@query("cosine_distance", """
SELECT a.vec_id, round(1.0 - list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance
FROM embeddings a JOIN (SELECT label, arg_min(embedding, vec_id) AS embedding FROM embeddings GROUP BY label) b ON a.label = b.label
""")
def cosine_distance(t):
    first = t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("lead"))
    joined = t.embeddings.join(first, "label")
    return joined.select("vec_id", F.round(v.cosine_distance(F.col("embedding"), F.col("lead")), 6).alias("distance"))


@query("normalize_values", r"""
SELECT page_id, lower(trim(regexp_replace('  ' || url || ' ', '\s+', ' ', 'g'))) AS name, regexp_replace(url, '[^0-9]', '', 'g') AS digits FROM pages
""")
def normalize_values(t):
    return t.pages.select(
        "page_id", v.normalize_name(F.concat(F.lit("  "), "url", F.lit(" "))).alias("name"), v.normalize_phone(F.col("url")).alias("digits")
    )
