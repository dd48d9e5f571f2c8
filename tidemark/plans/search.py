"""Search for the keys of large urgent orders and for conditions over several tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import provenance as p
from tidemark.operators import search as s
from tidemark.plans.registry import query
from tidemark.session import new_path

KEYS = "SELECT o_orderkey AS k FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 450000"


def keys(t):
    return t.orders.filter("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' AND o_totalprice > 450000").select(F.col("o_orderkey").alias("k"))


@query("pattern_search", """
SELECT 'orders' AS dataset, o_orderkey::VARCHAR AS key, 1.0::DOUBLE AS confidence, 'o_totalprice > 400000 AND o_orderpriority IN (1-URGENT, 2-HIGH) AND o_orderdate BETWEEN 1996 AND 1997' AS reason
FROM orders WHERE o_totalprice > 400000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate BETWEEN '1996-01-01' AND '1997-12-31'
UNION ALL SELECT 'events', event_id::VARCHAR, 1.0, 'event_type = purchase AND value > 150' FROM events WHERE event_type = 'purchase' AND value > 150
UNION ALL SELECT 'lineitem', l_orderkey::VARCHAR, 1.0, 'l_discount = 0 AND l_extendedprice > 90000' FROM lineitem WHERE l_discount = 0 AND l_extendedprice > 90000
""")
def pattern_search(t):
    dates = F.col("o_orderdate").between(F.lit("1996-01-01").cast("timestamp_ntz"), F.lit("1997-12-31").cast("timestamp_ntz"))
    return s.pattern_search({
        "orders": (t.orders, "o_orderkey", {
            "o_totalprice > 400000": F.col("o_totalprice") > 400000,
            "o_orderpriority IN (1-URGENT, 2-HIGH)": F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"),
            "o_orderdate BETWEEN 1996 AND 1997": dates,
        }),
        "events": (t.events, "event_id", {
            "event_type = purchase": F.col("event_type") == "purchase", "value > 150": F.col("value") > 150,
        }),
        "lineitem": (t.lineitem, "l_orderkey", {
            "l_discount = 0": F.col("l_discount") == 0, "l_extendedprice > 90000": F.col("l_extendedprice") > 90000,
        }),
    })


@query("bloom_build", f"""
SELECT n AS keys, ceil(ceil(-n * ln(0.001) / (ln(2) * ln(2))) / 64)::BIGINT * 64 AS bits, round(ceil(-n * ln(0.001) / (ln(2) * ln(2))) / n * ln(2))::INTEGER AS hashes
FROM (SELECT count(DISTINCT k) AS n FROM ({KEYS}))
""")
def bloom_build(t):
    words, bits, hashes = s.bloom_build(keys(t), "k")
    counted = keys(t).agg(F.count_distinct("k").alias("keys"))
    return counted.select("keys", F.lit(bits).cast("long").alias("bits"), F.lit(hashes).alias("hashes"))


@query("exact_verify", f"""
SELECT l_orderkey, l_linenumber, 1.0::DOUBLE AS confidence, 'l_orderkey in key set AND l_quantity > 25' AS reason FROM lineitem WHERE l_orderkey IN ({KEYS}) AND l_quantity > 25
""")
def exact_verify(t):
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    return s.exact_verify(rows, "l_orderkey", keys(t), "k", {"l_quantity > 25": F.col("l_quantity") > 25}).drop("l_quantity")


#: The column of each table that may hold a key.
KEY_COLUMNS = {
    "region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "lineitem": "l_orderkey",
    "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id", "labels": "doc_id", "conversations": "conv_id",
}
CERTAIN = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, {column}::VARCHAR AS key, count(*) AS matches, 1.0::DOUBLE AS confidence FROM {name} WHERE {column} IN ({KEYS}) GROUP BY {column}"
    for name, column in KEY_COLUMNS.items()
)


@query("certainty_search", CERTAIN)
def certainty_search(t):
    return s.certainty_search({name: (getattr(t, name), column) for name, column in KEY_COLUMNS.items()}, keys(t), "k")


@query("search_progress", f"""
SELECT date_trunc('month', l_shipdate)::DATE::VARCHAR AS part, count(*) AS matches FROM lineitem WHERE l_orderkey IN ({KEYS}) GROUP BY 1
""")
def search_progress(t):
    rows = t.lineitem.select(F.date_format(F.date_trunc("month", "l_shipdate"), "yyyy-MM-dd").alias("part"), "l_orderkey")
    wanted = keys(t)

    def process(df):
        found = s.exact_verify(df, "l_orderkey", wanted, "k")
        return found.groupBy("part").agg(F.count(F.lit(1)).alias("matches"))

    folder = new_path(t.spark, "search")
    p.resume(t.spark, rows, "part", process, folder, limit=F.col("part") < "1998-01-01")
    done = p.resume(t.spark, rows, "part", process, folder)
    return done.select(F.col("part").cast("string").alias("part"), "matches")


@query("sampling_recall", """
SELECT sample, hits, found, found::DOUBLE / hits AS recall FROM (SELECT s AS sample, count(*) AS hits, count(*) FILTER (draw < s) AS found FROM
 (SELECT ('0x' || left(md5(l_orderkey || '-' || l_linenumber), 6))::BIGINT / 16777216.0::DOUBLE AS draw FROM lineitem WHERE l_discount = 0 AND l_extendedprice > 90000), (SELECT unnest([0.01, 0.05, 0.5, 1.0]::DOUBLE[]) AS s) GROUP BY s)
""")
def sampling_recall(t):
    hit = (F.col("l_discount") == 0) & (F.col("l_extendedprice") > 90000)
    return s.sampling_recall(t.lineitem, F.concat_ws("-", "l_orderkey", "l_linenumber"), hit, [0.01, 0.05, 0.5, 1.0])
