"""Exact duplicates against a plain dictionary, with hot groups, nulls, ties and repeated rows."""

import hashlib
from collections import defaultdict

from pyspark.sql import types as T

from tidemark.llm import exact_dedup as e

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("row", T.StringType()), T.StructField("keep_id", T.LongType())])
ROWS = [
    *((k, "hot", "a", 1) for k in range(400)), *((1000 + k, f"own {k}", None, None) for k in range(300)), *((2000 + k, f"pair {k // 2}", "b", 2) for k in range(100)),
    (1, None, "x", 1), (2, "", "x", 1), (None, "", "x", 1), (None, "nobody", "x", 1), (None, "nobody", "x", 1), (7, "twice", "x", 1), (7, "twice", "x", 1), (8, "Twice", "x", 1),
    (9, "long " * 100_000, "x", 1), (10, "long " * 100_000, "x", 1),
]


def groups():
    found = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        found[text or ""].append(doc_id)
    return found


def test_marks_against_dictionary(spark):
    got = e.mark_copies(spark.createDataFrame(ROWS, SCHEMA), support=0.05).collect()
    own = groups()
    last = {t: max((i for i in ids if i is not None), default=None) for t, ids in own.items()}
    want = [(i, last[t or ""], len(own[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t, *_ in ROWS]
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == sorted(want, key=repr)
    assert sorted((r.text_sha256, r.doc_id) for r in got if r.kept and r.doc_id is not None) == sorted((hashlib.sha256(t.encode()).hexdigest(), i) for t, i in last.items() if i is not None)
    assert sum(r.kept for r in got) == len(own)


def test_support_changes_nothing(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    plain = sorted(map(tuple, e.mark_copies(docs, support=0.5).collect()), key=repr)
    assert plain == sorted(map(tuple, e.mark_copies(docs, support=0.005).collect()), key=repr)


def test_frequent_digests_are_winners_only(spark):
    rows = spark.createDataFrame([(k, "h" if k % 3 == 0 else str(k), k) for k in range(900)], "doc_id long, text_sha256 string, row long")
    found = e.frequent(rows, 0.1).collect()
    assert [(r.text_sha256, r.group_size, r.stays.doc_id) for r in found] == [("h", 300, 897)]


def test_rows_that_stay(spark):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    kept = e.drop_copies(docs, support=0.05)
    assert kept.columns == docs.columns
    rows = [tuple(r) for r in kept.collect()]
    assert len(rows) == len(groups()) and set(rows) <= {(i, t, a, b) for i, t, a, b in ROWS}
    assert (399, "hot", "a", 1) in rows and (10, "long " * 100_000, "x", 1) in rows
    assert e.drop_copies(docs.limit(0)).count() == 0 and e.mark_copies(docs.limit(0)).count() == 0
