"""Mixing: targets, permutations, whole results against SQL on odd rows, and the words of the mix."""

import re
from collections import Counter, defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import mixing as m

SCHEMA = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()), ("size", T.StringType()), ("row", T.StringType()))])


def rows():
    words = [f"w{k}" for k in range(40_000)]
    out = [(k, " ".join(words[k * 60 : k * 60 + 37 + k % 90]), "big", 1, "x", "y") for k in range(400)]
    out += [(500 + k, " ".join(words[k : k + 50]), "mid", 1, None, None) for k in range(60)]
    out += [(600 + k, "a  b\tc\x0bd e", "small", 1, None, None) for k in range(4)]
    out += [(700, None, "none", None, None, None), (None, "x y z", None, 1, None, None), (701, "", None, 0, None, None), (702, " \n", "big", 2, None, None)]
    return [*out, out[0], out[0], (703, " ".join(words[:9000]), "long", 1, None, None)]


def level(sizes):
    """The targets by resharing the excess again and again."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: m.WEIGHTS[k % 3] for k, s in enumerate(names)}
    full = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] >= 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_limits(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    got = m.words_taken(docs)
    assert got.columns == ["doc_id", "size", "source_size", "target", "taken"]
    found = got.collect()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, source = defaultdict(int), {}
    for doc_id, text, name, *_ in rows():
        sizes[name] += size(text)
        source[doc_id] = name
    assert Counter((r.doc_id, r.size) for r in found) == Counter((i, size(t)) for i, t, *_ in rows())
    want = level(dict(sizes))
    taken = defaultdict(int)
    for r in found:
        assert r.source_size == sizes[source[r.doc_id]] and r.target == pytest.approx(want[source[r.doc_id]])
        assert 0 <= r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for name, words in taken.items():
        assert abs(words - want[name]) <= m.BLOCK_WORDS + 0.03 * want[name]
    assert sorted(map(tuple, m.words_taken(docs).collect()), key=repr) == sorted(map(tuple, found), key=repr)


def test_whole_result_against_sql(spark):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?, ?)", [r[:3] for r in rows()])
    want = sorted(db.execute(m.SQL).fetchall(), key=repr)
    assert sorted(map(tuple, m.words_taken(spark.createDataFrame(rows(), SCHEMA)).collect()), key=repr) == want


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_permutation(spark, n):
    sent = spark.range(n).select("id", m.permuted(F.col("id"), F.lit(n), F.lit(5)).alias("to"), m.permuted(F.col("id"), F.lit(n), F.lit(6)).alias("other")).collect()
    assert sorted(r.to for r in sent) == list(range(n))
    if n == 1000:
        assert sum(r.to == r.id for r in sent) < 20 and sum(r.to == r.other for r in sent) < 20
        assert abs(sum(r.to for r in sent if r.id < 500) / 500 - 499.5) < 50


def test_shards_draw_sources_in_proportion(spark):
    quotas = spark.createDataFrame([(1, 50, 5000, 0), (2, 900, 3000, 5000), (3, 10, 0, 8000), (4, 2000, 2000, 8000)], "rank long, blocks long, slots long, first_slot long")
    slots = m.draw_slots(spark, quotas, 10_000, shard_blocks=1000).collect()
    assert len(slots) == len({r.slot for r in slots}) == 10_000
    by_shard = Counter((r.shard, r["rank"]) for r in slots)
    assert all(abs(by_shard[s, 1] - 500) < 80 and abs(by_shard[s, 2] - 300) < 75 for s in range(10))
    uses = Counter((r["rank"], r.block) for r in slots)
    assert {uses[1, b] for b in range(50)} == {100} and set(uses[2, b] for b in range(900)) == {3, 4} and {uses[4, b] for b in range(2000)} == {1}


def test_mixed_documents(spark):
    docs = spark.createDataFrame([r for r in rows() if r[0] is not None], SCHEMA)
    out = m.mixed(docs, 32)
    assert out.columns == docs.columns
    original = {i: t for i, t, *_ in rows()}
    words, want = Counter(), Counter()
    for r in out.collect():
        assert r.n_chars == len(r.text)
        own = re.findall(r"[^\x20\x09-\x0D]+", r.text)
        assert r.text == original[r.doc_id] or not Counter(own) - Counter(original[r.doc_id].split())
        words[r.doc_id] += len(own)
    for r in m.words_taken(docs, 32).collect():
        want[r.doc_id] += r.taken
    assert words == +want


def test_empty_table(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert m.words_taken(docs).count() == 0 and m.mixed(docs, 32).count() == 0
    nothing = spark.createDataFrame([(1, None, "a", 0, "", "")], SCHEMA)
    assert [tuple(r) for r in m.words_taken(nothing).collect()] == [(1, 0, 0, 0.0, 0)]
