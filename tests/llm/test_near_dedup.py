"""Near duplicates: the alignment against plain dynamic programming, classes against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from tidemark.llm import near_dedup as n
from tidemark.llm.words import mixed

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType()), T.StructField("class_id", T.LongType())])


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_banded_distance():
    draw = random.Random(1)
    for _ in range(3000):
        a = [draw.randint(0, 6) for _ in range(draw.randint(0, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 12)):
            at = draw.randint(0, len(b))
            draw.choice([lambda: b.insert(at, draw.randint(0, 6)), lambda: b.pop(at) if at < len(b) else None, lambda: b.__setitem__(at, 9) if at < len(b) else None])()
        most = draw.randint(0, 12)
        got = n.banded_distance(mixed(np.array(a, np.uint64)), mixed(np.array(b, np.uint64)), most)
        assert got == min(plain_distance(a, b), most + 1), (a, b, most)


def test_most_edits():
    assert [n.most_edits(x, x, 0.8) for x in (0, 4, 5, 9, 10, 100)] == [0, 0, 1, 1, 2, 20]


def test_equal_kmers_are_told_apart():
    hashes = np.array([5, 5, 7, 5], np.uint64)
    assert len(set(n.labelled(hashes, np.array([0, 0, 0, 1])).tolist())) == 3


def text(draw, words):
    return [draw.choice("bcdfg") + draw.choice("aeiou") + str(draw.randint(0, 99)) for _ in range(words)]


def edited(draw, words, share):
    return [w if draw.random() > share else "new" + str(draw.randint(0, 999)) for w in words]


@pytest.fixture(scope="module")
def rows():
    draw = random.Random(2)
    passage = text(draw, 60)
    made = []
    for _ in range(12):
        base = text(draw, draw.randint(60, 300))
        made += [base, *(edited(draw, base, 0.03) for _ in range(draw.randint(0, 4)))]
    made += [text(draw, 30) + passage + text(draw, 40) for _ in range(30)]
    made += [edited(draw, text(random.Random(9), 200), 0.04) for _ in range(60)]
    rows = [(k, " ".join(words), None, 3) for k, words in enumerate(made)]
    draw.shuffle(rows)
    return [*rows, *rows[:5], (1000, rows[0][1], None, 3), (1001, rows[1][1], None, 3)]


def test_classes_against_all_pairs(spark, rows):
    got = n.mark_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    texts = sorted({t for _, t, *_ in rows})
    words = [t.split() for t in texts]
    parent = list(range(len(texts)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(texts)):
        for j in range(i):
            a, b = words[i], words[j]
            if min(len(a), len(b)) >= 0.8 * max(len(a), len(b)) and set(a) & set(b):
                most = n.most_edits(len(a), len(b), 0.8)
                code = {w: k for k, w in enumerate(sorted({*a, *b}))}
                if n.banded_distance(np.array([code[w] for w in a]), np.array([code[w] for w in b]), most) <= most:
                    parent[root(i)] = root(j)
    place = {t: k for k, t in enumerate(texts)}
    least, size = {}, {}
    for doc_id, t, *_ in rows:
        r = root(place[t])
        least[r] = min(least.get(r, doc_id), doc_id)
        size[r] = size.get(r, 0) + 1
    want = sorted({(i, least[root(place[t])], size[root(place[t])]) for i, t, *_ in rows})
    assert sorted({(r.doc_id, r.class_id, r.class_size) for r in got}) == want
    assert sorted(r.doc_id for r in got if r.kept) == sorted(least.values())


def test_odd_rows(spark):
    rows = [(1, None, "a", 1), (2, "", "b", 2), (3, " \n", None, None), (None, "one two three", "x", 1), (4, "one two three", "x", 1), (5, "one two four", "x", 1), (6, "x " * 30_000 + "y", "x", 1), (7, "x " * 30_001, "x", 1), (7, "x " * 30_001, "x", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, n.mark_near_copies(docs).select("doc_id", "class_id", "class_size", "kept").collect()), key=repr)
    assert got == sorted([(1, 1, 3, True), (2, 1, 3, False), (3, 1, 3, False), (None, 4, 2, False), (4, 4, 2, True), (5, 5, 1, True), (6, 6, 3, True), (7, 6, 3, False), (7, 6, 3, False)], key=repr)
    kept = n.drop_near_copies(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 4, 5, 6]
    assert n.mark_near_copies(docs.limit(0)).count() == 0


def substituted(draw, words, edits):
    changed = list(words)
    for at in draw.sample(range(len(words)), edits):
        changed[at] = "new" + str(draw.randint(0, 10**9))
    return changed


def sketched(words):
    return n.sketches_of(n.words_of([" ".join(words).encode()]).hashes, n.run_for(0.8), 0.8)


@pytest.mark.parametrize(("size", "edits"), [(5, 1), (8, 1), (10, 1), (10, 2), (15, 2), (15, 3), (19, 3), (20, 4), (24, 4), (25, 5), (50, 10), (50, 8), (200, 40), (200, 30)])
def test_pairs_at_the_threshold_share_a_sketch(size, edits):
    draw = random.Random(size * 100 + edits)
    bases = [[f"w{draw.randint(0, 3000)}" for _ in range(size)] for _ in range(150)]
    missed = sum(not set(sketched(a).tolist()) & set(sketched(substituted(draw, a, edits)).tolist()) for a in bases)
    assert not missed


def test_lengths_on_both_sides_of_the_kinds_share_a_sketch():
    draw = random.Random(6)
    for size in range(16, 32):
        for _ in range(40):
            a = [f"w{draw.randint(0, 3000)}" for _ in range(size)]
            gone = draw.sample(range(size), n.most_edits(size, size, 0.8))
            assert set(sketched(a).tolist()) & set(sketched([w for k, w in enumerate(a) if k not in gone]).tolist())


def test_classes_of_pairs_at_the_threshold(spark):
    draw = random.Random(7)
    pairs = []
    for size in (5, 7, 10, 12, 15, 19, 20, 22, 25, 50, 200):
        for _ in range(8):
            base = [f"w{draw.randint(0, 100_000)}" for _ in range(size)]
            pairs.append((base, substituted(draw, base, n.most_edits(size, size, 0.8))))
            pairs.append(([f"v{k}x{len(pairs)}" for k in range(size)], None))
            every = [w if k % 5 != 4 else f"e{k}x{len(pairs)}" for k, w in enumerate(pairs[-1][0])]
            pairs[-1] = (pairs[-1][0], every)
    rows = [(2 * k + j, " ".join(words), None, k) for k, pair in enumerate(pairs) for j, words in enumerate(pair)]
    got = {r.doc_id: r.class_id for r in n.mark_near_copies(spark.createDataFrame([(*r[:3], r[3]) for r in rows], SCHEMA)).collect()}
    assert got == {r[0]: 2 * r[3] for r in rows}


def test_families_joined_by_one_text(spark):
    draw = random.Random(8)
    base = [f"w{draw.randint(0, 100_000)}" for _ in range(100)]
    far = substituted(draw, base, 38)
    changed = [k for k in range(100) if base[k] != far[k]]
    bridge = [far[k] if k in changed[:19] else w for k, w in enumerate(base)]
    texts = [*(substituted(draw, base, 3) for _ in range(8)), base, *(substituted(draw, far, 3) for _ in range(8)), far, bridge]
    rows = [(k, " ".join(words), None, None) for k, words in enumerate(texts)]
    assert {r.class_id for r in n.mark_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}


def test_two_members_that_lead_no_bucket_are_linked(spark):
    # two families of near copies share a passage; only one member of each is similar to one of the other
    draw = random.Random(11)
    links = 0
    for seed in range(6):
        base = [f"w{draw.randint(0, 100_000)}" for _ in range(100)]
        far = substituted(draw, base, 44)
        changed = [k for k in range(100) if base[k] != far[k]]
        one = [far[k] if k in changed[:13] else w for k, w in enumerate(base)]
        two = [far[k] if k in changed[:31] else w for k, w in enumerate(base)]
        texts = [base, *(substituted(draw, base, 2) for _ in range(20)), far, *(substituted(draw, far, 2) for _ in range(20)), one, two]
        rows = [(k, " ".join(words), None, None) for k, words in enumerate(texts)]
        links += {r.class_id for r in n.mark_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == {0}
    assert links == 6


def test_blocks_give_every_fitting_pair(spark, monkeypatch):
    monkeypatch.setattr(n, "BLOCK", 5)
    monkeypatch.setattr(n, "PAIRS_AT_ONCE", 7)
    draw = random.Random(12)
    members = [(b, k + 100 * b, draw.randint(0, 30), draw.randint(0, 3)) for b in range(4) for k in range((2, 5, 17, 23)[b])]
    bins = {k: bytes(draw.randint(0, 1) if j < 8 else 0 for j in range(n.BINS)) for _, k, _, _ in members}
    shared = spark.createDataFrame([m[:3] for m in members], "bucket long, node long, n_words long")
    joined = spark.createDataFrame([(m[1], m[3]) for m in members], "node long, component long")
    blocks = n._blocks(shared, spark.createDataFrame(list(bins.items()), "node long, bins binary"), joined)
    want = set()
    for b, k, size, group in members:
        for c, j, other, part in members:
            if b == c and k < j and group != part and min(size, other) >= 0.8 * max(size, other) - 1e-9:
                common = sum(map(min, bins[k], bins[j]))
                if max(sum(bins[k]), sum(bins[j])) - common <= 0.2 * max(size, other) + 1e-9:
                    want.add((k, j))
    every = n._pairs_of_blocks(blocks, 0.8, 1000).collect()
    assert sorted(r[:2] for r in every) == sorted(want) and not any(r.more for r in every) and len(want) > 20
    few = n._pairs_of_blocks(blocks, 0.8, 1).collect()
    assert {r[:2] for r in few} < want and any(r.more for r in few)


def test_pairs_left_out_at_first_are_passed_again(spark, monkeypatch):
    draw = random.Random(13)
    base = [f"w{draw.randint(0, 100_000)}" for _ in range(60)]
    shuffled = []
    for _ in range(12):  # equal word counts, so only the alignment tells them apart
        words = base[20:]
        draw.shuffle(words)
        shuffled.append(base[:20] + words)
    texts = [*shuffled, *(substituted(draw, t, 2) for t in shuffled)]
    monkeypatch.setattr(n, "FIRST_SKETCHES", 0)
    monkeypatch.setattr(n, "FIRST_PAIRS", 1)
    monkeypatch.setattr(n, "MORE_PAIRS", 2)
    rows = [(k, " ".join(words), None, None) for k, words in enumerate(texts)]
    assert {r.doc_id: r.class_id for r in n.mark_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: k % 12 for k in range(24)}


def test_bound_by_runs_is_sound():
    draw = random.Random(14)
    for _ in range(2000):
        a = [draw.randint(0, 5) for _ in range(draw.randint(0, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            at = draw.randint(0, len(b))
            draw.choice([lambda: b.insert(at, draw.randint(0, 5)), lambda: b.pop(at) if at < len(b) else None, lambda: b.__setitem__(at, 9) if at < len(b) else None])()
        one, two = (mixed(np.array(x, np.uint64)) for x in (a, b))
        assert n.enough_runs(one, two, plain_distance(a, b))


def counts(words):
    hashes = n.words_of([" ".join(map(str, words)).encode()]).hashes
    return n.counts_of(n.pa.array([n.binned(hashes) + n.finely_binned(hashes)]))


def test_bound_by_counts_is_sound():
    draw, zero = random.Random(15), np.zeros(1, np.int64)
    for _ in range(2000):
        a = [draw.randint(0, 5) for _ in range(draw.randint(0, 40))]
        b = list(a)
        for _ in range(draw.randint(0, 8)):
            at = draw.randint(0, len(b))
            draw.choice([lambda: b.insert(at, draw.randint(0, 5)), lambda: b.pop(at) if at < len(b) else None, lambda: b.__setitem__(at, 9) if at < len(b) else None])()
        assert n.near_enough(counts(a), counts(b), zero, zero, np.array([plain_distance(a, b)])).all()
    # a passage of three quarters and other words: the coarse bins alone leave such pairs
    for k in range(20):
        base = [f"w{draw.randint(0, 10**6)}" for _ in range(600)]
        one, two = (counts(base + [f"{x}{k}x{j}" for j in range(200)]) for x in "uv")
        edits = np.array([160])
        assert n.near_enough(one[:1], two[:1], zero, zero, edits).all() and not n.near_enough(one, two, zero, zero, edits).any()


def test_only_buckets_that_left_pairs_out_are_passed_again(spark, monkeypatch):
    draw = random.Random(16)
    parts = [[f"w{draw.randint(0, 100_000)}" for _ in range(15)] for _ in range(4)]
    orders = [draw.sample(range(4), 4) for _ in range(40)]
    moved = [sum((parts[k] for k in o), []) for o in dict.fromkeys(map(tuple, orders))][:12]  # equal words and nearly equal runs, so only the alignment tells them apart
    shared = [f"v{k}" for k in range(40)]
    other = [[*shared[:20], *(f"u{j}x{k}" for k in range(40))] for j in range(12)]  # a common passage, told apart at once
    texts = [*moved, *other, *(substituted(draw, t, 2) for t in moved)]
    monkeypatch.setattr(n, "FIRST_SKETCHES", 0)
    monkeypatch.setattr(n, "FIRST_PAIRS", 1)
    monkeypatch.setattr(n, "MORE_PAIRS", 2)
    passed, blocks = [], n._blocks
    monkeypatch.setattr(n, "_blocks", lambda shared, *rest: passed.append(shared.select("bucket").distinct().count()) or blocks(shared, *rest))
    rows = [(k, " ".join(words), None, None) for k, words in enumerate(texts)]
    assert {r.doc_id: r.class_id for r in n.mark_near_copies(spark.createDataFrame(rows, SCHEMA)).collect()} == {k: k if k < 24 else k - 24 for k in range(36)}
    assert len(passed) > 2 and passed == sorted(passed, reverse=True) and passed[1] < passed[0]


def test_a_bucket_that_left_pairs_out_is_named_once(spark):
    rows = [(b, k + 100 * b, 50, k + 100 * b) for b in range(3) for k in range((20, 2, 30)[b])]
    shared = spark.createDataFrame([r[:3] for r in rows], "bucket long, node long, n_words long")
    bins = spark.createDataFrame([(r[1], bytes([50] + [0] * (n.BINS - 1))) for r in rows], "node long, bins binary")
    got = n._pairs_of_blocks(n._blocks(shared, bins, None), 0.8, 4).collect()
    assert sorted(r.bucket for r in got if r.bucket is not None) == [0, 2]
    assert {r.node // 100 for r in got if not r.more} == {1}
