"""Deep lineage, merges with deletions and hot keys against plain Python."""

import random
from collections import Counter, defaultdict

from tidemark import session
from tidemark.operators import logs, provenance, relations

KEYS = (["k"], ["x"], ["x", "s"], ["s"])


def bfs(edges, starts):
    out = defaultdict(set)
    for a, b in edges:
        out[a].add(b)
    best = {s: (0, s) for s in starts}
    front = dict(best)
    while front:
        new = {}
        for a, (depth, path) in front.items():
            for b in out[a]:
                if b not in best:
                    new[b] = min(new.get(b, (depth + 1, path + ">" + b)), (depth + 1, path + ">" + b))
        best.update(new)
        front = new
    return sorted((n, d, p) for n, (d, p) in best.items())


def reached(spark, edges, starts, **options):
    links = spark.createDataFrame(edges, "src string, dst string")
    return relations.reach_far(links, spark.createDataFrame([(s,) for s in starts], "node string"), **options)


def test_random_graphs_with_chains_and_circles(spark):
    for seed in range(2):
        rng = random.Random(seed)
        nodes = [f"n{k}" for k in range(25)]
        edges = [(rng.choice(nodes), rng.choice(nodes)) for _ in range(28)]
        for c in range(4):
            chain = [rng.choice(nodes), *[f"c{c}.{k}" for k in range(rng.randint(1, 9))], rng.choice(nodes)]
            edges += list(zip(chain, chain[1:]))
        edges += [("o1", "o2"), ("o2", "o3"), ("o3", "o1"), ("n0", "n0"), ("n1", "n2"), ("n1", "n2")]
        starts = ["n0", "n1", "c0.0"]
        assert sorted(map(tuple, reached(spark, edges, starts).collect())) == bfs(edges, starts)


def test_a_chain_of_4096_takes_few_rounds(spark, monkeypatch):
    writes, cut = [], session.cut_lineage
    monkeypatch.setattr(relations, "cut_lineage", lambda df: writes.append(1) or cut(df))
    names = [f"{k:04d}" for k in range(4097)]
    rows = reached(spark, list(zip(names, names[1:])), ["0000"]).collect()
    assert sorted((r.node, r.depth) for r in rows) == [(n, k) for k, n in enumerate(names)]
    assert all(r.path == ">".join(names[: r.depth + 1]) for r in rows[::97])
    assert len(writes) <= 15 + 5  # a write a round, and the five around them


def test_merged_is_recomputed_after_twenty_deltas(spark):
    rng = random.Random(7)
    schema = "id int, k string, x int, s string"
    detail = {i: (i, rng.choice(["a", "b", "c", None]), rng.randrange(50), rng.choice("pqrs")) for i in range(300)}
    frame = lambda rows: spark.createDataFrame(list(rows), schema)
    base = session.cut_lineage(provenance.materialize(frame(detail.values()), *KEYS))
    for step in range(20):
        gone = [detail.pop(i) for i in rng.sample(sorted(detail), 12)] if step % 2 else []
        new = [(1000 * step + n + 1000, rng.choice(["a", "b", "d", "e", None]), rng.randrange(60), rng.choice("pqrstu")) for n in range(15)]
        if step == 19:
            gone += [detail.pop(i) for i, row in sorted(detail.items()) if row[1] == "c"]  # a key that goes
        detail.update({row[0]: row for row in new})
        base = session.cut_lineage(provenance.merge_materialized(base, frame(new), frame(gone), frame(detail.values()), *KEYS))
    want = {}
    for _, k, x, s in detail.values():
        want.setdefault(k, []).append((x, s))
    plain = {k: (len(r), sum(x for x, _ in r), min(x for x, _ in r), max(x for x, _ in r), min(s for _, s in r), max(s for _, s in r), len({s for _, s in r})) for k, r in want.items()}
    got = provenance.estimated(base, ["s"]).collect()
    assert {r.k: (r.rows, r.x, r.x_min, r.x_max, r.s_min, r.s_max, r.s_values) for r in got} == plain and len(got) == len(plain)


def test_hot_keys_are_all_and_exact(spark):
    rng = random.Random(3)
    keys = [None] * 400 + ["hot"] * 3000 + [f"warm{k % 20}" for k in range(400)] + [f"cold{k}" for k in range(6000)]
    rng.shuffle(keys)
    df = spark.createDataFrame([(k,) for k in keys], "key string").repartition(8)
    for least in (0.2, 0.01, 0.002, 0.0005):
        want = {k: n for k, n in Counter(keys).items() if n / len(keys) >= least}
        got = logs.hot_keys(df, "key", least).collect()
        assert {r.key: r.rows for r in got} == want and len(got) == len(want)
        assert all(abs(r.share - r.rows / len(keys)) < 1e-12 for r in got)
