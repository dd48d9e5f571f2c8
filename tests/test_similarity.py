"""The set-similarity join against all pairs, and its candidates under a hot name."""

import random

import pytest

from tidemark.operators import similarity as s


def gram_set(name, q=3):
    padded = "#" * (q - 1) + name + "#" * (q - 1)
    return {padded[i : i + q] for i in range(len(padded) - q + 1)}


def misspelt(rng, name):
    out = list(name)
    for _ in range(rng.choice([0, 1, 1, 2, 3])):
        k = rng.randrange(len(out) + 1)
        action = rng.randrange(3)
        if action == 0:
            out.insert(k, rng.choice("abcdeé "))
        elif k < len(out) and action == 1:
            del out[k]
        elif k < len(out):
            out[k] = rng.choice("abcdeé ")
    return "".join(out)


def people(seed, count):
    rng = random.Random(seed)
    first = ["anna", "annabelle", "bob", "roberto", "chris", "christina", "d", "élodie", ""]
    part = lambda: "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 7)))
    names = [f"{rng.choice(first)} {part()} {part()}".strip() for _ in range(count)]
    left = [(k, n) for k, n in enumerate(names)]
    right = [(10**6 + k, misspelt(rng, rng.choice(names))) for k in range(count)]
    return left, right


@pytest.mark.parametrize("percent", [50, 70, 90, 100])
def test_equal_to_all_pairs(spark, percent):
    left, right = people(1, 1000)
    left, right = [*left, (5000, None), (5001, ""), (5002, "x")], [*right, (10**6 + 5000, None), (10**6 + 5001, "")]
    want = {}
    rights = [(i, gram_set(n)) for i, n in right if n is not None]
    for i, name in left:
        if name is None:
            continue
        own = gram_set(name)
        found = []
        for j, other in rights:
            both = len(own & other)
            if both * 100 >= len(own | other) * percent:
                found.append((-both / len(own | other), j))
        if found:
            want[i] = (min(found)[1], -min(found)[0])
    df = lambda rows: spark.createDataFrame(rows, "id long, name string")
    got = s.match_similar(df(left), df(right), "id", "name", percent).collect()
    assert {r.left_record: (r.right_record, r.similarity) for r in got} == want and len(got) == len(want)
    assert len(want) > 100


def test_a_hot_name_costs_one_row(spark):
    left, right = people(2, 300)
    sizes, results = [], []
    for hot in (1, 2000):
        rows = spark.createDataFrame([*left, *[(10**7 + k, "anna hotname") for k in range(hot)]], "id long, name string")
        others = spark.createDataFrame([*right, *[(10**8 + k, "ana hotname") for k in range(hot)]], "id long, name string")
        names = rows.selectExpr("'l' side", "name").union(others.selectExpr("'r' side", "name")).distinct()
        sizes.append(s.candidate_names(names)[0].count())
        results.append({r.left_record: r.right_record for r in s.match_similar(rows, others, "id", "name", 50).collect()})
    assert sizes[0] == sizes[1] < 300 * 30
    assert len(results[1]) == len(results[0]) + 1999
    assert {results[1][10**7 + k] for k in range(2000)} == {10**8}
