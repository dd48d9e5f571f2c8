"""Licence lookup: equivalent spellings, copyright lines, odd rows."""

import textwrap

from pyspark.sql import types as T

from tidemark.llm import licenses as s

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("license", T.StringType()), T.StructField("row", T.StringType())])
MIT = next(text for name, text in s.KNOWN if name == "MIT")


def test_canonical_texts_are_found(spark):
    texts = {
        1: MIT, 2: "  " + MIT.upper().replace("SUBLICENSE", "sub-licence").replace(",", " ;"), 3: "Copyright (c) 2020 A. Müller\n(C) other\n\n" + MIT, 4: MIT + " Extra words.",
        5: "Some text.\nReleased under the MIT Licence\nmore\n* Licensed under the Apache License, version 2.0 *\nreleased under the mit license!", 6: "", 7: None, 8: "Licensed under CC BY-NC 4.0.", 9: "Copyright 2021", 10: "x " * 50_000 + MIT,
    }
    rows = [(k, t, "odd", "r") for k, t in texts.items()] + [(None, MIT, None, None), (1, MIT, None, None)]
    got = s.scan(spark.createDataFrame(rows, SCHEMA))
    assert got.columns == ["doc_id", "canonical_sha256", "license", "notices", "n_notices"]
    found = [(r.doc_id, r.license, r.notices, r.n_notices) for r in got.collect()]
    plain = {1: ("MIT", "", 0), 2: ("MIT", "", 0), 3: ("MIT", "", 0), 4: (None, "", 0), 5: (None, "Apache-2.0,MIT", 3), 6: (None, "", 0), 7: (None, "", 0), 8: ("CC-BY-NC-4.0", "CC-BY-NC-4.0", 1), 9: (None, "", 0), 10: (None, "", 0)}
    own = {k: v[1:] for k, v in plain.items()}
    assert [(i, lic) for i, lic, *_ in sorted(found, key=repr)] == sorted([*((k, v[0]) for k, v in plain.items()), (None, "MIT"), (1, "MIT")], key=repr)
    assert {i: (n, c) for i, _, n, c in found if i in (4, 5, 6, 7, 8, 9)} == {k: own[k] for k in (4, 5, 6, 7, 8, 9)}


def test_empty_table_and_known_texts(spark):
    assert s.scan(spark.createDataFrame([], SCHEMA)).count() == 0
    digests = [r.digest for r in s.known(spark).collect()]
    assert len(digests) == len(set(digests)) > 20


def test_known_texts_in_any_wrapping(spark):
    heads = ["", "Copyright (c) 2020 X.\n\n", "Copyright 2019-2021 The Example Authors and Others. All rights reserved.\n\n", "Copyright (c) 2020, A. Müller and Example Inc.\n"]
    rows, want = [], {}
    for name, text in s.KNOWN:
        if len(text) > 200:
            for head in heads:
                whole = " ".join((head + text).split())
                for form in (head + text, whole, *(head + textwrap.fill(" ".join(text.split()), w, break_long_words=False) for w in (30, 48, 60, 72, 80, 100)), *(textwrap.fill(whole, w, break_long_words=False) for w in (40, 60, 72, 80, 100))):
                    want[len(rows)] = name
                    rows.append((len(rows), form, None, None))
    got = s.scan(spark.createDataFrame(rows, SCHEMA)).collect()
    assert [rows[r.doc_id][1][:200] for r in got if r.license != want[r.doc_id]] == [] and len(got) == len(rows)


def test_only_statements_are_removed(spark):
    texts = ["copyright holders are liable", "copyright notice, this list", "Copyright law is old.", "(c) You must retain all notices", "All rights reserved by nobody", "Copyright (c) 2020 Foo Bar. Some words stay here", "All rights reserved.", "Copyright 2021", "x\n© Foo\ny", "All rights reserved. More words"]
    left = ["copyright holders are liable", "copyright notice this list", "copyright law is old", "c you must retain all notices", "all rights reserved by nobody", "some words stay here", "", "", "x y", "more words"]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    assert [r[0] for r in frame.orderBy("k").select(s.canonical(frame.t)).collect()] == left


def test_many_statements_long_lists_and_lines_without_a_year(spark):
    holders = ", ".join(f"Holder Number{k} of a Company With a Long Name" for k in range(200))
    texts = {
        1: "Copyright (c) 2020 X\n" + "(c) 2019 Some Author\n" * 20_000 + MIT,
        2: "Copyright (c) 2020 X\n" + "(c) Some Author\n" * 20_000 + MIT,
        3: f"Copyright (c) 2020 {holders}\n\n" + MIT,
        4: f"Copyright (c) 2020 {holders}. All rights reserved. " + MIT,
        5: f"Copyright (c) 2020 {holders}\n{holders} All rights reserved.\n" + MIT,
        6: "Copyright Holder Inc. All rights reserved.\n" + MIT,
        7: "Copyright (c) 2020 " + "x" * 1_000_000 + "\n" + MIT,
        8: "(c) you must keep this clause\n" + MIT,
        9: "\n(c) you must keep this clause\n" + MIT,
    }
    got = {r.doc_id: r.license for r in s.scan(spark.createDataFrame(list(texts.items()), "doc_id long, text string")).collect()}
    assert got == {**dict.fromkeys(range(1, 8), "MIT"), 8: None, 9: None}
