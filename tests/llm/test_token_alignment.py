"""Token alignment against a plain version that uses the libraries themselves and all pairs of tokens."""

import hashlib
import random
from collections import Counter

import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import types as T
from tokenizers import Tokenizer

from tidemark.llm import token_alignment as t

JSON, MODEL = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SOURCES = t.Sources.read(JSON, public_tokenizers.PATTERN, MODEL)
SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("copies", T.StringType()), T.StructField("a.b", T.StringType())])
COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(JSON)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=MODEL)


def character_bytes():
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    return dict(zip(map(chr, shown), shown, strict=True)) | {chr(256 + n): b for n, b in enumerate(hidden)}


def spans(tokens):
    end, out = 0, []
    for number, data in tokens:
        out.append((number, end, end + len(data)))
        end += len(data)
    return out


def plain(rows, libraries):
    a, b = libraries
    of, found = character_bytes(), []
    for _, text, *_ in rows:
        one = [(i, bytes(of[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids]
        two = [(i, bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()) for i in b.encode(text or "")]
        want = (" " + (text or "")).encode()
        if not text or b"".join(x for _, x in one) != want or b"".join(x for _, x in two) != want:
            one = two = []
        one, two = spans(one), spans(two)
        links = [(x, y) for x, _, end in one for y, _, other in two if end == other]
        cuts = sorted({e for *_, e in one} & {e for *_, e in two})
        groups = []
        for start, end in zip([0, *cuts], cuts, strict=False):
            side = lambda s, start=start, end=end: ",".join(str(i) for i, f, e in s if start <= f and e <= end)
            groups.append(f"{side(one)}|{side(two)}")
        found.append((len(one), len(two), groups, links))
    count = Counter(link for *_, links in found for link in links)
    top = Counter()
    for (_, y), n in count.items():
        top[y] = max(top[y], n)
    out = []
    for (doc_id, *_), (n_a, n_b, groups, links) in zip(rows, found, strict=True):
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else ""
        out.append((doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links), digest))
    return sorted(out, key=repr)


def got(spark, rows):
    found = t.align_documents(spark.createDataFrame(rows, SCHEMA), SOURCES)
    assert found.columns == COLUMNS
    return sorted(map(tuple, found.collect()), key=repr)


def texts(count, seed=3):
    draw = random.Random(seed)
    parts = ["the cat ", "unbelievable", " 1999", "don't", "\n\n", "\t", "naïve ", "été", "中文字", "\U0001f600", "<|endoftext|>", "<s>", "<0x41>", "  ", "▁", "é", "\x00", " ", "x" * 9, "!?", "Größe"]
    return ["".join(draw.choice(parts) for _ in range(draw.randint(1, 12))) for _ in range(count)]


def test_against_libraries_and_all_pairs(spark, libraries):
    rows = [(k, text, None, "z") for k, text in enumerate(texts(250))]
    rows += [(900 + k, "the cat don't", "c", None) for k in range(40)] + rows[:7]
    rows += [(None, None, None, None), (None, "été", "x", "y"), (2000, "", "x", "y"), (2001, " lead and trail ", None, None), (2002, "a ▁ b", None, None)]
    want = plain(rows, libraries)
    assert got(spark, rows) == want
    assert sum(row[1] == 0 for row in want) >= 3  # texts that do not come back are among them


def test_given_documents(spark, libraries):
    rows = [(r.doc_id, r.text, None, None) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rows = sorted(rows, key=lambda r: len(r[1] or ""))[:120]
    assert got(spark, rows) == plain(rows, libraries)


def test_long_text_and_small_chunks_change_nothing(spark, libraries, monkeypatch):
    draw = random.Random(8)
    long = "".join(draw.choice("abc de\n") for _ in range(300_000)) + "y" * 100_000
    pair = t.pair_of(SOURCES)
    whole = t.align([long, *texts(20)], pair)
    assert whole == [t.align([x], pair)[0] for x in [long, *texts(20)]]
    a, _ = libraries
    assert whole[0].n_a == len(a.encode(" " + long, add_special_tokens=False).ids)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_pairs_are_bounded_by_the_vocabularies(spark):
    pair = t.pair_of(SOURCES)
    most = t.most_pairs(pair)
    assert most < 400_000
    docs = spark.createDataFrame([(k, text, None, None) for k, text in enumerate(texts(200))], SCHEMA)
    pairs = [(r.pair // t.SIDE, r.pair % t.SIDE) for r in t.pair_counts(t.aligned_texts(docs, SOURCES)).collect()]
    assert len(pairs) == len(set(pairs)) <= most
    assert all(pair.bytes_a[x].endswith(pair.bytes_b[y]) or pair.bytes_b[y].endswith(pair.bytes_a[x]) for x, y in pairs)
