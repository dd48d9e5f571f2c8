"""Near duplicates by order min-hash, verified by banded alignment.

A text's k-mers are its runs of ``run`` words, each labelled with the number of its earlier equals. The length of runs
follows from ``similarity`` (``run_for``): it is the longest that leaves two similar texts 0.6 of their runs however the edits lie, two
words for 0.8. In texts of fewer than ``SHORT`` times as many words single edits touch too many runs, so their k-mers are single words;
lengths at which a similar text can be on the other side have both kinds. For each of
``SKETCHES`` hash functions the ``PICK`` k-mers of least hash are kept in the order in which they stand in the text;
two texts agree on a sketch only if they share those k-mers in the same order, so agreement follows
edit similarity rather than overlap alone. Two texts are linked if their edit similarity in words,
``1 - distance / words of the longer``, is at least ``similarity``; the distance is found in a band around the
diagonal no wider than that allows.

Equal texts are worked once. Texts that agree on a sketch form a bucket. Only members with another one of a fitting length next to them in
the order of lengths stay in it. A first pass takes ``FIRST_SKETCHES`` sketches and compares the members of a bucket with its first
one (its leader), so pairs grow with the members; connected components of the links found so far join most copies of large groups. The
second pass takes all sketches and every pair of members of different components whose lengths fit, for a pair inside a component can add
nothing. These pairs are no rows: a bucket is cut into blocks of ``BLOCK`` members by length, and a task passes two blocks at a time
through a cheap sound bound (word counts in ``BINS`` bins). What it leaves is aligned, at first ``FIRST_PAIRS`` pairs of a text in a block; if there were more, components are
joined and the buckets that left some out are passed again with ``MORE_PAIRS`` times as many, until none is left out. These buckets hold many texts that are nearly similar, so in them
the bound is taken in ``FINE`` bins too. Before the alignment a last sound bound (all words and runs of two and three, of which an edit touches at most as many) rejects most other pairs.
Classes are the connected components of all links.

Limits: two texts without a common sketch are not compared. At the threshold, edits that lie apart leave a share of 0.6 of the runs,
an overlap of 0.6 / 1.4 = 0.43, and order aside two k-mers of a sketch agree with 0.43 squared, so all 48 sketches miss such a pair with a
probability of about 6e-5; edits that lie together leave more. Single words of a pair at the threshold overlap by 0.67: about 1e-12.
All texts that do share a sketch are compared or are in one component. In a bucket of many different texts with a common passage the
bound is taken for each pair of fitting lengths, so this part of the time grows with the square of such a bucket; memory does not.

Defined cases: a null text counts as empty; texts without words are one class; null ids come last when a class is named; of repeated rows with the least id one is kept;
an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import in_batches, small
from tidemark.llm.components import components
from tidemark.llm.words import chunks, mixed, run_hashes, words_of
from tidemark.session import cut_lineage, spread

#: Texts of fewer than ``SHORT`` times ``run`` words are sketched by single words.
SHORT = 10
SIMILARITY = 0.8
SKETCHES = 48
PICK = 2
BINS = 256
#: Bins of four bits for texts of buckets that are passed again.
FINE = 2048
FIRST_SKETCHES = 8
#: Members of a bucket that a task holds twice at most, pairs it forms at once, and aligned pairs of a text in a block, at first and times as many later.
BLOCK, PAIRS_AT_ONCE = 4096, 20_000
FIRST_PAIRS, MORE_PAIRS = 8, 16
SEEDS = mixed(np.arange(1, SKETCHES + 1, dtype=np.uint64))
STEP = np.uint64(0xD6E8FEB86659FD93)


def labelled(hashes: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that also tell the first, second, ... equal hash of an owner apart."""
    group = mixed(hashes ^ mixed(owner.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(group, kind="stable")
    new = np.append(True, group[order][1:] != group[order][:-1]) if len(order) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    number = np.empty(len(order), np.uint64)
    number[order] = np.arange(len(order)) - np.repeat(first, np.diff(np.append(first, len(order))))
    return mixed(hashes + number * STEP)


def run_for(similarity: float) -> int:
    """The longest run of words of which edits of ``1 - similarity`` of the words leave 0.6, wherever they are."""
    return max(1, int(0.4 / max(1 - similarity, 0.01) + 1e-9))


def sketch(kmers: np.ndarray) -> np.ndarray:
    """The sketches of one text's labelled k-mers."""
    if not len(kmers):
        return SEEDS.copy()
    ranks = (kmers[None, :] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    ranks ^= ranks >> np.uint64(31)
    ranks *= np.uint64(0x94D049BB133111EB)
    line = np.arange(len(SEEDS))
    chosen = []
    for _ in range(min(PICK, len(kmers))):
        at = ranks.argmin(axis=1)
        ranks[line, at] = np.uint64(2**64 - 1)
        chosen.append(at)
    out = SEEDS.copy()
    for at in np.sort(chosen, axis=0):
        out = out * STEP + kmers[at]
    return mixed(out)


def sketches_of(hashes: np.ndarray, run: int, similarity: float) -> np.ndarray:
    """The sketches of one text: by single words if it is short, by runs if it is long, both where a similar text can be of the other kind."""
    n, short = len(hashes), SHORT * run
    kinds = [1] * (run > 1 and n * similarity < short) + [run] * (n >= short or run == 1)
    made = []
    for length in kinds:
        runs = run_hashes(hashes, length)
        made.append(sketch(labelled(runs, np.zeros(len(runs), np.int64))))
    return np.concatenate(made)


def binned(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of ``BINS`` bins, at most 255."""
    return np.minimum(np.bincount((hashes % np.uint64(BINS)).astype(np.int64), minlength=BINS), 255).astype(np.uint8).tobytes()


def finely_binned(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of ``FINE`` bins, at most 15; two bins a byte."""
    counts = np.minimum(np.bincount((hashes // np.uint64(BINS) % np.uint64(FINE)).astype(np.int64), minlength=FINE), 15).astype(np.uint8)
    return (counts[::2] | counts[1::2] << 4).tobytes()


def _survey(texts: DataFrame, run: int, similarity: float) -> DataFrame:
    def work(batches):
        for batch in batches:
            raw = batch.column(2).cast(pa.binary()).to_pylist()
            counts, bins, sketches = [], [], []
            for part in chunks(raw):
                words = words_of(raw[part])
                for k in range(part.stop - part.start):
                    own = words.hashes[int(words.first[k]) : int(words.first[k + 1])]
                    counts.append(len(own))
                    bins.append(binned(own))
                    sketches.append(sketches_of(own, run, similarity).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(bins, pa.binary()), pa.array(sketches, pa.list_(pa.int64()))],
                names=["key", "doc_id", "n_words", "bins", "sketches"],
            )

    kind = texts.schema["doc_id"].dataType.simpleString()
    return in_batches(texts, work, f"key binary, doc_id {kind}, n_words long, bins binary, sketches array<long>")


def most_edits(a: int, b: int, similarity: float) -> int:
    """The greatest distance at which texts of these lengths still have the similarity."""
    longer = max(a, b, 1)
    edits = int((1 - similarity) * longer) + 1
    while edits > max(a, b) or edits > 0 and 1 - edits / longer < similarity - 1e-12:
        edits -= 1
    return edits


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two sequences if it is at most ``most``, else ``most + 1``.

    The band of ``2 * most + 1`` diagonals is held in the bits of integers, one column after the other,
    as differences between neighbouring cells.
    """
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    start = int(differ[0]) if len(differ) else n
    a, b = a[start:], b[start:]
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    end = int(differ[0]) if len(differ) else n
    a, b = a[: len(a) - end], b[: len(b) - end]
    if abs(len(a) - len(b)) > most:
        return most + 1
    if not len(a) or not len(b):
        return max(len(a), len(b))
    band = min(most, max(len(a), len(b)))
    if len(a) <= band:
        band = len(a) - 1 if abs(len(a) - len(b)) <= len(a) - 1 else 0
        if band < most:
            return _full_distance(a, b, most)
    place: dict[int, int] = {}
    for k, value in enumerate(a.tolist()):
        place[value] = place.get(value, 0) | 1 << k
    width = 2 * band + 2
    mask = (1 << width) - 1
    up, down = mask & ~((1 << (width - band - 1)) - 1), 0
    diagonal, across = 1 << (width - 1), 1 << (width - 2)
    distance, first = band, band + 1 - width
    turn = len(a) - band
    for k, value in enumerate(b.tolist()):
        found = place.get(value, 0)
        match = (found >> first if first >= 0 else found << -first) & mask
        same = ((((match & up) + up) ^ up) | match | down) & mask
        right = down | (mask & ~(same | up))
        left = same & up
        if k < turn:
            distance += not same & diagonal
        else:
            distance += bool(right & across) - bool(left & across)
            across >>= 1
        shifted = same >> 1
        up = left | (mask & ~(shifted | right))
        down = right & shifted
        first += 1
    return min(distance, most + 1)


def _full_distance(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """For pairs so short after their common ends are cut that the band would cover everything."""
    row = np.arange(len(b) + 1)
    for k, value in enumerate(a.tolist()):
        new = np.minimum(row[1:] + 1, row[:-1] + (b != value))
        new = np.append(k + 1, new)
        row = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
    return min(int(row[-1]), most + 1)


def counts_of(bins) -> list[tuple[np.ndarray, np.ndarray, int]]:
    """The binned counts of words and, if there, the fine ones, a row for each text; their sums; and the mask of a count."""
    values = bins.to_pylist()
    every = np.frombuffer(b"".join(values), np.uint8).reshape(len(values), len(values[0]) if values else BINS)
    parts = [(every[:, :BINS], 255)] + [(every[:, BINS:], 15)] * (every.shape[1] > BINS)
    return [(part, _added(part, mask), mask) for part, mask in parts]


def _added(counts: np.ndarray, mask: int) -> np.ndarray:
    if mask == 255:
        return counts.sum(axis=1, dtype=np.int64)
    return (counts & 15).sum(axis=1, dtype=np.int64) + (counts >> 4).sum(axis=1, dtype=np.int64)


def near_enough(one, two, a: np.ndarray, b: np.ndarray, edits: np.ndarray) -> np.ndarray:
    """Whether so many edits can turn the counts of rows ``a`` of ``one`` into those of rows ``b`` of ``two``."""
    stay = np.ones(len(a), bool)
    for (left, size, mask), (right, other, _) in zip(one, two, strict=True):
        passed = np.flatnonzero(stay)
        for on in np.array_split(passed, len(passed) * left.shape[1] // 5_000_000 + 1):
            x, y = left[a[on]], right[b[on]]
            # counts above the greatest one stand as that, which can only make two texts look more alike
            common = _added(np.minimum(x, y), mask) if mask == 255 else np.minimum(x & 15, y & 15).sum(axis=1, dtype=np.int64) + np.minimum(x >> 4, y >> 4).sum(axis=1, dtype=np.int64)
            stay[on] = np.maximum(size[a[on]], other[b[on]]) - common <= edits[on]
    return stay


def _screen(pairs: DataFrame, similarity: float) -> DataFrame:
    """Pairs whose lengths and word counts allow the similarity."""

    def work(batches):
        for batch in batches:
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            one, two = (counts_of(batch.column(k)) for k in (4, 5))
            stay = near_enough(one, two, np.arange(len(n)), np.arange(len(n)), (1 - similarity) * np.maximum(n, m) + 1e-9)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["node", "leader"]).filter(pa.array(stay))

    return in_batches(pairs, work, "node long, leader long")


def enough_runs(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether so many words and runs of two and three words are in both that ``most`` edits can explain the rest; an edit touches at most as many runs as a run has words."""
    for length in (1, 2, 3):
        needed = max(len(a), len(b)) - length + 1 - length * most
        if needed > 0:
            one, two = np.sort(run_hashes(a, length)), np.sort(run_hashes(b, length))
            values, counts = np.unique(one, return_counts=True)
            if np.minimum(counts, np.searchsorted(two, values, "right") - np.searchsorted(two, values, "left")).sum() < needed:
                return False
    return True


def _align(pairs: DataFrame, similarity: float) -> DataFrame:
    def work(batches):
        for batch in batches:
            node, leader = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            one, two = (batch.column(k).cast(pa.binary()).to_pylist() for k in (2, 3))
            kept = []
            for part in chunks(one):
                left, right = words_of(one[part]), words_of(two[part])
                for k in range(part.stop - part.start):
                    a = left.hashes[left.first[k] : left.first[k + 1]]
                    b = right.hashes[right.first[k] : right.first[k + 1]]
                    most = most_edits(len(a), len(b), similarity)
                    if enough_runs(a, b, most) and banded_distance(a, b, most) <= most:
                        kept.append(part.start + k)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for k in kept], pa.int64()) for x in (node, leader)], names=["node", "leader"])

    return in_batches(pairs, work, "node long, leader long")


def fitting_pairs(rows: pa.Table, similarity: float, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows (their places) whose lengths and word counts allow the similarity, and the rows some of whose pairs were left out.

    ``rows`` has whole groups ``bucket, one, two``, each in the order of ``block, n_words``. In a group of one block the pairs are any two rows, in
    a group of two blocks a row of each; both rows are of different components. A row has at most ``most`` pairs with rows behind it.
    """
    bucket, one, two, block, words, component = (rows.column(x).to_numpy() for x in ("bucket", "one", "two", "block", "n_words", "component"))
    counts, n = counts_of(rows.column("bins")), len(words)
    new = np.append(True, (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1]))
    group = np.cumsum(new) - 1
    # the first row to meet is the next one, or the first of the other block; the last is told by length
    other = np.append(True, new[1:] | (block[1:] != block[:-1]))
    side = np.cumsum(other) - 1
    start = np.where(one == two, np.arange(n) + 1, np.searchsorted(side, side, "right"))
    step = np.int64(words.max(initial=0) / similarity) + 2
    reach = np.searchsorted(group * step + words, group * step + np.minimum((words / similarity + 1e-9).astype(np.int64), step - 1), "right")
    count = np.where((one == two) | (block == one), np.maximum(reach - start, 0), 0)
    found, left_out, at = [], np.zeros(n, bool), 0
    ends = np.cumsum(count)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        own = count[at:stop]
        a = np.repeat(np.arange(at, stop), own)
        b = np.repeat(start[at:stop] - np.append(0, np.cumsum(own)[:-1]), own) + np.arange(len(a))
        stay = component[a] != component[b]
        a, b = a[stay], b[stay]
        stay = near_enough(counts, counts, a, b, (1 - similarity) * np.maximum(words[a], words[b]) + 1e-9)
        a, b = a[stay], b[stay]
        number = np.arange(len(a)) - np.searchsorted(a, a)
        left_out[a[number >= most]] = True
        found.append((a[number < most], b[number < most]))
        at = stop
    a, b = (np.concatenate([x[k] for x in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    return a, b, np.flatnonzero(left_out)


def _whole_groups(batches, columns: list[str]):
    """Tables of whole groups, of about ``BATCH_ROWS`` rows or one larger group, from rows sorted by ``columns``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(x).to_numpy() for x in columns]
        new = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(x)[-1].as_py() != batch.column(x)[0].as_py() for x in columns):
            yield pa.Table.from_batches(held)
            held = []
        if len(new):
            last = int(new[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, batch = [], batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _pairs_of_blocks(rows: DataFrame, similarity: float, most: int) -> DataFrame:
    """``node, leader, more, bucket`` of all fitting pairs of different components in the buckets; ``more``: whether some of its
    bucket were left out, which the first pair of such a bucket alone names."""

    def work(batches):
        for table in _whole_groups(batches, ["bucket", "one", "two"]):
            a, b, left_out = fitting_pairs(table, similarity, most)
            node = table.column("node").to_numpy()
            least, greatest = np.minimum(node[a], node[b]), np.maximum(node[a], node[b])
            every = table.column("bucket").to_numpy()
            bucket, more, named = every[a], np.isin(every[a], every[left_out]), np.zeros(len(a), bool)
            named[np.flatnonzero(more)[np.unique(bucket[more], return_index=True)[1]]] = True
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(greatest), pa.array(more), pa.array(bucket, mask=~named)], names=["node", "leader", "more", "bucket"])

    return in_batches(rows, work, "node long, leader long, more boolean, bucket long")


def _blocks(shared: DataFrame, bins: DataFrame, joined: DataFrame | None) -> DataFrame:
    """The members of buckets that hold several components, once for every two blocks of a bucket that they take part in."""
    whole, order = Window.partitionBy("bucket"), Window.partitionBy("bucket").orderBy("n_words", "node")
    several = F.min("component").over(whole) < F.max("component").over(whole)
    rows = _with_component(shared.select("bucket", "node", "n_words"), joined).withColumn("several", several)
    rows = rows.withColumn("place", F.row_number().over(order) - 1).withColumn("members", F.count(F.lit(1)).over(whole)).filter("several")
    block, last = F.floor(F.col("place") / BLOCK), F.floor((F.col("members") - 1) / BLOCK)
    rows = rows.select("bucket", "node", "n_words", "component", block.alias("block"), last.alias("last"))
    alone = rows.filter("last = 0").select("bucket", "node", "n_words", "component", "block", F.col("block").alias("with"))
    parted = rows.filter("last > 0").select("bucket", "node", "n_words", "component", "block", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("with"))
    places = F.collect_list(F.struct("bucket", "block", F.least("block", "with").alias("one"), F.greatest("block", "with").alias("two"))).alias("places")
    # the counts of a text are joined once, whatever the number of its buckets
    rows = alone.unionByName(parted).groupBy("node", "n_words", "component").agg(places).join(bins, "node").select("node", "n_words", "component", "bins", F.inline("places"))
    return spread(rows, "bucket", "one", "two").sortWithinPartitions("bucket", "one", "two", "block", "n_words")


def find_links(keyed: DataFrame, similarity: float, run: int | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """The different texts (``node, key, doc_id, copies, ...``), verified links (``node, leader``) that join all similar ones among them, and the
    component (its least node) of every other text that has a link (None if there are no links).

    ``keyed`` has ``key, doc_id, text``; rows with equal keys have equal texts.
    """
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "n_words", "bins", "sketches")).alias("r")
    grouped = _survey(keyed, run or run_for(similarity), similarity).groupBy("key").agg(least, F.count(F.lit(1)).alias("copies"))
    nodes = cut_lineage(grouped.select(F.monotonically_increasing_id().alias("node"), "key", "copies", "r.doc_id", "r.n_words", "r.bins", "r.sketches"))
    bins = nodes.select("node", "bins")
    links, tested, joined = [], [], None
    keys = nodes.select("node", "n_words", F.posexplode("sketches").alias("slot", "bucket"))
    # in the order of lengths a text that fits any other in its bucket fits the one before or after it
    order = Window.partitionBy("bucket").orderBy("n_words", "node")
    before, after = (f("n_words").over(order) for f in (F.lag, F.lead))
    lone = ~F.coalesce(before >= similarity * F.col("n_words") - 1e-9, F.lit(False)) & ~F.coalesce(similarity * after <= F.col("n_words") + 1e-9, F.lit(False))
    lead = F.min(F.struct("node", "n_words")).over(Window.partitionBy("bucket"))
    shared = cut_lineage(keys.select("*", lone.alias("lone"), lead.alias("lead")).filter("NOT lone").drop("lone"))
    ends = F.least("node", "lead.node").alias("node"), F.greatest("node", "lead.node").alias("leader")
    close = F.least("n_words", "lead.n_words") >= similarity * F.greatest("n_words", "lead.n_words") - 1e-9
    first = shared.filter((F.col("slot") < FIRST_SKETCHES) & (F.col("node") != F.col("lead.node")) & close)
    words = [F.when(F.col("node") < F.col("lead.node"), F.col(x)).otherwise(F.col(y)).alias(z) for x, y, z in (
        ("n_words", "lead.n_words", "n_words"), ("lead.n_words", "n_words", "leader_words"))]
    pairs = cut_lineage(first.select(*ends, *words).distinct())
    with_one = small(pairs).join(bins, "node")
    both = with_one.join(_only(bins, pairs.select("leader")).select(F.col("node").alias("leader"), F.col("bins").alias("leader_bins")), "leader")
    candidates, most = cut_lineage(_screen(both.select("node", "leader", "n_words", "leader_words", "bins", "leader_bins"), similarity)), FIRST_PAIRS
    again = True
    while True:
        if candidates.limit(1).count():
            tested.append(candidates)
            links.append(_verify(keyed, nodes, tested[-1], similarity))
            joined = small(joined_by(joined, links[-1]))
        if not again:
            found = reduce(DataFrame.unionByName, links) if links else nodes.select("node", F.col("node").alias("leader")).limit(0)
            return nodes, found, joined
        new = cut_lineage(_pairs_of_blocks(_blocks(shared, bins, joined), similarity, most).groupBy("node", "leader").agg(F.collect_set("bucket").alias("left_out")))
        left_out = cut_lineage(new.select(F.explode("left_out").alias("bucket")).distinct())
        again, most = bool(left_out.limit(1).count()), most * MORE_PAIRS
        # whole buckets, so their blocks are the same in the next pass
        if again:
            shared = cut_lineage(shared.join(small(left_out), "bucket", "left_semi"))
            bins = _fine(keyed, nodes, shared) if most == FIRST_PAIRS * MORE_PAIRS else bins
        candidates = new.select("node", "leader")
        for earlier in tested:
            candidates = candidates.join(small(earlier), ["node", "leader"], "left_anti")
        candidates = cut_lineage(candidates)


def _fine(keyed: DataFrame, nodes: DataFrame, shared: DataFrame) -> DataFrame:
    """``node, bins``, written, with the fine counts of the texts in ``shared`` buckets."""

    def work(batches):
        for batch in batches:
            raw = batch.column(1).cast(pa.binary()).to_pylist()
            fine = []
            for part in chunks(raw):
                words = words_of(raw[part])
                fine += [finely_binned(words.hashes[words.first[k] : words.first[k + 1]]) for k in range(part.stop - part.start)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fine, pa.binary())], names=["node", "fine"])

    needed = cut_lineage(_only(nodes.select("node", "key", "bins", F.col("doc_id").alias("one")), shared.select("node")))
    texts = keyed.join(small(needed.select("node", "key", "one")), "key").filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("node", "text")
    fine = in_batches(texts, work, "node long, fine binary").dropDuplicates(["node"])
    return cut_lineage(fine.join(needed, "node").select("node", F.concat("bins", "fine").alias("bins")))


def _only(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """The rows of some nodes. What ``nodes`` repeats is written once, so it can be counted and, if few, the rows need no shuffle to be found."""
    return rows.join(small(cut_lineage(nodes.toDF("node").distinct())), "node", "left_semi")


def joined_by(joined: DataFrame | None, new: DataFrame) -> DataFrame:
    """The written components (of all nodes but the least of each) after the ``new`` links: links between components are few, so only those are followed."""
    ends = _with_component(new.select("node", "leader"), joined).select(F.col("leader").alias("node"), F.col("component").alias("a"))
    ends = _with_component(ends, joined).select("a", F.col("component").alias("b"))
    merged = cut_lineage(components(ends).filter("node <> component"))
    if joined is None:
        return merged
    into = small(merged.select(F.col("node").alias("component"), F.col("component").alias("into")))
    before = joined.join(into, "component", "left").select("node", F.coalesce("into", "component").alias("component"))
    return cut_lineage(before.union(merged))


def _with_component(rows: DataFrame, joined: DataFrame | None) -> DataFrame:
    """Adds the component of ``node``, its least node; a node that ``joined`` does not name is its own."""
    if joined is None:
        return rows.withColumn("component", F.col("node"))
    return rows.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))


def _verify(keyed: DataFrame, nodes: DataFrame, candidates: DataFrame, similarity: float) -> DataFrame:
    """The candidates whose alignment reaches the similarity. Only texts of candidates are read into the join."""
    needed = candidates.select("node").union(candidates.select("leader")).distinct().join(nodes.select("node", "key", F.col("doc_id").alias("one")), "node")
    needed = cut_lineage(needed)
    texts = keyed.join(small(needed), "key").filter(F.col("doc_id").eqNullSafe(F.col("one"))).select("node", "text")
    texts = cut_lineage(texts.dropDuplicates(["node"]))
    leaders = _only(texts, candidates.select("leader")).select(F.col("node").alias("leader"), F.col("text").alias("leader_text"))
    pairs = small(candidates).join(texts, "node").join(leaders, "leader")
    return cut_lineage(_align(pairs.select("node", "leader", "text", "leader_text"), similarity))


def keyed_texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.unhex(F.md5(text)).alias("key"), "doc_id", text.alias("text"))


def classes(docs: DataFrame, similarity: float = SIMILARITY, run: int | None = None) -> DataFrame:
    """Per different text: ``key, class_id, class_size, keep_key, keep_id``; the last two name the row that stays."""
    nodes, _, joined = find_links(keyed_texts(docs), similarity, run)
    members = _with_component(nodes.select("node", "key", "doc_id", "copies"), joined).drop("node")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), F.col("doc_id").alias("keep_id"), F.col("key").alias("keep_key"))).alias("first")
    named = members.groupBy("component").agg(first, F.sum("copies").alias("class_size"))
    return members.join(named, "component").select(
        "key", F.col("first.keep_id").alias("class_id"), "class_size", F.col("first.keep_key").alias("keep_key"), F.col("first.keep_id").alias("keep_id")
    )


def mark_near_copies(docs: DataFrame, similarity: float = SIMILARITY, run: int | None = None) -> DataFrame:
    """``doc_id, class_id`` (least id of the class)``, class_size`` and ``kept`` for every document."""
    keyed = docs.select(F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))).alias("key"), "doc_id")
    rows = keyed.join(classes(docs, similarity, run), "key")
    chosen = (F.col("key") == F.col("keep_key")) & F.col("doc_id").eqNullSafe(F.col("keep_id"))
    again = F.row_number().over(Window.partitionBy("key", "doc_id").orderBy("class_size"))
    return rows.select("doc_id", "class_id", "class_size", (chosen & (again == 1)).alias("kept"))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY, run: int | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, one of each class, with all their columns."""
    key, keep = "__key", "__keep_id"
    kept = classes(docs, similarity, run).filter("key = keep_key").select(F.col("key").alias(key), F.col("keep_id").alias(keep))
    named = docs.withColumn(key, F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")))))
    return named.join(kept, key).filter(F.col("doc_id").eqNullSafe(F.col(keep))).dropDuplicates([key]).select(*docs.columns)
