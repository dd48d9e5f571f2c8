"""Mixing sources to target weights, in fixed-length blocks of words.

Every source is one stream of words, packed into blocks of ``block_words`` words (the last block of a bin
of documents may be shorter). An output shard has ``shard_blocks`` slots. Which source a slot draws from is
decided by a keyed permutation of all slots: each shard's counts per source are a multinomial draw,
conditioned on the totals that the targets ask for, so the mix meets every target to within a block
and any shard can be drawn without the others. Slot ``j`` of a source reads block ``j mod blocks`` of
a second permutation, keyed by source and epoch; a block comes up again only after all others have.
Blocks and slots meet in an equi-join on (source, block), so a source that owns a third of all rows
spreads over as many tasks as it has blocks.

Both permutations are swap-or-not shuffles: a round pairs ``x`` with ``(key - x) mod n`` and swaps the two
if a hash of the larger says so. They work on any ``n``, point by point, without sorting or state.

Positions inside a source come from bins: ``ceil(sqrt(documents))`` bins by the MD5 of the id, a running
sum inside each bin and another over the bins, so no task orders a whole source.

Defined cases: null and empty texts have size 0, are taken 0 times; a null source is a source of its own,
last in order; ties and repeated rows are separate rows in any order among equals; an empty table gives no
rows; a source without words has target 0. Other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import WORD, small
from tidemark.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024
ROUNDS = 12
#: The modulus and the multipliers and offsets of the hash of each round.
PRIME = 2147483647
ROUND_KEYS = [((48271 ** (4 * r + 1)) % PRIME, (48271 ** (4 * r + 2)) % PRIME, (48271 ** (4 * r + 3)) % PRIME, (48271 ** (4 * r + 4)) % PRIME) for r in range(ROUNDS)]
LOOKUP_CELLS = 1024


def permuted(x: Column, n: Column, seed: Column) -> Column:
    """Where the permutation of ``0 .. n-1`` with this seed sends ``x``."""
    keys = F.array(*[F.struct(*[F.lit(v).cast("long").alias(k) for k, v in zip("abcd", key, strict=True)]) for key in ROUND_KEYS])
    n, seed = n.cast("long"), seed.cast("long") % PRIME

    def swapped(at: Column, key: Column) -> Column:
        other = ((key["a"] * seed + key["b"]) % PRIME % n - at + n) % n
        bit = F.floor(((F.greatest(at, other) % PRIME * key["c"] + key["d"]) % PRIME) / 65536) % 2
        return F.when(bit == 1, other).otherwise(at)

    return F.aggregate(keys, x.cast("long"), swapped)


def targets(rows: DataFrame) -> DataFrame:
    """One row per source: rank, weight, size, documents, target.

    Targets share all words by weight; none exceeds ``MOST_REPEATS`` times its source, and the excess
    goes to the others by weight. Sources that are full come first in order of size per weight, so
    one pass of running sums over the sources finds the level of the rest.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    ranked = sizes.withColumn("rank", F.row_number().over(order).cast("long")).withColumn(
        "weight", F.element_at(weights, ((F.col("rank") - 1) % len(WEIGHTS) + 1).cast("int"))
    )
    most = MOST_REPEATS * F.col("source_size")
    fill = Window.orderBy((most / F.col("weight")), "rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum(most).over(fill), F.lit(0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(fill), F.lit(0))
    )
    tried = ranked.withColumn("level", level).withColumn("full", most <= F.col("level") * F.col("weight"))
    common = F.max(F.when(~F.col("full"), F.col("level"))).over(every)
    return tried.withColumn("target", F.when(F.col("full"), most.cast("double")).otherwise(F.col("weight") * common)).drop("level", "full")


def sized(docs: DataFrame) -> DataFrame:
    """The written sizes of all documents: ``doc_id, source, size, row``."""
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    return cut_lineage(docs.select("doc_id", "source", size.alias("size"), F.monotonically_increasing_id().alias("row")))


def plan_mix(rows: DataFrame, block_words: int = BLOCK_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions of the documents, pieces of documents per block, and slots of the output shards.

    ``positions``: the rows with their source's target; ``pieces``: ``row, rank, block, first, words``
    (``first``: number of the piece's first word in its document); ``slots``: ``shard, slot, rank, epoch, block``.
    """
    spark = rows.sparkSession
    sources = cut_lineage(targets(rows))
    source = sources.withColumnRenamed("source", "__source")
    placed = rows.join(small(source), rows["source"].eqNullSafe(source["__source"])).drop("__source")
    digits = F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8)
    placed = placed.withColumn("bin", F.conv(digits, 16, 10).cast("long") % F.ceil(F.sqrt("docs")))
    bins = placed.groupBy("rank", "bin").agg(F.ceil(F.sum("size") / block_words).alias("blocks"))
    before = Window.partitionBy("rank").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = cut_lineage(bins.select("*", F.coalesce(F.sum("blocks").over(before), F.lit(0)).alias("block_offset")))
    totals = bins.groupBy("rank").agg(F.sum("blocks").alias("blocks")).join(sources.select("rank", "source_size", "target"), "rank")
    wanted = F.least(MOST_REPEATS * F.col("blocks"), F.floor(F.col("target") * F.col("blocks") / F.nullif(F.col("source_size"), F.lit(0)) + 0.5))
    totals = totals.withColumn("slots", F.coalesce(wanted, F.lit(0)).cast("long"))
    first = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    quotas = cut_lineage(totals.select("rank", "blocks", "slots", F.coalesce(F.sum("slots").over(first), F.lit(0)).alias("first_slot")))

    inside = Window.partitionBy("rank", "bin").orderBy("doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    filled = placed.filter("size > 0").join(bins.drop("blocks"), ["rank", "bin"])
    local = F.explode(F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("start") + F.col("size") - 1) / block_words)))
    pieces = filled.select("row", "rank", "block_offset", "start", "size", local.alias("local"))
    low = F.greatest(F.col("start"), F.col("local") * block_words)
    high = F.least(F.col("start") + F.col("size"), (F.col("local") + 1) * block_words)
    pieces = pieces.select("row", "rank", (F.col("block_offset") + F.col("local")).alias("block"), (low - F.col("start")).alias("first"), (high - low).alias("words"))

    total = quotas.agg(F.sum("slots")).first()[0] or 0
    return placed, pieces, draw_slots(spark, quotas, total)


def draw_slots(spark, quotas: DataFrame, total: int, shard_blocks: int = SHARD_BLOCKS) -> DataFrame:
    """Every output slot with the source it draws from and the block it reads: ``shard, slot, rank, epoch, block``."""
    n = F.lit(max(total, 1))
    slots = spark.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_blocks).alias("shard"))
    drawn = slots.withColumn("draw", permuted(F.col("slot"), n, F.lit(1))).withColumn("cell", F.floor(F.col("draw") * LOOKUP_CELLS / n))
    last = F.col("first_slot") + F.col("slots") - 1
    ranges = quotas.filter("slots > 0").withColumn(
        "cell", F.explode(F.sequence(F.floor(F.col("first_slot") * LOOKUP_CELLS / n), F.floor(last * LOOKUP_CELLS / n)))
    )
    inside = (F.col("draw") >= F.col("first_slot")) & (F.col("draw") <= last)
    found = drawn.join(small(cut_lineage(ranges)), "cell").filter(inside).withColumn("turn", F.col("draw") - F.col("first_slot"))
    found = found.withColumn("epoch", F.floor(F.col("turn") / F.col("blocks"))).withColumn("index", F.col("turn") % F.col("blocks"))
    block = permuted(F.col("index"), F.col("blocks"), F.col("rank") * 7919 + F.col("epoch") * 104729 + 2)
    return found.select("shard", "slot", "rank", "epoch", block.alias("block"))


def words_taken(docs: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for every document; ``taken`` counts repeats."""
    placed, pieces, slots = plan_mix(sized(docs), block_words)
    times = slots.groupBy("rank", "block").agg(F.count(F.lit(1)).alias("times"))
    taken = pieces.join(times, ["rank", "block"]).groupBy("row").agg(F.sum(F.col("words") * F.col("times")).alias("taken"))
    return placed.select("row", "doc_id", "size", "source_size", "target").join(taken, "row", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken")
    )


def mixed(docs: DataFrame, block_words: int) -> DataFrame:
    """The mix as documents: one row per document and epoch with the words that the epoch takes.

    A document taken whole keeps its text as it is; of one taken in part, the words taken follow in
    text order, joined by one space. All columns of ``docs`` are kept, ``n_chars`` is counted anew.
    """
    row, piece = "__row", F.struct("first", "words")
    numbered = cut_lineage(docs.withColumn(row, F.monotonically_increasing_id()))
    size = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(WORD)).cast("long")
    rows = cut_lineage(numbered.select("doc_id", "source", size.alias("size"), F.col(row).alias("row")))
    _, pieces, slots = plan_mix(rows, block_words)
    parts = pieces.join(slots.select("rank", "epoch", "block"), ["rank", "block"]).groupBy("row", "epoch").agg(
        F.sort_array(F.collect_list(piece)).alias("__parts"), F.sum("words").alias("__taken")
    )
    whole = rows.select(F.col("row").alias(row), F.col("size").alias("__size"))
    joined = numbered.join(parts.withColumnRenamed("row", row), row).join(whole, row)
    words = F.regexp_extract_all("text", F.lit(f"({WORD})"))
    chosen = F.flatten(F.transform("__parts", lambda p: F.slice(words, (p["first"] + 1).cast("int"), p["words"].cast("int"))))
    text = F.when(F.col("__taken") == F.col("__size"), F.col("text")).otherwise(F.concat_ws(" ", chosen))
    taken = joined.withColumn("__text", text)
    columns = [F.col("__text") if c == "text" else F.length("__text").cast("long") if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return taken.select(*[column.alias(c) for column, c in zip(columns, docs.columns, strict=True)])


def _permuted_sql(relation: str, x: str, n: str, seed: str, out: str) -> str:
    inner = f"(SELECT *, {x}::BIGINT AS {out} FROM {relation})"
    for a, b, c, d in ROUND_KEYS:
        inner = f"(SELECT *, ((({a}::BIGINT * (({seed})::BIGINT % {PRIME}) + {b}) % {PRIME}) % ({n}) - {out} + {n}) % ({n}) AS other_ FROM {inner})"
        inner = f"(SELECT * EXCLUDE (other_, {out}), CASE WHEN (((greatest({out}, other_) % {PRIME}) * {c}::BIGINT + {d}) % {PRIME}) // 65536 % 2 = 1 THEN other_ ELSE {out} END AS {out} FROM {inner})"
    return inner


SQL = f"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents
), ranked AS (
  SELECT source, sum(size)::BIGINT AS source_size, count(*) AS docs, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM sizes GROUP BY source
), weighed AS (
  SELECT *, [5, 2, 1][((rank - 1) % 3 + 1)::INTEGER]::BIGINT AS weight FROM ranked
), tried AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER fill, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0))::DOUBLE AS level
  FROM weighed WINDOW fill AS (ORDER BY (3 * source_size)::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), sources AS (
  SELECT *, CASE WHEN 3 * source_size <= level * weight THEN (3 * source_size)::DOUBLE
    ELSE weight * max(CASE WHEN NOT 3 * source_size <= level * weight THEN level END) OVER () END AS target FROM tried
), placed AS (
  SELECT s.doc_id, s.size, p.rank, p.source_size, p.target, ('0x' || substr(md5(coalesce(s.doc_id::VARCHAR, '')), 1, 8))::BIGINT % ceil(sqrt(p.docs))::BIGINT AS bin, row_number() OVER () AS line
  FROM sizes s JOIN sources p ON s.source IS NOT DISTINCT FROM p.source
), bins AS (
  SELECT rank, bin, blocks, coalesce(sum(blocks) OVER (PARTITION BY rank ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS block_offset
  FROM (SELECT rank, bin, ceil(sum(size) / {BLOCK_WORDS}.0)::BIGINT AS blocks FROM placed GROUP BY ALL)
), totals AS (
  SELECT rank, blocks, coalesce(least(3 * blocks, floor(target * blocks / nullif(source_size, 0) + 0.5)), 0)::BIGINT AS slots
  FROM (SELECT rank, sum(blocks)::BIGINT AS blocks FROM bins GROUP BY rank) JOIN sources USING (rank)
), quotas AS (
  SELECT *, coalesce(sum(slots) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first_slot, sum(slots) OVER ()::BIGINT AS n FROM totals
), drawn AS (
  SELECT slot, draw FROM {_permuted_sql("(SELECT unnest(range((SELECT max(n) FROM quotas))) AS slot, (SELECT max(n) FROM quotas) AS n)", "slot", "n", "1", "draw")}
), found AS (
  SELECT q.rank, q.blocks, (draw - first_slot) // q.blocks AS epoch, (draw - first_slot) % q.blocks AS index_
  FROM drawn d ASOF JOIN (SELECT * FROM quotas WHERE slots > 0) q ON d.draw >= q.first_slot
), times AS (
  SELECT rank, block, count(*) AS times FROM {_permuted_sql("found", "index_", "blocks", "rank * 7919 + epoch * 104729 + 2", "block")} GROUP BY ALL
), started AS (
  SELECT *, coalesce(sum(size) OVER (PARTITION BY rank, bin ORDER BY doc_id, size, line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM placed
), pieces AS (
  SELECT line, rank, block_offset, start, size, unnest(range(start // {BLOCK_WORDS}, (start + size - 1) // {BLOCK_WORDS} + 1)) AS local
  FROM started JOIN bins USING (rank, bin) WHERE size > 0
), taken AS (
  SELECT line, sum((least(start + size, (local + 1) * {BLOCK_WORDS}) - greatest(start, local * {BLOCK_WORDS})) * times)::BIGINT AS taken
  FROM pieces JOIN times ON times.rank = pieces.rank AND times.block = block_offset + local GROUP BY line
)
SELECT doc_id, size, source_size, target, coalesce(taken, 0) AS taken FROM placed LEFT JOIN taken USING (line)
"""
