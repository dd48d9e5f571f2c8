"""What the tables say about each other: profiles, roles, keys, paths, lineage, insights."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.rules import first_match
from tidemark.functions.values import money, share, token_estimate
from tidemark.operators.analytics import union_tables
from tidemark.session import MOST_BROADCAST_ROWS, by_rows, cut_lineage

# Limits of the tests and the normal quantile they compare with.
LEAST_SAMPLE = 100
NORMAL_95 = 1.96
APPROXIMATION = 0.02  # standard deviation of an estimated count of different values
SKETCH_LOG = 9  # a sketch keeps 2^9 hashes: enough to meet a missing value unless all but a few are there
INSIGHT_CONFIDENCE = 0.7
TOP_INSIGHTS = 10
NUMBER_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")
TIME_TYPES = ("date", "timestamp")


def column_profile(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows, nulls, different values, least and greatest value per column, all exact.

    Each column is read and counted by value on its own: column pruning keeps the total read at one
    pass, and the shuffle moves different values only.
    """
    parts = []
    for c in columns:
        values = df.groupBy(F.col(c).alias("v")).agg(F.count(F.lit(1)).alias("n"))
        parts.append(values.agg(
            F.sum("n").alias("rows"),
            F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("nulls"),
            F.count("v").alias("distinct_values"),
            F.min("v").cast("string").alias("least"),
            F.max("v").cast("string").alias("greatest"),
        ).select(
            F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(dict(df.dtypes)[c]).alias("type"), "*"
        ))
    return union_tables(parts)


def column_profile_approx(table: str, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The same from one pass without a shuffle of values; counts of different values are estimates."""
    measured = df.agg(
        F.count(F.lit(1)).alias("rows"),
        *[
            m.alias(f"{c}__{name}")
            for c in columns
            for name, m in (
                ("nulls", F.count_if(F.col(c).isNull())),
                ("distinct_values", F.approx_count_distinct(c, APPROXIMATION)),
                ("least", F.min(c).cast("string")),
                ("greatest", F.max(c).cast("string")),
            )
        ],
    )
    types = dict(df.dtypes)
    rows = F.array(*[
        F.struct(
            F.lit(table).alias("table"), F.lit(c).alias("column"), F.lit(types[c]).alias("type"), F.col("rows"),
            *[F.col(f"{c}__{n}").alias(n) for n in ("nulls", "distinct_values", "least", "greatest")],
        )
        for c in columns
    ])
    return measured.select(F.inline(rows))


def column_roles(profiles: DataFrame) -> DataFrame:
    """Role of each profiled column: identifier, foreign_key, timestamp, metric or dimension."""
    keyed = F.lower(F.col("column")).rlike("(key|id|_by)$")
    unique = (F.col("distinct_values") == F.col("rows")) & (F.col("nulls") == 0)
    number = F.col("type").rlike("^(" + "|".join(NUMBER_TYPES) + ")")
    role = first_match(
        [
            (keyed & unique, "identifier"),
            (keyed, "foreign_key"),
            (F.col("type").rlike("^(" + "|".join(TIME_TYPES) + ")"), "timestamp"),
            (number, "metric"),
        ],
        "dimension",
    )
    return profiles.select("table", "column", role.alias("role"))


def fk_discovery(
    columns: Mapping[str, Column | str], tables: Mapping[str, DataFrame], least: float = 1.0, normalize=None
) -> DataFrame:
    """Pairs of columns in which the values of one (child) are found in a unique other (parent).

    ``columns`` names the columns as ``table.column``. Values are reduced to different ones, and each value
    to the set of columns that hold it; only the count per such set goes on. So the one shuffle moves
    different values, and pairs are formed from a handful of sets, never from rows.
    """
    parts = []
    for full, column in columns.items():
        table = full.split(".")[0]
        value = F.col(column) if isinstance(column, str) else column
        value = normalize(value) if normalize else value.cast("string")
        parts.append(
            tables[table].select(F.lit(full).alias("c"), value.alias("v")).filter("v IS NOT NULL").groupBy("c", "v").agg(
                F.count(F.lit(1)).alias("n")
            )
        )
    values = union_tables(parts).groupBy("v").agg(
        F.array_sort(F.collect_list(F.struct("c", (F.col("n") > 1).alias("again")))).alias("held_by")
    )
    sets = cut_lineage(values.groupBy("held_by").agg(F.count(F.lit(1)).alias("values")))
    each = sets.select(F.explode("held_by").alias("h"), "values").groupBy("h.c").agg(
        F.sum("values").alias("total"), F.max("h.again").alias("repeats")
    )
    pairs = sets.select(F.explode("held_by.c").alias("child"), "held_by", "values").select(
        "child", F.explode("held_by.c").alias("parent"), "values"
    ).filter("child <> parent").groupBy("child", "parent").agg(F.sum("values").alias("shared"))
    children = each.select(F.col("c").alias("child"), F.col("total").alias("child_values"))
    parents = each.filter(~F.col("repeats")).select(F.col("c").alias("parent"))
    found = pairs.join(children, "child").join(parents, "parent").select(
        "child", "parent", share(F.col("shared"), F.col("child_values")).alias("containment")
    )
    own = F.split_part("child", F.lit("."), F.lit(1)) == F.split_part("parent", F.lit("."), F.lit(1))
    return found.filter((F.col("containment") >= least) & ~own)


def _per_column(columns: Mapping[str, Column | str], tables: Mapping[str, DataFrame], normalize, measures) -> DataFrame:
    """A row per column, from one pass per table without a shuffle of values: its name ``c`` and the aggregates that ``measures`` names."""
    parts = []
    for table in dict.fromkeys(full.split(".")[0] for full in columns):
        own = [full for full in columns if full.split(".")[0] == table]
        values = [F.col(c) if isinstance(c, str) else c for c in (columns[full] for full in own)]
        texts = tables[table].select(*[(normalize(v) if normalize else v.cast("string")).alias(f"_v{k}") for k, v in enumerate(values)])
        rows = texts.agg(*[
            F.struct(F.lit(full).alias("c"), *[m.alias(name) for name, m in measures(F.col(f"_v{k}")).items()]).alias(f"_v{k}") for k, full in enumerate(own)
        ])
        parts.append(rows.select(F.inline(F.array(*texts.columns))))
    return cut_lineage(union_tables(parts))


def key_candidates(columns: Mapping[str, Column | str], tables: Mapping[str, DataFrame], normalize=None, log_entries: int = SKETCH_LOG) -> DataFrame:
    """``child, parent``: the pairs of columns of which the child's values can all be in a unique parent, told without shuffling values.

    The first pass over each table sums up every column: rows, least and greatest value, and a theta sketch (the least hashes of its
    values, mergeable, of a bounded size). A parent with more rows than its estimated number of values and six standard errors allow is not
    unique. The second pass asks which columns hold the least and greatest values of the others, two per column; pairs
    come from equi-joins on these. The difference of two sketches holds hashes of the child below both thresholds that
    the parent lacks; one such hash proves a missing value. All tests are necessary ones, so no pair that holds is lost.
    """
    facts = _per_column(columns, tables, normalize, lambda v: {
        "rows": F.count(v), "sketch": F.theta_sketch_agg(v, log_entries), "low": F.min(v), "high": F.max(v),
    }).filter("rows > 0")
    ends = [end for row in facts.select("low", "high").distinct().collect() for end in row]  # two values per column
    held = _per_column(columns, tables, normalize, lambda v: {"held": F.collect_set(F.when(v.isin(ends), v))}).select("c", F.explode("held").alias("v"))
    own = lambda name: F.split_part(name, F.lit("."), F.lit(1))
    unique = facts.filter(F.col("rows") <= F.theta_sketch_estimate("sketch") * (1 + 6 / 2 ** (log_entries / 2)))
    parents = unique.select(F.col("c").alias("parent"), F.col("sketch").alias("parent_sketch"))
    low, high = (held.select(F.col("c").alias("parent"), F.col("v").alias(end)) for end in ("low", "high"))
    pairs = facts.withColumnRenamed("c", "child").join(low, "low").join(high, ["high", "parent"]).filter(own("child") != own("parent")).join(parents, "parent")
    missing = F.theta_sketch_estimate(F.theta_difference("sketch", "parent_sketch"))
    return pairs.filter(missing == 0).select("child", "parent")


def fk_discovery_sketched(columns: Mapping[str, Column | str], tables: Mapping[str, DataFrame], normalize=None, log_entries: int = SKETCH_LOG) -> DataFrame:
    """``fk_discovery`` at full containment with sketches first: only columns of pairs that may hold are compared value by value.

    Of the data the driver sees the names of these pairs and two values per column.
    """
    left = key_candidates(columns, tables, normalize, log_entries).collect()
    kept = {name for pair in left for name in pair}
    if not kept:
        return next(iter(tables.values())).select(F.lit("").alias("child"), F.lit("").alias("parent"), F.lit(0.0).alias("containment")).limit(0)
    found = fk_discovery({name: column for name, column in columns.items() if name in kept}, tables, normalize=normalize)
    pairs = found.sparkSession.createDataFrame([tuple(pair) for pair in left], "child string, parent string")
    return found.join(pairs, ["child", "parent"])


def temporal_relation(left: DataFrame, right: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """Share of entities whose first ``first`` comes before their first ``second``."""
    a = left.groupBy(key).agg(F.min(first).alias("a"))
    b = right.groupBy(key).agg(F.min(second).alias("b"))
    return a.join(b, key).agg(
        F.count(F.lit(1)).alias("entities"),
        share(F.count_if(F.col("a") <= F.col("b")), F.count(F.lit(1))).alias("ordered_share"),
    )


def reach(edges: DataFrame, starts: DataFrame, join_levels: int = 8) -> DataFrame:
    """Nodes reached from the starts along ``src`` → ``dst``, with depth and the least shortest path.

    One round per level, until a level finds nothing new; every level is written to the shared folder, so
    plans stay short and a lost executor costs no earlier level. Nodes seen before are left out, so cycles
    end. Every ``join_levels`` levels the nodes seen so far become one dataset again.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    frontier = cut_lineage(starts.select("node", F.lit(0).alias("depth"), F.col("node").alias("path")))
    seen = frontier
    for depth in count(1):
        step = frontier.join(links, frontier["node"] == links["src"]).groupBy(F.col("dst").alias("node")).agg(
            F.min(F.concat("path", F.lit(">"), "dst")).alias("path")
        )
        frontier = cut_lineage(
            step.join(seen.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth"), "path")
        )
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % join_levels == 0:
            seen = cut_lineage(seen)
    return seen


def reach_far(edges: DataFrame, starts: DataFrame, paths: bool = True) -> DataFrame:
    """``reach`` for deep graphs: rounds follow the logarithm of the longest chain, and the depth of what is left without chains.

    A node with one edge in and one out that is no start is inside a chain. Every such node points to its predecessor,
    and in each round to what that one points to, so after ``log2`` of a chain's length all its nodes know their distance and path from
    the chain's head. Chains then are single edges of a length, over which depths are corrected until none falls, and the
    nodes inside are placed behind their heads. A circle of such nodes alone has no head and cannot be reached.
    """
    links = cut_lineage(edges.select("src", "dst").distinct())
    ends = links.groupBy("dst").agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("head")).filter("n = 1").select(F.col("dst").alias("node"), "head")
    out = links.groupBy("src").agg(F.count(F.lit(1)).alias("n")).filter("n = 1").select(F.col("src").alias("node"))
    step = F.concat(F.lit(">"), F.col("node")) if paths else F.lit("")
    inside = ends.join(out, "node", "left_semi").join(starts.select("node"), "node", "left_anti")
    jumps = cut_lineage(inside.select("node", "head", F.lit(1).cast("long").alias("far"), step.alias("way")))
    size = jumps.count()
    for _ in range(size.bit_length()):
        nearer = jumps.select(F.col("node").alias("head"), F.col("head").alias("above"), F.col("far").alias("further"), F.col("way").alias("before"))
        joined = jumps.join(nearer, "head", "left")
        known = F.col("above").isNotNull()
        jumps = cut_lineage(joined.select(
            "node", F.coalesce("above", "head").alias("head"), (F.col("far") + F.coalesce("further", F.lit(0))).alias("far"),
            F.concat(F.coalesce("before", F.lit("")), "way").alias("way"), known.alias("moved"),
        ))
        if jumps.filter("moved").isEmpty():
            break
        jumps = jumps.drop("moved")
    jumps = jumps.select("node", "head", "far", "way")
    headed = jumps.join(jumps.select(F.col("node").alias("head")), "head", "left_anti") if size else jumps
    into = links.join(jumps.select(F.col("node").alias("dst")), "dst", "left_anti")
    last = F.concat(F.lit(">"), F.col("dst")) if paths else F.lit("")
    behind = headed.select(F.col("node").alias("src"), "head", "far", "way")
    roads = cut_lineage(into.join(behind, "src", "left").select(
        F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("far", F.lit(0)) + 1).alias("far"), F.concat(F.coalesce("way", F.lit("")), last).alias("way")
    ))
    best = cut_lineage(starts.select("node", F.lit(0).cast("long").alias("depth"), (F.col("node") if paths else F.lit("")).alias("path")))
    front = best
    while True:
        met = front.join(roads, front["node"] == roads["src"]).select(F.col("dst").alias("node"), (F.col("depth") + F.col("far")).alias("depth"), F.concat("path", "way").alias("path"))
        offers = met.groupBy("node").agg(F.min(F.struct("depth", "path")).alias("new"))
        after = cut_lineage(best.withColumn("old", F.struct("depth", "path")).select("node", "old").join(offers, "node", "full").select(
            "node", F.least("old", "new").alias("now"), (F.col("old").isNull() | (F.col("new") < F.col("old"))).alias("changed")
        ))
        best = after.select("node", "now.depth", "now.path")
        front = after.filter("changed").select("node", "now.depth", "now.path")
        if front.isEmpty():
            break
    within = headed.join(best.withColumnRenamed("node", "head"), "head").select("node", (F.col("depth") + F.col("far")).alias("depth"), F.concat("path", "way").alias("path"))
    found = best.union(within).select("node", F.col("depth").cast("int").alias("depth"), "path")
    return found if paths else found.drop("path")


def join_paths(keys: DataFrame, start: str) -> DataFrame:
    """Shortest join path from one table to each other, over discovered keys in either direction."""
    tables = keys.select(
        F.split_part("child", F.lit("."), F.lit(1)).alias("a"), F.split_part("parent", F.lit("."), F.lit(1)).alias("b")
    )
    edges = tables.select(F.col("a").alias("src"), F.col("b").alias("dst")).unionByName(
        tables.select(F.col("b").alias("src"), F.col("a").alias("dst"))
    )
    starts = keys.sparkSession.createDataFrame([(start,)], "node string")
    return reach(edges, starts)


def connected_groups(edges: DataFrame) -> DataFrame:
    """Least node id of each connected group, for the nodes that have an edge; an edge with a null end is none.

    Rounds of hooking and contraction: each node points to its least neighbour, which makes trees (the ends of a two-cycle share the lesser as root), pointers
    jump to the roots, and links between different roots are the next round's. A root has taken in a neighbour at least, so nodes
    halve each round and usually fall by much more: the links are read once in full, not in every round. Only nodes that others point to jump.
    Tables of many nodes are joined by sorting, whatever their files' size.
    """
    whole = edges.select("src", "dst").filter("src IS NOT NULL AND dst IS NOT NULL")
    links = cut_lineage(whole.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct())
    rounds = []
    while True:
        other = F.when(F.col("src") != F.col("dst"), F.col("dst"))
        ends = links.select("src", other.alias("dst")).unionByName(links.filter("src <> dst").select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        up = cut_lineage(ends.groupBy(F.col("src").alias("node")).agg(F.coalesce(F.min("dst"), F.col("src")).alias("up")))
        many = up.count() > MOST_BROADCAST_ROWS
        roots = _roots(up, many)
        rounds.append(by_rows(cut_lineage(up.join(_sorted(roots.withColumnsRenamed({"node": "up"}), many), "up").select("node", "root"))))
        near, far = (rounds[-1].withColumnsRenamed({"node": end, "root": f"{end}_root"}) for end in ("src", "dst"))
        between = links.filter("src <> dst").join(near, "src").join(far, "dst").filter("src_root <> dst_root")
        links = cut_lineage(between.select(F.least("src_root", "dst_root").alias("src"), F.greatest("src_root", "dst_root").alias("dst")).distinct())
        if links.isEmpty():
            break
    # from the last round back, so that only the first is joined in full
    named = cut_lineage(rounds[0].groupBy("root").agg(F.min("node").alias("grp")))
    if len(rounds) > 1:
        last = rounds[-1].withColumnsRenamed({"root": "final"})
        for later in reversed(rounds[1:-1]):
            last = _renamed(later, last)
        taken = _renamed(named.select(F.col("root").alias("node"), "root", "grp"), last, "grp")
        least = by_rows(cut_lineage(taken.groupBy("final").agg(F.min("grp").alias("grp"))))
        named = cut_lineage(taken.select(F.col("node").alias("root"), "final").join(least, "final").select("root", "grp"))
    return rounds[0].join(by_rows(named), "root").select("node", "grp")


def _sorted(df: DataFrame, many: bool) -> DataFrame:
    return df.hint("merge") if many else df


def _renamed(round_: DataFrame, last: DataFrame, *columns: str) -> DataFrame:
    """``node, final`` and ``columns`` of a round's nodes, from their roots and what later rounds made of those."""
    found = round_.join(last.withColumnsRenamed({"node": "root"}), "root", "left")
    return by_rows(cut_lineage(found.select("node", F.coalesce("final", "root").alias("final"), *columns)))


def _roots(up: DataFrame, many: bool) -> DataFrame:
    """``node, root`` of the nodes that others point to; ``up`` has ``node, up``, and its only cycles are of one or two nodes."""
    inner = cut_lineage(up.join(_sorted(up.select(F.col("up").alias("node")).distinct(), many), "node", "left_semi"))
    over = inner.select(F.col("node").alias("up"), F.col("up").alias("over"))
    new = F.when(F.col("over") == F.col("node"), F.least("node", "up")).otherwise(F.col("over"))
    found = cut_lineage(inner.join(_sorted(over, many), "up").select("node", new.alias("root")))
    while True:
        over = found.select(F.col("node").alias("root"), F.col("root").alias("over"))
        jumped = cut_lineage(found.join(_sorted(over, many), "root").select("node", F.col("root").alias("old"), F.col("over").alias("root")))
        found = jumped.select("node", "root")
        if jumped.filter("root <> old").isEmpty():
            return found


def group_rate_test(df: DataFrame, group: str, hit: Column) -> DataFrame:
    """Rate per group against the rest: two-proportion z, significant above 1.96 with enough rows."""
    counted = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.count_if(hit).alias("hits"))
    total = counted.agg(F.struct(F.sum("n").alias("n"), F.sum("hits").alias("hits")))
    both = counted.withColumn("_all", total.scalar())
    rest_n, rest_hits = F.col("_all.n") - F.col("n"), F.col("_all.hits") - F.col("hits")
    rate, rest_rate = share(F.col("hits"), F.col("n")), share(rest_hits, rest_n)
    pooled = share(F.col("_all.hits"), F.col("_all.n"))
    spread = F.sqrt(pooled * (1 - pooled) * (1.0 / F.col("n") + 1.0 / rest_n))
    return both.select(
        group, "n", rate.alias("rate"), rest_rate.alias("rest_rate"),
        F.try_divide(rate - rest_rate, spread).alias("z"),
    ).withColumn("significant", (F.col("n") > LEAST_SAMPLE) & (F.abs("z") > NORMAL_95))


def ratio_to_baseline(df: DataFrame, group: str, measure: str) -> DataFrame:
    """Average per group over the average of all rows."""
    sums = df.groupBy(group).agg(F.count(measure).alias("n"), F.sum(money(F.col(measure))).alias("s"))
    total = sums.agg(share(F.sum("s"), F.sum("n"))).scalar()
    average = share(F.col("s"), F.col("n"))
    return sums.select(group, "n", average.alias("average"), (average / total).alias("ratio"))


def engagement_bands(df: DataFrame, interactions: str, amount: str) -> DataFrame:
    """Rows, average amount and correlation of the whole set, by band of interactions."""
    band = F.when(F.col(interactions) <= 2, "0-2").when(F.col(interactions) < 5, "3-4").otherwise("5+")
    correlation = df.agg(F.corr(interactions, amount)).scalar()
    return df.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("rows"), share(F.sum(money(F.col(amount))), F.count(F.lit(1))).alias("average_amount")
    ).withColumn("correlation", correlation)


def adoption_gap(df: DataFrame, uses: Column, churned: Column) -> DataFrame:
    """Share of rows that use a feature, and churn among users and others."""
    return df.agg(
        share(F.count_if(uses), F.count(F.lit(1))).alias("adoption"),
        share(F.count_if(uses & churned), F.count_if(uses)).alias("churn_users"),
        share(F.count_if(~uses & churned), F.count_if(~uses)).alias("churn_others"),
    )


def rank_insights(insights: DataFrame, confidence: str, value: str, tie: str, top: int = TOP_INSIGHTS) -> DataFrame:
    return insights.filter(F.col(confidence) > INSIGHT_CONFIDENCE).orderBy(F.col(value).desc(), tie).limit(top)


def warehouse_context(tables: Mapping[str, DataFrame]) -> DataFrame:
    """One JSON row per table: columns with types, row count and likely keys, with a token estimate."""
    parts = []
    for name, df in tables.items():
        columns = F.array(*[F.struct(F.lit(c).alias("name"), F.lit(d).alias("type")) for c, d in df.dtypes])
        keys = F.array(*[F.lit(c) for c, _ in df.dtypes if c.lower().endswith(("key", "id"))] or [F.lit("")])
        parts.append(df.agg(F.count(F.lit(1)).alias("rows")).select(
            F.lit(name).alias("table"), "rows",
            F.to_json(F.struct(F.lit(name).alias("table"), "rows", columns.alias("columns"), keys.alias("keys"))).alias("context"),
        ))
    return union_tables(parts).withColumn("tokens", token_estimate(F.col("context")))
