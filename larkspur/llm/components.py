"""Connected components over tables: alternating large-star and small-star, and the search for links in buckets.

Nothing here collects nodes or links: the driver sees two counts for each round.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import forget_shuffles, materialise, release

MAX_ROUNDS = 60
MANY = 1_000_000  # edges
TOPS = 16  # of a node's largest buckets, by which a pair that meets in several of them is looked at once


def _state(edges: DataFrame) -> tuple[int, int]:
    """How many edges there are, and how many nodes keep them from being stars: those with several edges up, or with edges up and down."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.lit(1).alias("up")), F.struct(F.col("v").alias("x"), F.lit(0).alias("up")))).alias("e"))
    nodes = ends.groupBy("e.x").agg(F.sum("e.up").alias("up"), F.count("*").alias("n"))
    torn = F.expr("up > 1 OR (up > 0 AND n > up)").cast("int")
    return tuple(nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.coalesce(F.sum(torn), F.lit(0))).first())


def connected_components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links(a, b)``; the component is its smallest node. Each star
    step is a min per node (combined before the shuffle), written out from ``MANY`` edges on so that AQE may split the join that
    follows; with fewer, one job for each round is less than the start of five."""
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct()
    edges = materialise(edges, "edges")
    for _ in range(MAX_ROUNDS):
        n, torn = _state(edges)
        if not torn:
            break
        kept = materialise if n >= MANY else lambda df, name: df
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "low")
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = kept(large, "large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "edges")
        release(edges, low, large, least)
        edges = after
    else:
        raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def shared_buckets(members: DataFrame) -> DataFrame:
    """``key, node, size`` of the rows of ``members(key, node)`` whose key has several nodes, written out. Of keys with
    the same nodes (known by their number, least, largest, and two hashes over all) one is enough."""
    of_all = [F.try_sum(F.shiftright(F.xxhash64("node"), 20)).alias("s"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("x")]
    many = members.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("size"), *of_all).filter("lo < hi")
    many = materialise(many.groupBy("lo", "hi", "size", "s", "x").agg(F.min("key").alias("key")), "keys")  # an aggregate inside the join's stage would keep AQE from splitting a hot key
    return materialise(members.join(many.select("key", "size"), "key").select("key", "node", "size"), "buckets")


def linked_components(
    members: DataFrame,
    attributes: DataFrame,
    likely: Callable[[str, str], Column],
    verify: Callable[[DataFrame], DataFrame],
    rounds: int = 3,
    pivots: int = 1,
    own: bool = False,
    parts: int = 1,
) -> DataFrame:
    """``node, component`` over the verified links between nodes that share a key; no link is lost.

    ``members(key, node, size)`` comes from ``shared_buckets``; ``attributes(node, ...)`` has a row or
    more for each node (``own``: it is a table with rows of no other nodes, and is read as it is); ``likely(a_, b_)`` is a cheap necessary condition on attributes with those prefixes;
    ``verify(pairs(a, b))`` gives the true links.

    Pairs inside one component add nothing, so groups of copies are first gathered without listing their
    pairs: in ``rounds`` rounds every node is held against one pivot of each of its buckets, from the
    bucket's largest component. The first pivots are the nodes that share most buckets, as the original
    among altered copies does; later ones, ``pivots`` of each bucket, are drawn by hash. What can be missing then are links between
    components: in buckets that span several, the nodes outside the largest are held against all nodes of
    other components, under ``likely`` within the join, which is exhaustive. Nodes that share a passage meet in nearly
    all buckets of it: a pair is looked at in the first bucket that both have among their ``TOPS`` largest, else in each.
    Attributes of all nodes of a bucket are shuffled for that; with ``parts``, for one part of the buckets after another, so that
    the shuffle of one is gone before the next. All buckets are searched."""
    columns = [c for c in attributes.columns if c != "node"]
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    degree = materialise(degree, "degrees")
    nodes = attributes if own else materialise(attributes.join(degree.select("node"), "node", "left_semi"), "nodes")
    mine = lambda p: nodes.select(F.col("node").alias(p), *[F.col(x).alias(f"{p}_{x}") for x in columns])
    ordered = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    comps = None

    def torn(members: DataFrame, orders: list[Column]) -> DataFrame:
        """Rows of buckets with several components: ``key, node, component, main, pivots, size``. A bucket that is in
        one component stays so, so that each round looks at what the one before has left."""
        placed = members.select("key", "node").join(degree, "node")
        if comps is None:
            placed = placed.withColumn("component", F.col("node"))
        else:
            placed = placed.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
        placed = materialise(placed.select("key", "node", "component", *[x.alias(f"rank{j}") for j, x in enumerate(orders)]), "placed")
        tops = [F.max(F.struct(F.col(f"rank{j}").alias("rank"), "node")).alias(f"top{j}") for j in range(len(orders))]
        parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), *tops)
        best = F.struct("n", *[f"top{j}" for j in range(len(orders))], "component")
        main = parts.groupBy("key").agg(F.max(best).alias("m"), F.sum("n").alias("size"), F.count("*").alias("parts")).filter("parts > 1")
        drawn = F.array_distinct(F.array(*[F.col(f"m.top{j}.node") for j in range(len(orders))]))
        main = materialise(main.select("key", "size", drawn.alias("pivots"), F.col("m.component").alias("main")), "main")
        out = materialise(placed.join(main, "key").select("key", "node", "component", "main", "pivots", "size"), "torn")
        release(placed, main)
        return out

    def joined(links: DataFrame) -> DataFrame:
        if comps is not None:
            stars = comps.filter("node != component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            links = stars.unionByName(links.select("a", "b"))
        return materialise(connected_components(links), "components")

    spent = []
    for k in range(rounds):
        members = torn(members, [F.col("degree")] if k == 0 else [F.xxhash64("node", F.lit(k), F.lit(j)) if j else F.xxhash64("node", F.lit(k)) for j in range(pivots)])
        release(*spent)
        spent = [members]
        asked = members.filter("component != main").select("node", F.explode("pivots").alias("pivot"))
        asked = materialise(asked.select(*ordered("node", "pivot")).distinct(), "asked")
        if asked.isEmpty():  # every bucket is in one component
            break
        pairs = asked.join(mine("a"), "a").join(mine("b"), "b").filter(likely("a_", "b_")).select("a", "b")
        links = materialise(verify(pairs), "links")
        release(asked)
        if links.isEmpty():
            break
        comps = joined(links)
        release(links)

    last = torn(members, [F.xxhash64("node")])
    tops = F.slice(F.sort_array(F.collect_list(F.struct("size", "key")), asc=False), 1, TOPS)["key"]
    homes = materialise(last.groupBy("node").agg(tops.alias("tops")), "homes")
    rest = last.select("key", "node", "component", "main").join(nodes, "node").join(homes, "node")
    columns.append("tops")
    if parts > 1:
        rest = materialise(rest, "rest")
    few = rest.filter("component != main").select("key", F.col("node").alias("a"), F.col("component").alias("a_c"), *[F.col(x).alias(f"a_{x}") for x in columns])
    every = rest.select(F.col("key").alias("k"), F.col("node").alias("b"), (F.col("component") == F.col("main")).alias("b_main"), F.col("component").alias("b_c"), *[F.col(x).alias(f"b_{x}") for x in columns])
    first = lambda x: F.get(f"{x}_tops", F.lit(0))
    here = F.when(first("a") == first("b"), F.col("key") == first("a")).otherwise(F.coalesce(F.col("key") == F.get(F.array_intersect("a_tops", "b_tops"), F.lit(0)), F.lit(True)))
    once = (F.col("b_main") | (F.col("a") < F.col("b"))) & here
    found = []
    for part in range(parts):
        of = lambda df, key: df.filter(F.pmod(F.xxhash64(key), F.lit(parts)) == part) if parts > 1 else df  # noqa: B023, E731
        cross = of(few, "key").join(of(every, "k"), (F.col("key") == F.col("k")) & (F.col("a_c") != F.col("b_c")) & once & likely("a_", "b_"))
        found.append(cross.select(*ordered("a", "b")).distinct())
        if parts > 1:
            found[part] = materialise(found[part], "crossed")
            forget_shuffles(members.sparkSession)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    if parts > 1:
        release(rest)
        pairs = pairs.distinct()
    links = materialise(verify(pairs), "links")
    release(*found)
    if not links.isEmpty():
        comps = joined(links)
    if comps is None:
        comps = materialise(connected_components(links), "components")
    release(*spent, last, homes, links, nodes, degree)
    return comps
