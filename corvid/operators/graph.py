"""G area: call graphs as node/edge DataFrames and iterative dataflow.

Each loop round is a join plus an anti join; the per-round result is
checkpointed to the shared checkpoint folder (``plans.ordering.materialize``,
a reliable checkpoint; never a local one), which cuts lineage and survives
executor loss. Round counts are
bounded by graph depth (reachability, levels) or by O(log diameter) rounds
with pointer jumping (components).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvid.plans.ordering import materialize, shuffles_by_rows, with_global_position


def build_graph(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges out of inventory records ``(name, callees ARRAY)``.

    Only records whose callees are known (not NULL) contribute edges; callee
    names become nodes implicitly.
    """
    known = records.where(F.col("callees").isNotNull())
    edges = known.select(F.col("name").alias("src"), F.explode("callees").alias("dst")).distinct()
    nodes = known.select(F.col("name").alias("n")).union(edges.select(F.col("dst").alias("n"))).distinct()
    return nodes, edges


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    out_d = edges.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("out_degree"))
    in_d = edges.groupBy(F.col("dst").alias("n")).agg(F.count(F.lit(1)).alias("in_degree"))
    return (nodes.join(out_d, "n", "left").join(in_d, "n", "left")
            .select("n", F.coalesce("out_degree", F.lit(0)).alias("out_degree"),
                    F.coalesce("in_degree", F.lit(0)).alias("in_degree")))


def _union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


#: Rounds of the search after which the visited frontiers become one table.
MERGE_ROUNDS = 8


def reachable(nodes: DataFrame, edges: DataFrame, root: str) -> DataFrame:
    """Root and its descendants with their BFS depth.

    Frontier expansion: frontier ⋈ edges, minus visited (anti join). Each
    round's frontier is materialised once. The visited set is one table of the
    rounds up to the last merge and at most ``MERGE_ROUNDS`` frontiers since,
    so a deep graph makes no long plan.
    """
    spark = nodes.sparkSession
    if nodes.where(F.col("n") == F.lit(root)).isEmpty():
        raise ValueError(f"root {root!r} is not a node of the graph")
    e = materialize(edges.select("src", "dst"), "edges")
    frontier = spark.createDataFrame([(root, 0)], "n string, depth int")
    levels = [frontier]
    for depth in count(1):
        nxt = materialize(frontier.join(e, frontier["n"] == e["src"]).select(F.col("dst").alias("n")).distinct()
                          .join(_union_all(levels).select("n"), "n", "left_anti")
                          .withColumn("depth", F.lit(depth)), "frontier")
        if nxt.isEmpty():
            return _union_all(levels)
        levels.append(nxt)
        frontier = nxt
        if len(levels) > MERGE_ROUNDS:
            levels = [materialize(_union_all(levels), "visited")]
    raise RuntimeError("reachability did not converge")


#: A node with more than this part of all edges is hot; there are fewer than twice as many.
HOT_PART = 500


def _least_neighbours(edges: DataFrame) -> DataFrame:
    """(u, m, degree) from edge rows (u, v): the least of u and its v."""
    return edges.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count(F.lit(1)).alias("degree"))


def _join_least(edges: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """(u, v, m): the edges (u, v) with the least neighbour of u.

    The few hot nodes (at most ``HOT_PART`` of them) are broadcast with their
    answers and their edges are answered where they lie, so no task of the join
    has a hub's edges. (A salt that is constant on the other side won't do: the
    planner makes it a filter and deals by u alone.) All other edges are joined.
    """
    hot = F.broadcast(least.where(F.col("degree") > n_edges / HOT_PART).select("u", "m"))
    cold = edges.join(hot.select("u"), "u", "left_anti").join(least.select("u", "m"), "u", "left")
    return cold.select("u", "v", "m").union(edges.join(hot, "u").select("u", "v", "m"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node is linked to the node's least neighbour."""
    n = 2 * edges.count()
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    x = _join_least(both, materialize(_least_neighbours(both), "least"), n)
    return materialize(x.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large star")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its neighbours below are linked to the least of them; edges
    run from the greater node u to the lesser v."""
    n = edges.count()
    least = materialize(_least_neighbours(edges), "least")
    x = _join_least(edges, least, n).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return materialize(x.union(least.select("u", F.col("m").alias("v"))).distinct(), "small star")


def weak_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Component label (smallest node name) per node, edges undirected.

    Alternating star contraction: large stars and small stars in turn link
    every node ever closer to the least of its component, until each component
    is one star around it and a round changes nothing. Rounds grow with the
    logarithm of the size. No task holds a node's neighbours: the least of them
    is an aggregate that is combined before it is shuffled, and edges of hubs
    (in the end the label of a giant component) aren't shuffled to join it. Shuffles are dealt
    by the rows of the round, counted in both directions, so a task's memory
    stays as the graph grows; the labels are materialised likewise.
    """
    spark = edges.sparkSession
    e = edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("u <> v")

    def mark(x: DataFrame):
        return tuple(x.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    rows = 2 * edges.count()
    with shuffles_by_rows(spark, rows):
        e = materialize(e.distinct(), "edges")
    before = mark(e)
    while before[0]:
        rows = 2 * before[0]
        with shuffles_by_rows(spark, rows):
            e = _small_star(_large_star(e))
        now = mark(e)
        if now == before:
            break
        before = now
    labels = e.select(F.col("u").alias("n"), F.col("v").alias("label"))
    with shuffles_by_rows(spark, rows):
        return materialize(nodes.select("n").distinct().join(labels, "n", "left").withColumn("label", F.coalesce("label", "n")), "labels")


def levels_callee_first(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """level = rounds of peeling nodes none of whose callees is unpeeled.

    Leaves get level 0; a caller's level is one more than its deepest
    callee. If a round peels nothing while nodes remain, those nodes sit on
    or above a cycle: they are returned with a NULL level (see G6). A round
    subtracts the callees just peeled from each caller's number of unpeeled
    ones: edges are written once, and a round writes a row a node.
    """
    e = materialize(edges.select("src", "dst").distinct(), "edges")
    calls = e.groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("_open"))
    none = F.lit(None).cast("int")
    state = nodes.select("n").distinct().join(calls, "n", "left").select("n", F.coalesce("_open", F.lit(0)).alias("_open"))
    state = materialize(state.withColumn("level", F.when(F.col("_open") == 0, 0).otherwise(none)), "levels")
    for level in count():
        now, left = state.agg(F.count(F.when(F.col("level") == level, 1)), F.count(F.when(F.col("level").isNull(), 1))).first()
        if not now or not left:
            return state.select("n", "level")
        peeled = state.where(F.col("level") == level).select(F.col("n").alias("dst"))
        closed = e.join(peeled, "dst").groupBy(F.col("src").alias("n")).agg(F.count(F.lit(1)).alias("_closed"))
        x = state.join(closed, "n", "left").withColumn("_open", F.col("_open") - F.coalesce("_closed", F.lit(0)))
        fresh = F.col("level").isNull() & (F.col("_open") == 0)
        state = materialize(x.select("n", "_open", F.when(fresh, level + 1).otherwise(F.col("level")).alias("level")), "levels")
    raise RuntimeError("level peeling did not converge")


def callee_first_order(levels: DataFrame) -> DataFrame:
    """G1: leaf-first order as an explicit 0-based position over (level, name)."""
    return with_global_position(levels, [F.col("level").asc_nulls_last(), F.col("n")], "position")
