"""Sharding by a k-d tree over metadata, with near-equal bytes.

A node with more than one leaf's bytes is split along its widest dimension at
the weighted quantile that gives each side the bytes of its leaves (the median
where they divide evenly). Quantiles are found by counting bytes in ever finer
intervals of the dimension, all nodes of a level at once: a round shuffles a
row per node and interval, and the driver sees a row per node.

Languages and sources are ranked among their different values, whole strings in
the order of their bytes. Dimensions are scaled to 31 bits over the table; a
hash of the id breaks ties, so a value that many rows share can be cut anywhere.

Defined results: a null text has no bytes (size 8); a null dimension is the
least value; rows with equal ids go to one shard; a very long text counts
whole, and one with more bytes than a shard's share fills its shard alone or
nearly so while others get less; an empty table gives an empty result. Equal
texts are not kept together: the law is on bytes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.llm.common import keep, seeded_hash, small_join
from corvid.plans.ordering import with_global_position

BITS = 31
#: Intervals per node and round.
INTERVALS = 1024


#: Nodes that are named in a plan; more of them are a table.
PLAN_NODES = 256
#: Rows of one shard that are numbered together, about.
BLOCK_ROWS = 50_000


def value_ranks(docs: DataFrame, column: str) -> DataFrame:
    """(_value, _rank): the different values of a text column by their bytes."""
    values = docs.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("_value")).agg(F.count(F.lit(1)).alias("_n"))
    return keep(with_global_position(values, ["_value"], "_rank").select("_value", "_rank"))


def log_size(column: str) -> Column:
    return F.log2(F.coalesce(F.length(column), F.lit(0)) + F.lit(1.0))


def scaled(rows: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Each dimension as an integer of 31 bits over its range in the table; null is 0."""
    ends = rows.agg(*[f(d).alias(f"{f.__name__}{i}") for i, d in enumerate(dims) for f in (F.min, F.max)]).first()
    top = (1 << BITS) - 2
    out = {}
    for i, d in enumerate(dims):
        lo, hi = ends[f"min{i}"], ends[f"max{i}"]
        span = (hi - lo) if lo is not None and hi > lo else 1.0
        out[d] = F.coalesce(F.floor((F.col(d) - F.lit(lo or 0.0)) / F.lit(span) * top) + 1, F.lit(0)).cast("bigint")
    return rows.withColumns(out)


def _frame(like: DataFrame, rows: list[dict]) -> DataFrame:
    """A small frame, one row a node: literals, or a table of many."""
    if len(rows) > PLAN_NODES:
        names = list(rows[0])
        return like.sparkSession.createDataFrame([tuple(r[n] for n in names) for r in rows], ", ".join(f"{n} bigint" for n in names))
    items = F.array(*[F.struct(*[F.lit(v).cast("bigint").alias(k) for k, v in r.items()]) for r in rows])
    return like.sparkSession.range(1).select(F.inline(items))


def _split(rows: DataFrame, dims: Sequence[str], nodes: dict[int, tuple[int, int]]) -> list[dict]:
    """The cuts of the nodes (id -> (first shard, leaves)): dimension and key."""
    own = small_join(rows, _frame(rows, [{"_node": n} for n in nodes]), "_node", len(nodes))
    stats = own.groupBy("_node").agg(F.sum("_size").alias("bytes"), *[f(d).alias(f"{f.__name__}{i}")
                                     for i, d in enumerate(dims) for f in (F.min, F.max)]).collect()
    state = {}
    for r in stats:
        widths = [r[f"max{i}"] - r[f"min{i}"] for i in range(len(dims))]
        dim = max(range(len(dims)), key=lambda i: (widths[i], -i))
        leaves = nodes[r["_node"]][1]
        state[r["_node"]] = {"_node": r["_node"], "_dim": dim, "_lo": r[f"min{dim}"] << BITS,
                             "_hi": (r[f"max{dim}"] + 1) << BITS, "_below": 0,
                             "_goal": r["bytes"] * (leaves // 2) // leaves}
    cuts = []
    while state:
        at = small_join(rows, _frame(rows, list(state.values())), "_node", len(state))
        value = F.get(F.array(*dims), F.col("_dim").cast("int"))
        at = at.withColumn("_key", F.shiftleft(value, BITS) + F.col("_tie"))
        at = at.filter((F.col("_key") >= F.col("_lo")) & (F.col("_key") < F.col("_hi")))
        step = F.floor((F.col("_hi") - F.col("_lo") + INTERVALS - 1) / F.lit(INTERVALS)).cast("bigint")
        at = at.withColumn("_step", step).withColumn("_b", F.expr("(_key - _lo) div _step"))
        sums = at.groupBy("_node", "_b").agg(
            F.sum("_size").alias("_n"), F.min("_key").alias("_first"), F.max("_key").alias("_last"),
            F.first("_step").alias("_step"), F.first("_below").alias("_below"), F.first("_goal").alias("_goal"),
            F.first("_lo").alias("_lo"))
        run = Window.partitionBy("_node").orderBy("_b")
        sums = sums.withColumn("_cum", F.col("_below") + F.sum("_n").over(run)).filter(F.col("_cum") >= F.col("_goal"))
        nearest = F.row_number().over(Window.partitionBy("_node").orderBy("_b"))
        for r in sums.withColumn("_rn", nearest).filter("_rn = 1").collect():
            node, before = state[r["_node"]], r["_cum"] - r["_n"]
            if r["_first"] == r["_last"]:
                # one key is left: it goes where the bytes come nearer to the goal
                left = before + r["_n"] / 2 <= r["_goal"]
                cuts.append({"_node": r["_node"], "_dim": node["_dim"], "_cut": r["_first"] + (1 if left else 0)})
                del state[r["_node"]]
            else:
                node.update(_lo=r["_first"], _hi=r["_last"] + 1, _below=before)
    return cuts


def kd_shards(rows: DataFrame, dims: Sequence[str], shards: int | None = None,
              target_bytes: int | None = None) -> DataFrame:
    """Add ``shard`` and ``slot`` (gapless from 0 in each shard) to rows that
    carry ``_size``, ``_tie`` (31 bits) and the dimensions as numbers.

    Give the number of shards, or the bytes that a leaf is to reach.
    """
    rows = keep(scaled(rows, dims).withColumn("_node", F.lit(1).cast("bigint")))
    if shards is None:
        total = rows.agg(F.sum("_size")).first()[0] or 0
        shards = max(1, round(total / target_bytes))
    nodes, leaves = {1: (0, shards)}, {}
    while nodes:
        leaves.update({n: first for n, (first, k) in nodes.items() if k == 1})
        open_nodes = {n: v for n, v in nodes.items() if v[1] > 1}
        cuts = _split(rows, dims, open_nodes) if open_nodes else []
        nodes = {}
        for c in cuts:
            first, k = open_nodes[c["_node"]]
            nodes[2 * c["_node"]] = (first, k // 2)
            nodes[2 * c["_node"] + 1] = (first + k // 2, k - k // 2)
        if cuts:
            moved = small_join(rows, _frame(rows, cuts), "_node", len(cuts), "left")
            key = F.shiftleft(F.get(F.array(*dims), F.col("_dim").cast("int")), BITS) + F.col("_tie")
            child = 2 * F.col("_node") + (key >= F.col("_cut")).cast("bigint")
            rows = keep(moved.withColumn("_node", F.coalesce(child, F.col("_node"))).drop("_dim", "_cut"))
    shard_of = _frame(rows, [{"_node": n, "shard": s} for n, s in leaves.items()] or [{"_node": 1, "shard": 0}])
    placed = small_join(rows, shard_of, "_node", max(1, len(leaves))).withColumn("shard", F.col("shard").cast("int"))
    return with_slots(placed, max(64, -(-rows.count() // (shards * BLOCK_ROWS))))


def with_slots(placed: DataFrame, blocks: int = 64) -> DataFrame:
    """``slot``: a gapless position in the shard. Rows are numbered within
    blocks of the tie hash, as many as the rows ask for; block counts give each
    block's first slot."""
    x = placed.withColumn("_block", F.expr(f"(_tie * {blocks}L) >> {BITS}").cast("int"))
    counts = x.groupBy("shard", "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("shard").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    first = keep(counts.select("shard", "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first")))
    carried = [c for c in placed.columns if not c.startswith("_") and c != "shard"]
    inside = Window.partitionBy("shard", "_block").orderBy("_tie", "_size", *carried)
    x = small_join(x, first, ["shard", "_block"], first.count())
    return x.withColumn("slot", F.col("_first") + F.row_number().over(inside) - 1).drop("_block", "_first")


def shard_rows(docs: DataFrame, text: str = "text", key: str = "doc_id", lang: str = "lang", source: str = "source",
               carry: Sequence[str] = ()) -> DataFrame:
    """The narrow rows that a corpus is sharded by: size and tie, and four
    metadata dimensions (language, source, log of the length, id)."""
    x = docs.select(F.col(key), *carry, *{text, lang, source} - {key, *carry})
    for column, name in ((lang, "_d_lang"), (source, "_d_source")):
        ranks = value_ranks(docs, column)
        x = small_join(x, ranks, F.col(column) == F.col("_value"), ranks.count(), "left").withColumn(
            name, F.col("_rank").cast("double")).drop("_value", "_rank")
    return x.select(
        F.col(key), *carry, (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint").alias("_size"),
        F.shiftright(seeded_hash(11, F.col(key)), 60 - BITS).alias("_tie"),
        "_d_lang", "_d_source", log_size(text).alias("_d_length"),
        F.col(key).cast("double").alias("_d_id"))


DIMS = ("_d_lang", "_d_source", "_d_length", "_d_id")
