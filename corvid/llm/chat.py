"""Chat formatting: a role automaton, text segments and a reversible template.

The template is declarative: the strings that open, head and close a turn, the
roles under the loss, and the turns that may follow each other. Control
strings inside a text get a backslash after their first character (one more
if there are some), which no template string has, so reading back is exact.

Defined results: a null text or role is empty; a null conversation id is one
conversation; turns with equal or null numbers come in the order of role and
text, null numbers first; repeated rows are turns of their own; a conversation
with a bad turn order is formatted all the same and marked; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START = "<start>"


@dataclass(frozen=True)
class ChatTemplate:
    opening: str = "<s>[INST] "
    head_end: str = "\n"
    closing: str = "[/INST]</s>"
    loss_roles: Sequence[str] = ("assistant",)
    #: Control strings are one of the first characters and one of the rests.
    control_first: str = "<["
    control_rest: Sequence[str] = ("INST]", "/INST]", "s>", "/s>")
    #: The automaton: which roles may follow a state; the state is the last role.
    follows: Mapping[str, Sequence[str]] = field(default_factory=lambda: {
        START: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)})

    def _pattern(self, slashes: str) -> str:
        first = "".join(re.escape(c) for c in self.control_first)
        return f"([{first}]){slashes}({'|'.join(re.escape(r) for r in self.control_rest)})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"(\\*)"), r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self._pattern(r"\\(\\*)"), r"$1$2$3")

    def turn_pattern(self) -> str:
        q = re.escape
        return f"(?s){q(self.opening)}([^\\n]*){q(self.head_end)}(.*?){q(self.closing)}"

    def turns_of(self, formatted: Column) -> Column:
        """(role, text) of each turn of a formatted conversation."""
        p = F.lit(self.turn_pattern())
        both = F.arrays_zip(F.regexp_extract_all(formatted, p, F.lit(1)).alias("r"),
                            F.regexp_extract_all(formatted, p, F.lit(2)).alias("t"))
        return F.transform(both, lambda x: F.struct(
            F.url_decode(x["r"]).alias("role"), self.unescape(x["t"]).alias("text")))


def segments(turns: DataFrame, template: ChatTemplate = ChatTemplate(), role: str = "role", text: str = "text") -> DataFrame:
    """Three rows a turn: head, body and close, with ``segment`` (0 to 2),
    ``segment_text``, ``loss`` and ``segment_row``, a number of the turn's row
    in this frame that tells equal rows apart (unite turns, not segments). Rows
    stay where they are; the head's role is percent-encoded, so it has no line
    end or control string."""
    r, t = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    under_loss = r.isin(*template.loss_roles)

    def seg(n: int, value: Column, loss: Column) -> Column:
        return F.struct(F.lit(n).alias("segment"), value.alias("segment_text"), loss.alias("loss"))

    three = F.array(seg(0, F.concat(F.lit(template.opening), F.url_encode(r), F.lit(template.head_end)), F.lit(False)),
                    seg(1, template.escape(t), under_loss), seg(2, F.lit(template.closing), F.lit(False)))
    own = [c for c in turns.columns if c not in ("segment", "segment_text", "loss", "segment_row")]
    rows = turns.select(*[turns[c] for c in own], F.monotonically_increasing_id().alias("segment_row"), three.alias("segment_text"))
    return rows.select(*own, "segment_row", F.inline("segment_text"))


def turn_order(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id", turn: str = "turn",
               role: str = "role", block_turns: int = 256) -> DataFrame:
    """(_conv, n_turns, n_bad_turns) by running the automaton.

    A state is the last role, so a turn is checked against the one before it.
    Long conversations are cut into blocks of turn numbers; a block's first
    turn is checked against the last role of the block before.
    """
    x = turns.select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.coalesce(role, F.lit("")).alias("_role"),
                     F.coalesce(F.floor(F.col(turn) / block_turns), F.lit(-1 << 62)).alias("_block"))
    order = [F.col("_turn").asc_nulls_first(), F.col("_role")]
    x = x.withColumn("_prev", F.lag("_role").over(Window.partitionBy("_conv", "_block").orderBy(*order)))
    table = F.create_map(*[v for k, roles in template.follows.items()
                           for v in (F.lit(k), F.array(*[F.lit(r) for r in roles]))])

    def bad(prev: Column, now: Column) -> Column:
        return ~F.coalesce(F.array_contains(F.try_element_at(table, prev), now), F.lit(False))

    blocks = x.groupBy("_conv", "_block").agg(
        F.count(F.lit(1)).alias("_n"), F.sum((F.col("_prev").isNotNull() & bad(F.col("_prev"), F.col("_role"))).cast("long")).alias("_bad"),
        F.min(F.struct("_turn", "_role"))["_role"].alias("_first"), F.max(F.struct("_turn", "_role"))["_role"].alias("_last"))
    before = F.lag("_last", 1, START).over(Window.partitionBy("_conv").orderBy("_block"))
    return (blocks.withColumn("_before", before).groupBy("_conv")
            .agg(F.sum("_n").alias("n_turns"),
                 F.sum(F.col("_bad") + bad(F.col("_before"), F.col("_first")).cast("long")).alias("n_bad_turns")))


def conversations_from(segs: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                       text: str = "text") -> DataFrame:
    """One row a conversation: ``formatted`` and ``loss_spans`` (its segments
    under the loss, still escaped), put together in turn order."""
    r, t = F.coalesce(role, F.lit("")), F.xxhash64(text)
    item = F.struct(F.col(turn).alias("turn"), r.alias("role"), t.alias("text"), "segment_row", "segment", "segment_text", "loss")
    grouped = segs.groupBy(F.col(conv)).agg(F.sort_array(F.collect_list(item)).alias("_s"))
    return grouped.select(
        conv, F.array_join(F.transform("_s", lambda s: s["segment_text"]), "").alias("formatted"),
        F.transform(F.filter("_s", lambda s: s["loss"]), lambda s: s["segment_text"]).alias("loss_spans"))
