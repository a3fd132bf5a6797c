"""Multi-party chat formatting by perspective rotation.

Every participant of a conversation gets the dialogue from their own seat: their turns are the assistant's and the ones to learn from, all other
speakers are users with a name, and context roles (system) stay what they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.session import materialize

END = "<|end|>\n"
NAMELESS = "unknown"
#: Code points of a turn that say which range of a crowded span it belongs to; turns that agree in all of these stay in one range.
LEAD = 256


def _placed(said: DataFrame, part_turns: int) -> DataFrame:
    """`said` with `piece`: the row's number within its conversation and span of turn numbers, divided by `part_turns`.

    Spans of no more rows are one piece and aren't sorted here.  The rows of the others are parted by ranges of their order and numbered inside
    each range, from the rows in the ranges before it, so that no span goes through one task.  Equal rows may change places.
    """
    crowded = materialize(said.groupBy("key", "part").count().where(F.col("count") > part_turns).drop("count"), "crowded")
    salt = F.when(F.length("body") <= LEAD, F.monotonically_increasing_id()).otherwise(0)
    rows = said.join(crowded, ["key", "part"], "left_semi").withColumn("salt", salt)
    rows = rows.repartitionByRange("key", "part", "turn", "role", F.substring("body", 1, LEAD), "salt").drop("salt")
    rows = materialize(rows.withColumn("range", F.spark_partition_id()), "ranges")
    earlier = Window.partitionBy("key", "part").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("key", "part", "range").count()
    before = counts.select("key", "part", "range", F.coalesce(F.sum("count").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy("key", "part", "range").orderBy("turn", "role", "body")
    numbered = rows.withColumn("place", F.row_number().over(inside) - 1).join(before, ["key", "part", "range"])
    numbered = numbered.select(*said.columns, F.floor((F.col("place") + F.col("before")) / part_turns).cast("long").alias("piece"))
    return said.join(crowded, ["key", "part"], "left_anti").select(*said.columns, F.lit(0).cast("long").alias("piece")).union(numbered)


def rotate(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           context_roles: tuple[str, ...] = ("system",), part_turns: int = 1024) -> DataFrame:
    """(conv_col, perspective, part, n_turns, start, text, mask): the rendered dialogues.

    A dialogue is one row; one with turn numbers of `part_turns` and more comes in parts, one for each such span.  A span with more rows than `part_turns`
    (turns without a number, repeated numbers, rows without a conversation) comes in several rows of the same `part`, each of at most `part_turns` turns.
    In order of `start` (code points of the dialogue before the row) they make up the whole, so no more than `part_turns` turns are gathered in one place.  `mask` has
    the spans (start, end) in code points of the row's text that the assistant wrote, end marks included.

    Turns are ordered by number, those without one first (part -1), equal numbers by role and text; a repeated row is rendered again.  A null text is empty.  A null role is
    a speaker called "unknown", who takes no seat.  Rows with a null conversation form one conversation.  A conversation of context roles and nameless speakers alone has no seat and
    gives no row; an empty table gives none.  "<|" inside a text or name is written "< |", so that a text cannot imitate a mark.
    """
    clean = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    span = F.coalesce(F.floor(F.col(turn_col).cast("long") / part_turns), F.lit(-1)).cast("long")
    body = F.concat(clean(F.coalesce(F.col(text_col).cast("string"), F.lit(""))), F.lit(END))
    # in a struct a null conversation equals itself, in joins as in groups
    said = turns.select(F.struct(F.col(conv_col).alias("conv")).alias("key"), span.alias("part"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), body.alias("body"))
    seats = said.where(F.col("role").isNotNull() & ~F.col("role").isin(*context_roles)).select("key", F.col("role").alias("perspective")).distinct()
    seen = _placed(said, part_turns).withColumn("size", F.length("body")).join(seats, "key")
    name = clean(F.coalesce("role", F.lit(NAMELESS)))
    own = F.coalesce(F.col("role") == F.col("perspective"), F.lit(False))
    head = F.when(own, F.lit("<|assistant|>\n")).when(F.col("role").isin(*context_roles), F.concat(F.lit("<|"), name, F.lit("|>\n"))).otherwise(F.concat(F.lit("<|user name="), name, F.lit("|>\n")))
    keys = ["key", "perspective", "part", "piece"]
    lines = seen.select(*keys, F.struct("turn", "role", "body", head.alias("head"), own.alias("own")).alias("line"))
    parts = lines.groupBy(*keys).agg(F.array_sort(F.collect_list("line")).alias("lines"))

    def add(state: Column, line: Column) -> Column:
        begin = state["at"] + F.length(line["head"])
        end = begin + F.length(line["body"])
        span = F.struct(begin.alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(line["own"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))
    parts = parts.select(*keys, F.size("lines").cast("long").alias("n_turns"), F.array_join(F.transform("lines", lambda x: F.concat(x["head"], x["body"])), "").alias("text"),
                         F.aggregate("lines", empty, add, lambda s: s["spans"]).alias("mask"))
    # the sums run over lengths alone, one short row for each part
    sizes = seen.groupBy(*keys).agg(F.sum(F.length(head) + F.col("size")).alias("size"))
    before = Window.partitionBy("key", "perspective").orderBy("part", "piece").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("start"))
    return parts.join(starts, keys).select(F.col("key.conv").alias(conv_col), "perspective", "part", "n_turns", "start", "text", "mask")
