"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree, in DataFrame functions alone.

Every source's share is counted in blocks: runs of up to `block` words of a document.  A source's documents are put in a permuted order (by a keyed
hash), its blocks numbered through; it gives the blocks up to its target, a second time through for what exceeds its size.  How many blocks of each source an output
shard gets is drawn exactly as if all blocks given were shuffled and cut into shards of equal size: a node of the tree holds a quota for each
source, and its left half draws, source by source, from hypergeometric distributions, so quotas always add up.  A shard's quota of a source
is a range of the source's permuted blocks; ranges are disjoint.  In the shard, documents' parts are shuffled by another keyed hash.

All draws are functions of the seed, the node and the source, so that reruns, and tasks run again, agree.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.session import materialize

WEIGHTS = (3.0, 1.0, 2.0)
WORD = r"[^\x20\x09-\x0D]+"


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, source_size, target) of one row a source with its size: `share` of all sizes by weight, none above `most` times its size.

    Weights go round over the sources in order of code points, null last.  What a source can't take goes to the others by weight, until
    none is above: the targets are min(cap, level x weight), and the level follows from sorting the sources by cap / weight.  The table has a row
    for each source, not for each document, so one window over it is in order.
    """
    # Spark orders strings by their UTF-8 bytes, which is the order of code points
    w = F.element_at(F.array(*[F.lit(x) for x in weights]), F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, len(weights)).cast("int") + 1)
    rows = sizes.withColumn("weight", w).withColumn("cap", most * F.col("source_size"))
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    order = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    # the level if this source and all after it in this order stay below their caps; it holds for the first source that does
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    rows = rows.withColumn("level", level).withColumn("place", F.row_number().over(order))
    rows = rows.withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("place", "level"))).over(everything))
    below = F.col("place") >= F.col("free.place")
    return rows.select("source", "source_size", F.when(below, F.col("free.level") * F.col("weight")).otherwise(F.col("cap")).alias("target"))


def _let(value: Column, body) -> Column:
    """`body` of the value, which is computed once: an expression written twice would be planned and computed twice."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _ln_factorial(n: Column) -> Column:
    """Stirling's series, exact to 1e-12 from 12 on; below, the logarithm of the factorial itself."""
    series = lambda x: (x - 0.5) * F.log(x) - x + 0.5 * math.log(2 * math.pi) + 1 / (12 * x) - 1 / (360 * x * x * x) + 1 / (1260 * F.pow(x, 5))
    return F.when(n < 12, F.log(F.factorial(n.cast("int")).cast("double"))).otherwise(_let(n + F.lit(1.0), series))


def hypergeometric(total: Column, marked: Column, drawn: Column, u: Column) -> Column:
    """How many of `drawn` out of `total` are among the `marked`, for a uniform u: the distribution summed outward from its mode until it passes u."""
    given = F.struct(*[c.cast("double").alias(n) for n, c in (("total", total), ("marked", marked), ("drawn", drawn), ("u", u))])

    def bounded(g: Column) -> Column:
        low, high = F.greatest(F.lit(0.0), g["drawn"] + g["marked"] - g["total"]), F.least(g["drawn"], g["marked"])
        return F.struct(g.alias("g"), low.alias("low"), high.alias("high"))

    def peaked(b: Column) -> Column:
        g = b["g"]
        mode = F.least(b["high"], F.greatest(b["low"], F.floor((g["drawn"] + 1) * (g["marked"] + 1) / (g["total"] + 2)).cast("double")))
        share = g["marked"] / F.greatest(g["total"], F.lit(1.0))
        # beyond 12 standard deviations to each side less than 1e-30 is left
        steps = F.least(b["high"] - b["low"], F.ceil(12 * F.sqrt(g["drawn"] * share * (1 - share)) + 30).cast("double")).cast("int")
        return F.struct(b.alias("b"), mode.alias("mode"), steps.alias("steps"))

    def weighed(m: Column) -> Column:
        g, k = m["b"]["g"], m["mode"]
        logs = [g["marked"], k, g["marked"] - k, g["total"] - g["marked"], g["drawn"] - k, g["total"] - g["marked"] - g["drawn"] + k, g["total"], g["drawn"], g["total"] - g["drawn"]]
        signs = [1.0, -1.0, -1.0, 1.0, -1.0, -1.0, -1.0, 1.0, 1.0]
        terms = F.zip_with(F.transform(F.array(*logs), _ln_factorial), F.array(*map(F.lit, signs)), lambda x, y: x * y)
        return F.struct(m.alias("m"), F.exp(F.aggregate(terms, F.lit(0.0), lambda x, y: x + y)).alias("peak"))

    def walked(w: Column) -> Column:
        m, peak = w["m"], w["peak"]
        low, high, mode = m["b"]["low"], m["b"]["high"], m["mode"]
        total, marked, drawn = (m["b"]["g"][n] for n in ("total", "marked", "drawn"))
        nothing = F.lit(None).cast("double")
        start = F.struct((m["b"]["g"]["u"] - peak).alias("left"), mode.alias("down"), peak.alias("p_down"), mode.alias("up"), peak.alias("p_up"), F.when(m["b"]["g"]["u"] <= peak, mode).otherwise(nothing).alias("found"))

        def step(s: Column, _: Column) -> Column:
            down, up = s["down"], s["up"]
            lower = F.when(down > low, s["p_down"] * down * (total - marked - drawn + down) / ((marked - down + 1) * (drawn - down + 1))).otherwise(0.0)
            upper = F.when(up < high, s["p_up"] * (marked - up) * (drawn - up) / ((up + 1) * (total - marked - drawn + up + 1))).otherwise(0.0)
            return _let(F.struct(lower.alias("lower"), upper.alias("upper")), lambda p: F.struct(
                (s["left"] - p["lower"] - p["upper"]).alias("left"), F.greatest(low, down - 1).alias("down"), p["lower"].alias("p_down"), F.least(high, up + 1).alias("up"), p["upper"].alias("p_up"),
                F.coalesce(s["found"], F.when((s["left"] <= p["lower"]) & (p["lower"] > 0), down - 1), F.when((s["left"] <= p["lower"] + p["upper"]) & (p["upper"] > 0), up + 1)).alias("found")))

        steps = F.when(m["steps"] > 0, F.sequence(F.lit(1), F.greatest(F.lit(1), m["steps"]))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(steps, start, step, lambda s: F.coalesce(s["found"], mode)).cast("long")

    return _let(_let(_let(_let(given, bounded), peaked), weighed), walked)


def split_tree(quotas: DataFrame, shards: int, seed: int) -> DataFrame:
    """(shard, source, first long, blocks long): the part of every source's blocks that each shard gets, from (source, blocks).

    One row is a node with an array over the sources; each level explodes a node into its two halves.  Nothing is shuffled on the way down.
    """
    root = quotas.select(F.struct("source", F.lit(0).cast("long").alias("first"), "blocks").alias("q")).agg(F.sort_array(F.collect_list("q")).alias("qs"))
    nodes = root.select(F.lit(0).alias("shard"), F.lit(shards).alias("leaves"), "qs")
    for level in range(math.ceil(math.log2(shards)) if shards > 1 else 0):
        total = F.aggregate("qs", F.lit(0).cast("long"), lambda a, q: a + q["blocks"])
        nodes = nodes.withColumn("total", total).withColumn("left_leaves", F.floor(F.col("leaves") / 2).cast("int"))
        nodes = nodes.withColumn("drawn", F.floor(F.col("total") * F.col("left_leaves") / F.col("leaves")).cast("long"))
        state = F.struct(F.col("total").alias("rest"), F.col("drawn").alias("draw"), F.array().cast("array<long>").alias("got"))

        def draw(s: Column, q: Column, level: int = level) -> Column:
            u = (F.xxhash64(F.lit(seed), F.lit(level), F.col("shard"), q["source"]).bitwiseAND(F.lit((1 << 53) - 1)).cast("double") + 0.5) / float(1 << 53)
            return _let(hypergeometric(s["rest"], q["blocks"], s["draw"], u), lambda k: F.struct(
                (s["rest"] - q["blocks"]).alias("rest"), (s["draw"] - k).alias("draw"), F.array_append(s["got"], k).alias("got")))

        nodes = nodes.withColumn("got", F.aggregate("qs", state, lambda s, q: draw(s, q), lambda s: s["got"]))
        left = F.struct(F.col("shard"), F.col("left_leaves").alias("leaves"), F.transform("qs", lambda q, i: q.withField("blocks", F.element_at("got", i + 1))).alias("qs"))
        right = F.struct((F.col("shard") + F.col("left_leaves")).alias("shard"), (F.col("leaves") - F.col("left_leaves")).alias("leaves"), F.transform("qs", lambda q, i: F.struct(
            q["source"].alias("source"), (q["first"] + F.element_at("got", i + 1)).alias("first"), (q["blocks"] - F.element_at("got", i + 1)).alias("blocks"))).alias("qs"))
        halves = F.when(F.col("left_leaves") > 0, F.array(left, right)).otherwise(F.array(right))
        nodes = nodes.select(F.explode(halves).alias("n")).select("n.shard", "n.leaves", "n.qs")
    return nodes.select("shard", F.explode("qs").alias("q")).select("shard", "q.source", "q.first", "q.blocks")


def word_count(text: Column) -> Column:
    """Words between ASCII white space: each becomes one letter, then the white space goes."""
    letters = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(letters, " \t\n\x0b\x0c\r", "")).cast("long")


def numbered(docs: DataFrame, id_col: str, text_col: str, source_col: str, block: int, seed: int, payload: bool) -> tuple[DataFrame, DataFrame]:
    """Rows with their place in the permuted order of their source, and the sources with their sizes, targets and blocks given.

    Prefix sums are taken in two steps, over 4096 ranges of the hash for each source and inside each range, so a source with a third of all
    rows is worked on by as many tasks as any other rows.  With `payload`, all columns of the documents come along.
    """
    size = word_count(F.col(text_col).cast("string"))
    turn = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    marked = docs.select(F.struct(*docs.columns).alias("row") if payload else F.struct(F.col(id_col)).alias("row"), F.col(source_col).cast("string").alias("source"), size.alias("size"), turn.alias("turn"))
    marked = marked.select("row", "size", "turn", F.ceil(F.col("size") / block).cast("long").alias("blocks"), "source",
                           F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), F.shiftrightunsigned("turn", 52).alias("range"))
    if not payload:
        marked = materialize(marked, "mixing")
    ranges = materialize(marked.groupBy("skey", "range").agg(F.first("source").alias("source"), F.sum("size").alias("words"), F.sum("blocks").alias("blocks")), "ranges")
    sources = targets(ranges.groupBy("skey").agg(F.first("source").alias("source"), F.sum("words").alias("source_size")).drop("skey"))
    sources = sources.select("source", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("skey"), "source_size", "target")
    sources = materialize(sources, "sources")
    earlier = Window.partitionBy("skey").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    offsets = ranges.select("skey", "range", F.coalesce(F.sum("words").over(earlier), zero).alias("words0"), F.coalesce(F.sum("blocks").over(earlier), zero).alias("blocks0"))
    inside = Window.partitionBy("skey", "range").orderBy("turn", F.hash("row")).rowsBetween(Window.unboundedPreceding, -1)
    rows = marked.withColumn("w", F.coalesce(F.sum("size").over(inside), zero)).withColumn("b", F.coalesce(F.sum("blocks").over(inside), zero))
    rows = rows.join(offsets, ["skey", "range"]).withColumn("start", F.col("w") + F.col("words0")).withColumn("first", F.col("b") + F.col("blocks0"))
    totals = ranges.groupBy("skey").agg(F.sum("blocks").alias("source_blocks"))
    sources = sources.join(totals, "skey")
    rows = rows.join(sources.select("skey", "source_size", "target", "source_blocks"), "skey")
    return rows.select("row", "source", "skey", "size", "blocks", "turn", "start", "first", "source_size", "target", "source_blocks"), sources


def instances(rows: DataFrame, block: int) -> DataFrame:
    """A row for each time that words of a document are taken: `words`, and its blocks as a range of the source's given blocks."""
    once = [F.struct(F.lit(turn).alias("pass"), F.least("size", F.greatest(F.lit(0).cast("long"), F.ceil(F.col("target") - turn * F.col("source_size") - F.col("start")).cast("long"))).alias("words"),
                     (F.col("first") + turn * F.col("source_blocks")).alias("from")) for turn in (0, 1)]
    taken = rows.withColumn("t", F.explode(F.array(*once))).where("t.words > 0")
    return taken.select("*", "t.pass", "t.words", "t.from", (F.col("t.from") + F.ceil(F.col("t.words") / block)).cast("long").alias("to")).drop("t")


def dealt(rows: DataFrame, block: int, shard_words: int, seed: int) -> DataFrame:
    """The instances' parts in output shards: instances' columns, `shard`, and the blocks `part_from` to `part_to` that the shard has of it."""
    given = materialize(instances(rows.drop("row"), block).groupBy("skey").agg(F.sum("words").alias("words"), F.sum(F.col("to") - F.col("from")).alias("blocks")), "quotas")
    total = given.agg(F.sum("words")).first()[0] or 0
    shards = max(1, -(-total // shard_words))
    tree = split_tree(given.select(F.col("skey").alias("source"), "blocks"), shards, seed).where("blocks > 0").withColumnRenamed("source", "skey")
    # ranges and instances meet in cells of a source's mean quota: each range lies in two or three
    cells = given.select("skey", F.greatest(F.lit(1).cast("long"), F.ceil(F.col("blocks") / shards)).alias("cell"))
    cell = lambda a, b: F.explode(F.sequence(F.floor(a / F.col("cell")), F.floor((b - 1) / F.col("cell"))))
    tree = tree.join(cells, "skey").withColumn("last", F.col("first") + F.col("blocks"))
    tree = tree.select("skey", "shard", F.col("first").alias("low"), F.col("last").alias("high"), cell(F.col("first"), F.col("last")).alias("at"))
    tree = materialize(tree, "shards")
    taken = instances(rows, block).join(cells, "skey")
    taken = taken.withColumn("at", cell(F.col("from"), F.col("to")))
    parts = taken.join(tree, ["skey", "at"]).where("low < `to` and `from` < high").withColumn("part_from", F.greatest("from", "low")).withColumn("part_to", F.least("to", "high"))
    # a part that reaches over several cells is met in each; it counts where it begins
    return parts.where(F.floor(F.col("part_from") / F.col("cell")) == F.col("at")).drop("low", "high", "at", "cell")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_words: int = 1 << 24, seed: int = 17) -> DataFrame:
    """(id_col, size, source_size, target, taken) for every row: the words the output shards hold of it, repeats counted.

    A source's taken words are its target, rounded up.  Null and empty texts have no words and give none; a null source is a source of its own; rows
    that repeat share nothing but their hash and are each counted.  An empty table gives no rows; other columns are not read.
    """
    rows, _ = numbered(docs, id_col, text_col, source_col, block, seed, payload=False)
    rows = materialize(rows, "numbered")
    parts = dealt(rows, block, shard_words, seed)
    # words of a part: whole blocks, but the last block of an instance may be short
    words = F.least(F.col("words"), (F.col("part_to") - F.col("from")) * block) - (F.col("part_from") - F.col("from")) * block
    held = parts.withColumn("held", words).groupBy("skey", "first").agg(F.sum("held").alias("taken"))
    # a document with words has blocks, so its first block in its source tells it from all others
    key = F.when(F.col("size") > 0, F.col("first"))
    out = rows.withColumn("first", key).join(held, ["skey", "first"], "left")
    return out.select(F.col(f"row.{id_col}").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", block: int = 64, shard_words: int = 1 << 24, seed: int = 17) -> DataFrame:
    """The mix as documents: each as often as it is taken, in the shard of its first block, in a shuffled order inside the shard.

    Columns are those of `docs`.  Texts stay whole but for the one document of each source at which its target is reached: of that, the words
    that are taken stay, with the white space between them.
    """
    rows, _ = numbered(docs, id_col, text_col, source_col, block, seed, payload=True)
    slim = materialize(rows.drop("row"), "numbered")
    first = dealt(slim.withColumn("row", F.lit(0)), block, shard_words, seed).where("part_from = `from`").select("skey", "first", "pass", "shard", "words")
    out = rows.where("size > 0").join(first, ["skey", "first"])
    text = F.col(f"row.{text_col}")
    runs = F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(runs, F.lit(1), F.col("words").cast("int")), "")).otherwise(text)
    out = out.withColumn("row", F.col("row").withField(text_col, cut)).withColumn("_order", F.xxhash64(F.lit(seed), "turn", "pass"))
    return out.repartition("shard").sortWithinPartitions("shard", "_order").select("row.*")
