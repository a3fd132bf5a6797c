"""Rescans of stored changes with new rules through a bitmap index of three-letter runs.

Changes lie in blocks of bounded size, blocks in folders.  For every run of three letters that occurs in a block's diffs, in lower case, the index has a bit for that block, so a
run's bitmap names the blocks that can hold a text with it.  A rule's pattern yields literals that every match contains; the bitmaps of their runs, combined by AND
and OR, leave the blocks in which the rule can match.  Only these are read, and the exact scan follows on them.

A block not read holds no match.  Rules whose patterns yield no literal of three letters keep all blocks.  Each write adds a generation of blocks and rewrites nothing.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from changelens.operators import rules as R

GRAM = 3
GRAM_FOLDERS = 64
#: Bits of one bitmap, as Spark's bitmap functions have them.
BITS = 8 * 4096

Clause = frozenset[str]


# --------------------------------------------------------------------------- literals of patterns
def _runs(parsed) -> list[Clause]:
    """Clauses of a parsed pattern: of each clause, one literal at least is in every match."""
    clauses: list[Clause] = []
    run: list[str] = []

    def close() -> None:
        if run:
            clauses.append(frozenset(["".join(run)]))
        run.clear()

    for op, value in parsed:
        kind = str(op)
        if kind == "LITERAL":
            run.append(chr(value))
            continue
        if kind == "SUBPATTERN":
            inside = value[-1]
            if all(str(o) == "LITERAL" for o, _ in inside):
                run.extend(chr(v) for _, v in inside)
                continue
            close()
            clauses.extend(_runs(inside))
            continue
        close()
        if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and value[0] > 0:
            clauses.extend(_runs(value[2]))
        elif kind == "ATOMIC_GROUP":
            clauses.extend(_runs(value))
        elif kind == "BRANCH":
            best = [max(_runs(branch), key=_strength, default=None) for branch in value[1]]
            if None not in best:
                clauses.append(frozenset().union(*best))
    close()
    return clauses


def _strength(clause: Clause) -> int:
    return min(map(len, clause))


def literals_of(pattern: str) -> list[Clause]:
    """What every match of the pattern holds, in lower case: of each clause at least one literal.

    Clauses with a literal that is shorter than a run of the index, not ASCII or over a line's end say nothing here and are left out, and a
    pattern that Python's reader does not know yields none.
    """
    try:
        clauses = _runs(re._parser.parse(pattern))
    except (re.error, OverflowError):
        return []
    lowered = [frozenset(text.lower() for text in c) for c in clauses]
    return list(dict.fromkeys(c for c in lowered if all(len(t) >= GRAM and t.isascii() and "\n" not in t for t in c)))


def clauses_of(rule: R.Rule) -> list[Clause]:
    """The clauses of a rule: those of its pattern, and the literals that it names itself."""
    named = frozenset(n.lower() for n in rule.needs)
    usable = named and all(len(t) >= GRAM and t.isascii() and "\n" not in t for t in named)
    return list(dict.fromkeys([*literals_of(rule.pattern), *([named] if usable else [])]))


# --------------------------------------------------------------------------- writing
def write_changes(changes: DataFrame, path: str, key: Sequence[str] = ("pr_id",), per_block: int = 64, folders: int = 256) -> str:
    """Add changes (``key``, ``diff`` and any other columns) as a generation of blocks with their index; returns its name.

    Blocks follow a hash of the key and hold ``per_block`` rows on average; neighbouring blocks share a folder, of which there are at most
    ``folders``.  Null diffs have no runs.  The index is written after the rows and its last file makes the generation visible, so a cut run leaves nothing that
    is read; run it again.  An empty table adds an empty generation.
    """
    spark, generation = changes.sparkSession, uuid.uuid4().hex[:12]
    blocks = max(1, -(-changes.count() // per_block))
    width = -(-blocks // folders)
    block = F.pmod(F.xxhash64(*key), F.lit(blocks)).cast("int")
    placed = changes.withColumn("_block", block).withColumn("_folder", F.floor(F.col("_block") / width).cast("int"))
    rows = f"{path}/rows/_generation={generation}"
    placed.hint("rebalance", "_folder").sortWithinPartitions("_folder", "_block").write.partitionBy("_folder").parquet(rows)
    stored = spark.read.schema(placed.schema).parquet(rows).select("_block", "diff")
    # a look-ahead of three letters matches at every place, in time linear in the text
    found = F.regexp_extract_all(F.lower("diff"), F.lit("(?s)(?=(.{%d}))" % GRAM), F.lit(1))
    grams = stored.select("_block", F.explode(F.array_distinct(found)).alias("gram")).distinct()
    bitmaps = grams.groupBy("gram", F.bitmap_bucket_number("_block").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("_block")).alias("bits"))
    bitmaps.withColumn("folder", _gram_folder(F.col("gram"))).hint("rebalance", "folder").sortWithinPartitions("folder", "gram").write.partitionBy("folder").parquet(
        f"{path}/grams/_generation={generation}")
    spark.createDataFrame([(generation, blocks, width)], "generation string, blocks int, width int").coalesce(1).write.mode("append").parquet(f"{path}/generations")
    return generation


def _gram_folder(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(GRAM_FOLDERS)).cast("int")


# --------------------------------------------------------------------------- reading
def candidate_blocks(spark: SparkSession, path: str, rules: Iterable[R.Rule]) -> DataFrame:
    """(generation, _folder, _block) of the blocks in which one of the rules can match.

    Only bitmaps of the rules' runs are read; all that is combined is a row of 4096 bytes for each run and 32768 blocks.
    """
    wanted = [clauses_of(r) for r in rules]
    generations = spark.read.schema("generation string, blocks int, width int").parquet(f"{path}/generations")
    if not wanted or any(not c for c in wanted):
        every = generations.where(F.lit(bool(wanted)))
        return _placed(every.select("generation", "width", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("_block")))
    literals = sorted({text for clauses in wanted for clause in clauses for text in clause})
    runs_of = {text: sorted({text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}) for text in literals}
    runs = sorted({g for found in runs_of.values() for g in found})
    needed = spark.createDataFrame([(text, g, len(found)) for text, found in runs_of.items() for g in found], "literal string, gram string, runs int")
    uses = spark.createDataFrame([(no, k, len(clauses), text) for no, clauses in enumerate(wanted) for k, clause in enumerate(clauses) for text in clause],
                                 "rule int, clause int, clauses int, literal string")
    folders = sorted(r[0] for r in spark.createDataFrame([(g,) for g in runs], "gram string").select(_gram_folder(F.col("gram"))).distinct().collect())
    bitmaps = spark.read.schema("gram string, part bigint, bits binary, _generation string, folder int").parquet(f"{path}/grams")
    bitmaps = bitmaps.where(F.col("folder").isin(folders) & F.col("gram").isin(runs)).withColumnRenamed("_generation", "generation")
    place = ["generation", "part"]
    # a run without a bitmap is in no block, so all runs of a literal and all clauses of a rule are to be met
    texts = bitmaps.join(needed, "gram").groupBy(*place, "literal", "runs").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where("n = runs")
    clauses = texts.join(uses, "literal").groupBy(*place, "rule", "clause", "clauses").agg(F.bitmap_or_agg("bits").alias("bits"))
    met = clauses.groupBy(*place, "rule", "clauses").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n")).where("n = clauses")
    united = met.groupBy(*place).agg(F.bitmap_or_agg("bits").alias("bits")).join(generations, "generation")
    octets = united.select("generation", "width", "part", F.posexplode(F.transform(
        F.sequence(F.lit(1), F.octet_length("bits")), lambda i: F.conv(F.hex(F.substring(F.col("bits"), i, 1)), 16, 10).cast("int"))).alias("octet", "value")).where("value > 0")
    bits = octets.select("generation", "width", "part", "octet", F.explode(F.filter(F.sequence(F.lit(0), F.lit(7)), lambda b: F.expr("value").bitwiseAND(F.shiftleft(F.lit(1), b)) != 0)).alias("bit"))
    # part numbers of Spark's bitmaps begin at 1
    return _placed(bits.select("generation", "width", ((F.col("part") - 1) * BITS + F.col("octet") * 8 + F.col("bit")).cast("int").alias("_block")))


def _placed(blocks: DataFrame) -> DataFrame:
    return blocks.select("generation", F.floor(F.col("_block") / F.col("width")).cast("int").alias("_folder"), "_block")


def candidate_changes(spark: SparkSession, path: str, rules: Iterable[R.Rule], report: dict | None = None) -> DataFrame:
    """The stored changes in whose blocks one of the rules can match: scan these, and the result is that of a scan of all.

    Folders without such a block are not opened; in the others row groups are skipped by the order of blocks.  The names of folders, at most ``folders`` for
    each generation, come to the driver.  ``report`` takes the numbers of blocks and folders, in all and to be read.
    """
    blocks = candidate_blocks(spark, path, rules)
    places = sorted((r.generation, r["_folder"]) for r in blocks.select("generation", "_folder").distinct().collect())
    known = spark.read.schema("generation string, blocks int, width int").parquet(f"{path}/generations").agg(
        F.sum("blocks").alias("blocks"), F.sum(F.ceil(F.col("blocks") / F.col("width"))).alias("folders")).first()
    if report is not None:
        report.update(blocks=known["blocks"], folders=known["folders"], folders_read=len(places), blocks_read=blocks.count())
    rows = spark.read.parquet(f"{path}/rows").withColumn("generation", F.col("_generation").cast("string"))
    by_generation: dict[str, list[int]] = {}
    for generation, folder in places:
        by_generation.setdefault(generation, []).append(folder)
    chosen = F.lit(False)
    for generation, found in by_generation.items():
        chosen = chosen | ((F.col("_generation") == generation) & F.col("_folder").isin(found))
    return rows.where(chosen).join(blocks, ["generation", "_folder", "_block"], "left_semi").drop("generation", "_generation", "_folder", "_block")
