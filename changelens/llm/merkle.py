"""Document fingerprints: a Merkle tree over sections, paragraphs and sentences, in DataFrame functions alone.

Sections are parted by blank lines, paragraphs by line ends, and a paragraph's sentences by white space after a full stop, question or exclamation mark.  A leaf is
the SHA-256 of a sentence, each node above the SHA-256 of its children's digests in order; the root is the fingerprint.

There are two trees.  In that of `units` each sentence, paragraph and section keeps the separator behind it, so that the leaves tile the whole text: equal
roots (`text_fingerprint`) mean equal texts, and the nodes at which two such trees differ (`nodes`, `differing_paragraphs`) show where the texts do, spacing included.
In that of `leaves` separators are left out: its root (`fingerprint`) and the share of equal leaves, the likeness, take texts that differ only in the white space
at these places for equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from changelens.session import materialize


def _up(children: Column) -> Column:
    return F.sha2(F.concat_ws("", children), 256)


def leaves(text: Column) -> Column:
    """Sections of paragraphs of sentence digests, separators left out: array<array<array<string>>>."""
    sentences = lambda p: F.transform(F.split(p, r"(?<=[.!?])\s+"), lambda s: F.sha2(s, 256))
    paragraphs = lambda s: F.transform(F.split(s, "\n"), sentences)
    return F.transform(F.split(text, r"\n[ \t\r]*\n\s*"), paragraphs)


def units(text: Column) -> Column:
    """The same sections, paragraphs and sentences, each with the separator behind it: joined, they are the text.  An empty text is one empty sentence."""
    cut = lambda c, pattern: F.regexp_extract_all(c, F.lit(pattern), F.lit(0))
    sentences = lambda p: cut(p, r"(?s).*?[.!?]\s+|.+")
    paragraphs = lambda s: F.transform(cut(s, r"[^\n]*\n(?:[ \t\r]*\n\s*)?|[^\n]+"), sentences)
    found = F.transform(cut(text, r"(?s).*?\n[ \t\r]*\n\s*|.+"), paragraphs)
    return F.when(text == "", F.array(F.array(F.array(F.lit(""))))).otherwise(found)


def tiling_leaves(text: Column) -> Column:
    """The digests of `units`."""
    return F.transform(units(text), lambda section: F.transform(section, lambda paragraph: F.transform(paragraph, lambda s: F.sha2(s, 256))))


def root_of(tree: Column) -> Column:
    return _up(F.transform(tree, lambda section: _up(F.transform(section, _up))))


def nodes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, section, paragraph, digest): every paragraph node of every document, and its section's node with paragraph null.

    Comparing two versions: equal section nodes are skipped, the paragraphs of the others are compared.  White space between sentences,
    paragraphs and sections belongs to the node before it.  Null texts are like empty ones.
    """
    tree = docs.select(F.col(id_col), tiling_leaves(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("tree"))
    sections = tree.select(id_col, F.posexplode("tree").alias("section", "paragraphs"))
    parts = sections.select(id_col, "section", F.posexplode(F.concat(F.transform("paragraphs", _up), F.array(_up(F.transform("paragraphs", _up))))).alias("paragraph", "digest"), F.size("paragraphs").alias("n"))
    return parts.select(id_col, "section", F.when(F.col("paragraph") < F.col("n"), F.col("paragraph")).alias("paragraph"), "digest")


def differing_paragraphs(a: DataFrame, b: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id_col, section, paragraph) where the `nodes` of two versions differ, for sections whose own nodes differ."""
    top = lambda x: x.where("paragraph is null").drop("paragraph")
    keys = [id_col, "section"]
    changed = top(a).withColumnRenamed("digest", "da").join(top(b).withColumnRenamed("digest", "db"), keys, "full").where("not (da <=> db)").select(keys)
    below = [x.where("paragraph is not null").join(changed, keys, "left_semi").withColumnRenamed("digest", d) for x, d in ((a, "da"), (b, "db"))]
    return below[0].join(below[1], [*keys, "paragraph"], "full").where("not (da <=> db)").select(*keys, "paragraph")


def likeness(a: Column, b: Column) -> Column:
    """Shared leaves over the mean number of leaves, of two arrays of distinct leaves: 1 for equal texts, 0 where nothing is shared."""
    return 2.0 * F.size(F.array_intersect(a, b)) / (F.size(a) + F.size(b))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", per_bucket: int = 1024) -> DataFrame:
    """(id_col, text, next_text): every row and the text of the next one in descending order of ids (after the last: of the first).

    No window over the whole table: rows are dealt into buckets of equal spans of ids, some `per_bucket` to a bucket, and a window runs in
    each.  The first row of a bucket also goes, as a guest, to the end of the bucket before it, so texts are shuffled once.  Rows without an id come last,
    in a bucket of their own; rows that repeat an id are ordered by a hash of their text; a null text is an empty one.
    """
    low, high, n = docs.agg(F.min(id_col), F.max(id_col), F.count(F.lit(1))).first()
    width = 1 if low is None else max(1, (high - low + 1) * per_bucket // max(1, n))
    bucket = F.coalesce(F.floor((F.col(id_col) - F.lit(low or 0)) / F.lit(width)).cast("long"), F.lit(-1).cast("long"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), bucket.alias("bucket"), F.xxhash64(text).alias("tie"))
    # one short row for each bucket: its first row's id and hash, and the bucket before it
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "tie")).alias("head"))
    order = Window.orderBy(F.col("bucket").desc())
    top = Window.orderBy(F.col("bucket").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    heads = materialize(heads.select("head.id", "head.tie", F.coalesce(F.lag("bucket").over(order), F.last("bucket").over(top)).alias("guest_of")), "heads")
    # a table of files, so that Spark's own size check decides whether to broadcast it
    heads = heads.select(F.col("id").alias("h_id"), F.col("tie").alias("h_tie"), "guest_of").dropDuplicates(["h_id", "h_tie", "guest_of"])
    seen = rows.join(heads, rows["id"].eqNullSafe(heads["h_id"]) & (rows["tie"] == heads["h_tie"]), "left")
    once = F.array(F.struct(F.col("bucket"), F.lit(0).alias("guest")))
    seen = seen.select("id", "text", "tie", F.explode(F.when(F.col("guest_of").isNull(), once).otherwise(F.concat(once, F.array(F.struct(F.col("guest_of").alias("bucket"), F.lit(1).alias("guest")))))).alias("at"))
    seen = seen.select("id", "text", "tie", "at.bucket", "at.guest")
    inside = Window.partitionBy("bucket").orderBy("guest", F.col("id").desc_nulls_last(), F.col("tie").desc())
    return seen.withColumn("next_text", F.lead("text").over(inside)).where("guest = 0").select(F.col("id").alias(id_col), "text", "next_text")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, n_chars, edited, fingerprint, edited_fingerprint, near_edited, near_next, text_fingerprint, edited_text_fingerprint) for every row.

    The edited text has the last half of its code points (rounded down) replaced by the first as many, or all, of the next document.  Null
    and empty texts have one empty leaf and are like each other.  The first two fingerprints and the likenesses leave separators out, the last
    two cover the whole text.
    """
    rows = with_next(docs, id_col, text_col).withColumn("n_chars", F.length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring(F.col("next_text"), F.lit(1), half)))
    whole = lambda c: root_of(tiling_leaves(F.col(c)))
    trees = rows.select(id_col, "n_chars", "edited", whole("text").alias("text_fingerprint"), whole("edited").alias("edited_text_fingerprint"), leaves(F.col("text")).alias("tree"), leaves(F.col("edited")).alias("edited_tree"), leaves(F.col("next_text")).alias("next_tree"))
    flat = lambda c: F.array_distinct(F.flatten(F.flatten(c)))
    sets = trees.select(id_col, "n_chars", "edited", "text_fingerprint", "edited_text_fingerprint", root_of(F.col("tree")).alias("fingerprint"), root_of(F.col("edited_tree")).alias("edited_fingerprint"),
                        flat("tree").alias("own"), flat("edited_tree").alias("changed"), flat("next_tree").alias("after"))
    return sets.select(id_col, "n_chars", "edited", "fingerprint", "edited_fingerprint", likeness(F.col("own"), F.col("changed")).alias("near_edited"), likeness(F.col("own"), F.col("after")).alias("near_next"), "text_fingerprint", "edited_text_fingerprint")
