import hashlib
import re

from changelens.llm import catalog, merkle
from tests.llm.conftest import SF

sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def plain_tree(text):
    return [[[sha(s) for s in re.split(r"(?<=[.!?])[ \t\n\x0b\x0c\r]+", p)] for p in s.split("\n")] for s in re.split(r"\n[ \t\r]*\n[ \t\n\x0b\x0c\r]*", text)]


def plain_root(tree):
    up = lambda xs: sha("".join(xs))
    return up([up([up(p) for p in s]) for s in tree])


def likeness(a, b):
    a, b = ({x for s in t for p in s for x in p} for t in (a, b))
    return 2 * len(a & b) / (len(a) + len(b))


def expected(rows):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in rows), key=lambda r: -r[0])
    for k, (i, text) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        trees = [plain_tree(t) for t in (text, edited, after)]
        yield i, len(text), sha(edited), plain_root(trees[0]), plain_root(trees[1]), likeness(trees[0], trees[1]), likeness(trees[0], trees[2])


def test_query(spark, documents):
    got = sorted(tuple(r) for r in catalog.op8_merkle_fingerprints(spark, SF).collect())
    assert got == sorted(expected(documents))


def test_sparse_and_negative_ids_in_many_buckets(spark):
    ids = [-(10**15), -5, -4, 0, 3, 10**6, 10**6 + 1, 10**17]
    df = spark.createDataFrame([(i, f"text of {i}.\n\nend. really? yes") for i in ids], "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["next_text"]) for r in merkle.with_next(df, per_bucket=1).collect()}
    order = sorted(ids, reverse=True)
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    assert got == {i: (texts[i], texts[order[(k + 1) % len(order)]]) for k, i in enumerate(order)}


def test_odd_rows(spark, odd, empty):
    got = merkle.edits(odd).collect()
    assert len(got) == odd.count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)
    assert all(r["fingerprint"] and r["edited_fingerprint"] for r in got)
    assert merkle.edits(empty).collect() == []
    one = odd.where("doc_id = 8")
    assert merkle.edits(one).collect()[0]["edited"] == "ono"


def test_differing_branches_locate_edits(spark):
    a = spark.createDataFrame([(1, "a.\nb.\n\nc.\nd.\n\ne."), (2, "same"), (3, None)], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a.\nb.\n\nc.\nX.\n\ne."), (2, "same"), (3, None)], "doc_id long, text string")
    assert [tuple(r) for r in merkle.differing_paragraphs(merkle.nodes(a), merkle.nodes(b)).collect()] == [(1, 1, 1)]


def test_whole_texts_are_covered(spark, documents):
    pairs = [("A. B", "A.  B"), ("x\n\ny", "x\n \n\n y"), ("a.\nb", "a.\n\nb"), ("a\n", "a"), ("", "\n"), ("\n\nx", "\nx"), ("a. b! \n\n", "a. b!\n\n"), ("x\r\n\r\ny", "x\n\ny")]
    texts = [t for p in pairs for t in p] + [r["text"] or "" for r in documents]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    cut = df.select("doc_id", merkle.units(df["text"]).alias("units"), merkle.root_of(merkle.tiling_leaves(df["text"])).alias("root")).collect()
    assert {r["doc_id"]: "".join(u for s in r["units"] for p in s for u in p) for r in cut} == dict(enumerate(texts))
    assert all(p and all(p) for r in cut if texts[r["doc_id"]] for s in r["units"] for p in s)
    assert len({r["root"] for r in cut}) == len(set(texts))
    a, b = ([(i, p[k]) for i, p in enumerate(pairs)] for k in (0, 1))
    a, b = (spark.createDataFrame(x, "doc_id long, text string") for x in (a, b))
    assert {r["doc_id"] for r in merkle.differing_paragraphs(merkle.nodes(a), merkle.nodes(b)).collect()} == set(range(len(pairs)))
    roots = [{r["doc_id"]: r["text_fingerprint"] for r in merkle.edits(x).collect()} for x in (a, b)]
    assert all(roots[0][i] != roots[1][i] for i in range(len(pairs)))
