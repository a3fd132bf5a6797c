import math
import re
from collections import Counter

import numpy as np
import pytest

from changelens.llm import catalog, lexical
from changelens.session import work_dir
from tests.llm.conftest import SF

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
SMALL = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def split(text):
    return TERM.findall((text or "").translate(SMALL))


def brute(docs, items, k=10):
    """{item: [(doc_id, score), ...]} by scoring every row."""
    rows = [(key, Counter(split(text)), len(split(text))) for key, text in docs]
    rows = [r for r in rows if r[2]]
    n_docs, n_words = len(rows), sum(r[2] for r in rows)
    df = Counter(t for r in rows for t in r[1])
    out = {}
    for item, text in set(items):
        found = []
        for key, counts, n in rows:
            score = 0
            for term in split(text):
                if tf := counts[term]:
                    weight = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[term] + 1)))
                    score += weight * (10**9 * tf // (1000 * tf + 8 * (25 + 75 * n * n_docs // n_words)))
            if score > 0:
                found.append((-score, key is None, key or 0))
        if found:
            out[item] = [(None if none else key, -score) for score, none, key in sorted(found)[:k]]
    return out


def told(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r["item_id"], []).append((r["doc_id"], r["score"]))
        assert r["rank"] == len(out[r["item_id"]])
    return out


def test_terms():
    assert lexical.terms("Don't STOP Ärger_9 \u0000x\u0085y") == [t.encode() for t in split("Don't STOP Ärger_9 \u0000x\u0085y")]
    assert lexical.terms(None) == lexical.terms("") == lexical.terms(" .,_ ") == []


def test_query(spark, documents):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert told(catalog.op11_ranked_search(spark, SF)) == brute([(r["doc_id"], r["text"]) for r in documents], items)


def test_bounds_hold_for_every_row_and_level(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{min(int(x), 400)}" for x in rng.zipf(1.3, size=int(rng.integers(1, 3000)))) for _ in range(120)] + ["w1 " * 5000, "solo"]
    monkeypatch.setattr(lexical, "SPARSE", 1)  # crowded signatures: many rows that do not hold a term
    monkeypatch.setattr(lexical, "LEAST_BITS", 8)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts), pa.array(range(len(texts)))], ["id", "text", "mark"])
    stored = [r for b in lexical._index_task(iter([batch])) for r in b.to_pylist()]
    names = [b"w1", b"w2", b"w77", b"solo", b"absent"]
    total = next(r for r in stored if r["words"])
    q = lexical.Queries(names, lexical._hashes(names, 5), [np.arange(5), np.array([2, 3])], [np.array([3.0, 500, 7000, 9000, 9500]), np.array([1.0, 2.0])], total["docs"], total["words"], np.ones(2))
    seen = 0
    for block in (r for r in stored if r["bits"]):
        bounds = q.bounds(block["bits"], np.array(block["sizes"]), block["slices"])
        for j, key in enumerate(block["ids"]):
            exact = q.scores(texts[key])
            assert all(bounds[i, j] >= exact.get(i, 0) for i in range(2))
            seen += 1
    assert seen == len(texts)
    assert {r["term"]: r["docs"] for r in stored if r["term"]}[b"w1"] == sum(b"w1" in lexical.terms(t) for t in texts)


def test_ties_copies_and_blocks_of_items(spark):
    rng = np.random.default_rng(8)
    words = [f"t{i}" for i in range(60)]
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 40)))) for i in range(200)]
    docs += [(1000 + i, "t1 t2 t3 same text") for i in range(40)] + [(7, docs[7][1]), (None, "t1 t2 t3 same text"), (None, "t1 t2 t3 same text"), (3000, None), (3001, ""), (3002, "t5 " * 3000)]
    items = [(i, " ".join(rng.choice(words, size=5))) for i in range(12)] + [(50, "t1 t2 t3 same"), (51, None), (52, ""), (53, "nowhere"), (3, "t9 t9 t9 T9"), (50, "t1 t2 t3 same")]
    items = [x for x in items if x[0] != 3 or "T9" in x[1]]
    table, asked = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    assert told(lexical.ranked(table, asked)) == want
    folder = work_dir(spark, "index")
    lexical.build_index(table.repartition(5), folder)
    assert told(lexical.search(folder, table, asked, items_at_once=4, pilots=1)) == want
    assert told(lexical.search(folder, table, asked, k=3)) == {i: rows[:3] for i, rows in want.items()}


def test_odd_and_empty(spark, odd, empty):
    items = spark.createDataFrame([(1, "the cat x b", 1), (None, "other text", 2), (3, None, 3)], "item_id long, text string, rank int")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    renamed = odd.withColumnRenamed("size", "mark").withColumnRenamed("first", "items").withColumnRenamed("source", "key")
    assert told(lexical.ranked(renamed, items)) == brute(docs, [(r["item_id"], r["text"]) for r in items.collect()])
    assert lexical.ranked(empty, items).collect() == [] and lexical.ranked(odd, items.where("false")).collect() == []


@pytest.mark.parametrize("bits", [256, 1 << 20])
def test_places(bits):
    at = lexical._places(lexical._keys(lexical._hashes([b"a", b"b"], 2), 3), bits)
    assert at.shape == (2, lexical.HASHES) and at.min() >= 0 and at.max() < bits
