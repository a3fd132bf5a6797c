import itertools
import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from changelens.llm import catalog, simhash
from tests.llm.conftest import SF


def plain_fingerprint(text):
    words, now = [], ""
    for c in (text or "") + " ":
        if c in " \t\n\x0b\x0c\r":
            words, now = words + [now] if now else words, ""
        else:
            now += c.lower() if "A" <= c <= "Z" else c
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows):
    """Component of each (id, fingerprint) by all pairs."""
    root = {f: f for _, f in rows}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a, b in itertools.combinations(list(root), 2):
        if (a ^ b).bit_count() <= 2:
            root[find(a)] = find(b)
    first = {}
    for i, f in rows:
        if i is not None:
            first[find(f)] = min(first.get(find(f), i), i)
    return sorted(((i, f"{f:016x}", first.get(find(f))) for i, f in rows), key=repr)


def test_query(spark, documents):
    got = sorted((tuple(r) for r in catalog.op7_simhash_near_dedup(spark, SF).collect()), key=repr)
    assert got == plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in documents])


def test_odd_rows(spark, odd, empty):
    rows = [(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]
    got = sorted(((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in simhash.near_duplicates(odd).collect()), key=repr)
    assert got == plain_components(rows)
    assert simhash.near_duplicates(empty).collect() == []


def test_covering_masks_meet_every_pair_within_two_bits():
    covering = simhash.masks(2)
    for flips in itertools.chain(itertools.combinations(range(64), 1), itertools.combinations(range(64), 2)):
        diff = sum(1 << b for b in flips)
        assert any(not m & diff for m in covering)
    assert all(m.bit_count() >= 36 for m in covering)


def test_links_of_sparse_and_dense_buckets(spark):
    rng = random.Random(4)
    fps = {rng.getrandbits(64) for _ in range(60)}
    for base in list(fps)[:12]:
        for _ in range(30):
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (rng.random() < 0.3) * (1 << rng.randrange(64)))
    rows = [(i, f) for i, f in enumerate(sorted(fps))]
    df = spark.createDataFrame([(f - (f >> 63 << 64),) for f in fps], "fp long")
    want = {frozenset(f for _, f, c in plain_components(rows) if c == k) for k in {c for _, _, c in plain_components(rows)}}
    for dense in (1, 64, 1000):
        edges = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.fingerprint_links(df, dense).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in edges)
        root = {f: f for f in fps}

        def find(f, root=root):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in edges:
            root[find(a)] = find(b)
        sets = {}
        for f in fps:
            sets.setdefault(find(f), set()).add(f"{f:016x}")
        assert {frozenset(s) for s in sets.values()} == want


def test_one_of_each_component_stays(spark, odd):
    kept = simhash.keep_first(odd).collect()
    ids = sorted(r["doc_id"] for r in kept if r["doc_id"] is not None)
    want = {c for i, _, c in plain_components([(r["doc_id"], plain_fingerprint(r["text"])) for r in odd.collect()]) if i == c}
    assert ids == sorted(want)
    assert [r for r in kept if r["doc_id"] is None] and set(kept[0].asDict()) == set(odd.columns)


def test_exactly_one_row_of_each_component_stays_whatever_its_id(spark, odd, empty):
    for stage in (simhash.keep_one, lambda df: corpus_pipeline.near_dedup_stage(spark, df, SF)):
        kept = stage(odd)
        assert kept.columns == odd.columns
        got = sorted(((r["doc_id"], (r["text"] or "").strip()[:5].replace("\xa0", " ")) for r in kept.collect()), key=repr)
        # both texts of id 7 stay, and no copy without an id
        assert got == [(1, "a b c"), (2, ""), (5, "Größe"), (7, "other"), (7, "x y▁z"), (8, "one")]
        nameless = stage(odd.withColumn("doc_id", F.lit(None).cast("long"))).collect()
        assert len(nameless) == 6 and len({plain_fingerprint(r["text"]) for r in nameless}) == 6
        assert stage(empty).collect() == []
