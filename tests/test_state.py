"""The stored pull requests do not depend on the order, grouping or repetition of batches."""

from itertools import permutations

import pytest
from pyspark.sql import functions as F

from changelens.plans import stream_queries as Q
from changelens.session import work_dir
from changelens.streaming import events as E
from changelens.streaming import state as S

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr)


@pytest.fixture(scope="module")
def parts(spark):
    """Folds of the four quarters of the events by their numbers, and the result over all of them."""
    events = E.gate(Q._events(spark, SF))[0]
    top = events.agg(F.max("seq")).first()[0] + 1
    folds = [E.fold(events.filter(F.floor(F.col("seq") * 4 / top) == i)) for i in range(4)]
    for i, f in enumerate(folds):
        path = work_dir(spark, f"quarter-{i}")
        f.write.parquet(path)
        folds[i] = spark.read.schema(f.schema).parquet(path)
    return folds, rows(E.upsert(Q.stored_prs(spark, SF), E.fold(events)))


@pytest.mark.parametrize("order", [o for o in permutations(range(4)) if o[0] != 0][::3])
def test_snapshots_in_any_order_of_batches(spark, parts, order):
    folds, want = parts
    path = work_dir(spark, "folds")
    for batch, i in enumerate(order):
        folds[i].write.parquet(f"{path}/batch={batch}")
    first = E.compact(Q.stored_prs(spark, SF), path, -1, 0, work_dir(spark, "snapshot"))
    second = E.compact(first, path, 0, 2, work_dir(spark, "snapshot"))
    assert rows(E.current_prs(second, path, 2)) == want


@pytest.mark.parametrize("order", [(3, 2, 1, 0), (1, 0, 3, 2), (2, 2, 0, 3, 1, 0)])
def test_state_table_in_any_order_of_batches(spark, parts, order):
    folds, want = parts
    table = S.Table(spark, work_dir(spark, "state"), 8).create(Q.stored_prs(spark, SF))
    for i in order:
        table.apply(folds[i])
    assert rows(table.current()) == want


def test_merge_is_commutative_and_idempotent(spark, parts):
    folds, want = parts
    states = [S.of_folds(f) for f in folds] + [S.of_stored(Q.stored_prs(spark, SF))]
    one = S.merge(S.merge(states[3].unionByName(states[4])).unionByName(S.merge(states[0].unionByName(states[2]))).unionByName(states[1]).unionByName(states[3]))
    assert rows(S.current(one)) == want


def test_only_touched_buckets_are_read_and_written(spark, parts):
    folds, _ = parts
    table = S.Table(spark, work_dir(spark, "state"), 64).create(Q.stored_prs(spark, SF))
    _, before = table.manifest()
    few = folds[1].orderBy("first_seq").limit(2)
    touched = table.apply(few)
    version, after = table.manifest()
    assert version == 1 and 1 <= len(touched) <= 2
    assert {b for b, v in after.items() if v == 1} == set(touched) and all(after[b] == 0 for b in before if b not in touched)
    read = table._folders(before, touched).inputFiles()
    assert all(f"/bucket={b}/" in " ".join(read) for b in touched if b in before) and len({f.split("/bucket=")[1].split("/")[0] for f in read}) <= len(touched)
    assert table.apply(few.limit(0)) == [] and table.manifest()[0] == 1


def test_a_version_without_manifest_does_not_exist(spark, parts):
    folds, _ = parts
    table = S.Table(spark, work_dir(spark, "state"), 8).create(Q.stored_prs(spark, SF))
    before = rows(table.current())
    # a run that was cut before its manifest: rows are there, the commit is not
    placed = S.merge(table.states().unionByName(S.of_folds(folds[0]))).withColumn("bucket", E.bucket_of(E.KEY, 8))
    placed.write.partitionBy("bucket").parquet(f"{table.path}/rows/version=1")
    assert rows(table.current()) == before
    table.apply(folds[0])
    assert rows(table.current()) == rows(E.upsert(Q.stored_prs(spark, SF), folds[0]))
