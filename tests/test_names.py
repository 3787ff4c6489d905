"""Free names against going through the rows one by one."""

import random
from pathlib import PurePosixPath

import pytest

from lectern.operators import jobs, names
from lectern.plans import ORACLES, QUERIES
from tests.conftest import SF


def one_by_one(asked, files=False):
    taken, out = set(), []
    for name in asked:
        got, n = name, 2
        while got in taken:
            path = PurePosixPath(name)
            got = f"{path.stem}_{n}{path.suffix}" if files else f"{name}_{n}"
            n += 1
        taken.add(got)
        out.append(got)
    return out


def given(spark, asked, **more):
    rows = spark.createDataFrame(list(enumerate(asked)), "at int, name string").repartition(3)
    return [r.unique_name for r in sorted(names.suffix_collisions(rows, "name", "at", **more).collect(), key=lambda r: r.at)]


def test_a_name_that_was_given_is_taken(spark):
    assert given(spark, ["a", "a", "a_2"]) == ["a", "a_2", "a_2_2"]
    assert given(spark, ["a_2", "a", "a", "a"]) == ["a_2", "a", "a_3", "a_4"]


@pytest.mark.parametrize("seed", range(3))
def test_random_names(spark, seed):
    rng = random.Random(seed)
    bits = ["a", "a", "a", "a_2", "a_3", "a_4", "a_2_2", "a_2_3", "a_3_2", "a_02", "a_1", "a_2_2_2", "b", "b_2", "a_7", "a_10"]
    asked = [rng.choice(bits) for _ in range(60)]
    got = given(spark, asked, long=[1_000_000, 5, 1_000_000][seed])
    assert got == one_by_one(asked) and len(set(got)) == len(got)


def test_numbers_that_hang_together(spark):
    """Each number is settled by the one before it."""
    asked = ["a"] * 12 + [f"a_{n}" for n in range(2, 30, 3)] + ["a"] * 12 + [f"a_{n}" for n in range(2, 40)] + ["a"] * 5
    assert given(spark, asked) == one_by_one(asked)


def test_files_and_scopes(spark):
    asked = ["x.wav", "x.wav", "x_2.wav", "x", "x", "x_2", ".hid", ".hid", "t.tar.gz", "t.tar.gz", "x_2.wav", "y.", "y."]
    assert given(spark, asked, stem_aware=True)[:11] == one_by_one(asked, files=True)[:11]
    rows = spark.createDataFrame([(d, i, n) for d in (1, 2, None) for i, n in enumerate(["a", "a", "a_2", None])], "dir int, at int, name string")
    got = {(r.dir, r.at): r.unique_name for r in names.suffix_collisions(rows, "name", "at", ["dir"]).collect()}
    assert [got[d, i] for d in (1, 2, None) for i in range(4)] == ["a", "a_2", "a_2_2", None] * 3


def test_one_name_of_many_rows(spark):
    rows = spark.range(30_000).selectExpr("id AS at", "CASE WHEN id % 1000 = 999 THEN concat('a_', id) ELSE 'a' END AS name")
    got = [r.unique_name for r in sorted(names.suffix_collisions(rows, "name", "at", long=5_000).collect(), key=lambda r: r.at)]
    assert got == fast([f"a_{i}" if i % 1000 == 999 else "a" for i in range(30_000)])


def fast(asked):
    """As ``one_by_one``, but the number goes on where it stopped."""
    taken, upto, out = set(), {}, []
    for name in asked:
        got, n = name, upto.get(name, 2)
        while got in taken:
            got, n = f"{name}_{n}", n + 1
        upto[name] = n
        taken.add(got)
        out.append(got)
    return out


@pytest.mark.parametrize("query", ["win_suffix_collisions", "win_file_name_collisions"])
def test_queries_give_different_names(spark, query):
    got = QUERIES[query](spark, SF).collect()
    assert len({r.unique_name for r in got}) == len(got) and query in ORACLES


def test_ranges_and_batches(spark):
    rows = [(1, n) for n in (3, 1, 2, 6, 5, 5, 64, 63, 200, 0)] + [(2, 4), (3, None), (4, 10**6), (4, 10**6 + 1)]
    df = spark.createDataFrame(rows, "job int, n int")
    every = spark.createDataFrame([(i, "p") for i in range(1, 7)], "job int, project string")
    got = {r.job: r.batch for r in jobs.compact_ranges(df, "job", "n", every).collect()}
    assert got == {1: "batch0-3_5-6_63-64_200", 2: "batch4", 3: "complete", 4: "batch1000000-1000001", 5: "complete", 6: "complete"}
    named = {r.job: r.batch_name for r in jobs.batch_names(df, every, "job", "n", "project").collect()}
    assert [named[i] for i in (3, 5, 6)] == ["complete", "complete_2", "complete_3"]
