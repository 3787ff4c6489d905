"""Every query with SQL gives the rows of that SQL."""

import glob
import math
import os
import sys

import duckdb
import pytest

from lectern.plans import ORACLES, QUERIES
from tests.conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.6g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return float(f"{float(x):.6g}") if type(x).__name__ == "Decimal" else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(got.columns)
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("absent", ["corpus_pipeline", "lectern.llm", "zstandard"])
def test_other_queries_do_not_need_the_training_data_operators(monkeypatch, absent):
    import __spark_entry__

    for name in [n for n in sys.modules if n == "corpus_pipeline" or n.startswith("lectern.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, absent, None)
    assert set(__spark_entry__.queries()) == set(QUERIES)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 4
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_halves_are_rounded_as_in_sql(spark, duck, tmp_path):
    near = [(0.16221004724502563, 0.34483814239501953), (-0.04994594678282738, 0.32629817724227905), (0.030139649286866188, 0.31815841794013977), (0.011179300025105476, 0.3062821924686432)]
    made = [(i, [float(x), top, *[0.0] * 62], 0) for i, (x, top) in enumerate(near)]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label int").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: r.normal for r in QUERIES["aud_normalize_quantize"](spark, str(tmp_path)).collect()}
    here = ORACLES["aud_normalize_quantize"].replace("FROM embeddings", f"FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    want = {r[0]: r[1] for r in duck.execute(f"SELECT vec_id, normal FROM ({here})").fetchall()}
    assert got == want and [want[i][0] for i in range(4)] == [0.44688, -0.14541, 0.09, 0.03467]


@pytest.mark.parametrize("name", ["cfg_resolve_layers", "cfg_config_diff", "cfg_changed_settings"])
def test_of_equal_layers_the_first_order_holds(spark, tmp_path, name):
    customers = [(i, 1, "MACHINERY", 1.0) for i in range(40)]
    orders = [(1 + 3 * i + k * 1_000_000, i, f"{'acb'[(i + k) % 3]}-{k}", "O") for k in (0, 1, 3) for i in range(40)]
    spark.createDataFrame(customers, "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    made = spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string")
    made.coalesce(1).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = con.execute(ORACLES[name])
    columns = [c[0] for c in want.description]
    got = QUERIES[name](spark, str(tmp_path)).select(*columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


@pytest.mark.parametrize("name", ["scr_boundaries", "scr_breaks"])
def test_sentences_meet_without_a_window(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan


def test_pairs_of_parts(spark):
    from pyspark.sql import functions as F

    from lectern.operators import chunkers as C

    df = spark.createDataFrame([(1, "a b c"), (2, "a"), (3, None), (4, "d e")], "id int, text string")
    got = C.exploded_pairs(df, F.split("text", " "), "n", following="b").collect()
    assert sorted(map(tuple, got)) == [(1, 1, "a", "b"), (1, 2, "b", "c"), (4, 1, "d", "e")]
