"""Every registered query of the library against DuckDB."""

import decimal
import os

import duckdb
import pytest

from terrasift.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else str(v) if isinstance(v, decimal.Decimal) else v


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for f in os.listdir(SMALL):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SMALL}/{f}'")
    return c


def test_each_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, db, name):
    df = QUERIES[name](spark, SMALL)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    found = db.sql(ORACLES[name])
    assert sorted(found.columns) == columns
    order = [found.columns.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=str)


def test_pushdown_and_pruning(spark):
    plan = QUERIES["tpch_q6"](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull" in plan and "ReadSchema: struct<l_quantity:double" in plan and "l_orderkey" not in plan


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0 and set(QUERIES) <= set(e.queries())


def test_deltas_hold_whole_texts(spark):
    pieces = {}
    for r in sorted(QUERIES["delta_from_cumulative"](spark, SMALL).collect()):
        pieces[r["conv_id"], r["turn"]] = pieces.get((r["conv_id"], r["turn"]), "") + r["delta"]
    texts = {(r["conv_id"], r["turn"]): r["text"] for r in spark.read.parquet(f"{SMALL}/conversations.parquet").collect()}
    assert pieces == texts and max(map(len, texts.values())) > 120


def test_posting_ids_of_common_tokens(spark):
    rows = QUERIES["keyword_postings_lists"](spark, SMALL).collect()
    held = {}
    for r in rows:
        held.setdefault(r["token"], []).extend(map(int, r["doc_ids"].split(",")))
    df = {r["token"]: r["df"] for r in QUERIES["keyword_postings_df"](spark, SMALL).collect()}
    assert {t: len(set(ids)) for t, ids in held.items()} == df and max(df.values()) > 50


def test_systems_move_places_near_the_equator(spark, tmp_path):
    """Places whose coordinates in the zone are small, as eastings and northings are there."""
    keys = [k for k in range(200_000) if abs(k * 7919 % 36000 / 100 - 180) < 4 and 0 <= k * 104729 % 18000 / 100 - 90 < 4]
    spark.createDataFrame([(k,) for k in keys], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    rows = QUERIES["geometry_systems"](spark, str(tmp_path)).collect()
    assert len(rows) == len(keys) > 50 and all(r["moved"] for r in rows)


@pytest.mark.parametrize("keys", [[51153, 56931, 7, 8, 9], [51153, 56931, 7, 8, 9, None]])
def test_nearest_supplier_ties_by_the_distance_shown(spark, tmp_path, keys):
    """Distances that differ in their last bit only are ties; suppliers without a place come last."""
    spark.createDataFrame([(42,)], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, f"s{k}") for k in keys], "s_suppkey long, s_name string").write.parquet(str(tmp_path / "supplier.parquet"))
    got = [(r["s_suppkey"], r["s_name"], r["distance"]) for r in QUERIES["nearest_supplier"](spark, str(tmp_path)).collect()]
    ties = duckdb.connect()
    for t in ("customer", "supplier"):
        ties.sql(f"create view {t} as select * from '{tmp_path}/{t}.parquet/*.parquet'")
    assert got == ties.sql(ORACLES["nearest_supplier"]).fetchall()
    assert got[0][0] == 51153 and got[0][2] == got[1][2]
