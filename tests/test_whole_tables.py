"""Queries that must see every row of their tables."""

from shardloom.plans import catalogue


def test_full_join_keeps_every_supplier_and_part(spark):
    sf = "/root/testdata/sf0.01"
    rows = catalogue.QUERIES["join_full"](spark, sf).collect()
    for column, name, key in (("s_suppkey", "supplier", "s_suppkey"), ("p_partkey", "part", "p_partkey")):
        want = sorted(r[0] for r in spark.read.parquet(f"{sf}/{name}.parquet").select(key).collect())
        assert sorted(r[column] for r in rows if r[column] is not None) == want


def test_correlated_scalar_covers_every_customer(spark):
    sf = "/root/testdata/sf0.01"
    got = [r["c_custkey"] for r in catalogue.QUERIES["correlated_scalar"](spark, sf).collect()]
    assert sorted(got) == sorted(r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect())
    assert len(got) > 200
