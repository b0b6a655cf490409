import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from quarry import queries as core
from quarry.functions import cosine_distance, json_extract, json_extract_long, json_length, l2_distance, safe_divide, vector_literal
from quarry.operators import HyperplaneIndex, as_of, chain, equi_join, first_rows, group, nearest, top
from quarry.streaming import event_sessions, event_windows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def values(frame):
    return sorted(tuple("NULL" if v is None or v != v else str(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).where(frame[sorted(frame.columns)].notna(), None).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(core.oracle_sql()))
def test_query_against_duckdb(spark, tables, name):
    own, other = core.queries()[name](spark, SF).toPandas(), tables.execute(core.oracle_sql()[name]).df()
    assert sorted(own.columns) == sorted(other.columns)
    assert values(own) == values(other)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(core.oracle_sql()) <= set(__spark_entry__.queries())


def test_null_keys_meet(spark):
    a = spark.createDataFrame([(1, "x"), (None, "y"), (1, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "p"), (None, "q"), (2, "r")], "k int, v string")
    got = equi_join(a, b, "k", "k", "a", "b").select("`a.v`", "`b.v`").collect()
    assert sorted(map(tuple, got)) == [("x", "p"), ("y", "q"), ("z", "p")]
    assert equi_join(a, b, "k", "k", "a", "b", nulls_match=False).count() == 2
    assert equi_join(a, b.limit(0), "k", "k", "a", "b", how="left").count() == 3
    with pytest.raises(Exception, match="connect"):
        chain({"a": a, "b": b}, [("x.k", "y.k")])


def test_as_of(spark):
    a = spark.createDataFrame([(1, 5), (1, 1), (2, 9), (None, 3)], "k int, t int")
    b = spark.createDataFrame([(1, 2, "early"), (1, 5, "same"), (2, 10, "late"), (None, 1, "none")], "k int, at int, w string")
    got = {(r.k, r.t): r.w for r in as_of(a, b, ["k"], "t", "at", ["w"]).collect()}
    assert got == {(1, 5): "same", (1, 1): None, (2, 9): None, (None, 3): "none"}


def test_first_rows_and_global_aggregates(spark):
    df = spark.createDataFrame([("a", 2, "late"), ("a", 1, "first"), ("b", 3, None)], "k string, n int, v string")
    assert sorted(map(tuple, first_rows(df, ["k"], ["n"]).select("k", "v").collect())) == [("a", "first"), ("b", None)]
    assert group(df.limit(0), [], [F.count("*").alias("n"), F.sum("n").alias("s")]).collect()[0] == (0, None)
    assert [r.n for r in top(df, 2, "-n").collect()] == [3, 2]


def test_an_estimate_of_users_keeps_a_sketch_for_each_group_only(spark, tmp_path):
    rows = [("a", i % 3000) for i in range(9000)] + [(None, 1), (None, 1), ("b", None), ("b", None), ("c", None), ("c", 7)]
    spark.createDataFrame(rows, "event_type string, user_id long").repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    df = core.queries()["group_approximate"](spark, str(tmp_path))
    keys = re.findall(r"keys=\[(.*?)\], functions=\[[^\n]*approx_count_distinct", df._jdf.queryExecution().executedPlan().toString())
    assert keys and all(re.fullmatch(r"event_type#\d+", k) for k in keys)
    assert sorted(map(str, map(tuple, df.collect()))) == sorted(map(str, [("a", True), ("b", True), ("c", True), (None, True)]))
    spark.createDataFrame([], "event_type string, user_id long").write.parquet(str(tmp_path / "none/events.parquet"))
    assert core.queries()["group_approximate"](spark, str(tmp_path / "none")).count() == 0


def test_json_and_arithmetic(spark):
    df = spark.createDataFrame([('{"a": {"b": [1, 2]}, "n": null}',), ("[1, 2, 3]",), ("text",), (None,)], "j string")
    got = df.select(json_extract(F.col("j"), "$.a.b[1]").alias("x"), json_extract_long(F.col("j"), "$.a.b[5]").alias("y"), json_extract(F.col("j"), "a").alias("z"), json_length(F.col("j")).alias("n")).collect()
    assert [tuple(r) for r in got] == [("2", None, None, 2), (None, None, None, 3), (None, None, None, 4), (None, None, None, None)]
    assert spark.range(1).select(safe_divide(F.lit(1), F.lit(0)).alias("d")).first().d is None


def test_vectors(spark):
    df = spark.createDataFrame([("origin", [0.0, 0.0]), ("x", [1.0, 0.0]), ("wide", [1.0, 2.0, 3.0]), ("none", None), ("neg", [-1e-3, 2.5e1])], "key string, embedding array<double>")
    one = vector_literal([1.0, 0.0])
    cosine = {r.key: r.d for r in df.select("key", cosine_distance(F.col("embedding"), one).alias("d")).collect()}
    assert cosine["origin"] == 1.0 and cosine["x"] == 0.0 and cosine["wide"] is None and cosine["none"] is None
    assert {r.key: r.d for r in df.select("key", l2_distance(F.col("embedding"), one).alias("d")).collect()}["origin"] == 1.0
    assert [r.key for r in nearest(df, [0.1, 0.0], 1, metric="l2").collect()] == ["origin"]
    index = HyperplaneIndex(2)
    built = index.build(df)
    assert {r.key: r.signature for r in built.collect()}["x"] == index.of([1.0, 0.0])
    assert [r.key for r in index.search(built, [0.1, 0.0], 1).collect()] == ["origin"]
    assert index.search(built, [1.0, 0.0], 3, probes=4, exact=False).count() >= 1
    more = index.add(built, spark.createDataFrame([("x", [5.0, 5.0])], "key string, embedding array<double>"))
    assert more.count() == 5 and more.filter("key = 'x'").first().embedding == [5.0, 5.0]


def test_approximate_search_widens_until_the_limit(spark):
    rng = random.Random(7)
    rows = [(f"k{i:03}", [rng.gauss(20.0 * (1 if i % 40 else -1), 1.0) for _ in range(8)]) for i in range(200)] + [("none", None), ("hole", [None] * 8), ("wide", [1.0] * 9)]
    index = HyperplaneIndex(8)
    built = index.build(spark.createDataFrame(rows, "key string, embedding array<double>")).cache()
    for asked in ([-20.0] * 8, [20.0, -20.0] * 4):  # a bucket of five rows, and most likely none
        for limit in (1, 10, 150, 200):
            got = index.search(built, asked, limit, exact=False).collect()
            assert len(got) == limit and [r.distance for r in got] == sorted(r.distance for r in got)
    assert index.search(built, [20.0] * 8, 500, exact=False).count() == 200
    assert list(index._order(5))[:4] == [5, 4, 7, 1] and sorted(index._order(5)) == list(range(256))
    assert index.search(built, [20.0] * 8, 3, probes=2, exact=False).filter("key = 'k000'").count() == 0


def test_joins_stay_hash_joins_and_filters_reach_the_scan(spark):
    o = spark.read.parquet(f"{SF}/orders.parquet").filter("o_totalprice > 1000").select("o_orderkey", "o_custkey")
    c = spark.read.parquet(f"{SF}/customer.parquet")
    plan = equi_join(o, c, "o_custkey", "c_custkey", "o", "c")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "GreaterThan(o_totalprice,1000" in plan


def test_windows_of_a_stream_and_a_table_agree(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = event_windows(stream, "1 day", ["event_type"], late="1 hour").writeStream.format("memory").queryName("w").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    table = event_windows(events, "1 day", ["event_type"])
    key = lambda r: (r.start, r.event_type, r.n)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, table.collect()))
    assert event_sessions(events, "30 minutes", ["user_id"]).agg(F.sum("n")).first()[0] == events.count()
