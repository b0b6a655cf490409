"""Registered queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry import mvcc
from quarry.functions import cosine_distance, json_extract, json_extract_double, json_extract_long, l2_distance, matches, safe_add, safe_divide, safe_multiply, safe_subtract, vector_literal
from quarry.memory import recent_rows, semantic_rows, visible_rows
from quarry.operators import HyperplaneIndex, as_of, chain, equi_join, first_rows, group, hash_join, nearest, nested_loop_join, sort, top
from quarry.prepared import bind
from quarry.registry import QUERIES, SQL, Query, query, read
from quarry.sources.rows import key_range
from quarry.sources.writes import after_delete, after_insert, after_update
from quarry.streaming import event_windows

# --- scan, projection, filter, expressions ---


@query("scan_project", "SELECT o_orderkey, o_custkey AS customer, o_totalprice FROM orders")
def _(s, d):
    return read(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_totalprice")


@query("filter_bool", "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE (l_quantity > 45 AND l_discount <= 0.03) OR (l_returnflag = 'R' AND l_tax >= 0.08)")
def _(s, d):
    c = F.col
    return read(s, d, "lineitem").filter(((c("l_quantity") > 45) & (c("l_discount") <= 0.03)) | ((c("l_returnflag") == "R") & (c("l_tax") >= 0.08))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("filter_null_eq", "SELECT o_orderkey FROM orders WHERE nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM nullif(o_orderpriority, o_orderpriority)")
def _(s, d):
    return read(s, d, "orders").filter(F.nullif("o_orderstatus", F.lit("F")).eqNullSafe(F.nullif("o_orderpriority", "o_orderpriority"))).select("o_orderkey")


@query("filter_two_valued", "SELECT o_orderkey FROM orders WHERE NOT coalesce(nullif(o_custkey, 1) < 500, false)")
def _(s, d):
    return read(s, d, "orders").filter(~matches(F.nullif("o_custkey", F.lit(1)) < 500)).select("o_orderkey")


@query("filter_is_null", "SELECT o_orderkey, nullif(o_orderstatus, 'O') IS NULL AS missing FROM orders WHERE nullif(o_orderstatus, 'O') IS NULL OR nullif(o_orderstatus, 'P') IS NOT NULL")
def _(s, d):
    status = lambda x: F.nullif("o_orderstatus", F.lit(x))
    return read(s, d, "orders").filter(status("O").isNull() | status("P").isNotNull()).select("o_orderkey", status("O").isNull().alias("missing"))


@query("arith_safe", "SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(l_discount, 0) AS ratio, l_quantity + l_tax AS total, l_quantity - l_tax - l_discount AS less, l_quantity * l_tax + 1 AS more FROM lineitem")
def _(s, d):
    c = F.col
    return read(s, d, "lineitem").select(
        "l_orderkey", "l_linenumber", safe_divide(c("l_extendedprice"), c("l_discount")).alias("ratio"), safe_add(c("l_quantity"), c("l_tax")).alias("total"),
        safe_subtract(safe_subtract(c("l_quantity"), c("l_tax")), c("l_discount")).alias("less"), safe_add(safe_multiply(c("l_quantity"), c("l_tax")), F.lit(1)).alias("more"),
    )


@query("scalar_strings", "SELECT c_custkey, upper(c_name) AS u, lower(c_mktsegment) AS l, CAST(length(c_name) AS BIGINT) AS n, abs(c_acctbal) AS a, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS c FROM customer")
def _(s, d):
    return read(s, d, "customer").select("c_custkey", F.upper("c_name").alias("u"), F.lower("c_mktsegment").alias("l"), F.char_length("c_name").cast("long").alias("n"), F.abs("c_acctbal").alias("a"), F.coalesce(F.nullif("c_mktsegment", F.lit("BUILDING")), F.lit("none")).alias("c"))


# --- JSON ---


@query("json_extract_filter", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) >= 50")
def _(s, d):
    k = json_extract_long(F.col("props"), "$.k")
    return read(s, d, "events").filter(k >= 50).select("event_id", k.alias("k"))


@query("json_extract_variant", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(NULL AS VARCHAR) AS missing FROM events")
def _(s, d):
    v = F.parse_json("props")
    return read(s, d, "events").select("event_id", json_extract(v, "$.k", text=False).alias("k"), json_extract(v, "$.none", text=False).alias("missing"))


@query("json_group_agg", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(avg(event_id), 6) AS mean FROM events GROUP BY 1")
def _(s, d):
    return group(read(s, d, "events"), [json_extract_long(F.col("props"), "$.k").alias("k")], [F.count("*").alias("n"), F.round(F.avg("event_id"), 6).alias("mean")])


@query("json_double", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) * 2 < 10.5")
def _(s, d):
    return read(s, d, "events").filter(json_extract_double(F.col("props"), "$.k") * 2 < 10.5).select("event_id")


# --- aggregation ---

GLOBAL = "count(*) AS n, count(nullif(p_size, 1)) AS sized, CAST(sum(p_size) AS BIGINT) AS total, avg(p_size) AS mean, min(p_retailprice) AS low, max(p_name) AS high"


def _global(df: DataFrame) -> DataFrame:
    return group(df, [], [F.count("*").alias("n"), F.count(F.nullif("p_size", F.lit(1))).alias("sized"), F.sum("p_size").alias("total"), F.avg("p_size").alias("mean"), F.min("p_retailprice").alias("low"), F.max("p_name").alias("high")])


@query("agg_global", f"SELECT {GLOBAL} FROM part")
def _(s, d):
    return _global(read(s, d, "part"))


@query("agg_empty", f"SELECT {GLOBAL} FROM part WHERE p_size < 0")
def _(s, d):
    return _global(read(s, d, "part").filter("p_size < 0"))


@query("group_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS quantity, round(avg(l_discount), 6) AS discount, max(l_shipdate) AS last FROM lineitem GROUP BY 1, 2")
def _(s, d):
    return group(read(s, d, "lineitem"), [F.col("l_returnflag"), F.col("l_linestatus")], [F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.round(F.avg("l_discount"), 6).alias("discount"), F.max("l_shipdate").alias("last")])


@query("group_first_row", "SELECT o_custkey, arg_min(o_orderstatus, o_orderkey) AS first_status, count(*) AS n FROM orders GROUP BY o_custkey")
def _(s, d):
    return group(read(s, d, "orders"), [F.col("o_custkey")], [F.count("*").alias("n")], ["o_orderkey"], {"first_status": F.col("o_orderstatus")})


@query("group_distinct_on", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def _(s, d):
    return first_rows(read(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@query("group_distinct_like", "SELECT c_mktsegment, c_nationkey FROM customer GROUP BY 1, 2")
def _(s, d):
    return read(s, d, "customer").select("c_mktsegment", "c_nationkey").distinct()


@query("group_composite", "SELECT l_returnflag, round(sum(l_quantity) / count(*), 6) AS mean, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1 HAVING count(*) > 10")
def _(s, d):
    return read(s, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum("l_quantity") / F.count("*"), 6).alias("mean"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("n")).filter("n > 10").drop("n")


# --- joins ---


@query("join_hash_filter_sort", "SELECT c_name, o_totalprice, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice >= 300000 ORDER BY o_totalprice DESC, o_orderkey")
def _(s, d):
    j = hash_join(read(s, d, "customer"), read(s, d, "orders"), "c_custkey", "o_custkey", "c", "o").filter(F.col("`o.o_totalprice`") >= 300000)
    return j.select(F.col("`c.c_name`").alias("c_name"), F.col("`o.o_totalprice`").alias("o_totalprice"), F.col("`o.o_orderkey`").alias("o_orderkey")).orderBy(F.desc("o_totalprice"), "o_orderkey")


@query("join_nested_loop", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def _(s, d):
    return nested_loop_join(read(s, d, "nation"), read(s, d, "region"), "n_regionkey", "r_regionkey").select(F.col("`l.n_name`").alias("n_name"), F.col("`r.r_name`").alias("r_name"))


@query("join_multiway", "SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name")
def _(s, d):
    j = chain({"o": read(s, d, "orders").select("o_custkey", "o_totalprice"), "c": read(s, d, "customer").select("c_custkey", "c_nationkey"), "n": read(s, d, "nation").select("n_nationkey", "n_name")}, [("o.o_custkey", "c.c_custkey"), ("c.c_nationkey", "n.n_nationkey")], nulls_match=False)
    return j.groupBy(F.col("`n.n_name`").alias("n_name")).agg(F.count("*").alias("n"), F.round(F.sum("`o.o_totalprice`"), 2).alias("total"))


@query("join_nullsafe", "SELECT n_name, r_name FROM nation JOIN region ON nullif(n_regionkey, 2) IS NOT DISTINCT FROM nullif(r_regionkey, 3)")
def _(s, d):
    a = read(s, d, "nation").withColumn("k", F.nullif("n_regionkey", F.lit(2)))
    b = read(s, d, "region").withColumn("k", F.nullif("r_regionkey", F.lit(3)))
    return equi_join(a, b, "k", "k", "n", "r").select(F.col("`n.n_name`").alias("n_name"), F.col("`r.r_name`").alias("r_name"))


@query("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
def _(s, d):
    n = read(s, d, "nation")
    return equi_join(n, n, "n_regionkey", "n_regionkey", "a", "b", False).filter(F.col("`a.n_nationkey`") < F.col("`b.n_nationkey`")).select(F.col("`a.n_name`").alias("a"), F.col("`b.n_name`").alias("b"))


@query("join_outer", "SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey")
def _(s, d):
    return equi_join(read(s, d, "customer"), read(s, d, "orders").filter("o_totalprice > 400000"), "c_custkey", "o_custkey", "c", "o", False, "left").select(F.col("`c.c_custkey`").alias("c_custkey"), F.coalesce("`o.o_orderkey`", F.lit(-1)).alias("o_orderkey"))


@query("join_right", "SELECT coalesce(s_suppkey, -1) AS s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def _(s, d):
    j = equi_join(read(s, d, "supplier").filter("s_acctbal > 5000"), read(s, d, "nation"), "s_nationkey", "n_nationkey", "s", "n", False, "right")
    return j.select(F.coalesce("`s.s_suppkey`", F.lit(-1)).alias("s_suppkey"), F.col("`n.n_name`").alias("n_name"))


@query("join_full", "SELECT coalesce(c_custkey, -1) AS c_custkey, coalesce(s_suppkey, -1) AS s_suppkey FROM (SELECT * FROM customer WHERE c_acctbal > 9000) FULL JOIN (SELECT * FROM supplier WHERE s_acctbal > 5000) ON c_nationkey = s_nationkey")
def _(s, d):
    j = equi_join(read(s, d, "customer").filter("c_acctbal > 9000"), read(s, d, "supplier").filter("s_acctbal > 5000"), "c_nationkey", "s_nationkey", "c", "s", False, "full")
    return j.select(F.coalesce("`c.c_custkey`", F.lit(-1)).alias("c_custkey"), F.coalesce("`s.s_suppkey`", F.lit(-1)).alias("s_suppkey"))


BANDS = [(i, 40_000.0 * i, 40_000.0 * i + 15_000) for i in range(12)]


@query("join_range", f"SELECT o_orderkey, band FROM orders JOIN (VALUES {', '.join(map(str, BANDS))}) b(band, low, high) ON o_totalprice >= low AND o_totalprice < high")
def _(s, d):
    """A table of twelve bands, which is sent to every task."""
    bands = s.createDataFrame(BANDS, "band int, low double, high double")
    return read(s, d, "orders").join(F.broadcast(bands), (F.col("o_totalprice") >= F.col("low")) & (F.col("o_totalprice") < F.col("high"))).select("o_orderkey", "band")


@query("join_interval", "SELECT a.event_id, count(*) AS n FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts >= a.ts AND b.ts < a.ts + INTERVAL 1 DAY GROUP BY 1")
def _(s, d):
    """Events of a user within a day of each: a range frame counts them, and no pairs are made."""
    day = Window.partitionBy("user_id").orderBy(F.unix_micros(F.col("ts").cast("timestamp"))).rangeBetween(0, 86_400_000_000 - 1)
    return read(s, d, "events").select("event_id", F.count("*").over(day).alias("n"))


@query("join_theta", "SELECT a.r_name AS low, b.r_name AS high FROM region a JOIN region b ON a.r_regionkey < b.r_regionkey")
def _(s, d):
    r = read(s, d, "region")
    return r.select(F.col("r_regionkey").alias("x"), F.col("r_name").alias("low")).join(F.broadcast(r.select(F.col("r_regionkey").alias("y"), F.col("r_name").alias("high"))), F.col("x") < F.col("y")).select("low", "high")


@query("join_semi_anti", "SELECT c_custkey, 'with' AS orders FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders) UNION ALL SELECT c_custkey, 'without' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def _(s, d):
    c, o = read(s, d, "customer").select("c_custkey"), read(s, d, "orders").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("orders", F.lit("with")).union(c.join(o, "c_custkey", "left_anti").withColumn("orders", F.lit("without")))


@query("join_as_of", "SELECT a.event_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'click') a ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type <> 'click' GROUP BY 1, 2) b ON a.user_id = b.user_id AND a.ts >= b.ts")
def _(s, d):
    e = read(s, d, "events")
    a = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    b = e.filter("event_type <> 'click'").select("user_id", F.col("ts").alias("at"), F.col("value").alias("last_value"))
    return as_of(a, b, ["user_id"], "ts", "at", ["last_value"]).select("event_id", "last_value")


# --- order ---


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(s, d):
    return top(read(s, d, "orders").select("o_orderkey", "o_totalprice"), 25, "-o_totalprice", "o_orderkey")


@query("topk_nulls_last", "SELECT event_id, nullif(event_type, 'click') AS kind FROM events ORDER BY kind ASC NULLS LAST, event_id LIMIT 40")
def _(s, d):
    return top(read(s, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind")), 40, "kind", "event_id")


@query("topk_desc_nulls_first", "SELECT event_id, nullif(event_type, 'click') AS kind FROM events ORDER BY kind DESC NULLS FIRST, event_id LIMIT 40")
def _(s, d):
    return top(read(s, d, "events").select("event_id", F.nullif("event_type", F.lit("click")).alias("kind")), 40, "-kind", "event_id")


@query("order_hidden_column", "SELECT o_orderkey FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 30")
def _(s, d):
    return top(read(s, d, "orders"), 30, "o_totalprice", "o_orderkey").select("o_orderkey")


@query("sort_multi", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
def _(s, d):
    return sort(read(s, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_mktsegment", "-c_acctbal", "c_custkey")


@query("limit_offset", "SELECT p_partkey FROM part ORDER BY p_partkey LIMIT 10 OFFSET 5")
def _(s, d):
    return read(s, d, "part").select("p_partkey").orderBy("p_partkey").offset(5).limit(10)


# --- windows, sets, grouping sets ---


@query("window_rank", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 2")
def _(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return read(s, d, "orders").select("o_orderkey", F.row_number().over(w).cast("long").alias("place")).filter("place <= 2")


@query("set_operations", "(SELECT c_nationkey AS k FROM customer UNION SELECT n_nationkey FROM nation) EXCEPT SELECT s_nationkey FROM supplier WHERE s_nationkey < 10")
def _(s, d):
    return read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(read(s, d, "nation").select("n_nationkey")).distinct().subtract(read(s, d, "supplier").filter("s_nationkey < 10").select("s_nationkey"))


@query("group_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def _(s, d):
    return read(s, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("group_rollup", "SELECT l_returnflag, l_linestatus, grouping(l_linestatus) AS level, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def _(s, d):
    return read(s, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.grouping("l_linestatus").cast("long").alias("level"), F.count("*").alias("n"))


@query("group_sets", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority))")
def _(s, d):
    return read(s, d, "orders").groupingSets([[F.col("o_orderstatus")], [F.col("o_orderpriority")]], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("group_filtered", "SELECT event_type, count(*) FILTER (value > 50) AS high, coalesce(round(sum(value) FILTER (user_id % 2 = 0), 4), 0) AS even FROM events GROUP BY 1")
def _(s, d):
    return read(s, d, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("high"), F.coalesce(F.round(F.sum(F.when(F.col("user_id") % 2 == 0, F.col("value"))), 4), F.lit(0.0)).alias("even"))


@query("group_approximate", "SELECT event_type, true AS near FROM events GROUP BY 1")
def _(s, d):
    """Whether an estimate of distinct users is within a tenth of their number.

    Both go over the distinct pairs, which leave the sketch as it is: beside count_distinct there would be a sketch of 3 kB for each user."""
    exact, estimate = F.count("user_id"), F.approx_count_distinct("user_id", 0.02)
    return read(s, d, "events").select("event_type", "user_id").distinct().groupBy("event_type").agg((F.abs(estimate - exact) <= exact * 0.1).alias("near"))


@query("window_frames", "SELECT event_id, lag(value, 1, 0.0) OVER w AS before, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS three, first_value(event_type) OVER w AS first, dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS kind FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)")
def _(s, d):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return read(s, d, "events").select("event_id", F.lag("value", 1, 0.0).over(w).alias("before"), F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("three"), F.first("event_type").over(w).alias("first"), F.dense_rank().over(Window.partitionBy("user_id").orderBy("event_type")).cast("long").alias("kind"))


# --- vectors ---

FIRST = "(SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"
PROBE = [1.0 if i % 3 else -0.5 for i in range(64)]
PROBE_SQL = f"{PROBE}::DOUBLE[]"


@query("vector_cosine", f"SELECT vec_id, round(CASE WHEN list_inner_product(e, e) = 0 THEN 1.0 ELSE list_cosine_distance(e, {PROBE_SQL}) END, 6) + 0.0 AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(s, d):
    return read(s, d, "embeddings").select("vec_id", (F.round(cosine_distance(F.col("embedding"), vector_literal(PROBE)), 6) + 0.0).alias("distance"))


@query("vector_l2", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {PROBE_SQL}), 6) AS distance FROM embeddings")
def _(s, d):
    return read(s, d, "embeddings").select("vec_id", F.round(l2_distance(F.col("embedding"), vector_literal(PROBE)), 6).alias("distance"))


@query("vector_knn", f"SELECT vec_id, round(list_cosine_distance(embedding::DOUBLE[], {PROBE_SQL}), 6) AS distance FROM embeddings ORDER BY list_cosine_distance(embedding::DOUBLE[], {PROBE_SQL}), vec_id LIMIT 10")
def _(s, d):
    return nearest(read(s, d, "embeddings"), PROBE, 10, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


INDEX = HyperplaneIndex(64)


@query("vector_ann_signature", f"SELECT vec_id, CAST({' + '.join(f'CASE WHEN list_inner_product(e, {n}::DOUBLE[]) >= 0 THEN {1 << i} ELSE 0 END' for i, n in enumerate(INDEX.normals))} AS INTEGER) AS signature FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def _(s, d):
    return INDEX.build(read(s, d, "embeddings")).select("vec_id", "signature")


@query("vector_ann_search", f"SELECT vec_id, round(list_distance(embedding::DOUBLE[], {PROBE_SQL}), 6) AS distance FROM embeddings ORDER BY list_distance(embedding::DOUBLE[], {PROBE_SQL}), vec_id LIMIT 10")
def _(s, d):
    index = INDEX.build(read(s, d, "embeddings"))
    return INDEX.search(index, PROBE, 10, exact=True, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


SIGNATURE_SQL = f"SELECT vec_id, e, CAST({' + '.join(f'CASE WHEN list_inner_product(e, {n}::DOUBLE[]) >= 0 THEN {1 << i} ELSE 0 END' for i, n in enumerate(INDEX.normals))} AS INTEGER) AS signature FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"
OWN = INDEX.of(PROBE)


@query("vector_ann_probed", f"""WITH s AS ({SIGNATURE_SQL}), b AS (SELECT signature, count(*) AS n FROM s GROUP BY 1),
o AS (SELECT signature, coalesce(sum(n) OVER (ORDER BY bit_count(xor(signature, {OWN})), xor(signature, {OWN}) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held FROM b)
SELECT vec_id, round(list_distance(e, {PROBE_SQL}), 6) AS distance FROM s WHERE signature IN (SELECT signature FROM o WHERE held < 10 OR signature IN ({OWN}, {OWN ^ 1}))
ORDER BY list_distance(e, {PROBE_SQL}), vec_id LIMIT 10""")
def _(s, d):
    index = INDEX.build(read(s, d, "embeddings"))
    return INDEX.search(index, PROBE, 10, exact=False, key="vec_id").select("vec_id", F.round("distance", 6).alias("distance"))


# --- statements, writes, versions ---


@query("prepared_params", "SELECT o_orderkey, o_totalprice + 5 AS boosted FROM orders WHERE o_totalprice >= 250000 ORDER BY boosted, o_orderkey LIMIT 100")
def _(s, d):
    return bind(s, "SELECT o_orderkey, o_totalprice + ? AS boosted FROM {orders} WHERE o_totalprice >= ? ORDER BY boosted, o_orderkey LIMIT 100", [5, 250000], orders=read(s, d, "orders"))


@query("dml_update", "SELECT n_nationkey, CASE WHEN n_regionkey = 1 THEN upper(n_name) ELSE n_name END AS n_name, CASE WHEN n_regionkey = 1 THEN n_regionkey + 10 ELSE n_regionkey END AS n_regionkey FROM nation")
def _(s, d):
    return after_update(read(s, d, "nation"), {"n_name": "upper(n_name)", "n_regionkey": "n_regionkey + 10"}, "n_regionkey = 1")


@query("dml_delete", "SELECT s_suppkey, s_acctbal FROM supplier WHERE NOT coalesce(nullif(s_nationkey, 3) < 10, false)")
def _(s, d):
    return after_delete(read(s, d, "supplier"), "nullif(s_nationkey, 3) < 10").select("s_suppkey", "s_acctbal")


@query("dml_insert", "SELECT r_regionkey, r_name FROM region UNION ALL VALUES (90, 'NORTH'), (91, NULL)")
def _(s, d):
    return after_insert(read(s, d, "region").select("r_regionkey", "r_name"), s.createDataFrame([(90, "NORTH"), (91, None)], "r_regionkey int, r_name string"))


@query("index_key_range", "SELECT p_partkey, p_name FROM part WHERE p_partkey >= 100 AND p_partkey < 200")
def _(s, d):
    return key_range(read(s, d, "part"), "p_partkey", 100, 200).select("p_partkey", "p_name")


@query("mvcc_visible", "SELECT CAST(user_id AS VARCHAR) AS key, event_type AS value, event_id AS created FROM (SELECT *, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS deleted FROM events) WHERE event_id <= 4000 AND (deleted IS NULL OR deleted > 4000) AND CAST(user_id AS VARCHAR) LIKE '1%'")
def _(s, d):
    """Each event of a user replaces the one before: what stood at version 4000."""
    e, after = read(s, d, "events"), Window.partitionBy("user_id").orderBy("event_id")
    history = e.select(F.col("user_id").cast("string").alias("key"), F.col("event_type").alias("value"), F.col("event_id").alias("created"), F.lead("event_id").over(after).alias("deleted"))
    return mvcc.visible(history, 4000, "1").drop("deleted")


@query("mvcc_latest", "SELECT o_custkey AS key, arg_max(o_orderkey, o_orderdate) AS value FROM (SELECT o_custkey, o_orderdate, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1, 2) GROUP BY 1")
def _(s, d):
    rows = read(s, d, "orders").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("value"), F.col("o_orderdate").alias("created"))
    return mvcc.latest(rows, ["created", "value"]).select("key", "value")


# --- agent memory ---

NOTES = "SELECT conv_id, turn, role, text, row_number() OVER () AS n FROM conversations"


def _notes(s, d):
    c = read(s, d, "conversations")
    return c.select(F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("memory_id"), F.lit("main").alias("namespace"), F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("kind"), F.col("text").alias("content"), F.col("turn").alias("created_at"), (F.col("turn") + 100).alias("expires_at"))


MEMORY = "SELECT concat_ws('-', 'm', conv_id, turn) AS memory_id, CAST(conv_id AS VARCHAR) AS session_id, role AS kind, text AS content, turn AS created_at FROM conversations"


@query("memory_recent", f"SELECT memory_id, session_id, created_at FROM ({MEMORY}) QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, memory_id DESC) <= 3")
def _(s, d):
    return recent_rows(visible_rows(_notes(s, d), "main", now=50), 3).select("memory_id", "session_id", "created_at")


@query("memory_lexical", f"SELECT memory_id, created_at FROM ({MEMORY}) WHERE lower(content) LIKE '%the%' AND kind = 'user' QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, memory_id DESC) <= 3")
def _(s, d):
    return recent_rows(visible_rows(_notes(s, d), "main", kinds=["user"], now=50, text="THE"), 3).select("memory_id", "created_at")


@query("memory_semantic", f"SELECT vec_id AS memory_id, round(list_cosine_distance(embedding::DOUBLE[], {PROBE_SQL}), 6) AS distance FROM embeddings WHERE label = 3 ORDER BY list_cosine_distance(embedding::DOUBLE[], {PROBE_SQL}), vec_id DESC LIMIT 5")
def _(s, d):
    rows = read(s, d, "embeddings").filter("label = 3").select(F.col("vec_id").alias("memory_id"), "embedding", F.col("vec_id").alias("created_at"))
    return semantic_rows(rows, PROBE, 5).select("memory_id", F.round("distance", 6).alias("distance"))


@query("events_window", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def _(s, d):
    return event_windows(read(s, d, "events"), "1 day", ["event_type"]).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


def queries() -> dict[str, Query]:
    from quarry import front_queries  # noqa: F401  registers itself

    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in queries() if name in SQL}
