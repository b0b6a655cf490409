"""Registered queries that go through the engine's own front: statements, versions, replicas, memory and approval over a database."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.errors import TransactionConflict
from quarry.memory import MEMORY, MemoryStore
from quarry.prompt import PromptSQLService
from quarry.registry import query, read
from quarry.session import Session, shared_dir
from quarry.sources.backup import restore_backup
from quarry.sources.store import Files, Store
from quarry.streaming.follow import Follower, log_frame


def nations(s: SparkSession, d: str) -> Session:
    """A database with the table nations (id, name, region)."""
    db = Session(s)
    db.execute("CREATE TABLE nations (id INT PRIMARY KEY, name TEXT NOT NULL, region INT)")
    db.bulk_insert("nations", None, read(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region")))
    return db


def events(s: SparkSession, d: str) -> Session:
    """A database with the table ev (id, kind, amount, props), its rows in the order of id."""
    db = Session(s)
    db.execute("CREATE TABLE ev (id INT PRIMARY KEY, kind TEXT, amount DOUBLE, props JSON)")
    db.bulk_insert("ev", None, read(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("kind"), F.col("value").alias("amount"), F.parse_json("props").alias("props")).orderBy("id"))
    return db


NATIONS = "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, CAST(n_regionkey AS BIGINT) AS region FROM nation"

# --- statements ---


@query("sql_create_insert", f"{NATIONS} UNION ALL VALUES (100, 'NORTH', 2), (101, 'SO''UTH', -1), (102, 'east', -1)")
def _(s, d):
    db = nations(s, d)
    db.execute("INSERT INTO nations VALUES (100, 'NORTH', 2), (101, 'SO''UTH', NULL)")
    db.execute("INSERT INTO nations (name, id) VALUES ('east', 102)")
    return db.execute("SELECT id, name, COALESCE(region, -1) AS region FROM NATIONS")


@query("sql_update", f"SELECT id, CASE WHEN region = 1 OR id = 3 THEN lower(name) ELSE name END AS name, CASE WHEN region = 1 OR id = 3 THEN region + 10 ELSE region END AS region FROM ({NATIONS})")
def _(s, d):
    db = nations(s, d)
    db.execute("UPDATE nations SET name = LOWER(name), region = region + 10 WHERE region = 1 OR id = 3")
    return db.table("nations")


@query("sql_delete", "SELECT c_custkey AS id, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0")
def _(s, d):
    db, c = Session(s), read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, balance DOUBLE)")
    for rest in (0, 1):  # two folders, of which a delete rewrites those that it hits
        db.bulk_insert("c", None, c.filter(F.col("id") % 2 == rest))
    db.execute("DELETE FROM c WHERE balance < 0")
    return db.table("c")


@query("sql_row_insert", "SELECT 7 AS id, 'seven' AS name UNION ALL SELECT 8, NULL")
def _(s, d):
    db = Session(s)
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, name TEXT)")
    tx = db.begin()
    tx.insert("t", {"id": 7, "name": "seven"})
    tx.insert("t", {"id": 8})
    tx.commit()
    return db.table("t").select(F.col("id").cast("int").alias("id"), "name")


@query("sql_index_lookup", "SELECT c_custkey AS id, c_mktsegment AS segment FROM customer WHERE c_mktsegment = 'BUILDING'")
def _(s, d):
    """Compaction deals rows into ranges of the indexed column, so that the scan skips what cannot hold the value."""
    db = Session(s)
    db.execute("CREATE TABLE c (id INT PRIMARY KEY, segment TEXT)")
    db.bulk_insert("c", None, read(s, d, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("segment")))
    db.execute("CREATE INDEX by_segment ON c (segment)")
    db.compact(file_bytes=4096)
    return db.execute("SELECT id, segment FROM c WHERE segment = 'BUILDING'")


@query("sql_show_tables", 'SELECT table_name AS "table" FROM information_schema.tables WHERE table_schema = \'main\'')
def _(s, d):
    """A table for each file of the test data."""
    tx = (db := Session(s)).begin()
    for name in Files(s, d).names(""):
        if name.endswith(".parquet"):
            tx.run(f"CREATE TABLE {name.removesuffix('.parquet')} (id INT)")
    tx.commit()
    return db.execute("SHOW TABLES")


@query("sql_script", "SELECT CAST(n_regionkey AS BIGINT) AS region, count(*) AS n FROM nation WHERE n_regionkey <> 2 GROUP BY 1")
def _(s, d):
    return nations(s, d).script("DELETE FROM nations WHERE region = 2; -- a comment; with a semicolon\nSELECT region, COUNT(*) AS n FROM nations GROUP BY region;")[-1]


@query("sql_prepared_insert", "SELECT 'user-' || i AS name, i + 5 AS boosted FROM range(9900, 10000) t(i)")
def _(s, d):
    db = Session(s)
    db.execute("CREATE TABLE e (id INT PRIMARY KEY, name TEXT, meta JSON, embedding VECTOR)")
    db.prepare("INSERT INTO e VALUES (?, ?, ?, ?)").executemany([(i, f"user-{i}", {"segment": "ab"[i % 2]}, [i % 10, 3 * i % 10]) for i in range(10_000)])
    return db.prepare("SELECT name, id + ? AS boosted FROM e WHERE id >= ? ORDER BY boosted LIMIT 100").execute((5, 9900))


@query("sql_prepared_update", f"SELECT id, name, CASE WHEN id IN (1, 4, 9) THEN id * 100 ELSE region END AS region FROM ({NATIONS})")
def _(s, d):
    db = nations(s, d)
    for key in (1, 4, 9):
        db.execute(f"UPDATE nations SET region = id * 100 WHERE id = {key}")
    return db.table("nations")


@query("sql_first_row", "SELECT event_type AS kind, min(event_id) AS id, count(*) AS n FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).execute("SELECT kind, id, COUNT(*) AS n FROM ev GROUP BY kind")


@query("sql_json_group", "SELECT json_extract_string(props, '$.k') AS k, count(*) AS n, avg(event_id) AS mean FROM events GROUP BY 1")
def _(s, d):
    return events(s, d).execute("SELECT JSON_EXTRACT(props, '$.k') AS k, COUNT(*) AS n, AVG(id) AS mean FROM ev GROUP BY k")


@query("sql_json_order", "SELECT event_id AS id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events ORDER BY k DESC, id LIMIT 150")
def _(s, d):
    return events(s, d).execute("SELECT id, JSON_EXTRACT_LONG(props, '$.k') AS k FROM ev ORDER BY JSON_EXTRACT(props, '$.k') DESC, id LIMIT 150")


@query("sql_json_least", "SELECT event_type AS kind, CAST(min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR) AS low, CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS VARCHAR) AS high FROM events WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 8.5 GROUP BY 1")
def _(s, d):
    return events(s, d).execute("SELECT kind, MIN(JSON_EXTRACT(props, '$.k')) AS low, MAX(JSON_EXTRACT(props, '$.k')) AS high FROM ev WHERE JSON_EXTRACT(props, '$.k') > 8.5 GROUP BY kind")


@query("sql_lengths", "SELECT event_id AS id, CAST(length(event_type) AS BIGINT) AS letters, len(json_keys(props)) AS keys FROM events")
def _(s, d):
    out = events(s, d).execute("SELECT id, LENGTH(kind) AS letters, LENGTH(props) AS keys FROM ev")
    return out.select("id", F.col("letters").cast("long").alias("letters"), F.col("keys").cast("long").alias("keys"))


@query("sql_join_group", "SELECT r_name AS area, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey WHERE n_nationkey > 3 GROUP BY 1 ORDER BY n DESC, area LIMIT 3")
def _(s, d):
    db = nations(s, d)
    db.execute("CREATE TABLE areas (id INT PRIMARY KEY, area TEXT)")
    db.bulk_insert("areas", None, read(s, d, "region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("area")))
    return db.execute("SELECT a.area AS area, COUNT(*) AS n FROM nations t JOIN areas a ON t.region = a.id WHERE t.id > 3 GROUP BY a.area ORDER BY n DESC, area LIMIT 3")


@query("sql_documents", "SELECT vec_id AS id, 'note ' || vec_id AS body, round(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 3)), 6) AS distance FROM embeddings ORDER BY distance, id LIMIT 10")
def _(s, d):
    """Vectors and documents with an embedding in one table; the probe is one of the vectors."""
    db, e = Session(s), read(s, d, "embeddings")
    db.execute("CREATE TABLE v (id INT PRIMARY KEY, embedding VECTOR, document VECTOR_DOCUMENT)")
    vector = F.col("embedding").cast("array<double>")
    document = F.struct(F.concat(F.lit("note "), "vec_id").alias("text"), vector.alias("embedding"), F.parse_json(F.lit("{}")).alias("metadata"))
    db.bulk_insert("v", None, e.select(F.col("vec_id").alias("id"), vector.alias("embedding"), document.alias("document")))
    probe = e.filter("vec_id = 3").select(vector.alias("e")).first()["e"]
    out = db.execute(f"SELECT id, JSON_EXTRACT(document, '$.text') AS body, L2_DISTANCE(document, '{list(probe)}') AS distance FROM v ORDER BY L2_DISTANCE(embedding, '{list(probe)}'), id LIMIT 10")
    return out.select("id", F.col("body").cast("string").alias("body"), F.round("distance", 6).alias("distance"))


# --- versions ---


@query("sql_time_travel", f"SELECT 'before' AS moment, id, region FROM ({NATIONS}) UNION ALL SELECT 'after', id, 0 FROM ({NATIONS}) WHERE id < 20")
def _(s, d):
    db = nations(s, d)
    before = db.version
    db.execute("UPDATE nations SET region = 0")
    db.execute("DELETE FROM nations WHERE id >= 20")
    at = lambda moment, version: db.table("nations", version).select(F.lit(moment).alias("moment"), "id", "region")
    return at("before", before).union(at("after", None))


@query("sql_transactions", f"SELECT id, name, region FROM ({NATIONS}) WHERE id <> 5 UNION ALL VALUES (200, 'kept', 1)")
def _(s, d):
    """One transaction is rolled back, one commits, and one that began before that commit is refused."""
    db = nations(s, d)
    gone, kept, late = db.begin(), db.begin(), db.begin()
    gone.run("DELETE FROM nations")
    gone.rollback()
    kept.run("DELETE FROM nations WHERE id = 5")
    kept.run("INSERT INTO nations VALUES (200, 'kept', 1)")
    late.run("INSERT INTO nations VALUES (201, 'late', 1)")
    kept.commit()
    try:
        late.commit()
    except TransactionConflict:
        return db.table("nations")
    raise AssertionError("two commits after one version")


@query("sql_snapshot_restore", NATIONS)
def _(s, d):
    db = nations(s, d)
    state = db.snapshot_state()
    db.execute("DELETE FROM nations WHERE region = 1")
    db.execute("DROP TABLE nations")
    db.restore_state(state, db.version)
    return db.table("nations")


@query("sql_compaction", f"{NATIONS} UNION ALL SELECT i, 'x', -1 FROM range(300, 305) t(i)")
def _(s, d):
    db = nations(s, d)
    for i in range(300, 305):
        db.execute(f"INSERT INTO nations (id, name) VALUES ({i}, 'x')")
    db.compact()
    return Session(s, db.path).table("nations").select("id", "name", F.coalesce("region", F.lit(-1)).alias("region"))  # opened again from what is on disk


@query("sql_backup", NATIONS)
def _(s, d):
    db, place = nations(s, d), f"{shared_dir(s).rstrip('/')}/quarry-restored-{uuid.uuid4().hex}"
    with tempfile.TemporaryDirectory() as folder:
        db.backup(os.path.join(folder, "backup.zip"))
        restore_backup(s, os.path.join(folder, "backup.zip"), place)
    restored = Session(s, place)
    restored.store.files.on_exit()
    return restored.table("nations")


@query("sql_replication", f"SELECT id, name, region FROM ({NATIONS}) WHERE region <> 3")
def _(s, d):
    """A follower takes two commits, and later one more."""
    db = nations(s, d)
    store = Store(db.spark, f"{shared_dir(s).rstrip('/')}/quarry-follower-{uuid.uuid4().hex}")
    store.files.on_exit()
    follower = Follower(db.store, store)
    follower.sync()
    db.execute("DELETE FROM nations WHERE region = 3")
    follower.sync()
    return Session(s, store.root).table("nations")


@query("sql_change_log", "SELECT 1::BIGINT AS version, 'create' AS operation, 0 AS n_rows UNION ALL SELECT 2, 'insert', count(*) FROM nation UNION ALL SELECT 3, 'delete', count(*) FROM nation WHERE n_regionkey = 3")
def _(s, d):
    db = nations(s, d)
    db.execute("DELETE FROM nations WHERE region = 3")
    return log_frame(db.store).select("version", "operation", "n_rows")


# --- agent memory and approval ---


def _memory(s: SparkSession, d: str) -> MemoryStore:
    """The conversations as notes, written by the hour of their turn; the clock stands at 1,000."""
    store = MemoryStore(Session(s), clock=lambda: 1_000)
    said = read(s, d, "conversations")
    store.session.bulk_insert(MEMORY, None, said.select(
        F.concat_ws("-", F.lit("m"), "conv_id", "turn").alias("memory_id"), F.lit("hospital").alias("namespace"), F.col("conv_id").cast("string").alias("session_id"), F.col("role").alias("kind"), F.col("text").alias("content"),
        F.parse_json(F.lit("{}")).alias("metadata"), F.array(F.col("turn").cast("double"), F.lit(1.0)).alias("embedding"), F.col("turn").alias("created_at"), F.when(F.col("turn") == 1, 1_000).otherwise(5_000).alias("expires_at"), F.lit("n8n").alias("source"),
    ).dropDuplicates(["memory_id"]))
    return store


def _told(s: SparkSession, answer: dict) -> DataFrame:
    return s.createDataFrame([(m["memory_id"], m["created_at"]) for m in answer["memories"]], "memory_id string, created_at long")


FIRST = "(SELECT min(conv_id) FROM conversations)"
ALIVE = f"SELECT DISTINCT concat_ws('-', 'm', conv_id, turn) AS memory_id, turn AS created_at FROM conversations WHERE conv_id = {FIRST} AND turn <> 1"


@query("memory_store_recent", f"{ALIVE} ORDER BY created_at DESC, memory_id DESC LIMIT 4")
def _(s, d):
    first = read(s, d, "conversations").agg(F.min("conv_id")).first()[0]
    return _told(s, _memory(s, d).recent({"session_id": str(first), "limit": 4}))


@query("memory_store_upsert", "SELECT * FROM (VALUES ('kept', 'new', 1000::BIGINT), ('other', 'b', 1000::BIGINT)) t(memory_id, content, created_at)")
def _(s, d):
    store = MemoryStore(Session(s), clock=lambda: 1_000)
    for note, text in (("kept", "old"), ("other", "b"), ("kept", "new")):
        store.upsert({"memory_id": note, "session_id": "one", "content": text})
    store.audit({"event_type": "SEEN"})
    return store.session.table(MEMORY).select("memory_id", "content", "created_at")


@query("memory_store_semantic", f"{ALIVE} ORDER BY list_cosine_distance([created_at::DOUBLE, 1.0], [1.0, 0.0]), created_at DESC, memory_id DESC LIMIT 3")
def _(s, d):
    first = read(s, d, "conversations").agg(F.min("conv_id")).first()[0]
    return _told(s, _memory(s, d).search({"session_id": str(first), "query_embedding": [1, 0], "limit": 3}))


@query("prompt_undo_redo", f"SELECT id, name, region FROM ({NATIONS}) WHERE id <> 1")
def _(s, d):
    """Two approved statements, both undone, the first one redone."""
    service = PromptSQLService(nations(s, d), lambda prompt, _: {"sql": prompt})
    for sql in ("DELETE FROM nations WHERE id = 1", "UPDATE nations SET region = 9 WHERE id < 5"):
        plan = service.preview(sql)
        service.approve(plan["plan_id"], True, plan["sql_sha256"])
    for step in (service.undo, service.undo, service.redo):
        step()
    return service.session.table("nations")
