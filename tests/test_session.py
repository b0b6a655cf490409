import threading

import pytest

from quarry.errors import ConstraintError, ParseError, QuarryError, TransactionConflict
from quarry.session import Session, format_rows, rows
from quarry.sources.backup import restore_backup, verify_backup
from quarry.streaming import Follower


@pytest.fixture
def db(spark, tmp_path):
    return Session(spark, str(tmp_path / "db"))


@pytest.fixture
def docs(db):
    db.execute("CREATE TABLE docs (id INT PRIMARY KEY, name TEXT NOT NULL, meta JSON, embedding VECTOR)")
    db.execute("""INSERT INTO docs VALUES (1, 'alpha', '{"team":"red"}', '[1,0]'), (2, 'beta', {"team":"blue"}, [0, 1]), (3, 'gamma', '{"team":"red"}', '[0.8,0.2]')""")
    return db


def test_json_filter_group_and_vector_order(docs):
    assert docs.rows("SELECT name, JSON_EXTRACT(meta, '$.team') AS team FROM docs WHERE id >= 2 ORDER BY id") == [{"name": "beta", "team": "blue"}, {"name": "gamma", "team": "red"}]
    assert docs.rows("SELECT JSON_EXTRACT(meta, '$.team') AS team, COUNT(*) AS n FROM docs GROUP BY team ORDER BY team") == [{"team": "blue", "n": 1}, {"team": "red", "n": 2}]
    near = docs.rows("SELECT name, VECTOR_DISTANCE(embedding, '[1,0]') AS d FROM docs ORDER BY VECTOR_DISTANCE(embedding, '[1,0]') LIMIT 1")
    assert near[0]["name"] == "alpha" and abs(near[0]["d"]) < 1e-9
    assert docs.rows("SELECT name FROM docs ORDER BY L2_DISTANCE(embedding, '[0,1]') LIMIT 1") == [{"name": "beta"}]


def test_documents_and_vector_rules(db):
    db.execute("CREATE TABLE memories (id INT PRIMARY KEY, embedding VECTOR, document VECTOR_DOCUMENT)")
    db.execute("""INSERT INTO memories VALUES (1, '[1,0]', '{"text":"alpha note","embedding":[1,0],"metadata":{"kind":"note"}}')""")
    got = db.rows("SELECT JSON_EXTRACT(document, '$.text') AS t, VECTOR_DISTANCE(document, '[1,0]') AS d, LENGTH(embedding) AS n FROM memories")
    assert got == [{"t": "alpha note", "d": 0.0, "n": 2}]
    for bad, why in (("(2, '[1,0,0]', NULL)", "dimension"), ("(2, '[NaN,0]', NULL)", "VECTOR|finite"), ("(2, '[true,0]', NULL)", "VECTOR"), ("""(2, NULL, '{"text":" ","embedding":[1,0]}')""", "text"), ("""(2, NULL, '{"text":"a","embedding":[1,0],"metadata":null}')""", "metadata"), ("(1, NULL, NULL)", "primary key")):
        with pytest.raises(ConstraintError, match=why):
            db.execute(f"INSERT INTO memories VALUES {bad}")
    assert db.rows("SELECT COUNT(*) AS n FROM memories") == [{"n": 1}]


def test_types_are_coerced_or_refused(db):
    db.execute("CREATE TABLE t (a INT, b REAL, c DECIMAL(10,2), d VARCHAR(20), e BOOLEAN, f DATE)")
    db.execute("INSERT INTO t VALUES ('12', '1.5', 3.456, 'x - y', TRUE, '2024-01-02'), (2.9, 1, NULL, bare, NULL, NULL), (TRUE, 2e3, 1, \"q\\\"t\", FALSE, NULL)")
    got = db.rows("SELECT a, b, c, d FROM t ORDER BY a DESC")
    assert [(r["a"], r["b"], r["d"]) for r in got] == [(12, 1.5, "x - y"), (2, 1.0, "bare"), (1, 2000.0, 'q"t')]
    for bad in ("('x', 1, 1, 'a', TRUE, NULL)", "(1, 'y', 1, 'a', TRUE, NULL)"):
        with pytest.raises(ConstraintError):
            db.execute(f"INSERT INTO t VALUES {bad}")
    with pytest.raises(ParseError):
        db.execute("INSERT INTO t VALUES (1, 2)")
    with pytest.raises(ConstraintError):
        db.execute("INSERT INTO t (nope) VALUES (1)")
    with pytest.raises(ConstraintError):
        db.execute("CREATE TABLE t (a INT)")
    with pytest.raises(ParseError):
        db.execute("SELECT missing FROM t")
    with pytest.raises((ParseError, QuarryError)):
        db.rows("SELECT a FROM nowhere")


@pytest.fixture
def items(db):
    db.execute("CREATE TABLE items (id INT PRIMARY KEY, name TEXT, score INT)")
    db.execute("INSERT INTO items VALUES (1,'a',10),(2,'b',20),(3,'c',30)")
    return db


def test_prepared(items):
    p = items.prepare("SELECT name, score + ? AS boosted FROM items WHERE score >= ? ORDER BY boosted")
    assert rows(p.execute((5, 15))) == [{"name": "b", "boosted": 25}, {"name": "c", "boosted": 35}]
    assert "score" in p.explain()
    with pytest.raises(ParseError):
        p.execute((5,))
    insert = items.prepare("INSERT INTO items (id, name, score) VALUES (?, ?, NULL)")
    assert insert.executemany([(4, "what?"), (5, "it''s - 1")])["count"] == 2
    assert rows(items.prepare("SELECT * FROM items WHERE name = '?' OR id = ?").execute((4,))) == [{"id": 4, "name": "what?", "score": None}]


def test_arithmetic_nulls_and_order(items):
    items.execute("INSERT INTO items VALUES (4, NULL, NULL)")
    assert [r["id"] for r in items.rows("SELECT id FROM items ORDER BY name")] == [1, 2, 3, 4]
    assert [r["id"] for r in items.rows("SELECT id FROM items ORDER BY name DESC, id")] == [4, 3, 2, 1]
    assert items.rows("SELECT score - 1 - 2 AS a, score * 2 + 1 AS b, score / 0 AS c, -score AS d, score / 4 FROM items WHERE id = 1") == [{"a": 7, "b": 21, "c": None, "d": -10, "score / 4": 2.5}]
    assert items.rows("SELECT id FROM items WHERE name < 5") == []
    assert items.rows("SELECT id FROM items WHERE name IN ('a', 'c') AND score BETWEEN 5 AND 15") == [{"id": 1}]
    assert [r["id"] for r in items.rows("SELECT id FROM items ORDER BY score DESC LIMIT 2 OFFSET 1")] == [3, 2]


def test_null_equal_is_a_choice(spark, tmp_path):
    db = Session(spark, str(tmp_path / "n"), null_equal=True)
    db.execute("CREATE TABLE a (k INT, v TEXT)")
    db.execute("CREATE TABLE b (k INT, w TEXT)")
    db.execute("INSERT INTO a VALUES (1, 'x'), (NULL, 'y')")
    db.execute("INSERT INTO b VALUES (2, 'p'), (NULL, 'q')")
    assert db.rows("SELECT a.v, b.w FROM a JOIN b ON a.k = b.k") == [{"a.v": "y", "b.w": "q"}]
    assert db.rows("SELECT v FROM a WHERE k = NULL") == [{"v": "y"}]


def test_first_row_of_a_group(items):
    items.execute("INSERT INTO items VALUES (4, 'z', 10)")
    assert items.rows("SELECT name, score, COUNT(*) AS n FROM items GROUP BY score ORDER BY score") == [{"name": "a", "score": 10, "n": 2}, {"name": "b", "score": 20, "n": 1}, {"name": "c", "score": 30, "n": 1}]
    assert items.rows("SELECT name, SUM(score) AS s FROM items") == [{"name": "a", "s": 70}]


@pytest.fixture
def shop(db):
    db.execute("CREATE TABLE users (id INT PRIMARY KEY, name TEXT)")
    db.execute("CREATE TABLE orders (id INT PRIMARY KEY, user_id INT, amount INT)")
    db.execute("INSERT INTO users VALUES (1,'Ada'),(2,'Grace'),(3,'Linus')")
    db.execute("INSERT INTO orders VALUES (10,1,100),(11,1,50),(12,3,75)")
    return db


def test_joins_and_explain(shop):
    sql = "SELECT u.name, o.amount FROM users u JOIN orders o ON u.id = o.user_id WHERE o.amount >= 75 ORDER BY o.amount DESC"
    assert shop.rows(sql) == [{"u.name": "Ada", "o.amount": 100}, {"u.name": "Linus", "o.amount": 75}]
    assert shop.rows("SELECT u.name FROM users u LEFT JOIN orders o ON u.id = o.user_id WHERE o.id IS NULL") == [{"u.name": "Grace"}]

    def operations(node):
        return [node["operation"], *(x for c in node["children"] for x in operations(c))]

    assert "HASH_JOIN" in operations(shop.explain(sql))
    assert "HASH_JOIN" in shop.rows("EXPLAIN " + sql)[0]["plan"]
    assert shop.explain("DELETE FROM users")["operation"] == "write"
    with pytest.raises(ParseError):
        shop.rows("SELECT u.name, o.name, u.name FROM users u JOIN users o ON u.id = o.id")


def test_update_delete(items):
    assert items.execute("UPDATE items SET score = score + 1, name = upper(name) WHERE score >= 20")["count"] == 2
    assert items.rows("SELECT name, score FROM items ORDER BY id") == [{"name": "a", "score": 10}, {"name": "B", "score": 21}, {"name": "C", "score": 31}]
    assert items.execute("UPDATE items SET score = NULL WHERE id = 1")["count"] == 1
    with pytest.raises(ConstraintError):
        items.execute("UPDATE items SET id = 2 WHERE id = 3")
    assert items.execute("DELETE FROM items WHERE score > 25")["count"] == 1
    assert items.execute("DELETE FROM items WHERE name = 'no - such; name'")["count"] == 0
    assert items.rows("SELECT COUNT(*) AS n, COUNT(score) AS s FROM items") == [{"n": 2, "s": 1}]
    assert items.execute("DELETE FROM items")["count"] == 2 and items.rows("SELECT * FROM items") == []


def test_conflicts_snapshots_and_rollback(spark, items, tmp_path):
    a, b = items.begin(), items.begin()
    a.insert("items", {"id": 7, "name": "x"})
    b.insert("items", {"id": 8, "name": "y"})
    before = items.table("items")
    a.commit()
    with pytest.raises(TransactionConflict):
        b.commit()
    assert before.count() == 3 and items.table("items").count() == 4
    c = items.begin()
    c.delete("items")
    c.rollback()
    assert items.table("items").count() == 4 and items.table("items", items.version - 1).count() == 3
    again = Session(spark, items.path)
    assert again.version == items.version and rows(again.execute("SHOW TABLES")) == [{"table": "items"}]


def test_a_torn_manifest_is_passed_over(spark, items):
    version = items.version
    items.store.files.create(f"_manifest/{version + 1:012d}.json", b'{"manifest": {"version"')
    again = Session(spark, items.path)
    assert again.version == version and again.table("items").count() == 3
    again.execute("INSERT INTO items VALUES (9, 'i', 1)")
    assert again.version == version + 1 and Session(spark, items.path).table("items").count() == 4


def test_compact_backup_restore(spark, items, tmp_path):
    for i in range(4, 7):
        items.execute(f"INSERT INTO items VALUES ({i}, 'n', {i})")
    items.execute("CREATE INDEX by_score ON items (score)")
    report = items.compact()
    assert report["row_count"] == 6 and report["page_count"] == 1
    target = str(tmp_path / "b.zip")
    items.backup(target)
    with pytest.raises(QuarryError):
        items.backup(target)
    with pytest.raises(QuarryError):
        items.backup(f"{items.path}/inside.zip")
    restore_backup(spark, target, str(tmp_path / "again"))
    again = Session(spark, str(tmp_path / "again"))
    assert again.rows("SELECT COUNT(*) AS n, SUM(score) AS s FROM items") == [{"n": 6, "s": 75}]
    with pytest.raises(QuarryError):
        restore_backup(spark, target, str(tmp_path / "again"))
    data = bytearray(open(target, "rb").read())
    data[len(data) // 3] ^= 1
    open(target, "wb").write(bytes(data))
    with pytest.raises(QuarryError):
        verify_backup(target)


def test_followers_replay_in_order(spark, items, tmp_path):
    other = Session(spark, str(tmp_path / "other"))
    follower = Follower(items.store, other.store)
    assert follower.sync() == items.version
    items.execute("UPDATE items SET score = 0 WHERE id = 1")
    assert follower.sync() == items.version
    assert other.rows("SELECT score FROM items WHERE id = 1") == [{"score": 0}]


def test_restore_state(items):
    kept = items.snapshot_state()
    items.execute("DELETE FROM items WHERE id = 1")
    with pytest.raises(TransactionConflict):
        items.restore_state(kept, expected_version=1)
    items.restore_state(kept, expected_version=items.version)
    assert items.table("items").count() == 3 and items.storage_status()["tables"]["items"]["rows"] == 3


def test_concurrent_inserts_all_go_in(items):
    errors = []

    def add(i):
        try:
            items.execute(f"INSERT INTO items VALUES ({i}, 'n', 0)")
        except Exception as e:
            errors.append(e)

    ts = [threading.Thread(target=add, args=(i,)) for i in range(10, 14)]
    [t.start() for t in ts]
    [t.join() for t in ts]
    assert not errors and items.table("items").count() == 7


def test_format_rows():
    assert format_rows([]) == "(no rows)"
    assert format_rows([{"a": 1, "bb": None}]).split("\n") == ["a | bb", "--+-----", "1 | NULL"]


def test_types_come_from_the_tables_that_are_read(docs):
    ask = lambda: docs.rows("SELECT LENGTH(meta) AS n, JSON_EXTRACT(meta, '$.team') AS team FROM docs WHERE id = 1")
    before = ask()
    docs.execute("CREATE TABLE zother (id INT PRIMARY KEY, meta TEXT)")
    docs.execute("INSERT INTO zother VALUES (1, '{\"team\":\"x\"}')")
    assert ask() == before == [{"n": 1, "team": "red"}]
    assert docs.rows("SELECT LENGTH(d.meta) AS a, LENGTH(z.meta) AS b FROM docs d JOIN zother z ON d.id = z.id") == [{"a": 1, "b": 12}]
    assert docs.rows("SELECT JSON_EXTRACT(meta, '$.team') AS t FROM zother") == [{"t": "x"}]


def test_json_values_are_ordered_and_compared_by_what_they_are(db):
    db.execute("CREATE TABLE j (id INT PRIMARY KEY, m JSON)")
    db.execute("""INSERT INTO j VALUES (1, '{"a": 10}'), (2, '{"a": 9}'), (3, '{"a": 100.5}'), (4, '{"a": "x"}'), (5, '{}')""")
    order = "SELECT id FROM j ORDER BY JSON_EXTRACT(m, '$.a')"
    assert [r["id"] for r in db.rows(order)] == [2, 1, 3, 4, 5]
    assert [r["id"] for r in db.rows(order + " DESC LIMIT 2")] == [5, 4] or [r["id"] for r in db.rows(order + " DESC")][-3:] == [3, 1, 2]
    assert db.rows("SELECT JSON_EXTRACT(m, '$.a') AS v FROM j ORDER BY id") == [{"v": 10}, {"v": 9}, {"v": 100.5}, {"v": "x"}, {"v": None}]
    assert [r["id"] for r in db.rows("SELECT id, JSON_EXTRACT(m, '$.a') AS v FROM j ORDER BY v LIMIT 3")] == [2, 1, 3]
    assert [r["id"] for r in db.rows("SELECT id FROM j WHERE JSON_EXTRACT(m, '$.a') > 9.5 ORDER BY id")] == [1, 3]
    assert db.rows("SELECT MIN(JSON_EXTRACT(m, '$.a')) AS low FROM j WHERE id < 4") == [{"low": "9"}]
    assert db.rows("SELECT JSON_EXTRACT(m, '$.a') + 1 AS more FROM j WHERE id = 2") == [{"more": 10.0}]


def test_names_of_any_case_and_many_calls(docs):
    assert docs.rows("SELECT COUNT(*) AS n FROM DOCS") == [{"n": 3}]
    with pytest.raises(ConstraintError):
        docs.execute("CREATE TABLE Docs (id INT)")
    docs.execute("DELETE FROM Docs WHERE id = 3")
    many = " + ".join(["LENGTH(name)"] * 150)
    assert docs.rows(f"SELECT {many} AS n FROM docs WHERE id = 1") == [{"n": 750}]


def test_writes_leave_other_folders_alone(db):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY, v VECTOR)")
    for i in range(3):
        db.execute(f"INSERT INTO t VALUES ({i}, '[{i},1]')")
    before = db.store.manifest()["tables"]["t"]["files"]
    db.execute("UPDATE t SET id = 10 WHERE id = 1")
    after = db.store.manifest()["tables"]["t"]
    assert set(before) - set(after["files"]) == {before[1]} and after["row_count"] == 3
    db.execute("DELETE FROM t WHERE id = 10")
    assert db.store.manifest()["tables"]["t"]["files"] == [before[0], before[2]]
    for bad, word in (("INSERT INTO t VALUES (2, '[1,1]')", "duplicate"), ("INSERT INTO t VALUES (5, '[1,1]'), (5, '[1,2]')", "duplicate"), ("INSERT INTO t VALUES (6, '[1,1,1]')", "dimension"), ("UPDATE t SET id = 0", "duplicate"), ("INSERT INTO t VALUES ('x', NULL)", "type")):
        with pytest.raises(ConstraintError, match=word):
            db.execute(bad)
    assert sorted(r["id"] for r in db.rows("SELECT id FROM t")) == [0, 2]


def test_a_writer_that_dies_before_the_manifest_leaves_no_trace(db, monkeypatch):
    db.execute("CREATE TABLE t (id INT PRIMARY KEY)")
    monkeypatch.setattr(db.store, "publish", lambda *_: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        db.execute("INSERT INTO t VALUES (1)")
    monkeypatch.undo()
    assert Session(db.spark, db.path).rows("SELECT * FROM t") == []
    db.execute("INSERT INTO t VALUES (1)")
    assert db.store.vacuum(1) >= 1 and db.rows("SELECT * FROM t") == [{"id": 1}]
