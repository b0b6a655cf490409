"""The engine's front: SQL statements, prepared statements and transactions over versioned tables."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterable, Sequence
from typing import Any

import pyarrow as pa
from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry import statements as st
from quarry.errors import ConstraintError, ParseError, QuarryError, TransactionConflict
from quarry.functions.sql import register
from quarry.plans import explain_plan
from quarry.prepared import arity
from quarry.sources import backup
from quarry.sources.store import Store
from quarry.sources.types import ROW_ID, Column, agreed_sizes, check_keys, check_rows, check_table, measures, problem_of
from quarry.sources.writes import after_delete, after_update


#: Literal rows for each task that writes them.
LITERAL_ROWS = 50_000


def table_listing(spark: SparkSession, names: Iterable[str]) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(names)], "`table` string")


def plain(value: Any) -> Any:
    """A collected value as plain Python."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value.toPython() if isinstance(value, T.VariantVal) else value


def rows(df: DataFrame) -> list[dict[str, Any]]:
    """All rows as dictionaries; names that come twice are an error."""
    if len(set(df.columns)) != len(df.columns):
        raise ParseError("columns of one name: give them aliases")
    return [plain(r) for r in df.collect()]


def format_rows(found: list[dict[str, Any]]) -> str:
    """An aligned text table."""
    if not found:
        return "(no rows)"
    names = list(found[0])
    cells = [[("NULL" if r.get(n) is None else str(r[n])) for n in names] for r in found]
    wide = [max(len(n), *(len(c[i]) for c in cells)) for i, n in enumerate(names)]
    line = lambda c: " | ".join(x.ljust(w) for x, w in zip(c, wide, strict=True)).rstrip()
    return "\n".join([line(names), "-+-".join("-" * w for w in wide), *map(line, cells)])


def shared_dir(spark: SparkSession) -> str:
    """Where a database without a path lies: ``spark.checkpoint.dir``, which driver and executors share; a temporary folder on one machine alone."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named and not (conf.get("spark.master") or "").startswith("local"):
        raise QuarryError("a database on a cluster needs a path, or spark.checkpoint.dir")
    return named or tempfile.gettempdir()


class Session:
    """A database of versioned tables under ``path``; without one, under a folder that goes when it is closed or the application ends.

    Names of tables and columns are those of any case.

    It works in a Spark session of its own beside the caller's: temporary views, functions and settings are not the
    caller's. There ANSI mode is off, so that division by zero and operands of another type give NULL; integers
    then wrap around where they overflow, which the caller's own ANSI session would report. ``null_equal``: NULL = NULL is true."""

    def __init__(self, spark: SparkSession, path: str | None = None, null_equal: bool = False):
        self.spark = spark.newSession()
        self.spark.conf.set("spark.sql.ansi.enabled", "false")
        self.spark.conf.set("parquet.page.verify-checksum.enabled", "true")
        self.temporary = path is None or path == ":memory:"
        self.path = f"{shared_dir(spark).rstrip('/')}/quarry-{uuid.uuid4().hex}" if self.temporary else path
        self.store, self.null_equal, self.lock = Store(self.spark, self.path), null_equal, threading.RLock()
        if self.temporary:
            self.store.files.on_exit()
        register(self.spark)

    # --- reading ---

    @property
    def version(self) -> int:
        return self.store.version

    def tables(self, version: int | None = None) -> list[str]:
        return sorted(self.store.manifest(version)["tables"])

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table as it is, or was at ``version``."""
        return self.begin(version).frame(name)

    def execute(self, sql: str, params: Sequence[Any] = ()) -> DataFrame | dict[str, Any]:
        """Runs one statement: a DataFrame for what reads, a status for what writes. Each write is a commit of its own."""
        statement = st.parse(sql)
        if isinstance(statement, (st.Select, st.ShowTables, st.Explain)):
            return self.begin().run(statement, params)
        with self.lock:
            tx = self.begin()
            out = tx.run(statement, params)
            tx.commit()
            return out

    def rows(self, sql: str, params: Sequence[Any] = ()) -> list[dict[str, Any]]:
        out = self.execute(sql, params)
        return rows(out) if isinstance(out, DataFrame) else [out]

    def script(self, text: str) -> list[DataFrame | dict[str, Any]]:
        return [self.execute(s) for s in st.split_statements(text)]

    def explain(self, sql: str) -> dict[str, Any]:
        """The plan that runs, as a tree of operation, estimated_rows, cost, details and children."""
        statement = st.parse(sql)
        if isinstance(statement, st.Explain):
            statement = st.parse(statement.sql)
        if not isinstance(statement, st.Select):
            return {"operation": "write", "statement": type(statement).__name__}
        return explain_plan(self.begin().run(statement, ()))

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    # --- writing ---

    def begin(self, version: int | None = None) -> Transaction:
        return Transaction(self, self.store.manifest(version))

    def bulk_insert(self, table: str, columns: list[str] | None, values: Iterable[Sequence[Any]] | DataFrame) -> dict[str, Any]:
        with self.lock:
            tx = self.begin()
            out = tx.insert_many(table, columns, values)
            tx.commit()
            return out

    def compact(self, file_bytes: int = 128 << 20) -> dict[str, Any]:
        """Rewrites each table into one folder of files of about ``file_bytes``, in the order of its indexed columns, and drops what no version needs any more."""
        with self.lock:
            base, tables = self.store.manifest(), {}
            for name, t in base["tables"].items():
                df, files = self.store.read(t), max(1, -(-sum(map(self.store.files.bytes, t["files"])) // file_bytes))
                # ranges of the first indexed column, so that a lookup by it reads one file and skips the others
                dealt = df.repartitionByRange(files, t["indexes"][0]) if t["indexes"] else df.repartition(files)
                folders = [self.store.write(name, dealt, t["indexes"])] if t["files"] else []
                tables[name] = t | {"files": folders, "sizes": dict.fromkeys(folders, t["row_count"])}
            manifest = self.store.publish(base, tables, [{"table": n, "operation": "compact"} for n in tables])
            self.store.vacuum(1)
            return {"status": "compacted", "version": manifest["version"], "table_count": len(tables), "row_count": sum(t["row_count"] for t in tables.values()), "page_count": sum(len(t["files"]) for t in tables.values())}

    def checkpoint(self) -> dict[str, Any]:
        """Every commit is durable by itself; this tells where it stands."""
        return {"status": "checkpointed", "version": self.version}

    def backup(self, destination: str) -> dict[str, Any]:
        return backup.create_backup(self.store, destination)

    def storage_status(self) -> dict[str, Any]:
        return self.store.status()

    def catalog(self) -> dict[str, Any]:
        m = self.store.manifest()
        return {"catalog_version": 1, "engine_version": m["version"], "tables": {n: {k: t[k] for k in ("columns", "indexes", "row_count")} for n, t in sorted(m["tables"].items())}}

    def snapshot_state(self) -> dict[str, Any]:
        """The present state: which folders make each table. It can be restored as long as no compaction has come."""
        return self.store.manifest()

    def restore_state(self, snapshot: dict[str, Any], expected_version: int | None = None, change: dict[str, Any] | None = None) -> int:
        """Makes an earlier state the next version; ``change`` is told beside it."""
        with self.lock:
            base = self.store.manifest()
            if expected_version is not None and base["version"] != expected_version:
                raise TransactionConflict(f"the version is {base['version']}, not {expected_version}")
            return self.store.publish(base, snapshot["tables"], [{"table": n, "operation": "restore"} for n in sorted({*base["tables"], *snapshot["tables"]})] + ([change] if change else []))["version"]

    def close(self) -> None:
        if self.temporary:
            self.store.files.delete("")


class Transaction:
    """Statements against one version; what they write is published together or not at all."""

    def __init__(self, session: Session, base: dict[str, Any]):
        self.session, self.store, self.spark = session, session.store, session.spark
        self.base, self.tables = base, dict(base["tables"])
        self.changes: list[dict[str, Any]] = []
        self.open = True

    def name(self, given: str) -> str:
        """A table's own name, from one in any case."""
        if not self.open:
            raise QuarryError("the transaction has ended")
        own = given if given in self.tables else next((n for n in self.tables if n.lower() == given.lower()), None)
        if own is None:
            raise QuarryError(f"there is no table {given}")
        return own

    def _known(self, name: str) -> dict[str, Any]:
        return self.tables[self.name(name)]

    def bytes_left_behind(self) -> int:
        """Bytes of the folders that the version before names and this transaction does not: what stays on disk for the sake of going back."""
        now = {f for t in self.tables.values() for f in t["files"]}
        return sum(self.store.files.bytes(f) for t in self.base["tables"].values() for f in t["files"] if f not in now)

    def columns(self, name: str) -> list[Column]:
        return [Column(**c) for c in self._known(name)["columns"]]

    def frame(self, name: str, with_order: bool = False) -> DataFrame:
        df = self.store.read(self._known(name))
        return df if with_order else df.drop(ROW_ID)

    def run(self, statement: st.Statement | str, params: Sequence[Any] = ()) -> DataFrame | dict[str, Any]:
        statement = st.parse(statement) if isinstance(statement, str) else statement
        if isinstance(statement, st.Select):
            return self._select(statement.sql, params)
        if isinstance(statement, st.ShowTables):
            return table_listing(self.spark, self.tables)
        if isinstance(statement, st.Explain):
            inner = st.parse(statement.sql)
            if not isinstance(inner, st.Select):
                raise ParseError("EXPLAIN takes a SELECT")
            import json

            return self.spark.createDataFrame([(json.dumps(explain_plan(self._select(inner.sql, params))),)], "plan string")
        if isinstance(statement, st.CreateTable):
            self.create_table(statement.name, statement.columns)
            return {"status": "created", "table": statement.name}
        if isinstance(statement, st.DropTable):
            del self.tables[self.name(statement.name)]
            self.changes.append({"table": statement.name, "operation": "drop"})
            return {"status": "dropped", "table": statement.name}
        if isinstance(statement, st.CreateIndex):
            self.create_index(statement.table, statement.column)
            return {"status": "created", "index": statement.name}
        if isinstance(statement, st.Insert):
            return self.insert_many(statement.table, statement.columns, statement.rows)
        if isinstance(statement, st.Update):
            return self.update(statement.table, statement.assignments, statement.where)
        return self.delete(statement.table, statement.where)

    def _select(self, sql: str, params: Sequence[Any]) -> DataFrame:
        if arity(sql) != len(params):
            raise ParseError(f"the statement takes {arity(sql)} parameters, not {len(params)}")
        read = st.sources(sql, {n.lower(): n for n in self.tables})
        families = st.Families([(alias, self.columns(n)) for alias, n in read])
        text = st.order_nulls(st.typed_calls(st.typed_json(st.named_by_text(sql)), families))
        text = st.null_equal(text) if self.session.null_equal else text
        names = sorted({n for _, n in read})
        with self.session.lock:
            try:
                return self._ask(text, names, params, False)
            except AnalysisException as e:
                if "MISSING_AGGREGATION" not in str(e) and "MISSING_GROUP_BY" not in str(e):
                    raise ParseError(_short(e)) from e
                if len(names) != 1:
                    raise ParseError(_short(e)) from e
                try:
                    return self._ask(st.first_rows_of_groups(text, ROW_ID), names, params, True)
                except PySparkException as again:
                    raise ParseError(_short(again)) from again
            except ParseException as e:
                raise ParseError(_short(e)) from e

    def _ask(self, sql: str, names: list[str], params: Sequence[Any], with_order: bool) -> DataFrame:
        for n in names:
            self.frame(n, with_order).createOrReplaceTempView(n)
        try:
            return self.spark.sql(sql, args=list(params)) if params else self.spark.sql(sql)  # analysed here, so the views can go
        finally:
            for n in names:
                self.spark.catalog.dropTempView(n)

    def select(self, table: str, projection: str = "*", where: str | None = None, group_by: str | None = None, order_by: str | None = None, limit: int | None = None) -> DataFrame:
        clauses = [f"SELECT {projection} FROM {table}", f"WHERE {where}" if where else "", f"GROUP BY {group_by}" if group_by else "", f"ORDER BY {order_by}" if order_by else "", f"LIMIT {limit}" if limit is not None else ""]
        self._known(table)
        return self._select(" ".join(c for c in clauses if c), ())

    def create_table(self, name: str, columns: list[Column]) -> None:
        if not self.open:
            raise QuarryError("the transaction has ended")
        if name.lower() in {n.lower() for n in self.tables}:
            raise ConstraintError(f"table {name} exists")
        self.tables[name] = {"columns": [c.to_dict() for c in columns], "indexes": [], "files": [], "row_count": 0, "next_row": 0}
        self.changes.append({"table": name, "operation": "create"})

    def create_index(self, table: str, column: str) -> None:
        """Remembers a column by which new files are sorted, so that scans for its values skip most of them. Files that are there are sorted by the next compaction."""
        if column not in [c.name for c in self.columns(table)]:
            raise ConstraintError(f"{table} has no column {column}")
        table = self.name(table)
        t = self.tables[table]
        self.tables[table] = t | {"indexes": t["indexes"] if column in t["indexes"] else [*t["indexes"], column]}
        self.changes.append({"table": table, "operation": "index", "column": column})

    def insert(self, table: str, row: dict[str, Any]) -> dict[str, Any]:
        return self.insert_many(table, list(row), [list(row.values())])

    def insert_many(self, table: str, columns: list[str] | None, values: Iterable[Sequence[Any]] | DataFrame) -> dict[str, Any]:
        """Rows of plain values, or a DataFrame of typed columns. All of them go in, or none."""
        table = self.name(table)
        t, known = self.tables[table], self.columns(table)
        names = columns or (values.columns if isinstance(values, DataFrame) else [c.name for c in known])
        unknown = {*names} - {c.name for c in known}
        if unknown:
            raise ConstraintError(f"{table} has no column {', '.join(sorted(unknown))}")
        if isinstance(values, DataFrame):
            new, given = values.select([F.col(f"`{c.name}`").cast(c.spark).alias(c.name) if c.name in names else F.lit(None).cast(c.spark).alias(c.name) for c in known]), None
        else:
            values = [list(v) for v in values]
            if any(len(v) != len(names) for v in values):
                raise ParseError(f"{len(names)} columns need as many values in each row")
            if not values:
                return {"status": "inserted", "count": 0, "rows": 0}
            # in the order given; many rows are split among tasks by their number
            given_texts = [pa.array([st.as_text(v[i]) for v in values], pa.string()) for i in range(len(names))]
            texts = self.spark.createDataFrame(pa.table([*given_texts, pa.array(range(len(values)), pa.int64())], names=[*names, "__nth"])).coalesce(max(1, len(values) // LITERAL_ROWS))
            typed = [c.from_text().alias(c.name) if c.name in names else F.lit(None).cast(c.spark).alias(c.name) for c in known]
            given = {c.name: f"__given_{c.name}" for c in known if c.name in names and c.family != "string"}
            new = texts.select(*typed, "__nth", *[F.col(f"`{n}`").alias(g) for n, g in given.items()])
        told = Observation()
        numbered = new.withColumn("__problem", problem_of(known, given)).withColumn(ROW_ID, (F.monotonically_increasing_id() if given is None else F.col("__nth")) + F.lit(t["next_row"]))
        # one job writes and measures; whatever is wrong then leaves a folder that no version names
        folder = self.store.write(table, numbered.observe(told, *measures(known)).select([*[f"`{c.name}`" for c in known], ROW_ID]), t["indexes"])
        added = told.get
        if added["problem"] is not None:
            raise ConstraintError(added["problem"])
        dimensions = agreed_sizes(t.get("dimensions", {}), added, known)
        check_keys(self.store.read(t | {"files": [folder]}), self.store.read(t) if t["files"] else None, known)
        self.tables[table] = t | {"files": [*t["files"], folder], "sizes": t.get("sizes", {}) | {folder: added["n"]}, "dimensions": dimensions, "row_count": t["row_count"] + added["n"], "next_row": (added["last"] if added["last"] is not None else t["next_row"] - 1) + 1}
        self.changes.append({"table": table, "operation": "insert", "count": added["n"]})
        return {"status": "inserted", "count": added["n"], "rows": added["n"]}

    def _hit(self, table: str, where: str | None) -> dict[str, int]:
        """How many rows a condition finds in each folder of a table: one job, one row for each folder."""
        t, df = self.tables[table], self.frame(table, True)
        folder = F.regexp_extract(F.input_file_name(), r"/([0-9a-f]{32})/[^/]*$", 1).alias("folder")
        try:
            found = df.filter(F.coalesce(F.expr(where), F.lit(False))) if where else df
            by_name = {r["folder"]: r["n"] for r in found.select(folder).groupBy("folder").agg(F.count("*").alias("n")).collect()}
        except PySparkException as e:
            raise ParseError(_short(e)) from e
        return {f: by_name[f.rpartition("/")[2]] for f in t["files"] if f.rpartition("/")[2] in by_name}

    def _rewrite(self, table: str, hit: dict[str, int], after: DataFrame | None, operation: str) -> dict[str, Any]:
        """Puts ``after`` in place of the folders that were hit; the others stay as they are. None: no row is left of these."""
        t, count = self.tables[table], sum(hit.values())
        if count:
            kept = [f for f in t["files"] if f not in hit]
            new = [self.store.write(table, after, t["indexes"])] if after is not None else []
            gone, sizes = count if operation == "delete" else 0, t.get("sizes", {})
            held = sum(sizes.get(f, 0) for f in hit) - gone
            self.tables[table] = t | {"files": kept + new, "sizes": {f: sizes[f] for f in kept if f in sizes} | dict.fromkeys(new, held), "row_count": t["row_count"] - gone}
        self.changes.append({"table": table, "operation": operation, "count": count})
        return {"status": {"update": "updated", "delete": "deleted"}[operation], "count": count}

    def _condition(self, table: str, where: str | None) -> str | None:
        return st.typed_calls(where, st.Families([(table.lower(), self.columns(table))])) if where else None

    def update(self, table: str, assignments: dict[str, str], where: str | None = None) -> dict[str, Any]:
        """Assignments all see the row as it was."""
        table, known = self.name(table), {c.name: c for c in self.columns(table)}
        unknown = {*assignments} - {*known}
        if unknown:
            raise ConstraintError(f"{table} has no column {', '.join(sorted(unknown))}")
        t, where = self.tables[table], self._condition(table, where)
        wrapped = {n: {"json": f"parse_json({e})", "vector": f"from_json({e}, 'array<double>')"}.get(known[n].family, e) if st.tokens(e)[0].kind == "text" and len(st.tokens(e)) == 1 else e for n, e in assignments.items()}
        changed = [c for c in known.values() if c.name in assignments]
        try:
            hit = self._hit(table, where)
            after = after_update(self.store.read(t | {"files": list(hit)}), wrapped, where)
            if hit:
                check_rows(after, changed)
                if any(c.primary_key or c.family in ("vector", "document") for c in changed):
                    rest = [f for f in t["files"] if f not in hit]
                    check_table(after.unionByName(self.store.read(t | {"files": rest})) if rest else after, changed)
            return self._rewrite(table, hit, after, "update")
        except PySparkException as e:
            raise ParseError(_short(e)) from e

    def delete(self, table: str, where: str | None = None) -> dict[str, Any]:
        """Without a condition, or where all rows of a folder go, nothing is written."""
        table = self.name(table)
        t, where = self.tables[table], self._condition(table, where)
        hit = self._hit(table, where)
        emptied = all(n == t.get("sizes", {}).get(f) for f, n in hit.items())
        left = None if emptied or not where else after_delete(self.store.read(t | {"files": list(hit)}), where)
        return self._rewrite(table, hit, left, "delete")

    def commit(self) -> int:
        if not self.open:
            raise QuarryError("the transaction has ended")
        self.open = False
        return self.store.publish(self.base, self.tables, self.changes)["version"] if self.changes else self.base["version"]

    def rollback(self) -> None:
        """Folders that were written stay unnamed until the next compaction."""
        self.open = False


class Prepared:
    """A statement with ``?`` parameters."""

    def __init__(self, session: Session, sql: str):
        self.session, self.sql, self.arity = session, sql, arity(sql)
        self.insert = self._insert() if st.tokens(sql)[0].word == "INSERT" else None

    def _insert(self) -> tuple[str, list[str] | None, list[Any]]:
        slot = f"__slot_{uuid.uuid4().hex}"
        text = st._edit(self.sql, [(t.start, t.start + 1, slot) for t in st.tokens(self.sql) if t.text == "?" and t.kind == "mark"])
        parsed = st.parse(text)
        if len(parsed.rows) != 1:
            raise ParseError("a prepared INSERT has one row of VALUES")
        return parsed.table, parsed.columns, [... if v == slot else v for v in parsed.rows[0]]

    def execute(self, params: Sequence[Any] = ()) -> DataFrame | dict[str, Any]:
        if len(params) != self.arity:
            raise ParseError(f"the statement takes {self.arity} parameters, not {len(params)}")
        return self.executemany([params]) if self.insert else self.session.execute(self.sql, params)

    def executemany(self, many: Iterable[Sequence[Any]]) -> list[DataFrame | dict[str, Any]] | dict[str, Any]:
        """An INSERT puts all rows in at once; any other statement runs once for each."""
        many = [list(p) for p in many]
        if any(len(p) != self.arity for p in many):
            raise ParseError(f"the statement takes {self.arity} parameters")
        if not self.insert:
            return [self.session.execute(self.sql, p) for p in many]
        table, columns, template = self.insert
        return self.session.bulk_insert(table, columns, [_filled(template, p) for p in many])

    def explain(self, params: Sequence[Any] | None = None) -> str:
        df = self.session.begin().run(st.Select(self.sql), params if params is not None else [0] * self.arity)
        return df._jdf.queryExecution().toString()


def _filled(template: list[Any], params: Sequence[Any]) -> list[Any]:
    given = iter(params)
    return [next(given) if v is ... else v for v in template]


def _short(e: Exception) -> str:
    return str(e).strip().split("\n")[0][:500]
