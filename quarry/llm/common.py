"""What the operators share: the folder for intermediate tables and column helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a session on one machine (master ``local``, as in tests) may name none: it then uses a temporary folder. Anywhere else that
    folder would be another one on each machine, so a ValueError says what is missing."""
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named and not (conf.get("spark.master") or "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return named or os.path.join(tempfile.gettempdir(), "quarry-shared")


def ship(spark: SparkSession) -> None:
    """Lets Python workers import this package wherever they run: its sources go along once for each Spark context."""
    context = spark.sparkContext
    if not getattr(context, "_quarry_shipped", False):
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        path = os.path.join(folder := tempfile.mkdtemp(prefix="quarry-"), "quarry-sources.zip")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        with zipfile.ZipFile(path, "w") as z:
            for place, _, names in os.walk(root):
                for name in names:
                    if name.endswith(".py"):
                        z.write(os.path.join(place, name), os.path.relpath(os.path.join(place, name), os.path.dirname(root)))
        context.addPyFile(path)
        context._quarry_shipped = True


class Scratch:
    """Intermediate tables of one operator call, written as Parquet under :func:`shared_dir`.

    A written table cuts the lineage: losing an executor never re-runs what stands before it. Results read them, so they stay
    until the application ends, and then go."""

    def __init__(self, spark: SparkSession, name: str):
        ship(spark)
        self.spark = spark
        self.root = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

        path, files = self._hadoop(self.root)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _hadoop(self, path: str) -> tuple:
        """The path and its file system, as Hadoop knows them."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Writes ``df`` and returns the written table."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, name: str) -> None:
        """Deletes a table that no later plan reads."""
        path, files = self._hadoop(self.path(name))
        files.delete(path, True)


#: Bytes of input for each partition of a shuffle.
PARTITION_BYTES = 64 << 20


def _partitions(df: DataFrame) -> list[int]:
    """How many partitions a shuffle of ``df`` takes where the tables that it reads need more than the session's number; else none, and adaptive execution may take fewer.

    The tables' own sizes count: what a plan expects of a join is its sides' product."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    n = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) // PARTITION_BYTES
    return [n] if int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) < n < 1 << 24 else []  # beyond it a size is not known


def by_range(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.repartitionByRange(*_partitions(df), *keys)


def by_hash(df: DataFrame, *keys: str | Column) -> DataFrame:
    return df.repartition(*_partitions(df), *keys)


#: Rows of a few numbers that are sent to every task at most: some tens of megabytes.
SENT_ROWS = 1 << 20


def sent(small: DataFrame, rows: int) -> DataFrame:
    """``small``, to be sent to every task if it has few enough ``rows``; else it is joined by a shuffle."""
    return F.broadcast(small) if rows <= SENT_ROWS else small


class Recent(dict):
    """Key -> ``make(key)``, kept. Two generations of ``limit`` entries bound it; what is used stays."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
