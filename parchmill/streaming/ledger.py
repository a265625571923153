"""Streams into tables on a shared folder, each message exactly once.

A table is a folder with one part for each stream and batch. A batch is written over its own part and reads only the parts of
other batches, so a batch that is run again after a lost driver gives the same table, and the checkpoint need not be written
together with it. Batches of one stream run one after the other, and a table has one stream at a time that writes it; a
later stream, which counts its batches from 0 again, has parts of its own. A stream is known by its checkpoint."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from parchmill.operators.intake import unprocessed
from parchmill.operators.retention import pruned
from parchmill.session import scratch_path

#: Buckets by the hash of the keys. A batch reads those of its own keys only.
BUCKETS = 16
PARTS = "stream string, batch long, bucket int"


def part(table: str, stream: str, batch: int) -> str:
    return f"{table}/stream={stream}/batch={batch}"


def stream_name(checkpoint: str) -> str:
    return hashlib.sha1(checkpoint.encode()).hexdigest()[:16]


def _exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return files.exists(folder) and len(files.listStatus(folder)) > 0


def read_parts(spark: SparkSession, table: str, schema: str) -> DataFrame:
    """The rows of all parts with their stream, batch and bucket; no rows if nothing is written yet."""
    if not _exists(spark, table):
        return spark.createDataFrame([], f"{schema}, {PARTS}")
    return spark.read.schema(f"{schema}, {PARTS}").option("basePath", table).parquet(table)


def read_ledger(spark: SparkSession, table: str, schema: str) -> DataFrame:
    return read_parts(spark, table, schema).drop("stream", "batch", "bucket")


def bucket(keys: list[str]) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(BUCKETS)).cast("int")


def once(table: str, keys: list[str], schema: str) -> Callable[[DataFrame, int, str], None]:
    """A batch writer: the messages that no other batch brought, each once. Of the ledger it reads the buckets of its keys."""

    def write(batch: DataFrame, number: int, stream: str = "0") -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", bucket(keys))
        touched = [r[0] for r in rows.select("bucket").distinct().collect()]  # at most BUCKETS
        known = read_parts(spark, table, schema).where(F.col("bucket").isin(touched) & ~((F.col("stream") == stream) & (F.col("batch") == number)))
        unprocessed(rows, known.select(*keys), keys).write.mode("overwrite").partitionBy("bucket").parquet(part(table, stream, number))

    return write


def append(table: str) -> Callable[[DataFrame, int, str], None]:
    """A batch writer that adds rows and never changes those there are."""
    return lambda batch, number, stream="0": batch.withColumn("bucket", F.lit(0)).write.mode("overwrite").partitionBy("bucket").parquet(part(table, stream, number))


def drain(stream: DataFrame, write: Callable[[DataFrame, int, str], None], checkpoint: str | None = None) -> None:
    """Run a stream over all that is there now, and wait for its end. The same checkpoint goes on where it stopped; without
    one this is a stream of its own."""
    where = checkpoint or scratch_path(stream.sparkSession, "stream")
    name = stream_name(where)
    stream.writeStream.foreachBatch(lambda batch, number: write(batch, number, name)).option("checkpointLocation", where).trigger(availableNow=True).start().awaitTermination()


def insert(store: DataFrame, batch: DataFrame, key: str, owner: str, order: list[str], status: str, keep_status: list[str], most: int) -> DataFrame:
    """The store after a batch, with `removed`: rows whose key it lacks come in (the first of equal keys by `order`), then each owner
    above `most` rows loses its oldest closed ones, as many as it is over; new rows and those of a protected status stay
    even if that leaves it above. Equal columns on both sides."""
    first = batch.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where("_r = 1").drop("_r")
    new = first.join(store.select(key), key, "left_anti").select(*store.columns).withColumn("_new", F.lit(True))
    rows = store.withColumn("_new", F.lit(False)).unionByName(new)
    closed = ~F.col("_new") & ~F.coalesce(F.col(status).isin(*keep_status), F.lit(False))
    gone = pruned(rows, owner, closed, order, most).select(key, F.lit(True).alias("removed"))
    return rows.join(gone, key, "left").select(*store.columns, F.coalesce("removed", F.lit(False)).alias("removed"))


class Store:
    """A table that batches go into by `insert`, one unit each: rows that retention removes are in the archive, and the others in
    the table, as soon as the batch's commit is there, and neither before. Owners are dealt out to buckets; a batch writes a new
    version of the buckets of its own owners only, and the latest committed version of each bucket is the table."""

    def __init__(self, path: str, schema: str, key: str, owner: str, order: list[str], status: str, keep_status: list[str], most: int):
        self.path, self.schema, self.owner, self.rules = path, schema, owner, (key, owner, order, status, keep_status, most)

    def _read(self, spark: SparkSession, what: str, version: int | None) -> DataFrame:
        """Committed rows, of versions before `version` if it is given."""
        if not _exists(spark, f"{self.path}/commits") or not _exists(spark, f"{self.path}/{what}"):
            return spark.createDataFrame([], f"{self.schema}, version long, bucket int")
        commits = spark.read.schema("bucket int, version long").option("basePath", f"{self.path}/commits").parquet(f"{self.path}/commits")
        if version is not None:
            commits = commits.where(F.col("version") < version)
        if what == "rows":
            commits = commits.groupBy("bucket").agg(F.max("version").alias("version"))
        rows = spark.read.schema(f"{self.schema}, version long, bucket int").option("basePath", f"{self.path}/{what}").parquet(f"{self.path}/{what}")
        return rows.join(F.broadcast(commits), ["version", "bucket"], "left_semi")  # a row a bucket and version

    def rows(self, spark: SparkSession, version: int | None = None) -> DataFrame:
        return self._read(spark, "rows", version).drop("version", "bucket")

    def archive(self, spark: SparkSession) -> DataFrame:
        return self._read(spark, "archive", None).drop("version", "bucket")

    def put(self, batch: DataFrame, number: int, stream: str = "0") -> None:
        """A batch writer. A number that was there before is written again from the versions before it."""
        spark = batch.sparkSession
        batch = batch.withColumn("bucket", bucket([self.owner]))
        touched = [r[0] for r in batch.select("bucket").distinct().collect()]  # at most BUCKETS
        before = self.rows(spark, number).withColumn("bucket", bucket([self.owner])).where(F.col("bucket").isin(touched))
        after = insert(before, batch, *self.rules)
        for what, chosen in (("archive", "removed"), ("rows", "not removed")):
            after.where(chosen).drop("removed").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{what}/version={number}")
        spark.createDataFrame([(b,) for b in touched], "bucket int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/commits/version={number}")
