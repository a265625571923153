"""Mailboxes that are walked newest first, a bounded stretch a poll: a streaming data source with offsets and budgets of its own.

A listing is a folder of Parquet files below the shared folder, a part a mailbox, each message at its position from the newest. A
poll goes on where the mailbox's cursor stands and walks until it has met `limit` new messages, looked at five times as many
(or a hundred more) that the ledger does not know, paged past ten times as many, is told to slow down, or nothing is left.
The driver plans a poll from the kinds of the messages it may reach, a number that the budgets bound; tasks read them.

The source's offset is a position a mailbox. A poll's writer moves the cursor after its rows are written and before Spark notes the
batch as done, so a poll that is run again walks the same messages, and none is left out."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from parchmill.operators.retention import running
from parchmill.streaming.ledger import append, drain

#: What is known of a message before it is walked: in the ledger, looked at without new work, new work, or new work that the server
#: refuses to give out in the middle of a poll.
KNOWN, SEEN, NEW, LIMITED = KINDS = ("known", "seen", "new", "limited")
SCHEMA = "mailbox string, owner string, position long, id long, kind string"


def budgets(limit: int) -> tuple[int, int, int]:
    """(new messages, messages looked at, messages paged) of a poll."""
    looked = max(5 * limit, limit + 100)
    return limit, looked, max(10 * looked, 500)


def walked(kinds: Iterable[str], limit: int) -> int:
    """How many messages of a stretch a poll walks. A refusal ends it before that message, unless it comes first."""
    most_new, most_looked, most_paged = budgets(limit)
    new = looked = paged = 0
    for kind in kinds:
        if new >= most_new or looked >= most_looked or paged >= most_paged or (kind == LIMITED and paged):
            break
        paged += 1
        looked += kind != KNOWN
        new += kind in (NEW, LIMITED)
    return paged


def walk(listing: DataFrame, limit: int, owner: str = "owner", position: str = "position", kind: str = "kind") -> DataFrame:
    """The same by windows: the messages that a poll walks in each mailbox. Positions count from 0. No more than a poll may page
    are kept of a mailbox before they are put in order."""
    most_new, most_looked, most_paged = budgets(limit)
    before = Window.partitionBy(owner).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    count = lambda c: F.coalesce(F.sum(c.cast("int")).over(before), F.lit(0))
    k = F.col(kind)
    near = listing.withColumn("_k", F.row_number().over(Window.partitionBy(owner).orderBy(position))).where(F.col("_k") <= most_paged)
    ahead = near.withColumn("_new", count(k.isin(NEW, LIMITED))).withColumn("_looked", count(k != KNOWN))
    # A refusal that is not the first message shuts the door for itself and all behind it.
    shut = F.max(((k == LIMITED) & (F.col("_k") > 1)).cast("int")).over(before.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ahead.withColumn("_shut", shut).where((F.col("_new") < most_new) & (F.col("_looked") < most_looked) & (F.col("_shut") == 0)).drop("_k", "_new", "_looked", "_shut")


def write_listing(messages: DataFrame, path: str, owner: str, ident: str, order: list[str], kind: Column) -> None:
    """messages as mailboxes. order: columns that put an owner's messages in order, oldest first; ids are whole numbers."""
    ranked = running(messages.select(F.coalesce(F.col(owner).cast("string"), F.lit("")).alias("owner"), F.col(ident).cast("long").alias("id"), kind.alias("kind"), *[F.col(c).alias(f"_o{k}") for k, c in enumerate(order)], F.lit(1).alias("_one")), "owner", [f"_o{k}" for k in range(len(order))], "_one")
    rows = ranked.select(F.substring(F.sha1("owner"), 1, 16).alias("mailbox"), "owner", (F.col("_rank") - 1).alias("position"), "id", "kind")
    rows.sortWithinPartitions("mailbox", "position").write.partitionBy("mailbox").parquet(path)


def _files(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def read_cursor(path: str) -> dict[str, int]:
    files, base = _files(path)
    try:
        with files.open_input_file(base) as f:
            return json.loads(f.read())
    except FileNotFoundError:
        return {}


def write_cursor(path: str, positions: dict[str, int]) -> None:
    """The cursor only moves on; it is replaced as a whole."""
    files, base = _files(path)
    files.create_dir(base.rpartition("/")[0], recursive=True)
    old, part = read_cursor(path), f"{base}.{uuid.uuid4().hex}"
    with files.open_output_stream(part) as f:
        f.write(json.dumps({m: max(old.get(m, 0), positions.get(m, 0)) for m in {*old, *positions}}).encode())
    files.move(part, base)


@dataclass
class Stretch(InputPartition):
    mailbox: str
    start: int
    end: int


class PagedScan(DataSource):
    """`format("paged_scan")` with the options path, cursor and limit."""

    @classmethod
    def name(cls) -> str:
        return "paged_scan"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return PagedReader(self.options["path"], self.options["cursor"], int(self.options["limit"]))


class PagedReader(DataSourceStreamReader):
    def __init__(self, path: str, cursor: str, limit: int):
        self.path, self.cursor, self.limit = path.rstrip("/"), cursor, limit
        self.planned: dict[str, int] = {}

    def _mailboxes(self) -> list[str]:
        from pyarrow import fs

        files, base = _files(self.path)
        found = files.get_file_info(fs.FileSelector(base))
        return sorted(x.base_name.removeprefix("mailbox=") for x in found if x.base_name.startswith("mailbox="))

    def _rows(self, mailbox: str, start: int, end: int, columns: list[str]):
        import pyarrow.dataset as ds

        files, base = _files(self.path)
        at = ds.field("position")
        return ds.dataset(f"{base}/mailbox={mailbox}", filesystem=files, format="parquet").to_table(columns=columns, filter=(at >= start) & (at < end)).sort_by("position")

    def initialOffset(self) -> dict:
        return read_cursor(self.cursor)

    def latestOffset(self) -> dict:
        at = read_cursor(self.cursor)
        for m in self._mailboxes():
            start = max(at.get(m, 0), self.planned.get(m, 0))
            kinds = self._rows(m, start, start + budgets(self.limit)[2], ["position", "kind"]).column("kind").to_pylist()
            self.planned[m] = start + walked(kinds, self.limit)
        return dict(self.planned)

    def partitions(self, start: dict, end: dict) -> list[Stretch]:
        return [Stretch(m, start.get(m, 0), end[m]) for m in end if end[m] > start.get(m, 0)]

    def read(self, partition: Stretch) -> Iterator:
        rows = self._rows(partition.mailbox, partition.start, partition.end, ["owner", "position", "id", "kind"])
        for row in rows.to_pylist():
            yield partition.mailbox, row["owner"], row["position"], row["id"], row["kind"]


def poll(spark: SparkSession, listing: str, table: str, cursor: str, limit: int, checkpoint: str | None = None, then: Callable[[DataFrame], DataFrame] = lambda batch: batch) -> None:
    """One poll of all mailboxes into `table`: what `then` makes of its messages."""
    spark.dataSource.register(PagedScan)
    stream = spark.readStream.format("paged_scan").option("path", listing).option("cursor", cursor).option("limit", limit).load()
    keep = append(table)

    def write(batch: DataFrame, number: int, name: str) -> None:
        keep(then(batch), number, name)
        write_cursor(cursor, {r["mailbox"]: r["n"] for r in batch.groupBy("mailbox").agg((F.max("position") + 1).alias("n")).collect()})  # a row a mailbox

    drain(stream, write, checkpoint)
