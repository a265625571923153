"""Sessions, table reads and the shared scratch folder."""

from __future__ import annotations

import contextlib
import os
import tempfile
import threading
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"
CLEAN_KEY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_writing, _writers = threading.Lock(), [0, "false"]
_own_folders: dict[str, str] = {}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("parchmill")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder, through Spark's reader only, so any file system that Spark knows will do."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that all executors share: the one the session names, else (tests, one machine) a temporary one. On a
    cluster a session without one is an error, for executors do not see each other's temporary folders."""
    shared = spark.conf.get(CHECKPOINT_KEY, None)
    if not shared:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that all executors share")
        shared = _own_folders.setdefault(spark.sparkContext.applicationId, "")
        if not shared:
            shared = _own_folders[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="parchmill-")
    return shared.rstrip("/")


def scratch_path(spark: SparkSession, what: str) -> str:
    """A fresh path inside the shared folder."""
    return f"{scratch_dir(spark)}/{what}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def _shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """The setting is the session's; the first of several threads sets it and the last one restores it."""
    with _writing:
        if not _writers[0]:
            _writers[1] = spark.conf.get(CLEAN_KEY, "false")
            spark.conf.set(CLEAN_KEY, "true")
        _writers[0] += 1
    try:
        yield
    finally:
        with _writing:
            _writers[0] -= 1
            if not _writers[0]:
                spark.conf.set(CLEAN_KEY, _writers[1])


def settled(df: DataFrame, what: str = "step") -> DataFrame:
    """Write the rows to the shared folder and read them back. This cuts the lineage, so a lost executor costs
    a reread and never a recomputation, and later steps see the same rows each time they look. What the write
    shuffled is of no more use then, and Spark is told to drop it at once."""
    spark = df.sparkSession
    path = scratch_path(spark, what)
    with _shuffles_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete settled tables that no later step reads."""
    for t in tables:
        path = getattr(t, "_settled_at", None)
        if path:
            spark = t.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public vocabulary file lies on this machine."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)
