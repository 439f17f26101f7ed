"""What several operators share: tables, lineage cuts, size-checked joins."""

from __future__ import annotations

import ctypes
import ctypes.util
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a dimension (at most a few hundred bytes a row) is broadcast.
BROADCAST_ROWS = 50_000
#: ASCII white space, as the contracts of the word-based operators have it.
BLANKS = "\t\n\x0b\x0c\r "


#: Most bytes of one Arrow batch between Spark and Python, so that a batch of long texts stays small.
BATCH_BYTES = "2m"
#: Folders written by table() that are still there, by application.
WRITTEN: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; one of our own only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        if not named and not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="muxlake-"))
    return named or sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder as it is partitioned and sorted, and goes on from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Row groups of some 16 MB, whatever the number of rows: readers hold the rows of a whole one at once, up to 4096.
FEW_ROWS = {"parquet.block.size": 16 << 20, "parquet.block.size.row.check.min": 1, "parquet.block.size.row.check.max": 1, "parquet.page.size.row.check.min": 1}


def table(df: DataFrame, options: dict | None = None) -> DataFrame:
    """The same as compressed Parquet, for wide rows; partitions may be dealt anew when it is read."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    WRITTEN.setdefault(df.sparkSession.sparkContext.applicationId, []).append(path)
    df.write.options(compression="zstd", **options or {}).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, but: list[str] = ()) -> None:
    """Deletes what table() has written in this application, for callers that have written their result; `but` stays."""
    found = WRITTEN.get(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in [x for x in found if x not in but]:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
        found.remove(path)


def bound_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released(run):
    """A mapInArrow function that gives its memory back to the system at its end, as workers live on for further tasks."""

    def inner(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        libc = ctypes.util.find_library("c")
        if libc and hasattr(c := ctypes.CDLL(libc), "malloc_trim"):
            c.malloc_trim(0)

    return inner


def texts(column: pa.Array) -> list[str | None]:
    """Texts of an Arrow column; ill-formed UTF-8, which a Spark string may hold, is read with replacement characters."""
    try:
        return column.to_pylist()
    except UnicodeDecodeError:
        return [None if x is None else x.decode("utf-8", "replace") for x in column.cast(pa.binary()).to_pylist()]


def join_small(df: DataFrame, dim: DataFrame, on, how: str = "left", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a cut dimension: broadcast if it is counted to be small, else left to the planner and its skew handling."""
    small = dim.limit(rows + 1).count() <= rows
    return df.join(F.broadcast(dim) if small else dim, on, how)


def free_name(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name
