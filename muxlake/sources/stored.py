"""Tables that are built once a session and kept as Parquet, for data that many queries derive alike."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Path by application and key.
STORED: dict[tuple, str] = {}


def folder(spark: SparkSession) -> str:
    """The folder that all executors see: spark.checkpoint.dir; a temporary one, deleted at exit, only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if ("folder", sc.applicationId) not in STORED:
        path = tempfile.mkdtemp(prefix="muxlake-stored-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        STORED["folder", sc.applicationId] = path
    return STORED["folder", sc.applicationId]


def stored(spark: SparkSession, key: tuple, build: Callable[[], DataFrame]) -> DataFrame:
    """What build() gives, written at the first call with the key and read from then on. The key has to name all that the data depend on."""
    at = (spark.sparkContext.applicationId, *key)
    if at not in STORED:
        path = f"{folder(spark)}/stored-{uuid.uuid4().hex}"
        build().write.parquet(path)
        STORED[at] = path
    return spark.read.parquet(STORED[at])
