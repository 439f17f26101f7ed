"""Table functions for SQL users, registered in a session by name."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


@udtf(returnType="pos int, tag int, value binary")
class TlvEntries:
    """Entries of a list of one-byte tags and one-byte lengths: SELECT ... FROM t, LATERAL tlv_entries(t.payload). A list that ends within an entry ends before it."""

    def eval(self, data: bytes):
        at, pos = 0, 0
        while data is not None and at + 2 <= len(data) and at + 2 + data[at + 1] <= len(data):
            yield pos, data[at], bytes(data[at + 2 : at + 2 + data[at + 1]])
            at, pos = at + 2 + data[at + 1], pos + 1


def register(spark: SparkSession) -> None:
    spark.udtf.register("tlv_entries", TlvEntries)
