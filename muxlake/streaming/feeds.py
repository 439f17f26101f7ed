"""Structured Streaming: sources, stateless and windowed operators, and stateful ones (T-family).

The windowed operators of operators/timing.py (bandwidth, sliding_metrics, outage_sessions,
error_rates, frame_loss, reconfig_rate) take streams as they are, after a watermark. Here
are the rest: the frame feed, deduplication, the join of redundant feeds. Operators
with state of their own are in streaming/state.py, the live catalogue in catalog_store.py.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.streaming.catalog_store import upsert_catalog  # noqa: F401
from muxlake.streaming.state import alert_stream, announcement_registry_stream, assemble_mot_stream, reassemble_pft_stream, reorder_stream, service_status_stream  # noqa: F401


def stream_frames(spark: SparkSession, path: str, split_bytes: int | None = None, pattern: str = "*") -> DataFrame:
    """A live feed of captures in a folder: (stream_id, ts, frame_no, raw), one row a whole record. Files may be of any size and may grow; each record comes once (sources/captures.py)."""
    from muxlake.sources import captures

    read = spark.readStream.format(captures.captures(spark)).option("splitBytes", str(split_bytes or captures.SPLIT_BYTES)).option("pattern", pattern)
    return read.load(path).select("stream_id", "ts", "frame_no", "raw")


def stream_rows(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    """Rows of Parquet files dropped into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def dedupe_stream(packets: DataFrame, keys: list[str], ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Drops repeats of a key within the watermark."""
    return packets.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def merge_redundant_stream(primary: DataFrame, backup: DataFrame, late: str = "1 minute") -> DataFrame:
    """Stream-stream full join of two feeds by sequence number: the primary's packet, or the backup's where it is missing."""
    p = primary.withWatermark("ts", late).select(F.col("stream_id").alias("p_id"), F.col("seq").alias("p_seq"), F.col("ts").alias("p_ts"), F.col("payload").alias("p"))
    b = backup.withWatermark("ts", late).select(F.col("stream_id").alias("b_id"), F.col("seq").alias("b_seq"), F.col("ts").alias("b_ts"), F.col("payload").alias("b"))
    near = F.expr(f"b_ts BETWEEN p_ts - INTERVAL {late} AND p_ts + INTERVAL {late}")
    j = p.join(b, (F.col("p_id") == F.col("b_id")) & (F.col("p_seq") == F.col("b_seq")) & near, "full_outer")
    return j.select(F.coalesce("p_id", "b_id").alias("stream_id"), F.coalesce("p_seq", "b_seq").alias("seq"), F.coalesce("p", "b").alias("payload"), F.when(F.col("p").isNotNull(), "primary").otherwise("backup").alias("used"))
