"""Reports, exports and segmented recording."""

from __future__ import annotations

import json
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions.text import file_name


def report(frames: DataFrame, figs: DataFrame, errors: DataFrame) -> DataFrame:
    """(stream_id, report): a JSON text a stream with its sections."""
    a = frames.groupBy("stream_id").agg(F.struct(F.count("*").alias("total_frames"), F.count_if("valid").alias("valid_frames"), (F.count("*") * 24).alias("duration_ms")).alias("stream"))
    b = figs.groupBy("stream_id").agg(F.struct(F.count("*").alias("figs"), F.count_if(~F.col("crc_ok")).alias("crc_failures")).alias("fic"))
    c = errors.groupBy("stream_id").agg(F.struct(F.count("*").alias("n"), F.count_if(F.col("severity") == "critical").alias("critical")).alias("errors"))
    both = a.join(b, "stream_id", "full_outer").join(c, "stream_id", "full_outer")
    return both.select("stream_id", F.to_json(F.struct("stream", "fic", "errors")).alias("report"))


#: Points off for each violation, in hundredths of a percent.
PENALTIES = {"critical": 1500, "error": 500, "warning": 100, "info": 10}


def _list(df: DataFrame, name: str, *columns: str) -> DataFrame:
    """(stream_id, name): the rows of each stream as a list of structs, in order of the columns."""
    return df.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias(name))


def report_tree(frames: DataFrame, ensembles: DataFrame, services: DataFrame, subchannels: DataFrame, figs: DataFrame, violations: DataFrame, units: int = 864) -> DataFrame:
    """(stream_id, report): the whole report of each stream as one struct of nine sections.

    frames: stream_id, valid, dropped, errored, latency. ensembles: stream_id, eid, label.
    services: stream_id, sid, label, kind, status. subchannels: stream_id, sub_channel_id,
    start_address, size. figs: stream_id, fig_type, ext, crc_ok. violations: stream_id,
    rule_id, severity. Each section is an aggregate of its own, so a stream that a table
    lacks has that section empty; lists are as long as a multiplex is. Shares are in
    hundredths of a percent.
    """
    c, share = F.col, lambda x, n: F.when(n > 0, F.floor(x * 10_000 / n)).otherwise(F.lit(0)).cast("long")
    n, valid = F.count("*"), F.count_if("valid")
    stream = frames.groupBy("stream_id").agg(F.struct(n.alias("total_frames"), valid.alias("valid_frames"), (n - valid).alias("error_frames"), (n * 24).alias("duration_ms"), share(valid, n).alias("success")).alias("stream"), F.struct(F.count_if("dropped").alias("dropped"), F.count_if("errored").alias("errored"), F.floor(F.max("latency") * 1000).cast("long").alias("worst_latency_us")).alias("performance"))
    ensemble = ensembles.groupBy("stream_id").agg(F.min(F.struct("eid", "label")).alias("ensemble"))
    by = lambda col, x: F.count_if(c(col) == x)
    listed = services.withColumn("label", F.coalesce("label", F.lit("")))
    counted = services.groupBy("stream_id").agg(F.struct(F.count("*").alias("n"), by("kind", "audio").alias("audio"), by("kind", "data").alias("data"), by("status", "active").alias("active")).alias("counts"))
    capacity = subchannels.groupBy("stream_id").agg(F.struct(F.sum("size").alias("used_units"), (units - F.sum("size")).alias("free_units"), share(F.sum("size"), F.lit(units)).alias("used")).alias("capacity"))
    kinds = figs.groupBy("stream_id", "fig_type", "ext").agg(F.count("*").alias("n"), F.count_if(~c("crc_ok")).alias("crc_failures"))
    fic = figs.groupBy("stream_id").agg(F.struct(n.alias("figs"), F.count_if(~c("crc_ok")).alias("crc_failures"), share(F.count_if("crc_ok"), n).alias("healthy")).alias("fic_health"), F.struct(F.count_if(c("fig_type") == 0).alias("type_0"), F.count_if(c("fig_type") == 1).alias("type_1"), F.count_if(c("fig_type") > 1).alias("others")).alias("fig_stats"))
    points = F.sum(F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PENALTIES.items() for x in kv]), c("severity")), F.lit(0)))
    rules = violations.groupBy("stream_id", "rule_id").agg(F.count("*").alias("n"))
    verdict = violations.groupBy("stream_id").agg(F.struct(n.alias("violations"), *(by("severity", k).alias(k) for k in PENALTIES), F.greatest(F.lit(0), 10_000 - points).cast("long").alias("score")).alias("verdict"))
    sections = [stream, ensemble, counted, capacity, fic, verdict, _list(listed, "services", "sid", "label", "kind", "status"), _list(subchannels, "subchannels", "sub_channel_id", "start_address", "size"), _list(kinds, "figs", "fig_type", "ext", "n", "crc_failures"), _list(rules, "rules", "rule_id", "n")]
    out = sections[0]
    for x in sections[1:]:
        out = out.join(x, "stream_id", "full_outer")
    with_ = lambda name, counts, items: F.struct(F.col(counts).alias("summary"), F.coalesce(items, F.array()).alias("items")).alias(name)
    return out.select("stream_id", F.struct("stream", "ensemble", with_("services", "counts", c("services")), with_("subchannels", "capacity", c("subchannels")), F.coalesce("figs", F.array()).alias("figs"), "fic_health", "fig_stats", F.struct(c("verdict").alias("summary"), F.coalesce("rules", F.array()).alias("rules")).alias("compliance"), "performance").alias("report"))


def yaml_scalar(x) -> str:
    """A number, truth value or null as it is; text plain where that reads back as the same text, else quoted with escapes."""
    if x is None:
        return "null"
    if isinstance(x, bool):
        return "true" if x else "false"
    if isinstance(x, (int, float)):
        return repr(x)
    plain = re.fullmatch(r"[A-Za-z_][A-Za-z0-9_./+ -]*", x) and x == x.strip() and x.lower() not in ("null", "true", "false", "yes", "no", "on", "off", "y", "n")
    return x if plain else json.dumps(x, ensure_ascii=False)


def render_yaml(value, indent: int = 0) -> str:
    """YAML of dicts, lists and scalars. Empty ones are {} and []."""
    pad = " " * indent
    if isinstance(value, dict):
        lines = [f"{pad}{yaml_scalar(str(k))}:" + (f" {_inline(v)}" if _flat(v) else "\n" + render_yaml(v, indent + 2)) for k, v in value.items()]
    elif isinstance(value, list):
        lines = [f"{pad}- {_inline(v)}" if _flat(v) else f"{pad}- " + render_yaml(v, indent + 2).lstrip(" ") for v in value]
    else:
        return pad + yaml_scalar(value)
    return "\n".join(lines)


def _flat(x) -> bool:
    return not isinstance(x, (dict, list)) or not x


def _inline(x) -> str:
    return "{}" if x == {} else "[]" if x == [] else yaml_scalar(x)


def as_yaml(report_: Column) -> Column:
    """YAML text of a report struct, a row at a time over Arrow batches."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([None if x is None else render_yaml(json.loads(x)) for x in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(F.to_json(report_, {"ignoreNullFields": "false"}))


def write_report(reports_: DataFrame, path: str, fmt: str) -> None:
    """Reports (stream_id, report) as json (an object a line) or yaml (a document a stream)."""
    if fmt == "json":
        reports_.write.option("ignoreNullFields", "false").json(path)
    elif fmt == "yaml":
        head = F.concat(F.lit("---\nstream_id: "), F.to_json(F.array("stream_id")).substr(F.lit(2), F.length(F.to_json(F.array("stream_id"))) - 2), F.lit("\n"))
        reports_.select(F.concat(head, as_yaml(F.col("report"))).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def export(df: DataFrame, path: str, fmt: str) -> None:
    """csv with a header, json, xml (row tag `row`) or html (one table a part file)."""
    if fmt == "csv":
        df.write.option("header", "true").csv(path)
    elif fmt == "json":
        df.write.json(path)
    elif fmt == "xml":
        df.write.option("rowTag", "row").xml(path)
    elif fmt == "html":
        cell = lambda c: F.concat(F.lit("<td>"), F.replace(F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("</td>"))
        df.select(F.concat(F.lit("<tr>"), *[cell(c) for c in df.columns], F.lit("</tr>")).alias("value")).write.text(path)
    else:
        raise ValueError(f"unknown format {fmt}")


def segments(frames: DataFrame) -> DataFrame:
    """frames with the hour of recording they belong to and its file name."""
    at = F.date_trunc("hour", F.col("ts")).cast("timestamp_ntz")
    return frames.withColumn("segment", at).withColumn("name", file_name(F.col("segment"), F.lit(0)))


def record_segments(frames: DataFrame, path: str, most_rows: int = 1_000_000) -> None:
    """Parquet by stream and hour, files of bounded rows."""
    segments(frames).write.mode("append").option("maxRecordsPerFile", most_rows).partitionBy("stream_id", "segment").parquet(path)


def expire_segments(frames: DataFrame, now, days: int = 7) -> DataFrame:
    """The segments still kept: a filter on the partition column, which prunes folders."""
    return frames.where(F.col("segment") >= F.lit(now) - F.expr(f"INTERVAL {days} DAYS"))
