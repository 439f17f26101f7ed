"""Inventories, health, statistics and scores (A-family). DataFrame in, DataFrame out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions.times import micros
from muxlake.operators.scan import looking_back, running

FRAME_MS = 24
CAPACITY_CU = 864


def share(part: Column, whole: Column, scale: float = 100.0) -> Column:
    """scale * part / whole; 0 where whole is 0."""
    return F.when(whole > 0, scale * part / whole).otherwise(F.lit(0.0))


def clip(x: Column, low: float = 0.0, high: float = 100.0) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def fig_inventory(figs: DataFrame, *keys: str) -> DataFrame:
    """Per FIG type and extension: count, first and last frame, blocks from FIBs of bad CRC."""
    return figs.groupBy(*keys, "fig_type", "ext").agg(
        F.count("*").alias("n"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count_if(~F.col("crc_ok")).alias("crc_failures")
    )


def fig_type_counts(figs: DataFrame) -> DataFrame:
    """Counts by type and extension, by type, and in total (nulls)."""
    return figs.rollup("fig_type", "ext").agg(F.count("*").alias("n"))


def fic_health(fibs: DataFrame, figs: DataFrame) -> DataFrame:
    """Per stream: FIBs, FIBs of bad CRC, erroneous FIG areas."""
    crc = fibs.groupBy("stream_id").agg(F.count("*").alias("total_fibs"), F.count_if(~F.col("crc_ok")).alias("fib_crc_failures"))
    bad = figs.groupBy("stream_id").agg(F.count_if("erroneous").alias("erroneous_figs"))
    return crc.join(bad, "stream_id", "left").select("stream_id", "total_fibs", "fib_crc_failures", F.coalesce("erroneous_figs", F.lit(0)).alias("erroneous_figs"))


def figs_by_type(figs: DataFrame, first: int = 64) -> DataFrame:
    """Per type: count, the first frames (a window limit, no unbounded list), how many more."""
    frames = figs.select("fig_type", "ext", "frame_no").distinct()
    w = Window.partitionBy("fig_type", "ext").orderBy("frame_no")
    head = frames.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= first).groupBy("fig_type", "ext").agg(F.array_sort(F.collect_list("frame_no")).alias("frames"))
    n = figs.groupBy("fig_type", "ext").agg(F.count("*").alias("n"), F.count_distinct("frame_no").alias("n_frames"))
    return n.join(head, ["fig_type", "ext"]).withColumn("more", F.greatest(F.col("n_frames") - first, F.lit(0)))


def stream_stats(frames: DataFrame) -> DataFrame:
    """Per stream: total, valid and error frames, duration, success share. frames: stream_id, valid."""
    n, ok = F.count("*"), F.count_if("valid")
    return frames.groupBy("stream_id").agg(n.alias("total_frames"), ok.alias("valid_frames"), (n - ok).alias("error_frames"), (n * FRAME_MS).alias("duration_ms"), F.round(share(ok, n), 6).alias("success_rate"))


def ensemble_statistics(services: DataFrame) -> DataFrame:
    """Per ensemble: services by type and status, mean quality over rows that have it."""
    rated = F.col("signal") > 0
    return services.groupBy("stream_id").agg(
        F.count("*").alias("n_services"), F.count_if(F.col("kind") == "audio").alias("n_audio"), F.count_if(F.col("kind") == "data").alias("n_data"), F.count_if(F.col("status") == "active").alias("n_active"),
        F.round(F.avg(F.when(rated, F.col("signal"))), 6).alias("avg_signal"), F.round(F.avg(F.when(rated, F.col("error_rate"))), 6).alias("avg_error"),
    )


def violation_counts(violations: DataFrame, active_only: bool = False) -> DataFrame:
    """Counts by severity, by category and in all, from one scan."""
    v = violations.where("active") if active_only else violations
    return v.groupingSets([["severity"], ["category"], []], "severity", "category").agg(F.count("*").alias("n"))


def compliance_score_frames(frames: DataFrame) -> DataFrame:
    """Per stream: (passed - 10 critical - 2 warnings) / frames, in percent, clipped."""
    n = F.count("*")
    score = (F.count_if("passed") - 10 * F.sum("critical") - 2 * F.sum("warnings")) / n * 100
    return frames.groupBy("stream_id").agg(n.alias("n"), F.round(clip(score), 6).alias("score"))


def compliance_score_violations(violations: DataFrame) -> DataFrame:
    """100 less 20, 10, 3 and 0.5 for each critical, error, warning and info."""
    of = lambda s: F.count_if(F.col("severity") == s)
    score = 100 - 20 * of("critical") - 10 * of("error") - 3 * of("warning") - 0.5 * of("info")
    return violations.groupBy("stream_id").agg(F.count("*").alias("n"), F.round(clip(score), 6).alias("score"))


def compliance_score_eti(violations: DataFrame, legacy_floor: bool = False) -> DataFrame:
    """Light penalties and a bonus for checked frames; the floor of 92 hides failures and is off by default."""
    of = lambda s: F.count_if(F.col("severity") == s)
    score = 100 - 8 * of("critical") - 2 * of("error") - 0.3 * of("warning") - 0.05 * of("info") + 0.8 * F.count_if(F.col("severity") == "pass")
    return violations.groupBy("stream_id").agg(F.round(clip(score, 92.0 if legacy_floor else 0.0), 6).alias("score"))


def compliance_score_basic(headers: DataFrame) -> DataFrame:
    """Mean per-frame score: bad sync 25, frame count over 249 and sub-channels over 63 five each, mode 10."""
    off = lambda cond, x: F.when(cond, F.lit(x)).otherwise(F.lit(0))
    score = 100 - off(~F.col("sync_ok"), 25) - off(F.col("fc") > 249, 5) - off(F.col("nst") > 63, 5) - off(~F.col("mid").between(0, 3), 10)
    return headers.groupBy("stream_id").agg(F.round(F.avg(clip(score)), 6).alias("score"))


def health_score(errors: DataFrame, as_of: Column, minutes: int = 60) -> DataFrame:
    """Per stream over the last hour before as_of: 100 less 20, 10 and 5 for each critical, high and medium error."""
    recent = (F.col("ts") > as_of - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("ts") <= as_of)
    of = lambda s: F.count_if(recent & (F.col("severity") == s))
    return errors.groupBy("stream_id").agg(F.greatest(100 - 20 * of("critical") - 10 * of("high") - 5 * of("medium"), F.lit(0)).alias("health"))


def error_patterns(errors: DataFrame, least: int = 10, rate: float = 1.0) -> DataFrame:
    """Per category: count, first, last, errors a minute; critical where frequent and fast."""
    first, last, n = F.min("ts"), F.max("ts"), F.count("*")
    minutes = (micros(last) - micros(first)) / 60e6
    per_minute = F.when(minutes > 0, n / minutes).otherwise(n.cast("double"))
    return errors.groupBy("category").agg(n.alias("n"), first.alias("first_ts"), last.alias("last_ts"), F.round(per_minute, 6).alias("per_minute"), ((n >= least) & (per_minute > rate)).alias("critical"))


def error_report(errors: DataFrame, start: Column, end: Column) -> DataFrame:
    """Totals by severity and category within [start, end]."""
    return errors.where(F.col("ts").between(start, end)).groupBy("severity", "category").agg(F.count("*").alias("n"), F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"))


def alert_statistics(alerts: DataFrame) -> DataFrame:
    """By severity, by category and in all: total, active, acknowledged, resolved, last time."""
    return alerts.groupingSets([["severity"], ["category"], []], "severity", "category").agg(
        F.count("*").alias("total"), F.count_if("active").alias("active"), F.count_if("acknowledged").alias("acknowledged"), F.count_if("resolved").alias("resolved"), F.max("ts").alias("last_ts")
    )


def alert_priority(alerts: DataFrame) -> DataFrame:
    return alerts.withColumn("priority", F.col("severity") * 1000 + F.when(F.col("active"), 500).otherwise(0))


def operation_profile(spans: DataFrame) -> DataFrame:
    """Per operation: runs, total, least, greatest and mean duration."""
    d = F.col("duration")
    return spans.groupBy("operation").agg(F.count("*").alias("n"), F.round(F.sum(d), 4).alias("total"), F.min(d).alias("least"), F.max(d).alias("most"), F.round(F.avg(d), 6).alias("mean"))


def performance_score() -> Column:
    """10 less capped penalties on errors, memory_mb, cpu, throughput and latency_ms of a row."""
    part = lambda x, most: F.least(F.greatest(x, F.lit(0.0)), F.lit(most))
    return 10 - part(F.col("errors") * 0.1, 3.0) - part((F.col("memory_mb") - 100) / 100, 2.0) - part((F.col("cpu") - 50) / 25, 2.0) - part((900 - F.col("throughput")) / 300, 2.0) - part((F.col("latency_ms") - 1) / 10, 1.0)


def latency_percentiles(measurements: DataFrame, key: str = "metric") -> DataFrame:
    """Exact percentiles; at scale use approx=True of Spark's percentile_approx by the same names."""
    v = F.col("value")
    at = lambda p: F.round(F.percentile(v, F.lit(p)), 6)
    return measurements.groupBy(key).agg(at(0.5).alias("median"), at(0.95).alias("p95"), at(0.99).alias("p99"), F.min(v).alias("least"), F.max(v).alias("most"), F.round(F.avg(v), 6).alias("mean"), F.round(F.var_pop(v), 4).alias("variance"))


def fps_stability(measurements: DataFrame, key: str = "stream_id") -> DataFrame:
    return measurements.groupBy(key).agg(F.round(F.stddev_pop("value") / F.avg("value"), 6).alias("variation"))


def fig_carousel(figs: DataFrame, limit_ms: int = 100, span: float | None = None) -> DataFrame:
    """Repetition of each FIG in stream time: intervals in ms, share within the limit, efficiency."""
    gaps = looking_back(figs, ["stream_id", "fig_type", "ext"], "frame_no", 1, lambda w: {"gap": (F.col("frame_no") - F.lag("frame_no").over(w)) * FRAME_MS}, span)
    return gaps.groupBy("fig_type", "ext").agg(
        F.count("*").alias("n"), F.round(F.avg("gap"), 4).alias("avg_ms"), F.min("gap").alias("min_ms"), F.max("gap").alias("max_ms"),
        F.round(share(F.count_if(F.col("gap") < limit_ms), F.count("gap")), 6).alias("within"), F.round(100 - share(F.count_if(~F.col("crc_ok")), F.count("*")), 6).alias("efficiency"),
    )


def service_quality(services: DataFrame) -> DataFrame:
    """Per service the mean signal less errors, lowered where not compliant; the ensemble's mean beside it."""
    q = F.avg(F.col("signal") * (1 - F.col("error_rate")))
    q = q * F.when(F.bool_and("etsi_ok"), 1.0).otherwise(0.8) * F.when(F.bool_and("plan_ok"), 1.0).otherwise(0.9)
    out = services.groupBy("stream_id", "sid").agg(q.alias("quality"))
    return out.select("stream_id", "sid", F.round("quality", 6).alias("quality"), F.round(F.avg("quality").over(Window.partitionBy("stream_id")), 6).alias("ensemble_quality"))


def quality_score() -> Column:
    return 0.6 * F.col("signal") + 0.4 * (100 - F.col("error_rate"))


def discovery_progress(services: DataFrame) -> DataFrame:
    """0 to 100 per stream: 25 for an ensemble id, 25 for sub-channels, 40 by services up to 20, 10 by labels."""
    n = F.count("*")
    score = F.when(F.max("eid").isNotNull(), 25).otherwise(0) + F.when(F.max("sub_channel_id").isNotNull(), 25).otherwise(0) + 40 * F.least(F.lit(1.0), n / 20) + 10 * F.count_if(F.col("label") != "") / n
    return services.groupBy("stream_id").agg(F.round(score, 6).alias("progress"))


def plan_score() -> Column:
    """20, 20, 20, 15, 15, 10 for frequency, encoding, content, emergency, licence and labelling."""
    names = {"frequency_ok": 20, "encoding_ok": 20, "content_ok": 20, "emergency_ok": 15, "licence_ok": 15, "labelling_ok": 10}
    return sum((F.when(F.col(c), x).otherwise(0) for c, x in names.items()), F.lit(0))


def overall_quality() -> Column:
    # Whole numbers by a quotient, which is rounded once: 0.3 * 61 is above 18.3, and a sum may fall on the wrong side of a level.
    return 0.4 * F.col("signal") + F.col("compliance") * 3 / 10 + F.col("sync") * 2 / 10 + 0.1 * (100 - F.col("error_rate"))


def quality_level(q: Column) -> Column:
    return F.when(q >= 95, "excellent").when(q >= 85, "good").when(q >= 70, "fair").when(q >= 50, "poor").otherwise("bad")


def network_quality() -> Column:
    q = (1 - F.col("loss")) * (1 - F.least(F.lit(1.0), F.col("jitter_ms") / 50))
    return q * F.when(F.col("synced"), 1.0).otherwise(0.1)


def frame_quality() -> Column:
    """100 less a penalty by status and 10 for each ms over the first, within 0 to 100."""
    #: Penalty of each status.
    penalty = F.when(F.col("status") == "warning", 20).when(F.col("status") == "error", 50).when(F.col("status") == "sync_lost", 30).when(F.col("status") == "corrupted", 80).otherwise(0)
    return clip(100 - penalty - F.greatest(F.lit(0.0), F.col("process_ms") - 1) * 10)


def stream_quality(frames: DataFrame) -> DataFrame:
    return frames.groupBy("stream_id").agg(F.round(100 * (1 - F.count_if(~F.col("valid")) / F.count("*")), 6).alias("quality"))


def mux_capacity(subchannels: DataFrame) -> DataFrame:
    """Per ensemble: capacity units of its sub-channels, and whether they fit."""
    return subchannels.groupBy("stream_id").agg(F.sum("size").alias("used_cu")).withColumn("fits", F.col("used_cu") <= CAPACITY_CU)


def statistical_summary(frames: DataFrame, services: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: success rate, mean service quality, share of critical alerts."""
    a = frames.agg(F.round(share(F.count_if("valid"), F.count("*")), 6).alias("success_rate"))
    b = services.agg(F.round(F.avg(quality_score()), 6).alias("avg_quality"))
    c = alerts.agg(F.round(share(F.count_if(F.col("severity") >= 4), F.count("*")), 6).alias("critical_rate"))
    return a.join(b).join(c)  # one row each


def pft_statistics(packets: DataFrame) -> DataFrame:
    """Over reassembled packets (T03): loss, completeness, duplicates, order."""
    n = F.count("*")
    return packets.groupBy("stream_id").agg(
        n.alias("packets"), F.count_if("complete").alias("complete"), F.round(share(n - F.count_if("complete"), n), 6).alias("loss"), F.sum("duplicates").alias("duplicates"), F.sum("out_of_order").alias("out_of_order"), F.sum("invalid").alias("invalid")
    )


def active_services(services: DataFrame, approx: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approx else F.count_distinct
    return services.groupBy("stream_id").agg(count("sid").alias("n_services"), count("sub_channel_id").alias("n_subchannels"))


def uptime(states: DataFrame) -> DataFrame:
    """Per endpoint: time connected and lost, from state changes (ts, connected); the last state has no length."""
    s = states.withColumn("_until", -micros("ts"))  # the next change is the one before, the other way round
    s = looking_back(s, ["endpoint"], "_until", 1, lambda w: {"ms": (F.col("_until") - F.lag("_until").over(w)) / 1000}, 86_400_000_000)
    up, down = F.sum(F.when(F.col("connected"), F.col("ms"))), F.sum(F.when(~F.col("connected"), F.col("ms")))
    return s.groupBy("endpoint").agg(F.round(up, 3).alias("up_ms"), F.round(down, 3).alias("down_ms"), F.round(share(F.count_if("connected"), F.count("*")), 6).alias("success_rate"))


def log_statistics(entries: DataFrame) -> DataFrame:
    """By severity, by category and in all: entries, violations (error or worse), critical, warnings, first and last time."""
    s = F.col("severity")
    return entries.groupingSets([["severity"], ["category"], []], "severity", "category").agg(
        F.count("*").alias("n"), F.count_if(s.isin("error", "critical")).alias("violations"), F.count_if(s == "critical").alias("critical"), F.count_if(s == "warning").alias("warnings"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


def service_timeline(sightings: DataFrame) -> DataFrame:
    return sightings.groupBy("stream_id", "sid").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count("*").alias("sightings"))


def error_counters(errors: DataFrame, categories: list[str]) -> DataFrame:
    """A column a category."""
    return errors.groupBy("stream_id").pivot("category", categories).agg(F.count(F.lit(1))).na.fill(0)


def stream_monitor(frames: DataFrame, every: str = "1 hour") -> DataFrame:
    """Per stream and window: latency, rate, dropped, errored."""
    at = F.window("ts", every)
    seconds = (micros(F.col("w.end")) - micros(F.col("w.start"))) / 1e6
    out = frames.groupBy("stream_id", at.alias("w")).agg(F.min("latency").alias("least"), F.round(F.avg("latency"), 6).alias("mean"), F.max("latency").alias("most"), F.count("*").alias("n"), F.count_if("dropped").alias("dropped"), F.count_if("errored").alias("errored"))
    return out.select("stream_id", F.col("w.start").alias("window_start"), "least", "mean", "most", "n", F.round(F.col("n") / seconds, 6).alias("per_second"), "dropped", "errored")


def summary_widgets(services: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row of tiles."""
    s = services.agg(F.count("*").alias("services"), F.count_if(F.col("status") == "active").alias("active_services"), F.round(F.avg("signal"), 6).alias("avg_signal"))
    a = alerts.agg(F.count_if("active").alias("active_alerts"), F.count_if(F.col("severity") == 5).alias("emergencies"))
    return s.join(a)  # one row each


def data_service_snapshot(items: DataFrame) -> DataFrame:
    """Per sub-channel: bytes, frames, decoded objects by kind, and whether it has content."""
    of = lambda k: F.count_if(F.col("kind") == k)
    return items.groupBy("stream_id", "sub_channel_id").agg(
        F.sum("n_bytes").alias("n_bytes"), F.count_distinct("frame_no").alias("frames"), of("epg").alias("epg"), of("journaline").alias("journaline"), of("tpeg").alias("tpeg"), (of("epg") + of("journaline") + of("tpeg") > 0).alias("has_content")
    )


def text_inventory(runs: DataFrame, span: float | None = None) -> DataFrame:
    """Per text: repeats, first and last unit, rank of first sight."""
    t = runs.groupBy("text").agg(F.count("*").alias("repeats"), F.min("unit").alias("first_unit"), F.max("unit").alias("last_unit"))
    first = t.withColumn("_at", F.struct("first_unit", "text"))
    rank = running(first, [], "_at", {"seen_rank": ("total", F.lit(1))}, span, peers=False)
    return rank.drop("_at").withColumn("seen_rank", F.col("seen_rank").cast("int"))


def journaline_menus(objects: DataFrame) -> DataFrame:
    """A menu a category under the root: ids from 10 in order of the category."""
    by = objects.groupBy("category").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("object_id")).alias("objects"))
    return by.select((F.dense_rank().over(Window.orderBy("category")) + 9).alias("menu_id"), F.lit(1).alias("parent_id"), "category", "n", "objects")


def message_statistics(groups: DataFrame, key: str) -> DataFrame:
    """Decoded groups or messages by state (valid, crc_error, rejected), a row a key."""
    of = lambda s: F.count_if(F.col("state") == s)
    return groups.groupBy(key).agg(F.count("*").alias("processed"), of("valid").alias("valid"), of("crc_error").alias("crc_errors"), of("rejected").alias("rejected"))


def compliance_verdict(streams: DataFrame, strict: bool = False) -> DataFrame:
    """Per stream one verdict with reasons; transport errors of frames don't count by design."""
    checks = {
        "fib_crc": F.col("fib_crc_failures") > 0, "fig_errors": F.col("erroneous_figs") > 0, "no_fic": F.col("total_fibs") == 0, "no_ensemble": F.col("ensembles") == 0, "no_service": F.col("services") == 0,
        **({"eoh_crc": F.col("eoh_failures") > 0} if strict else {}),
    }
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in checks.items()]))
    return streams.select("stream_id", (F.size(reasons) == 0).alias("compliant"), F.array_join(reasons, ",").alias("reasons"))


def custom_metrics(rows: DataFrame, metrics: dict[str, Column], keys: list[str]) -> DataFrame:
    """A row a key and metric: any aggregate column under its name, from one scan."""
    wide = rows.groupBy(*keys).agg(*[F.round(c, 6).alias(k) for k, c in metrics.items()])
    return wide.select(*keys, F.explode(F.create_map(*[x for k in metrics for x in (F.lit(k), F.col(k))])).alias("metric", "value"))
