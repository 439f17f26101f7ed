"""Queries of inventories, health and scores (A-family) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.operators import health as h
from muxlake.plans import views as v
from muxlake.plans.views import query, sql

CLIP = "least(greatest({}, 0.0), 100.0)"


@query("a01_fig_inventory", sql("SELECT fig_type, ext, count(*) AS n, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) FILTER (NOT crc_ok) AS crc_failures FROM $figs GROUP BY 1, 2"))
def a01(s, d):
    return h.fig_inventory(v.figs(s, d))


@query("a02_fig_type_counts", sql("SELECT fig_type, ext, count(*) AS n FROM $figs GROUP BY ROLLUP (fig_type, ext)"))
def a02(s, d):
    return h.fig_type_counts(v.figs(s, d))


@query("a03_fic_health", sql("SELECT stream_id, count(*) AS total_fibs, count(*) FILTER (NOT crc_ok) AS fib_crc_failures, count(*) FILTER (erroneous) AS erroneous_figs FROM $figs GROUP BY 1"))
def a03(s, d):
    return h.fic_health(v.figs(s, d), v.figs(s, d))


@query("a04_figs_by_type", sql("""WITH f AS (SELECT DISTINCT fig_type, ext, frame_no FROM $figs), r AS (SELECT *, row_number() OVER (PARTITION BY fig_type, ext ORDER BY frame_no) AS rn FROM f)
    SELECT fig_type, ext, (SELECT count(*) FROM $figs x WHERE x.fig_type = r.fig_type AND x.ext = r.ext) AS n, count(*) AS n_frames, string_agg(frame_no::VARCHAR, ',' ORDER BY frame_no) FILTER (rn <= 64) AS frames, greatest(count(*) - 64, 0) AS more FROM r GROUP BY 1, 2"""))
def a04(s, d):
    return h.figs_by_type(v.figs(s, d)).withColumn("frames", F.array_join(F.transform("frames", lambda x: x.cast("string")), ","))


@query("a08_mux_capacity", sql("SELECT stream_id, sum(size)::BIGINT AS used_cu, sum(size) <= 864 AS fits FROM $subchannels GROUP BY 1"))
def a08(s, d):
    return h.mux_capacity(v.subchannels(s, d))


@query("a09_compliance_verdict", sql("""WITH f AS (SELECT stream_id, count(*) FILTER (NOT crc_ok) AS c, count(*) FILTER (erroneous) AS e FROM $figs GROUP BY 1)
    SELECT stream_id, c = 0 AND e = 0 AS compliant, concat_ws(',', CASE WHEN c > 0 THEN 'fib_crc' END, CASE WHEN e > 0 THEN 'fig_errors' END) AS reasons FROM f"""))
def a09(s, d):
    f = v.figs(s, d)
    found = f.groupBy("stream_id").agg(F.count_distinct("fig_type").alias("ensembles"), F.count_distinct("ext").alias("services"))
    return h.compliance_verdict(h.fic_health(f, f).join(found, "stream_id"))


@query("a10_stream_stats", sql("SELECT stream_id, count(*) AS total_frames, count(*) FILTER (valid) AS valid_frames, count(*) FILTER (NOT valid) AS error_frames, count(*) * 24 AS duration_ms, round(100.0 * count(*) FILTER (valid) / count(*), 6) AS success_rate FROM $frames GROUP BY 1"))
def a10(s, d):
    return h.stream_stats(v.frames(s, d))


@query("a11_ensemble_statistics", sql("""SELECT stream_id, count(*) AS n_services, count(*) FILTER (kind = 'audio') AS n_audio, count(*) FILTER (kind = 'data') AS n_data, count(*) FILTER (status = 'active') AS n_active,
    round(avg(signal) FILTER (signal > 0), 6) AS avg_signal, round(avg(error_rate) FILTER (signal > 0), 6) AS avg_error FROM $services GROUP BY 1"""))
def a11(s, d):
    return h.ensemble_statistics(v.services(s, d))


@query("a12_statistical_summary", sql("""SELECT (SELECT round(100.0 * count(*) FILTER (valid) / count(*), 6) FROM $frames) AS success_rate, (SELECT round(avg(0.6 * signal + 0.4 * (100 - error_rate)), 6) FROM $services) AS avg_quality,
    (SELECT round(100.0 * count(*) FILTER (severity >= 4) / count(*), 6) FROM $alerts) AS critical_rate"""))
def a12(s, d):
    return h.statistical_summary(v.frames(s, d), v.services(s, d), v.alerts(s, d))


@query("a13_violation_counts", sql("SELECT severity, category, count(*) AS n FROM $violations WHERE active GROUP BY GROUPING SETS ((severity), (category), ())"))
def a13(s, d):
    return h.violation_counts(v.violations(s, d), active_only=True)


@query("a14_compliance_score_frames", sql(f"""WITH f AS (SELECT stream_id, frame_no, bool_and(severity NOT IN ('critical', 'error')) AS passed, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings FROM $violations GROUP BY 1, 2)
    SELECT stream_id, count(*) AS n, round({CLIP.format("(count(*) FILTER (passed) - 10 * sum(critical) - 2 * sum(warnings)) / count(*) * 100")}, 6) AS score FROM f GROUP BY 1"""))
def a14(s, d):
    x = v.violations(s, d)
    per_frame = x.groupBy("stream_id", "frame_no").agg(F.bool_and(~F.col("severity").isin("critical", "error")).alias("passed"), F.count_if(F.col("severity") == "critical").alias("critical"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return h.compliance_score_frames(per_frame)


@query("a15_compliance_score_violations", sql(f"""SELECT stream_id, count(*) AS n, round({CLIP.format("100 - 20 * count(*) FILTER (severity = 'critical') - 10 * count(*) FILTER (severity = 'error') - 3 * count(*) FILTER (severity = 'warning') - 0.5 * count(*) FILTER (severity = 'info')")}, 6) AS score FROM $violations GROUP BY 1"""))
def a15(s, d):
    return h.compliance_score_violations(v.violations(s, d))


@query("a16_compliance_score_eti", sql(f"""SELECT stream_id, round({CLIP.format("100 - 8 * count(*) FILTER (severity = 'critical') - 2 * count(*) FILTER (severity = 'error') - 0.3 * count(*) FILTER (severity = 'warning') - 0.05 * count(*) FILTER (severity = 'info') + 0.8 * count(*) FILTER (severity = 'pass')")}, 6) AS score FROM $violations GROUP BY 1"""))
def a16(s, d):
    return h.compliance_score_eti(v.violations(s, d))


@query("a17_compliance_score_basic", sql("""SELECT stream_id, round(avg(greatest(100 - CASE WHEN NOT sync_ok THEN 25 ELSE 0 END - CASE WHEN fc > 249 THEN 5 ELSE 0 END - CASE WHEN nst > 63 THEN 5 ELSE 0 END - CASE WHEN mid NOT BETWEEN 0 AND 3 THEN 10 ELSE 0 END, 0)), 6) AS score FROM $headers GROUP BY 1"""))
def a17(s, d):
    return h.compliance_score_basic(v.headers(s, d))


AS_OF = "TIMESTAMP '2024-01-02 00:00:00'"


@query("a18_health_score", sql(f"""SELECT stream_id, greatest(100 - 20 * count(*) FILTER (severity = 'critical' AND r) - 10 * count(*) FILTER (severity = 'high' AND r) - 5 * count(*) FILTER (severity = 'medium' AND r), 0) AS health
    FROM (SELECT *, ts > {AS_OF} - INTERVAL 60 MINUTES AND ts <= {AS_OF} AS r FROM $errors) GROUP BY 1"""))
def a18(s, d):
    return h.health_score(v.errors(s, d), F.expr(AS_OF))


@query("a19_error_patterns", sql("""WITH e AS (SELECT category, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, (epoch_us(max(ts)) - epoch_us(min(ts))) / 60e6 AS m FROM $errors GROUP BY 1)
    SELECT category, n, first_ts, last_ts, round(CASE WHEN m > 0 THEN n / m ELSE n END, 6) AS per_minute, n >= 10 AND CASE WHEN m > 0 THEN n / m ELSE n END > 1 AS critical FROM e"""))
def a19(s, d):
    return h.error_patterns(v.errors(s, d))


@query("a20_error_report", sql(f"SELECT severity, category, count(*) AS n, min(frame_no) AS first_frame, max(frame_no) AS last_frame FROM $errors WHERE ts BETWEEN TIMESTAMP '2024-01-01 06:00:00' AND {AS_OF} GROUP BY 1, 2"))
def a20(s, d):
    return h.error_report(v.errors(s, d), F.expr("TIMESTAMP '2024-01-01 06:00:00'"), F.expr(AS_OF))


@query("a21_alert_statistics", sql("SELECT severity, category, count(*) AS total, count(*) FILTER (active) AS active, count(*) FILTER (acknowledged) AS acknowledged, count(*) FILTER (resolved) AS resolved, max(ts) AS last_ts FROM $alerts GROUP BY GROUPING SETS ((severity), (category), ())"))
def a21(s, d):
    return h.alert_statistics(v.alerts(s, d))


@query("a22_alert_priority", sql("SELECT alert_id, severity * 1000 + CASE WHEN active THEN 500 ELSE 0 END AS priority FROM $alerts"))
def a22(s, d):
    return h.alert_priority(v.alerts(s, d)).select("alert_id", "priority")


@query("a23_operation_profile", sql("SELECT metric AS operation, count(*) AS n, round(sum(value), 4) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM $measurements GROUP BY 1"))
def a23(s, d):
    return h.operation_profile(v.measurements(s, d).withColumnsRenamed({"metric": "operation", "value": "duration"}))


@query("a24_performance_score", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(10 - least(greatest(l_linenumber * 0.1, 0.0), 3.0) - least(greatest((l_quantity * 10 - 100) / 100, 0.0), 2.0) - least(greatest((l_discount * 1000 - 50) / 25, 0.0), 2.0) - least(greatest((900 - l_extendedprice / 50) / 300, 0.0), 2.0) - least(greatest((l_tax * 100 - 1) / 10, 0.0), 1.0), 6) AS score FROM lineitem""")
def a24(s, d):
    x = v.table(s, d, "lineitem").withColumns({"errors": F.col("l_linenumber"), "memory_mb": F.col("l_quantity") * 10, "cpu": F.col("l_discount") * 1000, "throughput": F.col("l_extendedprice") / 50, "latency_ms": F.col("l_tax") * 100})
    return x.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(h.performance_score(), 6).alias("score"))


@query("a25_latency_percentiles", sql("SELECT metric, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean, round(var_pop(value), 4) AS variance FROM $measurements GROUP BY 1"))
def a25(s, d):
    return h.latency_percentiles(v.measurements(s, d))


@query("a26_fps_stability", sql("SELECT stream_id, round(stddev_pop(value) / avg(value), 6) AS variation FROM $measurements GROUP BY 1"))
def a26(s, d):
    return h.fps_stability(v.measurements(s, d))


@query("a27_fig_carousel", sql("""WITH g AS (SELECT *, (frame_no - lag(frame_no) OVER (PARTITION BY stream_id, fig_type, ext ORDER BY frame_no)) * 24 AS gap FROM $figs)
    SELECT fig_type, ext, count(*) AS n, round(avg(gap), 4) AS avg_ms, min(gap) AS min_ms, max(gap) AS max_ms, round(CASE WHEN count(gap) > 0 THEN 100.0 * count(*) FILTER (gap < 100) / count(gap) ELSE 0 END, 6) AS within, round(100 - 100.0 * count(*) FILTER (NOT crc_ok) / count(*), 6) AS efficiency FROM g GROUP BY 1, 2"""))
def a27(s, d):
    return h.fig_carousel(v.figs(s, d))


@query("a28_service_quality", sql("""WITH q AS (SELECT stream_id, sid, avg(signal * (1 - error_rate)) * CASE WHEN bool_and(etsi_ok) THEN 1.0 ELSE 0.8 END * CASE WHEN bool_and(plan_ok) THEN 1.0 ELSE 0.9 END AS q FROM $services GROUP BY 1, 2)
    SELECT stream_id, sid, round(q, 6) AS quality, round(avg(q) OVER (PARTITION BY stream_id), 6) AS ensemble_quality FROM q"""))
def a28(s, d):
    return h.service_quality(v.services(s, d))


@query("a29_quality_score", sql("SELECT sid, round(0.6 * signal + 0.4 * (100 - error_rate), 6) AS score, 0.6 * signal + 0.4 * (100 - error_rate) >= 50 AS available FROM $services"))
def a29(s, d):
    return v.services(s, d).select("sid", F.round(h.quality_score(), 6).alias("score"), (h.quality_score() >= 50).alias("available"))


@query("a30_discovery_progress", sql("SELECT stream_id, round(50 + 40 * least(1.0, count(*) / 20) + 10 * count(*) FILTER (label <> '') / count(*), 6) AS progress FROM $services GROUP BY 1"))
def a30(s, d):
    return h.discovery_progress(v.services(s, d))


@query("a31_plan_score", sql("SELECT sid, CASE WHEN plan_ok THEN 20 ELSE 0 END + CASE WHEN etsi_ok THEN 20 ELSE 0 END + CASE WHEN signal > 50 THEN 20 ELSE 0 END + CASE WHEN tmid = 0 THEN 15 ELSE 0 END + CASE WHEN ecc > 0 THEN 15 ELSE 0 END + CASE WHEN label <> '' THEN 10 ELSE 0 END AS score FROM $services"))
def a31(s, d):
    x = v.services(s, d).withColumns({"frequency_ok": F.col("plan_ok"), "encoding_ok": F.col("etsi_ok"), "content_ok": F.col("signal") > 50, "emergency_ok": F.col("tmid") == 0, "licence_ok": F.col("ecc") > 0, "labelling_ok": F.col("label") != ""})
    return x.select("sid", h.plan_score().alias("score"))


@query("a32_overall_quality", sql("""WITH q AS (SELECT sid, 0.4 * signal + 0.3 * (sid % 97) + 0.2 * (sid % 89) + 0.1 * (100 - error_rate) AS q FROM $services)
    SELECT sid, round(q, 6) AS quality, CASE WHEN q >= 95 THEN 'excellent' WHEN q >= 85 THEN 'good' WHEN q >= 70 THEN 'fair' WHEN q >= 50 THEN 'poor' ELSE 'bad' END AS level FROM q"""))
def a32(s, d):
    x = v.services(s, d).withColumns({"compliance": F.col("sid") % 97, "sync": F.col("sid") % 89}).withColumn("q", h.overall_quality())
    return x.select("sid", F.round("q", 6).alias("quality"), h.quality_level(F.col("q")).alias("level"))


@query("a33_network_quality", sql("SELECT sid, round((1 - error_rate) * (1 - least(1.0, signal / 50)) * CASE WHEN etsi_ok THEN 1.0 ELSE 0.1 END, 6) AS quality FROM $services"))
def a33(s, d):
    x = v.services(s, d).withColumns({"loss": F.col("error_rate"), "jitter_ms": F.col("signal"), "synced": F.col("etsi_ok")})
    return x.select("sid", F.round(h.network_quality(), 6).alias("quality"))


@query("a34_frame_quality", sql("""SELECT stream_id, round(avg(least(greatest(100 - CASE event_type WHEN 'view' THEN 20 WHEN 'error' THEN 50 WHEN 'signup' THEN 30 WHEN 'click' THEN 80 ELSE 0 END - greatest(0.0, value / 10 - 1) * 10, 0.0), 100.0)), 6) AS quality FROM (SELECT 'S' || (user_id % 16) AS stream_id, * FROM events) GROUP BY 1"""))
def a34(s, d):
    status = F.create_map(*[F.lit(x) for x in ("view", "warning", "error", "error", "signup", "sync_lost", "click", "corrupted", "purchase", "ok")])
    x = v.measurements(s, d).withColumns({"status": status[F.col("metric")], "process_ms": F.col("value") / 10})
    return x.groupBy("stream_id").agg(F.round(F.avg(h.frame_quality()), 6).alias("quality"))


@query("a35_stream_quality", sql("SELECT stream_id, round(100 * (1 - count(*) FILTER (NOT valid) / count(*)), 6) AS quality FROM $frames GROUP BY 1"))
def a35(s, d):
    return h.stream_quality(v.frames(s, d))


@query("a36_data_service_snapshot", """SELECT 'S' || (user_id % 16) AS stream_id, user_id % 64 AS sub_channel_id, sum(floor(value)::BIGINT)::BIGINT AS n_bytes, count(DISTINCT event_id) AS frames, count(*) FILTER (event_type = 'view') AS epg, count(*) FILTER (event_type = 'click') AS journaline, count(*) FILTER (event_type = 'signup') AS tpeg, count(*) FILTER (event_type IN ('view', 'click', 'signup')) > 0 AS has_content FROM events GROUP BY 1, 2""")
def a36(s, d):
    kind = F.create_map(*[F.lit(x) for x in ("view", "epg", "click", "journaline", "signup", "tpeg")])
    e = v.table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), (F.col("user_id") % 64).alias("sub_channel_id"), F.floor("value").alias("n_bytes"), F.col("event_id").alias("frame_no"), F.coalesce(kind[F.col("event_type")], F.lit("other")).alias("kind"))
    return h.data_service_snapshot(e)


@query("a37_text_inventory", """WITH t AS (SELECT props AS text, count(*) AS repeats, min(event_id) AS first_unit, max(event_id) AS last_unit FROM events GROUP BY 1) SELECT *, row_number() OVER (ORDER BY first_unit, text)::INT AS seen_rank FROM t""")
def a37(s, d):
    return h.text_inventory(v.table(s, d, "events").select(F.col("props").alias("text"), F.col("event_id").alias("unit")))


@query("a38_pft_statistics", """WITH p AS (SELECT 'M' || (l_suppkey % 10) AS stream_id, l_orderkey, count(DISTINCT l_linenumber) AS got, max(l_linenumber) AS fcount, count(*) - count(DISTINCT l_linenumber) AS dup FROM lineitem GROUP BY 1, 2)
    SELECT stream_id, count(*) AS packets, count(*) FILTER (got = fcount) AS complete, round(100.0 * (count(*) - count(*) FILTER (got = fcount)) / count(*), 6) AS loss, sum(dup)::BIGINT AS duplicates, 0::BIGINT AS out_of_order, 0::BIGINT AS invalid FROM p GROUP BY 1""")
def a38(s, d):
    x = v.table(s, d, "lineitem").groupBy(F.concat(F.lit("M"), F.col("l_suppkey") % 10).alias("stream_id"), "l_orderkey")
    p = x.agg((F.count_distinct("l_linenumber") == F.max("l_linenumber")).alias("complete"), (F.count("*") - F.count_distinct("l_linenumber")).alias("duplicates"))
    return h.pft_statistics(p.withColumns({"out_of_order": F.lit(0).cast("long"), "invalid": F.lit(0).cast("long")}))


@query("a40_message_statistics", "SELECT user_id, count(*) AS processed, count(*) FILTER (value >= 10) AS valid, count(*) FILTER (value < 2) AS crc_errors, count(*) FILTER (value >= 2 AND value < 10) AS rejected FROM events GROUP BY 1")
def a40(s, d):
    state = F.when(F.col("value") >= 10, "valid").when(F.col("value") < 2, "crc_error").otherwise("rejected")
    return h.message_statistics(v.table(s, d, "events").withColumn("state", state), "user_id")


@query("a41_active_services", sql("SELECT stream_id, count(DISTINCT sid) AS n_services, count(DISTINCT sub_channel_id) AS n_subchannels FROM $services GROUP BY 1"))
def a41(s, d):
    return h.active_services(v.services(s, d))


@query("a42_journaline_menus", """SELECT (dense_rank() OVER (ORDER BY p_brand) + 9)::INT AS menu_id, 1 AS parent_id, p_brand AS category, count(*) AS n, string_agg(DISTINCT p_partkey::VARCHAR, ',' ORDER BY p_partkey::VARCHAR) AS objects FROM part GROUP BY p_brand""")
def a42(s, d):
    m = h.journaline_menus(v.table(s, d, "part").select(F.col("p_brand").alias("category"), F.col("p_partkey").cast("string").alias("object_id")))
    return m.withColumn("objects", F.array_join("objects", ","))


@query("a43_uptime", """WITH u AS (SELECT 'E' || (user_id % 32) AS endpoint, ts, event_type <> 'error' AS connected, (epoch_us(lead(ts) OVER (PARTITION BY user_id % 32 ORDER BY ts)) - epoch_us(ts)) / 1000 AS ms FROM events)
    SELECT endpoint, round(sum(ms) FILTER (connected), 3) AS up_ms, round(sum(ms) FILTER (NOT connected), 3) AS down_ms, round(100.0 * count(*) FILTER (connected) / count(*), 6) AS success_rate FROM u GROUP BY 1""")
def a43(s, d):
    e = v.table(s, d, "events").select(F.concat(F.lit("E"), F.col("user_id") % 32).alias("endpoint"), "ts", (F.col("event_type") != "error").alias("connected"))
    return h.uptime(e)


@query("a44_log_statistics", sql("SELECT severity, category, count(*) AS n, count(*) FILTER (severity IN ('error', 'critical')) AS violations, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'warning') AS warnings, min(ts) AS first_ts, max(ts) AS last_ts FROM $logs GROUP BY GROUPING SETS ((severity), (category), ())"))
def a44(s, d):
    return h.log_statistics(v.logs(s, d))


@query("a45_service_timeline", "SELECT event_type AS stream_id, user_id AS sid, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS sightings FROM events GROUP BY 1, 2")
def a45(s, d):
    return h.service_timeline(v.table(s, d, "events").withColumnsRenamed({"event_type": "stream_id", "user_id": "sid"}))


@query("a46_error_counters", sql("SELECT stream_id, count(*) FILTER (category = 'view') AS view, count(*) FILTER (category = 'click') AS click, count(*) FILTER (category = 'error') AS error FROM $errors GROUP BY 1"))
def a46(s, d):
    return h.error_counters(v.errors(s, d), ["view", "click", "error"])


@query("a47_stream_monitor", sql("SELECT stream_id, time_bucket(INTERVAL 1 HOUR, ts) AS window_start, min(latency) AS least, round(avg(latency), 6) AS mean, max(latency) AS most, count(*) AS n, round(count(*) / 3600.0, 6) AS per_second, count(*) FILTER (dropped) AS dropped, count(*) FILTER (errored) AS errored FROM $frames GROUP BY 1, 2"))
def a47(s, d):
    return h.stream_monitor(v.frames(s, d))


@query("a48_summary_widgets", sql("SELECT (SELECT count(*) FROM $services) AS services, (SELECT count(*) FROM $services WHERE status = 'active') AS active_services, (SELECT round(avg(signal), 6) FROM $services) AS avg_signal, (SELECT count(*) FROM $alerts WHERE active) AS active_alerts, (SELECT count(*) FROM $alerts WHERE severity = 5) AS emergencies"))
def a48(s, d):
    return h.summary_widgets(v.services(s, d), v.alerts(s, d))
