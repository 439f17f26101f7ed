"""Queries of windows and the batch forms of streams (W- and T-families)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.operators import timing as t
from muxlake.plans import views as v
from muxlake.plans.views import query, sql

#: Length of a span of numbers: short, so that the small tables have many.
SPAN = 1024
PER_STREAM = "OVER (PARTITION BY stream_id ORDER BY frame_no)"


@query("w01_frame_count_gaps", sql(f"SELECT stream_id, frame_no, fc, (lag(fc) {PER_STREAM} + 1) % 250 AS expected FROM $headers QUALIFY expected IS NOT NULL AND fc <> expected"))
def w01(s, d):
    return t.frame_count_gaps(v.headers(s, d), span=SPAN).select("stream_id", "frame_no", "fc", "expected")


@query("w02_counter_discontinuity", sql(f"SELECT stream_id, frame_no, frame_no - lag(frame_no) {PER_STREAM} AS step, CASE WHEN abs(step) > 10 THEN 'critical' ELSE 'warning' END AS severity FROM $frames QUALIFY step <> 1"))
def w02(s, d):
    return t.counter_discontinuity(v.frames(s, d).withColumn("counter", F.col("frame_no")), span=SPAN).select("stream_id", "frame_no", "step", "severity")


LOSS = """SELECT *, CASE WHEN step IS NULL OR step = 0 OR step >= 32768 THEN 0 ELSE step - 1 END AS lost, coalesce(step = 0, false) AS duplicate, coalesce(step >= 32768, false) AS reordered
    FROM (SELECT *, ((seq - lag(seq) OVER (PARTITION BY stream_id ORDER BY arrival_no)) % 65536 + 65536) % 65536 AS step FROM $packets)"""


@query("w03_sequence_loss", sql(f"SELECT stream_id, arrival_no, seq, lost, duplicate, reordered FROM ({LOSS})"))
def w03(s, d):
    return t.sequence_loss(v.packets(s, d), order="arrival_no", span=SPAN).select("stream_id", "arrival_no", "seq", "lost", "duplicate", "reordered")


@query("a39_rtp_statistics", sql(f"SELECT stream_id, count(*) AS packets, sum(n_bytes)::BIGINT AS n_bytes, sum(lost)::BIGINT AS lost, round(sum(lost) / (count(*) + sum(lost)), 6) AS loss_rate FROM ({LOSS}) GROUP BY 1"))
def a39(s, d):
    return t.rtp_statistics(t.sequence_loss(v.packets(s, d), order="arrival_no", span=SPAN))


@query("w04_rtp_jitter", sql("""WITH d AS (SELECT stream_id, arrival, abs((epoch_us(arrival) - epoch_us(lag(arrival) OVER w)) / 1000 - (rtp_ts - lag(rtp_ts) OVER w) / 48000.0 * 1000) AS x, row_number() OVER w - 2 AS i FROM $packets WINDOW w AS (PARTITION BY stream_id ORDER BY arrival)),
    l AS (SELECT stream_id, i, floor(i / 256)::BIGINT AS session, list(x) OVER (PARTITION BY stream_id ORDER BY i) AS xs FROM d WHERE x IS NOT NULL)
    SELECT stream_id, session, count(*)::INT AS n, round(list_reduce(arg_max(xs, i), lambda j, x: j + (x - j) * 0.125), 4) AS jitter FROM l GROUP BY stream_id, session"""))
def w04(s, d):
    return t.rtp_jitter(v.packets(s, d), session=256).withColumn("jitter", F.round("jitter", 4))


@query("w04_transit_difference", sql("SELECT stream_id, arrival_no, round(abs((epoch_us(arrival) - epoch_us(lag(arrival) OVER w)) / 1000 - (rtp_ts - lag(rtp_ts) OVER w) / 48000.0 * 1000), 3) AS difference FROM $packets WINDOW w AS (PARTITION BY stream_id ORDER BY arrival)"))
def w04b(s, d):
    return t.transit_difference(v.packets(s, d)).select("stream_id", "arrival_no", F.round("difference", 3).alias("difference"))


@query("w05_fig_intervals", sql("SELECT stream_id, frame_no, (frame_no - lag(frame_no) OVER (PARTITION BY stream_id, fig_type, ext ORDER BY frame_no)) * 24 AS interval_ms FROM $figs"))
def w05(s, d):
    return t.fig_intervals(v.figs(s, d), SPAN).select("stream_id", "frame_no", "interval_ms")


@query("w06_tist_steps", sql(f"SELECT stream_id, frame_no, round(latency - lag(latency) {PER_STREAM}, 6) AS step_ms FROM $frames QUALIFY abs(step_ms - 24) > 5"))
def w06(s, d):
    return t.tist_steps(v.frames(s, d).withColumn("tist_ms", F.col("latency")), span=SPAN).select("stream_id", "frame_no", "step_ms")


@query("w07_clock_drift_ppm", sql("""SELECT stream_id, frame_no, CASE WHEN count(*) OVER w >= 10 AND last(frame_no) OVER w > first(frame_no) OVER w THEN round((last(latency) OVER w - first(latency) OVER w) / (last(frame_no) OVER w - first(frame_no) OVER w) * 1000, 4) END AS drift_ppm
    FROM $frames WINDOW w AS (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN 99 PRECEDING AND CURRENT ROW)"""))
def w07(s, d):
    return t.clock_drift_ppm(v.frames(s, d).withColumns({"at_s": F.col("frame_no"), "offset_ms": F.col("latency")}), span=SPAN).select("stream_id", "frame_no", "drift_ppm")


@query("w08_error_runs", sql(f"""WITH r AS (SELECT *, sum(valid::INT) {PER_STREAM} AS run FROM (SELECT stream_id, frame_no, latency >= 10 AS valid FROM $frames))
    SELECT stream_id, min(frame_no) AS first_frame, max(frame_no) AS last_frame, count(*) AS length FROM r WHERE NOT valid GROUP BY stream_id, run HAVING count(*) >= 2"""))
def w08(s, d):
    return t.error_runs(v.frames(s, d).withColumn("valid", F.col("latency") >= 10), least=2, span=SPAN)


@query("w09_reconfigurations", """WITH e AS (SELECT 'S' || (user_id % 16) AS stream_id, event_id, unnest([{'k': 'ensemble', 'v': user_id % 8}, {'k': 'subchannel', 'v': user_id % 64}, {'k': 'service', 'v': user_id}]) AS x FROM events),
    f AS (SELECT stream_id, x.k, x.v, min(event_id) AS frame_no FROM e GROUP BY ALL) SELECT stream_id, frame_no, count(*) AS added FROM f GROUP BY 1, 2""")
def w09(s, d):
    e = v.table(s, d, "events")
    x = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), c.alias("value")) for k, c in (("ensemble", F.col("user_id") % 8), ("subchannel", F.col("user_id") % 64), ("service", F.col("user_id")))]))
    return t.reconfigurations(e.select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), F.col("event_id").alias("frame_no"), x.alias("x")).select("stream_id", "frame_no", "x.*"))


@query("w10_carry_forward", sql("SELECT stream_id, frame_no, last_value(CASE WHEN latency > 20 THEN frame_no % 8 END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS eid FROM $frames"))
def w10(s, d):
    return t.carry_forward(v.frames(s, d).withColumn("eid", F.when(F.col("latency") > 20, F.col("frame_no") % 8)), "eid", span=SPAN).select("stream_id", "frame_no", "eid")


@query("w11_now_playing_changes", sql("SELECT stream_id, frame_no, metric, low FROM (SELECT *, value < 10 AS low FROM $measurements) WINDOW w AS (PARTITION BY stream_id ORDER BY ts) QUALIFY row_number() OVER w = 1 OR metric IS DISTINCT FROM lag(metric) OVER w OR low IS DISTINCT FROM lag(low) OVER w"))
def w11(s, d):
    return t.changes(v.measurements(s, d).withColumn("low", F.col("value") < 10), ["metric", "low"]).select("stream_id", "frame_no", "metric", "low")


@query("w12_rolling_fps", sql("""SELECT stream_id, frame_no, CASE WHEN max(u) OVER w > min(u) OVER w THEN round((count(*) OVER w - 1) / ((max(u) OVER w - min(u) OVER w) / 1e6), 6) END AS rate FROM (SELECT *, epoch_us(ts) AS u FROM $frames) WINDOW w AS (PARTITION BY stream_id ORDER BY u RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"""))
def w12(s, d):
    return t.rolling_rate(v.frames(s, d), 3600).select("stream_id", "frame_no", "rate")


@query("w13_error_rate_60s", sql("""SELECT stream_id, frame_no, count(*) OVER r AS recent, count(*) FILTER (severity = 'critical') OVER r AS recent_critical, last_value(CASE WHEN severity = 'critical' THEN ts END IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY ts) AS last_critical
    FROM (SELECT *, epoch_us(ts) AS u FROM $errors) WINDOW r AS (PARTITION BY stream_id ORDER BY u RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW)"""))
def w13(s, d):
    return t.error_rate_window(v.errors(s, d)).select("stream_id", "frame_no", "recent", "recent_critical", "last_critical")


@query("w14_trend", sql("""WITH x AS (SELECT metric, value, (row_number() OVER (PARTITION BY metric ORDER BY ts) - 1)::DOUBLE AS x FROM $measurements), s AS (SELECT metric, regr_slope(value, x) AS s FROM x GROUP BY 1)
    SELECT metric, round(s, 6) AS slope, CASE WHEN s > 0.1 THEN 'improving' WHEN s < -0.1 THEN 'declining' ELSE 'stable' END AS trend FROM s"""))
def w14(s, d):
    return t.trend(v.measurements(s, d), "metric", "ts")


@query("w15_trend_forecast", sql("""WITH x AS (SELECT metric, value, epoch_us(ts) / 3.6e9 - min(epoch_us(ts) / 3.6e9) OVER (PARTITION BY metric) AS x FROM $measurements)
    SELECT metric, round(regr_slope(value, x), 6) AS slope_per_hour, round(regr_slope(value, x) * (max(x) + 1) + regr_intercept(value, x), 4) AS next_hour, round(regr_r2(value, x), 6) AS confidence, stddev_pop(value) > 0.5 * avg(value) AS volatile FROM x GROUP BY 1"""))
def w15(s, d):
    return t.trend_forecast(v.measurements(s, d), "metric")


@query("w16_anomalies", sql("""SELECT stream_id, frame_no, round(CASE WHEN count(*) OVER w >= 20 AND stddev_pop(value) OVER w > 0 THEN (value - avg(value) OVER w) / stddev_pop(value) OVER w END, 4) AS z FROM $measurements
    WINDOW w AS (PARTITION BY stream_id, metric ORDER BY frame_no ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) QUALIFY abs(z) > 3"""))
def w16(s, d):
    return t.anomalies(v.measurements(s, d), ["stream_id", "metric"], "frame_no", span=SPAN).select("stream_id", "frame_no", "z")


@query("w17_consecutive_violations", sql("SELECT stream_id, frame_no FROM (SELECT *, latency < 12 AS violating FROM $frames) WINDOW w AS (PARTITION BY stream_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) QUALIFY min(violating::INT) OVER w = 1 AND count(*) OVER w = 3"))
def w17(s, d):
    return t.consecutive_violations(v.frames(s, d).withColumn("violating", F.col("latency") < 12)).select("stream_id", "frame_no")


@query("w18_measurement_stats", sql("SELECT stream_id, frame_no, min(value) OVER w AS least, max(value) OVER w AS most, round(avg(value) OVER w, 6) AS mean, round(stddev_pop(value) OVER w, 4) AS deviation FROM $measurements WINDOW w AS (PARTITION BY stream_id, metric ORDER BY frame_no ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)"))
def w18(s, d):
    return t.measurement_stats(v.measurements(s, d), ["stream_id", "metric"], "frame_no", span=SPAN).select("stream_id", "frame_no", "least", "most", "mean", "deviation")


@query("w19_first_seen_rank", "WITH f AS (SELECT user_id, min(event_id) AS first FROM events GROUP BY 1) SELECT user_id, first, dense_rank() OVER (ORDER BY first)::INT AS seen_rank FROM f")
def w19(s, d):
    return t.first_seen_rank(v.table(s, d, "events"), "user_id", "event_id", SPAN)


@query("w20_latest_per_key", sql("SELECT stream_id, metric, frame_no, value FROM $measurements QUALIFY row_number() OVER (PARTITION BY stream_id, metric ORDER BY frame_no DESC) = 1"))
def w20(s, d):
    return t.latest_per_key(v.measurements(s, d).drop("ts"), ["stream_id", "metric"], ["frame_no"])


@query("w21_running_quality", sql("""WITH l AS (SELECT stream_id, frame_no, floor(frame_no / 1024)::BIGINT AS session, list(CASE WHEN valid THEN 0.01::DOUBLE ELSE -0.05::DOUBLE END) OVER (PARTITION BY stream_id ORDER BY frame_no) AS xs FROM $frames)
    SELECT stream_id, session, round(list_reduce(list_prepend(1.0::DOUBLE, arg_max(xs, frame_no)), lambda q, x: greatest(0.0::DOUBLE, least(1.0::DOUBLE, q + x))), 6) AS quality FROM l GROUP BY stream_id, session"""))
def w21(s, d):
    return t.running_quality(v.frames(s, d), session=1024)


@query("w22_silence_runs", sql("""WITH r AS (SELECT *, sum((level >= 8)::INT) OVER (PARTITION BY stream_id ORDER BY ts) AS run FROM (SELECT stream_id, ts, latency AS level FROM $frames)),
    q AS (SELECT stream_id, run, min(ts) AS start, max(ts) AS "end", count(*) AS n, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS seconds FROM r WHERE level < 8 GROUP BY 1, 2)
    SELECT stream_id, start, "end", n, seconds, CASE WHEN seconds >= 600 THEN 'critical' ELSE 'warning' END AS severity FROM q WHERE seconds >= 60"""))
def w22(s, d):
    return t.silence_runs(v.frames(s, d).withColumn("level", F.col("latency")), threshold=8, warn_s=60, critical_s=600)


@query("w23_zero_crossing_rate", """WITH x AS (SELECT vec_id, unnest(embedding) AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT vec_id, ((x >= 0) <> (lag(x) OVER (PARTITION BY vec_id ORDER BY i) >= 0))::INT AS c FROM x)
    SELECT vec_id, round(sum(c) / (count(*) - 1), 6) AS zero_crossing_rate FROM c GROUP BY 1""")
def w23(s, d):
    return t.zero_crossing_rate(v.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")), "vec_id", span=100)


@query("w24_target_deviation", sql("SELECT stream_id, frame_no, abs(value - 20.0) > 0.1 * 20.0 AS off_target, min(value) OVER w AS low, max(value) OVER w AS high FROM $measurements WINDOW w AS (PARTITION BY stream_id, metric ORDER BY frame_no)"))
def w24(s, d):
    return t.target_deviation(v.measurements(s, d), F.lit(20.0), ["stream_id", "metric"], "frame_no", span=SPAN).select("stream_id", "frame_no", "off_target", "low", "high")


@query("t01_dedupe", sql("SELECT stream_id, level_no, count(*) AS copies FROM $frames GROUP BY 1, 2"))
def t01(s, d):
    from muxlake.operators.catalog import dedupe_frames

    return dedupe_frames(v.frames(s, d), ["stream_id", "level_no"])


@query("t05_service_status", sql("SELECT stream_id, sid, ts, (epoch_us(lead(ts) OVER (PARTITION BY stream_id, sid ORDER BY ts)) - epoch_us(ts)) / 1e6 AS gap_s FROM (SELECT event_type AS stream_id, user_id AS sid, ts FROM events) QUALIFY gap_s IS NULL OR gap_s > 3600"))
def t05(s, d):
    return t.service_status(v.table(s, d, "events").select(F.col("event_type").alias("stream_id"), F.col("user_id").alias("sid"), "ts"), 3600)


@query("t07_failover", sql("""WITH h AS (SELECT stream_id, frame_no, latency >= 4 AS healthy FROM $frames),
    m AS (SELECT *, CASE WHEN NOT healthy THEN true WHEN min(healthy::INT) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS 2 PRECEDING) = 1 AND count(*) OVER (PARTITION BY stream_id ORDER BY frame_no ROWS 2 PRECEDING) >= 3 THEN false END AS mark FROM h),
    o AS (SELECT *, coalesce(last_value(mark IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_no), false) AS on_backup FROM m),
    w AS (SELECT *, (on_backup AND NOT coalesce(lag(on_backup) OVER (PARTITION BY stream_id ORDER BY frame_no), false))::INT AS switched FROM o)
    SELECT stream_id, frame_no, on_backup, sum(switched) OVER (PARTITION BY stream_id ORDER BY frame_no)::BIGINT AS failovers FROM w"""))
def t07(s, d):
    return t.failover(v.frames(s, d).withColumn("healthy", F.col("latency") >= 4), span=SPAN).select("stream_id", "frame_no", "on_backup", "failovers")


@query("t09_bandwidth", sql("SELECT stream_id, date_trunc('second', ts) AS window_start, round(sum(n_bytes) * 8 / 1e6, 9) AS mbit_s FROM $packets GROUP BY 1, 2"))
def t09(s, d):
    return t.bandwidth(v.packets(s, d))


@query("t10_sliding_metrics", sql("""WITH w AS (SELECT metric, value, time_bucket(INTERVAL 1 MINUTE, ts) - to_minutes(unnest(range(5))) AS window_start FROM $measurements) SELECT metric, window_start, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY 1, 2"""))
def t10(s, d):
    return t.sliding_metrics(v.measurements(s, d))


@query("t11_outage_sessions", sql("""WITH e AS (SELECT stream_id, ts FROM $errors WHERE category = 'error'), g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY stream_id ORDER BY ts) > INTERVAL 10 MINUTES, true) AS new FROM e),
    s AS (SELECT *, sum(new::INT) OVER (PARTITION BY stream_id ORDER BY ts) AS k FROM g), w AS (SELECT stream_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM s GROUP BY stream_id, k)
    SELECT *, CASE WHEN epoch_us("end") - epoch_us(start) >= 120e6 THEN 'critical' WHEN epoch_us("end") - epoch_us(start) >= 30e6 THEN 'warning' ELSE 'info' END AS severity FROM w"""))
def t11(s, d):
    return t.outage_sessions(v.errors(s, d).where("category = 'error'"))


@query("t12_reconfig_rate", sql("SELECT stream_id, date_trunc('hour', ts) AS window_start, count(*) AS n, CASE WHEN count(*) >= 10 THEN 'critical' WHEN count(*) >= 3 THEN 'warning' ELSE 'info' END AS severity FROM $figs WHERE fig_type = 0 GROUP BY 1, 2"))
def t12(s, d):
    return t.reconfig_rate(v.figs(s, d).where("fig_type = 0"))


@query("t13_error_rates", sql("SELECT stream_id, date_trunc('hour', ts) AS window_start, count(*) AS n, round(count(*) FILTER (errored) / count(*), 6) AS rate, CASE WHEN count(*) FILTER (errored) / count(*) >= 0.05 THEN 'critical' WHEN count(*) FILTER (errored) / count(*) >= 0.01 THEN 'warning' ELSE 'info' END AS severity FROM $frames GROUP BY 1, 2"))
def t13(s, d):
    return t.error_rates(v.frames(s, d))


@query("t14_announcement_events", sql("""WITH b AS (SELECT *, coalesce(lag(asw) OVER (PARTITION BY stream_id, cluster ORDER BY frame_no), 0) AS b FROM $switches)
    SELECT stream_id, cluster, frame_no, CASE WHEN asw <> 0 AND b = 0 THEN 'start' WHEN asw <> 0 THEN 'active' ELSE 'end' END AS event, asw & 1 = 1 AS emergency FROM b WHERE asw <> 0 OR b <> 0"""))
def t14(s, d):
    return t.announcement_events(v.switches(s, d), SPAN).select("stream_id", "cluster", "frame_no", "event", "emergency")


@query("t16_frame_loss", sql("SELECT stream_id, date_trunc('hour', ts) AS window_start, count(*) AS n, round(count(*) / 100, 6) AS receive_rate, round(avg(latency), 6) AS avg_latency, max(latency) AS max_latency, count(*) / 100 >= 0.95 AS good FROM $frames GROUP BY 1, 2"))
def t16(s, d):
    return t.frame_loss(v.frames(s, d))


@query("t17_late_frames", sql("SELECT stream_id, frame_no, round((epoch_us(max(ts) OVER (PARTITION BY stream_id ORDER BY frame_no % 97, frame_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) - epoch_us(ts)) / 1e6, 6) AS behind_s FROM $frames QUALIFY behind_s > 600"))
def t17(s, d):
    f = v.frames(s, d).withColumn("arrived", F.struct(F.col("frame_no") % 97, "frame_no"))
    return t.late_frames(f, 600, "arrived", 10).select("stream_id", "frame_no", "behind_s")
