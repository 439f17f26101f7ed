"""Queries of the report as one tree and of mergeable sketches."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.operators import reports
from muxlake.operators import sketches as sk
from muxlake.plans import views as v
from muxlake.plans.views import query, sql

ensembles = v.view("report_ensembles", "SELECT concat('S', n_nationkey) AS stream_id, 4096 + n_nationkey AS eid, n_name AS label FROM {nation} WHERE n_nationkey < 20")
services = v.view("report_services", "SELECT concat('S', c_nationkey % 16) AS stream_id, c_custkey AS sid, c_name AS label, CASE WHEN c_custkey % 3 = 0 THEN 'data' ELSE 'audio' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'idle' ELSE 'active' END AS status FROM {customer} WHERE c_custkey % 25 = 0")
subchannels = v.view("report_subchannels", "SELECT concat('S', s_nationkey % 16) AS stream_id, CAST(s_suppkey % 64 AS INT) AS sub_channel_id, CAST(s_suppkey * 7 % 800 AS INT) AS start_address, CAST(24 + s_suppkey % 40 AS INT) AS size FROM {supplier} WHERE s_nationkey < 20")
breaches = v.view("report_violations", "SELECT concat('S', l_suppkey % 16) AS stream_id, concat('R', l_linenumber) AS rule_id, CASE WHEN l_discount < 0.015 THEN 'critical' WHEN l_discount < 0.035 THEN 'error' WHEN l_discount < 0.075 THEN 'warning' ELSE 'info' END AS severity FROM {lineitem} WHERE l_orderkey % 700 = 0")

TREE = """WITH f AS (SELECT stream_id, {'total_frames': count(*), 'valid_frames': count(*) FILTER (valid), 'error_frames': count(*) FILTER (NOT valid), 'duration_ms': count(*) * 24, 'success': (count(*) FILTER (valid) * 10000) // count(*)} AS stream,
      {'dropped': count(*) FILTER (dropped), 'errored': count(*) FILTER (errored), 'worst_latency_us': floor(max(latency) * 1000)::BIGINT} AS performance FROM $frames GROUP BY 1),
    e AS (SELECT stream_id, min({'eid': eid, 'label': label}) AS ensemble FROM $report_ensembles GROUP BY 1),
    s AS (SELECT stream_id, {'summary': {'n': count(*), 'audio': count(*) FILTER (kind = 'audio'), 'data': count(*) FILTER (kind = 'data'), 'active': count(*) FILTER (status = 'active')}, 'items': list({'sid': sid, 'label': label, 'kind': kind, 'status': status} ORDER BY sid)} AS services FROM $report_services GROUP BY 1),
    u AS (SELECT stream_id, {'summary': {'used_units': sum(size)::BIGINT, 'free_units': 864 - sum(size)::BIGINT, 'used': (sum(size)::BIGINT * 10000) // 864}, 'items': list({'sub_channel_id': sub_channel_id, 'start_address': start_address, 'size': size} ORDER BY sub_channel_id, start_address, size)} AS subchannels FROM $report_subchannels GROUP BY 1),
    k AS (SELECT stream_id, fig_type, ext, count(*) AS n, count(*) FILTER (NOT crc_ok) AS bad FROM $figs GROUP BY ALL),
    g AS (SELECT stream_id, list({'fig_type': fig_type, 'ext': ext, 'n': n, 'crc_failures': bad} ORDER BY fig_type, ext) AS figs, {'figs': sum(n)::BIGINT, 'crc_failures': sum(bad)::BIGINT, 'healthy': ((sum(n) - sum(bad))::BIGINT * 10000) // sum(n)::BIGINT} AS fic_health,
      {'type_0': coalesce(sum(n) FILTER (fig_type = 0), 0)::BIGINT, 'type_1': coalesce(sum(n) FILTER (fig_type = 1), 0)::BIGINT, 'others': coalesce(sum(n) FILTER (fig_type > 1), 0)::BIGINT} AS fig_stats FROM k GROUP BY 1),
    r AS (SELECT stream_id, list({'rule_id': rule_id, 'n': n} ORDER BY rule_id) AS rules FROM (SELECT stream_id, rule_id, count(*) AS n FROM $report_violations GROUP BY ALL) GROUP BY 1),
    c AS (SELECT v.stream_id, {'summary': {'violations': count(*), 'critical': count(*) FILTER (severity = 'critical'), 'error': count(*) FILTER (severity = 'error'), 'warning': count(*) FILTER (severity = 'warning'), 'info': count(*) FILTER (severity = 'info'),
      'score': greatest(0, 10000 - sum(CASE severity WHEN 'critical' THEN 1500 WHEN 'error' THEN 500 WHEN 'warning' THEN 100 ELSE 10 END))::BIGINT}, 'rules': any_value(rules)} AS compliance FROM $report_violations v JOIN r ON r.stream_id = v.stream_id GROUP BY 1)
    SELECT f.stream_id, to_json({'stream': stream, 'ensemble': ensemble, 'services': services, 'subchannels': subchannels, 'figs': figs, 'fic_health': fic_health, 'fig_stats': fig_stats, 'compliance': compliance, 'performance': performance})::VARCHAR AS report
    FROM f JOIN e ON e.stream_id = f.stream_id JOIN s ON s.stream_id = f.stream_id JOIN u ON u.stream_id = f.stream_id JOIN g ON g.stream_id = f.stream_id JOIN c ON c.stream_id = f.stream_id"""


@query("s13_report_tree", sql(TREE))
def s13_tree(s, d):
    t = reports.report_tree(v.frames(s, d), s.sql(v.VIEWS["report_ensembles"], nation=v.table(s, d, "nation")), services(s, d), subchannels(s, d), v.figs(s, d), breaches(s, d))
    whole = [F.col(f"report.{c}").isNotNull() for c in ("stream", "ensemble", "services.summary", "subchannels.summary", "fic_health", "compliance.summary")]
    for w in whole:  # streams that all tables have
        t = t.where(w)
    return t.select("stream_id", F.to_json("report").alias("report"))


@query("a25_sketched_percentiles", sql("SELECT metric, count(*) AS n, min(value) AS least, max(value) AS most, true AS median_near, true AS p95_near, true AS p99_near FROM $measurements GROUP BY 1"))
def a25_sketched(s, d):
    """Hours are sketched, the day is merged from them; a quantile's true rank must be within 2 % of what was asked."""
    m = v.measurements(s, d)
    day = sk.answers(sk.merge_spans(sk.sketch_spans(m, ["metric", "stream_id"]), ["metric"]))
    below = lambda q, p: F.abs(F.count_if(F.col("value") <= F.col(q)) / F.count("*") - p) < 0.02
    ranks = m.join(day.select("metric", "q50", "q95", "q99"), "metric").groupBy("metric").agg(below("q50", 0.5).alias("median_near"), below("q95", 0.95).alias("p95_near"), below("q99", 0.99).alias("p99_near"))
    return day.select("metric", "n", "least", "most").join(ranks, "metric")


@query("a41_sketched_services", "SELECT event_type, count(*) AS n, true AS near FROM events GROUP BY 1")
def a41_sketched(s, d):
    """Users of each hour are sketched and merged; the count must be within 5 % of the true one."""
    e = v.table(s, d, "events")
    got = sk.answers(sk.merge_spans(sk.sketch_spans(e, ["event_type"], value=None, distinct=["user_id"]), ["event_type"]))
    true = e.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"))
    return got.join(true, "event_type").select("event_type", "n", (F.abs(F.col("n_user_id") - F.col("users")) <= 0.05 * F.col("users")).alias("near"))
