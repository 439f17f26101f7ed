"""Queries of the catalogue: joins, merges, ordering and sets (J-, O-, U-, P-predicates) over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.operators import catalog as c
from muxlake.plans import views as v
from muxlake.plans.views import query, sql


@query("j01_components_x_subchannels", sql("SELECT a.stream_id, a.sid, a.sub_channel_id, b.size, b.size * 8 AS bitrate FROM $services a LEFT JOIN $subchannels b USING (stream_id, sub_channel_id)"))
def j01(s, d):
    return c.components_x_subchannels(v.services(s, d), v.subchannels(s, d)).select("stream_id", "sid", "sub_channel_id", "size", "bitrate")


@query("j02_used_by_services", sql("""WITH n AS (SELECT DISTINCT stream_id, sub_channel_id, CASE WHEN label <> '' THEN label ELSE 'SId 0x' || printf('%X', sid) END AS name FROM $services)
    SELECT b.stream_id, b.sub_channel_id, coalesce(u, '') AS used_by FROM $subchannels b LEFT JOIN (SELECT stream_id, sub_channel_id, string_agg(name, ',' ORDER BY name) AS u FROM n GROUP BY 1, 2) USING (stream_id, sub_channel_id)"""))
def j02(s, d):
    x = v.services(s, d)
    return c.used_by_services(v.subchannels(s, d), x.select("stream_id", "sid", "sub_channel_id"), x.select("stream_id", "sid", "label"))


@query("j03_packet_components", sql("""WITH p AS (SELECT stream_id, sub_channel_id, arg_min(start_address % 64, start_address) AS dscty FROM $subchannels GROUP BY 1, 2)
    SELECT a.stream_id, a.sid, dscty, CASE WHEN dscty IS NOT NULL THEN 3 ELSE tmid END AS tmid FROM $services a LEFT JOIN p USING (stream_id, sub_channel_id)"""))
def j03(s, d):
    p = v.subchannels(s, d).select("stream_id", "sub_channel_id", (F.col("start_address") % 64).alias("dscty"), F.col("start_address").alias("seq"))
    return c.packet_components(v.services(s, d), p).select("stream_id", "sid", "dscty", "tmid")


@query("j04_labels_x_services", sql("SELECT coalesce(a.stream_id, b.stream_id) AS stream_id, coalesce(a.sid, b.sid) AS sid, coalesce(b.label, a.label, '') AS label, a.sid IS NOT NULL AS organised FROM $services a FULL JOIN $labels_ b ON a.stream_id = b.stream_id AND a.sid = b.sid"))
def j04(s, d):
    return c.labels_x_services(v.services(s, d).withColumn("organised", F.lit(True)), v.labels(s, d))


@query("j05_country_lookup", "SELECT s_suppkey, coalesce(CASE WHEN n_nationkey % 5 <> 0 THEN n_name END, 'Unknown') AS country FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey")
def j05(s, d):
    dim = v.table(s, d, "nation").where("n_nationkey % 5 <> 0").select(F.col("n_nationkey").alias("s_nationkey"), F.col("n_name").alias("country"))
    return c.lookup(v.table(s, d, "supplier"), dim, ["s_nationkey"], "country").select("s_suppkey", "country")


@query("j07_overlapping_subchannels", sql("""SELECT a.stream_id, a.sub_channel_id AS a_id, b.sub_channel_id AS b_id, least(a.start_address + a.size, b.start_address + b.size) - greatest(a.start_address, b.start_address) AS overlap
    FROM $subchannels a JOIN $subchannels b ON a.stream_id = b.stream_id AND a.sub_channel_id < b.sub_channel_id AND a.start_address < b.start_address + b.size AND b.start_address < a.start_address + a.size"""))
def j07(s, d):
    return c.overlapping_subchannels(v.subchannels(s, d))


@query("j08_frequency_plan_match", """WITH p AS (SELECT DISTINCT p_retailprice AS plan_mhz FROM part) SELECT l_orderkey, l_linenumber, l_partkey, mhz, plan_mhz FROM (SELECT *, round(l_extendedprice / 50, 3) AS mhz FROM lineitem) LEFT JOIN p ON abs(mhz - plan_mhz) < 0.0101""")
def j08(s, d):
    plan = v.table(s, d, "part").select(F.col("p_retailprice").alias("plan_mhz")).distinct()
    m = v.table(s, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(F.col("l_extendedprice") / 50, 3).alias("mhz"))
    return c.frequency_plan_match(m, plan, 0.0101)


@query("j09_tii_sub_to_main", """WITH g AS (SELECT l_orderkey AS fig_key, l_partkey % 3 AS main_id, l_linenumber, l_extendedprice AS pos, l_quantity AS lat, l_tax AS lon FROM lineitem), m AS (SELECT fig_key, main_id, arg_min(lat, pos) AS la, arg_min(lon, pos) AS lo FROM g WHERE l_linenumber <= 2 GROUP BY 1, 2)
    SELECT fig_key, main_id, pos, round(la + l_linenumber * 90.0 / 524288.0, 6) AS latitude, round(lo + l_linenumber * 180.0 / 524288.0, 6) AS longitude FROM g LEFT JOIN m USING (fig_key, main_id) WHERE l_linenumber > 2""")
def j09(s, d):
    n = F.col("l_linenumber")
    g = v.table(s, d, "lineitem").select(F.col("l_orderkey").alias("fig_key"), (F.col("l_partkey") % 3).alias("main_id"), F.col("l_extendedprice").alias("pos"), (n <= 2).alias("is_main"), F.col("l_quantity").alias("latitude"), F.col("l_tax").alias("longitude"), n.alias("lat_offset"), n.alias("lon_offset"))
    return c.tii_sub_to_main(g).select("fig_key", "main_id", "pos", "latitude", "longitude")


@query("j10_unknown_subchannels", sql("SELECT stream_id, sid, sub_channel_id FROM $services a WHERE NOT EXISTS (SELECT 1 FROM $subchannels b WHERE a.stream_id = b.stream_id AND a.sub_channel_id = b.sub_channel_id)"))
def j10(s, d):
    return c.unknown_subchannels(v.services(s, d), v.subchannels(s, d)).select("stream_id", "sid", "sub_channel_id")


@query("j11_epg_now_next", sql("""WITH e AS (SELECT * FROM $schedule), t AS (SELECT DISTINCT o_custkey AS service_id, o_orderdate + INTERVAL 5 DAYS AS "at" FROM orders),
    a AS (SELECT service_id, "at", max({'start_time': start_time, 'event_id': event_id, 'end_time': end_time}) AS x FROM t JOIN e USING (service_id) WHERE start_time <= "at" GROUP BY 1, 2), b AS (SELECT service_id, "at", min({'start_time': start_time, 'event_id': event_id, 'end_time': end_time}) AS y FROM t JOIN e USING (service_id) WHERE start_time > "at" GROUP BY 1, 2)
    SELECT t.service_id, t."at", CASE WHEN x.end_time > t."at" THEN x.event_id END::VARCHAR AS now_event, y.event_id::VARCHAR AS next_event FROM t LEFT JOIN a USING (service_id, "at") LEFT JOIN b USING (service_id, "at")"""))
def j11(s, d):
    e = v.schedule(s, d)
    t = e.select("service_id", (F.col("start_time") + F.expr("INTERVAL 5 DAYS")).alias("at")).distinct()
    return c.now_next(e, t).withColumns({x: F.col(x).cast("string") for x in ("now_event", "next_event")})


@query("j12_resolve_links", "SELECT a.o_orderkey AS object_id, b.o_orderpriority AS target_title FROM orders a LEFT JOIN orders b ON a.o_custkey * 7 = b.o_orderkey")
def j12(s, d):
    o = v.table(s, d, "orders").select(F.col("o_orderkey").alias("object_id"), (F.col("o_custkey") * 7).alias("link_target"), F.col("o_orderpriority").alias("title"))
    return c.resolve_links(o).select("object_id", "target_title")


@query("j13_menu_tree", """WITH m AS (SELECT p_partkey AS menu_id, CASE WHEN p_partkey > 0 THEN p_partkey // 4 END AS parent_id, p_name AS title FROM part)
    SELECT m.menu_id, m.parent_id::VARCHAR AS parent_id, m.title, p.title AS parent_title, coalesce(k.n, 0) AS children FROM m LEFT JOIN m p ON m.parent_id = p.menu_id LEFT JOIN (SELECT parent_id, count(*) AS n FROM m WHERE parent_id IS NOT NULL GROUP BY 1) k ON k.parent_id = m.menu_id""")
def j13(s, d):
    m = v.table(s, d, "part").select(F.col("p_partkey").alias("menu_id"), F.when(F.col("p_partkey") > 0, F.floor(F.col("p_partkey") / 4)).alias("parent_id"), F.col("p_name").alias("title"))
    return c.menu_tree(m).withColumn("parent_id", F.col("parent_id").cast("string"))


@query("j14_service_ecc", sql("SELECT a.stream_id, a.sid, CASE WHEN a.ecc = 0 THEN coalesce(n.e, 0) ELSE a.ecc END AS ecc FROM $services a LEFT JOIN (SELECT 'M' || n_nationkey AS stream_id, 224 + n_regionkey AS e FROM nation) n USING (stream_id)"))
def j14(s, d):
    e = v.table(s, d, "nation").select(F.concat(F.lit("M"), F.col("n_nationkey")).alias("stream_id"), (F.col("n_regionkey") + 224).alias("ecc"))
    return c.service_ecc(v.services(s, d), e).select("stream_id", "sid", "ecc")


@query("j15_merge_redundant", sql("""WITH e AS (SELECT 'S' || (user_id % 16) AS stream_id, event_id AS seq, event_type AS payload FROM events), p AS (SELECT * FROM e WHERE seq % 11 <> 0), b AS (SELECT stream_id, seq, upper(payload) AS payload FROM e WHERE seq % 17 <> 0)
    SELECT stream_id, seq, CASE WHEN p.payload IS NULL OR (seq % 5 = 0 AND b.payload IS NOT NULL) THEN b.payload ELSE p.payload END AS payload, CASE WHEN p.payload IS NULL OR (seq % 5 = 0 AND b.payload IS NOT NULL) THEN 'backup' ELSE 'primary' END AS used FROM p FULL JOIN b USING (stream_id, seq)"""))
def j15(s, d):
    e = v.table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("payload"))
    state = e.where("seq % 5 = 0").select("stream_id", "seq", F.lit(True).alias("on_backup"))
    return c.merge_redundant(e.where("seq % 11 <> 0"), e.where("seq % 17 <> 0").withColumn("payload", F.upper("payload")), state)


@query("j16_compare_streams", sql("""WITH f AS (SELECT stream_id, count(*) AS n_frames, round(100 * avg(valid::INT), 6) AS quality FROM $frames GROUP BY 1), s AS (SELECT 'S' || (sid % 20) AS stream_id, count(DISTINCT sid) AS n_services FROM $services GROUP BY 1),
    o AS (SELECT stream_id, coalesce(n_frames, 0) AS n_frames, quality, coalesce(n_services, 0) AS n_services FROM f FULL JOIN s USING (stream_id)) SELECT *, min(n_frames) OVER () > 0 AND (max(n_frames) OVER () - min(n_frames) OVER ()) / min(n_frames) OVER () <= 0.05 AS in_step FROM o"""))
def j16(s, d):
    return c.compare_streams(v.frames(s, d), v.services(s, d).withColumn("stream_id", F.concat(F.lit("S"), F.col("sid") % 20)))


@query("j17_announcements_active", sql("SELECT DISTINCT a.stream_id, cluster, a.sub_channel_id, sid FROM $switches a JOIN (SELECT 'S' || (sid % 16) AS stream_id, sub_channel_id, sid FROM $services) b ON a.stream_id = b.stream_id AND a.sub_channel_id = b.sub_channel_id WHERE asw <> 0"))
def j17(s, d):
    return c.announcements_active(v.switches(s, d), v.services(s, d).withColumn("stream_id", F.concat(F.lit("S"), F.col("sid") % 16))).select("stream_id", "cluster", "sub_channel_id", "sid")


@query("j18_user_app_services", sql("SELECT stream_id, sid FROM $services WHERE (stream_id, sid) IN (SELECT stream_id, sid FROM $apps WHERE app_type IN (2, 4))"))
def j18(s, d):
    return c.user_app_services(v.services(s, d), v.apps(s, d), [2, 4]).select("stream_id", "sid")


@query("j19_label_source", sql("""SELECT a.stream_id, a.sid, coalesce(l.label, nullif(a.label, ''), '') AS label, CASE WHEN l.label IS NOT NULL THEN 'first' WHEN a.label <> '' THEN 'second' ELSE 'none' END AS source FROM $services a LEFT JOIN $labels_ l USING (stream_id, sid)"""))
def j19(s, d):
    x = v.services(s, d)
    return c.label_source(x, v.labels(s, d), x.where("label <> ''"))


@query("j20_missing_labels", sql("SELECT stream_id, sid FROM $services WHERE (stream_id, sid) NOT IN (SELECT stream_id, sid FROM $labels_ WHERE label <> '')"))
def j20(s, d):
    return c.missing_labels(v.services(s, d), v.labels(s, d)).select("stream_id", "sid")


@query("a05_ensemble_catalog", sql("""WITH r AS (SELECT 'S' || (user_id % 16) AS stream_id, user_id % 8 AS eid, event_id AS f, CASE WHEN value > 10 THEN event_type ELSE '' END AS l, CASE WHEN value > 30 THEN upper(event_type) END AS s, CASE WHEN value > 5 THEN 224 + event_id % 3 ELSE 0 END AS e, value > 50 AS a FROM events)
    SELECT stream_id, eid, min(f) AS first_frame, arg_min(l, f) FILTER (l <> '') AS label, arg_min(s, f) FILTER (s <> '') AS short_label, arg_min(e, f) FILTER (e <> 0) AS ecc, bool_or(a) AS alarm FROM r GROUP BY 1, 2"""))
def a05(s, d):
    e = v.table(s, d, "events")
    big = lambda x: F.col("value") > x
    r = e.select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), (F.col("user_id") % 8).alias("eid"), F.col("event_id").alias("frame_no"), F.when(big(10), F.col("event_type")).otherwise("").alias("label"), F.when(big(30), F.upper("event_type")).alias("short_label"), F.when(big(5), 224 + F.col("event_id") % 3).otherwise(0).alias("ecc"), big(50).alias("alarm"))
    return c.ensemble_catalog(r)


@query("a06_service_catalog", sql("""WITH r AS (SELECT 'S' || (user_id % 16) AS stream_id, user_id AS sid, event_id AS f, CASE WHEN value > 10 THEN event_type ELSE '' END AS l, length(event_type) AS sc, event_id % 64 AS a FROM events),
    p AS (SELECT stream_id, sid, sc, arg_min(a, f) AS a FROM r GROUP BY 1, 2, 3), q AS (SELECT stream_id, sid, string_agg(sc || ':' || a, ',' ORDER BY sc) AS components FROM p GROUP BY 1, 2)
    SELECT stream_id, sid, min(f) AS first_frame, arg_min(l, f) FILTER (l <> '') AS label, any_value(components) AS components FROM r JOIN q USING (stream_id, sid) GROUP BY 1, 2"""))
def a06(s, d):
    e = v.table(s, d, "events")
    r = e.select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), F.col("user_id").alias("sid"), F.col("event_id").alias("frame_no"), F.when(F.col("value") > 10, F.col("event_type")).otherwise("").alias("label"), F.length("event_type").alias("sub_channel_id"), (F.col("event_id") % 64).alias("asc_ty"))
    return c.service_catalog(r).withColumn("components", F.array_join(F.transform("components", lambda x: F.concat_ws(":", x["sub_channel_id"].cast("string"), x["asc_ty"].cast("string"))), ","))


A07_SQL = sql("""WITH r AS (SELECT 'S' || (user_id % 16) AS stream_id, user_id % 64 AS sub_channel_id, event_id // 2 AS frame_no, CASE WHEN event_type IN ('view', 'click') THEN 0 ELSE 1 END AS source, event_id % 100 AS size FROM events)
    SELECT stream_id, sub_channel_id, arg_min(frame_no, (frame_no * 2 + source) * 1000 + size) AS frame_no, arg_min(size, (frame_no * 2 + source) * 1000 + size) AS size, arg_min(source, (frame_no * 2 + source) * 1000 + size) AS source FROM r GROUP BY 1, 2""")


@query("a07_subchannel_catalog", A07_SQL)
def a07(s, d):
    e = v.table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), (F.col("user_id") % 64).alias("sub_channel_id"), F.floor(F.col("event_id") / 2).alias("frame_no"), (F.col("event_id") % 100).alias("size"), F.col("event_type").isin("view", "click").alias("stc"))
    return c.union_subchannels(e.where("stc").drop("stc"), e.where("NOT stc").drop("stc"))


@query("o01_order_by_sid", sql("SELECT sid, stream_id, label FROM $services ORDER BY sid"))
def o01(s, d):
    return v.services(s, d).select("sid", "stream_id", "label").orderBy("sid")


@query("o02_top_k_frames", sql("SELECT fig_type, ext, frame_no, rn FROM (SELECT *, row_number() OVER (PARTITION BY fig_type, ext ORDER BY frame_no)::INT AS rn FROM $figs) WHERE rn <= 64"))
def o02(s, d):
    return c.top_k(v.figs(s, d), ["fig_type", "ext"], [F.col("frame_no")], 64).select("fig_type", "ext", "frame_no", "rn")


@query("o03_latest_n", sql("SELECT stream_id, frame_no FROM $frames ORDER BY frame_no DESC LIMIT 500"))
def o03(s, d):
    return v.frames(s, d).select("stream_id", "frame_no").orderBy(F.col("frame_no").desc()).limit(500)


@query("o04_lru_cap", sql("""WITH k AS (SELECT 'S' || (user_id % 16) AS stream_id, user_id AS key, max(event_id) AS last_activity FROM events GROUP BY 1, 2), a AS (SELECT *, max(last_activity) OVER (PARTITION BY stream_id) AS now FROM k)
    SELECT stream_id, key, last_activity, row_number() OVER (PARTITION BY stream_id ORDER BY last_activity DESC, key)::INT AS rn FROM a WHERE now - last_activity <= 5000 QUALIFY rn <= 5"""))
def o04(s, d):
    k = v.table(s, d, "events").groupBy(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), F.col("user_id").alias("key")).agg(F.max("event_id").alias("last_activity"))
    return c.lru_cap(k, 5, 5000)


@query("o05_alerts_by_priority", sql("SELECT alert_id, severity * 1000 + CASE WHEN active THEN 500 ELSE 0 END AS priority FROM $alerts WHERE severity >= 3 AND category = 2 ORDER BY priority DESC, alert_id"))
def o05(s, d):
    from muxlake.operators.health import alert_priority

    return alert_priority(v.alerts(s, d).where("severity >= 3 AND category = 2")).select("alert_id", "priority").orderBy(F.col("priority").desc(), "alert_id")


@query("u02_mandatory_figs_missing", sql("""WITH m AS (SELECT DISTINCT stream_id, unnest([0, 0, 0, 1, 1]) AS fig_type, unnest([4, 5, 6, 7, 8]) AS ext FROM $figs) SELECT stream_id, fig_type, ext FROM m EXCEPT SELECT stream_id, fig_type, ext FROM $figs"""))
def u02(s, d):
    f = v.figs(s, d)
    return c.mandatory_missing(f, f, [(0, 4), (0, 5), (0, 6), (1, 7), (1, 8)])


@query("u03_common_services", """WITH x AS (SELECT user_id AS sid FROM events WHERE event_type = 'view' AND user_id % 3 <> 0), y AS (SELECT user_id AS sid FROM events WHERE event_type = 'click')
    SELECT sid, 'both' AS where_ FROM (SELECT * FROM x INTERSECT SELECT * FROM y) UNION ALL SELECT sid, 'first' FROM (SELECT * FROM x EXCEPT SELECT * FROM y) UNION ALL SELECT sid, 'second' FROM (SELECT * FROM y EXCEPT SELECT * FROM x)""")
def u03(s, d):
    x = v.table(s, d, "events").select(F.col("user_id").alias("sid"), F.col("event_type").alias("stream_id")).where("stream_id <> 'view' OR sid % 3 <> 0")
    return c.common_services(x, "view", "click")


@query("u04_merge_sources", "SELECT o_orderkey AS object_id, o_orderpriority AS title, 'object' AS source FROM orders UNION ALL SELECT l_orderkey * 10 + l_linenumber, l_returnflag, 'stream' FROM lineitem")
def u04(s, d):
    a = v.table(s, d, "orders").select(F.col("o_orderkey").alias("object_id"), F.col("o_orderpriority").alias("title"), F.lit("object").alias("source"))
    b = v.table(s, d, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("object_id"), F.col("l_returnflag").alias("title"), F.lit("stream").alias("source"))
    return a.unionByName(b)


@query("p28_filter_services", sql("SELECT sid FROM $services WHERE contains(lower(label), '#0000001') OR contains(lower(kind), '#0000001')"))
def p28(s, d):
    return c.filter_services(v.services(s, d), "#0000001", ["label", "kind"]).select("sid")


@query("p29_filter_violations", sql("SELECT stream_id, frame_no, rule_id FROM $violations WHERE severity IN ('critical', 'error') AND category = 'R'"))
def p29(s, d):
    return v.violations(s, d).where("severity IN ('critical', 'error') AND category = 'R'").select("stream_id", "frame_no", "rule_id")


@query("p30_frames_of_service", sql("SELECT stream_id, frame_no FROM $frames WHERE (stream_id, frame_no % 64) IN (SELECT 'S' || (sid % 16), sub_channel_id FROM $services WHERE kind = 'data')"))
def p30(s, d):
    x = v.services(s, d).where("kind = 'data'").select(F.concat(F.lit("S"), F.col("sid") % 16).alias("stream_id"), "sub_channel_id")
    return v.frames(s, d).withColumn("sub_channel_id", (F.col("frame_no") % 64).cast("int")).join(x, ["stream_id", "sub_channel_id"], "left_semi").select("stream_id", "frame_no")


@query("p31_fig_enabled", sql("SELECT stream_id, frame_no FROM $figs WHERE NOT (fig_type = 0 AND ext = 5)"))
def p31(s, d):
    return v.figs(s, d).where("NOT (fig_type = 0 AND ext = 5)").select("stream_id", "frame_no")


@query("p34_query_logs", sql("SELECT entry_id, ts, severity FROM $logs WHERE severity IN ('critical', 'error') AND category IN ('error', 'click') AND contains(message, '9') AND ts >= TIMESTAMP '2024-01-02 00:00:00' ORDER BY ts DESC LIMIT 200"))
def p34(s, d):
    x = v.logs(s, d).where("severity IN ('critical', 'error') AND category IN ('error', 'click') AND contains(message, '9') AND ts >= TIMESTAMP '2024-01-02 00:00:00'")
    return x.orderBy(F.col("ts").desc()).limit(200).select("entry_id", "ts", "severity")


@query("s12_limit_frames", sql("SELECT stream_id, frame_no FROM $frames WHERE frame_no < 1000"))
def s12(s, d):
    return v.frames(s, d).where("frame_no < 1000").select("stream_id", "frame_no")


@query("s19_report_scope", sql("SELECT severity, count(*) AS n FROM $violations WHERE stream_id IN ('M1', 'M2', 'M3') AND severity IN ('critical', 'error', 'warning') AND active GROUP BY 1"))
def s19(s, d):
    return v.violations(s, d).where("stream_id IN ('M1', 'M2', 'M3') AND severity IN ('critical', 'error', 'warning') AND active").groupBy("severity").agg(F.count("*").alias("n"))


@query("s20_export_series", sql("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, round(avg(value) FILTER (metric = 'view'), 6) AS view, round(avg(value) FILTER (metric = 'click'), 6) AS click FROM $measurements GROUP BY 1"))
def s20(s, d):
    m = v.measurements(s, d).groupBy(F.window("ts", "1 hour").alias("w")).pivot("metric", ["view", "click"]).agg(F.round(F.avg("value"), 6))
    return m.select(F.col("w.start").alias("window_start"), "view", "click")


@query("r10_roll_up", sql("SELECT category AS standard, count(*) AS rules, round(100.0 * count(*) FILTER (severity NOT IN ('critical', 'error')) / count(*), 6) AS percentage, CASE WHEN percentage >= 95 THEN 'full' WHEN percentage >= 70 THEN 'partial' ELSE 'none' END AS level FROM $violations GROUP BY 1"))
def r10(s, d):
    p = 100.0 * F.count_if(~F.col("severity").isin("critical", "error")) / F.count("*")
    x = v.violations(s, d).groupBy(F.col("category").alias("standard")).agg(F.count("*").alias("rules"), F.round(p, 6).alias("percentage"))
    return x.withColumn("level", F.when(F.col("percentage") >= 95, "full").when(F.col("percentage") >= 70, "partial").otherwise("none"))
