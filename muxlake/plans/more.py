"""Queries of further frame predicates, lookups, statuses and exports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.functions import bits as b
from muxlake.functions import text as t
from muxlake.operators import catalog as c
from muxlake.operators import figs as g
from muxlake.operators import health, reports, timing
from muxlake.operators import rules as r
from muxlake.plans import signalling as sg
from muxlake.plans import views as v
from muxlake.plans.signalling import BASE
from muxlake.plans.views import query, sql
from muxlake.sources import dims
from muxlake.sources import frames as fr


def events(s, d):
    return v.table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), F.col("event_id").alias("frame_no"), "*")


@query("p02_nst_offset", f"SELECT stream_id, frame_no, u % 4 + 1 AS nst {BASE}")
def p02(s, d):
    return fr.frame_header(sg.frames(s, d), nst_offset=1).select("stream_id", "frame_no", "nst")


@query("p06_bitrate", f"SELECT stream_id, frame_no, (192 * (u % 4))::BIGINT AS kbps {BASE} WHERE u % 4 > 0")
def p06(s, d):
    return fr.explode_stc(sg.headers(s, d)).groupBy("stream_id", "frame_no").agg(F.sum("bitrate").alias("kbps"))


@query("p10_crc32_frame", "SELECT event_id, list_reduce(list_prepend(4294967295, list_transform(range(4), lambda k: (event_id >> ((3 - k) * 8)) & 255)), lambda c, b: list_reduce(list_prepend(xor(c::BIGINT, (b << 24)::BIGINT), range(8)), lambda r, k: CASE WHEN (r & 2147483648) <> 0 THEN xor((r << 1)::BIGINT, 79764919::BIGINT) & 4294967295 ELSE (r << 1) & 4294967295 END)) AS crc FROM events")
def p10(s, d):
    return v.table(s, d, "events").select("event_id", b.crc32_frame(b.pack((F.col("event_id"), 4))).bitwiseXOR(0xFFFFFFFF).alias("crc"))


@query("p14_ignore_fib_crc", f"SELECT stream_id, 4 * count(*) AS figs, 2 * count(*) FILTER (e % 20 = 0) AS from_bad_fibs {BASE} GROUP BY 1")
def p14(s, d):
    return sg.figs(s, d, "raw").groupBy("stream_id").agg(F.count("*").alias("figs"), F.count_if(~F.col("crc_ok")).alias("from_bad_fibs"))


@query("p15_fig_extension", "SELECT event_id, CASE user_id % 4 WHEN 0 THEN event_id % 32 WHEN 3 THEN 0 ELSE event_id % 8 END AS ext FROM events")
def p15(s, d):
    return v.table(s, d, "events").select("event_id", g.fig_extension(F.col("user_id") % 4, F.col("event_id") % 256).alias("ext"))


@query("p17_slice_by_address", f"SELECT stream_id, frame_no, i::INT AS sub_channel_id, 192 AS n_bytes FROM (SELECT *, unnest(range(u % 4)) AS i {BASE})")
def p17(s, d):
    m = fr.explode_stc(sg.headers(s, d), keep_raw=True)
    return fr.slice_msc_by_address(m).select("stream_id", "frame_no", "sub_channel_id", F.octet_length("payload").alias("n_bytes"))


@query("p20_timestamp_source", f"SELECT frame_no, epoch_us(TIMESTAMP '2024-01-01 00:00:00') + e * 24000 AS at_us {BASE}")
def p20(s, d):
    return events(s, d).select("frame_no", fr.frame_time(F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("frame_no")).alias("at_us"))


@query("p23_id_validity", sql("SELECT sid, sid % 65536 NOT IN (0, 65535) AS sid_ok, eid NOT IN (0, 65535) AS eid_ok, sub_channel_id < 64 AS sub_channel_ok FROM $services"))
def p23(s, d):
    return v.services(s, d).select("sid", (~(F.col("sid") % 65536).isin(0, 65535)).alias("sid_ok"), (~F.col("eid").isin(0, 65535)).alias("eid_ok"), (F.col("sub_channel_id") < 64).alias("sub_channel_ok"))


@query("p24_full_sid", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4026531840 + event_id ELSE user_id END AS sid FROM events")
def p24(s, d):
    x = v.table(s, d, "events").withColumn("sid32", F.when(F.col("event_id") % 3 == 0, F.lit(4026531840) + F.col("event_id")).otherwise(0))
    return x.select("event_id", F.when(F.col("sid32") > 0xFFFF, F.col("sid32")).otherwise(F.col("user_id")).alias("sid"))


@query("p26_service_type", sql("SELECT stream_id, sid, CASE WHEN kind = 'data' THEN 'Data' WHEN asc_ty = 63 OR asc_ty >= 2 THEN 'DAB+' ELSE 'DAB' END AS type FROM $services"))
def p26(s, d):
    return v.services(s, d).select("stream_id", "sid", F.when(F.col("kind") == "data", "Data").when((F.col("asc_ty") == 0x3F) | (F.col("asc_ty") >= 2), "DAB+").otherwise("DAB").alias("type"))


@query("p27_ecc_override", sql("SELECT sid, 243 AS ecc FROM $services"))
def p27(s, d):
    return v.services(s, d).withColumn("ecc", F.lit(0xF3)).select("sid", "ecc")


@query("p32_fib_hex", f"SELECT stream_id, frame_no, '06 02 ' || substring(printf('%04X', 4096 + u), 1, 2) || ' ' || substring(printf('%04X', 4096 + u), 3, 2) || ' 01' AS head {BASE}")
def p32(s, d):
    x = sg.fibs(s, d).where("fib_no = 1")
    return x.select("stream_id", "frame_no", F.substring(F.rtrim(F.regexp_replace(F.hex("area"), "(..)", "$1 ")), 1, 14).alias("head"))


@query("p33_fig_trace", f"SELECT stream_id, frame_no, format('FIG 1/1 SId 0x{{:04X}} label {{}}', 4096 + u, upper(event_type)) AS line {BASE}")
def p33(s, d):
    x = sg.service_labels(s, d)
    return x.select("stream_id", "frame_no", F.format_string("FIG 1/1 SId 0x%04X label %s", F.col("sid"), F.col("label")).alias("line"))


LANG = "CASE user_id % 100 WHEN 9 THEN 'English' WHEN 15 THEN 'German' WHEN 12 THEN 'French' ELSE 'other' END"


@query("j06_language_lookup", f"SELECT event_id, {LANG} AS language_name FROM events")
def j06(s, d):
    x = c.lookup(v.table(s, d, "events").withColumn("language", (F.col("user_id") % 100).cast("int")), dims.language_table(s), ["language"], "language_name")
    return x.select("event_id", F.when(F.col("language_name").isin("English", "German", "French"), F.col("language_name")).otherwise("other").alias("language_name"))


@query("j06_programme_type_lookup", "SELECT event_id, CASE WHEN user_id % 40 > 31 THEN 'Unknown' WHEN user_id % 40 IN (10, 11, 12, 13, 14, 15, 24, 25, 26, 27, 28) THEN 'Music' ELSE 'other' END AS pty_group FROM events")
def j06b(s, d):
    x = c.lookup(v.table(s, d, "events").withColumn("pty", (F.col("user_id") % 40).cast("int")), dims.programme_type_table(s), ["pty"], "pty_group")
    return x.select("event_id", F.when(F.col("pty_group").isin("Music", "Unknown"), F.col("pty_group")).otherwise("other").alias("pty_group"))


@query("j05_country_of_service", "SELECT event_id, CASE user_id % 256 WHEN 225 THEN 'Germany' WHEN 226 THEN 'France' WHEN 243 THEN 'Thailand' WHEN 227 THEN 'United Kingdom' WHEN 228 THEN 'Italy' WHEN 229 THEN 'Spain' WHEN 230 THEN 'Belgium' WHEN 231 THEN 'Netherlands' WHEN 232 THEN 'Switzerland' WHEN 233 THEN 'Austria' WHEN 234 THEN 'Denmark' WHEN 235 THEN 'Norway' WHEN 236 THEN 'Sweden' WHEN 237 THEN 'Poland' WHEN 238 THEN 'Czech Republic' ELSE 'Unknown' END AS country FROM events")
def j05b(s, d):
    x = v.table(s, d, "events").withColumn("ecc", (F.col("user_id") % 256).cast("int"))
    return c.lookup(x, dims.country_table(s), ["ecc"], "country").select("event_id", "country")


@query("r03_superframe_rules", "SELECT event_id, x.r AS rule_id FROM (SELECT event_id, unnest([{'b': event_id % 7 = 0, 'r': 'fire_code'}, {'b': user_id % 2 = 1 AND event_id % 2 = 0, 'r': 'ps_without_sbr'}, {'b': user_id % 2 = 1 AND event_id % 3 = 0, 'r': 'ps_and_stereo'}, {'b': value < 1, 'r': 'au_crc'}]) AS x FROM events) WHERE x.b")
def r03(s, d):
    e, u = F.col("event_id"), F.col("user_id")
    x = v.table(s, d, "events").withColumns({"fire_ok": e % 7 != 0, "ps": u % 2 == 1, "sbr": e % 2 != 0, "stereo": e % 3 == 0, "aus_ok": F.col("value") >= 1})
    return r.validate(x, r.superframe_rules(), ["event_id"]).select("event_id", "rule_id")


@query("r04_registered_tables", "SELECT event_id FROM events WHERE user_id % 256 NOT BETWEEN 225 AND 238 AND user_id % 256 <> 243")
def r04(s, d):
    x = v.table(s, d, "events").withColumn("ecc", (F.col("user_id") % 256).cast("int"))
    return x.join(c.broadcast_if(dims.country_table(s)), "ecc", "left_anti").select("event_id")


@query("c01_decode_label", "SELECT event_id, CASE event_id % 3 WHEN 1 THEN event_type ELSE event_type END AS label FROM events")
def c01(s, d):
    charset = F.when(F.col("event_id") % 3 == 0, 0).when(F.col("event_id") % 3 == 1, 3).otherwise(9)
    data = F.concat(F.rpad("event_type", 12, " ").cast("binary"), F.lit(bytearray(4)))
    return v.table(s, d, "events").select("event_id", t.decode_label(charset, data).alias("label"))


@query("c03_short_label", "SELECT event_id, array_to_string(list_transform(list_filter(range(16), lambda i: (event_id >> (15 - i)) & 1 = 1), lambda i: substring(rpad(event_type, 16, ' '), i + 1, 1)), '') AS short_label FROM events")
def c03(s, d):
    return v.table(s, d, "events").select("event_id", t.short_label(F.lit(3), F.rpad("event_type", 16, " ").cast("binary"), F.col("event_id") % 65536).alias("short_label"))


@query("c15_metrics_json", sql("SELECT metric, count(*) AS n, max(value) AS most FROM $measurements GROUP BY 1"))
def c15(s, d):
    m = v.measurements(s, d).groupBy("metric").agg(F.to_json(F.struct(F.count("*").alias("n"), F.max("value").alias("most"))).alias("j"))
    return m.select("metric", F.from_json("j", "n long, most double").alias("x")).select("metric", "x.n", "x.most")


@query("t08_alerts_batch", sql("WITH b AS (SELECT stream_id, metric, frame_no, value > 30 AS over FROM $measurements) SELECT stream_id, metric, frame_no FROM b QUALIFY over AND NOT coalesce(lag(over) OVER (PARTITION BY stream_id, metric ORDER BY frame_no), false)"))
def t08(s, d):
    x = timing.rising(v.measurements(s, d), F.col("value") > 30, ["stream_id", "metric"], "frame_no")
    return x.select("stream_id", "metric", "frame_no")


@query("t15_catalog_upsert", sql("SELECT stream_id, metric, max(frame_no) AS frame_no, arg_max(value, frame_no) AS value FROM $measurements GROUP BY 1, 2"))
def t15(s, d):
    return timing.latest_per_key(v.measurements(s, d).drop("ts"), ["stream_id", "metric"], ["frame_no"])


@query("s16_expire_segments", sql("SELECT stream_id, count(*) AS n FROM $frames WHERE date_trunc('hour', ts) >= TIMESTAMP '2024-01-15 00:00:00' - INTERVAL 7 DAYS GROUP BY 1"))
def s16(s, d):
    import datetime as dt

    kept = reports.expire_segments(reports.segments(v.frames(s, d)), dt.datetime(2024, 1, 15), 7)
    return kept.groupBy("stream_id").agg(F.count("*").alias("n"))


@query("s17_alerts_export", sql("SELECT alert_id, severity, severity * 1000 + CASE WHEN active THEN 500 ELSE 0 END AS priority FROM $alerts"))
def s17(s, d):
    return health.alert_priority(v.alerts(s, d)).select("alert_id", "severity", "priority")


@query("x01_custom_metric", sql("SELECT stream_id, 'latency_share' AS metric, round(avg(latency / 100), 6) AS value FROM $frames GROUP BY 1 UNION ALL SELECT stream_id, 'valid_share', round(avg(valid::INT), 6) FROM $frames GROUP BY 1"))
def x01(s, d):
    metrics = {"latency_share": F.avg(F.col("latency") / 100), "valid_share": F.avg(F.col("valid").cast("int"))}
    return health.custom_metrics(v.frames(s, d), metrics, ["stream_id"])
