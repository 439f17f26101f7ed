"""Queries of text functions, payload jobs, packets, audio, rules and reports over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.functions import bits as b
from muxlake.functions import codes
from muxlake.functions import text as t
from muxlake.operators import payload as k
from muxlake.operators import rules as r
from muxlake.plans import views as v
from muxlake.plans.views import query, sql

def E():
    return F.col("event_id")


def U():
    return F.col("user_id")


QUOTED = {"a": t.EBU_FROM.replace("'", "''"), "b": t.EBU_TO.replace("'", "''")}


def docs(s, d):
    return v.table(s, d, "documents")


def stream_frames(s, d):
    return v.table(s, d, "events").select(F.concat(F.lit("S"), U() % 16).alias("stream_id"), E().alias("frame_no"), "*")


# Text


@query("c02_ebu_to_utf8", f"SELECT item_id, translate(regexp_replace(text, '[^\\x01-\\xff]', '?', 'g'), '{QUOTED['a']}', '{QUOTED['b']}') AS label FROM benchmark")
def c02(s, d):
    return v.table(s, d, "benchmark").select("item_id", t.ebu_to_utf8(F.encode("text", "ISO-8859-1")).alias("label"))


@query("c02_tis620_to_utf8", "SELECT event_id, chr((3585 + event_id % 91)::INT) || event_type AS label FROM events")
def c02b(s, d):
    data = F.concat(b.pack((161 + E() % 91, 1)), F.col("event_type").cast("binary"))
    return v.table(s, d, "events").select("event_id", t.tis620_to_utf8(data).alias("label"))


@query("c05_is_valid_text", "SELECT doc_id, true AS whole, NOT (octet_length(encode(text)) > length(text)) AS cut FROM documents")
def c05(s, d):
    data = F.encode("text", "UTF-8")
    first = F.encode(F.regexp_extract("text", r"[^\x00-\x7F]", 0), "UTF-8")
    return docs(s, d).select("doc_id", t.is_valid_text(data).alias("whole"), t.is_valid_text(F.substring(first, 1, 1)).alias("cut"))


@query("c06_has_thai", "SELECT doc_id, regexp_matches(text, '[\\x{0E00}-\\x{0E7F}]') AS thai, regexp_matches(text, '[é-ñ]') AS latin FROM documents")
def c06(s, d):
    return docs(s, d).select("doc_id", t.has_thai(F.col("text")).alias("thai"), F.rlike(F.col("text"), F.lit("[é-ñ]")).alias("latin"))


@query("c07_mjd", "SELECT o_orderkey, (o_orderdate::DATE - DATE '1858-11-17')::INT AS mjd, o_orderdate + to_seconds(3661) AS stamp FROM orders")
def c07(s, d):
    mjd = t.date_mjd(F.col("o_orderdate"))
    return v.table(s, d, "orders").select("o_orderkey", mjd.cast("int").alias("mjd"), t.mjd_timestamp(mjd, F.lit(1), F.lit(1), F.lit(1)).alias("stamp"))


@query("c08_bcd", "SELECT event_id, CASE WHEN event_id % 256 // 16 > 9 OR event_id % 16 > 9 THEN 0 ELSE least(event_id % 256 // 16 * 10 + event_id % 16, 59) END AS n FROM events")
def c08(s, d):
    return v.table(s, d, "events").select("event_id", t.bcd(E() % 256, 59).alias("n"))


@query("c09_lto_minutes", "SELECT event_id, CASE WHEN h BETWEEN -24 AND 28 THEN h * 30 END AS minutes FROM (SELECT event_id, CASE WHEN event_id % 64 >= 32 THEN event_id % 64 - 64 ELSE event_id % 64 END AS h FROM events)")
def c09(s, d):
    return v.table(s, d, "events").select("event_id", t.lto_minutes(E() % 64).alias("minutes"))


@query("c11_now_playing", "SELECT event_id, CASE WHEN user_id % 3 > 0 AND event_id % 2 = 0 THEN event_type || ' - ' || props WHEN event_id % 2 = 0 THEN props WHEN user_id % 3 > 0 THEN event_type ELSE 'text' END AS playing FROM events")
def c11(s, d):
    tags = F.map_filter(F.create_map(F.lit("artist"), F.when(U() % 3 > 0, F.col("event_type")), F.lit("title"), F.when(E() % 2 == 0, F.col("props"))), lambda _, x: x.isNotNull())
    return v.table(s, d, "events").select("event_id", t.now_playing(tags, F.lit("text")).alias("playing"))


@query("c12_byte_slice", "SELECT doc_id, substring(hex(encode(text)), 1 + 2 * (doc_id % 50)::INT, 40) AS slice FROM documents WHERE octet_length(encode(text)) >= doc_id % 50 + 20")
def c12(s, d):
    x = docs(s, d).where(F.octet_length("text") >= F.col("doc_id") % 50 + 20)
    return x.select("doc_id", F.hex(F.substring(F.encode("text", "UTF-8"), (F.col("doc_id") % 50 + 1).cast("int"), F.lit(20))).alias("slice"))


@query("c13_to_db", "SELECT event_id, round(20 * log10(value), 6) AS db, round(10 ** (value / 20), 4) AS amplitude FROM events")
def c13(s, d):
    return v.table(s, d, "events").select("event_id", t.round_scaled(t.to_db(F.col("value"), float("-inf")), 6).alias("db"), t.round_scaled(t.from_db(F.col("value")), 4).alias("amplitude"))


@query("c14_file_name", "SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') || '_' || lpad((event_id % 1000)::VARCHAR, 4, '0') AS name FROM events")
def c14(s, d):
    return v.table(s, d, "events").select("event_id", t.file_name(F.col("ts"), E() % 1000).alias("name"))


@query("c16_format_hex", "SELECT event_id, printf('0x%04X', event_id % 65536) AS hex16, printf('0x%08X', event_id) AS hex32, printf('%02X:%X:%03X', 224, (event_id % 65536) >> 12, event_id % 4096) AS parts FROM events")
def c16(s, d):
    return v.table(s, d, "events").select("event_id", t.format_hex(E() % 65536).alias("hex16"), t.format_sid(E(), F.lit(224), "hex32").alias("hex32"), t.format_sid(E() % 65536, F.lit(224), "parts").alias("parts"))


@query("c17_flag_list", "SELECT event_id, array_to_string(list_filter(range(16), lambda i: (event_id >> i) & 1 = 1), ',') AS flags FROM events")
def c17(s, d):
    return v.table(s, d, "events").select("event_id", F.array_join(F.transform(b.flag_list(E()), lambda x: x.cast("string")), ",").alias("flags"))


@query("c18_prohibited_terms", "SELECT doc_id, regexp_matches(lower(text), 'license|gpl') OR length(text) > 2000 AS prohibited FROM documents")
def c18(s, d):
    return docs(s, d).select("doc_id", t.prohibited_terms(F.col("text"), ["License", "GPL"], 2000).alias("prohibited"))


@query("c20_bitrate_valid", sql("SELECT sid, sub_channel_id * 8 BETWEEN 8 AND 192 AND tmid + 1 BETWEEN 1 AND 5 AS valid FROM $services"))
def c20(s, d):
    return v.services(s, d).select("sid", t.bitrate_valid(F.col("sub_channel_id") * 8, F.col("tmid") + 1).alias("valid"))


@query("c21_audio_quality", sql("SELECT sid, round(least(sub_channel_id / CASE tmid WHEN 0 THEN 48.0 WHEN 1 THEN 96.0 ELSE 192.0 END * 100 * (1 + 0.05 * tmid), 100.0), 6) AS quality FROM $services"))
def c21(s, d):
    profile = F.when(F.col("tmid") == 0, "v2").when(F.col("tmid") == 1, "v1").otherwise("lc")
    return v.services(s, d).select("sid", F.round(t.audio_quality(F.col("sub_channel_id"), profile, F.col("tmid")), 6).alias("quality"))


@query("c10_epg_genre", "SELECT event_id, CASE event_id & 240 WHEN 0 THEN 'Undefined' WHEN 16 THEN 'News' WHEN 32 THEN 'Sport' WHEN 48 THEN 'Education' WHEN 64 THEN 'Drama' WHEN 80 THEN 'Music' WHEN 96 THEN 'Arts & Culture' WHEN 112 THEN 'Social' WHEN 128 THEN 'Science' WHEN 144 THEN 'Leisure' WHEN 160 THEN 'Children''s' ELSE 'Unknown' END AS genre FROM events")
def c10(s, d):
    return v.table(s, d, "events").select("event_id", codes.epg_genre(E() % 256).alias("genre"))


@query("c10_journaline_category", """SELECT event_id, coalesce(map([0, 1, 2, 3, 16, 17, 18, 32, 33, 34, 48, 64, 80, 96, 112, 128, 144], ['Undefined', 'News - General', 'News - Regional', 'News - International', 'Sport - General', 'Sport - Football', 'Sport - Other', 'Weather - General', 'Weather - Forecast', 'Weather - Warning', 'Traffic', 'Financial', 'Entertainment', 'Politics', 'Culture', 'Technology', 'Health'])[(event_id % 256)::INT], 'Unknown') AS category FROM events""")
def c10b(s, d):
    return v.table(s, d, "events").select("event_id", codes.journaline_category(E() % 256).alias("category"))


@query("c10_mot_content_type", """SELECT event_id, CASE event_id % 16 WHEN 0 THEN 'General Data' WHEN 1 THEN 'Text' WHEN 2 THEN 'JPEG Image' WHEN 3 THEN 'PNG Image' WHEN 4 THEN 'BMP Image' WHEN 5 THEN 'HTML Document' WHEN 6 THEN 'MPEG Audio' WHEN 7 THEN 'MPEG Video' ELSE printf('Unknown (0x%02x)', event_id % 16) END AS content_type FROM events""")
def c10c(s, d):
    return v.table(s, d, "events").select("event_id", codes.mot_content_type(E() % 16).alias("content_type"))


@query("c10_tpeg_category", """SELECT p_partkey, CASE WHEN contains(t, 'TEC') AND contains(t, 'TFP') AND contains(t, 'PKI') THEN 'banner' WHEN contains(t, 'R-3.1') OR contains(t, 'wip') THEN 'version' WHEN contains(lower(t), 'tec') THEN 'TEC' WHEN contains(lower(t), 'tfp') THEN 'TFP' WHEN contains(lower(t), 'pki') THEN 'PKI' WHEN contains(lower(t), 'emi') THEN 'EMI'
    WHEN contains(lower(t), 'parking') OR contains(lower(t), 'charge') THEN 'PKI' WHEN contains(lower(t), 'rd') OR contains(lower(t), 'bangkok') OR contains(lower(t), 'khwaeng') THEN 'TEC' ELSE 'unknown' END AS category
    FROM (SELECT p_partkey, p_name || CASE p_partkey % 9 WHEN 0 THEN ' TEC TFP PKI' WHEN 1 THEN ' R-3.1' WHEN 2 THEN ' tec' WHEN 3 THEN ' Tfp' WHEN 4 THEN ' pki' WHEN 5 THEN ' EMI' WHEN 6 THEN ' charge' WHEN 7 THEN ' Rd 7' ELSE '' END AS t FROM part)""")
def c10d(s, d):
    more = F.element_at(F.array(*map(F.lit, (" TEC TFP PKI", " R-3.1", " tec", " Tfp", " pki", " EMI", " charge", " Rd 7", ""))), (F.col("p_partkey") % 9 + 1).cast("int"))
    return v.table(s, d, "part").select("p_partkey", codes.tpeg_category(F.concat("p_name", more)).alias("category"))


# Payload


def groups(s, d):
    """A data group an event: flags, session header, a segment of the event's name; some with a broken CRC."""
    n = F.octet_length("event_type")
    body = F.concat(b.pack((F.lit(0x74), 1), (E() % 16 * 16, 1), (E() % 32768, 2), (F.lit(0x12), 1), (U() % 65536, 2), (n, 2)), F.col("event_type").cast("binary"))
    x = stream_frames(s, d).withColumn("body", body)
    return x.select("stream_id", "frame_no", F.concat("body", b.pack((b.crc16_stored(F.col("body")).bitwiseXOR(F.when(E() % 9 == 0, 1).otherwise(0).cast("long")), 2))).alias("payload"))


@query("k01_parse_data_groups", "SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, 4 AS group_type, event_id % 16 AS continuity, event_id % 32768 AS seg_no, false AS last, user_id % 65536 AS transport_id, CASE WHEN event_id % 9 = 0 THEN 'crc' END AS reject, CASE WHEN event_id % 9 <> 0 THEN event_type END AS segment FROM events")
def k01(s, d):
    return k.parse_data_groups(groups(s, d)).select("stream_id", "frame_no", "group_type", "continuity", "seg_no", "last", "transport_id", "reject", F.decode("segment", "UTF-8").alias("segment"))


def mot_segments(s, d):
    x = v.table(s, d, "lineitem").groupBy(F.concat(F.lit("M"), F.col("l_orderkey") % 7).alias("stream_id"), F.col("l_orderkey").alias("transport_id"), "l_linenumber").agg(F.min("l_partkey").alias("p"))
    return x.select("stream_id", "transport_id", F.lit("body").alias("kind"), (F.col("l_linenumber") - 1).alias("seg_no"), (F.col("l_linenumber") == 4).alias("last"), F.col("p").cast("string").cast("binary").alias("payload"), F.col("l_linenumber").alias("tick"))


@query("k02_assemble_mot", """WITH s AS (SELECT l_orderkey AS transport_id, l_linenumber AS n, min(l_partkey)::VARCHAR AS p FROM lineitem GROUP BY 1, 2)
    SELECT 'M' || (transport_id % 7) AS stream_id, transport_id, 0 AS epoch, 4 AS segments, string_agg(p, '' ORDER BY n) AS body FROM s GROUP BY transport_id HAVING count(*) FILTER (n <= 4) = 4 AND count(*) = 4""")
def k02(s, d):
    return k.assemble_mot(mot_segments(s, d)).withColumn("body", F.decode("body", "UTF-8"))


@query("k05_mot_progress", """WITH s AS (SELECT l_orderkey AS transport_id, l_linenumber AS n, length(min(l_partkey)::VARCHAR) AS p FROM lineitem GROUP BY 1, 2) SELECT 'M' || (transport_id % 7) AS stream_id, transport_id, sum(p)::BIGINT AS received, 20 AS body_size, round(least(sum(p) / 20, 1.0), 6) AS progress FROM s GROUP BY transport_id""")
def k05(s, d):
    x = mot_segments(s, d)
    return k.mot_progress(x, x.select("stream_id", "transport_id").distinct().withColumn("body_size", F.lit(20)))


@query("k03_parse_mot_header", "SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, event_id AS body_size, user_id % 8192 AS header_size, event_id % 64 AS content_type, user_id % 512 AS content_subtype, printf('%02X', event_id % 256) AS p5, hex(encode(event_type)) AS p12 FROM events")
def k03(s, d):
    core = E() * (1 << 28) + U() % 8192 * (1 << 15) + E() % 64 * 512 + U() % 512
    data = F.concat(b.pack((core, 7), (F.lit(0x45), 1), (E() % 256, 1), (F.lit(0xCC), 1), (F.octet_length("event_type"), 1)), F.col("event_type").cast("binary"))
    out = k.parse_mot_header(stream_frames(s, d).select("stream_id", "frame_no", data.alias("payload")))
    return out.withColumns({"p5": F.col("params")[5], "p12": F.col("params")[12]}).drop("params")


@query("k04_parse_mot_directory", "SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, event_id % 8192 AS directory_size, (1 + user_id % 3)::INT AS n_objects, event_id % 16777216 AS carousel_period_ms, user_id % 8192 AS segment_size, event_id % 7 <> 0 AS crc_ok, i::INT AS entry, (user_id + i) % 65536 AS transport_id, 20 + i AS header_size, event_id * 3 + i AS body_size, 5 + i AS repetitions FROM events, LATERAL (SELECT unnest(range(1 + user_id % 3)) AS i)")
def k04(s, d):
    entry = lambda i: b.pack(((U() + i) % 65536, 2), (F.lit(20) + i, 2), (F.shiftleft(E() * 3 + i, 4), 4), (F.lit(5) + i, 1))
    n = (U() % 3 + 1).cast("int")
    entries = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.hex(entry(i))), ""))
    x = stream_frames(s, d).withColumn("body", F.concat(b.pack((E() % 8192, 2), (n, 2), (E() % 16777216, 3), (U() % 8192, 2)), entries))
    x = x.select("stream_id", "frame_no", F.concat("body", b.pack((b.crc16_stored(F.col("body")).bitwiseXOR(F.when(E() % 7 == 0, 1).otherwise(0).cast("long")), 2))).alias("payload"))
    return k.parse_mot_directory(x)


@query("x03_tlv_entries", "SELECT event_id, i::INT AS pos, ((event_id + i) % 256)::INT AS tag, event_type AS value FROM events, LATERAL (SELECT unnest(range(2)) AS i)")
def x03(s, d):
    from muxlake.functions import tables

    tables.register(s)
    body = F.col("event_type").cast("binary")
    entry = lambda i: F.concat(b.pack(((E() + i) % 256, 1), (F.octet_length("event_type"), 1)), body)
    x = v.table(s, d, "events").select("event_id", F.concat(entry(0), entry(1)).alias("payload"))
    return s.sql("SELECT event_id, pos, tag, decode(value, 'UTF-8') AS value FROM {x}, LATERAL tlv_entries(payload)", x=x)


@query("k06_parse_dls", "SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, event_id % 64 AS code, CASE WHEN event_id % 64 BETWEEN 1 AND 31 THEN 'item' WHEN event_id % 64 BETWEEN 32 AND 47 THEN 'info' WHEN event_id % 64 BETWEEN 48 AND 55 THEN 'programme' WHEN event_id % 64 BETWEEN 56 AND 59 THEN 'interactivity' WHEN event_id % 64 BETWEEN 60 AND 61 THEN 'station' WHEN event_id % 64 = 62 THEN 'programme_type' ELSE 'reserved' END AS kind, substring(event_type, 2, 3) AS value FROM events")
def k06(s, d):
    x = stream_frames(s, d).select("stream_id", "frame_no", b.pack((E() % 64 * (1 << 26) + (1 << 13) + 3 * (1 << 8), 4)).alias("payload"), F.col("event_type").alias("text"))
    return k.dls_tags(x)


@query("k07_parse_epg", "SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, user_id AS service_id, (event_id * 2 + i) % 65536 AS event_id, TIMESTAMP '1858-11-17 00:00:00' + to_days((59000 + event_id % 1000)::INT) + to_hours(12) AS start_time, least(event_id % 3000, 1440) AS minutes, 7 AS content, event_type AS name FROM events, (SELECT unnest(range(2)) AS i)")
def k07(s, d):
    n = F.octet_length("event_type")
    event = lambda i: F.concat(b.pack(((E() * 2 + i) % 65536, 2), (59000 + E() % 1000, 2), (F.lit(0x120000), 3), (E() % 3000, 2), (F.lit(7), 1), (n, 1)), F.col("event_type").cast("binary"), b.pack((F.lit(0), 2)))
    data = F.concat(b.pack((U(), 4), (F.lit(59000), 2), (F.lit(2), 2)), event(0), event(1))
    return k.epg_events(stream_frames(s, d).select("stream_id", "frame_no", data.alias("payload")))


@query("k08_parse_journaline", "SELECT event_id % 65536 AS object_id, user_id % 8 AS category, TIMESTAMP '1858-11-17 06:30:00' + to_days((59000 + event_id % 100)::INT) AS ts, event_type AS title, props AS text, CASE WHEN event_id % 2 = 0 THEN user_id % 65536 END::VARCHAR AS link_target FROM events")
def k08(s, d):
    link = F.when(E() % 2 == 0, b.pack((F.lit(1), 1), (U() % 65536, 2))).otherwise(F.lit(bytearray()))
    data = F.concat(b.pack((E() % 65536, 2), (U() % 8, 1), (59000 + E() % 100, 2), (F.lit(0x063000), 3), (F.octet_length("event_type"), 1)), F.col("event_type").cast("binary"), b.pack((F.octet_length("props"), 2)), F.col("props").cast("binary"), link)
    return k.journaline_objects(v.table(s, d, "events").select(data.alias("payload"))).withColumn("link_target", F.col("link_target").cast("string"))


@query("k09_text_runs", "WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x20-\\x7E]{6,}')) AS run FROM documents) SELECT doc_id, count(*) AS n, max(length(run)) AS longest, sum(length(run))::BIGINT AS chars FROM r GROUP BY 1")
def k09(s, d):
    x = k.text_runs(docs(s, d).select("doc_id", "text"), "text")
    return x.groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("run")).alias("longest"), F.sum(F.length("run")).alias("chars"))


@query("k12_audio_levels", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x FROM embeddings) SELECT vec_id, round(20 * log10(max(abs(x))), 6) AS peak_db, round(20 * log10(sqrt(avg(x * x))), 6) AS rms_db, bool_or(abs(x) >= 1) AS clipped FROM x GROUP BY 1")
def k12(s, d):
    x = v.table(s, d, "embeddings").select("vec_id", F.explode("embedding").alias("x")).withColumn("x", F.col("x").cast("double"))
    return k.audio_levels(x, ["vec_id"])


def bins(s, d):
    return k.spectrum(v.table(s, d, "embeddings"), "vec_id", "embedding")


#: The transform of Hann-windowed samples, by its definition.
SPECTRUM = """x AS (SELECT vec_id, len(embedding) AS n, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), w AS (SELECT vec_id, n, i, x * (0.5 - 0.5 * cos(2 * pi() * i / (n - 1))) AS x FROM x),
    b AS (SELECT vec_id, k, n, sum(x * cos(2 * pi() * k * i / n)) AS re, sum(x * sin(2 * pi() * k * i / n)) AS im FROM w, LATERAL (SELECT unnest(range(n // 2 + 1)) AS k) GROUP BY ALL),
    s AS (SELECT vec_id, k AS bin, round(greatest(20 * log10(greatest(sqrt(re * re + im * im) / n * 2, 1e-12)), -120), 6) AS db FROM b)"""


@query("k13_spectrum_distortion", f"""WITH {SPECTRUM}, f AS (SELECT vec_id, arg_max(bin, db) AS fundamental, max(db) AS top FROM s WHERE bin > 0 GROUP BY 1), k AS (SELECT s.vec_id, bin, db, fundamental, round(bin / fundamental) AS k FROM s JOIN f ON s.vec_id = f.vec_id),
    h AS (SELECT vec_id, sum(p) AS p FROM (SELECT vec_id, k, max(pow(10.0, db / 10)) AS p FROM k WHERE k BETWEEN 2 AND 10 AND abs(bin - k * fundamental) <= 0.05 * k * fundamental GROUP BY 1, 2) GROUP BY 1)
    SELECT f.vec_id, fundamental::INT AS fundamental, round(100 * sqrt(coalesce(p, 0.0) / pow(10.0, top / 10)), 4) AS thd FROM f LEFT JOIN h ON f.vec_id = h.vec_id""")
def k13(s, d):
    return k.distortion(bins(s, d), "vec_id")


@query("k14_spectral_features", f"WITH {SPECTRUM} SELECT vec_id, round(sum(bin * pow(10.0, db / 20)) / sum(pow(10.0, db / 20)), 4) AS centroid, round(avg(db), 4) AS mean_db, round(stddev_pop(db), 4) AS deviation_db FROM s GROUP BY 1")
def k14(s, d):
    return k.spectral_features(bins(s, d), "vec_id")


@query("k15_normalise", "WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i FROM embeddings), c AS (SELECT vec_id, i, x - avg(x) OVER (PARTITION BY vec_id) AS c FROM x) SELECT vec_id, i, round(c / max(abs(c)) OVER (PARTITION BY vec_id), 6) AS normalised FROM c")
def k15(s, d):
    x = v.table(s, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "x")).withColumn("x", F.col("x").cast("double"))
    return k.normalise(x, ["vec_id"]).select("vec_id", "i", "normalised")


@query("k16_tpeg_framing", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'sync' WHEN 1 THEN 'phase' ELSE 'unknown' END AS framing, CASE event_id % 3 WHEN 0 THEN 1 WHEN 1 THEN 4 ELSE 2 END AS units FROM events")
def k16(s, d):
    data = F.unhex(F.when(E() % 3 == 0, F.concat(F.lit("11" * 20 + "0A46"), F.repeat(F.lit("22"), 10))).when(E() % 3 == 1, F.lit(("300113" + "44" * 21) * 4)).otherwise(F.lit("33" * 48)))
    return k.tpeg_framing(v.table(s, d, "events").select("event_id", data.alias("payload")))


# Packets


def datagrams(s, d):
    """An AF packet an event with two tags; some with a bad sync, cut short or with a bad check."""
    name = F.col("event_type").cast("binary")
    content = F.concat(F.lit(bytearray(b"deti")), b.pack((F.lit(32), 4), (E(), 4)), F.lit(bytearray(b"est1")), b.pack((F.octet_length("event_type") * 8, 4)), name)
    x = stream_frames(s, d).withColumn("content", content)
    head = F.concat(F.lit(bytearray(b"AF")), b.pack((F.octet_length("content"), 4), (E() % 65536, 2), (F.lit(0x1040), 2)), F.col("content"))
    x = x.withColumn("head", head)
    whole = F.concat("head", b.pack((F.crc32("head") + F.when(E() % 10 == 1, 1).otherwise(0), 4)))
    return x.select("stream_id", "frame_no", F.when(E() % 10 == 2, F.concat(F.lit(bytearray(b"XX")), whole)).when(E() % 10 == 3, F.substring(whole, 1, 20)).otherwise(whole).alias("payload"))


GOOD = "event_id % 10 NOT IN (1, 2, 3)"


@query("s06_read_af_packets", f"SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, CASE event_id % 10 WHEN 1 THEN 'crc' WHEN 2 THEN 'sync' WHEN 3 THEN 'truncated' END AS reject, (CASE WHEN {GOOD} THEN event_id % 65536 END)::VARCHAR AS seq FROM events")
def s06(s, d):
    return k.read_af_packets(datagrams(s, d)).select("stream_id", "frame_no", "reject", F.col("seq").cast("string").alias("seq"))


@query("s07_explode_tag_items", f"SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, i AS pos, CASE i WHEN 0 THEN 'deti' ELSE 'est1' END AS name, CASE i WHEN 0 THEN printf('%08X', event_id) ELSE hex(encode(event_type)) END AS value FROM events, (SELECT unnest(range(2)) AS i) WHERE {GOOD}")
def s07(s, d):
    x = k.explode_tag_items(k.read_af_packets(datagrams(s, d)).where("reject IS NULL"))
    return x.select("stream_id", "frame_no", "pos", "name", F.hex("value").alias("value"))


@query("s08_find_tag", f"SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, event_type AS value FROM events WHERE {GOOD}")
def s08(s, d):
    x = k.explode_tag_items(k.read_af_packets(datagrams(s, d)).where("reject IS NULL"))
    return k.find_tag(x, "est1", ["stream_id", "frame_no"]).withColumn("value", F.decode("value", "UTF-8"))


@query("s09_reframe_stream", "WITH a AS (SELECT user_id % 16 AS g, string_agg(event_type, '' ORDER BY event_id) AS x FROM events GROUP BY 1) SELECT 'S' || g AS stream_id, i AS frame_no, substring(x, i * 32 + 1, 32) AS raw FROM (SELECT g, x, unnest(range(length(x) // 32)) AS i FROM a)")
def s09(s, d):
    x = stream_frames(s, d).select("stream_id", F.col("frame_no").alias("chunk_no"), F.col("event_type").cast("binary").alias("payload"))
    return k.reframe_stream(x, 32).withColumn("raw", F.decode("raw", "UTF-8"))


@query("s11_parse_announcements", "SELECT page_id, url AS name, '239.1.' || (page_id % 256) || '.7' AS address, (5000 + page_id % 1000)::VARCHAR AS port, 'ETI' AS encoding FROM pages WHERE page_id % 5 <> 0")
def s11(s, d):
    text = F.concat(F.lit("v=0\ns="), "url", F.lit("\nc=IN IP4 239.1."), F.col("page_id") % 256, F.lit(".7/16\nm=video "), 5000 + F.col("page_id") % 1000, F.lit(" RTP/AVP 96\na=rtpmap:96 "), F.when(F.col("page_id") % 5 == 0, "MP2T").otherwise("ETI"), F.lit("/90000"))
    return k.parse_announcements(v.table(s, d, "pages").select("page_id", text.alias("text")))


@query("t03_reassemble_pft", """WITH f AS (SELECT l_orderkey AS pseq, l_linenumber - 1 AS findex, count(*) AS c, min(l_partkey)::VARCHAR AS p FROM lineitem GROUP BY 1, 2)
    SELECT pseq, count(*) FILTER (findex < 4) = 4 AS complete, sum(CASE WHEN findex < 4 THEN c - 1 ELSE 0 END)::BIGINT AS duplicates, sum(CASE WHEN findex >= 4 THEN c ELSE 0 END)::BIGINT AS invalid, CASE WHEN count(*) FILTER (findex < 4) = 4 THEN string_agg(p, '' ORDER BY findex) FILTER (findex < 4) END AS packet FROM f GROUP BY 1""")
def t03(s, d):
    li = v.table(s, d, "lineitem")
    f = li.select(F.lit("M").alias("stream_id"), F.col("l_orderkey").alias("pseq"), F.lit(0).alias("epoch"), (F.col("l_linenumber") - 1).alias("findex"), F.lit(4).alias("fcount"), F.struct("l_partkey", "l_suppkey").alias("arrival"), F.col("l_partkey").cast("string").cast("binary").alias("payload"))
    return k.reassemble_pft(f).select("pseq", "complete", "duplicates", "invalid", F.decode("packet", "UTF-8").alias("packet"))


# Rules


@query("r01_framing_rules", sql("""SELECT stream_id, frame_no, x.r AS rule_id, x.s AS severity FROM (SELECT *, unnest([{'b': NOT sync_ok, 'r': 'sync', 's': 'critical'}, {'b': fc > 249, 'r': 'frame_count', 's': 'error'}, {'b': nst > 63, 'r': 'nst', 's': 'error'}, {'b': mid NOT BETWEEN 1 AND 4, 'r': 'mode', 's': 'error'}]) AS x FROM $headers) WHERE x.b"""))
def r01(s, d):
    return r.validate(v.headers(s, d), r.framing_rules(), ["stream_id", "frame_no"]).select("stream_id", "frame_no", "rule_id", "severity")


@query("r02_service_rules", sql("""SELECT sid, x.r AS rule_id FROM (SELECT *, unnest([{'b': sid IN (0, 65535), 'r': 'sid'}, {'b': coalesce(label, '') = '', 'r': 'label'}, {'b': length(label) > 16, 'r': 'label_length'}]) AS x FROM $services) WHERE x.b"""))
def r02(s, d):
    return r.validate(v.services(s, d), r.service_rules(), ["sid"]).select("sid", "rule_id")


@query("r05_plan_rules", sql("SELECT sid, x.r AS rule_id FROM (SELECT *, unnest([{'b': NOT 170 + signal BETWEEN 174 AND 240, 'r': 'band'}, {'b': NOT plan_ok, 'r': 'plan'}]) AS x FROM $services) WHERE x.b"))
def r05(s, d):
    x = v.services(s, d).withColumns({"mhz": 170 + F.col("signal"), "plan_mhz": F.when(F.col("plan_ok"), 1.0)})
    return r.validate(x, r.plan_rules(), ["sid"]).select("sid", "rule_id")


@query("r06_component_rules", sql("SELECT sid, x.r AS rule_id FROM (SELECT *, unnest([{'b': sid % 5000 > 4095, 'r': 'scid'}, {'b': sid % 3 = 0, 'r': 'packet_address'}, {'b': sid % 200 > 127, 'r': 'language'}]) AS x FROM $services) WHERE x.b"))
def r06(s, d):
    x = v.services(s, d).withColumns({"scid": F.col("sid") % 5000, "packet_address": F.col("sid") % 3, "language": F.col("sid") % 200})
    return r.validate(x, r.component_rules(), ["sid"]).select("sid", "rule_id")


@query("r07_error_rules", sql("SELECT stream_id, frame_no, x.r AS rule_id, x.s AS severity FROM (SELECT *, unnest([{'b': latency < 1, 'r': 'sync_lost', 's': 'critical'}, {'b': latency < 2, 'r': 'structure', 's': 'high'}, {'b': latency < 4, 'r': 'fic', 's': 'medium'}, {'b': level_no % 8 = 0, 'r': 'no_service', 's': 'critical'}, {'b': latency / 20 < 0.5, 'r': 'audio_bad', 's': 'high'}, {'b': latency / 20 >= 0.5 AND latency / 20 < 0.75, 'r': 'audio_poor', 's': 'medium'}]) AS x FROM $frames) WHERE x.b"))
def r07(s, d):
    c = F.col("latency")
    x = v.frames(s, d).withColumns({"sync_ok": c >= 1, "structure_ok": c >= 2, "fic_ok": c >= 4, "services": F.col("level_no") % 8, "audio": c / 20})
    return r.validate(x, r.error_rules(), ["stream_id", "frame_no"]).select("stream_id", "frame_no", "rule_id", "severity")


@query("r08_cross_check", sql("""WITH f AS (SELECT stream_id, max(nst) AS nst FROM $headers GROUP BY 1), e AS (SELECT DISTINCT stream_id, 60 + (substring(stream_id, 2)::INT % 10) AS n FROM $frames) SELECT stream_id, coalesce(nst::VARCHAR, 'none') || ' against ' || coalesce(n::VARCHAR, 'none') AS message FROM f FULL JOIN e USING (stream_id) WHERE nst IS DISTINCT FROM n"""))
def r08(s, d):
    e = v.frames(s, d).select("stream_id").distinct().withColumn("subchannels", 60 + F.substring("stream_id", 2, 9).cast("int") % 10)
    return r.cross_check(e, v.headers(s, d)).select("stream_id", "message")


@query("r09_audio_rules", sql("SELECT sid, x.r AS rule_id, x.s AS severity FROM (SELECT sid, unnest([{'b': abs(23 - signal / 3) > 5, 'r': 'loudness', 's': 'critical'}, {'b': abs(23 - signal / 3) > 2 AND abs(23 - signal / 3) <= 5, 'r': 'loudness', 's': 'error'}, {'b': abs(23 - signal / 3) > 1 AND abs(23 - signal / 3) <= 2, 'r': 'loudness', 's': 'warning'}, {'b': error_rate > 0.1, 'r': 'thd', 's': 'warning'}, {'b': tmid * 5 < 12, 'r': 'dynamic', 's': 'info'}]) AS x FROM $services) WHERE x.b"))
def r09(s, d):
    x = v.services(s, d).withColumns({"lufs": -F.col("signal") / 3, "peak_db": F.lit(-9.0), "thd": F.col("error_rate"), "dynamic_db": F.col("tmid") * 5})
    return r.validate(x, r.audio_rules(), ["sid"]).select("sid", "rule_id", "severity")


# Reports


@query("s13_report", sql("""SELECT 'S' || g AS stream_id, (SELECT count(*) FROM $frames f WHERE f.stream_id = 'S' || g) AS frames, (SELECT count(*) FROM $figs f WHERE f.stream_id = 'S' || g AND NOT crc_ok) AS crc_failures, (SELECT count(*) FROM $errors f WHERE f.stream_id = 'S' || g AND severity = 'critical') AS critical FROM (SELECT DISTINCT user_id % 16 AS g FROM events)"""))
def s13(s, d):
    from muxlake.operators.reports import report

    out = report(v.frames(s, d), v.figs(s, d), v.errors(s, d))
    return out.select("stream_id", F.get_json_object("report", "$.stream.total_frames").cast("long").alias("frames"), F.get_json_object("report", "$.fic.crc_failures").cast("long").alias("crc_failures"), F.get_json_object("report", "$.errors.critical").cast("long").alias("critical"))


@query("s15_record_segments", sql("SELECT stream_id, date_trunc('hour', ts) AS segment, count(*) AS n, strftime(date_trunc('hour', ts), '%Y%m%d_%H%M%S') || '_0000' AS name FROM $frames GROUP BY 1, 2"))
def s15(s, d):
    from muxlake.operators.reports import segments

    return segments(v.frames(s, d)).groupBy("stream_id", "segment", "name").agg(F.count("*").alias("n"))
