"""Queries of text over chunk borders, dynamic labels and label sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.functions import bits as b
from muxlake.operators import figs as g
from muxlake.operators import payload as k
from muxlake.operators import texts as x
from muxlake.plans import views as v
from muxlake.plans.views import query, sql

CHUNK = 97


@query("k09_stream_runs", """SELECT doc_id, len(r) AS n, md5(array_to_string(r, chr(10))) AS runs_md5 FROM (SELECT doc_id, regexp_extract_all(text, '[\\x20-\\x7E]{6,}') AS r FROM documents) WHERE len(r) > 0""")
def k09_stream(s, d):
    raw = F.encode("text", "UTF-8")
    docs = v.table(s, d, "documents").where("text <> ''").select("doc_id", raw.alias("raw"))
    chunks = docs.select("doc_id", "raw", F.explode(F.sequence(F.lit(0), F.ceil(F.octet_length("raw") / CHUNK).cast("int") - 1)).alias("chunk_no")).select("doc_id", "chunk_no", F.substring("raw", F.col("chunk_no") * CHUNK + 1, F.lit(CHUNK)).alias("payload"))
    runs = x.stream_runs(chunks, ["doc_id"], span=64)
    in_order = F.array_sort(F.collect_list(F.struct("first_chunk", "place", F.decode("raw", "UTF-8").alias("r"))))
    return runs.groupBy("doc_id").agg(F.count("*").cast("int").alias("n"), F.md5(F.array_join(F.transform(in_order, lambda r: r["r"]), "\n")).alias("runs_md5"))


PIECES = v.view("pieces", "SELECT concat('S', event_id % 16) AS stream_id, CAST(floor(event_id / 16) AS BIGINT) AS chunk_no, CASE event_id % 3 WHEN 0 THEN event_type WHEN 1 THEN concat(event_type, chr(10)) ELSE concat(' ', user_id % 7, chr(1), event_type) END AS payload FROM {events}")
ITEMS = v.view("carousel", "SELECT concat('S', event_id % 16) AS stream_id, CAST(floor(event_id / 16) AS BIGINT) AS chunk_no, CASE event_id % 4 + event_id % 5 WHEN 0 THEN concat(chr(10), 'Title ', event_type, chr(10)) WHEN 1 THEN concat(props, ' and a body that is long enough', chr(3)) WHEN 2 THEN event_type WHEN 3 THEN concat('12345 678', chr(2)) WHEN 4 THEN concat('Größe ', event_type) ELSE concat(event_type, ' ', chr(9)) END AS payload FROM {events}")


@query("k09_message_inventory", sql("SELECT stream_id, t AS text, count(*) AS repeats FROM (SELECT stream_id, trim(unnest(regexp_extract_all(string_agg(payload, '' ORDER BY chunk_no), '[\\x20-\\x7E]{6,}'))) AS t FROM $pieces GROUP BY stream_id) WHERE t <> '' GROUP BY 1, 2"))
def k09_inventory(s, d):
    c = PIECES(s, d).withColumn("payload", F.encode("payload", "UTF-8"))
    return x.message_inventory(x.stream_runs(c, ["stream_id"], span=16), ["stream_id"]).select("stream_id", "text", "repeats")


@query("k08_journaline_stream", sql("""WITH w AS (SELECT stream_id, regexp_extract_all(string_agg(payload, '' ORDER BY chunk_no), '[^\\x00-\\x1F\\x7F]+') AS r FROM $carousel GROUP BY stream_id),
    r AS (SELECT stream_id, trim(r[i]) AS run, i FROM w, LATERAL (SELECT unnest(range(1, len(r) + 1)) AS i)),
    p AS (SELECT * FROM r WHERE length(run) >= 6 AND regexp_matches(run, '\\p{L}{4}') AND length(regexp_replace(run, '[^\\p{L}\\p{N}\\s.,:;!?"''()\\[\\]/\\-–—&%+#…]', '', 'g')) * 10 >= length(run) * 7),
    q AS (SELECT *, lag(CASE WHEN length(run) <= 26 THEN run ELSE '' END) OVER (PARTITION BY stream_id ORDER BY i) AS before, row_number() OVER (PARTITION BY stream_id ORDER BY i) AS k FROM p)
    SELECT stream_id, (k - 1 + 32768)::INT AS object_id, CASE WHEN length(run) <= 26 THEN run ELSE coalesce(before, '') END AS title, CASE WHEN length(run) <= 26 THEN '' ELSE run END AS text FROM q"""))
def k08_stream(s, d):
    c = ITEMS(s, d).withColumn("payload", F.encode("payload", "UTF-8"))
    return x.journaline_items(c, ["stream_id"], span=16).drop("first_chunk")


LABELS = v.view("labels_sent", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, event_id % 3 AS charset, event_id % 5 AS n_tags, concat(event_type, ' - ', props) AS text, user_id % 10 AS type, event_id % 16 AS subtype, user_id % 8 AS start, event_id % 60 AS length FROM {events}")


@query("k06_dynamic_labels", sql("""SELECT stream_id, frame_no, CASE charset WHEN 0 THEN 15 WHEN 1 THEN 0 ELSE 9 END AS charset, text, CASE WHEN n_tags > 0 AND frame_no % 7 <> 0 AND length > 0 AND start + length <= length(text) THEN n_tags ELSE 0 END AS tags, CASE WHEN n_tags > 0 AND frame_no % 7 <> 0 AND length > 0 AND start + length <= length(text) THEN type || '.' || subtype || '=' || substr(text, start + 1, length) END AS first_tag FROM (SELECT *, t.n_tags AS n FROM $labels_sent t)"""))
def k06_labels(s, d):
    c = F.col
    # Every second one has the extended field's byte before it; every seventh no zero byte, so no command.
    lead = F.when(c("frame_no") % 2 == 0, F.lit(b"\xa5")).otherwise(F.lit(b""))
    first = F.when(c("charset") == 0, 15).when(c("charset") == 1, 0).otherwise(9)
    tag = b.pack((c("type") * 4096 + c("subtype") * 256 + c("frame_no") % 256, 2), (c("start") * 512 + F.floor(c("length") / 64) * 256 + c("length") % 64 * 4, 2))
    tags = F.when(c("n_tags") == 0, F.lit(b"")).otherwise(F.unhex(F.repeat(F.hex(tag), c("n_tags").cast("int"))))
    pad = LABELS(s, d).withColumn("payload", F.concat(lead, b.pack((first, 1)), F.encode("text", "UTF-8"), F.when(c("frame_no") % 7 == 0, F.lit(b"")).otherwise(F.concat(F.lit(b"\0"), b.pack((c("n_tags"), 1)), tags))))
    out = x.dynamic_labels(pad.select("stream_id", "frame_no", "payload"))
    t = F.get("tags", F.lit(0))
    return out.select("stream_id", "frame_no", "charset", "text", F.size("tags").alias("tags"), F.when(t.isNotNull(), F.concat(t["type"], F.lit("."), t["subtype"], F.lit("="), t["value"])).alias("first_tag"))


@query("k06_commands_with_text", sql("""WITH m AS (SELECT stream_id, frame_no, CASE WHEN frame_no % 3 = 0 THEN text END AS text FROM $labels_sent),
    l AS (SELECT *, last_value(text IGNORE NULLS) OVER (PARTITION BY stream_id ORDER BY frame_no) AS t FROM m) SELECT stream_id, frame_no, 1 + frame_no % 31 AS code, substr(t, 2, 4) AS value FROM l WHERE frame_no % 3 <> 0 AND t IS NOT NULL"""))
def k06_timeline(s, d):
    c = LABELS(s, d)
    texts = c.where("frame_no % 3 = 0").select("stream_id", "frame_no", "text")
    commands = c.where("frame_no % 3 <> 0").select("stream_id", "frame_no", b.pack(((1 + F.col("frame_no") % 31) * (1 << 26) + (1 << 13) + 4 * (1 << 8), 4)).alias("payload"))
    return k.dls_tags(x.commands_with_text(texts, commands, span=512)).drop("kind")


SEGMENTS = v.view("segments_sent", "SELECT concat('S', user_id % 4) AS stream_id, event_id AS frame_no, 1 AS ext, user_id % 8 AS id, CAST(floor(event_id / 200) AS BIGINT) % 2 AS toggle, CAST(event_id % 4 + CASE WHEN event_id % 400 < 20 THEN 1 ELSE 0 END AS INT) AS segment, user_id % 8 = 3 AS ucs2, event_type AS part FROM {events}")


@query("g41_label_sessions", sql("""WITH f AS (SELECT *, (toggle IS DISTINCT FROM lag(toggle) OVER w)::INT AS flip FROM $segments_sent WINDOW w AS (PARTITION BY stream_id, id ORDER BY frame_no)), s AS (SELECT *, sum(flip) OVER (PARTITION BY stream_id, id ORDER BY frame_no)::BIGINT AS session FROM f),
    o AS (SELECT stream_id, ext, id, session, toggle, segment, arg_min(part, frame_no) AS part, min(frame_no) AS a, max(frame_no) AS b FROM s GROUP BY ALL),
    l AS (SELECT stream_id, ext, id, session, toggle, min(a) AS first_frame, max(b) AS last_frame, count(*) AS segments, sum(1 << segment)::INT AS bitmap, string_agg(part, '' ORDER BY segment) AS label FROM o GROUP BY ALL)
    SELECT *  EXCLUDE (label), bitmap & (bitmap + 1) = 0 AS complete, CASE WHEN bitmap & (bitmap + 1) = 0 THEN label END AS label FROM l"""))
def g41_sessions(s, d):
    parts = SEGMENTS(s, d).withColumn("part", F.when(F.col("ucs2"), F.encode("part", "UTF-16BE")).otherwise(F.encode("part", "UTF-8")))
    return g.label_sessions(parts, span=512).drop("ucs2")
