"""Queries of superframes and their access units (K10, K11, R03): superframes are built from events and cut into frames; the SQL has what went into them."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.functions.bits import crc_table
from muxlake.operators import payload as k
from muxlake.operators import rules as r
from muxlake.plans import views as v
from muxlake.plans.views import query

#: Bytes of a superframe of one capacity step of 8 kbit/s, and those of them that access units fill.
WHOLE, FILLED = 120, 110
FORMATS = {(0, 1): (2, 5), (1, 1): (3, 6), (0, 0): (4, 8), (1, 0): (6, 11)}  # (rate, sbr): units, first offset


def checksum(data: bytes, polynomial: int, start: int) -> int:
    table, c = crc_table(polynomial, 16), start
    for x in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ x]
    return c


def superframe(kind: int, variant: str) -> bytes:
    """Bits of kind: rate, sbr, stereo, ps. Units of equal size, the first with a PAD of 4 bytes. variant: fine, offsets (they fall), zeros (a header of zeros)."""
    rate, sbr, stereo, ps = (kind >> i & 1 for i in range(4))
    n, first = FORMATS[rate, sbr]
    starts = [first + i * ((FILLED - first) // n) for i in range(n)] + [FILLED]
    listed = starts[1:-1] if variant == "fine" else [0xFFF] * (n - 1) if variant == "offsets" else [0] * (n - 1)
    head = bytes([rate << 6 | sbr << 5 | stereo << 4 | ps << 3]) + bytes.fromhex("".join(f"{x:03X}" for x in listed).ljust(2 * (first - 3), "0"))
    units = b""
    for i in range(n):
        size = starts[i + 1] - starts[i] - 2
        data = (b"\x80\x04PAD!" if not i else b"").ljust(size, b"\x55")
        units += data + (checksum(data, 0x1021, 0xFFFF) ^ 0xFFFF).to_bytes(2, "big")
    body = (head + units).ljust(WHOLE - 2, b"\0")
    return checksum(body[:9], 0x782F, 0).to_bytes(2, "big") + body


def msc(s, d):
    """Five frames an event. Every 7th header check fails, every 13th header is zeros, offsets fall in every 11th, every 5th has a broken unit."""
    e = F.col("event_id")
    lists = {x: F.array(*[F.lit(superframe(i, x)) for i in range(16)]) for x in ("fine", "offsets", "zeros")}
    of = lambda x: F.get(lists[x], (e % 16).cast("int"))
    x = v.table(s, d, "events").select(F.concat(F.lit("S"), F.col("user_id") % 16).alias("stream_id"), (F.col("user_id") % 64).cast("int").alias("sub_channel_id"), e, F.when(e % 13 == 0, of("zeros")).when(e % 11 == 0, of("offsets")).otherwise(of("fine")).alias("sf"))
    ends = F.array(*[F.array(*[F.lit(first + (i + 1) * ((FILLED - first) // n) if i + 1 < n else FILLED) for i in range(n)]) for n, first in (FORMATS[i & 1, i >> 1 & 1] for i in range(16))])
    end = F.get(F.get(ends, (e % 16).cast("int")), (e % F.size(F.get(ends, (e % 16).cast("int")))).cast("int"))
    put = lambda at, byte: F.concat(F.substring("sf", F.lit(1), at), F.lit(byte), F.substring("sf", at + 2, F.lit(WHOLE)))
    x = x.withColumn("sf", F.when(e % 7 == 0, F.concat(F.lit(b"\xa5\xa5"), F.substring("sf", 3, WHOLE))).when(e % 5 == 0, put(end - 3, b"\xee")).otherwise(F.col("sf")))
    x = x.select("stream_id", "sub_channel_id", e, "sf", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i"))
    return x.select("stream_id", "sub_channel_id", (e * 5 + F.col("i")).alias("frame_no"), F.substring("sf", F.col("i") * 24 + 1, F.lit(24)).alias("payload"))


UNITS = """(SELECT 'S' || (user_id % 16) AS stream_id, (user_id % 64)::INT AS sub_channel_id, event_id AS e, event_id * 5 AS frame_no, event_id & 1 AS rate, (event_id >> 1) & 1 AS sbr, (event_id >> 2) & 1 AS stereo, (event_id >> 3) & 1 AS ps,
    CASE event_id & 3 WHEN 2 THEN 2 WHEN 3 THEN 3 WHEN 0 THEN 4 ELSE 6 END AS aus, CASE event_id & 3 WHEN 2 THEN 5 WHEN 3 THEN 6 WHEN 0 THEN 8 ELSE 11 END AS first, event_id % 11 <> 0 AS offsets_ok FROM events WHERE event_id % 7 <> 0 AND event_id % 13 <> 0)"""
EACH = f"""(SELECT stream_id, sub_channel_id, frame_no, ps, sbr, au::INT AS au, (first + au * ((110 - first) // aus))::INT AS "offset", (CASE WHEN au + 1 < aus THEN (110 - first) // aus ELSE 110 - first - au * ((110 - first) // aus) END)::INT AS size, NOT (e % 5 = 0 AND e % aus = au) AS crc_ok, CASE WHEN au = 0 THEN 2 END AS pad_offset, CASE WHEN au = 0 THEN 4 END AS pad_size
    FROM (SELECT *, unnest(range(aus)) AS au FROM {UNITS}) WHERE offsets_ok)"""
SPAN = 4096


@query("k10_superframes", f"SELECT stream_id, sub_channel_id, frame_no, CASE rate WHEN 1 THEN 48 ELSE 32 END AS rate_khz, sbr = 1 AS sbr, stereo = 1 AS stereo, ps = 1 AS ps, aus, 8 AS kbps, offsets_ok FROM {UNITS}")
def k10(s, d):
    return k.superframes(msc(s, d), 1, SPAN).drop("payload", "starts")


@query("k10_access_units", f'SELECT stream_id, sub_channel_id, frame_no, au, "offset", size, crc_ok, pad_offset, pad_size FROM {EACH}')
def k10_units(s, d):
    return k.access_units(k.superframes(msc(s, d), 1, SPAN)).drop("data")


@query("k11_audio_metrics", f"""WITH s AS (SELECT stream_id, sub_channel_id, CASE WHEN ps = 1 THEN 'v2' WHEN sbr = 1 THEN 'v1' ELSE 'lc' END AS profile, count(*) AS superframes, count(*) FILTER (NOT offsets_ok) AS bad_offsets FROM {UNITS} GROUP BY ALL),
    u AS (SELECT stream_id, sub_channel_id, CASE WHEN ps = 1 THEN 'v2' WHEN sbr = 1 THEN 'v1' ELSE 'lc' END AS profile, count(*) AS units, count(*) FILTER (NOT crc_ok) AS unit_errors, count(pad_offset) AS pads FROM {EACH} GROUP BY ALL)
    SELECT stream_id, sub_channel_id, profile, superframes, 8 AS kbps, bad_offsets, coalesce(units, 0) AS units, coalesce(unit_errors, 0) AS unit_errors, coalesce(pads, 0) AS pads, bad_offsets = 0 AND coalesce(unit_errors, 0) = 0 AS aus_ok, round(1 - unit_errors / units, 6) AS units_ok FROM s LEFT JOIN u USING (stream_id, sub_channel_id, profile)""")
def k11(s, d):
    sf = k.superframes(msc(s, d), 1, SPAN)
    return k.audio_metrics(sf, k.access_units(sf)).drop("quality", "low")


@query("r03_access_unit_rules", f"""WITH u AS (SELECT stream_id, sub_channel_id, frame_no, bool_and(crc_ok) AS ok FROM {EACH} GROUP BY ALL), s AS (SELECT s.*, coalesce(u.ok, true) AND offsets_ok AS aus_ok FROM {UNITS} s LEFT JOIN u USING (stream_id, sub_channel_id, frame_no))
    SELECT stream_id, sub_channel_id, frame_no, x.r AS rule_id FROM (SELECT *, unnest([{{'b': ps = 1 AND sbr = 0, 'r': 'ps_without_sbr'}}, {{'b': ps = 1 AND stereo = 1, 'r': 'ps_and_stereo'}}, {{'b': NOT aus_ok, 'r': 'au_crc'}}, {{'b': NOT offsets_ok, 'r': 'au_offsets'}}]) AS x FROM s) WHERE x.b""")
def r03_units(s, d):
    keys = ["stream_id", "sub_channel_id", "frame_no"]
    sf = k.superframes(msc(s, d), 1, SPAN)
    n = k.unit_counters(sf, k.access_units(sf), *keys)
    x = sf.join(n.select(*keys, "aus_ok"), keys).withColumn("fire_ok", F.lit(True))
    return r.validate(x, r.superframe_rules(), keys).select(*keys, "rule_id")
