"""Queries over frames as a real capture may hold them: damaged, short, of all sync words, modes and protections."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.plans import views as v
from muxlake.plans.views import query
from muxlake.sources import dims
from muxlake.sources import frames as fr
from muxlake.sources.stored import stored

E = """(SELECT 'S' || (user_id % 16) AS stream_id, event_id AS frame_no, event_id AS e, user_id AS u, CASE WHEN event_id % 97 = 0 THEN 'zeros' WHEN event_id % 101 = 0 THEN 'ones' WHEN event_id % 103 = 0 THEN 'short' ELSE 'whole' END AS kind FROM events)"""
WHOLE = f"(SELECT * FROM {E} WHERE kind = 'whole')"


def frames(s, d):
    return stored(s, ("odd frames", d), lambda: fr.frames_from_events(v.table(s, d, "events"), odd=True))


def whole(s, d):
    return fr.frame_header(frames(s, d).where(~fr.corrupt_frame(F.col("raw"))))


@query("s05_validate_capture", f"""SELECT stream_id, count(*) AS n_frames, count(*) FILTER (bad) AS bad_sync, count(*) FILTER (kind <> 'whole') AS corrupt, count(*) FILTER (bad) < count(*) AS usable
    FROM (SELECT *, kind IN ('zeros', 'ones') OR e % 50 = 0 AS bad FROM {E}) GROUP BY 1""")
def s05(s, d):
    return fr.validate_capture(frames(s, d))


@query("p01_frame_header", f"""SELECT stream_id, frame_no, CASE kind WHEN 'zeros' THEN 0 WHEN 'ones' THEN 255 ELSE e % 250 END::INT AS fc, CASE kind WHEN 'zeros' THEN false WHEN 'ones' THEN true ELSE e % 43 <> 0 END AS ficf, CASE kind WHEN 'zeros' THEN 0 WHEN 'ones' THEN 127 ELSE u % 4 END::INT AS nst,
    CASE kind WHEN 'zeros' THEN 0 WHEN 'ones' THEN 7 ELSE e % 8 END::INT AS fp, CASE WHEN kind = 'zeros' THEN 0 WHEN kind = 'ones' OR e % 23 = 0 THEN 3 ELSE 1 END AS mid, CASE kind WHEN 'zeros' THEN 0 WHEN 'ones' THEN 2047 ELSE e % 2000 END::INT AS fl FROM {E}""")
def p01(s, d):
    return fr.frame_header(frames(s, d)).select("stream_id", "frame_no", "fc", "ficf", "nst", "fp", "mid", "fl")


TABLE = ", ".join(f"({'true' if uep else 'false'}, {code}, '{name}', {units})" for uep, code, name, units in
                  [(True, i, f"UEP-{level + 1}", units) for i, (units, level) in enumerate(zip(dims.UEP_CU[:8], dims.UEP_LEVEL[:8], strict=True))]
                  + [(False, 4 * o + k, f"EEP-{'AB'[o]}", units) for o, sizes in enumerate((dims.EEP_A_CU, dims.EEP_B_CU)) for k, units in enumerate(sizes)])


@query("p05_protection_lookup", f"""SELECT stream_id, i::INT AS sub_channel_id, protection, table_cu, count(*) AS n FROM (SELECT stream_id, i, uep, CASE WHEN uep THEN e % 16 % 8 ELSE e % 2 * 4 + e // 2 % 4 END AS code FROM (SELECT *, (e + i) % 5 = 0 AS uep FROM (SELECT *, unnest(range(u % 4)) AS i FROM {WHOLE}))) x
    JOIN (VALUES {TABLE}) t(uep, code, protection, table_cu) ON t.uep = x.uep AND t.code = x.code GROUP BY ALL""")
def p05(s, d):
    return dims.protection_lookup(fr.explode_stc(whole(s, d))).groupBy("stream_id", "sub_channel_id", "protection", "table_cu").agg(F.count("*").alias("n"))


@query("p07_slice_fic", f"SELECT stream_id, CASE WHEN e % 23 = 0 THEN 128 ELSE 96 END AS n_bytes, count(*) AS n FROM {WHOLE} WHERE e % 43 <> 0 GROUP BY ALL")
def p07(s, d):
    return fr.slice_fic(whole(s, d)).groupBy("stream_id", F.octet_length("fic").alias("n_bytes")).agg(F.count("*").alias("n"))


@query("p08_blocks_of_modes", f"SELECT stream_id, k::INT AS fib_no, count(*) AS n, count(*) FILTER (k = 0 AND e % 20 = 0) AS crc_failures FROM (SELECT *, unnest(range(CASE WHEN e % 23 = 0 THEN 4 ELSE 3 END)) AS k FROM {WHOLE} WHERE e % 43 <> 0) GROUP BY ALL")
def p08(s, d):
    return fr.explode_fibs(fr.slice_fic(whole(s, d))).groupBy("stream_id", "fib_no").agg(F.count("*").alias("n"), F.count_if(~F.col("crc_ok")).alias("crc_failures"))


@query("p11_eoh_crc_check", f"SELECT stream_id, count(*) AS n, count(*) FILTER (e % 31 = 0) AS failures FROM {WHOLE} GROUP BY 1")
def p11(s, d):
    return fr.eoh_crc_ok(whole(s, d)).groupBy("stream_id").agg(F.count("*").alias("n"), F.count_if(~F.col("eoh_ok")).alias("failures"))


@query("p22_corrupt_frame", f"SELECT stream_id, count(*) FILTER (kind <> 'whole') AS corrupt, count(*) AS n FROM {E} GROUP BY 1")
def p22(s, d):
    return frames(s, d).groupBy("stream_id").agg(F.count_if(fr.corrupt_frame(F.col("raw"))).alias("corrupt"), F.count("*").alias("n"))


@query("s03_formats_of_sync_words", f"SELECT stream_id, CASE WHEN kind IN ('zeros', 'ones') OR e % 50 = 0 THEN 'unknown' WHEN e % 11 = 6 THEN 'LI' WHEN e % 11 IN (7, 9) THEN 'NI' ELSE 'unknown' END AS format, count(*) AS n FROM {E} GROUP BY 1, 2")
def s03(s, d):
    return frames(s, d).groupBy("stream_id", fr.detect_format(F.col("raw")).alias("format")).agg(F.count("*").alias("n"))
