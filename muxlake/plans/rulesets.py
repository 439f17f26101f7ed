"""Queries of rules over sets (R01, R02, R05) and of the national plan's blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.operators import catalog as c
from muxlake.operators import rulesets as r
from muxlake.plans import views as v
from muxlake.plans.views import query, sql, view
from muxlake.sources import dims

headers = view("set_headers", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, value >= 1 AS sync_ok, CAST(event_id % 256 AS INT) AS fc, CAST(user_id % 70 AS INT) AS nst, CAST(event_id % 6 AS INT) AS mid, value >= 2 AS fic_ok, event_id % 31 <> 0 AS eoh_ok, CASE WHEN event_id % 5 = 0 THEN 4294967295 ELSE event_id * 7919 % 4294967296 END AS tist, CASE WHEN event_id % 3 = 0 THEN 3096 WHEN event_id % 3 = 1 THEN 1728 ELSE 1152 END AS frame_bytes FROM {events}")
stc = view("set_stc", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, CAST(user_id % 900 + i AS INT) AS size FROM {events}, (SELECT 0 AS i UNION ALL SELECT 400 AS i) AS x")
ensembles = view("set_ensembles", "SELECT concat('M', n_nationkey) AS stream_id, CASE WHEN n_nationkey % 7 = 0 THEN 0 ELSE 4096 + n_nationkey END AS eid, CAST(n_nationkey % 17 AS INT) AS country_id, concat(n_name, n_name) AS label FROM {nation}")
components = view("set_components", "SELECT concat('M', c_nationkey) AS stream_id, c_custkey % 41 AS sid, c_custkey % 4 = 0 AS primary, CAST(c_custkey % 6 AS INT) AS tmid, CAST(c_custkey % 67 AS INT) AS sub_channel_id FROM {customer}")
places = view("set_places", "SELECT concat('M', s_nationkey) AS stream_id, CAST(s_suppkey % 64 AS INT) AS sub_channel_id, CAST(s_suppkey * 7 % 800 AS INT) AS start_address, CAST(24 + s_suppkey % 40 * 3 AS INT) AS size, s_suppkey % 2 = 0 AS uep, CAST(s_suppkey % 7 AS INT) AS protection_level FROM {supplier}")
licences = view("set_licences", """SELECT concat('M', c_nationkey) AS stream_id, c_custkey AS sid, CASE CAST(c_custkey % 5 AS INT) WHEN 0 THEN 'Commercial' WHEN 1 THEN 'Public Service' WHEN 2 THEN 'Community' WHEN 3 THEN 'Government' ELSE CASE WHEN c_nationkey % 3 = 0 THEN 'Government' ELSE 'Emergency' END END AS kind,
    round(170 + CAST(c_custkey * 107 % 4500 AS DOUBLE) * 0.016, 3) AS mhz, CASE WHEN c_custkey % 19 = 0 THEN 'Casino FM' WHEN c_custkey % 23 = 0 THEN '' ELSE c_name END AS label, c_custkey % 29 <> 0 AS label_ok, CAST(c_custkey % 20 AS INT) AS country_id, c_custkey % 11 / 10.0 AS signal, c_custkey % 13 <> 0 AS continuous,
    CASE WHEN c_custkey % 15 = 0 THEN '' WHEN c_custkey % 10 = 0 THEN 'TH 12' ELSE concat('TH-2024-', c_custkey) END AS licence, c_acctbal * 300 AS guarantee, c_custkey % 6 <> 0 AS authorised, c_custkey % 12 <> 2 AS licence_valid, CAST(c_custkey % 150 AS INT) AS watts, c_acctbal * 200 AS insurance, concat(c_mktsegment, c_name, c_mktsegment) AS description FROM {customer}""")

BREACH = "stream_id, x.s AS standard, x.r AS rule_id, x.v AS severity, subject FROM (SELECT *, unnest([%s]) AS x FROM %s) WHERE x.b"


def rows(table: str, standard: str, subject: str, *rules: tuple[str, str, str]) -> str:
    """SQL of rules (id, severity, condition) over each row of a table."""
    each = ", ".join(f"{{'b': {b}, 'r': '{i}', 's': '{standard}', 'v': '{s}'}}" for i, s, b in rules)
    return "SELECT " + BREACH % (each, f"(SELECT *, ({subject})::VARCHAR AS subject FROM {table})")


def breaches(tables, rulesets):
    return r.validate_all(tables, rulesets).drop("message")


ETI = "EN 300 799"


@query("r01_framing_sets", sql(" UNION ALL ".join([
    rows("$set_headers", ETI, "frame_no", ("sync", "critical", "NOT sync_ok"), ("frame_count", "error", "fc > 249"), ("nst", "error", "nst > 63"), ("mode", "error", "mid NOT BETWEEN 1 AND 4"), ("fic_crc", "error", "NOT fic_ok"), ("header_crc", "critical", "NOT eoh_ok"), ("time_stamp", "warning", "tist > 2147483647 AND tist <> 4294967295"), ("frame_length", "error", "frame_bytes <> CASE mid WHEN 1 THEN 3096 WHEN 2 THEN 1728 WHEN 3 THEN 1152 WHEN 4 THEN 864 END")),
    rows("(SELECT *, (lag(fc) OVER (PARTITION BY stream_id ORDER BY frame_no) + 1) % 250 AS expected FROM $set_headers)", ETI, "frame_no", ("frame_sequence", "error", "fc <> expected")),
    rows("(SELECT stream_id, frame_no, sum(size) AS units FROM $set_stc GROUP BY 1, 2)", ETI, "frame_no", ("capacity", "error", "units > 864")),
])))
def r01_sets(s, d):
    return breaches({"headers": headers(s, d), "stc": stc(s, d)}, r.framing(span=1024))


DAB = "EN 300 401"
SWEEP = """(WITH e AS (SELECT stream_id, p AS place, sum(st) AS step FROM (SELECT stream_id, start_address AS p, 1 AS st FROM $set_places UNION ALL SELECT stream_id, start_address + size, -1 FROM $set_places) GROUP BY 1, 2),
    d AS (SELECT stream_id, place, sum(step) OVER (PARTITION BY stream_id ORDER BY place) AS deep FROM e), w AS (SELECT *, coalesce(lag(deep) OVER (PARTITION BY stream_id ORDER BY place), 0) AS was FROM d) SELECT * FROM w)"""


@query("r02_broadcast_sets", sql(" UNION ALL ".join([
    rows("$set_ensembles", DAB, "eid", ("eid", "error", "eid IN (0, 65535)"), ("country", "error", "country_id NOT BETWEEN 1 AND 15"), ("label_length", "error", "length(label) > 16")),
    rows("$services", DAB, "sid", ("sid", "error", "sid IN (0, 65535)"), ("label", "warning", "coalesce(label, '') = ''"), ("label_length", "error", "length(label) > 16")),
    rows("$set_components", DAB, "sid", ("tmid", "error", "tmid NOT BETWEEN 0 AND 3"), ("sub_channel", "error", "sub_channel_id NOT BETWEEN 0 AND 63")),
    rows("(SELECT stream_id, sid, count(*) FILTER (\"primary\") AS n FROM $set_components GROUP BY 1, 2)", DAB, "sid", ("no_primary", "warning", "n = 0"), ("primaries", "error", "n > 1")),
    rows("$set_places", DAB, "sub_channel_id", ("boundary", "error", "start_address + size > 864"), ("protection", "error", "CASE WHEN uep THEN protection_level NOT BETWEEN 1 AND 5 ELSE protection_level NOT BETWEEN 1 AND 4 END")),
    rows("(SELECT stream_id, sum(size) AS n FROM $set_places GROUP BY 1)", DAB, "'stream'", ("capacity", "error", "n > 864")),
    rows(SWEEP, DAB, "place", ("overlap", "error", "deep > 1 AND was <= 1")),
    f"SELECT stream_id, '{DAB}' AS standard, 'mandatory_fig' AS rule_id, v AS severity, t || '/' || x AS subject FROM (SELECT DISTINCT stream_id FROM $figs) q, (VALUES (0, 0, 'error'), (0, 1, 'error'), (0, 2, 'info')) w(t, x, v) WHERE NOT EXISTS (SELECT 1 FROM $figs f WHERE f.stream_id = q.stream_id AND fig_type = t AND ext = x)",
])))
def r02_sets(s, d):
    e = s.sql(v.VIEWS["set_ensembles"], nation=v.table(s, d, "nation"))
    return breaches({"ensembles": e, "services": v.services(s, d).select("stream_id", "sid", "label"), "components": components(s, d), "subchannels": places(s, d), "figs": v.figs(s, d)}, r.broadcasting())


PLAN = ", ".join(f"({mhz}, '{block}', '{use}')" for mhz, block, use in dims.FREQUENCY_PLAN)
MATCHED = f"(SELECT l.*, plan_mhz, block FROM $set_licences l LEFT JOIN (VALUES {PLAN}) p(plan_mhz, block, use) ON abs(mhz - plan_mhz) < 0.001)"


@query("r05_national_sets", sql(" UNION ALL ".join([
    rows(MATCHED, "national plan", "sid", ("band", "critical", "mhz NOT BETWEEN 174 AND 240"), ("plan", "error", "plan_mhz IS NULL"), ("encoding", "error", "NOT label_ok"), ("content", "error", "regexp_matches(lower(label), 'gambling|casino|adult')"), ("emergency_country", "error", "kind = 'Emergency' AND country_id <> 15"), ("emergency_signal", "error", "kind = 'Emergency' AND signal < 0.8"), ("emergency_hours", "error", "kind = 'Emergency' AND NOT continuous"),
        ("licence", "error", "kind = 'Commercial' AND licence = ''"), ("licence_form", "error", "kind = 'Commercial' AND licence <> '' AND NOT regexp_matches(licence, '^[A-Za-z0-9-]{10,}$')"), ("guarantee", "error", "kind = 'Commercial' AND guarantee < 1000000"), ("authorisation", "error", "kind = 'Public Service' AND NOT authorised"), ("community_licence", "error", "kind = 'Community' AND NOT licence_valid"), ("community_power", "error", "kind = 'Community' AND watts > 100"),
        ("insurance", "error", "insurance < 500000"), ("label", "error", "label = ''"), ("label_length", "error", "length(label) > 16"), ("description_length", "warning", "length(description) > 128")),
    rows("(SELECT stream_id, count(*) FILTER (kind = 'Emergency') AS n FROM $set_licences GROUP BY 1)", "national plan", "'stream'", ("no_emergency", "warning", "n = 0")),
])))
def r05_sets(s, d):
    x = c.frequency_plan_match(licences(s, d), dims.frequency_plan(s).select("plan_mhz"))
    return breaches({"licences": x}, r.national())


@query("s18_frequency_plan", sql(f"SELECT sid, mhz, block, use FROM (SELECT l.sid, mhz, block, use FROM $set_licences l LEFT JOIN (VALUES {PLAN}) p(plan_mhz, block, use) ON abs(mhz - plan_mhz) < 0.001)"))
def s18_plan(s, d):
    return c.frequency_plan_match(licences(s, d), dims.frequency_plan(s)).select("sid", "mhz", "block", "use")
