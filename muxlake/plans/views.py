"""The driver's tables read as the schemas of the operators, for Spark and, as SQL text, for the checks."""

from __future__ import annotations

from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    """Registers a function (spark, sf_dir) under name, with its SQL if it has one."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(name: str, sql: str):
    """A view by one SQL text that Spark and DuckDB read alike, over tables named in braces."""
    VIEWS[name] = sql

    def frame(spark, sf_dir):
        names = [t for t in ("events", "orders", "lineitem", "customer", "supplier", "part", "nation", "embeddings") if "{" + t + "}" in sql]
        return spark.sql(sql, **{t: table(spark, sf_dir, t) for t in names})

    return frame


VIEWS: dict[str, str] = {}


def sql(text: str) -> str:
    """Replaces $view by its text."""
    for name in sorted(VIEWS, key=len, reverse=True):
        text = text.replace("$" + name, "(" + VIEWS[name].replace("{", "").replace("}", "") + ")")
    return text


#: Signalling blocks: type and extension from the event, bad CRC at low values.
figs = view("figs", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, ts, CAST(user_id % 3 AS INT) AS fig_type, CAST(length(event_type) AS INT) AS ext, value >= 2 AS crc_ok, value < 0.5 AS erroneous FROM {events}")
frames = view("frames", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, ts, value >= 3 AS valid, value < 3 AS errored, event_type = 'error' AS dropped, value AS latency, CAST(floor(value) AS INT) AS level_no FROM {events}")
headers = view("headers", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, value >= 1 AS sync_ok, CAST(event_id % 256 AS INT) AS fc, CAST(user_id % 70 AS INT) AS nst, CAST(event_id % 5 AS INT) AS mid FROM {events}")
errors = view("errors", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, ts, event_type AS category, CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 < 3 THEN 'high' WHEN event_id % 7 = 3 THEN 'medium' ELSE 'low' END AS severity FROM {events}")
logs = view("logs", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS entry_id, ts, event_type AS category, CASE WHEN event_id % 7 = 0 THEN 'critical' WHEN event_id % 7 < 3 THEN 'error' WHEN event_id % 7 = 3 THEN 'warning' ELSE 'info' END AS severity, props AS message FROM {events}")
measurements = view("measurements", "SELECT concat('S', user_id % 16) AS stream_id, event_id AS frame_no, ts, event_type AS metric, value FROM {events}")
packets = view("packets", "SELECT concat('S', user_id % 16) AS stream_id, CAST(event_id % 65536 AS INT) AS seq, event_id AS arrival_no, ts AS arrival, ts, event_id * 1152 AS rtp_ts, CAST(floor(value * 100) AS BIGINT) AS n_bytes, event_type AS payload FROM {events} WHERE event_id % 13 <> 0")
violations = view("violations", "SELECT concat('M', l_suppkey % 10) AS stream_id, l_orderkey AS frame_no, concat('R', l_linenumber) AS rule_id, l_returnflag AS category, CASE WHEN l_discount < 0.015 THEN 'critical' WHEN l_discount < 0.035 THEN 'error' WHEN l_discount < 0.075 THEN 'warning' WHEN l_discount < 0.095 THEN 'info' ELSE 'pass' END AS severity, l_linestatus = 'O' AS active FROM {lineitem}")
alerts = view("alerts", "SELECT o_orderkey AS alert_id, o_orderdate AS ts, 6 - CAST(substring(o_orderpriority, 1, 1) AS INT) AS severity, CAST(o_custkey % 8 + 1 AS INT) AS category, o_orderstatus = 'O' AS active, o_orderstatus = 'P' AS acknowledged, o_orderstatus = 'F' AS resolved, o_totalprice AS amount FROM {orders}")
services = view("services", "SELECT concat('M', c_nationkey) AS stream_id, c_custkey AS sid, CAST(c_custkey % 64 AS INT) AS sub_channel_id, CAST(4096 + c_nationkey AS INT) AS eid, CASE WHEN c_custkey % 10 = 0 THEN '' ELSE c_name END AS label, CASE WHEN c_mktsegment IN ('MACHINERY', 'BUILDING') THEN 'data' ELSE 'audio' END AS kind, CASE WHEN c_custkey % 4 = 0 THEN 'idle' ELSE 'active' END AS status, CASE WHEN c_custkey % 9 = 0 THEN 0.0 ELSE CAST(c_custkey % 101 AS DOUBLE) END AS signal, CAST(c_custkey % 13 AS DOUBLE) / 100 AS error_rate, c_custkey % 6 <> 0 AS etsi_ok, c_custkey % 5 <> 0 AS plan_ok, CAST(c_custkey % 3 * 225 AS INT) AS ecc, CAST(c_custkey % 4 AS INT) AS tmid, CAST(c_custkey % 64 AS INT) AS asc_ty FROM {customer}")
subchannels = view("subchannels", "SELECT concat('M', s_nationkey) AS stream_id, CAST(s_suppkey % 64 AS INT) AS sub_channel_id, CAST(s_suppkey * 7 % 800 AS INT) AS start_address, CAST(24 + s_suppkey % 40 AS INT) AS size FROM {supplier}")
labels = view("labels_", "SELECT concat('M', c_nationkey) AS stream_id, c_custkey + 5 AS sid, upper(c_name) AS label FROM {customer} WHERE c_custkey % 3 <> 0")
apps = view("apps", "SELECT concat('M', c_nationkey) AS stream_id, c_custkey AS sid, CAST(c_custkey % 5 AS INT) AS app_type FROM {customer}")
schedule = view("schedule", "SELECT o_custkey AS service_id, o_orderkey AS event_id, o_orderdate AS start_time, o_orderdate + INTERVAL 10 DAYS AS end_time FROM {orders}")
switches = view("switches", "SELECT concat('S', user_id % 16) AS stream_id, CAST(user_id % 4 AS INT) AS cluster, event_id AS frame_no, CAST(CASE WHEN value < 20 THEN 0 ELSE floor(value) END AS INT) AS asw, CAST(user_id % 64 AS INT) AS sub_channel_id FROM {events}")
