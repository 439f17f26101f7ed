"""Queries whose faults only show on larger tables or at values that the small ones don't hold."""

import datetime as dt
import random
import re

import duckdb
import pyarrow as pa
import pytest

from muxlake.operators import catalog, payload
from muxlake.operators import figs as g
from muxlake.plans import registry, signalling
from muxlake.sources import frames as fr


def events(spark, path, rows):
    """A table folder with events of (event_id, user_id, value)."""
    held = [(e, dt.datetime(2024, 1, 1), u, "view", float(x), "{}") for e, u, x in rows]
    spark.createDataFrame(held, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").write.parquet(str(path / "events.parquet"))
    return str(path)


def test_frames_are_built_by_tasks_of_a_bounded_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fr, "FRAMES_A_TASK", 10)
    d = events(spark, tmp_path, [(i, i, 1) for i in range(200)])
    for odd in (False, True):
        built = fr.frames_from_events(spark.read.parquet(d + "/events.parquet"), odd)
        assert built.rdd.getNumPartitions() == 20
        assert built.where("length(raw) > 6144").count() == 0 and built.count() == 200
    blocks = signalling.fibs(spark, d).where("crc_ok").count()
    assert blocks == 3 * 200 - 200 // 20


def test_repeated_switches_do_not_meet_every_service(spark):
    """4000 repeats of a switch and 4000 services: 16 million pairs for 4000 rows if repeats are joined."""
    switches = spark.range(4000).selectExpr("'s' AS stream_id", "1 AS cluster", "id AS frame_no", "IF(id = 7, 0, 1) AS asw", "5 AS sub_channel_id")
    components = spark.range(8000).selectExpr("'s' AS stream_id", "5 AS sub_channel_id", "id % 4000 AS sid")
    out = catalog.announcements_active(switches, components)
    assert out.count() == out.distinct().count() == 4000
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")  # no aggregate is above the join


def test_quality_on_the_edge_of_a_level(spark, tmp_path):
    """0.4 * 27 + 0.3 * 96 + 0.2 * 2 + 0.1 * 100 is 50."""
    customer = spark.createDataFrame([(704704, "x", 1, 1.0, "MACHINERY")], "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string")
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    assert [tuple(r) for r in registry.QUERIES["a32_overall_quality"](spark, str(tmp_path)).collect()] == [(704704, 50.0, "poor")]


def test_silence_in_decibels(spark, tmp_path):
    d = events(spark, tmp_path, [(0, 1, 0), (1, 1, 10)])
    got = {r.event_id: (r.db, r.amplitude) for r in registry.QUERIES["c13_to_db"](spark, d).collect()}
    assert got == {0: (float("-inf"), 1.0), 1: (20.0, pytest.approx(3.1623))}


def test_decibels_to_the_last_bit(spark, tmp_path):
    d = events(spark, tmp_path, [(i, 1, i * 0.37) for i in range(4000)] + [(4000, 1, 6159.9), (4001, 1, 7000)])
    null = spark.read.parquet(d + "/events.parquet").selectExpr("max(event_id) + 1 AS event_id", "max(ts) AS ts", "1L AS user_id", "'view' AS event_type", "CAST(NULL AS DOUBLE) AS value", "'{}' AS props")
    null.write.mode("append").parquet(d + "/events.parquet")
    got = sorted(tuple(r) for r in registry.QUERIES["c13_to_db"](spark, d).collect())
    want = duckdb.sql(registry.ORACLE["c13_to_db"].replace("FROM events", f"FROM read_parquet('{d}/events.parquet/*.parquet')")).fetchall()
    assert got == sorted(want) and got[-1] == (4002, None, None)


WIDE = [1, 28671, 28672, 61438, 61439, 61440, 89999, 2_000_000]


def test_services_of_more_than_16_bits(spark, tmp_path):
    d = events(spark, tmp_path, [(i + 1, u, 1) for i, u in enumerate(WIDE)])
    got = sorted((r.stream_id, r.sid, r.country_id, r.sub_channel_id, r.is_programme) for r in registry.QUERIES["g02_service_org"](spark, d).collect())
    assert got == sorted((f"S{u % 16}", 4096 + u, (4096 + u) >> 12, u % 64, True) for u in WIDE)


def test_labels_of_services_of_more_than_15_bits(spark, tmp_path):
    d = events(spark, tmp_path, [(i + 1, u, 1) for i, u in enumerate(WIDE)])
    got = sorted((r.stream_id, r.sid, r.is_programme, r.label) for r in registry.QUERIES["g31_service_label"](spark, d).collect())
    assert got == sorted((f"S{u % 16}", 4096 + u, True, "VIEW") for u in WIDE)


def test_traces_of_services_of_more_than_15_bits(spark, tmp_path):
    d = events(spark, tmp_path, [(i + 1, u, 1) for i, u in enumerate(WIDE)])
    got = sorted(r.line for r in registry.QUERIES["p33_fig_trace"](spark, d).collect())
    assert got == sorted(f"FIG 1/1 SId 0x{4096 + u:04X} label VIEW" for u in WIDE)


def test_superframes_take_their_header_check_over_batches(spark):
    """As an expression of masked words it was too much code for the JVM to compile."""
    msc = spark.createDataFrame([], "stream_id string, sub_channel_id int, frame_no long, payload binary")
    assert "ArrowEvalPython" in payload.superframes(msc, 1)._jdf.queryExecution().optimizedPlan().toString()


def below(df, node):
    """The line of the plan under the first such node."""
    lines = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    return lines[next(i for i, line in enumerate(lines) if node in line) + 1]


def frame(nst, crc_of, cut=None):
    """A frame of no FIC: its header, a list of sub-channels and the checksum over both."""
    head = bytes([7, nst, 8, 0]) + b"".join((i << 26 | 24 * i << 16 | 0x22 << 10 | 24).to_bytes(4, "big") for i in range(nst)) + b"\x12\x34"
    raw = b"\xff\xf8\xc5\x49" + head + ((fr._crc_of(head) ^ 0xFFFF) ^ crc_of).to_bytes(2, "big") + bytes(50)
    return raw[:cut]


def test_header_checksums_hold_no_whole_frames(spark):
    """A batch of frames of 6 KB waited beside the few bytes of each that are summed."""
    rows = [("a", 0, frame(0, 0)), ("a", 1, frame(3, 0)), ("a", 2, frame(3, 1)), ("a", 3, frame(3, 0, 4 + 4 + 12 + 2 + 2)), ("a", 4, frame(3, 0, 4 + 4 + 12 + 2 + 1)), ("a", 5, frame(64, 0)), ("a", 6, b""), ("a", 7, None)]
    h = fr.frame_header(spark.createDataFrame(rows, "stream_id string, frame_no long, raw binary"))
    out = fr.eoh_crc_ok(h)
    assert out.columns == [*h.columns, "eoh_ok"]
    assert [r.eoh_ok for r in out.orderBy("frame_no").collect()] == [True, True, False, True, None, True, None, None]
    used = out.groupBy("stream_id").agg({"eoh_ok": "count"})
    assert not re.search(r"[\[ ]raw#\d+[,\]]", below(used, "ArrowEvalPython"))


def blocks(area):
    """Offsets of an area's blocks, byte by byte, and whether their list ended badly."""
    at = []
    p = 0
    while area is not None and p < len(area) and area[p] >> 5 != 7 and area[p] & 31 and p + 1 + (area[p] & 31) <= len(area):
        at.append(p)
        p += 1 + (area[p] & 31)
    return at, area is not None and p < len(area) and area[p] >> 5 != 7


def test_blocks_are_walked_a_batch_at_once(spark):
    """As one aggregate of a list, a step a row, the walk took most of the time of all queries of FIGs."""
    random.seed(5)
    byte = lambda: random.choice([random.randrange(256), 32 * random.randrange(7) + random.randrange(8), 1, 2])
    areas = [None, b"", b"\x00", b"\x01", b"\xff" * 30, b"\x1e" + bytes(30), bytes(30)] + [bytes(byte() for _ in range(random.choice([1, 2, 3, 17, 30, 30, 30]))) for _ in range(3000)]
    for some in (areas, areas[:1], areas[:0]):
        got = g.list_figs(pa.array([b"\x01"] + some, pa.binary()).slice(1)).to_pylist()
        assert [([f["at"] for f in x["figs"]], x["ended_badly"]) for x in got] == [blocks(a) for a in some]
    fibs = spark.createDataFrame([("s", i, 0, True, a) for i, a in enumerate(areas)], "stream_id string, frame_no long, fib_no int, crc_ok boolean, area binary")
    figs = g.explode_figs(fibs)
    want = sorted((i, n, areas[i][p] >> 5, areas[i][p] & 31, areas[i][p + 1 : p + 1 + (areas[i][p] & 31)], bad) for i in range(len(areas)) for at, bad in [blocks(areas[i])] for n, p in enumerate(at) if areas[i][p] & 31 <= 29)
    assert sorted((r.frame_no, r.seq, r.fig_type, r.len, bytes(r.data), r.ended_badly) for r in figs.collect()) == want
    plan = figs._jdf.queryExecution().optimizedPlan().toString()
    assert "ArrowEvalPython" in plan and "lambdafunction" not in plan
