"""Streams over files: stateful operators on known rows, windowed ones equal to their batch form."""

import datetime as dt

from pyspark.sql import functions as F

from muxlake.operators import timing
from muxlake.streaming import feeds

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


def run(df, tmp_path, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def drop(spark, tmp_path, schema, *batches):
    """Each batch becomes a file; the stream reads one a trigger."""
    import time

    path = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
        time.sleep(1.1)  # files are read in order of their time
    return feeds.stream_rows(spark, path, schema, 1)


def test_dedupe(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, seq int, ts timestamp", [("a", 1, at(0)), ("a", 1, at(1)), ("a", 2, at(2))], [("a", 2, at(3))])
    assert sorted((r.seq) for r in run(feeds.dedupe_stream(s, ["stream_id", "seq"]), tmp_path, "dedupe")) == [1, 2]


def test_pft(spark, tmp_path):
    f = "stream_id string, pseq int, findex int, fcount int, ts timestamp, payload binary"
    s = drop(spark, tmp_path, f, [("a", 1, 1, 2, at(0), b"B"), ("a", 2, 0, 3, at(0), b"x"), ("a", 3, 5, 2, at(0), b"?")], [("a", 1, 0, 2, at(1), b"A"), ("a", 2, 0, 3, at(1), b"x")], [("a", 9, 0, 1, at(100), b"z")], [("a", 9, 0, 1, at(200), b"z")])
    rows = {r.pseq: r for r in run(feeds.reassemble_pft_stream(s), tmp_path, "pft")}
    assert rows[1].complete and bytes(rows[1].packet) == b"AB"
    assert not rows[2].complete and rows[2].duplicates == 1
    assert rows[3].invalid == 1 and not rows[3].complete


def test_status(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, sid long, ts timestamp", [("a", 1, at(0)), ("a", 2, at(0))], [("a", 1, at(50))], [("a", 1, at(100))], [("a", 1, at(150))])
    rows = [(r.sid, r.status) for r in run(feeds.service_status_stream(s), tmp_path, "status")]
    assert sorted(rows) == [(1, "available"), (2, "available"), (2, "unavailable")]


def test_registry(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, ts timestamp, deletion boolean", [("a", at(0), False), ("b", at(0), False)], [("a", at(5), True), ("c", at(400), False)], [("c", at(401), False)])
    rows = sorted((r.stream_id, r.event) for r in run(feeds.announcement_registry_stream(s), tmp_path, "registry"))
    assert rows == [("a", "added"), ("a", "removed"), ("b", "added"), ("b", "expired"), ("c", "added")]


def test_alerts(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, metric string, ts timestamp, value double", [("a", "m", at(0), 9.0), ("a", "m", at(10), 1.0)], [("a", "m", at(45), 1.0), ("a", "m", at(50), 9.0), ("a", "m", at(70), 9.0)])
    rows = [(r.event, r.at_ms - int(T0.timestamp() * 1000)) for r in run(feeds.alert_stream(s, 5.0), tmp_path, "alerts")]
    assert rows == [("raised", 0), ("cleared", 45_000), ("raised", 70_000)]


def test_reorder(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, seq int, ts timestamp", [("a", 2, at(0)), ("a", 1, at(0.05)), ("a", 3, at(1))], [("a", 5, at(2)), ("a", 4, at(2.1))], [("a", 6, at(60))], [("a", 7, at(120))])
    seqs = [r.seq for r in run(feeds.reorder_stream(s), tmp_path, "reorder")]
    assert seqs[:5] == [1, 2, 3, 4, 5]


def test_windows_equal_batch(spark, tmp_path):
    schema = "stream_id string, ts timestamp, n_bytes long"
    rows = [("a", at(i / 3), i) for i in range(60)] + [("a", at(4000), 1)]
    s = drop(spark, tmp_path, schema, rows[:30], rows[30:])
    got = {r.window_start: r.mbit_s for r in run(timing.bandwidth(s.withWatermark("ts", "1 minute")), tmp_path, "bandwidth")}
    want = {r.window_start: r.mbit_s for r in timing.bandwidth(spark.createDataFrame(rows, schema)).collect()}
    assert got and all(want[k] == v for k, v in got.items()) and len(got) >= len(want) - 1


def test_redundant_feeds(spark, tmp_path):
    schema = "stream_id string, seq int, ts timestamp, payload string"
    (tmp_path / "p").mkdir(), (tmp_path / "b").mkdir()
    p = drop(spark, tmp_path / "p", schema, [("a", 1, at(0), "p1"), ("a", 3, at(1), "p3")], [("a", 99, at(900), "p99")], [("a", 100, at(1800), "p100")])
    b = drop(spark, tmp_path / "b", schema, [("a", 1, at(0), "b1"), ("a", 2, at(1), "b2")], [("a", 99, at(900), "b99")], [("a", 100, at(1800), "b100")])
    rows = {r.seq: (r.payload, r.used) for r in run(feeds.merge_redundant_stream(p, b), tmp_path, "redundant")}
    assert rows[1] == ("p1", "primary") and rows[2] == ("b2", "backup") and rows[3] == ("p3", "primary")


def test_frames_from_files(spark, tmp_path):
    path = tmp_path / "captures"
    path.mkdir()
    (path / "x.eti").write_bytes(bytes(6144) + bytes([255]) * 6144 + b"tail")
    rows = run(feeds.stream_frames(spark, str(path)).select("frame_no", F.hex(F.substring("raw", 1, 1)).alias("b")), tmp_path, "frames")
    assert sorted((r.frame_no, r.b) for r in rows) == [(0, "00"), (1, "FF")]


def test_upsert(spark, tmp_path):
    from muxlake.streaming.catalog_store import CatalogStore

    schema = "stream_id string, sid long, ts timestamp, label string"
    s = drop(spark, tmp_path, schema, [("a", 1, at(0), "x"), ("a", 1, at(1), "y")], [("a", 1, at(2), "z")])
    feeds.upsert_catalog(spark, s, str(tmp_path / "out"), str(tmp_path / "cp"), ["stream_id", "sid"]).awaitTermination(60)
    store = CatalogStore(spark, str(tmp_path / "out"), ["stream_id", "sid"], compact_every=3, keep=1)
    assert [r.label for r in store.read().collect()] == ["z"] and store.manifest()["batch"] == 1
    before = store.read()  # a reader that began before what follows
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    assert not store.upsert(rows(("a", 1, at(9), "twice")), 1)  # delivered again
    assert store.upsert(rows(("a", 1, at(1), "older"), ("b", 2, at(3), "new"), (None, 3, at(3), "null")), 2)
    state = store.manifest()
    assert state["base"] and not state["changes"]  # the third change was compacted
    assert sorted(r.label for r in store.read().collect()) == ["new", "null", "z"]
    assert [r.label for r in before.collect()] == ["z"]
    for i in range(3, 9):
        store.upsert(rows(("b", 2, at(i + 1), f"n{i}")), i)
    assert sorted(r.label for r in store.read().collect()) == ["n8", "null", "z"]
    assert len(list((tmp_path / "out").glob("base-*"))) <= 2 and len(list((tmp_path / "out/_manifests").glob("[0-9]*.json"))) == 2


def test_reorder_over_the_end_of_numbers(spark, tmp_path):
    s = drop(spark, tmp_path, "stream_id string, seq int, ts timestamp", [("a", 65535, at(0)), ("a", 65534, at(0.05)), ("a", 0, at(0.1)), ("a", 1, at(1))], [("a", 3, at(2)), ("a", 2, at(2.1)), ("a", 65533, at(2.2))], [("a", 4, at(60))], [("a", 5, at(120))])
    seqs = [r.seq for r in run(feeds.reorder_stream(s), tmp_path, "wrap")]
    assert seqs[:6] == [65534, 65535, 0, 1, 2, 3]


def test_mot_assembly(spark, tmp_path):
    schema = "stream_id string, transport_id long, kind string, seg_no int, last boolean, payload binary, ts timestamp"
    seg = lambda t, n, last, data, s, kind="body": ("a", t, kind, n, last, data, at(s))
    first = [seg(1, 0, False, b"h1", 0, "header"), seg(1, 0, False, b"ab", 1), seg(1, 0, False, b"xx", 2), seg(2, 0, False, b"no", 1)]
    second = [seg(1, 1, True, b"cd", 3), seg(3, 0, True, b"one", 3)]
    s = drop(spark, tmp_path, schema, first, second, [seg(4, 0, True, b"late", 500)], [seg(5, 0, True, b"later", 600)])
    rows = {(r.transport_id, r.complete, bytes(r.payload) if r.payload is not None else None) for r in run(feeds.assemble_mot_stream(s), tmp_path, "mot")}
    assert {(1, True, b"abcd"), (2, False, None), (3, True, b"one")} <= rows


# State variables and timers


def test_strict_order_waits_for_a_gap(spark, tmp_path):
    batches = [[("a", 1, at(0)), ("a", 2, at(0.05)), ("a", 4, at(0.1)), ("a", 5, at(1))], [("a", 6, at(2))], [("a", 3, at(3)), ("a", 7, at(3.1))], [("a", 9, at(4))], [("a", 10, at(30))], [("a", 11, at(60))]]
    s = drop(spark, tmp_path, "stream_id string, seq int, ts timestamp", *batches)
    rows = run(feeds.reorder_stream(s, delay_ms=1000, strict=True), tmp_path, "strict")
    seqs = [r.seq for r in rows]
    assert seqs[:7] == [1, 2, 3, 4, 5, 6, 7] and seqs[7] == 9  # 8 never came: 9 went out as it got old
    late = {r.seq: r.late for r in rows}
    assert not late[2] and late[4] and late[9]


def test_alerts_escalate_and_are_acknowledged(spark, tmp_path):
    schema = "stream_id string, metric string, ts timestamp, value double, action string"
    first = [("a", "m", at(0), 9.0, None), ("b", "m", at(0), 9.0, None), ("b", "m", at(60), None, "acknowledge"), ("c", "m", at(0), 9.0, None), ("c", "m", at(20), None, "resolve"), ("c", "m", at(30), 9.0, None), ("c", "m", at(70), 9.0, None), ("d", "m", None, 9.0, None)]
    s = drop(spark, tmp_path, schema, first, [("z", "m", at(1000), 1.0, None)], [("z", "m", at(2000), 1.0, None)])
    t0 = int(T0.timestamp() * 1000)
    rows = sorted((r.stream_id, r.at_ms - t0, r.event) for r in run(feeds.alert_stream(s, 5.0), tmp_path, "escalation"))
    assert rows == [("a", 0, "raised"), ("a", 300_000, "escalated"), ("b", 0, "raised"), ("b", 60_000, "acknowledged"), ("c", 0, "raised"), ("c", 20_000, "resolved"), ("c", 70_000, "raised"), ("c", 370_000, "escalated")]


def test_late_repeats_of_a_whole_packet(spark, tmp_path):
    f = "stream_id string, pseq int, findex int, fcount int, ts timestamp, payload binary"
    s = drop(spark, tmp_path, f, [("a", 1, 1, 2, at(0), b"B"), ("a", 1, 0, 2, at(1), b"A")], [("a", 1, 0, 2, at(2), b"A")], [("a", 9, 0, 2, at(100), b"z")], [("a", 8, 0, 2, at(200), b"z")])
    rows = [(r.pseq, r.complete, r.out_of_order) for r in run(feeds.reassemble_pft_stream(s), tmp_path, "repeats")]
    assert rows == [(1, True, 1), (9, False, 0)]  # the repeat opens no packet of its own


def test_state_goes_on_after_a_restart(spark, tmp_path):
    schema = "stream_id string, sid long, ts timestamp"
    s = drop(spark, tmp_path, schema, [("a", 1, at(0))])
    mark, out = str(tmp_path / "mark"), str(tmp_path / "out")

    def go():
        q = feeds.service_status_stream(s).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return sorted((r.sid, r.status) for r in spark.read.parquet(out).collect())

    assert go() == [(1, "available")]
    drop(spark, tmp_path, schema, [("a", 1, at(30)), ("a", 2, at(500))], [("a", 2, at(501))])
    assert go() == [(1, "available"), (1, "unavailable"), (2, "available")]
