"""Rules over sets, text over borders, access units, reports, sketches and checksums: a breaking row each, odd rows, brute force."""

import json
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from muxlake.functions import bits
from muxlake.operators import payload, reports, rules, rulesets, sketches, texts
from muxlake.operators.figs import label_sessions


def found(df):
    return sorted((r.rule_id, r.severity, r.subject, r.message) for r in df.collect())


# Rules


def test_framing_rules_break_one_by_one(spark):
    h = "stream_id string, frame_no long, n_bytes int, sync_ok boolean, fc int, nst int, mid int, fic_ok boolean, eoh_ok boolean, tist long, frame_bytes int"
    fine = ("s", 6144, True, 3, 1, True, True, 5, 3096)
    rows = [(fine[0], i, fine[1], fine[2], i % 250, *fine[3:]) for i in range(249, 253)]  # the count goes on at 0 after 249
    assert found(rulesets.validate_all({"headers": spark.createDataFrame(rows, h)}, rulesets.framing())) == []
    bad = [("s", 1, 6000, False, 251, 64, 0, False, False, 0x80000000, 1728), ("s", 2, None, None, None, None, None, None, None, None, None), ("t", 7, 6144, True, 7, 1, 2, True, True, 0xFFFFFFFF, 1728), ("t", 8, 6144, True, 9, 1, 2, True, True, 1, 1728)]
    got = found(rulesets.validate_all({"headers": spark.createDataFrame(bad, h)}, rulesets.framing()))
    assert [x[0] for x in got] == ["fic_crc", "frame_count", "frame_sequence", "header_crc", "mode", "nst", "size", "sync", "time_stamp"]
    assert next(x for x in got if x[0] == "frame_sequence")[2:] == ("8", "frame count out of sequence: 9")
    stc = spark.createDataFrame([("s", 1, 800), ("s", 1, 65), ("s", 2, 864)], "stream_id string, frame_no long, size int")
    assert found(rulesets.validate_all({"stc": stc}, rulesets.framing())) == [("capacity", "error", "1", "capacity units 865")]


def test_rules_of_missing_columns_and_tables(spark):
    df = spark.createDataFrame([("s", 1, False)], "stream_id string, frame_no long, sync_ok boolean")
    row = next(r for r in rulesets.framing() if isinstance(r, rulesets.RowRules))
    assert [r.rule_id for r in row.breaches(df).collect()] == ["sync"]
    assert rules.validate(df.select("stream_id"), [rules.Rule("x", "y", "z", F.col("a") > 1, "m", ("a",))], ["stream_id"]).isEmpty()
    with pytest.raises(ValueError, match="no table"):
        rulesets.validate_all({"other": df}, rulesets.framing())


@pytest.mark.parametrize("seed", range(4))
def test_sweep_agrees_with_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"m{i % 3}", i, rng.randrange(60), rng.randrange(-1, 9)) for i in range(40)]
    df = spark.createDataFrame(rows, "stream_id string, sub_channel_id int, start_address int, size int")
    rule = rulesets.SweepRule("subchannels", ["stream_id"], "start_address", "size", "overlap", "x", "error")
    want = []
    for m in {r[0] for r in rows}:
        deep = [sum(a <= p < a + n for s, _, a, n in rows if s == m) > 1 for p in range(80)]
        for p in range(80):
            if deep[p] and not (p and deep[p - 1]):
                end = next(q for q in range(p, 81) if q == 80 or not deep[q])
                want.append((m, str(p), f"overlap from {p} to {end - 1}"))
    assert sorted((r.stream_id, r.subject, r.message) for r in rule.breaches(df).collect()) == sorted(want)


def test_members_and_groups(spark):
    figs = spark.createDataFrame([("a", 0, 0), ("a", 0, 1), ("a", 0, 2), ("b", 0, 1), ("b", 9, 9)], "stream_id string, fig_type int, ext int")
    parts = spark.createDataFrame([("a", 1, True, 0, 1), ("a", 1, True, 5, 1), ("a", 2, False, 3, 64)], "stream_id string, sid long, primary boolean, tmid int, sub_channel_id int")
    got = rulesets.validate_all({"figs": figs, "components": parts}, rulesets.broadcasting())
    assert [(x[0], x[1], x[2]) for x in found(got)] == [("mandatory_fig", "error", "0/0"), ("mandatory_fig", "info", "0/2"), ("no_primary", "warning", "2"), ("primaries", "error", "1"), ("sub_channel", "error", "2"), ("tmid", "error", "1")]


# Text over borders


def runs_of(data, least=6):
    return [m.group() for m in re.finditer(rb"[\x20-\x7e]{%d,}" % least, data)]


@pytest.mark.parametrize("size", [1, 2, 5, 24, 1000])
def test_runs_over_any_borders(spark, size):
    rng = random.Random(size)
    rows, want = [], {}
    for k in range(3):
        data = b"".join(bytes(rng.choice(b"abc xyz") for _ in range(rng.randrange(0, 20))) + rng.choice([b"", b"\0", b"\n", b"\xc3", b"\r\n"]) for _ in range(40))
        want[k] = runs_of(data)
        rows += [(k, i // size, data[i : i + size]) for i in range(0, len(data), size)]
    df = spark.createDataFrame(rows, "k int, chunk_no long, payload binary").repartition(4)
    got = {k: [] for k in want}
    for r in sorted(texts.stream_runs(df, ["k"], span=4).collect(), key=lambda r: (r.first_chunk, r.place)):
        got[r.k].append(bytes(r.raw))
    assert got == want


def test_a_missing_chunk_breaks_a_run(spark):
    rows = [("s", 1, b"abcd"), ("s", 2, b"efgh"), ("s", 4, b"ijklmn"), ("s", 5, b""), ("s", 6, b"opqrst"), ("t", 7, None)]
    df = spark.createDataFrame(rows, "s string, chunk_no long, payload binary")
    got = sorted((r.first_chunk, r.last_chunk, bytes(r.raw)) for r in texts.stream_runs(df, ["s"]).collect())
    assert got == [(1, 2, b"abcdefgh"), (4, 4, b"ijklmn"), (6, 6, b"opqrst")]
    inv = texts.message_inventory(texts.stream_runs(df.unionByName(df.where("chunk_no = 4").withColumn("chunk_no", F.lit(9).cast("long"))), ["s"]), ["s"])
    assert {(r.text, r.repeats, r.first_chunk, r.last_chunk) for r in inv.collect()} == {("abcdefgh", 1, 1, 2), ("ijklmn", 2, 4, 9), ("opqrst", 1, 6, 6)}


def test_carousel_items(spark):
    data = "\nhr4 - Britta am Vormittag\n" + "Die ARD-Hitnacht ist eine Sendung mit Musik\x00" + "{~^|<>}{~^|<>}\x01" + "Ein Text ohne Titel davor, lang genug für einen\x02ไทยข้อความ\x03"
    raw = data.encode()
    df = spark.createDataFrame([("s", i // 7, raw[i : i + 7]) for i in range(0, len(raw), 7)], "stream_id string, chunk_no long, payload binary")
    got = sorted((r.object_id, r.title, r.text) for r in texts.journaline_items(df, ["stream_id"], span=3).collect())
    assert got[0] == (0x8000, "hr4 - Britta am Vormittag", "") and got[1] == (0x8001, "hr4 - Britta am Vormittag", "Die ARD-Hitnacht ist eine Sendung mit Musik")
    assert got[2] == (0x8002, "", "Ein Text ohne Titel davor, lang genug für einen")


def test_dynamic_labels_of_odd_bytes(spark):
    tag = lambda t, s, start, n: (t << 12 | s << 8).to_bytes(2, "big") + (start << 9 | (n >> 6) << 8 | (n & 63) << 2).to_bytes(2, "big")
    rows = [
        (1, b"\x0fArtist - Song\0\x02" + tag(1, 3, 0, 6) + tag(1, 0, 9, 4)),
        (2, b"\x8f\x00Caf\xe9\0\x01" + tag(1, 0, 0, 5)),  # Latin, after an extended field's byte; é is two bytes of the text
        (3, b"\x0fshort\0\x01" + tag(1, 0, 3, 9)),  # beyond the text
        (4, b"\x0fcut\0\x03" + tag(1, 0, 0, 3) + b"\x10"),  # a command that is cut off
        (5, b"\x0f\0\x01"), (6, b"\x0f"), (7, None), (8, b"\x0fbad \xff utf\0\x09" + tag(1, 0, 0, 3)),
    ]
    got = {r.id: (r.charset, r.text, [(t.type, t.subtype, t.value) for t in r.tags]) for r in texts.dynamic_labels(spark.createDataFrame(rows, "id int, payload binary")).collect()}
    assert got == {1: (15, "Artist - Song", [(1, 3, "Artist"), (1, 0, "Song")]), 2: (0, "Café", [(1, 0, "Café")]), 3: (15, "short", []), 4: (15, "cut", [(1, 0, "cut")]), 8: (15, "bad � utf", [])}


def test_label_sessions(spark):
    rows = [("s", 1, 0, 7, 0, 0, True, "ไท".encode("utf-16-be")), ("s", 2, 0, 7, 0, 1, False, "ย".encode("utf-16-be")), ("s", 2, 0, 7, 0, 0, True, b"xx"), ("s", 5, 0, 7, 1, 0, False, b"ab"), ("s", 6, 0, 7, 1, 2, False, b"ef"), ("s", 9, 0, 7, 0, 0, False, b"\xc3\xa9")]
    df = spark.createDataFrame(rows, "stream_id string, frame_no long, ext int, id long, toggle int, segment int, ucs2 boolean, part binary")
    got = sorted((r.session, r.first_frame, r.last_frame, r.bitmap, r.complete, r.label) for r in label_sessions(df, span=2).collect())
    assert got == [(1, 1, 2, 3, True, "ไทย"), (2, 5, 6, 5, False, None), (3, 9, 9, 1, True, "é")]


# Access units and checksums


def test_checksums_of_a_batch(spark):
    import pyarrow as pa

    rng = random.Random(1)
    data = [None, b"", b"\0"] + [rng.randbytes(rng.randrange(0, 300)) for _ in range(60)]
    for part in (pa.array(data, pa.binary()), pa.array([b"x", *data], pa.binary())[1:]):
        got = bits.crc_arrow(part, 0x1021, 16, 0xFFFF).to_pylist()
        want = [None if x is None else by_bits(x, 0x1021, 16, 0xFFFF) for x in data]
        assert got == want
    flip = lambda c: int(f"{c:032b}"[::-1], 2)
    mirrored = [bytes(int(f"{b:08b}"[::-1], 2) for b in x) for x in data[1:]]
    assert [flip(c ^ 0xFFFFFFFF) for c in bits.crc_arrow(pa.array(mirrored, pa.binary()), 0x04C11DB7, 32, 0xFFFFFFFF).to_pylist()] == [zlib.crc32(x) for x in data[1:]]
    assert bits.crc_arrow(pa.array([], pa.binary()), 0x1021, 16, 0).to_pylist() == []


def by_bits(data, polynomial, width, c):
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c >> (width - 1) else c << 1) & ((1 << width) - 1)
    return c


def test_access_units_of_odd_superframes(spark):
    from muxlake.plans.audio import superframe

    fine, falling, zeros = (superframe(0, x) for x in ("fine", "offsets", "zeros"))
    assert [len(x) for x in (fine, falling, zeros)] == [120] * 3
    broken = fine[:20] + bytes([fine[20] ^ 1]) + fine[21:]  # inside the first unit's data
    rows = [("s", 1, 5 * k + i, (fine, falling, zeros, broken)[k][24 * i : 24 * i + 24]) for k in range(4) for i in range(5)]
    rows += [("gap", 1, i + (i > 2), fine[24 * i : 24 * i + 24]) for i in range(5)] + [("s", 2, 0, None)]
    sf = payload.superframes(spark.createDataFrame(rows, "stream_id string, sub_channel_id int, frame_no long, payload binary"), 1, span=4)
    assert sorted((r.stream_id, r.frame_no, r.offsets_ok) for r in sf.collect()) == [("s", 0, True), ("s", 5, False), ("s", 15, True)]
    units = payload.access_units(sf)
    got = sorted((r.frame_no, r.au, r.crc_ok, r.pad_offset, r.pad_size) for r in units.collect())
    assert got == [(f, a, not (f == 15 and a == 0), 2 if a == 0 else None, 4 if a == 0 else None) for f in (0, 15) for a in range(4)]
    n = payload.unit_counters(sf, units, "stream_id").first()
    assert (n.superframes, n.bad_offsets, n.units, n.unit_errors, n.pads, n.aus_ok) == (3, 1, 8, 1, 2, False)


# Reports and sketches


def test_yaml_reads_back():
    tree = {"a": 1, "b": {"c": "plain text", "d": 'quote " and: colon', "e": None, "f": True}, "list": [{"x": 1, "z": [1, 2]}, {"x": "yes", "z": []}], "empty": {}, "m": "12", "t": " padded ", "u": "ไทย\n"}
    text = reports.render_yaml(tree)
    assert 'd: "quote \\" and: colon"' in text and "z: []" in text and 'm: "12"' in text and 'x: "yes"' in text and "c: plain text" in text and "empty: {}" in text
    assert text.split("list:\n")[1].startswith("  - x: 1\n    z:\n      - 1\n      - 2\n  - x: ")
    assert reports.render_yaml({"a": {"b": 1}}) == "a:\n  b: 1"


def test_reports_are_written(spark, tmp_path):
    t = lambda rows, schema: spark.createDataFrame(rows, "stream_id string, " + schema)
    tree = reports.report_tree(t([("s", True, False, False, 1.5), ("s", False, True, True, 2.5)], "valid boolean, dropped boolean, errored boolean, latency double"), t([("s", 4096, "En: semble")], "eid int, label string"), t([("s", 2, None, "audio", "active"), ("s", 1, "One", "data", "idle")], "sid long, label string, kind string, status string"), t([], "sub_channel_id int, start_address int, size int"), t([("s", 0, 0, True)], "fig_type int, ext int, crc_ok boolean"), t([("s", "r1", "critical"), ("s", "r1", "info"), ("x", "r2", "odd")], "rule_id string, severity string"))
    got = {r.stream_id: json.loads(r.j) for r in tree.select("stream_id", F.to_json("report", {"ignoreNullFields": "false"}).alias("j")).collect()}
    assert list(got["s"]) == ["stream", "ensemble", "services", "subchannels", "figs", "fic_health", "fig_stats", "compliance", "performance"]
    assert got["s"]["services"] == {"summary": {"n": 2, "audio": 1, "data": 1, "active": 1}, "items": [{"sid": 1, "label": "One", "kind": "data", "status": "idle"}, {"sid": 2, "label": "", "kind": "audio", "status": "active"}]}
    assert got["s"]["compliance"]["summary"]["score"] == 10_000 - 1510 and got["s"]["subchannels"] == {"summary": None, "items": []}
    assert got["x"]["stream"] is None and got["x"]["compliance"]["rules"] == [{"rule_id": "r2", "n": 1}]
    for fmt in ("yaml", "json"):
        reports.write_report(tree, str(tmp_path / fmt), fmt)
    text = "".join(p.read_text() for p in (tmp_path / "yaml").glob("part-*"))
    assert '---\nstream_id: "s"\nstream:\n  total_frames: 2\n' in text and 'label: "En: semble"' in text
    with pytest.raises(ValueError):
        reports.write_report(tree, str(tmp_path / "x"), "pdf")


def test_sketches_merge(spark):
    df = spark.range(20_000).select((F.col("id") % 3).alias("k"), F.timestamp_seconds(F.col("id") * 2).alias("ts"), F.when(F.col("id") % 50 > 0, F.col("id").cast("double")).alias("value"), (F.col("id") % 5000).alias("u"))
    spans = sketches.sketch_spans(df, ["k"], distinct=["u"])
    assert spans.count() == 3 * 12 and spans.columns == ["k", "span_start", "n", "least", "most", "quantiles", "distinct_u"]
    whole = sketches.answers(sketches.merge_spans(spans.withColumn("all", F.lit(1)), ["all"])).first()
    assert whole.n == 20_000 and whole.least == 1 and whole.most == 19_999
    assert abs(whole.q50 - 10_000) < 600 and abs(whole.q99 - 19_800) < 600 and abs(whole.n_u - 5000) < 250
    assert sketches.answers(sketches.merge_spans(sketches.sketch_spans(df.limit(0), ["k"]), ["k"])).isEmpty()
