"""Known bytes, odd rows and partition counts for the core operators; queries against DuckDB."""

import hashlib
import os
import zlib

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

from muxlake.functions import bits, text
from muxlake.operators import catalog, figs, health, payload, reports, rules, timing
from muxlake.plans import registry
from muxlake.sources import frames as fr

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def crc_by_bits(data, polynomial, width, start):
    c, top, mask = start, 1 << (width - 1), (1 << width) - 1
    for byte in data:
        c ^= byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
    return c


def one(spark, data, expr):
    return spark.createDataFrame([(bytearray(data),)], "data binary").select(expr.alias("x")).first().x


@pytest.mark.parametrize("data", [b"\x00", b"123456789", bytes(range(30)), b"\xff" * 30])
def test_checksums(spark, data):
    d = F.col("data")
    assert one(spark, data, bits.crc16(d)) == crc_by_bits(data, 0x1021, 16, 0xFFFF)
    assert one(spark, data, bits.crc32_frame(d)) == crc_by_bits(data, 0x04C11DB7, 32, 0xFFFFFFFF) ^ 0xFFFFFFFF
    assert one(spark, data, bits.fire_code(d)) == crc_by_bits(data, 0x782F, 16, 0)
    assert one(spark, data, F.crc32(d)) == zlib.crc32(data)
    assert one(spark, data, bits.crc16_of(d, 30)) == (crc_by_bits(data, 0x1021, 16, 0xFFFF) if len(data) == 30 else None)


def test_bytes_beyond_the_end_are_null(spark):
    assert one(spark, b"\x01\x02", bits.u(F.col("data"), 1, 2)) is None
    assert one(spark, b"\x01\x02", bits.u(F.col("data"), 0, 2)) == 258
    assert one(spark, b"", bits.crc16(F.col("data"))) == 0xFFFF


def fib(spark, area):
    return spark.createDataFrame([("s", 1, 0, True, bytearray(area.ljust(30, b"\xff")))], "stream_id string, frame_no long, fib_no int, crc_ok boolean, area binary")


def test_fig_walk(spark):
    ok = figs.explode_figs(fib(spark, bytes([0x02, 0x00, 1, 0x21, 0x05, 0xFF]))).orderBy("seq").collect()
    assert [(r.fig_type, r.ext, r.len, bytes(r.data), r.ended_badly) for r in ok] == [(0, 0, 2, b"\x00\x01", False), (1, 5, 1, b"\x05", False)]
    bad = figs.explode_figs(fib(spark, bytes([0x01, 0x00, 0x1D]) + bytes(27))).collect()
    assert [(r.fig_type, r.ended_badly) for r in bad] == [(0, True)]  # the second block overruns the area
    assert figs.explode_figs(fib(spark, b"")).count() == 0


def fig(spark, fig_type, ext, *data):
    return spark.createDataFrame([("s", i, fig_type, ext, bytearray(d)) for i, d in enumerate(data)], "stream_id string, frame_no long, fig_type int, ext int, data binary")


def test_mixed_subchannel_entries(spark):
    d = bytes([1, 0x04, 0x10, 0x25, 0x08, 0x20, 0x8C, 0x30, 0x0C])  # short, long, then a truncated one
    r = figs.fig0_1(fig(spark, 0, 1, d)).collect()
    assert [(x.sub_channel_id, x.start_address, x.uep, x.size, x.table_index, x.protection_level) for x in r] == [(1, 16, True, 0, 37, 0), (2, 32, False, 48, None, 4)]


def test_data_services_and_components(spark):
    d = bytes([0x22, 0xE1, 0xC0, 0x12, 0x34, 0x02, 0x3F, 0x06, 0xC5, 0x09])
    r = figs.fig0_2(fig(spark, 0, 2, d)).collect()
    assert [(hex(x.sid), x.ecc, x.country_id, x.tmid, x.asc_ty, x.sub_channel_id, x.primary, x.ca) for x in r] == [("0xe1c01234", 0xE1, 12, 0, 63, 1, True, False), ("0xe1c01234", 0xE1, 12, 3, 5, 2, False, True)]


def test_frequencies(spark):
    d = bytes([21, 0x00, 0x2A, 0x10, 0x01, 0x03, 0x00, 0x36, 0xB0, 0xAB, 0xCD, 0x82, 10])  # a DAB list, then a list that overruns
    r = figs.fig0_21(fig(spark, 0, 21, d)).collect()
    assert [(x.region_id, x.kind, x.freq_khz) for x in r][0] == (1, 0, 16 * 0x36B0)


def test_geo_main_and_sub(spark):
    d = bytes([22, 0x05, 0x40, 0x00, 0xC0, 0x00, 0x12, 0x85, 0x01, 0x18, 0x07, 0x00, 0x10, 0xFF, 0xF0])
    r = {x.is_main: x for x in figs.fig0_22(fig(spark, 0, 22, d)).collect()}
    assert r[True].latitude == pytest.approx((0x40001) * 90 / 524288) and r[True].longitude == pytest.approx((-0x4000 * 16 + 2) * 180 / 524288)
    assert (r[False].main_id, r[False].sub_id, r[False].delay, r[False].lat_offset, r[False].lon_offset) == (5, 3, 7, 16, -16)


def test_extended_country_codes(spark):
    d = bytes([9, 0x80, 0xE1, 1, 0x80, 0xE2, 0x10, 0x01, 0x10, 0x02, 0x40, 0xE3, 0x10, 0x03])
    assert [(x.sid, x.ecc) for x in figs.fig0_9_services(fig(spark, 0, 9, d)).collect()] == [(0x1001, 0xE2), (0x1002, 0xE2), (0x1003, 0xE3)]


def test_labels(spark):
    d = bytes([0x00, 0x10, 0x01]) + b"Caf\x82 \x8dne\0\0      " [:16].ljust(16) + b"\xf0\x00"
    r = figs.fig1_0(fig(spark, 1, 0, d)).first()
    assert (r.label, r.short_label) == ("Café Çne"[:5] + text.EBU_HIGH[0x0D] + "ne", "Café")
    thai = bytes([0x60, 0x10, 0x01]) + bytes([0xA1, 0xDF, 0xFB]).ljust(16)
    assert figs.fig1_0(fig(spark, 1, 0, thai)).first().label == "ก฿๛"
    assert len(text.EBU_FROM) == len(text.EBU_TO) == 31 + 9 + 128


def test_modes(spark):
    rows = [("s", 1, i, ok) for i, ok in enumerate([True, False])] + [("s", 2, i, False) for i in range(2)]
    f = spark.createDataFrame(rows, "stream_id string, frame_no long, fib_no int, crc_ok boolean")
    count = lambda mode: sorted((r.frame_no, r.fib_no) for r in figs.fic_mode(f, mode).collect())
    assert count("strict") == [(1, 0)] and count("auto") == [(1, 0), (2, 0), (2, 1)] and len(count("raw")) == 4


def test_capture_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    frame = bytes.fromhex("FFF8C549") + bytes(6140)
    (tmp_path / "sub/a.eti").write_bytes(frame * 3 + b"x" * 100)
    (tmp_path / "b.eti").write_bytes(b"\0" * 6144)
    (tmp_path / "empty.eti").write_bytes(b"")
    f = fr.read_frames(spark, str(tmp_path))
    assert f.groupBy("stream_id").count().count() == 2 and f.count() == 4
    assert [r.tail_bytes for r in fr.partial_frames(spark, str(tmp_path)).collect()] == [100]
    p = {r.n_bytes: r.format for r in fr.capture_profile(spark, str(tmp_path)).collect()}
    assert p == {3 * 6144 + 100: "NI", 6144: "unknown"}  # Spark reads no empty files
    v = {r.n_frames: r for r in fr.validate_capture(f).collect()}
    assert v[3].usable and not v[1].usable and v[1].corrupt == 1


def test_jitter_and_quality_folds(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    ms = [0, 20, 45, 61, 90]
    p = spark.createDataFrame([("s", t0 + dt.timedelta(milliseconds=m), i * 960) for i, m in enumerate(ms)], "stream_id string, arrival timestamp, rtp_ts long")
    d = [abs((b - a) - 20) for a, b in zip(ms, ms[1:])]
    j = d[0]
    for x in d[1:]:
        j += (x - j) * 0.125
    assert timing.rtp_jitter(p).first().jitter == pytest.approx(j, abs=1e-6)
    f = spark.createDataFrame([("s", i, i % 4 != 0) for i in range(50)], "stream_id string, frame_no long, valid boolean")
    q = 1.0
    for i in range(50):
        q = min(1.0, max(0.0, q + (0.01 if i % 4 else -0.05)))
    assert timing.running_quality(f).first().quality == pytest.approx(q)


def test_reordering_is_not_loss(spark):
    p = spark.createDataFrame([("s", i, s) for i, s in enumerate([65534, 65535, 0, 2, 1, 1, 3])], "stream_id string, arrival long, seq int")
    r = [(x.lost, x.duplicate, x.reordered) for x in timing.sequence_loss(p).orderBy("arrival").collect()]
    assert r == [(0, False, False)] * 3 + [(1, False, False), (0, False, True), (0, True, False), (1, False, False)]


def test_superframe_lock(spark):
    head = bytes([0x60, 0x12]) + bytes(7)  # a header of zeros isn't one
    first = crc_by_bits(head, 0x782F, 16, 0).to_bytes(2, "big") + head
    sf = first + bytes([0x55]) * (5 * 24 - len(first))
    stream = bytes([1]) * 48 + sf + sf
    rows = [("s", 1, i, bytearray(stream[i * 24 : i * 24 + 24])) for i in range(len(stream) // 24)]
    r = payload.superframes(spark.createDataFrame(rows, "stream_id string, sub_channel_id int, frame_no long, payload binary"), 1).collect()
    assert sorted((x.frame_no, x.rate_khz, x.sbr, x.aus) for x in r) == [(2, 48, True, 3), (7, 48, True, 3)]
    m = payload.audio_metrics(spark.createDataFrame(r)).first()
    assert (m.profile, m.superframes, m.kbps) == ("v1", 2, 8)


def test_tone(spark):
    import numpy as np

    x = np.sin(2 * np.pi * 8 * np.arange(256) / 256) + 0.1 * np.sin(2 * np.pi * 16 * np.arange(256) / 256)
    s = payload.spectrum(spark.createDataFrame([(1, x.tolist()), (2, [])], "id long, x array<double>"), "id", "x")
    r = payload.distortion(s, "id").first()
    assert r.fundamental == 8 and r.thd == pytest.approx(10, abs=0.5)


def test_exports(spark, tmp_path):
    df = spark.createDataFrame([(1, "a<b"), (2, None)], "id long, label string")
    for fmt in ("csv", "json", "xml", "html"):
        reports.export(df, str(tmp_path / fmt), fmt)
        assert any(p.name.startswith("part-") for p in (tmp_path / fmt).iterdir())
    assert "a&lt;b" in "".join(p.read_text() for p in (tmp_path / "html").glob("part-*"))
    with pytest.raises(ValueError):
        reports.export(df, str(tmp_path / "x"), "pdf")
    f = spark.sql("SELECT 's' AS stream_id, TIMESTAMP '2024-01-01 01:30:00' AS ts, 1 AS x")
    reports.record_segments(f, str(tmp_path / "rec"))
    assert spark.read.parquet(str(tmp_path / "rec")).count() == 1
    assert reports.render_yaml({"a": {"b": 1}}) == "a:\n  b: 1"


def test_rules_of_nulls_are_not_broken(spark):
    df = spark.createDataFrame([("s", None, 300, None, 9)], "stream_id string, sync_ok boolean, fc int, nst int, mid int")
    assert [r.rule_id for r in rules.validate(df, rules.framing_rules(), ["stream_id"]).collect()] == ["frame_count", "mode"]


def test_empty_tables(spark):
    f = spark.createDataFrame([], "stream_id string, frame_no long, fig_type int, ext int, crc_ok boolean, erroneous boolean")
    assert health.fig_inventory(f).count() == 0 and timing.fig_intervals(f).count() == 0
    s = spark.createDataFrame([], "stream_id string, sub_channel_id int, start_address int, size int")
    assert catalog.overlapping_subchannels(s).count() == 0


def cell(x):
    if x is None or x is pd.NaT or x is pd.NA or x != x:
        return None
    if isinstance(x, bool) or type(x).__name__ in ("bool", "bool_"):
        return str(bool(x))
    if isinstance(x, (int, float)) or getattr(getattr(x, "dtype", None), "kind", "-") in "iuf":
        return repr(round(float(x), 4) + 0.0)
    return str(x)


def rows_of(df):
    return sorted(repr(tuple(map(cell, r))) for r in df[sorted(df.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLE:
        assert rows_of(got) == rows_of(duck.sql(registry.ORACLE[name]).df())
    else:
        assert len(got)
