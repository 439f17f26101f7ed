"""Captures by byte ranges: batch and stream, cut-off records, growing files, files beyond 2 GB."""

import hashlib
import json
import os

import pytest
from pyspark.sql import functions as F

from muxlake.sources import captures as c
from muxlake.sources import frames as fr
from muxlake.streaming import feeds

N = c.FRAME_BYTES


def frame(i):
    return bytes.fromhex("FFF8C549") + i.to_bytes(4, "big") + bytes(N - 8)


def capture(n, tail=b""):
    return b"".join(map(frame, range(n))) + tail


def numbers(df):
    """(file, number, bytes, number in the frame) of each row."""
    at = F.conv(F.hex(F.substring("raw", 5, 4)), 16, 10).cast("long").alias("i")
    return sorted((os.path.basename(r.stream_id), r.frame_no, r.n, r.i) for r in df.select("stream_id", "frame_no", F.octet_length("raw").alias("n"), at).collect())


def test_ranges_cover_whole_records():
    for size in (0, 1, N - 1, N, N + 1, 10 * N, 10 * N + 7):
        for split in (1, N, 3 * N, 3 * N + 5, 99 * N):
            for tail in (False, True):
                got = list(c.ranges("f", 0, size, 0.0, split, tail))
                assert [r.start for r in got] == [0, *(r.end for r in got)][: len(got)] and all(r.start % N == 0 and r.start < r.end for r in got)
                assert (got[-1].end if got else 0) == (size if tail else size - size % N)


def test_batches_are_cut_without_their_neighbours():
    data = capture(3, b"xyz")
    b = c.batch("f", 7, data, 1.5)
    assert b["raw"].to_pylist() == [frame(0), frame(1), frame(2), b"xyz"] and b["frame_no"].to_pylist() == [7, 8, 9, 10]
    assert b["ts"][0].as_py().timestamp() == 1.5 and set(b["stream_id"].to_pylist()) == {"f"}
    b.validate(full=True)


@pytest.mark.parametrize("split", [N, 5 * N + 1, 1 << 24])
def test_read_in_splits(spark, tmp_path, split):
    (tmp_path / "sub dir").mkdir()
    (tmp_path / "sub dir/a,b [1].eti").write_bytes(capture(1100, b"cut off"))
    (tmp_path / "b.eti").write_bytes(capture(1))
    (tmp_path / "short.eti").write_bytes(b"cut")
    (tmp_path / "empty.eti").write_bytes(b"")
    (tmp_path / "_hidden.eti").write_bytes(capture(1))
    want = [("a,b [1].eti", i, N, i) for i in range(1100)] + [("b.eti", 0, N, 0)]
    if split == N:
        want = want[:0] + [("b.eti", 0, N, 0)]
        assert numbers(fr.read_frames(spark, str(tmp_path / "b.eti"), split)) == want
        return
    f = fr.read_frames(spark, str(tmp_path), split)
    assert numbers(f) == want
    assert f.rdd.getNumPartitions() == len([r for p, n, w in c.listed(str(tmp_path)) for r in c.ranges(p, 0, n, w, split)])
    with_tail = numbers(fr.read_frames(spark, str(tmp_path), split, tail=True))
    assert [x[:3] for x in with_tail] == sorted([x[:3] for x in want] + [("a,b [1].eti", 1100, 7), ("short.eti", 0, 3)])
    assert numbers(fr.read_frames(spark, str(tmp_path), split, pattern="b*")) == [("b.eti", 0, N, 0)]
    assert sorted(r.tail_bytes for r in fr.partial_frames(spark, str(tmp_path)).where("stream_id NOT LIKE '%hidden%'").collect()) == [3, 7]


def test_no_files(spark, tmp_path):
    assert fr.read_frames(spark, str(tmp_path)).isEmpty() and fr.capture_profile(spark, str(tmp_path)).isEmpty()
    with pytest.raises(Exception, match="nowhere"):
        fr.read_frames(spark, str(tmp_path / "nowhere")).collect()


def test_profile(spark, tmp_path):
    for name, data in (("a b.eti", capture(900, b"x")), ("c.eti", b"\0" * N)):
        (tmp_path / name).write_bytes(data)
    got = {os.path.basename(r.stream_id): (r.n_bytes, r.frames, r.duration_ms, r.format, r.sha256) for r in fr.capture_profile(spark, str(tmp_path)).collect()}
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert got == {"a b.eti": (900 * N + 1, 900, 21_600, "NI", sha(capture(900, b"x"))), "c.eti": (N, 1, 24, "unknown", sha(b"\0" * N))}


def test_beyond_2_gb_with_a_cut_off_record(spark, tmp_path):
    n = 349_526
    with open(tmp_path / "long.eti", "wb") as f:
        f.write(frame(0))
        f.truncate(n * N + 100)  # sparse
    assert n * N >= 1 << 31
    df = fr.read_frames(spark, str(tmp_path), split_bytes=256 << 20)
    assert df.rdd.getNumPartitions() == 9
    assert [tuple(r) for r in df.select("frame_no", F.length("raw").alias("n")).take(1)] == [(0, N)]
    last = list(c.ranges("f", 0, n * N + 100, 0.0, 256 << 20))[-1]
    end = list(c.read_range(c.Range(str(tmp_path / "long.eti"), last.end - 2 * N, last.end, 0.0)))
    assert [b["frame_no"].to_pylist() for b in end] == [[n - 2, n - 1]]


def test_stream_follows_growing_files(spark, tmp_path):
    folder, out, mark = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "mark")
    folder.mkdir()

    def go():
        q = feeds.stream_frames(spark, str(folder), split_bytes=2 * N).writeStream.format("parquet").option("path", out).option("checkpointLocation", mark).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None
        return numbers(spark.read.parquet(out))

    (folder / "a.eti").write_bytes(capture(3) + frame(3)[:100])  # the recorder is within record 3
    assert go() == [("a.eti", i, N, i) for i in range(3)]
    (folder / "a.eti").write_bytes(capture(8))
    (folder / "b.eti").write_bytes(capture(1))
    want = [("a.eti", i, N, i) for i in range(8)] + [("b.eti", 0, N, 0)]
    assert go() == want  # from the checkpoint: nothing twice, record 3 whole
    assert go() == want
    s = c.CaptureStream({"path": str(folder)})
    assert sorted(s.latestOffset().values()) == [N, 8 * N] and json.loads(json.dumps(s.latestOffset())) == s.latestOffset()
    shrunk = {k: 9 * N for k in s.latestOffset()}
    assert sum(r.end - r.start for r in s.partitions(shrunk, s.latestOffset())) == 9 * N  # files that shrank are new ones


def test_other_schemes_are_left_to_hadoop():
    assert c.readable("/a") and c.readable("file:/a b") and c.readable("s3://b/x") and not c.readable("viewfs://store/in")
    assert c.opened("file:///a b/c")[1:] == ("/a b/c", "file:") and c.opened("/a b")[1] == "/a b"
