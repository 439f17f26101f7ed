"""Frames: files and directories of captures, and frames built from an event table (S- and P-families)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muxlake.functions.bits import CRC16_RESIDUE, bits, crc16, crc16_stored, u
from muxlake.functions.times import micros
from muxlake.sources import captures

FRAME_BYTES, FRAME_MS = 6144, 24
FRAMES_A_TASK = 25_000
# Sync words that a capture's frames may begin with, and the one that tells LI.
SYNC_WORDS = ["FF1F491F", "491F1FFF", "FF1FC4FF", "C4FF1FFF", "491FC4FF", "C4FF491F", "49931E03", "FFF8C549", "49C5F8FF", "FF073AB6", "B63A07FF"]
SYNC_LI = "49931E03"


def capture_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Files below path, by Spark's binaryFile source: only where `content` is selected are they read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)


def read_frames(spark: SparkSession, path: str, split_bytes: int = captures.SPLIT_BYTES, tail: bool = False, pattern: str = "*") -> DataFrame:
    """(stream_id, frame_no, raw): whole records of every capture below path; the file is the stream, record order the number. With tail, a cut-off last record is a row too.

    Captures are read in ranges of split_bytes, whatever their size (sources/captures.py).
    A path of a scheme that pyarrow doesn't have is read by Hadoop, each file as one row,
    so files must be under 2 GB there, Spark's limit.
    """
    if captures.readable(path):
        read = spark.read.format(captures.captures(spark)).option("splitBytes", str(split_bytes)).option("tail", str(tail)).option("pattern", pattern)
        return read.load(path).select("stream_id", "frame_no", "raw")
    size = F.octet_length("content") / FRAME_BYTES
    n = (F.ceil(size) if tail else F.floor(size)).cast("int")
    at = capture_files(spark, path, pattern).where(F.col("length") >= (1 if tail else FRAME_BYTES)).select(F.col("path").alias("stream_id"), F.explode(F.sequence(F.lit(0), n - 1)).alias("frame_no"), "content")
    return at.select("stream_id", F.col("frame_no").cast("long").alias("frame_no"), F.substring("content", F.col("frame_no") * FRAME_BYTES + 1, FRAME_BYTES).alias("raw"))


def partial_frames(spark: SparkSession, path: str) -> DataFrame:
    """Captures that end in a short record, and its length; contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("stream_id"), (F.col("length") % FRAME_BYTES).alias("tail_bytes")).where("tail_bytes > 0")


def capture_profile(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Per capture: size, frames, duration, format, hash. A hash goes through a file in order, so each file is a task's, in pieces of a few MB."""
    frames = F.floor(F.col("n_bytes") / FRAME_BYTES)
    read = spark.read.format(captures.captures(spark)).option("mode", "profile").option("pattern", pattern).load(path)
    return read.select("stream_id", "n_bytes", frames.alias("frames"), (frames * FRAME_MS).alias("duration_ms"), detect_format(F.col("head")).alias("format"), "sha256")


def detect_format(raw: Column) -> Column:
    """LI or NI by the sync, else unknown."""
    head = F.hex(F.substring(raw, 1, 4))
    return F.when((head == SYNC_LI), "LI").when(head.startswith("FFF8") | head.startswith("FF07"), "NI").otherwise("unknown")


def valid_sync(raw: Column) -> Column:
    return F.hex(F.substring(raw, 1, 4)).isin(SYNC_WORDS)


def corrupt_frame(raw: Column) -> Column:
    """Of another size, or all 00 or all FF."""
    return (F.octet_length(raw) != FRAME_BYTES) | (raw == F.lit(bytes(FRAME_BYTES))) | (raw == F.lit(b"\xff" * FRAME_BYTES))


def validate_capture(frames: DataFrame, least: int = 1) -> DataFrame:
    """Per stream: frames, bad sync, corrupt, and whether it can be used."""
    n, bad = F.count("*"), F.count_if(~valid_sync(F.col("raw")))
    return frames.groupBy("stream_id").agg(n.alias("n_frames"), bad.alias("bad_sync"), F.count_if(corrupt_frame(F.col("raw"))).alias("corrupt"), ((n >= least) & (bad < n)).alias("usable"))


def frame_header(frames: DataFrame, nst_offset: int = 0) -> DataFrame:
    """fc, ficf, nst, fp, mid, fl of each frame; nst_offset 1 for legacy multiplexers."""
    b5, b6 = u(F.col("raw"), 5), u(F.col("raw"), 6)
    return frames.select(
        "*", u(F.col("raw"), 4).cast("int").alias("fc"), (bits(b5, 7, 1) == 1).alias("ficf"), (bits(b5, 0, 7) + nst_offset).cast("int").alias("nst"),
        bits(b6, 5, 3).cast("int").alias("fp"), bits(b6, 3, 2).cast("int").alias("mid"), (bits(b6, 0, 3) * 256 + u(F.col("raw"), 7)).cast("int").alias("fl"),
    )


def explode_stc(headers: DataFrame, keep_raw: bool = False) -> DataFrame:
    """A row a sub-channel of each frame header, with its protection decoded; with the frame where a slice of it is wanted."""
    h = headers.where("nst > 0").select("stream_id", "frame_no", "raw", F.explode(F.sequence(F.lit(0), F.col("nst") - 1)).alias("pos"))
    w = u(F.col("raw"), 8 + 4 * F.col("pos"), 4)
    tpl = bits(F.col("w"), 10, 6)
    h = h.withColumn("w", w).where("w IS NOT NULL")
    uep = bits(tpl, 5, 1) == 0
    return h.select(
        "stream_id", "frame_no", "pos", bits(F.col("w"), 26, 6).cast("int").alias("sub_channel_id"), bits(F.col("w"), 16, 10).cast("int").alias("start_address"), bits(F.col("w"), 0, 10).cast("int").alias("size"), uep.alias("uep"),
        F.when(~uep, bits(tpl, 2, 3)).cast("int").alias("protection_option"), F.when(~uep, bits(tpl, 0, 2) + 1).otherwise(bits(tpl, 0, 3) + 1).cast("int").alias("protection_level"),
        F.when(uep, bits(tpl, 3, 1)).cast("int").alias("table_switch"), F.when(uep, bits(tpl, 0, 3)).cast("int").alias("table_index"), (bits(F.col("w"), 0, 10) * 8).cast("int").alias("bitrate"),
        *(["raw"] if keep_raw else []),
    )


def slice_fic(headers: DataFrame) -> DataFrame:
    """The FIC of frames that have one: 96 bytes, 128 in mode 3; null where the frame is too short."""
    size = F.when(F.col("mid") == 3, 128).otherwise(96)
    part = F.substring("raw", 13 + 4 * F.col("nst"), size)
    return headers.where("ficf").select("stream_id", "frame_no", F.when(F.octet_length(part) == size, part).alias("fic"))


def explode_fibs(fic: DataFrame) -> DataFrame:
    """A row a block: 30 bytes of area, the stored CRC, whether it agrees."""
    f = fic.where("fic IS NOT NULL").select("stream_id", "frame_no", F.posexplode(F.sequence(F.lit(1), F.octet_length("fic") - 31, F.lit(32))).alias("fib_no", "at"), "fic")
    f = f.select("stream_id", "frame_no", "fib_no", F.substring("fic", F.col("at"), 30).alias("area"), u(F.col("fic"), F.col("at") + 29, 2).cast("int").alias("crc_stored"))
    return f.withColumn("crc_ok", crc16_stored(F.col("area")) == F.col("crc_stored"))


def eoh_crc_ok(headers: DataFrame) -> DataFrame:
    """Whether the CRC over frame header and sub-channel list agrees with the one at the end of the header; null where that is beyond the frame."""
    size = 4 + 4 * F.col("nst") + 4
    # Over the stored one too, and from a column that is used twice, which Spark keeps as one: so no whole frames wait beside the Arrow batch.
    h = headers.withColumn("_head", F.substring("raw", 5, size))
    return h.withColumn("eoh_ok", crc16(F.when(F.octet_length("_head") == size, F.col("_head"))) == CRC16_RESIDUE).drop("_head")


def slice_msc(headers: DataFrame) -> DataFrame:
    """Payload of each sub-channel: 8 bytes a capacity unit, one after the other; those beyond the frame are dropped. All of a frame's list is in its own row, so nothing is shuffled."""
    fic = F.when(F.col("ficf"), F.when(F.col("mid") == 3, 128).otherwise(96)).otherwise(0)
    listed = F.filter(F.transform(F.sequence(F.lit(0), F.col("nst") - 1), lambda i: u(F.col("raw"), 8 + 4 * i, 4)), lambda w: w.isNotNull())
    begin = F.struct((12 + 4 * F.col("nst") + fic).cast("long").alias("at"), F.array().cast("array<struct<sub_channel_id:int,at:bigint,n:bigint>>").alias("subs"))

    def step(s: Column, w: Column) -> Column:
        n = bits(w, 0, 10) * 8
        return F.struct((s["at"] + n).alias("at"), F.array_append(s["subs"], F.struct(bits(w, 26, 6).cast("int").alias("sub_channel_id"), s["at"].alias("at"), n.alias("n"))).alias("subs"))

    m = headers.where("nst > 0").select("stream_id", "frame_no", "raw", F.explode_outer(F.aggregate(listed, begin, step, lambda s: s["subs"])).alias("x"))
    m = m.where(F.col("x.at") + F.col("x.n") <= F.octet_length("raw"))
    return m.select("stream_id", "frame_no", "x.sub_channel_id", F.substring("raw", (F.col("x.at") + 1).cast("int"), F.col("x.n").cast("int")).alias("payload"))


def slice_msc_by_address(stc: DataFrame) -> DataFrame:
    """Payload at 8 bytes a unit of the start address, clipped to the frame. stc has raw."""
    return stc.select("stream_id", "frame_no", "sub_channel_id", F.substring("raw", F.col("start_address") * 8 + 1, F.col("size") * 8).alias("payload"))


def frame_time(start: Column, frame_no: Column) -> Column:
    """Microseconds of a frame: the capture's time and 24 ms a frame."""
    return micros(start) + frame_no * FRAME_MS * 1000


def tist_ms(raw: Column) -> Column:
    return bits(u(raw, FRAME_BYTES - 4, 4), 0, 24) / 16384.0


def tist_kind(tist: Column) -> Column:
    """invalid, seconds, milliseconds, units of 24 ms, or samples, by size."""
    return F.when(tist == 0, "invalid").when(tist > 1_000_000_000, "seconds").when(tist > 1_000_000, "milliseconds").when(tist < 100_000, "frames").otherwise("samples")


def frames_from_events(events: DataFrame, odd: bool = False) -> DataFrame:
    """A frame an event: header, up to three sub-channels, three blocks (FIG 0/0 and 0/1; 0/2 and 1/1; padding), a time stamp.

    Every 50th frame has no sync, every 20th a broken CRC in its first block. odd: what a
    real capture may hold besides: all sync words, every protection, mode 3 with a fourth
    block (every 23rd), no blocks (every 43rd), a wrong header CRC (every 31st), frames of
    zeros (97th), of FF (101st) and short ones (103rd).

    A service's number may be longer than the ids of the blocks, 16 bits in FIG 0/2 and 15 in
    1/1. FIG 0/2 has its first four hex digits, FIG 1/1 its low 15 bits; what is beyond stands
    beside the frame: sid_digits, hex digits, and label_group.
    """
    # A split of the table holds some millions of events, but their frames are large: tasks of a bounded number of frames.
    tasks = max(events.sparkSession.sparkContext.defaultParallelism, -(-events.count() // FRAMES_A_TASK))
    events = events.repartition(tasks)
    e, user, eid = F.col("event_id"), F.col("user_id"), 4096 + F.col("user_id") % 8
    nst = (user % 4).cast("int")
    hex_ = lambda x, n: F.lpad(F.hex(x.cast("long")), 2 * n, "0")
    subs = F.sequence(F.lit(0), nst - 1)
    each = lambda f: F.when(nst > 0, F.array_join(F.transform(subs, f), "")).otherwise("")
    every = lambda n: (e % n == 0) if odd else F.lit(False)
    equal = 0x20 + e % 2 * 4 + F.floor(e / 2) % 4 if odd else F.lit(0x20 | 2)
    protection = lambda i: F.when((e + i) % 5 == 0, e % 16).otherwise(equal) if odd else equal
    stc = each(lambda i: hex_(i * (1 << 26) + i * 24 * (1 << 16) + protection(i) * 1024 + 24, 4))
    org = each(lambda i: hex_(i * (1 << 26) + i * 24 * (1 << 16) + F.lit(0x88 << 8) + 24, 4))
    cif = e % 8192
    fig00 = F.concat(F.lit("0600"), hex_(eid, 2), hex_(cif, 2), F.lit("00"))
    fig01 = F.concat(hex_(1 + 4 * nst, 1), F.lit("01"), org)
    sid = 4096 + user
    fig02 = F.concat(F.lit("0602"), hex_(sid, 2), F.lit("013F"), hex_((user % 64) * 4 + 2, 1))
    label = F.hex(F.rpad(F.upper("event_type"), 16, " "))
    fig11 = F.concat(F.lit("3501"), hex_(sid % 32768, 2), label, F.lit("FF00"))
    phase = (e % 8) * 8192 + F.when(every(23), 3).otherwise(1) * 2048 + e % 2000 if odd else F.lit(0x0800)
    head = F.concat(hex_(e % 250, 1), hex_(F.when(every(43), 0).otherwise(128) + nst, 1), hex_(phase, 2), stc)
    area = lambda x: F.unhex(F.rpad(x, 60, "FF"))
    # Columns of their own first: bytes are put together once, for their checksum and for the frame.
    parts = events.select(F.concat(F.lit("S"), user % 16).alias("stream_id"), e.alias("frame_no"), "ts", F.substring(F.hex(sid), 5, 16).alias("sid_digits"), F.shiftright(sid, 15).alias("label_group"), area(F.concat(fig00, fig01)).alias("a"), area(F.concat(fig02, fig11)).alias("b"), F.unhex(F.concat(head, F.lit("0000"))).alias("head"))
    # Over Arrow batches: as expressions, the checksums of a frame are too much code for the JVM to compile.
    parts = parts.select("*", crc16_stored(F.col("a")).alias("crc_a"), crc16_stored(F.col("b")).alias("crc_b"), crc16_stored(F.col("head")).alias("crc_head"))
    n, two = F.col("frame_no"), lambda x: F.unhex(hex_(x, 2))
    every = lambda k: (n % k == 0) if odd else F.lit(False)
    fib = lambda c, flip: F.concat(F.col(c), two(F.col(f"crc_{c}").bitwiseXOR(flip)))
    padding = b"\xff" * 30
    last = F.lit(padding + (_crc_of(padding) ^ 0xFFFF).to_bytes(2, "big"))
    # Not deterministic to the optimizer, so filters of decoded fields aren't moved below, where each would build the frame once more.
    once = F.monotonically_increasing_id() >= 0
    words = F.get(F.array(*[F.lit(bytes.fromhex(w)) for w in SYNC_WORDS]), (n % len(SYNC_WORDS)).cast("int")) if odd else F.lit(bytes.fromhex("FFF8C549"))
    sync = F.when((n % 50 == 0) & once, F.lit(bytes(4))).otherwise(words)
    blocks = F.concat(fib("a", F.when(n % 20 == 0, 1).otherwise(0).cast("long")), fib("b", F.lit(0).cast("long")), last)
    if odd:
        blocks = F.when(every(43), F.lit(b"")).when(every(23), F.concat(blocks, last)).otherwise(blocks)
    body = F.concat(sync, F.col("head"), two(F.col("crc_head").bitwiseXOR(F.when(every(31), 1).otherwise(0).cast("long"))), blocks)
    filled = FRAME_BYTES - 4 - F.octet_length(body)  # a slice of filling: rpad would copy it byte by byte
    raw = F.concat(body, F.substring(F.lit(b"\x55" * FRAME_BYTES), F.lit(1), filled), F.unhex(hex_((n * 393216) % (1 << 24), 4)))
    if odd:
        raw = F.when(every(97), F.lit(bytes(FRAME_BYTES))).when(every(101), F.lit(b"\xff" * FRAME_BYTES)).when(every(103), F.substring(raw, 1, 6000)).otherwise(raw)
    return parts.select("stream_id", "frame_no", "ts", "sid_digits", "label_group", raw.alias("raw"))


def _crc_of(data: bytes) -> int:
    from muxlake.functions.bits import crc_table

    table, c = crc_table(0x1021, 16), 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ table[c >> 8 ^ b]
    return c


