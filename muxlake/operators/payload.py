"""Payload jobs (K-family) and packets (S06-S11, T03 in batch): segments, objects, text, audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions.bits import bits, crc16_stored, fire_code, u, walk
from muxlake.functions.text import bcd, mjd_timestamp
from muxlake.operators.scan import looking_back, running

def D() -> Column:
    return F.col("payload")


def parse_data_groups(msc: DataFrame) -> DataFrame:
    """Header, session header and segment of each group, and why it is rejected (null: accepted)."""
    b0, n = u(D(), 0), F.octet_length("payload")
    ext = F.when(bits(b0, 7, 1) == 1, 2).otherwise(0)
    s = F.lit(2) + ext
    tid = u(D(), s + 2)
    seg = s + 3 + bits(tid, 0, 4)
    size = bits(u(D(), seg, 2), 0, 13)
    crc_ok = crc16_stored(F.substring(D(), F.lit(1), n - 2)) == u(D(), n - 2, 2)
    out = msc.select(
        "*", bits(b0, 0, 4).alias("group_type"), bits(u(D(), 1), 4, 4).alias("continuity"), bits(u(D(), s, 2), 0, 15).alias("seg_no"), (bits(u(D(), s), 7, 1) == 1).alias("last"),
        F.when(bits(tid, 4, 1) == 1, u(D(), s + 3, 2)).alias("transport_id"), size.alias("seg_size"),
        F.when(n < 9, "short").when((bits(b0, 6, 1) == 0) | (bits(b0, 5, 1) == 0) | (bits(b0, 4, 1) == 0), "flags").when(~bits(b0, 0, 4).isin(3, 4), "type").when(~bits(tid, 0, 4).isin(2, 4), "session")
        .when(~crc_ok, "crc").when(size != n - 2 - seg - 2, "size").alias("reject"),
    )
    return out.withColumn("segment", F.when(F.col("reject").isNull(), F.substring(D(), seg + 3, F.col("seg_size").cast("int"))))


def assemble_mot(segments: DataFrame) -> DataFrame:
    """Objects whose body segments 0 to last are all there; the first copy of a segment wins, a new header starts anew.

    segments: stream_id, transport_id, kind (header or body), seg_no, last, payload, tick.
    """
    w = Window.partitionBy("stream_id", "transport_id").orderBy("tick", F.col("kind").desc(), "seg_no")
    before = F.last(F.when(F.col("kind") == "header", F.col("payload")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = ((F.col("kind") == "header") & (F.col("seg_no") == 0) & before.isNotNull() & (F.col("payload") != before)).cast("int")
    s = segments.withColumn("starts", starts).withColumn("epoch", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    first = s.where("kind = 'body'").groupBy("stream_id", "transport_id", "epoch", "seg_no").agg(F.min_by("payload", "tick").alias("payload"), F.bool_or("last").alias("last"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_no", F.hex("payload").alias("h")))), lambda x: x["h"])
    o = first.groupBy("stream_id", "transport_id", "epoch").agg(F.count("*").alias("segments"), F.max(F.when(F.col("last"), F.col("seg_no"))).alias("last_no"), F.max("seg_no").alias("top_no"), F.unhex(F.array_join(parts, "")).alias("body"))
    return o.where((F.col("segments") == F.col("last_no") + 1) & (F.col("top_no") == F.col("last_no"))).drop("last_no", "top_no")


def mot_progress(segments: DataFrame, sizes: DataFrame) -> DataFrame:
    """Share of each object's body that has come; sizes: stream_id, transport_id, body_size."""
    got = segments.where("kind = 'body'").groupBy("stream_id", "transport_id", "seg_no").agg(F.max(F.octet_length("payload")).alias("n")).groupBy("stream_id", "transport_id").agg(F.sum("n").alias("received"))
    return sizes.join(got, ["stream_id", "transport_id"], "left").select("stream_id", "transport_id", F.coalesce("received", F.lit(0)).alias("received"), "body_size", F.round(F.least(F.coalesce("received", F.lit(0)) / F.col("body_size"), F.lit(1.0)), 6).alias("progress"))


def parse_mot_header(objects: DataFrame) -> DataFrame:
    """body_size, header_size, type, subtype and a map of parameters (hex) from the header bytes in payload."""
    pli = lambda p: bits(u(D(), p), 6, 2)
    short = lambda p: bits(u(D(), p + 1), 7, 1) == 0
    head = lambda p: F.when(pli(p) == 3, F.when(short(p), 2).otherwise(3)).otherwise(1)
    n = lambda p: F.when(pli(p) == 0, 0).when(pli(p) == 1, 1).when(pli(p) == 2, 4).when(short(p), bits(u(D(), p + 1), 0, 7)).otherwise(bits(u(D(), p + 1, 2), 0, 15))
    params = F.transform(walk(D(), 7, 1, lambda p: head(p) + n(p)), lambda p: F.struct(bits(u(D(), p), 0, 6).cast("int").alias("k"), F.hex(F.substring(D(), p + head(p) + 1, n(p).cast("int"))).alias("v")))
    first = u(D(), 0, 4)
    return objects.where(F.octet_length("payload") >= 7).select(
        *[c for c in objects.columns if c != "payload"], bits(first, 4, 28).alias("body_size"), (bits(first, 0, 4) * 512 + bits(u(D(), 4, 2), 7, 9)).alias("header_size"), bits(u(D(), 5), 1, 6).alias("content_type"), (bits(u(D(), 5), 0, 1) * 256 + u(D(), 6)).alias("content_subtype"),
        F.map_from_entries(F.array_distinct(F.aggregate(params, F.array().cast("array<struct<k:int,v:string>>"), lambda s, x: F.when(F.exists(s, lambda y: y["k"] == x["k"]), s).otherwise(F.array_append(s, x))))).alias("params"),
    )


def parse_mot_directory(objects: DataFrame) -> DataFrame:
    """A row an entry of a carousel directory: size 13 bits, objects 16, period 24, segment size 13; each entry id 16, header size 13, body size 28, repetitions 8; then a CRC (crc_ok is null without one). Entries that the bytes don't hold are left out."""
    n = F.octet_length("payload")
    held = F.least(u(D(), 2, 2), F.greatest(F.floor((n - 9) / 9), F.lit(0)))
    end = 9 + 9 * held
    keep = [c for c in objects.columns if c != "payload"]
    d = objects.where(n >= 9).select(
        *keep, "payload", bits(u(D(), 0, 2), 0, 13).alias("directory_size"), u(D(), 2, 2).cast("int").alias("n_objects"), u(D(), 4, 3).alias("carousel_period_ms"), bits(u(D(), 7, 2), 0, 13).alias("segment_size"),
        (crc16_stored(F.substring(D(), F.lit(1), end.cast("int"))) == u(D(), end, 2)).alias("crc_ok"), F.posexplode(F.when(held > 0, F.sequence(F.lit(9).cast("long"), end - 9, F.lit(9).cast("long")))).alias("entry", "p"),
    )
    p = F.col("p")
    return d.select(*keep, "directory_size", "n_objects", "carousel_period_ms", "segment_size", "crc_ok", "entry", u(D(), p, 2).alias("transport_id"), bits(u(D(), p + 2, 2), 0, 13).alias("header_size"), bits(u(D(), p + 4, 4), 4, 28).alias("body_size"), u(D(), p + 8).alias("repetitions"))


def dls_tags(commands: DataFrame) -> DataFrame:
    """Tags of a DLS+ command: 4 bytes each, at most 8: code 6, id 7, start 6, length 5 bits; text is cut by bytes, empty slices are dropped.

    commands: stream_id, frame_no, payload, text.
    """
    n = F.least(F.floor(F.octet_length("payload") / 4), F.lit(8)).cast("int")
    c = commands.where(n > 0).withColumn("p", F.explode(F.sequence(F.lit(0), (n - 1) * 4, F.lit(4))))
    x = u(D(), F.col("p"), 4)
    code = bits(F.col("x"), 26, 6)
    kind = F.when(code.between(1, 31), "item").when(code.between(32, 47), "info").when(code.between(48, 55), "programme").when(code.between(56, 59), "interactivity").when(code.between(60, 61), "station").when(code == 62, "programme_type").otherwise("reserved")
    start, length = bits(F.col("x"), 13, 6), bits(F.col("x"), 8, 5)
    c = c.withColumn("x", x)
    data = F.encode("text", "UTF-8")
    out = c.select("stream_id", "frame_no", code.alias("code"), kind.alias("kind"), F.when(start + length <= F.octet_length(data), F.decode(F.substring(data, (start + 1).cast("int"), length.cast("int")), "UTF-8")).alias("value"))
    return out.where("value <> ''")


def epg_events(objects: DataFrame) -> DataFrame:
    """Events of a schedule: sid 32, mjd 16, n 16 bits; each id 16, mjd 16, bcd time 24, minutes 16, content 8, name and description by length. A truncated one ends the list."""
    name = lambda p: u(D(), p + 10)
    more = lambda p: u(D(), p + 11 + name(p), 2)
    size = lambda p: 13 + name(p) + more(p)
    o = objects.where(F.octet_length("payload") >= 8)
    at = walk(D(), 8, 13, size, lambda p: p + size(p) <= F.octet_length("payload"))
    o = o.withColumn("p", F.explode(F.slice(at, F.lit(1), F.greatest(u(D(), 6, 2), F.lit(1)).cast("int"))))
    p = F.col("p")
    start = mjd_timestamp(u(D(), p + 2, 2), bcd(u(D(), p + 4), 23), bcd(u(D(), p + 5), 59), bcd(u(D(), p + 6), 59))
    minutes = F.least(u(D(), p + 7, 2), F.lit(1440))
    keep = [c for c in objects.columns if c != "payload"]
    return o.select(*keep, u(D(), 0, 4).alias("service_id"), u(D(), p, 2).alias("event_id"), start.alias("start_time"), minutes.alias("minutes"), u(D(), p + 9).alias("content"), F.decode(F.substring(D(), p + 12, name(p).cast("int")), "UTF-8").alias("name"))


def journaline_objects(objects: DataFrame) -> DataFrame:
    """id 16, category 8, mjd 16, bcd time 24, title and text by length, optional link."""
    n, title = F.octet_length("payload"), u(D(), 8)
    body = u(D(), 9 + title, 2)
    end = 11 + title + body
    keep = [c for c in objects.columns if c != "payload"]
    return objects.where((n >= 11) & (end <= n)).select(
        *keep, u(D(), 0, 2).alias("object_id"), u(D(), 2).alias("category"), mjd_timestamp(u(D(), 3, 2), bcd(u(D(), 5), 23), bcd(u(D(), 6), 59), bcd(u(D(), 7), 59)).alias("ts"),
        F.decode(F.substring(D(), F.lit(10), title.cast("int")), "UTF-8").alias("title"), F.decode(F.substring(D(), (12 + title).cast("int"), body.cast("int")), "UTF-8").alias("text"), F.when((n >= end + 3) & (u(D(), end) != 0), u(D(), end + 1, 2)).alias("link_target"),
    )


def text_runs(texts: DataFrame, column: str, least: int = 6) -> DataFrame:
    """A row for each run of printable ASCII of at least `least` characters."""
    keep = [c for c in texts.columns if c != column]
    return texts.select(*keep, F.posexplode(F.regexp_extract_all(column, F.lit(f"[\\x20-\\x7E]{{{least},}}"), F.lit(0))).alias("pos", "run"))


def superframes(msc: DataFrame, index: int, span: float | None = None) -> DataFrame:
    """Superframes of 5 frames of 24 ms: the candidates whose header check holds, one phase per run (the first), with their parameters.

    msc: stream_id, sub_channel_id, frame_no, payload of one sub-channel frame. A header of
    zeros isn't one, though its check holds. starts are the offsets of the access units and
    the end of the last; offsets_ok if they rise.
    """
    keys = ["stream_id", "sub_channel_id"]

    def five(w):
        whole = F.lag("frame_no", 4).over(w) == F.col("frame_no") - 4
        return {"_whole": whole, "_five": F.when(whole, F.concat(*[F.lag("payload", i).over(w) if i else D() for i in range(4, -1, -1)]))}

    c = looking_back(msc.select(*keys, "frame_no", "payload"), keys, "frame_no", 4, five, span).where("_whole")
    # Exploded, so that the bytes are put together once and not in each expression over them.
    c = c.select(*keys, (F.col("frame_no") - 4).alias("frame_no"), F.explode(F.array("_five")).alias("payload"))
    c = c.where(u(D(), 3, 2) >= 16).where(fire_code(F.substring(D(), 3, 9)) == u(D(), 0, 2))
    c = looking_back(c, keys, "frame_no", 1, lambda w: {"_near": F.coalesce(F.col("frame_no") - F.lag("frame_no").over(w) < 5, F.lit(False))}, span).where("NOT _near")
    b2 = u(D(), 2)
    rate, sbr = bits(b2, 6, 1), bits(b2, 5, 1)
    of = lambda low, low_sbr, high, high_sbr: F.when(rate == 0, F.when(sbr == 1, low_sbr).otherwise(low)).otherwise(F.when(sbr == 1, high_sbr).otherwise(high))
    c = c.select(*keys, "frame_no", F.when(rate == 1, 48).otherwise(32).alias("rate_khz"), (sbr == 1).alias("sbr"), (bits(b2, 4, 1) == 1).alias("stereo"), (bits(b2, 3, 1) == 1).alias("ps"), of(4, 2, 6, 3).alias("aus"), F.lit(index * 8).alias("kbps"), of(8, 5, 11, 6).alias("_first"), "payload")
    # Offsets of 12 bits follow each other from byte 3; an odd one ends on a byte.
    inner = F.transform(F.sequence(F.lit(0), F.col("aus") - 2), lambda i: (F.when(i % 2 == 0, F.shiftright(u(D(), 3 + i + F.shiftright(i, 1), 2), 4)).otherwise(u(D(), 3 + i + F.shiftright(i, 1), 2).bitwiseAND(0xFFF))).cast("int"))
    c = c.withColumn("starts", F.concat(F.array("_first"), inner, F.array(F.lit(index * 110)))).drop("_first")
    return c.withColumn("offsets_ok", F.forall(F.sequence(F.lit(1), F.col("aus")), lambda i: F.get("starts", i - 1) < F.get("starts", i)))


def access_units(superframes_: DataFrame) -> DataFrame:
    """A row for each access unit of superframes whose offsets rise: place, size, whether its check holds, and where its PAD is (null without one). Units under two bytes are left out."""
    pairs = F.transform(F.sequence(F.lit(0), F.col("aus") - 1), lambda i: F.struct(i.alias("au"), F.get("starts", i).alias("offset"), (F.get("starts", i + 1) - F.get("starts", i)).alias("size")))
    a = superframes_.where("offsets_ok").select("stream_id", "sub_channel_id", "frame_no", "payload", F.inline(pairs)).where("size >= 2")
    n = F.col("size") - 2
    a = a.select("stream_id", "sub_channel_id", "frame_no", "au", "offset", "size", F.substring("payload", F.col("offset") + 1, n).alias("data"), u(D(), F.col("offset") + n, 2).alias("_stored"))
    a = a.withColumn("crc_ok", crc16_stored(F.col("data")) == F.col("_stored")).drop("_stored")
    d = F.col("data")
    long_ = u(d, 1) == 255
    start, length = F.when(long_, 3).otherwise(2), F.when(long_, 255 + u(d, 2)).otherwise(u(d, 1)).cast("int")
    has = (n >= 3) & (F.shiftright(u(d, 0), 5) == 4) & (length >= 2) & (n >= start + length)
    return a.withColumns({"pad_offset": F.when(has, start), "pad_size": F.when(has, length)})


def unit_counters(superframes_: DataFrame, units: DataFrame, *keys: str) -> DataFrame:
    """Per keys: superframes, those whose offsets don't rise, access units, those whose check fails, those with PAD; and whether all is well (aus_ok)."""
    s = superframes_.groupBy(*keys).agg(F.count("*").alias("superframes"), F.count_if(~F.col("offsets_ok")).alias("bad_offsets"))
    a = units.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.count("*").alias("units"), F.count_if(~F.col("crc_ok")).alias("unit_errors"), F.count("pad_offset").alias("pads"))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    out = s.join(a, same, "left").drop(*[f"_{k}" for k in keys]).na.fill(0, ["units", "unit_errors", "pads"])
    return out.withColumn("aus_ok", (F.col("bad_offsets") == 0) & (F.col("unit_errors") == 0))


def tpeg_framing(msc: DataFrame) -> DataFrame:
    """sync if 0A46 stands anywhere; phase if two markers x0 01 13 stand in the first 96 bytes; else unknown. Units of 24 bytes."""
    h = F.hex("payload")
    byte = "^(?:..)*?"  # from the start in whole bytes
    sync = h.rlike(byte + "0A46")
    marks = F.substring(h, 1, 192).rlike(byte + "(?=.00113)(?:..)+?(?=.00113)")
    keep = [c for c in msc.columns if c != "payload"]
    return msc.select(*keep, F.when(sync, "sync").when(marks, "phase").otherwise("unknown").alias("framing"), F.floor(F.octet_length("payload") / 24).alias("units"))


# Packets


def read_af_packets(datagrams: DataFrame) -> DataFrame:
    """AF packets: sync, length 32, sequence 16, flags 16, payload, CRC-32; why one is rejected, or null."""
    n, size = F.octet_length("payload"), u(D(), 2, 4)
    body = F.substring(D(), F.lit(1), F.least(10 + size, n).cast("int"))
    stored = u(D(), 10 + size, 4)
    out = datagrams.withColumn("reject", F.when(n < 14, "short").when(F.substring(D(), 1, 2) != F.lit(bytearray(b"AF")), "sync").when(size > 65_536, "too_long").when(n < size + 14, "truncated").when(F.crc32(body) != stored, "crc"))
    return out.withColumn("seq", F.when(F.col("reject").isNull(), u(D(), 6, 2))).withColumn("content", F.when(F.col("reject").isNull(), F.substring(D(), F.lit(11), size.cast("int"))))


def explode_tag_items(af: DataFrame, column: str = "content") -> DataFrame:
    """name(4), length in bits(32, rounded up to bytes), value: a row an item."""
    c = F.col(column)
    n = lambda p: F.ceil(u(c, p + 4, 4) / 8)
    at = walk(c, 0, 8, lambda p: 8 + n(p), lambda p: p + 8 + n(p) <= F.octet_length(c))
    keep = [x for x in af.columns if x not in (column, "payload")]
    t = af.select(*keep, c, F.posexplode(at).alias("pos", "p"))
    return t.select(*keep, "pos", F.decode(F.substring(c, F.col("p") + 1, 4), "ISO-8859-1").alias("name"), F.substring(c, F.col("p") + 9, n(F.col("p")).cast("int")).alias("value"))


def find_tag(items: DataFrame, name: str, keys: list[str]) -> DataFrame:
    return items.where(F.col("name") == name).groupBy(*keys).agg(F.min_by("value", "pos").alias("value"))


def reframe_stream(chunks: DataFrame, size: int, span: float | None = None) -> DataFrame:
    """Frames of `size` bytes re-cut from chunks (stream_id, chunk_no, payload) of any length: each chunk is cut at frame borders, the parts meet by frame."""
    c = running(chunks, ["stream_id"], "chunk_no", {"end": ("total", F.octet_length("payload"))}, span, peers=False)
    c = c.where(F.octet_length("payload") > 0).withColumn("begin", F.col("end") - F.octet_length("payload"))
    c = c.withColumn("frame_no", F.explode(F.sequence(F.floor(F.col("begin") / size), F.floor((F.col("end") - 1) / size))))
    first, last = F.greatest(F.col("begin"), F.col("frame_no") * size), F.least(F.col("end"), (F.col("frame_no") + 1) * size)
    part = F.hex(F.substring(D(), (first - F.col("begin") + 1).cast("int"), (last - first).cast("int")))
    parts = c.groupBy("stream_id", "frame_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", part.alias("h")))).alias("parts"))
    return parts.select("stream_id", "frame_no", F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), "")).alias("raw")).where(F.octet_length("raw") == size)


def parse_announcements(sdp: DataFrame) -> DataFrame:
    """SDP text to name, address, port and media; kept if it is of this kind and has an address and a port."""
    line = lambda key, pattern, group=1: F.regexp_extract("text", f"(?m)^{key}={pattern}", group)
    out = sdp.select(*[c for c in sdp.columns if c != "text"], line("s", "(.*)$").alias("name"), line("c", r"IN IP4 ([^/\s]+)").alias("address"), line("m", r"\w+ (\d+)").alias("port"), line("a", r"rtpmap:\d+ ([^/\s]+)").alias("encoding"))
    return out.where("upper(encoding) LIKE '%ETI%' AND address <> '' AND port <> ''")


def reassemble_pft(fragments: DataFrame) -> DataFrame:
    """Packets from fragments in batch (stream_id, pseq, epoch, findex, fcount, arrival, payload): complete, duplicates, out of order, invalid."""
    w = Window.partitionBy("stream_id", "epoch", "pseq").orderBy("arrival")
    f = fragments.withColumn("invalid", (F.col("findex") >= F.col("fcount")) | (F.col("fcount") <= 0)).withColumn("behind", F.coalesce(F.col("findex") < F.max("findex").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    ok = ~F.col("invalid")
    one = f.groupBy("stream_id", "epoch", "pseq", "findex").agg(F.count_if(ok).alias("copies"), F.min_by("payload", "arrival").alias("payload"), F.max("fcount").alias("fcount"), F.count_if(ok & F.col("behind")).alias("behind"), F.count_if("invalid").alias("invalid"))
    parts = F.array_sort(F.collect_list(F.when(F.col("copies") > 0, F.struct("findex", F.hex("payload").alias("h")))))
    p = one.groupBy("stream_id", "epoch", "pseq").agg(F.count_if(F.col("copies") > 0).alias("got"), F.max("fcount").alias("fcount"), F.sum(F.greatest(F.col("copies") - 1, F.lit(0))).alias("duplicates"), F.sum("behind").alias("out_of_order"), F.sum("invalid").alias("invalid"), parts.alias("parts"))
    complete = F.col("got") == F.col("fcount")
    return p.select("stream_id", "epoch", "pseq", complete.alias("complete"), "duplicates", "out_of_order", "invalid", F.when(complete, F.unhex(F.array_join(F.transform("parts", lambda x: x["h"]), ""))).alias("packet"))


# Audio


def audio_levels(samples: DataFrame, keys: list[str], value: str = "x", full_scale: float = 1.0) -> DataFrame:
    """Peak and RMS in dBFS and whether a block clips."""
    db = lambda x: F.round(F.when(x > 0, 20 * F.log10(x / full_scale)).otherwise(F.lit(-120.0)), 6)
    x = F.col(value)
    return samples.groupBy(*keys).agg(db(F.max(F.abs(x))).alias("peak_db"), db(F.sqrt(F.avg(x * x))).alias("rms_db"), F.bool_or(F.abs(x) >= full_scale).alias("clipped"))


def normalise(samples: DataFrame, keys: list[str], value: str = "x") -> DataFrame:
    """Without the mean, scaled to a peak of 1."""
    w = Window.partitionBy(*keys)
    centred = F.col(value) - F.avg(value).over(w)
    s = samples.withColumn("_c", centred)
    peak = F.max(F.abs("_c")).over(w)
    return s.withColumn("normalised", F.when(peak > 0, F.round(F.col("_c") / peak, 6)).otherwise(F.lit(0.0))).drop("_c")


def spectrum(blocks: DataFrame, key: str, samples: str, floor_db: float = -120.0) -> DataFrame:
    """(key, bin, db): Hann-windowed magnitudes of each block of samples; blocks are rows, a map over Arrow batches."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        for b in batches:
            keys, bins, db = [], [], []
            for k, x in zip(b[key].to_pylist(), b[samples].to_pylist(), strict=True):
                x = np.asarray(x or [], float)
                if not len(x):
                    continue
                m = np.abs(np.fft.rfft(x * np.hanning(len(x)))) / len(x) * 2
                keys += [k] * len(m)
                bins += range(len(m))
                db += np.round(np.maximum(20 * np.log10(np.maximum(m, 1e-12)), floor_db), 6).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(bins, pa.int32()), pa.array(db, pa.float64())], [key, "bin", "db"])

    return blocks.select(F.col(key).cast("long").alias(key), samples).mapInArrow(run, f"{key} long, bin int, db double")


def distortion(spectrum_: DataFrame, key: str, harmonics: int = 10, slack: float = 0.05) -> DataFrame:
    """Fundamental bin and total harmonic distortion in percent over its multiples, each the largest bin within 5 %."""
    power = F.pow(F.lit(10.0), F.col("db") / 10)
    f = spectrum_.where("bin > 0").groupBy(key).agg(F.max_by("bin", "db").alias("fundamental"), F.max("db").alias("top"))
    s = spectrum_.join(f, key).withColumn("k", F.round(F.col("bin") / F.col("fundamental")))
    near = s.where(F.col("k").between(2, harmonics) & (F.abs(F.col("bin") - F.col("k") * F.col("fundamental")) <= slack * F.col("k") * F.col("fundamental")))
    h = near.groupBy(key, "k").agg(F.max(power).alias("p")).groupBy(key).agg(F.sum("p").alias("p"))
    return f.join(h, key, "left").select(key, "fundamental", F.round(100 * F.sqrt(F.coalesce("p", F.lit(0.0)) / F.pow(F.lit(10.0), F.col("top") / 10)), 4).alias("thd"))


def spectral_features(spectrum_: DataFrame, key: str) -> DataFrame:
    a = F.pow(F.lit(10.0), F.col("db") / 20)
    return spectrum_.groupBy(key).agg(F.round(F.sum(F.col("bin") * a) / F.sum(a), 4).alias("centroid"), F.round(F.avg("db"), 4).alias("mean_db"), F.round(F.stddev_pop("db"), 4).alias("deviation_db"))


def audio_metrics(frames: DataFrame, units: DataFrame | None = None) -> DataFrame:
    """Per sub-channel and profile over superframes: bitrate, superframes, estimate of quality; with access units also the errors of unit_counters, and the share of units that are well."""
    from muxlake.functions.text import audio_quality

    profile = F.when(F.col("ps"), "v2").when(F.col("sbr"), "v1").otherwise("lc")
    frames = frames.withColumn("profile", profile)
    keys = ["stream_id", "sub_channel_id", "profile"]
    g = frames.groupBy(*keys).agg(F.count("*").alias("superframes"), F.max("kbps").alias("kbps"))
    if units is not None:
        at = units.join(frames.select("stream_id", "sub_channel_id", "frame_no", "profile"), ["stream_id", "sub_channel_id", "frame_no"])
        n = unit_counters(frames, at, *keys).drop("superframes")
        g = g.join(n, keys).withColumn("units_ok", F.round(F.when(F.col("units") > 0, 1 - F.col("unit_errors") / F.col("units")), 6))
    q = audio_quality(F.col("kbps"), F.col("profile"), F.lit(3))
    return g.withColumn("quality", F.round(q, 4)).withColumn("low", F.col("quality") < 50)


