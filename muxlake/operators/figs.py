"""FIG blocks and their decoders (P08-P15 and the G-family).

figs: stream_id, frame_no, fig_type, ext, data (from the extension byte on), and what the
walk adds. Each decoder filters its type and extension, walks the entries and gives a row
an entry. Entries of one length are exploded by position, others by bits.walk.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions.bits import bits, edges_and_bytes, flag_list, signed, u, walk
from muxlake.functions.text import decode_label, lto_minutes, mjd_timestamp, short_label
from muxlake.operators.scan import looking_back, running

def D() -> Column:
    return F.col("data")


KEYS = ["stream_id", "frame_no"]


def explode_figs(fibs: DataFrame, types: list[int] | None = None) -> DataFrame:
    """The blocks of each FIB area: header type(3) length(5). Type 7 ends; length 0 or an overrun ends and is erroneous; over 29 is skipped and erroneous."""
    keys = ["stream_id", "frame_no", "fib_no", "crc_ok"]
    f = fibs.select(*keys, "area", F.arrow_udf(list_figs, LISTED)("area").alias("listed"))
    f = f.select(*keys, "listed.ended_badly", "area", F.posexplode_outer("listed.figs").alias("seq", "fig")).where("fig.len <= 29")
    if types is not None:
        f = f.where(F.col("fig.fig_type").isin(types))
    data = F.substring("area", F.col("fig.at") + 2, F.col("fig.len"))
    b0 = F.col("fig.first")
    return f.select(*keys, "ended_badly", "seq", "fig.fig_type", "fig.len", data.alias("data"), fig_extension(F.col("fig.fig_type"), b0).cast("int").alias("ext"), (bits(b0, 6, 1) == 1).alias("oe"), (bits(b0, 5, 1) == 1).alias("pd"))


LISTED = "struct<figs:array<struct<at:int,fig_type:int,len:int,first:int>>,ended_badly:boolean>"


def list_figs(areas: pa.Array) -> pa.Array:
    """LISTED of each area of a batch: offset, type, length and first byte of its blocks. A step takes the next block of all areas that go on."""
    n, null = len(areas), np.asarray(areas.is_null())
    edges, held = edges_and_bytes(areas)
    begin, size = edges[:-1], np.where(null, 0, np.diff(edges))
    at, badly, on = np.zeros(n, np.int64), np.zeros(n, bool), np.arange(n)
    rows, found = [np.zeros(0, np.int64)], [np.zeros((4, 0), np.int64)]
    while True:
        on = on[at[on] < size[on]]
        if not len(on):
            break
        head = held[begin[on] + at[on]].astype(np.int64)
        kind, length = head >> 5, head & 31
        good = (kind != 7) & (length > 0) & (at[on] + 1 + length <= size[on])
        badly[on[~good & (kind != 7)]] = True
        on, kind, length = on[good], kind[good], length[good]
        rows.append(on)
        found.append(np.stack([at[on], kind, length, held[begin[on] + at[on] + 1].astype(np.int64)]))
        at[on] += 1 + length
    row = np.concatenate(rows)
    order = np.argsort(row, kind="stable")  # steps follow each other, so an area's blocks stay in order
    columns = np.concatenate(found, axis=1)[:, order].astype(np.int32)
    figs = pa.StructArray.from_arrays([pa.array(c) for c in columns], ["at", "fig_type", "len", "first"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]).astype(np.int32)
    return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(ends), figs), pa.array(badly)], ["figs", "ended_badly"])


def fig_extension(fig_type: Column, first: Column) -> Column:
    return F.when(fig_type == 0, bits(first, 0, 5)).when(fig_type.isin(1, 2), bits(first, 0, 3)).otherwise(F.lit(0))


def fic_mode(fibs: DataFrame, mode: str = "auto") -> DataFrame:
    """strict: FIBs of good CRC; raw: all; auto: all only of frames in which every FIB fails."""
    if mode == "raw":
        return fibs
    if mode == "strict":
        return fibs.where("crc_ok")
    any_ok = F.max(F.col("crc_ok").cast("int")).over(Window.partitionBy(*KEYS))
    return fibs.withColumn("_any", any_ok).where("crc_ok OR _any = 0").drop("_any")


def of(figs: DataFrame, fig_type: int, ext: int, least: int) -> DataFrame:
    return figs.where((F.col("fig_type") == fig_type) & (F.col("ext") == ext) & (F.octet_length("data") >= least))


def rows(f: DataFrame, **columns: Column) -> DataFrame:
    return f.select(*KEYS, *[c.alias(k) for k, c in columns.items()])


def entries(f: DataFrame, stride: int, start: int = 1) -> DataFrame:
    """A row for each whole entry of one length, with its offset p."""
    n = F.floor((F.octet_length("data") - start) / stride).cast("int")
    return f.where(n > 0).withColumn("p", F.explode(F.sequence(F.lit(start), start + (n - 1) * stride, F.lit(stride))))


def walked(f: DataFrame, least: int, stride, start: int = 1) -> DataFrame:
    return f.withColumn("p", F.explode_outer(walk(D(), start, least, stride))).where("p IS NOT NULL")


def P() -> Column:
    """Offset of the entry."""
    return F.col("p")


def PD() -> Column:
    """Flag of 32-bit ids in the extension byte."""
    return bits(u(D(), 0), 5, 1) == 1


def b(i: int, n: int = 1) -> Column:
    return u(D(), P() + i, n)


def fig0_0(figs: DataFrame) -> DataFrame:
    long_, b3 = F.octet_length("data") >= 6, u(D(), 3)
    change = F.when(long_, bits(b3, 6, 2)).otherwise(0)
    return rows(of(figs, 0, 0, 5), eid=u(D(), 1, 2), country_id=bits(u(D(), 1, 2), 12, 4), change=change, alarm=F.coalesce(long_ & (bits(b3, 5, 1) == 1), F.lit(False)), cif_count=F.when(long_, bits(u(D(), 3, 2), 0, 13)).otherwise(0), occurrence_change=F.when(change != 0, u(D(), 5)))


def fig0_1(figs: DataFrame) -> DataFrame:
    """Long (equal protection) and short (unequal) entries; addresses beyond the multiplex are left out."""
    long_ = bits(b(2), 7, 1) == 1
    f = walked(of(figs, 0, 1, 4), 3, lambda p: F.when(bits(u(D(), p + 2), 7, 1) == 1, 4).otherwise(3))
    f = f.where(~long_ | (P() + 4 <= F.octet_length("data")))
    out = rows(
        f, sub_channel_id=bits(b(0), 2, 6), start_address=bits(b(0, 2), 0, 10), size=F.when(long_, bits(b(2, 2), 0, 10)).otherwise(0), uep=~long_, protection_option=F.when(long_, bits(b(2), 4, 3)),
        protection_level=F.when(long_, bits(b(2), 2, 2) + 1).otherwise(0), table_switch=F.when(~long_, bits(b(2), 6, 1)), table_index=F.when(~long_, bits(b(2), 0, 6)),
    )
    return out.where(F.col("start_address") + F.col("size") <= 864)


def fig0_2(figs: DataFrame, reserved: list[int] | None = None) -> DataFrame:
    """A row a component: 16-bit ids of programmes, 32-bit ids of data services. Reserved ids of programmes, 0 and FFFF unless said otherwise, are left out."""
    w = F.when(PD(), 4).otherwise(2)
    n = lambda p: bits(u(D(), p + w), 0, 4)
    f = walked(of(figs, 0, 2, 4), 4, lambda p: w + 1 + 2 * n(p))
    f = f.withColumn("sid", F.when(PD(), b(0, 4)).otherwise(b(0, 2))).withColumn("n", n(P()).cast("int")).where("n > 0")
    f = f.withColumn("c", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("p", (P() + w + 1 + 2 * F.col("c")).cast("int"))
    f = f.where(b(1).isNotNull())
    valid = F.when(PD(), F.col("sid") != 0xFFFFFFFF).otherwise(~F.col("sid").isin([0, 0xFFFF] if reserved is None else reserved))
    return rows(f.where(valid), sid=F.col("sid"), is_programme=~PD(), country_id=F.when(PD(), bits(F.col("sid"), 20, 4)).otherwise(bits(F.col("sid"), 12, 4)), ecc=F.when(PD(), bits(F.col("sid"), 24, 8)).otherwise(0), tmid=bits(b(0), 6, 2), asc_ty=bits(b(0), 0, 6), sub_channel_id=bits(b(1), 2, 6), primary=bits(b(1), 1, 1) == 1, ca=bits(b(1), 0, 1) == 1)


def fig0_3(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 3, 6), 5), scid=bits(b(0, 2), 4, 12), dscty=bits(b(2), 0, 6), sub_channel_id=bits(b(3), 2, 6), packet_address=bits(b(3, 2), 0, 10), ca=bits(b(1), 0, 1) == 1)


def fig0_4(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 4, 7), 6), sid=b(0, 2), sub_channel_id=bits(b(2), 2, 6), tmid=bits(b(2), 0, 2), asc_ty=bits(b(3), 0, 6), primary=bits(b(3), 6, 1) == 1, ca=bits(b(3), 7, 1) == 1, scid=b(4, 2))


def fig0_5(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 5, 3), 2), sub_channel_id=bits(b(0), 2, 6), short_form=bits(b(0), 0, 1) == 0, language=b(1))


def fig0_6(figs: DataFrame) -> DataFrame:
    """A linkage set with its ids; 2 to 5 bytes an id by P()/D() and international flag."""
    f = of(figs, 0, 6, 3).withColumn("w", F.when(PD(), 4).otherwise(2) + bits(u(D(), 1), 3, 1)).withColumn("n", F.when(bits(u(D(), 1), 0, 1) == 1, F.coalesce(bits(u(D(), 3), 4, 4), F.lit(0))).otherwise(0).cast("int"))
    at = F.when(F.col("n") > 0, F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: u(D(), 4 + i * F.col("w") + bits(u(D(), 1), 3, 1), (F.col("w") - bits(u(D(), 1), 3, 1)).cast("int")))).otherwise(F.array())
    return rows(f, lsn=bits(u(D(), 1), 4, 4) * 256 + u(D(), 2), active=bits(u(D(), 1), 1, 1) == 1, hard=bits(u(D(), 1), 2, 1) == 1, international=bits(u(D(), 1), 3, 1) == 1, id_qualifier=F.when(F.col("n") > 0, bits(u(D(), 3), 1, 2)), ids=F.array_compact(at))


def fig0_7(figs: DataFrame) -> DataFrame:
    return rows(of(figs, 0, 7, 3), service_count=bits(u(D(), 1, 2), 10, 6), reconfigurations=bits(u(D(), 1, 2), 0, 10))


def fig0_8(figs: DataFrame) -> DataFrame:
    w = F.when(PD(), 4).otherwise(2)
    long_ = lambda p: bits(u(D(), p + w + 1), 0, 1) == 1
    f = walked(of(figs, 0, 8, 5), 4, lambda p: w + F.when(long_(p), 3).otherwise(2)).where(P() + w + F.when(long_(P()), 3).otherwise(2) <= F.octet_length("data"))
    at = P() + w
    return rows(f, sid=F.when(PD(), b(0, 4)).otherwise(b(0, 2)), scids=bits(u(D(), at), 4, 4), long_form=long_(P()), scid=F.when(long_(P()), bits(u(D(), at + 1), 4, 4) * 256 + u(D(), at + 2)), sub_channel_id=F.when(~long_(P()), bits(u(D(), at + 1), 2, 6)))


def fig0_9(figs: DataFrame) -> DataFrame:
    return rows(of(figs, 0, 9, 4), extended=bits(u(D(), 1), 7, 1) == 1, lto_minutes=lto_minutes(u(D(), 1)), ecc=u(D(), 2), table_id=u(D(), 3))


def fig0_9_services(figs: DataFrame) -> DataFrame:
    """Country codes of single services in the extended part: groups of up to three."""
    n = lambda p: bits(u(D(), p), 6, 2)
    f = walked(of(figs, 0, 9, 4).where(bits(u(D(), 1), 7, 1) == 1), 2, lambda p: F.when(PD(), 1 + 4 * n(p)).otherwise(2 + 2 * n(p)), start=4)
    f = f.withColumn("n", n(P()).cast("int")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    long_id = u(D(), P() + 1 + 4 * F.col("i"), 4)
    out = rows(f, sid=F.when(PD(), bits(long_id, 0, 16)).otherwise(u(D(), P() + 2 + 2 * F.col("i"), 2)), ecc=F.when(PD(), bits(long_id, 24, 8)).otherwise(b(1)))
    return out.where("sid IS NOT NULL")


def fig0_10(figs: DataFrame) -> DataFrame:
    b3 = u(D(), 3)
    mjd, utc = bits(u(D(), 1), 1, 7) * 1024 + u(D(), 2) * 4 + bits(b3, 6, 2), bits(b3, 3, 1) == 1
    long_ = utc & (F.octet_length("data") >= 7)
    second, ms = F.when(long_, bits(u(D(), 5), 0, 6)).otherwise(0), F.when(long_, bits(u(D(), 5), 6, 2) * 256 + u(D(), 6)).otherwise(0)
    hour, minute = bits(b3, 0, 3) * 4 + bits(u(D(), 4), 6, 2), bits(u(D(), 4), 0, 6)
    return rows(of(figs, 0, 10, 5), mjd=mjd, utc=utc, lsi=bits(b3, 5, 1) == 1, confidence=bits(b3, 4, 1) == 1, hour=hour, minute=minute, second=second, ms=ms, at=mjd_timestamp(mjd, hour, minute, second, ms))


def fig0_11(figs: DataFrame) -> DataFrame:
    whole = bits(u(D(), 2), 7, 1) == 1
    f = of(figs, 0, 11, 3).where(~whole | (F.octet_length("data") >= 5))
    return rows(f, region_id=u(D(), 1), whole_ensemble=whole, eid=F.when(whole, bits(u(D(), 2), 0, 6) * 1024 + u(D(), 3) * 4 + bits(u(D(), 4), 6, 2)), sub_channel_id=F.when(~whole, bits(u(D(), 2), 0, 6)))


def fig0_12(figs: DataFrame) -> DataFrame:
    return rows(of(figs, 0, 12, 8), sid=u(D(), 1, 4), msc=bits(u(D(), 5), 7, 1) == 1, sub_channel_id=bits(u(D(), 5), 1, 6), frame_size=u(D(), 6, 2)).where("sid <> 0 AND frame_size <> 0")


def fig0_13(figs: DataFrame) -> DataFrame:
    """A row a user application: the first walk gives the services, the second their applications."""
    w = F.when(PD(), 4).otherwise(2)
    n_apps = lambda p: bits(u(D(), p + w), 0, 4)
    one = lambda q: 2 + bits(u(D(), q + 1), 3, 5)

    def past(p: Column) -> Column:
        """End of the entry: skips its applications one by one."""
        return F.aggregate(F.sequence(F.lit(0), F.greatest(n_apps(p).cast("int"), F.lit(0))), (p + w + 1).cast("int"), lambda q, i: F.when((i < n_apps(p)) & one(q).isNotNull(), (q + one(q)).cast("int")).otherwise(q))

    f = walked(of(figs, 0, 13, 4), 3, lambda p: past(p) - p)
    f = f.withColumn("sid", F.when(PD(), b(0, 4)).otherwise(b(0, 2))).withColumn("scids", bits(u(D(), P() + w), 4, 4)).withColumn("n", n_apps(P()).cast("int")).where("n > 0")
    steps = F.sequence(F.lit(1), F.col("n"))
    offsets = F.aggregate(steps, F.array((P() + w + 1).cast("int")), lambda s, i: F.when((i < F.col("n")) & one(F.element_at(s, -1)).isNotNull(), F.array_append(s, (F.element_at(s, -1) + one(F.element_at(s, -1))).cast("int"))).otherwise(s))
    f = f.withColumn("p", F.explode(offsets)).where((P() + 2 <= F.octet_length("data")) & (P() + one(P()) <= F.octet_length("data")))
    return rows(f, sid=F.col("sid"), scids=F.col("scids"), app_type=b(0) * 8 + bits(b(1), 0, 3), length=bits(b(1), 3, 5), app_data=F.substring(D(), P() + 3, bits(b(1), 3, 5).cast("int")))


def fig0_14(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 14, 2), 1), sub_channel_id=bits(b(0), 2, 6), fec=bits(b(0), 0, 2))


def fig0_15(figs: DataFrame) -> DataFrame:
    long_ = bits(u(D(), 1), 7, 1) == 1
    at = F.when(long_, 5).otherwise(3)
    f = of(figs, 0, 15, 6).where(~long_ | (F.octet_length("data") >= 8))
    out = rows(f, sid=F.when(long_, bits(u(D(), 1, 4), 0, 31)).otherwise(bits(u(D(), 1, 2), 0, 15)), number=u(D(), at, 2), continuation=bits(u(D(), at + 2), 7, 1) == 1, update=bits(u(D(), at + 2), 6, 1) == 1)
    return out.where("sid <> 0 AND number <> 0")


def fig0_16(figs: DataFrame) -> DataFrame:
    return rows(of(figs, 0, 16, 6), sid=u(D(), 1, 2), international=u(D(), 3), pty=bits(u(D(), 4), 3, 5), language=bits(u(D(), 4), 0, 3) * 32 + bits(u(D(), 5), 3, 5)).where("sid <> 0")


def fig0_17(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 17, 5), 4), sid=b(0, 2), static=bits(b(2), 0, 1) == 0, pty=bits(b(3), 3, 5))


def fig0_18(figs: DataFrame) -> DataFrame:
    n = lambda p: bits(u(D(), p + 4), 3, 5)
    f = walked(of(figs, 0, 18, 6), 5, lambda p: 5 + n(p))
    clusters = F.when(n(P()) > 0, F.filter(F.transform(F.sequence(F.lit(0), n(P()).cast("int") - 1), lambda i: u(D(), P() + 5 + i)), lambda x: x.isNotNull() & (x != 0xFF))).otherwise(F.array().cast("array<bigint>"))
    return rows(f, sid=b(0, 2), support=b(2, 2), types=flag_list(b(2, 2)), clusters=clusters)


def fig0_19(figs: DataFrame) -> DataFrame:
    region = lambda p: bits(u(D(), p + 3), 6, 1)
    f = walked(of(figs, 0, 19, 5), 4, lambda p: 4 + region(p)).where(P() + 4 + region(P()) <= F.octet_length("data"))
    return rows(f, cluster=b(0), switching=b(1, 2), new=bits(b(3), 7, 1) == 1, region_id=F.when(region(P()) == 1, bits(b(4), 0, 6)).otherwise(0), sub_channel_id=bits(b(3), 0, 6), alarm=bits(b(2), 0, 1) == 1)


def fig0_20(figs: DataFrame) -> DataFrame:
    f = of(figs, 0, 20, 6).where(u(D(), 5) <= F.octet_length("data") - 6)
    parts = F.when(u(D(), 5) > 0, F.transform(F.sequence(F.lit(0), u(D(), 5).cast("int") - 1), lambda i: u(D(), 6 + i))).otherwise(F.array().cast("array<bigint>"))
    return rows(f, sid=u(D(), 1, 2), scid=bits(u(D(), 3, 2), 4, 12), ca=bits(u(D(), 3, 2), 3, 1) == 1, components=parts).where("sid <> 0")


def fig0_21(figs: DataFrame) -> DataFrame:
    """A row a frequency: regions, in them lists, in them carriers of 3, 1 or 2 bytes by kind. An empty list is a change indication (null)."""
    f = walked(of(figs, 0, 21, 2), 2, lambda p: 2 + bits(u(D(), p + 1), 0, 5))
    f = f.withColumn("region_id", bits(b(0, 2), 5, 11)).withColumn("end", P() + 2 + bits(b(1), 0, 5)).where(F.col("end") <= F.octet_length("data"))
    f = f.withColumn("list", F.substring(D(), P() + 3, (F.col("end") - P() - 2).cast("int")))
    li = F.col("list")
    f = f.withColumn("q", F.explode(walk(li, 0, 3, lambda q: 3 + bits(u(li, q + 2), 0, 3))))
    q = F.col("q")
    f = f.withColumn("kind", bits(u(li, q + 2), 4, 4)).withColumn("n", bits(u(li, q + 2), 0, 3).cast("int")).withColumn("id_field", u(li, q, 2))
    width = F.when(F.col("kind").isin(0, 1), 3).when(F.col("kind").isin(8, 9), 1).when(F.col("kind") == 12, 2).otherwise(8)
    known = (F.col("n") >= width) & (q + 3 + F.col("n") <= F.octet_length(li))
    count = F.when(known, F.floor(F.col("n") / width)).otherwise(1).cast("int")
    f = f.withColumn("w", width).withColumn("known", known).withColumn("k", F.explode(F.sequence(F.lit(0), count - 1)))
    x = lambda n: u(li, q + 3 + F.col("k") * n, n)
    khz = F.when(~F.col("known"), None).when(F.col("w") == 3, 16 * bits(x(3), 0, 19)).when(F.col("w") == 1, 87500 + 100 * x(1)).when(F.col("w") == 2, 5 * x(2))
    return rows(f, region_id=F.col("region_id"), id_field=F.col("id_field"), kind=F.col("kind"), freq_khz=khz)


def fig0_22(figs: DataFrame) -> DataFrame:
    """Transmitters: main ones with a position, sub ones with offsets (catalog.tii_sub_to_main places them)."""
    sub = lambda p: bits(u(D(), p), 7, 1) == 1
    n = lambda p: bits(u(D(), p + 1), 0, 3)
    f = walked(of(figs, 0, 22, 2), 2, lambda p: F.when(sub(p), 2 + 6 * n(p)).otherwise(6))
    f = f.withColumn("is_main", ~sub(P())).withColumn("main_id", bits(b(0), 0, 7)).where(F.col("is_main") & (P() + 6 <= F.octet_length("data")) | ~F.col("is_main") & (n(P()) > 0))
    f = f.withColumn("s", F.explode(F.when(F.col("is_main"), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), n(P()).cast("int") - 1)))).withColumn("at", P() + F.when(F.col("is_main"), 1).otherwise(2 + 6 * F.col("s")))
    f = f.where(F.col("is_main") | (F.col("at") + 6 <= F.octet_length("data")))
    at, main = F.col("at"), F.col("is_main")
    lat, lon = signed(u(D(), at, 2), 16) * 16 + bits(u(D(), at + 4), 4, 4), signed(u(D(), at + 2, 2), 16) * 16 + bits(u(D(), at + 4), 0, 4)
    return rows(
        f, is_main=main, main_id=F.col("main_id"), sub_id=F.when(~main, bits(u(D(), at), 3, 5)), delay=F.when(~main, bits(u(D(), at, 2), 0, 10)), pos=F.col("s"), latitude=F.when(main, lat * 90.0 / 524288.0), longitude=F.when(main, lon * 180.0 / 524288.0),
        lat_offset=F.when(~main, signed(u(D(), at + 2, 2), 16)), lon_offset=F.when(~main, signed(u(D(), at + 4, 2), 16)),
    )


def fig0_24(figs: DataFrame) -> DataFrame:
    return rows(of(figs, 0, 24, 8), eid=u(D(), 1, 2), sid=u(D(), 3, 4), ca=bits(u(D(), 7), 7, 1) == 1).where("eid <> 0 AND sid <> 0")


def fig0_25(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 25, 9), 8), sid=b(0, 4), eid=b(4, 2), support=b(6, 2))


def fig0_26(figs: DataFrame) -> DataFrame:
    return rows(entries(of(figs, 0, 26, 8), 7), eid=b(0, 2), region_id=b(2), freq_khz=b(3, 4))


def _label(f: DataFrame, at: Column | int, policy: str = "raw", **columns: Column) -> DataFrame:
    at = F.lit(at) if isinstance(at, int) else at
    charset, data, mask = bits(u(D(), 0), 4, 4), F.substring(D(), at + 1, 16), u(D(), at + 16, 2)
    return rows(f, **columns, label=decode_label(charset, data, policy), short_label=F.when(mask.isNotNull(), short_label(charset, data, mask)), mask=F.coalesce(mask, F.lit(0)))


def fig1_0(figs: DataFrame, policy: str = "raw") -> DataFrame:
    return _label(of(figs, 1, 0, 19), 3, policy, eid=u(D(), 1, 2))


def fig1_1(figs: DataFrame, policy: str = "raw") -> DataFrame:
    """A set top bit of the id makes it a 32-bit data service; the top bit of a 16-bit id is dropped."""
    data = bits(u(D(), 1), 7, 1) == 1
    f = of(figs, 1, 1, 19).where(~data | (F.octet_length("data") >= 21))
    return _label(f, F.when(data, 5).otherwise(3), policy, sid=F.when(data, u(D(), 1, 4)).otherwise(bits(u(D(), 1, 2), 0, 15)), is_programme=~data)


def fig1_2(figs: DataFrame, policy: str = "raw", ext: int = 2) -> DataFrame:
    """Component label; published with extension 4 as well."""
    data = bits(u(D(), 1), 0, 1) == 1
    f = of(figs, 1, ext, 20).where(~data | (F.octet_length("data") >= 22))
    return _label(f, F.when(data, 6).otherwise(4), policy, scids=bits(u(D(), 1), 2, 6), sid=F.when(data, u(D(), 2, 4)).otherwise(u(D(), 2, 2)))


def fig1_3(figs: DataFrame, policy: str = "raw", ext: int = 3) -> DataFrame:
    """Data service label; published with extension 5 as well."""
    return _label(of(figs, 1, ext, 21), 5, policy, sid=u(D(), 1, 4))


def fig1_6(figs: DataFrame, policy: str = "raw") -> DataFrame:
    """Label of an X-PAD application."""
    pd = bits(u(D(), 1), 7, 1) == 1
    f = of(figs, 1, 6, 20).where(~pd | (F.octet_length("data") >= 23))
    return _label(f, F.when(pd, 7).otherwise(4), policy, app_type=bits(u(D(), 2), 0, 5), scid=F.when(pd, u(D(), 3, 4)).otherwise(bits(u(D(), 1), 0, 4) * 256 + u(D(), 3)))


def fig2(figs: DataFrame) -> DataFrame:
    """Segments of extended labels: 2 to 6 bytes of id by extension, flags and text."""
    top = bits(u(D(), 1), 7, 1) == 1
    ext = bits(u(D(), 0), 0, 3)
    width = F.when(ext.isin(0, 1), 2).when(ext == 4, F.when(top, 5).otherwise(3)).when(ext == 5, 4).when(ext == 6, F.when(top, 6).otherwise(4))
    f = figs.where((F.col("fig_type") == 2) & (F.octet_length("data") >= 3)).withColumn("w", width).where("w IS NOT NULL").where(F.octet_length("data") > F.col("w"))
    segment = bits(u(D(), 0), 4, 3)
    skip = F.when(segment == 0, F.when(bits(u(D(), 0), 3, 1) == 0, 3).otherwise(1)).otherwise(0)
    ids = F.conv(F.hex(F.substring(D(), F.lit(2), F.col("w"))), 16, 10).cast("long")
    return rows(f, ext=ext, toggle=bits(u(D(), 0), 7, 1), segment=segment, id=ids, ucs2=F.coalesce((segment == 0) & (bits(u(D(), F.col("w") + 1), 7, 1) == 1), F.lit(False)), part=F.substring(D(), F.col("w") + 2 + skip, 32))


def assemble_extended_labels(segments: DataFrame) -> DataFrame:
    """The text of each (id, toggle): its segments in order, one of each index."""
    one = segments.groupBy("stream_id", "ext", "id", "toggle", "segment").agg(F.min_by("part", "frame_no").alias("part"))
    parts = F.array_sort(F.collect_list(F.struct("segment", F.hex("part").alias("h"))))
    text = F.decode(F.unhex(F.array_join(F.transform(parts, lambda x: x["h"]), "")), "UTF-8")
    return one.groupBy("stream_id", "ext", "id", "toggle").agg(F.count("*").alias("segments"), text.alias("label"))


def label_sessions(segments: DataFrame, span: float | None = None) -> DataFrame:
    """A row for each time that a label of (stream_id, ext, id) was sent: from one flip of its toggle to the next.

    segments (fig2): stream_id, frame_no, ext, id, toggle, segment, ucs2, part. bitmap has a
    bit for each segment that came, the first copy of each counts; complete if none is
    missing up to the highest. label is null unless complete; UCS-2 where segment 0 says so.
    """
    keys = ["stream_id", "ext", "id"]
    s = segments.withColumn("_at", F.struct("frame_no", "segment"))
    s = looking_back(s, keys, "_at", 1, lambda w: {"_flip": (~F.col("toggle").eqNullSafe(F.lag("toggle").over(w))).cast("int")}, span)
    s = running(s, keys, "_at", {"session": ("total", F.col("_flip"))}, span)
    one = s.groupBy(*keys, "session", "toggle", "segment").agg(F.min_by("part", "frame_no").alias("part"), F.bool_or("ucs2").alias("ucs2"), F.min("frame_no").alias("a"), F.max("frame_no").alias("b"))
    parts = F.unhex(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("segment", F.hex("part").alias("h")))), lambda x: x["h"]), ""))
    out = one.groupBy(*keys, "session", "toggle").agg(F.min("a").alias("first_frame"), F.max("b").alias("last_frame"), F.count("*").alias("segments"), F.bit_or(F.expr("shiftleft(1, CAST(segment AS INT))")).alias("bitmap"), F.bool_or("ucs2").alias("ucs2"), parts.alias("_text"))
    complete = F.col("bitmap").bitwiseAND(F.col("bitmap") + 1) == 0
    text = F.when(F.col("ucs2"), F.decode("_text", "UTF-16BE")).otherwise(F.make_valid_utf8(F.col("_text").cast("string")))
    return out.withColumn("complete", complete).withColumn("label", F.when(F.col("complete"), text)).drop("_text")


def out_of_range(figs: DataFrame) -> DataFrame:
    """FIGs whose extension isn't registered for their type."""
    most = F.create_map(*[F.lit(x) for x in (0, 31, 1, 7, 2, 7, 5, 0, 6, 2)])[F.col("fig_type")]
    return figs.where(most.isNull() | (F.col("ext") > most))
