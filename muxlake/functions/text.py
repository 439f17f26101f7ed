"""Labels, character sets, dates and code names (C-family) as column expressions."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from muxlake.functions.bits import bits

# Complete EBU Latin where it differs from ASCII: 01-1F, 24 5C 5E 60, 7B-7F, 80-FF.
EBU_LOW = "ĘĮŲĂĖĎȘȚĊ\n\vĠĹŻŃąęįųăėďșțċŇĚġĺż\u0082"
EBU_ODD = {0x24: "ł", 0x5C: "Ů", 0x5E: "Ł", 0x60: "Ą", 0x7B: "«", 0x7C: "ů", 0x7D: "»", 0x7E: "Ľ", 0x7F: "Ħ"}
EBU_HIGH = (
    "áàéèíìóòúùÑÇŞß¡Ÿ"
    "âäêëîïôöûüñçşğıÿ"
    "ĶŅ©ĢĞěňőŐ€£$ĀĒĪŪ"
    "ķņĻģļİńűŰ¿ľ°āēīū"
    "ÁÀÉÈÍÌÓÒÚÙŘČŠŽÐĿ"
    "ÂÄÊËÎÏÔÖÛÜřčšžđŀ"
    "ÃÅÆŒŷÝÕØÞŊŔĆŚŹŤð"
    "ãåæœŵýõøþŋŕćśźťħ"
)
EBU_FROM = "".join(map(chr, [*range(1, 32), *EBU_ODD, *range(128, 256)]))
EBU_TO = EBU_LOW + "".join(EBU_ODD.values()) + EBU_HIGH
THAI_FROM = "".join(map(chr, range(0xA1, 0xFC)))
THAI_TO = "".join(map(chr, range(0x0E01, 0x0E5C)))


def latin(data: Column) -> Column:
    return F.decode(data, "ISO-8859-1")


def ebu_to_utf8(data: Column) -> Column:
    """Byte by byte; a NUL gives two question marks in one."""
    return F.translate(F.replace(latin(data), F.lit("\0"), F.lit("⁇")), EBU_FROM, EBU_TO)


def tis620_to_utf8(data: Column) -> Column:
    """ASCII, and the Thai block from A1 to FB; other bytes stay as code points."""
    return F.translate(latin(data), THAI_FROM, THAI_TO)


def decode_label(charset: Column, data: Column, policy: str = "raw", force: int | None = None) -> Column:
    """Label bytes of a character set: 0 EBU Latin, 3 UTF-8, 6 TIS-620; others by policy raw, utf8 or skip. NULs are dropped, trailing spaces too."""
    hexes = F.regexp_replace(F.regexp_replace(F.hex(data), "(..)", "$1 "), "00 ", "")
    data = F.unhex(F.replace(hexes, F.lit(" "), F.lit("")))
    charset = F.lit(force) if force is not None else charset
    plain = F.decode(data, "UTF-8")
    other = F.lit("") if policy == "skip" else plain
    return F.rtrim(F.when(charset == 0, ebu_to_utf8(data)).when(charset == 3, plain).when(charset == 6, tis620_to_utf8(data)).otherwise(other))


def short_label(charset: Column, data: Column, mask: Column) -> Column:
    """The characters of the mask's bits, the first at the top bit."""
    chosen = F.filter(F.sequence(F.lit(0), F.lit(15)), lambda i: F.getbit(mask.cast("long"), (15 - i).cast("int")) == 1)
    hexes = F.array_join(F.transform(chosen, lambda i: F.substring(F.hex(data), i * 2 + 1, 2)), "")
    picked = F.unhex(hexes)
    return F.when(charset == 6, tis620_to_utf8(picked)).when(charset == 0, ebu_to_utf8(picked)).otherwise(F.decode(picked, "UTF-8"))


def is_valid_text(data: Column) -> Column:
    return F.is_valid_utf8(data.cast("string"))


def has_thai(text: Column) -> Column:
    return F.rlike(text, F.lit(r"[฀-๿]"))


def mjd_date(mjd: Column) -> Column:
    return F.date_add(F.lit("1858-11-17").cast("date"), mjd.cast("int"))


def date_mjd(date: Column) -> Column:
    return F.datediff(date, F.lit("1858-11-17").cast("date"))


def mjd_timestamp(mjd: Column, hour: Column, minute: Column, second: Column, ms: Column | None = None) -> Column:
    """Without a time zone; null where the clock is out of range or mjd isn't one of 1970 to 2099."""
    ok = mjd.between(40587, 88068) & (hour < 24) & (minute < 60) & (second < 60)
    text = F.concat_ws(" ", mjd_date(mjd).cast("string"), F.format_string("%02d:%02d:%02d.%03d", hour.cast("int"), minute.cast("int"), second.cast("int"), (F.lit(0) if ms is None else ms).cast("int")))
    return F.when(ok, F.to_timestamp_ntz(text, F.lit("yyyy-MM-dd HH:mm:ss.SSS")))


def bcd(x: Column, most: int = 99) -> Column:
    """Two decimal digits of a byte; 0 if a digit is over 9, at most `most`."""
    high, low = bits(x, 4, 4), bits(x, 0, 4)
    return F.least(F.when((high > 9) | (low > 9), 0).otherwise(high * 10 + low), F.lit(most))


def lto_minutes(x: Column) -> Column:
    """Local time offset from 6 bits of signed half hours; null out of -24 to 28."""
    half = F.when(bits(x, 5, 1) == 1, bits(x, 0, 5) - 32).otherwise(bits(x, 0, 5))
    return F.when(half.between(-24, 28), half * 30)


def byte_slice(text: Column, start: Column, length: Column) -> Column:
    """Part of a text by bytes of its UTF-8; null out of bounds."""
    data = F.encode(text, "UTF-8")
    return F.when((start >= 0) & (length > 0) & (start + length <= F.octet_length(data)), F.try_validate_utf8(F.substring(data, (start + 1).cast("int"), length.cast("int")).cast("string")))


def now_playing(tags: Column, text: Column) -> Column:
    """artist - title, else the title, the artist, the text."""
    artist, title = tags["artist"], tags["title"]
    return F.coalesce(F.concat(artist, F.lit(" - "), title), title, artist, text)


# The JVM's powers and logarithms differ from those of C, which SQL engines call, in the last bit of some: these are C's, over Arrow batches.


def _log10(x: pa.Array) -> pa.Array:
    return pc.log10(x)


def _power_of_10(x: pa.Array) -> pa.Array:
    return pc.power(10.0, x)


def to_db(x: Column, least: float = -120.0) -> Column:
    """Decibels of an amplitude; least where it is 0 or below."""
    return F.when(x <= 0, F.lit(least)).otherwise(20 * F.arrow_udf(_log10, "double")(x.cast("double")))


def from_db(x: Column) -> Column:
    return F.arrow_udf(_power_of_10, "double")(x / 20)


def round_scaled(x: Column, digits: int) -> Column:
    """A double to some digits by whole multiples, halves away from zero, as C does; F.round goes by the decimal digits of x."""
    y = F.round(x * 10.0**digits) / 10.0**digits
    return F.when(F.abs(y) < float("inf"), y).otherwise(x)


def file_name(ts: Column, segment: Column) -> Column:
    return F.concat(F.date_format(ts, "yyyyMMdd_HHmmss"), F.lit("_"), F.lpad(segment.cast("string"), 4, "0"))


def format_hex(x: Column, digits: int = 4) -> Column:
    return F.concat(F.lit("0x"), F.lpad(F.hex(x), digits, "0"))


def format_sid(sid: Column, ecc: Column, mode: str = "hex16") -> Column:
    """hex16, hex32 or country parts ecc:cid:sref."""
    if mode == "parts":
        return F.concat_ws(":", F.lpad(F.hex(ecc), 2, "0"), F.hex(bits(sid, 12, 4)), F.lpad(F.hex(bits(sid, 0, 12)), 3, "0"))
    return format_hex(sid, 8 if mode == "hex32" else 4)


def prohibited_terms(label: Column, terms: list[str], most: int = 16) -> Column:
    """Whether a label holds one of the terms, in any case, or is too long."""
    return F.rlike(F.lower(label), F.lit("|".join(t.lower().replace(".", r"\.") for t in terms))) | (F.length(label) > most)


def bitrate_valid(kbps: Column, level: Column) -> Column:
    return kbps.between(8, 192) & level.between(1, 5)


def audio_quality(kbps: Column, profile: Column, level: Column) -> Column:
    """Bitrate against 48, 96 or 192 by profile (v2, v1, else), 5 % a level, at most 100."""
    full = F.when(profile == "v2", 48.0).when(profile == "v1", 96.0).otherwise(192.0)
    return F.least(kbps / full * 100 * (1 + 0.05 * level), F.lit(100.0))
