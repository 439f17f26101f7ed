"""Bytes, bits and checksums as column expressions."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


#: crc16 of any message that is followed by its stored checksum.
CRC16_RESIDUE = 0x1D0F


def u(data: Column, at: Column | int, n: int = 1) -> Column:
    """Big-endian unsigned number of n bytes of data from offset at (0-based); null beyond the end."""
    part = F.substring(data, (F.lit(at) if isinstance(at, int) else at) + 1, n)
    return F.when(F.octet_length(part) == n, F.conv(F.hex(part), 16, 10).cast("long"))


def bits(x: Column, shift: int, width: int) -> Column:
    return F.shiftright(x, shift).bitwiseAND((1 << width) - 1)


def signed(x: Column, width: int) -> Column:
    return F.when(x >= 1 << (width - 1), x - (1 << width)).otherwise(x)


def crc_table(polynomial: int, width: int) -> list[int]:
    """Of each byte, by the rule: shift out, subtract the polynomial."""
    top, mask, out = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        c = byte << (width - 8)
        for _ in range(8):
            c = (c << 1 ^ polynomial if c & top else c << 1) & mask
        out.append(c)
    return out


def edges_and_bytes(data: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each binary of a batch begins and the last one ends, and the bytes of all."""
    data = data.cast(pa.large_binary())
    _, edges, held = data.buffers()
    at = np.frombuffer(edges, np.int64)[data.offset : data.offset + len(data) + 1]
    return at, np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)


def crc_arrow(data: pa.Array, polynomial: int, width: int, start: int) -> pa.Array:
    """Checksums of a batch of binaries, byte by byte over all of them at once; null for nulls."""
    n, mask = len(data), (1 << width) - 1
    table = np.array(crc_table(polynomial, width), np.uint64)
    at, held = edges_and_bytes(data)
    size = np.diff(at)
    order = np.argsort(-size, kind="stable")  # those that go on are a prefix
    begin, going = at[:-1][order], np.searchsorted(-size[order], -np.arange(int(size.max(initial=0))), "left")
    c = np.full(n, start, np.uint64)
    for i, k in enumerate(going.tolist()):
        x = c[:k]
        c[:k] = ((x << np.uint64(8)) & np.uint64(mask)) ^ table[(x >> np.uint64(width - 8)) ^ held[begin[:k] + i]]
    out = np.empty(n, np.int64)
    out[order] = c.astype(np.int64)
    return pa.array(out, mask=np.asarray(data.is_null()))


def crc(data: Column, polynomial: int, width: int, start: int) -> Column:
    """Non-reflected checksum of all bytes of data, of any length, without a final complement: over Arrow batches."""

    def run(x: pa.Array) -> pa.Array:
        return crc_arrow(x, polynomial, width, start)

    return F.arrow_udf(run, "long")(data)


def parity_masks(polynomial: int, width: int, n: int, word: int) -> list[list[int]]:
    """Of each bit of the checksum of n bytes (start 0): which bits of each word of the message it is the parity of. A checksum is linear in the message."""
    one, c = [], 1 << (width - 1)
    for _ in range(8 * n):  # a single bit followed by k others leaves x**(width + k) mod the polynomial
        c = ((c << 1) ^ polynomial if c & (1 << (width - 1)) else c << 1) & ((1 << width) - 1)
        one.append(c)
    at = one[::-1]
    return [[sum(1 << (8 * word - 1 - i) for i in range(8 * word) if at[8 * word * w + i] >> bit & 1) for w in range(n // word)] for bit in range(width)]


def crc_fixed(data: Column, polynomial: int, width: int, start: int, n: int, word: int) -> Column:
    """crc of data of exactly n bytes, n a multiple of word: bit counts of masked words instead of a walk over bytes. Null for other lengths."""
    words = [F.when(F.octet_length(data) == n, u(data, i, word)) for i in range(0, n, word)]  # not around the whole: Spark computes a shared part once only where it is always needed
    out = F.lit(crc_of_zeros(polynomial, width, start, n)).cast("long")
    for bit, masks in enumerate(parity_masks(polynomial, width, n, word)):
        ones = reduce(operator.add, [F.bit_count(w.bitwiseAND(F.lit(m))) for w, m in zip(words, masks, strict=True) if m])
        out = out.bitwiseXOR(F.shiftleft(ones.bitwiseAND(1).cast("long"), bit))
    return out


def crc16_of(data: Column, n: int, word: int = 6) -> Column:
    """crc16 of data of exactly n bytes."""
    return crc_fixed(data, 0x1021, 16, 0xFFFF, n, word)


def crc_of_zeros(polynomial: int, width: int, start: int, n: int) -> int:
    """What the start value leaves after n bytes of zeros."""
    table, c, mask = crc_table(polynomial, width), start, (1 << width) - 1
    for _ in range(n):
        c = (c << 8 & mask) ^ table[c >> (width - 8)]
    return c


def crc16(data: Column) -> Column:
    """CCITT, start FFFF, no complement; the stored one is its complement."""
    return crc(data, 0x1021, 16, 0xFFFF)


def crc16_stored(data: Column) -> Column:
    return crc16(data).bitwiseXOR(0xFFFF)


def crc32_frame(data: Column) -> Column:
    return crc(data, 0x04C11DB7, 32, 0xFFFFFFFF).bitwiseXOR(0xFFFFFFFF)


def fire_code(data: Column, n: int | None = None) -> Column:
    """CRC of superframe header bytes; n where data is of that many bytes, a multiple of 3, which spares the Arrow batch."""
    return crc_fixed(data, 0x782F, 16, 0, n, 3) if n else crc(data, 0x782F, 16, 0)


def walk(data: Column, start: int, least: int, stride: Callable[[Column], Column], go: Callable[[Column], Column] | None = None, shortest: int = 1) -> Column:
    """Offsets of the entries of a list with lengths of their own: from start on while `least` bytes are left (and go holds), by stride(offset). No stride is below `shortest`."""
    n = F.octet_length(data)
    begin = F.struct(F.lit(start).cast("int").alias("pos"), F.array().cast("array<int>").alias("at"), F.lit(True).alias("on"))

    def step(s: Column, _: Column) -> Column:
        on = s["on"] & (s["pos"] + least <= n)
        if go is not None:
            on = on & F.coalesce(go(s["pos"]), F.lit(False))
        return F.when(on, F.struct((s["pos"] + F.greatest(stride(s["pos"]).cast("int"), F.lit(shortest))).cast("int").alias("pos"), F.array_append(s["at"], s["pos"]).alias("at"), F.lit(True).alias("on"))).otherwise(F.struct(s["pos"].alias("pos"), s["at"].alias("at"), F.lit(False).alias("on")))

    turns = F.sequence(F.lit(1), F.greatest(F.ceil(n / shortest).cast("int"), F.lit(1)))
    return F.aggregate(turns, begin, step, lambda s: s["at"])


def flag_list(word: Column, width: int = 16) -> Column:
    """Numbers of the bits that are set."""
    return F.filter(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.getbit(word.cast("long"), i.cast("int")) == 1)


def pack(*parts: tuple[Column, int]) -> Column:
    """Binary of (number, bytes) parts, big-endian: the inverse of u."""
    return F.unhex(F.concat(*[F.lpad(F.hex(x.cast("long")), 2 * n, "0") for x, n in parts]))
