"""Periodic runs of words: maximal stretches that repeat themselves with some period.

A run of period q and of `times` periods or more is found from a grid: the words that
equal the word q further on stand in a row at least max(least, times * q) - q long, so
they hold a multiple of that number. Grids of all periods together have n log n points.
A point is kept if words beside it agree; how far they agree to both sides is a longest
common extension (LCE) of two places.

LCEs are answered by a difference cover: places whose number modulo `modulus` is in the
cover are sampled, and of any two places some are both sampled at one distance below the
modulus. So only sampled suffixes are sorted (by doubling, from windows of one modulus),
the few words before the samples are compared one by one, and the rest is a range minimum
over the sorted suffixes' common prefixes, by a sparse table. A text in which no grid
point reaches its samples is never sorted.

All of it is numpy over one text at a time: memory is about 60 bytes a word, and 4 * 0.31
log2(n) more for the sparse table where a text needs one. Texts don't meet, so nothing is
shuffled.

Cases: a null, empty or blank text has no words and no runs. Words are bytes between
ASCII white space, so ill-formed UTF-8 is just other bytes. Repeated rows are rows of their
own. Other columns pass through; the result is a struct column of a name that is free.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import BLANKS, bound_batches, free_name, released

#: A difference cover: each remainder modulo 13 is a difference of two of its members.
MODULUS, COVER = 13, (0, 1, 3, 9)
#: Grid points that are looked at together.
POINTS = 1 << 20
IS_BLANK = np.zeros(256, bool)
IS_BLANK[list(BLANKS.encode())] = True


def shifts(modulus: int, cover: tuple[int, ...]) -> np.ndarray:
    """[i, j]: the least distance at which places of remainders i and j are both sampled."""
    r = np.arange(modulus)
    both = np.isin((r[:, None] + r) % modulus, cover)  # [i, d]
    return (both[:, None, :] & both[None, :, :]).argmax(axis=2)


SHIFT = shifts(MODULUS, COVER)


class Extensions:
    """Longest common extensions to the right in a sequence of numbers over 0."""

    def __init__(self, x: np.ndarray):
        self.n = len(x)
        self.x = np.r_[x, np.zeros(MODULUS, x.dtype)]  # 0 ends the sequence and equals no member of it
        self.table: list[np.ndarray] | None = None

    def _sort(self) -> None:
        """Ranks of the sampled suffixes, and the sparse table over their common prefixes."""
        places = np.concatenate([np.arange(r, self.n, MODULUS) for r in COVER])
        ends = np.cumsum([len(range(r, self.n, MODULUS)) for r in COVER])
        end = ends[np.searchsorted(ends, np.arange(len(places)), side="right")]  # of the class of each
        m, bits = len(places), max(1, int(self.x.max()).bit_length())
        keys, width = [], 63 // bits
        for t in range(0, MODULUS, width):
            key = np.zeros(m, np.int64)
            for d in range(t, min(t + width, MODULUS)):
                key = (key << bits) | self.x[places + d]
            keys.append(key)
        levels, step = [_ranks(keys)], 1
        while int(levels[-1].max(initial=0)) + 1 < m:
            after = np.arange(m) + step
            inside = after < end
            second = np.where(inside, levels[-1][np.where(inside, after, 0)] + 1, 0)
            levels.append(_ranks([levels[-1], second]))
            step *= 2
        self.rank = np.zeros(self.n, np.int32)
        self.rank[places] = levels[-1]
        order = np.argsort(levels[-1])
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(0, m - 1), np.int64)
        for k in range(len(levels) - 2, -1, -1):  # equal windows are whole ones, as no two suffixes end alike
            same = np.flatnonzero((a < end[order[:-1]]) & (b < end[order[1:]]))
            same = same[levels[k][a[same]] == levels[k][b[same]]]
            common[same] += MODULUS << k
            a[same] += 1 << k
            b[same] += 1 << k
        common += self._few(places[order[:-1]] + common, places[order[1:]] + common, np.full(m - 1, MODULUS) if m else common)
        self.table, k = [common.astype(np.int32)], 1
        while 2 * k <= len(common):
            last = self.table[-1]
            self.table.append(np.minimum(last[:-k], last[k:]))
            k *= 2

    def _few(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many of at most `most` members from i and j on are equal, one by one."""
        out = np.zeros(len(i), np.int64)
        at = np.flatnonzero((most > 0) & (np.maximum(i, j) < self.n))
        while len(at):
            at = at[self.x[i[at] + out[at]] == self.x[j[at] + out[at]]]
            out[at] += 1
            at = at[(out[at] < most[at]) & (np.maximum(i[at], j[at]) + out[at] < self.n)]
        return out

    def of(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The common extension of places i and j, i < j."""
        shift = SHIFT[i % MODULUS, j % MODULUS]
        out = self._few(i, j, shift)
        at = np.flatnonzero((out == shift) & (j + shift < self.n))
        if len(at):
            if self.table is None:
                self._sort()
            p, q = self.rank[i[at] + shift[at]], self.rank[j[at] + shift[at]]
            low, high = np.minimum(p, q), np.maximum(p, q)
            level = np.frexp(high - low)[1] - 1
            got = np.empty(len(at), np.int64)
            for k in np.unique(level):
                w = level == k
                got[w] = np.minimum(self.table[k][low[w]], self.table[k][high[w] - (1 << k)])
            out[at] += got
        return out


def _ranks(keys: list[np.ndarray]) -> np.ndarray:
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order[1:]] != k[order[:-1]]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _agree(x: np.ndarray, g: np.ndarray, q: np.ndarray, many: int, way: int) -> np.ndarray:
    """Whether `many` members in a row, from g on to one side, equal those q further on."""
    at, n = np.arange(len(g)), len(x)
    for t in range(many):
        i = g[at] + way * t
        at = at[(i >= 0) & (i + q[at] < n)]
        i = g[at] + way * t
        at = at[x[i] == x[i + q[at]]]
    out = np.zeros(len(g), bool)
    out[at] = True
    return out


def runs(x: np.ndarray, least: int = 24, times: int = 3) -> np.ndarray:
    """Rows (start, length, period), by start and period: stretches of length >= max(least, times * period), of that smallest period, that no neighbour extends. times is 2 or more."""
    n, found = len(x), []
    right = left = None
    periods = np.arange(1, n // times + 1) if n >= least else np.zeros(0, np.int64)
    steps = np.maximum(least, times * periods) - periods
    points = -(-(n - periods) // steps)
    parts = np.searchsorted(np.cumsum(points), np.arange(POINTS, int(points.sum()) + POINTS, POINTS))
    begin = 0
    for end in np.minimum(parts + 1, len(periods)).tolist():
        own = slice(begin, end)
        begin = max(begin, end)
        of = np.repeat(np.arange(own.start, max(own.start, own.stop)), points[own])
        if not len(of):
            continue
        first = np.repeat(np.cumsum(points[own]) - points[own], points[own])
        g, q = (np.arange(len(of)) - first) * steps[of], periods[of]
        at = np.flatnonzero(x[g] == x[g + q])
        g, q, half = g[at], q[at], max(1, min(8, int(steps[own].min()) // 2))
        keep = _agree(x, g, q, half, 1) | _agree(x, g, q, half, -1)
        g, q = g[keep], q[keep]
        if not len(g):
            continue
        if right is None:
            right, left = Extensions(x), Extensions(x[::-1])
        forward = right.of(g, g + q)
        back = left.of(n - 1 - g - q, n - 1 - g)  # both count g itself
        start, length = g - back + 1, back + forward - 1 + q
        long_ = length >= np.maximum(least, times * q)
        found.append(np.stack([start, length, q], axis=1)[long_])
    out = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)
    if len(out):  # a stretch that stands for several periods has the smallest; rows are sorted by all three
        out = out[np.r_[True, (out[1:, :2] != out[:-1, :2]).any(axis=1)]]
        out = out[np.lexsort((out[:, 2], out[:, 0]))]
    return out


def words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a text: a number over 0 for each word, its length in bytes, and the bytes of all words."""
    raw = np.frombuffer(text, np.uint8)
    blank = np.r_[True, IS_BLANK[raw], True]
    edge = np.flatnonzero(blank[1:] != blank[:-1])
    size = (edge[1::2] - edge[::2]).astype(np.int32)
    data = raw[~blank[1:-1]]
    if not len(size):
        return size, size, data
    offsets = np.r_[np.int32(0), np.cumsum(size, dtype=np.int32)]
    coded = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(offsets), pa.py_buffer(data)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False) + 1, size, data


def collapsed(size: np.ndarray, data: np.ndarray, found: np.ndarray) -> bytes:
    """The words joined by blanks, without those that a run holds after its first period."""
    ends = np.zeros(len(size) + 1, np.int64)
    np.add.at(ends, found[:, 0] + found[:, 2], 1)
    np.add.at(ends, found[:, 0] + found[:, 1], -1)
    keep = np.cumsum(ends[:-1]) == 0
    kept, k = size[keep], int(keep.sum())
    if not k:
        return b""
    out = np.full(int(kept.sum()) + k - 1, ord(" "), np.uint8)
    own = data[np.repeat(keep, size)]
    out[np.arange(len(own)) + np.repeat(np.arange(k), kept)] = own
    return out.tobytes()


def _find(column: str, least: int, times: int):
    def run(batches):
        for b in batches:
            n, sizes, rows, texts = [], [0], [], []
            for text in b[column].to_pylist():
                x, size, data = words(text or b"")
                found = runs(x, least, times)
                n.append(len(x))
                sizes.append(sizes[-1] + len(found))
                rows.append(found)
                texts.append(collapsed(size, data, found))
            all_ = np.concatenate(rows) if rows else np.zeros((0, 3), np.int64)
            items = pa.StructArray.from_arrays([pa.array(all_[:, i], pa.int64()) for i in range(3)], ["start", "length", "period"])
            out = [pa.array(n, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), items), pa.array(texts, pa.binary())]
            at = b.schema.get_field_index(column)
            names = [f.name for f in b.schema]
            yield pa.RecordBatch.from_arrays([*(c for i, c in enumerate(b.columns) if i != at), pa.StructArray.from_arrays(out, ["n_words", "runs", "collapsed"])], [x for i, x in enumerate(names) if i != at] + [column])

    return run


RESULT = "struct<n_words: long, runs: array<struct<start: long, length: long, period: long>>, collapsed: binary>"


def periodic_runs(docs: DataFrame, text: str = "text", result: str = "periodic", least: int = 24, times: int = 3) -> DataFrame:
    """docs with a struct column: n_words, runs (start and length in words, period), and the text of its words without the repeats, joined by blanks."""
    bound_batches(docs.sparkSession)
    name = free_name(docs, result)
    given = docs.withColumn(name, F.col(text).cast("binary"))
    schema = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema) + f", `{name}` {RESULT}"
    out = given.mapInArrow(released(_find(name, least, times)), schema)
    return out.withColumn(name, F.col(name).withField("collapsed", F.col(f"{name}.collapsed").cast("string")))
