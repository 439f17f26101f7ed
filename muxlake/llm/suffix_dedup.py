"""Exact substring dedup: bytes covered by a `length`-byte string that starts twice go.

The sort of all suffixes is split over Spark by anchors. The anchor of a window of
`length` bytes is its k-gram of least hash (the last of equal ones), so equal windows have
equal anchors at equal offsets. An anchor owns a run of window starts; the bytes of these
windows are its context.

1. A map pass emits anchors with a 128-bit hash of their context, no text.
2. Equal contexts are pre-aggregated: all windows of a context that stands twice repeat.
   Anchors that have several contexts need a closer look, one row for each context.
3. These contexts are fetched, dealt by anchor and sorted: within a group, suffixes are
   compared by hash. Prefix polynomial hashes and binary search give the common extension
   of two suffixes, a bottom-up mergesort orders them, and neighbours that share `length`
   bytes are verified byte by byte; a hash collision sends its group to plain bytes.
   Windows whose hash is alone at their anchor and offset can't repeat and aren't sorted.
4. Runs of repeated starts are gathered by document and their bytes cut out.

An anchor with more than `hot` contexts is split: its windows are dealt by slices of
offsets and by a hash of the bytes that all windows of the slice share. Equal slices come
one after the other, and only one of them is held for the sort. Slices that agree in these
bytes but differ beside them (at the ends of a passage that many documents surround by
other text) are sorted in one task, which holds them.

Equal contexts and equal slices are told by 128-bit hashes alone; what the sort finds is
verified.

shared_passages() finds documents that hold a passage of many words, found in another
document as well, whatever its bytes: by winnowed hashes of word k-grams, of which any two
documents with a common run of `words` words have one in common.

Cases: null text is empty. Texts shorter than `length` bytes lose nothing. Repeated rows
are copies of each other and lose all that is long enough. A document is told apart by
doc_id (null is an id like others) and text. Other columns are not used.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import released, table, texts

BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
VALUES = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LOW = 24
SLICE = 16


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


class Hashes:
    """Polynomial hashes of all substrings of a byte array, by prefix sums modulo 2**64."""

    up = down = np.zeros(0, np.uint64)

    def __init__(self, raw: np.ndarray):
        n = len(raw) + 1
        if len(Hashes.up) < n:
            Hashes.up, Hashes.down = powers(BASE, 2 * n), powers(INVERSE, 2 * n)
        self.prefix = np.zeros(n, np.uint64)
        np.cumsum(VALUES[raw] * Hashes.up[: n - 1], out=self.prefix[1:])

    def of(self, start: np.ndarray, length) -> np.ndarray:
        return (self.prefix[start + length] - self.prefix[start]) * Hashes.down[start]


def scrambled(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_minimum(x: np.ndarray, w: int) -> np.ndarray:
    """Least value of each w neighbours."""
    n = len(x)
    padded = np.full(-(-n // w) * w, np.uint64(0xFFFFFFFFFFFFFFFF))
    padded[:n] = x
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(raw: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, anchor position, first and last window start) of each anchor of raw."""
    parts = []
    for at in range(0, len(raw) - length + 1, 1 << (LOW - 1)):  # positions within a part have LOW bits
        part = raw[at : at + (1 << (LOW - 1)) + length - 1]
        own = np.arange(len(part) - k + 1)
        h = scrambled(Hashes(part).of(own, k))
        least = window_minimum((h >> np.uint64(LOW) << np.uint64(LOW)) | ((1 << LOW) - 1 - own).astype(np.uint64), length - k + 1)
        first = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        last = np.r_[first[1:], len(least)] - 1
        pos = (1 << LOW) - 1 - (least[first] & np.uint64((1 << LOW) - 1)).astype(np.int64)
        parts.append((h[pos].view(np.int64), at + pos, at + first, at + last))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 4


def _anchors(length: int, k: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[] for _ in range(7)]
            ids: list = []
            for doc_id, text_hash, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), strict=True):
                data = text or b""
                if len(data) < length:
                    continue
                h, pos, first, last = anchors(np.frombuffer(data, np.uint8), length, k)
                view, digests = memoryview(data), []
                for p, s, e in zip(pos.tolist(), first.tolist(), last.tolist(), strict=True):
                    digests.append(xxhash.xxh3_128_digest(view[s : e + length], p - s))
                c = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
                for column, v in zip(out, (h, c[:, 0], c[:, 1], np.full(len(h), text_hash), pos, first, last), strict=True):
                    column.append(v)
                ids += [doc_id] * len(h)
            arrays = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in out]
            arrays.insert(3, pa.array(ids, pa.int64()))
            yield pa.RecordBatch.from_arrays(arrays, ["anchor", "c1", "c2", "doc_id", "text_hash", "pos", "first", "last"])

    return run


def common_extension(hashes: Hashes, x: np.ndarray, y: np.ndarray, length: int) -> np.ndarray:
    """How many of the first `length` bytes the suffixes at x and y share, by binary search."""
    low = np.where(hashes.of(x, length) == hashes.of(y, length), length, 0)
    open_ = np.flatnonzero(low < length)
    lo, hi = np.zeros(len(open_), np.int64), np.full(len(open_), length - 1)
    while (lo < hi).any():
        mid = (lo + hi + 1) // 2
        same = hashes.of(x[open_], mid) == hashes.of(y[open_], mid)
        lo, hi = np.where(same, mid, lo), np.where(same, hi, mid - 1)
    low[open_] = lo
    return low


def suffix_sort(raw: np.ndarray, hashes: Hashes, starts: np.ndarray, group: np.ndarray, length: int) -> np.ndarray:
    """Order of the suffixes at starts, by group, then by their first `length` bytes: a bottom-up mergesort, all runs side by side."""
    order = np.argsort(group, kind="stable")
    g = group[order]
    n = len(order)
    begins = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if n else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begins, n])
    begin, size = np.repeat(begins, sizes), np.repeat(sizes, sizes)
    slot = np.arange(n) - begin
    width = 1
    while n and width < sizes.max():
        run = slot // width
        other = (run ^ 1) * width
        live = np.flatnonzero(other < size)
        lo = (begin + other)[live]
        base = lo.copy()
        hi = np.minimum(lo + width, (begin + size)[live])
        mine, right = order[live], (run[live] & 1).astype(bool)
        while (busy := np.flatnonzero(lo < hi)).size:  # how many of the other run come before mine
            mid = (lo[busy] + hi[busy]) // 2
            x, y = starts[mine[busy]], starts[order[mid]]
            shared = common_extension(hashes, x, y, length)
            end = shared == length
            at = np.where(end, 0, shared)
            before = np.where(end, right[busy], raw[y + at] < raw[x + at])
            lo[busy] = np.where(before, mid + 1, lo[busy])
            hi[busy] = np.where(before, hi[busy], mid)
        place = np.arange(n)
        pair = (begin + (run // 2) * 2 * width)[live]
        place[live] = pair + (slot - run * width)[live] + (lo - base)
        merged = np.empty_like(order)
        merged[place] = order
        order, width = merged, 2 * width
    return order


def repeated(contexts: list[bytes], keys: np.ndarray, before: np.ndarray, counts: np.ndarray, length: int) -> list[np.ndarray]:
    """For each context, which of its windows stand in another context of its key at the same offset from the anchor.

    before: bytes of the context before its anchor. counts: windows of it.
    """
    raw = np.frombuffer(b"".join(contexts), np.uint8)
    hashes = Hashes(raw)
    begins = np.cumsum([0, *map(len, contexts)])[:-1]
    owner = np.repeat(np.arange(len(contexts)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(np.r_[0, counts[:-1]]), counts)
    starts = begins[owner] + nth
    _, key_no = np.unique(keys, return_inverse=True)
    group = key_no[owner] * (length + 1) + before[owner] - nth
    # Alone by hash: can't repeat.
    full = scrambled(hashes.of(starts, length) + scrambled(group.astype(np.uint64) * np.uint64(BASE)))
    _, at, n = np.unique(full, return_inverse=True, return_counts=True)
    chosen = np.flatnonzero(n[at] > 1)
    found = np.zeros(len(owner), bool)
    s, g = starts[chosen], group[chosen]
    order = suffix_sort(raw, hashes, s, g, length)
    a, b = order[:-1], order[1:]
    next_ = np.flatnonzero((g[a] == g[b]) & (hashes.of(s[a], length) == hashes.of(s[b], length)))
    spread = np.arange(length)
    collided = set()
    for i in range(0, len(next_), 4096):
        part = next_[i : i + 4096]
        x, y = a[part], b[part]
        same = (raw[s[x][:, None] + spread] == raw[s[y][:, None] + spread]).all(axis=1)
        found[chosen[x[same]]] = found[chosen[y[same]]] = True
        collided.update(g[x[~same]].tolist())
    for k in collided:  # a collision: by the bytes themselves
        of = np.flatnonzero(group == k)
        texts = [raw[p : p + length].tobytes() for p in starts[of]]
        seen = Counter(texts)
        found[of] = [seen[t] > 1 for t in texts]
    return np.split(found, np.cumsum(counts)[:-1])


CONTEXT = "key long, doc_id long, text_hash long, first long, before int, n int, single boolean, bytes binary, d1 long, d2 long"


def _contexts(length: int):
    """Bytes of the wanted contexts of each document; those of hot anchors in slices."""

    def run(batches):
        for b in batches:
            rows: list[tuple] = []
            for doc_id, text_hash, text, wanted in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), b["text"].cast(pa.binary()).to_pylist(), b["wanted"].to_pylist(), strict=True):
                data = text or b""
                for w in wanted:
                    pos, first, last = w["pos"], w["first"], w["last"]
                    if not w["hot"]:
                        rows.append((w["anchor"], doc_id, text_hash, first, pos - first, last - first + 1, w["single"], data[first : last + length], None, None))
                        continue
                    for q in range((pos - last) // SLICE, (pos - first) // SLICE + 1):
                        s, e = max(first, pos - q * SLICE - SLICE + 1), min(last, pos - q * SLICE)
                        core = data[pos - q * SLICE : pos - q * SLICE - SLICE + 1 + length]
                        key = xxhash.xxh3_64_intdigest(core, (w["anchor"] + q * BASE) & 0xFFFFFFFFFFFFFFFF)
                        part = data[s : e + length]
                        d = xxhash.xxh3_128_digest(part, pos - s)
                        rows.append((key - (1 << 63), doc_id, text_hash, s, pos - s, e - s + 1, w["single"], part, *(int.from_bytes(x, "big", signed=True) for x in (d[:8], d[8:]))))
            cols = list(zip(*rows, strict=True)) or [[]] * 10
            types = (pa.int64(),) * 4 + (pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["key", "doc_id", "text_hash", "first", "before", "n", "single", "bytes", "d1", "d2"])

    return run


def _sorted_repeats(length: int, block: int = 2 << 20):
    """Over rows in order of key: whole keys, blocks of about `block` bytes at a time."""

    def flush(rows, out):
        if len(rows) > 1:
            counts = np.array([r[5] for r in rows])
            flags = repeated([r[7] for r in rows], np.array([r[0] for r in rows]), np.array([r[4] for r in rows]), counts, length)
            for r, f in zip(rows, flags, strict=True):
                if r[6] and f.any():
                    edge = np.flatnonzero(np.diff(np.r_[0, f.view(np.int8), 0]))
                    out += [(r[1], r[2], r[3] + int(s), r[3] + int(e) - 1) for s, e in zip(edge[::2], edge[1::2], strict=True)]
        cols = list(zip(*out, strict=True)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "text_hash", "first", "last"])

    def run(batches):
        rows, out, size = [], [], 0
        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if rows and r[8] is not None and (r[0], *r[8:]) == (rows[-1][0], *rows[-1][8:]):  # equal slices: one is held
                    held = rows[-1]
                    out += [(x[1], x[2], x[3], x[3] + x[5] - 1) for x in (held, r) if x[6]]
                    rows[-1] = (*held[:6], False, *held[7:])
                    continue
                if size >= block and r[0] != rows[-1][0] or len(out) >= 100_000:
                    if size < block or r[0] == rows[-1][0]:  # only what is known already
                        yield flush([], out)
                        out = []
                    else:
                        yield flush(rows, out)
                        rows, out, size = [], [], 0
                rows.append(r)
                size += len(r[7])
        yield flush(rows, out)

    return run


def told_apart(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")


def repeat_spans(docs: DataFrame, length: int = 400, k: int = 64, hot: int = 4096) -> DataFrame:
    """(doc_id, text_hash, spans): per document the runs [first, last] of window starts that repeat, in any order. docs: told_apart()."""
    found = table(docs.mapInArrow(_anchors(length, k), "anchor long, c1 long, c2 long, doc_id long, text_hash long, pos long, first long, last long"))
    owner = F.min(F.struct("doc_id", "text_hash", "pos", "first", "last")).alias("o")
    kinds = found.groupBy("anchor", "c1", "c2").agg(F.count("*").alias("n"), owner)
    kinds = table(kinds)
    whole = found.join(kinds.where("n > 1").select("anchor", "c1", "c2"), ["anchor", "c1", "c2"], "left_semi").select("doc_id", "text_hash", "first", "last")
    several = kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).where("kinds > 1")
    wanted = kinds.join(several, "anchor").select("o.doc_id", "o.text_hash", F.struct("anchor", "o.pos", "o.first", "o.last", (F.col("n") == 1).alias("single"), (F.col("kinds") > hot).alias("hot")).alias("w"))
    rows = contexts(docs, wanted, length)
    ends = rows.repartition("key").sortWithinPartitions("key", "d1", "d2").mapInArrow(released(_sorted_repeats(length)), "doc_id long, text_hash long, first long, last long")
    return whole.unionByName(ends).groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def contexts(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    wanted = wanted.groupBy("doc_id", "text_hash").agg(F.collect_list("w").alias("wanted"))
    return with_rows(docs, wanted, "inner").select("doc_id", "text_hash", "text", "wanted").mapInArrow(_contexts(length), CONTEXT)


def _fingerprints(k: int, words: int):
    """Of each run of words - k + 1 word k-grams the one of least hash, once a document."""

    def run(batches):
        for b in batches:
            ids, found = [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                w = (text or "").split()
                if len(w) < words:
                    continue
                g = np.fromiter((xxhash.xxh3_64_intdigest(x) for x in w), np.uint64, len(w))
                up = powers(BASE, len(g))
                prefix = np.r_[np.zeros(1, np.uint64), np.cumsum(g * up)]
                g = scrambled((prefix[k:] - prefix[:-k]) * powers(INVERSE, len(g) - k + 1))
                f = np.unique(window_minimum(g, words - k + 1))
                found.append(f.view(np.int64))
                ids += [doc_id] * len(f)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(found) if found else [], pa.int64())], ["doc_id", "print"])

    return run


def shared_passages(docs: DataFrame, words: int = 51, k: int = 24) -> DataFrame:
    """(doc_id, text_hash, n_shared): documents that share a run of `words` words with a document of another doc_id, and how many of their fingerprints others have.

    A shared run of `words` is always found, one of fewer than k never; between, it may be. Rows of a doc_id count as one document. docs: told_apart().
    """
    prints = docs.select(F.coalesce("doc_id", F.lit(-1)).alias("doc_id"), "text").mapInArrow(released(_fingerprints(k, words)), "doc_id long, print long")
    shared = prints.groupBy("print").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("print")
    found = prints.join(shared, "print", "left_semi").groupBy("doc_id").agg(F.count("*").alias("n_shared")).withColumnRenamed("doc_id", "own")
    return docs.select("doc_id", "text_hash").join(found, F.coalesce("doc_id", F.lit(-1)) == F.col("own")).select("doc_id", "text_hash", "n_shared")


def removed(spans: list | None, length: int) -> list[tuple[int, int]]:
    """Maximal byte runs [start, end) that the windows of spans cover."""
    out: list[list[int]] = []
    for first, last in sorted((s["first"], s["last"]) for s in spans or ()):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], last + length)
        else:
            out.append([first, last + length])
    return [tuple(x) for x in out]


def kept_bytes(data: bytes, runs: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in runs for x in r), len(data)]
    return b"".join(data[s:e] for s, e in zip(edges[::2], edges[1::2], strict=True))


def with_rows(docs: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    """docs with the row of each. Both joins of a run deal out the same rows of docs by the same key, so Spark shuffles texts once and reuses that."""
    r = rows.withColumnsRenamed({"doc_id": "__id", "text_hash": "__hash"}).hint("shuffle_hash")
    return docs.join(r, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("text_hash") == F.col("__hash")), how).drop("__id", "__hash")


def substring_dedup(docs: DataFrame, length: int = 400, words: int = 51, **options) -> DataFrame:
    """(doc_id, n_bytes, removed, kept, shares_passage): removed is an array of maximal byte runs [start, end), kept the other bytes; shares_passage tells of a passage of `words` words in another document."""
    docs = told_apart(docs)
    names = ["doc_id", "n_bytes", "removed", "kept", "shares_passage"]

    def run(batches):
        for b in batches:
            n, runs, kept = [], [], []
            for text, s in zip(b["text"].cast(pa.binary()).to_pylist(), b["spans"].to_pylist(), strict=True):
                data = text or b""
                r = removed(s, length)
                n.append(len(data)), runs.append([list(x) for x in r]), kept.append(kept_bytes(data, r))
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(runs, pa.list_(pa.list_(pa.int64()))), pa.array(kept, pa.binary()), b["n_shared"].is_valid()], names)

    spans, shared = repeat_spans(docs, length, **options), shared_passages(docs, words)
    both = spans.withColumn("n_shared", F.lit(None).cast("long")).unionByName(shared.withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)))
    both = both.groupBy("doc_id", "text_hash").agg(F.first("spans", ignorenulls=True).alias("spans"), F.max("n_shared").alias("n_shared"))
    return with_rows(docs, both, "left").mapInArrow(released(run), "doc_id long, n_bytes long, removed array<array<long>>, kept binary, shares_passage boolean")


def digests(deduped: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, shares_passage)."""
    lost = F.aggregate("removed", F.lit(0).cast("long"), lambda s, r: s + r[1] - r[0])
    return deduped.select("doc_id", "n_bytes", lost.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "shares_passage")
