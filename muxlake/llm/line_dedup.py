"""Line dedup: range-partitioned line hashes, streamed in order, give compressed keep bitmaps.

Each document is a row with doc_id and text. A line's key is the line without ASCII
blanks at its ends and with A-Z lowered. A key of min_chars code points or more that
min_docs documents hold loses all its lines but those of the largest doc_id holding it.

1. A map-only pass hashes the lines to 128 bits; no text is shuffled here.
2. The hashes are range-partitioned by (hash, document) and sorted by (hash, document
   descending, position), so a hot line is spread over partitions; the result is
   checkpointed so that both passes below see the same partitions.
3. Runs that touch a partition's edge are summed first: two rows a partition, all that
   the driver gets. A key's documents never straddle two partitions, so counts add up.
4. A streaming pass over each partition emits the lines to drop; a run holds back at
   most the lines of its second document.
5. Dropped positions are gathered by document and packed as zlib-compressed bits.

Cases: null or empty text is one empty line, which is never dropped (min_chars >= 1).
A null doc_id counts as one document below every other. Rows that share a doc_id are one
document; each row keeps or loses its own lines. Repeated rows are treated alike.
Columns beyond doc_id and text pass through, whatever their names. A document's lines of one key
are streamed in one task, as its bitmap is one row.
"""

from __future__ import annotations

import zlib
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import BLANKS, cut, free_name, released, texts

LINES = "h1 long, h2 long, doc_id long, text_hash long, pos int"


def line_keys(text: str | None) -> list[tuple[int, str]]:
    """(code points, key) of every line."""
    stripped = [x.strip(BLANKS) for x in (text or "").split("\n")]
    return [(len(x), x) for x in stripped]


def _hash_lines(min_chars: int):
    def run(batches):
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text_hash, text in zip(b["doc_id"].to_pylist(), b["text_hash"].to_pylist(), texts(b["text"]), strict=True):
                for pos, (n, key) in enumerate(line_keys(text)):
                    if n >= min_chars:
                        h = xxhash.xxh3_128_digest(key.encode().lower())  # bytes.lower() is A-Z only
                        out[0].append(int.from_bytes(h[:8], "big", signed=True))
                        out[1].append(int.from_bytes(h[8:], "big", signed=True))
                        out[2].append(doc_id)
                        out[3].append(text_hash)
                        out[4].append(pos)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(),) * 4 + (pa.int32(),), strict=True)], ["h1", "h2", "doc_id", "text_hash", "pos"])

    return run


def _runs(batches):
    """(key, rows of that key) in order; rows are streamed."""
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    return groupby(rows, key=lambda r: (r[0], r[1]))


def _edges(batches):
    """Documents and largest document of the first and the last run of a partition."""
    first = last = None
    for key, rows in _runs(batches):
        n, top = 0, None
        for doc, _ in groupby(rows, key=lambda r: r[2]):
            top = doc if n == 0 else top
            n += 1
        last = (*key, n, top)
        first = first or last
    found = [] if first is None else [first] if first == last else [first, last]
    cols = list(zip(*found, strict=True)) or [[]] * 4
    yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["h1", "h2", "n", "top"])


def _drops(edges: dict, min_docs: int):
    def chosen(batches):
        for key, rows in _runs(batches):
            if key in edges:
                n, top = edges[key]
                if n >= min_docs:
                    yield from (r for r in rows if r[2] != top)
                continue
            held, n = [], 0  # the largest document comes first
            for _, own in groupby(rows, key=lambda r: r[2]):
                n += 1
                if n == 1:
                    if min_docs <= 1:
                        continue
                elif n < min_docs:
                    held.extend(own)
                else:
                    yield from held
                    held = []
                    yield from own

    def run(batches):
        out: list = []
        for r in chosen(batches):
            out.append(r[2:])
            if len(out) >= 50_000:
                yield _batch(out)
                out = []
        yield _batch(out)

    return run


def _batch(rows):
    cols = list(zip(*rows, strict=True)) or [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32()), strict=True)], ["doc_id", "text_hash", "pos"])


def pack(dropped) -> bytes:
    """Positions to drop as compressed keep bits; later lines are kept."""
    bits = np.ones(max(dropped, default=-1) + 1, np.uint8)
    bits[np.asarray(dropped, np.int64)] = 0
    return zlib.compress(np.packbits(bits).tobytes() + bytes([(-len(bits)) % 8]))


def unpack(bitmap: bytes) -> np.ndarray:
    raw = zlib.decompress(bitmap)
    bits = np.unpackbits(np.frombuffer(raw[:-1], np.uint8))
    return bits[: len(bits) - raw[-1]].astype(bool)


def _pack_batches(batches):
    for b in batches:
        dropped = b["dropped"].to_pylist()
        yield pa.RecordBatch.from_arrays([b["doc_id"], b["text_hash"], pa.array([len(x) for x in dropped], pa.int64()), pa.array(map(pack, dropped), pa.binary())], ["doc_id", "text_hash", "n_dropped", "keep_bitmap"])


def keep_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) of each document that loses lines; all others keep theirs."""
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(released(_hash_lines(min_chars)), LINES)
    down = F.col("doc_id").desc_nulls_last()
    lines = cut(lines.repartitionByRange("h1", "h2", down).sortWithinPartitions("h1", "h2", down, "text_hash", "pos"))
    edges: dict = {}
    for r in lines.mapInArrow(_edges, "h1 long, h2 long, n long, top long").collect():  # two rows a partition
        n, top = edges.get((r.h1, r.h2), (0, None))
        edges[r.h1, r.h2] = (n + r.n, max((x for x in (top, r.top) if x is not None), default=None))
    drops = lines.mapInArrow(_drops(edges, min_docs), "doc_id long, text_hash long, pos int")
    by_doc = drops.groupBy("doc_id", "text_hash").agg(F.collect_set("pos").alias("dropped"))
    return by_doc.mapInArrow(_pack_batches, "doc_id long, text_hash long, n_dropped long, keep_bitmap binary")


def kept_text(text: str | None, bitmap: bytes | None) -> str | None:
    if bitmap is None:
        return text
    lines, keep = (text or "").split("\n"), unpack(bitmap)
    return "\n".join(x for i, x in enumerate(lines) if i >= len(keep) or keep[i])


def with_bitmaps(docs: DataFrame, bitmaps: DataFrame, name: str) -> DataFrame:
    """docs with the bitmap as column name; null where all lines stay."""
    own, hashed = free_name(docs, "bitmap_id"), free_name(docs, "bitmap_hash")
    b = bitmaps.select(F.col("doc_id").alias(own), F.col("text_hash").alias(hashed), F.col("keep_bitmap").alias(name)).hint("shuffle_hash")
    return docs.join(b, docs["doc_id"].eqNullSafe(F.col(own)) & (F.xxhash64(docs["text"]) == F.col(hashed)), "left").select(*[docs[c] for c in docs.columns], name)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """docs with the kept lines as text; other columns as they are."""
    name = free_name(docs, "keep_bitmap")
    at, names = docs.columns.index("text"), docs.columns

    def run(batches):
        for b in batches:
            cols = list(b.columns)
            cols[at] = pa.array(map(kept_text, texts(cols[at]), cols[-1].to_pylist()), b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(cols[:-1], names)

    return with_bitmaps(docs, bitmaps, name).mapInArrow(released(run), docs.schema)


def line_digests(docs: DataFrame, bitmaps: DataFrame) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256) of every document."""
    import hashlib

    def run(batches):
        for b in batches:
            n, dropped, sha = [], [], []
            for text, bitmap in zip(texts(b["text"]), b["keep_bitmap"].to_pylist(), strict=True):
                n.append((text or "").count("\n") + 1)
                dropped.append(0 if bitmap is None else int((~unpack(bitmap)).sum()))
                sha.append(hashlib.sha256((kept_text(text, bitmap) or "").encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(n, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_lines", "n_dropped", "kept_sha256"])

    return with_bitmaps(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), bitmaps, "keep_bitmap").mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")
