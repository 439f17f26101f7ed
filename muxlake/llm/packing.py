"""Best-fit packing by a grouping genetic algorithm on islands.

A document is its byte-level BPE ids, then id 0. Only documents of more than `cap` ids are
cut, into pieces of cap ids of which the first may be shorter. Pieces of cap ids are a
sequence each. The others are packed:

1. Pieces are dealt by hash into blocks of about block_items; a block is a packing
   problem of bounded size. Each block has `islands` populations, a Spark group each.
2. In a group, individuals are packings. Crossover injects whole, well-filled bins of one
   parent into the other, removes the bins that hold an injected piece, and places the
   displaced pieces by best fit. Fitness is few bins, then the sum of squared fills.
3. Between epochs each island's elite goes to the next island of its block, by a join.
4. Of each block the best island's packing is taken. Its poorly filled bins are dissolved
   and their pieces dealt to new blocks at the next level, so that blocks, too, exchange
   pieces; what is left open at last is a bin or so for each block of the last level.

Ids are those of the tokenizers file of the same vocabulary; they are made by tiktoken
from its rank file, which is four times faster (tests hold the two equal). Its pattern is
matched by backtracking, which overflows on long white space, so texts with such a run go
to tokenizers itself.

Cases: null and empty texts are one piece of the one id 0. Rows that share a doc_id, and
repeated rows, are packed each for itself. A null doc_id is kept. An empty table has no
pieces. Special tokens in texts are ordinary text. Other columns are not used.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muxlake.llm.common import cut, released, texts

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: White space that tiktoken isn't given.
LONG_BLANK = re.compile(r"\s{1000}")


def encoder(ranks_path: str, json_path: str):
    """text -> ids of the byte-level BPE, given as a rank file and as a tokenizers file."""
    import base64

    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    slow = []

    def encode(text: str):
        if not LONG_BLANK.search(text):
            return fast(text)
        if not slow:
            slow.append(Tokenizer.from_file(json_path))
            slow[0].encode_special_tokens = True
        return slow[0].encode(text, add_special_tokens=False).ids

    return encode


def cut_pieces(n: int, cap: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: the first takes what is over."""
    first = n % cap or cap
    return [(0, first), *((s, cap) for s in range(first, n, cap))] if n > cap else [(0, n)]


def _pieces(ranks_path: str | None, json_path: str | None, cap: int):
    def run(batches):
        import public_tokenizers

        encode = encoder(ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), json_path or public_tokenizers.path("byte_bpe_50k.json"))
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                ids = np.array([*encode(text or ""), 0], "<u4")
                for k, (start, n) in enumerate(cut_pieces(len(ids), cap)):
                    for column, v in zip(out, (doc_id, k, start, n, zlib.crc32(ids[start : start + n].tobytes())), strict=True):
                        column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def best_fit(sizes: list[int], free: list[int], cap: int) -> list[int]:
    """The bin of each size in turn: the one with least room that holds it, else a new one. free: room of the bins, changed in place."""
    at: list[list[int]] = [[] for _ in range(cap + 1)]
    mask = 0
    for k, room in enumerate(free):
        at[room].append(k)
        mask |= 1 << room
    out = []
    for size in sizes:
        fits = mask >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            k = at[room].pop()
            if not at[room]:
                mask ^= 1 << room
        else:
            k, room = len(free), cap
            free.append(cap)
        free[k] = room = room - size
        at[room].append(k)
        mask |= 1 << room
        out.append(k)
    return out


def fitness(sizes: np.ndarray, bins: np.ndarray, cap: int) -> tuple[int, float]:
    """Larger is better."""
    fill = np.bincount(bins, sizes)
    return -len(fill), float(((fill / cap) ** 2).sum())


def crossover(sizes: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int, rng) -> np.ndarray:
    """A child of a that has some of b's well-filled bins."""
    fill = np.bincount(b, sizes)
    good = (fill >= np.quantile(fill, 0.5)) & (rng.random(len(fill)) < 0.3)
    injected = good[b]
    hit = np.zeros(a.max() + 1, bool)
    hit[a[injected]] = True
    own = np.bincount(a, sizes)
    hit |= (own < 0.97 * cap) & (rng.random(len(hit)) < 0.8)  # the poorest bins of a are opened as well
    stay = ~hit[a] & ~injected
    child = np.full(len(sizes), -1)
    child[injected] = (np.cumsum(good) - 1)[b[injected]]
    n = int(good.sum())
    child[stay] = n + (np.cumsum(~hit) - 1)[a[stay]]
    rest = np.flatnonzero(child < 0)
    rest = rest[np.argsort(-sizes[rest] + rng.integers(0, 1 + cap // 64, len(rest)), kind="stable")]
    free = (cap - np.bincount(child[child >= 0], sizes[child >= 0], minlength=n + int((~hit).sum()))).astype(int).tolist()
    child[rest] = best_fit(sizes[rest].tolist(), free, cap)
    return np.unique(child, return_inverse=True)[1]


def evolve(sizes: np.ndarray, elites: list[np.ndarray], cap: int, population: int, generations: int, seed: int) -> np.ndarray:
    """The best packing (a bin for each size) after some generations."""
    rng = np.random.default_rng(seed)
    pop = [np.unique(x, return_inverse=True)[1] for x in elites]
    while len(pop) < population:
        order = np.argsort(-sizes + (rng.integers(0, 1 + cap // 16, len(sizes)) if pop else 0), kind="stable")
        bins = np.empty(len(sizes), int)
        bins[order] = best_fit(sizes[order].tolist(), [], cap)
        pop.append(bins)
    scored = sorted(((fitness(sizes, x, cap), i, x) for i, x in enumerate(pop)), key=lambda t: t[:2], reverse=True)
    least, made = -(-int(sizes.sum()) // cap), len(pop)
    for _ in range(generations):
        if -scored[0][0][0] <= least:
            break
        i, j = sorted(rng.choice(len(scored), 2, replace=False))
        child = crossover(sizes, scored[i][2], scored[j][2], cap, rng)
        made += 1
        scored = sorted([*scored, (fitness(sizes, child, cap), -made, child)], key=lambda t: t[:2], reverse=True)[:population]
    return scored[0][2]


def _island(cap: int, population: int, generations: int, epoch: int):
    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("item")  # rows come in any order
        sizes = g["length"].to_numpy()
        elites = [g[c].to_numpy() for c in ("bin", "guest") if c in g.column_names]
        bins = evolve(sizes, elites, cap, population, generations, hash((g["block"][0].as_py(), g["island"][0].as_py(), epoch)) & 0x7FFFFFFF)
        n, fill = fitness(sizes, bins, cap)
        rows = len(sizes)
        return pa.table([g["block"], g["island"], g["item"], g["length"], pa.array(bins.astype(np.int64)), pa.array(np.full(rows, -n)), pa.array(np.full(rows, fill))], ["block", "island", "item", "length", "bin", "n_bins", "fill"])

    return run


def pack_items(items: DataFrame, cap: int, level: int, block_items: int, islands: int, epochs: int, population: int, generations: int) -> DataFrame:
    """items (item, length), cut -> (item, length, level, block, bin, used)."""
    blocks = max(1, -(-items.count() // block_items))
    g = items.select(F.pmod(F.xxhash64(F.lit(level), "item"), F.lit(blocks)).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"), "item", "length")
    out = "block long, island int, item long, length long, bin long, n_bins long, fill double"
    for epoch in range(epochs):
        g = cut(g.groupBy("block", "island").applyInArrow(_island(cap, population, generations, epoch), out))
        if epoch + 1 < epochs and islands > 1:  # the elite goes to the next island
            guest = g.select("block", F.pmod(F.col("island") + 1, F.lit(islands)).alias("island"), "item", F.col("bin").alias("guest"))
            g = g.drop("n_bins", "fill").join(guest, ["block", "island", "item"])
    best = g.groupBy("block").agg(F.max_by("island", F.struct(-F.col("n_bins"), "fill", -F.col("island"))).alias("island"))
    g = g.join(best, ["block", "island"])
    return g.select("item", "length", F.lit(level).alias("level"), "block", "bin", F.sum("length").over(Window.partitionBy("block", "bin")).alias("used"))


def pack(docs: DataFrame, cap: int = 2048, ranks_path: str | None = None, json_path: str | None = None, block_items: int = 8192, islands: int = 2, epochs: int = 2, population: int = 6, generations: int = 12, levels: int = 3, spare: float = 0.01) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): a row a piece."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(_pieces(ranks_path, json_path, cap)), PIECES)
    pieces = cut(pieces).withColumn("item", F.monotonically_increasing_id())  # of cut rows, so it stays
    todo, done = cut(pieces.where(F.col("length") < cap).select("item", "length")), None
    for level in range(levels):
        packed = cut(pack_items(todo, cap, level, block_items, islands, epochs, population, generations))
        last = level == levels - 1 or packed.select("block").distinct().limit(2).count() < 2
        closed = packed if last else packed.where(F.col("used") >= cap * (1 - spare))
        closed = closed.select("item", (F.col("level").cast("long") * (1 << 58) + F.col("block") * (1 << 24) + F.col("bin")).alias("sequence_id"))
        done = closed if done is None else done.unionByName(closed)
        if last:
            break
        todo = cut(packed.where(F.col("used") < cap * (1 - spare)).select("item", "length"))
    out = pieces.join(done, "item", "left").withColumn("sequence_id", F.coalesce("sequence_id", -1 - F.col("item")))
    w = Window.partitionBy("sequence_id").orderBy("item").rowsBetween(Window.unboundedPreceding, 0)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", (F.sum("length").over(w) - F.col("length")).alias("offset"))
