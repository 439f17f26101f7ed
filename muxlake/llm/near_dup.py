"""Near-duplicate classes by Order MinHash, verified by banded alignment.

A document is its sequence of shingles of five words (lower-cased runs of word
characters), each labelled with its occurrence in the document. A sketch takes the
`order` labelled shingles of least hash under one seed and keeps them in text order, so
it is sensitive to order as edit similarity is. A document has `sketches` of them.
Two documents link if their banded alignment matches M shingles in order and
M / (n1 + n2 - M) >= similarity. Classes are the connected components of the links.

1. Exact copies (equal shingle sequences) collapse by a grouped aggregate; the smallest
   doc_id stands for them. A third of all rows may be copies of one text.
2. One map pass makes the sketches; only their 64-bit hashes are shuffled to buckets.
3. In each bucket a hub is chosen, the member of least seeded priority, by an aggregate
   and a join back, so no bucket is gathered anywhere and no pairs within it are emitted.
   A group of near copies has mostly one hub in all its buckets, which are distinct pairs
   only once. Shingles of both sides meet in one salted join by hub; a first bound by the
   common labelled shingles, then the alignment, accept a pair.
4. Components come from min-label steps over the links, cut to the shared folder.
5. Buckets that still hold several classes are settled exactly. Of each document in one,
   the rarest labelled shingles are taken, so many that two documents of the wanted
   similarity have one in common (a prefix filter; the order is by counts in 2**bits
   bins). The place of a shared shingle in both orders bounds what the two can have in
   common (a positional filter), so unrelated documents that share a passage don't meet.
   Documents that may be similar are compared to hubs, the most central document first and
   more hubs each time, until no shingle has documents of two classes that were not
   compared. There is no limit on rounds or partners.

At similarity s a pair shares one sketch with probability about s**order, so 24 sketches
of order 3 miss 3e-8 of pairs at 0.8; the tests hold the links against brute force.
Shingles are 32-bit hashes; a chance equality moves a similarity by 1/n at odds of 1e-4.

Cases: null texts and texts without a word are not compared: a class each, unless they
share a doc_id. Texts of one to four words are one shingle of all their words. Rows that
share a doc_id join one class. A null doc_id has a null class and is compared to none.
"""

from __future__ import annotations

import math
import operator
import re
from bisect import bisect_left
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import free_name, join_small, released, table, texts

WORD = re.compile(r"\w+")
K1, K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Ids or pairs of ids up to which they are broadcast.
IDS = 200_000


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * K1
    return (x ^ (x >> np.uint64(29))) * K2


def shingles(text: str | None, k: int = 5) -> np.ndarray:
    """32-bit hashes of all windows of k words; of all words if there are fewer."""
    words = [w.encode() for w in WORD.findall((text or "").lower())]
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(k, len(h))
    out = h[: len(h) - n + 1].copy() if n else h
    for i in range(1, n):
        out = mixed(out) + h[i : i + len(out)]
    return (mixed(out) >> np.uint64(32)).astype(np.uint32)


def labelled(s: np.ndarray) -> np.ndarray:
    """64-bit values of (shingle, occurrence)."""
    order = np.argsort(s, kind="stable")
    same = s[order]
    first = np.r_[True, same[1:] != same[:-1]] if len(s) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    occurrence = np.empty(len(s), np.uint64)
    occurrence[order] = np.arange(len(s)) - np.repeat(starts, np.diff(np.r_[starts, len(s)]))
    return (s.astype(np.uint64) << np.uint64(32)) | (occurrence & np.uint64(0xFFFFFFFF))


def sketch(s: np.ndarray, sketches: int, order: int, seed: int = 1) -> np.ndarray:
    """One hash for each sketch: the `order` least labelled shingles, in text order."""
    x = labelled(s)
    base = mixed(x)
    seeds = mixed(np.arange(seed * 1000, seed * 1000 + sketches, dtype=np.uint64) * K1 + K2)
    order_n, out = min(order, len(x)), []
    step = max(1, 400_000 // max(1, len(x)))
    for i in range(0, sketches, step):
        h = (base[None, :] ^ seeds[i : i + step, None]) * K2
        h ^= h >> np.uint64(32)
        at = np.empty((len(h), order_n), np.int64)
        rows = np.arange(len(h))
        for j in range(order_n):
            at[:, j] = h.argmin(axis=1)
            h[rows, at[:, j]] = np.uint64(0xFFFFFFFFFFFFFFFF)
        at.sort(axis=1)
        key = seeds[i : i + step].copy()
        for j in range(order_n):
            key = mixed(key) + base[at[:, j]]
        out.append(mixed(key))
    return np.concatenate(out).view(np.int64)


def aligned(a: np.ndarray, b: np.ndarray, similarity: float, x: np.ndarray | None = None, y: np.ndarray | None = None) -> float:
    """Similarity by the longest common subsequence within the band that the threshold leaves; 0 if it can't be reached. x, y: labelled(a), labelled(b)."""
    if not len(a) or not len(b):
        return 0.0
    least = similarity / (1 + similarity) * (len(a) + len(b)) - 1e-9  # M that is needed
    if min(len(a), len(b)) < least:
        return 0.0
    if len(a) == len(b) and (a == b).all():
        return 1.0
    x, y = labelled(a) if x is None else x, labelled(b) if y is None else y
    common, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    if len(common) < least:
        return 0.0
    band = math.floor(len(a) + len(b) - 2 * least)
    of = lambda m: m / (len(a) + len(b) - m)
    near = np.abs(i - j) <= band
    i, j = i[near], j[near]
    m = increasing(j[np.argsort(i)])
    if m < least:  # repeats may align better across labels
        m = banded_lcs(a, b, band)
    return of(m) if m >= least else 0.0


def banded_lcs(a: np.ndarray, b: np.ndarray, band: int, often: int = 256) -> int:
    """Longest common subsequence of matches at most `band` places apart, by bits: a whole number holds the band around a's place, a zero bit for each place of b where the length grows.

    A value's places in b within the band are set as bits when a has the value. Only for values that stand more than `often` times, of which there are few, are the bits kept and moved on, so memory is a small multiple of the band.
    """
    width = 2 * band + 1
    full, top = (1 << width) - 1, 1 << (width - 1)
    order = np.argsort(b, kind="stable")
    places = order.astype(np.int64)
    first, last = np.searchsorted(b[order], a, "left"), np.searchsorted(b[order], a, "right")
    moved: dict[int, tuple[int, int, int]] = {}  # first place: bits, the place of a they are for, places that were set
    state, done = full, 0
    for p, (i, j) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
        if p:  # the band moves on by a place
            done += 1 - (state & 1)
            state = (state >> 1) | top
        if i == j:
            continue
        low = p - band
        if j - i > often:
            hit, at, n = moved.get(i, (0, 0, i))
            hit >>= p - at
            to = i + int(np.searchsorted(places[i:j], p + band, "right"))
            if to > n:
                hit |= _at(places[n:to], low, width)
            moved[i] = hit, p, to
        else:
            near = places[i:j]
            if j - i > 1:
                near = near[np.searchsorted(near, low) : np.searchsorted(near, p + band, "right")]
            elif not low <= near[0] <= p + band:
                continue
            hit = _at(near, low, width)
        hit &= state
        if hit:
            state = ((state + hit) | (state - hit)) & full
    return done + width - state.bit_count()


def _at(places: np.ndarray, low: int, width: int) -> int:
    """A number with the bits of places from low on; those below are left out."""
    if len(places) < 8:
        out = 0
        for j in places.tolist():
            if j >= low:
                out |= 1 << (j - low)
        return out
    bits = np.zeros(width, np.uint8)
    bits[places[places >= low] - low] = 1
    return int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")


def increasing(x: np.ndarray) -> int:
    """Length of the longest increasing subsequence."""
    tails: list[int] = []
    for v in x.tolist():
        if not tails or v > tails[-1]:
            tails.append(v)
        else:
            tails[bisect_left(tails, v)] = v
    return len(tails)


def _sketches(k: int, sketches: int, order: int):
    def run(batches):
        for b in batches:
            prints, heads, sizes, keys = [], [], [], []
            for text in texts(b["text"]):
                s = shingles(text, k)
                d = xxhash.xxh3_128_digest(s.tobytes())
                prints.append(int.from_bytes(d[:8], "big", signed=True))
                heads.append(int.from_bytes(d[8:], "big", signed=True))
                sizes.append(len(s))
                keys.append(sketch(s, sketches, order) if len(s) else [])
            yield pa.RecordBatch.from_arrays([b["doc_id"], *(pa.array(x, pa.int64()) for x in (prints, heads, sizes)), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "p1", "p2", "n", "keys"])

    return run


def _sequences(k: int):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([shingles(x, k).tobytes() for x in texts(b["text"])], pa.binary())], ["id", "seq"])

    return run


def _verify(similarity: float):
    def run(batches):
        hub = hub_seq = hub_labels = None
        for b in batches:
            found = []
            for x, y in zip(b["seq"].to_pylist(), b["hub_seq"].to_pylist(), strict=True):
                if y is not hub and y != hub:  # rows of a hub mostly come together
                    hub, hub_seq = y, np.frombuffer(y, np.uint32)
                    hub_labels = labelled(hub_seq)
                found.append(aligned(np.frombuffer(x, np.uint32), hub_seq, similarity, y=hub_labels))
            keep = [i for i, x in enumerate(found) if x >= similarity - 1e-9]
            yield pa.RecordBatch.from_arrays([b["id"].take(pa.array(keep, pa.int64())), b["hub"].take(pa.array(keep, pa.int64())), pa.array([found[i] for i in keep], pa.float64())], ["a", "b", "similarity"])

    return run


def verified(pairs: DataFrame, seqs: DataFrame, similarity: float, hot: int = 256) -> DataFrame:
    """Of pairs (id, hub), written, those whose alignment is similar enough. A hub of many members is salted; its row goes to each salt."""
    small = pairs.limit(IDS + 1).count() <= IDS
    mark = F.broadcast if small else lambda df: df
    salts = pairs.groupBy("hub").agg(F.ceil(F.count("*") / hot).cast("int").alias("salts"))
    members = pairs.join(mark(salts), "hub").select("id", "hub", F.pmod(F.xxhash64("id"), F.col("salts")).cast("int").alias("salt"))
    hubs = salts.select(F.col("hub").alias("id"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    hubs = seqs.join(mark(hubs), "id").select(F.col("id").alias("hub"), "salt", F.col("seq").alias("hub_seq"))
    both = seqs.join(mark(members), "id").join(hubs, ["hub", "salt"])
    return both.select("id", "hub", "seq", "hub_seq").mapInArrow(released(_verify(similarity)), "a long, b long, similarity double")


def components(links: DataFrame, start: DataFrame | None = None) -> DataFrame:
    """(id, label): the least id of each component, for ids that links (a, b) touch. Min labels travel along links, and through the labels themselves, until none changes."""
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if start is not None:
        both = both.unionByName(start.select(F.col("id").alias("a"), F.col("label").alias("b"))).unionByName(start.select(F.col("label").alias("a"), F.col("id").alias("b")))
    edges = table(both.distinct())
    labels = table(edges.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("label")))
    while True:
        heard = edges.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy(F.col("a").alias("id")).agg(F.min("label").alias("heard"))
        new = labels.join(heard, "id").select("id", "label", F.least("label", "heard").alias("new"))
        root = labels.select(F.col("id").alias("new"), F.col("label").alias("root"))  # labels are ids with labels of their own
        new = table(new.join(root, "new", "left").select("id", "label", F.least("new", "root").alias("new")))
        changed = not new.where("new <> label").isEmpty()
        labels = new.select("id", F.col("new").alias("label"))
        if not changed:
            return labels


def tokens_of(seq: bytes) -> np.ndarray:
    return mixed(labelled(np.frombuffer(seq, np.uint32)))


def _bins(bits: int):
    """How often labelled shingles fall in each bin of their hash."""

    def run(batches):
        counts = np.zeros(1 << bits, np.int64)
        for b in batches:
            for seq in b["seq"].to_pylist():
                at, n = np.unique(tokens_of(seq) >> np.uint64(64 - bits), return_counts=True)
                counts[at.astype(np.int64)] += n
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at])], ["bin", "n"])

    return run


#: Words of a parity map, of 64 bits each.
MAP = 4
MAPS = [f"map{i}" for i in range(MAP)]


def parity_map(tokens: np.ndarray) -> np.ndarray:
    """64 * MAP bits: of each, whether an odd number of labelled shingles falls on it. Two maps differ in no more bits than the shingles that only one of both documents has."""
    odd = np.bincount((tokens & np.uint64(64 * MAP - 1)).astype(np.int64), minlength=64 * MAP) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _prefixes(sent, bits: int, similarity: float):
    """The rarest labelled shingles of each document, as many as may be missing in a similar one and one more.

    map is the parity map of all of them. most is the greatest size of a document that may still be similar if this shingle, at its place in the order by rarity, is the first that both have; central is the mean log count.
    """

    def run(batches):
        counts = sent.value
        for b in batches:
            ids, sizes, most, central, tokens, maps = [], [], [], [], [], []
            for doc_id, seq in zip(b["id"].to_pylist(), b["seq"].to_pylist(), strict=True):
                t = tokens_of(seq)
                c = counts[(t >> np.uint64(64 - bits)).astype(np.int64)]
                first = np.lexsort((t, c))[: len(t) - math.ceil(similarity * len(t) - 1e-9) + 1]
                place = np.flatnonzero(c[first] > 1)
                tokens.append(t[first[place]].view(np.int64))
                most += np.floor((len(t) - place) * ((1 + similarity) / similarity) - len(t) + 1e-6).astype(int).tolist()
                ids += [doc_id] * len(place)
                sizes += [len(t)] * len(place)
                central += [float(np.log(c).mean())] * len(place)
                maps.append(np.repeat(parity_map(t)[None, :], len(place), axis=0))
            tokens = np.concatenate(tokens) if tokens else np.zeros(0, np.int64)
            maps = np.concatenate(maps) if maps else np.zeros((0, MAP), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(most, pa.int64()), pa.array(central, pa.float64()), pa.array(tokens), *(pa.array(maps[:, i].copy()) for i in range(MAP))], ["id", "n", "most", "central", "token", *MAPS])

    return run


def with_key(rows: DataFrame, small: DataFrame, *key: str) -> DataFrame:
    """rows (id, key, ...) joined with the one row that small has of their key. A hot key's rows are split by the skew handling of adaptive execution, however many there are, as only one row meets them."""
    return rows.join(small, [*key])


def mixed_classes(rows: DataFrame, labels: DataFrame, *key: str) -> DataFrame:
    """rows (id, key) with the label of each, where a key has several labels."""
    at = rows.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    split = at.groupBy(*key).agg((F.min("label") < F.max("label")).alias("split")).where("split").drop("split")
    return with_key(at, split, *key)


def comparable(tokens: DataFrame, labels: DataFrame) -> DataFrame:
    """tokens with labels, without the rows that can't be similar to a row of their token in another class: by the sizes that both allow."""
    at = tokens.join(labels, "id", "left").withColumn("label", F.coalesce("label", "id"))
    span = at.groupBy("token").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), F.min("n").alias("least_n"), F.max("most").alias("greatest")).where("l0 < l1")
    return with_key(at, span, "token").where("least_n <= most AND n <= greatest").drop("l0", "l1", "least_n", "greatest")


def settled(flat: DataFrame, labels: DataFrame, seqs: DataFrame, similarity: float, tried: DataFrame | None = None, bits: int = 20) -> DataFrame:
    """labels, after all documents of buckets (i, key) with several classes were compared where they may be similar. tried: pairs (id, hub) that were compared before."""
    spark = flat.sparkSession
    left = table(mixed_classes(flat, labels, "i", "key").select("id").distinct())
    if left.isEmpty():
        return labels
    own = table(join_small(seqs, left, "id", "inner", rows=IDS))
    found = own.mapInArrow(_bins(bits), "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).toArrow()  # at most 2**bits rows
    counts = np.zeros(1 << bits, np.int64)
    counts[found["bin"].to_numpy()] = found["n"].to_numpy()
    tokens = table(own.mapInArrow(_prefixes(spark.sparkContext.broadcast(counts), bits, similarity), "id long, n long, most long, central double, token long, " + ", ".join(f"{c} long" for c in MAPS)))
    many = 1
    while True:
        at = table(comparable(tokens, labels))
        if at.isEmpty():
            return labels
        best = F.min(F.struct(-F.col("central"), F.xxhash64("id"), F.col("id").alias("hub"), F.col("label").alias("hub_label"), F.col("n").alias("hub_n"), F.col("most").alias("hub_most"), *(F.col(c).alias(f"hub_{c}") for c in MAPS)))
        hubs = table(at.groupBy("token", F.pmod(F.xxhash64("id"), F.lit(many)).alias("lot")).agg(best.alias("h")).select("token", *(f"h.hub{c}" for c in ("", "_label", "_n", "_most", *(f"_{c}" for c in MAPS)))))
        at = at.join(hubs.select("token", F.col("hub").alias("id"), F.lit(True).alias("spent")), ["token", "id"], "left")
        alike = (F.col("label") != F.col("hub_label")) & (F.col("n") <= F.col("hub_most")) & (F.col("hub_n") <= F.col("most"))
        apart = reduce(operator.add, [F.bit_count(F.col(c).bitwiseXOR(F.col(f"hub_{c}"))) for c in MAPS])
        alike = alike & (apart <= (1 - similarity) / (1 + similarity) * (F.col("n") + F.col("hub_n")) + 1e-6)
        pairs = with_key(at, hubs, "token").where(alike & (F.col("spent").isNull() | (F.col("id") < F.col("hub")))).select("id", "hub").distinct()
        if tried is not None:
            both = tried.unionByName(tried.select(F.col("hub").alias("id"), F.col("id").alias("hub")))
            pairs = pairs.join(both, ["id", "hub"], "left_anti")
        pairs = table(pairs)
        tokens = table(at.where("spent IS NULL").select("id", "n", "most", "central", "token", *MAPS))  # hubs were compared to all others
        if not pairs.isEmpty():
            labels = components(table(verified(pairs, seqs, similarity)), labels)
            tried = pairs if tried is None else table(tried.unionByName(pairs))
        many *= 32


def near_duplicates(docs: DataFrame, k: int = 5, similarity: float = 0.8, sketches: int = 24, order: int = 3) -> DataFrame:
    """(doc_id, class_id): a row for each row of docs; class_id is the least doc_id of the class."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    prints = table(docs.mapInArrow(released(_sketches(k, sketches, order)), "doc_id long, p1 long, p2 long, n long, keys array<long>"))
    known = prints.where("doc_id IS NOT NULL AND n > 0")
    reps = known.groupBy("p1", "p2", "n").agg(F.min("doc_id").alias("rep"))
    member = table(known.select("doc_id", "p1", "p2", "n").join(reps, ["p1", "p2", "n"]).select("doc_id", "rep", F.xxhash64("p1", "p2", "n").alias("print")).distinct())
    # A doc_id with several texts joins their classes.
    ties = member.where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    manifold = member.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("a"))
    ties = table(ties.join(manifold, "a"))
    keyed = known.join(member.where("doc_id = rep").select("doc_id", "print"), "doc_id").where(F.xxhash64("p1", "p2", "n") == F.col("print"))
    keyed = keyed.select(F.col("doc_id").alias("id"), "keys").distinct()
    flat = keyed.select("id", F.posexplode("keys").alias("i", "key"))
    crowded = flat.groupBy("i", "key").agg((F.min("id") < F.max("id")).alias("many")).where("many").drop("many")
    flat = table(with_key(flat, crowded, "i", "key"))
    inside = table(flat.select(F.col("id").alias("doc_id")).distinct())
    seqs = table(join_small(docs, inside, "doc_id", "inner", rows=IDS).mapInArrow(released(_sequences(k)), "id long, seq binary"))
    labels = docs.sparkSession.createDataFrame([], "id long, label long") if ties.isEmpty() else components(ties)
    at = flat.join(labels, "id", "left").select("id", "i", "key", F.coalesce("label", "id").alias("label"))
    first = F.min(F.struct(F.xxhash64("id").alias("p"), F.col("id").alias("hub"), F.col("label").alias("hub_label")))
    hubs = at.groupBy("i", "key").agg(first.alias("h")).select("i", "key", "h.hub", "h.hub_label")
    pairs = table(with_key(at, hubs, "i", "key").where("label <> hub_label").select("id", "hub").distinct())
    if not pairs.isEmpty():
        labels = components(table(verified(pairs, seqs, similarity)), labels)
    labels = settled(flat, labels, seqs, similarity, pairs)
    least = member.join(labels, member["rep"] == labels["id"], "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("class_id"))
    return prints.select("doc_id").join(least, "doc_id", "left").select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"))


def representatives(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents whose class has a smaller doc_id; rows of null doc_id stay."""
    name = free_name(docs, "gone_id")
    gone = near_duplicates(docs, **options).where("doc_id <> class_id").select(F.col("doc_id").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), docs["doc_id"].cast("long") == F.col(name), "left_anti")
