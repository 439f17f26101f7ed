"""Exact top-k search: an inverted index in shards, BM25 with block-max pruning.

1. A map pass turns documents into shards, one row each: sorted terms, and for each term
   its postings (document, frequency) in document order. A task deals its documents into
   groups of much the same frequent terms, and by number of terms within a group, so that
   neighbours are alike. No document is shuffled.
2. Queries are dealt into blocks of bounded size (terms_at_once distinct terms in all);
   only one block at a time is sent to the executors. The block's document frequencies
   are summed over all shards, so idf, the number of documents and their mean length are
   those of the whole table. Where shards are many, a few of them are searched first: each
   query's k-th score over them is a floor for all tasks.
3. A task keeps the k best of every query over the shards it reads. Each run of `run`
   neighbours is bounded: by the block maxima of the shard's most frequent terms, one product
   of matrices for many queries, plus those of the other lists. Runs whose bound reaches the
   k-th score so far are scored, the most promising first where a query has no k-th score yet;
   the others are skipped, which changes no result. Frequent terms are scored by a product in
   short floats, whose error is bounded; what may reach the k-th score is scored exactly.
4. The tasks' lists are merged by one window: exact, as scores use global statistics.

Scores are rounded to 6 digits, ties go to the smaller doc_id. A document matches if it
shares a term with the query; a query finds itself.

Cases: null and empty texts match nothing but count as documents. Null doc_ids are
searched and come last among ties, and are never queries. Repeated rows are found each;
as queries they are one. Other columns are not used.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muxlake.llm.common import FEW_ROWS, cut, table, texts

WORD = re.compile(r"\w+")
EPS = 2e-6
#: Runs of a block of the lists.
WIDE = 4


def terms(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct term hashes and their frequencies."""
    words = WORD.findall((text or "").lower())
    h = np.fromiter((xxhash.xxh3_64_intdigest(w.encode()) for w in words), np.uint64, len(words))
    return np.unique(h, return_counts=True)


INDEX = "n_docs long, n_words long, ids binary, known binary, lengths binary, terms binary, offsets binary, postings binary, freqs binary"


def shard(rows: list[tuple]) -> list:
    """One row of INDEX. rows: (doc_id, terms, frequencies)."""
    sizes = [len(t) for _, t, _ in rows]
    t = np.concatenate([t for _, t, _ in rows])
    d = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
    f = np.concatenate([f for _, _, f in rows]).astype(np.int32)
    order = np.argsort(t, kind="stable")
    unique, first = np.unique(t[order], return_index=True)
    lengths = np.array([int(f.sum()) for _, _, f in rows], np.int64)
    ids = np.array([i or 0 for i, _, _ in rows], np.int64)
    known = np.array([i is not None for i, _, _ in rows], np.uint8)
    arrays = ids, known, lengths, unique, np.r_[first, len(t)].astype(np.int64), d[order], f[order]
    return [len(rows), int(lengths.sum()), *(a.tobytes() for a in arrays)]


def grouping(rows: list[tuple], groups: int = 8, features: int = 512):
    """A function from terms to a group, of documents of much the same frequent terms (a language, a topic): k-means over some rows."""
    held, df = np.unique(np.concatenate([t for _, t, _ in rows]), return_counts=True)
    held = np.sort(held[np.argsort(-df, kind="stable")[:features]])

    def place(t):
        at = np.searchsorted(held, t)
        x = np.zeros(len(held) + 1, np.float32)
        x[at[held[np.minimum(at, len(held) - 1)] == t] if len(held) else []] = 1
        return x[:-1] / max(np.sqrt(x.sum()), 1)

    x = np.array([place(t) for _, t, _ in rows])
    centres = x[:1]
    while len(centres) < min(groups, len(rows)):  # the farthest from all so far
        centres = np.r_[centres, x[[np.argmin((x @ centres.T).max(axis=1))]]]
    for _ in range(8):
        of = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[of == i].sum(axis=0) for i in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    return lambda t: int(np.argmax(centres @ place(t)))


def _index(shard_docs: int, shard_postings: int):
    """Documents of a task by groups, which it finds over its first ones: a shard holds one group, or several in their order, each by number of terms."""

    def batch(rows):
        cols = list(zip(*[shard(rows)], strict=True))
        types = (pa.int64(), pa.int64(), *(pa.binary(),) * 7)
        return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], [x.split()[0] for x in INDEX.split(", ")])

    def rest(groups):
        rows, size = [], 0
        for r in (r for g in sorted(groups) for r in sorted(groups[g], key=lambda r: len(r[1]))):
            rows.append(r)
            size += len(r[1])
            if len(rows) >= shard_docs or size >= shard_postings:
                yield batch(rows)
                rows, size = [], 0
        if rows:
            yield batch(rows)

    def run(batches):
        found = ((doc_id, *terms(text)) for b in batches for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True))
        some = list(islice(found, min(shard_docs, 1024)))
        if not some:
            return
        group, groups, size = grouping(some), defaultdict(list), Counter()
        for r in chain(some, found):
            g = group(r[1])
            groups[g].append(r)
            size[g] += len(r[1])
            if len(groups[g]) >= shard_docs or size[g] >= shard_postings:
                yield from rest({g: groups.pop(g)})
                size[g] = 0
            elif sum(size.values()) >= 4 * shard_postings or sum(map(len, groups.values())) >= 4 * shard_docs:  # bounds what is held
                yield from rest(groups)
                groups.clear()
                size.clear()
        yield from rest(groups)

    return run


def _query_terms(batches):
    for b in batches:
        found = [terms(t) for t in texts(b["text"])]
        yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([t.tobytes() for t, _ in found], pa.binary()), pa.array([f.astype(np.int32).tobytes() for _, f in found], pa.binary()), pa.array([len(t) for t, _ in found], pa.int64())], ["query_id", "terms", "freqs", "n"])


def _frequencies(block_terms):
    """Documents of each of the block's terms in the shards of a task."""

    def run(batches):
        wanted = block_terms.value
        total = np.zeros(len(wanted), np.int64)
        for b in batches:
            for i in range(b.num_rows):
                t, n = np.frombuffer(b["terms"][i].as_buffer(), np.uint64), np.diff(np.frombuffer(b["offsets"][i].as_buffer(), np.int64))
                if len(t):
                    at = np.minimum(np.searchsorted(t, wanted), len(t) - 1)
                    total += np.where(t[at] == wanted, n[at], 0)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(total[held])], ["term", "df"])

    return run


class Best:
    """The k best of each query so far, a row a query: score down, then id up, null ids last; a score of -1 is an empty place. What is below least is left out."""

    def __init__(self, least: np.ndarray, k: int):
        n, self.least = len(least), least
        self.scores, self.ids, self.known = np.full((n, k), -1.0), np.zeros((n, k), np.int64), np.zeros((n, k), bool)

    def floor(self, rows) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.least[rows])

    def add(self, query: np.ndarray, scores: np.ndarray, ids: np.ndarray, known: np.ndarray) -> None:
        """Merges hits into them."""
        k = self.scores.shape[1]
        last = self.scores[query, -1]
        on = (scores >= self.least[query]) & (scores >= last)
        query, scores, ids, known, last = query[on], scores[on], ids[on], known[on], last[on]
        on = (scores > last) | (scores == last) & (~self.known[query, -1] | known & (ids < self.ids[query, -1]))
        query, scores, ids, known = query[on], scores[on], ids[on], known[on]
        rows, of_row = np.unique(query, return_inverse=True)
        of_row = np.r_[np.repeat(np.arange(len(rows)), k), of_row]
        scores, ids, known = np.r_[self.scores[rows].ravel(), scores], np.r_[self.ids[rows].ravel(), ids], np.r_[self.known[rows].ravel(), known]
        order = np.lexsort((ids, ~known, -scores, of_row))
        first = np.searchsorted(of_row[order], np.arange(len(rows)))
        order = order[first[:, None] + np.arange(k)]
        self.scores[rows], self.ids[rows], self.known[rows] = scores[order], ids[order], known[order]


def expand(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the ranges, and how many each range has."""
    n = end - start
    at = np.cumsum(n)
    return np.arange(at[-1] if len(at) else 0) + np.repeat(start - at + n, n), n


def parts(cost: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of neighbours whose cost is most at most, or of one."""
    total, out, low = np.r_[0, np.cumsum(cost)], [], 0
    while low < len(cost):
        high = max(low + 1, int(np.searchsorted(total, total[low] + most, "right")) - 1)
        out.append((low, high))
        low = high
    return out


class Shard:
    """One shard's lists and matrices; the bounds and scores of queries over it."""

    def __init__(self, row: dict, mean: float, k1: float, b: float, run: int, dense: int):
        self.ids, self.known = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["known"], np.uint8) > 0
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.offsets = offsets = np.frombuffer(row["offsets"], np.int64)
        self.doc, freq = np.frombuffer(row["postings"], np.int32), np.frombuffer(row["freqs"], np.int32)
        self.n, self.run = n, run = len(self.ids), run
        norm = k1 * (1 - b + b * np.frombuffer(row["lengths"], np.int64) / mean)
        self.impact = impact = freq * (k1 + 1) / (freq + norm[self.doc])
        # Entries: maximal postings of one term in WIDE runs of documents, with their greatest impact.
        of_run = self.doc // (WIDE * run)
        starts_term = np.zeros(len(self.doc) + 1, bool)
        starts_term[offsets] = True
        self.entry = entry = np.flatnonzero(starts_term[:-1] | np.r_[True, of_run[1:] != of_run[:-1]])
        self.greatest = np.maximum.reduceat(impact, entry) if len(entry) else impact
        self.entry_end, self.entry_run = np.r_[entry[1:], len(self.doc)], of_run[entry]
        self.term_entry = np.searchsorted(entry, offsets)
        # The most frequent terms as columns of a matrix: their part of all scores is one product a block of queries, in short floats,
        # whose sum of positive parts is off by less than a share of `slack`; the scores of what reaches the k best are exact.
        df = np.diff(offsets)
        full = np.argsort(-df, kind="stable")[:dense]
        full = full[df[full] * 24 >= n]
        self.column = np.full(len(self.terms), -1)
        self.column[full] = np.arange(len(full))
        self.matrix = np.zeros((n, len(full)))
        p, size = expand(offsets[full], offsets[full + 1])
        self.matrix[self.doc[p], np.repeat(np.arange(len(full)), size)] = impact[p]
        self.short = np.ascontiguousarray(self.matrix.T, np.float32)
        self.blocks = np.maximum.reduceat(self.short, np.arange(0, n, run), axis=1)
        self.slack = (len(full) + 8) * 2.0**-23

    def entries(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return expand(self.term_entry[term], self.term_entry[term + 1])

    def postings(self, term: np.ndarray, row: np.ndarray, weight: np.ndarray, now: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places, rows and weights of the lists' postings, without those of runs left out where these are many."""
        if now.mean() < 0.25:
            e, size = self.entries(term)
            row, weight = np.repeat(row, size), np.repeat(weight, size)
            pick = np.logical_or.reduceat(now, np.arange(0, now.shape[1], WIDE), axis=1)[row, self.entry_run[e]]
            e, row, weight = e[pick], row[pick], weight[pick]
            p, size = expand(self.entry[e], self.entry_end[e])
        else:
            p, size = expand(self.offsets[term], self.offsets[term + 1])
        return p, np.repeat(row, size), np.repeat(weight, size)

    def search(self, term: np.ndarray, weight: np.ndarray, offsets: np.ndarray, best: Best, start: int, first: int, at_once: int = 1 << 18) -> None:
        """Merges the hits of queries into best, from row start on. term, weight: those of one query after the other, as places in the shard."""
        m, runs = len(offsets) - 1, self.blocks.shape[1]
        wide = -(-runs // WIDE)
        query, column = np.repeat(np.arange(m), np.diff(offsets)), self.column[term]
        listed = column < 0
        weights = np.zeros((m, len(self.short)))
        weights[query[~listed], column[~listed]] = weight[~listed]
        short = weights.astype(np.float32)
        term, weight, query = term[listed], weight[listed], query[listed]
        at = np.searchsorted(query, np.arange(m + 1))
        cost = np.diff(np.r_[0, np.cumsum(self.offsets[term + 1] - self.offsets[term])][at])  # postings of each query
        bound = short @ self.blocks * (1 + self.slack)
        for low, high in parts(cost, at_once):
            own = slice(at[low], at[high])
            e, size = self.entries(term[own])
            held = np.bincount(np.repeat((query[own] - low) * wide, size) + self.entry_run[e], self.greatest[e] * np.repeat(weight[own], size), (high - low) * wide)
            bound[low:high] += np.repeat(held.reshape(-1, wide) * (1 + self.slack), WIDE, axis=1)[:, :runs]
        todo = bound > 0
        while True:
            floor = best.floor(slice(start, start + m))
            todo &= bound >= floor[:, None] - EPS
            left = np.flatnonzero(todo.any(axis=1))
            if not len(left):
                return
            now = todo[left]
            new = np.flatnonzero(floor[left] < 0)
            if first < runs:
                likely = np.where(now[new], bound[left[new]], -1)
                now[new] &= likely >= -np.partition(-likely, first - 1, axis=1)[:, [first - 1]]
            todo[left] &= ~now
            order = np.argmax(now, axis=1).argsort(kind="stable")  # those that look at much the same runs are taken together
            for i in range(0, len(left), 256):
                x = order[i : i + 256]
                self.score(left[x], now[x], short, weights, term, weight, at, cost, at_once, best, start)

    def score(self, rows, now, short, weights, term, weight, at, cost, at_once, best, start) -> None:
        """Scores the documents of the runs `now` of some queries."""
        seen = np.flatnonzero(now.any(axis=0))
        low_doc, high_doc, k = seen[0] * self.run, min((seen[-1] + 1) * self.run, self.n), best.scores.shape[1]
        n = high_doc - low_doc
        base = short[rows] @ self.short[:, low_doc:high_doc]
        base *= 1 + self.slack
        found = []
        for low, high in parts(cost[rows], at_once):
            own = rows[low:high]
            j, size = expand(at[own], at[own + 1])
            p, row, by = self.postings(term[j], np.repeat(np.arange(high - low), size), weight[j], now[low:high])
            row *= self.n
            row += self.doc[p]
            by *= self.impact[p]
            rest = np.bincount(row, by, (high - low) * self.n).reshape(-1, self.n)[:, low_doc:high_doc]
            most = base[low:high] + rest
            floor = best.floor(start + own) - EPS
            at_cell = np.flatnonzero((most >= np.maximum(floor, 1e-12)[:, None]).ravel())
            i, d = at_cell // n, at_cell % n
            looked = now[low + i, (d + low_doc) // self.run]
            i, d = i[looked], d[looked]
            many = np.flatnonzero(np.bincount(i, minlength=high - low) > 4 * k)
            if len(many):  # a floor from the documents of these runs
                held = np.where(np.repeat(now[low + many], self.run, axis=1)[:, low_doc:high_doc], most[many], 0)
                floor[many] = np.maximum(floor[many], np.partition(held, n - k, axis=1)[:, n - k] * (1 - 3 * self.slack) - EPS)
                reach = most[i, d] >= floor[i]
                i, d = i[reach], d[reach]
            scores = rest[i, d].astype(float)  # bincount counts in whole numbers where there are no postings
            d += low_doc
            for x in range(0, len(i), 2048):
                scores[x : x + 2048] += np.einsum("ij,ij->i", weights[own[i[x : x + 2048]]], self.matrix[d[x : x + 2048]])
            hit = scores >= 1e-12
            found.append((start + own[i[hit]], np.round(scores[hit], 6), self.ids[d[hit]], self.known[d[hit]]))
        best.add(*map(np.concatenate, zip(*found, strict=True)))


def search_shard(row: dict, queries: dict, best: Best, k1: float, b: float, run: int, first: int, dense: int = 1024, at_once: int = 2048) -> None:
    """Merges one shard's hits into best. queries: each one's terms (places in terms, one query after the other, with offsets) and weights."""
    if not len(row["terms"]):
        return
    shard = Shard(row, queries["mean"], k1, b, run, dense)
    here = np.minimum(np.searchsorted(shard.terms, queries["terms"]), len(shard.terms) - 1)
    here[shard.terms[here] != queries["terms"]] = -1
    for start in range(0, len(best.scores), at_once):
        offsets = queries["offsets"][start : start + at_once + 1]
        some = slice(offsets[0], offsets[-1])
        term = here[queries["places"][some]]
        on = term >= 0
        shard.search(term[on], queries["weights"][some][on], np.r_[0, np.cumsum(on)][offsets - offsets[0]], best, start, first)


def _search(sent, least, k: int, k1: float, b: float, run_docs: int, first: int):
    def run(batches):
        s = sent.value
        best = Best(least.value, k)
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].as_buffer() for c in ("ids", "known", "lengths", "terms", "offsets", "postings", "freqs")}
                search_shard(row, s, best, k1, b, run_docs, first)
        query, place = np.nonzero(best.scores >= 0)
        cols = s["ids"][query], pa.array(best.ids[query, place], mask=~best.known[query, place]), best.scores[query, place]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["query_id", "doc_id", "score"])

    return run


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75, shard_docs: int = 4096, shard_postings: int = 1_500_000, terms_at_once: int = 2_000_000, shards_a_task: int = 8, run: int = 64, first: int = 4) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of docs for each row of queries (doc_id, text)."""
    spark = docs.sparkSession
    index = table(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_index(shard_docs, shard_postings), INDEX), FEW_ROWS)  # rows of some 15 MB
    asked = queries.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    asked = table(asked.mapInArrow(_query_terms, "query_id long, terms binary, freqs binary, n long"))
    whole = index.agg(F.sum("n_docs").alias("n"), F.sum("n_words").alias("words"), F.count("*").alias("shards")).first()
    n, mean = whole.n or 0, (whole.words or 0) / (whole.n or 1) or 1.0
    blocks = -(-(asked.agg(F.sum("n").alias("n")).first().n or 0) // terms_at_once)
    # A task searches a number of shards, so tasks grow in number with the input, not in size; of few shards each core gets some.
    tasks = index.coalesce(max(-(-(whole.shards or 0) // shards_a_task), 2 * spark.sparkContext.defaultParallelism))
    # A few shards are searched before the others: the k-th score over them is a floor for all tasks, below which no result is.
    cores = spark.sparkContext.defaultParallelism
    some = table(index.sample(2 * cores / whole.shards, seed=6), FEW_ROWS) if blocks and whole.shards >= 32 * cores else None
    found = None
    w = Window.partitionBy("query_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    for block in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).collect()  # about terms_at_once terms
        pairs = [(np.frombuffer(r.terms, np.uint64), np.frombuffer(r.freqs, np.int32)) for r in rows]
        vocabulary = np.unique(np.concatenate([t for t, _ in pairs])) if pairs else np.zeros(0, np.uint64)
        sent_terms = spark.sparkContext.broadcast(vocabulary)
        df = np.zeros(len(vocabulary))
        for r in tasks.select("terms", "offsets").mapInArrow(_frequencies(sent_terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).collect():  # a row a term of the block
            df[r.term] = r.df
        idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
        places = np.concatenate([np.searchsorted(vocabulary, t) for t, _ in pairs]) if pairs else np.zeros(0, np.int64)
        weights = np.concatenate([f for _, f in pairs]) * idf[places] if pairs else np.zeros(0)
        sent = spark.sparkContext.broadcast({"ids": np.array([r.query_id for r in rows], np.int64), "offsets": np.r_[0, np.cumsum([len(t) for t, _ in pairs])].astype(np.int64), "places": places, "weights": weights, "terms": vocabulary, "mean": mean})
        hits, least = "query_id long, doc_id long, score double", np.full(len(rows), -1.0)
        if some is not None:
            none = spark.sparkContext.broadcast(least)
            kth = some.mapInArrow(_search(sent, none, k, k1, b, run, first), hits).withColumn("rank", F.row_number().over(w)).where(F.col("rank") == k)
            floors = {r.query_id: r.score - EPS for r in kth.select("query_id", "score").collect()}  # a row a query of the block
            least = np.array([floors.get(r.query_id, -1.0) for r in rows])
        hits = cut(tasks.mapInArrow(_search(sent, spark.sparkContext.broadcast(least), k, k1, b, run, first), hits))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        found = spark.createDataFrame([], "query_id long, doc_id long, score double")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")
