"""Quality rules: base counts, then a hashed n-gram log-likelihood ratio.

Words are the runs of non-blank bytes (ASCII blanks). The n-grams of orders 1 to n are
hashed to 2**bits features. One pass over all documents counts the features of the raw
corpus and of the trusted target: the documents whose ids are in a bounded sample of the
trusted ids (trusted_limit, smallest hash first; they are what the target side is fitted
on, as text is not shuffled for it). Two smoothed multinomials give each feature a log
ratio target to raw; a document's score is the mean over its n-grams, so length plays no
part. The threshold is the trusted documents' mean score less z standard deviations, from
all of them, those beyond the sample too; each that is in the target is scored with its
own n-grams taken out of it (else it would score above equally clean documents that
aren't in it). Every document is held against that one number.

Cases: null text has no words. Documents of fewer than min_words words, or with more than
max_repeat of them in repeated windows, fail the base rules and are not kept. Without any
trusted document all log ratios are 0 and the base rules alone decide. Null ids are never
trusted. Repeated rows count as often as they stand. Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import BLANKS, cut, texts

SYMBOLS = "#*$%&|<>"
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    words = (text or "").encode().split()  # bytes.split() is by ASCII blanks only
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of n words."""
    out = h[: max(0, len(h) - n + 1)].copy()
    for i in range(1, n):
        out ^= out >> np.uint64(29)
        out *= MIX
        out += h[i : i + len(out)]
    return out


def features(h: np.ndarray, n: int, bits: int) -> np.ndarray:
    return np.concatenate([((grams(h, k) * MIX) >> np.uint64(64 - bits)).astype(np.int64) for k in range(1, n + 1)])


def base_counts(text: str | None, h: np.ndarray) -> list[int]:
    """The columns of BASE."""
    text = text or ""
    lines = [x for x in text.split("\n") if x.strip(BLANKS)]
    repeated = np.zeros(len(h), bool)
    if len(h) >= 3:
        _, at, n = np.unique(grams(h, 3), return_inverse=True, return_counts=True)
        twice = n[at] > 1
        for i in range(3):
            repeated[i : i + len(twice)] |= twice
    return [len(h), len(text) - sum(map(text.count, BLANKS)), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), int(repeated.sum())]


def _count(trusted: frozenset, n: int, bits: int):
    def run(batches):
        raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                f = np.bincount(features(word_hashes(text), n, bits), minlength=1 << bits) if text and len(text) > 1 << bits else None
                if f is None:
                    at = features(word_hashes(text), n, bits)
                    np.add.at(raw, at, 1)
                    if doc_id in trusted:
                        np.add.at(target, at, 1)
                else:
                    raw += f
                    if doc_id in trusted:
                        target += f
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(raw[at]), pa.array(target[at])], ["feature", "raw", "target"])

    return run


def log_share(x: np.ndarray, total: float, size: int, alpha: float) -> np.ndarray:
    return np.log((x + alpha) / (total + alpha * size))


def fit(docs: DataFrame, trusted: DataFrame, n: int = 2, bits: int = 16, trusted_limit: int = 20_000) -> tuple[np.ndarray, np.ndarray, frozenset]:
    """Counts of the 2**bits features in the raw corpus and in the target, and the trusted ids used. trusted: a column doc_id."""
    ids = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    ids = frozenset(r.doc_id for r in ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(trusted_limit).collect())
    counted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_count(ids, n, bits), "feature long, raw long, target long")
    raw, target = np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)
    for r in counted.groupBy("feature").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():  # at most 2**bits rows
        raw[r.feature], target[r.feature] = r.raw, r.target
    return raw, target, ids


def mean_ratio(f: np.ndarray, own: bool, raw: np.ndarray, target: np.ndarray, totals: tuple[int, int], alpha: float) -> float:
    """Mean log ratio of a document's features; if own, its counts are taken out of the target's. Totals are given, as the arrays are whole."""
    if not len(f) or not totals[1]:
        return 0.0
    x, at, k = np.unique(f, return_inverse=True, return_counts=True)
    t = target[x] - k if own else target[x]
    if own and totals[1] == len(f):
        return 0.0
    ratio = log_share(t, totals[1] - own * len(f), len(raw), alpha) - log_share(raw[x], totals[0], len(raw), alpha)
    return float((ratio * k).sum() / len(f))


def _score(raw: np.ndarray, target: np.ndarray, ids: frozenset, n: int, alpha: float):
    bits, totals = int(len(raw)).bit_length() - 1, (int(raw.sum()), int(target.sum()))

    def run(batches):
        for b in batches:
            base, llr, out = [], [], []
            for doc_id, text in zip(b["doc_id"].to_pylist(), texts(b["text"]), strict=True):
                h = word_hashes(text)
                f = features(h, n, bits)
                base.append(base_counts(text, h))
                llr.append(mean_ratio(f, False, raw, target, totals, alpha))
                out.append(mean_ratio(f, True, raw, target, totals, alpha) if doc_id in ids else None)
            cols = np.array(base, np.int64).reshape(len(base), len(BASE)).T
            yield pa.RecordBatch.from_arrays([b["doc_id"], *map(pa.array, np.ascontiguousarray(cols)), pa.array(llr, pa.float64()), pa.array(out, pa.float64())], ["doc_id", *BASE, "llr", "left_out"])

    return run


def quality(docs: DataFrame, trusted: DataFrame, n: int = 2, bits: int = 16, trusted_limit: int = 20_000, z: float = 3.0, alpha: float = 0.5, min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """doc_id, the columns of BASE, base_failed, kept, llr and threshold of every document."""
    raw, target, ids = fit(docs, trusted, n, bits, trusted_limit)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_score(raw, target, ids, n, alpha), "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", llr double, left_out double")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"))
    scored = cut(scored.withColumn("base_failed", failed))
    all_trusted = trusted.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct()
    of_trusted = scored.where("NOT base_failed").select("doc_id", F.coalesce("left_out", "llr").alias("own")).join(all_trusted, "doc_id", "left_semi")
    r = of_trusted.agg(F.avg("own").alias("mean"), F.stddev_pop("own").alias("sd")).first()
    threshold = -1e9 if r["mean"] is None else round(r["mean"] - z * r["sd"], 9)
    return scored.select("doc_id", *BASE, "base_failed", (~F.col("base_failed") & (F.round("llr", 9) >= threshold)).alias("kept"), "llr", F.lit(threshold).alias("threshold"))
