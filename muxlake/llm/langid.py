"""Language ID: a bidirectional gated recurrent network over bytes, in numpy.

Each byte is embedded straight into the gates of a forward and of a backward recurrent
layer; both states give a softmax over the languages at every position. A document's
probabilities are the mean over all its positions; text is cut into windows of `window`
bytes only to run many side by side, and every window of the whole text counts.
Gates are hard sigmoids, the candidate is a tanh with the reset gate after the matrix.

The network is trained by backpropagation through time on the driver, on a bounded sample:
at most per_lang documents a language (least hash first) and `pieces` windows of each, cut
out on the executors. Inference is a map over all documents.

Cases: null texts and texts without a letter (category L; number signs are none) are `und` with score 0; so is every document
if there is nothing to learn from. Null labels are not learned. Documents of null doc_id
are predicted, never learned from, and not held out. Repeated rows are predicted alike.
Other columns are not used.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import free_name, released, texts

LETTER = regex.compile(r"\p{L}")
UND = "und"


class Net:
    """e: (2, 3H, 256) bytes to gates, u: (2, 3H, H) states to gates, v: (L, 2H) and c: (L, 1) states to languages."""

    def __init__(self, langs: list[str], hidden: int, seed: int):
        rng, n = np.random.default_rng(seed), len(langs)
        self.langs, self.h = langs, hidden
        f = lambda s, *shape: rng.normal(0, s, shape).astype(np.float32)
        self.w = {"e": f(0.3, 2, 3 * hidden, 256), "u": f(0.3, 2, 3 * hidden, hidden), "v": f(0.3, n, 2 * hidden), "c": np.zeros((n, 1), np.float32)}
        self.w["e"][:, :hidden] += 0.3  # gates begin by keeping the state

    def step(self, d: int, x: np.ndarray, h: np.ndarray, g: np.ndarray, a: np.ndarray) -> None:
        """One byte of each window: h is changed in place; g and a are room for the gates."""
        n = self.h
        np.take(self.w["e"][d], x, axis=1, out=g, mode="clip")
        np.matmul(self.w["u"][d], h, out=a)
        gates = a[: 2 * n]
        gates += g[: 2 * n]
        gates += 0.5
        np.clip(gates, 0, 1, out=gates)
        c = a[2 * n :]
        c *= a[n : 2 * n]
        c += g[2 * n :]
        np.tanh(c, out=c)
        h -= c
        h *= a[:n]
        h += c

    def positions(self, x: np.ndarray):
        """x: (T, B) bytes. Gives (t, (L, B) probabilities) for t from the last to the first."""
        t, b = x.shape
        x, n = x.astype(np.intp), self.h
        g, a, h = (np.empty((3 * n, b), np.float32), np.empty((3 * n, b), np.float32), np.zeros((n, b), np.float32))
        ahead = np.empty((t, len(self.langs), b), np.float32)
        for i in range(t):
            self.step(0, x[i], h, g, a)
            np.matmul(self.w["v"][:, :n], h, out=ahead[i])
        h[:] = 0
        for i in range(t - 1, -1, -1):
            self.step(1, x[i], h, g, a)
            p = ahead[i]
            p += self.w["v"][:, n:] @ h
            p += self.w["c"]
            np.clip(p, -30, 30, out=p)
            np.exp(p, out=p)
            p /= p.sum(axis=0)
            yield i, p

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
        """Loss and gradients by backpropagation through time; y: (B,) language of each window. Byte 0 is padding."""
        (t, b), n, w = x.shape, self.h, self.w
        x = x.astype(np.intp)
        seen = []
        states = np.zeros((2, t, n, b), np.float32)
        for d in range(2):
            h, steps = np.zeros((n, b), np.float32), []
            for i in range(t) if d == 0 else range(t - 1, -1, -1):
                g = w["e"][d][:, x[i]]
                a = w["u"][d] @ h
                z, r = np.clip(a[:n] + g[:n] + 0.5, 0, 1), np.clip(a[n : 2 * n] + g[n : 2 * n] + 0.5, 0, 1)
                c = np.tanh(g[2 * n :] + r * a[2 * n :])
                steps.append((i, h, z, r, c, a[2 * n :]))
                h = c + z * (h - c)
                states[d, i] = h
            seen.append(steps)
        both = states.transpose(0, 2, 1, 3).reshape(2 * n, t * b)
        p = w["v"] @ both + w["c"]
        p = np.exp(p - p.max(axis=0))
        p /= p.sum(axis=0)
        mask = (x > 0).astype(np.float32).ravel()
        at = np.tile(y, t), np.arange(t * b)
        loss = float(-(np.log(p[at] + 1e-9) * mask).sum() / mask.sum())
        p[at] -= 1
        p *= mask / mask.sum()
        out = {"v": p @ both.T, "c": p.sum(axis=1, keepdims=True), "e": np.zeros_like(w["e"]), "u": np.zeros_like(w["u"])}
        down = (w["v"].T @ p).reshape(2, n, t, b)
        one = np.eye(256, dtype=np.float32)[x.ravel()]
        for d in range(2):
            dh, dg = np.zeros((n, b), np.float32), np.empty((3 * n, t, b), np.float32)
            for i, h, z, r, c, ac in reversed(seen[d]):
                dh = dh + down[d, :, i]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * ((z > 0) & (z < 1))
                dr = dc * ac * ((r > 0) & (r < 1))
                da = np.concatenate([dz, dr, dc * r])
                dg[:, i] = np.concatenate([dz, dr, dc])
                out["u"][d] += da @ h.T
                dh = dh * z + w["u"][d].T @ da
            out["e"][d] = dg.reshape(3 * n, t * b) @ one
        return loss, out


def train(samples: list[tuple[str, bytes]], hidden: int = 8, window: int = 64, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Net:
    """samples: (language, bytes). Batches have as many windows of each language."""
    langs = sorted({k for k, _ in samples})
    net, rng = Net(langs, hidden, seed), np.random.default_rng(seed)
    if not langs:
        return net
    of = [[x for k, x in samples if k == lang and x] or [b" "] for lang in langs]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, steps + 1):
        y = np.resize(rng.permutation(len(langs)), batch)
        x = np.zeros((window, batch), np.uint8)
        for i, k in enumerate(y):
            s = of[k][rng.integers(len(of[k]))]
            at = rng.integers(max(1, len(s) - window + 1))
            s = np.frombuffer(s[at : at + (window if rng.random() < 0.8 else int(rng.integers(8, window)))], np.uint8)
            x[: len(s), i] = s
        _, g = net.gradients(x, y)
        lr = rate * (1 - step / (steps + 1))
        for k, v in g.items():  # Adam
            first[k] += 0.1 * (v - first[k])
            second[k] += 0.01 * (v * v - second[k])
            net.w[k] -= (lr * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def label_positions(net: Net, text: str, window: int = 128) -> np.ndarray:
    """Index of the language of every byte of text."""
    raw = np.frombuffer(text.encode(), np.uint8)
    x = np.zeros(-(-len(raw) // window) * window, np.uint8)
    x[: len(raw)] = raw
    x = x.reshape(-1, window).T
    out = np.empty(x.shape, np.int64)
    for i, p in net.positions(x):
        out[i] = p.argmax(axis=0)
    return out.T.ravel()[: len(raw)]


def pooled(net: Net, raws: list[bytes], window: int = 128, at_once: int = 2048) -> np.ndarray:
    """(documents, L): mean probabilities over all bytes of each."""
    n = np.array([len(r) for r in raws])
    windows = -(-n // window)
    out = np.zeros((int(windows.sum()), len(net.langs)), np.float32)
    owner = np.repeat(np.arange(len(raws)), windows)
    joined = b"".join(r + bytes(-len(r) % window) for r in raws)
    x = np.frombuffer(joined, np.uint8).reshape(-1, window)
    for at in range(0, len(x), at_once):
        part = np.ascontiguousarray(x[at : at + at_once].T)
        total = np.zeros((len(net.langs), part.shape[1]), np.float32)
        for i, p in net.positions(part):
            p *= part[i] > 0
            total += p
        out[at : at + at_once] = total.T
    sums = np.zeros((len(raws), len(net.langs)))
    np.add.at(sums, owner, out)
    return sums / np.maximum(n, 1)[:, None]


def _cut_samples(window: int, pieces: int):
    def run(batches):
        for b in batches:
            lang, rank, text = [], [], []
            for k, h, t in zip(b["lang"].to_pylist(), b["rank"].to_pylist(), texts(b["text"]), strict=True):
                raw = t.encode()
                for i in range(min(pieces, 1 + len(raw) // window)):
                    at = xxhash.xxh3_64_intdigest(f"{h} {i}".encode()) % max(1, len(raw) - window + 1)
                    lang.append(k), rank.append(h), text.append(raw[at : at + window])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(rank, pa.int64()), pa.array(text, pa.binary())], ["lang", "rank", "text"])

    return run


def fit(docs: DataFrame, per_lang: int = 400, pieces: int = 4, window: int = 128, **options) -> Net:
    """Learns from text and lang of the documents that are not held out."""
    usable = docs.where("crc32(CAST(doc_id AS STRING)) % 4 <> 2 AND lang IS NOT NULL AND text IS NOT NULL").where(F.col("text").rlike(r"\p{L}"))
    counts = {r.lang: r.n for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return train([], **options)
    rank = F.xxhash64("doc_id", "text")
    limit = F.lit(None)
    for lang, n in sorted(counts.items()):
        limit = F.when(F.col("lang") == lang, F.lit(min(1.0, 2 * per_lang / n))).otherwise(limit)
    few = usable.select("lang", rank.alias("rank"), "text").where((F.shiftrightunsigned("rank", 11) * F.lit(2.0**-53)) < limit)
    rows = few.mapInArrow(_cut_samples(window, pieces), "lang string, rank long, text binary").collect()  # about 2 * per_lang * pieces windows a language
    found: dict[str, dict[int, list]] = {}
    for r in rows:
        found.setdefault(r.lang, {}).setdefault(r.rank, []).append(bytes(r.text))
    samples = [(lang, x) for lang in sorted(found) for h in sorted(found[lang], key=lambda v: v & (2**64 - 1))[:per_lang] for x in sorted(found[lang][h])]
    return train(samples, **options)


def languages(docs: DataFrame, net: Net, names: list[str], batch_bytes: int = 2 << 20) -> DataFrame:
    """docs with two more columns, called names: the predicted language and its score."""

    def run(batches):
        for b in batches:
            whole = texts(b["text"])
            preds, scores = [UND] * len(whole), [0.0] * len(whole)
            usable = [i for i, t in enumerate(whole) if t and net.langs and LETTER.search(t)]
            at = 0
            while at < len(usable):
                part, size = [], 0
                while at < len(usable) and (not part or size < batch_bytes):
                    part.append(usable[at])
                    size += len(whole[usable[at]])
                    at += 1
                for i, p in zip(part, pooled(net, [whole[i].encode() for i in part]), strict=True):
                    k = int(p.argmax())
                    preds[i], scores[i] = net.langs[k], min(1.0, float(p[k]))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(preds, pa.string()), pa.array(scores, pa.float64())], [*b.schema.names, *names])

    from pyspark.sql.types import DoubleType, StringType, StructType

    schema = StructType([*docs.schema.fields]).add(names[0], StringType()).add(names[1], DoubleType())
    return docs.mapInArrow(released(run), schema)


def identify(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document, by a network fitted on those not held out."""
    net = fit(docs, **options)
    out = languages(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), net, ["lang_pred", "score"])
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def identified(docs: DataFrame, least: float = 0.0, **options) -> DataFrame:
    """docs without those whose language can't be told or whose score is under `least`."""
    names = [free_name(docs, "lang_pred"), free_name(docs, "score")]
    out = languages(docs, fit(docs, **options), names)
    return out.where((F.col(names[0]) != UND) & (F.col(names[1]) >= least)).select(*docs.columns)
