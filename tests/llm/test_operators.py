"""Each operator against a brute-force version, on rows with every odd case."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

BLANKS = "\t\n\x0b\x0c\r "


def of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Language ID


def test_language_id(docs, empty, corpus):
    from muxlake.llm.langid import fit, identify, label_positions

    out = of(identify(docs, steps=120))
    assert len(out) == len(corpus)
    for r in out:
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    signs = docs.sparkSession.createDataFrame([(1, "½ ² ① Ⅷ", "en")], "doc_id long, text string, lang string")
    assert [r["lang_pred"] for r in of(identify(signs, steps=1))] == ["und"]
    by = {r["doc_id"]: r["lang_pred"] for r in out}
    assert by[152] == by[153] == by[154] == by[155] == "und"
    long_ = [(i, lang) for i, text, lang, *_ in corpus if i is not None and i < 120 and len(text) > 100]
    assert np.mean([by[i] == lang for i, lang in long_]) > 0.95
    assert of(identify(empty)) == []
    net = fit(docs, steps=120)
    assert len(label_positions(net, "the other thing" * 20)) == 300


def test_gradients_agree_with_differences():
    from muxlake.llm.langid import Net

    rng = np.random.default_rng(0)
    net = Net(["a", "b", "c"], 4, 1)
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    x, y = rng.integers(1, 20, (6, 5)), rng.integers(0, 3, 5)
    loss, g = net.gradients(x, y)
    for k in net.w:
        for _ in range(6):
            at = tuple(rng.integers(0, s) for s in net.w[k].shape)
            if k == "e":
                at = (at[0], at[1], int(x[0, 0]))
            old = net.w[k][at]
            net.w[k][at] = old + 1e-6
            more = net.gradients(x, y)[0]
            net.w[k][at] = old - 1e-6
            less = net.gradients(x, y)[0]
            net.w[k][at] = old
            assert g[k][at] == pytest.approx((more - less) / 2e-6, abs=3e-3)


# Token counts


def test_token_counts_equal_the_unigram_tokenizer(docs, empty, corpus):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from muxlake.llm.token_counts import Counter as Parts
    from muxlake.llm.token_counts import token_counts, vocabulary

    t = Tokenizer(models.Unigram(vocabulary(), 0, byte_fallback=True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement="▁", prepend_scheme="always", split=False)
    count = lambda x: len(t.encode(x, add_special_tokens=False).ids) if x else 0
    got = Counter((r["doc_id"], r["n_tokens"]) for r in of(token_counts(docs)))
    assert got == Counter((i, count(text)) for i, text, *_ in corpus)
    parts = Parts(vocabulary(), most=50)
    for x in [" ", "  a  b ", "▁x", "héé 梦\n\nß€", "\t\t", "a▁▁b", "日本語　x", "a" * 40, "ﬀ𝔘🙂 x"]:
        assert parts.tokens(x) == count(x), x
    assert of(token_counts(empty)) == []


# Mixing


def water(sizes, weights):
    """Targets by repeated capping."""
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        w = sum(weights[s] for s in sizes if s not in capped)
        out = {s: 3 * sizes[s] if s in capped else left * weights[s] / w for s in sizes}
        over = {s for s in sizes if s not in capped and out[s] > 3 * sizes[s] + 1e-9}
        if not over:
            return out
        capped |= over


def words(text):
    import re

    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_mix_targets_and_sizes(docs, empty, corpus):
    from muxlake.llm.mixing import mix, repeat_rows

    out = of(mix(docs))
    assert list(mix(docs).columns)[: len(docs.columns)] == docs.columns
    name = mix(docs).columns[-1]
    assert name == "_mix"  # the table has a column mix
    sizes = Counter()
    for _, text, _, source, *_ in corpus:
        sizes[source] += len(words(text))
    order = sorted((s for s in sizes if s is not None)) + [None]
    target = water(sizes, {s: 1 + k % 3 for k, s in enumerate(order)})
    taken = Counter()
    for r in out:
        m = r[name]
        assert m["size"] == len(words(r["text"])) and m["source_size"] == sizes[r["source"]]
        assert m["target"] == pytest.approx(target[r["source"]])
        assert 0 <= m["taken"] <= 3 * m["size"]
        taken[r["source"]] += m["taken"]
    for s in sizes:
        assert abs(taken[s] - target[s]) <= 0.05 * target[s] + 25 or s == "s0"  # s0 has one document of most of its words
    again = sorted((str(r["doc_id"]), r["text"] or "", r[name]["copies"]) for r in of(mix(docs.repartition(3))))
    assert again == sorted((str(r["doc_id"]), r["text"] or "", r[name]["copies"]) for r in out)
    assert of(mix(empty)) == []
    assert repeat_rows(docs).columns == docs.columns
    assert repeat_rows(docs).count() == sum(r[name]["copies"] for r in out)


def test_mix_caps_small_sources(spark):
    from muxlake.llm.mixing import targets

    sizes = {"a": 100, "b": 1, "c": 2, None: 50}
    t = {r.source: r.target for r in targets(spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")).collect()}
    want = water(sizes, {"a": 1, "b": 2, "c": 3, None: 1})
    assert t == {k: pytest.approx(v) for k, v in want.items()}


def test_propensity_changes_inclusion(spark):
    from muxlake.llm.mixing import mix

    rows = [(i, "w " * 10, "a" if i < 400 else "b", 4.0 if i % 2 else 1.0) for i in range(800)]
    out = of(mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lean double"), propensity="lean"))
    got = lambda odd: sum(r["mix"]["taken"] for r in out if r["source"] == "a" and r["doc_id"] % 2 == odd)
    assert got(1) > 1.4 * got(0)


def test_repeated_rows_are_sampled_each_for_itself(spark):
    from muxlake.llm.mixing import mix

    rows = [(7, "w " * 10, "a")] * 600 + [(10 + i, "w " * (3 + i % 17), "b") for i in range(200)]
    out = of(mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)))
    assert len(out) == 800
    for source in "ab":
        taken = sum(r["mix"]["taken"] for r in out if r["source"] == source)
        target = next(r["mix"]["target"] for r in out if r["source"] == source)
        assert abs(taken - target) <= 10


def test_targets_hold_where_copies_stop(spark):
    from muxlake.llm.mixing import mix

    rows = [(i, "w " * 10, "a" if i < 400 else "b", 8.0 if i % 5 == 0 else 0.2) for i in range(800)]
    out = of(mix(spark.createDataFrame(rows, "doc_id long, text string, source string, lean double"), propensity="lean"))
    for source in "ab":
        taken = sum(r["mix"]["taken"] for r in out if r["source"] == source)
        assert abs(taken - next(r["mix"]["target"] for r in out if r["source"] == source)) <= 10
    assert max(r["mix"]["copies"] for r in out) == 3


# Substring dedup


def brute_substrings(texts, length):
    seen = Counter(t[s : s + length] for t in texts for s in range(len(t) - length + 1))
    out = []
    for t in texts:
        hit = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                hit[s : s + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if hit[i] and (i == 0 or not hit[i - 1]))
        out.append((len(t), sum(hit), spans, hashlib.sha256(bytes(c for c, x in zip(t, hit) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("length,k,hot", [(400, 64, 4096), (60, 16, 4096), (60, 16, 2)])
def test_substring_dedup(docs, empty, corpus, length, k, hot):
    from muxlake.llm.suffix_dedup import digests, substring_dedup

    out = substring_dedup(docs, length, k=k, hot=hot)
    got = Counter(tuple(r.values())[:5] for r in of(digests(out)))
    want = brute_substrings([(t or "").encode() for _, t, *_ in corpus], length)
    assert got == Counter((i, *w) for (i, *_), w in zip(corpus, want))
    assert of(substring_dedup(empty)) == []


def test_suffix_sort_and_collisions():
    from muxlake.llm.suffix_dedup import Hashes, common_extension, suffix_sort

    rng = np.random.default_rng(1)
    raw = rng.integers(97, 99, 600).astype(np.uint8)
    starts, group, length = np.arange(0, 560), np.arange(560) % 3, 40
    order = suffix_sort(raw, Hashes(raw), starts, group, length)
    key = lambda i: (group[i], raw[starts[i] : starts[i] + length].tobytes())
    assert [key(i) for i in order] == sorted(key(i) for i in range(560))
    n = common_extension(Hashes(raw), starts[:-1], starts[1:], length)
    for i in range(559):
        a, b = raw[i : i + length], raw[i + 1 : i + 1 + length]
        assert n[i] == (np.r_[a != b, True].argmax())


def test_a_hash_collision_is_found(monkeypatch):
    from muxlake.llm import suffix_dedup as s

    monkeypatch.setattr(s, "VALUES", np.ones(256, np.uint64))  # every string of a length has one hash
    a, b = bytes(range(40)), bytes(range(1, 41))
    flags = s.repeated([a, b, a], np.zeros(3, np.int64), np.array([5, 5, 5]), np.array([1, 1, 1]), 40)
    assert [f.tolist() for f in flags] == [[True], [False], [True]]


# Line dedup


def brute_lines(corpus, min_chars=20, min_docs=3):
    holders = defaultdict(set)
    key = lambda x: (lambda s: s.translate({c: c + 32 for c in range(65, 91)}))(x.strip(BLANKS))
    for i, text, *_ in corpus:
        for x in (text or "").split("\n"):
            if len(key(x)) >= min_chars:
                holders[key(x)].add(-1 if i is None else i)
    out = []
    for i, text, *_ in corpus:
        lines = (text or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or (-1 if i is None else i) == max(holders[key(x)])]
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return Counter(out)


def test_line_dedup(docs, empty, corpus):
    from muxlake.llm.line_dedup import apply_bitmaps, keep_bitmaps, line_digests

    bitmaps = keep_bitmaps(docs)
    assert Counter(tuple(r.values()) for r in of(line_digests(docs, bitmaps))) == brute_lines(corpus)
    assert apply_bitmaps(docs, bitmaps).columns == docs.columns
    assert of(line_digests(empty, keep_bitmaps(empty))) == []


def test_bitmaps_round_trip():
    from muxlake.llm.line_dedup import pack, unpack

    for dropped in ([0], [3, 7, 8], list(range(1, 1000, 7))):
        keep = unpack(pack(dropped))
        assert np.flatnonzero(~keep).tolist() == dropped


def test_a_hot_line_over_many_partitions(spark):
    from muxlake.llm.line_dedup import keep_bitmaps, line_digests

    rows = [(i, f"the very same line of text here\nown line number {i} of this document") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(16)
    out = {r["doc_id"]: r["n_dropped"] for r in of(line_digests(docs, keep_bitmaps(docs)))}
    assert sum(out.values()) == 2999 and out[2999] == 0


# Search


def test_top_k_is_exact(docs, empty, corpus):
    from muxlake.llm.bm25 import WORD, top_k

    tf = [(i, Counter(WORD.findall((t or "").lower()))) for i, t, *_ in corpus]
    n, mean = len(tf), sum(sum(c.values()) for _, c in tf) / len(tf)
    df = Counter(w for _, c in tf for w in c)
    want = {}
    for q, c in tf:
        if q is None or q % 7:
            continue
        scores = []
        for d, e in tf:
            s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * e[w] * 2.2 / (e[w] + 1.2 * (0.25 + 0.75 * sum(e.values()) / mean)) for w, f in c.items() if w in e)
            if s > 0:
                scores.append((-round(s, 6), d is None, d))
        want[q] = sorted(scores)[:5]
    got = defaultdict(list)
    for r in of(top_k(docs, docs.where("doc_id % 7 = 0"), k=5, shard_docs=16, run=4, first=1, terms_at_once=500).orderBy("query_id", "rank")):
        got[r["query_id"]].append((-r["score"], r["doc_id"] is None, r["doc_id"]))
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        assert [x[0] for x in got[q]] == pytest.approx([x[0] for x in want[q]], abs=2e-6)
        assert [x[2] for x in got[q]] == [x[2] for x in want[q]]
    assert of(top_k(empty, docs.where("doc_id = 0"))) == [] == of(top_k(docs, empty))


def two_languages(n):
    """Documents of words of one of two languages, some of them copies."""
    rng = np.random.default_rng(5)
    chance = 1 / np.arange(1, 301)
    texts = [" ".join(f"{'ab'[i % 2]}{w}" for w in rng.choice(300, 5 + i % 40, p=chance / chance.sum())) for i in range(n)]
    return [(i, texts[i % 11] if i % 5 == 0 else texts[i]) for i in range(n)]


def test_neighbours_in_a_shard_are_of_one_kind():
    from muxlake.llm.bm25 import _index

    rows = two_languages(600)
    batch = pa.RecordBatch.from_pydict({"doc_id": [i for i, _ in rows], "text": [t for _, t in rows]})
    shards = [b.to_pylist()[0] for b in _index(64, 1_500_000)(iter([batch]))]
    ids = [np.frombuffer(s["ids"], np.int64).tolist() for s in shards]
    assert sorted(i for x in ids for i in x) == list(range(600)) and max(map(len, ids)) <= 64
    runs = [{dict(rows)[i][0] for i in x[at : at + 4]} for x in ids for at in range(0, len(x), 4)]
    assert sum(len(r) == 1 for r in runs) >= 0.8 * len(runs)


def test_runs_of_another_kind_are_skipped(monkeypatch):
    """A query of one language reads no list of a shard of the other, though they share a word."""
    from muxlake.llm import bm25

    rows = [(i, *bm25.terms(f"{t} shared")) for i, t in two_languages(600) if t[0] == "a"]
    mean = float(np.mean([f.sum() for _, _, f in rows]))
    asked = [bm25.terms(f"shared {' '.join(f'b{w}' for w in range(i, i + 20))}") for i in range(8)]
    places = np.unique(np.concatenate([t for t, _ in asked]))
    queries = {"terms": places, "places": np.concatenate([np.searchsorted(places, t) for t, _ in asked]), "weights": np.concatenate([f for _, f in asked]) * 1.0, "offsets": np.arange(0, 21 * 9, 21), "mean": mean}
    scored = []
    whole = bm25.Shard.score
    monkeypatch.setattr(bm25.Shard, "score", lambda self, rows, *rest: scored.extend(rows.tolist()) or whole(self, rows, *rest))
    row = dict(zip([x.split()[0] for x in bm25.INDEX.split(", ")], bm25.shard(rows), strict=True))
    best = bm25.Best(np.full(8, 3.0), 5)
    bm25.search_shard(row, queries, best, 1.2, 0.75, 4, 2)
    assert not scored and (best.scores < 0).all()
    best = bm25.Best(np.full(8, -1.0), 5)
    bm25.search_shard(row, queries, best, 1.2, 0.75, 4, 2)
    assert set(scored) == set(range(8)) and (best.scores > 0).all()


def test_floors_from_a_few_shards_lose_nothing(spark):
    from muxlake.llm.bm25 import terms, top_k

    rows = [*two_languages(900), (None, two_languages(3)[2][1]), (900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    tf = [(i, dict(zip(*map(np.ndarray.tolist, terms(t)), strict=True))) for i, t in rows]
    n, mean = len(tf), sum(sum(c.values()) for _, c in tf) / len(tf)
    df = Counter(w for _, c in tf for w in c)
    got = defaultdict(list)
    for r in of(top_k(docs, docs.where("doc_id % 20 = 0"), k=4, shard_docs=4, run=2, first=1).orderBy("query_id", "rank")):
        got[r["query_id"]].append((-round(r["score"], 6), r["doc_id"] is None, r["doc_id"]))
    for q, c in tf:
        if q is not None and q % 20 == 0 and c:
            score = {}
            for d, e in tf:
                s = sum(f * math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * e[w] * 2.2 / (e[w] + 1.2 * (0.25 + 0.75 * sum(e.values()) / mean)) for w, f in c.items() if w in e)
                if s > 0:
                    score[d] = -round(s, 6)
            want = sorted((s, d is None, d) for d, s in score.items())[:4]
            assert [x[2] for x in got.pop(q)] == [x[2] for x in want]
    assert not got


def test_tables_of_long_rows_are_in_row_groups_of_few(spark):
    """A reader holds the rows of a row group at once: 12 rows of 8 MB in one are 96 MB a task."""
    import pyarrow.parquet as pq

    from muxlake.llm.common import FEW_ROWS, table

    def long_rows(batches):
        for b in batches:
            for i in b["id"].to_pylist():
                yield pa.RecordBatch.from_pydict({"id": [i], "x": [np.random.default_rng(i).bytes(8 << 20)]})

    t = table(spark.range(0, 12, 1, 1).mapInArrow(long_rows, "id long, x binary"), FEW_ROWS)
    (file,) = [f.removeprefix("file://").removeprefix("file:") for f in t.inputFiles()]
    held = pq.ParquetFile(file).metadata
    assert max(held.row_group(i).num_rows for i in range(held.num_row_groups)) <= 3
    assert t.selectExpr("sum(length(x)) AS n").first().n == 12 << 23


# Packing


def test_packing(docs, empty, corpus):
    import public_tokenizers
    from tokenizers import Tokenizer

    from muxlake.llm.packing import pack

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    out = of(pack(docs, cap=512, block_items=64))
    want = Counter()
    for i, text, *_ in corpus:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        first = len(ids) % 512 or 512
        cuts = [0, len(ids)] if len(ids) <= 512 else [0, *range(first, len(ids) + 1, 512)]
        for k, (s, e) in enumerate(zip(cuts, cuts[1:])):
            want[i, k, s, e - s, zlib.crc32(ids[s:e].tobytes())] += 1
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 512
    assert len(bins) <= 1.02 * sum(r["length"] for r in out) / 512 + 1
    assert of(pack(empty)) == []


def test_long_runs_are_tokenized_alike():
    import public_tokenizers
    from tokenizers import Tokenizer

    from muxlake.llm.packing import encoder

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    encode = encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))
    for x in (" " * 1_000_000, " " * 1_000_000 + "a", "\n" * 5000 + "b", "a" * 200_000, "#" * 5000, "\u3000" * 3000 + "x", "a  b\n\n" * 400):
        assert list(encode(x)) == t.encode(x, add_special_tokens=False).ids


def test_evolution_beats_or_equals_best_fit():
    from muxlake.llm.packing import best_fit, evolve, fitness

    rng = np.random.default_rng(3)
    sizes = rng.integers(300, 900, 400)
    order = np.argsort(-sizes)
    plain = np.empty(400, int)
    plain[order] = best_fit(sizes[order].tolist(), [], 2048)
    best = evolve(sizes, [], 2048, 6, 20, 1)
    assert np.bincount(best, sizes).max() <= 2048
    assert fitness(sizes, best, 2048) >= fitness(sizes, plain, 2048)


# WARC


def test_revisits(spark, empty):
    from muxlake.llm.warc import canonical_url, resolve_revisits

    urls = {"HTTP://WWW.Ex.org:80/a/?b=2&utm_x=1&a=1#f": "ex.org/a?a=1&b=2", "https://u@ex.org": "ex.org", "http://ex.org/a//": "ex.org/a", "http://ex.org?x": "ex.org?x", "": ""}
    df = spark.createDataFrame([(k,) for k in urls], "url string")
    assert {r.url: r.c for r in df.select("url", canonical_url(F.col("url")).alias("c")).collect()} == urls
    h = lambda **k: {x.replace("_", "-"): v for x, v in k.items()}
    rows = [
        (1, "response", "http://a.org/x", 100, h(etag='"1"', content_type="t", cache_control="old"), "one", "r"),
        (2, "revisit", "https://www.a.org/x/", 200, h(etag='W/"1"', cache_control="new", content_type="no"), None, "r"),
        (3, "response", "http://a.org/x", 90_000, h(etag='"2"', last_modified="m"), "two", "r"),
        (4, "revisit", "http://a.org/x", 200_000, h(etag='"1"'), None, "r"),
        (5, "revisit", "http://a.org/x", 90_000, h(etag='"1"'), None, "r"),
        (6, "revisit", "http://a.org/x", 200_000, h(last_modified="m"), None, "r"),
        (7, "revisit", "http://a.org/x", 200_000, None, None, "r"),
        (8, "revisit", "http://a.org/x", 100, h(etag='"1"'), None, "r"),
        (9, "revisit", None, 300, h(etag='"1"'), None, "r"),
        (10, "request", "http://a.org/x", 300, None, None, None),
        (None, "revisit", "http://a.org/x", 300, h(etag='"1"'), None, "r"),
        (11, "revisit", "http://a.org/x", None, h(etag='"1"'), None, "r"),
    ]
    df = spark.createDataFrame(rows, "record_id long, record_type string, url string, ts long, headers map<string,string>, payload string, revisit string").withColumn("ts", F.timestamp_seconds("ts"))
    out = resolve_revisits(df)
    assert out.columns == [*df.columns, "_revisit"]
    got = {r.record_id: r for r in out.collect()}
    state = {k: (r._revisit.outcome, r._revisit.refers_to) for k, r in got.items()}
    assert state == {1: ("full", None), 2: ("resolved", 1), 3: ("full", None), 4: ("etag_differs", None), 5: ("resolved", 1), 6: ("resolved", 3), 7: ("no_validator", None), 8: ("no_earlier_response", None), 9: ("no_earlier_response", None), 10: (None, None), None: ("no_earlier_response", None), 11: ("no_earlier_response", None)}
    assert got[2].payload == "one" and got[2].headers == {"etag": 'W/"1"', "cache-control": "new", "content-type": "t"}
    assert got[6].payload == "two"
    assert resolve_revisits(df.limit(0)).count() == 0


# Quality


def brute_quality(text):
    w = words(text)
    tri = Counter(zip(w, w[1:], w[2:]))
    repeated = set()
    for i in range(len(w) - 2):
        if tri[tuple(w[i : i + 3])] > 1:
            repeated |= {i, i + 1, i + 2}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(repeated)


def test_quality(docs, empty, corpus, spark):
    from muxlake.llm.quality import BASE, features, fit, log_share, quality, word_hashes

    trusted = spark.createDataFrame([(i,) for i in range(0, 100, 2)] + [(None,), (0,)], "doc_id long")
    out = of(quality(docs, trusted, bits=10))
    assert Counter((r["doc_id"], *(r[c] for c in BASE)) for r in out) == Counter((i, *brute_quality(t)) for i, t, *_ in corpus)
    f = [(i, features(word_hashes(t), 2, 10)) for i, t, *_ in corpus]
    raw, target = np.zeros(1024), np.zeros(1024)
    for i, x in f:
        np.add.at(raw, x, 1)
        if i is not None and i < 100 and i % 2 == 0:
            np.add.at(target, x, 1)
    ratio = log_share(target, target.sum(), 1024, 0.5) - log_share(raw, raw.sum(), 1024, 0.5)
    want = Counter((i, round(float(ratio[x].mean()), 6) if len(x) else 0.0) for i, x in f)
    assert Counter((r["doc_id"], round(r["llr"], 6)) for r in out) == want
    for r in out:
        failed = r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]
        assert r["base_failed"] == failed
        assert r["kept"] == (not failed and round(r["llr"], 9) >= r["threshold"])
    assert of(quality(empty, trusted)) == []
    for limit in (3, 20_000):  # the threshold is from all trusted documents, also from those beyond the sample
        ids = fit(docs, trusted, 2, 10, limit)[2]
        sample = np.zeros(1024)
        for i, x in f:
            if i in ids:
                np.add.at(sample, x, 1)
        own = []
        for (i, x), (_, t, *_) in zip(f, corpus, strict=True):
            n_words, *_, repeats = brute_quality(t)
            if i is None or i >= 100 or i % 2 or n_words < 50 or 100 * repeats > 50 * n_words:
                continue
            rest = sample - (np.bincount(x, minlength=1024) if i in ids else 0)
            own.append(float((log_share(rest, rest.sum(), 1024, 0.5) - log_share(raw, raw.sum(), 1024, 0.5))[x].mean()))
        got = quality(docs, trusted, bits=10, trusted_limit=limit).first()["threshold"]
        assert len(own) > 3 and abs(got - (np.mean(own) - 3 * np.std(own))) < 1e-6
    assert all(r["llr"] == 0 for r in of(quality(docs, trusted.limit(0), bits=10)))


# Near duplicates


def brute_classes(corpus, similarity=0.8):
    from muxlake.llm.near_dup import aligned, shingles

    rows = [(i, shingles(t)) for i, t, *_ in corpus if i is not None]
    up = {i: i for i, _ in rows}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if len(rows[a][1]) and len(rows[b][1]) and aligned(rows[a][1], rows[b][1], similarity) >= similarity:
                x, y = top(rows[a][0]), top(rows[b][0])
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i, _ in rows}


def test_near_duplicates(docs, empty, corpus):
    from muxlake.llm.near_dup import near_duplicates, representatives

    out = of(near_duplicates(docs))
    assert len(out) == len(corpus)
    want = brute_classes(corpus)
    assert all(r["class_id"] == want.get(r["doc_id"]) for r in out)
    assert {want[i] for i in range(140, 152)} == {140}
    kept = representatives(docs)
    assert kept.columns == docs.columns
    assert Counter(r["doc_id"] for r in of(kept)) == Counter(i for i, *_ in corpus if i is None or want[i] == i)
    assert of(near_duplicates(empty)) == []


def test_alignment_against_dynamic_programming():
    from muxlake.llm.near_dup import aligned

    rng = np.random.default_rng(2)
    for _ in range(60):
        a = rng.integers(0, 40, rng.integers(5, 60)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), 2))
        b = np.insert(b, rng.integers(0, len(b)), rng.integers(0, 40))
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                m[i + 1, j + 1] = m[i, j] + 1 if a[i] == b[j] else max(m[i, j + 1], m[i + 1, j])
        s = m[-1, -1] / (len(a) + len(b) - m[-1, -1])
        got = aligned(a, b, 0.6)
        # Labels may part repeats across; a similarity that is reached is never over the true one.
        assert got <= s + 1e-12 and (got >= 0.6) <= (s >= 0.6)


def test_banded_length_by_bits():
    from muxlake.llm.near_dup import banded_lcs

    rng = np.random.default_rng(8)
    for _ in range(60):
        a, b = (rng.integers(0, 6, rng.integers(1, 40)).astype(np.uint32) for _ in range(2))
        band = int(rng.integers(0, 45))
        m = np.zeros((len(a) + 1, len(b) + 1), int)
        for i in range(len(a)):
            for j in range(len(b)):
                near = a[i] == b[j] and abs(i - j) <= band
                m[i + 1, j + 1] = max(m[i, j + 1], m[i + 1, j], m[i, j] + near)
        assert banded_lcs(a, b, band) == m[-1, -1]


def test_a_large_group_of_near_copies(spark):
    from muxlake.llm.near_dup import near_duplicates

    rng = np.random.default_rng(4)
    base = [f"w{x}" for x in rng.integers(0, 10_000, 200)]
    rows = []
    for i in range(600):
        w = list(base)
        w[int(rng.integers(200))] = f"x{i}"
        rows.append((i, " ".join(w)))
    rows += [(600 + i, " ".join(base[:60]) + " " + " ".join(f"y{i}_{j}" for j in range(120))) for i in range(200)]  # share a passage only
    out = of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)))
    by = {r["doc_id"]: r["class_id"] for r in out}
    assert {by[i] for i in range(600)} == {0}
    assert all(by[i] == i for i in range(600, 800))


def star(n, base_id, n_words=600, changed=9):
    """A text and n copies of it, each near to it but not to the others."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(n_words)]
    rows = [(base_id, " ".join(base))]
    for i in range(n + 1):
        if i != base_id:
            w = list(base)
            for j in range(changed):
                w[j * (n_words // changed) + rng.randrange(5, n_words // changed - 5)] = f"x{i}_{j}"
            rows.append((i, " ".join(w)))
    return rows


def test_a_group_linked_over_one_text_is_one_class(spark):
    from muxlake.llm.near_dup import aligned, near_duplicates, shingles

    rows = star(200, 77)
    s = [shingles(t) for _, t in rows]
    assert aligned(s[0], s[1], 0.1) > 0.8 > max(aligned(s[1], x, 0.1) for x in s[2:])
    rows += [(1000 + i, " ".join(t.split()[:300] + [f"y{i}_{j}" for j in range(200)])) for i, (_, t) in enumerate(rows[:50])]
    out = of(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert {r["class_id"] for r in out if r["doc_id"] < 1000} == {0}
    assert all(r["class_id"] == r["doc_id"] for r in out if r["doc_id"] >= 1000)
