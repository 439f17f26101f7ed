"""Periodic runs, spelling variants and main texts against brute force, on rows with every odd case."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

ODD = "doc_id long, text string, periodic string, node string"


def of(df):
    return [r.asDict(recursive=True) for r in df.collect()]


# Periodic runs


def all_runs(x, least, times):
    n, out = len(x), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and x[i] == x[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                out.setdefault((start, i - start + q), q)
            i += i == start
    return sorted((s, n, q) for (s, n), q in out.items())


def repeating(rng, n, kinds):
    x = rng.integers(1, kinds + 1, n)
    if n > 30 and rng.random() < 0.6:
        a = int(rng.integers(0, n))
        p = 1 + (n - a) // int(rng.integers(3, 11))
        x[a:] = x[a + np.arange(n - a) % p]
    return x


def test_runs_agree_with_brute_force():
    from muxlake.llm.runs import runs

    rng = np.random.default_rng(1)
    for trial in range(1200):
        x = repeating(rng, int(rng.integers(0, 220)), int(rng.integers(1, 6)))
        for least, times in ((24, 3), (4, 2), (9, 3)):
            assert sorted(map(tuple, runs(x, least, times).tolist())) == all_runs(x.tolist(), least, times), trial


def test_extensions_agree_with_brute_force():
    from muxlake.llm.runs import COVER, MODULUS, Extensions

    assert {(a - b) % MODULUS for a in COVER for b in COVER} == set(range(MODULUS))
    rng = np.random.default_rng(2)
    for _ in range(60):
        x = repeating(rng, int(rng.integers(2, 300)), int(rng.integers(1, 4)))
        i = rng.integers(0, len(x) - 1, 200)
        j = i + 1 + (rng.random(200) * (len(x) - 1 - i)).astype(int)
        got = Extensions(x).of(i, j)
        for a, b, n in zip(i, j, got, strict=True):
            assert (x[a : a + n] == x[b : b + n]).all() and (b + n == len(x) or x[a + n] != x[b + n])


def test_runs_over_more_points_than_one_look(monkeypatch):
    from muxlake.llm import runs as r

    rng = np.random.default_rng(9)
    x = np.r_[rng.integers(1, 9, 700), np.tile(rng.integers(1, 9, 211), 5), np.tile(rng.integers(1, 9, 4), 20)]
    whole = r.runs(x).tolist()
    monkeypatch.setattr(r, "POINTS", 100)
    assert r.runs(x).tolist() == whole and whole


def planted(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
    return w


def test_op11_agrees_with_brute_force(spark, tmp_path):
    from fractions import Fraction

    from muxlake.llm import queries

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["ab", "é", "the", "x y", "z"]) + rng.choice(["", "\n", "\t "]) for _ in range(rng.randrange(0, 160)))) for i in range(150)]
    rows += [(200, None), (201, ""), (202, " \n"), (203, "a " * 30_000), (204, "a b c " * 9), (204, "a b c " * 9), (None, "x y " * 20), (-7, "q " * 30), (205, " ".join(rng.choice("abcdefgh") for _ in range(4000)) + " k l" * 500)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op11(spark, str(tmp_path)).collect())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for doc_id, text in rows:
        w = planted(doc_id, text) if doc_id is not None else re.findall(r"[^\x20\x09-\x0D]+", text)
        found = [(0, len(w), 1)] if len(set(w)) == 1 and len(w) >= 24 else sorted(all_runs(w, 24, 3), key=lambda r: (r[0], r[2]))
        best = max(found, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        gone = {i for s, n, q in found for i in range(s + q, s + n)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        want[(doc_id, len(found), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(kept))] += 1
    assert got == want and sum(r[1] > 0 for r in want) > 5
    assert queries.op11(spark, str(tmp_path)).columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_runs_of_odd_rows(spark):
    from muxlake.llm.runs import periodic_runs

    bad = b"\xff\xc3 b " * 20
    df = spark.createDataFrame([(1, "a b " * 20, "x", "y"), (2, None, None, None)], ODD)
    out = periodic_runs(df.unionByName(spark.createDataFrame([(3, bad)], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"), F.lit("x").alias("periodic"), F.lit("y").alias("node"))))
    assert out.columns == ["doc_id", "text", "periodic", "node", "_periodic"]
    by = {r["doc_id"]: r["_periodic"] for r in of(out.withColumn("_periodic", F.col("_periodic").withField("collapsed", F.hex(F.col("_periodic.collapsed")))))}
    assert by[1]["runs"] == [{"start": 0, "length": 40, "period": 2}] and bytes.fromhex(by[1]["collapsed"]) == b"a b"
    assert by[2] == {"n_words": 0, "runs": [], "collapsed": ""}
    assert bytes.fromhex(by[3]["collapsed"]) == b"\xff\xc3 b"
    assert periodic_runs(df.limit(0)).isEmpty()


# Spelling variants


def beside(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)) :] == b[k + (len(b) >= len(a)) :]


def all_variants(counts, ratio=2):
    near = {w: sorted((-m, v) for v, m in counts.items() if beside(w, v)) for w in counts}
    form = {w: (x[0][1] if x and -x[0][0] >= ratio * counts[w] else None) for w, x in near.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else -1) for w in counts)


def variants(spark, rows):
    from muxlake.llm.variants import spelling_variants

    out = spelling_variants(spark.createDataFrame(rows, "word string, n long, left string, id string").repartition(4))
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in of(out))


def test_variants_agree_with_brute_force(spark):
    rng = random.Random(4)
    counts = {}
    for _ in range(500):
        counts["".join(rng.choice("abé") for _ in range(rng.randrange(1, 8)))] = rng.choice([1, 2, 3, 5, 9, 20, 41, 90, 200])
    counts |= {"": 5, "𝒳𝒳ab": 3, "𝒳𝒳a": 7, "￿ab": 4}
    for base, other in (("a" * 63, "b"), ("a" * 64, "b"), ("a" * 65, "c"), ("ab" * 60, "x")):  # about and over the longest in the tries
        k = len(base)
        counts |= {base: 50, base[1:]: 7, base[: k // 2] + other + base[k // 2 :]: 3, other + base[1:]: 20, base[:-1] + other: 2, base + other: 100, base[: k // 2] + other + base[k // 2 + 1 :]: 1}
    assert variants(spark, [(w, n, "x", "y") for w, n in counts.items()]) == all_variants(counts)


def test_variants_of_odd_rows(spark):
    assert variants(spark, [("word", 2, None, None), ("word", 3, None, None), ("wird", 1, None, None), (None, 9, None, None), ("ward", None, None, None)]) == [("wird", "word", "word", 1, 1, 5), ("word", "", "word", 5, 1, -1)]
    assert variants(spark, []) == []
    # Ties go to the first word; chains end at their last form; a form needs twice the count.
    assert variants(spark, [("bbbb", 4, None, None), ("abbb", 4, None, None), ("cbbb", 2, None, None), ("cbbx", 1, None, None)]) == all_variants({"bbbb": 4, "abbb": 4, "cbbb": 2, "cbbx": 1})


def test_op12_agrees_with_brute_force(spark, tmp_path):
    from muxlake.llm import queries

    rng = random.Random(5)
    names = ["Vögel", "singen", "heute", "überall", "ABCDE", "ab×cd", "Éclat"]
    rows = [(i, " ".join(rng.choice(names) + rng.choice(["", ",", "9", "-"]) for _ in range(60))) for i in range(120)] + [(None, "singen " * 9), (500, None), (501, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for doc_id, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{doc_id}:{w}".encode()) if doc_id is not None else 1
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    want = all_variants({w: n for w, n in counts.items() if len(w) >= 5 and n >= 3})
    got = sorted((r["word"], r["form"] or "", r["root"], r["n"], r["n_near"], -1 if r["form_n"] is None else r["form_n"]) for r in of(queries.op12(spark, str(tmp_path))))
    assert got == want and any(r[1] for r in want)


# Main text of pages


def test_min_cut_agrees_with_brute_force():
    from muxlake.llm.extraction import min_cut

    rng = np.random.default_rng(6)
    for _ in range(600):
        n = int(rng.integers(1, 10))
        costs = rng.normal(0, 2, n).round(1).tolist()
        edges = [(int(rng.integers(0, n)), int(rng.integers(0, n)), float(rng.random() * 2)) for _ in range(rng.integers(0, 2 * n))]

        def cost(kept):
            return sum(-c for c, k in zip(costs, kept, strict=True) if k and c < 0) + sum(c for c, k in zip(costs, kept, strict=True) if c > 0 and not k) + sum(w for a, b, w in edges if kept[a] != kept[b])

        assert cost(min_cut(costs, edges)) == pytest.approx(min(map(cost, itertools.product((False, True), repeat=n))))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="has-sidebar"><form id="page">
<div class="header"><h1>Site</h1></div><ul class="menu"><li><a href=x>Home page</a><li><a href=y>About us all</a></ul>
<div class="content-sidebar-wrap"><main><article class="post category-notices"><header class="entry-header"><h1>Title &amp;
here&#33;</h1></header><p>First <b>para</b> with words.&nbsp; And more.<aside>Pull quote</aside><p><b>Be.<br><p>Open.<div class="ad">Buy now our things. They are good. Really good things for all.</div>
<p>Third<!-- not this --> para.</p><noscript>no</noscript><ul><li>one<li>two <a href=z>link</a></ul><table><tr><td>a<td>b<tr><td>c</table></article>
<section id="comments"><h2>Comments</h2><article class="comment"><p>I think this is a very good article indeed. Thanks. More.</p></article></section></main>
<div class="sidebar"><p>Related stories are here, and they are long. Many words stand here. Truly.</p></div></div>
<div id="cookie-notice">We use cookies on this site. Please accept them.</div><form><label>Mail</label><p>Give us your mail, please. We need it.</p></form><footer><p>&copy; 2020 by us. All rights reserved.</p></footer></form></body>"""


def test_main_text():
    from muxlake.llm.extraction import main_text

    assert main_text(PAGE).split("\n") == ["Title & here!", "First para with words. And more.", "Be.", "Open.", "Third para.", "one", "two link", "a", "b", "c"]
    plain = "<div><a href=1>Home</a> <a href=2>News</a></div><div><h2>A headline of some words</h2><p>A paragraph of quite a few words that goes on. It ends here. Well then.<p>Short one.<p>Another one of many words with commas, and full stops. Yes.</div><div><a href=3>Contact</a></div>"
    assert main_text(plain).split("\n") == ["A headline of some words", "A paragraph of quite a few words that goes on. It ends here. Well then.", "Short one.", "Another one of many words with commas, and full stops. Yes."]
    assert main_text("<nav>Home</nav>") == "" and main_text("<article>text<!-- no end") == "text"
    assert len(main_text("<article>" + "<p>Some words.</p><div class=ad>x</div>" * 20_000).split("\n")) == 20_000


def test_extract_text_of_odd_rows(spark):
    from muxlake.llm.extraction import extract_text

    df = spark.createDataFrame([(1, PAGE, "x"), (1, PAGE, "x"), (2, None, None), (3, "", "x"), (4, " \n", "x")], "page_id long, html string, text string")
    bad = spark.createDataFrame([(5, b"<article><p>a\xffb</p></article>")], "page_id long, b binary").select("page_id", F.col("b").cast("string").alias("html"), F.lit("x").alias("text"))
    out = extract_text(df.unionByName(bad))
    assert out.columns == ["page_id", "html", "text", "_text"]
    rows = [(r["page_id"], r["_text"]) for r in out.select("page_id", "_text").collect()]
    assert len(rows) == 6 and [x for i, x in rows if i == 1][0] == [x for i, x in rows if i == 1][1] != ""
    assert {i: x for i, x in rows if i > 1} == {2: "", 3: "", 4: "", 5: "a�b"}
    assert extract_text(df.limit(0)).isEmpty()


def test_op13_of_generated_pages(spark):
    """Those of the smallest tables mark their article; the method doesn't rest on that alone."""
    import html as h

    from muxlake.llm import queries

    pages = {r["page_id"]: r["html"] for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    for r in queries.op13(spark, "/root/testdata/sf0.001").collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", pages[r["page_id"]], re.S)[1])
        want = "\n".join(x for x in (" ".join(h.unescape(re.sub("<[^>]*>", " ", p)).split()) for p in parts) if x)
        assert r["text"] == want and r["n_chars"] == len(want)


# Near duplicates: long texts, template pages


def test_banded_alignment_agrees_with_brute_force():
    from muxlake.llm.near_dup import banded_lcs

    rng = np.random.default_rng(0)
    for _ in range(150):
        n, m = rng.integers(1, 40, 2)
        kinds, band = int(rng.integers(1, 12)), int(rng.integers(0, 50))
        a, b = rng.integers(0, kinds, n).astype(np.uint32), rng.integers(0, kinds, m).astype(np.uint32)
        d = np.zeros((n + 1, m + 1), int)
        for i, j in itertools.product(range(n), range(m)):
            d[i + 1, j + 1] = max(d[i, j + 1], d[i + 1, j], d[i, j] + 1 if a[i] == b[j] and abs(i - j) <= band else 0)
        for often in (256, 3, 0):
            assert banded_lcs(a, b, band, often) == d[n, m]


def test_alignment_of_very_long_texts_takes_little_memory():
    import tracemalloc

    from muxlake.llm.near_dup import aligned

    x = np.random.default_rng(1).permutation(800_000)[:400_000].astype(np.uint32)
    tracemalloc.start()
    assert aligned(x, np.r_[x[200_000:], x[:200_000]], 0.8) == 0.0  # halves swapped: half of it aligns
    assert tracemalloc.get_traced_memory()[1] < 200e6
    tracemalloc.stop()


def test_pages_of_shared_passages_are_hardly_aligned(spark, monkeypatch):
    """Pages of 10 of 24 passages share many shingles but aren't similar: pairs to align don't grow with the square of the pages."""
    from muxlake.llm import near_dup

    rng = random.Random(8)
    passages = [" ".join(f"p{i}w{rng.randrange(10**6)}" for _ in range(20)) for i in range(24)]
    aligned, check = [], near_dup.verified

    def counted(pairs, *args, **more):
        aligned.append(pairs.count())
        return check(pairs, *args, **more)

    monkeypatch.setattr(near_dup, "verified", counted)
    found = []
    for n in (150, 300):
        rows = [(i, " ".join(rng.sample(passages, 10))) for i in range(n)]
        rows += [(n + i, rows[i][1].replace(" p", " q", 1)) for i in range(5)]
        aligned.clear()
        got = {r.doc_id: r.class_id for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert all(got[n + i] == got[i] for i in range(5))
        found.append(sum(aligned))
    assert found[1] < 3 * found[0] + 60


# Ill-formed UTF-8, which a Spark string may hold


def test_ill_formed_texts_end_no_operator(spark, tmp_path):
    from muxlake.llm import queries

    good = [(i, f"the other thing is here with line {i % 3}\nthis line stands in many documents\n" + "and more words of the same kind " * 3, "en", "s", 0) for i in range(1, 60)]
    df = spark.createDataFrame(good, "doc_id long, text string, lang string, source string, n_chars long")
    bad = spark.createDataFrame([(0, b"the \xff thing \xc3 stands here\nthis line stands in many documents\n\xe2\x82 end " + b"word " * 600), (100, b"a\xffb \xc3")], "doc_id long, b binary")
    df = df.unionByName(bad.select("doc_id", F.col("b").cast("string").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(0).cast("long").alias("n_chars")))
    df.repartition(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name in ("op1_language_id", "op2_token_counts", "op3_source_mix", "op4_suffix_dedup", "op5_line_dedup", "op9_quality_rules", "op10_near_dup", "op11_periodic_runs"):
        ids = {r.doc_id for r in queries.QUERIES[name](spark, str(tmp_path)).select("doc_id").collect()}
        assert {0, 100} <= ids and len(ids) == 61, name
    assert {0, 100} <= {r.doc_id for r in queries.op7(spark, str(tmp_path)).select("doc_id").collect()}
    assert 0 in {r.query_id for r in queries.op6(spark, str(tmp_path)).collect()}
    assert queries.op12(spark, str(tmp_path)).count() > 0
    kept = {r.doc_id: (r.n_bytes, r.n_removed) for r in queries.op4(spark, str(tmp_path)).collect()}
    raw = bad.select("doc_id", F.octet_length("b").alias("n")).collect()
    assert all(kept[r.doc_id][0] == r.n for r in raw) and kept[0][1] > 2000  # bytes are as they are


# Language ID: predictions against a plain pass, a byte at a time


def plain_pass(net, raw, window):
    """Probabilities of each byte of a text, window by window, by the formulas of a gated unit with hard gates."""
    w, n = {k: v.astype(float) for k, v in net.w.items()}, net.h
    out = []
    for at in range(0, len(raw), window):
        x = list(raw[at : at + window].ljust(window, b"\0"))

        def states(d, order):
            h, found = np.zeros(n), {}
            for i in order:
                g, a = w["e"][d][:, x[i]], w["u"][d] @ h
                z, r = np.clip(a[:n] + g[:n] + 0.5, 0, 1), np.clip(a[n : 2 * n] + g[n : 2 * n] + 0.5, 0, 1)
                c = np.tanh(g[2 * n :] + r * a[2 * n :])
                h = z * h + (1 - z) * c
                found[i] = h
            return found

        ahead, back = states(0, range(window)), states(1, range(window - 1, -1, -1))
        for i in range(min(window, len(raw) - at)):
            p = np.exp(np.clip(w["v"] @ np.r_[ahead[i], back[i]] + w["c"][:, 0], -30, 30))
            out.append(p / p.sum())
    return np.array(out)


def test_language_predictions_agree_with_a_plain_pass(spark):
    from muxlake.llm.langid import fit, identify, label_positions, pooled, train

    rng = random.Random(11)
    en, fr = ["the", "thing", "other", "with"], ["le", "être", "château", "où"]
    rows = [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(rng.randrange(3, 90))), "en" if i % 2 else "fr") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = fit(docs, steps=60)
    raws = [t.encode() for _, t, _ in rows[:12]]
    plain = [plain_pass(net, r, 128) for r in raws]
    assert np.allclose(pooled(net, raws), [p.mean(axis=0) for p in plain], atol=1e-3)
    for raw, p in zip(raws[:4], plain, strict=False):
        sure = np.sort(p, axis=1)[:, -1] - np.sort(p, axis=1)[:, -2] > 1e-3
        assert (label_positions(net, raw.decode())[sure] == p.argmax(axis=1)[sure]).all()
    for r in identify(docs, steps=60).where("doc_id < 12").collect():
        p = plain[r.doc_id].mean(axis=0)
        assert r.lang_pred == net.langs[p.argmax()] and abs(r.score - p.max()) < 1e-3
    assert train([("en", b"the"), ("fr", b"le")], steps=2, seed=3).langs == ["en", "fr"]
