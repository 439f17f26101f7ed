"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import functions as F

from muxlake.llm.common import documents

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("op3_source_mix")
def op3(spark, sf_dir):
    from muxlake.llm.mixing import mix

    out = mix(documents(spark, sf_dir).select("doc_id", "text", "source"))
    return out.select("doc_id", *[F.col(f"mix.{c}").alias(c) for c in ("size", "source_size", "target", "taken")])


@query(
    "op5_line_dedup",
    """WITH l AS (SELECT doc_id, g.i, t.x[g.i] AS line, translate(trim(t.x[g.i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
      FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS x FROM documents) t, LATERAL (SELECT unnest(range(1, len(t.x) + 1)) AS i) g),
    k AS (SELECT key, max(doc_id) AS top FROM l WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
    m AS (SELECT l.doc_id, l.i, l.line, k.key IS NOT NULL AND l.doc_id <> k.top AS gone FROM l LEFT JOIN k ON l.key = k.key)
    SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
)
def op5(spark, sf_dir):
    from muxlake.llm.line_dedup import keep_bitmaps, line_digests

    docs = documents(spark, sf_dir)
    return line_digests(docs, keep_bitmaps(docs))


@query("op9_quality_rules")
def op9(spark, sf_dir):
    from muxlake.llm.quality import quality

    trusted = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    return quality(documents(spark, sf_dir), trusted)


@query("op10_near_dup")
def op10(spark, sf_dir):
    from muxlake.llm.near_dup import near_duplicates

    return near_duplicates(documents(spark, sf_dir))


@query("op2_token_counts")
def op2(spark, sf_dir):
    from muxlake.llm.token_counts import token_counts

    return token_counts(documents(spark, sf_dir))


@query("op7_best_fit_packing")
def op7(spark, sf_dir):
    from muxlake.llm.packing import pack

    return pack(documents(spark, sf_dir))


@query("op1_language_id")
def op1(spark, sf_dir):
    from muxlake.llm.langid import identify

    return identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))


@query("op4_suffix_dedup")
def op4(spark, sf_dir):
    from muxlake.llm.suffix_dedup import digests, substring_dedup

    return digests(substring_dedup(documents(spark, sf_dir)))


@query(
    "op6_top_k_search",
    """WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS w FROM documents),
    tf AS (SELECT doc_id, w, count(*) AS f FROM tok GROUP BY ALL), dl AS (SELECT doc_id, sum(f) AS len FROM tf GROUP BY 1),
    n AS (SELECT count(*) AS n, (SELECT sum(len) FROM dl) / count(*) AS mean FROM documents), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT q.doc_id AS query_id, d.doc_id, round(sum(q.f * ln(1 + (n - df + 0.5) / (df + 0.5)) * d.f * 2.2 / (d.f + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM tf q JOIN df USING (w) JOIN tf d USING (w) JOIN dl ON dl.doc_id = d.doc_id, n WHERE q.doc_id % 50 = 0 GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s)
    SELECT query_id, rank::INT AS rank, doc_id, round(score, 3) AS score FROM r WHERE rank <= 10""",
)
def op6(spark, sf_dir):
    from muxlake.llm.bm25 import top_k

    docs = documents(spark, sf_dir)
    return top_k(docs, docs.where("doc_id % 50 = 0")).withColumn("score", F.round("score", 3))


def page_captures(pages):
    """Crawl records of pages: a response each, later responses of some, and revisits with matching, stale or no validators."""
    t = F.lit(1704067200) + F.col("page_id") * 37
    md5 = lambda x: F.concat(F.lit('"'), F.md5(x), F.lit('"'))
    second = F.concat("html", F.lit("<!-- v2 -->"))
    again = F.concat(F.lit("https://www."), F.regexp_replace("url", r"^https?://(www\.)?", ""), F.lit("#again"))

    def record(offset, kind, url, ts, etag, modified, cache, length, payload, where=None):
        names = ["etag", "last-modified", "cache-control", "content-type", "content-length"]
        values = [etag, modified, F.lit(cache), F.lit("text/html" if kind == "response" else "text/plain"), length.cast("string")]
        headers = F.map_filter(F.create_map(*[x for n, v in zip(names, values, strict=True) for x in (F.lit(n), v)]), lambda _, v: v.isNotNull())
        rows = pages.where(where) if where else pages
        return rows.select((F.col("page_id") * 4 + offset).alias("record_id"), F.lit(kind).alias("record_type"), url.alias("url"), F.timestamp_seconds(ts).alias("ts"), headers.alias("headers"), payload.alias("payload"))

    none = F.lit(None).cast("string")
    own = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("W/"), md5("html"))).otherwise(md5("html"))
    asked = F.when(F.col("page_id") % 7 == 0, F.lit('"gone"')).when((F.col("page_id") % 11 == 0) | (F.col("page_id") % 13 == 0), none).when(F.col("page_id") % 10 == 0, md5(second)).otherwise(md5("html"))
    since = F.when((F.col("page_id") % 11 == 0) & (F.col("page_id") % 13 != 0), t.cast("string"))
    url = F.col("url")
    return (
        record(0, "response", url, t, own, t.cast("string"), "max-age=60", F.length("html"), F.col("html"))
        .unionByName(record(1, "response", url, t + 7200, md5(second), (t + 7200).cast("string"), "max-age=60", F.length(second), second, "page_id % 5 = 0"))
        .unionByName(record(2, "revisit", again, t + 10800, asked, since, "max-age=120", F.lit(0), none))
        .unionByName(record(3, "revisit", again, t - 60, md5("html"), none, "max-age=120", F.lit(0), none, "page_id % 17 = 0"))
    )




@query(
    "op8_warc_revisits",
    """WITH c AS (
      SELECT page_id * 4 AS record_id, 'response' AS record_type, url, 1704067200 + page_id * 37 AS t, CASE WHEN page_id % 3 = 0 THEN 'W/' ELSE '' END || '"' || md5(html) || '"' AS etag, (1704067200 + page_id * 37)::VARCHAR AS modified, 'max-age=60' AS cache, length(html)::VARCHAR AS len, html AS payload FROM pages
      UNION ALL SELECT page_id * 4 + 1, 'response', url, 1704074400 + page_id * 37, '"' || md5(html || '<!-- v2 -->') || '"', (1704074400 + page_id * 37)::VARCHAR, 'max-age=60', length(html || '<!-- v2 -->')::VARCHAR, html || '<!-- v2 -->' FROM pages WHERE page_id % 5 = 0
      UNION ALL SELECT page_id * 4 + 2, 'revisit', 'https://www.' || regexp_replace(url, '^https?://(www\\.)?', '') || '#again', 1704078000 + page_id * 37,
        CASE WHEN page_id % 7 = 0 THEN '"gone"' WHEN page_id % 11 = 0 OR page_id % 13 = 0 THEN NULL WHEN page_id % 10 = 0 THEN '"' || md5(html || '<!-- v2 -->') || '"' ELSE '"' || md5(html) || '"' END,
        CASE WHEN page_id % 11 = 0 AND page_id % 13 <> 0 THEN (1704067200 + page_id * 37)::VARCHAR END, 'max-age=120', '0', NULL FROM pages
      UNION ALL SELECT page_id * 4 + 3, 'revisit', 'https://www.' || regexp_replace(url, '^https?://(www\\.)?', '') || '#again', 1704067140 + page_id * 37, '"' || md5(html) || '"', NULL, 'max-age=120', '0', NULL FROM pages WHERE page_id % 17 = 0),
    u AS (SELECT *, regexp_replace(url, '#.*$', '') AS v FROM c),
    x AS (SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', 1)), ':(80|443)$', ''), '^www\\.', '') AS h, regexp_replace(v, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)', '') AS rest FROM u),
    y AS (SELECT *, regexp_replace(regexp_extract(rest, '^[^?]*'), '/+$', '') AS p, array_to_string(list_sort(list_filter(string_split(regexp_extract(rest, '\\?(.*)$', 1), '&'), lambda z: z <> '' AND NOT starts_with(z, 'utm_'))), '&') AS q FROM x),
    r AS (SELECT *, h || p || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS canonical_url FROM y),
    f AS (SELECT * FROM r WHERE record_type = 'response'),
    j AS (SELECT r.*, f.record_id AS fid, f.etag AS fetag, f.modified AS fmod, f.len AS flen, f.payload AS fpay FROM r ASOF LEFT JOIN f ON r.canonical_url = f.canonical_url AND r.t > f.t),
    o AS (SELECT *, CASE WHEN record_type = 'response' THEN 'full' WHEN fid IS NULL THEN 'no_earlier_response'
      WHEN etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(fetag, '^W/', '') THEN 'resolved' ELSE 'etag_differs' END
      WHEN modified IS NOT NULL THEN CASE WHEN modified = fmod THEN 'resolved' ELSE 'last_modified_differs' END ELSE 'no_validator' END AS outcome FROM j)
    SELECT record_id, record_type, canonical_url, outcome, CASE WHEN outcome = 'resolved' THEN fid::VARCHAR END AS refers_to, cache AS cache_control,
      CASE WHEN record_type = 'response' OR outcome = 'resolved' THEN 'text/html' ELSE 'text/plain' END AS content_type, CASE WHEN outcome = 'resolved' THEN flen ELSE len END AS content_length,
      CASE WHEN outcome = 'resolved' THEN coalesce(etag, fetag) ELSE etag END AS etag, sha256(CASE WHEN outcome = 'resolved' THEN fpay ELSE payload END) AS payload_sha256 FROM o""",
)
def op8(spark, sf_dir):
    from muxlake.llm.warc import resolve_revisits

    out = resolve_revisits(page_captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    header = lambda name: F.element_at("headers", name).alias(name.replace("-", "_"))
    return out.select("record_id", "record_type", "revisit.canonical_url", "revisit.outcome", F.col("revisit.refers_to").cast("string").alias("refers_to"), *map(header, ("cache-control", "content-type", "content-length", "etag")), F.sha2("payload", 256).alias("payload_sha256"))


def with_repeats(docs):
    """(doc_id, text), where every tenth document, by the crc32 of its id, repeats some of its words up to its end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.floor(h / 10)
    own = docs.select("doc_id", "text", g.alias("g"), F.when((h % 10 == 0) & F.col("text").isNotNull(), F.regexp_extract_all("text", F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))).alias("w"))
    n = F.size("w")
    own = own.withColumn("a", F.when(n > 0, F.col("g") % n).cast("int"))
    own = own.withColumn("p", (1 + F.floor((n - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    rest = F.slice(F.flatten(F.array_repeat(F.slice("w", F.col("a") + 1, F.col("p")), F.ceil((n - F.col("a")) / F.col("p")).cast("int"))), 1, n - F.col("a"))
    repeated = F.array_join(F.concat(F.slice("w", 1, F.col("a")), rest), " ")
    return own.select("doc_id", F.when(n > 0, repeated).otherwise(F.col("text")).alias("text"))


@query("op11_periodic_runs")
def op11(spark, sf_dir):
    from muxlake.llm.runs import periodic_runs

    found = periodic_runs(with_repeats(documents(spark, sf_dir))).select("doc_id", "periodic.*")
    none = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    # Runs are sorted by start and period, so of equal ratios the first stays.
    more = lambda z, r: z.isNull() | (r["length"] * z["period"] > z["length"] * r["period"])
    best = F.aggregate("runs", none, lambda z, r: F.when(more(z, r), r).otherwise(z))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return out.select("doc_id", "n_runs", "best.*", F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")


def with_typos(words):
    """(word) of (doc_id, word): one code point is left out where 97 divides the crc32 of both."""
    h = F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("word")).cast("binary"))
    cut = (h % F.length("word")).cast("int")
    typo = F.concat(F.substring("word", F.lit(1), cut), F.substring("word", cut + 2, F.length("word")))
    return words.select(F.when(h % 97 == 0, typo).otherwise(F.col("word")).alias("word"))


@query(
    "op12_spelling_variants",
    """WITH t AS (SELECT list(list_reduce(list_prepend(k, range(8)), lambda c, _: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY k) AS t FROM range(256) r(k)),
    r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w FROM documents),
    d AS (SELECT doc_id, w, count(*) AS n, hex(encode(doc_id::VARCHAR || ':' || w)) AS x FROM r GROUP BY doc_id, w),
    h AS (SELECT w, n, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h FROM d, t),
    c AS (SELECT CASE WHEN h % 97 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, sum(n)::BIGINT AS n FROM h GROUP BY 1 HAVING length(word) >= 5 AND sum(n) >= 3),
    s AS (SELECT word, n, i, substr(word, 1, i) AS l, substr(word, i + 2) AS r FROM c, LATERAL (SELECT unnest(range(length(word))) AS i)),
    near AS (SELECT DISTINCT a.word, a.n, b.word AS other, b.n AS m FROM s a JOIN s b ON a.l = b.l AND a.r = b.r AND a.word <> b.word
      UNION SELECT s.word, s.n, c.word, c.n FROM s JOIN c ON c.word = s.l || s.r UNION SELECT c.word, c.n, s.word, s.n FROM s JOIN c ON c.word = s.l || s.r),
    best AS (SELECT word, count(*) AS n_near, arg_min(other, (-m, other)) AS other, max(m) AS m FROM near GROUP BY word),
    f AS (SELECT c.word, c.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * c.n THEN other END AS form, CASE WHEN m >= 2 * c.n THEN m END AS form_n FROM c LEFT JOIN best ON c.word = best.word),
    g AS (WITH RECURSIVE g AS (SELECT word, word AS root, 0 AS k FROM f UNION ALL SELECT g.word, f.form, k + 1 FROM g JOIN f ON g.root = f.word WHERE f.form IS NOT NULL) SELECT word, arg_max(root, k) AS root FROM g GROUP BY word)
    SELECT f.word, form, root, n, n_near, form_n FROM f JOIN g ON f.word = g.word""",
)
def op12(spark, sf_dir):
    from muxlake.llm.variants import letter_runs, spelling_variants

    counts = with_typos(letter_runs(documents(spark, sf_dir), "doc_id")).groupBy("word").agg(F.count("*").alias("n"))
    return spelling_variants(counts.where((F.length("word") >= 5) & (F.col("n") >= 3)))


@query("op13_html_extraction")
def op13(spark, sf_dir):
    from muxlake.llm.extraction import extract_text

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract_text(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
