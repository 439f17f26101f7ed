"""Two-level windows equal one window over the whole stream, whatever the spans hold."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from muxlake.operators import scan, timing


@pytest.fixture(scope="module")
def rows(spark):
    """Streams of many and of few rows, gaps of many spans, a null stream, null values, orders below 0."""
    rng = random.Random(7)
    out = []
    for stream, n, step in (("a", 700, 3), ("b", 40, 90), (None, 60, 5), ("c", 1, 1)):
        at = -300
        for _ in range(n):
            at += rng.randrange(1, 2 * step)
            out.append((stream, at, rng.randrange(100) if rng.random() < 0.8 else None, "x"))
    return spark.createDataFrame(out, "stream_id string, n long, v long, __n string").repartition(5).cache()


def collected(df):
    return sorted(map(repr, df.select("stream_id", "n", "v", "got").collect()))


def whole():
    return Window.partitionBy("stream_id").orderBy("n")


@pytest.mark.parametrize("back", [1, 3, 40])
@pytest.mark.parametrize("span", [7, 64, 10_000])
def test_looking_back(rows, back, span):
    rows = rows.drop("__n")
    of = lambda w: F.struct(F.sum("v").over(w.rowsBetween(-back, -1)), F.lag("v", back).over(w), F.count("*").over(w.rowsBetween(-back, 0)))
    got = scan.looking_back(rows, ["stream_id"], "n", back, lambda w: {"got": of(w)}, span)
    assert got.columns == ["stream_id", "n", "v", "got"]
    assert collected(got) == collected(rows.withColumn("got", of(whole())))


@pytest.mark.parametrize("span", [7, 64, 10_000])
def test_ranging_back(rows, span):
    of = lambda w: F.struct(F.sum("v").over(w.rangeBetween(-50, 0)), F.min("n").over(w.rangeBetween(-50, 0)))
    assert collected(scan.ranging_back(rows, ["stream_id"], "n", 50, lambda w: {"got": of(w)}, span)) == collected(rows.withColumn("got", of(whole())))


@pytest.mark.parametrize("span", [7, 64, 10_000])
@pytest.mark.parametrize("before", [False, True])
def test_running(rows, span, before):
    w = whole().rowsBetween(Window.unboundedPreceding, -1 if before else 0)
    want = F.struct(F.sum("v").over(w).alias("g0"), F.min("v").over(w).alias("g1"), F.max("v").over(w).alias("g2"), F.last("v", ignorenulls=True).over(w).alias("g3"))
    values = {f"g{i}": (kind, F.col("v")) for i, kind in enumerate(("total", "least", "most", "latest"))}
    got = scan.running(rows, ["stream_id"], "n", values, span, before=before).withColumn("got", F.struct(*values))
    assert collected(got) == collected(rows.withColumn("got", want))


def test_running_over_all_rows_and_ties(spark):
    df = spark.createDataFrame([(i // 2, 1) for i in range(40)], "n int, one int")
    got = scan.running(df, [], "n", {"all": ("total", F.col("one"))}, 3)
    assert sorted(r["all"] for r in got.collect()) == sorted(2 * (i // 2) + 2 for i in range(40))
    got = scan.running(df, [], "n", {"all": ("total", F.col("one"))}, 3, peers=False)
    assert sorted(r["all"] for r in got.collect()) == list(range(1, 41))


def test_null_orders_and_empty_tables(spark):
    df = spark.createDataFrame([("a", None, 5), ("a", 1, 6), ("a", 900, 7)], "stream_id string, n long, v long")
    got = scan.running(df, ["stream_id"], "n", {"got": ("total", F.col("v"))}, 10)
    assert sorted(r.got for r in got.collect()) == [5, 11, 18]
    got = scan.looking_back(df, ["stream_id"], "n", 1, lambda w: {"got": F.lag("v").over(w)}, 10)
    assert {r.v: r.got for r in got.collect()} == {5: None, 6: 5, 7: 6}
    none = df.limit(0)
    assert scan.running(none, ["stream_id"], "n", {"got": ("least", F.col("v"))}).isEmpty() and scan.looking_back(none, ["stream_id"], "n", 2, lambda w: {"got": F.lag("v").over(w)}).isEmpty()


def test_spans_of_times_and_structs(spark):
    df = spark.sql("SELECT TIMESTAMP '1970-01-01 02:30:00' AS t, named_struct('a', 130, 'b', 'x') AS s, 65536.5 AS d")
    r = df.select(scan.span_of(df, "t").alias("t"), scan.span_of(df, "t", 60).alias("m"), scan.span_of(df, "s", 10).alias("s"), scan.span_of(df, "d").alias("d")).first()
    assert tuple(r) == (2, 150, 13, 1)


def test_no_task_sorts_a_whole_stream(spark):
    """A million rows of one stream: the windows over rows get a span each."""
    n, span = 1_000_000, 65_536
    df = spark.range(0, n, 1, 16).select(F.lit("s").alias("stream_id"), F.col("id").alias("frame_no"), (F.col("id") % 250).alias("fc"), (F.col("id") % 1000 != 0).alias("valid"))
    sizes = scan.running(df, ["stream_id"], "frame_no", {"run": ("total", F.lit(1))}, span, then=lambda w: {"size": F.count("*").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    r = sizes.agg(F.max("size").alias("most"), F.max("run").alias("run"), F.count("*").alias("n")).first()
    assert (r.most, r.run, r.n) == (span + 1, n, n)
    assert timing.frame_count_gaps(df).count() == 0
    runs = timing.error_runs(df, 1)
    assert runs.count() == n // 1000 and runs.where("length <> 1").count() == 0
