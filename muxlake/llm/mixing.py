"""Mixing sources to target weights by Pareto order sampling.

Each source gets a share of all words by its weight. A share stops at max_repeat times
the source's words, and the excess goes to the others by weight until none is above.
A document's expected copies are a rate of its source times its propensity: a column, or
its size to the power size_power. They stop at max_repeat, and the rate is such that the
expected words of a source, those that stop included, are its target; propensities are
rounded to steps of an eighth of a doubling for that. The whole part is taken for certain;
the fractional part p is sampled by Pareto order sampling: documents are ranked by
[u / (1 - u)] / [p / (1 - p)], u uniform by hash of the row, and taken from the smallest
rank up to the fixed size. The size is counted in words: the sample ends before the
document that would pass it; then up to `fills` further documents, each the one whose size
is nearest to what is left, are added while that brings the source nearer.

All is built-in functions. Windows without a partition run over a table of one row a source
alone, in one task: sources may be many thousands, but not one a document. Ranks are cut
into bins twice; only one bin of BINS**2 a source is ordered, so a source with a third of
all rows needs no global sort.

Cases: null text has size 0. Null sources are one source, last in order. Documents of
size 0 are taken or not, at no words. Rows that repeat a doc_id and text within a source
are numbered, and sampled each for itself. A null propensity is 1, one below 0 is 0. An
empty table gives no rows. Extra columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.llm.common import free_name, join_small, table

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 4096


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, cycle: int = 3, max_repeat: int = 3) -> DataFrame:
    """sizes: (source, source_size), a row a source. Adds the weight (1 to cycle, by code point, null last) and the target."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % cycle + 1).withColumn("most", F.lit(max_repeat) * F.col("source_size"))
    # In the order of most / weight, the capped sources come first: each takes its most, the others share the rest.
    fill = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.partitionBy())
    s = s.withColumn("level", (total - F.coalesce(F.sum("most").over(before), F.lit(0))) / F.sum("weight").over(after))
    s = s.withColumn("capped", F.col("level") * F.col("weight") > F.col("most"))
    level = F.max(F.when(~F.col("capped"), F.col("level"))).over(Window.partitionBy())
    return s.withColumn("target", F.when(F.col("capped"), F.col("most").cast("double")).otherwise(F.least(level * F.col("weight"), F.col("most").cast("double"))))


def rates(words: DataFrame, max_repeat: int) -> DataFrame:
    """words: (source, lean, words, target), a row a propensity of a source -> (source, rate), so that the sum of words * min(rate * lean, max_repeat) is the target."""
    w = Window.partitionBy("source").orderBy(F.col("lean").desc())
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing)
    # From the greatest propensity down: those that stop come first, the others share what is left.
    left = F.col("target") - max_repeat * F.coalesce(F.sum("words").over(before), F.lit(0))
    s = words.where("lean > 0 AND words > 0").withColumn("level", left / F.sum(F.col("words") * F.col("lean")).over(after)).withColumn("stops", F.col("level") * F.col("lean") > max_repeat)
    return s.groupBy("source").agg(F.coalesce(F.max(F.when(~F.col("stops"), F.col("level"))), F.max(max_repeat / F.col("lean"))).alias("rate"))


def repeats(base: DataFrame) -> DataFrame:
    """(__s, __h): source and h that several rows of base share."""
    return table(base.groupBy("source", "h").agg(F.count("*").alias("c")).where("c > 1").select(F.col("source").alias("__s"), F.col("h").alias("__h")))


def numbered(full: DataFrame, twice: DataFrame) -> DataFrame:
    """full, where h of rows that share it with others goes with their number; a group of many is numbered partition by partition."""
    same = F.col("source").eqNullSafe(F.col("__s")) & (F.col("h") == F.col("__h"))
    again = table(full.join(twice, same, "left_semi")).withColumn("part", F.spark_partition_id())
    counts = again.groupBy("source", "h", "part").agg(F.count("*").alias("c"))
    w = Window.partitionBy("source", "h").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = counts.select(F.col("source").alias("__s"), F.col("h").alias("__h"), F.col("part").alias("__p"), F.coalesce(F.sum("c").over(w), F.lit(0)).alias("first"))
    own = again.withColumn("nth", F.row_number().over(Window.partitionBy("source", "h", "part").orderBy("size")).cast("long") - 1)
    own = own.join(first, same & (F.col("part") == F.col("__p"))).withColumn("nth", F.col("nth") + F.col("first"))
    own = table(own.withColumn("h", F.when(F.col("nth") > 0, F.xxhash64("h", "nth")).otherwise(F.col("h"))).select(*full.columns))
    return full.join(twice, same, "left_anti").unionByName(own)


def mix(docs: DataFrame, seed: int = 17, propensity: str | None = None, size_power: float = 0.25, max_repeat: int = 3, cycle: int = 3, fills: int = 3) -> DataFrame:
    """docs and, as last column, a struct `mix` (size, source_size, target, copies, taken)."""
    lean = docs[propensity].cast("double") if propensity else F.lit(None).cast("double")
    h = F.xxhash64(F.lit(seed), docs["doc_id"], docs["text"])
    full = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].alias("source"), word_count(docs["text"]).alias("size"), lean.alias("lean"), h.alias("h"))
    base = table(full.drop("row"))
    twice = repeats(base)
    if not twice.isEmpty():
        full = numbered(full, twice)
        base = table(full.drop("row"))

    def leaning(df: DataFrame) -> DataFrame:
        given = F.coalesce("lean", F.lit(1.0)) if propensity else F.pow(F.greatest("size", F.lit(1)), F.lit(size_power))
        return df.withColumn("lean", given).withColumn("lean", F.when(F.col("lean") > 0, F.pow(F.lit(2.0), F.round(F.log2("lean") * 8) / 8)).otherwise(0.0))

    sums = table(leaning(base).groupBy("source", "lean").agg(F.sum("size").alias("words")))
    t = table(targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")), cycle, max_repeat).select("source", "source_size", "target"))
    t = with_source(t, rates(with_source(sums, t), max_repeat))
    t = table(t.withColumn("rate", F.coalesce("rate", F.lit(0.0))))
    rate = t.select("source", "rate")

    def ranked(df: DataFrame) -> DataFrame:
        """Adds whole, the rank q (null where nothing is left to chance), and its bins: bin, and fine within it. A column a step, so that none is computed twice."""
        df = leaning(with_source(df, rate)).withColumn("expected", F.least(F.col("rate") * F.col("lean"), F.lit(float(max_repeat))))
        df = df.withColumn("whole", F.floor(F.col("expected") + 1e-9)).withColumn("p", F.col("expected") - F.col("whole"))
        df = df.withColumn("p", F.when(F.col("p") > 1e-9, F.least(F.lit(1 - 1e-9), "p"))).withColumn("u", (F.shiftrightunsigned("h", 11) + F.lit(0.5)) * F.lit(2.0**-53))
        df = df.withColumn("q", F.col("u") / (1 - F.col("u")) * (1 - F.col("p")) / F.col("p")).withColumn("at", F.col("q") / (1 + F.col("q")) * BINS)
        df = df.withColumn("bin", F.floor("at").cast("int")).withColumn("fine", F.floor((F.col("at") - F.col("bin")) * BINS).cast("int"))
        return df.drop("rate", "expected", "lean", "p", "u", "at")

    def edge_of(hist: DataFrame, name: str) -> DataFrame:
        """Of each source the last bin that begins within what is left to sample, and the words before it. hist: source, bin, words, left."""
        in_order = Window.partitionBy("source").orderBy("bin")
        hist = hist.withColumn("before", F.sum("words").over(in_order) - F.col("words")).where(F.col("before") <= F.col("left"))
        return hist.groupBy("source").agg(F.max("bin").alias(name), F.max("before").alias("before"), F.max("left").alias("left"))

    base = table(ranked(base))
    t = t.drop("rate")
    hist = base.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("whole") * F.col("size")).alias("certain"))
    hist = table(with_source(hist, t))
    left = hist.groupBy("source").agg(F.greatest(F.first("target") - F.sum("certain"), F.lit(0.0)).alias("left"))
    edges = table(with_source(t, edge_of(with_source(hist.where("bin IS NOT NULL").select("source", "bin", "words"), left), "edge")))
    near = table(with_source(base, edges.select("source", "edge", "before", "left")).where(F.col("bin") == F.col("edge")))
    within = near.groupBy("source", F.col("fine").alias("bin")).agg(F.sum("size").alias("words"), F.first(F.col("left") - F.col("before")).alias("left"))
    fine = edge_of(within, "fine_edge").select("source", "fine_edge", F.col("before").alias("further"))
    edges = with_source(edges, fine)
    edges = table(edges.withColumn("before", F.col("before") + F.coalesce("further", F.lit(0))).drop("further"))
    w = Window.partitionBy("source").orderBy("q", "h").rowsBetween(Window.unboundedPreceding, 0)
    at_edge = with_source(near.drop("edge", "before", "left"), edges).where(F.col("fine") == F.col("fine_edge"))
    ended = at_edge.withColumn("sum", F.col("before") + F.sum("size").over(w)).where(F.col("sum") <= F.col("left"))
    t = with_source(edges, ended.groupBy("source").agg(F.max(F.struct("q", "h")).alias("last"), F.max("sum").alias("sum")))
    up_to = (F.col("bin") < F.col("edge")) | (F.col("bin") == F.col("edge")) & ((F.col("fine") < F.col("fine_edge")) | (F.col("fine") == F.col("fine_edge")) & (F.struct("q", "h") <= F.col("last")))
    t = table(t.select("*", (F.col("left") - F.coalesce("sum", "before")).alias("gap"), F.array().cast("array<struct<q:double,h:bigint>>").alias("fills")))
    taken = F.coalesce(up_to, F.lit(False)) | F.coalesce(F.array_contains("fills", F.struct("q", "h")), F.lit(False))
    for i in range(fills):  # the last one may pass the target
        most = F.col("gap") if i + 1 < fills else 2 * F.col("gap") - 1e-6
        rest = with_source(base, t).where(~taken & (F.col("size") > 0) & (F.col("whole") < max_repeat) & (F.col("size") <= most) & F.col("q").isNotNull())
        found = rest.groupBy("source").agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), "q", "h", "size")).alias("fill"))
        t = with_source(t, found).withColumn("gap", F.col("gap") - F.coalesce("fill.size", F.lit(0)))
        t = table(t.withColumn("fills", F.when(F.col("fill").isNull(), F.col("fills")).otherwise(F.array_append("fills", F.struct("fill.q", "fill.h")))).drop("fill"))
    out = with_source(ranked(full), t).withColumn("copies", (F.col("whole") + taken.cast("int")).cast("int"))
    return out.select("row.*", F.struct("size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken")).alias(free_name(docs, "mix")))


def repeat_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken."""
    out = mix(docs, **options)
    name = out.columns[-1]
    return out.where(F.col(f"{name}.copies") > 0).withColumn(name, F.explode(F.sequence(F.lit(1), F.col(f"{name}.copies")))).drop(name)


def with_source(df: DataFrame, dim: DataFrame) -> DataFrame:
    s = dim.withColumnRenamed("source", "__s")
    return join_small(df, s, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
