"""Windows over long streams in two levels, so that no task sorts a whole stream.

A stream (a key) is cut into spans of its order: 65,536 numbers or an hour, unless said
otherwise. Spans are the partitions of the windows; what a row needs from before its span
is brought to the span as a few further rows:

* `looking_back`: windows of a bounded number of rows get the last rows of earlier spans,
  however few rows those have;
* `ranging_back`: windows of a bounded distance get the rows of that distance;
* `running`: totals, least, most and latest values from a stream's start get one row with
  the value that all earlier spans come to. A span's summary is an aggregate, combined
  before the shuffle; summaries are scanned, a row a span; no row of the stream moves twice.

Results are those of one window over the whole stream. Null keys are keys, rows of null
order are a span of their own before all others, ties in the order are as in a window.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Length of a span: numbers, or seconds of a time.
NUMBERS, SECONDS = 65_536, 3600
SPAN, OWN, BACK = "__span", "__own", "__back"


def span_of(df: DataFrame, order: str, length: float | None = None) -> Column:
    """The span of each row: floor(order / length). Times count in seconds; of a struct, the first field counts."""
    kind, at = df.schema[order].dataType, F.col(order)
    while isinstance(kind, T.StructType):
        at, kind = at[kind.fields[0].name], kind.fields[0].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.floor(F.unix_micros(at.cast("timestamp")) / int((length or SECONDS) * 1_000_000))
    return F.floor(at / (length or NUMBERS))


def _windows(keys: list[str], order: str) -> WindowSpec:
    return Window.partitionBy(*keys, SPAN).orderBy(OWN, order)


def _done(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    return rows.withColumns(columns).where(OWN).drop(SPAN, OWN, BACK)


def looking_back(df: DataFrame, keys: list[str], order: str, rows: int, columns: Callable[[WindowSpec], dict[str, Column]], span: float | None = None) -> DataFrame:
    """df with columns over a window that looks back at most `rows` rows: columns(window) gives them by name."""
    d = df.withColumn(SPAN, span_of(df, order, span))
    # Of each span: the spans after it that its rows may be needed in, and the rows between.
    n = d.groupBy(*keys, SPAN).agg(F.count("*").alias("__n"))
    w = Window.partitionBy(*keys).orderBy(SPAN)
    n = n.withColumn("__to", F.sum("__n").over(w))
    after = F.collect_list(F.struct(F.col(SPAN).alias("s"), (F.col("__to") - F.col("__n")).alias("before"))).over(w.rowsBetween(1, rows))
    between = F.transform(after, lambda x: F.struct(x["s"].alias("s"), (x["before"] - F.col("__to")).alias("gap")))
    named = {c: f"__k{i}" for i, c in enumerate((*keys, SPAN))}
    n = n.select(*(F.col(c).alias(k) for c, k in named.items()), F.filter(between, lambda x: x["gap"] < rows).alias("__after")).where("size(__after) > 0")
    last = d.withColumn(BACK, F.row_number().over(Window.partitionBy(*keys, SPAN).orderBy(F.desc(order)))).where(F.col(BACK) <= rows)
    last = last.join(n, _all([F.col(c).eqNullSafe(F.col(k)) for c, k in named.items()])).withColumn("__a", F.explode("__after"))
    last = last.where(F.col("__a.gap") + F.col(BACK) <= rows).select(*df.columns, F.col("__a.s").alias(SPAN), F.lit(False).alias(OWN))
    return _done(d.withColumn(OWN, F.lit(True)).unionByName(last), columns(_windows(keys, order)))


def _all(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def ranging_back(df: DataFrame, keys: list[str], order: str, distance: int, columns: Callable[[WindowSpec], dict[str, Column]], span: int | None = None) -> DataFrame:
    """df with columns over a window that looks back at most `distance` units of a numeric order. The window orders by that alone, so it may be ranged."""
    length = max(span or NUMBERS, distance)
    own = F.floor(F.col(order) / length)
    also = F.when(F.pmod(F.col(order), F.lit(length)) >= length - distance, F.array(own, own + 1)).otherwise(F.array(own))
    d = df.withColumn(SPAN, F.explode(also)).withColumn(OWN, F.col(SPAN).eqNullSafe(own))
    return _done(d, columns(Window.partitionBy(*keys, SPAN).orderBy(order)))


#: How a running value is taken: from rows, from summaries of spans, and over a window.
KINDS: dict[str, tuple[Callable, Callable]] = {
    "total": (lambda x, order: F.sum(x), F.sum),
    "least": (lambda x, order: F.min(x), F.min),
    "most": (lambda x, order: F.max(x), F.max),
    "latest": (lambda x, order: F.max_by(x, F.when(x.isNotNull(), F.col(order))), lambda x: F.last(x, ignorenulls=True)),
}


def running(df: DataFrame, keys: list[str], order: str, values: dict[str, tuple[str, Column]], span: float | None = None, peers: bool = True, before: bool = False, then: Callable[[WindowSpec], dict[str, Column]] | None = None) -> DataFrame:
    """df with running values from the start of each key's rows: name -> (total, least, most or latest, of what).

    latest is the last that isn't null. Rows of equal order count together if peers; before
    leaves the row itself out. then(window) gives further columns over the same windows,
    which see what was carried over as a row before the span's.
    """
    names = {name: f"__v{i}" for i, name in enumerate(values)}
    d = df.withColumn(SPAN, span_of(df, order, span)).withColumns({names[k]: x for k, (_, x) in values.items()})
    summary = d.groupBy(*keys, SPAN).agg(*(KINDS[kind][0](F.col(names[k]), order).alias(names[k]) for k, (kind, _) in values.items()))
    w = Window.partitionBy(*keys).orderBy(SPAN).rowsBetween(Window.unboundedPreceding, -1)
    carried = summary.select(*keys, SPAN, *(KINDS[kind][1](F.col(names[k])).over(w).alias(names[k]) for k, (kind, _) in values.items()), F.lit(False).alias(OWN))
    rows = d.withColumn(OWN, F.lit(True)).unionByName(carried, allowMissingColumns=True)
    of = _windows(keys, order)
    framed = of.rowsBetween(Window.unboundedPreceding, -1) if before else of if peers else of.rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: KINDS[kind][1](F.col(names[k])).over(framed) for k, (kind, _) in values.items()})
    return _done(rows.withColumns(then(of)) if then else rows, {}).drop(*names.values())
