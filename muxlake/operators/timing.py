"""Window operators over ordered streams (W-family) and the batch forms of the streaming ones (T-family).

Streams run side by side, and each is cut into spans of its order (operators/scan.py), so
no task sorts a whole stream. `span` is the length of a span: numbers of the order, or
seconds where it is a time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions.times import micros
from muxlake.operators.scan import looking_back, ranging_back, running

FRAME_MS = 24
STREAM = ["stream_id"]


def frame_count_gaps(frames: DataFrame, modulus: int = 250, span: float | None = None) -> DataFrame:
    """Frames whose count isn't the one before plus 1, modulo 250."""
    f = looking_back(frames, STREAM, "frame_no", 1, lambda w: {"expected": (F.lag("fc").over(w) + 1) % modulus}, span)
    return f.where(F.col("expected").isNotNull() & (F.col("fc") != F.col("expected")))


def counter_discontinuity(frames: DataFrame, counter: str = "counter", critical: int = 10, span: float | None = None) -> DataFrame:
    f = looking_back(frames, STREAM, "frame_no", 1, lambda w: {"step": F.col(counter) - F.lag(counter).over(w)}, span)
    return f.where("step IS NOT NULL AND step <> 1").withColumn("severity", F.when(F.abs("step") > critical, "critical").otherwise("warning"))


def sequence_loss(packets: DataFrame, order: str = "arrival", bits: int = 16, span: float | None = None) -> DataFrame:
    """Per packet: lost before it, duplicate, out of order. A step of half the range or more is reordering, not loss."""
    size = 1 << bits
    p = looking_back(packets, STREAM, order, 1, lambda w: {"step": F.pmod(F.col("seq") - F.lag("seq").over(w), F.lit(size))}, span)
    return p.select(
        "*", F.when(F.col("step").isNull() | (F.col("step") == 0) | (F.col("step") >= size // 2), 0).otherwise(F.col("step") - 1).alias("lost"),
        F.coalesce(F.col("step") == 0, F.lit(False)).alias("duplicate"), F.coalesce(F.col("step") >= size // 2, F.lit(False)).alias("reordered"),
    ).drop("step")


def rtp_statistics(packets: DataFrame) -> DataFrame:
    """Over sequence_loss: packets, bytes, lost, share lost."""
    n, lost = F.count("*"), F.sum("lost")
    return packets.groupBy("stream_id").agg(n.alias("packets"), F.sum("n_bytes").alias("n_bytes"), lost.alias("lost"), F.round(F.when(n + lost > 0, lost / (n + lost)).otherwise(0.0), 6).alias("loss_rate"))


def transit_difference(packets: DataFrame, clock: float = 48_000.0, span: float | None = None) -> DataFrame:
    """|arrival step - timestamp step| in ms of consecutive packets, the input of the jitter filter."""

    def steps(w):
        arrived = (micros("arrival") - micros(F.lag("arrival").over(w))) / 1000
        stamped = (F.col("rtp_ts") - F.lag("rtp_ts").over(w)) / clock * 1000
        return {"difference": F.abs(arrived - stamped)}

    return looking_back(packets, STREAM, "arrival", 1, steps, span)


def rtp_jitter(packets: DataFrame, alpha: float = 0.125, session: int = 65_536, span: float | None = None) -> DataFrame:
    """Exponential mean of the transit difference at the end of each `session` packets of a stream; it begins with the first difference and goes on over sessions.

    A session is a straight line of the mean before it: j -> a * j + b. Sessions are folded side by side, then their lines one after the other.
    """
    d = transit_difference(packets, span=span).where("difference IS NOT NULL")
    d = running(d, STREAM, "arrival", {"number": ("total", F.lit(1))}, span, peers=False).withColumn("session", F.floor((F.col("number") - 1) / session))
    rows = d.groupBy("stream_id", "session").agg(F.array_sort(F.collect_list(F.struct(micros("arrival").alias("at"), "difference"))).alias("rows"))
    line = F.aggregate("rows", F.lit(0.0), lambda j, r: j + (r["difference"] - j) * alpha)
    rows = rows.select("stream_id", "session", F.size("rows").alias("n"), F.col("rows")[0]["difference"].alias("first"), line.alias("b"), F.pow(F.lit(1 - alpha), F.size("rows")).alias("a"))
    of = rows.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("session", "n", "first", "a", "b"))).alias("s"))
    begin = F.struct(F.col("s")[0]["first"].alias("j"), F.array().cast("array<struct<session:bigint,n:int,jitter:double>>").alias("out"))

    def step(z: Column, x: Column) -> Column:
        j = x["a"] * z["j"] + x["b"]
        return F.struct(j.alias("j"), F.array_append(z["out"], F.struct(x["session"].alias("session"), x["n"].alias("n"), j.alias("jitter"))).alias("out"))

    return of.select("stream_id", F.inline(F.aggregate("s", begin, step, lambda z: z["out"]))).withColumn("jitter", F.round("jitter", 6))


def fig_intervals(figs: DataFrame, span: float | None = None) -> DataFrame:
    return looking_back(figs, ["stream_id", "fig_type", "ext"], "frame_no", 1, lambda w: {"interval_ms": (F.col("frame_no") - F.lag("frame_no").over(w)) * FRAME_MS}, span)


def tist_steps(frames: DataFrame, tolerance: float = 5.0, span: float | None = None) -> DataFrame:
    """Frames whose time stamp isn't 24 ms after the one before, within the tolerance."""
    f = looking_back(frames, STREAM, "frame_no", 1, lambda w: {"step_ms": F.round(F.col("tist_ms") - F.lag("tist_ms").over(w), 6)}, span)
    return f.where(F.abs(F.col("step_ms") - FRAME_MS) > tolerance)


def clock_drift_ppm(frames: DataFrame, samples: int = 100, least: int = 10, span: float | None = None) -> DataFrame:
    """Drift of offset_ms against at_s over the last samples rows, in parts per million; null under `least` rows."""

    def drifts(w):
        w = w.rowsBetween(1 - samples, 0)
        length = F.last("at_s").over(w) - F.first("at_s").over(w)
        drift = (F.last("offset_ms").over(w) - F.first("offset_ms").over(w)) / length * 1000
        return {"drift_ppm": F.when((F.count("*").over(w) >= least) & (length > 0), F.round(drift, 4))}

    return looking_back(frames, STREAM, "frame_no", samples - 1, drifts, span)


def error_runs(frames: DataFrame, least: int = 5, span: float | None = None) -> DataFrame:
    """Runs of at least `least` consecutive frames that aren't valid."""
    bad = running(frames, STREAM, "frame_no", {"run": ("total", F.col("valid").cast("int"))}, span).where("NOT valid")
    return bad.groupBy("stream_id", "run").agg(F.min("frame_no").alias("first_frame"), F.max("frame_no").alias("last_frame"), F.count("*").alias("length")).where(F.col("length") >= least).drop("run")


def reconfigurations(elements: DataFrame) -> DataFrame:
    """Frames in which an element (kind, value) of a stream stands for the first time; the first lock-in counts."""
    first = elements.groupBy("stream_id", "kind", "value").agg(F.min("frame_no").alias("frame_no"))
    return first.groupBy("stream_id", "frame_no").agg(F.count("*").alias("added"))


def carry_forward(frames: DataFrame, *columns: str, span: float | None = None) -> DataFrame:
    """columns with the last value so far where they are null."""
    return running(frames, STREAM, "frame_no", {c: ("latest", F.col(c)) for c in columns}, span, peers=False)


def changes(rows: DataFrame, columns: list[str], key: str = "stream_id", order: str = "ts", span: float | None = None) -> DataFrame:
    """Rows in which one of the columns differs from the row before; null-safe; the first row counts."""

    def new(w):
        same = F.lit(True)
        for c in columns:
            same = same & F.col(c).eqNullSafe(F.lag(c).over(w))
        return {"_new": ~same | (F.row_number().over(w) == 1)}

    return looking_back(rows, [key], order, 1, new, span).where("_new").drop("_new")


def rolling_rate(rows: DataFrame, seconds: int = 60, span: int | None = None) -> DataFrame:
    """(n - 1) / span of the rows of the last seconds."""

    def rates(w):
        w = w.rangeBetween(-seconds * 1_000_000, 0)
        length = (F.max("at_us").over(w) - F.min("at_us").over(w)) / 1e6
        return {"rate": F.when(length > 0, F.round((F.count("*").over(w) - 1) / length, 6))}

    return ranging_back(rows.withColumn("at_us", micros("ts")), STREAM, "at_us", seconds * 1_000_000, rates, (span or 3600) * 1_000_000).drop("at_us")


def error_rate_window(errors: DataFrame, seconds: int = 60, span: int | None = None) -> DataFrame:
    """Errors and critical ones of the last seconds at each error, and the last critical time."""
    critical = F.col("severity") == "critical"

    def recent(w):
        r = w.rangeBetween(-seconds * 1_000_000, 0)
        return {"recent": F.count("*").over(r), "recent_critical": F.count_if(critical).over(r)}

    e = ranging_back(errors.withColumn("at_us", micros("ts")), STREAM, "at_us", seconds * 1_000_000, recent, (span or 3600) * 1_000_000).drop("at_us")
    return running(e, STREAM, "ts", {"last_critical": ("latest", F.when(critical, F.col("ts")))}, span)


def trend(series: DataFrame, key: str, order: str, value: str = "value", rising_is_bad: bool = False, span: float | None = None) -> DataFrame:
    """Least-squares slope over the index; over 0.1 improving, under -0.1 declining."""
    t = running(series, [key], order, {"x": ("total", F.lit(1.0))}, span, peers=False).groupBy(key).agg(F.regr_slope(value, "x").alias("slope"))
    s = -F.col("slope") if rising_is_bad else F.col("slope")
    return t.select(key, F.round("slope", 6).alias("slope"), F.when(s > 0.1, "improving").when(s < -0.1, "declining").otherwise("stable").alias("trend"))


def trend_forecast(series: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Slope an hour, value one hour after the last, r2 as confidence, volatile where the deviation passes half the mean. An aggregate: a line doesn't depend on where its hours begin."""
    both = F.col("h").isNotNull() & F.col(value).isNotNull()
    mean = lambda c: F.avg(F.when(both, F.col(c)))
    out = series.withColumn("h", micros("ts") / 3.6e9).groupBy(key).agg(F.regr_slope(value, "h").alias("a"), mean("h").alias("mean_h"), mean(value).alias("mean_v"), F.regr_r2(value, "h").alias("r2"), F.max("h").alias("last"), (F.stddev_pop(value) > 0.5 * F.avg(value)).alias("volatile"))
    next_ = F.col("mean_v") + F.col("a") * (F.col("last") + 1 - F.col("mean_h"))
    return out.select(key, F.round("a", 6).alias("slope_per_hour"), F.round(next_, 4).alias("next_hour"), F.round("r2", 6).alias("confidence"), "volatile")


def anomalies(series: DataFrame, keys: list[str], order: str, value: str = "value", history: int = 20, z: float = 3.0, span: float | None = None) -> DataFrame:
    """Rows more than z deviations from the mean of the `history` rows before."""

    def scores(w):
        w = w.rowsBetween(-history, -1)
        sd = F.stddev_pop(value).over(w)
        return {"z": F.round(F.when((F.count("*").over(w) >= history) & (sd > 0), (F.col(value) - F.avg(value).over(w)) / sd), 4)}

    return looking_back(series, keys, order, history, scores, span).where(F.abs("z") > z)


def consecutive_violations(periods: DataFrame, k: int = 3, key: str = "stream_id", order: str = "ts", span: float | None = None) -> DataFrame:
    """Rows that end k violating periods in a row."""

    def runs(w):
        w = w.rowsBetween(1 - k, 0)
        return {"_all": F.min(F.col("violating").cast("int")).over(w), "_n": F.count("*").over(w)}

    return looking_back(periods, [key], order, k - 1, runs, span).where(f"_all = 1 AND _n = {k}").drop("_all", "_n")


def measurement_stats(series: DataFrame, keys: list[str], order: str, rows: int = 10, span: float | None = None) -> DataFrame:
    """Least, most, mean and deviation of the last rows."""

    def stats(w):
        w = w.rowsBetween(1 - rows, 0)
        of = F.min("value"), F.max("value"), F.avg("value"), F.stddev_pop("value")
        low, high, mean, deviation = (x.over(w) for x in of)
        return {"least": low, "most": high, "mean": F.round(mean, 6), "deviation": F.round(deviation, 4)}

    return looking_back(series, keys, order, rows - 1, stats, span)


def first_seen_rank(rows: DataFrame, key: str, order: str, span: float | None = None) -> DataFrame:
    """Keys by when they were first seen: 1 for the first, no gaps."""
    first = rows.groupBy(key).agg(F.min(order).alias("first"))
    rank = running(first.select("first").distinct(), [], "first", {"seen_rank": ("total", F.lit(1))}, span)
    rank = rank.select(F.col("first").alias("_at"), F.col("seen_rank").cast("int").alias("seen_rank"))
    return first.join(rank, F.col("first").eqNullSafe(F.col("_at"))).drop("_at")


def latest_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by an aggregate (combined before the shuffle), not a sort."""
    others = [c for c in rows.columns if c not in keys]
    top = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return rows.groupBy(*keys).agg(top).select(*keys, "_row.*")


def running_quality(frames: DataFrame, session: int = 65_536, up: float = 0.01, down: float = 0.05) -> DataFrame:
    """+up a good and -down a bad frame, within 0 to 1, from 1 at the start of a stream: the quality after each `session` frame numbers.

    A session takes q to min(high, max(low, q + c)). Sessions are folded side by side, then one after the other.
    """
    s = frames.withColumn("session", F.floor(F.col("frame_no") / session))
    rows = s.groupBy("stream_id", "session").agg(F.array_sort(F.collect_list(F.struct("frame_no", "valid"))).alias("rows"))
    within = lambda x: F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))

    def fold(z: Column, r: Column) -> Column:
        d = F.when(r["valid"], up).otherwise(-down)
        return F.struct((z["c"] + d).alias("c"), within(z["low"] + d).alias("low"), within(z["high"] + d).alias("high"))

    begin = F.struct(F.lit(0.0).alias("c"), F.lit(0.0).alias("low"), F.lit(1.0).alias("high"))
    of = rows.select("stream_id", "session", F.aggregate("rows", begin, fold).alias("z")).groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("session", "z"))).alias("s"))

    def step(z: Column, x: Column) -> Column:
        q = F.least(x["z"]["high"], F.greatest(x["z"]["low"], z["q"] + x["z"]["c"]))
        return F.struct(q.alias("q"), F.array_append(z["out"], F.struct(x["session"].alias("session"), q.alias("quality"))).alias("out"))

    start = F.struct(F.lit(1.0).alias("q"), F.array().cast("array<struct<session:bigint,quality:double>>").alias("out"))
    return of.select("stream_id", F.inline(F.aggregate("s", start, step, lambda z: z["out"]))).withColumn("quality", F.round("quality", 6))


def silence_runs(levels: DataFrame, threshold: float = -60.0, warn_s: float = 5.0, critical_s: float = 10.0, key: str = "stream_id", order: str = "ts", span: float | None = None) -> DataFrame:
    """Runs of levels under the threshold that last at least warn_s."""
    loud = (F.col("level") >= threshold).cast("int")
    quiet = running(levels, [key], order, {"run": ("total", loud)}, span).where(F.col("level") < threshold)
    runs = quiet.groupBy(key, "run").agg(F.min(order).alias("start"), F.max(order).alias("end"), F.count("*").alias("n"))
    runs = runs.withColumn("seconds", F.round((micros("end") - micros("start")) / 1e6, 6)).where(F.col("seconds") >= warn_s)
    return runs.withColumn("severity", F.when(F.col("seconds") >= critical_s, "critical").otherwise("warning")).drop("run")


def zero_crossing_rate(samples: DataFrame, key: str, order: str = "i", value: str = "x", span: float | None = None) -> DataFrame:
    s = looking_back(samples, [key], order, 1, lambda w: {"c": ((F.col(value) >= 0) != (F.lag(value).over(w) >= 0)).cast("int")}, span)
    return s.groupBy(key).agg(F.round(F.sum("c") / (F.count("*") - 1), 6).alias("zero_crossing_rate"))


def target_deviation(series: DataFrame, target: Column, keys: list[str], order: str, share: float = 0.1, span: float | None = None) -> DataFrame:
    """Whether a value is off its target by more than a share; running least and greatest value."""
    s = running(series, keys, order, {"low": ("least", F.col("value")), "high": ("most", F.col("value"))}, span)
    return s.withColumn("off_target", F.abs(F.col("value") - target) > share * target)


# Batch forms of streaming operators; streaming/ has the stateful ones.


def service_status(sightings: DataFrame, timeout_s: int = 60, span: float | None = None) -> DataFrame:
    """Sightings after which a service was not seen for the timeout."""
    s = sightings.withColumn("_until", -micros("ts"))  # the next sighting is the one before, the other way round
    s = looking_back(s, ["stream_id", "sid"], "_until", 1, lambda w: {"gap_s": (F.col("_until") - F.lag("_until").over(w)) / 1e6}, (span or 3600) * 1_000_000)
    return s.drop("_until").where(F.col("gap_s").isNull() | (F.col("gap_s") > timeout_s))


def bandwidth(packets: DataFrame, every: str = "1 second") -> DataFrame:
    """Mbit/s a stream and window."""
    w = packets.groupBy("stream_id", F.window("ts", every).alias("w")).agg(F.sum("n_bytes").alias("n_bytes"))
    seconds = (micros("w.end") - micros("w.start")) / 1e6
    return w.select("stream_id", F.col("w.start").alias("window_start"), F.round(F.col("n_bytes") * 8 / seconds / 1e6, 9).alias("mbit_s"))


def sliding_metrics(series: DataFrame, length: str = "5 minutes", every: str = "1 minute", key: str = "metric") -> DataFrame:
    w = series.groupBy(key, F.window("ts", length, every).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return w.select(key, F.col("w.start").alias("window_start"), "n", "mean")


def outage_sessions(events: DataFrame, gap: str = "10 minutes", warn_s: int = 30, critical_s: int = 120) -> DataFrame:
    """Sessions of outage events no further apart than the gap; seconds from the first to the last event."""
    s = events.groupBy("stream_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.min("ts").alias("start"), F.max("ts").alias("end"))
    seconds = (micros("end") - micros("start")) / 1e6
    return s.select("stream_id", "start", "end", "n", F.when(seconds >= critical_s, "critical").when(seconds >= warn_s, "warning").otherwise("info").alias("severity"))


def reconfig_rate(changes_: DataFrame, warn: int = 3, critical: int = 10) -> DataFrame:
    w = changes_.groupBy("stream_id", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return w.select("stream_id", F.col("w.start").alias("window_start"), "n", F.when(F.col("n") >= critical, "critical").when(F.col("n") >= warn, "warning").otherwise("info").alias("severity"))


def error_rates(frames: DataFrame, every: str = "1 hour", warn: float = 0.01, critical: float = 0.05) -> DataFrame:
    rate = F.count_if("errored") / F.count("*")
    w = frames.groupBy("stream_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), rate.alias("rate"))
    return w.select("stream_id", F.col("w.start").alias("window_start"), "n", F.round("rate", 6).alias("rate"), F.when(F.col("rate") >= critical, "critical").when(F.col("rate") >= warn, "warning").otherwise("info").alias("severity"))


def frame_loss(frames: DataFrame, every: str = "1 hour", expected: int = 100) -> DataFrame:
    """Receive rate against what a window should have, mean and greatest latency, quality gate."""
    w = frames.groupBy("stream_id", F.window("ts", every).alias("w")).agg(F.count("*").alias("n"), F.round(F.avg("latency"), 6).alias("avg_latency"), F.max("latency").alias("max_latency"))
    rate = F.col("n") / expected
    return w.select("stream_id", F.col("w.start").alias("window_start"), "n", F.round(rate, 6).alias("receive_rate"), "avg_latency", "max_latency", (rate >= 0.95).alias("good"))


def late_frames(frames: DataFrame, allowed_s: int = 600, arrival: str = "frame_no", span: float | None = None) -> DataFrame:
    """Rows more than the allowed lateness behind the greatest event time that came before them."""
    f = running(frames, STREAM, arrival, {"_mark": ("most", F.col("ts"))}, span, before=True)
    return f.withColumn("behind_s", F.round((micros("_mark") - micros("ts")) / 1e6, 6)).where(F.col("behind_s") > allowed_s).drop("_mark")


def announcement_events(switches: DataFrame, span: float | None = None) -> DataFrame:
    """start, active or end at each switching message of a cluster; an emergency has bit 0."""

    def states(w):
        before = F.coalesce(F.lag("asw").over(w), F.lit(0))
        return {"event": F.when((F.col("asw") != 0) & (before == 0), "start").when(F.col("asw") != 0, "active").when(before != 0, "end")}

    s = looking_back(switches, ["stream_id", "cluster"], "frame_no", 1, states, span)
    return s.where("event IS NOT NULL").withColumn("emergency", F.col("asw").bitwiseAND(1) == 1)


def failover(health: DataFrame, recovery: int = 3, order: str = "frame_no", span: float | None = None) -> DataFrame:
    """The stream in use at each row: the backup from a bad row on until `recovery` good ones stand in a row; failovers so far."""

    def marks(w):
        w = w.rowsBetween(1 - recovery, 0)
        recovered = (F.min(F.col("healthy").cast("int")).over(w) == 1) & (F.count("*").over(w) >= recovery)
        return {"_mark": F.when(~F.col("healthy"), F.lit(True)).when(recovered, F.lit(False))}

    h = looking_back(health, STREAM, order, recovery - 1, marks, span)
    on = F.coalesce("on_backup", F.lit(False))
    h = running(h, STREAM, order, {"on_backup": ("latest", F.col("_mark"))}, span, peers=False, then=lambda w: {"_switched": (on & ~F.coalesce(F.lag("on_backup").over(w), F.lit(False))).cast("int")})
    return running(h.withColumn("on_backup", on), STREAM, order, {"failovers": ("total", F.col("_switched"))}, span).drop("_mark", "_switched")


def rising(rows: DataFrame, condition: Column, keys: list[str], order: str, span: float | None = None) -> DataFrame:
    """Rows in which the condition holds and didn't in the row before: when an alert is raised."""
    r = rows.withColumn("_on", F.coalesce(condition, F.lit(False)))
    r = looking_back(r, keys, order, 1, lambda w: {"_was": F.coalesce(F.lag("_on").over(w), F.lit(False))}, span)
    return r.where("_on AND NOT _was").drop("_on", "_was")
