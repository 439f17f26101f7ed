"""Operators with keyed state: state variables in RocksDB and event-time timers, by transformWithState.

A processor keeps what it needs in value and map state, so a batch writes what changed and
nothing else, and sets one timer a key for what is due next; on expiry it looks again. All
times are event times in milliseconds, those of the rows and of the watermark.

Input columns that are null: rows of a null time or key number are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

#: The state store that keeps state variables and timers.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def keyed(df: DataFrame, keys: list[str], processor: StatefulProcessor, output: str, ts: str, late: str) -> DataFrame:
    """Runs a processor over each key; the session's state store becomes the one that has timers."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return df.withWatermark(ts, late).groupBy(*keys).transformWithStateInPandas(statefulProcessor=processor, outputStructType=output, outputMode="append", timeMode="eventTime")


def ms(t: pd.Timestamp) -> int:
    return t.value // 1_000_000


class Timed(StatefulProcessor):
    """One timer a key: `due` puts it to a time, or takes it away."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.timer = handle.getValueState("timer", "at long")
        self.states()

    def states(self) -> None:
        raise NotImplementedError

    def due(self, at: int | None, watermark: int) -> None:
        had = self.timer.get()[0] if self.timer.exists() else None
        at = None if at is None else max(at, watermark + 1)  # a timer in the past would never come
        if at == had:
            return
        if had is not None and had > watermark:
            self.handle.deleteTimer(had)
        if at is None:
            self.timer.clear()
        else:
            self.handle.registerTimer(at)
            self.timer.update((at,))

    def close(self) -> None:
        pass


def rows_of(batches: Iterator[pd.DataFrame], *order: str) -> list:
    """All rows of a key in a batch, in order; a key's rows of one batch are what a task has to hold anyway."""
    parts = [g for g in batches if len(g)]
    if not parts:
        return []
    df = pd.concat(parts, ignore_index=True).dropna(subset=list(order))
    return list(df.sort_values(list(order), kind="stable").itertuples(index=False))


def after(seq: int, sent: int, bits: int = 16) -> int:
    """How far a sequence number is ahead of another, modulo 2**bits; not over 0 if it isn't."""
    d = (seq - sent) & ((1 << bits) - 1)
    return d if d < 1 << (bits - 1) else d - (1 << bits)


class Reorder(Timed):
    """Packets in order of their sequence. Held: sequence -> time; sent: the last number that went out, the newest time."""

    def __init__(self, delay: int, oldest: int, strict: bool):
        self.delay, self.oldest, self.strict = delay, oldest, strict

    def states(self) -> None:
        self.held = self.handle.getMapState("held", "seq int", "at long")
        self.mark = self.handle.getValueState("mark", "sent int, newest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        sent, newest = self.mark.get() if self.mark.exists() else (None, 0)
        new = rows_of(rows, "ts", "seq")
        newest = max([newest, *(ms(r.ts) for r in new)])
        held = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        for r in new:
            seq, at = int(r.seq), ms(r.ts)
            if at < newest - self.oldest or seq in held or (sent is not None and after(seq, sent) <= 0):
                continue  # too old, a repeat, or behind what has gone out
            held[seq] = at
            self.held.updateValue((seq,), (at,))
        yield self.release(key, held, sent, newest, newest, now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        self.timer.clear()
        sent, newest = self.mark.get() if self.mark.exists() else (None, 0)
        held = {k[0]: v[0] for k, v in self.held.iterator()} if self.held.exists() else {}
        yield self.release(key, held, sent, newest, max(newest, now), now)

    def release(self, key, held: dict[int, int], sent: int | None, newest: int, clock: int, watermark: int) -> pd.DataFrame:
        base = sent if sent is not None else min(held, key=lambda s: (held[s], s)) if held else 0
        order = sorted(held, key=lambda s: after(s, base))
        ripe = [i for i, s in enumerate(order) if held[s] <= clock - self.delay]
        out = order[: ripe[-1] + 1] if ripe else []  # one that is ripe takes those before it along
        if self.strict:  # a gap holds back what is behind it, until that is as old as may be
            going, last = [], sent
            for s in out:
                if last is not None and after(s, last) != 1 and held[s] > clock - self.oldest:
                    break
                going.append(s)
                last = s
            out = going
        rows = []
        for s in out:
            rows.append((*key, s, held[s], held[s] < clock - 2 * self.delay))
            self.held.removeKey((s,))
        left = [held[s] for s in order[len(out) :]]
        self.mark.update((out[-1] if out else sent, newest))
        wait = self.oldest if self.strict and left and min(left) <= clock - self.delay else self.delay
        self.due(min(left) + wait if left else None, watermark)
        return pd.DataFrame(rows, columns=["stream_id", "seq", "at_ms", "late"])


def reorder_stream(packets: DataFrame, delay_ms: int = 200, oldest_ms: int = 5000, late: str = "5 seconds", strict: bool = False) -> DataFrame:
    """Jitter buffer (stream_id, seq, at_ms, late): packets of a stream in order of their sequence, modulo 65536, released when they are older than the delay against the newest, or against the watermark where nothing comes.

    late: it went out over twice the delay after its time. Packets that come after a later
    one was released, repeats, and those older than `oldest` as they come are dropped.
    strict: a missing number holds back the later ones until they are `oldest`.
    """
    return keyed(packets.select("stream_id", "seq", "ts"), ["stream_id"], Reorder(delay_ms, oldest_ms, strict), "stream_id string, seq int, at_ms long, late boolean", "ts", late)


class Fragments(Timed):
    """Parts of one packet: index -> payload, and counts. Kept after the packet is whole, until the timeout, so that late repeats are known as such."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def states(self) -> None:
        self.parts = self.handle.getMapState("parts", "findex int", "payload binary")
        self.counts = self.handle.getValueState("counts", "fcount int, got int, duplicates int, out_of_order int, invalid int, highest int, done boolean, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        fcount, got, duplicates, behind, invalid, highest, done, latest = self.counts.get() if self.counts.exists() else (0, 0, 0, 0, 0, -1, False, 0)
        out = []
        for r in rows_of(rows, "ts", "findex"):
            latest, i = max(latest, ms(r.ts)), int(r.findex)
            if r.fcount != r.fcount or not 0 <= i < r.fcount:
                invalid += 1
            elif done or self.parts.containsKey((i,)):
                duplicates += 1
            else:
                self.parts.updateValue((i,), (bytes(r.payload),))
                fcount, got, behind, highest = int(r.fcount), got + 1, behind + (i < highest), max(highest, i)
                if got == fcount:
                    out.append((*key, True, got, duplicates, behind, invalid, b"".join(self.parts.getValue((j,))[0] for j in range(fcount))))
                    self.parts.clear()
                    done = True
        self.counts.update((fcount, got, duplicates, behind, invalid, highest, done, latest))
        self.due(latest + self.timeout, now)
        yield pd.DataFrame(out, columns=PACKET)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        _, got, duplicates, behind, invalid, _, done, _ = self.counts.get()
        for s in (self.parts, self.counts, self.timer):
            s.clear()
        yield pd.DataFrame([] if done else [(*key, False, got, duplicates, behind, invalid, None)], columns=PACKET)


PACKET = ["stream_id", "pseq", "complete", "got", "duplicates", "out_of_order", "invalid", "packet"]


def reassemble_pft_stream(fragments: DataFrame, timeout_ms: int = 5000, late: str = "10 seconds") -> DataFrame:
    """Packets when their last fragment comes, or incomplete ones when they time out after their latest fragment.

    fragments: stream_id, pseq, findex, fcount, ts, payload. Counts are those up to the packet's last fragment.
    """
    f = fragments.select("stream_id", "pseq", "findex", "fcount", "ts", "payload")
    return keyed(f, ["stream_id", "pseq"], Fragments(timeout_ms), "stream_id string, pseq int, complete boolean, got int, duplicates int, out_of_order int, invalid int, packet binary", "ts", late)


class Registry(Timed):
    """Whether an announcement is alive, and since when it wasn't heard."""

    def __init__(self, timeout: int):
        self.timeout = timeout

    def states(self) -> None:
        self.heard = self.handle.getValueState("heard", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        alive, last, out = self.heard.exists(), self.heard.get()[0] if self.heard.exists() else 0, []
        for r in rows_of(rows, "ts"):
            at = ms(r.ts)
            if alive and at > last + self.timeout:  # it had expired before this one
                out.append((*key, "expired", last + self.timeout))
                alive = False
            if bool(r.deletion) == alive:
                out.append((*key, "removed" if alive else "added", at))
            alive, last = not r.deletion, max(last, at)
        if alive:
            self.heard.update((last,))
        else:
            self.heard.clear()
        self.due(last + self.timeout + 1 if alive else None, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["stream_id", "event", "at_ms"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        at = self.heard.get()[0] + self.timeout
        self.heard.clear()
        self.timer.clear()
        yield pd.DataFrame([(*key, "expired", at)], columns=["stream_id", "event", "at_ms"])


def announcement_registry_stream(messages: DataFrame, timeout_ms: int = 300_000, late: str = "10 seconds") -> DataFrame:
    """added, removed (by message) or expired announcements, and when. messages: stream_id, ts, deletion."""
    return keyed(messages.select("stream_id", "ts", "deletion"), ["stream_id"], Registry(timeout_ms), "stream_id string, event string, at_ms long", "ts", late)


class Alerts(Timed):
    """An alert of one metric: whether it is active, acknowledged, escalated; when it was last over the limit and last raised."""

    def __init__(self, limit: float, hold: int, gap: int, escalate: int):
        self.limit, self.hold, self.gap, self.escalate = limit, hold, gap, escalate

    def states(self) -> None:
        self.alert = self.handle.getValueState("alert", "active boolean, acknowledged boolean, escalated boolean, over long, raised long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        s = list(self.alert.get()) if self.alert.exists() else [False, False, False, 0, None]
        out, latest = [], now
        for r in rows_of(rows, "ts"):
            at, value = ms(r.ts), None if r.value != r.value else float(r.value)
            latest = max(latest, at)
            out += self.escalated(key, s, at)
            if r.action == "acknowledge" and s[0] and not s[1]:
                s[1] = True
                out.append((*key, "acknowledged", at, value))
            elif r.action == "resolve" and s[0]:
                s[0] = False
                out.append((*key, "resolved", at, value))
            elif value is not None and value > self.limit:
                s[3] = at
                if not s[0] and (s[4] is None or at - s[4] >= self.gap):
                    s[:3], s[4] = [True, False, False], at
                    out.append((*key, "raised", at, value))
            elif value is not None and s[0] and at - s[3] >= self.hold:
                s[0] = False
                out.append((*key, "cleared", at, value))
        self.keep(s, now)
        yield pd.DataFrame(out, columns=ALERT)

    def escalated(self, key, s: list, at: int) -> list[tuple]:
        if not s[0] or s[1] or s[2] or at < s[4] + self.escalate:
            return []
        s[2] = True
        return [(*key, "escalated", s[4] + self.escalate, None)]

    def keep(self, s: list, now: int) -> None:
        """An active alert stays, and is due when it escalates; another goes when the gap after it is over."""
        if not s[0] and (s[4] is None or now > s[4] + self.gap):
            self.alert.clear()
            self.due(None, now)
            return
        self.alert.update(tuple(s))
        self.due(s[4] + self.gap + 1 if not s[0] else None if s[1] or s[2] else s[4] + self.escalate, now)

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, s = timerValues.getCurrentWatermarkInMs(), list(self.alert.get())
        self.timer.clear()
        out = self.escalated(key, s, now)
        self.keep(s, now)
        yield pd.DataFrame(out, columns=ALERT)


ALERT = ["stream_id", "metric", "event", "at_ms", "value"]


def alert_stream(measurements: DataFrame, limit: float, hold_ms: int = 30_000, least_gap_ms: int = 60_000, escalate_ms: int = 300_000, late: str = "10 seconds") -> DataFrame:
    """raised, acknowledged, escalated, resolved and cleared alerts of each (stream_id, metric).

    measurements: stream_id, metric, ts, value, and action where operators act: acknowledge
    or resolve, else null. A value over the limit raises, at most once a gap; `hold` of
    values below clears; one that is active and not acknowledged for `escalate` escalates.
    """
    from pyspark.sql import functions as F

    action = F.col("action") if "action" in measurements.columns else F.lit(None).cast("string")
    m = measurements.select("stream_id", "metric", "ts", F.col("value").cast("double").alias("value"), action.alias("action"))
    return keyed(m, ["stream_id", "metric"], Alerts(limit, hold_ms, least_gap_ms, escalate_ms), "stream_id string, metric string, event string, at_ms long, value double", "ts", late)


class Status(Timed):
    def __init__(self, timeout: int):
        self.timeout = timeout

    def states(self) -> None:
        self.seen = self.handle.getValueState("seen", "at long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        times, out = [ms(r.ts) for r in rows_of(rows, "ts")], []
        if times:
            if not self.seen.exists():
                out = [(*key, "available", times[0])]
            last = max(times[-1], self.seen.get()[0] if self.seen.exists() else 0)
            self.seen.update((last,))
            self.due(last + self.timeout, timerValues.getCurrentWatermarkInMs())
        yield pd.DataFrame(out, columns=["stream_id", "sid", "status", "at_ms"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        last = self.seen.get()[0]
        self.seen.clear()
        self.timer.clear()
        yield pd.DataFrame([(*key, "unavailable", last)], columns=["stream_id", "sid", "status", "at_ms"])


def service_status_stream(sightings: DataFrame, timeout_ms: int = 60_000, late: str = "10 seconds") -> DataFrame:
    """`available` when a service is first seen, `unavailable` with the time it was last seen when it isn't for the timeout."""
    return keyed(sightings.select("stream_id", "sid", "ts"), ["stream_id", "sid"], Status(timeout_ms), "stream_id string, sid long, status string, at_ms long", "ts", late)


class Objects(Timed):
    """Body segments of one object: number -> payload; its header, its last number, when it last got something."""

    def __init__(self, idle: int, most: int):
        self.idle, self.most = idle, most

    def states(self) -> None:
        self.parts = self.handle.getMapState("parts", "seg_no int", "payload binary")
        self.head = self.handle.getValueState("head", "header binary, last int, got int, latest long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        header, last, got, latest = self.head.get() if self.head.exists() else (None, -1, 0, 0)
        new = rows_of(rows, "ts", "seg_no")
        new.sort(key=lambda r: (r.ts, r.kind != "header", r.seg_no))
        out, done = [], False
        for r in new:
            latest, n = max(latest, ms(r.ts)), int(r.seg_no)
            if r.kind == "header":
                if n == 0:
                    if header is not None and bytes(r.payload) != bytes(header) or done:
                        self.parts.clear()
                        last, got, done = -1, 0, False
                    header = bytes(r.payload)
                continue
            if done:
                continue  # repeats of the carousel, until a header begins anew
            if not self.parts.containsKey((n,)):
                self.parts.updateValue((n,), (bytes(r.payload),))
                got += 1
            last = n if r.last else last
            if got > self.most:
                out.append((*key, False, got, None))
                self.parts.clear()
                last, got = -1, 0
            elif last >= 0 and got == last + 1 and all(self.parts.containsKey((i,)) for i in range(got)):
                out.append((*key, True, got, b"".join(self.parts.getValue((i,))[0] for i in range(got))))
                done = True
        now = timerValues.getCurrentWatermarkInMs()
        if done:
            self.parts.clear()
            self.head.clear()
            self.due(None, now)
        else:
            self.head.update((header, last, got, latest))
            self.due(latest + self.idle, now)
        yield pd.DataFrame(out, columns=["stream_id", "transport_id", "complete", "segments", "payload"])

    def handleExpiredTimer(self, key, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        got = self.head.get()[2]
        for s in (self.parts, self.head, self.timer):
            s.clear()
        yield pd.DataFrame([(*key, False, got, None)], columns=["stream_id", "transport_id", "complete", "segments", "payload"])


def assemble_mot_stream(segments: DataFrame, idle_ms: int = 60_000, most_segments: int = 8192, late: str = "10 seconds") -> DataFrame:
    """Objects when their body segments 0 to last are there; the first copy of a segment wins, another header begins anew, an object that gets nothing for idle_ms is dropped, as is one of more than most_segments.

    segments: stream_id, transport_id, kind (header or body), seg_no, last, payload, ts.
    payload of the result is null for a dropped one. Body segments that follow in the batch
    in which an object became whole are repeats, unless a header comes before them.
    """
    s = segments.select("stream_id", "transport_id", "kind", "seg_no", "last", "payload", "ts")
    return keyed(s, ["stream_id", "transport_id"], Objects(idle_ms, most_segments), "stream_id string, transport_id long, complete boolean, segments int, payload binary", "ts", late)
