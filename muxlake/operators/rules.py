"""Validation rules (R-family): one scan evaluates all rules of a set into rows of violations."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """broken says when a row violates the rule; message may use its columns."""

    rule_id: str
    standard: str
    severity: str
    broken: Column
    message: Column | str
    #: Columns without which the rule isn't asked.
    needs: tuple[str, ...] = ()


def validate(df: DataFrame, rules: list[Rule], keys: list[str]) -> DataFrame:
    """(keys, rule_id, standard, severity, message): a row for each broken rule of each row. A rule that is null isn't broken."""

    def row(r: Rule) -> Column:
        message = F.lit(r.message) if isinstance(r.message, str) else r.message
        return F.when(r.broken, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.standard).alias("standard"), F.lit(r.severity).alias("severity"), message.alias("message")))

    missing = {c for r in rules for c in r.needs} - set(df.columns)
    asked = [r for r in rules if not missing & set(r.needs)]
    if not asked:
        return df.limit(0).select(*keys, *(F.lit("").alias(c) for c in ("rule_id", "standard", "severity", "message")))
    found = F.array_compact(F.array(*[row(r) for r in asked]))
    return df.select(*keys, F.explode(found).alias("v")).select(*keys, "v.*")


def framing_rules() -> list[Rule]:
    """Frame headers: sync_ok, fc, nst, mid, used_cu."""
    c = F.col
    return [
        Rule("sync", "EN 300 799", "critical", ~c("sync_ok"), "no sync word"),
        Rule("frame_count", "EN 300 799", "error", c("fc") > 249, F.concat(F.lit("frame count "), c("fc"))),
        Rule("nst", "EN 300 799", "error", c("nst") > 63, F.concat(F.lit("sub-channels "), c("nst"))),
        Rule("mode", "EN 300 799", "error", ~c("mid").between(1, 4), F.concat(F.lit("mode "), c("mid"))),
    ]


def service_rules() -> list[Rule]:
    """Services with a component: sid, eid, label, tmid, sub_channel_id, used_cu."""
    c = F.col
    return [
        Rule("sid", "EN 300 401", "critical", c("sid").isin(0, 0xFFFF), "service id not allowed"),
        Rule("eid", "EN 300 401", "critical", c("eid").isin(0, 0xFFFF), "ensemble id not allowed"),
        Rule("tmid", "EN 300 401", "error", c("tmid") > 3, "transport mechanism out of range"),
        Rule("sub_channel", "EN 300 401", "error", c("sub_channel_id") >= 64, "sub-channel out of range"),
        Rule("label", "EN 300 401", "warning", F.coalesce(c("label"), F.lit("")) == "", "no label"),
        Rule("label_length", "EN 300 401", "warning", F.length("label") > 16, F.concat(F.lit("label of "), F.length("label"), F.lit(" characters"))),
    ]


def plan_rules(low: float = 174.0, high: float = 240.0) -> list[Rule]:
    """National plan: mhz, plan_mhz (null without a match), label."""
    c = F.col
    return [
        Rule("band", "national plan", "critical", ~c("mhz").between(low, high), F.concat(F.lit("outside the band: "), F.round("mhz", 3))),
        Rule("plan", "national plan", "error", c("plan_mhz").isNull(), "no such block in the plan"),
    ]


def component_rules() -> list[Rule]:
    """Fields of FIG 0/3, 0/4 and 0/5 entries: scid, packet_address, language."""
    c = F.col
    return [
        Rule("scid", "EN 300 401", "error", c("scid") > 4095, "component id over 12 bits"),
        Rule("packet_address", "EN 300 401", "warning", c("packet_address") == 0, "packet address 0"),
        Rule("language", "TS 101 756", "info", c("language") > 127, "language not registered"),
    ]


def error_rules() -> list[Rule]:
    """Health of a frame: sync_ok, structure_ok, fic_ok, services, audio (0 to 1)."""
    c = F.col
    return [
        Rule("sync_lost", "health", "critical", ~c("sync_ok"), "sync lost"),
        Rule("structure", "health", "high", ~c("structure_ok"), "broken structure"),
        Rule("fic", "health", "medium", ~c("fic_ok"), "FIC errors"),
        Rule("no_service", "health", "critical", c("services") == 0, "no service"),
        Rule("audio_bad", "health", "high", c("audio") < 0.5, "bad audio"),
        Rule("audio_poor", "health", "medium", (c("audio") >= 0.5) & (c("audio") < 0.75), "poor audio"),
    ]


def audio_rules() -> list[Rule]:
    """Levels: lufs, peak_db, thd, dynamic_db."""
    c = F.col
    off = F.abs(c("lufs") + 23)
    return [
        Rule("loudness", "EBU R 128", "critical", off > 5, "loudness far off"),
        Rule("loudness", "EBU R 128", "error", (off > 2) & (off <= 5), "loudness off"),
        Rule("loudness", "EBU R 128", "warning", (off > 1) & (off <= 2), "loudness a little off"),
        Rule("peak", "EBU R 128", "error", c("peak_db") > -3, "peak over -3 dBFS"),
        Rule("peak", "EBU R 128", "warning", (c("peak_db") > -6) & (c("peak_db") <= -3), "peak over -6 dBFS"),
        Rule("thd", "EBU R 128", "warning", c("thd") > 0.1, "distortion"),
        Rule("dynamic", "EBU R 128", "info", c("dynamic_db") < 12, "little dynamic range"),
    ]


def superframe_rules() -> list[Rule]:
    """Superframes: fire_ok, sbr, ps, stereo, aus_ok; offsets_ok where it is there (payload.superframes and unit_counters)."""
    c = F.col
    return [
        Rule("fire_code", "TS 102 563", "critical", ~c("fire_ok"), "header check failed"),
        Rule("ps_without_sbr", "TS 102 563", "error", c("ps") & ~c("sbr"), "parametric stereo without SBR"),
        Rule("ps_and_stereo", "TS 102 563", "error", c("ps") & c("stereo"), "parametric stereo of a stereo stream"),
        Rule("au_crc", "TS 102 563", "warning", ~c("aus_ok"), "access unit check failed"),
        Rule("au_offsets", "TS 102 563", "error", ~c("offsets_ok"), "access unit offsets don't rise", ("offsets_ok",)),
    ]


def cross_check(ensembles: DataFrame, frames: DataFrame) -> DataFrame:
    """Streams whose frames and catalogue disagree on the number of sub-channels."""
    seen = frames.groupBy("stream_id").agg(F.max("nst").alias("nst"))
    both = ensembles.join(seen, "stream_id", "full_outer")
    rules = [Rule("consistency", "cross", "warning", ~F.col("nst").eqNullSafe(F.col("subchannels")), F.concat_ws(" against ", F.coalesce(F.col("nst").cast("string"), F.lit("none")), F.coalesce(F.col("subchannels").cast("string"), F.lit("none"))))]
    return validate(both, rules, ["stream_id"])
