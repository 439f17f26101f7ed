"""Rules over sets: of rows, of a sequence, of groups, of members, of intervals; all give rows of one kind.

A ruleset names the table it looks at; `validate_all` runs many over named tables and
returns (stream_id, standard, rule_id, severity, subject, message), a row for each breach:

* RowRules: each row by itself (rules.validate);
* SequenceRule: a row against rows before it, over spans, so no task sorts a stream;
* GroupRules: rules over aggregates of a group, combined before the shuffle;
* MemberRule: members that a stream must have and hasn't, a set difference;
* SweepRule: intervals of a group that overlap: +1 where one begins, -1 where it ends, and
  a running sum over these, so n intervals cost n log n, not all pairs.

A rule whose columns are null isn't broken. Tables that aren't given leave their rulesets out.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from muxlake.operators.rules import Rule, validate
from muxlake.operators.scan import looking_back

OUT = ["stream_id", "standard", "rule_id", "severity", "subject", "message"]


@dataclass(frozen=True)
class RowRules:
    table: str
    rules: list[Rule]
    subject: Column

    def breaches(self, df: DataFrame) -> DataFrame:
        return validate(df.withColumn("subject", self.subject.cast("string")), self.rules, ["stream_id", "subject"])


@dataclass(frozen=True)
class SequenceRule:
    """broken(window) says, for each row in order, whether it breaks the rule against the `back` rows before."""

    table: str
    rule_id: str
    standard: str
    severity: str
    order: str
    broken: Callable[[WindowSpec], Column]
    message: Column | str
    back: int = 1
    span: float | None = None

    def breaches(self, df: DataFrame) -> DataFrame:
        seen = looking_back(df, ["stream_id"], self.order, self.back, lambda w: {"_broken": self.broken(w)}, self.span).where("_broken")
        rule = Rule(self.rule_id, self.standard, self.severity, F.col("_broken"), self.message)
        return validate(seen.withColumn("subject", F.col(self.order).cast("string")), [rule], ["stream_id", "subject"])


@dataclass(frozen=True)
class GroupRules:
    """Rules over aggregates (name -> column) of the groups of `keys`, which hold stream_id."""

    table: str
    keys: list[str]
    aggregates: dict[str, Column]
    rules: list[Rule]

    def breaches(self, df: DataFrame) -> DataFrame:
        g = df.groupBy(*self.keys).agg(*(c.alias(k) for k, c in self.aggregates.items()))
        subject = F.concat_ws(" ", *(F.col(k).cast("string") for k in self.keys if k != "stream_id")) if len(self.keys) > 1 else F.lit("stream")
        return validate(g.withColumn("subject", subject), self.rules, ["stream_id", "subject"])


@dataclass(frozen=True)
class MemberRule:
    """Each stream of the table must have a row of every wanted member: (value, severity)."""

    table: str
    member: Column
    wanted: list[tuple[str, str]]
    rule_id: str
    standard: str

    def breaches(self, df: DataFrame) -> DataFrame:
        has = df.groupBy("stream_id").agg(F.collect_set(F.when(self.member.isin([m for m, _ in self.wanted]), self.member)).alias("has"))  # no more than are wanted
        all_ = F.array(*[F.struct(F.lit(m).alias("member"), F.lit(s).alias("severity")) for m, s in self.wanted])
        gone = has.select("stream_id", F.inline(F.filter(all_, lambda x: ~F.array_contains(F.col("has"), x["member"]))))
        return gone.select("stream_id", F.lit(self.rule_id).alias("rule_id"), F.lit(self.standard).alias("standard"), "severity", F.col("member").alias("subject"), F.concat(F.lit("never seen: "), F.col("member")).alias("message"))


@dataclass(frozen=True)
class SweepRule:
    """No place of a group may be in more than `most` of its intervals [start, start + size): a row for each stretch that is, from the first place on."""

    table: str
    keys: list[str]
    start: str
    size: str
    rule_id: str
    standard: str
    severity: str
    most: int = 1

    def breaches(self, df: DataFrame) -> DataFrame:
        edges = F.array(F.struct(F.col(self.start).alias("at"), F.lit(1).alias("step")), F.struct((F.col(self.start) + F.col(self.size)).alias("at"), F.lit(-1).alias("step")))
        e = df.where(F.col(self.size) > 0).select(*self.keys, F.inline(edges)).groupBy(*self.keys, "at").agg(F.sum("step").alias("step")).where("step <> 0")
        w = Window.partitionBy(*self.keys).orderBy("at")
        e = e.withColumn("deep", F.sum("step").over(w)).withColumn("was", F.coalesce(F.lag("deep").over(w), F.lit(0)))
        edge = e.where((F.col("deep") > self.most) != (F.col("was") > self.most)).withColumn("until", F.lead("at").over(w))
        rule = Rule(self.rule_id, self.standard, self.severity, F.col("deep") > self.most, F.concat(F.lit("overlap from "), F.col("at"), F.lit(" to "), F.col("until") - 1))
        subject = F.concat_ws(" ", *(F.col(k).cast("string") for k in self.keys if k != "stream_id"), F.col("at").cast("string"))
        return validate(edge.withColumn("subject", subject), [rule], ["stream_id", "subject"])


Ruleset = RowRules | SequenceRule | GroupRules | MemberRule | SweepRule


def validate_all(tables: dict[str, DataFrame], rulesets: list[Ruleset]) -> DataFrame:
    """The breaches of all rulesets whose table is given."""
    found = [r.breaches(tables[r.table]).select(*OUT) for r in rulesets if r.table in tables]
    if not found:
        raise ValueError("no table that a rule looks at")
    return reduce(DataFrame.unionByName, found)


# Capacity units of a multiplex, frame lengths in bytes by mode, service ids that aren't allowed.
UNITS = 864
FRAME_LENGTHS = {1: 3096, 2: 1728, 3: 1152, 4: 864}
RESERVED = (0, 0xFFFF)


def _n(text: str, column: str) -> Column:
    return F.concat(F.lit(text + " "), F.col(column))


def framing(span: float | None = None) -> list[Ruleset]:
    """EN 300 799. headers: stream_id, frame_no, and of these what there is: n_bytes, sync_ok, fc, nst, mid, fic_ok, eoh_ok, tist, frame_bytes. stc: stream_id, frame_no, size."""
    c, std = F.col, "EN 300 799"
    length = F.coalesce(*[F.when(c("mid") == m, n) for m, n in FRAME_LENGTHS.items()])
    rows = [
        Rule("size", std, "critical", c("n_bytes") != 6144, _n("bytes", "n_bytes"), ("n_bytes",)),
        Rule("sync", std, "critical", ~c("sync_ok"), "no sync word", ("sync_ok",)),
        Rule("frame_count", std, "error", c("fc") > 249, _n("frame count", "fc"), ("fc",)),
        Rule("nst", std, "error", c("nst") > 63, _n("sub-channels", "nst"), ("nst",)),
        Rule("mode", std, "error", ~c("mid").between(1, 4), _n("mode", "mid"), ("mid",)),
        Rule("fic_crc", std, "error", ~c("fic_ok"), "FIC check failed", ("fic_ok",)),
        Rule("header_crc", std, "critical", ~c("eoh_ok"), "header check failed", ("eoh_ok",)),
        Rule("time_stamp", std, "warning", (c("tist") > 0x7FFFFFFF) & (c("tist") != 0xFFFFFFFF), _n("time stamp", "tist"), ("tist",)),
        Rule("frame_length", std, "error", c("frame_bytes") != length, _n("frame of", "frame_bytes"), ("frame_bytes", "mid")),
    ]
    return [
        RowRules("headers", rows, c("frame_no")),
        SequenceRule("headers", "frame_sequence", std, "error", "frame_no", lambda w: c("fc") != (F.lag("fc").over(w) + 1) % 250, _n("frame count out of sequence:", "fc"), span=span),
        GroupRules("stc", ["stream_id", "frame_no"], {"units": F.sum("size")}, [Rule("capacity", std, "error", c("units") > UNITS, _n("capacity units", "units"))]),
    ]


def broadcasting() -> list[Ruleset]:
    """EN 300 401. services: stream_id, sid, eid, label. components: stream_id, sid, primary, tmid, sub_channel_id. subchannels: stream_id, sub_channel_id, start_address, size, protection_level, uep. figs: stream_id, fig_type, ext. ensembles: stream_id, eid, country_id, label."""
    c, std = F.col, "EN 300 401"
    long_label = Rule("label_length", std, "error", F.length("label") > 16, F.concat(F.lit("label of "), F.length("label"), F.lit(" characters")), ("label",))
    return [
        RowRules("ensembles", [Rule("eid", std, "error", c("eid").isin(*RESERVED), _n("ensemble id", "eid")), Rule("country", std, "error", ~c("country_id").between(1, 15), _n("country id", "country_id"), ("country_id",)), long_label], c("eid")),
        RowRules("services", [Rule("sid", std, "error", c("sid").isin(*RESERVED), _n("service id", "sid")), Rule("label", std, "warning", F.coalesce(c("label"), F.lit("")) == "", "no label", ("label",)), long_label], c("sid")),
        RowRules("components", [Rule("tmid", std, "error", ~c("tmid").between(0, 3), _n("transport", "tmid"), ("tmid",)), Rule("sub_channel", std, "error", ~c("sub_channel_id").between(0, 63), _n("sub-channel", "sub_channel_id"))], c("sid")),
        GroupRules("components", ["stream_id", "sid"], {"primaries": F.count_if("primary")}, [Rule("no_primary", std, "warning", c("primaries") == 0, "no primary component"), Rule("primaries", std, "error", c("primaries") > 1, _n("primary components", "primaries"))]),
        RowRules("subchannels", [
            Rule("boundary", std, "error", c("start_address") + c("size") > UNITS, F.concat(F.lit("ends at "), c("start_address") + c("size"))),
            Rule("protection", std, "error", F.when(c("uep"), ~c("protection_level").between(1, 5)).otherwise(~c("protection_level").between(1, 4)), _n("protection level", "protection_level"), ("uep", "protection_level")),
        ], c("sub_channel_id")),
        GroupRules("subchannels", ["stream_id"], {"units": F.sum("size")}, [Rule("capacity", std, "error", c("units") > UNITS, _n("capacity units", "units"))]),
        SweepRule("subchannels", ["stream_id"], "start_address", "size", "overlap", std, "error"),
        MemberRule("figs", F.concat_ws("/", c("fig_type").cast("string"), c("ext").cast("string")), [("0/0", "error"), ("0/1", "error"), ("0/2", "info")], "mandatory_fig", std),
    ]


#: Terms that a service's label may not hold: a parameter, as they are a matter of policy.
TERMS = ("gambling", "casino", "adult")


def national(terms: tuple[str, ...] = TERMS) -> list[Ruleset]:
    """National plan. licences: stream_id, sid, kind, and of these what there is: mhz, plan_mhz (of the block that matches, or null), approved, label, label_ok (readable), country_id, signal (0 to 1), continuous, licence, guarantee, authorised, licence_valid, watts, insurance, description."""
    c, std = F.col, "national plan"
    kind = c("kind")
    emergency, commercial = kind == "Emergency", kind == "Commercial"
    rows = [
        Rule("band", std, "critical", ~c("mhz").between(174.0, 240.0), _n("outside the band:", "mhz"), ("mhz",)),
        Rule("plan", std, "error", c("mhz").isNotNull() & c("plan_mhz").isNull(), _n("no such block:", "mhz"), ("mhz", "plan_mhz")),
        Rule("approval", std, "error", ~c("approved"), "block not approved", ("approved",)),
        Rule("encoding", std, "error", ~c("label_ok"), "label isn't readable text", ("label_ok",)),
        Rule("content", std, "error", F.rlike(F.lower("label"), F.lit("|".join(terms))), "label holds a prohibited term", ("label",)),
        Rule("emergency_country", std, "error", emergency & (c("country_id") != 15), _n("country id", "country_id"), ("country_id",)),
        Rule("emergency_signal", std, "error", emergency & (c("signal") < 0.8), "signal too weak", ("signal",)),
        Rule("emergency_hours", std, "error", emergency & ~c("continuous"), "not continuous", ("continuous",)),
        Rule("licence", std, "error", commercial & (F.coalesce(c("licence"), F.lit("")) == ""), "no licence", ("licence",)),
        Rule("licence_form", std, "error", commercial & (c("licence") != "") & ~F.rlike("licence", F.lit("^[A-Za-z0-9-]{10,}$")), _n("licence", "licence"), ("licence",)),
        Rule("guarantee", std, "error", commercial & (c("guarantee") < 1_000_000), "guarantee too low", ("guarantee",)),
        Rule("authorisation", std, "error", (kind == "Public Service") & ~c("authorised"), "not authorised", ("authorised",)),
        Rule("community_licence", std, "error", (kind == "Community") & ~c("licence_valid"), "licence not valid", ("licence_valid",)),
        Rule("community_power", std, "error", (kind == "Community") & (c("watts") > 100), _n("watts", "watts"), ("watts",)),
        Rule("insurance", std, "error", c("insurance") < 500_000, "insurance too low", ("insurance",)),
        Rule("label", std, "error", F.coalesce(c("label"), F.lit("")) == "", "no label", ("label",)),
        Rule("label_length", std, "error", F.length("label") > 16, F.concat(F.lit("label of "), F.length("label"), F.lit(" characters")), ("label",)),
        Rule("description_length", std, "warning", F.length("description") > 128, "description too long", ("description",)),
    ]
    return [RowRules("licences", rows, c("sid")), GroupRules("licences", ["stream_id"], {"emergencies": F.count_if(emergency)}, [Rule("no_emergency", std, "warning", c("emergencies") == 0, "no emergency service")])]
