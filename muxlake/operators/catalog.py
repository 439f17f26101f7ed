"""Catalogue joins, merges and set operators (J-, O- and U-families, A05-A07)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muxlake.functions.times import micros

BITRATE_PER_CU = 8


def broadcast_if(dim: DataFrame, most: int = 20_000) -> DataFrame:
    """dim, marked for broadcast if it is counted to be small; registered tables are."""
    return F.broadcast(dim) if dim.limit(most + 1).count() <= most else dim


def components_x_subchannels(components: DataFrame, subchannels: DataFrame) -> DataFrame:
    s = subchannels.select("stream_id", "sub_channel_id", "size", (F.col("size") * BITRATE_PER_CU).alias("bitrate"))
    return components.join(s, ["stream_id", "sub_channel_id"], "left")


def used_by_services(subchannels: DataFrame, components: DataFrame, services: DataFrame) -> DataFrame:
    """Sub-channels with the names of the services that use them, by name."""
    name = F.when(F.coalesce("label", F.lit("")) != "", F.col("label")).otherwise(F.concat(F.lit("SId 0x"), F.hex("sid")))
    used = components.join(services.select("stream_id", "sid", name.alias("name")), ["stream_id", "sid"])
    names = used.groupBy("stream_id", "sub_channel_id").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("used_by"))
    return subchannels.join(names, ["stream_id", "sub_channel_id"], "left").select("stream_id", "sub_channel_id", F.coalesce("used_by", F.lit("")).alias("used_by"))


def packet_components(components: DataFrame, packets: DataFrame) -> DataFrame:
    """Components with the type of the first packet-mode entry of their sub-channel; those get transport 3."""
    first = packets.groupBy("stream_id", "sub_channel_id").agg(F.min_by("dscty", "seq").alias("dscty"))
    c = components.join(first, ["stream_id", "sub_channel_id"], "left")
    return c.withColumn("tmid", F.when(F.col("dscty").isNotNull(), F.lit(3)).otherwise(F.col("tmid")))


def labels_x_services(services: DataFrame, labels: DataFrame) -> DataFrame:
    """Services with their labels; services known by a label only are kept."""
    return services.join(labels.withColumnRenamed("label", "new_label"), ["stream_id", "sid"], "full_outer").select(
        "stream_id", "sid", F.coalesce("new_label", "label", F.lit("")).alias("label"), F.col("organised").isNotNull().alias("organised")
    )


def lookup(df: DataFrame, dim: DataFrame, on: list[str], name: str, default: str = "Unknown") -> DataFrame:
    """Left join to a registered table; the default where there is no row (country, language, programme type)."""
    return df.join(broadcast_if(dim), on, "left").withColumn(name, F.coalesce(name, F.lit(default)))


def overlapping_subchannels(subchannels: DataFrame, grid: int = 64) -> DataFrame:
    """Pairs a < b of one stream whose address intervals meet. Intervals meet in a cell of the grid; the first common cell counts."""
    last = F.col("start_address") + F.col("size") - 1
    s = subchannels.where("size > 0").withColumn("last", last).withColumn("cell", F.explode(F.sequence(F.floor(F.col("start_address") / grid), F.floor(last / grid))))
    a, b = s.alias("a"), s.alias("b")
    meets = (F.col("a.stream_id") == F.col("b.stream_id")) & (F.col("a.cell") == F.col("b.cell")) & (F.col("a.sub_channel_id") < F.col("b.sub_channel_id"))
    meets &= (F.col("a.start_address") <= F.col("b.last")) & (F.col("b.start_address") <= F.col("a.last"))
    first = F.floor(F.greatest("a.start_address", "b.start_address") / grid) == F.col("a.cell")
    overlap = F.least("a.last", "b.last") - F.greatest("a.start_address", "b.start_address") + 1
    return a.join(b, meets & first).select("a.stream_id", F.col("a.sub_channel_id").alias("a_id"), F.col("b.sub_channel_id").alias("b_id"), overlap.alias("overlap"))


def frequency_plan_match(measured: DataFrame, plan: DataFrame, tolerance: float = 0.001) -> DataFrame:
    """Band join: a bucket of the tolerance and its neighbours as equi key, the band as residual. Left outer."""
    bucket = lambda c: F.floor(F.col(c) / tolerance)
    p = plan.withColumn("bucket", F.explode(F.sequence(bucket("plan_mhz") - 1, bucket("plan_mhz") + 1)))
    m = measured.withColumn("bucket", bucket("mhz"))
    return m.join(p, (m["bucket"] == p["bucket"]) & (F.abs(F.col("mhz") - F.col("plan_mhz")) < tolerance), "left").drop("bucket")


def tii_sub_to_main(geo: DataFrame) -> DataFrame:
    """Sub transmitters with the position of the main one of the same FIG plus their offset."""
    main = geo.where("is_main").groupBy("fig_key", "main_id").agg(F.min_by("latitude", "pos").alias("m_lat"), F.min_by("longitude", "pos").alias("m_lon"))
    sub = geo.where("NOT is_main").drop("latitude", "longitude").join(main, ["fig_key", "main_id"], "left")
    return sub.withColumns({"latitude": F.round(F.col("m_lat") + F.col("lat_offset") * 90.0 / 524288.0, 6), "longitude": F.round(F.col("m_lon") + F.col("lon_offset") * 180.0 / 524288.0, 6)}).drop("m_lat", "m_lon")


def unknown_subchannels(components: DataFrame, subchannels: DataFrame) -> DataFrame:
    return components.join(subchannels, ["stream_id", "sub_channel_id"], "left_anti")


def now_next(events: DataFrame, as_of: DataFrame) -> DataFrame:
    """At each (service_id, at): the running event (start <= at < end, the latest start) and the next one.

    Events and times are one sorted sequence a service and month; months exchange one row
    each, so a service of long history isn't one window. The running event is found among
    the events that started before, the next among those that start after.
    """
    month = lambda c: F.date_trunc("month", c)
    e = events.select("service_id", F.col("start_time").alias("at"), F.struct("start_time", "event_id", "end_time").alias("e"), F.lit(0).alias("kind"))
    t = as_of.select("service_id", "at", F.lit(None).cast(e.schema["e"].dataType).alias("e"), F.lit(1).alias("kind"))
    both = e.unionByName(t).withColumn("month", month("at")).withColumn("us", micros("at"))
    w = Window.partitionBy("service_id", "month").orderBy("us")
    before, after = w.rangeBetween(Window.unboundedPreceding, 0), w.rangeBetween(1, Window.unboundedFollowing)
    near = both.select("*", F.max("e").over(before).alias("last_e"), F.min("e").over(after).alias("next_e"))
    m = Window.partitionBy("service_id").orderBy("month")
    far = both.groupBy("service_id", "month").agg(F.max("e").alias("hi"), F.min("e").alias("lo"))
    far = far.select("service_id", "month", F.max("hi").over(m.rowsBetween(Window.unboundedPreceding, -1)).alias("far_last"), F.min("lo").over(m.rowsBetween(1, Window.unboundedFollowing)).alias("far_next"))
    out = near.where("kind = 1").join(far, ["service_id", "month"])
    last, next_ = F.coalesce("last_e", "far_last"), F.coalesce("next_e", "far_next")
    return out.select("service_id", "at", F.when(last["end_time"] > F.col("at"), last["event_id"]).alias("now_event"), next_["event_id"].alias("next_event"))


def resolve_links(objects: DataFrame) -> DataFrame:
    target = objects.select(F.col("object_id").alias("link_target"), F.col("title").alias("target_title"))
    return objects.join(target, "link_target", "left")


def menu_tree(menus: DataFrame) -> DataFrame:
    """Menus with the title of their parent and the number of their sub-menus."""
    parent = menus.select(F.col("menu_id").alias("parent_id"), F.col("title").alias("parent_title"))
    children = menus.groupBy(F.col("parent_id").alias("menu_id")).agg(F.count("*").alias("children"))
    return menus.join(parent, "parent_id", "left").join(children, "menu_id", "left").select("menu_id", "parent_id", "title", "parent_title", F.coalesce("children", F.lit(0)).alias("children"))


def service_ecc(services: DataFrame, ensembles: DataFrame) -> DataFrame:
    e = ensembles.select("stream_id", F.col("ecc").alias("ensemble_ecc"))
    return services.join(e, "stream_id", "left").withColumn("ecc", F.when(F.col("ecc") == 0, F.coalesce("ensemble_ecc", F.lit(0))).otherwise(F.col("ecc"))).drop("ensemble_ecc")


def merge_redundant(primary: DataFrame, backup: DataFrame, failover: DataFrame | None = None) -> DataFrame:
    """One packet a sequence number: the primary's unless it is missing or the backup is in use."""
    key = ["stream_id", "seq"]
    m = primary.withColumnRenamed("payload", "p").join(backup.withColumnRenamed("payload", "b"), key, "full_outer")
    if failover is not None:
        m = m.join(failover.select(*key, "on_backup"), key, "left")
    else:
        m = m.withColumn("on_backup", F.lit(False))
    use_backup = F.coalesce("on_backup", F.lit(False)) & F.col("b").isNotNull() | F.col("p").isNull()
    return m.select(*key, F.when(use_backup, F.col("b")).otherwise(F.col("p")).alias("payload"), F.when(use_backup, "backup").otherwise("primary").alias("used"))


def compare_streams(frames: DataFrame, services: DataFrame, tolerance: float = 0.05) -> DataFrame:
    """Per stream frames, services and quality, beside the least and greatest frame count; in step if they differ by at most 5 %."""
    f = frames.groupBy("stream_id").agg(F.count("*").alias("n_frames"), F.round(100 * F.avg(F.col("valid").cast("int")), 6).alias("quality"))
    s = services.groupBy("stream_id").agg(F.count_distinct("sid").alias("n_services"))
    every = Window.partitionBy()
    out = f.join(s, "stream_id", "full_outer").select("stream_id", F.coalesce("n_frames", F.lit(0)).alias("n_frames"), "quality", F.coalesce("n_services", F.lit(0)).alias("n_services"))
    low, high = F.min("n_frames").over(every), F.max("n_frames").over(every)
    return out.withColumn("in_step", (low > 0) & ((high - low) / low <= tolerance))


def announcements_active(switches: DataFrame, components: DataFrame) -> DataFrame:
    """Services on the sub-channels that carry an announcement. Repeats go before the join: a switch is repeated frame by frame, and each repeat would meet every service."""
    active = switches.where("asw <> 0").select("stream_id", "cluster", "sub_channel_id").distinct()
    return active.join(components.select("stream_id", "sub_channel_id", "sid").distinct(), ["stream_id", "sub_channel_id"])


def user_app_services(services: DataFrame, apps: DataFrame, types: list[int]) -> DataFrame:
    return services.join(apps.where(F.col("app_type").isin(types)), ["stream_id", "sid"], "left_semi")


def label_source(services: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """The label of the preferred source, else of the other."""
    key = ["stream_id", "sid"]
    a, b = first.select(*key, F.col("label").alias("a")), second.select(*key, F.col("label").alias("b"))
    return services.join(a, key, "left").join(b, key, "left").select(*key, F.coalesce("a", "b", F.lit("")).alias("label"), F.when(F.col("a").isNotNull(), "first").when(F.col("b").isNotNull(), "second").otherwise("none").alias("source"))


def missing_labels(services: DataFrame, labels: DataFrame) -> DataFrame:
    return services.join(labels.where("label <> ''"), ["stream_id", "sid"], "left_anti")


def first_known(column: str, order: str = "frame_no", empty: str | int = "") -> Column:
    """The value of the first row in which it isn't null or empty."""
    return F.min_by(column, F.when(F.col(column).isNotNull() & (F.col(column) != F.lit(empty)), F.col(order)))


def ensemble_catalog(rows: DataFrame) -> DataFrame:
    """Per stream and ensemble id the first label, short label and country code known; any alarm."""
    return rows.groupBy("stream_id", "eid").agg(
        F.min("frame_no").alias("first_frame"), first_known("label").alias("label"), first_known("short_label").alias("short_label"), first_known("ecc", empty=0).alias("ecc"), F.bool_or("alarm").alias("alarm")
    )


def service_catalog(rows: DataFrame) -> DataFrame:
    """Per stream and service the first label known and its components, one for each sub-channel, the first wins."""
    fields = rows.groupBy("stream_id", "sid").agg(F.min("frame_no").alias("first_frame"), first_known("label").alias("label"))
    own = rows.where("sub_channel_id IS NOT NULL").groupBy("stream_id", "sid", "sub_channel_id").agg(F.min_by("asc_ty", "frame_no").alias("asc_ty"))
    parts = own.groupBy("stream_id", "sid").agg(F.array_sort(F.collect_list(F.struct("sub_channel_id", "asc_ty"))).alias("components"))
    return fields.join(parts, ["stream_id", "sid"], "left")


def union_subchannels(stc: DataFrame, fig01: DataFrame) -> DataFrame:
    """One row a sub-channel: the first seen, the frame header's before FIG 0/1 within a frame."""
    both = stc.withColumn("source", F.lit(0)).unionByName(fig01.withColumn("source", F.lit(1)))
    others = [c for c in stc.columns if c not in ("stream_id", "sub_channel_id")]
    first = F.min_by(F.struct(*others, "source"), F.struct("frame_no", "source")).alias("r")
    return both.groupBy("stream_id", "sub_channel_id").agg(first).select("stream_id", "sub_channel_id", "r.*")


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    return rows.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rn") <= k)


def lru_cap(keys: DataFrame, most: int, idle: int) -> DataFrame:
    """Of each stream the `most` keys active last that aren't idle for more than `idle` units before the stream's last activity."""
    w = Window.partitionBy("stream_id")
    alive = keys.withColumn("now", F.max("last_activity").over(w)).where(F.col("now") - F.col("last_activity") <= idle)
    return top_k(alive.drop("now"), ["stream_id"], [F.col("last_activity").desc(), F.col("key")], most)


def mandatory_missing(streams: DataFrame, figs: DataFrame, mandatory: list[tuple[int, int]]) -> DataFrame:
    """(stream, type, extension) that is mandatory and was never seen."""
    need = F.explode(F.array(*[F.struct(F.lit(t).alias("fig_type"), F.lit(e).alias("ext")) for t, e in mandatory])).alias("m")
    wanted = streams.select("stream_id").distinct().select("stream_id", need).select("stream_id", "m.fig_type", "m.ext")
    return wanted.join(figs.select("stream_id", "fig_type", "ext").distinct(), ["stream_id", "fig_type", "ext"], "left_anti")


def common_services(services: DataFrame, a: str, b: str) -> DataFrame:
    """Services of both streams, of the first only, of the second only."""
    of = lambda s: services.where(F.col("stream_id") == s).select("sid")
    tag = lambda df, t: df.withColumn("where_", F.lit(t))
    return tag(of(a).intersect(of(b)), "both").unionByName(tag(of(a).subtract(of(b)), "first")).unionByName(tag(of(b).subtract(of(a)), "second"))


def dedupe_frames(packets: DataFrame, keys: list[str]) -> DataFrame:
    """One row a key with the number of its copies."""
    return packets.groupBy(*keys).agg(F.count("*").alias("copies"))


def filter_services(services: DataFrame, text: str, columns: list[str]) -> DataFrame:
    hit = F.lit(False)
    for c in columns:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(c)), F.lit(text.lower())), F.lit(False))
    return services.where(hit)
