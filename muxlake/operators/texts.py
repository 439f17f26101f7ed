"""Text that goes over the borders of chunks: runs of a byte stream, Journaline items in it, dynamic labels and their tags.

A chunk's inner runs are whole as they are. Only what touches a border is scanned: a piece
at the start of a chunk goes on with the one at the end of the chunk before, and a chunk
that is text throughout with both, so a run may stand in any number of chunks. Pieces are
numbered by a running count over spans (operators/scan.py); no task sees a whole stream.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.functions.bits import bits, u
from muxlake.operators.scan import looking_back, running

#: Characters of a run, as classes over bytes read as ISO-8859-1: printable ASCII, or whatever isn't a control byte.
ASCII, TEXT = "\\x20-\\x7E", "\\x20-\\x7E\\x80-\\xFF"


def stream_runs(chunks: DataFrame, keys: list[str], order: str = "chunk_no", payload: str = "payload", characters: str = ASCII, least: int = 6, span: float | None = None) -> DataFrame:
    """(keys, first_chunk, last_chunk, place, raw): runs of at least `least` bytes of a class, across chunks whose numbers follow each other. place is the order of runs that begin in one chunk.

    Chunks without bytes break a run. raw is binary.
    """
    x, n = F.decode(F.col(payload), "ISO-8859-1"), F.octet_length(payload)
    c = chunks.where(n > 0).select(*keys, F.col(order).alias("_n"), x.alias("_x"))
    head, tail = F.regexp_extract("_x", f"^[{characters}]*", 0), F.regexp_extract("_x", f"(?<![{characters}])[{characters}]*\\z", 0)
    c = c.withColumns({"_head": head, "_all": F.length(head) == F.length("_x")}).withColumn("_tail", F.when(~F.col("_all"), tail).otherwise(""))
    inner = F.substring("_x", F.length("_head") + 1, F.length("_x") - F.length("_head") - F.length("_tail"))
    within = c.where("NOT _all").select(*keys, F.col("_n").alias("first_chunk"), F.col("_n").alias("last_chunk"), F.posexplode(F.regexp_extract_all(inner, F.lit(f"[{characters}]{{{least},}}"), F.lit(0))).alias("place", "_run"))
    within = within.withColumn("place", F.col("place") + 1)
    # Pieces at borders: side 0 ends a run, 1 begins one, 2 goes on with both neighbours.
    sides = F.filter(F.array(F.struct(F.when(F.col("_all"), 2).otherwise(0).alias("side"), F.col("_head").alias("piece")), F.struct(F.lit(1).alias("side"), F.col("_tail").alias("piece"))), lambda p: p["piece"] != "")
    e = c.select(*keys, "_n", F.inline(sides)).withColumn("_at", F.col("_n") * 2 + (F.col("side") == 1).cast("int"))
    length = 2 * span if span else None
    goes_on = lambda w: (F.col("side") != 1) & (F.lag("side").over(w) != 0) & (F.lag("_n").over(w) == F.col("_n") - 1)
    e = looking_back(e, keys, "_at", 1, lambda w: {"_new": (~F.coalesce(goes_on(w), F.lit(False))).cast("int")}, length)
    e = running(e, keys, "_at", {"_run_no": ("total", F.col("_new"))}, length)
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "piece"))), lambda p: p["piece"]), "")
    over = e.groupBy(*keys, "_run_no").agg(F.min("_n").alias("first_chunk"), F.max("_n").alias("last_chunk"), F.min_by("side", "_at").alias("_side"), parts.alias("_run"))
    over = over.where(F.length("_run") >= least).select(*keys, "first_chunk", "last_chunk", F.when(F.col("_side") == 1, 1 << 30).otherwise(0).alias("place"), "_run")
    return within.unionByName(over).select(*keys, "first_chunk", "last_chunk", "place", F.encode("_run", "ISO-8859-1").alias("raw"))


def message_inventory(runs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, text, repeats, first_chunk, last_chunk): the different texts of each key, trimmed, and how often they were seen."""
    t = runs.withColumn("text", F.trim(F.decode("raw", "ISO-8859-1"))).where("text <> ''")
    return t.groupBy(*keys, "text").agg(F.count("*").alias("repeats"), F.min("first_chunk").alias("first_chunk"), F.max_by("last_chunk", F.struct("first_chunk", "place")).alias("last_chunk"))


def plausible(text: Column, least: int = 6) -> Column:
    """Whether a text reads as prose: seven in ten of its characters are letters, digits, blanks or common signs, and a word of four letters is in it."""
    good = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,:;!?\"'()\[\]/\-–—&%+#…]", ""))
    return (F.length(text) >= least) & F.rlike(text, F.lit(r"\p{L}{4}")) & (good * 10 >= F.length(text) * 7) & (F.length(F.regexp_replace(text, "[^�]", "")) <= 2)


def journaline_items(chunks: DataFrame, keys: list[str], order: str = "chunk_no", title: int = 26, first_id: int = 0x8000, span: float | None = None) -> DataFrame:
    """(keys, object_id, title, text, first_chunk): items of a carousel that is sent as plain text. A short run is a title; a longer one is a body, under the title right before it."""
    r = stream_runs(chunks, keys, order, characters=TEXT, span=span).withColumn("run", F.trim(F.decode(F.make_valid_utf8(F.col("raw").cast("string")).cast("binary"), "UTF-8"))).where(plausible(F.col("run")))
    short = F.length("run") <= title
    r = r.withColumn("_at", F.struct("first_chunk", "place"))
    r = looking_back(r, keys, "_at", 1, lambda w: {"_title": F.lag(F.when(short, F.col("run")).otherwise("")).over(w)}, span)
    r = running(r, keys, "_at", {"_number": ("total", F.lit(1))}, span, peers=False)
    own = F.when(short, F.col("run")).otherwise(F.coalesce("_title", F.lit("")))
    return r.select(*keys, (F.col("_number") - 1 + first_id).cast("int").alias("object_id"), own.alias("title"), F.when(short, "").otherwise(F.col("run")).alias("text"), "first_chunk")


# Dynamic labels


def dynamic_labels(pad: DataFrame, payload: str = "payload") -> DataFrame:
    """pad with charset, text, and tags (an array) of the dynamic label in its bytes.

    An extended field (top bit set) has one byte before it. Then a byte whose low four bits
    are the charset (0 and 6 Latin, else UTF-8), the text up to a zero byte, and after that
    perhaps a command: the number of tags (1 to 4) and four bytes for each: type 4 bits,
    subtype 4, id 12 (with the subtype's bits), start 7 and length 7 in bytes of the text.
    Tags that the bytes don't hold, or whose place isn't in the text, are left out; rows
    without a text go.
    """
    d = F.col("_d")
    whole = F.when(bits(u(F.col(payload), 0), 7, 1) == 1, F.substring(payload, F.lit(2), F.octet_length(payload))).otherwise(F.col(payload))
    p = pad.withColumn("_d", whole).where(F.octet_length("_d") >= 2).withColumn("charset", bits(u(d, 0), 0, 4).cast("int"))
    body = F.substring(d, F.lit(2), F.octet_length("_d"))
    zero = F.instr(F.decode(body, "ISO-8859-1"), "\0")
    raw = F.when(zero > 0, F.substring(body, F.lit(1), zero - 1)).otherwise(body)
    utf8 = F.make_valid_utf8(raw.cast("string"))
    p = p.withColumn("_zero", zero).withColumn("text", F.trim(F.when(F.col("charset").isin(0, 6), F.decode(raw, "ISO-8859-1")).otherwise(utf8))).where("text <> ''")
    command = F.col("_zero") + 1  # offset in _d
    count = F.when((F.col("_zero") > 0) & (F.octet_length("_d") > command), bits(u(d, command), 0, 4))
    p = p.withColumn("_count", F.when(count.between(1, 4), F.least(count, F.floor((F.octet_length("_d") - command - 1) / 4))).otherwise(0).cast("int"))
    data = F.encode("text", "UTF-8")

    def tag(i: Column) -> Column:
        at = (command + 1 + i * 4).cast("int")
        word, low = u(d, at, 2), u(d, at + 2, 2)
        start, length = bits(low, 9, 7).cast("int"), F.shiftleft(bits(low, 8, 1), 6).bitwiseOR(bits(low, 2, 6)).cast("int")
        value = F.when((length > 0) & (start + length <= F.octet_length(data)), F.make_valid_utf8(F.substring(data, start + 1, length).cast("string")))
        return F.struct(bits(word, 12, 4).cast("int").alias("type"), bits(word, 8, 4).cast("int").alias("subtype"), bits(word, 0, 12).cast("int").alias("id"), start.alias("start"), length.alias("length"), value.alias("value"))

    tags = F.when(F.col("_count") > 0, F.filter(F.transform(F.sequence(F.lit(0), F.greatest(F.col("_count") - 1, F.lit(0))), tag), lambda t: t["value"].isNotNull())).otherwise(F.array().cast("array<struct<type:int,subtype:int,id:int,start:int,length:int,value:string>>"))
    return p.withColumn("tags", tags).drop("_d", "_zero", "_count")


def commands_with_text(texts: DataFrame, commands: DataFrame, span: float | None = None) -> DataFrame:
    """(stream_id, frame_no, payload, text): each command with the last text of its stream that came before it or with it, for payload.dls_tags. texts: stream_id, frame_no, text; commands: stream_id, frame_no, payload."""
    t = texts.select("stream_id", "frame_no", "text", F.lit(None).cast("binary").alias("payload"), F.lit(0).alias("_kind"))
    c = commands.select("stream_id", "frame_no", F.lit(None).cast("string").alias("text"), "payload", F.lit(1).alias("_kind"))
    both = t.unionByName(c).withColumn("_at", F.struct("frame_no", "_kind"))
    both = running(both, ["stream_id"], "_at", {"text": ("latest", F.col("text"))}, span)
    return both.where("_kind = 1 AND text IS NOT NULL").select("stream_id", "frame_no", "payload", "text")
