"""Names of registered codes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Genres by the upper half of a schedule's content byte.
GENRES = {
    0x00: "Undefined", 0x10: "News", 0x20: "Sport", 0x30: "Education", 0x40: "Drama", 0x50: "Music", 0x60: "Arts & Culture", 0x70: "Social", 0x80: "Science", 0x90: "Leisure", 0xA0: "Children's",
}
# Categories of text service objects.
TEXT_CATEGORIES = {
    0x00: "Undefined", 0x01: "News - General", 0x02: "News - Regional", 0x03: "News - International", 0x10: "Sport - General", 0x11: "Sport - Football", 0x12: "Sport - Other",
    0x20: "Weather - General", 0x21: "Weather - Forecast", 0x22: "Weather - Warning", 0x30: "Traffic", 0x40: "Financial", 0x50: "Entertainment", 0x60: "Politics", 0x70: "Culture", 0x80: "Technology", 0x90: "Health",
}
# Content types of multimedia objects.
OBJECT_TYPES = {0: "General Data", 1: "Text", 2: "JPEG Image", 3: "PNG Image", 4: "BMP Image", 5: "HTML Document", 6: "MPEG Audio", 7: "MPEG Video"}
# Words of travel messages that tell their application, in order; the first three are matched as they are written, alone or all together.
TRAVEL_APPLICATIONS = [("TEC", ["tec"]), ("TFP", ["tfp"]), ("PKI", ["pki"]), ("EMI", ["emi"]), ("PKI", ["parking", "charge"]), ("TEC", ["rd", "bangkok", "khwaeng"])]


def named(code: Column, names: dict[int, str], other: Column) -> Column:
    pairs = [x for k, v in names.items() for x in (F.lit(k), F.lit(v))]
    return F.when(code.isNotNull(), F.coalesce(F.try_element_at(F.create_map(*pairs), code.cast("int")), other))


def epg_genre(content: Column) -> Column:
    return named(content.bitwiseAND(0xF0), GENRES, F.lit("Unknown"))


def journaline_category(category: Column) -> Column:
    return named(category, TEXT_CATEGORIES, F.lit("Unknown"))


def mot_content_type(content_type: Column) -> Column:
    return named(content_type, OBJECT_TYPES, F.concat(F.lit("Unknown (0x"), F.lpad(F.lower(F.hex(content_type.cast("long"))), 2, "0"), F.lit(")")))


def tpeg_category(text: Column) -> Column:
    """What a travel message is about: a banner of all applications, a version, or the first application whose words it has."""
    has = lambda *words: F.contains(text, F.lit(words[0])) if len(words) == 1 else has(words[0]) & has(*words[1:])
    out = F.when(has("TEC", "TFP", "PKI"), "banner").when(has("R-3.1") | has("wip"), "version")
    for name, words in TRAVEL_APPLICATIONS:
        out = out.when(F.rlike(F.lower(text), F.lit("|".join(words))), name)
    return out.otherwise("unknown")
