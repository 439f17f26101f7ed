"""Registered tables as small DataFrames, and lookups by them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Capacity units by equal protection level 1 to 4, and by index of the unequal protection table.
EEP_A_CU = [16, 8, 6, 4]
EEP_B_CU = [27, 21, 18, 15]
UEP_CU = [
    16, 21, 24, 29, 35, 24, 29, 35,
    42, 52, 29, 35, 42, 52, 32, 42,
    48, 58, 70, 40, 52, 58, 70, 84,
    48, 58, 70, 84, 104, 58, 70, 84,
    104, 64, 84, 96, 116, 140, 80, 104,
    116, 140, 168, 96, 116, 140, 168, 208,
    116, 140, 168, 208, 232, 128, 168, 192,
    232, 280, 160, 208, 280, 192, 280, 416,
]
UEP_LEVEL = [
    4, 3, 2, 1, 0, 4, 3, 2, 1, 0, 4, 3, 2, 1, 4, 3,
    2, 1, 0, 4, 3, 2, 1, 0, 4, 3, 2, 1, 0, 4, 3, 2,
    1, 4, 3, 2, 1, 0, 4, 3, 2, 1, 0, 4, 3, 2, 1, 0,
    4, 3, 2, 1, 0, 4, 3, 2, 1, 0, 4, 3, 1, 4, 2, 0,
]


# Countries by extended country code; every country id up to 15 of a code is the same country.
COUNTRIES = [
    (0xE1, "Germany", "DE"), (0xE2, "France", "FR"), (0xE3, "United Kingdom", "GB"), (0xE4, "Italy", "IT"), (0xE5, "Spain", "ES"), (0xE6, "Belgium", "BE"), (0xE7, "Netherlands", "NL"), (0xE8, "Switzerland", "CH"),
    (0xE9, "Austria", "AT"), (0xEA, "Denmark", "DK"), (0xEB, "Norway", "NO"), (0xEC, "Sweden", "SE"), (0xED, "Poland", "PL"), (0xEE, "Czech Republic", "CZ"), (0xF3, "Thailand", "TH"),
]
# Languages by code, with their ISO 639-2 codes.
LANGUAGES = [
    (0, "Unknown", "und"), (1, "Albanian", "alb"), (2, "Breton", "bre"), (3, "Catalan", "cat"), (4, "Croatian", "hrv"), (5, "Welsh", "wel"), (6, "Czech", "cze"), (7, "Danish", "dan"),
    (8, "Dutch", "dut"), (9, "English", "eng"), (10, "Finnish", "fin"), (11, "Flemish", "dut"), (12, "French", "fre"), (13, "Frisian", "fry"), (14, "Gaelic", "gla"), (15, "German", "ger"),
    (16, "Greek", "gre"), (17, "Hungarian", "hun"), (18, "Icelandic", "ice"), (19, "Irish", "gle"), (20, "Italian", "ita"), (21, "Lappish", "smi"), (22, "Latin", "lat"), (23, "Latvian", "lav"),
    (24, "Luxembourgian", "ltz"), (25, "Lithuanian", "lit"), (26, "Macedonian", "mac"), (27, "Maltese", "mlt"), (28, "Norwegian", "nor"), (29, "Occitan", "oci"), (30, "Polish", "pol"), (31, "Portuguese", "por"),
    (32, "Romanian", "rum"), (33, "Romansh", "roh"), (34, "Serbian", "srp"), (35, "Slovak", "slo"), (36, "Slovene", "slv"), (37, "Spanish", "spa"), (38, "Swedish", "swe"), (39, "Turkish", "tur"),
    (40, "Flemish", "dut"), (41, "Walloon", "wln"), (42, "Amharic", "amh"), (43, "Thai", "tha"), (44, "Bengali", "ben"), (45, "Burmese", "bur"), (46, "Chinese", "chi"), (47, "Sinhalese", "sin"),
    (48, "Hindi", "hin"), (49, "Japanese", "jpn"), (50, "Korean", "kor"), (51, "Malay", "may"), (52, "Vietnamese", "vie"), (53, "Uzbek", "uzb"), (54, "Kazakh", "kaz"), (55, "Tajik", "tgk"),
    (56, "Bulgarian", "bul"), (57, "Moldavian", "mol"), (58, "Russian", "rus"), (59, "Ukrainian", "ukr"), (60, "Zulu", "zul"),
    (0x7F, "Background Sound", "zxx"),
]
# Programme types 0 to 31 with their group.
PROGRAMME_TYPES = [
    ("No programme type", "None"), ("News", "Information"), ("Current Affairs", "Information"), ("Information", "Information"), ("Sport", "Entertainment"), ("Education", "Information"), ("Drama", "Entertainment"), ("Culture", "Entertainment"),
    ("Science", "Information"), ("Varied", "Entertainment"), ("Pop Music", "Music"), ("Rock Music", "Music"), ("Easy Listening", "Music"), ("Light Classical", "Music"), ("Serious Classical", "Music"), ("Other Music", "Music"),
    ("Weather", "Information"), ("Finance", "Information"), ("Children's programmes", "Entertainment"), ("Social Affairs", "Information"), ("Religion", "Information"), ("Phone In", "Entertainment"), ("Travel", "Information"), ("Leisure", "Entertainment"),
    ("Jazz Music", "Music"), ("Country Music", "Music"), ("National Music", "Music"), ("Oldies Music", "Music"), ("Folk Music", "Music"), ("Documentary", "Information"), ("Alarm Test", "Other"), ("Alarm", "Other"),
]

# The national plan's blocks: centre in MHz, name, use.
FREQUENCY_PLAN = [
    (174.928, "5A", "Public Service"), (176.640, "5B", "Public Service"), (178.352, "5C", "Public Service"), (180.064, "5D", "Public Service"),
    (181.936, "6A", "Commercial"), (183.648, "6B", "Commercial"), (185.360, "6C", "Commercial"), (187.072, "6D", "Commercial"),
    (188.928, "7A", "Community"), (190.640, "7B", "Community"), (192.352, "7C", "Community"), (194.064, "7D", "Community"),
    (195.936, "8A", "Commercial"), (197.648, "8B", "Commercial"), (199.360, "8C", "Commercial"), (201.072, "8D", "Commercial"),
    (202.928, "9A", "Public Service"), (204.640, "9B", "Public Service"), (206.352, "9C", "Public Service"), (208.064, "9D", "Public Service"),
    (209.936, "10A", "Community"), (211.648, "10B", "Community"), (213.360, "10C", "Community"), (215.072, "10D", "Community"),
    (216.928, "11A", "Commercial"), (218.640, "11B", "Commercial"), (220.352, "11C", "Commercial"), (222.064, "11D", "Commercial"),
    (223.936, "12A", "Emergency"), (225.648, "12B", "Emergency"), (227.360, "12C", "Emergency"), (229.072, "12D", "Emergency"),
    (230.784, "13A", "Government"), (232.496, "13B", "Government"), (234.208, "13C", "Government"), (235.776, "13D", "Government"),
    (237.488, "13E", "Government"),
]


def frequency_plan(spark: SparkSession) -> DataFrame:
    """(plan_mhz, block, use) of the national plan, all approved."""
    return spark.createDataFrame(FREQUENCY_PLAN, "plan_mhz double, block string, use string")


def country_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(COUNTRIES, "ecc int, country string, iso string")


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LANGUAGES, "language int, language_name string, iso_639 string")


def programme_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *x) for i, x in enumerate(PROGRAMME_TYPES)], "pty int, pty_name string, pty_group string")

def protection_table(spark: SparkSession) -> DataFrame:
    """(uep, option, code, protection, table_cu): code is the level for equal, the index for unequal protection."""
    rows = [(False, o, k + 1, f"EEP-{'AB'[o]}", cu) for o, sizes in enumerate((EEP_A_CU, EEP_B_CU)) for k, cu in enumerate(sizes)]
    rows += [(True, None, i, f"UEP-{level + 1}", cu) for i, (cu, level) in enumerate(zip(UEP_CU, UEP_LEVEL, strict=True))]
    return spark.createDataFrame(rows, "uep boolean, option int, code int, protection string, table_cu int")


def protection_lookup(stc: DataFrame) -> DataFrame:
    """stc with the name of its protection table and the units it stands for; 72 rows, broadcast."""
    t = F.broadcast(protection_table(stc.sparkSession).withColumnsRenamed({"uep": "t_uep"}))
    code = F.when(F.col("uep"), F.col("table_index")).otherwise(F.col("protection_level"))
    return stc.join(t, (F.col("uep") == F.col("t_uep")) & F.col("protection_option").eqNullSafe(F.col("option")) & (code == F.col("code")), "left").drop("t_uep", "option", "code").withColumn("protection", F.coalesce("protection", F.lit("EEP-?")))
