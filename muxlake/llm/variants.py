"""Spelling variants: words that differ by one code point, and the common form each goes to.

A pair dictionary of two tries finds exact neighbours. The nodes of the trie of all words
are numbered, and those of the trie of all words read backwards. A word of L code points
has L + 1 splits and L skips: a split is the pair of nodes (prefix, suffix) that meet at a
place, a skip the pair around one code point that is left out. Two words are neighbours if

* they share a skip: one code point is replaced there, or
* a skip of one is a split of the other: that code point is inserted or deleted. Where the
  code point before is the same, leaving out either gives the same word; only the first of
  such places counts, so each pair of words meets in one entry of the dictionary alone.

Entries are grouped by their two numbers. The skips of an entry differ in one code point,
so there are no more than the alphabet has, and one word at most is its split. Each entry
gives its words their number of neighbours and the most common one; no pairs are emitted.

Prefixes of a word of L code points hold L * L / 2 of them, so words over `longest` take
another exact way: a neighbour shares the first or the last half, and words that share one
are compared by their edit distance. Only where very many very long words share a half
does that work grow with the square of their number.

Cases: null words and counts of null are dropped; the counts of a repeated word are added;
the empty word and words of one code point are neighbours as any others. Words compare by
code point. Other columns of the input are not used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muxlake.llm.common import table

#: Code points up to which a word is in the tries.
LONGEST = 64


def entries(words: DataFrame) -> DataFrame:
    """(id, word, n, left, right, skip, first): splits and skips of each word, by their strings. first: not after the same code point."""
    size, i = F.length("word"), F.col("i")
    at = words.select("id", "word", "n", F.explode(F.sequence(F.lit(0), size)).alias("i"))
    kinds = F.when(i < size, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    at = at.select("*", F.explode(kinds).alias("skip"))
    code = lambda k: F.substring("word", k, F.lit(1))
    right = F.substring("word", i + 1 + F.col("skip").cast("int"), F.lit(LONGEST))
    return at.select("id", "word", "n", F.substring("word", F.lit(1), i).alias("left"), right.alias("right"), "skip", (F.col("skip") & ((i == 0) | (code(i) != code(i + 1)))).alias("first"))


def numbered(strings: DataFrame, string: str, node: str) -> DataFrame:
    """A number for each different string, that is for each node of their trie; written, so that it stays."""
    return table(strings.select(string).distinct().withColumn(node, F.monotonically_increasing_id()))


def dictionary(words: DataFrame) -> DataFrame:
    """entries() with the numbers of both nodes in place of the strings."""
    e = entries(words)
    splits = e.where("NOT skip")
    return e.join(numbered(splits, "left", "prefix"), "left").join(numbered(splits, "right", "suffix"), "right").drop("left", "right")


def better(*found: Column) -> Column:
    """The most common word, of those the first by code points: structs of (-n, word, id)."""
    return F.least(*found)


def neighbours(words: DataFrame) -> DataFrame:
    """(id, near, best): of words (id, word, n) of up to LONGEST code points, the number of neighbours and the most common one, a row for each entry that has some."""
    row = F.struct((-F.col("n")).alias("less"), "word", "id")
    kind = "struct<less:bigint,word:string,id:bigint>"
    skips = F.array_sort(F.collect_list(F.when(F.col("skip"), F.struct(row.alias("row"), "first"))))
    g = dictionary(words).groupBy("prefix", "suffix").agg(skips.alias("skips"), F.max(F.when(~F.col("skip"), row)).alias("split"))
    g = g.where("size(skips) > 1 OR (size(skips) = 1 AND split IS NOT NULL)")
    one, two, split = F.col("skips")[0]["row"], F.get("skips", F.lit(1))["row"], F.col("split")
    none = F.lit(None).cast(kind)

    def member(m: Column) -> Column:
        joined = m["first"] & split.isNotNull()
        other = F.when(m["row"]["id"] == one["id"], two).otherwise(one)
        return F.struct(m["row"]["id"].alias("id"), (F.size("skips") - 1 + joined.cast("int")).cast("long").alias("near"), better(other, F.when(joined, split).otherwise(none)).alias("best"))

    firsts = F.filter("skips", lambda m: m["first"])
    whole = F.struct(split["id"].alias("id"), F.size(firsts).cast("long").alias("near"), F.get(firsts, F.lit(0))["row"].alias("best"))
    members = F.transform("skips", member)
    return g.select(F.inline(F.when(split.isNotNull(), F.array_append(members, whole)).otherwise(members))).where("near > 0")


def long_neighbours(words: DataFrame) -> DataFrame:
    """The same of pairs that hold a word of over LONGEST code points, where they share their first or last half: by edit distance."""
    size = F.length("word")
    # Half of the shorter word's length: of its own, and of one code point less.
    halves = F.array_distinct(F.array(F.expr("length(word) div 2"), F.expr("(length(word) - 1) div 2")))
    w = words.select("id", "word", "n", size.alias("size"), F.explode(halves).alias("half"))
    key = F.array(F.struct(F.lit(True).alias("head"), F.substring("word", F.lit(1), F.col("half").cast("int")).alias("part")), F.struct(F.lit(False).alias("head"), F.substring("word", (F.col("size") - F.col("half") + 1).cast("int"), F.col("half").cast("int")).alias("part")))
    w = w.select("id", "word", "n", "half", F.inline(key))
    other = w.select(F.col("id").alias("id2"), F.struct((-F.col("n")).alias("less"), "word", "id").alias("best"), F.col("word").alias("word2"), "half", "head", "part")
    at = w.select("id", "word", "half", "head", "part").join(other, ["half", "head", "part"])
    sizes = F.length("word"), F.length("word2")
    at = at.where((F.col("id") != F.col("id2")) & (F.abs(sizes[0] - sizes[1]) <= 1) & (F.greatest(*sizes) > LONGEST))
    at = at.where(F.levenshtein("word", "word2", 1) == 1).select("id", F.lit(1).cast("long").alias("near"), "best", "id2")
    return at.dropDuplicates(["id", "id2"]).drop("id2")


def roots(forms: DataFrame) -> DataFrame:
    """(id, root): of (id, form), where each goes to in the end. Steps double each round; n doubles with each form, so a chain is short."""
    now = table(forms.select("id", F.col("form").alias("root")))
    while True:
        on = now.select(F.col("id").alias("root"), F.col("root").alias("further"))
        new = table(now.join(on, "root", "left").select("id", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")))
        now = new.select("id", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(counts: DataFrame, ratio: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of counts (word, n).

    n_near: words that differ by one inserted, deleted or replaced code point. form: the
    most common of them (ties: the first by code points), if it is at least `ratio` times
    (over 1) as common as the word. root: the last of the forms' forms; the word itself if
    it has none.
    """
    counts = counts.where("word IS NOT NULL AND n IS NOT NULL").groupBy("word").agg(F.sum("n").cast("long").alias("n"))
    words = table(counts.select(F.monotonically_increasing_id().alias("id"), "word", "n"))
    near = neighbours(words.where(F.length("word") <= LONGEST))
    if not words.where(F.length("word") > LONGEST).isEmpty():  # their neighbours are at most one code point shorter
        near = near.unionByName(long_neighbours(words.where(F.length("word") >= LONGEST)))
    found = near.groupBy("id").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    common = -F.col("best.less") >= ratio * F.col("n")
    out = table(words.join(found, "id", "left").select("id", "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(common, F.col("best")).alias("best")))
    to = roots(out.where("best IS NOT NULL").select("id", F.col("best.id").alias("form")))
    names = out.select(F.col("id").alias("root"), F.col("word").alias("root_word"))
    out = out.join(to, "id", "left").join(names, "root", "left")
    return out.select("word", F.col("best.word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", (-F.col("best.less")).alias("form_n"))


def letter_runs(docs: DataFrame, *keep: str, text: str = "text", letters: str = "[A-Za-z\\u00C0-\\u00FF]+") -> DataFrame:
    """(keep, word): a row for each run of letters of each text; A to Z are lower-cased."""
    found = F.explode(F.regexp_extract_all(F.col(text), F.lit(letters), F.lit(0)))
    upper = "".join(map(chr, range(65, 91)))
    return docs.select(*keep, found.alias("word")).withColumn("word", F.translate("word", upper, upper.lower()))
