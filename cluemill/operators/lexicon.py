"""Word play over a lexicon: anagrams, charades, containers, reversals, neighbours, near anagrams, familiarity.

All work by generating the parts of each word and matching them by key, so the work grows with the lexicon times a
word's length and never with pairs of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.functions.text import letter_key


def familiarity(rank: Column, total: Column) -> Column:
    """0 to 100, falling with the logarithm of the rank; 0 for a rank that is null or not positive."""
    score = F.bround(100 * (1 - F.log(rank) / F.log(total)), 0)
    return F.when(rank.isNull() | (rank <= 0), 0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).cast("int")


def anagram_groups(words: DataFrame) -> DataFrame:
    groups = words.groupBy(letter_key(F.col("word")).alias("letters")).agg(F.array_sort(F.collect_set("word")).alias("words"))
    return groups.where(F.size("words") > 1).select("letters", F.size("words").cast("bigint").alias("n"), F.array_join("words", ",").alias("words"))


def piece_charades(words: DataFrame, least: int) -> DataFrame:
    """(word, pieces): words made of two or three words of at least that many letters.

    The second cut is made only behind a first piece that is a word.
    """
    keys = words.where(F.length("word") >= least).select("word")
    known = lambda df, part: df.join(keys.withColumnRenamed("word", part), part, "left_semi")
    cut = lambda rest: F.explode(F.sequence(F.lit(least), F.length(rest) - least)).alias("cut")
    split = lambda rest, left, right: (F.expr(f"substring({rest}, 1, cut)").alias(left), F.expr(f"substring({rest}, cut + 1)").alias(right))
    first = known(words.where(F.length("word") >= 2 * least).select("word", cut("word")).select("word", *split("word", "a", "rest")), "a")
    two = known(first, "rest").select("word", F.array("a", "rest").alias("pieces"))
    second = first.where(F.length("rest") >= 2 * least).select("word", "a", "rest", cut("rest")).select("word", "a", *split("rest", "b", "c"))
    return two.unionByName(known(known(second, "b"), "c").select("word", F.array("a", "b", "c").alias("pieces")))


def containers(words: DataFrame, inner_least: int, outer_least: int) -> DataFrame:
    """(word, outer, inner): words that are one word put inside another."""
    n = F.length("word")
    start = F.explode(F.sequence(F.lit(1), n - inner_least - 1)).alias("start")
    begun = words.where(n >= inner_least + max(outer_least, 2)).select("word", start)
    size = F.explode(F.sequence(F.lit(inner_least), F.length("word") - F.col("start") - 1)).alias("size")
    cut = begun.where(F.length("word") - F.col("start") - 1 >= inner_least).select("word", "start", size)
    parts = cut.select("word", F.expr("substring(word, start + 1, size)").alias("inner"), F.expr("concat(substring(word, 1, start), substring(word, start + size + 1))").alias("outer")).where(F.length("outer") >= outer_least)
    return parts.join(words.select(F.col("word").alias("inner")), "inner", "left_semi").join(words.select(F.col("word").alias("outer")), "outer", "left_semi").select("word", "outer", "inner").distinct()


def reversals(words: DataFrame, least: int) -> DataFrame:
    turned = words.where(F.length("word") >= least).select("word", F.reverse("word").alias("turned"))
    return turned.join(words.select(F.col("word").alias("turned")), "turned", "left_semi").select("word", "turned")


def reversed_parts(words: DataFrame, least: int) -> DataFrame:
    """(word, part, turned): parts of a word, of at least that many letters and short of the whole, that are another word backwards."""
    size = F.explode(F.sequence(F.lit(least), F.length("word") - 1)).alias("size")
    begun = words.where(F.length("word") > least).select("word", size)
    parts = begun.select("word", "size", F.explode(F.sequence(F.lit(1), F.length("word") - F.col("size") + 1)).alias("at")).select("word", F.expr("substring(word, at, size)").alias("part")).distinct()
    turned = parts.withColumn("turned", F.reverse("part")).where("part <> turned")
    return turned.join(words.select(F.col("word").alias("turned")), "turned", "left_semi").select("word", "part", "turned")


def deletions(words: DataFrame) -> DataFrame:
    """(word, shorter): words that are another word with one letter left out."""
    at = F.explode(F.sequence(F.lit(1), F.length("word"))).alias("at")
    less = words.select("word", at).select("word", F.expr("concat(substring(word, 1, at - 1), substring(word, at + 1))").alias("shorter"))
    return less.join(words.select(F.col("word").alias("shorter")), "shorter", "left_semi").select("word", "shorter").distinct()


def neighbours(words: DataFrame) -> DataFrame:
    """(word, other): words that differ by one letter put in or left out, from both sides."""
    pairs = deletions(words).withColumnRenamed("shorter", "other")
    return pairs.unionByName(pairs.select(F.col("other").alias("word"), F.col("word").alias("other")))


#: Spellings and the sign that stands for their sound, applied in order.
SOUNDS = (
    ("^(kn|gn|pn)", "n"), ("^wr", "r"), ("^ps", "s"), ("^wh", "w"), ("ph", "f"), ("gh", ""), ("ck|q|x", "k"), ("sch|sh|ch", "S"), ("th", "T"), ("c([eiy])", "s$1"), ("c", "k"), ("dg", "j"), ("g([eiy])", "j$1"),
    ("mb$", "m"), ("[aeiouy]+", "A"), ("e$", ""), ("([^A])\\1+", "$1"), ("[hw]", ""), ("z", "s"),
)


def phone_key(word: Column) -> Column:
    """A rough key of how an English word sounds, by rules of spelling; for lexicons without phone keys of their own."""
    for pattern, sign in SOUNDS:
        word = F.regexp_replace(word, pattern, sign)
    return word


def homophones(words: DataFrame) -> DataFrame:
    """(phone, n, words): words (word, phone) that share a phone key."""
    groups = words.where(F.col("phone") != "").groupBy("phone").agg(F.array_sort(F.collect_set("word")).alias("words"))
    return groups.where(F.size("words") > 1).select("phone", F.size("words").cast("bigint").alias("n"), F.array_join("words", ",").alias("words"))


#: Most letters of an abbreviation that is looked for in anagrams.
ABBREVIATION_LETTERS = 3


def abbreviation_anagrams(words: DataFrame, abbreviations: DataFrame, least: int = 3) -> DataFrame:
    """(word, abbreviation, other): words whose letters are those of an abbreviation and of another word of at least that many letters.

    abbreviations: (abbreviation) in lower case, of ABBREVIATION_LETTERS at most; longer ones fail. Every way to take so
    many letters out of a word is matched by the letters taken, so the work does not grow with the abbreviations.
    """
    short = abbreviations.select("abbreviation", letter_key(F.col("abbreviation")).alias("taken")).where("abbreviation <> ''").distinct()
    short = short.withColumn("taken", F.when(F.length("abbreviation") <= ABBREVIATION_LETTERS, F.col("taken")).otherwise(F.raise_error(F.lit("abbreviation too long"))))
    keyed = words.select("word", letter_key(F.col("word")).alias("key"))
    rest = keyed.select("word", F.lit("").alias("taken"), F.col("key").alias("rest"), F.lit(1).alias("from"))
    found = None
    for _ in range(ABBREVIATION_LETTERS):
        at = F.explode(F.when(F.length("rest") >= F.col("from"), F.sequence(F.col("from"), F.length("rest")))).alias("at")
        rest = rest.select("word", "taken", "rest", at).select("word", F.expr("concat(taken, substring(rest, at, 1))").alias("taken"), F.expr("concat(substring(rest, 1, at - 1), substring(rest, at + 1))").alias("rest"), F.col("at").alias("from")).distinct()
        found = rest if found is None else found.unionByName(rest)
    left = found.where(F.length("rest") >= least).select("word", "taken", F.col("rest").alias("key")).distinct().join(short, "taken")
    return left.join(keyed.withColumnRenamed("word", "other"), "key").select("word", "abbreviation", "other")


def near_anagrams(words: DataFrame) -> DataFrame:
    """(word, other): words whose letters are those of another word and one more; matched by the sorted letters less one."""
    keyed = words.select("word", letter_key(F.col("word")).alias("key"))
    at = F.explode(F.sequence(F.lit(1), F.length("key"))).alias("at")
    less = keyed.select("word", "key", at).select("word", F.expr("concat(substring(key, 1, at - 1), substring(key, at + 1))").alias("key")).distinct()
    return less.join(keyed.withColumnRenamed("word", "other"), "key").select("word", "other")


def trigram_share(words: DataFrame, often: int) -> DataFrame:
    """(word, share): share of a word's trigrams that occur at least that often in the lexicon; words of 3 letters and more."""
    grams = words.where(F.length("word") >= 3).select("word", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 2), lambda k: F.substring(F.col("word"), k, F.lit(3)))).alias("gram"))
    counts = grams.groupBy("gram").agg((F.count(F.lit(1)) >= often).alias("often"))
    return grams.join(counts, "gram").groupBy("word").agg(F.round(F.avg(F.when(F.col("often"), 1.0).otherwise(0.0)), 6).alias("share"))
