"""Word and bigram statistics over a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.functions.text import word_list
from cluemill.operators.ordering import numbered


def with_words(docs: DataFrame, text: str, *keep: str) -> DataFrame:
    """keep and ws, the words of each text. The one-row explode makes ws an attribute: an expression used inside a
    higher-order function would be evaluated anew for each element."""
    return docs.where(F.col(text).isNotNull()).select(*keep, F.explode(F.array(word_list(F.col(text)))).alias("ws"))


def word_counts(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, n_docs) over the ASCII words of all texts. Each text's words are sorted, so the first of equal ones counts the document, and one aggregation that combines on the map side does the rest."""
    sorted_words = with_words(docs, text).where(F.size("ws") > 0).select(F.explode(F.array(F.array_sort("ws"))).alias("s"))
    at = F.transform(F.sequence(F.lit(0), F.size("s") - 1), lambda k: F.struct(F.get(F.col("s"), k).alias("word"), (~F.get(F.col("s"), k).eqNullSafe(F.get(F.col("s"), k - 1))).alias("is_first")))
    return sorted_words.select(F.explode(at).alias("x")).groupBy("x.word").agg(F.count(F.lit(1)).alias("n"), F.count_if("x.is_first").alias("n_docs"))


def bigrams(words: str) -> Column:
    """Pairs of adjacent words of an attribute of words, as text."""
    return F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda k: F.concat_ws(" ", F.get(F.col(words), k - 1), F.get(F.col(words), k)))


def bigram_set(docs: DataFrame, text: str) -> DataFrame:
    return with_words(docs, text).where(F.size("ws") > 1).select(F.explode(bigrams("ws")).alias("bigram")).distinct()


def unattested(clues: DataFrame, key: str, text: str, known: DataFrame) -> DataFrame:
    """(key, n, absent): bigrams of each clue and how many of them the corpus lacks."""
    own = with_words(clues, text, key).where(F.size("ws") > 1).select(key, F.explode(F.array_distinct(bigrams("ws"))).alias("bigram"))
    return own.join(known.withColumn("_k", F.lit(1)), "bigram", "left").groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_k").isNull()).alias("absent"))


def top_share(counts: DataFrame, key: str, n: str, percent: int) -> DataFrame:
    """The most frequent percent of all keys, at least one; ties by key."""
    ranked = numbered(counts.select(key, n), [F.col(n).desc(), F.col(key)], "place")
    total = ranked.agg(F.max("place").alias("t")).scalar()
    return ranked.where(F.col("place") <= F.greatest(F.lit(1), F.floor(total * percent / 100))).select(key, n)


def contexts(docs: DataFrame, text: str, before: tuple[str, ...]) -> DataFrame:
    """(word, after, other): how often a word follows one of the given words, and how often any other."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda k: F.struct(F.get(F.col("ws"), k).alias("word"), F.get(F.col("ws"), k - 1).isin(*before).alias("follows")))
    return with_words(docs, text).where(F.size("ws") > 1).select(F.explode(pairs).alias("p")).select("p.*").groupBy("word").agg(F.count_if("follows").alias("after"), F.count_if(~F.col("follows")).alias("other"))
