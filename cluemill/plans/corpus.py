"""Corpus statistics and lexicon queries on documents and clues."""

from __future__ import annotations

from pyspark.sql import functions as F

from cluemill.functions.text import word_list
from cluemill.operators import corpus, lexicon, ordering
from cluemill.session import built_once, table

DETERMINERS = ("a", "an", "the")


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars")


def word_frequency(spark, sf_dir):
    return corpus.word_counts(_docs(spark, sf_dir), "text")


def stock_terms(spark, sf_dir):
    return corpus.top_share(corpus.word_counts(_docs(spark, sf_dir), "text"), "word", "n", 2)


def context_counts(spark, sf_dir):
    return corpus.contexts(_docs(spark, sf_dir), "text", DETERMINERS).where("after >= 5 AND after >= 2 * other")


def bigram_unattested(spark, sf_dir):
    clues = table(spark, sf_dir, "authored_clue").select("clue_id", "clue").where("clue IS NOT NULL")
    known = corpus.bigram_set(_docs(spark, sf_dir), "text")
    return corpus.unattested(clues, "clue_id", "clue", known).withColumn("flagged", (F.col("n") >= 4) & (F.col("absent") * 5 >= F.col("n") * 4))


def length_median(spark, sf_dir):
    rows = _docs(spark, sf_dir).where("text IS NOT NULL").select(F.floor(F.col("n_chars") / 500).alias("bucket"), F.size(word_list(F.col("text"))).alias("words"))
    return rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.median("words").alias("median_words")).where("n > 20")


def quantile_by_index(spark, sf_dir):
    return ordering.value_quantiles(_docs(spark, sf_dir), ["lang"], "n_chars", (10, 50, 75, 90, 99))


def lang_mix(spark, sf_dir):
    """Documents per stated language: texts that are there, empty or blank, and their share of all."""
    rows = _docs(spark, sf_dir).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count("text").alias("n_text"), F.count_if(F.trim("text") == "").alias("n_blank"))
    return rows


def _lexicon(spark, sf_dir):
    """Words of 2 to 15 letters that stand in at least three documents, with how often they occur; built once for all queries."""
    build = lambda: corpus.word_counts(_docs(spark, sf_dir), "text").where((F.col("n_docs") >= 3) & F.length("word").between(2, 15)).select("word", "n")
    return built_once(spark, f"{sf_dir}/documents.parquet", "lexicon", build)


def ranked(spark, sf_dir):
    """The lexicon with each word's rank, the most frequent first; built once."""
    build = lambda: ordering.numbered(_lexicon(spark, sf_dir), [F.col("n").desc(), F.col("word")], "rank").select("word", "rank")
    return built_once(spark, f"{sf_dir}/documents.parquet", "ranked", build)


def anagram_groups(spark, sf_dir):
    return lexicon.anagram_groups(_lexicon(spark, sf_dir))


def charade_splits(spark, sf_dir):
    """Words made of two or three words of two letters and more. There is no floor of familiarity, and abbreviations are no pieces."""
    return lexicon.piece_charades(_lexicon(spark, sf_dir), 2).select("word", F.array_join("pieces", "+").alias("pieces"))


def container_splits(spark, sf_dir):
    return lexicon.containers(_lexicon(spark, sf_dir), 2, 2)


def reversed_words(spark, sf_dir):
    return lexicon.reversals(_lexicon(spark, sf_dir), 2)


def reversed_parts(spark, sf_dir):
    return lexicon.reversed_parts(_lexicon(spark, sf_dir), 4)


def edit_distance_one(spark, sf_dir):
    """Words that differ by one letter put in or left out, from both sides."""
    return lexicon.neighbours(_lexicon(spark, sf_dir))


def near_anagrams(spark, sf_dir):
    return lexicon.near_anagrams(_lexicon(spark, sf_dir))


def trigram_share(spark, sf_dir):
    return lexicon.trigram_share(_lexicon(spark, sf_dir), 5)


def word_familiarity(spark, sf_dir):
    words = ranked(spark, sf_dir)
    total = words.agg(F.max("rank").alias("t")).scalar()
    return words.select("word", "rank", lexicon.familiarity(F.col("rank"), total).alias("familiarity"))


def homophones(spark, sf_dir):
    """Words of the same rough sound."""
    return lexicon.homophones(_lexicon(spark, sf_dir).select("word", lexicon.phone_key(F.col("word")).alias("phone")))


def solution_words(spark, sf_dir):
    """Solutions that stand as words in the documents, with their counts."""
    found = table(spark, sf_dir, "clue_entry").where("solution IS NOT NULL").select(F.lower("solution").alias("word")).distinct()
    return found.join(corpus.word_counts(_docs(spark, sf_dir), "text"), "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_docs", F.lit(0)).alias("n_docs"))


NAMES = """word_frequency stock_terms context_counts bigram_unattested length_median quantile_by_index lang_mix anagram_groups charade_splits
container_splits reversed_words reversed_parts homophones edit_distance_one near_anagrams trigram_share word_familiarity solution_words""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_T = "t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS ws FROM documents WHERE text IS NOT NULL), k AS (SELECT doc_id, unnest(ws) AS word FROM t), c AS (SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM k GROUP BY 1)"
_B = "b AS (SELECT DISTINCT ws[i] || ' ' || ws[i + 1] AS bigram FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM t))"
_L = _T + ", w AS (SELECT word, n FROM c WHERE n_docs >= 3 AND length(word) BETWEEN 2 AND 15)"
_CHARADES = """cut AS (SELECT word, unnest(range(2, length(word) - 1)) AS k FROM w WHERE length(word) >= 4), one AS (SELECT word, substr(word, 1, k) AS a, substr(word, k + 1) AS rest FROM cut WHERE substr(word, 1, k) IN (SELECT word FROM w)),
two AS (SELECT word, a, rest, unnest(range(2, length(rest) - 1)) AS k FROM one WHERE length(rest) >= 4), ch AS (SELECT word, [a, rest] AS pieces FROM one WHERE rest IN (SELECT word FROM w)
UNION ALL SELECT word, [a, substr(rest, 1, k), substr(rest, k + 1)] FROM two WHERE substr(rest, 1, k) IN (SELECT word FROM w) AND substr(rest, k + 1) IN (SELECT word FROM w))"""
_KEYED = "array_to_string(list_sort(string_split(word, '')), '')"
_NEAR = "del AS (SELECT word, unnest(range(1, length(word) + 1)) AS k FROM w), sh AS (SELECT DISTINCT word, substr(word, 1, k - 1) || substr(word, k + 1) AS shorter FROM del), near AS (SELECT word, shorter FROM sh WHERE shorter IN (SELECT word FROM w))"
_PHONE = "word"
for _pattern, _sign in lexicon.SOUNDS:
    # the one rule with a group that repeats itself is spelt out, for the engine of the SQL has none
    _PHONE = f"regexp_replace({_PHONE}, '{_pattern}', '{_sign.replace('$', chr(92))}', 'g')" if "\\1" not in _pattern else "".join(["array_to_string(list_filter(list_transform(string_split(", _PHONE, ", ''), lambda l, i: CASE WHEN i > 1 AND l <> 'A' AND l = substr(", _PHONE, ", i - 1, 1) THEN '' ELSE l END), lambda l: l <> ''), '')"])
SQL = {
    "word_frequency": f"WITH {_T} SELECT * FROM c",
    "stock_terms": f"WITH {_T} SELECT word, n FROM (SELECT word, n, row_number() OVER (ORDER BY n DESC, word) AS r, count(*) OVER () AS t FROM c) WHERE r <= greatest(1, floor(t * 2 / 100))",
    "context_counts": f"WITH {_T}, p AS (SELECT ws[i + 1] AS word, ws[i] IN ('a', 'an', 'the') AS f FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM t)), q AS (SELECT word, count(*) FILTER (f) AS after, count(*) FILTER (NOT f) AS other FROM p GROUP BY 1) SELECT * FROM q WHERE after >= 5 AND after >= 2 * other",
    "bigram_unattested": f"WITH {_T}, {_B}, a AS (SELECT clue_id, regexp_extract_all(lower(clue), '[a-z]+') AS ws FROM authored_clue WHERE clue IS NOT NULL), o AS (SELECT DISTINCT clue_id, ws[i] || ' ' || ws[i + 1] AS bigram FROM (SELECT clue_id, ws, unnest(range(1, len(ws))) AS i FROM a)), q AS (SELECT clue_id, count(*) AS n, count(*) FILTER (bigram NOT IN (SELECT bigram FROM b)) AS absent FROM o GROUP BY 1) SELECT *, n >= 4 AND absent * 5 >= n * 4 AS flagged FROM q",
    "length_median": "SELECT CAST(floor(n_chars / 500) AS BIGINT) AS bucket, count(*) AS n, median(len(regexp_extract_all(lower(text), '[a-z]+'))) AS median_words FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 20",
    "quantile_by_index": "WITH s AS (SELECT lang, n_chars, row_number() OVER (PARTITION BY lang ORDER BY n_chars) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE n_chars IS NOT NULL), p AS (SELECT CAST(unnest([10, 50, 75, 90, 99]) AS INTEGER) AS percent) SELECT lang, percent, n_chars AS value FROM s, p WHERE r = least(floor(n * percent / 100), n - 1)",
    "lang_mix": "SELECT lang, count(*) AS n, count(text) AS n_text, count(*) FILTER (trim(text, ' ') = '') AS n_blank FROM documents GROUP BY 1",
    "anagram_groups": f"WITH {_L} SELECT {_KEYED} AS letters, count(*) AS n, string_agg(word, ',' ORDER BY word) AS words FROM w GROUP BY 1 HAVING count(*) > 1",
    "charade_splits": f"WITH {_L}, {_CHARADES} SELECT word, array_to_string(pieces, '+') AS pieces FROM ch",
    "container_splits": f"WITH {_L}, s AS (SELECT word, unnest(range(1, length(word) - 2)) AS a FROM w), z AS (SELECT word, a, unnest(range(2, length(word) - a)) AS z FROM s), p AS (SELECT DISTINCT word, substr(word, 1, a) || substr(word, a + z + 1) AS \"outer\", substr(word, a + 1, z) AS \"inner\" FROM z) SELECT * FROM p WHERE length(\"outer\") >= 2 AND \"outer\" IN (SELECT word FROM w) AND \"inner\" IN (SELECT word FROM w)",
    "reversed_words": f"WITH {_L} SELECT word, reverse(word) AS turned FROM w WHERE reverse(word) IN (SELECT word FROM w)",
    "edit_distance_one": f"WITH {_L}, {_NEAR} SELECT word, shorter AS other FROM near UNION ALL SELECT shorter, word FROM near",
    "reversed_parts": f"WITH {_L}, z AS (SELECT word, unnest(range(4, length(word))) AS n FROM w), x AS (SELECT DISTINCT word, substr(word, i, n) AS part FROM (SELECT word, n, unnest(range(1, length(word) - n + 2)) AS i FROM z)) SELECT word, part, reverse(part) AS turned FROM x WHERE part <> reverse(part) AND reverse(part) IN (SELECT word FROM w)",
    "homophones": f"WITH {_L}, x AS (SELECT word, {_PHONE} AS phone FROM w) SELECT phone, count(*) AS n, string_agg(word, ',' ORDER BY word) AS words FROM x WHERE phone <> '' GROUP BY 1 HAVING count(*) > 1",
    "near_anagrams": f"WITH {_L}, y AS (SELECT word, {_KEYED} AS key FROM w), d AS (SELECT word, key, unnest(range(1, length(key) + 1)) AS k FROM y), s AS (SELECT DISTINCT word, substr(key, 1, k - 1) || substr(key, k + 1) AS key FROM d) SELECT s.word, y.word AS other FROM s JOIN y USING (key)",
    "trigram_share": f"WITH {_L}, g AS (SELECT word, substr(word, CAST(i AS INTEGER), 3) AS gram FROM (SELECT word, unnest(range(1, length(word) - 1)) AS i FROM w)), q AS (SELECT gram, count(*) >= 5 AS often FROM g GROUP BY 1) SELECT word, round(avg(CASE WHEN often THEN 1.0 ELSE 0.0 END), 6) AS share FROM g JOIN q USING (gram) GROUP BY 1",
    "word_familiarity": f"WITH {_L}, r AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank, count(*) OVER () AS t FROM w) SELECT word, rank, CAST(greatest(0, least(100, round_even(100 * (1 - ln(rank) / ln(t)), 0))) AS INTEGER) AS familiarity FROM r",
    "solution_words": f"WITH {_T}, s AS (SELECT DISTINCT lower(solution) AS word FROM clue_entry WHERE solution IS NOT NULL) SELECT s.word, coalesce(n, 0) AS n, coalesce(n_docs, 0) AS n_docs FROM s LEFT JOIN c USING (word)",
}
