"""Column functions for identifiers, words and clue text (all JVM-side)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space at either end, and runs of it inside.
OUTER_SPACE = r"(?U)^\s+|\s+$"
SPACE_RUN = r"(?U)\s+"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, OUTER_SPACE, "")


def id_key(c: Column) -> Column:
    """Identifier without outer white space and letter case; null where nothing is left."""
    return F.nullif(F.lower(strip(c)), F.lit(""))


def term_key(c: Column) -> Column:
    """Term in lower case, outer white space dropped, inner runs as one space; null where nothing is left."""
    return F.nullif(F.lower(F.regexp_replace(strip(c), SPACE_RUN, " ")), F.lit(""))


def letters(c: Column) -> Column:
    """Upper-case ASCII letters only; accented letters are dropped."""
    return F.regexp_replace(F.upper(c), "[^A-Z]", "")


def word_list(c: Column) -> Column:
    """Runs of ASCII letters, lower case; null gives null."""
    return F.regexp_extract_all(F.lower(c), F.lit("[a-z]+"), F.lit(0))


def letter_key(c: Column) -> Column:
    """Letters in alphabetical order: equal for anagrams."""
    return F.array_join(F.array_sort(F.split(c, "")), "")


def enumeration(c: Column) -> Column:
    """Content of a closing bracket of digits, commas, hyphens and spaces, such as 4,6; empty where there is none."""
    return F.regexp_extract(c, r"\(([0-9][0-9, -]*)\)\s*$", 1)


def enumeration_sizes(c: Column) -> Column:
    """The numbers of an enumeration, in order."""
    return F.transform(F.regexp_extract_all(c, F.lit("[0-9]+"), F.lit(0)), lambda x: x.cast("int"))


def enumeration_breaks(sizes: Column) -> Column:
    """Running offsets at which words end, without the last one."""
    return F.transform(
        F.slice(F.sequence(F.lit(1), F.greatest(F.size(sizes), F.lit(1))), F.lit(1), F.greatest(F.size(sizes) - 1, F.lit(0))),
        lambda n: F.aggregate(F.slice(sizes, F.lit(1), n), F.lit(0), lambda a, x: a + x),
    )


def split_id_tail(c: Column) -> tuple[Column, Column]:
    """(head, tail) of an id at its last hyphen."""
    return F.regexp_extract(c, r"^(.*)-([^-]+)$", 1), F.regexp_extract(c, r"^(.*)-([^-]+)$", 2)


def tidy_words(c: Column) -> Column:
    """Runs of ASCII letters, lower case, of text without tags and without what stands in round brackets; null gives null."""
    return word_list(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\([^)]*\)", " "))


def straight_quotes(c: Column) -> Column:
    """Curly single quotes as straight ones."""
    return F.translate(c, "’‘", "''")


def without_enumeration(c: Column) -> Column:
    """Text with straight quotes and without a closing bracket of digits, outer spaces dropped."""
    return F.trim(F.regexp_replace(straight_quotes(c), r"\s*\([\d,\-\s/]+\)\s*$", ""))


def clue_words(c: Column) -> Column:
    """Words in lower case without the enumeration; a contraction's end ('s, 're, 'll, 've, 'd, n't) is a word of its own, n't as 't."""
    words = F.regexp_extract_all(F.lower(without_enumeration(c)), F.lit("[a-z']+"), F.lit(0))
    end = lambda w: F.regexp_extract(w, "^(.+?)('s|'re|'ll|'ve|'d|n't)$", 2)
    split = lambda w: F.array(F.regexp_extract(w, "^(.+?)('s|'re|'ll|'ve|'d|n't)$", 1), F.when(end(w) == "n't", "'t").otherwise(end(w)))
    return F.flatten(F.transform(words, lambda w: F.when(end(w) != "", split(w)).otherwise(F.array(w))))


def base_forms(word: Column) -> Column:
    """Words that may be the base of one ending in -s: without s, without es, and with y for ies. None for fewer than four letters."""
    without = lambda n: F.substring(word, F.lit(1), F.length(word) - n)
    forms = F.array(without(1), F.when(word.endswith("es"), without(2)), F.when(word.endswith("ies"), F.concat(without(3), F.lit("y"))))
    return F.when(word.endswith("s") & (F.length(word) >= 4), F.array_compact(forms)).otherwise(F.array().cast("array<string>"))


def anchor(c: Column) -> Column:
    """Lower case, every run of other signs than letters and digits as one hyphen, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), F.lit("-"))


def placed_tokens(c: Column) -> Column:
    """Array of (at, text): runs of visible signs with their place (from 0) in the text, without a closing bracket."""
    body = F.regexp_replace(c, r"\s*\([^()]*\)\s*$", "")
    parts = F.split(body, r"(?<=\S)(?=\s)|(?<=\s)(?=\S)")
    ends = F.transform(parts, lambda x, n: F.aggregate(F.slice(parts, F.lit(1), n), F.lit(0), lambda a, y: a + F.length(y)))
    spans = F.zip_with(ends, parts, lambda at, text: F.struct(at.alias("at"), text.alias("text")))
    return F.filter(spans, lambda x: F.trim(x["text"]).rlike(r"\S"))


def letter_places(c: Column) -> Column:
    """Places (from 0) of the letters of a text, in order."""
    return F.filter(F.transform(F.split(c, ""), lambda x, n: F.when(x.rlike(r"\p{L}"), n)), lambda n: n.isNotNull())


def occurrences(text: Column, part: Column) -> Column:
    """Places (from 0) at which part stands in text, overlapping ones included; none for an empty part."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - F.length(part), F.lit(0)))
    return F.when(F.length(part) > 0, F.filter(starts, lambda n: F.substring(text, n + 1, F.length(part)) == part)).otherwise(F.array().cast("array<int>"))


def letter_spans(text: Column, wanted: Column) -> Column:
    """Array of (a, b): from and to which place (from 0, to exclusive) the wanted letters (A to Z) stand in a text in order, with
    nothing but other signs between them; overlapping ones included."""
    places = letter_places(text)
    joined = F.upper(F.array_join(F.transform(places, lambda n: F.substring(text, n + 1, F.lit(1))), ""))
    last = F.length(wanted) - 1
    return F.transform(occurrences(joined, wanted), lambda s: F.struct(F.get(places, s).alias("a"), (F.get(places, s + last) + 1).alias("b")))


def first_sentence(c: Column) -> Column:
    """Text up to its first full stop, question or exclamation mark before white space or the end; the whole text without one."""
    return F.coalesce(F.nullif(F.regexp_extract(c, r"(?s)^(.*?[.!?])(?:\s|$)", 1), F.lit("")), c)


def flat_markup(c: Column) -> Column:
    """(text, italics) of simple markup: the text without tags, and (at, size) of each part in i or em."""
    tokens = F.split(c, r"(?=<)|(?<=>)")
    start = F.struct(F.lit("").alias("text"), F.lit(-1).alias("open"), F.array().cast("array<struct<at: int, size: int>>").alias("italics"))

    def step(acc: Column, token: Column) -> Column:
        text, opened, found = acc["text"], acc["open"], acc["italics"]
        at = F.length(text)
        begins, ends = token.rlike("(?i)^<(i|em)[ >]"), token.rlike("(?i)^</(i|em)>$")
        closed = F.concat(found, F.array(F.struct(opened.alias("at"), (at - opened).alias("size"))))
        return F.struct(
            F.when(token.rlike("^<[^>]*>$"), text).otherwise(F.concat(text, token)).alias("text"),
            F.when(begins, at).when(ends, F.lit(-1)).otherwise(opened).alias("open"),
            F.when(ends & (opened >= 0) & (at > opened), closed).otherwise(found).alias("italics"),
        )

    done = F.aggregate(tokens, start, step)
    return F.when(c.isNotNull(), F.struct(done["text"].alias("text"), done["italics"].alias("italics")))
