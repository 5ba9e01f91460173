"""Annotations of entries with their parts as arrays, and the checks over them.

``gathered`` brings the flat rows of a shredded document back together, one row per annotation: a single grouping by the
annotation's node, whose parts are as many as one annotation has. All checks are array expressions on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cluemill.functions.text import letter_key, letters, tidy_words
from cluemill.operators.rules import Rule, RuleSet

PARTS = ("blocks", "pieces", "indicators", "linkWords", "indicatorNotes", "subAnagrams", "subReversals")

#: Parts of a type, those whose answer is heard, and those whose blocks need not hold the answer's letters.
TYPE_PARTS = (
    "anagram", "charade", "container", "hidden word", "homophone", "reversal", "deletion", "double definition", "cryptic definition", "&lit", "spoonerism",
    "first letter", "first letters", "last letter", "last letters", "middle letter", "middle letters", "outer letters", "alternate letters", "cycling", "substitution",
)
HEARD = ("homophone", "spoonerism")
UNBALANCED = ("deletion", "substitution", "cryptic definition", "double definition", "homophone", "spoonerism", "&lit")
#: Cost of each part of a type, and what is added to the costliest one.
DEVICE_COST = {
    "hidden word": 0.15, "anagram": 0.30, "charade": 0.45, "reversal": 0.50, "container": 0.50, "double definition": 0.55,
    "first letter": 0.55, "first letters": 0.55, "last letter": 0.55, "last letters": 0.55, "middle letter": 0.55, "middle letters": 0.55, "outer letters": 0.55, "alternate letters": 0.55,
    "homophone": 0.60, "deletion": 0.60, "&lit": 0.80, "cryptic definition": 0.85,
}
OTHER_DEVICE, PER_DEVICE, PER_SEAM, PER_SHORT_PIECE, NO_INDICATOR = 0.50, 0.12, 0.09, 0.06, 0.06
SHORT_PIECE = 2
NEVER_INDICATED = ("double definition", "cryptic definition")
#: Share of a puzzle's entries that must be annotated for a cost.
MOST = 0.8
#: Most entries of a puzzle with each fault of its blocks.
PUZZLE_CAPS = {"blocks-differ": 2, "blocks-undivided": 2, "blocks-misordered": 0}
#: Words by which an explanation places parts, and words by which it teaches a convention.
PLACING = (
    r"\b(inside|around|round|in front|follows?|following|sits?|before|after|precedes?|next to|side by side|within|wraps?|swallow\w*|contain\w*|enclos\w*|goes? in|splits?|splitting|between|on top)\b"
)
TEACHING = r"\b(abbreviat\w*|staple\w*|worth banking|stands for|shorthand|standard|convention\w*|vocabulary|crosswordese|every solver|symbol|the setter\w* word)\b"


def gathered(rows: DataFrame, doc_key: str) -> DataFrame:
    """One row per annotation with its entry, from shredded rows of entries, annotation and PARTS (which are read twice)."""
    attr = lambda name: F.col("attributes")[name]
    entries = rows.where("element = 'entries'").select(doc_key, F.col("keys")["entries"].alias("entry_id"), attr("clue").alias("clue"), attr("solution").alias("solution"), attr("direction").alias("direction"))
    owner = F.when(F.col("element") == "annotation", F.col("node_id")).otherwise(F.col("parent_id"))
    own = lambda c, name: F.max(F.when(F.col("element") == "annotation", c)).alias(name)

    def listed(element: str, value: Column, name: str) -> Column:
        items = F.collect_list(F.when(F.col("element") == element, F.struct("item_no", value.alias("v"))))
        return F.transform(F.array_sort(items), lambda x: x["v"]).alias(name)

    block = F.struct(attr("clueFragment").alias("fragment"), attr("gives").alias("gives"), attr("note").alias("note"), attr("soundsLike").alias("sounds"))
    notes = rows.where(F.col("element").isin("annotation", *PARTS)).groupBy(doc_key, owner.alias("node_id")).agg(
        own(F.col("keys")["entries"], "entry_id"), own(F.col("has_fields"), "_there"), own(attr("type"), "kind"), own(attr("answer"), "answer"), own(attr("definition"), "definition"),
        own(attr("anagram.fodder"), "fodder"), own(attr("linkedTo"), "linked_to"), own(attr("walkthrough"), "walkthrough"),
        listed("pieces", F.coalesce(attr("value"), attr("text")), "pieces"), listed("indicators", attr("value"), "indicators"), listed("linkWords", attr("value"), "link_words"),
        listed("indicatorNotes", F.col("item_key"), "noted"), listed("blocks", block, "blocks"),
        listed("subAnagrams", F.struct(attr("fodder").alias("fodder"), attr("gives").alias("gives")), "sub_anagrams"), listed("subReversals", F.struct(attr("from").alias("from"), attr("to").alias("to")), "sub_reversals"),
    )
    return notes.where("_there").drop("_there").join(entries, [doc_key, "entry_id"])


def type_parts(kind: Column) -> Column:
    return F.filter(F.transform(F.split(F.lower(kind), r"\+"), lambda p: F.trim(p)), lambda p: p != "")


def device_cost(kind: Column, indicators: Column, pieces: Column) -> Column:
    """Cost of one annotation, 1 at most: its costliest device, each further one, each seam beyond the first, short pieces,
    and a missing indicator. Null without a type."""
    parts = type_parts(kind)
    costs = F.create_map(*[F.lit(x) for pair in DEVICE_COST.items() for x in pair])
    dearest = F.array_max(F.transform(parts, lambda p: F.coalesce(costs[p], F.lit(OTHER_DEVICE))))
    bare = (F.size(indicators) == 0) & ~F.arrays_overlap(parts, F.array(*map(F.lit, NEVER_INDICATED)))
    short = F.size(F.filter(pieces, lambda p: F.length(F.regexp_replace(p, r"[^\p{L}]", "")).between(1, SHORT_PIECE)))
    cost = dearest + PER_DEVICE * (F.size(parts) - 1) + F.when(bare, NO_INDICATOR).otherwise(0.0) + PER_SEAM * F.greatest(F.size(pieces) - 2, F.lit(0)) + PER_SHORT_PIECE * short
    return F.when(F.size(parts) > 0, F.least(F.lit(1.0), cost))


def _key(c: Column) -> Column:
    return letter_key(letters(c))


def _any(column: str, test) -> Column:
    return F.exists(column, test)


def _said(c: Column) -> Column:
    return F.coalesce(letters(c), F.lit("")) != ""


def _answer() -> Column:
    return letters(F.col("answer"))


def _block_letters() -> Column:
    return F.array_join(F.transform("blocks", lambda b: F.coalesce(letters(b["gives"]), F.lit(""))), "")


def _free() -> Column:
    return F.col("linked_to").isNull()


def _sound() -> Column:
    return F.col("kind").rlike("(?i)" + "|".join(HEARD))


def _balanced() -> Column:
    return _free() & ~F.coalesce(F.col("kind").rlike("|".join(UNBALANCED)), F.lit(False))


#: Checks of one annotation; a null on either side is no violation.
ANNOTATION_RULES = RuleSet(
    Rule("field-missing", "E", lambda: _free() & (F.col("kind").isNull() | F.col("answer").isNull() | F.col("definition").isNull())),
    Rule("type-part-unknown", "E", lambda: F.exists(F.split("kind", r" \+ "), lambda p: (p != "") & ~p.isin(*TYPE_PARTS))),
    Rule("answer-differs", "E", lambda: (_answer() != letters(F.col("solution"))) & _said(F.col("solution"))),
    Rule("definition-not-in-clue", "E", lambda: ~F.contains("clue", F.col("definition"))),
    Rule("indicator-not-in-clue", "E", lambda: _any("indicators", lambda x: ~F.contains(F.col("clue"), x))),
    Rule("link-word-not-in-clue", "E", lambda: _any("link_words", lambda x: ~F.contains(F.col("clue"), x))),
    Rule("fragment-not-in-clue", "W", lambda: _any("blocks", lambda b: (b["fragment"] != "") & ~F.contains(F.col("clue"), b["fragment"]))),
    Rule("fodder-differs", "E", lambda: _key(F.col("fodder")) != letter_key(_answer())),
    Rule("pieces-differ", "E", lambda: (F.size("pieces") > 0) & (letters(F.array_join("pieces", "")) != _answer())),
    Rule(
        "hidden-not-found", "E",
        lambda: F.contains("kind", F.lit("hidden")) & ~F.contains(letters(F.col("clue")), _answer()) & ~(F.contains("kind", F.lit("reversal")) & F.contains(letters(F.col("clue")), F.reverse(_answer()))),
    ),
    Rule("no-assembly", "W", lambda: F.col("fodder").isNull() & (F.size("pieces") == 0) & ~F.col("kind").rlike("hidden|definition|homophone")),
    Rule("heard-without-gives", "E", lambda: _any("blocks", lambda b: (b["sounds"] != "") & (F.coalesce(b["gives"], F.lit("")) == ""))),
    Rule("heard-is-written", "E", lambda: _any("blocks", lambda b: (b["sounds"] != "") & (b["gives"] != "") & (letters(b["sounds"]) == letters(b["gives"])))),
    Rule("heard-without-type", "E", lambda: ~_sound() & _any("blocks", lambda b: F.coalesce(b["sounds"], F.lit("")) != "")),
    Rule("type-without-heard", "E", lambda: _sound() & ~_any("blocks", lambda b: F.coalesce(b["sounds"], F.lit("")) != "")),
    Rule("sub-anagram-differs", "E", lambda: _any("sub_anagrams", lambda s: _key(s["fodder"]) != _key(s["gives"]))),
    Rule("sub-reversal-differs", "E", lambda: _any("sub_reversals", lambda s: F.reverse(letters(s["from"])) != letters(s["to"]))),
    Rule("note-without-indicator", "E", lambda: F.size(F.array_except("noted", "indicators")) > 0),
    Rule("indicator-without-note", "W", lambda: F.size(F.array_except("indicators", "noted")) > 0),
    Rule("blocks-differ", "W", lambda: _balanced() & (_block_letters() != "") & (letter_key(_block_letters()) != letter_key(_answer()))),
    Rule(
        "blocks-undivided", "W",
        lambda: _free() & (F.size("pieces") >= 2) & F.exists("pieces", lambda p: F.length(letters(p)) > 1) & _any("blocks", lambda b: letters(b["gives"]) == _answer()) & (F.size(F.filter("blocks", lambda b: _said(b["gives"]))) == 1),
    ),
    Rule("blocks-misordered", "W", lambda: _free() & (F.trim("kind") == "charade") & (_block_letters() != "") & (_block_letters() != _answer()) & (letter_key(_block_letters()) == letter_key(_answer()))),
    Rule("block-without-note", "W", lambda: _free() & _any("blocks", lambda b: _said(b["gives"]) & (F.trim(F.coalesce(b["note"], F.lit(""))) == ""))),
)


def over_cap(violations: DataFrame, puzzle: str) -> DataFrame:
    """(puzzle, code, n): faults of blocks that a puzzle has more often than PUZZLE_CAPS allows."""
    caps = F.create_map(*[F.lit(x) for pair in PUZZLE_CAPS.items() for x in pair])
    return violations.where(F.col("code").isin(*PUZZLE_CAPS)).groupBy(puzzle, "code").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > caps[F.col("code")])


def chunks(blocks: Column, pieces: Column) -> Column:
    """Distinct groups of two letters and more that an annotation's blocks and pieces stand for, without spaces, upper case."""
    raw = F.concat(F.transform(blocks, lambda b: b["gives"]), pieces)
    return F.filter(F.array_distinct(F.transform(raw, lambda x: F.upper(F.replace(x, F.lit(" "), F.lit(""))))), lambda x: F.length(x) >= 2)


def renarrated(notes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, hits): explanations that name two or more of their own chunks in capitals: 0 where they place parts and
    teach nothing, 1 where they do both, 2 where they only name them."""
    named = F.array_distinct(F.transform(F.regexp_extract_all("walkthrough", F.lit(r"\b[A-Z][A-Z’'-]+\b"), F.lit(0)), lambda t: F.regexp_replace(t, "[’'-]", "")))
    answer = F.upper(F.replace(F.coalesce("answer", F.lit("")), F.lit(" "), F.lit("")))
    hits = F.array_sort(F.array_remove(F.array_intersect(named, chunks(F.col("blocks"), F.col("pieces"))), answer))
    placing, teaching = F.col("walkthrough").rlike("(?i)" + PLACING), F.col("walkthrough").rlike("(?i)" + TEACHING)
    rank = F.when(placing & ~teaching, 0).when(placing, 1).otherwise(2)
    return notes.where("walkthrough IS NOT NULL").select(*keys, rank.alias("rank"), hits.alias("hits")).where(F.size("hits") >= 2)


def unclaimed(notes: DataFrame, keys: list[str], filler: tuple[str, ...]) -> DataFrame:
    """(keys, words): words of the clue that neither definition, indicators, link words nor fragments hold, but for filler."""
    claimed = F.flatten(F.transform(F.concat(F.array("definition"), "indicators", "link_words", F.transform("blocks", lambda b: b["fragment"])), lambda x: F.coalesce(tidy_words(x), F.array().cast("array<string>"))))
    words = F.array_sort(F.array_except(F.array_except(tidy_words(F.col("clue")), claimed), F.array(*map(F.lit, filler))))
    return notes.where("clue IS NOT NULL").select(*keys, words.alias("words")).where(F.size("words") > 0)
