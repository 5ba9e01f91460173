"""Clue text, letters, slots, grid rules and clueability on clue_entry, play_save and the documents' words."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.operators import filling, geometry, lexicon, ordering
from cluemill.operators.topk import top_k
from cluemill.plans import annotations, problems, puzzles
from cluemill.plans import corpus as corpus_plans
from cluemill.session import table

UNKNOWN_RANK = 60_000
#: Fixed value: an 11 x 11 grid of 20 entries of 4 to 10 letters, symmetric.
PATTERN = (
    "....#......", ".#.#.#.#.#.", ".....#.....", ".#.#.#.#.#.", ".........##", ".###.#.###.", "##.........", ".#.#.#.#.#.", ".....#.....", ".#.#.#.#.#.", "......#....",
)


def _latest(spark, sf_dir):
    return puzzles._latest(spark, sf_dir)


def multiset_diff(spark, sf_dir):
    """Letters that the answer has more often than its definition, and those that it has less often."""
    rows = _latest(spark, sf_dir).where("answer IS NOT NULL AND definition IS NOT NULL")
    letters = lambda c, name: rows.select("puzzle_id", "entry_id", F.explode(F.split(text.letters(F.col(c)), "")).alias("letter")).where("letter <> ''").groupBy("puzzle_id", "entry_id", "letter").agg(F.count(F.lit(1)).alias(name))
    both = letters("answer", "a").join(letters("definition", "s"), ["puzzle_id", "entry_id", "letter"], "full").withColumn("d", F.coalesce("a", F.lit(0)) - F.coalesce("s", F.lit(0))).where("d <> 0")
    joined = lambda positive: F.array_join(F.array_sort(F.flatten(F.collect_list(F.when((F.col("d") > 0) == positive, F.array_repeat("letter", F.abs("d").cast("int")))))), "")
    return both.groupBy("puzzle_id", "entry_id").agg(joined(F.lit(True)).alias("extra"), joined(F.lit(False)).alias("missing"))


def definition_place(spark, sf_dir):
    """Where the definition stands in the bare clue."""
    bare = F.trim(F.regexp_replace("clue", r"\s*\([0-9][0-9, -]*\)\s*$", ""))
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL AND definition IS NOT NULL AND definition <> ''").select(bare.alias("bare"), "definition")
    place = F.when(F.startswith("bare", F.col("definition")), "start").when(F.endswith("bare", F.col("definition")), "end").when(F.contains("bare", F.col("definition")), "inside").otherwise("absent")
    return rows.groupBy(place.alias("place")).agg(F.count(F.lit(1)).alias("n"))


def redacted_clues(spark, sf_dir):
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL AND definition IS NOT NULL AND definition <> ''")
    return rows.select("puzzle_id", "entry_id", F.replace("clue", "definition", F.lit("___")).alias("clue"))


def usable_clues(spark, sf_dir):
    """Clues of at least 12 characters whose enumeration sums up to the answer, without brackets of other kinds, references to other entries or the answer itself."""
    sizes = text.enumeration_sizes(text.enumeration(F.col("clue")))
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    rows = _latest(spark, sf_dir).where("length(clue) >= 12 AND answer IS NOT NULL")
    return rows.where((total == F.length(text.letters(F.col("answer")))) & (text.enumeration(F.col("clue")) != "") & ~F.col("clue").rlike(r"[{}\[\]<>]") & ~F.lower("clue").rlike(r"\b\d+ ?(?:across|down|ac|dn)\b") & ~F.contains(text.letters(F.col("clue")), text.letters(F.col("answer")))).select("clue_id")


def rival_clues(spark, sf_dir):
    """Up to three clues for each answer, the longest first."""
    rows = _latest(spark, sf_dir).where("answer IS NOT NULL AND clue IS NOT NULL").select("answer", "clue_id", F.length("clue").alias("size"))
    return top_k(rows, ["answer"], [F.col("size").desc(), F.col("clue_id")], 3).select("answer", "clue_id", "place")


def clue_packets(spark, sf_dir):
    """Each puzzle's clues as one text in page order."""
    line = F.concat_ws(" ", F.col("entry_no").cast("string"), "direction", "clue")
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL").groupBy("puzzle_id").agg(F.array_sort(F.collect_list(F.struct("direction", "entry_no", "entry_id", line.alias("line")))).alias("l"))
    return rows.select("puzzle_id", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("packet"), F.size("l").cast("bigint").alias("n"))


def _cells(spark, sf_dir):
    return puzzles._cells(spark, sf_dir)


def checked_counts(spark, sf_dir):
    used = F.count(F.lit(1)).over(Window.partitionBy("puzzle_id", "x", "y"))
    return _cells(spark, sf_dir).withColumn("used", used).groupBy("puzzle_id", "entry_id").agg(F.count_if(F.col("used") > 1).alias("checked"), F.count_if(F.col("used") == 1).alias("unchecked"))


def through_cuts(spark, sf_dir):
    """Per grid the least number of places in which two neighbouring rows or columns are both open."""
    return geometry.through_cuts(_cells(spark, sf_dir).select("puzzle_id", "x", "y").distinct(), "puzzle_id")


def grid_rules(spark, sf_dir):
    """Violations of the grid rules per puzzle: a code and a number of cells or entries."""
    cells = _cells(spark, sf_dir)
    asymmetric = geometry.not_symmetric(cells.select("puzzle_id", "x", "y", F.lit(puzzles.GRID).alias("rows"), F.lit(puzzles.GRID).alias("cols")), "puzzle_id", "rows", "cols").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("asymmetric"))
    outside = cells.where(~F.col("x").between(0, puzzles.GRID - 1) | ~F.col("y").between(0, puzzles.GRID - 1)).groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("outside"))
    short = _latest(spark, sf_dir).where("n_cells < 3").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("short-entry"))
    light = checked_counts(spark, sf_dir).where("unchecked > checked + CASE WHEN unchecked + checked >= 9 THEN 1 ELSE 0 END").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("under-checked"))
    runs = puzzles.unchecked_runs(spark, sf_dir).where("longest > 2").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).withColumn("code", F.lit("unchecked-run"))
    return asymmetric.unionByName(outside).unionByName(short).unionByName(light).unionByName(runs).select("puzzle_id", "code", "n")


def slot_candidates(spark, sf_dir):
    """How many known solutions fit the letters at the even places of each entry."""
    mask = lambda c: F.array_join(F.filter(F.transform(F.split(c, ""), lambda l, n: F.when(n % 2 == 0, l).otherwise(".")), lambda l: l != ""), "")
    known = _latest(spark, sf_dir).where("solution IS NOT NULL").select(F.col("solution").alias("word")).distinct().groupBy(mask("word").alias("mask")).agg(F.count(F.lit(1)).alias("n_words"))
    return _latest(spark, sf_dir).where("solution IS NOT NULL").select("puzzle_id", "entry_id", mask("solution").alias("mask")).join(known, "mask")


def obscurity(spark, sf_dir):
    """Per puzzle the mean logarithm of the rank of its entries' solutions among the documents' words."""
    rows = _latest(spark, sf_dir).where("solution IS NOT NULL").select("puzzle_id", F.lower("solution").alias("word")).join(corpus_plans.ranked(spark, sf_dir), "word", "left")
    value = F.log10(F.greatest(F.coalesce("rank", F.lit(UNKNOWN_RANK)), F.lit(10)))
    return rows.groupBy("puzzle_id").agg(F.round(F.avg(value), 6).alias("obscurity"))


def _scored(words, hooks):
    """words with the sum of the points of the hooks (code, points, rows with the words that have it), 100 at most, and their codes."""
    found = None
    for n, (code, points, rows) in enumerate(hooks):
        one = rows.select("word").distinct().select("word", F.lit(code).alias("code"), F.lit(points).alias("points"), F.lit(n).alias("n"))
        found = one if found is None else found.unionByName(one)
    scored = found.groupBy("word").agg(F.least(F.lit(100), F.sum("points")).alias("score"), F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("n", "code"))), lambda x: x["code"]), "").alias("hooks"))
    return words.join(scored, "word", "left").select("word", F.coalesce("score", F.lit(0)).alias("score"), F.coalesce("hooks", F.lit("-")).alias("hooks"))


def clueability(spark, sf_dir):
    """Score of each word of the lexicon by what can be done with its letters, 100 at most, and the codes of that.

    Anagrams, charades of two or three pieces, containers, words backwards (R) or, with half their points, a word of four
    letters backwards inside a word that is none itself backwards (r), neighbours, homophones, near anagrams.
    """
    words = corpus_plans._lexicon(spark, sf_dir).select("word")
    whole = lexicon.reversals(words, 2).where("word <> turned")
    split = lambda rows: rows.select(F.explode(F.split("words", ",")).alias("word"))
    return _scored(words, [
        ("A", 30, split(lexicon.anagram_groups(words))), ("C", 25, lexicon.piece_charades(words, 2)), ("X", 20, lexicon.containers(words, 2, 2)),
        ("R", 20, whole), ("r", 10, lexicon.reversed_parts(words, 4).join(whole, "word", "left_anti")), ("D", 15, lexicon.neighbours(words)), ("H", 12, split(corpus_plans.homophones(spark, sf_dir))), ("N", 10, lexicon.near_anagrams(words)),
    ])


def clueability_top(spark, sf_dir):
    """The three best words of each length from 3 letters on, by score and then the last in the alphabet."""
    rows = clueability(spark, sf_dir).select(F.length("word").alias("n_letters"), "word", "score").where("n_letters >= 3")
    return top_k(rows, ["n_letters"], [F.col("score").desc(), F.col("word").desc()], 3)


#: Least clueability of words by their length, and least familiarity, for a place in a grid.
FLOORS, LEAST_FAMILIAR = ((3, 40), (4, 35), (5, 25), (6, 15)), 8


def fill_candidates(spark, sf_dir):
    """The five best words of each length for a grid: by clueability, then familiarity, then the alphabet, above their length's floor."""
    floor = F.lit(10)
    for n, least in FLOORS:
        floor = F.when(F.length("word") == n, least).otherwise(floor)
    rows = clueability(spark, sf_dir).join(corpus_plans.word_familiarity(spark, sf_dir).select("word", "familiarity"), "word")
    rows = rows.where((F.length("word") >= 3) & (F.col("score") >= floor) & (F.col("familiarity") >= LEAST_FAMILIAR)).select(F.length("word").alias("n_letters"), "word", "score", "familiarity")
    return top_k(rows, ["n_letters"], [F.col("score").desc(), F.col("familiarity").desc(), F.col("word")], 5)


def abbreviation_anagrams(spark, sf_dir):
    """Words whose letters are those of an abbreviation and another word; abbreviations are the one or two letters that blocks of the documents give.

    Fewer than 26 + 26 x 26 abbreviations, whatever the documents.
    """
    gives = annotations._rows(spark, sf_dir, "blocks").select(F.lower(F.col("attributes")["gives"]).alias("abbreviation")).where("abbreviation RLIKE '^[a-z]{1,2}$'").distinct()
    return lexicon.abbreviation_anagrams(corpus_plans._lexicon(spark, sf_dir), gives)


def vetoed_words(spark, sf_dir):
    """Lexicon words that are no solution yet."""
    used = table(spark, sf_dir, "clue_entry").where("solution IS NOT NULL").select(F.lower("solution").alias("word"))
    return corpus_plans._lexicon(spark, sf_dir).join(used, "word", "left_anti").select("word")


def first_charades(spark, sf_dir):
    """The first four charades of each word: two pieces before three, then by the places of the cuts."""
    rows = lexicon.piece_charades(corpus_plans._lexicon(spark, sf_dir), 2)
    best = top_k(rows, ["word"], [F.size("pieces"), F.length(F.get("pieces", F.lit(0))), F.length(F.get("pieces", F.lit(1)))], 4)
    return best.select("word", F.array_join("pieces", "+").alias("pieces"), "place")


def hint_depth(spark, sf_dir):
    """Entries by the number of different rungs opened, and players among them who also used reveals."""
    rows = table(spark, sf_dir, "play_save").select("save_id", "reveals_used", F.explode("hints_shown").alias("entry_id", "rungs"))
    return rows.groupBy(F.size(F.array_distinct("rungs")).alias("depth")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("reveals_used") > 0).alias("n_revealed"))


def month_weekday(spark, sf_dir):
    """Puzzles by month and weekday (Monday 0) of their day of publication."""
    at = F.timestamp_millis("published_ms")
    return puzzles._index(spark, sf_dir).where("published_ms IS NOT NULL").groupBy(F.date_format(at, "yyyy-MM").alias("month"), F.weekday(at).alias("weekday")).agg(F.count(F.lit(1)).alias("n"))


def grid_fill(spark, sf_dir):
    """Fills of an 11 x 11 grid with the documents' words of its entries' lengths, all of them, scored by their counts' familiarity.

    A seed's search ends by its nodes alone, so its row does not depend on the load of the machine. The lexicon is as
    large as the vocabulary; its order is fixed because the seeds' random numbers are dealt in it.
    """
    lengths = sorted({len(cells) for cells in filling.slots(PATTERN)})
    words = corpus_plans.word_familiarity(spark, sf_dir).where(F.length("word").isin(lengths)).orderBy("rank").select("word", "familiarity").collect()
    return filling.fills(spark, PATTERN, {r.word: r.familiarity for r in words}, seeds=8)



NAMES = """multiset_diff definition_place redacted_clues usable_clues rival_clues clue_packets checked_counts through_cuts grid_rules slot_candidates
obscurity clueability clueability_top fill_candidates abbreviation_anagrams vetoed_words first_charades hint_depth month_weekday grid_fill""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_E, _C, _L, _I = puzzles._E, puzzles._C, corpus_plans._L, puzzles._I
_BARE = r"trim(regexp_replace(clue, '\s*\([0-9][0-9, -]*\)\s*$', ''), ' ')"
_ENUM = r"regexp_extract(clue, '\(([0-9][0-9, -]*)\)\s*$', 1)"
_USED = _C + ", u AS (SELECT *, count(*) OVER (PARTITION BY puzzle_id, x, y) AS used FROM c), k AS (SELECT puzzle_id, entry_id, count(*) FILTER (used > 1) AS checked, count(*) FILTER (used = 1) AS unchecked FROM u GROUP BY 1, 2)"
_MASK = "array_to_string(list_transform(string_split(solution, ''), lambda l, n: CASE WHEN n % 2 = 1 THEN l ELSE '.' END), '')"
_WHOLE = "(SELECT word FROM w WHERE word <> reverse(word) AND reverse(word) IN (SELECT word FROM w))"
_HOOKS = (
    ("A", 30, f"SELECT word FROM (SELECT word, count(*) OVER (PARTITION BY {corpus_plans._KEYED}) AS k FROM w) WHERE k > 1"),
    ("C", 25, f"SELECT word FROM ({corpus_plans.SQL['charade_splits']})"), ("X", 20, f"SELECT word FROM ({corpus_plans.SQL['container_splits']})"),
    ("R", 20, _WHOLE), ("r", 10, f"SELECT word FROM ({corpus_plans.SQL['reversed_parts']}) WHERE word NOT IN {_WHOLE}"), ("D", 15, f"SELECT word FROM ({corpus_plans.SQL['edit_distance_one']})"),
    ("H", 12, f"SELECT unnest(string_split(words, ',')) AS word FROM ({corpus_plans.SQL['homophones']})"), ("N", 10, f"SELECT word FROM ({corpus_plans.SQL['near_anagrams']})"),
)
_CLUEABLE = f"WITH {_L}, h AS (" + " UNION ALL ".join(f"SELECT DISTINCT word, '{c}' AS code, {p} AS points, {n} AS n FROM ({q})" for n, (c, p, q) in enumerate(_HOOKS)) + "), s AS (SELECT word, CAST(least(100, sum(points)) AS BIGINT) AS score, string_agg(code, '' ORDER BY n) AS hooks FROM h GROUP BY 1) SELECT w.word, coalesce(score, 0) AS score, coalesce(hooks, '-') AS hooks FROM w LEFT JOIN s USING (word)"
SQL = {
    "clueability_top": f"SELECT n_letters, word, score, place FROM (SELECT CAST(length(word) AS INTEGER) AS n_letters, word, score, CAST(row_number() OVER (PARTITION BY length(word) ORDER BY score DESC, word DESC) AS INTEGER) AS place FROM ({_CLUEABLE})) WHERE n_letters >= 3 AND place <= 3",
    "fill_candidates": f"SELECT * FROM (SELECT CAST(length(word) AS INTEGER) AS n_letters, word, score, familiarity, CAST(row_number() OVER (PARTITION BY length(word) ORDER BY score DESC, familiarity DESC, word) AS INTEGER) AS place FROM ({_CLUEABLE}) JOIN ({corpus_plans.SQL['word_familiarity']}) USING (word) WHERE length(word) >= 3 AND familiarity >= {LEAST_FAMILIAR} AND score >= CASE length(word) {' '.join(f'WHEN {n} THEN {k}' for n, k in FLOORS)} ELSE 10 END) WHERE place <= 5",
    "abbreviation_anagrams": f"""WITH w AS (WITH {_L} SELECT word FROM w), ab AS (WITH {problems._NODES} SELECT DISTINCT lower(x ->> '$.gives') AS abbreviation FROM c WHERE f = 'blocks' AND regexp_matches(lower(x ->> '$.gives'), '^[a-z]{{1,2}}$')),
y AS (SELECT word, list_sort(string_split(word, '')) AS l FROM w), o AS (SELECT word AS other, array_to_string(l, '') AS key FROM y),
r AS (SELECT DISTINCT word, l[i] AS taken, array_to_string(list_filter(l, lambda x, n: n <> i), '') AS key FROM (SELECT word, l, unnest(range(1, len(l) + 1)) AS i FROM y)
UNION SELECT DISTINCT word, l[i] || l[j], array_to_string(list_filter(l, lambda x, n: n <> i AND n <> j), '') FROM (SELECT word, l, i, unnest(range(i + 1, len(l) + 1)) AS j FROM (SELECT word, l, unnest(range(1, len(l) + 1)) AS i FROM y)))
SELECT word, abbreviation, other FROM r JOIN ab ON array_to_string(list_sort(string_split(abbreviation, '')), '') = taken JOIN o USING (key) WHERE length(key) >= 3""",
    "multiset_diff": f"WITH {_E}, q AS (SELECT puzzle_id, entry_id, {puzzles._LET('answer')} AS a, {puzzles._LET('definition')} AS s FROM e WHERE answer IS NOT NULL AND definition IS NOT NULL), l AS (SELECT puzzle_id, entry_id, unnest(string_split(a, '')) AS letter, 1 AS d FROM q UNION ALL SELECT puzzle_id, entry_id, unnest(string_split(s, '')), -1 FROM q), g AS (SELECT puzzle_id, entry_id, letter, sum(d) AS d FROM l WHERE letter <> '' GROUP BY 1, 2, 3 HAVING sum(d) <> 0) SELECT puzzle_id, entry_id, coalesce(string_agg(repeat(letter, CAST(d AS INTEGER)), '' ORDER BY letter) FILTER (d > 0), '') AS extra, coalesce(string_agg(repeat(letter, CAST(-d AS INTEGER)), '' ORDER BY letter) FILTER (d < 0), '') AS missing FROM g GROUP BY 1, 2",
    "definition_place": f"WITH {_E}, b AS (SELECT {_BARE} AS bare, definition FROM e WHERE clue IS NOT NULL AND definition <> '') SELECT CASE WHEN starts_with(bare, definition) THEN 'start' WHEN ends_with(bare, definition) THEN 'end' WHEN contains(bare, definition) THEN 'inside' ELSE 'absent' END AS place, count(*) AS n FROM b GROUP BY 1",
    "redacted_clues": f"WITH {_E} SELECT puzzle_id, entry_id, replace(clue, definition, '___') AS clue FROM e WHERE clue IS NOT NULL AND definition <> ''",
    "usable_clues": f"WITH {_E} SELECT clue_id FROM e WHERE length(clue) >= 12 AND answer IS NOT NULL AND {_ENUM} <> '' AND coalesce(list_sum(list_transform(regexp_extract_all({_ENUM}, '[0-9]+'), lambda x: CAST(x AS INTEGER))), 0) = length({puzzles._LET('answer')}) AND NOT regexp_matches(clue, '[{{}}\\[\\]<>]') AND NOT regexp_matches(lower(clue), '\\b\\d+ ?(?:across|down|ac|dn)\\b') AND NOT contains({puzzles._LET('clue')}, {puzzles._LET('answer')})",
    "rival_clues": f"WITH {_E}, r AS (SELECT answer, clue_id, CAST(row_number() OVER (PARTITION BY answer ORDER BY length(clue) DESC, clue_id) AS INTEGER) AS place FROM e WHERE answer IS NOT NULL AND clue IS NOT NULL) SELECT * FROM r WHERE place <= 3",
    "clue_packets": f"WITH {_E} SELECT puzzle_id, string_agg(concat_ws(' ', entry_no, direction, clue), chr(10) ORDER BY direction, entry_no, entry_id) AS packet, count(*) AS n FROM e WHERE clue IS NOT NULL GROUP BY 1",
    "checked_counts": f"WITH {_USED} SELECT * FROM k",
    "through_cuts": f"WITH {_C}, l AS (SELECT DISTINCT puzzle_id, x, y FROM c), j AS (SELECT l.puzzle_id, 'y' AS d, l.y AS at, count(*) AS n FROM l JOIN l o ON o.puzzle_id = l.puzzle_id AND o.x = l.x AND o.y = l.y + 1 GROUP BY 1, 2, 3 UNION ALL SELECT l.puzzle_id, 'x', l.x, count(*) FROM l JOIN l o ON o.puzzle_id = l.puzzle_id AND o.y = l.y AND o.x = l.x + 1 GROUP BY 1, 2, 3) SELECT puzzle_id, min(n) AS least FROM j GROUP BY 1",
    "grid_rules": f"""WITH {_USED}, d AS (SELECT DISTINCT puzzle_id, x, y FROM c), a AS ({puzzles.SQL['rot_symmetry']}), m AS ({puzzles.SQL['unchecked_runs']})
SELECT puzzle_id, 'asymmetric' AS code, n_cells AS n FROM a UNION ALL SELECT puzzle_id, 'outside', count(*) FROM c WHERE x NOT BETWEEN 0 AND 14 OR y NOT BETWEEN 0 AND 14 GROUP BY 1
UNION ALL SELECT puzzle_id, 'short-entry', count(*) FROM e WHERE n_cells < 3 GROUP BY 1 UNION ALL SELECT puzzle_id, 'under-checked', count(*) FROM k WHERE unchecked > checked + CASE WHEN unchecked + checked >= 9 THEN 1 ELSE 0 END GROUP BY 1
UNION ALL SELECT puzzle_id, 'unchecked-run', count(*) FROM m WHERE longest > 2 GROUP BY 1""",
    "slot_candidates": f"WITH {_E}, s AS (SELECT puzzle_id, entry_id, solution, {_MASK} AS mask FROM e WHERE solution IS NOT NULL), g AS (SELECT mask, count(DISTINCT solution) AS n_words FROM s GROUP BY 1) SELECT puzzle_id, entry_id, mask, n_words FROM s JOIN g USING (mask)",
    "obscurity": f"WITH {_L}, {_E}, r AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM w) SELECT puzzle_id, round(avg(log10(greatest(coalesce(rank, {UNKNOWN_RANK}), 10))), 6) AS obscurity FROM e LEFT JOIN r ON r.word = lower(solution) WHERE solution IS NOT NULL GROUP BY 1",
    "clueability": _CLUEABLE,
    "vetoed_words": f"WITH {_L} SELECT word FROM w WHERE word NOT IN (SELECT lower(solution) FROM clue_entry WHERE solution IS NOT NULL)",
    "first_charades": f"WITH {_L}, {corpus_plans._CHARADES}, r AS (SELECT word, pieces, CAST(row_number() OVER (PARTITION BY word ORDER BY len(pieces), length(pieces[1]), length(pieces[2])) AS INTEGER) AS place FROM ch) SELECT word, array_to_string(pieces, '+') AS pieces, place FROM r WHERE place <= 4",
    "hint_depth": "WITH h AS (SELECT reveals_used, unnest(map_entries(hints_shown)) AS e FROM play_save) SELECT CAST(len(list_distinct(e.value)) AS INTEGER) AS depth, count(*) AS n, count(*) FILTER (reveals_used > 0) AS n_revealed FROM h GROUP BY 1",
    "month_weekday": f"WITH {_I} SELECT strftime(make_timestamp(published_ms * 1000), '%Y-%m') AS month, CAST(isodow(make_timestamp(published_ms * 1000)) - 1 AS INTEGER) AS weekday, count(*) AS n FROM i WHERE published_ms IS NOT NULL GROUP BY 1, 2",
}
