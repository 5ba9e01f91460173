"""Words, spans and marks of clue text, on clue_entry and puzzle_index."""

from __future__ import annotations

from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.operators.topk import top_k
from cluemill.plans import annotations, corpus, puzzles
from cluemill.session import table

#: Words after which a word is counted.
CONTEXTS = {"after_to": ("to",), "after_determiner": ("a", "an", "the"), "after_subject": ("he", "she", "it", "we", "they", "i", "you", "who")}
#: Seed of the shuffle of rivals.
SEED = "20"


def _latest(spark, sf_dir):
    return puzzles._latest(spark, sf_dir)


def clue_words(spark, sf_dir):
    """The words of each clue with contractions split."""
    rows = table(spark, sf_dir, "clue_entry").where("clue IS NOT NULL")
    return rows.select("clue_id", F.array_join(text.clue_words(F.col("clue")), " ").alias("words"))


def clue_tokens(spark, sf_dir):
    """Every visible run of signs of each clue with its place in the text, the enumeration left out."""
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL")
    return rows.select("clue_id", F.posexplode(text.placed_tokens(F.col("clue"))).alias("n", "t")).select("clue_id", "n", F.col("t.at").alias("at"), F.col("t.text").alias("text"))


def base_words(spark, sf_dir):
    """Lexicon words in -s whose base form is in the lexicon too: plurals, and verbs of the third person."""
    words = corpus._lexicon(spark, sf_dir).select("word")
    forms = words.select("word", F.explode(text.base_forms(F.col("word"))).alias("base"))
    return forms.join(words.withColumnRenamed("word", "base"), "base", "left_semi").select("word", "base").distinct()


def gerunds(spark, sf_dir):
    """Lexicon words in -ing whose verb is in the lexicon: without ing, with e for it, or without a doubled letter."""
    words = corpus._lexicon(spark, sf_dir).select("word")
    stem = F.expr("substring(word, 1, length(word) - 3)")
    forms = F.array(stem, F.concat(stem, F.lit("e")), F.when(F.right(stem, F.lit(1)) == F.substring(stem, -2, 1), F.expr("substring(word, 1, length(word) - 4)")))
    rows = words.where("word LIKE '%ing' AND length(word) >= 6").select("word", F.explode(F.array_compact(forms)).alias("verb"))
    return rows.join(words.withColumnRenamed("word", "verb"), "verb", "left_semi").select("word", "verb").distinct()


def _verbs(spark, sf_dir):
    """Words that follow "to" in at least a fifth of their places and ten times at least."""
    from cluemill.operators import corpus as statistics

    rows = statistics.contexts(corpus._docs(spark, sf_dir), "text", ("to",))
    return rows.where("after >= 10 AND after * 4 >= other").select("word", "after", "other")


def verb_sets(spark, sf_dir):
    return _verbs(spark, sf_dir)


def imperative_openings(spark, sf_dir):
    """Clues that open with a verb's base form."""
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL").select("clue_id", F.get(text.clue_words(F.col("clue")), F.lit(0)).alias("word"))
    return rows.join(_verbs(spark, sf_dir).select("word"), "word", "left_semi").select("clue_id", "word")


def setter_anchors(spark, sf_dir):
    """Anchors of the setters' names, and how many spellings share each."""
    names = table(spark, sf_dir, "puzzle_index").where("setter IS NOT NULL").select("setter").distinct()
    return names.groupBy(text.anchor(F.col("setter")).alias("anchor")).agg(F.count(F.lit(1)).alias("n_names"))


def span_overlaps(spark, sf_dir):
    """Indicators whose first place in the clue overlaps the definition's."""
    rows = _latest(spark, sf_dir).where("definition <> ''").select("clue_id", "clue", "definition", F.explode("indicators").alias("indicator")).where("indicator <> ''")
    placed = rows.select("clue_id", "indicator", F.expr("instr(clue, definition)").alias("d"), F.expr("instr(clue, indicator)").alias("i"), F.length("definition").alias("dn"), F.length("indicator").alias("n"))
    return placed.where("d > 0 AND i > 0 AND i < d + dn AND d < i + n").select("clue_id", "indicator", (F.col("i") - 1).alias("at"), (F.col("d") - 1).alias("definition_at"))


def best_occurrence(spark, sf_dir):
    """Where an indicator stands best in the clue: at word borders and clear of the definition, at borders, clear of it, anywhere."""
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL").select("clue_id", "clue", F.expr("instr(clue, definition)").alias("d"), F.length("definition").alias("dn"), F.explode("indicators").alias("indicator")).where("indicator <> ''")
    letter = lambda at: F.expr(f"coalesce(substring(clue, {at}, 1) RLIKE '[A-Za-z]', false) AND {at} >= 1")
    places = rows.withColumn("n", F.length("indicator")).withColumn("p", F.explode(text.occurrences(F.col("clue"), F.col("indicator")))).withColumn("p", F.col("p") + 1)
    border = ~(letter("p") & letter("(p - 1)")) & ~(letter("(p + n - 1)") & letter("(p + n)"))
    clear = ~F.coalesce((F.col("d") > 0) & (F.col("p") < F.col("d") + F.col("dn")) & (F.col("d") < F.col("p") + F.col("n")), F.lit(False))
    kind = F.when(border & clear, 0).when(border, 1).when(clear, 2).otherwise(3)
    return places.groupBy("clue_id", "indicator").agg(F.min(F.struct(kind.alias("kind"), (F.col("p") - 1).alias("at"))).alias("m")).select("clue_id", "indicator", "m.kind", "m.at")


def fodder_spans(spark, sf_dir):
    """Where the letters of an anagram's fodder stand in the clue in order, widened to whole words; every place of them."""
    rows = annotations._notes(spark, sf_dir).where("clue IS NOT NULL AND fodder IS NOT NULL")
    at = rows.select("raw_id", "entry_id", "clue", F.explode(text.letter_spans(F.col("clue"), text.letters(F.col("fodder")))).alias("s")).select("raw_id", "entry_id", "clue", "s.a", "s.b")
    before = F.length(F.regexp_extract(F.expr("substring(clue, 1, a)"), r"\p{L}*$", 0))
    after = F.length(F.regexp_extract(F.expr("substring(clue, b + 1)"), r"^\p{L}*", 0))
    return at.select("raw_id", "entry_id", (F.col("a") - before).alias("starts"), (F.col("b") + after).alias("ends")).distinct()


def hidden_spans(spark, sf_dir):
    """Where an answer's letters, or their reverse, stand in the clue in order."""
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL").select("clue_id", "clue", text.letters(F.col("answer")).alias("a")).where("length(a) >= 3")
    ways = F.explode(F.array_distinct(F.array("a", F.reverse("a")))).alias("way")
    found = rows.select("clue_id", "clue", "a", ways).select("clue_id", (F.col("way") != F.col("a")).alias("turned"), F.explode(text.letter_spans(F.col("clue"), F.col("way"))).alias("s"))
    return found.select("clue_id", "turned", F.col("s.a").alias("starts"), F.col("s.b").alias("ends"))


def first_sentences(spark, sf_dir):
    """How long the first sentence of an explanation is, in words: explanations by that."""
    rows = annotations._notes(spark, sf_dir).where("walkthrough IS NOT NULL").select(F.size(text.word_list(text.first_sentence(F.col("walkthrough")))).alias("n_words"))
    return rows.groupBy("n_words").agg(F.count(F.lit(1)).alias("n"))


def words_by_answer_length(spark, sf_dir):
    """Median number of words of the clues whose answer has 3 to 12 letters, per length with more than 50 clues."""
    rows = table(spark, sf_dir, "clue_entry").where("clue IS NOT NULL").select(F.length(text.letters(F.col("answer"))).alias("n_letters"), F.size(text.word_list(F.col("clue"))).alias("words"))
    return rows.where("n_letters BETWEEN 3 AND 12").groupBy("n_letters").agg(F.count(F.lit(1)).alias("n"), F.median("words").alias("median_words")).where("n > 50")


def terse_clues(spark, sf_dir):
    """Clues with fewer words than the median of their answer's length less one."""
    rows = table(spark, sf_dir, "clue_entry").where("clue IS NOT NULL").select("clue_id", F.length(text.letters(F.col("answer"))).alias("n_letters"), F.size(text.word_list(F.col("clue"))).alias("words"))
    return rows.join(words_by_answer_length(spark, sf_dir), "n_letters").where("words < median_words - 1").select("clue_id", "words", "median_words")


def context_sets(spark, sf_dir):
    """How often a word follows "to", a determiner or a subject, for words that do so at least ten times in all."""
    pairs = F.transform(F.sequence(F.lit(1), F.size("ws") - 1), lambda k: F.struct(F.get("ws", k).alias("word"), F.get("ws", k - 1).alias("before")))
    rows = corpus._docs(spark, sf_dir).select(text.word_list(F.col("text")).alias("ws")).where(F.size("ws") > 1).select(F.explode(pairs).alias("p")).select("p.*")
    counts = rows.groupBy("word").agg(*[F.count_if(F.col("before").isin(*names)).alias(name) for name, names in CONTEXTS.items()])
    return counts.where(" + ".join(CONTEXTS) + " >= 10")


def separators(spark, sf_dir):
    """Where an answer's words break and by what, from its enumeration; null where that does not fit its length."""
    enum = text.enumeration(F.col("clue"))
    sizes, signs = text.enumeration_sizes(enum), F.regexp_extract_all(enum, F.lit("[,-]"), F.lit(0))
    breaks = text.enumeration_breaks(sizes)
    total = F.aggregate(sizes, F.lit(0), lambda a, x: a + x)
    rows = _latest(spark, sf_dir).where(enum != "")
    marks = F.array_join(F.zip_with(signs, breaks, lambda s, b: F.concat(s, b.cast("string"))), " ")
    return rows.select("clue_id", F.when((total == F.col("n_cells")) & (F.size(signs) == F.size(breaks)), marks).alias("marks"))


def marks_shortest_first(spark, sf_dir):
    """The marked parts of each clue, the shortest first."""
    parts = F.array_distinct(F.filter(F.concat(F.array("definition"), F.coalesce("indicators", F.array().cast("array<string>"))), lambda p: p != ""))
    ordered = F.transform(F.array_sort(F.transform(parts, lambda p: F.struct(F.length(p).alias("n"), p.alias("p")))), lambda x: x["p"])
    return _latest(spark, sf_dir).where("clue IS NOT NULL AND definition IS NOT NULL").select("clue_id", F.array_join(ordered, "|").alias("marks"))


def short_messages(spark, sf_dir):
    """Each puzzle's entries without a type as a message that names the first four and counts the rest."""
    rows = _latest(spark, sf_dir).where("clue_type IS NULL").groupBy("puzzle_id").agg(F.array_sort(F.collect_list("entry_id")).alias("ids"))
    more = F.when(F.size("ids") > 4, F.concat(F.lit(" and "), (F.size("ids") - 4).cast("string"), F.lit(" more"))).otherwise("")
    return rows.select("puzzle_id", F.concat(F.array_join(F.slice("ids", 1, 4), ", "), more).alias("message"))


def shuffled_rivals(spark, sf_dir):
    """Up to three clues for each answer, in an order that a seed shuffles."""
    rows = _latest(spark, sf_dir).where("answer IS NOT NULL AND clue IS NOT NULL").select("answer", "clue_id", F.md5(F.concat(F.col("clue_id").cast("string"), F.lit(":" + SEED))).alias("lot"))
    return top_k(rows, ["answer"], [F.col("lot"), F.col("clue_id")], 3).select("answer", "clue_id", "place")


def redacted_walkthroughs(spark, sf_dir):
    """Explanations with the answer blotted out, also where spaces or hyphens stand between its letters."""
    rows = annotations._notes(spark, sf_dir).where("walkthrough IS NOT NULL").withColumn("a", text.letters(F.col("answer"))).where("length(a) >= 3")
    pattern = F.concat(F.lit("(?i)"), F.array_join(F.split("a", ""), "[ -]?"))
    return rows.select("raw_id", "entry_id", F.md5(F.regexp_replace("walkthrough", pattern, F.lit("___"))).alias("blotted"))


def guess_grades(spark, sf_dir):
    """The words of the definition of an entry's first loading as a guess at those of its last: hit, spare and missed."""
    guess = puzzles._first(spark, sf_dir).select("puzzle_id", "entry_id", text.word_list(F.col("definition")).alias("picked"))
    target = _latest(spark, sf_dir).select("puzzle_id", "entry_id", text.word_list(F.col("definition")).alias("target"))
    both = guess.join(target, ["puzzle_id", "entry_id"]).where("picked IS NOT NULL AND target IS NOT NULL")
    hit, spare, missed = F.size(F.array_intersect("picked", "target")), F.size(F.array_except("picked", "target")), F.size(F.array_except("target", "picked"))
    return both.select("puzzle_id", "entry_id", hit.alias("hit"), spare.alias("spare"), missed.alias("missed"), ((missed == 0) & (spare == 0)).alias("exact"))


def settled_words(spark, sf_dir):
    """Words of a clue that the steps before have settled: for each indicator, those of the definition and of the indicators before it, less its own."""
    rows = _latest(spark, sf_dir).where("clue IS NOT NULL AND definition IS NOT NULL").select("clue_id", text.word_list(F.col("definition")).alias("first"), F.posexplode("indicators").alias("step", "indicator"), "indicators")
    before = F.flatten(F.transform(F.slice("indicators", F.lit(1), F.col("step")), lambda i: text.word_list(i)))
    own = text.word_list(F.col("indicator"))
    return rows.select("clue_id", "step", F.array_join(F.array_sort(F.array_except(F.concat("first", before), own)), " ").alias("settled"))


def unlinked_entries(spark, sf_dir):
    """Annotated entries that no other entry covers."""
    return _latest(spark, sf_dir).where("clue_type IS NOT NULL AND (linked_to IS NULL OR trim(linked_to) = '')").select("puzzle_id", "entry_id")


def stock_indicators(spark, sf_dir):
    """Indicators that are among the documents' stock words, with the entries that use them."""
    stock = corpus.stock_terms(spark, sf_dir).select("word")
    used = _latest(spark, sf_dir).select("puzzle_id", "entry_id", F.explode("indicators").alias("word")).withColumn("word", text.term_key(F.col("word")))
    return used.join(stock, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def sampled_clues(spark, sf_dir):
    """A calibration sample, which is the feature: every second clue by its number, as a share of all."""
    rows = table(spark, sf_dir, "clue_entry").where("clue IS NOT NULL")
    return rows.groupBy((F.col("clue_id") % 2 == 0).alias("sampled")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.length("clue")), 6).alias("mean_length"))


def exceedance(spark, sf_dir):
    """Share of clues longer than each of the fixed numbers of words."""
    rows = table(spark, sf_dir, "clue_entry").where("clue IS NOT NULL").select(F.size(text.word_list(F.col("clue"))).alias("n"))
    counts = rows.agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("n") > k).alias(f"k{k}") for k in (4, 6, 8, 10)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("more_than"), F.round(F.col(f"k{k}") / F.col("all"), 6).alias("share")) for k in (4, 6, 8, 10)])).alias("x")).select("x.*")


NAMES = """clue_words clue_tokens base_words gerunds verb_sets imperative_openings setter_anchors span_overlaps best_occurrence fodder_spans hidden_spans first_sentences words_by_answer_length terse_clues context_sets separators
marks_shortest_first short_messages shuffled_rivals redacted_walkthroughs guess_grades settled_words unlinked_entries stock_indicators sampled_clues exceedance""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_E, _F, _T, _L = puzzles._E, puzzles._F, corpus._T, corpus._L
_ENDS = "^(.+?)(''s|''re|''ll|''ve|''d|n''t)$"
_BARE = r"trim(regexp_replace(replace(replace({0}, '’', ''''), '‘', ''''), '\s*\([\d,\-\s/]+\)\s*$', ''), ' ')".format
_SPLIT = f"flatten(list_transform(regexp_extract_all(lower({_BARE('clue')}), '[a-z'']+'), lambda w: CASE WHEN regexp_extract(w, '{_ENDS}', 2) <> '' THEN [regexp_extract(w, '{_ENDS}', 1), CASE regexp_extract(w, '{_ENDS}', 2) WHEN 'n''t' THEN '''t' ELSE regexp_extract(w, '{_ENDS}', 2) END] ELSE [w] END))"
_W = "regexp_extract_all(lower({0}), '[a-z]+')".format
_BY_LENGTH = f"cw AS (SELECT clue_id, CAST(length({puzzles._LET('answer')}) AS INTEGER) AS n_letters, CAST(len({_W('clue')}) AS INTEGER) AS words FROM clue_entry WHERE clue IS NOT NULL), bl AS (SELECT n_letters, count(*) AS n, median(words) AS median_words FROM cw WHERE n_letters BETWEEN 3 AND 12 GROUP BY 1 HAVING count(*) > 50)"
_VERBS = f"{_T}, p AS (SELECT ws[i + 1] AS word, ws[i] = 'to' AS f FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM t)), q AS (SELECT word, count(*) FILTER (f) AS after, count(*) FILTER (NOT f) AS other FROM p GROUP BY 1), vb AS (SELECT * FROM q WHERE after >= 10 AND after * 4 >= other)"
_AZ = "regexp_matches(coalesce(substr(clue, CAST({0} AS BIGINT), 1), ''), '[A-Za-z]') AND {0} >= 1".format
_ENUM = r"regexp_extract(clue, '\(([0-9][0-9, -]*)\)\s*$', 1)"
SQL = {
    "clue_words": f"SELECT clue_id, array_to_string({_SPLIT}, ' ') AS words FROM clue_entry WHERE clue IS NOT NULL",
    "clue_tokens": rf"""WITH {_E}, b AS (SELECT clue_id, regexp_replace(clue, '\s*\([^()]*\)\s*$', '') AS t FROM e WHERE clue IS NOT NULL), i AS (SELECT clue_id, t, unnest(range(1, length(t) + 1)) AS i FROM b)
SELECT clue_id, CAST(row_number() OVER (PARTITION BY clue_id ORDER BY i) - 1 AS INTEGER) AS n, CAST(i - 1 AS INTEGER) AS at, regexp_extract(substr(t, i), '^\S+') AS text FROM i WHERE regexp_matches(substr(t, i, 1), '\S') AND (i = 1 OR regexp_matches(substr(t, i - 1, 1), '\s'))""",
    "base_words": f"WITH {_L}, x AS (SELECT word, unnest([substr(word, 1, length(word) - 1), CASE WHEN word LIKE '%es' THEN substr(word, 1, length(word) - 2) END, CASE WHEN word LIKE '%ies' THEN substr(word, 1, length(word) - 3) || 'y' END]) AS base FROM w WHERE word LIKE '%s' AND length(word) >= 4) SELECT DISTINCT word, base FROM x WHERE base IN (SELECT word FROM w)",
    "gerunds": f"WITH {_L}, s AS (SELECT word, substr(word, 1, length(word) - 3) AS stem FROM w WHERE word LIKE '%ing' AND length(word) >= 6), x AS (SELECT word, unnest([stem, stem || 'e', CASE WHEN stem[-1] = stem[-2] THEN substr(stem, 1, length(stem) - 1) END]) AS verb FROM s) SELECT DISTINCT word, verb FROM x WHERE verb IN (SELECT word FROM w)",
    "verb_sets": f"WITH {_VERBS} SELECT * FROM vb",
    "imperative_openings": f"WITH {_VERBS}, {_E}, o AS (SELECT clue_id, ({_SPLIT})[1] AS word FROM e WHERE clue IS NOT NULL) SELECT clue_id, word FROM o WHERE word IN (SELECT word FROM vb)",
    "setter_anchors": "WITH n AS (SELECT DISTINCT setter FROM puzzle_index WHERE setter IS NOT NULL) SELECT trim(regexp_replace(lower(setter), '[^a-z0-9]+', '-', 'g'), '-') AS anchor, count(*) AS n_names FROM n GROUP BY 1",
    "span_overlaps": f"WITH {_E}, x AS (SELECT clue_id, clue, definition, unnest(indicators) AS indicator FROM e WHERE definition <> ''), p AS (SELECT *, instr(clue, definition) AS d, instr(clue, indicator) AS i FROM x WHERE indicator <> '') SELECT clue_id, indicator, CAST(i - 1 AS INTEGER) AS at, CAST(d - 1 AS INTEGER) AS definition_at FROM p WHERE d > 0 AND i > 0 AND i < d + length(definition) AND d < i + length(indicator)",
    "best_occurrence": f"""WITH {_E}, x AS (SELECT clue_id, clue, instr(clue, definition) AS d, length(definition) AS dn, unnest(indicators) AS indicator FROM e WHERE clue IS NOT NULL), y AS (SELECT DISTINCT *, length(indicator) AS n, unnest(range(1, length(clue) - length(indicator) + 2)) AS p FROM x WHERE indicator <> ''),
z AS (SELECT *, NOT ({_AZ('p')} AND {_AZ('(p - 1)')}) AND NOT ({_AZ('(p + n - 1)')} AND {_AZ('(p + n)')}) AS border, NOT coalesce(d > 0 AND p < d + dn AND d < p + n, false) AS clear FROM y WHERE substr(clue, p, n) = indicator),
k AS (SELECT clue_id, indicator, p, CASE WHEN border AND clear THEN 0 WHEN border THEN 1 WHEN clear THEN 2 ELSE 3 END AS kind FROM z) SELECT clue_id, indicator, CAST(kind AS INTEGER) AS kind, CAST(p - 1 AS INTEGER) AS at FROM (SELECT *, row_number() OVER (PARTITION BY clue_id, indicator ORDER BY kind, p) AS r FROM k) WHERE r = 1""",
    "fodder_spans": rf"""WITH {annotations._ANN}, x0 AS (SELECT raw_id, entry_id, clue, {puzzles._LET('fodder')} AS fd, list_filter(range(length(clue)), lambda i: regexp_matches(substr(clue, i + 1, 1), '\p{{L}}')) AS places FROM ann WHERE clue IS NOT NULL AND fodder IS NOT NULL),
x1 AS (SELECT *, upper(array_to_string(list_transform(places, lambda i: substr(clue, i + 1, 1)), '')) AS joined FROM x0 WHERE fd <> ''), x2 AS (SELECT *, unnest(range(length(joined) - length(fd) + 1)) AS s FROM x1), x3 AS (SELECT raw_id, entry_id, clue, places[s + 1] AS a, places[s + length(fd)] + 1 AS b FROM x2 WHERE substr(joined, s + 1, length(fd)) = fd)
SELECT DISTINCT raw_id, entry_id, CAST(a - length(regexp_extract(substr(clue, 1, a), '\p{{L}}*$')) AS INTEGER) AS starts, CAST(b + length(regexp_extract(substr(clue, b + 1), '^\p{{L}}*')) AS INTEGER) AS ends FROM x3""",
    "hidden_spans": rf"""WITH {_E}, x0 AS (SELECT clue_id, clue, {puzzles._LET('answer')} AS a FROM e WHERE clue IS NOT NULL), x1 AS (SELECT clue_id, clue, a, unnest(list_distinct([a, reverse(a)])) AS way, list_filter(range(length(clue)), lambda i: regexp_matches(substr(clue, i + 1, 1), '\p{{L}}')) AS places FROM x0 WHERE length(a) >= 3),
x2 AS (SELECT *, upper(array_to_string(list_transform(places, lambda i: substr(clue, i + 1, 1)), '')) AS joined FROM x1), x3 AS (SELECT *, unnest(range(length(joined) - length(way) + 1)) AS s FROM x2)
SELECT clue_id, way <> a AS turned, CAST(places[s + 1] AS INTEGER) AS starts, CAST(places[s + length(way)] + 1 AS INTEGER) AS ends FROM x3 WHERE substr(joined, s + 1, length(way)) = way""",
    "first_sentences": rf"WITH {annotations._ANN}, f1 AS (SELECT coalesce(nullif(regexp_extract(walkthrough, '(?s)^(.*?[.!?])(?:\s|$)', 1), ''), walkthrough) AS t FROM ann WHERE walkthrough IS NOT NULL) SELECT CAST(len({_W('t')}) AS INTEGER) AS n_words, count(*) AS n FROM f1 GROUP BY 1",
    "words_by_answer_length": f"WITH {_BY_LENGTH} SELECT * FROM bl",
    "terse_clues": f"WITH {_BY_LENGTH} SELECT clue_id, words, median_words FROM cw JOIN bl USING (n_letters) WHERE words < median_words - 1",
    "context_sets": f"WITH {_T}, p AS (SELECT ws[i + 1] AS word, ws[i] AS b FROM (SELECT ws, unnest(range(1, len(ws))) AS i FROM t)), q AS (SELECT word, " + ", ".join(f"count(*) FILTER (b IN ({', '.join(repr(x) for x in names)})) AS {name}" for name, names in CONTEXTS.items()) + f" FROM p GROUP BY 1) SELECT * FROM q WHERE {' + '.join(CONTEXTS)} >= 10",
    "separators": f"""WITH {_E}, x AS (SELECT clue_id, n_cells, list_transform(regexp_extract_all({_ENUM}, '[0-9]+'), lambda v: CAST(v AS INTEGER)) AS sizes, regexp_extract_all({_ENUM}, '[,-]') AS signs FROM e WHERE {_ENUM} <> '')
SELECT clue_id, CASE WHEN list_sum(sizes) = n_cells AND len(signs) = len(sizes) - 1 THEN coalesce(array_to_string(list_transform(range(1, len(sizes)), lambda i: signs[i] || CAST(CAST(list_sum(sizes[1:i]) AS INTEGER) AS VARCHAR)), ' '), '') END AS marks FROM x""",
    "marks_shortest_first": f"WITH {_E}, x AS (SELECT clue_id, unnest(list_distinct(list_filter(list_concat([definition], coalesce(indicators, [])), lambda p: p <> ''))) AS p FROM e WHERE clue IS NOT NULL AND definition IS NOT NULL) SELECT clue_id, string_agg(p, '|' ORDER BY length(p), p) AS marks FROM x GROUP BY 1",
    "short_messages": f"WITH {_E}, x AS (SELECT puzzle_id, list_sort(list(entry_id)) AS ids FROM e WHERE clue_type IS NULL GROUP BY 1) SELECT puzzle_id, array_to_string(ids[1:4], ', ') || CASE WHEN len(ids) > 4 THEN ' and ' || CAST(len(ids) - 4 AS VARCHAR) || ' more' ELSE '' END AS message FROM x",
    "shuffled_rivals": f"WITH {_E}, r AS (SELECT answer, clue_id, CAST(row_number() OVER (PARTITION BY answer ORDER BY md5(clue_id || ':{SEED}'), clue_id) AS INTEGER) AS place FROM e WHERE answer IS NOT NULL AND clue IS NOT NULL) SELECT * FROM r WHERE place <= 3",
    "redacted_walkthroughs": f"WITH {annotations._ANN} SELECT raw_id, entry_id, md5(regexp_replace(walkthrough, '(?i)' || array_to_string(string_split(a, ''), '[ -]?'), '___', 'g')) AS blotted FROM ann WHERE walkthrough IS NOT NULL AND length(a) >= 3",
    "guess_grades": f"WITH {_E}, {_F}, x AS (SELECT e.puzzle_id, e.entry_id, list_distinct({_W('f.definition')}) AS p, list_distinct({_W('e.definition')}) AS t FROM e JOIN f USING (puzzle_id, entry_id) WHERE f.definition IS NOT NULL AND e.definition IS NOT NULL), y AS (SELECT puzzle_id, entry_id, CAST(len(list_filter(p, lambda w: list_contains(t, w))) AS INTEGER) AS hit, CAST(len(list_filter(p, lambda w: NOT list_contains(t, w))) AS INTEGER) AS spare, CAST(len(list_filter(t, lambda w: NOT list_contains(p, w))) AS INTEGER) AS missed FROM x) SELECT *, missed = 0 AND spare = 0 AS exact FROM y",
    "settled_words": f"WITH {_E}, x AS (SELECT clue_id, definition, indicators, unnest(indicators) AS i, unnest(range(len(indicators))) AS step FROM e WHERE clue IS NOT NULL AND definition IS NOT NULL) SELECT clue_id, CAST(step AS INTEGER) AS step, array_to_string(list_sort(list_distinct(list_filter(list_concat({_W('definition')}, flatten(list_transform(indicators[1:step], lambda j: {_W('j')}))), lambda w: NOT list_contains({_W('i')}, w)))), ' ') AS settled FROM x",
    "unlinked_entries": f"WITH {_E} SELECT puzzle_id, entry_id FROM e WHERE clue_type IS NOT NULL AND (linked_to IS NULL OR trim(linked_to, ' ') = '')",
    "stock_indicators": f"WITH {_E}, st AS ({corpus.SQL['stock_terms']}), x AS (SELECT lower(trim(regexp_replace(raw, '\\s+', ' ', 'g'), ' ')) AS word FROM (SELECT unnest(indicators) AS raw FROM e)) SELECT word, count(*) AS n FROM x WHERE word IN (SELECT word FROM st) GROUP BY 1",
    "sampled_clues": "SELECT clue_id % 2 = 0 AS sampled, count(*) AS n, round(avg(length(clue)), 6) AS mean_length FROM clue_entry WHERE clue IS NOT NULL GROUP BY 1",
    "exceedance": f"SELECT CAST(k AS INTEGER) AS more_than, round(avg(CASE WHEN len({_W('clue')}) > k THEN 1.0 ELSE 0.0 END), 6) AS share FROM clue_entry, (VALUES (4), (6), (8), (10)) t(k) WHERE clue IS NOT NULL GROUP BY 1",
}
