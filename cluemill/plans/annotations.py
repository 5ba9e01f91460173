"""Queries over the annotations of the puzzle documents: costs, ratings, checks, claimed words, retold explanations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.operators import annotations as notes
from cluemill.operators import geometry, nested, scoring
from cluemill.plans import corpus as corpus_plans
from cluemill.plans import problems
from cluemill.plans.puzzles import _LET, _SORTED
from cluemill.session import materialize

UNKNOWN_RANK = 60_000
#: Weights of the measures of difficulty and upper ends of the bands.
WEIGHTS = {"checking": 0.45, "obscurity": 0.30, "device": 0.25}
BANDS, ABOVE = ((-0.90, "Gentle"), (-0.25, "Moderate"), (0.60, "Tough")), "Brutal"
FILLER = ("a", "an", "and", "as", "at", "by", "for", "from", "in", "is", "it", "of", "on", "or", "the", "to", "with")


def _rows(spark: SparkSession, sf_dir: str, *elements: str) -> DataFrame:
    """Shredded rows of the elements, written once."""
    docs, plan = problems._puzzle_plan(spark, sf_dir)
    return materialize(nested.shred(docs, "raw_id", "body", problems.PUZZLE_MODEL, plan, elements))


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.gathered(_rows(spark, sf_dir, "entries", "annotation", *notes.PARTS), "raw_id")


def _device(entries: DataFrame, gathered: DataFrame) -> DataFrame:
    """(raw_id, n_entries, n_costed, device): mean cost of a document's annotations; null where fewer than MOST of its entries have one."""
    costs = gathered.select("raw_id", notes.device_cost(F.col("kind"), F.col("indicators"), F.col("pieces")).alias("cost")).groupBy("raw_id").agg(F.count("cost").alias("n_costed"), F.avg("cost").alias("mean"))
    sizes = entries.groupBy("raw_id").agg(F.count(F.lit(1)).alias("n_entries"))
    return sizes.join(costs, "raw_id", "left").select("raw_id", "n_entries", F.coalesce("n_costed", F.lit(0)).alias("n_costed"), F.when(F.col("n_costed") >= notes.MOST * F.col("n_entries"), F.col("mean")).alias("device"))


def device_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _rows(spark, sf_dir, "entries", "annotation", *notes.PARTS)
    return _device(rows.where("element = 'entries'"), notes.gathered(rows, "raw_id")).withColumn("device", F.round("device", 6))


def rating_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Difficulty of each document from its grid, its words and its devices: z-scores against all documents, their weighted
    mean and its band, where at least two of them are there and the devices are one."""
    rows = _rows(spark, sf_dir, "entries", "annotation", *notes.PARTS)
    attr = lambda name: F.col("attributes")[name]
    entries = rows.where("element = 'entries'").select(
        "raw_id", "node_id", attr("direction").alias("direction"), attr("solution").alias("solution"),
        attr("position.x").cast("int").alias("pos_x"), attr("position.y").cast("int").alias("pos_y"), attr("length").cast("int").alias("n_cells"),
    )
    checking = geometry.checking(geometry.cells(entries, ["raw_id", "node_id"]), "raw_id", "node_id").select("raw_id", F.col("unchecked").alias("checking"))
    words = entries.select("raw_id", "node_id", F.explode(F.filter(F.split(F.lower("solution"), " "), lambda w: w != "")).alias("word")).join(corpus_plans.ranked(spark, sf_dir), "word", "left")
    worst = words.groupBy("raw_id", "node_id").agg(F.max(F.coalesce("rank", F.lit(UNKNOWN_RANK))).alias("worst"))
    obscurity = worst.groupBy("raw_id").agg(F.round(F.avg(F.log10(F.greatest("worst", F.lit(10)))), 6).alias("obscurity"))
    device = _device(entries, notes.gathered(rows, "raw_id")).select("raw_id", F.round("device", 6).alias("device"))
    parts = materialize(device.join(checking, "raw_id", "left").join(obscurity, "raw_id", "left"))
    scored = scoring.weighted_z(parts, scoring.baseline(parts, list(WEIGHTS)), WEIGHTS)
    basis = F.array_compact(F.array(*[F.when(F.col(c).isNotNull(), F.lit(c)) for c in sorted(WEIGHTS)]))
    rated = scored.withColumn("basis", basis).where((F.size("basis") >= 2) & F.col("device").isNotNull())
    return rated.select("raw_id", *WEIGHTS, F.array_join("basis", ",").alias("basis"), F.round("score", 3).alias("index"), scoring.band(F.col("score"), BANDS, ABOVE).alias("band"))


def nested_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.ANNOTATION_RULES.violations(_notes(spark, sf_dir), ["raw_id", "entry_id"]).select("raw_id", "entry_id", "severity", "code")


def puzzle_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with more faults of their blocks than are allowed."""
    return notes.over_cap(nested_rules(spark, sf_dir), "raw_id")


def renarration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Explanations that retell their own chunks, the plainest retelling first."""
    return notes.renarrated(_notes(spark, sf_dir), ["raw_id", "entry_id"]).withColumn("hits", F.array_join("hits", ","))


def unclaimed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.unclaimed(_notes(spark, sf_dir), ["raw_id", "entry_id"], FILLER).withColumn("words", F.array_join("words", " "))


def own_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many annotations claim each chunk of letters."""
    rows = _notes(spark, sf_dir).select(F.explode(notes.chunks(F.col("blocks"), F.col("pieces"))).alias("chunk"))
    return rows.groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


def glossary_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of letters and fragment of at most three letters that fewer than three documents use, against a glossary of the others."""
    pairs = _rows(spark, sf_dir, "blocks").select("raw_id", F.upper(F.col("attributes")["gives"]).alias("letters"), F.lower(F.col("attributes")["clueFragment"]).alias("fragment")).where("length(letters) BETWEEN 1 AND 3 AND fragment <> ''")
    glossary = pairs.groupBy("letters", "fragment").agg(F.count_distinct("raw_id").alias("n_documents")).where("n_documents >= 3")
    return pairs.select("letters", "fragment").distinct().join(glossary, ["letters", "fragment"], "left_anti")


NAMES = "device_cost rating_gate nested_rules puzzle_rules renarration unclaimed_words own_chunks glossary_misses".split()
QUERIES = {name: globals()[name] for name in NAMES}

_TEXT = "CASE WHEN json_type(x) = 'OBJECT' THEN x ->> '$.text' ELSE x ->> '$' END"
_SIZES = "z AS (SELECT raw_id, count(*) AS n_entries FROM s GROUP BY 1)"
_ANN = problems._NODES + f""",
parts AS (SELECT raw_id, parent_id, list({_TEXT} ORDER BY i) FILTER (f = 'pieces') AS pieces, list(x ->> '$' ORDER BY i) FILTER (f = 'indicators') AS indicators, list(x ->> '$' ORDER BY i) FILTER (f = 'linkWords') AS link_words,
list(item_key ORDER BY i) FILTER (f = 'indicatorNotes') AS noted, list(x ORDER BY i) FILTER (f = 'blocks') AS blocks, list(x ORDER BY i) FILTER (f = 'subAnagrams') AS sub_anagrams, list(x ORDER BY i) FILTER (f = 'subReversals') AS sub_reversals
FROM c WHERE parent_element = 'annotation' GROUP BY 1, 2),
ann AS MATERIALIZED (SELECT g.raw_id, g.entry_id, e ->> '$.clue' AS clue, e ->> '$.solution' AS solution, n ->> '$.type' AS kind, n ->> '$.answer' AS answer, n ->> '$.definition' AS definition, n ->> '$.anagram.fodder' AS fodder,
n ->> '$.linkedTo' AS linked_to, n ->> '$.walkthrough' AS walkthrough, coalesce(pieces, []) AS pieces, coalesce(indicators, []) AS indicators, coalesce(link_words, []) AS link_words, coalesce(noted, []) AS noted,
coalesce(blocks, []) AS blocks, coalesce(sub_anagrams, []) AS sub_anagrams, coalesce(sub_reversals, []) AS sub_reversals, {_LET("n ->> '$.answer'")} AS a,
array_to_string(list_transform(coalesce(blocks, []), lambda b: coalesce({_LET("b ->> '$.gives'")}, '')), '') AS bl
FROM g JOIN s USING (raw_id, entry_id) LEFT JOIN parts ON parts.raw_id = g.raw_id AND parts.parent_id = g.node_id)"""
_SOUND = f"regexp_matches(kind, '(?i){'|'.join(notes.HEARD)}')"
_BALANCED = f"linked_to IS NULL AND NOT coalesce(regexp_matches(kind, '{'|'.join(notes.UNBALANCED)}'), false)"


def _exists(column: str, test: str) -> str:
    return f"len(list_filter({column}, lambda b: {test})) > 0"


_GIVES = _LET("b ->> '$.gives'")
_RULE_SQL = {
    "field-missing": "linked_to IS NULL AND (kind IS NULL OR answer IS NULL OR definition IS NULL)",
    "type-part-unknown": _exists("string_split(kind, ' + ')", "b <> '' AND b NOT IN (" + ", ".join(f"'{t}'" for t in notes.TYPE_PARTS) + ")"),
    "answer-differs": f"a <> {_LET('solution')} AND {_LET('solution')} <> ''",
    "definition-not-in-clue": "NOT contains(clue, definition)",
    "indicator-not-in-clue": _exists("indicators", "NOT contains(clue, b)"),
    "link-word-not-in-clue": _exists("link_words", "NOT contains(clue, b)"),
    "fragment-not-in-clue": _exists("blocks", "b ->> '$.clueFragment' <> '' AND NOT contains(clue, b ->> '$.clueFragment')"),
    "fodder-differs": f"{_SORTED(_LET('fodder'))} <> {_SORTED('a')}",
    "pieces-differ": f"len(pieces) > 0 AND {_LET('''array_to_string(pieces, '')''')} <> a",
    "hidden-not-found": f"contains(kind, 'hidden') AND NOT contains({_LET('clue')}, a) AND NOT (contains(kind, 'reversal') AND contains({_LET('clue')}, reverse(a)))",
    "no-assembly": "fodder IS NULL AND len(pieces) = 0 AND NOT regexp_matches(kind, 'hidden|definition|homophone')",
    "heard-without-gives": _exists("blocks", "b ->> '$.soundsLike' <> '' AND coalesce(b ->> '$.gives', '') = ''"),
    "heard-is-written": _exists("blocks", f"b ->> '$.soundsLike' <> '' AND b ->> '$.gives' <> '' AND {_LET('''b ->> '$.soundsLike' ''')} = {_GIVES}"),
    "heard-without-type": f"NOT {_SOUND} AND " + _exists("blocks", "coalesce(b ->> '$.soundsLike', '') <> ''"),
    "type-without-heard": f"{_SOUND} AND NOT " + _exists("blocks", "coalesce(b ->> '$.soundsLike', '') <> ''"),
    "sub-anagram-differs": _exists("sub_anagrams", f"{_SORTED(_LET('''b ->> '$.fodder' '''))} <> {_SORTED(_GIVES)}"),
    "sub-reversal-differs": _exists("sub_reversals", f"reverse({_LET('''b ->> '$.from' ''')}) <> {_LET('''b ->> '$.to' ''')}"),
    "note-without-indicator": _exists("noted", "NOT list_contains(indicators, b)"),
    "indicator-without-note": _exists("indicators", "NOT list_contains(noted, b)"),
    "blocks-differ": f"{_BALANCED} AND bl <> '' AND {_SORTED('bl')} <> {_SORTED('a')}",
    "blocks-undivided": f"linked_to IS NULL AND len(pieces) >= 2 AND {_exists('pieces', f'length({_LET('b')}) > 1')} AND {_exists('blocks', f'{_GIVES} = a')} AND len(list_filter(blocks, lambda b: coalesce({_GIVES}, '') <> '')) = 1",
    "blocks-misordered": f"linked_to IS NULL AND trim(kind) = 'charade' AND bl <> '' AND bl <> a AND {_SORTED('bl')} = {_SORTED('a')}",
    "block-without-note": "linked_to IS NULL AND " + _exists("blocks", f"coalesce({_GIVES}, '') <> '' AND trim(coalesce(b ->> '$.note', '')) = ''"),
}
_SEVERITY = {code: rule.severity for code, rule in notes.ANNOTATION_RULES.rules.items()}
_VIOLATIONS = "v AS (" + " UNION ALL ".join(f"SELECT raw_id, entry_id, '{_SEVERITY[c]}' AS severity, '{c}' AS code FROM ann WHERE {p}" for c, p in _RULE_SQL.items()) + ")"
_COSTS = "list_max(list_transform(parts, lambda p: CASE p " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in notes.DEVICE_COST.items()) + f" ELSE {notes.OTHER_DEVICE} END))"
_DEVICE = _ANN + f""", {_SIZES},
t AS (SELECT raw_id, indicators, pieces, list_filter(list_transform(string_split(lower(kind), '+'), lambda p: trim(p)), lambda p: p <> '') AS parts FROM ann WHERE kind IS NOT NULL),
u AS (SELECT raw_id, least(1.0, {_COSTS} + 0.12 * (len(parts) - 1) + CASE WHEN len(indicators) = 0 AND NOT list_has_any(parts, ['double definition', 'cryptic definition']) THEN 0.06 ELSE 0 END + 0.09 * greatest(len(pieces) - 2, 0)
+ 0.06 * len(list_filter(pieces, lambda p: length(regexp_replace(p, '[^\\p{{L}}]', '', 'g')) BETWEEN 1 AND 2))) AS cost FROM t WHERE len(parts) > 0),
m AS (SELECT raw_id, count(*) AS n, avg(cost) AS mean FROM u GROUP BY 1),
dev AS (SELECT z.raw_id, n_entries, coalesce(n, 0) AS n_costed, CASE WHEN n >= 0.8 * n_entries THEN mean END AS device FROM z LEFT JOIN m USING (raw_id))"""
_WORDS = "regexp_extract_all(regexp_replace(regexp_replace(lower({0}), '<[^>]*>', ' ', 'g'), '\\([^)]*\\)', ' ', 'g'), '[a-z]+')".format
_CHUNKS = "list_filter(list_distinct(list_transform(list_concat(list_transform(blocks, lambda b: b ->> '$.gives'), pieces), lambda x: upper(replace(x, ' ', '')))), lambda x: length(x) >= 2)"
_RATING = _DEVICE + f""", cell AS (SELECT raw_id, node_id, x + CASE WHEN d = 'across' THEN n ELSE 0 END AS x, y + CASE WHEN d = 'across' THEN 0 ELSE n END AS y FROM (SELECT raw_id, node_id, e ->> '$.direction' AS d, CAST(e ->> '$.position.x' AS INTEGER) AS x,
CAST(e ->> '$.position.y' AS INTEGER) AS y, unnest(range(CAST(e ->> '$.length' AS INTEGER))) AS n FROM s)),
used AS (SELECT raw_id, node_id, count(*) OVER (PARTITION BY raw_id, x, y) AS k FROM cell), chk AS (SELECT raw_id, round(avg(share), 6) AS checking FROM (SELECT raw_id, node_id, avg(CASE WHEN k < 2 THEN 1.0 ELSE 0.0 END) AS share FROM used GROUP BY 1, 2) GROUP BY 1),
wr AS (SELECT word, row_number() OVER (ORDER BY n DESC, word) AS rank FROM w), sw AS (SELECT raw_id, node_id, unnest(list_filter(string_split(lower(e ->> '$.solution'), ' '), lambda q: q <> '')) AS word FROM s),
obs AS (SELECT raw_id, round(avg(log10(greatest(worst, 10))), 6) AS obscurity FROM (SELECT raw_id, node_id, max(coalesce(rank, {UNKNOWN_RANK})) AS worst FROM sw LEFT JOIN wr USING (word) GROUP BY 1, 2) GROUP BY 1),
p3 AS (SELECT dev.raw_id, checking, obscurity, round(device, 6) AS device FROM dev LEFT JOIN chk USING (raw_id) LEFT JOIN obs USING (raw_id)),
base AS (SELECT {', '.join(f'avg({c}) AS {c}_m, stddev_samp({c}) AS {c}_s' for c in WEIGHTS)} FROM p3),
zs AS (SELECT raw_id, checking, obscurity, device, ({' + '.join(f'coalesce(({c} - {c}_m) / {c}_s * {w}, 0)' for c, w in WEIGHTS.items())}) / ({' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE {w} END' for c, w in WEIGHTS.items())}) AS score FROM p3, base)
SELECT raw_id, checking, obscurity, device, concat_ws(',', CASE WHEN checking IS NOT NULL THEN 'checking' END, CASE WHEN device IS NOT NULL THEN 'device' END, CASE WHEN obscurity IS NOT NULL THEN 'obscurity' END) AS basis, round(score, 3) AS index,
CASE WHEN score < -0.9 THEN 'Gentle' WHEN score < -0.25 THEN 'Moderate' WHEN score < 0.6 THEN 'Tough' ELSE 'Brutal' END AS band FROM zs WHERE device IS NOT NULL AND (checking IS NOT NULL OR obscurity IS NOT NULL)"""
SQL = {
    "device_cost": f"WITH {_DEVICE} SELECT raw_id, n_entries, n_costed, round(device, 6) AS device FROM dev",
    "rating_gate": f"WITH {{lexicon}}, {_RATING}",
    "nested_rules": f"WITH {_ANN}, {_VIOLATIONS} SELECT * FROM v",
    "puzzle_rules": f"WITH {_ANN}, {_VIOLATIONS} SELECT raw_id, code, count(*) AS n FROM v WHERE code IN ('blocks-differ', 'blocks-undivided', 'blocks-misordered') GROUP BY 1, 2 HAVING count(*) > CASE WHEN code = 'blocks-misordered' THEN 0 ELSE 2 END",
    "renarration": f"""WITH {_ANN}, qq AS (SELECT raw_id, entry_id, walkthrough AS t, {_CHUNKS} AS owned, upper(replace(coalesce(answer, ''), ' ', '')) AS whole, list_distinct(list_transform(regexp_extract_all(walkthrough, '\\b[A-Z][A-Z’''-]+\\b'), lambda x: regexp_replace(x, '[’''-]', '', 'g'))) AS named FROM ann WHERE walkthrough IS NOT NULL),
kk AS (SELECT *, list_sort(list_filter(named, lambda x: list_contains(owned, x) AND x <> whole)) AS hits FROM qq)
SELECT raw_id, entry_id, CASE WHEN regexp_matches(t, '(?i){notes.PLACING}') AND NOT regexp_matches(t, '(?i){notes.TEACHING}') THEN 0 WHEN regexp_matches(t, '(?i){notes.PLACING}') THEN 1 ELSE 2 END AS rank, array_to_string(hits, ',') AS hits FROM kk WHERE len(hits) >= 2""",
    "unclaimed_words": f"""WITH {_ANN}, qq AS (SELECT raw_id, entry_id, {_WORDS('clue')} AS words, flatten(list_transform(list_concat([definition], indicators, link_words, list_transform(blocks, lambda b: b ->> '$.clueFragment')), lambda x: coalesce({_WORDS('x')}, []))) AS claimed FROM ann WHERE clue IS NOT NULL),
kk AS (SELECT raw_id, entry_id, list_sort(list_distinct(list_filter(words, lambda x: NOT list_contains(claimed, x) AND x NOT IN ({', '.join(f"'{x}'" for x in FILLER)})))) AS words FROM qq) SELECT raw_id, entry_id, array_to_string(words, ' ') AS words FROM kk WHERE len(words) > 0""",
    "own_chunks": f"WITH {_ANN}, qq AS (SELECT unnest({_CHUNKS}) AS chunk FROM ann) SELECT chunk, count(*) AS n FROM qq GROUP BY 1",
    "glossary_misses": f"WITH {problems._NODES}, qq AS (SELECT raw_id, upper(x ->> '$.gives') AS letters, lower(x ->> '$.clueFragment') AS fragment FROM c WHERE f = 'blocks'), kk AS (SELECT * FROM qq WHERE length(letters) BETWEEN 1 AND 3 AND fragment <> '') SELECT letters, fragment FROM kk GROUP BY 1, 2 HAVING count(DISTINCT raw_id) < 3",
}
SQL["rating_gate"] = SQL["rating_gate"].replace("{lexicon}", f"w AS (WITH {corpus_plans._L} SELECT word, n FROM w)")
