"""Index, entry and grid queries on puzzle_index, clue_entry and authored_clue."""

from __future__ import annotations

from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.functions.text import id_key
from cluemill.operators import activity, geometry, ordering, rules, scoring, snapshots
from cluemill.session import table

#: Own dimension of series: kind and size class; a series not listed takes the row of the default.
SERIES = (("cryptic", "daily", 1), ("harbour", "daily", 2), ("lanternday", "weekly", 3), ("quiptic", "gentle", 1))
DEFAULT_SERIES = "cryptic"
GRID = 15


def _latest(spark, sf_dir):
    """The entry as last loaded."""
    return snapshots.latest_rows(table(spark, sf_dir, "clue_entry"), ["puzzle_id", "entry_id"], ["loaded_at", "clue_id"])


def _first(spark, sf_dir):
    return activity.first_per(table(spark, sf_dir, "clue_entry"), ["puzzle_id", "entry_id"], ["loaded_at", "clue_id"])


def _index(spark, sf_dir):
    """The index row of each puzzle as last loaded, with the default series."""
    rows = table(spark, sf_dir, "puzzle_index").withColumn("series", F.coalesce("series", F.lit(DEFAULT_SERIES)))
    return snapshots.latest_rows(rows, ["puzzle_id"], ["loaded_at", "content_stamp"])


def _newest_first():
    return [F.coalesce(F.col("published_ms"), F.lit(0)).desc(), (F.col("series") == DEFAULT_SERIES).desc(), F.col("puzzle_no").desc(), F.col("puzzle_id")]


def index_sort(spark, sf_dir):
    return ordering.numbered(_index(spark, sf_dir).select("puzzle_id", "published_ms", "series", "puzzle_no"), _newest_first()).select("puzzle_id", "position")


def neighbours(spark, sf_dir):
    return ordering.neighbours(_index(spark, sf_dir).select("puzzle_id", "published_ms", "series", "puzzle_no"), "puzzle_id", _newest_first())


def first_wins(spark, sf_dir):
    """The newest puzzle of each bare number."""
    rows = _index(spark, sf_dir).select("puzzle_no", F.expr("-coalesce(published_ms, 0)").alias("neg"), "puzzle_id")
    return activity.first_per(rows, ["puzzle_no"], ["neg", "puzzle_id"]).select("puzzle_no", "puzzle_id")


def ambiguous_keys(spark, sf_dir):
    """Bare numbers shared by several puzzles, with these in order."""
    groups = table(spark, sf_dir, "puzzle_index").groupBy("puzzle_no").agg(F.array_sort(F.collect_set("puzzle_id")).alias("ids"))
    return groups.where(F.size("ids") > 1).select("puzzle_no", F.size("ids").cast("bigint").alias("n"), F.array_join("ids", ",").alias("ids"))


def id_parts(spark, sf_dir):
    head, tail = text.split_id_tail(F.col("puzzle_id"))
    return table(spark, sf_dir, "puzzle_index").select("puzzle_id").distinct().select("puzzle_id", head.alias("series_part"), tail.alias("number_part"))


def series_profile(spark, sf_dir):
    dim = spark.createDataFrame(SERIES, "series string, kind string, size_class int")  # a fixed list
    default = next(r for r in SERIES if r[0] == DEFAULT_SERIES)
    joined = _index(spark, sf_dir).join(F.broadcast(dim), "series", "left")
    return joined.groupBy("series", F.coalesce("kind", F.lit(default[1])).alias("kind")).agg(F.count(F.lit(1)).alias("n_puzzles"), F.sum(F.coalesce("size_class", F.lit(default[2]))).alias("size_total"))


def pending_topk(spark, sf_dir):
    rows = _index(spark, sf_dir).where("NOT annotated AND has_solutions AND removed_at IS NULL")
    return rows.orderBy(F.col("published_ms").desc(), F.col("puzzle_id").desc()).limit(3).select("puzzle_id", "published_ms")


def setter_mix(spark, sf_dir):
    """Puzzles per setter without letter case, with the series they appear in."""
    return _index(spark, sf_dir).groupBy(F.lower("setter").alias("setter")).agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("series")), ",").alias("series"))


def haystack_search(spark, sf_dir):
    """Puzzles whose name, setter, number (also with thousands) and series hold all the terms."""
    thousands = F.format_number("puzzle_no", 0)
    hay = F.lower(F.concat_ws(" ", "puzzle_name", "setter", "series", F.col("puzzle_no").cast("string"), thousands))
    terms = F.array(F.lit("crossword"), F.lit("mole"), F.lit("4"))
    return _index(spark, sf_dir).where(F.forall(terms, lambda t: F.contains(hay, t))).select("puzzle_id")


def stamp_changes(spark, sf_dir):
    """Index rows of 2025 and later against those before: content stamps added, removed, changed."""
    rows = table(spark, sf_dir, "puzzle_index")
    cut = F.lit("2025-01-01").cast("timestamp_ntz")
    before = snapshots.latest_rows(rows.where(F.col("loaded_at") < cut).select("puzzle_id", "loaded_at", "content_stamp"), ["puzzle_id"], ["loaded_at", "content_stamp"])
    return snapshots.differences(before, snapshots.latest_rows(rows.select("puzzle_id", "loaded_at", "content_stamp"), ["puzzle_id"], ["loaded_at", "content_stamp"]), ["puzzle_id"], "content_stamp")


def band_changes(spark, sf_dir):
    """Puzzles whose band of difficulty differs between their first and their last index row."""
    rows = table(spark, sf_dir, "puzzle_index").select("puzzle_id", "loaded_at", "content_stamp", F.col("difficulty.band").alias("band"))
    first = activity.first_per(rows, ["puzzle_id"], ["loaded_at", "content_stamp"])
    return snapshots.differences(first, snapshots.latest_rows(rows, ["puzzle_id"], ["loaded_at", "content_stamp"]), ["puzzle_id"], "band")


def difficulty_percentile(spark, sf_dir):
    rows = _index(spark, sf_dir).select("puzzle_id", F.col("difficulty.score").alias("score"))
    return scoring.percentile(rows, "score")


def difficulty_by_series(spark, sf_dir):
    rows = _index(spark, sf_dir).where("difficulty.score IS NOT NULL")
    return rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("difficulty.score"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("difficulty.score"), F.lit(0.0)), 6).alias("sd"))


def basis_use(spark, sf_dir):
    return _index(spark, sf_dir).select(F.explode("difficulty.basis").alias("component")).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


def perm_pvalue(spark, sf_dir):
    """Permutation test of the scores of the puzzles of two series. Collected is a row per distinct score, and scores have three decimals."""
    rows = _index(spark, sf_dir).where("difficulty.score IS NOT NULL AND series IN ('cryptic', 'quiptic')")
    counts = rows.groupBy(F.col("difficulty.score").alias("s")).agg(F.count_if(F.col("series") == "cryptic").alias("a"), F.count_if(F.col("series") == "quiptic").alias("b")).orderBy("s").collect()
    return scoring.permutation_p_of_counts(spark, [r.s for r in counts], [r.a for r in counts], [r.b for r in counts])


def _cells(spark, sf_dir):
    return geometry.cells(_latest(spark, sf_dir), ["puzzle_id", "entry_id"])


def entry_cells(spark, sf_dir):
    return _cells(spark, sf_dir).select("puzzle_id", "entry_id", "n", "x", "y", F.nullif("letter", F.lit("")).alias("letter"))


def crossing_map(spark, sf_dir):
    return geometry.crossings(_cells(spark, sf_dir), "puzzle_id", "entry_id").select("puzzle_id", "entry", "at", "other", "other_at")


def cell_conflicts(spark, sf_dir):
    cells = _cells(spark, sf_dir).where("letter <> ''")
    return cells.groupBy("puzzle_id", "x", "y").agg(F.count_distinct("letter").alias("n_letters")).where("n_letters > 1")


def entry_checking(spark, sf_dir):
    return geometry.checking(_cells(spark, sf_dir), "puzzle_id", "entry_id")


def unchecked_runs(spark, sf_dir):
    cells = _cells(spark, sf_dir)
    shared = cells.groupBy("puzzle_id", "x", "y").agg(F.count(F.lit(1)).alias("used"))
    rows = cells.join(shared, ["puzzle_id", "x", "y"]).select("puzzle_id", "entry_id", "n", (F.col("used") < 2).alias("alone"))
    return geometry.longest_runs(rows, ["puzzle_id", "entry_id"], "n", "alone")


def rot_symmetry(spark, sf_dir):
    cells = _cells(spark, sf_dir).select("puzzle_id", "x", "y", F.lit(GRID).alias("rows"), F.lit(GRID).alias("cols"))
    return geometry.not_symmetric(cells, "puzzle_id", "rows", "cols").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n_cells"))


def start_numbers(spark, sf_dir):
    starts = _latest(spark, sf_dir).select("puzzle_id", F.col("pos_x").alias("x"), F.col("pos_y").alias("y")).distinct()
    return geometry.numbering(starts, "puzzle_id").select("puzzle_id", "x", "y", "number")


def grid_components(spark, sf_dir):
    """Connected regions of entries per puzzle, entries that share a cell being connected; a puzzle's entries are one task."""
    name = lambda entry: F.concat_ws("/", "puzzle_id", entry)
    alone = _latest(spark, sf_dir).select("puzzle_id", name("entry_id").alias("a"), name("entry_id").alias("b"))
    edges = geometry.crossings(_cells(spark, sf_dir), "puzzle_id", "entry_id").where("entry < other").select("puzzle_id", name("entry").alias("a"), name("other").alias("b")).distinct()
    return geometry.group_components(alone.unionByName(edges), "puzzle_id").select("id", "component")


def solution_round_trip(spark, sf_dir):
    """Entries whose solution is put together again from its cells."""
    made = _cells(spark, sf_dir).where("letter <> ''").groupBy("puzzle_id", "entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "letter"))), lambda c: c["letter"]), "").alias("made"))
    return _latest(spark, sf_dir).join(made, ["puzzle_id", "entry_id"]).groupBy((F.col("made") == F.col("solution")).alias("same")).agg(F.count(F.lit(1)).alias("n"))


def entry_order(spark, sf_dir):
    """Entries of each puzzle in the order of a page: across before down, by number."""
    rows = _latest(spark, sf_dir).groupBy("puzzle_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("direction", "entry_no", "entry_id"))), lambda e: e["entry_id"]), " ").alias("entries"))
    return rows


def carry_over(spark, sf_dir):
    """Types of the first loading kept where there is one."""
    columns = ["puzzle_id", "entry_id", "clue_type"]
    return snapshots.carry_over(_latest(spark, sf_dir).select(*columns), _first(spark, sf_dir).select(*columns), columns[:2], ["clue_type"])


def grade_diff(spark, sf_dir):
    return snapshots.differences(_first(spark, sf_dir), _latest(spark, sf_dir), ["puzzle_id", "entry_id"], "clue")


def unmatched_puzzles(spark, sf_dir):
    left = table(spark, sf_dir, "puzzle_index").select(id_key(F.col("puzzle_id")).alias("puzzle"))
    return snapshots.unmatched(left, table(spark, sf_dir, "clue_entry").select(id_key(F.col("puzzle_id")).alias("puzzle")), ["puzzle"])


def skip_existing(spark, sf_dir):
    rows, cut = table(spark, sf_dir, "clue_entry").select("clue_id", "puzzle_id", "entry_id", "loaded_at"), F.lit("2025-01-01").cast("timestamp_ntz")
    return snapshots.append_unseen(rows.where(F.col("loaded_at") >= cut), rows.where(F.col("loaded_at") < cut), ["puzzle_id", "entry_id"], ["loaded_at", "clue_id"])


def linked_answers(spark, sf_dir):
    """Linked entries with the answer of the entry that covers them."""
    rows = _latest(spark, sf_dir)
    cover = rows.select("puzzle_id", id_key(F.col("entry_id")).alias("target"), F.col("answer").alias("covering_answer"))
    return rows.withColumn("target", id_key(F.col("linked_to"))).where("target IS NOT NULL").join(cover, ["puzzle_id", "target"], "left").select("puzzle_id", "entry_id", "target", "covering_answer")


def group_solutions(spark, sf_dir):
    """Solutions of the groups of several entries, put together in the group's order."""
    rows = _latest(spark, sf_dir)
    parts = rows.where(F.size("group_ids") > 1).select("puzzle_id", "entry_id", F.posexplode("group_ids").alias("n", "part")).withColumn("part", id_key(F.col("part")))
    found = parts.join(rows.select("puzzle_id", id_key(F.col("entry_id")).alias("part"), "solution"), ["puzzle_id", "part"])
    return found.where("solution IS NOT NULL").groupBy("puzzle_id", "entry_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "solution"))), lambda p: p["solution"]), "").alias("whole"))


def type_families(spark, sf_dir):
    """Entries by the family of their type: the first keyword that it holds."""
    kind = F.col("clue_type")
    family = F.when(kind.contains("anagram"), "anagram").when(kind.contains("hidden"), "hidden").when(kind.contains("letters"), "letters").when(kind.contains("definition"), "definition").otherwise("assembly")
    return _latest(spark, sf_dir).where("clue_type IS NOT NULL").groupBy(family.alias("family")).agg(F.count(F.lit(1)).alias("n"))


def map_inversion(spark, sf_dir):
    """Answers with the types that give them."""
    return _latest(spark, sf_dir).where("answer IS NOT NULL AND clue_type IS NOT NULL").groupBy("answer").agg(F.array_join(F.array_sort(F.collect_set("clue_type")), ";").alias("types"))


def enum_parse(spark, sf_dir):
    sizes = text.enumeration_sizes(F.col("enumeration"))
    rows = table(spark, sf_dir, "clue_entry").select("clue_id", text.enumeration(F.col("clue")).alias("enumeration")).where("enumeration <> ''")
    return rows.select("clue_id", "enumeration", F.aggregate(sizes, F.lit(0), lambda a, x: a + x).alias("total"), F.array_join(text.enumeration_breaks(sizes).cast("array<string>"), ",").alias("breaks"))


def _annotated(spark, sf_dir):
    return _latest(spark, sf_dir).where("clue_type IS NOT NULL AND clue IS NOT NULL")


def rule_violations(spark, sf_dir):
    return rules.ENTRY_RULES.violations(_annotated(spark, sf_dir), ["puzzle_id", "entry_id"]).select("puzzle_id", "entry_id", "severity", "code")


def rule_firing_rate(spark, sf_dir):
    return rules.ENTRY_RULES.firing_rates(_annotated(spark, sf_dir))


def ratchet(spark, sf_dir):
    """Violations of the last loading beyond those of the first, per puzzle: no more than then are allowed."""
    count = lambda rows, name: rules.ENTRY_RULES.violations(rows.where("clue_type IS NOT NULL AND clue IS NOT NULL"), ["puzzle_id", "entry_id"]).groupBy("puzzle_id").agg(F.count(F.lit(1)).alias(name))
    now, then = count(_latest(spark, sf_dir), "n"), count(_first(spark, sf_dir), "allowed")
    return now.join(then, "puzzle_id", "left").select("puzzle_id", "n", F.coalesce("allowed", F.lit(0)).alias("allowed")).where("n > allowed")


def puzzle_fingerprint(spark, sf_dir):
    return snapshots.fingerprint(_latest(spark, sf_dir).where("answer IS NOT NULL"), ["puzzle_id"], [F.col("entry_id"), F.col("answer")])


NAMES = """index_sort neighbours first_wins ambiguous_keys id_parts series_profile pending_topk setter_mix haystack_search stamp_changes band_changes
difficulty_percentile difficulty_by_series basis_use perm_pvalue entry_cells crossing_map cell_conflicts entry_checking unchecked_runs rot_symmetry
start_numbers grid_components solution_round_trip entry_order carry_over grade_diff unmatched_puzzles skip_existing linked_answers group_solutions
type_families map_inversion enum_parse rule_violations rule_firing_rate ratchet puzzle_fingerprint""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_KEY = "nullif(lower(trim({}, E' \\t\\n\\r')), '')".format
_E = "e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id, entry_id ORDER BY loaded_at DESC, clue_id DESC) AS k FROM clue_entry) WHERE k = 1)"
_F = "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id, entry_id ORDER BY loaded_at, clue_id) AS k FROM clue_entry) WHERE k = 1)"
_I = "i AS (SELECT * REPLACE (coalesce(series, 'cryptic') AS series) FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY loaded_at DESC, content_stamp DESC) AS k FROM puzzle_index) WHERE k = 1)"
_N = "ORDER BY coalesce(published_ms, 0) DESC, (series = 'cryptic') DESC, puzzle_no DESC, puzzle_id"
_C = _E + """, c AS (SELECT puzzle_id, entry_id, direction, n, pos_x + CASE WHEN direction = 'across' THEN n ELSE 0 END AS x, pos_y + CASE WHEN direction = 'across' THEN 0 ELSE n END AS y, nullif(substr(solution, n + 1, 1), '') AS letter
FROM (SELECT *, CAST(unnest(range(n_cells)) AS INTEGER) AS n FROM e WHERE n_cells > 0))"""
_LET = "regexp_replace(upper({}), '[^A-Z]', '', 'g')".format
_SORTED = "list_sort(string_split({}, ''))".format
_RULES = {
    "answer-differs": ("E", f"{_LET('answer')} <> {_LET('solution')}"),
    "answer-not-a-rearrangement": ("W", f"{_SORTED(_LET('answer'))} <> {_SORTED(_LET('solution'))}"),
    "length-differs": ("E", f"length({_LET('solution')}) <> n_cells"),
    "definition-not-in-clue": ("E", "NOT contains(clue, definition)"),
    "definition-words-not-in-clue": ("W", "len(list_filter(regexp_extract_all(lower(definition), '[a-z]+'), lambda w: NOT list_contains(regexp_extract_all(lower(clue), '[a-z]+'), w))) > 0"),
    "indicator-not-in-clue": ("E", "len(list_filter(indicators, lambda i: NOT contains(lower(clue), lower(i)))) > 0"),
    "answer-in-clue": ("E", f"length({_LET('answer')}) >= 4 AND contains({_LET('clue')}, {_LET('answer')})"),
    "type-without-indicator": ("W", "coalesce(len(indicators), 0) = 0"),
    "markup": ("E", "regexp_matches(clue, '<[a-zA-Z/]|&[a-z]+;')"),
    "no-enumeration": ("W", r"regexp_extract(clue, '\(([0-9][0-9, -]*)\)\s*$', 1) = ''"),
}
_R = "a AS (SELECT * FROM {0} WHERE clue_type IS NOT NULL AND clue IS NOT NULL), {1} AS (" + " UNION ALL ".join(f"SELECT puzzle_id, entry_id, '{s}' AS severity, '{c}' AS code FROM a WHERE {p}" for c, (s, p) in _RULES.items()) + ")"
SQL = {
    "index_sort": f"WITH {_I} SELECT puzzle_id, row_number() OVER ({_N}) AS position FROM i",
    "neighbours": f"WITH {_I} SELECT puzzle_id, row_number() OVER ({_N}) AS position, lag(puzzle_id) OVER ({_N}) AS previous, lead(puzzle_id) OVER ({_N}) AS next FROM i",
    "first_wins": f"WITH {_I} SELECT puzzle_no, puzzle_id FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_no ORDER BY coalesce(published_ms, 0) DESC, puzzle_id) AS w FROM i) WHERE w = 1",
    "ambiguous_keys": "SELECT puzzle_no, count(DISTINCT puzzle_id) AS n, string_agg(DISTINCT puzzle_id, ',' ORDER BY puzzle_id) AS ids FROM puzzle_index GROUP BY 1 HAVING count(DISTINCT puzzle_id) > 1",
    "id_parts": "SELECT DISTINCT puzzle_id, regexp_extract(puzzle_id, '^(.*)-([^-]+)$', 1) AS series_part, regexp_extract(puzzle_id, '^(.*)-([^-]+)$', 2) AS number_part FROM puzzle_index",
    "series_profile": f"WITH {_I}, d(series, kind, size_class) AS (VALUES {', '.join(map(str, SERIES))}) SELECT i.series, coalesce(kind, 'daily') AS kind, count(*) AS n_puzzles, CAST(sum(coalesce(size_class, 1)) AS BIGINT) AS size_total FROM i LEFT JOIN d USING (series) GROUP BY 1, 2",
    "pending_topk": f"WITH {_I} SELECT puzzle_id, published_ms FROM i WHERE NOT annotated AND has_solutions AND removed_at IS NULL ORDER BY published_ms DESC, puzzle_id DESC LIMIT 3",
    "setter_mix": f"WITH {_I} SELECT lower(setter) AS setter, count(*) AS n, string_agg(DISTINCT series, ',' ORDER BY series) AS series FROM i GROUP BY 1",
    "haystack_search": f"WITH {_I}, h AS (SELECT puzzle_id, lower(concat_ws(' ', puzzle_name, setter, series, puzzle_no, format('{{:,}}', puzzle_no))) AS hay FROM i) SELECT puzzle_id FROM h WHERE contains(hay, 'crossword') AND contains(hay, 'mole') AND contains(hay, '4')",
    "stamp_changes": """WITH b AS (SELECT puzzle_id, content_stamp AS old FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY loaded_at DESC, content_stamp DESC) AS k FROM puzzle_index WHERE loaded_at < '2025-01-01') WHERE k = 1),
a AS (SELECT puzzle_id, content_stamp AS new FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id ORDER BY loaded_at DESC, content_stamp DESC) AS k FROM puzzle_index) WHERE k = 1)
SELECT coalesce(a.puzzle_id, b.puzzle_id) AS puzzle_id, CASE WHEN b.puzzle_id IS NULL THEN 'added' WHEN a.puzzle_id IS NULL THEN 'removed' ELSE 'changed' END AS change, old, new FROM a FULL JOIN b ON a.puzzle_id = b.puzzle_id WHERE a.puzzle_id IS NULL OR b.puzzle_id IS NULL OR old IS DISTINCT FROM new""",
    "band_changes": """WITH x AS (SELECT puzzle_id, difficulty.band AS band, row_number() OVER (PARTITION BY puzzle_id ORDER BY loaded_at, content_stamp) AS a, row_number() OVER (PARTITION BY puzzle_id ORDER BY loaded_at DESC, content_stamp DESC) AS z FROM puzzle_index)
SELECT o.puzzle_id, 'changed' AS change, o.band AS old, n.band AS new FROM x o JOIN x n ON o.puzzle_id = n.puzzle_id AND o.a = 1 AND n.z = 1 WHERE o.band IS DISTINCT FROM n.band""",
    "difficulty_percentile": f"WITH {_I}, s AS (SELECT puzzle_id, difficulty.score AS score FROM i), r AS (SELECT puzzle_id, percent_rank() OVER (ORDER BY score) AS p, count(*) OVER () AS n FROM s WHERE score IS NOT NULL) SELECT s.puzzle_id, s.score, CASE WHEN n > 1 THEN CAST(round_even(100 * p, 0) AS INTEGER) END AS percentile FROM s LEFT JOIN r USING (puzzle_id)",
    "difficulty_by_series": f"WITH {_I} SELECT series, count(*) AS n, round(avg(difficulty.score), 6) AS mean, round(coalesce(stddev_samp(difficulty.score), 0), 6) AS sd FROM i WHERE difficulty.score IS NOT NULL GROUP BY 1",
    "basis_use": f"WITH {_I}, b AS (SELECT unnest(difficulty.basis) AS component FROM i) SELECT component, count(*) AS n FROM b GROUP BY 1",
    "entry_cells": f"WITH {_C} SELECT puzzle_id, entry_id, n, x, y, letter FROM c",
    "crossing_map": f"WITH {_C} SELECT a.puzzle_id, a.entry_id AS entry, a.n AS at, b.entry_id AS other, b.n AS other_at FROM c a JOIN c b ON a.puzzle_id = b.puzzle_id AND a.x = b.x AND a.y = b.y AND a.entry_id <> b.entry_id",
    "cell_conflicts": f"WITH {_C} SELECT puzzle_id, x, y, count(DISTINCT letter) AS n_letters FROM c GROUP BY 1, 2, 3 HAVING count(DISTINCT letter) > 1",
    "entry_checking": f"WITH {_C}, u AS (SELECT *, count(*) OVER (PARTITION BY puzzle_id, x, y) AS used FROM c), s AS (SELECT puzzle_id, entry_id, avg(CASE WHEN used < 2 THEN 1.0 ELSE 0.0 END) AS share FROM u GROUP BY 1, 2) SELECT puzzle_id, count(*) AS n_entries, round(avg(share), 6) AS unchecked FROM s GROUP BY 1",
    "unchecked_runs": f"""WITH {_C}, u AS (SELECT *, count(*) OVER (PARTITION BY puzzle_id, x, y) AS used FROM c), r AS (SELECT puzzle_id, entry_id, n - row_number() OVER (PARTITION BY puzzle_id, entry_id ORDER BY n) AS i FROM u WHERE used < 2),
m AS (SELECT puzzle_id, entry_id, max(k) AS longest FROM (SELECT puzzle_id, entry_id, i, count(*) AS k FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT d.puzzle_id, d.entry_id, coalesce(longest, 0) AS longest FROM (SELECT DISTINCT puzzle_id, entry_id FROM c) d LEFT JOIN m USING (puzzle_id, entry_id)""",
    "rot_symmetry": f"WITH {_C}, l AS (SELECT DISTINCT puzzle_id, x, y FROM c) SELECT puzzle_id, count(*) AS n_cells FROM l WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.puzzle_id = l.puzzle_id AND o.x = 14 - l.x AND o.y = 14 - l.y) GROUP BY 1",
    "start_numbers": f"WITH {_E}, s AS (SELECT DISTINCT puzzle_id, pos_x AS x, pos_y AS y FROM e) SELECT puzzle_id, x, y, CAST(dense_rank() OVER (PARTITION BY puzzle_id ORDER BY y, x) AS INTEGER) AS number FROM s",
    "grid_components": f"WITH RECURSIVE {_C}, x AS (SELECT DISTINCT a.puzzle_id || '/' || a.entry_id AS a, b.puzzle_id || '/' || b.entry_id AS b FROM c a JOIN c b ON a.puzzle_id = b.puzzle_id AND a.x = b.x AND a.y = b.y AND a.entry_id <> b.entry_id), r(id, component) AS (SELECT puzzle_id || '/' || entry_id, puzzle_id || '/' || entry_id FROM e UNION SELECT r.id, x.b FROM r JOIN x ON r.component = x.a) SELECT id, min(component) AS component FROM r GROUP BY 1",
    "solution_round_trip": f"WITH {_C}, m AS (SELECT puzzle_id, entry_id, string_agg(letter, '' ORDER BY n) AS made FROM c WHERE letter IS NOT NULL GROUP BY 1, 2) SELECT made = solution AS same, count(*) AS n FROM e JOIN m USING (puzzle_id, entry_id) GROUP BY 1",
    "entry_order": f"WITH {_E} SELECT puzzle_id, string_agg(entry_id, ' ' ORDER BY direction, entry_no, entry_id) AS entries FROM e GROUP BY 1",
    "carry_over": f"WITH {_E}, {_F} SELECT e.puzzle_id, e.entry_id, coalesce(f.clue_type, e.clue_type) AS clue_type FROM e LEFT JOIN f USING (puzzle_id, entry_id)",
    "grade_diff": f"WITH {_E}, {_F} SELECT e.puzzle_id, e.entry_id, 'changed' AS change, f.clue AS old, e.clue AS new FROM e JOIN f USING (puzzle_id, entry_id) WHERE f.clue IS DISTINCT FROM e.clue",
    "unmatched_puzzles": f"WITH l AS (SELECT DISTINCT {_KEY('puzzle_id')} AS puzzle FROM puzzle_index), r AS (SELECT DISTINCT {_KEY('puzzle_id')} AS puzzle FROM clue_entry) SELECT puzzle, 'left' AS side FROM l WHERE puzzle NOT IN (SELECT puzzle FROM r WHERE puzzle IS NOT NULL) UNION ALL SELECT puzzle, 'right' FROM r WHERE puzzle NOT IN (SELECT puzzle FROM l WHERE puzzle IS NOT NULL)",
    "skip_existing": "SELECT clue_id, puzzle_id, entry_id, loaded_at FROM (SELECT *, row_number() OVER (PARTITION BY puzzle_id, entry_id ORDER BY loaded_at, clue_id) AS k FROM clue_entry b WHERE loaded_at >= '2025-01-01' AND NOT EXISTS (SELECT 1 FROM clue_entry o WHERE o.loaded_at < '2025-01-01' AND o.puzzle_id = b.puzzle_id AND o.entry_id = b.entry_id)) WHERE k = 1",
    "linked_answers": f"WITH {_E}, l AS (SELECT puzzle_id, entry_id, {_KEY('linked_to')} AS target FROM e) SELECT l.puzzle_id, l.entry_id, l.target, o.answer AS covering_answer FROM l LEFT JOIN e o ON o.puzzle_id = l.puzzle_id AND {_KEY('o.entry_id')} = l.target WHERE l.target IS NOT NULL",
    "group_solutions": f"WITH {_E}, g AS (SELECT puzzle_id, entry_id, unnest(group_ids) AS part, unnest(range(len(group_ids))) AS n FROM e WHERE len(group_ids) > 1) SELECT g.puzzle_id, g.entry_id, string_agg(o.solution, '' ORDER BY n) AS whole FROM g JOIN e o ON o.puzzle_id = g.puzzle_id AND {_KEY('o.entry_id')} = {_KEY('part')} WHERE o.solution IS NOT NULL GROUP BY 1, 2",
    "type_families": f"WITH {_E} SELECT CASE WHEN contains(clue_type, 'anagram') THEN 'anagram' WHEN contains(clue_type, 'hidden') THEN 'hidden' WHEN contains(clue_type, 'letters') THEN 'letters' WHEN contains(clue_type, 'definition') THEN 'definition' ELSE 'assembly' END AS family, count(*) AS n FROM e WHERE clue_type IS NOT NULL GROUP BY 1",
    "map_inversion": f"WITH {_E} SELECT answer, string_agg(DISTINCT clue_type, ';' ORDER BY clue_type) AS types FROM e WHERE answer IS NOT NULL AND clue_type IS NOT NULL GROUP BY 1",
    "enum_parse": r"""WITH p AS (SELECT clue_id, regexp_extract(clue, '\(([0-9][0-9, -]*)\)\s*$', 1) AS enumeration FROM clue_entry WHERE clue IS NOT NULL), s AS (SELECT *, list_transform(regexp_extract_all(enumeration, '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS sizes FROM p WHERE enumeration <> '')
SELECT clue_id, enumeration, CAST(list_sum(sizes) AS INTEGER) AS total, coalesce(array_to_string(list_transform(range(1, len(sizes)), lambda n: CAST(list_sum(sizes[1:n]) AS BIGINT)), ','), '') AS breaks FROM s""",
    "rule_violations": f"WITH {_E}, {_R.format('e', 'v')} SELECT * FROM v",
    "rule_firing_rate": f"WITH {_E}, {_R.format('e', 'v')}, t AS (SELECT count(*) AS n FROM a), d(code) AS (VALUES {', '.join(f'({c!r})' for c in _RULES)}), q AS (SELECT code, count(*) AS k FROM v GROUP BY 1) SELECT d.code, n, coalesce(k, 0) AS fired, round(coalesce(k, 0) / n, 6) AS rate FROM d LEFT JOIN q USING (code), t",
    "ratchet": f"WITH {_E}, {_F}, now AS (WITH {_R.format('e', 'v')} SELECT puzzle_id, count(*) AS n FROM v GROUP BY 1), was AS (WITH {_R.format('f', 'v')} SELECT puzzle_id, count(*) AS allowed FROM v GROUP BY 1) SELECT puzzle_id, n, coalesce(allowed, 0) AS allowed FROM now LEFT JOIN was USING (puzzle_id) WHERE n > coalesce(allowed, 0)",
    "puzzle_fingerprint": f"WITH {_E} SELECT puzzle_id, substr(sha1(string_agg(entry_id || '|' || answer, chr(10) ORDER BY entry_id || '|' || answer)), 1, 12) AS fingerprint FROM e WHERE answer IS NOT NULL GROUP BY 1",
}
