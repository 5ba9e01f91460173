"""Flags, queues, grids and state over time, on puzzle_index, clue_entry, play_save, events and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.functions.text import id_key
from cluemill.operators import activity, geometry, merge, state
from cluemill.plans import problems, puzzles, usage
from cluemill.session import table
from cluemill.streaming import events as streams

#: Bare numbers from which the newer series counts.
NEW_SERIES_FROM = 40_000
MOST_PUZZLES, CODE_SHAPE = 2_000, "^[a-z0-9]{8}$"
DAY_S = 86_400
GRID = puzzles.GRID
#: Least and greatest share of checked cells; a cut must leave as many open columns as three or 4/15 of the rows.
CHECKED_SHARE = (0.28, 0.52)
KNOWN = ("view", "click", "signup")


def _latest(spark, sf_dir):
    return puzzles._latest(spark, sf_dir)


def puzzle_flags(spark, sf_dir):
    """Per puzzle whether all its entries have a type and whether all have a solution."""
    return _latest(spark, sf_dir).groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n_entries"), F.bool_and(F.col("clue_type").isNotNull()).alias("annotated"), F.bool_and(F.coalesce(F.col("solution") != "", F.lit(False))).alias("has_solutions"))


def unsolved_queue(spark, sf_dir):
    """Puzzles without all solutions, the newest first."""
    rows = puzzles._index(spark, sf_dir).where("NOT has_solutions AND removed_at IS NULL").select("puzzle_id", "published_ms")
    return puzzles.ordering.numbered(rows, [F.coalesce("published_ms", F.lit(0)).desc(), F.col("puzzle_id").desc()]).select("puzzle_id", "position")


def backlog_order(spark, sf_dir):
    """The whole queue of puzzles with solutions and without annotations, the newest first."""
    rows = puzzles._index(spark, sf_dir).where("NOT annotated AND has_solutions AND removed_at IS NULL").select("puzzle_id", "published_ms")
    return puzzles.ordering.numbered(rows, [F.coalesce("published_ms", F.lit(0)).desc(), F.col("puzzle_id").desc()]).select("puzzle_id", "position")


def recent_solved(spark, sf_dir):
    """The twelve newest puzzles with solutions."""
    rows = puzzles._index(spark, sf_dir).where("has_solutions AND removed_at IS NULL")
    return rows.orderBy(F.col("published_ms").desc(), F.col("puzzle_id").desc()).limit(12).select("puzzle_id", "published_ms")


def refresh_set(spark, sf_dir):
    """Puzzles of which an entry lacks its solution, or whose document says where its solutions come from."""
    lacking = _latest(spark, sf_dir).where("solution IS NULL OR solution = ''").select(id_key(F.col("puzzle_id")).alias("puzzle"))
    sourced = problems.QUERIES["p1_documents"](spark, sf_dir).where("solutionSource_kind IS NOT NULL").select(id_key(F.col("id")).alias("puzzle"))
    return lacking.unionByName(sourced).distinct()


def default_list(spark, sf_dir):
    """Puzzles that are annotated, the newest of their series, or begun by somebody."""
    index = puzzles._index(spark, sf_dir).select("puzzle_id", "series", "annotated", "published_ms")
    newest = index.groupBy("series").agg(F.max(F.struct("published_ms", "puzzle_id"))["puzzle_id"].alias("puzzle_id")).select("puzzle_id", F.lit(True).alias("current"))
    begun = table(spark, sf_dir, "play_save").where("letters_typed > 0").select(id_key(F.col("puzzle_id")).alias("_k")).distinct().withColumn("begun", F.lit(True))
    rows = index.join(newest, "puzzle_id", "left").join(begun, id_key(F.col("puzzle_id")) == F.col("_k"), "left")
    return rows.where("annotated OR current OR begun").select("puzzle_id", F.coalesce("annotated", F.lit(False)).alias("annotated"), F.coalesce("current", F.lit(False)).alias("current"), F.coalesce("begun", F.lit(False)).alias("begun"))


def sync_codes(spark, sf_dir):
    """Players' codes: whether they have the right shape and not too many puzzles."""
    rows = table(spark, sf_dir, "play_save").where("sync_code IS NOT NULL").groupBy("sync_code").agg(F.count_distinct("puzzle_id").alias("n_puzzles"))
    return rows.select("sync_code", "n_puzzles", (F.col("sync_code").rlike(CODE_SHAPE) & (F.col("n_puzzles") <= MOST_PUZZLES)).alias("accepted"))


def series_by_number(spark, sf_dir):
    """Puzzles by the series that their bare number stands for."""
    series = F.when(F.col("puzzle_no") >= NEW_SERIES_FROM, "cryptic").otherwise("other")
    return puzzles._index(spark, sf_dir).groupBy(series.alias("by_number"), "series").agg(F.count(F.lit(1)).alias("n"))


def reconcile(spark, sf_dir):
    """Entries whose clue, cells and solution do not fit: enumeration, length, number and direction; none is let through silently."""
    enum = text.enumeration(F.col("clue"))
    total = F.aggregate(text.enumeration_sizes(enum), F.lit(0), lambda a, x: a + x)
    faults = F.array_compact(F.array(
        F.when((enum != "") & (total != F.col("n_cells")), "enumeration"), F.when(F.length(text.letters(F.col("solution"))) != F.col("n_cells"), "solution"),
        F.when(F.lower(F.trim("entry_id")) != F.concat(F.col("entry_no").cast("string"), F.lit("-"), F.col("direction")), "name"),
    ))
    return _latest(spark, sf_dir).select("puzzle_id", "entry_id", F.explode(faults).alias("fault"))


def checked_pattern(spark, sf_dir):
    """Each entry's solution, checked letters in capitals and the others small."""
    cells = puzzles._cells(spark, sf_dir)
    used = cells.groupBy("puzzle_id", "x", "y").agg(F.count(F.lit(1)).alias("used"))
    letter = F.when(F.col("used") > 1, F.upper("letter")).otherwise(F.lower("letter"))
    rows = cells.where("letter <> ''").join(used, ["puzzle_id", "x", "y"]).groupBy("puzzle_id", "entry_id").agg(F.array_sort(F.collect_list(F.struct("n", letter.alias("l")))).alias("c"))
    return rows.select("puzzle_id", "entry_id", F.array_join(F.transform("c", lambda x: x["l"]), "").alias("pattern"))


def check_tally(spark, sf_dir):
    """Letters of the first loading held against those wanted by the last: wrong, right and blank ones per puzzle, whether half is
    filled and whether it is done."""
    wanted = puzzles._cells(spark, sf_dir).where("letter <> ''").groupBy("puzzle_id", "x", "y").agg(F.min("letter").alias("wanted"))
    typed = geometry.cells(puzzles._first(spark, sf_dir), ["puzzle_id"]).where("letter <> ''").groupBy("puzzle_id", "x", "y").agg(F.min("letter").alias("typed"))
    rows = wanted.join(typed, ["puzzle_id", "x", "y"], "left").groupBy("puzzle_id").agg(
        F.count_if(F.col("typed") != F.col("wanted")).alias("wrong"), F.count_if(F.col("typed") == F.col("wanted")).alias("right"), F.count_if(F.col("typed").isNull()).alias("blank")
    )
    return rows.select("*", ((F.col("wrong") + F.col("right")) * 2 >= F.col("wrong") + F.col("right") + F.col("blank")).alias("half_filled"), ((F.col("wrong") == 0) & (F.col("blank") == 0)).alias("done"))


def named_and_present(spark, sf_dir):
    """Per series whether the setters of the annotated puzzles are exactly those of all of them."""
    names = lambda only: F.array_sort(F.collect_set(F.when(only, F.lower("setter"))))
    rows = puzzles._index(spark, sf_dir).groupBy("series").agg(names(F.col("annotated")).alias("a"), names(F.lit(True)).alias("b"))
    return rows.select("series", F.size("b").alias("n_setters"), (F.col("a") == F.col("b")).alias("same"))


def entry_rows(spark, sf_dir):
    """Entries of each puzzle from the top left to the bottom right, across before down."""
    rows = _latest(spark, sf_dir).groupBy("puzzle_id").agg(F.array_sort(F.collect_list(F.struct("pos_y", "pos_x", "direction", "entry_id"))).alias("e"))
    return rows.select("puzzle_id", F.array_join(F.transform("e", lambda x: x["entry_id"]), " ").alias("entries"))


def canonical_entries(spark, sf_dir):
    """Entries of each document with defaults for what it leaves out, numbered from the top left to the bottom right."""
    rows = problems.QUERIES["p1_entries"](spark, sf_dir)
    full = rows.select("raw_id", F.col("entries_key").alias("entry_id"), F.coalesce("position_y", F.lit(0)).alias("y"), F.coalesce("position_x", F.lit(0)).alias("x"), F.coalesce("direction", F.lit("across")).alias("direction"), F.coalesce("length", F.length("solution").cast("bigint"), F.lit(0)).alias("n_cells"), F.coalesce("clue", F.lit("")).alias("clue"))
    ordered = full.groupBy("raw_id").agg(F.array_sort(F.collect_list(F.struct("y", "x", "direction", "entry_id", "n_cells", "clue"))).alias("e"))
    return ordered.select("raw_id", F.posexplode("e").alias("place", "r")).select("raw_id", "place", "r.entry_id", "r.direction", "r.n_cells", F.length("r.clue").alias("n_signs"))


def row_major(spark, sf_dir):
    """Solutions sliced out of their grid as one row-major text; cells outside it and unknown ones are a dot."""
    letters = puzzles._cells(spark, sf_dir).where(F.col("x").between(0, GRID - 1) & F.col("y").between(0, GRID - 1) & (F.col("letter") != "")).groupBy("puzzle_id", "x", "y").agg(F.min("letter").alias("l"))
    grids = letters.groupBy("puzzle_id").agg(F.map_from_entries(F.collect_list(F.struct((F.col("y") * GRID + F.col("x")).alias("k"), "l"))).alias("m"))
    grids = grids.select("puzzle_id", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(GRID * GRID - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit("."))), "").alias("grid"))
    across = F.col("direction") == "across"
    rows = _latest(spark, sf_dir).where("n_cells > 0").join(grids, "puzzle_id")

    def sign(n):
        x, y = F.col("pos_x") + F.when(across, n).otherwise(0), F.col("pos_y") + F.when(across, 0).otherwise(n)
        return F.when(x.between(0, GRID - 1) & y.between(0, GRID - 1), F.substring("grid", y * GRID + x + 1, F.lit(1))).otherwise(".")

    sliced = F.array_join(F.transform(F.sequence(F.lit(0), F.col("n_cells") - 1), sign), "")
    return rows.select("puzzle_id", "entry_id", sliced.alias("sliced"))


def index_projection(spark, sf_dir):
    """The index as it is shown: number with thousands, flags, and the band where the rating rests on devices and one more measure."""
    rated = (F.size("difficulty.basis") >= 2) & F.array_contains("difficulty.basis", "device")
    return puzzles._index(spark, sf_dir).where("removed_at IS NULL").select(
        "puzzle_id", "series", F.format_number("puzzle_no", 0).alias("number"), F.coalesce("annotated", F.lit(False)).alias("annotated"), F.coalesce("has_solutions", F.lit(False)).alias("has_solutions"), F.when(rated, F.col("difficulty.band")).alias("band")
    )


def hardest_first(spark, sf_dir):
    """Rated puzzles, the hardest first."""
    rows = puzzles._index(spark, sf_dir).select("puzzle_id", F.col("difficulty.score").alias("score")).where("score IS NOT NULL")
    return puzzles.ordering.numbered(rows, [F.col("score").desc(), F.col("puzzle_id")])


def linked_faults(spark, sf_dir):
    """Entries linked to one that is not there, or that does not count them among its group."""
    rows = _latest(spark, sf_dir)
    cover = rows.select("puzzle_id", id_key(F.col("entry_id")).alias("target"), F.transform("group_ids", lambda g: id_key(g)).alias("members"))
    linked = rows.select("puzzle_id", "entry_id", id_key(F.col("linked_to")).alias("target")).where("target IS NOT NULL").join(cover, ["puzzle_id", "target"], "left")
    fault = F.when(F.col("members").isNull(), "no-target").when(~F.coalesce(F.array_contains("members", id_key(F.col("entry_id"))), F.lit(False)), "not-covered")
    return linked.select("puzzle_id", "entry_id", fault.alias("fault")).where("fault IS NOT NULL")


def answer_accuracy(spark, sf_dir):
    """Answers of the first loading as guesses at those of the last: how many were made, held back and right, by direction."""
    first = puzzles._first(spark, sf_dir).select("puzzle_id", "entry_id", F.col("answer").alias("guess"))
    rows = _latest(spark, sf_dir).where("answer IS NOT NULL").select("puzzle_id", "entry_id", "direction", "answer").join(first, ["puzzle_id", "entry_id"])
    counts = rows.groupBy("direction").agg(F.count("guess").alias("guesses"), F.count_if(F.col("guess").isNull()).alias("abstentions"), F.count_if(F.col("guess") == F.col("answer")).alias("right"))
    return counts.withColumn("accuracy", F.round(F.col("right") / F.nullif("guesses", F.lit(0)), 6))


def light_runs(spark, sf_dir):
    """Longest run of open cells in any row and any column of each grid."""
    lit = puzzles._cells(spark, sf_dir).select("puzzle_id", "x", "y").distinct()
    rows = geometry.longest_runs(lit.withColumn("lit", F.lit(True)), ["puzzle_id", "y"], "x", "lit").groupBy("puzzle_id").agg(F.max("longest").alias("across"))
    columns = geometry.longest_runs(lit.withColumn("lit", F.lit(True)), ["puzzle_id", "x"], "y", "lit").groupBy("puzzle_id").agg(F.max("longest").alias("down"))
    return rows.join(columns, "puzzle_id")


def grid_limits(spark, sf_dir):
    """Violations of the limits of a grid: shape, lights in no entry of three cells, share of checked cells, cuts through it, separate parts."""
    cells = puzzles._cells(spark, sf_dir)
    lit = cells.select("puzzle_id", "x", "y").distinct()
    size = lit.groupBy("puzzle_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    shape = size.where("w <> h OR w % 2 = 0").select("puzzle_id", F.lit("not-square-or-even").alias("code"), F.lit(1).cast("bigint").alias("n"))
    long = _latest(spark, sf_dir).where("n_cells >= 3").select("puzzle_id", "entry_id")
    loose = lit.join(cells.join(long, ["puzzle_id", "entry_id"], "left_semi").select("puzzle_id", "x", "y").distinct(), ["puzzle_id", "x", "y"], "left_anti").groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n")).select("puzzle_id", F.lit("light-in-no-entry").alias("code"), "n")
    used = cells.groupBy("puzzle_id", "x", "y").agg(F.count(F.lit(1)).alias("used")).groupBy("puzzle_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("used") > 1).alias("k"))
    share = used.where(~(F.col("k") / F.col("n")).between(*CHECKED_SHARE)).select("puzzle_id", F.lit("checked-share").alias("code"), F.col("k").alias("n"))
    least = F.greatest(F.lit(3), F.expr(f"CAST(bround(4 * {GRID} / 15.0, 0) AS INT)"))
    cut = geometry.through_cuts(lit, "puzzle_id").where(F.col("least") < least).select("puzzle_id", F.lit("cut-through").alias("code"), F.col("least").alias("n"))
    parts = geometry.regions(lit, "puzzle_id").groupBy("puzzle_id").agg(F.count_distinct("region").alias("n")).where("n > 1").select("puzzle_id", F.lit("separate-parts").alias("code"), "n")
    return shape.unionByName(loose).unionByName(share).unionByName(cut).unionByName(parts)


def usage_names(spark, sf_dir):
    """Events per day and name: the known names in their order, then the others by the alphabet."""
    rows = usage._events(spark, sf_dir).groupBy(F.to_date("ts").alias("day"), F.col("event_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    names = rows.select("name").distinct()
    place = F.array_position(F.array(*map(F.lit, KNOWN)), F.col("name")).cast("int")
    others = puzzles.ordering.numbered(names.where(~F.col("name").isin(*KNOWN)), [F.col("name")]).select("name", (F.col("position") + len(KNOWN)).cast("int").alias("place"))
    placed = names.where(F.col("name").isin(*KNOWN)).select("name", place.alias("place")).unionByName(others)
    return rows.join(placed, "name").select("day", "name", "place", "n")


def usage_steps(spark, sf_dir):
    """Steps as shares of openings; the engaging one is the most frequent of its names, for a session may hold several."""
    totals = usage._events(spark, sf_dir).agg(*[F.count_if(F.col("event_type") == v).alias(v) for v in usage.VOCABULARY])
    steps = {"opened": F.col("view"), "engaged": F.greatest("click", "signup"), "bought": F.col("purchase")}
    rows = F.array(*[F.struct(F.lit(k).alias("step"), v.alias("n"), F.round(v / F.col("view"), 6).alias("share")) for k, v in steps.items()])
    return totals.select(F.explode(rows).alias("x")).select("x.*")


def judge_means(spark, sf_dir):
    """Mean of each measure by ship mode, and how often each mode's items are reduced."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.avg("l_quantity").alias("q"), F.avg("l_discount").alias("d"), F.avg((F.col("l_discount") >= 0.05).cast("int")).alias("r"))
    return rows.select("l_returnflag", "l_linestatus", *[F.round(c, 6).alias(n) for c, n in (("q", "mean_quantity"), ("d", "mean_discount"), ("r", "reduced_share"))])


def asof_reading(spark, sf_dir):
    """Each purchase with its user's newest view of the day before it."""
    events = usage._events(spark, sf_dir)
    bought = events.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return state.as_of(bought, events.where("event_type = 'view'"), ["user_id"], "ts", "value", DAY_S).select("event_id", "reading", "reading_us")


def next_resets(spark, sf_dir):
    """Each user's last sign-up as a reset that recurs weekly, seen from the newest event of all."""
    events = usage._events(spark, sf_dir)
    now = events.agg(F.max("ts").alias("ts")).select(activity.micros("ts").alias("t")).scalar()
    rows = events.where("event_type = 'signup'").groupBy("user_id").agg(F.max("ts").alias("ts")).withColumn("r", activity.micros("ts") + 2 * DAY_S * 1_000_000).withColumn("now", now)
    at, derived = state.rolled_reset(F.col("r"), F.col("now"), 7 * DAY_S * 1_000_000)
    return rows.select("user_id", at.alias("next_us"), derived.alias("derived"))


def sealed_progress(spark, sf_dir):
    """Events per type since 5 January 2024 of users and types that had none before: what was there already is not reported again."""
    events, cut = usage._events(spark, sf_dir), F.lit("2024-01-05").cast("timestamp_ntz")
    after, before = events.where(F.col("ts").cast("timestamp_ntz") >= cut), events.where(F.col("ts").cast("timestamp_ntz") < cut)
    return state.unsealed(after, before, ["user_id", "event_type"]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def changed_pushes(spark, sf_dir):
    """Merged saves of all pushes that differ from those merged of the pushes received before 2025."""
    saves = table(spark, sf_dir, "play_save").withColumn("puzzle", id_key(F.col("puzzle_id"))).where("sync_code IS NOT NULL AND puzzle IS NOT NULL")
    keys, columns = ["sync_code", "puzzle"], ["letters_typed", "reveals_used", "active_ms", "solved_at", "updated_at"]
    mine, remote = merge.merge_saves(saves, keys), merge.merge_saves(saves.where(F.col("received_at") < F.lit("2025-01-01").cast("timestamp_ntz")), keys)
    return state.to_push(mine, remote, keys, columns).select(*keys, *columns)


def stream_saves(spark, sf_dir):
    """Saves merged as they stream in, however late: the table is merged anew with every batch."""
    stream = streams.file_stream(spark, sf_dir, "play_save.parquet").withColumn("puzzle", id_key(F.col("puzzle_id"))).where("sync_code IS NOT NULL AND puzzle IS NOT NULL")
    return streams.merge_stream(stream, ["sync_code", "puzzle"]).select("sync_code", "puzzle", "letters_typed", "reveals_used", "active_ms", "solved_at", "updated_at")


def save_retention(spark, sf_dir):
    """Players whose newest save is at most 365 days older than the newest of all, with the days they have left."""
    saves = table(spark, sf_dir, "play_save").where("sync_code IS NOT NULL").groupBy("sync_code").agg(F.max("received_at").alias("last"))
    newest = saves.agg(F.max("last").alias("m")).scalar()
    left = 365 - F.datediff(newest, F.col("last"))
    return saves.withColumn("days_left", left).where("days_left >= 0").select("sync_code", "days_left")


def score_levels(spark, sf_dir):
    """Saves by how a puzzle was solved: without any hint or reveal, with hints, with reveals, or not."""
    hints = F.coalesce(F.size(F.map_keys("hints_shown")), F.lit(0))
    level = F.when(F.col("solved_at").isNull(), "open").when(F.col("reveals_used") > 0, "revealed").when(hints > 0, "hinted").otherwise("clean")
    return table(spark, sf_dir, "play_save").groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("n"), F.sum("letters_typed").alias("letters"))


def weekday_dimension(spark, sf_dir):
    """Orders by weekday against a small constant table of weekdays, Sundays having no row in it."""
    dim = spark.createDataFrame([(0, 72), (1, 83), (2, 92), (3, 101), (4, 128), (5, 97)], "weekday int, expected int")  # fixed values
    rows = table(spark, sf_dir, "orders").groupBy(F.weekday("o_orderdate").alias("weekday")).agg(F.count(F.lit(1)).alias("n"))
    return rows.join(F.broadcast(dim), "weekday")


def best_answers(spark, sf_dir):
    """Entries whose last answer equals the one of the authored clues of the same answer, by label of their type."""
    ours = table(spark, sf_dir, "authored_clue").where("answer IS NOT NULL").select(F.upper("answer").alias("answer"), F.col("clue_id").alias("ours"))
    theirs = _latest(spark, sf_dir).where("answer IS NOT NULL").select(F.upper("answer").alias("answer"), "clue_id", F.coalesce("clue_type", F.lit("none")).alias("label"))
    return ours.join(theirs, "answer").groupBy("ours", "label").agg(F.count(F.lit(1)).alias("n"))


NAMES = """puzzle_flags unsolved_queue backlog_order recent_solved refresh_set default_list sync_codes series_by_number reconcile checked_pattern check_tally
named_and_present entry_rows canonical_entries row_major index_projection hardest_first linked_faults answer_accuracy light_runs grid_limits usage_names usage_steps judge_means asof_reading next_resets sealed_progress changed_pushes stream_saves
save_retention score_levels weekday_dimension best_answers""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_E, _F, _I, _C, _KEY, _LET = puzzles._E, puzzles._F, puzzles._I, puzzles._C, puzzles._KEY, puzzles._LET
_ENUM = r"regexp_extract(clue, '\(([0-9][0-9, -]*)\)\s*$', 1)"
_SAVES = f"s AS (SELECT *, {_KEY('puzzle_id')} AS puzzle FROM play_save WHERE sync_code IS NOT NULL AND {_KEY('puzzle_id')} IS NOT NULL)"
_MERGED = "SELECT sync_code, puzzle, max(letters_typed) AS letters_typed, max(reveals_used) AS reveals_used, max(active_ms) AS active_ms, min(solved_at) AS solved_at, max(updated_at) AS updated_at FROM s {0} GROUP BY 1, 2".format
_CELLS_OF = lambda name, rows: f"{name} AS (SELECT puzzle_id, x, y, min(letter) AS letter FROM (SELECT puzzle_id, pos_x + CASE WHEN direction = 'across' THEN n ELSE 0 END AS x, pos_y + CASE WHEN direction = 'across' THEN 0 ELSE n END AS y, nullif(substr(solution, n + 1, 1), '') AS letter FROM (SELECT *, CAST(unnest(range(n_cells)) AS INTEGER) AS n FROM {rows} WHERE n_cells > 0)) WHERE letter IS NOT NULL GROUP BY 1, 2, 3)"
_RUN = lambda key, at: f"SELECT puzzle_id, max(k) AS longest FROM (SELECT puzzle_id, {key}, i, count(*) AS k FROM (SELECT puzzle_id, {key}, {at} - row_number() OVER (PARTITION BY puzzle_id, {key} ORDER BY {at}) AS i FROM l) GROUP BY 1, 2, 3) GROUP BY 1"
_CUTS = lambda a, b: f"SELECT l.puzzle_id, l.{a} AS at, count(*) AS n FROM l JOIN l o ON o.puzzle_id = l.puzzle_id AND o.{b} = l.{b} AND o.{a} = l.{a} + 1 GROUP BY 1, 2"
SQL = {
    "puzzle_flags": f"WITH {_E} SELECT puzzle_id, count(*) AS n_entries, bool_and(clue_type IS NOT NULL) AS annotated, bool_and(coalesce(solution <> '', false)) AS has_solutions FROM e GROUP BY 1",
    "unsolved_queue": f"WITH {_I} SELECT puzzle_id, row_number() OVER (ORDER BY coalesce(published_ms, 0) DESC, puzzle_id DESC) AS position FROM i WHERE NOT has_solutions AND removed_at IS NULL",
    "backlog_order": f"WITH {_I} SELECT puzzle_id, row_number() OVER (ORDER BY coalesce(published_ms, 0) DESC, puzzle_id DESC) AS position FROM i WHERE NOT annotated AND has_solutions AND removed_at IS NULL",
    "recent_solved": f"WITH {_I} SELECT puzzle_id, published_ms FROM i WHERE has_solutions AND removed_at IS NULL ORDER BY published_ms DESC, puzzle_id DESC LIMIT 12",
    "refresh_set": f"WITH {_E}, doc AS (WITH {problems._NODES} SELECT {_KEY("p ->> '$.id'")} AS puzzle FROM p WHERE p ->> '$.solutionSource.kind' IS NOT NULL) SELECT {_KEY('puzzle_id')} AS puzzle FROM e WHERE solution IS NULL OR solution = '' UNION SELECT puzzle FROM doc",
    "default_list": f"WITH {_I}, x AS (SELECT puzzle_id, annotated, row_number() OVER (PARTITION BY series ORDER BY published_ms DESC NULLS LAST, puzzle_id DESC) = 1 AS current, {_KEY('puzzle_id')} IN (SELECT {_KEY('puzzle_id')} FROM play_save WHERE letters_typed > 0 AND {_KEY('puzzle_id')} IS NOT NULL) AS begun FROM i) SELECT puzzle_id, coalesce(annotated, false) AS annotated, current, begun FROM x WHERE annotated OR current OR begun",
    "sync_codes": f"SELECT sync_code, count(DISTINCT puzzle_id) AS n_puzzles, regexp_matches(sync_code, '{CODE_SHAPE}') AND count(DISTINCT puzzle_id) <= {MOST_PUZZLES} AS accepted FROM play_save WHERE sync_code IS NOT NULL GROUP BY 1",
    "series_by_number": f"WITH {_I} SELECT CASE WHEN puzzle_no >= {NEW_SERIES_FROM} THEN 'cryptic' ELSE 'other' END AS by_number, series, count(*) AS n FROM i GROUP BY 1, 2",
    "reconcile": f"WITH {_E}, x AS (SELECT puzzle_id, entry_id, [CASE WHEN {_ENUM} <> '' AND list_sum(list_transform(regexp_extract_all({_ENUM}, '[0-9]+'), lambda v: CAST(v AS INTEGER))) <> n_cells THEN 'enumeration' END, CASE WHEN length({_LET('solution')}) <> n_cells THEN 'solution' END, CASE WHEN lower(trim(entry_id, ' ')) <> entry_no || '-' || direction THEN 'name' END] AS f FROM e), y AS (SELECT puzzle_id, entry_id, unnest(f) AS fault FROM x) SELECT * FROM y WHERE fault IS NOT NULL",
    "checked_pattern": f"WITH {_C}, u AS (SELECT *, count(*) OVER (PARTITION BY puzzle_id, x, y) AS used FROM c) SELECT puzzle_id, entry_id, string_agg(CASE WHEN used > 1 THEN upper(letter) ELSE lower(letter) END, '' ORDER BY n) AS pattern FROM u WHERE letter IS NOT NULL GROUP BY 1, 2",
    "check_tally": f"WITH {_E}, {_F}, {_CELLS_OF('wa', 'e')}, {_CELLS_OF('ty', 'f')}, x AS (SELECT puzzle_id, count(*) FILTER (ty.letter <> wa.letter) AS wrong, count(*) FILTER (ty.letter = wa.letter) AS \"right\", count(*) FILTER (ty.letter IS NULL) AS blank FROM wa LEFT JOIN ty USING (puzzle_id, x, y) GROUP BY 1) SELECT *, (wrong + \"right\") * 2 >= wrong + \"right\" + blank AS half_filled, wrong = 0 AND blank = 0 AS done FROM x",
    "named_and_present": f"WITH {_I}, x AS (SELECT series, list_sort(list(DISTINCT lower(setter)) FILTER (annotated AND setter IS NOT NULL)) AS a, list_sort(list(DISTINCT lower(setter)) FILTER (setter IS NOT NULL)) AS b FROM i GROUP BY 1) SELECT series, CAST(len(b) AS INTEGER) AS n_setters, coalesce(a, []) = b AS same FROM x",
    "entry_rows": f"WITH {_E} SELECT puzzle_id, string_agg(entry_id, ' ' ORDER BY pos_y, pos_x, direction, entry_id) AS entries FROM e GROUP BY 1",
    "canonical_entries": f"""WITH {problems._NODES}, x0 AS (SELECT raw_id, entry_id, coalesce(CAST(e ->> '$.position.y' AS BIGINT), 0) AS y, coalesce(CAST(e ->> '$.position.x' AS BIGINT), 0) AS x, coalesce(e ->> '$.direction', 'across') AS direction, coalesce(CAST(e ->> '$.length' AS BIGINT), length(e ->> '$.solution'), 0) AS n_cells, coalesce(e ->> '$.clue', '') AS clue FROM s)
SELECT raw_id, CAST(row_number() OVER (PARTITION BY raw_id ORDER BY y, x, direction, entry_id, n_cells, clue) - 1 AS INTEGER) AS place, entry_id, direction, n_cells, CAST(length(clue) AS INTEGER) AS n_signs FROM x0""",
    "row_major": f"WITH {_C}, k AS (SELECT puzzle_id, x, y, min(letter) AS l FROM c WHERE letter IS NOT NULL AND x BETWEEN 0 AND 14 AND y BETWEEN 0 AND 14 GROUP BY 1, 2, 3), g AS (SELECT DISTINCT puzzle_id FROM k) SELECT c.puzzle_id, c.entry_id, string_agg(coalesce(k.l, '.'), '' ORDER BY c.n) AS sliced FROM c JOIN g USING (puzzle_id) LEFT JOIN k ON k.puzzle_id = c.puzzle_id AND k.x = c.x AND k.y = c.y GROUP BY 1, 2",
    "index_projection": f"WITH {_I} SELECT puzzle_id, series, format('{{:,}}', puzzle_no) AS number, coalesce(annotated, false) AS annotated, coalesce(has_solutions, false) AS has_solutions, CASE WHEN len(difficulty.basis) >= 2 AND list_contains(difficulty.basis, 'device') THEN difficulty.band END AS band FROM i WHERE removed_at IS NULL".replace("{:,}", "{:,}"),
    "hardest_first": f"WITH {_I} SELECT puzzle_id, difficulty.score AS score, row_number() OVER (ORDER BY difficulty.score DESC, puzzle_id) AS position FROM i WHERE difficulty.score IS NOT NULL",
    "linked_faults": f"WITH {_E}, x AS (SELECT puzzle_id, entry_id, {_KEY('linked_to')} AS target FROM e), y AS (SELECT x.puzzle_id, x.entry_id, CASE WHEN o.group_ids IS NULL THEN 'no-target' WHEN NOT list_contains(list_transform(o.group_ids, lambda g: {_KEY('g')}), {_KEY('x.entry_id')}) THEN 'not-covered' END AS fault FROM x LEFT JOIN e o ON o.puzzle_id = x.puzzle_id AND {_KEY('o.entry_id')} = x.target WHERE x.target IS NOT NULL) SELECT * FROM y WHERE fault IS NOT NULL",
    "answer_accuracy": f"WITH {_E}, {_F}, x AS (SELECT e.direction, count(f.answer) AS guesses, count(*) FILTER (f.answer IS NULL) AS abstentions, count(*) FILTER (f.answer = e.answer) AS \"right\" FROM e JOIN f USING (puzzle_id, entry_id) WHERE e.answer IS NOT NULL GROUP BY 1) SELECT *, round(\"right\" / nullif(guesses, 0), 6) AS accuracy FROM x",
    "light_runs": f"WITH {_C}, l AS (SELECT DISTINCT puzzle_id, x, y FROM c) SELECT a.puzzle_id, a.longest AS across, d.longest AS down FROM ({_RUN('y', 'x')}) a JOIN ({_RUN('x', 'y')}) d USING (puzzle_id)",
    "grid_limits": f"""WITH RECURSIVE {_C}, l AS (SELECT DISTINCT puzzle_id, x, y FROM c), z AS (SELECT puzzle_id, max(x) + 1 AS w, max(y) + 1 AS h FROM l GROUP BY 1), g AS (SELECT DISTINCT puzzle_id, x, y FROM c JOIN e USING (puzzle_id, entry_id) WHERE n_cells >= 3),
u AS (SELECT puzzle_id, count(*) AS n, count(*) FILTER (k > 1) AS k FROM (SELECT puzzle_id, x, y, count(*) AS k FROM c GROUP BY 1, 2, 3) GROUP BY 1), cut AS (SELECT puzzle_id, min(n) AS n FROM ({_CUTS('y', 'x')} UNION ALL {_CUTS('x', 'y')}) GROUP BY 1),
g2(puzzle_id, x, y, region) AS (SELECT puzzle_id, x, y, y * 100 + x FROM l UNION SELECT l.puzzle_id, l.x, l.y, g2.region FROM g2 JOIN l ON l.puzzle_id = g2.puzzle_id AND abs(l.x - g2.x) + abs(l.y - g2.y) = 1)
SELECT puzzle_id, 'not-square-or-even' AS code, 1 AS n FROM z WHERE w <> h OR w % 2 = 0 UNION ALL SELECT puzzle_id, 'light-in-no-entry', count(*) FROM l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.puzzle_id = l.puzzle_id AND g.x = l.x AND g.y = l.y) GROUP BY 1
UNION ALL SELECT puzzle_id, 'checked-share', k FROM u WHERE k / n NOT BETWEEN {CHECKED_SHARE[0]} AND {CHECKED_SHARE[1]} UNION ALL SELECT puzzle_id, 'cut-through', n FROM cut WHERE n < 4
UNION ALL SELECT puzzle_id, 'separate-parts', count(DISTINCT region) FROM (SELECT puzzle_id, x, y, min(region) AS region FROM g2 GROUP BY 1, 2, 3) GROUP BY 1 HAVING count(DISTINCT region) > 1""",
    "usage_names": f"WITH n AS (SELECT name, CAST(row_number() OVER (ORDER BY k, name) AS INTEGER) AS place FROM (SELECT DISTINCT event_type AS name, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 ELSE 9 END AS k FROM events)) SELECT CAST(ts AS DATE) AS day, event_type AS name, place, count(*) AS n FROM events JOIN n ON name = event_type GROUP BY 1, 2, 3",
    "usage_steps": "WITH t AS (SELECT count(*) FILTER (event_type = 'view') AS v, count(*) FILTER (event_type = 'click') AS c, count(*) FILTER (event_type = 'signup') AS s, count(*) FILTER (event_type = 'purchase') AS p FROM events), x AS (SELECT 'opened' AS step, v AS n, v FROM t UNION ALL SELECT 'engaged', greatest(c, s), v FROM t UNION ALL SELECT 'bought', p, v FROM t) SELECT step, n, round(n / v, 6) AS share FROM x",
    "judge_means": "SELECT l_returnflag, l_linestatus, round(avg(l_quantity), 6) AS mean_quantity, round(avg(l_discount), 6) AS mean_discount, round(avg(CASE WHEN l_discount >= 0.05 THEN 1 ELSE 0 END), 6) AS reduced_share FROM lineitem GROUP BY 1, 2",
    "asof_reading": "WITH v AS (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'view' GROUP BY 1, 2), x AS (SELECT p.event_id, p.ts, v.value, v.ts AS seen FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts) SELECT event_id, CASE WHEN epoch_us(ts) - epoch_us(seen) <= 86400000000 THEN value END AS reading, CASE WHEN epoch_us(ts) - epoch_us(seen) <= 86400000000 THEN epoch_us(seen) END AS reading_us FROM x",
    "next_resets": "WITH x AS (SELECT user_id, epoch_us(max(ts)) + 172800000000 AS r, (SELECT epoch_us(max(ts)) FROM events) AS now FROM events WHERE event_type = 'signup' GROUP BY 1), y AS (SELECT user_id, now, r <= now AS derived, CASE WHEN r <= now THEN r + 604800000000 ELSE r END AS n FROM x) SELECT user_id, CASE WHEN n > now THEN n END AS next_us, CASE WHEN n > now THEN derived END AS derived FROM y",
    "sealed_progress": "SELECT event_type, count(*) AS n FROM events e WHERE ts >= '2024-01-05' AND NOT EXISTS (SELECT 1 FROM events b WHERE b.ts < '2024-01-05' AND b.user_id = e.user_id AND b.event_type = e.event_type) GROUP BY 1",
    "changed_pushes": f"WITH {_SAVES}, m AS ({_MERGED('')}), r AS ({_MERGED('''WHERE received_at < '2025-01-01' ''')}) SELECT m.* FROM m LEFT JOIN r ON r.sync_code = m.sync_code AND r.puzzle = m.puzzle WHERE r.sync_code IS NULL OR (m.letters_typed, m.reveals_used, m.active_ms, m.solved_at, m.updated_at) IS DISTINCT FROM (r.letters_typed, r.reveals_used, r.active_ms, r.solved_at, r.updated_at)",
    "stream_saves": f"WITH {_SAVES} {_MERGED('')}",
    "save_retention": "WITH x AS (SELECT sync_code, max(received_at) AS last FROM play_save WHERE sync_code IS NOT NULL GROUP BY 1), y AS (SELECT sync_code, CAST(365 - date_diff('day', CAST(last AS DATE), CAST((SELECT max(last) FROM x) AS DATE)) AS INTEGER) AS days_left FROM x) SELECT * FROM y WHERE days_left >= 0",
    "score_levels": "SELECT CASE WHEN solved_at IS NULL THEN 'open' WHEN reveals_used > 0 THEN 'revealed' WHEN coalesce(cardinality(hints_shown), 0) > 0 THEN 'hinted' ELSE 'clean' END AS level, count(*) AS n, CAST(sum(letters_typed) AS BIGINT) AS letters FROM play_save GROUP BY 1",
    "weekday_dimension": "WITH d(weekday, expected) AS (VALUES (0, 72), (1, 83), (2, 92), (3, 101), (4, 128), (5, 97)), o AS (SELECT CAST(isodow(o_orderdate) - 1 AS INTEGER) AS weekday, count(*) AS n FROM orders GROUP BY 1) SELECT o.weekday, n, expected FROM o JOIN d USING (weekday)",
    "best_answers": f"WITH {_E} SELECT a.clue_id AS ours, coalesce(e.clue_type, 'none') AS label, count(*) AS n FROM authored_clue a JOIN e ON upper(a.answer) = upper(e.answer) WHERE a.answer IS NOT NULL GROUP BY 1, 2",
}
