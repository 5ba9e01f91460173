"""Usage reports, sessions and merges on the event log and the pushed saves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.functions.text import id_key
from cluemill.operators import activity, merge
from cluemill.session import table
from cluemill.streaming import events as streams

VOCABULARY = ("view", "click", "signup", "purchase", "error")
IDLE_S = 3600


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def usage_daily_pivot(spark, sf_dir):
    return activity.daily_pivot(_events(spark, sf_dir), "ts", "event_type", VOCABULARY)


def usage_totals(spark, sf_dir):
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def usage_funnel(spark, sf_dir):
    return activity.funnel(_events(spark, sf_dir), "event_type", "view")


def last_n_active_days(spark, sf_dir):
    return activity.last_active_days(_events(spark, sf_dir), "ts", 7)


def session_counts(spark, sf_dir):
    rows = activity.with_session(_events(spark, sf_dir), ["user_id"], "ts", "event_id", IDLE_S)
    return rows.groupBy("user_id").agg(F.max("session_no").alias("n_sessions"), F.count(F.lit(1)).alias("n_events"))


def active_time(spark, sf_dir):
    return activity.active_time(_events(spark, sf_dir), ["user_id"], "ts", "event_id", IDLE_S).select("user_id", "active_us")


def first_event_per_session(spark, sf_dir):
    rows = activity.with_session(_events(spark, sf_dir), ["user_id"], "ts", "event_id", IDLE_S).select("user_id", "session_no", "ts", "event_id", "event_type")
    return activity.first_per(rows, ["user_id", "session_no"], ["ts", "event_id"]).select("user_id", "session_no", "event_id", "event_type")


def ladder_depth(spark, sf_dir):
    """Per user and day that holds an error: the highest rung of the other types seen; days per depth."""
    rungs = F.create_map(*[F.lit(x) for k, v in enumerate(("view", "click", "signup", "purchase"), 1) for x in (v, k)])
    days = _events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.max(F.col("event_type") == "error").alias("bailed"), F.max(F.coalesce(rungs[F.col("event_type")], F.lit(0))).alias("depth"))
    return days.where("bailed").groupBy("depth").agg(F.count(F.lit(1)).alias("n_days"))


def bail_rate_top(spark, sf_dir):
    per_user = _events(spark, sf_dir).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("bails")).where("n >= 5")
    return per_user.withColumn("rate", F.round(F.col("bails") / F.col("n"), 6)).orderBy(F.col("rate").desc(), "user_id").limit(10)


def _updates(spark, sf_dir):
    return _events(spark, sf_dir).select("user_id", "ts", "value", "event_type", F.get_json_object("props", "$.k").alias("cell"))


def cell_lww_merge(spark, sf_dir):
    return merge.last_writer_wins(_updates(spark, sf_dir), ["user_id"], "cell", "ts", "value", F.col("event_type") == "error", F.col("event_type") == "signup")


def merge_growonly(spark, sf_dir):
    return _updates(spark, sf_dir).groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"), F.max("value").alias("most"), F.min("value").alias("least"))


def merge_timing(spark, sf_dir):
    bought = F.when(F.col("event_type") == "purchase", F.struct("ts", "value"))
    rows = _updates(spark, sf_dir).groupBy("user_id").agg(F.min("ts").alias("started"), F.max("ts").alias("last"), F.min(bought).alias("first"))
    return rows.select("user_id", "started", "last", F.col("first.ts").alias("solved_at"), F.col("first.value").alias("solved_value"))


def json_prop_stats(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return _events(spark, sf_dir).groupBy("event_type").agg(F.count(k).alias("n"), F.sum(k).alias("total"), F.min(k).alias("least"), F.max(k).alias("most"))


def gate_verdict(spark, sf_dir):
    rows = activity.running_gate(_events(spark, sf_dir).withColumn("day", F.to_date("ts")), "day", "ts", "event_id", "value", 100.0)
    return rows.groupBy("day", "verdict").agg(F.count(F.lit(1)).alias("n"))


def alert_suppress(spark, sf_dir):
    rows = activity.suppress_repeats(_events(spark, sf_dir), ["user_id", "event_type"], "ts", "event_id", 12 * 3600)
    return rows.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_alerts"))


def event_retention(spark, sf_dir):
    """Events of the last 7 days before the newest one, per type."""
    events = _events(spark, sf_dir)
    newest = events.agg(F.max("ts").alias("newest")).scalar()
    return events.where(F.col("ts") > newest - F.expr("INTERVAL 7 DAYS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def stream_daily(spark, sf_dir):
    stream = streams.known(streams.event_stream(spark, sf_dir, "events.parquet"), ("view", "click", "purchase"))
    return streams.drain(streams.daily_counts(stream, "400 days"), "complete")


def stream_dedup(spark, sf_dir):
    stream = streams.event_stream(spark, sf_dir, "events.parquet").withColumn("day", F.to_date("ts"))
    return streams.drain(streams.once_per(stream, ["user_id", "event_type", "day"], "400 days").select("user_id", "event_type", "day"))


def save_merge(spark, sf_dir):
    saves = table(spark, sf_dir, "play_save").withColumn("puzzle", id_key(F.col("puzzle_id"))).where("sync_code IS NOT NULL AND puzzle IS NOT NULL")
    return merge.merge_saves(saves, ["sync_code", "puzzle"])


def hint_union(spark, sf_dir):
    saves = table(spark, sf_dir, "play_save").withColumn("puzzle", id_key(F.col("puzzle_id"))).where("sync_code IS NOT NULL AND puzzle IS NOT NULL")
    return merge.merge_hints(saves, ["sync_code", "puzzle"], "hints_shown").withColumn("rungs", F.array_join("rungs", ","))


def rung_usage(spark, sf_dir):
    """Hints shown by rung, most used first."""
    shown = table(spark, sf_dir, "play_save").select(F.explode("hints_shown").alias("entry_id", "rungs")).select(F.explode("rungs").alias("rung"))
    return shown.groupBy("rung").agg(F.count(F.lit(1)).alias("n"))


def score_tally(spark, sf_dir):
    """Per puzzle: players, solved, solved without hints, letters typed."""
    saves = table(spark, sf_dir, "play_save").withColumn("puzzle", id_key(F.col("puzzle_id"))).where("puzzle IS NOT NULL")
    no_hint = F.col("solved_at").isNotNull() & (F.coalesce(F.size(F.map_keys("hints_shown")), F.lit(0)) <= 0)
    return saves.groupBy("puzzle").agg(F.count_distinct("sync_code").alias("n_players"), F.count("solved_at").alias("n_solved"), F.count_if(no_hint).alias("n_no_hint"), F.sum("letters_typed").alias("letters"))


def cursor_last(spark, sf_dir):
    """Each player's newest save; ties go to the smaller save_id."""
    rows = table(spark, sf_dir, "play_save").where("sync_code IS NOT NULL").select("sync_code", (-activity.micros("updated_at")).alias("neg"), "save_id", "puzzle_id")
    return activity.first_per(rows, ["sync_code"], ["neg", "save_id"]).select("sync_code", "save_id", "puzzle_id")


NAMES = """usage_daily_pivot usage_totals usage_funnel last_n_active_days session_counts active_time first_event_per_session ladder_depth
bail_rate_top cell_lww_merge merge_growonly merge_timing json_prop_stats gate_verdict alert_suppress event_retention stream_daily stream_dedup
save_merge hint_union rung_usage score_tally cursor_last""".split()
QUERIES = {name: globals()[name] for name in NAMES}

_SESSIONS = """WITH g AS (SELECT *, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap_us FROM events),
s AS (SELECT *, sum(CASE WHEN gap_us IS NULL OR gap_us > 3600000000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session_no FROM g)"""
_SAVES = "WITH s AS (SELECT *, lower(trim(puzzle_id, E' \\t\\n\\r')) AS puzzle FROM play_save)"
SQL = {
    "usage_daily_pivot": "SELECT CAST(ts AS DATE) AS day, " + ", ".join(f"count(*) FILTER (event_type = '{v}') AS {v}" for v in VOCABULARY) + f", count(*) FILTER (event_type IS NULL OR event_type NOT IN {VOCABULARY}) AS other FROM events GROUP BY 1",
    "usage_totals": "SELECT event_type, count(*) AS n FROM events GROUP BY 1",
    "usage_funnel": "SELECT event_type AS name, count(*) AS n, round(count(*) / (SELECT count(*) FROM events WHERE event_type = 'view'), 6) AS share FROM events GROUP BY 1",
    "last_n_active_days": "SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1 ORDER BY 1 DESC LIMIT 7",
    "session_counts": _SESSIONS + " SELECT user_id, CAST(max(session_no) AS BIGINT) AS n_sessions, count(*) AS n_events FROM s GROUP BY 1",
    "active_time": _SESSIONS + " SELECT user_id, CAST(sum(CASE WHEN gap_us > 0 AND gap_us <= 3600000000 THEN gap_us ELSE 0 END) AS BIGINT) AS active_us FROM s GROUP BY 1",
    "first_event_per_session": _SESSIONS + " SELECT user_id, CAST(session_no AS BIGINT) AS session_no, event_id, event_type FROM s WHERE gap_us IS NULL OR gap_us > 3600000000",
    "ladder_depth": """WITH d AS (SELECT user_id, CAST(ts AS DATE) AS day, bool_or(event_type = 'error') AS bailed, max(CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 ELSE 0 END) AS depth FROM events GROUP BY 1, 2)
SELECT depth, count(*) AS n_days FROM d WHERE bailed GROUP BY 1""",
    "bail_rate_top": "SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'error') AS bails, round(count(*) FILTER (event_type = 'error') / count(*), 6) AS rate FROM events GROUP BY 1 HAVING count(*) >= 5 ORDER BY 4 DESC, 1 LIMIT 10",
    "cell_lww_merge": """WITH u AS (SELECT user_id, ts, value, event_type, json_extract_string(props, '$.k') AS cell FROM events),
r AS (SELECT user_id, max(ts) AS cleared FROM u WHERE event_type = 'signup' GROUP BY 1),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, cell ORDER BY ts DESC, (event_type <> 'error') DESC, value DESC) AS k FROM u WHERE event_type <> 'signup' AND cell IS NOT NULL)
SELECT n.user_id, n.cell, n.ts, CASE WHEN n.event_type <> 'error' THEN n.value END AS value, n.event_type = 'error' AS deleted FROM n LEFT JOIN r USING (user_id) WHERE k = 1 AND (cleared IS NULL OR n.ts >= cleared)""",
    "merge_growonly": "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, max(value) AS most, min(value) AS least FROM events GROUP BY 1",
    "merge_timing": """SELECT user_id, min(ts) AS started, max(ts) AS last, min(ts) FILTER (event_type = 'purchase') AS solved_at, arg_min(value, struct_pack(ts := ts, value := value)) FILTER (event_type = 'purchase') AS solved_value FROM events GROUP BY 1""",
    "json_prop_stats": "WITH p AS (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, min(k) AS least, max(k) AS most FROM p GROUP BY 1",
    "gate_verdict": """WITH h AS (SELECT CAST(ts AS DATE) AS day, max(value) OVER (PARTITION BY CAST(ts AS DATE) ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS high FROM events)
SELECT day, CASE WHEN high IS NULL THEN 'unknown' WHEN high >= 100 THEN 'over' ELSE 'under' END AS verdict, count(*) AS n FROM h GROUP BY 1, 2""",
    "alert_suppress": "WITH g AS (SELECT event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS gap_us FROM events) SELECT event_type, count(*) AS n_alerts FROM g WHERE gap_us IS NULL OR gap_us > 43200000000 GROUP BY 1",
    "event_retention": "SELECT event_type, count(*) AS n FROM events WHERE ts > (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY 1",
    "stream_daily": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_type IN ('view', 'click', 'purchase') AND coalesce(octet_length(encode(props)), 0) <= 32 GROUP BY 1, 2",
    "stream_dedup": "SELECT DISTINCT user_id, event_type, CAST(ts AS DATE) AS day FROM events",
    "save_merge": _SAVES + " SELECT sync_code, puzzle, count(*) AS n_pushes, max(letters_typed) AS letters_typed, max(reveals_used) AS reveals_used, max(active_ms) AS active_ms, min(solved_at) AS solved_at, max(updated_at) AS updated_at FROM s WHERE sync_code IS NOT NULL AND puzzle <> '' GROUP BY 1, 2",
    "hint_union": _SAVES + """, h AS (SELECT sync_code, puzzle, unnest(map_entries(hints_shown)) AS e FROM s WHERE sync_code IS NOT NULL AND puzzle <> ''), r AS (SELECT sync_code, puzzle, e.key AS entry_id, unnest(e.value) AS rung FROM h)
SELECT sync_code, puzzle, entry_id, string_agg(DISTINCT rung, ',' ORDER BY rung) AS rungs FROM r GROUP BY 1, 2, 3""",
    "rung_usage": "WITH h AS (SELECT unnest(map_entries(hints_shown)) AS e FROM play_save), r AS (SELECT unnest(e.value) AS rung FROM h) SELECT rung, count(*) AS n FROM r GROUP BY 1",
    "score_tally": _SAVES + " SELECT puzzle, count(DISTINCT sync_code) AS n_players, count(solved_at) AS n_solved, count(*) FILTER (solved_at IS NOT NULL AND coalesce(cardinality(hints_shown), 0) = 0) AS n_no_hint, CAST(sum(letters_typed) AS BIGINT) AS letters FROM s WHERE puzzle <> '' GROUP BY 1",
    "cursor_last": "SELECT sync_code, save_id, puzzle_id FROM (SELECT *, row_number() OVER (PARTITION BY sync_code ORDER BY updated_at DESC, save_id) AS k FROM play_save WHERE sync_code IS NOT NULL) WHERE k = 1",
}
