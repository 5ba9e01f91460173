"""Queries of the general problems 1 to 3 on the project's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cluemill.functions.text import id_key
from cluemill.operators import drift, nested, orphans
from cluemill.session import materialize, table

PUZZLE_MODEL = nested.DocumentModel(
    aliases={"annotations": "annotation"},
    keyed=frozenset({"entries", "annotations"}),
    maps=frozenset({"indicatorNotes", "separatorLocations"}),
    records=frozenset({"entries", "annotation"}),
    keys={"entries": ("id", "@key", "{number}-{direction}")},
    references={"annotations": "entries"},
    wrappers=frozenset({"puzzle"}),
    markers=("/*JSON-START*/", "/*JSON-END*/"),
)
NODE_KINDS = {"entries": "entry", "annotation": "annotation", "blocks": "block", "pieces": "piece"}


#: Columns that the tables have in any case, whatever the documents at hand hold; others come from the element graph.
DECLARED = {
    "document": {"id": "string", "number": "string", "series": "string", "name": "string", "setter": "string", "date": "bigint", "dimensions.rows": "bigint", "dimensions.cols": "bigint", "sourceUrl": "string", "v": "bigint"} | {
        f"solutionSource.{c}": "string" for c in ("check", "date", "kind", "model")
    },
    "entries": {"id": "string", "number": "bigint", "direction": "string", "position.x": "bigint", "position.y": "bigint", "length": "bigint", "clue": "string", "solution": "string"},
    "annotation": dict.fromkeys(("type", "answer", "definition", "walkthrough", "definitionFit", "definitionNote", "linkedTo", "anagram.fodder"), "string"),
    "blocks": dict.fromkeys(("clueFragment", "gives", "note", "soundsLike"), "string"),
    "pieces": dict.fromkeys(("value", "text", "from"), "string"),
    "group": {"value": "string"}, "separatorLocations": {"value": "string"}, "clueItalics": {"value": "string"},
    "indicators": {"value": "string"}, "linkWords": {"value": "string"}, "indicatorNotes": {"value": "string"},
    "subAnagrams": {"fodder": "string", "gives": "string"}, "subReversals": {"from": "string", "to": "string"},
}
#: Tables of the documents, by the query that gives each.
TABLES = {
    "p1_documents": "document", "p1_entries": "entries", "p1_annotations": "annotation", "p1_blocks": "blocks", "p1_pieces": "pieces", "p1_groups": "group", "p1_separators": "separatorLocations",
    "p1_italics": "clueItalics", "p1_indicators": "indicators", "p1_link_words": "linkWords", "p1_indicator_notes": "indicatorNotes", "p1_sub_anagrams": "subAnagrams", "p1_sub_reversals": "subReversals",
}


def _puzzle_plan(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, nested.InlinePlan]:
    docs = table(spark, sf_dir, "puzzle_file")
    return docs, nested.inline_plan(nested.element_graph(docs, "body", PUZZLE_MODEL), PUZZLE_MODEL, DECLARED)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, plan = _puzzle_plan(spark, sf_dir)
    rows = nested.shred(docs, "raw_id", "body", PUZZLE_MODEL, plan, NODE_KINDS, attributes=False)
    kind = F.create_map(*[F.lit(x) for pair in NODE_KINDS.items() for x in pair])[F.col("element")]
    single = F.col("element").isin("entries", "annotation")
    return (
        rows.where((F.col("element") != "annotation") | F.col("has_fields"))
        .select("raw_id", F.col("keys")["entries"].alias("entry_id"), kind.alias("node_kind"), F.when(single, 0).otherwise(F.col("item_no")).alias("item_no"))
        .distinct()
    )


def puzzle_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Every table of the plan by its element, those of elements not declared included."""
    docs, plan = _puzzle_plan(spark, sf_dir)
    return {element: _flat(docs, plan, element) for element in sorted(plan.tables)}


def _flat(docs: DataFrame, plan: nested.InlinePlan, element: str) -> DataFrame:
    rows = nested.shred(docs, "raw_id", "body", PUZZLE_MODEL, plan, [element]).where((F.col("element") != "annotation") | F.col("has_fields"))
    keys = [] if element == nested.ROOT else ["entries"]
    return nested.flat_table(rows, "raw_id", element, plan.columns[element] | DECLARED.get(element, {}), keys)


def _table_query(element: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _flat(*_puzzle_plan(spark, sf_dir), element)

    return query


def p1_schema_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.schema_graph(table(spark, sf_dir, "puzzle_file"), "body", PUZZLE_MODEL)


SEP = "\u0001"


def _references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every reference of clue_entry and play_save."""
    entries = table(spark, sf_dir, "clue_entry").select("clue_id", "puzzle_id", "entry_id", "group_ids", "linked_to", "loaded_at")
    ref = lambda field, value, target: F.struct(F.lit(field).alias("field_name"), value.alias("ref_value"), F.lit(target).alias("target"))
    group = F.transform(F.array_distinct(F.coalesce("group_ids", F.array().cast("array<string>"))), lambda g: ref("group_ids", g, "entry"))
    in_entries = entries.select(
        F.lit("clue_entry").alias("table_name"), F.col("clue_id").alias("row_key"), "puzzle_id", F.col("loaded_at").alias("at"), _entry_key().alias("own_key"),
        F.explode(F.concat(F.array(ref("puzzle_id", F.col("puzzle_id"), "puzzle"), ref("linked_to", F.col("linked_to"), "entry")), group)).alias("r"),
    ).select("table_name", "row_key", "puzzle_id", "at", "own_key", "r.*")
    saves = table(spark, sf_dir, "play_save").select(
        F.lit("play_save").alias("table_name"), F.col("save_id").alias("row_key"), "puzzle_id", F.col("received_at").alias("at"), F.lit(None).cast("string").alias("own_key"),
        F.lit("puzzle_id").alias("field_name"), F.col("puzzle_id").alias("ref_value"), F.lit("puzzle").alias("target"),
    )
    inside = F.concat(F.coalesce(id_key(F.col("puzzle_id")), F.lit("")), F.lit(SEP), id_key(F.col("ref_value")))
    key = F.when(F.col("target") == "puzzle", id_key(F.col("ref_value"))).otherwise(inside)
    return in_entries.unionByName(saves).withColumn("ref_key", key).withColumn("own_target", F.when(F.col("own_key").isNotNull(), "entry")).select(*orphans.REFERENCE_COLUMNS, *orphans.OWN_COLUMNS)


def _entry_key() -> Column:
    return F.concat(id_key(F.col("puzzle_id")), F.lit(SEP), id_key(F.col("entry_id")))


def _targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that references may lead to; the house's own puzzles are always there."""
    never = F.lit(None).cast("timestamp_ntz")
    puzzles = table(spark, sf_dir, "puzzle_index").select(F.lit("puzzle").alias("target"), id_key(F.col("puzzle_id")).alias("ref_key"), "loaded_at", "removed_at")
    own = table(spark, sf_dir, "authored_clue").select(F.lit("puzzle").alias("target"), id_key(F.col("puzzle_id")).alias("ref_key"), never.alias("loaded_at"), never.alias("removed_at")).distinct()
    entries = table(spark, sf_dir, "clue_entry").select(F.lit("entry").alias("target"), _entry_key().alias("ref_key"), "loaded_at", "removed_at")
    return puzzles.unionByName(own).unionByName(entries)


def _cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.cascade(_references(spark, sf_dir), _targets(spark, sf_dir), ["entry"]).withColumn("period", orphans.month(F.col("at")))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cascade(spark, sf_dir).where("depth = 0").select("table_name", "row_key", "field_name", "ref_value", "reason", "period")


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references and their rows per table, month and reason; those with reason inherited are not direct."""
    return _cascade(spark, sf_dir).groupBy("table_name", "period", "reason").agg(F.count(F.lit(1)).alias("n_references"), F.count_distinct("row_key").alias("n_rows"))


def p2_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by table, month and depth: direct orphans and those that inherit from them."""
    return _cascade(spark, sf_dir).groupBy("table_name", "period", "depth").agg(F.count_distinct("row_key").alias("n_rows")).withColumn("inherited", F.col("depth") > 0)


FEEDS = {"annotation_feed": "lines", "backlog_file": "allowances"}


def _records(spark: SparkSession, sf_dir: str, *names: str, values: bool = False) -> DataFrame:
    """Records of the named tables, parsed once and written to the shared folder: two branches of the plans read them."""
    parts = [drift.records(table(spark, sf_dir, name), name, FEEDS[name], values) for name in names]
    return materialize(parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drift.changes(_records(spark, sf_dir, *FEEDS)).select("file_name", "field_name", "change_kind", "old_name").distinct()


def p3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema of each file: its version in its feed, and its fields with their kinds."""
    prints = materialize(drift.fingerprints(_records(spark, sf_dir, *FEEDS)))
    rows = prints.join(drift.file_chain(prints), drift.FILE).where(F.col("field_name").isNotNull())
    return rows.select("series", "feed", "file_name", "version", "field_name", "kinds")


def p3_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By file and field: the name the field had first in its feed, and whether its values become text."""
    rows = _records(spark, sf_dir, *FEEDS)
    rules = drift.field_rules(materialize(drift.fingerprints(rows)), materialize(drift.changes(rows)))
    return rules.where(F.col("field_name").isNotNull()).select("series", "feed", "file_name", "version", "field_name", "first_name", "as_text")


def _unified(spark: SparkSession, sf_dir: str, name: str, *keys: str) -> DataFrame:
    rows = _records(spark, sf_dir, name, values=True)
    return drift.unified(rows, materialize(drift.changes(rows))).select("feed", "file_name", "exported_at", "version", *keys, F.to_json("fields").alias("fields"), "conflicts")


def p3_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of annotations: every entry of every file with its values under first names."""
    return _unified(spark, sf_dir, "annotation_feed", "id", "entry")


def p3_allowances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The consistent table of allowances: every puzzle of every file with its counts under first names, and a row for what belongs to no puzzle."""
    return _unified(spark, sf_dir, "backlog_file", "puzzle")


QUERIES = {
    "p1_found": p1_found,
    **{name: _table_query(element) for name, element in TABLES.items()},
    "p1_schema_graph": p1_schema_graph,
    "p2_found": p2_found,
    "p2_report": p2_report,
    "p2_cascade": p2_cascade,
    "p3_found": p3_found,
    "p3_fingerprints": p3_fingerprints,
    "p3_rules": p3_rules,
    "p3_annotations": p3_annotations,
    "p3_allowances": p3_allowances,
}

_KEY = "nullif(lower(regexp_replace({}, '^\\s+|\\s+$', '', 'g')), '')".format
_REFERENCES = f"""t AS (SELECT 'puzzle' AS target, {_KEY('puzzle_id')} AS k, loaded_at AS a, removed_at AS b FROM puzzle_index
UNION ALL SELECT DISTINCT 'puzzle', {_KEY('puzzle_id')}, TIMESTAMP '0001-01-01', CAST(NULL AS TIMESTAMP) FROM authored_clue
UNION ALL SELECT 'entry', {_KEY('puzzle_id')} || chr(1) || {_KEY('entry_id')}, loaded_at, removed_at FROM clue_entry),
g AS (SELECT clue_id, puzzle_id, loaded_at, unnest(list_distinct(group_ids)) AS g FROM clue_entry),
r AS (SELECT 'clue_entry' AS table_name, clue_id AS row_key, 'puzzle_id' AS field_name, puzzle_id AS ref_value, 'puzzle' AS target, {_KEY('puzzle_id')} AS k, loaded_at AS made FROM clue_entry
UNION ALL SELECT 'clue_entry', clue_id, 'linked_to', linked_to, 'entry', {_KEY('puzzle_id')} || chr(1) || {_KEY('linked_to')}, loaded_at FROM clue_entry
UNION ALL SELECT 'clue_entry', clue_id, 'group_ids', g, 'entry', {_KEY('puzzle_id')} || chr(1) || {_KEY('g')}, loaded_at FROM g
UNION ALL SELECT 'play_save', save_id, 'puzzle_id', puzzle_id, 'puzzle', {_KEY('puzzle_id')}, received_at FROM play_save),
j AS (SELECT table_name, row_key, field_name, ref_value, made, count(t.k) AS n, count(*) FILTER (t.a <= r.made) AS came, count(*) FILTER (t.a <= r.made AND (t.b IS NULL OR t.b > r.made)) AS alive
FROM r LEFT JOIN t ON r.target = t.target AND r.k = t.k WHERE r.k IS NOT NULL GROUP BY 1, 2, 3, 4, 5),
p2 AS (SELECT table_name, row_key, field_name, ref_value, CASE WHEN n = 0 THEN 'missing' WHEN came = 0 THEN 'late' ELSE 'deleted' END AS reason, strftime(made, '%Y-%m') AS period FROM j WHERE alive = 0)"""
#: Rows found at each depth: the shortest way from a direct orphan; ways are cut at 40 steps, longer than any chain of entries in a puzzle's groups.
_INHERITED = f"""own AS (SELECT clue_id, {_KEY('puzzle_id')} || chr(1) || {_KEY('entry_id')} AS own_key FROM clue_entry),
links AS (SELECT r.*, strftime(made, '%Y-%m') AS period FROM r JOIN own ON own.clue_id = r.row_key WHERE r.table_name = 'clue_entry' AND target = 'entry' AND k IS NOT NULL AND own_key IS DISTINCT FROM k),
way(row_key, depth) AS (SELECT DISTINCT row_key, 0 FROM p2 WHERE table_name = 'clue_entry' UNION SELECT links.row_key, depth + 1 FROM way JOIN own ON own.clue_id = way.row_key JOIN links ON links.k = own.own_key WHERE depth < 40),
least AS (SELECT row_key, min(depth) AS depth FROM way GROUP BY 1),
o AS (SELECT table_name, row_key, field_name, ref_value, reason, period, 0 AS depth FROM p2
UNION ALL SELECT links.table_name, links.row_key, field_name, ref_value, 'inherited', period, least.depth FROM links JOIN least USING (row_key)
WHERE least.depth > 0 AND EXISTS (SELECT 1 FROM own JOIN least b ON b.row_key = own.clue_id WHERE own.own_key = links.k AND b.depth = least.depth - 1))"""
_NOTE = "CASE WHEN json_type({0}) = 'VARCHAR' THEN CASE WHEN json_valid({0} ->> '$') THEN CAST({0} ->> '$' AS JSON) END ELSE {0} END".format
_NODES = rf"""b AS (SELECT raw_id, ltrim(CASE WHEN contains(body, '/*JSON-START*/') THEN regexp_extract(body, '(?s)/\*JSON-START\*/(.*)/\*JSON-END\*/', 1) ELSE body END, chr(65279)) AS t FROM puzzle_file),
d AS MATERIALIZED (SELECT raw_id, CAST(t AS JSON) AS j FROM b WHERE json_valid(t)),
p AS (SELECT raw_id, coalesce(json_type(j, '$.puzzle') = 'OBJECT', false) AS w, CASE WHEN json_type(j, '$.puzzle') = 'OBJECT' THEN j -> '$.puzzle' ELSE j END AS p, j FROM d WHERE json_type(j) = 'OBJECT'),
o AS (SELECT raw_id, w, p -> '$.entries' AS es, unnest(json_keys(p, '$.entries')) AS k FROM p WHERE json_type(p, '$.entries') = 'OBJECT'),
e AS (SELECT raw_id, w, CAST(NULL AS VARCHAR) AS k, unnest(CAST(p -> '$.entries' AS JSON[])) AS e, unnest(range(CAST(json_array_length(p, '$.entries') AS BIGINT))) AS i FROM p WHERE json_type(p, '$.entries') = 'ARRAY'
UNION ALL SELECT raw_id, w, k, json_extract(es, '$."' || k || '"'), 0 FROM o),
s AS MATERIALIZED (SELECT raw_id, coalesce(nullif(e ->> '$.id', ''), k, concat(e ->> '$.number', '-', e ->> '$.direction')) AS entry_id, concat('/entries[', coalesce(k, CAST(i AS VARCHAR)), ']') AS node_id, i, k, e, e -> '$.annotation' AS a FROM e WHERE json_type(e) = 'OBJECT'),
h AS (SELECT raw_id, '/annotations[' AS prefix, j -> '$.annotations' AS m FROM p UNION ALL SELECT raw_id, '/annotations[', p -> '$.annotations' FROM p WHERE w),
q AS (SELECT raw_id, prefix, m, unnest(json_keys(m)) AS k FROM h WHERE json_type(m) = 'OBJECT'),
a AS (SELECT raw_id, entry_id, node_id || '/annotation[0]' AS node_id, 'entries' AS parent_element, node_id AS parent_id, CAST(NULL AS VARCHAR) AS item_key, {_NOTE('a')} AS n FROM s
UNION ALL SELECT raw_id, k, prefix || k || ']', 'document', '', k, {_NOTE("json_extract(m, '$.' || chr(34) || k || chr(34))")} FROM q WHERE EXISTS (SELECT 1 FROM s WHERE s.raw_id = q.raw_id AND s.entry_id = q.k)),
g AS MATERIALIZED (SELECT * FROM a WHERE json_type(n) = 'OBJECT' AND len(json_keys(n)) > 0),
items AS (SELECT raw_id, entry_id, 'entries' AS parent_element, node_id AS parent_id, f, e -> ('$.' || f) AS v FROM s, (VALUES ('group'), ('separatorLocations'), ('clueItalics')) t(f)
UNION ALL SELECT raw_id, entry_id, 'annotation', node_id, f, n -> ('$.' || f) FROM g, (VALUES ('blocks'), ('pieces'), ('indicators'), ('linkWords'), ('indicatorNotes'), ('subAnagrams'), ('subReversals')) t(f)),
mapped AS (SELECT *, unnest(json_keys(v)) AS k, unnest(range(CAST(len(json_keys(v)) AS BIGINT))) AS i FROM items WHERE json_type(v) = 'OBJECT' AND f IN ('separatorLocations', 'indicatorNotes')),
listed AS (SELECT *, unnest(CAST(v AS JSON[])) AS x, unnest(range(CAST(json_array_length(v) AS BIGINT))) AS i FROM items WHERE json_type(v) = 'ARRAY'),
every AS (SELECT raw_id, entry_id, parent_element, parent_id, f, x, CAST(NULL AS VARCHAR) AS item_key, i FROM listed
UNION ALL SELECT raw_id, entry_id, parent_element, parent_id, f, v, NULL, 0 FROM items WHERE json_type(v) <> 'ARRAY' AND NOT (json_type(v) = 'OBJECT' AND f IN ('separatorLocations', 'indicatorNotes'))
UNION ALL SELECT raw_id, entry_id, parent_element, parent_id, f, json_extract(v, '$.' || chr(34) || k || chr(34)), k, i FROM mapped),
c AS (SELECT *, concat(parent_id, '/', f, '[', coalesce(item_key, CAST(i AS VARCHAR)), ']') AS node_id FROM every WHERE json_type(x) <> 'NULL')"""
_FOUND = """SELECT DISTINCT raw_id, entry_id, node_kind, CAST(item_no AS INTEGER) AS item_no FROM (SELECT raw_id, entry_id, 'entry' AS node_kind, 0 AS item_no FROM s
UNION ALL SELECT raw_id, entry_id, 'annotation', 0 FROM g UNION ALL SELECT raw_id, entry_id, f[:-2], i FROM c WHERE f IN ('blocks', 'pieces'))"""


def _table_sql(element: str) -> str:
    """A table of the documents in SQL, over the nodes of _NODES."""
    source, item, place = {"document": ("p", "p", "CAST(NULL AS VARCHAR) AS parent_element, CAST(NULL AS VARCHAR) AS parent_id, 0 AS item_no, CAST(NULL AS VARCHAR) AS item_key, '' AS node_id"),
                           "entries": ("s", "e", "'document' AS parent_element, '' AS parent_id, CAST(i AS INTEGER) AS item_no, k AS item_key, node_id"),
                           "annotation": ("g", "n", "parent_element, parent_id, 0 AS item_no, item_key, node_id")}.get(element, ("c", "x", "parent_element, parent_id, CAST(i AS INTEGER) AS item_no, item_key, node_id"))
    value = "CASE json_type(x) WHEN 'VARCHAR' THEN x ->> '$' WHEN 'OBJECT' THEN NULL ELSE regexp_replace(CAST(x AS VARCHAR), ',', ', ', 'g') END"
    sql_type = {"string": "VARCHAR"}
    columns = [f"{value} AS value" if path == "value" else f"CAST({'j' if path == 'v' else item} ->> '$.{path}' AS {sql_type.get(t, t)}) AS \"{path.replace('.', '_')}\"" for path, t in DECLARED[element].items()]
    key = [] if element == "document" else ["entry_id AS entries_key"]
    where = f"f = '{element}'" if source == "c" else "true"
    return f"WITH {_NODES} SELECT raw_id, {', '.join([place, *key, *columns])} FROM {source} WHERE {where}"


_AT = "json_extract({0}, '$.' || chr(34) || {1} || chr(34))".format
_KIND = "CASE json_type({0}) WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'ARRAY' THEN 'list' WHEN 'OBJECT' THEN 'object' ELSE 'number' END".format
_CHANGES = f"""l AS MATERIALIZED (SELECT feed, file_name, exported_at, CAST(body AS JSON) AS j FROM annotation_feed WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
m AS (SELECT 'a' AS s, feed, file_name, exported_at, concat(j -> '$.id', j -> '$.entry') AS r, j, j -> '$.annotation' AS n FROM l),
w AS MATERIALIZED (SELECT feed, file_name, exported_at, CAST(body AS JSON) AS j FROM backlog_file WHERE json_valid(body) AND json_type(body) = 'OBJECT'),
w1 AS (SELECT * FROM (SELECT *, unnest(json_keys(j)) AS k FROM w) WHERE NOT starts_with(k, '_') AND json_type({_AT('j', 'k')}) <> 'NULL'),
w2 AS (SELECT *, {_AT('j', 'k')} AS v FROM w1),
w3 AS (SELECT feed, file_name, exported_at, k, r, {_AT('v', 'r')} AS v FROM (SELECT *, unnest(json_keys(v)) AS r FROM w2 WHERE json_type(v) = 'OBJECT')
UNION ALL SELECT feed, file_name, exported_at, k, x ->> '$.puzzle', x -> '$.count' FROM (SELECT *, unnest(CAST(v AS JSON[])) AS x FROM w2 WHERE json_type(v) = 'ARRAY')),
b AS (SELECT s, feed, file_name, exported_at, r, i, k, {_AT('x', 'k')} AS v FROM (SELECT *, unnest(json_keys(x)) AS k FROM (SELECT *, unnest(CAST(n -> '$.blocks' AS JSON[])) AS x, unnest(range(CAST(json_array_length(n, '$.blocks') AS BIGINT))) AS i FROM m WHERE json_type(n, '$.blocks') = 'ARRAY') WHERE json_type(x) = 'OBJECT')),
c AS (SELECT s, feed, file_name, exported_at, r, '' AS parent, k AS field, {_AT('j', 'k')} AS v, 0 AS i FROM (SELECT *, unnest(json_keys(j)) AS k FROM m) WHERE k NOT IN ('id', 'entry', 'annotation')
UNION ALL SELECT s, feed, file_name, exported_at, r, 'annotation', 'annotation.' || k, {_AT('n', 'k')}, 0 FROM (SELECT *, unnest(json_keys(n)) AS k FROM m WHERE json_type(n) = 'OBJECT') WHERE k <> 'blocks'
UNION ALL SELECT s, feed, file_name, exported_at, r, 'annotation.blocks', 'annotation.blocks.' || k, v, i FROM b
UNION ALL SELECT 'b', feed, file_name, exported_at, r, '', k, v, 0 FROM w3),
held AS (SELECT s, feed, file_name, r, parent, field, string_agg(DISTINCT i || ':' || CAST(v AS VARCHAR), ',' ORDER BY i || ':' || CAST(v AS VARCHAR)) AS val FROM c WHERE json_type(v) <> 'NULL' GROUP BY ALL),
kinds AS (SELECT s, feed, file_name, parent, field, list_sort(list(DISTINCT kind)) AS kinds FROM (SELECT s, feed, file_name, parent, field, (CASE s WHEN 'b' THEN 'count ' ELSE '' END) || {_KIND('v')} AS kind FROM c WHERE json_type(v) <> 'NULL' UNION ALL SELECT 'b', feed, file_name, '', k, {_KIND('v')} FROM w2) GROUP BY ALL),
records AS (SELECT DISTINCT s, feed, file_name, r FROM m UNION SELECT 'b', feed, file_name, r FROM w3),
files AS (SELECT DISTINCT s, feed, file_name, exported_at FROM m UNION SELECT 'b', feed, file_name, exported_at FROM w),
pairs AS (SELECT s, feed, file_name, lag(file_name) OVER (PARTITION BY s, feed ORDER BY exported_at, file_name) AS before FROM files),
added AS (SELECT p.s, p.feed, p.file_name, p.before, k.parent, k.field FROM pairs p JOIN kinds k USING (s, feed, file_name) WHERE before IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kinds o WHERE o.s = p.s AND o.feed = p.feed AND o.file_name = p.before AND o.field = k.field)),
removed AS (SELECT p.s, p.feed, p.file_name, p.before, k.parent, k.field FROM pairs p JOIN kinds k ON k.s = p.s AND k.feed = p.feed AND k.file_name = p.before WHERE NOT EXISTS (SELECT 1 FROM kinds o WHERE o.s = p.s AND o.feed = p.feed AND o.file_name = p.file_name AND o.field = k.field)),
common AS (SELECT p.s, p.feed, p.file_name, a.r FROM pairs p JOIN records a USING (s, feed, file_name) JOIN records z ON z.s = p.s AND z.feed = p.feed AND z.file_name = p.before AND z.r = a.r),
new AS (SELECT f.s, f.feed, f.file_name, f.parent, f.field, md5(string_agg(h.r || '=' || val, ';' ORDER BY h.r)) AS sig FROM added f JOIN held h USING (s, feed, file_name, parent, field) JOIN common q ON q.s = f.s AND q.feed = f.feed AND q.file_name = f.file_name AND q.r = h.r GROUP BY ALL),
old AS (SELECT f.s, f.feed, f.file_name, f.parent, f.field, md5(string_agg(h.r || '=' || val, ';' ORDER BY h.r)) AS sig FROM removed f JOIN held h ON h.s = f.s AND h.feed = f.feed AND h.file_name = f.before AND h.parent = f.parent AND h.field = f.field JOIN common q ON q.s = f.s AND q.feed = f.feed AND q.file_name = f.file_name AND q.r = h.r GROUP BY ALL),
renamed AS (SELECT n.s, n.feed, n.file_name, n.field, o.field AS old_name FROM new n JOIN old o USING (s, feed, file_name, parent, sig)),
retyped AS (SELECT p.s, p.feed, p.file_name, k.field FROM pairs p JOIN kinds k USING (s, feed, file_name) JOIN kinds o ON o.s = p.s AND o.feed = p.feed AND o.file_name = p.before AND o.field = k.field WHERE k.kinds <> o.kinds),
versions AS (SELECT s, feed, file_name, CAST(row_number() OVER (PARTITION BY s, feed ORDER BY exported_at, file_name) AS INTEGER) AS version FROM files)"""
_FOUND_CHANGES = """SELECT DISTINCT file_name, field AS field_name, 'renamed' AS change_kind, old_name FROM renamed
UNION SELECT file_name, field, 'added', '' FROM added a WHERE NOT EXISTS (SELECT 1 FROM renamed x WHERE x.s = a.s AND x.feed = a.feed AND x.file_name = a.file_name AND x.field = a.field)
UNION SELECT file_name, field, 'removed', '' FROM removed a WHERE NOT EXISTS (SELECT 1 FROM renamed x WHERE x.s = a.s AND x.feed = a.feed AND x.file_name = a.file_name AND x.old_name = a.field)
UNION SELECT file_name, field, 'retyped', '' FROM retyped"""
_SERIES = "CASE s WHEN 'a' THEN 'annotation_feed' ELSE 'backlog_file' END AS series"
_BITS = "CAST(list_sum(list_transform(kinds, lambda k: CASE split_part(k, ' ', -1) WHEN 'string' THEN 1 WHEN 'number' THEN 2 WHEN 'boolean' THEN 4 WHEN 'list' THEN 8 ELSE 16 END * CASE WHEN starts_with(k, 'count ') THEN 32 ELSE 1 END)) AS INTEGER) AS kinds"
#: Field names of each file by those of the file before it: renamed, carried on, or new; a new field whose name is another's first name is numbered.
_CHAINED = """x AS (SELECT s, feed, version, field, max(old_name) AS old_name FROM renamed JOIN versions USING (s, feed, file_name) GROUP BY ALL),
here AS (SELECT s, feed, version, field, coalesce(old_name, field) AS source FROM kinds JOIN versions USING (s, feed, file_name) LEFT JOIN x USING (s, feed, version, field)),
r(s, feed, version, field, first) AS (SELECT s, feed, version, field, field FROM here WHERE version = 1
UNION ALL SELECT s, feed, version, field, CASE WHEN carried IS NOT NULL THEN carried WHEN list_contains(list(carried) OVER (PARTITION BY s, feed), field) THEN field || '#' || version ELSE field END
FROM (SELECT h.s, h.feed, h.version, h.field, max(r.first) FILTER (r.field = h.source) AS carried FROM r JOIN here h ON h.s = r.s AND h.feed = r.feed AND h.version = r.version + 1 GROUP BY ALL)),
t AS (SELECT DISTINCT s, feed, first FROM retyped JOIN versions USING (s, feed, file_name) JOIN r USING (s, feed, version, field))"""
SQL = {
    "p3_found": f"WITH {_CHANGES} {_FOUND_CHANGES}",
    "p3_fingerprints": f"WITH {_CHANGES} SELECT {_SERIES}, feed, file_name, version, field AS field_name, {_BITS} FROM kinds JOIN versions USING (s, feed, file_name)",
    "p3_rules": f"WITH RECURSIVE {_CHANGES}, {_CHAINED} SELECT {_SERIES}, r.feed, file_name, r.version, field AS field_name, r.first AS first_name, t.first IS NOT NULL AS as_text FROM r JOIN versions USING (s, feed, version) LEFT JOIN t USING (s, feed, first)",
    "p1_found": f"WITH {_NODES} {_FOUND}",
    **{name: _table_sql(element) for name, element in TABLES.items()},
    "p2_found": f"WITH {_REFERENCES} SELECT * FROM p2",
    "p2_report": f"WITH RECURSIVE {_REFERENCES}, {_INHERITED} SELECT table_name, period, reason, count(*) AS n_references, count(DISTINCT row_key) AS n_rows FROM o GROUP BY 1, 2, 3",
    "p2_cascade": f"WITH RECURSIVE {_REFERENCES}, {_INHERITED} SELECT table_name, period, depth, count(DISTINCT row_key) AS n_rows, depth > 0 AS inherited FROM o GROUP BY 1, 2, 3",
}
