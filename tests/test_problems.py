"""Problems 1 to 3 against plain Python, on the smallest data and on literal rows."""

import datetime as dt
import json

import brute
import pytest
from pyspark.sql import functions as F

from cluemill.operators import drift, nested, orphans, skew, snapshots
from cluemill.plans import problems


def rows(spark, data, name):
    return [r.asDict() for r in spark.read.parquet(f"{data}/{name}.parquet").collect()]


def found(df):
    got = [tuple(r) for r in df.collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_p1_is_brute_force(spark, data):
    assert found(problems.p1_found(spark, data)) == brute.p1([(r["raw_id"], r["body"]) for r in rows(spark, data, "puzzle_file")])


def test_p2_is_brute_force(spark, data):
    want = brute.p2(*[rows(spark, data, t) for t in ("puzzle_index", "clue_entry", "authored_clue", "play_save")])
    assert found(problems.p2_found(spark, data)) == want


def test_p3_is_brute_force(spark, data):
    assert found(problems.p3_found(spark, data)) == brute.p3(rows(spark, data, "annotation_feed"), rows(spark, data, "backlog_file"))


MODEL = problems.PUZZLE_MODEL


def shredded(spark, *bodies, wanted=("entries", "annotation")):
    docs = spark.createDataFrame(list(enumerate(bodies)), "raw_id bigint, body string")
    plan = nested.inline_plan(nested.element_graph(docs, "body", MODEL), MODEL, wanted)
    return nested.shred(docs, "raw_id", "body", MODEL, plan), plan


def test_p1_shapes_and_gaps(spark):
    block = {"gives": "A", "note": None}
    bodies = [
        None, "", "not found", '{"entries": [', "[]", "3", '{"entries": null}',
        json.dumps({"entries": [None, {"id": "1-across", "annotation": {"blocks": [None, block], "pieces": "AB"}}]}),
        "x /*JSON-START*/ " + json.dumps({"puzzle": {"entries": {"2-down": {"annotation": json.dumps({"blocks": block})}}}}) + " /*JSON-END*/ y",
        "﻿" + json.dumps({"entries": [{"number": 3, "direction": "down", "annotation": {}}], "annotations": {"3-down": {"type": "x"}}}),
        "/*JSON-START*/ {}",
        json.dumps({"entries": [], "annotations": {"3-down": {"type": "x", "blocks": [block]}}}), '{"entries": [{"id": "1-across", "length": NaN}]}',
        json.dumps({"annotations": {"4-down": {"type": "x"}}, "entries": [{"id": "4-down"}]}),
    ]
    got, _ = shredded(spark, *bodies, wanted=("entries", "annotation", "blocks", "pieces"))
    seen = {(r.raw_id, r.element, r["keys"].get("entries"), r.item_no) for r in got.collect() if r.element in problems.NODE_KINDS and (r.element != "annotation" or r.has_fields)}
    assert seen == {
        (7, "entries", "1-across", 1), (7, "annotation", "1-across", 0), (7, "blocks", "1-across", 1), (7, "pieces", "1-across", 0),
        (8, "entries", "2-down", 0), (8, "annotation", "2-down", 0), (8, "blocks", "2-down", 0),
        (9, "entries", "3-down", 0), (9, "annotation", "3-down", 0), (13, "entries", "4-down", 0), (13, "annotation", "4-down", 0),
    }


def test_p1_inlining_rules():
    at = nested.OBJECT
    edges = [("document", "a", False, at), ("a", "b", False, at), ("document", "c", True, nested.LIST), ("c", "s", False, at), ("a", "s", False, at), ("c", "r", False, at), ("r", "r", False, at)]
    edges += [("b", "k", False, nested.WHOLE), ("a", "k", False, nested.WHOLE | nested.FLOAT), ("c", "k", False, nested.TEXT | nested.WHOLE), ("r", "k", False, nested.BOOLEAN)]
    plan = nested.inline_plan(edges, nested.DocumentModel(), ["w"])
    assert plan.reasons == {"document": "root", "c": "repeated", "s": "shared", "r": "shared", "w": "wanted"}
    assert plan.columns["document"] == {"a.b.k": "bigint", "a.k": "double"} and plan.columns["c"] == {"k": "string"} and plan.columns["r"] == {"k": "boolean"}
    assert nested.inline_plan([("document", "r", False, at), ("r", "q", False, at), ("q", "r", False, at)], nested.DocumentModel()).reasons["q"] == "recursive"


def test_p1_children_keep_their_parents(spark):
    got, _ = shredded(spark, json.dumps({"entries": [{"id": "1-across", "position": {"x": 1}, "annotation": {"blocks": [{"gives": "A"}]}}]}))
    by_id = {(r.element, r.node_id): r for r in got.collect()}
    for r in by_id.values():
        assert r.parent_id is None or (r.parent_element, r.parent_id) in by_id
    assert next(r for r in by_id.values() if r.element == "entries").attributes["position.x"] == "1"


def test_p1_names_that_are_data_are_refused(spark, monkeypatch):
    monkeypatch.setattr(nested, "MAX_EDGES", 20)
    with pytest.raises(ValueError, match="edges"):
        shredded(spark, json.dumps({f"k{n}": n for n in range(30)}))


def test_p1_every_table_of_the_plan(spark, data):
    tables = problems.puzzle_tables(spark, data)
    assert set(problems.DECLARED) <= set(tables)
    entries = tables["entries"]
    assert dict(entries.dtypes)["number"] == "bigint" and entries.where("number IS NULL OR clue IS NULL").count() == 0
    blocks = tables["blocks"].join(tables["annotation"].withColumnRenamed("node_id", "a"), (F.col("a") == tables["blocks"].parent_id) & (tables["annotation"].raw_id == tables["blocks"].raw_id), "left_anti")
    assert blocks.count() == 0


def test_p1_empty_table(spark):
    assert shredded(spark)[0].count() == 0


T = dt.datetime(2024, 5, 1)
DAY = dt.timedelta(days=1)
REFS = "table_name string, row_key bigint, field_name string, ref_value string, target string, ref_key string, at timestamp_ntz"
TARGETS = "target string, ref_key string, loaded_at timestamp_ntz, removed_at timestamp_ntz"


def reasons(spark, stays, times):
    refs = spark.createDataFrame([("t", n, "f", "k", "p", "k", t) for n, t in enumerate(times)], REFS)
    got = orphans.direct_orphans(refs, spark.createDataFrame([("p", "k", a, b) for a, b in stays], TARGETS))
    return {r.row_key: r.reason for r in got.collect()}


def test_p2_reasons(spark):
    times = [T - DAY, T, T + DAY, T + 2 * DAY, None]
    assert reasons(spark, [], times) == dict.fromkeys(range(5), "missing")
    assert reasons(spark, [(T, None)], times) == {0: "late"}
    assert reasons(spark, [(T, T + DAY)], times) == {0: "late", 2: "deleted", 3: "deleted"}
    assert reasons(spark, [(T, T + DAY), (T + 2 * DAY, None)], times) == {0: "late", 2: "deleted"}
    assert reasons(spark, [(T, T + DAY), (T, T + 3 * DAY)], times) == {0: "late"}
    assert reasons(spark, [(None, None)], times) == {}


def test_p2_null_keys_and_hot_key(spark, monkeypatch):
    refs = spark.createDataFrame([("t", n, "f", None if n % 3 else "hot", "p", None if n % 3 else "hot", T) for n in range(300)], REFS)
    monkeypatch.setattr(skew.heavy_keys, "__kwdefaults__", {"least": 10})
    assert len(skew.heavy_keys(refs.where("ref_key is not null"), "target", "ref_key")) == 1
    got = orphans.direct_orphans(refs, spark.createDataFrame([("p", "other", T, None)], TARGETS))
    assert got.count() == 100
    assert orphans.direct_orphans(refs, spark.createDataFrame([("p", "hot", T, None), ("p", "hot", T - DAY, None)], TARGETS)).count() == 0
    assert orphans.direct_orphans(refs, spark.createDataFrame([("p", "hot", T - DAY, T)], TARGETS)).where("reason = 'deleted'").count() == 100
    assert skew.heavy_keys(refs.limit(0), "target", "ref_key") == []


OWN = REFS + ", own_target string, own_key string"


def linked(spark, *pairs):
    """References of the rows n to the keys k, of entries that are themselves k{n}."""
    return spark.createDataFrame([("e", n, "link", k, "entry", k, T, "entry", f"k{n}") for n, k in pairs], OWN)


def test_p2_cascade_goes_to_the_fixpoint(spark):
    refs = linked(spark, *[(n, f"k{n - 1}") for n in range(6)], (5, "k5"), (9, "k9"))
    targets = spark.createDataFrame([("entry", f"k{n}", T, None) for n in (*range(6), 9)], TARGETS)
    got = {(r.row_key, r.depth, r.reason) for r in orphans.cascade(refs, targets, ["entry"]).collect()}
    assert got == {(n, n, "inherited" if n else "missing") for n in range(6)}
    assert {r.row_key for r in orphans.cascade(refs, targets, ["entry"], 2).collect()} == {0, 1, 2}


def test_p2_cascade_ends_in_a_circle(spark):
    refs = linked(spark, (0, "gone"), *[(n, f"k{(n + 1) % 3}") for n in range(3)])
    got = {(r.row_key, r.depth) for r in orphans.cascade(refs, spark.createDataFrame([("entry", f"k{n}", T, None) for n in range(3)], TARGETS), ["entry"]).collect()}
    assert got == {(0, 0), (2, 1), (1, 2)}


def line(n, annotation, **fields):
    return json.dumps({"id": "p", "entry": f"{n}-down", "annotation": annotation, **fields})


def drifted(spark, *files, reader="lines"):
    data = [("f", f"file{n}", T + n * DAY, body) for n, bodies in enumerate(files) for body in bodies]
    df = spark.createDataFrame(data, "feed string, file_name string, exported_at timestamp_ntz, body string")
    return drift.records(df, "s", reader, values=True)


def named(df):
    return {(r.file_name, r.field_name, r.change_kind, r.old_name) for r in df.collect()}


def test_p3_kinds_of_change(spark):
    cells = drifted(
        spark,
        [line(1, {"a": "x", "blocks": [{"g": 1}, {"g": None}]}, rev=1), line(1, {"a": "x", "blocks": [{"g": 1}, {"g": None}]}, rev=1), "{torn"],
        [line(1, {"b": "x", "blocks": [{"h": 1}, {}]}, rev="1", more=None), None, ""],
        [line(2, {"c": "x"}, new=[1])],
    )
    assert named(drift.changes(cells)) == {
        ("file1", "annotation.b", "renamed", "annotation.a"), ("file1", "annotation.blocks.h", "renamed", "annotation.blocks.g"), ("file1", "rev", "retyped", ""),
        ("file2", "annotation.b", "removed", ""), ("file2", "annotation.c", "added", ""), ("file2", "annotation.blocks.h", "removed", ""), ("file2", "rev", "removed", ""), ("file2", "new", "added", ""),
    }


def test_p3_chained_renames_reach_the_first_name(spark):
    cells = drifted(spark, [line(1, {"a": "x"})], [line(1, {"b": "x"})], [line(1, {"c": "x"}), line(2, {"c": "y"}), line(2, {"c": "z"})])
    table = drift.unified(cells, drift.changes(cells)).collect()
    assert {f for r in table for f in r.fields} == {"annotation.a"} and {r.version for r in table} == {1, 2, 3}
    assert sorted(r.fields["annotation.a"] for r in table) == ['"x"', '"x"', '"x"', '"y"']


def test_p3_casts_and_defaults(spark):
    cells = drifted(spark, [line(1, {"a": 3}, more=1), line(2, {"a": 4})], [line(1, {"b": 3}), line(2, {"b": 4})], [line(1, {"b": '3 "x'}, k="s")])
    table = {(r.version, r.fields["annotation.a"], r.fields["more"], r.fields["k"]) for r in drift.unified(cells, drift.changes(cells)).collect()}
    assert table == {(1, "3", "1", None), (1, "4", None, None), (2, "3", None, None), (2, "4", None, None), (3, '3 "x', None, '"s"')}


def test_p3_conflicts_are_counted(spark):
    cells = drifted(spark, [line(1, {"a": "y", "c": 1}), line(1, {"a": "x", "c": 1}), line(1, {"b": "z"}), *[line(2, {"a": "x"})] * 3])
    table = {r.entry: r for r in drift.unified(cells, drift.changes(cells)).collect()}
    assert table["1-down"].conflicts == 1 and table["1-down"].fields == {"annotation.a": '"x"', "annotation.b": '"z"', "annotation.c": "1"}
    assert table["2-down"].conflicts == 0 and table["2-down"].fields["annotation.a"] == '"x"' and len(table) == 2


def test_p3_a_name_that_comes_back_is_another_field(spark):
    cells = drifted(spark, [line(1, {"a": "x"})], [line(1, {"b": "x"})], [line(1, {"b": "x", "a": "y"})])
    table = {r.version: r.fields for r in drift.unified(cells, drift.changes(cells)).collect()}
    assert table[3]["annotation.a"] == '"x"' and table[3]["annotation.a#3"] == '"y"' and table[1]["annotation.a#3"] is None


def test_p3_allowances(spark):
    cells = drifted(spark, ['{"_why": "x", "a": {"p1": 3, "p2": 4}}'], ['{"b": [{"puzzle": "p1", "count": 3}]}'], ['{"b": {"p1": "3"}}'], reader="allowances")
    assert named(drift.changes(cells)) == {("file1", "b", "renamed", "a"), ("file2", "b", "retyped", "")}


def test_p3_unnamed_files_are_ignored(spark):
    rows = [("f", None, T, line(1, {"a": 1})), (None, "x", T, line(1, {"b": 1})), ("f", "y", None, line(1, {"c": 1})), ("f", "z", T, None)]
    df = spark.createDataFrame(rows, "feed string, file_name string, exported_at timestamp_ntz, body string")
    assert drift.records(df, "s", "lines").count() == 0


def test_p3_nothing_readable(spark):
    assert named(drift.changes(drifted(spark, ["{"], [None]))) == set()


def test_latest_row_wins_with_ties_and_clashing_names(spark):
    data = [(1, "x", T, 1, "_row"), (1, "x", T, 2, "new"), (1, "x", None, 3, "old"), (None, "x", T, 4, "null")]
    df = spark.createDataFrame(data, "k int, e string, at timestamp_ntz, id int, `term` string")
    got = {(r.k, r.term) for r in snapshots.latest_rows(df, ["k", "e"], ["at", "id"]).collect()}
    assert got == {(1, "new"), (None, "null")}


@pytest.mark.parametrize("name", ["p1_schema_graph", "p3_annotations", "p3_allowances", "p3_fingerprints", "p3_rules"])
def test_other_queries_run(spark, data, name):
    assert problems.QUERIES[name](spark, data).count() > 0
