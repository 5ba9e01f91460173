"""Annotation checks, spans and state operators on literal rows that the tables do not hold."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.operators import annotations as notes
from cluemill.operators import geometry, nested, scoring, state
from cluemill.plans import clues, problems
from cluemill.streaming import events as streams

T = dt.datetime(2024, 5, 1)


def gathered(spark, *entries):
    docs = spark.createDataFrame([(1, json.dumps({"entries": list(entries)}))], "raw_id bigint, body string")
    plan = nested.inline_plan(nested.element_graph(docs, "body", problems.PUZZLE_MODEL), problems.PUZZLE_MODEL, problems.DECLARED)
    return notes.gathered(nested.shred(docs, "raw_id", "body", problems.PUZZLE_MODEL, plan, ["entries", "annotation", *notes.PARTS]), "raw_id")


def entry(n, clue="Odd cat (3)", solution="ACT", **annotation):
    base = {"type": "anagram", "answer": "ACT", "definition": "cat", "indicators": ["Odd"], "indicatorNotes": {"Odd": "x"}, "anagram": {"fodder": "cat"}}
    return {"id": f"{n}-across", "clue": clue, "solution": solution, "annotation": {k: v for k, v in (base | annotation).items() if v is not None}}


def test_each_rule_fires_alone(spark):
    block = {"clueFragment": "cat", "gives": "ACT", "note": "n"}
    cases = {
        "type-part-unknown": {"type": "anagram + magic"}, "answer-differs": {"answer": "TAC"}, "definition-not-in-clue": {"definition": "dog"}, "link-word-not-in-clue": {"linkWords": ["by"]},
        "fragment-not-in-clue": {"blocks": [block | {"clueFragment": "dog"}]}, "fodder-differs": {"anagram": {"fodder": "cab"}}, "pieces-differ": {"pieces": ["A", "C"]},
        "hidden-not-found": {"type": "hidden word"}, "no-assembly": {"anagram": None}, "heard-without-gives": {"type": "homophone", "blocks": [{"clueFragment": "cat", "soundsLike": "akt"}]},
        "heard-is-written": {"type": "homophone", "blocks": [block | {"soundsLike": "act"}]}, "heard-without-type": {"blocks": [block | {"soundsLike": "akt"}]}, "type-without-heard": {"type": "homophone"},
        "sub-anagram-differs": {"subAnagrams": [{"fodder": "AB", "gives": "AC"}]}, "sub-reversal-differs": {"subReversals": [{"from": "AB", "to": "AB"}]},
        "note-without-indicator": {"indicatorNotes": {"Odd": "x", "more": "y"}}, "indicator-without-note": {"indicatorNotes": None}, "blocks-differ": {"blocks": [block | {"gives": "AB"}]},
        "blocks-undivided": {"pieces": ["A", "CT"], "blocks": [block]}, "blocks-misordered": {"type": "charade", "blocks": [block | {"gives": "CT"}, block | {"gives": "A"}]}, "block-without-note": {"blocks": [block | {"note": " "}]},
        "field-missing": {"definition": None}, "indicator-not-in-clue": {"indicators": ["Even"], "indicatorNotes": {"Even": "x"}},
    }
    rows = gathered(spark, entry(0), *[entry(n, **case) for n, case in enumerate(cases.values(), 1)])
    got = {}
    for r in notes.ANNOTATION_RULES.violations(rows, ["entry_id"]).collect():
        got.setdefault(int(r.entry_id.split("-")[0]), set()).add(r.code)
    assert got == {n: {code} for n, code in enumerate(cases, 1)}


def test_caps_count_puzzles_faults(spark):
    rows = spark.createDataFrame([(p, c) for p, c, n in ((1, "blocks-differ", 3), (2, "blocks-differ", 2), (1, "blocks-misordered", 1), (1, "answer-differs", 9)) for _ in range(n)], "raw_id int, code string")
    assert {tuple(r) for r in notes.over_cap(rows, "raw_id").collect()} == {(1, "blocks-differ", 3), (1, "blocks-misordered", 1)}


def test_device_cost(spark):
    costs = [("anagram", ["x"], [], 0.30), ("charade", [], ["AB", "CDE", "F"], 0.45 + 0.06 + 0.09 + 0.12), ("double definition", [], [], 0.55), ("&lit + deletion + charade", [], [], 1.0), ("odd", ["x"], ["A-", "BCD"], 0.56)]
    rows = spark.createDataFrame([(k, i, p) for k, i, p, _ in costs] + [(None, [], []), (" + ", [], [])], "kind string, indicators array<string>, pieces array<string>")
    got = [r.c for r in rows.select(notes.device_cost(F.col("kind"), F.col("indicators"), F.col("pieces")).alias("c")).collect()]
    assert got == [pytest.approx(c) for *_, c in costs] + [None, None]


def test_retold_explanations(spark):
    blocks = [{"clueFragment": "cat", "gives": "AC"}, {"clueFragment": "cat", "gives": "T O"}]
    walks = ["AC goes before TO", "AC, the standard sign, before TO", "AC and TO", "AC alone", None]
    rows = gathered(spark, *[entry(n, walkthrough=w, blocks=blocks) for n, w in enumerate(walks)])
    assert {(r.entry_id, r["rank"], tuple(r.hits)) for r in notes.renarrated(rows, ["entry_id"]).collect()} == {(f"{n}-across", n, ("AC", "TO")) for n in range(3)}


def test_fodder_is_found_and_widened(spark, monkeypatch):
    rows = gathered(spark, entry(1, clue="Very odd bedsore very (8)", anagram={"fodder": "BEDSORE V"}), entry(2, clue="a-b aab (3)", anagram={"fodder": "AB"}), entry(3, anagram={"fodder": ""}))
    monkeypatch.setattr(clues.annotations, "_notes", lambda *_: rows)
    got = {(r.entry_id[0], r.starts, r.ends) for r in clues.fodder_spans(spark, "").collect()}
    assert got == {("1", 9, 21), ("2", 0, 3), ("2", 4, 7)}


def test_text_functions_of_clues(spark):
    one = lambda f, value: spark.createDataFrame([(value,)], "t string").select(f(F.col("t")).alias("x")).first().x
    assert one(text.clue_words, "He’s won't they'd 'tis (3,4)") == ["he", "'s", "wo", "'t", "they", "'d", "'tis"]
    assert one(text.base_forms, "cries") == ["crie", "cri", "cry"] and one(text.base_forms, "gas") == [] and one(text.base_forms, None) == []
    assert one(text.anchor, " Él & Co. 9 ") == "l-co-9" and one(text.tidy_words, "A <b>big</b> Cat (3)") == ["a", "big", "cat"]
    assert [tuple(x) for x in one(text.placed_tokens, " a  bc, d (3)")] == [(1, "a"), (4, "bc,"), (8, "d")] and one(text.placed_tokens, "") == []
    pair = spark.createDataFrame([("aaa", "aa"), ("abc", "x"), ("a", ""), ("", "a")], "t string, p string")
    assert [r.x for r in pair.select(text.occurrences(F.col("t"), F.col("p")).alias("x")).collect()] == [[0, 1], [], [], []]


def test_regions_and_cuts(spark):
    rows = [("g", x, y) for x, y in ((0, 0), (1, 0), (1, 1), (3, 3), (3, 4))] + [("h", 5, 5)]
    lit = spark.createDataFrame(rows, "grid string, x int, y int")
    got = {(r.grid, r.x, r.y): r.region for r in geometry.regions(lit, "grid").collect()}
    assert got["g", 0, 0] == got["g", 1, 1] == 0 and got["g", 3, 3] == got["g", 3, 4] != 0 and len(got) == 6
    assert {tuple(r) for r in geometry.through_cuts(lit, "grid").collect()} == {("g", 1)}
    assert geometry.regions(lit.limit(0), "grid").count() == 0


def test_as_of_takes_the_newest_within_reach(spark):
    at = lambda h: T + dt.timedelta(hours=h)
    readings = spark.createDataFrame([("a", at(0), 1.0), ("a", at(5), 2.0), ("a", at(5), 3.0), ("a", at(30), 4.0), (None, at(1), 9.0)], "k string, at timestamp_ntz, v double")
    asked = spark.createDataFrame([(1, "a", at(4)), (2, "a", at(5)), (3, "a", at(28)), (4, "a", at(30)), (5, "a", at(80)), (6, "b", at(6)), (7, None, at(2)), (8, "a", at(-1))], "n int, k string, at timestamp_ntz")
    got = {r.n: r.reading for r in state.as_of(asked, readings, ["k"], "at", "v", 86_400).collect()}
    assert got == {1: 1.0, 2: 3.0, 3: 3.0, 4: 4.0, 5: None, 6: None, 7: 9.0, 8: None}


def test_resets_roll_once(spark):
    rows = spark.createDataFrame([(50, 100), (150, 100), (95, 100), (100, 100), (None, 100)], "r bigint, now bigint")
    at, derived = state.rolled_reset(F.col("r"), F.col("now"), 30)
    assert [tuple(r) for r in rows.select(at, derived).collect()] == [(None, None), (150, False), (125, True), (130, True), (None, None)]


def test_only_changes_are_pushed(spark):
    mine = spark.createDataFrame([("a", 1), ("b", None), ("c", 3), ("d", None)], "k string, v int")
    remote = spark.createDataFrame([("a", 1), ("b", 2), ("d", None)], "k string, v int")
    assert {r.k for r in state.to_push(mine, remote, ["k"], ["v"]).collect()} == {"b", "c"}
    assert {r.k for r in state.unsealed(mine, remote, ["k"]).collect()} == {"c"}


def test_saves_stream_in_any_order(spark, tmp_path):
    schema = "sync_code string, puzzle string, letters_typed int, reveals_used int, active_ms bigint, solved_at timestamp_ntz, updated_at timestamp_ntz"
    rows = [("s", "p", 3, 0, 5, None, T), ("s", "p", 9, 1, 4, T, T), ("s", "q", 1, 0, 1, None, T), ("s", "p", 2, 0, 9, None, T + dt.timedelta(days=9))]
    for n, r in enumerate(rows):
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.puzzle, r.letters_typed, r.reveals_used, r.active_ms, r.solved_at, r.updated_at) for r in streams.merge_stream(stream, ["sync_code", "puzzle"]).collect()}
    assert got == {("p", 9, 1, 9, T, T + dt.timedelta(days=9)), ("q", 1, 0, 1, None, T)}


def test_markup_becomes_text_and_ranges(spark):
    values = ["a <i>bc</i> d<em class='x'>e</em>", "plain & <", "<i></i>x", None, "<b>q</b></i>"]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(text.flat_markup(F.col("t")).alias("x")).collect()
    got = [None if r.x is None else (r.x.text, [tuple(i) for i in r.x.italics]) for r in rows]
    assert got == [("a bc de", [(2, 2), (6, 1)]), ("plain & <", []), ("x", []), None, ("q", [])]


def test_first_sentences(spark):
    values = ["One. Two.", "What?! Yes", "no stop", "3.5 is. It", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(text.first_sentence(F.col("t")).alias("x")).collect()
    assert [r.x for r in rows] == ["One.", "What?!", "no stop", "3.5 is.", "", None]


def test_permutation_of_any_statistic(spark):
    spread = lambda a, b: a.std() - b.std()
    far = scoring.permutation_of(spark, [0.0] * 12, [-9.0, 9.0] * 6, spread, 2_000).first()
    near = scoring.permutation_of(spark, [1.0, 2.0, 3.0], [1.5, 2.5, 3.5], spread, 2_000).first()
    assert far.p < 0.01 < near.p and far.statistic == 9.0
    assert scoring.permutation_of(spark, [], [1.0], spread, 10).first().p == pytest.approx(1 / 11)


def test_long_bodies_are_left_out(spark):
    rows = spark.createDataFrame([("view", "x" * 32), ("view", "é" * 17), ("view", None), ("odd", "x")], "event_type string, props string")
    assert streams.known(rows, ("view",)).count() == 2
