"""Merges, sessions, geometry, scoring, ordering, sources and sinks on literal rows."""

import datetime as dt
import itertools
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cluemill.functions import text
from cluemill.operators import activity, filling, geometry, lexicon, merge, ordering, rules, scoring, snapshots, topk
from cluemill.sources import readers, sinks

UPDATE = "who string, cell string, at bigint, value string, kind string"


def merged(spark, updates):
    df = spark.createDataFrame(updates, UPDATE)
    got = merge.last_writer_wins(df, ["who"], "cell", "at", "value", F.col("kind") == "del", F.col("kind") == "reset")
    return {(r.who, r.cell): (r.at, r.value, r.deleted) for r in got.collect()}


def test_merge_cases(spark):
    base = [("u", "1,1", 5, "A", "set"), ("u", "1,1", 7, "B", "set")]
    assert merged(spark, base) == {("u", "1,1"): (7, "B", False)}
    assert merged(spark, [*base, ("u", "1,1", 9, None, "del"), ("u", "1,1", 7, "B", "set")]) == {("u", "1,1"): (9, None, True)}
    assert merged(spark, [*base, ("u", "1,1", 7, None, "del")]) == {("u", "1,1"): (7, "B", False)}
    assert merged(spark, [*base, ("u", None, 8, None, "reset")]) == {}
    assert merged(spark, [*base, ("u", None, 7, None, "reset"), ("v", "1,1", 1, "C", "set")]) == {("u", "1,1"): (7, "B", False), ("v", "1,1"): (1, "C", False)}
    assert merged(spark, []) == {}


updates = st.lists(st.tuples(st.sampled_from(["u", "v"]), st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(0, 5)), st.sampled_from(["X", "Y", None]), st.sampled_from(["set", "del", "reset"])), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(rows=updates, data=st.data())
def test_merge_ignores_order_repeats_and_partitions(spark, rows, data):
    shuffled = data.draw(st.permutations(rows + rows[:3]))
    assert merged(spark, rows) == merged(spark, shuffled)


def test_three_way_reset_has_one_answer(spark):
    rows = [("u", "h", 100, "A", "set"), ("u", "g", 400, "B", "set"), ("u", None, 300, None, "reset")]
    assert all(merged(spark, list(p)) == {("u", "g"): (400, "B", False)} for p in itertools.permutations(rows))


def test_upsert_is_idempotent(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("c", "p", 3, 1, 10, None, t), ("c", "p", 5, 0, 7, t, t)], "sync_code string, puzzle string, letters_typed int, reveals_used int, active_ms bigint, solved_at timestamp_ntz, updated_at timestamp_ntz")
    once = merge.merge_saves(df, ["sync_code", "puzzle"])
    assert merge.upsert(once, df, ["sync_code", "puzzle"]).collect() == once.drop("n_pushes").collect()


def test_sessions_and_active_time(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, t + dt.timedelta(seconds=s), n) for n, s in enumerate((0, 10, 10, 400, 405))], "u int, ts timestamp, id int")
    got = activity.active_time(df, ["u"], "ts", "id", 300).first()
    assert (got.active_us, got.n_sessions) == (15_000_000, 2)
    assert activity.active_time(df.limit(0), ["u"], "ts", "id", 300).count() == 0


def test_gate_is_monotone_and_knows_nothing_without_readings(spark):
    df = spark.createDataFrame([(1, 1, None), (1, 2, 95.0), (1, 3, 20.0), (2, 1, 10.0)], "w int, at int, v double")
    got = {(r.w, r["at"]): r.verdict for r in activity.running_gate(df, "w", "at", "at", "v", 90.0).collect()}
    assert got == {(1, 1): "unknown", (1, 2): "over", (1, 3): "over", (2, 1): "under"}


def grid(spark):
    rows = [("g", "1-across", "across", 0, 0, 3, "CAT"), ("g", "1-down", "down", 0, 0, 3, "COD"), ("g", "9-down", "down", 2, 2, 1, "T"), ("g", "x", "down", 0, 0, 0, None), ("g", "y", "down", None, 0, None, None)]
    return spark.createDataFrame(rows, "p string, e string, direction string, pos_x int, pos_y int, n_cells int, solution string")


def test_cells_crossings_checking(spark):
    cells = geometry.cells(grid(spark), ["p", "e"])
    assert {(r.e, r.x, r.y, r.letter) for r in cells.collect()} == {("1-across", 0, 0, "C"), ("1-across", 1, 0, "A"), ("1-across", 2, 0, "T"), ("1-down", 0, 0, "C"), ("1-down", 0, 1, "O"), ("1-down", 0, 2, "D"), ("9-down", 2, 2, "T")}
    assert {(r.entry, r.other) for r in geometry.crossings(cells, "p", "e").collect()} == {("1-across", "1-down"), ("1-down", "1-across")}
    assert geometry.checking(cells, "p", "e").first().unchecked == pytest.approx((2 / 3 + 2 / 3 + 1) / 3, abs=1e-6)


def test_components_and_runs(spark):
    nodes = spark.range(8)
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 4), (4, 4)], "a bigint, b bigint")
    assert {(r.id, r.component) for r in geometry.components(nodes, edges).collect()} == {(0, 0), (1, 0), (2, 0), (3, 0), (4, 4), (5, 4), (6, 6), (7, 7)}
    runs = spark.createDataFrame([("k", n, n not in (3,)) for n in range(7)] + [("z", 0, False)], "k string, n int, f boolean")
    assert {(r.k, r.longest) for r in geometry.longest_runs(runs, ["k"], "n", "f").collect()} == {("k", 3), ("z", 0)}


def test_scores_drop_missing_components(spark):
    df = spark.createDataFrame([(1.0, 2.0), (3.0, None), (None, None)], "a double, b double")
    got = [r.score for r in scoring.weighted_z(df, scoring.baseline(df, ["a", "b"]), {"a": 0.5, "b": 0.5}).collect()]
    assert got[0] == pytest.approx(-0.353553, abs=1e-5) and got[1] == pytest.approx(0.707107, abs=1e-5) and got[2] is None


def test_percentile_and_spearman_with_ties(spark):
    df = spark.createDataFrame([(1, 10.0, 1.0), (2, 10.0, 2.0), (3, 20.0, 3.0), (4, None, 4.0), (5, 30.0, 5.0)], "id int, v double, w double")
    assert {r.id: r.percentile for r in scoring.percentile(df, "v").collect()} == {1: 0, 2: 0, 3: 67, 4: None, 5: 100}
    assert scoring.percentile(df.limit(1), "v").first().percentile is None
    assert scoring.spearman(df, "v", "w").first().rho == pytest.approx(0.948683)


def test_permutation_p_is_stable_and_small_for_far_samples(spark):
    a, b = [0.0, 0.1, 0.2, 0.1, 0.0, 0.2], [5.0, 5.1, 5.2, 5.1, 5.0, 5.2]
    first = scoring.permutation_p(spark, a, b, trials=1000).first().p
    assert first == scoring.permutation_p(spark, a, b, trials=1000).first().p and first < 0.02


def test_numbered_and_quantiles(spark):
    df = spark.range(100).select((F.lit(99) - F.col("id")).alias("v"))
    assert [r.position for r in ordering.numbered(df, [F.col("v")]).orderBy("v").collect()] == list(range(1, 101))
    assert ordering.numbered(df.limit(0), [F.col("v")]).count() == 0
    got = ordering.value_quantiles(df.withColumn("k", F.lit(1)), ["k"], "v", (0, 50, 100)).collect()
    assert {(r.percent, r.value) for r in got} == {(0, 0), (50, 50), (100, 99)}


def test_top_k_of_a_hot_key(spark):
    df = spark.range(200).select(F.when(F.col("id") < 150, "hot").otherwise("cold").alias("k"), "id")
    got = topk.top_k(df, ["k"], [F.col("id").desc()], 2).collect()
    assert {(r.k, r.id, r.place) for r in got} == {("hot", 149, 1), ("hot", 148, 2), ("cold", 199, 1), ("cold", 198, 2)}


def fits(pattern, words, fill):
    letters = {}
    for slot, word in zip(filling.slots(pattern), fill, strict=True):
        assert word in words and len(word) == len(slot)
        assert all(letters.setdefault(cell, letter) == letter for cell, letter in zip(slot, word))
    return len(set(fill)) == len(fill)


def test_fill_search_is_brute_force(spark):
    words = {w: n for n, w in enumerate("cat ace ten tea ant eat can nee ate tan net".split())}
    pattern = ("...", ".#.", "...")
    some = any(fits_quietly(pattern, words, x) for x in itertools.permutations(words, 4))
    found, nodes = filling.search(pattern, words, 1, 10_000)
    assert (found is not None) == some and (found is None or fits(pattern, words, found))
    square = {w: 1 for w in "bit ice ten".split()}
    assert filling.search(("...", "...", "..."), square, 1, 1_000)[0] is None  # each word would stand twice
    assert filling.search(("...",), {}, 1, 10)[0] is None and filling.search(("...",), {"CAT": 1, "né1": 2}, 1, 10)[0] is None
    assert filling.search(("...",), {"cat": 1, "dog": 2}, 1, 10, veto=lambda w: w == "dog")[0] == ["cat"]
    assert filling.search(("...",), words, 3, 50, restarts=5)[0] == filling.search(("...",), words, 3, 50, restarts=5)[0]
    for r in filling.fills(spark, ("...", "###", "..."), words, 3).collect():
        assert len(set(r.fill.split())) == 2 and r.least >= 0


def fits_quietly(pattern, words, fill):
    try:
        return fits(pattern, words, fill)
    except AssertionError:
        return False


def test_lexicon_operators(spark):
    words = spark.createDataFrame([(w,) for w in "sister sis ter late tale steal rat tar brat bat plate pate painter paint inter".split()], "word string")
    assert {(r.word, *r.pieces) for r in lexicon.piece_charades(words, 3).collect()} == {("sister", "sis", "ter")}
    assert ("late", "tale") in {tuple(r.words.split(",")) for r in lexicon.anagram_groups(words).collect()}
    assert {("rat", "tar"), ("tar", "rat")} <= {tuple(r) for r in lexicon.reversals(words, 3).collect()}
    assert {("brat", "bat"), ("brat", "rat"), ("plate", "late"), ("plate", "pate")} <= {tuple(r) for r in lexicon.deletions(words).collect()}
    assert ("steal", "late") in {tuple(r) for r in lexicon.near_anagrams(words).collect()}


def test_snapshots(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (4, "w")], "k int, v string")
    assert {(r.k, r.change) for r in snapshots.differences(a, b, ["k"], "v").collect()} == {(2, "changed"), (3, "removed"), (4, "added")}
    assert {(r.k, r.side) for r in snapshots.unmatched(a, b, ["k"]).collect()} == {(3, "left"), (4, "right")}
    assert {(r.k, r.v) for r in snapshots.carry_over(b, a, ["k"], ["v"]).collect()} == {(1, "x"), (2, "y"), (4, "w")}
    assert {(r.k, r.v) for r in snapshots.append_unseen(b.union(b), a, ["k"], ["v"]).collect()} == {(4, "w")}
    prints = [snapshots.fingerprint(x, ["k"], [F.col("v")]).collect() for x in (a, a.orderBy(F.col("k").desc()))]
    assert sorted(prints[0]) == sorted(prints[1])


def test_rules_fire_and_stay_quiet(spark):
    columns = "clue string, solution string, answer string, definition string, indicators array<string>, clue_type string, n_cells int"
    good = ("Odd cat stirred (3)", "ACT", "ACT", "Odd", ["stirred"], "anagram", 3)
    bad = ("<b>Act</b> acted up", "ACTED", "CATED!", "Foo", ["gone"], "anagram", 4)
    df = spark.createDataFrame([good, bad, (None,) * 7], columns)
    got = {r.code for r in rules.ENTRY_RULES.violations(df.where("clue LIKE '<b>%'"), ["clue"]).collect()}
    assert {"answer-differs", "length-differs", "definition-not-in-clue", "indicator-not-in-clue", "markup", "no-enumeration"} <= got
    assert rules.ENTRY_RULES.violations(df.where("clue LIKE 'Odd%'"), ["clue"]).count() == 0
    assert rules.ENTRY_RULES.firing_rates(df).count() == len(rules.ENTRY_RULES.rules)


def test_text_functions(spark):
    df = spark.createDataFrame([("  In  UP\t", "Foo (4,3-2)", "a-b-12")], "t string, c string, i string")
    r = df.select(text.term_key(F.col("t")).alias("t"), text.enumeration(F.col("c")).alias("e"), text.enumeration_breaks(text.enumeration_sizes(text.enumeration(F.col("c")))).alias("b"), text.split_id_tail(F.col("i"))[0].alias("h"), text.letter_key(F.lit("cab")).alias("k")).first()
    assert tuple(r) == ("in up", "4,3-2", [4, 7], "a-b", "abc")


def test_readers(spark, tmp_path):
    (tmp_path / "a-1.js").write_text("x\n/*JSON-START*/{\"id\": 1}/*JSON-END*/\ny")
    (tmp_path / "a-2.js").write_text("x /*JSON-START*/{\"id\"")
    (tmp_path / "index.js").write_text("{}")
    assert {(r.file_name, r.body) for r in readers.marked_documents(spark, str(tmp_path)).collect()} == {("a-1.js", '{"id": 1}'), ("a-2.js", None)}
    (tmp_path / "lex.tsv").write_text("#head\ncat\t5\t1\t2\tKAT\nbad\nét\t1\t1\t1\t\ndog\t9\t0\t1\t\n")
    assert {r.word for r in readers.lexicon(spark, str(tmp_path / "lex.tsv")).collect()} == {"cat", "dog"}
    assert {r.word for r in readers.lexicon(spark, str(tmp_path / "lex.tsv"), True).collect()} == {"cat"}
    (tmp_path / "ab.json").write_text(json.dumps({"abbreviations": {"A": ["one", "ace"], "B": []}}))
    assert {(r.key, r.word) for r in readers.pair_map(spark, str(tmp_path / "ab.json"), "abbreviations").collect()} == {("A", "one"), ("A", "ace")}
    (tmp_path / "back.json").write_text(json.dumps({"_why": "x", "fit": {"p-1": 3}}))
    assert [tuple(r) for r in readers.nested_counts(spark, str(tmp_path / "back.json")).collect()] == [("fit", "p-1", 3)]
    (tmp_path / "rows.jsonl").write_text('{"a": 1}\n{"a": \n{"a": 2}\n')
    assert {r.a for r in readers.tolerant_lines(spark, str(tmp_path / "rows.jsonl"), "a int").collect()} == {1, 2}
    (tmp_path / "grid.txt").write_text("#.\n..\n")
    assert {(r.r, r.c, r.is_block) for r in readers.grid_patterns(spark, str(tmp_path / "grid.txt")).collect()} == {(0, 0, True), (0, 1, False), (1, 0, False), (1, 1, False)}
    keys = spark.createDataFrame([("e:2024-01-02:open:u1",), ("s:x",)], "name string")
    assert [(str(r.day), r.event) for r in readers.event_keys(keys, "name").collect()] == [("2024-01-02", "open")]
    saves = spark.createDataFrame([("c", json.dumps({"v": 1, "puzzles": {"p": {"letters": {"1,1": "A"}, "updated": 5}}})), ("d", "{")], "code string, body string")
    assert [(r.code, r.puzzle_id, r.save.letters, r.save.updated) for r in readers.save_envelopes(saves, "code", "body").collect()] == [("c", "p", {"1,1": "A"}, 5)]
    (tmp_path / "feed.xml").write_text('<crossword><metadata><title>T</title></metadata><grid><cell x="1" y="1" solution="A"/></grid><word id="1" x="1-3" y="2"/><clues><clue word="1" number="4" format="3">Hi there</clue></clues></crossword>')
    row = readers.xml_feed(spark, str(tmp_path / "feed.xml")).first()
    assert (row.title, row.number, row.x, row.clue, [tuple(c) for c in row.cells]) == ("T", "4", "1-3", "Hi there", [(0, 1), (1, 1), (2, 1)])
    again = "<crossword>{}<word id='1' x='2' y='{}'/><clues><clue word='1' number='4'>one</clue><clue word='9' number='5'>none</clue></clues></crossword>"
    (tmp_path / "two.xml").write_text("<all>" + again.format("", 1) + again.format("<metadata><title>T</title></metadata>", 2) + "</all>")
    two = readers.xml_feed(spark, str(tmp_path / "two.xml"))
    assert {(r.title, r.clue, r.y, r.run_missing) for r in two.collect()} == {(None, "one", "1", False), (None, "none", None, True), ("T", "one", "2", False), ("T", "none", None, True)} and two.count() == 4
    assert readers.require(two.where("word = 1"), ~F.col("run_missing"), "no run").count() == 2
    with pytest.raises(Exception, match="no run"):
        readers.require(two, ~F.col("run_missing"), "no run").collect()
    html = spark.createDataFrame([("<i>A&amp;B</i>  c",), ("plain  x",)], "t string").select(readers.plain_text(F.col("t")).alias("t"))
    assert [r.t for r in html.collect()] == ["A&B c", "plain  x"]
    ids = spark.createDataFrame([("a-1",), ("b-1",), ("b-2",)], "id string")
    assert readers.find_one(ids, "id", "2").first().id == "b-2" and readers.find_one(ids, "id", "a-1").first().id == "a-1"
    assert readers.find_one(ids, "id", "77").count() == 0
    with pytest.raises(ValueError, match="ambiguous"):
        readers.find_one(ids, "id", "1")


def test_stores_lists_and_ranks(spark, tmp_path):
    (tmp_path / "index.json").write_text('{"v": 1, "puzzles": [{"id": "a-1"}, {"id": "b-2"}]}')
    assert [r.id for r in readers.index_manifest(spark, str(tmp_path / "index.json"), "id: string").collect()] == ["a-1", "b-2"]
    (tmp_path / "ranks.txt").write_text("# word rank\nthe 1\ncat 900\ntorn\n\n")
    assert {tuple(r) for r in readers.rank_file(spark, str(tmp_path / "ranks.txt")).collect()} == {("the", 1), ("cat", 900)}
    (tmp_path / "words.txt").write_text("Cat\n\ncat\ndog\n")
    assert {r.word for r in readers.first_word_file(spark, str(tmp_path / "none"), str(tmp_path / "words.txt")).collect()} == {"cat", "dog"}
    assert readers.first_word_file(spark, str(tmp_path / "none")).count() == 0
    listing = spark.createDataFrame([('warning: x\n[{"name": "e:2024-01-02:open:u"}, {"name": "s"}]',), ("[{",), ("none",), (None,)], "text string")
    assert [r.name for r in readers.key_listing(listing, "text").collect()] == ["e:2024-01-02:open:u", "s"]
    store = spark.createDataFrame([("ct:p-1", '{"letters": {"1,1": "A"}}'), ("ct:sync", "{}"), ("x", "{}"), ("ct:p-2", "{torn")], "k string, v string")
    assert [(r.puzzle_id, r.save.letters) for r in readers.local_store(store, "k", "v").collect()] == [("p-1", {"1,1": "A"})]
    odd = spark.createDataFrame([("e:2024-13-02:open:u",), ("e:2024-01-02::u",), ("e:2024-01-02:x",), (None,)], "name string")
    assert readers.event_keys(odd, "name").count() == 0
    swaps = spark.createDataFrame([("cats", "cat"), ("cats", "catty"), ("dog", "dogs")], "word string, other string")
    assert {tuple(r) for r in readers.family_roots(swaps).collect()} == {("cat", "cat"), ("cats", "cat"), ("catty", "cat"), ("dog", "dog"), ("dogs", "dog")}
    marked = spark.createDataFrame([("<p>a <i>b</i></p>",), ("x",)], "t string").select(readers.inner_markup(F.col("t")).alias("t"))
    assert [r.t for r in marked.collect()] == ["a <i>b</i>", None]


def test_more_readers(spark, tmp_path):
    pages = spark.createDataFrame([('<div data-x="{&quot;a&quot;: 3}">',), ("<div>",)], "html string")
    assert [r.data and r.data.a for r in readers.embedded_json(pages, "html", "data-x", "a int").collect()] == [3, None]
    assert pages.select(readers.escaped(F.lit('<&">')).alias("e")).first().e == "&lt;&amp;&quot;&gt;"
    words = spark.createDataFrame([("cat", 1, "K AE1 T"), ("cats", 2, ""), ("x", 3, ""), ("color", 4, "")], "word string, rank int, phone string")
    built = readers.build_lexicon(words, spark.createDataFrame([("color",)], "word string"), spark.createDataFrame([("cat", "cat"), ("cats", "cat")], "word string, root string"))
    assert {(r.word, r.gb, r.family, r.phone) for r in built.collect()} == {("cat", 1, 2, "K AE T"), ("cats", 1, 2, ""), ("color", 0, 1, "")}
    (tmp_path / "judge1.json").write_text('[{"answer": "A", "favourite": "x"}]')
    assert [(r.judge, r.answer) for r in readers.judge_files(spark, str(tmp_path), "answer string, favourite string").collect()] == [("1", "A")]
    assert readers.single_run(spark.createDataFrame([("r",), ("r",)], "run string")) == "r"
    for rows in ([("r",), ("s",)], [], [(None,)]):
        with pytest.raises(ValueError):
            readers.single_run(spark.createDataFrame(rows, "run string"))
    assert readers.latest_number(spark.createDataFrame([("a /s/12 /s/7 /t/99",)], "t string"), "t", "s").first().latest == 12
    assert [str(r.day) for r in readers.dates_back(spark, "2024-03-01", 2, 7).collect()] == ["2024-03-01", "2024-02-23"]


def test_sinks(spark, tmp_path):
    docs = spark.createDataFrame([("a-1", "a"), ("b-2", "b")], "id string, series string")
    sinks.write_documents(docs, str(tmp_path / "docs"), "id", "series")
    assert spark.read.json(str(tmp_path / "docs")).count() == 2
    with pytest.raises(ValueError):
        sinks.write_documents(docs.withColumn("series", F.lit("z")), str(tmp_path / "no"), "id", "series")
    built = []
    for _ in range(2):
        table = sinks.versioned(spark, str(tmp_path / "v"), 7, lambda: built.append(1) or docs)
    assert table.count() == 2 and built == [1]
    for _ in range(2):
        sinks.append_new(docs.union(docs), str(tmp_path / "log"), ["id"], ["series"])
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    assert sinks.write_if_changed(docs, str(tmp_path / "c")) and not sinks.write_if_changed(docs, str(tmp_path / "c"))
    assert not sinks.replace_unless_empty(docs.limit(0), str(tmp_path / "c"))
    assert sinks.content_stamps(spark, str(tmp_path / "c"), "*.parquet").count() >= 1
    assert sinks.bars(spark.createDataFrame([("a", 4), ("b", 2)], "n string, k int"), "n", "k", 4).collect()[0].line.endswith(" ####")
    assert sinks.site_rows(spark.createDataFrame([("a-1",)], "puzzle_id string"), "https://x", ["", "about"]).count() == 3


def test_replacements_never_lose_a_snapshot(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    sinks.replace(spark.read.parquet(path).where("id > 0"), path)
    assert {r.id for r in spark.read.parquet(path).collect()} == {1, 2}
    assert sinks.replace_unless_empty(spark.range(5), path) and not sinks.replace_unless_empty(spark.range(0), path)
    assert spark.read.parquet(path).count() == 5 and not sinks.write_if_changed(spark.read.parquet(path).orderBy(F.col("id").desc()), path)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["t"]
    first = sinks.write_round(spark.range(2), str(tmp_path / "r"), "a")
    assert sinks.write_round(spark.range(3), str(tmp_path / "r"), "b") != first == sinks.write_round(spark.range(2), str(tmp_path / "r"), "a")
    assert spark.read.parquet(str(tmp_path / "r/current")).count() == 2 and len(list((tmp_path / "r/archive").iterdir())) == 2


def test_documents_of_one_file(spark, tmp_path):
    index = spark.createDataFrame([("a-1", 2), ("b-2", 3), ("c-3", 1)], "id string, n int")
    text = lambda name: "".join(p.read_text() for p in sorted((tmp_path / name).glob("part*")))
    sinks.write_index(index, str(tmp_path / "index"), [F.col("n").desc()])
    assert [p["id"] for p in json.loads(text("index"))["puzzles"]] == ["b-2", "a-1", "c-3"]
    sinks.write_index(index, str(tmp_path / "script"), [F.col("n")], "window.X")
    assert text("script").startswith("window.X = {") and json.loads(text("script")[len("window.X = ") :].rstrip().rstrip(";"))["puzzles"][0]["id"] == "c-3"
    sinks.write_counts(spark.createDataFrame([("f", "p", 3), ("f", "q", 1), ("g", "p", 2)], "field string, id string, n int"), str(tmp_path / "counts"), "field", "id", "n")
    assert [json.loads(x) for x in text("counts").splitlines()] == [{"f": {"p": 3, "q": 1}}, {"g": {"p": 2}}]
    (tmp_path / "pages").mkdir()
    for name, body in (("same", "1"), ("old", "2"), ("extra", "3")):
        (tmp_path / "pages" / name).write_text(body)
    pages = spark.createDataFrame([("same", "1"), ("old", "new"), ("lacking", "4")], "n string, b string")
    assert {r.file_name for r in sinks.stale_pages(pages, str(tmp_path / "pages"), "n", "b").collect()} == {"old", "extra", "lacking"}
