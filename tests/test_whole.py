"""Queries do the whole job: nothing of their input is left out."""

import datetime as dt
import itertools
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cluemill.operators import drift, filling, lexicon, scoring
from cluemill.plans import corpus, puzzles, wordplay


def test_grid_fill_searches_all_words_and_not_by_the_clock(spark, data, monkeypatch):
    words = ["".join(x) for x in itertools.islice(itertools.product("abcdefghij", repeat=4), 3000)]
    ranked = spark.createDataFrame([(w, n, 50) for n, w in enumerate(words, 1)], "word string, rank bigint, familiarity int")
    monkeypatch.setattr(wordplay.corpus_plans, "word_familiarity", lambda *_: ranked)
    seen = {}
    monkeypatch.setattr(filling, "fills", lambda spark, pattern, words, seeds, **limits: seen.update(limits, pattern=pattern, words=words))
    wordplay.grid_fill(spark, data)
    assert set(seen["words"]) == set(words)
    assert "max_nodes" not in seen
    assert all(a == b[::-1] for a, b in zip(seen["pattern"], seen["pattern"][::-1]))


def test_perm_pvalue_weighs_every_puzzle_alike(spark, data, monkeypatch):
    month = 31 * 86_400_000
    rows = [("cryptic", 0, (1.0,)), ("cryptic", 1, (1.0,)), ("cryptic", month, (4.0,)), ("quiptic", 0, (0.0,)), ("quiptic", 1, (3.0,)), ("quiptic", None, (3.0,)), ("cryptic", 2, None)]
    index = spark.createDataFrame(rows, "series string, published_ms bigint, difficulty struct<score: double>")
    monkeypatch.setattr(puzzles, "_index", lambda *_: index)
    assert puzzles.perm_pvalue(spark, data).first().difference == pytest.approx(0.0)


def test_permutation_of_counts_is_the_test_over_all_splits(spark):
    a, b = [0.0, 1.0, 1.0, 3.0, 3.0], [1.0, 2.0, 4.0, 5.0]
    every, seen = [*a, *b], abs(np.mean(a) - np.mean(b))
    splits = [set(x) for x in itertools.combinations(range(9), 5)]
    exact = np.mean([abs(np.mean([every[k] for k in x]) - np.mean([every[k] for k in range(9) if k not in x])) >= seen - 1e-12 for x in splits])
    assert scoring.permutation_p(spark, a, b).first().p == pytest.approx(exact, abs=0.02)


WORDS = "to day today in side inside insides so on soon no net ten tent often of tin tint lived delivered so at oat boat bat tattoo too tat aint ordinary extra".split()


@pytest.fixture
def words(spark):
    return spark.createDataFrame([(w,) for w in sorted(set(WORDS))], "word string")


def test_charades_take_two_letters_and_three_pieces(words):
    known = set(WORDS)
    want = {(w, (w[:i], w[i:])) for w in known for i in range(2, len(w) - 1) if {w[:i], w[i:]} <= known}
    want |= {(w, (w[:i], w[i:j], w[j:])) for w in known for i in range(2, len(w)) for j in range(i + 2, len(w) - 1) if {w[:i], w[i:j], w[j:]} <= known}
    got = lexicon.piece_charades(words, 2).collect()
    assert {(r.word, tuple(r.pieces)) for r in got} == want and len(got) == len(want)
    assert {("today", ("to", "day")), ("inside", ("in", "side"))} <= want


def test_three_pieces(spark):
    df = spark.createDataFrame([(w,) for w in "sotoon so to on".split()], "word string")
    assert [(r.word, r.pieces) for r in lexicon.piece_charades(df, 2).collect()] == [("sotoon", ["so", "to", "on"])]


def test_containers_take_two_letters(words):
    known = set(WORDS)
    want = {(w, w[:i] + w[j:], w[i:j]) for w in known for i in range(1, len(w) - 1) for j in range(i + 2, len(w)) if {w[:i] + w[j:], w[i:j]} <= known}
    assert {(r.word, r.outer, r.inner) for r in lexicon.containers(words, 2, 2).collect()} == want != set()


def test_neighbours_reversed_parts_and_phones(spark, words):
    known = set(WORDS)
    assert {("bat", "boat"), ("boat", "bat"), ("at", "oat"), ("oat", "at")} <= {tuple(r) for r in lexicon.neighbours(words).collect()}
    parts = {(w, w[i:j], w[i:j][::-1]) for w in known for i in range(len(w)) for j in range(i + 4, len(w) + 1) if j - i < len(w) and w[i:j] != w[i:j][::-1] and w[i:j][::-1] in known}
    assert {tuple(r) for r in lexicon.reversed_parts(words, 4).collect()} == parts
    more = spark.createDataFrame([("undevilish",), ("lived",)], "word string")
    assert {tuple(r) for r in lexicon.reversed_parts(more, 4).collect()} == {("undevilish", "devil", "lived")}
    phones = spark.createDataFrame([("sea", "S IY"), ("see", "S IY"), ("tea", "T IY"), ("x", ""), ("y", ""), ("z", None)], "word string, phone string")
    assert [tuple(r) for r in lexicon.homophones(phones).collect()] == [("S IY", 2, "sea,see")]


def test_anagrams_with_an_abbreviation(spark):
    df = spark.createDataFrame([(w,) for w in "earth rate tear hat teeth".split()], "word string")
    short = spark.createDataFrame([("h",), ("he",), ("ee",), ("ray",)], "abbreviation string")
    assert {tuple(r) for r in lexicon.abbreviation_anagrams(df, short).collect()} == {("earth", "h", "rate"), ("earth", "h", "tear")}
    df = spark.createDataFrame([(w,) for w in "tea teapots pots".split()], "word string")
    assert {tuple(r) for r in lexicon.abbreviation_anagrams(df, spark.createDataFrame([("aet",), ("st",)], "abbreviation string")).collect()} == {("teapots", "aet", "pots")}
    with pytest.raises(Exception, match="too long"):
        lexicon.abbreviation_anagrams(df, spark.createDataFrame([("abcd",)], "abbreviation string")).collect()


def test_phone_keys(spark):
    pairs = [("knight", "night"), ("phone", "fone"), ("write", "rite"), ("cell", "sell"), ("lamb", "lam"), ("sea", "see")]
    df = spark.createDataFrame([(w,) for p in pairs for w in p], "word string").select("word", lexicon.phone_key(F.col("word")).alias("k"))
    keys = {r.word: r.k for r in df.collect()}
    assert all(keys[a] == keys[b] for a, b in pairs) and len(set(keys.values())) == len(pairs)


def test_lexicon_has_two_to_fifteen_letters(spark, tmp_path):
    text = "to in into extraordinarily responsibility a antidisestablish characteristic"
    spark.createDataFrame([(n, text, "en", len(text)) for n in range(3)], "doc_id int, text string, lang string, n_chars int").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.word for r in corpus.word_familiarity(spark, str(tmp_path)).collect()} == {"to", "in", "into", "extraordinarily", "responsibility", "characteristic"}
    scores = {r.word: r.hooks for r in wordplay.clueability(spark, str(tmp_path)).collect()}
    assert "C" in scores["into"] and len(scores) == 6


def test_built_once_sees_new_files(spark, tmp_path):
    from cluemill.session import built_once

    path = str(tmp_path / "t.parquet")
    made = []
    build = lambda: made.append(1) or spark.read.parquet(path)
    spark.range(3).write.parquet(path)
    assert built_once(spark, path, "x", build).count() == built_once(spark, path, "x", build).count() == 3 and len(made) == 1
    spark.range(5).write.mode("overwrite").parquet(path)
    assert built_once(spark, path, "x", build).count() == 5 and len(made) == 2


def table_of(spark, reader, *bodies):
    at = dt.datetime(2024, 1, 1)
    rows = [("f", f"file{n}", at + n * dt.timedelta(days=1), body) for n, body in enumerate(bodies)]
    cells = drift.records(spark.createDataFrame(rows, "feed string, file_name string, exported_at timestamp_ntz, body string"), "s", reader, values=True)
    return drift.unified(cells, drift.changes(cells)).collect()


def test_p3_tables_keep_the_keys_of_lines_and_lines_without_values(spark):
    rows = table_of(spark, "lines", json.dumps({"id": 'p "1', "entry": "1-down", "k": 3}), json.dumps({"id": 7, "entry": None, "k": None}), json.dumps({"entry": "é"}))
    assert {(r.version, r.id, r.entry, r.puzzle, r.fields["k"]) for r in rows} == {(1, 'p "1', "1-down", None, "3"), (2, "7", None, None, None), (3, None, "é", None, None)}
    assert len(rows) == 3
    bare = table_of(spark, "lines", json.dumps({"id": "p", "entry": "e"}))
    assert [(r.id, r.entry, r.fields) for r in bare] == [("p", "e", {})]


def test_p3_tables_keep_puzzles_and_plain_values_of_allowances(spark):
    rows = table_of(spark, "allowances", '{"a": {"p-1": 3, "p-2": null}, "b": 4.50, "c": [1, "x"], "d": [{"puzzle": "p-1", "count": 5}]}')
    got = {(r.puzzle, r.id): r.fields for r in rows}
    none = dict.fromkeys("abcd")
    assert got == {("p-1", None): none | {"a": "3", "d": "5"}, ("p-2", None): none, (None, None): none | {"b": "4.50", "c": '[1, "x"]'}}
