import unicodedata

import pyarrow as pa
import pytest
from hypothesis import given
from hypothesis import strategies as st

from cluemill.llm import looks, queries


@pytest.fixture(scope="module")
def table(spark):
    return looks.look_alikes(spark)


@pytest.fixture(scope="module")
def forms(table):
    return looks.Looks(table)


def test_look_alikes_of_many_scripts(table):
    for letter, latin in zip("АВЕЅІЈКМНОРСТУХаеѕіјорсухһԁԛԝѵӏΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϳՕօսհᎪᏴᏟⲞⲟꓐꓮԚ", "ABESIJKMHOPCTYXaesijopcyxhdqwvlABEZHIKMNOPTYXojOouhABCOoBAQ", strict=True):
        assert table[letter] == latin
    assert not {"ı", "ß", "é", "æ", "З", "α", "Ь", "ס"} & set(table)
    assert all(k.isupper() == v.isupper() for k, v in table.items() if k.isupper() or k.islower())


def test_same_look(forms):
    same = ["Café (6)", "Café (6)", "Ｃａｆé　（６）", "C​afé (6)", "Сafé\xa0(6)", "Caf͏é (6)️", " Café  (6)"]
    assert {forms.look_key(t) for t in same} == {"Café (6)"}
    assert forms.look_key("oﬃce") == "office" and forms.look_key("a‐b") == forms.look_key("a-b")
    assert forms.look_key("e͏́") == "é"


def test_visible_differences_stay(forms):
    for a, b in [("Café", "café"), ("Café", "Cafe"), ("’", "'"), ("–", "-"), ("“", '"'), ("x²", "x2"), ("½", "1/2"), ("①", "1"), ("𝐀", "A")]:
        assert forms.look_key(a) != forms.look_key(b)


def test_canonical_form_folds_case_and_shapes(forms):
    assert forms.canonical_form("ＳＴＲＡẞＥ x²") == forms.canonical_form("strasse X2")
    assert forms.canonical_form("") == forms.look_key("​ 　") == ""


@given(text=st.text(max_size=30))
def test_forms_are_stable(forms, text):
    for form in (forms.look_key, forms.canonical_form):
        once = form(text)
        assert form(once) == once and unicodedata.is_normalized("NFC", once)


@given(texts=st.lists(st.one_of(st.none(), st.text(max_size=12), st.text(st.sampled_from("aB \t\x1c\x00\x7f\r\n"), max_size=8)), max_size=6))
def test_columns_are_the_forms(forms, texts):
    values = pa.array(texts, pa.string())
    assert forms.column(values, "look").to_pylist() == [None if t is None else forms.look_key(t) for t in texts]
    assert forms.column(values, "form").to_pylist() == [None if t is None else forms.canonical_form(t) for t in texts]


def brute(rows, look_key):
    groups = {}
    for key, text in sorted((k, t) for k, t in rows if t is not None):
        if look_key(text):
            groups.setdefault(look_key(text), []).append((key, text))
    return {(g[0][0], k) for g in groups.values() for k, t in g if t != g[0][1]}


def test_query_is_brute_force(spark, data, forms):
    rows = [tuple(r) for t in ("clue_entry", "authored_clue") for r in spark.read.parquet(f"{data}/{t}.parquet").select("clue_id", "clue").collect()]
    got = [tuple(r) for r in queries.p5_found(spark, data).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, forms.look_key)


def test_nulls_repeats_hot_texts_and_empty(spark, texts):
    values = ["a b"] * 40 + ["a\xa0b"] * 40 + ["ａ b", None, "", "​", "A b"]
    got = {tuple(r) for r in looks.same_looks(texts(values), "doc_id", "text").collect()}
    assert got == {(0, n) for n in range(40, 81)}
    nameless = texts(["a b", "a\xa0b"]).selectExpr("IF(doc_id = 1, NULL, doc_id) AS doc_id", "text")
    assert looks.same_looks(nameless, "doc_id", "text").count() == 0
    assert looks.same_looks(texts([]), "doc_id", "text").count() == 0
