import random

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cluemill.llm import queries, tokens

NAME = "byte_bpe_50k.tiktoken"


@pytest.fixture(scope="module")
def encoder():
    with open(tokens.tokenizer_path(NAME), "rb") as file:
        return tokens.Encoder(file.read())


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def streamed(encoder, text, sizes):
    stream, ids, at = tokens.StreamEncoder(encoder), [], 0
    while at < len(text):
        n = next(sizes)
        ids += stream.feed(text[at : at + n])
        at += n
    return ids + stream.finish()


def test_lookahead_is_finite_and_covers_the_longest_token(encoder):
    assert max(map(len, encoder.ranks)) // 2 <= encoder.lookahead < 5000


def test_lookahead_of_a_small_list():
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258}
    assert tokens.sufficient_lookahead(ranks) == 2
    assert tokens.merge(b"abc", ranks) == [b"abc"] and tokens.merge(b"bcbc", ranks) == [b"bc", b"bc"]


def test_all_texts_of_the_table(spark, data, encoder, library):
    ids = {r.doc_id: r.ids for r in queries.p6_ids(spark, data).collect()}
    rows = spark.read.parquet(f"{data}/documents.parquet").collect()
    assert len(ids) == len(rows)
    for r in rows:
        assert ids[r.doc_id] == (library(r.text) if r.text else [])


def test_odd_texts(odd, encoder, library):
    rng = random.Random(5)
    for text in filter(None, odd):
        want = library(text)
        assert list(encoder.ids(text)) == want
        assert streamed(encoder, text, iter(lambda: rng.choice([1, 2, 3, 9, 500]), None)) == want


@settings(max_examples=60, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab'stll 1\n\té漢🙂-_"), max_size=80), size=st.integers(1, 7))
def test_streaming_is_whole_encoding(encoder, library, text, size):
    assert streamed(encoder, text, iter(lambda: size, None)) == library(text)


def test_memory_is_bounded(encoder):
    stream, most = tokens.StreamEncoder(encoder), 0
    for _ in range(300):
        stream.feed("qzx" * 100)
        most = max(most, len(stream.held) + len(stream.open))
    assert most < encoder.window + 1000


def test_long_white_space(encoder, library):
    for run in (" " * 4_000, "\n \t" * 1_500, " " * 3_999 + "\n"):
        for text in (run, run + "x", "a" + run + "'ll b" + run, run + "1 " + run + "\n\n"):
            for size in (1_000, 3_900, 5_000):
                assert streamed(encoder, text, iter(lambda: size, None)) == library(text)


def test_memory_does_not_grow_with_the_text(encoder):
    stream, most = tokens.StreamEncoder(encoder), 0
    for part in ("it's a clue, and " * 900, " " * 15_000, "\n\t " * 5_000, "qzx" * 5_000, "-=" * 8_000, "7" * 15_000, "é漢" * 4_000) * 25:
        for at in range(0, len(part), 1_000):
            stream.feed(part[at : at + 1_000])
            most = max(most, len(stream.held) + len(stream.open))
    assert most < 2 * encoder.window


def test_decoder_is_the_way_back(encoder, odd):
    table = [b""] * (max(encoder.ranks.values()) + 1)
    for token, rank in encoder.ranks.items():
        table[rank] = token
    for text in filter(None, odd):
        decoder = tokens.StreamDecoder(table)
        assert "".join(decoder.feed([i]) for i in encoder.ids(text)) + decoder.finish() == text
    for broken in (b"\xff", b"\xe6\xbc", b"\xe6x", b"\xf0\x9f\x99", b"\xc0\x80", b"\xed\xa0\x80"):
        decoder = tokens.StreamDecoder(table)
        got = decoder.feed([encoder.ranks[bytes([b])] for b in broken]) + decoder.finish()
        assert got == broken.decode("utf-8", "replace")


def test_round_trip_query(spark, data):
    assert queries.p6_round_trip(spark, data).where("NOT same").count() == 0


def test_nulls_and_empty_table(texts):
    got = {r.doc_id: r.ids for r in tokens.encode(texts([None, "", "a"]), "doc_id", "text", NAME).collect()}
    assert got[0] == got[1] == [] and len(got[2]) == 1
    assert tokens.encode(texts([]), "doc_id", "text", NAME).count() == 0


def test_query_encodes_in_chunks_of_bounded_size(spark, data):
    with open(tokens.tokenizer_path("byte_bpe_50k.tiktoken"), "rb") as file:
        encoder = tokens.Encoder(file.read())
    seen, find = [], encoder.find
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").select("text").where("text <> ''").collect()]
    texts += ["it's " * 20_000, "qzx" * 30_000, "a " + "1" * 9_000 + "'ll  \n x" * 50, " " * 5_000 + "x"]
    whole = [list(encoder.ids(text)) for text in texts]
    encoder.find = lambda text: seen.append(len(text)) or find(text)
    for chunk in (7, tokens.CHUNK):
        for text, ids in zip(texts if chunk > 7 else [x[:3_000] for x in texts[::40]], whole if chunk > 7 else [list(encoder.ids(x[:3_000])) for x in texts[::40]]):
            assert [i for own in tokens.stream_ids(encoder, text, chunk) for i in own] == ids
    seen.clear()
    list(tokens.stream_ids(encoder, "it's fun " * 50_000))
    assert max(seen) < tokens.CHUNK + encoder.window + 1_000
