import base64

import numpy as np
import public_tokenizers
import sentencepiece
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cluemill.llm import counting, packing, queries

NAMES = ["byte_bpe_50k", "byte_bpe_multi_50k", "piece_bpe_32k", "word_bpe_49k"]


def libraries():
    def byte_level(name):
        with open(public_tokenizers.path(name), "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    words = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    words.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    return [byte_level("byte_bpe_50k.tiktoken"), byte_level("byte_bpe_multi_50k.tiktoken"), pieces.encode, lambda t: words.encode(t, add_special_tokens=False).ids]


def counter():
    files = {}
    for name in NAMES:
        path = counting.tokenizer_file(name, None)
        with open(path, "rb") as file:
            files[name] = (path.rpartition(".")[2], file.read())
    return counting.TextCounter(files)


def test_counts_of_odd_texts(odd):
    count, libs = counter(), libraries()
    for text in filter(None, odd):
        assert count.texts([text]).tolist() == [[len(encode(text)) for encode in libs]], ascii(text[:40])


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aB'st  \n\r\té1漢▁.,-"), min_size=1, max_size=40))
def test_counts_are_the_libraries(text):
    global _COUNTER, _LIBS
    if "_COUNTER" not in globals():
        _COUNTER, _LIBS = counter(), libraries()
    assert _COUNTER.texts([text]).tolist() == [[len(encode(text)) for encode in _LIBS]]


def test_counts_of_the_table(spark, data):
    libs = libraries()
    docs = spark.read.parquet(f"{data}/documents.parquet")
    got = {r.doc_id: tuple(r)[1:] for r in counting.token_counts(docs, "doc_id", "text", NAMES).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == tuple(len(encode(r.text)) if r.text else 0 for encode in libs)


def test_rule_takes_the_least_sum_of_squares():
    rng, capacity = np.random.default_rng(1), 12
    sizes = rng.integers(1, capacity + 1, 300).tolist()
    window, _ = packing.sum_of_squares(sizes, capacity)
    fills: list[int] = []
    for s, w in zip(sizes, window.tolist()):
        def total(change):
            levels = np.bincount([f for f in change if f < capacity], minlength=capacity)
            return int((levels[1:] ** 2).sum())

        ways = [total([*fills[:k], fills[k] + s, *fills[k + 1 :]]) for k in range(len(fills)) if fills[k] + s <= capacity] + [total([*fills, s])]
        fills = [*fills, 0] if w == len(fills) else fills
        fills[w] += s
        assert total(fills) == min(ways)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 30), max_size=120), st.integers(30, 60))
def test_packing_is_valid_and_tight(sizes, capacity):
    sizes = np.array(sizes, np.int64)
    window = packing.pack(sizes, capacity)
    fill = np.bincount(window, weights=sizes) if len(sizes) else np.zeros(0)
    assert (fill <= capacity).all() and (fill > 0).all()
    assert len(fill) <= max(2 * -(-sizes.sum() // capacity), 1)


def placed(df):
    return [tuple(r) for r in df.collect()]


def test_query_keeps_every_text(spark, data):
    budgets = {r.budget_id: r for r in spark.read.parquet(f"{data}/packet_budget.parquet").collect()}
    docs = spark.read.parquet(f"{data}/documents.parquet")
    counts = {r.doc_id: r for r in counting.token_counts(docs, "doc_id", "text", NAMES).collect()}
    rows = queries.p7_packets(spark, data).collect()
    fill, parts = {}, {}
    for r in rows:
        fill[r.budget_id, r.packet_no] = fill.get((r.budget_id, r.packet_no), 0) + r.n_tokens
        parts.setdefault((r.budget_id, r.doc_id), []).append(r)
    assert len(parts) == len(budgets) * len(counts)
    for (b, _), n in fill.items():
        assert n <= budgets[b].capacity_tokens
    for (b, d), own in parts.items():
        n, capacity = counts[d][budgets[b].tokenizer], budgets[b].capacity_tokens
        assert sum(r.n_tokens for r in own) == n
        assert sorted(r.part_no for r in own) == list(range(len(own))) and len(own) == max(1, -(-n // capacity))
    for r in queries.p7_fill(spark, data).collect():
        assert r.n_packets <= r.fewest * 1.05 + 2


def test_nulls_splits_and_shards(spark):
    sizes = spark.createDataFrame([(None, 3), (1, None), (2, 0), (3, 25), (4, 20), (5, 7)] + [(n, 4) for n in range(10, 60)], "key bigint, t int")
    got = placed(packing.packets(sizes, "key", [(1, "t", 10), (2, "t", None)], 56, shard_items=20))
    assert {r[0] for r in got} == {1} and len({r[1] >> 32 for r in got}) > 1
    assert sorted(r[4] for r in got if r[2] == 3) == [5, 10, 10] and sorted(r[4] for r in got if r[2] == 4) == [10, 10]
    assert [r[4] for r in got if r[2] in (1, 2)] == [0, 0] and [r[4] for r in got if r[2] is None] == [3]
    assert packing.packets(sizes.limit(0), "key", [(1, "t", 10)], 0).count() == 0


def test_report_of_both_rules(spark, data):
    rows = queries.p7_fill(spark, data).collect()
    assert len(rows) == 6 and all(r.fewest <= r.n_packets <= r.n_online and r.fullest <= r.capacity_tokens for r in rows)
