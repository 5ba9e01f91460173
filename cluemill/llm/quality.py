"""Per-document text quality statistics with a line-labelling hidden Markov model (problem 8).

Every non-blank line becomes one observation of nine discrete statistics (share of common words, layout, end
punctuation, letter plausibility, broken characters, words per item, repetition, company, inner marks). The most likely
sequence of the states prose, list, table and junk labels the lines; documents of a batch are decoded together, line by
line. ``text_quality`` gives one row per document: the statistics, each label's share of the characters, and the kind.

A document's kind depends on its text alone: the model's parameters are fixed values, learned once by ``fitting`` with
the Baum-Welch algorithm, and letter plausibility comes from the vocabulary of a public tokenizer (``letter_model``).
No statistic looks at a part of a line or leaves a line out by its size.

Defined results: a null, empty or blank text has no lines, zero counts, null shares and no kind. A line break is any of
CR, LF, VT, FF, NEL, LS and PS; blank lines are no observations. Zero-width characters count nowhere. Texts of any
length are read whole; only one batch of them is held at a time. Letters of scripts other than the Latin one say
nothing about plausibility, nor do their words about common words; in scripts without spaces two letters count as a word
where words per item are asked for.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from cluemill.llm.batching import text_slices
from cluemill.llm.tokens import read_ranks, tokenizer_path

STATES = ("prose", "list", "table", "junk")
BREAK = re.compile("[\r\n\v\f\x85  ]+")
LETTER, DIGIT, SPACE, STOP, PUNCT, SYMBOL, BROKEN, NOTHING, NEWLINE = range(1, 10)
SYMBOLS = 64  # letters of the bigram model: a to z, other Latin letters folded by code point, 0 for a word's border and letters of other scripts
#: The model's parameters, from fitting.fit. Rows are states, columns the values of a statistic.
START = np.array([0.6529, 0.1642, 0.09548, 0.08747])
STAY = np.array([0.95, 0.95, 0.95, 0.95])
#: no words; 1-3 words without and with common ones; 4 and more words by share of common ones: 0, <.1, <.2, <.3, more; words of another script
P_COMMON = np.array([
    [0.00326, 0.01742, 0.02459, 0.00401, 0.00675, 0.02877, 0.09635, 0.8156, 0.00323],
    [0.01004, 0.6897, 0.08828, 0.05692, 0.04022, 0.04085, 0.04122, 0.02944, 0.00335],
    [0.2805, 0.2667, 0.05191, 0.1998, 0.06541, 0.06181, 0.04869, 0.02164, 0.00363],
    [0.05771, 0.07449, 0.01077, 0.3098, 0.2945, 0.1547, 0.07278, 0.02283, 0.00239],
])
#: none, bullet or number, glossary or answer item, run of items, cells, grid, markup, hexadecimal
P_LAYOUT = np.array([
    [0.9613, 0.01375, 0.00325, 0.00647, 0.00409, 0.00032, 0.00115, 0.00032],
    [0.2147, 0.5354, 0.1862, 0.05714, 0.00335, 0.00067, 0.00067, 0.00033],
    [0.02257, 0.00363, 0.00363, 0.00752, 0.6845, 0.2712, 0.00364, 0.00181],
    [0.5574, 0.00548, 0.00477, 0.01473, 0.0112, 0.00477, 0.1828, 0.2189],
])
#: ends without and with end punctuation
P_END = np.array([
    [0.318, 0.6821],
    [0.87, 0.13],
    [0.9513, 0.04872],
    [0.8842, 0.1158],
])
#: mean log probability of the letters: no pairs, good, middling, bad; letters of another script
P_LETTERS = np.array([
    [0.00395, 0.7973, 0.1917, 0.00384, 0.00323],
    [0.02664, 0.5993, 0.3127, 0.05803, 0.00335],
    [0.3104, 0.4192, 0.2254, 0.04135, 0.00363],
    [0.09848, 0.07147, 0.2319, 0.5934, 0.00477],
])
LETTER_CUTS = (-3.15, -2.62)
#: share of broken characters: up to .01, up to .04, up to .1, more
P_BROKEN = np.array([
    [0.995, 0.0049, 6e-05, 1e-06],
    [0.993, 0.00669, 0.0003, 3e-05],
    [0.9924, 0.00725, 0.00033, 4e-05],
    [0.5508, 0.07308, 0.1186, 0.2576],
])
BROKEN_CUTS = (0.01, 0.04, 0.1)
#: words per item: up to 3, up to 8, more
P_ITEM = np.array([
    [0.0388, 0.127, 0.8342],
    [0.8518, 0.1279, 0.02029],
    [0.6718, 0.2732, 0.05496],
    [0.1291, 0.1732, 0.6977],
])
#: none; at most three different words, each four times on average; most letters in words of more than LONG_WORD letters; the same line not long before or after
P_REPEAT = np.array([
    [0.9981, 3e-05, 0.00029, 0.00161],
    [0.9812, 7e-05, 0.00027, 0.01845],
    [0.9335, 0.00831, 0.00029, 0.05791],
    [0.7954, 0.05336, 0.05584, 0.09541],
])
LONG_WORD = 45
#: whether the line has company: other lines or several items; a line without any is no list and no table
P_COMPANY = np.array([
    [0.8597, 0.1403],
    [0.9998, 0.00017],
    [0.9997, 0.00028],
    [0.8402, 0.1598],
])
#: marks between the words of a line (comma, stop and the like before a space): none, some; a run of items
P_INNER = np.array([
    [0.2806, 0.7162, 0.00324],
    [0.7946, 0.1449, 0.06048],
    [0.9453, 0.04717, 0.00752],
    [0.7067, 0.2786, 0.01473],
])
TABLES = ("P_COMMON", "P_LAYOUT", "P_END", "P_LETTERS", "P_BROKEN", "P_ITEM", "P_REPEAT", "P_COMPANY", "P_INNER")
#: a document with at least this share of prose is prose
PROSE_SHARE = 0.5

BULLET = re.compile(r"\s*(?:[-*+•–—·▪◦‣>o]|\(?\d{1,4}[.):]|\(?[a-z][.)]|\[[ xX✓]?\])\s+\S")
ITEM = re.compile(r"\s*(?:[^\W\d_]+ = [^\W_]{1,12}|[^\W\d_]+ \(\d[\d, -]*\)|\d{1,3} (?:across|down|ac|dn|Across|Down|Ac|Dn)\.? [^\W\d_]+|[^\W\d_]+: [^\W\d_]+ [^\W\d_]+\.?|\d{1,3} (?:across|down|ac|dn|Ac|Dn))\s*$")
MARKUP = re.compile(r"\s*<[/a-zA-Z!][^>]*>")
HEX = re.compile(r"\s*0x[0-9a-fA-F]+\b|\s*(?:[0-9a-fA-F]{2} ){6}")
GRID = re.compile(r"\s*+(?:[A-Z.#■□_*01-]\s?+){5,}+\s*+$")
GRID_SIGN = re.compile("[.#■□_*-].*[.#■□_*-]")


@lru_cache(1)
def _tables() -> tuple[np.ndarray, ...]:
    """Class, lower case, bigram symbol, whether it is Latin and whether its script has no spaces, of each code point up to U+FFFF; U+FFFF stands for all above."""
    latin, dense = np.zeros(0x10000, bool), np.zeros(0x10000, bool)
    kinds = np.full(0x10000, SYMBOL, np.uint8)
    lower = np.arange(0x10000, dtype=np.uint32)
    symbol = np.zeros(0x10000, np.uint8)
    for cp in range(0xD800):
        ch = chr(cp)
        category = unicodedata.category(ch)
        if category[0] == "L" or category == "Mn" or category == "Mc":
            kinds[cp] = LETTER
            latin[cp] = category[0] == "M" or "LATIN" in unicodedata.name(ch, "") or ch in "ªº"
            dense[cp] = unicodedata.name(ch, "").startswith(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "THAI", "LAO", "KHMER", "MYANMAR"))
            low = ch.lower()
            if len(low) == 1 and ord(low) < 0x10000:
                lower[cp] = ord(low)
        elif category[0] == "N" and cp not in (0xB2, 0xB3, 0xB9, 0xBC, 0xBD, 0xBE):
            kinds[cp] = DIGIT
        elif category == "Zs" or ch == "\t":
            kinds[cp] = SPACE
        elif category == "Cf":
            kinds[cp] = NOTHING
        elif category in ("Cc", "Cn", "Co") or 0x80 <= cp <= 0xBF and ch not in "\xa0¡«·»¿°":
            kinds[cp] = BROKEN
        elif category[0] == "P":
            kinds[cp] = PUNCT
    kinds[0xFFFD] = BROKEN
    kinds[0xFE00:0xFE10] = NOTHING
    kinds[0xFEFF] = NOTHING
    kinds[10] = NEWLINE
    for ch in ".!?…。！？":
        kinds[ord(ch)] = STOP
    letters = (kinds == LETTER) & latin
    symbol[letters] = 27 + lower[letters] % 37
    ascii_letters = letters & (lower >= 97) & (lower <= 122)
    symbol[ascii_letters] = lower[ascii_letters] - 96
    return kinds, lower, symbol, latin, dense


def _code_points(text: str) -> np.ndarray:
    return np.minimum(np.frombuffer(text.encode("utf-32-le"), np.uint32), 0xFFFF)


#: Tokenizer whose vocabulary letter_model counts, and the rank at which a token weighs half as much as the first.
VOCABULARY, HALF_RANK = "byte_bpe_multi_50k.tiktoken", 500
WORD_TOKEN = re.compile(r" ?[a-zà-öø-ÿœ]+")


def letter_model(content: bytes) -> np.ndarray:
    """Log probability of each symbol after each symbol, from the words and beginnings of words in a public tokenizer's vocabulary.

    The vocabulary (content of its rank file) covers many languages and is ordered by frequency, so a token counts by
    its rank. It is the same for every run, so a document's kind does not depend on the others.
    """
    symbol, counts = _tables()[2], np.zeros(SYMBOLS * SYMBOLS)
    for token, rank in read_ranks(content).items():
        text = token.decode("utf-8", "ignore")
        if WORD_TOKEN.fullmatch(text) and len(text) > 1:
            s = symbol[_code_points(text)].astype(np.int64)
            np.add.at(counts, s[:-1] * SYMBOLS + s[1:], 1 / (rank + HALF_RANK))
    table = (counts / counts.sum() * 1e5 + 0.5).reshape(SYMBOLS, SYMBOLS)
    return np.log(table / table.sum(axis=1, keepdims=True))


def _prefix_hashes(n: int, base: int = 0x9E3779B97F4A7C15) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    inverse = pow(base, -1, 1 << 64)
    with np.errstate(over="ignore"):
        up = np.cumprod(np.full(n, base, np.uint64))
        down = np.cumprod(np.full(n, inverse, np.uint64))
    return up, down


def word_hash(words: Iterable[str]) -> np.ndarray:
    words = list(words)
    up, _ = _prefix_hashes(max(map(len, words), default=0) + 1)
    out = []
    for word in words:
        codes = np.array([min(ord(c), 0xFFFF) for c in word.lower()], np.uint64) + np.uint64(1)
        out.append((codes * up[: len(codes)]).sum(dtype=np.uint64) if len(codes) else np.uint64(0))
    return np.sort(np.array(out, np.uint64))


def _line_statistics(lines: list[str], model: np.ndarray, common: np.ndarray) -> dict[str, np.ndarray]:
    kinds_table, lower_table, symbol_table, latin_table, dense_table = _tables()
    cp = _code_points("\n".join(lines) + "\n")
    kinds = kinds_table[cp]
    if (kinds == NOTHING).any():
        cp = cp[kinds != NOTHING]
        kinds = kinds_table[cp]
    ends = np.flatnonzero(kinds == NEWLINE)
    starts = np.concatenate([[0], ends[:-1] + 1])

    def per_line(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return total[ends] - total[starts]

    letter = kinds == LETTER
    before = np.concatenate([[False], letter[:-1]])
    after = np.concatenate([letter[1:], [False]])
    # words: runs of letters; hashed by differences of a running sum, made equal for equal words by the inverse power
    word_from = np.flatnonzero(letter & ~before)
    word_to = np.flatnonzero(before & ~letter)
    lower = lower_table[cp]
    up, down = _prefix_hashes(len(cp) + 1)
    with np.errstate(over="ignore"):
        running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(np.where(letter, (lower.astype(np.uint64) + np.uint64(1)) * up[: len(cp)], np.uint64(0)), dtype=np.uint64)])
        hashes = (running[word_to] - running[word_from]) * np.where(word_from > 0, down[np.maximum(word_from - 1, 0)], np.uint64(1))
    at = np.searchsorted(common, hashes)
    is_common = (common[np.minimum(at, len(common) - 1)] == hashes) if len(common) else np.zeros(len(hashes), bool)
    word_line = np.searchsorted(ends, word_from)
    n = len(lines)
    words = np.bincount(word_line, minlength=n)
    order = np.lexsort((hashes, word_line))
    of, what = word_line[order], hashes[order]
    new = np.concatenate([[True], (of[1:] != of[:-1]) | (what[1:] != what[:-1])]) if len(of) else np.zeros(0, bool)
    distinct = np.bincount(of[new], minlength=n)
    long = word_to - word_from > LONG_WORD
    in_long = np.bincount(word_line[long], weights=(word_to - word_from)[long], minlength=n)
    n_common = np.bincount(word_line[is_common], minlength=n)
    word_chars = np.bincount(word_line, weights=word_to - word_from, minlength=n)

    symbol = symbol_table[cp].astype(np.int64)
    latin = letter & latin_table[cp]
    pair = latin[1:] & latin[:-1] | latin[1:] & (kinds[:-1] == SPACE)
    scores = np.concatenate([[0.0], np.where(pair, model[symbol[:-1], symbol[1:]], 0.0)])
    total = np.concatenate([[0.0], np.cumsum(scores)])
    n_pairs = per_line(np.concatenate([[False], pair]))
    plausible = (total[ends] - total[starts]) / np.maximum(n_pairs, 1)

    # broken: replacement and control characters, question marks inside words, and capitals inside words beyond each word's first
    upper = letter & (cp != lower)
    camel = upper & np.concatenate([[False], (letter & ~upper)[:-1]])
    humps = np.concatenate([[0], np.cumsum(camel)])
    in_word = humps[word_to] - humps[word_from]
    more_humps = np.bincount(word_line, weights=np.maximum(in_word - 1, 0), minlength=n)
    odd_inside = before & after & ((cp == 0x3F) | (cp == 0xBF) | (cp == 0xA1))
    broken = per_line((kinds == BROKEN) | odd_inside) + more_humps

    visible = (kinds != SPACE) & (kinds != NEWLINE)
    n_visible = per_line(visible)
    last = np.full(len(cp), -1, np.int64)
    last[visible] = np.flatnonzero(visible)
    last = np.maximum.accumulate(last)[ends]
    quote = (kinds == PUNCT) & np.isin(cp, [0x22, 0x27, 0x29, 0x2019, 0x201D, 0xBB, 0x5D])
    last_kind = kinds[last]
    stepped = quote[last] & (last > starts)
    last_kind = np.where(stepped, kinds[np.maximum(last - 1, 0)], last_kind)

    space = kinds == SPACE
    space_before = np.concatenate([[True], space[:-1]])
    space_after = np.concatenate([space[1:], [True]])
    two_before = space_before & np.concatenate([[True, True], space[:-2]])
    first = np.zeros(len(cp), bool)
    first_at = np.searchsorted(np.flatnonzero(visible), starts)
    first[np.flatnonzero(visible)[np.minimum(first_at, visible.sum() - 1)]] = True
    gaps = per_line(visible & two_before & ~first)
    tabs = per_line((cp == 9) & ~np.concatenate([[True], (kinds == NEWLINE)[:-1]]))
    pipes = per_line(cp == 0x7C)
    tight = ~space_after & ~space_before & np.concatenate([(kinds != NEWLINE)[1:], [False]])
    edge = np.concatenate([(kinds == NEWLINE)[1:], [True]]) | np.concatenate([[True], (kinds == NEWLINE)[:-1]])
    commas = per_line((cp == 0x2C) & (tight | edge))
    semicolons = per_line((cp == 0x3B) & (tight | edge))
    spaced = lambda sign, left: per_line((cp == sign) & space_after & (space_before if left else ~space_before))
    marks = per_line(((kinds == STOP) | np.isin(cp, [0x2C, 0x3A, 0x3B, 0x3001, 0xFF0C])) & (space_after | (cp >= 0x3000)) & ~edge & np.concatenate([[False], visible[:-1]]))
    runs = np.maximum.reduce([spaced(0xB7, True), spaced(0x2022, True), spaced(0x3B, False), spaced(0x2F, True), spaced(0x2C, False), spaced(0x7C, True)])
    return {
        "chars": per_line(kinds != NEWLINE), "visible": n_visible, "words": words, "common": n_common, "word_chars": word_chars,
        "symbols": per_line(visible & ~letter & (kinds != DIGIT)), "ends_stop": last_kind == STOP, "plausible": plausible, "pairs": n_pairs, "broken": broken,
        "cells": np.maximum.reduce([gaps, tabs, np.maximum(pipes - 1, 0), commas, semicolons]), "distinct": distinct, "in_long": in_long, "letters": per_line(letter), "latin": per_line(latin), "dense": per_line(letter & dense_table[cp]), "tabs": tabs, "gaps": gaps, "runs": runs, "marks": marks, "digits": per_line(kinds == DIGIT),
    }


def _seen_near(lines: list[str], sizes: np.ndarray) -> np.ndarray:
    """Lines that equal one of the two lines before or after them in their document."""
    texts = np.array(lines, object)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    near = np.zeros(len(lines), bool)
    for step in (1, 2):
        same = (texts[step:] == texts[:-step]) & (doc[step:] == doc[:-step])
        near[step:] |= same
        near[:-step] |= same
    return near


def observations(lines: list[str], sizes: np.ndarray, s: dict[str, np.ndarray]) -> np.ndarray:
    """Value of each statistic of TABLES for each line."""
    n = len(lines)
    share = s["common"] / np.maximum(s["words"], 1)
    few = np.where(s["common"] > 0, 2, 1)
    many = 3 + (share > 0).astype(int) + (share >= 0.1) + (share >= 0.2) + (share >= 0.3)
    common = np.where(s["words"] == 0, 0, np.where(s["words"] < 4, few, many))
    common[(s["latin"] * 2 < s["letters"])] = 8

    words = np.maximum(s["words"], s["dense"] // 2)
    per_item = words / np.where(s["runs"] >= 2, s["runs"] + 1, 1)
    layout = np.zeros(n, np.int64)
    layout[(s["runs"] >= 4) & (per_item <= 5) & (share < 0.3)] = 3
    layout[(s["cells"] >= 2) & (per_item <= 12) | (s["tabs"] > 0) | (s["gaps"] > 0) & (s["words"] <= 6)] = 4
    for k, line in enumerate(lines):
        if MARKUP.match(line):
            layout[k] = 6
        elif HEX.match(line):
            layout[k] = 7
        elif GRID.match(line) and len(line.split()[0]) in (1, len(line.strip())) and (line.strip(" 01") == "" or not line.strip(" .#■□_*-ABCDEFGHIJKLMNOPQRSTUVWXYZ") and GRID_SIGN.search(line)):
            layout[k] = 5
        elif layout[k] != 4 and ITEM.match(line):
            layout[k] = 2
        elif layout[k] != 4 and BULLET.match(line):
            layout[k] = 1
    per_item = np.where(layout == 3, per_item, words)
    letters = np.where(s["pairs"] < 4, 0, np.where(s["plausible"] >= LETTER_CUTS[1], 1, np.where(s["plausible"] >= LETTER_CUTS[0], 2, 3)))
    letters[common == 8] = 4
    broken_share = s["broken"] / np.maximum(s["visible"], 1)
    broken = np.searchsorted(BROKEN_CUTS, broken_share)
    item = (per_item > 3).astype(int) + (per_item > 8)
    repeat = np.where(_seen_near(lines, sizes), 3, 0)
    repeat[s["in_long"] * 2 > s["letters"]] = 2
    repeat[(s["distinct"] <= 3) & (s["distinct"] * 4 <= s["words"]) & (s["words"] > 0)] = 1
    grid = layout == 5  # a row of a grid has cells and no words
    common[grid] = letters[grid] = item[grid] = 0
    alone = (np.repeat(sizes, sizes) == 1) & (s["runs"] < 2) & (s["cells"] < 2)
    inner = np.where(layout == 3, 2, (s["marks"] > 0) & ~grid)
    return np.stack([common, layout, s["ends_stop"].astype(int), letters, broken, item, repeat, alone.astype(int), inner], axis=1)


def likelihood(observed: np.ndarray, tables: dict[str, np.ndarray] | None = None) -> np.ndarray:
    """Log likelihood of each line in each state."""
    return sum(np.log((tables or globals())[name]).T[observed[:, n]] for n, name in enumerate(TABLES))


def transitions(stay: np.ndarray) -> np.ndarray:
    """Probability of each state after each state: stay in it, or go to one of the others, all alike."""
    k = len(STATES)
    return np.where(np.eye(k, dtype=bool), stay[:, None], (1 - stay[:, None]) / (k - 1))


def decode(likelihood: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Most likely state of each line. likelihood: lines x states of sequences one after another, sizes: their lengths.

    All sequences advance together, longest first, so a step works on those that still have lines.
    """
    labels = np.zeros(len(likelihood), np.int64)
    if not len(likelihood):
        return labels
    k = len(STATES)
    step = np.log(transitions(STAY))
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 0]
    starts = (np.cumsum(sizes) - sizes)[order]
    length = sizes[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")  # sequences with at least t lines
    back = np.zeros((len(likelihood), k), np.int8)
    score = np.log(START) + likelihood[starts]
    for t in range(1, length[0]):
        m = alive[t]
        ways = score[:m, :, None] + step
        best = ways.argmax(axis=1)
        back[starts[:m] + t] = best
        score[:m] = np.take_along_axis(ways, best[:, None, :], axis=1)[:, 0] + likelihood[starts[:m] + t]
    state = score.argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        m = alive[t]
        labels[starts[:m] + t] = state[:m]
        if t:
            state[:m] = back[starts[:m] + t, state[:m]]
    return labels


QUALITY_SCHEMA = "n_words bigint, n_lines bigint, mean_word_length double, symbol_ratio double, stop_line_share double, common_share double, prose_share double, list_share double, table_share double, junk_share double, doc_kind string"


def split_lines(text: str) -> list[str]:
    """The lines of a text that are not blank."""
    return [x for x in BREAK.split(text) if x and not x.isspace()]


def text_quality(docs: DataFrame, key: str, text: str, common_words: Iterable[str], folder: str | None = None) -> DataFrame:
    """One row per document: key and the columns of QUALITY_SCHEMA.

    common_words: frequent words of all languages together, since a document's stated language may be wrong; a fixed
    list, carried with the tasks like the letter model's SYMBOLS x SYMBOLS table. folder: of the tokenizers' files.
    """
    with open(tokenizer_path(VOCABULARY, folder), "rb") as file:
        model = letter_model(file.read())
    common = word_hash(set(common_words))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_slices(batches):
            lines: list[str] = []
            sizes = np.zeros(len(texts), np.int64)
            for n, body in enumerate(texts):
                if body:
                    own = split_lines(body)
                    sizes[n] = len(own)
                    lines += own
            doc = np.repeat(np.arange(len(texts)), sizes)
            total = lambda x: np.bincount(doc, weights=x, minlength=len(texts))
            if lines:
                s = _line_statistics(lines, model, common)
                labels = decode(likelihood(observations(lines, sizes, s)), sizes)
            else:
                s = dict.fromkeys(("chars", "visible", "words", "common", "word_chars", "symbols", "ends_stop"), np.zeros(0))
                labels = np.zeros(0, np.int64)
            words, visible = total(s["words"]), total(s["visible"])
            shares = [total(s["visible"] * (labels == k)) / np.maximum(visible, 1) for k in range(len(STATES))]
            other = np.argmax(np.stack(shares[1:]), axis=0) + 1 if len(texts) else np.zeros(0, int)
            kind = np.where(shares[0] >= PROSE_SHARE, 0, other)
            none = visible == 0
            with np.errstate(invalid="ignore", divide="ignore"):
                ratios = [total(s["word_chars"]) / words, total(s["symbols"]) / visible, total(s["ends_stop"]) / sizes, total(s["common"]) / words]
            floats = [pa.array(x, pa.float64(), mask=~np.isfinite(x)) for x in ratios] + [pa.array(x, pa.float64(), mask=none) for x in shares]
            kinds = pa.array([None if e else STATES[k] for e, k in zip(none, kind)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.astype(np.int64)), pa.array(sizes), *floats, kinds], names=[key, *[x.split()[0] for x in QUALITY_SCHEMA.split(", ")]])

    key_type = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(run, f"`{key}` {key_type}, {QUALITY_SCHEMA}")
