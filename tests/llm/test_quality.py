import random
import textwrap

import numpy as np
import pytest

from cluemill.llm import fitting, quality, queries

COMMON = "the of and to a in is it was that we on with for as".split()
PROSE = "It was a fair puzzle, and we took an hour to see that the last word was in plain sight. The setter had put it in the middle of the clue, with a comma to lead us on."
ODD_LETTERS = "zqx vkj wqz xvq jkz qwv zxk vqj kzw qxj vzk wjq xkv zqw jvx kqz wxv qjk zvw xqk"
CASES = {
    PROSE: "prose", PROSE.upper(): "prose", "\n".join(textwrap.wrap(PROSE, 28)): "prose", PROSE + "\n- lemon\n- candle\n- river": "prose", PROSE.replace(",", "").replace(".", ""): "prose",
    "\n".join(f"- {w}" for w in "lemon candle river garden pilot cousin".split()): "list",
    "lemon; candle; river; garden; pilot; cousin; island; mirror": "list",
    "\n".join(f"{n}. {w.upper()} ({n})" for n, w in enumerate("lemon candle river garden".split(), 3)): "list",
    "day,score,name\n2024-01-02,5,lemon\n2024-01-03,6,river\n2024-01-04,7,pilot": "table",
    "| a | b |\n|---|---|\n| 1 | 2 |\n| 3 | 4 |": "table", "a\tb\tc\n1\t2\t3\n4\t5\t6": "table",
    "#..A.\n.#.#.\nB...C\n.#.#.\n..D.#": "table", "■□■□■\n□□■□□\n■□■□■": "table",
    ODD_LETTERS: "junk", "hahaha" * 60: "junk", "no " * 80: "junk", "0xca1bb549 51 9d 69 a4\n0xcf298c92 21 63 d4 10": "junk",
    '<div class="a"></div><span data-k="1"></span>': "junk", "a�b�¤ ¶¼ �¤¶ M�¤¿e �¶¤": "junk", "🙂" * 60: "junk",
}


NOUNS = "lemon candle river garden pilot cousin island mirror bottle anchor blanket feather jacket umbrella".split()


def items(size):
    """Numbered items of about size characters each."""
    rng = random.Random(size)
    return "\n".join(f"{k}. " + " ".join(rng.choice(NOUNS) for _ in range(size // 7)) for k in range(1, 8))


def grid(rows, columns, signs):
    rng = random.Random(rows)
    return "\n".join("".join(rng.choice(signs) for _ in range(columns)) for _ in range(rows))


def board(size, signs):
    return "\n".join("".join(signs[(i + j) % 2] for j in range(size)) for i in range(size))


#: No statistic turns at a size; prose of other scripts, with odd words, or short stays prose.
FORMS = {
    **{items(n): "list" for n in (150, 199, 200, 400, 2000)}, **{grid(7, n, "ABCDE.#"): "table" for n in (150, 199, 219, 2000)},
    **{board(n, signs): "table" for n in (7, 15, 21) for signs in ("■□", "#.")},
    "Der Donaudampfschifffahrtselektrizitätenhauptbetriebswerkbauunterbeamte war gestern nicht zu Hause.": "prose",
    "Это была хорошая загадка, и мы решали её целый час.": "prose", "Это хорошая загадка.": "prose", "这是一个谜题。我们花了一个小时才解开它。": "prose",
    "I wrote the JavaScript for GitHub on my iPhone and it was fun.": "prose", "an old silent pond\na frog jumps into the pond\nsplash! silence again": "prose",
    "A lovely puzzle": "prose", "Thanks, Anna!": "prose", PROSE * 150: "prose",
}


def test_kinds(spark, texts, data):
    words = [r.word for r in spark.read.parquet(f"{data}/common_word.parquet").collect() if r.word]
    cases = CASES | FORMS
    got = {r.doc_id: r.doc_kind for r in quality.text_quality(texts(list(cases)), "doc_id", "text", words).collect()}
    wrong = {ascii(t[:40]): (got[n], want) for n, (t, want) in enumerate(cases.items()) if got[n] != want}
    assert not wrong


def test_kind_depends_on_the_text_alone(texts):
    kinds = lambda values: [r.doc_kind for r in quality.text_quality(texts(values), "doc_id", "text", COMMON).orderBy("doc_id").collect()]
    assert kinds([*CASES, *[ODD_LETTERS] * 50])[: len(CASES)] == kinds(list(CASES))


def test_words_of_any_length_are_common(texts):
    long = "ab" * 40
    assert quality.text_quality(texts([f"the {long} x"]), "doc_id", "text", [long]).first().common_share == pytest.approx(1 / 3)


def test_fitting_raises_the_likelihood_and_finds_the_states():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 9, 300)
    start = fitting.current()
    observed = np.concatenate([np.stack([rng.choice(start[t].shape[1], n, p=start[t][k] / start[t][k].sum()) for t in quality.TABLES], axis=1) for n, k in zip(sizes, rng.integers(0, 4, 300))])
    found, seen = fitting.fit(observed, sizes, start, rounds=6, prior=1e-9)
    assert seen[-1] > seen[0] and all(np.allclose(found[t].sum(axis=1), 1, atol=0.01) for t in quality.TABLES)
    share, steps, value = fitting.posteriors(start, observed[:5], np.array([2, 3]))
    step, emit = quality.transitions(start["STAY"]), np.exp(quality.likelihood(observed[:5], start))
    paths = [(start["START"][a] * emit[0, a] * step[a, b] * emit[1, b], a, b) for a in range(4) for b in range(4)]
    total = sum(p for p, _, _ in paths)
    assert np.allclose(share[0] * 2**0.5, [sum(p for p, a, _ in paths if a == k) / total for k in range(4)])


def test_statistics_of_one_text(texts):
    row = quality.text_quality(texts(["The cat, it sat.\n\nAnd (so) on"]), "doc_id", "text", COMMON).first()
    assert (row.n_words, row.n_lines) == (7, 2)
    assert row.mean_word_length == pytest.approx(18 / 7) and row.symbol_ratio == pytest.approx(4 / 22)
    assert row.stop_line_share == 0.5 and row.common_share == pytest.approx(4 / 7)


def test_null_empty_blank_and_odd(texts, odd):
    rows = {r.doc_id: r for r in quality.text_quality(texts(odd), "doc_id", "text", COMMON).collect()}
    assert len(rows) == len(odd)
    for n in range(5):
        assert rows[n].doc_kind is None and rows[n].n_words == 0 and rows[n].prose_share is None
    assert quality.text_quality(texts([]), "doc_id", "text", COMMON).count() == 0


def test_decode_is_the_best_path():
    rng = np.random.default_rng(2)
    sizes = np.array([3, 0, 1, 4, 2])
    likelihood = np.log(rng.random((sizes.sum(), 4)))
    got = quality.decode(likelihood, sizes)
    step = np.log(quality.transitions(quality.STAY))
    at = 0
    for size in sizes:
        if size:
            own = likelihood[at : at + size]
            paths = np.stack(np.meshgrid(*[range(4)] * size, indexing="ij"), -1).reshape(-1, size)
            score = np.log(quality.START)[paths[:, 0]] + own[np.arange(size), paths].sum(1) + step[paths[:, :-1], paths[:, 1:]].sum(1)
            assert (paths[score.argmax()] == got[at : at + size]).all()
        at += size


def test_query_leaves_prose_out(spark, data):
    kinds = {r.doc_kind for r in queries.p8_found(spark, data).collect()}
    assert kinds <= {"list", "table", "junk"}
